"""Registered queries on images derived from the events of each user."""

from __future__ import annotations

from pyspark.sql import functions as F

from .operators import regions
from .plans import fixtures as fx
from .registry import query

_SPOTS = """ev AS (SELECT user_id AS img, event_id % 4 AS ch, event_id * 31 % 23 AS y, event_id * 17 % 19 + k AS x, 0.4::DOUBLE + (event_id % 8) / 16.0::DOUBLE AS p
  FROM events, (SELECT unnest(range(4)) AS k) WHERE k <= event_id // 4 % 4),
pr AS (SELECT img, ch, y, x, max(p) AS p FROM ev GROUP BY ALL),
top AS (SELECT img, y, x, max(p) AS t FROM pr GROUP BY ALL HAVING max(p) > 0.5),
sp AS (SELECT img, y, x, CAST(min(ch) + 1 AS INTEGER) AS base FROM pr JOIN top USING (img, y, x) WHERE p = t GROUP BY img, y, x),
reach AS (SELECT img, y, x, y AS ty, x AS tx FROM sp
  UNION SELECT r.img, r.y, r.x, s.y, s.x FROM reach r JOIN sp s ON s.img = r.img AND abs(s.y - r.ty) <= 1 AND abs(s.x - r.tx) <= 1),
reg AS (SELECT img, y, x, min(ty * 4294967296 + tx) AS region FROM reach GROUP BY ALL)"""


def _regions(spark, sf_dir):
    runs = fx.table(spark, sf_dir, "events").withColumn("k", F.explode(F.expr("sequence(0L, event_id div 4 % 4)")))
    probability = runs.selectExpr("user_id AS img", "event_id % 4 AS ch", "event_id * 31 % 23 AS y", "event_id * 17 % 19 + k AS x", "0.4D + (event_id % 8) / 16D AS p")
    return regions.label_regions(regions.spot_pixels(probability, ["img"]), ["img"], tile=8)


@query(f"WITH RECURSIVE {_SPOTS} SELECT img, y, x, base, region FROM sp JOIN reg USING (img, y, x)")
def spot_regions(spark, sf_dir):
    return _regions(spark, sf_dir)


@query(f"""WITH RECURSIVE {_SPOTS} SELECT img, region, base, CAST(round_even(sum(y) / count(*)::DOUBLE, 0) AS INTEGER) AS y, CAST(round_even(sum(x) / count(*)::DOUBLE, 0) AS INTEGER) AS x, count(*) AS n
FROM sp JOIN reg USING (img, y, x) GROUP BY img, region, base""")
def region_calls(spark, sf_dir):
    return regions.region_calls(_regions(spark, sf_dir), ["img"])
