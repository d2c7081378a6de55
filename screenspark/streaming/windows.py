"""Structured Streaming forms of window and normalisation steps (an extension: batch tables are the main surface)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _timed(events: DataFrame, time: str, late: str) -> DataFrame:
    return events.withColumn(time, F.col(time).cast("timestamp")).withWatermark(time, late)


def counts(events: DataFrame, time: str, key: str, width: str, late: str, slide: str | None = None) -> DataFrame:
    """Events, mean and maximum of ``value`` per key and tumbling or sliding window; rows later than the watermark go."""
    window = F.window(time, width, slide) if slide else F.window(time, width)
    rows = _timed(events, time, late).groupBy(window.alias("w"), key)
    return rows.agg(F.count("*").alias("n"), F.avg("value").alias("mean"), F.max("value").alias("top")).select(key, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n", "mean", "top")


def sessions(events: DataFrame, time: str, key: str, gap: str, late: str) -> DataFrame:
    rows = _timed(events, time, late).groupBy(F.session_window(time, gap).alias("w"), key)
    return rows.agg(F.count("*").alias("n")).select(key, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


def normalize_stream(cells: DataFrame, control: DataFrame) -> DataFrame:
    """``z`` of arriving long cells against frozen control statistics ``plate_well, dim, center, scale`` (stream-static join)."""
    z = F.try_divide(F.col("x") - F.col("center"), F.col("scale"))
    return cells.join(control, ["plate_well", "dim"], "left").withColumn("z", z).drop("center", "scale")
