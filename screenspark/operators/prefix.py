"""Running sums, minima and maxima over an order, in two levels, so that no task sees a whole group.

Rows are range-partitioned by group and order and stored with the number of their range.  Ranges are summed
in a table with a row per range and group, its running totals are the small step, and every range adds what
came before it to its own running values.  A group may be all rows, or a third of them.

Defined results: rows that are equal in group and order are in an order of their own choice, so callers aggregate to distinct
keys first where that matters; null groups are a group; an empty table gives an empty table.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..plans.lineage import cut

_AGG = {"sum": F.sum, "min": F.min, "max": F.max, "count": F.count}


def in_ranges(df: DataFrame, keys: list[str], order: list[tuple[str, bool]]) -> DataFrame:
    """``df`` stored in ranges of group and order (name, descending), with the number ``_part`` of each row's range."""
    placed = df.repartitionByRange(*[F.col(k) for k in keys], *_sort(order)) if df.columns else df
    return cut(placed.withColumn("_part", F.spark_partition_id()))


def _sort(order: list[tuple[str, bool]]) -> list[Column]:
    return [F.col(c).desc() if down else F.col(c).asc() for c, down in order]


def _same(left: DataFrame, right: DataFrame, names: list[str]) -> Column:
    return reduce(lambda a, b: a & b, (left[c].eqNullSafe(right[c]) for c in names))


def running(df: DataFrame, keys: list[str], order: list[tuple[str, bool]], running: dict[str, tuple[str, str]], whole: dict[str, tuple[str, str]] | None = None, ahead: dict[str, str] | None = None) -> DataFrame:
    """``df`` with running aggregates along ``order`` inside each group, itself included.

    ``running`` and ``whole`` name columns by ``(function, column)``, function one of sum, min, max and count; ``whole`` are those of the
    complete group.  ``ahead`` names columns that hold the next row's value (null after the last).
    """
    whole, ahead = whole or {}, ahead or {}
    ranged = in_ranges(df, keys, order)
    along = Window.partitionBy("_part", *keys).orderBy(*_sort(order))
    upto = along.rowsBetween(Window.unboundedPreceding, 0)
    parts = ranged.groupBy("_part", *keys).agg(
        *(_AGG[f](c).alias(f"_r_{n}") for n, (f, c) in running.items()),
        *(_AGG[f](c).alias(f"_w_{n}") for n, (f, c) in whole.items()),
        F.min(F.struct(*(_rank(ranged, c, down).alias(f"o{i}") for i, (c, down) in enumerate(order)), *(F.col(c).alias(f"a_{n}") for n, c in ahead.items()))).alias("_first"),
    )
    # a row per range and group: the running totals of this table are bounded by the number of ranges
    group = Window.partitionBy(F.lit(0), *keys)
    earlier = group.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    again = {"count": "sum"}
    offsets = parts.select(
        "_part", *keys,
        *(_AGG[again.get(f, f)](f"_r_{n}").over(earlier).alias(f"_b_{n}") for n, (f, _) in running.items()),
        *(_AGG[again.get(f, f)](f"_w_{n}").over(group).alias(n) for n, (f, _) in whole.items()),
        *(F.lead(F.col(f"_first.a_{n}")).over(group.orderBy("_part")).alias(f"_n_{n}") for n in ahead),
    )
    own = ranged.select(
        *ranged.columns,
        *(_AGG[f](c).over(upto).alias(f"_l_{n}") for n, (f, c) in running.items()),
        *(F.lead(c).over(along).alias(f"_h_{n}") for n, c in ahead.items()),
        *([F.lead(F.lit(True)).over(along).alias("_more")] if ahead else []),
    )
    both = own.join(offsets, _same(own, offsets, ["_part", *keys]))

    def total(name: str, f: str) -> Column:
        local, before = F.col(f"_l_{name}"), F.col(f"_b_{name}")
        if f in ("sum", "count"):
            return F.when(before.isNull(), local).when(local.isNull(), before).otherwise(before + local)
        return F.least(local, before) if f == "min" else F.greatest(local, before)

    return both.select(
        *(own[c] for c in df.columns),
        *(total(n, f).alias(n) for n, (f, _) in running.items()),
        *(F.col(n) for n in whole),
        *(F.when(F.col("_more"), F.col(f"_h_{n}")).otherwise(F.col(f"_n_{n}")).alias(n) for n in ahead),
    )


def _rank(df: DataFrame, name: str, down: bool) -> Column:
    """A value whose ascending order is that of the column, for numbers, booleans and (ascending) any other type; nulls first in ascending order."""
    if not down:
        return F.struct(F.col(name).isNotNull().alias("n"), F.col(name).alias("v"))
    return F.struct(F.col(name).isNull().alias("n"), (-F.col(name)).alias("v"))


def row_numbers(df: DataFrame, keys: list[str], order: list[tuple[str, bool]], name: str) -> DataFrame:
    """``df`` with the place of each row in its group, from 1."""
    return running(df.withColumn("_one", F.lit(1).cast("long")), keys, order, {name: ("sum", "_one")}).drop("_one")


def last_values(df: DataFrame, keys: list[str], order: list[tuple[str, bool]], value: str, width: int, name: str) -> DataFrame:
    """``df`` with an array of the last ``width`` values along the order, the row's own at its end.

    Ranges get the last ``width - 1`` values before them; each range has a row at least, so as many ranges back suffice.
    """
    ranged = in_ranges(df, keys, order)
    along = Window.partitionBy("_part", *keys).orderBy(*_sort(order))
    own = ranged.withColumn("_near", F.collect_list(F.struct(F.col(value).alias("v"))).over(along.rowsBetween(-(width - 1), 0)))
    back = Window.partitionBy("_part", *keys).orderBy(*(F.col(c).asc() if down else F.col(c).desc() for c, down in order))
    tails = ranged.withColumn("_i", F.row_number().over(back)).filter(F.col("_i") < width)
    tails = tails.groupBy("_part", *keys).agg(F.transform(F.sort_array(F.collect_list(F.struct((-F.col("_i")).alias("i"), F.col(value).alias("v")))), lambda s: F.struct(s["v"].alias("v"))).alias("_tail"))
    before = Window.partitionBy(F.lit(0), *keys).orderBy("_part").rowsBetween(-(width - 1), -1) if width > 1 else None
    offsets = tails.select("_part", *keys, F.flatten(F.collect_list("_tail").over(before)).alias("_before")) if before is not None else None
    if offsets is None:
        return own.select(*df.columns, F.col("_near.v").alias(name))
    both = own.join(offsets, _same(own, offsets, ["_part", *keys]))
    joined = F.concat("_before", "_near")
    return both.select(*(own[c] for c in df.columns), F.transform(F.slice(joined, F.greatest(F.lit(1), F.size(joined) - width + 1), width), lambda s: s["v"]).alias(name))
