"""Connected components of an edge table by minimum labels, root hooking and pointer jumping.

Only DataFrame joins and minima with a partial combine; labels are written to the shared
folder after each round, so a lost executor costs a round at most.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import FEW_ROWS, discard, join_counted, materialise, replace_table


def connected_components(edges: DataFrame) -> DataFrame:
    """``v, c``: for every endpoint of ``edges(a, b)`` the smallest vertex that it reaches.

    No edges give an empty table.  Loops and repeated edges are harmless; null endpoints are dropped.
    Labels only fall and rounds end when none does, so there is no limit on rounds.  A label may
    be that of a third of all vertices: what is joined by label is first counted by label.
    """
    pairs = edges.select("a", "b").filter("a is not null and b is not null")
    both = materialise(pairs.union(pairs.select("b", "a")).toDF("v", "u").distinct())
    labels = materialise(both.groupBy("v").agg(F.min("u").alias("c")).select("v", F.least("v", "c").alias("c")))
    few = labels.count() <= FEW_ROWS
    small = F.broadcast if few else lambda df: df
    while True:
        near = both.join(small(labels.select(F.col("v").alias("u"), "c")), "u").groupBy("v").agg(F.min("c").alias("m"))
        lowered = materialise(labels.join(near, "v").select("v", F.col("c").alias("was"), F.least("c", "m").alias("c")))
        # a vertex whose label falls takes its old label along, or long chains settle a hop a round
        roots = lowered.filter("c < was").groupBy(F.col("was").alias("v")).agg(F.min("c").alias("r"))
        hooked = lowered.join(small(roots), "v", "left").select("v", "was", F.least("c", "r").alias("c"))
        # the label's own label, one hop further
        above = labels.select(F.col("v").alias("c"), F.col("c").alias("up"))
        if few:
            jumped = materialise(hooked.join(small(above), "c").select("v", "was", F.least("c", "up").alias("c")))
            discard(labels, lowered)
        else:
            hooked = replace_table(lowered, hooked)
            up = materialise(hooked.groupBy("c").agg(F.count("*").alias("rows")).join(above, "c"))
            jumped = materialise(join_counted(hooked, up, "c", "rows").select("v", "was", F.least("c", "up").alias("c")))
            discard(labels, hooked, up)
        labels = jumped
        if labels.filter("c <> was").isEmpty():
            discard(both)
            out = labels.select("v", "c")
            out.scratch_path = labels.scratch_path
            return out


def join_components(labels: DataFrame, edges: DataFrame) -> DataFrame:
    """``v, c``: the labels after ``edges(a, b)`` are added to the graph that ``labels(v, c)`` describes.

    Only the components that the new edges touch are labelled again: the edges are contracted to the
    labels of their ends (an end without a label is its own), so the work follows the new edges.
    """
    ends = edges
    for end in ("a", "b"):
        ends = ends.join(labels.select(F.col("v").alias(end), F.col("c").alias(f"c{end}")), end, "left")
    merged = connected_components(ends.select(F.coalesce("ca", "a").alias("a"), F.coalesce("cb", "b").alias("b")))
    # a label may be that of a third of all vertices: counted by label before the join
    sizes = labels.groupBy("c").agg(F.count("*").alias("rows"))
    after = materialise(sizes.join(merged.select(F.col("v").alias("c"), F.col("c").alias("to")), "c", "left").select("c", F.coalesce("to", "c").alias("to"), "rows"))
    old = join_counted(labels, after, "c", "rows").select("v", F.col("to").alias("c"))
    new = merged.join(labels.select("v"), "v", "left_anti").select("v", "c")
    out = materialise(old.union(new))
    discard(merged, after)
    return out
