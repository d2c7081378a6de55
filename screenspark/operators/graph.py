"""Exact nearest neighbours by cosine, and communities of a graph, as joins and matrix products of blocks.

Defined results: vectors of norm 0 have similarity 0 with all; rows with a null id or vector are left out; ties between equal similarities
(to nine places) go to the smaller id; loops and null ends of edges are dropped, repeated edges count once.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..plans.lineage import cut

#: Rows that a task looks up neighbours for, and rows of the products it makes for that.
BLOCK, STEP = 1 << 16, 1 << 11

#: Tasks that neighbours are looked up in at least, if they get ``STEP`` rows each.
TASKS = 32

#: Links up to which the rounds of ``communities`` run in the driver: some 100 MB of arrays, whatever the graph they were contracted from.
HERE = 1 << 20

#: Gains up to this are rounding.
LEAST_GAIN = 1e-9

_PRIME = (1 << 31) - 1


# --- nearest neighbours ----------------------------------------------------------------


def _unit(column: pa.Array) -> np.ndarray:
    wide = pc.list_value_length(column).to_numpy()
    if len(wide) and (wide != wide[0]).any():
        raise ValueError("vectors must have one length")
    x = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)
    n = np.linalg.norm(x, axis=1, keepdims=True)
    return np.divide(x, n, out=np.zeros_like(x), where=n > 0)


class _Nearest:
    """The ``k`` nearest of all rows met so far for each row of a block."""

    def __init__(self, ids: np.ndarray, x: np.ndarray, k: int, step: int):
        whole = ~np.isnan(x).any(axis=1)  # the others are near to none
        self.ids, self.x, self.k, self.step = ids[whole], x[whole], k, step
        self.rough = self.x.astype(np.float32)
        self.margin = (x.shape[1] + 8) * 2.0**-23  # products of unit vectors in 32 bits are off by half of that at most
        self.sims, self.others = np.full((len(self.ids), k), -np.inf), np.zeros((len(self.ids), k), dtype=np.int64)

    def meet(self, ids: np.ndarray, x: np.ndarray) -> None:
        whole = ~np.isnan(x).any(axis=1)
        ids, x = ids[whole], x[whole]
        rough = x.astype(np.float32)
        for a in range(0, len(self.ids), self.step):
            rows = slice(a, a + self.step)
            # what 32 bits let through is multiplied anew in 64
            near = self.rough[rows] @ rough.T
            least = self.sims[rows, -1]
            if np.isneginf(least).any() and len(ids) > self.k:
                least = np.maximum(least, np.partition(near, len(ids) - self.k - 1, axis=1)[:, len(ids) - self.k - 1] - self.margin)
            i, j = np.nonzero(near >= (least - self.margin)[:, None].astype(np.float32))
            i += a
            apart = self.ids[i] != ids[j]
            i, j = i[apart], j[apart]
            sims = np.round(np.einsum("ij,ij->i", self.x[i], x[j]), 9)
            good = sims >= self.sims[i, -1]
            self._keep(i[good], sims[good], ids[j[good]])

    def _keep(self, i: np.ndarray, sims: np.ndarray, others: np.ndarray) -> None:
        rows = np.unique(i)
        i = np.concatenate([i, np.repeat(rows, self.k)])
        sims, others = np.concatenate([sims, self.sims[rows].ravel()]), np.concatenate([others, self.others[rows].ravel()])
        order = np.lexsort((others, -sims, i))
        i = i[order]
        place = np.arange(len(i)) - np.searchsorted(i, i)
        first = place < self.k
        self.sims[i[first], place[first]] = sims[order][first]
        self.others[i[first], place[first]] = others[order][first]

    def table(self) -> pa.RecordBatch:
        found = self.sims > -np.inf
        near = pa.StructArray.from_arrays([pa.array(self.sims[found]), pa.array(self.others[found])], names=["sim", "id"])
        ends = np.concatenate([[0], np.cumsum(found.sum(axis=1))]).astype(np.int32)
        return pa.RecordBatch.from_arrays([pa.array(self.ids), pa.ListArray.from_arrays(pa.array(ends), near)], names=["id", "near"])


def _lookup(k: int, step: int):
    """Neighbours of the rows on side 0 of each pair of blocks among those on side 1, which follow them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pair, lefts, block = None, [], None
        for batch in batches:
            task, side = batch.column("task").to_numpy(), batch.column("side").to_numpy()
            begun = np.flatnonzero((np.diff(task, prepend=-1) != 0) | (np.diff(side, prepend=-1) != 0))
            for a, b in zip(begun, np.append(begun[1:], len(task)), strict=True):
                if task[a] != pair:
                    if block is not None:
                        yield block.table()
                    pair, lefts, block = task[a], [], None
                part = batch.slice(a, b - a)
                ids, v = part.column("id").to_numpy(), part.column("v")
                if side[a] == 0:
                    lefts.append((ids, _unit(v)))
                    continue
                if block is None and lefts:
                    block = _Nearest(np.concatenate([x[0] for x in lefts]), np.concatenate([x[1] for x in lefts]), k, step)
                    lefts = []
                for c in range(0, len(ids) if block else 0, step):
                    block.meet(ids[c : c + step], _unit(v.slice(c, step)))
        if block is not None:
            yield block.table()

    return run


def dealt(n: int, block: int, step: int, tasks: int) -> tuple[int, int]:
    """Blocks and parts of ``n`` rows: as few copies of a row as give so many tasks, none of them below ``step`` rows."""
    most = max(1, -(-n // step))
    blocks = max(-(-n // block), min(math.isqrt(tasks) + 1, most), 1)
    return blocks, min(-(-tasks // blocks), most)


def knn_graph(df: DataFrame, k: int, ident: str = "id", vector: str = "features", block: int = BLOCK, step: int = STEP) -> DataFrame:
    """``id, other, rank, sim``: the ``k`` rows most similar to each row by cosine, the row itself apart.

    Rows are dealt by a hash of the id to blocks whose neighbours are wanted and to parts they are wanted among, one task for each pair.  A block is held
    in memory, about ``block`` rows; the part streams past it ``step`` rows at a time.  A row is thus copied once per block and once per part; there are no
    more of either than ``block``, ``TASKS`` and the session's cores ask for.  Partial lists of ``k`` rows per part are all that is shuffled after the products.
    """
    kind = "array<float>" if df.schema[vector].dataType.simpleString() == "array<float>" else "array<double>"
    rows = df.select(F.col(ident).cast("long").alias("id"), F.col(vector).cast(kind).alias("v")).dropna()
    n = rows.count()
    blocks, parts = dealt(n, block, step, max(TASKS, 2 * df.sparkSession.sparkContext.defaultParallelism))
    own = F.xxhash64("id")
    left = rows.select(F.pmod(own, F.lit(blocks)).alias("i"), F.explode(F.sequence(F.lit(0), F.lit(parts - 1))).alias("j"), F.lit(0).alias("side"), "id", "v")
    right = rows.select(F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("i"), F.pmod(F.shiftright(own, 20), F.lit(parts)).alias("j"), F.lit(1).alias("side"), "id", "v")
    both = left.union(right).select((F.col("i") * parts + F.col("j")).cast("int").alias("task"), "side", "id", "v")
    placed = both.repartitionById(blocks * parts, "task").sortWithinPartitions("task", "side")
    found = placed.mapInArrow(_lookup(k, step), "id long, near array<struct<sim: double, id: long>>")
    order = lambda a, b: F.when(a["sim"] > b["sim"], -1).when(a["sim"] < b["sim"], 1).when(a["id"] < b["id"], -1).when(a["id"] > b["id"], 1).otherwise(0)
    best = found.groupBy("id").agg(F.slice(F.array_sort(F.flatten(F.collect_list("near")), order), 1, k).alias("near"))
    return best.select("id", F.posexplode("near").alias("rank", "n")).select("id", F.col("n.id").alias("other"), (F.col("rank") + 1).alias("rank"), F.col("n.sim").alias("sim"))


# --- communities -----------------------------------------------------------------------


def quality(edges: DataFrame, members: DataFrame, resolution: float) -> float:
    """Links inside communities less ``resolution`` times their expected number at the graph's density.

    ``edges(a, b, w)`` hold each pair once, a loop (a = b) the links inside a contracted vertex; ``members(v, size, c)``.
    """
    inside = edges.join(members.select(F.col("v").alias("a"), F.col("c").alias("ca")), "a").join(members.select(F.col("v").alias("b"), F.col("c").alias("cb")), "b")
    held = inside.agg(F.sum("w").alias("all"), F.sum(F.when(F.col("ca") == F.col("cb"), F.col("w"))).alias("own")).first()
    n = members.agg(F.sum("size").alias("n")).first().n or 0
    pairs = members.groupBy("c").agg(F.sum("size").alias("s")).agg(F.sum(F.col("s") * (F.col("s") - 1) / 2).alias("p")).first().p or 0.0
    density = (held["all"] or 0.0) / (n * (n - 1) / 2) if n > 1 else 0.0
    return (held["own"] or 0.0) - resolution * density * pairs


def _factor(turn: int) -> int:
    """What hashes of a turn multiply ids by, modulo ``_PRIME``; the first powers would leave small ids in order."""
    return pow(48271, turn + 10, _PRIME)


def _moves(both: DataFrame, members: DataFrame, price: float, largest: int | None, turn: int) -> DataFrame:
    """``v, to, gain``: moves that raise the quality together by at least a part of each one's ``gain``; ``both(v, u, w)`` has links both ways round.

    Each vertex names its best move.  Of the moves that touch a community the first says whether it gives or takes in this turn, and only moves
    from givers to takers go on.  A taker loses nobody, so links count at least what each move counted; what moves of one giver or taker cost
    each other is ``price`` times the product of their sizes, and a move stays if its gain outweighs that for all moves before it.
    A taker also stops once it has doubled: communities that grow in a single turn end up worse.  The first of all moves always stays.
    """
    sizes = members.groupBy("c").agg(F.sum("size").alias("s"))
    links = both.join(members.select(F.col("v").alias("u"), F.col("c").alias("to")), "u").groupBy("v", "to").agg(F.sum("w").alias("w"))
    own = members.join(sizes, "c").select("v", "size", "c", F.col("s").alias("s_own"))
    stay = links.withColumnRenamed("to", "c").withColumnRenamed("w", "w_own")
    found = links.join(own, "v").filter("to <> c").join(sizes.toDF("to", "s_to"), "to").join(stay, ["v", "c"], "left")
    gain = F.col("w") - F.coalesce("w_own", F.lit(0.0)) - price * (F.col("size") * (F.col("s_to") - (F.col("s_own") - F.col("size"))))
    found = found.withColumn("gain", gain).filter(F.col("gain") > LEAST_GAIN)
    if largest is not None:
        found = found.filter(F.col("s_to") + F.col("size") <= largest)
    # equal gains go by a hash of their target, another one each turn: by ids, hardly any community would take
    toss = lambda c: F.pmod(F.col(c), F.lit(_PRIME)) * _factor(turn) % _PRIME
    rank = F.struct("gain", toss("to").alias("h"), (-F.col("to")).alias("to"), "s_to")
    best = found.groupBy("v", "c", "size").agg(F.max(rank).alias("m")).select("v", "c", "size", (-F.col("m.to")).alias("to"), "m.gain", "m.s_to")
    best = best.withColumn("mark", F.struct("gain", toss("to").alias("h"), (-F.col("to")).alias("to"), (-F.col("v")).alias("v")))
    sides = F.array(F.struct(F.col("c").alias("k"), F.lit(False).alias("takes")), F.struct(F.col("to").alias("k"), F.lit(True).alias("takes")))
    role = best.select("mark", F.explode(sides).alias("r")).groupBy("r.k").agg(F.max_by("r.takes", "mark").alias("takes"))
    kept = best.join(role.filter("NOT takes").select(F.col("k").alias("c")), "c").join(role.filter("takes").select(F.col("k").alias("to")), "to")
    before = lambda key: F.coalesce(F.sum("size").over(Window.partitionBy(key).orderBy(F.desc("mark")).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    kept = kept.withColumn("joined", before("to")).withColumn("left", before("c"))
    kept = kept.withColumn("gain", F.col("gain") - price * (F.col("size") * (F.col("joined") + F.col("left")))).filter((F.col("gain") > LEAST_GAIN) & (F.col("joined") < F.col("s_to")))
    if largest is not None:
        kept = kept.filter(F.col("s_to") + F.col("joined") + F.col("size") <= largest)
    return kept.select("v", "to", "gain")


def _moves_here(links: tuple[np.ndarray, ...], names: np.ndarray, size: np.ndarray, c: np.ndarray, price: float, largest: int | None, turn: int) -> tuple[np.ndarray, np.ndarray]:
    """Vertices and the communities they move to: ``_moves`` on arrays, with the same results.  Vertices are places in the sorted ``names``."""
    v, u, w = links
    n, most = len(names), np.inf if largest is None else largest
    held = np.bincount(c, size, n).astype(np.int64)
    key = v * n + c[u]
    order = np.argsort(key, kind="stable")
    first = np.flatnonzero(np.diff(key[order], prepend=-1))
    weight = np.add.reduceat(w[order], first) if len(first) else w[:0]
    at, to = v[order][first], c[u[order][first]]
    inside = to == c[at]
    own = np.zeros(n)
    own[at[inside]] = weight[inside]
    gain = weight - own[at] - price * (size[at] * (held[to] - (held[c[at]] - size[at])))
    good = ~inside & (gain > LEAST_GAIN) & (held[to] + size[at] <= most)
    at, to, gain = at[good], to[good], gain[good]
    toss = np.mod(names, _PRIME) * _factor(turn) % _PRIME
    order = np.lexsort((to, -toss[to], -gain, at))
    best = order[np.flatnonzero(np.diff(at[order], prepend=-1))]
    best = best[np.lexsort((at[best], to[best], -toss[to[best]], -gain[best]))]
    at, to, gain = at[best], to[best], gain[best]
    top = np.full(n, len(at))
    for side in (c[at], to):
        np.minimum.at(top, side, np.arange(len(at)))
    takes = np.zeros(n, dtype=bool)
    touched = np.flatnonzero(top < len(at))
    takes[touched] = to[top[touched]] == touched
    go = takes[to] & ~takes[c[at]]
    at, to, gain = at[go], to[go], gain[go]

    def before(group: np.ndarray) -> np.ndarray:
        order = np.argsort(group, kind="stable")
        total = np.cumsum(size[at][order]) - size[at][order]
        begun = np.flatnonzero(np.diff(group[order], prepend=-1))
        out = np.empty(len(group), dtype=np.int64)
        out[order] = total - np.repeat(total[begun], np.diff(np.append(begun, len(group))))
        return out

    joined, left = before(to), before(c[at])
    stays = (joined < held[to]) & (gain - price * (size[at] * (joined + left)) > LEAST_GAIN) & (held[to] + joined + size[at] <= most)
    return at[stays], to[stays]


def _levels_here(graph: DataFrame, state: DataFrame, price: float, resolution: float, largest: int | None, turn: int, trace: list[float] | None) -> DataFrame:
    """``v, c`` of the vertices of ``state`` after all rounds and levels, made in the driver."""
    table = state.orderBy("v").toArrow()
    names, size = table.column("v").to_numpy(), table.column("size").to_numpy()
    edges = graph.toArrow()
    a, b = (np.searchsorted(names, edges.column(k).to_numpy()) for k in ("a", "b"))
    w = edges.column("w").to_numpy()
    ids, node = names, np.arange(len(names))  # the vertex of the contracted graph that holds each of ``ids``
    while True:
        n, c, moved = len(names), np.arange(len(names)), False
        apart = a != b
        links = tuple(np.concatenate(k) for k in ((a[apart], b[apart]), (b[apart], a[apart]), (w[apart], w[apart])))
        while True:
            turn += 1
            at, to = _moves_here(links, names, size, c, price, largest, turn)
            if not len(at):
                break
            moved = True
            c[at] = to
            if trace is not None:
                held, every = np.bincount(c, size), float(size.sum())
                density = w.sum() / (every * (every - 1) / 2) if every > 1 else 0.0
                trace.append(float(w[c[a] == c[b]].sum() - resolution * density * (held * (held - 1) / 2).sum()))
        if not moved:
            break
        kept, c = np.unique(c, return_inverse=True)
        names, size, node = names[kept], np.bincount(c, size).astype(np.int64), c[node]
        key, place = np.unique(np.minimum(c[a], c[b]) * n + np.maximum(c[a], c[b]), return_inverse=True)
        a, b, w = key // n, key % n, np.bincount(place, w, len(key))
    return state.sparkSession.createDataFrame(pa.table([pa.array(ids, pa.int64()), pa.array(names[node], pa.int64())], names=["v", "c"]))


def communities(edges: DataFrame, resolution: float = 1.0, largest: int | None = None, trace: list[float] | None = None, here: int = HERE) -> DataFrame:
    """``v, c``: communities of the undirected graph ``edges(a, b)``, named by their smallest vertex.

    Quality (``quality``) is raised by moving vertices in rounds; in a round every community either gives vertices or takes some (``_moves``), so
    the moves of a round raise it together.  When nothing moves, communities become vertices of a contracted graph
    and rounds go on there, until a level moves nothing.  Nothing is drawn at random and ties go by hashes of ids, so labels depend on
    the graph alone.  ``trace`` gets the quality after every round.  ``largest`` limits vertices per community.  From the level on that has at most
    ``here`` links, rounds run in the driver, where they give the same labels.
    """
    pairs = edges.select(F.least("a", "b").cast("long").alias("a"), F.greatest("a", "b").cast("long").alias("b")).dropna().filter("a <> b").distinct()
    graph = cut(pairs.withColumn("w", F.lit(1.0)))
    state = cut(graph.select(F.explode(F.array("a", "b")).alias("v")).distinct().select("v", F.lit(1).cast("long").alias("size"), F.col("v").alias("c")))
    whole = state.select("v", "c")
    n = state.count()
    price = resolution * graph.count() / (n * (n - 1) / 2) if n > 1 else 0.0
    if trace is not None:
        trace.append(quality(graph, state, resolution))
    turn, links = 0, graph.count()
    while True:
        if links <= here:
            final = cut(_levels_here(graph, state, price, resolution, largest, turn, trace))
            whole = whole.withColumnRenamed("c", "node").join(final.select(F.col("v").alias("node"), "c"), "node").select("v", "c")
            break
        moved = False
        ends = graph.filter("a <> b")
        both = cut(ends.select("a", "b", "w").union(ends.select("b", "a", "w")).toDF("v", "u", "w"))
        while True:
            turn += 1
            step = _moves(both, state, price, largest, turn).select("v", "to")
            after = cut(state.join(step, "v", "left").select("v", "size", F.coalesce("to", "c").alias("c"), F.col("to").isNotNull().alias("moved")))
            if after.filter("moved").isEmpty():
                break
            moved = True
            state = after.drop("moved")
            if trace is not None:
                trace.append(quality(graph, state, resolution))
        if not moved:
            break
        whole = cut(whole.withColumnRenamed("c", "node").join(state.select(F.col("v").alias("node"), "c"), "node").select("v", "c"))
        ends = graph.join(state.select(F.col("v").alias("a"), F.col("c").alias("ca")), "a").join(state.select(F.col("v").alias("b"), F.col("c").alias("cb")), "b")
        graph = cut(ends.groupBy(F.least("ca", "cb").alias("a"), F.greatest("ca", "cb").alias("b")).agg(F.sum("w").alias("w")))
        state = cut(state.groupBy("c").agg(F.sum("size").alias("size")).select(F.col("c").alias("v"), "size", "c"))
        links = graph.count()
    return whole.withColumn("c", F.min("v").over(Window.partitionBy("c")))
