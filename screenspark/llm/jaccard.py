"""Exact Jaccard join of documents' shingle sets in the Jaccard metric space.

Distance is ``1 - |x & y| / |x | y|`` over distinct five-word shingles, and a link is a distance of at
most ``r = 0.25``.  Most documents of a corpus lie at distance 1 from almost every other, so
whole documents as pivots cannot split it.  Two kinds of pivots are used instead, and
every step below loses no link:

1. *Sketch.*  A count sketch over all shingles of all documents (its size follows the counted rows)
   orders shingles from rare to frequent; any fixed order is right, this one is cheap.
2. *Voronoi regions of single shingles.*  A set's nearest single-shingle pivots are its own
   shingles, all tied; it is replicated into the regions of the first ``|x| - ceil(0.75 |x|) + 1``
   of them in that order, the window outside which no partner within r can lie.  Documents
   with equal sets are one vertex from the start.
3. *Small regions* (up to ``SMALL`` vertices) yield the pairs inside the size window.
4. *Large regions* are split by whole documents as pivots, recursively, until none holds more than
   ``BLOCK`` vertices.  Sets are contracted into ``BUCKETS`` counts, whose L1 distance l is a metric that
   never exceeds the size of the symmetric difference.  A vertex x of n shingles goes to its nearest
   pivot p; a partner y of a nearer pivot q has ``l(x,q) <= l(x,p) + 2 l(x,y) <= l(x,p) + 2 n / 3``, so x is
   replicated to the later regions q inside this triangle window, and to no others.  A split
   is kept where it lowers the number of rows to compare; a region in which everything is close to
   everything (a group of near copies) is dealt into blocks instead, of which only
   the parts that are not yet connected meet the others.
5. *Rounds.*  Candidates of each vertex are verified on the whole sets: its nearest pivot or nearest small-region
   partner first, then the nearest partners in its regions that are not yet connected with it, at last all
   that no bound (size window, triangle inequality, l) excludes and that are still apart.

Links are returned between vertices (distinct sets), with membership; components follow by
minimum labels.  Hashes are 64 bits (see ``shingles``); sets are told apart by 128 bits.

Defined results: null, empty and blank texts have an empty set, link with nothing and are
their own component; texts under five words are one element; rows with a null id take part
and get the component's smallest non-null id (null if there is none); repeated rows are equal
sets; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import discard, documents, join_counted, materialise, replace_table, slices, small_batches, utf8
from .components import connected_components, join_components
from .shingles import WIDTH, mix, shingle_sets

#: Links have 100 * |x & y| >= PERCENT * |x | y|.
PERCENT = 75
SMALL = 16
#: Cells of the sketch are 2**SKETCH_BITS at least, and up to 2**MOST_BITS four times the number of rows.
SKETCH_BITS = 22
MOST_BITS = 26
STRIPS = 64
#: Counts of a set: this many, or 8 or 64 times as many for sets above 8 or 64 times as many elements.
BUCKETS = 128
#: Vertices of a region that is compared as a whole, and of a block of a region that pivots cannot split.
BLOCK = 1024
#: Pivots that split a region at a time, about.
PIVOTS = 64
#: Bytes of text whose sets a task holds at a time.
STEP_BYTES = 1 << 19
#: Vertices of a region that one task measures to its pivots.
DEAL = 16_384


# --- 1. sketch -------------------------------------------------------------------------


def _count_cells(width: int, bits: int):
    def run(batches):
        total = np.zeros(1 << bits, dtype=np.uint32)
        for batch in slices(batches, limit=STEP_BYTES):
            for found in shingle_sets(utf8(batch), width):
                np.add.at(total, (found >> np.uint64(64 - bits)).astype(np.int64), np.uint32(1))
        if total.any():
            yield from _strips(total)

    return run


def _strips(total: np.ndarray):
    parts = total.reshape(STRIPS, -1)
    yield pa.record_batch([pa.array(range(STRIPS), pa.int32()), pa.array([zlib.compress(_narrow(p), 1) for p in parts], pa.binary())], names=["strip", "cells"])


def _narrow(part: np.ndarray) -> bytes:
    kind = np.min_scalar_type(int(part.max()))
    return kind.itemsize.to_bytes(1, "little") + part.astype(f"u{kind.itemsize}").tobytes()


def _widen(data: bytes) -> np.ndarray:
    raw = zlib.decompress(data)
    return np.frombuffer(raw, dtype=f"u{raw[0]}", offset=1).astype(np.uint64)


def _add_strips(batches):
    sums: dict[int, np.ndarray] = {}
    for batch in batches:
        for strip, cells in zip(batch.column("strip").to_pylist(), batch.column("cells"), strict=True):
            part = _widen(cells.as_py())
            sums[strip] = sums[strip] + part if strip in sums else part
    if sums:
        yield pa.record_batch([pa.array(list(sums), pa.int32()), pa.array([zlib.compress(_narrow(p), 1) for p in sums.values()], pa.binary())], names=["strip", "cells"])


def cell_totals(rows: DataFrame, run, bits: int) -> np.ndarray:
    """Sums per cell over all tasks.  ``2**bits`` numbers reach the driver, whatever the input."""
    strips = rows.mapInArrow(run, "strip int, cells binary").repartition(STRIPS, "strip").mapInArrow(_add_strips, "strip int, cells binary").collect()
    out = np.zeros((STRIPS, (1 << bits) // STRIPS), dtype=np.uint64)
    for row in strips:
        out[row.strip] += _widen(bytes(row.cells))
    return out.ravel()


def rank_classes(totals: np.ndarray) -> np.ndarray:
    """Frequency class of each cell: 0 up to three deviations above the usual load, then one per doubling of what exceeds it.

    The usual load is the median, the deviation that of a Poisson number, so what a rare shingle may
    have beside it in its cell grows with the root of the corpus only.
    """
    usual = float(np.median(totals))
    excess = (totals - usual) / (3 * np.sqrt(usual) + 2)
    return np.floor(np.log2(np.maximum(excess, 0.5)) + 1).astype(np.uint8)


# --- 2. vertices and cells -------------------------------------------------------------


def window(n: int, percent: int = PERCENT) -> int:
    """How many first shingles of a set of size n every partner must share one of."""
    return n - -(-percent * n // 100) + 1


_SIGNED = pa.schema([("doc_id", pa.int64()), ("pos", pa.int64()), ("n", pa.int64()), ("digest", pa.binary()), ("first", pa.binary()), ("counts", pa.binary())])


def _signatures(width: int, percent: int, bits: int, shared):
    def run(batches):
        classes = shared.value
        for batch in slices(batches, limit=STEP_BYTES):
            sizes, digests, firsts, counts = [], [], [], []
            for found in shingle_sets(utf8(batch), width):
                n = len(found)
                sizes.append(n)
                digests.append(_digest(found))
                counts.append(_counts(found))
                if not n:
                    firsts.append(b"")
                    continue
                k = window(n, percent)
                rank = classes[(found >> np.uint64(64 - bits)).astype(np.int64)]
                light = found[rank == 0]
                if len(light) < k:  # sets are sorted by hash, a stable sort by class keeps that
                    order = np.argsort(rank, kind="stable")[:k]
                    chosen, hot = found[order], rank[order] > 0
                else:
                    chosen, hot = light[:k], np.zeros(k, dtype=bool)
                firsts.append(np.concatenate((chosen, np.packbits(hot).astype(np.uint64))).tobytes() if hot.any() else chosen.tobytes())
            yield pa.record_batch(
                [batch.column("doc_id").cast(pa.int64()), batch.column("pos").cast(pa.int64()), pa.array(sizes, pa.int64()), pa.array(digests, pa.binary()), pa.array(firsts, pa.binary()), pa.array(counts, pa.binary())],
                schema=_SIGNED,
            )

    return run


def _digest(found: np.ndarray) -> bytes:
    return hashlib.blake2b(found.tobytes(), digest_size=16).digest()


_NAMED = pa.schema([("doc_id", pa.int64()), ("n", pa.int64()), ("digest", pa.binary())])
_KEYED = _NAMED.append(pa.field("text_key", pa.binary()))


def text_key(text: Column) -> Column:
    """Digest of the whole text, null as empty."""
    return F.unhex(F.sha2(F.coalesce(text.cast("string"), F.lit("")).cast("binary"), 256))


def _names(width: int, keyed: bool = False):
    """Size and digest of each row's set."""

    def run(batches):
        for batch in slices(batches, limit=STEP_BYTES):
            sets = list(shingle_sets(utf8(batch), width))
            columns = [batch.column("doc_id").cast(pa.int64()), pa.array([len(s) for s in sets], pa.int64()), pa.array([_digest(s) for s in sets], pa.binary())]
            yield pa.record_batch([*columns, batch.column("text_key").cast(pa.binary())], schema=_KEYED) if keyed else pa.record_batch(columns, schema=_NAMED)

    return run


def _counts(found: np.ndarray) -> bytes:
    size = BUCKETS * (64 if len(found) > 64 * BUCKETS else 8 if len(found) > 8 * BUCKETS else 1)
    return np.minimum(np.bincount((found & np.uint64(size - 1)).astype(np.int64), minlength=size), 255).astype(np.uint8).tobytes()


_CELL_ROWS = pa.schema([("token", pa.int64()), ("v", pa.int64()), ("n", pa.int64())])


def _cell_rows(percent: int, hot_only: bool):
    """One row per vertex and cell; cells of frequent shingles apart from the others."""

    def run(batches):
        for batch in batches:
            tokens, vs, ns = [], [], []
            for v, n, first in zip(batch.column("v").to_pylist(), batch.column("n").to_pylist(), batch.column("first"), strict=True):
                found = np.frombuffer(first.as_buffer(), dtype=np.uint64)
                k = window(n, percent)
                if len(found) > k:
                    hot = np.unpackbits(found[k:].astype(np.uint8))[:k].astype(bool)
                    found = found[:k][hot if hot_only else ~hot]
                elif hot_only:
                    continue
                tokens.append(found)
                vs.append(np.full(len(found), v, dtype=np.int64))
                ns.append(np.full(len(found), n, dtype=np.int64))
            if tokens:
                token = np.concatenate(tokens).view(np.int64)
                yield pa.record_batch([pa.array(token), pa.array(np.concatenate(vs)), pa.array(np.concatenate(ns))], schema=_CELL_ROWS)

    return run


_FOUND = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("star", pa.bool_())])


def _priority(v: np.ndarray) -> np.ndarray:
    return (v.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(1)


def _cell_pairs(percent: int, small: int):
    """Streams rows sorted by cell: pairs of small cells, pivot pairs (``star``) of large ones."""

    def emit(token, v, n):
        starts = np.flatnonzero(np.concatenate(([True], token[1:] != token[:-1])))
        sizes = np.diff(np.append(starts, len(token)))
        a, b = [], []
        for m in range(2, small + 1):
            of = starts[sizes == m]
            if len(of):
                i, j = np.triu_indices(m, 1)
                left, right = (of[:, None] + i).ravel(), (of[:, None] + j).ravel()
                low, high = np.minimum(n[left], n[right]), np.maximum(n[left], n[right])
                ok = (100 * low >= percent * high) & (v[left] != v[right])
                a.append(v[left[ok]])
                b.append(v[right[ok]])
        if a:
            x, y = np.concatenate(a), np.concatenate(b)
            pair = np.unique(np.stack((np.minimum(x, y), np.maximum(x, y))), axis=1)
            yield pa.record_batch([pa.array(pair[0]), pa.array(pair[1]), pa.array(np.zeros(pair.shape[1], dtype=bool))], schema=_FOUND)
        for s, m in zip(starts[sizes > small].tolist(), sizes[sizes > small].tolist(), strict=True):
            own = v[s : s + m]
            pivot = int(own[np.argmin(_priority(own))])
            yield pa.record_batch([pa.array(np.full(m, pivot)), pa.array(own), pa.array(np.ones(m, dtype=bool))], schema=_FOUND)

    def run(batches):
        rest = [np.zeros(0, dtype=np.int64)] * 3
        for batch in batches:
            token, v, n = (np.concatenate((old, batch.column(c).to_numpy(zero_copy_only=False))) for old, c in zip(rest, ("token", "v", "n"), strict=True))
            if not len(token):
                continue
            cut = int(np.searchsorted(token, token[-1], side="left"))  # the last cell may go on
            if cut:
                yield from emit(token[:cut], v[:cut], n[:cut])
            rest = [token[cut:], v[cut:], n[cut:]]
        if len(rest[0]):
            yield from emit(*rest)

    return run


# --- 3. bounds and exact distances -----------------------------------------------------


def _fold(data: bytes, size: int) -> np.ndarray:
    """Counts of a set in ``size`` buckets, from as many or more."""
    return np.frombuffer(data, dtype=np.uint8).reshape(-1, size).sum(axis=0, dtype=np.int32)


def _apart(xs: list[bytes], ys: list[bytes], most: int | None = None) -> np.ndarray:
    """L1 distances of bucket counts, lower bounds of the sizes of the symmetric differences.

    Each pair is measured in as many buckets as both its sets have, up to ``most``.
    """
    sizes = np.minimum(np.fromiter(map(len, xs), np.int64, len(xs)), np.fromiter(map(len, ys), np.int64, len(ys)))
    sizes = np.minimum(sizes, most or sizes)
    out = np.zeros(len(xs), dtype=np.int64)
    for size in np.unique(sizes).tolist():
        of = np.flatnonzero(sizes == size)
        for at in range(0, len(of), 1 << 14):
            own = of[at : at + (1 << 14)]
            for part in np.array_split(own, -(-len(own) * size // (1 << 21))):
                x = np.stack([_fold(xs[k], size) for k in part])
                y = np.stack([_fold(ys[k], size) for k in part])
                out[part] = np.abs(x - y).sum(axis=1)
    return out


def may_link(apart, n, m, percent: int = PERCENT):
    """Whether sets of sizes n and m with at least ``apart`` elements not in common can link."""
    return (100 * (n + m - apart) >= percent * (n + m + apart)) & (100 * np.minimum(n, m) >= percent * np.maximum(n, m))


_BOUNDS = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("apart", pa.int64())])


def _bounds(percent: int):
    """Pairs of a vertex ``a`` and the rows ``v`` after its own row that their finest counts let link, and their distance in ``BUCKETS`` counts."""

    def run(batches):
        last = None  # number, size and counts of the last row of its own
        for batch in batches:
            a, v, n = (batch.column(k).to_numpy(zero_copy_only=False) for k in ("a", "v", "n"))
            counts = batch.column("counts").to_pylist()
            if last is not None:
                a, v, n, counts = np.append(last[0], a), np.append(last[0], v), np.append(last[1], n), [last[2], *counts]
            if not len(a):
                continue
            own = np.maximum.accumulate(np.where(a == v, np.arange(len(a)), 0))
            last = a[own[-1]], n[own[-1]], counts[own[-1]]
            rest = np.flatnonzero(a != v)
            x, y = [counts[k] for k in own[rest]], [counts[k] for k in rest]
            ok = may_link(_apart(x, y), n[own[rest]], n[rest], percent)
            far = _apart(x, y, BUCKETS)
            yield pa.record_batch([pa.array(a[rest][ok]), pa.array(v[rest][ok]), pa.array(far[ok])], schema=_BOUNDS)

    return run


def bounds(rows: DataFrame, percent: int = PERCENT) -> DataFrame:
    """The pairs ``a, b`` of ``rows(a, v, n, counts)``, which hold each ``a`` also as a ``v`` of its own, that may link."""
    placed = rows.repartition("a").sortWithinPartitions("a", F.col("a") != F.col("v"))
    return placed.select("a", "v", "n", "counts").mapInArrow(_bounds(percent), "a long, b long, apart long")


def _common(x: np.ndarray, y: np.ndarray) -> int:
    if len(x) > len(y):
        x, y = y, x
    at = np.searchsorted(y, x)
    at[at == len(y)] = 0
    return int((y[at] == x).sum()) if len(y) else 0


_LINKS = pa.schema([("a", pa.int64()), ("b", pa.int64())])


def _verify(percent: int):
    def run(batches):
        for batch in batches:
            keep = []
            for x, y in zip(batch.column("x"), batch.column("y"), strict=True):
                s, t = (np.frombuffer(c.as_buffer(), dtype=np.uint64) for c in (x, y))
                common = _common(s, t)
                keep.append(100 * common >= percent * (len(s) + len(t) - common))
            yield pa.record_batch([batch.column("a"), batch.column("b")], schema=_LINKS).filter(pa.array(keep, pa.bool_()))

    return run


def verify(pairs: DataFrame, named: DataFrame, sets: DataFrame, percent: int = PERCENT) -> DataFrame:
    """The pairs ``a, b`` whose whole sets link; ``named(v, doc_id, digest)`` finds the sets of vertices in ``sets(id, digest, elements)``."""

    def of(end: str, elements: str) -> tuple[DataFrame, DataFrame]:
        name = named.select(F.col("v").alias(end), F.coalesce("doc_id", F.lit(0)).alias(f"id_{end}"), F.col("doc_id").isNull().alias(f"no_{end}"), F.col("digest").alias(f"digest_{end}"))
        found = sets.select(F.coalesce("id", F.lit(0)).alias(f"id_{end}"), F.col("id").isNull().alias(f"no_{end}"), F.col("digest").alias(f"digest_{end}"), F.col("elements").alias(elements))
        return name, found

    joined = pairs.select("a", "b")
    for name, _ in (of("b", "y"), of("a", "x")):
        joined = joined.join(name, name.columns[0])
    for _, found in (of("b", "y"), of("a", "x")):
        joined = joined.join(found, found.columns[:3])
    return joined.select("a", "b", "x", "y").mapInArrow(_verify(percent), "a long, b long")


# --- 4. regions ------------------------------------------------------------------------


def reach(n, percent: int = PERCENT):
    """The largest size of the symmetric difference of a set of size n and a set that it links with."""
    return (100 - percent) * n // percent


_DEALT = pa.schema([("a", pa.int64()), ("v", pa.int64()), ("n", pa.int64()), ("counts", pa.binary()), ("m", pa.int64()), ("p", pa.int64()), ("apart", pa.int64()), ("may", pa.bool_()), ("to", pa.list_(pa.int32()))])


def _deal(percent: int):
    """Nearest pivot of each member, and the pivots whose regions its triangle window reaches (``to``, the nearest first)."""

    def run(members: pa.Table, pivots: pa.Table) -> pa.Table:
        if not members.num_rows:
            return pa.table({f.name: pa.array([], f.type) for f in _DEALT})
        v, n = (members.column(k).to_numpy() for k in ("v", "n"))
        counts = members.column("counts").to_pylist()
        order = np.argsort(pivots.column("v").to_numpy(), kind="stable") if pivots.num_rows else np.zeros(0, dtype=np.int64)
        centres, centre_n = pivots.column("v").to_numpy()[order], pivots.column("n").to_numpy()[order]
        centre_counts = pivots.column("counts").to_pylist()
        far = np.zeros((len(v), max(1, len(order))), dtype=np.int64)
        for at in range(0, len(v), 1 << 12):
            own = np.stack([_fold(x, BUCKETS) for x in counts[at : at + (1 << 12)]])
            for k, j in enumerate(order):
                far[at : at + (1 << 12), k] = np.abs(own - _fold(centre_counts[j], BUCKETS)).sum(axis=1)
        home = far.argmin(axis=1)
        near = far[np.arange(len(v)), home]
        guest = (far <= (near + 2 * reach(n, percent))[:, None]) & (np.arange(far.shape[1]) > home[:, None])
        to = [[h, *np.flatnonzero(g).tolist()] for h, g in zip(home.tolist(), guest, strict=True)]
        has = len(order) > 0
        p = centres[home] if has else v
        may = may_link(near, n, centre_n[home], percent) & (p != v) if has else np.zeros(len(v), dtype=bool)
        return pa.table([members.column("a"), pa.array(v), pa.array(n), members.column("counts"), members.column("m"), pa.array(p), pa.array(near), pa.array(may), pa.array(to, pa.list_(pa.int32()))], schema=_DEALT)

    return run


def split_regions(members: DataFrame, percent: int = PERCENT, block: int = BLOCK) -> tuple[DataFrame, DataFrame | None]:
    """``(leaves, dense)`` of the regions in ``members(a, v, n, counts, m)``, ``m`` the size of region ``a``.

    ``leaves`` (the same columns) are regions of at most ``block`` vertices.  Regions that pivots
    cannot split further are ``dense``, with the nearest pivot ``p`` of each member, the distance
    ``apart`` to it and whether it lets both link (``may``).  Vertices that link share a region of either table.
    """
    leaves, dense, level = [members.filter(F.col("m") <= block).select("a", "v", "n", "counts", "m")], [], 0
    while True:
        large = members.filter(F.col("m") > block)
        if large.isEmpty():
            break
        large = large.withColumn("salt", F.pmod(F.xxhash64("v", F.lit(level)), F.ceil(F.col("m") / DEAL)).cast("int"))
        # a draw by hash: PIVOTS or four a block are expected; a region without any is dealt as it is
        share = F.least(F.lit(float(PIVOTS)), 4 * F.ceil(F.col("m") / block)) / F.col("m")
        drawn = F.pmod(F.xxhash64("v", F.lit(level), F.lit("pivot")), F.lit(1 << 30)) < share * float(1 << 30)
        pivots = large.filter(drawn).select("a", F.explode(F.sequence(F.lit(0), (F.ceil(F.col("m") / DEAL) - 1).cast("int"))).alias("salt"), "v", "n", "counts")
        pivots = pivots.toDF("region", "part", "v", "n", "counts")
        dealt = large.groupBy("a", "salt").cogroup(pivots.groupBy("region", "part")).applyInArrow(_deal(percent), "a long, v long, n long, counts binary, m long, p long, apart long, may boolean, to array<int>")
        dealt = materialise(dealt)
        parts = materialise(dealt.select("a", "m", F.explode("to").alias("k")).groupBy("a", "m", "k").agg(F.count("*").alias("size")))
        # rows to compare, in blocks; a split must lower them by a tenth, so levels end
        cost = lambda m: F.col(m) * F.greatest(F.lit(1.0), F.col(m) / block)
        split = parts.groupBy("a", "m").agg(F.sum(cost("size")).alias("after")).filter(F.col("after") < 0.9 * cost("m")).select("a", "m")
        split = materialise(split)
        stuck = materialise(dealt.select("a", "m").distinct().join(split.select("a"), "a", "left_anti"))
        region = lambda a, k: F.xxhash64(a, k, F.lit(level))
        parts = parts.join(split.select("a"), "a", "left_semi").select(region("a", "k").alias("to"), "size")
        children = join_counted(dealt, split, "a", "m").select(region("a", F.explode("to")).alias("to"), "v", "n", "counts") if not split.isEmpty() else None
        if not stuck.isEmpty():
            dense.append(materialise(join_counted(dealt.drop("m"), stuck, "a", "m").select("a", "v", "n", "counts", "p", "apart", "may")))
        if children is None:
            break
        members = materialise(join_counted(children, parts, "to", "size").join(parts, "to").select(F.col("to").alias("a"), "v", "n", "counts", F.col("size").alias("m")))
        discard(dealt, split, stuck)
        leaves.append(members.filter(F.col("m") <= block))
        level += 1
    union = lambda tables: tables[0] if len(tables) == 1 else union([tables[0].unionByName(tables[1]), *tables[2:]])
    return union(leaves), union(dense) if dense else None


_STARS = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("apart", pa.int64())])


def _stars(percent: int):
    """Pairs of the pivot of a region (the vertex of the smallest hash) with the members that it may link with."""

    def run(table: pa.Table) -> pa.Table:
        v, n = (table.column(k).to_numpy() for k in ("v", "n"))
        counts = table.column("counts").to_pylist()
        p = int(np.argmin(_priority(v)))
        fine = _apart(counts, [counts[p]] * len(v))
        coarse = _apart(counts, [counts[p]] * len(v), BUCKETS)
        ok = may_link(fine, n, n[p], percent) & (v != v[p])
        return pa.table([pa.array(np.full(int(ok.sum()), v[p])), pa.array(v[ok]), pa.array(coarse[ok])], schema=_STARS)

    return run


def _block_pairs(v, c, n, side, counts, percent: int, best: bool) -> pa.Table:
    """Pairs between components inside one block that no bound excludes.

    ``side`` 1 rows are compared with all rows of the block, ``side`` 0 rows only with those.
    With ``best``, each row of side 1 yields only its partner of the smallest bound.
    """
    coarse = np.stack([_fold(x, BUCKETS) for x in counts])
    far = np.abs(coarse - coarse[np.argmin(_priority(v))]).sum(axis=1)
    a, b = [], []
    for i in np.flatnonzero(side == 1):
        # (with best, a row looks both ways) the triangle inequality: |l(x, p) - l(y, p)| never exceeds l(x, y)
        near = np.flatnonzero((c != c[i]) & (best | (side == 0) | (v > v[i])) & may_link(np.abs(far - far[i]), n, n[i], percent))
        near = near[may_link(np.abs(coarse[near] - coarse[i]).sum(axis=1), n[near], n[i], percent)]
        fine = _apart([counts[k] for k in near], [counts[i]] * len(near))
        ok = may_link(fine, n[near], n[i], percent)
        near, fine = near[ok], fine[ok]
        if best and len(near):
            near = near[[np.argmin(fine / (n[near] + n[i]))]]
        a.append(np.minimum(v[near], v[i]))
        b.append(np.maximum(v[near], v[i]))
    a, b = (np.concatenate(x) if x else np.zeros(0, dtype=np.int64) for x in (a, b))
    return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})


def _leaf_pairs(percent: int, best: bool):
    def run(table: pa.Table, labels: pa.Table) -> pa.Table:
        v, n = (table.column(k).to_numpy() for k in ("v", "n"))
        own, label = (labels.column(k).to_numpy() for k in ("member", "c"))
        order = np.argsort(own, kind="stable")
        c = label[order][np.searchsorted(own[order], v)] if len(own) else v
        kinds, code, sizes = np.unique(c, return_inverse=True, return_counts=True)
        if len(kinds) < 2:
            return pa.table({"a": pa.array([], pa.int64()), "b": pa.array([], pa.int64())})
        # the largest component is settled: its members are not compared with each other
        side = (code != sizes.argmax()).astype(np.int8)
        return _block_pairs(v, c, n, side, table.column("counts").to_pylist(), percent, best)

    return run


def _dense_pairs(percent: int, best: bool):
    def run(table: pa.Table) -> pa.Table:
        v, c, n, side = (table.column(k).to_numpy() for k in ("v", "c", "n", "side"))
        return _block_pairs(v, c, n, side, table.column("counts").to_pylist(), percent, best)

    return run


def dense_blocks(dense: DataFrame, labels: DataFrame, block: int = BLOCK) -> DataFrame:
    """Members of dense regions dealt into blocks (``a, i, j``), all pairs of components that are apart meeting in one.

    The largest component of a region is settled: its members are dealt once, all others meet every block.
    """
    member = dense.select("a", "v").join(labels, "v", "left").withColumn("c", F.coalesce("c", "v"))
    sizes = member.groupBy("a", "c").agg(F.count("*").alias("k"))
    top = sizes.groupBy("a").agg(F.max(F.struct("k", "c")).alias("top"), F.sum("k").alias("m"), F.count("*").alias("parts")).filter("parts > 1")
    top = materialise(top.select("a", "m", F.col("top.c").alias("main"), F.ceil((F.col("m") - F.col("top.k")) / block).cast("int").alias("open_blocks"), F.ceil(F.col("top.k") / block).cast("int").alias("main_blocks")))
    member = join_counted(member, top, "a", "m")
    spread = F.xxhash64("v")
    settled = F.col("c") == F.col("main")
    own = F.when(settled, F.pmod(spread, F.col("main_blocks"))).otherwise(F.pmod(spread, F.col("open_blocks"))).cast("int")
    last = F.col("open_blocks") - 1
    # block (i, j): open block i against main block j (j >= 0) or against open block -1 - j
    cells = F.when(settled, F.transform(F.sequence(F.lit(0), last), lambda i: F.struct(i.alias("i"), own.alias("j"), F.lit(0).alias("side")))).otherwise(
        F.concat(
            F.transform(F.sequence(F.lit(0), F.col("main_blocks") - 1), lambda j: F.struct(own.alias("i"), j.alias("j"), F.lit(1).alias("side"))),
            F.transform(F.sequence(F.lit(0), last), lambda i: F.struct(F.least(i, own).alias("i"), (F.lit(-1) - F.greatest(i, own)).alias("j"), F.lit(1).alias("side"))),
        )
    )
    member = member.join(dense.select("a", "v", "n", "counts"), ["a", "v"])
    return member.withColumn("cell", F.explode(cells)).select("a", "cell.i", "cell.j", "cell.side", "v", "c", "n", "counts")


def region_pairs(leaves: DataFrame, dense: DataFrame | None, labels: DataFrame, percent: int = PERCENT, block: int = BLOCK, best: bool = False) -> DataFrame:
    """Pairs of vertices that share a region, are in different components and may link (``a, b``)."""
    known = leaves.select("a", "v").join(labels, "v", "left").select(F.col("a").alias("region"), F.col("v").alias("member"), F.coalesce("c", "v").alias("c"))
    found = leaves.select("a", "v", "n", "counts").groupBy("a").cogroup(known.groupBy("region")).applyInArrow(_leaf_pairs(percent, best), "a long, b long")
    if dense is not None:
        found = found.union(dense_blocks(dense, labels, block).groupBy("a", "i", "j").applyInArrow(_dense_pairs(percent, best), "a long, b long"))
    return found.distinct()


# --- the join --------------------------------------------------------------------------


def _bitmap_cells(bits: int):
    def run(batches):
        total = np.zeros(1 << bits, dtype=np.uint32)
        for batch in batches:
            for place in _bitmap_places(batch.column("doc_id").to_numpy(zero_copy_only=False), bits):
                total[place] = 1
        if total.any():
            yield from _strips(total)

    return run


def _bitmap_places(ids, bits: int) -> list[np.ndarray]:
    """Two cells per id; an id is in the bitmap if both are set."""
    ids = np.nan_to_num(np.asarray(ids, dtype=np.float64), nan=-1).astype(np.int64).astype(np.uint64)
    return [(mix(ids + np.uint64(k)) >> np.uint64(64 - bits)).astype(np.int64) for k in (1, 1 << 40)]


def _wanted_sets(width: int, bits: int, shared):
    def run(batches):
        bitmap = shared.value
        for batch in batches:
            one, two = _bitmap_places(batch.column("doc_id").to_numpy(zero_copy_only=False), bits)
            for part in slices([batch.filter(pa.array(bitmap[one] & bitmap[two]))], limit=STEP_BYTES):
                sets = list(shingle_sets(utf8(part), width))
                yield pa.record_batch([part.column("doc_id").cast(pa.int64()), pa.array(map(_digest, sets), pa.binary()), pa.array([s.tobytes() for s in sets], pa.binary())], names=["id", "digest", "elements"])

    return run


def table_bits(rows: int, least: int, most: int = MOST_BITS) -> int:
    """Bits of a table with at least four cells a row, between two bounds."""
    return max(least, min(most, (4 * max(rows, 1) - 1).bit_length()))


def jaccard_links(docs: DataFrame, percent: int = PERCENT, width: int = WIDTH, id_col: str = "doc_id", text_col: str = "text", small: int = SMALL, block: int = BLOCK, sketch_bits: int = SKETCH_BITS, keyed: bool = False) -> tuple[DataFrame, DataFrame, DataFrame]:
    """``(rows, links, labels)``.

    ``rows``: ``doc_id, n, v`` of every row (``v`` null for an empty set); ``links``: verified pairs
    of vertices ``a, b`` that connect all that is connected; ``labels``: ``v, c``, the components.
    """
    spark = docs.sparkSession
    own = documents(docs, id_col, text_col)
    bits = table_bits(own.count(), sketch_bits)
    classes = spark.sparkContext.broadcast(rank_classes(cell_totals(own.select("text"), _count_cells(width, bits), bits)))
    signed = own.withColumn("pos", F.monotonically_increasing_id()).select("doc_id", "pos", "text")
    signed = signed.mapInArrow(_signatures(width, percent, bits, classes), "doc_id long, pos long, n long, digest binary, first binary, counts binary")

    vertices = signed.filter("n > 0").groupBy("digest", "n").agg(F.min_by(F.struct("pos", "doc_id", "first", "counts"), "pos").alias("s"), F.count("*").alias("copies"))
    vertices = materialise(vertices.select(F.col("s.pos").alias("v"), F.col("s.doc_id").alias("doc_id"), "digest", "copies", "n", F.col("s.first").alias("first"), F.col("s.counts").alias("counts")))
    # what every row needs later is small; computing it again from the texts costs less than keeping the signatures of all rows
    key = [text_key(F.col("text")).alias("text_key")] if keyed else []
    named = materialise(own.select("doc_id", "text", *key).mapInArrow(_names(width, keyed), "doc_id long, n long, digest binary" + ", text_key binary" * keyed))

    source = vertices.select("v", "n", "first")
    light = source.mapInArrow(_cell_rows(percent, False), "token long, v long, n long")
    light = light.repartition("token").sortWithinPartitions("token").select("token", "v", "n").mapInArrow(_cell_pairs(percent, small), "a long, b long, star boolean")
    # frequent shingles: the pivot is a minimum with a partial combine, and the join may be split
    hot = materialise(source.mapInArrow(_cell_rows(percent, True), "token long, v long, n long").select("token", "v"))
    pivot = materialise(hot.groupBy("token").agg(F.min(F.struct(F.xxhash64("v").alias("h"), F.col("v").alias("v"))).alias("p"), F.count("*").alias("m")).filter("m > 1").select("token", F.col("p.v").alias("a"), "m"))
    stars = join_counted(hot, pivot, "token", "m").select("a", F.col("v").alias("b"), F.lit(True).alias("star"))
    found = materialise(light.union(stars).groupBy("a", "b").agg(F.max("star").alias("star")))
    discard(hot, pivot)
    # each large column is kept only as long as a later step reads it
    vertices = replace_table(vertices, vertices.drop("first"))
    # sizes and counts of all vertices are joined once: to the members of regions, and to pairs with a row of its own for each first vertex
    sizes = materialise(found.filter("star").groupBy("a").agg(F.count("*").alias("m")).filter("m > 1"))
    members = join_counted(found.filter("star").select("a", F.col("b").alias("v")), sizes.withColumn("size", F.col("m")), "a", "size").select("a", "v", "m")
    pairs = found.filter("not star").select("a", F.col("b").alias("v"))
    pairs = pairs.union(pairs.select("a").distinct().select("a", F.col("a").alias("v"))).withColumn("m", F.lit(None).cast("long"))
    shaped = materialise(members.union(pairs).join(vertices.select("v", "n", "counts"), "v").select("a", "v", "n", "counts", "m"))
    discard(found, sizes)
    vertices = replace_table(vertices, vertices.select("v", "doc_id", "digest", "copies"))
    bounded = materialise(bounds(shaped.filter("m is null"), percent))
    shaped = replace_table(shaped, shaped.filter("m is not null"))
    leaves, dense = split_regions(shaped, percent, block)
    stars = leaves.select("a", "v", "n", "counts").groupBy("a").applyInArrow(_stars(percent), "a long, b long, apart long")
    if dense is not None:
        stars = stars.union(dense.filter("may").select(F.col("p").alias("a"), F.col("v").alias("b"), "apart"))

    def linked(pairs: DataFrame) -> DataFrame:
        """Those of the pairs whose whole sets link.

        The sets are computed again from the texts; all but a few other texts are left out by a bitmap sized by their number.
        """
        wanted = materialise(vertices.select("v", "doc_id", "digest").join(pairs.select(F.explode(F.array("a", "b")).alias("v")).distinct(), "v", "left_semi"))
        wide = table_bits(4 * wanted.count(), 16)
        bitmap = spark.sparkContext.broadcast(cell_totals(wanted.select("doc_id"), _bitmap_cells(wide), wide) > 0)
        # rows that repeat both id and text repeat a set, which only repeats verified pairs
        sets = materialise(own.mapInArrow(_wanted_sets(width, wide, bitmap), "id long, digest binary, elements binary"))
        out = materialise(verify(pairs, wanted, sets, percent))
        discard(wanted, sets)
        return out

    # first round: the partner with the smallest bound, of each vertex
    both = bounded.union(stars)
    both = both.union(both.select("b", "a", "apart"))
    chosen = materialise(both.groupBy("a").agg(F.min(F.struct("apart", "b")).alias("m")).select(F.least("a", "m.b").alias("a"), F.greatest("a", "m.b").alias("b")).distinct())
    links = linked(chosen)
    labels = connected_components(links)
    # next rounds: of what is still apart, the nearest partner in each region; the last round: all
    for best in (True, True, False):
        apart = region_pairs(leaves, dense, labels, percent, block, best)
        if not best:
            apart = apart.union(bounded.select(F.least("a", "b"), F.greatest("a", "b"))).distinct()
        apart = apart.join(labels.toDF("a", "ca"), "a", "left").join(labels.toDF("b", "cb"), "b", "left").filter("coalesce(ca, a) <> coalesce(cb, b)")
        apart = materialise(apart.select("a", "b").join(chosen, ["a", "b"], "left_anti"))
        if apart.isEmpty():
            continue
        fresh = linked(apart)
        chosen = chosen.union(apart)
        if not fresh.isEmpty():
            links = links.union(fresh)
            before, labels = labels, join_components(labels, fresh)
            discard(before)
    # rows of empty sets have no vertex; a digest may be that of a third of all rows
    vertex = vertices.select("digest", "v", "copies")
    text_keys = ["text_key"] * keyed
    rows = join_counted(named.filter("n > 0"), vertex, "digest", "copies").select("doc_id", "n", "v", *text_keys)
    empty = named.filter("n = 0").select("doc_id", "n", F.lit(None).cast("long").alias("v"), *text_keys)
    return rows.union(empty), links, labels


def _with_component(rows: DataFrame, labels: DataFrame) -> DataFrame:
    """``rows`` with the component ``c`` of their vertex; a vertex may be that of a third of all rows."""
    sizes = rows.filter("v is not null").groupBy("v").agg(F.count("*").alias("copies"))
    known = materialise(sizes.join(labels, "v", "left").select("v", F.coalesce("c", "v").alias("c"), "copies"))
    return join_counted(rows.filter("v is not null"), known, "v", "copies").unionByName(rows.filter("v is null").withColumn("c", F.lit(None).cast("long")))


def jaccard_rows(docs: DataFrame, percent: int = PERCENT, id_col: str = "doc_id", text_col: str = "text", **bounds) -> DataFrame:
    """``doc_id, text_key, c`` of every row: its text's digest and its component (null for an empty set)."""
    with small_batches(docs.sparkSession):
        rows, _, labels = jaccard_links(docs, percent, id_col=id_col, text_col=text_col, keyed=True, **bounds)
    return _with_component(materialise(rows), labels).select("doc_id", "text_key", "c")


def jaccard_components(docs: DataFrame, percent: int = PERCENT, id_col: str = "doc_id", text_col: str = "text", **bounds) -> DataFrame:
    """``doc_id, n_shingles, component_id`` of every row; the component's id is its smallest doc_id."""
    with small_batches(docs.sparkSession):
        rows, _, labels = jaccard_links(docs, percent, id_col=id_col, text_col=text_col, **bounds)
    rows = materialise(_with_component(materialise(rows), labels).select("doc_id", F.col("n").alias("n_shingles"), "c"))
    smallest = materialise(rows.filter("c is not null").groupBy("c").agg(F.min("doc_id").alias("component_id"), F.count("*").alias("m")))
    linked = join_counted(rows.filter("c is not null"), smallest, "c", "m").select("doc_id", "n_shingles", "component_id")
    return linked.union(rows.filter("c is null").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id")))
