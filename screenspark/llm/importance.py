"""Importance resampling of documents towards a target distribution, with an exact draw count.

Features are runs of consecutive words, hashed into buckets.  A bucket's gain is the scaled log
ratio of its smoothed shares in the target and in the documents; a document's weight is the sum of
the gains in an array over its features, and its score adds Gumbel noise from a hash of its id, so
the highest scores are a draw without replacement in proportion to ``exp(weight / 1000)``.

The draw is a sorted merge:

1. *Runs.*  Each partition sorts its eligible rows by rank order.  Splitters from a small sample of keys cut
   the order into ranges of about ``RANGE_ROWS`` rows; a run is stored as blocks of at most
   ``BLOCK_ROWS`` rows, none across a splitter.
2. *Counts.*  Exact rows per range give each range its first rank; ranges behind the last rank are never read.
3. *Merge.*  A task reads the blocks of a range in the order of their first keys.  A tournament tree
   holds the heads of the open blocks; whatever is before the next block's first key is final and
   leaves the tree, so of each run one block at most is open.  The range in which the count
   is reached stops there.

Defined results: null and empty texts have no words and are never drawn; null ids are hashed as the word
``null`` and come last among ties; rows that repeat an id and its features are rows of their own with
ranks of their own (stored once per run, with their number); long texts are read in pieces; an empty
table or no target text give the formula's values (no rows, or gains of ``s`` alone); other columns are ignored.
"""

from __future__ import annotations

import hashlib
import math
import zlib
from bisect import bisect_right

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import documents, materialise, slices, utf8

BUCKETS = 10_000
PERCENT = 10
MIN_WORDS = 20
SEED = "2024"
#: Rows of one merge, about, and of one block of a run.
RANGE_ROWS = 131_072
BLOCK_ROWS = 1_024
#: Sampled keys per range.
OVERSAMPLE = 16
#: Features whose bucket one task remembers; longer ones than ``LONG`` bytes are not remembered.
REMEMBERED = 500_000
LONG = 64
#: Bytes of a text that are cut into words at a time.
PIECE = 1 << 20

#: Lower case for A-Z; everything but digits, a-z and bytes of non-ASCII characters parts words.
_WORD_BYTES = bytes(c + 32 if 0x41 <= c <= 0x5A else c if 0x30 <= c <= 0x39 or 0x61 <= c <= 0x7A or c >= 0x80 else 0x20 for c in range(256))


# --- 1. features and gains -------------------------------------------------------------


class Buckets(dict):
    """Bucket of a feature: its CRC-32 modulo the number of buckets."""

    def __init__(self, buckets: int):
        super().__init__()
        self.buckets = buckets

    def __missing__(self, feature: bytes) -> int:
        found = zlib.crc32(feature) % self.buckets
        if len(feature) <= LONG:
            if len(self) >= REMEMBERED:
                self.clear()
            self[feature] = found
        return found


def words_of(raw: bytes):
    """Lists of words of a text, piece by piece."""
    raw = raw.translate(_WORD_BYTES)
    at = 0
    while at < len(raw):
        end = raw.find(b" ", at + PIECE)
        end = len(raw) if end < 0 else end
        yield raw[at:end].split()
        at = end


def feature_buckets(raw: bytes, known: Buckets, most: int):
    """``(number of words, buckets)`` of a text, piece by piece: all runs of 1 to ``most`` words."""
    before: list[bytes] = []
    for words in words_of(raw):
        found = [known[w] for w in words]
        if most > 1:
            line = before + words
            for n in range(2, most + 1):
                first = max(0, len(before) - n + 1)  # runs that end in this piece
                found += [known[b" ".join(line[i : i + n])] for i in range(first, len(line) - n + 1)]
            before = line[-(most - 1) :]
        yield len(words), np.array(found, dtype=np.int64)


def _count(buckets: int, most: int):
    def run(batches):
        known, total = Buckets(buckets), np.zeros(buckets, dtype=np.int64)
        for batch in batches:
            for raw in utf8(batch):
                for _, found in feature_buckets(raw, known, most):
                    total += np.bincount(found, minlength=buckets)
        some = np.flatnonzero(total)
        yield pa.record_batch([pa.array(some, pa.int64()), pa.array(total[some], pa.int64())], names=["bucket", "n"])

    return run


def bucket_counts(rows: DataFrame, buckets: int = BUCKETS, most: int = 1, text_col: str = "text") -> DataFrame:
    """``bucket, n``: features of all texts per bucket, summed inside each task first."""
    text = rows.select(F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    return text.mapInArrow(_count(buckets, most), "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n"))


def _dense(counts: DataFrame, buckets: int) -> list[int]:
    out = [0] * buckets
    for row in counts.collect():  # one row per bucket at most
        out[row.bucket] = row.n
    return out


def bucket_gains(docs: DataFrame, target: DataFrame, buckets: int = BUCKETS, most: int = 1, text_col: str = "text") -> np.ndarray:
    """The gain of each bucket, an array of ``buckets`` numbers whatever the input."""
    s, t = (_dense(bucket_counts(rows, buckets, most, text_col), buckets) for rows in (docs, target))
    all_s, all_t = float(sum(s) + buckets), float(sum(t) + buckets)
    return np.array([math.floor(1000 * math.log((b + 1) * all_s / ((a + 1) * all_t))) for a, b in zip(map(float, s), map(float, t), strict=True)], dtype=np.int64)


def noise(doc_id, seed: str = SEED) -> int:
    """Gumbel noise in thousandths from a hash of the id."""
    h = int(hashlib.sha256(f"{seed}:{'null' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
    return math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))


_SCORED = pa.schema([("doc_id", pa.int64()), ("n_features", pa.int64()), ("weight", pa.int64()), ("score", pa.int64()), ("n_words", pa.int64())])


def _score(shared, buckets: int, most: int, seed: str):
    def run(batches):
        gains, known = shared.value, Buckets(buckets)
        for batch in slices(batches):
            ids = batch.column("doc_id").to_pylist()
            n_features, weights, n_words = [], [], []
            for raw in utf8(batch):
                n = w = own = 0
                for words, found in feature_buckets(raw, known, most):
                    own += words
                    n += len(found)
                    w += int(gains[found].sum())
                n_features.append(n)
                weights.append(w)
                n_words.append(own)
            scores = [w + noise(i, seed) for i, w in zip(ids, weights, strict=True)]
            yield pa.record_batch([pa.array(c, pa.int64()) for c in (ids, n_features, weights, scores, n_words)], schema=_SCORED)

    return run


def score_documents(docs: DataFrame, gains: np.ndarray, most: int = 1, seed: str = SEED, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, n_features, weight, score, n_words`` of every row."""
    shared = docs.sparkSession.sparkContext.broadcast(gains)
    return documents(docs, id_col, text_col).mapInArrow(_score(shared, len(gains), most, seed), "doc_id long, n_features long, weight long, score long, n_words long")


# --- 2. runs ---------------------------------------------------------------------------

_VALUES = ["score", "doc_id", "n_features", "weight"]


def rank_order(score: str = "score", doc_id: str = "doc_id", n_features: str = "n_features", weight: str = "weight") -> list:
    """The highest score first, then the smallest id (null last); rows that are equal so far differ in nothing but features."""
    return [F.col(score).desc(), F.col(doc_id).asc_nulls_last(), F.col(n_features), F.col(weight)]


def rank_key(score: int, doc_id: int | None, *rest: int) -> tuple:
    return (-score, doc_id is None, doc_id or 0, *rest)


def splitters(rows: DataFrame, n: int, range_rows: int) -> list[tuple]:
    """Keys that cut the rank order of ``n`` rows into ranges of about ``range_rows``; about ``OVERSAMPLE`` keys a range reach the driver."""
    ranges = -(-n // range_rows)
    if ranges < 2:
        return []
    share = min(1.0, OVERSAMPLE * ranges / n)
    drawn = F.pmod(F.xxhash64("doc_id", "score"), F.lit(1 << 30)) < int(share * (1 << 30))
    keys = sorted(rank_key(r.score, r.doc_id) for r in rows.select("score", "doc_id").filter(drawn).distinct().collect())
    return keys[OVERSAMPLE::OVERSAMPLE]


_BLOCKS = "range int, run long, first_score long, first_id long, first_features long, first_weight long, n long, score array<long>, doc_id array<long>, n_features array<long>, weight array<long>, times array<long>"
_BLOCK_TYPES = pa.schema([("range", pa.int32()), *((c, pa.int64()) for c in ("run", "first_score", "first_id", "first_features", "first_weight", "n")), *((c, pa.list_(pa.int64())) for c in (*_VALUES, "times"))])


def _blocks(shared, block_rows: int):
    """Sorted rows of a run as blocks; equal rows are one entry with their number."""

    def run(batches):
        cuts = shared.value
        entries: list[list] = []  # score, id, features, weight, times
        at, own = 0, 0

        def block():
            first = entries[0]
            columns = [[e[k] for e in entries] for k in range(5)]
            return pa.record_batch([pa.array([v], f.type) for v, f in zip([at, own, *first[:4], sum(columns[4]), *columns], _BLOCK_TYPES, strict=True)], schema=_BLOCK_TYPES)

        for batch in batches:
            for *row, own_run in zip(*(batch.column(c).to_pylist() for c in (*_VALUES, "run")), strict=True):
                if entries and entries[-1][:4] == row:
                    entries[-1][4] += 1
                    continue
                place = bisect_right(cuts, rank_key(row[0], row[1]), lo=at)
                if entries and (place != at or len(entries) == block_rows):
                    yield block()
                    entries = []
                at, own = place, own_run
                entries.append([*row, 1])
        if entries:
            yield block()

    return run


# --- 3. merge --------------------------------------------------------------------------


class Tournament:
    """Winner tree over the heads of sorted sequences; the slot of a finished sequence is used again."""

    def __init__(self):
        self.size, self.free = 1, [0]
        self.heads: list[tuple | None] = [None]
        self.rest: list = [None]
        self.tree = [-1, -1]  # slot of the winner below each node, -1 for none

    def _play(self, slot: int) -> None:
        heads, tree = self.heads, self.tree
        k = self.size + slot
        tree[k] = slot if heads[slot] is not None else -1
        while k > 1:
            k >>= 1
            a, b = tree[2 * k], tree[2 * k + 1]
            tree[k] = a if b < 0 or (a >= 0 and heads[a] <= heads[b]) else b

    def add(self, sequence) -> None:
        """Another sorted iterator of tuples."""
        if not self.free:
            self.free = list(range(2 * self.size - 1, self.size - 1, -1))
            self.heads += [None] * self.size
            self.rest += [None] * self.size
            self.size *= 2
            self.tree = [-1] * (2 * self.size)
            for slot in range(self.size // 2):
                self._play(slot)
        slot = self.free.pop()
        self.rest[slot] = iter(sequence)
        self._advance(slot)

    def _advance(self, slot: int) -> None:
        self.heads[slot] = next(self.rest[slot], None)
        if self.heads[slot] is None:
            self.rest[slot] = None
            self.free.append(slot)
        self._play(slot)

    def first(self) -> tuple | None:
        return self.heads[self.tree[1]] if self.tree[1] >= 0 else None

    def pop(self) -> tuple:
        slot = self.tree[1]
        out = self.heads[slot]
        self._advance(slot)
        return out


def merge_blocks(blocks):
    """Entries ``(key, times)`` of blocks ``(first key, entries)`` that come in the order of their first keys."""
    tree = Tournament()
    for first, entries in blocks:
        while (head := tree.first()) is not None and head[0] < first:
            yield tree.pop()
        tree.add(entries)
    while tree.first() is not None:
        yield tree.pop()


_RANKED = "score long, doc_id long, n_features long, weight long, first_rank long, times long, drawn long"
_RANKED_TYPES = pa.schema([(c, pa.int64()) for c in (*_VALUES, "first_rank", "times", "drawn")])


def ranked_rows(blocks, start: int, k: int):
    """Rows ``score, doc_id, n_features, weight, first_rank, times, drawn`` of a range up to rank ``k``, and entries equal to the last one."""
    rank, last = start + 1, None
    for key, times in merge_blocks(blocks):
        if rank > k and key != last:
            return
        drawn = max(0, min(times, k - rank + 1))
        yield (-key[0], None if key[1] else key[2], key[3], key[4], rank, times, drawn)
        rank, last = rank + drawn, key


def _merge(shared, k: int):
    def run(batches):
        starts = shared.value

        def blocks():
            for batch in batches:
                for i in range(batch.num_rows):
                    row = {c: batch.column(c)[i].as_py() for c in ("range", *_VALUES, "times")}
                    keys = [rank_key(*values) for values in zip(*(row[c] for c in _VALUES), strict=True)]
                    yield row["range"], keys[0], zip(keys, row["times"], strict=True)

        stream = blocks()
        block = next(stream, None)
        while block is not None:
            here, ahead = block[0], [block]

            def of_range():
                while ahead and ahead[0] is not None and ahead[0][0] == here:
                    _, first, entries = ahead.pop()
                    yield first, entries
                    ahead.append(next(stream, None))

            own = of_range()
            out = []
            for row in ranked_rows(own, starts[here], k):
                out.append(row)
                if len(out) == 8 * BLOCK_ROWS:
                    yield _ranked(out)
                    out = []
            if out:
                yield _ranked(out)
            for _ in own:  # blocks behind the last rank
                pass
            block = ahead[0] if ahead else next(stream, None)

    return run


def _ranked(rows: list[tuple]) -> pa.RecordBatch:
    return pa.record_batch([pa.array(c, pa.int64()) for c in zip(*rows, strict=True)], schema=_RANKED_TYPES)


def draw(scored: DataFrame, k: int, n: int, range_rows: int = RANGE_ROWS, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """``doc_id, n_features, weight, score, rank``: the ``k`` first of the ``n`` rows of ``scored`` that are ``eligible``, ranked; all others with a null rank.

    ``scored`` is read several times: a stored table.
    """
    out = ["doc_id", "n_features", "weight", "score"]
    unranked = F.lit(None).cast("long").alias("rank")
    if not k:
        return scored.select(*out, unranked)
    sc = scored.sparkSession.sparkContext
    rows = scored.filter("eligible").select(*_VALUES)
    cuts = sc.broadcast(splitters(rows, n, range_rows))
    runs = rows.withColumn("run", F.spark_partition_id().cast("long")).sortWithinPartitions(*rank_order())
    blocks = materialise(runs.mapInArrow(_blocks(cuts, block_rows), _BLOCKS))
    starts, before = {}, 0
    for row in sorted(blocks.groupBy("range").agg(F.sum("n").alias("n")).collect(), key=lambda r: r.range):  # a row per RANGE_ROWS rows
        if before < k:
            starts[row.range] = before
        before += row.n
    wanted = blocks.filter(F.col("range") <= max(starts)).drop("n", "run").repartition("range")
    wanted = wanted.sortWithinPartitions("range", *rank_order("first_score", "first_id", "first_features", "first_weight"))
    ranked = materialise(wanted.mapInArrow(_merge(sc.broadcast(starts), k), _RANKED))
    last = ranked.filter("drawn > 0").agg(F.max_by(F.struct(*_VALUES), "first_rank").alias("at")).first().at
    same = (F.col("score") == last.score) & F.col("doc_id").eqNullSafe(F.lit(last.doc_id).cast("long"))
    later_id = F.lit(False) if last.doc_id is None else F.col("doc_id").isNull() | (F.col("doc_id") > last.doc_id)
    behind = (F.col("score") < last.score) | ((F.col("score") == last.score) & F.coalesce(later_id, F.lit(False)))
    behind |= same & (F.struct("n_features", "weight") > F.struct(F.lit(last.n_features).cast("long").alias("n_features"), F.lit(last.weight).cast("long").alias("weight")))
    drawn = ranked.withColumn("i", F.explode(F.sequence(F.lit(0).cast("long"), F.col("times") - 1)))
    drawn = drawn.select(*out, F.when(F.col("i") < F.col("drawn"), F.col("first_rank") + F.col("i")).alias("rank"))
    return drawn.union(scored.filter(~F.col("eligible") | behind).select(*out, unranked))


def resample(docs: DataFrame, target: DataFrame, percent: int = PERCENT, min_words: int = MIN_WORDS, buckets: int = BUCKETS, most: int = 1, seed: str = SEED, id_col: str = "doc_id", text_col: str = "text", **sizes) -> DataFrame:
    """Every row of ``docs`` with its weight, score and rank in the draw of ``percent`` of those with ``min_words`` words."""
    gains = bucket_gains(docs, target, buckets, most, text_col)
    scored = score_documents(docs, gains, most, seed, id_col, text_col)
    scored = materialise(scored.withColumn("eligible", F.col("n_words") >= min_words).drop("n_words"))
    n = scored.filter("eligible").count()
    return draw(scored, percent * n // 100, n, **sizes)


#: The same draw in DuckDB SQL; CRC-32 byte by byte from its polynomial, for each distinct word.
ORACLE_SQL = r"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words
  FROM documents),
b AS (
  SELECT regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words
  FROM benchmark),
dw AS (SELECT doc_id, unnest(words) AS word FROM d),
bw AS (SELECT unnest(words) AS word FROM b),
k AS (
  SELECT list_transform(range(256), lambda n: list_reduce(list_prepend(n, range(8)), lambda c, i: CASE WHEN c % 2 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS t),
w AS (
  SELECT word, hex(encode(word)) AS h FROM (SELECT word FROM dw UNION SELECT word FROM bw)),
y AS (
  SELECT word, list_transform(range(CAST(len(h) // 2 AS BIGINT)), lambda i: CAST('0x' || substr(h, CAST(2 * i + 1 AS BIGINT), 2) AS BIGINT)) AS bytes FROM w),
c AS (
  SELECT word, xor(list_reduce(list_prepend(4294967295, bytes), lambda c, x: xor(c >> 8, t[CAST(xor(c & 255, x) + 1 AS BIGINT)])), 4294967295) % 10000 AS bucket
  FROM y, k),
s AS (SELECT bucket, count(*) AS s FROM dw JOIN c USING (word) GROUP BY bucket),
t AS (SELECT bucket, count(*) AS t FROM bw JOIN c USING (word) GROUP BY bucket),
g AS (
  SELECT bucket, CAST(floor(1000 * ln((coalesce(t, 0) + 1)::DOUBLE * ((SELECT count(*) FROM dw) + 10000) / ((coalesce(s, 0) + 1)::DOUBLE * ((SELECT count(*) FROM bw) + 10000)))) AS BIGINT) AS gain
  FROM s FULL JOIN t USING (bucket)),
x AS (SELECT doc_id, count(*) AS n_features, CAST(sum(gain) AS BIGINT) AS weight FROM dw JOIN c USING (word) JOIN g USING (bucket) GROUP BY doc_id),
z AS (
  SELECT d.doc_id, coalesce(n_features, 0) AS n_features, coalesce(weight, 0) AS weight,
         coalesce(weight, 0) + CAST(floor(-1000 * ln(-ln((CAST('0x' || substr(sha256('2024:' || d.doc_id), 1, 8) AS BIGINT) + 0.5::DOUBLE) / 4294967296.0::DOUBLE))) AS BIGINT) AS score
  FROM d LEFT JOIN x USING (doc_id)),
r AS (SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS place, count(*) OVER () AS n FROM z WHERE n_features >= 20)
SELECT z.doc_id, n_features, weight, score, CASE WHEN place <= 10 * n // 100 THEN place END AS rank
FROM z LEFT JOIN r USING (doc_id)
"""
