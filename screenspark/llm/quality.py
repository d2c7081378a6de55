"""Quality classifier: supervised subword embeddings.

A document is the average of learned vectors of its hashed words, word pairs and character
n-grams of 3 to 5 code points; a linear layer and a softmax give the class shares (its bias
is the log of the classes' shares in the sample).  Vectors and layer are learned by stochastic gradient descent in numpy, one document a step, on at
most ``TRAIN_ROWS`` labelled rows drawn by a hash of their id (the documented bound of the
fit).  For scoring, a class difference is folded into one number per bucket, so a document
costs one table look-up per feature and the model is 4 * 2**BITS bytes whatever the corpus.

Defined results: null text is empty; a text without features scores as the layer's bias
alone; labels other than 0 and 1, null labels and null ids do not train; without labelled
rows every score is 0.5; rows with a null id are scored and count as not held out; rows that repeat an id are scored
each, and train with the smallest of their texts; ids with two labels do not train; a long text is
cut into steps of code points, no feature lost; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import documents, slices
from .shingles import mix

BITS = 17
DIMENSIONS = 16
GRAMS = (3, 4, 5)
TRAIN_ROWS = 3000
EPOCHS = 3
RATE = 0.5
ACCEPT = 0.7
HELD_OUT = (4, 2)
#: Code points hashed together; a longer text is read in such steps.
STEP = 1 << 20
_MIX = np.uint64(0x9E3779B97F4A7C15)
_REPEAT = np.uint64(0x5851F42D4C957F2D)
_WHITE = np.zeros(0x110000, dtype=bool)
_WHITE[[0x20, *range(0x09, 0x0E), 0x85, 0xA0, 0x2028, 0x2029, 0x3000]] = True


def features(text: str, bits: int = BITS) -> Iterator[np.ndarray]:
    """Bucket numbers of all words, word pairs and n-grams of a whole text, step by step.

    A word that a step cuts is carried on as the sum of its code points' numbers, so steps change nothing.
    """
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    shift, longest = np.uint64(64 - bits), max(GRAMS)
    n = len(points)
    open_sum, open_size = np.zeros(1, dtype=np.uint64), 0
    before = np.zeros(0, dtype=np.uint64)  # the last word of the steps so far
    for a in range(0, n, STEP):
        b = min(n, a + STEP)
        codes = points[a : min(n, b + longest - 1)].astype(np.uint64) + np.uint64(1)
        own = b - a
        parts = []
        h = codes
        for k in range(2, longest + 1):
            if len(codes) < k:
                break
            h = h[: len(codes) - k + 1] * _MIX + codes[k - 1 :]
            if k in GRAMS:
                parts.append(mix(h[:own] + np.uint64(k)) >> shift)
        white = _WHITE[points[a:b]]
        edge = np.flatnonzero(white)
        starts, ends = np.concatenate(([0], edge + 1)), np.concatenate((edge, [own]))
        full = ends > starts
        starts, ends = starts[full], ends[full]
        place = np.arange(own)
        words = open_sum[:0]
        goes_on = open_size > 0 and not white[0]
        if len(starts):
            first = np.zeros(own, dtype=np.int64)
            first[starts] = starts
            place -= np.maximum.accumulate(first)
            if goes_on:
                place[: ends[0]] += open_size
            words = np.add.reduceat(mix(codes[:own] + (place.astype(np.uint64) << np.uint64(21))) * ~white, starts)
        if goes_on:
            words[:1] += open_sum
        elif open_size:
            words = np.concatenate((open_sum, words))
        if b < n and not white[-1]:
            open_size = int(place[-1]) + 1
            open_sum, words = words[-1:], words[:-1]
        else:
            open_size = 0
        if len(words):
            parts.append(mix(words) >> shift)
            chain = np.concatenate((before, words))
            if len(chain) > 1:  # word pairs; a word that follows itself is one shared feature
                pair = mix(chain[:-1] * _MIX + chain[1:])
                parts.append(np.where(chain[:-1] == chain[1:], _REPEAT, pair) >> shift)
            before = words[-1:]
        yield np.concatenate(parts).astype(np.int64) if parts else np.zeros(0, dtype=np.int64)


class SubwordModel:
    """Bucket vectors, class layer and bias of a two-class model."""

    def __init__(self, bits: int = BITS, dimensions: int = DIMENSIONS, seed: int = 7):
        rng = np.random.default_rng(seed)
        self.bits = bits
        self.vectors = rng.uniform(-1.0 / dimensions, 1.0 / dimensions, (1 << bits, dimensions)).astype(np.float32)
        self.layer = np.zeros((2, dimensions), dtype=np.float64)
        self.bias = np.zeros(2)

    def fit(self, texts: list[str], labels: list[int], epochs: int = EPOCHS, rate: float = RATE, seed: int = 7) -> SubwordModel:
        rng = np.random.default_rng(seed)
        if not texts:
            return self
        share = np.clip(np.bincount(labels, minlength=2) / len(labels), 1e-3, 1)
        self.bias = np.log(share)
        steps, done = epochs * len(texts), 0
        for _ in range(epochs):
            for i in rng.permutation(len(texts)):
                now, done = rate * (1 - done / steps), done + 1
                found = [np.unique(x, return_counts=True) for x in features(texts[i], self.bits)]
                if not found or not len(found[0][0]):
                    continue
                ids, counts = found[0] if len(found) == 1 else np.unique(np.concatenate([np.repeat(*x) for x in found]), return_counts=True)
                weight = (counts / counts.sum()).astype(np.float32)
                hidden = weight @ self.vectors[ids]
                logits = self.layer @ hidden + self.bias
                share = np.exp(logits - logits.max())
                share /= share.sum()
                wrong = share - np.eye(2)[labels[i]]
                back = wrong @ self.layer
                self.layer -= now * np.outer(wrong, hidden)
                # a row moves in proportion to its share of the document, scaled so that a document moves as a whole
                self.vectors[ids] -= np.outer(weight * (now * min(len(ids), 1000)), back).astype(np.float32)
        return self

    def folded(self) -> tuple[np.ndarray, float]:
        """Per bucket, and as a bias, the logit of class 1 minus that of class 0."""
        return (self.vectors @ (self.layer[1] - self.layer[0])).astype(np.float32), float(self.bias[1] - self.bias[0])


def score(text: str, weights: np.ndarray, bias: float) -> float:
    bits, total, n = int(len(weights)).bit_length() - 1, 0.0, 0
    for ids in features(text, bits):
        total += float(weights[ids].sum(dtype=np.float64))
        n += len(ids)
    logit = bias + (total / n if n else 0.0)
    return float(1 / (1 + np.exp(-np.clip(logit, -50, 50))))


def held_out(id_col, modulus: int = HELD_OUT[0], rest: int = HELD_OUT[1]):
    return F.coalesce(F.crc32(id_col.cast("string").cast("binary")) % modulus == rest, F.lit(False))


def fit_quality(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS, label_col: str = "quality", id_col: str = "doc_id", text_col: str = "text") -> tuple[np.ndarray, float]:
    """Learns from labelled rows that are not held out; ``rows`` bounds what reaches the driver."""
    labelled = labels.select(F.col(id_col).cast("long").alias("doc_id"), F.col(label_col).cast("int").alias("y")).filter("doc_id is not null and y in (0, 1)")
    labelled = labelled.filter(~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.min("y").alias("y"), F.max("y").alias("other")).filter("y = other")
    sample = labelled.orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows).select("doc_id", "y")
    found = documents(docs, id_col, text_col).join(F.broadcast(sample), "doc_id").groupBy("doc_id", "y").agg(F.min("text").alias("text")).collect()
    found.sort(key=lambda r: r.doc_id)
    model = SubwordModel().fit([r.text for r in found], [r.y for r in found])
    return model.folded()


_SCORES = pa.schema([("doc_id", pa.int64()), ("score", pa.float64())])


def score_quality(docs: DataFrame, weights: np.ndarray, bias: float, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, score``: the share of class 1, per row."""
    model = docs.sparkSession.sparkContext.broadcast((weights, bias))

    def run(batches):
        table, offset = model.value
        for batch in slices(batches):
            scores = [score(t or "", table, offset) for t in batch.column("text").to_pylist()]
            yield pa.record_batch([batch.column("doc_id").cast(pa.int64()), pa.array(scores, pa.float64())], schema=_SCORES)

    return documents(docs, id_col, text_col).mapInArrow(run, "doc_id long, score double")


def classify_quality(docs: DataFrame, labels: DataFrame, accept: float = ACCEPT, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, held_out, score, predicted`` of every document, by a model fitted to ``labels``."""
    weights, bias = fit_quality(docs, labels, id_col=id_col, text_col=text_col)
    return score_quality(docs, weights, bias, id_col, text_col).select(
        "doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= accept).cast("int").alias("predicted")
    )


def keep_accepted(docs: DataFrame, weights: np.ndarray, bias: float, accept: float = ACCEPT, text_col: str = "text") -> DataFrame:
    """The rows of ``docs``, with all their columns, whose score is at least ``accept``."""
    model = docs.sparkSession.sparkContext.broadcast((weights, bias))

    def run(batches):
        table, offset = model.value
        for batch in slices(batches, text_col):
            keep = [score(t or "", table, offset) >= accept for t in batch.column(text_col).to_pylist()]
            yield batch.filter(pa.array(keep, pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
