"""Language identification with spans: script ranges, per-word scores, Viterbi.

Words are maximal runs of letters.  The script of a word (of its first letter) narrows the
languages to those that use that script in training; each of them gets a naive Bayes score
from the word's letter n-grams of 1 to 4 (word edges included).  Viterbi over a document's
words, with a penalty for each switch, labels spans; the document's language is the one with
most letters, the score its share of the letters.

Counts are learned from whole texts of at most ``TRAIN_PER_LANG`` labelled documents of each
language, drawn by a hash of the id (the documented bound of the fit).

Defined results: null text, or text without a letter, is ``und`` with score 0 and no spans;
without training rows every document is ``und``; null languages and ids do not train; ties go
to the alphabetically first language; rows with a null id are labelled, not held out; rows that repeat an
id are rows of their own; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import sys

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import documents, slices
from .shingles import mix, span_hashes

UNKNOWN = "und"
GRAMS = (1, 2, 3, 4)
BITS = 16
TRAIN_PER_LANG = 400
SWITCH = 9.0
#: A language uses a script if at least this share of its training letters is in it.
SCRIPT_SHARE = 0.01
HELD_OUT = (3, 1)
#: Words scored together.
WORDS = 50_000

#: Start of each script range, in order of code points; fixed values (Unicode blocks).
SCRIPTS = [
    (0x0000, "latin"),
    (0x0370, "greek"),
    (0x0400, "cyrillic"),
    (0x0530, "armenian"),
    (0x0590, "hebrew"),
    (0x0600, "arabic"),
    (0x0900, "devanagari"),
    (0x0980, "bengali"),
    (0x0A00, "other indic"),
    (0x0E00, "thai"),
    (0x0E80, "other"),
    (0x10A0, "georgian"),
    (0x1100, "hangul"),
    (0x1200, "other"),
    (0x1E00, "latin"),
    (0x1F00, "greek"),
    (0x2000, "other"),
    (0x3040, "kana"),
    (0x3100, "han"),
    (0xAC00, "hangul"),
    (0xD7B0, "other"),
    (0xF900, "han"),
    (0xFB00, "other"),
    (0x20000, "han"),
    (0x30000, "other"),
]
_MIX = np.uint64(0x9E3779B97F4A7C15)
_tables: dict[str, np.ndarray] = {}


def _letters() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Per code point: whether it is a letter, its lower case, its script number."""
    if not _tables:
        points = [chr(c) for c in range(sys.maxunicode + 1)]
        _tables["letter"] = np.fromiter((c.isalpha() for c in points), dtype=bool, count=len(points))
        _tables["lower"] = np.arange(len(points), dtype=np.uint32)
        for c in np.flatnonzero(_tables["letter"]).tolist():
            low = points[c].lower()
            _tables["lower"][c] = ord(low) if len(low) == 1 else c
        names = sorted({name for _, name in SCRIPTS})
        at = np.searchsorted([start for start, _ in SCRIPTS], np.arange(len(points)), side="right") - 1
        _tables["script"] = np.array([names.index(name) for _, name in SCRIPTS], dtype=np.uint8)[at]
    return _tables["letter"], _tables["lower"], _tables["script"]


def _code_points(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Code points of the texts, each followed by a line feed, and where each text begins."""
    points = np.frombuffer(("\n".join(texts) + "\n").encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    return points, np.cumsum([0, *(len(t) + 1 for t in texts)])


def _words(points: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    inside = np.concatenate(([False], _letters()[0][points], [False]))
    return np.flatnonzero(inside[1:] & ~inside[:-1]), np.flatnonzero(inside[:-1] & ~inside[1:])


def _grams(points: np.ndarray, starts: np.ndarray, ends: np.ndarray):
    """For each n: bucket per window start, and the first and last + 1 window of each word (relative)."""
    letter, lower, _ = _letters()
    low, high = int(starts[0]) - 1, int(ends[-1]) + 1
    codes = np.zeros(high - low, dtype=np.uint64)
    inner = points[max(low, 0) : high]
    codes[len(codes) - len(inner) :] = np.where(letter[inner], lower[inner], 0) + np.uint64(1)
    h = codes
    for n in range(1, max(GRAMS) + 1):
        if n > 1:
            if len(codes) < n:
                return
            h = h[: len(codes) - n + 1] * _MIX + codes[n - 1 :]
        if n in GRAMS:
            edge = int(n > 1)  # windows of two and more letters may take in one word edge on each side
            first, last = starts - low - edge, ends - low + edge - n + 1
            yield n, (mix(h + np.uint64(n)) >> np.uint64(64 - BITS)).astype(np.int64), first, np.maximum(last, first)


class LanguageModel:
    """Log scores per n-gram bucket and language, and the scripts of each language."""

    def __init__(self, langs: list[str], table: np.ndarray, uses: np.ndarray):
        self.langs, self.table, self.uses = langs, table, uses

    @classmethod
    def fit(cls, rows: list[tuple[str, str]]) -> LanguageModel:
        """Learns from ``(text, language)`` pairs."""
        langs = sorted({lang for _, lang in rows})
        counts = np.zeros((1 << BITS, max(1, len(langs))), dtype=np.float64)
        scripts = np.zeros((len(langs), len({name for _, name in SCRIPTS})))
        script = _letters()[2]
        for k, lang in enumerate(langs):
            for text in (t for t, own in rows if own == lang):
                points, _ = _code_points([text])
                starts, ends = _words(points)
                if not len(starts):
                    continue
                scripts[k] += np.bincount(script[points[starts]], weights=ends - starts, minlength=scripts.shape[1])
                for _, bucket, first, last in _grams(points, starts, ends):
                    inside = np.zeros(len(bucket) + 1, dtype=np.int64)
                    np.add.at(inside, first, 1)
                    np.add.at(inside, last, -1)
                    np.add.at(counts[:, k], bucket[np.cumsum(inside[:-1]) > 0], 1)
        share = (counts + 0.5) / (counts.sum(axis=0) + 0.5 * len(counts))
        table = np.log(share) - np.log(share.mean(axis=1, keepdims=True))
        uses = scripts >= SCRIPT_SHARE * np.maximum(scripts.sum(axis=1, keepdims=True), 1)
        return cls(langs, table.astype(np.float32), uses)

    def word_scores(self, points: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Score of every word in every language; equal words of the call are scored once."""
        code, distinct = pd.factorize(span_hashes(points, starts, ends))
        where = np.zeros(len(distinct), dtype=np.int64)
        where[code[::-1]] = np.arange(len(code))[::-1]
        lengths = (ends - starts)[where]
        # the distinct words side by side, a space before, between and after them
        own_ends = np.cumsum(lengths + 1)
        own_starts = own_ends - lengths
        packed = np.full(int(own_ends[-1]) + 1, 0x20, dtype=np.uint32)
        packed[np.arange(int(lengths.sum())) + np.repeat(np.arange(1, len(lengths) + 1), lengths)] = points[np.arange(int(lengths.sum())) + np.repeat(starts[where] - np.concatenate(([0], np.cumsum(lengths)[:-1])), lengths)]
        out = np.zeros((len(where), len(self.langs)))
        for a in range(0, len(where), WORDS):
            own = slice(a, a + WORDS)
            for _, bucket, first, last in _grams(packed, own_starts[own], own_ends[own]):
                total = np.zeros((len(bucket) + 1, len(self.langs)))
                np.cumsum(self.table[bucket], axis=0, dtype=np.float64, out=total[1:])
                out[own] += total[np.minimum(last, len(bucket))] - total[np.minimum(first, len(bucket))]
        allowed = self.uses.T[_letters()[2][packed[own_starts]]]
        return np.where(allowed | ~allowed.any(axis=1, keepdims=True), out, -1e6)[code]


def viterbi(scores: np.ndarray, counts: np.ndarray, switch: float = SWITCH) -> np.ndarray:
    """Best label of each word; ``scores`` holds the words of all documents in order, ``counts`` words per document.

    All documents take their t-th step together, so a step is a few numpy calls.
    """
    langs = scores.shape[1]
    begins = np.cumsum(np.concatenate(([0], counts)))[:-1]
    order = np.argsort(-counts, kind="stable")
    begins, lengths = begins[order], counts[order]
    steps = int(lengths[0]) if len(lengths) else 0
    live = np.searchsorted(-lengths, -np.arange(1, steps + 1), side="right")  # documents with more than t words
    back = np.zeros((len(scores), langs), dtype=np.uint16)
    best = np.zeros((len(counts), langs))
    same = np.arange(langs, dtype=np.uint16)
    for t in range(steps):
        k = live[t]
        at = begins[:k] + t
        if t:
            top = best[:k].argmax(axis=1)
            jump = best[np.arange(k), top][:, None] - switch
            stay = best[:k] >= jump
            back[at] = np.where(stay, same, top[:, None])
            best[:k] = np.where(stay, best[:k], jump) + scores[at]
        else:
            best[:k] = scores[at]
    labels = np.zeros(len(scores), dtype=np.int64)
    now = best.argmax(axis=1) if len(counts) else np.zeros(0, dtype=np.int64)
    for t in range(steps - 1, -1, -1):
        k = live[t]
        at = begins[:k] + t
        labels[at] = now[:k]
        now[:k] = back[at, now[:k]]
    return labels


_SPAN = pa.struct([("start", pa.int64()), ("end", pa.int64()), ("lang", pa.string())])
_OUT = pa.schema([("doc_id", pa.int64()), ("lang_pred", pa.string()), ("score", pa.float64()), ("spans", pa.list_(_SPAN))])


def label(texts: list[str], model: LanguageModel) -> tuple[list[str], list[float], pa.Array]:
    """Language, share and spans of each text."""
    points, begins = _code_points(texts)
    starts, ends = _words(points)
    if not model.langs or not len(starts):
        return [UNKNOWN] * len(texts), [0.0] * len(texts), pa.array([[]] * len(texts), pa.list_(_SPAN))
    doc = np.searchsorted(begins, starts, side="right") - 1
    labels = viterbi(model.word_scores(points, starts, ends), np.bincount(doc, minlength=len(texts)))
    n = len(model.langs)
    weight = np.bincount(doc * n + labels, weights=ends - starts, minlength=len(texts) * n).reshape(len(texts), n)
    total = weight.sum(axis=1)
    top = weight.argmax(axis=1)
    share = weight.max(axis=1) / np.maximum(total, 1)
    first = np.flatnonzero(np.concatenate(([True], (doc[1:] != doc[:-1]) | (labels[1:] != labels[:-1]))))
    last = np.append(first[1:], len(doc)) - 1
    offset = begins[doc[first]]
    spans = pa.StructArray.from_arrays([pa.array(starts[first] - offset), pa.array(ends[last] - offset), pa.array(np.array(model.langs, dtype=object)[labels[first]], pa.string())], fields=list(_SPAN))
    edges = np.searchsorted(doc[first], np.arange(len(texts) + 1))
    return (
        [model.langs[k] if t else UNKNOWN for k, t in zip(top.tolist(), total.tolist(), strict=True)],
        share.tolist(),
        pa.ListArray.from_arrays(pa.array(edges, pa.int32()), spans),
    )


def held_out(id_col, modulus: int = HELD_OUT[0], rest: int = HELD_OUT[1]):
    return F.coalesce(F.crc32(id_col.cast("string").cast("binary")) % modulus == rest, F.lit(False))


def fit_language(docs: DataFrame, per_lang: int = TRAIN_PER_LANG, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> LanguageModel:
    """Learns from rows that are not held out; ``per_lang`` bounds what reaches the driver."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang"))
    rows = rows.filter("doc_id is not null and text is not null and lang is not null").filter(~held_out(F.col("doc_id")))
    sizes = rows.groupBy("lang").count().collect()
    # the hash picks about per_lang rows of a language, so that no language gathers in one task
    draw = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) / float(1 << 30)
    rate = F.coalesce(*(F.when(F.col("lang") == r["lang"], F.lit(per_lang / r["count"])) for r in sizes), F.lit(0.0)) if sizes else F.lit(0.0)
    # the draw gives about per_lang rows of a language; twice as many are the most, the first by the hash
    along = Window.partitionBy("lang").orderBy(F.xxhash64("doc_id"), "doc_id", "text")
    sample = rows.filter(draw < rate).withColumn("place", F.row_number().over(along)).filter(F.col("place") <= 2 * per_lang).select("text", "lang").collect()
    return LanguageModel.fit(sorted((r.text, r.lang) for r in sample))


def language_spans(docs: DataFrame, model: LanguageModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, lang_pred, score, spans``; spans are in code points, end exclusive."""
    shared = docs.sparkSession.sparkContext.broadcast((model.langs, model.table, model.uses))

    def run(batches):
        own = LanguageModel(*shared.value)
        for batch in slices(batches):
            langs, scores, spans = label([t or "" for t in batch.column("text").to_pylist()], own)
            yield pa.record_batch([batch.column("doc_id").cast(pa.int64()), pa.array(langs, pa.string()), pa.array(scores, pa.float64()), spans], schema=_OUT)

    return documents(docs, id_col, text_col).mapInArrow(run, "doc_id long, lang_pred string, score double, spans array<struct<start:long,end:long,lang:string>>")
