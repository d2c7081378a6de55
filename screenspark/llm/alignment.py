"""Alignment of two tokenizers' tokens over the same bytes.

The B tokens of a text are disjoint byte ranges in order: a static interval index (sorted starts and ends).  Every A token stabs
it with two bisections, which give the first and the last B token that its range overlaps.  The gap after an A token that no B token spans
is a group boundary; groups hold the A and B tokens between two boundaries, and every A token of a group is linked with every B token of it.

Encoders and bytes: A is a byte-level file of the tokenizers library, encoded from a space and the text; B is a sentencepiece model that adds that
space by itself.  Neither has a token that holds a space after something else (the B vocabulary is checked for that), so a space
between two characters that are no white space parts the text into units, each encoded and aligned once while it is remembered.

How many documents hold a pair of ids linked is counted over the corpus: distinct pairs per document, summed per task before the shuffle.  The
counts return to the documents as sorted arrays of at most about ``PAIRS`` pairs at a time, cut between A ids; with more
pairs than that, documents are read once per array and their sums are added up.

Defined results: null and empty texts, and texts that either tokenizer does not give back byte by byte, have no tokens (zeros and an empty digest); null and repeated
ids are documents of their own; a long text is handled unit by unit, a unit without spaces as a whole; ties for an A id's highest count all count as best;
an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import os
import re

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe import byte_symbols
from .common import documents, materialise, slices, utf8

#: Pairs whose counts are sent to the tasks at a time, about (16 bytes each).
PAIRS = 4_000_000
#: Units that a Python worker remembers, up to ``LONG`` characters each.
REMEMBERED = 400_000
LONG = 64
#: Links of a group above which it is expanded by distinct ids.
WIDE = 4_096

_CUT = re.compile(r"(?<=\S) (?=\S)")
#: A space beside white space, or at an end of the text.
_ODD = re.compile(r"\s | \s|\A | \Z")


def units(text: str) -> list[str]:
    """A text cut at each space between two characters that are no white space."""
    return _CUT.split(text) if _ODD.search(text) else text.split(" ")


class _Rows:
    """A numpy array that grows at its end."""

    def __init__(self, kind):
        self.data, self.n = np.zeros(1024, dtype=kind), 0

    def extend(self, values) -> None:
        if self.n + len(values) > len(self.data):
            self.data = np.concatenate((self.data[: self.n], np.zeros(max(len(values), self.n), dtype=self.data.dtype)))
        self.data[self.n : self.n + len(values)] = values
        self.n += len(values)


def stab(a_ends: np.ndarray, b_ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and last B token that each A token overlaps, for tokens that cover the same bytes without gaps."""
    a_starts, b_starts = (np.concatenate(([0], ends[:-1])) for ends in (a_ends, b_ends))
    return np.searchsorted(b_ends, a_starts, side="right"), np.searchsorted(b_starts, a_ends, side="left") - 1


def group_sizes(a_ends: np.ndarray, b_ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Numbers of A and of B tokens in each group."""
    if not len(a_ends):
        return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
    _, last = stab(a_ends, b_ends)
    closed = np.flatnonzero(b_ends[last] == a_ends)  # no B token spans the gap after these A tokens
    return np.diff(closed, prepend=-1), np.diff(last[closed], prepend=-1)


class Aligner:
    """Encodes and aligns units; keeps what it learned of them in arrays."""

    def __init__(self, a_path: str, b_path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        import sentencepiece
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_file(str(a_path))
        self.a.no_truncation()
        self.a.no_padding()
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_file=str(b_path))
        byte_of = {s: b for b, s in enumerate(byte_symbols())}
        vocab = self.a.get_vocab(with_added_tokens=False)
        self.n_a, self.n_b = max(vocab.values()) + 1, self.b.get_piece_size()
        self.a_bytes = [b""] * self.n_a
        for token, i in vocab.items():
            self.a_bytes[i] = bytes(byte_of[c] for c in token) if all(c in byte_of for c in token) else token.encode()
        pieces = [self.b.id_to_piece(i) for i in range(self.n_b)]
        if any("▁" in p.lstrip("▁") for p in pieces):
            raise ValueError("units cannot be encoded apart: a piece holds a space after something else")
        if self.n_a * self.n_b > 1 << 32:
            raise ValueError("pairs of ids of these vocabularies need more than 32 bits")
        self.b_bytes = [bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(pieces)]
        self.a_length, self.b_length = (np.array(list(map(len, t)), dtype=np.int64) for t in (self.a_bytes, self.b_bytes))
        self.forget()

    def forget(self) -> None:
        self.known: dict[str, int] = {}
        self.shown: list[bytes] = []  # groups as text
        self.right, self.tokens_a, self.tokens_b, self.groups, self.links = (_Rows(np.int64) for _ in range(5))
        self.begins, self.pairs, self.times = _Rows(np.int64), _Rows(np.int64), _Rows(np.int64)
        self.begins.extend([0])

    def learn(self, new: list[str]) -> dict[str, int]:
        """Numbers of new units, whose results are added to the arrays."""
        a_ids = [e.ids for e in self.a.encode_batch_fast([" " + u for u in new], add_special_tokens=False)]
        b_ids = self.b.encode(new, num_threads=1)
        a_bytes, b_bytes = self.a_bytes, self.b_bytes
        right = []
        for k, u in enumerate(new):
            raw = b" " + u.encode()
            right.append(b"".join([a_bytes[i] for i in a_ids[k]]) == raw and b"".join([b_bytes[i] for i in b_ids[k]]) == raw)
            if not right[-1]:
                a_ids[k], b_ids[k] = [], []
        at_a, at_b = (np.cumsum([0, *map(len, ids)]) for ids in (a_ids, b_ids))
        flat_a, flat_b = (np.fromiter((i for ids in x for i in ids), np.int64) for x in (a_ids, b_ids))
        of_a, of_b = group_sizes(np.cumsum(self.a_length[flat_a]), np.cumsum(self.b_length[flat_b]))
        ends_a, ends_b = np.cumsum(of_a), np.cumsum(of_b)
        # units end where both tokenizers have an end, so each group lies in one unit
        unit = np.searchsorted(at_a, ends_a - 1, side="right") - 1
        counts = lambda weights=None: np.bincount(unit, weights, minlength=len(new)).astype(np.int64)
        first = self.right.n
        self.right.extend(np.array(right, dtype=np.int64))
        self.tokens_a.extend(np.diff(at_a))
        self.tokens_b.extend(np.diff(at_b))
        self.groups.extend(counts())
        self.links.extend(counts(of_a * of_b))
        pair_unit, pair, times = self._expand(flat_a, flat_b, ends_a - of_a, ends_b - of_b, of_a, of_b, unit)
        self.pairs.extend(pair)
        self.times.extend(times)
        self.begins.extend(self.begins.data[self.begins.n - 1] + np.cumsum(np.bincount(pair_unit, minlength=len(new))))
        text_a, text_b = list(map(str, flat_a.tolist())), list(map(str, flat_b.tolist()))
        groups, a, b = [], 0, 0
        for x, y in zip(ends_a.tolist(), ends_b.tolist(), strict=True):
            groups.append((text_a[a] if x == a + 1 else ",".join(text_a[a:x])) + "|" + (text_b[b] if y == b + 1 else ",".join(text_b[b:y])))
            a, b = x, y
        cut = np.cumsum(counts()).tolist()
        self.shown += [";".join(groups[x:y]).encode() for x, y in zip([0, *cut], cut, strict=False)]
        return {u: first + k for k, u in enumerate(new)}

    def _expand(self, flat_a, flat_b, from_a, from_b, of_a, of_b, unit):
        """Distinct linked pairs per unit, with their numbers."""
        narrow = of_a * of_b <= WIDE
        n, m, own = of_a[narrow], of_b[narrow], unit[narrow]
        total = n * m
        place = np.arange(total.sum()) - np.repeat(np.cumsum(total) - total, total)
        width = np.repeat(m, total)
        a = flat_a[np.repeat(from_a[narrow], total) + place // np.maximum(width, 1)]
        b = flat_b[np.repeat(from_b[narrow], total) + place % np.maximum(width, 1)]
        units_, pairs, times = [np.repeat(own, total)], [a * self.n_b + b], [np.ones(len(a), dtype=np.int64)]
        for g in np.flatnonzero(~narrow):
            x, x_times = np.unique(flat_a[from_a[g] : from_a[g] + of_a[g]], return_counts=True)
            y, y_times = np.unique(flat_b[from_b[g] : from_b[g] + of_b[g]], return_counts=True)
            pairs.append((x[:, None] * self.n_b + y).ravel())
            times.append((x_times[:, None] * y_times).ravel())
            units_.append(np.full(len(pairs[-1]), unit[g]))
        return _summed(*map(np.concatenate, (units_, pairs, times)))

    def documents(self, texts: list[str]):
        """``(n_a, n_b, n_groups, n_links, digests, document of each pair, pair, times)`` of some texts."""
        if len(self.known) > REMEMBERED:
            self.forget()
        cut = [units(t) if t else [] for t in texts]
        new = list(set().union(*cut) - self.known.keys())
        found = self.learn(new) if new else {}
        self.known.update((u, k) for u, k in found.items() if len(u) <= LONG)
        known = self.known if len(found) == 0 or max(map(len, new)) <= LONG else {**self.known, **found}
        rows = [[known[u] for u in x] for x in cut]
        doc = np.repeat(np.arange(len(texts)), list(map(len, rows)))
        unit = np.fromiter((k for x in rows for k in x), np.int64, count=len(doc))
        wrong = np.bincount(doc, self.right.data[unit] == 0, minlength=len(texts)) > 0
        shown = self.shown
        digests = [hashlib.sha256(b";".join([shown[k] for k in x])).hexdigest() if x and not w else "" for x, w in zip(rows, wrong.tolist(), strict=True)]
        keep = ~wrong[doc]
        doc, unit = doc[keep], unit[keep]
        totals = [np.bincount(doc, r.data[unit], minlength=len(texts)).astype(np.int64) for r in (self.tokens_a, self.tokens_b, self.groups, self.links)]
        # units of a document with their numbers first, then the pairs of each
        doc, unit, often = _summed(doc, unit, np.ones(len(doc), dtype=np.int64))
        begin, end = self.begins.data[unit], self.begins.data[unit + 1]
        size = end - begin
        at = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size) + np.repeat(begin, size)
        doc, pair, times = _summed(np.repeat(doc, size), self.pairs.data[at], self.times.data[at] * np.repeat(often, size))
        self._drop_long(found)
        return (*totals, digests, doc, pair, times)

    def _drop_long(self, found: dict[str, int]) -> None:
        """A worker that learned long units forgets all: their arrays have no bound."""
        if any(len(u) > LONG for u in found) and self.pairs.n > 40 * REMEMBERED:
            self.forget()


def _summed(row: np.ndarray, value: np.ndarray, times: np.ndarray):
    """Distinct ``(row, value)`` in order, with the sums of ``times``."""
    if not len(row):
        return row, value, times
    key = row << 32 | value
    order = np.argsort(key, kind="stable")
    key = key[order]
    first = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
    return key[first] >> 32, key[first] & 0xFFFFFFFF, np.add.reduceat(times[order], first)


_ALIGNERS: dict[tuple[str, str], Aligner] = {}


def aligner(a_path: str, b_path: str) -> Aligner:
    """The aligner of two files, one per Python worker."""
    if (a_path, b_path) not in _ALIGNERS:
        _ALIGNERS[a_path, b_path] = Aligner(a_path, b_path)
    return _ALIGNERS[a_path, b_path]


# --- corpus ----------------------------------------------------------------------------

_ALIGNED = "doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, pairs array<int>, times array<int>"
_NUMBERS = pa.list_(pa.int32())
_ALIGNED_TYPES = pa.schema([*((c, pa.int64()) for c in ("doc_id", "n_a", "n_b", "n_groups", "n_links")), ("groups_sha256", pa.string()), ("pairs", _NUMBERS), ("times", _NUMBERS)])


def align(docs: DataFrame, a_path: str, b_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document its numbers of tokens, groups and links, the digest of its groups, and its distinct linked pairs.

    ``pairs`` holds ``a * (number of B ids) + b`` as unsigned 32-bit numbers, ``times`` how often each is linked.
    """

    def run(batches):
        own = aligner(a_path, b_path)
        for batch in slices(batches):
            n_a, n_b, groups, links, digests, doc, pair, times = own.documents([raw.decode("utf-8", "replace") for raw in utf8(batch)])
            offsets = pa.array(np.searchsorted(doc, np.arange(batch.num_rows + 1)), pa.int32())
            lists = [pa.ListArray.from_arrays(offsets, pa.array(v.astype(np.uint32).view(np.int32))) for v in (pair, np.minimum(times, 2**31 - 1))]
            yield pa.record_batch([batch.column("doc_id").cast(pa.int64()), *(pa.array(v) for v in (n_a, n_b, groups, links)), pa.array(digests, pa.string()), *lists], schema=_ALIGNED_TYPES)

    return documents(docs, id_col, text_col).mapInArrow(run, _ALIGNED)


def _count_pairs(most: int = 1 << 21):
    """Distinct pairs with their numbers of documents; what a task has gathered is summed whenever it grows beyond ``most``."""

    def out(pair, n):
        for at in range(0, len(pair), 1 << 16):
            yield pa.record_batch([pa.array(pair[at : at + (1 << 16)]), pa.array(n[at : at + (1 << 16)])], names=["pair", "n"])

    def run(batches):
        held = np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
        parts, size = [], 0

        def folded():
            pair = np.concatenate([held[0], *parts])
            n = np.concatenate((held[1], np.ones(len(pair) - len(held[0]), dtype=np.int64)))
            order = np.argsort(pair, kind="stable")
            pair = pair[order]
            first = np.flatnonzero(np.concatenate(([True], pair[1:] != pair[:-1]))) if len(pair) else np.zeros(0, dtype=np.int64)
            return pair[first], np.add.reduceat(n[order], first) if len(first) else first

        for batch in batches:
            parts.append(batch.column("pairs").flatten().to_numpy(zero_copy_only=False).view(np.uint32).astype(np.int64))
            size += len(parts[-1])
            if size > most:
                held = folded()
                parts, size = [], 0
                if len(held[0]) > most:
                    yield from out(*held)
                    held = np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
        held = folded()
        if len(held[0]):
            yield from out(*held)

    return run


def pair_counts(aligned: DataFrame, n_b: int) -> DataFrame:
    """``a, b, n``: in how many documents of ``align``'s table each pair of ids is linked."""
    summed = aligned.select("pairs").mapInArrow(_count_pairs(), "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n"))
    return summed.select((F.col("pair") / n_b).cast("long").alias("a"), F.pmod("pair", F.lit(n_b)).alias("b"), "n")


def _look_up(shared, n_b: int):
    """Adds to each document what the shared pairs give: links of best pairs, and the sum of counts over links."""

    def run(batches):
        keys, counts, best = shared.value
        for batch in batches:
            lists = batch.column("pairs")
            pair = lists.flatten().to_numpy(zero_copy_only=False).view(np.uint32)
            times = batch.column("times").flatten().to_numpy(zero_copy_only=False).astype(np.int64)
            doc = np.repeat(np.arange(batch.num_rows), pa.compute.list_value_length(lists).fill_null(0).to_numpy(zero_copy_only=False))
            at = np.searchsorted(keys, pair)
            at[at == len(keys)] = 0
            here = keys[at] == pair if len(keys) else np.zeros(len(pair), dtype=bool)
            doc, at, times = doc[here], at[here], times[here]
            sums = [np.zeros(batch.num_rows, dtype=np.int64) for _ in range(2)]
            np.add.at(sums[0], doc, times * best[at])
            np.add.at(sums[1], doc, times * counts[at])
            rest = [c for c in batch.schema.names if c not in ("pairs", "times")]
            yield pa.record_batch([*(batch.column(c) for c in rest), *map(pa.array, sums)], names=[*rest, "n_best", "count_sum"])

    return run


def pair_arrays(counts: DataFrame, n_b: int, pairs: int):
    """Shared arrays ``(pair, count, whether it is its A id's highest)``, each of about ``pairs`` pairs, no A id in two of them.

    A row per A id reaches the driver, and one array at a time.
    """
    sizes = sorted((r.a, r.m) for r in counts.groupBy("a").agg(F.count("*").alias("m")).collect())
    at = 0
    while at < len(sizes):
        end, total = at, 0
        while end < len(sizes) and (end == at or total + sizes[end][1] <= pairs):
            total += sizes[end][1]
            end += 1
        rows = counts.filter(F.col("a").between(sizes[at][0], sizes[end - 1][0])).select((F.col("a") * n_b + F.col("b")).alias("pair"), "n").toArrow()
        pair, n = (rows.column(c).to_numpy() for c in ("pair", "n"))
        order = np.argsort(pair)
        pair, n = pair[order], n[order]
        first = np.flatnonzero(np.diff(pair // n_b, prepend=-1))
        best = n == np.repeat(np.maximum.reduceat(n, first), np.diff(np.append(first, len(n))))
        yield pair.astype(np.uint32), n, best
        at = end


def corpus_alignment(docs: DataFrame, a_path: str, b_path: str, pairs: int = PAIRS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256`` of every row of ``docs``."""
    names = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    n_b = aligner(a_path, b_path).n_b
    aligned = materialise(align(docs, a_path, b_path, id_col, text_col).withColumn("pos", F.monotonically_increasing_id()))
    counts = materialise(pair_counts(aligned, n_b))
    sc = docs.sparkSession.sparkContext
    columns = "doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, pos long"
    source = aligned.select(*(c.split()[0] for c in columns.split(", ")), "pairs", "times")
    rounds = [source.mapInArrow(_look_up(sc.broadcast(arrays), n_b), columns + ", n_best long, count_sum long") for arrays in pair_arrays(counts, n_b, pairs)]
    if not rounds:
        return aligned.select(*(F.lit(0).cast("long").alias(c) if c in ("n_best", "count_sum") else F.col(c) for c in names))
    if len(rounds) == 1:
        return rounds[0].select(*names)
    both = rounds[0]
    for more in rounds[1:]:
        both = both.unionByName(more)
    own = [c.split()[0] for c in columns.split(", ")]
    return both.groupBy(*own).agg(F.sum("n_best").alias("n_best"), F.sum("count_sum").alias("count_sum")).select(*names)
