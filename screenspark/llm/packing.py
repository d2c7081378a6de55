"""Packing token sequences into windows by minimum bin slack.

Every document is its token ids and an end id.  Whole windows are cut from the front of long documents; what
remains of each document joins a pool.  A window is filled with the multiset of remaining lengths whose sum comes
closest to the capacity: a bitset (one Python integer, bit ``s`` for a reachable sum ``s``) is shifted by each
length, the longest first and as often as the length occurs, until the capacity is reachable; walking the
stored bitsets backwards gives the count of each length.  Where the best sum leaves slack, the longest
document left in the pool is cut to fill it.  Sequences of a power of two need no padding, so the tokens left at
the end of a partition become windows of the powers of two that they sum to.

Partitions are packed independently, so nothing is shuffled; a lost task packs the same rows in the same way again.
The pool holds at most ``POOL`` documents, each with less than a window of ids.

Words are encoded by the tokenizers library, each distinct word once as long as it is remembered: the vocabulary's
pre-tokenizer drops white space, so no token spans two words.

Defined results: null and empty texts are the end id alone; null and repeated ids are documents of their own; long
texts are encoded piece by piece and leave whole windows behind; ties between equal lengths go to the document that came last;
an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import os
import sys
import zlib
from array import array
from bisect import insort

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from .common import documents, slices, utf8

CAPACITY = 4096
END_ID = 2
#: Documents in the pool of a task, at least as many as ``CAPACITY``: so many always fill a window.
POOL = 4096
#: Words whose ids a Python worker remembers, about, up to ``LONG`` bytes each.
REMEMBERED = 1_200_000
LONG = 48
#: Words of letters that are encoded as one text.
JOINED = 2_000
#: Bytes of a text that are cut into words at a time.
PIECE = 1 << 20


# --- token ids -------------------------------------------------------------------------

#: ASCII punctuation without the apostrophe: behind letters it is a pre-token of its own.
_MARKS = bytes(c for c in range(0x21, 0x7F) if not chr(c).isalnum() and c != 0x27)


def pack_ids(ids: list[int]) -> bytes:
    """Ids as little-endian unsigned 32-bit numbers."""
    out = array("I", ids)
    if sys.byteorder == "big":
        out.byteswap()
    return out.tobytes()


class WordIds:
    """Ids of white-space separated words, as little-endian unsigned 32-bit numbers."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(str(path))
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.specials = [t.content.encode() for t in self.tokenizer.get_added_tokens_decoder().values()]
        suffix = self.tokenizer.model.end_of_word_suffix
        vocab = self.tokenizer.get_vocab()
        self.ends_word = np.zeros(max(vocab.values()) + 1, dtype=bool)
        self.ends_word[[i for token, i in vocab.items() if token.endswith(suffix)]] = True
        # two generations: words that are used again stay, the others go
        self.known: dict[bytes, bytes] = {}
        self.before: dict[bytes, bytes] = {}

    def _learn(self, words: list[bytes]) -> dict[bytes, bytes]:
        """Ids of words; those of ASCII letters alone are one pre-token each, so many are encoded as one text and cut where a token ends a word."""
        plain = [w for w in words if w.isalpha()]
        out: dict[bytes, bytes] = {}
        for at in range(0, len(plain), JOINED):
            some = plain[at : at + JOINED]
            ids = np.array(self.tokenizer.encode(b" ".join(some).decode(), add_special_tokens=False).ids, dtype="<u4")
            ends = (4 * (np.flatnonzero(self.ends_word[ids]) + 1)).tolist()
            if len(ends) != len(some):
                raise ValueError("a word of letters is not one pre-token of this tokenizer")
            raw = ids.tobytes()
            out.update(zip(some, [raw[a:b] for a, b in zip([0, *ends], ends, strict=False)], strict=True))
        return out | self._each([w for w in words if not w.isalpha()])

    def _each(self, words: list[bytes]) -> dict[bytes, bytes]:
        found = self.tokenizer.encode_batch_fast([w.decode("utf-8", "replace") for w in words], add_special_tokens=False)
        return {w: pack_ids(e.ids) for w, e in zip(words, found, strict=True)}

    def words(self, raw: bytes) -> list[bytes]:
        """Words of a text; case does not count, except in the strings of special tokens, which are matched first."""
        lower = raw.lower()
        return (raw if any(s.lower() in lower for s in self.specials) else lower).split()

    def encode(self, texts: list[list[bytes]]) -> list[bytes]:
        """The ids of some lists of words."""
        if len(self.known) > REMEMBERED // 2:
            self.before, self.known = self.known, {}
        known, before = self.known, self.before
        short, rest, made = set(), [], []
        for word in set().union(*texts).difference(known):
            found = before.get(word)
            if found is not None:
                known[word] = found
                continue
            if len(word) > LONG:
                rest.append(word)
                continue
            body = word.rstrip(_MARKS)
            if len(body) == len(word) or not body.isalpha():
                short.add(word)
                continue
            made.append((word, body, word[len(body) :]))
            short.update(p for p in made[-1][1:] if p not in known)
        known.update(self._learn(list(short)))
        known.update((word, known[body] + known[marks]) for word, body, marks in made)
        long = self._learn(rest)
        if not long:
            return [b"".join(map(known.__getitem__, words)) for words in texts]
        return [b"".join([known[w] if len(w) <= LONG else long[w] for w in words]) for words in texts]


_WORD_IDS: dict[str, WordIds] = {}


def word_ids(path: str) -> WordIds:
    """The encoder of a file, one per Python worker."""
    if path not in _WORD_IDS:
        _WORD_IDS[path] = WordIds(path)
    return _WORD_IDS[path]


def text_pieces(raw: bytes, size: int = PIECE):
    """A text in pieces of about ``size`` bytes, cut at spaces."""
    at = 0
    while at < len(raw):
        end = raw.find(b" ", at + size)
        end = len(raw) if end < 0 else end
        yield raw[at:end]
        at = end


# --- minimum bin slack -----------------------------------------------------------------


def fullest(lengths: list[int], counts: dict[int, int], capacity: int) -> list[tuple[int, int]]:
    """The multiset ``(length, number)`` of the given one whose sum is closest to ``capacity`` from below.

    ``lengths`` are the keys of ``counts`` in ascending order.
    """
    reach, mask, stages = 1, (1 << (capacity + 1)) - 1, []
    for length in reversed(lengths):
        if length > capacity:
            continue
        stages.append((length, reach))
        left, step = min(counts[length], capacity // length), 1
        while left:
            step = min(step, left)
            reach |= (reach << (step * length)) & mask
            left -= step
            step *= 2
        if reach >> capacity:
            break
    at, chosen = reach.bit_length() - 1, []
    for length, before in reversed(stages):
        number = 0
        while not before >> at & 1:
            at -= length
            number += 1
        if number:
            chosen.append((length, number))
    return chosen


class Packer:
    """Packs documents of one partition; ``pieces`` holds the rows made so far."""

    def __init__(self, first_sequence: int, capacity: int = CAPACITY, pool: int = POOL, keep_ids: bool = False):
        self.capacity, self.pool, self.keep_ids = capacity, max(pool, capacity), keep_ids
        self.sequence = first_sequence
        self.lengths: list[int] = []
        self.counts: dict[int, int] = {}
        self.held: dict[int, list[tuple]] = {}
        self.docs = self.tokens = 0
        self.pieces: list[tuple] = []

    def _put(self, doc: list, start: int, ids: bytes) -> None:
        n = len(ids) // 4
        if n not in self.counts:
            self.counts[n], self.held[n] = 0, []
            insort(self.lengths, n)
        self.counts[n] += 1
        self.held[n].append((doc, start, ids))
        self.docs += 1
        self.tokens += n

    def _take(self, n: int) -> tuple:
        self.counts[n] -= 1
        self.docs -= 1
        self.tokens -= n
        out = self.held[n].pop()
        if not self.counts[n]:
            del self.counts[n], self.held[n]
            self.lengths.remove(n)
        return out

    def _emit(self, doc: list, start: int, ids: bytes, offset: int) -> None:
        # ``doc`` gets its number of tokens when its end is read
        self.pieces.append((doc, start, len(ids) // 4, zlib.crc32(ids), self.sequence, offset, ids if self.keep_ids else None))

    def _window(self, capacity: int) -> None:
        offset = 0
        for length, number in fullest(self.lengths, self.counts, capacity):
            for _ in range(number):
                self._emit(*self._take(length), offset)
                offset += length
        if offset < capacity:  # then every document left is longer than the slack
            doc, start, ids = self._take(self.lengths[-1])
            slack = capacity - offset
            self._emit(doc, start, ids[: 4 * slack], offset)
            self._put(doc, start + slack, ids[4 * slack :])
        self.sequence += 1

    def add(self, doc_id, pieces) -> None:
        """A document as pieces of its ids; the last one ends with its end id."""
        doc, start, left, width = [doc_id, 0], 0, b"", 4 * self.capacity
        for piece in pieces:
            left += piece
            doc[1] += len(piece) // 4
            at = 0
            while len(left) - at >= width:
                self._emit(doc, start, left[at : at + width], 0)
                self.sequence += 1
                at += width
                start += self.capacity
            left = left[at:]
        if left:
            self._put(doc, start, left)
        if self.docs >= self.pool:
            while self.docs > self.pool // 2 and self.tokens >= self.capacity:
                self._window(self.capacity)

    def finish(self) -> None:
        while self.tokens >= self.capacity:
            self._window(self.capacity)
        for bit in reversed(range(self.tokens.bit_length())):
            if self.tokens >> bit & 1:
                self._window(1 << bit)


# --- the operator ----------------------------------------------------------------------

_COLUMNS = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
_TYPES = pa.schema([(c.split()[0], pa.int64()) for c in _COLUMNS.split(", ")])


def _rows(pieces: list[tuple], keep_ids: bool) -> pa.RecordBatch:
    columns = [[p[0][0] for p in pieces], *([p[k] for p in pieces] for k in (1, 2, 3)), [p[0][1] for p in pieces], *([p[k] for p in pieces] for k in (4, 5))]
    arrays = [pa.array(c, pa.int64()) for c in columns]
    if not keep_ids:
        return pa.record_batch(arrays, schema=_TYPES)
    ids = [pa.Array.from_buffers(pa.int32(), len(p[6]) // 4, [None, pa.py_buffer(p[6])]).to_pylist() for p in pieces]
    return pa.record_batch([*arrays, pa.array(ids, pa.list_(pa.int32()))], schema=_TYPES.append(pa.field("ids", pa.list_(pa.int32()))))


def pack(docs: DataFrame, vocab_path: str, capacity: int = CAPACITY, end_id: int = END_ID, pool: int = POOL, keep_ids: bool = False, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row per piece of a document: where it begins in its document and in its sequence, its length and the CRC-32 of its ids; with ``keep_ids`` the ids too.

    ``sequence_id`` holds the partition's number in its upper and the sequence's number in its lower 32 bits.
    """

    def run(batches):
        known = word_ids(vocab_path)
        end = end_id.to_bytes(4, "little")
        packer = Packer(TaskContext.get().partitionId() << 32, capacity, pool, keep_ids)
        for batch in slices(batches):
            texts, ids = utf8(batch), batch.column("doc_id").to_pylist()
            short = known.encode([known.words(raw) if len(raw) <= PIECE else [] for raw in texts])
            for doc_id, raw, found in zip(ids, texts, short, strict=True):
                if len(raw) <= PIECE:
                    packer.add(doc_id, [found + end])
                else:
                    packer.add(doc_id, (part for piece in (*text_pieces(raw), None) for part in ([end] if piece is None else known.encode([known.words(piece)]))))
                if len(packer.pieces) > 10_000:
                    yield _rows(packer.pieces, keep_ids)
                    packer.pieces = []
        packer.finish()
        if packer.pieces:
            yield _rows(packer.pieces, keep_ids)

    return documents(docs, id_col, text_col).mapInArrow(run, _COLUMNS + ", ids array<int>" * keep_ids)
