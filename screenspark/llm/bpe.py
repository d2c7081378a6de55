"""Byte-level BPE encoding and decoding with a segment tree over adjacent pair ranks.

A pre-token is a row of byte symbols.  Leaf ``i`` of its segment tree holds the merge rank of
the pair that starts at symbol ``i`` (no merge: a value above all ranks), inner nodes hold the
smaller of their children as ``rank * size + i``, so the root is the leftmost pair of lowest
rank.  A merge rewrites three leaves, each in log(size) steps; the word is done when the root
holds no mergeable pair.  Long words therefore cost n log n, not n**2.

Vocabulary and merges are read from a public tokenizer file; nothing is trained.  Ids equal
those of the tokenizers library for the same file: added tokens are cut out of the text
first, the rest is split by the byte-level pattern and every piece is merged by itself.
Null text is empty and encodes to no ids.

Defined results: rows with null or repeated ids are rows of their own; an empty table gives no rows; other
columns are ignored; a long text without spaces is one piece with one tree; ties between equal ranks go to the leftmost pair, between documents none arise.
"""

from __future__ import annotations

import hashlib
import json
from itertools import islice

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from .common import documents, slices, utf8

#: Split pattern of byte-level BPE vocabularies; fixed value.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Pieces whose ids one task remembers at most, in two generations.
CACHE = 120_000
#: Bytes of text whose pieces a task holds at a time.
STEP_BYTES = 1 << 19
#: Leaves of the segment trees that are advanced together; bounds the temporary arrays.
MERGED_CELLS = 1 << 17
#: Longer pieces (in UTF-8 bytes) have a tree of their own each and are not remembered.
SHORT_BYTES = 64


def byte_symbols() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies.

    Bytes that print by themselves stand for themselves; the others follow from U+0100 on.
    """
    own = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    spare = iter(range(0x100, 0x200))
    return [chr(b) if b in own else chr(next(spare)) for b in range(256)]


class BytePairs:
    """Encoder and decoder of one byte-level vocabulary file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        vocab: dict[str, int] = spec["model"]["vocab"]
        symbols = byte_symbols()
        self.first = [vocab[s] for s in symbols]
        byte_of = {s: b for b, s in enumerate(symbols)}
        self.bytes_of = {i: bytes(byte_of[c] for c in token) for token, i in vocab.items()}
        #: (left id, right id) as one number -> (rank, merged id)
        self.merges: dict[int, tuple[int, int]] = {}
        for rank, pair in enumerate(spec["model"]["merges"]):
            left, right = pair if isinstance(pair, list) else pair.split(" ")
            self.merges.setdefault(vocab[left] << 20 | vocab[right], (rank, vocab[left + right]))
        self.none = len(self.merges) + 1
        keys = np.array(sorted(self.merges), dtype=np.int64)
        self.keys = np.append(keys, np.iinfo(np.int64).max)
        self.found = np.array([*(self.merges[k] for k in keys.tolist()), (self.none, 0)], dtype=np.int64)
        self.first_ids = np.array(self.first, dtype=np.int64)
        self.added = {t["content"]: t["id"] for t in spec.get("added_tokens", ())}
        self.bytes_of |= {i: token.encode() for token, i in self.added.items()}
        self.split = regex.compile(PATTERN)
        names = sorted(self.added, key=len, reverse=True)
        self.special = regex.compile("(" + "|".join(map(regex.escape, names)) + ")") if names else None

    def merge(self, piece: bytes) -> list[int]:
        """Token ids of one pre-token."""
        ids = [self.first[b] for b in piece]
        n = len(ids)
        if n < 2:
            return ids
        merges, none = self.merges, self.none
        size = 1 << (n - 2).bit_length() if n > 2 else 1
        tree = [none * size] * (2 * size)
        made = [0] * n  # id that the pair starting here would become
        for i in range(n - 1):
            found = merges.get(ids[i] << 20 | ids[i + 1])
            if found:
                tree[size + i] = found[0] * size + i
                made[i] = found[1]
        for k in range(size - 1, 0, -1):
            a, b = tree[2 * k], tree[2 * k + 1]
            tree[k] = a if a < b else b
        after = list(range(1, n + 1))
        before = list(range(-1, n - 1))
        limit = none * size
        while (root := tree[1]) < limit:
            i = root % size
            gone = after[i]
            ids[i] = made[i]
            ids[gone] = -1
            right = after[gone]
            after[i] = right
            changed = [(i, none)]
            if right < n:
                before[right] = i
                found = merges.get(ids[i] << 20 | ids[right])
                if found:
                    changed[0] = (i, found[0])
                    made[i] = found[1]
            if gone < size and tree[size + gone] != limit:
                changed.append((gone, none))
            left = before[i]
            if left >= 0:
                found = merges.get(ids[left] << 20 | ids[i])
                changed.append((left, found[0] if found else none))
                if found:
                    made[left] = found[1]
            for leaf, rank in changed:
                k = size + leaf
                value = rank * size + leaf if rank < none else limit
                if tree[k] == value:
                    continue
                tree[k] = value
                while k > 1:
                    other = tree[k ^ 1]
                    k >>= 1
                    value = value if value < other else other
                    if tree[k] == value:
                        break
                    tree[k] = value
        return [t for t in ids if t >= 0]

    def _pairs(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rank and merged id of pairs of ids (a side below 0, or no merge: rank ``none``)."""
        key = left << 20 | right
        at = np.searchsorted(self.keys, key)
        at[(self.keys[at] != key) | (left < 0) | (right < 0)] = len(self.keys) - 1
        return self.found[at, 0], self.found[at, 1]

    def merge_many(self, words: list[bytes]) -> list[list[int]]:
        """``merge`` of many short pieces: one segment tree per piece, all trees advanced together."""
        out: list[list[int]] = [[]] * len(words)
        lengths = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
        low = 0
        for size in (1, 2, 4, 8, 16, 32, SHORT_BYTES):
            whole = np.flatnonzero((lengths > low) & (lengths <= size))
            low = size
            for at in range(0, len(whole), MERGED_CELLS // size):
                group = whole[at : at + MERGED_CELLS // size]
                raw = np.frombuffer(b"".join(words[g].ljust(size, b"\0") for g in group), dtype=np.uint8).reshape(len(group), size)
                ids = self._merge_rows(self.first_ids[raw], lengths[group])
                counts = (ids >= 0).sum(axis=1)
                flat, ends = ids[ids >= 0].tolist(), np.cumsum(counts).tolist()
                for g, a, b in zip(group.tolist(), [0, *ends], ends, strict=False):
                    out[g] = flat[a:b]
        return out

    def _merge_rows(self, ids: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        rows, size = ids.shape
        ids[np.arange(size) >= lengths[:, None]] = -1
        if size == 1:
            return ids
        limit = self.none * size
        tree = np.full((rows, 2 * size), limit, dtype=np.int64)
        rank, fused = self._pairs(ids[:, :-1].ravel(), ids[:, 1:].ravel())
        made = np.zeros((rows, size), dtype=np.int64)
        made[:, :-1] = fused.reshape(rows, size - 1)
        leaf = rank.reshape(rows, size - 1) * size + np.arange(size - 1)
        tree[:, size:-1] = np.where(leaf < limit, leaf, limit)
        k = size
        while k > 1:
            half = k // 2
            tree[:, half:k] = np.minimum(tree[:, k : 2 * k : 2], tree[:, k + 1 : 2 * k : 2])
            k = half
        after = np.tile(np.arange(1, size + 1), (rows, 1))
        before = np.tile(np.arange(-1, size - 1), (rows, 1))
        ids = np.concatenate((ids, np.full((rows, 1), -1)), axis=1)  # a symbol past the end
        act = np.arange(rows)

        def put(rows_, leaf_, value):
            k = size + leaf_
            tree[rows_, k] = value
            for _ in range(size.bit_length() - 1):
                k = k >> 1
                tree[rows_, k] = np.minimum(tree[rows_, 2 * k], tree[rows_, 2 * k + 1])

        while True:
            root = tree[act, 1]
            live = root < limit
            act, at = act[live], root[live] % size
            if not len(act):
                return ids[:, :-1]
            gone = after[act, at]
            ids[act, at] = made[act, at]
            ids[act, gone] = -1
            right = after[act, gone]
            after[act, at] = right
            inner = right < size
            before[act[inner], right[inner]] = at[inner]
            put(act, gone, limit)
            rank, fused = self._pairs(ids[act, at], ids[act, right])
            made[act, at] = fused
            put(act, at, np.where(rank < self.none, rank * size + at, limit))
            left = before[act, at]
            some = left >= 0
            rows_, left, here = act[some], left[some], at[some]
            rank, fused = self._pairs(ids[rows_, left], ids[rows_, here])
            made[rows_, left] = fused
            put(rows_, left, np.where(rank < self.none, rank * size + left, limit))

    def pieces(self, text: str):
        """Pre-tokens of a text; added tokens come out whole."""
        if self.special is None:
            return self.split.findall(text)
        if not any(name in text for name in self.added):
            return self.split.findall(text)
        out: list[str] = []
        for k, part in enumerate(self.special.split(text)):
            out += [part] if k % 2 else self.split.findall(part)
        return out

    def ids_of(self, piece: str) -> list[int]:
        return [self.added[piece]] if piece in self.added else self.merge(piece.encode())

    def encode(self, text: str) -> list[int]:
        return [i for piece in self.pieces(text) for i in self.ids_of(piece)]

    def decode(self, ids) -> str:
        """The text of token ids; bytes that are no UTF-8 become U+FFFD."""
        return b"".join(map(self.bytes_of.__getitem__, ids)).decode("utf-8", "replace")


class _Memory:
    """Ids and decoded bytes of recent pieces, in two generations of bounded size."""

    def __init__(self, pairs: BytePairs, limit: int = CACHE):
        self.pairs, self.limit = pairs, limit // 2
        self.young: dict[str, tuple[str, int, bytes]] = {}
        self.old: dict[str, tuple[str, int, bytes]] = {}

    def many(self, texts: list[list[str]]) -> list[list[tuple[str, int, bytes]]]:
        """``(ids joined by commas, their number, decoded bytes)`` of the pieces of some texts."""
        if len(self.young) >= self.limit:
            recent = islice(self.young.items(), len(self.young) - self.limit, None)
            self.old, self.young = dict(recent), {}
        known, bytes_of = self.young, self.pairs.bytes_of
        wanted = set().union(*texts) - known.keys()
        new, long = [], {}
        for piece in wanted:
            found = self.old.get(piece)
            if found is not None:
                known[piece] = found
            else:
                new.append(piece)
        short = [p for p in new if p not in self.pairs.added and len(p) <= SHORT_BYTES and len(p.encode()) <= SHORT_BYTES]
        for piece, ids in zip(short, self.pairs.merge_many([p.encode() for p in short]), strict=True):
            known[piece] = (",".join(map(str, ids)), len(ids), b"".join([bytes_of[i] for i in ids]))
        for piece in set(new).difference(short):
            ids = self.pairs.ids_of(piece)
            long[piece] = (",".join(map(str, ids)), len(ids), b"".join([bytes_of[i] for i in ids]))
        if not long:
            return [[known[p] for p in pieces] for pieces in texts]
        return [[known.get(p) or long[p] for p in pieces] for pieces in texts]


_DIGEST = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string()), ("round_trip", pa.bool_())])
_IDS = pa.schema([("doc_id", pa.int64()), ("ids", pa.list_(pa.int32()))])
_TEXT = pa.schema([("doc_id", pa.int64()), ("text", pa.string())])


def encode_ids(docs: DataFrame, vocab_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, ids``: token ids of every whole text.  The file must be readable on every executor."""

    def run(batches):
        pairs = BytePairs(vocab_path)
        memory = _Memory(pairs)
        for batch in slices(batches, limit=STEP_BYTES):
            ids = []
            for found in memory.many([pairs.pieces(raw.decode("utf-8", "replace")) for raw in utf8(batch)]):
                ids.append([int(i) for text, n, _ in found if n for i in text.split(",")])
            yield pa.record_batch([batch.column("doc_id").cast(pa.int64()), pa.array(ids, pa.list_(pa.int32()))], schema=_IDS)

    return documents(docs, id_col, text_col).mapInArrow(run, "doc_id long, ids array<int>")


def decode_ids(encoded: DataFrame, vocab_path: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """``doc_id, text``: the texts of token ids; null ids decode to the empty text."""

    def run(batches):
        pairs = BytePairs(vocab_path)
        for batch in batches:
            texts = [pairs.decode(ids or ()) for ids in batch.column("ids").to_pylist()]
            yield pa.record_batch([batch.column("doc_id").cast(pa.int64()), pa.array(texts, pa.string())], schema=_TEXT)

    return encoded.selectExpr(f"cast(`{id_col}` as long) as doc_id", f"cast(`{ids_col}` as array<int>) as ids").mapInArrow(run, "doc_id long, text string")


def token_digests(docs: DataFrame, vocab_path: str, id_col: str = "doc_id", text_col: str = "text", cache: int = CACHE) -> DataFrame:
    """Token count and digests of the ids and of the text decoded from them, per document; ``cache`` trades memory for time."""

    def run(batches):
        pairs = BytePairs(vocab_path)
        memory = _Memory(pairs, cache)
        for batch in slices(batches, limit=STEP_BYTES):
            counts, ids_sha, text_sha, same = [], [], [], []
            texts = utf8(batch)
            for raw, found in zip(texts, memory.many([pairs.pieces(t.decode("utf-8", "replace")) for t in texts]), strict=True):
                counts.append(sum(n for _, n, _ in found))
                ids_sha.append(hashlib.sha256(",".join([t for t, _, _ in found]).encode()).hexdigest())
                decoded = b"".join([b for _, _, b in found]).decode("utf-8", "replace").encode()
                text_sha.append(hashlib.sha256(decoded).hexdigest())
                same.append(decoded == raw)
            yield pa.record_batch([batch.column("doc_id").cast(pa.int64()), pa.array(counts, pa.int64()), pa.array(ids_sha), pa.array(text_sha), pa.array(same)], schema=_DIGEST)

    return documents(docs, id_col, text_col).mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string, round_trip boolean")
