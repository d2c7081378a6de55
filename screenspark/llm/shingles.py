"""Sets of hashed five-word shingles of whole texts, computed batch-wise with numpy.

Words are maximal runs of bytes outside ``[\\x20\\x09-\\x0D]`` with ``A-Z`` lower-cased.
A text with at least ``width`` words yields its distinct ``width``-word shingles; a text
with fewer words yields one element for the whole sequence; a text without words (null,
empty or blank) yields the empty set.  Elements are 64-bit hashes: a word is the sum of one
pseudo-random number per byte and place (no polynomial, so words built to cancel do not), a shingle
a mixed linear form of its words; at N distinct shingles the chance that any two share a value
is about N**2 / 2**65.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

WIDTH = 5
#: Bytes of text hashed together; bounds the temporary arrays, not the texts.
CHUNK_BYTES = 1 << 20

_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[0x41:0x5B] += 32
#: Places of a word with a number of their own per byte; later places mix theirs.
_PLACES = 64
_GOLDEN = np.uint64(0x9E3779B97F4A7C15)


def mix(h: np.ndarray) -> np.ndarray:
    """Bijective 64-bit finaliser; every output bit depends on every input bit."""
    h = h ^ (h >> np.uint64(30))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h = h ^ (h >> np.uint64(27))
    h = h * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


_NUMBERS = mix((np.arange(_PLACES * 256, dtype=np.uint64) + np.uint64(1)) * _GOLDEN)


def _places(starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of disjoint, ordered, non-empty spans: the index of each element, its place in its span, and where spans begin among them."""
    lengths = ends - starts
    begins = np.cumsum(lengths) - lengths
    place = np.arange(int(lengths.sum())) - np.repeat(begins, lengths)
    return place + np.repeat(starts, lengths), place, begins


def span_hashes(codes: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of ``codes[start:end]`` (code points), equal for equal spans wherever they lie."""
    if not len(starts):
        return np.zeros(0, dtype=np.uint64)
    at, place, begins = _places(starts, ends)
    numbers = mix((codes[at].astype(np.uint64) + np.uint64(1)) * _GOLDEN + (place.astype(np.uint64) << np.uint64(21)))
    return mix(np.add.reduceat(numbers, begins) + (ends - starts).astype(np.uint64))


def _words(buf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Word start offsets and 64-bit word hashes of a byte buffer that ends in a space."""
    space = _SPACE[buf]
    inside = ~space
    starts = np.flatnonzero(inside[1:] & space[:-1]) + 1
    if len(buf) and inside[0]:
        starts = np.concatenate(([0], starts))
    ends = np.flatnonzero(space[1:] & inside[:-1]) + 1
    if not len(starts):
        return starts, np.zeros(0, dtype=np.uint64)
    at, place, begins = _places(starts, ends)
    numbers = _NUMBERS[((place & (_PLACES - 1)) << 8) | _LOWER[buf[at]]]
    far = np.flatnonzero(place >= _PLACES)
    if len(far):
        numbers[far] = mix(numbers[far] + (place[far] >> 6).astype(np.uint64) * _GOLDEN)
    return starts, mix(np.add.reduceat(numbers, begins) + (ends - starts).astype(np.uint64))


def _combine(words: list[np.ndarray], width: int) -> np.ndarray:
    h = np.full(len(words[0]), 0x1234567 + len(words) * 0x10001 + (len(words) == width), dtype=np.uint64)
    for w in words:
        h = h * np.uint64(0xFF51AFD7ED558CCD) + w
    return mix(h)


def shingle_sets(texts: list[bytes | None], width: int = WIDTH) -> Iterator[np.ndarray]:
    """The sorted distinct shingle hashes (uint64) of each text, in order."""
    at = 0
    while at < len(texts):
        end, size = at, 0
        while end < len(texts) and (end == at or size + len(texts[end] or b"") < CHUNK_BYTES):
            size += len(texts[end] or b"") + 1
            end += 1
        part = [t or b"" for t in texts[at:end]]
        starts, words = _words(np.frombuffer(b" ".join(part) + b" ", dtype=np.uint8))
        edges = np.cumsum([0, *(len(t) + 1 for t in part)])
        cut = np.searchsorted(starts, edges)
        n = len(words)
        grams = _combine([words[j : n - width + 1 + j] for j in range(width)], width) if n >= width else words[:0]
        for i in range(len(part)):
            a, b = cut[i], cut[i + 1]
            if b - a >= width:
                yield _distinct(grams[a : b - width + 1])
            elif b > a:
                yield _combine([words[j : j + 1] for j in range(a, b)], width)
            else:
                yield words[:0]
        at = end


def _distinct(h: np.ndarray) -> np.ndarray:
    h = np.sort(h)
    keep = np.empty(len(h), dtype=bool)
    keep[0] = True
    np.not_equal(h[1:], h[:-1], out=keep[1:])
    return h[keep]
