"""op12: groups, links and corpus counts against a brute-force version."""

import hashlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from tokenizers import Tokenizer

from screenspark.llm import alignment
from screenspark.llm.bpe import byte_symbols

A_PATH, B_PATH = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
ODD = [None, "", " ", "  ", "a", "a", "A  b", "a\tb", "Grüße 𝔘 \u0000 x", "lorem ipsum " * 300, "z" * 500, "   \n\n  tail ", "'s 12345 don't"]
ODD += ["x<|endoftext|>Y <s> </s> <0x41> Q", "é ́a ΟΔΟΣ. İ ", "a b c\x1cd\x85e \x85 f", "DON'T'S,,. ...", "a▁b c", "日本語 テキスト。", "a 　b", "x \n y\n z"]
ODD += ["tab \t tab", " lead", "trail  ", "ﬁ Å ́x", "👩‍👩‍👧 x", "naïve café" * 60, "The cat sat on the mat. " * 9]


def cut_bytes(text):
    """``(A ids, B ids, groups)`` of a text, or None."""
    if not text:
        return None
    a_of = Tokenizer.from_file(str(A_PATH))
    a_of.encode_special_tokens = True
    b_of = sentencepiece.SentencePieceProcessor(model_file=str(B_PATH))
    byte_of = {s: b for b, s in enumerate(byte_symbols())}
    a, b = a_of.encode(" " + text, add_special_tokens=False), b_of.encode(text)
    a_bytes = [bytes(byte_of[c] for c in t) for t in a.tokens]
    b_bytes = [bytes([int(b_of.id_to_piece(i)[3:5], 16)]) if b_of.is_byte(i) else b_of.id_to_piece(i).replace("▁", " ").encode() for i in b]
    raw = (" " + text).encode()
    if b"".join(a_bytes) != raw or b"".join(b_bytes) != raw:
        return None
    ends = [np.cumsum(list(map(len, x))).tolist() for x in (a_bytes, b_bytes)]
    groups, before = [], 0
    for end in sorted(set(ends[0]) & set(ends[1])):
        groups.append(tuple([i for i, e in zip(ids, own, strict=True) if before < e <= end] for ids, own in zip((a.ids, b), ends, strict=True)))
        before = end
    return a.ids, b, groups


def brute_force(texts):
    cut = [cut_bytes(t) for t in texts]
    links = [[(x, y) for p, q in c[2] for x in p for y in q] if c else [] for c in cut]
    count = Counter(pair for own in links for pair in set(own))
    best = defaultdict(int)
    for (x, _), n in count.items():
        best[x] = max(best[x], n)
    out = []
    for c, own in zip(cut, links, strict=True):
        if not c:
            out.append((0, 0, 0, 0, 0, 0, ""))
            continue
        shown = ";".join(",".join(map(str, p)) + "|" + ",".join(map(str, q)) for p, q in c[2])
        out.append((len(c[0]), len(c[1]), len(c[2]), len(own), sum(count[k] == best[k[0]] for k in own), sum(count[k] for k in own), hashlib.sha256(shown.encode()).hexdigest()))
    return out, len(count)


def found(spark, texts, **kw):
    df = spark.createDataFrame([(i, t, 1, "") for i, t in enumerate(texts)], "doc_id long, text string, pos int, pairs string").repartition(3)
    rows = alignment.corpus_alignment(df, A_PATH, B_PATH, **kw).collect()
    assert len(rows) == len(texts)
    return [tuple(r)[1:] for r in sorted(rows, key=lambda r: r.doc_id)]


@pytest.mark.parametrize("share", [1, 7])
def test_every_column_equals_brute_force(spark, share):
    want, pairs = brute_force(ODD)
    assert found(spark, ODD, pairs=pairs // share + 1) == want
    assert sum(w[0] == 0 for w in want) == 3


def test_wide_groups_are_counted_by_distinct_ids(spark, monkeypatch):
    want, _ = brute_force(ODD)
    own = alignment.Aligner(A_PATH, B_PATH)
    monkeypatch.setattr(alignment, "WIDE", 1)
    links = own.documents([t or "" for t in ODD])[3]
    assert links.tolist() == [w[3] for w in want]
    n, m = np.array([3]), np.array([4])
    unit, pair, times = own._expand(np.array([5, 5, 6]), np.array([1, 2, 2, 2]), np.array([0]), np.array([0]), n, m, np.array([0]))
    assert dict(zip(pair.tolist(), times.tolist(), strict=True)) == {5 * own.n_b + 1: 2, 5 * own.n_b + 2: 6, 6 * own.n_b + 1: 1, 6 * own.n_b + 2: 3}


def test_workers_forget_without_changing_results(spark, monkeypatch):
    want, _ = brute_force(ODD)
    monkeypatch.setattr(alignment, "REMEMBERED", 3)
    monkeypatch.setattr(alignment, "LONG", 2)
    own = alignment.Aligner(A_PATH, B_PATH)
    for _ in range(2):
        for text, w in zip(ODD, want, strict=True):
            n_a, n_b, groups, links, digests, *_ = own.documents([text or ""])
            assert (n_a[0], n_b[0], groups[0], links[0], digests[0]) == (*w[:4], w[6])


def test_stabbing_finds_the_overlaps():
    a_ends, b_ends = np.array([2, 5, 6, 9]), np.array([3, 5, 9])
    first, last = alignment.stab(a_ends, b_ends)
    assert (first.tolist(), last.tolist()) == ([0, 0, 2, 2], [0, 1, 2, 2])
    assert [x.tolist() for x in alignment.group_sizes(a_ends, b_ends)] == [[2, 2], [2, 1]]


def test_nulls_repeats_and_empty_tables(spark):
    df = spark.createDataFrame([(None, "a b"), (None, "a b"), (2, "a b"), (2, None)], "doc_id long, text string")
    rows = alignment.corpus_alignment(df, A_PATH, B_PATH).collect()
    assert sorted(r.count_sum for r in rows) == [0, 6, 6, 6] and sum(r.doc_id is None for r in rows) == 2
    assert alignment.corpus_alignment(df.limit(0), A_PATH, B_PATH).collect() == []
