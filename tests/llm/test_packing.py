"""op13: ids and checksums against the tokenizers library, windows, and the subset sum against all subsets."""

import itertools
import random
import struct
import zlib
from collections import defaultdict

import public_tokenizers
import pytest
from tokenizers import Tokenizer

from screenspark.llm import packing

ODD = [None, "", " ", "a", "a", "A  b", "a\tb", "Grüße 𝔘 \u0000 x", "lorem ipsum " * 3000, "z" * 5000, "   \n\n  tail ", "'s 12345 don't"]
ODD += ["x<|endoftext|>Y <|ENDOFTEXT|> Q", "é ́a ΟΔΟΣ. İ ", "a b c\x1cd\x85e", "DON'T'S,,. ...", "<|startoftext|>" * 3, "ÊÈ!! LE!! a.,, b'., 12,. é,. x).. word, word. word!! (word) ,, .a"]


def ids_of(text):
    known = Tokenizer.from_file(str(public_tokenizers.path("word_bpe_49k.json")))
    known.no_truncation()
    known.no_padding()
    return [*known.encode(text or "", add_special_tokens=False).ids, 2]


def pieces(spark, docs, parts=3, **kw):
    df = spark.createDataFrame([(i, t, 1) for i, t in docs], "doc_id long, text string, offset int").repartition(parts)
    return packing.pack(df, public_tokenizers.path("word_bpe_49k.json"), **kw).collect()


@pytest.mark.parametrize("capacity", [4096, 64, 8])
def test_every_id_lies_in_one_piece_and_nothing_is_padded(spark, capacity):
    docs = list(enumerate(ODD))
    rows = pieces(spark, docs, capacity=capacity, pool=8, keep_ids=True)
    of_doc, of_sequence = defaultdict(list), defaultdict(list)
    for r in rows:
        of_doc[r.doc_id].append(r)
        of_sequence[r.sequence_id].append(r)
    for doc_id, text in docs:
        ids = ids_of(text)
        own = sorted(of_doc[doc_id], key=lambda r: r.start)
        assert [r.start for r in own] == [sum(q.length for q in own[:k]) for k in range(len(own))]
        assert [i for r in own for i in r.ids] == ids and {r.doc_tokens for r in own} == {len(ids)}
        assert all(r.ids_crc32 == zlib.crc32(struct.pack(f"<{r.length}I", *ids[r.start : r.start + r.length])) for r in own)
    for own in of_sequence.values():
        own.sort(key=lambda r: r.offset)
        assert [r.offset for r in own] == [sum(q.length for q in own[:k]) for k in range(len(own))]
        total = sum(r.length for r in own)
        assert total <= capacity and total & (total - 1) == 0


def test_repeats_null_ids_and_long_texts(spark, monkeypatch):
    docs = [(None, "a b"), (None, "a b"), (3, "c d e"), (3, "c d e"), (3, None)]
    rows = pieces(spark, docs, parts=1)
    assert sum(r.length for r in rows) == sum(len(ids_of(t)) for _, t in docs)
    assert sum(r.length for r in rows if r.doc_id is None) == 2 * len(ids_of("a b"))
    monkeypatch.setattr(packing, "PIECE", 50)
    text = "Some words, of 12 kinds. " * 40
    packer = packing.Packer(0, 64)
    known = packing.WordIds(public_tokenizers.path("word_bpe_49k.json"))
    packer.add(1, [found for piece in packing.text_pieces(text.encode(), 50) for found in known.encode([known.words(piece)])] + [(2).to_bytes(4, "little")])
    packer.finish()
    assert sum(p[2] for p in packer.pieces) == len(ids_of(text)) == packer.pieces[0][0][1]
    assert pieces(spark, [], parts=1) == []


def test_the_fullest_window_against_all_subsets():
    draw = random.Random(4)
    for _ in range(200):
        capacity = draw.randrange(1, 60)
        items = [draw.randrange(1, 70) for _ in range(draw.randrange(0, 9))]
        counts = {n: items.count(n) for n in items}
        chosen = packing.fullest(sorted(counts), counts, capacity)
        assert all(k <= counts[n] for n, k in chosen)
        best = max(s for r in range(len(items) + 1) for c in itertools.combinations(items, r) if (s := sum(c)) <= capacity)
        assert sum(n * k for n, k in chosen) == best


def test_documents_are_cut_only_where_no_subset_fills_the_window():
    packer = packing.Packer(0, 16, pool=16)
    for doc_id, n in enumerate([10, 6, 9, 7, 5, 5, 6, 11, 3]):
        packer.add(doc_id, [bytes(4 * n)])
    packer.finish()
    assert sum(p[2] for p in packer.pieces) == 62
    assert len(packer.pieces) <= 9 + 4  # three whole windows and 14 = 8 + 4 + 2
