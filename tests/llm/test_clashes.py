"""Hash collisions, seams of long texts, and columns whose names operators use themselves."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from screenspark.llm import exact_dedup, media, mixing, quality, warc
from screenspark.llm.shingles import shingle_sets, span_hashes


def test_thue_morse_words_have_hashes_of_their_own():
    bits = [bin(k).count("1") & 1 for k in range(1024)]
    one, two = ("".join("ab"[b ^ flip] for b in bits).encode() for flip in (0, 1))
    assert [s.tolist() for s in shingle_sets([one])] != [s.tolist() for s in shingle_sets([two])]
    codes = np.frombuffer(one + two, dtype=np.uint8)
    a, b = span_hashes(codes, np.array([0, 1024]), np.array([1024, 2048]))
    assert a != b


@pytest.mark.parametrize("text", ["x" * 300, "one two  two three " * 20, "ab " + "y" * 70 + " end", " " * 40 + "z" * 33 + " " * 31, "", "é\n" * 50])
def test_steps_of_long_texts_change_no_feature(text, monkeypatch):
    whole = np.sort(np.concatenate([np.zeros(0, dtype=np.int64), *quality.features(text)]))
    for step in (1, 7, 32, 64):
        monkeypatch.setattr(quality, "STEP", step)
        assert (np.sort(np.concatenate([np.zeros(0, dtype=np.int64), *quality.features(text)])) == whole).all()


def test_columns_named_like_those_of_the_operators(spark):
    rows = [(1, "same text", "s", 7), (2, "same  text", "s", 8), (2, "other", "t", 9), (None, "other", None, 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, copies long")
    for name in ("kept_id", "kept_sha", "own_sha", "passes", "block", "block_place", "copy", "key", "whole", "blocks", "last_place", "last_block", "last_doc", "Block"):
        docs = docs.withColumn(name, F.col("copies")) if name != "Block" else docs
    kept = exact_dedup.drop_exact_duplicates(docs)
    assert kept.columns == docs.columns
    assert sorted((r.doc_id, r.text, r.copies, r.kept_id, r.own_sha) for r in kept.collect()) == [(1, "same text", 7, 7, 7), (2, "other", 9, 9, 9)]
    mixed = mixing.mix(docs, mixing.mixing_plan(docs))
    assert mixed.columns == docs.columns
    assert {tuple(r) for r in mixed.collect()} == {tuple(r) for r in docs.collect()}


def test_probe_reads_the_video_track_where_another_track_is_first():
    payload = bytes(range(192)) * 40
    file = media.mux(payload)
    head = file.index(b"moov") - 4
    size = int.from_bytes(file[head : head + 4], "big")
    at = file.index(b"trak", head) - 4
    track = file[at : at + int.from_bytes(file[at : at + 4], "big")]
    sound = track.replace(b"vide", b"soun").replace(b"raw ", b"mp4a")
    both = file[:at] + sound + file[at:]
    both = both[:head] + (size + len(sound)).to_bytes(4, "big") + both[head + 4 :]
    info = media.probe(both)
    assert info["codec"] == "raw " and len(info["sizes"]) == 40
    with pytest.raises(ValueError):
        media.probe(file.replace(b"vide", b"soun"))


def test_repeated_payloads_beyond_the_broadcast_bound(spark, monkeypatch):
    monkeypatch.setattr(warc, "FEW_ROWS", 1)
    monkeypatch.setattr(warc, "HOT_ROWS", 3)
    rows = [(i, f"http://a.b/{i}", "one") for i in range(5, 0, -1)] + [(8, "u", "two"), (7, "u", "two"), (9, None, "own"), (None, "v", None), (None, "v", "")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = {(r.page_id, r.record_type, r.refers_to) for r in warc.archive_pages(pages).collect()}
    assert got == {(1, "response", None), *((i, "revisit", 1) for i in range(2, 6)), (7, "response", None), (8, "revisit", 7), (9, "response", None), (None, "response", None)}
