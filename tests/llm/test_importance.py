"""op11: the draw against a plain version, ties, repeats, nulls, runs and ranges of any size."""

import hashlib
import math
import random
import re
import zlib

import pytest

from screenspark.llm import importance

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def plain(docs, target, percent=10, min_words=20, buckets=10_000, most=1):
    def features(text):
        words = WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
        return len(words), [zlib.crc32(" ".join(words[i : i + n]).encode()) % buckets for n in range(1, most + 1) for i in range(len(words) - n + 1)]

    s, t = [0] * buckets, [0] * buckets
    for counts, texts in ((s, [x for _, x in docs]), (t, target)):
        for text in texts:
            for b in features(text)[1]:
                counts[b] += 1
    gain = [math.floor(1000 * math.log((y + 1) * (sum(s) + buckets) / ((x + 1) * (sum(t) + buckets)))) for x, y in zip(s, t, strict=True)]
    rows = []
    for doc_id, text in docs:
        n_words, found = features(text)
        h = int(hashlib.sha256(f"2024:{'null' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
        weight = sum(gain[b] for b in found)
        rows.append([doc_id, len(found), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 2**32))), n_words])
    able = sorted((r for r in rows if r[4] >= min_words), key=lambda r: (-r[3], r[0] is None, r[0] or 0, r[1]))
    ranks = {id(r): k + 1 for k, r in enumerate(able[: percent * len(able) // 100])}
    return sorted(((*r[:4], ranks.get(id(r))) for r in rows), key=str)


def corpus(seed=5, n=150):
    draw = random.Random(seed)
    words = ["the", "Of", "straße", "x1", "日本", "and", "zoo", "é", "q" * 90]
    docs = [(i, " ".join(draw.choice(words) for _ in range(draw.randrange(0, 60)))) for i in range(n)]
    docs += [(7, docs[7][1])] * 30 + [(None, "a b c " * 12)] * 9 + [(None, "zoo and " * 30), (900, None), (901, ""), (902, "-- \t --"), (903, "ÀB" * 40_000)]
    return docs, ["the zoo and the straße", None, "x1 x1 日本"]


def spark_rows(spark, docs, target, parts=3, **kw):
    df = spark.createDataFrame([(i, t, 1, 2, 3) for i, t in docs], "doc_id long, text string, score int, rank int, run int").repartition(parts)
    found = importance.resample(df, spark.createDataFrame([(t,) for t in target], "text string"), **kw)
    assert found.columns == ["doc_id", "n_features", "weight", "score", "rank"]
    return sorted((tuple(r) for r in found.collect()), key=str)


@pytest.mark.parametrize("sizes", [{}, {"range_rows": 9, "block_rows": 3}, {"range_rows": 40, "block_rows": 1}, {"percent": 73, "range_rows": 25, "block_rows": 7}, {"percent": 100, "min_words": 0}])
def test_draw_equals_the_plain_version(spark, sizes):
    docs, target = corpus()
    own = {k: v for k, v in sizes.items() if k in ("percent", "min_words")}
    assert spark_rows(spark, docs, target, **sizes) == plain(docs, target, **own)


def test_runs_of_words_and_pieces_of_texts(spark, monkeypatch):
    docs, target = corpus(6, 60)
    assert spark_rows(spark, docs, target, most=3, buckets=97) == plain(docs, target, most=3, buckets=97)
    known = importance.Buckets(97)
    raw = docs[3][1].encode()
    whole = sorted(b for _, found in importance.feature_buckets(raw, known, 3) for b in found.tolist())
    monkeypatch.setattr(importance, "PIECE", 11)
    assert sorted(b for _, found in importance.feature_buckets(raw, known, 3) for b in found.tolist()) == whole


def test_no_rows_and_no_target(spark):
    docs, target = corpus(7, 40)
    assert spark_rows(spark, docs, []) == plain(docs, [])
    assert spark_rows(spark, [], target) == []
    few = [(1, "a " * 30), (2, None)]
    assert spark_rows(spark, few, target) == plain(few, target)  # a tenth of one document is none


def test_merge_holds_one_block_of_a_run_at_most():
    draw = random.Random(3)
    runs = [sorted((draw.randrange(500), k, i) for i in range(draw.randrange(1, 60))) for k in range(9)]
    blocks = sorted((run[i : i + 4] for run in runs for i in range(0, len(run), 4)), key=lambda b: b[0])
    assert [key for key, _ in importance.merge_blocks((b[0], [(key, 1) for key in b]) for b in blocks)] == sorted(x for run in runs for x in run)
    tree = importance.Tournament()
    for b in blocks:
        while tree.first() is not None and tree.first() < b[0]:
            tree.pop()
        tree.add(b)
        assert tree.size - len(tree.free) <= len(runs)


def test_a_merge_stops_at_the_draw_count():
    seen = []

    def blocks():
        for i in range(100):
            seen.append(i)
            yield (-100 + i, False, i, 1, 1), [((-100 + i, False, i, 1, 1), 2)]

    rows = list(importance.ranked_rows(blocks(), 10, 15))
    assert [r[4:] for r in rows] == [(11, 2, 2), (13, 2, 2), (15, 2, 1)] and len(seen) <= 6
