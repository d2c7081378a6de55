"""The pipeline's rows against plain second implementations of its filtering stages."""

import re

import corpus_pipeline
import public_tokenizers
import pyarrow as pa
from screenspark.llm import bpe, common, jaccard, quality

SF = "/root/testdata/sf0.001"


def shingles(text: str) -> frozenset:
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return frozenset(tuple(words[k : k + 5]) for k in range(max(1, len(words) - 4))) if words else frozenset()


def test_one_document_of_each_group_of_accepted_ones(spark):
    docs, labels = (spark.read.parquet(f"{SF}/{n}.parquet") for n in ("documents", "labels"))
    accepted = {r.doc_id for r in quality.classify_quality(docs, labels).filter("predicted = 1").select("doc_id").collect()}
    texts = {r.doc_id: r.text for r in docs.select("doc_id", "text").collect() if r.doc_id in accepted}
    first = {}
    for k in sorted(texts):
        first.setdefault(re.sub(r"[\x20\x09-\x0D]+", " ", texts[k] or ""), k)
    sets = {k: shingles(texts[k]) for k in first.values()}
    group = {k: k for k in sets}

    def root(k):
        while group[k] != k:
            k = group[k]
        return k

    ids = sorted(sets)
    for n, a in enumerate(ids):
        for b in ids[n + 1 :]:
            both = len(sets[a] & sets[b])
            if both and 100 * both >= 75 * (len(sets[a]) + len(sets[b]) - both):
                x, y = sorted((root(a), root(b)))
                group[y] = x
    found = {r.doc_id for r in corpus_pipeline.run(spark, SF).select("doc_id").collect()}
    assert found <= set(ids)
    assert len({root(k) for k in found}) == len(found)
    assert {root(k) for k in found} == {root(k) for k in ids}


def test_near_copies_go_by_row_where_ids_repeat_or_are_null(spark):
    base = " ".join(f"w{k}" for k in range(60))
    lone = " ".join(f"v{k}" for k in range(60))
    other, third = (" ".join(f"{c}{k}" for k in range(60)) for c in "uq")
    rows = [
        (1, base), (2, base + " x"), (2, lone),  # id 2: a copy that goes and a text of its own
        (5, other), (5, other + " y"),  # both hold the smallest id of their group
        (None, third), (None, third + " z"), (None, "short of its own"),
        (7, "Twice the same row"), (7, "Twice the same row"),
        (8, ""), (8, None),
    ]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long").repartition(3)
    kept = [(r.doc_id, (r.text or "").split(" ")[0]) for r in corpus_pipeline.drop_near_copies(spark, docs, SF).collect()]
    assert sorted(kept, key=str) == sorted([(1, "w0"), (2, "v0"), (5, "u0"), (None, "q0"), (None, "short"), (7, "Twice"), (8, ""), (8, "")], key=str)


def test_whole_texts_reach_python_in_small_batches(spark, monkeypatch):
    docs = spark.range(3000, numPartitions=1).selectExpr("id as doc_id", "concat('text ', id) as text")

    def batch_sizes(docs, path, **_):
        def run(batches):
            for b in batches:
                yield pa.record_batch([b.column("doc_id"), pa.array([b.num_rows] * b.num_rows, pa.int64()), b.column("text"), b.column("text")], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

        return docs.mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")

    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    monkeypatch.setattr(bpe, "token_digests", batch_sizes)
    sizes = [r.n_tokens for r in corpus_pipeline.encode(spark, docs, SF).collect()]
    assert len(sizes) == 3000 and max(sizes) <= common.BATCH_ROWS
    seen, links = [], jaccard.jaccard_links
    monkeypatch.setattr(jaccard, "jaccard_links", lambda docs, *a, **k: seen.append(int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch"))) or links(docs, *a, **k))
    assert jaccard.jaccard_rows(docs).count() == 3000
    assert seen == [common.BATCH_ROWS]
    assert spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch") == before


def test_a_worker_remembers_few_of_many_different_words(monkeypatch):
    class Rows:
        def mapInArrow(self, run, schema):
            return run

    known, many = [], bpe._Memory.many

    def counted(self, texts):
        out = many(self, texts)
        known.append(len(self.young) + len(self.old))
        return out

    monkeypatch.setattr(bpe, "documents", lambda docs, *a: docs)
    monkeypatch.setattr(bpe._Memory, "many", counted)
    texts = [" ".join(f"{c}{chr(97 + k % 26)}{chr(97 + k // 26 % 26)}{chr(97 + k // 676)}" for k in range(17_000)) for c in ("q", "w", "x", "z", "bb", "cc", "dd", "ee", "ff", "gg", "hh", "ii", "jj", "kk", "mm", "nn")]
    batch = pa.record_batch([pa.array(range(len(texts)), pa.int64()), pa.array(texts)], names=["doc_id", "text"])
    out = pa.Table.from_batches(bpe.token_digests(Rows(), public_tokenizers.path("byte_bpe_50k.json"))(iter([batch])))
    assert out.column("round_trip").to_pylist() == [True] * len(texts)
    assert max(known) < 210_000
