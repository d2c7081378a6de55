import math

import pytest

from screenspark.llm import mixing


def corpus(spark, sizes):
    rows = [(1000 * k + i, " ".join(["w"] * (5 + i % 7)), source) for k, (source, n) in enumerate(sizes.items()) for i in range(n)]
    return spark.createDataFrame(rows, "doc_id long, text string, source string")


def test_repeat_limit_is_met_and_nothing_is_left_out(spark):
    docs = corpus(spark, {"a": 600, "b": 60, "c": 9})
    plan = mixing.mixing_plan(docs, repeat_limit=2.0, block_tokens=50)
    passes = {r.key: r.passes for r in plan.collect()}
    assert passes["s:a"] == pytest.approx(1) and passes["s:c"] == pytest.approx(2, abs=1e-6)
    mixed = mixing.mix(docs, plan)
    assert mixed.columns == docs.columns
    tokens = {r.source: r.n for r in mixed.selectExpr("source", "size(split(text, ' ')) n").groupBy("source").sum("n").toDF("source", "n").collect()}
    for row in plan.collect():
        want = row.passes * row.tokens
        assert want - 12 <= tokens[row.key[2:]] <= want
    assert mixed.select("doc_id").distinct().count() == docs.count()


def test_target_entropy(spark):
    docs = corpus(spark, {"a": 500, "b": 50, "c": 5})
    plan = mixing.mixing_plan(docs, repeat_limit=None, target_entropy=0.9, budget=10_000.0)
    assert -sum(r.weight * math.log(r.weight) for r in plan.collect()) == pytest.approx(0.9, abs=1e-6)


def test_nulls_repeats_empty(spark):
    docs = spark.createDataFrame([(1, None, None), (None, "a b", None), (2, "", "x"), (3, "a b c", "y"), (3, "a b c", "y")], "doc_id long, text string, source string")
    plan = mixing.mixing_plan(docs)
    assert mixing.mix(docs, plan).select("doc_id").distinct().count() == 4
    none = docs.limit(0)
    assert mixing.mix(none, mixing.mixing_plan(none)).collect() == []
