import random

import pytest

from screenspark.llm import common, components
from screenspark.llm.components import connected_components, join_components
from screenspark.llm.jaccard import jaccard_components, may_link


def brute(rows):
    """Components of (doc_id, text) by comparing all pairs."""
    sets = []
    for _, text in rows:
        words = (text or "").encode().lower().split()
        sets.append({tuple(words[i : i + 5]) for i in range(len(words) - 4)} if len(words) >= 5 else {tuple(words)} if words else set())
    up = list(range(len(rows)))

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and 100 * len(sets[i] & sets[j]) >= 75 * len(sets[i] | sets[j]) and sets[j]:
                up[root(i)] = root(j)
    least = {}
    for i, (doc_id, _) in enumerate(rows):
        least.setdefault(root(i), []).append(doc_id)
    return sorted(((d, len(sets[i]), min((x for x in least[root(i)] if x is not None), default=None) if sets[i] else d) for i, (d, _) in enumerate(rows)), key=str)


def corpus(seed, families, copies, edit):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdef") for _ in range(3))
    line = " ".join(word() for _ in range(30))
    texts = []
    for f in range(families):
        base = [word() for _ in range(rng.choice((20, 60, 120)))]
        for _ in range(copies if f == 0 else rng.randint(1, 6)):
            own = list(base)
            for _ in range(rng.randint(0, edit)):
                own[rng.randrange(len(own))] = word()
            texts.append(" ".join(own) + ("\n" + line if rng.random() < 0.3 else ""))
    texts += ["", None, "   ", "one two", "One\ttwo", "a b c d e", "a b c d  e", "x"]
    rng.shuffle(texts)
    return list(enumerate(texts, start=5))


@pytest.mark.parametrize(("seed", "bounds"), [(1, {}), (2, {"small": 2, "block": 4, "sketch_bits": 8}), (3, {"small": 3, "block": 16, "sketch_bits": 12})])
def test_same_components_as_all_pairs(spark, seed, bounds):
    rows = corpus(seed, 25, 60, 5)
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    got = sorted(map(tuple, jaccard_components(docs, **bounds).collect()), key=str)
    assert got == brute(rows)


def test_nulls_repeats_extra_columns(spark):
    text = "the quick brown fox jumps over the lazy dog"
    rows = [(3, text, "x"), (3, text, None), (None, text.upper(), "y"), (None, None, None), (9, "other words that are here only now", "z")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, component_id string")
    got = sorted(map(tuple, jaccard_components(docs).collect()), key=str)
    assert got == sorted([(3, 5, 3), (3, 5, 3), (None, 5, 3), (None, 0, None), (9, 3, 9)], key=str)


def test_empty_table(spark):
    assert jaccard_components(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_bound_never_excludes_a_link():
    assert may_link(0, 10, 10) and may_link(2, 7, 7) and not may_link(4, 7, 7) and not may_link(0, 10, 20)


@pytest.mark.parametrize("few", [0, 100_000])
def test_components_of_a_chain(spark, monkeypatch, few):
    monkeypatch.setattr(components, "FEW_ROWS", few)
    monkeypatch.setattr(common, "FEW_ROWS", few)
    monkeypatch.setattr(common, "HOT_ROWS", 5)
    edges = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 99), (99, 99)], "a long, b long")
    got = dict(map(tuple, connected_components(edges).collect()))
    assert got == {**dict.fromkeys(range(41), 0), 99: 99, 100: 99}


def test_components_of_a_long_shuffled_chain(spark):
    chain = list(range(1000))
    random.Random(4).shuffle(chain)
    edges = spark.createDataFrame(list(zip(chain, chain[1:])) + [(5000, 5001)], "a long, b long").repartition(4)
    got = dict(map(tuple, connected_components(edges).collect()))
    assert got == {**dict.fromkeys(range(1000), 0), 5000: 5000, 5001: 5000}


@pytest.mark.parametrize("few", [0, 100_000])
def test_components_grown_by_edges(spark, monkeypatch, few):
    for module, name, value in ((components, "FEW_ROWS", few), (common, "FEW_ROWS", few), (common, "HOT_ROWS", 5)):
        monkeypatch.setattr(module, name, value)
    rng = random.Random(6)
    edges = [(rng.randrange(60), rng.randrange(60)) for _ in range(45)]
    table = lambda part: spark.createDataFrame(part, "a long, b long")
    grown = join_components(connected_components(table(edges[:25])), table(edges[25:]))
    got = sorted(map(tuple, grown.collect()))
    assert got == sorted(map(tuple, connected_components(table(edges)).collect()))
