"""Held-out accuracy and odd rows of the fitted operators (op1, op5, op10)."""

import itertools

import numpy as np
import pytest
from pyspark.sql import functions as F

from screenspark.llm import html_text, language, quality

SF = "/root/testdata/sf0.01"
ODD = [None, "", "  \n ", "12345 !?", "word " * 20000, "same text here", "same text here"]


def odd(spark, texts):
    return spark.createDataFrame([(i, t, "en", "x") for i, t in enumerate(texts)], "doc_id long, text string, lang string, score string")


def test_language_on_rows_not_learned_from(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    model = language.fit_language(docs)
    got = language.language_spans(docs, model).join(docs.select("doc_id", "lang"), "doc_id").filter(language.held_out(F.col("doc_id")) & F.col("lang").isNotNull())
    right, n = got.agg(F.count_if(F.col("lang_pred") == F.col("lang")), F.count("*")).first()
    assert n > 100 and right / n > 0.95
    rows = {r.doc_id: r for r in language.language_spans(odd(spark, ODD), model).collect()}
    assert len(rows) == len(ODD)
    assert [rows[k].lang_pred for k in range(4)] == ["und"] * 4
    assert all(0 <= r.score <= 1 for r in rows.values())
    assert rows[5].lang_pred == rows[6].lang_pred and rows[5].score == rows[6].score
    assert language.language_spans(odd(spark, []), model).count() == 0


def test_quality_on_rows_not_learned_from(spark):
    docs, labels = (spark.read.parquet(f"{SF}/{n}.parquet") for n in ("documents", "labels"))
    model = quality.fit_quality(docs, labels)
    got = quality.score_quality(docs, *model).join(labels, "doc_id").filter(quality.held_out(F.col("doc_id")))
    right, n = got.agg(F.count_if((F.col("score") >= 0.7) == (F.col("quality") == 1)), F.count("*")).first()
    assert n > 50 and right / n > 0.9
    rows = {r.doc_id: r.score for r in quality.score_quality(odd(spark, ODD), *model).collect()}
    assert len(rows) == len(ODD) and all(0 <= s <= 1 for s in rows.values())
    assert rows[0] == rows[1] and rows[5] == rows[6]
    assert quality.score_quality(odd(spark, []), *model).count() == 0
    kept = quality.keep_accepted(odd(spark, ODD), *model)
    assert kept.columns == ["doc_id", "text", "lang", "score"]
    assert sorted(r.doc_id for r in kept.collect()) == sorted(k for k, s in rows.items() if s >= quality.ACCEPT)


def test_main_text_of_plain_and_odd_pages(spark):
    model = html_text.train()
    body = "The river rose slowly during the night and the people of the valley moved their cattle to higher ground before dawn."
    page = f"<html><head><style>p {{}}</style><script>var a = '<p>no</p>';</script></head><body><nav><ul><li><a href='/'>Home</a></li><li><a href='/x'>News</a></li></ul></nav><article><h1>Flood in the valley</h1><p>{body} &amp;  more</p><p>{body}</p></article><footer><p>Copyright 2020 Example</p></footer></body></html>"
    htmls = [page, None, "", "no markup", "<p", page]
    pages = spark.createDataFrame([(i, f"u{i}", h, "x") for i, h in enumerate(htmls)], "page_id long, url string, html string, text string")
    rows = {r.page_id: r for r in html_text.extract_text(pages, model).collect()}
    assert len(rows) == len(htmls)
    assert f"{body} & more\n\n{body}" in rows[0].text
    assert not any(w in rows[0].text for w in ("Home", "Copyright", "var a"))
    assert rows[0].text == rows[5].text
    assert rows[1].text == rows[2].text == "" and rows[1].n_chars == 0
    assert all(r.n_chars == len(r.text) for r in rows.values())
    assert html_text.extract_text(pages.limit(0), model).count() == 0


ALL_ONES = (1 << 64) - 1


def plain_mix(h: int) -> int:
    h ^= h >> 30
    h = h * 0xBF58476D1CE4E5B9 & ALL_ONES
    h ^= h >> 27
    h = h * 0x94D049BB133111EB & ALL_ONES
    return h ^ h >> 31


def plain_features(text: str, bits: int) -> list[int]:
    """Buckets of n-grams, words and word pairs of a text, one by one."""
    out, numbers = [], [ord(c) + 1 for c in text]
    for i in range(len(numbers)):
        h = numbers[i]
        for k in range(2, 6):
            if i + k > len(numbers):
                break
            h = (h * int(quality._MIX) + numbers[i + k - 1]) & ALL_ONES
            if k >= 3:
                out.append(plain_mix((h + k) & ALL_ONES) >> 64 - bits)
    words = "".join(" " if quality._WHITE[ord(c)] else c for c in text).split(" ")
    hashes = [sum(plain_mix(ord(c) + 1 + (place << 21)) for place, c in enumerate(w)) & ALL_ONES for w in words if w]
    out += [plain_mix(h) >> 64 - bits for h in hashes]
    for a, b in zip(hashes, hashes[1:]):
        out.append((int(quality._REPEAT) if a == b else plain_mix((a * int(quality._MIX) + b) & ALL_ONES)) >> 64 - bits)
    return out


def test_quality_scores_equal_a_loop_over_features(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.001/{n}.parquet") for n in ("documents", "labels"))
    rows = [(r.text, r.quality) for r in docs.join(labels, "doc_id").orderBy("doc_id").limit(60).collect() if r.text]
    model = quality.SubwordModel(bits=12, dimensions=5).fit([t for t, _ in rows], [y for _, y in rows], epochs=1)
    weights, bias = model.folded()
    for text in ["", "a", "ab cd", "no no no", "Grüße 𝔘　x \u0085y", rows[0][0][:700], rows[1][0][:700]]:
        found = plain_features(text, 12)
        assert sorted(found) == sorted(int(b) for x in quality.features(text, 12) for b in x)
        hidden = np.mean([model.vectors[b].astype(np.float64) for b in found], axis=0) if found else np.zeros(5)
        logits = model.layer @ hidden + model.bias
        share = np.exp(logits - logits.max())
        assert quality.score(text, weights, bias) == pytest.approx(float(share[1] / share.sum()), abs=1e-5)


def test_language_labels_are_the_best_of_all_sequences():
    draw = np.random.default_rng(9)
    counts = np.array([4, 1, 0, 6, 3])
    scores = draw.normal(scale=3, size=(counts.sum(), 3))
    found, at = language.viterbi(scores, counts, switch=2.0), 0
    for n in counts.tolist():
        own = scores[at : at + n]

        def worth(labels, own=own):
            return sum(own[t, k] for t, k in enumerate(labels)) - 2.0 * sum(a != b for a, b in zip(labels, labels[1:]))

        best = max(map(worth, itertools.product(range(3), repeat=n)))
        assert abs(worth(found[at : at + n].tolist()) - best) < 1e-9
        at += n


def test_language_word_scores_equal_a_loop(spark):
    rows = [("der hund und die katze", "de"), ("the dog and the cat", "en"), ("le chien et le chat", "fr"), ("Ein Haus", "de")]
    model = language.LanguageModel.fit(rows)
    for text, lang in rows:
        found, share, spans = language.label([text], model)
        assert found == [lang] and 0.5 < share[0] <= 1
        assert "".join(text[s["start"] : s["end"]] for s in spans[0].as_py())
    both = "der hund und die katze und der hund the dog and the cat and the dog"
    spans = language.label([both], model)[2][0].as_py()
    assert [s["lang"] for s in spans] == ["de", "en"] and both[spans[1]["start"] :].startswith("the dog")
