import hashlib
import random
import re

from screenspark.llm.pii import find_pii, fit_spans, reliabilities

PLAIN = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(digits):
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = int(c) * (1 + k % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def base_spans(text):
    out = []
    for k, (kind, pattern) in enumerate(PLAIN.items()):
        for m in re.finditer(pattern, text or ""):
            digits = re.sub("[^0-9]", "", m[0])
            ok = kind == "email"
            if kind == "ip":
                ok = all(int(p) <= 255 for p in m[0].split("."))
            elif kind == "card":
                ok = 12 <= len(digits) <= 19 and luhn(digits)
            elif kind == "phone":
                ok = 9 <= len(digits) <= 15
            if ok:
                out.append((m.start(), k, m.end(), kind))
    return sorted(out)


def check(spark, rows):
    docs = spark.createDataFrame(rows, "doc_id long, text string, spans int")
    got = sorted((tuple(r) for r in find_pii(docs).collect()), key=str)
    want = []
    for doc_id, text, _ in rows:
        spans = base_spans(text)
        line = ",".join(f"{kind}:{a}:{b}" for a, _, b, kind in spans)
        want.append((doc_id, *(sum(s[1] == k for s in spans) for k in range(4)), hashlib.sha256(line.encode()).hexdigest()))
    assert sorted((r[:6] for r in got), key=str) == sorted(want, key=str)
    return {r[0]: r[6] for r in got}


def test_base_spans_equal_the_plain_patterns(spark):
    rng = random.Random(5)
    pieces = ["a@b.c", "x@y", "@", "a@b.c_d@e.f", ".", "1", "23", "256.1.1.1", "10.0.0.255", "1.2.3.4.5", "+", "+1 (310) 555-4510", "4111 1111 1111 1111", "4111-1111-1111-1112", " ", "-", "é", "😀", "\n", "000000000000", "(", "%%%", "b.c", "999999999999999999999.1.1.1", "0001.02.3.4"]
    rows = [(i, "".join(rng.choice(pieces) for _ in range(rng.randint(0, 25))), i) for i in range(400)]
    check(spark, rows)


def test_edge_rows_and_long_runs(spark):
    rows = [(1, None, 0), (2, "", None), (None, "mail a@b.org", 1), (7, "a@b.org", 1), (7, "a@b.org", 1)]
    spans = check(spark, rows)
    assert spans[2] == "" and spans[7] == "email:0:7"


def test_long_runs_are_read_whole(spark):
    texts = ["a" * 100_000 + "@", "1" * 100_000, "x@" + "b." * 20_000 + "c", "1 " * 20_000, "1." * 20_000]
    got = {r.doc_id: r for r in find_pii(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    assert [got[i].n_email for i in range(5)] == [0, 0, 1, 0, 0] and got[2].spans == "email:0:40003"
    assert got[3].n_card == 0 and got[4].n_ip == 5_000


def test_empty_table(spark):
    assert find_pii(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_added_spans_do_not_replace_base_ones(spark):
    rows = [(i, f"write a mail to user{i}@mail.org or tel +49 30 5550{i:03d}1", 0) for i in range(60)]
    rows += [(100, 'token = "24be64439e3e49cf46b2d7c90f3602a3d0b907ff"', 0)]
    spans = check(spark, rows)
    assert all(s.count("email:") >= 1 for i, s in spans.items() if i < 60)


def test_em_finds_the_reliable_labeler():
    counts = [(0, (1, 1, None, 1), 80), (0, (0, 0, None, 1), 80), (0, (1, 1, None, 0), 20), (0, (0, 0, None, 0), 20)]
    chance, posterior = reliabilities(counts)
    assert chance[0, 1, 1] > 0.9 and chance[0, 1, 0] < 0.1 and abs(chance[3, 1, 1] - 0.8) < 0.1
    assert posterior[0, (1, 1, None, 0)] > 0.5 > posterior[0, (0, 0, None, 1)]
    weights = fit_spans([(k, v, 0, n) for k, v, n in counts])
    assert weights["v0=1"] > 0 > weights["v0=0"]
