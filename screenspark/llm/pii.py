"""Personal data by weak supervision, in DataFrame and SQL functions only.

*Base* spans are the matches of four fixed patterns that pass their checks; they always stay.
*Candidates* are the base matches and the matches of looser patterns (written-out e-mail
addresses, phone numbers without country code, assigned secrets).  Four labelers vote on each
candidate: for, against, or not at all:

- ``regex``: the strict form and its checksum,
- ``gazetteer``: top-level domains, private address ranges, card issuer digits, area codes,
- ``context``: words of four languages just before or after the span,
- ``shape``: lengths, separators and repeated digits.

Expectation-maximisation over the counts of vote patterns (3**4 a kind, whatever the corpus)
estimates each labeler's reliability per class; the posteriors train a logistic span
classifier on votes, kind and length, again over counts of distinct feature rows.  Candidates
with a share of at least ``ACCEPT`` that overlap no base span of their kind are added.

Offsets come from the lengths of the pieces between matches, so they are code points, and
texts are read once per pattern without leaving the JVM; only spans are shuffled.  Patterns are
written possessively and with look-behind, which leaves their matches as they are but makes
long runs cost linear time and no stack.

Defined results: null text is empty and has no spans; rows with null or repeated ids are
rows of their own; an empty table gives an empty result; other columns are ignored; spans of several kinds that
begin at one place are listed in the order of kinds; a long text is one row of the same expressions.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import documents, materialise

#: Kinds in the order of the output; fixed value.
KINDS = ["email", "ip", "card", "phone", "secret"]
#: The four base patterns; fixed values, with possessive loops.  A match that the plain pattern
#: finds begins at the start of a run of its first characters or where the last match ended.
BASE = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: Looser patterns, each with a cheap test that most texts fail; fixed values.
LOOSE = {
    "email": (r"(?i)[\[(] ?at ?[\])]", r"(?i)(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++ ?[\[(] ?at ?[\])] ?[A-Za-z0-9-]++(?: ?(?:[\[(] ?dot ?[\])]|\.) ?[A-Za-z0-9-]++)++"),
    "phone": (r"[0-9]{3}\)?[ .-][0-9]{3}[ .-][0-9]{4}", r"(?<![0-9+.(-])\(?[0-9]{3}\)?[ .-][0-9]{3}[ .-][0-9]{4}(?![0-9])"),
    "secret": (r"(?i)(?:token|secret|key|password)", r"(?i)(?:token|secret|api_?key|password)[\"']? ?[=:] ?[\"']?[A-Za-z0-9_\-]{12,}+"),
}
#: Word lists of the labelers; fixed values.
TOP_DOMAINS = "com org net edu gov info io de fr es uk eu ch at be nl it us ca"
CONTEXT = {
    "email": "mail e-mail contact kontakt contacto correo courriel write schreiben",
    "ip": "ip host server address adresse dirección serveur addr",
    "card": "card visa karte carte tarjeta credit payment zahlung paiement pago",
    "phone": "tel phone call telefon téléphone teléfono mobile handy fax",
    "secret": "token secret key password passwort clave",
}
ACCEPT = 0.5
EM_STEPS = 50
FIT_STEPS = 300
_BYTE = r"^0*(?:[0-9]|[1-9][0-9]|1[0-9][0-9]|2[0-4][0-9]|25[0-5])$"
_SPAN = "array<struct<kind:int,base:boolean,i:int,gap:int,pre:string,hit:string,post:string>>"


def _pieces(text: Column, kind: str, pattern: str, base: bool) -> Column:
    """Matches of a pattern with the length of the piece before each and a little context."""
    hits = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    gaps = F.split(text, pattern, -1)
    return F.transform(
        hits,
        lambda hit, i: F.struct(
            F.lit(KINDS.index(kind)).alias("kind"),
            F.lit(base).alias("base"),
            i.alias("i"),
            F.length(F.get(gaps, i)).alias("gap"),
            F.right(F.get(gaps, i), F.lit(24)).alias("pre"),
            hit.alias("hit"),
            F.left(F.get(gaps, i + 1), F.lit(12)).alias("post"),
        ),
    ).cast(_SPAN)


def _candidates(text: Column) -> Column:
    none = F.array().cast(_SPAN)
    gate = {"email": text.contains("@"), "ip": text.rlike(r"[0-9]\.[0-9]++\.[0-9]"), "card": text.rlike(r"[0-9][\x20-]?[0-9]"), "phone": text.contains("+")}
    found = [F.when(gate[k], _pieces(text, k, p, True)).otherwise(none) for k, p in BASE.items()]
    found += [F.when(text.rlike(test), _pieces(text, k, p, False)).otherwise(none) for k, (test, p) in LOOSE.items()]
    return F.concat(*found)


def _luhn(digits: Column) -> Column:
    """Whether a string of at most 19 digits passes the Luhn check."""

    def worth(i: Column) -> Column:
        d = F.substr(digits, F.length(digits) - i + 1, F.lit(1)).cast("int")
        twice = d * 2
        return F.when(i % 2 == 1, d).otherwise(twice - F.when(twice > 9, 9).otherwise(0))

    total = F.aggregate(F.transform(F.sequence(F.lit(1), F.greatest(F.length(digits), F.lit(1))), worth), F.lit(0), lambda s, d: s + F.coalesce(d, F.lit(0)))
    return total % 10 == 0


def _valid() -> Column:
    """Whether a base match passes the check of its kind."""
    hit, digits = F.col("hit"), F.regexp_replace("hit", "[^0-9]", "")
    parts = F.split(hit, r"\.")
    return (
        F.when(F.col("kind") == 0, F.lit(True))
        .when(F.col("kind") == 1, F.forall(parts, lambda p: p.rlike(_BYTE)))
        .when(F.col("kind") == 2, F.length(digits).between(12, 19) & F.when(F.length(digits).between(12, 19), _luhn(digits)).otherwise(F.lit(False)))
        .when(F.col("kind") == 3, F.length(digits).between(9, 15))
        .otherwise(F.lit(False))
    )


def _words(words: str) -> str:
    return r"(?i)(?<!\p{L})(?:" + "|".join(words.split()) + r")(?!\p{L})"


def _votes() -> list[Column]:
    """One column a labeler: 1 for, 0 against, null for no vote."""
    kind, hit, digits = F.col("kind"), F.col("hit"), F.regexp_replace("hit", "[^0-9]", "")
    strict = F.when(F.col("base"), F.col("valid").cast("int")).when(kind == 3, F.lit(None).cast("int")).otherwise(F.lit(None).cast("int"))
    top = F.lower(F.regexp_extract(hit, r"([A-Za-z0-9-]+)$", 1))
    gazetteer = (
        F.when(kind == 0, top.isin(*TOP_DOMAINS.split()).cast("int"))
        .when(kind == 1, F.when(hit.rlike(r"^(?:0|10|127|192\.168|169\.254|255)\."), 0).otherwise(F.lit(None)))
        .when(kind == 2, digits.rlike(r"^[3-6]").cast("int"))
        .when(kind == 3, F.when(digits.rlike(r"^(?:1|3[0-9]|4[0-9])"), 1).otherwise(F.lit(None)))
        .otherwise(F.lit(None))
    ).cast("int")
    near = F.concat_ws(" ", "pre", "post")
    said = F.lit(False)
    for k, name in enumerate(KINDS):
        said = F.when(kind == k, near.rlike(_words(CONTEXT[name]))).otherwise(said)
    context = F.when(said, 1).otherwise(F.lit(None)).cast("int")
    same = digits.rlike(r"^([0-9])\1*$")
    shape = (
        F.when(kind == 0, F.length(hit).between(6, 80).cast("int"))
        .when(kind == 1, (F.length(hit) <= 15).cast("int"))
        .when(kind == 2, (F.length(digits).between(13, 19) & ~same).cast("int"))
        .when(kind == 3, (F.length(digits).between(9, 15) & ~same).cast("int"))
        .otherwise((F.length(hit) >= 20).cast("int"))
    )
    return [strict.alias("v0"), gazetteer.alias("v1"), context.alias("v2"), shape.alias("v3")]


VOTES = ("v0", "v1", "v2", "v3")


def candidate_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row per candidate (one with null ``kind`` for a text without any): offsets, check, votes, length class."""
    rows = documents(docs, id_col, text_col).withColumn("row", F.monotonically_increasing_id())
    rows = rows.select("row", "doc_id", F.explode_outer(_candidates(F.col("text"))).alias("s")).select("row", "doc_id", "s.*")
    rows = rows.withColumn("valid", F.when(F.col("base"), _valid()).otherwise(F.lit(False)))
    rows = rows.select("row", "doc_id", "kind", "base", "i", "gap", F.length("hit").alias("size"), "valid", *_votes())
    along = Window.partitionBy("row", "kind", "base").orderBy("i")
    end = F.sum(F.col("gap") + F.col("size")).over(along)
    length = F.when(F.col("size") < 12, 0).when(F.col("size") < 20, 1).otherwise(2)
    return rows.withColumn("end", end.cast("long")).select("row", "doc_id", "kind", "base", "valid", (F.col("end") - F.col("size")).alias("start"), "end", length.alias("length"), *VOTES)


def reliabilities(counts: list[tuple], steps: int = EM_STEPS) -> tuple[dict, dict]:
    """EM over ``(kind, votes, count)``: chance of each vote per class, and the posterior of each pattern.

    Classes start from the majority of votes; chances are smoothed by one vote each way.
    """
    posterior = {}
    for kind, votes, _ in counts:
        cast = [v for v in votes if v is not None]
        posterior[kind, votes] = 0.9 if sum(cast) * 2 > len(cast) else 0.1
    chance: dict = {}
    for _ in range(steps):
        prior, seen = {}, {}
        for kind, votes, n in counts:
            for y, share in ((1, posterior[kind, votes]), (0, 1 - posterior[kind, votes])):
                prior[kind, y] = prior.get((kind, y), 1.0) + n * share
                for j, v in enumerate(votes):
                    if v is not None:
                        seen[j, v, y] = seen.get((j, v, y), 1.0 + 2.0 * (v == y)) + n * share
        chance = {(j, v, y): s / (s + seen.get((j, 1 - v, y), 1.0 + 2.0 * (1 - v == y))) for (j, v, y), s in seen.items()}
        for kind, votes, _ in counts:
            odds = math.log(prior[kind, 1] / prior[kind, 0])
            for j, v in enumerate(votes):
                if v is not None:
                    odds += math.log(chance.get((j, v, 1), 0.5) / chance.get((j, v, 0), 0.5))
            posterior[kind, votes] = 1 / (1 + math.exp(-max(-30.0, min(30.0, odds))))
    return chance, posterior


def _features(kind: int, votes: tuple, length: int) -> list[str]:
    return ["bias", f"kind{kind}", f"length{length}"] + [f"{name}={v}" for name, v in zip(VOTES, votes, strict=True) if v is not None]


def fit_spans(counts: list[tuple], steps: int = FIT_STEPS) -> dict[str, float]:
    """Weights of the span classifier from ``(kind, votes, length, count)`` rows."""
    merged: dict = {}
    for kind, votes, _, n in counts:
        merged[kind, votes] = merged.get((kind, votes), 0) + n
    _, posterior = reliabilities([(*k, n) for k, n in sorted(merged.items(), key=str)])
    rows = [(_features(kind, votes, length), posterior[kind, votes], n) for kind, votes, length, n in counts]
    total = sum(n for *_, n in rows) or 1
    weights: dict[str, float] = {}
    for _ in range(steps):
        slope: dict[str, float] = {}
        for names, y, n in rows:
            wrong = (1 / (1 + math.exp(-sum(weights.get(f, 0.0) for f in names))) - y) * n / total
            for f in names:
                slope[f] = slope.get(f, 0.0) + wrong
        for f, g in slope.items():
            weights[f] = weights.get(f, 0.0) - 2.0 * (g + 1e-4 * weights.get(f, 0.0))
    return weights


def find_pii(docs: DataFrame, accept: float = ACCEPT, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id``, counts of base spans, ``base_sha256`` and all ``spans`` of every row."""
    found = materialise(candidate_spans(docs, id_col, text_col))
    # at most 5 kinds * 3**4 votes * 3 lengths rows come to the driver
    table = found.filter("kind is not null").groupBy("kind", *VOTES, "length").count().collect()
    weights = fit_spans(sorted(((r["kind"], tuple(r[v] for v in VOTES), r["length"], r["count"]) for r in table), key=str))
    odds = F.lit(weights.get("bias", 0.0))
    for name in KINDS:
        odds = odds + F.when(F.col("kind") == KINDS.index(name), F.lit(weights.get(f"kind{KINDS.index(name)}", 0.0))).otherwise(0.0)
    for k in range(3):
        odds = odds + F.when(F.col("length") == k, F.lit(weights.get(f"length{k}", 0.0))).otherwise(0.0)
    for name in VOTES:
        for v in (0, 1):
            odds = odds + F.when(F.col(name) == v, F.lit(weights.get(f"{name}={v}", 0.0))).otherwise(0.0)
    share = 1 / (1 + F.exp(-odds))
    # a rejected base match is a failing match and is not added again
    rows = found.withColumn("keep", F.col("valid") | (~F.col("base") & (share >= accept)))
    span = F.when(F.col("keep"), F.struct("start", "kind", "end", F.col("base").alias("base")))
    grouped = rows.groupBy("row", "doc_id").agg(F.sort_array(F.collect_list(span)).alias("all"))
    base = F.filter("all", lambda s: s["base"])
    overlaps = lambda s: F.exists(base, lambda b: (b["kind"] == s["kind"]) & (b["start"] < s["end"]) & (s["start"] < b["end"]))
    grouped = grouped.select("doc_id", base.alias("base"), F.filter("all", lambda s: s["base"] | ~overlaps(s)).alias("all"))
    names = F.array(*map(F.lit, KINDS))
    text = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ",")
    count = lambda k: F.size(F.filter("base", lambda s: s["kind"] == k)).cast("long")
    return grouped.select(
        "doc_id",
        *(count(k).alias(f"n_{name}") for k, name in enumerate(KINDS[:4])),
        F.sha2(text("base").cast("binary"), 256).alias("base_sha256"),
        text("all").alias("spans"),
    )
