"""Mixing sources to target weights by temperature, in DataFrame operations only.

A source with token share p gets weight ``p**alpha`` over the sum of these.  ``alpha`` is
bisected until the weights' entropy meets a target, or until no source is repeated more often
than a limit.  The weights become a token budget, the budget passes over each source: whole
passes, and a last one over a permutation of the source's blocks that ends inside one block.

Per source only four numbers decide a document's copies (whole passes, the last block's place
in the permutation, that block, the last document's place in it), so applying a mix moves no
text.  Blocks and places come from MD5 of seed and id; sums along the permutation run over
groups of blocks first and within a group second, so a source with a third of all
rows is never summed in one task.

Defined results: null and empty texts have no tokens; sources without tokens get one pass;
null sources are one source of their own; rows that repeat an id are at the same place and go
in or out together; a null id is at the place of the word ``null``; no rows give no result; blocks at
equal places go by their number; long texts count their words like others and may fill more than a block;
columns of the input keep their names, those added give way (``free_names``).
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import free_names, materialise

REPEAT_LIMIT = 2.0
BLOCK_TOKENS = 65_536
SEED = 17
#: Exponents per bisection job: 2**LEVELS - 1 points settle LEVELS bisection steps.
LEVELS = 5
STEPS = 40
#: Sources up to this number are broadcast; the number is counted first.
FEW_SOURCES = 10_000


def n_tokens(text: Column) -> Column:
    """Number of words outside ``[\\x20\\x09-\\x0D]``, the token measure of the mix."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def _key(source: Column) -> Column:
    return F.coalesce(F.concat(F.lit("s:"), source.cast("string")), F.lit("null"))


def _place(*parts: Column) -> Column:
    """A number below 2**32 from the MD5 of some values."""
    return F.conv(F.substring(F.md5(F.concat_ws("|", F.lit(str(SEED)), *parts).cast("binary")), 1, 8), 16, 10).cast("long")


def _id(doc_id: Column) -> Column:
    return F.coalesce(doc_id.cast("string"), F.lit("null"))


def bisect_exponent(sources: DataFrame, repeat_limit: float | None = None, target_entropy: float | None = None, budget: float | None = None) -> float:
    """The exponent of ``sources(key, tokens)``; both measures fall or rise with it, so halving works.

    With ``target_entropy`` (nats): the exponent in [0, 1] whose weights have that entropy, or the
    nearest end.  Otherwise the smallest exponent in [0, 1] that repeats no source more than
    ``repeat_limit`` times under ``budget`` tokens (none: one pass over the least repeated source).
    """
    rows = sources.filter("tokens > 0").select(F.col("tokens").cast("double").alias("t"))
    top = rows.agg(F.max("t").alias("top")).first().top
    if top is None:
        return 1.0
    low, high, done = 0.0, 1.0, 0
    # the ends first: an end that already meets the target is the answer
    ends = _measures(rows, top, [0.0, 1.0])
    good = lambda m: _meets(m, top, repeat_limit, target_entropy, budget)
    if good(ends[0.0]):
        return 0.0
    if not good(ends[1.0]):
        return 1.0
    while done < STEPS:
        points = [low + (high - low) * k / (1 << LEVELS) for k in range(1, 1 << LEVELS)]
        found = _measures(rows, top, points)
        first = next((k for k, a in enumerate(points) if good(found[a])), len(points))
        low, high = (points[first - 1] if first else low), (points[first] if first < len(points) else high)
        done += LEVELS
    return round(high, 9)


def _measures(rows: DataFrame, top: float, exponents: list[float]) -> dict:
    each = rows.select("t", F.explode(F.array(*map(F.lit, exponents))).alias("a")).withColumn("u", F.pow(F.col("t") / top, "a"))
    found = each.groupBy("a").agg(F.sum("u").alias("z"), F.sum(F.col("u") * F.log(F.col("t") / top)).alias("s"), F.max(F.col("u") / F.col("t")).alias("most"), F.min(F.col("u") / F.col("t")).alias("least"))
    return {r.a: r for r in found.collect()}


def _meets(m, top: float, repeat_limit, target_entropy, budget) -> bool:
    if target_entropy is not None:
        return math.log(m.z) - m.a * m.s / m.z <= target_entropy
    passes = m.most / m.least if budget is None else budget * m.most / m.z
    return passes <= (REPEAT_LIMIT if repeat_limit is None else repeat_limit) * (1 + 1e-12)


def mixing_plan(docs: DataFrame, repeat_limit: float | None = REPEAT_LIMIT, target_entropy: float | None = None, budget: float | None = None, block_tokens: int = BLOCK_TOKENS, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """One row per source: ``key, tokens, weight, passes, whole, blocks, last_place, last_block, last_doc``.

    Without ``budget`` it is the smallest one that passes over every source at least once, so no
    document is left out.
    """
    rows = materialise(docs.select(_key(F.col(source_col)).alias("key"), _id(F.col(id_col)).alias("id"), n_tokens(F.col(text_col)).alias("n")))
    sources = materialise(rows.groupBy("key").agg(F.sum("n").alias("tokens")))
    alpha = bisect_exponent(sources, repeat_limit, target_entropy, budget)
    top = sources.agg(F.max("tokens").alias("top")).first().top or 1
    t, u = F.col("tokens").cast("double"), F.pow(F.col("tokens").cast("double") / float(top), F.lit(alpha))
    total = sources.filter("tokens > 0").agg(F.sum(u).alias("z"), F.min(u / t).alias("least")).first()
    z = total.z or 1.0
    budget = budget if budget is not None else z / (total.least or 1.0)
    plan = sources.select(
        "key",
        "tokens",
        F.when(F.col("tokens") > 0, u / z).otherwise(0.0).alias("weight"),
        F.when(F.col("tokens") > 0, F.round(budget * (u / z) / t, 9)).otherwise(1.0).alias("passes"),
    )
    plan = plan.withColumn("whole", F.floor("passes").cast("int")).withColumn("rest", F.floor((F.col("passes") - F.col("whole")) * t).cast("long"))
    plan = materialise(plan.withColumn("blocks", F.greatest(F.lit(1), F.ceil(t / block_tokens)).cast("long")))
    plan_ = _small(plan)

    dealt = rows.join(plan_.select("key", "blocks"), "key").withColumn("block", F.pmod(_place(F.lit("doc"), F.col("id")), F.col("blocks")))
    blocks = dealt.groupBy("key", "block", "blocks").agg(F.sum("n").alias("n")).withColumn("place", _place(F.lit("block"), F.col("key"), F.col("block").cast("string")))
    # groups of neighbouring places, about sqrt(blocks) of them
    blocks = materialise(blocks.withColumn("group", F.floor(F.col("place") * F.ceil(F.sqrt("blocks")) / float(1 << 32)).cast("long")))
    before = Window.partitionBy("key").orderBy("group").rowsBetween(Window.unboundedPreceding, -1)
    groups = blocks.groupBy("key", "group").agg(F.sum("n").alias("n")).withColumn("start", F.coalesce(F.sum("n").over(before), F.lit(0)))
    groups = groups.join(plan_.select("key", "rest"), "key").filter("start <= rest and rest < start + n").select("key", "group", "start", "rest")
    inner = Window.partitionBy("key").orderBy("place", "block").rowsBetween(Window.unboundedPreceding, -1)
    last = blocks.join(_small(groups), ["key", "group"]).withColumn("begin", F.col("start") + F.coalesce(F.sum("n").over(inner), F.lit(0)))
    last = materialise(last.filter("begin <= rest and rest < begin + n").select("key", "block", "place", (F.col("rest") - F.col("begin")).alias("left")))
    own = dealt.join(_small(last), ["key", "block"]).withColumn("at", F.md5(F.concat_ws("|", F.lit(str(SEED)), F.lit("in"), "id").cast("binary")))
    own = own.groupBy("key", "block", "place", "left", "at").agg(F.sum("n").alias("n"))
    along = Window.partitionBy("key").orderBy("at")
    fits = own.withColumn("end", F.sum("n").over(along)).filter("end <= left")
    ends = last.join(fits.groupBy("key").agg(F.max("at").alias("last_doc")), "key", "left")
    return materialise(plan.join(ends.select("key", F.col("place").alias("last_place"), F.col("block").alias("last_block"), "last_doc"), "key", "left"))


def _small(plan: DataFrame) -> DataFrame:
    """Marks a table with a row per source for broadcast if its counted rows are few."""
    return F.broadcast(plan) if plan.limit(FEW_SOURCES + 1).count() <= FEW_SOURCES else plan


def copies(docs: DataFrame, plan: DataFrame, id_col: str = "doc_id", source_col: str = "source", names: list[str] | None = None) -> DataFrame:
    """``docs`` with four more columns: the passes over its source, each row's block, the block's place in the permutation, and the row's copies in the mix.

    They are called ``passes, block, block_place, copies``, with underscores before a name that ``docs`` has; or by ``names``.
    """
    passes, block, place, count = names or free_names(docs, "passes", "block", "block_place", "copies")
    key, whole, blocks, last_place, last_block, last_doc = free_names(docs.select("*", *(F.lit(0).alias(n) for n in (passes, block, place, count))), "key", "whole", "blocks", "last_place", "last_block", "last_doc")
    plan = plan.select(F.col("key").alias(key), F.col("whole").alias(whole), F.col("blocks").alias(blocks), F.col("last_place").alias(last_place), F.col("last_block").alias(last_block), F.col("last_doc").alias(last_doc), F.col("passes").alias(passes))
    out = docs.withColumn(key, _key(F.col(source_col))).join(_small(plan), key)
    ident = _id(F.col(id_col))
    out = out.withColumn(block, F.pmod(_place(F.lit("doc"), ident), F.col(blocks)))
    out = out.withColumn(place, _place(F.lit("block"), F.col(key), F.col(block).cast("string")))
    at = F.md5(F.concat_ws("|", F.lit(str(SEED)), F.lit("in"), ident).cast("binary"))
    # blocks before the last one in the permutation are in; in the last one, documents up to the last that fits
    taken = F.when(F.col(block) == F.col(last_block), at <= F.col(last_doc)).otherwise(F.struct(F.col(place).alias("p"), F.col(block).alias("b")) < F.struct(F.col(last_place).alias("p"), F.col(last_block).alias("b")))
    return out.withColumn(count, F.col(whole) + F.coalesce(taken, F.lit(False)).cast("int")).drop(key, whole, blocks, last_place, last_block, last_doc)


def mix(docs: DataFrame, plan: DataFrame, id_col: str = "doc_id", source_col: str = "source") -> DataFrame:
    """The mixed corpus: each row of ``docs`` as often as the plan says, with its own columns."""
    *names, copy = free_names(docs, "passes", "block", "block_place", "copies", "copy")
    out = copies(docs, plan, id_col, source_col, names).filter(F.col(names[3]) > 0)
    return out.withColumn(copy, F.explode(F.sequence(F.lit(1), F.col(names[3])))).select(*(F.col(f"`{c}`") for c in docs.columns))


#: The same mix in DuckDB SQL, for distinct ids and the default limit (there the exponent has a closed form).
ORACLE_SQL = r"""
WITH d AS (
  SELECT doc_id, source, coalesce('s:' || source, 'null') AS key, coalesce(CAST(doc_id AS VARCHAR), 'null') AS id,
         CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS n
  FROM documents),
s AS (SELECT key, CAST(sum(n) AS BIGINT) AS tokens FROM d GROUP BY key),
e AS (
  SELECT max(tokens) AS top,
         round(CASE WHEN min(tokens) = max(tokens) THEN 0.0
                    ELSE greatest(0.0, 1.0 - ln(2.0) / ln(max(tokens)::DOUBLE / min(tokens))) END, 9) AS alpha
  FROM s WHERE tokens > 0),
p AS (
  SELECT key, tokens,
         CASE WHEN tokens > 0 THEN round(pow(tokens::DOUBLE / top, alpha - 1.0), 9) ELSE 1.0 END AS passes,
         greatest(1, CAST(ceil(tokens::DOUBLE / 65536) AS BIGINT)) AS blocks
  FROM s, e),
q AS (SELECT *, CAST(floor(passes) AS INTEGER) AS whole, CAST(floor((passes - floor(passes)) * tokens) AS BIGINT) AS rest FROM p),
b AS (
  SELECT d.*, q.tokens, q.whole, q.rest, q.passes,
         CAST('0x' || substr(md5('17|doc|' || id), 1, 8) AS BIGINT) % q.blocks AS block
  FROM d JOIN q USING (key)),
c AS (
  SELECT *, CAST('0x' || substr(md5('17|block|' || key || '|' || block), 1, 8) AS BIGINT) AS place, md5('17|in|' || id) AS spot
  FROM b),
r AS (
  SELECT *, sum(n) OVER (PARTITION BY key ORDER BY place, block) AS block_end,
         sum(n) OVER (PARTITION BY key, block) AS block_n,
         sum(n) OVER (PARTITION BY key, block ORDER BY spot) AS doc_end
  FROM (SELECT * FROM c) x),
m AS (SELECT *, block_end - block_n AS block_start FROM r)
SELECT doc_id, source, n AS n_tokens, passes, CAST(block AS BIGINT) AS block, place AS block_place,
       whole + CAST(CASE WHEN tokens = 0 THEN FALSE
                         WHEN block_end <= rest THEN TRUE
                         WHEN block_start <= rest THEN block_start + doc_end <= rest
                         ELSE FALSE END AS INTEGER) AS copies
FROM m
"""
