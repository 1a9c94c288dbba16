"""Mixing sources to target weights: temperature, budget and block permutations.

A source's share of all tokens, raised to an exponent and normalised, is its
weight; an exponent of 1 keeps the natural shares, 0 makes all sources equal.
The exponent is bisected to the largest one whose weights reach a target
entropy, and raised where a source would else repeat too often.

Weights become token budgets.  A source's documents are dealt into blocks; in
every epoch its blocks come in a new permutation, documents in a fixed one
inside each block, until the budget is met.  The place of a document in its
source's stream, relative to that budget, is its place in the mixture, so that
every output block holds each source at its weight.

DataFrame operations only.  Prefix sums run inside blocks and over the blocks
of a source, never over the documents of a source.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import fresh, written

ENTROPY_SHARE = 0.97       # target entropy, as a share of that of equal weights
MAX_REPETITION = 4.0       # how often a document may occur, at most
BLOCK_TOKENS = 1 << 14     # tokens of a block of one source
MAX_BLOCKS = 1 << 12       # blocks of one source; larger sources have larger blocks
OUTPUT_TOKENS = 1 << 16    # tokens of a block of the mixture
LEVELS = 25                # bisections of the exponent
LEVELS_A_PASS = 5          # bisections that one aggregation decides


def token_count(text: Column) -> Column:
    """Tokens of a text: runs of characters other than blanks, tabs and line ends."""
    return F.coalesce(F.regexp_count(text, F.lit("[^ \\t\\n\\r]+")), F.lit(0)).cast("long")


@dataclass(frozen=True)
class Plan:
    """Exponent, normaliser and budget of a mixture."""

    exponent: float
    norm: float
    tokens: int
    budget: int

    def weight(self, source_tokens: Column) -> Column:
        return F.pow(source_tokens / F.lit(float(self.tokens)), F.lit(self.exponent)) / F.lit(self.norm)

    def source_budget(self, source_tokens: Column) -> Column:
        return F.floor(self.weight(source_tokens) * F.lit(float(self.budget)) + F.lit(0.5)).cast("long")


def plan(sources: DataFrame, budget: int | None = None, entropy_share: float = ENTROPY_SHARE,
         max_repetition: float = MAX_REPETITION) -> Plan | None:
    """The mixture of ``sources`` (tokens long, positive; one row a source).

    The budget is all tokens unless given, and at most ``max_repetition`` times
    all tokens.  None where there is no source."""
    total = sources.agg(F.sum("tokens").alias("t"), F.min("tokens").alias("least"), F.count(F.lit(1)).alias("n")).first()
    if not total["n"]:
        return None
    tokens, n = int(total["t"]), total["n"]
    budget = min(tokens if budget is None else budget, int(max_repetition * tokens))
    p = F.col("tokens") / F.lit(float(tokens))
    target, least = entropy_share * math.log(n), total["least"] / tokens

    def measured(exponents: list[float]) -> list[tuple[float, float, float]]:
        """(normaliser, entropy, highest repetition) under each exponent; one job."""
        row = sources.agg(*[f(F.pow(p, F.lit(x))) for x in exponents
                            for f in (F.sum, lambda c: F.sum(c * F.log(p)))]).first()
        out = []
        for k, x in enumerate(exponents):
            z, s = row[2 * k], row[2 * k + 1]
            out.append((z, math.log(z) - x * s / z, budget / tokens * least ** (x - 1) / z))
        return out

    def bisected(low_side) -> int:
        """The largest k with ``low_side`` at k / 2 ** LEVELS, which holds at 0
        and up to some point; -1 where it doesn't hold at 0."""
        unit = 1 << LEVELS
        at_0, at_1 = measured([0.0, 1.0])
        if not low_side(*at_0):
            return -1
        if low_side(*at_1):
            return unit
        lo, width = 0, unit
        while width > 1:
            step = width >> min(LEVELS_A_PASS, width.bit_length() - 1)
            ks = range(lo + step, lo + width, step)
            held = [low_side(*m) for m in measured([k / unit for k in ks])]
            lo, width = lo + step * (held + [False]).index(False), step
        return lo

    by_entropy = max(0, bisected(lambda z, h, r: h >= target - 1e-12))
    by_repetition = bisected(lambda z, h, r: r > max_repetition + 1e-12) + 1
    exponent = min(1.0, max(by_entropy, by_repetition) / (1 << LEVELS))
    return Plan(exponent, measured([exponent])[0][0], tokens, budget)


def _hash(*parts) -> Column:
    return F.md5(F.concat_ws(":", *[p if isinstance(p, Column) else F.lit(p) for p in parts]).cast("binary"))


def mix(docs: DataFrame, budget: int | None = None, entropy_share: float = ENTROPY_SHARE,
        max_repetition: float = MAX_REPETITION, block_tokens: int = BLOCK_TOKENS,
        output_tokens: int = OUTPUT_TOKENS, seed: str = "mix", id_col: str = "doc_id", text_col: str = "text",
        source_col: str = "source") -> DataFrame:
    """The rows of ``docs`` as often as the mixture takes them, with the columns

    n_tokens, epoch (how often the document came before), block (of its source),
    start (tokens of its source's stream before it), mix_block (block of the
    mixture, from 0).

    A null source is a source of its own.  A null text has no tokens; a source
    without tokens has no weight and isn't in the mixture; of another source, a
    document without tokens that stands just at the end of the budget is.  Rows that repeat an
    id are documents of their own; where they tie in tokens too, which of them
    comes first is open.  Columns of these names in ``docs`` are replaced.
    """
    made = ["n_tokens", "epoch", "block", "start", "mix_block"]
    names = [c for c in docs.columns if c.lower() not in made]
    skey, order, all_tokens, own_budget, base, prior = fresh(
        docs, "skey", "order", "source_tokens", "source_budget", "block_start", "prior")
    source = F.col(source_col).cast("string")
    dealt = docs.select(*names, token_count(F.col(text_col)).alias("n_tokens"),
                        F.concat(F.when(source.isNull(), "n").otherwise("v"), F.coalesce(source, F.lit(""))).alias(skey))
    sources = written(dealt.groupBy(skey).agg(F.sum("n_tokens").alias("tokens")).where("tokens > 0"), "sources")
    p = plan(sources, budget, entropy_share, max_repetition)
    if p is None:
        return dealt.where(F.lit(False)).select(*names, "n_tokens", *[
            F.lit(0).cast(t).alias(c) for c, t in zip(made[1:], ("int", "long", "long", "long"))])
    blocks_of = F.greatest(F.lit(1), F.least(F.lit(MAX_BLOCKS), F.ceil(F.col(all_tokens) / F.lit(float(block_tokens)))))
    sources = sources.select(skey, F.col("tokens").alias(all_tokens), p.source_budget(F.col("tokens")).alias(own_budget))
    number = F.conv(F.substring(F.col(order), 1, 8), 16, 10).cast("long")
    dealt = (dealt.join(sources, skey).withColumn(order, _hash(seed, "doc", F.col(id_col)))
             .withColumn("block", number % blocks_of.cast("long")))

    # the blocks of each source, permuted anew in each epoch, up to the budget
    blocks = (dealt.groupBy(skey, "block", all_tokens, own_budget).agg(F.sum("n_tokens").alias("tokens"))
              .withColumn("epoch", F.explode(F.sequence(F.lit(0), F.floor(
                  (F.greatest(F.col(own_budget), F.lit(1)) - 1) / F.col(all_tokens)).cast("int")))))
    permuted = (Window.partitionBy(skey, "epoch").orderBy(_hash(seed, "block", F.col("epoch"), F.col("block")), "block")
                .rowsBetween(Window.unboundedPreceding, -1))
    starts = (blocks.withColumn(base, F.col("epoch") * F.col(all_tokens) + F.coalesce(F.sum("tokens").over(permuted), F.lit(0)))
              .where(F.col(base) <= F.col(own_budget)).select(skey, "block", "epoch", base))

    inside = Window.partitionBy(skey, "block").orderBy(order, id_col, "n_tokens").rowsBetween(Window.unboundedPreceding, -1)
    out = (dealt.withColumn(prior, F.coalesce(F.sum("n_tokens").over(inside), F.lit(0)))
           .join(starts, [skey, "block"])
           .withColumn("start", F.col(base) + F.col(prior))
           .where((F.col("start") < F.col(own_budget)) | ((F.col("n_tokens") == 0) & (F.col("start") == F.col(own_budget)))))
    output_blocks = max(1, -(-p.budget // output_tokens))
    # a source of weight 0 has its documents without tokens at the start
    place = F.coalesce(F.floor(F.try_divide(F.col("start"), F.col(own_budget)) * F.lit(float(output_blocks))), F.lit(0)).cast("long")
    return out.select(*names, "n_tokens", "epoch", "block", "start", F.least(place, F.lit(output_blocks - 1)).alias("mix_block"))


def mixed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
          **options) -> DataFrame:
    """The mixture with the columns of ``docs`` alone: rows repeat as often as
    their source's weight asks, and those beyond its budget are gone."""
    # the row travels as one column, so that no name in it meets one of ours
    row = F.struct(*docs.columns).alias("row")
    own = docs.select(row, F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), F.col(source_col).alias("source"))
    return mix(own, **options).select("row.*")


def oracle(entropy_share: float = ENTROPY_SHARE, max_repetition: float = MAX_REPETITION,
           block_tokens: int = BLOCK_TOKENS, output_tokens: int = OUTPUT_TOKENS, seed: str = "mix") -> str:
    """DuckDB SQL of ``mix`` over ``documents`` with the budget of all tokens."""
    unit = float(1 << LEVELS)
    z = "list_sum(list_transform(ps, lambda q: pow(q, {x})))"
    s = "list_sum(list_transform(ps, lambda q: pow(q, {x}) * ln(q)))"
    ent = lambda x: f"(ln({z.format(x=x)}) - {x} * {s.format(x=x)} / {z.format(x=x)})"
    rep = lambda x: f"(pow(least_p, {x} - 1) / {z.format(x=x)})"
    mid = f"(((lo + hi) // 2) / {unit})"
    search = lambda name, holds: f"""
{name}(i, lo, hi) AS (
  SELECT 0, 0::BIGINT, {1 << LEVELS}::BIGINT
  UNION ALL
  SELECT i + 1, CASE WHEN {holds(mid)} THEN (lo + hi) // 2 ELSE lo END, CASE WHEN {holds(mid)} THEN hi ELSE (lo + hi) // 2 END
  FROM {name}, total WHERE i < {LEVELS})"""  # noqa: E731
    by_h = lambda x: f"{ent(x)} >= {entropy_share} * ln(n) - 1e-12"
    by_r = lambda x: f"{rep(x)} > {max_repetition} + 1e-12"
    return f"""
WITH RECURSIVE dealt AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^ \\t\\n\\r]+')), 0)::BIGINT AS n_tokens,
         CASE WHEN source IS NULL THEN 'n' ELSE 'v' END || coalesce(source, '') AS skey,
         md5(concat_ws(':', '{seed}', 'doc', doc_id)) AS ord
  FROM documents),
sources AS (SELECT skey, sum(n_tokens)::BIGINT AS tokens FROM dealt GROUP BY 1 HAVING sum(n_tokens) > 0),
total AS (
  SELECT list(tokens / t) AS ps, min(tokens / t) AS least_p, count(*) AS n, any_value(t)::BIGINT AS t
  FROM sources, (SELECT sum(tokens)::DOUBLE AS t FROM sources)),
{search("h", by_h)},
{search("r", by_r)},
expo AS (
  SELECT least(1.0, greatest(
    (SELECT CASE WHEN {by_h("1.0")} THEN {1 << LEVELS} ELSE lo END FROM h, total WHERE i = {LEVELS}),
    (SELECT CASE WHEN NOT {by_r("0.0")} THEN 0 WHEN {by_r("1.0")} THEN {1 << LEVELS} ELSE lo + 1 END FROM r, total WHERE i = {LEVELS})
  ) / {unit}) AS x),
budgets AS (
  SELECT skey, tokens, greatest(1, least({MAX_BLOCKS}, ceil(tokens / {float(block_tokens)})))::BIGINT AS k,
         floor(pow(tokens / t::DOUBLE, x) / {z.format(x="x")} * t::DOUBLE + 0.5)::BIGINT AS budget
  FROM sources, total, expo),
placed AS (
  SELECT d.*, b.tokens AS all_tokens, b.budget, ('0x' || substr(ord, 1, 8))::BIGINT % k AS block
  FROM dealt d JOIN budgets b USING (skey)),
inside AS (
  SELECT *, coalesce(sum(n_tokens) OVER (PARTITION BY skey, block ORDER BY ord, doc_id, n_tokens
                     ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS prior FROM placed),
blocks AS (
  SELECT skey, block, all_tokens, budget, sum(n_tokens)::BIGINT AS tokens,
         unnest(generate_series(0, ((greatest(budget, 1) - 1) // all_tokens)))::INTEGER AS epoch
  FROM placed GROUP BY 1, 2, 3, 4),
starts AS (
  SELECT skey, block, epoch, epoch * all_tokens + coalesce(sum(tokens) OVER (
           PARTITION BY skey, epoch ORDER BY md5(concat_ws(':', '{seed}', 'block', epoch, block)), block
           ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS base
  FROM blocks)
SELECT doc_id, source, n_tokens, epoch, i.block, base + prior AS start, least(blocks - 1,
       coalesce(floor((base + prior) / nullif(budget, 0)::DOUBLE * blocks), 0))::BIGINT AS mix_block
FROM inside i JOIN starts s ON i.skey = s.skey AND i.block = s.block,
     (SELECT greatest(1, (t + {output_tokens - 1}) // {output_tokens}) AS blocks FROM total)
WHERE base + prior < budget OR (n_tokens = 0 AND base + prior = budget)
"""
