"""Mixing sources by temperature, realised as budgeted block permutations.

A source's weight is its token share to the power of an exponent, normalised.
The exponent is bisected between 0 (all sources alike) and 1 (as they are) to
meet a target entropy (a share of the largest possible), then raised as far as
the repetition limit asks. A source's quota is its weight times the budget.

Its documents are dealt by a hash into blocks; the blocks follow one another in
the order of another hash (a permutation that any worker can compute). Full
passes take every block; the last pass takes blocks in that order until the
quota, and documents by hash in the one block where the quota ends.

Sources, their weights and the blocks are tables, joined by key: Spark broadcasts
them where their measured size allows it and else shuffles, splitting a hot source's
rows by adaptive execution. Only sums over all sources reach the driver, a few for
each exponent tried, so sources may be as many as documents.

Defined results: null texts have no tokens; null sources form one source; a
source without tokens gets weight 0 and its documents no copies; repeated rows
are dealt alike and counted one by one; very long texts are counted whole; an empty
input gives no rows; other columns are kept as they are (their names must not begin
with ``mix_``).
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import Scratch, words


_STEP = 32


def entropy(weights: list[float]) -> float:
    return -sum(w * math.log(w) for w in weights if w > 0)


def tempered(tokens: dict, exponent: float) -> dict:
    """Weights proportional to token shares to the power of exponent; 0 where there are no tokens."""
    total = sum(tokens.values())
    raw = {s: (n / total) ** exponent if n else 0.0 for s, n in tokens.items()}
    norm = sum(raw.values())
    return {s: w / norm for s, w in raw.items()} if norm else raw


def power_sums(sources: DataFrame, total: int, exponents: list[float]) -> list[tuple[float, float]]:
    """For each exponent the sums, over sources (mix_source, n), of share ** exponent and of that times ln share; one job."""
    log = F.log(F.col("n") / F.lit(float(total)))
    sums = [x for a in exponents for x in (F.sum(F.exp(log * a)), F.sum(F.exp(log * a) * log))]
    got = sources.where("n > 0").agg(*[s.alias(f"s{i}") for i, s in enumerate(sums)]).first()
    return [(got[2 * i] or 0.0, got[2 * i + 1] or 0.0) for i in range(len(exponents))]


def least_exponent(sources: DataFrame, total: int, holds: Callable[[float, float, float], bool], rounds: int = 6) -> float:
    """The least exponent from 0 to 1 that holds(exponent, sums), which 1 is taken to do.

    The bracket is cut into ``_STEP`` parts a round, all tried in one job, so six
    rounds bisect it thirty times.
    """
    low, high = 0.0, 1.0
    for k in range(rounds):
        tried = [low + (high - low) * i / _STEP for i in range(0 if k == 0 else 1, _STEP)]
        fits = [holds(a, *s) for a, s in zip(tried, power_sums(sources, total, tried), strict=True)]
        if k == 0 and fits[0]:
            return 0.0
        at = fits.index(True) if True in fits else len(tried)
        low, high = tried[at - 1] if at else low, tried[at] if at < len(tried) else high
    return high


def choose_exponent(sources: DataFrame, total: int, budget: float, target_entropy: float | None, repetition: float | None) -> float:
    """The exponent that meets the target entropy share, raised until no source repeats more than allowed."""
    filled = sources.where("n > 0").agg(F.count("*").alias("k"), F.min("n").alias("least")).first()
    if filled["k"] < 2:
        return 1.0
    goal = math.inf if target_entropy is None else target_entropy * math.log(filled["k"])
    limit = math.inf if repetition is None else repetition
    least = filled["least"] / total

    def holds(a: float, z: float, s: float) -> bool:
        # Exponents are 1 at most, so the smallest source repeats most.
        return math.log(z) - a * s / z <= goal and least ** (a - 1) / z * budget / total <= limit

    return least_exponent(sources, total, holds)


def mix(
    spark: SparkSession, docs: DataFrame, target_entropy: float | None = 0.97, repetition: float | None = 4.0, budget_share: float = 1.0,
    block_tokens: int = 1 << 18, seed: int = 7,
) -> DataFrame:
    """docs with mix_tokens, mix_weight, mix_block, mix_place (the block's place in its source's permutation) and mix_copies (how often the row is taken)."""
    scratch = Scratch(spark, "mixing")
    key = F.coalesce(F.concat(F.lit("s"), F.col("source").cast("string")), F.lit("null"))
    rows = docs.withColumn("mix_source", key).withColumn("mix_tokens", F.size(words(F.col("text"))).cast("bigint"))
    sources = scratch.keep(rows.groupBy("mix_source").agg(F.sum("mix_tokens").alias("n")), "sources")
    total = sources.agg(F.sum("n")).first()[0] or 0
    exponent, budget = 1.0, budget_share * total
    if total:
        exponent = choose_exponent(sources, total, budget, target_entropy, repetition)
    norm = round(power_sums(sources, total, [exponent])[0][0], 12) if total else 1.0
    weight = F.when(F.col("n") > 0, F.exp(F.log(F.col("n") / F.lit(float(total or 1))) * exponent) / norm).otherwise(F.lit(0.0))
    quota = F.floor(F.col("mix_weight") * budget)
    passes, rest = (F.when(F.col("n") > 0, F.expr(f"mix_quota {op} n")).otherwise(F.lit(0)) for op in ("div", "%"))
    plan = sources.withColumn("mix_weight", weight).withColumn("mix_quota", quota).select(
        "mix_source", "mix_weight", F.greatest(F.lit(1), F.ceil(F.col("n") / block_tokens)).cast("bigint").alias("mix_blocks"),
        passes.cast("bigint").alias("mix_passes"), rest.cast("bigint").alias("mix_rest"),
    )
    plan = scratch.keep(plan, "plan")

    dealt = rows.join(plan, "mix_source")
    deal = F.xxhash64(F.lit(seed), F.col("doc_id"), F.xxhash64("text"))
    dealt = dealt.withColumn("mix_deal", deal).withColumn("mix_block", F.pmod("mix_deal", "mix_blocks"))
    per_block = dealt.groupBy("mix_source", "mix_block", "mix_rest").agg(F.sum("mix_tokens").alias("mix_n"))
    order = Window.partitionBy("mix_source").orderBy(F.xxhash64(F.lit(seed + 1), "mix_source", "mix_block"), "mix_block")
    upto = F.sum("mix_n").over(order.rowsBetween(Window.unboundedPreceding, 0))
    left = F.col("mix_rest") - (F.col("mix_upto") - F.col("mix_n"))  # what the last pass still takes when it comes to the block
    placed = per_block.withColumn("mix_upto", upto).withColumn("mix_place", F.row_number().over(order).cast("bigint"))
    blocks = scratch.keep(placed.select("mix_source", "mix_block", "mix_place", left.alias("mix_left"), "mix_n"), "blocks")

    placed = dealt.join(blocks, ["mix_source", "mix_block"])
    whole = (F.col("mix_left") >= F.col("mix_n")) | (F.col("mix_left") <= 0)
    within = Window.partitionBy("mix_source", "mix_block").orderBy(F.xxhash64(F.lit(seed + 2), "mix_deal"), "mix_deal")
    so_far = F.sum("mix_tokens").over(within.rowsBetween(Window.unboundedPreceding, 0))
    names = [*[F.col(f"`{c}`") for c in docs.columns], "mix_tokens", "mix_weight", "mix_block", "mix_place"]
    easy = placed.where(whole).select(*names, (F.col("mix_passes") + F.when(F.col("mix_left") > 0, 1).otherwise(0)).alias("mix_copies"))
    split = placed.where(~whole).withColumn("mix_so_far", so_far)
    hard = split.select(*names, (F.col("mix_passes") + F.when(F.col("mix_so_far") <= F.col("mix_left"), 1).otherwise(0)).alias("mix_copies"))
    none = F.when(F.col("mix_tokens") > 0, F.col("mix_copies")).otherwise(0)
    return easy.unionByName(hard).withColumn("mix_copies", none.cast("bigint"))


def mixed(spark: SparkSession, docs: DataFrame, **options) -> DataFrame:
    """The rows of docs that the mix takes, as often as it takes them."""
    plan = mix(spark, docs, **options).where("mix_copies > 0")
    return plan.withColumn("mix_pass", F.explode(F.sequence(F.lit(1), F.col("mix_copies").cast("int")))).select(*docs.columns)
