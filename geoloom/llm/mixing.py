"""Mixing sources to target weights by temperature, in DataFrame functions.

Source i has the share p_i of all tokens; its weight is p_i**a over the sum of these. The exponent a in [0, 1] is found by
bisection: for a target entropy the weights' entropy falls as a grows, for a repetition limit the most repeated source (its
budget over its tokens) is repeated less as a grows. Each job evaluates the exponents of four bisection levels at once over
the table of sources, which stays distributed; only those sums reach the driver.

A source's budget is its weight of the total. Its documents are dealt into blocks by a hash, blocks are permuted by a hash,
and documents within a block by another. The budget takes whole epochs, then whole blocks in permuted order, then the
documents of the block that it ends in, up to the document that reaches it. Running sums go over the blocks of a source and
over the documents of a block, never over all documents of a source.

Defined cases: a null source is a source of its own; null, empty and wordless texts have no tokens, are taken once with
each whole epoch and else never; a source without tokens has weight 0 and its documents are left out; repeated rows are
documents of their own; an empty table gives no rows; other columns are kept by mix_sources.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from geoloom.llm.common import SPACE_CLASS, table, written

BLOCK_TOKENS = 200_000
MOST_BLOCKS = 65_536
LEVELS = 4
ROUNDS = 10
SEED = 17
MIXTURE = ("mix_tokens", "mix_epoch", "mix_block", "mix_weight")


def _evaluate(shares: DataFrame, exponents: list[float]) -> dict[float, tuple[float, float, float]]:
    """By exponent: the sum of p**a, the sum of p**a ln p**a, and the largest p**(a - 1)."""
    grid = F.explode(F.array(*(F.lit(float(a)) for a in exponents))).alias("a")
    power = F.pow("p", "a")
    got = shares.select("p", grid).groupBy("a").agg(F.sum(power).alias("z"), F.sum(power * F.col("a") * F.log("p")).alias("s"), F.max(F.pow("p", F.col("a") - 1)).alias("m"))
    return {r.a: (r.z, r.s, r.m) for r in got.collect()}  # a row for each exponent


def entropy(z: float, s: float) -> float:
    return math.log(z) - s / z


def bisect_exponent(shares: DataFrame, too_flat, rounds: int = ROUNDS) -> float:
    """The least exponent in [0, 1] at which too_flat(z, s, m) no longer holds, by bisection."""
    if not too_flat(*_evaluate(shares, [0.0])[0.0]):
        return 0.0
    low, high, n = 0.0, 1.0, 1 << LEVELS
    for _ in range(rounds):
        inner = [low + (high - low) * k / n for k in range(1, n)]
        flat = _evaluate(shares, inner)
        a, b = 0, n  # too flat at a, not at b
        while b - a > 1:
            mid = (a + b) // 2
            a, b = (mid, b) if too_flat(*flat[inner[mid - 1]]) else (a, mid)
        low, high = low + (high - low) * a / n, low + (high - low) * b / n
    return high


def source_weights(docs: DataFrame, target_entropy: float | None = None, max_repeats: float | None = None, budget_share: float = 1.0) -> DataFrame:
    """docs (source, n_tokens) -> source, tokens, weight, budget. target_entropy is a share of the largest possible one,
    between that of the plain shares, which stay where they are flatter than that, and 1, of equal weights; max_repeats bounds
    budget / tokens of every source, and can't be less than budget_share."""
    if max_repeats is not None and budget_share > max_repeats:
        raise ValueError(f"a budget of {budget_share} times all tokens repeats some source more than {max_repeats} times")
    sums = written(docs.groupBy("source").agg(F.sum("n_tokens").alias("tokens")).where("tokens > 0"), "mix-sources")
    total, n = sums.agg(F.sum("tokens"), F.count("*")).first()
    if not n:
        return sums.select("source", "tokens", F.lit(0.0).alias("weight"), F.lit(0).cast("long").alias("budget"))
    shares = sums.select("source", "tokens", (F.col("tokens") / F.lit(float(total))).alias("p"))
    budget = total * budget_share

    def too_flat(z: float, s: float, m: float) -> bool:
        over = max_repeats is not None and budget_share * m / z > max_repeats * (1 + 1e-12)
        return over or target_entropy is not None and n > 1 and entropy(z, s) > target_entropy * math.log(n)

    a = bisect_exponent(shares, too_flat)
    z = _evaluate(shares, [a])[a][0]
    weight = F.pow("p", F.lit(a)) / F.lit(z)
    return shares.select("source", "tokens", weight.alias("weight"), F.round(weight * F.lit(float(budget))).cast("long").alias("budget"))


def mix_sources(docs: DataFrame, keep: list[str] | None = None, **options) -> DataFrame:
    """docs (doc_id, text, source, ...) -> the columns of keep (all), mix_tokens, mix_epoch, mix_block, mix_weight: a row for
    each time that the mixture takes a document. Columns of docs with one of these four names give way. options: see mixture."""
    keep = [c for c in keep or docs.columns if c.lower() not in MIXTURE]
    mixed = mixture(docs, keep, **options)
    return mixed.select("doc.*", *MIXTURE)


def mixture(docs: DataFrame, keep: list[str] | None = None, block_tokens: int = BLOCK_TOKENS, seed: int = SEED, **target) -> DataFrame:
    """docs -> doc (a struct of the columns of keep, all by default), mix_tokens, mix_epoch, mix_block, mix_weight.
    target: see source_weights."""
    keep = docs.columns if keep is None else keep
    n_tokens = F.size(F.array_remove(F.split(F.coalesce("text", F.lit("")), rf"{SPACE_CLASS}+"), "")).cast("long")
    rows = docs.select("source", F.xxhash64(F.lit(seed), "doc_id", "text").alias("key"), n_tokens.alias("n_tokens"), F.struct(*keep).alias("doc"))
    keys = written(rows.select("source", "key", "n_tokens"), "mix-keys")
    weights = source_weights(keys, **target)
    n_blocks = F.least(F.lit(MOST_BLOCKS), F.ceil(F.col("tokens") / F.lit(block_tokens))).cast("long")
    epochs = F.floor(F.col("budget") / F.col("tokens"))
    weights = written(weights.select(F.col("source").alias("w_source"), "weight", n_blocks.alias("n_blocks"), epochs.alias("epochs"), (F.col("budget") - epochs * F.col("tokens")).alias("rest")), "mix-weights")

    def dealt(df: DataFrame) -> DataFrame:
        return df.join(weights, F.col("source").eqNullSafe(F.col("w_source"))).drop("w_source").withColumn("block", F.pmod(F.xxhash64("key", F.lit(1)), F.col("n_blocks")))

    def of_block(df: DataFrame, name: str, how: str) -> DataFrame:
        other = part[name].select(F.col("source").alias("o_source"), F.col("block").alias("o_block"), *(c for c in part[name].columns if c not in ("source", "block")))
        return df.join(other, F.col("source").eqNullSafe(F.col("o_source")) & (F.col("block") == F.col("o_block")), how).drop("o_source", "o_block")

    part = {}
    keyed = dealt(keys)
    blocks = keyed.groupBy("source", "block").agg(F.sum("n_tokens").alias("in_block"), F.any_value("rest").alias("rest"))
    order = Window.partitionBy("source").orderBy(F.xxhash64("block", F.lit(seed)), "block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = blocks.withColumn("room", F.col("rest") - F.coalesce(F.sum("in_block").over(order), F.lit(0))).where("room > 0")
    part["partial"] = written(blocks.select("source", "block", "room", (F.col("room") < F.col("in_block")).alias("cut")), "mix-blocks")
    # the block that a budget ends in gives its documents up to the one that reaches the budget
    part["ends"] = part["partial"].where("cut").drop("cut")
    run = Window.partitionBy("source", "block").orderBy("key").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    reach = of_block(keyed, "ends", "inner").withColumn("n", F.sum("n_tokens").over(run)).where("n >= room")
    part["last"] = reach.groupBy("source", "block").agg(F.min("key").alias("last"))
    part["takes"] = of_block(part["partial"].drop("room", "cut"), "last", "left").withColumn("partial", F.lit(True))
    out = of_block(dealt(rows), "takes", "left")
    once_more = F.col("partial").isNotNull() & (F.col("n_tokens") > 0) & (F.col("last").isNull() | (F.col("key") <= F.col("last")))
    times = F.col("epochs") + once_more.cast("long")
    out = out.where(times > 0).withColumn("epoch", F.explode(F.sequence(F.lit(0).cast("long"), times - 1)))
    return out.select("doc", F.col("n_tokens").alias("mix_tokens"), F.col("epoch").alias("mix_epoch"), F.col("block").alias("mix_block"), F.col("weight").alias("mix_weight"))


def op9_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The mixture at 97 % of the largest entropy and a budget of all tokens, no source more than four times."""
    mixed = mix_sources(table(spark, sf_dir, "documents"), keep=["doc_id", "source"], target_entropy=0.97, max_repeats=4.0)
    return mixed.withColumn("mix_weight", F.round("mix_weight", 9))
