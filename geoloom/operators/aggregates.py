"""Aggregations beyond one built-in function: upper medians, nearest-rank percentiles, masked cell means, gains."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from geoloom.operators.lineage import table


def share(condition: Column) -> Column:
    """The share of rows for which a condition holds; null counts as no."""
    return F.avg(F.coalesce(condition, F.lit(False)).cast("double"))


def counts_upto(df: DataFrame, value: str, *by: str, ranges: int | None = None) -> DataFrame:
    """by, v (the value), c (its rows), upto (rows of values up to it), n (rows of the group): running counts over distinct
    values, without a group in one task. Values are dealt into ranges of about as many distinct values, running sums go over the
    values of a range, and a range's start comes from the sums of the ranges before it."""
    counts = df.where(F.col(value).isNotNull()).groupBy(*by, F.col(value).alias("v")).agg(F.count("*").alias("c"))
    ranges = ranges or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = table(counts.repartitionByRange(ranges, *by, "v").withColumn("part", F.spark_partition_id()), "ranges")
    inner = Window.partitionBy("part", *by).orderBy("v").rowsBetween(Window.unboundedPreceding, 0)
    sums = dealt.groupBy("part", *by).agg(F.sum("c").alias("c"))  # a row for each range that a group has
    before = F.coalesce(F.sum("c").over(Window.partitionBy(*by).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = sums.select("part", *by, before.alias("before"), F.sum("c").over(Window.partitionBy(*by)).alias("n"))
    starts = starts.withColumnsRenamed({c: f"_{c}" for c in by}).withColumnRenamed("part", "_part")
    on = F.col("part") == F.col("_part")
    for c in by:
        on = on & F.col(c).eqNullSafe(F.col(f"_{c}"))
    met = dealt.withColumn("run", F.sum("c").over(inner)).join(starts, on)
    return met.select(*by, "v", "c", (F.col("run") + F.col("before")).alias("upto"), "n")


def at_rank(df: DataFrame, value: str, rank: Column, *by: str) -> DataFrame:
    """The value at a rank (from 0, a column of n) of each group's ordered values, without gathering a group: the first value
    whose running count reaches the rank is taken."""
    return counts_upto(df, value, *by).where(F.col("upto") > rank).groupBy(*by).agg(F.min("v").alias(value))


def percentiles(df: DataFrame, value: str, shares: dict[str, float], *by: str) -> DataFrame:
    """by, and under each name the value at that share of the ordering, between two values in proportion; as at_rank, no group
    is gathered, only running counts of its distinct values."""
    run, found = counts_upto(df, value, *by), []
    for name, p in shares.items():
        place = F.lit(p) * (F.col("n") - 1)
        for end, rank in (("low", F.floor(place)), ("high", F.ceil(place))):
            found.append(F.min(F.when(F.col("upto") > rank, F.col("v"))).alias(f"_{name}_{end}"))
        found.append(F.any_value(place - F.floor(place)).alias(f"_{name}_part"))
    out = run.groupBy(*by).agg(*found)
    return out.select(*by, *((F.col(f"_{k}_low") + (F.col(f"_{k}_high") - F.col(f"_{k}_low")) * F.col(f"_{k}_part")).alias(k) for k in shares))


def upper_median(df: DataFrame, value: str, *by: str) -> DataFrame:
    return at_rank(df, value, F.floor(F.col("n") / 2), *by)


def nearest_rank(df: DataFrame, value: str, p: float, *by: str) -> DataFrame:
    return at_rank(df, value, F.rint(F.lit(p) * (F.col("n") - 1)), *by)


def masked_cell_means(df: DataFrame, cell: str, value: str, valid: Column, least_share: float = 0.5) -> DataFrame:
    """cell, n, valid_share, mean: the mean of valid values, null where fewer than least_share are valid."""
    ok = valid & ~F.isnan(value) & F.col(value).isNotNull()
    out = df.groupBy(cell).agg(F.count("*").alias("n"), share(ok).alias("valid_share"), F.avg(F.when(ok, F.col(value))).alias("m"))
    return out.select(cell, "n", "valid_share", F.when(F.col("valid_share") >= least_share, F.col("m")).alias("mean"))


def gain(relevance: Column, rank: Column) -> Column:
    return (F.pow(F.lit(2.0), relevance) - 1) / F.log2(rank + 1)
