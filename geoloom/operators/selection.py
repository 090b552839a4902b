"""Choice of scenes and rows: per period, per group, gaps, ids, chip windows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from geoloom.operators.lineage import cut


def best_of(df: DataFrame, by: list[Column], order: list[Column], n: int) -> DataFrame:
    """The first n rows of each group in an order; Spark cuts each task's groups before the shuffle."""
    w = Window.partitionBy(*by).orderBy(*order)
    return df.withColumn("rank_in_group", F.row_number().over(w)).where(F.col("rank_in_group") <= n)


def month(date: str) -> Column:
    return F.date_format(date, "yyyy-MM")


def quarter(date: str) -> Column:
    return F.concat(F.year(date).cast("string"), F.lit("-Q"), F.quarter(date).cast("string"))


def missing_months(df: DataFrame, date: str, start: str, end: str) -> DataFrame:
    """Months from start to end without a row."""
    spark = df.sparkSession
    months = spark.range(1).select(F.explode(F.sequence(F.lit(start).cast("date"), F.lit(end).cast("date"), F.expr("interval 1 month"))).alias("m")).select(F.date_format("m", "yyyy-MM").alias("month"))
    return months.join(df.select(month(date).alias("month")).distinct(), "month", "left_anti")


def stable_ids(df: DataFrame, kind: str, key: str, letters: int = 4) -> DataFrame:
    """df with stable_id: PREFIX_000001 and so on within each kind, by key.

    Numbers come from two steps, so that no kind passes through one task: rows are sorted over the cluster by (kind, key),
    numbered within their range, and moved by the counts of the ranges before.
    """
    spark = df.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ranged = cut(df.repartitionByRange(n, kind, key).sortWithinPartitions(kind, key).withColumn("_part", F.spark_partition_id()))
    inside = ranged.withColumn("_k", F.row_number().over(Window.partitionBy("_part", kind).orderBy(key)))
    counts = inside.groupBy("_part", kind).agg(F.count("*").alias("_n"))  # a row for each range and kind
    before = counts.withColumn("_before", F.coalesce(F.sum("_n").over(Window.partitionBy(kind).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("_n")
    out = inside.join(before, ["_part", kind])
    return out.withColumn("stable_id", F.format_string("%s_%06d", F.upper(F.substring(kind, 1, letters)), F.col("_k") + F.col("_before"))).drop("_part", "_k", "_before")


def chip_windows(scenes: DataFrame, height: int, width: int, size: int, stride: int) -> DataFrame:
    """scenes with row_off, col_off of each whole chip."""
    steps = lambda n: F.explode(F.sequence(F.lit(0), F.lit((n - size) // stride)))
    return scenes.withColumn("_r", steps(height)).withColumn("_c", steps(width)).select(*scenes.columns, (F.col("_r") * stride).alias("row_off"), (F.col("_c") * stride).alias("col_off"))
