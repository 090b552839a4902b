"""Grid operators over long pixel tables: box moments, histogram matching."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from geoloom.operators.aggregates import counts_upto
from geoloom.operators.lineage import table


def box_moments(grid: DataFrame, value: str, reach: int, cell: str = "cell", row: str = "row_no", col: str = "col_no") -> DataFrame:
    """mean and variance (population) of the pixels present within `reach` rows and columns, in two one-dimensional windows:
    sums run over a range of columns within a row, and rows meet by an explode of 2 * reach + 1 row sums."""
    offsets = F.explode(F.array(*(F.lit(d) for d in range(-reach, reach + 1)))).alias("_offset")
    sums = grid.select(cell, row, col, value, offsets).withColumn("_target", F.col(row) + F.col("_offset"))
    # every pixel is offered to the rows around it; a pixel then sums what its row was offered in the columns around
    w = Window.partitionBy(cell, "_target").orderBy(col).rangeBetween(-reach, reach)
    offered = sums.withColumns({"_n": F.count("*").over(w), "_s": F.sum(value).over(w), "_q": F.sum(F.col(value) ** 2).over(w)})
    mean = F.col("_s") / F.col("_n")
    return offered.where("_offset = 0").select(cell, row, col, value, mean.alias("mean"), (F.col("_q") / F.col("_n") - mean * mean).alias("variance"))


def histogram_match(source: DataFrame, value: str, target: DataFrame, target_value: str) -> DataFrame:
    """source with matched: the target value at the same place of the ordering. Places come from running counts of distinct
    values by ranges; source values that are equal get one match. The place among the target's counts is found by ranges too:
    wanted places and counts are dealt by place, and the first count of a later range stands for places behind a range's last."""
    n, m = source.count(), target.count()
    place = F.greatest(F.lit(1), F.ceil((F.col("upto") - F.col("c") + 1) * m / F.lit(float(max(n, 1))))).cast("long")
    wanted = counts_upto(source, value).select(F.col("v").alias("_v"), place.alias("at"), F.lit(None).cast("double").alias("t"))
    have = counts_upto(target, target_value).select(F.lit(None).cast("double").alias("_v"), F.col("upto").alias("at"), F.col("v").cast("double").alias("t"))
    both = wanted.unionByName(have)
    dealt = table(both.repartitionByRange("at").withColumn("part", F.spark_partition_id()), "places")
    first = dealt.where("t IS NOT NULL").groupBy("part").agg(F.min(F.struct("at", "t")).alias("f"))  # a row for each range
    later = dealt.select("part").distinct().join(first, "part", "left")
    later = later.select(F.col("part").alias("_part"), F.first("f.t", ignorenulls=True).over(Window.orderBy("part").rowsBetween(1, Window.unboundedFollowing)).alias("later"))
    # the first target value whose count reaches the place: an as-of join in one window of each range
    w = Window.partitionBy("part").orderBy(F.desc("at"), F.col("t").isNull(), F.desc("t")).rowsBetween(Window.unboundedPreceding, 0)
    filled = dealt.withColumn("here", F.last("t", ignorenulls=True).over(w)).where("_v IS NOT NULL").join(F.broadcast(later), F.col("part") == F.col("_part"))
    return source.join(filled.select("_v", F.coalesce("here", "later").alias("matched")), F.col(value) == F.col("_v")).drop("_v")


def grids(pixels: DataFrame, key: str, row: str = "row_no", col: str = "col_no") -> DataFrame:
    """The grid that the pixels of each key span: its corners, and how many pixels there are."""
    corners = (F.min(row).alias("top"), F.min(col).alias("left"), F.max(row).alias("bottom"), F.max(col).alias("right"))
    return pixels.groupBy(key).agg(*corners, F.count("*").alias("pixels"))


def conformance(one: DataFrame, two: DataFrame, key: str, name: str, other: str) -> DataFrame:
    """Whether two grids of a key start at the same pixel, and are the same; a key that has one of them conforms to nothing."""
    at = F.struct("top", "left", "bottom", "right")
    one = one.select(key, at.alias("g"), F.col("pixels").alias(f"{name}_pixels"))
    two = two.select(key, at.alias("h"), F.col("pixels").alias(f"{other}_pixels"))
    both = one.join(two, key, "full")
    origin = F.coalesce((F.col("g.top") == F.col("h.top")) & (F.col("g.left") == F.col("h.left")), F.lit(False))
    count = lambda x: F.coalesce(f"{x}_pixels", F.lit(0)).alias(f"{x}_pixels")
    return both.select(key, count(name), count(other), origin.alias("same_origin"), F.coalesce(F.col("g") == F.col("h"), F.lit(False)).alias("conforms"))


def refined(clear: Column, bands: list[str], predict: Callable[[pd.DataFrame], pd.Series], most: float = 0.4) -> Column:
    """struct(clear, failed): clear and the model's chance of cloud under `most`. predict: the chances from a batch's bands. Where
    it fails on a batch's values, clear stays as it is and failed is true, to be counted; a fault of another kind (types, memory)
    stops the job. Pixels without a chance stay as they are."""

    def refine(mask: pd.Series, *values: pd.Series) -> pd.DataFrame:
        try:
            chance = predict(pd.DataFrame(dict(zip(bands, values, strict=True))))
        except (ArithmeticError, LookupError, RuntimeError, ValueError):
            return pd.DataFrame({"clear": mask, "failed": True})
        return pd.DataFrame({"clear": mask & ~(chance >= most), "failed": False})

    return F.pandas_udf(refine, "clear boolean, failed boolean")(F.coalesce(clear, F.lit(False)), *bands)


def refined_clear(clear: Column, bands: list[str], predict: Callable[[pd.DataFrame], pd.Series], most: float = 0.4) -> Column:
    """clear of refined()."""
    return refined(clear, bands, predict, most).getField("clear")
