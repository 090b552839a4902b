"""Calibrated confidence: split-conformal thresholds by group, and thresholds that bound a risk; ranks by ranges of values.

- ``quantiles``: of the calibration rows of each group, the score that a further row of the group does not exceed with a chance of
  1 - alpha at least: the ceil((n + 1)(1 - alpha))-th least. Where a group has too few rows for that, no score is enough, and the
  threshold is infinite.
- ``prediction_sets``: for each row the classes whose score is within the class's threshold; the true class is among them with that
  chance, class by class.
- ``risk_threshold``: the least confidence from which on rows may be accepted, so that accepted wrong rows are at most a share alpha
  of all rows, with a chance of 1 - delta (Hoeffding's bound on the calibration rows).

Rows with a null group or score are left out. Calibration rows must not have been used to fit the scores.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from geoloom.operators.aggregates import counts_upto


def quantiles(rows: DataFrame, score: str, by: str, alpha: float) -> DataFrame:
    """by, n, threshold of the calibration rows (by, score)."""
    rows = rows.where(F.col(by).isNotNull() & F.col(score).isNotNull())
    # a whole product counts as whole, whatever its last digit
    rank = F.ceil((F.col("n") + 1) * F.lit(1 - alpha) - 1e-9)
    run = counts_upto(rows, score, by)
    found = run.groupBy(by).agg(F.any_value("n").alias("n"), F.min(F.when(F.col("upto") >= rank, F.col("v"))).alias("threshold"))
    return found.select(by, "n", F.coalesce(F.col("threshold").cast("double"), F.lit(math.inf)).alias("threshold"))


def prediction_sets(scores: DataFrame, thresholds: DataFrame, key: str, by: str, score: str = "score") -> DataFrame:
    """key, classes: for rows (key, by, score), a row for each class, the classes within their thresholds, in order."""
    met = scores.join(thresholds.select(by, "threshold"), by)
    return met.groupBy(key).agg(F.sort_array(F.collect_set(F.when(F.col(score) <= F.col("threshold"), F.col(by)))).alias("classes"))


def risk_threshold(rows: DataFrame, confidence: str, wrong: str, alpha: float, delta: float, by: str) -> DataFrame:
    """by, n, allowed, above: rows of a group whose confidence is greater than `above` may be accepted. allowed: how many wrong
    calibration rows may be among them; above is null where all may, and infinite where none."""
    rows = rows.where(F.col(by).isNotNull() & F.col(confidence).isNotNull())
    sizes = rows.groupBy(by).agg(F.count("*").alias("n"))
    allowed = F.floor(F.col("n") * (F.lit(alpha) - F.sqrt(F.lit(math.log(1 / delta) / 2) / F.col("n"))))
    sizes = sizes.withColumn("allowed", allowed.cast("long"))
    run = counts_upto(rows.where(F.coalesce(F.col(wrong), F.lit(False))), confidence, by).select(by, F.col("v").alias("x"), (F.col("n") - F.col("upto") + F.col("c")).alias("from"))
    # the greatest confidence from which on more than the allowed are wrong
    met = run.join(sizes.select(by, "allowed"), by).where(F.col("from") > F.col("allowed"))
    found = sizes.join(met.groupBy(by).agg(F.max("x").cast("double").alias("above")), by, "left")
    return found.select(by, "n", F.greatest("allowed", F.lit(0)).alias("allowed"), F.when(F.col("allowed") < 0, F.lit(math.inf)).otherwise(F.col("above")).alias("above"))
