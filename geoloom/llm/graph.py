"""Connected components of an edge table by least labels, with tables written between the rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from geoloom.llm.common import written


def components(edges: DataFrame) -> DataFrame:
    """(a, b), of any ordered type -> (v, component): for each vertex with an edge the least vertex that it reaches.

    Each round every vertex takes the least label around it, then the label of its label, so that paths shorten at least by
    half; the rounds end when no label changes. Only a count per round reaches the driver.
    """
    both = written(edges.select("a", "b").union(edges.select("b", "a")).where("a <> b").distinct(), "edges")
    labels = written(both.groupBy(F.col("a").alias("v")).agg(F.least(F.first("a"), F.min("b")).alias("component")), "labels")
    while True:
        near = both.join(labels.select(F.col("v").alias("b"), "component"), "b").groupBy(F.col("a").alias("v")).agg(F.min("component").alias("near"))
        step = labels.join(near, "v").select("v", "component", F.least("component", "near").alias("next"))
        jump = labels.select(F.col("v").alias("next"), F.col("component").alias("far"))
        step = written(step.join(jump, "next", "left").select("v", "component", F.least("next", F.coalesce("far", "next")).alias("next")), "labels")
        changed = step.where("next <> component").limit(1).count()
        labels = step.select("v", F.col("next").alias("component"))
        if not changed:
            return labels
