"""Learned re-ranking of a scene's entities."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from geoloom.functions import scalars
from geoloom.operators import rerank
from geoloom.plans.registry import query

FEATURES = ["change_confidence", "class_confidence", "spatial", "visual", "valid_fraction", "area_m2", "cloud_context"]


def reranked(a):
    """Entities of each scene by a ranker that the scenes with even numbers teach, beside the fixed weights. An entity is the more
    relevant the more of three marks it has: seen well, changed for sure, near a river though not in a road's way."""
    e = a.entities.withColumns({"spatial": F.exp(-F.col("river_distance_m") / 500), "visual": F.greatest(F.lit(0.0), F.col("ndvi_delta"))})
    marks = (F.col("valid_fraction") >= 0.85, F.col("change_confidence") >= 0.6, F.col("river_distance_m") < 600)
    e = e.withColumn("rel", sum((F.coalesce(m, F.lit(False)).cast("int") for m in marks), F.lit(0)))
    e = e.withColumn("held_out", F.substr("scene_id", F.lit(4)).cast("int") % 2 == 1)
    known = lambda c: F.coalesce(c, F.lit(0.0))
    fixed = scalars.ranking_score(*(known(F.col(c)) for c in ("change_confidence", "class_confidence", "spatial", "visual", "valid_fraction")))
    ranker = rerank.fit(e.where("NOT held_out"), FEATURES, "scene_id", "entity_id", rounds=12)
    out = rerank.scored(e.withColumn("fixed", fixed), ranker)
    w = Window.partitionBy("scene_id").orderBy(F.desc("score"), "entity_id")
    return out.select("scene_id", "entity_id", "rel", "held_out", "score", "fixed", F.row_number().over(w).alias("rank"))


@query("t_learned_rerank")
def _(a):
    """The first ten of each scene."""
    return reranked(a).where("rank <= 10").select("scene_id", "entity_id", F.round("score", 6).alias("score"), "rank")
