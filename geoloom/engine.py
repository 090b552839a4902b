"""The archive's functions for applications, each a lazy DataFrame over one Archive."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from geoloom.operators import discovery, temporal, vectors
from geoloom.plans.dsl import LAYERS, Plan, execute, parse, stage_order
from geoloom.sources import sinks
from geoloom.sources.config import Settings
from geoloom.sources.views import Archive


class Engine:
    """encode: gives a table of one row with the vector q for a text; without it, plans are ranked around a given entity.
    settings: ranking weights, limits of the break search and feedback factors (sources.config.load)."""

    def __init__(self, spark: SparkSession, sf_dir: str, encode=None, settings: Settings | None = None):
        self.archive, self.encode, self.settings = Archive(spark, sf_dir), encode, settings or Settings()

    def compile(self, text: str) -> Plan:
        return parse(text)

    def explain(self, plan: Plan) -> list[str]:
        return stage_order(plan)

    def vector(self, entity_id: str) -> DataFrame:
        return self.archive.vectors.where(F.col("entity_id") == entity_id).select(F.col("embedding").alias("q"))

    def execute(self, plan: Plan, like: str | None = None, explain_top: int = 5) -> DataFrame:
        """like: the entity to rank around; otherwise the plan's text is encoded, which takes an encoder."""
        if like is None and self.encode is None:
            raise ValueError("a text needs an encoder, or an entity to rank around")
        query = self.vector(like) if like is not None else self.encode(plan.semantic_query)
        return execute(self.archive.entities, self.archive.vectors, plan, query, explain_top=explain_top, weights=self.settings.weights)

    def search(self, text: str, aoi: tuple[tuple[float, float], ...] = (), limit: int = 20, explain_top: int = 5, like: str | None = None) -> DataFrame:
        return self.execute(replace(self.compile(text), aoi=aoi, limit=limit), like, explain_top)

    def entity(self, entity_id: str) -> DataFrame:
        return self.archive.entities.where(F.col("entity_id") == entity_id)

    def timeline(self, cell_id: str) -> DataFrame:
        """The cell's points in order, and its break, if one is found, on each of them."""
        points = temporal.indexed(self.archive.trajectory.where(F.col("cell_id") == cell_id))
        s = self.settings
        found = temporal.breaks(self.archive.trajectory.where(F.col("cell_id") == cell_id), min_obs=s.min_obs, drift=s.drift, limit=s.limit).select("cell_id", "lower", "upper", "interval_days")
        return points.join(found, "cell_id", "left").select("cell_id", "i", "obs_date", "z", "valid_fraction", "ndvi", "lower", "upper", F.when(F.col("upper").isNotNull(), "REGIME_CHANGE_DETECTED").otherwise("STABLE").alias("status"), "interval_days")

    def similar(self, entity_id: str, k: int = 10, exclude_self: bool = True) -> DataFrame:
        others = self.archive.vectors.where(F.col("entity_id") != entity_id) if exclude_self else self.archive.vectors
        return vectors.top_k(others.select("entity_id", "embedding"), self.vector(entity_id), k).select("entity_id", "cosine")

    def similar_sites(self, seeds: list[str], k: int = 15) -> DataFrame:
        seed = F.col("entity_id").isin(seeds)
        centre = vectors.mean_vector(self.archive.vectors.where(seed)).withColumnRenamed("mean", "q")
        return vectors.top_k(self.archive.vectors.where(~seed).select("entity_id", "embedding"), centre, k).select("entity_id", "cosine")

    def refined(self, query: DataFrame, liked: list[str], disliked: list[str], k: int = 15) -> DataFrame:
        """The nearest entities to query (one row with q) after feedback; the judged ones are left out."""
        centre = lambda ids, name: vectors.mean_vector(self.archive.vectors.where(F.col("entity_id").isin(ids))).withColumnRenamed("mean", name)
        at = vectors.with_row(vectors.with_row(query, centre(liked, "p")), centre(disliked, "n"))  # one row each
        moved = at.select(vectors.rocchio(F.col("q"), F.col("p"), F.col("n"), *self.settings.rocchio).alias("q"))
        others = self.archive.vectors.where(~F.col("entity_id").isin(liked + disliked))
        return vectors.top_k(others.select("entity_id", "embedding"), moved, k).select("entity_id", "cosine")

    def co_change(self, max_days: int = 21) -> DataFrame:
        return discovery.co_change_edges(self.archive.entities, max_days)

    def export(self, results: DataFrame) -> DataFrame:
        """Results with rank as GeoJSON features, in rank order; entities that are gone are left out."""
        found = self.archive.entities.join(results.select("entity_id", "rank"), "entity_id")
        return found.orderBy("rank").select("rank", sinks.geojson_feature().alias("feature"))

    def layer(self, name: str) -> DataFrame:
        if name not in LAYERS.values():
            raise ValueError(f"unknown layer {name}")
        return self.archive.segments.where(F.col("layer") == name)

    def verdict(self, ledger: DataFrame, entry: DataFrame) -> DataFrame:
        """The ledger with an entry appended to its chain."""
        last = ledger.orderBy(F.desc("log_id")).limit(1).select("entry_hash").first()
        return ledger.unionByName(sinks.chained(entry, last.entry_hash if last else sinks.GENESIS))
