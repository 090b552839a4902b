"""Sources, sinks and streams end to end (S06-S10, K03-K12, ST1-ST6)."""

from __future__ import annotations

from pyspark.sql import functions as F

from geoloom.operators.lineage import scratch
from geoloom.plans.registry import query
from geoloom.sources import documents, sinks
from geoloom.streaming import jobs


@query("s06_k10_json_documents", "SELECT entity_id, entity_type, lon FROM entities")
def _(a):
    path = scratch(a.spark, "entities-json")
    part = F.floor(F.col("vec_id") / 1000).alias("part")  # a document has the entities of a scene and of a thousand ids at most
    a.entities.groupBy("scene_id", part).agg(F.collect_list(F.struct("entity_id", "entity_type", "lon")).alias("entities")).write.json(path)
    return documents.json_rows(a.spark, path, "entities", "entity_id: string, entity_type: string, lon: double")


@query("s07_k03_geojson_layer", "SELECT ref_id, name, x1, y2 FROM segments")
def _(a):
    path = scratch(a.spark, "layer")
    line = F.struct(F.lit("LineString").alias("type"), F.array(F.array("x1", "y1"), F.array("x2", "y2")).alias("coordinates"))
    feature = F.struct(F.lit("Feature").alias("type"), F.struct("ref_id", "name").alias("properties"), line.alias("geometry"))
    part = F.floor(F.monotonically_increasing_id() / 1000).alias("part")  # a collection has a thousand features at most
    a.segments.groupBy("layer", part).agg(F.collect_list(feature).alias("features")).drop("part").write.json(path)
    layer = documents.geojson_layer(a.spark, path, "ref_id: string, name: string")
    return layer.select("ref_id", "name", F.col("geom")[0].lon.alias("x1"), F.col("geom")[1].lat.alias("y2"))


@query("s08_k11_vector_files", "SELECT entity_id, len(embedding) AS dims FROM vectors")
def _(a):
    path = scratch(a.spark, "vectors")
    a.vectors.select("entity_id", "embedding").write.parquet(path)
    return a.spark.read.parquet(path).select("entity_id", F.size("embedding").alias("dims"))


@query("s09_s10_catalogue_search", "SELECT scene_id, relative_orbit FROM scenes WHERE band_letter = 'F' AND cloud_cover < 15 AND relative_orbit >= 2")
def _(a):
    path = scratch(a.spark, "catalogue")
    a.scenes.select("scene_id", F.col("band_letter").alias("collection"), "cloud_cover", "relative_orbit").write.json(path)
    found = documents.catalogue(a.spark, path)
    return found.where((F.col("collection") == "F") & (F.col("cloud_cover") < 15.0) & (F.col("relative_orbit") >= 2)).select("scene_id", "relative_orbit")


@query("k04_relations_by_kind", "SELECT entity_id, change_type AS relation, CASE WHEN change_type = 'clearance' THEN 1 ELSE 0 END AS version FROM entities")
def _(a):
    path = scratch(a.spark, "relations")
    rows = a.entities.select("entity_id", F.lit(0).alias("version"), F.col("change_type").alias("relation"))
    sinks.write_relations(rows, path)
    sinks.write_relations(rows.where("relation = 'clearance'").withColumn("version", F.lit(1)), path)
    return a.spark.read.parquet(path).select("entity_id", "relation", "version")


@query("k12_partitioned_trajectories", "SELECT substr(cell_id, 1, 7) AS cell_prefix, count(*) AS n, count(DISTINCT cell_id) AS cells FROM trajectory WHERE starts_with(cell_id, 'CELL_1') GROUP BY ALL")
def _(a):
    path = scratch(a.spark, "trajectories")
    sinks.write_trajectory(a.trajectory.select("cell_id", "seq", "z"), path)
    t = a.spark.read.schema("cell_id string, seq long, z double, cell_prefix string").parquet(path)
    return t.where(F.startswith("cell_prefix", F.lit("CELL_1"))).groupBy("cell_prefix").agg(F.count("*").alias("n"), F.count_distinct("cell_id").alias("cells"))


@query("st_tumbling_windows", "SELECT window_start, event_type, n, total FROM (SELECT time_bucket(interval 1 hour, ts) AS window_start, event_type, count(*) AS n, round(sum(value), 2) AS total FROM events GROUP BY ALL), (SELECT max(ts) AS last FROM events) WHERE window_start + interval 1 hour <= date_trunc('milliseconds', last) - interval 1 day")
def _(a):
    return jobs.drained(jobs.tumbling(jobs.events(a.spark, a.sf_dir)), "tumbling").withColumn("window_start", F.col("window_start").cast("timestamp_ntz"))


@query("st_sessions", """WITH g AS (SELECT user_id, ts, (ts > lag(ts) OVER (PARTITION BY user_id ORDER BY ts) + interval 2 hours)::INT AS gap FROM events), s AS (SELECT user_id, ts, sum(coalesce(gap, 0)) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM g),
c AS (SELECT user_id, min(ts) AS session_start, max(ts) AS session_end, count(*) AS n FROM s GROUP BY user_id, k) SELECT user_id, session_start, n FROM c, (SELECT max(ts) AS last FROM events) WHERE session_end + interval 2 hours <= date_trunc('milliseconds', last) - interval 1 day""")
def _(a):
    return jobs.drained(jobs.sessions(jobs.events(a.spark, a.sf_dir)), "sessions").withColumn("session_start", F.col("session_start").cast("timestamp_ntz"))


@query("st4_deduplicated", "SELECT DISTINCT user_id, event_type FROM events")
def _(a):
    return jobs.first_seen(jobs.events(a.spark, a.sf_dir))


@query("st1_st5_online_baseline", None)
def _(a):
    """The keyed state of each cell over the stream (checked against the batch baseline in tests)."""
    return jobs.drained(jobs.online_baseline(jobs.events(a.spark, a.sf_dir)), "online").select("user_id", "event_id", "obs_state", F.round("z", 6).alias("z"), F.round("cusum", 6).alias("cusum"))


@query("st2_incremental_ingest", "SELECT entity_id, entity_type, last_seen FROM entities")
def _(a):
    return jobs.ingest(a.spark, a.sf_dir)
