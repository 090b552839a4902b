"""Streams with typed state: trajectories, detections matched with entities, pairs of two streams (ST1, ST2, ST5, J08)."""

from __future__ import annotations

from pyspark.sql import functions as F

from geoloom.operators import geo
from geoloom.operators.lineage import scratch
from geoloom.plans.registry import query
from geoloom.plans.sets import MATCHED
from geoloom.sources.views import VIEWS
from geoloom.streaming import entities, jobs, tracks


def observations(a, names: str | None = None):
    rows = jobs.landed(a.spark, a.sf_dir, "events", "event_id, user_id, event_type, value, ts", names)
    return a.spark.sql(VIEWS["trajectory"][1], t=rows).withColumn("ts", F.col("ts").cast("timestamp"))


@query("st1_trajectory_stream")
def _(a):
    """The recursive baseline of each cell in order of time, as far as the watermark has come (checked against the batch way)."""
    rows = observations(a).withColumn("values", F.array(F.col("value") / 50))
    out = jobs.drained(tracks.trajectories(rows, 1), "tracks")
    return out.select("cell_id", "seq", "obs_state", F.round("z", 6).alias("z"), F.round("cusum", 6).alias("cusum"), "interval_days")


def detections(a, names: str | None = None):
    """Vectors as they land, with the boxes of their entities."""
    rows = jobs.landed(a.spark, a.sf_dir, "embeddings", "vec_id, embedding, label", names)
    return boxed(a.spark.sql(VIEWS["entities"][1], t=rows))


def boxed(rows):
    box = geo.boxes(rows.withColumn("area_m2", F.col("area_m2") * 400))
    return box.select("entity_id", "entity_type", "x1", "y1", "x2", "y2", F.col("last_seen").alias("seen"), "vec_id")


@query("st2_detection_stream", MATCHED)
def _(a):
    """A third of the entities streams in as detections, which are matched by overlap with the others."""
    base, state = scratch(a.spark, "detections"), scratch(a.spark, "detections-state")
    entities.seed(boxed(a.entities).where("vec_id % 3 <> 0").withColumnRenamed("seen", "last_seen"), base)
    out = entities.ingest(detections(a).where("vec_id % 3 = 0"), base, state)
    return out.select("entity_id", "last_seen", "n_matched")


@query("st_j08_paired_streams", """SELECT l.cell_id, l.seq AS optical, r.seq AS radar FROM trajectory l JOIN trajectory r ON l.cell_id = r.cell_id AND r.ts >= l.ts - interval 6 hours AND r.ts <= l.ts + interval 6 hours
WHERE l.sensor = 'sentinel-2' AND r.sensor = 'sentinel-1'""")
def _(a):
    """Observations of a cell by both sensors within six hours of each other."""
    side = lambda sensor: observations(a).where(F.col("sensor") == sensor).select("cell_id", "seq", "ts")
    out = tracks.paired(side("sentinel-2"), side("sentinel-1"), ["cell_id"], "6 HOURS")
    return jobs.drained(out.select("l.cell_id", F.col("l.seq").alias("optical"), F.col("r.seq").alias("radar")), "pairs")
