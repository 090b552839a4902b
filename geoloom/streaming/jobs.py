"""Structured Streaming over landed files: windows with watermarks, keyed state, merges by micro-batch."""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from geoloom.operators import temporal
from geoloom.operators.lineage import scratch
from geoloom.sources import sinks
from geoloom.sources.views import VIEWS

LATE = "1 day"


def landed(spark: SparkSession, sf_dir: str, table: str, columns: str, names: str | None = None) -> DataFrame:
    """A stream of a table's files in a folder (names: a glob for them); new files are new rows. A table may be a folder itself, of
    which all files count."""
    path = f"{sf_dir}/{table}.parquet"
    rows = spark.readStream.schema(spark.read.parquet(path).schema)
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    if names is None and at.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(at).isDirectory():
        return rows.parquet(path).selectExpr(*columns.split(", "))
    return rows.option("pathGlobFilter", names or f"{table}.parquet").parquet(sf_dir).selectExpr(*columns.split(", "))


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return landed(spark, sf_dir, "events", "event_id, user_id, event_type, value, ts").withColumn("ts", F.col("ts").cast("timestamp"))


def drained(stream: DataFrame, name: str, mode: str = "append") -> DataFrame:
    """What the stream gives for all files that have landed, through a file sink with a checkpoint."""
    spark = stream.sparkSession
    out = scratch(spark, name)
    query = stream.writeStream.format("parquet").outputMode(mode).option("path", out).option("checkpointLocation", scratch(spark, f"{name}-state")).trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(out)


def tumbling(stream: DataFrame, width: str = "1 hour", late: str = LATE) -> DataFrame:
    """Counts by window and type; a window is given once the watermark has passed its end, later rows are dropped."""
    w = stream.withWatermark("ts", late).groupBy(F.window("ts", width), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))
    return w.select(F.col("window.start").alias("window_start"), "event_type", "n", F.round("total", 2).alias("total"))


def sessions(stream: DataFrame, gap: str = "2 hours", late: str = LATE) -> DataFrame:
    s = stream.withWatermark("ts", late).groupBy(F.session_window("ts", gap), "user_id").agg(F.count("*").alias("n"))
    return s.select("user_id", F.col("session_window.start").alias("session_start"), "n")


def first_seen(stream: DataFrame, keys: tuple[str, ...] = ("user_id", "event_type"), base: str | None = None, state: str | None = None) -> DataFrame:
    """One row per key, however late a repeat comes. What was seen is a table in base, not state in memory: a batch adds the keys
    that no batch before it has, under its number, so that one which is repeated after a failure gives the same, and a new run with
    the same base and state goes on where the last one ended."""
    spark = stream.sparkSession
    base, state = base or scratch(spark, "first-seen"), state or scratch(spark, "first-seen-state")
    schema = ", ".join(f"{k} {t}" for k, t in stream.dtypes if k in keys) + ", batch long"
    spark.createDataFrame([], schema).write.mode("append").partitionBy("batch").parquet(base)

    def add(rows: DataFrame, number: int) -> None:
        seen = rows.sparkSession.read.schema(schema).parquet(base).where(F.col("batch") < number).drop("batch")
        new = rows.select(*keys).distinct().alias("n")
        on = [F.col(f"n.{k}").eqNullSafe(F.col(f"s.{k}")) for k in keys]
        new = new.join(seen.alias("s"), on, "left_anti").withColumn("batch", F.lit(number).cast("long"))
        new.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch").parquet(base)

    stream.writeStream.foreachBatch(add).option("checkpointLocation", state).trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(schema).parquet(base).select(*keys)


def online_baseline(stream: DataFrame) -> DataFrame:
    """The recursive baseline kept as state by cell, over batches as they come. Rows of a batch are put in order; a row is
    taken as it comes if an earlier one arrives in a later batch, and what state a cell has survives restarts."""

    def update(key: tuple, frames: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        cell = pickle.loads(state.get[0]) if state.exists else temporal.Online(1)
        rows, out = pd.concat(list(frames)).sort_values(["ts", "event_id"]), []
        for r in rows.itertuples():
            got = cell.observe(r.ts.date(), [r.value / 50], 0.70 + (r.event_id * 7 % 31) / 100)
            out.append({"user_id": key[0], "event_id": r.event_id, "obs_state": got["obs_state"], "z": got["z"], "cusum": got["cusum"]})
        state.update((pickle.dumps(cell),))
        yield pd.DataFrame(out)

    return stream.groupBy("user_id").applyInPandasWithState(update, "user_id long, event_id long, obs_state string, z double, cusum double", "model binary", "append", "NoTimeout")


ENTITY = "entity_id string, entity_type string, last_seen date"
#: Entities are dealt by their key to this many parts; a batch rewrites only the parts that it touches.
PARTS = 64


def current(spark: SparkSession, base: str, schema: str = ENTITY, before: int | None = None) -> DataFrame:
    """The table in base, with part: the last version of each part, of versions under `before` only if that is given."""
    rows = spark.read.schema(f"{schema}, part int, version long").parquet(base)
    if before is not None:
        rows = rows.where(F.col("version") < before)
    last = rows.groupBy("part").agg(F.max("version").alias("version"))
    return rows.join(F.broadcast(last), ["part", "version"]).drop("version")  # at most PARTS rows


def ingest(spark: SparkSession, sf_dir: str, base: str | None = None, state: str | None = None, files: str | None = None) -> DataFrame:
    """Entities merged by key from each micro-batch of landed vectors. A batch writes a new version of the parts it touches,
    made of versions before it only, so one that is repeated after a failure gives the same; with the same base and state a
    new run goes on where the last one ended. Of equal keys in a batch the one seen last counts."""
    base, state = base or scratch(spark, "entities"), state or scratch(spark, "entities-state")
    spark.createDataFrame([], f"{ENTITY}, part int, version long").write.mode("append").partitionBy("part", "version").parquet(base)

    def merge(batch: DataFrame, number: int) -> None:
        seen = batch.sparkSession.sql(VIEWS["entities"][1], t=batch).groupBy("entity_id").agg(F.max(F.struct("last_seen", "entity_type")).alias("x"))
        new = seen.select("entity_id", "x.entity_type", "x.last_seen", F.pmod(F.xxhash64("entity_id"), F.lit(PARTS)).cast("int").alias("part"))
        touched = F.broadcast(new.select("part").distinct())  # at most PARTS rows
        old = current(batch.sparkSession, base, before=number).join(touched, "part", "left_semi").select(*new.columns)
        out = sinks.merged(old, new, "entity_id").withColumn("version", F.lit(number).cast("long")).repartition("part")
        out.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("part", "version").parquet(base)

    stream = landed(spark, sf_dir, "embeddings", "vec_id, embedding, label", files)
    stream.writeStream.foreachBatch(merge).option("checkpointLocation", state).trigger(availableNow=True).start().awaitTermination()
    return current(spark, base).drop("part")


def status(query) -> dict:
    """Where a stream stands, from its last batch: batch, rows in, rows a second, watermark, rows of state."""
    last = query.lastProgress
    if last is None:
        return {"batch": None, "rows": 0, "rows_per_second": 0.0, "watermark": None, "state_rows": 0, "active": query.isActive}
    state = sum(s.numRowsTotal for s in last.stateOperators)
    return {"batch": last.batchId, "rows": last.numInputRows, "rows_per_second": last.processedRowsPerSecond, "watermark": last.eventTime.get("watermark"), "state_rows": state, "active": query.isActive}
