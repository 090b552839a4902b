"""Detections of a stream matched with known entities by the overlap of their boxes: known ones are updated, others added.

Each micro-batch writes what it changes only, as a delta under its number, and the observations of entities as tracks under the
same number. It reads numbers before its own only, so a batch that is repeated after a failure writes the same again. Every few
batches the table is written whole as a snapshot; one counts once its row is in `snapshots`, written after it, so a torn one is never
read. `clear` removes what no reader needs after that.

Detections of a batch are matched with entities known before the batch, each with the one that it overlaps most. An entity keeps
the box that it was first seen with. Detections without a key or box corner are left out; repeats of a key in a batch count once,
the one seen last; a detection that an earlier batch has taken is taken again, as a further observation.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from geoloom.operators import geo

ENTITY = "entity_id string, entity_type string, x1 double, y1 double, x2 double, y2 double, last_seen date, n_matched long"
TRACK = "entity_id string, detection_id string, seen date, iou double"
NAMES = [c.split()[0] for c in ENTITY.split(", ")]
BOX = ["x1", "y1", "x2", "y2"]


def _read(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The table there, by version; empty if nothing has been written."""
    try:
        return spark.read.schema(f"{schema}, version long").parquet(path)
    except AnalysisException as missing:
        if missing.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], f"{schema}, version long")


def _write(rows: DataFrame, path: str, version: int) -> None:
    rows.withColumn("version", F.lit(version).cast("long")).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("version").parquet(path)


def _snapshot(spark: SparkSession, base: str, before: int | None) -> int | None:
    done = _read(spark, f"{base}/snapshots", "rows long")
    return done.where(F.lit(True) if before is None else F.col("version") < before).agg(F.max("version")).first()[0]


def current(spark: SparkSession, base: str, before: int | None = None) -> DataFrame:
    """The entities after all batches, or after those numbered under `before`: the last snapshot and the deltas after it."""
    deltas = _read(spark, f"{base}/deltas", ENTITY)
    if before is not None:
        deltas = deltas.where(F.col("version") < before)
    last = _snapshot(spark, base, before)
    if last is not None:
        deltas = deltas.where(F.col("version") > last).unionByName(_read(spark, f"{base}/whole", ENTITY).where(F.col("version") == last))
    newest = deltas.groupBy("entity_id").agg(F.max_by(F.struct(*NAMES[1:]), "version").alias("e"))
    return newest.select("entity_id", *(f"e.{c}" for c in NAMES[1:]))


def tracks(spark: SparkSession, base: str) -> DataFrame:
    """entity_id, detection_id, seen, iou, version: all observations, a new entity's own with a null iou."""
    return _read(spark, f"{base}/tracks", TRACK)


def compact(spark: SparkSession, base: str, version: int) -> None:
    """A snapshot of all batches up to `version`."""
    _write(current(spark, base, version + 1), f"{base}/whole", version)
    _write(_read(spark, f"{base}/whole", ENTITY).where(F.col("version") == version).agg(F.count("*").alias("rows")), f"{base}/snapshots", version)


def clear(spark: SparkSession, base: str) -> list[int]:
    """Removes deltas up to the last snapshot but one, and the snapshots before that; a reader that began under the last one but
    one goes on. Versions that are gone."""
    done = sorted(r.version for r in _read(spark, f"{base}/snapshots", "rows long").select("version").collect())
    if len(done) < 2:
        return []
    keep, gone = done[-2], set()
    fs_path = spark._jvm.org.apache.hadoop.fs.Path
    for name, old in (("snapshots", lambda v: v < keep), ("whole", lambda v: v < keep), ("deltas", lambda v: v <= keep)):
        folder = fs_path(f"{base}/{name}")
        fs = folder.getFileSystem(spark._jsc.hadoopConfiguration())
        for entry in fs.listStatus(folder):
            label, _, number = entry.getPath().getName().partition("=")
            if label == "version" and old(int(number)):
                fs.delete(entry.getPath(), True)
                gone.add(int(number))
    return sorted(gone)


def _around(known: DataFrame, found: DataFrame, size: float) -> DataFrame:
    """The known entities in cells that a detection touches."""
    span = lambda lo, hi: F.explode(F.sequence(F.floor(F.col(lo) / size), F.floor(F.col(hi) / size)))
    cells = lambda t: t.withColumn("cx", span("x1", "x2")).withColumn("cy", span("y1", "y2"))
    touched = cells(found.select("entity_type", *BOX)).select("entity_type", "cx", "cy").distinct()
    return cells(known).join(touched, ["entity_type", "cx", "cy"], "left_semi").drop("cx", "cy").dropDuplicates(["entity_id"])


def merge(found: DataFrame, base: str, number: int, least_iou: float = 0.3, size: float = 3000.0, compact_every: int = 16) -> None:
    """One batch of detections (entity_id, entity_type, x1, y1, x2, y2, seen) into the table in base, as number `number`."""
    spark = found.sparkSession
    found = found.select("entity_id", "entity_type", *BOX, "seen").dropna(subset=["entity_id", *BOX])
    last = Window.partitionBy("entity_id").orderBy(F.desc_nulls_last("seen"), *BOX)
    found = found.withColumn("k", F.row_number().over(last)).where("k = 1").drop("k")
    known = current(spark, base, number)
    matches = geo.best_matches(found, _around(known, found, size), least_iou, size=size)
    found = found.join(matches, "entity_id", "left")
    _write(found.select(F.coalesce("match", "entity_id").alias("entity_id"), F.col("entity_id").alias("detection_id"), "seen", "iou"), f"{base}/tracks", number)
    # what follows reads the tracks as written, so both tables tell of the same matches
    told = tracks(spark, base).where(F.col("version") == number)
    seen = told.groupBy("entity_id").agg(F.max("seen").alias("seen"), F.count("iou").alias("hits"))
    updated = known.join(seen, "entity_id").select(*NAMES[:-2], F.greatest("last_seen", "seen").alias("last_seen"), (F.col("n_matched") + F.col("hits")).alias("n_matched"))
    new = found.where(F.col("match").isNull()).join(known.select("entity_id"), "entity_id", "left_anti")
    new = new.join(seen.select("entity_id", "hits", F.col("seen").alias("last_seen")), "entity_id")
    _write(updated.unionByName(new.select(*NAMES[:-1], F.col("hits").alias("n_matched"))), f"{base}/deltas", number)
    if compact_every and (number + 1) % compact_every == 0:
        compact(spark, base, number)


def seed(known: DataFrame, base: str) -> None:
    """Entities (entity_id, entity_type, x1, y1, x2, y2, last_seen) that are there before the first batch."""
    _write(known.select(*NAMES[:-1], F.lit(0).cast("long").alias("n_matched")), f"{base}/deltas", -1)


def ingest(detections: DataFrame, base: str, state: str, least_iou: float = 0.3, size: float = 3000.0, compact_every: int = 16) -> DataFrame:
    """All detections that have landed, merged batch by batch; with the same base and state a new run goes on where the last one
    ended, also one that was killed."""
    spark = detections.sparkSession
    query = detections.writeStream.foreachBatch(lambda rows, number: merge(rows, base, number, least_iou, size, compact_every))
    query.option("checkpointLocation", state).trigger(availableNow=True).start().awaitTermination()
    return current(spark, base)
