"""Writers: keyed merges, partitioned trajectories, layers, GeoJSON, hash-chained ledgers."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def geojson_feature(properties: tuple[str, ...] = ("entity_id", "entity_type")) -> Column:
    point = F.struct(F.lit("Point").alias("type"), F.array(F.round("lon", 4).cast("decimal(9,4)"), F.round("lat", 4).cast("decimal(9,4)")).alias("coordinates"))
    return F.to_json(F.struct(F.lit("Feature").alias("type"), F.struct(*properties).alias("properties"), point.alias("geometry")))


def merged(existing: DataFrame, new: DataFrame, *key: str) -> DataFrame:
    """existing with rows replaced by, or added from, new; the last of equal keys in new must be unique."""
    return existing.join(new.select(*key), list(key), "left_anti").unionByName(new)


def only_new(existing: DataFrame, new: DataFrame, *key: str) -> DataFrame:
    """Rows of new whose key does not exist yet: an insert that ignores conflicts."""
    return new.join(existing.select(*key), list(key), "left_anti")


def registered(cache: DataFrame, new: DataFrame, key: str, ttl: str, now: Column) -> DataFrame:
    """A cache of results (key, last_access, ..) with new ones in place of those of their key, without what wasn't asked for
    within ttl before now."""
    return merged(cache, new, key).where(F.col("last_access") >= now - F.expr(f"interval {ttl}"))


def write_trajectory(df: DataFrame, path: str, cell: str = "cell_id", prefix: int = 7) -> None:
    """Parquet by cell prefix; rows of a prefix are brought together first, so that each folder gets few files."""
    df.withColumn("cell_prefix", F.substring(cell, 1, prefix)).repartition("cell_prefix").sortWithinPartitions(cell).write.mode("append").partitionBy("cell_prefix").parquet(path)


def write_relations(df: DataFrame, path: str) -> None:
    """Relations by kind; only the kinds that df has are replaced."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("relation").parquet(path)


GENESIS = "0" * 64


def entry_text(prev: Column) -> Column:
    """What an entry's hash covers: keys in order, and the hash before."""
    return F.to_json(F.struct("action", "actor", "entity_id", "log_id", "payload", prev.alias("prev_hash")))


def chained(df: DataFrame, prev_hash: str = GENESIS, chain: str | None = None) -> DataFrame:
    """df with prev_hash and entry_hash in order of log_id. A chain is serial by its nature: one batch, or one `chain`
    value, passes through one task, in order and in batches of rows; only the last hash is carried from row to row."""
    key = F.col(chain).cast("string") if chain else F.lit("")
    # prev_hash is the last key and hex, so the text of an entry is that with an empty one, and the hash put in
    rows = df.select(key.alias("chain"), "log_id", entry_text(F.lit("")).alias("text"))
    rows = (rows.repartition("chain") if chain else rows.coalesce(1)).sortWithinPartitions("chain", "log_id")

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at, last = (), prev_hash  # no chain equals ()
        for f in frames:
            out = []
            for of, log_id, text in f.itertuples(index=False):
                if of != at:
                    at, last = of, prev_hash
                digest = hashlib.sha256((text[:-2] + last + '"}').encode()).hexdigest()
                out.append((log_id, last, digest))
                last = digest
            yield pd.DataFrame(out, columns=["log_id", "prev_hash", "entry_hash"])

    return df.join(rows.mapInPandas(run, "log_id long, prev_hash string, entry_hash string"), "log_id")


def verify_chain(ledger: DataFrame, chain: str | None = None) -> DataFrame:
    """Per entry: whether it links to the one before and whether its hash is that of its text."""
    w = Window.partitionBy(*([chain] if chain else [F.lit(0)])).orderBy("log_id")
    linked = F.col("prev_hash") == F.lag("entry_hash", 1, GENESIS).over(w)
    return ledger.select("log_id", *([chain] if chain else []), linked.alias("linked"), (F.sha2(entry_text(F.col("prev_hash")), 256) == F.col("entry_hash")).alias("intact"))
