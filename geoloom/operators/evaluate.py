"""Ranking metrics of a stated set of queries against all vectors, in blocks.

Blocks of vectors meet blocks of queries, and a task gives the k best of each query of such a pair, or extremes by label: what leaves
it is bounded by the blocks, and how many rows are relevant follows from counts of labels. Vectors have one length; rows without
one, or without vec_id, are left out. A row is its own query's neighbour never, by vec_id. A null label is relevant to nothing.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from geoloom.operators.aggregates import gain
from geoloom.operators.lineage import table

BLOCK, ASKED = 4096, 512


def _blocks(rows: DataFrame, size: int, prefix: str) -> DataFrame:
    """Rows (vec_id, entity_id, label, embedding) in blocks of at most size, as they lie."""

    def pack(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            for at in range(0, len(f), size):
                part = f.iloc[at : at + size]
                raw = np.array(part.embedding.tolist(), np.float64).tobytes()
                yield pd.DataFrame({f"{prefix}_ids": [part.vec_id.tolist()], f"{prefix}_names": [part.entity_id.tolist()], f"{prefix}_labels": [[None if pd.isna(x) else int(x) for x in part.label]], f"{prefix}_raw": [raw]})

    known = rows.select("vec_id", "entity_id", F.col("label").cast("long").alias("label"), "embedding").dropna(subset=["vec_id", "embedding"])
    return known.mapInPandas(pack, f"{prefix}_ids array<long>, {prefix}_names array<string>, {prefix}_labels array<long>, {prefix}_raw binary")


def against(vecs: DataFrame, queries: Column, step: Callable, schema: str) -> DataFrame:
    """step(query ids, ids, names, query labels, same, cosine) for each pair of blocks: same tells equal labels, and cosine, rounded to nine places, is
    NaN for a row with itself."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            for r in f.to_dict("records"):
                q, x = (np.frombuffer(r[f"{p}_raw"], np.float64).reshape(len(r[f"{p}_ids"]), -1) for p in "qv")
                cosine = q @ x.T / ((np.linalg.norm(q, axis=1) + 1e-7)[:, None] * (np.linalg.norm(x, axis=1) + 1e-7)[None, :])
                cosine = np.round(cosine, 9) + 0.0
                q_ids, ids = np.array(list(r["q_ids"])), np.array(list(r["v_ids"]))
                cosine[q_ids[:, None] == ids[None, :]] = np.nan
                q_labels, labels = (np.array([np.nan if v is None else v for v in r[f"{p}_labels"]], float) for p in "qv")
                yield step(q_ids, ids, np.array(list(r["v_names"]), object), q_labels, q_labels[:, None] == labels[None, :], cosine)

    pairs = _blocks(vecs, BLOCK, "v").crossJoin(_blocks(vecs.where(queries), ASKED, "q"))
    return pairs.mapInPandas(run, schema)


def neighbours(vecs: DataFrame, queries: Column, k: int, relevance: int = 3) -> DataFrame:
    """query_id, entity_id, rel, cosine, k: the k nearest others of each query in order, equal ones by entity_id. One with the query's
    label is relevant."""

    def best(q_ids, ids, names, q_labels, same, cosine) -> pd.DataFrame:
        out = []
        for i, q in enumerate(q_ids):
            c = np.where(np.isnan(cosine[i]), -3.0, cosine[i])
            least = np.partition(c, -k)[-k] if len(c) > k else -2.0
            some = np.flatnonzero(c >= max(least, -2.0))
            out.append(pd.DataFrame({"query_id": q, "entity_id": names[some], "rel": same[i][some].astype(int) * relevance, "cosine": c[some]}))
        return pd.concat(out)

    return first(against(vecs, queries, best, "query_id long, entity_id string, rel int, cosine double"), k)


def spreads(vecs: DataFrame, queries: Column) -> DataFrame:
    """label, spread: the greatest less the least cosine of the queries of a label with its other vectors."""

    def extremes(q_ids, ids, names, q_labels, same, cosine) -> pd.DataFrame:
        out = []
        for label in np.unique(q_labels[~np.isnan(q_labels)]):
            c = cosine[(q_labels == label)[:, None] & same & ~np.isnan(cosine)]
            if len(c):
                out.append((int(label), c.min(), c.max()))
        return pd.DataFrame(out, columns=["label", "least", "most"])

    found = against(vecs, queries, extremes, "label long, least double, most double")
    return found.groupBy("label").agg((F.max("most") - F.min("least")).alias("spread"))


def relevant(vecs: DataFrame, queries: Column) -> DataFrame:
    """query_id, hits, others: how many of the other vectors have a query's label, and how many there are, from counts."""
    known = vecs.dropna(subset=["vec_id", "embedding"])
    counts = known.groupBy("label").agg(F.count("*").alias("n"))
    asked = known.where(queries).select(F.col("vec_id").alias("query_id"), "label").join(counts.where("label IS NOT NULL"), "label", "left")
    return asked.select("query_id", F.coalesce(F.col("n") - 1, F.lit(0)).alias("hits"), F.lit(known.count() - 1).alias("others"))


def first(judged: DataFrame, k: int) -> DataFrame:
    """The first k neighbours of each query with their rank k."""
    w = Window.partitionBy("query_id").orderBy(F.desc("cosine"), "entity_id")
    return judged.withColumn("k", F.row_number().over(w)).where(F.col("k") <= k)


def ndcg(vecs: DataFrame, queries: Column, k: int, relevance: int = 3) -> DataFrame:
    """query_id, ndcg at k; 1 where nothing is relevant."""
    dcg = neighbours(vecs, queries, k, relevance).groupBy("query_id").agg(F.sum(gain(F.col("rel"), F.col("k"))).alias("dcg"))
    places = F.sequence(F.lit(1).cast("long"), F.least(F.col("hits"), F.lit(k).cast("long")))
    ideal = F.when(F.col("hits") > 0, F.aggregate(places, F.lit(0.0), lambda s, at: s + gain(F.lit(relevance), at))).otherwise(0.0)
    met = relevant(vecs, queries).where("others > 0").withColumn("idcg", ideal).join(dcg, "query_id")
    return met.select("query_id", F.when(F.col("idcg") > 0, F.col("dcg") / F.col("idcg")).otherwise(1.0).alias("ndcg"))


def recall(vecs: DataFrame, queries: Column, k: int) -> DataFrame:
    """query_id, recall at k, and the rank of the first hit, null if there is none to find. Queries without a hit among the first k
    are asked again for twice as many, until all are found."""
    counts, reach, out = table(relevant(vecs, queries).where("others > 0"), "relevant"), k, None
    left = counts.where("hits > 0").select("query_id")
    asked = table(neighbours(vecs, queries, k), "first-hits")
    found = asked.groupBy("query_id").agg(F.count_if(F.col("rel") > 0).alias("found"))
    while True:
        ranks = asked.where("rel > 0").groupBy("query_id").agg(F.min("k").cast("long").alias("first_hit"))
        out = ranks if out is None else out.unionByName(ranks)
        left = table(left.join(ranks, "query_id", "left_anti"), "unfound")
        if left.isEmpty():
            break
        reach *= 2
        some = vecs.join(left.select(F.col("query_id").alias("vec_id"), F.lit(True).alias("_asked")), "vec_id", "left")
        asked = table(neighbours(some, F.col("_asked"), reach), "first-hits")
    rows = counts.join(found, "query_id").join(out, "query_id", "left")
    return rows.select("query_id", (F.col("found") / F.greatest(F.lit(1), F.col("hits"))).alias("recall"), "first_hit")
