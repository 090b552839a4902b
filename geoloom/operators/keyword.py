"""Keyword search over descriptions: a written inverted index with positions, BM25, blocks left out by upper bounds, phrases.

Every write adds a segment: documents are dealt by a hash of their id to blocks of about BLOCK, and a row of the index holds what a
term has in a block (term, segment, block, docs), in folders by a hash of the term, so a search reads the folders of its terms only.
A document lies in one block, so the bounds of a block's rows, from the highest count and the least length in each, add up to a bound
of all scores in it. A search brings shares of the different sets of terms that are asked for together with shares of the blocks, so
postings are sent once for each SETS sets, and nothing is sent for a pair of query and document but the k best of a share. A block
whose bound is under the k-th score that its share has found for a set is left out; it holds nothing for the result, which is that of
scoring all documents.

New documents are a further segment; counts of documents and of terms are sums over segments, so nothing is rebuilt. An id is
written once. Terms are runs of ASCII letters and digits in lower case; null texts have none; a query counts a term once.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from geoloom.operators.lineage import table
from geoloom.operators.vector_index import best_of

K1, B = 1.2, 0.75
BLOCK = 2048
BUCKETS = 64
#: Sets of terms and documents that meet in a task, but for chance, and shares of documents at least.
SETS, DOCS, SHARES = 4096, 32_768, 6
POSTINGS = "term string, segment long, block int, docs array<struct<id: string, tf: int, length: int, places: array<int>>>, most int, least int, bucket int"
STATS = "segment long, n long, length long"


def terms(text: Column | str) -> Column:
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit("([a-z0-9]+)"), F.lit(1))


def write(docs: DataFrame, path: str, segment: int, key: str = "id", text: str = "text", block: int = BLOCK) -> None:
    """Adds docs (key, text) to the index under path as a segment; one that is written again replaces itself."""
    words = docs.select(F.col(key).cast("string").alias("id"), terms(F.col(text)).alias("words"))
    n, length = words.agg(F.count("*"), F.coalesce(F.sum(F.size("words")), F.lit(0))).first()
    blocks = max(1, math.ceil(n / block))
    rows = words.select("id", F.size("words").alias("length"), F.posexplode("words").alias("place", "term"))
    counts = rows.groupBy("term", "id", "length").agg(F.count("*").cast("int").alias("tf"), F.sort_array(F.collect_list("place")).alias("places"))  # of one document
    entry = F.struct("id", "tf", "length", "places")
    held = counts.groupBy("term", F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("int").alias("block"))
    out = held.agg(F.sort_array(F.collect_list(entry)).alias("docs"), F.max("tf").alias("most"), F.min("length").alias("least"))  # at most a block's documents
    out = out.withColumns({"segment": F.lit(segment).cast("long"), "bucket": F.pmod(F.xxhash64("term"), F.lit(BUCKETS)).cast("int")})
    out = out.select("term", "block", "docs", "most", "least", "bucket", "segment").repartition("bucket").sortWithinPartitions("bucket", "term")
    spark = docs.sparkSession
    out.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("segment", "bucket").parquet(f"{path}/postings")
    stats = spark.createDataFrame([(segment, n, length)], STATS)
    stats.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("segment").parquet(f"{path}/stats")


def _postings(spark: SparkSession, path: str, asked: DataFrame) -> DataFrame:
    """The postings of the terms in asked (term)."""
    buckets = [r.b for r in asked.select(F.pmod(F.xxhash64("term"), F.lit(BUCKETS)).cast("int").alias("b")).distinct().collect()]  # BUCKETS at most
    return spark.read.schema(POSTINGS).parquet(f"{path}/postings").where(F.col("bucket").isin(buckets)).join(asked.select("term").distinct(), "term", "left_semi")


def _block(rows: list[tuple], mean: float) -> tuple[np.ndarray, dict[str, tuple[np.ndarray, np.ndarray]]]:
    """The ids of a block's documents in order, and by term the places of its documents among these and what they gain by it."""
    ids, at = np.unique(np.concatenate([np.array(r[2].to_pylist(), object) for r in rows]), return_inverse=True)
    gains, k = {}, 0
    for term, idf, held, tf, length in rows:
        tf, length = tf.to_numpy().astype(float), length.to_numpy()
        gains[term] = at[k : k + len(held)], idf * tf * (K1 + 1) / (tf + K1 * (1 - B + B * length / mean))
        k += len(held)
    return ids, gains


def _found(sets: pa.Table, postings: pa.Table, mean: float, k: int) -> pa.Table:
    """asked, id, score of the k best documents of each set of terms in blocks of postings."""
    names = ["asked", "id", "score"]
    keys, blocks = sets["asked"].to_pylist(), {}
    for c in postings.to_batches():
        columns = [c.column(n) for n in ("ids", "tfs", "lengths")]
        for i, key in enumerate(zip(*(c.column(n).to_pylist() for n in ("segment", "block", "term", "idf")), strict=True)):
            blocks.setdefault(key[:2], []).append((*key[2:], *(x[i].values for x in columns)))
    least, out = np.full(len(keys), -1.0), []
    for _, rows in sorted(blocks.items(), key=lambda x: x[0]):
        ids, gains = _block(rows, mean)
        most = {t: float(g.max()) for t, (_, g) in gains.items()}
        for n, key in enumerate(keys):
            met = [t for t in key.split(" ") if t in gains]
            if not met or sum(most[t] for t in met) < least[n] - 1e-6:
                continue
            score = np.zeros(len(ids))
            for t in met:
                at, gain = gains[t]
                score[at] += gain
            hit = np.flatnonzero(score > 0)
            score = np.round(score[hit], 9)
            if len(hit) > k:
                some = score >= max(least[n], np.partition(score, len(hit) - k)[len(hit) - k])
                hit, score = hit[some], score[some]
            top = np.lexsort((hit, -score))[:k]  # ids are in order
            if len(top) == k:
                least[n] = max(least[n], score[top[-1]])
            out.append((np.full(len(top), n), ids[hit[top]], score[top]))
    if not out:
        return pa.table([pa.array([], pa.string()), pa.array([], pa.string()), pa.array([], pa.float64())], names=names)
    of, ids, score = (np.concatenate(c) for c in zip(*out, strict=True))
    top = best_of(of, score, np.unique(ids, return_inverse=True)[1], k)
    return pa.table([pa.array([keys[n] for n in of[top]], pa.string()), pa.array(ids[top], pa.string()), pa.array(score[top])], names=names)


def search(spark: SparkSession, path: str, queries: DataFrame, k: int) -> DataFrame:
    """query_id, id, score, rank: the k documents of highest BM25 score for each query (query_id, text); ties go to the least id."""
    n, length = spark.read.schema(STATS).parquet(f"{path}/stats").agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.sum("length"), F.lit(0))).first()
    mean = max(length, 1) / max(n, 1)
    # queries of the same terms are asked once; terms have no spaces
    asked = table(queries.select("query_id", F.array_join(F.sort_array(F.array_distinct(terms("text"))), " ").alias("asked")).where("asked <> ''"), "asked")
    sets = asked.select("asked").distinct()
    found = _postings(spark, path, sets.select(F.explode(F.split("asked", " ")).alias("term")))
    df = found.select("term", F.size("docs.tf").alias("n")).groupBy("term").agg(F.sum("n").alias("df"))
    idf = F.log(1 + (F.lit(float(n)) - F.col("df") + 0.5) / (F.col("df") + 0.5))
    groups, shares = max(1, -(-sets.count() // SETS)), max(SHARES, -(-n // DOCS))
    every = lambda name, m: F.explode(F.sequence(F.lit(0), F.lit(m - 1))).alias(name)
    left = sets.select("asked", F.pmod(F.xxhash64("asked"), F.lit(groups)).cast("int").alias("g"), every("s", shares))
    right = found.select("term", "segment", "block", F.col("docs.id").alias("ids"), F.col("docs.tf").alias("tfs"), F.col("docs.length").alias("lengths")).join(df.select("term", idf.alias("idf")), "term")
    right = right.select("*", F.pmod(F.xxhash64("segment", "block"), F.lit(shares)).cast("int").alias("s"), every("g", groups))
    best = left.groupBy("s", "g").cogroup(right.groupBy("s", "g")).applyInArrow(lambda a, b: _found(a, b, mean, k), "asked string, id string, score double")
    w = Window.partitionBy("asked").orderBy(F.desc("score"), "id")
    best = best.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
    return asked.join(best, "asked").select("query_id", "id", "score", "rank")


def phrases(spark: SparkSession, path: str, queries: DataFrame) -> DataFrame:
    """query_id, id, times: the documents that have a query's terms side by side in its order, and how often."""
    q = queries.select("query_id", F.posexplode(terms("text")).alias("offset", "term"), F.size(terms("text")).alias("n"))
    rows = _postings(spark, path, q).join(q, "term").select("query_id", "n", "offset", F.explode("docs").alias("d"))
    at = rows.select("query_id", "n", "offset", F.col("d.id").alias("id"), F.explode("d.places").alias("place"))
    runs = at.groupBy("query_id", "n", "id", (F.col("place") - F.col("offset")).alias("start")).agg(F.count_distinct("offset").alias("met")).where("met = n")
    return runs.groupBy("query_id", "id").agg(F.count("*").alias("times"))
