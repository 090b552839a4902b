"""From raw documents to token files: toxic documents go, one document of each near-duplicate group stays, documents with
benchmark passages go, sources are mixed to their weights, and what is left is written as token ids.

Each stage takes (spark, docs, sf_dir) and works on all rows that the stage before kept; all but the last return the columns
of documents. run() writes each stage's rows as Parquet to the shared folder and reads them again for the next one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from geoloom.llm.common import fresh, table, written
from geoloom.llm.decontaminate import drop_contaminated
from geoloom.llm.mixing import mixture
from geoloom.llm.near_dedup import judged_rows
from geoloom.llm.token_files import tokenized
from geoloom.llm.toxicity import keep_clean, train


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier chain doesn't find toxic."""
    return keep_clean(docs, train(docs, table(spark, sf_dir, "labels")))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the least doc_id of each group; documents without doc_id stay. Rows of one doc_id go or stay each by
    its own text."""
    id_name, text_name = fresh(docs.columns, "gone_id", "gone_text")
    gone = judged_rows(docs).where("not kept").select(F.col("doc_id").alias(id_name), F.col("row_key").alias(text_name)).distinct()
    return docs.join(gone, (docs.doc_id.cast("long") == gone[id_name]) & (F.xxhash64(docs.text) == gone[text_name]), "left_anti")


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a benchmark passage."""
    return drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Nine tenths of the tokens, at the weights nearest to equal that take no document twice: small sources stay whole."""
    return mixture(docs, max_repeats=1.0, budget_share=0.9).select("doc.*")


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row per document of the token files: doc_id, start, n_tokens, ids_crc32, shard_name."""
    return tokenized(spark, docs)


STAGES = [("toxicity", toxicity), ("near_dedup", near_dedup), ("decontamination", decontamination), ("mixing", mixing), ("token_ids", token_ids)]

#: The classifier and the hashes of the mixture are beyond SQL; tests/llm holds the stages against plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
