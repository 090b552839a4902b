"""Substring deduplication by content-defined chunks.

A gear hash rolls over the bytes of a text; shifting by one bit a byte, its 16 bits depend on the last 16 bytes only. A
chunk ends where the hash is the least within REACH bytes to either side (the first of equal ones), so a cut depends on
nothing but the bytes around it: text inserted elsewhere moves no cut, and chunks are longer than REACH and 2 * REACH + 1
bytes on average. Where no least hash comes for MOST bytes, a cut is forced. Within a passage that two documents share,
all cuts but those near its ends agree, and so do the chunks between them: at REACH = 20, a passage of 300 bytes holds
some six whole chunks.

Chunks are told apart by a 128-bit digest. A digest is repeated if it lies in two documents at least, which partial minima
and maxima of the document ids show before the shuffle. Rows of repeated chunks only are joined back, and neighbouring ones
are put together to spans; spans of less than MIN_CHARS characters are chance phrases and are left out. The first document
(by doc_id) of a digest holds the original; removing spans that lie elsewhere too deduplicates.

Defined cases: null and empty texts have no chunks; a row without doc_id takes no part; rows with one doc_id count as one
document, so repeats within it are none: rows with the same text give its spans once, other texts of the doc_id give theirs
too; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from geoloom.llm.common import byte_rows, fresh, table

REACH = 20
MOST = 1024
MIN_CHARS = 80
GEAR = np.random.default_rng(64).integers(0, 2**16, 256, dtype=np.uint16)


def gear_hashes(data: np.ndarray) -> np.ndarray:
    """The 16-bit gear hash after each byte: the sum of gear[b] << age over the last 16 bytes, by doubling."""
    h = GEAR[data]
    for age in (1, 2, 4, 8):
        older = np.zeros_like(h)
        older[age:] = h[:-age] if age < len(h) else 0
        h = h + (older << np.uint16(age)) if age < len(h) else h
    return h


def cuts(text: bytes) -> np.ndarray:
    """Where chunks end, the end of the text included."""
    n = len(text)
    if not n:
        return np.zeros(0, np.int64)
    h = gear_hashes(np.frombuffer(text, np.uint8)).astype(np.int32)
    # ties: the first wins, so the left side must be greater and the right side no less
    edge = np.full(REACH, 1 << 16, np.int32)
    padded = np.concatenate([edge, h, edge])
    left, right = padded.copy(), padded.copy()
    done = 1  # minima over the done values up to, and from, each place
    while done < REACH:
        step = min(done, REACH - done)
        left[step:] = np.minimum(left[step:], left[:-step])
        right[:-step] = np.minimum(right[:-step], right[step:])
        done += step
    found = np.flatnonzero((h < left[REACH - 1 : REACH - 1 + n]) & (h <= right[REACH + 1 : REACH + 1 + n])) + 1
    out = np.unique(np.append(found[found < n], n))
    gaps = np.diff(out, prepend=0)
    if gaps.max() > MOST:
        out = np.unique(np.concatenate([np.arange(a, b, MOST)[1:] for a, b in zip(out - gaps, out, strict=True) if b - a > MOST] + [out]))
    return out


def chunk_rows(docs: DataFrame) -> DataFrame:
    """doc_id, text_key (tells the texts of a doc_id apart), seq, start, stop (in code points), d1, d2 (the digest)."""
    names = ["doc_id", "text_key", "seq", "start", "stop", "d1", "d2"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parts, size = [], 0

            def out() -> pa.RecordBatch:
                columns = [np.concatenate(x) for x in zip(*parts, strict=True)]
                return pa.RecordBatch.from_arrays([pa.array(x) for x in columns], names=names)

            for key, text_key, text in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), byte_rows(batch.column(1)), strict=True):
                ends = cuts(text)
                if not len(ends):
                    continue
                starts = np.append(0, ends[:-1])
                whole = b"".join(hashlib.blake2b(text[a:b], digest_size=16).digest() for a, b in zip(starts.tolist(), ends.tolist(), strict=True))
                digests = np.frombuffer(whole, np.int64).reshape(-1, 2)
                points = np.append(0, np.cumsum((np.frombuffer(text, np.uint8) & 0xC0) != 0x80))
                k = len(ends)
                parts.append((np.full(k, key, np.int64), np.full(k, text_key, np.int64), np.arange(k, dtype=np.int32), points[starts].astype(np.int32), points[ends].astype(np.int32), digests[:, 0], digests[:, 1]))
                size += k
                if size > 100_000:
                    yield out()
                    parts, size = [], 0
            if parts:
                yield out()

    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64("text").alias("text_key")).where("doc_id is not null and text <> ''")
    return texts.mapInArrow(run, "doc_id long, text_key long, seq int, start int, stop int, d1 long, d2 long")


def repeated_spans(docs: DataFrame, min_chars: int = MIN_CHARS) -> DataFrame:
    """doc_id, text_key, start, stop, n_chunks, first_doc: the spans of texts whose chunks other documents hold too."""
    chunks = chunk_rows(docs)
    repeated = chunks.groupBy("d1", "d2").agg(F.min("doc_id").alias("first_doc"), F.max("doc_id").alias("last_doc")).where("first_doc <> last_doc").drop("last_doc")
    hits = chunks.join(repeated, ["d1", "d2"]).select("doc_id", "text_key", "seq", "start", "stop", "first_doc")
    run = F.col("seq") - F.dense_rank().over(Window.partitionBy("doc_id", "text_key").orderBy("seq"))  # a repeated row's chunks have equal ranks
    spans = hits.withColumn("run", run).groupBy("doc_id", "text_key", "run")
    spans = spans.agg(F.min("start").alias("start"), F.max("stop").alias("stop"), (F.max("seq") - F.min("seq") + 1).cast("long").alias("n_chunks"), F.min("first_doc").alias("first_doc"))
    return spans.where(F.col("stop") - F.col("start") >= min_chars).drop("run")


def deduplicated(docs: DataFrame, min_chars: int = MIN_CHARS) -> DataFrame:
    """docs whose text lacks the spans that an earlier document holds; all rows stay."""
    id_name, text_name, cut_name = fresh(docs.columns, "cut_doc", "cut_text", "cut")
    cut = repeated_spans(docs, min_chars).where("first_doc < doc_id").groupBy("doc_id", "text_key").agg(F.sort_array(F.collect_list(F.struct("start", "stop"))).alias("cut"))
    cut = cut.select(F.col("doc_id").alias(id_name), F.col("text_key").alias(text_name), F.col("cut").alias(cut_name))
    edges = F.concat(F.array(F.struct(F.lit(0).alias("start"), F.lit(0).alias("stop"))), F.col(cut_name))
    after = F.concat(F.transform(cut_name, lambda x: x.start), F.array(F.length("text")))
    left = F.array_join(F.zip_with(edges, after, lambda e, a: F.substring(F.col("text"), e.stop + 1, a - e.stop)), "")
    joined = docs.join(cut, (docs.doc_id.cast("long") == cut[id_name]) & (F.xxhash64(docs.text) == cut[text_name]), "left")
    return joined.withColumn("text", F.when(F.col(cut_name).isNull(), F.col("text")).otherwise(left)).select(*docs.columns)


def op6_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row for each document that shares a passage with another: its spans, and whether all of them are originals."""
    spans = repeated_spans(table(spark, sf_dir, "documents"))
    return spans.groupBy("doc_id").agg(
        F.count("*").alias("n_spans"),
        F.sum(F.col("stop") - F.col("start")).cast("long").alias("repeated_chars"),
        (F.sum(F.when(F.col("first_doc") < F.col("doc_id"), F.col("stop") - F.col("start")).otherwise(0))).cast("long").alias("removed_chars"),
        F.min("first_doc").alias("first_doc"),
        F.sort_array(F.collect_list(F.struct("start", "stop"))).alias("spans"),
    )
