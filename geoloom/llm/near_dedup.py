"""MinHash near-duplicate detection with tensored banding and exact links.

A document's set is its distinct SHINGLE-word shingles, as 64-bit hashes. COLLECTIONS small collections of ROWS minhashes
each are computed (32 minhashes by default) and a table key is a pair of collections, so 16 collections give 120 tables of
four minhashes each. Two documents meet in a table if and only if two of their collections agree: at a similarity of 0.75
that fails with a chance of 4e-5, at 0.8 of 2e-6.

1. Documents with equal word sequences are one class (partial minima of doc_id before the shuffle).
2. Collections that no other class shares are dropped, and with them the classes left with fewer than two: they meet nobody
   in any table. Only the rest, a small part of the corpus, pays for table keys and for its full sets.
3. In each table bucket the least class is the hub; every distinct (hub, member) pair is confirmed on the full sets, and
   components are formed of the confirmed links. The pairs grow with the members of buckets, not with their squares.
4. What is left are table buckets that hold members of two components or more; each of them has a member that its hub
   isn't linked with, so only the classes of such buckets go on. They meet by single collections: members outside the
   bucket's largest component face all its members of other components, in blocks of about BLOCK_SHINGLES shingles a side inside
   tasks. Two members are compared on their full sets if they agree in two collections, that is in a table key, and only in
   the first collection they agree in. Only confirmed links leave a task, so no candidate is dropped and no pairs are
   emitted. Buckets with equal membership are taken once.

Classes are named by a 128-bit digest of their word sequence; doc_ids come back at the end.

Defined cases: null, empty and wordless texts have no shingles and link with nothing; a text of fewer words is one shingle;
a row without doc_id takes no part in links, its component is null and it is kept; repeated rows of one doc_id are judged
each by its own text; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from geoloom.llm.common import WordHashes, byte_rows, table, written
from geoloom.llm.graph import components

SHINGLE = 5
PERCENT = 75
COLLECTIONS = 16
ROWS = 2
#: Shingles of the members on either side of a block: 8 bytes each in a task, however long the texts are.
BLOCK_SHINGLES = 1 << 19
#: Up to this many classes, documents are sifted by a bitmap of BITMAP_BITS that every task gets; beyond, by a join.
BITMAP_CLASSES, BITMAP_BITS = 2_000_000, 1 << 25
SEED = 20_240_229

_A, _B, _C = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * _B
    h = (h ^ (h >> np.uint64(27))) * _C
    return h ^ (h >> np.uint64(31))


def shingle_set(words: list[bytes], hashes: WordHashes, size: int = SHINGLE) -> np.ndarray:
    """The ordered hashes of the distinct shingles; fewer words than size make one shingle, none make none."""
    h = np.fromiter(map(hashes.__getitem__, words), np.uint64, len(words))
    k = min(size, len(h))
    if not k:
        return h
    out = h[: len(h) - k + 1].copy()
    for i in range(1, k):
        out = out * _A + h[i : len(h) - k + 1 + i]
    return np.unique(mixed(out + np.uint64(k)))


def _coefficients(n: int) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(SEED)
    return rng.integers(1, 2**63, n, dtype=np.uint64) * np.uint64(2) + np.uint64(1), rng.integers(0, 2**63, n, dtype=np.uint64)


def collection_hashes(shingles: np.ndarray, a: np.ndarray, b: np.ndarray, rows: int) -> np.ndarray:
    """One hash for each collection of minhashes; the shingles are taken in blocks, so long texts need no more memory."""
    low = np.full(len(a), np.iinfo(np.uint64).max)
    for i in range(0, len(shingles), 2048):
        np.minimum(low, (a[:, None] * shingles[None, i : i + 2048] + b[:, None]).min(1), out=low)
    out = low[0::rows].copy()
    for r in range(1, rows):
        out = out * _A + low[r::rows]
    return mixed(out)


def _text_key(words: list[bytes]) -> bytes:
    import xxhash

    return xxhash.xxh3_128_digest(b" ".join(words))


def sketches(docs: DataFrame, collections: int, rows: int) -> DataFrame:
    """doc_id, row_key (of the text as it is), n_shingles, text_key (of the word sequence), sig (a hash for each collection)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, (a, b) = WordHashes(), _coefficients(collections * rows)
        for batch in batches:
            n, keys, sigs = [], [], []
            for text in byte_rows(batch.column(1)):
                words = text.lower().split()
                found = shingle_set(words, hashes)
                n.append(len(found))
                keys.append(_text_key(words) if words else None)
                sigs.append(collection_hashes(found, a, b, rows).view(np.int64) if len(found) else None)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(n, pa.int64()), pa.array(keys, pa.binary()), pa.array(sigs, pa.list_(pa.int64()))], names=["doc_id", "row_key", "n_shingles", "text_key", "sig"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64("text").alias("row_key")).mapInArrow(run, "doc_id long, row_key long, n_shingles long, text_key binary, sig array<long>")


def _bitmap(ids: DataFrame) -> np.ndarray:
    """Which places, of hashes of the ids, are taken: BITMAP_BITS bits, put together in pieces of 4 KB."""
    place = F.pmod(F.xxhash64("min_id"), F.lit(BITMAP_BITS))
    pieces = ids.select(F.shiftright(place, 15).alias("piece"), place.bitwiseAND(32767).alias("bit")).groupBy("piece").agg(F.bitmap_construct_agg("bit").alias("bits"))
    out = np.zeros((BITMAP_BITS >> 15, 4096), np.uint8)
    for r in pieces.collect():  # at most BITMAP_BITS / 32768 rows
        out[r.piece] = np.frombuffer(bytes(r.bits), np.uint8)
    return out.reshape(-1)


def full_sets(docs: DataFrame, alive: DataFrame) -> DataFrame:
    """text_key, shingles of the documents that stand for the classes in alive (min_id), and of few more; a task gives each
    word sequence once."""
    sift = alive.count() <= BITMAP_CLASSES
    if sift:
        shared = docs.sparkSession.sparkContext.broadcast(_bitmap(alive))
    else:
        docs = docs.join(alive.select(F.col("min_id").alias("doc_id")).distinct(), "doc_id", "left_semi")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, given = WordHashes(), set()
        for batch in batches:
            if sift:
                place = batch.column(1).to_numpy()
                batch = batch.filter(pa.array(shared.value[place >> 3] >> (place & 7).astype(np.uint8) & 1 == 1))
            for i in range(0, batch.num_rows, 500):
                sets = {}
                for text in byte_rows(batch.column(0).slice(i, 500)):
                    words = text.lower().split()
                    if words and (key := _text_key(words)) not in given:
                        given.add(key)
                        sets[key] = shingle_set(words, hashes).view(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(list(sets), pa.binary()), pa.array(list(sets.values()), pa.list_(pa.int64()))], names=["text_key", "shingles"])

    known = docs.where("doc_id is not null").select("text", F.pmod(F.xxhash64("doc_id"), F.lit(BITMAP_BITS)).alias("place"))
    return known.mapInArrow(run, "text_key binary, shingles array<long>")


def _linked(common, n, m, percent):
    return 100 * common >= percent * (n + m - common)


def _collections(own: pa.ChunkedArray, n: int) -> np.ndarray:
    """Rows of collection hashes by place; 0 where a collection was dropped, for nobody shares it."""
    own = own.combine_chunks()
    x, out = own.flatten(), np.zeros((len(own), n), np.int64)
    out[pa.compute.list_parent_indices(own).to_numpy(), x.field("place").to_numpy()] = x.field("value").to_numpy()
    return out


def _block_links(percent: int, collections: int):
    def run(rows: pa.Table) -> pa.Table:  # the sets of a side have about BLOCK_SHINGLES shingles
        asks, place, keys = rows["asks"].to_numpy(), rows["place"].to_numpy(), rows["text_key"].to_pylist()
        comp = np.unique(np.array(rows["component"].to_pylist(), object), return_inverse=True)[1]
        sets, sigs = [x.values.to_numpy() for x in rows["shingles"]], _collections(rows["own"], collections)
        sizes, members = np.array([len(x) for x in sets]), np.flatnonzero(~asks)
        theirs, left, right = sigs[members], [], []
        for q in np.flatnonzero(asks) if len(members) else ():
            same = (theirs == sigs[q]) & (sigs[q] != 0)
            fit = (same.sum(1) > 1) & (same.argmax(1) == place[q]) & (comp[members] != comp[q])
            fit &= 100 * np.minimum(sizes[members], sizes[q]) >= percent * np.maximum(sizes[members], sizes[q])
            for m in members[fit]:
                common = len(np.intersect1d(sets[q], sets[m], assume_unique=True))
                if _linked(common, sizes[q], sizes[m], percent):
                    left.append(keys[q])
                    right.append(keys[m])
        return pa.table({"a": pa.array(left, pa.binary()), "b": pa.array(right, pa.binary())})

    return run


def link_classes(classes: DataFrame, docs: DataFrame, percent: int, collections: int) -> DataFrame:
    """classes (text_key, min_id, n_shingles, sig) and docs (doc_id, text) -> (a, b): confirmed links, enough for the components."""
    entries = classes.select("text_key", "min_id", "n_shingles", F.posexplode("sig").alias("place", "value"))
    shared = entries.groupBy("place", "value").agg(F.count("*").alias("n")).where("n > 1").select("place", "value")
    alive = entries.join(shared, ["place", "value"]).groupBy("text_key", "min_id", "n_shingles").agg(F.sort_array(F.collect_list(F.struct("place", "value"))).alias("own"))
    alive = written(alive.where("size(own) > 1"), "near-alive")

    # table keys: pairs of the collections that are left, of one class in ascending order
    first = alive.select("text_key", "own", F.posexplode("own").alias("i", "x"))
    keys = first.select("text_key", "x", F.explode(F.slice("own", F.col("i") + 2, F.size("own"))).alias("y"))
    keys = keys.select("text_key", F.xxhash64("x", "y").alias("key"), F.xxhash64("y", "x").alias("key2"))
    hubs = keys.groupBy("key", "key2").agg(F.min("text_key").alias("hub"), F.count("*").alias("n")).where("n > 1").drop("n")
    pairs = written(keys.join(hubs, ["key", "key2"]).where("text_key <> hub").select("hub", "text_key").distinct(), "near-pairs")

    sets = written(full_sets(docs, alive), "near-sets")
    n = F.size("shingles")
    member = pairs.join(sets, "text_key").select("hub", "text_key", F.col("shingles").alias("own"), n.alias("n_own"))
    hub = sets.select(F.col("text_key").alias("hub"), "shingles", n.alias("n_hub"))
    size_fits = 100 * F.least("n_own", "n_hub") >= percent * F.greatest("n_own", "n_hub")
    common = F.size(F.array_intersect("own", "shingles"))
    stars = member.join(hub, "hub").where(size_fits).where(_linked(common, F.col("n_own"), F.col("n_hub"), percent))
    stars = written(stars.select(F.col("hub").alias("a"), F.col("text_key").alias("b")), "near-stars")
    labels = components(stars)

    # the rest: classes of tables' buckets with members of several components, met by single collections
    named = lambda key, name: labels.select(F.col("v").alias(key), F.col("component").alias(name))
    apart = pairs.join(named("hub", "h"), "hub", "left").join(named("text_key", "c"), "text_key", "left").where(F.coalesce("h", "hub") != F.coalesce("c", "text_key"))
    several = pairs.join(apart.select("hub").distinct(), "hub", "left_semi")
    several = several.select("text_key").union(several.select("hub")).distinct()
    mine = alive.join(several, "text_key", "left_semi").join(named("text_key", "component"), "text_key", "left").select("text_key", F.coalesce("component", "text_key").alias("component"), "n_shingles", "own")
    mine = written(mine, "near-rest")
    rows = mine.select("text_key", "component", "n_shingles", F.explode("own").alias("x")).select("text_key", "component", "n_shingles", "x.*")
    key = F.xxhash64("text_key").cast("decimal(38,0)")
    counts = rows.groupBy("place", "value", "component").agg(F.count("*").alias("n"), F.sum("n_shingles").alias("size"), F.sum(key).alias("digest"), F.min("text_key").alias("least"))
    largest = F.struct("n", "component", "size")
    buckets = counts.groupBy("place", "value").agg(F.sum("n").alias("n"), F.sum("size").alias("size"), F.max(largest).alias("main"), F.sum("digest").alias("digest"), F.min("least").alias("least"))
    # of equal buckets the one of the first collection stays: that is where its members agree first
    buckets = buckets.where("n > main.n").groupBy("n", "digest", "least").agg(F.min(F.struct("place", "value", "size", "main")).alias("b")).select("b.*")
    blocks = lambda size: F.greatest(F.lit(1), F.ceil(size / F.lit(BLOCK_SHINGLES))).cast("int")
    buckets = buckets.select("place", "value", F.col("main.component").alias("main"), blocks(F.col("size")).alias("m_blocks"), blocks(F.col("size") - F.col("main.size")).alias("q_blocks"))
    rows = rows.join(buckets, ["place", "value"]).withColumn("other", F.col("component") != F.col("main"))
    dealt = lambda blocks: F.pmod(F.xxhash64("text_key"), F.col(blocks)).cast("int")
    each = lambda blocks: F.explode(F.sequence(F.lit(0), F.col(blocks) - 1))
    ask = rows.where("other").select("place", "value", "text_key", F.lit(True).alias("asks"), dealt("q_blocks").alias("q"), each("m_blocks").alias("m"))
    answer = rows.select("place", "value", "text_key", F.lit(False).alias("asks"), each("q_blocks").alias("q"), dealt("m_blocks").alias("m"))
    whole = mine.select("text_key", "component", "own").join(sets, "text_key")
    both = ask.unionByName(answer).join(whole, "text_key")
    rest = both.groupBy("place", "value", "q", "m").applyInArrow(_block_links(percent, collections), "a binary, b binary")
    return written(stars.unionByName(rest), "near-links")


def judged_rows(docs: DataFrame, percent: int = PERCENT, collections: int = COLLECTIONS, rows: int = ROWS) -> DataFrame:
    """Per document row: doc_id, row_key (xxhash64 of the text), n_shingles, component_id, kept."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    seen = written(sketches(docs, collections, rows), "near-sketches")
    classes = seen.where("doc_id is not null and text_key is not null").groupBy("text_key").agg(F.min("doc_id").alias("min_id"), F.first("n_shingles").alias("n_shingles"), F.first("sig").alias("sig"))
    classes = written(classes, "near-classes")
    labels = components(link_classes(classes, docs, percent, collections)).withColumnRenamed("v", "text_key")
    labels = written(labels.join(classes.select("text_key", "min_id"), "text_key"), "near-labels")
    least = labels.groupBy("component").agg(F.min("min_id").alias("component_id"))
    linked = labels.join(least, "component").select("text_key", "component_id")
    results = classes.select("text_key", "min_id").join(linked, "text_key", "left").select("text_key", F.coalesce("component_id", "min_id").alias("component_id"))
    out = seen.select("doc_id", "row_key", "n_shingles", "text_key").join(results, "text_key", "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id"))
    return out.select("doc_id", "row_key", "n_shingles", component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"))


def near_duplicates(docs: DataFrame, percent: int = PERCENT, collections: int = COLLECTIONS, rows: int = ROWS) -> DataFrame:
    """Per document row: doc_id, n_shingles, component_id, kept."""
    return judged_rows(docs, percent, collections, rows).drop("row_key")


def op3_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))


OP3_SQL = r"""
WITH RECURSIVE t AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
i AS (SELECT doc_id, w, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [1] ELSE range(1, len(w) - 3) END) AS i FROM t),
s AS (SELECT DISTINCT doc_id, array_to_string(w[i:i + 4], ' ') AS g FROM i),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY a.doc_id, b.doc_id),
e AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 75 * (x.n + y.n - c)),
r AS (SELECT doc_id AS v, doc_id AS u FROM documents UNION SELECT r.v, e.b FROM r JOIN e ON e.a = r.u),
m AS (SELECT v, min(u) AS component_id FROM r GROUP BY v)
SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, component_id, d.doc_id = component_id AS kept FROM documents d JOIN m ON m.v = d.doc_id LEFT JOIN n ON n.doc_id = d.doc_id
"""
