"""Benchmark decontamination by winnowing.

Each text is cut into words, every K words in a row are hashed, and of each WINNOW hashes in a row the least is kept (the
last of equal ones). Two texts that share K + WINNOW - 1 words in a row thus keep a common hash inside the shared span:
with K = 6 and WINNOW = 5, every shared span of 10 words or more is found. Hits are extended word by word to the windows of
10 item words around them. Items of fewer than 10 words are one window of their own length and are looked up by the hash of
that many words.

A benchmark whose texts come to no more than BROADCAST_BYTES is sent to every task, and documents are read once, with no
shuffle; windows are compared as words. A larger one is joined in two steps: places of documents' fingerprints are kept where
any item has the fingerprint (a semi-join), and the windows around them meet the items' windows by digests of 128 bits. No
document meets an item's text, and no window is compared twice. Both ways give the same rows.

Defined cases: null, empty and wordless texts have no words, no hits and no items; a null doc_id is kept as null; repeated
rows each give a row; repeated item texts count each by its item_id, a null item_id is left out; an empty benchmark hits
nothing; other columns are ignored.
"""

from __future__ import annotations

import gc
import hashlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

from geoloom.llm.common import WordHashes, byte_rows, fresh, slices, table, tidied, written

WINDOW = 10
K = 6
WINNOW = WINDOW - K + 1
BROADCAST_BYTES = 16 << 20

#: Bytes 0-9, a-z and those above 0x7F make words; A-Z are lowered; all others are white space.
WORD_BYTES = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
_ODD = np.uint64(0x9E3779B97F4A7C15)

ROWS = "doc_id long, n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean"


def words(text: bytes) -> list[bytes]:
    return text.translate(WORD_BYTES).split()


def gram_hashes(hashes: np.ndarray, k: int) -> np.ndarray:
    """The hash of every k words in a row."""
    n = len(hashes) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = hashes[:n].copy()
    for i in range(1, k):
        out = out * _ODD + hashes[i : n + i]
    return (out ^ (out >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)


def winnow(grams: np.ndarray, width: int = WINNOW) -> np.ndarray:
    """Places of the least hash of each window, the last of equal ones; of a text shorter than a window, of all of it."""
    if not len(grams):
        return np.zeros(0, np.int64)
    width = min(width, len(grams))
    windows = np.lib.stride_tricks.sliding_window_view(grams, width)[:, ::-1]
    return np.unique(np.arange(len(windows)) + width - 1 - windows.argmin(1))


def starts_around(places: np.ndarray, n_words: int) -> np.ndarray:
    """Where the windows that hold a kept gram begin."""
    found = places[:, None] - np.arange(WINDOW - K + 1)
    return np.unique(found[(found >= 0) & (found <= n_words - WINDOW)])


class Benchmark:
    """The distinct windows of some items, by hash, each with the set of the items that hold it; equal sets are one object.

    A document's windows around winnowed hits are looked up once for each distinct hash, so neither an item's repeats nor
    many items with one window multiply the work."""

    def __init__(self, items: list[tuple[int, bytes]], remembered: int = WordHashes.LIMIT):
        self.hashes = WordHashes()
        self.hashes.LIMIT = remembered
        holders = defaultdict(set)
        prints = set()
        for key, text in items:
            w = words(text)
            n = min(WINDOW, len(w))
            for i in range(len(w) - n + 1 if n else 0):
                holders[tuple(w[i : i + n])].add(key)
            if n == WINDOW:
                grams = gram_hashes(self.hash(w), K)
                prints.update(grams[winnow(grams)].tolist())
        self.prints = np.array(sorted(prints), np.uint64)
        sets: dict[frozenset, frozenset] = {}
        self.windows: dict[int, dict[int, list]] = defaultdict(lambda: defaultdict(list))  # by length, by hash
        for window, keys in holders.items():
            same = frozenset(keys)
            self.windows[len(window)][int(gram_hashes(self.hash(list(window)), len(window))[0])].append((list(window), sets.setdefault(same, same)))
        self.ordered = {n: np.array(sorted(x), np.uint64) for n, x in self.windows.items()}

    def hash(self, w: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.hashes.__getitem__, w), np.uint64, len(w))

    def hits(self, w: list[bytes]) -> tuple[np.ndarray, set[int]]:
        """Which words lie in an occurrence of a window, and the keys of the items whose windows occur."""
        edges, met = np.zeros(len(w) + 1, np.int64), {}
        h = self.hash(w)
        for n, ordered in self.ordered.items():
            grams = gram_hashes(h, n)
            if not len(grams):
                continue
            if n == WINDOW:
                short = gram_hashes(h, K)
                kept = winnow(short)
                at = starts_around(kept[_member(short[kept], self.prints)], len(w))
            else:
                at = np.arange(len(grams))
            for s in at[_member(grams[at], ordered)].tolist():
                for window, keys in self.windows[n][int(grams[s])]:
                    if w[s : s + n] == window:
                        edges[s] += 1
                        edges[s + n] -= 1
                        met[id(keys)] = keys
        return np.cumsum(edges[:-1]) > 0, set().union(*met.values())


_LAST: dict[str, Benchmark] = {}


def _of_worker(items: list[tuple[int, bytes]]) -> Benchmark:
    """The benchmark that this Python worker has made for these items before, or a new one in its place: a task in a worker that
    goes on needs no memory of its own for it."""
    key = hashlib.sha256(repr(items).encode()).hexdigest()
    if key not in _LAST:
        _LAST.clear()
        _LAST[key] = Benchmark(items, 100_000)
    return _LAST[key]


def _member(values: np.ndarray, ordered: np.ndarray) -> np.ndarray:
    return ordered[np.minimum(np.searchsorted(ordered, values), len(ordered) - 1)] == values


def _digest(keys: set[int]) -> str:
    return hashlib.sha256(",".join(sorted(map(str, keys))).encode()).hexdigest()


def _broadcast_way(docs: DataFrame, items: list[tuple[int, bytes]]) -> DataFrame:
    shared = docs.sparkSession.sparkContext.broadcast(items)

    @tidied
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        benchmark = Benchmark(shared.value)
        for batch in batches:
            for part in slices(batch):
                out = []
                for text in byte_rows(part.column(1)):
                    w = words(text)
                    hit, found = benchmark.hits(w)
                    out.append((len(w), int(hit.sum()), len(found), _digest(found), bool(hit.any())))
                columns = list(zip(*out, strict=True)) or [[]] * 5
                yield pa.RecordBatch.from_arrays([part.column(0), *(pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.bool_()), strict=True))], names=["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(rows, ROWS)


def _windows(w: list[bytes], n: int, at) -> tuple[list[int], list[bytes]]:
    """Each distinct window's first place, and its digest of 128 bits."""
    import xxhash

    first: dict[bytes, int] = {}
    for s in at:
        first.setdefault(xxhash.xxh3_128_digest(b" ".join(w[s : s + n])), s)
    return list(first.values()), list(first)


def _item_rows(kind: str):
    """items (item_id, text) -> their windows (n, window, item_id), or their winnowed prints (n, print), each once a text; an
    item shorter than a window has its own hash as its print."""

    @tidied
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for batch in batches:
            for key, text in zip(batch.column(0).to_pylist(), byte_rows(batch.column(1)), strict=True):
                w = words(text)
                n = min(WINDOW, len(w))
                if not n:
                    continue
                if kind == "windows":
                    _, found = _windows(w, n, range(len(w) - n + 1))
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(found), n)), pa.array(found, pa.binary()), pa.array([key] * len(found), pa.int64())], names=["n", "window", "item_id"])
                else:
                    h = np.fromiter(map(hashes.__getitem__, w), np.uint64, len(w))
                    grams = gram_hashes(h, K if n == WINDOW else n)
                    prints = np.unique(grams[winnow(grams)] if n == WINDOW else grams)
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(prints), n)), pa.array(prints.view(np.int64))], names=["n", "print"])

    return run, "n long, window binary, item_id long" if kind == "windows" else "n long, print long"


def _doc_prints(lengths: tuple[int, ...]):
    """texts (digest, text) -> digest, n, print, at: the places of winnowed grams (n = WINDOW), and of all grams of the other
    lengths."""

    @tidied
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for batch in batches:
            for digest, text in zip(batch.column(0).to_pylist(), byte_rows(batch.column(1)), strict=True):
                w = words(text)
                h = np.fromiter(map(hashes.__getitem__, w), np.uint64, len(w))
                for n in lengths:
                    grams = gram_hashes(h, K if n == WINDOW else n)
                    at = winnow(grams) if n == WINDOW else np.arange(len(grams))
                    for i in range(0, len(at), 100_000):
                        some = at[i : i + 100_000]
                        yield pa.RecordBatch.from_arrays([pa.array([digest] * len(some), pa.string()), pa.array(np.full(len(some), n)), pa.array(grams[some].view(np.int64)), pa.array(some.astype(np.int64))], names=["digest", "n", "print", "at"])

    return run, "digest string, n long, print long, at long"


@tidied
def _doc_windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """digest, text, n, places -> digest, n, window, places: the distinct windows around the places, with all their starts."""
    import xxhash

    for batch in batches:
        for digest, text, n, places in zip(batch.column(0).to_pylist(), byte_rows(batch.column(1)), batch.column(2).to_pylist(), batch.column(3), strict=True):
            w, at = words(text), np.unique(places.values.to_numpy())
            found = defaultdict(list)
            for s in (starts_around(at, len(w)) if n == WINDOW else at).tolist():
                found[xxhash.xxh3_128_digest(b" ".join(w[s : s + n]))].append(s)
            yield pa.RecordBatch.from_arrays([pa.array([digest] * len(found), pa.string()), pa.array([n] * len(found), pa.int64()), pa.array(list(found), pa.binary()), pa.array(list(found.values()), pa.list_(pa.int64()))], names=["digest", "n", "window", "places"])


def text_digest(text: Column) -> Column:
    return F.sha2(F.coalesce(text, F.lit("")), 256)


def _join_way(texts: DataFrame, items: DataFrame) -> DataFrame:
    """texts (digest, text; distinct) -> digest, n_words, n_hit, keys (strings, in order).

    Prints and windows meet as distinct keys, so a print or window that many items share is one row on the items' side: its
    items are put together before they meet documents. A text is joined once, to the list of its own hits."""
    prints = items.mapInArrow(*_item_rows("prints")).distinct()
    holders = items.mapInArrow(*_item_rows("windows")).groupBy("n", "window").agg(F.sort_array(F.collect_set("item_id")).alias("items"))
    prints, holders = written(prints, "decontaminate-prints"), written(holders, "decontaminate-windows")
    lengths = tuple(sorted(r.n for r in prints.select("n").distinct().collect()))  # at most WINDOW of them
    met = texts.select("digest", "text").mapInArrow(*_doc_prints(lengths)).join(prints, ["n", "print"], "left_semi")
    places = met.groupBy("digest", "n").agg(F.collect_set("at").alias("places"))  # no longer than the text
    around = texts.join(places, "digest").select("digest", "text", "n", "places").mapInArrow(_doc_windows, "digest string, n long, window binary, places array<long>")
    hits = written(around.join(holders, ["n", "window"]), "decontaminate-hits")
    spans = hits.select("digest", "n", F.explode("places").alias("at")).groupBy("digest").agg(F.sort_array(F.collect_list(F.struct("at", "n"))).alias("spans"))
    nothing = F.struct(F.lit(0).cast("long").alias("end"), F.lit(0).cast("long").alias("n"))

    def covered(found: Column, x: Column) -> Column:
        end = F.greatest(found.end, x.at + x.n)
        return F.struct(end.alias("end"), (found.n + end - F.greatest(F.least(end, x.at), found.end)).alias("n"))

    n_hit = spans.select("digest", F.aggregate("spans", nothing, covered).n.alias("n_hit"))
    sets = hits.select("digest", "items").distinct().groupBy("digest").agg(F.array_distinct(F.flatten(F.collect_list("items"))).alias("items"))
    return n_hit.join(sets, "digest").select("digest", "n_hit", F.sort_array(F.transform("items", lambda x: x.cast("string"))).alias("keys"))


def _distinct_texts(docs: DataFrame) -> DataFrame:
    texts = docs.where("text is not null").select(text_digest(F.col("text")).alias("digest"), "text")
    return written(texts.groupBy("digest").agg(F.first("text").alias("text")), "decontaminate-texts")


@F.arrow_udf(LongType())
def n_words(texts: pa.Array) -> pa.Array:
    return pa.array([len(words(t)) for part in slices(texts) for t in byte_rows(part)], pa.int64())


def _items(benchmark: DataFrame) -> DataFrame:
    return benchmark.where("item_id is not null").select(F.col("item_id").cast("long").alias("item_id"), "text")


def _is_large(items: DataFrame, broadcast_bytes: int) -> bool:
    return (items.agg(F.sum(F.octet_length("text") + 64)).first()[0] or 0) > broadcast_bytes


def _collected(items: DataFrame) -> list[tuple[int, bytes]]:
    return [(r.item_id, (r.text or "").encode()) for r in items.collect()]


def decontaminate(docs: DataFrame, benchmark: DataFrame, broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """Per document row: doc_id, n_words, n_hit, n_items, items_sha256, contaminated."""
    items = _items(benchmark)
    if not _is_large(items, broadcast_bytes):
        return _broadcast_way(docs, _collected(items))
    found = _join_way(_distinct_texts(docs), items)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_digest(F.col("text")).alias("digest"), n_words("text").alias("n_words"))
    out = rows.join(found, "digest", "left")
    keys, hit = F.coalesce("keys", F.array().cast("array<string>")), F.coalesce("n_hit", F.lit(0).cast("long"))
    return out.select("doc_id", "n_words", hit.alias("n_hit"), F.size(keys).cast("long").alias("n_items"), F.sha2(F.array_join(keys, ","), 256).alias("items_sha256"), (hit > 0).alias("contaminated"))


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """The rows of docs without a hit, all columns as they are."""
    items = _items(benchmark)
    if _is_large(items, broadcast_bytes):
        (name,) = fresh(docs.columns, "hit_digest")
        hit = _join_way(_distinct_texts(docs), items).select(F.col("digest").alias(name))
        return docs.join(hit, text_digest(docs.text) == hit[name], "left_anti")
    shared = docs.sparkSession.sparkContext.broadcast(_collected(items))

    @F.arrow_udf("boolean")
    def is_clean(columns: Iterator[pa.Array]) -> Iterator[pa.Array]:
        found = _of_worker(shared.value)
        for column in columns:
            yield pa.array([not found.hits(words(t))[0].any() for part in slices(column, 128) for t in byte_rows(part)], pa.bool_())
        gc.collect()
        pa.default_memory_pool().release_unused()

    return docs.where(is_clean(docs.text))


def op7_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


OP7_SQL = r"""
WITH low AS (SELECT 'd' AS kind, doc_id AS id, text FROM documents UNION ALL SELECT 'i', item_id, text FROM benchmark),
w AS (SELECT kind, id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM low),
g AS (SELECT id AS item_id, n, unnest(range(1, len(w) - n + 2)) AS i, w FROM (SELECT *, least(10, len(w)) AS n FROM w WHERE kind = 'i' AND len(w) > 0)),
items AS (SELECT DISTINCT item_id, n, array_to_string(w[i:i + n - 1], ' ') AS gram FROM g),
d AS (SELECT id AS doc_id, n, unnest(range(1, len(w) - n + 2)) AS i, w FROM w, (SELECT DISTINCT n FROM items) WHERE kind = 'd' AND len(w) >= n),
hits AS (SELECT doc_id, i, d.n, item_id FROM d JOIN items ON items.n = d.n AND array_to_string(w[i:i + d.n - 1], ' ') = gram),
h AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM hits) GROUP BY doc_id),
k AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS keys FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS item FROM hits) GROUP BY doc_id)
SELECT id AS doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items, sha256(coalesce(keys, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM w LEFT JOIN h ON h.doc_id = id LEFT JOIN k ON k.doc_id = id WHERE kind = 'd'
"""
