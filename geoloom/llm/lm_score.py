"""Scores of whole documents by a gated recurrent language model (see gru), beside add-one unigram scores.

1. The words of all training documents are counted (partial counts in each task, then a shuffle by word) and the table is
   written; the sums N and V come from it.
2. The most frequent words, at most DICTIONARY, are sent to every task. The model's words are the first of them, as many as
   cover COVERAGE of the training tokens and MODEL_WORDS at least, so they grow with the corpus up to the dictionary; all
   others are its tail. Words beyond the dictionary find their counts by a join in the shuffle.
3. Every document is turned into the model's ids once; the table of ids is written, and later steps read no texts.
4. Training documents are dealt by hashes to ROUNDS rounds and to shards of about SHARD_TOKENS tokens (over all rounds). In a
   round each shard trains a copy of the model so far on its documents, in an order by hash, by truncated backpropagation,
   and the copies are averaged by weight of their tokens, in blocks of weights. Every training document is read
   in one round. Shards follow from the data alone, so the model does not depend on how tasks split it.
5. Every document is scored whole: the model gives each word's probability, and that of a tail word is the tail's times
   its add-one share of the tail, (c + 1) / (N_tail + V_tail + 1). The same counts give the base score.

Training documents are those whose crc32 of the doc_id as text, mod FOLDS, is not HELD_OUT. Words are runs of bytes other
than white space, A-Z lowered; each document ends with one end token, written as the empty word.

Defined cases: null counts as empty, which is the end token alone; a null doc_id counts as the empty text for the fold and
stays null; each row gives a row, repeated rows the same scores (they also count as often in training); an empty table, or
one without training documents, gives N = 0 and scores from an untrained model; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from geoloom.llm.common import byte_rows, slices, table, tidied, written
from geoloom.llm.gru import Gru

FOLDS = 7
HELD_OUT = 2
DICTIONARY = 1 << 18
MODEL_WORDS = 2048
COVERAGE = 0.6
SHARD_TOKENS = 2_000_000
SHARDS = 4  # at least
ROUNDS = 4
#: A task trains on so many tokens at a time, whatever its shard's size.
AT_ONCE = 1 << 20
#: A task counts so many words before it adds up equal ones, and sends them on if half as many differ.
COUNTED = 800_000
#: Weights that are added up together.
BLOCK = 1 << 13
END = b""


def held_out(doc_id: Column) -> Column:
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % FOLDS == HELD_OUT


def tokens(text: bytes) -> list[bytes]:
    return [*text.lower().split(), END]


def coded_tokens(texts: list[bytes]) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """The different tokens of all texts, a token's place among them for each token in a row, and the tokens of each text."""
    plain = pc.ascii_trim_whitespace(pc.ascii_lower(pa.array(texts, pa.binary()).view(pa.string())))
    words = pc.ascii_split_whitespace(plain)  # of an empty text the empty word, which is the end token
    coded, ends = words.values.dictionary_encode(), words.offsets.to_numpy()
    different, more = coded.dictionary.view(pa.binary()), pc.binary_length(plain).to_numpy() > 0
    codes = np.insert(coded.indices.to_numpy(), ends[1:][more], len(different))
    return pa.concat_arrays([different, pa.array([END], pa.binary())]), codes, np.diff(ends) + more


def _added(counts: list[pa.Table]) -> pa.Table:
    """Tables of (word, n) as one with each word once."""
    return pa.concat_tables(counts).group_by("word", use_threads=False).aggregate([("n", "sum")]).select(["word", "n_sum"]).rename_columns(["word", "n"])


def count_words(docs: DataFrame) -> DataFrame:
    """(word binary, n long) over the texts of docs."""

    @tidied
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found, size = [], 0
        for batch in batches:
            for part in slices(batch, 1024):
                words, codes, _ = coded_tokens(byte_rows(part.column(0)))
                times = np.bincount(codes, minlength=len(words))
                found.append(pa.table({"word": words, "n": times}).filter(pa.array(times > 0)))  # without texts no end token is there
                size += len(words)
                if size > COUNTED:
                    found = [_added(found)]
                    size = len(found[0])
                    if size > COUNTED // 2:
                        yield from found[0].to_batches()
                        found, size = [], 0
        if found:
            yield from _added(found).to_batches()

    return docs.select("text").mapInArrow(run, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n"))


def dictionary_limit(counts: DataFrame, most: int) -> int:
    """The least count that at most `most` words exceed. Each job counts the words over some limits, so that no task sorts:
    first powers of two, as most words are rare, then 31 between two of them."""
    high, words = counts.agg(F.coalesce(F.max("n"), F.lit(0)), F.count("*")).first()
    if words <= most:
        return 0
    low, limits = -1, [2**k - 1 for k in range(high.bit_length())]  # too many exceed low; none exceeds high
    while high - low > 1:
        over = counts.agg(*(F.count_if(F.col("n") > x) for x in limits)).first()
        fits = [x for x, n in zip(limits, over, strict=True) if n <= most]
        low, high = max([low, *(x for x in limits if x not in fits)]), min([high, *fits])
        limits = sorted({low + (high - low) * k // 32 for k in range(1, 32)} - {low})
    return high


class Words:
    """The dictionary's places and counts, and which of them are the model's words."""

    def __init__(self, ranked: list[tuple[bytes, int]], total: int):
        self.place = {w: i for i, (w, _) in enumerate(ranked)}
        self.counts = np.array([n for _, n in ranked], np.float64)
        self.log = np.log10(self.counts + 1)
        covering = int(np.searchsorted(np.cumsum(self.counts), COVERAGE * total)) + 1
        self.k = min(max(MODEL_WORDS, covering), len(ranked))
        self.tail = total - self.counts[: self.k].sum()

    def places(self, words: list[bytes]) -> np.ndarray:
        """In the dictionary; -1 for other words."""
        return np.fromiter(map(self.place.get, words, repeat(-1)), np.int64, len(words))

    def ids(self, places: np.ndarray) -> np.ndarray:
        return np.where((places < 0) | (places >= self.k), self.k, places)

    def model(self) -> Gru:
        return Gru(self.counts[: self.k], self.tail)


class LocalWords:
    """A Python worker's Words, of the last dictionary that it was sent."""

    last: tuple | None = None

    @classmethod
    def of(cls, shared) -> Words:
        if cls.last is None or cls.last[0] != shared.value[0]:
            cls.last = None
            cls.last = (shared.value[0], Words(*shared.value[1:]))
        return cls.last[1]


def id_type(k: int) -> np.dtype:
    """Of the ids of a model of k words, which are kept as bytes."""
    return np.dtype("<u2" if k < 1 << 16 else "<u4")


NUMBERS = ("n_tokens", "n_head", "head_log", "tail_log", "n_tail")
ENCODED = "doc_id long, held_out boolean, n_tokens long, n_head long, head_log double, tail_log double, n_tail long, key binary, ids binary, rare array<struct<word: binary, tf: long>>"


def encode(docs: DataFrame, shared) -> DataFrame:
    """docs (doc_id, held_out, text) -> ENCODED: numbers of the base score, the text's digest, its ids, and its words beyond
    the dictionary with their times."""

    @tidied
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = LocalWords.of(shared)
        for batch in batches:
            for part in slices(batch, 1024):
                yield encoded(part, words)

    def encoded(batch: pa.RecordBatch, words: Words) -> pa.RecordBatch:
        texts = byte_rows(batch.column(2))
        different, codes, sizes = coded_tokens(texts)
        place_of, doc = words.places(different.to_numpy(zero_copy_only=False).tolist()), np.repeat(np.arange(len(texts)), sizes)
        places = place_of[codes]
        in_model, is_rare = (places >= 0) & (places < words.k), places < 0
        logs = np.where(is_rare, 0.0, words.log[places]) if len(words.log) else np.zeros(len(places))
        begin = np.cumsum(sizes) - sizes  # of each document, which has the end token at least
        add = lambda x, kind: np.add.reduceat(x, begin, dtype=kind) if len(x) else np.zeros(0)
        numbers = (sizes, sizes - add(is_rare, np.int64), add(logs, float), add(np.where(in_model, 0.0, logs), float), sizes - add(in_model, np.int64))
        columns = [pa.array(x.astype(t)) for x, t in zip(numbers, (np.int64, np.int64, np.float64, np.float64, np.int64), strict=True)]
        kind = id_type(words.k)
        edges = (kind.itemsize * np.append(0, np.cumsum(sizes))).astype(np.int32)
        ids = pa.Array.from_buffers(pa.binary(), len(texts), [None, pa.py_buffer(edges), pa.py_buffer(words.ids(places).astype(kind))])
        beyond = np.flatnonzero(is_rare)
        found, times = np.unique(doc[beyond] * len(different) + codes[beyond], return_counts=True)  # by document and word
        of, code = np.divmod(found, max(1, len(different)))
        keys = pa.array([hashlib.md5(t).digest() for t in texts], pa.binary())
        words_of, times = different.take(pa.array(code)), pa.array(times.astype(np.int64))
        ends = pa.array(np.append(0, np.cumsum(np.bincount(of, minlength=len(texts)))), pa.int32())
        pairs = pa.ListArray.from_arrays(ends, pa.StructArray.from_arrays([words_of, times], ["word", "tf"]))
        return pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *columns, keys, ids, pairs], names=["doc_id", "held_out", *NUMBERS, "key", "ids", "rare"])

    return docs.select("doc_id", "held_out", "text").mapInArrow(run, ENCODED)


def _train_round(dealt: DataFrame, shape, tasks: int) -> DataFrame:
    """dealt (shard, ids), a shard in one of the tasks and in order -> block, part, tokens, mean: the mean of the copies' weights
    by tokens, in blocks, taken in two steps. shape: a broadcast of the model's counts, tail and weights so far."""

    @tidied
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, tail, vector = shape.value
        kind = id_type(len(counts))
        shard, model, seen, waiting, size = None, None, 0, [], 0
        total, tokens_of_all = None, 0

        def learn() -> None:
            lengths = np.concatenate([n for _, n in waiting])
            starts = np.zeros(size, bool)
            starts[np.cumsum(lengths) - lengths] = True
            model.train(np.concatenate([x for x, _ in waiting]), starts)

        def finish() -> None:
            nonlocal total, tokens_of_all
            if size:
                learn()
            n = seen + size
            if model is not None and n:
                part = n * model.vector().astype(np.float64)
                total, tokens_of_all = part if total is None else total + part, tokens_of_all + n

        for batch in batches:
            shards = batch.column(0).to_numpy()
            edges = [0, *(np.flatnonzero(np.diff(shards)) + 1).tolist(), len(shards)]
            for a, b in zip(edges[:-1], edges[1:], strict=True):
                if b > a and shards[a] != shard:
                    finish()
                    shard, model, seen, waiting, size = shards[a], Gru(counts, tail), 0, [], 0
                    if vector is not None:
                        model.load(vector)
                for part in slices(batch.column(1).slice(a, b - a)):
                    found = part.to_pylist()
                    ids = np.frombuffer(b"".join(found), kind).astype(np.int64)
                    waiting.append((ids, np.array([len(x) // kind.itemsize for x in found])))
                    size += len(ids)
                    if size >= AT_ONCE:
                        learn()
                        seen, waiting, size = seen + size, [], 0
        finish()
        if tokens_of_all:
            ends = np.append(np.arange(0, len(total), BLOCK), len(total))
            mean = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array((total / tokens_of_all).astype(np.float32)))
            n, part = len(mean), TaskContext.get().partitionId() % math.isqrt(tasks)
            columns = [pa.array(np.arange(n, dtype=np.int32)), pa.array(np.full(n, part, np.int32)), pa.array(np.full(n, float(tokens_of_all))), mean]
            yield pa.RecordBatch.from_arrays(columns, names=["block", "part", "tokens", "mean"])

    kind = "block int, part int, tokens double, mean array<float>"
    return dealt.mapInArrow(run, kind).groupBy("block", "part").applyInArrow(_averaged, kind).groupBy("block").applyInArrow(_averaged, kind)


def _averaged(rows: pa.Table) -> pa.Table:  # rows of one block, of at most about the square root of the tasks
    tokens, means = rows["tokens"].to_numpy(), rows["mean"].combine_chunks().flatten().to_numpy().reshape(rows.num_rows, -1)
    mean = pa.array([tokens @ means / tokens.sum()], pa.list_(pa.float64())).cast(pa.list_(pa.float32()))
    return pa.table({"block": rows["block"].slice(0, 1), "part": rows["part"].slice(0, 1), "tokens": [float(tokens.sum())], "mean": mean})


def _dealt(salt: int, n: int) -> Column:
    return F.pmod(F.xxhash64("key", "doc_id", F.lit(salt)), F.lit(n))


def train(table_of_ids: DataFrame, words: Words, total: int) -> np.ndarray | None:
    """The weights after all rounds; None without training documents."""
    spark, vector = table_of_ids.sparkSession, None
    n_shards = max(SHARDS, -(-total // SHARD_TOKENS))
    tasks = min(n_shards, max(SHARDS, int(spark.conf.get("spark.sql.shuffle.partitions"))))
    training = table_of_ids.select("round", _dealt(2, n_shards).alias("shard"), F.xxhash64("key", "doc_id", F.lit(3)).alias("place"), "ids")
    for turn in range(ROUNDS if total else 0):
        shape = spark.sparkContext.broadcast((words.counts[: words.k], words.tail, vector))
        mine = training.where(F.col("round") == turn).repartitionById(tasks, F.pmod("shard", F.lit(tasks)).cast("int")).sortWithinPartitions("shard", "place").select("shard", "ids")
        means = _train_round(mine, shape, tasks).toArrow().sort_by("block")  # no more values than the model has
        if means.num_rows:
            vector = means["mean"].combine_chunks().flatten().to_numpy()
        shape.destroy()
    return vector


def lm_scores(docs: DataFrame) -> DataFrame:
    """Per document row: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score."""
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", held_out(F.col("doc_id")).alias("held_out"))
    counts = written(count_words(docs.where("not held_out")), "lm-counts")
    total, distinct = (x or 0 for x in counts.agg(F.sum("n"), F.count("*")).first())
    least = dictionary_limit(counts, DICTIONARY)
    top = counts.where(F.col("n") > least).toArrow()  # DICTIONARY rows at most
    ranked = sorted(zip(top["word"].to_pylist(), top["n"].to_pylist(), strict=True), key=lambda x: (-x[1], x[0]))
    shared = spark.sparkContext.broadcast((hashlib.sha1(repr(ranked).encode()).hexdigest(), ranked, total))
    words = Words(ranked, total)
    turn = F.when(F.col("held_out"), -1).otherwise(_dealt(1, ROUNDS).cast("int"))
    found = written(encode(docs, shared).withColumn("round", turn), "lm-ids", "round")  # a round reads its documents alone
    shared.destroy()
    fitted = spark.sparkContext.broadcast((words.counts[: words.k], words.tail, train(found, words, total)))

    @F.arrow_udf("double")
    def model_log(columns: Iterator[pa.Array]) -> Iterator[pa.Array]:
        counts, tail, vector = fitted.value
        model, kind = Gru(counts, tail), id_type(len(counts))
        if vector is not None:
            model.load(vector)
        for ids in columns:
            yield pa.array(model.score([np.frombuffer(x, kind) for x in ids.to_pylist()]) if len(ids) else [], pa.float64())
        pa.default_memory_pool().release_unused()

    tasks = max(1, len(found.inputFiles()) // (ROUNDS + 1))  # about as many as wrote it: long batches fill the model's lanes
    out = found.coalesce(tasks).select("doc_id", "held_out", *NUMBERS, "key", model_log("ids").alias("model_log"))
    if distinct > len(ranked):  # the words beyond the dictionary, and their counts
        rest = counts.where(F.col("n") <= least)
        rare = found.select("key", F.explode("rare").alias("x")).select("key", "x.word", "x.tf").join(rest, "word")
        rare = rare.groupBy("key").agg(F.sum(F.col("tf") * F.log10(F.col("n") + 1)).alias("rare_log"), F.sum("tf").alias("n_rare"))
        copies = found.groupBy("key").agg(F.count("*").alias("copies"))  # each copy of a text has brought its words
        out = out.join(rare.join(copies, "key"), "key", "left")
        rare_log, n_rare = F.coalesce(F.col("rare_log") / F.col("copies"), F.lit(0.0)), F.coalesce((F.col("n_rare") / F.col("copies")).cast("long"), F.lit(0).cast("long"))
    else:
        rare_log, n_rare = F.lit(0.0), F.lit(0).cast("long")
    of_all = F.lit(float(np.log10(total + distinct + 1)))
    of_tail = F.lit(float(np.log10(words.tail + (distinct - words.k) + 1)))
    return out.select(
        "doc_id", "held_out", "n_tokens", (F.col("n_head") + n_rare).alias("n_known"), F.lit(total).cast("long").alias("train_tokens"),
        (F.col("head_log") + rare_log - F.col("n_tokens") * of_all).alias("base_score"),
        (F.col("model_log") + F.col("tail_log") + rare_log - F.col("n_tail") * of_tail).alias("score"),
    )


def op4_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_scores(table(spark, sf_dir, "documents"))
