"""Toxicity by a classifier chain of linear models.

Categories are predicted in a fixed order, each by a logistic regression over word features and the probabilities of the
categories before it. While training, those probabilities are out-of-fold: each labelled document gets them from a model
fitted without its fold, so later models see them as noisy as they will be on new documents. Then each category is fitted
once more on all folds.

Training takes at most MAX_LABELLED labelled documents, those with the least hashes of their doc_id; word features are the
MAX_FEATURES words per category with the largest chi-squared score among these. Folds are fitted side by side as Spark
tasks. Scoring reads every document once, with the weights (of bounded size) sent to the tasks, and shuffles nothing.

Defined cases: null and empty texts get the probabilities of a document without features; labels that are null, or of
documents that don't exist, are not used; a category whose labels are all equal, or none at all, is predicted as that
constant (0 without labels), so that an empty labels table rejects nothing; repeated rows are judged alike; an empty table
gives no rows; other columns are kept by `score`.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from geoloom.llm.common import byte_rows, slices, table, tidied, written
from geoloom.llm.decontaminate import words

MAX_LABELLED = 12_000
MAX_FEATURES = 400
MIN_DOCS = 3
MIN_CHI2 = 10.83  # one in a thousand by chance
FOLDS = 3
ITERATIONS = 200
RIDGE = 1e-3
THRESHOLD = 0.35  # missing a toxic document costs more than losing a clean one
MODELS = pa.schema([("target", pa.int32()), ("weights", pa.list_(pa.float64())), ("ids", pa.list_(pa.int64())), ("p", pa.list_(pa.float64()))])
#: The chain, in order: category and its SQL over the labels table.
CATEGORIES = {"low_quality": "1 - quality", "toxic": "toxic"}


def features(text: bytes, index: dict[bytes, int]) -> tuple[np.ndarray, np.ndarray]:
    """Places and values (log counts) of the features of a text."""
    found = Counter(i for i in map(index.get, words(text)) if i is not None)
    return np.fromiter(found.keys(), np.int64, len(found)), np.log1p(np.fromiter(found.values(), np.float64, len(found)))


def fit(z: np.ndarray, y: np.ndarray, iterations: int = ITERATIONS, ridge: float = RIDGE) -> np.ndarray:
    """Weights of a logistic regression, bias last, by Nesterov's accelerated gradient on scaled columns. z: features, and a
    last column of ones; it is scaled in place, so that a fit needs no second matrix."""
    if not len(y) or y.min() == y.max():
        return np.append(np.zeros(z.shape[1] - 1), 40.0 if len(y) and y[0] else -40.0)
    scale = 1 / np.maximum(np.sqrt(np.einsum("ij,ij->j", z, z) / len(z))[:-1], 1e-6)
    np.multiply(z[:, :-1], scale, out=z[:, :-1], casting="same_kind")
    v = np.full(z.shape[1], 1 / np.sqrt(z.shape[1]), z.dtype)
    for _ in range(8):
        v = z.T @ (z @ v)
        v /= np.linalg.norm(v)
    step = 1 / (0.25 * np.linalg.norm(z @ v) ** 2 / len(y) * 1.05 + ridge)
    w, look = np.zeros(z.shape[1]), np.zeros(z.shape[1])
    for i in range(iterations):
        slope = z.T @ (sigmoid(z @ look.astype(z.dtype)) - y).astype(z.dtype) / len(y) + ridge * np.append(look[:-1], 0)
        new = look - step * slope
        look, w = new + i / (i + 3) * (new - w), new
    return np.append(w[:-1] * scale, w[-1])


def sigmoid(t: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(t, -40, 40)))


def _dense(places, values, before, n: int) -> np.ndarray:
    """Words, earlier probabilities and a column of ones."""
    x = np.zeros((len(places), n + len(before[0]) + 1) if len(places) else (0, n + 1), np.float32)
    for row, (i, v, p) in enumerate(zip(places, values, before, strict=True)):
        x[row, i], x[row, n:-1], x[row, -1] = v, p, 1
    return x


class Chain:
    """The vocabulary and, by category, its weights: words, then probabilities of earlier categories, then the bias."""

    def __init__(self, vocabulary: list[bytes], weights: dict[str, np.ndarray]):
        self.index, self.weights = {w: i for i, w in enumerate(vocabulary)}, weights

    def score(self, text: bytes) -> list[float]:
        places, values = features(text, self.index)
        n, out = len(self.index), []
        for w in self.weights.values():
            out.append(float(sigmoid(np.asarray(w[places] @ values + np.dot(w[n:-1], out) + w[-1]))))
        return out


def labelled(docs: DataFrame, labels: DataFrame, categories: dict[str, str] = CATEGORIES, bound: int = MAX_LABELLED) -> DataFrame:
    """doc_id, text, fold and a 0/1 column for each category of at most bound labelled documents."""
    y = labels.select(F.col("doc_id").cast("long").alias("y_doc"), *(F.expr(sql).cast("double").alias(f"y_{name}") for name, sql in categories.items())).dropna().dropDuplicates(["y_doc"])
    ids = docs.select(F.col("doc_id").cast("long").alias("doc_id")).join(y, F.col("doc_id") == F.col("y_doc")).drop("y_doc").dropDuplicates(["doc_id"])
    chosen = ids.orderBy(F.xxhash64("doc_id"), "doc_id").limit(bound)
    texts = docs.select(F.col("doc_id").cast("long").alias("t_doc"), "text")
    found = texts.join(F.broadcast(chosen), F.col("t_doc") == F.col("doc_id")).drop("t_doc")  # at most bound rows
    return found.withColumn("fold", F.pmod(F.xxhash64("doc_id", F.lit(7)), F.lit(FOLDS)).cast("int"))


def vocabulary(sample: DataFrame, categories: dict[str, str] = CATEGORIES) -> list[bytes]:
    """The words with the largest chi-squared scores by category."""

    @tidied
    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, 200):
                found = [sorted(set(words(t))) for t in byte_rows(part.column(0))]
                yield pa.RecordBatch.from_arrays([pa.array([w for f in found for w in f], pa.binary()), *(pa.array(np.repeat(c.to_numpy(), [len(f) for f in found])) for c in part.columns[1:])], names=["word", *ys])

    ys = [f"y_{name}" for name in categories]
    total = sample.agg(F.count("*"), *(F.sum(y) for y in ys)).first()
    counts = sample.select("text", *ys).mapInArrow(split, "word binary, " + ", ".join(f"{y} double" for y in ys)).groupBy("word").agg(F.count("*").alias("n"), *(F.sum(y).alias(y) for y in ys)).where(F.col("n") >= MIN_DOCS)
    counts, out = written(counts, "toxicity-words"), set()
    for k, y in enumerate(ys, 1):
        if 0 < (total[k] or 0) < total[0]:
            share = F.lit(total[k] / total[0])
            score = F.pow(F.col(y) - F.col("n") * share, 2) / (F.col("n") * share * (1 - share))
            out |= {bytes(r.word) for r in counts.where(score >= MIN_CHI2).orderBy(score.desc(), "word").limit(MAX_FEATURES).collect()}
    return sorted(out)


def _fold(name: str, n: int):
    def fitted(key: tuple[pa.Scalar, ...], rows: pa.Table) -> pa.Table:  # at most the bound of labelled rows
        """Weights without fold key (all folds: -1), and with them the probabilities of that fold."""
        inside = rows["fold"].to_numpy() != key[0].as_py()
        parts = [rows[c].combine_chunks().to_numpy(zero_copy_only=False) for c in ("places", "counts", "before")]
        w = fit(_dense(*(x[inside] for x in parts), n), rows[f"y_{name}"].to_numpy()[inside])
        outside = [x[~inside] for x in parts]
        p = [float(sigmoid(np.asarray(v @ w[i] + b @ w[n:-1] + w[-1]))) for i, v, b in zip(*outside, strict=True)]
        out = pa.table({"target": [key[0].as_py()], "weights": [w.tolist()], "ids": [rows["doc_id"].to_numpy()[~inside].tolist()], "p": [p]}, MODELS)
        pa.default_memory_pool().release_unused()
        return out

    return fitted


def train(docs: DataFrame, labels: DataFrame, categories: dict[str, str] = CATEGORIES, bound: int = MAX_LABELLED) -> Chain:
    names = list(categories)
    sample = written(labelled(docs, labels, categories, bound), "toxicity-sample")
    vocab = vocabulary(sample, categories)
    index, n = {w: i for i, w in enumerate(vocab)}, len(vocab)

    @tidied
    def featured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                found = [features(t, index) for t in byte_rows(part.column("text"))]
                places, counts = pa.array([i for i, _ in found], pa.list_(pa.int64())), pa.array([v for _, v in found], pa.list_(pa.float64()))
                rest = part.drop_columns(["text"])
                yield pa.RecordBatch.from_arrays([*rest.columns, places, counts], names=[*rest.schema.names, "places", "counts"])

    ys = ", ".join(f"y_{name} double" for name in names)
    rows = sample.select("doc_id", *(f"y_{name}" for name in names), "fold", "text")
    rows = written(rows.mapInArrow(featured, f"doc_id long, {ys}, fold int, places array<long>, counts array<double>"), "toxicity-features")
    rows, weights = rows.withColumn("before", F.array().cast("array<double>")), {}
    for name in names:
        targets = rows.withColumn("target", F.explode(F.array(*(F.lit(k) for k in range(-1, FOLDS)))))
        models = written(targets.repartitionByRange(FOLDS + 1, "target").groupBy("target").applyInArrow(_fold(name, n), "target int, weights array<double>, ids array<long>, p array<double>"), "toxicity-models")
        final = models.where("target = -1").select("weights").first()
        weights[name] = np.array(final.weights) if final else np.append(np.zeros(n + len(weights)), -40.0)
        if name != names[-1]:
            p = models.where("target >= 0").select(F.explode(F.arrays_zip("ids", "p")).alias("x")).select(F.col("x.ids").alias("doc_id"), F.col("x.p").alias("p_new"))
            rows = written(rows.join(p, "doc_id").withColumn("before", F.concat("before", F.array("p_new"))).drop("p_new"), "toxicity-features")
    return Chain(vocab, weights)


def probabilities(docs: DataFrame, chain: Chain, text: str = "text") -> Column:
    """The struct of the categories' probabilities of docs' text. Only the texts go to Python; the weights, of bounded size,
    are sent to every task."""
    names, numbers = list(chain.weights), {k: v.tolist() for k, v in chain.weights.items()}
    shared = docs.sparkSession.sparkContext.broadcast((list(chain.index), numbers))

    @F.arrow_udf("struct<" + ", ".join(f"{c}: double" for c in names) + ">")
    def run(columns: Iterator[pa.Array]) -> Iterator[pa.Array]:
        model = Chain(shared.value[0], {k: np.array(v) for k, v in shared.value[1].items()})
        for column in columns:
            p = np.array([model.score(t) for part in slices(column) for t in byte_rows(part)]).reshape(-1, len(names))
            yield pa.StructArray.from_arrays([pa.array(x) for x in p.T], names)
        pa.default_memory_pool().release_unused()

    return run(docs[text])


def score(docs: DataFrame, chain: Chain) -> DataFrame:
    """A row per document row: doc_id, and p_<category> for each category."""
    scored = docs.select(docs.doc_id.cast("long").alias("doc_id"), probabilities(docs, chain).alias("p"))
    return scored.select("doc_id", *(F.col(f"p.{c}").alias(f"p_{c}") for c in chain.weights))


def keep_clean(docs: DataFrame, chain: Chain, category: str = "toxic", threshold: float = THRESHOLD) -> DataFrame:
    """The rows of docs below the threshold, all columns as they are."""
    return docs.where(probabilities(docs, chain)[category] < threshold)


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    out = score(docs, train(docs, table(spark, sf_dir, "labels")))
    return out.withColumn("toxic", F.col("p_toxic") >= THRESHOLD).withColumn("kept", ~F.col("toxic"))
