"""Learned re-ranking: boosted regression trees on the gradients of nDCG (LambdaMART), with histograms added in Spark.

Rows are (query, id, relevance, features). Each round a query's first `k` rows by the scores so far meet all rows of the query:
places beyond k have no discount, so a pair matters only if one of its rows is among the first. A row's gradient sums over those
few; what the rows beyond k give to the first ones is summed by (query, id). So no query passes through one task, however many
rows it has, and nothing is cut: that is the gradient of nDCG at k.

Trees grow level by level. Tasks add gradients by (node, feature, bin) and give a histogram of fixed size; the sums of a level go to
the driver: nodes x features x bins, which does not grow with the rows. Gradients are whole multiples of 1/UNIT, so sums do not depend
on their order and a repeated task or another partitioning gives the same trees. Of equal gains the first feature and least bin count.

Rows without query, id or relevance are left out of a fit, and repeats of (query, id) count once, the most relevant one. A null or NaN
feature has a bin of its own, below all others. Queries whose rows are all equally relevant have no gradient. Without any gradient a
tree has one leaf of value 0.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from geoloom.operators.lineage import table

UNIT = 65536


@dataclass
class Tree:
    """Nodes in order of levels: the children of i are 2i + 1, for bins up to `at`, and 2i + 2; a leaf's feature is -1."""

    feature: np.ndarray
    at: np.ndarray
    value: np.ndarray
    depth: int

    @staticmethod
    def root(depth: int) -> Tree:
        n = 2 ** (depth + 1) - 1
        return Tree(np.full(n, -1), np.zeros(n, int), np.zeros(n), depth)

    def place(self, bins: np.ndarray) -> np.ndarray:
        node, rows = np.zeros(len(bins), int), np.arange(len(bins))
        for _ in range(self.depth):
            f = self.feature[node]
            node = np.where(f >= 0, 2 * node + 1 + (bins[rows, np.maximum(f, 0)] > self.at[node]), node)
        return node


@dataclass
class Ranker:
    features: list[str]
    edges: list[list[float]]
    trees: list[Tree] = field(default_factory=list)

    def scores(self, bins: np.ndarray, trees: list[Tree] | None = None) -> np.ndarray:
        out = np.zeros(len(bins))
        for t in self.trees if trees is None else trees:
            out += t.value[t.place(bins)]
        return out

    def bins(self) -> Column:
        """The bins of a row's features: 0 for none, else one more than the edges below the value."""

        def one(name: str, edges: list[float]) -> Column:
            v = F.col(name).cast("double")
            below = F.size(F.filter(F.array(*map(F.lit, edges)), lambda e: e < v)) + 1 if edges else F.lit(1)
            return F.when(v.isNull() | F.isnan(v), 0).otherwise(below).cast("int")

        return F.array(*(one(n, e) for n, e in zip(self.features, self.edges, strict=True)))


def _edges(rows: DataFrame, features: list[str], bins: int) -> list[list[float]]:
    """Cut points of each feature at even shares of its rows, by mergeable sketches."""
    shares = F.array(*(F.lit((i + 1) / bins) for i in range(bins - 1)))
    value = lambda n: F.when(~F.isnan(F.col(n).cast("double")), F.col(n).cast("double"))
    found = rows.agg(*(F.percentile_approx(value(n), shares, 10_000).alias(f"f{i}") for i, n in enumerate(features))).first()
    return [sorted(set(x or [])) for x in found]


def _discount(slot: Column) -> Column:
    return 1 / F.log2(slot + 2.0)


def _ideal(rows: DataFrame, k: int) -> DataFrame:
    """query, ideal: the best DCG at k, from counts of each relevance."""
    counts = rows.groupBy("query", "rel").agg(F.count("*").alias("n"))
    w = Window.partitionBy("query").orderBy(F.desc("rel"))
    before = counts.withColumn("before", F.coalesce(F.sum("n").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).where(F.col("before") < k)
    last = F.least(F.col("before") + F.col("n"), F.lit(k))
    discounts = F.aggregate(F.sequence(F.col("before"), last - 1), F.lit(0.0), lambda s, i: s + _discount(i))
    return before.groupBy("query").agg(F.sum((F.pow(F.lit(2.0), "rel") - 1) * discounts).alias("ideal"))


def gradients(rows: DataFrame, k: int) -> DataFrame:
    """rows (query, id, rel, ideal, score, ..) with g and h in units: the gradient of nDCG at k, and its weight."""
    order = Window.partitionBy("query").orderBy(F.desc("score"), "id")
    first = rows.select("query", "id", "rel", "score").withColumn("slot", F.row_number().over(order) - 1).where(F.col("slot") < k)
    first = first.groupBy("query").agg(F.sort_array(F.collect_list(F.struct("slot", "id", "rel", "score"))).alias("top"))  # k at most
    met = rows.join(first, "query").withColumn("slot", F.array_position(F.transform("top", lambda t: t.id), F.col("id")) - 1)
    own = F.when(F.col("slot") >= 0, _discount(F.col("slot"))).otherwise(0.0)
    gain = lambda r: F.pow(F.lit(2.0), r) - 1

    def pair(t: Column) -> Column:
        higher = F.col("rel") > t.rel
        rho = 1 / (1 + F.exp(F.when(higher, F.col("score") - t.score).otherwise(t.score - F.col("score"))))
        delta = F.when((F.col("rel") != t.rel) & (F.col("ideal") > 0), F.abs(gain(F.col("rel")) - gain(t.rel)) * F.abs(own - _discount(t.slot)) / F.col("ideal")).otherwise(0.0)
        g = F.round(rho * delta * UNIT).cast("long")
        return F.struct(t.id.alias("id"), F.when(higher, g).otherwise(-g).alias("g"), F.round(rho * (1 - rho) * delta * UNIT).cast("long").alias("h"))

    met = met.withColumn("pairs", F.transform("top", pair))
    total = lambda name: F.aggregate("pairs", F.lit(0).cast("long"), lambda s, p: s + p[name])
    mine = met.select(*rows.columns, total("g").alias("_g"), total("h").alias("_h"))
    back = met.where("slot < 0").select("query", F.explode("pairs").alias("p")).groupBy("query", F.col("p.id").alias("id")).agg((-F.sum("p.g")).alias("_bg"), F.sum("p.h").alias("_bh"))
    both = mine.join(back, ["query", "id"], "left")
    add = lambda a, b: F.col(a) + F.coalesce(b, F.lit(0))
    return both.select(*rows.columns, add("_g", "_bg").alias("g"), add("_h", "_bh").alias("h"))


def _matrix(f: pd.DataFrame) -> np.ndarray:
    return np.array(f["bins"].tolist(), int).reshape(len(f), -1)


def histogram(rows: DataFrame, tree: Tree, level: int, features: int, bins: int) -> np.ndarray:
    """Sums of g, h and rows by node of the level, feature and bin: an array of fixed size."""
    first, nodes = 2**level - 1, 2**level
    shape = (nodes, features, bins + 1)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros((3, *shape), np.int64)
        for f in frames:
            if not len(f):
                continue
            x, node = _matrix(f), tree.place(_matrix(f)) - first
            here = node >= 0
            for j in range(features):
                cell = (node[here] * features + j) * (bins + 1) + x[here, j]
                for part, weight in zip(total, (f.g.to_numpy()[here], f.h.to_numpy()[here], np.ones(here.sum())), strict=True):
                    part += np.bincount(cell, weight, part.size).astype(np.int64).reshape(shape)
        at = np.flatnonzero(total[2])
        yield pd.DataFrame({"cell": at, **{c: t.ravel()[at] for c, t in zip("ghn", total, strict=True)}})

    sums = rows.select("bins", "g", "h").mapInPandas(run, "cell long, g long, h long, n long").groupBy("cell").agg(*(F.sum(c).alias(c) for c in "ghn"))
    out = np.zeros((3, math.prod(shape)), np.int64)
    for r in sums.collect():  # nodes x features x bins
        out[:, r.cell] = r.g, r.h, r.n
    return out.reshape(3, *shape)


def split(tree: Tree, level: int, sums: np.ndarray, rate: float, ridge: float, least: int) -> None:
    """Values of the level's nodes, and the best split of each that gains."""
    for k in range(2**level):
        i, (g, h, n) = 2**level - 1 + k, (x[k] for x in sums)
        all_g, all_h, all_n = (x[0].sum() for x in (g, h, n))  # every feature sums to the node
        worth = lambda a, b: (a / UNIT) ** 2 / (b / UNIT + ridge)
        tree.value[i] = rate * (all_g / UNIT) / (all_h / UNIT + ridge)
        if level == tree.depth or not all_n:
            continue
        left_g, left_h, left_n = (np.cumsum(x, axis=1)[:, :-1] for x in (g, h, n))
        gain = worth(left_g, left_h) + worth(all_g - left_g, all_h - left_h) - worth(all_g, all_h)
        gain[(left_n < least) | (all_n - left_n < least)] = -1.0
        best = int(np.argmax(np.round(gain, 9)))
        if gain.ravel()[best] > 1e-9:
            tree.feature[i], tree.at[i] = divmod(best, gain.shape[1])


def fit(rows: DataFrame, features: list[str], query: str = "query_id", key: str = "id", relevance: str = "rel", rounds: int = 20, depth: int = 3, k: int = 10, bins: int = 32, rate: float = 0.3, ridge: float = 1.0, least: int = 5) -> Ranker:
    """A ranker from judged rows; relevance is a number from 0 on."""
    clean = rows.dropna(subset=[query, key, relevance]).select(F.col(query).alias("query"), F.col(key).alias("id"), F.col(relevance).cast("double").alias("rel"), *(F.col(f).cast("double").alias(f"f{i}") for i, f in enumerate(features)))
    names = [f"f{i}" for i in range(len(features))]
    once = Window.partitionBy("query", "id").orderBy(F.desc("rel"), *names)
    clean = table(clean.withColumn("_k", F.row_number().over(once)).where("_k = 1").drop("_k"), "rerank-rows")
    ranker = Ranker(names, _edges(clean, names, bins))
    state = clean.join(_ideal(clean, k), "query").select("query", "id", "rel", "ideal", ranker.bins().alias("bins"), F.lit(0.0).alias("score"))
    for _ in range(rounds):
        state = table(gradients(state, k), "rerank-round")
        tree = Tree.root(depth)
        for level in range(depth + 1):
            split(tree, level, histogram(state, tree, level, len(features), bins), rate, ridge, least)
            if level < depth and not (tree.feature[2**level - 1 : 2 ** (level + 1) - 1] >= 0).any():
                break
        ranker.trees.append(tree)
        state = _stepped(state.drop("g", "h"), tree)
    ranker.features = features
    return ranker


def _stepped(state: DataFrame, tree: Tree) -> DataFrame:
    @F.pandas_udf("double")
    def step(bins: pd.Series) -> pd.Series:
        x = np.array(bins.tolist(), int).reshape(len(bins), -1)
        return pd.Series(tree.value[tree.place(x)])

    return state.withColumn("score", F.col("score") + step("bins"))


def scored(rows: DataFrame, ranker: Ranker, name: str = "score") -> DataFrame:
    """rows with the ranker's score."""

    @F.pandas_udf("double")
    def of(bins: pd.Series) -> pd.Series:
        return pd.Series(ranker.scores(np.array(bins.tolist(), int).reshape(len(bins), -1)))

    return rows.withColumn(name, of(ranker.bins()))
