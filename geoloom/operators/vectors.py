"""Vectors as array columns: norms, cosines, top-k, centroids, feedback, projections."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def doubles(v: Column | str) -> Column:
    return F.transform(v, lambda x: x.cast("double"))


def dot(a: Column | str, b: Column | str) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(v: Column | str) -> Column:
    return F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))


def normalized(v: Column | str) -> Column:
    """v over its length; the guard keeps a zero vector at zero."""
    return F.transform(v, lambda x: x.cast("double") / (norm(v) + F.lit(1e-7)))


def cosine(a: Column | str, b: Column | str) -> Column:
    return dot(a, b) / ((norm(a) + F.lit(1e-7)) * (norm(b) + F.lit(1e-7)))


def rescaled(cos: Column) -> Column:
    """A cosine as a score in [0, 1]."""
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), (cos + 1) / 2))


def mean_vector(df: DataFrame, v: str = "embedding", *by: str) -> DataFrame:
    """The mean of the vectors, by group: positions are averaged apart, with partial sums before the shuffle."""
    parts = df.select(*by, F.posexplode(v).alias("pos", "x")).groupBy(*by, "pos").agg(F.avg(F.col("x").cast("double")).alias("x"))
    ordered = F.transform(F.sort_array(F.collect_list(F.struct("pos", "x"))), lambda p: p.x)  # as long as a vector
    return parts.groupBy(*by).agg(ordered.alias("mean"))


def with_row(df: DataFrame, one: DataFrame) -> DataFrame:
    """df with the columns of a table of one row."""
    return df.join(F.broadcast(one.limit(1)), F.lit(True))


def top_k(df: DataFrame, query: DataFrame, k: int, v: str = "embedding", key: str = "entity_id") -> DataFrame:
    """The k rows of df nearest to query.q by cosine: columns of df, cosine. Ties go to the least key."""
    scored = with_row(df, query.select("q")).withColumn("cosine", F.round(cosine(v, "q"), 9)).drop("q")
    return scored.orderBy(F.desc("cosine"), key).limit(k)


def rocchio(query: Column, positive: Column, negative: Column, alpha: float = 1.0, beta: float = 0.75, gamma: float = 0.25) -> Column:
    moved = F.zip_with(F.zip_with(query, positive, lambda q, p: alpha * q.cast("double") + beta * p), negative, lambda s, n: s - gamma * n)
    return normalized(moved)
