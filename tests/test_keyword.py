"""The keyword index against scoring all documents in plain Python."""

from __future__ import annotations

import math
import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from geoloom.operators import keyword
from geoloom.operators.lineage import scratch


def full(docs, queries, k):
    words = {i: re.findall("[a-z0-9]+", (t or "").lower()) for i, t in docs}
    mean, df = sum(map(len, words.values())) / len(words), Counter(x for w in words.values() for x in set(w))
    out = {}
    for q, text in queries:
        scores = {}
        for i, w in words.items():
            tf = Counter(w)
            s = sum(math.log(1 + (len(words) - df[t] + 0.5) / (df[t] + 0.5)) * tf[t] * 2.2 / (tf[t] + 1.2 * (0.25 + 0.75 * len(w) / mean)) for t in set(re.findall("[a-z0-9]+", (text or "").lower())) if tf[t])
            if s:
                scores[i] = round(s, 9)
        out[q] = sorted(scores.items(), key=lambda x: (-x[1], x[0]))[:k]
    return {q: r for q, r in out.items() if r}


@pytest.fixture(scope="module")
def archive(spark):
    rng = random.Random(8)
    names = [f"w{int(rng.paretovariate(0.6)) % 400}" for _ in range(30_000)]
    docs = [(f"d{i:04}", " ".join(rng.choice(names) for _ in range(rng.randint(1, 40))) + rng.choice(["", ". Built near the RIVER", ", cleared"])) for i in range(1500)]
    docs += [("z1", None), ("z2", ""), ("z3", "river"), ("z4", "river")]
    queries = [(f"q{i:03}", " ".join(rng.choice(names) for _ in range(rng.randint(1, 6)))) for i in range(97)] + [("q097", "the river"), ("q098", "nowhere"), ("q099", None)]
    path = scratch(spark, "keywords")
    frame = spark.createDataFrame(docs, "id string, text string")
    for segment in range(3):  # the third one comes later, without a rebuild
        keyword.write(frame.where(F.pmod(F.xxhash64("id"), F.lit(3)) == segment), path, segment, block=40)
    return docs, queries, path


def test_bounded_search_is_the_full_one(spark, archive):
    docs, queries, path = archive
    got = {}
    for r in keyword.search(spark, path, spark.createDataFrame(queries, "query_id string, text string"), 5).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.id, r.score))
    want = full(docs, queries, 5)
    assert {q: [i for i, _ in r] for q, r in got.items()} == {q: [i for i, _ in r] for q, r in want.items()} and len(want) > 90
    assert all([s for _, s in got[q]] == pytest.approx([s for _, s in want[q]], abs=1e-6) for q in want)


def test_a_segment_written_again_replaces_itself(spark, archive):
    docs, queries, path = archive
    frame = spark.createDataFrame(docs, "id string, text string")
    keyword.write(frame.where(F.pmod(F.xxhash64("id"), F.lit(3)) == 2), path, 2, block=40)
    rows = spark.read.schema(keyword.POSTINGS).parquet(f"{path}/postings").select(F.explode("docs").alias("d"), "term", "least", "most")
    assert rows.groupBy("term", "d.id").count().where("count > 1").count() == 0
    assert rows.where("d.tf > most OR d.length < least OR size(d.places) <> d.tf").count() == 0


def test_phrases(spark, archive):
    docs, _, path = archive
    queries = [("a", "near the river"), ("b", "river the"), ("c", "built near"), ("d", "river")]
    got = {(r.query_id, r.id): r.times for r in keyword.phrases(spark, path, spark.createDataFrame(queries, "query_id string, text string")).collect()}
    want = {}
    for q, text in queries:
        p = text.split()
        for i, t in docs:
            w = re.findall("[a-z0-9]+", (t or "").lower())
            if n := sum(w[j : j + len(p)] == p for j in range(len(w))):
                want[q, i] = n
    assert got == want and any(q == "a" for q, _ in want) and not any(q == "b" for q, _ in want)


def test_pairs_of_queries_and_documents_are_not_sent(spark, archive, monkeypatch):
    """Repeated questions, several shares of sets and of documents: the full result, from k documents of a set and share at most."""
    docs, queries, path = archive
    monkeypatch.setattr(keyword, "SETS", 30)
    monkeypatch.setattr(keyword, "DOCS", 200)
    queries = queries + [(f"r{q}", " ".join(reversed((t or "").split()))) for q, t in queries]
    found = keyword.search(spark, path, spark.createDataFrame(queries, "query_id string, text string"), 5)
    got = {}
    for r in found.orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append(r.id)
    assert got == {q: [i for i, _ in r] for q, r in full(docs, queries, 5).items()}
    assert "Generate explode(docs" not in found._jdf.queryExecution().optimizedPlan().toString()
    assert "FlatMapCoGroupsInArrow" in found._jdf.queryExecution().optimizedPlan().toString()
