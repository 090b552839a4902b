"""Ranking metrics by blocks against all pairs in plain Python: small blocks, rare labels, ties, nulls."""

from __future__ import annotations

import math
import random

import pytest
from pyspark.sql import functions as F

from geoloom.operators import evaluate


def test_metrics_equal_all_pairs(spark, monkeypatch):
    monkeypatch.setattr(evaluate, "BLOCK", 7)
    monkeypatch.setattr(evaluate, "ASKED", 3)
    rng = random.Random(2)
    rows = [(i, f"e{i:03}", rng.choice([1, 1, 2, 3, None]), [rng.gauss(0, 1) for _ in range(4)]) for i in range(60)]
    rows += [(60 + i, f"e{60 + i:03}", 9, [(-1.0) ** i * 5, 1.0, 0.0, 0.0]) for i in range(2)]  # each other's only hit, far off
    rows += [(70 + i, f"e{70 + i:03}", 1, rows[3][3]) for i in range(5)]  # copies
    rows += [(80, "e080", 77, [1.0, 2.0, 3.0, 4.0]), (90, "e090", 1, None)]
    table = spark.createDataFrame(rows, "vec_id long, entity_id string, label long, embedding array<double>").repartition(4)
    asked = F.col("vec_id") % 3 == 0
    full = [r for r in rows if r[3]]
    norm = lambda v: math.sqrt(sum(x * x for x in v)) + 1e-7
    cos = lambda a, b: round(sum(x * y for x, y in zip(a, b, strict=True)) / norm(a) / norm(b), 9)
    places = {q[0]: sorted(((-cos(q[3], v[3]), v[1], q[2] is not None and v[2] == q[2]) for v in full if v[0] != q[0]), key=lambda p: p[:2]) for q in full if q[0] % 3 == 0}
    recall = {r.query_id: (r.recall, r.first_hit) for r in evaluate.recall(table, asked, 2).collect()}
    ndcg = {r.query_id: r.ndcg for r in evaluate.ndcg(table, asked, 4).collect()}
    assert recall.keys() == ndcg.keys() == places.keys()
    late = 0
    for q, order in places.items():
        hits = [i + 1 for i, p in enumerate(order) if p[2]]
        late += bool(hits) and hits[0] > 4
        assert recall[q] == (pytest.approx(sum(h <= 2 for h in hits) / max(1, len(hits))), hits[0] if hits else None)
        best = sum(7 / math.log2(i + 2) for i in range(min(4, len(hits))))
        assert ndcg[q] == pytest.approx(sum(7 / math.log2(h + 1) for h in hits if h <= 4) / best if best else 1.0)
    assert late > 1
    label = {r[0]: r[2] for r in full}
    own = {}
    for q in places:
        own.setdefault(label[q], []).extend(cos(next(r[3] for r in full if r[0] == q), v[3]) for v in full if v[0] != q and v[2] == label[q])
    assert {r.label: r.spread for r in evaluate.spreads(table, asked).collect()} == {k: pytest.approx(max(c) - min(c)) for k, c in own.items() if c and k is not None}
    assert evaluate.ndcg(table.where("false"), asked, 4).count() == evaluate.recall(table.where("false"), asked, 4).count() == 0
