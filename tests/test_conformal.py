"""Coverage of conformal sets and risk of thresholds on held-out rows."""

from __future__ import annotations

import math
import random
from collections import Counter

from geoloom.operators import conformal
from geoloom.plans import catalog  # noqa: F401
from geoloom.plans.registry import QUERIES


def test_ranks_and_small_groups(spark):
    rows = [("a", float(i)) for i in range(1, 20)] + [("b", 5.0)] * 3 + [("c", None), (None, 1.0)]
    got = {r.g: (r.n, r.threshold) for r in conformal.quantiles(spark.createDataFrame(rows, "g string, s double"), "s", "g", 0.1).collect()}
    assert got == {"a": (19, 18.0), "b": (3, math.inf)}


def test_coverage_by_class(spark):
    """Classes of unlike spread: of each, the true class is in the set for nine of ten held-out rows, within the binomial band."""
    rng = random.Random(12)
    spread = {"road": 0.2, "building": 1.0, "water": 3.0}
    rows = [(i, k, abs(rng.gauss(0, spread[k]))) for i, k in enumerate(rng.choice(list(spread)) for _ in range(9000))]
    table = spark.createDataFrame(rows, "i int, kind string, score double")
    limits = conformal.quantiles(table.where("i % 2 = 0"), "score", "kind", 0.1)
    held = conformal.prediction_sets(table.where("i % 2 = 1"), limits, "i", "kind")
    true = {i: k for i, k, _ in rows}
    hit, n = Counter(), Counter()
    for r in held.collect():
        n[true[r.i]] += 1
        hit[true[r.i]] += true[r.i] in r.classes
    for k in spread:
        assert abs(hit[k] / n[k] - 0.9) <= 4 * math.sqrt(0.9 * 0.1 * 2 / n[k])


def test_risk_is_bounded(spark):
    rng = random.Random(3)
    rows = [(i, "g", c := rng.random(), rng.random() > c) for i in range(8000)]
    table = spark.createDataFrame(rows, "i int, g string, c double, wrong boolean")
    r = conformal.risk_threshold(table.where("i % 2 = 0"), "c", "wrong", 0.1, 0.05, "g").first()
    own = [(c, w) for i, _, c, w in rows if i % 2 == 0]
    assert r.allowed == math.floor(4000 * (0.1 - math.sqrt(math.log(20) / 8000)))
    assert sum(w for c, w in own if c > r.above) <= r.allowed < sum(w for c, w in own if c >= r.above)
    assert sum(w for i, _, c, w in rows if i % 2 and c > r.above) <= 0.1 * 4000
    few = conformal.risk_threshold(table.where("i < 9"), "c", "wrong", 0.1, 0.05, "g").first()
    assert few.above == math.inf and few.allowed == 0
    sure = conformal.risk_threshold(table.where("NOT wrong"), "c", "wrong", 0.1, 0.05, "g").first()
    assert sure.above is None


def test_sets_of_entities_cover_their_labels(spark, sf):
    rows = QUERIES["m_conformal_sets"](spark, sf).collect()
    share = sum(r.label in r.classes for r in rows) / len(rows)
    assert share >= 0.9 - 4 * math.sqrt(0.9 * 0.1 * 3 / len(rows))
