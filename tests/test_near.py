"""Distance joins against all pairs, and what their plans do for a pair."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from geoloom.operators import geo


@pytest.fixture(scope="module")
def places(spark):
    """Points and segments, short and long, level and upright, at the antimeridian and far north; one key twice, one null."""
    rng = random.Random(8)
    wrap = lambda x: (x + 180) % 360 - 180
    points, lines = [], []
    for i in range(90):
        x, y = rng.choice(((77.2, 28.6), (179.99, 10), (20, 84), (0, 0)))
        points.append((f"e{i:02}" if i else None, wrap(x + rng.uniform(-0.08, 0.08)), y + rng.uniform(-0.05, 0.05)))
        far, x1, y1 = rng.choice((0.0, 0.02, 0.4)), x + rng.uniform(-0.08, 0.08), y + rng.uniform(-0.05, 0.05)
        lines.append((i, wrap(x1), y1, wrap(x1 + rng.choice((0, 1)) * rng.uniform(-far, far)), y1 + rng.choice((0, 1)) * rng.uniform(-far, far)))
    points += [("e01", 77.2, 28.6), ("none", None, 1.0), ("alone", 50.0, 50.0)]
    points, lines = spark.createDataFrame(points, "entity_id string, lon double, lat double"), spark.createDataFrame(lines, "ref_id int, x1 double, y1 double, x2 double, y2 double")
    d = geo.segment_distance_m(*(F.col(c) for c in ("lon", "lat", "x1", "y1", "x2", "y2")))
    every = [tuple(r) for r in points.crossJoin(lines).select("entity_id", "lon", "ref_id", d.alias("d")).where("d is not null").collect()]
    return points, lines, every


def conditions(df):
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    return [line for line in plan.split("\n") if "Join " in line]


def test_nearest(places):
    points, lines, every = places
    want = {}
    for key, _, ref, d in every:
        if d <= 3000:
            want[key] = min(want.get(key, (9e9, 0)), (d, ref))
    near = geo.nearest(points, lines, 3000.0)
    got = near.collect()
    assert {r.entity_id: (r.distance_m, r.ref_id) for r in got} == {k: (pytest.approx(d, abs=1e-6), ref) for k, (d, ref) in want.items()}
    assert len(got) == len(want) > 50
    # the widest search is left to points that the closer ones have not found, and a pair takes no cosines
    assert any("LeftAnti" in line for line in conditions(near)) and not any("COS(" in line for line in conditions(near))


def test_within(places):
    """A point stops at its first feature: the join of pairs is a semi join."""
    points, lines, every = places
    for reach in (200.0, 3000.0, 20000.0):
        keys = {key for key, _, _, d in every if key is not None and d <= reach}
        near = geo.within_distance(points, lines, reach)
        assert sorted(r.entity_id for r in near.collect()) == sorted([*keys, *({"e01"} & keys)])
    assert all("LeftSemi" in line for line in conditions(near)) and any("_cx" in line for line in conditions(near))


def test_pairs_carry_their_relation(spark, sf, places):
    """Pairs are joined once, on cells; what the query tells of a segment comes with it. Distances are those of the column."""
    from geoloom.plans import catalog  # noqa: F401
    from geoloom.plans.registry import QUERIES

    assert len(conditions(QUERIES["j03_relation_table"](spark, sf))) == 1
    points, lines, every = places
    got = geo.near_pairs(points, lines.withColumn("kind", F.col("ref_id") % 3), 5000.0, keep=("kind",)).collect()
    want = {(key, ref, round(d, 6)) for key, _, ref, d in every if d <= 5000}
    assert {(r.entity_id, r.ref_id, round(r.distance_m, 6)) for r in got} == want and all(r.kind == r.ref_id % 3 for r in got)


def test_plan_fields_make_no_pairs(spark, sf):
    """Relations of a plan are semi joins, however many segments lie near."""
    from geoloom.plans import catalog  # noqa: F401
    from geoloom.plans.registry import QUERIES

    joins = conditions(QUERIES["qe_plan_fields"](spark, sf))
    assert joins and all("LeftSemi" in line for line in joins)
