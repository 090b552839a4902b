"""Every registered query against its SQL, and plain Python for those that SQL can't express."""

from __future__ import annotations

import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).parent))
from compare import both, duck

from geoloom.operators import discovery, temporal
from geoloom.plans import catalog  # noqa: F401
from geoloom.plans.registry import QUERIES, SQL
from geoloom.sources.views import Archive


@pytest.fixture(scope="module")
def con(sf):
    return duck(sf)


@pytest.mark.parametrize("name", sorted(SQL))
def test_against_sql(spark, sf, con, name):
    got, want = both(spark, QUERIES[name], SQL[name], sf, con)
    assert got == want


def test_all_have_sql_or_a_test():
    tested = {"f12_mask_regions", "r03_coregistration", "qc_archetypes", "qc_leiden_communities", "t01_index_search", "v06_a14_pca", "w04_w09_v07_rls_baseline", "st1_st5_online_baseline", "st1_trajectory_stream", "t_learned_rerank"}
    assert set(QUERIES) - set(SQL) == tested


def _groups(pairs):
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in pairs:
        x, y = sorted((find(a), find(b)))
        parent[y] = x
    return {x: find(x) for x in parent}


def test_clusters(spark, sf):
    edges = discovery.co_change_edges(Archive(spark, sf).entities, 1)
    want = _groups([(r.source, r.target) for r in edges.collect()])
    got = {r.component: r.n for r in QUERIES["qc_clusters"](spark, sf).collect()}
    assert got == {c: list(want.values()).count(c) for c in set(want.values())}


def test_merged_groups_cover_the_pairs(spark, sf):
    pairs = QUERIES["j09_g02_iou_join"](spark, sf).collect()
    want = _groups([(r.left_id, r.right_id) for r in pairs])
    got = {r.component: r.n for r in QUERIES["j09_a16_merged_groups"](spark, sf).collect()}
    assert got == {c: list(want.values()).count(c) for c in set(want.values())}


def test_pca_lengths(spark, sf):
    import numpy as np

    rows = Archive(spark, sf).vectors.select("entity_id", "embedding").collect()
    x = np.array([r.embedding for r in rows], float)
    w = np.linalg.eigh(np.cov(x.T))[1][:, -8:]
    want = dict(zip([r.entity_id for r in rows], np.linalg.norm(x @ w, axis=1), strict=True))
    got = {r.entity_id: r.length for r in QUERIES["v06_a14_pca"](spark, sf).collect()}
    assert got == pytest.approx(want, abs=1e-5)


def sequential(rows, dims):
    """(date, values, share seen) of one cell in order -> state, z, cusum, interval, in plain Python from the recurrences:
    gain = P x / (0.98 + x' P x), b += gain * residual, P = (P - gain x' P) / 0.98, one dimension after the other."""
    import math

    p = [[1000.0 * (i == j) for j in range(6)] for i in range(6)]
    b, error, past, out, total, run, done = [[0.0] * 6 for _ in range(dims)], [0.1] * dims, [], [], 0.0, 0, False
    for date, values, share in rows:
        if share < 0.8:
            out.append(("NOT_OBSERVED", None, total, None))
            continue
        doy = (date - date.replace(month=1, day=1)).days + 1
        w = 2 * math.pi * doy / 365.25
        x = [1, date.year - 2024 + doy / 365.25, math.cos(w), math.sin(w), math.cos(2 * w), math.sin(2 * w)]
        square = 0.0
        for d in range(dims):
            px, xp = [sum(r[j] * x[j] for j in range(6)) for r in p], [sum(x[i] * p[i][j] for i in range(6)) for j in range(6)]
            down = max(0.98 + sum(x[i] * px[i] for i in range(6)), 1e-6)
            left = values[d] - sum(b[d][i] * x[i] for i in range(6))
            b[d] = [b[d][i] + px[i] / down * left for i in range(6)]
            p = [[(p[i][j] - px[i] / down * xp[j]) / 0.98 for j in range(6)] for i in range(6)]
            error[d] = math.sqrt(0.98 * error[d] ** 2 + 0.02 * left**2)
            square += (left / max(error[d], 1e-6)) ** 2
        z = math.sqrt(square / dims)
        past.append((date, z))
        state, days = "INSUFFICIENT_HISTORY", None
        if len(past) >= 12:
            state, total = "OBSERVED", max(0.0, total + z - 0.5)
            run = run + 1 if total > 4 else 0
            if run >= 3 and not done:
                calm = max((k for k, (_, v) in enumerate(past[:-1]) if v <= 1.2), default=-1)
                state, days, done = "REGIME_CHANGE_DETECTED", max(1, (past[calm + 1][0] - past[max(calm, 0)][0]).days), True
        out.append((state, z, total, days))
    return out


def _cells(rows, key):
    cells = {}
    for r in sorted(rows, key=lambda r: (r.ts, r.seq)):
        cells.setdefault(r[key], []).append(r)
    return cells


def test_baseline_is_sequential(spark, sf):
    got = {(r.cell_id, r.i): r for r in QUERIES["w04_w09_v07_rls_baseline"](spark, sf).collect()}
    found = set()
    for k, rows in _cells(Archive(spark, sf).trajectory.collect(), "cell_id").items():
        for i, (state, z, total, days) in enumerate(sequential([(r.obs_date, [r.value / 50, r.ndvi or 0.0], r.valid_fraction) for r in rows], 2)):
            r = got.pop((k, i))
            found.add(state)
            assert (r.obs_state, r.interval_days) == (state, days) and r.z == pytest.approx(z, abs=2e-6) and r.cusum == pytest.approx(total, abs=1e-4)
    assert not got and len(found) == 4


def test_baseline_over_batches(spark, sf):
    """Cells that go on over many batches of a task keep their fit."""
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    rows = lambda: sorted(map(tuple, QUERIES["w04_w09_v07_rls_baseline"](spark, sf).collect()), key=str)
    want = rows()
    try:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
        assert rows() == want
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)


def test_online_baseline_is_the_batch_one(spark, sf):
    got = {r.event_id: r for r in QUERIES["st1_st5_online_baseline"](spark, sf).collect()}
    for rows in _cells(Archive(spark, sf).trajectory.collect(), "cell_no").values():
        want = sequential([(r.obs_date, [r.value / 50], r.valid_fraction) for r in rows], 1)
        for r, (state, z, total, _) in zip(rows, want, strict=True):
            x = got.pop(r.seq)
            assert x.obs_state == state and x.z == pytest.approx(z, abs=2e-6) and x.cusum == pytest.approx(total, abs=1e-4)
    assert not got


def test_hash_chain_holds_and_shows_tampering(spark, sf):
    import hashlib
    import json

    from pyspark.sql import functions as F

    from geoloom.sources import sinks

    rows = QUERIES["w11_w10_hash_chain"](spark, sf).collect()
    assert all(r.entries == r.linked == r.intact for r in rows)
    ledger = sinks.chained(Archive(spark, sf).audit.where("log_id < 6"))
    prev = "0" * 64
    for r in ledger.orderBy("log_id").collect():
        text = json.dumps({"action": r.action, "actor": r.actor, "entity_id": r.entity_id, "log_id": r.log_id, "payload": r.payload, "prev_hash": prev}, separators=(",", ":"))
        assert r.prev_hash == prev and r.entry_hash == hashlib.sha256(text.encode()).hexdigest()
        prev = r.entry_hash
    forged = ledger.withColumn("action", F.when(F.col("log_id") == 3, "forged").otherwise(F.col("action")))
    assert [r.log_id for r in sinks.verify_chain(forged).where("NOT intact").collect()] == [3]


def test_chains_are_not_gathered_in_rows(spark):
    """Long chains, read in several batches and not held in one array."""
    from pyspark.sql import functions as F

    from geoloom.sources import sinks

    log = spark.range(30_000).select(F.col("id").alias("log_id"), F.lit("view \"é\"").alias("action"), F.concat(F.lit("u"), F.col("id") % 2).alias("actor"), F.lit(None).cast("string").alias("entity_id"), F.lit("{}").alias("payload"))
    ledger = sinks.chained(log, chain="actor")
    assert "collect_list" not in ledger._jdf.queryExecution().toString()
    checked = sinks.verify_chain(ledger, "actor")
    assert checked.count() == 30_000 and checked.where("NOT (linked AND intact)").count() == 0


def test_spatial_search_uses_exact_distances(spark, sf):
    from geoloom.operators import geo
    from geoloom.plans.archive import PLAN

    a = Archive(spark, sf)
    near = {r.entity_id for r in geo.near_pairs(a.entities.select("entity_id", "lon", "lat"), a.segments.where("layer = 'ref_water'"), PLAN.distance_m).collect()}
    rows = QUERIES["qe_spatial_search"](spark, sf).orderBy("rank").collect()
    assert [r.rank for r in rows] == list(range(1, len(rows) + 1))
    assert {r.entity_id for r in rows} <= near
    assert [r.final for r in rows] == sorted((r.final for r in rows), reverse=True)
    assert all((r.explanation is not None) == (r.rank <= 5) for r in rows)


def test_distances_near_the_poles_and_over_the_antimeridian(spark):
    """Every point and segment within reach meet, wherever they lie: against all pairs."""
    import random

    from pyspark.sql import functions as F

    from geoloom.operators import geo

    rng = random.Random(4)
    places = [(x + rng.uniform(-0.02, 0.02), y + rng.uniform(-0.02, 0.02)) for x, y in ((179.995, 10), (-179.995, 10), (20, 78), (20, -69), (0, 0)) for _ in range(12)]
    wrap = lambda x: (x + 180) % 360 - 180
    points = spark.createDataFrame([(i, wrap(x), y) for i, (x, y) in enumerate(places)], "entity_id int, lon double, lat double")
    lines = spark.createDataFrame([(i, wrap(x), y, wrap(x + rng.uniform(-0.03, 0.03)), y + 0.01) for i, (x, y) in enumerate(places)], "ref_id int, x1 double, y1 double, x2 double, y2 double")
    d = geo.segment_distance_m(*(F.col(c) for c in ("lon", "lat", "x1", "y1", "x2", "y2")))
    want = {(r.entity_id, r.ref_id) for r in points.crossJoin(lines).where(d <= 1500).collect()}
    got = [(r.entity_id, r.ref_id) for r in geo.near_pairs(points, lines, 1500.0).collect()]
    assert len(want) > 60 and set(got) == want and len(got) == len(want)
    assert any(abs(places[i][0]) > 179 and wrap(places[i][0]) * wrap(places[j][0]) < 0 for i, j in want)
