"""The archive's own small fixtures: parser, plan, basis, breaks, set semantics."""

from __future__ import annotations

import datetime

import numpy as np
import pytest
from pyspark.sql import functions as F

from geoloom.functions import scalars as S
from geoloom.operators import temporal
from geoloom.plans.dsl import Plan, parse, stage_one, stage_order

Q = "Find new structures within 500 m of the river between 2024 and 2025"


def test_parse():
    p = parse(Q)
    assert (p.entity_type, p.relation, p.distance_m, p.from_date, p.to_date) == ("building", "near_water", 500.0, "2024-01-01", "2025-12-31")
    assert parse("roads 10 months ago").distance_m == 10.0  # "10 m" of months, as the rule reads it
    assert parse("forest cleared").change_types == ("clearance",)


def test_parser_forms_agree(spark):
    texts = [Q, "Paved highway within 20 meters in 2023", "Lake flood", "convoy 5 km away", "2025 to 2023 demolished compound", ""]
    cols = S.parsed_question(F.col("t"))
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select("t", *(c.alias(n) for n, c in cols.items())).collect()
    for r in rows:
        p = parse(r.t)
        assert (r.entity_type, r.relation, r.distance_m, r.change_type, r.from_date, r.to_date) == (p.entity_type, p.relation, p.distance_m, p.change_types[0], p.from_date, p.to_date)


def test_plan_is_checked():
    for bad in ({"limit": 0}, {"limit": 101}, {"relation": "near_moon"}, {"min_confidence": 2.0}, {"on_empty": "some"}):
        with pytest.raises(ValueError):
            Plan(**bad)


def test_stage_order():
    assert stage_order(Plan(from_date="2024-01-01", to_date="2024-03-01"))[0] == "temporal"
    assert stage_order(parse(Q))[0] == "spatial"
    assert stage_order(Plan())[0] == "semantic"


def test_empty_first_stage(spark, sf):
    from geoloom.sources.views import Archive

    e = Archive(spark, sf).entities
    assert stage_one(e, Plan(entity_type="none")).count() == 0
    assert stage_one(e, Plan(entity_type="none", on_empty="all")).count() == e.count()


def test_basis():
    (b,) = temporal.basis([datetime.date(2024, 6, 28)])
    assert len(b) == 6 and b[0] == 1 and b[1] == pytest.approx(180 / 365.25)


def _months(n, year=2024):
    return [datetime.date(year + (i // 12), i % 12 + 1, 15) for i in range(n)]


def test_stable_series_has_no_break():
    cell = temporal.Online(4)
    assert all(cell.observe(d, [1, 0.5, -0.5, 0.2], 0.95)["lower"] is None for d in _months(15))


def test_shift_is_found():
    cell = temporal.Online(4)
    for d in _months(15):
        cell.observe(d, [1, 0.5, -0.5, 0.2], 0.95)
    got = [cell.observe(d, [6, 5.5, 4.5, 5.2], 0.95) for d in _months(6, 2025)]
    found = [g for g in got if g["obs_state"] == "REGIME_CHANGE_DETECTED"]
    assert len(found) == 1 and found[0]["interval_days"] >= 1


def test_state_of_a_stream_does_not_grow():
    import pickle

    cell, sizes = temporal.Online(1), []
    for k in range(60):
        for d in _months(12, 2000 + k):
            cell.observe(d, [k % 7 - (d.month > 6) * 5], 0.95)
        sizes.append(len(pickle.dumps(cell)))
    assert max(sizes[5:]) - min(sizes[5:]) < 40


def test_cloud_is_not_observed():
    assert temporal.Online(1).observe(datetime.date(2024, 1, 1), [1.0], 0.5)["obs_state"] == "NOT_OBSERVED"


def test_cusum_identity(spark):
    rng = np.random.default_rng(0)
    z = np.round(rng.uniform(0, 1.4, 200), 3).tolist()
    rows = spark.createDataFrame([("a", i, v) for i, v in enumerate(z)], "cell_id string, i int, z double")
    got, s = [r.cusum for r in temporal.cusum(rows).orderBy("i").collect()], 0.0
    for v, g in zip(z, got, strict=True):
        s = max(0.0, s + v - 0.5)
        assert g == pytest.approx(s, abs=1e-5)


def test_merge_and_windows(spark):
    from geoloom.operators.selection import chip_windows
    from geoloom.sources import sinks

    old, new = spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string"), spark.createDataFrame([(2, "c"), (3, "d")], "k int, v string")
    assert sorted(map(tuple, sinks.merged(old, new, "k").collect())) == [(1, "a"), (2, "c"), (3, "d")]
    assert sorted(map(tuple, sinks.only_new(old, new, "k").collect())) == [(3, "d")]
    assert chip_windows(spark.createDataFrame([("s",)], "scene_id string"), 2485, 2491, 256, 128).count() == 18 * 18


def test_gates_and_fusion(spark):
    row = spark.range(1).select(
        F.size(F.filter(S.gates(F.lit(0.97), F.lit(0.18), F.lit(True), F.lit(5.2), F.lit(4.1)), lambda g: g.passed)).alias("n"),
        S.agreement(F.lit(5.2), F.lit(4.1), F.lit(0.05)).change_class.alias("both"), S.agreement(F.lit(5.2), F.lit(0.1), F.lit(0.4)).change_class.alias("cloud"), S.spatial_relevance(F.lit(None).cast("double")).alias("unknown"),
    ).first()
    assert tuple(row) == (5, "structural", "cloud_artifact_suspected", 0.5)


def test_config(tmp_path):
    from geoloom.sources import config

    (tmp_path / "c.yaml").write_text("ranking: {change: 0.4, semantic: 0.1}\ntemporal: {limit: 5}\n")
    s = config.load(str(tmp_path / "c.yaml"))
    assert s.weights["change"] == 0.4 and s.weights["spatial"] == 0.25 and s.limit == 5.0 and s.drift == 0.5
    (tmp_path / "c.json").write_text('{"ranking": {"change": 0.9}}')
    with pytest.raises(ValueError):
        config.load(str(tmp_path / "c.json"))


def test_engine(spark, sf):
    from geoloom.engine import Engine
    from geoloom.sources import sinks
    from geoloom.sources.config import Settings

    e = Engine(spark, sf)
    assert e.search(Q, limit=5, like="ENT_000007").count() <= 5
    assert e.explain(e.compile(Q))[0] == "spatial"
    assert e.entity("ENT_000001").count() == 1 and e.layer("ref_water").count() > 0
    assert "ENT_000007" not in {r.entity_id for r in e.similar("ENT_000007").collect()}
    assert not {"ENT_000001", "ENT_000002"} & {r.entity_id for r in e.similar_sites(["ENT_000001", "ENT_000002"], 5).collect()}
    with pytest.raises(ValueError):
        e.search(Q)
    strict = Engine(spark, sf, settings=Settings(weights={"change": 1.0, "semantic": 0.0, "spatial": 0.0, "visual": 0.0, "quality": 0.0}, limit=1e9, rocchio=(1.0, 0.0, 0.0)))
    assert all(r.final == pytest.approx(r.change_confidence) for r in strict.search(Q, limit=5, like="ENT_000007").collect())
    assert {r.status for r in strict.timeline("CELL_3").collect()} == {"STABLE"}
    plain = [r.entity_id for r in e.similar("ENT_000007", 12).collect() if r.entity_id not in ("ENT_000001", "ENT_000002")]
    near = strict.refined(e.vector("ENT_000007"), ["ENT_000007", "ENT_000001"], ["ENT_000002"], 10)
    assert [r.entity_id for r in near.collect()] == plain[:10]
    encoded = Engine(spark, sf, encode=lambda text: e.vector("ENT_000007"))
    assert encoded.search(Q, limit=5).collect() == e.search(Q, limit=5, like="ENT_000007").collect()
    ledger = sinks.chained(e.archive.audit.where("log_id < 4"))
    entry = spark.createDataFrame([(99, "a", "confirm", "ENT_000001", "{}")], e.archive.audit.schema)
    grown = e.verdict(ledger, entry)
    assert sinks.verify_chain(grown).where("NOT (linked AND intact)").count() == 0 and grown.count() == 5


def test_ingest_goes_on_after_a_restart(spark, sf, tmp_path):
    """Two runs over files that land one after the other give the table of all; a batch rewrites only what it touches."""
    import pyarrow.parquet as pq

    from geoloom.sources.views import Archive
    from geoloom.streaming import jobs

    vectors = pq.read_table(f"{sf}/embeddings.parquet")
    land, base, state = (str(tmp_path / x) for x in ("land", "table", "state"))
    (tmp_path / "land").mkdir()
    run = lambda: jobs.ingest(spark, land, base, state, "embeddings*.parquet")
    pq.write_table(vectors.slice(0, 100), f"{land}/embeddings.parquet")
    assert run().count() == 100
    pq.write_table(vectors.slice(99, 2), f"{land}/embeddings-2.parquet")
    assert run().count() == 101
    written = spark.read.parquet(base).select("part", "version").distinct().groupBy("version").count().collect()
    assert {r.version: r["count"] for r in written}[1] <= 2
    pq.write_table(vectors.slice(101), f"{land}/embeddings-3.parquet")
    want = Archive(spark, sf).entities.select("entity_id", "entity_type", "last_seen")
    assert sorted(run().collect()) == sorted(want.collect())
    assert sorted(jobs.current(spark, base, before=2).drop("part").collect()) == sorted(want.where("vec_id < 101").collect())


def test_status_of_a_stream(spark, sf):
    from geoloom.streaming import jobs

    events = jobs.events(spark, sf)
    query = jobs.tumbling(events).writeStream.format("noop").option("checkpointLocation", jobs.scratch(spark, "status")).trigger(availableNow=True).start()
    query.awaitTermination()
    got = jobs.status(query)
    assert got["batch"] >= 0 and not got["active"] and got["watermark"]


def test_plan_fields_are_checked(spark, sf):
    from geoloom.sources.views import Archive

    for wrong in ({"time_field": "seen"}, {"sensors": ("landsat",)}, {"relations": (("near_moon", 1.0),)}):
        with pytest.raises(ValueError):
            Plan(**wrong)
    a = Archive(spark, sf)
    with pytest.raises(ValueError):
        stage_one(a.entities, Plan(relation="near_rail"))  # no distances are kept for it
    assert stage_one(a.entities, Plan(relation="near_rail"), a.segments).count() == 0  # and no such features
    assert stage_one(a.entities, Plan(sensors=("sentinel-1", "sentinel-2"))).count() == a.entities.count()


def test_refined_mask_without_its_model(spark, sf):
    from geoloom.operators.raster import refined_clear
    from geoloom.sources.views import Archive

    def broken(bands):
        raise RuntimeError("no weights")

    p = Archive(spark, sf).pixels
    assert p.where(refined_clear(p.is_valid, ["blue"], broken)).count() == p.where("is_valid").count()


def test_elapsed_until_now(spark):
    row = spark.range(1).select(S.elapsed_seconds(F.current_timestamp() - F.expr("interval 90 seconds")).alias("s")).first()
    assert row.s in (90, 91)


def test_failures_of_a_mask_model_are_counted(spark, sf):
    from geoloom.operators.raster import refined
    from geoloom.sources.views import Archive

    def broken(f):
        raise ValueError("no such band")

    p = Archive(spark, sf).pixels.limit(50).select("is_valid", "blue")
    assert p.select(refined(p.is_valid, ["blue"], broken).alias("r")).where("r.failed").count() == 50

    def wrong(f):
        raise TypeError("a fault in the model's code")

    with pytest.raises(Exception, match="a fault in the model"):
        p.select(refined(p.is_valid, ["blue"], wrong).alias("r")).collect()


def test_a_null_key_is_a_cell(spark):
    import datetime

    from geoloom.operators import temporal

    day = datetime.date(2024, 1, 5)
    rows = [(k, i, day + datetime.timedelta(days=30 * i), [float(i % 3)], 0.9) for k in (None, "a", "b") for i in range(14)]
    df = spark.createDataFrame(rows, "cell_id string, i int, obs_date date, values array<double>, valid_fraction double").repartition(3)
    got = temporal.scored(df, 1).collect()
    by = lambda k: [(r.i, r.z) for r in sorted(got, key=lambda r: r.i) if r.cell_id == k]
    assert len(got) == 42 and by(None) == by("a") == by("b")


def test_first_seen_is_a_table_that_goes_on(spark, tmp_path):
    from geoloom.streaming import jobs

    land, base, state = (str(tmp_path / x) for x in ("land", "base", "state"))
    run = lambda: sorted(map(tuple, jobs.first_seen(spark.readStream.schema("user_id long, event_type string, x int").parquet(land), base=base, state=state).collect()), key=str)
    put = lambda rows: spark.createDataFrame(rows, "user_id long, event_type string, x int").coalesce(1).write.mode("append").parquet(land)
    put([(1, "a", 1), (1, "a", 2), (None, "a", 3)])
    assert run() == [(1, "a"), (None, "a")]
    put([(1, "a", 4), (None, "a", 5), (2, "b", 6), (2, "b", 7)])
    assert run() == sorted([(1, "a"), (None, "a"), (2, "b")], key=str) == run()


def test_connected_parts_of_long_chains(spark):
    """Many rounds, whose plan does not grow: its size in bytes is that of the labels."""
    import random

    from geoloom.operators import discovery

    names = [f"{i:04}" for i in range(400)]
    random.Random(3).shuffle(names)
    chains = [list(c) for c in (names[:250], names[250:399])]
    edges = [(a, b) for c in chains for a, b in zip(c, c[1:], strict=False)]
    labels = discovery.connected(spark.createDataFrame(edges, "a string, b string"), "a", "b")
    assert {r.id: r.component for r in labels.collect()} == {x: min(c) for c in chains for x in c}
    assert len(str(labels._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())) < 9
