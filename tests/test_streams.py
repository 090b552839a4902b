"""Typed state against the batch way, over files that land out of order, kills and restarts; detections against plain Python."""

from __future__ import annotations

import os
import random
import sys
from datetime import date, datetime, timedelta
from pathlib import Path

import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

sys.path.insert(0, str(Path(__file__).parent))
from compare import both, duck

from geoloom.operators import temporal
from geoloom.plans import catalog  # noqa: F401
from geoloom.plans.registry import QUERIES, SQL
from geoloom.streaming import entities, jobs, tracks

ROW = "cell_id string, seq long, ts timestamp, values array<double>, valid_fraction double"


def _track(spark, land, out, state):
    stream = spark.readStream.schema(ROW).option("maxFilesPerTrigger", 1).parquet(land)
    writer = tracks.trajectories(stream, 1, "12 days").writeStream.format("parquet").option("path", out).option("checkpointLocation", state)
    query = writer.trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.parquet(out), query


def test_trajectories_over_batches_and_a_restart(spark, tmp_path):
    """Rows dealt to files out of order within the watermark's delay, in two runs: what the watermark has passed equals the batch
    baseline, the null cell included."""
    rng, start = random.Random(5), datetime(2024, 1, 1)
    rows = []
    for c in ["a", "b", None]:
        for i in range(40):
            at = start + timedelta(days=i, hours=rng.randrange(20), microseconds=rng.randrange(10**6))
            value = None if i == 7 else [rng.random() + (6 if i > 30 and c == "a" else 0)]
            rows.append({"cell_id": c, "seq": len(rows), "ts": at, "values": value, "valid_fraction": None if i == 9 else 0.95})
    rows.append({"cell_id": "a", "seq": 999, "ts": None, "values": [1.0], "valid_fraction": 0.9})
    schema = pa.schema([("cell_id", pa.string()), ("seq", pa.int64()), ("ts", pa.timestamp("us", "UTC")), ("values", pa.list_(pa.float64())), ("valid_fraction", pa.float64())])
    # a file holds the rows of ten days, in any order; each tenth row comes one file late, still within the delay
    late = {r["seq"] for r in rows if r["ts"] and r["seq"] % 10 == 3}
    land = tmp_path / "land"
    land.mkdir()
    file_of = lambda r: (0 if r["ts"] is None else min((r["ts"] - start).days // 10 + (r["seq"] in late), 3))
    put = lambda k: pq.write_table(pa.Table.from_pylist(rng.sample(got := [r for r in rows if file_of(r) == k], len(got)), schema), str(land / f"{k}.parquet"))
    args = str(land), str(tmp_path / "out"), str(tmp_path / "state")
    old = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "2")
    try:
        put(0), put(1)
        _track(spark, *args)
        put(2), put(3)
        got, query = _track(spark, *args)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", old)
    passed = max(r["ts"] for r in rows if r["ts"]) - timedelta(days=12)
    clean = [{**r, "values": r["values"] or [0.0], "valid_fraction": (r["valid_fraction"] or 0.0) * (r["values"] is not None)} for r in rows if r["ts"]]
    pq.write_table(pa.Table.from_pylist(clean, schema), str(tmp_path / "clean.parquet"))
    table = spark.read.schema(ROW).parquet(str(tmp_path / "clean.parquet")).withColumn("obs_date", F.to_date("ts"))
    batch = temporal.baseline(temporal.indexed(table), 1)
    order = {c: sorted((r for r in clean if r["cell_id"] == c), key=lambda r: r["ts"]) for c in ["a", "b", None]}
    want = {order[r.cell_id][r.i]["seq"]: r for r in batch.collect() if order[r.cell_id][r.i]["ts"] < passed}
    found = {r.seq: r for r in got.collect()}
    assert len(found) == got.count() and found.keys() == want.keys()
    for seq, r in found.items():
        w = want[seq]
        assert (r.obs_state, r.interval_days) == (w.obs_state, w.interval_days)
        assert (r.z is None) == (w.z is None) and (r.z is None or r.z == pytest.approx(w.z, abs=1e-6)) and r.cusum == pytest.approx(w.cusum, abs=1e-4)
    assert jobs.status(query)["watermark"]


DETECTION = "entity_id string, entity_type string, x1 double, y1 double, x2 double, y2 double, seen date"


def _iou(a, b):
    side = lambda lo, hi: max(0.0, min(a[hi], b[hi]) - max(a[lo], b[lo]))
    area = lambda t: (t["x2"] - t["x1"]) * (t["y2"] - t["y1"])
    common = side("x1", "x2") * side("y1", "y2")
    return common / (area(a) + area(b) - common)


def _sequential(batches):
    known, seen = {}, []
    for n, rows in enumerate(batches):
        before, told = dict(known), []
        for r in rows:
            near = [(-round(_iou(r, e), 9), k) for k, e in before.items() if e["entity_type"] == r["entity_type"] and _iou(r, e) > 0.3]
            told.append((min(near)[1] if near else r["entity_id"], r, -min(near)[0] if near else None))
        for key, r, iou in told:
            e = known.setdefault(key, {**r, "last_seen": r["seen"], "n": 0})
            known[key] = {**e, "last_seen": max(e["last_seen"], r["seen"]), "n": e["n"] + (iou is not None)}
            seen.append((key, r["entity_id"], r["seen"], n))
    return {k: (e["x1"], e["y2"], e["last_seen"], e["n"]) for k, e in known.items()}, sorted(seen)


def test_detections_with_a_kill_between_tables(spark, tmp_path, monkeypatch):
    """Five batches; the third dies after its tracks and before its entities, and a new run goes on. Entities and tracks equal
    those of plain Python; a batch writes only what it changes; cleared versions change nothing."""
    rng = random.Random(9)
    batches = []
    for n in range(5):
        rows = []
        for i in range(12):
            x, y = rng.randrange(6) * 100 + rng.random() * 40, rng.randrange(4) * 100 + rng.random() * 40
            rows.append({"entity_id": f"d{n}_{i:02}", "entity_type": rng.choice(["road", "water"]), "x1": x, "y1": y, "x2": x + 90, "y2": y + 80, "seen": date(2024, 1, 1 + n)})
        batches.append(rows)
    schema = pa.schema([(c, pa.string()) for c in ("entity_id", "entity_type")] + [(c, pa.float64()) for c in ("x1", "y1", "x2", "y2")] + [("seen", pa.date32())])
    land, base, state = tmp_path / "land", str(tmp_path / "base"), str(tmp_path / "state")
    land.mkdir()
    hostile = [{**batches[0][0], "entity_id": None}, {**batches[0][1], "x1": None}, batches[0][2]]
    for n, rows in enumerate(batches):
        pq.write_table(pa.Table.from_pylist(rows + (hostile if n == 0 else []), schema), str(land / f"{n}.parquet"))
        os.utime(land / f"{n}.parquet", (1_700_000_000 + n, 1_700_000_000 + n))
    run = lambda: entities.ingest(spark.readStream.schema(DETECTION).option("maxFilesPerTrigger", 1).parquet(str(land)), base, state, size=200.0, compact_every=2)
    write = entities._write

    def dying(rows, path, version):
        if path.endswith("deltas") and version == 2:
            raise RuntimeError("lost")
        write(rows, path, version)

    monkeypatch.setattr(entities, "_write", dying)
    with pytest.raises(Exception, match="lost"):
        run()
    monkeypatch.setattr(entities, "_write", write)
    table = run()
    want, seen = _sequential(batches)
    read = lambda t: {r.entity_id: (r.x1, r.y2, r.last_seen, r.n_matched) for r in t.collect()}
    assert read(table) == want and table.count() == len(want) < 60
    assert sorted((r.entity_id, r.detection_id, r.seen, r.version) for r in entities.tracks(spark, base).collect()) == seen
    deltas = {r.version: r["count"] for r in spark.read.parquet(f"{base}/deltas").groupBy("version").count().collect()}
    assert deltas[4] <= 12 and sum(deltas.values()) > len(want)
    assert entities.clear(spark, base) == [0, 1] and read(entities.current(spark, base)) == want
    assert entities.current(spark, str(tmp_path / "none")).count() == 0


@pytest.mark.parametrize("name", ["st2_detection_stream", "st2_incremental_ingest", "st4_deduplicated"])
def test_streams_of_tables_that_are_folders(spark, sf, tmp_path, name):
    """Tables of several files in a folder of their own, as Spark writes them, give what a single file gives."""
    for t in ("embeddings", "events"):
        (tmp_path / f"{t}.parquet").mkdir()
        rows = pq.read_table(f"{sf}/{t}.parquet")
        for i in range(3):
            pq.write_table(rows.slice(i * (len(rows) // 3), len(rows) if i == 2 else len(rows) // 3), str(tmp_path / f"{t}.parquet" / f"part-{i}.parquet"))
    got, want = both(spark, QUERIES[name], SQL[name], str(tmp_path), duck(sf))
    assert got == want and got
