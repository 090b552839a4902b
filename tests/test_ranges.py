"""Ranks and matches by ranges against plain Python; the catalogue's files."""

from __future__ import annotations

import json
import math
import random
from bisect import bisect_left
from itertools import accumulate

import numpy as np
import pytest

from geoloom.operators import aggregates, raster
from geoloom.operators.lineage import scratch
from geoloom.plans import catalog  # noqa: F401
from geoloom.plans.registry import QUERIES, SQL
from geoloom.sources import documents


def test_percentiles_without_a_group_in_one_task(spark):
    """A million distinct values in one group: no task orders more than a few ranges of them."""
    df = spark.range(400_000).selectExpr("id % 2 AS g", "cast(pmod(id * 7919, 400009) AS double) AS x")
    run = aggregates.counts_upto(df, "x", "g", ranges=32)
    assert run.count() == 400_000
    got = {r.g: r for r in aggregates.percentiles(df, "x", {"low": 0.02, "mid": 0.5, "high": 0.98}, "g").collect()}
    for g in (0, 1):
        x = [i * 7919 % 400009 for i in range(g, 400_000, 2)]
        assert [got[g].low, got[g].mid, got[g].high] == pytest.approx(np.percentile(x, [2, 50, 98]).tolist())
    plan = run._jdf.queryExecution().executedPlan().toString()
    assert "SinglePartition" not in plan


def test_ranks_of_odd_groups(spark):
    rows = [(None, 1.0), (None, None), (None, 3.0), ("a", 5.0), ("a", 5.0), ("a", None), ("b", None)]
    df = spark.createDataFrame(rows, "g string, x double")
    assert set(map(tuple, aggregates.upper_median(df, "x", "g").collect())) == {(None, 3.0), ("a", 5.0)}
    assert aggregates.percentiles(df.where("false"), "x", {"p": 0.5}, "g").count() == 0


def test_histogram_match(spark):
    rng = random.Random(1)
    a, b = [float(rng.randint(0, 40)) for _ in range(500)], [rng.random() * 9 for _ in range(333)]
    got = raster.histogram_match(spark.createDataFrame([(x,) for x in a], "v double"), "v", spark.createDataFrame([(x,) for x in b], "t double"), "t").collect()
    ordered, values = sorted(b), sorted(set(a))
    before = dict(zip(values, [0, *accumulate(a.count(v) for v in values)], strict=False))
    upto = list(range(1, len(ordered) + 1))
    want = sorted((v, ordered[bisect_left(upto, max(1, math.ceil((before[v] + 1) * len(b) / float(len(a)))))]) for v in a)
    assert sorted((r.v, r.matched) for r in got) == want


def test_catalogue_reads_every_file_and_line(spark):
    path = scratch(spark, "items")
    fs = spark._jvm.org.apache.hadoop.fs.FileSystem.get(spark._jvm.java.net.URI(path), spark._jsc.hadoopConfiguration())
    fs.mkdirs(spark._jvm.org.apache.hadoop.fs.Path(path))
    assert documents.catalogue(spark, path).count() == 0
    names = ["a b", "c\u0085d", "plain"]
    for file in ("items.json", "more/part-0.json", "_hidden.json"):
        out = fs.create(spark._jvm.org.apache.hadoop.fs.Path(f"{path}/{file}"))
        out.write(bytearray("\n".join(json.dumps({"scene_id": n, "collection": "F", "cloud_cover": 3.0}, ensure_ascii=False) for n in names).encode()))
        out.close()
    found = documents.catalogue(spark, path)
    assert sorted(r.scene_id for r in found.where("cloud_cover < 5").collect()) == sorted(names * 2)
    assert "PushedFilters: [IsNotNull(cloud_cover), LessThan(cloud_cover,5.0)]" in found.where("cloud_cover < 5")._jdf.queryExecution().executedPlan().toString()


def test_plan_fields_have_rows(spark, sf):
    assert QUERIES["qe_plan_fields"](spark, sf).count() > 0 and "qe_plan_fields" in SQL
