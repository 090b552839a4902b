"""Known shifts of grids: found by phase correlation, undone by resampling."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from geoloom.operators import registration as reg
from geoloom.plans import catalog  # noqa: F401
from geoloom.plans.registry import QUERIES


def texture(seed, n, dy=0.0, dx=0.0):
    """A smooth random picture, of sums of waves, seen (dy, dx) further down and right."""
    rng = np.random.default_rng(seed)
    y, x = np.mgrid[:n, :n].astype(float)
    out = np.zeros((n, n))
    for _ in range(220):
        fy, fx, phase = rng.uniform(-0.3, 0.3), rng.uniform(-0.3, 0.3), rng.uniform(0, 2 * np.pi)
        out += np.cos(2 * np.pi * (fy * (y - dy) + fx * (x - dx)) + phase)
    return 1000 + 50 * out


def grid_rows(spark, scenes):
    """scene -> (reference, moving) as rows of pixels."""
    rows = [(k, i, j, float(a[i, j]), float(b[i, j]), True) for k, (a, b) in scenes.items() for i in range(a.shape[0]) for j in range(a.shape[1])]
    return spark.createDataFrame(rows, "cell string, row_no int, col_no int, ref double, mov double, ok boolean").repartition(4)


SHIFTS = {"still": (0, 0), "fraction": (0.35, -0.6), "whole": (3, -2), "both": (-2.45, 1.3)}


def test_known_shifts_are_found(spark):
    """Within 0.05 px, over scenes of several tiles; flat scenes tell nothing."""
    scenes = {k: (texture(1, 128), texture(1, 128, *s)) for k, s in SHIFTS.items()} | {"flat": (np.ones((70, 70)), np.ones((70, 70)))}
    tiles = reg.tile_shifts(grid_rows(spark, scenes), "ref", "mov")
    got = {r.cell: r for r in reg.scene_shifts(tiles).collect()}
    for k, (dy, dx) in SHIFTS.items():
        r = got[k]
        assert (r.tiles, r.used) == (4, 4) and abs(r.dy + dy) <= 0.05 and abs(r.dx + dx) <= 0.05, (k, r)
        assert r.passes == (np.hypot(r.dy, r.dx) <= 0.5)
    assert got["flat"].used == 0 and got["flat"].dy is None and not got["flat"].passes and got["flat"].tiles == 4


def test_clouds_do_not_register(spark):
    """A bright cloud at another place in each scene, masked: the shift is that of the ground."""
    a, b = texture(3, 64), texture(3, 64, 0.4, 0.25)
    a[5:20, 5:25] = 9000
    b[40:58, 30:50] = 9000
    clear = (F.col("ref") < 5000) & (F.col("mov") < 5000)
    r = reg.scene_shifts(reg.tile_shifts(grid_rows(spark, {"s": (a, b)}), "ref", "mov", clear)).first()
    assert abs(r.dy + 0.4) <= 0.1 and abs(r.dx + 0.25) <= 0.1 and r.passes


def test_a_shift_is_undone(spark):
    a, b = texture(7, 64), texture(7, 64, 0.4, -0.25)
    rows = grid_rows(spark, {"s": (a, b)})
    moved = reg.shifted(rows.select("cell", "row_no", "col_no", "mov"), spark.createDataFrame([("s", -0.4, 0.25)], "cell string, dy double, dx double"), "mov")
    again = rows.drop("mov").join(moved, ["cell", "row_no", "col_no"])
    r = reg.scene_shifts(reg.tile_shifts(again, "ref", "mov")).first()
    assert r.residual_px <= 0.05 and again.count() == 64 * 64


def test_resampling_at_edges_and_holes(spark):
    rows = spark.createDataFrame([("a", 0, c, v) for c, v in ((0, 10.0), (1, 20.0), (2, None), (3, 40.0))], "cell string, row_no int, col_no int, v double")
    moves = spark.createDataFrame([("a", 0.0, 0.25)], "cell string, dy double, dx double")
    got = {r.col_no: r.v for r in reg.shifted(rows, moves, "v").collect()}
    assert got == pytest.approx({0: 10.0, 1: 17.5, 2: 20.0, 3: 40.0})
    assert reg.shifted(rows, moves.where("false"), "v").count() == 0


def test_query_finds_most_shifts(spark, sf):
    rows = QUERIES["r03_coregistration"](spark, sf).collect()
    assert len(rows) == len({r.cell for r in rows}) and all(r.tiles == 1 for r in rows)
