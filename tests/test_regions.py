"""Regions over tiles against one flood fill; outlines against pixels."""

from __future__ import annotations

import random
from collections import defaultdict

import numpy as np
import pytest
from test_overlay import covers

from geoloom.operators import overlay, regions
from geoloom.plans import catalog  # noqa: F401
from geoloom.plans.registry import QUERIES


def flooded(pixels, diagonal):
    """{(key, r, c)} -> sets of connected pixels."""
    steps = [(a, b) for a in (-1, 0, 1) for b in (-1, 0, 1) if (a or b) and (diagonal or not (a and b))]
    left, out = set(pixels), set()
    while left:
        todo = [left.pop()]
        seen = set(todo)
        while todo:
            k, r, c = todo.pop()
            new = {(k, r + a, c + b) for a, b in steps} & left
            left -= new
            seen |= new
            todo += new
        out.add(frozenset(seen))
    return out


def drawn(seed, n=60):
    """Noise, a spiral over the whole grid, rings with holes."""
    rng = random.Random(seed)
    noise = {("noise", r, c) for r in range(n) for c in range(n) if rng.random() < 0.55}
    snake = {("snake", r, c) for r in range(n) for c in range(n) if r % 4 == 0 or (c == (n - 1 if r // 4 % 2 == 0 else 0))}
    ring = {("ring", r, c) for r in range(-20, 20) for c in range(-20, 20) if 8 <= max(abs(r), abs(c)) < 14 or abs(r) + abs(c) < 4}
    return sorted(noise | snake | ring)


@pytest.mark.parametrize("diagonal", [False, True])
def test_regions_are_those_of_a_flood(spark, diagonal):
    pixels = drawn(5)
    df = spark.createDataFrame([(*p, 1) for p in pixels + pixels[:9]], "cell string, row_no int, col_no int, x int").repartition(5)
    found = defaultdict(set)
    rows = regions.regions(df, size=16, diagonal=diagonal).collect()
    for r in rows:
        found[r.region].add((r.cell, r.row_no, r.col_no))
    assert len(rows) == len(pixels) and {frozenset(x) for x in found.values()} == flooded(pixels, diagonal)
    assert sum(len(x) > 900 for x in found.values()) >= 1  # the snake, over all tiles


def test_outlines_hold_their_pixels(spark):
    pixels = [p for p in drawn(2, 24) if p[0] != "snake"]
    labelled = regions.regions(spark.createDataFrame(pixels, "cell string, row_no int, col_no int"), size=16)
    own = defaultdict(set)
    for r in labelled.collect():
        own[r.cell, r.region].add((r.row_no, r.col_no))
    x, y = np.meshgrid(np.arange(-25, 30) + 0.5, np.arange(-25, 30) + 0.5)
    shapes = {(r.cell, r.region): [np.array([(p.x, p.y) for p in ring[:-1]]) for ring in r.rings] for r in regions.outlines(labelled).collect()}
    assert set(shapes) == set(own)
    for k, rings in shapes.items():
        inside = covers(rings, x, y)
        assert {(int(b - 0.5), int(a - 0.5)) for a, b in zip(x[inside], y[inside], strict=True)} == own[k]
        assert overlay.areas(overlay.trapezoids(rings, [], overlay.KINDS["left_only"])).sum() == pytest.approx(len(own[k]))
    sizes = {(r.cell, r.region): r.pixels for r in regions.measures(labelled).collect()}
    assert sizes == {k: len(v) for k, v in own.items()}


def test_no_pixels(spark):
    none = spark.createDataFrame([], "cell string, row_no int, col_no int")
    assert regions.regions(none).count() == 0 and regions.outlines(regions.regions(none)).count() == 0


def test_regions_of_the_archive(spark, sf):
    rows = QUERIES["f12_mask_regions"](spark, sf).collect()
    assert sum(r.pixels for r in rows) > 100 and len({(r.cell, r.region) for r in rows}) == len(rows)


def test_tiles_are_labelled_together(spark):
    """Many tiles at once as one by one, and over batches that end within a tile; repeated and null pixels, a null key."""
    rng = random.Random(6)
    many = sorted({(rng.randrange(30), rng.randrange(9), rng.randrange(9)) for _ in range(1500)})
    t, r, c = (np.array(x) for x in zip(*many, strict=True))
    for diagonal in (False, True):
        got = regions.tile_labels(r, c, diagonal, t)
        for k in range(30):
            own = regions.tile_labels(r[t == k], c[t == k], diagonal)
            pairs = set(zip(got[t == k].tolist(), own.tolist(), strict=True))
            assert len(pairs) == len(set(got[t == k].tolist())) == len(set(own.tolist()))
        assert all(len(set(t[got == x].tolist())) == 1 for x in set(got.tolist()))
    rows = [(None if k == 3 else k, y - 4, x) for k, y, x in many] * 2 + [(1, None, 2)]
    mask = spark.createDataFrame(rows, "cell int, row_no int, col_no int")
    found = lambda: sorted(map(tuple, regions.regions(mask, size=4).collect()), key=str)
    want = found()
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    try:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "5")
        assert found() == want and len(want) == len(many)
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
