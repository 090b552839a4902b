"""Zones, transverse Mercator and grid references: the map's definition, published places, round trips, hostile text."""

from __future__ import annotations

import math
import random

import pytest
from pyspark.sql import functions as F

from geoloom.functions import projection as P

C = F.col


def _utm(spark, places):
    rows = spark.createDataFrame([(i, *p) for i, p in enumerate(places)], "i int, lon double, lat double")
    return {r.i: r for r in rows.select("i", P.to_utm(C("lon"), C("lat")).alias("u"), P.mgrs(C("lon"), C("lat")).alias("m")).collect()}


def _arc(lat):
    """Metres along the meridian from the equator, by Simpson's rule."""
    e2, n = P.FLAT * (2 - P.FLAT), 4000
    f = lambda p: P.A * (1 - e2) / (1 - e2 * math.sin(p) ** 2) ** 1.5
    h = math.radians(lat) / n
    return h / 3 * sum((1 if k in (0, n) else 4 if k % 2 else 2) * f(k * h) for k in range(n + 1))


def test_lengths_are_true_along_the_meridian(spark):
    lats = [0.0, 1.0, 28.6, 45.0, 60.0, 83.9, -33.3, -79.9]
    got = _utm(spark, [(75.0, lat) for lat in lats])
    for i, lat in enumerate(lats):
        assert got[i].u.easting == pytest.approx(500_000, abs=1e-6)
        assert got[i].u.northing - (1e7 if lat < 0 else 0) == pytest.approx(0.9996 * _arc(lat), abs=1e-4)


def test_angles_are_kept(spark):
    """Small steps east and north have equal scales and right angles everywhere in a zone: with true lengths along the meridian
    that is what defines the map."""
    e2, d = P.FLAT * (2 - P.FLAT), 1e-5
    places = [(75 + x, lat) for x in (-2.9, -1.0, 0.5, 2.9) for lat in (-75.0, -10.0, 5.0, 28.6, 50.0, 70.0)]
    got = _utm(spark, [q for x, y in places for q in ((x - d, y), (x + d, y), (x, y - d), (x, y + d))])
    for i, (_, lat) in enumerate(places):
        w, e, s, n = (got[4 * i + k].u for k in range(4))
        p = math.radians(lat)
        v = P.A / math.sqrt(1 - e2 * math.sin(p) ** 2)
        m = P.A * (1 - e2) / (1 - e2 * math.sin(p) ** 2) ** 1.5
        east = [(e.easting - w.easting) / (v * math.cos(p)), (e.northing - w.northing) / (v * math.cos(p))]
        north = [(n.easting - s.easting) / m, (n.northing - s.northing) / m]
        k = math.radians(2 * d)
        assert math.hypot(*east) / k == pytest.approx(math.hypot(*north) / k, abs=2e-6)
        assert (east[0] * north[0] + east[1] * north[1]) / k**2 == pytest.approx(0, abs=2e-6)


def test_published_places(spark):
    """A tower in Toronto; the reference 4QFJ12345678 is in Honolulu, so within ten kilometres of its centre."""
    got = _utm(spark, [(-(79 + 23 / 60 + 13.7 / 3600), 43 + 38 / 60 + 33.24 / 3600)])[0]
    assert (got.u.zone, got.u.south) == (17, False) and got.u.easting == pytest.approx(630_084, abs=1) and got.u.northing == pytest.approx(4_833_438, abs=1)
    assert got.m[:5] == "17TPJ" and abs(int(got.m[5:10]) - 30084) <= 1 and abs(int(got.m[10:]) - 33438) <= 1
    corner = spark.range(1).select(P.from_mgrs(F.lit("4QFJ 1234 5678")).alias("u")).select("u", P.from_utm(C("u.zone"), C("u.south"), C("u.easting"), C("u.northing")).alias("p")).first()
    assert corner.u.size == 10 and math.hypot(corner.p.lat - 21.307, (corner.p.lon + 157.858) * math.cos(math.radians(21.3))) * 111.2 < 10


def test_zones_and_bands(spark):
    places = {(5.0, 60.0): (32, "V"), (2.9, 60.0): (31, "V"), (5.0, 64.0): (31, "W"), (8.9, 75.0): (31, "X"), (9.0, 75.0): (33, "X"), (21.0, 80.0): (35, "X"), (41.9, 84.0): (37, "X"), (42.0, 75.0): (38, "X"), (180.0, 0.0): (1, "N"), (-180.0, -0.1): (1, "M"), (179.9, -80.0): (60, "C"), (0.0, 84.1): (None, None), (0.0, -80.1): (None, None), (437.2, 28.6): (43, "R")}
    rows = spark.createDataFrame([(*p, *want) for p, want in places.items()] + [(None, 3.0, None, "N"), (3.0, None, None, None)], "lon double, lat double, z int, b string")
    for r in rows.select("*", P.zone(C("lon"), C("lat")).alias("gz"), P.band(C("lat")).alias("gb"), P.to_utm(C("lon"), C("lat")).alias("u"), P.mgrs(C("lon"), C("lat")).alias("m")).collect():
        assert (r.gz, r.gb) == (r.z, r.b), r
        assert (r.u is None) == (r.m is None) == (r.z is None)


def test_round_trips_within_a_millimetre(spark):
    rng = random.Random(4)
    places = [(rng.uniform(-180, 180), math.degrees(math.asin(rng.uniform(-0.984, 0.994)))) for _ in range(4000)] + [(0.0, 0.0), (-180.0, 83.99), (179.999, -79.99)]
    rows = spark.createDataFrame(places, "lon double, lat double").select("*", P.to_utm(C("lon"), C("lat")).alias("u"), P.mgrs(C("lon"), C("lat")).alias("m"), P.mgrs(C("lon"), C("lat"), 0).alias("short"))
    rows = rows.withColumns({"back": P.from_utm(C("u.zone"), C("u.south"), C("u.easting"), C("u.northing")), "c": P.from_mgrs(C("m")), "s": P.from_mgrs(C("short"))})
    for r in rows.collect():
        dlon = (r.back.lon - r.lon + 180) % 360 - 180
        assert math.hypot(dlon * math.cos(math.radians(r.lat)), r.back.lat - r.lat) * 111_200 < 1e-3, r
        assert (r.c.zone, r.c.south, r.c.size) == (r.u.zone, r.u.south, 1.0), r
        assert r.c.easting == math.floor(r.u.easting) and r.c.northing == math.floor(r.u.northing), r
        assert r.s.size == 100_000 and 0 <= r.u.easting - r.s.easting < 1e5 and 0 <= r.u.northing - r.s.northing < 1e5


def test_text_that_is_no_reference(spark):
    wrong = ["", None, "17TPJ123", "61TPJ", "0TPJ", "17IPJ", "17TAJ", "17TPO", "TPJ12", "17TPJ123456789012"]
    rows = spark.createDataFrame([(w,) for w in wrong], "m string").select(P.from_mgrs(C("m")).alias("u"))
    assert all(r.u is None for r in rows.collect())
