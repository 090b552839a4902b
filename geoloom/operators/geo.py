"""Distances and spatial joins on lon/lat columns.

Distance joins are equi-joins on grid cells: one side's segments are written to all cells that they come near, within the
distance; points look up their own cell, boxes are compared first, and the exact distance decides. Work grows with the points and
with the features near each of them, never with points times features. Whether there is a feature at all ends at the first one, and
the nearest one is looked for close by first.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from geoloom.operators.lineage import table

METRES_PER_DEGREE = 111_195.08  # on the sphere of functions.scalars.EARTH_M
CELL = 0.01


def wrapped(dlon: Column) -> Column:
    """A difference of longitudes by the shorter way round."""
    return F.when(dlon > 180, dlon - 360).when(dlon < -180, dlon + 360).otherwise(dlon)


def shrink(lat: Column) -> Column:
    """How much shorter a degree of longitude is than on the equator."""
    return F.cos(F.radians(lat))


def segment_distance_m(lon: Column, lat: Column, x1: Column, y1: Column, x2: Column, y2: Column, by_lat: Column | None = None) -> Column:
    """Metres from a point to a segment, in the plane that touches the point. by_lat: shrink(lat), where it is a column already; the
    text of the expression has it dozens of times."""
    by_lat = shrink(lat) if by_lat is None else by_lat
    ax, ay = wrapped(x1 - lon) * by_lat * METRES_PER_DEGREE, (y1 - lat) * METRES_PER_DEGREE
    bx, by = wrapped(x2 - lon) * by_lat * METRES_PER_DEGREE, (y2 - lat) * METRES_PER_DEGREE
    dx, dy = bx - ax, by - ay
    long2 = dx * dx + dy * dy
    t = F.when(long2 > 0, F.greatest(F.lit(0.0), F.least(F.lit(1.0), -(ax * dx + ay * dy) / long2))).otherwise(0.0)
    return F.sqrt((ax + t * dx) ** 2 + (ay + t * dy) ** 2)


def cell(x: Column, size: float = CELL) -> Column:
    return F.floor(x / size)


def in_polygon(lon: Column, lat: Column, ring: list[tuple[float, float]]) -> Column:
    """Whether a point lies in a ring (closed by itself), by crossings of a ray; the box is a plain range, for pushdown."""
    xs, ys = zip(*ring, strict=True)
    box = lon.between(min(xs), max(xs)) & lat.between(min(ys), max(ys))
    crossings = F.lit(0)
    for (xa, ya), (xb, yb) in zip(ring, ring[1:] + ring[:1], strict=True):
        if ya != yb:
            crosses = ((lat < ya) != (lat < yb)) & (lon < (lat - ya) * ((xb - xa) / (yb - ya)) + xa)
            crossings = crossings + crosses.cast("int")
    return box & (crossings % 2 == 1)


def _near(points: DataFrame, segments: DataFrame, distance_m: float, size: float | None, keep: tuple[str, ...] = ()) -> tuple[DataFrame, DataFrame, Column]:
    """points (alias p) with their cell, segments (alias s) in each cell within distance_m of them, and when the box of a segment,
    wider by the distance, holds a point of its cell."""
    reach = distance_m / METRES_PER_DEGREE
    around = max(1, round(360 / (size or max(CELL, reach / 4))))
    size, hair = 360 / around, 1e-9  # hair: degrees, far over any rounding
    # a degree of longitude is shorter by the cosine of the latitude that is farthest from the equator within reach; a segment
    # over the antimeridian starts at its eastern longitude and ends past 180 degrees, and cells count round the globe
    far = F.least(F.greatest(F.abs("y1"), F.abs("y2")) + reach, F.lit(89.9))
    wide = F.least(F.lit(reach) / F.cos(F.radians(far)), F.lit(180.0)) + hair
    across = F.abs(F.col("x1") - F.col("x2")) > 180
    turned = (F.col("x1") > F.col("x2")) != across  # whether the segment begins in the east
    ends = segments.select("ref_id", *keep, "x1", "y1", "x2", "y2", wide.alias("_wide"),
        F.when(across, F.greatest("x1", "x2")).otherwise(F.least("x1", "x2")).alias("_west"), F.when(across, F.least("x1", "x2") + 360).otherwise(F.greatest("x1", "x2")).alias("_east"),
        F.when(turned, F.col("y2")).otherwise(F.col("y1")).alias("_yw"), F.when(turned, F.col("y1")).otherwise(F.col("y2")).alias("_ye"),
    )
    c = F.col
    first, last = cell(c("_west") - c("_wide"), size), cell(c("_east") + c("_wide"), size)
    whole = last - first + 1 >= around  # all round the globe: each column once
    at = ends.withColumn("_whole", whole).withColumn("_c", F.explode(F.when(whole, F.sequence(F.lit(0).cast("long"), F.lit(around - 1).cast("long"))).otherwise(F.sequence(first, last))))
    # what of the segment a point in this column may be near to
    part = lambda x: F.least(F.greatest(x, c("_west")), c("_east"))
    y_at = lambda x: c("_yw") + (part(x) - c("_west")) / (c("_east") - c("_west")) * (c("_ye") - c("_yw"))
    sloped = ~c("_whole") & (c("_east") > c("_west"))
    ya = F.when(sloped, y_at(c("_c") * size - c("_wide"))).otherwise(c("_yw"))
    yb = F.when(sloped, y_at((c("_c") + 1) * size + c("_wide"))).otherwise(c("_ye"))
    at = at.withColumns({"_ya": ya, "_yb": yb})
    rows = F.sequence(cell(F.least("_ya", "_yb") - reach - hair, size), cell(F.greatest("_ya", "_yb") + reach + hair, size))
    at = at.select("ref_id", *keep, "x1", "y1", "x2", "y2", ((c("_west") + c("_east")) / 2).alias("_x"), ((c("_east") - c("_west")) / 2 + c("_wide")).alias("_w"), F.pmod("_c", F.lit(around)).alias("_cx"), F.explode(rows).alias("_cy")).alias("s")
    here = points.withColumns({"_cx": F.pmod(cell(c("lon"), size), F.lit(around)), "_cy": cell(c("lat"), size), "_by_lat": shrink(c("lat"))}).alias("p")
    aside = F.abs(c("p.lon") - c("s._x"))
    boxed = (c("p.lat") >= F.least("s.y1", "s.y2") - (reach + hair)) & (c("p.lat") <= F.greatest("s.y1", "s.y2") + (reach + hair)) & ((aside <= c("s._w")) | (aside >= 360 - c("s._w")))
    return here, at, (c("p._cx") == c("s._cx")) & (c("p._cy") == c("s._cy")) & boxed


def _distances(lon, lat, x1, y1, x2, y2, by_lat) -> np.ndarray:
    """segment_distance_m of columns."""
    wrap = lambda d: np.where(d > 180, d - 360, np.where(d < -180, d + 360, d))
    ax, ay = wrap(x1 - lon) * by_lat * METRES_PER_DEGREE, (y1 - lat) * METRES_PER_DEGREE
    bx, by = wrap(x2 - lon) * by_lat * METRES_PER_DEGREE, (y2 - lat) * METRES_PER_DEGREE
    dx, dy = bx - ax, by - ay
    long2 = dx * dx + dy * dy
    t = np.clip(-(ax * dx + ay * dy) / np.where(long2 > 0, long2, 1.0), 0.0, 1.0)
    t = np.where(long2 > 0, t, 0.0)
    return np.sqrt((ax + t * dx) ** 2 + (ay + t * dy) ** 2)


def near_pairs(points: DataFrame, segments: DataFrame, distance_m: float, size: float | None = None, keep: tuple[str, ...] = ()) -> DataFrame:
    """points (.., lon, lat) with each segment (ref_id, x1, y1, x2, y2) within distance_m: adds ref_id, distance_m, and the
    segments' columns in keep. size: of a cell, in degrees. Distances are taken in Arrow: as a condition of the join they are a
    method too long for the JVM to compile."""
    here, at, boxed = _near(points, segments, distance_m, size, keep)
    names = [*(f"p.{x}" for x in points.columns), "s.ref_id", *(f"s.{x}" for x in keep)]
    places = [F.col(x).cast("double").alias(f"_{i}") for i, x in enumerate(("p.lon", "p.lat", "s.x1", "s.y1", "s.x2", "s.y2", "p._by_lat"))]
    pairs = here.join(at, boxed).select(*names, *places)
    n = len(names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            d = _distances(*(c.to_numpy(zero_copy_only=False) for c in batch.columns[n:]))
            at = pa.array(np.flatnonzero(d <= distance_m))
            yield pa.RecordBatch.from_arrays([*(c.take(at) for c in batch.columns[:n]), pa.array(d).take(at)], names=[*batch.schema.names[:n], "distance_m"])

    return pairs.mapInArrow(run, StructType([*pairs.schema.fields[:n], StructField("distance_m", DoubleType())]))


def within_distance(points: DataFrame, segments: DataFrame, distance_m: float, key: str = "entity_id") -> DataFrame:
    """The points that have a segment within the distance, each once; a point stops at the first one."""
    here, at, boxed = _near(points.select(key, "lon", "lat"), segments, distance_m, None)
    d = segment_distance_m(*(F.col(x) for x in ("p.lon", "p.lat", "s.x1", "s.y1", "s.x2", "s.y2", "p._by_lat")))
    return points.join(here.join(at, boxed & (d <= distance_m), "left_semi").select(key), key, "left_semi")


def nearest(points: DataFrame, segments: DataFrame, distance_m: float, key: str = "entity_id") -> DataFrame:
    """key, ref_id, distance_m of the nearest segment in metres; points with none within the distance are absent. What is found
    within a part of the distance is nearest, so only points without go on to the next part."""
    left, found = points.select(key, "lon", "lat"), None
    for reach in (distance_m / 16, distance_m / 4, distance_m):
        pairs = near_pairs(left, segments, reach, max(CELL / 4, reach / 4 / METRES_PER_DEGREE))
        near = pairs.groupBy(key).agg(F.min(F.struct("distance_m", "ref_id")).alias("n")).select(key, "n.ref_id", "n.distance_m")
        near = near if reach == distance_m else table(near, "nearest")
        found = near if found is None else found.unionByName(near)
        left = left.alias("p").join(near.select(key).alias("n"), F.col(f"p.{key}").eqNullSafe(F.col(f"n.{key}")), "left_anti")
    return found


def boxes(points: DataFrame) -> DataFrame:
    """points with a box of area_m2 around them: x1, y1, x2, y2 in metres from a fixed corner."""
    half = F.sqrt("area_m2") / 2
    x, y = (F.col("lon") - 77.0) * 98_000, (F.col("lat") - 28.0) * 111_000
    return points.select("*", (x - half).alias("x1"), (y - half).alias("y1"), (x + half).alias("x2"), (y + half).alias("y2"))


def overlap(a: str, b: str) -> tuple[Column, Column]:
    """(intersection area, intersection over union) of the boxes of two aliases."""
    c = lambda t, n: F.col(f"{t}.{n}")
    side = lambda lo, hi: F.greatest(F.lit(0.0), F.least(c(a, hi), c(b, hi)) - F.greatest(c(a, lo), c(b, lo)))
    area = lambda t: (c(t, "x2") - c(t, "x1")) * (c(t, "y2") - c(t, "y1"))
    common = side("x1", "x2") * side("y1", "y2")
    return common, common / (area(a) + area(b) - common)


def overlapping_pairs(boxed: DataFrame, least_iou: float, kind: str = "entity_type", key: str = "entity_id", size: float = 1000.0) -> DataFrame:
    """(left_id, right_id, iou) of boxes of one kind over least_iou, by an equi-join on the cells that boxes touch; a pair is
    taken in the cell of its common lower corner only, so none comes twice."""
    span = lambda lo, hi: F.explode(F.sequence(F.floor(F.col(lo) / size), F.floor(F.col(hi) / size)))
    at = boxed.select(key, kind, "x1", "y1", "x2", "y2", span("x1", "x2").alias("cx")).withColumn("cy", span("y1", "y2"))
    a, b = at.alias("a"), at.alias("b")
    on = (F.col("a.cx") == F.col("b.cx")) & (F.col("a.cy") == F.col("b.cy")) & (F.col(f"a.{kind}") == F.col(f"b.{kind}")) & (F.col(f"a.{key}") < F.col(f"b.{key}"))
    first = (F.floor(F.greatest("a.x1", "b.x1") / size) == F.col("a.cx")) & (F.floor(F.greatest("a.y1", "b.y1") / size) == F.col("a.cy"))
    return a.join(b, on).where(first).select(F.col(f"a.{key}").alias("left_id"), F.col(f"b.{key}").alias("right_id"), overlap("a", "b")[1].alias("iou")).where(F.col("iou") > least_iou)


def best_matches(found: DataFrame, known: DataFrame, least_iou: float, kind: str = "entity_type", key: str = "entity_id", size: float = 1000.0) -> DataFrame:
    """(key, match, iou): for each found box the known box of its kind that it overlaps most, over least_iou; the least key
    of equal ones. Keys of found and known must differ."""
    columns = [key, kind, "x1", "y1", "x2", "y2"]
    ids = F.concat(F.when(F.col("_new"), "n").otherwise("k"), F.col(key))  # n sorts after k: a known box is on the left
    both = found.select(*columns, F.lit(True).alias("_new")).unionByName(known.select(*columns, F.lit(False).alias("_new"))).withColumn(key, ids)
    pairs = overlapping_pairs(both, least_iou, kind, key, size).where(F.startswith("left_id", F.lit("k")) & F.startswith("right_id", F.lit("n")))
    best = pairs.groupBy("right_id").agg(F.min(F.struct((-F.round("iou", 9)).alias("iou"), F.col("left_id"))).alias("m"))
    return best.select(F.substr("right_id", F.lit(2)).alias(key), F.substr("m.left_id", F.lit(2)).alias("match"), (-F.col("m.iou")).alias("iou"))


# --- rings: arrays of struct(x, y), the first corner repeated at the end --------------------------------------------------


def _edges(ring: str, step) -> Column:
    n = F.size(ring) - 1
    return F.zip_with(F.slice(ring, 1, n), F.slice(ring, 2, n), step)


def ring_area(ring: str) -> Column:
    """Signed area by the shoelace rule, about the first corner so that small rings far from the origin keep their digits."""
    o = F.get(ring, F.lit(0))
    terms = _edges(ring, lambda p, q: (p.x - o.x) * (q.y - o.y) - (q.x - o.x) * (p.y - o.y))
    return F.aggregate(terms, F.lit(0.0), lambda s, t: s + t) / 2


def ring_centroid(ring: str) -> tuple[Column, Column]:
    o, six = F.get(ring, F.lit(0)), 6 * ring_area(ring)

    def axis(name: str) -> Column:
        terms = _edges(ring, lambda p, q: ((p[name] - o[name]) + (q[name] - o[name])) * ((p.x - o.x) * (q.y - o.y) - (q.x - o.x) * (p.y - o.y)))
        return o[name] + F.aggregate(terms, F.lit(0.0), lambda s, t: s + t) / six

    return axis("x"), axis("y")


def ring_orientation(ring: str) -> Column:
    """The direction of the longest edge, in degrees from 0 to 180; the first of equal ones."""
    edges = _edges(ring, lambda p, q: F.struct(F.round(F.hypot(q.x - p.x, q.y - p.y), 9).alias("d"), F.round(F.pmod(F.degrees(F.atan2(q.y - p.y, q.x - p.x)), F.lit(180.0)), 6).alias("a")))
    longest = F.array_max(F.transform(edges, lambda e: F.struct(e.d.alias("d"), (-e.a).alias("a"))))
    return F.abs(longest.a)


def ring_closed(ring: str) -> Column:
    return (F.size(ring) >= 4) & (F.get(ring, F.lit(0)) == F.element_at(ring, -1))
