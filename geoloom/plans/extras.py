"""Polygons, grids, provenance, plan fields, documents and the engine's routes (G, R, K, S20, P07, F11, F20, C09, D07, API)."""

from __future__ import annotations

from pyspark.sql import functions as F

from geoloom.engine import Engine
from geoloom.functions import projection, scalars
from geoloom.operators import geo, overlay, raster, regions, registration, vectors
from geoloom.operators.lineage import scratch
from geoloom.plans.archive import COS
from geoloom.plans.dsl import Plan, stage_one
from geoloom.plans.registry import query
from geoloom.plans.sets import DIST
from geoloom.sources import documents, sinks


@query("g03_g07_polygons", """SELECT entity_id, round(w * h * 1e6, 6) AS area, round(lon + w / 2, 9) AS cx, round(lat + h / 2, 9) AS cy, CASE WHEN w >= h THEN 0.0 ELSE 90.0 END AS orientation, true AS closed
FROM (SELECT entity_id, lon, lat, 0.001e0 + (vec_id % 7) / 10000e0 AS w, 0.001e0 + (vec_id % 5) / 10000e0 AS h FROM entities)""")
def _(a):
    w, h = F.lit(0.001) + (F.col("vec_id") % 7) / 10000, F.lit(0.001) + (F.col("vec_id") % 5) / 10000
    x, y = F.col("lon"), F.col("lat")
    corner = lambda px, py: F.struct(px.alias("x"), py.alias("y"))
    ring = F.array(corner(x, y), corner(x + w, y), corner(x + w, y + h), corner(x, y + h), corner(x, y))
    e = a.entities.select("entity_id", ring.alias("ring"))
    return e.select("entity_id", F.round(F.abs(geo.ring_area("ring")) * 1e6, 6).alias("area"), *(F.round(c, 9).alias(n) for n, c in zip(("cx", "cy"), geo.ring_centroid("ring"), strict=True)), geo.ring_orientation("ring").alias("orientation"), geo.ring_closed("ring").alias("closed"))


@query("r08_grid_conformance", """WITH o AS (SELECT cell, min(row_no) AS top, min(col_no) AS left_, max(row_no) AS bottom, max(col_no) AS right_, count(*) AS n FROM pixels WHERE l_linenumber <= 3 GROUP BY cell),
s AS (SELECT cell, min(row_no) AS top, min(col_no) AS left_, max(row_no) AS bottom, max(col_no) AS right_, count(*) AS n FROM pixels WHERE l_linenumber > 3 GROUP BY cell)
SELECT coalesce(o.cell, s.cell) AS cell, coalesce(o.n, 0) AS optical_pixels, coalesce(s.n, 0) AS sar_pixels, o.top = s.top AND o.left_ = s.left_ IS TRUE AS same_origin, coalesce(o.top = s.top AND o.left_ = s.left_ AND o.bottom = s.bottom AND o.right_ = s.right_, false) AS conforms FROM o FULL JOIN s ON o.cell = s.cell""".replace("o.top = s.top AND o.left_ = s.left_ IS TRUE", "coalesce(o.top = s.top AND o.left_ = s.left_, false)"))
def _(a):
    """The grid that the optical pixels of a cell span, against that of its radar pixels."""
    optical, sar = raster.grids(a.pixels.where("l_linenumber <= 3"), "cell"), raster.grids(a.pixels.where("l_linenumber > 3"), "cell")
    return raster.conformance(optical, sar, "cell", "optical", "sar")


@query("k09_k14_provenance", "SELECT scene_id, length(scene_id || ' ' || cloud_cover::VARCHAR || chr(10)) AS size, sha256(scene_id || ' ' || cloud_cover::VARCHAR || chr(10)) AS checksum FROM scenes")
def _(a):
    """Each scene's metadata is written as a row, and size and checksum are taken of what is read back."""
    path = scratch(a.spark, "scene-files")
    a.scenes.select("scene_id", F.concat(F.concat_ws(" ", "scene_id", F.col("cloud_cover").cast("string")), F.lit("\n")).alias("content")).write.parquet(path)
    back = a.spark.read.parquet(path)
    return back.select("scene_id", F.octet_length("content").cast("long").alias("size"), F.sha2("content", 256).alias("checksum"))


@query("api_similar", f"SELECT v.entity_id, round({COS}, 6) AS cosine FROM vectors v, vectors q WHERE q.entity_id = 'ENT_000021' AND v.entity_id <> 'ENT_000021' ORDER BY {COS} DESC, v.entity_id LIMIT 10")
def _(a):
    return Engine(a.spark, a.sf_dir).similar("ENT_000021").select("entity_id", F.round("cosine", 6).alias("cosine"))


@query("api_timeline", "SELECT i::INT AS i, obs_date, z, valid_fraction FROM (SELECT *, row_number() OVER (ORDER BY ts, seq) - 1 AS i FROM trajectory WHERE cell_id = 'CELL_3')")
def _(a):
    return Engine(a.spark, a.sf_dir).timeline("CELL_3").select("i", "obs_date", "z", "valid_fraction")


@query("api_export", """SELECT rank, '{"type":"Feature","properties":{"entity_id":"' || entity_id || '","entity_type":"' || entity_type || '"},"geometry":{"type":"Point","coordinates":[' || printf('%.4f', lon) || ',' || printf('%.4f', lat) || ']}}' AS feature
FROM (SELECT *, row_number() OVER (ORDER BY area_m2 DESC, entity_id) AS rank FROM entities) WHERE rank <= 15""")
def _(a):
    from pyspark.sql import Window

    top = a.entities.select("entity_id", "area_m2").orderBy(F.desc("area_m2"), "entity_id").limit(15)
    ranked = top.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("area_m2"), "entity_id")))  # of 15 rows
    return Engine(a.spark, a.sf_dir).export(ranked)


@query("qe_plan_fields", f"""WITH d AS (SELECT * FROM {DIST} WHERE d <= 9000) SELECT entity_id FROM entities WHERE entity_type = 'building' AND NOT is_linear AND radiometric_ok AND last_seen BETWEEN date '2025-10-15' AND date '2025-12-31' AND optical_z IS NOT NULL
AND entity_id IN (SELECT entity_id FROM d WHERE layer = 'ref_water' AND d <= 9000) AND entity_id IN (SELECT entity_id FROM d WHERE layer = 'ref_roads' AND d <= 8000)""")
def _(a):
    """Attributes, the time field, one sensor and two relations of a plan."""
    plan = Plan(
        entity_type="building", attributes=(("is_linear", False), ("radiometric_ok", True)), time_field="last_seen", from_date="2025-10-15", to_date="2025-12-31",
        sensors=("sentinel-2",), relation="near_water", distance_m=9000.0, relations=(("near_road", 8000.0),),
    )
    return stage_one(a.entities, plan, a.segments).select("entity_id")


@query("p07_scene_rows", "SELECT scene_id, band_letter AS collection, scene_date, cloud_cover, len(string_split(assets, ',')) AS n_assets, CASE WHEN list_contains(string_split(assets, ','), 'swir') THEN scene_id || '/swir.tif' END AS swir FROM scenes")
def _(a):
    path = scratch(a.spark, "items")
    names = F.split("assets", ",")
    assets = F.map_from_arrays(names, F.transform(names, lambda n: F.struct(F.concat("scene_id", F.lit("/"), n, F.lit(".tif")).alias("href"))))
    properties = F.struct(F.date_format("scene_date", "yyyy-MM-dd'T'HH:mm:ss").alias("datetime"), F.col("cloud_cover").alias("eo:cloud_cover"))
    a.scenes.select(F.col("scene_id").alias("id"), F.col("band_letter").alias("collection"), properties.alias("properties"), assets.alias("assets")).write.json(path)
    return documents.scene_rows(a.spark, path).select("scene_id", "collection", "scene_date", "cloud_cover", F.size("assets").alias("n_assets"), F.try_element_at("assets", F.lit("swir")).alias("swir"))


@query("s20_judgements", "SELECT 'Q' || q.vec_id AS query_id, e.entity_id, 3 - abs(q.label % 3 - e.label % 3)::INT AS rel FROM vectors q JOIN vectors e ON q.label % 5 = e.label % 5 WHERE q.vec_id % 100 = 0")
def _(a):
    """Relevance of each entity to a stated set of queries, through documents of a thousand ids at most."""
    path = scratch(a.spark, "relevance")
    q = a.vectors.where("vec_id % 100 = 0").select(F.concat(F.lit("Q"), "vec_id").alias("query_id"), F.col("label").alias("q_label"))
    pairs = a.vectors.join(q, F.col("label") % 5 == F.col("q_label") % 5)
    rel = (3 - F.abs(F.col("q_label") % 3 - F.col("label") % 3)).cast("int")
    part = F.floor(F.col("vec_id") / 1000).alias("part")
    maps = pairs.groupBy("query_id", part).agg(F.map_from_entries(F.collect_list(F.struct("entity_id", rel.alias("rel")))).alias("relevance"))
    maps.drop("part").write.json(path)
    return documents.judgements(a.spark, path)


@query("k13_query_cache", """WITH l AS (SELECT max(ts) AS last FROM trajectory), o AS (SELECT cell_id, max(ts) AS last_access, count(*) AS n FROM trajectory WHERE sensor = 'sentinel-2' GROUP BY cell_id), w AS (SELECT cell_id, max(ts) AS last_access, count(*) AS n FROM trajectory WHERE sensor = 'sentinel-1' GROUP BY cell_id)
SELECT cell_id, last_access, n FROM (SELECT * FROM w UNION ALL SELECT * FROM o WHERE cell_id NOT IN (SELECT cell_id FROM w)), l WHERE last_access >= last - interval 24 hours""")
def _(a):
    """Results of cells are registered over older ones; those that were not asked for within a day of the newest go."""
    of = lambda sensor: a.trajectory.where(F.col("sensor") == sensor).groupBy("cell_id").agg(F.max("ts").alias("last_access"), F.count("*").alias("n"))
    timed = lambda df: vectors.with_row(df, a.trajectory.agg(F.max("ts").alias("last")))
    kept = sinks.registered(timed(of("sentinel-2")), timed(of("sentinel-1")), "cell_id", "24 hours", F.col("last"))
    return kept.select("cell_id", "last_access", "n")


@query("f11_f20_regions", "SELECT entity_id, round((1 - cloud_context) * valid_fraction, 6) AS clear FROM entities WHERE (1 - cloud_context) * valid_fraction >= 0.6 AND entity_type <> 'unknown' AND NOT is_linear AND lon IS NOT NULL AND lat IS NOT NULL")
def _(a):
    """Regions that are clear enough, of a known type and with a polygon; a linear entity has none."""
    clear = (1 - F.col("cloud_context")) * F.col("valid_fraction")
    corner = lambda x, y: F.struct(x.alias("x"), y.alias("y"))
    x, y = F.col("lon"), F.col("lat")
    ring = F.when(~F.col("is_linear"), F.array(corner(x, y), corner(x + 0.001, y), corner(x, y + 0.001), corner(x, y)))
    e = a.entities.withColumns({"clear": clear, "ring": ring})
    return e.where("clear >= 0.6 AND entity_type <> 'unknown' AND lon IS NOT NULL AND lat IS NOT NULL AND size(ring) > 0").select("entity_id", F.round("clear", 6).alias("clear"))


XY = "printf('%.6f %.6f', {}, {})"


@query("c09_wkt_polygons", f"SELECT ref_id, 'POLYGON((' || {XY.format('x1', 'y1')} || ', ' || {XY.format('x2', 'y1')} || ', ' || {XY.format('x2', 'y2')} || ', ' || {XY.format('x1', 'y2')} || ', ' || {XY.format('x1', 'y1')} || '))' AS wkt FROM segments")
def _(a):
    corner = lambda x, y: F.struct(F.col(x).alias("x"), F.col(y).alias("y"))
    ring = F.array(corner("x1", "y1"), corner("x2", "y1"), corner("x2", "y2"), corner("x1", "y2"), corner("x1", "y1"))
    return a.segments.withColumn("ring", ring).select("ref_id", scalars.wkt_polygon("ring").alias("wkt"))


@query("d07_elapsed", "SELECT seq, cell_id, (floor(epoch(last)) - floor(epoch(ts)))::BIGINT AS elapsed_s FROM trajectory, (SELECT max(ts) AS last FROM trajectory)")
def _(a):
    """Seconds from each observation to the newest one, which stands for now."""
    timed = vectors.with_row(a.trajectory, a.trajectory.agg(F.max("ts").alias("last")))
    return timed.select("seq", "cell_id", scalars.elapsed_seconds(F.col("ts"), F.col("last")).alias("elapsed_s"))


@query("r02_refined_mask", "SELECT cell, count(*) AS n, count(*) FILTER (is_valid AND NOT (blue / 10000 >= 0.4)) AS clear FROM pixels GROUP BY cell")
def _(a):
    """The rules' mask and a model's chance of cloud; here brightness in blue stands for the model."""
    clear = raster.refined_clear(F.col("is_valid"), ["blue", "red"], lambda f: f["blue"] / 10000)
    return a.pixels.withColumn("clear", clear).groupBy("cell").agg(F.count("*").alias("n"), F.count_if("clear").alias("clear"))


def _rectangle(x1, y1, x2, y2):
    return F.array(*(F.struct(x.cast("double").alias("x"), y.cast("double").alias("y")) for x, y in ((x1, y1), (x2, y1), (x2, y2), (x1, y2))))


def _footprints(a):
    """Entities as squares of 0.01 to 0.016 degrees with a square hole, and reference segments as squares of 0.02 degrees."""
    c, half = F.col, 0.005 + (F.col("vec_id") % 7) / 2000
    hole = F.lit(0.001) + (c("vec_id") % 3) / 1000
    entities = a.entities.select(c("entity_id").alias("left_id"), F.array(_rectangle(c("lon") - half, c("lat") - half, c("lon") + half, c("lat") + half), _rectangle(c("lon") - hole, c("lat") - hole, c("lon") + hole, c("lat") + hole)).alias("rings"))
    zones = a.segments.select(c("ref_id").alias("right_id"), F.array(_rectangle(c("x1") - 0.01, c("y1") - 0.01, c("x1") + 0.01, c("y1") + 0.01)).alias("rings"))
    return entities, zones


def _in_common(half):
    sides = (f"greatest(0, least({x} + {half}, {z} + 0.01e0) - greatest({x} - {half}, {z} - 0.01e0))" for x, z in (("lon", "x1"), ("lat", "y1")))
    return " * ".join(sides)


@query("g02_polygon_overlay", f"""SELECT left_id, right_id, round(common * 1e6, 6) AS common_area, round((4 * half * half - 4 * hole * hole - common) * 1e6, 6) AS left_only_area, round((0.0004e0 - common) * 1e6, 6) AS right_only_area
FROM (SELECT entity_id AS left_id, ref_id AS right_id, half, hole, {_in_common("half")} - {_in_common("hole")} AS common
FROM (SELECT *, 0.005e0 + (vec_id % 7) / 2000e0 AS half, 0.001e0 + (vec_id % 3) / 1000e0 AS hole FROM entities), segments) WHERE common > 0""")
def _(a):
    """Squares with holes over squares: what they have in common, and what either has alone."""
    left, right = _footprints(a)
    found = overlay.overlaid(left, right, ("common", "left_only", "right_only"))
    return found.select("left_id", "right_id", *(F.round(F.col(f"{k}_area") * 1e6, 6).alias(f"{k}_area") for k in ("common", "left_only", "right_only")))


@query("f05_points_in_polygons", """SELECT entity_id, ref_id AS area_id FROM entities, segments WHERE lon >= x1 - 0.02e0 AND lon < x1 + 0.02e0 AND lat >= y1 - 0.02e0 AND lat < y1 + 0.02e0
AND NOT (lon >= x1 - 0.005e0 AND lon < x1 + 0.005e0 AND lat >= y1 - 0.005e0 AND lat < y1 + 0.005e0)""")
def _(a):
    """Entities in a table of squares with holes."""
    c = F.col
    zones = a.segments.select(c("ref_id").alias("area_id"), F.array(*(_rectangle(c("x1") - h, c("y1") - h, c("x1") + h, c("y1") + h) for h in (0.02, 0.005))).alias("rings"))
    return overlay.points_in(a.entities, zones)


def _grid(a):
    """A pixel for each place of a cell's grid, and a known shift of each cell in eighths of a pixel."""
    pixels = a.pixels.groupBy("cell", "row_no", "col_no").agg(F.avg("red").alias("red"))
    shifts = a.pixels.select("cell").distinct().select("cell", ((F.col("cell") % 7 - 3) / 8).alias("dy"), ((F.col("cell") % 5 - 2) / 8).alias("dx"))
    return pixels, shifts


@query("r04_shifted", """WITH g AS (SELECT cell, row_no AS r, col_no AS c, avg(red) AS v FROM pixels GROUP BY ALL),
e AS (SELECT cell, min(r) AS top, max(r) AS bottom, min(c) AS left_, max(c) AS right_ FROM g GROUP BY cell),
t AS (SELECT cell, r, c, greatest(least(r - (cell % 7 - 3) / 8e0, bottom), top) AS y, greatest(least(c - (cell % 5 - 2) / 8e0, right_), left_) AS x FROM g JOIN e USING (cell)),
w AS (SELECT t.cell, t.r AS row_no, t.c AS col_no, floor(y) + i AS r, floor(x) + j AS c, CASE i WHEN 0 THEN 1 - (y - floor(y)) ELSE y - floor(y) END * CASE j WHEN 0 THEN 1 - (x - floor(x)) ELSE x - floor(x) END AS p
  FROM t, (VALUES (0), (1)) a(i), (VALUES (0), (1)) b(j))
SELECT w.cell, row_no, col_no, round(sum(p * v) / sum(p), 6) AS red FROM w JOIN g ON g.cell = w.cell AND g.r = w.r AND g.c = w.c WHERE p > 0 GROUP BY w.cell, row_no, col_no""")
def _(a):
    """Grids moved by fractions of a pixel."""
    pixels, shifts = _grid(a)
    return registration.shifted(pixels, shifts, "red").withColumn("red", F.round("red", 6))


@query("r03_coregistration")
def _(a):
    """Each cell's grid against itself moved by a known shift: what phase correlation finds, and whether it passes the gate."""
    pixels, shifts = _grid(a)
    moved = registration.shifted(pixels, shifts, "red").withColumnRenamed("red", "moved")
    both = pixels.join(moved, ["cell", "row_no", "col_no"])
    found = registration.scene_shifts(registration.tile_shifts(both, "red", "moved"), counts=registration.telling(valid=0.05))
    return found.select("cell", "tiles", "used", *(F.round(c, 4).alias(c) for c in ("dy", "dx", "residual_px")), "passes")


@query("f12_mask_regions")
def _(a):
    """The regions of the valid pixels of each cell whose red is high."""
    return regions.measures(regions.regions(a.pixels.where("is_valid AND red > 2000"), size=32, diagonal=True))


def _series(terms, x: str, y: str, outer: str, inner: str) -> str:
    return " + ".join(f"{c!r} * {outer}({2 * j}e0 * {x}) * {inner}({2 * j}e0 * {y})" for j, c in enumerate(terms, 1))


@query("g04_utm_grid", f"""WITH p AS (SELECT scene_id, (scene_no * 7919 % 36000) / 100e0 - 179.99679e0 AS lon, (scene_no * 104729 % 16000) / 100e0 - 79.49877e0 AS lat FROM scenes),
z AS (SELECT *, CASE WHEN lat >= 56 AND lat < 64 AND lon >= 3 AND lon < 12 THEN 32 WHEN lat >= 72 AND lon >= 0 AND lon < 42 THEN CASE WHEN lon < 9 THEN 31 WHEN lon < 21 THEN 33 WHEN lon < 33 THEN 35 ELSE 37 END ELSE floor((lon + 180) / 6)::INT + 1 END AS zone FROM p),
t AS (SELECT *, sinh(atanh(sin(radians(lat))) - {projection.ECC!r} * atanh({projection.ECC!r} * sin(radians(lat)))) AS t, radians(lon - (zone * 6 - 183)) AS e FROM z),
x AS (SELECT *, atan2(t, cos(e)) AS x, atanh(sin(e) / sqrt(1 + t * t)) AS y FROM t),
u AS (SELECT *, 500000e0 + {projection.RADIUS!r} * (y + {_series(projection.FORWARD, "x", "y", "cos", "sinh")}) AS east, {projection.RADIUS!r} * (x + {_series(projection.FORWARD, "x", "y", "sin", "cosh")}) + CASE WHEN lat < 0 THEN 10000000e0 ELSE 0e0 END AS north FROM x)
SELECT scene_id, zone, round(east, 1) AS easting, round(north, 1) AS northing, round(lon, 6) AS lon, round(lat, 6) AS lat, zone::VARCHAR || substr('{projection.BANDS}', least(floor((lat + 80) / 8)::INT, 19) + 1, 1)
|| substr(CASE zone % 3 WHEN 1 THEN 'ABCDEFGH' WHEN 2 THEN 'JKLMNPQR' ELSE 'STUVWXYZ' END, floor(east / 100000)::INT, 1) || substr('{projection.ROWS}', (floor(north / 100000)::INT + CASE WHEN zone % 2 = 0 THEN 5 ELSE 0 END) % 20 + 1, 1)
|| lpad((floor(east)::INT % 100000)::VARCHAR, 5, '0') || lpad((floor(north)::INT % 100000)::VARCHAR, 5, '0') AS mgrs FROM u""")
def _(a):
    """Places of scenes over the globe in metres of their zone, as grid references, and back in degrees."""
    lon, lat = (F.col("scene_no") * 7919 % 36000) / 100 - 179.99679, (F.col("scene_no") * 104729 % 16000) / 100 - 79.49877
    rows = a.scenes.select("scene_id", lon.alias("x"), lat.alias("y")).select("*", projection.to_utm(F.col("x"), F.col("y")).alias("u"), projection.mgrs(F.col("x"), F.col("y")).alias("mgrs"))
    back = projection.from_utm(F.col("u.zone"), F.col("u.south"), F.col("u.easting"), F.col("u.northing"))
    rows = rows.withColumn("p", back)
    return rows.select("scene_id", "u.zone", F.round("u.easting", 1).alias("easting"), F.round("u.northing", 1).alias("northing"), F.round("p.lon", 6).alias("lon"), F.round("p.lat", 6).alias("lat"), "mgrs")
