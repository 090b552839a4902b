"""Joins, aggregations, windows, sorts and set operations (J, A, W, T, X)."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from geoloom.functions import scalars
from geoloom.operators import aggregates as A
from geoloom.operators import discovery, geo, selection
from geoloom.plans.registry import query

M = geo.METRES_PER_DEGREE
DIST = f"""(SELECT entity_id, ref_id, layer, sqrt((ax + t * dx) * (ax + t * dx) + (ay + t * dy) * (ay + t * dy)) AS d FROM (SELECT *, CASE WHEN dx * dx + dy * dy > 0 THEN greatest(0, least(1, -(ax * dx + ay * dy) / (dx * dx + dy * dy))) ELSE 0 END AS t
 FROM (SELECT *, bx - ax AS dx, by_ - ay AS dy FROM (SELECT entity_id, ref_id, layer, (x1 - lon) * cos(radians(lat)) * {M}::DOUBLE AS ax, (y1 - lat) * {M}::DOUBLE AS ay, (x2 - lon) * cos(radians(lat)) * {M}::DOUBLE AS bx, (y2 - lat) * {M}::DOUBLE AS by_ FROM entities, segments))))"""


@query("j01_within_distance", f"SELECT DISTINCT entity_id FROM {DIST} WHERE layer = 'ref_water' AND d <= 1500")
def _(a):
    return geo.within_distance(a.entities, a.segments.where("layer = 'ref_water'"), 1500.0).select("entity_id")


@query("j02_j13_nearest_features", f"""WITH d AS (SELECT *, row_number() OVER (PARTITION BY entity_id, layer ORDER BY d, ref_id) AS k FROM {DIST} WHERE d <= 3000), n AS (SELECT * FROM d WHERE k = 1)
SELECT entity_id, max(ref_id) FILTER (layer = 'ref_water') AS water_id, round(max(d) FILTER (layer = 'ref_water'), 3) AS river_m, max(ref_id) FILTER (layer = 'ref_roads') AS road_id, round(max(d) FILTER (layer = 'ref_roads'), 3) AS road_m FROM n GROUP BY entity_id""")
def _(a):
    def near(layer, key, name):
        n = geo.nearest(a.entities, a.segments.where(F.col("layer") == layer), 3000.0)
        return n.select("entity_id", F.col("ref_id").alias(key), F.round("distance_m", 3).alias(name))

    return near("ref_water", "water_id", "river_m").join(near("ref_roads", "road_id", "road_m"), "entity_id", "full")


@query("j03_relation_table", f"SELECT entity_id, ref_id, CASE layer WHEN 'ref_water' THEN 'near_water' ELSE 'near_road' END AS relation, round(d, 3) AS distance_m FROM {DIST} WHERE d <= 1000")
def _(a):
    relation = F.when(F.col("layer") == "ref_water", "near_water").otherwise("near_road")
    pairs = geo.near_pairs(a.entities.select("entity_id", "lon", "lat"), a.segments.withColumn("relation", relation), 1000.0, keep=("relation",))
    return pairs.select("entity_id", "ref_id", "relation", F.round("distance_m", 3).alias("distance_m"))


@query("j04_j05_semi_and_lookup", "SELECT e.entity_id, e.entity_type, t.n FROM entities e JOIN (SELECT cell_no, count(*) AS n FROM trajectory GROUP BY cell_no) t ON t.cell_no = e.vec_id WHERE EXISTS (SELECT 1 FROM scenes s WHERE s.scene_no = e.vec_id AND s.cloud_cover < 50)")
def _(a):
    clear = a.scenes.where("cloud_cover < 50").select(F.col("scene_no").alias("vec_id"))
    hits = a.trajectory.groupBy(F.col("cell_no").alias("vec_id")).agg(F.count("*").alias("n"))
    return a.entities.join(clear, "vec_id", "left_semi").join(hits, "vec_id").select("entity_id", "entity_type", "n")


@query("j06_left_outer_default", "SELECT v.entity_id, coalesce(e.entity_type, 'unknown') AS entity_type, coalesce(e.area_m2, 0) AS area_m2 FROM vectors v LEFT JOIN (SELECT * FROM entities WHERE vec_id % 3 <> 0) e USING (entity_id)")
def _(a):
    e = a.entities.where("vec_id % 3 <> 0").select("entity_id", "entity_type", "area_m2")
    return a.vectors.select("entity_id").join(e, "entity_id", "left").select("entity_id", F.coalesce("entity_type", F.lit("unknown")).alias("entity_type"), F.coalesce("area_m2", F.lit(0.0)).alias("area_m2"))


@query("j07_m13_d06_co_change", """SELECT l.entity_id AS source, r.entity_id AS target, abs(date_diff('day', l.first_seen, r.first_seen)) AS days,
  round(greatest(0.2, 1 - abs(date_diff('day', l.first_seen, r.first_seen)) / 21.0) * CASE WHEN l.change_type = r.change_type THEN 1.0 ELSE 0.5 END, 3) AS weight, strftime(least(l.first_seen, r.first_seen), '%b %Y') AS label
  FROM entities l JOIN entities r ON l.entity_id < r.entity_id AND abs(date_diff('day', l.first_seen, r.first_seen)) <= 21""")
def _(a):
    return discovery.co_change_edges(a.entities, 21)


TIMED = "(SELECT *, date_diff('day', DATE '1970-01-01', scene_date) * 1440 + scene_no * 7 % 1440 AS minute, 77.0e0 + (scene_no * 7919 % 3000) / 10000e0 AS west, 28.4e0 + (scene_no * 104729 % 3000) / 10000e0 AS south FROM scenes)"
IN_AOI = "{0}.west <= 77.25e0 AND {0}.west + 0.05e0 >= 77.1e0 AND {0}.south <= 28.65e0 AND {0}.south + 0.05e0 >= 28.5e0"


@query("j08_interval_join", f"SELECT l.scene_id AS optical_id, r.scene_id AS sar_id FROM {TIMED} l JOIN {TIMED} r ON l.relative_orbit = r.relative_orbit AND l.band_letter = r.band_letter AND abs(l.minute - r.minute) < 2 WHERE l.scene_no <> r.scene_no AND {IN_AOI.format('l')} AND {IN_AOI.format('r')}")
def _(a):
    """Scenes of one orbit taken less than two minutes apart, both over the area of interest."""
    minute = F.datediff("scene_date", F.lit("1970-01-01").cast("date")) * 1440 + F.col("scene_no") * 7 % 1440
    west, south = F.lit(77.0) + (F.col("scene_no") * 7919 % 3000) / 10000, F.lit(28.4) + (F.col("scene_no") * 104729 % 3000) / 10000
    timed = a.scenes.withColumns({"minute": minute, "west": west, "south": south})
    inside = timed.where("west <= 77.25 and west + 0.05 >= 77.1 and south <= 28.65 and south + 0.05 >= 28.5")
    pairs = discovery.near_in_time(inside, inside, "minute", 2, ["relative_orbit", "band_letter"])
    return pairs.where("l.scene_no <> r.scene_no").select(F.col("l.scene_id").alias("optical_id"), F.col("r.scene_id").alias("sar_id"))


@query("d04_minute_shift", "SELECT seq, cell_id, floor(epoch(ts - interval 45 minute))::BIGINT AS opens, floor(epoch(ts + interval 90 minute))::BIGINT AS closes FROM trajectory")
def _(a):
    moved = lambda n: F.unix_timestamp(F.timestamp_add("MINUTE", F.lit(n), F.col("ts").cast("timestamp")))
    return a.trajectory.select("seq", "cell_id", moved(-45).alias("opens"), moved(90).alias("closes"))


BOX = "(SELECT *, (lon - 77.0) * 98000 - sqrt(area_m2) / 2 AS x1, (lat - 28.0) * 111000 - sqrt(area_m2) / 2 AS y1, (lon - 77.0) * 98000 + sqrt(area_m2) / 2 AS x2, (lat - 28.0) * 111000 + sqrt(area_m2) / 2 AS y2 FROM (SELECT entity_id, entity_type, lon, lat, area_m2 * 400 AS area_m2 FROM entities))"
IOU = f"""SELECT a.entity_id AS left_id, b.entity_id AS right_id, a.entity_type, greatest(0, least(a.x2, b.x2) - greatest(a.x1, b.x1)) * greatest(0, least(a.y2, b.y2) - greatest(a.y1, b.y1)) AS i, (a.x2 - a.x1) * (a.y2 - a.y1) + (b.x2 - b.x1) * (b.y2 - b.y1) AS s
  FROM {BOX} a JOIN {BOX} b ON a.entity_type = b.entity_type AND a.entity_id < b.entity_id"""


@query("j09_g02_iou_join", f"SELECT left_id, right_id, round(i / (s - i), 6) AS iou FROM ({IOU}) WHERE i / (s - i) > 0.3")
def _(a):
    boxed = geo.boxes(a.entities.select("entity_id", "entity_type", "lon", "lat", (F.col("area_m2") * 400).alias("area_m2")))
    return geo.overlapping_pairs(boxed, 0.3, size=3000.0).select("left_id", "right_id", F.round("iou", 6).alias("iou"))


NEW = "{0}::BIGINT % 3 = 0"


MATCHED = f"""WITH p AS (SELECT left_id, right_id, round(i / (s - i), 9) AS iou FROM ({IOU}) WHERE i / (s - i) > 0.3), q AS (SELECT left_id AS d, right_id AS e, iou FROM p UNION ALL SELECT right_id, left_id, iou FROM p),
m AS (SELECT d, e FROM (SELECT d, e, row_number() OVER (PARTITION BY d ORDER BY iou DESC, e) AS k FROM q WHERE {NEW.format('substr(d, 5)')} AND NOT {NEW.format('substr(e, 5)')}) WHERE k = 1)
SELECT coalesce(e, entity_id) AS entity_id, max(last_seen) AS last_seen, count(e) AS n_matched FROM entities LEFT JOIN m ON d = entity_id GROUP BY coalesce(e, entity_id)"""


@query("st2_matched_ingest", MATCHED)
def _(a):
    """A third of the entities arrives as new detections: what overlaps a known one of its type updates that, the rest is added."""
    boxed = geo.boxes(a.entities.select("entity_id", "entity_type", "lon", "lat", (F.col("area_m2") * 400).alias("area_m2"), "last_seen", (F.col("vec_id") % 3 == 0).alias("new")))
    matches = geo.best_matches(boxed.where("new"), boxed.where("NOT new"), 0.3, size=3000.0)
    into = boxed.select("entity_id", "last_seen").join(matches.select("entity_id", "match"), "entity_id", "left")
    return into.groupBy(F.coalesce("match", "entity_id").alias("entity_id")).agg(F.max("last_seen").alias("last_seen"), F.count("match").alias("n_matched"))


@query("j09_a16_merged_groups", f"""WITH RECURSIVE p AS (SELECT left_id, right_id FROM ({IOU}) WHERE i / (s - i) > 0.3), e AS (SELECT left_id AS a, right_id AS b FROM p UNION ALL SELECT right_id, left_id FROM p),
r AS (SELECT DISTINCT a AS v, a AS u FROM e UNION SELECT r.v, e.b FROM r JOIN e ON e.a = r.u), g AS (SELECT v, min(u) AS component FROM r GROUP BY v)
SELECT component, count(*) AS n, round(avg(class_confidence), 6) AS confidence, array_to_string(list_sort(list(DISTINCT scene_id)), ',') AS scenes FROM g JOIN entities ON entity_id = v GROUP BY component""")
def _(a):
    """Groups of overlapping boxes: connected components, their size, mean confidence and scenes."""
    boxed = geo.boxes(a.entities.select("entity_id", "entity_type", "lon", "lat", (F.col("area_m2") * 400).alias("area_m2")))
    groups = discovery.connected(geo.overlapping_pairs(boxed, 0.3, size=3000.0), "left_id", "right_id")
    e = a.entities.select(F.col("entity_id").alias("id"), "class_confidence", "scene_id").join(groups, "id")
    return e.groupBy("component").agg(F.count("*").alias("n"), F.round(F.avg("class_confidence"), 6).alias("confidence"), F.array_join(F.sort_array(F.collect_set("scene_id")), ",").alias("scenes"))


@query("j10_fk_join", "SELECT e.entity_id, s.scene_date FROM entities e LEFT JOIN scenes s ON s.scene_no = e.vec_id % 40")
def _(a):
    s = a.scenes.select(F.col("scene_no").alias("k"), "scene_date")
    return a.entities.withColumn("k", F.col("vec_id") % 40).join(s, "k", "left").select("entity_id", "scene_date")


@query("j11_x02_missing_months", "SELECT strftime(m, '%Y-%m') AS month FROM (SELECT unnest(generate_series(date '1994-06-01', date '2002-06-01', interval 1 month)) AS m) WHERE strftime(m, '%Y-%m') NOT IN (SELECT strftime(scene_date, '%Y-%m') FROM scenes)")
def _(a):
    return selection.missing_months(a.scenes, "scene_date", "1994-06-01", "2002-06-01")


@query("j12_f18_seed_exclusion", "SELECT entity_id FROM entities e WHERE NOT EXISTS (SELECT 1 FROM vectors s WHERE s.entity_id = e.entity_id AND s.vec_id < 10) AND EXISTS (SELECT 1 FROM vectors v WHERE v.entity_id = e.entity_id)")
def _(a):
    return a.entities.join(a.vectors.where("vec_id < 10").select("entity_id"), "entity_id", "left_anti").join(a.vectors.select("entity_id"), "entity_id", "left_semi").select("entity_id")


@query("j14_ranked_lookup", "SELECT r.rank, e.entity_id, e.lon, e.lat FROM (SELECT cell_no, row_number() OVER (ORDER BY max(z) DESC, cell_no) AS rank FROM trajectory GROUP BY cell_no) r JOIN entities e ON e.vec_id = r.cell_no WHERE rank <= 50")
def _(a):
    top = a.trajectory.groupBy("cell_no").agg(F.max("z").alias("z")).orderBy(F.desc("z"), "cell_no").limit(50)
    ranked = top.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("z"), "cell_no")))  # of 50 rows
    return a.entities.join(F.broadcast(ranked), F.col("vec_id") == F.col("cell_no")).select("rank", "entity_id", "lon", "lat")


@query("j15_judgement_default", "SELECT q.entity_id AS query_id, e.entity_id, CASE WHEN q.label = e.label THEN 3 WHEN q.label % 5 = e.label % 5 THEN 1 ELSE 0 END AS rel FROM vectors q, vectors e WHERE q.vec_id % 100 = 0")
def _(a):
    q = a.vectors.where("vec_id % 100 = 0").select(F.col("entity_id").alias("query_id"), F.col("label").alias("q_label"))  # a stated set of queries
    rel = F.when(F.col("q_label") == F.col("label"), 3).when(F.col("q_label") % 5 == F.col("label") % 5, 1).otherwise(0)
    return a.vectors.select("entity_id", "label").crossJoin(q).select("query_id", "entity_id", rel.alias("rel"))


@query("j16_a25_date_errors", "SELECT e.entity_id, t.last_date, abs(date_diff('day', t.last_date, e.first_seen)) AS error_days, CASE WHEN t.last_date IS NULL THEN 'no_trajectory' WHEN e.first_seen IS NULL THEN 'no_label' END AS reason FROM entities e LEFT JOIN (SELECT cell_no, max(obs_date) AS last_date FROM trajectory GROUP BY cell_no) t ON t.cell_no = e.vec_id")
def _(a):
    t = a.trajectory.groupBy(F.col("cell_no").alias("vec_id")).agg(F.max("obs_date").alias("last_date"))
    why = F.when(F.col("last_date").isNull(), "no_trajectory").when(F.col("first_seen").isNull(), "no_label")
    return a.entities.join(t, "vec_id", "left").select("entity_id", "last_date", F.abs(F.datediff("last_date", "first_seen")).alias("error_days"), why.alias("reason"))


@query("j17_as_of", "SELECT cell_id, arg_min(seq, (abs(epoch(ts) - epoch(timestamp '2024-01-15 12:00:00')), seq)) AS nearest, min(seq) FILTER (ts >= timestamp '2024-01-15 12:00:00') AS first_after FROM trajectory GROUP BY cell_id")
def _(a):
    at = F.lit("2024-01-15 12:00:00").cast("timestamp_ntz")
    away = F.abs(F.unix_micros(F.col("ts").cast("timestamp")) - F.unix_micros(at.cast("timestamp")))
    return a.trajectory.groupBy("cell_id").agg(F.min_by("seq", F.struct(away, F.col("seq"))).alias("nearest"), F.min(F.when(F.col("ts") >= at, F.col("seq"))).alias("first_after"))


@query("j18_aoi_coverage", "SELECT ref_id, round(greatest(0, least(greatest(x1, x2), 77.25) - greatest(least(x1, x2), 77.15)) * greatest(0, least(greatest(y1, y2), 28.65) - greatest(least(y1, y2), 28.55)) / (0.1 * 0.1), 9) AS coverage FROM segments")
def _(a):
    side = lambda p, q, lo, hi: F.greatest(F.lit(0.0), F.least(F.greatest(p, q), F.lit(hi)) - F.greatest(F.least(p, q), F.lit(lo)))
    return a.segments.select("ref_id", F.round(side("x1", "x2", 77.15, 77.25) * side("y1", "y2", 28.55, 28.65) / F.lit(0.1 * 0.1), 9).alias("coverage"))


@query("j20_sensor_pairs", "SELECT l.cell_id, l.seq AS optical_seq, r.seq AS sar_seq FROM trajectory l JOIN trajectory r ON l.cell_id = r.cell_id AND abs(date_diff('day', l.obs_date, r.obs_date)) <= 3 WHERE l.sensor = 'sentinel-2' AND r.sensor = 'sentinel-1' AND l.z >= 2.0 AND r.z >= 2.0")
def _(a):
    t = a.trajectory.where("z >= 2.0").select("cell_id", "seq", "obs_date", "sensor")
    pairs = discovery.band_pairs(t.where("sensor = 'sentinel-2'"), t.where("sensor = 'sentinel-1'"), "obs_date", 3, ["cell_id"])
    return pairs.select(F.col("l.cell_id").alias("cell_id"), F.col("l.seq").alias("optical_seq"), F.col("r.seq").alias("sar_seq"))


@query("j21_cascade_delete", "SELECT t.cell_id, t.seq FROM trajectory t WHERE EXISTS (SELECT 1 FROM entities e WHERE e.vec_id = t.cell_no AND e.change_type <> 'clearance')")
def _(a):
    left = a.entities.where("change_type <> 'clearance'").select(F.col("vec_id").alias("cell_no"))
    return a.trajectory.join(left, "cell_no", "left_semi").select("cell_id", "seq")


# --- aggregations -------------------------------------------------------------------------------------------------------


@query("a01_a02_counts", "SELECT count(*) AS n, count(river_distance_m) AS n_river, round(avg(river_distance_m), 6) AS mean_river, min(river_distance_m) AS least_river FROM entities")
def _(a):
    r = F.col("river_distance_m")
    return a.entities.agg(F.count("*").alias("n"), F.count(r).alias("n_river"), F.round(F.avg(r), 6).alias("mean_river"), F.min(r).alias("least_river"))


@query("a03_a22_counts_by_type", "SELECT entity_type, count(*) AS n, count(DISTINCT scene_id) AS scenes FROM entities GROUP BY entity_type ORDER BY n DESC, entity_type")
def _(a):
    return a.entities.groupBy("entity_type").agg(F.count("*").alias("n"), F.count_distinct("scene_id").alias("scenes")).orderBy(F.desc("n"), "entity_type")


@query("a04_distinct_cells", "SELECT count(DISTINCT (floor(lon / 0.01)::BIGINT, floor(lat / 0.01)::BIGINT)) AS cells, count(DISTINCT scene_id) AS scenes FROM entities")
def _(a):
    return a.entities.agg(F.count_distinct(F.struct(geo.cell(F.col("lon")), geo.cell(F.col("lat")))).alias("cells"), F.count_distinct("scene_id").alias("scenes"))


@query("a05_r01_class_breakdown", "SELECT cell, round(avg((scl IN (8, 9, 10))::INT), 6) AS cloud, round(avg((scl = 3)::INT), 6) AS shadow, round(avg((scl IN (4, 5, 6))::INT), 6) AS clear FROM pixels GROUP BY cell")
def _(a):
    scl = F.col("scl")
    return a.pixels.groupBy("cell").agg(F.round(A.share(scl.isin(8, 9, 10)), 6).alias("cloud"), F.round(A.share(scl == 3), 6).alias("shadow"), F.round(A.share(scl.isin(4, 5, 6)), 6).alias("clear"))


@query("a06_masked_cell_means", "SELECT cell, count(*) AS n, round(avg(is_valid::INT), 6) AS valid_share, CASE WHEN avg(is_valid::INT) >= 0.75 THEN round(avg(value) FILTER (is_valid), 6) END AS mean FROM pixels GROUP BY cell")
def _(a):
    m = A.masked_cell_means(a.pixels, "cell", "value", F.col("is_valid"), 0.75)
    return m.select("cell", "n", F.round("valid_share", 6).alias("valid_share"), F.round("mean", 6).alias("mean"))


@query("a07_mode_orbit", "SELECT band_letter, relative_orbit FROM (SELECT band_letter, relative_orbit, row_number() OVER (PARTITION BY band_letter ORDER BY count(*) DESC, min(scene_no)) AS k FROM scenes GROUP BY band_letter, relative_orbit) WHERE k = 1")
def _(a):
    c = a.scenes.groupBy("band_letter", "relative_orbit").agg(F.count("*").alias("n"), F.min("scene_no").alias("first"))
    return c.groupBy("band_letter").agg(F.max_by("relative_orbit", F.struct("n", -F.col("first"))).alias("relative_orbit"))


@query("a08_reference_scene", "SELECT band_letter, arg_min(scene_id, (cloud_cover, scene_no)) AS scene_id, min(cloud_cover) AS cloud_cover FROM scenes GROUP BY band_letter")
def _(a):
    return a.scenes.groupBy("band_letter").agg(F.min_by("scene_id", F.struct("cloud_cover", "scene_no")).alias("scene_id"), F.min("cloud_cover").alias("cloud_cover"))


@query("a09_min_median_max", "SELECT relative_orbit, min(valid_fraction) AS low, median(valid_fraction) AS mid, max(valid_fraction) AS high FROM scenes GROUP BY relative_orbit")
def _(a):
    ends = a.scenes.groupBy("relative_orbit").agg(F.min("valid_fraction").alias("low"), F.max("valid_fraction").alias("high"))
    return ends.join(A.percentiles(a.scenes, "valid_fraction", {"mid": 0.5}, "relative_orbit"), "relative_orbit")


@query("a10_upper_median", "SELECT relative_orbit, list_sort(list(cloud_cover))[(count(*) // 2) + 1] AS cloud_cover FROM scenes GROUP BY relative_orbit")
def _(a):
    return A.upper_median(a.scenes, "cloud_cover", "relative_orbit")


@query("a11_nearest_rank", "SELECT cell_id, list_sort(list(value))[round_even(0.95 * (count(*) - 1), 0)::INT + 1] AS value FROM trajectory GROUP BY cell_id")
def _(a):
    return A.nearest_rank(a.trajectory, "value", 0.95, "cell_id")


@query("a12_r07_percentile_stretch", "SELECT l_orderkey, l_linenumber, round(greatest(0, least(255, (red - lo) / (hi - lo) * 255)), 3) AS stretched FROM pixels, (SELECT quantile_cont(red, 0.02) AS lo, quantile_cont(red, 0.98) AS hi FROM pixels)")
def _(a):
    from geoloom.operators.vectors import with_row

    limits = A.percentiles(a.pixels, "red", {"lo": 0.02, "hi": 0.98})
    v = (F.col("red") - F.col("lo")) / (F.col("hi") - F.col("lo")) * 255
    return with_row(a.pixels, limits).select("l_orderkey", "l_linenumber", F.round(F.greatest(F.lit(0.0), F.least(F.lit(255.0), v)), 3).alias("stretched"))


@query("a17_enl", "SELECT cell, round(avg(vv), 9) AS mean, round(stddev_pop(vv), 9) AS sd, round(pow(avg(vv) / stddev_pop(vv), 2), 4) AS enl FROM pixels GROUP BY cell HAVING count(*) > 1 AND stddev_pop(vv) > 0")
def _(a):
    g = a.pixels.groupBy("cell").agg(F.count("*").alias("n"), F.avg("vv").alias("m"), F.stddev_pop("vv").alias("s")).where("n > 1 AND s > 0")
    return g.select("cell", F.round("m", 9).alias("mean"), F.round("s", 9).alias("sd"), F.round(F.pow(F.col("m") / F.col("s"), 2), 4).alias("enl"))


@query("a18_s18_sizes", """SELECT *, CASE WHEN bytes < 1024 THEN printf('%.1f B', bytes) WHEN bytes < 1048576 THEN printf('%.1f KB', bytes / 1024) WHEN bytes < 1073741824 THEN printf('%.1f MB', bytes / 1048576) WHEN bytes < 1099511627776 THEN printf('%.1f GB', bytes / 1073741824) ELSE printf('%.1f TB', bytes / 1099511627776) END AS human
FROM (SELECT relative_orbit, count(*) AS files, count(*) FILTER (ends_with(scene_id, '7')) AS ending_7, round(sum(size_bytes), 2)::DOUBLE AS bytes FROM scenes GROUP BY relative_orbit)""")
def _(a):
    sizes = a.scenes.groupBy("relative_orbit").agg(F.count("*").alias("files"), F.count_if(F.endswith("scene_id", F.lit("7"))).alias("ending_7"), F.round(F.sum("size_bytes"), 2).cast("double").alias("bytes"))
    return sizes.withColumn("human", scalars.human_bytes(F.col("bytes")))


@query("a20_x03_manifest_digest", """WITH u AS (SELECT * FROM entities WHERE vec_id % 2 = 0 UNION ALL SELECT * FROM entities WHERE vec_id % 2 = 1),
r AS (SELECT entity_type, vec_id // 65536 AS part, vec_id // 256 AS leaf, sha256(string_agg(entity_id || ':' || scene_id, ',' ORDER BY vec_id)) AS digest FROM u GROUP BY ALL),
p AS (SELECT entity_type, part, sha256(string_agg(digest, ',' ORDER BY leaf)) AS digest FROM r GROUP BY ALL) SELECT entity_type, part, digest FROM p""")
def _(a):
    """A manifest's digest by ranges of 65,536 keys: each is taken of the digests of 256 keys, so no group grows."""
    both = a.entities.where("vec_id % 2 = 0").unionByName(a.entities.where("vec_id % 2 = 1"), allowMissingColumns=True)
    entries = both.select("entity_type", "vec_id", F.concat_ws(":", "entity_id", "scene_id").alias("entry"))

    def digest(df, key: str, value: str, *by: str):
        ordered = F.sort_array(F.collect_list(F.struct(F.col(key).alias("k"), F.col(value).alias("v"))))
        return df.groupBy(*by).agg(F.sha2(F.array_join(F.transform(ordered, lambda x: x.v), ","), 256).alias("digest"))

    leaves = digest(entries.withColumn("leaf", F.floor(F.col("vec_id") / 256)), "vec_id", "entry", "entity_type", "leaf")
    return digest(leaves.withColumn("part", F.floor(F.col("leaf") / 256)), "leaf", "digest", "entity_type", "part")


@query("a21_group_lists", "SELECT scene_id, string_agg(entity_id, ',' ORDER BY entity_id) AS members, round(avg(class_confidence), 6) AS confidence FROM entities GROUP BY scene_id")
def _(a):
    return a.entities.groupBy("scene_id").agg(F.array_join(F.sort_array(F.collect_list("entity_id")), ",").alias("members"), F.round(F.avg("class_confidence"), 6).alias("confidence"))


@query("a26_m11_bounds", "SELECT layer, floor(least(min(x1), min(x2)) * 100) AS west, ceil(greatest(max(x1), max(x2)) * 100) AS east, floor(least(min(y1), min(y2)) * 100) AS south, ceil(greatest(max(y1), max(y2)) * 100) AS north FROM segments GROUP BY layer")
def _(a):
    low = lambda p, q: F.floor(F.least(F.min(p), F.min(q)) * 100).cast("double")
    high = lambda p, q: F.ceil(F.greatest(F.max(p), F.max(q)) * 100).cast("double")
    return a.segments.groupBy("layer").agg(low("x1", "x2").alias("west"), high("x1", "x2").alias("east"), low("y1", "y2").alias("south"), high("y1", "y2").alias("north"))


# --- windows, sorts, sets -----------------------------------------------------------------------------------------------


@query("w01_t06_stratify_by_month", "SELECT scene_id, strftime(scene_date, '%Y-%m') AS month FROM scenes QUALIFY row_number() OVER (PARTITION BY strftime(scene_date, '%Y-%m') ORDER BY cloud_cover, scene_no) <= 3 ORDER BY scene_date, scene_id")
def _(a):
    best = selection.best_of(a.scenes, [selection.month("scene_date")], [F.col("cloud_cover"), F.col("scene_no")], 3)
    return best.orderBy("scene_date", "scene_id").select("scene_id", selection.month("scene_date").alias("month"))


@query("w02_f16_best_per_quarter", "SELECT year(scene_date) || '-Q' || quarter(scene_date) AS quarter, scene_id, valid_fraction FROM scenes WHERE NOT excluded_from_change QUALIFY row_number() OVER (PARTITION BY year(scene_date), quarter(scene_date) ORDER BY valid_fraction DESC, scene_no) = 1")
def _(a):
    best = selection.best_of(a.scenes.where("NOT excluded_from_change"), [selection.quarter("scene_date")], [F.desc("valid_fraction"), F.col("scene_no")], 1)
    return best.select(selection.quarter("scene_date").alias("quarter"), "scene_id", "valid_fraction")


@query("w12_k13_recent_queries", "SELECT cell_id, max(ts) AS last_access FROM trajectory GROUP BY cell_id ORDER BY last_access DESC, cell_id LIMIT 100")
def _(a):
    return a.trajectory.groupBy("cell_id").agg(F.max("ts").alias("last_access")).orderBy(F.desc("last_access"), "cell_id").limit(100)


@query("t04_t07_sorted_prefix", "SELECT entity_id, area_m2 FROM entities ORDER BY area_m2 DESC, entity_id LIMIT 25")
def _(a):
    return a.entities.select("entity_id", "area_m2").orderBy(F.desc("area_m2"), "entity_id").limit(25)


@query("t09_explain_gate", "SELECT entity_id, k AS rank, CASE WHEN k <= 5 THEN 'explained' ELSE 'template' END AS explanation FROM (SELECT entity_id, row_number() OVER (ORDER BY area_m2 DESC, entity_id) AS k FROM entities) WHERE k <= 20")
def _(a):
    top = a.entities.select("entity_id", "area_m2").orderBy(F.desc("area_m2"), "entity_id").limit(20)
    k = F.row_number().over(Window.orderBy(F.desc("area_m2"), "entity_id"))  # of 20 rows
    return top.select("entity_id", k.alias("rank")).withColumn("explanation", F.when(F.col("rank") <= 5, "explained").otherwise("template"))


@query("x01_set_differences", "SELECT 'undeclared' AS side, tile FROM (SELECT square AS tile FROM scenes EXCEPT SELECT substr(change_type, 1, 2) FROM entities) UNION ALL SELECT 'unobserved', tile FROM (SELECT substr(change_type, 1, 2) AS tile FROM entities EXCEPT SELECT square FROM scenes)")
def _(a):
    seen, said = a.scenes.select(F.col("square").alias("tile")), a.entities.select(F.substring("change_type", 1, 2).alias("tile"))
    return seen.subtract(said).select(F.lit("undeclared").alias("side"), "tile").unionByName(said.subtract(seen).select(F.lit("unobserved").alias("side"), "tile"))


@query("x04_x06_reconcile_failures", "SELECT scene_id FROM scenes WHERE scene_no % 9 = 0 EXCEPT SELECT scene_id FROM scenes WHERE scene_no % 27 = 0")
def _(a):
    return a.scenes.where("scene_no % 9 = 0").select("scene_id").subtract(a.scenes.where("scene_no % 27 = 0").select("scene_id"))


@query("x05_dissolved_boxes", "SELECT scene_id, entity_type, min(lon) AS west, max(lon) AS east, min(lat) AS south, max(lat) AS north FROM entities GROUP BY scene_id, entity_type")
def _(a):
    return a.entities.groupBy("scene_id", "entity_type").agg(F.min("lon").alias("west"), F.max("lon").alias("east"), F.min("lat").alias("south"), F.max("lat").alias("north"))
