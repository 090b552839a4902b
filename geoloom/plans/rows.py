"""Scans, filters, projections and scalar functions (S, F, P, C, D, M, JS)."""

from __future__ import annotations

from pyspark.sql import functions as F

from geoloom.functions import scalars as S
from geoloom.operators import geo
from geoloom.plans.registry import query

AOI = [(77.12, 28.52), (77.31, 28.50), (77.33, 28.66), (77.22, 28.71), (77.11, 28.64)]
E, T, SC, PX, SEG, QU = "entities", "trajectory", "scenes", "pixels", "segments", "questions"


@query("s01_entity_scan", "SELECT entity_id, entity_type, change_type FROM entities ORDER BY entity_id")
def _(a):
    return a.entities.select("entity_id", "entity_type", "change_type").orderBy("entity_id")


@query("s02_point_lookup", "SELECT entity_id, entity_type, lon, lat FROM entities WHERE vec_id = 42")
def _(a):
    return a.entities.where("vec_id = 42").select("entity_id", "entity_type", "lon", "lat")


@query("s03_row_counts", "SELECT 'entities' AS layer, count(*) AS n FROM entities UNION ALL SELECT layer, count(*) FROM segments GROUP BY layer")
def _(a):
    return a.entities.agg(F.count("*").alias("n")).select(F.lit("entities").alias("layer"), "n").unionByName(a.segments.groupBy("layer").agg(F.count("*").alias("n")))


@query("s05_ledger_scan", "SELECT log_id, actor, action, entity_id FROM audit ORDER BY log_id")
def _(a):
    return a.audit.select("log_id", "actor", "action", "entity_id").orderBy("log_id")


@query("s15_pixel_window", "SELECT row_no, col_no, value, l_orderkey, l_linenumber FROM pixels WHERE row_no BETWEEN 8 AND 15 AND col_no BETWEEN 16 AND 31")
def _(a):
    return a.pixels.where(F.col("row_no").between(8, 15) & F.col("col_no").between(16, 31)).select("row_no", "col_no", "value", "l_orderkey", "l_linenumber")


@query("f01_f04_entity_filters", "SELECT entity_id FROM entities WHERE entity_type = 'building' AND change_type IN ('construction', 'expansion') AND change_confidence >= 0.5 AND first_seen BETWEEN date '2024-03-01' AND date '2025-09-30'")
def _(a):
    from geoloom.plans.dsl import Plan, stage_one

    plan = Plan(entity_type="building", change_types=("construction", "expansion"), min_confidence=0.5, from_date="2024-03-01", to_date="2025-09-30")
    return stage_one(a.entities, plan).select("entity_id")


@query(
    "f05_aoi_polygon",
    f"""WITH ring AS (SELECT unnest({[x for x, _ in AOI]}) AS xa, unnest({[y for _, y in AOI]}) AS ya, unnest({[x for x, _ in AOI[1:] + AOI[:1]]}) AS xb, unnest({[y for _, y in AOI[1:] + AOI[:1]]}) AS yb)
SELECT entity_id FROM entities, ring WHERE (lat < ya) <> (lat < yb) AND lon < (lat - ya) * ((xb::DOUBLE - xa::DOUBLE) / (yb::DOUBLE - ya::DOUBLE)) + xa GROUP BY entity_id HAVING count(*) % 2 = 1""",
)
def _(a):
    return a.entities.where(geo.in_polygon(F.col("lon"), F.col("lat"), AOI)).select("entity_id")


@query("f06_cached_distance", "SELECT entity_id, coalesce(river_distance_m, road_distance_m) AS distance_m FROM entities WHERE coalesce(river_distance_m, road_distance_m) <= 500")
def _(a):
    d = F.coalesce("river_distance_m", "road_distance_m")
    return a.entities.where(d <= 500).select("entity_id", d.alias("distance_m"))


@query("f08_f09_scene_filters", "SELECT scene_id, cloud_cover FROM scenes WHERE cloud_cover < 20 AND aoi_coverage >= 0.3 AND list_contains(string_split(assets, ','), 'swir') AND relative_orbit = 3")
def _(a):
    return a.scenes.where((F.col("cloud_cover") < 20) & (F.col("aoi_coverage") >= 0.3) & F.array_contains(F.split("assets", ","), "swir") & (F.col("relative_orbit") == 3)).select("scene_id", "cloud_cover")


@query("f10_f12_usable_regions", "SELECT entity_id, area_m2 FROM entities WHERE valid_fraction >= 0.5 AND area_m2 BETWEEN 200 AND 5000 AND class_confidence >= 0.6")
def _(a):
    return a.entities.where((F.col("valid_fraction") >= 0.5) & F.col("area_m2").between(200, 5000) & (F.col("class_confidence") >= 0.6)).select("entity_id", "area_m2")


@query("f13_valid_observations", "SELECT cell_id, seq FROM trajectory WHERE valid_fraction >= 0.80")
def _(a):
    return a.trajectory.where(F.col("valid_fraction") >= 0.80).select("cell_id", "seq")


@query("f14_cloud_mask", "SELECT cell, count(*) AS n FROM pixels WHERE scl NOT IN (0, 1, 3, 8, 9, 10, 11) GROUP BY cell")
def _(a):
    return a.pixels.where(~F.col("scl").isin(0, 1, 3, 8, 9, 10, 11)).groupBy("cell").agg(F.count("*").alias("n"))


@query("f15_resume_check", "SELECT scene_id FROM scenes s WHERE NOT EXISTS (SELECT 1 FROM scenes d WHERE d.scene_id = s.scene_id AND d.scene_no % 3 = 0 AND d.size_bytes = s.size_bytes)")
def _(a):
    done = a.scenes.where("scene_no % 3 = 0").select("scene_id", "size_bytes")
    return a.scenes.join(done, ["scene_id", "size_bytes"], "left_anti").select("scene_id")


@query("f16_f17_f20_f24_presence", "SELECT e.entity_id, 10 * log10(p.vv) AS db FROM entities e JOIN (SELECT cell, max(vv) AS vv FROM pixels WHERE vv > 0 GROUP BY cell) p ON p.cell = e.vec_id WHERE e.first_seen IS NOT NULL")
def _(a):
    p = a.pixels.where("vv > 0").groupBy("cell").agg(F.max("vv").alias("vv"))
    return a.entities.where("first_seen IS NOT NULL").join(p, F.col("vec_id") == F.col("cell")).select("entity_id", S.decibels(F.col("vv")).alias("db"))


@query("f21_hint_match", "SELECT band_letter, scene_id FROM (SELECT *, row_number() OVER (PARTITION BY band_letter ORDER BY CASE WHEN contains(scene_id, '77') THEN 0 ELSE 1 END, scene_no) AS k FROM scenes) WHERE k = 1")
def _(a):
    order = F.struct(F.when(F.contains("scene_id", F.lit("77")), 0).otherwise(1), F.col("scene_no"))
    return a.scenes.groupBy("band_letter").agg(F.min_by("scene_id", order).alias("scene_id"))


@query("f23_ttl", "SELECT cell_id, max(ts) AS last_access FROM trajectory GROUP BY cell_id HAVING max(ts) >= timestamp '2024-01-30 12:00:00' - interval 24 hours")
def _(a):
    return a.trajectory.groupBy("cell_id").agg(F.max("ts").alias("last_access")).where("last_access >= timestamp_ntz'2024-01-30 12:00:00' - interval 24 hours")


@query(
    "p01_p03_result_rows",
    """SELECT entity_id, lat AS centroid_lat, lon AS centroid_lon, coalesce(change_confidence, 0.85) AS change_confidence, coalesce(river_distance_m, 500.0) AS river_distance_m,
  coalesce(valid_fraction, 0.95) AS valid_fraction, coalesce(registration_residual_px, 0.21) AS residual_px, coalesce(optical_z, 4.2) AS optical_z,
  coalesce(sar_z, CASE WHEN has_sar THEN 3.8 ELSE 0.5 END) AS sar_z FROM entities""",
)
def _(a):
    from geoloom.plans.dsl import with_defaults

    e = with_defaults(a.entities).withColumn("centroid", F.struct("lat", "lon"))
    return e.select("entity_id", F.col("centroid.lat").alias("centroid_lat"), F.col("centroid.lon").alias("centroid_lon"), "change_confidence", "river_distance_m", "valid_fraction", F.col("registration_residual_px").alias("residual_px"), "optical_z", "sar_z")


@query("p02_payload", "SELECT entity_id, entity_type, strftime(coalesce(first_seen, last_seen), '%Y-%m-%d') AS observed FROM entities")
def _(a):
    return a.entities.select("entity_id", "entity_type", F.date_format(F.coalesce("first_seen", "last_seen"), "yyyy-MM-dd").alias("observed"))


@query(
    "p04_k07_geojson",
    """SELECT entity_id, '{"type":"Feature","properties":{"entity_id":"' || entity_id || '","entity_type":"' || entity_type || '"},"geometry":{"type":"Point","coordinates":['
  || printf('%.4f', lon) || ',' || printf('%.4f', lat) || ']}}' AS feature FROM entities""",
)
def _(a):
    from geoloom.sources.sinks import geojson_feature

    return a.entities.select("entity_id", geojson_feature().alias("feature"))


@query("p05_timeline_points", "SELECT cell_id, seq, strftime(obs_date, '%Y-%m-%d') AS day, round(z + 1e-7, 3) AS z, round(ndvi, 2) AS ndvi, round(valid_fraction * 100, 1) AS valid_pct FROM trajectory")
def _(a):
    return a.trajectory.select("cell_id", "seq", F.date_format("obs_date", "yyyy-MM-dd").alias("day"), F.round(F.col("z") + 1e-7, 3).alias("z"), F.round("ndvi", 2).alias("ndvi"), F.round(F.col("valid_fraction") * 100, 1).alias("valid_pct"))


GATE_SQL = """SELECT entity_id, coalesce(valid_fraction >= 0.8, false) AS g1, coalesce(registration_residual_px <= 0.5, false) AS g2, radiometric_ok AS g3,
  coalesce(optical_z >= 2.0, false) AS g4, coalesce(sar_z >= 2.0, false) AS g5 FROM entities"""


@query("p06_m07_gates", f"SELECT entity_id, g1, g2, g3, g4, g5, (g1::INT + g2::INT + g3::INT + g4::INT + g5::INT) AS gates_passed, g1 AND g2 AND g3 AND g4 AND g5 AS verified FROM ({GATE_SQL})")
def _(a):
    e = a.entities.withColumn("g", S.gates(*(F.col(c) for c in ("valid_fraction", "registration_residual_px", "radiometric_ok", "optical_z", "sar_z"))))
    return e.select("entity_id", *(F.get("g", F.lit(i)).passed.alias(f"g{i + 1}") for i in range(5)), F.size(F.filter("g", lambda x: x.passed)).alias("gates_passed"), F.forall("g", lambda x: x.passed).alias("verified"))


@query("p08_chip_windows", """SELECT scene_id, r * 128 AS row_off, c * 128 AS col_off FROM scenes, (SELECT unnest(range(0, 4)) AS r), (SELECT unnest(range(0, 3)) AS c)""")
def _(a):
    from geoloom.operators.selection import chip_windows

    return chip_windows(a.scenes.select("scene_id"), 640, 512, 256, 128).select("scene_id", "row_off", "col_off")


@query(
    "p09_c07_c08_descriptions",
    """SELECT entity_id, upper(substr(replace(entity_type, '_', ' '), 1, 1)) || substr(replace(entity_type, '_', ' '), 2) || ', ' || CASE WHEN area_m2 > 5000 THEN 'large' WHEN area_m2 > 1000 THEN 'medium' ELSE 'small' END
  || CASE WHEN ndvi_delta < -0.15 THEN ', loss of vegetation' WHEN ndvi_delta > 0.15 THEN ', gain of vegetation' ELSE '' END || printf(', z = %.2f', coalesce(optical_z, 0.0)) AS description FROM entities""",
)
def _(a):
    words = F.replace("entity_type", F.lit("_"), F.lit(" "))
    size = F.when(F.col("area_m2") > 5000, "large").when(F.col("area_m2") > 1000, "medium").otherwise("small")
    plants = F.when(F.col("ndvi_delta") < -0.15, ", loss of vegetation").when(F.col("ndvi_delta") > 0.15, ", gain of vegetation").otherwise("")
    first = F.concat(F.upper(F.substring(words, 1, 1)), F.substring(words, 2, 100))
    return a.entities.select("entity_id", F.concat(first, F.lit(", "), size, plants, F.format_string(", z = %.2f", F.coalesce("optical_z", F.lit(0.0)))).alias("description"))


@query("p10_w13_stable_ids", "SELECT entity_id, upper(substr(entity_type, 1, 4)) || '_' || lpad(cast(row_number() OVER (PARTITION BY entity_type ORDER BY entity_id) AS VARCHAR), 6, '0') AS stable_id FROM entities")
def _(a):
    from geoloom.operators.selection import stable_ids

    return stable_ids(a.entities, "entity_type", "entity_id").select("entity_id", "stable_id")


@query(
    "p12_crop_windows",
    """SELECT entity_id, greatest(0, floor((lon - 77.1) * 9800 - sqrt(area_m2) / 20))::BIGINT AS col_from, least(2491, ceil((lon - 77.1) * 9800 + sqrt(area_m2) / 20))::BIGINT AS col_to,
  greatest(0, floor((28.72 - lat) * 11100 - sqrt(area_m2) / 20))::BIGINT AS row_from, least(2485, ceil((28.72 - lat) * 11100 + sqrt(area_m2) / 20))::BIGINT AS row_to FROM entities""",
)
def _(a):
    half, x, y = F.sqrt("area_m2") / 20, (F.col("lon") - 77.1) * 9800, (28.72 - F.col("lat")) * 11100
    low = lambda v: F.greatest(F.lit(0).cast("long"), F.floor(v - half))
    high = lambda v, n: F.least(F.lit(n).cast("long"), F.ceil(v + half))
    return a.entities.select("entity_id", low(x).alias("col_from"), high(x, 2491).alias("col_to"), low(y).alias("row_from"), high(y, 2485).alias("row_to"))


def _words(words, otherwise):
    parts = [f"WHEN {' OR '.join(f'''contains(q, '{w}')''' for w in ws)} THEN '{name}'" for name, ws in words.items()]
    return f"CASE {' '.join(parts)} ELSE {otherwise} END"


@query(
    "c01_c03_parse_questions",
    f"""WITH p AS (SELECT conv_id, turn, lower(question) AS q, regexp_extract_all(question, '20\\d{{2}}') AS y FROM questions)
SELECT conv_id, turn, {_words(S.ENTITY_WORDS, "'building'")} AS entity_type, {_words(S.RELATION_WORDS, "NULL")} AS relation,
  coalesce(nullif(regexp_extract(q, '(\\d+)\\s*(?:m|meters|meter)', 1), '')::DOUBLE, 500.0) AS distance_m, {_words(S.CHANGE_WORDS, "'construction'")} AS change_type,
  CASE WHEN len(y) >= 1 THEN y[1] || '-01-01' ELSE '2024-01-01' END AS from_date, CASE WHEN len(y) >= 2 THEN y[2] || '-12-31' WHEN len(y) = 1 THEN y[1] || '-12-31' ELSE '2025-12-31' END AS to_date FROM p""",
)
def _(a):
    return a.questions.select("conv_id", "turn", *(c.alias(n) for n, c in S.parsed_question(F.col("question")).items()))


@query("c04_c05_date_parts", "SELECT scene_id, strftime(scene_date, '%Y-%m') AS month, year(scene_date) || '-Q' || quarter(scene_date) AS quarter, strftime(scene_date, '%b %Y') AS label FROM scenes")
def _(a):
    d = F.col("scene_date")
    return a.scenes.select("scene_id", F.date_format(d, "yyyy-MM").alias("month"), F.concat(F.year(d).cast("string"), F.lit("-Q"), F.quarter(d).cast("string")).alias("quarter"), F.date_format(d, "MMM yyyy").alias("label"))


@query("c06_c09_c13_strings", """SELECT scene_id, string_split(assets, ',')[1] AS first_asset, utm_zone || band_letter || square AS mgrs,
  'POINT(' || printf('%.3f', aoi_coverage) || ' ' || printf('%.3f', valid_fraction) || ')' AS wkt FROM scenes""")
def _(a):
    return a.scenes.select("scene_id", F.split("assets", ",")[0].alias("first_asset"), F.concat(F.col("utm_zone").cast("string"), "band_letter", "square").alias("mgrs"), F.format_string("POINT(%.3f %.3f)", "aoi_coverage", "valid_fraction").alias("wkt"))


@query("c10_c12_digests", "SELECT log_id, sha256(actor || '|' || action || '|' || payload) AS digest, base64(encode(payload)) AS encoded, substr(sha256(entity_id), 1, 32) AS point_key FROM audit")
def _(a):
    return a.audit.select("log_id", F.sha2(F.concat_ws("|", "actor", "action", "payload"), 256).alias("digest"), F.base64(F.col("payload").cast("binary")).alias("encoded"), F.substring(F.sha2("entity_id", 256), 1, 32).alias("point_key"))


@query("d01_d05_date_math", """SELECT entity_id, dayofyear(first_seen) AS doy, round(year(first_seen) - 2024 + dayofyear(first_seen) / 365.25::DOUBLE, 6) AS year_frac, abs(date_diff('day', first_seen, last_seen)) AS days,
  len(generate_series(date_trunc('month', first_seen)::DATE, date_trunc('month', last_seen)::DATE, interval 1 month)) AS months FROM entities WHERE first_seen <= last_seen""")
def _(a):
    f, last = F.col("first_seen"), F.col("last_seen")
    months = F.size(F.sequence(F.trunc(f, "MM"), F.trunc(last, "MM"), F.expr("interval 1 month")))
    return a.entities.where("first_seen <= last_seen").select("entity_id", F.dayofyear(f).alias("doy"), F.round(F.year(f) - 2024 + F.dayofyear(f) / F.lit(365.25), 6).alias("year_frac"), F.abs(F.datediff(last, f)).alias("days"), months.alias("months"))


@query("m01_harmonic_basis", """SELECT entity_id, round(cos(2 * pi() * d), 6) AS c1, round(sin(2 * pi() * d), 6) AS s1, round(cos(4 * pi() * d), 6) AS c2, round(sin(4 * pi() * d), 6) AS s2
  FROM (SELECT entity_id, dayofyear(first_seen) / 365.25::DOUBLE AS d FROM entities WHERE first_seen IS NOT NULL)""")
def _(a):
    b = a.entities.where("first_seen IS NOT NULL").select("entity_id", S.harmonic_basis(F.col("first_seen")).alias("b"))
    return b.select("entity_id", *(F.round(F.get("b", F.lit(i + 2)), 6).alias(n) for i, n in enumerate(("c1", "s1", "c2", "s2"))))


FUSE_SQL = """SELECT entity_id, coalesce(optical_z, 0) AS zo, coalesce(sar_z, 0) AS zs, CASE WHEN coalesce(optical_z, 0) >= 2 AND coalesce(sar_z, 0) >= 2 THEN 1.0 WHEN coalesce(optical_z, 0) >= 2 AND cloud_context > 0.3 THEN -0.5
  WHEN coalesce(optical_z, 0) >= 2 THEN 0.0 WHEN coalesce(sar_z, 0) >= 2 THEN 0.3 ELSE 0.0 END::DOUBLE AS agreement,
  CASE WHEN coalesce(optical_z, 0) >= 2 AND coalesce(sar_z, 0) >= 2 THEN 'structural' WHEN coalesce(optical_z, 0) >= 2 AND cloud_context > 0.3 THEN 'cloud_artifact_suspected'
  WHEN coalesce(optical_z, 0) >= 2 THEN 'surface_phenological' WHEN coalesce(sar_z, 0) >= 2 THEN 'structural_under_cloud' ELSE 'unconfirmed' END AS change_class FROM entities"""


@query("m02_m06_sensor_fusion", f"SELECT entity_id, agreement, change_class, round(1 / (1 + exp(-greatest(-20, least(20, 0.45 * zo + 0.35 * zs + 0.2 * agreement * 3 - 2)))), 6) AS fused FROM ({FUSE_SQL})")
def _(a):
    zo, zs = F.coalesce("optical_z", F.lit(0.0)), F.coalesce("sar_z", F.lit(0.0))
    e = a.entities.select("entity_id", zo.alias("zo"), zs.alias("zs"), S.agreement(zo, zs, F.col("cloud_context")).alias("a"))
    return e.select("entity_id", "a.agreement", "a.change_class", F.round(S.fused_score(F.col("zo"), F.col("zs"), F.col("a.agreement")), 6).alias("fused"))


@query("m03_m05_ranking", """SELECT entity_id, round(0.3 * coalesce(change_confidence, 0.85) + 0.2 * class_confidence + 0.25 * greatest(0, least(1, 1 - coalesce(river_distance_m, 500.0) / 1000)) + 0.15 * class_confidence + 0.1 * coalesce(valid_fraction, 0.95) + 1e-9, 4) AS score FROM entities""")
def _(a):
    c = F.col("class_confidence")
    score = S.ranking_score(F.coalesce("change_confidence", F.lit(0.85)), c, S.spatial_relevance(F.col("river_distance_m")), c, F.coalesce("valid_fraction", F.lit(0.95)))
    return a.entities.select("entity_id", F.round(score + 1e-9, 4).alias("score"))


def _nd(x, y):
    return f"round(CASE WHEN abs({x} + {y}) >= 1e-6 THEN ({x} - ({y})) / ({x} + {y}) END, 6)"


@query("m08_m09_indices", f"""SELECT l_orderkey, l_linenumber, {_nd("nir", "red")} AS ndvi, {_nd("swir", "nir")} AS ndbi, {_nd("green", "nir")} AS ndwi,
  round(CASE WHEN abs(swir + red + nir + blue) >= 1e-6 THEN (swir + red - (nir + blue)) / (swir + red + nir + blue) END, 6) AS bsi,
  round(10 * log10(vv), 6) AS vv_db, round(CASE WHEN vh > 0 THEN 10 * log10(vh) END - 10 * log10(vv), 6) AS ratio_db FROM pixels""")
def _(a):
    c = F.col
    cols = {"ndvi": S.ndvi(c("red"), c("nir")), "ndbi": S.ndbi(c("swir"), c("nir")), "ndwi": S.ndwi(c("green"), c("nir")), "bsi": S.bare_soil(c("blue"), c("red"), c("nir"), c("swir")), "vv_db": S.decibels(c("vv")), "ratio_db": S.decibels(c("vh")) - S.decibels(c("vv"))}
    return a.pixels.select("l_orderkey", "l_linenumber", *(F.round(v, 6).alias(k) for k, v in cols.items()))


@query("m10_m12_geometry_math", """SELECT ref_id, round(sqrt((x2 - x1) * (x2 - x1) + (y2 - y1) * (y2 - y1)), 9) AS length_deg, round(((degrees(atan2(y2 - y1, x2 - x1)) % 180) + 180) % 180, 6) AS orientation,
  floor(x1 * 1000 / 10) * 10 AS snapped, round(6371.0088 * 6371.0088 * abs(radians(x2) - radians(x1)) * abs(sin(radians(y2)) - sin(radians(y1))), 6) AS km2 FROM segments""")
def _(a):
    c, dx, dy = F.col, F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1")
    return a.segments.select("ref_id", F.round(F.hypot(dx, dy), 9).alias("length_deg"), F.round(F.pmod(F.degrees(F.atan2(dy, dx)), F.lit(180.0)), 6).alias("orientation"), (F.floor(c("x1") * 1000 / 10) * 10).cast("double").alias("snapped"), F.round(S.rectangle_km2(c("x1"), c("y1"), c("x2"), c("y2")), 6).alias("km2"))


@query("m14_change_rules", """SELECT entity_id, CASE WHEN is_linear THEN 'road_development' WHEN sar_delta_db > 2.5 AND ndvi_delta < -0.15 THEN 'construction' WHEN sar_delta_db < -2.0 AND ndvi_delta < -0.20 THEN 'clearance'
  WHEN abs(ndvi_delta) > 0.35 AND abs(sar_delta_db) < 1.0 THEN 'water_variation' WHEN sar_delta_db > 1.0 THEN 'expansion' ELSE 'construction' END AS kind FROM entities""")
def _(a):
    return a.entities.select("entity_id", S.change_kind(F.col("is_linear"), F.col("ndvi_delta"), F.col("sar_delta_db")).alias("kind"))


@query("js1_js2_json", """SELECT log_id, '{"action":"' || action || '","actor":"' || actor || '","entity_id":"' || entity_id || '"}' AS canonical, (log_id * 3 % 1000)::INT AS k FROM audit""")
def _(a):
    return a.audit.select("log_id", F.to_json(F.struct("action", "actor", "entity_id")).alias("canonical"), F.get_json_object("payload", "$.k").cast("int").alias("k"))
