"""The archive's tables as views over the base tables.

Each view is one SELECT that Spark and DuckDB both run, so a query and its check read the same rows. Shares, scores and
places follow from keys by modular arithmetic; nothing is drawn at random, and every view grows with its base table.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession

#: view -> (base table, SELECT over {t})
VIEWS = {
    "entities": (
        "embeddings",
        """SELECT concat('ENT_', lpad(cast(vec_id AS string), 6, '0')) AS entity_id, vec_id,
  CASE label % 5 WHEN 0 THEN 'building' WHEN 1 THEN 'road' WHEN 2 THEN 'vegetation' WHEN 3 THEN 'water' ELSE 'vehicle_cluster' END AS entity_type,
  CASE vec_id % 4 WHEN 0 THEN 'construction' WHEN 1 THEN 'clearance' WHEN 2 THEN 'expansion' ELSE 'road_development' END AS change_type,
  CASE WHEN vec_id % 23 = 0 THEN NULL ELSE 0.30e0 + (vec_id * 37 % 70) / 100e0 END AS change_confidence,
  0.50e0 + (vec_id * 41 % 50) / 100e0 AS class_confidence,
  77.10e0 + (vec_id * 7919 % 2500) / 10000e0 AS lon, 28.50e0 + (vec_id * 104729 % 2200) / 10000e0 AS lat,
  CASE WHEN vec_id % 17 = 0 THEN NULL ELSE date '2024-01-01' + cast(vec_id * 13 % 730 AS int) END AS first_seen,
  date '2026-01-01' - cast(vec_id % 90 AS int) AS last_seen,
  CASE WHEN vec_id % 11 = 0 THEN NULL ELSE (vec_id * 29 % 80) / 10e0 END AS optical_z,
  CASE WHEN vec_id % 13 = 0 THEN NULL ELSE (vec_id * 31 % 60) / 10e0 END AS sar_z,
  CASE WHEN vec_id % 19 = 0 THEN NULL ELSE 0.70e0 + (vec_id * 11 % 31) / 100e0 END AS valid_fraction,
  CASE WHEN vec_id % 29 = 0 THEN NULL ELSE (vec_id * 23 % 80) / 100e0 END AS registration_residual_px,
  vec_id % 31 <> 0 AS radiometric_ok, vec_id % 2 = 0 AS has_sar,
  CASE WHEN vec_id % 5 = 0 THEN NULL ELSE (vec_id * 53 % 2000) * 1e0 END AS river_distance_m,
  CASE WHEN vec_id % 7 = 0 THEN NULL ELSE (vec_id * 59 % 1500) * 1e0 END AS road_distance_m,
  150e0 + (vec_id * 97 % 9000) AS area_m2, (vec_id * 3 % 40) / 100e0 AS cloud_context,
  ((vec_id * 7 % 81) - 40) / 100e0 AS ndvi_delta, ((vec_id * 17 % 81) - 40) / 10e0 AS sar_delta_db, vec_id % 6 = 0 AS is_linear,
  concat('SC_', cast(vec_id % 40 AS string)) AS scene_id, label FROM {t}""",
    ),
    "vectors": ("embeddings", "SELECT concat('ENT_', lpad(cast(vec_id AS string), 6, '0')) AS entity_id, vec_id, label, embedding FROM {t}"),
    "trajectory": (
        "events",
        """SELECT concat('CELL_', cast(user_id AS string)) AS cell_id, user_id AS cell_no, event_id AS seq, cast(ts AS date) AS obs_date, ts, value,
  round(value / 80e0, 6) AS z, 0.70e0 + (event_id * 7 % 31) / 100e0 AS valid_fraction,
  CASE WHEN event_type IN ('click', 'view', 'signup') THEN 'sentinel-2' ELSE 'sentinel-1' END AS sensor,
  CASE WHEN event_id % 9 = 0 THEN NULL ELSE ((event_id * 19 % 200) - 100) / 100e0 END AS ndvi FROM {t}""",
    ),
    "scenes": (
        "orders",
        """SELECT concat('S_', cast(o_orderkey AS string)) AS scene_id, o_orderkey AS scene_no, cast(o_orderdate AS date) AS scene_date,
  (o_orderkey * 17 % 1000) / 10e0 AS cloud_cover, (o_orderkey * 43 % 101) / 100e0 AS valid_fraction, o_custkey % 7 AS relative_orbit,
  (o_orderkey * 61 % 101) / 100e0 AS aoi_coverage, o_orderkey % 12 = 0 AS excluded_from_change,
  CASE WHEN o_orderkey % 10 = 0 THEN NULL ELSE (o_custkey % 60) + 1 END AS utm_zone, o_orderstatus AS band_letter, substr(o_orderpriority, 3, 2) AS square,
  CASE WHEN o_orderkey % 3 = 0 THEN 'red,nir' ELSE 'red,nir,swir,scl' END AS assets, o_totalprice AS size_bytes FROM {t}""",
    ),
    "segments": (
        "supplier",
        """SELECT concat(CASE WHEN s_suppkey % 2 = 0 THEN 'W_' ELSE 'R_' END, cast(s_suppkey AS string)) AS ref_id,
  CASE WHEN s_suppkey % 2 = 0 THEN 'ref_water' ELSE 'ref_roads' END AS layer, s_name AS name,
  77.10e0 + (s_suppkey * 6151 % 2500) / 10000e0 AS x1, 28.50e0 + (s_suppkey * 3571 % 2200) / 10000e0 AS y1,
  77.10e0 + (s_suppkey * 6151 % 2500) / 10000e0 + ((s_suppkey * 7 % 41) - 20) / 1000e0 AS x2,
  28.50e0 + (s_suppkey * 3571 % 2200) / 10000e0 + ((s_suppkey * 11 % 41) - 20) / 1000e0 AS y2 FROM {t}""",
    ),
    "pixels": (
        "lineitem",
        """SELECT l_suppkey AS cell, cast(l_orderkey % 64 AS int) AS row_no, cast(l_partkey % 64 AS int) AS col_no, l_orderkey, l_linenumber,
  l_quantity AS value, l_discount <= 0.08e0 AS is_valid, cast(l_orderkey * 7 % 12 AS int) AS scl, cast(l_partkey * 31 % 10000 AS double) AS red,
  cast(l_orderkey * 37 % 10000 AS double) AS nir, cast(l_suppkey * 41 % 10000 AS double) AS swir, cast(l_linenumber * 1009 % 10000 AS double) AS green,
  cast(l_partkey * 13 % 10000 AS double) AS blue, 0.001e0 + (l_partkey % 500) / 1000e0 AS vv, (l_orderkey % 300) / 1000e0 AS vh FROM {t}""",
    ),
    "questions": (
        "conversations",
        """SELECT conv_id, turn, concat(CASE conv_id % 6 WHEN 0 THEN 'New structures within ' WHEN 1 THEN 'Road paved near ' WHEN 2 THEN 'Forest cleared within '
  WHEN 3 THEN 'Convoy seen at ' WHEN 4 THEN 'Lake flood within ' ELSE 'Compound expanded ' END, cast(conv_id * 37 % 3000 AS string),
  CASE turn % 3 WHEN 0 THEN ' m of the river' WHEN 1 THEN ' meters of the highway' ELSE ' km away' END,
  CASE conv_id % 4 WHEN 0 THEN ' between 2023 and 2025' WHEN 1 THEN ' in 2024' ELSE '' END) AS question FROM {t}""",
    ),
    "audit": (
        "events",
        """SELECT event_id AS log_id, cast(user_id % 20 AS string) AS actor, event_type AS action, concat('ENT_', lpad(cast(user_id AS string), 6, '0')) AS entity_id,
  concat('{{"k":', cast(event_id * 3 % 1000 AS string), '}}') AS payload FROM {t}""",
    ),
}


class Archive:
    """The views over one folder of base tables."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def base(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    def view(self, name: str) -> DataFrame:
        base, sql = VIEWS[name]
        return self.spark.sql(sql, t=self.base(base))

    entities = cached_property(lambda self: self.view("entities"))
    vectors = cached_property(lambda self: self.view("vectors"))
    trajectory = cached_property(lambda self: self.view("trajectory"))
    scenes = cached_property(lambda self: self.view("scenes"))
    segments = cached_property(lambda self: self.view("segments"))
    pixels = cached_property(lambda self: self.view("pixels"))
    questions = cached_property(lambda self: self.view("questions"))
    audit = cached_property(lambda self: self.view("audit"))


def with_views(sql: str) -> str:
    """DuckDB SQL that may name the views."""
    ctes = ", ".join(f"{name} AS ({view.format(t=base)})" for name, (base, view) in VIEWS.items())
    body = sql.strip()
    if body[:15].upper() == "WITH RECURSIVE ":
        return f"WITH RECURSIVE {ctes}, {body[15:]}"
    return f"WITH {ctes}, {body[5:]}" if body[:5].upper() == "WITH " else f"WITH {ctes} {body}"
