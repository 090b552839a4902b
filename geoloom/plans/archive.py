"""Vectors, trajectories, discovery, search, evaluation and the ledger (T01, V, W04-W11, Q, A13-A15, K)."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from geoloom.operators import aggregates as A
from geoloom.operators import discovery, evaluate, temporal, vectors
from geoloom.plans.dsl import Plan, execute
from geoloom.plans.registry import query
from geoloom.plans.sets import DIST
from geoloom.sources import sinks

COS = "round(list_dot_product(v.embedding::DOUBLE[], q.embedding::DOUBLE[]) / ((sqrt(list_dot_product(v.embedding::DOUBLE[], v.embedding::DOUBLE[])) + 1e-7) * (sqrt(list_dot_product(q.embedding::DOUBLE[], q.embedding::DOUBLE[])) + 1e-7)), 9)"


def _query_vector(a, vec_id=7):
    return a.vectors.where(F.col("vec_id") == vec_id).select(F.col("embedding").alias("q"))


@query("t01_v02_knn", f"SELECT v.entity_id, round(greatest(0, least(1, ({COS} + 1) / 2)), 6) AS score FROM vectors v, vectors q WHERE q.vec_id = 7 ORDER BY {COS} DESC, v.entity_id LIMIT 20")
def _(a):
    return vectors.top_k(a.vectors.select("entity_id", "embedding"), _query_vector(a), 20).select("entity_id", F.round(vectors.rescaled(F.col("cosine")), 6).alias("score"))


@query("t01_f07_filtered_knn", f"SELECT v.entity_id, round({COS}, 6) AS cosine FROM vectors v JOIN entities e USING (entity_id), vectors q WHERE q.vec_id = 3 AND v.vec_id <> 3 AND e.entity_type = 'road' ORDER BY {COS} DESC, v.entity_id LIMIT 10")
def _(a):
    roads = a.entities.where("entity_type = 'road' AND vec_id <> 3").select("entity_id")
    hits = vectors.top_k(a.vectors.join(roads, "entity_id", "left_semi").select("entity_id", "embedding"), _query_vector(a, 3), 10)
    return hits.select("entity_id", F.round("cosine", 6).alias("cosine"))


@query("s16_vector_lookup", "SELECT entity_id, round(list_sum(embedding::DOUBLE[]), 6) AS total, len(embedding) AS dims FROM vectors WHERE vec_id = 11")
def _(a):
    return a.vectors.where("vec_id = 11").select("entity_id", F.round(F.aggregate(vectors.doubles("embedding"), F.lit(0.0), lambda s, x: s + x), 6).alias("total"), F.size("embedding").alias("dims"))


@query("v01_normalized", "SELECT entity_id, round(list_sum(list_transform(embedding::DOUBLE[], lambda x: x / (sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[])) + 1e-7))), 6) AS total FROM vectors")
def _(a):
    return a.vectors.select("entity_id", F.round(F.aggregate(vectors.normalized("embedding"), F.lit(0.0), lambda s, x: s + x), 6).alias("total"))


MEAN = "(SELECT list(m ORDER BY i) AS q FROM (SELECT i, avg(x) AS m FROM (SELECT unnest(embedding::DOUBLE[]) AS x, unnest(range(len(embedding))) AS i FROM vectors WHERE {w}) GROUP BY i))"
COSQ = "round(list_dot_product(v.embedding::DOUBLE[], s.q) / ((sqrt(list_dot_product(v.embedding::DOUBLE[], v.embedding::DOUBLE[])) + 1e-7) * (sqrt(list_dot_product(s.q, s.q)) + 1e-7)), 9)"


@query("v03_a13_similar_sites", f"SELECT v.entity_id, round({COSQ}, 6) AS cosine FROM vectors v, {MEAN.format(w='vec_id < 5')} s WHERE v.vec_id >= 5 ORDER BY {COSQ} DESC, v.entity_id LIMIT 15")
def _(a):
    seeds = vectors.mean_vector(a.vectors.where("vec_id < 5")).withColumnRenamed("mean", "q")
    return vectors.top_k(a.vectors.where("vec_id >= 5").select("entity_id", "embedding"), seeds, 15).select("entity_id", F.round("cosine", 6).alias("cosine"))


@query("v04_rocchio", f"""WITH p AS (SELECT q AS p FROM {MEAN.format(w='label = 1')}), n AS (SELECT q AS n FROM {MEAN.format(w='label = 2')}), x AS (SELECT list_transform(range(1, len(embedding) + 1), lambda i: embedding[i]::DOUBLE + 0.75::DOUBLE * p[i] - 0.25::DOUBLE * n[i]) AS q FROM vectors, p, n WHERE vec_id = 7)
SELECT i AS pos, round(q[i + 1] / (sqrt(list_dot_product(q, q)) + 1e-7), 6) AS value FROM x, (SELECT unnest(range(64)) AS i)""")
def _(a):
    p = vectors.mean_vector(a.vectors.where("label = 1")).withColumnRenamed("mean", "p")
    n = vectors.mean_vector(a.vectors.where("label = 2")).withColumnRenamed("mean", "n")
    x = vectors.with_row(vectors.with_row(_query_vector(a), p), n)
    return x.select(F.posexplode(vectors.rocchio(F.col("q"), F.col("p"), F.col("n"))).alias("pos", "value")).select("pos", F.round("value", 6).alias("value"))


@query("v05_centred", f"SELECT v.entity_id, round(sqrt(list_sum(list_transform(range(1, len(v.embedding) + 1), lambda i: pow(v.embedding[i]::DOUBLE - s.q[i], 2)))), 6) AS residual FROM vectors v, {MEAN.format(w='true')} s")
def _(a):
    c = vectors.with_row(a.vectors.select("entity_id", "embedding"), vectors.mean_vector(a.vectors))
    return c.select("entity_id", F.round(vectors.norm(F.zip_with("embedding", "mean", lambda x, m: x.cast("double") - m)), 6).alias("residual"))


@query("v06_a14_pca", None)
def _(a):
    """Lengths of the projections on 8 principal components (signs are free; checked in tests)."""
    from pyspark.ml.feature import PCA
    from pyspark.ml.functions import array_to_vector, vector_to_array

    x = a.vectors.select("entity_id", array_to_vector(vectors.doubles("embedding")).alias("x"))
    model = PCA(k=8, inputCol="x", outputCol="y").fit(x)
    return model.transform(x).select("entity_id", F.round(vectors.norm(vector_to_array("y")), 6).alias("length"))


@query("a23_cosine_spread", f"SELECT v.label, round(max(round({COS}, 9)) - min(round({COS}, 9)), 6) AS spread FROM vectors v JOIN vectors q ON v.label = q.label AND v.vec_id <> q.vec_id WHERE q.vec_id % 100 = 0 GROUP BY v.label")
def _(a):
    """How far the cosines within a label spread: a stated set of queries against all vectors of their label."""
    return evaluate.spreads(a.vectors, F.col("vec_id") % 100 == 0).select(F.col("label").cast("int").alias("label"), F.round("spread", 6).alias("spread"))


# --- trajectories -------------------------------------------------------------------------------------------------------

LIVE = """i AS (SELECT *, row_number() OVER (PARTITION BY cell_id ORDER BY ts, seq) - 1 AS i FROM trajectory),
b AS (SELECT *, coalesce(max(CASE WHEN z <= 1.2 THEN i END) OVER (PARTITION BY cell_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) + 1, 0) AS start FROM i),
p AS (SELECT *, round(sum(z - 0.5) OVER w, 6) AS total FROM b WHERE valid_fraction >= 0.8 AND i >= 11 WINDOW w AS (PARTITION BY cell_id ORDER BY i)),
c AS (SELECT *, round(total - least(0, min(total) OVER (PARTITION BY cell_id ORDER BY i)), 6) AS cusum FROM p),
g AS (SELECT *, sum((cusum <= 4)::INT) OVER (PARTITION BY cell_id ORDER BY i) AS island FROM c),
r AS (SELECT *, sum((cusum > 4)::INT) OVER (PARTITION BY cell_id, island ORDER BY i) AS run FROM g)"""


@query("w05_cusum", f"WITH {LIVE} SELECT cell_id, i, cusum FROM c")
def _(a):
    rows = temporal.indexed(a.trajectory).where("valid_fraction >= 0.8 AND i >= 11")
    return temporal.cusum(rows).select("cell_id", "i", "cusum")


@query("w06_w07_w15_runs", f"WITH {LIVE} SELECT cell_id, i, run::BIGINT AS run FROM r WHERE run >= 3")
def _(a):
    rows = temporal.cusum(temporal.indexed(a.trajectory).where("valid_fraction >= 0.8 AND i >= 11"))
    return temporal.exceedance_runs(rows).where("run >= 3").select("cell_id", "i", "run")


@query("qt_w08_breaks", f"""WITH {LIVE}, d AS (SELECT cell_id, min(i) AS detected_at, arg_min(start, i) AS start FROM r WHERE run >= 3 GROUP BY cell_id)
SELECT d.cell_id, detected_at, u.obs_date AS estimate, l.obs_date AS lower, u.obs_date AS upper, greatest(1, date_diff('day', l.obs_date, u.obs_date)) AS interval_days
FROM d JOIN i u ON u.cell_id = d.cell_id AND u.i = d.start JOIN i l ON l.cell_id = d.cell_id AND l.i = greatest(0, d.start - 1)""")
def _(a):
    return temporal.breaks(a.trajectory)


@query("w04_w09_v07_rls_baseline", None)
def _(a):
    """The recursive baseline over two series per cell (checked against a sequential loop in tests)."""
    values = F.array(F.col("value") / 50, F.coalesce("ndvi", F.lit(0.0)))
    rows = temporal.indexed(a.trajectory).select("cell_id", "i", "obs_date", values.alias("values"), "valid_fraction")
    return temporal.baseline(rows, 2).select("cell_id", "i", "obs_state", F.round("z", 6).alias("z"), F.round("cusum", 6).alias("cusum"), "interval_days")


@query("w14_r06_box_filter", """SELECT a.cell, a.row_no, a.col_no, round(avg(b.m) + 1e-9, 6) AS mean, round(avg(b.m * b.m) - avg(b.m) * avg(b.m) + 1e-9, 6) AS variance FROM (SELECT cell, row_no, col_no, avg(vv) AS m FROM pixels GROUP BY ALL) a
 JOIN (SELECT cell, row_no, col_no, avg(vv) AS m FROM pixels GROUP BY ALL) b ON a.cell = b.cell AND abs(a.row_no - b.row_no) <= 2 AND abs(a.col_no - b.col_no) <= 2 GROUP BY ALL""")
def _(a):
    from geoloom.operators.raster import box_moments

    grid = a.pixels.groupBy("cell", "row_no", "col_no").agg(F.avg("vv").alias("m"))
    return box_moments(grid, "m", 2).select("cell", "row_no", "col_no", F.round(F.col("mean") + 1e-9, 6).alias("mean"), F.round(F.col("variance") + 1e-9, 6).alias("variance"))


@query("r05_histogram_match", """WITH t AS (SELECT scene_no, cloud_cover, rank() OVER (ORDER BY cloud_cover) AS k FROM scenes WHERE relative_orbit = 1), n AS (SELECT count(*) AS n FROM t),
d AS (SELECT valid_fraction AS v, row_number() OVER (ORDER BY valid_fraction, scene_no) AS k, count(*) OVER () AS n FROM scenes WHERE relative_orbit = 2)
SELECT t.scene_no, d.v AS matched FROM t, n JOIN d ON d.k = greatest(1, ceil(t.k * d.n / n.n::DOUBLE)::BIGINT)""")
def _(a):
    from geoloom.operators.raster import histogram_match

    s = a.scenes.where("relative_orbit = 1").select("scene_no", "cloud_cover")
    d = a.scenes.where("relative_orbit = 2").select("valid_fraction")
    return histogram_match(s, "cloud_cover", d, "valid_fraction").select("scene_no", "matched")


# --- search, discovery, evaluation --------------------------------------------------------------------------------------

PLAN = Plan(entity_type="building", relation="near_water", distance_m=1500.0, from_date="2024-01-01", to_date="2025-12-31", change_types=("construction", "expansion"), min_confidence=0.5, limit=20)
RANKED = f"""f AS (SELECT * FROM entities WHERE entity_type = 'building' AND change_type IN ('construction', 'expansion') AND change_confidence >= 0.5 AND first_seen BETWEEN date '2024-01-01' AND date '2025-12-31' AND river_distance_m <= 1500),
k AS (SELECT v.entity_id, {COS} AS cosine FROM vectors v JOIN f USING (entity_id), vectors q WHERE q.vec_id = 7 ORDER BY cosine DESC, v.entity_id LIMIT 100),
s AS (SELECT f.entity_id, cosine, coalesce(valid_fraction, 0.95) AS vf, coalesce(registration_residual_px, 0.21) AS rp, coalesce(optical_z, 4.2) AS zo, coalesce(sar_z, CASE WHEN has_sar THEN 3.8 ELSE 0.5 END) AS zs,
  round(0.3 * coalesce(change_confidence, 0.85) + 0.2 * greatest(0, least(1, (cosine + 1) / 2)) + 0.25 * greatest(0, least(1, 1 - coalesce(river_distance_m, 500.0) / 1000)) + 0.15 * greatest(0, least(1, cosine)) + 0.1 * coalesce(valid_fraction, 0.95), 4) AS final FROM f JOIN k USING (entity_id))"""


@query("qe_execute_plan", f"""WITH {RANKED} SELECT row_number() OVER (ORDER BY final DESC, cosine DESC, entity_id) AS rank, entity_id, final, ((vf >= 0.8)::INT + (rp <= 0.5)::INT + 1 + (zo >= 2)::INT + (zs >= 2)::INT) AS gates_passed,
 round(1 / (1 + exp(-(0.45 * zo + 0.35 * zs + 0.6 * CASE WHEN zo >= 2 AND zs >= 2 THEN 1 WHEN zo >= 2 THEN 0 WHEN zs >= 2 THEN 0.3 ELSE 0 END - 2))), 6) AS fused FROM s ORDER BY rank LIMIT 20""")
def _(a):
    return execute(a.entities, a.vectors, PLAN, _query_vector(a)).select("rank", "entity_id", "final", "gates_passed", "fused")


IN_REACH = RANKED.replace("AND river_distance_m <= 1500", f"AND entity_id IN (SELECT entity_id FROM {DIST} WHERE layer = 'ref_water' AND d <= 1500)")


@query("qe_spatial_search", f"""WITH {IN_REACH}, o AS (SELECT *, row_number() OVER (ORDER BY final DESC, cosine DESC, entity_id) AS rank, ((vf >= 0.8)::INT + (rp <= 0.5)::INT + 1 + (zo >= 2)::INT + (zs >= 2)::INT) AS gates_passed FROM s JOIN (SELECT entity_id, entity_type, change_type FROM entities) USING (entity_id))
SELECT rank, entity_id, final, gates_passed, CASE WHEN rank <= 5 THEN printf('%s: %s changed by %s, optical z = %.2f, %d of 5 gates', entity_id, entity_type, change_type, zo, gates_passed) END AS explanation FROM o WHERE rank <= 20""")
def _(a):
    """The same plan through the spatial join in place of cached distances."""
    return execute(a.entities, a.vectors, PLAN, _query_vector(a), a.segments).select("rank", "entity_id", "final", "gates_passed", "explanation")


@query("qe_stage_counts", "WITH f AS (SELECT * FROM entities WHERE entity_type = 'building'), g AS (SELECT * FROM f WHERE change_confidence >= 0.5), h AS (SELECT * FROM g WHERE river_distance_m <= 1500) SELECT (SELECT count(*) FROM entities) AS archive, (SELECT count(*) FROM f) AS by_type, (SELECT count(*) FROM g) AS by_confidence, (SELECT count(*) FROM h) AS by_distance")
def _(a):
    kind, sure, near = F.col("entity_type") == "building", F.col("change_confidence") >= 0.5, F.col("river_distance_m") <= 1500
    return a.entities.agg(F.count("*").alias("archive"), F.count_if(kind).alias("by_type"), F.count_if(kind & sure).alias("by_confidence"), F.count_if(kind & sure & near).alias("by_distance"))


@query("qc_graph_summary", "SELECT count(*) AS edges, count(DISTINCT r.entity_id) AS distinct_targets, min(abs(date_diff('day', l.first_seen, r.first_seen))) AS closest FROM entities l JOIN entities r ON l.entity_id < r.entity_id AND abs(date_diff('day', l.first_seen, r.first_seen)) <= 21")
def _(a):
    return discovery.graph_summary(a.entities, 21)


@query("qc_clusters", """WITH RECURSIVE d AS (SELECT first_seen AS d, count(*) AS n, min(entity_id) AS first FROM entities WHERE first_seen IS NOT NULL GROUP BY ALL),
r AS (SELECT d AS v, d AS u FROM d UNION SELECT r.v, d.d FROM r JOIN d ON abs(date_diff('day', r.u, d.d)) <= 1),
c AS (SELECT v, min(u) AS root FROM r GROUP BY v) SELECT min(first) AS component, sum(n)::BIGINT AS n FROM d JOIN c ON c.v = d.d GROUP BY root HAVING sum(n) > 1""")
def _(a):
    """Connected parts of the co-change graph of one day."""
    return discovery.co_change_clusters(a.entities, 1)


@query("a15_t08_ndcg", f"""WITH h AS (SELECT q.vec_id AS query_id, v.entity_id, (v.label = q.label)::INT * 3 AS rel, row_number() OVER (PARTITION BY q.vec_id ORDER BY {COS} DESC, v.entity_id) AS k FROM vectors q JOIN vectors v ON v.vec_id <> q.vec_id WHERE q.vec_id % 100 = 0),
d AS (SELECT query_id, sum((pow(2, rel) - 1) / log2(k + 1)) AS dcg FROM h WHERE k <= 10 GROUP BY query_id), i AS (SELECT query_id, rel, row_number() OVER (PARTITION BY query_id ORDER BY rel DESC) AS k FROM h), j AS (SELECT query_id, sum((pow(2, rel) - 1) / log2(k + 1)) AS idcg FROM i WHERE k <= 10 GROUP BY query_id)
SELECT query_id, round(CASE WHEN idcg > 0 THEN dcg / idcg ELSE 1 END, 6) AS ndcg FROM d JOIN j USING (query_id)""")
def _(a):
    return evaluate.ndcg(a.vectors, F.col("vec_id") % 100 == 0, 10).select("query_id", F.round("ndcg", 6).alias("ndcg"))


@query("a24_recall_at_k", f"""WITH h AS (SELECT q.vec_id AS query_id, v.label = q.label AS hit, row_number() OVER (PARTITION BY q.vec_id ORDER BY {COS} DESC, v.entity_id) AS k FROM vectors q JOIN vectors v ON v.vec_id <> q.vec_id WHERE q.vec_id % 100 = 0)
SELECT query_id, round(count(*) FILTER (hit AND k <= 50) / greatest(1, count(*) FILTER (hit))::DOUBLE, 6) AS recall, min(k) FILTER (hit) AS first_hit FROM h GROUP BY query_id""")
def _(a):
    return evaluate.recall(a.vectors, F.col("vec_id") % 100 == 0, 50).select("query_id", F.round("recall", 6).alias("recall"), "first_hit")


@query("f22_negative_controls", f"WITH {LIVE}, m AS (SELECT cell_id, max(cusum) AS cusum_max FROM c GROUP BY cell_id) SELECT cell_id, cusum_max, cusum_max <= 4 AS suppressed FROM m")
def _(a):
    rows = temporal.cusum(temporal.indexed(a.trajectory).where("valid_fraction >= 0.8 AND i >= 11"))
    return rows.groupBy("cell_id").agg(F.max("cusum").alias("cusum_max")).withColumn("suppressed", F.col("cusum_max") <= 4)


# --- sinks --------------------------------------------------------------------------------------------------------------


@query("k01_k02_keyed_merge", "SELECT entity_id, entity_type, CASE WHEN vec_id % 3 = 0 THEN 'updated' ELSE change_type END AS change_type FROM entities WHERE vec_id % 2 = 0 OR vec_id % 3 = 0")
def _(a):
    old = a.entities.where("vec_id % 2 = 0").select("entity_id", "entity_type", "change_type")
    new = a.entities.where("vec_id % 3 = 0").select("entity_id", "entity_type", F.lit("updated").alias("change_type"))
    return sinks.merged(old, new, "entity_id")


@query("k05_cached_columns", "SELECT e.entity_id, coalesce(n.m, e.river_distance_m) AS river_distance_m FROM entities e LEFT JOIN (SELECT cell, max(value) AS m FROM pixels GROUP BY cell) n ON n.cell = e.vec_id")
def _(a):
    near = a.pixels.groupBy(F.col("cell").alias("vec_id")).agg(F.max("value").alias("m"))
    return a.entities.join(near, "vec_id", "left").select("entity_id", F.coalesce("m", "river_distance_m").alias("river_distance_m"))


@query("k06_st4_insert_new", "SELECT log_id, actor FROM audit WHERE log_id % 5 = 0 AND log_id % 2 <> 0")
def _(a):
    return sinks.only_new(a.audit.where("log_id % 2 = 0"), a.audit.where("log_id % 5 = 0"), "log_id").select("log_id", "actor")


ENTRY = """sha256('{{"action":"' || action || '","actor":"' || n.actor || '","entity_id":"' || entity_id || '","log_id":' || log_id || ',"payload":"' || replace(payload, '"', chr(92) || '"') || '","prev_hash":"' || {} || '"}}')"""


@query("w11_w10_hash_chain", f"""WITH RECURSIVE n AS (SELECT *, row_number() OVER (PARTITION BY actor ORDER BY log_id) AS k FROM audit),
h AS (SELECT actor, k, {ENTRY.format("repeat('0', 64)")} AS hash FROM n WHERE k = 1 UNION ALL SELECT n.actor, n.k, {ENTRY.format("h.hash")} FROM h JOIN n ON n.actor = h.actor AND n.k = h.k + 1)
SELECT actor, count(*) AS entries, count(*) AS linked, count(*) AS intact, arg_max(hash, k) AS last_hash FROM h GROUP BY actor""")
def _(a):
    """A chain for each actor, then its verification: entries, links and hashes that hold, and the last hash."""
    ledger = sinks.chained(a.audit, chain="actor")
    last = ledger.groupBy("actor").agg(F.max_by("entry_hash", "log_id").alias("last_hash"))
    checked = sinks.verify_chain(ledger, "actor").groupBy("actor").agg(F.count("*").alias("entries"), F.count_if(F.col("linked")).alias("linked"), F.count_if(F.col("intact")).alias("intact"))
    return checked.join(last, "actor")


@query("f19_verdict_history", "SELECT entity_id, actor, action, log_id FROM audit WHERE entity_id = 'ENT_000007'")
def _(a):
    return a.audit.where("entity_id = 'ENT_000007'").select("entity_id", "actor", "action", "log_id")


@query("api_stats", "SELECT (SELECT count(*) FROM entities) AS entities, (SELECT count(*) FROM scenes) AS scenes, (SELECT count(DISTINCT cell_id) FROM trajectory) AS cells, (SELECT max(scene_date) FROM scenes) AS newest_scene")
def _(a):
    one = a.entities.agg(F.count("*").alias("entities"))
    one = vectors.with_row(one, a.scenes.agg(F.count("*").alias("scenes"), F.max("scene_date").alias("newest_scene")))
    return vectors.with_row(one, a.trajectory.agg(F.count_distinct("cell_id").alias("cells"))).select("entities", "scenes", "cells", "newest_scene")
