"""The query plan and its execution as one DataFrame: filter, nearest vectors, score, verify, rank, explain."""

from __future__ import annotations

import re
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from geoloom.functions import scalars as S
from geoloom.operators import geo, vectors

LAYERS = {"near_water": "ref_water", "near_road": "ref_roads", "near_rail": "ref_rail", "near_landuse": "ref_landuse"}
DISTANCES = {"near_water": "river_distance_m", "near_road": "road_distance_m"}
#: What an entity must have to be seen by a sensor; a plan that names both, or none, asks for nothing.
SENSORS = {"sentinel-1": "has_sar", "sentinel-2": "optical_z IS NOT NULL"}
DEFAULTS = {"change_confidence": 0.85, "river_distance_m": 500.0, "road_distance_m": 500.0, "valid_fraction": 0.95, "registration_residual_px": 0.21, "optical_z": 4.2}


@dataclass(frozen=True)
class Plan:
    entity_type: str | None = None
    semantic_query: str = ""
    relation: str | None = None
    distance_m: float = S.DEFAULT_DISTANCE_M
    target_layer: str | None = None
    from_date: str | None = None
    to_date: str | None = None
    change_types: tuple[str, ...] = ()
    min_confidence: float | None = None
    aoi: tuple[tuple[float, float], ...] = ()
    sensors: tuple[str, ...] = ()
    limit: int = 20
    on_empty: str = "none"  # or "all": an empty first stage then searches the whole archive
    attributes: tuple[tuple[str, object], ...] = ()  # (column, value) that entities must have
    time_field: str = "first_seen"  # the column that the window of dates is about
    relations: tuple[tuple[str, float], ...] = ()  # further (relation, metres), all of which must hold

    def __post_init__(self):
        if not 1 <= self.limit <= 100:
            raise ValueError("limit must lie between 1 and 100")
        for relation in (self.relation, *(r for r, _ in self.relations)):
            if relation is not None and relation not in LAYERS and relation != "within_aoi":
                raise ValueError(f"unknown relation {relation}")
        if self.time_field not in ("first_seen", "last_seen"):
            raise ValueError("time_field must be first_seen or last_seen")
        if not set(self.sensors) <= set(SENSORS):
            raise ValueError(f"unknown sensors {self.sensors}")
        if self.min_confidence is not None and not 0 <= self.min_confidence <= 1:
            raise ValueError("min_confidence must lie between 0 and 1")
        if self.on_empty not in ("none", "all"):
            raise ValueError("on_empty must be none or all")


def parse(text: str) -> Plan:
    """A plan from a question, by the rules of functions.scalars."""
    low, years = text.lower(), re.findall(S.YEAR, text)
    pick = lambda rules, otherwise: next((k for k, ws in rules.items() if any(w in low for w in ws)), otherwise)
    found, relation = re.search(S.DISTANCE, low), pick(S.RELATION_WORDS, None)
    return Plan(
        entity_type=pick(S.ENTITY_WORDS, "building"), semantic_query=text, relation=relation, distance_m=float(found[1]) if found else S.DEFAULT_DISTANCE_M,
        target_layer=LAYERS.get(relation), from_date=f"{years[0]}-01-01" if years else S.DEFAULT_FROM, to_date=f"{years[1 if len(years) > 1 else 0]}-12-31" if years else S.DEFAULT_TO,
        change_types=(pick(S.CHANGE_WORDS, "construction"),), min_confidence=0.60, sensors=("sentinel-2", "sentinel-1"), limit=20,
    )


def stage_order(plan: Plan) -> list[str]:
    """The heuristic order of stages, as an annotation; Catalyst orders the work itself."""
    from datetime import date

    if plan.from_date and plan.to_date and (date.fromisoformat(plan.to_date) - date.fromisoformat(plan.from_date)).days <= 180:
        return ["temporal", "spatial", "semantic"]
    if plan.relation and plan.distance_m <= 1000:
        return ["spatial", "temporal", "semantic"]
    return ["semantic", "spatial", "temporal"]


def predicates(plan: Plan) -> Column:
    """The plan's row predicates; null never passes."""
    c, parts = F.col, [F.lit(True)]
    if plan.entity_type:
        parts.append(c("entity_type") == plan.entity_type)
    if plan.change_types:
        parts.append(c("change_type").isin(*plan.change_types))
    if plan.min_confidence is not None:
        parts.append(c("change_confidence") >= plan.min_confidence)
    if plan.from_date and plan.to_date:
        parts.append(c(plan.time_field).between(F.lit(plan.from_date).cast("date"), F.lit(plan.to_date).cast("date")))
    if plan.aoi:
        parts.append(geo.in_polygon(c("lon"), c("lat"), list(plan.aoi)))
    if len(set(plan.sensors)) == 1:
        parts.append(F.expr(SENSORS[plan.sensors[0]]))
    parts += [c(name) == value for name, value in plan.attributes]
    out = parts[0]
    for p in parts[1:]:
        out = out & p
    return out


def related(entities: DataFrame, relation: str | None, distance_m: float, segments: DataFrame | None, layer: str | None = None) -> DataFrame:
    """The entities that lie near a feature of the relation's layer: by segments if they are given, by the distance kept with
    each entity otherwise. An area of interest is no layer."""
    layer = layer or LAYERS.get(relation or "")
    if layer and segments is not None:
        return geo.within_distance(entities, segments.where(F.col("layer") == layer), distance_m)
    if relation in DISTANCES:
        return entities.where(F.col(DISTANCES[relation]) <= distance_m)
    if relation in LAYERS:
        raise ValueError(f"{relation} takes the segments of {layer}")
    return entities


def stage_one(entities: DataFrame, plan: Plan, segments: DataFrame | None = None) -> DataFrame:
    """The entities that pass the predicates and lie near a feature of each relation's layer."""
    out = related(entities.where(predicates(plan)), plan.relation, plan.distance_m, segments, plan.target_layer)
    for relation, distance_m in plan.relations:
        out = related(out, relation, distance_m, segments)
    if plan.on_empty == "all":
        return out if not out.isEmpty() else entities
    return out


def with_defaults(df: DataFrame) -> DataFrame:
    out = df.withColumns({k: F.coalesce(k, F.lit(v)) for k, v in DEFAULTS.items()})
    return out.withColumn("sar_z", F.coalesce("sar_z", F.when(F.col("has_sar"), 3.8).otherwise(0.5)))


def execute(entities: DataFrame, vecs: DataFrame, plan: Plan, query: DataFrame, segments: DataFrame | None = None, k: int = 100, explain_top: int = 5, weights: dict[str, float] | None = None) -> DataFrame:
    """The plan's results in rank order. query: one row with the vector q. Vectors are narrowed to the first stage before
    they are compared, and explanations are made for the first explain_top ranks only. weights: of the ranking, the fixed ones
    if not given."""
    first = stage_one(entities, plan, segments)
    rows = with_defaults(vectors.top_k(first.join(vecs.select("entity_id", "embedding"), "entity_id"), query, k).drop("embedding"))
    c = F.col
    distance = c(DISTANCES.get(plan.relation or "near_water", "river_distance_m"))
    gates = S.gates(c("valid_fraction"), c("registration_residual_px"), F.lit(True), c("optical_z"), c("sar_z"))
    rows = rows.withColumns({"semantic": vectors.rescaled(c("cosine")), "gates": gates})
    rows = rows.withColumn("agreed", S.agreement(c("optical_z"), c("sar_z"), F.lit(0.05)))
    rows = rows.withColumn("fused", F.round(S.fused_score(c("optical_z"), c("sar_z"), c("agreed.agreement")), 6))
    score = S.ranking_score(c("change_confidence"), c("semantic"), S.spatial_relevance(distance), S.clamp(c("cosine")), c("valid_fraction"), weights)
    rows = rows.withColumn("final", F.round(score, 4)).orderBy(F.desc("final"), F.desc("cosine"), "entity_id").limit(plan.limit)
    rank = F.row_number().over(Window.orderBy(F.desc("final"), F.desc("cosine"), "entity_id"))  # of at most 100 rows
    passed = F.size(F.filter("gates", lambda g: g.passed))
    text = F.format_string("%s: %s changed by %s, optical z = %.2f, %d of 5 gates", "entity_id", "entity_type", "change_type", "optical_z", "gates_passed")
    out = rows.withColumns({"rank": rank, "gates_passed": passed, "change_class": c("agreed.change_class")})
    return out.withColumn("explanation", F.when(c("rank") <= explain_top, text))


def with_limit(plan: Plan, limit: int) -> Plan:
    return replace(plan, limit=limit)
