"""Scalar column functions: spectral indices, decibels, sigmoid, gates, ranking, text rules."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values
WEIGHTS = {"change": 0.30, "semantic": 0.20, "spatial": 0.25, "visual": 0.15, "quality": 0.10}
W_OPTICAL, W_SAR, W_AGREEMENT, TAU = 0.45, 0.35, 0.20, 2.0
MIN_VALID, MAX_RESIDUAL = 0.80, 0.50
EARTH_M = 6371008.8


def clamp(x: Column, low: float = 0.0, high: float = 1.0) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), x))


def sigmoid(x: Column) -> Column:
    return 1 / (1 + F.exp(-clamp(x, -20.0, 20.0)))


def normalized_difference(a: Column, b: Column) -> Column:
    """(a - b) / (a + b); null where the sum is next to zero."""
    return F.when(F.abs(a + b) >= 1e-6, (a - b) / (a + b))


def ndvi(red: Column, nir: Column) -> Column:
    return normalized_difference(nir, red)


def ndbi(swir: Column, nir: Column) -> Column:
    return normalized_difference(swir, nir)


def ndwi(green: Column, nir: Column) -> Column:
    return normalized_difference(green, nir)


def bare_soil(blue: Column, red: Column, nir: Column, swir: Column) -> Column:
    return normalized_difference(swir + red, nir + blue)


def decibels(power: Column) -> Column:
    """10 log10 of a positive power; null for the rest, which stands for no data."""
    return F.when(power > 0, 10 * F.log10(power))


def gates(valid: Column, residual: Column, radiometric: Column, z_optical: Column, z_sar: Column) -> Column:
    """The five gates in order, each with its measure and limit; a null measure fails."""
    rows = [
        ("optical_validity", valid >= MIN_VALID, valid, MIN_VALID),
        ("registration", residual <= MAX_RESIDUAL, residual, MAX_RESIDUAL),
        ("radiometric", radiometric, radiometric.cast("double"), 1.0),
        ("optical_change", z_optical >= TAU, z_optical, TAU),
        ("sar_confirmation", z_sar >= TAU, z_sar, TAU),
    ]
    return F.array(*(F.struct(F.lit(n).alias("name"), F.coalesce(p, F.lit(False)).alias("passed"), m.cast("double").alias("metric"), F.lit(t).alias("threshold")) for n, p, m, t in rows))


def agreement(z_optical: Column, z_sar: Column, cloud: Column) -> Column:
    """struct(agreement, change_class) of two sensors."""
    optical, sar = z_optical >= TAU, z_sar >= TAU
    case = lambda a, c: F.struct(F.lit(a).alias("agreement"), F.lit(c).alias("change_class"))
    return (
        F.when(optical & sar, case(1.0, "structural"))
        .when(optical & (cloud > 0.30), case(-0.5, "cloud_artifact_suspected"))
        .when(optical, case(0.0, "surface_phenological"))
        .when(sar, case(0.3, "structural_under_cloud"))
        .otherwise(case(0.0, "unconfirmed"))
    )


def fused_score(z_optical: Column, z_sar: Column, agreed: Column) -> Column:
    return sigmoid(W_OPTICAL * z_optical + W_SAR * z_sar + W_AGREEMENT * agreed * 3.0 - 2.0)


def ranking_score(change: Column, semantic: Column, spatial: Column, visual: Column, quality: Column, weights: dict[str, float] | None = None) -> Column:
    parts = {"change": change, "semantic": semantic, "spatial": spatial, "visual": visual, "quality": quality}
    return sum((F.lit((weights or WEIGHTS)[k]) * v for k, v in parts.items()), F.lit(0.0))


def spatial_relevance(distance_m: Column) -> Column:
    """1 at the feature, 0 from one kilometre; an unknown distance counts as 500 m."""
    return clamp(1 - F.coalesce(distance_m, F.lit(500.0)) / 1000)


def change_kind(linear: Column, ndvi_delta: Column, sar_delta_db: Column) -> Column:
    return (
        F.when(linear, "road_development")
        .when((sar_delta_db > 2.5) & (ndvi_delta < -0.15), "construction")
        .when((sar_delta_db < -2.0) & (ndvi_delta < -0.20), "clearance")
        .when((F.abs(ndvi_delta) > 0.35) & (F.abs(sar_delta_db) < 1.0), "water_variation")
        .when(sar_delta_db > 1.0, "expansion")
        .otherwise("construction")
    )


def harmonic_basis(date: Column) -> Column:
    """[1, t, cos w, sin w, cos 2w, sin 2w] with t in years from 2024 and w the season's angle."""
    share = F.dayofyear(date) / F.lit(365.25)
    w = 2 * F.pi() * share
    return F.array(F.lit(1.0), F.year(date) - 2024 + share, F.cos(w), F.sin(w), F.cos(2 * w), F.sin(2 * w))


def rectangle_km2(west: Column, south: Column, east: Column, north: Column) -> Column:
    return (EARTH_M / 1000) ** 2 * F.abs(F.radians(east) - F.radians(west)) * F.abs(F.sin(F.radians(north)) - F.sin(F.radians(south)))


def human_bytes(n: Column) -> Column:
    out = F.format_string("%.1f TB", n / F.lit(2.0**40))
    for unit, size in (("GB", 2.0**30), ("MB", 2.0**20), ("KB", 2.0**10), ("B", 1.0)):
        out = F.when(n < size * 1024, F.format_string(f"%.1f {unit}", n / F.lit(size))).otherwise(out)
    return out


# --- text rules ---------------------------------------------------------------------------------------------------------

# Fixed values. In order; the first whose words occur wins.
ENTITY_WORDS = {
    "building": ("building", "structure", "compound"), "road": ("road", "highway"), "vegetation": ("vegetation", "crop", "forest"),
    "vehicle_cluster": ("vehicle", "convoy"), "water": ("water", "lake", "reservoir", "pond"),
}
RELATION_WORDS = {"near_water": ("river", "water", "yamuna"), "near_road": ("road", "highway")}
CHANGE_WORDS = {
    "clearance": ("clearance", "cleared", "demolished"), "expansion": ("expansion", "expanded", "extended"),
    "water_variation": ("flood", "water level"), "road_development": ("road development", "paved"),
}
DISTANCE = r"(\d+)\s*(?:m|meters|meter)"
YEAR = r"20\d{2}"
DEFAULT_DISTANCE_M, DEFAULT_FROM, DEFAULT_TO = 500.0, "2024-01-01", "2025-12-31"


def first_word_class(low: Column, rules: dict[str, tuple[str, ...]], otherwise: str | None) -> Column:
    out = F.lit(otherwise).cast("string")
    for name, words in reversed(rules.items()):
        hit = F.lit(False)
        for w in words:
            hit = hit | F.contains(low, F.lit(w))
        out = F.when(hit, F.lit(name)).otherwise(out)
    return out


def parsed_question(text: Column) -> dict[str, Column]:
    """The plan's fields of a question, as columns."""
    low, years = F.lower(text), F.regexp_extract_all(text, F.lit(YEAR), F.lit(0))
    first, n = F.get(years, F.lit(0)), F.size(years)
    distance = F.coalesce(F.nullif(F.regexp_extract(low, DISTANCE, 1), F.lit("")).cast("double"), F.lit(DEFAULT_DISTANCE_M))
    return {
        "entity_type": first_word_class(low, ENTITY_WORDS, "building"),
        "relation": first_word_class(low, RELATION_WORDS, None),
        "distance_m": distance,
        "change_type": first_word_class(low, CHANGE_WORDS, "construction"),
        "from_date": F.when(n >= 1, F.concat(first, F.lit("-01-01"))).otherwise(DEFAULT_FROM),
        "to_date": F.when(n >= 2, F.concat(F.get(years, F.lit(1)), F.lit("-12-31"))).when(n == 1, F.concat(first, F.lit("-12-31"))).otherwise(DEFAULT_TO),
    }


def elapsed_seconds(since: Column, until: Column | None = None) -> Column:
    """Whole seconds from a time to another, to now if that isn't given."""
    return F.unix_timestamp((until if until is not None else F.current_timestamp()).cast("timestamp")) - F.unix_timestamp(since.cast("timestamp"))


def wkt_polygon(ring: str) -> Column:
    """A ring of struct(x, y) as well-known text, six decimals."""
    corners = F.transform(ring, lambda p: F.format_string("%.6f %.6f", p.x, p.y))
    return F.concat(F.lit("POLYGON(("), F.array_join(corners, ", "), F.lit("))"))
