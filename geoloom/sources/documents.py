"""JSON documents with nested arrays, GeoJSON layers and catalogue items."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

CATALOGUE = "scene_id string, collection string, cloud_cover double, relative_orbit long"


def json_rows(spark: SparkSession, path: str, array: str, schema: str) -> DataFrame:
    """The elements of an array that each JSON document holds, with a given schema; one document a line."""
    docs = spark.read.schema(f"{array} array<struct<{schema}>>").json(path)
    return docs.select(F.explode(array).alias("x")).select("x.*")


def geojson_layer(spark: SparkSession, path: str, properties: str) -> DataFrame:
    """Features as their properties and geom, an array of lon/lat structs; features without geometry are left out."""
    feature = f"type: string, properties: struct<{properties}>, geometry: struct<type: string, coordinates: array<array<double>>>"
    docs = spark.read.schema(f"features array<struct<{feature}>>").json(path)
    f = docs.select(F.explode("features").alias("f"))
    geom = F.transform("f.geometry.coordinates", lambda p: F.struct(p[0].alias("lon"), p[1].alias("lat")))
    return f.where(F.size("f.geometry.coordinates") > 0).select("f.properties.*", geom.alias("geom"))


def scene_rows(spark: SparkSession, path: str) -> DataFrame:
    """Catalogue items as rows of scenes, with assets as a map of name to address; items without an id are left out."""
    item = "id string, collection string, properties struct<datetime: timestamp_ntz, `eo:cloud_cover`: double>, assets map<string, struct<href: string>>"
    found, p = spark.read.schema(item).json(path).where("id IS NOT NULL"), F.col("properties")
    assets = F.transform_values("assets", lambda _, asset: asset.href)
    return found.select(F.col("id").alias("scene_id"), "collection", p["datetime"].cast("date").alias("scene_date"), p["eo:cloud_cover"].alias("cloud_cover"), assets.alias("assets"))


def judgements(spark: SparkSession, path: str) -> DataFrame:
    """(query_id, entity_id, rel) of documents that hold a query and a map of entities to their relevance each."""
    docs = spark.read.schema("query_id string, relevance map<string, int>").json(path)
    return docs.select("query_id", F.explode("relevance").alias("entity_id", "rel"))


def catalogue(spark: SparkSession, path: str) -> DataFrame:
    """Landed catalogue items, a JSON object a line in any file under the folder, in the columns of CATALOGUE. Spark's reader
    splits the files and takes filters down to the items; an empty folder has no items."""
    return spark.read.schema(CATALOGUE).option("recursiveFileLookup", "true").json(path)
