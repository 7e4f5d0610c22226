"""GeoJSON readers with explicit schemas, and the routes file."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from meshwright.functions import geo, grid

_FEATURE = T.StructType([T.StructField("type", T.StringType()), T.StructField("properties", T.MapType(T.StringType(), T.StringType())), T.StructField("geometry", T.StructType([T.StructField("type", T.StringType()), T.StructField("coordinates", T.StringType())]))])
_DOCUMENT = T.StructType([T.StructField("type", T.StringType()), T.StructField("features", T.ArrayType(_FEATURE)), T.StructField("geometry", _FEATURE["geometry"].dataType), T.StructField("properties", _FEATURE["properties"].dataType), T.StructField("coordinates", T.StringType())])
_POINT, _LINE, _RINGS, _POLYGONS = "array<double>", "array<array<double>>", "array<array<array<double>>>", "array<array<array<array<double>>>>"


def features(spark: SparkSession, path: str) -> DataFrame:
    """(feature, kind, coordinates as JSON, props) of a FeatureCollection, a Feature or a bare geometry."""
    doc = spark.read.schema(_DOCUMENT).option("multiLine", True).json(path)
    single = F.array(F.struct(F.lit("Feature").alias("type"), F.col("properties"), F.coalesce("geometry", F.struct(F.col("type").alias("type"), F.col("coordinates").alias("coordinates"))).alias("geometry")))
    rows = doc.select(F.posexplode(F.when(F.col("type") == "FeatureCollection", F.col("features")).otherwise(single)).alias("feature", "f"))
    return rows.select("feature", F.col("f.geometry.type").alias("kind"), F.col("f.geometry.coordinates").alias("coordinates"), F.col("f.properties").alias("props"))


def _points(ring):
    return F.transform(ring, lambda p: F.struct(F.get(p, F.lit(0)).alias("lon"), F.get(p, F.lit(1)).alias("lat")))


def polygons(rows: DataFrame) -> DataFrame:
    """(feature, part, rings, props): every polygon of the features, multipolygons taken apart."""
    parts = F.when(F.col("kind") == "Polygon", F.array(F.from_json("coordinates", _RINGS))).when(F.col("kind") == "MultiPolygon", F.from_json("coordinates", _POLYGONS))
    split = rows.where("kind in ('Polygon', 'MultiPolygon')").select("feature", F.posexplode(parts).alias("part", "rings"), "props")
    return split.select("feature", "part", F.transform("rings", _points).alias("rings"), "props")


def load_boundary(spark: SparkSession, path: str) -> DataFrame:
    """(id, rings): the largest polygon of a boundary file; an error where there is none."""
    found = polygons(features(spark, path)).withColumn("area", geo.ring_area(F.get("rings", F.lit(0))))
    best = found.agg(F.max_by("rings", F.struct("area", (-F.col("feature")).alias("f"), (-F.col("part")).alias("p"))).alias("rings"))
    missing = F.when(F.col("rings").isNull(), F.raise_error(F.lit("the boundary holds no polygon")).cast("array<array<struct<lon:double,lat:double>>>")).otherwise(F.col("rings"))
    return best.select(F.lit(0).alias("id"), missing.alias("rings"))


def load_roads(spark: SparkSession, path: str) -> DataFrame:
    """(feature, part, seq, lon, lat, props): the vertices of all lines; other geometries are left out."""
    rows = features(spark, path)
    parts = F.when(F.col("kind") == "LineString", F.array(F.from_json("coordinates", _LINE))).when(F.col("kind") == "MultiLineString", F.from_json("coordinates", _RINGS))
    split = rows.where("kind in ('LineString', 'MultiLineString')").select("feature", F.posexplode(parts).alias("part", "points"), "props")
    return split.select("feature", "part", F.posexplode("points").alias("seq", "p"), "props").select("feature", "part", "seq", F.get("p", F.lit(0)).alias("lon"), F.get("p", F.lit(1)).alias("lat"), "props")


def _ring_sums(ring, x0, y0):
    """struct<a, x, y>: twice the area of a ring and its first moments, from an origin, whatever its direction."""
    n = F.size(ring)

    def term(i):
        p, q = F.get(ring, i), F.get(ring, F.pmod(i + 1, n))
        px, py, qx, qy = F.get(p, F.lit(0)) - x0, F.get(p, F.lit(1)) - y0, F.get(q, F.lit(0)) - x0, F.get(q, F.lit(1)) - y0
        cross = px * qy - qx * py
        return F.struct(cross.alias("a"), (cross * (px + qx)).alias("x"), (cross * (py + qy)).alias("y"))

    zero = F.struct(F.lit(0.0).alias("a"), F.lit(0.0).alias("x"), F.lit(0.0).alias("y"))
    add = lambda s, t: F.struct(*[(s[k] + t[k]).alias(k) for k in "axy"])
    signed = lambda s: F.struct(*[(F.when(s["a"] < 0, -s[k]).otherwise(s[k])).alias(k) for k in "axy"])
    return F.aggregate(F.transform(F.sequence(F.lit(0), n - 1), term), zero, add, signed)


def centroid(rows: DataFrame) -> DataFrame:
    """``rows`` (kind, coordinates) with lon and lat: a point, the middle of a line by length, or of a polygon by area, its holes taken off.

    Lines without length and polygons without area have the mean of their points.
    """
    rings = F.when(F.col("kind") == "Polygon", F.from_json("coordinates", _RINGS))
    line = F.when(F.col("kind") == "Point", F.array(F.from_json("coordinates", _POINT))).when(F.col("kind") == "LineString", F.from_json("coordinates", _LINE)).otherwise(F.get(rings, F.lit(0)))
    df = rows.withColumn("__line", line).withColumn("__rings", rings).where("__line is not null and size(__line) > 0")
    mean = lambda i: F.aggregate(F.transform("__line", lambda p: F.get(p, F.lit(i))), F.lit(0.0), lambda s, x: s + x) / F.size("__line")
    df = df.withColumn("__x0", F.get(F.get("__line", F.lit(0)), F.lit(0))).withColumn("__y0", F.get(F.get("__line", F.lit(0)), F.lit(1)))
    df = df.withColumn("__sums", F.transform(F.coalesce("__rings", F.array().cast(_RINGS)), lambda r: _ring_sums(r, F.col("__x0"), F.col("__y0"))))
    whole = lambda k: F.aggregate(F.transform("__sums", lambda t, i: F.when(i == 0, t[k]).otherwise(-t[k])), F.lit(0.0), lambda s, x: s + x)
    steps = F.transform(F.sequence(F.lit(1), F.greatest(F.size("__line") - 1, F.lit(1))), lambda i: F.struct(F.get("__line", i - 1).alias("p"), F.get("__line", i).alias("q")))
    df = df.withColumn("__steps", F.filter(steps, lambda s: s["q"].isNotNull()))
    away = lambda s: F.sqrt((F.get(s["q"], F.lit(0)) - F.get(s["p"], F.lit(0))) * (F.get(s["q"], F.lit(0)) - F.get(s["p"], F.lit(0))) + (F.get(s["q"], F.lit(1)) - F.get(s["p"], F.lit(1))) * (F.get(s["q"], F.lit(1)) - F.get(s["p"], F.lit(1))))
    total = lambda f: F.aggregate(F.transform("__steps", f), F.lit(0.0), lambda s, x: s + x)
    middle = lambda k: lambda s: away(s) * (F.get(s["p"], F.lit(k)) + F.get(s["q"], F.lit(k))) / 2
    df = df.withColumn("__area", whole("a")).withColumn("__length", total(away))
    for i, (name, k, origin) in enumerate((("lon", "x", "__x0"), ("lat", "y", "__y0"))):
        by_area = F.col(origin) + whole(k) / F.when(F.col("__area") > 0, 3 * F.col("__area")).otherwise(F.lit(1.0))
        by_length = total(middle(i)) / F.when(F.col("__length") > 0, F.col("__length")).otherwise(F.lit(1.0))
        df = df.withColumn(name, F.when((F.col("kind") == "Polygon") & (F.col("__area") > 0), by_area).when((F.col("kind") == "LineString") & (F.col("__length") > 0), by_length).otherwise(mean(i)))
    return df.drop("__line", "__rings", "__x0", "__y0", "__sums", "__steps", "__area", "__length")


def load_sites(spark: SparkSession, path: str, resolution: int) -> DataFrame:
    """(id, ord, name, lat, lon, priority, site_height_m, cell); other geometries by their centroid.

    Defaults: name Site_n, priority 999, height 0.
    """
    placed = centroid(features(spark, path))
    named = placed.select(F.col("feature").cast("long").alias("id"), F.col("feature").alias("ord"), F.coalesce(F.col("props")["name"], F.concat(F.lit("Site_"), F.col("feature"))).alias("name"), "lat", "lon", F.coalesce(F.col("props")["priority"].cast("int"), F.lit(999)).alias("priority"), F.coalesce(F.col("props")["site_height_m"].cast("double"), F.lit(0.0)).alias("site_height_m"))
    return named.withColumn("cell", grid.cell_of(F.col("lat"), F.col("lon"), resolution))


def load_cities(spark: SparkSession, path: str) -> DataFrame:
    """(id, name, rings) of city polygons."""
    return polygons(features(spark, path)).select(F.struct("feature", "part").alias("id"), F.col("props")["name"].alias("name"), "rings")


def load_towers(spark: SparkSession, path: str, resolution: int) -> DataFrame:
    """(cell, source, ord) of towers that stand already, from point features; their source is ``existing`` unless they have one."""
    rows = features(spark, path).where("kind = 'Point'").withColumn("p", F.from_json("coordinates", "array<double>"))
    at = grid.cell_of(F.element_at("p", 2), F.element_at("p", 1), resolution)
    return rows.select(at.alias("cell"), F.coalesce(F.col("props")["source"], F.lit("existing")).alias("source"), (F.col("feature") - F.lit(1_000_000_000)).cast("long").alias("ord"))


_END = "struct<name:string,lat:double,lon:double,site_height_m:double>"
_ROUTES = f"parameters map<string,string>, routes array<struct<route_id:string,site1:{_END},site2:{_END},max_towers_per_route:int,max_towers:int,features:array<struct<geometry:struct<type:string,coordinates:string>>>>>"


def load_routes(spark: SparkSession, path: str) -> DataFrame:
    """(ord, route_id, site1, site2, max_towers, features) of a routes file; either name of the tower limit is read."""
    doc = spark.read.schema(_ROUTES).option("multiLine", True).json(path)
    rows = doc.select(F.posexplode("routes").alias("ord", "r")).select("ord", "r.*")
    return rows.select("ord", "route_id", "site1", "site2", F.coalesce("max_towers_per_route", "max_towers").alias("max_towers"), "features")


def load_route_parameters(spark: SparkSession, path: str) -> dict[str, str]:
    """The parameters of a routes file."""
    found = spark.read.schema(_ROUTES).option("multiLine", True).json(path).select("parameters").first()
    return dict(found["parameters"] or {}) if found else {}
