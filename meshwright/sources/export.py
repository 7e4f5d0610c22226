"""Writers: towers, coverage, cells, edges and reports as GeoJSON features or JSON."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from meshwright.config import MeshConfig
from meshwright.functions import grid, physics

_RED, _YELLOW = ("peak_fallback", "endpoint_fallback"), "dp_repair"


def feature(geometry: Column, *properties: Column) -> Column:
    """A GeoJSON feature as JSON; null properties stay as null."""
    return F.to_json(F.struct(F.lit("Feature").alias("type"), geometry.alias("geometry"), F.struct(*properties).alias("properties")), {"ignoreNullFields": "false"})


def point(lat: Column, lon: Column) -> Column:
    return F.struct(F.lit("Point").alias("type"), F.array(lon, lat).alias("coordinates"))


def hexagon(cell: Column) -> Column:
    """The closed outline of a cell."""
    ring = F.transform(grid.boundary(cell), lambda p: F.array(p["lon"], p["lat"]))
    return F.struct(F.lit("Polygon").alias("type"), F.array(F.concat(ring, F.slice(ring, 1, 1))).alias("coordinates"))


def finite(x: Column) -> Column:
    """Infinite and not-a-number values as null."""
    return F.when(~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))), x)


def _or_null(df: DataFrame, name: str, kind: str) -> Column:
    """A column that a table may lack."""
    return F.col(name) if name in df.columns else F.lit(None).cast(kind)


def tower_algorithm(towers: DataFrame) -> Column:
    """How a tower was placed; a site's own tower is of kind ``site``."""
    return F.coalesce(_or_null(towers, "algorithm", "string"), F.when(_or_null(towers, "source", "string") == "site", "site"))


def tower_features(towers: DataFrame, cells: DataFrame, mast_m: float) -> DataFrame:
    """(feature): towers (id, cell, lat, lon, source[, algorithm, dp_steps, repair_round, city_link, coverage_radius_m, route])
    with their cell's centre, elevation and antenna height; what is not known is null, or false and 0 for link data."""
    place = cells.select(F.col("cell").alias("__c"), F.col("elevation").alias("__elevation"), _or_null(cells, "offset_m", "double").alias("__offset"))
    joined = towers.join(place, F.col("cell") == F.col("__c"), "left")
    known = F.col("__c").isNotNull()
    own = [
        F.col("id").alias("tower_id"),
        F.col("cell").alias("h3_index"),
        F.col("source"),
        F.coalesce(_or_null(towers, "route", "string").cast("string"), F.col("source")).alias("route_id"),
        (F.col("source") == "site").alias("virtual"),
        F.coalesce(_or_null(towers, "city_link", "boolean"), F.lit(False)).alias("city_link"),
        F.coalesce(_or_null(towers, "coverage_radius_m", "double"), F.lit(0.0)).alias("coverage_radius_m"),
        F.col("lat"),
        F.col("lon"),
        F.when(known, grid.lat_of(F.col("cell"))).alias("centroid_lat"),
        F.when(known, grid.lon_of(F.col("cell"))).alias("centroid_lon"),
        finite(F.col("__elevation")).alias("elevation_m"),
        (F.lit(mast_m) + F.coalesce("__offset", F.lit(0.0))).alias("antenna_height_m"),
        tower_algorithm(towers).alias("algorithm"),
        _or_null(towers, "dp_steps", "int").alias("dp_steps"),
        _or_null(towers, "repair_round", "int").alias("repair_round"),
    ]
    return joined.select(feature(point(F.col("lat"), F.col("lon")), *own).alias("feature"))


def coverage_features(cells: DataFrame) -> DataFrame:
    """(feature): hexagons of covered cells with their coverage values; infinite distances are null."""
    own = ["cell", finite(F.col("elevation")).alias("elevation"), "n_visible", "closest_id", finite(F.col("closest_m")).alias("closest_m"), "serving_id", finite(F.col("serving_loss_db")).alias("path_loss_db"), finite(F.col("serving_clearance_m")).alias("clearance_m"), finite(F.col("received_dbm")).alias("received_dbm"), "covered"]
    return cells.select(feature(hexagon(F.col("cell")), *[F.col(c) if isinstance(c, str) else c for c in own]).alias("feature"))


def record_features(records: DataFrame) -> DataFrame:
    """(feature): every column of coverage records but lat and lon, on the cell's hexagon."""
    own = [F.col(c) for c in records.columns if c not in ("lat", "lon")]
    return records.select(feature(hexagon(F.col("cell")), *own).alias("feature"))


def grid_features(cells: DataFrame, resolution: int | None = None) -> DataFrame:
    """(feature): grid cells; resolutions fall back from the cell's own column to the argument to the id."""
    own = grid.resolution_of(F.col("cell"))
    base = F.coalesce(F.col("base_resolution") if "base_resolution" in cells.columns else F.lit(None).cast("int"), F.lit(resolution).cast("int"), own)
    target = F.coalesce(F.col("resolution") if "resolution" in cells.columns else F.lit(None).cast("int"), own)
    flags = [F.col(c) for c in ("has_road", "has_tower", "unfit", "elevation", "refined", "gradient") if c in cells.columns]
    return cells.select(feature(hexagon(F.col("cell")), F.col("cell"), base.alias("base_resolution"), target.alias("resolution"), *flags).alias("feature"))


def search_features(records: DataFrame) -> DataFrame:
    """(feature): hexagons of search records, with the older names of gap and ring beside the new ones."""
    old = [F.col("gap").alias("gap_idx"), F.col("ring").alias("buffer_ring")]
    return records.select(feature(hexagon(F.col("cell")), *[F.col(c) for c in records.columns], *old).alias("feature"))


def link_type(algorithm1: Column, algorithm2: Column) -> Column:
    """red if an end is a fallback, else yellow if one was repaired, else green."""
    either = lambda *names: F.coalesce(algorithm1.isin(*names), F.lit(False)) | F.coalesce(algorithm2.isin(*names), F.lit(False))
    return F.when(either(*_RED), "red").when(either(_YELLOW), "yellow").otherwise("green")


def edge_features(edges: DataFrame, towers: DataFrame, cells: DataFrame | None = None, config: MeshConfig | None = None) -> DataFrame:
    """(feature): lines between towers with all that is known of the link and of its ends.

    ``edges`` have a, b, distance_m, path_loss_db, clearance_m, obstruction, origin; ``cells`` (cell, elevation[, offset_m])
    give the ends' ground and antennas, ``config`` the budget, the rule and the margins.
    """
    rows = edges
    for side, key in (("source", "a"), ("target", "b")):
        end = towers.select(F.col("id").alias(key), F.col("lat").alias(f"{side}_y"), F.col("lon").alias(f"{side}_x"), _or_null(towers, "cell", "long").alias(f"{side}_h3"), _or_null(towers, "source", "string").alias(f"{side}_source"), tower_algorithm(towers).alias(f"{side}_algorithm"))
        rows = rows.join(end, key)
        if cells is not None:
            place = cells.select(F.col("cell").alias(f"{side}_c"), F.col("elevation").cast("double").alias(f"{side}_elevation_m"), F.coalesce(_or_null(cells, "offset_m", "double"), F.lit(0.0)).alias(f"{side}_offset"))
            rows = rows.join(place, F.col(f"{side}_h3") == F.col(f"{side}_c"), "left")
        else:
            rows = rows.withColumn(f"{side}_c", F.lit(None).cast("long")).withColumn(f"{side}_elevation_m", F.lit(None).cast("double")).withColumn(f"{side}_offset", F.lit(None).cast("double"))
    r = lambda c: F.bround(c, 6)
    line = F.struct(F.lit("LineString").alias("type"), F.array(F.array(F.col("source_x"), F.col("source_y")), F.array(F.col("target_x"), F.col("target_y"))).alias("coordinates"))
    low = F.coalesce(F.col("clearance_m") < 0, F.lit(False))
    given = lambda v: F.lit(v).cast("double") if config is not None else F.lit(None).cast("double")
    mast, budget = given(config and config.mast_height_m), given(config and config.link_budget_db)
    most = given(physics.MOST_OBSTRUCTION)
    both = lambda name, value: [value(side).alias(f"{side}_{name}") for side in ("source", "target")]
    own = [
        F.col("a").alias("source_id"),
        F.col("b").alias("target_id"),
        *both("h3", lambda s: F.col(f"{s}_h3")),
        *both("lat", lambda s: r(F.col(f"{s}_y"))),
        *both("lon", lambda s: r(F.col(f"{s}_x"))),
        *both("centroid_lat", lambda s: F.when(F.col(f"{s}_c").isNotNull(), r(grid.lat_of(F.col(f"{s}_h3"))))),
        *both("centroid_lon", lambda s: F.when(F.col(f"{s}_c").isNotNull(), r(grid.lon_of(F.col(f"{s}_h3"))))),
        *both("source", lambda s: F.col(f"{s}_source")),
        F.col("distance_m"),
        F.col("clearance_m"),
        F.col("path_loss_db"),
        mast.alias("mast_height_m"),
        *both("elevation_m", lambda s: F.col(f"{s}_elevation_m")),
        *both("antenna_height_m", lambda s: mast + F.coalesce(F.col(f"{s}_offset"), F.lit(0.0))),
        F.col("origin").alias("edge_origin"),
        (F.lit("budget_and_fresnel_40pct") if config is not None else F.lit(None).cast("string")).alias("visibility_policy"),
        budget.alias("link_budget_db"),
        (budget - F.col("path_loss_db")).alias("path_loss_margin_db"),
        most.alias("max_allowed_fresnel_obstruction_ratio"),
        F.col("obstruction").alias("fresnel_obstruction_ratio"),
        (most - F.col("obstruction")).alias("fresnel_obstruction_margin_ratio"),
        (F.col("path_loss_db") <= budget).alias("accepted_by_budget"),
        (F.col("obstruction") <= most).alias("accepted_by_fresnel_policy"),
        *both("algorithm", lambda s: F.col(f"{s}_algorithm")),
        link_type(F.col("source_algorithm"), F.col("target_algorithm")).alias("link_type"),
        low.alias("is_nlos"),
        F.when(low, "nlos").otherwise("los").alias("los_state"),
    ]
    return rows.select(feature(line, *own).alias("feature"))


def write_features(features: DataFrame, path: str) -> None:
    """Features as text, one a line, ready to be joined to a collection."""
    features.select("feature").write.mode("overwrite").text(path)


def collection(features: DataFrame) -> str:
    """A FeatureCollection of few features, as one JSON text on the driver."""
    return '{"type":"FeatureCollection","features":[' + ",".join(r[0] for r in features.select("feature").toLocalIterator()) + "]}"
