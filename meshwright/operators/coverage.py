"""Coverage of cells by towers: serving, closest and visible towers, coverage radii, city links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from meshwright.config import MeshConfig
from meshwright.functions import grid, physics
from meshwright.operators import dem, los, spatial


def dedupe_sources(sources: DataFrame) -> DataFrame:
    """One source a cell, the first by ord."""
    names = [c for c in sources.columns if c != "cell"]
    return sources.groupBy("cell").agg(F.min_by(F.struct(*names), F.struct("ord", F.col("id").cast("string"))).alias("s")).select("cell", "s.*")


def snap_sources(sources: DataFrame, resolution: int) -> DataFrame:
    """Sources moved to the centre of their cell at a resolution."""
    moved = sources.withColumn("cell", grid.cell_of(F.col("lat"), F.col("lon"), resolution))
    return moved.withColumn("lat", grid.lat_of(F.col("cell"))).withColumn("lon", grid.lon_of(F.col("cell")))


def aggregate_links(links: DataFrame) -> DataFrame:
    """By cell, over visible links (cell, source, ord, distance_m, path_loss_db, clearance_m).

    n_visible, closest_* (least distance) and serving_* (least loss); ties go to the smaller ord.
    Where links have ``n``, a link stands for so many of its kind, the first by ord among them.
    """
    many = F.sum("n") if "n" in links.columns else F.count(F.lit(1))
    near = F.struct("distance_m", "ord")
    strong = F.struct("path_loss_db", "ord")
    return links.groupBy("cell").agg(
        many.alias("n_visible"),
        F.min_by("source", near).alias("closest_id"),
        F.min("distance_m").alias("closest_m"),
        F.min_by(F.struct("source", "path_loss_db", "clearance_m", "distance_m"), strong).alias("s"),
    ).select("cell", "n_visible", "closest_id", "closest_m", F.col("s.source").alias("serving_id"), F.col("s.path_loss_db").alias("serving_loss_db"), F.col("s.clearance_m").alias("serving_clearance_m"), F.col("s.distance_m").alias("serving_m"))


def with_power(cells: DataFrame, config: MeshConfig, loss: str = "serving_loss_db", count: str = "n_visible") -> DataFrame:
    """received_dbm of the given loss, and covered: at least one link, and power over the sensitivity."""
    power = physics.received_power_dbm(F.col(loss), config.tx_power_dbm, config.antenna_gain_dbi)
    return cells.withColumn("received_dbm", power).withColumn("covered", F.coalesce((F.col(count) > 0) & (power >= config.receiver_sensitivity_dbm), F.lit(False)))


def coverage_radius(cells: DataFrame) -> DataFrame:
    """(id, radius_m): the farthest covered cell that a tower is closest to."""
    return cells.where("covered and closest_id is not null").groupBy(F.col("closest_id").alias("id")).agg(F.max("closest_m").alias("radius_m"))


def cell_coverage(cells: DataFrame, towers: DataFrame, config: MeshConfig, raster: dem.Raster | None = None) -> DataFrame:
    """Every cell (cell, lat, lon, elevation) with its visible towers; a tower's own cell is covered by it at no distance."""
    radius = min(config.max_coverage_radius_m, physics.max_fspl_distance_m(config.frequency_hz, config.link_budget_db))
    mast = F.lit(config.mast_height_m) + (F.coalesce("offset_m", F.lit(0.0)) if "offset_m" in cells.columns else F.lit(0.0))
    left = cells.select(F.col("cell").alias("id"), F.coalesce("los_lat", "lat").alias("lat"), F.coalesce("los_lon", "lon").alias("lon"), "cell", F.col("elevation").alias("ground"), mast.alias("mast"))
    right = towers.select("id", "lat", "lon", "cell", "ground", "mast")
    pairs = spatial.range_join(left, right, radius).withColumn("id", F.struct(F.col("id1").alias("cell"), F.col("id2").alias("source")))
    seen = los.evaluate(pairs, config, cells.select("cell", "elevation"), raster).where("visible")
    links = seen.select("id.cell", "id.source", F.col("id.source").alias("ord"), "distance_m", "path_loss_db", "clearance_m")
    own = towers.groupBy(F.col("cell").alias("tc")).agg(F.min("id").alias("tower"))
    joined = cells.join(aggregate_links(links).withColumnRenamed("cell", "lc"), F.col("cell") == F.col("lc"), "left").join(own, F.col("cell") == F.col("tc"), "left")
    mine = F.col("tower").isNotNull()
    fixed = {"closest_id": F.col("tower"), "serving_id": F.col("tower"), "closest_m": F.lit(0.0), "serving_loss_db": F.lit(0.0), "serving_clearance_m": F.lit(0.0), "serving_m": F.lit(0.0)}
    for name, value in fixed.items():
        joined = joined.withColumn(name, F.when(mine, value).otherwise(F.col(name)))
    joined = joined.withColumn("n_visible", F.when(mine, F.greatest(F.coalesce("n_visible", F.lit(0)), F.lit(1))).otherwise(F.coalesce("n_visible", F.lit(0))))
    return with_power(joined.drop("lc", "tc", "tower"), config)


def tower_coverage(cells: DataFrame, sources: DataFrame, raster: dem.Raster, config: MeshConfig, radius_m: float | None = None) -> DataFrame:
    """Coverage of candidate cells (cell, lat, lon, elevation) by sources (id, cell, lat, lon, ground, ord).

    Sources are one a cell; links within the radius are tested by the strict terrain
    shadow; a cell without a visible link falls back to the nearest source in reach for
    closest_*, its other values stay null.
    """
    radius = min(radius_m or config.max_coverage_radius_m, config.max_coverage_radius_m)
    left = cells.select(F.col("cell").alias("id"), "lat", "lon", F.col("elevation").alias("ground"))
    right = dedupe_sources(sources).select("id", "lat", "lon", "ground", "ord")
    # the tower's end, with the mast, is the first of a link
    reach = spatial.range_join(right, left, radius).withColumn("id", F.struct(F.col("id2").alias("cell"), F.col("id1").alias("source"), F.col("ord1").alias("ord")))
    tested = los.shadow_links(reach, raster, config).select("id.cell", "id.source", "id.ord", "distance_m", "path_loss_db", "clearance_m", "visible")
    best = aggregate_links(tested.where("visible").drop("visible"))
    any_ = tested.groupBy(F.col("cell").alias("ac")).agg(F.min_by("source", F.struct("distance_m", "ord")).alias("any_id"), F.min("distance_m").alias("any_m"))
    joined = cells.join(best.withColumnRenamed("cell", "bc"), F.col("cell") == F.col("bc"), "left").join(any_, F.col("cell") == F.col("ac"), "left")
    joined = joined.withColumn("n_visible", F.coalesce("n_visible", F.lit(0))).withColumn("closest_id", F.coalesce("closest_id", "any_id")).withColumn("closest_m", F.coalesce("closest_m", "any_m"))
    return with_power(joined.drop("bc", "ac", "any_id", "any_m"), config)


def city_links(cells: DataFrame, cities: DataFrame, share: float = 0.2) -> DataFrame:
    """(id, city_link): towers of whose closest cells at least a share lies in a city (rings)."""
    rows = cells.where("closest_id is not null").select(F.col("cell").alias("id"), "lat", "lon", "closest_id")
    inside = spatial.within_polygons(rows, cities)
    return inside.groupBy(F.col("closest_id").alias("id")).agg((F.avg(F.col("inside").cast("int")) >= share).alias("city_link"))


def report(towers: DataFrame, cells: DataFrame, clusters: DataFrame) -> DataFrame:
    """One row: towers by kind, cells, coverage in percent (one digit, halves to even), clusters and their sizes."""
    t = towers.agg(F.count(F.lit(1)).alias("towers"), F.count_if(F.col("source") == "site").alias("virtual_towers"), F.count_if(F.col("source") != "site").alias("physical_towers"))
    c = cells.agg(F.count(F.lit(1)).alias("cells"), F.count_if(F.col("covered")).alias("covered"), F.bround(F.lit(100.0) * F.avg(F.col("covered").cast("int")), 1).alias("coverage_pct"))
    sizes = clusters.groupBy("component").count().agg(F.count(F.lit(1)).alias("clusters"), F.sort_array(F.collect_list("count"), False).alias("cluster_sizes"))
    return t.join(F.broadcast(c)).join(F.broadcast(sizes))  # one row each


def distance_to(cells: DataFrame, sources: DataFrame, radius_m: float) -> DataFrame:
    """(cell, source, distance_m): the nearest source of each cell within a radius, visible or not."""
    near = spatial.nearest(cells.select(F.col("cell").alias("id"), "lat", "lon"), sources, radius_m)
    return near.select(F.col("id1").alias("cell"), F.col("id2").alias("source"), "distance_m")

