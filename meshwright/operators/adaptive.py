"""The adaptive mesh: cells refined where the terrain is steep, membership, corridors and summaries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from meshwright.config import MeshConfig
from meshwright.functions import grid
from meshwright.operators import dem, spatial

#: Gradient (m per km) over which a cell is refined, and the resolution it then gets.
STEEP, FINE = 75.0, 9


def targets(gradients: DataFrame, base: int, most: int, steep: float = STEEP) -> DataFrame:
    """(cell, gradient, target): steep cells get the finer resolution, never above ``most`` nor below the base."""
    fine = max(base, min(FINE, most))
    return gradients.withColumn("target", F.when(F.col("gradient") > steep, F.lit(fine)).otherwise(F.lit(base)))


def mesh(full: DataFrame, targeted: DataFrame, base: int, fine_cells: DataFrame | None = None) -> DataFrame:
    """(cell, base_cell, resolution, refined, gradient): unrefined cells, and the children of refined ones (within ``fine_cells``)."""
    rows = full.select("cell").join(targeted, "cell", "left").withColumn("target", F.coalesce("target", F.lit(base)))
    plain = rows.where(F.col("target") == base).select("cell", F.col("cell").alias("base_cell"), F.lit(base).alias("resolution"), F.lit(False).alias("refined"), "gradient")
    fine = [r[0] for r in rows.where(F.col("target") > base).select("target").distinct().collect()]  # at most the 16 resolutions
    for to in sorted(fine):
        split = rows.where(F.col("target") == to).select(F.explode(grid.children(F.col("cell"), base, to)).alias("cell"), F.col("cell").alias("base_cell"), F.lit(to).alias("resolution"), F.lit(True).alias("refined"), "gradient")
        plain = plain.union(split if fine_cells is None else split.join(fine_cells, "cell", "left_semi").select("cell", "base_cell", "resolution", "refined", "gradient"))
    return plain


def from_static(static: DataFrame, config: MeshConfig) -> DataFrame:
    """cell, elevation, los_lat, los_lon, has_road, base_cell, resolution, refined, gradient of the mesh over static cells (resolution, cell, kind, elevation, los_lat, los_lon).

    Cells of the plan's resolution whose slope to a neighbour is over the threshold give way to their children, those that the
    static cells have; where these lack the finer resolution nothing is refined.  Without refinement all cells are of one resolution.
    """
    base = config.h3_resolution
    known = static.groupBy("cell", "resolution").agg(F.max("elevation").alias("elevation"), F.min("los_lat").alias("los_lat"), F.min("los_lon").alias("los_lon"), F.max(F.col("kind") == "road").alias("has_road"))
    full = known.where(F.col("resolution") == base)
    fine = max(base, min(FINE, config.auto_refine_h3_max_resolution))
    finer = known.where(F.col("resolution") == fine).select("cell")
    gradients = dem.local_gradient(full.select("cell", "elevation"))
    if not config.auto_refine_h3_on_gradient or fine == base or finer.isEmpty():
        gradients = gradients.withColumn("gradient", F.lit(0.0))
    targeted = targets(gradients, base, config.auto_refine_h3_max_resolution, config.gradient_refine_threshold_m_per_km)
    made = mesh(full, targeted, base, finer)
    return made.join(known.drop("resolution"), "cell")


def project(samples: DataFrame, cells: DataFrame, base: int, fine: int, order: list[str]) -> DataFrame:
    """(route, pos, cell): samples (route, lat, lon and ``order``) of a road put onto the mesh, each cell at its first visit.

    ``cells`` (cell, resolution) are the mesh cells with roads; a sample outside all of them counts for its base cell.
    """
    named = samples.withColumn("id", F.struct("route", *order))
    placed = locate(named.select("id", "lat", "lon"), cells, base, fine)
    first = placed.groupBy(F.col("id.route").alias("route"), "cell").agg(F.min(F.struct(*[F.col(f"id.{c}").alias(c) for c in order])).alias("at"))
    return first.withColumn("pos", (F.row_number().over(W.partitionBy("route").orderBy("at")) - 1).cast("int")).select("route", "pos", "cell")


def near(cells: DataFrame, centres: DataFrame, radius_m: float) -> DataFrame:
    """(centre, cell): mesh cells (cell, lat, lon) of any resolution that a radius about a centre (cell) reaches, both cells' edges added; the centre too."""
    sized = lambda df: df.select(F.col("cell").alias("id"), "lat", "lon", grid.edge_of(grid.resolution_of(F.col("cell"))).alias("edge"))
    middle = centres.select("cell", grid.lat_of(F.col("cell")).alias("lat"), grid.lon_of(F.col("cell")).alias("lon")).distinct()
    largest = cells.select("cell").union(middle.select("cell")).select(F.max(grid.edge_of(grid.resolution_of(F.col("cell"))))).first()[0]
    found = spatial.within_adaptive(sized(cells), sized(middle), radius_m, largest or 0.0)
    return found.select("centre", F.col("id").alias("cell"))


def locate(points: DataFrame, cells: DataFrame, base: int, fine: int) -> DataFrame:
    """(id, cell): the finest member of the mesh that holds a point (id, lat, lon), else its base cell."""
    out = points.withColumn("__base", grid.cell_of(F.col("lat"), F.col("lon"), base)).withColumn("__hit", F.lit(None).cast("long"))
    for resolution in range(fine, base - 1, -1):
        out = out.withColumn("__want", grid.cell_of(F.col("lat"), F.col("lon"), resolution)).join(cells.where(F.col("resolution") == resolution).select(F.col("cell").alias("__have")).distinct(), F.col("__want") == F.col("__have"), "left")
        out = out.withColumn("__hit", F.coalesce("__hit", "__have")).drop("__want", "__have")
    return out.select("id", F.coalesce("__hit", "__base").alias("cell"))


def summary(cells: DataFrame) -> DataFrame:
    """(resolution, cells, least, most): counts by resolution, and the range of resolutions."""
    every = W.partitionBy()
    counted = cells.groupBy("resolution").agg(F.count(F.lit(1)).alias("cells"))
    return counted.withColumn("least", F.min("resolution").over(every)).withColumn("most", F.max("resolution").over(every))


def metadata(wanted: DataFrame, cells: DataFrame) -> DataFrame:
    """Mesh metadata of cells, with a default for those outside the mesh: themselves, unrefined."""
    found = wanted.select("cell").join(cells, "cell", "left")
    return found.select("cell", F.coalesce("base_cell", "cell").alias("base_cell"), F.coalesce("resolution", grid.resolution_of(F.col("cell"))).alias("resolution"), F.coalesce("refined", F.lit(False)).alias("refined"), "gradient")


def materialise(wanted: DataFrame, static: DataFrame, profiles: DataFrame, road: DataFrame) -> DataFrame:
    """Cells (cell, elevation, los_lat, los_lon, has_road, origin): from the static table, else from the raster's profiles.

    Repeated requests are merged; has_road is true where any request or the road set says so.
    """
    ids = wanted.groupBy("cell").agg(F.bool_or("has_road").alias("asked"))
    s = static.select(F.col("cell").alias("cs"), F.col("elevation").alias("es"), F.col("los_lat").alias("las"), F.col("los_lon").alias("los"))
    p = profiles.select(F.col("cell").alias("cp"), F.col("elevation").alias("ep"), F.col("los_lat").alias("lap"), F.col("los_lon").alias("lop"))
    joined = ids.join(s, F.col("cell") == F.col("cs"), "left").join(p, F.col("cell") == F.col("cp"), "left").join(road.select(F.col("cell").alias("cr")).distinct(), F.col("cell") == F.col("cr"), "left")
    origin = F.when(F.col("cs").isNotNull(), "static").otherwise("dem")
    return joined.select("cell", F.coalesce("es", "ep", F.lit(0.0)).alias("elevation"), F.coalesce("las", "lap", grid.lat_of(F.col("cell"))).alias("los_lat"), F.coalesce("los", "lop", grid.lon_of(F.col("cell"))).alias("los_lon"), (F.coalesce("asked", F.lit(False)) | F.col("cr").isNotNull()).alias("has_road"), origin.alias("origin"))


def materialise_stats(cells: DataFrame) -> DataFrame:
    """(requested, from_static, from_dem) of materialised cells."""
    return cells.agg(F.count(F.lit(1)).alias("requested"), F.count_if(F.col("origin") == "static").alias("from_static"), F.count_if(F.col("origin") == "dem").alias("from_dem"))
