"""Elevation lookups on a raster table (row, col, value; value null where there is no data).

Rasters are joined on pixel keys; Spark broadcasts a small raster by its own size
estimate and shuffles a large one.  North is at row 0.
"""

from __future__ import annotations

import dataclasses
import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from meshwright.functions import geo, grid


@dataclasses.dataclass(frozen=True)
class Raster:
    """Pixels and their placing: the north-west corner, the pixel size in degrees, and the shape.

    ``px`` is a pixel's width, and its height too unless ``py`` says otherwise.
    """

    pixels: DataFrame
    west: float
    north: float
    px: float
    width: int
    height: int
    py: float = 0.0

    @property
    def dlat(self) -> float:
        return self.py or self.px

    def row_at(self, lat: Column) -> Column:
        """Fractional row of a latitude."""
        return (F.lit(self.north) - lat) / F.lit(self.dlat)

    def col_at(self, lon: Column) -> Column:
        return (lon - F.lit(self.west)) / F.lit(self.px)

    def inside(self, row: Column, col: Column) -> Column:
        return (row >= 0) & (row < self.height) & (col >= 0) & (col < self.width)

    def _rows_and_columns(self, south: float, west: float, north: float, east: float) -> tuple[int, int, int, int]:
        """First and last row, first and last column of a rectangle, at least one of each."""
        r0, r1 = int((self.north - north) // self.dlat), int((self.north - south) // self.dlat)
        c0, c1 = int((west - self.west) // self.px), int((east - self.west) // self.px)
        return r0, max(r0, r1), c0, max(c0, c1)

    def window(self, south: float, west: float, north: float, east: float) -> DataFrame:
        """The pixels of a rectangle, at least one in each direction."""
        r0, r1, c0, c1 = self._rows_and_columns(south, west, north, east)
        return self.pixels.where(F.col("row").between(r0, r1) & F.col("col").between(c0, c1))

    # What a store in tiles does better: each may leave out pixels or samples that cannot matter.

    def at(self, keyed: DataFrame, row: str, col: str) -> DataFrame:
        """Pixels among which are those that the rows and columns of ``keyed`` name."""
        return self.pixels

    def around(self, points: DataFrame, reach_deg: float) -> Raster:
        """This raster, or the part of it within some degrees of points (lat, lon)."""
        return self

    def promising(self, samples: DataFrame) -> DataFrame:
        """Samples (id, r, c, ...) of lines, among which is the highest of each."""
        return samples


def nearest_value(points: DataFrame, raster: Raster, out: str = "elevation") -> DataFrame:
    """Elevation of the pixel that holds a point; 0 outside and where there is no data."""
    keyed = points.withColumn("__r", F.floor(raster.row_at(F.col("lat")))).withColumn("__c", F.floor(raster.col_at(F.col("lon"))))
    px = raster.at(keyed, "__r", "__c").select(F.col("row").cast("long").alias("__pr"), F.col("col").cast("long").alias("__pc"), F.col("value").cast("double").alias("__v"))
    found = keyed.join(px, (F.col("__r") == F.col("__pr")) & (F.col("__c") == F.col("__pc")), "left")
    return found.withColumn(out, F.coalesce("__v", F.lit(0.0))).drop("__r", "__c", "__pr", "__pc", "__v")


def bilinear_value(points: DataFrame, raster: Raster, key: str = "id", out: str = "elevation") -> DataFrame:
    """Elevation between four pixels; the nearest one where not all four are inside.

    ``key`` names each point.  Four keys a point meet the raster in one join and are summed.
    """
    r, c = raster.row_at(F.col("lat")), raster.col_at(F.col("lon"))
    fr, fc = r - F.floor(r), c - F.floor(c)
    full = raster.inside(F.floor(r), F.floor(c)) & raster.inside(F.floor(r) + 1, F.floor(c) + 1)
    one = lambda i, j, w: F.struct((F.floor(r) + i).alias("r"), (F.floor(c) + j).alias("c"), w.alias("w"))
    corners = F.array(one(0, 0, (1 - fr) * (1 - fc)), one(0, 1, (1 - fr) * fc), one(1, 0, fr * (1 - fc)), one(1, 1, fr * fc))
    needed = points.select(key, F.explode(F.when(full, corners).otherwise(F.array(one(0, 0, F.lit(1.0))))).alias("p")).select(key, "p.*")
    px = raster.at(needed, "r", "c").select(F.col("row").cast("long").alias("__pr"), F.col("col").cast("long").alias("__pc"), F.col("value").cast("double").alias("__v"))
    summed = needed.join(px, (F.col("r") == F.col("__pr")) & (F.col("c") == F.col("__pc")), "left").groupBy(F.col(key).alias("__k")).agg(F.sum(F.col("w") * F.coalesce("__v", F.lit(0.0))).alias(out))
    return points.join(summed, F.col(key) == F.col("__k")).drop("__k")


def pixel_cells(raster: Raster, resolution: int) -> DataFrame:
    """(cell, row, col, lat, lon, value) of every pixel with data, by the cell of its centre."""
    lat = F.lit(raster.north) - (F.col("row") + F.lit(0.5)) * F.lit(raster.dlat)
    lon = F.lit(raster.west) + (F.col("col") + F.lit(0.5)) * F.lit(raster.px)
    return raster.pixels.where("value is not null").select("row", "col", lat.alias("lat"), lon.alias("lon"), F.col("value").cast("double").alias("value")).withColumn("cell", grid.cell_of(F.col("lat"), F.col("lon"), resolution))


def touched_cells(raster: Raster, resolution: int) -> DataFrame:
    """As ``pixel_cells``, but a pixel belongs to every cell whose hexagon its rectangle overlaps.

    Cells near a pixel's own are tried; hexagon and rectangle overlap where no edge direction of either separates them.
    """
    edge, half = grid.edge_m(resolution), raster.dlat / 2 * geo.METRES_PER_DEGREE
    wide, inner = raster.px / 2 * geo.METRES_PER_DEGREE * grid._COS0, edge * grid.ROOT3 / 2
    reach = math.ceil(math.hypot(half, wide) / (1.5 * edge)) + 1
    tried = pixel_cells(raster, resolution).withColumn("cell", F.explode(grid.disk(F.col("cell"), reach)))
    x, y = (F.col("lon") - grid.lon_of(F.col("cell"))) * (geo.METRES_PER_DEGREE * grid._COS0), (F.col("lat") - grid.lat_of(F.col("cell"))) * geo.METRES_PER_DEGREE
    apart = tried.withColumn("__x", x).withColumn("__y", y)
    slanted = lambda sign: F.abs(F.col("__x") * 0.5 + sign * F.col("__y") * (grid.ROOT3 / 2)) < inner + wide * 0.5 + half * grid.ROOT3 / 2
    return apart.where((F.abs("__x") < wide + inner) & (F.abs("__y") < half + edge) & slanted(1.0) & slanted(-1.0)).drop("__x", "__y")


def highest(touched: DataFrame) -> DataFrame:
    """(cell, elevation): the highest of the pixels that touch each cell."""
    return touched.where(~F.isnan("value")).groupBy("cell").agg(F.max("value").alias("elevation"))


def cell_max(raster: Raster, resolution: int) -> DataFrame:
    """(cell, elevation): the highest pixel that touches each cell."""
    return highest(touched_cells(raster, resolution))


def _edge_margin(lat: Column, lon: Column, cell: Column) -> Column:
    """Metres from a point to the nearest edge of its cell (negative outside)."""
    x, y = geo.to_local(lat, lon, grid.lat_of(cell), grid.lon_of(cell))
    inner = grid.edge_of(grid.resolution_of(cell)) * F.lit(grid.ROOT3 / 2)
    reach = F.greatest(F.abs(x), F.abs(x * 0.5 + y * (grid.ROOT3 / 2)), F.abs(x * 0.5 - y * (grid.ROOT3 / 2)))
    return inner - reach


def anchors(cells: DataFrame, raster: Raster, resolution: int, margin_m: float = 10.0) -> DataFrame:
    """(cell, elevation, los_lat, los_lon): the highest pixel at least ``margin_m`` inside each cell.

    Where no pixel lies so far inside the highest of the whole cell counts, and without
    any the centre with the nearest elevation.  Ties go to the pixel nearest the centre,
    then to the smaller row and column.
    """
    spots = cells.select(grid.lat_of(F.col("cell")).alias("lat"), grid.lon_of(F.col("cell")).alias("lon"))
    near = raster.around(spots, 1.5 * grid.edge_m(resolution) / (geo.METRES_PER_DEGREE * grid._COS0))
    px = pixel_cells(near, resolution).withColumn("deep", (_edge_margin(F.col("lat"), F.col("lon"), F.col("cell")) >= margin_m).cast("int"))
    off = (F.col("lat") - grid.lat_of(F.col("cell"))) * (F.col("lat") - grid.lat_of(F.col("cell"))) + (F.col("lon") - grid.lon_of(F.col("cell"))) * (F.col("lon") - grid.lon_of(F.col("cell")))
    order = F.struct((-F.col("deep")).alias("t"), (-F.col("value")).alias("v"), off.alias("o"), "row", "col")
    best = px.groupBy(F.col("cell").alias("__cell")).agg(F.min_by(F.struct("value", "lat", "lon"), order).alias("a"))
    placed = cells.select("cell", grid.lat_of(F.col("cell")).alias("lat"), grid.lon_of(F.col("cell")).alias("lon"))
    near = nearest_value(placed, raster, "__near")
    joined = near.join(best, F.col("cell") == F.col("__cell"), "left")
    return joined.select("cell", F.coalesce("a.value", "__near").alias("elevation"), F.coalesce("a.lat", "lat").alias("los_lat"), F.coalesce("a.lon", "lon").alias("los_lon"))


def line_peaks(lines: DataFrame, raster: Raster) -> DataFrame:
    """(id, peak_m, fraction): the highest pixel on each line (id, lat1, lon1, lat2, lon2) and where it lies.

    Lines are walked from their smaller end (rounded to 6 digits), two samples a pixel;
    repeated pixels count once, ties go to the sample nearest the middle; without data
    the higher end counts.
    """
    first, second = F.struct(F.round("lat1", 6), F.round("lon1", 6)), F.struct(F.round("lat2", 6), F.round("lon2", 6))
    flip = first > second
    walk = lines.withColumn("__flip", flip)
    for name in ("lat", "lon"):
        walk = walk.withColumn(f"__{name}a", F.when(F.col("__flip"), F.col(f"{name}2")).otherwise(F.col(f"{name}1"))).withColumn(f"__{name}b", F.when(F.col("__flip"), F.col(f"{name}1")).otherwise(F.col(f"{name}2")))
    ra, rb = raster.row_at(F.col("__lata")) - F.lit(0.5), raster.row_at(F.col("__latb")) - F.lit(0.5)
    ca, cb = raster.col_at(F.col("__lona")) - F.lit(0.5), raster.col_at(F.col("__lonb")) - F.lit(0.5)
    steps = F.greatest(F.ceil(F.abs(rb - ra)), F.ceil(F.abs(cb - ca)), F.lit(1)) * 2
    samples = walk.withColumn("__n", steps).withColumn("__ra", ra).withColumn("__rb", rb).withColumn("__ca", ca).withColumn("__cb", cb).withColumn("__i", F.explode(F.sequence(F.lit(0).cast("long"), F.col("__n"))))
    t = F.col("__i") / F.col("__n")
    keyed = samples.select("id", "__flip", t.alias("t"), F.bround(F.col("__ra") + (F.col("__rb") - F.col("__ra")) * t).cast("long").alias("r"), F.bround(F.col("__ca") + (F.col("__cb") - F.col("__ca")) * t).cast("long").alias("c"))
    keyed = raster.promising(keyed)
    px = raster.at(keyed, "r", "c").where("value is not null").select(F.col("row").cast("long").alias("pr"), F.col("col").cast("long").alias("pc"), F.col("value").cast("double").alias("v"))
    found = keyed.join(px, (F.col("r") == F.col("pr")) & (F.col("c") == F.col("pc")))
    best = found.groupBy(F.col("id").alias("__id")).agg(F.min_by(F.struct("v", F.when(F.col("__flip"), 1 - F.col("t")).otherwise(F.col("t")).alias("f")), F.struct((-F.col("v")).alias("v"), F.abs(F.col("t") - 0.5).alias("m"), "t")).alias("p"))
    ends = nearest_value(nearest_value(lines.withColumnRenamed("lat1", "lat").withColumnRenamed("lon1", "lon"), raster, "__e1").withColumnRenamed("lat", "lat1").withColumnRenamed("lon", "lon1").withColumnRenamed("lat2", "lat").withColumnRenamed("lon2", "lon"), raster, "__e2")
    joined = ends.join(best, F.col("id") == F.col("__id"), "left")
    return joined.select("id", F.coalesce("p.v", F.greatest("__e1", "__e2")).alias("peak_m"), F.coalesce("p.f", F.when(F.col("__e2") > F.col("__e1"), F.lit(1.0)).otherwise(F.lit(0.0))).alias("fraction"))


def cell_profiles(cells: DataFrame, anchored: DataFrame, highest: DataFrame, raster: Raster | None = None) -> DataFrame:
    """(cell, elevation, los_lat, los_lon): anchor, else highest pixel at the centre, else point elevation, else 0."""
    rows = cells.select("cell", grid.lat_of(F.col("cell")).alias("lat"), grid.lon_of(F.col("cell")).alias("lon"))
    rows = nearest_value(rows, raster, "__point") if raster is not None else rows.withColumn("__point", F.lit(0.0))
    a = anchored.select(F.col("cell").alias("ca"), F.col("elevation").alias("ea"), "los_lat", "los_lon")
    m = highest.select(F.col("cell").alias("cm"), F.col("elevation").alias("em"))
    joined = rows.join(a, F.col("cell") == F.col("ca"), "left").join(m, F.col("cell") == F.col("cm"), "left")
    return joined.select("cell", F.coalesce("ea", "em", "__point").alias("elevation"), F.coalesce("los_lat", "lat").alias("los_lat"), F.coalesce("los_lon", "lon").alias("los_lon"))


def local_gradient(cells: DataFrame) -> DataFrame:
    """(cell, gradient): steepest rise in m per km to a neighbour in the set; neighbours of 1 m or less are skipped."""
    pairs = cells.select(F.col("cell").alias("a"), F.col("elevation").alias("ea"), F.explode(grid.ring(F.col("cell"), 1)).alias("b"))
    near = pairs.join(cells.select(F.col("cell").alias("c"), F.col("elevation").alias("eb")), F.col("b") == F.col("c"))
    near = near.withColumn("la", grid.lat_of(F.col("a"))).withColumn("oa", grid.lon_of(F.col("a"))).withColumn("lb", grid.lat_of(F.col("b"))).withColumn("ob", grid.lon_of(F.col("b")))
    far = geo.geodesic_m(F.col("la"), F.col("oa"), F.col("lb"), F.col("ob"))
    steep = near.withColumn("d", far).where("d > 1").groupBy("a").agg(F.max(F.abs(F.col("ea") - F.col("eb")) / (F.col("d") / 1000)).alias("gradient"))
    return cells.select("cell").join(steep, F.col("cell") == F.col("a"), "left").select("cell", F.coalesce("gradient", F.lit(0.0)).alias("gradient"))

