"""A tiled store for rasters: pixels in Parquet by square tiles, with the lowest and highest value of each.

Lookups on such a raster read the tiles that their points fall into: the tiles are gathered first, and the pixel
table is filtered by them before it is joined.  A few tiles become a partition filter, whose files alone are listed
and read; more than ``NAMED`` are joined on the tile, so that the driver holds a bounded number.  A question for the
highest pixel on a line drops whole tiles that lie below what another tile of the line is sure to hold.
"""

from __future__ import annotations

import dataclasses
import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from meshwright.operators.dem import Raster
from meshwright.operators.stage import cut

#: Pixels along a tile's side, for a store whose tiles are worth a file each.
SIDE = 1024
#: Tiles that a filter names one by one.
NAMED = 2000
VERSION = 1


@dataclasses.dataclass(frozen=True)
class TiledRaster(Raster):
    """A raster whose ``pixels`` have a partition column ``tile``; ``bounds`` has tile, least, most, held (pixels with a value) and whole (all pixels have one)."""

    side: int = SIDE
    bounds: DataFrame | None = None

    def tile_of(self, row: Column, col: Column) -> Column:
        """The tile of a pixel inside the raster; null outside."""
        across = -(-self.width // self.side)
        inside = (row >= 0) & (row < self.height) & (col >= 0) & (col < self.width)
        return F.when(inside, F.floor(row / self.side) * across + F.floor(col / self.side)).cast("long")

    def within(self, tiles: DataFrame) -> DataFrame:
        """The pixels of some tiles (tile)."""
        wanted = cut(tiles.where("tile is not null").select("tile").distinct())
        few = [r[0] for r in wanted.limit(NAMED + 1).collect()]
        if len(few) <= NAMED:
            return self.pixels.where(F.col("tile").isin(few)) if few else self.pixels.where(F.lit(False))
        return self.pixels.join(wanted.select(F.col("tile").alias("__tile")), F.col("tile") == F.col("__tile"), "left_semi")

    def at(self, keyed: DataFrame, row: str, col: str) -> DataFrame:
        return self.within(keyed.select(self.tile_of(F.col(row), F.col(col)).alias("tile")))

    def window(self, south: float, west: float, north: float, east: float) -> DataFrame:
        r0, r1, c0, c1 = self._rows_and_columns(south, west, north, east)
        tiles = self.bounds.where((F.col("row0") <= r1) & (F.col("row0") + self.side > r0) & (F.col("col0") <= c1) & (F.col("col0") + self.side > c0))
        return self.within(tiles).where(F.col("row").between(r0, r1) & F.col("col").between(c0, c1))

    def around(self, points: DataFrame, reach_deg: float) -> Raster:
        """The raster's tiles within so many degrees of latitude and longitude of any point (lat, lon)."""
        lo = lambda x, most: F.greatest(F.lit(0), F.least(F.floor(x), F.lit(most - 1)))
        rows = points.select(*[F.floor(lo(self.row_at(F.col("lat") + s * reach_deg), self.height) / self.side).alias(n) for n, s in (("r0", 1), ("r1", -1))], *[F.floor(lo(self.col_at(F.col("lon") + s * reach_deg), self.width) / self.side).alias(n) for n, s in (("c0", -1), ("c1", 1))])
        across = -(-self.width // self.side)
        tiles = rows.distinct().select(F.explode(F.sequence("r0", "r1")).alias("r"), "c0", "c1").select("r", F.explode(F.sequence("c0", "c1")).alias("c")).select((F.col("r") * across + F.col("c")).cast("long").alias("tile"))
        return dataclasses.replace(self, pixels=self.within(tiles))

    def promising(self, samples: DataFrame) -> DataFrame:
        """Samples (id, r, c, ...) without those in tiles that cannot hold the highest of their line.

        A line with a sample in a tile without gaps reaches that tile's least value there; tiles whose most is below the
        largest such value go.
        """
        known = self.bounds.select(F.col("tile").alias("__t"), "least", "most", "whole")
        tiled = samples.withColumn("__tile", self.tile_of(F.col("r"), F.col("c"))).where("__tile is not null")
        crossed = tiled.select("id", "__tile").distinct().join(known, F.col("__tile") == F.col("__t"))
        sure = crossed.groupBy(F.col("id").alias("__id")).agg(F.max(F.when(F.col("whole"), F.col("least"))).alias("__sure"))
        kept = crossed.join(sure, F.col("id") == F.col("__id")).where("__sure is null or most >= __sure").select(F.col("id").alias("__id"), F.col("__tile").alias("__t"))
        return tiled.join(kept, (F.col("id") == F.col("__id")) & (F.col("__tile") == F.col("__t")), "left_semi").drop("__tile")


def write_tiles(raster: Raster, path: str, side: int = SIDE) -> None:
    """Store a raster below ``path``: pixels by tile (those without a value are left out), bounds, and a description."""
    across = -(-raster.width // side)
    tile = (F.floor(F.col("row") / side) * across + F.floor(F.col("col") / side)).cast("long")
    rows = raster.pixels.where("value is not null").select("row", "col", F.col("value").cast("double").alias("value"), tile.alias("tile"))
    rows.repartition("tile").sortWithinPartitions("tile", "row", "col").write.mode("overwrite").partitionBy("tile").parquet(f"{path}/pixels")
    spark = raster.pixels.sparkSession
    stored = spark.read.schema("row int, col int, value double, tile long").parquet(f"{path}/pixels")
    held = stored.groupBy("tile").agg(F.min("value").alias("least"), F.max("value").alias("most"), F.count(F.lit(1)).alias("held"), F.max(F.isnan("value")).alias("__nan"))
    r0, c0 = F.floor(F.col("tile") / across) * side, F.pmod(F.col("tile"), F.lit(across)) * side
    size = F.least(F.lit(side), F.lit(raster.height) - r0) * F.least(F.lit(side), F.lit(raster.width) - c0)
    held.select("tile", r0.alias("row0"), c0.alias("col0"), "least", "most", "held", ((F.col("held") == size) & ~F.col("__nan")).alias("whole")).write.mode("overwrite").parquet(f"{path}/bounds")
    told = {"version": VERSION, "west": raster.west, "north": raster.north, "px": raster.px, "py": raster.py, "width": raster.width, "height": raster.height, "side": side}
    spark.createDataFrame([(json.dumps(told, sort_keys=True),)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/description")


def read_tiles(spark: SparkSession, path: str) -> TiledRaster:
    """The raster of a store; another version is an error."""
    told = json.loads(spark.read.text(f"{path}/description").first()[0])
    if told.pop("version") != VERSION:
        raise ValueError(f"{path} is a store of another version")
    pixels = spark.read.schema("row int, col int, value double, tile long").parquet(f"{path}/pixels")
    return TiledRaster(pixels=pixels, bounds=spark.read.parquet(f"{path}/bounds"), **told)
