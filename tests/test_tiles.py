"""The tiled store against the plain raster, and what it does not read."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from meshwright.functions import grid
from meshwright.operators import dem
from meshwright.sources import geotiff, raster, tiles

WIDTH, HEIGHT, PX = 230, 190, 0.001


@pytest.fixture(scope="module")
def both(spark, tmp_path_factory):
    """A raster with hills, holes and a plain store of it in tiles of 32."""
    i, row, col = F.col("id"), (F.col("id") / WIDTH).cast("int"), (F.col("id") % WIDTH).cast("int")
    value = F.when(i % 211 != 0, 100 + (row * 3 + col) % 40 + F.when((row / 32).cast("int") % 3 == 1, (col / 32).cast("int") * 50).otherwise(0)).cast("double")
    px = spark.range(WIDTH * HEIGHT).select(row.alias("row"), col.alias("col"), F.when((row < 64) | (col < 64), F.coalesce(value, 120.0 + (col / 32).cast("int") * 50)).otherwise(value).alias("value"))
    plain = dem.Raster(px, 44.0, 40.19, PX, WIDTH, HEIGHT)
    path = str(tmp_path_factory.mktemp("store") / "dem")
    tiles.write_tiles(plain, path, 32)
    return plain, tiles.read_tiles(spark, path), path


def points(spark, n, south=39.99, north=40.2, west=43.99, east=44.24):
    return spark.range(n).select("id", (F.lit(south) + (F.col("id") * 7919 % 1000) / 1000 * (north - south)).alias("lat"), (F.lit(west) + (F.col("id") * 104729 % 1000) / 1000 * (east - west)).alias("lon"))


def same(a, b):
    assert sorted(map(tuple, a.collect())) == sorted(map(tuple, b.collect()))


def test_lookups_are_those_of_the_plain_raster(spark, both):
    plain, tiled, _ = both
    p = points(spark, 150)
    same(dem.nearest_value(p, plain), dem.nearest_value(p, tiled))
    same(dem.bilinear_value(p, plain).select("id", F.round("elevation", 6)), dem.bilinear_value(p, tiled).select("id", F.round("elevation", 6)))
    cells = p.select(grid.cell_of(F.col("lat"), F.col("lon"), 8).alias("cell")).distinct()
    same(dem.anchors(cells, plain, 8), dem.anchors(cells, tiled, 8))
    same(plain.window(40.03, 44.02, 40.1, 44.13).where("value is not null").select("row", "col", "value"), tiled.window(40.03, 44.02, 40.1, 44.13).select("row", "col", "value"))


def test_line_peaks_with_and_without_tiles(spark, both):
    plain, tiled, _ = both
    a = points(spark, 40)
    lines = a.select("id", F.col("lat").alias("lat1"), F.col("lon").alias("lon1")).withColumn("lat2", F.lit(39.99) + (F.col("id") * 613 % 1000) / 1000 * 0.21).withColumn("lon2", F.lit(43.99) + (F.col("id") * 419 % 1000) / 1000 * 0.25)
    same(dem.line_peaks(lines, plain), dem.line_peaks(lines, tiled))
    # the store's own part: fewer samples, the highest among them
    walked = spark.range(100).select(F.lit(1).alias("id"), F.lit(40).alias("r"), (F.col("id") * 2).alias("c"))
    left = tiled.promising(walked)
    assert 0 < left.count() < 70
    top = lambda s: s.join(plain.pixels, (F.col("r") == F.col("row")) & (F.col("c") == F.col("col"))).agg(F.max("value")).first()[0]
    assert top(left) == top(walked)


def files_read(df):
    """Files that the scan of a plain selection opened."""
    assert df.collect() is not None
    return df._jdf.queryExecution().executedPlan().collectLeaves().head().metrics().apply("numFiles").value()


def test_only_the_tiles_of_the_points_are_read(spark, both):
    _, tiled, _ = both
    near = points(spark, 50, 40.131, 40.155, 44.001, 44.009)
    keyed = near.select(F.floor(tiled.row_at(F.col("lat"))).alias("r"), F.floor(tiled.col_at(F.col("lon"))).alias("c"))
    found = tiled.at(keyed, "r", "c")
    assert files_read(found) == 1 < files_read(tiled.pixels)
    window = tiled.window(40.13, 44.001, 40.155, 44.03)
    assert files_read(window) == 1
    assert tiled.at(points(spark, 5, 10, 11, 10, 11).select(F.floor(tiled.row_at(F.col("lat"))).alias("r"), F.floor(tiled.col_at(F.col("lon"))).alias("c")), "r", "c").count() == 0


def test_many_tiles_are_joined(spark, both, monkeypatch):
    plain, tiled, _ = both
    monkeypatch.setattr(tiles, "NAMED", 3)
    p = points(spark, 100)
    same(dem.nearest_value(p, plain), dem.nearest_value(p, tiled))


def test_every_format_by_its_path(spark, both, tmp_path):
    plain, tiled, path = both
    geotiff.write_geotiff(plain, str(tmp_path / "mosaic"), side=128, tile=64).collect()
    text = "\n".join(["ncols 3", "nrows 2", "xllcorner 44", "yllcorner 40", "cellsize 0.5", "nodata_value -1", "1 2 3", "4 -1 6"])
    (tmp_path / "a.asc").write_text(text)
    assert raster.load(spark, path).side == 32
    assert raster.load(spark, str(tmp_path / "mosaic")).width == WIDTH
    assert raster.load(spark, str(tmp_path / "mosaic" / "000000_000000.tif")).width == 128
    small = raster.load(spark, str(tmp_path / "a.asc"))
    assert small.north == 41.0 and small.pixels.where("value is null").count() == 1


def test_ascii_grids_are_read_by_blocks(spark, tmp_path):
    """A file of many blocks: each line has its row."""
    rows = [" ".join(str((r * 31 + c) % 500) for c in range(60)) for r in range(400)]
    (tmp_path / "b.asc").write_text("\n".join(["NCOLS 60", "NROWS 400", "XLLCORNER 44", "YLLCORNER 40", "CELLSIZE 0.01", "NODATA_VALUE 499", *rows, ""]))
    was = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
    try:
        found = raster.load(spark, str(tmp_path / "b.asc"))
        got = {(r.row, r.col): r.value for r in found.pixels.collect()}
        assert spark.read.text(str(tmp_path / "b.asc")).rdd.getNumPartitions() > 5
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", was)
    assert (found.width, found.height, found.north) == (60, 400, 44.0) and len(got) == 24_000
    assert all(v == (None if (r * 31 + c) % 500 == 499 else (r * 31 + c) % 500) for (r, c), v in got.items())
