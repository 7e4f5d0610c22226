"""Rasters as pixel tables, from Parquet or from plain-text grids; and grid bundles."""

from __future__ import annotations

import hashlib
import json

from pyarrow import fs as files
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from meshwright.operators.dem import Raster
from meshwright.sources import geotiff, tiles

BUNDLE_VERSION = 3


def from_pixels(pixels: DataFrame, west: float, north: float, px: float, width: int, height: int) -> Raster:
    """A raster over a table (row, col, value)."""
    return Raster(pixels.select("row", "col", F.col("value").cast("double").alias("value")), west, north, px, width, height)


def load_ascii_grid(spark: SparkSession, path: str) -> Raster:
    """A raster from an ESRI ASCII grid: six header lines, then a line for each row; the no-data value becomes null.

    The file is read by blocks, as any text: lines are numbered inside each block, and the lines of the blocks before are added.
    """
    text = spark.read.text(path).select("value", F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("m")).where(F.trim("value") != "")
    numbered = text.withColumn("n", F.row_number().over(W.partitionBy("block").orderBy("m")))
    before = F.sum("count").over(W.orderBy("block").rowsBetween(W.unboundedPreceding, -1))  # a row a block
    starts = text.groupBy("block").count().select(F.col("block").alias("b"), F.coalesce(before, F.lit(0)).alias("start"))
    lines = numbered.join(starts, F.col("block") == F.col("b")).select((F.col("start") + F.col("n") - 1).alias("line"), F.trim("value").alias("value"))
    head = {k.lower(): float(v) for k, v in (r["value"].split() for r in lines.where("line < 6").collect())}
    width, height, px = int(head["ncols"]), int(head["nrows"]), head["cellsize"]
    rows = lines.where((F.col("line") >= 6) & (F.col("line") < 6 + height)).select((F.col("line") - 6).cast("int").alias("row"), F.posexplode(F.split("value", r"\s+")).alias("col", "text"))
    value = F.col("text").cast("double")
    pixels = rows.select("row", "col", F.when(value != head["nodata_value"], value).alias("value"))
    return Raster(pixels, head["xllcorner"], head["yllcorner"] + height * px, px, width, height)


def load(spark: SparkSession, path: str) -> Raster:
    """A raster from a GeoTIFF file (or a folder of them), a tiled store, or an ASCII grid."""
    if path.lower().endswith((".tif", ".tiff")):
        return geotiff.load_geotiff(spark, path)
    if path.lower().endswith((".asc", ".txt", ".grd")):
        return load_ascii_grid(spark, path)
    system, name = geotiff.opened(path)
    if system.get_file_info(f"{name.rstrip('/')}/description").type == files.FileType.Directory:
        return tiles.read_tiles(spark, path)
    return geotiff.load_geotiff(spark, path)


def stable_sha256(value: object) -> str:
    """SHA-256 of a value's JSON with sorted keys."""
    return hashlib.sha256(json.dumps(value, sort_keys=True, separators=(",", ":")).encode()).hexdigest()


def file_metadata(spark: SparkSession, path: str) -> dict[str, int] | None:
    """size_bytes and mtime_ns of a file or folder (all its files together, the latest time), whatever store Spark reaches; null where there is none."""
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    store = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not store.exists(where):
        return None
    size, latest, found = 0, 0, store.listFiles(where, True)
    while found.hasNext():
        status = found.next()
        size, latest = size + status.getLen(), max(latest, status.getModificationTime())
    return {"size_bytes": size, "mtime_ns": latest * 1_000_000}


def elevation_of(meta: dict, path: str) -> str:
    """Where a bundle's raster lies: a relative path counts from the folder that holds the bundle, and so moves with it."""
    own = meta["elevation_path"]
    return own if own.startswith("/") or "://" in own else f"{path.rstrip('/').rsplit('/', 1)[0]}/{own}"


def write_bundle(cells: DataFrame, path: str, boundary: object, roads: object, elevation_path: str | None = None) -> None:
    """Write static cells (resolution, cell, kind, elevation, los_lat, los_lon), in order, and the bundle's metadata: what it was made from."""
    spark = cells.sparkSession
    cells.repartition("resolution").sortWithinPartitions("resolution", "kind", "cell").write.mode("overwrite").partitionBy("resolution").parquet(f"{path}/cells")
    resolutions = sorted(r[0] for r in cells.select("resolution").distinct().collect())  # at most 16
    source = {"resolution_set": resolutions, "boundary_sha256": stable_sha256(boundary), "roads_sha256": stable_sha256(roads)}
    meta = {"version": BUNDLE_VERSION, "elevation_path": elevation_path, "metadata": source}
    if elevation_path:
        source["elevation_path_abs"] = elevation_of(meta, path)
        source["elevation_file"] = file_metadata(spark, source["elevation_path_abs"])
    spark.createDataFrame([(json.dumps(meta, sort_keys=True),)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/bundle")


def read_bundle(spark: SparkSession, path: str, boundary: object = None, roads: object = None, fresh: bool = True) -> tuple[dict, DataFrame]:
    """Metadata and static cells of a bundle.

    An error: another version; a resolution without static values; with ``boundary`` or ``roads``, one made from others; and,
    where ``fresh``, a raster that is not the one it was made from any more (size, or time of change).
    """
    meta = json.loads(spark.read.text(f"{path}/bundle").first()[0])
    if meta.get("version") != BUNDLE_VERSION:
        raise ValueError(f"bundle version {meta.get('version')}; {BUNDLE_VERSION} is needed")
    told = meta.get("metadata") or {}
    for name, given in (("boundary", boundary), ("roads", roads)):
        if given is not None and stable_sha256(given) != told.get(f"{name}_sha256"):
            raise ValueError(f"the bundle was made from another {name}")
    if fresh and meta.get("elevation_path") and told.get("elevation_file"):
        now = file_metadata(spark, elevation_of(meta, path))
        if now != told["elevation_file"]:
            raise ValueError(f"the raster {meta['elevation_path']} is not the one of the bundle: {now}, not {told['elevation_file']}")
    cells = spark.read.parquet(f"{path}/cells")
    lacking = cells.groupBy("resolution").agg(F.max(F.col("elevation").isNotNull() & F.col("los_lat").isNotNull() & F.col("los_lon").isNotNull()).alias("some")).where("not some").collect()
    if lacking:
        raise ValueError(f"the bundle has no static values for resolutions {sorted(r['resolution'] for r in lacking)}")
    return meta, cells
