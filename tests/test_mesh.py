"""A whole plan on a small region, and a stream."""

from __future__ import annotations

from pyspark.sql import functions as F

from meshwright.config import MeshConfig
from meshwright.functions import grid
from meshwright.plans import mesh
from meshwright.sources import raster
from meshwright.streaming import telemetry


def test_plan(spark):
    ring = "array(named_struct('lon', {w}, 'lat', {s}), named_struct('lon', {e}, 'lat', {s}), named_struct('lon', {e}, 'lat', {n}), named_struct('lon', {w}, 'lat', {n}))".format(w="44.0D", e="44.06D", s="40.0D", n="40.05D")
    boundary = spark.range(1).select("id", F.expr(f"array({ring})").alias("rings"))
    roads = spark.createDataFrame([(0, 0, 0, 44.005, 40.02), (0, 0, 1, 44.055, 40.02), (1, 0, 0, 44.03, 40.005), (1, 0, 1, 44.03, 40.045)], "feature int, part int, seq int, lon double, lat double")
    sites = spark.createDataFrame([(0, 0, "A", 40.02, 44.008, 1, 0.0), (1, 1, "B", 40.02, 44.052, 1, 0.0), (2, 2, "C", 40.04, 44.03, 2, 0.0)], "id long, ord int, name string, lat double, lon double, priority int, site_height_m double").withColumn("cell", grid.cell_of(F.col("lat"), F.col("lon"), 8))
    px = spark.range(70 * 70).select((F.col("id") / 70).cast("int").alias("row"), (F.col("id") % 70).cast("int").alias("col"), F.lit(100.0).alias("value"))
    made = mesh.plan_mesh(spark, MeshConfig(mast_height_m=28.0, max_towers_per_route=4), boundary, roads, sites, raster.from_pixels(px, 43.99, 40.06, 0.001, 70, 70))
    r = made["report"].first()
    assert r.virtual_towers == 3 and r.towers >= 3 and r.cells > 10
    assert r.clusters == 1 and r.coverage_pct > 50
    assert made["edges"].count() >= 2


def test_windows(spark):
    rows = spark.createDataFrame([("2024-01-01 00:10:00", "a", 1.0), ("2024-01-01 00:50:00", "a", 3.0), ("2024-01-01 01:10:00", "a", 5.0)], "ts string, kind string, value double").withColumn("ts", F.col("ts").cast("timestamp"))
    assert sorted((r.n, r.least, r["mean"]) for r in telemetry.windowed(rows).collect()) == [(1, 5.0, 5.0), (2, 1.0, 2.0)]
