"""Bundles, and a route over a mesh of two resolutions, end to end."""

from __future__ import annotations

import json

import pytest
from pyspark.sql import functions as F

from meshwright import cli
from meshwright.config import MeshConfig
from meshwright.functions import grid
from meshwright.operators import adaptive, dem, sightbook
from meshwright.operators.stage import cut
from meshwright.sources import geotiff, raster

WEST, NORTH, PX, WIDTH, HEIGHT = 43.97, 40.06, 0.001, 120, 80


@pytest.fixture(scope="module")
def terrain(spark):
    """Flat in the west, a steep slope from 44.04 on."""
    row, col = (F.col("id") / WIDTH).cast("int"), (F.col("id") % WIDTH).cast("int")
    value = F.lit(100.0) + F.greatest(F.lit(0.0), (F.col("col") - 70) * 12.0)
    px = spark.range(WIDTH * HEIGHT).select(row.alias("row"), col.alias("col")).withColumn("value", value)
    return raster.from_pixels(px, WEST, NORTH, PX, WIDTH, HEIGHT)


@pytest.fixture(scope="module")
def static(spark, terrain):
    """Cells of both resolutions about a road along 40.02."""
    spots = spark.range(200).crossJoin(spark.range(16).withColumnRenamed("id", "j")).select((F.lit(40.0) + F.col("j") * 0.0025).alias("lat"), (F.lit(43.98) + F.col("id") * 0.0005).alias("lon"))
    made = None
    for resolution in (8, 9):
        cells = spots.select(grid.cell_of(F.col("lat"), F.col("lon"), resolution).alias("cell")).distinct()
        road = spark.range(400).select(grid.cell_of(F.lit(40.02), F.lit(43.99) + F.col("id") * 0.0002, resolution).alias("r")).distinct()
        placed = dem.anchors(cells, terrain, resolution).join(road, F.col("cell") == F.col("r"), "left")
        part = placed.select(F.lit(resolution).alias("resolution"), "cell", F.when(F.col("r").isNotNull(), "road").otherwise("full").alias("kind"), "elevation", "los_lat", "los_lon")
        made = part if made is None else made.unionByName(part)
    return cut(made)


def write(static, folder, terrain=None):
    if terrain is not None:
        geotiff.write_geotiff(terrain, f"{folder}/dem", side=64, tile=32).collect()
    raster.write_bundle(static, f"{folder}/bundle", {"b": 1}, {"r": [1, 2]}, "dem" if terrain is not None else None)


def test_bundles_are_checked(spark, static, terrain, tmp_path):
    write(static, str(tmp_path), terrain)
    path = str(tmp_path / "bundle")
    meta, cells = raster.read_bundle(spark, path, {"b": 1}, {"r": [1, 2]})
    assert meta["metadata"]["resolution_set"] == [8, 9] and cells.count() == static.count()
    assert raster.elevation_of(meta, path) == str(tmp_path / "dem") == meta["metadata"]["elevation_path_abs"]
    assert meta["metadata"]["elevation_file"]["size_bytes"] == sum(f.stat().st_size for f in (tmp_path / "dem").glob("*.tif"))
    ordered = [r.cell for r in spark.read.parquet(f"{path}/cells").where("resolution = 9 and kind = 'road'").collect()]
    assert ordered == sorted(ordered)
    for wrong in ({"boundary": {"b": 2}}, {"roads": []}):
        with pytest.raises(ValueError):
            raster.read_bundle(spark, path, **wrong)
    with open(next((tmp_path / "dem").glob("*.tif")), "ab") as f:
        f.write(b"more")
    with pytest.raises(ValueError):
        raster.read_bundle(spark, path)
    assert raster.read_bundle(spark, path, fresh=False)[0] == meta
    raster.write_bundle(static.withColumn("los_lat", F.when(F.col("resolution") == 8, F.col("los_lat"))), path, {}, {})
    with pytest.raises(ValueError):
        raster.read_bundle(spark, path)


def test_mesh_of_static_cells(spark, static):
    cells = adaptive.from_static(static, MeshConfig()).toPandas()
    assert set(cells.resolution) == {8, 9} and cells.cell.is_unique
    fine = cells[cells.resolution == 9]
    assert fine.refined.all() and (fine.gradient > 75).all() and (cells[cells.resolution == 8].gradient <= 75).all()
    assert not set(fine.base_cell) & set(cells[cells.resolution == 8].cell)
    for config in (MeshConfig(auto_refine_h3_on_gradient=False), MeshConfig(auto_refine_h3_max_resolution=8)):
        assert set(adaptive.from_static(static, config).toPandas().resolution) == {8}
    alone = static.where("resolution = 8")
    assert adaptive.from_static(alone, MeshConfig()).count() == alone.count()


def test_near_cells_count_both_edges(spark, static):
    cells = adaptive.from_static(static, MeshConfig()).withColumn("lat", grid.lat_of(F.col("cell"))).withColumn("lon", grid.lon_of(F.col("cell")))
    one = cells.where("has_road").limit(1)
    centre = one.select("cell", "lat", "lon", grid.edge_of(F.col("resolution")).alias("e")).first()
    from tests.test_waves import chord

    got = {r.cell for r in adaptive.near(cells, spark.createDataFrame([(centre.cell,)], "cell long"), 700.0).collect()}
    assert got == {r.cell for r in cells.withColumn("e", grid.edge_of(F.col("resolution"))).collect() if chord((r.lat, r.lon), (centre.lat, centre.lon)) <= 700 + r.e + centre.e}
    assert {r.cell for r in adaptive.near(cells, spark.createDataFrame([(centre.cell,)], "cell long"), 0.0).collect()} == {centre.cell}


def test_routes_command_over_a_mixed_mesh(spark, static, terrain, tmp_path):
    """The command reads the bundle's raster and plans over cells of both resolutions."""
    write(static, str(tmp_path), terrain)
    site = lambda name, lon: {"name": name, "lat": 40.02, "lon": lon}
    shape = {"type": "Feature", "properties": {}, "geometry": {"type": "LineString", "coordinates": [[44.0, 40.02], [44.065, 40.02]]}}
    spec = {"parameters": {"h3_resolution": 8, "mast_height_m": 30.0, "road_buffer_m": 0.0, "fallback_initial_search_radius_ladder_m": []}, "routes": [{"route_id": "up", "site1": site("A", 44.0), "site2": site("B", 44.065), "max_towers_per_route": 5, "features": [shape]}]}
    (tmp_path / "routes.json").write_text(json.dumps(spec))
    cli.main(["routes", "--routes", str(tmp_path / "routes.json"), "--grid-bundle", str(tmp_path / "bundle"), "--output", str(tmp_path / "out"), "--debug-snapshots", str(tmp_path / "debug"), "--sight-book", str(tmp_path / "book")])
    towers = [json.loads(r[0])["properties"] for r in spark.read.text(str(tmp_path / "out" / "towers.geojson")).collect()]
    cells = [json.loads(r[0])["properties"] for r in spark.read.text(str(tmp_path / "out" / "grid_cells.geojson")).collect()]
    assert {c["resolution"] for c in cells} == {8, 9}
    placed = sorted(towers, key=lambda t: t["lon"])
    assert placed[0]["source"] == placed[-1]["source"] == "site" and {t["route_id"] for t in towers} <= {"site", "up"}
    assert placed[0]["h3_index"] >> 56 == 8 and placed[-1]["h3_index"] >> 56 == 9
    assert placed[-1]["elevation_m"] > placed[0]["elevation_m"] == 100.0
    assert any(t["coverage_radius_m"] > 0 for t in towers)
    told = json.loads(spark.read.text(str(tmp_path / "debug")).first()["value"])
    assert told["route_id"] == "up" and told["corridor_cells"] == len(told["corridor"]) >= len(told["trimmed_corridor"]) > 5
    assert [n["cell"] for n in told["placement"]] and {a["city"] for a in told["anchors"]} == {False} and told["search_hexes"]
    hexes = [json.loads(r[0])["properties"] for r in spark.read.text(str(tmp_path / "out" / "gap_repair_hexes.geojson")).collect()]
    assert {h["phase"] for h in hexes} >= {"placement"} and all(h["gap_idx"] == h["gap"] and h["buffer_ring"] == h["ring"] for h in hexes)
    assert sightbook.SightBook(spark, str(tmp_path / "book")).answers().count() > 5
