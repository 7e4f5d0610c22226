"""Closed-form values of physics, geometry and the grid."""

from __future__ import annotations

import math

import pytest
from pyspark.sql import functions as F

from meshwright.config import MeshConfig, output_path
from meshwright.functions import geo, grid, physics


def one(spark, *columns):
    return spark.range(1).select(*[c.alias(f"c{i}") for i, c in enumerate(columns)]).first()


def test_free_space_loss(spark):
    row = one(spark, physics.fspl_db(F.lit(1000.0), 868e6), physics.fspl_db(F.lit(physics.max_fspl_distance_m(868e6, 120.0)), 868e6))
    assert row[0] == pytest.approx(20 * math.log10(868) + 32.44)
    assert row[1] == pytest.approx(120.0, abs=1e-6)
    assert physics.max_fspl_distance_m(868e6, 0) == 0


def test_path_loss_and_invalid_input(spark):
    free, blocked = one(spark, physics.path_loss_db(F.lit(1e4), 868e6, F.lit(10.0)), physics.path_loss_db(F.lit(1e4), 868e6, F.lit(-5.0)))
    assert free == pytest.approx(20 * math.log10(10) + 20 * math.log10(868) + 32.44)
    assert blocked > free + 6
    with pytest.raises(ValueError):
        physics.path_loss_db(F.lit(1.0), 0, F.lit(0.0))
    with pytest.raises(Exception, match="positive"):
        one(spark, physics.path_loss_db(F.lit(-100.0), 868e6, F.lit(1.0)))


def test_obstruction_rule(spark):
    assert list(one(spark, *[physics.obstruction_accepts(F.lit(x)) for x in (0.25, 0.40, 0.41)])) == [True, True, False]


def test_edge_cost(spark):
    assert list(one(spark, *[physics.edge_cost(F.lit(0.0), F.lit(x)) for x in (50.0, 51.0, 101.0)])) == [1.0, 1.5, 2.5]


def test_geodesic(spark):
    far, zero, degree = one(spark, geo.geodesic_m(F.lit(40.7128), F.lit(-74.0060), F.lit(51.5074), F.lit(-0.1278)), geo.geodesic_m(F.lit(1.0), F.lit(1.0), F.lit(1.0), F.lit(1.0)), geo.geodesic_m(F.lit(0.0), F.lit(0.0), F.lit(0.0), F.lit(1.0)))
    assert 5.5e6 < far < 5.6e6
    assert zero == 0
    assert degree == pytest.approx(111319.4908, abs=1e-3)


def test_line_fraction_and_local(spark):
    t, low, flat = one(spark, geo.line_fraction(F.lit(40.0), F.lit(44.5), F.lit(40.0), F.lit(44.0), F.lit(40.0), F.lit(45.0)), geo.line_fraction(F.lit(40.0), F.lit(43.0), F.lit(40.0), F.lit(44.0), F.lit(40.0), F.lit(45.0)), geo.line_fraction(F.lit(1.0), F.lit(1.0), F.lit(2.0), F.lit(2.0), F.lit(2.0), F.lit(2.0)))
    assert (t, low, flat) == (pytest.approx(0.5), 0.0, 0.0)
    x, y = geo.to_local(F.lit(40.01), F.lit(44.02), F.lit(40.0), F.lit(44.0))
    assert list(one(spark, *geo.from_local(x, y, F.lit(40.0), F.lit(44.0)))) == [pytest.approx(40.01), pytest.approx(44.02)]


def test_polygon_with_hole(spark):
    square = lambda a, b: f"array(named_struct('lon', {a}D, 'lat', {a}D), named_struct('lon', {b}D, 'lat', {a}D), named_struct('lon', {b}D, 'lat', {b}D), named_struct('lon', {a}D, 'lat', {b}D))"
    rings = F.expr(f"array({square(0, 10)}, {square(4, 6)})")
    assert list(one(spark, *[geo.in_polygon(F.lit(x), F.lit(x), rings) for x in (1.0, 5.0, 11.0)])) == [True, False, False]
    assert one(spark, geo.ring_area(F.get(rings, F.lit(0))))[0] == 100


def test_grid_round_trip_ring_and_path(spark):
    cell = grid.cell_of(F.lit(40.0), F.lit(44.0), 8)
    row = spark.range(1).select(cell.alias("c")).select("c", grid.ring(F.col("c"), 1).alias("r"), grid.disk(F.col("c"), 4).alias("d"), grid.cell_of(grid.lat_of(F.col("c")), grid.lon_of(F.col("c")), 8).alias("again"), grid.resolution_of(F.col("c")).alias("res"), grid.is_valid(F.col("c")).alias("ok")).first()
    assert row.again == row.c and row.res == 8 and row.ok
    assert len(set(row.r)) == 6 and len(set(row.d)) == 61
    far = spark.range(1).select(cell.alias("a"), grid.cell_of(F.lit(40.05), F.lit(44.07), 8).alias("b")).select(grid.path_cells(F.col("a"), F.col("b")).alias("p"), grid.grid_distance(F.col("a"), F.col("b")).alias("n"), "a", "b").first()
    assert len(far.p) == far.n + 1 and far.p[0] == far.a and far.p[-1] == far.b
    steps = spark.createDataFrame(list(zip(far.p, far.p[1:], strict=False)), "a long, b long").select(grid.grid_distance(F.col("a"), F.col("b")).alias("d"))
    assert {r.d for r in steps.collect()} == {1}
    mixed = one(spark, grid.path_cells(grid.cell_of(F.lit(40.0), F.lit(44.0), 8), grid.cell_of(F.lit(40.0), F.lit(44.0), 9)))
    assert mixed[0] is None


def test_children_partition_their_parents(spark):
    cells = spark.range(1).select(F.explode(grid.disk(grid.cell_of(F.lit(40.0), F.lit(44.0), 8), 1)).alias("cell"))
    kids = [r.k for r in cells.select(F.explode(grid.children(F.col("cell"), 8, 9)).alias("k")).collect()]
    assert len(kids) == len(set(kids)) and 40 <= len(kids) <= 58
    assert 400 < grid.edge_m(8) < 600


def test_config():
    c = MeshConfig()
    assert c.link_budget_db == pytest.approx(167.9897, abs=1e-4)
    assert c.max_visibility_m == 200_000
    assert MeshConfig.of({"max_visibility_m": 5, "mast_height_m": 28}).mast_height_m == 28
    with pytest.warns(DeprecationWarning):
        MeshConfig.of({"los_parallel_workers": 4})
    with pytest.raises(TypeError):
        MeshConfig.of({"unknown": 1})
    assert output_path("towers", {}, "/x") == "/x/towers.geojson"
    assert output_path("towers", {"towers": "own.geojson"}, "/x") == "own.geojson"
