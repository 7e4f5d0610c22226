"""Operators on small fixtures with known answers."""

from __future__ import annotations

import json

import pytest
from pyspark.sql import functions as F

from meshwright.config import MeshConfig
from meshwright.functions import grid
from meshwright.operators import adaptive, corridor, coverage, dem, los, network, placement, spatial
from meshwright.sources import export, geojson, raster


def dp(spark, n, visible, k=10):
    edges = spark.createDataFrame([(1, i, j, 10.0) for i, j in visible], "route long, i int, j int, clearance double")
    last = spark.createDataFrame([(1, n)], "route long, last int")
    found = placement.best_paths(edges, last, k).collect()
    return found[0].path if found else None


@pytest.mark.parametrize(
    ("n", "visible", "path"),
    [(4, [(0, 3), (3, 4)], [0, 3, 4]), (3, [(0, 1), (1, 3)], [0, 1, 3]), (5, [(0, 1), (0, 2), (0, 4), (4, 5)], [0, 4, 5]), (7, [(0, 1), (0, 4), (0, 6), (6, 7)], [0, 6, 7]), (7, [(1, 2)], None)],
)
def test_placement(spark, n, visible, path):
    assert dp(spark, n, visible, 4) == path


def test_placement_prefers_positive_then_best(spark):
    edges = spark.createDataFrame([(1, 0, 2, -5.0), (1, 0, 1, 3.0), (1, 1, 2, 2.0), (2, 0, 1, -9.0), (2, 0, 2, -4.0), (2, 1, 2, -1.0)], "route long, i int, j int, clearance double")
    last = spark.createDataFrame([(1, 2), (2, 2)], "route long, last int")
    found = {r.route: (r.towers, r.quality, r.path) for r in placement.best_paths(edges, last, 3).collect()}
    assert found == {1: (3, 2.0, [0, 1, 2]), 2: (2, -4.0, [0, 2])}


def chain_of(spark, n, elevation=None):
    return spark.createDataFrame([(1, i, i, float((elevation or {}).get(i, 100))) for i in range(n)], "route long, pos int, cell long, elevation double")


def test_prune_and_select(spark):
    seen = spark.createDataFrame([(0, 1), (1, 2), (2, 3), (0, 2)], "lo long, hi long")
    assert [r.cell for r in placement.prune_redundant(chain_of(spark, 4), seen).orderBy("pos").collect()] == [0, 2, 3]
    adjacent = spark.createDataFrame([(i, i + 1) for i in range(4)], "lo long, hi long")
    kept = [r.cell for r in placement.select_nodes(chain_of(spark, 5), adjacent, 3).orderBy("pos").collect()]
    assert len(kept) == 3 and kept[0] == 0 and kept[-1] == 4


def test_gap_repair_moves_inner_cells_only():
    sees = {(0, 9): 5.0, (2, 9): 7.0}
    look = lambda a, b: 1.0 if a == b else sees.get((min(a, b), max(a, b)))
    near = lambda c, r: [(c, 100.0, 0.0), (9, 120.0, 10.0)]
    assert placement.repair([0, 1, 2], look, near, set(), 100.0) == ([0, 9, 2], {9: 1})
    assert placement.repair([0, 1, 2], look, near, {1}, 100.0) == ([0, 1, 2], {})
    radii = []
    placement.repair([0, 1, 2], lambda a, b: None, lambda c, r: radii.append(r) or [], set(), 100.0)
    assert sorted(radii) == [50.0, 50.0, 100.0, 100.0, 150.0, 150.0]  # half of one, two and three times the base


def test_gap_repair_widens_one_gap_before_the_next():
    """The first gap takes its third round before the second is tried; an end that does not move must see its outer neighbour too."""
    sees = {(0, 11): 4.0, (3, 4): 2.0, (2, 11): 3.0, (2, 3): 1.0, (3, 12): 9.0, (4, 12): 9.0}
    look = lambda a, b: 1.0 if a == b else sees.get((min(a, b), max(a, b)))
    near = lambda c, r: [(c, 0.0, 0.0)] + ([(11, 50.0, 140.0)] if c == 1 and r >= 150 else [])
    assert placement.repair([0, 1, 2, 3, 4], look, near, set(), 100.0) == ([0, 11, 2, 3, 4], {11: 3})
    sees = {(1, 11): 5.0, (3, 11): 4.0, (2, 3): 1.0, (3, 4): 1.0}
    near = lambda c, r: [(c, 0.0, 0.0)] + ([(11, 50.0, 40.0)] if c == 2 else [])
    assert placement.repair([0, 1, 2, 3, 4], look, near, set(), 100.0) == ([0, 1, 2, 3, 4], {})
    sees[0, 1] = 1.0
    assert placement.repair([0, 1, 2, 3, 4], look, near, set(), 100.0) == ([0, 1, 11, 3, 4], {11: 1})


def test_components_and_isolated_nodes(spark):
    nodes = spark.createDataFrame([(i,) for i in range(8)], "id long")
    edges = spark.createDataFrame([(0, 1), (1, 2), (5, 6), (6, 5), (3, 3)], "a long, b long")
    found = {r.id: r.component for r in network.components(nodes, edges).collect()}
    assert found == {0: 0, 1: 0, 2: 0, 3: 3, 4: 4, 5: 5, 6: 5, 7: 7}


def test_routing_graph_bridges_a_gap_with_two_steps(spark):
    start = spark.range(1).select(grid.cell_of(F.lit(40.0), F.lit(44.0), 8).alias("cell"))
    cells = start.select(F.explode(F.array("cell", grid.shifted(F.col("cell"), F.lit(2), F.lit(0)))).alias("cell")).withColumn("elevation", F.lit(100.0))
    assert network.routing_graph(cells, 1).count() == 0
    assert [r.cost for r in network.routing_graph(cells, 2).collect()] == [2.0, 2.0]


def test_shortest_paths(spark):
    edges = spark.createDataFrame([(0, 1, 1.0), (1, 2, 1.0), (0, 2, 5.0), (2, 3, 1.0)], "src long, dst long, cost double")
    ask = spark.createDataFrame([(7, 0, 3), (8, 3, 0), (9, 0, 42)], "route long, src long, dst long")
    assert [(r.route, r.cost, r.path) for r in network.shortest_paths(edges, ask).collect()] == [(7, 3.0, [0, 1, 2, 3])]


def test_corridor_steps(spark):
    rows = spark.createDataFrame([(1, i, c) for i, c in enumerate([5, 5, 6, 6, 5, 7])], "route long, pos int, cell long")
    plain = corridor.without_repeats(rows, ["pos"])
    assert [r.cell for r in plain.orderBy("pos").collect()] == [5, 6, 5, 7]
    first = corridor.first_visits(plain)
    assert [r.cell for r in first.orderBy("pos").collect()] == [5, 6, 7]
    ends = spark.createDataFrame([(1, 4, 7)], "route long, first long, last long")
    assert [r.cell for r in corridor.with_ends(first, ends).orderBy("pos").collect()] == [4, 5, 6, 7]


def test_order_features_flips(spark):
    f = spark.createDataFrame([(1, 0, 0.0, 2.0, 0.0, 3.0, 0.0, 0.0), (1, 1, 0.0, 1.9, 0.0, 1.0, 0.0, 0.0), (1, 2, 0.0, 0.0, 0.0, 1.0, 0.0, 0.0)], "route long, feature long, lat1 double, lon1 double, lat2 double, lon2 double, slat double, slon double")
    assert [(r.feature, r.flip) for r in corridor.order_features(f).orderBy("ord").collect()] == [(2, False), (1, True), (0, False)]


def flat(spark, value=100.0, n=60):
    px = spark.range(n * n).select((F.col("id") / n).cast("int").alias("row"), (F.col("id") % n).cast("int").alias("col"), F.lit(value).alias("value"))
    return px, dict(west=44.0, north=40.06, px=0.001, width=n, height=n)


def test_elevation(spark):
    px, where = flat(spark)
    r = raster.from_pixels(px.withColumn("value", F.when((F.col("row") == 10) & (F.col("col") == 20), 1234.0).otherwise(F.col("value"))), **where)
    points = spark.createDataFrame([(1, 40.0495, 44.0205), (2, 50.0, 44.0), (3, 40.03, 44.03)], "id long, lat double, lon double")
    assert {p.id: p.elevation for p in dem.nearest_value(points, r).collect()} == {1: 1234.0, 2: 0.0, 3: 100.0}
    assert {p.id: round(p.elevation, 6) for p in dem.bilinear_value(points.where("id = 3"), r).collect()} == {3: 100.0}
    cell = points.where("id = 1").select(grid.cell_of(F.col("lat"), F.col("lon"), 8).alias("cell"))
    a = dem.anchors(cell, r, 8, 0.0).first()
    assert a.elevation == 1234.0 and abs(a.los_lat - 40.0495) < 1e-9
    assert dem.anchors(cell, r, 8, 1e6).first().elevation == 1234.0
    line = spark.createDataFrame([(1, 40.0495, 44.0005, 40.0495, 44.0405), (2, 40.0495, 44.0405, 40.0495, 44.0005)], "id long, lat1 double, lon1 double, lat2 double, lon2 double")
    peaks = {p.id: (p.peak_m, round(p.fraction, 6)) for p in dem.line_peaks(line, r).collect()}
    assert peaks == {1: (1234.0, 0.5), 2: (1234.0, 0.5)}


def link(spark, ground=100.0, mast=20.0, lon2=44.05):
    p = spark.createDataFrame([(1, 40.03, 44.005, 40.03, lon2, ground, ground, mast, mast)], "id long, lat1 double, lon1 double, lat2 double, lon2 double, ground1 double, ground2 double, mast1 double, mast2 double")
    return p.withColumn("cell1", grid.cell_of(F.col("lat1"), F.col("lon1"), 8)).withColumn("cell2", grid.cell_of(F.col("lat2"), F.col("lon2"), 8))


def test_line_of_sight_over_ridge_and_flat(spark):
    px, where = flat(spark)
    open_ = los.evaluate(link(spark), MeshConfig(), None, raster.from_pixels(px, **where)).first()
    assert open_.visible and open_.gate == "dense" and open_.clearance_m > 0
    ridge = px.withColumn("value", F.when(F.col("col").between(25, 30), 1800.0).otherwise(F.col("value")))
    shut = los.evaluate(link(spark), MeshConfig(), None, raster.from_pixels(ridge, **where)).first()
    assert not shut.visible and shut.clearance_m < 0
    tight = MeshConfig(tx_power_mw=1.0, antenna_gain_dbi=0.0, receiver_sensitivity_dbm=-60.0)
    assert los.evaluate(link(spark), tight).first().gate in ("distance", "budget")
    assert los.evaluate(link(spark, lon2=44.005), MeshConfig()).first().gate == "same"


def test_coverage_serving_and_closest(spark):
    links = spark.createDataFrame([(1, 1, 1, 600.0, 130.0, 5.0), (1, 2, 2, 900.0, 100.0, 9.0)], "cell long, source long, ord long, distance_m double, path_loss_db double, clearance_m double")
    r = coverage.aggregate_links(links).first()
    assert (r.n_visible, r.closest_id, r.serving_id, r.serving_loss_db) == (2, 1, 2, 100.0)


def test_range_join_equals_brute_force(spark):
    rows = spark.range(60).select(F.col("id"), (F.lit(40.0) + (F.col("id") * 37 % 60) / 500).alias("lat"), (F.lit(44.0) + (F.col("id") * 53 % 60) / 500).alias("lon"))
    near = {(r.id1, r.id2) for r in spatial.pairs_within(rows, 3000).collect()}
    a, b = [rows.select([F.col(c).alias(f"{c}{i}") for c in rows.columns]) for i in (1, 2)]
    from meshwright.functions import geo

    every = a.crossJoin(b).where("id1 < id2").where(geo.chord_m(F.col("lat1"), F.col("lon1"), F.col("lat2"), F.col("lon2")) <= 3000)
    assert near == {(r.id1, r.id2) for r in every.collect()} and near


def test_range_join_knows_no_edge_of_the_map(spark):
    """Across the antimeridian, near a pole and on it."""
    rows = spark.createDataFrame([(0, 40.0, 179.999), (1, 40.0, -179.9986), (2, 85.0, 10.0), (3, 85.0, 10.247), (4, 90.0, 0.0), (5, 89.99, 120.0), (6, 0.0, 0.0)], "id long, lat double, lon double")
    assert {(r.id1, r.id2) for r in spatial.pairs_within(rows, 2500).collect()} == {(0, 1), (2, 3), (4, 5)}


def test_pixels_overlap_cells(spark):
    """A pixel wider than cells belongs to all of them, and a cell takes pixels that only its corner enters."""
    from meshwright.operators import dem
    from meshwright.sources import raster

    px = spark.createDataFrame([(0, 0, 5.0), (0, 1, 9.0)], "row int, col int, value double")
    wide = dem.touched_cells(raster.from_pixels(px, 44.0, 40.05, 0.05, 2, 1), 8)
    counts = {r.value: r["count"] for r in wide.groupBy("value").count().collect()}
    assert all(30 < n < 60 for n in counts.values())
    inside = corridor.polyfill(spark.range(1).select("id", F.expr("array(array(named_struct('lon', 44.0D, 'lat', 40.0D), named_struct('lon', 44.05D, 'lat', 40.0D), named_struct('lon', 44.05D, 'lat', 40.05D), named_struct('lon', 44.0D, 'lat', 40.05D)))").alias("rings")), 8)
    assert inside.join(wide.where("value = 5"), "cell", "left_anti").count() == 0
    assert {r.elevation for r in dem.highest(wide).collect()} == {5.0, 9.0}


def test_polyfill_and_adaptive(spark):
    square = spark.range(1).select("id", F.expr("array(array(named_struct('lon', 44.0D, 'lat', 40.0D), named_struct('lon', 44.05D, 'lat', 40.0D), named_struct('lon', 44.05D, 'lat', 40.05D), named_struct('lon', 44.0D, 'lat', 40.05D)))").alias("rings"))
    cells = corridor.polyfill(square, 8)
    n = cells.count()
    assert 25 < n < 40
    gradients = cells.select("cell", F.when(F.col("cell") == cells.agg(F.min("cell")).first()[0], 99.0).otherwise(0.0).alias("gradient"))
    mesh = adaptive.mesh(cells, adaptive.targets(gradients, 8, 9), 8)
    counts = {r.resolution: r.cells for r in adaptive.summary(mesh).collect()}
    assert counts[8] == n - 1 and 5 <= counts[9] <= 9
    inside = mesh.where("resolution = 9").select(F.lit(1).alias("id"), grid.lat_of(F.col("cell")).alias("lat"), grid.lon_of(F.col("cell")).alias("lon"), F.col("cell").alias("want")).limit(1)
    assert adaptive.locate(inside, mesh, 8, 9).first().cell == inside.first().want


def test_geojson_and_exports(spark, tmp_path):
    ring = [[0, 0], [0, 2], [2, 2], [2, 0], [0, 0]]
    small = [[5, 5], [5, 6], [6, 6], [6, 5], [5, 5]]
    doc = {"type": "FeatureCollection", "features": [{"type": "Feature", "properties": {"name": "x"}, "geometry": {"type": "MultiPolygon", "coordinates": [[small], [ring]]}}]}
    (tmp_path / "b.geojson").write_text(json.dumps(doc))
    assert geojson.load_boundary(spark, str(tmp_path / "b.geojson")).first().rings[0][1].lat == 2
    sites = {"type": "FeatureCollection", "features": [{"type": "Feature", "properties": {"name": "A", "priority": 1}, "geometry": {"type": "Point", "coordinates": [44.0, 40.0]}}, {"type": "Feature", "properties": {}, "geometry": {"type": "Point", "coordinates": [44.1, 40.1]}}]}
    (tmp_path / "s.geojson").write_text(json.dumps(sites))
    got = [(r.name, r.priority, r.lat) for r in geojson.load_sites(spark, str(tmp_path / "s.geojson"), 8).orderBy("ord").collect()]
    assert got == [("A", 1, 40.0), ("Site_1", 999, 40.1)]
    towers = spark.createDataFrame([(1, 40.0, 44.0, "dp"), (2, 40.1, 44.1, "endpoint_fallback")], "id long, lat double, lon double, algorithm string")
    edges = spark.createDataFrame([(1, 2, 10.0, 100.0, -1.0, 0.2, "x")], "a long, b long, distance_m double, path_loss_db double, clearance_m double, obstruction double, origin string")
    f = json.loads(export.edge_features(edges, towers).first().feature)
    assert f["geometry"]["coordinates"] == [[44.0, 40.0], [44.1, 40.1]]
    assert f["properties"]["is_nlos"] and f["properties"]["link_type"] == "red"


def test_sites_by_centroid(spark, tmp_path):
    """Points, a line by length, a square with a hole, and towers that stand already."""
    shapes = [("Point", [44.0, 40.0]), ("LineString", [[0, 0], [4, 0], [4, 2]]), ("Polygon", [[[0, 0], [4, 0], [4, 4], [0, 4], [0, 0]], [[0, 0], [2, 0], [2, 4], [0, 4], [0, 0]]])]
    doc = {"type": "FeatureCollection", "features": [{"type": "Feature", "properties": {"name": str(i)}, "geometry": {"type": k, "coordinates": c}} for i, (k, c) in enumerate(shapes)]}
    (tmp_path / "s.geojson").write_text(json.dumps(doc))
    got = {r.name: (round(r.lon, 9), round(r.lat, 9)) for r in geojson.load_sites(spark, str(tmp_path / "s.geojson"), 8).collect()}
    assert got == {"0": (44.0, 40.0), "1": (round((4 * 2 + 2 * 4) / 6, 9), round(2 / 6, 9)), "2": (3.0, 2.0)}
    tower = geojson.load_towers(spark, str(tmp_path / "s.geojson"), 8).collect()
    assert [(r.source, r.ord < 0) for r in tower] == [("existing", True)]


def test_site_priorities(spark):
    sites = spark.createDataFrame([(0, 0, 40.0, 44.0, 1), (1, 1, 40.0, 44.1, 1), (2, 2, 40.0, 44.09, 2)], "id long, ord long, lat double, lon double, priority int")
    assert {(r.a, r.b, r.level) for r in placement.priority_links(sites).collect()} == {(0, 1, 1), (2, 1, 2)}
