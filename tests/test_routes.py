"""Placement along corridors with given sight, and a whole run over ready routes."""

from __future__ import annotations

import json

from pyspark.sql import functions as F

from meshwright.config import MeshConfig
from meshwright.functions import grid
from meshwright.plans import routes

CONFIG = MeshConfig(road_buffer_m=0.0, fallback_initial_search_radius_ladder_m=(), max_towers_per_route=5, gap_repair_rounds=0)


def ids(spark, n):
    rows = spark.range(n).select("id", grid.pack_id(F.lit(8), 8000 + F.col("id"), F.lit(8400)).alias("cell"))
    return {r.id: r.cell for r in rows.collect()}


def cells_of(spark, known, high=None):
    rows = [(c, float((high or {}).get(i, 100.0)), True, False) for i, c in known.items()]
    df = spark.createDataFrame(rows, "cell long, elevation double, has_road boolean, unfit boolean")
    return df.withColumn("lat", grid.lat_of(F.col("cell"))).withColumn("lon", grid.lon_of(F.col("cell"))).withColumn("los_lat", F.col("lat")).withColumn("los_lon", F.col("lon"))


def given(spark, known, visible):
    table = spark.createDataFrame([(min(known[a], known[b]), max(known[a], known[b]), 10.0) for a, b in visible] or [(-1, -1, 0.0)], "l long, h long, c double")

    def ask(pairs):
        found = pairs.join(table, (F.col("lo") == F.col("l")) & (F.col("hi") == F.col("h")), "left")
        same = F.col("lo") == F.col("hi")
        return found.select("lo", "hi", F.coalesce("c", F.when(same, 10.0), F.lit(-999.0)).alias("clearance"), (F.col("c").isNotNull() | same).alias("visible"))

    return ask


def test_chains_of_given_sight(spark):
    """Several corridors at once: skips, budgets, ends without a path, an existing tower."""
    cases = {
        0: (range(5), [(0, 3), (3, 4)], [0, 3, 4]),
        1: (range(10, 14), [(10, 11), (11, 13)], [10, 11, 13]),
        2: (range(20, 26), [(20, 21), (20, 22), (20, 24), (24, 25)], [20, 24, 25]),
        3: (range(30, 38), [], [30, 37]),
        4: (range(40, 46), [(a, b) for a in range(40, 46) for b in range(a + 1, 46)], [40, 43, 45]),
    }
    known = ids(spark, 50)
    place = {c: i for i, c in known.items()}
    corridors = spark.createDataFrame([(r, k, known[i]) for r, (span, _, _) in cases.items() for k, i in enumerate(span)], "route long, pos int, cell long")
    budgets = spark.createDataFrame([(r, 5) for r in cases], "route long, budget int")
    existing = spark.createDataFrame([(known[43],)], "cell long")
    sight = given(spark, known, [p for _, pairs, _ in cases.values() for p in pairs])
    rows = routes.place_along(corridors, budgets, cells_of(spark, known), existing, CONFIG, sight).collect()
    for r, (_, _, want) in cases.items():
        got = [place[x.cell] for x in sorted((x for x in rows if x.route == r), key=lambda x: x.pos)]
        assert got == want, (r, got)
    how = {place[x.cell]: x.algorithm for x in rows}
    assert how[3] == "dp" and how[30] == how[37] == "endpoint_fallback" and how[43] is None


def test_repair_moves_a_node(spark):
    """Neighbours that do not see each other: the cell beside the inner node that sees both is taken."""
    known = ids(spark, 40)
    place = {c: i for i, c in known.items()}
    config = MeshConfig(road_buffer_m=1000.0, gap_repair_rounds=1)
    chains = spark.createDataFrame([(0, 0, known[0], "dp", 3, None), (0, 10, known[10], "dp", 3, None), (0, 20, known[20], "dp", 3, None)], routes.CHAIN)
    sight = given(spark, known, [(0, 10), (0, 11), (11, 20)])
    broken = routes.broken_routes(chains, sight)
    assert broken.count() == 1
    fixed = routes.repaired(chains, broken, cells_of(spark, known, {11: 300.0}), spark.createDataFrame([], "cell long"), config, 1000.0, sight).orderBy("pos").collect()
    assert [place[r.cell] for r in fixed] == [0, 11, 20]
    assert [r.algorithm for r in fixed] == ["dp", "dp_repair", "dp"] and fixed[1].repair_round == 2  # 920 m away: beyond half the base, within the base


def test_lost_ends_go(spark):
    known = ids(spark, 30)
    rows = [(0, 0, known[0], "dp", 2, None), (0, 5, known[5], "endpoint_fallback", None, None), (0, 9, known[9], None, None, None)]
    sight = given(spark, known, [(0, 9)])
    kept = routes.without_lost_ends(spark.createDataFrame(rows, routes.CHAIN), sight).orderBy("pos").collect()
    assert [r.pos for r in kept] == [0, 9]


def test_run_over_routes(spark, tmp_path):
    spec = {"parameters": {"mast_height_m": 28.0, "h3_resolution": 8}, "routes": [{"route_id": "r0", "site1": {"name": "A", "lat": 40.02, "lon": 44.0, "site_height_m": 4.0}, "site2": {"name": "B", "lat": 40.02, "lon": 44.06}, "max_towers_per_route": 4, "features": [{"type": "Feature", "properties": {}, "geometry": {"type": "LineString", "coordinates": [[44.03, 40.02], [44.06, 40.02]]}}, {"type": "Feature", "properties": {}, "geometry": {"type": "LineString", "coordinates": [[44.03, 40.02], [44.0, 40.02]]}}]}]}
    (tmp_path / "routes.json").write_text(json.dumps(spec))
    config, found = routes.load(spark, str(tmp_path / "routes.json"))
    assert config.mast_height_m == 28.0 and config.h3_resolution == 8
    grid_cells = spark.range(20).crossJoin(spark.range(9).withColumnRenamed("id", "j")).select(grid.cell_of(F.lit(39.995) + F.col("j") * 0.006, F.lit(43.99) + F.col("id") * 0.005, 8).alias("cell")).distinct()
    cells = grid_cells.select("cell", F.lit(100.0).alias("elevation"), F.lit(True).alias("has_road"), F.lit(False).alias("unfit"), grid.lat_of(F.col("cell")).alias("lat"), grid.lon_of(F.col("cell")).alias("lon")).withColumn("los_lat", F.col("lat")).withColumn("los_lon", F.col("lon"))
    made = routes.run_routes(spark, found, cells, config)
    path = made["corridors"].orderBy("pos").collect()
    assert len(path) >= 5 and [r.pos for r in path] == list(range(len(path)))
    towers = made["towers"].collect()
    assert len(towers) >= 2 and {t.algorithm for t in towers} <= {"dp", "dp_repair", "endpoint_fallback", None}
    assert made["report"].first().towers == len(towers) and made["edges"].count() >= 1
    assert made["cells"].where("offset_m = 4").count() == 1


def a_site(name, lat, lon, height=0.0):
    return {"name": name, "lat": lat, "lon": lon, "site_height_m": height}


def a_route(name, a, b, lines, most=4, kind="LineString"):
    shapes = [{"type": "Feature", "properties": {}, "geometry": {"type": kind, "coordinates": x}} for x in lines]
    return {"route_id": name, "site1": a, "site2": b, "max_towers_per_route": most, "features": shapes}


def read(spark, tmp_path, *found, **parameters):
    (tmp_path / "routes.json").write_text(json.dumps({"parameters": {"mast_height_m": 40.0, "h3_resolution": 8, "auto_refine_h3_on_gradient": False} | parameters, "routes": list(found)}))
    return routes.load(spark, str(tmp_path / "routes.json"))


def flat(spark, rows, columns, west=43.99, south=39.995):
    made = spark.range(columns).crossJoin(spark.range(rows).withColumnRenamed("id", "j")).select(grid.cell_of(F.lit(south) + F.col("j") * 0.006, F.lit(west) + F.col("id") * 0.005, 8).alias("cell")).distinct()
    return made.select("cell", F.lit(100.0).alias("elevation"), F.lit(True).alias("has_road"), F.lit(False).alias("unfit"), grid.lat_of(F.col("cell")).alias("lat"), grid.lon_of(F.col("cell")).alias("lon")).withColumn("los_lat", F.col("lat")).withColumn("los_lon", F.col("lon"))


def test_a_tall_site_is_no_hill(spark):
    """A site's height raises its own mast; between others its ground is what it was."""
    known = ids(spark, 7)
    cells = cells_of(spark, known).withColumn("offset_m", F.when(F.col("cell") == known[3], 120.0).otherwise(0.0))
    seen = routes.sight_over(cells, MeshConfig(mast_height_m=40.0))(spark.createDataFrame([(known[0], known[6]), (known[0], known[3])], "lo long, hi long"))
    clear = {r.hi: (r.visible, r.clearance) for r in seen.collect()}
    assert clear[known[6]][0] and 10 < clear[known[6]][1] < 30 and clear[known[3]][0]


def test_routes_that_meet_share_towers_and_are_planned_in_order(spark, tmp_path):
    """Two routes from one site and a third far away: two waves, the same plan as one route after the other; ids, sources, heights and radii."""
    a, b, c = a_site("A", 40.02, 44.0, 4.0), a_site("B", 40.02, 44.04), a_site("C", 40.04, 44.0)
    d, e = a_site("D", 40.02, 44.5), a_site("E", 40.02, 44.53)
    config, found = read(spark, tmp_path, a_route("one", a, b, [[[44.0, 40.02], [44.04, 40.02]]]), a_route("two", a | {"site_height_m": 12.0}, c, [[[[44.0, 40.02], [44.0, 40.03]], [[44.0, 40.03], [44.0, 40.04]]]], kind="MultiLineString"), a_route("far", d, e, [[[44.5, 40.02], [44.53, 40.02]]]))
    made = routes.run_routes(spark, found, flat(spark, 9, 16), config)
    told = {r.route_id: r for r in made["routes"].collect()}
    assert [told[x].wave for x in ("one", "two", "far")] == [0, 1, 0] and not any(r.skipped for r in told.values())
    towers = made["towers"].orderBy("id").collect()
    assert [t.id for t in towers] == list(range(len(towers))) and len({t.cell for t in towers}) == len(towers)
    assert [t.source for t in towers if t.source == "site"] == ["site"] * 5  # A, B, C, D, E
    assert {t.source for t in towers} <= {"site", "one", "two", "far"} and towers[0].source == towers[1].source == "site"
    assert all(t.coverage_radius_m >= 0 for t in towers) and any(t.coverage_radius_m > 0 for t in towers)
    assert made["report"].first().virtual_towers == 5
    spot = spark.range(1).select(grid.cell_of(F.lit(40.02), F.lit(44.0), 8)).first()[0]
    assert made["cells"].where("offset_m > 0").select("cell", "offset_m").collect() == [(spot, 12.0)]
    # the far route's cells are not in the table and come with it
    assert made["cells"].where("lon > 44.4 and has_road").count() >= 4 and told["far"].corridor_cells >= 4
    ends = {r.a for r in made["corridor_edges"].collect()} | {r.b for r in made["corridor_edges"].collect()}
    assert ends and ends <= {t.id for t in towers}
    every = {(r.a, r.b) for r in made["edges"].collect()}
    assert {(r.a, r.b) for r in made["corridor_edges"].collect()} <= every
    alone = routes.run_routes(spark, found.where("ord < 2"), flat(spark, 9, 16), config)
    assert sorted((t.cell, t.source, t.algorithm) for t in alone["towers"].collect()) == sorted((t.cell, t.source, t.algorithm) for t in towers if t.lon < 44.4)


def test_city_anchors_stand_where_the_road_enters(spark, tmp_path):
    """Two roads into one city: each has an anchor at the edge, but for the one that another stands beside."""
    city = spark.range(1).select(F.struct("id").alias("id"), F.lit("X").alias("name"), F.expr("array(array(named_struct('lon', 43.98D, 'lat', 40.0D), named_struct('lon', 44.02D, 'lat', 40.0D), named_struct('lon', 44.02D, 'lat', 40.05D), named_struct('lon', 43.98D, 'lat', 40.05D), named_struct('lon', 43.98D, 'lat', 40.0D)))").alias("rings"))
    x, b, c = a_site("X", 40.02, 44.0, 9.0), a_site("B", 40.02, 44.06), a_site("C", 40.021, 44.06)
    config, found = read(spark, tmp_path, a_route("one", x, b, [[[44.0, 40.02], [44.06, 40.02]]]), a_route("two", x, c, [[[44.0, 40.021], [44.06, 40.021]]]))
    from meshwright.plans import mesh

    made = routes.run_routes(spark, found, mesh.marked(flat(spark, 9, 20).drop("unfit"), city), config, None, city)
    first = made["corridors"].where("pos = 0").orderBy("route").collect()
    outside = made["cells"].where("not unfit").select("cell")
    assert made["corridors"].join(outside, "cell", "left_anti").count() == 0
    anchors = [t.cell for t in made["towers"].where("source = 'site'").orderBy("id").collect()]
    assert first[0].cell in anchors and made["cells"].where("offset_m = 9").count() == 1
    assert len(anchors) == len({first[0].cell, *made["corridors"].groupBy("route").agg(F.max_by("cell", "pos")).toPandas().iloc[:, 1]})
    assert "city_link" in made["towers"].columns


def test_hidden_pairs_are_not_asked_for(spark):
    """A ridge between cells: the pairs across it are dropped by the peak beneath their line, and no sight is asked of them."""
    from meshwright.operators import dem, los

    known = ids(spark, 9)
    cells = cells_of(spark, known)
    spots = {r.cell: (r.lat, r.lon) for r in cells.collect()}
    west, north = min(x[1] for x in spots.values()) - 0.01, max(x[0] for x in spots.values()) + 0.02
    ridge = spots[known[4]][1]
    px = spark.range(100 * 40).select((F.col("id") / 100).cast("int").alias("row"), (F.col("id") % 100).cast("int").alias("col"))
    px = px.withColumn("value", F.when(F.abs(F.lit(west) + (F.col("col") + 0.5) * 0.001 - ridge) < 0.002, 900.0).otherwise(100.0))
    raster = dem.Raster(px, west, north, 0.001, 100, 40)
    config = MeshConfig(mast_height_m=30.0)
    pairs = spark.createDataFrame([(known[a], known[b]) for a in range(9) for b in range(a + 1, 9)], "lo long, hi long")
    shut = {(r.lo, r.hi) for r in routes.shade_over(cells, config, raster)(pairs).collect()}
    assert {(known[a], known[b]) for a in range(4) for b in range(5, 9)} <= shut
    assert not any((known[a], known[b]) in shut for a in range(3) for b in range(a + 1, 3))
    seen = los.evaluate(routes.mesh.pair_rows(pairs, cells, config), config, cells.select("cell", "elevation"), raster)
    assert not {(r.id.lo, r.id.hi) for r in seen.where("visible").collect()} & {p for p in shut if known[4] not in p}
    assert routes.shade_over(cells, config, None) is None
