"""Rows at one place: pairs of kinds repeated for their members, and lines of no length."""

from __future__ import annotations

from pyspark.sql import functions as F

from meshwright.config import MeshConfig
from meshwright.operators import coverage, dem, los, placement, spatial, waves


def standing(spark, n=40):
    """Points on seven places, by the remainder of their id."""
    return spark.range(n).select("id", (F.lit(40.0) + (F.col("id") % 7) / F.lit(100.0)).alias("lat"), F.lit(44.0).alias("lon"), (F.col("id") % 3).cast("double").alias("ground"))


def test_a_line_of_no_length_is_not_rejected(spark):
    pixels = spark.createDataFrame([(0, 0, 500.0)], "row int, col int, value double")
    raster = dem.Raster(pixels, 44.0, 40.1, 0.2, 1, 1)
    pairs = spark.createDataFrame([(1, 40.0, 44.1, 40.0, 44.1, 10.0, 10.0, 20.0, 20.0)], "id int, lat1 double, lon1 double, lat2 double, lon2 double, ground1 double, ground2 double, mast1 double, mast2 double")
    assert [r.rejected for r in los.shadow_prefilter(pairs, raster, MeshConfig()).collect()] == [False]


def test_pairs_of_kinds_are_the_pairs_of_their_members(spark):
    rows = standing(spark)
    for names in (["id", "lat", "lon"], ["id", "lat", "lon", "ground"]):
        some = rows.select(*names)
        of = spatial.kinds(some)
        found = spatial.each(spatial.kind_pairs(of, 1500.0).select("id1", "id2", "lat1", "lat2"), of, of, ordered=True).collect()
        want = spatial.pairs_within(some, 1500.0).select("id1", "id2", "lat1", "lat2").collect()
        assert len(found) == len(want) and set(found) == set(want)


def test_what_depends_on_places_is_computed_once_a_kind(spark):
    of = spatial.kinds(standing(spark, 700).select("id", "lat", "lon"))
    assert of.rows.count() == 7 and of.members.count() == 700
    assert spatial.kind_pairs(of, 1500.0).count() == 7 + 2 * 6


def test_a_large_kind_is_dealt_in_parts(spark):
    of = spatial.kinds(spark.range(2500).select("id", F.lit(40.0).alias("lat"), F.lit(44.0).alias("lon")))
    assert of.members.select("part").distinct().count() == 3
    found = spatial.each(spatial.kind_pairs(of, 100.0).select("id1", "id2"), of, of, ordered=True)
    assert found.count() == 2500 * 2499 // 2 and found.rdd.getNumPartitions() >= spatial.spread(spark)


def test_rows_that_are_alone_are_their_own_kinds(spark):
    some = standing(spark, 7).select("id", "lat", "lon")
    of = spatial.kinds(some)
    assert of.members is None
    assert set(spatial.each(spatial.kind_pairs(of, 1500.0).select("id1", "id2"), of, of, ordered=True).collect()) == set(spatial.pairs_within(some, 1500.0).select("id1", "id2").collect())


def test_nearest_of_places_with_many_sites(spark):
    points, sites = standing(spark).select("id", "lat", "lon"), standing(spark, 30).select("id", "lat", "lon")
    for k in (1, 3):
        for radius in (1500.0, None):
            found = spatial.nearest(points, sites, radius, k).select("id1", "rank", "id2").collect()
            gap = {(p, s): abs(p % 7 - s % 7) for p in range(40) for s in range(30)}
            want = {(p, rank, s) for p in range(40) for rank, s in enumerate(sorted((s for s in range(30) if radius is None or gap[p, s] <= 1), key=lambda s: (gap[p, s], s))[:k], 1)}
            one = {(p, r, s) for p, r, s in found if abs(p % 7 - s % 7) == 0}
            assert one == {(p, r, s) for p, r, s in want if gap[p, s] == 0} and len(found) == len(want)


def test_sites_of_one_place_go_to_an_earlier_one_there(spark):
    rows = [(i, i, 1 + i % 2, 40.0 + (i % 3) / 100, 44.0) for i in range(24)]
    sites = spark.createDataFrame(rows, "id long, ord long, priority int, lat double, lon double")
    found = {(r.a, r.b) for r in placement.priority_links(sites).where("level = 2").collect()}
    want = set()
    for a in rows:
        if a[2] == 2:
            near = [x for x in rows if x[2] < a[2] or (x[2] == a[2] and x[1] < a[1])]
            want.add((a[0], min(near, key=lambda x: (round(abs(x[3] - a[3]), 4), x[1]))[0]))
    assert found == want


def test_many_points_a_place_keep_their_first(spark):
    rows = [(i, 100 - i, 40.0 + (i % 5) / 100, 44.0) for i in range(50)]
    got = {r.id: (r.kept, r.by) for r in waves.first_fit(spark.createDataFrame(rows, "id long, ord long, lat double, lon double"), 1200.0).collect()}
    kept, want = [], {}
    for i, ord_, lat, _ in sorted(rows, key=lambda r: r[1]):
        near = [(abs(lat - x[2]), x[1], x[0]) for x in kept if abs(lat - x[2]) < 0.0105]
        want[i] = (not near, min(near)[2] if near else None)
        kept += [] if near else [(i, ord_, lat)]
    assert {i: k for i, (k, _) in got.items()} == {i: k for i, (k, _) in want.items()} and {i for i, (k, by) in got.items() if not k and by is None} == set()


def test_waves_in_blocks_and_long_chains(spark, monkeypatch):
    monkeypatch.setattr(waves, "BLOCK", 16)
    claims = [(r, c) for r in range(90) for c in ((r % 4, 9) if r < 60 else (100 + r,))]
    last: dict = {}
    want = {}
    for r in range(90):
        cells = [c for q, c in claims if q == r]
        want[r] = 1 + max(last.get(c, -1) for c in cells)
        last.update(dict.fromkeys(cells, want[r]))
    found = waves.waves(spark.createDataFrame(claims, "route long, cell long"))
    assert {x.route: x.wave for x in found.collect()} == want and max(want.values()) == 59


def test_links_that_stand_for_several(spark):
    links = spark.createDataFrame([(1, 5, 5, 10, 3, 0.0, 4), (1, 6, 6, 9, 3, 0.0, 0), (1, 7, 7, 12, 1, 0.0, 2)], "cell long, source long, ord long, distance_m long, path_loss_db long, clearance_m double, n long")
    r = coverage.aggregate_links(links).first()
    assert (r.n_visible, r.closest_id, r.serving_id) == (6, 6, 7)


def test_requests_are_dealt_before_they_are_counted(spark):
    asked = spark.createDataFrame([(1, 2), (2, 1), (3, 3), (1, 2), (2, 3), (None, 4)], "src long, dst long")
    found = los.requests(asked)
    assert {tuple(r) for r in found.collect()} == {(1, 2, 3), (3, 3, 1), (2, 3, 1), (4, 4, 1)}
    plan = los.requests(asked)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and "Join" not in plan


def test_corridors_are_dealt_by_route_once(spark):
    from pyspark.sql import Window as W

    from meshwright.plans import bindings as b

    rows = b.corridors(spark, "/root/testdata/sf0.001").withColumn("next", F.lead("cell").over(W.partitionBy("route").orderBy("pos")))
    assert rows._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") == 1
