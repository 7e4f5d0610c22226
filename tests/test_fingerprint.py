"""Digests that do not depend on order or partitions, and what they tell apart; linear pairs, relays."""

from __future__ import annotations

from pyspark.sql import functions as F

from meshwright.functions import grid
from meshwright.operators import corridor, fingerprint, placement


def one(df):
    return tuple(fingerprint.fingerprint(df).first())


def test_order_partitions_and_columns_do_not_matter(spark):
    df = spark.range(500).select("id", (F.col("id") / 7).alias("x"), F.create_map(F.lit("b"), F.col("id"), F.lit("a"), F.lit(1)).alias("m"), F.array(F.struct((F.col("id") * 0.1).alias("q"))).alias("s"))
    want = one(df)
    assert one(df.repartition(7, "x").orderBy(F.desc("id"))) == want and one(df.select("s", "m", "x", "id")) == want and want[0] == 500
    turned = df.withColumn("m", F.create_map(F.lit("a"), F.lit(1).cast("long"), F.lit("b"), F.col("id")))
    assert one(turned) == want
    assert one(df.withColumn("x", F.col("x") + 1e-9)) == want and one(df.withColumn("x", F.col("x") + 1e-3)) != want


def test_what_is_told_apart(spark):
    rows = lambda *x: spark.createDataFrame(x, "a string, b string")
    tables = [rows(("x", "y")), rows(("y", "x")), rows(("x", "y"), ("x", "y")), rows(("x", "y"), ("x", "y"), ("x", "y")), rows(("x", None)), rows((None, "x")), rows(), rows((None, None)), rows(("", None))]
    assert len({one(t) for t in tables}) == len(tables)
    assert one(spark.createDataFrame([(-0.0,)], "x double")) == one(spark.createDataFrame([(0.0,)], "x double"))


def test_repeated_runs_and_files(spark, tmp_path):
    steady = lambda: {"a": spark.range(100).groupBy((F.col("id") % 7).alias("k")).agg(F.sum("id").alias("n"))}
    assert [r.same for r in fingerprint.repeated(spark, steady, (1, 3, 8)).collect()] == [True] * 3
    state = iter(range(10))
    unsteady = lambda: {"a": spark.range(3 + next(state))}
    assert [r.same for r in fingerprint.repeated(spark, unsteady, (2, 2)).orderBy("run").collect()] == [True, False]
    for folder, text in (("p", "one"), ("q", "two")):
        (tmp_path / folder / "deep").mkdir(parents=True)
        (tmp_path / folder / "deep" / "a.txt").write_text(text)
        (tmp_path / folder / "b.txt").write_text("same")
        (tmp_path / folder / "_SUCCESS").write_text("")
    (tmp_path / "q" / "c.txt").write_text("more")
    p, q = (fingerprint.file_fingerprints(spark, str(tmp_path / x)) for x in "pq")
    assert sorted(r.path for r in p.collect()) == ["b.txt", "deep/a.txt"]
    assert sorted(r.path for r in fingerprint.changed(p, q).collect()) == ["c.txt", "deep/a.txt"] and fingerprint.changed(p, p).isEmpty()


def winding(spark, n):
    """Two routes of cells; the first turns back, so that a position far on comes near again."""
    step = F.col("id")
    cells = spark.range(n).select(F.lit(1).alias("route"), step.cast("int").alias("pos"), grid.pack_id(F.lit(8), 8000 + F.when(step < n // 2, step).otherwise(n - step), 8400 + F.when(step < n // 2, 0).otherwise(1)).alias("cell"))
    cells = cells.union(spark.range(n).select(F.lit(2), (step * 3).cast("int"), grid.pack_id(F.lit(8), 8000 + step, F.lit(8400))))
    return cells.withColumn("lat", grid.lat_of(F.col("cell"))).withColumn("lon", grid.lon_of(F.col("cell"))).withColumn("unfit", F.lit(False))


def test_forward_pairs_stop_at_the_first_that_is_too_far(spark):
    rows = winding(spark, 40)
    from meshwright.functions import geo

    two = rows.select(F.col("route").alias("r2"), F.col("pos").alias("j"), F.col("lat").alias("lat2"), F.col("lon").alias("lon2"))
    every = rows.join(two, (F.col("route") == F.col("r2")) & (F.col("pos") < F.col("j"))).withColumn("far", geo.geodesic_m(F.col("lat"), F.col("lon"), F.col("lat2"), F.col("lon2")))
    far = {(r.route, r.pos, r.j): r.far for r in every.collect()}
    spots = {route: sorted({k[1] for k in far if k[0] == route} | {k[2] for k in far if k[0] == route}) for route in (1, 2)}
    want = set()
    for route, places in spots.items():
        for a, i in enumerate(places):
            for j in places[a + 1 :]:
                if far[route, i, j] > 5000:
                    break
                want.add((route, i, j))
    assert {(r.route, r.i, r.j) for r in placement.forward_pairs(rows, 5000.0).collect()} == want


def test_relays_until_every_part_is_short(spark):
    rows = winding(spark, 60).where("route = 2").select("route", "pos", "cell")
    ends = rows.where("pos in (0, 177)")
    from meshwright.functions import geo

    filled = placement.fill_gaps(ends, rows, 9000.0).orderBy("pos").collect()
    place = {r.cell: (r.lat, r.lon) for r in rows.select("cell", grid.lat_of(F.col("cell")).alias("lat"), grid.lon_of(F.col("cell")).alias("lon")).collect()}
    at = spark.createDataFrame([(i, *place[a.cell], *place[b.cell]) for i, (a, b) in enumerate(zip(filled, filled[1:], strict=False))], "i int, a double, b double, c double, d double")
    assert at.where(geo.geodesic_m(F.col("a"), F.col("b"), F.col("c"), F.col("d")) > 9000).isEmpty() and len(filled) > 4
    assert placement.fill_gaps(ends, ends, 9000.0).count() == 2  # no cell to put one on


def test_best_cells_beside_a_road(spark):
    road = winding(spark, 30).where("route = 2").select("route", "pos", "cell", "lat", "lon")
    beside = road.select("route", F.explode(grid.disk(F.col("cell"), 2)).alias("cell")).distinct().join(road.select("cell"), "cell", "left_anti")
    offered = beside.select("route", "cell", grid.lat_of(F.col("cell")).alias("lat"), grid.lon_of(F.col("cell")).alias("lon"), (F.col("cell") % 97).cast("double").alias("elevation"))
    wide = corridor.best_buffer_cells(offered, road, 1e6)
    assert sorted(map(tuple, corridor.best_buffer_cells(offered, road, 4000.0).collect())) == sorted(map(tuple, wide.collect())) and wide.count() > 20


def test_forward_pairs_meet_those_beyond_the_window(spark):
    """A position with more cells in reach than the window holds meets all of them; one on a short route makes no join."""
    at = [(1, p, 40.0 + (p if p < 60 else 600) * 1e-4, 44.0, False) for p in range(70)] + [(2, p * 2, 41.0 + p * 0.02, 44.0, False) for p in range(5)]
    rows = spark.createDataFrame(at, "route long, pos int, lat double, lon double, unfit boolean")
    found = {(r.route, r.i, r.j) for r in placement.forward_pairs(rows, 5000.0).collect()}
    want = {(1, i, j) for i in range(60) for j in range(i + 1, 60)} | {(1, i, j) for i in range(60, 70) for j in range(i + 1, 70)} | {(2, i, i + 2) for i in range(0, 8, 2)} | {(2, i, i + 4) for i in range(0, 6, 2)}
    within = {(1, i, j) for i in range(60) for j in range(60, 70) if (600 - i) * 1e-4 * 111032 <= 5000}
    assert {x for x in found if not (x[0] == 1 and x[1] < 60 <= x[2])} == want and all(x in found for x in within)
    short = placement.forward_pairs(rows.where("route = 2"), 5000.0)
    assert " Join" not in short._jdf.queryExecution().optimizedPlan().toString()


def test_slopes_are_ranked_in_the_window_of_their_route(spark):
    from meshwright.functions import geo

    rows = winding(spark, 40).withColumn("elevation", ((F.col("pos") * 37 + F.col("route")) % 101).cast("double"))
    w = "lead({0}) over (partition by route order by pos)"
    ahead = rows.selectExpr("route", "cell", "elevation", w.format("cell") + " c2", w.format("elevation") + " e2").where("c2 is not null")
    far = geo.geodesic_m(*[of(F.col(c)) for c in ("cell", "c2") for of in (grid.lat_of, grid.lon_of)])
    slopes = ahead.withColumn("d", far).where("d > 1").groupBy("route").agg(F.percentile(F.abs(F.col("e2") - F.col("elevation")) / (F.col("d") / 1000), 0.9).alias("s"))
    want = {r.route: r.s for r in slopes.collect()}
    found = corridor.slope_percentile(rows)
    got = {r.route: r.slope for r in found.collect()}
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-6 * want[k] for k in want)
    assert "percentile" not in found._jdf.queryExecution().optimizedPlan().toString()


def test_geodesics_of_arrays_are_those_of_columns(spark):
    from meshwright.functions import geo

    rows = spark.range(200).select((F.lit(40.0) + F.col("id") * 0.001).alias("a"), (F.lit(44.0) + F.col("id") * 0.002).alias("b"), (F.lit(40.1) - F.col("id") * 0.001).alias("c"), F.when(F.col("id") != 7, F.lit(44.1)).alias("d"))
    both = rows.select(*[f(*[F.col(c) for c in "abcd"]).alias(n) for f, n in ((geo.geodesic_m, "x"), (geo.geodesic_rows, "y"))]).collect()
    assert all((r.x is None) == (r.y is None) and (r.x is None or abs(r.x - r.y) < 1e-7) for r in both)
    assert [r[0] for r in rows.limit(1).select(geo.geodesic_rows(F.col("a"), F.col("b"), F.col("a"), F.col("b"))).collect()] == [0.0]


def test_tables_are_dealt_into_more_parts_the_more_they_are_read_in(spark):
    for parts in (1, 6):
        table = spark.range(600).repartition(parts)
        some = fingerprint.dealt(table)
        assert some.rdd.getNumPartitions() == parts * int(spark.conf.get("spark.sql.shuffle.partitions"))
        sizes = some.groupBy(F.spark_partition_id()).count()
        assert sizes.agg(F.sum("count")).first()[0] == 600 and one(some) == one(table)
    assert max(r["count"] for r in sizes.collect()) < 100
