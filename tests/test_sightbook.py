"""Answers kept between runs, their whole key, failures of single pairs, and reports."""

from __future__ import annotations

import dataclasses

import pytest
from pyspark.sql import functions as F

from meshwright.config import MeshConfig
from meshwright.functions import grid
from meshwright.operators import los, sightbook
from meshwright.plans import mesh
from tests.test_routes import cells_of, ids

CONFIG = MeshConfig(mast_height_m=30.0)


@pytest.fixture(scope="module")
def ground(spark):
    known = ids(spark, 12)
    return known, cells_of(spark, known, {5: 160.0})


def asked(spark, known, pairs):
    return spark.createDataFrame([(known.get(a, a), known.get(b, b)) for a, b in pairs], "src long, dst long")


def test_second_run_computes_nothing(spark, ground, tmp_path):
    known, cells = ground
    pairs = [(a, b) for a in range(12) for b in range(12) if a != b and (a + b) % 3]
    want = asked(spark, known, pairs)
    first = sightbook.SightBook(spark, str(tmp_path / "book"))
    one = sorted(map(tuple, sightbook.batch(want, cells, CONFIG, None, first, "a").drop("status").collect()))
    second = sightbook.SightBook(spark, str(tmp_path / "book"))
    kept = sightbook.batch(want, cells, CONFIG, None, second, "b")
    assert {r.status for r in kept.collect()} == {"kept"} and sorted(map(tuple, kept.drop("status").collect())) == one
    n = len({frozenset(p) for p in pairs})
    assert [tuple(r)[1:6] for r in first.report().collect()] == [(len(pairs), n, 0, n, 0)]
    assert [tuple(r)[1:6] for r in second.report().collect()] == [(len(pairs), n, n, 0, 0)]
    assert first.report().first().visible == second.report().first().visible == sum(r[-2] for r in one)
    # as without a book
    plain = los.evaluate(mesh.pair_rows(los.canonical(want), cells, CONFIG), CONFIG, cells.select("cell", "elevation"))
    assert sorted((r.id.lo, r.id.hi, r.visible, round(r.clearance_m, 6)) for r in plain.collect()) == [(r[0], r[1], r[7], round(r[3], 6)) for r in one]
    # some are new
    third = sightbook.SightBook(spark, str(tmp_path / "book"))
    sightbook.batch(asked(spark, known, [*pairs, (0, 3), (3, 0)]), cells, CONFIG, None, third, "c")
    assert [tuple(r)[1:6] for r in third.report().collect()] == [(len(pairs) + 2, n + 1, n, 1, 0)]


def test_every_part_of_the_key_counts(spark, ground, tmp_path):
    known, cells = ground
    want = asked(spark, known, [(0, 7), (7, 0), (1, 4)])
    path = str(tmp_path / "book")
    sightbook.batch(want, cells, CONFIG, None, sightbook.SightBook(spark, path))
    other = [dataclasses.replace(CONFIG, **{k: (getattr(CONFIG, k) or 1) * 2}) for k in sightbook.PARAMETERS] + [dataclasses.replace(CONFIG, mast_height_m=31.0)]
    assert len({sightbook.setting_of(c) for c in other}) == len(other) and sightbook.setting_of(CONFIG, "x") != sightbook.setting_of(CONFIG)
    moved = cells.withColumn("los_lat", F.col("los_lat") + F.when(F.col("cell") == known[7], 2e-6).otherwise(0.0))
    raised = cells.withColumn("offset_m", F.when(F.col("cell") == known[1], 3.0).otherwise(0.0))
    for config, ground_, terrain, hits in ((CONFIG, cells, "", 2), (other[0], cells, "", 0), (CONFIG, cells, "hills", 0), (CONFIG, moved, "", 1), (CONFIG, raised, "", 1), (CONFIG, moved.withColumn("los_lat", F.col("lat") + 1e-8), "", 2)):
        book = sightbook.SightBook(spark, path, terrain)
        rows = sightbook.endpoints(los.canonical(want), ground_, config)
        assert book.lookup(rows, config).where("gate is not null").count() == hits


def test_a_bad_pair_fails_alone(spark, ground, tmp_path):
    known, cells = ground
    bad = cells.withColumn("elevation", F.when(F.col("cell") == known[2], F.lit(float("nan"))).otherwise(F.col("elevation"))).withColumn("los_lat", F.when(F.col("cell") == known[3], F.lit(123.0)).otherwise(F.col("los_lat")))
    want = asked(spark, known, [(0, 1), (0, 2), (1, 3), (1, 999), (998, 1), (2, 3), (0, 3), (4, 4)])
    book = sightbook.SightBook(spark, str(tmp_path / "book"))
    found = {(r.lo, r.hi): r for r in sightbook.batch(want, bad, CONFIG, None, book, "x").collect()}
    assert len(found) == 8 and found[known[0], known[1]].status == "computed" and found[known[4], known[4]].visible
    failed = {k: r.error for k, r in found.items() if r.status == "failed"}
    assert len(failed) == 6 and failed[999, known[1]] == "no cell 999" and "height" in failed[known[0], known[2]] and "place" in failed[known[1], known[3]]
    told = book.report().first()
    assert (told.requested, told.unique, told.computed, told.failed) == (8, 8, 2, 6) and len(told.samples) == 5
    assert book.answers().count() == 2  # no failure is kept
    with pytest.raises(RuntimeError, match="6 of 8"):
        sightbook.batch(want, bad, CONFIG, strict=True)
    total = book.summary().where("stage is null").first()
    assert (total.calls, total.failed, total.computed) == (1, 6, 2) and total.pair_s > 0


def test_answers_are_not_shuffled(spark, ground, tmp_path):
    known, cells = ground
    book = sightbook.SightBook(spark, str(tmp_path / "book"))
    rows = sightbook.endpoints(los.canonical(asked(spark, known, [(0, 1)])), cells, CONFIG)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = book.lookup(rows, CONFIG)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    above = plan.split(book.table)[0]
    above = above[above.rindex("Sort [__lo") :]
    assert "SelectedBucketsCount" in plan or "Bucketed: true" in plan
    assert "SortMergeJoin" in plan and "Exchange" not in above  # sorted in its buckets, not moved


def test_empty_batch(spark, ground, tmp_path):
    known, cells = ground
    book = sightbook.SightBook(spark, str(tmp_path / "book"))
    assert sightbook.batch(asked(spark, known, [(0, 1)]).limit(0), cells, CONFIG, None, book).count() == 0
    assert tuple(book.report().first())[1:6] == (0, 0, 0, 0, 0)
