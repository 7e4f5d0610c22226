"""Sight between all members of places: the same as pair by pair, whatever the grounds of a place."""

from __future__ import annotations

from pyspark.sql import functions as F

from meshwright.functions import grid
from meshwright.operators import dem, los, sightlines, spatial
from meshwright.plans import bindings as b


def standing(spark, n=36):
    """Masts on nine places, with grounds of their own."""
    rows = spark.range(n).select("id", (F.lit(40.0) + (F.col("id") % 9) * 0.0041).alias("lat"), (F.lit(44.0) + (F.col("id") % 9) * (F.col("id") % 9) * 0.0013).alias("lon"), (F.lit(900.0) + (F.col("id") * 31) % 47 * 5).alias("ground"))
    return rows.withColumn("mast", F.lit(b.TIGHT.mast_height_m)).withColumn("cell", grid.cell_of(F.col("lat"), F.col("lon"), b.RESOLUTION))


def hills(spark):
    px = spark.range(2500).select(F.floor(F.col("id") / 50).cast("int").alias("row"), (F.col("id") % 50).cast("int").alias("col"), (F.lit(880.0) + (F.col("id") * 7919) % 211).alias("value"))
    return dem.Raster(px.where("value > 900"), b.WEST, b.NORTH, b.PX, b.WIDTH, 50)


def rounded(df):
    return {(r.id1, r.id2, round(r.clearance_m, 6), round(r.path_loss_db, 6), r.visible, r.gate) for r in df.collect()}


def test_sight_of_members_is_that_of_their_pairs(spark):
    rows = standing(spark)
    of = spatial.kinds(rows, own=("ground",))
    assert of.rows.count() == 9 and of.members.count() == 36
    pairs = spatial.pairs_within(rows, 2500.0).withColumn("id", F.struct("id1", "id2"))
    for raster in (None, hills(spark)):
        got = rounded(sightlines.sights(spatial.kind_pairs(of, 2500.0), of, b.TIGHT, raster))
        want = los.evaluate(pairs, b.TIGHT, None, raster).select("id.id1", "id.id2", "clearance_m", "path_loss_db", "visible", "gate")
        assert got == rounded(want)
        assert {g[-1] for g in got} == ({"same", "coarse", "dense"} if raster else {"same", "coarse"})


def test_refinement_ends_with_the_sample_budget(spark):
    import dataclasses

    rows = standing(spark, 18)
    of = spatial.kinds(rows, own=("ground",))
    pairs = spatial.pairs_within(rows, 2500.0).withColumn("id", F.struct("id1", "id2"))
    tight = dataclasses.replace(b.TIGHT, los_dense_max_samples=40)
    got = rounded(sightlines.sights(spatial.kind_pairs(of, 2500.0), of, tight, hills(spark)))
    assert got == rounded(los.evaluate(pairs, tight, None, hills(spark)).select("id.id1", "id.id2", "clearance_m", "path_loss_db", "visible", "gate"))
