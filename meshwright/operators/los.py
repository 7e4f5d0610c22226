"""Line of sight between pairs of cells: profiles, Fresnel summaries and the decision cascade.

``pairs`` have id, and per end lat, lon (the anchor) and height (ground plus mast), with
the suffixes 1 and 2.  Cheap gates run as filters before any profile is exploded, and
the dense profile only for pairs that the coarse one lets pass.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from meshwright.config import MeshConfig
from meshwright.functions import geo, grid, physics
from meshwright.operators import dem, spatial
from meshwright.operators.stage import cut

BLOCKED_CLEARANCE, NO_LOSS = -999.0, 999.0
#: Samples of the refinement, and how many of the worst are refined.
REFINE_STEP_M, WORST = 10.0, 3


def canonical(pairs: DataFrame, a: str = "src", b: str = "dst") -> DataFrame:
    """Distinct unordered pairs (lo, hi)."""
    return pairs.select(F.least(a, b).alias("lo"), F.greatest(a, b).alias("hi")).distinct()


def fan_out(requested: DataFrame, results: DataFrame, a: str = "src", b: str = "dst") -> DataFrame:
    """Results of canonical pairs for every requested, directed pair."""
    return requested.withColumn("lo", F.least(a, b)).withColumn("hi", F.greatest(a, b)).join(results, ["lo", "hi"])


def requests(asked: DataFrame, a: str = "src", b: str = "dst") -> DataFrame:
    """(lo, hi, asked): the distinct unordered pairs, and how many directed requests each of them answers.

    Pairs are dealt before they are counted: where most are asked once, a count beforehand would hold nearly all rows of a task
    and save none.
    """
    pairs = asked.select(F.least(a, b).alias("lo"), F.greatest(a, b).alias("hi"))
    return pairs.repartition(spatial.spread(asked.sparkSession), "lo", "hi").groupBy("lo", "hi").agg(F.count(F.lit(1)).alias("asked"))


def merged_profile(samples: DataFrame) -> DataFrame:
    """(id, fraction, terrain): the highest terrain of each fraction (6 digits)."""
    return samples.groupBy("id", F.bround("fraction", 6).alias("fraction")).agg(F.max("terrain").alias("terrain"))


def coarse_profile(pairs: DataFrame, cells: DataFrame, raster: dem.Raster | None = None) -> DataFrame:
    """(id, fraction, terrain): ends and the cells of the grid path between cell1 and cell2.

    A cell of ``cells`` (cell, elevation) gives its elevation, another the raster's point
    elevation, and is left out without a raster.  Cells of mixed resolutions give the ends only.
    """
    middle = between_ends(pairs, cells, raster)
    ends = pairs.select("id", F.explode(F.array(F.struct(F.lit(0.0).alias("fraction"), F.col("ground1").alias("terrain")), F.struct(F.lit(1.0).alias("fraction"), F.col("ground2").alias("terrain")))).alias("e")).select("id", "e.*")
    return merged_profile(middle.union(ends))


def between_ends(pairs: DataFrame, cells: DataFrame, raster: dem.Raster | None = None) -> DataFrame:
    """(id, fraction, terrain): ``coarse_profile`` without the ends, fractions as they are."""
    inner = pairs.select("id", "cell1", "cell2", "lat1", "lon1", "lat2", "lon2", F.explode(grid.path_cells(F.col("cell1"), F.col("cell2"))).alias("cell")).where("cell != cell1 and cell != cell2")
    placed = inner.withColumn("lat", grid.lat_of(F.col("cell"))).withColumn("lon", grid.lon_of(F.col("cell")))
    known = placed.join(cells.select(F.col("cell").alias("__c"), F.col("elevation").alias("__e")), F.col("cell") == F.col("__c"), "left")
    known = dem.nearest_value(known, raster, "__p") if raster is not None else known.withColumn("__p", F.lit(None).cast("double"))
    fraction = geo.line_fraction(F.col("lat"), F.col("lon"), F.col("lat1"), F.col("lon1"), F.col("lat2"), F.col("lon2"))
    return known.select("id", fraction.alias("fraction"), F.coalesce("__e", "__p").alias("terrain")).where("terrain is not null")


def dense_profile(pairs: DataFrame, raster: dem.Raster, step_m: float = 50.0, most: int = 400) -> DataFrame:
    """(id, fraction, terrain): ends, and bilinear terrain at equal steps between them."""
    n = F.least(F.greatest(F.lit(2), F.floor(F.col("distance_m") / step_m).cast("int")), F.lit(max(most, 2)))
    rows = pairs.withColumn("n", n).withColumn("i", F.explode(F.sequence(F.lit(1), F.col("n") - 1)))
    t = F.col("i") / F.col("n")
    points = rows.select("id", "i", t.alias("fraction"), (F.col("lat1") + (F.col("lat2") - F.col("lat1")) * t).alias("lat"), (F.col("lon1") + (F.col("lon2") - F.col("lon1")) * t).alias("lon")).withColumn("key", F.struct("id", "i"))
    middle = dem.bilinear_value(points, raster, "key", "terrain").select("id", "fraction", "terrain")
    ends = pairs.select("id", F.explode(F.array(F.struct(F.lit(0.0).alias("fraction"), F.col("ground1").alias("terrain")), F.struct(F.lit(1.0).alias("fraction"), F.col("ground2").alias("terrain")))).alias("e")).select("id", "e.*")
    return middle.union(ends)


def sample_metrics(pairs: DataFrame, profile: DataFrame, config: MeshConfig) -> DataFrame:
    """Profile points with d1, d2, fresnel, geometric, clearance and obstruction."""
    keyed = profile.join(pairs.select("id", "distance_m", "height1", "height2"), "id").where("distance_m > 0")
    m = physics.sample_metrics(F.col("fraction"), F.col("terrain"), F.col("distance_m"), F.col("height1"), F.col("height2"), config.wavelength_m, config.effective_earth_radius_m)
    return keyed.withColumn("m", m).select("id", "fraction", "terrain", "distance_m", "m.*")


def summary(metrics: DataFrame) -> DataFrame:
    """(id, clearance, d1, d2, obstruction): least clearance and where, and the largest obstruction of the interior (else of all)."""
    interior = (F.col("fraction") > 0) & (F.col("fraction") < 1)
    worst = F.struct("clearance", "fraction")
    return metrics.groupBy("id").agg(
        F.min_by(F.struct("clearance", "d1", "d2"), worst).alias("w"),
        F.coalesce(F.max(F.when(interior, F.col("obstruction"))), F.max("obstruction")).alias("obstruction"),
    ).select("id", "w.clearance", "w.d1", "w.d2", "obstruction")


def refine(pairs: DataFrame, metrics: DataFrame, raster: dem.Raster, most: int = 400) -> DataFrame:
    """More samples, every 10 m, beside the worst points of each profile, while the sample budget lasts.

    The neighbours of a point are those by fraction, in the sorted profile, whatever order its samples came in.
    """
    order = W.partitionBy("id").orderBy("fraction")
    near = metrics.withColumn("before", F.lag("fraction").over(order)).withColumn("after", F.lead("fraction").over(order)).withColumn("have", F.count(F.lit(1)).over(W.partitionBy("id")))
    rank = F.row_number().over(W.partitionBy("id").orderBy(F.desc("obstruction"), "clearance", "fraction"))
    spans = near.withColumn("rank", rank).where((F.col("rank") <= WORST) & (F.col("have") < most)).select("id", "rank", "have", "distance_m", F.coalesce("before", "fraction").alias("lo"), F.coalesce("after", "fraction").alias("hi")).where("hi > lo")
    n = F.floor((F.col("hi") - F.col("lo")) * F.col("distance_m") / REFINE_STEP_M).cast("int")
    added = spans.withColumn("n", n).where("n > 1").withColumn("i", F.explode(F.sequence(F.lit(1), F.col("n") - 1)))
    added = added.withColumn("fraction", F.col("lo") + (F.col("hi") - F.col("lo")) * F.col("i") / F.col("n"))
    added = added.withColumn("place", F.row_number().over(W.partitionBy("id").orderBy("rank", "i"))).where(F.col("place") <= F.lit(most) - F.col("have"))
    ends = pairs.select(F.col("id").alias("__id"), "lat1", "lon1", "lat2", "lon2")
    points = added.join(ends, F.col("id") == F.col("__id")).select("id", "place", "fraction", (F.col("lat1") + (F.col("lat2") - F.col("lat1")) * F.col("fraction")).alias("lat"), (F.col("lon1") + (F.col("lon2") - F.col("lon1")) * F.col("fraction")).alias("lon")).withColumn("key", F.struct("id", "place"))
    return dem.bilinear_value(points, raster, "key", "terrain").select("id", "fraction", "terrain")


def decide(links: DataFrame, config: MeshConfig) -> DataFrame:
    """Links (distance_m, clearance, d1, d2, obstruction) with path_loss_db, the gates and ``visible``."""
    loss = physics.path_loss_db(F.col("distance_m"), config.frequency_hz, F.col("clearance"), F.col("d1"), F.col("d2"))
    budget = F.lit(config.link_budget_db)
    out = links.withColumn("path_loss_db", loss)
    out = out.withColumn("budget_ok", F.col("path_loss_db") <= budget).withColumn("fresnel_ok", physics.obstruction_accepts(F.col("obstruction")))
    return out.withColumn("visible", F.col("budget_ok") & F.col("fresnel_ok"))


def evaluate(pairs: DataFrame, config: MeshConfig, cells: DataFrame | None = None, raster: dem.Raster | None = None, refined: bool = True) -> DataFrame:
    """Line of sight of pairs: id, clearance_m, path_loss_db, distance_m, obstruction, visible, gate.

    ``pairs`` have id, cell1, cell2, lat, lon, ground and mast per end.  Gates in order:
    the same cell, distance beyond visibility, free-space loss over the budget, the coarse
    profile, and with a raster the dense one, whose values then replace the coarse ones.
    """
    far = geo.geodesic_m(F.col("lat1"), F.col("lon1"), F.col("lat2"), F.col("lon2"))
    rows = pairs.withColumn("distance_m", far).withColumn("height1", F.col("ground1") + F.col("mast1")).withColumn("height2", F.col("ground2") + F.col("mast2"))
    rows = rows.withColumn("fspl", F.when(F.col("distance_m") > 0, physics.fspl_db(F.col("distance_m"), config.frequency_hz)).otherwise(F.lit(0.0)))
    gate = F.when((F.col("cell1") == F.col("cell2")) | (F.col("distance_m") == 0), "same").when(F.col("distance_m") > config.max_visibility_m, "distance").when(F.col("fspl") > config.link_budget_db, "budget").otherwise("profile")
    rows = cut(rows.withColumn("gate", gate))
    null = F.lit(None).cast("double")
    same = rows.where("gate = 'same'").select("id", F.least("mast1", "mast2").alias("clearance_m"), F.lit(0.0).alias("path_loss_db"), "distance_m", F.lit(0.0).alias("obstruction"), F.lit(True).alias("visible"), "gate")
    off = rows.where("gate in ('distance', 'budget')").select("id", F.lit(BLOCKED_CLEARANCE).alias("clearance_m"), F.when(F.col("gate") == "distance", F.lit(NO_LOSS)).otherwise(F.col("fspl")).alias("path_loss_db"), "distance_m", F.when(F.col("gate") == "distance", null).otherwise(F.lit(1.0)).alias("obstruction"), F.lit(False).alias("visible"), "gate")
    open_ = rows.where("gate = 'profile'")
    known = cells if cells is not None else pairs.select(F.col("cell1").alias("cell"), F.col("ground1").alias("elevation")).union(pairs.select("cell2", "ground2")).groupBy("cell").agg(F.max("elevation").alias("elevation"))
    coarse = cut(decide(summary(sample_metrics(open_, coarse_profile(open_, known, raster), config)).join(open_.select("id", "distance_m"), "id"), config))
    shaped = lambda df, gate: df.select("id", F.col("clearance").alias("clearance_m"), "path_loss_db", "distance_m", "obstruction", "visible", F.lit(gate).alias("gate"))
    if raster is None:
        return same.union(off).union(shaped(coarse, "coarse"))
    passed = open_.join(coarse.where("visible").select(F.col("id").alias("__v")), F.col("id") == F.col("__v"), "left_semi")
    passed = cut(passed)
    metrics = cut(sample_metrics(passed, dense_profile(passed, raster, config.los_dense_sample_step_m, config.los_dense_max_samples), config))
    dense = summary(metrics)
    if refined:
        good = passed.join(dense.where(physics.obstruction_accepts(F.col("obstruction"))).select(F.col("id").alias("__g")), F.col("id") == F.col("__g"), "left_semi")
        close = metrics.join(good.select(F.col("id").alias("__h")), F.col("id") == F.col("__h"), "left_semi")
        more = refine(good, close, raster, config.los_dense_max_samples)
        both = merged_profile(metrics.select("id", "fraction", "terrain").union(more))
        dense = summary(sample_metrics(passed, both, config))
    final = decide(dense.join(passed.select("id", "distance_m"), "id"), config)
    return same.union(off).union(shaped(coarse.where("not visible"), "coarse")).union(shaped(final, "dense"))


def shadow_links(links: DataFrame, raster: dem.Raster, config: MeshConfig, step_m: float = 50.0, most: int = 400) -> DataFrame:
    """Strict geometric line of sight from mast to receiver over nearest samples: id, clearance_m, path_loss_db, visible.

    ``links`` have id, lat, lon and ground per end; a blocked link's loss is null.
    """
    far = geo.geodesic_m(F.col("lat1"), F.col("lon1"), F.col("lat2"), F.col("lon2"))
    rows = cut(links.withColumn("distance_m", far).withColumn("h1", F.col("ground1") + config.mast_height_m).withColumn("h2", F.col("ground2") + config.coverage_receiver_height_m))
    n = F.least(F.greatest(F.lit(2), F.floor(F.col("distance_m") / step_m).cast("int")), F.lit(most))
    samples = rows.withColumn("n", n).withColumn("i", F.explode(F.sequence(F.lit(1), F.col("n") - 1))).withColumn("t", F.col("i") / F.col("n"))
    samples = samples.withColumn("lat", F.col("lat1") + (F.col("lat2") - F.col("lat1")) * F.col("t")).withColumn("lon", F.col("lon1") + (F.col("lon2") - F.col("lon1")) * F.col("t"))
    over = dem.nearest_value(samples, raster, "terrain")
    d1 = F.col("t") * F.col("distance_m")
    clearance = F.col("h1") + (F.col("h2") - F.col("h1")) * F.col("t") - d1 * (F.col("distance_m") - d1) / (2 * config.effective_earth_radius_m) - F.col("terrain")
    least = over.groupBy(F.col("id").alias("__id")).agg(F.min(clearance).alias("clearance_m"))
    joined = rows.join(least, F.col("id") == F.col("__id"), "left")
    free = F.coalesce(F.col("clearance_m") >= 0, F.lit(True))
    loss = F.when(F.col("distance_m") <= 0, F.lit(0.0)).otherwise(physics.fspl_db(F.greatest("distance_m", F.lit(1e-9)), config.frequency_hz))
    return joined.select("id", "distance_m", F.coalesce("clearance_m", F.lit(0.0)).alias("clearance_m"), F.when(free, loss).alias("path_loss_db"), (free & (loss <= config.link_budget_db)).alias("visible"))


def shadow_prefilter(pairs: DataFrame, raster: dem.Raster, config: MeshConfig, share: float = 0.6) -> DataFrame:
    """(id, rejected): whether the peak of the line leaves less than a share of the Fresnel radius; a line of no length has none."""
    peaks = dem.line_peaks(pairs.select("id", "lat1", "lon1", "lat2", "lon2"), raster)
    rows = pairs.join(peaks, "id").withColumn("distance_m", geo.geodesic_m(F.col("lat1"), F.col("lon1"), F.col("lat2"), F.col("lon2")))
    return rows.select("id", shadowed(config, share).alias("rejected"))


def shadowed(config: MeshConfig, share: float = 0.6) -> Column:
    """The rule of ``shadow_prefilter`` for rows with distance_m, fraction, peak_m, and ground and mast per end."""
    m = physics.sample_metrics(F.col("fraction"), F.col("peak_m"), F.col("distance_m"), F.col("ground1") + F.col("mast1"), F.col("ground2") + F.col("mast2"), config.wavelength_m, config.effective_earth_radius_m)
    return F.coalesce((F.col("distance_m") > 0) & (F.col("fraction") > 0) & (F.col("fraction") < 1) & (m["geometric"] < m["fresnel"] * share), F.lit(False))


def cached(requested: DataFrame, cache: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Results found in a table of canonical pairs, and the canonical pairs that are missing there."""
    hits = fan_out(requested, cache)
    missing = canonical(requested).join(cache.select("lo", "hi"), ["lo", "hi"], "left_anti")
    return hits, missing


def batch_report(metrics: DataFrame) -> DataFrame:
    """Totals and by stage (null for all): requests, visible, seconds a pair (mean, least, most, median)."""
    return metrics.rollup("stage").agg(F.sum("requested").alias("requested"), F.sum("visible").alias("visible"), F.avg("seconds").alias("mean_s"), F.min("seconds").alias("least_s"), F.max("seconds").alias("most_s"), F.percentile("seconds", 0.5).alias("median_s"))


def decision_debug(links: DataFrame, config: MeshConfig) -> DataFrame:
    """Margins of a decision: to the budget and to the obstruction rule, with the acceptance flags."""
    return links.withColumn("budget_margin_db", F.lit(config.link_budget_db) - F.col("path_loss_db")).withColumn("fresnel_margin", F.lit(physics.MOST_OBSTRUCTION) - F.col("obstruction")).withColumn("budget_ok", F.col("budget_margin_db") >= 0).withColumn("fresnel_ok", F.col("fresnel_margin") >= 0)


def strict_sight(links: DataFrame, config: MeshConfig) -> Column:
    """The strict rule: the whole Fresnel zone is free and the distance within visibility."""
    return (F.col("clearance_m") > 0) & (F.col("distance_m") <= config.max_visibility_m)
