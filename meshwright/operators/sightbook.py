"""Batches of sight requests: answers kept between runs, failures of single pairs, and what was done by stage.

Answers are kept in a table bucketed by the pair of cells.  An answer holds for its whole key: both
cells, both masts, both anchors to six digits, the parameters that decide, and the terrain; the two ends in
either order.  A lookup moves the requests to the buckets and reads no answer twice; only what is missing is evaluated
and appended.
"""

from __future__ import annotations

import hashlib
import json
import time

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from meshwright.config import MeshConfig
from meshwright.operators import dem, los
from meshwright.operators.stage import cut

#: How sight is decided: coarse profiles first, what they accept verified on dense ones.
MODE = "hybrid_accept_verify"
BUCKETS = 64
#: Failures that a report shows of each batch.
SHOWN = 5
#: The parameters that are part of an answer's key.
PARAMETERS = ["frequency_hz", "tx_power_mw", "antenna_gain_dbi", "receiver_sensitivity_dbm", "min_fresnel_clearance_m", "los_dense_sample_step_m", "los_dense_max_samples", "earth_radius_m", "earth_radius_factor"]
_KEY = ["mast1", "mast2", "lat1", "lon1", "lat2", "lon2"]
ANSWER = "clearance_m double, path_loss_db double, distance_m double, obstruction double, visible boolean, gate string"
_ANSWER = [x.split()[0] for x in ANSWER.split(", ")]
_ROW = f"lo long, hi long, setting string, {', '.join(f'{k} long' for k in _KEY)}, {ANSWER}"
REPORT = "stage string, requested long, unique long, hits long, computed long, failed long, visible long, seconds double, samples array<struct<lo:long,hi:long,error:string>>"


def setting_of(config: MeshConfig, terrain: str = "") -> str:
    """A digest of the parameters and the terrain that an answer holds for."""
    told = {name: getattr(config, name) for name in PARAMETERS} | {"mode": MODE, "terrain": terrain}
    return hashlib.sha256(json.dumps(told, sort_keys=True).encode()).hexdigest()


def _micro(c: str) -> Column:
    """A mast or a coordinate as a whole number of millionths."""
    return F.floor(F.col(c) * 1e6 + 0.5).cast("long")


class SightBook:
    """Answers in a folder, and the reports of the batches that used it."""

    def __init__(self, spark: SparkSession, path: str, terrain: str = "") -> None:
        self.spark, self.path, self.terrain = spark, path, terrain
        self.table = "sight_" + hashlib.sha256(path.encode()).hexdigest()[:16]
        self.rows: list[tuple] = []
        spark.sql(f"CREATE TABLE IF NOT EXISTS {self.table} ({_ROW.replace(' long', ' BIGINT')}) USING parquet CLUSTERED BY (lo, hi) INTO {BUCKETS} BUCKETS LOCATION '{path}'")

    def answers(self) -> DataFrame:
        self.spark.catalog.refreshTable(self.table)
        return self.spark.table(self.table)

    def lookup(self, rows: DataFrame, config: MeshConfig) -> DataFrame:
        """Canonical pairs (lo, hi, and mast, lat, lon of both ends) with their answer, null where there is none."""
        setting = setting_of(config, self.terrain)
        known = self.answers().where(F.col("setting") == setting).select(F.col("lo").alias("__lo"), F.col("hi").alias("__hi"), *[F.col(k).alias(f"__{k}") for k in _KEY], *_ANSWER)
        same = (F.col("lo") == F.col("__lo")) & (F.col("hi") == F.col("__hi"))
        for k in _KEY:
            # a difference, so that the join's keys stay those of the buckets
            same &= (F.col(f"__{k}") - _micro(k)) == 0
        # answers are deterministic, so that two runs that appended the same one do no harm
        found = rows.join(known, same, "left").drop("__lo", "__hi", *[f"__{k}" for k in _KEY])
        return found.dropDuplicates(["lo", "hi"])

    def add(self, rows: DataFrame, config: MeshConfig) -> None:
        """Append answers of canonical pairs."""
        kept = rows.select("lo", "hi", F.lit(setting_of(config, self.terrain)).alias("setting"), *[_micro(k).alias(k) for k in _KEY], *_ANSWER)
        kept.repartition(BUCKETS, "lo", "hi").write.insertInto(self.table)

    def report(self) -> DataFrame:
        """REPORT of every batch."""
        return self.spark.createDataFrame(self.rows, REPORT)

    def summary(self) -> DataFrame:
        """By stage, and for all (null): calls, requested, unique, hits, computed, failed, visible, seconds for each computed pair."""
        sums = [F.sum(c).alias(c) for c in ("requested", "unique", "hits", "computed", "failed", "visible", "seconds")]
        by = self.report().rollup("stage").agg(F.count(F.lit(1)).alias("calls"), *sums)
        return by.withColumn("pair_s", F.when(F.col("computed") > 0, F.col("seconds") / F.col("computed")))


def endpoints(pairs: DataFrame, cells: DataFrame, config: MeshConfig) -> DataFrame:
    """Canonical pairs (lo, hi) as rows for ``los.evaluate``, with ``error``: why a pair cannot be evaluated, null where it can."""
    mast = F.lit(config.mast_height_m) + (F.coalesce("offset_m", F.lit(0.0)) if "offset_m" in cells.columns else F.lit(0.0))
    out = pairs.select("lo", "hi", F.struct("lo", "hi").alias("id"), F.col("lo").alias("cell1"), F.col("hi").alias("cell2"))
    finite = lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(float("inf")))
    for i in ("1", "2"):
        own = cells.select(F.col("cell").alias(f"c{i}"), F.coalesce("los_lat", "lat").alias(f"lat{i}"), F.coalesce("los_lon", "lon").alias(f"lon{i}"), F.col("elevation").cast("double").alias(f"ground{i}"), mast.alias(f"mast{i}"))
        out = out.join(own, F.col(f"cell{i}") == F.col(f"c{i}"), "left")
    error = F.lit(None).cast("string")
    for i in ("2", "1"):
        place = finite(F.col(f"lat{i}")) & finite(F.col(f"lon{i}")) & (F.abs(f"lat{i}") <= 90) & (F.abs(f"lon{i}") <= 180)
        error = F.when(F.col(f"c{i}").isNull(), F.concat(F.lit("no cell "), F.col(f"cell{i}"))).when(~place, F.concat(F.lit("no place for cell "), F.col(f"cell{i}"))).when(~(finite(F.col(f"ground{i}")) & finite(F.col(f"mast{i}"))), F.concat(F.lit("no height for cell "), F.col(f"cell{i}"))).otherwise(error)
    return out.withColumn("error", error).drop("c1", "c2")


def batch(requested: DataFrame, cells: DataFrame, config: MeshConfig, raster: dem.Raster | None = None, book: SightBook | None = None, stage: str = "unknown", strict: bool = False) -> DataFrame:
    """Canonical pairs (lo, hi) of the requests (src, dst) with ``status`` (kept, computed or failed), ``error`` and their answer.

    A pair that lacks a cell, a place or a height fails by itself; ``strict`` makes that an error of the batch.  Each pair is
    evaluated once, however often and in whichever direction it is asked for.  What was done is counted while it is done, and told to the book.
    """
    began = time.time()
    asked, seen, made = Observation(), Observation(), Observation()
    counted = requested.observe(asked, F.count(F.lit(1)).alias("n"))
    rows = endpoints(los.canonical(counted), cells, config)
    null = lambda c: F.lit(None).cast(c)
    if book is not None:
        good = book.lookup(rows.where("error is null"), config)
        bad = rows.where("error is not null")
        for part in ANSWER.split(", "):
            bad = bad.withColumn(part.split()[0], null(part.split()[1]))
        rows = good.unionByName(bad)
    else:
        for part in ANSWER.split(", "):
            rows = rows.withColumn(part.split()[0], null(part.split()[1]))
    status = F.when(F.col("error").isNotNull(), "failed").when(F.col("gate").isNotNull(), "kept").otherwise("computed")
    known = cut(rows.withColumn("status", status).observe(seen, F.count(F.lit(1)).alias("n"), F.count_if(F.col("error").isNotNull()).alias("failed"), F.count_if(F.col("gate").isNotNull()).alias("hits"), F.count_if(F.coalesce("visible", F.lit(False))).alias("visible")))
    if known.isEmpty():  # Spark drops what it knows to be empty, and counts nothing
        if book is not None:
            book.rows.append((stage, 0, 0, 0, 0, 0, 0, time.time() - began, []))
        return known.select("lo", "hi", "status", "error", *_ANSWER)
    failed = known.where("status = 'failed'").orderBy("lo", "hi").select("lo", "hi", "error").limit(SHOWN).collect() if seen.get["failed"] else []
    if strict and failed:
        raise RuntimeError(f"{seen.get['failed']} of {seen.get['n']} pairs failed, first {tuple(failed[0])}")
    todo = known.where("status = 'computed'").drop(*_ANSWER)
    out = known.where("status != 'computed'").select("lo", "hi", "status", "error", *_ANSWER)
    visible, computed = seen.get["visible"], seen.get["n"] - seen.get["failed"] - seen.get["hits"]
    if computed:
        terrain = cells.select("cell", "elevation")
        found = los.evaluate(todo, config, terrain, raster).select(F.col("id.lo").alias("flo"), F.col("id.hi").alias("fhi"), *_ANSWER)
        fresh = cut(todo.join(found, (F.col("lo") == F.col("flo")) & (F.col("hi") == F.col("fhi"))).observe(made, F.count_if("visible").alias("visible")))
        visible += made.get["visible"]
        if book is not None:
            book.add(fresh, config)
        out = out.unionByName(fresh.select("lo", "hi", "status", "error", *_ANSWER))
    if book is not None:
        book.rows.append((stage, asked.get["n"], seen.get["n"], seen.get["hits"], computed, seen.get["failed"], visible, time.time() - began, [tuple(x) for x in failed]))
    return out
