"""The planning tables made from the driver's tables, by integer arithmetic that any SQL engine repeats."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from meshwright.config import MeshConfig
from meshwright.operators.dem import Raster

#: A tight link budget, so that both sides of every gate occur.
TIGHT = MeshConfig(tx_power_mw=1.0, antenna_gain_dbi=0.0, receiver_sensitivity_dbm=-105.0, mast_height_m=20.0)
RESOLUTION = 8
WEST, NORTH, PX, WIDTH = 44.0, 40.1, 0.002, 50


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _point(key: str, a: int, b: int) -> list:
    k = F.col(key)
    return [(F.lit(40.0) + ((k * a) % 1000) / F.lit(10000.0)).alias("lat"), (F.lit(44.0) + ((k * b) % 1000) / F.lit(10000.0)).alias("lon")]


def towers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id, lat, lon, ground, nation of every supplier."""
    return table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("id"), *_point("s_suppkey", 7919, 104729), F.floor(F.col("s_acctbal") / 50).cast("double").alias("ground"), F.col("s_nationkey").alias("nation"))


def sites(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id, ord, lat, lon, priority (region + 1) of every supplier."""
    nation = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("nation"), F.col("n_regionkey").alias("region"))
    return towers(spark, sf_dir).join(nation, "nation").select("id", F.col("id").alias("ord"), "lat", "lon", (F.col("region") + 1).cast("int").alias("priority"))


def receivers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id, lat, lon, ground, segment of every customer."""
    return table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), *_point("c_custkey", 7907, 104723), F.floor(F.col("c_acctbal") / 50).cast("double").alias("ground"), F.col("c_mktsegment").alias("segment"))


def raster(spark: SparkSession, sf_dir: str) -> Raster:
    """The retail prices of parts as pixels, 50 to a row."""
    px = table(spark, sf_dir, "part").select(F.floor(F.col("p_partkey") / 50).cast("int").alias("row"), (F.col("p_partkey") % 50).cast("int").alias("col"), F.col("p_retailprice").cast("double").alias("value"))
    return Raster(px, WEST, NORTH, PX, WIDTH, 1 << 30)


def corridors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """route, pos, cell (part key), value (whole price) of every order's lines."""
    # named before the window, so that Spark knows the rows to be dealt by route already
    lines = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("route"), F.col("l_partkey").alias("cell"), "l_linenumber", "l_suppkey", "l_extendedprice", "l_shipdate")
    order = W.partitionBy("route").orderBy("l_linenumber", "cell", "l_suppkey", "l_extendedprice", "l_shipdate")
    return lines.select("route", (F.row_number().over(order) - 1).cast("int").alias("pos"), "cell", F.floor("l_extendedprice").cast("long").alias("value"))
