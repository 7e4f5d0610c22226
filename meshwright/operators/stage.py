"""Cutting the lineage between stages."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W


def shared_dir(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``, the folder that driver and executors share; only in local mode, and where nothing is set, a temporary folder."""
    sc = spark.sparkContext
    found = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    if not sc.getCheckpointDir():
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="meshwright-"))
    return sc.getCheckpointDir().rstrip("/")


def cut(df: DataFrame) -> DataFrame:
    """Cut the lineage: write a table in the shared folder, computing it once, and read it back.

    Lost executors lose none of it, and what follows is planned with its true size: a checkpoint would
    hand on the estimate of its plan, which is a product of sizes and grows with every join of a loop.  The files go
    when the application ends.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/cut-{uuid.uuid4().hex}"
    df.write.parquet(path)
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(where)
    return spark.read.schema(df.schema).parquet(path)


def numbered(df: DataFrame, order: list[Column], name: str) -> DataFrame:
    """``df`` with the place of each row in ``order``, from 0: rows are dealt by ranges, numbered in them, and moved by the rows before."""
    dealt = cut(df.repartitionByRange(*order).withColumn("__part", F.spark_partition_id()))
    sizes = dealt.groupBy("__part").count()
    before = F.sum("count").over(W.orderBy("__part").rowsBetween(W.unboundedPreceding, -1))  # a row a range
    starts = sizes.select(F.col("__part").alias("__p"), F.coalesce(before, F.lit(0)).alias("__before"))
    place = F.row_number().over(W.partitionBy("__part").orderBy(*order)) - 1
    return dealt.withColumn(name, place).join(starts, F.col("__part") == F.col("__p")).withColumn(name, (F.col(name) + F.col("__before")).cast("long")).drop("__part", "__p", "__before")
