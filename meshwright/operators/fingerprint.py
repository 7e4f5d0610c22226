"""Digests of tables that do not depend on the order of rows or on partitions, and of files."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

_TWO64 = "18446744073709551616"


def _steady(value: Column, kind: T.DataType, digits: int) -> Column:
    """A value in a form in which equal values are equal: rounded numbers, one zero, maps as sorted entries."""
    if isinstance(kind, (T.DoubleType, T.FloatType)):
        return F.round(value.cast("double"), digits) + F.lit(0.0)
    if isinstance(kind, T.ArrayType):
        return F.transform(value, lambda x: _steady(x, kind.elementType, digits))
    if isinstance(kind, T.StructType):
        return F.when(value.isNotNull(), F.struct(*[_steady(value.getField(f.name), f.dataType, digits).alias(f.name) for f in kind.fields]))
    if isinstance(kind, T.MapType):
        entry = T.StructType([T.StructField("key", kind.keyType), T.StructField("value", kind.valueType)])
        return F.array_sort(F.transform(F.map_entries(value), lambda x: _steady(x, entry, digits)))
    return value


def _row_hash(df: DataFrame, digits: int) -> Column:
    """A hash of a row's columns by name; which of them are null counts too."""
    fields = sorted(df.schema.fields, key=lambda f: f.name)
    nulls = F.concat(F.lit("0"), *[F.col(f"`{f.name}`").isNull().cast("int").cast("string") for f in fields])
    return F.xxhash64(nulls, *[_steady(F.col(f"`{f.name}`"), f.dataType, digits) for f in fields])


def fingerprint(df: DataFrame, digits: int = 6) -> DataFrame:
    """(rows, total, parity): how many rows, the sum of their hashes modulo 2**64, and their exclusive or; one row, aggregated before it is shuffled."""
    h = _row_hash(df, digits)
    total = F.coalesce(F.sum(h.cast("decimal(38,0)")), F.lit(0).cast("decimal(38,0)"))
    return df.agg(F.count(F.lit(1)).alias("rows"), F.pmod(total, F.lit(_TWO64).cast("decimal(38,0)")).cast("string").alias("total"), F.coalesce(F.bit_xor(h), F.lit(0)).alias("parity"))


def fingerprints(tables: dict[str, DataFrame], digits: int = 6) -> DataFrame:
    """(name, rows, total, parity) of every table."""
    out = None
    for name in sorted(tables):
        one = fingerprint(tables[name], digits).select(F.lit(name).alias("name"), "rows", "total", "parity")
        out = one if out is None else out.unionByName(one)
    if out is None:
        raise ValueError("no tables")
    return out


def dealt(df: DataFrame, seed: int = 7) -> DataFrame:
    """``df`` dealt at random into as many partitions as the session shuffles into, times those it is read in, so that no task gets a share of a large table."""
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return df.repartition(n * max(1, df.rdd.getNumPartitions()), F.rand(seed))


def repeated(spark: SparkSession, run: Callable[[], dict[str, DataFrame]], partitions: tuple[int, ...] = (3, 8), digits: int = 6) -> DataFrame:
    """(name, run, partitions, rows, total, parity, same): a plan's tables, run once for each number of shuffle partitions, and whether each is as in the first run."""
    was = spark.conf.get("spark.sql.shuffle.partitions")
    found = []
    try:
        for i, n in enumerate(partitions, 1):
            spark.conf.set("spark.sql.shuffle.partitions", str(n))
            found += [(r["name"], i, n, r["rows"], r["total"], r["parity"]) for r in fingerprints(run(), digits).collect()]  # a row a table
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", was)
    first = {x[0]: x[3:] for x in found if x[1] == 1}
    return spark.createDataFrame([(*x, x[3:] == first.get(x[0])) for x in found], "name string, run int, partitions int, rows long, total string, parity long, same boolean")


def file_fingerprints(spark: SparkSession, folder: str) -> DataFrame:
    """(path, bytes, sha256) of the files below a folder, by their place in it; Spark's own marks are left out."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder)
    name = F.regexp_replace("path", "^[a-z]+:/*", "/")
    below = F.expr("substring(name, length(root) + 2)")
    rows = files.select(name.alias("name"), F.lit("/" + folder.split(":", 1)[-1].strip("/")).alias("root"), F.col("length").alias("bytes"), F.sha2("content", 256).alias("sha256"))
    return rows.select(below.alias("path"), "bytes", "sha256").where(~F.col("path").rlike(r"(^|/)[_.]"))


def changed(a: DataFrame, b: DataFrame) -> DataFrame:
    """(path): files that are not in both (path, bytes, sha256), or not alike."""
    right = b.select(F.col("path").alias("p2"), F.col("sha256").alias("s2"))
    return a.join(right, F.col("path") == F.col("p2"), "full").where("p2 is null or path is null or sha256 != s2").select(F.coalesce("path", "p2").alias("path"))
