"""Approximate nearest neighbours by randomly rotated one-bit codes.

Vectors are centred, normalised and rotated by a random orthogonal matrix; a code keeps
the sign of each rotated component, packed into bits, with two correction scalars: the
distance from the centre, and the inner product of the unit vector with its code.  The
inner product of a query with a code, divided by that scalar, estimates the inner
product with the vector without bias, and its error has a bound that falls with the
dimension.  A row is reranked by the exact Euclidean distance, in double precision,
when the lower bound of its distance is within the K-th smallest upper bound seen.

Every row is indexed.  Queries are broadcast in passes of a bounded number, and each
pass reads the index once, so that neither side has to fit anywhere whole.  Vectors
that are null, zero, hold null or non-finite components, or have another length than most (no distance is
defined between lengths), take no part.  Components too large for an estimate are compared exactly; a distance that
overflows is infinite and comes last.  Ties go to the smaller vec_id, repeated rows stay rows of their own; an
empty table, or one without queries, gives an empty result; other columns are not looked at.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from meshwright.llm.common import stored, table

#: Standard deviations of the estimate that the error bound allows.
BOUND = 3.0
#: Queries of one pass, at most about so many.
PASS = 4096
#: Rows compared with the queries of a pass at once.
ROWS = 1024
SEED = 7
#: Rows with a component as large as this do not count for the centre.
HUGE = 1e100
#: What a product in single precision may be off by, relative to its largest terms.
SINGLE = 1e-6


def rotation(size: int, seed: int = SEED) -> np.ndarray:
    """A random orthogonal matrix."""
    q, r = np.linalg.qr(np.random.default_rng(seed).standard_normal((size, size)))
    return q * np.sign(np.diag(r))


def usable(df: DataFrame, vector: str = "embedding", key: str = "vec_id") -> DataFrame:
    """vec_id and vector (array<double>) of the rows that take part."""
    v = F.col(vector)
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    rows = df.where(v.isNotNull() & F.col(key).isNotNull()).where(finite & F.exists(v, lambda x: x != 0)).select(F.col(key).cast("long").alias("vec_id"), v.cast("array<double>").alias("vector"))
    most = rows.groupBy(F.size("vector").alias("d")).count().orderBy(F.desc("count"), "d").limit(1).collect()
    return rows.where(F.size("vector") == most[0]["d"]) if most else rows


def mean_of(rows: DataFrame, size: int) -> np.ndarray:
    """The mean of all vectors, from sums over the partitions."""

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, total = 0, np.zeros(size)
        for batch in batches:
            part = matrix(batch.column("vector"), size)
            part = part[(np.abs(part) < HUGE).all(axis=1)]
            n += len(part)
            total += part.sum(axis=0)
        yield pa.RecordBatch.from_arrays([pa.array([n], pa.int64()), pa.array([total.tolist()], pa.list_(pa.float64()))], ["n", "total"])

    added = rows.select("vector").mapInArrow(sums, "n long, total array<double>").agg(F.sum("n").alias("n"), *[F.sum(F.get("total", F.lit(i))).alias(f"t{i}") for i in range(size)]).collect()[0]
    return np.array([added[f"t{i}"] for i in range(size)]) / max(1, added["n"])


def matrix(column: pa.Array, size: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, size)


def codes(vector: Column, centre: np.ndarray, size: int) -> Column:
    """struct<code, norm, dot>: packed signs, distance from the centre, inner product of unit vector and code."""

    turn = rotation(size)

    @F.arrow_udf("struct<code:binary,norm:double,dot:double>")
    def encode(column: pa.Array) -> pa.Array:
        with np.errstate(over="ignore", invalid="ignore"):
            away = matrix(column, size) - centre
            norm = np.linalg.norm(away, axis=1)
            unit = np.nan_to_num(away / np.where(norm > 0, norm, 1.0)[:, None]) @ turn
        packed = np.packbits(unit > 0, axis=1)
        dot = np.abs(unit).sum(axis=1) / np.sqrt(size)
        return pa.StructArray.from_arrays([pa.array([x.tobytes() for x in packed], pa.binary()), pa.array(norm), pa.array(dot)], ["code", "norm", "dot"])

    return encode(vector)


def bounds(code: np.ndarray, norm: np.ndarray, dot: np.ndarray, queries: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Lower and upper bounds of the squared distances of rows (packed codes) to rotated, centred queries.

    A sign is a bit, so that the inner product with a code is twice the sum over its set bits less the sum over all.
    Where a number is too large for an estimate the bounds are infinite, and the row is reranked.
    """
    bits = np.unpackbits(code, axis=1, count=size).astype(np.float32)
    with np.errstate(over="ignore", invalid="ignore"):
        reach = np.linalg.norm(queries, axis=1)
        unit = np.nan_to_num(queries / np.where(reach > 0, reach, 1.0)[:, None])
        safe = np.where(dot > 0, dot, 1.0)
        inner = (2 * (bits @ unit.T.astype(np.float32)).astype(np.float64) - unit.sum(axis=1)) / np.sqrt(size) / safe[:, None]
        error = BOUND * np.sqrt(np.maximum(0.0, 1 - safe**2) / safe**2 / max(1, size - 1)) + SINGLE * np.sqrt(size)
        both = 2 * norm[:, None] * reach[None, :]
        far = norm[:, None] ** 2 + reach[None, :] ** 2
        middle, slack = far - both * inner, both * error[:, None] + 1e-9 * far
        low, high = middle - slack, middle + slack
    return np.where(np.isfinite(low), low, -np.inf), np.where(np.isfinite(high), high, np.inf)


class Nearest:
    """The k nearest rows of every query, from batches of rows."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, rotated: np.ndarray, k: int) -> None:
        self.ids, self.vectors, self.rotated, self.k = ids, vectors, rotated, k
        self.upper = np.full((k, len(ids)), np.inf)
        self.found = (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))  # query, vec_id, distance

    def add(self, keys: np.ndarray, rows: np.ndarray, code: np.ndarray, norm: np.ndarray, dot: np.ndarray) -> None:
        low, high = bounds(code, norm, dot, self.rotated, rows.shape[1])
        own = keys[:, None] == self.ids[None, :]
        high[own] = np.inf
        stacked = np.vstack([self.upper, high])
        self.upper = np.partition(stacked, self.k - 1, axis=0)[: self.k]
        r, q = np.nonzero((low <= self.upper.max(axis=0)[None, :]) & ~own)
        distance = np.empty(len(r))
        for at in range(0, len(r), 50_000):
            part = slice(at, at + 50_000)
            with np.errstate(over="ignore"):
                distance[part] = np.sqrt(((rows[r[part]] - self.vectors[q[part]]) ** 2).sum(axis=1))
        query, key, far = (np.concatenate(x) for x in zip(self.found, (q, keys[r], distance), strict=True))
        order = np.lexsort((key, far, query))
        query, key, far = query[order], key[order], far[order]
        first = np.searchsorted(query, query, "left")
        keep = np.arange(len(query)) - first < self.k
        self.found = query[keep], key[keep], far[keep]


def search(rows: DataFrame, queries: DataFrame, k: int = 10) -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest of ``rows`` to each of ``queries`` (both vec_id and vector)."""
    spark = rows.sparkSession
    empty = spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    sizes = queries.select(F.size("vector").alias("d")).limit(1).collect()
    parts = []
    if sizes:
        size = sizes[0]["d"]
        centre = mean_of(rows, size)
        index = stored(rows.select("vec_id", "vector", codes(F.col("vector"), centre, size).alias("c")).select("vec_id", "vector", "c.*"))
        passes = -(-queries.count() // PASS)
        for i in range(passes):
            own = queries.where(F.pmod(F.xxhash64("vec_id"), F.lit(passes)) == i).select("vec_id", "vector").distinct().toArrow()
            ids, vectors = own["vec_id"].to_numpy(), np.array(own["vector"].to_pylist(), dtype=np.float64).reshape(-1, size)
            shared = spark.sparkContext.broadcast((ids, vectors, (vectors - centre) @ rotation(size)))

            def nearest(batches: Iterator[pa.RecordBatch], shared=shared, size=size) -> Iterator[pa.RecordBatch]:
                top = Nearest(*shared.value, k)
                for whole in batches:
                    for at in range(0, whole.num_rows, ROWS):
                        batch = whole.slice(at, ROWS)
                        code = np.frombuffer(b"".join(batch.column("code").to_pylist()), np.uint8).reshape(batch.num_rows, -1)
                        top.add(batch.column("vec_id").to_numpy(), matrix(batch.column("vector"), size), code, batch.column("norm").to_numpy(), batch.column("dot").to_numpy())
                query, key, far = top.found
                yield pa.RecordBatch.from_arrays([pa.array(top.ids[query], pa.int64()), pa.array(key, pa.int64()), pa.array(far, pa.float64())], ["query_id", "vec_id", "score"])

            rank = F.row_number().over(W.partitionBy("query_id").orderBy("score", "vec_id"))
            best = index.mapInArrow(nearest, "query_id long, vec_id long, score double").withColumn("rank", rank).where(F.col("rank") <= k)
            # a pass is written out, and its queries go, before the next is gathered
            parts.append(stored(best.select("query_id", "rank", "vec_id", "score")))
            shared.destroy()
    for part in parts:
        empty = empty.union(part)
    return empty


def op7_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """query_id, rank, vec_id, score: the 10 nearest rows of each row whose vec_id is divisible by 100."""
    rows = usable(table(spark, sf_dir, "embeddings"))
    return search(rows, rows.where(F.col("vec_id") % 100 == 0))
