"""Hard-negative mining by bit-sliced integer products.

Components become integers, and a row is kept as the bit-planes of its components in two's
complement, each packed.  A score, the inner product with an anchor, is built from the
most significant plane down: a plane adds the anchor's components where its bits are set, times the
plane's power of two.  After every plane the score lies in an interval, from the sum so
far plus what the anchor's negative components can still add to that plus what its positive
ones can.  A candidate goes as soon as its interval cannot reach the least score that still
qualifies, or cannot come down to the highest.  What is left after the last plane has its exact score.

First each anchor's best rows of its own label are found (its positives), then, for each
of those, the best rows of other labels whose score is within a range of shares of the
positive's.  Anchors are broadcast in passes of a bounded number; each pass reads
the index by partitions, keeps the few best of every partition, and is written out before the next.

Rows with a null label or vector, or a null or non-finite component, take no part.
Vectors of unequal length are compared as if the shorter ended in zeros; an empty one scores 0.  Higher scores come
first, ties by smaller vec_id.  Rows with the vec_id of an anchor are not its candidates; other repeated rows
stay rows of their own, and equal anchors count once.  A positive without rows in range (as any of negative score) has none.
Components of any size are exact (Python's integers where doubles would round); a score beyond a long is returned as its
nearest long, after exact comparison.  An empty table, or one without anchors, gives an empty result.  Other columns are not looked at.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from meshwright.llm.common import stored, table

#: Positives of an anchor, and negatives of a positive.
POSITIVES, NEGATIVES = 5, 10
#: Hundredths of a positive's score that a negative's may have.
SHARES = (30, 90)
#: What a component is multiplied by before it is floored.
SCALE = 256
#: Anchors of one pass, at most about so many.
PASS = 4096
#: Rows, and anchors, that are compared at once; numbers in a block of rows.
ROWS, ANCHORS, NUMBERS = 2048, 256, 1 << 20
#: Components of ordinary rows are below two to this power, so that most products are exact in doubles.
ORDINARY = 20
#: Part of the pairs of a block below which survivors are listed one by one.
FEW = 0.1
_LONG = 2**63 - 1


def whole_numbers(vector: list[float]) -> list[int]:
    """floor(SCALE * x) of every component, exact at any size."""
    return [math.floor(x * SCALE) if abs(x) < 2.0**900 else int(x) * SCALE for x in vector]


def bits_for(values: list[int]) -> int:
    """Planes that hold the values in two's complement."""
    return 1 + max((max(v.bit_length(), (~v).bit_length() if v < 0 else 0) for v in values), default=0)


def planes_of(values: list[int], bits: int) -> bytes:
    """The bit-planes of the values, the sign first, each packed into whole bytes."""
    if bits <= 62:
        v = np.array(values, dtype=np.int64)
        return b"".join(np.packbits((v >> k) & 1 == 1).tobytes() for k in reversed(range(bits)))
    return b"".join(np.packbits([(v >> k) & 1 == 1 for v in values]).tobytes() for k in reversed(range(bits)))


def usable(df: DataFrame, label: Column | str = "label", vector: str = "embedding", key: str = "vec_id") -> DataFrame:
    """vec_id, label and vector of the rows that take part."""
    v = F.col(vector)
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    label = F.col(label) if isinstance(label, str) else label
    rows = df.where(v.isNotNull() & F.col(key).isNotNull()).where(finite)
    return rows.select(F.col(key).cast("long").alias("vec_id"), label.cast("long").alias("label"), v.cast("array<double>").alias("vector")).where("label is not null")


def index(rows: DataFrame) -> DataFrame:
    """vec_id, label, bits and planes of rows (vec_id, label, vector); ordinary rows share one number of planes and one length."""
    wide = F.exists("vector", lambda x: F.abs(x) * SCALE >= F.lit(2.0**ORDINARY - 1))
    sizes = rows.agg(F.max(F.size("vector")).alias("d"), F.max(F.when(~wide, F.coalesce(F.array_max(F.transform("vector", lambda x: F.abs(x))), F.lit(0.0)))).alias("m")).collect()[0]
    size = max(1, sizes["d"] or 0)
    usual = 2 + int((sizes["m"] or 0.0) * SCALE + 1).bit_length()

    def slowly(vector: list[float]) -> tuple[int, bytes]:
        values = whole_numbers(vector) + [0] * (size - len(vector))
        bits = max(usual, bits_for(values))
        return bits, planes_of(values, bits)

    @F.arrow_udf("struct<bits:int,planes:binary>")
    def encode(column: pa.Array) -> pa.Array:
        lengths = np.diff(column.offsets.to_numpy())
        flat = column.flatten().to_numpy(zero_copy_only=False)
        most = np.abs(flat).max(initial=0.0)
        if len(column) and (lengths == size).all() and most * SCALE < 2.0**ORDINARY - 1:
            v = np.floor(flat.reshape(-1, size) * SCALE).astype(np.int64)
            packed = np.stack([np.packbits((v >> k) & 1 == 1, axis=1) for k in reversed(range(usual))], axis=1)
            found = [(usual, x.tobytes()) for x in packed]
        else:
            found = [slowly(vector) for vector in column.to_pylist()]
        return pa.StructArray.from_arrays([pa.array([x[0] for x in found], pa.int32()), pa.array([x[1] for x in found], pa.binary())], ["bits", "planes"])

    return stored(rows.select("vec_id", "label", encode("vector").alias("p"), F.lit(size).alias("d")).select("vec_id", "label", "d", "p.*"))


def below(x: float) -> float:
    """A double that is not above a whole number, and is the number where doubles are exact."""
    try:
        return float(x) if abs(x) < 2**53 or x in (-math.inf, math.inf) else math.nextafter(float(x), -math.inf)
    except OverflowError:
        return -math.inf if x < 0 else 1.7e308


def above(x: float) -> float:
    return -below(-x)


class Anchors:
    """Anchors of one pass: ids, labels and components; ``span`` is the largest component."""

    def __init__(self, ids: np.ndarray, labels: np.ndarray, values: np.ndarray) -> None:
        self.ids, self.labels, self.values = ids, labels, values
        self.span = max((abs(int(x)) for x in values.ravel()), default=0) if values.dtype == object else int(np.abs(values).max(initial=0))
        self.positive, self.negative = np.where(values > 0, values, 0).sum(axis=1), np.where(values < 0, values, 0).sum(axis=1)

    def part(self, at: np.ndarray) -> Anchors:
        return Anchors(self.ids[at], self.labels[at], self.values[at])


def narrowed(planes: np.ndarray, size: int, anchors: Anchors, may: np.ndarray, least: np.ndarray, most: np.ndarray, wanted: int = 0) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, anchor, score) of the pairs that may match and whose score is between ``least`` and ``most`` of the anchor.

    ``planes`` is (rows, planes, bytes), the sign first; ``may`` (rows, anchors).  With ``wanted``, the bound from below rises
    to that many-th largest lower end of an anchor's own intervals, so that only its best rows have to be finished.
    """
    rows, count, _ = planes.shape
    exact = size * anchors.span << count < 2**53 and anchors.values.dtype != object
    kind = np.float64 if exact else object
    values = anchors.values.astype(kind)
    positive, negative = anchors.positive.astype(kind), anchors.negative.astype(kind)
    total = np.zeros(may.shape, dtype=kind)
    alive, listed = may.copy(), None
    for k in range(count):
        power = 1 << (count - 1 - k)
        rest = power - 1
        power = -power if k == 0 else power
        bits = np.unpackbits(planes[:, k, :], axis=1, count=size)
        if listed is None:
            total = total + power * (bits.astype(kind) @ values.T)
            if wanted and rows > wanted:
                low = np.where(alive, total + rest * negative, -np.inf if exact else -(10**400))
                least = np.maximum(least, np.partition(low, rows - wanted, axis=0)[rows - wanted])
            alive &= (total + rest * positive >= least) & (total + rest * negative <= most)
            if alive.mean() < FEW:
                r, q = np.nonzero(alive)
                listed = r, q, total[r, q]
        else:
            r, q, sums = listed
            sums = sums.copy()
            for at in range(0, len(r), 1 << 16):
                part = slice(at, at + (1 << 16))
                sums[part] += power * (bits[r[part]].astype(kind) * values[q[part]]).sum(axis=1)
            keep = (sums + rest * positive[q] >= least[q]) & (sums + rest * negative[q] <= most[q])
            listed = r[keep], q[keep], sums[keep]
    if listed is None:
        r, q = np.nonzero(alive)
        listed = r, q, total[r, q]
    return listed


class Best:
    """The best rows of each slot (an anchor, or an anchor and a positive), from blocks of scored pairs."""

    def __init__(self, slots: int, k: int) -> None:
        self.k = k
        self.kth = np.full(slots, -math.inf)
        self.found: tuple[np.ndarray, ...] = (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, object))

    def add(self, slot: np.ndarray, key: np.ndarray, score: np.ndarray) -> None:
        if not len(slot):
            return
        slot, key, score = (np.concatenate(x) for x in zip(self.found, (slot, key, score.astype(object)), strict=True))
        # scores that doubles may round are ranked as integers
        rank = score.astype(np.float64) if all(abs(x) < 2**53 for x in (score.max(), score.min())) else np.unique(score, return_inverse=True)[1]
        order = np.lexsort((key, -rank, slot))
        slot, key, score = slot[order], key[order], score[order]
        place = np.arange(len(slot)) - np.searchsorted(slot, slot, "left")
        keep = place < self.k
        last = place == self.k - 1
        self.kth[slot[last]] = [below(x) for x in score[last]]
        self.found = slot[keep], key[keep], score[keep]


def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray, int, np.ndarray]]:
    """(ids, labels, length, planes) of rows with equal numbers of planes, of bounded size."""
    for whole in batches:
        bits = whole.column("bits").to_numpy()
        for n in np.unique(bits):
            same = whole.filter(pa.array(bits == n))
            size = same.column("d")[0].as_py()
            step = max(1, min(ROWS, NUMBERS // size))
            for at in range(0, same.num_rows, step):
                part = same.slice(at, step)
                planes = np.frombuffer(b"".join(part.column("planes").to_pylist()), np.uint8).reshape(part.num_rows, int(n), -1)
                yield part.column("vec_id").to_numpy(), part.column("label").to_numpy(), size, planes


def _best_positives(shared: Broadcast, k: int) -> Callable:
    """Of every partition, each anchor's k best rows of its label."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        groups = shared.value
        best = [Best(len(g.ids), k) for g in groups]
        for ids, labels, size, planes in blocks(batches):
            for label in np.unique(labels):
                rows = np.flatnonzero(labels == label)
                for group, top in zip(groups, best, strict=True):
                    own = np.flatnonzero(group.labels == label)
                    for at in range(0, len(own), ANCHORS):
                        part = own[at : at + ANCHORS]
                        anchors = group.part(part)
                        may = ids[rows][:, None] != anchors.ids[None, :]
                        r, q, score = narrowed(planes[rows], size, anchors, may, top.kth[part], np.full(len(part), math.inf), k)
                        top.add(part[q], ids[rows][r], score)
        for n, top in enumerate(best):
            slot, key, score = top.found
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(slot), n), pa.int32()), pa.array(slot, pa.int32()), pa.array(key, pa.int64()), _as_text(score)], ["g", "slot", "vec_id", "score"])

    return run


def _best_negatives(shared: Broadcast, k: int) -> Callable:
    """Of every partition, the k best rows of other labels in each positive's range."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        groups = shared.value
        best = [Best(len(g.owner), k) for g in groups]
        bounds = [(np.array([below(x) for x in g.least]), np.array([above(x) for x in g.most])) for g in groups]
        for ids, labels, size, planes in blocks(batches):
            for group, (least, most), top in zip(groups, bounds, best, strict=True):
                # slots are ordered by anchor; an anchor's bounds are the widest of its slots
                need = np.maximum(least, top.kth)
                asked, first = np.unique(group.owner, return_index=True)
                last = np.append(first[1:], len(group.owner))
                for at in range(0, len(asked), ANCHORS):
                    part, a, b = (x[at : at + ANCHORS] for x in (asked, first, last))
                    anchors = group.anchors.part(part)
                    low, high = np.minimum.reduceat(need[: b[-1]], a), np.maximum.reduceat(most[: b[-1]], a)
                    may = (labels[:, None] != anchors.labels[None, :]) & (ids[:, None] != anchors.ids[None, :])
                    r, q, score = narrowed(planes, size, anchors, may, low, high)
                    for j in range(int((b - a).max(initial=0))):
                        slot = a[q] + j
                        has = slot < b[q]
                        slot, row, own = slot[has], r[has], score[has]
                        fits = (need[slot] <= own) & (own <= most[slot])
                        if score.dtype == object:
                            fits &= (group.least[slot] <= own) & (own <= group.most[slot])
                        top.add(slot[fits], ids[row[fits]], own[fits])
        for group, top in zip(groups, best, strict=True):
            slot, key, score = top.found
            anchor, positive, own = group.anchors.ids[group.owner[slot]], group.positive[slot], [group.score[x] for x in slot]
            yield pa.RecordBatch.from_arrays([pa.array(anchor, pa.int64()), pa.array(positive, pa.int64()), pa.array(own, pa.string()), pa.array(key, pa.int64()), _as_text(score)], ["anchor_id", "positive_id", "positive_score", "vec_id", "score"])

    return run


def _as_text(score: np.ndarray) -> pa.Array:
    """Exact scores travel as text, as they may be beyond a long."""
    return pa.array([str(int(x)) for x in score], pa.string())


def best_first() -> list[Column]:
    """Order of exact scores that are text: by sign, then by digits, then by the text; ties by vec_id."""
    minus, digits = F.col("score").startswith("-"), F.length("score")
    return [minus.asc(), F.when(minus, -digits).otherwise(digits).desc(), F.when(~minus, F.col("score")).desc_nulls_last(), F.col("score").asc(), F.col("vec_id").asc()]


def as_long(score: Column) -> Column:
    """A long from text, its nearest long where it is beyond."""
    edge = F.when(score.startswith("-"), F.lit(-_LONG - 1)).otherwise(F.lit(_LONG))
    return F.coalesce(score.try_cast("long"), edge)


class Asked:
    """The positives of one group of anchors: slots ordered by anchor, with the range of scores each asks for."""

    def __init__(self, anchors: Anchors, near: dict[int, list[tuple[int, str]]], shares: tuple[int, int]) -> None:
        self.anchors = anchors
        slots = [(at, key, score, -(-shares[0] * int(score) // 100), shares[1] * int(score) // 100) for at in sorted(near) for key, score in near[at]]
        slots = [x for x in slots if x[3] <= x[4]]
        self.owner, self.positive = (np.array([x[i] for x in slots], dtype=np.int64) for i in (0, 1))
        self.score = [x[2] for x in slots]
        self.least, self.most = (np.array([x[i] for x in slots], dtype=object) for i in (3, 4))


def _grouped(rows: pa.Table, size: int) -> list[Anchors]:
    """The anchors of a pass: ordinary ones with machine numbers, the others with Python's."""
    values = [whole_numbers(v) + [0] * (size - len(v)) for v in rows["vector"].to_pylist()]
    wide = np.array([bits_for(v) > ORDINARY + 1 for v in values], dtype=bool)
    ids, labels = rows["vec_id"].to_numpy(), rows["label"].to_numpy()
    out = []
    for at, kind in ((np.flatnonzero(~wide), np.int64), (np.flatnonzero(wide), object)):
        if len(at):
            out.append(Anchors(ids[at], labels[at], np.array([values[i] for i in at], dtype=kind).reshape(len(at), size)))
    return out


def mine(rows: DataFrame, anchors: DataFrame, positives: int = POSITIVES, negatives: int = NEGATIVES, shares: tuple[int, int] = SHARES) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score and negative_score; ``rows`` and ``anchors`` have vec_id, label and vector."""
    spark = rows.sparkSession
    out = spark.createDataFrame([], "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long")
    sliced, asking = index(rows), stored(anchors.distinct())
    sizes = sliced.select("d").limit(1).collect()
    size = sizes[0]["d"] if sizes else 1
    passes = -(-asking.count() // max(1, min(PASS, 4 * NUMBERS // size))) if sizes else 0
    for i in range(passes):
        groups = _grouped(asking.where(F.pmod(F.xxhash64("vec_id"), F.lit(passes)) == i).orderBy("vec_id", "label", "vector").toArrow(), size)
        shared = spark.sparkContext.broadcast(groups)
        found = sliced.mapInArrow(_best_positives(shared, positives), "g int, slot int, vec_id long, score string")
        rank = F.row_number().over(W.partitionBy("g", "slot").orderBy(*best_first()))
        near: list[dict[int, list[tuple[int, str]]]] = [{} for _ in groups]
        # no more rows than anchors of a pass have positives
        for x in found.withColumn("rank", rank).where(F.col("rank") <= positives).orderBy("g", "slot", "rank").toArrow().to_pylist():
            near[x["g"]].setdefault(x["slot"], []).append((x["vec_id"], x["score"]))
        shared.destroy()
        shared = spark.sparkContext.broadcast([Asked(g, n, shares) for g, n in zip(groups, near, strict=True)])
        found = sliced.mapInArrow(_best_negatives(shared, negatives), "anchor_id long, positive_id long, positive_score string, vec_id long, score string")
        rank = F.row_number().over(W.partitionBy("anchor_id", "positive_id", "positive_score").orderBy(*best_first()))
        best = found.withColumn("rank", rank).where(F.col("rank") <= negatives)
        mined = best.select("anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), F.col("vec_id").alias("negative_id"), as_long(F.col("positive_score")).alias("positive_score"), as_long(F.col("score")).alias("negative_score"))
        out = out.union(stored(mined))
        shared.destroy()
    return out


def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score for the rows whose vec_id is divisible by 100."""
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    rows = usable(table(spark, sf_dir, "embeddings"), moved)
    return mine(rows, rows.where(F.col("vec_id") % 100 == 0))


OP13_SQL = """
WITH rows AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
    list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS DOUBLE)) AS v
  FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND vec_id IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scored AS (
  SELECT a.vec_id AS anchor_id, r.vec_id, a.label = r.label AS same, CAST(list_dot_product(a.v, r.v) AS BIGINT) AS score
  FROM rows a JOIN rows r ON r.vec_id <> a.vec_id
  WHERE a.vec_id % 100 = 0),
positives AS (
  SELECT anchor_id, vec_id AS positive_id, score AS positive_score
  FROM scored WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5)
SELECT p.anchor_id, p.positive_id, CAST(row_number() OVER best AS INTEGER) AS rank, s.vec_id AS negative_id, p.positive_score, s.score AS negative_score
FROM positives p JOIN scored s ON s.anchor_id = p.anchor_id AND NOT s.same
WHERE 30 * p.positive_score <= 100 * s.score AND 100 * s.score <= 90 * p.positive_score
WINDOW best AS (PARTITION BY p.anchor_id, p.positive_id ORDER BY s.score DESC, s.vec_id)
QUALIFY row_number() OVER best <= 10
"""
