"""Helpers shared by the training-data operators."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the Parquet tables below ``sf_dir``; only Spark opens the path."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def whole_text(name: str = "text") -> Column:
    """The text of a row, null read as empty."""
    return F.coalesce(F.col(name).cast("string"), F.lit(""))


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share (``spark.checkpoint.dir``).

    Where it is unset a temporary folder serves, but only in local mode, where
    every task runs on this machine; on a cluster that is an error.
    """
    sc = spark.sparkContext
    found = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    if not sc.getCheckpointDir():
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="meshwright-"))
    return sc.getCheckpointDir().rstrip("/")


def stored(df: DataFrame) -> DataFrame:
    """Write ``df`` as compressed Parquet in the shared folder and read it back.

    Cuts the lineage and survives lost executors.  The files are removed when the
    application ends.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/meshwright-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(where)
    return spark.read.schema(df.schema).parquet(path)


def gapless_rank(df: DataFrame, group: str, keys: list[str], buckets: int = 256, out: str = "rank") -> DataFrame:
    """Number the rows of each group from 0 without gaps, and without sending a group to one task.

    Identical (group, keys) rows are first counted (so a hot group of copies is one
    row), then ranked inside a hash bucket; bucket totals give the offsets.  Returns
    group, keys and ``out``; equal rows get consecutive numbers.
    """
    counted = df.groupBy(group, *keys).agg(F.count(F.lit(1)).alias("__n"))
    counted = counted.withColumn("__b", F.pmod(F.xxhash64(*keys), F.lit(buckets)))
    totals = counted.groupBy(group, "__b").agg(F.sum("__n").alias("__t"))
    before = F.sum("__t").over(W.partitionBy(group).orderBy("__b").rowsBetween(W.unboundedPreceding, -1))
    offsets = totals.select(F.col(group).alias("__g"), F.col("__b").alias("__c"), F.coalesce(before, F.lit(0)).alias("__o"))
    inside = F.sum("__n").over(W.partitionBy(group, "__b").orderBy(*keys).rowsBetween(W.unboundedPreceding, -1))
    ranked = counted.withColumn("__i", F.coalesce(inside, F.lit(0)))
    joined = ranked.join(offsets, F.col(group).eqNullSafe(F.col("__g")) & (F.col("__b") == F.col("__c")))
    first = F.col("__o") + F.col("__i")
    return joined.select(group, *keys, F.explode(F.sequence(first, first + F.col("__n") - 1)).alias(out))


#: Bits of a sieve; 2 MB whatever the number of keys.
SIEVE_BITS = 1 << 24


def sieve_bits(keys: DataFrame, key: str) -> Broadcast:
    """A Bloom filter (two probes, fixed size) of a column of 64-bit keys, broadcast.

    The bitmap is aggregated by Spark and brought to the driver, no more than its bits
    however many keys there are.  With very many it lets more keys through, never fewer.
    """
    probes = keys.select(F.explode(F.array(F.col(key), F.shiftrightunsigned(F.col(key), 28))).alias("h"))
    words = probes.select(F.shiftright(F.col("h").bitwiseAND(F.lit(SIEVE_BITS - 1)), 6).alias("w"), F.expr("shiftleft(1L, int(h & 63))").alias("b")).groupBy("w").agg(F.bit_or("b").alias("b"))
    found = words.toArrow()
    bits = np.zeros(SIEVE_BITS >> 6, dtype=np.int64)
    bits[found["w"].to_numpy()] = found["b"].to_numpy()
    return keys.sparkSession.sparkContext.broadcast(bits.view(np.uint64))


def in_sieve(keys: np.ndarray, bits: np.ndarray) -> np.ndarray:
    """Which of the int64 keys a sieve may hold."""
    h = keys.view(np.uint64)
    hit = np.ones(len(h), dtype=bool)
    for x in (h, h >> np.uint64(28)):
        x = x & np.uint64(SIEVE_BITS - 1)
        hit &= (bits[x >> np.uint64(6)] >> (x & np.uint64(63))) & np.uint64(1) == 1
    return hit


def sieve(keys: DataFrame, key: str) -> Column:
    """A column that is true where the 64-bit ``key`` may be among ``keys`` (and always where it is)."""
    shared = sieve_bits(keys, key)

    @F.arrow_udf("boolean")
    def may(hashes: pa.Array) -> pa.Array:
        return pa.array(in_sieve(hashes.fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64), shared.value))

    return may(F.col(key))


def native_sieve(keys: DataFrame, key: str) -> DataFrame:
    """(w, bits): a bitmap of the low bits of 64-bit keys in words, at most SIEVE_BITS / 64 rows whatever the keys."""
    return keys.select(F.col(key).alias("h")).select(_word(F.col("h")).alias("w"), _bit(F.col("h")).alias("b")).groupBy("w").agg(F.bit_or("b").alias("bits"))


def _word(h: Column) -> Column:
    return F.shiftright(h.bitwiseAND(F.lit(SIEVE_BITS - 1)), 6)


def _bit(h: Column) -> Column:
    return F.call_function("shiftleft", F.lit(1).cast("long"), h.bitwiseAND(F.lit(63)).cast("int"))


def sieved(df: DataFrame, h: str, words: DataFrame) -> DataFrame:
    """``df`` with ``__in``: whether the bitmap may hold the 64-bit column ``h``; the bitmap's size bound allows a broadcast."""
    known = words.select(F.col("w").alias("__w"), F.col("bits").alias("__bits"))
    hit = F.coalesce(F.col("__bits").bitwiseAND(_bit(F.col(h))) != 0, F.lit(False))
    return df.join(F.broadcast(known), _word(F.col(h)) == F.col("__w"), "left").withColumn("__in", hit).drop("__w", "__bits")


def components(edges: DataFrame, checkpoint=stored) -> DataFrame:
    """(node, root) of every node of the undirected ``edges`` (a, b); root is the smallest node reachable.

    Distributed union-find by contraction: every node points to its smallest neighbour,
    pointers are doubled, edges are moved to what their ends point to, and loops and
    repeats go, until no edge is left.  Each round is written out, so that the lineage
    stays short; a round at least halves the nodes that still have a smaller neighbour.
    """
    left = checkpoint(edges.where("a != b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    labels: DataFrame | None = None
    while True:
        both = left.select("a", "b").union(left.select(F.col("b").alias("a"), F.col("a").alias("b")))
        to = both.groupBy("a").agg(F.min("b").alias("p")).select(F.col("a").alias("node"), F.least("a", "p").alias("p"))
        hop = to.alias("x").join(to.select(F.col("node").alias("q"), F.col("p").alias("pp")), F.col("x.p") == F.col("q"), "left")
        to = checkpoint(hop.select("node", F.coalesce("pp", "p").alias("p")))
        if labels is None:
            labels = to.select("node", F.col("p").alias("root"))
        else:
            labels = labels.join(to.select(F.col("node").alias("n2"), "p"), F.col("root") == F.col("n2"), "left").select("node", F.coalesce("p", "root").alias("root"))
        ends = [to.select(F.col("node").alias(f"n{x}"), F.col("p").alias(f"p{x}")) for x in "ab"]
        moved = left.join(ends[0], F.col("a") == F.col("na")).join(ends[1], F.col("b") == F.col("nb")).where("pa != pb")
        left = checkpoint(moved.select(F.least("pa", "pb").alias("a"), F.greatest("pa", "pb").alias("b")).distinct())
        labels = checkpoint(labels)
        if left.isEmpty():
            return labels


def hubs_of(lists: DataFrame) -> DataFrame:
    """(key, hub): of each list of ``lists`` (key, id, c: the members of the list) the member that stands in the longest lists.

    In a family of near copies that is the one the others derive from, so that most of them link to it.
    """
    known = lists.groupBy(F.col("id").alias("i")).agg(F.sum("c").alias("pop"))
    ranked = lists.join(known, F.col("id") == F.col("i")).groupBy("key").agg(F.max(F.struct("pop", "id")).alias("top"))
    return ranked.select("key", F.col("top.id").alias("hub"))


def linked_by_difference(measured: DataFrame, comps: DataFrame, percent: int) -> DataFrame:
    """(a, b): linked pairs of different components, of members that were measured against one hub.

    ``measured`` has the hub a, the member b, the sizes na and nb of their sets, whether the two are
    linked, and the elements in which they differ.  The members that a hub's component does not hold are
    compared with all members of that hub by their differences, a small part of the sets:
    two sets that differ from the hub in d1 and d2 elements, s of them the same, differ from
    each other in d1 + d2 - 2s.  The comparison is exact, and is the residual of the join on the hub, so
    that only linked pairs leave it.
    """
    comp = comps.select(F.col("node").alias("cn"), F.col("root").alias("comp"))
    hub = comps.select(F.col("node").alias("hn"), F.col("root").alias("hub_comp"))
    known = measured.join(comp, F.col("b") == F.col("cn"), "left").withColumn("comp", F.coalesce("comp", "b"))
    known = known.join(hub, F.col("a") == F.col("hn"), "left").withColumn("probe", ~F.col("linked") & (F.col("comp") != F.coalesce("hub_comp", "a")))
    known = stored(known.select("a", "b", "nb", "comp", "probe", "diff"))
    one = known.where("probe").select("a", "b", "nb", "comp", "diff")
    two = known.select([F.col(c).alias(f"{c}_2") for c in known.columns])
    size = F.col("nb") + F.col("nb_2")
    apart = lambda shared: F.size("diff") + F.size("diff_2") - 2 * shared
    may = lambda shared: 100 * (size - apart(shared)) >= percent * (size + apart(shared))
    pairs = one.join(
        two,
        (F.col("a") == F.col("a_2"))
        & (F.col("comp") != F.col("comp_2"))
        & (~F.col("probe_2") | (F.col("b") < F.col("b_2")))
        & (percent * F.greatest("nb", "nb_2") <= 100 * F.least("nb", "nb_2"))
        & may(F.least(F.size("diff"), F.size("diff_2")))
        & may(F.size(F.array_intersect("diff", "diff_2"))),
    )
    return pairs.select(F.least("b", "b_2").alias("a"), F.greatest("b", "b_2").alias("b")).distinct()


def across_lists(lists: DataFrame, own: list[str], hubs: DataFrame, measured: DataFrame, far: DataFrame, comps: DataFrame, least: int, fits: Callable[[Callable[[str], Column], Callable[[str], Column]], Column]) -> DataFrame:
    """(a, b): pairs of different components that share ``least`` lists and that differences from a hub do not cover.

    ``lists`` has key and id; the lists that count together for an id are those of equal ``own`` columns.  Two members that were measured near the
    hub of a list are left to ``linked_by_difference``.  A member that is known to be ``far`` from the hub is linked
    with none that is linked with the hub: distances obey the triangle inequality, and far is beyond twice
    the distance of a link.  So a pair that need not be looked at in one of its lists need not be looked at
    at all, and each pair leaves the join in the first list that it shares, however many there are.
    Members of a list's largest component are paired only with those outside it.
    """
    comp = comps.select(F.col("node").alias("cn"), F.col("root").alias("comp"))
    states = measured.select("a", "b", F.when(F.col("linked"), 3).otherwise(2).alias("state")).union(far.select("a", "b", F.lit(1)))
    states = states.select(F.col("a").alias("sa"), F.col("b").alias("sb"), "state")
    rows = lists.join(hubs.withColumnRenamed("key", "hk"), F.col("key") == F.col("hk")).drop("hk")
    rows = rows.join(states, (F.col("hub") == F.col("sa")) & (F.col("id") == F.col("sb")), "left").drop("sa", "sb")
    # 3: linked with the hub or the hub, 2: near it, 1: far from it, 0: not measured
    rows = rows.withColumn("state", F.when(F.col("id") == F.col("hub"), 3).otherwise(F.coalesce("state", F.lit(0)))).drop("hub")
    rows = stored(rows.join(comp, F.col("id") == F.col("cn"), "left").withColumn("comp", F.coalesce("comp", "id")).drop("cn"))
    sizes = rows.groupBy("key", "comp").agg(F.count(F.lit(1)).alias("c"), F.min("state").alias("least"))
    mixed = sizes.groupBy(F.col("key").alias("k")).agg(F.max(F.struct("c", "comp")).alias("top"), F.count(F.lit(1)).alias("comps"), F.min("least").alias("least")).where("comps > 1 and least < 2")
    open_ = stored(rows.join(mixed.select("k", F.col("top.comp").alias("top")), F.col("key") == F.col("k")).withColumn("inside", F.col("comp") == F.col("top")).drop("k", "top"))
    members = open_.select(F.col("id").alias("m")).distinct()
    held = lists.join(members, F.col("id") == F.col("m"), "left_semi").groupBy([F.col(c).alias(f"h{c}") for c in own]).agg(F.array_sort(F.collect_list("key")).alias("keys"))
    open_ = open_.join(held, reduce(Column.__and__, [F.col(c) == F.col(f"h{c}") for c in own])).drop(*[f"h{c}" for c in own])
    few = open_.where("not inside").select([F.col(c).alias(f"{c}_2") for c in open_.columns])
    two = lambda c: F.col(f"{c}_2")
    low, high = F.least("state", "state_2"), F.greatest("state", "state_2")
    shared = F.array_intersect("keys", "keys_2")
    pairs = open_.join(
        few,
        (F.col("key") == F.col("key_2"))
        & (F.col("comp") != F.col("comp_2"))
        & (F.col("inside") | (F.col("id") < F.col("id_2")))
        & (low < 2)
        & ~((low == 1) & (high == 3))
        & fits(F.col, two)
        & (F.get(shared, F.lit(0)) == F.col("key"))
        & (F.size(shared) >= least),
    )
    return pairs.select(F.least("id", "id_2").alias("a"), F.greatest("id", "id_2").alias("b")).distinct()
