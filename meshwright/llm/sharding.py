"""Jump consistent hashing of stable keys to shards, in DataFrame expressions only.

A key's shard under n shards follows the published jump sequence: a linear
congruential generator seeded with the key says where the key next jumps as shards
are appended, and the last jump below n is its shard.  No ring table is kept, and a
key only ever moves into the appended shard.  The generator needs products modulo
2**64, which are made from 32-bit halves so that no step overflows a long.

Law ``key``: the key and the shard count decide.  Null keys hash like a fixed value of
their own; equal rows get consecutive slots; a hot key or a hot group of identical
rows is counted before it is ranked, and slots are ranked in hash buckets, so that no
shard is ordered in one task.  A null or empty text has size 1, a very long one is measured whole; an empty table gives
an empty result; other columns are not looked at.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from meshwright.llm.common import gapless_rank, table, whole_text

SHARDS = 8
#: Multiplier of the published jump sequence, in halves.
MULTIPLIER = 2862933555777941757
_HIGH, _LOW = MULTIPLIER >> 32, MULTIPLIER & 0xFFFFFFFF
_LOW1, _LOW0 = _LOW >> 16, _LOW & 0xFFFF
_MASK32, _MASK16 = 0xFFFFFFFF, 0xFFFF


def _and(x: Column, mask: int) -> Column:
    return x.bitwiseAND(F.lit(mask).cast("long"))


def _next(high: Column, low: Column) -> tuple[Column, Column]:
    """The halves of key * MULTIPLIER + 1 modulo 2**64."""
    middle = low * F.lit(_LOW1)
    partial = low * F.lit(_LOW0) + F.shiftleft(_and(middle, _MASK16), 16) + F.lit(1)
    carried = F.shiftright(partial, 32) + F.shiftright(middle, 16)
    crossed = _and(low * F.lit(_HIGH), _MASK32) + _and(high * F.lit(_LOW0) + F.shiftleft(_and(high * F.lit(_LOW1), _MASK16), 16), _MASK32)
    return _and(carried + crossed, _MASK32), _and(partial, _MASK32)


def jump_shard(key: Column, shards: int) -> Column:
    """The shard (0 to shards - 1) of a 64-bit key."""
    start = F.struct(F.lit(0).cast("long").alias("b"), F.lit(0).cast("long").alias("j"), _and(F.shiftrightunsigned(key, 32), _MASK32).alias("h"), _and(key, _MASK32).alias("l"))

    def step(state: Column, _: Column) -> Column:
        done = state["j"] >= F.lit(shards)
        high, low = _next(state["h"], state["l"])
        to = F.floor((state["j"] + 1).cast("double") * (F.lit(float(1 << 31)) / (F.shiftright(high, 1) + 1).cast("double"))).cast("long")
        moved = F.struct(state["j"].alias("b"), to.alias("j"), high.alias("h"), low.alias("l"))
        return F.when(done, state).otherwise(moved)

    # every step moves j on by one at least, so that as many steps as shards always suffice
    return F.aggregate(F.sequence(F.lit(1), F.lit(shards)), start, step)["b"].cast("int")


def stable_key(*columns: str) -> Column:
    """A 64-bit key that depends on the values of the columns only."""
    return F.xxhash64(*columns)


def shard(df: DataFrame, key: str, keep: list[str], shards: int = SHARDS) -> DataFrame:
    """key, keep, shard, slot (gapless from 0 in each shard) and grown_shard (with one shard more) for every row."""
    placed = df.select(key, *keep).withColumn("__k", stable_key(key))
    placed = placed.withColumn("shard", jump_shard(F.col("__k"), shards)).withColumn("grown_shard", jump_shard(F.col("__k"), shards + 1))
    return gapless_rank(placed.drop("__k"), "shard", [key, *keep, "grown_shard"], out="slot")


def op5_jump_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard of every document; law ``key``."""
    text = whole_text()
    size = (F.octet_length(text) + 1).cast("long")
    docs = table(spark, sf_dir, "documents").select("doc_id", size.alias("size"), F.crc32(F.encode(text, "UTF-8")).alias("text_crc32"))
    placed = shard(docs, "doc_id", ["size", "text_crc32"])
    return placed.select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", "grown_shard")
