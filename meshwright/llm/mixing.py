"""Mixing sources to target weights: hash-random keys, range-sorted within each source, cut at each source's budget.

Every row gets a key from a hash of its id.  The keys of a source are dealt into equal
ranges and sorted within them; sums per range, and sums before each range, give every
row the number of words that stand before it in its source.  A source's budget is its
target rounded to whole words.  The source is read through as often as the budget
holds it whole, and the last reading stops at the budget exactly: the row in which it
ends is taken in part.

Targets share a budget by weight; none is above ``most`` times its source's size, and
what that cuts off is shared among the others by weight until none is above.  That has
a closed form: with sources ordered by the ratio of that bound to the weight, those
below a level stand at their bounds, the others at the level times their weight.

Neither rows nor sources are gathered in one task: a source has as many ranges as the
square root of all rows, sources are ranked and summed by ranges too, and exact copies
of a row are counted first, whatever their number.

A null or empty text has size 0 and takes nothing; a null source is a source of its
own, after all others; a null id has a key like any other.  Equal rows get consecutive places
and may take different parts.  An empty table gives an empty result, a table without words targets of 0.  Very long
texts are counted whole.  Other columns of the table are not looked at.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from meshwright.llm.common import stored, table, whole_text

SEED = "mix"
#: How often a source may be read.
EPOCHS = 3
#: Weights of sources in their order, repeating.
WEIGHTS = (1, 2, 3)
#: Hexadecimal digits of a key, so that it is never negative as a long.
DIGITS = 15
#: Copies of a row that are unfolded at once.
COPIES = 4096

_SPACE = r"\x20\x09-\x0D"


def words_in(text: Column) -> Column:
    """How many runs of characters other than space and U+0009 to U+000D a text has."""
    marked = F.regexp_replace(text, f"[^{_SPACE}]++", "a")
    return F.length(F.translate(marked, " \t\n\x0b\x0c\r", "")).cast("long")


def random_key(key: Column, seed: str = SEED) -> Column:
    """A number from 0 to 16**DIGITS - 1 that depends on the id and the seed only."""
    digest = F.sha2(F.encode(F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit(""))), "UTF-8"), 256)
    return F.conv(F.substring(digest, 1, DIGITS), 16, 10).cast("long")


def running_sums(df: DataFrame, order: list[Column], sums: dict[str, str]) -> DataFrame:
    """``df`` with the sums (new name to column) of the rows before each in ``order``, which must tell all rows apart.

    Rows are dealt by ranges and stored so, ranges are summed, and the sums before a range
    are added to the running sums inside it.
    """
    dealt = stored(df.repartitionByRange(*order).withColumn("__part", F.spark_partition_id()))
    totals = dealt.groupBy("__part").agg(*[F.sum(c).alias(f"__t_{out}") for out, c in sums.items()])
    before = W.orderBy("__part").rowsBetween(W.unboundedPreceding, -1)  # a row a range
    starts = totals.select(F.col("__part").alias("__q"), *[F.sum(f"__t_{out}").over(before).alias(f"__o_{out}") for out in sums])
    inside = W.partitionBy("__part").orderBy(*order).rowsBetween(W.unboundedPreceding, -1)
    running = dealt.select("*", *[F.sum(c).over(inside).alias(f"__i_{out}") for out, c in sums.items()])
    joined = running.join(starts, F.col("__part") == F.col("__q"))
    zero = F.lit(0)
    return joined.select(*df.columns, *[(F.coalesce(f"__o_{out}", zero) + F.coalesce(f"__i_{out}", zero)).alias(out) for out in sums])


def targets(sources: DataFrame, budget: float, most: int = EPOCHS) -> DataFrame:
    """``sources`` (source_key, source_size, weight) with target: the share of ``budget`` by weight, ``most`` times source_size at most."""
    bounded = sources.withColumn("bound", (F.col("source_size") * most).cast("double")).withColumn("ratio", F.col("bound") / F.col("weight"))
    summed = stored(running_sums(bounded.withColumn("weight", F.col("weight").cast("double")), [F.col("ratio"), F.col("source_key")], {"weight_before": "weight", "bound_before": "bound"}))
    whole = summed.agg(F.sum("weight").alias("weight")).collect()[0]["weight"] or 0.0
    level = (F.lit(float(budget)) - F.col("bound_before")) / (F.lit(whole) - F.col("weight_before"))
    # the first source in order whose bound is not below the level that is left for it and those after it
    first = summed.where(F.col("ratio") >= level).agg(F.min(F.struct("ratio", "source_key", level.alias("level"))).alias("f")).select("f.level").collect()
    held = first[0]["level"] if first and first[0]["level"] is not None else math.inf
    return summed.select(*sources.columns, F.least(F.col("bound"), F.col("weight") * F.lit(held)).alias("target"))


def mix(rows: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = EPOCHS, share: float = 1.0, seed: str = SEED) -> DataFrame:
    """doc_id, source, size, source_size, target and taken of ``rows`` (doc_id, source, size).

    Sources by code point, null last, have the ``weights`` in turn, and share ``share`` of all sizes.
    """
    named = rows.select("doc_id", F.col("source").cast("string").alias("source"), F.col("size").cast("long").alias("size"))
    # the names sort by code point, with null after all others
    named = named.withColumn("source_key", F.when(F.col("source").isNull(), F.lit("1")).otherwise(F.concat(F.lit("0"), F.col("source"))))
    counted = stored(named.groupBy("source_key", "doc_id", "size").agg(F.count(F.lit(1)).alias("copies")).withColumn("key", random_key(F.col("doc_id"), seed)))
    ranges = max(1, math.isqrt(counted.count()))
    width = -(-(16**DIGITS) // ranges)
    counted = counted.withColumn("range", F.floor(F.col("key") / F.lit(width)).cast("long")).withColumn("words", F.col("size") * F.col("copies"))
    totals = stored(counted.groupBy("source_key", "range").agg(F.sum("words").alias("words")))
    sizes = totals.groupBy("source_key").agg(F.sum("words").alias("source_size")).withColumn("one", F.lit(1).cast("long"))
    ranked = running_sums(sizes, [F.col("source_key")], {"place": "one"})
    weight = F.element_at(F.array(*[F.lit(w) for w in weights]), (F.col("place") % len(weights) + 1).cast("int"))
    sources = stored(ranked.select("source_key", "source_size", weight.alias("weight")))
    budget = share * (sources.agg(F.sum("source_size")).collect()[0][0] or 0)
    shared = targets(sources, budget, most).select(F.col("source_key").alias("sk"), "source_size", "target")
    ahead = F.sum("words").over(W.partitionBy("source_key").orderBy("range").rowsBetween(W.unboundedPreceding, -1))
    starts = totals.select("source_key", F.col("range").alias("r"), F.coalesce(ahead, F.lit(0)).alias("ahead")).join(shared, F.col("source_key") == F.col("sk"))
    starts = starts.select("sk", "r", "ahead", "source_size", "target")
    inside = F.sum("words").over(W.partitionBy("source_key", "range").orderBy("key", "doc_id", "size").rowsBetween(W.unboundedPreceding, -1))
    placed = counted.withColumn("inside", F.coalesce(inside, F.lit(0))).join(starts, (F.col("source_key") == F.col("sk")) & (F.col("range") == F.col("r")))
    first = F.sequence(F.lit(0).cast("long"), F.col("copies") - 1, F.lit(COPIES).cast("long"))
    placed = placed.select("*", F.explode(first).alias("from"))
    copy = F.sequence(F.col("from"), F.least(F.col("from") + COPIES, F.col("copies")) - 1)
    placed = placed.select("*", F.explode(copy).alias("copy"))
    cut = F.floor(F.col("target") + 0.5).cast("long")
    start = F.col("ahead") + F.col("inside") + F.col("copy") * F.col("size")
    whole = F.when(F.col("source_size") > 0, F.floor(cut / F.col("source_size")).cast("long")).otherwise(F.lit(0))
    rest = cut - whole * F.col("source_size")
    taken = whole * F.col("size") + F.greatest(F.lit(0), F.least(F.col("size"), rest - start))
    name = F.when(F.col("source_key") != "1", F.expr("substring(source_key, 2)"))
    return placed.select("doc_id", name.alias("source"), "size", "source_size", "target", taken.cast("long").alias("taken"))


def op11_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, size, source_size, target, taken and source of every document."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", words_in(whole_text()).alias("size"))
    return mix(docs).select("doc_id", "size", "source_size", "target", "taken", "source")


OP11_SQL = f"""
WITH docs AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS size,
    CAST('0x' || substr(sha256('{SEED}:' || coalesce(CAST(doc_id AS VARCHAR), '')), 1, {DIGITS}) AS BIGINT) AS key
  FROM documents),
sized AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM docs GROUP BY source),
weighed AS (
  SELECT source, source_size, CAST((row_number() OVER (ORDER BY source NULLS LAST) - 1) % {len(WEIGHTS)} + 1 AS DOUBLE) AS weight,
    CAST({EPOCHS} * source_size AS DOUBLE) AS bound
  FROM sized),
levels AS (
  SELECT *, bound / weight AS ratio,
    ((SELECT CAST(sum(source_size) AS DOUBLE) FROM sized) - coalesce(sum(bound) OVER before, 0)) / ((SELECT sum(weight) FROM weighed) - coalesce(sum(weight) OVER before, 0)) AS level
  FROM weighed
  WINDOW before AS (ORDER BY bound / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
held AS (SELECT arg_min(level, ratio) AS level FROM levels WHERE ratio >= level),
shared AS (SELECT source, source_size, least(bound, weight * (SELECT level FROM held)) AS target FROM levels),
placed AS (
  SELECT d.doc_id, d.size, s.source_size, s.target, d.source, CAST(floor(s.target + 0.5) AS BIGINT) AS cut,
    CAST(coalesce(sum(d.size) OVER (PARTITION BY d.source ORDER BY d.key, d.doc_id, d.size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS start
  FROM docs d JOIN shared s ON d.source IS NOT DISTINCT FROM s.source)
SELECT doc_id, CAST(size AS BIGINT) AS size, source_size, target, source,
  CASE WHEN source_size = 0 THEN 0 ELSE cut // source_size * size + greatest(0, least(size, cut % source_size - start)) END AS taken
FROM placed
"""
