"""Near-duplicate documents by bottom-k sketches of one hash function.

A document is the set of its distinct word shingles (two words here).  One hash
function orders all shingles; a document's sketch is its K smallest hashes.  Documents
of equal sets are one class.  Inverted lists of the retained values give the overlaps
of classes: of its sketch a class lists only its rarest values, as many as any partner
at the threshold must share some of (the rest are held by too many documents to tell
them apart).  The sketch of a union is the K smallest hashes of two sketches; the share
of it that both hold estimates their Jaccard similarity and filters pairs.  What is
left is verified on the full sets of the two whole texts.

Large groups are not paired with each other.  First every list compares its members with
its hub, the one that stands in the longest lists, and links are contracted.  Members that
are near a hub but not in its component are compared with the hub's other members by
their differences from it, as the residual of a join, so that only linked pairs leave it.  Other
pairs of different components leave the join once, in the first list they share, if they share enough of them.
No link between components is lost.  In a family of copies the comparisons of differences
still grow with its members times those that the hub's component lacks.

Words are runs of characters other than blank and U+0009 to U+000D, with A-Z
lower-cased.  A text with fewer words than a shingle is one shingle of all its words;
a text without words (or null) has the empty set and is linked with nothing.  Rows of
one doc_id are one node; rows without a doc_id take no part (component_id null, kept).  Very long texts are
compared whole; ties go to the smaller doc_id; an empty table gives an empty result; other columns are not looked at.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from meshwright.llm.common import across_lists, components, hubs_of, linked_by_difference, native_sieve, sieve, sieved, stored, table, whole_text

#: Hashes retained by a sketch.
K = 64
#: Retained hashes that two sketches share at the least when the sets are at the threshold: half of K is six
#: standard deviations below the mean.
SHARED = K // 2
#: Listed values that a pair must share before its sketches are compared.
COUNT = 3
#: How often lists of one class and classes of too few lists are dropped in turn; it changes the cost only.
PEELS = 2
#: Hashes, cut to 32 bits, that a sketch keeps for the estimate.
LONG = 192
#: How far below the threshold an estimate may lie (six standard deviations), and where both sets are whole.
MARGIN, WHOLE_MARGIN = 0.175, 0.02


def words_of(text: str) -> list[bytes]:
    return text.encode().lower().split()


def shingles_of(text: str, size: int) -> set[tuple[bytes, ...]]:
    """The exact set of word shingles."""
    words = words_of(text)
    if len(words) < size:
        return {tuple(words)} if words else set()
    return set(zip(*(words[i:] for i in range(size)), strict=False))


def hashes_of(text: str, size: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the shingles."""
    words = words_of(text)
    if not words:
        return np.zeros(0, np.uint64)
    of = {w: xxhash.xxh3_64_intdigest(w) for w in set(words)}
    single = np.fromiter(map(of.__getitem__, words), np.uint64, len(words))
    if len(words) < size:
        size = len(words)
    last = len(words) - size + 1
    mixed = np.full(last, size, np.uint64)
    for i in range(size):
        mixed = (mixed ^ single[i : i + last]) * np.uint64(0x9E3779B97F4A7C15)
        mixed ^= mixed >> np.uint64(29)
    mixed *= np.uint64(0xBF58476D1CE4E5B9)
    mixed ^= mixed >> np.uint64(32)
    return np.unique(mixed)


def sketches(text: Column, size: int) -> Column:
    """struct<n, digest, sketch, rest>: set size, digest of the whole set, its K smallest hashes (as longs of the
    same order), and those that follow up to the LONG smallest, cut to 32 bits."""

    @F.arrow_udf("struct<n:bigint,digest:binary,sketch:array<bigint>,rest:array<int>>")
    def of(texts: pa.Array) -> pa.Array:
        n, digest, parts, more = [], [], [], []
        for at in range(0, len(texts), 256):
            for x in texts[at : at + 256].to_pylist():
                h = hashes_of(x, size)
                n.append(len(h))
                digest.append(xxhash.xxh3_128_digest(h.tobytes()))
                parts.append(h[:K])
                more.append((h[K:LONG] >> np.uint64(32)).astype(np.uint32) ^ np.uint32(1 << 31))
        rest = pa.ListArray.from_arrays(np.cumsum([0, *map(len, more)], dtype=np.int32), (np.concatenate(more) if more else np.zeros(0, np.uint32)).view(np.int32))
        ends = np.cumsum([0, *map(len, parts)], dtype=np.int32)
        flat = (np.concatenate(parts) if parts else np.zeros(0, np.uint64)) ^ np.uint64(1 << 63)
        return pa.StructArray.from_arrays([pa.array(n, pa.int64()), pa.array(digest, pa.binary()), pa.ListArray.from_arrays(ends, flat.view(np.int64)), rest], ["n", "digest", "sketch", "rest"])

    return of(text)


def longer() -> Column:
    """The LONG smallest hashes cut to 32 bits: those of the sketch, and the rest."""
    return F.concat(F.transform("sketch", lambda x: F.shiftright(x, 32).cast("int")), F.col("rest"))


def estimate(a: Column, b: Column, whole: Column) -> Column:
    """Jaccard similarity by the sketch of the union: its LONG smallest hashes, or all where both sets are whole."""
    union = F.array_sort(F.array_union(a, b))
    union = F.when(whole, union).otherwise(F.slice(union, 1, LONG))
    return F.size(F.array_intersect(F.array_intersect(union, a), b)) / F.size(union)


def compared(a: Column, b: Column, size: int, least: Column, differences: bool) -> Column:
    """struct<both, diff>: of the full shingle sets of two texts the size of the intersection, and the hashes of what
    only one of them holds (none where fewer than ``least`` are common, or where they are not asked for)."""

    @F.arrow_udf("struct<both:bigint,diff:array<bigint>>")
    def compare(left: pa.Array, right: pa.Array, floor: pa.Array) -> pa.Array:
        counts, diffs, last, mine = [], [], None, np.zeros(0, np.uint64)
        for i in range(len(left)):
            x, y = left[i].as_py(), right[i].as_py()
            if x != last:
                last, mine = x, hashes_of(x, size)
            other = hashes_of(y, size)
            both = len(np.intersect1d(mine, other, assume_unique=True))
            counts.append(both)
            diffs.append(np.setxor1d(mine, other, assume_unique=True).view(np.int64) if differences and both >= floor[i].as_py() else np.zeros(0, np.int64))
        ends = np.cumsum([0, *map(len, diffs)], dtype=np.int32)
        flat = np.concatenate(diffs) if diffs else np.zeros(0, np.int64)
        return pa.StructArray.from_arrays([pa.array(counts, pa.int64()), pa.ListArray.from_arrays(ends, flat)], ["both", "diff"])

    return compare(a, b, least)


def measured_pairs(pairs: DataFrame, classes: DataFrame, docs: DataFrame, size: int, percent: int, least: int, differences: bool = False) -> tuple[DataFrame, DataFrame]:
    """Of pairs (a, b) of class ids those near at ``least`` per cent (a, b, na, nb, linked, diff), and all the others (a, b).

    The sketch estimate filters them; what is left is compared on whole texts.
    """
    pairs = stored(pairs)
    ends = pairs.select(F.xxhash64("a").alias("h")).union(pairs.select(F.xxhash64("b").alias("h"))).distinct()
    classes = sieved(classes.withColumn("h", F.xxhash64("rep")), "h", native_sieve(ends, "h")).where("__in").select("rep", "n", longer().alias("longer"))
    one = classes.select(F.col("rep").alias("ra"), F.col("n").alias("na"), F.col("longer").alias("sa"))
    two = classes.select(F.col("rep").alias("rb"), F.col("n").alias("nb"), F.col("longer").alias("sb"))
    close = pairs.join(one, F.col("a") == F.col("ra")).join(two, F.col("b") == F.col("rb"))
    sized = F.lit(least) * F.greatest("na", "nb") <= F.lit(100) * F.least("na", "nb")
    whole = (F.col("na") <= LONG) & (F.col("nb") <= LONG)
    likely = estimate(F.col("sa"), F.col("sb"), whole) >= F.lit(least / 100) - F.when(whole, WHOLE_MARGIN).otherwise(MARGIN)
    judged = stored(close.select("a", "b", "na", "nb", (sized & likely).alias("likely")))
    near = judged.where("likely").select("a", "b", "na", "nb")
    involved = near.select("a").union(near.select("b")).distinct().select(F.xxhash64("a").alias("h"))
    texts = docs.select(F.col("doc_id").alias("id"), whole_text().alias("text"), F.xxhash64("doc_id").alias("h"))
    texts = texts.where(sieve(involved, "h")).select("id", "text")
    with_b = near.join(texts.select(F.col("id").alias("ib"), F.col("text").alias("tb")), F.col("b") == F.col("ib")).drop("ib")
    with_both = with_b.join(texts.select(F.col("id").alias("ia"), F.col("text").alias("ta")), F.col("a") == F.col("ia"))
    enough = F.ceil(F.lit(least / 100 - 1e-9) * F.greatest("na", "nb"))
    found = with_both.select("a", "b", "na", "nb", compared(F.col("ta"), F.col("tb"), size, enough, differences).alias("c"))
    found = found.select("a", "b", "na", "nb", "c.*").withColumn("union", F.col("na") + F.col("nb") - F.col("both"))
    linked = (F.col("both") > 0) & (100 * F.col("both") >= percent * F.col("union"))
    found = stored(found.select("a", "b", "na", "nb", linked.alias("linked"), (100 * F.col("both") >= least * F.col("union")).alias("near"), "diff"))
    return found.where("near").drop("near"), judged.where("not likely").select("a", "b").union(found.where("not near").select("a", "b"))


def shared_values(values: DataFrame, percent: int) -> DataFrame:
    """(v, rep, n, df): the rows (v, rep, n) whose value a class of a fitting size retains as well; ``df`` classes retain it in all.

    Other values make no pair, and what two possible partners share either of them keeps, so that both rank it alike.
    """
    beside = W.partitionBy("v").orderBy("n")
    fits = (F.lag("n").over(beside) * 100 >= F.col("n") * percent) | (F.lead("n").over(beside) * percent <= F.col("n") * 100)
    rows = values.select("v", "rep", "n", F.coalesce(fits, F.lit(False)).alias("fits"), F.count(F.lit(1)).over(W.partitionBy("v")).alias("df"))
    return rows.where("fits").drop("fits")


def listed_values(classes: DataFrame, percent: int) -> DataFrame:
    """Inverted lists (key, id, n, own, level, c): of each class the rarest retained values that a partner must share COUNT of.

    A list holds the classes of one value and size class (``level``), and those of the size
    class below (``own``); a pair counts in the list of the larger of its size classes.  ``c`` is
    the length of the list.
    """
    values = classes.where(F.col("n") * (100 - percent) >= percent)  # smaller sets have no other partner
    values = values.select("rep", "n", F.explode("sketch").alias("v"))
    known = shared_values(values, percent)
    whole = F.col("n") * 100 <= F.lit(K * percent)  # any partner's sketch is its whole set as well
    shared = F.when(whole, F.ceil(F.col("n") * percent / 100)).otherwise(F.lit(SHARED))
    kept = F.least("n", F.lit(K)) - shared + COUNT
    mine = W.partitionBy("rep")
    # values that no partner retains are taken for the rarest, and come first
    place = F.least("n", F.lit(K)) - F.count(F.lit(1)).over(mine) + F.row_number().over(mine.orderBy("df", "v"))
    rows = known.withColumn("place", place).where(F.col("place") <= kept).select("v", "rep", "n")
    # sets of the threshold differ in size by its inverse at most: lists are kept by size class, each class with the one below
    own = F.floor(F.log(F.col("n").cast("double")) / F.log(F.lit(100.0 / percent))).cast("int")
    rows = rows.withColumn("own", own).withColumn("level", F.explode(F.array(F.col("own"), F.col("own") + 1)))
    rows = rows.select(F.xxhash64("v", "level").alias("key"), F.col("rep").alias("id"), "n", "own", "level")
    for _ in range(PEELS):
        # a list needs a second member; a class with fewer than COUNT lists shares COUNT with none
        rows = stored(several(rows).withColumn("k", F.count(F.lit(1)).over(W.partitionBy("id", "level"))).where(F.col("k") >= COUNT).drop("k", "c"))
    return several(rows)


def several(rows: DataFrame) -> DataFrame:
    """The rows of lists of two or more members, one of them of the list's own size class, with the length ``c``."""
    counts = rows.groupBy(F.col("key").alias("k")).agg(F.count(F.lit(1)).alias("c"), F.max((F.col("own") == F.col("level")).cast("int")).alias("has"))
    return rows.join(counts.where("c > 1 and has = 1").select("k", "c"), F.col("key") == F.col("k")).drop("k")


def classes_of(seen: DataFrame) -> DataFrame:
    """rep, n, sketch, rest of every class of equal sets; only sets that may be repeated are dealt anew."""
    rows = seen.where("n > 0 and doc_id is not null").withColumn("h", F.xxhash64("digest"))
    counts = rows.groupBy("h").count().where("count > 1").select("h")
    split = sieved(rows, "h", native_sieve(counts, "h"))
    once = split.where("not __in").select(F.col("doc_id").alias("rep"), "n", "sketch", "rest")
    again = split.where("__in").groupBy("digest").agg(F.min("doc_id").alias("rep"), F.first("n").alias("n"), F.first("sketch").alias("sketch"), F.first("rest").alias("rest"))
    return once.union(stored(again.select("rep", "n", "sketch", "rest")))


def near_duplicates(docs: DataFrame, size: int = 2, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles, component_id, kept for every row of ``docs`` (doc_id, text)."""
    seen = stored(docs.select("doc_id", sketches(whole_text(), size).alias("s")).select("doc_id", "s.*"))
    classes = classes_of(seen)
    lists = stored(listed_values(classes, percent))
    hubs = stored(hubs_of(lists.where("own = level")))
    # every list's members against its hub, the nearer ones with their differences from it
    stars = lists.join(hubs, "key").where("hub != id").groupBy(F.col("hub").alias("a"), F.col("id").alias("b")).count().where(F.col("count") >= COUNT).select("a", "b")
    near, far = measured_pairs(stars, classes, docs, size, percent, 2 * percent - 100, differences=True)
    first = near.where("linked").select("a", "b")
    comps = components(first)
    # what may still be linked across components
    sized = lambda one, two: (F.greatest(one("own"), two("own")) == one("level")) & (F.lit(percent) * F.greatest(one("n"), two("n")) <= F.lit(100) * F.least(one("n"), two("n")))
    pairs = across_lists(lists.drop("c"), ["id", "level"], hubs, near, far, comps, COUNT, sized)
    second = measured_pairs(pairs, classes, docs, size, percent, percent)[0].where("linked").select("a", "b")
    second = second.union(linked_by_difference(near, comps, percent))
    labels = components(first.union(second))
    reps = seen.where("n > 0 and doc_id is not null").groupBy(F.col("digest").alias("d2")).agg(F.min("doc_id").alias("rep"))
    placed = seen.join(reps, (F.col("digest") == F.col("d2")) & (F.col("n") > 0) & F.col("doc_id").isNotNull(), "left")
    rooted = placed.join(labels, F.col("rep") == F.col("node"), "left")
    component = F.coalesce("root", "rep", "doc_id")
    return rooted.select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"))


def op9_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_shingles, component_id, kept of every document: two-word shingles, similarity 0.8."""
    return near_duplicates(table(spark, sf_dir, "documents"), 2, 80)


#: The plain way: all shingles as strings, all pairs that share one, and every chain of links.
OP9_SQL = """
WITH RECURSIVE split AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS words
  FROM documents),
sets AS (
  SELECT doc_id, CASE WHEN len(words) < 2 THEN words ELSE list_distinct(list_transform(range(1, len(words)), lambda i: words[i] || ' ' || words[i + 1])) END AS shingles
  FROM split),
sized AS (SELECT doc_id, len(shingles) AS n FROM sets),
held AS (SELECT doc_id, unnest(shingles) AS shingle FROM sets),
shared AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS n_both FROM held a JOIN held b ON a.shingle = b.shingle AND a.doc_id < b.doc_id GROUP BY ALL),
links AS (SELECT a, b FROM shared JOIN sized x ON x.doc_id = a JOIN sized y ON y.doc_id = b WHERE 100 * n_both >= 80 * (x.n + y.n - n_both)),
ways AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reach AS (SELECT doc_id AS node, doc_id AS label FROM sized UNION SELECT w.b, r.label FROM reach r JOIN ways w ON w.a = r.node WHERE r.label < w.b),
named AS (SELECT node, min(label) AS component_id FROM reach GROUP BY node)
SELECT doc_id, CAST(n AS BIGINT) AS n_shingles, component_id, doc_id = component_id AS kept FROM sized JOIN named ON node = doc_id
"""
