"""Target-distribution importance resampling over hashed n-grams whose CRCs are composed, not computed from strings.

Features are all runs of 1 to ``most`` consecutive words, joined by one space; a feature's
bucket is the CRC-32 of its bytes modulo the number of buckets.  The CRC of a
concatenation follows from those of its parts: appending n bytes multiplies a CRC by the
n-th power of a matrix over GF(2), and the CRC of what was appended is added.  So each
word's CRC is computed once, and an n-gram's is composed from its words' with matrices
for the words' lengths; no n-gram is ever built as a string.

Buckets of the corpus and of the target are counted, each task counting into an array of
fixed length; their smoothed log-ratio is a bucket's gain.  A document weighs the mean
gain of its features, to which a Gumbel number drawn from a hash of its id is added: the
highest sums are a draw without replacement by those weights.  Texts are read twice, as
bytes in slices of bounded size, and only numbers are shuffled.

A null text has no words; a document without words weighs 0 and is not drawn, nor is one with fewer
words than ``least``.  A null id draws its number as an empty id does and stands after others of its score;
equal rows are ranked one after another.  Very long texts and very long words are taken whole.  With an empty
target all gains come from the corpus; an empty corpus gives an empty result.  Other columns are not looked at.
"""

from __future__ import annotations

import hashlib
import math
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from meshwright.llm.common import stored, table
from meshwright.llm.mixing import COPIES, running_sums

BUCKETS = 10_000
#: Words of the longest run.
MOST = 2
#: Words that a document needs to be drawn.
LEAST = 20
PERCENT = 25
SEED = 7
#: Bytes of text that are worked on at once (more only if a single text is longer).
SLICE = 1 << 20
#: Lengths with a matrix of their own; longer ones are composed from powers of two.
SHORT = 64

#: The reflected CRC-32 polynomial, and 2**32.
POLYNOMIAL = 0xEDB88320
TWO32 = 4294967296


@lru_cache(maxsize=1)
def byte_table() -> np.ndarray:
    """What each byte makes of a CRC register that holds it alone."""
    c = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        c = np.where(c & 1, (c >> 1) ^ np.uint32(POLYNOMIAL), c >> 1)
    return c


def through(tables: np.ndarray, c: np.ndarray) -> np.ndarray:
    """CRCs multiplied by a matrix; ``tables`` (4, 256) are the images of the four bytes of a register."""
    out = tables[0][c & np.uint32(0xFF)]
    for k in (1, 2, 3):
        out = out ^ tables[k][(c >> np.uint32(8 * k)) & np.uint32(0xFF)]
    return out


def squared(tables: np.ndarray) -> np.ndarray:
    """The matrix applied twice."""
    return np.stack([through(tables, tables[k]) for k in range(4)])


def one_byte() -> np.ndarray:
    """The matrix that one zero byte applies to a CRC."""
    table, c = byte_table(), np.arange(256, dtype=np.uint32)
    return np.stack([table[c]] + [table[np.zeros(256, np.intp)] ^ (c << np.uint32(8 * (k - 1))) for k in (1, 2, 3)])


@lru_cache(maxsize=1)
def shifts() -> tuple[np.ndarray, list[np.ndarray]]:
    """Matrices for 0 to SHORT - 1 bytes, as (SHORT, 4, 256), and for every power of two bytes."""
    one = one_byte()
    identity = np.stack([np.arange(256, dtype=np.uint32) << np.uint32(8 * k) for k in range(4)])
    short = [identity]
    for _ in range(SHORT - 1):
        short.append(np.stack([through(one, short[-1][k]) for k in range(4)]))
    powers = [one]
    for _ in range(40):
        powers.append(squared(powers[-1]))
    return np.stack(short), powers


def shifted(c: np.ndarray, length: np.ndarray) -> np.ndarray:
    """Each CRC after as many zero bytes as ``length`` says, so that what was appended has only to be added."""
    short, powers = shifts()
    near = np.minimum(length, SHORT - 1)
    out = short[near, 0, c & 0xFF]
    for k in (1, 2, 3):
        out = out ^ short[near, k, (c >> np.uint32(8 * k)) & np.uint32(0xFF)]
    far = np.flatnonzero(length >= SHORT)
    if len(far):
        part, left = c[far], length[far].astype(np.int64)
        for k in range(int(left.max()).bit_length()):
            on = (left >> k) & 1 == 1
            part[on] = through(powers[k], part[on])
        out[far] = part
    return out


def _word_bytes() -> tuple[np.ndarray, np.ndarray]:
    """Which bytes belong to words, and what each byte is in lower case (A-Z only)."""
    lower = np.arange(256, dtype=np.uint8)
    lower[65:91] += 32
    inside = np.ones(256, dtype=bool)
    for first, last in ((0x00, 0x2F), (0x3A, 0x60), (0x7B, 0x7F)):
        inside[first : last + 1] = False
    return inside, lower


_INSIDE, _LOWER = _word_bytes()


def word_crcs(data: np.ndarray, start: np.ndarray, length: np.ndarray) -> np.ndarray:
    """CRC-32 of every word of ``data`` (bytes), each at its place and length."""
    table = byte_table()
    out = np.zeros(len(start), dtype=np.uint32)
    short = np.flatnonzero(length < SHORT)
    order = short[np.argsort(-length[short], kind="stable")]
    begin, size = start[order], length[order]
    c = np.full(len(order), 0xFFFFFFFF, dtype=np.uint32)
    # longest words first, so that those with a j-th byte are a prefix
    left = np.searchsorted(-size, -np.arange(int(size[0]) if len(size) else 0), side="left")
    for j, n in enumerate(left):
        c[:n] = table[(c[:n] ^ data[begin[:n] + j]) & np.uint32(0xFF)] ^ (c[:n] >> np.uint32(8))
    out[order] = c ^ np.uint32(0xFFFFFFFF)
    for i in np.flatnonzero(length >= SHORT):
        out[i] = zlib.crc32(data[start[i] : start[i] + length[i]])
    return out


def hashed(data: np.ndarray, ends: np.ndarray, most: int = MOST, buckets: int = BUCKETS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, bucket) of every feature, and the words of each text; ``data`` holds the texts' bytes on end, ``ends`` where each stops."""
    data = _LOWER[data]
    inside = _INSIDE[data]
    # a text's last byte ends its word
    edge = np.zeros(len(data) + 1, dtype=bool)
    edge[0] = True
    edge[ends] = True
    before = np.concatenate([[False], inside[:-1]]) & ~edge[:-1]
    after = np.concatenate([inside[1:], [False]]) & ~edge[1:]
    start, stop = np.flatnonzero(inside & ~before), np.flatnonzero(inside & ~after) + 1
    length = stop - start
    text = np.searchsorted(ends, start, side="right")
    crc = word_crcs(data, start, length)
    space = np.uint32(zlib.crc32(b" "))
    step = shifts()[0][1]
    texts, found, run, own = [text], [crc % np.uint32(buckets)], crc, text
    for n in range(2, most + 1):
        last = slice(n - 1, None)  # the word that a run of n words ends with
        run = through(step, run[:-1]) ^ space
        run = shifted(run, length[last]) ^ crc[last]
        fits = own[: len(run)] == text[last]
        texts.append(text[last][fits])
        found.append(run[fits] % np.uint32(buckets))
        own = text[: len(run)]
    return np.concatenate(texts), np.concatenate(found).astype(np.int64), np.bincount(text, minlength=len(ends))


def slices(column: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first, last, bytes, ends) of consecutive texts of about SLICE bytes together; null texts are empty."""
    column = column.cast(pa.large_binary()).fill_null(b"")
    sizes = np.diff(np.frombuffer(column.buffers()[1], dtype=np.int64, count=len(column) + 1, offset=column.offset * 8))
    first = 0
    while first < len(column):
        last = first + max(1, int(np.searchsorted(np.cumsum(sizes[first : first + 65536]), SLICE, side="right")))
        part = column.slice(first, last - first)
        ends = np.cumsum(sizes[first:last])
        at = np.frombuffer(part.buffers()[1], dtype=np.int64, count=1, offset=part.offset * 8)[0]
        data = np.frombuffer(part.buffers()[2], dtype=np.uint8, count=int(ends[-1]), offset=int(at)) if ends[-1] else np.zeros(0, np.uint8)
        yield first, last, data, ends
        first = last


def bucket_counts(df: DataFrame, text: str = "text", most: int = MOST, buckets: int = BUCKETS) -> np.ndarray:
    """How many features of a table's texts fall into each bucket."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, dtype=np.int64)
        for batch in batches:
            for _, _, data, ends in slices(batch.column(0)):
                total += np.bincount(hashed(data, ends, most, buckets)[1], minlength=buckets)
        held = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(held, pa.int64()), pa.array(total[held], pa.int64())], ["bucket", "n"])

    # no more rows than buckets reach the driver
    found = df.select(F.col(text).cast("string").alias("text")).mapInArrow(count, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(buckets, dtype=np.int64)
    out[found["bucket"].to_numpy()] = found["n"].to_numpy()
    return out


def gains(corpus: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Per bucket, a thousand times the smoothed log-ratio of its shares in the target and in the corpus, floored."""
    n = len(corpus)
    top, under = float(corpus.sum() + n), float(target.sum() + n)
    return np.array([math.floor(1000 * math.log((float(t + 1) * top) / (float(s + 1) * under))) for s, t in zip(corpus, target, strict=True)], dtype=np.int64)


def noise(key: int | None, seed: int = SEED) -> int:
    """A thousand times a Gumbel number that depends on the id, floored."""
    h = int(hashlib.sha256(f"{seed}:{'' if key is None else key}".encode()).hexdigest()[:8], 16)
    return math.floor(-1000 * math.log(-math.log((h + 0.5) / TWO32)))


def weigh(df: DataFrame, gain: np.ndarray, key: str = "doc_id", text: str = "text", most: int = MOST, seed: int = SEED) -> DataFrame:
    """doc_id, n_words, n_features, weight and score of every row."""

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, last, data, ends in slices(batch.column(1)):
                of, bucket, words = hashed(data, ends, most, len(gain))
                n = np.bincount(of, minlength=len(ends))
                total = np.bincount(of, weights=gain[bucket], minlength=len(ends)).astype(np.int64)  # exact: far below 2**53
                weight = np.where(n > 0, total // np.maximum(n, 1), 0)
                ids = batch.column(0).slice(first, last - first)
                drawn = np.array([noise(x, seed) for x in ids.to_pylist()], dtype=np.int64)
                yield pa.RecordBatch.from_arrays([ids, *[pa.array(x, pa.int64()) for x in (words, n, weight, weight + drawn)]], ["doc_id", "n_words", "n_features", "weight", "score"])

    rows = df.select(F.col(key).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    return rows.mapInArrow(measure, "doc_id long, n_words long, n_features long, weight long, score long")


def draw(weighed: DataFrame, percent: int = PERCENT, least: int = LEAST) -> DataFrame:
    """doc_id, n_features, weight, score and rank; rank is null for rows that are not drawn."""
    may = F.col("n_words") >= least
    counted = weighed.groupBy("doc_id", "n_features", "weight", "score", may.alias("may")).agg(F.count(F.lit(1)).alias("n"))
    counted = stored(counted)
    found = counted.where("may")
    size = found.agg(F.sum("n")).collect()[0][0] or 0
    quota = percent * size // 100
    order = [F.col("score").desc(), F.col("doc_id").asc_nulls_last(), F.col("n_features"), F.col("weight")]
    ranked = running_sums(found.select("doc_id", "n_features", "weight", "score", "n"), order, {"before": "n"})
    out = ranked.union(counted.where("not may").select("doc_id", "n_features", "weight", "score", "n", F.lit(None).cast("long").alias("before")))
    first = F.sequence(F.lit(0).cast("long"), F.col("n") - 1, F.lit(COPIES).cast("long"))
    out = out.select("*", F.explode(first).alias("from"))
    copy = F.sequence(F.col("from"), F.least(F.col("from") + COPIES, F.col("n")) - 1)
    out = out.select("*", F.explode(copy).alias("copy"))
    rank = F.col("before") + F.col("copy") + 1
    return out.select("doc_id", "n_features", "weight", "score", F.when(rank <= quota, rank).alias("rank"))


def resample(docs: DataFrame, target: DataFrame, percent: int = PERCENT, least: int = LEAST, most: int = MOST, buckets: int = BUCKETS, seed: int = SEED) -> DataFrame:
    """doc_id, n_features, weight, score, rank of every row of ``docs`` (doc_id, text), drawn towards ``target`` (text)."""
    gain = gains(bucket_counts(docs, "text", most, buckets), bucket_counts(target, "text", most, buckets))
    return draw(weigh(docs, gain, most=most, seed=seed), percent, least)


def op12_resample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_features, weight, score, rank of every document, drawn towards the benchmark."""
    return resample(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark").select("text"))


_TABLE = ", ".join(str(int(x)) for x in byte_table())
_STEP = f"xor(c >> 8, ([{_TABLE}])[CAST(xor(c, b) & 255 AS INTEGER) + 1])"
_RUNS = """list_concat(words, list_transform(range(1, len(words)), lambda i: words[i] || ' ' || words[i + 1]))"""
#: The plain way: every feature as a string, its CRC byte by byte.
OP12_SQL = f"""
WITH texts AS (
  SELECT doc_id, text, true AS own FROM documents UNION ALL SELECT NULL, text, false FROM benchmark),
split AS (
  SELECT row_number() OVER () AS nr, doc_id, own,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS words
  FROM texts),
runs AS (SELECT nr, own, unnest({_RUNS}) AS feature FROM split),
known AS (SELECT feature, hex(encode(feature)) AS h FROM (SELECT DISTINCT feature FROM runs)),
bytes AS (SELECT feature, list_concat([CAST(4294967295 AS BIGINT)], list_transform(range(0, len(h) // 2), lambda i: CAST('0x' || substr(h, 2 * i + 1, 2) AS BIGINT))) AS l FROM known),
buckets AS (SELECT feature, xor(list_reduce(l, lambda c, b: {_STEP}), 4294967295) % {BUCKETS} AS bucket FROM bytes),
found AS (SELECT nr, own, bucket FROM runs JOIN buckets USING (feature)),
counted AS (SELECT bucket, count(*) FILTER (own) AS s, count(*) FILTER (NOT own) AS t FROM found GROUP BY bucket),
sums AS (SELECT coalesce(sum(s), 0) AS sa, coalesce(sum(t), 0) AS ta FROM counted),
gains AS (SELECT bucket, CAST(floor(1000 * ln((CAST(t + 1 AS DOUBLE) * (sa + {BUCKETS})) / (CAST(s + 1 AS DOUBLE) * (ta + {BUCKETS})))) AS BIGINT) AS gain FROM counted, sums),
weighed AS (SELECT nr, count(*) AS n, CAST(floor(CAST(sum(gain) AS DOUBLE) / count(*)) AS BIGINT) AS weight FROM found JOIN gains USING (bucket) WHERE own GROUP BY nr),
scored AS (
  SELECT s.doc_id, len(s.words) AS n_words, coalesce(w.n, 0) AS n_features, coalesce(w.weight, 0) AS weight,
    coalesce(w.weight, 0) + CAST(floor(-1000 * ln(-ln((CAST('0x' || substr(sha256('{SEED}:' || coalesce(CAST(s.doc_id AS VARCHAR), '')), 1, 8) AS BIGINT) + 0.5) / 4294967296))) AS BIGINT) AS score
  FROM split s LEFT JOIN weighed w USING (nr) WHERE s.own),
ranked AS (
  SELECT *, n_words >= {LEAST} AS may, row_number() OVER (PARTITION BY n_words >= {LEAST} ORDER BY score DESC, doc_id NULLS LAST, n_features, weight) AS place,
    count(*) FILTER (n_words >= {LEAST}) OVER () AS n
  FROM scored)
SELECT doc_id, n_features, weight, score, CASE WHEN may AND place <= {PERCENT} * n // 100 THEN place END AS rank FROM ranked
"""
