"""Media columns by content-defined chunking.

A payload is cut where a rolling gear hash of its last 32 bytes has zeros in its low
bits, so that equal passages give equal chunks wherever they stand.  Chunk digests are
counted by Spark; chunks that several payloads share are kept once in a chunk store,
the others stay with their payload.  A stored medium is an ordered chunk list with the
8-bit samples of its chunks; it is put together from the list and, by joins on the
digests, from the store, and every chunk is verified against its digest when the
medium is read back.

Which chunks are shared is looked up in a sieve of fixed size; it may send a chunk
through the store that nobody shares, which changes nothing but the way it takes.
Null text is empty: its payload is one unit of padding.  Very long texts are cut whole, into
chunks of bounded size.  Equal texts give equal media, repeated rows stay rows of their own;
hot chunks and groups of copies are stored once.  An empty table gives an empty result; other columns are not looked at.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from meshwright.llm.common import in_sieve, sieve_bits, stored, table, whole_text

#: Payloads are padded by blanks to a positive multiple of this.
UNIT = 192
#: Least and most bytes of a chunk, and the low bits of the rolling hash that are zero at a cut.
LEAST, MOST, MASK = 512, 8192, np.uint32((1 << 10) - 1)
#: Rows that a worker holds at once.
ROWS = 256
#: The gear table: a number for each byte, from a rule.
GEAR = np.array([xxhash.xxh32_intdigest(bytes([b]), 192) for b in range(256)], dtype=np.uint32)
MAGIC = b"CDC1"
HEAD, ENTRY = "<4sQI", "<I16s"
HEAD_SIZE, ENTRY_SIZE = struct.calcsize(HEAD), struct.calcsize(ENTRY)


def payload_of(text: str) -> bytes:
    data = text.encode()
    return data + b" " * (max(UNIT, -(-len(data) // UNIT) * UNIT) - len(data))


def cuts(data: bytes) -> list[int]:
    """The ends of the chunks of a payload."""
    h = GEAR[np.frombuffer(data, np.uint8)]
    for step in (1, 2, 4, 8, 16):  # doubling: each pass covers twice as many of the last bytes
        moved = h[:-step] << np.uint32(step)
        h = h.copy()
        h[step:] += moved
    ends, last = [], 0
    for at in (np.flatnonzero((h & MASK) == 0) + 1).tolist():
        while at - last > MOST:
            last += MOST
            ends.append(last)
        if at - last >= LEAST:
            last = at
            ends.append(last)
    while len(data) - last > MOST:
        last += MOST
        ends.append(last)
    if last < len(data):
        ends.append(len(data))
    return ends


def chunks(data: bytes) -> list[bytes]:
    ends = cuts(data)
    return [data[a:b] for a, b in zip([0, *ends], ends, strict=False)]


def digest_of(chunk: bytes) -> bytes:
    return hashlib.blake2b(chunk, digest_size=16).digest()


def key_of(digest: bytes) -> int:
    return int.from_bytes(digest[:8], "little", signed=True)


def by_rows(batches: Iterator[pa.RecordBatch], make: Callable[[pa.RecordBatch], pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Work through Arrow batches a few rows at a time and give unused memory back, so that a worker stays small."""
    for batch in batches:
        for at in range(0, batch.num_rows, ROWS):
            yield make(batch.slice(at, ROWS))
        pa.default_memory_pool().release_unused()


def digest_keys(rows: DataFrame) -> DataFrame:
    """(key): the first 64 bits of the digest of every chunk of every text."""

    def keys(batch: pa.RecordBatch) -> pa.RecordBatch:
        found = [key_of(digest_of(c)) for x in batch.column("text") for c in chunks(payload_of(x.as_py()))]
        return pa.RecordBatch.from_arrays([pa.array(found, pa.int64())], ["key"])

    return rows.select("text").mapInArrow(lambda batches: by_rows(batches, keys), "key long")


def chunk_lists(rows: DataFrame, shared: Broadcast) -> DataFrame:
    """``rows`` with its text replaced by ``media``, a digest of the whole payload, and ``chunks`` in order; the body is null where the sieve holds it."""

    def cut(batch: pa.RecordBatch) -> pa.RecordBatch:
        media, lists, digests, bodies = [], [0], [], []
        for x in batch.column("text"):
            data = payload_of(x.as_py())
            parts = chunks(data)
            media.append(digest_of(data))
            own = [digest_of(c) for c in parts]
            common = in_sieve(np.array([key_of(d) for d in own], dtype=np.int64), shared.value)
            digests += own
            bodies += [None if hit else c for c, hit in zip(parts, common.tolist(), strict=True)]
            lists.append(len(digests))
        inner = pa.StructArray.from_arrays([pa.array(digests, pa.binary()), pa.array(bodies, pa.binary())], ["digest", "body"])
        kept = [name for name in batch.schema.names if name != "text"]
        return pa.RecordBatch.from_arrays([*(batch.column(name) for name in kept), pa.array(media, pa.binary()), pa.ListArray.from_arrays(pa.array(lists, pa.int32()), inner)], [*kept, "media", "chunks"])

    schema = T.StructType([f for f in rows.schema.fields if f.name != "text"]).add("media", "binary").add("chunks", T.ArrayType(T.StructType().add("digest", "binary").add("body", "binary")))
    return rows.mapInArrow(lambda batches: by_rows(batches, cut), schema)


def shared_bodies(rows: DataFrame, shared: Broadcast) -> DataFrame:
    """(digest, body) of the chunks of all texts that the sieve holds."""

    def bodies(batch: pa.RecordBatch) -> pa.RecordBatch:
        digests, found = [], []
        for x in batch.column("text"):
            parts = chunks(payload_of(x.as_py()))
            own = [digest_of(c) for c in parts]
            common = in_sieve(np.array([key_of(d) for d in own], dtype=np.int64), shared.value)
            for digest, body, hit in zip(own, parts, common.tolist(), strict=True):
                if hit:
                    digests.append(digest)
                    found.append(body)
        return pa.RecordBatch.from_arrays([pa.array(digests, pa.binary()), pa.array(found, pa.binary())], ["digest", "body"])

    return rows.select("text").mapInArrow(lambda batches: by_rows(batches, bodies), "digest binary, body binary")


def built(own: list[dict], found: list[bytes]) -> bytes:
    """The stored medium of an ordered chunk list, the missing bodies taken from the store's in their order."""
    rest = iter(found)
    parts = [(c["digest"], next(rest) if c["body"] is None else c["body"]) for c in own]
    head = struct.pack(HEAD, MAGIC, sum(len(b) for _, b in parts), len(parts))
    return b"".join([head, *(struct.pack(ENTRY, len(b), d) for d, b in parts), *(b for _, b in parts)])


def read_back(media: bytes) -> tuple[bytes, int]:
    """Payload and number of chunks of a stored medium; raises where a chunk is not what its digest says."""
    magic, size, n = struct.unpack_from(HEAD, media)
    if magic != MAGIC:
        raise ValueError("not a chunked medium")
    at = HEAD_SIZE + n * ENTRY_SIZE
    for i in range(n):
        length, digest = struct.unpack_from(ENTRY, media, HEAD_SIZE + i * ENTRY_SIZE)
        if digest_of(media[at : at + length]) != digest:
            raise ValueError("a chunk does not match its digest")
        at += length
    payload = media[HEAD_SIZE + n * ENTRY_SIZE :]
    if len(payload) != size or at != len(media):
        raise ValueError("a medium has the wrong length")
    return payload, n


def facts_of(medium: bytes) -> dict:
    """What is known of a medium once it is read back and verified.

    feature: chunks, mean, standard deviation and range of the samples, and crossings of their mean.
    """
    payload, n = read_back(medium)
    samples = np.frombuffer(payload, np.uint8)
    mean = samples.mean()
    over = samples > mean
    feature = f"{n};{mean:.4f};{samples.std():.4f};{samples.min()}-{samples.max()};{np.count_nonzero(over[1:] != over[:-1])}"
    return {"payload_bytes": len(payload), "payload_sha256": hashlib.sha256(payload).hexdigest(), "tail_crc32": zlib.crc32(payload[-16:]), "media_bytes": len(medium), "media_sha256": hashlib.sha256(medium).hexdigest(), "feature": feature}


FACTS = [("payload_bytes", pa.int64()), ("payload_sha256", pa.string()), ("tail_crc32", pa.int64()), ("media_bytes", pa.int64()), ("media_sha256", pa.string()), ("feature", pa.string())]


def media_of(batch: pa.RecordBatch) -> Iterator[bytes]:
    """The stored media of rows of chunk lists and of the bodies that the store gave, in their order."""
    for own, more in zip(batch.column("chunks"), batch.column("bodies"), strict=True):
        yield built(own.as_py(), more.as_py() or [])


def assembled(rows: DataFrame) -> DataFrame:
    """``rows`` (with chunks and bodies) with the stored ``medium`` in their place."""
    kept = [c for c in rows.columns if c not in ("chunks", "bodies")]

    def build(batch: pa.RecordBatch) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), pa.array(media_of(batch), pa.binary())], [*kept, "medium"])

    schema = T.StructType([rows.schema[c] for c in kept]).add("medium", "binary")
    return rows.mapInArrow(lambda batches: by_rows(batches, build), schema)


def assembled_features(rows: DataFrame) -> DataFrame:
    """``rows`` (with chunks and bodies) with the facts of their media in their place; these are put together and read back in one pass."""
    kept = [c for c in rows.columns if c not in ("chunks", "bodies")]

    def read(batch: pa.RecordBatch) -> pa.RecordBatch:
        facts = [facts_of(m) for m in media_of(batch)]
        return pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), *(pa.array([f[k] for f in facts], t) for k, t in FACTS)], [*kept, *(k for k, _ in FACTS)])

    schema = T.StructType([rows.schema[c] for c in kept])
    for k, t in FACTS:
        schema = schema.add(k, "long" if t == pa.int64() else "string")
    return rows.mapInArrow(lambda batches: by_rows(batches, read), schema)


def chunked(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, chunks and bodies of every row of ``docs`` (doc_id, text): its ordered chunk list, and from the store what that lacks."""
    rows = docs.select("doc_id", whole_text().alias("text"))
    used = digest_keys(rows).groupBy("key").count()
    shared = sieve_bits(used.where("count > 1").select("key"), "key")
    # chunk store: one body for each digest
    store = stored(shared_bodies(rows, shared).groupBy("digest").agg(F.first("body").alias("body")))
    listed = stored(chunk_lists(rows.withColumn("n_bytes", F.octet_length("text").cast("long")), shared))
    refers = F.exists("chunks", lambda c: c["body"].isNull())
    whole = listed.where(~refers).select("doc_id", "n_bytes", "chunks", F.array().cast("array<binary>").alias("bodies"))
    partly = listed.where(refers)
    # ordered references of each distinct payload, looked up in the store
    references = partly.select("media", F.posexplode(F.filter("chunks", lambda c: c["body"].isNull())).alias("seq", "c")).select("media", "seq", "c.digest").distinct()
    bodies = references.join(store.select(F.col("digest").alias("d"), "body"), F.col("digest") == F.col("d")).groupBy("media").agg(F.array_sort(F.collect_list(F.struct("seq", "body"))).alias("found"))
    joined = partly.join(bodies.select(F.col("media").alias("m"), F.col("found.body").alias("bodies")), F.col("media") == F.col("m")).select("doc_id", "n_bytes", "chunks", "bodies")
    return whole.union(joined)


def store_media(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes and ``medium`` (the stored form) of every row of ``docs`` (doc_id, text)."""
    return assembled(chunked(docs))


def op1_media_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_bytes, payload_bytes, payload_sha256, tail_crc32, media_bytes, media_sha256, feature of every document."""
    return assembled_features(chunked(table(spark, sf_dir, "documents")))
