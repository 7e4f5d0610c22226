"""Byte-level BPE through a sentencepiece model serialised from a rank file.

The rank file lists (base64 bytes, rank) pairs.  A sentencepiece BPE model is
written directly in its wire format: every byte is mapped to one character, every
vocabulary entry becomes a piece of such characters with the score ``-rank`` and
the normaliser is the identity, so that the best-scored merge is the merge of the
lowest rank.  Texts are cut into pre-tokens by a pattern, each pre-token is encoded
by itself, and ids are decoded by the inverse mapping.

Null text is read as empty and gives an empty id list; a null id list decodes to
null.  Repeated rows, ties and very long texts need no special case: a pre-token is
encoded in O(n log n) and only one Arrow batch of texts is held at a time.  An empty table
gives an empty result, and other columns than those asked for are not looked at.
"""

from __future__ import annotations

import base64
import codecs
import re
import struct
from collections.abc import Callable
from itertools import chain

import numpy as np
import public_tokenizers
import pyarrow as pa
import regex
import sentencepiece
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from meshwright.llm.common import table, whole_text

#: First character of the block that stands for bytes 0 to 255.
BYTE_BASE = 0x100
#: Pre-tokens remembered by one Python worker before its memo is emptied.
MEMO = 400_000
#: Texts encoded together.
BLOCK = 128


def read_ranks(path: str) -> dict[bytes, int]:
    """The vocabulary of a rank file: token bytes to rank."""
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in lines if line.strip())}


def _varint(n: int) -> bytes:
    out = bytearray()
    while n > 0x7F:
        out.append(n & 0x7F | 0x80)
        n >>= 7
    out.append(n)
    return bytes(out)


def _field(number: int, value: int | float | bytes) -> bytes:
    if isinstance(value, bytes):
        return _varint(number << 3 | 2) + _varint(len(value)) + value
    if isinstance(value, float):
        return _varint(number << 3 | 5) + struct.pack("<f", value)
    return _varint(number << 3) + _varint(value)


_CHARS = "".join(chr(BYTE_BASE + b) for b in range(256))


def mapped(data: bytes) -> str:
    """Bytes as the characters that stand for them."""
    return codecs.charmap_decode(data, "strict", _CHARS)[0]


def serialise(ranks: dict[bytes, int]) -> bytes:
    """A sentencepiece ModelProto: piece 0 is the unknown piece, piece r + 1 the token of the r-th smallest rank."""
    kind_unknown, model_bpe = 2, 2
    pieces = [_field(1, _field(1, b"<unk>") + _field(2, 0.0) + _field(3, kind_unknown))]
    pieces += [_field(1, _field(1, mapped(token).encode()) + _field(2, float(-rank))) for token, rank in sorted(ranks.items(), key=lambda x: x[1])]
    trainer = _field(3, model_bpe) + _field(4, len(pieces)) + b"".join(_field(n, (1 << 64) - 1) for n in (41, 42, 43))
    normaliser = _field(1, b"identity") + _field(3, 0) + _field(4, 0) + _field(5, 0)
    return b"".join(pieces) + _field(2, trainer) + _field(3, normaliser)


def cutter(pattern: str) -> Callable[[str], list[str]]:
    """What cuts a text into pre-tokens.

    For the public pattern, texts within Latin-1 go through the standard library's faster
    engine, with the letters, numbers and white space of that block spelled out.
    """
    general = regex.compile(pattern).findall
    if pattern != public_tokenizers.PATTERN:
        return general
    latin = [chr(i) for i in range(256)]
    classes = {name: "".join(re.escape(c) for c in latin if regex.match(kind, c)) for name, kind in (("L", r"\p{L}"), ("N", r"\p{N}"), ("S", r"\s"))}
    quick = re.compile("'s|'t|'re|'ve|'m|'ll|'d| ?[{L}]+| ?[{N}]+| ?[^{S}{L}{N}]+|[{S}]+(?![^{S}])|[{S}]+".format(**classes)).findall

    def cut(text: str) -> list[str]:
        try:
            text.encode("latin-1")
        except UnicodeEncodeError:
            return general(text)
        return quick(text)

    return cut


class ByteBpe:
    """Encoder and decoder of one rank file."""

    def __init__(self, path: str, pattern: str) -> None:
        self.ranks = read_ranks(path)
        self.tokens: dict[int, bytes] = {rank: token for token, rank in self.ranks.items()}
        self.by_piece = np.array([-1, *sorted(self.tokens)], dtype=np.int32)
        self.cut = cutter(pattern)
        self.model = sentencepiece.SentencePieceProcessor()
        self.model.LoadFromSerializedProto(serialise(self.ranks))
        self.memo: dict[str, bytes] = {}

    def learn(self, fresh: list[str]) -> None:
        """Encode pre-tokens by the model (whole tokens directly) and remember their ids as 32-bit numbers."""
        raw = [word.encode() for word in fresh]
        rest = []
        for word, data in zip(fresh, raw, strict=True):
            whole = self.ranks.get(data)
            if whole is None:
                rest.append((word, data))
            else:
                self.memo[word] = whole.to_bytes(4, "little")
        found = self.model.encode([mapped(data) for _, data in rest], num_threads=1)
        ids = self.by_piece[np.fromiter(chain.from_iterable(found), dtype=np.int32)].astype("<i4").tobytes()
        at = 0
        for (word, _), pieces in zip(rest, found, strict=True):
            end = at + 4 * len(pieces)
            self.memo[word] = ids[at:end]
            at = end

    def encode_block(self, texts: list[str]) -> list[bytes]:
        """The ids of texts, each as little-endian 32-bit numbers."""
        if len(self.memo) > MEMO:
            self.memo.clear()
        split = [self.cut(x) for x in texts]
        if fresh := set().union(*split) - self.memo.keys():
            self.learn(list(fresh))
        of = self.memo.__getitem__
        return [b"".join(map(of, words)) for words in split]

    def encode(self, text: str) -> list[int]:
        return np.frombuffer(self.encode_block([text])[0], "<i4").tolist()

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.tokens.__getitem__, ids))


_LOADED: dict[tuple[str, str], ByteBpe] = {}


def loaded(path: str, pattern: str) -> ByteBpe:
    """One encoder per Python worker."""
    if (path, pattern) not in _LOADED:
        _LOADED[path, pattern] = ByteBpe(path, pattern)
    return _LOADED[path, pattern]


def encode(text: Column, path: str, pattern: str = public_tokenizers.PATTERN) -> Column:
    """The ids of a text column, array<int>."""

    @F.arrow_udf(T.ArrayType(T.IntegerType(), False))
    def ids_of(texts: pa.Array) -> pa.Array:
        bpe = loaded(path, pattern)
        rows = [ids for at in range(0, len(texts), BLOCK) for ids in bpe.encode_block(texts[at : at + BLOCK].to_pylist())]
        ends = np.cumsum([0, *(len(x) // 4 for x in rows)], dtype=np.int32)
        return pa.ListArray.from_arrays(ends, np.frombuffer(b"".join(rows), "<i4"))

    return ids_of(F.coalesce(text.cast("string"), F.lit("")))


def decode(ids: Column, path: str, pattern: str = public_tokenizers.PATTERN) -> Column:
    """The bytes that an array<int> of ids stands for; null stays null."""

    @F.arrow_udf(T.BinaryType())
    def bytes_of(lists: pa.Array) -> pa.Array:
        bpe = loaded(path, pattern)
        return pa.array([bpe.decode(x.values.to_numpy(zero_copy_only=False).tolist()) if x.is_valid else None for x in lists], pa.binary())

    return bytes_of(ids)


def digests(docs: DataFrame, path: str, pattern: str = public_tokenizers.PATTERN) -> DataFrame:
    """Encode and decode the texts of documents; digests of ids and of decoded bytes by doc_id."""
    ids = docs.select("doc_id", encode(whole_text(), path, pattern).alias("ids"))
    both = ids.select("doc_id", "ids", decode(F.col("ids"), path, pattern).alias("decoded"))
    listed = F.concat_ws(" ", F.col("ids").cast("array<string>"))
    return both.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(listed.cast("binary"), 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op2_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of every document."""
    return digests(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"))
