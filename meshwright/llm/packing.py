"""Best-fit packing of token sequences by a configuration linear program.

The pieces of all documents are counted by length.  A configuration is a multiset of
lengths that fits one sequence; the covering program asks for the fewest
configurations that hold the whole histogram.  It is solved by multiplicative
weights: each length has a weight that decays as it gets covered, and a bounded knapsack
dynamic program prices the heaviest configuration under the current weights, until
every length is covered.  The whole parts of the solution are used as they are; its
fractions are rounded up, trimmed to the pieces that are left, and the room that this
frees is priced again.  Only the histogram (at most one number per length up to the capacity) reaches
the driver, whatever the number of documents, and the plan that goes back to the
executors has a size bounded by the capacity as well.

Null text is empty and gives one piece that holds the end id.  Repeated documents,
ties and null doc_ids are placed like any others: equal rows get consecutive places.  Very long texts
are cut into pieces of the capacity, the last one shorter; an empty table gives an empty result; other columns are not looked at.
"""

from __future__ import annotations

import functools
import re
import string
import threading
import time
import unicodedata
import zlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pandas as pd
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from meshwright.llm.common import gapless_rank, stored, table, whole_text

CAPACITY = 4096
END_ID = 1
#: How often the program covers its least covered length before it is scaled down.
COVERS = 1
#: Share of its scarcest length that a priced configuration covers at once.
STEP = 0.35
#: Lengths offered to one pricing of the program, the heaviest by the token, and of what is left in the end.
OFFERED, LAST_OFFERED = 48, 144
#: What a piece as long as the capacity weighs more by the token.
LONGER = 1.0
#: How fast a covered length loses weight.
RATE = 2.0
#: Words remembered by one Python worker before its memo is emptied.
MEMO = 1_400_000
#: Seconds without texts after which a worker's memo goes.
IDLE_S = 4.0
#: Closing marks: to the tokenizer a run of its own after letters.
MARKS = string.punctuation.encode()
#: A lower-case word of letters, with or without closing marks: ASCII, and the letters from U+00DF to U+00FF, which no normalisation changes.
SHAPE = re.compile(rb"((?:[a-z]|\xc3[\x9f-\xb6\xb8-\xbf])+)([" + re.escape(MARKS) + rb"]*)").fullmatch
#: The characters that stand for bytes in the vocabulary (byte-level BPE), for bytes read as Latin-1.
_PLAIN = {*range(33, 127), *range(161, 173), *range(174, 256)}
BYTES = dict(zip([b for b in range(256) if b not in _PLAIN], range(256, 512), strict=False))
#: Bytes of text encoded at once; a longer text is taken alone.
SLICE = 4_000_000
#: Words encoded at once.
JOINED = 2000

PIECES = "array<struct<piece:int,start:bigint,length:bigint,ids_crc32:bigint>>"


def letters(word: bytes) -> bool:
    """Whether a word is letters only once it is normalised and lower-cased."""
    return word.isalpha() if word.isascii() else unicodedata.normalize("NFC", word.decode()).lower().isalpha()


class WordIds:
    """Ids of whole texts as little-endian 32-bit numbers.

    The tokenizer drops white space and never merges across it, so that a text's ids
    are those of its words, one after the other; words are encoded once and kept.  It
    lower-cases too, so that A-Z can be lower-cased before.
    """

    def __init__(self, path: str) -> None:
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        vocabulary = self.tokenizer.get_vocab()
        self.is_end = np.zeros(max(vocabulary.values()) + 1, dtype=bool)
        self.is_end[[i for token, i in vocabulary.items() if token.endswith("</w>")]] = True
        self.memo: dict[bytes, bytes] = {}
        self.lock, self.used = threading.Lock(), time.monotonic()
        threading.Thread(target=self.forget, daemon=True).start()

    def forget(self) -> None:
        """Give the memo's memory back once there have been no texts for a while: the worker lives on, beside other stages."""
        while True:
            time.sleep(IDLE_S / 2)
            with self.lock:
                if self.memo and time.monotonic() - self.used > IDLE_S:
                    self.memo = {}

    def batch(self, texts: list[str]) -> list[list[int]]:
        return [x.ids for x in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def keep(self, words: list[bytes], found: list[list[int]]) -> None:
        ids, at = np.fromiter(chain.from_iterable(found), dtype="<u4").tobytes(), 0
        for word, own in zip(words, found, strict=True):
            self.memo[word] = ids[at : (at := at + 4 * len(own))]

    def learn(self, words: list[bytes]) -> None:
        """Encode words: those of plain letters by the model alone, other letters joined by blanks, many at a time, the others one by one.

        A word of letters is one run to the tokenizer, its closing marks are another, so that the ids of a word with
        marks are those of its letters and those of its marks; each is encoded once.  Plain letters are what the normaliser and the
        pre-tokenizer leave as they are, so that only their bytes are named.
        """
        shapes, other = [], []
        for word in words:
            if shape := SHAPE(word):
                shapes.append((word, *shape.groups()))
            else:
                other.append(word)
        tokens = self.tokenizer.model.tokenize
        for core in {core for _, core, _ in shapes if core not in self.memo}:
            name = core.decode() if core.isascii() else core.decode("latin-1").translate(BYTES)
            self.memo[core] = np.array([x.id for x in tokens(name)], "<u4").tobytes()
        if rest := {marks for _, _, marks in shapes if marks and marks not in self.memo}:
            self.learn_others(list(rest))
        for word, core, marks in shapes:
            if marks:
                self.memo[word] = self.memo[core] + self.memo[marks]
        self.learn_others(other)

    def learn_others(self, words: list[bytes]) -> None:
        """Each run of a joined text ends in one word-end id.  Where the number of these ids is not that of its runs, its words are encoded singly."""
        joined, runs, other = [], [], []
        for word in words:
            if not word.isascii() and (core := word.rstrip(MARKS)) and letters(core):
                joined.append(word)
                runs.append(1 if core == word else 2)
            else:
                other.append(word)
        for at in range(0, len(joined), JOINED):
            group = joined[at : at + JOINED]
            found = np.array(self.batch([b" ".join(group).decode()])[0], dtype="<u4")
            ends, last = 4 * np.flatnonzero(self.is_end[found]) + 4, np.cumsum(runs[at : at + JOINED]) - 1
            if len(ends) == last[-1] + 1:
                ids, stops = found.tobytes(), ends[last].tolist()
                self.memo.update(zip(group, map(ids.__getitem__, map(slice, [0, *stops[:-1]], stops)), strict=True))
            else:
                other += group
        for at in range(0, len(other), JOINED):
            group = other[at : at + JOINED]
            self.keep(group, self.batch([w.decode() for w in group]))

    def encode(self, texts: pa.Array | list[str]) -> list[bytes]:
        """Ids of texts: their words are numbered by Arrow, so that a word is looked up once however often it stands there."""
        texts = texts if isinstance(texts, pa.Array) else pa.array(texts, pa.string())
        lists = pc.ascii_split_whitespace(pc.ascii_lower(texts))
        words = lists.flatten().dictionary_encode()
        distinct = words.dictionary.cast(pa.binary()).to_numpy(zero_copy_only=False).tolist()
        with self.lock:
            if len(self.memo) > MEMO:
                self.memo.clear()
            if fresh := [word for word in distinct if word not in self.memo]:
                self.learn(fresh)
            own = list(map(self.memo.__getitem__, distinct))
            self.used = time.monotonic()
        sizes = np.fromiter(map(len, own), np.int64, len(own)) // 4
        firsts = np.cumsum(sizes) - sizes
        at = words.indices.to_numpy()
        stops = np.cumsum(sizes[at])
        # a word's ids stand one after the other, both where they are kept and in its text
        places = np.repeat(firsts[at] - stops + sizes[at], sizes[at]) + np.arange(stops[-1] if len(stops) else 0)
        ids = np.frombuffer(b"".join(own), "<u4")[places]
        cuts = np.concatenate([[0], stops])[lists.offsets.to_numpy() - lists.offsets[0].as_py()].tolist()
        return [ids[a:b].tobytes() for a, b in zip(cuts[:-1], cuts[1:], strict=True)]


def slices(texts: pa.Array, most: int = SLICE) -> Iterator[pa.Array]:
    """Runs of texts of at most ``most`` bytes together, or of one."""
    ends, at = np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False).astype(np.int64)), 0
    while at < len(texts):
        before = int(ends[at - 1]) if at else 0
        to = max(at + 1, int(np.searchsorted(ends, before + most, "right")))
        yield texts[at:to]
        at = to


@functools.cache
def word_ids(path: str) -> WordIds:
    """One per Python worker."""
    return WordIds(path)


def pieces(text: Column, path: str, capacity: int = CAPACITY, end_id: int = END_ID) -> Column:
    """The pieces of a text: its ids and the end id, cut only where longer than ``capacity``."""
    end = np.array([end_id], "<u4").tobytes()

    @F.arrow_udf(PIECES)
    def cut(texts: pa.Array) -> pa.Array:
        out = []
        words = word_ids(path)
        for some in slices(texts):
            for ids in words.encode(some):
                ids += end
                out.append([{"piece": i, "start": s // 4, "length": (len(part := ids[s : s + 4 * capacity])) // 4, "ids_crc32": zlib.crc32(part)} for i, s in enumerate(range(0, len(ids), 4 * capacity))])
        return pa.array(out, pa.list_(pa.struct([("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64())])))

    return cut(F.coalesce(text.cast("string"), F.lit("")))


def price(lengths: np.ndarray, counts: np.ndarray, weights: np.ndarray, capacity: int, ties: np.random.Generator, most: int = OFFERED) -> dict[int, int]:
    """A heaviest multiset of at most ``counts`` of each length within the capacity (bounded knapsack by dynamic programming).

    Offered are the ``most`` lengths that weigh most by the token, ties in random order, so that
    equally heavy lengths take turns; each is split into lots of 1, 2, 4, ... pieces.  Of
    configurations about equally heavy the one of the longer pieces is preferred.
    """
    fits = np.flatnonzero((lengths <= capacity) & (counts > 0))
    dense = weights[fits] / lengths[fits] * (1 + 1e-6 * ties.random(len(fits)))
    offered = fits[np.argsort(-dense)[:most]]
    weights = weights * (1 + LONGER * lengths / capacity)
    lots: list[tuple[int, int]] = []
    for i in offered.tolist():
        left, k = min(int(counts[i]), capacity // int(lengths[i])), 1
        while left > 0:
            lots.append((i, min(k, left)))
            left, k = left - k, 2 * k
    best, taken = np.zeros(capacity + 1), np.zeros((len(lots), capacity + 1), dtype=bool)
    for row, (i, k) in zip(taken, lots, strict=True):
        size = k * int(lengths[i])
        gain = best[:-size] + k * weights[i]
        np.greater(gain, best[size:], out=row[size:])
        np.maximum(gain, best[size:], out=best[size:])
    found: dict[int, int] = {}
    room = capacity
    for at in range(len(lots) - 1, -1, -1):
        if taken[at, room]:
            i, k = lots[at]
            found[i] = found.get(i, 0) + k
            room -= k * int(lengths[i])
    return found


def solve(lengths: np.ndarray, counts: np.ndarray, capacity: int) -> tuple[list[tuple[dict[int, int], float]], np.ndarray]:
    """Fractional configurations by multiplicative weights that together cover every length, and the mean weights (a priced configuration weighs 1).

    Pricing goes on until the least covered length is covered COVERS times, however many
    lengths there are; the solution is then scaled down to cover it once.
    """
    covered, ties = np.zeros(len(lengths)), np.random.default_rng(0)
    found: list[tuple[dict[int, int], float]] = []
    mean = np.zeros(len(lengths))
    while covered.min(initial=COVERS) < COVERS:
        weights = np.exp(-RATE * (covered - covered.min())) * lengths
        config = price(lengths, counts, weights, capacity, ties)
        mean += weights / sum(k * weights[i] for i, k in config.items())
        times = STEP * min(counts[i] / k for i, k in config.items())
        for i, k in config.items():
            covered[i] += times * k / counts[i]
        found.append((config, times))
    scale = covered.min(initial=np.inf)
    return [(config, times / scale) for config, times in found], mean / max(1, len(found))


def rounded(lengths: np.ndarray, counts: np.ndarray, capacity: int) -> list[tuple[dict[int, int], int]]:
    """Whole uses of configurations that hold every piece once.

    The whole parts of a solution are used as they are and the program is solved again for
    what is left, until the whole parts hold less than a quarter of it.  Then the fractions are rounded
    up where all their pieces are left; the others are trimmed to their longest piece and
    priced again with what is left, the longest first.
    """
    out, left, ties = [], counts.copy(), np.random.default_rng(1)

    def use(config: dict[int, int], times: int) -> int:
        if times:
            for i, k in config.items():
                left[i] -= times * k
            out.append((config, times))
        return times

    def uses(config: dict[int, int]) -> int:
        return min(int(left[i]) // k for i, k in config.items())

    weights = np.zeros(len(lengths))
    while left.any():
        live = np.flatnonzero(left)
        found, mean = solve(lengths[live], left[live], capacity)
        weights[live] = mean
        found = [({int(live[i]): k for i, k in config.items()}, times) for config, times in found]
        found.sort(key=lambda x: -max(x[0]))
        before = left.sum()
        for config, times in found:
            if full(config, lengths, capacity):
                use(config, min(int(times), uses(config)))
        if before - left.sum() < before / 4:
            break
    if left.any():
        for config, _ in found:
            if full(config, lengths, capacity):
                use(config, min(1, uses(config)))
    while left.any():
        top = int(np.flatnonzero(left)[-1])
        config, room, spare = {top: 1}, capacity - int(lengths[top]), left.copy()
        spare[top] -= 1
        if ((lengths <= room) & (spare > 0)).any():
            for i, k in price(lengths, spare, weights, room, ties, LAST_OFFERED).items():
                config[i] = config.get(i, 0) + k
        use(config, uses(config))
    return out


def full(config: dict[int, int], lengths: np.ndarray, capacity: int) -> bool:
    return sum(k * int(lengths[i]) for i, k in config.items()) == capacity


def plan(histogram: dict[int, int], capacity: int = CAPACITY) -> list[tuple[dict[int, int], int]]:
    """Configurations (length to number) and how often each is used; together they hold the histogram exactly."""
    used: list[tuple[dict[int, int], int]] = []
    if histogram.get(capacity):
        used.append(({capacity: 1}, histogram[capacity]))
    lengths = np.array(sorted(x for x in histogram if x < capacity and histogram[x]), dtype=np.int64)
    counts = np.array([histogram[int(x)] for x in lengths], dtype=np.int64)
    used += [({int(lengths[i]): k for i, k in config.items()}, n) for config, n in rounded(lengths, counts, capacity)]
    return used


def places(used: list[tuple[dict[int, int], int]]) -> dict[int, tuple[np.ndarray, ...]]:
    """By length, sorted runs of ranks: first rank, first sequence, pieces of this length in a sequence, their first offset."""
    runs: dict[int, list[tuple[int, int, int, int]]] = {}
    given: dict[int, int] = {}
    first = 0
    for config, times in used:
        offset = 0
        for length, k in sorted(config.items(), reverse=True):
            runs.setdefault(length, []).append((given.get(length, 0), first, k, offset))
            given[length] = given.get(length, 0) + times * k
            offset += k * length
        first += times
    return {length: tuple(np.array(x, dtype=np.int64) for x in zip(*rows, strict=True)) for length, rows in runs.items()}


def pack(items: DataFrame, keys: list[str], capacity: int = CAPACITY) -> DataFrame:
    """Give every row of ``items`` (keys and a ``length`` of 1 to ``capacity``) a sequence_id and an offset."""
    histogram = {int(r[0]): int(r[1]) for r in items.groupBy("length").count().collect()}
    runs = items.sparkSession.sparkContext.broadcast(places(plan(histogram, capacity)))
    ranked = gapless_rank(items, "length", keys)

    @F.pandas_udf("struct<sequence_id:bigint,offset:bigint>")
    def place(length: pd.Series, rank: pd.Series) -> pd.DataFrame:
        seq, off = np.zeros(len(length), np.int64), np.zeros(len(length), np.int64)
        sizes, ranks = length.to_numpy(), rank.to_numpy()
        for size in np.unique(sizes):
            rows = np.flatnonzero(sizes == size)
            start, first, k, offset = runs.value[int(size)]
            run = np.searchsorted(start, ranks[rows], "right") - 1
            inside = ranks[rows] - start[run]
            seq[rows] = first[run] + inside // k[run]
            off[rows] = offset[run] + inside % k[run] * size
        return pd.DataFrame({"sequence_id": seq, "offset": off})

    return ranked.withColumn("__p", place("length", "rank")).select(*keys, "length", "__p.sequence_id", "__p.offset")


def pack_documents(docs: DataFrame, path: str, capacity: int = CAPACITY) -> DataFrame:
    """Tokenise, cut and pack documents; a row for each piece."""
    cut = docs.select("doc_id", F.explode(pieces(whole_text(), path, capacity)).alias("p")).select("doc_id", "p.*")
    packed = pack(stored(cut), ["doc_id", "piece", "start", "ids_crc32"], capacity)
    return packed.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


def op3_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset of every piece of every document."""
    return pack_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))
