"""Importance resampling against a plain program that builds every feature as a string."""

from __future__ import annotations

import collections
import hashlib
import math
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest

from meshwright.llm import resampling
from tests.llm.test_brute_force import table

WORD = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words_of(text):
    return WORD.findall(bytes(c + 32 if 65 <= c <= 90 else c for c in (text or "").encode()))


def features(words, most=2):
    return [zlib.crc32(b" ".join(words[i : i + n])) % 10_000 for n in range(1, most + 1) for i in range(len(words) - n + 1)]


def plain(docs, target):
    corpus, aim = collections.Counter(), collections.Counter()
    for _, t in docs:
        corpus.update(features(words_of(t)))
    for t in target:
        aim.update(features(words_of(t)))
    s_all, t_all = sum(corpus.values()), sum(aim.values())
    gain = lambda b: math.floor(1000 * math.log((aim[b] + 1) * (s_all + 10_000) / ((corpus[b] + 1) * (t_all + 10_000))))
    out = []
    for d, t in docs:
        f = features(words_of(t))
        weight = sum(map(gain, f)) // len(f) if f else 0
        h = int(hashlib.sha256(f"7:{'' if d is None else d}".encode()).hexdigest()[:8], 16)
        out.append([d, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None, len(words_of(t))])
    may = sorted((x for x in out if x[5] >= 20), key=lambda x: (-x[3], x[0] is None, x[0] or 0, x[1], x[2]))
    for rank, x in enumerate(may[: 25 * len(may) // 100], 1):
        x[4] = rank
    return [tuple(x[:5]) for x in out]


def text_of(rng, n):
    return "".join(rng.choice(("Alpha", "beta", "Ünder", "x1", "中文", "c" * 70, "D")) + rng.choice((" ", ", ", "-", "\n", "  ", "[", "\x7f")) for _ in range(n))


def run(spark, folder, docs, target):
    table(spark, folder, "documents", docs, "doc_id long, text string")
    table(spark, folder, "benchmark", list(enumerate(target)), "item_id long, text string")
    got = resampling.op12_resample(spark, str(folder))
    assert [(f.name, f.dataType.simpleString()) for f in got.schema] == [(c, "bigint") for c in ("doc_id", "n_features", "weight", "score", "rank")]
    return [tuple(r) for r in got.collect()]


def order(rows):
    return sorted(rows, key=lambda x: tuple((y is None, y or 0) for y in x))


def test_against_plain_program(spark, tmp_path):
    rng = random.Random(11)
    docs = [(i, text_of(rng, rng.choice((0, 1, 2, 19, 20, 21, 60)))) for i in range(200)]
    docs += [(500, None), (501, ""), (502, " .,;"), (503, text_of(rng, 30_000)), (504, "q" * 300_000), (None, text_of(rng, 40))]
    docs += [docs[3]] * 3 + [(7, text_of(rng, 25))] * 5
    target = [text_of(rng, 50) for _ in range(20)] + [None, "", "beta beta beta"]
    assert order(run(spark, tmp_path, docs, target)) == order(plain(docs, target))


def test_empty_tables(spark, tmp_path):
    assert run(spark, tmp_path / "a", [], ["x y"]) == []
    docs = [(i, "one two three " * 10) for i in range(8)]
    got = run(spark, tmp_path / "b", docs, [])
    assert order(got) == order(plain(docs, [])) and sum(r[4] is not None for r in got) == 2


def test_all_rows_alike(spark, tmp_path):
    docs = [(3, "same words " * 15)] * 5000
    got = run(spark, tmp_path, docs, ["same"])
    assert sorted(r[4] for r in got if r[4] is not None) == list(range(1, 1251)) and len(got) == 5000


@pytest.mark.parametrize("length", [0, 1, 2, 63, 64, 65, 1000, 70_001])
def test_crc_of_concatenation(length):
    rng = random.Random(length)
    first, second = rng.randbytes(9), rng.randbytes(length)
    got = resampling.shifted(np.array([zlib.crc32(first)], dtype=np.uint32), np.array([length]))[0] ^ np.uint32(zlib.crc32(second))
    assert got == zlib.crc32(first + second)


@pytest.mark.parametrize("most", [1, 2, 3, 5])
def test_hashed_runs(most):
    rng = random.Random(most)
    texts = [text_of(rng, n) for n in (0, 3, 1, 0, 40, 2)] + ["", "Z", "no-break space"]
    data = np.frombuffer("".join(texts).encode(), np.uint8)
    text, bucket, words = resampling.hashed(data, np.cumsum([len(t.encode()) for t in texts]), most)
    assert sorted(zip(text.tolist(), bucket.tolist(), strict=True)) == sorted((i, b) for i, t in enumerate(texts) for b in features(words_of(t), most))
    assert words.tolist() == [len(words_of(t)) for t in texts]


def test_slices_hold_every_byte(monkeypatch):
    monkeypatch.setattr(resampling, "SLICE", 50)
    texts = ["a" * 10, None, "", "b" * 200, "é" * 20, "c"] * 3
    column = pa.array(["skip", *texts, "skip"])[1:-1]
    got = []
    for first, last, data, ends in resampling.slices(column):
        begin = 0
        assert len(ends) == last - first
        for end in ends:
            got.append(data[begin:end].tobytes().decode())
            begin = end
    assert got == [t or "" for t in texts]
