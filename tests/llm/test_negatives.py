"""Hard-negative mining against a plain program with Python's integers."""

from __future__ import annotations

import math
import random

import numpy as np

from meshwright.llm import negatives
from tests.llm.test_brute_force import table

SCHEMA = "vec_id long, embedding array<float>, label int"
LONG = 2**63 - 1


def plain(rows):
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score), every pair scored in full."""
    good = []
    for key, vector, label in rows:
        if key is None or label is None or vector is None or any(x is None or not math.isfinite(x) for x in vector):
            continue
        good.append((key, [math.floor(256 * float(np.float32(x))) for x in vector], (label + 1) % 10 if key % 7 == 0 else label))
    cut = lambda x: max(-LONG - 1, min(LONG, x))
    out = []
    for key, a, label in {(k, tuple(v), n) for k, v, n in good if k % 100 == 0}:
        scored = [(-sum(x * y for x, y in zip(a, v, strict=False)), k, n) for k, v, n in good if k != key]
        for ps, positive, _ in sorted(x for x in scored if x[2] == label)[:5]:
            fit = [x for x in scored if x[2] != label and 30 * -ps <= 100 * -x[0] <= 90 * -ps]
            out += [(key, positive, i, k, cut(-ps), cut(-s)) for i, (s, k, _) in enumerate(sorted(fit)[:10], 1)]
    return sorted(out)


def run(spark, folder, rows):
    table(spark, folder, "embeddings", rows, SCHEMA)
    return sorted(tuple(r) for r in negatives.op13_hard_negatives(spark, str(folder)).collect())


def some(rng, n, size, span=1.0):
    return [(i, [rng.gauss(0.2, 1) * span for _ in range(size)], rng.randrange(4)) for i in range(n)]


def test_against_plain_program(spark, tmp_path):
    rng = random.Random(2)
    rows = some(rng, 700, 12)
    rows += [(701, None, 1), (702, [1.0] * 12, None), (703, [None] + [1.0] * 11, 1), (704, [float("nan")] * 12, 1), (705, [float("inf")] * 12, 2), (None, [1.0] * 12, 2)]
    rows += [(706, [], 1), (707, [0.5, 2.0], 2), (800, [0.0] * 12, 3), (900, [0.3] * 15, 2), (1000, [-1.0] * 12, 1)]
    got = run(spark, tmp_path, rows)
    assert got == plain(rows) and len(got) > 200


def test_one_vector_repeated_and_ties(spark, tmp_path):
    rng = random.Random(3)
    rows = [(i, [0.5, 0.25, -0.125], 1 + i % 2) for i in range(1, 600)] + [(0, [0.5, 0.25, 0.0], 1)] + [(700 + i, [rng.random() for _ in range(3)], i % 5) for i in range(300)]
    rows += [(303, [0.4, 0.2, 0.1], 2)] * 4 + [(100, [0.5, 0.25, -0.125], 1)]
    assert run(spark, tmp_path, rows) == plain(rows)


def test_large_components_are_exact(spark, tmp_path):
    rng = random.Random(4)
    rows = some(rng, 150, 6) + [(200 + i, [rng.gauss(0.5, 1) * 10 ** rng.choice((0, 3, 5, 8, 12, 17)) for _ in range(6)], rng.randrange(3)) for i in range(200)]
    rows += [(600, [1e30, 1.0, 0.0, 0.0, 0.0, 0.0], 1), (601, [9e29, 5.0, 0.0, 0.0, 0.0, 0.0], 1), (602, [8e29, 5.0, 0.0, 0.0, 0.0, 0.0], 2), (603, [8e29, 6.0, 0.0, 0.0, 0.0, 0.0], 2), (604, [-1e38, 0.0, 0.0, 0.0, 0.0, 0.0], 0)]
    got = run(spark, tmp_path, rows)
    assert got == plain(rows) and any(r[5] == LONG for r in got)


def test_passes_and_small_blocks(spark, monkeypatch):
    rng = random.Random(6)
    rows = some(rng, 120, 5)
    df = spark.createDataFrame([(k, n, [float(x) for x in v]) for k, v, n in rows], "vec_id long, label long, vector array<double>")
    once = sorted(tuple(r) for r in negatives.mine(df, df.where("vec_id % 10 = 0")).collect())
    monkeypatch.setattr(negatives, "PASS", 4)
    assert sorted(tuple(r) for r in negatives.mine(df, df.where("vec_id % 10 = 0")).collect()) == once and once


def test_empty_tables_and_no_partner(spark, tmp_path):
    assert run(spark, tmp_path / "a", []) == []
    assert run(spark, tmp_path / "b", [(1, [1.0], 1), (2, [1.0], 2)]) == []
    assert run(spark, tmp_path / "c", [(100, [1.0], 1)]) == []
    assert run(spark, tmp_path / "d", [(100, [1.0], 1), (2, [-1.0], 1), (3, [1.0], 2)]) == []


def test_planes_give_the_values_back():
    rng = random.Random(8)
    for span in (1, 300, 2**40, 2**70):
        values = [rng.randint(-span, span) for _ in range(19)]
        bits = negatives.bits_for(values)
        planes = np.frombuffer(negatives.planes_of(values, bits), np.uint8).reshape(bits, -1)
        rows = np.unpackbits(planes, axis=1, count=19).astype(object)
        back = sum((-1 if k == 0 else 1) * (1 << (bits - 1 - k)) * rows[k] for k in range(bits))
        assert back.tolist() == values


def test_dropped_pairs_could_not_qualify():
    rng = np.random.default_rng(1)
    v, a = rng.integers(-500, 500, (400, 16)), rng.integers(-500, 500, (30, 16))
    bits = negatives.bits_for([int(x) for x in v.ravel()])
    planes = np.stack([np.frombuffer(negatives.planes_of(row.tolist(), bits), np.uint8).reshape(bits, -1) for row in v])
    anchors = negatives.Anchors(np.arange(30), np.zeros(30, np.int64), a)
    score = v @ a.T
    low, high = np.quantile(score, 0.7, axis=0), np.quantile(score, 0.9, axis=0)
    r, q, s = negatives.narrowed(planes, 16, anchors, np.ones(score.shape, bool), low, high)
    assert set(zip(r.tolist(), q.tolist(), strict=True)) == set(zip(*(x.tolist() for x in np.nonzero((score >= low) & (score <= high))), strict=True))
    assert (s == score[r, q]).all()
    r, q, s = negatives.narrowed(planes, 16, anchors, np.ones(score.shape, bool), np.full(30, -np.inf), np.full(30, np.inf), 5)
    for anchor in range(30):
        assert sorted(s[q == anchor])[-5:] == sorted(score[:, anchor])[-5:]
