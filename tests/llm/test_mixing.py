"""Mixing sources against a plain program: targets by repeated resharing, cuts word by word."""

from __future__ import annotations

import collections
import hashlib
import random
import re

import pytest
from pyspark.sql import functions as F

from meshwright.llm import mixing
from tests.llm.test_brute_force import table

SCHEMA = "doc_id long, text string, source string"


def plain_targets(sizes):
    """Targets of sources in their order, by resharing until none is above its bound."""
    names = sorted((s for s in sizes if s is not None), key=lambda s: [ord(c) for c in s]) + ([None] if None in sizes else [])
    weight = {s: i % 3 + 1 for i, s in enumerate(names)}
    held, left = {}, float(sum(sizes.values()))
    open_ = list(names)
    while open_:
        whole = sum(weight[s] for s in open_)
        share = {s: left * weight[s] / whole for s in open_}
        above = [s for s in open_ if share[s] > 3 * sizes[s]]
        if not above:
            return held | share
        for s in above:
            held[s] = 3.0 * sizes[s]
            left -= held[s]
            open_.remove(s)
    return held


def key_of(doc_id):
    return int(hashlib.sha256(f"mix:{'' if doc_id is None else doc_id}".encode()).hexdigest()[:15], 16)


def plain_mix(rows):
    """doc_id, size, source_size, target, taken of every row; the mix is laid out word by word."""
    sized = [(d, len(re.findall(r"[^\x20\x09-\x0D]+", t or "")), s) for d, t, s in rows]
    sizes = collections.Counter()
    for _, n, s in sized:
        sizes[s] += n
    target = plain_targets(sizes)
    out = []
    for s in sizes:
        own = sorted((x for x in sized if x[2] == s), key=lambda x: (key_of(x[0]), x[0] is not None, x[0] or 0, x[1]))
        words = [i for i, x in enumerate(own) for _ in range(x[1])]
        cut = int(target[s] + 0.5)
        taken = collections.Counter(words[k % len(words)] for k in range(cut)) if words else {}
        out += [(x[0], x[1], sizes[s], target[s], taken.get(i, 0)) for i, x in enumerate(own)]
    return out


def run(spark, tmp_path, rows):
    table(spark, tmp_path, "documents", rows, SCHEMA)
    got = mixing.op11_source_mix(spark, str(tmp_path)).collect()
    return [(r["doc_id"], r["size"], r["source_size"], r["target"], r["taken"]) for r in got]


def same(got, want):
    order = lambda x: (x[0] is not None, x[0] or 0, x[1], x[2], x[4])
    got, want = sorted(got, key=order), sorted(want, key=order)
    assert [(x[0], x[1], x[2], x[4]) for x in got] == [(x[0], x[1], x[2], x[4]) for x in want]
    assert [x[3] for x in got] == pytest.approx([x[3] for x in want], rel=1e-12)


def test_mix_against_plain_program(spark, tmp_path):
    rng = random.Random(5)
    rows = [(i, " ".join("w" * rng.randint(1, 4) for _ in range(rng.choice((0, 1, 5, 40)))), rng.choice(("b", "b", "b", "a", "é", "z", "", "\U0001f600", None))) for i in range(300)]
    rows += [(1000, "one two\tthree\x0bfour five\x85six", "a"), (1001, None, "a"), (1002, "", "only empty"), (1003, " \n\t ", None)]
    rows += [(None, "x y", "b")] * 3 + [(7, "same row", "b")] * 4
    same(run(spark, tmp_path, rows), plain_mix(rows))


def test_budgets_are_met_and_reruns_agree(spark, tmp_path):
    rows = [(i, "w " * (i % 9), f"s{i % 7 if i % 3 else 0}") for i in range(500)] + [(900, "w " * 20_000, "s1")]
    got = run(spark, tmp_path, rows)
    taken, target = collections.Counter(), {}
    of = {d: s for d, _, s in rows}
    for d, size, whole, goal, t in got:
        assert t <= 3 * size and goal <= 3 * whole
        taken[of[d]] += t
        target[of[d]] = goal
    for s in target:
        assert abs(taken[s] - target[s]) <= 0.5
    assert sum(target.values()) == pytest.approx(sum(x[1] for x in got))
    assert sorted(got) == sorted((r["doc_id"], r["size"], r["source_size"], r["target"], r["taken"]) for r in mixing.op11_source_mix(spark, str(tmp_path)).collect())


def test_many_copies_of_one_row(spark, tmp_path):
    rows = [(5, "a b c", "x")] * 9000 + [(6, "d", "x"), (7, "e f", "y")]
    same(run(spark, tmp_path, rows), plain_mix(rows))


def test_empty_and_wordless_tables(spark, tmp_path):
    assert run(spark, tmp_path / "none", []) == []
    assert sorted(run(spark, tmp_path / "blank", [(1, "", "a"), (2, None, None)])) == [(1, 0, 0, 0.0, 0), (2, 0, 0, 0.0, 0)]


def test_one_source_and_bounded_share(spark):
    rows = spark.createDataFrame([(i, "a", 10) for i in range(50)], "doc_id long, source string, size long")
    assert mixing.mix(rows).agg(F.sum("taken")).collect()[0][0] == 500
    assert mixing.mix(rows, share=9.0).agg(F.sum("taken"), F.min("taken"), F.max("taken")).collect()[0][:] == (1500, 30, 30)
    assert mixing.mix(rows, share=0.5).agg(F.sum("taken")).collect()[0][0] == 250


def test_running_sums(spark):
    rows = spark.range(0, 1000, 1, 7).select(((F.col("id") * 7919) % 1000).alias("k"), (F.col("id") % 5).alias("v"))
    got = mixing.running_sums(rows, [F.col("k").desc()], {"before": "v"}).orderBy(F.desc("k")).collect()
    total = 0
    for r in got:
        assert r["before"] == total
        total += r["v"]
