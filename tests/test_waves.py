"""Waves of routes and spacing of points against plain, strictly ordered programs."""

from __future__ import annotations

import math
import random

from meshwright.functions import geo
from meshwright.operators import waves


def plain_waves(claims):
    wave = {}
    for r in sorted(claims):
        wave[r] = 1 + max((wave[q] for q in wave if claims[q] & claims[r]), default=-1)
    return wave


def test_waves_against_all_meetings(spark):
    rng = random.Random(1)
    claims = {r: {rng.randrange(150) for _ in range(rng.randint(1, 6))} for r in range(80)}
    rows = spark.createDataFrame([(r, c) for r, own in claims.items() for c in own] * 2, "route long, cell long")
    assert {x.route: x.wave for x in waves.waves(rows).collect()} == plain_waves(claims)


def test_waves_of_one_common_cell_and_of_none(spark):
    same = spark.createDataFrame([(r, 7) for r in range(6)], "route long, cell long")
    assert {x.route: x.wave for x in waves.waves(same).collect()} == {r: r for r in range(6)}
    apart = spark.createDataFrame([(r, r) for r in range(6)], "route long, cell long")
    assert {x.wave for x in waves.waves(apart).collect()} == {0}
    assert waves.waves(same.limit(0)).count() == 0


def chord(a, b):
    p, q = ((math.cos(math.radians(x[0])) * math.cos(math.radians(x[1])), math.cos(math.radians(x[0])) * math.sin(math.radians(x[1])), math.sin(math.radians(x[0]))) for x in (a, b))
    return geo.EARTH_RADIUS_M * math.dist(p, q)


def test_first_fit_against_one_after_the_other(spark):
    rng = random.Random(3)
    points = [(i, 40 + rng.random() / 10, 44 + rng.random() / 10, rng.random() < 0.1) for i in range(120)]
    standing = [(1000 + i, 40 + rng.random() / 10, 44 + rng.random() / 10) for i in range(4)]
    kept, want = [(s[0], (s[1], s[2])) for s in standing], {}
    for i, lat, lon, fixed in points:
        blocked = not fixed and any(chord(at, (lat, lon)) <= 1200 for _, at in kept)
        want[i] = not blocked
        if not blocked:
            kept.append((i, (lat, lon)))
    df = spark.createDataFrame([(i, i, lat, lon, f) for i, lat, lon, f in points], "id long, ord long, lat double, lon double, fixed boolean")
    got = waves.first_fit(df, 1200.0, spark.createDataFrame(standing, "id long, lat double, lon double")).collect()
    assert {r.id: r.kept for r in got} == want and len(got) == 120
    place = {i: (lat, lon) for i, lat, lon, _ in points} | {i: (lat, lon) for i, lat, lon in standing}
    for r in got:
        assert (r.by is None) == r.kept
        if not r.kept:
            assert chord(place[r.by], place[r.id]) <= 1200 and (r.by >= 1000 or (want[r.by] and r.by < r.id))
