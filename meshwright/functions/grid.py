"""The hexagonal grid as expressions.

Cells are pointy-top hexagons in a local equirectangular plane about the origin
(``LAT0`` sets the scale of longitudes).  An id is a BIGINT: resolution, then the two
axial coordinates with an offset.  Children of a cell are the finer cells whose centre
lies in it, so that every resolution is partitioned exactly.  Ids are this engine's
own; they are not those of any other hexagon library.
"""

from __future__ import annotations

import json
import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from meshwright.functions.geo import METRES_PER_DEGREE, let

LAT0 = 40.0
#: Average hexagon edge in metres by resolution 0 to 15 (published for a common global grid).
EDGE_M = [1281256.011, 483056.8391, 182512.9565, 68979.22179, 26071.75968, 9854.090990, 3724.532667, 1406.475763, 531.414010, 200.786148, 75.863783, 28.663897, 10.830188, 4.092010, 1.546100, 0.584169]
OFFSET = 1 << 27
ROOT3 = math.sqrt(3.0)
_COS0 = math.cos(math.radians(LAT0))


def edge_m(resolution: int) -> float:
    """Average edge of a cell."""
    return EDGE_M[resolution]


def edge_of(resolution: Column) -> Column:
    """Average edge by a column of resolutions."""
    return F.get(F.from_json(F.lit(json.dumps(EDGE_M)), "array<double>"), resolution.cast("int"))


def ring_step_m(resolution: int) -> float:
    """Distance of neighbouring centres."""
    return EDGE_M[resolution] * ROOT3


def pack_id(resolution: Column, q: Column, r: Column) -> Column:
    return F.shiftleft(resolution.cast("long"), 56) + F.shiftleft(q.cast("long") + F.lit(OFFSET), 28) + (r.cast("long") + F.lit(OFFSET))


def resolution_of(cell: Column) -> Column:
    return F.shiftright(cell, 56).cast("int")


def q_of(cell: Column) -> Column:
    return F.shiftright(cell, 28).bitwiseAND(F.lit((1 << 28) - 1)) - F.lit(OFFSET)


def r_of(cell: Column) -> Column:
    return cell.bitwiseAND(F.lit((1 << 28) - 1)) - F.lit(OFFSET)


def is_valid(cell: Column) -> Column:
    """Whether a number is a cell id."""
    return F.coalesce((resolution_of(cell) >= 0) & (resolution_of(cell) < len(EDGE_M)) & (cell > 0), F.lit(False))


def _rounded_id(resolution: Column, fq: Column, fr: Column) -> Column:
    """Id of the hexagon that holds fractional axial coordinates (cube rounding, halves up)."""
    half = F.lit(0.5)

    def near(v: Column) -> Column:
        q, r, s = F.floor(v["fq"] + half), F.floor(v["fr"] + half), F.floor(-v["fq"] - v["fr"] + half)
        return F.struct(q.alias("q"), r.alias("r"), s.alias("s"), F.abs(q - v["fq"]).alias("dq"), F.abs(r - v["fr"]).alias("dr"), F.abs(s + v["fq"] + v["fr"]).alias("ds"))

    def settle(v: Column) -> Column:
        off = (v["dq"] > v["dr"]) & (v["dq"] > v["ds"])
        return pack_id(resolution, F.when(off, -v["r"] - v["s"]).otherwise(v["q"]), F.when(off, v["r"]).when(v["dr"] > v["ds"], -v["q"] - v["s"]).otherwise(v["r"]))

    return F.get(F.transform(F.transform(F.array(F.struct(fq.alias("fq"), fr.alias("fr"))), near), settle), F.lit(0))


def cell_of(lat: Column, lon: Column, resolution: int | Column) -> Column:
    """The cell that holds a point."""
    edge = F.lit(EDGE_M[resolution]) if isinstance(resolution, int) else edge_of(resolution)
    x, y = lon * F.lit(METRES_PER_DEGREE * _COS0), lat * F.lit(METRES_PER_DEGREE)
    level = F.lit(resolution) if isinstance(resolution, int) else resolution
    return _rounded_id(level, (F.lit(ROOT3 / 3) * x - y / F.lit(3.0)) / edge, y * F.lit(2.0) / F.lit(3.0) / edge)


def lat_of(cell: Column) -> Column:
    """Latitude of a cell's centre."""
    return r_of(cell) * F.lit(1.5) * edge_of(resolution_of(cell)) / F.lit(METRES_PER_DEGREE)


def lon_of(cell: Column) -> Column:
    """Longitude of a cell's centre."""
    return (q_of(cell) * F.lit(ROOT3) + r_of(cell) * F.lit(ROOT3 / 2)) * edge_of(resolution_of(cell)) / F.lit(METRES_PER_DEGREE * _COS0)


def grid_distance(a: Column, b: Column) -> Column:
    """Steps between two cells of one resolution."""
    dq, dr = q_of(a) - q_of(b), r_of(a) - r_of(b)
    return F.greatest(F.abs(dq), F.abs(dr), F.abs(dq + dr))


def offsets(k: int, ring: bool = False) -> list[tuple[int, int]]:
    """Axial offsets of the disk of radius k, or of its outer ring only."""
    every = [(q, r) for q in range(-k, k + 1) for r in range(max(-k, -q - k), min(k, -q + k) + 1)]
    return [(q, r) for q, r in every if not ring or max(abs(q), abs(r), abs(q + r)) == k]


def shifted(cell: Column, dq: Column, dr: Column) -> Column:
    return cell + F.shiftleft(dq.cast("long"), 28) + dr.cast("long")


def disk(cell: Column, k: int | Column) -> Column:
    """Array of the cells within k steps."""
    if isinstance(k, int):
        return F.array(*[shifted(cell, F.lit(q), F.lit(r)) for q, r in offsets(k)]) if k <= 3 else F.transform(F.array(*[F.lit((q << 28) + r) for q, r in offsets(k)]), lambda d: cell + d)
    n = k.cast("long")
    rows = lambda q: F.transform(F.sequence(F.greatest(-n, -q - n), F.least(n, -q + n)), lambda r: shifted(cell, q, r))
    return F.flatten(F.transform(F.sequence(-n, n), rows))


def ring(cell: Column, k: int) -> Column:
    """Array of the cells exactly k steps away."""
    return F.array(*[shifted(cell, F.lit(q), F.lit(r)) for q, r in offsets(k, ring=True)])


def path_cells(a: Column, b: Column) -> Column:
    """Cells of the straight line between two cells of one resolution, ends included; null for mixed resolutions."""

    def line(v: Column) -> Column:
        def at(i: Column) -> Column:
            t = F.when(v["n"] == 0, F.lit(0.0)).otherwise(i.cast("double") / F.when(v["n"] == 0, F.lit(1)).otherwise(v["n"]))
            return _rounded_id(v["level"], v["q"] + v["dq"] * t + F.lit(1e-6), v["r"] + v["dr"] * t + F.lit(2e-6))

        return F.transform(F.sequence(F.lit(0).cast("long"), v["n"]), at)

    values = {"n": grid_distance(a, b), "level": resolution_of(a), "q": q_of(a), "r": r_of(a), "dq": q_of(b) - q_of(a), "dr": r_of(b) - r_of(a)}
    return F.when(resolution_of(a) == resolution_of(b), let(values, line))


def parent(cell: Column, resolution: int) -> Column:
    """The coarser cell that holds a cell's centre."""
    return cell_of(lat_of(cell), lon_of(cell), resolution)


def children(cell: Column, coarse: int, fine: int) -> Column:
    """The finer cells whose centre lies in a cell of resolution ``coarse``; the cell itself where none is finer."""
    if fine <= coarse:
        return F.array(cell)
    reach = math.ceil(EDGE_M[coarse] / (EDGE_M[fine] * 1.5)) + 1
    middle = cell_of(lat_of(cell), lon_of(cell), fine)
    return F.filter(disk(middle, reach), lambda c: parent(c, coarse) == cell)


def boundary(cell: Column) -> Column:
    """The six corners of a cell, array<struct<lon,lat>>."""
    edge = edge_of(resolution_of(cell))
    corner = lambda i: F.struct((lon_of(cell) + edge * F.lit(math.cos(math.radians(60 * i - 30))) / F.lit(METRES_PER_DEGREE * _COS0)).alias("lon"), (lat_of(cell) + edge * F.lit(math.sin(math.radians(60 * i - 30))) / F.lit(METRES_PER_DEGREE)).alias("lat"))
    return F.array(*[corner(i) for i in range(6)])


def radius_to_ring(radius_m: Column, resolution: int, least: int = 0) -> Column:
    """Rings of a radius, rounded half to even."""
    return F.greatest(F.bround(radius_m / F.lit(EDGE_M[resolution])), F.lit(float(least))).cast("int")


def rings_covering(radius_m: float, resolution: int) -> int:
    """Rings that surely hold a radius."""
    return math.ceil(radius_m / ring_step_m(resolution)) + 1
