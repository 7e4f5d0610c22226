"""Geometry as Catalyst expressions: distances, projections, polygons."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from meshwright.functions import exact

#: Radius of the sphere, and metres of a degree in the local projection.
EARTH_RADIUS_M = 6_371_000.0
METRES_PER_DEGREE = 111_320.0
#: WGS84 semi-major axis and flattening.
WGS84_A, WGS84_F = 6_378_137.0, 1 / 298.257223563


def _d(x: float) -> Column:
    return F.lit(float(x))


def let(values: dict[str, Column], body) -> Column:
    """``body`` of a struct of values that are each computed once, however often the body uses them."""
    return F.get(F.transform(F.array(F.struct(*[v.alias(k) for k, v in values.items()])), body), F.lit(0))


def haversine_m(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Distance on the sphere in metres."""
    dlat, dlon = F.radians(lat2 - lat1) / _d(2), F.radians(lon2 - lon1) / _d(2)
    h = F.sin(dlat) * F.sin(dlat) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.sin(dlon) * F.sin(dlon)
    return _d(2 * EARTH_RADIUS_M) * F.asin(F.sqrt(F.least(_d(1), h)))


def geodesic_m(lat1: Column, lon1: Column, lat2: Column, lon2: Column, rounds: int = 6) -> Column:
    """Distance on the WGS84 ellipsoid in metres: the inverse problem, a fixed number of rounds.

    Links are far shorter than half the globe, so that a few rounds converge; equal
    points give 0.  The rounds fold over a struct, and every intermediate value is bound
    before it is used again, so that a row costs a few hundred operations.
    """
    f, a = WGS84_F, WGS84_A
    b = a * (1 - f)
    u1, u2 = F.atan(_d(1 - f) * F.tan(F.radians(lat1))), F.atan(_d(1 - f) * F.tan(F.radians(lat2)))
    base = {"s1": F.sin(u1), "c1": F.cos(u1), "s2": F.sin(u2), "c2": F.cos(u2), "l": F.radians(lon2 - lon1)}
    unless = lambda zero, value, by: F.when(zero == 0, _d(0)).otherwise(value / F.when(by == 0, _d(1)).otherwise(by))

    def at(p: Column, lam: Column, then) -> Column:
        """``then`` of the struct of sigma's sine and cosine, alpha's sine and squared cosine, and the cosine of the middle."""

        def angle(t: Column) -> Column:
            x, y = p["c2"] * t["sin"], p["c1"] * p["s2"] - p["s1"] * p["c2"] * t["cos"]
            return let({"sin_l": t["sin"], "sin_s": F.sqrt(x * x + y * y), "cos_s": p["s1"] * p["s2"] + p["c1"] * p["c2"] * t["cos"]}, azimuth)

        def azimuth(t: Column) -> Column:
            return let({"sin_s": t["sin_s"], "cos_s": t["cos_s"], "sin_a": unless(t["sin_s"], p["c1"] * p["c2"] * t["sin_l"], t["sin_s"])}, middle)

        def middle(t: Column) -> Column:
            known = {k: t[k] for k in ("sin_s", "cos_s", "sin_a")}
            return let(known | {"cos2_a": _d(1) - t["sin_a"] * t["sin_a"]}, lambda v: let({k: v[k] for k in (*known, "cos2_a")} | {"cos_m": F.when(v["cos2_a"] == 0, _d(0)).otherwise(v["cos_s"] - unless(v["cos2_a"], _d(2) * p["s1"] * p["s2"], v["cos2_a"]))}, then))

        return let({"sin": F.sin(lam), "cos": F.cos(lam)}, angle)

    def solve(p: Column) -> Column:
        def nearer(t: Column) -> Column:
            c = _d(f / 16) * t["cos2_a"] * (_d(4) + _d(f) * (_d(4) - _d(3) * t["cos2_a"]))
            turn = lambda v: p["l"] + (_d(1) - v["c"]) * _d(f) * t["sin_a"] * (F.atan2(t["sin_s"], t["cos_s"]) + v["c"] * t["sin_s"] * (t["cos_m"] + v["c"] * t["cos_s"] * (_d(-1) + _d(2) * t["cos_m"] * t["cos_m"])))
            return let({"c": c}, turn)

        def length(t: Column) -> Column:
            def of(v: Column) -> Column:
                big_a = _d(1) + v["u"] / _d(16384) * (_d(4096) + v["u"] * (_d(-768) + v["u"] * (_d(320) - _d(175) * v["u"])))
                big_b = v["u"] / _d(1024) * (_d(256) + v["u"] * (_d(-128) + v["u"] * (_d(74) - _d(47) * v["u"])))
                return let({"a": big_a, "b": big_b}, arc)

            def arc(v: Column) -> Column:
                turn = v["b"] / _d(6) * t["cos_m"] * (_d(-3) + _d(4) * t["sin_s"] * t["sin_s"]) * (_d(-3) + _d(4) * t["cos_m"] * t["cos_m"])
                delta = v["b"] * t["sin_s"] * (t["cos_m"] + v["b"] / _d(4) * (t["cos_s"] * (_d(-1) + _d(2) * t["cos_m"] * t["cos_m"]) - turn))
                return _d(b) * v["a"] * (F.atan2(t["sin_s"], t["cos_s"]) - delta)

            return let({"u": t["cos2_a"] * _d((a * a - b * b) / (b * b))}, of)

        return F.aggregate(F.sequence(F.lit(1), F.lit(rounds)), p["l"], lambda lam, _: at(p, lam, nearer), lambda lam: at(p, lam, length))

    return F.when((lat1 == lat2) & (lon1 == lon2), _d(0)).otherwise(let(base, solve))


def geodesics(lat1: np.ndarray, lon1: np.ndarray, lat2: np.ndarray, lon2: np.ndarray, rounds: int = 6, by=np) -> np.ndarray:
    """``geodesic_m`` of arrays: the same rounds, a batch at a time, with the functions of ``by``."""
    f, a = WGS84_F, WGS84_A
    b = a * (1 - f)
    unless = lambda zero, value, by: np.where(zero == 0, 0.0, value / np.where(by == 0, 1.0, by))
    u1, u2 = by.arctan((1 - f) * by.tan(np.radians(lat1))), by.arctan((1 - f) * by.tan(np.radians(lat2)))
    s1, c1, s2, c2 = by.sin(u1), by.cos(u1), by.sin(u2), by.cos(u2)
    lam = wide = np.radians(lon2 - lon1)
    for i in range(rounds + 1):
        sin_l, cos_l = by.sin(lam), by.cos(lam)
        x, y = c2 * sin_l, c1 * s2 - s1 * c2 * cos_l
        sin_s, cos_s = np.sqrt(by.square(x) + by.square(y)), s1 * s2 + c1 * c2 * cos_l
        sin_a = unless(sin_s, c1 * c2 * sin_l, sin_s)
        cos2_a = 1.0 - sin_a * sin_a
        cos_m = np.where(cos2_a == 0, 0.0, cos_s - unless(cos2_a, 2.0 * s1 * s2, cos2_a))
        if i < rounds:
            c = f / 16 * cos2_a * (4.0 + f * (4.0 - 3.0 * cos2_a))
            lam = wide + (1.0 - c) * f * sin_a * (by.arctan2(sin_s, cos_s) + c * sin_s * (cos_m + c * cos_s * (-1.0 + 2.0 * cos_m * cos_m)))
    u = cos2_a * ((a * a - b * b) / (b * b))
    big_a = 1.0 + u / 16384.0 * (4096.0 + u * (-768.0 + u * (320.0 - 175.0 * u)))
    big_b = u / 1024.0 * (256.0 + u * (-128.0 + u * (74.0 - 47.0 * u)))
    turn = big_b / 6.0 * cos_m * (-3.0 + 4.0 * sin_s * sin_s) * (-3.0 + 4.0 * cos_m * cos_m)
    delta = big_b * sin_s * (cos_m + big_b / 4.0 * (cos_s * (-1.0 + 2.0 * cos_m * cos_m) - turn))
    return np.where((lat1 == lat2) & (lon1 == lon2), 0.0, b * big_a * (by.arctan2(sin_s, cos_s) - delta))


def geodesic_exact(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """``geodesic_m`` by the C library's functions, to the last bit what SQL gives."""

    @F.pandas_udf("double")
    def far(lat1: pd.Series, lon1: pd.Series, lat2: pd.Series, lon2: pd.Series) -> pd.Series:
        return pd.Series(geodesics(*[x.to_numpy(dtype="float64") for x in (lat1, lon1, lat2, lon2)], by=exact))

    return far(lat1, lon1, lat2, lon2)


def chord_exact(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """``chord_m`` by the C library's functions, to the last bit what SQL gives."""

    @F.pandas_udf("double")
    def far(lat1: pd.Series, lon1: pd.Series, lat2: pd.Series, lon2: pd.Series) -> pd.Series:
        def place(lat: pd.Series, lon: pd.Series) -> list[np.ndarray]:
            la, lo = np.radians(lat.to_numpy(dtype="float64")), np.radians(lon.to_numpy(dtype="float64"))
            return [EARTH_RADIUS_M * exact.cos(la) * exact.cos(lo), EARTH_RADIUS_M * exact.cos(la) * exact.sin(lo), EARTH_RADIUS_M * exact.sin(la)]

        x, y, z = (exact.square(one - two) for one, two in zip(place(lat1, lon1), place(lat2, lon2), strict=True))
        return pd.Series(np.sqrt(x + y + z))

    return far(lat1, lon1, lat2, lon2)


def geodesic_rows(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """``geodesic_m`` by Arrow batches, for tables of many rows: lambdas are interpreted row by row.  Null where an argument is.

    Called nondeterministic, so that a filter on it does not compute it twice.
    """

    @F.pandas_udf("double")
    def far(lat1: pd.Series, lon1: pd.Series, lat2: pd.Series, lon2: pd.Series) -> pd.Series:
        return pd.Series(geodesics(*[x.to_numpy(dtype="float64") for x in (lat1, lon1, lat2, lon2)]))

    known = lat1.isNotNull() & lon1.isNotNull() & lat2.isNotNull() & lon2.isNotNull()
    return F.when(known, far.asNondeterministic()(lat1, lon1, lat2, lon2))


def xyz(lat: Column, lon: Column) -> tuple[Column, Column, Column]:
    """A point of the sphere in metres from its centre."""
    la, lo = F.radians(lat), F.radians(lon)
    r = _d(EARTH_RADIUS_M)
    return r * F.cos(la) * F.cos(lo), r * F.cos(la) * F.sin(lo), r * F.sin(la)


def chord_m(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Straight distance through the sphere in metres."""
    (x1, y1, z1), (x2, y2, z2) = xyz(lat1, lon1), xyz(lat2, lon2)
    return F.sqrt((x1 - x2) * (x1 - x2) + (y1 - y2) * (y1 - y2) + (z1 - z2) * (z1 - z2))


def line_fraction(plat: Column, plon: Column, lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Where a point projects on a line, from 0 (its start) to 1; 0 for a line of no length."""
    k = F.cos(F.radians((lat1 + lat2) / _d(2)))
    dx, dy = (lon2 - lon1) * k, lat2 - lat1
    px, py = (plon - lon1) * k, plat - lat1
    size = dx * dx + dy * dy
    return F.when(size <= _d(1e-12), _d(0)).otherwise(F.greatest(_d(0), F.least(_d(1), (px * dx + py * dy) / F.when(size <= _d(1e-12), _d(1)).otherwise(size))))


def to_local(lat: Column, lon: Column, lat0: Column, lon0: Column) -> tuple[Column, Column]:
    """Metres east and north of an origin (equirectangular; the cosine is at least 1e-6)."""
    return (lon - lon0) * _d(METRES_PER_DEGREE) * F.greatest(F.cos(F.radians(lat0)), _d(1e-6)), (lat - lat0) * _d(METRES_PER_DEGREE)


def from_local(x: Column, y: Column, lat0: Column, lon0: Column) -> tuple[Column, Column]:
    """The inverse of ``to_local``: lat and lon."""
    return lat0 + y / _d(METRES_PER_DEGREE), lon0 + x / (_d(METRES_PER_DEGREE) * F.greatest(F.cos(F.radians(lat0)), _d(1e-6)))


def in_ring(lat: Column, lon: Column, ring: Column) -> Column:
    """Whether a point lies inside a ring (array<struct<lon,lat>>, closed or not); even-odd rule."""

    def crosses(i: Column) -> Column:
        p, q = F.get(ring, i), F.get(ring, F.pmod(i + 1, F.size(ring)))
        return ((p["lat"] > lat) != (q["lat"] > lat)) & (lon < (q["lon"] - p["lon"]) * (lat - p["lat"]) / F.when(q["lat"] == p["lat"], _d(1)).otherwise(q["lat"] - p["lat"]) + p["lon"])

    hits = F.size(F.filter(F.sequence(F.lit(0), F.size(ring) - 1), crosses))
    return (F.size(ring) > 2) & (hits % 2 == 1)


def in_polygon(lat: Column, lon: Column, rings: Column) -> Column:
    """Whether a point lies inside the first ring and in no other (holes)."""
    holes = F.slice(rings, 2, F.greatest(F.size(rings) - 1, F.lit(0)))
    return in_ring(lat, lon, F.get(rings, F.lit(0))) & ~F.exists(holes, lambda h: in_ring(lat, lon, h))


def ring_area(ring: Column) -> Column:
    """Shoelace area of a ring in square degrees."""
    term = lambda i: F.get(ring, i)["lon"] * F.get(ring, F.pmod(i + 1, F.size(ring)))["lat"] - F.get(ring, F.pmod(i + 1, F.size(ring)))["lon"] * F.get(ring, i)["lat"]
    return F.abs(F.aggregate(F.transform(F.sequence(F.lit(0), F.size(ring) - 1), term), _d(0), lambda s, x: s + x)) / _d(2)
