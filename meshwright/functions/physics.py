"""Radio physics as expressions: path loss, Fresnel clearance, link budget."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Share of the Fresnel radius that terrain may obstruct.
MOST_OBSTRUCTION = 0.4
#: Fixed values of the free-space formula (km, MHz) and of the Fresnel radius (km, GHz as MHz).
FSPL_CONSTANT, FRESNEL_CONSTANT = 32.44, 17.32


def _d(x: float) -> Column:
    return F.lit(float(x))


def fspl_db(distance_m: Column, frequency_hz: Column | float) -> Column:
    """Free-space path loss."""
    f = _d(frequency_hz) if isinstance(frequency_hz, (int, float)) else frequency_hz
    return _d(20) * F.log10(distance_m / _d(1000)) + _d(20) * F.log10(f / _d(1e6)) + _d(FSPL_CONSTANT)


def knife_edge_db(clearance_m: Column, d1_m: Column, d2_m: Column, frequency_hz: float) -> Column:
    """Loss over a single edge that stands ``-clearance`` above the line."""
    d1, d2 = d1_m / _d(1000), d2_m / _d(1000)
    r1 = _d(FRESNEL_CONSTANT) * F.sqrt(d1 * d2 / (_d(frequency_hz / 1e6) * (d1 + d2)))
    v = _d(2.0**0.5) * F.abs(clearance_m) / r1 - _d(0.1)
    return _d(6.9) + _d(20) * F.log10(F.sqrt(v * v + _d(1)) + v)


def path_loss_db(distance_m: Column, frequency_hz: float, clearance_m: Column, d1_m: Column | None = None, d2_m: Column | None = None) -> Column:
    """Free-space loss, and knife-edge loss where the clearance is negative; raises for a distance that is not positive.

    Without positive parts d1 and d2 the obstacle stands in the middle.
    """
    if frequency_hz <= 0:
        raise ValueError("the frequency must be positive")
    middle = distance_m / _d(2)
    d1 = F.coalesce(d1_m, middle) if d1_m is not None else middle
    d2 = F.coalesce(d2_m, middle) if d2_m is not None else middle
    off = (d1 <= 0) | (d2 <= 0)
    d1, d2 = F.when(off, middle).otherwise(d1), F.when(off, middle).otherwise(d2)
    loss = fspl_db(distance_m, frequency_hz)
    both = F.when(clearance_m >= 0, loss).otherwise(loss + knife_edge_db(clearance_m, d1, d2, frequency_hz))
    return F.when(distance_m <= 0, F.raise_error(F.lit("the distance must be positive")).cast("double")).otherwise(both)


def max_fspl_distance_m(frequency_hz: float, budget_db: float) -> float:
    """The distance at which free-space loss uses up a budget; 0 without one."""
    if budget_db <= 0:
        return 0.0
    return 1000.0 * 10 ** ((budget_db - FSPL_CONSTANT - 20 * math.log10(frequency_hz / 1e6)) / 20)


def sample_metrics(fraction: Column, terrain_m: Column, distance_m: Column, height1_m: Column, height2_m: Column, wavelength_m: float, effective_radius_m: float) -> Column:
    """struct<d1, d2, fresnel, geometric, clearance, obstruction> of a point of a profile.

    height1 and height2 are the absolute heights of the antennas; geometric clearance is
    line height less curvature and terrain, clearance is that less the Fresnel radius, and
    obstruction the share of the radius that terrain takes (0 to 1).
    """
    d1 = fraction * distance_m
    d2 = distance_m - d1
    line = height1_m + (height2_m - height1_m) * fraction
    curve = d1 * d2 / _d(2 * effective_radius_m)
    radius = F.sqrt(_d(wavelength_m) * d1 * d2 / F.when(distance_m > 0, distance_m).otherwise(_d(1)))
    geometric = line - curve - terrain_m
    share = F.when(radius > 0, F.greatest(_d(0), F.least(_d(1), (radius - geometric) / F.when(radius > 0, radius).otherwise(_d(1))))).otherwise(F.when(geometric < 0, _d(1)).otherwise(_d(0)))
    return F.struct(d1.alias("d1"), d2.alias("d2"), radius.alias("fresnel"), geometric.alias("geometric"), (geometric - radius).alias("clearance"), share.alias("obstruction"))


def obstruction_accepts(share: Column) -> Column:
    """Whether an obstruction share is within the rule."""
    return share <= _d(MOST_OBSTRUCTION)


def received_power_dbm(loss_db: Column, tx_dbm: float, gain_dbi: float) -> Column:
    return _d(tx_dbm + 2 * gain_dbi) - loss_db


def edge_cost(elevation1: Column, elevation2: Column) -> Column:
    """Cost of a step between road cells: 1, with more for steep ones."""
    rise = F.abs(elevation1 - elevation2)
    return _d(1) + F.when(rise > 50, _d(0.5)).otherwise(_d(0)) + F.when(rise > 100, _d(1)).otherwise(_d(0))


def mast_height(mast_m: float, offset_m: Column) -> Column:
    """Mast height with a cell's own offset."""
    return _d(mast_m) + F.coalesce(offset_m, _d(0))
