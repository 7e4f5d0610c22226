"""Sight between all members of places: what a line has in common is found once, the heights of its ends meet it in arrays.

The functions of a row of ``spatial.packs`` are evaluated for every pair of different heights of its two sides, and handed
on for every pair of members; nothing is shuffled for a pair of members.
"""

from __future__ import annotations

import copy
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from meshwright.config import MeshConfig
from meshwright.functions import exact, geo, physics
from meshwright.operators import dem, los, spatial
from meshwright.operators.stage import cut

#: Rows of a batch that is handed on, and numbers of an array that is worked on.
ROWS, CELLS = 1 << 16, 1 << 18
#: Gates as numbers: they cross to Spark as such.
GATES = ("same", "distance", "budget", "coarse", "dense")
_OFFSET = 1 << 31


def for_members(found: DataFrame, of: spatial.Kinds, schema: str, values: Callable[[dict, np.ndarray, np.ndarray], dict]) -> DataFrame:
    """(id1, id2, ...) for every pair of members with id1 < id2 of pairs of kinds; ``values`` of a row and two arrays of heights gives the columns of ``schema``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting: list[dict] = []
        for batch in batches:
            of_row = [_column(c) for c in batch.columns]
            for i in range(batch.num_rows):
                row = {name: get(i) for name, get in zip(batch.schema.names, of_row, strict=True)}
                first, second = np.nonzero(row["ids1"][:, None] < row["ids2"][None, :])
                if not first.size:
                    continue
                (own1, at1), (own2, at2) = (np.unique(row[f"own{side}"], return_inverse=True) for side in "12")
                known = values(row, np.repeat(own1, own2.size), np.tile(own2, own1.size))
                at = at1[first] * own2.size + at2[second]
                waiting.append({"id1": row["ids1"][first], "id2": row["ids2"][second]} | {k: v[at] for k, v in known.items()})
                if sum(w["id1"].size for w in waiting) >= ROWS:
                    yield _batch(waiting)
                    waiting = []
        if waiting:
            yield _batch(waiting)

    return spatial.packs(found, of).mapInArrow(run, f"id1 long, id2 long, {schema}")


def _column(column: pa.Array) -> Callable[[int], object]:
    if pa.types.is_list(column.type):
        values, offsets = column.values.to_numpy(zero_copy_only=False), column.offsets.to_numpy()
        null = column.is_null().to_numpy(zero_copy_only=False)
        return lambda i: values[:0] if null[i] else values[offsets[i] : offsets[i + 1]]
    return column.to_numpy(zero_copy_only=False).__getitem__


def _batch(parts: list[dict]) -> pa.RecordBatch:
    names = list(parts[0])
    return pa.RecordBatch.from_arrays([pa.array(np.concatenate([p[n] for p in parts]), from_pandas=True) for n in names], names)


def _fspl(distance_m: np.ndarray, frequency_hz: float) -> np.ndarray:
    return 20.0 * exact.log10(distance_m / 1000.0) + 20.0 * exact.log10([frequency_hz / 1e6]) + physics.FSPL_CONSTANT


def loss_db(fspl: float, clearance: np.ndarray, d1: np.ndarray, d2: np.ndarray, frequency_hz: float) -> np.ndarray:
    """``physics.path_loss_db`` of arrays, the knife edge only where the clearance is negative."""
    found = np.full(clearance.shape, float(fspl))
    low = ~(clearance >= 0)
    one, two = d1[low] / 1000.0, d2[low] / 1000.0
    r1 = physics.FRESNEL_CONSTANT * np.sqrt(one * two / (frequency_hz / 1e6 * (one + two)))
    v = 2.0**0.5 * np.abs(clearance[low]) / r1 - 0.1
    found[low] = fspl + 6.9 + 20.0 * exact.log10(np.sqrt(v * v + 1.0) + v)
    return found


def losses(pairs: DataFrame, of: spatial.Kinds, frequency_hz: float, clearance: Callable[[np.ndarray, np.ndarray], np.ndarray]) -> DataFrame:
    """(id1, id2, loss_db) of pairs of members of kinds (id1, id2, chord_m > 0), whose obstacle stands in the middle."""

    def values(row: dict, own1: np.ndarray, own2: np.ndarray) -> dict:
        middle = np.full(own1.shape, row["chord_m"] / 2.0)
        return {"loss_db": loss_db(_fspl(np.array([row["chord_m"]]), frequency_hz)[0], clearance(own1, own2), middle, middle, frequency_hz)}

    return for_members(pairs.select("id1", "id2", "chord_m"), of, "loss_db double", values)


# --- profiles of a line ---------------------------------------------------------------------------


def _steps(far: float, step_m: float, most: int) -> np.ndarray:
    """Fractions of the dense profile, the ends with it."""
    n = int(min(max(2, np.floor(far / step_m)), max(most, 2)))
    return np.arange(n + 1) / float(n)


def _between(f: np.ndarray, far: float) -> tuple[np.ndarray, np.ndarray]:
    """Fractions of the samples that the refinement of each point adds (a row a point, by place; longer rows than needed end at its next point), and how many they are."""
    lo, hi = np.concatenate([f[:1], f[:-1]]), np.concatenate([f[1:], f[-1:]])
    n = np.floor((hi - lo) * far / los.REFINE_STEP_M)
    i = np.arange(1, max(int(n.max()), 2))
    return lo[:, None] + (hi - lo)[:, None] * np.minimum(i, n[:, None]) / np.maximum(n, 1.0)[:, None], np.maximum(n - 1, 0).astype("int64")


def _corners(row: dict, raster: dict, t: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Row and column of the pixels north-west of points of a line, the shares beyond them, and whether all four are inside."""
    r = (raster["north"] - (row["lat1"] + (row["lat2"] - row["lat1"]) * t)) / raster["dlat"]
    c = ((row["lon1"] + (row["lon2"] - row["lon1"]) * t) - raster["west"]) / raster["px"]
    r0, c0 = np.floor(r), np.floor(c)
    whole = (r0 >= 0) & (r0 + 1 < raster["height"]) & (c0 >= 0) & (c0 + 1 < raster["width"])
    return r0.astype("int64"), c0.astype("int64"), r - r0, c - c0, whole


def _key(r: np.ndarray, c: np.ndarray) -> np.ndarray:
    return (r << 32) | (c + _OFFSET)


def _terrain(row: dict, raster: dict, t: np.ndarray) -> np.ndarray:
    """Bilinear terrain of points of a line, from its pixels (keys sorted, values); the nearest where not all four are inside."""

    def at(r: np.ndarray, c: np.ndarray) -> np.ndarray:
        if not row["keys"].size:
            return np.zeros(r.shape)
        key = _key(r, c)
        place = np.minimum(np.searchsorted(row["keys"], key), row["keys"].size - 1)
        return np.where(row["keys"][place] == key, row["pixels"][place], 0.0)

    r, c, fr, fc, whole = _corners(row, raster, t)
    near = at(r, c)
    return np.where(whole, (1 - fr) * (1 - fc) * near + (1 - fr) * fc * at(r, c + 1) + fr * (1 - fc) * at(r + 1, c) + fr * fc * at(r + 1, c + 1), near)


class _Line:
    """The parts of the metrics that do not depend on the heights of the ends; points are in order of their fraction, in one row or in one a pair of heights."""

    def __init__(self, far: float, config: MeshConfig, f: np.ndarray, terrain: np.ndarray):
        self.f, self.terrain, self.d1 = f, terrain, f * far
        self.d2 = far - self.d1
        self.curve = self.d1 * self.d2 / (2 * config.effective_earth_radius_m)
        self.radius = np.sqrt(config.wavelength_m * self.d1 * self.d2 / far)
        self.inner = (f > 0) & (f < 1)

    def met(self, h1: np.ndarray, h2: np.ndarray, g1: np.ndarray, g2: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Clearance and obstruction, a row a pair of heights and a column a point; points with a terrain of nan are the ends, on their own ground."""
        terrain = np.broadcast_to(self.terrain, (h1.size, self.f.shape[-1]))
        if np.isnan(self.terrain).any():
            terrain = np.where(np.isnan(self.terrain), np.where(self.f == 0, g1[:, None], g2[:, None]), terrain)
        geometric = h1[:, None] + (h2 - h1)[:, None] * self.f - self.curve - terrain
        taken = np.maximum(0.0, np.minimum(1.0, (self.radius - geometric) / np.where(self.radius > 0, self.radius, 1.0)))
        return geometric - self.radius, np.where(self.radius > 0, taken, np.where(geometric < 0, 1.0, 0.0))

    def of(self, rows: np.ndarray) -> _Line:
        """Some rows of points, in order and repeated as asked."""
        some = copy.copy(self)
        some.__dict__ = {k: v[rows] for k, v in self.__dict__.items()}
        return some

    def most(self, obstruction: np.ndarray) -> np.ndarray:
        """The largest obstruction of the interior, else of all."""
        return (obstruction[:, self.inner] if self.inner.any() else obstruction).max(axis=1)


def _worst(clearance: np.ndarray, obstruction: np.ndarray) -> np.ndarray:
    """The places of the most obstructed points, then the least clear, then the first; -1 where there are no more."""
    left, rows = obstruction.copy(), np.arange(len(obstruction))
    found = np.full((len(obstruction), los.WORST), -1)
    for k in range(min(los.WORST, obstruction.shape[1])):
        found[:, k] = np.where(left == left.max(axis=1)[:, None], clearance, np.inf).argmin(axis=1)
        left[rows, found[:, k]] = -1.0
    return found


def _round6(f: np.ndarray) -> np.ndarray:
    return np.rint(f * 1e6) / 1e6


def _decided(row: dict, config: MeshConfig, clearance: np.ndarray, f: np.ndarray, obstruction: np.ndarray, fspl: float) -> tuple[np.ndarray, np.ndarray]:
    """Loss, and whether it and the obstruction are accepted, of the least clearance and where it is."""
    far = row["distance_m"]
    d1 = f * far
    d2 = far - d1
    off = (d1 <= 0) | (d2 <= 0)
    loss = loss_db(fspl, clearance, np.where(off, far / 2, d1), np.where(off, far / 2, d2), config.frequency_hz)
    return loss, (loss <= config.link_budget_db) & (obstruction <= physics.MOST_OBSTRUCTION)


def _refined(beside: _Line, counts: np.ndarray, allowed: int, worst: np.ndarray, heights: tuple[np.ndarray, ...], best: tuple[np.ndarray, np.ndarray, np.ndarray]) -> tuple[np.ndarray, ...]:
    """``best`` (clearance, fraction, obstruction) lowered by the samples beside the worst points (a row of ``beside`` a point), while ``allowed`` lasts."""
    before, rows = np.zeros(len(worst), dtype="int64"), np.arange(len(worst))
    places = np.arange(1, beside.f.shape[1] + 1)
    for k in worst.T:
        line, most = beside.of(k), np.where(k < 0, 0, counts[k])[:, None]
        clearance, obstruction = line.met(*heights)
        beyond = (places > most) | (before[:, None] + places > allowed)
        clearance[beyond] = np.inf
        obstruction[beyond | ~line.inner] = 0.0
        at = clearance.argmin(axis=1)
        least, where = clearance[rows, at], line.f[rows, at]
        lower = (least < best[0]) | ((least == best[0]) & (where < best[1]))
        best = np.where(lower, least, best[0]), np.where(lower, where, best[1]), np.maximum(best[2], obstruction.max(axis=1))
        before += most[:, 0]
    return best


def sights(pairs: DataFrame, of: spatial.Kinds, config: MeshConfig, raster: dem.Raster | None = None) -> DataFrame:
    """``los.evaluate`` for all pairs of members with id1 < id2: id1, id2, clearance_m, path_loss_db, visible, gate.

    ``pairs`` are of kinds: lat, lon and cell per end, and the highest ground of a kind; ``of`` has ground as its own.
    """
    rows = pairs.select(F.struct("id1", "id2").alias("id"), *[f"{c}{side}" for c in ("id", "lat", "lon", "cell", "ground") for side in "12"]).withColumn("distance_m", geo.geodesic_exact(F.col("lat1"), F.col("lon1"), F.col("lat2"), F.col("lon2")))
    free = physics.fspl_db(F.col("distance_m"), config.frequency_hz)
    gate = F.when((F.col("cell1") == F.col("cell2")) | (F.col("distance_m") == 0), 0).when(F.col("distance_m") > config.max_visibility_m, 1).when(free > config.link_budget_db, 2).otherwise(3)
    rows = cut(rows.withColumn("gate", gate))
    open_ = rows.where("gate = 3")
    known = rows.select(F.col("cell1").alias("cell"), F.col("ground1").alias("elevation")).union(rows.select("cell2", "ground2")).groupBy("cell").agg(F.max("elevation").alias("elevation"))
    middle = los.between_ends(open_, known, raster).select("id", F.bround("fraction", 6).alias("f"), "terrain")
    way = middle.groupBy(F.col("id").alias("__w")).agg(F.collect_list(F.struct("f", "terrain")).alias("w"))
    # tables as long as the pairs: their files are small, their rows in the driver would not be
    lines = rows.join(way.hint("merge"), F.col("id") == F.col("__w"), "left").select("id", "id1", "id2", "lat1", "lon1", "lat2", "lon2", "distance_m", "gate", F.col("w.f").alias("f"), F.col("w.terrain").alias("terrain"))
    place = None
    if raster is not None:
        place = {"north": raster.north, "west": raster.west, "px": raster.px, "dlat": raster.dlat, "width": raster.width, "height": raster.height}
        strips = _strips(open_, raster, place, config)
        lines = lines.join(strips.hint("merge"), F.col("id") == F.col("__s"), "left").drop("__s")
    values = _evaluation(config, place)
    found = for_members(cut(lines.drop("id")), of, "clearance_m double, path_loss_db double, visible boolean, gate int", values)
    return found.withColumn("gate", F.element_at(F.array(*[F.lit(g) for g in GATES]), F.col("gate") + 1))


def _strips(lines: DataFrame, raster: dem.Raster, place: dict, config: MeshConfig) -> DataFrame:
    """(__s, keys, pixels): the pixels that samples of a line may need."""
    step, most = config.los_dense_sample_step_m, config.los_dense_max_samples

    @F.pandas_udf("array<long>")
    def keys(lat1: pd.Series, lon1: pd.Series, lat2: pd.Series, lon2: pd.Series, far: pd.Series) -> pd.Series:
        found = []
        for a, b, c, d, e in zip(lat1, lon1, lat2, lon2, far, strict=True):
            f = _steps(e, step, most)
            t = np.concatenate([f[1:-1], _between(f, e)[0].ravel()])
            r, q, _, _, whole = _corners({"lat1": a, "lon1": b, "lat2": c, "lon2": d}, place, t)
            near = [_key(r, q)] + [_key(r[whole] + i, q[whole] + j) for i, j in ((0, 1), (1, 0), (1, 1))]
            found.append(np.unique(np.concatenate(near)))
        return pd.Series(found)

    asked = lines.select("id", F.explode(keys("lat1", "lon1", "lat2", "lon2", "distance_m")).alias("key"))
    asked = asked.withColumn("r", F.shiftright("key", 32)).withColumn("c", F.col("key").bitwiseAND(F.lit(0xFFFFFFFF).cast("long")) - F.lit(_OFFSET))
    px = raster.at(asked, "r", "c").where("value is not null").select(F.col("row").cast("long").alias("__pr"), F.col("col").cast("long").alias("__pc"), F.col("value").cast("double").alias("v"))
    met = asked.join(px, (F.col("r") == F.col("__pr")) & (F.col("c") == F.col("__pc")))
    sorted_ = F.array_sort(F.collect_list(F.struct("key", "v")))
    return met.groupBy(F.col("id").alias("__s")).agg(sorted_.alias("p")).select("__s", F.col("p.key").alias("keys"), F.col("p.v").alias("pixels"))


def _evaluation(config: MeshConfig, raster: dict | None) -> Callable[[dict, np.ndarray, np.ndarray], dict]:
    def values(row: dict, g1: np.ndarray, g2: np.ndarray) -> dict:
        gate, far = row["gate"], row["distance_m"]
        filled = lambda clearance, loss, seen: {"clearance_m": np.full(g1.shape, clearance), "path_loss_db": np.full(g1.shape, loss), "visible": np.full(g1.shape, seen), "gate": np.full(g1.shape, gate, dtype="int32")}
        if gate == 0:
            return filled(config.mast_height_m, 0.0, True)
        if gate == 1:
            return filled(los.BLOCKED_CLEARANCE, los.NO_LOSS, False)
        fspl = float(_fspl(np.array([far]), config.frequency_hz)[0])
        if gate == 2:
            return filled(los.BLOCKED_CLEARANCE, fspl, False)
        f = np.concatenate([[0.0], row["f"], [1.0]])
        order = np.argsort(f, kind="stable")
        coarse = _Line(far, config, f[order], np.concatenate([[np.nan], row["terrain"], [np.nan]])[order])
        out = filled(0.0, 0.0, False)
        if raster is not None:
            steps = _steps(far, config.los_dense_sample_step_m, config.los_dense_max_samples)
            ground = _terrain(row, raster, steps)
            ground[[0, -1]] = np.nan
            first, rounded = _Line(far, config, steps, ground), _Line(far, config, _round6(steps), ground)
            beside, allowed = None, config.los_dense_max_samples - steps.size
        size = max(1, CELLS // (steps.size if raster is not None else f.size))
        for begin in range(0, g1.size, size):
            part = slice(begin, begin + size)
            heights = (g1[part] + config.mast_height_m, g2[part] + config.mast_height_m, g1[part], g2[part])
            clearance, obstruction = coarse.met(*heights)
            at = clearance.argmin(axis=1)
            least = clearance[np.arange(at.size), at]
            loss, seen = _decided(row, config, least, coarse.f[at], coarse.most(obstruction), fspl)
            if raster is not None and seen.any():
                go = np.nonzero(seen)[0]
                dense = tuple(h[go] for h in heights)
                clearance, obstruction = first.met(*dense)
                good = np.nonzero(first.most(obstruction) <= physics.MOST_OBSTRUCTION)[0]
                worst = _worst(clearance[good], obstruction[good])
                clearance, obstruction = rounded.met(*dense)
                at = clearance.argmin(axis=1)
                best = (clearance[np.arange(at.size), at], rounded.f[at], rounded.most(obstruction))
                some = tuple(x[good] for x in best)
                if good.size and allowed > 0:
                    if beside is None:
                        fractions, counts = _between(steps, far)
                        beside = _Line(far, config, _round6(fractions), _terrain(row, raster, fractions))
                    some = _refined(beside, counts, allowed, worst, tuple(h[good] for h in dense), some)
                    for x, y in zip(best, some, strict=True):
                        x[good] = y
                least[go] = best[0]
                loss[go], seen[go] = _decided(row, config, *best, fspl)
                out["gate"][part][go] = 4
            out["clearance_m"][part], out["path_loss_db"][part], out["visible"][part] = least, loss, seen
        return out

    return values
