"""Order that matters: routes that can be planned together, and points that keep apart, first come first served."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from meshwright.operators import network, spatial
from meshwright.operators.stage import cut, numbered

#: Routes of a group that one task takes at a time.
BLOCK = 20_000


def waves(claims: DataFrame) -> DataFrame:
    """(route, wave): routes that claim a common cell are planned in their order, all others together.

    ``claims`` has route and cell.  A route's wave is one more than the largest of the earlier routes
    that it meets, so that planning wave after wave gives what planning one route after the other gives, in as many
    waves as the longest chain of meetings has routes.  Routes that meet, directly or through others, are a
    group; groups go on side by side, each in blocks of its routes in order.  Between blocks only the last wave of each
    cell is handed on, so that the rounds are the blocks of the largest group, however long its chains.
    """
    own = cut(claims.select("route", "cell").distinct())
    before = own.withColumn("before", F.lag("route").over(W.partitionBy("cell").orderBy("route"))).where("before is not null")
    routes = own.select(F.col("route").alias("id")).distinct()
    groups = cut(network.components(routes, before.select(F.col("before").alias("a"), F.col("route").alias("b"))))
    placed = cut(numbered(groups, [F.col("component"), F.col("id")], "place"))
    starts = placed.groupBy(F.col("component").alias("c")).agg(F.min("place").alias("start"))
    blocks = placed.join(starts, F.col("component") == F.col("c")).select("id", "component", F.floor((F.col("place") - F.col("start")) / BLOCK).cast("int").alias("block"))
    dealt = cut(own.join(blocks, F.col("route") == F.col("id")).select("component", "block", "route", "cell"))
    rounds = dealt.agg(F.max("block")).first()[0]
    found = own.select("route", F.lit(0).alias("wave")).limit(0)
    last = cut(own.select("cell", F.lit(0).alias("last")).limit(0))
    schema = f"route {own.schema['route'].dataType.simpleString()}, wave int"
    for block in range(-1 if rounds is None else rounds + 1):
        asked = dealt.where(F.col("block") == block).select("component", "route", "cell").join(last.withColumnRenamed("cell", "k"), F.col("cell") == F.col("k"), "left").drop("k")
        told = cut(asked.groupBy("component").applyInPandas(_in_order, schema))
        found = found.union(told)
        if block < rounds:
            here = dealt.where(F.col("block") == block).join(told.withColumnRenamed("route", "r"), F.col("route") == F.col("r")).select("cell", F.col("wave").alias("last"))
            last = cut(last.union(here).groupBy("cell").agg(F.max("last").alias("last")))
    return found


def _in_order(rows: pd.DataFrame) -> pd.DataFrame:
    """Waves of a block's routes (route, cell, last: the cell's last wave before them, if any)."""
    rows = rows.sort_values("route", kind="stable")
    known: dict = {}
    out: dict = {}
    claimed: dict = {}
    for route, cell, last in zip(rows["route"], rows["cell"], rows["last"], strict=True):
        claimed.setdefault(route, []).append(cell)
        if last == last and last is not None:
            known[cell] = int(last)
    for route, cells in claimed.items():
        out[route] = 1 + max(known.get(cell, -1) for cell in cells)
        known.update(dict.fromkeys(cells, out[route]))
    return pd.DataFrame({"route": list(out), "wave": list(out.values())})


def first_fit(points: DataFrame, radius_m: float, standing: DataFrame | None = None) -> DataFrame:
    """(id, kept, by): each point in order is kept unless a point that is kept stands within the radius; ``by`` is the nearest of those.

    ``points`` have id, ord (all different), lat, lon, and may have ``fixed``: such a point is always kept.  ``standing`` points
    (id, lat, lon) were there before all others.  Where points have ``reach`` and all have ``size``, a point's own radius is its reach
    and the other's size, none above ``radius_m``.  A point is decided when all earlier points within its
    reach are; many are in each round, and there are as many rounds as the longest chain of points
    in each other's reach, in order, has points.
    """
    own = "reach" in points.columns
    if not own and "fixed" not in points.columns:
        return _first_fit_by_place(points, radius_m, standing)
    return _first_fit(points, radius_m, standing)


def _first_fit_by_place(points: DataFrame, radius_m: float, standing: DataFrame | None) -> DataFrame:
    """``first_fit`` where only the first point of each place can be kept: what blocks it blocks the others, and if it is kept it does."""
    rows = cut(points.select("id", "ord", "lat", "lon"))
    first = cut(rows.groupBy("lat", "lon").agg(F.min_by("id", "ord").alias("id"), F.min("ord").alias("ord")))
    found = cut(_first_fit(first, radius_m, standing).where("kept").select(F.col("id").alias("k")))
    state = cut(rows.join(found, F.col("id") == F.col("k"), "left").select("id", "ord", "lat", "lon", F.col("k").isNotNull().alias("kept")))
    others = state.where("not kept").drop("kept")
    near = spatial.range_join(others, state.where("kept").drop("kept"), radius_m, "gap").where("ord2 < ord1").groupBy(F.col("id1").alias("late")).agg(F.min_by("id2", F.struct("gap", "ord2")).alias("own"))
    out = state.join(near, F.col("id") == F.col("late"), "left").drop("late")
    if standing is None:
        return out.select("id", "kept", F.when(~F.col("kept"), F.col("own")).alias("by"))
    places = first.select("id", "lat", "lon")
    stood = spatial.range_join(places, standing.select("id", "lat", "lon"), radius_m, "gap").groupBy("lat1", "lon1").agg(F.min_by("id2", F.struct("gap", "id2")).alias("stood"))
    out = out.join(stood, (F.col("lat") == F.col("lat1")) & (F.col("lon") == F.col("lon1")), "left")
    return out.select("id", "kept", F.when(~F.col("kept"), F.coalesce("stood", "own")).alias("by"))


def _first_fit(points: DataFrame, radius_m: float, standing: DataFrame | None) -> DataFrame:
    rows = points if "fixed" in points.columns else points.withColumn("fixed", F.lit(False))
    own = "reach" in points.columns
    rows = cut(rows.select("id", "ord", "lat", "lon", "fixed", *(["reach", "size"] if own else [])))
    inside = F.col("gap") <= F.col("reach1") + F.col("size2") if own else F.lit(True)
    pairs = spatial.range_join(rows, rows, radius_m, "gap").where("ord2 < ord1 and not fixed1").where(inside)
    pairs = cut(pairs.select(F.col("id1").alias("late"), F.col("id2").alias("early"), F.col("ord2").alias("early_ord"), "gap"))
    taken = None
    if standing is not None:
        # ranks before all points
        taken = cut(spatial.range_join(rows, standing.select("id", "lat", "lon", *(["size"] if own else [])), radius_m, "gap").where("not fixed1").where(inside).groupBy(F.col("id1").alias("late")).agg(F.min_by(F.struct("id2"), F.struct("gap", "id2")).alias("b")).select("late", "b.id2"))
    state = rows.select("id", F.when(F.col("fixed"), F.lit(True)).alias("kept"))
    if taken is not None:
        state = state.join(taken, F.col("id") == F.col("late"), "left").select("id", F.when(F.col("late").isNotNull(), F.lit(False)).otherwise(F.col("kept")).alias("kept"))
    state = cut(state)
    while True:
        seen = pairs.join(state.select(F.col("id").alias("e"), F.col("kept").alias("early_kept")), F.col("early") == F.col("e"))
        told = seen.groupBy("late").agg(F.max(F.coalesce("early_kept", F.lit(False))).alias("blocked"), F.max(F.col("early_kept").isNull()).alias("waits"))
        open_ = state.where("kept is null").join(told, F.col("id") == F.col("late"), "left")
        decided = cut(open_.select("id", F.when(F.col("blocked"), F.lit(False)).when(~F.coalesce("waits", F.lit(False)), F.lit(True)).alias("now")).where("now is not null"))
        if decided.isEmpty():
            break
        state = cut(state.join(decided.withColumnRenamed("id", "d"), F.col("id") == F.col("d"), "left").select("id", F.coalesce("kept", "now").alias("kept")))
    near = pairs.join(state.where("kept").select(F.col("id").alias("e")), F.col("early") == F.col("e")).groupBy("late").agg(F.min_by("early", F.struct("gap", "early_ord")).alias("own"))
    out = state.join(near, F.col("id") == F.col("late"), "left").drop("late")
    if taken is not None:
        out = out.join(taken.select("late", F.col("id2").alias("stood")), F.col("id") == F.col("late"), "left").drop("late")
    else:
        out = out.withColumn("stood", F.lit(None).cast("long"))
    return out.select("id", "kept", F.when(~F.col("kept"), F.coalesce("stood", "own")).alias("by"))
