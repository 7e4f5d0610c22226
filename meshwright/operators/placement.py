"""Towers along corridors: max-min path by dynamic programming, gaps, repair, pruning.

The program runs for all routes at once, a join and an aggregate a layer: the state of
layer t is the best bottleneck clearance with which each corridor cell can be the t-th
tower, with the path kept beside it.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from meshwright.config import MeshConfig
from meshwright.functions import geo, grid, physics
from meshwright.operators import spatial
from meshwright.operators.stage import cut

#: Rounds of gap repair, and candidates that each side of a gap tries.
REPAIR_ROUNDS, CANDIDATES = 3, 24
#: Positions ahead that a position of a corridor meets within the window of its route.
AHEAD = 32


def forward_pairs(corridor: DataFrame, most_m: float) -> DataFrame:
    """(route, i, j, distance_m, ...): pairs of positions i < j by centroid distance; once a distance of i exceeds the limit all later j go.

    ``corridor`` has route, pos, lat, lon, unfit.  A position first meets the AHEAD that follow it, in a window of its route, so that
    its rows are dealt once; its partners in reach are numbered in order, and stay as long as none is missing between them.
    A position that has all of these in reach, which takes a route of more cells, meets those farther on by ``range_join``.
    """
    names = ["pos", "lat", "lon", "unfit"]
    of_route = W.partitionBy("route").orderBy("pos")
    rows = corridor.select("route", *names).withColumn("n", F.row_number().over(of_route))
    # a chord on the sphere is never more than a hundredth longer than the geodesic
    reach = most_m * 1.01
    placed = rows
    for axis, v in zip("xyz", geo.xyz(F.col("lat"), F.col("lon")), strict=True):
        placed = placed.withColumn(f"__{axis}", v)
    follow = F.collect_list(F.struct(*names, "n", "__x", "__y", "__z")).over(of_route.rowsBetween(1, AHEAD))
    met = placed.withColumn("__follow", follow).withColumn("__o", F.explode("__follow")).drop("__follow")
    gap = [(F.col(f"__{axis}") - F.col(f"__o.__{axis}")) * (F.col(f"__{axis}") - F.col(f"__o.__{axis}")) for axis in "xyz"]
    met = met.where(F.sqrt(gap[0] + gap[1] + gap[2]) <= reach)
    near = met.select("route", *[F.col(c).alias(f"{c}1") for c in (*names, "n")], *[F.col(f"__o.{c}").alias(f"{c}2") for c in (*names, "n")])

    def kept(pairs: DataFrame) -> DataFrame:
        far = geo.geodesic_rows(F.col("lat1"), F.col("lon1"), F.col("lat2"), F.col("lon2"))
        pairs = pairs.withColumn("distance_m", far).where(F.col("distance_m") <= most_m)
        place = F.row_number().over(W.partitionBy("route", "n1").orderBy("n2"))
        return pairs.withColumn("place", place).where(F.col("place") == F.col("n2") - F.col("n1"))

    found = kept(near)
    if not corridor.groupBy("route").count().where(F.col("count") > AHEAD + 1).isEmpty():
        found, rows = cut(found), cut(rows)
        open_ = found.where(F.col("place") == AHEAD).select(F.col("route").alias("__r"), F.col("n1").alias("__n"))
        left = rows.join(open_, (F.col("route") == F.col("__r")) & (F.col("n") == F.col("__n")), "left_semi")
        rest = spatial.range_join(left, rows, reach, "chord", "route").where("n1 < n2").withColumnRenamed("route1", "route")
        found = found.unionByName(kept(rest.select(*near.columns)).where(F.col("place") > AHEAD))
    return found.select("route", F.col("pos1").alias("i"), "lat1", "lon1", "unfit1", F.col("pos2").alias("j"), "lat2", "lon2", "unfit2", "distance_m")


def prefiltered(pairs: DataFrame, corridor: DataFrame, config: MeshConfig) -> DataFrame:
    """Pairs that line of sight is worth asking for, with ``reason`` for the others: zero (accepted), budget, unfit."""
    last = corridor.groupBy(F.col("route").alias("r3")).agg(F.min("pos").alias("lo"), F.max("pos").alias("hi"))
    rows = pairs.join(last, F.col("route") == F.col("r3")).drop("r3")
    end = lambda c: (F.col(c) == F.col("lo")) | (F.col(c) == F.col("hi"))
    loss = physics.fspl_db(F.greatest("distance_m", F.lit(1e-9)), config.frequency_hz)
    reason = F.when(F.col("distance_m") <= 0, "zero").when(loss > config.link_budget_db, "budget").when((F.col("unfit1") & ~end("i")) | (F.col("unfit2") & ~end("j")), "unfit").otherwise("ask")
    return rows.withColumn("reason", reason).drop("lo", "hi")


def best_paths(edges: DataFrame, lengths: DataFrame, k: int | Column) -> DataFrame:
    """(route, towers, quality, path): the max-min path of each corridor from its first position to its last.

    ``edges`` (route, i, j, clearance) are the visible forward pairs, ``lengths`` (route, last[, k])
    the last positions; at most k towers (or the route's own ``k``).  The fewest towers with a positive
    bottleneck win, else the best bottleneck (ties to fewer); routes without a path are absent.
    """
    limit = k if isinstance(k, int) else int(lengths.agg(F.max("k")).collect()[0][0] or 2)
    steps = cut(edges.select("route", "i", "j", "clearance"))
    state = lengths.select("route", F.lit(0).alias("j"), F.lit(float("inf")).alias("q"), F.array(F.lit(0)).alias("path"))
    found = []
    for t in range(2, limit + 1):
        before = state.select(F.col("route").alias("r"), F.col("j").alias("at"), "q", "path")
        ahead = steps.join(before, (F.col("route") == F.col("r")) & (F.col("i") == F.col("at"))).select("route", "j", F.least("q", "clearance").alias("q"), "i", "path")
        best = F.max_by(F.struct("q", "path"), F.struct("q", (-F.col("i")).alias("o")))
        state = cut(ahead.groupBy("route", "j").agg(best.alias("b")).select("route", "j", "b.q", F.concat("b.path", F.array("j")).alias("path")))
        found.append(state.withColumn("towers", F.lit(t)))
    if not found:
        return lengths.limit(0).select("route", F.lit(0).alias("towers"), F.lit(0.0).alias("quality"), F.array(F.lit(0)).alias("path"))
    every = reduce(DataFrame.union, found)
    goal = lengths.select(F.col("route").alias("r2"), "last", *(["k"] if "k" in lengths.columns else []))
    ends = every.join(goal, (F.col("route") == F.col("r2")) & (F.col("j") == F.col("last")))
    if "k" in lengths.columns:
        ends = ends.where("towers <= k")
    rank = F.struct((F.col("q") > 0).alias("good"), F.when(F.col("q") > 0, F.lit(0.0)).otherwise(F.col("q")).alias("q"), (-F.col("towers")).alias("t"))
    return ends.groupBy("route").agg(F.max_by(F.struct("towers", "q", "path"), rank).alias("b")).select("route", "b.towers", F.col("b.q").alias("quality"), "b.path")


def segment_budgets(segments: DataFrame, total: int) -> DataFrame:
    """(route, segment, k): a route's towers shared among its segments by length, at least 2, rounded half to even."""
    w = W.partitionBy("route")
    share = F.bround(F.lit(float(total)) * F.col("length") / F.sum("length").over(w)).cast("int")
    return segments.withColumn("k", F.greatest(F.lit(2), share))


def broken_gaps(chain: DataFrame, visible: DataFrame) -> DataFrame:
    """(route, pos, a, b): following cells of a chain (route, pos, cell) that do not see each other.

    ``visible`` holds canonical pairs (lo, hi) that do.
    """
    ahead = chain.withColumn("b", F.lead("cell").over(W.partitionBy("route").orderBy("pos"))).where("b is not null")
    keyed = ahead.select("route", "pos", F.col("cell").alias("a"), "b", F.least("cell", "b").alias("lo"), F.greatest("cell", "b").alias("hi"))
    return keyed.join(visible.select("lo", "hi"), ["lo", "hi"], "left_anti").select("route", "pos", "a", "b")


def gap_candidates(gaps: DataFrame, cells: DataFrame, radius_m: float, most: int = CANDIDATES) -> DataFrame:
    """(route, pos, side, cell, elevation, move_m): for both ends of a gap the highest cells within a radius, at most ``most`` a side."""
    ends = gaps.select("route", "pos", F.explode(F.array(F.struct(F.lit("a").alias("side"), F.col("a").alias("end")), F.struct(F.lit("b").alias("side"), F.col("b").alias("end")))).alias("e")).select("route", "pos", "e.*")
    near = ends.withColumn("resolution", grid.resolution_of(F.col("end"))).withColumn("rings", F.ceil(F.lit(radius_m) / (grid.edge_of(F.col("resolution")) * grid.ROOT3)).cast("int") + 1)
    offered = near.withColumn("cell", F.explode(grid.disk(F.col("end"), F.col("rings"))))
    known = offered.join(cells.select("cell", "elevation"), "cell")
    far = geo.geodesic_m(grid.lat_of(F.col("end")), grid.lon_of(F.col("end")), grid.lat_of(F.col("cell")), grid.lon_of(F.col("cell")))
    rank = F.row_number().over(W.partitionBy("route", "pos", "side").orderBy(F.desc("elevation"), "move_m", "cell"))
    return known.withColumn("move_m", far).where(F.col("move_m") <= radius_m).withColumn("n", rank).where(F.col("n") <= most).select("route", "pos", "side", "cell", "elevation", "move_m")


def repair_choices(candidates: DataFrame, sight: DataFrame) -> DataFrame:
    """(route, pos, a, b, clearance): the best pair of cells for each gap.

    Pairs of one gap's two sides that see each other (``sight``: lo, hi, clearance) compete by
    clearance, then the smaller move, then the higher ground; ties to the smaller cells.
    """
    a = candidates.where("side = 'a'").select("route", "pos", F.col("cell").alias("a"), F.col("elevation").alias("ea"), F.col("move_m").alias("ma"))
    b = candidates.where("side = 'b'").select(F.col("route").alias("r2"), F.col("pos").alias("p2"), F.col("cell").alias("b"), F.col("elevation").alias("eb"), F.col("move_m").alias("mb"))
    pairs = a.join(b, (F.col("route") == F.col("r2")) & (F.col("pos") == F.col("p2"))).where("a != b").withColumn("lo", F.least("a", "b")).withColumn("hi", F.greatest("a", "b"))
    seen = pairs.join(sight.select("lo", "hi", "clearance"), ["lo", "hi"])
    order = F.struct((-F.col("clearance")).alias("c"), (F.col("ma") + F.col("mb")).alias("m"), (-(F.col("ea") + F.col("eb"))).alias("e"), "a", "b")
    return seen.groupBy("route", "pos").agg(F.min_by(F.struct("a", "b", "clearance"), order).alias("x")).select("route", "pos", "x.*")


def repair(chain: list, sees: Callable, candidates: Callable, fixed: set, base_m: float, rounds: int = REPAIR_ROUNDS) -> tuple[list, dict]:
    """Repair the broken gaps of one chain by moving its cells: (chain, round in which each new cell was placed).

    Gaps are mended in order, as each mend changes the chain, and each tries radii of base * round / 2
    before the next one is looked at.  Both ends, moved or not, must see their other neighbour;
    the chain's ends and ``fixed`` cells stay.  ``sees(a, b)`` gives a clearance or None,
    ``candidates(cell, radius)`` the (cell, elevation, move) to try, the cell itself among them.
    """
    chain, placed = list(chain), {}
    broken = [i for i in range(len(chain) - 1) if sees(chain[i], chain[i + 1]) is None]
    for i in broken:
        first, second = chain[i], chain[i + 1]
        stays = i == 0 or first in fixed, i + 2 == len(chain) or second in fixed
        outer = chain[i - 1] if i else None, chain[i + 2] if i + 2 < len(chain) else None
        for r in range(1, rounds + 1):
            sides = []
            for cell, stay, beyond in zip((first, second), stays, outer, strict=True):
                offered = [(cell, 0.0, 0.0)] if stay else sorted(candidates(cell, base_m * r / 2), key=lambda c: (-c[1], c[2], c[0]))[:CANDIDATES]
                sides.append([c for c in offered if beyond is None or sees(beyond, c[0]) is not None])
            pairs = [(sees(a, b), ma + mb, ea + eb, a, b) for a, ea, ma in sides[0] for b, eb, mb in sides[1]]
            seen = [(-clearance, move, -high, a, b) for clearance, move, high, a, b in pairs if clearance is not None]
            if seen:
                *_, chain[i], chain[i + 1] = min(seen)
                placed |= {new: r for old, new in ((first, chain[i]), (second, chain[i + 1])) if new != old and new not in fixed}
                break
    return chain, placed


def _per_route(rows: DataFrame, schema: str, step: Callable[[pd.DataFrame], pd.DataFrame]) -> DataFrame:
    return rows.groupBy("route").applyInPandas(step, schema)


def prune_redundant(chain: DataFrame, visible: DataFrame) -> DataFrame:
    """Chains (route, pos, cell) without the inner cells whose neighbours see each other, from the front."""
    pairs = _chain_pairs(chain, visible)

    def prune(rows: pd.DataFrame) -> pd.DataFrame:
        cells, sees = _unpacked(rows)
        i = 1
        while i < len(cells) - 1:
            if (min(cells[i - 1], cells[i + 1]), max(cells[i - 1], cells[i + 1])) in sees:
                del cells[i]
            else:
                i += 1
        return pd.DataFrame({"route": rows["route"].iloc[0], "pos": range(len(cells)), "cell": cells})

    return _per_route(pairs, "route long, pos int, cell long", prune)


def select_nodes(chain: DataFrame, visible: DataFrame, most: int) -> DataFrame:
    """Chains (route, pos, cell, elevation) cut to at most ``most`` cells.

    The score is elevation / 100 plus the cells of the chain that a cell sees; the lowest inner cell whose
    neighbours see each other goes first, else the lowest at all.  Two or fewer leave the ends.
    """
    pairs = _chain_pairs(chain, visible, ["elevation"])

    def choose(rows: pd.DataFrame) -> pd.DataFrame:
        cells, sees = _unpacked(rows)
        high = dict(zip(rows["cell"], rows["elevation"], strict=True))
        linked = lambda a, b: (min(a, b), max(a, b)) in sees
        if most <= 2 and len(cells) > 2:
            cells = [cells[0], cells[-1]]
        while len(cells) > max(2, most):
            score = {i: (high[cells[i]] / 100 + sum(linked(cells[i], c) for c in cells if c != cells[i]), i) for i in range(1, len(cells) - 1)}
            spare = [i for i in score if linked(cells[i - 1], cells[i + 1])]
            del cells[min(spare or score, key=score.get)]
        return pd.DataFrame({"route": rows["route"].iloc[0], "pos": range(len(cells)), "cell": cells})

    return _per_route(pairs, "route long, pos int, cell long", choose)


def _chain_pairs(chain: DataFrame, visible: DataFrame, more: list[str] | None = None) -> DataFrame:
    """A chain's cells, each with the cells of its route that it sees and are larger."""
    two = chain.select(F.col("route").alias("r2"), F.col("cell").alias("hi"))
    seen = chain.join(two, (F.col("route") == F.col("r2")) & (F.col("cell") < F.col("hi"))).select("route", F.col("cell").alias("lo"), "hi").join(visible.select("lo", "hi"), ["lo", "hi"], "left_semi")
    grouped = seen.groupBy(F.col("route").alias("r3"), F.col("lo").alias("c3")).agg(F.collect_set("hi").alias("sees"))
    joined = chain.join(grouped, (F.col("route") == F.col("r3")) & (F.col("cell") == F.col("c3")), "left")
    return joined.select("route", "pos", "cell", *(more or []), "sees")


def _unpacked(rows: pd.DataFrame) -> tuple[list[int], set[tuple[int, int]]]:
    rows = rows.sort_values("pos")
    sees = {(c, s) for c, many in zip(rows["cell"], rows["sees"], strict=True) if many is not None for s in many}
    return rows["cell"].tolist(), sees


def fill_gaps(chain: DataFrame, corridor: DataFrame, most_m: float) -> DataFrame:
    """Relay cells by distance only: between far neighbours the corridor cell that makes the larger part smallest.

    All gaps of all routes are split at once, and their parts again, until every part is within the limit or has no corridor cell
    left inside; a round halves what is left, more or less.  (route, pos, cell), positions of the corridor.
    """
    far = lambda x, y: geo.geodesic_m(grid.lat_of(x), grid.lon_of(x), grid.lat_of(y), grid.lon_of(y))
    w = W.partitionBy("route").orderBy("pos")
    filled = chain.select("route", "pos", "cell")
    ahead = filled.withColumn("b", F.lead("cell").over(w)).withColumn("to", F.lead("pos").over(w)).where("b is not null")
    open_ = cut(ahead.where(far(F.col("cell"), F.col("b")) > most_m).select(F.col("route").alias("r"), F.col("pos").alias("from"), "to", F.col("cell").alias("a"), "b"))
    while not open_.isEmpty():
        inner = corridor.join(open_, (F.col("route") == F.col("r")) & (F.col("pos") > F.col("from")) & (F.col("pos") < F.col("to")))
        part = F.greatest(far(F.col("a"), F.col("cell")), far(F.col("cell"), F.col("b")))
        best = inner.withColumn("part", part).groupBy("route", "from", "to", "a", "b").agg(F.min_by(F.struct("pos", "cell"), F.struct("part", "pos")).alias("x"))
        relays = cut(best.select("route", "from", "to", "a", "b", "x.pos", "x.cell"))
        filled = cut(filled.union(relays.select("route", "pos", "cell")))
        halves = relays.select("route", F.explode(F.array(F.struct(F.col("from"), F.col("pos").alias("to"), "a", F.col("cell").alias("b")), F.struct(F.col("pos").alias("from"), F.col("to"), F.col("cell").alias("a"), "b"))).alias("h")).select(F.col("route").alias("r"), "h.*")
        open_ = cut(halves.where(far(F.col("a"), F.col("b")) > most_m))
    return filled


def peak_fallback(corridor: DataFrame, k: int) -> DataFrame:
    """The ends of each corridor (route, pos, cell, elevation) and its highest inner cells, k in all, in order of pos."""
    w = W.partitionBy("route")
    ends = corridor.withColumn("end", (F.col("pos") == F.min("pos").over(w)) | (F.col("pos") == F.max("pos").over(w)))
    rank = F.row_number().over(w.orderBy(F.desc("end"), F.desc("elevation"), "pos"))
    return ends.withColumn("n", rank).where((F.col("n") <= k) | F.col("end")).drop("n", "end")


def wire_chain(chain: DataFrame) -> DataFrame:
    """(a, b): pairs of towers that follow each other in a chain (route, pos, id), each pair once; those that see each other become edges."""
    ahead = chain.withColumn("next", F.lead("id").over(W.partitionBy("route").orderBy("pos"))).where("next is not null and next != id")
    return ahead.select(F.least("id", "next").alias("a"), F.greatest("id", "next").alias("b")).distinct()


def sites_by_priority(sites: DataFrame) -> DataFrame:
    """``sites`` with their ``place`` within their priority, from 1, in order of ord."""
    return sites.withColumn("place", F.row_number().over(W.partitionBy("priority").orderBy("ord")))


def priority_links(sites: DataFrame) -> DataFrame:
    """(a, b, level): which sites (id, ord, priority, lat, lon) are to be connected.

    The first level (priority 1, else the lowest) is meshed in full; every site of a later
    level goes to the nearest site of the levels before it, or of its own level before it in order.
    """
    first = sites.agg(F.min("priority").alias("first"))
    ranked = sites.join(F.broadcast(first))
    top = ranked.where("priority = first")
    mesh = top.select(F.col("id").alias("a"), F.col("ord").alias("oa"), F.col("priority").alias("level")).repartition(spatial.spread(sites.sparkSession), "a").join(top.select(F.col("id").alias("b"), F.col("ord").alias("ob")), F.col("oa") < F.col("ob")).select("a", "b", "level")
    # of a level's sites at one place only the first looks about it: the others stand beside an earlier one
    heads = sites.groupBy("lat", "lon", "priority").agg(F.min_by("id", "ord").alias("id"), F.min("ord").alias("ord"))
    before = cut(heads.select("id", "ord", "priority", "lat", "lon"))
    beside = before.select(F.col("lat").alias("__lat"), F.col("lon").alias("__lon"), F.col("priority").alias("__p"), F.col("id").alias("__id"), F.col("ord").alias("__ord"))
    here = (F.col("lat") == F.col("__lat")) & (F.col("lon") == F.col("__lon"))
    rest = ranked.where("priority > first").select("id", "ord", "priority", "lat", "lon")
    behind = here & (F.col("priority") == F.col("__p")) & (F.col("ord") > F.col("__ord"))
    later = rest.join(beside, behind, "left_anti")
    copies = rest.join(beside, behind, "left_semi").join(beside, here & (F.col("__p") <= F.col("priority"))).groupBy(F.col("id").alias("a"), F.col("priority").alias("level")).agg(F.min_by("__id", "__ord").alias("b")).select("a", "b", "level")
    earlier = (F.col("priority2") < F.col("priority1")) | ((F.col("priority2") == F.col("priority1")) & (F.col("ord2") < F.col("ord1")))
    near = spatial.nearest(later, before, allowed=earlier).select(F.col("id1").alias("a"), F.col("id2").alias("b"), F.col("priority1").alias("level"))
    return mesh.union(near).union(copies)
