"""Towers along ready routes: attempts over widening searches, segments at existing towers, repair, pruning.

All routes of a wave are planned together, with one request for line of sight a step.  Routes
whose cells meet are in different waves, in their order, so that later routes reuse the towers of
earlier ones and a plan is the same as if one route after the other had been planned.
"""

from __future__ import annotations

import json
from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from meshwright.config import MeshConfig
from meshwright.functions import geo, grid
from meshwright.operators import adaptive, corridor, dem, los, network, placement, sightbook, spatial, waves
from meshwright.operators.stage import cut
from meshwright.plans import mesh
from meshwright.sources import geojson

#: Canonical pairs (lo, hi) to (lo, hi, clearance, visible).
Sight = Callable[[DataFrame], DataFrame]
#: Canonical pairs (lo, hi) to those that need not be asked for.
Shade = Callable[[DataFrame], DataFrame]
#: Centres (cell) and a radius to (centre, cell): the cells that are searched about them.
Reach = Callable[[DataFrame, float], DataFrame]
#: A chain of nodes: pos is the place in the route's corridor.
CHAIN = "route long, pos int, cell long, algorithm string, dp_steps int, repair_round int"
#: What was searched: by route and attempt, in which phase, about which gap and in which round, how far.
SEARCHED = "route long, cell long, algorithm string, phase string, attempt_id int, gap int, repair_round int, radius_m double, ring int, search_scope string"
#: A city's anchor keeps this many edges away from other towers: 1.2, and the two cells' own.
ANCHOR_EDGES = 3.2


def sight_over(cells: DataFrame, config: MeshConfig, raster: dem.Raster | None = None, book: sightbook.SightBook | None = None, stage: str = "placement") -> Sight:
    """Line of sight between the anchors of cells; with a ``book`` answers of other runs are used, and new ones kept."""

    def ask(pairs: DataFrame) -> DataFrame:
        if book is not None:
            seen = sightbook.batch(pairs.select(F.col("lo").alias("src"), F.col("hi").alias("dst")), cells, config, raster, book, stage).where("status != 'failed'")
            return cut(seen.select("lo", "hi", F.col("clearance_m").alias("clearance"), "visible"))
        seen = los.evaluate(mesh.pair_rows(pairs, cells, config), config, cells.select("cell", "elevation"), raster)
        return cut(seen.select("id.lo", "id.hi", F.col("clearance_m").alias("clearance"), "visible"))

    return ask


def shade_over(cells: DataFrame, config: MeshConfig, raster: dem.Raster | None) -> Shade | None:
    """Pairs whose line the highest pixel beneath it shadows, before sight is asked for; none without a raster."""
    if raster is None:
        return None

    def ask(pairs: DataFrame) -> DataFrame:
        tested = los.shadow_prefilter(mesh.pair_rows(pairs, cells, config), raster, config)
        return tested.where("rejected").select("id.lo", "id.hi")

    return ask


def in_rings(resolution: int) -> Reach:
    """Cells of one resolution, by rings: as many as edges go into the radius."""

    def ask(centres: DataFrame, radius_m: float) -> DataFrame:
        return centres.select(F.col("cell").alias("centre"), F.explode(grid.disk(F.col("cell"), round(radius_m / grid.edge_m(resolution)))).alias("cell"))

    return ask


def in_mesh(cells: DataFrame) -> Reach:
    """Cells of a mesh (cell, lat, lon) of any resolutions, by distance and both cells' edges."""

    def ask(centres: DataFrame, radius_m: float) -> DataFrame:
        return adaptive.near(cells.select("cell", "lat", "lon"), centres.select("cell"), radius_m)

    return ask


def widened(corridors: DataFrame, cells: DataFrame, radius_m: float, config: MeshConfig, reach: Reach | None = None) -> DataFrame:
    """Corridors (route, pos, cell) with the best cell beside each road cell, taken from the cells within a radius that hold no road."""
    if radius_m <= 0 or (reach is None and round(radius_m / grid.edge_m(config.h3_resolution)) <= 0):
        return corridors.select("route", "pos", "cell")
    road = corridor.first_visits(corridors)
    beside = (reach or in_rings(config.h3_resolution))(road.select("cell").distinct(), radius_m)
    around = road.select("route", F.col("cell").alias("centre")).join(beside, "centre").select("route", "cell").distinct().join(road.select("route", "cell"), ["route", "cell"], "left_anti")
    offered = around.join(cells.where("not has_road").select("cell", "lat", "lon", "elevation"), "cell")
    # rings are true to scale about one latitude only; at the equator their cells are a third wider
    most = 1.4 * (radius_m + 3 * grid.edge_m(config.h3_resolution))
    best = corridor.best_buffer_cells(offered, road.join(cells.select("cell", "lat", "lon"), "cell"), most)
    cap = config.dp_buffer_candidates_max_per_segment
    return corridor.inject(corridors.select("route", "pos", "cell"), best, cap)


def segments(corridors: DataFrame, existing: DataFrame) -> DataFrame:
    """(route, segment, pos, at, cell, length, total, anchors): corridors split at cells that have a tower (cell).

    A tower's cell ends one segment and begins the next; ``at`` counts from 0 in the segment.
    """
    w = W.partitionBy("route")
    flagged = corridors.join(existing.select(F.col("cell").alias("__t")).distinct(), F.col("cell") == F.col("__t"), "left").withColumn("has", F.col("__t").isNotNull()).drop("__t")
    rows = flagged.withColumn("last", F.max("pos").over(w))
    rows = rows.withColumn("edge", (F.col("pos") == 0) | (F.col("pos") == F.col("last")) | F.col("has"))
    rows = rows.withColumn("anchors", F.sum((F.col("has") & ((F.col("pos") == 0) | (F.col("pos") == F.col("last")))).cast("int")).over(w))
    rows = rows.withColumn("segment", (F.sum(F.col("edge").cast("int")).over(w.orderBy("pos")) - 1).cast("int"))
    both = rows.where("pos < last").unionByName(rows.where("edge and pos > 0").withColumn("segment", F.col("segment") - 1))
    own = W.partitionBy("route", "segment")
    placed = both.withColumn("at", (F.col("pos") - F.min("pos").over(own)).cast("int"))
    return placed.select("route", "segment", "pos", "at", "cell", F.max("at").over(own).alias("length"), (F.col("last") + 1).alias("total"), "anchors")


def best_chains(split: DataFrame, budgets: DataFrame, cells: DataFrame, config: MeshConfig, sight: Sight, existing: DataFrame, shade: Shade | None = None) -> DataFrame:
    """CHAIN of every route: the max-min path of each segment, or its ends where it has none; repeated cells once."""
    rows = cut(split.join(budgets, "route").join(cells.select("cell", "lat", "lon", "unfit"), "cell").withColumn("key", F.struct("route", "segment")))
    share = F.bround((F.col("budget") + F.col("anchors")) * F.col("length") / F.col("total")).cast("int")
    lengths = rows.groupBy(F.col("key").alias("route")).agg(F.max("at").alias("last"), F.max(F.greatest(F.lit(2), share)).alias("k")).where("last > 0")
    steps = rows.select(F.col("key").alias("route"), F.col("at").alias("pos"), "cell", "lat", "lon", "unfit")
    pairs = placement.prefiltered(placement.forward_pairs(steps, config.max_visibility_m), steps, config).where("reason in ('ask', 'zero')")
    at = steps.select("route", "pos", "cell")
    named = pairs.join(at.select("route", F.col("pos").alias("i"), F.col("cell").alias("src")), ["route", "i"]).join(at.select("route", F.col("pos").alias("j"), F.col("cell").alias("dst")), ["route", "j"])
    asked = cut(named.select("route", "i", "j", "src", "dst"))
    if shade is not None:
        shut = cut(shade(los.canonical(asked).where("lo != hi")))
        asked = cut(asked.join(shut, (F.least("src", "dst") == F.col("lo")) & (F.greatest("src", "dst") == F.col("hi")), "left_anti"))
    edges = los.fan_out(asked, sight(los.canonical(asked)).where("visible")).select("route", "i", "j", "clearance")
    best = cut(placement.best_paths(edges, lengths, F.col("k")))
    chosen = best.select("route", F.explode("path").alias("at"), F.lit("dp").alias("algorithm"), F.col("towers").alias("dp_steps"))
    ends = lengths.join(best.select("route"), "route", "left_anti").select("route", F.explode(F.array(F.lit(0), F.col("last"))).alias("at"), F.lit("endpoint_fallback").alias("algorithm"), F.lit(None).cast("int").alias("dp_steps"))
    nodes = chosen.union(ends).join(rows.select(F.col("key").alias("route"), F.col("at"), "pos", "cell"), ["route", "at"])
    first = nodes.select("route.route", "route.segment", "pos", "cell", "algorithm", "dp_steps").groupBy("route", "cell").agg(F.min_by(F.struct("pos", "algorithm", "dp_steps"), F.struct("segment", "pos")).alias("n"))
    standing = existing.select(F.col("cell").alias("__t")).distinct()
    known = first.join(standing, F.col("cell") == F.col("__t"), "left")
    fresh = lambda c: F.when(F.col("__t").isNull(), F.col(f"n.{c}")).alias(c)
    return cut(known.select("route", "n.pos", "cell", fresh("algorithm"), fresh("dp_steps"), F.lit(None).cast("int").alias("repair_round")))


def following(chains: DataFrame) -> DataFrame:
    """(route, pos, src, dst): neighbours in a chain."""
    ahead = chains.withColumn("dst", F.lead("cell").over(W.partitionBy("route").orderBy("pos"))).where("dst is not null")
    return ahead.select("route", "pos", F.col("cell").alias("src"), "dst")


def broken_routes(chains: DataFrame, sight: Sight) -> DataFrame:
    """(route, pos, a, b): neighbours without sight."""
    seen = sight(los.canonical(following(chains)))
    return cut(placement.broken_gaps(chains, seen.where("visible")))


def repaired(chains: DataFrame, broken: DataFrame, cells: DataFrame, existing: DataFrame, config: MeshConfig, base_m: float, sight: Sight, reach: Reach | None = None, searched: Callable[[DataFrame], None] | None = None) -> DataFrame:
    """Chains whose broken gaps are mended by moving the nodes beside them, no farther than the last round's radius from their first place.

    Each node beside a gap has a pool of the highest cells around it; sight is asked for between the pools of
    neighbours, and the mending itself goes through one chain after the other, an Arrow group a route.
    """
    w = W.partitionBy("route")
    order = chains.withColumn("n", F.row_number().over(w.orderBy("pos"))).withColumn("of", F.count(F.lit(1)).over(w))
    gaps = broken.select(F.col("route").alias("gr"), F.col("a").alias("ga")).union(broken.select("route", "b")).distinct()
    standing = existing.select(F.col("cell").alias("__t")).distinct()
    movable = order.where("n > 1 and n < of").join(gaps, (F.col("route") == F.col("gr")) & (F.col("cell") == F.col("ga")), "left_semi").join(standing, F.col("cell") == F.col("__t"), "left_anti")
    most = base_m * placement.REPAIR_ROUNDS / 2
    free = cells.where("not unfit").select(F.col("cell").alias("to"), "elevation")
    if reach is None:
        rings = grid.rings_covering(most, config.h3_resolution)
        near = movable.select("route", "n", "cell", F.explode(grid.disk(F.col("cell"), rings)).alias("to"))
        slack = F.lit(0.0)
    else:
        near = movable.join(reach(movable.select("cell").distinct(), most).select("centre", F.col("cell").alias("to")), F.col("cell") == F.col("centre")).select("route", "n", "cell", "to")
        slack = grid.edge_of(grid.resolution_of(F.col("cell"))) + grid.edge_of(grid.resolution_of(F.col("to")))
    near = near.join(free, "to").select("route", "n", "cell", "to", "elevation")
    near = near.union(movable.join(cells.select(F.col("cell").alias("own"), "elevation"), F.col("cell") == F.col("own")).select("route", "n", "cell", F.col("cell").alias("to"), "elevation")).distinct()
    far = geo.geodesic_m(grid.lat_of(F.col("cell")), grid.lon_of(F.col("cell")), grid.lat_of(F.col("to")), grid.lon_of(F.col("to")))
    # a cell's own edge counts for a mesh: what a radius touches is tried
    offered = near.withColumn("move", far).withColumn("least", F.greatest(F.lit(0.0), F.col("move") - slack))
    kept = None
    for r in range(1, placement.REPAIR_ROUNDS + 1):
        inside = offered.where(F.col("least") <= base_m * r / 2)
        rank = F.row_number().over(W.partitionBy("route", "n").orderBy(F.desc("elevation"), "move", "to"))
        part = inside.withColumn("rank", rank).where(F.col("rank") <= placement.CANDIDATES).drop("rank").withColumn("round", F.lit(r))
        kept = part if kept is None else kept.union(part)
    pool = cut(kept.groupBy("route", "n", "cell", "to", "elevation", "move", "least").agg(F.min("round").alias("round")))
    if searched is not None:
        searched(pool.select("route", F.col("to").alias("cell"), F.lit("gap_repair").alias("phase"), (F.col("n") - 1).cast("int").alias("gap"), F.col("round").alias("repair_round"), (F.col("round") * base_m / 2).alias("radius_m"), F.lit("gap_repair_subcorridor").alias("search_scope")))
    places = pool.select("route", "n", "to").union(order.select("route", "n", F.col("cell").alias("to")))
    ahead = places.select(F.col("route").alias("r2"), (F.col("n") - 1).alias("n2"), F.col("to").alias("dst"))
    asked = places.join(ahead, (F.col("route") == F.col("r2")) & (F.col("n") == F.col("n2"))).where("to != dst").select("route", F.col("to").alias("src"), "dst").distinct()
    asked = cut(asked.join(broken.select(F.col("route").alias("br")).distinct(), F.col("route") == F.col("br"), "left_semi"))
    seen = los.fan_out(asked, sight(los.canonical(asked)).where("visible"))
    null = lambda kind: F.lit(None).cast(kind)
    none = F.lit(0).cast("long")  # a null would make cell ids floating-point numbers
    rows = order.select("route", F.lit("node").alias("kind"), "pos", "cell", none.alias("other"), null("double").alias("value"), null("double").alias("move"), "algorithm", "dp_steps", "repair_round")
    rows = rows.union(pool.select("route", F.lit("pool"), null("int"), "cell", "to", "elevation", "move", F.col("least").cast("string"), null("int"), null("int")))
    rows = rows.union(seen.select("route", F.lit("sight"), null("int"), "lo", "hi", "clearance", null("double"), null("string"), null("int"), null("int")))
    rows = rows.union(order.join(standing, F.col("cell") == F.col("__t"), "left_semi").select("route", F.lit("fixed"), null("int"), "cell", none, null("double"), null("double"), null("string"), null("int"), null("int")))
    touched = rows.join(broken.select(F.col("route").alias("br")).distinct(), F.col("route") == F.col("br"), "left_semi")

    def mend(group: pd.DataFrame) -> pd.DataFrame:
        nodes = group[group.kind == "node"].sort_values("pos")
        clear = {(int(a), int(b)): c for a, b, c in group[group.kind == "sight"][["cell", "other", "value"]].itertuples(index=False)}
        pools: dict[int, list[tuple[int, float, float, float]]] = {}
        home: dict[int, int] = {}
        for cell, to, high, move, least in group[group.kind == "pool"][["cell", "other", "value", "move", "algorithm"]].itertuples(index=False):
            pools.setdefault(int(cell), []).append((int(to), high, move, float(least)))
            if to != cell:
                home.setdefault(int(to), int(cell))
        before = [int(c) for c in nodes.cell]
        fixed = {int(c) for c in group[group.kind == "fixed"].cell}
        sees = lambda a, b: config.mast_height_m if a == b else clear.get((min(a, b), max(a, b)))
        near = lambda cell, radius: [c[:3] for c in pools.get(cell, pools.get(home.get(cell, -1), [])) if c[3] <= radius]
        after, rounds = placement.repair(before, sees, near, fixed, base_m)
        moved = [a != b for a, b in zip(before, after, strict=True)]
        out = pd.DataFrame({"route": nodes.route.to_numpy(), "pos": nodes.pos.astype(int).to_numpy(), "cell": after})
        out["algorithm"] = ["dp_repair" if m else a for m, a in zip(moved, nodes.algorithm, strict=True)]
        out["dp_steps"] = [None if m or pd.isna(s) else int(s) for m, s in zip(moved, nodes.dp_steps, strict=True)]
        out["repair_round"] = [rounds.get(a) if m else None for a, m in zip(after, moved, strict=True)]
        return out.astype({"dp_steps": "Int64", "repair_round": "Int64"})

    mended = touched.groupBy("route").applyInPandas(mend, CHAIN)
    whole = chains.join(broken.select(F.col("route").alias("br")).distinct(), F.col("route") == F.col("br"), "left_anti")
    return cut(whole.select("route", "pos", "cell", "algorithm", "dp_steps", "repair_round").union(mended))


def without_lost_ends(chains: DataFrame, sight: Sight) -> DataFrame:
    """Chains without the inner nodes that only stand for a segment without a path and see no neighbour, until that changes nothing."""
    two = chains.select(F.col("route").alias("r2"), F.col("cell").alias("dst"))
    pairs = cut(chains.join(two, (F.col("route") == F.col("r2")) & (F.col("cell") < F.col("dst"))).select("route", F.col("cell").alias("src"), "dst"))
    seen = los.fan_out(pairs, sight(los.canonical(pairs)).where("visible")).groupBy(F.col("route").alias("sr"), F.col("src").alias("sc")).agg(F.collect_set("dst").alias("sees"))
    joined = chains.join(seen, (F.col("route") == F.col("sr")) & (F.col("cell") == F.col("sc")), "left").drop("sr", "sc")

    def prune(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("pos").reset_index(drop=True)
        sees = {(int(c), int(s)) for c, many in zip(rows.cell, rows.sees, strict=True) if many is not None for s in many}
        while len(rows) >= 2:
            cells = [int(c) for c in rows.cell]
            gaps = [i for i in range(len(cells) - 1) if (min(cells[i : i + 2]), max(cells[i : i + 2])) not in sees]
            lost = {j for i in gaps for j in (i, i + 1) if 0 < j < len(cells) - 1 and rows.algorithm[j] == "endpoint_fallback"}
            if not lost:
                break
            rows = rows.drop(index=list(lost)).reset_index(drop=True)
        return rows.drop(columns="sees").astype({"dp_steps": "Int64", "repair_round": "Int64"})

    return cut(joined.groupBy("route").applyInPandas(prune, CHAIN))


def place_along(corridors: DataFrame, budgets: DataFrame, cells: DataFrame, existing: DataFrame, config: MeshConfig, sight: Sight, reach: Reach | None = None, records: list[DataFrame] | None = None, shade: Shade | None = None) -> DataFrame:
    """CHAIN of every corridor (route, pos, cell) of two or more cells.

    ``budgets`` (route, budget) bound the towers of a route, ``existing`` (cell) are towers to be
    reused, ``cells`` have cell, lat, lon, elevation, has_road, unfit; ``reach`` finds the cells beside others, by rings if there is none.  The first attempt searches beside the road as far as the
    optimizer's radius (else the road buffer); routes with broken links try again with each
    larger radius of the fallback ladder, and at last lose the ends that nothing reaches.
    ``records`` receives what was searched (SEARCHED), as tables; pairs that ``shade`` finds hidden are not asked for.
    """
    first = config.optimizer_search_radius_m if config.optimizer_search_radius_m is not None else config.road_buffer_m
    first = max(0.0, float(first))
    ladder = [first, *(float(x) for x in config.fallback_initial_search_radius_ladder_m if float(x) > first)]
    two = corridors.groupBy("route").count().where("count > 1").select("route")
    left = cut(corridors.join(two, "route", "left_semi").select("route", "pos", "cell"))
    done: DataFrame | None = None
    for i, radius in enumerate(ladder):
        work = cut(widened(left, cells, radius, config, reach))

        def note(rows: DataFrame, attempt: int = i + 1) -> None:
            if records is not None:
                ring = F.round(F.col("radius_m") / grid.edge_m(config.h3_resolution)).cast("int")
                told = rows.withColumn("algorithm", F.lit("dp")).withColumn("attempt_id", F.lit(attempt)).withColumn("ring", ring)
                records.append(cut(told.select(*[x.split()[0] for x in SEARCHED.split(", ")])))

        note(work.select("route", "cell", F.lit("placement").alias("phase"), F.lit(None).cast("int").alias("gap"), F.lit(None).cast("int").alias("repair_round"), F.lit(radius).alias("radius_m"), F.lit("corridor").alias("search_scope")))
        chains = best_chains(segments(work, existing), budgets, cells, config, sight, existing, shade)
        if config.gap_repair_rounds > 0:
            broken = broken_routes(chains, sight)
            base = config.road_buffer_m if config.road_buffer_m > 0 else radius
            if base > 0 and not broken.isEmpty():
                chains = repaired(chains, broken, cells, existing, config, base, sight, reach, note)
        filled = placement.fill_gaps(chains.select("route", "pos", "cell"), work, config.max_visibility_m)
        meta = chains.select(F.col("route").alias("cr"), F.col("cell").alias("cc"), "algorithm", "dp_steps", "repair_round")
        chains = cut(filled.join(meta, (F.col("route") == F.col("cr")) & (F.col("cell") == F.col("cc")), "left").select("route", F.col("pos").cast("int").alias("pos"), "cell", "algorithm", "dp_steps", "repair_round"))
        bad = cut(broken_routes(chains, sight).select("route").distinct())
        good = chains.join(bad, "route", "left_anti")
        done = good if done is None else done.unionByName(good)
        if bad.isEmpty():
            return cut(done)
        if i == len(ladder) - 1:
            return cut(done.unionByName(without_lost_ends(chains.join(bad, "route", "left_semi").select(*chains.columns), sight)))
        left = cut(left.join(bad, "route", "left_semi"))
    return done


def sampled_corridors(routes: DataFrame, resolution: int) -> DataFrame:
    """(route, pos, cell) of routes (route, site1, site2, features): their lines head to tail from the first site, sampled into cells.

    A MultiLineString is one feature: its first line's ends place it among the others, its lines follow each other, in reverse
    order where it is turned.  Features of other kinds, or without a line, are left out.
    """
    kind, text = F.col("f.geometry.type"), F.col("f.geometry.coordinates")
    lines = F.when(kind == "LineString", F.array(F.from_json(text, "array<array<double>>"))).when(kind == "MultiLineString", F.from_json(text, "array<array<array<double>>>"))
    features = routes.select("route", "site1", F.posexplode("features").alias("feature", "f")).select("route", F.col("feature").cast("long").alias("feature"), "site1", lines.alias("lines"), (kind == "MultiLineString").alias("many"))
    features = features.where("size(get(lines, 0)) > 1")
    end = lambda part, i: [F.element_at(F.element_at(F.element_at("lines", part), i), k) for k in (2, 1)]
    (lat1, lon1), (lat2, lon2) = end(1, 1), end(1, -1)
    # the end at which a turned feature is left
    tail = [F.when(F.col("many"), a).otherwise(b) for a, b in zip(end(-1, -1), end(1, 1), strict=True)]
    ordered = corridor.order_features(features.select("route", "feature", lat1.alias("lat1"), lon1.alias("lon1"), lat2.alias("lat2"), lon2.alias("lon2"), tail[0].alias("tlat"), tail[1].alias("tlon"), F.col("site1.lat").alias("slat"), F.col("site1.lon").alias("slon")))
    turned = features.join(ordered.select(F.col("route").alias("r2"), F.col("feature").alias("f2"), "ord", "flip"), (F.col("route") == F.col("r2")) & (F.col("feature") == F.col("f2")))
    whole = F.when(~F.col("flip"), F.col("lines")).when(F.col("many"), F.reverse("lines")).otherwise(F.transform("lines", F.reverse))
    parts = turned.select("route", "ord", F.posexplode(whole).alias("part", "line"))
    points = parts.select("route", "ord", "part", F.posexplode("line").alias("seq", "p"))
    vertices = points.select(F.struct("route", "ord", "part").alias("line"), "seq", F.element_at("p", 1).alias("lon"), F.element_at("p", 2).alias("lat"))
    samples = corridor.segment_cells(vertices, resolution).select("line.route", "line.ord", "line.part", "seq", "i", "cell")
    return corridor.without_repeats(samples, ["ord", "part", "seq", "i"])


def site_cells(routes: DataFrame, members: DataFrame, base: int, fine: int) -> DataFrame:
    """(route, side, cell): the finest member (cell, resolution) that holds each site with a place, else its base cell."""
    sites = routes.select("route", F.posexplode(F.array("site1", "site2")).alias("side", "s")).where("s.lat is not null and s.lon is not null")
    found = adaptive.locate(sites.select(F.struct("route", "side").alias("id"), F.col("s.lat").alias("lat"), F.col("s.lon").alias("lon")), members, base, fine)
    return found.select("id.route", "id.side", "cell")


def mesh_corridors(routes: DataFrame, members: DataFrame, base: int, fine: int, available: int) -> DataFrame:
    """(route, pos, cell): roads sampled at the finest resolution there is, put onto the mesh's road cells, with the sites' cells at the ends."""
    samples = sampled_corridors(routes, available).withColumn("lat", grid.lat_of(F.col("cell"))).withColumn("lon", grid.lon_of(F.col("cell"))).drop("cell")
    found = adaptive.project(samples, members, base, fine, ["pos"])
    spots = site_cells(routes, members, base, fine).groupBy("route").agg(F.max(F.when(F.col("side") == 0, F.col("cell"))).alias("first"), F.max(F.when(F.col("side") == 1, F.col("cell"))).alias("last"))
    return corridor.with_ends(found, spots)


def with_unknown(cells: DataFrame, wanted: DataFrame, config: MeshConfig, raster: dem.Raster | None, cities: DataFrame | None) -> DataFrame:
    """Cells with those of ``wanted`` (cell, has_road) that they lack, at their anchors in the raster (without one at no height, at their centres)."""
    missing = cut(wanted.groupBy("cell").agg(F.bool_or("has_road").alias("has_road")).join(cells.select("cell"), "cell", "left_anti"))
    if missing.isEmpty():
        return cells
    if raster is not None:
        placed = None
        for (resolution,) in missing.select(grid.resolution_of(F.col("cell"))).distinct().collect():  # at most 16
            part = dem.anchors(missing.where(grid.resolution_of(F.col("cell")) == resolution).select("cell"), raster, resolution, config.cell_anchor_margin_m)
            placed = part if placed is None else placed.unionByName(part)
    else:
        placed = missing.select("cell", F.lit(0.0).alias("elevation"), grid.lat_of(F.col("cell")).alias("los_lat"), grid.lon_of(F.col("cell")).alias("los_lon"))
    made = missing.join(placed, "cell").withColumn("lat", grid.lat_of(F.col("cell"))).withColumn("lon", grid.lon_of(F.col("cell")))
    return cut(cells.select("cell", "lat", "lon", "elevation", "los_lat", "los_lon", "has_road", "unfit").unionByName(mesh.marked(made, cities).select("cell", "lat", "lon", "elevation", "los_lat", "los_lon", "has_road", "unfit")))


def route_claims(paths: DataFrame, anchors: DataFrame, reach: Reach, config: MeshConfig) -> DataFrame:
    """(route, cell): all cells that planning a corridor (route, pos, cell) with its anchors (route, cell) may read or put a tower on."""
    search = max([config.road_buffer_m, config.optimizer_search_radius_m or 0.0, *config.fallback_initial_search_radius_ladder_m])
    repair = (config.road_buffer_m if config.road_buffer_m > 0 else search) * placement.REPAIR_ROUNDS / 2
    own = paths.select("route", "cell").union(anchors.select("route", "cell")).distinct()
    beside = reach(own.select("cell").distinct(), max(search, repair, ANCHOR_EDGES * grid.edge_m(config.h3_resolution)))
    return own.select("route", F.col("cell").alias("centre")).join(beside, "centre").select("route", "cell").union(own)


def site_anchors(routes: DataFrame, paths: DataFrame, spots: DataFrame, cities: DataFrame | None) -> DataFrame:
    """(route, side, cell, height, city): where the sites of routes get their towers.

    A site inside a city has its anchor where the trimmed corridor enters the city: at the corridor's end on
    the site's side.  Any other has it in its own cell (``spots``: route, side, cell).  Sites without a place have none.
    """
    sites = routes.select("route", F.posexplode(F.array("site1", "site2")).alias("side", "s")).where("s.lat is not null and s.lon is not null")
    rows = sites.select("route", "side", F.struct("route", "side").alias("id"), F.col("s.lat").alias("lat"), F.col("s.lon").alias("lon"), F.coalesce("s.site_height_m", F.lit(0.0)).alias("height"))
    rows = spatial.within_polygons(rows, cities).withColumnRenamed("inside", "city") if cities is not None else rows.withColumn("city", F.lit(False))
    ends = paths.groupBy(F.col("route").alias("er")).agg(F.min_by("cell", "pos").alias("first"), F.max_by("cell", "pos").alias("last"))
    entry = F.when(F.col("side") == 0, F.col("first")).otherwise(F.col("last"))
    placed = rows.join(ends, F.col("route") == F.col("er")).join(spots.select(F.col("route").alias("sr"), F.col("side").alias("ss"), F.col("cell").alias("own")), (F.col("route") == F.col("sr")) & (F.col("side") == F.col("ss")))
    return placed.select("route", "side", F.when(F.col("city"), entry).otherwise(F.col("own")).alias("cell"), "height", "city")


def anchored(anchors: DataFrame, towers: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(towers, heights): towers with those of anchors (route, side, cell, height, city), and the extra height (cell, height) each anchor gives to a cell.

    Anchors come in order of route and side.  A city's anchor is left out where a tower stands near it already, and that tower
    gets its height; all others are placed.
    """
    points = anchors.select((F.col("route") * 2 + F.col("side")).alias("id"), "cell", "height", "city", "route", "side").withColumn("ord", F.col("id"))
    placed = points.withColumn("lat", grid.lat_of(F.col("cell"))).withColumn("lon", grid.lon_of(F.col("cell")))
    edge = grid.edge_of(grid.resolution_of(F.col("cell")))
    stood = cut(towers.select(F.col("cell").alias("id"), grid.lat_of(F.col("cell")).alias("lat"), grid.lon_of(F.col("cell")).alias("lon"), edge.alias("size")))
    placed = cut(placed.select("id", "ord", "lat", "lon", (~F.col("city")).alias("fixed"), (edge * (ANCHOR_EDGES - 1)).alias("reach"), edge.alias("size")))
    widest = placed.select("size").union(stood.select("size")).agg(F.max("size")).first()[0] or 1.0
    fit = waves.first_fit(placed, ANCHOR_EDGES * widest, stood)
    judged = cut(points.join(fit, "id"))
    kept = judged.where("kept")
    fresh = kept.select("cell", F.lit("site").alias("source"), "route", F.lit(0).alias("step"), F.col("side").cast("long").alias("pos"))
    to = judged.where("not kept").join(points.select(F.col("id").alias("pid"), F.col("cell").alias("near")), F.col("by") == F.col("pid"), "left")
    # ``by`` is the id of an anchor, or the cell of a standing tower
    heights = kept.select("cell", "height").union(to.select(F.coalesce("near", "by").alias("cell"), "height"))
    return cut(network.place_towers(towers, fresh)), cut(heights)


def run_routes(spark: SparkSession, routes: DataFrame, cells: DataFrame, config: MeshConfig, raster: dem.Raster | None = None, cities: DataFrame | None = None, existing: DataFrame | None = None, finest: int | None = None, book: sightbook.SightBook | None = None) -> dict[str, DataFrame]:
    """cells, corridors, chains, towers, edges, clusters, coverage, city links, summaries and report of ready routes (ord, route_id, site1, site2, max_towers, features).

    ``cells`` have cell, lat, lon, elevation, los_lat, los_lon, has_road, unfit, and may be of several resolutions (``adaptive.from_static``): roads
    are then sampled at the ``finest`` resolution and put onto the mesh.  Cells that a corridor needs and that are not among them are
    made from the raster.  ``existing`` (cell, source, ord) are towers that stand already.  Each route's sites get their anchors first, then its corridor its
    nodes, whose source is the route's id.  Routes that do not meet are planned together.  A ``book`` keeps answers about sight between runs.
    """
    named = F.coalesce(F.col("route_id") if "route_id" in routes.columns else F.lit(None).cast("string"), F.concat(F.lit("route_"), F.col("ord")))
    routes = cut(routes.withColumn("route", F.col("ord").cast("long")).withColumn("name", named))
    base = config.h3_resolution
    members = cut(cells.select("cell", grid.resolution_of(F.col("cell")).alias("resolution"), "has_road"))
    fine = max(base, members.agg(F.max("resolution")).first()[0] or base)
    roads = members.where("has_road")
    spots = cut(site_cells(routes, members, base, fine))
    full = cut(mesh_corridors(routes, roads, base, fine, max(fine, finest or base)) if config.auto_refine_h3_on_gradient else sampled_corridors(routes, base))
    reach = in_mesh(cells.select("cell", "lat", "lon"))
    cells = with_unknown(cells, full.select("cell", F.lit(True).alias("has_road")).union(spots.select("cell", F.lit(False))), config, raster, cities)
    known = full.join(cells.select("cell", (~F.col("unfit")).alias("fit")), "cell")
    trimmed = corridor.first_visits(corridor.trim_unfit(known.select("route", "pos", "cell", "fit")).select("route", "pos", "cell"))
    long = trimmed.groupBy("route").count().where("count > 1").select("route")
    paths = cut(trimmed.join(long, "route", "left_semi"))
    anchors = cut(site_anchors(routes, paths, spots, cities))
    order = cut(waves.waves(route_claims(paths, anchors, reach, config)))
    towers = mesh.standing(spark, existing)
    heights = spark.createDataFrame([], "cell long, height double")
    budgets = routes.select("route", F.coalesce("max_towers", F.lit(config.max_towers_per_route)).alias("budget"))
    chains = spark.createDataFrame([], CHAIN)
    records: list[DataFrame] = []
    for (wave,) in order.select("wave").distinct().orderBy("wave").collect():  # one row a wave
        mine = cut(order.where(F.col("wave") == wave).select("route"))
        towers, more = anchored(anchors.join(mine, "route", "left_semi"), towers)
        heights = cut(heights.union(more).groupBy("cell").agg(F.max("height").alias("height")))
        standing = cut(mesh.raised(cells, heights))
        found = place_along(paths.join(mine, "route", "left_semi"), budgets, standing, towers.select("cell"), config, sight_over(standing, config, raster, book), reach, records, shade_over(standing, config, raster))
        fresh = found.join(routes.select("route", F.col("name").alias("source")), "route").select("cell", "source", "route", F.lit(1).alias("step"), F.col("pos").cast("long").alias("pos"))
        towers = cut(network.place_towers(towers, fresh))
        chains = cut(chains.unionByName(found))
    cells = cut(mesh.raised(cells, heights))
    new = towers.where("step = 1").groupBy("route").agg(F.count(F.lit(1)).alias("towers_new"))
    placed = chains.groupBy("route").agg(F.countDistinct("cell").alias("nodes"))
    sampled = full.groupBy("route").agg(F.count(F.lit(1)).alias("corridor_cells"))
    zero = lambda c: F.coalesce(c, F.lit(0))
    summaries = routes.select("route", "name").join(sampled, "route", "left").join(placed, "route", "left").join(new, "route", "left").join(order, "route", "left")
    summaries = summaries.select("route", F.col("name").alias("route_id"), zero("corridor_cells").alias("corridor_cells"), zero("towers_new").alias("towers_new"), (zero("nodes") - zero("towers_new")).alias("towers_reused"), F.col("nodes").isNull().alias("skipped"), "wave")
    search = spark.createDataFrame([], SEARCHED)
    for part in records:
        search = search.unionByName(part)
    return {"cells": cells, "sampled": full, "corridors": paths, "anchors": anchors, "chains": chains, "routes": summaries, "search": search} | mesh.assembled(towers, chains, cells, config, raster, cities)


def snapshots(made: dict[str, DataFrame]) -> DataFrame:
    """(route_id, snapshot): one JSON text a route: its corridor as sampled and as trimmed, its anchors, its nodes and what was searched for them."""
    by = lambda df, name, *columns: df.groupBy(F.col("route").alias(f"r_{name}")).agg(F.array_sort(F.collect_list(F.struct(*columns))).alias(name))
    out = made["routes"]
    for part in (
        by(made["sampled"], "corridor", "pos", "cell"),
        by(made["corridors"], "trimmed_corridor", "pos", "cell"),
        by(made["anchors"], "anchors", "side", "cell", "city", "height"),
        by(made["chains"], "placement", "pos", "cell", "algorithm", "dp_steps", "repair_round"),
        by(made["search"].distinct(), "search_hexes", "attempt_id", "phase", "gap", "repair_round", "cell", "radius_m", "ring"),
    ):
        key = part.columns[0]
        out = out.join(part, F.col("route") == F.col(key), "left").drop(key)
    return out.select("route_id", F.to_json(F.struct(*[c for c in out.columns if c != "route"]), {"ignoreNullFields": "false"}).alias("snapshot"))


def write_snapshots(made: dict[str, DataFrame], folder: str) -> None:
    """The snapshots of all routes in one write, a folder a route."""
    snapshots(made).withColumnRenamed("snapshot", "value").write.mode("overwrite").partitionBy("route_id").text(folder)


def load(spark: SparkSession, path: str) -> tuple[MeshConfig, DataFrame]:
    """The parameters and routes of a routes file; a file without routes is an error."""
    given = {}
    for name, value in geojson.load_route_parameters(spark, path).items():
        default = getattr(MeshConfig, name, None)
        if isinstance(default, tuple):
            given[name] = tuple(float(x) for x in json.loads(value))
            continue
        given[name] = value.lower() == "true" if isinstance(default, bool) else int(float(value)) if isinstance(default, int) else float(value) if isinstance(default, float) or default is None else value
    routes = geojson.load_routes(spark, path)
    if routes.isEmpty():
        raise ValueError(f"{path} holds no routes")
    return MeshConfig.of(given), routes
