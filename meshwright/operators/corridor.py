"""Roads to corridors: sampling lines into cells, ordering features, trimming and snapping."""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from meshwright.functions import geo, grid
from meshwright.operators import spatial


def line_cells(vertices: DataFrame, resolution: int) -> DataFrame:
    """(line, i, cell): samples along whole lines (line, seq, lon, lat), half an edge apart in degrees; lines of no length give none."""
    order = W.partitionBy("line").orderBy("seq")
    spans = vertices.withColumn("lon2", F.lead("lon").over(order)).withColumn("lat2", F.lead("lat").over(order)).where("lon2 is not null")
    size = F.sqrt((F.col("lon2") - F.col("lon")) * (F.col("lon2") - F.col("lon")) + (F.col("lat2") - F.col("lat")) * (F.col("lat2") - F.col("lat")))
    spans = spans.withColumn("size", size).withColumn("end", F.sum("size").over(order.rowsBetween(W.unboundedPreceding, 0)))
    spans = spans.withColumn("begin", F.col("end") - F.col("size")).withColumn("total", F.sum("size").over(W.partitionBy("line")))
    spacing = grid.edge_m(resolution) / 2 / geo.METRES_PER_DEGREE
    n = F.greatest(F.floor(F.col("total") / spacing).cast("int") + 1, F.lit(2))
    step = F.col("total") / (F.col("n") - 1)
    own = spans.where("total > 0 and size > 0").withColumn("n", n).withColumn("step", step)
    first = F.ceil(F.col("begin") / F.col("step") - 1e-9).cast("int")
    last = F.when(F.col("end") >= F.col("total") - 1e-12, F.col("n") - 1).otherwise(F.ceil(F.col("end") / F.col("step") - 1e-9).cast("int") - 1)
    points = own.withColumn("first", first).withColumn("last", last).where("last >= first").withColumn("i", F.explode(F.sequence("first", "last")))
    t = F.greatest(F.lit(0.0), F.least(F.lit(1.0), (F.col("i") * F.col("step") - F.col("begin")) / F.col("size")))
    return points.select("line", "i", grid.cell_of(F.col("lat") + (F.col("lat2") - F.col("lat")) * t, F.col("lon") + (F.col("lon2") - F.col("lon")) * t, resolution).alias("cell"))


def segment_cells(vertices: DataFrame, resolution: int, group: str = "line") -> DataFrame:
    """(group, seq, i, cell): samples along every segment by itself, ends included."""
    order = W.partitionBy(group).orderBy("seq")
    spans = vertices.withColumn("lon2", F.lead("lon").over(order)).withColumn("lat2", F.lead("lat").over(order)).where("lon2 is not null")
    size = F.sqrt((F.col("lon2") - F.col("lon")) * (F.col("lon2") - F.col("lon")) + (F.col("lat2") - F.col("lat")) * (F.col("lat2") - F.col("lat")))
    n = F.greatest(F.floor(size / (grid.edge_m(resolution) / 2 / geo.METRES_PER_DEGREE)).cast("int") + 1, F.lit(2))
    points = spans.withColumn("n", n).withColumn("i", F.explode(F.sequence(F.lit(0), F.col("n") - 1)))
    t = F.col("i") / (F.col("n") - 1)
    return points.select(group, "seq", "i", grid.cell_of(F.col("lat") + (F.col("lat2") - F.col("lat")) * t, F.col("lon") + (F.col("lon2") - F.col("lon")) * t, resolution).alias("cell"))


def without_repeats(samples: DataFrame, order: list[str], group: str = "route") -> DataFrame:
    """(route, pos, cell): consecutive repeats removed, positions from 0."""
    w = W.partitionBy(group).orderBy(*order)
    changed = samples.withColumn("__before", F.lag("cell").over(w)).where(F.col("__before").isNull() | (F.col("__before") != F.col("cell")))
    return changed.withColumn("pos", (F.row_number().over(w) - 1).cast("int")).select(group, "pos", "cell")


def first_visits(corridor: DataFrame, group: str = "route") -> DataFrame:
    """(route, pos, cell): only the first visit of each cell, positions anew from 0."""
    first = corridor.groupBy(group, "cell").agg(F.min("pos").alias("at"))
    return first.withColumn("pos", (F.row_number().over(W.partitionBy(group).orderBy("at")) - 1).cast("int")).select(group, "pos", "cell")


def with_ends(corridor: DataFrame, ends: DataFrame) -> DataFrame:
    """Corridors with their sites' cells (route, first, last) put before and after, where they are not the ends already."""
    w = W.partitionBy("route")
    edge = corridor.withColumn("lo", F.min("pos").over(w)).withColumn("hi", F.max("pos").over(w)).join(ends, "route")
    head = edge.where((F.col("pos") == F.col("lo")) & (F.col("cell") != F.col("first"))).select("route", (F.col("lo") - 1).alias("pos"), F.col("first").alias("cell"))
    tail = edge.where((F.col("pos") == F.col("hi")) & (F.col("cell") != F.col("last"))).select("route", (F.col("hi") + 1).alias("pos"), F.col("last").alias("cell"))
    rows = corridor.select("route", "pos", "cell").union(head).union(tail)
    return rows.withColumn("pos", (F.row_number().over(W.partitionBy("route").orderBy("pos")) - 1).cast("int"))


def order_features(features: DataFrame) -> DataFrame:
    """(route, feature, ord, flip): greedy head-to-tail order from the route's start.

    ``features`` have route, feature, lat1, lon1, lat2, lon2 (their ends) and slat, slon
    (the start), and may have tlat, tlon (where a turned feature is left, if not at its first end).  The nearest end of the features left comes next, flipped where it is
    its tail; the first wins ties.  Inherently sequential in a route, so one Arrow group a route.
    """

    def stitch(rows: pd.DataFrame) -> pd.DataFrame:
        def far(a: tuple[float, float], b: tuple[float, float]) -> float:
            p, q = math.radians(a[0]), math.radians(b[0])
            h = math.sin((q - p) / 2) ** 2 + math.cos(p) * math.cos(q) * math.sin(math.radians(b[1] - a[1]) / 2) ** 2
            return 2 * geo.EARTH_RADIUS_M * math.asin(math.sqrt(min(1.0, h)))

        left = sorted(rows.itertuples(index=False), key=lambda r: r.feature)
        at = (left[0].slat, left[0].slon)
        out = []
        while left:
            offers = [(far(at, end), i, flip) for i, r in enumerate(left) for flip, end in ((False, (r.lat1, r.lon1)), (True, (r.lat2, r.lon2)))]
            _, i, flip = min(offers, key=lambda x: x[0])
            r = left.pop(i)
            at = (r.tlat, r.tlon) if flip else (r.lat2, r.lon2)
            out.append((r.route, r.feature, len(out), flip))
        return pd.DataFrame(out, columns=["route", "feature", "ord", "flip"])

    if "tlat" not in features.columns:
        features = features.withColumn("tlat", F.col("lat1")).withColumn("tlon", F.col("lon1"))
    return features.groupBy("route").applyInPandas(stitch, "route long, feature long, ord int, flip boolean")


def trim_unfit(corridor: DataFrame) -> DataFrame:
    """Rows (route, pos, cell, fit) from the first fit cell of a route to its last; routes without any give none."""
    w = W.partitionBy("route")
    lo, hi = F.min(F.when(F.col("fit"), F.col("pos"))).over(w), F.max(F.when(F.col("fit"), F.col("pos"))).over(w)
    return corridor.withColumn("__lo", lo).withColumn("__hi", hi).where("pos between __lo and __hi").drop("__lo", "__hi")


def city_intervals(corridor: DataFrame) -> DataFrame:
    """(route, interval, first_pos, last_pos, entry, exit): every run of cells of a corridor (route, pos, cell, fit) inside cities, with the fit cells before and after.

    A corridor may run through several cities; a run at one of its ends has no entry, or no exit.
    """
    w = W.partitionBy("route").orderBy("pos")
    rows = corridor.withColumn("__before", F.lag("cell").over(w)).withColumn("__after", F.lead("cell").over(w))
    rows = rows.withColumn("__n", F.row_number().over(w)).where("not fit").withColumn("__run", F.col("__n") - F.row_number().over(w))
    runs = rows.groupBy("route", "__run").agg(F.min("pos").alias("first_pos"), F.max("pos").alias("last_pos"), F.min_by("__before", "pos").alias("entry"), F.max_by("__after", "pos").alias("exit"))
    return runs.withColumn("interval", F.row_number().over(W.partitionBy("route").orderBy("first_pos")) - 1).select("route", "interval", "first_pos", "last_pos", "entry", "exit")


def road_grid(road_cells: DataFrame, boundary_cells: DataFrame, buffer_m: float, resolution: int) -> DataFrame:
    """(cell, has_road): road cells and, with a buffer, the rings around them (at least one), inside the boundary."""
    rings = max(1, round(buffer_m / grid.edge_m(resolution))) if buffer_m > 0 else 0
    roads = road_cells.select("cell").distinct()
    around = roads.select(F.explode(grid.disk(F.col("cell"), rings)).alias("cell")).distinct() if rings else roads
    flagged = around.join(roads.select(F.col("cell").alias("__r")), F.col("cell") == F.col("__r"), "left")
    return flagged.join(boundary_cells, "cell", "left_semi").select("cell", F.col("__r").isNotNull().alias("has_road"))


def polyfill(polygons: DataFrame, resolution: int) -> DataFrame:
    """(id, cell): cells whose centre lies in a polygon (id, rings)."""
    rows = polygons.select("id", "rings", *spatial._box(F.get("rings", F.lit(0))))
    edge = grid.edge_m(resolution)
    dlat, dlon = 1.5 * edge / geo.METRES_PER_DEGREE, grid.ROOT3 * edge / geo.METRES_PER_DEGREE / grid._COS0
    lines = rows.withColumn("r", F.explode(F.sequence(F.floor(F.col("s") / dlat), F.ceil(F.col("n") / dlat))))
    lo, hi = F.floor(F.col("w") / dlon - F.col("r") / 2), F.ceil(F.col("e") / dlon - F.col("r") / 2)
    cells = lines.withColumn("q", F.explode(F.sequence(lo, hi))).withColumn("cell", grid.pack_id(F.lit(resolution), F.col("q"), F.col("r")))
    inside = geo.in_polygon(grid.lat_of(F.col("cell")), grid.lon_of(F.col("cell")), F.col("rings"))
    return cells.where(inside).select("id", "cell")


def snap_sites(sites: DataFrame, cells: DataFrame) -> DataFrame:
    """(id, cell): a site's own cell where the grid has it, else the nearest road cell, a fit one if there is any.

    ``sites`` have id, lat, lon, cell; ``cells`` have cell, lat, lon, has_road, unfit.
    """
    known = sites.join(cells.select("cell"), "cell", "left_semi").select("id", "cell")
    lost = sites.join(cells.select("cell"), "cell", "left_anti").select("id", "lat", "lon")
    roads = cells.where("has_road").select(F.col("cell").alias("id"), "lat", "lon", "unfit")
    fit = roads.where("not unfit")
    use = roads if fit.isEmpty() else fit
    near = spatial.nearest(lost, use.select("id", "lat", "lon")).select(F.col("id1").alias("id"), F.col("id2").alias("cell"))
    return known.union(near)


def best_buffer_cells(candidates: DataFrame, corridor: DataFrame, reach_m: float, shortlist: int = 8) -> DataFrame:
    """(route, pos, cell, elevation): for each road cell of a corridor the highest of the candidates nearest to it.

    ``candidates`` (route, cell, lat, lon, elevation) go to the nearest corridor cell
    (route, pos, cell, lat, lon): a shortlist by chord, then the geodesic, ties to the smaller pos.  No candidate
    is farther than ``reach_m`` from all of its corridor, so that each meets the cells about it only.
    """
    c = candidates.select("route", F.col("cell").alias("id"), "lat", "lon", "elevation")
    pairs = spatial.range_join(c, corridor.select("route", "pos", "lat", "lon"), reach_m, "chord", "route")
    pairs = pairs.select(F.col("route1").alias("route"), F.col("id1").alias("id"), F.col("elevation1").alias("elevation"), F.col("pos2").alias("pos"), "lat1", "lon1", "lat2", "lon2", "chord")
    short = pairs.withColumn("n", F.row_number().over(W.partitionBy("route", "id").orderBy("chord", "pos"))).where(F.col("n") <= shortlist)
    short = short.withColumn("far", geo.geodesic_m(F.col("lat1"), F.col("lon1"), F.col("lat2"), F.col("lon2")))
    own = short.groupBy("route", "id", "elevation").agg(F.min_by("pos", F.struct("far", "pos")).alias("pos"))
    best = own.groupBy("route", "pos").agg(F.min_by(F.struct("id", "elevation"), F.struct((-F.col("elevation")).alias("e"), "id")).alias("b"))
    return best.select("route", "pos", F.col("b.id").alias("cell"), F.col("b.elevation").alias("elevation"))


def inject(corridor: DataFrame, best: DataFrame, cap: int | None = None) -> DataFrame:
    """Corridors with each road cell's best candidate after it; a cap keeps the highest of a route (0 or less: all)."""
    if cap is not None and cap > 0:
        best = best.withColumn("__n", F.row_number().over(W.partitionBy("route").orderBy(F.desc("elevation"), "cell", "pos"))).where(F.col("__n") <= cap)
    rows = corridor.select("route", F.col("pos").cast("double").alias("at"), "cell").union(best.select("route", F.col("pos") + F.lit(0.5), "cell"))
    return rows.withColumn("pos", (F.row_number().over(W.partitionBy("route").orderBy("at")) - 1).cast("int")).select("route", "pos", "cell")


def slope_percentile(corridor: DataFrame, share: float = 0.9) -> DataFrame:
    """(route, slope): exact percentile of |rise| in m per km between following cells (route, pos, cell, elevation).

    Slopes are ranked in the window of their route, and the two about the share are taken, so that rows are dealt once and no
    group's values are gathered.
    """
    w = W.partitionBy("route").orderBy("pos")
    ahead = corridor.withColumn("c2", F.lead("cell").over(w)).withColumn("e2", F.lead("elevation").over(w)).where("c2 is not null")
    far = geo.geodesic_rows(grid.lat_of(F.col("cell")), grid.lon_of(F.col("cell")), grid.lat_of(F.col("c2")), grid.lon_of(F.col("c2")))
    slopes = ahead.withColumn("d", far).where("d > 1").select("route", (F.abs(F.col("e2") - F.col("elevation")) / (F.col("d") / 1000)).alias("s"))
    ranked = slopes.withColumn("k", F.row_number().over(W.partitionBy("route").orderBy(F.asc_nulls_last("s"))) - 1)
    ranked = ranked.withColumn("at", (F.count("s").over(W.partitionBy("route")) - 1) * F.lit(float(share)))
    pick = lambda k: F.max(F.when(F.col("k") == k, F.col("s")))
    found = ranked.groupBy("route").agg(F.first("at").alias("at"), pick(F.floor("at")).alias("lo"), pick(F.ceil("at")).alias("hi"))
    between = (F.ceil("at") - F.col("at")) * F.col("lo") + (F.col("at") - F.floor("at")) * F.col("hi")
    return found.select("route", F.when(F.col("lo") == F.col("hi"), F.col("lo")).otherwise(between).alias("slope"))
