"""The whole plan: from boundary, roads, sites and terrain to towers, links and coverage."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from meshwright.config import MeshConfig
from meshwright.functions import grid
from meshwright.operators import corridor, coverage, dem, los, network, placement, spatial
from meshwright.operators.stage import cut, numbered
from meshwright.sources import export

#: A tower's cell and source, and its place in the order of planning: route (negative before all routes), step (0 anchors, 1 placed nodes), pos.
TOWER = "cell long, source string, route long, step int, pos long"


def road_cells(roads: DataFrame, resolution: int) -> DataFrame:
    """(cell): the cells that roads (feature, part, seq, lon, lat) run through."""
    lines = roads.select(F.struct("feature", "part").alias("line"), "seq", "lon", "lat")
    return corridor.line_cells(lines, resolution).select("cell").distinct()


def plan_cells(boundary: DataFrame, roads: DataFrame, config: MeshConfig, raster: dem.Raster | None = None, cities: DataFrame | None = None) -> DataFrame:
    """cell, lat, lon, elevation, los_lat, los_lon, has_road, unfit of the road grid inside the boundary."""
    resolution = config.h3_resolution
    inside = corridor.polyfill(boundary, resolution).select("cell")
    cells = corridor.road_grid(road_cells(roads, resolution), inside, config.road_buffer_m, resolution)
    if raster is not None:
        cells = cells.join(dem.anchors(cells, raster, resolution, config.cell_anchor_margin_m), "cell")
    else:
        cells = cells.withColumn("elevation", F.lit(0.0)).withColumn("los_lat", grid.lat_of(F.col("cell"))).withColumn("los_lon", grid.lon_of(F.col("cell")))
    placed = cut(cells.withColumn("lat", grid.lat_of(F.col("cell"))).withColumn("lon", grid.lon_of(F.col("cell"))))
    return marked(placed, cities)


def marked(placed: DataFrame, cities: DataFrame | None) -> DataFrame:
    """Cells (cell, lat, lon, ...) with ``unfit``: whether a city holds their centre."""
    if cities is None:
        return placed.withColumn("unfit", F.lit(False))
    inside = spatial.within_polygons(placed.select(F.col("cell").alias("id"), "lat", "lon"), cities).select(F.col("id").alias("cell"), F.col("inside").alias("unfit"))
    return cut(placed.join(inside, "cell"))


def pair_rows(pairs: DataFrame, cells: DataFrame, config: MeshConfig) -> DataFrame:
    """Canonical pairs (lo, hi) of cells as line-of-sight rows, ends at their anchors; a cell's ``offset_m`` raises its mast, not its ground."""
    mast = F.lit(config.mast_height_m) + (F.coalesce("offset_m", F.lit(0.0)) if "offset_m" in cells.columns else F.lit(0.0))
    out = pairs.select("lo", "hi", F.struct("lo", "hi").alias("id"), F.col("lo").alias("cell1"), F.col("hi").alias("cell2"))
    for i in ("1", "2"):
        own = cells.select(F.col("cell").alias(f"cell{i}"), F.coalesce("los_lat", "lat").alias(f"lat{i}"), F.coalesce("los_lon", "lon").alias(f"lon{i}"), F.col("elevation").alias(f"ground{i}"), mast.alias(f"mast{i}"))
        out = out.join(own, f"cell{i}")
    return out


def standing(spark: SparkSession, existing: DataFrame | None) -> DataFrame:
    """The towers that a plan begins with: those of ``existing`` (cell, source, ord), or none."""
    towers = spark.createDataFrame([], TOWER)
    if existing is None:
        return towers
    return cut(network.place_towers(towers, existing.select("cell", "source", F.lit(-2).cast("long").alias("route"), F.lit(0).alias("step"), F.col("ord").cast("long").alias("pos"))))


def raised(cells: DataFrame, heights: DataFrame) -> DataFrame:
    """Cells with ``offset_m``: the largest extra height (cell, height) of what stands in each, 0 or more."""
    own = heights.groupBy("cell").agg(F.max(F.greatest(F.coalesce("height", F.lit(0.0)), F.lit(0.0))).alias("offset_m"))
    return cells.drop("offset_m").join(own, "cell", "left").withColumn("offset_m", F.coalesce("offset_m", F.lit(0.0)))


def assembled(towers: DataFrame, chains: DataFrame, cells: DataFrame, config: MeshConfig, raster: dem.Raster | None, cities: DataFrame | None) -> dict[str, DataFrame]:
    """towers, edges, chain edges, clusters, coverage[, city links] and report of placed towers (TOWER) and chains (route, pos, cell, algorithm, ...).

    Towers get ids in the order in which they were planned, how they were placed, their coverage radius and whether they serve a city.
    """
    named = cut(network.numbered(towers, cells))
    how = chains.where("algorithm is not null").groupBy(F.col("cell").alias("mc")).agg(F.min_by(F.struct("algorithm", "dp_steps", "repair_round"), "route").alias("m"))
    known = named.join(how, (F.col("cell") == F.col("mc")) & (F.col("step") == 1), "left").select("id", "cell", "lat", "lon", "source", "m.algorithm", "m.dp_steps", "m.repair_round")
    sited = cut(named.join(cells.select("cell", F.col("elevation").alias("ground"), "offset_m"), "cell").select("id", "cell", "lat", "lon", "ground", (F.lit(config.mast_height_m) + F.col("offset_m")).alias("mast")))
    terrain = cells.select("cell", "elevation")
    follow = placement.wire_chain(chains.select("route", "pos", "cell").join(named.select("cell", "id"), "cell"))
    wired = cut(network.chain_edges(follow, sited, config, terrain, raster))
    edges = cut(network.linked(wired, network.visibility_edges(sited, config, terrain, raster)))
    groups = cut(network.clusters(named, edges))
    covered = cut(coverage.cell_coverage(cells, sited, config, raster))
    radii = coverage.coverage_radius(covered).withColumnRenamed("radius_m", "coverage_radius_m")
    full = known.join(radii, "id", "left").withColumn("coverage_radius_m", F.coalesce("coverage_radius_m", F.lit(0.0)))
    made = {"edges": edges, "corridor_edges": wired, "clusters": groups, "coverage": covered, "report": coverage.report(named, covered, groups)}
    if cities is not None:
        made["city_links"] = cut(coverage.city_links(covered.select("cell", "lat", "lon", "closest_id"), cities))
        full = full.join(made["city_links"], "id", "left")
    return made | {"towers": cut(full)}


def plan_mesh(spark: SparkSession, config: MeshConfig, boundary: DataFrame, roads: DataFrame, sites: DataFrame, raster: dem.Raster | None = None, cities: DataFrame | None = None, existing: DataFrame | None = None) -> dict[str, DataFrame]:
    """cells, sites, corridors, towers, edges, clusters, coverage and report of a plan.

    Towers that stand already (``existing``: cell, source, ord) come first, then those of the sites; sites are linked by
    priority along the road graph.  A level's corridors are planned together, beside the towers of the levels before
    it, which they reuse; then links, clusters and coverage follow.  A site's height (site_height_m) raises the antennas of its cell.
    """
    from meshwright.plans import routes

    cells = plan_cells(boundary, roads, config, raster, cities)
    snapped = cut(sites.drop("cell").join(corridor.snap_sites(sites.select("id", "lat", "lon", "cell"), cells), "id"))
    height = F.col("site_height_m") if "site_height_m" in snapped.columns else F.lit(0.0)
    cells = cut(raised(cells, snapped.select("cell", height.alias("height"))))
    towers = standing(spark, existing)
    towers = cut(network.place_towers(towers, snapped.select("cell", F.lit("site").alias("source"), F.lit(-1).cast("long").alias("route"), F.lit(0).alias("step"), F.col("ord").cast("long").alias("pos"))))
    graph_cells = cells.join(snapped.select("cell").withColumn("__site", F.lit(True)).distinct(), "cell", "left").where("has_road or __site").select("cell", "elevation")
    graph = cut(network.routing_graph(graph_cells, config.routing_k_ring))
    links = placement.priority_links(snapped.select("id", "ord", "priority", "lat", "lon"))
    end = lambda key, cell, ord_: snapped.select(F.col("id").alias(key), F.col("cell").alias(cell), F.col("ord").alias(ord_))
    asked = links.join(end("a", "src", "oa"), "a").join(end("b", "dst", "ob"), "b").where("src != dst")
    requests = cut(numbered(asked.select("level", "src", "dst", "oa", "ob"), [F.col("level"), F.col("oa"), F.col("ob")], "route"))
    paths = network.shortest_paths(graph, requests.select("route", "src", "dst"))
    corridors = cut(paths.select("route", F.posexplode("path").alias("pos", "cell")))
    budgets = requests.select("route", F.lit(config.max_towers_per_route).alias("budget"))
    sight = routes.sight_over(cells, config, raster)
    chains = spark.createDataFrame([], routes.CHAIN)
    for (level,) in requests.select("level").distinct().orderBy("level").collect():  # as many rows as there are priorities
        own = corridors.join(requests.where(F.col("level") == level).select("route"), "route", "left_semi")
        chosen = routes.place_along(own, budgets, cells, towers.select("cell"), config, sight, shade=routes.shade_over(cells, config, raster))
        towers = cut(network.place_towers(towers, chosen.select("cell", F.lit(f"priority_{level}").alias("source"), "route", F.lit(1).alias("step"), F.col("pos").cast("long").alias("pos"))))
        chains = cut(chains.unionByName(chosen))
    return {"cells": cells, "sites": snapped, "corridors": corridors, "chains": chains} | assembled(towers, chains, cells, config, raster, cities)


def write_plan(plan: dict[str, DataFrame], paths: dict[str, str], config: MeshConfig) -> None:
    """Towers, coverage, links, grid cells and report of a plan to their paths."""
    towers = plan["towers"]
    export.write_features(export.tower_features(towers, plan["cells"], config.mast_height_m), paths["towers"])
    export.write_features(export.coverage_features(plan["coverage"]), paths["coverage"])
    export.write_features(export.edge_features(plan["edges"], towers, plan["cells"], config), paths["edges"])
    if config.export_full_grid_cells:
        export.write_features(export.grid_features(plan["cells"], config.h3_resolution), paths["grid_cells"])
    if "search" in plan:
        export.write_features(export.search_features(plan["search"].distinct()), paths["gap_repair_hexes"])
    plan["report"].select(F.to_json(F.struct(*plan["report"].columns)).alias("value")).write.mode("overwrite").text(paths["report"])
