"""Graphs of towers and road cells: visibility edges, components, clusters, routing, shortest paths."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from meshwright.config import MeshConfig
from meshwright.functions import geo, grid, physics
from meshwright.operators import los, spatial, stage
from meshwright.operators.stage import cut


def components(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(id, component): the smallest node reachable from each node over the undirected edges (a, b).

    Edges are contracted to the smallest neighbour round by round; nodes without edges are
    components of their own.
    """
    left = cut(edges.where("a != b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    labels = nodes.select("id", F.col("id").alias("component"))
    while not left.isEmpty():
        both = left.union(left.select(F.col("b").alias("a"), F.col("a").alias("b")))
        to = both.groupBy("a").agg(F.min("b").alias("p")).select(F.col("a").alias("x"), F.least("a", "p").alias("p"))
        hop = to.select(F.col("x").alias("y"), F.col("p").alias("pp"))
        to = cut(to.join(hop, F.col("p") == F.col("y"), "left").select("x", F.coalesce("pp", "p").alias("p")))
        labels = cut(labels.join(to, F.col("component") == F.col("x"), "left").select("id", F.coalesce("p", "component").alias("component")))
        moved = left.join(to.select(F.col("x").alias("xa"), F.col("p").alias("pa")), F.col("a") == F.col("xa")).join(to.select(F.col("x").alias("xb"), F.col("p").alias("pb")), F.col("b") == F.col("xb")).where("pa != pb")
        left = cut(moved.select(F.least("pa", "pb").alias("a"), F.greatest("pa", "pb").alias("b")).distinct())
    return labels


def representatives(labels: DataFrame) -> DataFrame:
    """The towers that name their cluster."""
    return labels.where("id = component")


def nearest_in_clusters(point: DataFrame, towers: DataFrame, labels: DataFrame, clusters: DataFrame) -> DataFrame:
    """The nearest tower to each point among the given clusters (component)."""
    own = labels.join(clusters, "component", "left_semi").select("id")
    return spatial.nearest(point, towers.join(own, "id", "left_semi"))


def tower_pairs(towers: DataFrame, config: MeshConfig) -> DataFrame:
    """Pairs (id1 < id2) of towers within the radius that visibility and free-space loss allow."""
    radius = min(config.max_visibility_m, physics.max_fspl_distance_m(config.frequency_hz, config.link_budget_db))
    return spatial.pairs_within(towers, radius)


def routing_graph(road_cells: DataFrame, k: int) -> DataFrame:
    """Directed edges (src, dst, cost) between road cells (cell, elevation) at most k steps apart; cost times steps."""
    near = road_cells.select(F.col("cell").alias("src"), F.col("elevation").alias("e1"), F.explode(grid.disk(F.col("cell"), k)).alias("dst")).where("src != dst")
    found = near.join(road_cells.select(F.col("cell").alias("dst"), F.col("elevation").alias("e2")), "dst")
    return found.select("src", "dst", (physics.edge_cost(F.col("e1"), F.col("e2")) * grid.grid_distance(F.col("src"), F.col("dst"))).alias("cost"))


def shortest_paths(edges: DataFrame, requests: DataFrame, most_rounds: int = 10_000) -> DataFrame:
    """(route, cost, path) for requests (route, src, dst) over directed edges (src, dst, cost).

    All requests are relaxed together, a frontier of improved nodes at a time, until no
    node improves.  Ties go to the lexically smaller path; requests without a path, or
    with a missing node, are absent.
    """
    reached = requests.select("route", F.col("src").alias("node"), F.lit(0.0).alias("cost"), F.array("src").alias("path"))
    reached = cut(reached.join(edges.select(F.col("src").alias("node")).union(edges.select("dst")).distinct(), "node", "left_semi").select("route", "node", "cost", "path"))
    frontier = reached
    steps = edges.select(F.col("src").alias("__s"), F.col("dst").alias("__d"), F.col("cost").alias("__c"))
    for _ in range(most_rounds):
        ahead = frontier.join(steps, F.col("node") == F.col("__s")).select("route", F.col("__d").alias("node"), (F.col("cost") + F.col("__c")).alias("cost"), F.concat("path", F.array("__d")).alias("path"))
        best = F.min(F.struct("cost", "path"))
        offered = ahead.groupBy("route", "node").agg(best.alias("o"))
        known = reached.select(F.col("route").alias("r2"), F.col("node").alias("n2"), F.struct("cost", "path").alias("k"))
        better = offered.join(known, (F.col("route") == F.col("r2")) & (F.col("node") == F.col("n2")), "left").where(F.col("k").isNull() | (F.col("o") < F.col("k")))
        frontier = cut(better.select("route", "node", "o.cost", "o.path"))
        if frontier.isEmpty():
            break
        reached = cut(reached.union(frontier).groupBy("route", "node").agg(best.alias("o")).select("route", "node", "o.cost", "o.path"))
    goal = requests.select(F.col("route").alias("r2"), F.col("dst").alias("n2"))
    return reached.join(goal, (F.col("route") == F.col("r2")) & (F.col("node") == F.col("n2"))).select("route", "cost", "path")


def corridor_length(corridor: DataFrame) -> DataFrame:
    """(route, length_m): the geodesic length of the cells of each route in order of pos."""
    ahead = corridor.withColumn("next", F.lead("cell").over(W.partitionBy("route").orderBy("pos")))
    step = geo.geodesic_m(grid.lat_of(F.col("cell")), grid.lon_of(F.col("cell")), grid.lat_of(F.col("next")), grid.lon_of(F.col("next")))
    return ahead.groupBy("route").agg(F.coalesce(F.sum(step), F.lit(0.0)).alias("length_m"))


def place_towers(towers: DataFrame, wanted: DataFrame) -> DataFrame:
    """Towers (cell, source, route, step, pos) with those of ``wanted`` that stand on a free cell; of several on one cell the first."""
    own = ["source", "route", "step", "pos"]
    first = wanted.groupBy("cell").agg(F.min_by(F.struct(*own), F.struct("route", "step", "pos")).alias("w")).select("cell", "w.*")
    return towers.unionByName(first.join(towers.select("cell"), "cell", "left_anti"))


def numbered(towers: DataFrame, cells: DataFrame) -> DataFrame:
    """(id, cell, lat, lon, source, route, step, pos): ids from 0 in the order of route, step and pos, at the anchors of their cells."""
    known = towers.join(cells.select("cell", F.coalesce("los_lat", "lat").alias("lat"), F.coalesce("los_lon", "lon").alias("lon")), "cell")
    placed = stage.numbered(known, [F.col("route"), F.col("step"), F.col("pos"), F.col("cell")], "id")
    return placed.select("id", "cell", "lat", "lon", "source", "route", "step", "pos")


def upsert_edges(edges: DataFrame, fresh: DataFrame, columns: list[str]) -> DataFrame:
    """Undirected edges (a < b, seq, ...) where later rows (larger seq) replace earlier ones."""
    rows = edges.unionByName(fresh).withColumn("lo", F.least("a", "b")).withColumn("hi", F.greatest("a", "b"))
    best = rows.groupBy("lo", "hi").agg(F.max_by(F.struct("seq", *columns), "seq").alias("e"))
    return best.select(F.col("lo").alias("a"), F.col("hi").alias("b"), "e.*")


def visibility_edges(towers: DataFrame, config: MeshConfig, cells: DataFrame | None = None, raster=None, origin: str = "global_visibility") -> DataFrame:
    """Edges (a, b, distance_m, path_loss_db, clearance_m, obstruction, origin) between towers that see each other.

    ``towers`` have id, cell, lat, lon, ground, mast.
    """
    pairs = tower_pairs(towers, config).withColumn("id", F.struct(F.col("id1").alias("a"), F.col("id2").alias("b")))
    seen = los.evaluate(pairs, config, cells, raster).where("visible")
    return seen.select("id.a", "id.b", "distance_m", "path_loss_db", "clearance_m", "obstruction", F.lit(origin).alias("origin"))


def chain_edges(pairs: DataFrame, towers: DataFrame, config: MeshConfig, cells: DataFrame | None = None, raster=None) -> DataFrame:
    """Edges of origin ``corridor_chain`` between the pairs (a, b) of towers (id, cell, lat, lon, ground, mast) that see each other."""
    rows = pairs.withColumn("id", F.struct("a", "b"))
    for i, end in (("1", "a"), ("2", "b")):
        rows = rows.join(towers.select(F.col("id").alias(end), *[F.col(c).alias(f"{c}{i}") for c in ("cell", "lat", "lon", "ground", "mast")]), end)
    seen = los.evaluate(rows, config, cells, raster).where("visible")
    return seen.select("id.a", "id.b", "distance_m", "path_loss_db", "clearance_m", "obstruction", F.lit("corridor_chain").alias("origin"))


def linked(chain: DataFrame, everywhere: DataFrame) -> DataFrame:
    """All edges: those of the chains, replaced where the edges between all towers have them too."""
    values = ["distance_m", "path_loss_db", "clearance_m", "obstruction", "origin"]
    both = upsert_edges(chain.withColumn("seq", F.lit(0)), everywhere.withColumn("seq", F.lit(1)), values)
    return both.select("a", "b", *values)


def clusters(towers: DataFrame, edges: DataFrame) -> DataFrame:
    """(id, component): a cluster is named by its smallest tower."""
    return components(towers.select("id"), edges.select("a", "b"))
