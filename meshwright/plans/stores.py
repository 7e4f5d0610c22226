"""Queries over what the library stores and orders: GeoTIFF mosaics, tiled rasters, meshes of two resolutions, waves, spacing."""

from __future__ import annotations

import dataclasses
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from meshwright.functions import grid
from meshwright.operators import adaptive, corridor, dem, fingerprint, sightbook, spatial, waves
from meshwright.operators.stage import shared_dir
from meshwright.plans import bindings as b
from meshwright.plans.queries import CORRIDORS, ORACLE_SQL, PIXELS, TOWERS, _chord, _each, _pairs, _receiver_cells, query, scaled
from meshwright.plans.terrain import _E9, _GRADIENT, _children, _located
from meshwright.sources import geotiff, tiles

#: Pixels along the sides of the files and tiles of these small stores, and how near two anchors may stand.
FILE, TILE, APART_M = 256, 16, 1500.0


def _raster(spark: SparkSession, sf_dir: str) -> dem.Raster:
    """The part prices as a raster of as many rows as there are."""
    found = b.raster(spark, sf_dir)
    return dem.Raster(found.pixels, found.west, found.north, found.px, found.width, (found.pixels.agg(F.max("row")).first()[0] or 0) + 1)


def _place(spark: SparkSession) -> str:
    return f"{shared_dir(spark)}/store-{uuid.uuid4().hex}"


@query(f"WITH {PIXELS} SELECT r AS row, c AS col, {'CAST(floor(value * 1e2 + 0.5) AS BIGINT)'} AS cents FROM pixels")
def geotiff_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pixels, written as a mosaic of GeoTIFF files and read back from their blocks (32-bit floats, to the cent)."""
    at = _place(spark)
    geotiff.write_geotiff(_raster(spark, sf_dir), at, FILE, TILE).collect()
    return geotiff.load_geotiff(spark, at).pixels.where("value is not null").select("row", "col", scaled(F.col("value"), 2).alias("cents"))


@query(f"WITH {PIXELS} SELECT r AS row, c AS col, {'CAST(floor(value * 1e2 + 0.5) AS BIGINT)'} AS cents FROM pixels WHERE r BETWEEN 5 AND 24 AND c BETWEEN 10 AND 29")
def geotiff_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A rectangle of a mosaic; blocks outside it are not read."""
    at = _place(spark)
    geotiff.write_geotiff(_raster(spark, sf_dir), at, FILE, TILE).collect()
    window = geotiff.load_geotiff(spark, at).window(b.NORTH - 24.5 * b.PX, b.WEST + 10.5 * b.PX, b.NORTH - 5.5 * b.PX, b.WEST + 29.5 * b.PX)
    return window.where("value is not null").select("row", "col", scaled(F.col("value"), 2).alias("cents"))


def _tiled(spark: SparkSession, sf_dir: str) -> tiles.TiledRaster:
    at = _place(spark)
    tiles.write_tiles(_raster(spark, sf_dir), at, TILE)
    return tiles.read_tiles(spark, at)


@query(ORACLE_SQL["elevation_bilinear"].replace("floor(c) + 1 < 50 AS whole", "floor(c) + 1 < 50 AND floor(r) + 1 <= (SELECT max(p.r) FROM pixels p) AS whole"))
def tiled_bilinear(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Elevations between pixels, from a store in tiles."""
    points = b.receivers(spark, sf_dir).select("id", "lat", "lon")
    return dem.bilinear_value(points, _tiled(spark, sf_dir)).select("id", scaled(F.col("elevation")).alias("elevation"))


@query(ORACLE_SQL["line_peak"])
def tiled_line_peak(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Peaks of lines, from a store in tiles; tiles that lie too low are not read."""
    of = spatial.kinds(b.towers(spark, sf_dir).select("id", "lat", "lon"))
    lines = _pairs(of).select(F.struct("id1", "id2").alias("id"), "lat1", "lon1", "lat2", "lon2")
    return _each(dem.line_peaks(lines, _tiled(spark, sf_dir)).select("id.id1", "id.id2", "peak_m", scaled(F.col("fraction"), 6).alias("fraction")), of)


@query(ORACLE_SQL["cell_anchor"])
def tiled_anchor(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Anchors of cells, from the tiles about them."""
    cells = _receiver_cells(spark, sf_dir)
    found = dem.anchors(cells, _tiled(spark, sf_dir), b.RESOLUTION)
    return found.select("cell", "elevation", scaled(F.col("los_lat"), 7).alias("lat7"), scaled(F.col("los_lon"), 7).alias("lon7"))


_MESH = f"{_GRADIENT}, steeper AS (SELECT * FROM gradients WHERE gradient > {adaptive.STEEP!r}), {_children('steeper')}, mesh AS (SELECT cell, 8 AS resolution FROM gradients WHERE gradient <= {adaptive.STEEP!r} UNION ALL SELECT kid, 9 FROM kids)"


@query(f"""WITH {_MESH}, samples AS (SELECT id, lat, lon, CAST(id % 25 AS BIGINT) AS route FROM receivers),
{_located('coarsely', 'samples')}, {_located('finely', 'samples', _E9, 9)},
placed AS (SELECT c.id, c.route, coalesce(f2.cell, c2.cell, c.cell) AS cell FROM coarsely c JOIN finely f USING (id) LEFT JOIN mesh f2 ON f2.cell = f.cell AND f2.resolution = 9 LEFT JOIN mesh c2 ON c2.cell = c.cell AND c2.resolution = 8),
firsts AS (SELECT route, cell, min(id) AS id FROM placed GROUP BY route, cell)
SELECT route, CAST(row_number() OVER (PARTITION BY route ORDER BY id) - 1 AS INT) AS pos, cell FROM firsts""")
def adaptive_corridors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Corridors over a mesh that is finer where it is steep: samples in order, each cell at its first visit."""
    cells = _receiver_cells(spark, sf_dir)
    mesh = adaptive.mesh(cells, adaptive.targets(dem.local_gradient(cells.select("cell", "elevation")), b.RESOLUTION, 9), b.RESOLUTION)
    samples = b.receivers(spark, sf_dir).select((F.col("id") % 25).alias("route"), F.col("id").alias("at"), "lat", "lon")
    return adaptive.project(samples, mesh, b.RESOLUTION, 9, ["at"])


_EDGES8, _EDGES9 = grid.EDGE_M[8], grid.EDGE_M[9]


@query(f"""WITH {_MESH}, {TOWERS}, sized AS (SELECT cell, CASE resolution WHEN 8 THEN {_EDGES8!r}e0 ELSE {_EDGES9!r}e0 END AS edge,
  ((cell & 268435455) - 134217728) * 1.5e0 * CASE resolution WHEN 8 THEN {_EDGES8!r}e0 ELSE {_EDGES9!r}e0 END / 111320e0 AS lat,
  ((((cell >> 28) & 268435455) - 134217728) * {grid.ROOT3!r}e0 + ((cell & 268435455) - 134217728) * {grid.ROOT3 / 2!r}e0) * CASE resolution WHEN 8 THEN {_EDGES8!r}e0 ELSE {_EDGES9!r}e0 END / {111320.0 * grid._COS0!r}e0 AS lon FROM mesh),
{_located('standing', 'towers')}, centres8 AS (SELECT DISTINCT cell AS centre FROM standing),
placed AS (SELECT centre, ((centre & 268435455) - 134217728) * 1.5e0 * {_EDGES8!r}e0 / 111320e0 AS lat, ((((centre >> 28) & 268435455) - 134217728) * {grid.ROOT3!r}e0 + ((centre & 268435455) - 134217728) * {grid.ROOT3 / 2!r}e0) * {_EDGES8!r}e0 / {111320.0 * grid._COS0!r}e0 AS lon FROM centres8)
SELECT p.centre, s.cell FROM placed p JOIN sized s ON abs(p.lat - s.lat) < 0.03 WHERE {_chord('p', 's')} <= 700e0 + s.edge + {_EDGES8!r}e0 UNION SELECT centre, centre FROM placed""")
def mesh_neighbourhoods(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cells of a mesh of two resolutions that a radius about each tower's cell reaches, the edges of both added."""
    cells = _receiver_cells(spark, sf_dir)
    mesh = adaptive.mesh(cells, adaptive.targets(dem.local_gradient(cells.select("cell", "elevation")), b.RESOLUTION, 9), b.RESOLUTION)
    mesh = mesh.select("cell", grid.lat_of(F.col("cell")).alias("lat"), grid.lon_of(F.col("cell")).alias("lon"))
    centres = b.towers(spark, sf_dir).select(grid.cell_of(F.col("lat"), F.col("lon"), b.RESOLUTION).alias("cell"))
    return adaptive.near(mesh, centres, 700.0)


@query(f"""WITH RECURSIVE {TOWERS}, {_located('standing', 'towers')}, offsets AS (SELECT q AS dq, r AS dr FROM range(-1, 2) a(q), range(-1, 2) c(r) WHERE abs(q + r) <= 1),
claims AS (SELECT DISTINCT id AS route, q + dq AS q, r + dr AS r FROM standing, offsets),
meets AS (SELECT DISTINCT a.route AS early, c.route AS late FROM claims a JOIN claims c ON a.q = c.q AND a.r = c.r AND a.route < c.route),
reach AS (SELECT id AS route, 0 AS wave FROM towers UNION SELECT m.late, wave + 1 FROM reach JOIN meets m ON m.early = reach.route)
SELECT route, CAST(max(wave) AS INT) AS wave FROM reach GROUP BY route""")
def route_waves(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Waves of routes that claim a tower's cell and the cells about it."""
    cell = grid.cell_of(F.col("lat"), F.col("lon"), b.RESOLUTION)
    return waves.waves(b.towers(spark, sf_dir).select(F.col("id").alias("route"), F.explode(grid.disk(cell, 1)).alias("cell")))


@query(f"""WITH RECURSIVE {TOWERS}, near AS (SELECT a.id AS late, list(c.id) AS before FROM towers a JOIN towers c ON c.id < a.id AND abs(a.lat - c.lat) < 0.03 WHERE {_chord('a', 'c')} <= {APART_M} GROUP BY a.id),
steps AS (SELECT CAST(-1 AS BIGINT) AS id, CAST([] AS BIGINT[]) AS kept UNION ALL
  SELECT t.id, CASE WHEN list_has_any(coalesce(n.before, []), s.kept) THEN s.kept ELSE list_append(s.kept, t.id) END
  FROM steps s JOIN towers t ON t.id = s.id + 1 LEFT JOIN near n ON n.late = t.id),
final AS (SELECT kept FROM steps ORDER BY id DESC LIMIT 1)
SELECT id, list_contains((SELECT kept FROM final), id) AS kept FROM towers""")
def anchor_spacing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Anchors that keep apart, first come first served."""
    points = b.towers(spark, sf_dir).select("id", F.col("id").alias("ord"), "lat", "lon")
    return waves.first_fit(points, APART_M).select("id", "kept")


@query("SELECT run, requested, unique_pairs, hits, computed, failed FROM (SELECT count(*) AS n FROM supplier) s, (VALUES (1, 3, 1, 0, 1), (2, 3, 1, 1, 0), (3, 3, 1, 0, 1)) r(run, requested_times, once, hit, done), LATERAL (SELECT (n - 1) * requested_times AS requested, n - 1 + 0 * once AS unique_pairs, hit * (n - 2) AS hits, done * (n - 2) AS computed, CAST(1 AS BIGINT) AS failed) x")
def sight_cache(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each tower asked for the next one, three times in both directions, in three runs with one store of answers: new, known, and with another mast height; the last pair has no cell."""
    t = b.towers(spark, sf_dir)
    cells = t.select(F.col("id").alias("cell"), "lat", "lon", F.col("lat").alias("los_lat"), F.col("lon").alias("los_lon"), F.col("ground").alias("elevation"))
    last = t.agg(F.max("id")).first()[0]
    ahead = t.where(F.col("id") > 0).select((F.col("id") - 1).alias("src"), F.when(F.col("id") == last, F.lit(-1)).otherwise(F.col("id")).alias("dst"))
    asked = ahead.union(ahead.select("dst", "src")).union(ahead)
    out = []
    at = _place(spark)
    for run, config in enumerate((b.TIGHT, b.TIGHT, dataclasses.replace(b.TIGHT, mast_height_m=35.0)), 1):
        book = sightbook.SightBook(spark, at)
        sightbook.batch(asked, cells, config, None, book, "towers")
        out.append(book.report().select(F.lit(run).alias("run"), "requested", F.col("unique").alias("unique_pairs"), "hits", "computed", "failed"))
    return out[0].union(out[1]).union(out[2])


@query("SELECT name, n AS rows, true AS same FROM (SELECT 'events' AS name, count(*) AS n FROM events UNION ALL SELECT 'lineitem', count(*) FROM lineitem UNION ALL SELECT 'orders', count(*) FROM orders), range(2)")
def table_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of tables dealt into different numbers of partitions, which are to be the same."""
    deal = lambda: {name: fingerprint.dealt(b.table(spark, sf_dir, name)) for name in ("events", "lineitem", "orders")}
    return fingerprint.repeated(spark, deal, (2, 5)).select("name", "rows", "same")


@query(f"""WITH {CORRIDORS}, rows AS (SELECT route, pos, cell, value % 3 <> 0 AS fit, lag(cell) OVER w AS before, lead(cell) OVER w AS after, row_number() OVER w AS n FROM corridors WINDOW w AS (PARTITION BY route ORDER BY pos)),
runs AS (SELECT *, n - row_number() OVER (PARTITION BY route ORDER BY pos) AS run FROM rows WHERE NOT fit),
found AS (SELECT route, run, min(pos) AS first_pos, max(pos) AS last_pos, arg_min(coalesce(before, -1), pos) AS entry, arg_max(coalesce(after, -1), pos) AS exit FROM runs GROUP BY route, run)
SELECT route, CAST(row_number() OVER (PARTITION BY route ORDER BY first_pos) - 1 AS INT) AS interval, first_pos, last_pos, entry, exit FROM found""")
def city_intervals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All runs of corridors through cities, with the cells where the road enters and leaves (-1: it does not)."""
    rows = b.corridors(spark, sf_dir).withColumn("fit", F.col("value") % 3 != 0)
    found = corridor.city_intervals(rows)
    return found.withColumn("interval", F.col("interval").cast("int")).withColumn("entry", F.coalesce("entry", F.lit(-1))).withColumn("exit", F.coalesce("exit", F.lit(-1)))
