"""More queries with their SQL: cells and their children, anchors, peaks, sight over terrain, coverage, routes, exports."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from meshwright.functions import geo, grid, physics
from meshwright.operators import adaptive, corridor, coverage, dem, los, network, placement, sightlines, spatial
from meshwright.operators.stage import cut
from meshwright.plans import bindings as b
from meshwright.plans.queries import BUDGET, CELLS, CORRIDORS, FREQUENCY, PAIRS, PIXELS, REACH_M, RECEIVERS, SITES, TOWERS, _chord, _fspl, _each, _links, _masts, _pairs, _receiver_cells, _s, _vincenty, query, scaled

_M, _C, _R3 = geo.METRES_PER_DEGREE, grid._COS0, grid.ROOT3
_E8, _E9 = grid.EDGE_M[8], grid.EDGE_M[9]
_CURVE = 2 * b.TIGHT.effective_earth_radius_m


def _lat(r: str, edge: float = _E8) -> str:
    return f"({r} * 1.5e0 * {edge!r}e0 / {_M!r}e0)"


def _lon(q: str, r: str, edge: float = _E8) -> str:
    return f"(({q} * {_R3!r}e0 + {r} * {_R3 / 2!r}e0) * {edge!r}e0 / {_M * _C!r}e0)"


def _rounded(name: str, source: str, fq: str, fr: str, resolution: int = 8) -> str:
    """CTEs that add q, r and cell of fractional coordinates to the rows of ``source``."""
    return (
        f"{name}_f AS (SELECT *, {fq} AS fq, {fr} AS fr FROM {source}), {name}_r AS (SELECT *, floor(fq + 0.5) AS rq, floor(fr + 0.5) AS rr, floor(-fq - fr + 0.5) AS rs FROM {name}_f), "
        f"{name}_d AS (SELECT *, abs(rq - fq) AS dq, abs(rr - fr) AS dr, abs(rs + fq + fr) AS ds FROM {name}_r), "
        f"{name}_c AS (SELECT * EXCLUDE (fq, fr, rq, rr, rs, dq, dr, ds), CAST(CASE WHEN dq > dr AND dq > ds THEN -rr - rs ELSE rq END AS BIGINT) AS q, CAST(CASE WHEN dq > dr AND dq > ds THEN rr WHEN dr > ds THEN -rq - rs ELSE rr END AS BIGINT) AS r FROM {name}_d), "
        f"{name} AS (SELECT *, CAST({resolution} AS BIGINT) * 72057594037927936 + (q + 134217728) * 268435456 + (r + 134217728) AS cell FROM {name}_c)"
    )


def _located(name: str, source: str, edge: float = _E8, resolution: int = 8) -> str:
    """As ``_rounded``, from lat and lon."""
    return _rounded(name, source, f"(({_R3 / 3!r}e0 * (lon * {_M * _C!r}e0) - lat * {_M!r}e0 / 3e0) / {edge!r}e0)", f"(lat * {_M!r}e0 * 2e0 / 3e0 / {edge!r}e0)", resolution)


_CENTRES = f"{CELLS}, centres AS (SELECT *, {_lat('r')} AS lat, {_lon('q', 'r')} AS lon FROM gridcells)"


# --- grid -----------------------------------------------------------------------------------------

_GRADIENT = f"{_CENTRES}, pairs AS (SELECT a.cell AS id1, c.cell AS id2, a.lat AS lat1, a.lon AS lon1, c.lat AS lat2, c.lon AS lon2 FROM centres a JOIN centres c ON greatest(abs(a.q - c.q), abs(a.r - c.r), abs(a.q - c.q + a.r - c.r)) = 1), {_vincenty()}, steep AS (SELECT id1 AS cell, max(abs(a.elevation - c.elevation) / (far / 1000e0)) AS gradient FROM geodesics JOIN gridcells a ON a.cell = id1 JOIN gridcells c ON c.cell = id2 WHERE far > 1 GROUP BY id1), gradients AS (SELECT cell, q, r, lat, lon, coalesce(gradient, 0e0) AS gradient FROM centres LEFT JOIN steep USING (cell))"


@query(f"WITH {_GRADIENT} SELECT cell, {_s('gradient')} AS gradient FROM gradients")
def local_gradient(spark: SparkSession, sf_dir: str) -> DataFrame:
    steep = dem.local_gradient(_receiver_cells(spark, sf_dir).select("cell", "elevation"))
    return steep.select("cell", scaled(F.col("gradient")).alias("gradient"))


def _children(source: str) -> str:
    """CTEs: ``kids`` (own, cell), the cells of resolution 9 whose centre lies in a cell of resolution 8."""
    middle = _located("middle", f"(SELECT cell AS own, lat, lon FROM {source})", _E9, 9)
    offered = f"offered AS (SELECT own, q + dq AS kq, r + dr AS kr FROM middle, range(-6, 7) x(dq), range(-6, 7) y(dr) WHERE abs(dq + dr) <= 6), places AS (SELECT own, kq, kr, {_lat('kr', _E9)} AS lat, {_lon('kq', 'kr', _E9)} AS lon FROM offered)"
    return f"{middle}, {offered}, {_located('above', 'places')}, kids AS (SELECT own, CAST(9 AS BIGINT) * 72057594037927936 + (kq + 134217728) * 268435456 + (kr + 134217728) AS kid FROM above WHERE cell = own)"


@query(f"WITH {_CENTRES}, {_children('centres')}, once AS (SELECT kid, count(*) AS parents, min(own) AS cell FROM kids GROUP BY kid) SELECT cell, parents, count(*) AS count FROM once GROUP BY ALL")
def children_partition(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every finer cell has one parent: children of all cells, counted by parent."""
    kids = _receiver_cells(spark, sf_dir).select("cell", F.explode(grid.children(F.col("cell"), b.RESOLUTION, 9)).alias("child"))
    return kids.groupBy("child").agg(F.count(F.lit(1)).alias("parents"), F.min("cell").alias("cell")).groupBy("cell", "parents").count()


@query(f"WITH {_GRADIENT}, steeper AS (SELECT * FROM gradients WHERE gradient > {adaptive.STEEP!r}), {_children('steeper')}, mesh AS (SELECT cell, cell AS base_cell, 8 AS resolution FROM gradients WHERE gradient <= {adaptive.STEEP!r} UNION ALL SELECT kid, own, 9 FROM kids) SELECT cell, base_cell, CAST(resolution AS INT) AS resolution, resolution = 9 AS refined FROM mesh")
def adaptive_mesh(spark: SparkSession, sf_dir: str) -> DataFrame:
    cells = _receiver_cells(spark, sf_dir)
    mesh = adaptive.mesh(cells, adaptive.targets(dem.local_gradient(cells.select("cell", "elevation")), b.RESOLUTION, 9), b.RESOLUTION)
    return mesh.select("cell", "base_cell", "resolution", "refined")


# --- elevation ------------------------------------------------------------------------------------

_POINTS = f"{PIXELS}, points AS (SELECT r AS pr, c AS pc, value, {b.NORTH!r}e0 - (r + 0.5e0) * {b.PX!r}e0 AS lat, {b.WEST!r}e0 + (c + 0.5e0) * {b.PX!r}e0 AS lon FROM pixels)"
_ANCHORS = f"""{_CENTRES}, {_POINTS}, {_located('placed', 'points')}, offs AS (SELECT cell, pr, pc, value, lat, lon, {_lat('r')} AS lat0, {_lon('q', 'r')} AS lon0 FROM placed),
local_xy AS (SELECT *, (lon - lon0) * {_M!r}e0 * greatest(cos(radians(lat0)), 1e-6) AS x, (lat - lat0) * {_M!r}e0 AS y, (lat - lat0) * (lat - lat0) + (lon - lon0) * (lon - lon0) AS d FROM offs),
deep AS (SELECT *, CASE WHEN {_E8 * _R3 / 2!r}e0 - greatest(abs(x), abs(x * 0.5e0 + y * {_R3 / 2!r}e0), abs(x * 0.5e0 - y * {_R3 / 2!r}e0)) >= 10e0 THEN 1 ELSE 0 END AS inside FROM local_xy),
best AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY cell ORDER BY inside DESC, value DESC, d, pr, pc) AS n FROM deep) WHERE n = 1),
anchored AS (SELECT c.cell, coalesce(b.value, p.value, 0e0) AS elevation, coalesce(b.lat, c.lat) AS los_lat, coalesce(b.lon, c.lon) AS los_lon FROM centres c LEFT JOIN best b USING (cell) LEFT JOIN pixels p ON p.r = floor(({b.NORTH!r}e0 - c.lat) / {b.PX!r}e0) AND p.c = floor((c.lon - {b.WEST!r}e0) / {b.PX!r}e0))"""


@query(f"WITH {_ANCHORS} SELECT cell, elevation, {_s('los_lat', 7)} AS lat7, {_s('los_lon', 7)} AS lon7 FROM anchored")
def cell_anchor(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = dem.anchors(_receiver_cells(spark, sf_dir), b.raster(spark, sf_dir), b.RESOLUTION)
    return found.select("cell", "elevation", scaled(F.col("los_lat"), 7).alias("lat7"), scaled(F.col("los_lon"), 7).alias("lon7"))


_HX, _HY = b.PX / 2 * _M * _C, b.PX / 2 * _M


@query(f"""WITH {_POINTS}, {_located('placed', 'points')}, around AS (SELECT value, lat, lon, q + dq AS q, r + dr AS r FROM placed, range(-2, 3) x(dq), range(-2, 3) y(dr) WHERE abs(dq + dr) <= 2),
apart AS (SELECT value, q, r, (lon - {_lon('q', 'r')}) * {_M * _C!r}e0 AS x, (lat - {_lat('r')}) * {_M!r}e0 AS y FROM around)
SELECT CAST(8 AS BIGINT) * 72057594037927936 + (q + 134217728) * 268435456 + (r + 134217728) AS cell, max(value) AS elevation, count(*) AS pixels FROM apart
WHERE abs(x) < {_HX + _E8 * _R3 / 2!r}e0 AND abs(y) < {_HY + _E8!r}e0 AND abs(x * 0.5e0 + y * {_R3 / 2!r}e0) < {_E8 * _R3 / 2 + _HX * 0.5 + _HY * _R3 / 2!r}e0 AND abs(x * 0.5e0 - y * {_R3 / 2!r}e0) < {_E8 * _R3 / 2 + _HX * 0.5 + _HY * _R3 / 2!r}e0 GROUP BY cell""")
def cell_max_touched(spark: SparkSession, sf_dir: str) -> DataFrame:
    touched = dem.touched_cells(b.raster(spark, sf_dir), b.RESOLUTION)
    return dem.highest(touched).join(touched.groupBy("cell").agg(F.count(F.lit(1)).alias("pixels")), "cell")


_PEAKS = f"""ends AS (SELECT *, (lat1, lon1) > (lat2, lon2) AS flip FROM pairs),
walk AS (SELECT *, CASE WHEN flip THEN lat2 ELSE lat1 END AS lata, CASE WHEN flip THEN lon2 ELSE lon1 END AS lona, CASE WHEN flip THEN lat1 ELSE lat2 END AS latb, CASE WHEN flip THEN lon1 ELSE lon2 END AS lonb FROM ends),
px AS (SELECT id1, id2, flip, ({b.NORTH!r}e0 - lata) / {b.PX!r}e0 - 0.5e0 AS ra, ({b.NORTH!r}e0 - latb) / {b.PX!r}e0 - 0.5e0 AS rb, (lona - {b.WEST!r}e0) / {b.PX!r}e0 - 0.5e0 AS ca, (lonb - {b.WEST!r}e0) / {b.PX!r}e0 - 0.5e0 AS cb FROM walk),
counted AS (SELECT *, CAST(greatest(ceil(abs(rb - ra)), ceil(abs(cb - ca)), 1) * 2 AS BIGINT) AS n FROM px),
steps AS (SELECT id1, id2, flip, i / CAST(n AS DOUBLE) AS t, round_even(ra + (rb - ra) * (i / CAST(n AS DOUBLE)), 0) AS sr, round_even(ca + (cb - ca) * (i / CAST(n AS DOUBLE)), 0) AS sc FROM counted, LATERAL (SELECT unnest(range(0, n + 1)) AS i)),
tops AS (SELECT * FROM (SELECT id1, id2, CASE WHEN flip THEN 1 - t ELSE t END AS f, value, row_number() OVER (PARTITION BY id1, id2 ORDER BY value DESC, abs(t - 0.5e0), t) AS n FROM steps JOIN pixels ON r = sr AND c = sc) WHERE n = 1),
ground AS (SELECT w.id1, w.id2, coalesce(x.value, 0e0) AS e1, coalesce(y.value, 0e0) AS e2 FROM pairs w LEFT JOIN pixels x ON x.r = floor(({b.NORTH!r}e0 - w.lat1) / {b.PX!r}e0) AND x.c = floor((w.lon1 - {b.WEST!r}e0) / {b.PX!r}e0) LEFT JOIN pixels y ON y.r = floor(({b.NORTH!r}e0 - w.lat2) / {b.PX!r}e0) AND y.c = floor((w.lon2 - {b.WEST!r}e0) / {b.PX!r}e0)),
peaks AS (SELECT id1, id2, coalesce(value, greatest(e1, e2)) AS peak_m, coalesce(f, CASE WHEN e2 > e1 THEN 1e0 ELSE 0e0 END) AS fraction FROM ground LEFT JOIN tops USING (id1, id2))"""


@query(f"WITH {PAIRS}, {PIXELS}, {_PEAKS} SELECT id1, id2, peak_m, {_s('fraction', 6)} AS fraction FROM peaks")
def line_peak(spark: SparkSession, sf_dir: str) -> DataFrame:
    of = spatial.kinds(b.towers(spark, sf_dir).select("id", "lat", "lon"))
    lines = _pairs(of).select(F.struct("id1", "id2").alias("id"), "lat1", "lon1", "lat2", "lon2")
    return _each(dem.line_peaks(lines, b.raster(spark, sf_dir)).select("id.id1", "id.id2", "peak_m", scaled(F.col("fraction"), 6).alias("fraction")), of)


# --- line of sight --------------------------------------------------------------------------------

_MAST = b.TIGHT.mast_height_m
_LINKS = f"{PAIRS}, {_vincenty()}, links AS (SELECT p.id1, p.id2, lat1, lon1, lat2, lon2, ground1 + 900e0 AS g1, ground2 + 900e0 AS g2, ground1 + 900e0 + {_MAST!r}e0 AS h1, ground2 + 900e0 + {_MAST!r}e0 AS h2, far FROM pairs p JOIN geodesics g USING (id1, id2))"


def _metrics(name: str, source: str) -> str:
    """A CTE with the metrics of profile points (id1, id2, f, terrain, far, h1, h2)."""
    return f"""{name}_g AS (SELECT *, f * far AS d1, far - f * far AS d2 FROM {source} WHERE far > 0), {name}_h AS (SELECT *, h1 + (h2 - h1) * f - d1 * d2 / {_CURVE!r}e0 - terrain AS geometric, sqrt({b.TIGHT.wavelength_m!r}e0 * d1 * d2 / far) AS radius FROM {name}_g),
{name} AS (SELECT *, geometric - radius AS clearance, CASE WHEN radius > 0 THEN greatest(0e0, least(1e0, (radius - geometric) / CASE WHEN radius > 0 THEN radius ELSE 1e0 END)) WHEN geometric < 0 THEN 1e0 ELSE 0e0 END AS obstruction FROM {name}_h)"""


def _decided(name: str, metrics: str) -> str:
    """A CTE with the summary of each pair's points, its loss and the decision."""
    d1, d2 = "CASE WHEN d1 <= 0 OR d2 <= 0 THEN far / 2 ELSE d1 END", "CASE WHEN d1 <= 0 OR d2 <= 0 THEN far / 2 ELSE d2 END"
    r1 = f"({physics.FRESNEL_CONSTANT!r}e0 * sqrt((({d1}) / 1000e0) * (({d2}) / 1000e0) / ({FREQUENCY / 1e6!r}e0 * (({d1}) / 1000e0 + ({d2}) / 1000e0))))"
    v = f"(sqrt(2e0) * abs(clearance) / {r1} - 0.1e0)"
    loss = f"CASE WHEN clearance >= 0 THEN {_fspl('far')} ELSE {_fspl('far')} + 6.9e0 + 20e0 * log10(sqrt({v} * {v} + 1e0) + {v}) END"
    return f"""{name}_w AS (SELECT *, row_number() OVER (PARTITION BY id1, id2 ORDER BY clearance, f) AS n, max(CASE WHEN f > 0 AND f < 1 THEN obstruction END) OVER (PARTITION BY id1, id2) AS inner_o, max(obstruction) OVER (PARTITION BY id1, id2) AS every_o FROM {metrics}),
{name}_l AS (SELECT id1, id2, far, clearance, coalesce(inner_o, every_o) AS obstruction, {loss} AS loss FROM {name}_w WHERE n = 1), {name} AS (SELECT *, loss <= {BUDGET!r}e0 AND obstruction <= {physics.MOST_OBSTRUCTION!r}e0 AS visible FROM {name}_l)"""


_FRACTION = "CASE WHEN size <= 1e-12 THEN 0e0 ELSE greatest(0e0, least(1e0, (pxx * dx + pyy * dy) / CASE WHEN size <= 1e-12 THEN 1e0 ELSE size END)) END"


def _coarse(fallback: bool) -> str:
    """CTEs up to ``coarse``, the decision over the cells of the grid path; cells that no tower stands in take the raster's value, or are left out."""
    at = lambda i: _located(f"end{i}", f"(SELECT id1 AS k1, id2 AS k2, lat{i} AS lat, lon{i} AS lon FROM links)")
    path = _rounded("path", "steps_c", "(q1 + sq * t + 1e-6)", "(r1 + sr * t + 2e-6)")
    value = "coalesce(k.elevation, p.value, 0e0)" if fallback else "k.elevation"
    raster = f"LEFT JOIN pixels p ON p.r = floor(({b.NORTH!r}e0 - s.lat) / {b.PX!r}e0) AND p.c = floor((s.lon - {b.WEST!r}e0) / {b.PX!r}e0)" if fallback else ""
    return f"""{_LINKS}, {at(1)}, {at(2)}, celled_links AS (SELECT l.*, a.cell AS cell1, a.q AS q1, a.r AS r1, c.cell AS cell2, c.q AS q2, c.r AS r2 FROM links l JOIN end1 a ON a.k1 = l.id1 AND a.k2 = l.id2 JOIN end2 c ON c.k1 = l.id1 AND c.k2 = l.id2),
gated AS (SELECT *, CASE WHEN cell1 = cell2 OR far = 0 THEN 'same' WHEN far > {b.TIGHT.max_visibility_m!r}e0 THEN 'distance' WHEN {_fspl('greatest(far, 1e-9)')} > {BUDGET!r}e0 THEN 'budget' ELSE 'profile' END AS gate FROM celled_links),
known AS (SELECT cell, max(elevation) AS elevation FROM (SELECT cell1 AS cell, g1 AS elevation FROM gated UNION ALL SELECT cell2, g2 FROM gated) GROUP BY cell),
opened AS (SELECT * FROM gated WHERE gate = 'profile'), spans AS (SELECT *, q2 - q1 AS sq, r2 - r1 AS sr, greatest(abs(q1 - q2), abs(r1 - r2), abs(q1 - q2 + r1 - r2)) AS n FROM opened),
steps_c AS (SELECT id1, id2, lat1, lon1, lat2, lon2, cell1, cell2, q1, r1, sq, sr, CASE WHEN n = 0 THEN 0e0 ELSE i / CAST(n AS DOUBLE) END AS t FROM spans, LATERAL (SELECT unnest(range(0, n + 1)) AS i)),
{path},
passed_cells AS (SELECT *, {_lat('r')} AS lat, {_lon('q', 'r')} AS lon FROM path WHERE cell <> cell1 AND cell <> cell2),
valued AS (SELECT s.*, {value} AS terrain FROM passed_cells s LEFT JOIN known k USING (cell) {raster}),
lined AS (SELECT *, (lon2 - lon1) * cos(radians((lat1 + lat2) / 2)) AS dx, lat2 - lat1 AS dy, (lon - lon1) * cos(radians((lat1 + lat2) / 2)) AS pxx, lat - lat1 AS pyy FROM valued WHERE terrain IS NOT NULL), sized AS (SELECT *, dx * dx + dy * dy AS size FROM lined),
profile AS (SELECT id1, id2, {_FRACTION} AS f, terrain FROM sized UNION ALL SELECT id1, id2, 0e0, g1 FROM opened UNION ALL SELECT id1, id2, 1e0, g2 FROM opened),
merged AS (SELECT id1, id2, round_even(f, 6) AS f, max(terrain) AS terrain FROM profile GROUP BY ALL), coarse_p AS (SELECT m.*, far, h1, h2 FROM merged m JOIN opened USING (id1, id2)), {_metrics('coarse_m', 'coarse_p')}, {_decided('coarse', 'coarse_m')}"""


_SHUT = f"SELECT id1, id2, {_s(f'{_MAST!r}e0')} AS clearance_mm, 0 AS loss, true AS visible, gate FROM gated WHERE gate = 'same' UNION ALL SELECT id1, id2, {_s(f'{los.BLOCKED_CLEARANCE!r}e0')}, CASE WHEN gate = 'distance' THEN {_s(f'{los.NO_LOSS!r}e0', 4)} ELSE {_s(_fspl('greatest(far, 1e-9)'), 4)} END, false, gate FROM gated WHERE gate IN ('distance', 'budget')"


def _shaped(found: DataFrame) -> DataFrame:
    return found.select("id1", "id2", scaled(F.col("clearance_m")).alias("clearance_mm"), scaled(F.col("path_loss_db"), 4).alias("loss"), "visible", "gate")


@query(f"WITH {_coarse(False)} {_SHUT} UNION ALL SELECT id1, id2, {_s('clearance')}, {_s('loss', 4)}, visible, 'coarse' FROM coarse")
def coarse_sight(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The decision without a raster: over the cells between two towers in which others stand."""
    of = _masts(spark, sf_dir)
    return _shaped(sightlines.sights(_pairs(of), of, b.TIGHT))


def _bilinear(name: str, source: str) -> str:
    """A CTE with the bilinear ``terrain`` of the rows of ``source`` (lat, lon)."""
    return f"""{name}_k AS (SELECT *, ({b.NORTH!r}e0 - lat) / {b.PX!r}e0 AS br, (lon - {b.WEST!r}e0) / {b.PX!r}e0 AS bc FROM {source}),
{name}_f AS (SELECT *, floor(br) AS r0, floor(bc) AS c0, br - floor(br) AS fr, bc - floor(bc) AS fc, floor(br) >= 0 AND floor(bc) >= 0 AND floor(bc) + 1 < {b.WIDTH} AS whole FROM {name}_k),
{name} AS (SELECT s.* EXCLUDE (br, bc, r0, c0, fr, fc, whole), CASE WHEN whole THEN (1 - fr) * (1 - fc) * coalesce(x1.value, 0) + (1 - fr) * fc * coalesce(x2.value, 0) + fr * (1 - fc) * coalesce(x3.value, 0) + fr * fc * coalesce(x4.value, 0) ELSE coalesce(x1.value, 0) END AS terrain
FROM {name}_f s LEFT JOIN pixels x1 ON x1.r = r0 AND x1.c = c0 LEFT JOIN pixels x2 ON x2.r = r0 AND x2.c = c0 + 1 LEFT JOIN pixels x3 ON x3.r = r0 + 1 AND x3.c = c0 LEFT JOIN pixels x4 ON x4.r = r0 + 1 AND x4.c = c0 + 1)"""


_STEP, _MOST = b.TIGHT.los_dense_sample_step_m, b.TIGHT.los_dense_max_samples
_DENSE = f"""passed AS (SELECT o.* FROM opened o JOIN coarse c USING (id1, id2) WHERE c.visible),
dense_n AS (SELECT *, CAST(least(greatest(2, floor(far / {_STEP!r}e0)), {max(_MOST, 2)}) AS BIGINT) AS n FROM passed),
dense_i AS (SELECT id1, id2, i / CAST(n AS DOUBLE) AS f, lat1 + (lat2 - lat1) * (i / CAST(n AS DOUBLE)) AS lat, lon1 + (lon2 - lon1) * (i / CAST(n AS DOUBLE)) AS lon FROM dense_n, LATERAL (SELECT unnest(range(1, n)) AS i)),
{_bilinear('dense_t', 'dense_i')},
dense_all AS (SELECT id1, id2, f, terrain FROM dense_t UNION ALL SELECT id1, id2, 0e0, g1 FROM passed UNION ALL SELECT id1, id2, 1e0, g2 FROM passed),
dense_p AS (SELECT d.*, far, h1, h2 FROM dense_all d JOIN passed USING (id1, id2)), {_metrics('dense_m', 'dense_p')},
first_o AS (SELECT id1, id2, coalesce(max(CASE WHEN f > 0 AND f < 1 THEN obstruction END), max(obstruction)) AS o FROM dense_m GROUP BY ALL),
good AS (SELECT p.* FROM passed p JOIN first_o USING (id1, id2) WHERE o <= {physics.MOST_OBSTRUCTION!r}e0),
near_w AS (SELECT m.id1, m.id2, m.f, m.far, lag(m.f) OVER w AS before, lead(m.f) OVER w AS after, count(*) OVER (PARTITION BY m.id1, m.id2) AS have, row_number() OVER (PARTITION BY m.id1, m.id2 ORDER BY m.obstruction DESC, m.clearance, m.f) AS rank FROM dense_m m JOIN good g ON g.id1 = m.id1 AND g.id2 = m.id2 WINDOW w AS (PARTITION BY m.id1, m.id2 ORDER BY m.f)),
gaps AS (SELECT *, coalesce(before, f) AS lo, coalesce(after, f) AS hi FROM near_w WHERE rank <= {los.WORST} AND have < {_MOST}),
more_n AS (SELECT *, CAST(floor((hi - lo) * far / {los.REFINE_STEP_M!r}e0) AS BIGINT) AS n FROM gaps WHERE hi > lo),
more_i AS (SELECT id1, id2, rank, have, i, lo + (hi - lo) * i / CAST(n AS DOUBLE) AS f FROM more_n, LATERAL (SELECT unnest(range(1, n)) AS i) WHERE n > 1),
more_k AS (SELECT *, row_number() OVER (PARTITION BY id1, id2 ORDER BY rank, i) AS place FROM more_i),
more_at AS (SELECT m.id1, m.id2, m.f, lat1 + (lat2 - lat1) * m.f AS lat, lon1 + (lon2 - lon1) * m.f AS lon FROM more_k m JOIN good USING (id1, id2) WHERE place <= {_MOST} - have),
{_bilinear('more_t', 'more_at')},
both_p AS (SELECT id1, id2, f, terrain FROM dense_m UNION ALL SELECT id1, id2, f, terrain FROM more_t),
final_g AS (SELECT id1, id2, round_even(f, 6) AS f, max(terrain) AS terrain FROM both_p GROUP BY ALL), final_p AS (SELECT m.*, far, h1, h2 FROM final_g m JOIN passed USING (id1, id2)), {_metrics('final_m', 'final_p')}, {_decided('final', 'final_m')}"""


@query(f"WITH {PIXELS}, {_coarse(True)}, {_DENSE} {_SHUT} UNION ALL SELECT id1, id2, {_s('clearance')}, {_s('loss', 4)}, visible, 'coarse' FROM coarse WHERE NOT visible UNION ALL SELECT id1, id2, {_s('clearance')}, {_s('loss', 4)}, visible, 'dense' FROM final")
def line_of_sight(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole decision: gates, coarse profile, dense profile with refinement."""
    of = _masts(spark, sf_dir)
    return _shaped(sightlines.sights(_pairs(of), of, b.TIGHT, b.raster(spark, sf_dir)))


@query(f"WITH {PIXELS}, {_LINKS}, {_PEAKS}, at_peak AS (SELECT k.id1, k.id2, fraction AS f, peak_m AS terrain, far, h1, h2 FROM peaks k JOIN links USING (id1, id2)), {_metrics('peak_metrics', 'at_peak')} SELECT k.id1, k.id2, coalesce(fraction > 0 AND fraction < 1 AND geometric < radius * 0.6e0, false) AS rejected FROM peaks k LEFT JOIN peak_metrics m USING (id1, id2)")
def shadow_prefilter(spark: SparkSession, sf_dir: str) -> DataFrame:
    of = _masts(spark, sf_dir)
    lines = _links(of).drop("ground1", "ground2")
    far = geo.geodesic_exact(F.col("lat1"), F.col("lon1"), F.col("lat2"), F.col("lon2"))
    peaks = dem.line_peaks(lines.select("id", "lat1", "lon1", "lat2", "lon2"), b.raster(spark, sf_dir))
    lines = cut(lines.withColumn("distance_m", far).join(peaks, "id").select("id1", "id2", "mast1", "mast2", "distance_m", "fraction", "peak_m"))
    # a peak is that of the places, only the grounds are the towers' own
    return _each(lines, of).select("id1", "id2", los.shadowed(b.TIGHT).alias("rejected"))


_NEAR = f"reach AS (SELECT v.id AS cell, t.id AS source, v.lat AS clat, v.lon AS clon, t.lat AS tlat, t.lon AS tlon FROM receivers v JOIN towers t ON abs(v.lat - t.lat) < 0.03 WHERE {_chord('v', 't')} <= {REACH_M})"


@query(f"WITH {RECEIVERS}, {TOWERS}, {_NEAR}, pairs AS (SELECT cell AS id1, source AS id2, clat AS lat1, clon AS lon1, tlat AS lat2, tlon AS lon2 FROM reach), {_vincenty()} SELECT id1 AS id, id2 AS tower FROM (SELECT *, row_number() OVER (PARTITION BY id1 ORDER BY far, id2) AS n FROM geodesics) WHERE n = 1")
def nearest_tower(spark: SparkSession, sf_dir: str) -> DataFrame:
    near = spatial.nearest(b.receivers(spark, sf_dir).select("id", "lat", "lon"), b.towers(spark, sf_dir).select("id", "lat", "lon"), REACH_M)
    return near.select(F.col("id1").alias("id"), F.col("id2").alias("tower"))


_RADIUS = min(REACH_M, b.TIGHT.max_coverage_radius_m)


@query(f"""WITH {RECEIVERS}, {TOWERS}, {PIXELS}, {_located('standing', 'towers')}, sources AS (SELECT id, ground, {_lat('r')} AS lat, {_lon('q', 'r')} AS lon FROM (SELECT q, r, min(id) AS id, arg_min(ground, id) + 950e0 AS ground FROM standing GROUP BY ALL)),
pairs AS (SELECT s.id AS id1, v.id AS id2, s.lat AS lat1, s.lon AS lon1, v.lat AS lat2, v.lon AS lon2, s.ground + {_MAST!r}e0 AS h1, v.ground + 900e0 + {b.TIGHT.coverage_receiver_height_m!r}e0 AS h2 FROM sources s JOIN receivers v ON abs(v.lat - s.lat) < 0.03 WHERE {_chord('s', 'v')} <= {_RADIUS}), {_vincenty()},
shade AS (SELECT p.*, far, CAST(least(greatest(2, floor(far / 50e0)), 400) AS BIGINT) AS n FROM pairs p JOIN geodesics USING (id1, id2)),
shots AS (SELECT id1, id2, far, h1, h2, i / CAST(n AS DOUBLE) AS t, lat1 + (lat2 - lat1) * (i / CAST(n AS DOUBLE)) AS lat, lon1 + (lon2 - lon1) * (i / CAST(n AS DOUBLE)) AS lon FROM shade, LATERAL (SELECT unnest(range(1, n)) AS i)),
clear AS (SELECT id1, id2, min(h1 + (h2 - h1) * t - t * far * (far - t * far) / {_CURVE!r}e0 - coalesce(value, 0e0)) AS clearance FROM shots LEFT JOIN pixels ON r = floor(({b.NORTH!r}e0 - lat) / {b.PX!r}e0) AND c = floor((lon - {b.WEST!r}e0) / {b.PX!r}e0) GROUP BY ALL),
tested AS (SELECT s.id1 AS source, s.id2 AS cell, far, CASE WHEN far <= 0 THEN 0e0 ELSE {_fspl('greatest(far, 1e-9)')} END AS loss, coalesce(clearance >= 0, true) AS free FROM shade s LEFT JOIN clear USING (id1, id2)),
seen AS (SELECT * FROM tested WHERE free AND loss <= {BUDGET!r}e0), served AS (SELECT cell, count(*) AS n_visible, min_by(source, (far, source)) AS closest_id, min_by(source, (loss, source)) AS serving_id, min(loss) AS loss FROM seen GROUP BY cell), any_near AS (SELECT cell, min_by(source, (far, source)) AS any_id FROM tested GROUP BY cell)
SELECT v.id AS cell, coalesce(n_visible, 0) AS n_visible, coalesce(closest_id, any_id) AS closest_id, serving_id, coalesce(n_visible > 0 AND {b.TIGHT.tx_power_dbm + 2 * b.TIGHT.antenna_gain_dbi!r}e0 - loss >= {b.TIGHT.receiver_sensitivity_dbm!r}e0, false) AS covered FROM receivers v LEFT JOIN served s ON s.cell = v.id LEFT JOIN any_near a ON a.cell = v.id""")
def terrain_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    of = spatial.kinds(b.receivers(spark, sf_dir).select("id", "lat", "lon", (F.col("ground") + 900.0).alias("elevation")))
    cells = of.rows.select(F.col("id").alias("cell"), "lat", "lon", "elevation")
    sources = coverage.snap_sources(b.towers(spark, sf_dir).select("id", "lat", "lon", (F.col("ground") + 950.0).alias("ground"), F.col("id").alias("ord")), b.RESOLUTION)
    found = coverage.tower_coverage(cells, sources, b.raster(spark, sf_dir), b.TIGHT, REACH_M)
    return spatial.each(found.select(F.col("cell").alias("id1"), "n_visible", "closest_id", "serving_id", "covered"), of).withColumnRenamed("id1", "cell")


# --- routes and corridors -------------------------------------------------------------------------

_LAYERS = 24
_GRAPH = f"{CELLS}, road AS (SELECT * FROM gridcells WHERE has_road), graph AS (SELECT a.cell AS src, c.cell AS dst, (1e0 + CASE WHEN abs(a.elevation - c.elevation) > 50 THEN 0.5e0 ELSE 0e0 END + CASE WHEN abs(a.elevation - c.elevation) > 100 THEN 1e0 ELSE 0e0 END) * greatest(abs(a.q - c.q), abs(a.r - c.r), abs(a.q - c.q + a.r - c.r)) AS cost FROM road a JOIN road c ON abs(a.q - c.q) <= 2 AND abs(a.r - c.r) <= 2 AND abs(a.q - c.q + a.r - c.r) <= 2)"
_RELAXED = ", ".join(["l0 AS MATERIALIZED (SELECT min(cell) AS node, 0e0 AS cost FROM road)", *[f"l{i} AS MATERIALIZED (SELECT dst AS node, min(l.cost + g.cost) AS cost FROM l{i - 1} l JOIN graph g ON g.src = l.node GROUP BY dst)" for i in range(1, _LAYERS + 1)]])


@query(f"WITH {_GRAPH}, {_RELAXED} SELECT node AS dst, cost FROM l{_LAYERS} WHERE cost > 0")
def shortest_routes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Costs of the cheapest routes from the first road cell to all the others; each path is checked to cost what it says."""
    cells = _receiver_cells(spark, sf_dir).where("has_road").select("cell", "elevation")
    edges = network.routing_graph(cells, 2)
    first = edges.agg(F.min("src").alias("src"))
    requests = edges.select(F.col("dst").alias("to")).distinct().join(F.broadcast(first)).where("to != src").select(F.col("to").alias("route"), "src", F.col("to").alias("dst"))
    return network.shortest_paths(edges, requests).select(F.col("route").alias("dst"), "cost")


_PLACES = f"{CORRIDORS}, spots AS (SELECT route, pos, value, 40e0 + ((cell * 7919) % 1000) / 10000e0 AS lat, 44e0 + ((cell * 104729) % 1000) / 10000e0 AS lon FROM corridors)"


def _places(spark: SparkSession, sf_dir: str) -> DataFrame:
    lat, lon = F.lit(40.0) + ((F.col("cell") * 7919) % 1000) / F.lit(10000.0), F.lit(44.0) + ((F.col("cell") * 104729) % 1000) / F.lit(10000.0)
    return b.corridors(spark, sf_dir).select("route", "pos", "value", lat.alias("lat"), lon.alias("lon"))


@query(f"WITH {_PLACES}, {_located('celled_spots', 'spots')}, ahead AS (SELECT route, pos, value, {_lat('r')} AS lat1, {_lon('q', 'r')} AS lon1, lead(value) OVER w AS v2, lead({_lat('r')}) OVER w AS lat2, lead({_lon('q', 'r')}) OVER w AS lon2 FROM celled_spots WINDOW w AS (PARTITION BY route ORDER BY pos)), pairs AS (SELECT route AS id1, pos AS id2, lat1, lon1, lat2, lon2, abs(v2 - value) AS rise FROM ahead WHERE v2 IS NOT NULL), {_vincenty()} SELECT g.id1 AS route, {_s('quantile_cont(rise / (far / 1000e0), 0.9)', 2)} AS p90 FROM geodesics g JOIN pairs p USING (id1, id2) WHERE far > 1 GROUP BY g.id1")
def slope_percentile(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = _places(spark, sf_dir).select("route", "pos", grid.cell_of(F.col("lat"), F.col("lon"), b.RESOLUTION).alias("cell"), F.col("value").cast("double").alias("elevation"))
    return corridor.slope_percentile(c).select("route", scaled(F.col("slope"), 2).alias("p90"))


@query(f"WITH {_PLACES}, pairs AS (SELECT a.route * 100 + a.pos AS id1, c.pos AS id2, a.lat AS lat1, a.lon AS lon1, c.lat AS lat2, c.lon AS lon2 FROM spots a JOIN spots c ON a.route = c.route AND a.pos < c.pos), {_vincenty()}, seen AS (SELECT *, max(CASE WHEN far > 5000 THEN 1 ELSE 0 END) OVER (PARTITION BY id1 ORDER BY id2 ROWS UNBOUNDED PRECEDING) AS past FROM geodesics) SELECT id1 // 100 AS route, count(*) AS pairs, {_s('max(far)')} AS most_mm FROM seen WHERE past = 0 GROUP BY id1 // 100")
def early_exit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Forward pairs of every corridor, up to the first that is farther than 5 km."""
    rows = _places(spark, sf_dir).select("route", "pos", "lat", "lon", F.lit(False).alias("unfit"))
    return placement.forward_pairs(rows, 5000.0).groupBy("route").agg(F.count(F.lit(1)).alias("pairs"), scaled(F.max("distance_m")).alias("most_mm"))


@query(f"WITH {_PLACES}, pairs AS (SELECT a.route * 100 + a.pos AS id1, c.pos AS id2, a.lat AS lat1, a.lon AS lon1, c.lat AS lat2, c.lon AS lon2 FROM spots a JOIN spots c ON a.route = c.route AND a.pos < c.pos), {_vincenty()}, seen AS (SELECT *, max(CASE WHEN far > 5000 THEN 1 ELSE 0 END) OVER (PARTITION BY id1 ORDER BY id2 ROWS UNBOUNDED PRECEDING) AS past FROM geodesics) SELECT id1 // 100 AS route, CAST(id1 % 100 AS INT) AS i, CAST(id2 AS INT) AS j, {_s('far')} AS far_mm FROM seen WHERE past = 0")
def forward_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every forward pair of every corridor, up to the first that is farther than 5 km."""
    rows = _places(spark, sf_dir).select("route", "pos", "lat", "lon", F.lit(False).alias("unfit"))
    return placement.forward_pairs(rows, 5000.0).select("route", F.col("i").cast("int").alias("i"), F.col("j").cast("int").alias("j"), scaled(F.col("distance_m")).alias("far_mm"))


@query(f"WITH {_CENTRES}, gap_ends AS (SELECT cell AS route, 'a' AS side, q, r FROM gridcells UNION ALL SELECT cell, 'b', q + 1, r FROM gridcells), tried AS (SELECT DISTINCT q, r, {_lat('r')} AS lat, {_lon('q', 'r')} AS lon FROM gap_ends), pairs AS (SELECT t.q * 1000000 + t.r AS id1, c.cell AS id2, t.lat AS lat1, t.lon AS lon1, c.lat AS lat2, c.lon AS lon2 FROM tried t JOIN centres c ON greatest(abs(t.q - c.q), abs(t.r - c.r), abs(t.q - c.q + t.r - c.r)) <= 6), {_vincenty()}, ranked AS (SELECT route, side, c.cell, row_number() OVER (PARTITION BY route, side ORDER BY c.elevation DESC, far, c.cell) AS n FROM gap_ends e JOIN geodesics g ON g.id1 = e.q * 1000000 + e.r JOIN gridcells c ON c.cell = g.id2 WHERE far <= 3500) SELECT route, side, cell FROM ranked WHERE n <= {placement.CANDIDATES}")
def top_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For a gap at every cell (to its eastern neighbour) the highest cells within 3.5 km of either end."""
    cells = _receiver_cells(spark, sf_dir).select("cell", "elevation")
    gaps = cells.select(F.col("cell").alias("route"), F.lit(0).alias("pos"), F.col("cell").alias("a"), grid.shifted(F.col("cell"), F.lit(1), F.lit(0)).alias("b"))
    return placement.gap_candidates(gaps, cells, 3500.0).select("route", "side", "cell")


@query(f"WITH {SITES} SELECT priority, CAST(row_number() OVER (PARTITION BY priority ORDER BY ord) AS INT) AS place, id FROM sites")
def sites_by_priority(spark: SparkSession, sf_dir: str) -> DataFrame:
    return placement.sites_by_priority(b.sites(spark, sf_dir)).select("priority", "place", "id")


# --- exports --------------------------------------------------------------------------------------


@query(f"WITH {CELLS}, {_located('standing', 'towers')} SELECT s.id AS tower_id, s.cell AS h3_index, CASE WHEN id % 3 = 0 THEN 'site' ELSE 'route' END AS source, id % 3 = 0 AS virtual, CASE WHEN id % 3 = 0 THEN 'site' ELSE 'dp' END AS algorithm, {_s('s.lat', 6)} AS lat6, {_s('s.lon', 6)} AS lon6, CASE WHEN g.cell IS NOT NULL THEN {_s(_lat('s.r'), 6)} END AS centroid6, {_s(f'{_MAST!r}e0 + CASE WHEN g.cell IS NOT NULL THEN 1.5e0 ELSE 0e0 END')} AS antenna_mm FROM standing s LEFT JOIN gridcells g USING (cell)".replace(f"WITH {CELLS}", f"WITH {TOWERS}, {CELLS}"))
def tower_export(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tower features, read back from their JSON."""
    from meshwright.sources import export

    t = b.towers(spark, sf_dir).withColumn("cell", grid.cell_of(F.col("lat"), F.col("lon"), b.RESOLUTION)).withColumn("source", F.when(F.col("id") % 3 == 0, "site").otherwise("route")).withColumn("algorithm", F.when(F.col("id") % 3 != 0, "dp"))
    cells = _receiver_cells(spark, sf_dir).select("cell", "elevation", F.lit(1.5).alias("offset_m"))
    schema = "properties struct<tower_id:long,h3_index:long,source:string,virtual:boolean,algorithm:string,lat:double,lon:double,centroid_lat:double,antenna_height_m:double>"
    rows = export.tower_features(t, cells, b.TIGHT.mast_height_m).select(F.from_json("feature", schema).alias("f")).select("f.properties.*")
    return rows.select("tower_id", "h3_index", "source", "virtual", "algorithm", scaled(F.col("lat"), 6).alias("lat6"), scaled(F.col("lon"), 6).alias("lon6"), scaled(F.col("centroid_lat"), 6).alias("centroid6"), scaled(F.col("antenna_height_m")).alias("antenna_mm"))


@query(f"WITH {_CENTRES} SELECT cell, 8 AS base_resolution, 8 AS resolution, has_road, elevation, 7 AS corners, {_s('lat + ' + repr(_E8 / _M) + 'e0', 6)} AS top6 FROM centres")
def grid_export(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Grid features, read back from their JSON: properties, number of corners and the highest latitude."""
    from meshwright.sources import export

    schema = "geometry struct<coordinates:array<array<array<double>>>>, properties struct<cell:long,base_resolution:int,resolution:int,has_road:boolean,elevation:double>"
    rows = export.grid_features(_receiver_cells(spark, sf_dir), b.RESOLUTION).select(F.from_json("feature", schema).alias("f"))
    ring = F.get("f.geometry.coordinates", F.lit(0))
    top = F.array_max(F.transform(ring, lambda p: F.get(p, F.lit(1))))
    return rows.select("f.properties.cell", "f.properties.base_resolution", "f.properties.resolution", "f.properties.has_road", "f.properties.elevation", F.size(ring).alias("corners"), scaled(top, 6).alias("top6"))
