"""Spatial joins: range, nearest and containment, as equi-joins on grid buckets."""

from __future__ import annotations

import dataclasses

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from meshwright.functions import geo
from meshwright.operators.stage import cut


def range_join(left: DataFrame, right: DataFrame, radius_m: float, distance: str = "chord_m", by: str | None = None) -> DataFrame:
    """Pairs of (id, lat, lon, ...) rows within a radius, by the straight distance through the sphere.

    Points are put into cubes of twice the radius about the earth's centre, so that poles and
    the antimeridian are like any other place.  The left side is repeated into the cubes that its ball touches, at
    most two in each direction; the join is on the cube, and the exact distance decides.
    Columns of the sides get the suffixes 1 and 2.  With ``by`` only rows with the same value of that column meet.
    """
    width, radius = F.lit(2.0 * radius_m), F.lit(float(radius_m))
    one = left.select([F.col(c).alias(f"{c}1") for c in left.columns])
    two = right.select([F.col(c).alias(f"{c}2") for c in right.columns])
    # a millimetre more, so that rounding loses no point on the rim
    near = lambda v, sign: F.floor((v + F.lit(sign) * (radius + F.lit(1e-3))) / width)
    for axis, v in zip("xyz", geo.xyz(F.col("lat1"), F.col("lon1")), strict=True):
        one = one.withColumn(f"__{axis}", v)
    for axis in "xyz":
        one = one.withColumn(f"__c{axis}", F.explode(F.sequence(near(F.col(f"__{axis}"), -1.0), near(F.col(f"__{axis}"), 1.0))))
    for axis, v in zip("xyz", geo.xyz(F.col("lat2"), F.col("lon2")), strict=True):
        two = two.withColumn(f"__{axis}2", v).withColumn(f"__d{axis}", F.floor(F.col(f"__{axis}2") / width))
    met = (F.col("__cx") == F.col("__dx")) & (F.col("__cy") == F.col("__dy")) & (F.col("__cz") == F.col("__dz"))
    joined = one.join(two, met & (F.col(f"{by}1") == F.col(f"{by}2")) if by else met)
    gap = [(F.col(f"__{axis}") - F.col(f"__{axis}2")) * (F.col(f"__{axis}") - F.col(f"__{axis}2")) for axis in "xyz"]
    found = joined.withColumn(distance, F.sqrt(gap[0] + gap[1] + gap[2])).where(F.col(distance) <= radius)
    return found.drop(*[f"__{k}{axis}" for k in ("", "c", "d") for axis in "xyz"], *[f"__{axis}2" for axis in "xyz"])


def pairs_within(points: DataFrame, radius_m: float) -> DataFrame:
    """Unordered pairs (id1 < id2) of points within a radius."""
    return range_join(points, points, radius_m).where("id1 < id2")


#: Members of a kind that stay together when pairs of kinds are repeated for their members, and where they are handed on as arrays.
PART, PACK = 1000, 250


@dataclasses.dataclass(frozen=True)
class Kinds:
    """Rows that differ in nothing but their id: ``rows`` (the columns, the least ``id``, ``last``, ``n``), and ``members`` (id, kind, part); no members where most rows are alone.

    Columns of their ``own`` may differ too: they are with the members, and their largest values with the rows.
    """

    rows: DataFrame
    members: DataFrame | None
    own: tuple[str, ...] = ()
    size: int = PART


def kinds(rows: DataFrame, own: tuple[str, ...] = ()) -> Kinds:
    """The kinds of rows (id, ...), so that what depends on the other columns is computed once a kind."""
    names = [c for c in rows.columns if c != "id" and c not in own]
    found = cut(rows.groupBy(*names).agg(F.min("id").alias("id"), F.max("id").alias("last"), F.count(F.lit(1)).alias("n"), *[F.max(c).alias(c) for c in own]))
    if not own and 2 * found.count() > rows.count():
        return Kinds(rows.withColumn("last", F.col("id")).withColumn("n", F.lit(1).cast("long")), None)
    size = PACK if own else PART
    kept = found.select(*[F.col(c).alias(f"__{c}") for c in names], F.col("id").alias("kind"), F.ceil(F.col("n") / size).alias("__parts"))
    met = F.lit(True)
    for c in names:
        met = met & F.col(c).eqNullSafe(F.col(f"__{c}"))
    return Kinds(found, cut(rows.join(kept, met).select("id", *own, "kind", F.pmod(F.xxhash64("id"), F.col("__parts")).alias("part"))), own, size)


def spread(spark: SparkSession) -> int:
    """Partitions for work that is many times larger than its input, which Spark would deal by the bytes of the input."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), 8 * spark.sparkContext.defaultParallelism)


def kind_pairs(of: Kinds, radius_m: float) -> DataFrame:
    """Directed pairs of kinds within a radius, a kind with itself too, where a member of the first has a smaller id than one of the second."""
    return place_join(of.rows, of.rows, radius_m).where("id1 < last2").drop("n1", "n2", "last1", "last2")


def place_join(left: DataFrame, right: DataFrame, radius_m: float) -> DataFrame:
    """``range_join`` of tables with many rows a place: places are joined, and their pairs dealt evenly before rows meet."""
    places = [rows.select(F.monotonically_increasing_id().alias("id"), "lat", "lon") for rows in (left.select("lat", "lon").distinct(), right.select("lat", "lon").distinct())]
    near = range_join(*places, radius_m).select("lat1", "lon1", "lat2", "lon2", "chord_m")
    near = near.repartition(spread(left.sparkSession), "lat1", "lon1", "lat2", "lon2")
    for side, rows in (("1", left), ("2", right)):
        own = rows.select(*[F.col(c).alias(f"__{c}" if c in ("lat", "lon") else f"{c}{side}") for c in rows.columns])
        near = near.join(own, (F.col(f"lat{side}") == F.col("__lat")) & (F.col(f"lon{side}") == F.col("__lon"))).drop("__lat", "__lon")
    return near


def each(found: DataFrame, first: Kinds | None = None, second: Kinds | None = None, ordered: bool = False) -> DataFrame:
    """Rows about kinds (id1, id2, ...), repeated for their members: of both sides or of one; ``ordered`` keeps the pairs with id1 < id2.

    Pairs of kinds are dealt by hash in parts of bounded size, so that a large kind is spread over tasks.
    """
    sides = [(side, k) for side, k in (("1", first), ("2", second)) if k is not None and k.members is not None]
    if not sides:
        return found.where("id1 < id2") if ordered else found
    out = _dealt(found, sides)
    for side, k in sides:
        own = k.members.select(F.col("id").alias(f"__id{side}"), *[F.col(c).alias(f"{c}{side}") for c in k.own], F.col("kind").alias(f"__m{side}"), F.col("part").alias(f"__q{side}"))
        out = out.join(own, (F.col(f"id{side}") == F.col(f"__m{side}")) & (F.col(f"__p{side}") == F.col(f"__q{side}")))
    low, high = ("__id1" if "1" in dict(sides) else "id1"), ("__id2" if "2" in dict(sides) else "id2")
    out = out.where(F.col(low) < F.col(high)) if ordered else out
    named = {f"id{side}": F.col(f"__id{side}").alias(f"id{side}") for side, _ in sides}
    return out.select(*[named.get(c, F.col(c)) for c in found.columns], *[f"{c}{side}" for side, k in sides for c in k.own])


def _dealt(found: DataFrame, sides: list[tuple[str, Kinds]]) -> DataFrame:
    """``found`` once for each part of the kinds of its sides (__p1, __p2), dealt by hash."""
    out = found
    for side, k in sides:
        parts = k.rows.select(F.col("id").alias(f"__k{side}"), F.explode(F.sequence(F.lit(0).cast("long"), F.ceil(F.col("n") / k.size) - 1)).alias(f"__p{side}"))
        out = out.join(parts, F.col(f"id{side}") == F.col(f"__k{side}"))
    return out.repartition(spread(found.sparkSession), *[c for c in ("id1", "id2") if c in found.columns], *[f"__p{side}" for side, _ in sides])


def packs(found: DataFrame, of: Kinds) -> DataFrame:
    """Rows about pairs of kinds (id1, id2, ...) with their members as arrays (ids1, own1, ids2, own2), a part of each at a time; ``of`` has one column of its own."""
    sides = [("1", of), ("2", of)]
    packed = cut(of.members.groupBy("kind", "part").agg(F.collect_list(F.struct("id", F.col(of.own[0]).alias("own"))).alias("m")))
    out = _dealt(found, sides)
    for side, _ in sides:
        own = packed.select(F.col("m.id").alias(f"ids{side}"), F.col("m.own").alias(f"own{side}"), F.col("kind").alias(f"__m{side}"), F.col("part").alias(f"__q{side}"))
        out = out.join(own, (F.col(f"id{side}") == F.col(f"__m{side}")) & (F.col(f"__p{side}") == F.col(f"__q{side}")))
    return out.select(*found.columns, "ids1", "own1", "ids2", "own2")


#: Where a search for the nearest begins, and how much larger each round is; beyond the last all sites are in reach.
FIRST_M, LARGER, WHOLE_M = 5000.0, 4.0, 12_800_000.0
#: A chord on the sphere is at most so many times the geodesic.
CHORD = 1.01


def nearest(points: DataFrame, sites: DataFrame, radius_m: float | None = None, k: int = 1, allowed: Column | None = None) -> DataFrame:
    """The k sites nearest to each point by geodesic distance, ties to the smaller ``ord`` (else id); rank from 1.

    With a radius only sites within it count.  Without one the search widens: points that have their k sites well within a
    radius are done, the others look farther, so that each meets the sites about it and not all there are.  ``allowed`` says which
    pairs count (columns with the suffixes 1 and 2).
    """
    order = "ord2" if "ord" in sites.columns else "id2"
    far = geo.geodesic_m(F.col("lat1"), F.col("lon1"), F.col("lat2"), F.col("lon2"))
    place = F.row_number().over(W.partitionBy("id1").orderBy("distance_m", order))

    if allowed is None:
        # a place looks once, and only its first k sites can be among a point's k nearest
        sites = sites.withColumn("__n", F.row_number().over(W.partitionBy("lat", "lon").orderBy(order[:-1]))).where(F.col("__n") <= k).drop("__n")
        spots = points.groupBy("lat", "lon").agg(F.min("id").alias("id"))
        whole, points = points, spots

    def within(some: DataFrame, reach: float) -> DataFrame:
        pairs = range_join(some, sites, reach)
        pairs = pairs if allowed is None else pairs.where(allowed)
        return pairs.withColumn("distance_m", far).withColumn("rank", place).where(F.col("rank") <= k)

    def told(near: DataFrame) -> DataFrame:
        if allowed is not None:
            return near
        own = whole.select(*[F.col(c).alias(f"{c}1") for c in whole.columns])
        near = near.drop("id1").withColumnRenamed("lat1", "__lat").withColumnRenamed("lon1", "__lon")
        rest = [c for c in near.columns if c not in ("__lat", "__lon")]
        return own.join(near, (F.col("lat1") == F.col("__lat")) & (F.col("lon1") == F.col("__lon"))).select(*own.columns, *rest)

    if radius_m is not None:
        return told(within(points, radius_m))
    found, left, reach = None, cut(points), FIRST_M
    while True:
        near = cut(within(left, reach))
        last = reach >= WHOLE_M
        done = near if last else near.join(near.groupBy(F.col("id1").alias("__id")).agg(F.count(F.lit(1)).alias("__n"), F.max("distance_m").alias("__far")).where((F.col("__n") == k) & (F.col("__far") <= reach / CHORD)), F.col("id1") == F.col("__id"), "left_semi")
        found = done if found is None else found.unionByName(done)
        if last:
            return told(found)
        left = cut(left.join(done.select(F.col("id1").alias("__id")).distinct(), F.col("id") == F.col("__id"), "left_anti"))
        if left.isEmpty():
            return told(found)
        reach = min(reach * LARGER, WHOLE_M)


#: Degrees of the smallest tile, and tiles that a polygon's box is cut into at most in each direction.
TILE_DEG, TILES = 0.05, 8


def within_polygons(points: DataFrame, polygons: DataFrame) -> DataFrame:
    """``points`` (id, lat, lon, ...) with ``inside``: whether any polygon (rings) holds the point; boundaries do not count.

    A polygon's box is cut into a few tiles, of twice the size for each level that it is larger by; points look up their tile of every level
    there is, so that each meets the polygons about it only.
    """
    boxes = polygons.select("rings", *_box(F.get("rings", F.lit(0)))).where("s is not null")
    span = F.greatest(F.col("n") - F.col("s"), F.col("e") - F.col("w"), F.lit(TILE_DEG))
    level = F.greatest(F.lit(0), F.ceil(F.log2(span / (TILE_DEG * (TILES - 1))))).cast("int")
    width = F.lit(TILE_DEG) * F.pow(F.lit(2.0), F.col("level"))
    tile = lambda c: F.floor(c / width)
    tiled = cut(boxes.withColumn("level", level).withColumn("tx", F.explode(F.sequence(tile(F.col("w")), tile(F.col("e"))))).withColumn("ty", F.explode(F.sequence(tile(F.col("s")), tile(F.col("n"))))))
    levels = [r[0] for r in tiled.select("level").distinct().collect()]  # no more than fit between a tile and the earth
    asked = points.select(F.col("id").alias("__id"), F.col("lat").alias("__lat"), F.col("lon").alias("__lon"), F.explode(F.array(*[F.lit(x) for x in levels]).cast("array<int>")).alias("level"))
    asked = asked.withColumn("px", tile(F.col("__lon"))).withColumn("py", tile(F.col("__lat"))).withColumnRenamed("level", "pl")
    hits = asked.join(tiled, (F.col("pl") == F.col("level")) & (F.col("px") == F.col("tx")) & (F.col("py") == F.col("ty")))
    hits = hits.where((F.col("__lat") > F.col("s")) & (F.col("__lat") < F.col("n")) & (F.col("__lon") > F.col("w")) & (F.col("__lon") < F.col("e")))
    hits = hits.where(geo.in_polygon(F.col("__lat"), F.col("__lon"), F.col("rings"))).select("__id").distinct()
    return points.join(hits, F.col("id") == F.col("__id"), "left").withColumn("inside", F.col("__id").isNotNull()).drop("__id")


def _box(ring: Column) -> list[Column]:
    lat, lon = F.transform(ring, lambda p: p["lat"]), F.transform(ring, lambda p: p["lon"])
    return [F.array_min(lat).alias("s"), F.array_max(lat).alias("n"), F.array_min(lon).alias("w"), F.array_max(lon).alias("e")]


def within_adaptive(cells: DataFrame, centres: DataFrame, radius_m: float, most_edge_m: float) -> DataFrame:
    """(centre, id): cells within radius + both edges of a centre, by chord; a radius of 0 or less gives the centre itself.

    ``cells`` and ``centres`` have id, lat, lon and edge.
    """
    own = centres.select(F.col("id").alias("centre"), "id")
    if radius_m <= 0:
        return own
    near = range_join(cells, centres, radius_m + 2 * most_edge_m).where(F.col("chord_m") <= F.lit(radius_m) + F.col("edge1") + F.col("edge2"))
    return near.select(F.col("id2").alias("centre"), F.col("id1").alias("id")).union(own).distinct()


def union_within(cells: DataFrame, centres: DataFrame, radius_m: float, most_edge_m: float) -> DataFrame:
    """(id): the union of ``within_adaptive`` over all centres."""
    return within_adaptive(cells, centres, radius_m, most_edge_m).select("id").distinct()
