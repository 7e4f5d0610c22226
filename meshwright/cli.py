"""Plan a mesh: python -m meshwright.cli CONFIG [--output FOLDER], or from ready routes:
python -m meshwright.cli routes --routes FILE --grid-bundle FOLDER [--city-boundaries FILE] [--output FOLDER]."""

from __future__ import annotations

import argparse
import sys

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from meshwright.config import OUTPUT_NAMES, load_yaml, output_path
from meshwright.functions import grid
from meshwright.operators import adaptive, sightbook
from meshwright.plans import mesh, routes
from meshwright.sources import geojson, raster


def routes_main(args: list[str]) -> None:
    """Towers along the routes of a file, over the cells of a grid bundle."""
    parser = argparse.ArgumentParser(prog="meshwright.cli routes")
    parser.add_argument("--routes", required=True)
    parser.add_argument("--grid-bundle", required=True)
    parser.add_argument("--city-boundaries")
    parser.add_argument("--output", default="output")
    parser.add_argument("--debug-snapshots", help="a folder for one JSON text a route")
    parser.add_argument("--sight-book", help="a folder that keeps answers about sight between runs")
    given = parser.parse_args(args)
    spark = SparkSession.builder.appName("meshwright-routes").getOrCreate()
    config, found = routes.load(spark, given.routes)
    meta, static = raster.read_bundle(spark, given.grid_bundle)
    cells = adaptive.from_static(static, config).withColumn("lat", grid.lat_of(F.col("cell"))).withColumn("lon", grid.lon_of(F.col("cell")))
    terrain = raster.load(spark, raster.elevation_of(meta, given.grid_bundle)) if meta["elevation_path"] else None
    cities = geojson.load_cities(spark, given.city_boundaries) if given.city_boundaries else None
    told = meta["metadata"].get("elevation_file")
    book = sightbook.SightBook(spark, given.sight_book, raster.stable_sha256([meta["elevation_path"], told])) if given.sight_book else None
    made = routes.run_routes(spark, found, mesh.marked(cells, cities), config, terrain, cities, None, max(meta["metadata"]["resolution_set"]), book)
    mesh.write_plan(made, {name: output_path(name, {}, given.output) for name in OUTPUT_NAMES}, config)
    if given.debug_snapshots:
        routes.write_snapshots(made, given.debug_snapshots)
    print(made["report"].toPandas().to_string(index=False))
    if book is not None:
        print(book.summary().toPandas().to_string(index=False))


def main(args: list[str] | None = None) -> None:
    args = sys.argv[1:] if args is None else args
    if args[:1] == ["routes"]:
        return routes_main(args[1:])
    parser = argparse.ArgumentParser(description=__doc__)
    parser.add_argument("config")
    parser.add_argument("--output")
    given = parser.parse_args(args)
    plan = load_yaml(given.config)
    config, inputs = plan["parameters"], plan["inputs"]
    spark = SparkSession.builder.appName("meshwright").getOrCreate()
    terrain = raster.load(spark, inputs.elevation) if inputs.elevation else None
    cities = geojson.load_cities(spark, inputs.city_boundaries) if inputs.city_boundaries else None
    standing = geojson.load_towers(spark, inputs.existing_towers, config.h3_resolution) if inputs.existing_towers else None
    made = mesh.plan_mesh(spark, config, geojson.load_boundary(spark, inputs.boundary), geojson.load_roads(spark, inputs.roads), geojson.load_sites(spark, inputs.sites, config.h3_resolution), terrain, cities, standing)
    mesh.write_plan(made, {name: output_path(name, plan["outputs"], given.output) for name in OUTPUT_NAMES}, config)
    print(made["report"].toPandas().to_string(index=False))


if __name__ == "__main__":
    main()
