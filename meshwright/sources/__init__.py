"""Readers: GeoJSON, routes, rasters and grid bundles."""
