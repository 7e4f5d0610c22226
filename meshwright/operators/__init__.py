"""Set-at-a-time operators on DataFrames: joins, elevation, line of sight, graphs, coverage, placement."""
