"""Operators on DataFrames: as-of joins, panels, statistics, credit, stress tests, watch lists, tilted indexes, clustering."""
