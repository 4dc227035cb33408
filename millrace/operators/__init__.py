"""Relational operators: lookups, searches, aggregates, sorts, keyed state, grids and rasters."""
