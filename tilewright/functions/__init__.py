"""Scalar functions over columns: names and paths, numbers, geometry, maps and JSON."""
