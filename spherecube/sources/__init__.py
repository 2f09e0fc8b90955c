"""Readers and writers."""

from .readers import (
    cube_from_arrays, cube_from_matrix, literal_table, read_axis, read_csv_dir, read_feature_catalog, read_indicators,
    read_region_levels, read_region_table,
)
from .sinks import read_cube, split_write, write_cube, write_table_csv

__all__ = [
    "cube_from_arrays", "cube_from_matrix", "literal_table", "read_axis", "read_csv_dir", "read_cube",
    "read_feature_catalog", "read_indicators", "read_region_levels", "read_region_table", "split_write", "write_cube",
    "write_table_csv",
]
