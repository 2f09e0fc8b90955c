"""Region codes across classification vintages: code tables and spatial overlap."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import region_code
from .components import components, extended


def extract_codes(table: DataFrame) -> DataFrame:
    """Region codes out of free text in every column; rows without a code in each column are dropped."""
    return table.select(*[region_code(c).alias(c) for c in table.columns]).dropna("any")


def _full_join(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    # Rows a former step left without this code would all meet in one task; each gets a key of its own instead.
    own = F.concat(F.lit("\0"), F.xxhash64(*left.columns).cast("string"))
    keyed = left.withColumn("_key", F.coalesce(key, own)).drop(key)
    joined = keyed.join(right.withColumnRenamed(key, "_key"), "_key", "full")
    code = F.when(~F.col("_key").startswith("\0"), F.col("_key"))
    return joined.withColumn(key, code).drop("_key")


def crosswalk_chain(tables: Sequence[DataFrame]) -> DataFrame:
    """Full outer chain of (older, newer) code tables; each shares its first column with the table before.

    Columns come newest vintage first.
    """
    vintages = [tables[0].columns[0], *[t.columns[1] for t in tables]]
    chained = reduce(lambda left, right: _full_join(left, right, right.columns[0]), tables)
    return chained.select(*reversed(vintages))


def harmonise_codes(tables: Sequence[DataFrame]) -> DataFrame:
    return crosswalk_chain([extract_codes(t) for t in tables])


def _node(vintage: str) -> Column:
    return F.when(F.col(vintage).isNotNull(), F.struct(F.lit(vintage).alias("vintage"), F.col(vintage).alias("code")))


def harmonised_ids(tables: Sequence[DataFrame]) -> DataFrame:
    """(vintage, code, area_vintage, area_code): one name per area for its codes in all vintages.

    Each table links (older, newer) codes that are the same area, in whole or in part; a code may split into several and
    several may merge into one. Codes that links join, directly or over other vintages, are one area, named by its
    smallest vintage and code. Vintages are taken one after the other: a new one works on its own links and on the areas
    they join, not on all former links. A code without a partner in a table is an area of its own if no other table
    links it.
    """
    known = None
    for table in tables:
        older, newer = (_node(c) for c in table.columns)
        # A code without a partner is linked with itself.
        links = table.select(F.coalesce(older, newer).alias("a"), F.coalesce(newer, older).alias("b"))
        known = components(links) if known is None else extended(known, links)
    return known.select("node.vintage", "node.code", F.col("component.vintage").alias("area_vintage"), F.col("component.code").alias("area_code"))


def sort_by_length(df: DataFrame, col: str) -> DataFrame:
    """Shorter codes first, equal lengths by value, missing codes last."""
    return df.orderBy(F.length(col).asc_nulls_last(), F.col(col).asc_nulls_last())


def largest_overlap(a_cells: DataFrame, b_cells: DataFrame) -> DataFrame:
    """For every region of `a` the region of `b` that shares the largest area with it, NULL if none does.

    Regions are given as (region, cell_x, cell_y[, area]) rows; of equally large overlaps the lower code counts.
    """
    area = F.col("area") if "area" in a_cells.columns else F.lit(1.0)
    a = a_cells.select("cell_x", "cell_y", "region", area.alias("area"))
    b = b_cells.select("cell_x", "cell_y", F.col("region").alias("other"))
    shared = a.join(b, ["cell_x", "cell_y"], "left").groupBy("region", "other").agg(F.sum("area").alias("overlap"))
    size = F.when(F.col("other").isNotNull(), F.struct(-F.col("overlap"), "other"))
    return shared.groupBy("region").agg(
        F.min_by("other", size).alias("other"), F.min_by("overlap", size).alias("overlap")
    )


def crosswalk_by_overlap(base: DataFrame, vintages: Mapping[str, DataFrame], base_tag: str) -> DataFrame:
    """Regions of `base` with their largest-overlap partner in each vintage, in columns `region-<tag>`."""
    start = base.select("region").distinct()
    steps = [
        largest_overlap(base, cells).select("region", F.col("other").alias(f"region-{tag}"))
        for tag, cells in vintages.items()
    ]
    wide = reduce(lambda left, right: left.join(right, "region", "left"), steps, start)
    return wide.withColumnRenamed("region", f"region-{base_tag}")
