"""Cubes as dense tiles: blocks of regions x times as arrays, in folders that a slice reads alone."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.keys import assign_id
from ..operators.reshape import conformed_rows, laid_out
from ..runtime import materialise

#: Regions and times of a tile.
REGIONS, TIMES = 1024, 8

#: Folders of a cube, about; with more tiles, neighbouring ones of a time share a folder, in order.
FOLDERS = 64


def _axis(dim: DataFrame) -> DataFrame:
    """(label, place): the labels of an axis (label, ord) numbered from 0 without holes."""
    return assign_id(dim.select("ord", "label"), ["ord", "label"], "_id").select("label", (F.col("_id") - 1).alias("place"))


def write_tiles(
    series: DataFrame, dim_time: DataFrame, dim_geo: DataFrame, path: str, regions: int = REGIONS, times: int = TIMES
) -> str:
    """Every variable of (var, geo, time, values), brought to the full axes, as tiles of `regions` x `times` values.

    A tile is an array, region by region; its folder names its place. `axes` beside it has the places of the labels
    and the sizes of tiles and folders, so that a slice knows its folders. Each tile is a group of its size; the grid's rows
    are shuffled once, by tile. Files are few however many tiles there are; within one, tiles lie in order, and a slice skips
    the stretches it does not need.
    """
    places = {name: materialise(_axis(dim)) for name, dim in (("time", dim_time), ("geo", dim_geo))}
    totals = {name: axis.count() for name, axis in places.items()}
    tiles_in_all = -(-totals["time"] // times) * -(-totals["geo"] // regions)
    bands = {"time": 1, "geo": max(1, -(-tiles_in_all // FOLDERS))}  # tiles of a folder along each axis
    for name, size in (("time", times), ("geo", regions)):
        described = {"size": F.lit(size), "total": F.lit(totals[name]), "band": F.lit(bands[name])}
        places[name].withColumns(described).write.mode("overwrite").parquet(f"{path}/axes/{name}")
    place = {name: axis.select(F.col("label").alias(name), F.col("place").alias(f"_{name}")) for name, axis in places.items()}
    rows, labels = conformed_rows(series, dim_time, dim_geo)
    numbered = rows.join(place["geo"], "geo").drop("geo")  # a region's cells find their place at once
    placed = laid_out(numbered, labels).join(place["time"], "time")
    tile = {f"tile_{name}": F.floor(F.col(f"_{name}") / size).cast("int") for name, size in (("time", times), ("geo", regions))}
    cell = F.struct("_geo", "_time", "values")
    tiles = placed.withColumns(tile).groupBy("var", *tile).agg(F.sort_array(F.collect_list(cell)).alias("_cells"))  # regions * times
    band = F.floor(F.col("tile_geo") / bands["geo"]).cast("int").alias("band_geo")
    stored = tiles.select("var", *tile, band, F.col("_cells")["values"].alias("cells"))
    folder = ["tile_time", "band_geo"]
    laid = stored.hint("rebalance", *folder).sortWithinPartitions(*folder, "tile_geo")
    laid.write.mode("overwrite").partitionBy(*folder).parquet(f"{path}/tiles")
    return path


def _chosen(axis: DataFrame, labels: Sequence[str] | None) -> list[int] | None:
    """The places of the labels, or None for all; a label that is not on the axis is an error."""
    if labels is None:
        return None
    found = {r["label"]: r["place"] for r in axis.where(F.col("label").isin(*labels)).collect()}
    absent = [x for x in labels if x not in found]
    if absent:
        raise ValueError(f"not on the axis: {', '.join(map(str, absent))}")
    return sorted(found.values())


def _within(places: list[int], start: Column, end: Column) -> Column:
    return F.filter(F.array(*[F.lit(p).cast("long") for p in places]), lambda p: (p >= start) & (p < end))


def read_tiles(
    spark: SparkSession, path: str, times: Sequence[str] | None = None, regions: Sequence[str] | None = None
) -> DataFrame:
    """(var, geo, time, values) of a stored cube, of all or the given times and regions; reads the folders of their tiles only."""
    axes = {name: spark.read.parquet(f"{path}/axes/{name}") for name in ("time", "geo")}
    tiles = spark.read.parquet(f"{path}/tiles")
    inside: dict[str, Column] = {}
    extent = {}
    for name, labels in (("time", times), ("geo", regions)):
        size, total, band = axes[name].select("size", "total", "band").first() or (1, 0, 1)
        chosen = _chosen(axes[name], labels)
        start = F.col(f"tile_{name}").cast("long") * size
        extent[name] = F.least(F.lit(size).cast("long"), F.lit(total) - start)
        if chosen is None:
            inside[name] = F.sequence(start, start + extent[name] - 1)
        else:
            numbers = sorted({p // size for p in chosen})
            tiles = tiles.where(F.col(f"tile_{name}").isin(*numbers))
            if name == "geo":
                tiles = tiles.where(F.col("band_geo").isin(*sorted({n // band for n in numbers})))
            inside[name] = _within(chosen, start, start + extent[name])
        extent[f"start_{name}"] = start
    at = lambda g, t: ((g - extent["start_geo"]) * extent["time"] + t - extent["start_time"]).cast("int")
    cell = lambda g: F.transform(inside["time"], lambda t: F.struct(g.alias("_geo"), t.alias("_time"), F.get("cells", at(g, t)).alias("values")))
    rows = tiles.select("var", F.inline(F.flatten(F.transform(inside["geo"], cell))))
    for name in ("time", "geo"):
        rows = rows.join(axes[name].select(F.col("label").alias(name), F.col("place").alias(f"_{name}")), f"_{name}")
    return rows.select(F.col("var").cast("string").alias("var"), "geo", "time", "values")
