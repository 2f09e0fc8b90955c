"""From raw tables to stored cubes."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame

from ..operators.datasets import indicator_series
from ..operators.normalize import detrended_cube, detrended_long, scaled_cube
from ..operators.regions import resample_space
from ..operators.reshape import full_join_all, union_named
from ..operators.timeaxis import resample_time
from ..sources import write_cube


def ingest(
    datasets: Mapping[str, DataFrame], regions: DataFrame, levels: DataFrame, level_policy: str = "majority"
) -> DataFrame:
    """Raw indicator tables of any frequency and level -> quarterly (var, geo, time, values) of leaf regions."""
    series = union_named({code: indicator_series(df, code) for code, df in datasets.items()}, "code")
    quarterly = resample_time(series, by=["code"])
    lifted = resample_space(quarterly, regions, levels, level_policy, by=["code"])
    return lifted.drop("code")


def ingest_and_store(
    datasets: Mapping[str, DataFrame], regions: DataFrame, levels: DataFrame,
    dim_time: DataFrame, dim_geo: DataFrame, path: str,
) -> str:
    return write_cube(ingest(datasets, regions, levels), dim_time, dim_geo, path)


@dataclass(frozen=True)
class Cubes:
    raw: DataFrame
    scaled: DataFrame
    detrended: DataFrame
    detrended_long: DataFrame


def build_cubes(frames: Sequence[DataFrame], catalog: DataFrame, path: str) -> Cubes:
    """Join frames of features into the raw cube, store it as a table below `path`, derive the others from the table."""
    spark = frames[0].sparkSession
    full_join_all(frames).write.mode("overwrite").parquet(f"{path}/raw")
    raw = spark.read.parquet(f"{path}/raw")
    detrended = detrended_cube(raw)
    return Cubes(raw, scaled_cube(raw), detrended, detrended_long(detrended, catalog))
