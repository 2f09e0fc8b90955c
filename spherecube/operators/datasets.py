"""Indicator datasets: variables, profiles and titles."""

from __future__ import annotations

from collections.abc import Mapping
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import united
from ..schema import STABLE
from ..sources.readers import literal_table
from .reshape import columns_except


def variable_name(df: DataFrame, code: str):
    """`code_breakdown_...`, one name per combination of breakdown values."""
    return united(F.lit(code), *columns_except(df, STABLE))


def indicator_series(df: DataFrame, code: str) -> DataFrame:
    """Raw indicator table -> (var, geo, freq, TIME_PERIOD, values)."""
    return df.select(variable_name(df, code).alias("var"), "geo", "freq", "TIME_PERIOD", "values")


def count_variables(df: DataFrame, code: str) -> DataFrame:
    return df.agg(F.countDistinct(variable_name(df, code)).alias("vars"))


def dataset_profile(datasets: Mapping[str, DataFrame], levels: DataFrame) -> DataFrame:
    """(code, columns, freq, level, vars) of every dataset, a row each also where it is empty.

    Every table is read once: its distinct (freq, variable, geo), far fewer than its rows, are all a profile needs. The
    level is the finest one that occurs.
    """
    described = [
        df.select(F.lit(code).alias("code"), "freq", variable_name(df, code).alias("var"), "geo") for code, df in datasets.items()
    ]
    facts = reduce(DataFrame.unionByName, described).distinct().join(levels, "geo", "left").groupBy("code").agg(
        F.array_join(F.sort_array(F.collect_set("freq")), ",").alias("freq"),
        F.max("level").alias("level"),
        F.countDistinct("var").alias("vars"),
    )
    columns = literal_table(levels.sparkSession, [(c, ",".join(df.columns)) for c, df in datasets.items()], "code string, columns string")
    return columns.join(facts, "code", "left").select(
        "code", "columns", F.coalesce("freq", F.lit("")).alias("freq"), "level", F.coalesce("vars", F.lit(0)).alias("vars")
    )


def metadata_join(profiles: DataFrame, titles: DataFrame) -> DataFrame:
    """Profiles with the title of the dataset, where it has one."""
    return profiles.join(titles, "code", "left").select("code", "level", "title")
