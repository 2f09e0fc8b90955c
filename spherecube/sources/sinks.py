"""Sinks. `rebalance` lets Spark split a hot partition value over several files and merge small ones."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import united
from ..operators.reshape import conformed_rows, laid_out
from ..runtime import ROW_GROUP
from ..schema import FILL_VALUE, STABLE


#: Folders that a task writes side by side; with more, the rest of its rows is sorted by folder.
WRITERS = 8


def _write_folders(df: DataFrame, column: str, path: str) -> None:
    """A folder per value of the column. Rows go to the open file of their folder, as they come and without a sort."""
    conf, key = df.sparkSession.conf, "spark.sql.maxConcurrentOutputFileWriters"
    before = conf.get(key)
    conf.set(key, str(WRITERS))
    try:
        df.write.mode("overwrite").option("parquet.block.size", str(ROW_GROUP)).partitionBy(column).parquet(path)
    finally:
        conf.set(key, before)


def write_cube(
    series: DataFrame, dim_time: DataFrame, dim_geo: DataFrame, path: str, fill: float | None = FILL_VALUE
) -> str:
    """Bring every variable of (var, geo, time, values) to the full axes and store it, one folder per variable.

    Dealt out by variable are rows of many cells, not the cells.
    """
    rows, axis = conformed_rows(series, dim_time, dim_geo)
    full = laid_out(rows.hint("rebalance", "var"), axis)
    if fill is not None:
        full = full.withColumn("values", F.coalesce("values", F.lit(fill)))
    _write_folders(full, "var", path)
    return path


def read_cube(spark: SparkSession, path: str, fill: float | None = FILL_VALUE) -> DataFrame:
    """Stored cube -> (var, geo, time, values), the fill value read as missing."""
    df = spark.read.parquet(path).withColumn("var", F.col("var").cast("string"))
    if fill is not None:
        df = df.withColumn("values", F.nullif("values", F.lit(fill)))
    return df.select("var", "geo", "time", "values")


def write_table_csv(df: DataFrame, path: str) -> str:
    df.write.mode("overwrite").csv(path, header=True)
    return path


def split_write(df: DataFrame, code: str, path: str) -> str:
    """Split a dataset by its breakdown columns: one folder per descriptor `code_breakdown_...`."""
    breakdown = [c for c in df.columns if c not in STABLE]
    named = df.withColumn("descriptor", united(F.lit(code), *breakdown)).drop("code", *breakdown)
    named.hint("rebalance", "descriptor").write.mode("overwrite").partitionBy("descriptor").parquet(path)
    return path
