"""Sources. Every reader names its schema, so that no file is read twice to infer one."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..schema import BOUNDARIES, FEATURES, REGIONS


def read_axis(spark: SparkSession, path: str) -> DataFrame:
    """Text file -> (label, ord); the line number is the order.

    An axis file is a short list of labels, so each file is read whole, which keeps its line order.
    """
    lines = F.split(F.regexp_replace("value", r"\r?\n$", ""), r"\r?\n")
    return spark.read.text(path, wholetext=True).select(F.posexplode(lines).alias("ord", "label")).select("label", "ord")


def read_feature_catalog(spark: SparkSession, path: str) -> DataFrame:
    """Feature catalogue; short rows get NULLs and padding around fields is dropped."""
    return spark.read.csv(
        path, schema=FEATURES, header=True, mode="PERMISSIVE",
        ignoreLeadingWhiteSpace=True, ignoreTrailingWhiteSpace=True,
    )


def read_region_table(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.csv(path, schema=REGIONS, header=True)


def read_csv_dir(spark: SparkSession, path: str | Sequence[str], schema) -> DataFrame:
    """All CSV files of a folder in one scan. The header must name the columns of `schema`."""
    return spark.read.csv(path, schema=schema, header=True, enforceSchema=False)


def dataset_codes(spark: SparkSession, path: str) -> list[str]:
    """Names of the datasets `<code>.parquet` in a folder."""
    jvm = spark.sparkContext._jvm
    folder = jvm.org.apache.hadoop.fs.Path(path)
    entries = folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).listStatus(folder)
    names = [e.getPath().getName() for e in entries]
    return sorted(n.removesuffix(".parquet") for n in names if n.endswith(".parquet"))


def read_indicators(spark: SparkSession, path: str, codes: Sequence[str] | None = None) -> dict[str, DataFrame]:
    """Parquet datasets of one folder by code, each with its own columns only; a file or a folder `<code>.parquet` each.

    Columns of one dataset never become columns of another: they name its variables.
    """
    codes = dataset_codes(spark, path) if codes is None else codes
    return {c: spark.read.parquet(f"{path.rstrip('/')}/{c}.parquet").withColumn("code", F.lit(c)) for c in codes}


def read_region_levels(spark: SparkSession, paths: Sequence[str]) -> DataFrame:
    """Boundary files of several vintages -> distinct (geo, level)."""
    return (
        spark.read.schema(BOUNDARIES).json(list(paths), multiLine=True)
        .select(F.explode("features.properties").alias("p"))
        .select(F.col("p.NUTS_ID").alias("geo"), F.col("p.LEVL_CODE").alias("level"))
        .distinct()
    )


def cube_from_matrix(wide: DataFrame, time_col: str, var_id: str) -> DataFrame:
    """Matrix with one row per time and one column per region -> long cube; missing cells are kept."""
    regions = [c for c in wide.columns if c != time_col]
    return wide.unpivot(time_col, regions, "geo", "value").select(
        "geo", F.col(time_col).alias("time"), F.lit(var_id).alias("var_id"), F.col("value").cast("double").alias("value")
    )


def cube_from_arrays(rows: DataFrame, time_col: str, array_col: str, dim_geo: DataFrame, var_id: str) -> DataFrame:
    """The same with one array per time, whose positions are the `ord` of the region axis (label, ord)."""
    cells = rows.select(F.col(time_col).alias("time"), F.posexplode(array_col).alias("ord", "value"))
    return cells.join(dim_geo, "ord").select(
        F.col("label").alias("geo"), "time", F.lit(var_id).alias("var_id"), F.col("value").cast("double").alias("value")
    )


def literal_table(spark: SparkSession, rows: Sequence[tuple], schema) -> DataFrame:
    """A few rows as a part of the plan, so that their size is known and a join can send them along."""
    empty = spark.createDataFrame([], schema)
    if not rows:
        return empty
    row = lambda r: F.struct(*[F.lit(v).cast(f.dataType).alias(f.name) for v, f in zip(r, empty.schema, strict=True)])
    return spark.sql("SELECT 1").select(F.inline(F.array(*map(row, rows))))
