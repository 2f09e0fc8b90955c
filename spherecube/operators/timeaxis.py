"""Time axis: quarters, and tables of any frequency brought to quarters."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import quarter_label, quarter_name, quarter_number, strict_mean
from .quantiles import QuantileOf


def quarter_axis(first: Column, last: Column, spans: DataFrame) -> DataFrame:
    """Quarters from `first` to `last` (dates computed over `spans`) -> (time, ord, quarter_start)."""
    starts = F.sequence(
        F.trunc(first, "quarter"), F.trunc(last, "quarter"), F.expr("interval 3 months")
    )
    days = spans.agg(starts.alias("starts")).select(F.posexplode("starts").alias("ord", "quarter_start"))
    return days.select(quarter_label("quarter_start").alias("time"), "ord", "quarter_start")


Aggregate = Callable[[str], Column] | QuantileOf


def resample_month_to_quarter(df: DataFrame, agg: Aggregate = strict_mean, by: Sequence[str] = ()) -> DataFrame:
    """Monthly rows -> one row per variable, region and quarter.

    `agg` is an aggregate column of a column's name, or an order statistic, which no single aggregate column can find
    for groups of any size.
    """
    keys = [*by, "var", "geo", "_quarter"]
    numbered = df.select(*by, "var", "geo", quarter_number("TIME_PERIOD").alias("_quarter"), "values")
    quarters = agg.over(numbered, keys, "values") if isinstance(agg, QuantileOf) else numbered.groupBy(*keys).agg(agg("values").alias("values"))
    return quarters.select(*by, "var", "geo", quarter_name("_quarter").alias("time"), "values")


def _four_quarters() -> Column:
    year = F.year("TIME_PERIOD").cast("string")
    return F.array(*[F.concat(year, F.lit(f"-Q{q}")) for q in (1, 2, 3, 4)])


def complete_annual(df: DataFrame) -> DataFrame:
    """Annual rows -> the same value in each of the four quarters."""
    return df.select("var", "geo", F.explode(_four_quarters()).alias("time"), "values")


def resample_time(df: DataFrame, agg: Aggregate = strict_mean, by: Sequence[str] = ()) -> DataFrame:
    """(var, geo, freq, TIME_PERIOD, values) of mixed frequency -> (var, geo, time, values) by quarter.

    Each row follows its own `freq`: Q is kept, M aggregated, A repeated; any other frequency is an error. Columns named
    in `by` are kept as further keys.
    """
    monthly = F.coalesce(F.col("freq") == "M", F.lit(False))
    unknown = F.raise_error(F.concat(F.lit("unknown frequency "), F.coalesce("freq", F.lit("NULL"))))
    labels = (
        F.when(F.col("freq") == "Q", F.array(quarter_label("TIME_PERIOD")))
        .when(F.col("freq") == "A", _four_quarters())
        .otherwise(unknown.cast("array<string>"))
    )
    others = df.where(~monthly).select(*by, "var", "geo", F.explode(labels).alias("time"), "values")
    return resample_month_to_quarter(df.where(monthly), agg, by).unionByName(others)
