"""Result tables of the country study. `long` is (country, year, domain, cca_axis, value)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import year_label
from ..operators.factors import pca_fit, pca_rotation, pca_scores
from ..operators.keys import concat_unique, first_per_key
from ..operators.reshape import grid, to_wide
from ..operators.trajectories import with_events
from ..runtime import materialise
from ..schema import DOMAINS

AXES = ("CCA1", "CCA2", "CCA3")
DOMAIN_NAMES = tuple(DOMAINS.values())


def domains_wide(long: DataFrame) -> DataFrame:
    """One column per domain."""
    return to_wide(long, ["country", "year", "cca_axis"], "domain", "value", DOMAIN_NAMES)


def axes_wide(long: DataFrame) -> DataFrame:
    """One column per axis."""
    return to_wide(long, ["country", "year", "domain"], "cca_axis", "value", AXES)


def country_current(long: DataFrame, countries: Sequence[str], first: float, last: float) -> DataFrame:
    chosen = long.where(F.col("country").isin(*countries) & F.col("year").between(first, last))
    return chosen.orderBy("cca_axis", "country", "year", "domain")


def country_domains(long: DataFrame) -> DataFrame:
    return domains_wide(long.where(F.col("cca_axis") == "CCA1"))


def country_axes(long: DataFrame, domain: str) -> DataFrame:
    return axes_wide(long.where(F.col("domain") == domain))


def country_cca_plane(long: DataFrame) -> DataFrame:
    return axes_wide(long)


def country_time(long: DataFrame) -> DataFrame:
    return long.where(F.col("cca_axis") == "CCA1").select("country", "domain", "year", "value")


def country_events(long: DataFrame, events: DataFrame) -> DataFrame:
    return with_events(long, events)


def event_caption(flagged: DataFrame, country: str, year, sep: str = "\n") -> DataFrame:
    """(country, year, events): caption of one country and year; no row if nothing happened."""
    here = flagged.where((F.col("country") == country) & (F.col("year") == year))
    return concat_unique(here, ["country", "year"], "event", sep, "events")


def pca_frame(long: DataFrame, country: str, year) -> tuple[DataFrame, DataFrame]:
    """Path of one country in the plane of its first two components up to `year`, and the rotation.

    Of each year the row of the first axis counts. A year without a value in each of the three domains has no place in the
    plane: it takes no part in the fit and is not in the path.
    """
    wide = domains_wide(long.where(F.col("country") == country)).dropna(subset=list(DOMAIN_NAMES))
    yearly = materialise(first_per_key(wide, ["country", "year"], ["cca_axis"]))
    model = pca_fit(yearly, DOMAIN_NAMES)
    path = pca_scores(yearly, model).where(F.col("year") <= year)
    return path, pca_rotation(long.sparkSession, model)


def country_panel(long: DataFrame, axes: DataFrame, countries: DataFrame) -> DataFrame:
    """One panel per (cca_axis, country) of the two lists, domains as columns."""
    return grid(axes, countries).join(domains_wide(long), ["cca_axis", "country"])


def year_labels(long: DataFrame, country: str, axis: str = "CCA1", every: int = 5) -> DataFrame:
    wide = domains_wide(long.where((F.col("country") == country) & (F.col("cca_axis") == axis)))
    return wide.withColumn("label", year_label("year", every))


def panel_lists(spark: SparkSession, axes: Sequence[str], countries: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    return (
        spark.createDataFrame([(a,) for a in axes], "cca_axis string"),
        spark.createDataFrame([(c,) for c in countries], "country string"),
    )
