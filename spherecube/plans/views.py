"""Result tables behind the views of the cube."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import quarter_start, strict_max_abs, united
from ..operators.cca import AXES, CcaModel, cca_both_scores, cca_loadings, combination, pairwise_loadings
from ..operators.density import density2d
from ..operators.keys import order_levels_within
from ..operators.normalize import processed_cube
from ..operators.reshape import to_long
from ..schema import KEYS, features_of

SCORES = tuple(f"{side}_CCA{k}" for side in ("fwd", "rev") for k in range(1, AXES + 1))


def highlighted(name: str | Column, pattern: str) -> Column:
    """Whether a packed observation name matches the user's pattern."""
    return (F.col(name) if isinstance(name, str) else name).rlike(pattern)


def features_for_spheres(features: DataFrame, x_sphere: str, y_sphere: str) -> DataFrame:
    return features.where(F.col("sphere").isin(x_sphere, y_sphere)).select("label")


def xy_features(features: DataFrame, x_sphere: str, y_sphere: str, used: Sequence[str]) -> DataFrame:
    """(side, var_id): features of either side among the labels in use."""
    side = F.when(F.col("sphere") == x_sphere, "x").when(F.col("sphere") == y_sphere, "y")
    return features.where(F.col("label").isin(*used)).select(side.alias("side"), "var_id").dropna()


def detrended_and_others(features: DataFrame, used: Sequence[str], detrended: Sequence[str]) -> DataFrame:
    """(var_id, detrend): features in use, and whether they are to be detrended."""
    return features.where(F.col("label").isin(*used)).select("var_id", F.col("label").isin(*detrended).alias("detrend"))


def processed(raw: DataFrame, features: DataFrame, used: Sequence[str], detrended: Sequence[str]) -> DataFrame:
    """The cube the analyses use. The catalogue has one row per column of the cube, so its choice may be collected."""
    choice = {r["var_id"]: r["detrend"] for r in detrended_and_others(features, used, detrended).collect()}
    named = [c for c in features_of(raw) if c in choice]
    return processed_cube(raw, [c for c in named if choice[c]], [c for c in named if not choice[c]])


def features_table(features: DataFrame) -> DataFrame:
    return features.drop("var_id")


def scores_view(cube: DataFrame, model: CcaModel, pattern: str) -> DataFrame:
    """(name, fwd, rev, highlight): first variate of both directions."""
    name = united("geo", "time")
    return cca_both_scores(cube, model).select(
        name.alias("name"), F.col("fwd_CCA1").alias("fwd"), F.col("rev_CCA1").alias("rev"),
        highlighted(name, pattern).alias("highlight"),
    )


def loadings_view(spark: SparkSession, model: CcaModel, features: DataFrame) -> DataFrame:
    """Loadings of both directions with the catalogue entry."""
    both = cca_loadings(spark, model).unionByName(cca_loadings(spark, model.reverse()))
    return both.join(features, "var_id", "left")


def trajectories_view(cube: DataFrame, model: CcaModel, x_sphere: str, y_sphere: str, pattern: str) -> DataFrame:
    """(geo, time, name, direction, CCA1, CCA2, highlight): both directions stacked from one reading of the cube."""
    rows = [
        F.struct(
            F.lit(f"{a}-{b}").alias("direction"),
            *[combination(m.x, m.xcoef[:, k]).alias(f"CCA{k + 1}") for k in range(AXES)],
        )
        for m, a, b in ((model, x_sphere, y_sphere), (model.reverse(), y_sphere, x_sphere))
    ]
    name = F.concat("geo", "time")
    return cube.select(*KEYS, name.alias("name"), highlighted(name, pattern).alias("highlight"), F.inline(F.array(*rows)))


def trajectories_density(view: DataFrame, grid_n: int = 100) -> DataFrame:
    """(direction, CCA1, CCA2, density): the density of the first two scores, for each direction of `trajectories_view`."""
    found = density2d(view, "CCA1", "CCA2", grid_n, by=["direction"])
    return found.withColumnsRenamed({"x": "CCA1", "y": "CCA2"})


def pairwise_loadings_view(
    spark: SparkSession, models: Mapping[tuple[str, str], CcaModel], features: DataFrame, order: str = "CCA1"
) -> DataFrame:
    """Loadings of all ordered pairs with the catalogue entry; `ord` is a feature's place in its pair, by the column `order`."""
    loadings = pairwise_loadings(spark, models)
    places = order_levels_within(loadings, ["x", "y"], "var_id", order)
    return loadings.join(places, ["x", "y", "var_id"]).join(features, "var_id", "left")


def chosen_variable(features: DataFrame, name: str) -> str:
    """The variable behind a label of the catalogue, of several the first by name; a score's name stands for itself."""
    if name in SCORES:
        return name
    found = features.where(F.col("label") == name).agg(F.min("var_id")).first()[0]
    if found is None:
        raise ValueError(f"no feature is labelled {name}")
    return found


def map_view(regions: DataFrame, cube: DataFrame, model: CcaModel | None, feature: str, time: str) -> DataFrame:
    """(geo, value, value_limit): a feature or score of one quarter for every region, and its symmetric limit."""
    source = cca_both_scores(cube, model) if feature in SCORES else cube
    values = source.where(F.col("time") == time).select("geo", F.col(f"`{feature}`").alias("value"))
    limit = values.agg(strict_max_abs("value")).scalar()
    return regions.join(values, "geo", "left").select("geo", "value").withColumn("value_limit", limit)


def timeseries_view(cube: DataFrame, model: CcaModel, geo: str) -> DataFrame:
    """(geo, time, feature, value): all features and scores of one region, the time as a date."""
    region = cube.where(F.col("geo") == geo)
    back = model.reverse()
    scored = region.withColumns({
        f"{side}_CCA{k + 1}": combination(m.x, m.xcoef[:, k])
        for side, m in (("fwd", model), ("rev", back)) for k in range(AXES)
    })
    long = to_long(scored, KEYS, [*features_of(cube), *SCORES], "feature", "value")
    return long.withColumn("time", quarter_start("time"))
