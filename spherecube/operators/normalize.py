"""Column-wise maps, moments, scaling, detrending and coverage of wide cubes.

A wide cube has one column per feature, so the moments of all features are one aggregate row. They return to the rows
as a scalar subquery: no join, no window, no pass through the driver, and the cube's last shuffle is used twice.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import ln_positive, quarter_start
from ..schema import DEFAULT_SPHERE, KEYS, LOG_PREFIX, features_of
from .reshape import cube_to_long


def _quoted(name: str) -> Column:
    return F.col(f"`{name}`")


def map_columns(df: DataFrame, cols: Sequence[str], f: Callable[[Column], Column]) -> DataFrame:
    return df.select(*[f(_quoted(c)).alias(c) if c in cols else _quoted(c) for c in df.columns])


def map_prefix(df: DataFrame, prefix: str, f: Callable[[Column], Column]) -> DataFrame:
    return map_columns(df, [c for c in df.columns if c.startswith(prefix)], f)


def map_numeric(df: DataFrame, f: Callable[[Column], Column]) -> DataFrame:
    return map_columns(df, [s.name for s in df.schema if isinstance(s.dataType, T.NumericType)], f)


def map_all(df: DataFrame, f: Callable[[Column], Column]) -> DataFrame:
    return map_columns(df, df.columns, f)


def _present(c: str) -> str:
    """SQL of a feature with NaN as missing. Per-feature expressions are texts: one call to the JVM for each."""
    return f"nullif(`{c}`, double('NaN'))"


def _moments(cube: DataFrame, features: Sequence[str]) -> DataFrame:
    """One row, one struct (n, mean, sd) per feature."""
    return cube.agg(*[
        F.expr(f"struct(count({v}) AS n, avg({v}) AS mean, stddev_samp({v}) AS sd) AS `{c}`")
        for c, v in ((c, _present(c)) for c in features)
    ])


def column_moments(cube: DataFrame, features: Sequence[str] | None = None) -> DataFrame:
    """(var_id, n, mean, sd) of every feature; missing values are skipped."""
    features = features or features_of(cube)
    return _moments(cube, features).unpivot([], features, "var_id", "m").select("var_id", "m.*")


def zscore_impute(cube: DataFrame, features: Sequence[str] | None = None) -> DataFrame:
    """z-scores by sample standard deviation; what is missing or constant becomes 0, the mean."""
    features = features or features_of(cube)
    moments = _moments(cube, features).select(F.struct("*")).scalar()

    def scale(c: str) -> Column:
        z = f"try_divide({_present(c)} - _moments.`{c}`.mean, _moments.`{c}`.sd)"
        return F.expr(f"coalesce(nullif({z}, double('NaN')), 0D) AS `{c}`")

    kept = [c for c in cube.columns if c not in features]
    return cube.withColumn("_moments", moments).select(*kept, *[scale(c) for c in features])


def log_features(cube: DataFrame, features: Sequence[str] | None = None) -> DataFrame:
    """Logarithm of the power-law features, recognised by their prefix."""
    features = features or features_of(cube)
    return map_columns(cube, [c for c in features if c.startswith(LOG_PREFIX)], ln_positive)


def scaled_cube(cube: DataFrame, features: Sequence[str] | None = None) -> DataFrame:
    return zscore_impute(log_features(cube, features), features)


def demean_by(df: DataFrame, keys: Sequence, cols: Sequence[str]) -> DataFrame:
    """Columns minus their group mean, missing values skipped.

    Group means combine before the shuffle and are joined back, so a hot group is spread over tasks, which a window
    over the group would not allow. A group's key may be missing.
    """
    keys = [F.col(k) if isinstance(k, str) else k for k in keys]
    keyed = df.select("*", *[k.alias(f"_k{n}") for n, k in enumerate(keys)])
    means = (
        keyed.groupBy(*[F.col(f"_k{n}").alias(f"_g{n}") for n in range(len(keys))])
        .agg(F.expr(f"struct({', '.join(f'avg({_present(c)}) AS `{c}`' for c in cols)}) AS _mean"))
    )
    same = reduce(Column.__and__, [F.col(f"_k{n}").eqNullSafe(F.col(f"_g{n}")) for n in range(len(keys))])
    joined = keyed.join(means, same, "left")
    return joined.select(*[
        F.expr(f"{_present(c)} - _mean.`{c}` AS `{c}`") if c in cols else _quoted(c) for c in df.columns
    ])


def _year() -> Column:
    return F.substring("time", 1, 4)


def _season() -> Column:
    return F.substring("time", -2, 2)


def _demean_within(df: DataFrame, keys: Sequence, cols: Sequence[str]) -> DataFrame:
    """The same as `demean_by` where groups are small: a window, which costs one shuffle."""
    group = Window.partitionBy(*keys)
    less = lambda c: (F.expr(_present(c)) - F.avg(F.expr(_present(c))).over(group)).alias(c)
    return df.select(*[less(c) if c in cols else _quoted(c) for c in df.columns])


def detrend(cube: DataFrame, by: str = "season", features: Sequence[str] | None = None) -> DataFrame:
    """Remove the mean per region and season (default), per region and year, or first the one by year, then by season.

    A region has a row per quarter, so the groups are as small as the time axis. `both` deals rows out by region once.
    """
    features = features or features_of(cube)
    steps = {"season": [_season()], "year": [_year()], "both": [_year(), _season()]}[by]
    start = cube.repartition("geo") if by == "both" else cube
    return reduce(lambda df, part: _demean_within(df, ["geo", part], features), steps, start)


def detrended_cube(cube: DataFrame, by: str = "season", features: Sequence[str] | None = None) -> DataFrame:
    return zscore_impute(detrend(cube, by, features), features)


def processed_cube(raw: DataFrame, detrended: Sequence[str], others: Sequence[str], by: str = "season") -> DataFrame:
    """Some features detrended, the others only scaled, from one pass over the raw cube instead of two joined cubes."""
    chosen = raw.select(*KEYS, *[_quoted(c) for c in [*detrended, *others]])
    if detrended:
        chosen = detrend(chosen, by, detrended)
    return zscore_impute(log_features(chosen, others) if others else chosen)


def with_feature_defaults(ids: DataFrame, catalog: DataFrame) -> DataFrame:
    """Catalogue entries of the given `var_id`s; what the catalogue lacks gets default sphere, label and description."""
    label = F.coalesce("label", "var_id")
    known = ids.join(catalog, "var_id", "left")
    return known.withColumns({
        "sphere": F.coalesce("sphere", F.lit(DEFAULT_SPHERE)),
        "label": label,
        "description": F.coalesce(F.col("description"), label),
    })


def detrended_long(detrended: DataFrame, catalog: DataFrame) -> DataFrame:
    """Long form with the catalogue entry and the first day of the quarter."""
    dated = detrended.withColumn("time", quarter_start("time"))
    return with_feature_defaults(cube_to_long(dated), catalog)


def coverage(cube: DataFrame, expected: Column, max_na: float = 0.1, features: Sequence[str] | None = None) -> DataFrame:
    """(var_id, n, missing, complete): share of the expected cells without a value, and whether it is within `max_na`."""
    counted = column_moments(cube, features).select("var_id", "n").withColumn("_expected", expected)
    missing = 1 - F.try_divide("n", "_expected")
    return counted.select("var_id", "n", missing.alias("missing"), (missing <= max_na).alias("complete"))
