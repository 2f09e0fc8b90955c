"""Canonical correlation analysis between two groups of features.

The data are read once for the covariance matrix; the solve is on p x p numbers; scores are linear combinations of
columns and need no shuffle.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass
from itertools import permutations

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import country_of
from ..schema import KEYS
from .moments import Moments, cross_moments, dependent_features, oriented_signs

# Canonical variates every analysis reports.
AXES = 2


@dataclass(frozen=True)
class CcaModel:
    """Canonical correlations, and coefficients that give centred scores unit norm (columns are variates)."""

    x: tuple[str, ...]
    y: tuple[str, ...]
    cor: np.ndarray
    xcoef: np.ndarray
    ycoef: np.ndarray

    def reverse(self) -> CcaModel:
        """The same analysis seen from the other side, its variates pointing the same way."""
        return CcaModel(self.y, self.x, self.cor, self.ycoef, self.xcoef)


def _whitening(cov: np.ndarray) -> np.ndarray:
    """W with W' cov W = 1."""
    return np.linalg.inv(np.linalg.cholesky(cov)).T


def solve_cca(moments: Moments, x: Sequence[str], y: Sequence[str]) -> CcaModel:
    """Singular value decomposition of the whitened cross-covariance.

    Signs: the largest coefficient of each x variate is positive, and each y variate correlates positively with it.
    """
    if min(len(x), len(y)) < AXES:
        raise ValueError(f"at least {AXES} features are needed on each side")
    for side in (x, y):
        bad = dependent_features(moments.take(side))
        if bad:
            raise ValueError(f"constant or linearly dependent features: {', '.join(bad)}")
    ix, iy = moments.index(x), moments.index(y)
    wx = _whitening(moments.cov[np.ix_(ix, ix)])
    wy = _whitening(moments.cov[np.ix_(iy, iy)])
    u, cor, vt = np.linalg.svd(wx.T @ moments.cov[np.ix_(ix, iy)] @ wy)
    k = min(len(x), len(y))
    norm = np.sqrt(moments.n - 1)
    xcoef, ycoef = wx @ u[:, :k] / norm, wy @ vt.T[:, :k] / norm
    sign = oriented_signs(xcoef)
    return CcaModel(tuple(x), tuple(y), np.clip(cor, 0.0, 1.0), xcoef * sign, ycoef * sign)


def cca_fit(cube: DataFrame, x: Sequence[str], y: Sequence[str]) -> CcaModel:
    return solve_cca(cross_moments(cube, [*x, *y]), x, y)


def combination(names: Sequence[str], weights: Sequence[float]) -> Column:
    """Weighted sum of columns."""
    total = F.lit(0.0)
    for c, w in zip(names, weights):
        total = total + F.col(f"`{c}`") * F.lit(float(w))
    return total


def cca_scores(cube: DataFrame, model: CcaModel, keep: Sequence[str] = KEYS) -> DataFrame:
    """(geo, time, CCA1, CCA2, country): scores of the x side, not centred."""
    axes = [combination(model.x, model.xcoef[:, k]).alias(f"CCA{k + 1}") for k in range(AXES)]
    return cube.select(*keep, *axes).withColumn("country", country_of("geo"))


def cca_both_scores(cube: DataFrame, model: CcaModel) -> DataFrame:
    """Forward and reverse scores of an observation in one row. Both come from the same row, so nothing is joined."""
    back = model.reverse()
    return cube.select(*KEYS, *[
        combination(m.x, m.xcoef[:, k]).alias(f"{name}_CCA{k + 1}")
        for name, m in (("fwd", model), ("rev", back)) for k in range(AXES)
    ])


def match_scores(fwd: DataFrame, rev: DataFrame, axes: Sequence[str] = ("CCA1",)) -> DataFrame:
    """Scores of two separate analyses, matched on the observation."""
    left = fwd.select(*KEYS, *[F.col(a).alias(f"fwd_{a}") for a in axes])
    right = rev.select(*KEYS, *[F.col(a).alias(f"rev_{a}") for a in axes])
    return left.join(right, list(KEYS))


def cca_loadings(spark: SparkSession, model: CcaModel) -> DataFrame:
    """(var_id, CCA1, CCA2) of the x side."""
    rows = [(c, *map(float, model.xcoef[k, :AXES])) for k, c in enumerate(model.x)]
    return spark.createDataFrame(rows, "var_id string, CCA1 double, CCA2 double")


def cca_correlations(spark: SparkSession, model: CcaModel) -> DataFrame:
    rows = [(k + 1, float(r)) for k, r in enumerate(model.cor)]
    return spark.createDataFrame(rows, "axis int, correlation double")


def sphere_pairs(spheres: DataFrame, name: str = "sphere") -> DataFrame:
    """Ordered pairs of different spheres. There are as many rows as pairs to analyse."""
    x, y = spheres.select(F.col(name).alias("x")), spheres.select(F.col(name).alias("y"))
    return x.join(y, F.col("x") != F.col("y"))


def pairwise_cca(cube: DataFrame, spheres: Mapping[str, Sequence[str]]) -> dict[tuple[str, str], CcaModel]:
    """Models of all ordered pairs of spheres, from one covariance pass over all their features."""
    moments = cross_moments(cube, [c for names in spheres.values() for c in names])
    return {(a, b): solve_cca(moments, spheres[a], spheres[b]) for a, b in permutations(spheres, 2)}


def pairwise_scores(cube: DataFrame, models: Mapping[tuple[str, str], CcaModel]) -> DataFrame:
    """(x, y, geo, time, CCA1, CCA2, country): scores of all pairs from one reading of the cube."""
    rows = [
        F.struct(
            F.lit(a).alias("x"), F.lit(b).alias("y"),
            *[combination(m.x, m.xcoef[:, k]).alias(f"CCA{k + 1}") for k in range(AXES)],
        )
        for (a, b), m in models.items()
    ]
    return cube.select(*KEYS, F.inline(F.array(*rows))).withColumn("country", country_of("geo"))


def pairwise_loadings(spark: SparkSession, models: Mapping[tuple[str, str], CcaModel]) -> DataFrame:
    rows = [
        (a, b, c, *map(float, m.xcoef[k, :AXES])) for (a, b), m in models.items() for k, c in enumerate(m.x)
    ]
    return spark.createDataFrame(rows, "x string, y string, var_id string, CCA1 double, CCA2 double")


def score_means(scores: DataFrame) -> DataFrame:
    return scores.agg(*[F.avg(f"CCA{k}").alias(f"CCA{k}") for k in range(1, AXES + 1)])


def biplot_loadings(scores: DataFrame, loadings: DataFrame, scale: float = 1.0) -> DataFrame:
    """Loading arrows (x, y, xend, yend) from the origin, shifted by the mean score."""
    shift = score_means(scores).select(F.struct("*")).scalar()
    return loadings.withColumn("_shift", shift).select(
        "var_id",
        F.lit(0.0).alias("x"),
        F.lit(0.0).alias("y"),
        (F.col("CCA1") * scale - F.col("_shift.CCA1")).alias("xend"),
        (F.col("CCA2") * scale - F.col("_shift.CCA2")).alias("yend"),
    )


def pairwise_biplot(cube: DataFrame, models: Mapping[tuple[str, str], CcaModel], scale: float = 1.0) -> DataFrame:
    """(x, y, var_id, x0, y0, xend, yend): the loading arrows of all pairs, each shifted by its pair's mean score.

    The mean scores of all pairs are one aggregation over one reading of the cube.
    """
    means = pairwise_scores(cube, models).groupBy("x", "y").agg(*[F.avg(f"CCA{k}").alias(f"_m{k}") for k in range(1, AXES + 1)])
    arrows = pairwise_loadings(cube.sparkSession, models).join(means, ["x", "y"])
    return arrows.select(
        "x", "y", "var_id", F.lit(0.0).alias("x0"), F.lit(0.0).alias("y0"),
        (F.col("CCA1") * scale - F.col("_m1")).alias("xend"), (F.col("CCA2") * scale - F.col("_m2")).alias("yend"),
    )
