"""First and second moments of a feature set, the only thing multivariate fits need from the data."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Relative residual variance below which a feature counts as a combination of others.
RANK_TOLERANCE = 1e-10


@dataclass(frozen=True)
class Moments:
    """Size of the data is gone here: `mean` has p entries and `cov` p x p."""

    names: tuple[str, ...]
    n: int
    mean: np.ndarray
    cov: np.ndarray

    def take(self, names: Sequence[str]) -> Moments:
        at = self.index(names)
        return Moments(tuple(names), self.n, self.mean[at], self.cov[np.ix_(at, at)])

    def index(self, names: Sequence[str]) -> list[int]:
        return [self.names.index(c) for c in names]


def oriented_signs(vectors: np.ndarray) -> np.ndarray:
    """Signs that make the largest entry of every column positive, of equally large ones the first."""
    size = np.abs(vectors)
    first = (size >= size.max(axis=0) * (1 - 1e-9)).argmax(axis=0)
    sign = np.sign(vectors[first, np.arange(vectors.shape[1])])
    return np.where(sign == 0, 1.0, sign)


def pair_moments(cube: DataFrame, x: Sequence[str], y: Sequence[str]) -> DataFrame:
    """(a, b, n, cov) for every pair of a feature in `x` with one in `y`; one aggregation."""
    pairs = [(a, b) for a in x for b in y]
    row = cube.agg(*[
        F.struct(F.count(F.when(F.col(a).isNotNull() & F.col(b).isNotNull(), 1)).alias("n"), F.covar_samp(a, b).alias("cov"))
        .alias(f"_{k}")
        for k, (a, b) in enumerate(pairs)
    ])
    entries = [
        F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.col(f"_{k}.n").alias("n"), F.col(f"_{k}.cov").alias("cov"))
        for k, (a, b) in enumerate(pairs)
    ]
    return row.select(F.inline(F.array(*entries)))


def _sizes(cube: DataFrame, names: Sequence[str]) -> tuple[int, np.ndarray]:
    """Number of rows and means of complete features."""
    row = cube.agg(F.count(F.lit(1)), *[F.count(c) for c in names], *[F.avg(c) for c in names]).first()
    _check_complete(row[0], dict(zip(names, row[1:len(names) + 1])))
    return row[0], np.array(row[len(names) + 1:], dtype=float)


def _products(cube: DataFrame, names: Sequence[str], centre: np.ndarray) -> np.ndarray:
    """Sums of the products of all pairs of features, taken from `centre`: a p x p matrix by task, summed by entry."""
    p = len(names)

    def partial(batches):
        total = np.zeros((p, p))
        for batch in batches:
            x = np.column_stack([c.to_numpy(zero_copy_only=False) for c in batch.columns]) - centre
            total += x.T @ x
        i, j = np.tril_indices(p)
        yield pa.RecordBatch.from_arrays([pa.array(i), pa.array(j), pa.array(total[i, j])], names=["i", "j", "s"])

    columns = cube.select(*[F.col(c).cast("double").alias(f"x{k}") for k, c in enumerate(names)])
    entries = columns.mapInArrow(partial, "i long, j long, s double").groupBy("i", "j").agg(F.sum("s").alias("s")).collect()
    out = np.zeros((p, p))
    for e in entries:
        out[e["i"], e["j"]] = out[e["j"], e["i"]] = e["s"]
    if not np.isfinite(out).all():
        raise ValueError("features with values that are not finite")
    return out


def cross_moments(cube: DataFrame, features: Sequence[str]) -> Moments:
    """Size, means and covariance matrix of complete features: p x p numbers to the driver.

    Means first, products around them second: two passes over `cube`, so pass a stored one. Infinite values are an error.
    """
    names = tuple(dict.fromkeys(features))
    n, mean = _sizes(cube, names)
    return Moments(names, n, mean, _products(cube, names, mean) / (n - 1))


def gram(df: DataFrame, cols: Sequence[str]) -> np.ndarray:
    """Sums of the products of all pairs of complete columns, not centred."""
    return _products(df, cols, np.zeros(len(cols)))


def _check_complete(n: int, present: dict[str, int]) -> None:
    if n < 2:
        raise ValueError(f"{n} observations are too few")
    gaps = [c for c, k in present.items() if k < n]
    if gaps:
        raise ValueError(f"features with missing values: {', '.join(gaps)}")


def dependent_features(moments: Moments) -> list[str]:
    """Features that are constant or a linear combination of the ones before them."""
    sd = np.sqrt(np.diag(moments.cov))
    found, basis = [], []
    for k, name in enumerate(moments.names):
        if sd[k] <= 0:
            found.append(name)
            continue
        corr = moments.cov[k, basis] / (sd[k] * sd[basis]) if basis else np.zeros(0)
        among = moments.cov[np.ix_(basis, basis)] / np.outer(sd[basis], sd[basis]) if basis else np.zeros((0, 0))
        left = 1 - corr @ np.linalg.solve(among, corr) if basis else 1.0
        if left < RANK_TOLERANCE:
            found.append(name)
        else:
            basis.append(k)
    return found


def moment_state(df: DataFrame, features: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """(by..., x, y, n, mean_x, mean_y, product): co-moments of each pair of features over the rows that have both.

    `product` is the sum of products of deviations from the means. One aggregation; the result does not grow with the
    rows, and states of different rows add up, see `merged_states`. NaN counts as missing.
    """
    pairs = [(a, b) for i, a in enumerate(features) for b in features[i:]]
    held = {c: F.when(~F.isnan(F.col(f"`{c}`").cast("double")), F.col(f"`{c}`").cast("double")) for c in features}
    rows = df.select(*by, *[v.alias(f"_{k}") for k, v in enumerate(held.values())])
    place = {c: f"_{k}" for k, c in enumerate(features)}
    entries = []
    for a, b in pairs:
        both = F.col(place[a]).isNotNull() & F.col(place[b]).isNotNull()
        x, y = F.when(both, F.col(place[a])), F.when(both, F.col(place[b]))
        n = F.count(F.when(both, 1))
        entries.append(F.struct(
            F.lit(a).alias("x"), F.lit(b).alias("y"), n.alias("n"), F.avg(x).alias("mean_x"), F.avg(y).alias("mean_y"), (F.covar_pop(x, y) * n).alias("product"),
        ))
    grouped = rows.groupBy(*by).agg(F.array(*entries).alias("_all"))
    return grouped.select(*by, F.inline("_all")).where("n > 0")


def merged_states(states: Sequence[DataFrame], by: Sequence[str] = ()) -> DataFrame:
    """The state of all rows behind the `states` together. Neither their rows nor their order matter.

    Means are merged by weight, and a state's products gain what its means differ from the common ones.
    """
    parts = reduce(DataFrame.unionByName, states)
    total = parts.groupBy(*by, "x", "y").agg(
        F.sum("n").alias("n"), F.collect_list(F.struct("n", "mean_x", "mean_y", "product")).alias("_parts")  # as many as states
    )

    def mean(c: str) -> Column:
        return F.aggregate("_parts", F.lit(0.0), lambda s, p: s + p["n"] / F.col("n") * p[c])

    merged = total.withColumns({c: mean(c) for c in ("mean_x", "mean_y")})
    product = F.aggregate("_parts", F.lit(0.0), lambda s, p: s + p["product"] + p["n"] * (p["mean_x"] - F.col("mean_x")) * (p["mean_y"] - F.col("mean_y")))
    return merged.select(*by, "x", "y", "n", "mean_x", "mean_y", product.alias("product"))


def moments_of(state: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """(by..., x, y, n, mean_x, mean_y, cov): what a state says; no covariance of a single row."""
    cov = F.when(F.col("n") > 1, F.col("product") / (F.col("n") - 1))
    return state.select(*by, "x", "y", "n", "mean_x", "mean_y", cov.alias("cov"))
