"""Principal components and three-way factors."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..runtime import materialise
from .cca import combination
from .moments import cross_moments, oriented_signs

# Numbers of a dense piece of regions.
PIECE = 2_000_000


def _leading(matrix: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The k largest eigenvalues and their vectors."""
    values, vectors = np.linalg.eigh(matrix)
    order = np.argsort(values)[::-1][:k]
    return values[order], vectors[:, order] * oriented_signs(vectors[:, order])


@dataclass(frozen=True)
class PcaModel:
    names: tuple[str, ...]
    mean: np.ndarray
    sd: np.ndarray
    eigenvalues: np.ndarray
    rotation: np.ndarray


def pca_fit(df: DataFrame, cols: Sequence[str], k: int | None = None) -> PcaModel:
    """Principal components of the correlation matrix."""
    m = cross_moments(df, cols)
    sd = np.sqrt(np.diag(m.cov))
    if (sd <= 0).any():
        raise ValueError(f"constant columns: {', '.join(c for c, s in zip(m.names, sd) if s <= 0)}")
    values, rotation = _leading(m.cov / np.outer(sd, sd), k or len(m.names))
    return PcaModel(m.names, m.mean, sd, values, rotation)


def pca_scores(df: DataFrame, model: PcaModel) -> DataFrame:
    """The rows with columns PC1, PC2, ... added."""
    axes = {}
    for k in range(model.rotation.shape[1]):
        w = model.rotation[:, k] / model.sd
        axes[f"PC{k + 1}"] = combination(model.names, w) - F.lit(float(w @ model.mean))
    return df.withColumns(axes)


def pca_rotation(spark: SparkSession, model: PcaModel) -> DataFrame:
    axes = [f"PC{k + 1}" for k in range(model.rotation.shape[1])]
    rows = [(c, *map(float, model.rotation[i])) for i, c in enumerate(model.names)]
    return spark.createDataFrame(rows, "name string, " + ", ".join(f"{a} double" for a in axes))


def pca_variances(spark: SparkSession, model: PcaModel) -> DataFrame:
    rows = [(k + 1, float(v)) for k, v in enumerate(model.eigenvalues)]
    return spark.createDataFrame(rows, "component int, variance double")


@dataclass(frozen=True)
class ThreewayModel:
    """Tucker model of geo x feature x time: the geo factors stay distributed, the rest is small."""

    geo: DataFrame
    features: tuple[str, ...]
    times: tuple[str, ...]
    b: np.ndarray
    c: np.ndarray
    core: np.ndarray
    fit: float


def threeway_fit(
    cube: DataFrame, features: Sequence[str], times: Sequence[str], ranks: tuple[int, int, int] = (2, 2, 2),
    iterations: int = 10, tolerance: float = 1e-6,
) -> ThreewayModel:
    """Tucker-3 factors by sequentially truncated HOSVD and alternating least squares.

    `times` is the time axis; feature and time mode are short, so their Gram matrices reach the driver. The geo mode is
    long: no region-by-region matrix is ever formed. With both short modes projected, a region is a handful of numbers,
    and its factor is a linear combination of these. Missing values count as zero. `cube` is read and shuffled once, into
    a stored table of one row per region; an iteration is one reading of that table.
    """
    p, q, r = ranks
    features, times = tuple(features), tuple(times)
    if q > len(features) or r > len(times) or p > q * r:
        raise ValueError(f"ranks {ranks} exceed the modes")
    shape = len(times), len(features)
    regions = materialise(_by_region(cube, features, times))
    tensors, projected = _piecewise(shape)

    by_feature = _summed(regions, shape, lambda x: x.reshape(-1, shape[1]).T @ x.reshape(-1, shape[1]))
    norm = float(np.trace(by_feature))
    b = _leading(by_feature, q)[1]

    def time_products(x):
        scores = (x @ b).transpose(1, 0, 2).reshape(shape[0], -1)
        return scores @ scores.T

    c = _leading(_summed(regions, shape, time_products), r)[1]
    fit, last = 0.0, -1.0
    for step in range(iterations + 1):
        # What the projected regions have in common with the cube: all that the next factors depend on.
        shared = _summed(regions, shape, lambda x: projected(x, b, c).T @ x.reshape(len(x), -1)).reshape(q * r, *shape)
        values, v = _leading(np.einsum("ktf,fq,tr->kqr", shared, b, c).reshape(q * r, q * r), p)
        scale = np.sqrt(np.maximum(values, 0))
        weights = v / np.where(scale > 0, scale, np.inf)
        core = (v * scale).T.reshape(p, q, r)
        fit = float(values.sum()) / norm if norm > 0 else 0.0
        # Geo factors and core belong to the b and c they were computed from, so the last pass updates neither.
        if step == iterations or fit - last < tolerance:
            break
        last = fit
        y = np.einsum("kp,ktf->pft", weights, shared)
        by_feature = np.einsum("pft,tr->fpr", y, c).reshape(shape[1], -1)
        b = _leading(by_feature @ by_feature.T, q)[1]
        by_time = np.einsum("pft,fq->tpq", y, b).reshape(shape[0], -1)
        c = _leading(by_time @ by_time.T, r)[1]

    def factors(batches):
        for geo, x in tensors(batches):
            yield pa.RecordBatch.from_arrays([geo, *map(pa.array, (projected(x, b, c) @ weights).T)], names=names)

    names = ["geo", *[f"F{k + 1}" for k in range(p)]]
    schema = ", ".join([f"geo {dict(regions.dtypes)['geo']}", *[f"{n} double" for n in names[1:]]])
    return ThreewayModel(regions.mapInArrow(factors, schema), features, times, b, c, core, fit)


def _by_region(cube: DataFrame, features: Sequence[str], times: Sequence[str]) -> DataFrame:
    """(geo, cells): a row per region with the features of each time, as long as the time axis at most."""
    place = F.create_map(*[F.lit(v) for i, t in enumerate(times) for v in (t, i)])
    values = F.array(*[F.coalesce(F.col(f"`{f}`").cast("double"), F.lit(0.0)) for f in features])
    cell = F.struct(place[F.col("time")].alias("t"), values.alias("v"))
    return cube.where(F.col("time").isin(*times)).groupBy("geo").agg(F.collect_list(cell).alias("cells"))


def _piecewise(shape: tuple[int, int]):
    """Functions for tasks: one cuts batches into values (region, time, feature) of bounded size, one projects them."""
    step = max(1, PIECE // (shape[0] * shape[1]))

    def tensors(batches):
        for batch in batches:
            for start in range(0, batch.num_rows, step):
                part = batch.slice(start, step)
                lists = part.column("cells")
                cells = lists.flatten()
                rows = np.repeat(np.arange(part.num_rows), np.asarray(lists.value_lengths()))
                x = np.zeros((part.num_rows, *shape))
                np.add.at(x, (rows, np.asarray(cells.field("t"))), np.asarray(cells.field("v").flatten()).reshape(-1, shape[1]))
                yield part.column("geo"), x

    def projected(x, b, c):
        """The q x r numbers that remain of each region, in a row."""
        return np.einsum("ntq,tr->nqr", x @ b, c).reshape(len(x), -1)

    return tensors, projected


def _summed(regions: DataFrame, shape: tuple[int, int], product) -> np.ndarray:
    """The sum of `product` over all pieces: each task adds up one matrix, matrices are summed by entry."""

    tensors, _ = _piecewise(shape)

    def partial(batches):
        total = None
        for _, x in tensors(batches):
            found = product(x)
            total = found if total is None else total + found
        if total is not None:
            i, j = np.indices(total.shape)
            yield pa.RecordBatch.from_arrays([pa.array(i.ravel()), pa.array(j.ravel()), pa.array(total.ravel())], names=["i", "j", "s"])

    entries = regions.mapInArrow(partial, "i long, j long, s double").groupBy("i", "j").agg(F.sum("s").alias("s")).toPandas()
    if entries.empty:
        raise ValueError("no region has a row on the time axis")
    out = np.zeros((entries["i"].max() + 1, entries["j"].max() + 1))
    out[entries["i"], entries["j"]] = entries["s"]
    if not np.isfinite(out).all():
        raise ValueError("features with values that are not finite")
    return out


def threeway_estimate(model: ThreewayModel) -> DataFrame:
    """(geo, time, features): the cube that the factors stand for, every region on the whole time axis."""
    weights = np.einsum("pqr,fq,tr->ptf", model.core, model.b, model.c).reshape(model.core.shape[0], -1)
    times = list(model.times)
    n_times, n_features = len(times), len(model.features)
    step = max(1, PIECE // (n_times * n_features))

    def estimate(batches):
        for batch in batches:
            for start in range(0, batch.num_rows, step):
                part = batch.slice(start, step)
                z = np.column_stack([np.asarray(f) for f in part.columns[1:]])
                values = (z @ weights).reshape(-1, n_features)
                geo = part.column("geo").take(pa.array(np.repeat(np.arange(part.num_rows), n_times)))
                time = pa.array(times * part.num_rows, pa.string())
                yield pa.RecordBatch.from_arrays([geo, time, *map(pa.array, values.T)], names=names)

    names = ["geo", "time", *model.features]
    schema = ", ".join([f"geo {dict(model.geo.dtypes)['geo']}", "time string", *[f"`{f}` double" for f in model.features]])
    return model.geo.mapInArrow(estimate, schema)


def threeway_factors(spark: SparkSession, model: ThreewayModel) -> DataFrame:
    """(mode, label, component, value) of all three factor matrices."""
    p = model.core.shape[0]
    rows = [
        (mode, label, k + 1, float(m[i, k]))
        for mode, labels, m in (("feature", model.features, model.b), ("time", model.times, model.c))
        for i, label in enumerate(labels) for k in range(m.shape[1])
    ]
    small = spark.createDataFrame(rows, "mode string, label string, component int, value double")
    axes = F.array(*[F.struct(F.lit(k).alias("component"), F.col(f"F{k}").alias("value")) for k in range(1, p + 1)])
    geo = model.geo.select(F.lit("geo").alias("mode"), F.col("geo").alias("label"), F.inline(axes))
    return geo.unionByName(small)


def threeway_core(spark: SparkSession, model: ThreewayModel) -> DataFrame:
    rows = [(i + 1, j + 1, k + 1, float(v)) for (i, j, k), v in np.ndenumerate(model.core)]
    return spark.createDataFrame(rows, "geo_component int, feature_component int, time_component int, value double")
