"""Two-dimensional kernel density on a grid."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import clean
from ..runtime import materialise
from .quantiles import grouped_quantiles, quantiles


def reference_bandwidth(sd: float, q1: float, q3: float, n: int) -> float:
    """Normal-reference bandwidth of an axis; a quarter of it is the kernel's standard deviation.

    Where half of the points share a place, so that the quartiles are equal, the deviation alone counts.
    """
    return 4 * 1.06 * (min(sd, (q3 - q1) / 1.34) if q3 > q1 else sd) * n ** -0.2


def density2d(
    points: DataFrame, x: str, y: str, grid_n: int = 100,
    bandwidth: Sequence[float] | None = None, limits: Sequence[float] | None = None, by: Sequence[str] = (),
) -> DataFrame:
    """(by..., x, y, density) on a `grid_n` x `grid_n` grid over `limits` (xmin, xmax, ymin, ymax; the range of the points).

    The Gaussian kernel is a product of one factor per axis, so a batch of points adds the product of two thin
    matrices to the grid. A task emits one grid, and grids are summed by cell: no point meets the grid in a join.

    With `by`, every group has a density of its own, see `grouped_density`; without, all points are one group.
    """
    if by:
        return grouped_density(points, by, x, y, grid_n, bandwidth, limits)
    pts = points.select(clean(x).alias("x"), clean(y).alias("y")).dropna()
    row = pts.agg(
        F.count(F.lit(1)), F.min("x"), F.max("x"), F.min("y"), F.max("y"), F.stddev_samp("x"), F.stddev_samp("y")
    ).first()
    n = row[0]
    if n < 2:
        raise ValueError(f"{n} points are too few for a density")
    if bandwidth is None:
        q = quantiles(pts, ["x", "y"], [0.25, 0.75], {"x": (n, row[1], row[2]), "y": (n, row[3], row[4])})
        bandwidth = [reference_bandwidth(sd, *q[c], n) for c, sd in (("x", row[5]), ("y", row[6]))]
    hx, hy = (h / 4 for h in bandwidth)
    if hx <= 0 or hy <= 0:
        raise ValueError("bandwidths must be positive")
    x0, x1, y0, y1 = limits or row[1:5]
    gx, gy = np.linspace(x0, x1, grid_n), np.linspace(y0, y1, grid_n)

    def sums(batches):
        total = np.zeros((grid_n, grid_n))
        for batch in batches:
            kx = np.exp(-0.5 * ((gx[:, None] - batch["x"].to_numpy()) / hx) ** 2)
            ky = np.exp(-0.5 * ((gy[:, None] - batch["y"].to_numpy()) / hy) ** 2)
            total += kx @ ky.T
        ix, iy = np.indices(total.shape)
        yield pd.DataFrame({"ix": ix.ravel(), "iy": iy.ravel(), "s": total.ravel()})

    cells = pts.mapInPandas(sums, "ix int, iy int, s double").groupBy("ix", "iy").agg(F.sum("s").alias("s"))
    step = grid_n - 1 if grid_n > 1 else 1
    return cells.select(
        (F.lit(float(x0)) + F.col("ix") * F.lit((x1 - x0) / step)).alias("x"),
        (F.lit(float(y0)) + F.col("iy") * F.lit((y1 - y0) / step)).alias("y"),
        (F.col("s") / F.lit(2 * np.pi * n * hx * hy)).alias("density"),
    )


#: Groups whose axes a task gets with its code, beyond which they are joined to the points; grids a task holds at once.
SENT, HELD = 20_000, 64


def group_axes(
    points: DataFrame, by: Sequence[str], bandwidth: Sequence[float] | None, limits: Sequence[float] | None
) -> DataFrame:
    """(by..., n, x0, x1, y0, y1, hx, hy): number of points, range and kernel deviation of every group of (by..., x, y).

    Where half of a group's points share a place of an axis, so that its quartiles are equal, the standard deviation alone
    gives the bandwidth. A group of fewer than two points, or without spread on an axis, has no density: that is an error.
    """
    stats = points.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"), F.min("x").alias("x0"), F.max("x").alias("x1"), F.min("y").alias("y0"), F.max("y").alias("y1"),
        F.stddev_samp("x").alias("_sx"), F.stddev_samp("y").alias("_sy"),
    )
    if limits is not None:
        stats = stats.withColumns({c: F.lit(float(v)) for c, v in zip(("x0", "x1", "y0", "y1"), limits)})
    same = lambda a, b: reduce(Column.__and__, [F.col(f"{a}.`{c}`").eqNullSafe(F.col(f"{b}.`{c}`")) for c in by])
    if bandwidth is None:
        for c in "xy":
            spread = grouped_quantiles(points, by, c, [0.25, 0.75], "_q").drop("n", "missing")
            iqr = (F.col("_q")[1] - F.col("_q")[0]) / 1.34
            joined = stats.alias("s").join(spread.alias("q"), same("s", "q"))
            spread_of = F.least(F.col(f"_s{c}"), F.nullif(iqr, F.lit(0.0)))  # skips a missing one
            stats = joined.select("s.*", (1.06 * spread_of * F.pow(F.col("n"), F.lit(-0.2))).alias(f"h{c}"))
    else:
        stats = stats.withColumns({f"h{c}": F.lit(h / 4) for c, h in zip("xy", bandwidth)})
    wrong = F.raise_error(F.lit("a group has too few points or no spread for a density"))
    fine = (F.col("n") >= 2) & (F.col("hx") > 0) & (F.col("hy") > 0)
    return stats.select(*by, "n", "x0", "x1", "y0", "y1", F.when(fine, F.col("hx")).otherwise(wrong.cast("double")).alias("hx"), "hy")


def grouped_density(
    points: DataFrame, by: Sequence[str], x: str, y: str, grid_n: int = 100,
    bandwidth: Sequence[float] | None = None, limits: Sequence[float] | None = None,
) -> DataFrame:
    """(by..., x, y, density): a kernel density for every group, all from one pass over the points.

    A task keeps the grids of the groups it meets, HELD of them at most, and emits a grid's sums when it makes room or
    ends. Points are not shuffled, so a hot group is spread over all tasks; only grids are, and those are summed by cell.
    A task gets the axes of all groups with its code; of more than SENT groups they are joined to the points instead.
    Points with a missing coordinate are left out; a missing key is a group of its own.
    """
    pts = points.select(*by, clean(x).alias("x"), clean(y).alias("y")).dropna(subset=["x", "y"])
    axes = group_axes(pts, by, bandwidth, limits).withColumn("_id", F.xxhash64(*[F.coalesce(F.to_json(F.struct(c)), F.lit("")) for c in by]))
    axes = materialise(axes)
    numbers = ["x0", "x1", "y0", "y1", "hx", "hy"]
    known = axes.count()
    if known != axes.select("_id").distinct().count():
        raise ValueError("two groups have the same hash")
    keyed = pts.withColumn("_id", F.xxhash64(*[F.coalesce(F.to_json(F.struct(c)), F.lit("")) for c in by])).select("_id", "x", "y")
    sent = None
    if known <= SENT:
        sent = points.sparkSession.sparkContext.broadcast({r["_id"]: tuple(r[c] for c in numbers) for r in axes.select("_id", *numbers).collect()})
    else:
        keyed = keyed.join(axes.select("_id", *numbers), "_id").select("_id", "x", "y", F.struct(*numbers).alias("axes"))

    def grids(batches):
        held: dict[int, np.ndarray] = {}
        ix, iy = (i.ravel() for i in np.indices((grid_n, grid_n)))

        def out(group):
            total = held.pop(group).ravel()
            some = np.flatnonzero(total)
            return pd.DataFrame({"_id": np.full(len(some), group), "ix": ix[some], "iy": iy[some], "s": total[some]})

        for batch in batches:
            for group, rows in batch.groupby("_id"):
                x0, x1, y0, y1, hx, hy = sent.value[group] if sent else (rows["axes"].iloc[0][c] for c in numbers)
                kx = np.exp(-0.5 * ((np.linspace(x0, x1, grid_n)[:, None] - rows["x"].to_numpy()) / hx) ** 2)
                ky = np.exp(-0.5 * ((np.linspace(y0, y1, grid_n)[:, None] - rows["y"].to_numpy()) / hy) ** 2)
                if group not in held and len(held) >= HELD:
                    yield out(next(iter(held)))
                held[group] = held.get(group, 0) + kx @ ky.T
        for group in list(held):
            yield out(group)

    cells = keyed.mapInPandas(grids, "_id long, ix int, iy int, s double").groupBy("_id", "ix", "iy").agg(F.sum("s").alias("s"))
    # Cells that no kernel reaches, in numbers as small as these are, have density 0.
    whole = axes.withColumn("ix", F.explode(F.sequence(F.lit(0), F.lit(grid_n - 1)))).withColumn("iy", F.explode(F.sequence(F.lit(0), F.lit(grid_n - 1))))
    filled = whole.join(cells, ["_id", "ix", "iy"], "left")
    step = grid_n - 1 if grid_n > 1 else 1
    return filled.select(
        *by,
        (F.col("x0") + F.col("ix") * (F.col("x1") - F.col("x0")) / step).alias("x"),
        (F.col("y0") + F.col("iy") * (F.col("y1") - F.col("y0")) / step).alias("y"),
        (F.coalesce("s", F.lit(0.0)) / (2 * np.pi * F.col("n") * F.col("hx") * F.col("hy"))).alias("density"),
    )
