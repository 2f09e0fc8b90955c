"""Multivariate operators against plain numpy on collected data."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from spherecube.catalog import frames as fx
from spherecube.operators import cca, density, factors, moments, normalize, quantiles

NAMES = [f"v{k}" for k in range(9)]


@pytest.fixture(scope="module")
def data():
    rng = np.random.default_rng(5)
    base = rng.normal(size=(400, 4))
    noise = rng.normal(size=(400, 9))
    return base @ rng.normal(size=(4, 9)) + 0.7 * noise + np.arange(9)


@pytest.fixture(scope="module")
def cube(spark, data):
    rows = [(f"R{k % 20}", f"{2000 + k // 20}-Q1", *map(float, v)) for k, v in enumerate(data)]
    return spark.createDataFrame(rows, "geo string, time string, " + ", ".join(f"{c} double" for c in NAMES)).cache()


def reference_cca(x, y):
    """Textbook solution by QR and singular values."""
    qx, rx = np.linalg.qr(x - x.mean(axis=0))
    qy, ry = np.linalg.qr(y - y.mean(axis=0))
    u, cor, vt = np.linalg.svd(qx.T @ qy, full_matrices=False)
    return cor, np.linalg.solve(rx, u), np.linalg.solve(ry, vt.T)


@pytest.mark.parametrize("p", [2, 8])
def test_infinite_values_are_refused(cube, p):
    wild = cube.withColumn("v0", F.when(F.col("v0") > 0, F.col("v0")).otherwise(F.lit(float("inf"))))
    with pytest.raises(ValueError, match="not finite"):
        moments.cross_moments(wild, NAMES[:p])


@pytest.mark.parametrize("p", [4, 9])
def test_cross_moments(cube, data, p):
    m = moments.cross_moments(cube, NAMES[:p])
    assert m.n == 400
    assert m.mean == pytest.approx(data[:, :p].mean(axis=0))
    assert m.cov == pytest.approx(np.cov(data[:, :p], rowvar=False))


@pytest.mark.parametrize("px, py", [(2, 2), (3, 2), (4, 5)])
def test_cca_against_qr(cube, data, px, py):
    x, y = NAMES[:px], NAMES[px:px + py]
    model = cca.cca_fit(cube, x, y)
    cor, xcoef, ycoef = reference_cca(data[:, :px], data[:, px:px + py])
    assert model.cor == pytest.approx(cor)
    k = len(cor)
    assert np.abs(model.xcoef) == pytest.approx(np.abs(xcoef[:, :k]), rel=1e-6)
    assert np.abs(model.ycoef) == pytest.approx(np.abs(ycoef[:, :k]), rel=1e-6)
    assert (np.diff(model.cor) <= 0).all() and (model.cor >= 0).all() and (model.cor <= 1).all()
    assert (model.xcoef[np.abs(model.xcoef).argmax(axis=0), range(k)] > 0).all()


def test_scores_are_orthonormal_and_correlated(cube, data):
    model = cca.cca_fit(cube, NAMES[:3], NAMES[3:6])
    both = cca.cca_both_scores(cube, model).toPandas()[["fwd_CCA1", "fwd_CCA2", "rev_CCA1", "rev_CCA2"]].to_numpy()
    centred = both - both.mean(axis=0)
    gram = centred.T @ centred
    assert gram[:2, :2] == pytest.approx(np.eye(2), abs=1e-9)
    assert gram[2:, 2:] == pytest.approx(np.eye(2), abs=1e-9)
    assert np.diag(gram[:2, 2:]) == pytest.approx(model.cor[:2])
    back = cca.cca_fit(cube, NAMES[3:6], NAMES[:3])
    assert back.cor == pytest.approx(model.cor)


def test_linear_map_correlates_fully(cube):
    mapped = cube.withColumns({"a": F.col("v0") * 2 + F.col("v1") + 1, "b": F.col("v0") - F.col("v1")})
    assert cca.cca_fit(mapped, ["v0", "v1"], ["a", "b"]).cor == pytest.approx([1, 1])


def test_dependent_features_are_named(cube):
    bad = cube.withColumns({"twice": F.col("v0") * 2 + F.col("v1"), "flat": F.lit(3.0)})
    with pytest.raises(ValueError, match="twice"):
        cca.cca_fit(bad, ["v0", "v1", "twice"], ["v2", "v3"])
    with pytest.raises(ValueError, match="flat"):
        cca.cca_fit(bad, ["v0", "flat"], ["v2", "v3"])
    with pytest.raises(ValueError, match="at least 2"):
        cca.cca_fit(cube, ["v0"], ["v2", "v3"])


def test_gram(cube, data):
    assert moments.gram(cube, NAMES) == pytest.approx(data.T @ data)


@pytest.mark.parametrize("p", [2, 8])
def test_missing_values_are_refused(cube, p):
    gaps = cube.withColumn("v0", F.when(F.col("v0") > 0, F.col("v0")))
    with pytest.raises(ValueError, match="v0"):
        moments.cross_moments(gaps, NAMES[:p])


def test_pairwise_agrees_with_single_fits(cube):
    spheres = {"a": NAMES[:2], "b": NAMES[2:5], "c": NAMES[5:7]}
    models = cca.pairwise_cca(cube, spheres)
    assert len(models) == 6
    for (x, y), m in models.items():
        assert m.cor == pytest.approx(cca.cca_fit(cube, spheres[x], spheres[y]).cor)
    scores = cca.pairwise_scores(cube, models)
    one = cca.cca_scores(cube, models["a", "c"]).toPandas().sort_values(["geo", "time"])
    same = scores.where("x = 'a' and y = 'c'").toPandas().sort_values(["geo", "time"])
    assert same["CCA2"].to_numpy() == pytest.approx(one["CCA2"].to_numpy())


def test_known_correlations_of_the_nation_cube(spark):
    """Quarterly sums by nation at scale factor 0.01."""
    d = "/root/testdata/sf0.01"
    orders = fx.table(spark, d, "orders").join(fx.customers(spark, d), F.col("o_custkey") == F.col("c_custkey"))
    day = F.col("o_orderdate").cast("date")
    cells = orders.groupBy("geo1", F.year(day).alias("y"), F.quarter(day).alias("q")).agg(
        F.sum("o_totalprice").alias("x1"), F.avg("c_acctbal").alias("x2"), F.count("*").cast("double").alias("y1"),
        F.avg((F.col("o_orderstatus") == "F").cast("double")).alias("y2"),
    )
    model = cca.cca_fit(cells, ["x1", "x2"], ["y1", "y2"])
    assert model.cor == pytest.approx([0.91920826, 0.01786445], abs=1e-8)


def test_pca(cube, data):
    model = factors.pca_fit(cube, NAMES[:5])
    z = (data[:, :5] - data[:, :5].mean(axis=0)) / data[:, :5].std(axis=0, ddof=1)
    values, vectors = np.linalg.eigh(np.corrcoef(z, rowvar=False))
    assert model.eigenvalues == pytest.approx(values[::-1])
    assert np.abs(model.rotation) == pytest.approx(np.abs(vectors[:, ::-1]))
    scores = factors.pca_scores(cube, model).toPandas()[[f"PC{k}" for k in range(1, 6)]].to_numpy()
    assert scores == pytest.approx(z @ model.rotation)


def test_density_against_direct_sum(cube, data):
    out = density.density2d(cube, "v0", "v1", grid_n=7).toPandas().sort_values(["x", "y"])
    x, y = data[:, 0], data[:, 1]

    def kernel_sd(v):
        q1, q3 = np.quantile(v, [0.25, 0.75])
        return 1.06 * min(v.std(ddof=1), (q3 - q1) / 1.34) * len(v) ** -0.2

    hx, hy = kernel_sd(x), kernel_sd(y)
    expected = [
        np.exp(-0.5 * (((x - gx) / hx) ** 2 + ((y - gy) / hy) ** 2)).sum() / (2 * np.pi * len(x) * hx * hy)
        for gx in np.linspace(x.min(), x.max(), 7) for gy in np.linspace(y.min(), y.max(), 7)
    ]
    assert out["density"].to_numpy() == pytest.approx(np.array(expected))


@pytest.mark.parametrize("kind", ["normal", "ties", "two", "hot"])
def test_exact_quantiles(spark, kind, monkeypatch):
    monkeypatch.setattr(quantiles, "BINS", 7)  # few, so that searches need several rounds
    rng = np.random.default_rng(3)
    v = {
        "normal": rng.normal(size=5000),
        "ties": rng.integers(0, 7, 5000).astype(float),
        "two": np.r_[np.zeros(2500), np.ones(2501)],
        "hot": np.r_[np.full(2000, 3.5), rng.exponential(size=3001)],
    }[kind]
    df = spark.createDataFrame([(float(x), float(-x) if k % 3 else None) for k, x in enumerate(v)], "a double, b double")
    probs = [0.0, 0.25, 0.5, 0.75, 0.9, 1.0]
    out = quantiles.quantiles(df, ["a", "b"], probs)
    assert out["a"] == pytest.approx(np.quantile(v, probs))
    assert out["b"] == pytest.approx(np.quantile([-x for k, x in enumerate(v) if k % 3], probs))


def _tensor(spark, x):
    g, f, t = x.shape
    rows = [(f"g{i}", f"t{k}", *map(float, x[i, :, k])) for i in range(g) for k in range(t)]
    return spark.createDataFrame(rows, "geo string, time string, " + ", ".join(f"f{j} double" for j in range(f)))


def test_threeway_recovers_a_low_rank_tensor(spark):
    rng = np.random.default_rng(11)
    a, b, c = rng.normal(size=(30, 2)), rng.normal(size=(4, 2)), rng.normal(size=(5, 2))
    x = np.einsum("pqr,ip,jq,kr->ijk", rng.normal(size=(2, 2, 2)), a, b, c)
    model = factors.threeway_fit(_tensor(spark, x), [f"f{j}" for j in range(4)], [f"t{k}" for k in range(5)])
    assert model.fit == pytest.approx(1)
    geo = model.geo.toPandas().assign(n=lambda d: d["geo"].str[1:].astype(int)).sort_values("n")[["F1", "F2"]].to_numpy()
    assert geo.T @ geo == pytest.approx(np.eye(2), abs=1e-8)
    assert np.einsum("pqr,ip,jq,kr->ijk", model.core, geo, model.b, model.c) == pytest.approx(x, abs=1e-8)


def test_threeway_is_at_least_as_good_as_truncation(spark):
    rng = np.random.default_rng(12)
    x = rng.normal(size=(25, 4, 6))
    model = factors.threeway_fit(_tensor(spark, x), [f"f{j}" for j in range(4)], [f"t{k}" for k in range(6)], iterations=8)

    def leading(mode, k):
        m = np.moveaxis(x, mode, 0).reshape(x.shape[mode], -1)
        return np.linalg.svd(m, full_matrices=False)[0][:, :k]

    core = np.einsum("ijk,ip,jq,kr->pqr", x, leading(0, 2), leading(1, 2), leading(2, 2))
    assert model.fit >= (core ** 2).sum() / (x ** 2).sum() - 1e-9
    assert model.fit == pytest.approx((model.core ** 2).sum() / (x ** 2).sum())
    assert model.b.T @ model.b == pytest.approx(np.eye(2), abs=1e-9)


def test_scaling_and_detrending_invariants(spark, sf_dir):
    raw = fx.raw_cube(spark, sf_dir).cache()
    scaled = normalize.column_moments(normalize.zscore_impute(raw.dropna())).collect()
    assert all(abs(r["mean"]) < 1e-9 and abs(r["sd"] - 1) < 1e-9 for r in scaled)
    seasonless = normalize.detrend(raw)
    means = seasonless.groupBy("geo", F.substring("time", 6, 2)).agg(*[F.avg(c).alias(c) for c in fx.CUBE_FEATURES])
    worst = means.agg(*[F.max(F.abs(c)) for c in fx.CUBE_FEATURES]).first()
    assert max(worst) < 1e-6
    raw.unpersist()
