"""Grouped order statistics, densities by group, interval joins and orders within groups, against plain computations."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from spherecube.operators import density, keys, quantiles, trajectories


def plan_of(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


@pytest.mark.parametrize("gather", [10_000, 40, 1])
def test_grouped_quantiles(spark, monkeypatch, gather):
    monkeypatch.setattr(quantiles, "GATHER", gather)
    rng = random.Random(1)
    rows = [(g, float(rng.choice([rng.gauss(0, 1), 3.0, 3.0]))) for g in ["hot"] * 3000 + ["warm"] * 60 + ["one"] + [None] * 5]
    rows += [("hot", None), ("none", None), ("same", 2.0), ("same", 2.0), ("nan", float("nan")), ("nan", 4.0), ("wide", 1e308), ("wide", -1e308), ("wide", 0.0)]
    probs = [0.0, 0.25, 0.5, 0.9, 1.0]
    got = {r["g"]: r for r in quantiles.grouped_quantiles(spark.createDataFrame(rows, "g string, v double"), ["g"], "v", probs).collect()}
    assert len(got) == 8
    for g, r in got.items():
        values = sorted(v for k, v in rows if k == g and v is not None and v == v)
        missing = sum(1 for k, v in rows if k == g and (v is None or v != v))
        assert (r["n"], r["missing"]) == (len(values), missing)
        if g == "wide":
            assert r["quantiles"][0] == -1e308 and r["quantiles"][2] == 0.0
        else:
            assert (r["quantiles"] is None) if not values else np.allclose(r["quantiles"], np.quantile(values, probs))


def test_a_hot_group_is_counted_by_bins(spark, monkeypatch):
    """A few passes over bins leave no more values than a row may gather."""
    monkeypatch.setattr(quantiles, "GATHER", 100)
    df = spark.range(20_000).select(F.when(F.col("id") % 3 > 0, "hot").otherwise("cool").alias("g"), F.hash("id").cast("double").alias("v"))
    passes, real = [], quantiles._narrowed
    monkeypatch.setattr(quantiles, "_narrowed", lambda v, o: passes.append(1) or real(v, o))
    found = quantiles.grouped_quantiles(df, ["g"], "v", [0.5]).collect()
    values = df.toPandas().groupby("g")["v"].median()
    assert {r["g"]: r["quantiles"][0] for r in found} == pytest.approx(values.to_dict()) and 1 <= len(passes) <= 4
    assert quantiles.grouped_quantiles(df.limit(0), ["g"], "v", [0.5]).count() == 0


def test_strict_median_is_missing_with_a_missing_value(spark):
    df = spark.createDataFrame([("a", 1.0), ("a", None), ("b", 1.0), ("b", 4.0)], "k string, values double")
    loose, strict = ({r["k"]: r["values"] for r in quantiles.QuantileOf(0.5, s).over(df, ["k"], "values").collect()} for s in (False, True))
    assert loose == {"a": 1.0, "b": 2.5} and strict == {"a": None, "b": 2.5}


@pytest.fixture(scope="module")
def clouds(spark):
    rng = np.random.default_rng(0)
    rows = [("hot", float(a), float(b)) for a, b in rng.normal(0, 1, (4000, 2))] + [("b", float(a), float(b)) for a, b in rng.normal(5, 2, (50, 2))]
    rows += [(None, 1.0, 2.0), (None, 2.0, 4.0), (None, 4.0, 4.5), ("b", None, 1.0), ("b", 2.0, float("nan"))]
    return rows, spark.createDataFrame(rows, "g string, x double, y double")


@pytest.mark.parametrize(("sent", "held"), [(20_000, 64), (1, 1)])
def test_density_by_group_is_that_of_each_group(clouds, monkeypatch, sent, held):
    rows, df = clouds
    monkeypatch.setattr(density, "SENT", sent)
    monkeypatch.setattr(density, "HELD", held)
    got = density.density2d(df.repartition(3), "x", "y", 7, by=["g"]).collect()
    assert len(got) == 3 * 49
    for g in ("hot", "b", None):
        own = {(round(r["x"], 9), round(r["y"], 9)): r["density"] for r in got if r["g"] == g}
        alone = density.density2d(df.where(F.col("g").eqNullSafe(F.lit(g))), "x", "y", 7).collect()
        assert own.keys() == {(round(r["x"], 9), round(r["y"], 9)) for r in alone}
        assert all(own[round(r["x"], 9), round(r["y"], 9)] == pytest.approx(r["density"], rel=1e-9, abs=1e-300) for r in alone)


def test_points_of_a_density_are_neither_joined_nor_shuffled(clouds):
    _, df = clouds
    plan = plan_of(density.grouped_density(df, ["g"], "x", "y", 7, bandwidth=(1.0, 1.0)))
    below = plan[plan.index("MapInPandas"):]
    assert "Join" not in below and "Repartition" not in below and "Aggregate" not in below


def test_density_of_a_group_without_spread_is_an_error(spark):
    df = spark.createDataFrame([("a", 1.0, 1.0), ("b", 1.0, 2.0), ("b", 2.0, 3.0)], "g string, x double, y double")
    with pytest.raises(Exception, match="too few points"):
        density.density2d(df, "x", "y", 3, by=["g"]).collect()


def test_interval_join(spark):
    rng = random.Random(1)
    held = [(rng.choice("ab"), rng.randrange(-40, 40)) for _ in range(60)]
    held = [(k, a, a + rng.choice([0, 1, 2, 3, 7, 8, 30, -4]), i) for i, (k, a) in enumerate(held)] + [("a", None, 3, 100), (None, 1, 2, 101)]
    points = [(rng.choice("abc"), rng.randrange(-50, 80), i) for i in range(300)] + [("a", None, 999), (None, 1, 998), ("a", 5, 0)]
    p, h = spark.createDataFrame(points, "k string, t int, id int"), spark.createDataFrame(held, "k string, lo int, hi int, e int")
    expected = sorted((i, t, e) for k, t, i in points for q, a, b, e in held if k and k == q and None not in (t, a) and min(a, b) <= t <= max(a, b))
    assert sorted((r["id"], r["t"], r["e"]) for r in trajectories.interval_join(p, h, ["k"], "t", "lo", "hi").collect()) == expected
    left = trajectories.interval_join(p, h, ["k"], "t", "lo", "hi", "left").collect()
    alone = [(i, t, None) for _, t, i in points if (i, t) not in {(a, b) for a, b, _ in expected}]
    assert sorted(((r["id"], r["t"], r["e"]) for r in left), key=repr) == sorted(expected + alone, key=repr)
    assert trajectories.interval_join(p, h.limit(0), ["k"], "t", "lo", "hi").count() == 0


def test_intervals_make_few_rows_whatever_their_length(spark):
    pieces = trajectories.dyadic_pieces(F.col("a"), F.col("b"), 21)
    cut = spark.createDataFrame([(1, 1_000_000), (-7, 1_999_999), (5, 5), (0, 2**20 - 1)], "a long, b long").select("a", "b", pieces.alias("p")).collect()
    for r in cut:
        assert len(r["p"]) <= 2 * 21
        covered = sorted((x["block"] << x["level"], (x["block"] + 1 << x["level"]) - 1) for x in r["p"])
        assert covered[0][0] == r["a"] and covered[-1][1] == r["b"]
        assert all(b + 1 == c for (_, b), (c, _) in zip(covered, covered[1:], strict=False))


def test_interval_join_is_by_equal_values(spark):
    p = spark.range(10).select(F.lit("a").alias("k"), F.col("id").alias("t"))
    h = spark.range(10).select(F.lit("a").alias("k"), F.col("id").alias("lo"), (F.col("id") + 5).alias("hi"))
    plan = plan_of(trajectories.interval_join(p, h, ["k"], "t", "lo", "hi"))
    assert "Cross" not in plan and "(_level" in plan and "(_block" in plan


def test_interval_join_sends_points_once(spark):
    """Where lengths are alike there is one level; a few long intervals add some, and make few blocks each."""
    p = spark.range(2000).select(F.lit("a").alias("k"), F.col("id").alias("t"))
    h = spark.range(90).select(F.lit("a").alias("k"), (F.col("id") * 20).alias("lo"), (F.col("id") * 21).alias("hi"))
    assert "explode([0])" in plan_of(trajectories.interval_join(p, h, ["k"], "t", "lo", "hi"))
    alike = spark.range(1, 91).select(F.col("id").alias("n"))
    assert trajectories._levels(F.col("n"), alike)[1] == 1
    finest, levels, _ = trajectories._levels(F.col("n"), alike.union(spark.sql("SELECT 1L << 40")))
    assert finest <= 6 and 2**40 >> finest + levels - 1 <= 1 << 16
    assert trajectories._levels(F.col("n"), alike.limit(0)) == (0, 1, 1)


def test_interval_join_of_very_different_lengths(spark, monkeypatch):
    """Several levels above a coarse finest one, in several tasks."""
    monkeypatch.setattr(trajectories, "_MEAN_PIECES", 1)
    monkeypatch.setattr(trajectories, "_MOST_PIECES", 3)
    monkeypatch.setattr(trajectories, "_TASK_PIECES", 50)
    rng = random.Random(4)
    held = [(rng.choice("ab"), a := rng.randrange(-300, 300), a + rng.choice([5, 9, 14, 40, 700, -33]), i) for i in range(80)]
    points = [(rng.choice("ab"), rng.randrange(-400, 1100), i) for i in range(400)]
    p, h = spark.createDataFrame(points, "k string, t int, e int"), spark.createDataFrame(held, "k string, lo int, hi int, e int")
    finest, levels, tasks = trajectories._levels(F.abs(F.col("hi") - F.col("lo")) + 1, h)
    assert finest > 2 and levels > 2 and tasks > 1
    expected = sorted((k, t, i, a, b, e) for k, t, i in points for q, a, b, e in held if k == q and min(a, b) <= t <= max(a, b))
    assert sorted(map(tuple, trajectories.interval_join(p, h, ["k"], "t", "lo", "hi").collect())) == expected
    left = trajectories.interval_join(p, h, ["k"], "t", "lo", "hi", "left")
    assert left.columns == ["k", "t", "e", "lo", "hi", "e"]
    assert sorted(tuple(r) for r in left.collect() if r[5] is not None) == expected


def test_interval_join_is_exact_for_large_numbers(spark):
    far = 2**53
    p = spark.createDataFrame([("a", s * (far + k)) for s in (1, -1) for k in range(4)], "k string, t long")
    held = [("a", far + 1, far + 1, 1), ("a", far + 2, far + 3, 2), ("a", -far - 3, -far - 1, 3), ("a", far - 5, far - 1, 4)]
    found = trajectories.interval_join(p, spark.createDataFrame(held, "k string, lo long, hi long, e int"), ["k"], "t", "lo", "hi")
    expected = [(far + 1, 1), (far + 2, 2), (far + 3, 2), (-far - 1, 3), (-far - 2, 3), (-far - 3, 3)]
    assert sorted((r["t"], r["e"]) for r in found.collect()) == sorted(expected)


def test_pieces_of_whole_numbers_of_either_kind(spark):
    spans = spark.createDataFrame([(-9, 6), (3, 3), (0, 40)], "a int, b int")
    for kind in ("int", "long"):
        for levels in (1, 3, 7):
            pieces = trajectories.dyadic_pieces(F.col("a").cast(kind), F.col("b").cast(kind), levels)
            for r in spans.select("a", "b", pieces.alias("p")).collect():
                assert sorted(n for x in r["p"] for n in range(x["block"] << x["level"], x["block"] + 1 << x["level"])) == list(range(r["a"], r["b"] + 1))


def test_levels_in_order_within_groups(spark):
    rows = [(f"g{k % 3}", f"l{k % 17}", (k * 7919) % 101) for k in range(500)] + [("g0", None, 3), (None, "l1", 2), ("g1", "empty", None)]
    got = {(r["g"], r["l"]): r["ord"] for r in keys.order_levels_within(spark.createDataFrame(rows, "g string, l string, v int"), ["g"], "l", "v").collect()}
    low = {}
    for g, l, v in rows:
        low[g, l] = min([x for x in (low.get((g, l)), v) if x is not None], default=None)
    for g in {r[0] for r in rows}:
        names = sorted((l for q, l in low if q == g), key=lambda l: (low[g, l] is not None, low[g, l] or 0, l is not None, l or ""))
        assert [got[g, l] for l in names] == list(range(1, len(names) + 1))
