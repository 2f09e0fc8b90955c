"""Small cases with answers worked out by hand."""

import datetime
import math
from collections import Counter

import pytest
from pyspark.sql import functions as F

from spherecube.catalog.frames import INTERVALS
from spherecube.functions import (
    axis_of, country_of, domain_of, quarter_start, region_code, replace_zero, strict_mean, tidy, united,
)
from spherecube.operators import crosswalk, keys, normalize, regions, reshape, timeaxis, trajectories
from spherecube.schema import EVENTS, FEATURES

DAY = datetime.date


@pytest.mark.parametrize("by, expected", [
    ("season", [-1, -2, 1, 2]), ("year", [-2, 2, -3, 3]), ("both", [0.5, -0.5, -0.5, 0.5]),
])
def test_detrend(table, by, expected):
    cube = table("geo string, time string, v double",
                 ("A", "2001-Q1", 1.0), ("A", "2001-Q2", 5.0), ("A", "2002-Q1", 3.0), ("A", "2002-Q2", 9.0))
    assert [r["v"] for r in normalize.detrend(cube, by).orderBy("time").collect()] == expected


def _months(table):
    return table("var string, geo string, freq string, TIME_PERIOD date, values double", *[
        ("v", "A", "M", DAY(2001, m, 1), x) for m, x in enumerate([1.0, None, 3.0, 2.0, 4.0, 6.0], 1)
    ])


def test_month_to_quarter_needs_every_month(table, rows):
    out = timeaxis.resample_month_to_quarter(_months(table))
    assert rows(out, "time", "values") == [("2001-Q1", None), ("2001-Q2", 4.0)]


def test_month_to_quarter_other_aggregate(table, rows):
    out = timeaxis.resample_month_to_quarter(_months(table), F.avg)
    assert rows(out, "time", "values") == [("2001-Q1", 2.0), ("2001-Q2", 4.0)]


def test_year_to_quarter(table, rows):
    out = timeaxis.resample_time(table(
        "var string, geo string, freq string, TIME_PERIOD date, values double", ("v", "A", "A", DAY(2001, 1, 1), 8.0)))
    assert rows(out, "time", "values") == [(f"2001-Q{q}", 8.0) for q in (1, 2, 3, 4)]


@pytest.mark.parametrize("freq", ["W", None])
def test_unknown_frequency_fails(table, freq):
    df = table("var string, geo string, freq string, TIME_PERIOD date, values double", ("v", "A", freq, DAY(2001, 1, 1), 8.0))
    with pytest.raises(Exception, match="unknown frequency"):
        timeaxis.resample_time(df).collect()


@pytest.fixture
def tree(table):
    return table("geo3 string, geo2 string, geo1 string, geo0 string",
                 ("XA111", "XA11", "XA1", "XA"), ("XA112", "XA11", "XA1", "XA"), ("XA121", "XA12", "XA1", "XA"),
                 ("XA131", "XA13", "XA1", "XA"))


@pytest.fixture
def mixed(table):
    return table("geo string, time string, values double",
                 ("XA11", "t", 1.0), ("XA12", "t", 2.0), ("XA111", "t", 9.0))


def test_majority_level(tree, mixed, rows):
    levels = regions.region_levels(tree)
    assert rows(regions.majority_level(mixed, levels)) == [(2,)]
    assert rows(regions.infer_level(mixed, levels)) == [(3,)]
    out = regions.resample_space(mixed, tree, levels)
    assert rows(out) == [("XA111", "t", 1.0), ("XA112", "t", 1.0), ("XA121", "t", 2.0)]


def test_dataset_of_unknown_codes_is_an_error(tree, table):
    df = table("var string, geo string, values double", ("a", "XA11", 1.0), ("b", "YY11", 2.0))
    with pytest.raises(Exception, match="without known region codes"):
        regions.resample_space(df, tree, regions.region_levels(tree), by=["var"]).collect()


def test_level_tie_goes_to_the_lower_level(tree, table, rows):
    df = table("geo string, values double", ("XA", 1.0), ("XA11", 2.0))
    assert rows(regions.majority_level(df, regions.region_levels(tree))) == [(0,)]


def test_finest_level(tree, mixed, rows):
    out = regions.resample_space(mixed, tree, regions.region_levels(tree), "finest")
    assert rows(out) == [("XA111", "t", 9.0)]


def test_finest_level_keeps_childless_leaves(tree, mixed, rows):
    coarse = mixed.where("length(geo) = 4")
    out = regions.resample_space(coarse, tree, regions.region_levels(tree), "finest")
    assert rows(out) == [("XA111", "t", 1.0), ("XA112", "t", 1.0), ("XA121", "t", 2.0), ("XA131", None, None)]


def test_leaf_majority_is_passed_on_unfiltered(tree, table, rows):
    df = table("geo string, values double", ("XA111", 1.0), ("XA112", 2.0), ("XA", 3.0), ("XA121", 4.0))
    assert rows(regions.resample_space(df, tree, regions.region_levels(tree))) == rows(df)


def test_resample_space_per_dataset(tree, table, rows):
    df = table("code string, geo string, values double", ("a", "XA1", 1.0), ("b", "XA131", 2.0))
    out = regions.resample_space(df, tree, regions.region_levels(tree), by=["code"])
    assert rows(out) == [("a", f"XA{k}", 1.0) for k in ("111", "112", "121", "131")] + [("b", "XA131", 2.0)]


def test_few_regions_of_many_leaves_are_lifted_by_many_tasks(spark, table, monkeypatch):
    monkeypatch.setattr(regions, "_PART_ROWS", 500, raising=False)
    monkeypatch.setattr(regions, "_TASK_ROWS", 1000, raising=False)
    tree = spark.range(0, 400, 1, 1).selectExpr("concat('XA1', id) geo3", "'XA1' geo2", "'X' geo1", "'W' geo0")
    tree = tree.union(spark.range(1).selectExpr("'YB2' geo3", "'YB' geo2", "'Y' geo1", "'W' geo0")).coalesce(1)
    held = [("a", "XA1", f"t{k % 40}", float(k % 3)) for k in range(50)] + [("a", "YB", f"t{k}", None) for k in range(1200)]
    held += [("b", "W", "t", 1.0), ("b", "W", "t", 1.0), ("b", "W", None, 2.0), ("b", None, "t", 3.0), ("b", "unknown", "t", 4.0)]
    out = regions.resample_space(table("code string, geo string, time string, values double", *held), tree, regions.region_levels(tree), by=["code"])
    leaves = [f"XA1{k}" for k in range(400)]
    below = {"XA1": leaves, "YB": ["YB2"], "W": [*leaves, "YB2"]}
    expected = sorted(((c, leaf, t, v) for c, g, t, v in held for leaf in below.get(g, [])), key=repr)
    got = out.withColumn("part", F.spark_partition_id()).collect()
    assert sorted(((r["code"], r["geo"], r["time"], r["values"]) for r in got), key=repr) == expected
    sizes = Counter(r["part"] for r in got)
    assert max(sizes.values()) < len(got) / 3


def test_region_parents_with_letters(table, rows):
    out = regions.region_parents(table("geo string, level int", ("DEA11", 3), ("DEA1", 2)))
    assert rows(out) == [("DEA11", "DEA1", "DEA", "DE")]


@pytest.mark.parametrize("values, expected", [
    ([1.0, 2.0, 3.0, None], [-1, 0, 1, 0]), ([5.0, 5.0, 5.0], [0, 0, 0]), ([7.0], [0]),
    ([1.0, 2.0, 3.0, math.nan], [-1, 0, 1, 0]), ([None, None], [0, 0]),
])
def test_zscore(table, values, expected):
    cube = table("geo string, time string, v double", *[("A", f"t{k}", v) for k, v in enumerate(values)])
    out = [r["v"] for r in normalize.zscore_impute(cube).orderBy("time").collect()]
    assert out == pytest.approx(expected)


def test_log_of_prefixed_features(table):
    cube = table("geo string, time string, nama_x double, x double",
                 ("A", "1", 1.0, 1.0), ("A", "2", math.e ** 2, 2.0), ("A", "3", -4.0, 3.0))
    out = normalize.scaled_cube(cube).orderBy("time").collect()
    assert [r["nama_x"] for r in out] == pytest.approx([-math.sqrt(0.5), math.sqrt(0.5), 0])
    assert [r["x"] for r in out] == pytest.approx([-1, 0, 1])


def test_first_per_key(table, rows):
    df = table("k int, ord int, v string", (1, 2, "b"), (1, 1, "a"), (2, 5, None))
    assert rows(keys.first_per_key(df, ["k"], ["ord"])) == [(1, 1, "a"), (2, 5, None)]


def test_lag_starts_anew_in_each_group(table, rows):
    df = table("country string, year int, v double", ("A", 2001, 1.0), ("A", 2002, 4.0), ("B", 2001, 10.0))
    assert rows(trajectories.abs_lag_diff(df, ["country"], "year", "v"), "country", "year", "derivative") == [
        ("A", 2001, None), ("A", 2002, 3.0), ("B", 2001, None)]


@pytest.mark.parametrize("span", [1, 2, 3, 100])
def test_lag_across_blocks(table, span):
    values = [1.0, None, 4.0, 9.0, None, None, 2.0]
    df = table("g string, o int, v double", *[("A", 3 * k, v) for k, v in enumerate(values)])
    out = trajectories.lag_by(df, ["g"], "o", "v", "before", span).orderBy("o").collect()
    assert [r["before"] for r in out] == [None, *values[:-1]]


def test_events_fan_out(spark, table, rows):
    df = table("country string, year double", *[("NATION_1", float(y)) for y in range(1996, 2002)])
    out = trajectories.with_events(df, spark.createDataFrame(INTERVALS, EVENTS))
    assert out.count() == 7
    assert rows(out.where("year = 1998"), "event") == [("growth",), ("law",)]
    assert out.where("during_event").count() == 7


def test_missing_keys_match(table, rows):
    left = table("a int, b int, x int", (1, None, 10), (2, 5, 20))
    right = table("a int, b int, y int", (1, None, 1), (2, 5, 2))
    assert rows(keys.natural_left_chain([left, right], ["a", "b"])) == [(1, None, 10, 1), (2, 5, 20, 2)]


def _cells(spark, first, version):
    return spark.createDataFrame(
        [(f"{version}{n}", x, y) for n in range(25) for x in range(4 * n + first(n), 4 * n + 4 + first(n)) for y in range(4)],
        "region string, cell_x int, cell_y int")


def test_largest_overlap(spark):
    a, b = _cells(spark, lambda n: 0, "a"), _cells(spark, lambda n: n % 3, "b")
    out = {r["region"]: (r["other"], r["overlap"]) for r in crosswalk.largest_overlap(a, b).collect()}
    assert out["a2"] == ("b2", 8.0)
    assert out["a0"] == ("b0", 16.0)


def test_region_without_overlap_stays(table, rows):
    a = table("region string, cell_x int, cell_y int", ("a", 0, 0))
    b = table("region string, cell_x int, cell_y int", ("b", 9, 9))
    assert rows(crosswalk.largest_overlap(a, b)) == [("a", None, None)]


def test_recoded_and_renamed_regions(table, rows):
    t1 = table("V1 string, V2 string", ("AA1 (x)", "AA1"), ("AA2", "AB2 new"), ("none", "AC9"))
    t2 = table("V2 string, V3 string", ("AA1", "AA1"), ("AB2", "AB3"), ("AD1", "AD1"))
    out = crosswalk.harmonise_codes([t1, t2])
    assert out.columns == ["V3", "V2", "V1"]
    assert rows(out) == [("AA1", "AA1", "AA1"), ("AB3", "AB2", "AA2"), ("AD1", "AD1", None)]


def test_version_long_keeps_one_id(table, rows):
    wide = table("id int, `CODE-A` string, `NAME-A` string, `CODE-B` string, `NAME-B` string, `CODE-C` string",
                 (1, "X1", "old", "X1", "new", "X1"))
    out = reshape.version_long(wide, ["id"])
    assert rows(out) == [(1, "A", "X1", "old"), (1, "B", "X1", "new"), (1, "C", "X1", None)]
    assert out.select("CODE").distinct().count() == 1


def test_vintage_chain_with_many_unmatched_codes(table, spark):
    t1 = spark.range(200).selectExpr("concat('AA', id) V1", "concat('AA', id) V2")
    t2 = spark.range(500, 900).selectExpr("concat('AA', id) V2", "concat('AB', id) V3")
    t3 = spark.range(880, 1000).selectExpr("concat('AB', id) V3", "concat('AC', id) V4")
    out = crosswalk.crosswalk_chain([t1, t2, t3])
    assert out.count() == 200 + 400 + 100
    assert out.where("V1 is not null and V3 is null").count() == 200
    assert out.where("V2 is not null and V4 is not null").count() == 20


def test_catalogue_defaults(table, spark, rows):
    catalog = spark.createDataFrame([("bio", "x1", "X", None)], FEATURES)
    out = normalize.with_feature_defaults(table("var_id string", ("y2",), ("x1",)), catalog)
    assert rows(out, "var_id", "sphere", "label", "description") == [("x1", "bio", "X", "X"), ("y2", "socio", "y2", "y2")]


@pytest.mark.parametrize("expr, expected", [
    (lambda: quarter_start(F.lit("2001-Q2")), DAY(2001, 4, 1)),
    (lambda: quarter_start(F.lit("2001-05")), None),
    (lambda: domain_of(F.lit("CCY3")), "Atmosphere"),
    (lambda: axis_of(F.lit("CCY3")), "CCA3"),
    (lambda: country_of(F.lit("DEA11")), "DEA"),
    (lambda: country_of(F.lit("1x")), None),
    (lambda: region_code(F.lit("code AA017 (new)")), "AA017"),
    (lambda: region_code(F.lit("n/a")), None),
    (lambda: replace_zero(F.lit(0.0)), 0.001),
    (lambda: united(F.lit("a"), F.lit(None).cast("string"), F.lit("b")), "a_NA_b"),
    (lambda: tidy(F.lit(-1e-12)), 0.0),
])
def test_expression(spark, expr, expected):
    value = spark.range(1).select(expr().alias("v")).first()["v"]
    assert value == expected
    if expected == 0.0:
        assert math.copysign(1, value) == 1


def test_strict_mean(table):
    df = table("g int, v double", (1, 1.0), (1, None), (2, 1.0), (2, 3.0), (3, math.nan))
    assert {r[0]: r[1] for r in df.groupBy("g").agg(strict_mean("v")).collect()} == {1: None, 2: 2.0, 3: None}


def test_repeated_cell_fails(table):
    df = table("geo string, time string, var_id string, value double", ("A", "t", "x", 1.0), ("A", "t", "x", 1.0))
    with pytest.raises(Exception, match="more than one value"):
        reshape.assemble_cube([df], ["x"]).collect()


def test_repeated_key_in_full_join_fails(table):
    df = table("geo string, time string, x double", ("A", "t", 1.0), ("A", "t", None))
    with pytest.raises(Exception, match="more than one row"):
        reshape.full_join_all([df]).collect()


def test_full_join_of_many_features(spark, rows):
    frames = [
        spark.range(k, k + 2).selectExpr("cast(id as string) geo", "'t' time", f"double(id) f{k}") for k in range(70)
    ]
    out = reshape.full_join_all(frames)
    assert out.count() == 71
    assert rows(out.where("geo = '40'"), "f39", "f40", "f41") == [(40.0, 40.0, None)]


def test_all_missing_keys_survive(table, rows):
    df = table("geo string, time string, var_id string, value double", ("A", "t", "x", None), ("B", "t", "y", 1.0))
    assert rows(reshape.assemble_cube([df], ["x", "y"])) == [("A", "t", None, None), ("B", "t", None, 1.0)]


def test_conform_to_axes(table, rows):
    series = table("var string, geo string, time string, values double",
                   ("v", "A", "1", 3.0), ("v", "A", "1", 2.0), ("v", None, "1", 9.0), ("v", "Z", "1", 9.0), ("w", "B", "9", 9.0))
    times, geos = table("label string, ord int", ("1", 0), ("2", 1)), table("label string, ord int", ("A", 0), ("B", 1))
    out = reshape.conform_to_axes(series, times, geos, fill=-9.0)
    assert out.count() == 8
    assert rows(out.where("values <> -9")) == [("v", "A", "1", 2.0)]


def test_conform_to_axes_over_long_axes(spark, rows):
    """More places than a row of cells has; labels that come twice; NaN, which a missing value of the same cell precedes."""
    nan = float("nan")
    series = spark.createDataFrame(
        [("v", "A", "t00", 1.0), ("v", "A", "t17", nan), ("v", "A", "t39", nan), ("v", "A", "t39", None), ("v", "A", "t20", nan), ("v", "A", "t20", 2.0), (None, "B", "t05", 3.0)],
        "var string, geo string, time string, values double",
    )
    times = spark.createDataFrame([(f"t{k:02}", k) for k in range(40)] + [("t05", 5)], "label string, ord int")
    geos = spark.createDataFrame([("A", 0), ("B", 1), ("B", 2), (None, 3)], "label string, ord int")
    out = reshape.conform_to_axes(series, times, geos)
    assert out.count() == 2 * 4 * 40
    found = {(r["var"], r["geo"], r["time"], str(r["values"])) for r in out.where("values is not null").collect()}
    assert found == {("v", "A", "t00", "1.0"), ("v", "A", "t17", "nan"), ("v", "A", "t20", "2.0"), (None, "B", "t05", "3.0")}
    assert out.where("values = 3").count() == 2
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "array_except" not in plan and "partial_min_by" not in plan


def test_conform_to_axes_prefers_values(table, rows):
    series = table("var string, geo string, time string, values double",
                   ("v", "A", "1", 5.0), ("v", "A", "1", None), ("v", "A", "1", math.nan), ("v", "A", "2", None))
    times, geos = table("label string, ord int", ("1", 0), ("2", 1)), table("label string, ord int", ("A", 0))
    assert rows(reshape.conform_to_axes(series, times, geos, fill=-1.0)) == [("v", "A", "1", 5.0), ("v", "A", "2", -1.0)]


def test_wide_and_long_are_inverse(table, rows):
    cube = table("geo string, time string, a double, b double", ("A", "1", 1.0, None), ("B", "1", None, None))
    assert rows(reshape.to_wide(reshape.cube_to_long(cube), ["geo", "time"], "var_id", "value", ["a", "b"])) == rows(cube)


def test_assign_id_is_consecutive(spark):
    df = spark.range(1000).selectExpr("cast(id * 7919 % 1000 as string) as k")
    out = keys.assign_id(df, ["k"]).orderBy("k").collect()
    assert [r["id"] for r in out] == list(range(1, 1001))


def test_category_order(table, rows):
    df = table("c string", ("b",), ("a",), ("z",))
    assert rows(df.select("c", keys.category_order("c", ["b", "a"]).alias("o"))) == [("a", 2), ("b", 1), ("z", None)]
