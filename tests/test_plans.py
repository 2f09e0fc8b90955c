"""Physical plans have the shape the operators promise."""

import re

import pytest
from pyspark.sql import functions as F

from spherecube.catalog import frames as fx
from spherecube.operators import cca, keys, normalize, reshape, timeaxis
from spherecube.sources import readers


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def exchanges(text):
    return len(re.findall(r"Exchange (?:hashpartitioning|rangepartitioning|SinglePartition)", text))


@pytest.fixture(scope="module")
def stored(spark, sf_dir):
    return fx.stored_cube(spark, sf_dir)


@pytest.fixture(scope="module")
def model(stored):
    cube = normalize.zscore_impute(stored)
    return cca.cca_fit(cube, ["ord_value", "ord_count"], ["nama_net", "fin_share"])


def test_full_join_of_many_frames_is_one_shuffle(spark):
    frames = [spark.range(10).selectExpr("cast(id as string) geo", "'t' time", f"double(id) f{k}") for k in range(20)]
    text = plan(reshape.full_join_all(frames))
    assert exchanges(text) == 1
    assert "Join" not in text


def test_cells_with_the_cube_key_are_not_shuffled_again(spark, sf_dir):
    numbers = reshape.full_join_all(
        [fx._order_numbers(spark, sf_dir), fx._ship_numbers(spark, sf_dir)], ["c_custkey", "quarter"])
    assert exchanges(plan(numbers)) == 2


def test_scaling_needs_no_join_and_no_window(stored):
    text = plan(normalize.zscore_impute(stored))
    assert "Join" not in text and "Window" not in text
    assert exchanges(text) == 1 and text.count("Subquery subquery#") >= 1


@pytest.mark.parametrize("by", ["season", "year", "both"])
def test_detrending_is_one_shuffle(stored, by):
    text = plan(normalize.detrend(stored, by))
    assert exchanges(text) == 1 and "Join" not in text and text.count("FileScan") == 1


def test_literal_tables_need_no_shuffle(spark):
    few = readers.literal_table(spark, [("a", 1.0), ("b", None)], "k string, v double")
    assert few.schema.simpleString() == "struct<k:string,v:double>" and few.count() == 2
    assert exchanges(plan(spark.range(10).selectExpr("cast(id as string) k").join(few, "k"))) == 0


def test_scores_need_no_shuffle(stored, model):
    for df in (cca.cca_scores(stored, model), cca.cca_both_scores(stored, model)):
        assert exchanges(plan(df)) == 0


def test_scores_of_all_pairs_read_the_cube_once(stored):
    models = cca.pairwise_cca(normalize.zscore_impute(stored), fx.SPHERE_FEATURES)
    text = plan(cca.pairwise_scores(stored, models))
    assert exchanges(text) == 0 and text.count("FileScan") == 1


def test_scan_reads_only_the_needed_columns(stored):
    text = plan(normalize.column_moments(stored, ["ship_qty"]))
    assert "ReadSchema: struct<ship_qty:double>" in text


def test_filters_reach_the_scan(stored):
    text = plan(stored.where((F.col("time") == "1998-Q2") & (F.col("ord_value") > 0)).select("geo"))
    assert "EqualTo(time,1998-Q2)" in text and "GreaterThan(ord_value,0.0)" in text


def test_first_per_key_combines_before_the_shuffle(stored):
    text = plan(keys.first_per_key(stored.select("geo", "time", "ship_qty"), ["geo"], ["time"]))
    assert "partial_min_by" in text and "Window" not in text and exchanges(text) == 1


def test_monthly_aggregate_is_one_shuffle_on_numbers(spark, sf_dir):
    monthly = fx.monthly(spark, sf_dir)
    assert exchanges(plan(timeaxis.resample_month_to_quarter(monthly))) == exchanges(plan(monthly)) + 1


def test_common_keys_of_many_frames_are_one_shuffle(stored):
    frames = [stored.where(F.col(c) > 0) for c in fx.CUBE_FEATURES]
    text = plan(keys.common_observations(frames, ["geo", "time"]))
    assert exchanges(text) == 1 and "Join" not in text


def test_cells_of_a_grid_are_made_by_compiled_code(spark):
    """Java never compiles methods above 8000 bytes, nor does Spark functions of lambdas; a short axis is dealt out before it meets the others."""
    series = spark.createDataFrame([("v", "a", "1", 1.0)], "var string, geo string, time string, values double")
    axes = [spark.createDataFrame([(label, 0)], "label string, ord int") for label in ("1", "a")]
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        out = reshape.conform_to_axes(series, *axes, fill=0.0)
        parts = out._jdf.queryExecution().debug().codegenToSeq()
        sizes = [parts.apply(k)._3().maxMethodCodeSize() for k in range(parts.size())]
        text = plan(out)
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    assert max(sizes) < 8000
    assert "lambda" not in text
    assert "REPARTITION_BY_NUM" in text
