"""One key holds a third of all rows or more: results stay whole and no task or row holds the key's rows."""

import pytest
from pyspark.sql import functions as F

from spherecube.operators import keys, normalize, reshape, timeaxis


@pytest.fixture(scope="module")
def hot(spark):
    key = F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("k"), (F.col("id") % 1000).cast("string")))
    return spark.range(60_000).select("id", key.alias("geo"), (F.col("id") % 97).cast("double").alias("v"))


def test_chunks_of_a_hot_key_stay_small(hot):
    nested = keys.nest_by(hot, ["geo"], ["id"], size=200)
    largest = nested.select(F.max(F.size("rows"))).first()[0]
    assert largest < 400
    back = keys.unnest(nested, ["geo"]).select(*hot.columns)
    assert back.exceptAll(hot).count() == hot.exceptAll(back).count() == 0


def test_first_of_a_hot_key(hot):
    out = {r["geo"]: r["id"] for r in keys.first_per_key(hot, ["geo"], ["v", "id"]).collect()}
    assert out["hot"] == 0
    assert len(out) == hot.select("geo").distinct().count()


def test_demeaning_a_hot_group(hot):
    out = normalize.demean_by(hot, ["geo"], ["v"])
    assert out.count() == 60_000
    assert out.groupBy("geo").agg(F.avg("v").alias("m")).agg(F.max(F.abs("m"))).first()[0] < 1e-9
    assert "Window" not in out._jdf.queryExecution().toString()


def test_numbering_a_hot_key(hot):
    out = keys.assign_id(hot, ["geo", "id"], "n")
    assert out.agg(F.min("n"), F.max("n"), F.countDistinct("n")).first()[:] == (1, 60_000, 60_000)


def test_monthly_values_of_a_hot_region(spark):
    df = spark.range(90_000).select(
        F.lit("v").alias("var"), F.when(F.col("id") % 3 == 0, "hot").otherwise((F.col("id") % 500).cast("string")).alias("geo"),
        F.lit("M").alias("freq"), F.lit("2001-02-01").cast("date").alias("TIME_PERIOD"), F.lit(1.0).alias("values"),
    )
    out = timeaxis.resample_time(df)
    assert out.where("values = 1").count() == out.count() == df.select("geo").distinct().count()


def test_missing_codes_do_not_meet_in_one_task(spark):
    """Half of the left rows lack the code; their join keys are all different."""
    left = spark.range(2000).select(F.col("id").cast("string").alias("a"), F.when(F.col("id") < 1000, F.col("id").cast("string")).alias("b"))
    from spherecube.operators.crosswalk import _full_join

    right = spark.range(500, 1500).select(F.col("id").cast("string").alias("b"), F.lit("c").alias("c"))
    out = _full_join(left, right, "b")
    assert out.count() == 2000 + 500
    assert out.where("a is not null and b is null").count() == 1000
    assert out.where("a is null").count() == 500


def test_conform_keeps_one_row_per_cell(hot, spark):
    series = hot.select(F.lit("v").alias("var"), "geo", F.lit("1").alias("time"), F.col("v").alias("values"))
    geos = hot.select(F.col("geo").alias("label")).distinct()
    times = spark.createDataFrame([("1", 0)], "label string, ord int")
    out = reshape.conform_to_axes(series, times, geos)
    assert out.count() == geos.count()
    assert out.where("geo = 'hot'").first()["values"] == 0.0


def test_number_within_a_hot_group(spark):
    from spherecube.operators.keys import number_within

    rows = [("hot", k * 7919 % 3000) for k in range(3000)] + [(f"g{k % 50}", k) for k in range(3000)] + [(None, 2), (None, 1), ("g1", None)]
    df = spark.createDataFrame(rows, "g string, x int")
    got = {(r["g"], r["x"]): r["n"] for r in number_within(df, ["g"], ["x"]).collect()}
    expected = {}
    for g in {r[0] for r in rows}:
        for n, x in enumerate(sorted((r[1] for r in rows if r[0] == g), key=lambda x: (x is not None, x or 0))):
            expected[g, x] = n + 1
    assert got == expected
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        sizes = number_within(df, ["g"], ["x"]).groupBy(F.spark_partition_id()).count().collect()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert max(r["count"] for r in sizes) < 3000  # the hot group is not in one task
    empty = spark.createDataFrame([], "g string, x int")
    assert number_within(empty, ["g"], ["x"]).count() == 0
