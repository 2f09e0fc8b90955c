"""Registered queries: each exercises operators on frames derived from the given tables."""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import sources
from ..functions import (
    axis_of, clean, country_of, days_since, domain_of, quarter_label, quarter_start, region_code, replace_zero,
    strict_max_abs, tidy, united,
)
from ..operators import (
    cca, covers, crosswalk, datasets, density, factors, gaps, keys, moments, normalize, quantiles, regions, reshape, timeaxis,
    trajectories,
)
from ..plans import country, cubes, views
from ..runtime import materialise, scratch_path, tune
from ..schema import COUNTRY_AXES, KEYS
from ..sources import tiles
from . import frames as fx

_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}

X, Y = fx.SPHERE_FEATURES["bio"], fx.SPHERE_FEATURES["socio"]


def query(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    @wraps(f)
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return f(tune(spark), sf_dir)

    _QUERIES[f.__name__] = run
    return run


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(_QUERIES)


def rounded(df: DataFrame, *cols: str, digits: int = 6) -> DataFrame:
    return df.withColumns({c: tidy(c, digits) for c in cols})


# --- assembling and reshaping ---------------------------------------------------------------------------------------


@query
def assemble_cube(spark, d):
    series = [normalize.cube_to_long(f(spark, d)) for f in (fx.order_cells, fx.ship_cells)]
    return rounded(reshape.assemble_cube(series, fx.CUBE_FEATURES), *fx.CUBE_FEATURES)


@query
def full_outer_features(spark, d):
    return rounded(fx.raw_cube(spark, d), *fx.CUBE_FEATURES)


@query
def bind_by_key(spark, d):
    both = reshape.bind_by_key(fx.order_cells(spark, d), fx.ship_cells(spark, d))
    return rounded(both, *fx.CUBE_FEATURES)


@query
def cube_to_long(spark, d):
    return rounded(reshape.cube_to_long(fx.raw_cube(spark, d)), "value")


@query
def key_unite_separate(spark, d):
    packed = reshape.unite(fx.raw_cube(spark, d).select(*KEYS, "ord_value"), "space_time", KEYS)
    parts = reshape.separate(packed, "space_time", ["geo", "year", "quarter"], remove=False)
    return rounded(parts.withColumn("country", country_of("geo")), "ord_value")


@query
def unite_missing(spark, d):
    v2 = fx.code_tables(spark, d)[1]
    return reshape.unite(v2, "pair", ["V2", "V3"]).groupBy("pair").agg(F.count(F.lit(1)).alias("n"))


@query
def union_named(spark, d):
    parts = {"orders": fx.order_cells(spark, d), "lines": fx.ship_cells(spark, d)}
    stacked = reshape.union_named(parts, "source")
    again = reshape.split_named(stacked, list(parts), "source")
    stacked = again["orders"].withColumn("source", F.lit("orders")).unionByName(again["lines"].withColumn("source", F.lit("lines")))
    return rounded(stacked.select("source", *KEYS, *fx.CUBE_FEATURES), *fx.CUBE_FEATURES)


@query
def complete_grid(spark, d):
    geos = fx.regions(spark, d).select(F.col("geo3").alias("geo"))
    times = fx.quarters(spark, d).select("time")
    return rounded(reshape.complete_grid(fx.order_cells(spark, d).select(*KEYS, "ord_value"), geos, times), "ord_value")


@query
def expected_cells(spark, d):
    n = reshape.expected_cells(fx.dim_geo(spark, d), fx.dim_time(spark, d))
    return fx.order_cells(spark, d).agg(F.count(F.lit(1)).alias("observed")).withColumn("expected", n)


@query
def prefix_pivot(spark, d):
    names = [f"R{r['r_regionkey']}" for r in fx.table(spark, d, "region").select("r_regionkey").collect()]  # pivot columns
    wide = reshape.prefix_pivot(fx.yearly(spark, d), ["TIME_PERIOD"], "geo", "values", names, "geo_")
    return rounded(
        wide.select(
            days_since("TIME_PERIOD").alias("days"), days_since("TIME_PERIOD", "1990-01-01").alias("days_1990"),
            *[f"geo_{n}" for n in names],
        ),
        *[f"geo_{n}" for n in names], digits=2,
    )


@query
def cube_from_matrix(spark, d):
    codes = [r["geo1"] for r in fx.customers(spark, d).select("geo1").distinct().sort("geo1").collect()]  # matrix columns
    matrix = reshape.to_wide(fx.at_level(spark, d, 1, "v"), ["time"], "geo", "values", codes)
    return rounded(sources.cube_from_matrix(matrix, "time", "price"), "value", digits=2)


@query
def cube_from_arrays(spark, d):
    axis = fx.customers(spark, d).select(F.col("c_nationkey").alias("ord"), F.col("geo1").alias("label")).distinct()
    codes = [r["label"] for r in axis.sort("ord").collect()]  # array positions
    matrix = reshape.to_wide(fx.at_level(spark, d, 1, "v"), ["time"], "geo", "values", codes)
    rows = matrix.select("time", F.array(*codes).alias("cells"))
    return rounded(sources.cube_from_arrays(rows, "time", "cells", axis, "price"), "value", digits=2)


@query
def version_long(spark, d):
    wide = fx.customers(spark, d).select(
        "c_custkey", F.col("geo3").alias("ID-A"), F.col("country").alias("NAME-A"),
        F.col("geo2").alias("ID-B"), F.col("geo1").alias("ID-C"), F.col("geo0").alias("NAME-C"),
    )
    return reshape.version_long(wide, ["c_custkey"])


@query
def nest_unnest(spark, d):
    orders = fx.sales(spark, d).select("priority", "id", "geo3", "price")
    nested = keys.nest_by(orders, ["priority"], ["id"], size=500)
    return rounded(keys.unnest(nested, ["priority"]), "price")


@query
def nest_sizes(spark, d):
    nested = keys.nest_by(fx.sales(spark, d).select("priority", "id", "geo3"), ["priority"], ["id"], size=500)
    return nested.groupBy("priority").agg(
        F.sum(F.size("rows").cast("bigint")).alias("n"), (F.max(F.size("rows")) < 1000).alias("bounded")
    )


# --- sources and sinks ------------------------------------------------------------------------------------------------


@query
def read_axis(spark, d):
    path = scratch_path(spark, "axis")
    labels = fx.quarters(spark, d).orderBy("ord").select("time").coalesce(1)  # an axis is one short file
    labels.write.text(path)
    return sources.read_axis(spark, path)


@query
def read_feature_catalog(spark, d):
    path = scratch_path(spark, "features")
    part = fx.table(spark, d, "part")
    line = F.concat_ws(
        ",", "p_type", F.concat(F.lit(" "), F.col("p_partkey").cast("string")), F.concat("p_name", F.lit("  ")),
        F.when(F.col("p_size") > 10, F.col("p_brand")),
    )

    def headed(batches):
        yield pd.DataFrame({"value": ["sphere,var_id,label,description"]})
        yield from batches

    # Every part file starts with the header, as every CSV file of a folder does.
    part.select(line.alias("value")).mapInPandas(headed, "value string").write.text(path)
    return sources.read_feature_catalog(spark, path)


@query
def read_region_table(spark, d):
    path = sources.write_table_csv(fx.regions(spark, d), scratch_path(spark, "regions"))
    return sources.read_region_table(spark, path)


@query
def read_csv_dir(spark, d):
    wide = fx.axes_wide(spark, d)
    path = sources.write_table_csv(wide.select(*COUNTRY_AXES.fieldNames()), scratch_path(spark, "axes"))
    return rounded(trajectories.parse_axis_names(sources.read_csv_dir(spark, path, COUNTRY_AXES)), "value", digits=4)


@query
def csv_roundtrip(spark, d):
    codes = crosswalk.extract_codes(fx.code_tables(spark, d)[0])
    path = sources.write_table_csv(crosswalk.sort_by_length(codes, "V2"), scratch_path(spark, "codes"))
    return sources.read_csv_dir(spark, path, codes.schema)


@query
def read_indicators(spark, d):
    folder = scratch_path(spark, "indicators")
    for code, df in (("ord_val", fx.indicator(spark, d)), ("ord_avg", fx.indicator_annual(spark, d))):
        df.drop("code").write.parquet(f"{folder}/{code}.parquet")
    read = reshape.union_named(sources.read_indicators(spark, folder), "code")
    return rounded(read.select("code", "freq", "geo", "TIME_PERIOD", "values", "priority", "status"), "values", digits=4)


@query
def read_region_levels(spark, d):
    path = scratch_path(spark, "boundaries")
    levels = regions.region_levels(fx.regions(spark, d))
    nested = keys.nest_by(levels.withColumn("all", F.lit(0)), ["all"], ["geo"])  # documents of about 1000 regions
    features = F.transform("rows", lambda g: F.struct(F.lit("Feature").alias("type"), F.struct(
        g["geo"].alias("NUTS_ID"), g["level"].alias("LEVL_CODE")
    ).alias("properties")))
    documents = nested.select("chunk", F.to_json(F.struct(F.lit("FeatureCollection").alias("type"), features.alias("features"))).alias("value"))
    documents.write.partitionBy("chunk").text(path)
    return sources.read_region_levels(spark, [path])


@query
def conform_to_axes(spark, d):
    full = reshape.conform_to_axes(_monthly_quarters(spark, d), fx.dim_time(spark, d), _geo2_axis(spark, d), fill=-1.0)
    return rounded(full, "values", digits=2)


def _geo2_axis(spark, d):
    return fx.regions(spark, d).select(F.col("geo2").alias("label")).distinct()


def _monthly_quarters(spark, d):
    """Three rows to a cell, a missing geo where the value is missing."""
    return fx.monthly(spark, d).select(
        "var", F.when(F.col("values").isNotNull(), F.col("geo")).alias("geo"),
        quarter_label("TIME_PERIOD").alias("time"), "values",
    )


@query
def write_cube_roundtrip(spark, d):
    path = sources.write_cube(
        _monthly_quarters(spark, d), fx.dim_time(spark, d), _geo2_axis(spark, d), scratch_path(spark, "cube")
    )
    return rounded(sources.read_cube(spark, path), "values", digits=2)


def _tiles(spark, d):
    axis = fx.dim_geo(spark, d)
    long = normalize.cube_to_long(fx.order_cells(spark, d)).select(F.col("var_id").alias("var"), "geo", "time", F.col("value").alias("values"))
    return tiles.write_tiles(long, fx.dim_time(spark, d), axis, scratch_path(spark, "tiles"), regions=256)


@query
def tile_roundtrip(spark, d):
    return rounded(tiles.read_tiles(spark, _tiles(spark, d)), "values", digits=2)


@query
def tile_slice_time(spark, d):
    return rounded(tiles.read_tiles(spark, _tiles(spark, d), times=["1998-Q2", "1996-Q1"]), "values", digits=2)


@query
def tile_slice_region(spark, d):
    """All times of the first and of the last region."""
    first, last = fx.dim_geo(spark, d).agg(F.min_by("label", "ord"), F.max_by("label", "ord")).first()
    return rounded(tiles.read_tiles(spark, _tiles(spark, d), regions=[first, last]), "values", digits=2)


@query
def split_write_roundtrip(spark, d):
    path = sources.split_write(fx.indicator(spark, d), "ord_val", scratch_path(spark, "split"))
    return rounded(spark.read.parquet(path).select("descriptor", "geo", "TIME_PERIOD", "values"), "values", digits=2)


# --- time and space ---------------------------------------------------------------------------------------------------


@query
def quarter_axis(spark, d):
    return fx.quarters(spark, d)


@query
def resample_month_to_quarter(spark, d):
    return rounded(timeaxis.resample_month_to_quarter(fx.monthly(spark, d)), "values")


@query
def resample_year_to_quarter(spark, d):
    return rounded(timeaxis.complete_annual(fx.yearly(spark, d)), "values", digits=2)


@query
def resample_time_mixed(spark, d):
    return rounded(timeaxis.resample_time(fx.mixed_freq(spark, d)), "values", digits=4)


@query
def resample_time_median(spark, d):
    return rounded(timeaxis.resample_time(fx.mixed_freq(spark, d), agg=quantiles.MEDIAN), "values", digits=4)


@query
def price_quantiles(spark, d):
    """Order statistics of all orders by status, some of them hot groups."""
    found = quantiles.grouped_quantiles(fx.sales(spark, d), ["status"], "price", [0.1, 0.5, 0.9])
    parts = [F.col("quantiles")[k].alias(f"q{p}") for k, p in enumerate((10, 50, 90))]
    return rounded(found.select("status", "n", *parts), "q10", "q50", "q90", digits=4)


@query
def resample_time_custom(spark, d):
    return rounded(timeaxis.resample_time(fx.mixed_freq(spark, d), agg=F.max), "values", digits=4)


@query
def region_parents(spark, d):
    return regions.region_parents(regions.region_levels(fx.regions(spark, d)))


@query
def region_levels(spark, d):
    return regions.region_levels(fx.regions(spark, d))


@query
def attach_level(spark, d):
    levels = regions.region_levels(fx.regions(spark, d))
    return rounded(regions.attach_level(fx.mixed_level(spark, d), levels), "values", digits=2)


@query
def majority_level(spark, d):
    return regions.majority_level(fx.mixed_level(spark, d), regions.region_levels(fx.regions(spark, d)), ["var"])


@query
def infer_level(spark, d):
    return regions.infer_level(fx.mixed_level(spark, d), regions.region_levels(fx.regions(spark, d)), ["var"])


@query
def expand_level2(spark, d):
    data = rounded(fx.at_level(spark, d, 2, "v"), "values", digits=2)
    return regions.expand_to_children(data, fx.regions(spark, d), 2)


@query
def expand_level0(spark, d):
    data = rounded(fx.at_level(spark, d, 0, "v"), "values", digits=2)
    return regions.expand_to_children(data, fx.regions(spark, d), 0)


def _segments(spark, d):
    return fx.sales(spark, d).groupBy(F.col("geo2").alias("geo"), "time").agg(F.sum("price").alias("values"))


@query
def expand_finest_right(spark, d):
    """All segments, on a tree that also has segments without orders."""
    out = regions.expand_to_children_right(_segments(spark, d), fx.settled(spark, d), 2)
    return rounded(out.select("geo", "time", "values"), "values", digits=2)


@query
def resample_space_majority(spark, d):
    tree = fx.regions(spark, d)
    data = rounded(fx.mixed_level(spark, d), "values", digits=2)
    return regions.resample_space(data, tree, regions.region_levels(tree), "majority", ["var"])


@query
def resample_space_finest(spark, d):
    tree = fx.settled(spark, d)
    data = _segments(spark, d).unionByName(fx.at_level(spark, d, 0, "v").drop("var"))
    return rounded(regions.resample_space(data, tree, regions.region_levels(tree), "finest"), "values", digits=2)


@query
def ingest_datasets(spark, d):
    tree = fx.regions(spark, d)
    tables = {"ord_val": fx.indicator(spark, d), "ord_avg": fx.indicator_annual(spark, d)}
    exact = {code: rounded(df, "values", digits=4) for code, df in tables.items()}
    return cubes.ingest(exact, tree, regions.region_levels(tree))


@query
def ingest_and_store(spark, d):
    """Reader, profile, ingest and stored cube, over datasets of different breakdown columns, frequency and level."""
    folder = scratch_path(spark, "indicators")
    for code, df in (("ord_val", fx.indicator(spark, d)), ("ord_avg", fx.indicator_annual(spark, d))):
        df.drop("code").write.parquet(f"{folder}/{code}.parquet")
    tables = sources.read_indicators(spark, folder)
    tree = fx.regions(spark, d)
    levels = regions.region_levels(tree)
    known = datasets.dataset_profile(tables, levels).where("level is not null").collect()  # a row per dataset
    path = cubes.ingest_and_store(
        {r["code"]: tables[r["code"]] for r in known}, tree, levels, fx.dim_time(spark, d), fx.dim_geo(spark, d),
        scratch_path(spark, "cube"),
    )
    return rounded(sources.read_cube(spark, path), "values", digits=4)


# --- datasets and catalogue -------------------------------------------------------------------------------------------


@query
def dataset_profile(spark, d):
    tables = {"ord_val": fx.indicator(spark, d), "ord_avg": fx.indicator_annual(spark, d)}
    return datasets.dataset_profile(tables, regions.region_levels(fx.regions(spark, d)))


@query
def dataset_titles(spark, d):
    profiles = dataset_profile(spark, d)
    titles = spark.createDataFrame([("ord_val", "Value of orders")], "code string, title string")
    return datasets.metadata_join(profiles, titles)


@query
def count_variables(spark, d):
    return datasets.count_variables(fx.indicator(spark, d), "ord_val")


def _catalogued(spark, d):
    """Catalogue of the features the cube has values of."""
    present = normalize.column_moments(fx.raw_cube(spark, d)).where(F.col("n") > 0).select("var_id")
    return normalize.with_feature_defaults(present, fx.catalog(spark))


@query
def feature_defaults(spark, d):
    return _catalogued(spark, d).orderBy("sphere", "var_id").select("sphere", "var_id", "label", "description")


@query
def features_for_spheres(spark, d):
    return views.features_for_spheres(_catalogued(spark, d), "bio", "socio")


@query
def xy_features(spark, d):
    return views.xy_features(_catalogued(spark, d), "bio", "socio", ["Value", "Orders", "Net", "Discount"])


@query
def features_table(spark, d):
    return views.features_table(_catalogued(spark, d)).select("sphere", "label", "description")


@query
def detrend_choice(spark, d):
    return views.detrended_and_others(_catalogued(spark, d), ["Value", "Net", "Quantity"], ["Value"])


# --- normalising ------------------------------------------------------------------------------------------------------


@query
def column_moments(spark, d):
    return rounded(normalize.column_moments(fx.raw_cube(spark, d)), "mean", "sd")


@query
def coverage(spark, d):
    n = reshape.expected_cells(fx.dim_geo(spark, d), fx.dim_time(spark, d))
    return rounded(normalize.coverage(fx.raw_cube(spark, d), n, max_na=0.5), "missing")


@query
def map_columns(spark, d):
    cube = fx.raw_cube(spark, d).select(*KEYS, "ord_value", "nama_net", "ship_qty")
    logged = normalize.map_prefix(cube, "nama_", lambda c: F.ln(c))
    halved = normalize.map_numeric(logged, lambda c: c / 2)
    text = normalize.map_all(rounded(halved, "ord_value", "nama_net", "ship_qty"), lambda c: F.coalesce(c.cast("string"), F.lit("NA")))
    return text.groupBy(F.substring("geo", 1, 3).alias("geo1")).agg(
        F.count(F.when(F.col("nama_net") == "NA", 1)).alias("no_net"),
        F.count(F.when(F.col("ship_qty") != "NA", 1)).alias("shipped"),
        tidy(F.sum(F.expr("try_cast(ord_value AS double)")), 2).alias("half_value"),
    )


@query
def zscore_impute(spark, d):
    return rounded(normalize.zscore_impute(fx.raw_cube(spark, d)), *fx.CUBE_FEATURES)


@query
def scaled_cube(spark, d):
    return rounded(normalize.scaled_cube(fx.raw_cube(spark, d)), *fx.CUBE_FEATURES)


@query
def demean_by(spark, d):
    return rounded(normalize.demean_by(fx.raw_cube(spark, d), ["time"], fx.CUBE_FEATURES), *fx.CUBE_FEATURES)


def _detrend(by):
    def run(spark, d):
        return rounded(normalize.detrend(fx.stored_cube(spark, d), by), *fx.CUBE_FEATURES)

    run.__name__ = f"detrend_{by}"
    return query(run)


detrend_season, detrend_year, detrend_both = map(_detrend, ("season", "year", "both"))


@query
def detrended_cube(spark, d):
    return rounded(fx.detrended(spark, d), *fx.CUBE_FEATURES)


@query
def detrended_long(spark, d):
    long = normalize.detrended_long(fx.detrended(spark, d), fx.catalog(spark))
    return rounded(long.select("geo", "time", "var_id", "value", "sphere", "label", "description"), "value")


@query
def processed_cube(spark, d):
    labels = ["Value", "Orders", "Net", "Quantity"]
    # The catalogue is literal; its features are those of the cube.
    ids = spark.createDataFrame([(c,) for c in fx.CUBE_FEATURES], "var_id string")
    features = normalize.with_feature_defaults(ids, fx.catalog(spark))
    cube = views.processed(fx.stored_cube(spark, d), features, labels, ["Value", "Quantity"])
    return rounded(cube, "ord_value", "ship_qty", "ord_count", "nama_net")


@query
def build_cubes(spark, d):
    frames = [f(spark, d) for f in (fx.order_cells, fx.ship_cells)]
    built = cubes.build_cubes(frames, fx.catalog(spark), scratch_path(spark, "build"))
    stacked = reshape.union_named({"raw": built.raw, "scaled": built.scaled, "detrended": built.detrended}, "cube")
    return rounded(stacked, *fx.CUBE_FEATURES)


# --- canonical correlation --------------------------------------------------------------------------------------------


def _model(spark, d):
    cube = materialise(fx.order_cube(spark, d))
    return cube, cca.cca_fit(cube, X, Y)


@query
def cross_moments(spark, d):
    out = moments.pair_moments(fx.order_cube(spark, d), [*X, *Y], [*X, *Y])
    return rounded(out, "cov")


@query
def cca_correlations(spark, d):
    return rounded(cca.cca_correlations(spark, _model(spark, d)[1]), "correlation")


@query
def cca_scores_fwd(spark, d):
    cube, model = _model(spark, d)
    return rounded(cca.cca_scores(cube, model), "CCA1", "CCA2", digits=8)


@query
def cca_match_scores(spark, d):
    cube, model = _model(spark, d)
    fwd, rev = cca.cca_scores(cube, model), cca.cca_scores(cube, model.reverse())
    axes = ["CCA1", "CCA2"]
    return rounded(cca.match_scores(fwd, rev, axes), *[f"{s}_{a}" for s in ("fwd", "rev") for a in axes], digits=8)


@query
def cca_loadings(spark, d):
    _, model = _model(spark, d)
    return rounded(cca.cca_loadings(spark, model), "CCA1", "CCA2", digits=8)


@query
def cca_many(spark, d):
    """Five shipping and order features against three others, from the full cube: more features than pairs allow."""
    cube = fx.stored_cube(spark, d)
    wide = cube.withColumn("ord_size", F.col("ord_value") / F.col("ord_count")).withColumn("ship_sq", F.col("ship_qty") ** 2)
    full = materialise(normalize.zscore_impute(wide))
    model = cca.cca_fit(full, ["ord_value", "ord_count", "ord_size", "nama_net", "fin_share"], ["ship_qty", "ship_disc", "ship_sq"])
    return rounded(cca.cca_correlations(spark, model), "correlation")


def _pairs(spark, d):
    cube = materialise(normalize.scaled_cube(fx.stored_cube(spark, d)))
    return cube, cca.pairwise_cca(cube, fx.SPHERE_FEATURES)


@query
def pairwise_cca(spark, d):
    _, models = _pairs(spark, d)
    return rounded(cca.pairwise_loadings(spark, models), "CCA1", "CCA2", digits=8)


@query
def pairwise_loadings_view(spark, d):
    """All ordered pairs of spheres, features in the order of their first loading within a pair."""
    _, models = _pairs(spark, d)
    features = normalize.with_feature_defaults(
        spark.createDataFrame([(c,) for c in fx.CUBE_FEATURES], "var_id string"), fx.catalog(spark)
    )
    return rounded(views.pairwise_loadings_view(spark, models, features), "CCA1", "CCA2", digits=8)


@query
def pairwise_biplot(spark, d):
    cube, models = _pairs(spark, d)
    return rounded(cca.pairwise_biplot(cube, models, scale=2.0), "xend", "yend", digits=8)


@query
def pairwise_scores(spark, d):
    cube, models = _pairs(spark, d)
    return rounded(cca.pairwise_scores(cube, models), "CCA1", "CCA2", digits=8)


@query
def sphere_pairs(spark, d):
    """Ordered pairs of spheres with the number of observations either has values in."""
    cube = fx.raw_cube(spark, d)
    present = {s: F.coalesce(*[F.col(c) for c in cols]).isNotNull() for s, cols in fx.SPHERE_FEATURES.items()}
    counts = cube.agg(*[F.count(F.when(ok, 1)).alias(s) for s, ok in present.items()])
    spheres = counts.unpivot([], list(present), "sphere", "n")
    pairs = cca.sphere_pairs(spheres)
    return pairs.join(spheres.withColumnRenamed("sphere", "x"), "x")


@query
def common_observations(spark, d):
    return keys.common_observations([fx.order_cells(spark, d), fx.ship_cells(spark, d)], KEYS)


@query
def biplot_loadings(spark, d):
    cube, model = _model(spark, d)
    arrows = cca.biplot_loadings(cca.cca_scores(cube, model), cca.cca_loadings(spark, model), scale=2.0)
    return rounded(arrows, "xend", "yend", digits=8)


@query
def score_means(spark, d):
    cells = normalize.log_features(fx.order_cells(spark, d)).select(*KEYS, "ord_value", "ord_count")
    _, model = _model(spark, d)
    # Scores of unscaled features, whose means differ from zero.
    scores = cca.cca_scores(cells, model)
    return rounded(cca.score_means(scores), "CCA1", "CCA2", digits=4)


@query
def scores_view(spark, d):
    cube, model = _model(spark, d)
    return rounded(views.scores_view(cube, model, "^R1.*_199[67]"), "fwd", "rev", digits=8)


@query
def loadings_view(spark, d):
    _, model = _model(spark, d)
    features = normalize.with_feature_defaults(
        spark.createDataFrame([(c,) for c in fx.CUBE_FEATURES], "var_id string"), fx.catalog(spark)
    )
    return rounded(views.loadings_view(spark, model, features), "CCA1", "CCA2", digits=8)


@query
def trajectories_view(spark, d):
    cube, model = _model(spark, d)
    return rounded(views.trajectories_view(cube, model, "bio", "socio", "^R2"), "CCA1", "CCA2", digits=8)


@query
def map_view_feature(spark, d):
    tree = fx.regions(spark, d).select(F.col("geo3").alias("geo"))
    out = views.map_view(tree, fx.order_cube(spark, d), None, "ord_value", "1998-Q2")
    return rounded(out, "value", "value_limit")


@query
def map_view_label(spark, d):
    """The same by the label a user picks."""
    tree = fx.regions(spark, d).select(F.col("geo3").alias("geo"))
    var_id = views.chosen_variable(fx.catalog(spark), "Value")
    return rounded(views.map_view(tree, fx.order_cube(spark, d), None, var_id, "1998-Q2"), "value", "value_limit")


@query
def map_view_score(spark, d):
    cube, model = _model(spark, d)
    tree = fx.regions(spark, d).select(F.col("geo3").alias("geo"))
    return rounded(views.map_view(tree, cube, model, "rev_CCA1", "1998-Q2"), "value", "value_limit", digits=8)


@query
def timeseries_view(spark, d):
    cube, model = _model(spark, d)
    geo = cube.where(F.col("time") == "1998-Q2").agg(F.min("geo")).first()[0]  # the region a user would pick
    return rounded(views.timeseries_view(cube, model, geo), "value", digits=8)


# --- density and factors ----------------------------------------------------------------------------------------------


@query
def density2d(spark, d):
    cube = materialise(fx.order_cube(spark, d))
    return rounded(density.density2d(cube, "ord_value", "fin_share"), "x", "y", "density")


@query
def density2d_highlight(spark, d):
    """Density of the highlighted scores only."""
    cube, model = _model(spark, d)
    chosen = cca.cca_scores(cube, model).where(views.highlighted(united(*KEYS), "^R1"))
    out = density.density2d(chosen, "CCA1", "CCA2")
    return rounded(rounded(out, "x", "y", digits=8), "density", digits=4)


@query
def trajectories_density(spark, d):
    """Density of the scores of each direction."""
    cube, model = _model(spark, d)
    out = views.trajectories_density(views.trajectories_view(cube, model, "bio", "socio", "^R2"))
    return rounded(rounded(out, "CCA1", "CCA2", digits=8), "density", digits=4)


@query
def density_by_nation(spark, d):
    cube = materialise(fx.order_cube(spark, d).withColumn("nation", F.substring("geo", 1, 3)))
    return rounded(density.density2d(cube, "ord_value", "fin_share", grid_n=20, by=["nation"]), "x", "y", "density")


@query
def pca_2(spark, d):
    model = factors.pca_fit(materialise(fx.order_cube(spark, d)), ["ord_value", "ord_count"])
    rotation = factors.pca_rotation(spark, model)
    variances = factors.pca_variances(spark, model)
    first = variances.where("component = 1").select("variance").scalar()
    return rounded(rotation.withColumn("first_variance", first), "PC1", "PC2", "first_variance")


@query
def pca_2_scores(spark, d):
    cells = materialise(fx.order_cells(spark, d).select(*KEYS, "ord_value", "ord_count"))
    model = factors.pca_fit(cells, ["ord_value", "ord_count"])
    return rounded(factors.pca_scores(cells, model).select(*KEYS, "PC1", "PC2"), "PC1", "PC2")


@query
def pca_3(spark, d):
    path, _ = country.pca_frame(fx.axes(spark, d), "NATION_1", 1999)
    return rounded(path.select("country", "year", "PC1", "PC2"), "PC1", "PC2")


@query
def threeway_factors(spark, d):
    cube = materialise(normalize.scaled_cube(fx.stored_cube(spark, d)))
    times = [r["time"] for r in fx.quarters(spark, d).sort("ord").collect()]  # the time axis
    model = factors.threeway_fit(cube, fx.CUBE_FEATURES, times, (2, 2, 2))
    return rounded(factors.threeway_factors(spark, model), "value")


def _yearly_model(spark, d, ranks=None):
    """Factors of the value and number of orders of regions by year, of full ranks if none are given."""
    cells = fx.sales(spark, d).groupBy(F.col("geo3").alias("geo"), F.year("day").cast("string").alias("time")).agg(
        (F.sum("price") / 1e5).alias("ord_value"), F.count(F.lit(1)).cast("double").alias("ord_count")
    )
    times = [r["time"] for r in fx.quarters(spark, d).select(F.substring("time", 1, 4).alias("time")).distinct().sort("time").collect()]
    return factors.threeway_fit(cells, ["ord_value", "ord_count"], times, ranks or (2 * len(times), 2, len(times)))


@query
def threeway_reduced(spark, d):
    """The years' factor and the share of squares that one component of time leaves of the cube."""
    model = _yearly_model(spark, d, (2, 2, 1))
    found = factors.threeway_factors(spark, model).where("mode = 'time'").select("label", "value")
    return rounded(found.withColumn("fit", F.lit(model.fit)), "value", "fit")


@query
def threeway_estimate(spark, d):
    """Factors of full ranks give back the cube."""
    return rounded(factors.threeway_estimate(_yearly_model(spark, d)), "ord_value", "ord_count")


@query
def threeway_core(spark, d):
    """A core of full ranks holds the whole sum of squares."""
    core = factors.threeway_core(spark, _yearly_model(spark, d))
    return rounded(core.agg(F.sum(F.col("value") ** 2).alias("squares")), "squares", digits=2)


# --- country study ----------------------------------------------------------------------------------------------------


@query
def parse_axis_names(spark, d):
    return rounded(fx.axes(spark, d), "value", digits=4)


@query
def country_current(spark, d):
    chosen = country.country_current(fx.axes(spark, d), ["NATION_1", "NATION_4", "NATION_7"], 1996, 1999)
    return rounded(chosen, "value", digits=4)


@query
def country_domains(spark, d):
    return rounded(country.country_domains(fx.axes(spark, d)).drop("cca_axis"), *country.DOMAIN_NAMES, digits=4)


@query
def country_axes(spark, d):
    return rounded(country.country_axes(fx.axes(spark, d), "Atmosphere"), *country.AXES, digits=4)


@query
def country_plane(spark, d):
    return rounded(country.country_cca_plane(fx.axes(spark, d)), *country.AXES, digits=4)


@query
def country_time(spark, d):
    return rounded(country.country_time(fx.axes(spark, d)), "value", digits=4)


@query
def country_panel(spark, d):
    axes, countries = country.panel_lists(spark, ["CCA1", "CCA2", "CCA3"], ["NATION_1", "NATION_4"])
    return rounded(country.country_panel(fx.axes(spark, d), axes, countries), *country.DOMAIN_NAMES, digits=4)


@query
def events_by_year(spark, d):
    return rounded(country.country_events(fx.axes(spark, d), fx.intervals(spark)), "value", digits=4)


@query
def events_interval_join(spark, d):
    """Orders of a segment during its campaigns, which every urgent order starts, at the resolution of days."""
    sales = fx.sales(spark, d).select("geo2", "id", "day", "priority")
    urgent = sales.where("priority = '1-URGENT'")
    campaigns = urgent.select("geo2", F.col("id").alias("campaign"), F.col("day").alias("first"), F.date_add("day", (F.col("id") % 90).cast("int")).alias("last"))
    found = trajectories.interval_join(sales.select("geo2", "id", "day"), campaigns, ["geo2"], "day", "first", "last")
    return found.select("geo2", "id", "campaign", F.datediff("day", "first").alias("days_in"))


@query
def event_text(spark, d):
    return trajectories.event_text(country.country_events(fx.axes(spark, d), fx.intervals(spark)))


@query
def event_caption(spark, d):
    flagged = country.country_events(fx.axes(spark, d), fx.intervals(spark))
    return country.event_caption(flagged, "NATION_1", 1998, ", ")


@query
def abs_lag_diff(spark, d):
    out = trajectories.abs_lag_diff(fx.axes_wide(spark, d), ["Country Code"], "year", "CCZ1")
    return rounded(out.select(F.col("Country Code").alias("country"), "year", "derivative"), "derivative", digits=4)


@query
def abs_lag_region(spark, d):
    """Change since the quarter before in which the region ordered, blocks of eight quarters."""
    cells = fx.order_cells(spark, d).select(*KEYS, "ord_value")
    place = F.year(quarter_start("time")) * 4 + F.quarter(quarter_start("time"))
    numbered = cells.withColumn("place", place)
    lagged = trajectories.lag_by(numbered, ["geo"], "place", "ord_value", "before", span=8)
    return rounded(lagged.select(*KEYS, F.abs(F.col("ord_value") - F.col("before")).alias("change")), "change")


@query
def trajectory_state(spark, d):
    wide = country.country_domains(fx.axes(spark, d)).select("country", "year", "Biosphere")
    state = trajectories.sort_by_state(trajectories.trajectory_state(wide, "NATION_1", 1998))
    return rounded(state, "Biosphere", digits=4)


@query
def year_labels(spark, d):
    labels = country.year_labels(fx.axes(spark, d), "NATION_1")
    return rounded(labels.select("country", "year", "label", *country.DOMAIN_NAMES), *country.DOMAIN_NAMES, digits=4)


# --- vintages ---------------------------------------------------------------------------------------------------------


@query
def crosswalk_chain(spark, d):
    return crosswalk.harmonise_codes(fx.code_tables(spark, d))


@query
def largest_overlap(spark, d):
    out = crosswalk.largest_overlap(fx.cells(spark, d, "A"), fx.cells(spark, d, "B"))
    return out


@query
def overlap_of_covers(spark, d):
    """Areas that blocks of 50 customers share with blocks of 240, both as covers of cells of mixed size."""
    a, b = (materialise(covers.quad_cover(fx.cells(spark, d, v))) for v in "BD")
    return covers.cover_overlap(a, b)


@query
def largest_overlap_of_covers(spark, d):
    """The same as from unit cells."""
    a, b = (materialise(covers.quad_cover(fx.cells(spark, d, v))) for v in "AB")
    return covers.largest_overlap_of_covers(a, b)


@query
def harmonised_ids(spark, d):
    """Areas over three vintages whose codes split and merge in chains."""
    return crosswalk.harmonised_ids(fx.split_tables(spark, d))


@query
def crosswalk_by_overlap(spark, d):
    later = {"B": fx.cells(spark, d, "B"), "C": fx.cells(spark, d, "C")}
    wide = crosswalk.crosswalk_by_overlap(fx.cells(spark, d, "A"), later, "A")
    numbered = keys.assign_id(wide, ["region-A"], "space_id")
    return reshape.version_long(numbered, ["space_id"])


@query
def assign_id(spark, d):
    return keys.assign_id(fx.order_cells(spark, d).select(*KEYS), ["time", "geo"])


# --- keys, filters, sets ----------------------------------------------------------------------------------------------


@query
def first_per_key(spark, d):
    orders = fx.sales(spark, d).select("geo3", "day", "id", "price", "status")
    return rounded(keys.first_per_key(orders, ["geo3"], ["day", "id"]), "price")


@query
def top_per_group(spark, d):
    best = fx.sales(spark, d).groupBy("geo2").agg(F.max_by("id", F.struct("price", "id")).alias("id"), F.max("price").alias("price"))
    return rounded(best, "price")


@query
def slice_rows(spark, d):
    return rounded(keys.slice_rows(fx.sales(spark, d).select("id", "price"), [1, 3, 5], ["price", "id"]), "price")


@query
def head_n(spark, d):
    ordered = fx.sales(spark, d).orderBy(F.col("price").desc(), "id")
    return rounded(ordered.select("id", "price").limit(20), "price")


@query
def natural_left_chain(spark, d):
    """Segments of final orders: the time is missing for early orders, and missing equals missing."""
    s = fx.sales(spark, d).withColumn("time", F.when(F.year("day") > 1995, F.col("time")))
    parts = [
        s.where(F.col("status") == status).groupBy("geo2", "time").agg(F.sum("price").alias(f"value_{status}"))
        for status in ("F", "O", "P")
    ]
    out = keys.natural_left_chain(parts, ["geo2", "time"])
    return rounded(out, "value_F", "value_O", "value_P", digits=2)


@query
def level_reorder(spark, d):
    return keys.reorder_levels(fx.sales(spark, d), "geo3", "day")


@query
def level_order_within(spark, d):
    """Regions of each nation in the order of their first order."""
    return keys.order_levels_within(fx.sales(spark, d), ["country"], "geo3", "day")


@query
def gap_runs(spark, d):
    """Runs of quarters without a value, by region and feature."""
    axis = fx.dim_time(spark, d).withColumnRenamed("label", "time")
    return gaps.gap_runs(fx.raw_cube(spark, d), axis, fx.CUBE_FEATURES)


@query
def gap_runs_daily(spark, d):
    """Runs of days without an order, and without an urgent one, by segment: an axis of some forty blocks."""
    daily = fx.sales(spark, d).groupBy("geo2", F.col("day").alias("time")).agg(
        F.sum("price").alias("price"), F.sum(F.when(F.col("priority") == "1-URGENT", F.col("price"))).alias("urgent")
    )
    days = daily.agg(F.sequence(F.min("time"), F.max("time")).alias("days")).select(F.posexplode("days").alias("ord", "time"))
    return gaps.gap_runs(daily, days, ["price", "urgent"], "geo2")


@query
def moments_merged(spark, d):
    """Co-moments by season: the state of the years to 1996, to which later quarters are added."""
    cube = fx.stored_cube(spark, d).withColumns({"ord_value": F.col("ord_value") / 1e5, "ship_qty": F.col("ship_qty") / 100})
    seasons = cube.withColumn("season", F.substring("time", 6, 2))
    features = ["ord_value", "ord_count", "fin_share", "ship_qty", "ship_disc"]
    old = materialise(moments.moment_state(seasons.where("time < '1997'"), features, ["season"]))
    new = moments.moment_state(seasons.where("time >= '1997'"), features, ["season"])
    merged = moments.moments_of(moments.merged_states([old, new], ["season"]), ["season"])
    return rounded(merged, "mean_x", "mean_y", "cov")


@query
def category_order(spark, d):
    counts = fx.sales(spark, d).groupBy("status").agg(F.count(F.lit(1)).alias("n"))
    return counts.withColumn("ord", keys.category_order("status", ["P", "O"])).orderBy("ord")


@query
def lookup_first(spark, d):
    """Share of every priority in the number of orders of the first one."""
    counts = fx.sales(spark, d).groupBy("priority").agg(F.count(F.lit(1)).alias("n"))
    first = keys.lookup_first(counts, F.col("priority").startswith("1"), "n", ["priority"])
    return rounded(counts.withColumn("share", F.col("n") / first), "share")


@query
def axis_filters(spark, d):
    """Rows that pass each of the row filters, counted by segment."""
    s = fx.sales(spark, d)
    early = fx.quarters(spark, d).where(F.year("quarter_start") < 1998).select("time")
    final, year = F.col("status") == "F", F.year("day")
    kept = {
        "equal": s.where(final & (F.col("priority") == "5-LOW")),
        "member": s.join(early, "time", "left_semi"),
        "absent": s.join(early, "time", "left_anti"),
        "in_not_in": s.where(F.col("status").isin("F", "O") & ~F.col("priority").isin("5-LOW", "1-URGENT")),
        "range": s.where(year.between(1996, 1998) & F.col("status").isin("F", "P")),
        "prefix": s.where(F.col("geo3").startswith("R1") | (F.col("country") == "NATION_7")),
        "pattern": s.where(views.highlighted(united("geo3", "time"), "^R2.*-Q3$")),
        "upto": s.where(year <= 1997),
    }
    stacked = reshape.union_named({k: f.select("geo2") for k, f in kept.items()}, "filter")
    return stacked.groupBy("filter", "geo2").agg(F.count(F.lit(1)).alias("n"))


@query
def drop_missing(spark, d):
    cube = fx.raw_cube(spark, d)
    kept = {
        "any": cube.dropna("any"),
        "positioned": fx.monthly(spark, d).select(F.lit("").alias("geo"), "values").dropna(subset=["values"]),
    }
    return reshape.union_named({k: f.select("geo") for k, f in kept.items()}, "rule").groupBy("rule").agg(F.count(F.lit(1)).alias("n"))


@query
def slice_mode(spark, d):
    """One time slice of geo x feature x time, and the same for one feature."""
    long = reshape.cube_to_long(fx.raw_cube(spark, d))
    return rounded(long.where((F.col("time") == "1998-Q2") | (F.col("var_id") == "ship_disc")), "value")


@query
def subset_features(spark, d):
    long = reshape.cube_to_long(fx.raw_cube(spark, d))
    return rounded(reshape.to_wide(long, KEYS, "var_id", "value", ["ord_value", "ship_disc"]), "ord_value", "ship_disc")


@query
def set_operations(spark, d):
    a, b = fx.order_cells(spark, d).select("geo", "time"), fx.ship_cells(spark, d).select("geo", "time")
    parts = {"both": a.intersect(b), "only_orders": a.subtract(b), "only_lines": b.exceptAll(a)}
    return reshape.union_named(parts, "part").groupBy("part", "time").agg(F.count(F.lit(1)).alias("n"))


@query
def distinct_rows(spark, d):
    return fx.sales(spark, d).select("geo2", "time", "status").distinct()


@query
def row_counts(spark, d):
    s = fx.sales(spark, d)
    return s.groupBy("status").agg(
        F.count(F.lit(1)).alias("n_rows"), F.countDistinct("geo3").alias("n_regions"), F.countDistinct("time").alias("n_times")
    )


@query
def symmetric_limit(spark, d):
    cube = fx.raw_cube(spark, d)
    return rounded(cube.groupBy("time").agg(
        strict_max_abs("nama_net").alias("net_limit"), strict_max_abs(F.coalesce("ship_qty", F.lit(0.0))).alias("qty_limit")
    ), "net_limit", "qty_limit")


@query
def column_choice(spark, d):
    """Breakdown columns renamed with a vintage and moved first."""
    df = fx.indicator(spark, d)
    extra = reshape.columns_except(df, ["code", "freq", "unit", "geo", "TIME_PERIOD", "values"])
    tagged = reshape.suffix_columns(df.drop("code", "unit"), extra, "2024", "_")
    return rounded(reshape.move_first(tagged, [f"{c}_2024" for c in extra]), "values", digits=2)


@query
def scalar_functions(spark, d):
    """Text, date, numeric and conditional functions on every order."""
    s = fx.sales(spark, d)
    name = F.concat(F.lit("CC"), F.when(F.col("status") == "F", "X").when(F.col("status") == "O", "Y").otherwise("Z"), F.substring("priority", 1, 1))
    return s.select(
        "id",
        domain_of(name).alias("domain"),
        axis_of(name).alias("axis"),
        quarter_start("time").alias("start"),
        F.year("day").alias("year"),
        F.quarter("day").alias("quarter"),
        days_since("day").alias("days"),
        F.pmod(F.year("day"), F.lit(5)).alias("mod5"),
        F.length("geo3").alias("length"),
        region_code(F.concat(F.lit("code "), F.upper("priority"))).alias("code"),
        replace_zero(F.col("price") * F.pmod("id", F.lit(2))).alias("nonzero"),
        F.coalesce(clean(F.ln(F.col("price") - 300_000)), F.lit(0.0)).alias("log_above"),
        F.format_string("%s/%s", "country", "status").alias("label"),
    ).withColumns({"nonzero": tidy("nonzero", 3), "log_above": tidy("log_above")})
