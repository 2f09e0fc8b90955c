"""Seconds per headline query. Environment: BENCH_SF_DIR, BENCH_CPUS; BENCH_QUERIES=all runs every registered query."""

from __future__ import annotations

import json
import os
import time

from pyspark.sql import SparkSession

from spherecube.catalog import queries

HEADLINE = [
    "assemble_cube", "full_outer_features", "complete_grid", "conform_to_axes", "write_cube_roundtrip",
    "resample_time_mixed", "resample_space_majority", "ingest_datasets", "dataset_profile", "coverage", "zscore_impute",
    "scaled_cube", "detrend_season", "detrend_both", "detrended_cube", "detrended_long", "processed_cube", "build_cubes",
    "cca_correlations", "cca_scores_fwd", "cca_many", "pairwise_cca", "pairwise_scores", "scores_view",
    "trajectories_view", "map_view_feature", "timeseries_view", "density2d", "pca_2_scores", "threeway_factors",
    "country_plane", "events_by_year", "abs_lag_region", "crosswalk_chain", "crosswalk_by_overlap", "first_per_key",
    "nest_unnest", "level_reorder",
]

WARM_UP = ["full_outer_features", "detrended_cube", "density2d"]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]").appName("spherecube-bench")
        .config("spark.sql.shuffle.partitions", cpus if cpus.isdigit() else "8")
        .config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false")
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    registered = queries()
    chosen = list(registered) if os.environ.get("BENCH_QUERIES") == "all" else HEADLINE
    for name in WARM_UP:  # start-up of the session and of Python workers is not a query's time
        registered[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
    seconds = {}
    for name in chosen:
        start = time.perf_counter()
        registered[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - start, 3)
    print(json.dumps({
        "metric": "total_query_seconds",
        "value": round(sum(seconds.values()), 3),
        "unit": "sec",
        "queries": seconds,
        "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
        "cpus": cpus,
        "spark": spark.version,
    }))
    spark.stop()


if __name__ == "__main__":
    main()
