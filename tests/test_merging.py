"""Covers, components, gap runs, mergeable moments, lags over blocks, chunks of texts and tiles, against plain computations."""

import itertools
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from spherecube.operators import components, covers, crosswalk, gaps, keys, moments, trajectories
from spherecube.runtime import materialise
from spherecube.sources import tiles


def optimized(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


# --- covers -----------------------------------------------------------------------------------------------------------


def rectangle(name, x0, y0, x1, y1):
    return [(name, x, y) for x in range(x0, x1) for y in range(y0, y1)]


@pytest.fixture(scope="module")
def areas(spark):
    a = rectangle("a1", -8, -8, 24, 24) + rectangle("a2", 40, 0, 43, 5) + rectangle("alone", 900, 900, 901, 901) + [("a2", 40, 0), (None, 1, 1), ("a2", None, 1)]
    b = rectangle("b1", 0, 0, 16, 16) + rectangle("b2", 16, 0, 64, 64) + rectangle("b3", -8, -8, 0, 0) + [("b4", 5, 5)]
    return [(rows, spark.createDataFrame(rows, "region string, cell_x int, cell_y int")) for rows in (a, b)]


def test_a_cover_holds_the_same_cells_in_far_fewer_rows(areas):
    for rows, df in areas:
        units = {(r, x, y) for r, x, y in rows if None not in (r, x, y)}
        cover = covers.quad_cover(df).collect()
        assert sum(4 ** r["level"] for r in cover) == len(units) and len(cover) < len(units) / 8
    assert covers.quad_cover(areas[0][1].limit(0)).count() == 0


def test_overlap_of_covers_is_that_of_unit_cells(areas):
    (a, da), (b, db) = areas
    expected = {}
    places = {}
    for r, x, y in set(b):
        places.setdefault((x, y), []).append(r)
    for r, x, y in set(a):
        for other in places.get((x, y), []):
            if r is not None and x is not None:
                expected[r, other] = expected.get((r, other), 0) + 1
    got = covers.cover_overlap(covers.quad_cover(da), covers.quad_cover(db)).collect()
    assert {(r["a"], r["b"]): r["area"] for r in got} == expected
    largest = {r["region"]: (r["other"], r["overlap"]) for r in covers.largest_overlap_of_covers(covers.quad_cover(da), covers.quad_cover(db)).collect()}
    assert largest == {"a1": ("b1", 256.0), "a2": ("b2", 15.0), "alone": (None, 1.0)}


def test_a_cell_out_of_range_is_an_error(spark):
    with pytest.raises(Exception, match="out of range"):
        covers.quad_cover(spark.createDataFrame([("a", 2**30, 0)], "region string, cell_x long, cell_y long")).collect()


# --- components -------------------------------------------------------------------------------------------------------


def smallest(links):
    parent = {v: v for link in links for v in link}

    def top(v):
        while parent[v] != v:
            v = parent[v]
        return v

    for a, b in links:
        low, high = sorted((top(a), top(b)))
        parent[high] = low
    return {v: top(v) for v in parent}


@pytest.mark.parametrize("links", [
    [], [(1, 1)], [(k, k + 1) for k in range(200)], [(0, k) for k in range(1, 300)] + [(500, 501)],
    [(k % 37, (k * 7919) % 91) for k in range(60)] + [(1000 + k, 1001 + k) for k in range(0, 40, 2)],
])
def test_components_and_their_extension(spark, links):
    df = spark.createDataFrame(links, "a long, b long")
    assert {r["node"]: r["component"] for r in components.components(df).collect()} == smallest(links)
    half = len(links) // 2
    known = components.components(spark.createDataFrame(links[:half], "a long, b long"))
    got = components.extended(known, spark.createDataFrame(links[half:], "a long, b long")).collect()
    assert {r["node"]: r["component"] for r in got} == smallest(links) and len(got) == len(smallest(links))


def test_one_name_over_vintages_with_splits_and_merges(spark):
    first = spark.createDataFrame([("A", "B1"), ("A", "B2"), ("C", "B3"), ("D", None), (None, "B9")], "v1 string, v2 string")
    second = spark.createDataFrame([("B2", "E"), ("B3", "E"), ("B9", "F"), (None, "G")], "v2 string, v3 string")
    got = {(r["vintage"], r["code"]): r["area_code"] for r in crosswalk.harmonised_ids([first, second]).collect()}
    joined = dict.fromkeys([("v1", "A"), ("v1", "C"), ("v2", "B1"), ("v2", "B2"), ("v2", "B3"), ("v3", "E")], "A")
    assert got == joined | {("v1", "D"): "D", ("v2", "B9"): "B9", ("v3", "F"): "B9", ("v3", "G"): "G"}


# --- gaps -------------------------------------------------------------------------------------------------------------


def runs(cells):
    groups = [(missing, len(list(g))) for missing, g in itertools.groupby(cells)]
    found = [n for missing, n in groups if missing]
    lead = groups[0][1] if groups[0][0] else 0
    trail = groups[-1][1] if groups[-1][0] else 0
    return len(cells), sum(found), len(found), max(found, default=0), lead, trail


@pytest.mark.parametrize("places", [1, 63, 64, 65, 300, 5000])
def test_gap_runs(spark, places):
    rng = random.Random(places)
    rows = []
    for geo, share in (("full", 1.0), ("some", 0.6), ("few", 3 / places), ("last", 0.0)):
        rows += [(geo, t, rng.choice([1.0, None, float("nan")]), 2.0) for t in range(places) if rng.random() < share]
    rows += [("last", places - 1, 5.0, None), ("last", places + 7, 1.0, 1.0), ("some", 0, None, None), ("some", 0, None, None)]
    axis = spark.range(places).select(F.col("id").alias("time"), F.col("id").cast("int").alias("ord"))
    got = gaps.gap_runs(spark.createDataFrame(rows, "geo string, time long, x double, y double"), axis, ["x", "y"]).collect()
    expected = {}
    for geo in {r[0] for r in rows if r[1] < places}:
        for k, feature in ((2, "x"), (3, "y")):
            present = {r[1] for r in rows if r[0] == geo and r[k] is not None and r[k] == r[k]}
            expected[geo, feature] = runs([t not in present for t in range(places)])
    assert {(r["geo"], r["feature"]): tuple(r)[2:] for r in got} == expected


# --- moments ----------------------------------------------------------------------------------------------------------


def test_states_of_parts_are_that_of_the_whole(spark):
    rng = np.random.default_rng(0)
    rows = [(("s", "t", None)[k % 3], *(None if rng.random() < 0.1 else float(v) for v in rng.normal([1e6, 5, -3], [1, 2, 1e-3])), k % 4) for k in range(400)]
    rows += [("s", float("nan"), 1.0, 2.0, 0), ("lone", 1.0, 2.0, 3.0, 1)]
    df = spark.createDataFrame(rows, "g string, a double, b double, c double, part int")
    parts = [moments.moment_state(df.where(F.col("part") == k), ["a", "b", "c"], ["g"]) for k in range(4)]
    got = {(r["g"], r["x"], r["y"]): tuple(r)[3:] for r in moments.moments_of(moments.merged_states(parts, ["g"]), ["g"]).collect()}
    for g in ("s", "t", None, "lone"):
        own = np.array([[np.nan if v is None else v for v in r[1:4]] for r in rows if r[0] == g])
        for i, j in itertools.combinations_with_replacement(range(3), 2):
            both = own[~np.isnan(own[:, i]) & ~np.isnan(own[:, j])]
            n, mx, my, cov = got[g, "abc"[i], "abc"[j]]
            assert n == len(both) and (mx, my) == pytest.approx((both[:, i].mean(), both[:, j].mean()))
            expected = np.cov(both[:, i], both[:, j])[0, 1] if len(both) > 1 else None
            assert cov == (expected if expected is None else pytest.approx(expected, rel=1e-6, abs=1e-9))


def test_merging_reads_the_state_and_the_new_rows_only(spark):
    df = spark.range(1000).select(F.col("id").cast("double").alias("a"), (F.col("id") % 7).cast("double").alias("b"))
    old, new = materialise(df.where("a < 900")), materialise(df.where("a >= 900"))
    state = materialise(moments.moment_state(old, ["a", "b"]))
    plan = moments.merged_states([state, moments.moment_state(new, ["a", "b"])])
    files = set(plan.inputFiles())
    assert files == set(state.inputFiles()) | set(new.inputFiles()) and not files & set(old.inputFiles())


# --- lags and texts ---------------------------------------------------------------------------------------------------


def test_lag_over_a_long_group(spark):
    rows = spark.range(60_000).where("id % 13 <> 5").select(F.when(F.col("id") % 97 == 0, "b").otherwise("hot").alias("g"), "id", (F.col("id") * 3).alias("v"))
    got = trajectories.lag_by(rows, ["g"], "id", "v", "before", span=8)
    frame = rows.toPandas().sort_values("id")
    frame["expected"] = frame.groupby("g")["v"].shift()
    both = frame.merge(got.toPandas(), on=["g", "id", "v"])
    assert len(both) == len(frame) and both["before"].fillna(-1).equals(both["expected"].fillna(-1))


def test_no_window_over_a_long_group(spark):
    """Windows are partitioned by blocks, and the last one sees no more block ends than a block has places."""
    df = spark.range(100_000).select(F.lit("g").alias("g"), "id", F.col("id").alias("v"))
    seen, real = [], trajectories._lagged
    trajectories._lagged = lambda *a: seen.append(a[-1] - a[-2] + 1) or real(*a)
    try:
        assert trajectories.lag_by(df, ["g"], "id", "v", "before", span=16).where("before is null").count() == 1
    finally:
        trajectories._lagged = real
    assert len(seen) == 4 and seen[-1] <= 16
    assert trajectories.lag_by(df.limit(0), ["g"], "id", "v", "before").count() == 0


def test_texts_of_a_hot_key_are_joined_in_chunks(spark):
    rows = [("hot", f"t{k % 700}") for k in range(2000)] + [("b", "y"), ("b", "x"), ("b", None), (None, "z"), ("c", None)]
    df = spark.createDataFrame(rows, "k string, t string")
    got = {r["k"]: r["all"] for r in keys.concat_unique(df, ["k"], "t", ", ", "all", size=50).collect()}
    assert got == {"hot": ", ".join(sorted({f"t{k}" for k in range(700)})), "b": "x, y", None: "z"}


# --- tiles ------------------------------------------------------------------------------------------------------------


@pytest.fixture(scope="module")
def tiled(spark, tmp_path_factory):
    path = f"{tmp_path_factory.mktemp('tiles')}/cube"
    times = spark.createDataFrame([(f"t{k:02}", 10 * k) for k in range(11)], "label string, ord int")
    places = spark.createDataFrame([(f"g{k:02}", 2 * k + 1) for k in range(23)], "label string, ord int")
    rng = random.Random(2)
    cells = {(v, f"g{g:02}", f"t{t:02}"): rng.random() for v in "xy" for g in range(23) for t in range(11) if rng.random() < 0.7}
    series = spark.createDataFrame([(*k, v) for k, v in cells.items()] + [("x", "off", "t00", 1.0)], "var string, geo string, time string, values double")
    tiles.write_tiles(series, times, places, path, regions=5, times=4)
    return path, cells


def read(rows):
    return {(r["var"], r["geo"], r["time"]): r["values"] for r in rows.collect()}


def test_tiles_come_back_whole(spark, tiled):
    path, cells = tiled
    every = {(v, f"g{g:02}", f"t{t:02}"): None for v in "xy" for g in range(23) for t in range(11)}
    assert read(tiles.read_tiles(spark, path)) == every | cells


def files_read(df, column):
    """Files read by the scans that have the column."""
    leaves = df._jdf.queryExecution().executedPlan().collectLeaves()
    scans = [leaves.apply(k) for k in range(leaves.length())]
    return sum(s.metrics().apply("numFiles").value() for s in scans if column in s.toString())


def test_slices_read_their_own_files_only(spark, tiled):
    path, _ = tiled
    whole = read(tiles.read_tiles(spark, path))
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        for times, regions, most in ((None, None, 15), (["t05"], None, 5), (None, ["g22"], 3), (["t00", "t10"], ["g07"], 2)):
            got = tiles.read_tiles(spark, path, times, regions)
            wanted = {k: v for k, v in whole.items() if (times is None or k[2] in times) and (regions is None or k[1] in regions)}
            assert read(got) == wanted and len(wanted) > 0
            assert files_read(got, "tile_geo") == most
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    with pytest.raises(ValueError, match="not on the axis"):
        tiles.read_tiles(spark, path, ["never"])


def test_many_tiles_share_few_folders(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(tiles, "FOLDERS", 6)
    times = spark.createDataFrame([(f"t{k}", k) for k in range(3)], "label string, ord int")
    places = spark.createDataFrame([(f"g{k:02}", k) for k in range(20)], "label string, ord int")
    cells = {(v, f"g{g:02}", f"t{t}"): float(100 * g + t) for v in "xy" for g in range(20) for t in range(3) if (g + t) % 4}
    series = spark.createDataFrame([(*k, v) for k, v in cells.items()], "var string, geo string, time string, values double")
    path = tiles.write_tiles(series, times, places, f"{tmp_path}/cube", regions=1, times=1)
    assert len(list((tmp_path / "cube" / "tiles").glob("*/*"))) == 6
    whole = {(v, f"g{g:02}", f"t{t}"): None for v in "xy" for g in range(20) for t in range(3)} | cells
    assert read(tiles.read_tiles(spark, path)) == whole
    got = read(tiles.read_tiles(spark, path, ["t2"], ["g00", "g19"]))
    assert got == {k: v for k, v in whole.items() if k[2] == "t2" and k[1] in ("g00", "g19")}
