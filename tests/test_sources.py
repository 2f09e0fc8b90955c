"""Readers and writers on small files."""

import json

from pyspark.sql import functions as F

from spherecube import sources
from spherecube.plans import cubes
from spherecube.operators.regions import region_levels
from spherecube.schema import COUNTRY_AXES


def test_axis_keeps_line_order(spark, tmp_path):
    (tmp_path / "axis.txt").write_text("CH1\nCY2\nAL3\n")
    out = sources.read_axis(spark, str(tmp_path / "axis.txt")).orderBy("ord").collect()
    assert [tuple(r) for r in out] == [("CH1", 0), ("CY2", 1), ("AL3", 2)]


def test_catalogue_with_short_and_padded_rows(spark, tmp_path, rows):
    (tmp_path / "f.csv").write_text("sphere,var_id,label,description\nbio,H,H\nbio, q,Heat, Heat flux \n")
    out = sources.read_feature_catalog(spark, str(tmp_path / "f.csv"))
    assert rows(out) == [("bio", "H", "H", None), ("bio", "q", "Heat", "Heat flux")]


def test_region_levels_of_several_vintages(spark, tmp_path, rows):
    def document(*regions):
        return json.dumps({"type": "FeatureCollection", "features": [
            {"type": "Feature", "geometry": None, "properties": {"NUTS_ID": i, "LEVL_CODE": n, "X": 1}} for i, n in regions
        ]}, indent=1)

    (tmp_path / "a.geojson").write_text(document(("AL", 0), ("AL011", 3)))
    (tmp_path / "b.geojson").write_text(document(("AL", 0), ("AL012", 3)))
    out = sources.read_region_levels(spark, [str(tmp_path / "a.geojson"), str(tmp_path / "b.geojson")])
    assert rows(out) == [("AL", 0), ("AL011", 3), ("AL012", 3)]


def test_indicator_files_and_folders(spark, tmp_path, rows):
    import pandas as pd

    pd.DataFrame({"geo": ["A"], "values": [1.0]}).to_parquet(tmp_path / "one.parquet")
    spark.createDataFrame([("B", 2.0, "x")], "geo string, values double, age string").write.parquet(str(tmp_path / "two.parquet"))
    out = sources.read_indicators(spark, str(tmp_path))
    assert list(out) == ["one", "two"]
    assert rows(out["one"], "code", "geo", "values") == [("one", "A", 1.0)]
    assert rows(out["two"], "code", "geo", "values", "age") == [("two", "B", 2.0, "x")]
    assert "age" not in out["one"].columns
    assert list(sources.read_indicators(spark, str(tmp_path), ["two"])) == ["two"]


def test_csv_folder(spark, tmp_path):
    header = ",".join(COUNTRY_AXES.fieldNames())
    for code in ("AAA", "BBB"):
        (tmp_path / f"{code}.csv").write_text(header + "\n" + ",".join(["0.5"] * 9) + f",{code},2003.0\n")
    out = sources.read_csv_dir(spark, str(tmp_path), COUNTRY_AXES)
    assert sorted(r["Country Code"] for r in out.collect()) == ["AAA", "BBB"]


def test_matrix_and_arrays_agree(spark, table, rows):
    wide = table("time string, A double, B double", ("t1", 1.0, None), ("t2", 3.0, 4.0))
    axis = table("label string, ord int", ("A", 0), ("B", 1))
    from_matrix = sources.cube_from_matrix(wide, "time", "v")
    from_arrays = sources.cube_from_arrays(wide.select("time", F.array("A", "B").alias("cells")), "time", "cells", axis, "v")
    assert rows(from_matrix) == rows(from_arrays)
    assert from_matrix.count() == 4


def test_stored_cube_marks_missing_cells(spark, table, tmp_path, rows):
    series = table("var string, geo string, time string, values double", ("7", "A", "1", 3.0))
    axis = table("label string, ord int", ("A", 0), ("B", 1)), table("label string, ord int", ("1", 0))
    path = sources.write_cube(series, axis[1], axis[0], str(tmp_path / "cube"))
    assert rows(spark.read.parquet(path), "geo", "values") == [("A", 3.0), ("B", 9.96921e36)]
    assert rows(sources.read_cube(spark, path)) == [("7", "A", "1", 3.0), ("7", "B", "1", None)]


def test_stored_cube_of_many_variables(spark, tmp_path, rows):
    """More variables in a task than it writes side by side, and fewer."""
    key = "spark.sql.maxConcurrentOutputFileWriters"
    before = spark.conf.get(key)
    cells = [(f"v{v:02}", g, t, float(v) if t == "t03" else None) for v in range(30) for g in "AB" for t in ("t03", "t19")]
    series = spark.createDataFrame(cells, "var string, geo string, time string, values double")
    times, geos = (spark.createDataFrame([(x, k) for k, x in enumerate(labels)], "label string, ord int") for labels in ([f"t{k:02}" for k in range(20)], "AB"))
    seen = []
    for some in (series, series.where("var < 'v05'")):
        path = sources.write_cube(some, times, geos, str(tmp_path / f"cube{len(seen)}"))
        out = sources.read_cube(spark, path)
        n = some.select("var").distinct().count()
        assert out.count() == n * 2 * 20
        assert rows(out.where("values is not null")) == sorted((f"v{v:02}", g, "t03", float(v)) for v in range(n) for g in "AB")
        seen.append(path)
    assert spark.conf.get(key) == before


def test_cube_is_written_without_a_sort(spark, table, tmp_path, monkeypatch):
    from pyspark.sql.readwriter import DataFrameWriter

    held, parquet = {}, DataFrameWriter.parquet

    def noted(self, path, *args, **named):
        held[path] = int(spark.conf.get("spark.sql.maxConcurrentOutputFileWriters"))
        parquet(self, path, *args, **named)

    monkeypatch.setattr(DataFrameWriter, "parquet", noted)
    series = table("var string, geo string, time string, values double", ("7", "A", "1", 3.0))
    axis = table("label string, ord int", ("A", 0)), table("label string, ord int", ("1", 0))
    path = sources.write_cube(series, axis[1], axis[0], str(tmp_path / "cube"))
    assert held[path] > 1


def test_ingest_and_store(spark, table, tmp_path):
    tree = table("geo3 string, geo2 string, geo1 string, geo0 string", ("XA111", "XA11", "XA1", "XA"), ("XA121", "XA12", "XA1", "XA"))
    annual = table("freq string, unit string, geo string, TIME_PERIOD string, values double, sex string",
                   ("A", "n", "XA", "2001-01-01", 4.0, "T")).withColumn("TIME_PERIOD", F.col("TIME_PERIOD").cast("date"))
    monthly = table("freq string, unit string, geo string, TIME_PERIOD string, values double",
                    *[("M", "n", "XA11", f"2001-0{m}-01", float(m)) for m in (1, 2, 3)]
                    ).withColumn("TIME_PERIOD", F.col("TIME_PERIOD").cast("date"))
    times = table("label string, ord int", *[(f"2001-Q{q}", q) for q in (1, 2, 3, 4)])
    geos = table("label string, ord int", ("XA111", 0), ("XA121", 1))
    path = cubes.ingest_and_store({"pop": annual, "gdp": monthly}, tree, region_levels(tree), times, geos, str(tmp_path / "c"))
    out = sources.read_cube(spark, path)
    assert out.count() == 16
    assert out.where("var = 'pop_T' and values = 4").count() == 8
    assert [tuple(r) for r in out.where("var = 'gdp' and values is not null").collect()] == [("gdp", "XA111", "2001-Q1", 2.0)]


def test_stage_tables_are_removed_on_request(spark, monkeypatch):
    import os

    from spherecube import runtime

    monkeypatch.setattr(runtime, "_WRITTEN", [])
    one, two = (runtime.materialise(spark.range(k)) for k in (5, 7))
    folders = [f.rpartition("/")[0].removeprefix("file://") for df in (one, two) for f in df.inputFiles()[:1]]
    assert all(map(os.path.isdir, folders)) and len(runtime._WRITTEN) == 2
    runtime.remove_stage(one)
    assert [os.path.isdir(f) for f in folders] == [False, True] and len(runtime._WRITTEN) == 1
    assert runtime.remove_stages(spark) == 1 and not any(map(os.path.isdir, folders)) and runtime.remove_stages(spark) == 0
