"""The registered queries of spherecube.llm against their SQL, and the pipeline's stages on each other's results."""

import duckdb
import pytest
from compare import TABLES, duck_result, spark_result
from pyspark.sql import functions as F

import corpus_pipeline
from spherecube.llm import bpe, mixing, ngram_join, queries

SQL = queries.oracle_sql()


@pytest.fixture(scope="module")
def duck(sf_dir):
    connection = duckdb.connect()
    for t in TABLES:
        connection.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return connection


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_is_its_sql(name, spark, sf_dir, duck):
    got = spark_result(queries.queries()[name](spark, sf_dir))
    assert got == duck_result(duck, SQL[name]) and got[1]


def test_every_operator_has_its_query():
    assert [n.split("_")[0] for n in queries.queries()] == [f"op{k}" for k in range(1, 14)] + ["pipeline"]


def test_stages(spark, sf_dir, tmp_path):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    columns, frames = docs.columns, [docs]
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, frames[-1], sf_dir).write.parquet(f"{tmp_path}/{name}")
        frames.append(spark.read.parquet(f"{tmp_path}/{name}"))
    spoken, polite, single, mixed, encoded = frames[1:]
    assert all(f.columns == columns for f in frames[:-1])
    assert spoken.count() == docs.where("text rlike '\\\\p{L}'").count()
    toxic = docs.join(spark.read.parquet(f"{sf_dir}/labels.parquet").where("toxic = 0"), "doc_id", "left_semi").select("doc_id")
    assert polite.join(toxic, "doc_id", "left_semi").count() >= 0.9 * toxic.count()
    groups = ngram_join.jaccard_components(polite, 5, 80)
    assert sorted(r[0] for r in single.select("doc_id").collect()) == sorted(r[0] for r in groups.select("component_id").distinct().collect())
    assert mixed.exceptAll(mixing.mixed_documents(single)).count() == 0
    assert encoded.exceptAll(bpe.round_trip(mixed)).count() == 0 and encoded.count() == mixed.count()


def test_stages_of_odd_documents(spark, sf_dir):
    rows = [(None, "a text without an id", "en", None, 1), (1, None, None, None, None), (2, "same words here again now", "en", "a", 1), (2, "same words here again now", "en", "a", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    kept = corpus_pipeline.drop_near_copies(spark, docs, sf_dir)
    assert sorted((r["doc_id"] for r in kept.collect()), key=str) == [1, 2, None]
    nothing = docs.limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, nothing, sf_dir).count() == 0


def test_stages_keep_extra_columns_with_clashing_names(spark, sf_dir):
    extra = "_lang _share _toxic _sk _copy upto0 upto1 upto2 found score lang_pred rep n k token size taken source_size target component_id words ids".split()
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").limit(120).withColumns({c: F.lit(i) for i, c in enumerate(extra)})
    columns = docs.columns
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, sf_dir)
        assert docs.columns == columns and docs.where(" or ".join(f"`{c}` <> {i}" for i, c in enumerate(extra))).count() == 0, name
        docs = spark.createDataFrame(docs.collect(), docs.schema)
    assert docs.count() > 0 and corpus_pipeline.STAGES[-1][1](spark, docs, sf_dir).count() == docs.count()
