"""A corpus from raw documents to tokens: each stage works on what the one before it kept.

Language ID and toxicity drop the documents they reject, of near copies one document stays, the mix repeats or leaves out
documents by its targets, and the last stage returns the digests of the token ids and of what they decode to.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spherecube.llm import bpe, langid, mixing, ngram_join, toxicity
from spherecube.llm.common import free_name, read
from spherecube.runtime import materialise

#: SQL cannot express a classifier or an encoder; tests compare the stages with brute force.
ORACLE_SQL = None

#: A document whose language is less likely than this is rejected.
LEAST_LANGUAGE = 0.5


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of a known language: not `und`, and the language has at least half of the probability."""
    columns, lang, share = docs.columns, free_name(docs, "_lang"), free_name(docs, "_share")
    found = langid.predict(docs, langid.fit_held_out(docs), lang, share)
    return found.where((F.col(lang) != "und") & (F.col(share) >= LEAST_LANGUAGE)).select(*columns)


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score under 0.5; the classifiers learn from the labelled documents that came here."""
    columns, score = docs.columns, free_name(docs, "_toxic")
    model = toxicity.fit_held_out(docs, read(spark, sf_dir, "labels"))
    return toxicity.score(docs, model, score).where(F.col(score) < 0.5).select(*columns)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document of smallest doc_id of each group of linked ones; rows without an id stay.

    Near copies share five-word shingles, with a similarity of 0.8 or more.
    """
    groups = ngram_join.jaccard_components(docs, width=5, percent=80)
    first = groups.where("doc_id = component_id").select("doc_id").distinct()
    kept = docs.join(first, "doc_id", "left_semi").dropDuplicates(["doc_id"])
    return kept.select(*docs.columns).union(docs.where("doc_id is null"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document as often as the mix takes it."""
    return mixing.mixed_documents(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens and digests of each document of the mix."""
    return bpe.round_trip(docs)


STAGES = [
    ("language", identify_language), ("toxicity", drop_toxic), ("near_copies", drop_near_copies), ("mixture", mix_sources), ("byte_bpe", encode),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of `sf_dir`; what a stage returns is written before the next one reads it."""
    docs = read(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
