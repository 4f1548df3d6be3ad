"""A corpus from documents: language, near duplicates, benchmark passages, source weights, shards.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns
of docs. `run` applies them in order to the table documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from strandlake.llm import common, decontaminate, language, mixing, ngram_join, sharding

#: Documents whose best cosine with a language profile is lower are rejected.
LEAST_COSINE = 0.05


def keep_languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Profiles learned from the documents' own lang; what has no letters or resembles no language goes.

    Null and empty texts have no letters; a null lang isn't learned from; repeated rows are judged each; very long texts whole.
    """
    langs, prototypes = language.train(docs)
    return language.recognised(docs, langs, prototypes, LEAST_COSINE)


def keep_one_of_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component of the n-gram Jaccard join the least doc_id stays.

    A null doc_id is the least; of repeated rows with one doc_id one stays; documents without words are linked with nothing and stay.
    """
    return ngram_join.one_of_each(docs)


def drop_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark passage go.

    Null and empty texts hold none, null and empty passages are held by none; an empty benchmark removes nothing.
    """
    return decontaminate.clean(docs, common.table(spark, sf_dir, "benchmark"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents are dropped or repeated until sources have their target weights.

    A null source is a source, the last; null and empty texts have no words and go with their source's rate.
    """
    return mixing.mixed(docs)


def cut_shards(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every row of the mix with its shard and its place in it.

    Null texts are of size 1 and stand with empty ones; null lang and source come first on the curve; ties and repeated
    rows are ordered by doc_id; no rows give no rows.
    """
    return sharding.shards(docs, keep=("lang", "source", "n_chars"), texts=True)


STAGES = [
    ("language", keep_languages),
    ("near_duplicates", keep_one_of_near_duplicates),
    ("decontamination", drop_benchmark),
    ("mixing", mix_sources),
    ("sharding", cut_shards),
]

#: The language stage is no SQL; the stages are tested one by one against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stage(spark, docs, sf_dir)
        if name != STAGES[-1][0]:
            docs = common.cut_lineage(docs)
    return docs
