"""Corpus pipeline: language, near duplicates, decontamination, mixing, shards.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; between stages the rows are written as Parquet to the
shared folder and read again, so a lost executor costs one stage's tasks.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without an identifiable language go.

    Rows with a null or empty text, or without a letter, go; a null id or language, repeated rows and very long texts change
    nothing; an empty table stays empty; other columns are kept as they are.
    """
    from linkloom.llm.langid import fit_language_model, keep_identified

    return keep_identified(docs, fit_language_model(docs))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays (five-word shingles, similarity 0.75): that of the smallest id.

    Rows without words stay; of rows that share an id, or have none, each is judged by its own text, and of equal ones one
    stays; an empty table stays empty; other columns are kept as they are.
    """
    from linkloom.llm.ngram_join import keep_one_of_each

    return keep_one_of_each(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark passage go.

    Rows with a null or empty text stay; items with a null text, or of fewer than ten letters and digits, drop nothing; every
    row is judged by itself; an empty table or benchmark drops nothing; other columns are kept as they are.
    """
    from linkloom.llm.common import read_table
    from linkloom.llm.decontam import drop_leaking

    return drop_leaking(docs, read_table(spark, sf_dir, "benchmark"))


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources at their target weights; documents beyond a source's budget go, others repeat.

    Rows without words go; a null source is a source of its own, last in order; repeated rows are separate rows, also those
    without an id; the row at a source's cut keeps its first words; an empty table stays empty; other columns are kept.
    """
    from linkloom.llm.mixing import mixed_documents

    return mixed_documents(docs)


def shards(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All rows in compacted shards, with shard, tier and version.

    Nothing is dropped or changed: nulls, empty and long texts and repeated rows are stored as they are; where a column is
    named like one of the three, the new one gets an underscore; an empty table gives no rows.
    """
    from linkloom.llm.common import Scratch
    from linkloom.llm.sharding import shard_documents

    return shard_documents(docs, Scratch(spark, "shards").root).read()


STAGES = [("language", language), ("near_duplicates", near_duplicates), ("decontamination", decontamination), ("mixture", mixture), ("shards", shards)]

#: Language models, edit distances and compaction have no SQL; tests/llm/test_pipeline.py holds each stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    from linkloom.llm.common import Scratch, read_table, release_shuffles

    scratch = Scratch(spark, "pipeline")
    docs = read_table(spark, sf_dir, "documents")
    for i, (name, stage) in enumerate(STAGES):
        docs = scratch.save(stage(spark, docs, sf_dir), name)
        if i:
            scratch.drop(STAGES[i - 1][0])
        release_shuffles(spark)
    return docs
