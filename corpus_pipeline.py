"""A training corpus from the documents table: five stages, each a table to the next."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from signalloom.llm import decontaminate, fair_mix, language_id, line_runs, simhash
from signalloom.session import remove_folder, stage_folder, stage_scope


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is clear; the dictionaries come from the labelled ones."""
    return language_id.drop_rejected(docs, language_id.learn(docs))


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the lines that several of them share."""
    return line_runs.without_repeats(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: 3-word shingles, at most 2 differing bits."""
    return simhash.keep_one(docs, shingle=3, budget=2)


def remove_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the passages of ten words and more that test items hold."""
    return decontaminate.remove(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents of the mix, with the words it takes of each."""
    return fair_mix.mixed(docs)


STAGES = [
    ("language_id", identify_language),
    ("line_dedup", drop_repeated_lines),
    ("simhash_dedup", drop_near_copies),
    ("decontamination", remove_benchmark),
    ("source_mix", mix_sources),
]

#: Compression and the trie have no SQL; the tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The mix, from the documents table.  A stage reads what the one before it wrote, so that its
    lineage is cut; what stages leave in the shared folder is deleted as soon as it has been read."""
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for _, stage in STAGES[:-1]:
        path = stage_folder(spark)
        with stage_scope(spark):
            made = stage(spark, docs, sf_dir)
            made.write.parquet(path)
        docs = spark.read.schema(made.schema).parquet(path)
        if before:
            remove_folder(spark, before)
        before = path
    return STAGES[-1][1](spark, docs, sf_dir)
