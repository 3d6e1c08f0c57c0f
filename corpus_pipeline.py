"""A training corpus in five stages: rate, drop common lines, drop near-duplicates, drop benchmark leaks, encode."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from labelgrid.llm import bpe, classifier, decontaminate, jaccard_dedup, line_dedup
from labelgrid.llm.common import located
from labelgrid.session import through_table

# Look-ups of hashed text, suffix-free fingerprints and merges have no SQL form; tests compare with a brute-force version.
ORACLE_SQL = None


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def rate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the ordinal classifier expects to be good; the model learns from the labelled ones among them."""
    return classifier.keep_good(docs, classifier.ratings(_table(spark, sf_dir, "labels")))


def drop_common_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document without lines found in many; n_chars follows the text."""
    cut = line_dedup.drop_lines(docs)
    return cut.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)).select(*docs.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of texts whose five-word shingles have a Jaccard similarity of 0.8 or more: the one with its smallest doc_id."""
    return jaccard_dedup.one_of_each(docs)


def drop_benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a benchmark passage, judged and dropped row by row whatever their doc_id."""
    rows = located(docs)
    texts = rows.select(F.lit(None).cast("bigint").alias("doc_id"), F.col("row.text").alias("text"), "at")
    found = decontaminate.decontaminate(texts, _table(spark, sf_dir, "benchmark"), carry="at")
    leaks = through_table(found.where("contaminated").select(F.col("carried").alias("at")), "leaks")
    return rows.join(leaks, "at", "left_anti").select("row.*")


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of every document that is left."""
    return bpe.round_trip(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [
    ("quality classifier", rate),
    ("line dedup", drop_common_lines),
    ("simhash near-dedup", drop_near_duplicates),
    ("benchmark decontamination", drop_benchmark_leaks),
    ("bpe encoding", encode),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each result is written and read again by the next stage."""
    docs = _table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = through_table(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
