"""A corpus pipeline of five stages over ``documents``; part of the ``llm`` subpackage.

Each stage is (name, function); a function takes (spark, docs, sf_dir) and returns a DataFrame, which ``run`` writes
as Parquet into the shared checkpoint folder and reads again as the documents of the next stage. All but the last
return the columns of ``documents``. What a stage wrote for itself, and its input, is deleted once its result is written.

Defined cases, for every stage: null, empty and blank texts pass all stages but the mix, which takes words and so drops
documents without any; very long texts pass whole; rows that repeat a doc_id are documents of their own, unless the near
duplicates' stage finds them alike; without labels no document is bad; an empty table gives an empty result with the same
columns; further columns stay, whatever their names, up to the last stage, which names its columns.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from loomspark.llm import bpe, common, line_crf, minmax, mixing, secret_scan


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the line classifier predicts to be bad go."""
    return line_crf.keep_good(docs, common.table(spark, sf_dir, "labels"))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates, with a similarity of 0.8 or more, stays."""
    return minmax.keep_one(docs)


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are replaced by a mark; every document stays."""
    return secret_scan.redact(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The words that the mix takes from each document, once for each pass that takes some of them."""
    return mixing.mixed_texts(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each text, and whether they decode to it."""
    done = bpe.round_trips(docs.select("doc_id", "lang", "source", "text"), bpe.default_path())
    return done.select("doc_id", "lang", "source", "n_tokens", "token_ids", "round_trip")


STAGES = [("quality classifier", quality), ("minhash near-dedup", near_dedup), ("secret scans", secrets), ("source mixing", mix), ("bpe encoding", tokens)]
#: SQL cannot express a trained classifier or the merges of a vocabulary.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents")
    for _, stage in STAGES:
        with common.scratch() as kept:
            made = common.cut(stage(spark, docs, sf_dir))
            kept.append(made)
        common.drop(docs)
        docs = made
    return docs
