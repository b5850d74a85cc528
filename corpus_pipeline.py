"""A training-data pipeline over documents: five stages, each one operator of tallyhouse.llm."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tallyhouse.llm import decontamination, near_duplicates, pieces, quality_model, quality_rules
from tallyhouse.llm.queries import piece_file
from tallyhouse.llm.shared import Scratch, lasting


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the factorisation machine, fitted on labelled rows of docs, doesn't reject.

    Null and empty texts are scored by their statistics, repeated rows alike; rows
    keep all their columns, and an empty table gives an empty one.
    """
    machine = quality_model.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return quality_model.keep_predicted(docs, machine)


def fertility_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents inside the bands of tokeniser fertility.

    Null, empty and short texts go; a language without a band, null too, takes the
    default one. Rows keep all their columns, and an empty table gives an empty one.
    """
    return quality_rules.keep_quality(docs, pieces.PieceModel.load(piece_file()))


def near_deduplication(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near-duplicates, the one with the least id.

    Documents without words and rows without an id stay; of rows that repeat an id one
    stays. Rows keep all their columns, and an empty table gives an empty one.
    """
    return near_duplicates.drop_near_duplicates(docs)


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a word window of a benchmark item.

    Texts without words, null ones too, stay, and repeated rows are judged alike. Rows
    keep all their columns, and an empty table gives an empty one.
    """
    return decontamination.drop_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def piece_encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids and round_trip of each document that is left, repeated rows too.

    A null or empty text has no ids. An empty table gives an empty one.
    """
    return pieces.encode(docs, pieces.PieceModel.load(piece_file()))


STAGES = [
    ("quality_classifier", quality_classifier),
    ("quality_rules", fertility_rules),
    ("near_deduplication", near_deduplication),
    ("benchmark_decontamination", benchmark_decontamination),
    ("piece_encoding", piece_encoding),
]

#: No SQL: a fitted model and a tokeniser decide what the rows are.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents. Each stage's rows are written out before the next reads them, and deleted after it."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    with Scratch(spark) as scratch:
        for k, (_, stage) in enumerate(STAGES):
            out = stage(spark, docs, sf_dir)
            out = scratch.keep(out) if k + 1 < len(STAGES) else lasting(out)
            if k:
                scratch.drop(docs)
            docs = out
    return docs
