"""The corpus pipeline: each stage works on all that its predecessor kept.

A stage is (name, function); a function takes (spark, docs, sf_dir) and returns a
DataFrame, which is written as Parquet and read again as the next one's docs. All but
the last return the columns of documents.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from plumbline.llm import jaccard, mixing, packing, quality, toxicity
from plumbline.session import importable, remove, scratch, table

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules reject go.

    Null and empty texts have too few words and go; repeated rows are judged alike; very long texts are
    judged whole. An empty table stays empty. Columns, whatever their names, are unchanged.
    """
    importable(spark)
    return quality.keep(docs)


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents predicted toxic go; the grammar learns from the labelled documents of the corpus.

    Null and empty texts stay; repeated rows are judged alike; very long texts are judged whole. Without
    labels of both kinds nothing goes. An empty table stays empty. Columns are unchanged.
    """
    importable(spark)
    return toxicity.keep(docs, toxicity.train(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays, that with the smallest doc_id.

    Null and empty texts have no copies and stay; of rows that repeat doc_id and text one stays; very long
    texts are compared whole. An empty table stays empty. Columns are unchanged.
    """
    importable(spark)
    return jaccard.keep_first(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents are repeated or left out as their rate says, so that domain totals meet the targets.

    Null and empty texts have uniform posteriors and no tokens and get a rate like others; repeated rows
    are rounded alike. Targets out of reach give the nearest shares and a warning. An empty table stays
    empty. Columns are unchanged.
    """
    importable(spark)
    return mixing.resample(docs, mixing.language_labels(docs, table(spark, sf_dir, "labels")))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """What is left, packed into sequences.

    Null and empty texts are one token; repeated rows are packed once each; longer texts than a sequence are
    cut into pieces and none of their tokens is lost. An empty table packs to nothing. Other columns go.
    """
    importable(spark)
    return packing.pack(docs)


STAGES: list[tuple[str, Stage]] = [
    ("quality rules", quality_rules),
    ("toxicity", drop_toxic),
    ("near duplicates", near_duplicates),
    ("mixing to targets", mix_sources),
    ("best-fit packing", pack),
]
#: The classifiers and the packing aren't SQL; tests/llm/test_pipeline.py holds each stage against a plain version on its own input.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over `documents`, each written to the shared folder and read again; what a stage has read goes once it has written."""
    folder = scratch(spark, "pipeline")
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{k}")
        docs = spark.read.parquet(f"{folder}/{k}")
        if k:
            remove(spark, f"{folder}/{k - 1}")
    return docs
