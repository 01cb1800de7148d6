"""From raw documents to packed training sequences, stage by stage."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from foliate.llm import neardup, packing, quality, toxicity
from foliate.llm.common import table, written


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep. Null, empty and short texts go; repeated rows are judged alike; an empty
    table stays empty."""
    return quality.keep_good(docs)


def toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score below 0.5 for toxicity, by a model of the labelled ones among them that are not held out.
    Without labels of both classes none goes; an empty table stays empty."""
    return toxicity.keep_civil(docs, table(spark, sf_dir, "labels"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document of least doc_id of each group of near-duplicates (five words, similarity 0.8). Rows without an id
    stay, as do all rows of one kept id; an empty table stays empty."""
    return neardup.keep_first(docs)


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents, each with its sequence and offset. Documents of any length are cut into pieces that are
    all packed; repeated rows have pieces of their own; an empty table gives no rows."""
    return packing.best_fit(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality_rules", quality_rules),
    ("toxicity", toxic),
    ("near_duplicates", near_duplicates),
    ("best_fit_packing", best_fit_packing),
]

#: SQL cannot express the trained classifier, nor the packing; tests/llm/test_queries.py holds every stage and run()
#: against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages one after the other over the documents table, each written as Parquet and read back. Columns beside
    those of documents, whatever their names, come through all stages but the last."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), name)
    return docs
