"""A corpus from raw documents to packed training sequences, stage by stage.

Each stage takes all that the one before it kept; its rows are written as Parquet and read again as the next one's documents.
Quality rules and language ID drop the documents they reject, the n-gram join keeps one document of each group of linked
ones (five words, Jaccard 0.8), mixing writes all documents in the order of the target weights, and packing cuts and
places their tokens in successive windows of that order.

Empty tables pass through; null ids and texts are judged as each operator says (a null text is too short and goes at once).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tideglass.llm import language_id, mixing, ngram_join, packing, quality_rules
from tideglass.llm.common import table, written
from tideglass.llm.queries import REST_WEIGHT, SEQUENCE, VOCABULARY, WEIGHTS


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that no quality rule rejects."""
    return quality_rules.keep_good(docs)


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is found with a margin; learned from the labels of these documents."""
    return language_id.keep_certain(docs)


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates; the stage links at five words and 0.8, whatever the operator's defaults."""
    return ngram_join.keep_one(docs, width=5, percent=80)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents in mixed order: the files follow the schedule, row by row. Sources without a weight have streams of their own."""
    return mixing.mixed(docs, mixing.with_unlisted(docs, WEIGHTS, REST_WEIGHT), REST_WEIGHT)


def sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents' pieces with their sequence and offset, packed window by window in the order of the files that ``mix`` wrote."""
    return packing.pack(mixing.as_written(docs, "_place"), VOCABULARY, SEQUENCE, order_col="_place")


STAGES = [
    ("quality_rules", quality),
    ("language_id", language),
    ("ngram_jaccard_join", one_of_each),
    ("source_mixing", mix),
    ("best_fit_packing", sequences),
]

#: SQL can express neither compression nor byte-pair merges; tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
