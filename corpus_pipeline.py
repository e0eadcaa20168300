"""The corpus pipeline: from raw documents to padded training batches."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from postwright.llm.common import materialize, table
from postwright.llm.lines import drop_boilerplate
from postwright.llm.mixing import mixed
from postwright.llm.ngram_join import keep_first
from postwright.llm.packing import packed
from postwright.llm.quality_rules import keep_good

#: Share of the tokens that the mixing stage keeps in expectation.
MIX_BUDGET = 0.8


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules reject go."""
    return keep_good(docs)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Boilerplate lines of each source go; ``n_chars`` follows the text."""
    return drop_boilerplate(docs).drop("n_lines", "n_dropped").withColumn("n_chars", F.char_length("text").cast("long"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates stays."""
    return keep_first(docs)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents are sampled to the target mix."""
    return mixed(docs, budget=MIX_BUDGET).select("__row.*")


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents become pieces with the batch that each is trained in."""
    return packed(docs)


STAGES = [
    ("quality_rules", quality),
    ("line_dedup", line_dedup),
    ("ngram_jaccard_join", near_duplicates),
    ("mixing", mixing),
    ("packing", packing),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents; what a stage keeps is written and read by the next."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)


#: Shingle hashes and batch numbers have no SQL form; the tests hold the stages against brute force.
ORACLE_SQL = None
