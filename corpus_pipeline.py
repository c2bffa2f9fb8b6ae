"""The corpus pipeline: each stage takes what the stage before it kept, as a table.

Quality rules, line dedup, the Jaccard join and decontamination return the columns of documents; packing returns pieces."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from genolake.llm.common import discard, staged, table
from genolake.llm.decontamination import without_leaks
from genolake.llm.jaccard_join import without_near_copies
from genolake.llm.line_dedup import without_boilerplate
from genolake.llm.packing import pack, tokenizer_path
from genolake.llm.quality_rules import keep_good


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that fail the rules go."""
    return keep_good(docs)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that stand on too many documents of a source go from all of them."""
    return without_boilerplate(docs)


def ngram_jaccard_join(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents linked by near copies (five-word shingles, similarity of 0.8 or more), the one with the least id stays."""
    return without_near_copies(docs, k=5, percent=80)


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that contain an item of benchmark go."""
    return without_leaks(docs, table(spark, sf_dir, "benchmark"))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of token windows."""
    return pack(docs, tokenizer_path())


STAGES = [(f.__name__, f) for f in (quality_rules, line_dedup, ngram_jaccard_join, benchmark_decontamination, packing)]
#: SQL can't express tokenization and retrieval packing; the tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, done = table(spark, sf_dir, "documents"), []
    for name, stage in STAGES[:-1]:
        docs = staged(stage(spark, docs, sf_dir), name)
        discard(*done)
        done = [docs]
    return STAGES[-1][1](spark, docs, sf_dir)
