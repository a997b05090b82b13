"""The corpus pipeline: quality, line dedup, near duplicates, decontamination, mixing; each stage reads what the last kept.

Edge cases of all stages: rows with a null doc_id are kept but never learned from, never a copy of another document, never
contaminated, and drawn like others; null and empty texts have no lines to lose, no shingles and no windows; rows that
repeat a doc_id share its decisions; of ties the smallest doc_id stays; an empty table gives an empty one; columns beyond
those of documents are left out.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from netloom.llm import decontam, linededup, mixing, ngram_join, quality
from netloom.llm.common import cut, table

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose chance of good quality is a half or more."""
    return quality.scored(docs, table(spark, sf_dir, "labels")).where("quality_score >= 0.5").select(*COLUMNS)


def unique_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that an earlier document holds go; n_chars follows the text. Documents without a line left go."""
    out = linededup.dedup_lines(docs)
    out = out.where("n_dropped = 0 or length(text) > 0")
    return out.selectExpr("doc_id", "text", "lang", "source", "cast(case when n_dropped = 0 then n_chars else length(text) end as bigint) as n_chars")


def near_unique(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group linked by a Jaccard similarity of 0.8 or more on five-word shingles."""
    return ngram_join.keep_one(docs).select(*COLUMNS)


def uncontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that share no ten-word window with the benchmark."""
    occurrences, _ = decontam.decontaminate(docs, table(spark, sf_dir, "benchmark"))
    return docs.join(cut(occurrences.select("id").distinct(), "leaks").withColumnRenamed("id", "doc_id"), "doc_id", "left_anti").select(*COLUMNS)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the mixture of target weights holds at least once, with n_tokens and copies."""
    return mixing.mix(docs, weights=mixing.WEIGHTS).where("copies > 0").select(*COLUMNS, "n_tokens", "copies")


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality", good_quality), ("line_dedup", unique_lines), ("near_duplicates", near_unique), ("decontamination", uncontaminated), ("mixing", mixture),
]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = cut(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
