"""A training corpus from raw documents: five stages, each working on all that the one before has kept."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from linetriage.llm import jaccard, linededup, packing, quality, toxicity
from linetriage.llm.common import stored, table
from linetriage.llm.queries import WORD_TOKENIZER

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose quality score reaches the cut; a score of one half or more always does."""
    model = quality.fit(docs, table(spark, sf_dir, "labels"))
    return quality.passing(docs, model, quality.cut_at(docs, model))


def toxicity_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are not predicted toxic."""
    return toxicity.passing(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without later copies of line runs; those of which nothing is left go."""
    done = linededup.dedup_lines(docs)
    emptied = (F.col("removed_lines") > 0) & (F.trim(F.regexp_replace("text", r"\s+", " ")) == "")
    return done.where(~F.coalesce(emptied, F.lit(False))).select(*[f"`{c}`" for c in docs.columns])


def ngram_jaccard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that of the smallest id, of each group of near copies (five words, similarity 0.8)."""
    linked = jaccard.link(docs, width=5, least=80)
    others = linked.where("doc_id <> component_id").select(F.col("doc_id").alias("_llm_other")).distinct()
    return docs.join(others, F.col("doc_id").cast("long") == F.col("_llm_other"), "left_anti")


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All kept documents as pieces of token sequences."""
    return packing.pack(docs, WORD_TOKENIZER)


STAGES: list[tuple[str, Stage]] = [
    ("quality_classifier", quality_classifier),
    ("toxicity", toxicity_filter),
    ("line_dedup", line_dedup),
    ("ngram_jaccard", ngram_jaccard),
    ("packing", pack),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage over ``documents``; each stage is written and read again."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir))
    return docs


#: Classifiers, connected components and packing are no SQL; tests compare each stage with a plain version.
ORACLE_SQL: str | None = None
