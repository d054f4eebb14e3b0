"""The queries of this subpackage over the given tables; their SQL, where SQL can say it, is in ``oracles``."""

from __future__ import annotations

from collections.abc import Callable
from string import ascii_lowercase, ascii_uppercase

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from linetriage.llm import (
    alignment, bpe, html, jaccard, linededup, merkle, neardup, packing, parsing, quality, secretscan, tokenfiles, toxicity,
)
from linetriage.llm.common import table
from linetriage.llm.oracles import ORACLE_SQL  # noqa: F401

Query = Callable[[SparkSession, str], DataFrame]

WORD_TOKENIZER = public_tokenizers.path("word_bpe_49k.json")
BYTE_TOKENIZER = public_tokenizers.path("byte_bpe_50k.json")
PIECE_TOKENIZER = public_tokenizers.path("piece_bpe_32k.model")
BYTE_RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")


def op1_embedding_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_copies(table(spark, sf_dir, "embeddings"))


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = quality.fit(docs, table(spark, sf_dir, "labels"))
    return quality.score(docs, model).select("doc_id", quality.held_out().alias("held_out"), "score", "predicted")


def op3_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = tokenfiles.write_tokens(table(spark, sf_dir, "documents"), WORD_TOKENIZER)
    return tokenfiles.read_tokens(files).select(
        "doc_id", "start", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), F.crc32("ids").alias("ids_crc32"))


def op4_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html.extract(table(spark, sf_dir, "pages"))


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"))
    return toxicity.score(docs, model).select("doc_id", toxicity.held_out().alias("held_out"), "score", "predicted")


def op6_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.link(table(spark, sf_dir, "documents"))


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    packed = packing.pack(table(spark, sf_dir, "documents"), WORD_TOKENIZER)
    return packed.select(
        "doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = linededup.dedup_lines(table(spark, sf_dir, "documents"))
    return done.select("doc_id", "text", F.length("text").cast("long").alias("n_chars"), "removed_lines")


def op9_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded = bpe.encode(table(spark, sf_dir, "documents"), BYTE_RANKS, public_tokenizers.PATTERN)
    return bpe.digests(coded, BYTE_RANKS, public_tokenizers.PATTERN)


def op10_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return parsing.fingerprint_beside_next(table(spark, sf_dir, "documents"))


def op11_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secretscan.find(table(spark, sf_dir, "documents"))

    def joined(only: tuple[str, ...]) -> Column:
        wanted = F.filter("spans", lambda s: s["kind"].isin(*only))
        return F.array_join(F.transform(wanted, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")

    def count(kind: str) -> Column:
        return F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    return found.select(
        "doc_id", *map(count, secretscan.BASE_KINDS), F.sha2(joined(secretscan.BASE_KINDS), 256).alias("base_sha256"),
        joined(secretscan.KINDS).alias("spans"))


def op12_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.col("text")
    lowered = F.translate(text, ascii_uppercase, ascii_lowercase)
    fields = [lowered if f == "text" else F.col(f) for f in merkle.FIELDS]
    tampered = F.when(F.crc32(F.col("doc_id").cast("string")) % 5 == 0, merkle.leaf_digest(fields))
    rows = merkle.manifest(table(spark, sf_dir, "documents"), {"tampered": tampered})
    folded = rows.withColumn("folded_root", merkle.folded(F.coalesce("tampered", "leaf"), F.col("path")))
    return folded.select(
        "doc_id", "leaf", "subroot", "root", merkle.proof_digest(F.col("path")).alias("proof_sha256"), "folded_root",
        (F.col("folded_root") == F.col("root")).alias("verified"))


def op13_tokenizer_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    aligned = alignment.align(
        table(spark, sf_dir, "documents"), BYTE_TOKENIZER, PIECE_TOKENIZER, public_tokenizers.PATTERN)
    return aligned.select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")


QUERIES: dict[str, Query] = {f.__name__: f for f in (
    op1_embedding_neardup, op2_quality, op3_token_files, op4_html_extraction, op5_toxicity, op6_ngram_jaccard, op7_packing,
    op8_line_dedup, op9_byte_bpe, op10_fingerprints, op11_secret_scan, op12_merkle_manifest,
    op13_tokenizer_alignment,
)}
