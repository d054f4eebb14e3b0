"""Append-only evidence records, their current view, and unset leaves of nested documents."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F, types as T

from linetriage.operators.ordering import previous_row

# States of an evidence record.
STATES = ("confirmed", "unconfirmed", "mismatch")


def linked_history(records: DataFrame) -> DataFrame:
    """Each record with the version recorded just before it for the same item."""
    return previous_row(records, ["item"], "checked_micros", "version", ["version"])


def current_view(records: DataFrame, items: Sequence[str], scope_hash: str) -> DataFrame:
    """Latest record per item for one scope; items without a record are unconfirmed, changed evidence is a mismatch.

    records: item, status, scope_hash, reviewer, checked_micros, version, evidence_sha256, current_sha256.
    """
    spark = records.sparkSession
    wanted = spark.range(1).select(F.explode(F.array(*[F.lit(i) for i in items])).alias("item"))
    body = F.struct("status", "reviewer", "checked_micros", "version", "evidence_sha256", "current_sha256")
    latest = records.where(F.col("scope_hash") == scope_hash).groupBy("item").agg(
        F.max_by(body, F.struct("checked_micros", "version")).alias("r")
    )
    joined = wanted.join(latest, "item", "left").select("item", "r.*")
    needs = F.col("status").isin("confirmed", "mismatch")
    intact = (
        F.col("reviewer").isNotNull() & F.col("checked_micros").isNotNull()
        & (F.col("evidence_sha256") == F.col("current_sha256"))
    )
    status = (
        F.when(F.col("status").isNull(), STATES[1])
        .when(needs & ~F.coalesce(intact, F.lit(False)), STATES[2])
        .otherwise(F.col("status"))
    )
    return joined.withColumn("status", status).select("item", "status", "version", "reviewer", "checked_micros")


def leaf_paths(schema: T.StructType, prefix: str = "") -> list[str]:
    """Dotted paths of the leaves of a nested schema."""
    out: list[str] = []
    for field in schema.fields:
        path = f"{prefix}{field.name}"
        if isinstance(field.dataType, T.StructType):
            out += leaf_paths(field.dataType, f"{path}.")
        else:
            out.append(path)
    return out


def unset_leaves(df: DataFrame) -> DataFrame:
    """How many documents leave each leaf unset, for leaves unset at least once."""
    paths = leaf_paths(df.schema)
    counts = df.agg(*[F.count(F.when(F.col(p).isNull(), 1)).alias(f"c{i}") for i, p in enumerate(paths)])
    cells = F.array(*[
        F.struct(F.lit(p).alias("path"), F.col(f"c{i}").alias("unset")) for i, p in enumerate(paths)
    ])
    return counts.select(F.explode(cells).alias("_c")).select("_c.*").where(F.col("unset") > 0)
