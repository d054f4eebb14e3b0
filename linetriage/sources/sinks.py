"""Writers: tables, one-row JSON reports, guarded aggregate exports."""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, functions as F

from linetriage.session import shared_root

FORMATS = ("parquet", "csv", "json")


def scratch_folder(spark: SparkSession) -> str:
    """A new folder every executor can reach, below the shared one."""
    return f"{shared_root(spark).rstrip('/')}/scratch-{uuid.uuid4().hex}"


def save(df: DataFrame, path: str, kind: str = "parquet", overwrite: bool = False, **options: str) -> None:
    """Write a table; an existing target is an error unless overwriting is asked for."""
    if kind not in FORMATS:
        raise ValueError(f"unknown format {kind}")
    defaults = {"header": "true"} if kind == "csv" else {}
    writer = df.write.mode("overwrite" if overwrite else "errorifexists").options(**{**defaults, **options})
    writer.format(kind).save(path)


def save_report(df: DataFrame, path: str) -> None:
    """A nested frame as JSON documents, one line each."""
    save(df, path, "json", ignoreNullFields="false")


def export_aggregates(
    df: DataFrame, allowed: Sequence[str], fraction: float | None = None
) -> DataFrame:
    """Only tables whose columns are all on the allow-list may leave; optionally one budget fraction of them."""
    extra = sorted(set(df.columns) - set(allowed))
    if extra:
        raise ValueError(f"columns are not on the export list: {extra}")
    return df if fraction is None else df.where(F.abs(F.col("fraction") - fraction) < 1e-12)
