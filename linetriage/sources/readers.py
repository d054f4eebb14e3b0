"""Readers: segment files, text-only tables, declared encodings, samples, JSON records."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, Window, functions as F, types as T

from linetriage.functions.sizing import small_table

# Encodings and separators a declared text file may use.
ENCODINGS = ("utf-8", "utf-8-sig", "cp949", "euc-kr")
SEPARATORS = (",", "\t", ";", "|")


def measurement_schema(features: Sequence[str], labelled: bool) -> T.StructType:
    fields = [T.StructField("row_id", T.LongType())]
    if labelled:
        fields.append(T.StructField("label", T.IntegerType()))
    return T.StructType([*fields, *[T.StructField(f, T.DoubleType()) for f in features]])


def read_segments(
    spark: SparkSession, path: str, features: Sequence[str], labelled: bool, pattern: str, header: bool = True
) -> DataFrame:
    """All files of a kind as one table; the segment is the first group of ``pattern`` in the file path.

    With a header the names in every file are checked against the schema by the reader.
    """
    frame = spark.read.schema(measurement_schema(features, labelled)).csv(
        path, header=header, enforceSchema=False, mode="FAILFAST"
    )
    return frame.withColumn("segment", F.regexp_extract(F.col("_metadata.file_path"), pattern, 1))


def read_text_columns(
    spark: SparkSession, path: str, columns: Sequence[str], sep: str = ",", lines: bool = False
) -> DataFrame:
    """Every column as text; blanks stay blanks and nothing is read as null. ``lines`` adds the row's position."""
    schema = T.StructType([T.StructField(c, T.StringType()) for c in columns])
    frame = spark.read.schema(schema).csv(
        path, header=True, sep=sep, enforceSchema=False, nullValue="\x00", emptyValue="",
        ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False,
    )
    text = [F.coalesce(F.col(c), F.lit("")).alias(c) for c in columns]
    if not lines:
        return frame.select(*text)
    return _with_lines(frame.select(
        *text, F.col("_metadata.file_path").alias("_file"), F.col("_metadata.file_block_start").alias("_block"),
        F.monotonically_increasing_id().alias("_id"),
    ))


def _with_lines(df: DataFrame) -> DataFrame:
    """Position of each row over all files in path order.

    A block of a file is read by one task from start to end, so the running id gives the place inside
    the block; the rows of earlier blocks come from one count per block.
    """
    blocks = df.groupBy("_file", "_block").agg(F.count(F.lit(1)).alias("_rows"), F.min("_id").alias("_first"))
    before = Window.partitionBy(F.lit(0)).orderBy("_file", "_block").rowsBetween(Window.unboundedPreceding, -1)
    starts = blocks.select(
        "_file", "_block", "_first", F.coalesce(F.sum("_rows").over(before), F.lit(0)).alias("_start")
    )
    line = F.col("_start") + F.col("_id") - F.col("_first") + 1
    return df.join(small_table(starts), ["_file", "_block"]).withColumn("line", line).drop(
        "_id", "_file", "_block", "_first", "_start"
    )


def read_declared(
    spark: SparkSession, path: str, encoding: str = "utf-8", sep: str = ",", header: bool = True
) -> DataFrame:
    """Text table with a declared encoding and separator; nothing is guessed."""
    if encoding not in ENCODINGS or sep not in SEPARATORS:
        raise ValueError(f"encoding must be one of {ENCODINGS} and separator one of {SEPARATORS}")
    if encoding in ("cp949", "euc-kr"):
        # Spark reads only the Unicode and ISO charsets unless the session allows all JVM charsets.
        spark.conf.set("spark.sql.legacy.javaCharsets", "true")
    names = {"utf-8-sig": "UTF-8", "utf-8": "UTF-8", "cp949": "x-windows-949", "euc-kr": "EUC-KR"}
    frame = spark.read.csv(path, header=header, sep=sep, encoding=names[encoding], multiLine=names[encoding] != "UTF-8")
    first = frame.columns[0]
    return frame.withColumnRenamed(first, first.lstrip("﻿"))


def read_json_records(spark: SparkSession, path: str, lines: bool = True, schema: T.StructType | None = None) -> DataFrame:
    """JSON lines, or documents that hold an array of records."""
    reader = spark.read if schema is None else spark.read.schema(schema)
    return reader.json(path, multiLine=not lines, mode="FAILFAST")


def read_sample(spark: SparkSession, path: str, kind: str, rows: int) -> tuple[DataFrame, dict]:
    """First rows of a csv, parquet or JSON-lines table, with its column count and repeated header names."""
    if kind == "csv":
        names = spark.read.csv(path, header=False).first()
        frame = spark.read.csv(path, header=True)
        header = [] if names is None else list(names)
    elif kind == "parquet":
        frame = spark.read.parquet(path)
        header = frame.columns
    elif kind == "jsonl":
        frame = spark.read.json(path)
        header = frame.columns
    else:
        raise ValueError(f"unknown kind {kind}")
    repeated = sorted({h for h in header if header.count(h) > 1})
    return frame.limit(rows), {"columns": len(header), "repeated": repeated}
