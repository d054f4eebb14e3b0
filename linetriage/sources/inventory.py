"""File inventory: size and SHA-256 of files, comparison with a recorded manifest."""

from __future__ import annotations

import re
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession, functions as F

from linetriage.sources.digests import escaped, split_digests

ROOT = r"^(?:[A-Za-z][A-Za-z0-9+.-]*:(?://[^/]*)?)?/+"  # what stands before the first step of a path
WHOLE = 128 * 2**20
PACKED = r"\.(gz|bz2|lz4|snappy|deflate|zst|zstd)$"


def file_digests(spark: SparkSession, path: str) -> DataFrame:
    """Name, bytes and SHA-256 of each file under a path, or of each entry that a glob matches.

    A folder that the glob matches (a table of several files) is one entry: its digest is that of the list of its
    files, each with its path in the folder, its bytes and its own SHA-256.
    """
    files = _each_file(spark, path)
    if not any(c in path.rsplit("/", 1)[-1] for c in "*?[{"):
        return files.select(F.element_at(F.split("path", "/"), -1).alias("name"), "bytes", "sha256")
    place = _depth(path)
    below = F.array_join(F.slice("steps", place + 1, F.size("steps")), "/")
    parts = files.withColumn("steps", F.split(F.regexp_replace("path", ROOT, ""), "/")).select(
        F.element_at("steps", place).alias("name"), F.struct(below.alias("below"), "bytes", "sha256").alias("part"))
    entries = parts.groupBy("name").agg(F.sum("part.bytes").alias("bytes"), F.sort_array(F.collect_list("part")).alias("parts"))
    listed = F.array_join(F.transform("parts", lambda p: F.concat_ws(":", p["below"], p["bytes"].cast("string"), p["sha256"])), "\n")
    is_file = (F.size("parts") == 1) & (F.col("parts")[0]["below"] == "")
    return entries.select("name", "bytes", F.when(is_file, F.col("parts")[0]["sha256"]).otherwise(F.sha2(listed, 256)).alias("sha256"))


def _each_file(spark: SparkSession, path: str) -> DataFrame:
    """A file of up to ``WHOLE`` bytes is one row of one task; a larger one is read in splits by many."""
    def read(paths: str | list[str]) -> DataFrame:
        return spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(paths)

    def whole(files: DataFrame) -> DataFrame:
        return files.select("path", F.col("length").alias("bytes"), F.sha2("content", 256).alias("sha256"))

    large = read(path).where(F.col("length") > WHOLE).select("path", "length", F.col("_metadata.file_path").alias("file")).collect()
    out = whole(read(path).where(F.col("length") <= WHOLE))  # the reader opens no file that its length leaves out
    packed = [r["path"] for r in large if re.search(PACKED, r["path"])]
    if packed:  # their lines would come unpacked
        out = out.unionByName(whole(read([escaped(p) for p in packed])))
    listed = [r for r in large if r["path"] not in packed]
    if not listed:
        return out
    found = split_digests(spark, [r["path"] for r in listed], {r["file"]: r["length"] for r in listed})
    rows = [(r["path"], r["length"], found[r["file"]]) for r in listed]
    return out.unionByName(spark.createDataFrame(rows, out.schema))


def _depth(path: str) -> int:
    """How many steps below the root of its file system the entries of a path lie."""
    whole = re.sub(ROOT, "", path if re.match(ROOT, path) else str(Path(path).absolute()))
    return len([step for step in whole.split("/") if step])


def against_manifest(files: DataFrame, manifest: DataFrame) -> DataFrame:
    """Files that are missing, unexpected or changed compared with a manifest of (name, sha256)."""
    a = files.select("name", F.col("sha256").alias("found"))
    b = manifest.select("name", F.col("sha256").alias("recorded"))
    state = (
        F.when(F.col("found").isNull(), "missing").when(F.col("recorded").isNull(), "unexpected")
        .when(F.col("found") != F.col("recorded"), "changed").otherwise("same")
    )
    return a.join(b, "name", "full_outer").withColumn("state", state)

