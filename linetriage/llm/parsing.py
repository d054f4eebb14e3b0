"""Document fingerprints by locally consistent parsing, and the next document in id order."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from linetriage.llm.common import mixed, parts

KEEP = 64  # phrase names kept in a fingerprint
LEVELS = 48


def _tossed(x: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Twice the lowest bit in which a name differs from its left neighbour's, plus that bit of the name."""
    left = np.empty_like(x)
    left[1:] = x[:-1]
    left[first] = ~x[first]  # at the left edge of a text: bit 0
    differ = x ^ left
    low = np.bitwise_count((differ & (~differ + x.dtype.type(1))) - x.dtype.type(1))
    return (2 * low + ((x >> low.astype(x.dtype)) & x.dtype.type(1)).astype(np.uint8)).astype(np.uint8)


def _phrase_starts(x: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Positions where phrases start: local maxima after four tosses, and the starts of texts.

    Neighbours differ, so after four tosses labels are below 6 and neighbours still differ: phrases have
    bounded length, and whether a position starts one depends on five names before it and one after it.
    """
    label = x
    for _ in range(4):
        label = _tossed(label, first)
    left, right = np.zeros_like(label), np.zeros_like(label)
    left[1:], right[:-1] = label[:-1], label[1:]
    top = (label > left) & (label >= right)
    top[first] = True
    after = first[first + 1 < len(x)] + 1
    top[after] &= np.isin(after, first)  # no phrase of a single name at the left edge
    return np.flatnonzero(top)


def phrase_names(codes: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(text number, name) of every phrase from the second level up, over texts given one after another.

    Runs of equal names become one name first, then deterministic coin tossing cuts the rest into
    phrases. A name is a hash of the names below, so equal phrases have equal names in any text.
    """
    owner = np.repeat(np.arange(len(lengths)), lengths).astype(np.int32)
    names, owners, found = codes, owner, []
    for level in range(LEVELS):
        if not len(names):
            break
        new = np.ones(len(names), bool)
        new[1:] = (names[1:] != names[:-1]) | (owners[1:] != owners[:-1])
        at = np.flatnonzero(new)
        times = np.diff(np.append(at, len(names)))
        first_level = names.dtype != np.uint64
        names, owners = names[at], owners[at]
        fold = np.flatnonzero(times > 1)
        if len(fold) and first_level:
            names, first_level = names.astype(np.uint64), False
        if len(fold):
            names[fold] = mixed(names[fold] ^ mixed(times[fold].astype(np.uint64) + np.uint64(1 << 40)))
        head = np.ones(len(names), bool)
        head[1:] = owners[1:] != owners[:-1]
        first = np.flatnonzero(head)
        start = _phrase_starts(names, first)
        place = np.arange(len(names)) - np.repeat(start, np.diff(np.append(start, len(names))))
        with np.errstate(over="ignore"):
            each = mixed(names.astype(np.uint64) + (place.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15))
            names = mixed(np.add.reduceat(each, start) + np.uint64(level))
        owners = owners[start]
        if level >= 1:
            found.append((owners, names))
        alone = np.bincount(owners, minlength=len(lengths)) == 1
        done = alone[owners]
        if level == 0 and done.any():
            found.append((owners[done], names[done]))
        names, owners = names[~done], owners[~done]
    if not found:
        return np.empty(0, np.int32), np.empty(0, np.uint64)
    return np.concatenate([f[0] for f in found]), np.concatenate([f[1] for f in found])


def fingerprints(texts: list[str], keep: int = KEEP) -> list[np.ndarray]:
    """The ``keep`` smallest distinct phrase names of each text, as unsigned 32-bit integers; none if empty."""
    codes = [np.frombuffer(t.encode("utf-32-le", "surrogatepass"), "<u4") for t in texts]
    lengths = np.array([len(c) for c in codes], np.int64)
    owners, names = phrase_names(np.concatenate(codes) if codes else np.empty(0, np.uint32), lengths)
    small = (names >> np.uint64(32)).astype(np.uint64)
    key = np.sort((owners.astype(np.uint64) << np.uint64(32)) | small)
    if len(key):
        key = key[np.append(True, key[1:] != key[:-1])]
    edges = np.searchsorted(key, np.arange(len(texts) + 1, dtype=np.uint64) << np.uint64(32))
    low = (key & np.uint64(0xFFFFFFFF)).astype(np.uint32)
    return [low[a : min(b, a + keep)] for a, b in zip(edges[:-1], edges[1:])]


def likeness(a: np.ndarray, b: np.ndarray, keep: int = KEEP) -> float:
    """Estimated share of phrases in common (twice the common ones by the sum of both); two empty texts: 1."""
    if not len(a) and not len(b):
        return 1.0
    union = np.union1d(a, b)[:keep]
    jaccard = np.isin(union, np.intersect1d(a, b, assume_unique=True)).sum() / len(union)
    return float(2 * jaccard / (1 + jaccard))


def written(fingerprint: np.ndarray) -> str:
    return fingerprint.astype(">u4").tobytes().hex()


def edited(text: str, following: str) -> str:
    """The last half of ``text`` (rounded down) replaced by as many first characters of ``following``, or all."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


def id_ranges(docs: DataFrame, ranges: int) -> list[int]:
    """First ids of at most ``ranges`` ranges of doc_id of like size; as many rows as ranges reach the driver."""
    firsts = (
        docs.select("doc_id").repartitionByRange(ranges, "doc_id")
        .groupBy(F.spark_partition_id().alias("_p")).agg(F.min("doc_id").alias("doc_id")).collect()
    )
    return sorted(r.doc_id for r in firsts)


def dealt_by_range(docs: DataFrame, ranges: int | None = None, copies: bool = True) -> DataFrame:
    """Deal (doc_id, text) into sorted ranges of doc_id, each followed by a copy of the next range's first row.

    Adds ``range`` and ``copy``; rows are sorted by both and doc_id (ties by text) within their task. The
    last range is followed by the first row of all. Without ``copies``, ranges hold their own rows only, and each
    is a task of its own.
    """
    docs = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(-(1 << 63))).alias("doc_id"),
                       F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    spark = docs.sparkSession
    count = ranges or 4 * parts(spark)
    starts = id_ranges(docs, count)
    if not starts:
        return docs.select("*", F.lit(0).alias("range"), F.lit(False).alias("copy"))
    edges = np.array(starts, np.int64)

    @F.pandas_udf("int")
    def range_of(ids: pd.Series) -> pd.Series:
        return pd.Series(np.searchsorted(edges, ids.to_numpy(), side="right") - 1).astype("int32")

    own = F.struct(F.col("_r").alias("range"), F.lit(False).alias("copy"))
    before = F.struct(((F.col("_r") + F.lit(len(starts) - 1)) % F.lit(len(starts))).cast("int").alias("range"),
                      F.lit(True).alias("copy"))
    places = F.when(F.col("doc_id").isin(starts), F.array(own, before)).otherwise(F.array(own)) if copies else F.array(own)
    rows = docs.withColumn("_r", range_of("doc_id")).withColumn("_to", F.explode(places)).select(
        "doc_id", "text", "_to.range", "_to.copy")
    if copies:
        dealt = rows.repartition(max(1, min(count, 4 * len(starts)) // 4), "range")
    else:
        dealt = rows.repartitionByRange(len(starts), "range")
    return dealt.sortWithinPartitions("range", "copy", "doc_id", "text")


SCHEMA = ("doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, "
          "near_edited double, near_next double")


def fingerprint_beside_next(docs: DataFrame, keep: int = KEEP, chars: int = 1_000_000) -> DataFrame:
    """Fingerprint every text and its edited text, and compare with the next document's.

    One shuffle of the texts by id range; a task holds about ``chars`` characters at a time (a longer
    text alone). Null and empty texts have an empty fingerprint. Rows with equal doc_id are ordered by
    text; null doc_ids come first and come back null. A single row is its own next one. Other columns
    are ignored; an empty table gives no rows.
    """

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                yield from zip(*(part.column(i).to_pylist() for i in range(4)))

    def answer(group: list[tuple], following: tuple) -> pa.RecordBatch:
        ids, texts = [g[0] for g in group], [g[1] for g in group]
        nexts = [*texts[1:], following[1]]
        changed = [edited(t, n) for t, n in zip(texts, nexts)]
        own = fingerprints([*texts, following[1]], keep)
        other = fingerprints(changed, keep)
        return pa.RecordBatch.from_arrays([
            pa.array([None if i == -(1 << 63) else i for i in ids], pa.int64()),
            pa.array([len(t) for t in texts], pa.int64()),
            pa.array([hashlib.sha256(c.encode()).hexdigest() for c in changed], pa.string()),
            pa.array([written(f) for f in own[:-1]], pa.string()),
            pa.array([written(f) for f in other], pa.string()),
            pa.array([likeness(a, b, keep) for a, b in zip(own, other)], pa.float64()),
            pa.array([likeness(a, b, keep) for a, b in zip(own, own[1:])], pa.float64()),
        ], names=["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group: list[tuple] = []
        size, now = 0, None
        for row in rows(batches):
            if row[2] != now:
                group, size, now = [], 0, row[2]
            if row[3]:
                if group:
                    yield answer(group, row)
                    group = []
                continue
            if size >= chars:
                yield answer(group, row)
                group, size = [], 0
            group.append(row)
            size += len(row[1])

    return dealt_by_range(docs).mapInArrow(run, SCHEMA)
