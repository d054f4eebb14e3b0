"""Helpers that several operators of this subpackage share."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from linetriage.session import shared_root


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """A new folder below ``spark.checkpoint.dir``."""
    return f"{shared_root(spark).rstrip('/')}/llm-{uuid.uuid4().hex}"


def stored(df: DataFrame) -> DataFrame:
    """Write a table once to the shared folder and read it back, so that lost executors cost no recomputation."""
    path = shared_folder(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def parts(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions", "200"))


def texts_of(column: pa.Array) -> list[str]:
    """Python strings of a text column; null counts as empty."""
    return [t or "" for t in column.to_pylist()]


def whole_keys(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """Cut a stream that is sorted by ``keys`` into tables that hold every key completely."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        cut = batch.num_rows
        same = np.ones(batch.num_rows, bool)
        for k in keys:
            column = batch.column(k).to_numpy(zero_copy_only=False)
            same &= column == column[-1]
        cut = batch.num_rows - int(np.argmin(same[::-1])) if not same.all() else 0
        if cut:
            done = pa.Table.from_batches([*held, batch.slice(0, cut)])
            held = []
            yield done
        elif held:
            last = held[-1]
            if any(last.column(k)[last.num_rows - 1] != batch.column(k)[0] for k in keys):
                yield pa.Table.from_batches(held)
                held = []
        held.append(batch.slice(cut))
    if held:
        yield pa.Table.from_batches(held)


def runs(*columns: np.ndarray) -> np.ndarray:
    """Start positions of the runs of equal keys in sorted columns, with the length appended."""
    n = len(columns[0])
    new = np.zeros(n, bool)
    if n:
        new[0] = True
    for c in columns:
        new[1:] |= c[1:] != c[:-1]
    return np.append(np.flatnonzero(new), n)


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser (the constants are those of splitmix64)."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


def summed_vector(
    df: DataFrame, partial: Callable[[Iterator[pa.RecordBatch]], Iterator[np.ndarray]], size: int, join: np.ufunc = np.add
) -> np.ndarray:
    """The sum over all tasks of vectors of fixed ``size`` (unsigned 32-bit), as one vector on the driver.

    Each task sends the non-zero stretches of its vector; equal stretches are summed by Spark before
    anything reaches the driver, which holds ``4 * size`` bytes however large the input is.
    """
    stretch = 4096

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for vector in partial(batches):
            at = [i for i in range(0, size, stretch) if vector[i : i + stretch].any()]
            raw = [np.pad(v := vector[i : i + stretch], (0, stretch - len(v))).astype("<u4").tobytes() for i in at]
            yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(raw, pa.binary())], names=["at", "part"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for at, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                part = np.frombuffer(raw, "<u4")
                sums[at] = join(sums[at], part) if at in sums else part
        yield pa.RecordBatch.from_arrays(
            [pa.array(list(sums), pa.int64()), pa.array([s.tobytes() for s in sums.values()], pa.binary())],
            names=["at", "part"])

    schema = "at long, part binary"
    sent = df.mapInArrow(cut, schema).repartition(max(1, min(parts(df.sparkSession), -(-size // stretch))), "at")
    out = np.zeros(-(-size // stretch) * stretch, np.uint32)
    for row in sent.mapInArrow(add, schema).collect():
        out[row["at"] : row["at"] + stretch] = np.frombuffer(row["part"], "<u4")
    return out[:size]
