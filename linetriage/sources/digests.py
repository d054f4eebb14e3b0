"""SHA-256 of large files, read in splits: the state of the hash goes from split to split."""

from __future__ import annotations

import _hashlib
import ctypes
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from linetriage.sources import sinks

PIECE = 4 * 2**20  # bytes of a file in one row
MARK = b"\xef\xbb\xbf"  # Spark's line reader leaves this out at the start of a file


class Sha256:
    """SHA-256 whose state can be taken out and put back, which hashlib does not offer; the same OpenSSL."""

    def __init__(self, state: bytes = b"") -> None:
        self._crypto = ctypes.CDLL(_hashlib.__file__)
        self._context = ctypes.create_string_buffer(256)
        if state:
            self._context.raw = state
        else:
            self._crypto.SHA256_Init(self._context)

    def update(self, data: bytes) -> None:
        self._crypto.SHA256_Update(self._context, data, ctypes.c_size_t(len(data)))

    def state(self) -> bytes:
        return self._context.raw

    def hexdigest(self) -> str:
        out = ctypes.create_string_buffer(32)
        self._crypto.SHA256_Final(out, ctypes.create_string_buffer(self._context.raw, 256))
        return out.raw.hex()


def escaped(path: str) -> str:
    """The path as a glob that matches only itself."""
    return re.sub(r"([\[\]{}*?\\])", r"\\\1", path)


def _runs(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """The stretches of a batch that come from one split of one file; splits follow each other."""
    files, starts = batch.column("file"), batch.column("start")
    last, at = batch.num_rows - 1, 0
    if files[0] == files[last] and starts[0] == starts[last]:
        yield batch
        return
    for i in range(1, batch.num_rows):
        if starts[i] != starts[at] or files[i] != files[at]:
            yield batch.slice(at, i - at)
            at = i
    yield batch.slice(at)


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Lines of a split put together again, about ``PIECE`` bytes a row; each line gets its line feed."""
    key, nth, held, size = None, 0, [], 0

    def out() -> pa.RecordBatch:
        return pa.RecordBatch.from_pylist([{
            "file": key[0], "start": key[1], "nth": nth, "bytes": size, "data": b"".join(held)}], SCHEMA)

    for batch in batches:
        if not batch.num_rows:
            continue
        for run in _runs(batch):
            its = (run.column("file")[0].as_py(), run.column("start")[0].as_py())
            if its != key:
                if held:
                    yield out()
                key, nth, held, size = its, 0, [], 0
            lines = b"\n".join([*run.column("value").to_pylist(), b""])
            held.append(lines)
            size += len(lines)
            if size >= PIECE:
                yield out()
                nth, held, size = nth + 1, [], 0
    if held:
        yield out()


SCHEMA = pa.schema([
    ("file", pa.string()), ("start", pa.int64()), ("nth", pa.int32()), ("bytes", pa.int64()), ("data", pa.binary())])


def split_digests(spark: SparkSession, paths: list[str], sizes: dict[str, int]) -> dict[str, str]:
    """SHA-256 of each file in ``sizes`` (the URI and bytes of those at ``paths``) by jobs that read one split of every file.

    The files are read once, by lines, and stored as pieces in order. The hash of a file is sequential, so each job goes
    on from the states of the job before; states are all that reaches the driver.
    """
    lines = spark.read.option("lineSep", "\n").option("recursiveFileLookup", "true").text([escaped(p) for p in paths]).select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"),
        F.col("value").cast("binary").alias("value"))
    folder = f"{sinks.scratch_folder(spark)}/pieces"
    kinds = "file string, start long, nth int, bytes long, data binary"
    cut = lines.mapInArrow(_pieces, kinds).withColumn("step", F.col("start"))
    cut.write.partitionBy("step").option("compression", "none").parquet(folder)
    pieces = spark.read.schema(f"{kinds}, step long").parquet(folder)
    totals = pieces.groupBy("file").agg(F.sum("bytes").alias("bytes"), F.max("start").alias("last")).collect()
    found = {r["file"]: (r["bytes"], r["last"]) for r in totals}
    states, surplus = {}, {}
    for file, size in sizes.items():
        # What the lines gave beyond the file: a line feed after its last line, less the mark at its start.
        extra = found.get(file, (0, 0))[0] - size
        if extra not in (0, 1, -len(MARK), 1 - len(MARK)):
            raise ValueError(f"{file} changed while it was read")
        begun = Sha256()
        if extra < 0:
            begun.update(MARK)
        states[file], surplus[file] = begun.state(), extra in (1, 1 - len(MARK))
    for step in sorted(r[0] for r in pieces.select("step").distinct().collect()):
        ends = {f for f, (_, last) in found.items() if last == step and surplus[f]}
        rows = pieces.where(F.col("step") == step).select("file", "nth", "data").repartition("file").sortWithinPartitions("file", "nth")
        for r in rows.mapInArrow(_going_on(dict(states), ends), "file string, state binary").collect():
            states[r["file"]] = bytes(r["state"])
    return {f: Sha256(s).hexdigest() for f, s in states.items()}


def _going_on(states: dict[str, bytes], ends: set[str]):
    """States after the pieces of one split of each file; the last piece of a file in ``ends`` has a byte too many."""
    def advance(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        file, held, now = None, b"", None
        done: list[tuple[str, bytes]] = []

        def close() -> None:
            if now is not None:
                now.update(held[:-1] if file in ends else held)
                done.append((file, now.state()))

        for batch in batches:
            for name, data in zip(batch.column("file"), batch.column("data")):
                name = name.as_py()
                if name != file:
                    close()
                    file, now = name, Sha256(states[name])
                else:
                    now.update(held)
                held = data.as_py()
        close()
        yield pa.RecordBatch.from_arrays(
            [pa.array([d[0] for d in done], pa.string()), pa.array([d[1] for d in done], pa.binary())], names=["file", "state"])
    return advance
