"""Token files of a whole table in doc_id order, and what they hold."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from linetriage.llm import coding
from linetriage.llm.common import parts, stored
from linetriage.llm.parsing import dealt_by_range
from linetriage.llm.tokens import END_ID, encode_with_end

FILE_IDS = 1 << 23  # ids after which a file is closed; documents stay whole. Blocks of a file advance together
NULL_ID = -(1 << 63)


def write_tokens(docs: DataFrame, tokenizer: str, file_ids: int = FILE_IDS, end_id: int = END_ID) -> DataFrame:
    """(range, number, first, n_ids, content): the token files of ``docs`` (doc_id, text), stored in the shared folder.

    Each task codes a range of doc_ids in ascending order; ``content`` is a whole file of the format, and
    ``first`` counts the ids of its range before it. The table is written by Spark's committer, so a task
    that runs again leaves no halves. A null or empty text is the end id alone; null doc_ids come first;
    rows that share a doc_id are ordered by text. Other columns are ignored; an empty table gives no file.
    """
    schema = "range int, number int, first long, n_ids long, content binary"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        docs_held: list[int] = []
        size = first = number = 0
        now = None

        def close() -> pa.RecordBatch:
            content = coding.write_file(np.concatenate(held), doc_ids=docs_held, lengths=[len(h) for h in held])
            return pa.RecordBatch.from_arrays(
                [pa.array([now], pa.int32()), pa.array([number], pa.int32()), pa.array([first], pa.int64()),
                 pa.array([size], pa.int64()), pa.array([content], pa.binary())],
                names=["range", "number", "first", "n_ids", "content"])

        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                coded = encode_with_end(tokenizer, part.column(1).to_pylist(), end_id)
                for doc, ids, of in zip(part.column(0).to_pylist(), coded, part.column(2).to_pylist()):
                    if held and (of != now or size >= file_ids):
                        yield close()
                        first, number, held, docs_held, size = first + size, number + 1, [], [], 0
                    if of != now:
                        now, first, number = of, 0, 0
                    held.append(ids)
                    docs_held.append(doc)
                    size += len(ids)
        if held:
            yield close()

    return stored(dealt_by_range(docs, parts(docs.sparkSession), copies=False).mapInArrow(run, schema))


def read_tokens(files: DataFrame) -> DataFrame:
    """(doc_id, start, ids) of every document in token files, ids as little-endian unsigned 32-bit integers.

    ``start`` counts the ids of all documents before it. Only the number of ids per range reaches the
    driver, one row for each range.
    """
    totals = files.groupBy("range").agg(F.sum("n_ids").alias("n")).orderBy("range").collect()
    before, base = 0, {}
    for row in totals:
        base[row["range"]] = before
        before += row["n"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for of, first, content in zip(*(batch.column(i).to_pylist() for i in range(3))):
                ids = coding.read_file(content).astype("<u4")
                doc_ids, lengths = coding.read_documents(content)
                ends = np.cumsum(lengths.astype(np.int64))
                starts = ends - lengths
                for at in range(0, len(doc_ids), 2000):
                    some = slice(at, at + 2000)
                    raw = [ids[a:b].tobytes() for a, b in zip(starts[some], ends[some])]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(doc_ids[some], pa.int64(), mask=doc_ids[some] == NULL_ID),
                         pa.array(starts[some] + first + base[of]), pa.array(raw, pa.binary())], names=["doc_id", "start", "ids"])

    return files.select("range", "first", "content").mapInArrow(run, "doc_id long, start long, ids binary")
