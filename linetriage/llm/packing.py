"""Pack documents into token windows: minimum bin slack by subset sums over remaining lengths."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from linetriage.llm.tokens import END_ID, encode_with_end

SCHEMA = "doc_id long, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long"
_ARROW = pa.schema([
    ("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("ids", pa.binary()),
    ("doc_tokens", pa.int64()), ("sequence_id", pa.int64()), ("offset", pa.int64()),
])


def fullest(counts: dict[int, int], capacity: int) -> dict[int, int]:
    """The multiset of lengths with the largest sum that is at most ``capacity``.

    A set of reachable sums is one integer used as a bitset. Each length enters as copies of 1, 2, 4, ...
    times itself, so that a length with count c costs about log2(c) shifts; the sums known before each
    entry are kept, and walking them backwards gives how often each length was used.
    """
    mask = (1 << (capacity + 1)) - 1
    sums, trail = 1, []
    for length in sorted(counts, reverse=True):
        left, step = min(counts[length], capacity // length), 1
        while left > 0:
            take = min(step, left)
            trail.append((sums, length, take))
            sums |= (sums << (length * take)) & mask
            left -= take
            step *= 2
        if sums >> capacity & 1:
            break
    at, used = sums.bit_length() - 1, {}
    for before, length, take in reversed(trail):
        if not before >> at & 1:
            at -= length * take
            used[length] = used.get(length, 0) + take
    return used


class Packer:
    """Packs the documents of one stream; holds at most ``pool`` remainders, each shorter than a window."""

    def __init__(self, capacity: int, pool: int, first_sequence: int):
        self.capacity, self.pool, self.sequence = capacity, pool, first_sequence
        self.rest: dict[int, list[tuple]] = {}
        self.held = 0
        self.rows: list[tuple] = []

    def place(self, pieces: list[tuple]) -> None:
        """One sequence: pieces (doc_id, start, ids, doc_tokens) one after another."""
        offset = 0
        for doc, start, ids, total in pieces:
            self.rows.append((doc, start, len(ids), ids.astype("<u4").tobytes(), total, self.sequence, offset))
            offset += len(ids)
        self.sequence += 1

    def add(self, doc, ids: np.ndarray) -> None:
        total, whole = len(ids), len(ids) // self.capacity * self.capacity
        for at in range(0, whole, self.capacity):
            self.place([(doc, at, ids[at : at + self.capacity], total)])
        if whole < total:
            self.keep((doc, whole, ids[whole:], total))
        if self.held >= self.pool:
            while self.held > self.pool // 2:
                self.fill()

    def keep(self, piece: tuple) -> None:
        self.rest.setdefault(len(piece[2]), []).append(piece)
        self.held += 1

    def take(self, length: int) -> tuple:
        piece = self.rest[length].pop()
        if not self.rest[length]:
            del self.rest[length]
        self.held -= 1
        return piece

    def fill(self) -> None:
        """The longest remainder opens a window; the best multiset of the others fills it."""
        pieces = [self.take(max(self.rest))]
        room = self.capacity - len(pieces[0][2])
        counts = {n: len(p) for n, p in self.rest.items() if n <= room}
        for length, times in fullest(counts, room).items():
            pieces += [self.take(length) for _ in range(times)]
            room -= length * times
        if room and self.rest:  # what no multiset reaches is cut from the longest remainder
            doc, start, ids, total = self.take(max(self.rest))
            pieces.append((doc, start, ids[:room], total))
            self.keep((doc, start + room, ids[room:], total))
            room = 0
        if room:
            self.halves(pieces)
        else:
            self.place(pieces)

    def halves(self, pieces: list[tuple]) -> None:
        """The last pieces of a stream: sequences whose lengths are powers of two, so without padding."""
        left = sum(len(p[2]) for p in pieces)
        while left:
            size = 1 << (left.bit_length() - 1)
            left -= size
            now = []
            while size:
                doc, start, ids, total = pieces.pop(0)
                now.append((doc, start, ids[:size], total))
                if len(ids) > size:
                    pieces.insert(0, (doc, start + size, ids[size:], total))
                size -= len(now[-1][2])
            self.place(now)

    def finish(self) -> None:
        while self.rest:
            self.fill()

    def drain(self) -> pa.RecordBatch:
        columns = list(zip(*self.rows)) if self.rows else [[]] * len(_ARROW)
        self.rows = []
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, _ARROW)], schema=_ARROW)


def pack(
    docs: DataFrame, tokenizer: str, capacity: int = 4096, pool: int = 512, end_id: int = END_ID
) -> DataFrame:
    """Pack every document of ``docs`` (doc_id, text) into sequences of at most ``capacity`` tokens.

    Each input partition is packed as it streams by: no shuffle, and at most ``pool`` remainders held. A
    sequence id is the partition number times 2**40 plus a running number, the same when a task is run
    again. ``ids`` holds little-endian unsigned 32-bit integers. A null or empty text is the end id
    alone; a null doc_id is carried along; repeated rows are packed each; other columns are ignored; an
    empty table gives no rows.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer = Packer(capacity, pool, TaskContext.get().partitionId() << 40)
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                texts = [t or "" for t in part.column(1).to_pylist()]
                for doc, ids in zip(part.column(0).to_pylist(), encode_with_end(tokenizer, texts, end_id)):
                    packer.add(doc, ids)
                if packer.rows:
                    yield packer.drain()
        packer.finish()
        if packer.rows:
            yield packer.drain()

    return docs.selectExpr("cast(doc_id as long) doc_id", "cast(text as string) text").mapInArrow(run, SCHEMA)
