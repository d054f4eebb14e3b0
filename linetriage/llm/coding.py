"""Token ids in files of range-coded blocks, predicted by mixed contexts of order 0 to 2.

The distribution of the next id mixes three with integer weights that add up to 4,096: the file's ids by how
often they occur (order 0), and the ids that last followed the same one and the same two ids in the block, each with
all its chance on that id. The weights follow how sure these two ids are: how often in turn they were right. What each
state of sureness is worth is counted over the file and stands in its head; the memory starts anew in each block.
Many blocks advance together, one id a step.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np

BLOCK = 4096  # ids of a block, at most
MAGIC = b"LTTOK2\n\0"
IDS = (1 << 16) - 2  # ids lie below
COUNTS = 16  # bits of the total of the chances of order 0
TOTAL = 12  # bits of the total of the weights
ROWS = 9  # bits of the number of remembered ids of each order
SURE = 15  # how often in turn a remembered id was right, at most
STATES = (SURE + 1) ** 2
PLAIN = 2  # of a state's three cells: right by order 2, right by order 1, neither
WORD = 32  # bits written at once
STEPS = 8  # steps whose intervals are looked up together
_U = np.uint64
_LEAST, _WORD, _UNIT = _U(1 << WORD), _U(WORD), _U(TOTAL + COUNTS)
_FULL = _U((1 << 64) - 1)
_FIRST_CELL = 3 * np.arange(STATES)


def shares(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct ids by falling count, and the chance of each in 1 / 65,536, at least 1."""
    seen = np.zeros(IDS, np.int64)
    for at in range(0, len(ids), 1 << 18):
        seen += np.bincount(ids[at : at + (1 << 18)], minlength=IDS)
    order = np.argsort(-seen, kind="stable")[: np.count_nonzero(seen)]
    if not len(order):
        return order, order
    sizes = np.maximum(seen[order] * (1 << COUNTS) // len(ids), 1)
    over = int(sizes.sum()) - (1 << COUNTS)
    if over <= 0:
        sizes[0] -= over
        return order, sizes
    # Rare ids got more than their share: it is taken evenly from the commoner ones.
    spare = sizes - 1
    taken = np.minimum(spare, spare * over // spare.sum() + 1)
    taken -= np.diff(np.maximum(np.cumsum(taken) - over, 0), prepend=0)
    return order, sizes - taken


class Memory:
    """What many blocks remember at once, one lane each, all starting with nothing.

    For the last id and for the last two ids: the id that followed lately, and how often in turn it did. All
    arithmetic is on integers, so coder and decoder agree everywhere.
    """

    def __init__(self, lanes: int, distinct: int):
        n = np.arange(distinct + 1, dtype=np.uint32)
        self.one, self.two = ((n * np.uint32(k) >> np.uint32(32 - ROWS)).astype(np.int64) for k in (0x9E3779B1, 0x85EBCA6B))
        self.held = np.full(lanes << (ROWS + 1), distinct << 4, np.int32)
        self.before = np.zeros(lanes, np.int64)
        self.last = np.zeros(lanes, np.int64)
        self.keep(lanes)

    def keep(self, lanes: int) -> None:
        """Go on with the first ``lanes`` lanes only."""
        self.last, self.before = self.last[:lanes], self.before[:lanes]
        self.rows = np.arange(2 * lanes).reshape(2, lanes, order="F") << ROWS
        self.row = np.empty((2, lanes), np.int64)
        self.found, self.guess, self.sure = (np.empty((2, lanes), np.int32) for _ in range(3))
        self.hit, self.more = np.empty((2, lanes), bool), np.empty((2, lanes), bool)

    def look(self) -> np.ndarray:
        """The first cell of each lane's state: how sure its guesses of order 2 and 1 are."""
        one = self.row[1]
        self.one.take(self.last, out=one, mode="clip")
        np.bitwise_xor(one, self.before, out=self.row[0])
        self.row += self.rows
        self.held.take(self.row, out=self.found, mode="clip")
        np.right_shift(self.found, 4, out=self.guess)
        np.bitwise_and(self.found, SURE, out=self.sure)
        state = self.sure[0] << 4
        state += self.sure[1]
        return _FIRST_CELL.take(state)

    def learn(self, ranks: np.ndarray) -> np.ndarray:
        """Remember what came; which guesses of order 2 and 1 were right."""
        new = ranks.astype(np.int32)
        np.equal(self.guess, new, out=self.hit)
        new <<= 4
        new += 1
        np.less(self.sure, SURE, out=self.more)
        self.found += self.more
        self.held[self.row] = np.where(self.hit, self.found, new)
        self.before, self.last = self.two.take(self.last, mode="clip"), ranks
        return self.hit


def intervals(weights: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and scale of the three cells of every state: the shares of order 2, order 1 and order 0."""
    ends = np.zeros((len(weights), 4), np.int64)
    ends[:, 1:3] = weights
    ends[:, 3] = 1 << TOTAL
    return (ends[:, :3] << COUNTS).ravel(), np.diff(ends).ravel()


class Order0:
    """Intervals of ranks in 1 / 65,536; the rank behind the last one stands for all of it."""

    def __init__(self, sizes: np.ndarray):
        self.size = np.append(sizes, 1 << COUNTS)
        self.start = np.append(np.cumsum(sizes) - sizes, 0)
        self.at = np.repeat(np.arange(len(sizes)), sizes).astype(np.uint16) if len(sizes) else np.zeros(1, np.uint16)


def guessed(grid: np.ndarray, sizes: np.ndarray, distinct: int) -> np.ndarray:
    """The cell of every rank in ``grid`` (a lane a column); ranks that were guessed become ``distinct`` there."""
    cells = np.full(grid.shape, 3 * STATES, np.uint16)
    live = grid.shape[1]
    memory = Memory(live, distinct)
    for step, row in enumerate(grid):
        if sizes[live - 1] <= step:
            live = int(np.searchsorted(-sizes, -step))
            memory.keep(live)
        ranks = row[:live].astype(np.int64)
        state = memory.look()
        exact, second = memory.learn(ranks)
        state += PLAIN
        state -= np.maximum(exact.view(np.uint8) << 1, second.view(np.uint8))
        cells[step, :live] = state
        np.copyto(row[:live], distinct, where=exact | second)
    return cells


def weigh(cells: np.ndarray) -> np.ndarray:
    """Where the shares of order 2 and 1 end in each state, of 4,096, by how often either was right; none is 0."""
    seen = np.zeros(3 * STATES + 1, np.int64)
    for rows in range(0, len(cells), 64):
        seen += np.bincount(cells[rows : rows + 64].ravel(), minlength=len(seen))
    seen = seen[:-1].reshape(STATES, 3)
    right = seen[:, :PLAIN] * ((1 << TOTAL) - 3) // np.maximum(seen.sum(axis=1), 1)[:, None] + 1
    return np.cumsum(right, axis=1)


def encode_lanes(cells: np.ndarray, grid: np.ndarray, lengths: np.ndarray, weights: np.ndarray, order0: Order0) -> list[bytes]:
    """Code each column (longest first) by itself; all lanes advance one id a step."""
    longest, count = grid.shape
    starts, scales = intervals(weights)
    low, width = np.zeros(count, _U), np.full(count, _FULL, _U)
    words = np.zeros(count * (longest + 2), np.uint32)
    begin = np.arange(count) * (longest + 2)
    sent = begin.copy()

    def put(rows: np.ndarray | slice, values: np.ndarray) -> None:
        words[sent[rows]] = values >> _WORD
        sent[rows] += 1

    live = count
    for step in range(longest):
        if step % STEPS == 0:
            some, ranks = (x[step : step + STEPS, :live].astype(np.int64) for x in (cells, grid))
            scale = scales.take(some, mode="clip")
            start = order0.start.take(ranks)
            start *= scale
            start += starts.take(some, mode="clip")
            scale *= order0.size.take(ranks)
            start, scale = start.view(_U), scale.view(_U)
        if lengths[live - 1] <= step:
            ended, live = live, int(np.searchsorted(-lengths, -step))
            for _ in range(2):
                put(slice(live, ended), low[live:])
                low[live:] <<= _WORD
            low, width = low[:live].copy(), width[:live].copy()
        width >>= _UNIT
        up = width * start[step % STEPS, :live]
        low += up
        width *= scale[step % STEPS, :live]
        carry = np.flatnonzero(low < up)
        if len(carry):
            places = sent[carry]
            while len(places):
                places -= 1
                words[places] += np.uint32(1)
                places = places[words[places] == 0]
        short = np.flatnonzero(width < _LEAST)
        if len(short):
            rest = low[short]
            put(short, rest)
            low[short] = rest << _WORD
            width[short] <<= _WORD
    for _ in range(2):
        put(slice(0, live), low)
        low <<= _WORD
    return [words[a:b].astype(">u4").tobytes() for a, b in zip(begin.tolist(), sent.tolist())]


def decode_lanes(coded: list[bytes], lengths: np.ndarray, weights: np.ndarray, order0: Order0) -> np.ndarray:
    """The ranks of each coded column (longest first)."""
    count, longest, distinct = len(coded), int(lengths.max(initial=0)), len(order0.size) - 1
    stream = np.frombuffer(b"".join([*coded, bytes(8)]), ">u4").astype(np.uint32)
    at = np.cumsum([0, *map(len, coded)])[:-1] // 4
    starts, scales = intervals(weights)
    share2, share1 = (np.repeat(weights[:, i], 3) for i in range(2))
    value = (stream.take(at, mode="clip").astype(_U) << _WORD) | stream.take(at + 1, mode="clip")
    at += 2
    width = np.full(count, _FULL, _U)
    grid = np.zeros((longest, count), np.uint16)
    live, memory = count, Memory(count, distinct)
    for step in range(longest):
        if lengths[live - 1] <= step:
            live = int(np.searchsorted(-lengths, -step))
            value, width, at = value[:live].copy(), width[:live].copy(), at[:live].copy()
            memory.keep(live)
        cell = memory.look()
        width >>= _UNIT
        place = (value // width).view(np.int64)
        share = place >> COUNTS
        exact, guess = share < share2.take(cell), share < share1.take(cell)
        cell += PLAIN
        cell -= exact
        cell -= guess
        start, scale = starts.take(cell, mode="clip"), scales.take(cell, mode="clip")
        place -= start
        ranks = order0.at.take((place / scale).astype(np.int64), mode="clip").astype(np.int64)  # place below 2**28, so exact
        np.copyto(ranks, distinct, where=guess)
        down = order0.start.take(ranks)
        down *= scale
        down += start
        scale *= order0.size.take(ranks)
        down = down.view(_U)
        down *= width
        value -= down
        width *= scale.view(_U)
        np.copyto(ranks, memory.guess[1], where=guess)
        np.copyto(ranks, memory.guess[0], where=exact)
        short = np.flatnonzero(width < _LEAST)
        if len(short):
            places = at[short]
            value[short] = (value[short] << _WORD) | stream.take(places, mode="clip")
            at[short] = places + 1
            width[short] <<= _WORD
        grid[step, :live] = ranks
        memory.learn(ranks)
    return grid


def write_file(ids: np.ndarray, block: int = BLOCK, doc_ids: np.ndarray | None = None, lengths: np.ndarray | None = None) -> bytes:
    """One file: a head, the documents in it, the ids ordered by how often they occur, and coded blocks.

    Head: magic; lengths of what follows; doc ids (signed 64-bit) and their numbers of ids (unsigned
    32-bit), compressed; distinct ids by falling count; their chances less 1 and the weights of all states, compressed; crc32 of all that. A block: number of ids, number
    of coded bytes, crc32 of its ids (little-endian unsigned 32-bit), crc32 of its coded bytes, those
    bytes. A block is decoded without any other.
    """
    ids = np.asarray(ids)
    if len(ids) and (ids.min() < 0 or ids.max() >= IDS):
        raise ValueError(f"ids must lie in 0 .. {IDS - 1}")
    order, sizes = shares(ids)
    rank_of = np.zeros(IDS, np.uint16)
    rank_of[order] = np.arange(len(order))
    blocks = [ids[i : i + block] for i in range(0, len(ids), block)]
    counts = np.array([len(b) for b in blocks], np.int64)
    grid = np.zeros((int(counts.max(initial=0)), len(blocks)), np.uint16)
    for i, plain in enumerate(blocks):
        grid[: len(plain), i] = rank_of.take(plain)
    cells = guessed(grid, counts, len(order))
    weights = weigh(cells)
    tables = zlib.compress((sizes - 1).astype("<u2").tobytes() + weights.astype("<u2").tobytes())
    index = b"" if doc_ids is None else zlib.compress(np.asarray(doc_ids, "<i8").tobytes() + np.asarray(lengths, "<u4").tobytes())
    documents = 0 if doc_ids is None else len(doc_ids)
    head = _HEAD.pack(block, len(ids), documents, len(index), len(order), len(tables), len(blocks))
    head += index + order.astype("<u2").tobytes() + tables
    out = [MAGIC, head, struct.pack("<I", zlib.crc32(head))]
    for plain, coded in zip(blocks, encode_lanes(cells, grid, counts, weights, Order0(sizes))):
        out += [_BLOCK.pack(len(plain), len(coded), zlib.crc32(plain.astype("<u4").tobytes()), zlib.crc32(coded)), coded]
    return b"".join(out)


_HEAD, _BLOCK = struct.Struct("<IQIIIII"), struct.Struct("<IIII")


def _head(data: bytes) -> tuple[int, int, np.ndarray, np.ndarray, tuple[np.ndarray, np.ndarray, np.ndarray], int]:
    """(number of ids, of blocks, doc ids, lengths, (ids by rank, their chances, weights), where blocks start), checked."""
    if data[: len(MAGIC)] != MAGIC:
        raise ValueError("not a token file")
    at = len(MAGIC)
    _, total, documents, index, distinct, tables, count = _HEAD.unpack_from(data, at)
    middle = at + _HEAD.size + index
    end = middle + 2 * distinct + tables
    if end + 4 > len(data) or zlib.crc32(data[at:end]) != struct.unpack_from("<I", data, end)[0]:
        raise ValueError("the head of a token file is damaged")
    raw = zlib.decompress(data[middle - index : middle]) if index else b""
    doc_ids, lengths = np.frombuffer(raw, "<i8", documents), np.frombuffer(raw, "<u4", documents, 8 * documents)
    found = np.frombuffer(zlib.decompress(data[end - tables : end]), "<u2").astype(np.int64)
    model = np.frombuffer(data, "<u2", distinct, middle), found[:distinct] + 1, found[distinct:].reshape(STATES, 2)
    return total, count, doc_ids, lengths, model, end + 4


def read_documents(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Doc ids of a file and how many ids each has."""
    return _head(data)[2:4]


def read_file(data: bytes, wanted: slice | None = None) -> np.ndarray:
    """The ids of a file, or of the blocks in ``wanted``; raises if any checksum is wrong."""
    return np.concatenate([*_blocks(data, wanted), np.empty(0, np.int32)])


def _blocks(data: bytes, wanted: slice | None) -> Iterator[np.ndarray]:
    total, count, _, _, (order, chances, weights), at = _head(data)
    found = []
    for _ in range(count):
        if at + _BLOCK.size > len(data):
            raise ValueError("blocks of a token file are missing")
        n, size, plain_crc, coded_crc = _BLOCK.unpack_from(data, at)
        found.append((n, data[at + _BLOCK.size : at + _BLOCK.size + size], plain_crc, coded_crc))
        at += _BLOCK.size + size
    if sum(f[0] for f in found) != total:
        raise ValueError("blocks of a token file are missing")
    found = found if wanted is None else found[wanted]
    for n, coded, _, crc in found:
        if zlib.crc32(coded) != crc:
            raise ValueError("a block of a token file is damaged")
    sizes = np.array([f[0] for f in found], np.int64)
    ranks = decode_lanes([f[1] for f in found], sizes, weights, Order0(chances)).T
    for row, (n, _, crc, _) in zip(ranks, found):
        ids = order.take(row[:n])
        if zlib.crc32(ids.astype("<u4").tobytes()) != crc:
            raise ValueError("a block of a token file decodes to other ids")
        yield ids.astype(np.int32)
