"""Byte-level BPE as a lazily determinised finite-state transducer, and a streaming decoder."""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

EMPTY = b""
NEVER = 1 << 60
STRIDE = 32  # bytes after which agreed tokens are written where no states are kept
LONGEST = 256  # characters of a piece that is remembered


def read_ranks(path: str) -> dict[bytes, int]:
    """Token bytes and ranks of a file with one base64 token and one rank a line."""
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}


def merge(ranks: dict[bytes, int], piece: bytes) -> list[bytes]:
    """The definition: join the adjacent pair of lowest rank, leftmost first, while there is one."""
    parts = [piece[i : i + 1] for i in range(len(piece))]
    while len(parts) > 1:
        best, at = min((ranks.get(a + b, 1 << 60), i) for i, (a, b) in enumerate(zip(parts, parts[1:])))
        if best == 1 << 60:
            break
        parts[at : at + 2] = [parts[at] + parts[at + 1]]
    return parts


def _slices(token: bytes) -> Iterator[bytes]:
    for i in range(len(token)):
        for j in range(i + 1, len(token) + 1):
            yield token[i:j]


class Transducer:
    """Reads bytes, writes tokens as soon as no later byte can change them.

    The last token of the encoding of a prefix is the only one whose start is itself encoded and whose
    left neighbour does not merge with it. A state holds the last written token and, for each position
    from which a longer token may still start, the bytes since then and the tokens since the last
    written one. States are made when they are first reached and shared by content; what all positions
    agree on is written. Lookahead is bounded by the longest token. Once ``limit`` states are kept, the rest
    of a piece that leaves them is stepped through without, and what is agreed on is written every
    ``STRIDE`` bytes. As in any trained file, a token must have a higher rank than its two halves.
    """

    def __init__(self, ranks: dict[bytes, int], limit: int = 60_000):
        self.ranks, self.limit = ranks, limit
        self.prefixes = {token[:i] for token in ranks for i in range(1, len(token))}
        self.fits_memory: dict[tuple[bytes, bytes], bool] = {}
        self.spines: tuple[dict, dict] = {}, {}
        self.halves_memory: dict[bytes, tuple[bytes, bytes] | None] = {}
        self.states: dict[tuple, dict] = {}
        self.start = self.state((EMPTY, ((EMPTY, ()),)))

    def state(self, key: tuple) -> dict:
        """A state is a dict of byte to (ids written, next state), with its key under -1 and its last ids under -2."""
        known = self.states.get(key)
        if known is None:
            final = next(chain for since, chain in key[1] if since == EMPTY)
            known = self.states[key] = {-1: key, -2: tuple([self.ranks[t] for t in final])}
        return known

    def halves(self, token: bytes) -> tuple[bytes, bytes] | None:
        """The two tokens that are merged last to make this one; None if merging does not make it."""
        if token not in self.halves_memory:
            rank = self.ranks[token]
            parts = merge({k: r for k in _slices(token) if (r := self.ranks.get(k, rank)) < rank}, token)
            self.halves_memory[token] = tuple(parts) if len(parts) == 2 else None
        return self.halves_memory[token]

    def spine(self, token: bytes, side: int) -> tuple[list[bytes], list[int]]:
        """The parts of a token at its left (0) or right (1) edge, in the order in which merging makes them,
        and for each the rank at which it grows (``NEVER`` for the whole token)."""
        known = self.spines[side].get(token)
        if known is None:
            parts = [token]
            while len(parts[-1]) > 1:
                parts.append(self.halves(parts[-1])[side])
            parts.reverse()
            known = self.spines[side][token] = parts, [*(self.ranks[p] for p in parts[1:]), NEVER]
        return known

    def fits(self, left: bytes, right: bytes) -> bool:
        """Whether the bytes of both tokens are encoded as these two; ``left`` may be empty."""
        key = (left, right)
        known = self.fits_memory.get(key)
        if known is None:
            if len(self.fits_memory) > 4 * self.limit:
                self.fits_memory.clear()
            known = self.fits_memory[key] = self._fits(left, right)
        return known

    def _fits(self, left: bytes, right: bytes) -> bool:
        if len(right) > 1 and self.halves(right) is None:
            return False
        if left == EMPTY:
            return True
        # Both edges grow in order of rank; the tokens stay apart if no merge across comes first.
        (a, grow_a), (b, grow_b), i, j, rank = self.spine(left, 1), self.spine(right, 0), 0, 0, self.ranks.get
        while True:
            across, next_a, next_b = rank(a[i] + b[j], NEVER), grow_a[i], grow_b[j]
            if across < next_a and across <= next_b:
                return False
            if next_a <= next_b:
                if next_a == NEVER:
                    return True
                i += 1
            else:
                j += 1

    def step(self, state: dict, byte: int) -> tuple[tuple[int, ...], dict]:
        (written, live), one = state[-1], bytes((byte,))
        after, ended, ranks, prefixes = [], None, self.ranks, self.prefixes
        for since, chain in live:
            longer = since + one
            if ended is None and longer in ranks:
                key = (chain[-1] if chain else written, longer)
                fits = self.fits_memory.get(key)
                if self.fits(*key) if fits is None else fits:
                    ended = (*chain, longer)
            if longer in prefixes:
                after.append((longer, chain))
        after.append((EMPTY, ended))
        sure, written, after = self.agreed(written, after)
        made = state[byte] = tuple([ranks[t] for t in sure]), self.state((written, tuple(after)))
        return made

    def agreed(self, written: bytes, live: list) -> tuple[tuple[bytes, ...], bytes, list]:
        """The tokens that all positions agree on, the last token written after them, and the positions without them."""
        ended = live[-1][1]
        sure = len(ended)
        for _, chain in live[:-1]:
            sure = min(sure, len(chain))
            while chain[:sure] != ended[:sure]:
                sure -= 1
        if not sure:
            return (), written, live
        return ended[:sure], ended[sure - 1], [(since, chain[sure:]) for since, chain in live]

    def unkept(self, key: tuple, rest: bytes) -> list[int]:
        """Ids from a state on to the end of ``rest``, without making states: what the steps above would write."""
        (written, live), ranks, prefixes, known = key, self.ranks, self.prefixes, self.fits_memory
        out: list[int] = []
        for at, byte in enumerate(rest, 1):
            one, after, ended = bytes((byte,)), [], None
            for since, chain in live:
                longer = since + one
                if ended is None and longer in ranks:
                    pair = (chain[-1] if chain else written, longer)
                    fits = known.get(pair)
                    if self.fits(*pair) if fits is None else fits:
                        ended = (*chain, longer)
                if longer in prefixes:
                    after.append((longer, chain))
            after.append((EMPTY, ended))
            live = after
            if not at % STRIDE:
                sure, written, live = self.agreed(written, live)
                out += [ranks[t] for t in sure]
        return out + [ranks[t] for t in live[-1][1]]

    def encode(self, piece: bytes) -> list[int]:
        out: list[int] = []
        state = self.start
        for at, byte in enumerate(piece):
            known = state.get(byte)
            if known is None:
                if len(self.states) >= self.limit:
                    return out + self.unkept(state[-1], piece[at:])
                known = self.step(state, byte)
            ids, state = known
            if ids:
                out += ids
        out += state[-2]
        return out


class Pieces(dict):
    """Ids of whole pieces seen lately, as bytes; others go through the transducer.

    With ``limit`` pieces they become the older half, from which those still in use come back. Pieces of
    more than ``LONGEST`` characters are not kept, so memory is bounded however long they are.
    """

    def __init__(self, transducer: Transducer, limit: int):
        super().__init__()
        self.transducer, self.limit, self.older = transducer, limit, {}

    def __missing__(self, piece: str) -> bytes:
        raw = self.older.get(piece)
        if raw is None:
            raw = np.array(self.transducer.encode(piece.encode()), "<u4").tobytes()
        if len(piece) > LONGEST:
            return raw
        if len(self) >= self.limit:
            self.older = dict(self)
            self.clear()
        self[piece] = raw
        return raw


class Encoder:
    """Ids of texts: each match of ``pattern`` separately; at most twice ``limit`` pieces remembered per worker."""

    def __init__(self, ranks: dict[bytes, int], pattern: str, limit: int = 200_000):
        import regex

        self.find = regex.compile(pattern).findall
        self.pieces = Pieces(Transducer(ranks), limit)

    def encode(self, text: str) -> np.ndarray:
        return np.frombuffer(b"".join(map(self.pieces.__getitem__, self.find(text))), "<u4")


def _utf8_table() -> list[bytes]:
    """Next state by state and byte. 0: between code points; 1 to 3: so many bytes to come; 4 to 7: two
    or three to come with a narrower next byte (after E0, ED, F0, F4); 8: broken."""
    rows = [bytearray([8] * 256) for _ in range(9)]
    for b in range(0x80):
        rows[0][b] = 0
    for lead, state in [*((b, 1) for b in range(0xC2, 0xE0)), *((b, 2) for b in range(0xE1, 0xF0)), (0xE0, 4),
                        (0xED, 5), (0xF0, 6), *((b, 3) for b in range(0xF1, 0xF4)), (0xF4, 7)]:
        rows[0][lead] = state
    for state, low, high, then in [(1, 0x80, 0xC0, 0), (2, 0x80, 0xC0, 1), (3, 0x80, 0xC0, 2), (4, 0xA0, 0xC0, 1),
                                   (5, 0x80, 0xA0, 1), (6, 0x90, 0xC0, 2), (7, 0x80, 0x90, 2)]:
        for b in range(low, high):
            rows[state][b] = then
    return [bytes(r) for r in rows]


_UTF8 = _utf8_table()
_HIGH = re.compile(rb"[\x80-\xff]+")


class Utf8Stream:
    """Turns bytes that arrive in any cuts into text; keeps at most three bytes of an open code point.

    ASCII leaves the state between code points as it is, so only runs of other bytes are walked. Bytes
    that no code point can hold raise, as they mean that ids were lost.
    """

    def __init__(self):
        self.state, self.open = 0, b""

    def feed(self, data: bytes) -> str:
        if not self.state and data.isascii():
            return data.decode("ascii")
        data = self.open + data
        state, cut = 0, len(data)
        for run in _HIGH.finditer(data):
            if state:
                break
            for at in range(*run.span()):
                if not state:
                    cut = at
                state = _UTF8[state][data[at]]
                if state == 8:
                    raise ValueError(f"byte {data[at]:#x} cannot stand here")
            if state and run.end() < len(data):
                raise ValueError("a code point is cut short")
        self.state = state
        whole = data[:cut] if state else data
        self.open = data[len(whole) :]
        return whole.decode("utf-8")

    def close(self) -> None:
        if self.open:
            raise ValueError("the last code point is cut short")


class Decoder:
    def __init__(self, ranks: dict[bytes, int]):
        self.tokens = [b""] * (max(ranks.values()) + 1)
        for token, rank in ranks.items():
            self.tokens[rank] = token

    def stream(self, ids: np.ndarray, step: int = 4096) -> Iterator[str]:
        stream = Utf8Stream()
        for at in range(0, len(ids), step):
            yield stream.feed(b"".join(map(self.tokens.__getitem__, ids[at : at + step].tolist())))
        stream.close()


@lru_cache(maxsize=2)
def coder(path: str, pattern: str) -> tuple[Encoder, Decoder]:
    ranks = read_ranks(path)
    return Encoder(ranks, pattern), Decoder(ranks)


def encode(docs: DataFrame, ranks_path: str, pattern: str) -> DataFrame:
    """(doc_id, ids): the ids of every text as little-endian unsigned 32-bit integers.

    Null and empty texts have no ids. Every row gives one row, repeated rows and null doc_ids too; other
    columns are ignored.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = coder(ranks_path, pattern)[0]
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                ids = [encoder.encode(t or "").tobytes() for t in part.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(ids, pa.binary())], names=["doc_id", "ids"])

    return docs.selectExpr("cast(doc_id as long) doc_id", "cast(text as string) text").mapInArrow(
        run, "doc_id long, ids binary")


def decode(coded: DataFrame, ranks_path: str, pattern: str) -> DataFrame:
    """(doc_id, ids, text) of what ``encode`` returns."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decoder = coder(ranks_path, pattern)[1]
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                texts = ["".join(decoder.stream(np.frombuffer(i or b"", "<u4"))) for i in part.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), part.column(1), pa.array(texts, pa.string())], names=["doc_id", "ids", "text"])

    return coded.select("doc_id", "ids").mapInArrow(run, "doc_id long, ids binary, text string")


def digests(coded: DataFrame, ranks_path: str, pattern: str) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256) of what ``encode`` returns, decoding the ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, decoder = _decimals(ranks_path), coder(ranks_path, pattern)[1]
        for batch in batches:
            counts, ids_sha, text_sha = [], [], []
            for raw in batch.column(1).to_pylist():
                ids = np.frombuffer(raw or b"", "<u4")
                counts.append(len(ids))
                ids_sha.append(hashlib.sha256(" ".join(map(words.__getitem__, ids.tolist())).encode()).hexdigest())
                text = hashlib.sha256()
                for part in decoder.stream(ids):
                    text.update(part.encode())
                text_sha.append(text.hexdigest())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(counts, pa.int64()), pa.array(ids_sha, pa.string()),
                 pa.array(text_sha, pa.string())],
                names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return coded.select("doc_id", "ids").mapInArrow(
        run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


@lru_cache(maxsize=2)
def _decimals(ranks_path: str) -> list[str]:
    return [str(i) for i in range(max(read_ranks(ranks_path).values()) + 1)]
