"""Alignment of two tokenizers on the bytes of documents: an associative fragment monoid and corpus-wide pair counts.

A fragment is what is known about a stretch of a document without its surroundings: tokens before the first
byte where tokens of both kinds end together, the closed groups after it, and tokens behind the last such
byte. Joining two fragments only looks at the open end of the one and the open start of the other, and any
bracketing gives the same fragment, so chunks of a long document are aligned by many tasks and joined as a tree.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window, functions as F

from linetriage.llm.common import stored, texts_of

CHUNK = 1 << 16  # bytes of a document that one fragment covers
FAN_IN = 8  # fragments that one step of the tree joins
BLOCK_LINKS = 1 << 19  # a block of documents is closed at this many links,
BLOCK_ENTRIES = 1 << 18  # this many pairs that are different within a document,
BLOCK_DOCS = 4096  # or this many documents
SLICE = 64  # documents tokenized in one call
PART = 1 << 17  # characters of a text that are tokenized at once
_BETWEEN_WORDS = re.compile(r"(?<=[A-Za-z.]) (?=[A-Za-z])")
_NONE = np.zeros(0, np.int64)


def _byte_level() -> dict[str, int]:
    """The letters by which byte-level vocabularies write bytes: printable ones as themselves, the rest from U+0100."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(others)}


class Tokenizers:
    """Both tokenizers with the bytes of each of their tokens.

    The byte-level file's ids are the ranks of its merges, which the faster of the two libraries that know
    this kind takes directly; tests compare its ids with the other's on every code point.
    """

    def __init__(self, byte_file: str, piece_file: str, pattern: str):
        import sentencepiece
        import tiktoken

        with open(byte_file, encoding="utf-8") as file:
            content = json.load(file)
        special = {t["content"] for t in content["added_tokens"]}
        letters = _byte_level()
        ranks = {
            bytes(letters[c] for c in token): i for token, i in content["model"]["vocab"].items() if token not in special}
        self.first = tiktoken.Encoding("bytes", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self.second = sentencepiece.SentencePieceProcessor(model_file=piece_file)
        self.a_bytes = [b""] * (max(ranks.values()) + 1)
        for token, i in ranks.items():
            self.a_bytes[i] = token
        self.b_bytes = [
            bytes([int(p[3:5], 16)]) if self.second.is_byte(i) else p.replace("▁", " ").encode()
            for i, p in enumerate(map(self.second.id_to_piece, range(self.second.get_piece_size())))]
        self.parted = not any(b" " in b.lstrip(b" ") for b in self.b_bytes)
        if max(len(self.a_bytes), len(self.b_bytes)) > 1 << 16:
            raise ValueError("a pair of ids has to fit into 32 bits")
        self.a_length = np.array([len(b) for b in self.a_bytes], np.int64)
        self.b_length = np.array([len(b) for b in self.b_bytes], np.int64)
        self.decimal = np.array([str(i) for i in range(max(len(self.a_bytes), len(self.b_bytes)))], object)

    def ids(self, texts: Sequence[str]) -> Iterator[tuple[str, list[int], list[int]]]:
        """Each text with its ids of both kinds; long texts are tokenized in parts that no token can cross.

        Neither kind has a token, nor the pattern a match, with a space behind a letter or a full stop.
        """
        for text, b in zip(texts, self.second.encode([t if len(t) <= PART else "" for t in texts], num_threads=1)):
            if len(text) <= PART:
                yield text, self.first.encode_ordinary(f" {text}") if text else [], b
                continue
            a, b, at = [], [], 0
            while at < len(text):
                cut = _BETWEEN_WORDS.search(text, at + PART) if self.parted else None
                stop = cut.start() if cut else len(text)
                a += self.first.encode_ordinary(f" {text[at:stop]}")
                b += self.second.encode(text[at:stop], num_threads=1)
                at = stop + 1
            yield text, a, b

    def encode(self, texts: Sequence[str]) -> list[tuple[np.ndarray, np.ndarray]]:
        """Ids of both kinds per text; none where either's bytes are not a space and the text."""
        out = []
        for text, a, b in self.ids(texts):
            want = f" {text}".encode()
            same = text and b"".join(map(self.a_bytes.__getitem__, a)) == want
            if same and b"".join(map(self.b_bytes.__getitem__, b)) == want:
                out.append((np.array(a, np.int64), np.array(b, np.int64)))
            else:
                out.append((_NONE, _NONE))
        return out


@lru_cache(maxsize=2)
def tokenizers(byte_file: str, piece_file: str, pattern: str) -> Tokenizers:
    return Tokenizers(byte_file, piece_file, pattern)


@dataclass
class Run:
    """Tokens of both kinds in a row, and the byte of the document where the first of each kind starts."""

    a: np.ndarray
    b: np.ndarray
    a_start: int = 0
    b_start: int = 0

    def __add__(self, other: Run) -> Run:
        return Run(
            np.concatenate([self.a, other.a]), np.concatenate([self.b, other.b]),
            self.a_start if len(self.a) else other.a_start, self.b_start if len(self.b) else other.b_start)

    def part(self, a: slice, b: slice, ends_a: np.ndarray, ends_b: np.ndarray) -> Run:
        start_a = ends_a[a.start - 1] if a.start else self.a_start
        start_b = ends_b[b.start - 1] if b.start else self.b_start
        return Run(self.a[a], self.b[b], int(start_a), int(start_b))


@dataclass
class Fragment:
    """``head`` alone if no byte of the stretch ends tokens of both kinds, else head, closed groups and tail."""

    head: Run
    tail: Run | None
    groups: int
    pairs: np.ndarray  # a << 16 | b of every overlapping pair in the closed groups
    text: bytes  # the closed groups in writing, each ended by a semicolon


class Aligner:
    """Makes and joins fragments for one pair of tokenizers."""

    def __init__(self, kinds: Tokenizers):
        self.kinds = kinds

    def ends(self, run: Run) -> tuple[np.ndarray, np.ndarray]:
        ends_a, ends_b = np.cumsum(self.kinds.a_length[run.a]), np.cumsum(self.kinds.b_length[run.b])
        return run.a_start + ends_a, run.b_start + ends_b

    def closed(self, a: np.ndarray, b: np.ndarray) -> tuple[int, np.ndarray, bytes]:
        """Number of groups, overlapping pairs and writing of tokens that start and end together.

        Between two neighbouring token ends lies one stretch of one token of each kind, and two tokens overlap
        in one such stretch, so the stretches are the overlapping pairs.
        """
        if not len(a):
            return 0, _NONE, b""
        ends_a, ends_b = self.ends(Run(a, b))
        cuts = np.intersect1d(ends_a, ends_b, assume_unique=True)
        ends = np.union1d(ends_a, ends_b)
        pairs = a[np.searchsorted(ends_a, ends)] << 16 | b[np.searchsorted(ends_b, ends)]
        group_a, group_b = np.searchsorted(cuts, ends_a), np.searchsorted(cuts, ends_b)
        upto_a, upto_b = np.searchsorted(ends_a, cuts, "right"), np.searchsorted(ends_b, cuts, "right")
        at_a = np.arange(len(a)) + np.append(0, upto_b)[group_a]
        at_b = np.arange(len(b)) + upto_a[group_b]
        words = np.empty(2 * (len(a) + len(b)), object)
        words[2 * at_a], words[2 * at_b] = self.kinds.decimal[a], self.kinds.decimal[b]
        words[1::2] = ","
        words[2 * at_a[upto_a - 1] + 1] = "|"
        words[2 * at_b[upto_b - 1] + 1] = ";"
        return len(cuts), pairs, "".join(words.tolist()).encode()

    def split(self, run: Run) -> Fragment:
        """The fragment of a run of tokens."""
        ends_a, ends_b = self.ends(run)
        cuts = np.intersect1d(ends_a, ends_b, assume_unique=True)
        if not len(cuts):
            return Fragment(run, None, 0, _NONE, b"")
        (a0, a1), (b0, b1) = (np.searchsorted(e, [cuts[0], cuts[-1]], "right") for e in (ends_a, ends_b))
        head = run.part(slice(0, a0), slice(0, b0), ends_a, ends_b)
        tail = run.part(slice(a1, None), slice(b1, None), ends_a, ends_b)
        return Fragment(head, tail, *self.closed(run.a[a0:a1], run.b[b0:b1]))

    def join(self, left: Fragment, right: Fragment) -> Fragment:
        for one, other in ((left, right), (right, left)):
            if one.tail is None and not len(one.head.a) and not len(one.head.b):
                return other  # a stretch without tokens, also beside a whole document
        middle = self.split((left.head if left.tail is None else left.tail) + right.head)
        head, groups, pairs, text = middle.head, middle.groups, [middle.pairs], middle.text
        if left.tail is not None:
            # What is open before the middle's first cut starts at the left one's last: a closed group.
            head = left.head
            pairs.insert(0, left.pairs)
            if middle.tail is None:
                text, tail = left.text, middle.head
                groups = left.groups
            else:
                n, own, written = self.closed(middle.head.a, middle.head.b)
                pairs.insert(1, own)
                groups, text, tail = left.groups + n + groups, left.text + written + text, middle.tail
        else:
            tail = middle.tail
        if right.tail is None:
            return Fragment(head, tail, groups, np.concatenate(pairs), text)
        if tail is None or len(tail.a) or len(tail.b):
            raise ValueError("tokens of the two kinds do not cover the same bytes")
        pairs.append(right.pairs)
        return Fragment(head, right.tail, groups + right.groups, np.concatenate(pairs), text + right.text)

    def whole(self, fragment: Fragment) -> Fragment:
        """The fragment of a whole document, which starts and ends tokens of both kinds: nothing stays open."""
        open_end = fragment.tail
        if open_end is None or len(open_end.a) or len(open_end.b):
            raise ValueError("a document does not end with its tokens")
        groups, pairs, text = self.closed(fragment.head.a, fragment.head.b)
        return Fragment(
            Run(_NONE, _NONE), Run(_NONE, _NONE), groups + fragment.groups, np.concatenate([pairs, fragment.pairs]),
            text + fragment.text)

    def chunks(self, run: Run, size: int) -> Iterator[tuple[int, Run]]:
        """The tokens of a document by the range of ``size`` bytes in which they start."""
        ends_a, ends_b = self.ends(run)
        starts_a, starts_b = ends_a - self.kinds.a_length[run.a], ends_b - self.kinds.b_length[run.b]
        for i in range(-(-int(ends_a[-1]) // size)):
            (a0, a1), (b0, b1) = (np.searchsorted(s, [i * size, (i + 1) * size]) for s in (starts_a, starts_b))
            if a1 > a0 or b1 > b0:
                yield i, run.part(slice(int(a0), int(a1)), slice(int(b0), int(b1)), ends_a, ends_b)


_DOC = pa.struct([
    ("doc_id", pa.int64()), ("n_a", pa.int64()), ("n_b", pa.int64()), ("n_groups", pa.int64()), ("n_links", pa.int64()),
    ("groups", pa.binary()), ("entries", pa.int64())])
_BLOCK = pa.schema([
    ("block", pa.int64()), ("pairs", pa.list_(pa.int64())), ("times", pa.list_(pa.int64())), ("docs", pa.list_(_DOC)),
    ("packed", pa.binary())])
_CHUNK = pa.schema([
    ("row", pa.int64()), ("doc_id", pa.int64()), ("n_a", pa.int64()), ("n_b", pa.int64()), ("chunk", pa.int64()),
    ("a", pa.binary()), ("b", pa.binary()), ("a_start", pa.int64()), ("b_start", pa.int64())])
_BOTH = pa.schema([*_BLOCK, *_CHUNK])
_FRAGMENT = pa.schema([
    *[_CHUNK.field(n) for n in ("row", "doc_id", "n_a", "n_b", "chunk")],
    ("head_a", pa.binary()), ("head_b", pa.binary()), ("head_a_start", pa.int64()), ("head_b_start", pa.int64()),
    ("cut", pa.bool_()),
    ("tail_a", pa.binary()), ("tail_b", pa.binary()), ("tail_a_start", pa.int64()), ("tail_b_start", pa.int64()),
    ("groups", pa.int64()), ("pairs", pa.binary()), ("text", pa.binary())])
_BLOCK_DDL = (
    "block long, pairs array<long>, times array<long>, docs array<struct<doc_id:long,n_a:long,n_b:long,n_groups:long,"
    "n_links:long,groups:binary,entries:long>>, packed binary")
_CHUNK_DDL = "row long, doc_id long, n_a long, n_b long, chunk long, a binary, b binary, a_start long, b_start long"
_FRAGMENT_DDL = (
    "row long, doc_id long, n_a long, n_b long, chunk long, head_a binary, head_b binary, head_a_start long, head_b_start long, "
    "cut boolean, tail_a binary, tail_b binary, tail_a_start long, tail_b_start long, groups long, pairs binary, text binary")
SCHEMA = (
    "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string, "
    "groups binary")


def _ids(raw: bytes) -> np.ndarray:
    return np.frombuffer(raw, "<u2").astype(np.int64)


def _raw(ids: np.ndarray) -> bytes:
    return ids.astype("<u2").tobytes()


def _batch(rows: list[dict], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_pylist(rows, schema=schema)


def _planes(numbers: np.ndarray) -> bytes:
    """Unsigned 32-bit numbers by significance of their bytes, compressed."""
    planes = numbers.astype("<u4").view(np.uint8).reshape(-1, 4).T
    return zstandard.ZstdCompressor(level=1).compress(planes.tobytes())


def _numbers(raw: bytes) -> np.ndarray:
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(raw), np.uint8).reshape(4, -1)
    return np.ascontiguousarray(planes.T).view("<u4").ravel().astype(np.int64)


class Blocks:
    """Gathers documents into blocks, in which every different pair of ids stands once."""

    def __init__(self, first: int, keep_groups: bool):
        self.block, self.keep_groups = first, keep_groups
        self.docs: list[dict] = []
        self.parts: list[tuple[np.ndarray, np.ndarray]] = []
        self.links = self.entries = 0

    def add(self, doc_id, n_a: int, n_b: int, done: Fragment) -> None:
        pairs, times = np.unique(done.pairs, return_counts=True)
        self.parts.append((pairs, times))
        self.docs.append({
            "doc_id": doc_id, "n_a": n_a, "n_b": n_b, "n_groups": done.groups, "n_links": len(done.pairs),
            "groups": done.text[:-1] if self.keep_groups else hashlib.sha256(done.text[:-1]).digest() if n_a else b"",
            "entries": len(pairs)})
        self.links += len(done.pairs)
        self.entries += len(pairs)

    def full(self) -> bool:
        return self.links >= BLOCK_LINKS or self.entries >= BLOCK_ENTRIES or len(self.docs) >= BLOCK_DOCS

    def close(self) -> dict:
        pairs = np.concatenate([p for p, _ in self.parts])
        times = np.concatenate([t for _, t in self.parts])
        every, at = np.unique(pairs, return_inverse=True)
        packed = _planes(np.append(np.diff(at, prepend=0) % (1 << 32), times))
        row = {
            "block": self.block, "pairs": every, "times": np.bincount(at, times, len(every)).astype(np.int64),
            "docs": self.docs, "packed": packed}
        self.__init__(self.block + 1, self.keep_groups)
        return row


def _fragment_row(keys: dict, f: Fragment) -> dict:
    tail = f.tail or Run(_NONE, _NONE)
    return keys | {
        "head_a": _raw(f.head.a), "head_b": _raw(f.head.b), "head_a_start": f.head.a_start, "head_b_start": f.head.b_start,
        "cut": f.tail is not None, "tail_a": _raw(tail.a), "tail_b": _raw(tail.b), "tail_a_start": tail.a_start,
        "tail_b_start": tail.b_start, "groups": f.groups, "pairs": f.pairs.astype("<u4").tobytes(), "text": f.text}


def _fragment_of(row: dict) -> Fragment:
    head = Run(_ids(row["head_a"]), _ids(row["head_b"]), row["head_a_start"], row["head_b_start"])
    tail = Run(_ids(row["tail_a"]), _ids(row["tail_b"]), row["tail_a_start"], row["tail_b_start"])
    pairs = np.frombuffer(row["pairs"], "<u4").astype(np.int64)
    return Fragment(head, tail if row["cut"] else None, row["groups"], pairs, row["text"])


def align(
    docs: DataFrame, byte_file: str, piece_file: str, pattern: str, chunk: int = CHUNK, keep_groups: bool = False,
) -> DataFrame:
    """Align two tokenizations of every document of ``docs`` (doc_id, text) and count id pairs over all of them.

    A is the byte-level tokenizer on a space and the text, B the piece tokenizer on the text (it adds that
    space itself). Groups are cut where tokens of both end at one byte; links are pairs of overlapping tokens;
    ``n_best`` are links whose pair is linked as often, over all documents, as any pair of its B id, and
    ``count_sum`` adds up those numbers over the links. ``groups`` holds the groups in writing if
    ``keep_groups``. Texts that are null, empty or not given back by both tokenizers have no tokens: zeros.
    A null doc_id is carried along; repeated rows are aligned, counted and returned each; other columns are
    ignored; an empty table gives no rows.

    Each task tokenizes its documents and packs them into blocks, whose different pairs are counted once each;
    a pair thus reaches any task at most once per block, however often it occurs. Documents over ``chunk``
    bytes are dealt out as ranges of bytes, aligned as fragments and joined ``FAN_IN`` at a time.
    """

    def kinds() -> Tokenizers:
        return tokenizers(byte_file, piece_file, pattern)

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        start = TaskContext.get().partitionId() << 33
        aligner, blocks, row = Aligner(kinds()), Blocks(start, keep_groups), start
        for batch in batches:
            for at in range(0, batch.num_rows, SLICE):
                part = batch.slice(at, SLICE)
                for doc_id, (a, b) in zip(part.column(0).to_pylist(), aligner.kinds.encode(texts_of(part.column(1)))):
                    if len(a) and int(aligner.kinds.a_length[a].sum()) > chunk:
                        keys = {"row": row, "doc_id": doc_id, "n_a": len(a), "n_b": len(b)}
                        row += 1
                        for i, run in aligner.chunks(Run(a, b), chunk):
                            yield _batch([keys | {
                                "chunk": i, "a": _raw(run.a), "b": _raw(run.b), "a_start": run.a_start,
                                "b_start": run.b_start}], _BOTH)
                        continue
                    blocks.add(doc_id, len(a), len(b), Fragment(Run(_NONE, _NONE), None, *aligner.closed(a, b)))
                    if blocks.full():
                        yield _batch([blocks.close()], _BOTH)
        if blocks.docs:
            yield _batch([blocks.close()], _BOTH)

    def fragments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        aligner = Aligner(kinds())
        for batch in batches:
            for row in batch.to_pylist():
                run = Run(_ids(row.pop("a")), _ids(row.pop("b")), row.pop("a_start"), row.pop("b_start"))
                yield _batch([_fragment_row(row, aligner.split(run))], _FRAGMENT)

    def join_all(table: pa.Table) -> pa.Table:
        aligner = Aligner(kinds())
        rows = sorted(table.select(_FRAGMENT.names).to_pylist(), key=lambda r: r["chunk"])
        joined = _fragment_of(rows[0])
        for row in rows[1:]:
            joined = aligner.join(joined, _fragment_of(row))
        keys = {n: rows[0][n] for n in ("row", "doc_id", "n_a", "n_b")} | {"chunk": rows[0]["chunk"] // FAN_IN}
        return pa.Table.from_batches([_batch([_fragment_row(keys, joined)], _FRAGMENT)])

    def finished(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        aligner, blocks = Aligner(kinds()), Blocks(-(TaskContext.get().partitionId() + 1) << 33, keep_groups)
        for batch in batches:
            for row in batch.to_pylist():
                blocks.add(row["doc_id"], row["n_a"], row["n_b"], aligner.whole(_fragment_of(row)))
                if blocks.full():
                    yield _batch([blocks.close()], _BLOCK)
        if blocks.docs:
            yield _batch([blocks.close()], _BLOCK)

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                one = {n: batch.column(n)[i] for n in batch.schema.names}
                yield _sums(one, keep_groups)

    source = docs.selectExpr("cast(doc_id as long) doc_id", "cast(text as string) text")
    made = stored(source.mapInArrow(first, f"{_BLOCK_DDL}, {_CHUNK_DDL}"))
    blocks = made.where("block is not null").select(*_BLOCK.names)
    chunks = made.where("chunk is not null").select(*_CHUNK.names)
    last = chunks.agg(F.max("chunk")).first()[0]
    if last is not None:
        parted = stored(chunks.repartition("row", "chunk").mapInArrow(fragments, _FRAGMENT_DDL))
        while last > 0:
            step = parted.groupBy("row", F.expr(f"chunk div {FAN_IN}").alias("up")).applyInArrow(join_all, _FRAGMENT_DDL)
            parted = stored(step)
            last //= FAN_IN
        blocks = stored(blocks.unionByName(parted.mapInArrow(finished, _BLOCK_DDL)))

    sent = blocks.select(F.explode(F.arrays_zip("pairs", "times")).alias("p")).select("p.pairs", "p.times")
    totals = sent.groupBy(F.col("pairs").alias("pair")).agg(F.sum("times").alias("total"))
    same_b = Window.partitionBy(F.expr("pair & 65535"))  # no more rows than there are A ids
    marked = totals.withColumn("best", F.col("total") == F.max("total").over(same_b))
    asked = blocks.select("block", F.posexplode("pairs").alias("at", "pair"))
    answers = asked.join(marked, "pair").groupBy("block").agg(
        F.sort_array(F.collect_list(F.struct("at", "total", "best"))).alias("answers"))
    full = blocks.select("block", "docs", "packed").join(answers, "block", "left").select(
        "docs", "packed", F.col("answers.total").alias("totals"), F.col("answers.best").alias("bests"))
    return full.mapInArrow(counted, SCHEMA)


def _sums(one: dict[str, pa.Scalar], keep_groups: bool) -> pa.RecordBatch:
    """Per document of a block: counts of its links, from the answers to the block's pairs."""
    docs = pa.RecordBatch.from_struct_array(one["docs"].values)
    sizes = docs.column("entries").to_numpy()
    numbers = _numbers(one["packed"].as_py())
    half = len(numbers) // 2
    at, times = np.cumsum(numbers[:half]) % (1 << 32), numbers[half:]
    if half:
        totals = one["totals"].values.to_numpy()[at]
        bests = one["bests"].values.to_numpy(zero_copy_only=False)[at]
    else:
        totals, bests = _NONE, _NONE
    stops = np.cumsum(sizes)

    def per_doc(values: np.ndarray) -> np.ndarray:
        sums = np.append(0, np.cumsum(values))
        return sums[stops] - sums[stops - sizes]

    groups = docs.column("groups").to_pylist()
    has = (docs.column("n_a").to_numpy() > 0).tolist()
    digests = [
        ("" if not h else hashlib.sha256(g).hexdigest() if keep_groups else g.hex()) for g, h in zip(groups, has)]
    return pa.RecordBatch.from_arrays([
        *[docs.column(n) for n in ("doc_id", "n_a", "n_b", "n_groups", "n_links")],
        pa.array(per_doc(times * bests), pa.int64()), pa.array(per_doc(times * totals), pa.int64()),
        pa.array(digests, pa.string()), pa.array(groups if keep_groups else [None] * len(groups), pa.binary())],
        names=["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256", "groups"])
