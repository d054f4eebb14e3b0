"""Similarity join of documents on word n-grams: rare-first prefixes, length, positional and suffix filters."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from linetriage.llm.common import mixed, parts, runs, stored, summed_vector, whole_keys
from linetriage.llm.graph import components

SKETCH = 1 << 21  # counters of n-gram frequencies; collisions change the order, never the result
BINS = 32  # partitions of a set that the suffix filter compares
FULL = 65_535  # a partition of so many or more elements; two such partitions never rule a pair out
BLOCK = 2048  # classes under one n-gram that meet in one block
SHARED = ["gram", "id", "n", "place", "bins"]
STARS = 2  # rounds in which each n-gram's classes are compared with one of them only
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_ODD = 0xD6E8FEB86659FD93


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    with np.errstate(over="ignore"):
        up = np.cumprod(np.append(np.uint64(1), np.full(n - 1, _ODD, np.uint64)), dtype=np.uint64)
        down = np.cumprod(np.append(np.uint64(1), np.full(n - 1, pow(_ODD, -1, 1 << 64), np.uint64)), dtype=np.uint64)
    return up, down


def word_hashes(raw: bytes, powers: list) -> np.ndarray:
    """64-bit hashes of the words of a text, after lower-casing A to Z."""
    data = np.frombuffer(raw.lower(), np.uint8)
    if not len(data):
        return np.empty(0, np.uint64)
    if not powers or len(powers[0]) < len(data) + 1:
        powers[:] = _powers(max(1 << 16, 2 * len(data)))
    word = np.concatenate([[False], ~_SPACE[data], [False]])
    edge = np.flatnonzero(word[1:] != word[:-1])
    start, end = edge[::2], edge[1::2]
    with np.errstate(over="ignore"):
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum((data + np.uint64(1)) * powers[0][: len(data)])])
        return mixed((sums[end] - sums[start]) * powers[1][start] + (end - start).astype(np.uint64) * np.uint64(0xA0761D6478BD642F))


def shingles(raw: bytes, width: int, powers: list) -> np.ndarray:
    """The distinct hashes of ``width``-word shingles, ascending; of all words as one if there are fewer."""
    words = word_hashes(raw, powers)
    if not len(words):
        return words
    with np.errstate(over="ignore"):
        if len(words) < width:
            out = np.full(1, len(words), np.uint64)
            for w in words:
                out = mixed(out + w) * np.uint64(0xE7037ED1A0B428DB)
            return out
        n = len(words) - width + 1
        out = words[:n]
        for i in range(1, width):
            out = mixed(out) + words[i : i + n] * np.uint64(2 * i + 1)
    return np.unique(mixed(out))


def _digest(found: np.ndarray) -> tuple[int, int]:
    raw = hashlib.blake2b(found.tobytes(), digest_size=16).digest()
    return int.from_bytes(raw[:8], "little", signed=True), int.from_bytes(raw[8:], "little", signed=True)


def _texts(docs: DataFrame) -> DataFrame:
    return docs.selectExpr("cast(doc_id as long) doc_id", "cast(text as string) text")


def _sets(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[tuple]:
    powers: list = []
    for batch in batches:
        for at in range(0, batch.num_rows, 512):
            part = batch.slice(at, 512)
            for doc, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist()):
                yield doc, shingles((text or "").encode("utf-8", "surrogatepass"), width, powers)


def _batched(rows: Iterator[tuple], schema: pa.Schema, size: int = 2000) -> Iterator[pa.RecordBatch]:
    held: list[tuple] = []
    for row in rows:
        held.append(row)
        if len(held) >= size:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held), schema)], schema=schema)
            held = []
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held), schema)], schema=schema)


class Join:
    """Parameters of one join: shingle width and least Jaccard similarity as ``least`` of 100."""

    def __init__(self, width: int, least: int):
        self.width, self.least = width, least

    def prefix(self, n: int) -> int:
        """Elements of which two linked sets share at least one: all but the least overlap, plus one."""
        return n - -(-self.least * n // 100) + 1

    def overlap(self, a, b):
        """The least intersection with which sets of these sizes link."""
        return -(-self.least * (a + b) // (100 + self.least))

    # Passes over the texts

    def described(self, docs: DataFrame) -> DataFrame:
        """(doc_id, n, d1, d2, bins): size, digest and partition counts of every document's set."""
        schema = pa.schema([("doc_id", pa.int64()), ("n", pa.int32()), ("d1", pa.int64()), ("d2", pa.int64()), ("bins", pa.binary())])

        def rows(batches):
            for doc, found in _sets(batches, self.width):
                bins = np.bincount((found >> np.uint64(59)).astype(np.int64), minlength=BINS)
                yield (doc, len(found), *_digest(found), np.minimum(bins, FULL).astype("<u2").tobytes())

        return _texts(docs).mapInArrow(
            lambda b: _batched(rows(b), schema), "doc_id long, n int, d1 long, d2 long, bins binary")

    def frequencies(self, docs: DataFrame) -> np.ndarray:
        """Counts of all n-grams of all documents, by the low bits of their hashes."""

        def count(batches):
            sums, held, size = np.zeros(SKETCH, np.uint32), [], 0
            for _, found in _sets(batches, self.width):
                held.append((found & np.uint64(SKETCH - 1)).astype(np.int32))
                size += len(found)
                if size > 1 << 21:
                    sums += np.bincount(np.concatenate(held), minlength=SKETCH).astype(np.uint32)
                    held, size = [], 0
            if held:
                sums += np.bincount(np.concatenate(held), minlength=SKETCH).astype(np.uint32)
            yield sums

        return summed_vector(_texts(docs), count, SKETCH)

    def prefixes(self, docs: DataFrame, counts: np.ndarray) -> DataFrame:
        """(gram, d1, d2, n, place): the rarest n-grams of every set, each copy of a set once per task."""
        rank = docs.sparkSession.sparkContext.broadcast(np.minimum(np.round(8 * np.log2(1.0 + counts)), 255).astype(np.uint8))
        names = ["gram", "d1", "d2", "n", "place"]

        def run(batches):
            ranks, seen, held, size = rank.value, set(), [], 0
            for _, found in _sets(batches, self.width):
                n = len(found)
                if not n:
                    continue
                key = _digest(found)
                if key in seen:
                    continue
                if len(seen) > 200_000:
                    seen.clear()
                seen.add(key)
                first = self.prefix(n)
                order = np.lexsort((found, ranks[(found & np.uint64(SKETCH - 1)).astype(np.int64)]))[:first]
                held.append((found[order].view(np.int64), np.full(first, key[0]), np.full(first, key[1]),
                             np.full(first, n, np.int32), np.arange(first, dtype=np.int32)))
                size += first
                if size > 50_000:
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*held)], names=names)
                    held, size = [], 0
            if held:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*held)], names=names)

        return _texts(docs).mapInArrow(run, "gram long, d1 long, d2 long, n int, place int")

    def sets_of(self, docs: DataFrame, wanted: DataFrame) -> DataFrame:
        """(id, grams): the sets of the documents in ``wanted`` (id), found by a bit table of bounded size.

        The table lets a few others through; it is a filter only, as pairs are joined on ids later.
        """
        bits = 1 << min(27, max(16, int(np.ceil(np.log2(16 * max(1, wanted.count()))))))

        def slot(ids: np.ndarray) -> np.ndarray:
            return (mixed(ids.astype(np.int64).view(np.uint64)) & np.uint64(bits - 1)).astype(np.int64)

        def mark(batches):
            table = np.zeros(bits // 32, np.uint32)
            for batch in batches:
                at = slot(batch.column(0).to_numpy())
                np.bitwise_or.at(table, at >> 5, (np.uint32(1) << (at & 31).astype(np.uint32)))
            yield table

        table = docs.sparkSession.sparkContext.broadcast(summed_vector(wanted, mark, bits // 32, np.bitwise_or))
        schema = pa.schema([("id", pa.int64()), ("grams", pa.binary())])

        def chosen(batches):
            for batch in batches:
                ids = batch.column(0).to_numpy(zero_copy_only=False)
                known = np.array([i is not None and i == i for i in ids], bool)
                at = slot(np.where(known, ids, 0))
                keep = known & ((table.value[at >> 5] >> (at & 31).astype(np.uint32)) & 1).astype(bool)
                if keep.any():
                    yield batch.filter(pa.array(keep))

        return _texts(docs).mapInArrow(
            lambda b: _batched(((i, g.tobytes()) for i, g in _sets(chosen(b), self.width)), schema, 500), "id long, grams binary")

    # Candidates

    def shared(self, prefixes: DataFrame) -> DataFrame:
        """The rows of n-grams that at least two different sets have in their prefix, each set once."""

        def run(batches):
            last, pending, sent = None, None, False  # the latest set's row waits until its n-gram is seen again
            for batch in batches:
                if not batch.num_rows:
                    continue
                key = [batch.column(i).to_numpy() for i in range(3)]
                new = np.append(True, np.logical_or.reduce([k[1:] != k[:-1] for k in key]))
                new[0] = last != tuple(k[0] for k in key)
                last = tuple(k[-1] for k in key)
                rows = batch.filter(pa.array(new))
                if not rows.num_rows:
                    continue
                gram = rows.column(0).to_numpy()
                same = gram[1:] == gram[:-1]
                keep = np.append(False, same) | np.append(same, False)
                if pending is not None and pending.column(0)[0].as_py() == gram[0]:
                    keep[0] = True
                    if not sent:
                        yield pending
                pending, sent = rows.slice(rows.num_rows - 1), bool(keep[-1])
                yield rows.filter(pa.array(keep))

        return (
            prefixes.repartition(2 * parts(prefixes.sparkSession), "gram").sortWithinPartitions("gram", "d1", "d2")
            .mapInArrow(run, prefixes.schema)
        )

    def may_link(self, n1, n2, place1, place2, bins1: np.ndarray, bins2: np.ndarray):
        """Length, positional and suffix filters on arrays of candidate pairs."""
        least = self.overlap(n1, n2)
        small, large = np.minimum(n1, n2), np.maximum(n1, n2)
        ok = (100 * small >= self.least * large) & (np.minimum(n1 - place1, n2 - place2) >= least)
        some = np.flatnonzero(ok)
        common = np.minimum(bins1[some], bins2[some])
        ok[some] = (common.sum(axis=1, dtype=np.int64) >= least[some]) | (common == FULL).any(axis=1)
        return ok

    def blocked(self, shared: DataFrame) -> DataFrame:
        """Rows of each n-gram dealt to pairs of blocks of at most about ``BLOCK`` sets."""
        crowded = stored(shared.groupBy("gram").count().where(F.col("count") > BLOCK).select(
            "gram", F.ceil(F.col("count") / BLOCK).cast("int").alias("blocks")))
        rows = shared.join(crowded, "gram", "left").withColumn(
            "own", F.coalesce(F.pmod(F.xxhash64("id"), F.col("blocks")), F.lit(0)).cast("int"))
        return rows.withColumn(
            "other", F.explode(F.sequence(F.lit(0), F.coalesce(F.col("blocks"), F.lit(1)) - 1))
        ).withColumn("first", F.least("own", "other")).withColumn("second", F.greatest("own", "other")).drop("other", "blocks")

    def within_blocks(self, shared: DataFrame, pairs: bool) -> DataFrame:
        """Rows with a filter-passing partner under their n-gram, or (``pairs``) those pairs whose components differ."""

        def run(batches):
            keys = ["gram", "first", "second"]
            for whole in whole_keys(batches, keys):
                c = {k: whole.column(k).to_numpy() for k in [*keys, "own", "id", "n", "place", *["component"] * pairs]}
                bins = np.frombuffer(b"".join(whole.column("bins").to_pylist()), "<u2").reshape(-1, BINS)
                edges = runs(*(c[k] for k in keys))
                left, right, met = [], [], np.zeros(whole.num_rows, bool)
                for at, end in zip(edges[:-1], edges[1:]):
                    m = end - at
                    if m < 2:
                        continue
                    a, b = np.triu_indices(m, 1) if m <= 512 else (None, None)
                    for i in [None] if a is not None else range(m - 1):
                        x, y = (a, b) if i is None else (np.full(m - 1 - i, i), np.arange(i + 1, m))
                        x, y = x + at, y + at
                        ok = c["id"][x] != c["id"][y]
                        if c["first"][at] != c["second"][at]:
                            ok &= c["own"][x] != c["own"][y]
                        if pairs:
                            ok &= c["component"][x] != c["component"][y]
                        x, y = x[ok], y[ok]
                        ok = self.may_link(c["n"][x], c["n"][y], c["place"][x], c["place"][y], bins[x], bins[y])
                        if pairs:
                            left.append(c["id"][x[ok]])
                            right.append(c["id"][y[ok]])
                        else:
                            met[x[ok]] = met[y[ok]] = True
                if pairs and left:
                    a, b = np.concatenate(left), np.concatenate(right)
                    both = np.unique(np.column_stack([np.minimum(a, b), np.maximum(a, b)]), axis=0)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(both[:, 0].copy()), pa.array(both[:, 1].copy())], names=["a", "b"])
                elif met.any():
                    yield from whole.select(SHARED).filter(pa.array(met)).to_batches()

        keys = ["gram", "first", "second"]
        dealt = self.blocked(shared).repartition(2 * parts(shared.sparkSession), *keys).sortWithinPartitions(*keys)
        if pairs:
            return dealt.mapInArrow(run, "a long, b long").distinct()
        return dealt.mapInArrow(run, shared.select(*SHARED).schema)

    def stars(self, shared: DataFrame, turn: int) -> DataFrame:
        """(a, b): each set with one set of each of its n-grams (another one each turn), if filters let it."""
        order = F.col("id") if turn == 0 else F.xxhash64("id", F.lit(turn))
        lead = shared.groupBy("gram").agg(F.min(F.struct(
            order.alias("o"), "id", "n", "place", "bins", "component")).alias("lead"))
        pair = shared.join(lead, "gram").where("component <> lead.component").select(
            "id", "n", "place", "bins", F.col("lead.id").alias("id2"), F.col("lead.n").alias("n2"),
            F.col("lead.place").alias("place2"), F.col("lead.bins").alias("bins2"))

        def run(batches):
            for batch in batches:
                if not batch.num_rows:
                    continue
                c = {k: batch.column(k).to_numpy() for k in ("id", "n", "place", "id2", "n2", "place2")}
                one, two = (np.frombuffer(b"".join(batch.column(k).to_pylist()), "<u2").reshape(-1, BINS) for k in ("bins", "bins2"))
                ok = self.may_link(c["n"], c["n2"], c["place"], c["place2"], one, two)
                yield pa.RecordBatch.from_arrays([pa.array(c["id"][ok]), pa.array(c["id2"][ok])], names=["a", "b"])

        return pair.mapInArrow(run, "a long, b long").distinct()

    def verified(self, pairs: DataFrame, sets: DataFrame) -> DataFrame:
        """The pairs (a, b) that link, each compared once by its exact intersection."""

        def run(batches):
            for batch in batches:
                ok = []
                for x, y in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist()):
                    a, b = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
                    both = np.sort(np.concatenate([a, b]), kind="stable")
                    common = int((both[1:] == both[:-1]).sum())
                    ok.append(100 * common >= self.least * (len(both) - common))
                yield batch.select(["a", "b"]).filter(pa.array(ok, pa.bool_()))

        one = sets.select(F.col("id").alias("a"), F.col("grams").alias("grams_a"))
        two = sets.select(F.col("id").alias("b"), F.col("grams").alias("grams_b"))
        return pairs.join(one, "a").join(two, "b").select("a", "b", "grams_a", "grams_b").mapInArrow(run, "a long, b long")


def link(docs: DataFrame, width: int = 3, least: int = 90, stars: int = STARS) -> DataFrame:
    """(doc_id, n_shingles, component_id) of every row of ``docs`` (doc_id, text).

    Equal sets are one class, represented by its smallest doc_id. Classes whose prefixes share an n-gram
    and that pass the filters are compared. To join groups of thousands of near copies without all their
    pairs, the first rounds compare each class with one class per n-gram; then only pairs whose ends
    still lie in different components are compared, so no link between components is lost. An n-gram in
    more than ``BLOCK`` prefixes is cut into pairs of blocks.

    Null texts and texts without words have an empty set and link with nothing. A null doc_id has a null
    component. doc_id should be unique: rows that share one and differ in text may become one node.
    Repeated rows are copies like any others. Other columns are ignored; an empty table gives no rows.
    """
    join = Join(width, least)
    described = stored(join.described(docs))
    classes = stored(
        described.where("n > 0 and doc_id is not null").groupBy("d1", "d2", "n")
        .agg(F.min("doc_id").alias("id"), F.first("bins").alias("bins")))
    shared = stored(join.shared(join.prefixes(docs, join.frequencies(docs))))
    shared = stored(shared.join(classes.select("d1", "d2", "id", "bins"), ["d1", "d2"]).select(*SHARED))
    shared = stored(join.within_blocks(shared, False))
    sets = stored(join.sets_of(docs, shared.select("id").distinct()))
    links, tied = None, None
    for turn in range(stars + 1):
        if tied is None:
            now = shared.withColumn("component", F.col("id"))
        else:
            now = shared.join(tied, "id", "left").withColumn("component", F.coalesce("component_id", "id")).drop("component_id")
        pairs = stored(join.stars(now, turn) if turn < stars else join.within_blocks(now, True))
        if turn:  # few sets are still in question
            ends = pairs.select(F.col("a").alias("id")).union(pairs.select(F.col("b").alias("id"))).distinct()
            sets_now = sets.join(stored(ends), "id", "left_semi")
        else:
            sets_now = sets
        found = stored(join.verified(pairs, sets_now))
        if turn and found.isEmpty():
            continue
        links = found if links is None else links.union(found)
        tied = stored(components(links))
    named = classes.join(tied, "id", "left").select(
        "d1", "d2", F.coalesce("component_id", "id").alias("component"))
    own = described.join(named, ["d1", "d2"], "left")
    by_doc: Column = F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "doc_id"))
    return own.select("doc_id", F.col("n").cast("long").alias("n_shingles"), by_doc.alias("component_id"))
