"""Near copies among embeddings: sign hashes in several tables, exact cosine, connected components."""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from linetriage.llm.common import parts, runs, stored, whole_keys
from linetriage.llm.graph import components

BLOCK = 2048  # vectors of one bucket that meet in one block; larger buckets are cut into pairs of blocks
MISS = 1e-5  # chance that a pair of exactly the least cosine shares no table


def table_plan(vectors: int, cosine: float, miss: float = MISS) -> tuple[int, int]:
    """Bits and tables: about eight unrelated vectors a bucket, and tables for the wanted chance of a miss."""
    bits = max(8, math.ceil(math.log2(max(vectors, 1) / 8)))
    same = (1 - math.acos(cosine) / math.pi) ** bits
    return bits, math.ceil(math.log(miss) / math.log(1 - same))


def planes(width: int, bits: int, tables: int) -> np.ndarray:
    return np.random.default_rng([20, width]).standard_normal((width, tables * bits))


def signatures(unit: np.ndarray, bits: int, tables: int) -> np.ndarray:
    """(rows, tables) of bit strings of signs."""
    signs = (unit @ planes(unit.shape[1], bits, tables) > 0).reshape(len(unit), tables, bits)
    return signs.astype(np.int64) @ (1 << np.arange(bits, dtype=np.int64))


def unit_rows(raw: list[bytes]) -> np.ndarray:
    rows = np.frombuffer(b"".join(raw), "<f8").reshape(len(raw), -1)
    rows = rows / np.abs(rows).max(axis=1, keepdims=True)
    return rows / np.sqrt((rows * rows).sum(axis=1, keepdims=True))


def _keyed(vectors: DataFrame) -> DataFrame:
    """(vec_id, key, vector): a digest and the components as doubles; null where a vector links with nothing."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, raw = [], []
            for values in batch.column(1).to_pylist():
                usable = bool(values) and all(v is not None and math.isfinite(v) for v in values) and any(values)
                raw.append(np.array(values, "<f8").tobytes() if usable else None)
                keys.append(hashlib.blake2b(raw[-1], digest_size=16).digest() if usable else None)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(keys, pa.binary()), pa.array(raw, pa.binary())],
                names=["vec_id", "key", "vector"])

    return vectors.selectExpr("cast(vec_id as long) vec_id", "cast(embedding as array<double>) embedding").mapInArrow(
        run, "vec_id long, key binary, vector binary")


def _in_tables(classes: DataFrame, bits: int, tables: int, with_vector: bool) -> DataFrame:
    """One row per class and table: (width, slot, bucket, id) and, if wanted, weight and vector."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw, ids = batch.column(2).to_pylist(), batch.column(0).to_numpy()
            widths = np.array([len(r) // 8 for r in raw])
            for width in np.unique(widths).tolist():
                mine = np.flatnonzero(widths == width)
                for at in range(0, len(mine), 256):
                    rows = mine[at : at + 256]
                    buckets = signatures(unit_rows([raw[i] for i in rows]), bits, tables)
                    take = pa.array(np.repeat(rows, tables))
                    out = [pa.array(np.full(buckets.size, width, np.int32)),
                           pa.array(np.tile(np.arange(tables, dtype=np.int32), len(rows))), pa.array(buckets.ravel())]
                    names = ["width", "slot", "bucket"]
                    if with_vector:
                        out += [pa.array(np.repeat(ids[rows], tables)), batch.column(1).take(take), batch.column(2).take(take)]
                        names += ["id", "weight", "vector"]
                    yield pa.RecordBatch.from_arrays(out, names=names)

    schema = "width int, slot int, bucket long"
    return classes.select("id", "weight", "vector").mapInArrow(
        run, f"{schema}, id long, weight long, vector binary" if with_vector else schema)


def _found(bits: int, tables: int, cosine: float):
    """Links of whole block pairs: per vector the linked weight not counted in an earlier table, and a root."""

    def pairs(unit: np.ndarray, weight: np.ndarray, own: np.ndarray, slot: int, first: int, second: int):
        adjacent = unit @ unit.T >= cosine
        np.fill_diagonal(adjacent, False)
        if first != second:
            adjacent &= own[:, None] != own[None, :]
        a, b = np.nonzero(adjacent)
        if not len(a):
            return None
        label = np.arange(len(unit))
        while True:
            low = label.copy()
            np.minimum.at(low, a, label[b])
            low = low[low]
            if (low == label).all():
                break
            label = low
        if slot:
            some = np.unique(a)
            place = np.zeros(len(unit), np.int64)
            place[some] = np.arange(len(some))
            sign = signatures(unit[some], bits, tables)[:, :slot]
            fresh = np.concatenate([
                ~(sign[place[a[i : i + 65536]]] == sign[place[b[i : i + 65536]]]).any(axis=1)
                for i in range(0, len(a), 65536)])
            a, b = a[fresh], b[fresh]
        return np.bincount(a, weights=weight[b], minlength=len(unit)).astype(np.int64), label

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys = ["width", "slot", "bucket", "first", "second"]
        for whole in whole_keys(batches, keys):
            columns = {k: whole.column(k).to_numpy() for k in [*keys, "own", "id", "weight"]}
            vectors = whole.column("vector").to_pylist()
            edges = runs(*(columns[k] for k in keys))
            ids, links, roots = [], [], []
            for at, end in zip(edges[:-1], edges[1:]):
                if end - at < 2:
                    continue
                part = {k: c[at:end] for k, c in columns.items()}
                found = pairs(unit_rows(vectors[at:end]), part["weight"], part["own"], int(part["slot"][0]),
                              int(part["first"][0]), int(part["second"][0]))
                if found is None:
                    continue
                count, label = found
                some = np.flatnonzero((count > 0) | (label != np.arange(len(label))))
                ids.append(part["id"][some])
                links.append(count[some])
                roots.append(part["id"][label[some]])
            if ids:
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.concatenate(x)) for x in (ids, links, roots)], names=["id", "links", "root"])

    return run


def near_copies(vectors: DataFrame, cosine: float = 0.95, miss: float = MISS, block: int = BLOCK) -> DataFrame:
    """(vec_id, n_links, component_id, kept) of every row of ``vectors`` (vec_id, embedding).

    Equal vectors are one class with a weight, so a group of exact copies meets once. A class is dealt to
    one bucket per table by the signs of random projections; all pairs in a bucket are compared by exact
    cosine inside the task and only counts and one root per vector leave it. A pair is counted in the
    first table it shares. A bucket of more than ``block`` classes is cut into blocks, and each pair of
    blocks is its own group, so no task holds more than two blocks of a bucket.

    Null, empty or zero vectors and ones with null or non-finite components have no links and are kept;
    vectors of different length never link. A null vec_id has a null component and is not kept. Rows
    that repeat a vec_id are one node for components, and each row counts as a link of its copies. Other
    columns are ignored; an empty table gives no rows.
    """
    keyed = stored(_keyed(vectors))
    classes = stored(
        keyed.where("key is not null and vec_id is not null").groupBy("key")
        .agg(F.min("vec_id").alias("id"), F.count("*").alias("weight"), F.first("vector").alias("vector"))
    )
    bits, tables = table_plan(classes.count(), cosine, miss)
    keys = ["width", "slot", "bucket"]
    crowded = stored(
        _in_tables(classes, bits, tables, False).groupBy(*keys).count().where(F.col("count") > block)
        .select(*keys, F.ceil(F.col("count") / block).cast("int").alias("blocks"))
    )
    rows = _in_tables(classes, bits, tables, True).join(crowded, keys, "left")
    own = F.coalesce(F.pmod(F.xxhash64("id"), F.col("blocks")), F.lit(0)).cast("int")
    rows = (
        rows.withColumn("own", own)
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.coalesce(F.col("blocks"), F.lit(1)) - 1)))
        .select(*keys, F.least("own", "other").alias("first"), F.greatest("own", "other").alias("second"), "own",
                "id", "weight", "vector")
    )
    order = [*keys, "first", "second"]
    found = stored(
        rows.repartition(2 * parts(rows.sparkSession), *order).sortWithinPartitions(*order)
        .mapInArrow(_found(bits, tables, cosine), "id long, links long, root long")
    )
    links = found.groupBy("id").agg(F.sum("links").alias("links"))
    tied = components(found.select(F.col("id").alias("a"), F.col("root").alias("b")))
    known = (
        classes.select("key", "id", "weight").join(links, "id", "left").join(tied, "id", "left")
        .select("key", (F.coalesce("links", F.lit(0)) + F.col("weight") - 1).alias("links"),
                F.coalesce("component_id", "id").alias("component"))
    )
    component = F.coalesce("component", "vec_id")
    return keyed.select("vec_id", "key").join(known, "key", "left").select(
        "vec_id", F.when(F.col("vec_id").isNull(), 0).otherwise(F.coalesce("links", F.lit(0))).cast("long").alias("n_links"),
        F.when(F.col("vec_id").isNotNull(), component).alias("component_id"),
        F.coalesce(F.col("vec_id") == component, F.lit(False)).alias("kept"))
