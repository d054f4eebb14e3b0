"""Weights of all draws of a group as one value, and ranking metrics of all draws from tiles of ordered rows.

A group's weights in draws ``first`` .. ``first + count - 1`` are one binary: the bit planes of the numbers, lowest
first, ``ceil(count / 8)`` bytes a plane. A tile is one bucket of the row order (score descending, segment, row id) of
one table of scores. It gets its rows and the weights of its groups; what stands before it comes from sums per tile.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from hashlib import md5

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, functions as F

from linetriage.functions.columns import ratio
from linetriage.operators.budget import ALL
from linetriage.operators.ordering import BUCKETS, Cuts, find_cuts, with_buckets
from linetriage.session import bucket_count, cut_lineage

BLOCK = 64  # draws whose weights are numbers at a time; a multiple of 8
RANGE = 4096  # groups that are counted together
UNIT = 256  # draws that are hashed together for a range of slots; even
TILE_ROWS = 250_000
SPAN = 256  # rows between two running sums: with weights below 2 ** 16 their sums are exact in 32 bits
CHUNK = 8192

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # executors need not have this package


@dataclass(frozen=True)
class Picks:
    """One row per group: ``link`` (see ``link_key``) and ``picks``, its weights in all draws."""

    table: DataFrame
    first: int
    count: int


def link_key(columns: Sequence[str]) -> Column:
    """One text per combination of values; null where one of them is."""
    texts = [F.col(c).cast("string") for c in columns]
    return F.concat(*[x for t in texts for x in (F.length(t).cast("string"), F.lit(":"), t)])


def packed(weights: np.ndarray) -> list[bytes]:
    """Bit planes of each row of whole numbers, without the empty ones above the last."""
    top = weights.max(axis=1, initial=1)
    need = np.array([int(t).bit_length() for t in top])
    planes = np.stack([np.packbits((weights >> j & 1).astype(np.uint8), axis=1) for j in range(max(need, default=1))], axis=1)
    return [planes[i, :n].tobytes() for i, n in enumerate(need)]


def planes_of(picks: Sequence[bytes], count: int) -> np.ndarray:
    """Bit planes of many groups as one array (group, plane, byte)."""
    width = -(-count // 8)
    sizes = np.array([len(p) for p in picks])
    out = np.zeros((len(picks), max(sizes, default=width) // width, width), np.uint8)
    for size in np.unique(sizes):
        at = np.flatnonzero(sizes == size)
        out[at, : size // width] = np.frombuffer(b"".join([picks[i] for i in at]), np.uint8).reshape(len(at), -1, width)
    return out


def block_weights(planes: np.ndarray, first: int, count: int, kind: type = np.float64) -> np.ndarray:
    """Weights of ``count`` draws from place ``first``, a multiple of 8: (group, draw)."""
    part = planes[:, :, first // 8 : -(-(first + count) // 8)]
    out = np.zeros((len(planes), count), kind)
    for j in range(planes.shape[1]):
        out += np.unpackbits(np.ascontiguousarray(part[:, j]), axis=1, count=count) * kind(2.0**j)
    return out


def pack(weights: DataFrame, link: Sequence[str]) -> Picks:
    """Weights with rows (link, draw, w) as one value per group."""
    ends = weights.agg(F.min("draw").alias("a"), F.max("draw").alias("b")).first()
    first, count = (ends["a"], ends["b"] - ends["a"] + 1) if ends["a"] is not None else (0, 1)

    def together(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for a in range(0, len(frame), 512):
                part = frame.iloc[a : a + 512]
                w = np.zeros((len(part), count), np.int64)
                for i, (draws, values) in enumerate(zip(part["draws"], part["w"])):
                    np.add.at(w[i], np.asarray(draws) - first, np.asarray(values))
                yield pd.DataFrame({"link": part["link"].to_numpy(), "picks": packed(w)})

    lists = weights.select(link_key(link).alias("link"), F.struct(
        F.col("draw").cast("long").alias("draw"), F.col("w").cast("long").alias("w")).alias("e"))
    lists = lists.where(F.col("link").isNotNull()).groupBy("link").agg(F.collect_list("e").alias("e"))
    table = lists.select("link", F.col("e.draw").alias("draws"), F.col("e.w").alias("w"))
    return Picks(cut_lineage(table.mapInPandas(together, "link string, picks binary")), first, count)


def multinomial_picks(numbered: DataFrame, draws: int, seed: int, strata: Sequence[str], group: str, observed: bool) -> Picks:
    """The draws of ``resample.multinomial_weights`` from its numbered groups, hashed and counted in arrays.

    With ``observed`` there is one more draw, number -1, in which every group counts once.
    """
    strata, shift = list(strata), int(observed)
    count = draws + shift
    size = max(1, min(RANGE, 2**22 // count))
    # A unit is a range of slots of a stratum and some draws.
    text = F.concat_ws("|", F.lit(str(seed)), *[F.col(c).cast("string") for c in strata])
    sizes = numbered.select(*strata, "group_count").distinct().withColumn("text", text)
    units = sizes.withColumn("slot", F.explode(F.sequence(F.lit(0).cast("long"), F.col("group_count") - 1, F.lit(size).cast("long"))))
    units = units.withColumn("draw", F.explode(F.sequence(F.lit(0), F.lit(draws - 1), F.lit(UNIT))))
    key_types = "".join(f"`{c}` {t}, " for c, t in numbered.select(*strata).dtypes)

    def hashed(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for unit in frame.to_dict("records"):
                groups, numbers = unit["group_count"], [b"%d" % i for i in range(unit["slot"], min(unit["slot"] + size, unit["group_count"]))]
                stop, found = min(unit["draw"] + UNIT, draws), []
                for pair in range(unit["draw"] // 2, (stop + 1) // 2):
                    lead = f"{unit['text']}|{pair}|".encode()
                    digests = b"".join([md5(lead + n).digest() for n in numbers])
                    # One hash holds the picks of two draws: 15 hex digits from each half.
                    halves = (np.frombuffer(digests, ">u8").astype(np.uint64) >> np.uint64(4)) % np.uint64(groups)
                    for half in range(min(2, stop - 2 * pair)):
                        found.append(halves[half::2].astype(np.int64) * count + (2 * pair + half + shift))
                places = np.sort(np.concatenate(found))
                ranges, starts = np.unique(places // (size * count), return_index=True)
                parts = [p.astype("<u4").tobytes() for p in np.split(places % (size * count), starts[1:])]
                yield pd.DataFrame({**{c: [unit[c]] * len(parts) for c in strata}, "range": ranges, "places": parts})

    def counted(groups: pd.DataFrame, found: pd.DataFrame) -> pd.DataFrame:
        places = np.frombuffer(b"".join(found["places"]), "<u4")
        w = np.bincount(places, minlength=size * count).reshape(size, count)[groups["group_number"].to_numpy() % size]
        if observed:
            w[:, 0] = 1
        return pd.DataFrame({"link": groups["link"].to_numpy(), "picks": packed(w)})

    spread_units = units.repartition(max(bucket_count(numbered.sparkSession), numbered.sparkSession.sparkContext.defaultParallelism))
    found = spread_units.mapInPandas(hashed, f"{key_types}range long, places binary")
    groups = numbered.select(*strata, link_key([*strata, group]).alias("link"), "group_number", F.floor(F.col("group_number") / size).alias("range"))
    keys = [*strata, "range"]
    table = groups.groupBy(*keys).cogroup(found.groupBy(*keys)).applyInPandas(counted, "link string, picks binary")
    return Picks(cut_lineage(table.where(F.col("link").isNotNull())), -shift, count)


def _sums(w: np.ndarray, at: np.ndarray, which: np.ndarray, size: int, times: np.ndarray | None = None) -> np.ndarray:
    """Sums of the weights at ``at`` (times ``times``) by the ascending numbers ``which``."""
    out = np.zeros((size, w.shape[1]))
    for a in range(0, len(at), CHUNK):
        part = which[a : a + CHUNK]
        starts = np.flatnonzero(np.diff(part, prepend=-1))
        rows = w[at[a : a + CHUNK]]
        if times is not None:
            rows = rows * times[a : a + CHUNK, None]
        out[part[starts]] += np.add.reduceat(rows, starts, axis=0)
    return out


def _blocks(count: int) -> list[tuple[int, int, int]]:
    return [(b, a, min(BLOCK, count - a)) for b, a in enumerate(range(0, count, BLOCK))]


def _joined(frames: Sequence[pd.DataFrame]) -> pd.DataFrame:
    return pd.concat(frames, ignore_index=True)


def _tile_sums(tile: Sequence[str], count: int):
    """Rows and positives of every draw by segment of a tile."""
    tile = list(tile)

    def of_tile(counts: pd.DataFrame, table: pd.DataFrame) -> pd.DataFrame:
        counts = counts.sort_values("segment")
        at = pd.Index(table["link"]).get_indexer(counts["link"])
        counts, at = counts[at >= 0], at[at >= 0]
        if not len(counts):
            return pd.DataFrame(columns=[*tile, "segment", "block", "v"])
        which, names = pd.factorize(counts["segment"], use_na_sentinel=False)
        n, pos = (counts[c].to_numpy(dtype=float) for c in ("n", "pos"))
        planes, out = planes_of(table["picks"].tolist(), count), []
        for block, first, size in _blocks(count):
            w = block_weights(planes, first, size)
            v = np.hstack([_sums(w, at, which, len(names), x) for x in (n, pos)])
            out += [(s, block, r.tobytes()) for s, r in zip(names, v)]
        return pd.DataFrame(out, columns=["segment", "block", "v"]).assign(**{c: counts[c].iloc[0] for c in tile})
    return of_tile


def _offsets(dims: Sequence[str], scopes: Sequence[str]):
    """For each tile and scope in one block of draws: (rows, positives) before the tile, up to the end of its score bucket, in all."""
    dims = list(dims)

    def of_block(rows: pd.DataFrame) -> pd.DataFrame:
        whole = rows.groupby(BUCKETS, as_index=False)["v"].agg(lambda vs: np.sum([np.frombuffer(v) for v in vs], axis=0).tobytes())
        parts = [(ALL, whole)] if ALL in scopes else []
        parts += [(s, part) for s, part in rows.groupby("segment")] if "segment" in scopes else []
        out = []
        for scope, part in parts:
            part = part.sort_values(BUCKETS, ascending=[False, True, True])
            v = np.stack([np.frombuffer(x) for x in part["v"]])
            upto = np.cumsum(v, axis=0)
            bucket = part["_bucket"].to_numpy()
            last = np.append(np.flatnonzero(np.diff(bucket)), len(bucket) - 1)
            end = upto[last[np.searchsorted(-bucket[last], -bucket)]]
            sums = np.hstack([upto - v, end, np.broadcast_to(upto[-1], v.shape)])
            out.append(part[BUCKETS].assign(scope=scope, v=[x.tobytes() for x in sums]))
        keys = {c: rows[c].iloc[0] for c in [*dims, "block"]}
        return _joined(out).assign(**keys)
    return of_block


@dataclass(frozen=True)
class _Scope:
    """Rows of one scope in a tile, in order: group, label, span of each; which spans end a score with positives."""

    at: np.ndarray
    label: np.ndarray
    span: np.ndarray
    starts: np.ndarray
    ends: np.ndarray


def _scope(score: np.ndarray, at: np.ndarray, label: np.ndarray) -> _Scope:
    size = len(at)
    close = np.append(np.flatnonzero(np.diff(score)) + 1, size)  # one past the last row of each score
    positive = np.add.reduceat(label != 0, np.append(0, close[:-1]), dtype=np.int64) > 0
    stops = np.unique(np.concatenate([close[positive], np.arange(SPAN, size, SPAN), [size]]))
    starts = np.append(0, stops[:-1])
    span = np.repeat(np.arange(len(stops)), stops - starts)
    return _Scope(at, label, span, starts, np.searchsorted(stops, close[positive]))


def _of_scope(part: _Scope, w: np.ndarray, offsets: np.ndarray, fractions: Sequence[float], one_score: bool) -> np.ndarray:
    """Share of average precision, then positives caught by each fraction whose cut is here, for each draw."""
    (n0, y0), (n1, y1), (total, _) = offsets.reshape(3, 2, -1)
    spans, hit = len(part.starts), np.flatnonzero(part.label)
    n = _sums(w, part.at, part.span, spans)
    y = _sums(w, part.at[hit], part.span[hit], spans, part.label[hit])
    cn, cy = n0 + np.cumsum(n, axis=0), y0 + np.cumsum(y, axis=0)
    if one_score:  # the score may go on in the tiles beside it
        own, upto, rows = y.sum(axis=0)[None], y1[None], n1[None]
    else:
        upto, rows = cy[part.ends], cn[part.ends]
        own = np.diff(upto, axis=0, prepend=y0[None])
    out = [np.divide(own * upto, rows, out=np.zeros_like(own), where=own > 0).sum(axis=0)]
    for f in fractions:
        k, found = np.maximum(1.0, np.ceil(f * total)), np.zeros(len(total))
        here = np.flatnonzero((n0 < k) & (k <= cn[-1]))
        spot = (cn[:, here] >= k[here]).argmax(axis=0)
        for s in np.unique(spot):
            d = here[spot == s]
            rows_in = slice(part.starts[s], part.starts[s + 1] if s + 1 < spans else len(part.at))
            copies = w[part.at[rows_in]][:, d].astype(float)
            before = (cn[s, d] - n[s, d]) + np.cumsum(copies, axis=0) - copies
            taken = np.clip(k[d] - before, 0.0, copies)
            found[d] = (cy[s, d] - y[s, d]) + (taken * part.label[rows_in, None]).sum(axis=0)
        out.append(found)
    return np.concatenate(out)


def _tile(dims: Sequence[str], fractions: Sequence[float], scopes: Sequence[str], heavy: Sequence[int], count: int):
    dims = list(dims)

    def of_tile(rows: pd.DataFrame, table: pd.DataFrame) -> pd.DataFrame:
        offsets = rows[rows["scope"].notna()]
        rows = rows[rows["scope"].isna()]
        at = pd.Index(table["link"]).get_indexer(rows["link"])
        rows, at = rows[at >= 0], at[at >= 0]
        if not len(rows):
            return pd.DataFrame(columns=[*dims, "scope", "block", "v"])
        score = rows["score"].to_numpy(dtype=float)
        order = np.lexsort((rows["row_id"], pd.factorize(rows["segment"], sort=True)[0], -score))
        score, at = score[order], at[order]
        label, segment = rows["label"].to_numpy(dtype=float)[order], rows["segment"].to_numpy()[order]
        one_score = int(rows["_bucket"].iloc[0]) in heavy
        parts = {}
        if ALL in scopes:
            parts[ALL] = _scope(score, at, label)
        if "segment" in scopes:
            for name in pd.unique(segment):
                own = segment == name
                parts[name] = _scope(score[own], at[own], label[own])
        planes = planes_of(table["picks"].tolist(), count)
        kind = np.float32 if planes.shape[1] <= 16 else np.float64
        given, out = {(s, b): np.frombuffer(v) for s, b, v in zip(offsets["scope"], offsets["block"], offsets["v"])}, []
        for block, first, size in _blocks(count):
            w = block_weights(planes, first, size, kind)
            for name, part in parts.items():
                before = given[name, block]
                v = np.concatenate([before[-2 * size :], _of_scope(part, w, before, fractions, one_score)])
                out.append((name, block, v.tobytes()))
        keys = {c: rows[c].iloc[0] for c in dims}
        return pd.DataFrame(out, columns=["scope", "block", "v"]).assign(**keys)
    return of_tile


def _whole(dims: Sequence[str], fractions: Sequence[float], first: int):
    """Metrics of one scope in one block of draws from those of its tiles."""
    dims = list(dims)

    def of_block(rows: pd.DataFrame) -> pd.DataFrame:
        tiles = np.stack([np.frombuffer(v) for v in rows["v"]]).reshape(len(rows), 3 + len(fractions), -1)
        total, positives = tiles[0, :2]
        part, found = tiles[:, 2].sum(axis=0), tiles[:, 3:].sum(axis=0)
        draw = first + BLOCK * rows["block"].iloc[0] + np.arange(len(total))
        out = _joined([pd.DataFrame({
            "draw": draw, "fraction": f, "rows": total, "positives": positives, "k": np.maximum(1.0, np.ceil(f * total)),
            "part": part, "found": found[i],
        })[total > 0] for i, f in enumerate(fractions)])
        return out.assign(**{c: rows[c].iloc[0] for c in [*dims, "scope"]})
    return of_block


def tile_metrics(
    df: DataFrame, picks: Picks, dims: Sequence[str], fractions: Sequence[float], link: Sequence[str],
    scopes: Sequence[str], cuts: Cuts | None,
) -> DataFrame:
    """See ``resample.draw_metrics``."""
    dims, fractions, count = list(dims), [float(f) for f in fractions], picks.count
    spark = df.sparkSession
    size = df.count()
    cuts = cuts or find_cuts(df, "score", "row_id", max(bucket_count(spark), min(4096, -(-size // TILE_ROWS))))
    rows = df.select(*dims, "segment", "row_id", "label", "score", link_key(link).alias("link")).where(F.col("link").isNotNull())
    ready = with_buckets(rows, cuts, "score", ("segment", "row_id"))
    tile = [*dims, *BUCKETS]
    types = dict(ready.dtypes)
    kinds = lambda names: "".join(f"`{c}` {types[c]}, " for c in names)
    counts = ready.groupBy(*tile, "segment", "link").agg(F.count(F.lit(1)).alias("n"), F.sum("label").alias("pos"))
    # The weights of a tile's groups are moved once and read twice: for its sums, then for its rows.
    weights = counts.select(*tile, "link").distinct().join(picks.table, "link").select(
        *[F.col(c).alias(c) for c in [*tile, "link", "picks"]]).groupBy(*tile)
    sums = counts.groupBy(*tile).cogroup(weights).applyInPandas(
        _tile_sums(tile, count), f"{kinds([*tile, 'segment'])}block int, v binary")
    offsets = sums.groupBy(*dims, "block").applyInPandas(
        _offsets(dims, scopes), f"{kinds(tile)}scope string, block int, v binary")
    both = ready.unionByName(offsets, allowMissingColumns=True)
    done = both.groupBy(*tile).cogroup(weights).applyInPandas(
        _tile(dims, fractions, scopes, cuts.heavy, count), f"{kinds(dims)}scope string, block int, v binary")
    wide = done.groupBy(*dims, "scope", "block").applyInPandas(
        _whole(dims, fractions, picks.first), f"{kinds(dims)}draw long, scope string, fraction double, rows double, positives double, "
                                              "k double, part double, found double")
    # Draws x scopes x fractions rows, read more than once: write them.
    written = cut_lineage(wide)
    whole = {c: F.col(c).cast("long") for c in ("rows", "positives", "k")}
    return written.select(
        *dims, "draw", "scope", "fraction", *[v.alias(c) for c, v in whole.items()],
        ratio(F.col("part"), F.col("positives")).alias("average_precision"), F.col("found").cast("long").alias("found"),
    ).withColumn("recall", ratio(F.col("found"), F.col("positives")))
