"""Merkle manifest of a table: trees of any fan-out, built level by level with sibling-shift self-joins."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from linetriage.llm.common import parts, stored

FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
PATH = "array<struct<left:string,right:string>>"


def framed(value: Column) -> Column:
    """A value as its UTF-8 byte count, a colon and its text, or ``-`` for null; concatenations stay unambiguous."""
    text = value.cast("string")
    return F.when(text.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text))


def leaf_digest(values: Sequence[Column]) -> Column:
    return F.sha2(F.concat(*[framed(v) for v in values]), 256)


def is_sibling(at: Column, other: Column, fanout: int) -> Column:
    """Whether ``other`` is a place that ``at`` computes for a sibling: its XOR, or itself shifted within the run."""
    if fanout == 2:
        return other == at.bitwiseXOR(F.lit(1))
    return F.pmod(other - at, F.lit(fanout)).between(1, fanout - 1)


def slotted(df: DataFrame, order: Sequence[str]) -> DataFrame:
    """Add ``slot`` (position from 0 in its ``tree``) and ``total`` (rows of the tree), in ``order``.

    Rows are dealt by range of (tree, order), so a tree that holds most rows lies in many tasks; the range
    number is stored with the row, and counts per range place each range in its tree.
    """
    ranges = parts(df.sparkSession)
    dealt = stored(df.repartitionByRange(ranges, "tree", *order).withColumn("dealt", F.spark_partition_id()))
    counts = dealt.groupBy("tree", "dealt").agg(F.count(F.lit(1)).alias("rows"))
    tree = Window.partitionBy("tree")
    placed = counts.select(
        "tree", "dealt", F.sum("rows").over(tree).alias("total"),
        (F.sum("rows").over(tree.orderBy("dealt")) - F.col("rows")).alias("before"))
    inside = Window.partitionBy("tree", "dealt").orderBy(*order)
    ranked = dealt.withColumn("nth", F.row_number().over(inside) - 1).join(placed, ["tree", "dealt"])
    return ranked.withColumn("slot", F.col("before") + F.col("nth")).drop("dealt", "before", "nth")


def with_siblings(nodes: DataFrame, fanout: int, only_first: bool = False) -> DataFrame:
    """Give each node (tree, slot, total, digest, ...) the digests of its run: ``left`` and ``right`` of it, concatenated.

    A self-join on the run in which every node meets the nodes at its computed sibling places. Both sides and
    the sums of the answers need one shuffle, by (tree, run), so a large tree is spread by its runs.
    """
    placed = nodes.withColumns({
        "run": F.expr(f"slot div {fanout}"), "at": F.expr(f"cast(slot % {fanout} as int)")}).repartition("tree", "run")
    given = placed.select(
        F.col("tree").alias("o_tree"), F.col("run").alias("o_run"), F.col("at").alias("o_at"), F.col("digest").alias("other"))
    asking = placed.where("at = 0") if only_first else placed
    met = asking.join(
        given, (F.col("tree") == F.col("o_tree")) & (F.col("run") == F.col("o_run"))
        & is_sibling(F.col("at"), F.col("o_at"), fanout), "left")
    answer = F.when(F.col("other").isNotNull(), F.struct("o_at", "other"))
    kept = [F.first(c).alias(c) for c in nodes.columns if c != "tree"]
    found = met.groupBy("tree", "run", "at").agg(F.sort_array(F.collect_list(answer)).alias("others"), *kept)

    def side(keep: str) -> Column:
        return F.expr(f"array_join(transform(filter(others, o -> o.o_at {keep} at), o -> o.other), '')")

    return found.withColumns({"left": side("<"), "right": side(">")}).drop("others")


def climb(nodes: DataFrame, fanout: int) -> tuple[list[DataFrame], list[DataFrame]]:
    """The nodes of all levels of all trees, and by height those that are alone in their tree: its root."""
    levels: list[DataFrame] = []
    tops: list[DataFrame] = []
    left = nodes.agg(F.max("total")).first()[0] or 0
    while left > 1:
        tops.append(nodes.where("total = 1"))
        levels.append(nodes.where("total > 1"))
        first = with_siblings(levels[-1].select("tree", "slot", "total", "digest"), fanout, only_first=True)
        nodes = stored(first.select(
            "tree", F.col("run").alias("slot"), F.ceil(F.col("total") / fanout).alias("total"),
            F.sha2(F.concat("digest", "right"), 256).alias("digest")))
        left = -(-left // fanout)
    return levels, [*tops, nodes]


def descend(levels: list[DataFrame], roots: list[DataFrame], fanout: int) -> DataFrame:
    """The lowest level with ``path``: what to put left and right of the digest, from the node up to the last root.

    ``roots`` are the tops by height with their own ``path`` above and the columns that all nodes of the tree get.
    """
    extra = [c for c in roots[-1].columns if c not in ("tree", "path")]
    slot = F.lit(0).cast("long").alias("slot")
    above = roots[-1].select("tree", slot, "path", *extra)
    for height in range(len(levels) - 1, -1, -1):
        up = above.select("tree", F.col("slot").alias("run"), F.col("path").alias("upper"), *extra)
        step = F.array(F.struct("left", "right")).cast(PATH)
        level = with_siblings(levels[height], fanout).join(up, ["tree", "run"]).withColumn(
            "path", F.concat(step, "upper")).drop("upper", "left", "right")
        if height == 0:
            return level
        above = level.select("tree", "slot", "path", *extra).unionByName(
            roots[height].select("tree", slot, "path", *extra))
    return above


def manifest(
    docs: DataFrame, carried: dict[str, Column] | None = None, group: str = "source", order: str = "doc_id",
    fields: Sequence[str] = FIELDS, fanout: int = 16,
) -> DataFrame:
    """One tree per value of ``group`` over rows in ``order``, one tree over their roots, and each row's path.

    Returns per row of ``docs``: ``order``, ``group``, ``leaf`` (digest of the framed ``fields``), ``subroot``,
    ``root``, ``path`` (per level the digests left and right of the row's ancestor, up to the root) and the
    ``carried`` columns. Texts are read once and never shuffled. Null keys come first; rows that repeat a key
    are ordered by their leaf and are leaves of their own; every field may be null or empty; other columns are
    ignored; an empty table gives no rows. A digest of a parent is that of its children's digests in order.
    """
    if fanout < 2:
        raise ValueError("a tree needs a fan-out of two or more")
    carried = carried or {}
    # The prefix keeps a null group apart from an empty one and before all others.
    tree = F.coalesce(F.concat(F.lit("="), F.col(group).cast("string")), F.lit(""))
    kept = [F.col(f"`{order}`").alias("key"), *[c.alias(f"carried_{n}") for n, c in carried.items()]]
    leaves = stored(docs.select(
        tree.alias("tree"), leaf_digest([F.col(f"`{f}`") for f in fields]).alias("digest"),
        F.monotonically_increasing_id().alias("row"), *kept))
    nodes = stored(slotted(leaves, ["key", "digest", "row"]).drop("row"))
    levels, tops = climb(nodes, fanout)

    subroots = tops[0].select("tree", F.lit(0).alias("height"), "digest")
    for height, top in enumerate(tops[1:], 1):
        subroots = subroots.unionByName(top.select("tree", F.lit(height).alias("height"), "digest"))
    upper = slotted(
        subroots.select(F.lit("").alias("tree"), F.col("tree").alias("name"), "height", "digest"), ["name"])
    upper = stored(upper)
    top_levels, top_roots = climb(upper, fanout)
    last = top_roots[-1].select("tree", "digest").first()
    root = last["digest"] if last else None
    empty = F.array().cast(PATH)
    if top_levels:
        ends = [t.select("tree", empty.alias("path")) for t in top_roots]
        named = descend(top_levels, ends, fanout)
    else:
        named = upper.withColumn("path", empty)
    named = stored(named.select(F.col("name").alias("tree"), "height", F.col("digest").alias("subroot"), "path"))
    by_height = [named.where(F.col("height") == h).drop("height") for h in range(len(tops))]

    own = ["key", "digest", "tree", *[f"carried_{n}" for n in carried], "subroot", "path"]
    alone = tops[0].where("total = 1").join(by_height[0], "tree").select(*own)
    rows = descend(levels, by_height, fanout).select(*own).unionByName(alone) if levels else alone
    return rows.select(
        F.col("key").alias(order), F.when(F.col("tree") != "", F.expr("substring(tree, 2)")).alias(group),
        F.col("digest").alias("leaf"), "subroot", F.lit(root).cast("string").alias("root"), "path",
        *[F.col(f"carried_{n}").alias(n) for n in carried])


def proof_digest(path: Column) -> Column:
    """Digest of all siblings of a path, level by level, left to right."""
    return F.sha2(F.array_join(F.transform(path, lambda s: F.concat(s["left"], s["right"])), ""), 256)


def folded(leaf: Column, path: Column) -> Column:
    """The root that a leaf gives with the siblings of ``path``."""
    return F.aggregate(path, leaf, lambda digest, s: F.sha2(F.concat(s["left"], digest, s["right"]), 256))
