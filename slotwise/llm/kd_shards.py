"""Shards of near-equal bytes by a k-d tree over metadata, with DataFrame functions only."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from slotwise.llm.shelf import Shelf

#: A coordinate has VALUE bits of the dimension's own value and, below them, TIE bits that spread equal values.
VALUE, TIE = 24, 32
SPAN = 1 << (VALUE + TIE)
#: Bins of one refining pass.
BINS = 1024
#: A cut is fine enough when the bin that holds it weighs less than this share of a leaf.
TOLERANCE = 0.002


@dataclass
class Node:
    """Rows of a part of the tree, to become ``leaves`` shards from number ``first`` on."""

    first: int
    leaves: int
    dimension: int | None = None
    low: int = 0
    high: int = SPAN
    target: float = 0.0


def size_of() -> Column:
    """UTF-8 bytes of the text (null: none) and 16 for the row."""
    return F.coalesce(F.octet_length("text"), F.lit(0)).cast("long") + 16


def metadata(docs: DataFrame) -> DataFrame:
    """(doc_id, size, text_crc32, c0..c3): one row per document with its place in four dimensions, each below SPAN.

    c0 is the size on a logarithmic scale, c1 the language, c2 the source (both as hashes), c3 the doc_id's place in
    the table's range. Absent columns and nulls are the lowest value. Equal values are spread by a hash of doc_id and
    text; only rows equal in both differ by their place in the input.
    """
    text = F.coalesce("text", F.lit(""))
    ends = docs.agg(F.min("doc_id").alias("low"), F.max("doc_id").alias("high")).first()
    low, high = ends["low"] or 0, ends["high"] or 0
    hashed = lambda name: F.shiftrightunsigned(F.xxhash64(F.col(name)), 64 - VALUE) if name in docs.columns else F.lit(0)
    scaled = (F.col("doc_id").cast("double") - low) / max(1.0, float(high) - float(low)) * ((1 << VALUE) - 1)
    values = [F.log2(F.col("size").cast("double")) * ((1 << VALUE) / 64), hashed("lang"), hashed("source"), scaled]
    rows = docs.select(
        "doc_id", *[c for c in ("lang", "source") if c in docs.columns], size_of().alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"))
    tie = F.xxhash64("doc_id", "text_crc32", "size")
    again = F.monotonically_increasing_id().bitwiseAND((1 << 12) - 1)
    tie = F.shiftrightunsigned(tie, 64 - TIE).bitwiseXOR(again)
    return rows.select("doc_id", "size", "text_crc32", tie.alias("tie"), *[
        F.coalesce(F.least(F.greatest(v.cast("long"), F.lit(0)), F.lit((1 << VALUE) - 1)), F.lit(0)).alias(f"v{i}")
        for i, v in enumerate(values)]).select("doc_id", "size", "text_crc32", *[
            (F.col(f"v{i}") * (1 << TIE) + F.shiftrightunsigned(F.xxhash64(F.lit(i), "tie"), 64 - TIE).bitwiseXOR(
                F.col("tie").bitwiseAND((1 << 12) - 1))).alias(f"c{i}") for i in range(4)])


def tree(rows: DataFrame, shards: int) -> list[tuple[Node, int, Node, Node]]:
    """Splits (node, cut, left, right) until every node is one shard; left has coordinates below the cut.

    All nodes of a level are split together. A first pass over the rows finds, per node, the extent of each dimension; the
    widest is cut where the weight below reaches the left part's share. The cut is narrowed by histograms of
    BINS bins: partial sums per task, at most nodes x BINS rows, and one row per node for the driver.
    """
    splits, level = [], [Node(0, shards)]
    while any(n.leaves > 1 for n in level):
        todo = [n for n in level if n.leaves > 1]
        at = rows.withColumn("node", _node(splits, shards))
        _widest(at, todo)
        _narrow(at, todo)
        children = []
        for n in todo:
            left = Node(n.first, n.leaves // 2)
            right = Node(n.first + n.leaves // 2, n.leaves - n.leaves // 2)
            splits.append((n, n.high, left, right))
            children += [left, right]
        level = children + [n for n in level if n.leaves == 1]
    return splits


def _node(splits, shards: int) -> Column:
    """First shard number of the node that a row is in, as far as the tree goes."""
    by_start = {(s[0].first, s[0].leaves): s for s in splits}

    def below(first: int, leaves: int) -> Column:
        if (first, leaves) not in by_start:
            return F.lit(first)
        n, cut, left, right = by_start[first, leaves]
        return F.when(F.col(f"c{n.dimension}") < cut, below(left.first, left.leaves)).otherwise(below(right.first, right.leaves))

    return below(0, shards)


def _widest(at: DataFrame, todo: list[Node]) -> None:
    wanted = [n.first for n in todo]
    found = at.where(F.col("node").isin(wanted)).groupBy("node").agg(
        F.sum("size").alias("size"), *[f(f"c{i}").alias(f"{name}{i}") for i in range(4) for f, name in ((F.min, "low"), (F.max, "high"))])
    by_node = {r["node"]: r for r in found.collect()}
    for n in todo:
        r = by_node.get(n.first)
        n.dimension, n.low, n.high, n.target = 0, 0, 1, 0.0
        if r is not None:
            n.dimension = max(range(4), key=lambda i: (r[f"high{i}"] - r[f"low{i}"], -i))
            n.low, n.high = r[f"low{n.dimension}"], r[f"high{n.dimension}"] + 1
            n.target = r["size"] * (n.leaves // 2) / n.leaves
            n.weight = r["size"] / n.leaves


def _narrow(at: DataFrame, todo: list[Node]) -> None:
    """Set ``high`` of each node to its cut."""
    left = [n for n in todo if n.target > 0]
    while left:
        value, low, width = F.lit(None), F.lit(None), F.lit(None)
        for n in left:
            here = F.col("node") == n.first
            value = F.when(here, F.col(f"c{n.dimension}")).otherwise(value)
            low = F.when(here, F.lit(n.low)).otherwise(low)
            width = F.when(here, F.lit(max(1, -(-(n.high - n.low) // BINS)))).otherwise(width)
        bins = at.select("node", "size", value.alias("value"), low.alias("low"), width.alias("width"))
        bins = bins.where("value is not null").groupBy(
            "node", F.least(F.greatest(F.floor((F.col("value") - F.col("low")) / F.col("width")), F.lit(-1)), F.lit(BINS)).alias("bin")
        ).agg(F.sum("size").alias("size"))  # -1 and BINS hold all that lies outside
        targets = F.create_map(*[x for n in left for x in (F.lit(n.first), F.lit(n.target))])
        running = F.sum("size").over(Window.partitionBy("node").orderBy("bin"))
        cut = bins.withColumn("upto", running).where(F.col("upto") >= targets[F.col("node")]).groupBy("node").agg(
            F.min(F.struct("bin", "size", "upto")).alias("b"))
        by_node = {r["node"]: r["b"] for r in cut.collect()}
        again = []
        for n in left:
            b, width = by_node[n.first], max(1, -(-(n.high - n.low) // BINS))
            below = b["upto"] - b["size"]
            start = n.low + b["bin"] * width
            if width == 1 or b["size"] <= TOLERANCE * n.weight:
                n.high = start + width if b["upto"] - n.target <= n.target - below else start
            else:
                n.low, n.high = start, start + width
                again.append(n)
        left = again


def sharded(docs: DataFrame, shards: int = 40, shelf: Shelf | None = None, chunk: int = 1 << 17) -> DataFrame:
    """(doc_id, size, text_crc32, shard, slot) of every row: ``shards`` shards of near-equal bytes, slots gapless from 0.

    The leaves of the tree are the shards, by their place in it; leaf targets are total bytes / ``shards``. Slots number
    the rows of a shard: rows are counted per (shard, chunk), chunks hold about ``chunk`` rows whatever a shard's
    size, and each chunk starts where the one before it ends. An empty table gives no rows; fewer rows than shards leave
    shards empty; a row is never split, so a shard may exceed its target by one row.
    """
    shelf = shelf or Shelf(docs.sparkSession)
    rows = shelf.put(metadata(docs))
    count = rows.count()
    splits = tree(rows, shards) if count else []
    chunks = max(1, -(-count // (shards * chunk)))
    placed = rows.select(
        "doc_id", "size", "text_crc32", _node(splits, shards).alias("shard"),
        F.pmod(F.xxhash64("c3", "c0"), F.lit(chunks)).cast("int").alias("chunk"), "c0", "c3")
    counts = placed.groupBy("shard", "chunk").agg(F.count(F.lit(1)).alias("n"))
    before = F.sum("n").over(Window.partitionBy("shard").orderBy("chunk")) - F.col("n")
    starts = counts.select("shard", "chunk", before.alias("start"))
    order = Window.partitionBy("shard", "chunk").orderBy("doc_id", "c3", "c0", "text_crc32", "size")
    return placed.withColumn("place", F.row_number().over(order) - 1).join(starts, ["shard", "chunk"]).select(
        "doc_id", "size", "text_crc32", "shard", (F.col("start") + F.col("place")).cast("long").alias("slot"))
