"""Repeated runs of lines: suffix ranks of line sequences by distributed prefix doubling; later copies are deleted."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from slotwise.llm import texts
from slotwise.llm.fingerprints import bound
from slotwise.llm.shelf import Shelf

#: A run counts from this many words on.
LEAST_WORDS = 6
LINES = ("doc long, copy long, line int, id long, size int, reach int, back int")
PLACE = ("doc", "copy", "line")


def lines_of(docs: DataFrame, least: int = LEAST_WORDS) -> DataFrame:
    """One row per line of (doc_id, text): its document, place, identity, and the shortest runs of ``least`` words around it.

    ``reach``: lines of the shortest run that begins here, ``back``: of the shortest that ends here; 0 where the document has too
    few words on that side. Identity is a 64-bit hash and the length in bytes. A document is its doc_id and text hash.
    """

    def work(batch, data, offsets):
        data = np.append(data, np.uint8(10))
        newline = np.flatnonzero(data[:-1] == 10)
        counts = np.diff(np.searchsorted(newline, offsets)) + 1
        first = np.concatenate([[0], np.cumsum(counts)])
        row = np.repeat(np.arange(len(counts)), counts)
        stop, begin = np.empty(first[-1], np.int64), np.empty(first[-1], np.int64)
        inner = np.ones(first[-1], bool)
        inner[first[1:] - 1] = False
        stop[inner] = newline
        stop[~inner] = offsets[1:]
        begin[1:] = stop[:-1] + 1
        begin[first[:-1]] = offsets[:-1]
        word = texts.UNSPACED[data]
        word[1:] &= ~texts.UNSPACED[data[:-1]] | np.isin(np.arange(1, len(data)), offsets)
        total = np.concatenate([[0], np.cumsum(word)])
        upto = total[stop]
        before = total[begin]
        place = np.arange(first[-1]) - first[row]
        end_line = np.searchsorted(upto, before + least)
        reach = np.where(end_line < first[row + 1], end_line - np.arange(first[-1]) + 1, 0)
        start_line = np.searchsorted(before, upto - least, "right") - 1
        back = np.where((start_line >= first[row]) & (upto - before[np.maximum(start_line, 0)] >= least),
                        np.arange(first[-1]) - start_line + 1, 0)
        ids = texts.segment_hash(data, begin, stop)
        docs_ = batch.column("doc").to_numpy(zero_copy_only=False)
        copies = batch.column("copy").to_numpy(zero_copy_only=False)
        return pa.RecordBatch.from_arrays(
            [pa.array(docs_[row], pa.int64()), pa.array(copies[row], pa.int64()), pa.array(place.astype(np.int32)),
             pa.array(ids.view(np.int64)), pa.array((stop - begin).astype(np.int32)), pa.array(reach.astype(np.int32)),
             pa.array(back.astype(np.int32))],
            ["doc", "copy", "line", "id", "size", "reach", "back"])

    return docs.where("text is not null").select(*_document(), "text").mapInArrow(texts.by_slice(work), LINES)


def _document() -> tuple[Column, Column]:
    """Key of a document; null doc_ids come first."""
    return F.coalesce(F.col("doc_id").cast("long"), F.lit(-(1 << 63))).alias("doc"), F.xxhash64("text").alias("copy")


def ranked(keyed: DataFrame, keys: list[str], shelf: Shelf) -> DataFrame:
    """(keys, rank) of keys with at least two rows. Ranks rise in the order of the keys over the whole table.

    The distinct keys are sorted by ranges; partition and row numbers are the rank, so no task sees all of them.
    """
    classes = keyed.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).where("n > 1").select(*keys)
    return shelf.put(classes.orderBy(*keys).withColumn("rank", F.monotonically_increasing_id()))


def later_copies(docs: DataFrame, least: int = LEAST_WORDS, shelf: Shelf | None = None) -> DataFrame:
    """(doc, copy, deleted): line numbers, ascending, that lie in a run of at least ``least`` words which occurred before.

    Before: in a document with a smaller (doc_id, text hash), or further up in the same one. A line of a repeated run
    lies in the run's shortest part of ``least`` words that begins at it, ends at it, or begins where the run does, so those
    parts, as places and lengths, decide all maximal runs. A part of n lines is known by n and the ranks of
    its first and last 2**j lines, 2**j <= n; its first place is a partial minimum, so a part with any number of
    copies is one row per task.
    """
    shelf = shelf or Shelf(docs.sparkSession)
    lines = shelf.put(lines_of(docs, least))
    repeated = ranked(lines, ["id", "size"], shelf)
    # one row a place, however many rows of docs repeat it: places are joined with each other below
    own = shelf.put(lines.join(repeated, ["id", "size"]).select(*PLACE, "rank", "reach", "back").dropDuplicates(list(PLACE)))
    parts = own.where("reach > 0").select(*PLACE, F.col("reach").alias("n")).unionByName(
        own.where("back > 1").select("doc", "copy", (F.col("line") - F.col("back") + 1).alias("line"), F.col("back").alias("n"))).distinct()
    parts = shelf.put(parts.withColumn("level", F.floor(F.log2("n") + 1e-9).cast("int")))
    longest = parts.agg(F.max("n")).first()[0] or 0
    found = None
    rank = own.select(*PLACE, "rank")
    level = 0
    while longest >= 1 << level:
        span = 1 << level
        here = parts.where(F.col("level") == level)
        tail = rank.select("doc", "copy", F.col("line").alias("last"), F.col("rank").alias("tail"))
        named = here.join(rank, list(PLACE)).withColumn("last", F.col("line") + F.col("n") - span).join(
            tail, ["doc", "copy", "last"]) if level else here.join(rank, list(PLACE)).withColumn("tail", F.col("rank"))
        named = shelf.put(named.select(*PLACE, "n", "rank", "tail"))
        place = F.struct(*PLACE)
        origin = named.groupBy("n", "rank", "tail").agg(F.min(place).alias("first"), F.count(F.lit(1)).alias("k")).where("k > 1")
        origin = shelf.put(origin)  # then adaptive execution can split a run with very many copies
        copies = named.join(origin, ["n", "rank", "tail"]).where(place > F.col("first")).select(*PLACE, "n")
        found = copies if found is None else found.unionByName(copies)
        level += 1
        if longest >= 1 << level:
            ahead = rank.select("doc", "copy", (F.col("line") - span).alias("line"), F.col("rank").alias("next"))
            pairs = shelf.put(rank.withColumnRenamed("rank", "own").join(ahead, list(PLACE)))
            rank = shelf.put(pairs.join(ranked(pairs, ["own", "next"], shelf), ["own", "next"]).select(*PLACE, "rank"))
    if found is None:
        return lines.select("doc", "copy", F.array("line").alias("deleted")).limit(0)
    # parts overlap: each goes on from where the parts before it end, so that a line is made once
    found = found.groupBy(*PLACE).agg(F.max("n").alias("n")).withColumn("stop", F.col("line") + F.col("n"))
    earlier = Window.partitionBy("doc", "copy").orderBy("line").rowsBetween(Window.unboundedPreceding, -1)
    fresh = found.withColumn("start", F.greatest("line", F.max("stop").over(earlier))).where("stop > start")
    covered = fresh.select("doc", "copy", F.explode(F.sequence("start", F.col("stop") - 1)).alias("line"))
    return covered.groupBy("doc", "copy").agg(F.sort_array(F.collect_list("line")).alias("deleted"))


def without_repeats(docs: DataFrame, least: int = LEAST_WORDS, shelf: Shelf | None = None) -> DataFrame:
    """``docs`` with the lines of later copies deleted from the text, and n_lines and ``deleted`` (line numbers from 0).

    Null text: unchanged, zero lines, nothing deleted; empty text: one empty line. Rows that repeat doc_id and text are one
    document and lose the same lines. Null doc_ids come before all others. Columns of ``docs`` with the
    result's names are replaced.
    """
    base = texts.no_clash(docs, "n_lines", "deleted")
    found = later_copies(docs.select("doc_id", "text"), least, shelf).withColumnsRenamed({"doc": "_doc", "copy": "_copy"})
    doc, copy = _document()
    rows = base.withColumns({"_doc": doc, "_copy": copy}).join(found.hint("merge"), ["_doc", "_copy"], "left").drop("_doc", "_copy")
    count = F.when(F.col("text").isNull(), F.lit(0)).otherwise(F.size(F.split("text", "\n", -1)))
    kept = bound(F.split("text", "\n", -1), lambda lines: F.array_join(F.transform(
        F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), F.col("deleted")), lambda i: F.get(lines, i)), "\n"))
    return rows.select(
        *[F.when(F.col("deleted").isNull(), F.col("text")).otherwise(kept).alias("text") if c == "text" else F.col(c) for c in base.columns],
        count.cast("long").alias("n_lines"), F.coalesce("deleted", F.array().cast("array<int>")).alias("deleted"))


def drop_repeats(docs: DataFrame, least: int = LEAST_WORDS, shelf: Shelf | None = None) -> DataFrame:
    """``docs`` without the lines of later copies, and without the rows of which the deletion leaves no word."""
    rows, back = texts.aside(docs)
    rows = without_repeats(rows, least, shelf)
    return rows.where((F.size("deleted") == 0) | F.col("text").rlike(r"[^ \t\n\x0B\f\r]")).select(*back)
