"""Benchmark passages in training text, found by one FM-index per shard of documents."""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from slotwise.llm import texts
from slotwise.llm.fm_index import FMIndex
from slotwise.llm.shelf import Shelf

#: Words of a window; a shorter item is one window.
WINDOW = 13
#: Benchmark text whose windows travel to the tasks at once; a larger benchmark goes through the documents in blocks.
BLOCK_BYTES = 16 << 20

SPANS = T.ArrayType(T.StructType([T.StructField("begin", T.LongType()), T.StructField("end", T.LongType())]))
FOUND = [T.StructField("n_words", T.LongType()), T.StructField("n_hit", T.LongType()),
         T.StructField("hits", SPANS), T.StructField("items", T.ArrayType(T.StringType()))]


@dataclass
class Phrases:
    """Distinct windows as symbols of the benchmark's own vocabulary (0 end, 1 gap, words from 2), left-aligned."""

    vocabulary: np.ndarray
    patterns: np.ndarray
    lengths: np.ndarray
    item_at: np.ndarray
    items: np.ndarray
    names: list[str]


def phrases_of(names: list[str | None], item_texts: list[str | None], window: int = WINDOW) -> Phrases:
    data, offsets = texts.text_buffers(pa.array(item_texts, pa.large_string()))
    h, _, _, at = texts.words(data, offsets, texts.ALNUM)
    vocabulary = np.unique(h)
    symbols = np.searchsorted(vocabulary, h) + 2
    rows, owner = [], []
    for i, (lo, hi) in enumerate(zip(at[:-1].tolist(), at[1:].tolist())):
        for k in range(lo, max(hi - window, lo) + 1 if hi > lo else lo):
            row = np.zeros(window, np.int64)
            part = symbols[k : min(k + window, hi)]
            row[: len(part)] = part
            rows.append(row)
            owner.append(i)
    known = sorted({n for n in names if n is not None})
    if not rows:
        return Phrases(vocabulary, np.zeros((0, window), np.int64), np.zeros(0, np.int64), np.zeros(1, np.int64),
                       np.zeros(0, np.int64), known)
    patterns, inverse = np.unique(np.array(rows), axis=0, return_inverse=True)
    place = {n: i for i, n in enumerate(known)}
    pairs = sorted({(p, place[names[i]]) for p, i in zip(inverse.ravel().tolist(), owner) if names[i] is not None})
    item_at = np.concatenate([[0], np.cumsum(np.bincount([p for p, _ in pairs], minlength=len(patterns)))]).astype(np.int64)
    return Phrases(vocabulary, patterns, (patterns > 0).sum(axis=1), item_at, np.array([i for _, i in pairs], np.int64), known)


def occurrences(symbols: np.ndarray, word_offsets: np.ndarray, phrases: Phrases):
    """(phrase, first word) of every occurrence in the documents of one shard.

    ``symbols`` holds 1 where a word is not in the benchmark. A window lies within a run of known words of one
    document, so only runs as long as the shortest window are indexed, each followed by a gap symbol.
    """
    none = np.zeros(0, np.int64)
    if not len(phrases.lengths) or not len(symbols):
        return none, none
    known = symbols > 1
    edge = np.ones(len(symbols) + 1, bool)
    edge[1:-1] = known[1:] != known[:-1]
    edge[word_offsets] = True
    begin = np.flatnonzero(edge)
    length = np.diff(begin)
    keep = known[begin[:-1]] & (length >= phrases.lengths.min())
    begin, length = begin[:-1][keep], length[keep]
    if not len(begin):
        return none, none
    at = np.concatenate([[0], np.cumsum(length + 1)])
    source = np.arange(at[-1]) - np.repeat(at[:-1] - begin, length + 1)
    text = symbols[np.minimum(source, len(symbols) - 1)]
    text[at[1:] - 1] = 1
    index = FMIndex(text, len(phrases.vocabulary) + 2)
    low, high = index.search(phrases.patterns, phrases.lengths)
    count = high - low
    phrase = np.repeat(np.arange(len(count)), count)
    rows = np.repeat(low, count) + np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
    return phrase, source[index.locate(rows)]


def find_in_shard(data: np.ndarray, offsets: np.ndarray, phrases: Phrases):
    """Per document: number of words, merged hit spans (words), items; and the words' bytes."""
    h, begin, stop, at = texts.words(data, offsets, texts.ALNUM)
    symbols = np.ones(len(h), np.int64)
    if len(phrases.vocabulary) and len(h):
        place = np.searchsorted(phrases.vocabulary, h)
        place[place == len(phrases.vocabulary)] = 0
        same = phrases.vocabulary[place] == h
        symbols[same] = place[same] + 2
    phrase, first = occurrences(symbols, at, phrases)
    cover = np.zeros(len(h) + 1, np.int64)
    np.add.at(cover, first, 1)
    np.add.at(cover, first + phrases.lengths[phrase], -1)
    hit = np.cumsum(cover)[:-1] > 0
    rows = np.searchsorted(at, first, "right") - 1
    items: dict[int, set[int]] = {}
    for row, p in np.unique(np.stack([rows, phrase], axis=1), axis=0).tolist():
        items.setdefault(row, set()).update(phrases.items[phrases.item_at[p] : phrases.item_at[p + 1]].tolist())
    return at, hit, items, begin, stop


def contamination(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, shelf: Shelf | None = None) -> DataFrame:
    """``docs`` with n_words, n_hit, hits (merged spans of word places, end exclusive) and items (sorted item_ids).

    Benchmark windows go to the tasks in blocks of at most BLOCK_BYTES of text (or one item); every block reads all
    documents once, and its spans and items are merged with those found so far.

    Null or empty texts: no words, no hits. Empty benchmark: no hits. Repeated item_ids are one item; items
    without an id mark words but are not listed. Columns of ``docs`` with the result's names are replaced.
    """
    shelf = shelf or Shelf(docs.sparkSession)
    spark = docs.sparkSession
    size = benchmark.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    blocks = max(1, -(-int(size) // BLOCK_BYTES))
    items = benchmark.select(F.col("item_id").cast("string").alias("item"), "text").where("text is not null").withColumn(
        "block", F.pmod(F.xxhash64("item", "text"), F.lit(blocks)))
    out = texts.no_clash(docs, *[f.name for f in FOUND])
    columns = out.columns
    for block in range(blocks):
        rows = items.where(F.col("block") == block).collect()
        phrases = phrases_of([r["item"] for r in rows], [r["text"] for r in rows], window)
        out = out.mapInArrow(texts.by_slice(_finder(spark.sparkContext.broadcast(phrases), block > 0)),
                             T.StructType([*out.select(columns).schema.fields, *FOUND]))
        if block < blocks - 1:
            out = shelf.put(out)
    return out


def _finder(shared, more: bool):
    def work(batch, data, offsets):
        phrases = shared.value
        at, hit, items, _, _ = find_in_shard(data, offsets, phrases)
        names = {row: {phrases.names[i] for i in found} for row, found in items.items()}
        if more:
            for row, (spans, found) in enumerate(zip(batch.column("hits").to_pylist(), batch.column("items").to_pylist())):
                for s in spans:
                    hit[at[row] + s["begin"] : at[row] + s["end"]] = True
                if found:
                    names[row] = names.get(row, set()) | set(found)
        edge = np.zeros(len(hit) + 1, np.int8)
        edge[:-1] += hit
        edge[1:] -= hit
        inner = at[(at > 0) & (at < len(hit))]
        split = inner[hit[inner] & hit[inner - 1]] if len(inner) else inner
        first = np.sort(np.concatenate([np.flatnonzero(edge > 0), split]))
        last = np.sort(np.concatenate([np.flatnonzero(edge < 0), split]))
        row = np.searchsorted(at, first, "right") - 1
        spans = pa.StructArray.from_arrays([pa.array(first - at[row]), pa.array(last - at[row])], ["begin", "end"])
        span_at = np.searchsorted(row, np.arange(len(at)))
        keep = [f.name for f in batch.schema if f.name not in {f.name for f in FOUND}]
        sums = np.concatenate([[0], np.cumsum(hit)])[at]
        return pa.RecordBatch.from_arrays(
            [*[batch.column(n) for n in keep], pa.array(np.diff(at)), pa.array(np.diff(sums).astype(np.int64)),
             pa.ListArray.from_arrays(pa.array(span_at.astype(np.int32)), spans),
             pa.array([sorted(names.get(r, ())) for r in range(len(at) - 1)], pa.list_(pa.string()))],
            [*keep, *[f.name for f in FOUND]])

    return work


def contaminated():
    """The rule: at least a twentieth of the words is hit."""
    return (F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words"))


def without_spans(docs: DataFrame) -> DataFrame:
    """Result of ``contamination`` with the hit words cut out of the text (from the first word's start to the last's end)."""

    def work(batch, data, offsets):
        _, begin, stop, at = texts.words(data, offsets, texts.ALNUM)
        out = []
        for row, (text, spans) in enumerate(zip(batch.column("text").to_pylist(), batch.column("hits").to_pylist())):
            if spans:
                raw, parts, place = text.encode(), [], 0
                for s in spans:
                    parts.append(raw[place : begin[at[row] + s["begin"]] - offsets[row]])
                    place = stop[at[row] + s["end"] - 1] - offsets[row]
                text = b"".join([*parts, raw[place:]]).decode()
            out.append(text)
        place = batch.schema.get_field_index("text")
        return pa.RecordBatch.from_arrays(
            [pa.array(out, pa.string()) if i == place else batch.column(i) for i in range(batch.num_columns)],
            batch.schema.names)

    return docs.mapInArrow(texts.by_slice(work), docs.schema)


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, shelf: Shelf | None = None) -> DataFrame:
    """``docs`` without the contaminated rows; the others are unchanged."""
    rows, back = texts.aside(docs)
    return contamination(rows, benchmark, shelf=shelf).where(~contaminated()).select(*back)


def items_digest():
    return F.sha2(F.array_join("items", ","), 256)


def digest(items: list[str]) -> str:
    """The same for tests."""
    return hashlib.sha256(",".join(sorted(items)).encode()).hexdigest()
