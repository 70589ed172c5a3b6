"""Repeated byte strings of any place and document: suffix arrays per shard of text that can repeat; later copies are cut."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from slotwise.llm import texts
from slotwise.llm.line_runs import _document
from slotwise.llm.shelf import Shelf
from slotwise.llm.suffixes import Windows, merge

#: Bytes of a gram; of the grams inside a window the smallest hash names the shard of the window.
GRAM = 20
#: A run of windows with one name is cut into stretches of this many.
STRETCH = 64
#: Texts (bytes) per bucket of names and per shard, and bytes of stretches per suffix array.
BUCKET, SHARD = 1 << 25, 1 << 21
#: Stretches that are told of at once.
STRETCHED = 1 << 16
#: Names in more documents than this are resolved window by window, so that no shard grows with them.
CROWD = 1 << 15
_BLOCK = 1 << 20
_ODD = np.uint64(0x9E3779B97F4A7C15)
_NONE = np.uint64(0xFFFFFFFFFFFFFFFF)
_PLACE = np.dtype([("doc", "<i8"), ("copy", "<i8"), ("at", "<i4")])


def named_runs(data: np.ndarray, offsets: np.ndarray, length: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(row, first, windows, name) of the stretches of neighbouring windows with one name, block by block.

    A name depends on the window's bytes alone, so equal windows have equal names wherever they stand.
    """
    n = len(data)
    ahead = length - GRAM + 1
    for base in range(0, n, _BLOCK):
        stop = min(n, base + _BLOCK)
        part = np.concatenate([data[base : min(n, stop + length)], np.zeros(GRAM, np.uint8)])
        size = len(part) - GRAM
        word = np.ndarray((size + GRAM - 8,), "<u8", part, strides=(1,))
        h = texts.mix(word[:size] * _ODD + word[8 : size + 8])
        h = texts.mix(h + word[GRAM - 8 : size + GRAM - 8])
        row = np.searchsorted(offsets, np.arange(base, base + size), "right") - 1
        left = offsets[row + 1] - np.arange(base, base + size)
        h[left < GRAM] = _NONE
        least, span = h, 1
        while span * 2 <= ahead:
            least = np.minimum(least[: len(least) - span], least[span:])
            span *= 2
        if span < ahead:
            least = np.minimum(least[: len(least) - (ahead - span)], least[ahead - span :])
        here = np.flatnonzero(left[: min(stop - base, len(least))] >= length)
        if not len(here):
            continue
        name, owner = least[here], row[here]
        head = np.ones(len(here), bool)
        head[1:] = (name[1:] != name[:-1]) | (owner[1:] != owner[:-1])
        start = np.flatnonzero(head)
        count = np.diff(np.append(start, len(here)))
        pieces = (count + STRETCH - 1) // STRETCH
        run = np.repeat(np.arange(len(start)), pieces)
        nth = np.arange(len(run)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
        first = start[run] + nth * STRETCH
        yield owner[first], here[first] + base, np.minimum(count[run] - nth * STRETCH, STRETCH), name[first]


def _names(data: np.ndarray, offsets: np.ndarray, length: int):
    """All stretches of a slice, and for each the number of its name among the distinct (row, name), sorted."""
    found = list(named_runs(data, offsets, length))
    row, first, windows, name = (np.concatenate([f[i] for f in found]) if found else np.zeros(0, np.int64) for i in range(4))
    name = name.astype(np.uint64)
    order = np.lexsort((name, row))
    fresh = np.ones(len(order), bool)
    fresh[1:] = (row[order[1:]] != row[order[:-1]]) | (name[order[1:]] != name[order[:-1]])
    number = np.empty(len(order), np.int64)
    number[order] = np.cumsum(fresh) - 1
    return row, first, windows, name, number, row[order[fresh]], name[order[fresh]]


# 1. Which names occur in several documents ---------------------------------------------------------------------------------

NAMES = "key long, slice long, bucket int, payload binary, docs array<bigint>, copies array<bigint>, counts array<int>"
#: Low six bytes of a name and the number of documents of the slice that have it.
_NAME = np.dtype([("low", "u1", 6), ("n", "<u2")])


def names(docs: DataFrame, length: int, buckets: int) -> DataFrame:
    """The distinct names of slices of (doc, copy, text) by bucket, with the number of documents that have them.

    One more row a slice (bucket -1) holds its documents, and for each of their names, sorted, its number among those of the slice
    in the order of the buckets. ``key`` spreads the rows. A name in very many documents is one entry a slice.
    """
    columns = [f.split()[0] for f in NAMES.split(", ")]

    def rows(number, kept):
        slice_ = (TaskContext.get().partitionId() << 24) + number
        name, which, count = np.unique(np.concatenate([k[3] for k in kept]), return_inverse=True, return_counts=True)
        bucket = (name % np.uint64(buckets)).astype(np.int64)
        order = np.argsort(bucket, kind="stable")
        rank = np.empty(len(order), np.uint32)
        rank[order] = np.arange(len(order))
        entries = np.empty(len(order), _NAME)
        entries["low"] = (name[order] // np.uint64(buckets)).view(np.uint8).reshape(-1, 8)[:, :6]
        entries["n"] = np.minimum(count[order], 0xFFFF)
        used, at = np.unique(bucket[order], return_index=True)
        blobs = [part.tobytes() for part in np.split(entries, at[1:])] if len(used) else []
        docs_, copies = (np.concatenate([k[i] for k in kept]).tolist() for i in (0, 1))
        counts = np.concatenate([k[2] for k in kept]).tolist()
        some = len(used)
        return pa.RecordBatch.from_arrays([
            pa.array([-1 - slice_, *used.tolist()], pa.int64()), pa.array([slice_] * (some + 1), pa.int64()),
            pa.array([-1, *used.tolist()], pa.int32()), pa.array([rank[which].tobytes(), *blobs], pa.binary()),
            pa.array([docs_] + [None] * some, pa.list_(pa.int64())), pa.array([copies] + [None] * some, pa.list_(pa.int64())),
            pa.array([counts] + [None] * some, pa.list_(pa.int32()))], columns)

    def run(batches):
        kept, bytes_, number = [], 0, 0
        for batch in batches:
            data, offsets = texts.text_buffers(batch.column("text"))
            doc, copy = (batch.column(c).to_numpy() for c in ("doc", "copy"))
            for first, last in texts.slices(offsets):
                cut = offsets[first : last + 1]
                _, _, _, _, _, row, name = _names(data[cut[0] : cut[-1]], cut - cut[0], length)
                kept.append((doc[first:last], copy[first:last], np.bincount(row, minlength=last - first), name))
                bytes_ += int(cut[-1] - cut[0])
                if bytes_ >= BUCKET:
                    yield rows(number, kept)
                    kept, bytes_, number = [], 0, number + 1
        if kept:
            yield rows(number, kept)

    return docs.mapInArrow(run, NAMES)


def _groups(batches, key: str) -> Iterator[pa.Table]:
    """Tables of the rows with one value of ``key``, of rows that come sorted by it."""
    tail = None
    for batch in batches:
        table = pa.Table.from_batches([batch] if tail is None else [*tail.to_batches(), batch])
        values = table.column(key).to_numpy()
        cut = np.concatenate([[0], np.flatnonzero(values[1:] != values[:-1]) + 1, [len(values)]])
        for first, last in zip(cut[:-2].tolist(), cut[1:-1].tolist()):
            yield table.slice(first, last - first)
        tail = table.slice(int(cut[-2])) if len(values) else None
    if tail is not None and tail.num_rows:
        yield tail


def counted(named: DataFrame, buckets: int, crowd: int) -> DataFrame:
    """``named`` with the payload of every bucket replaced by a byte a name: 0 one document, 1 several, 2 more than ``crowd``."""

    def run(batches):
        for table in _groups(batches, "key"):
            if table.column("bucket")[0].as_py() >= 0:
                blobs = table.column("payload").to_pylist()
                entries = np.frombuffer(b"".join(blobs), _NAME)
                low = np.zeros((len(entries), 8), np.uint8)
                low[:, :6] = entries["low"]
                _, number = np.unique(low.view(np.uint64).ravel(), return_inverse=True)
                count = np.bincount(number, entries["n"])
                told = ((count > 1).astype(np.uint8) + (count > crowd).astype(np.uint8))[number]
                at = np.cumsum([len(b) // _NAME.itemsize for b in blobs])[:-1]
                made = pa.array([part.tobytes() for part in np.split(told, at)], pa.binary())
                table = table.set_column(table.schema.get_field_index("payload"), "payload", made)
            yield from table.to_batches()

    return named.repartition(buckets, "key").sortWithinPartitions("key").mapInArrow(run, named.schema)


def masks(told: DataFrame) -> DataFrame:
    """(doc, copy, mask) of the documents with a name that others have too: a byte for each of the document's names, sorted."""

    def run(batches):
        for table in _groups(batches, "slice"):
            head = int(np.flatnonzero(table.column("bucket").to_numpy() < 0)[0])
            which = np.frombuffer(table.column("payload")[head].as_py(), np.uint32)
            parts = sorted((b, p) for b, p in zip(table.column("bucket").to_pylist(), table.column("payload").to_pylist()) if b >= 0)
            flags = np.frombuffer(b"".join(p for _, p in parts), np.uint8)[which]
            counts = table.column("counts")[head].values.to_numpy()
            at = np.concatenate([[0], np.cumsum(counts)])
            upto = np.concatenate([[0], np.cumsum(flags > 0)])
            some = np.flatnonzero(upto[at[1:]] > upto[at[:-1]])
            whole = flags.tobytes()
            yield pa.RecordBatch.from_arrays([
                pa.array(table.column("docs")[head].values.to_numpy()[some]), pa.array(table.column("copies")[head].values.to_numpy()[some]),
                pa.array([whole[at[i] : at[i + 1]] for i in some.tolist()], pa.binary())], ["doc", "copy", "mask"])

    return told.repartition("slice").sortWithinPartitions("slice").mapInArrow(run, "doc long, copy long, mask binary")


# 2. Their stretches, by shard ----------------------------------------------------------------------------------------------

STRETCHES = "shard long, stretch binary, places binary, crowd boolean"


def stretches(docs: DataFrame, length: int) -> DataFrame:
    """(shard, stretch, places, crowd) of (doc, copy, text, mask): the stretches whose name several documents have.

    Equal stretches of a slice are one row with all their places. Those of a crowded name are cut into single windows, which stand for
    themselves by a digest.
    """

    width = _PLACE.itemsize

    def rows(held, crowd):
        shards, strings, places = [], [], []
        for stretch, found in held.items():
            shards.append(found[0])
            strings.append(stretch)
            places.append(b"".join(found[1:]))
        return pa.RecordBatch.from_arrays(
            [pa.array(shards, pa.int64()), pa.array(strings, pa.binary()), pa.array(places, pa.binary()), pa.array([crowd] * len(shards))],
            [c.split()[0] for c in STRETCHES.split(", ")])

    def run(batches):
        held, hot, bytes_ = {}, {}, 0
        for batch in batches:
            data, offsets = texts.text_buffers(batch.column("text"))
            doc, copy = (batch.column(c).to_numpy() for c in ("doc", "copy"))
            mask = batch.column("mask").to_pylist()
            for first, last in texts.slices(offsets):
                cut = offsets[first : last + 1]
                part = data[cut[0] : cut[-1]]
                row, at, windows, name, number, _, _ = _names(part, cut - cut[0], length)
                flag = np.frombuffer(b"".join(mask[first:last]), np.uint8)[number]
                whole = part.tobytes()
                for kind in (1, 2):
                    live = np.flatnonzero(flag == kind)
                    place = np.empty(len(live), _PLACE)
                    place["doc"], place["copy"] = doc[first + row[live]], copy[first + row[live]]
                    place["at"] = at[live] - (cut[row[live]] - cut[0])
                    begins, stops = at[live].tolist(), (at[live] + windows[live] + (length - 1)).tolist()
                    if kind == 1:
                        encoded = place.tobytes()
                        for i, (begin, stop, shard) in enumerate(zip(begins, stops, name[live].view(np.int64).tolist())):
                            stretch = whole[begin:stop]
                            found = held.get(stretch)
                            if found is None:
                                held[stretch] = found = [shard]
                            found.append(encoded[i * width : i * width + width])
                        continue
                    for i, (begin, stop) in enumerate(zip(begins, stops)):
                        one = place[i : i + 1]
                        for step in range(begin, stop - length + 1):
                            digest = hashlib.blake2b(whole[step : step + length], digest_size=16).digest()
                            hot.setdefault(digest, [int.from_bytes(digest[:8], "little", signed=True)]).append(one.tobytes())
                            one["at"] += 1
                bytes_ += len(part)
                if bytes_ >= BUCKET // 2:
                    yield from (rows(h, h is hot) for h in (held, hot) if h)
                    held, hot, bytes_ = {}, {}, 0
        yield from (rows(h, h is hot) for h in (held, hot) if h)

    return docs.mapInArrow(run, STRETCHES)


# 3. Suffix arrays per shard ------------------------------------------------------------------------------------------------

SPANS = "doc long, copy long, begin int, end int, digest binary"


def _told(shard: Windows, occurrences: np.ndarray, counts: np.ndarray, length: int) -> pa.RecordBatch:
    """Spans of the places whose windows begin in an earlier document too."""
    least = shard.by_place()
    sizes = shard.stops - shard.starts
    which = np.repeat(np.arange(len(counts)), counts)
    inner = shard.stops - length  # the last window of a stretch
    windows = np.repeat(inner - shard.starts + 1, sizes)
    real = np.arange(len(least)) - np.repeat(shard.starts, sizes) < windows
    lowest = np.minimum.reduceat(least, shard.starts)
    highest = np.maximum.reduceat(np.where(real, least, np.iinfo(np.int64).min), shard.starts)
    all_ = highest[which] < occurrences["doc"]
    part = np.flatnonzero(~all_ & (lowest[which] < occurrences["doc"]))
    whole = occurrences[all_]
    doc, copy, begin = [whole["doc"]], [whole["copy"]], [whole["at"]]
    end = [whole["at"] + sizes[which[all_]]]
    for i in part.tolist():
        s = which[i]
        hit = np.flatnonzero(least[shard.starts[s] : inner[s] + 1] < occurrences["doc"][i])
        cut = np.flatnonzero(np.diff(hit) > 1)
        first, last = hit[np.concatenate([[0], cut + 1])], hit[np.concatenate([cut, [len(hit) - 1]])]
        doc.append(np.full(len(first), occurrences["doc"][i]))
        copy.append(np.full(len(first), occurrences["copy"][i]))
        begin.append(occurrences["at"][i] + first)
        end.append(occurrences["at"][i] + last + length)
    doc, copy, begin, end = (np.concatenate(c) for c in (doc, copy, begin, end))
    return pa.RecordBatch.from_arrays(
        [pa.array(doc, pa.int64()), pa.array(copy, pa.int64()), pa.array(begin.astype(np.int32)), pa.array(end.astype(np.int32)),
         pa.nulls(len(doc), pa.binary())], [c.split()[0] for c in SPANS.split(", ")])


def _dealt(shards: np.ndarray, sizes: np.ndarray, most: int = SHARD) -> tuple[np.ndarray, list[list[np.ndarray]]]:
    """(stretches that are alone under their name, the others in sets of whole names).

    A set has about ``most`` bytes and one part; a name beyond that is a set of its own of several parts. Equal windows have equal names, so
    sets have no window in common.
    """
    order = np.argsort(shards, kind="stable")
    head = np.ones(len(order), bool)
    head[1:] = shards[order[1:]] != shards[order[:-1]]
    begin = np.flatnonzero(head)
    many = np.diff(np.append(begin, len(order))) > 1
    alone = order[begin[~many]]
    order, head = (v[np.repeat(many, np.diff(np.append(begin, len(order))))] for v in (order, head))
    begin = np.flatnonzero(head)
    upto = np.concatenate([[0], np.cumsum(sizes[order])])
    edges, sets, first = np.append(begin, len(order)), [], 0
    while first < len(begin):
        last = max(first + 1, int(np.searchsorted(upto[edges], upto[edges[first]] + most, "right")) - 1)
        one = order[edges[first] : edges[last]]
        parts = max(1, -(-int(sizes[one].sum()) // most))
        sets.append(np.array_split(one, parts))
        first = last
    return alone, sets


def spans_of(cut: DataFrame, length: int, shards: int) -> DataFrame:
    """Spans (doc, copy, begin, end) to remove; windows of crowded names pass with their digest.

    All stretches with a name meet in one partition. The windows of a name's only stretch stand nowhere else, so its places suffice. The others
    get suffix arrays of two megabytes each; those of a name that needs several are merged by binary search.
    """

    def found(held, which):
        strings = [held[i][0] for i in which.tolist()]
        places = [b"".join(held[i][2:]) for i in which.tolist()]
        counts = np.array([len(p) // _PLACE.itemsize for p in places])
        occurrences = np.frombuffer(b"".join(places), _PLACE)
        owners = np.minimum.reduceat(occurrences["doc"], np.cumsum(counts) - counts)
        return strings, occurrences, counts, owners

    def only(held, which):
        strings, occurrences, counts, owners = found(held, which)
        sizes = np.repeat(np.array([len(s) for s in strings], np.int32), counts)
        late = occurrences["doc"] > np.repeat(owners, counts)
        some = occurrences[late]
        return pa.RecordBatch.from_arrays(
            [pa.array(some["doc"]), pa.array(some["copy"]), pa.array(some["at"]), pa.array(some["at"] + sizes[late]), pa.nulls(len(some), pa.binary())],
            [c.split()[0] for c in SPANS.split(", ")])

    def run(batches):
        held = {}
        for batch in batches:
            crowd = batch.column("crowd").to_numpy(zero_copy_only=False)
            cold = batch.filter(pa.array(~crowd))
            for shard, stretch, places in zip(*[cold.column(c).to_pylist() for c in ("shard", "stretch", "places")]):
                one = held.get(stretch)
                if one is None:
                    held[stretch] = one = [stretch, shard]
                one.append(places)
            hot = batch.filter(pa.array(crowd))
            if hot.num_rows:
                found_ = [np.frombuffer(p, _PLACE) for p in hot.column("places").to_pylist()]
                every = np.concatenate(found_)
                which = np.repeat(np.arange(len(found_)), [len(f) for f in found_])
                yield pa.RecordBatch.from_arrays(
                    [pa.array(every["doc"]), pa.array(every["copy"]), pa.array(every["at"]), pa.array(every["at"] + np.int32(length)),
                     hot.column("stretch").take(pa.array(which))], [c.split()[0] for c in SPANS.split(", ")])
        held = list(held.values())
        alone, sets = _dealt(np.array([h[1] for h in held], np.int64), np.array([len(h[0]) for h in held], np.int64))
        for i in range(0, len(alone), STRETCHED):
            yield only(held, alone[i : i + STRETCHED])
        for parts in sets:
            built = []
            for strings, occurrences, counts, owners in (found(held, which) for which in parts):
                built.append((Windows(strings, owners, length), occurrences, counts))
            merge([shard for shard, _, _ in built])
            while built:
                yield _told(*built.pop(), length)

    return cut.repartition(shards, "shard").mapInArrow(run, SPANS)


def whole_copies(rows: DataFrame, shelf: Shelf) -> DataFrame:
    """(doc, copy, n) of the rows (doc, copy, text) whose text a smaller doc has too; n is their number of bytes."""
    prints = shelf.put(rows.select("doc", "copy", F.octet_length("text").alias("n"), F.unhex(F.sha2("text", 256)).alias("digest")))
    first = shelf.put(prints.groupBy("digest").agg(F.min("doc").alias("first")))
    return shelf.put(prints.join(first.hint("merge"), "digest").where("doc > first").select("doc", "copy", "n").distinct())


def later_spans(docs: DataFrame, length: int = 50, crowd: int = CROWD, shelf: Shelf | None = None) -> DataFrame:
    """(doc, copy, spans) of the documents that lose bytes: places (begin, end) of later copies, overlapping and in any order.

    A later copy of a whole text loses all of it, and the first document with that text owns its strings, so later ones send no stretches.
    """
    if length < GRAM + 8:
        raise ValueError(f"strings of {GRAM + 8} bytes at least")
    spark = docs.sparkSession
    shelf = shelf or Shelf(spark)
    rows = docs.where(F.octet_length("text") >= length).select(*_document(), "text")
    total = rows.agg(F.sum(F.octet_length("text").cast("long"))).first()[0] or 0
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), total // BUCKET + 1)
    copies = whole_copies(rows, shelf)
    told = masks(counted(names(rows, length, parts), parts, crowd)).dropDuplicates(["doc", "copy"])
    told = shelf.put(told.join(copies.hint("merge"), ["doc", "copy"], "left_anti"))
    found = shelf.put(spans_of(stretches(rows.join(told.hint("merge"), ["doc", "copy"]), length), length, parts))
    crowded = found.where("digest is not null")
    first = shelf.put(crowded.groupBy("digest").agg(F.min("doc").alias("first")))
    late = crowded.join(first.hint("merge"), "digest").where("doc > first").select("doc", "copy", "begin", "end")
    spans = found.where("digest is null").select("doc", "copy", "begin", "end").unionByName(late).unionByName(
        copies.select("doc", "copy", F.lit(0).alias("begin"), F.col("n").alias("end")))
    return spans.groupBy("doc", "copy").agg(F.collect_list(F.struct("begin", "end")).alias("spans"))


RESULT = [
    T.StructField("n_bytes", T.LongType()), T.StructField("n_removed", T.LongType()),
    T.StructField("removed", T.ArrayType(T.StructType([T.StructField("begin", T.IntegerType()), T.StructField("end", T.IntegerType())]))),
    T.StructField("kept", T.BinaryType())]


def without_copies(docs: DataFrame, length: int = 50, crowd: int = CROWD, shelf: Shelf | None = None) -> DataFrame:
    """``docs`` with n_bytes, n_removed, ``removed`` (maximal runs of removed bytes) and ``kept``, the other bytes.

    A byte goes if a string of ``length`` bytes around it also begins in a document with a smaller doc_id; copies inside one
    document stay. ``kept`` is binary, as a cut can split a character. Null text is empty, and texts below ``length`` stay whole.
    Null doc_ids come before all others and don't lose anything to each other, nor do rows that share a doc_id. Columns of
    ``docs`` with the result's names are replaced. An empty table gives one.
    """
    base = texts.no_clash(docs, *[f.name for f in RESULT], "_doc", "_copy", "_spans")
    spans = later_spans(docs.select("doc_id", "text"), length, crowd, shelf).withColumnsRenamed(
        {"doc": "_doc", "copy": "_copy", "spans": "_spans"})
    doc, copy = _document()
    rows = base.withColumns({"_doc": doc, "_copy": copy}).join(spans.hint("merge"), ["_doc", "_copy"], "left").select(*base.columns, "_spans")
    own = base.columns

    def work(batch, data, offsets):
        spans = batch.column("_spans")
        flat = spans.flatten()
        begin, end = flat.field("begin").to_numpy(), flat.field("end").to_numpy()
        at = np.concatenate([[0], np.cumsum(spans.value_lengths().fill_null(0).to_numpy())])
        whole, kept, removed, lost = data.tobytes(), [], [], []
        for i in range(batch.num_rows):
            text = whole[offsets[i] : offsets[i + 1]]
            b, e = begin[at[i] : at[i + 1]], end[at[i] : at[i + 1]]
            order = np.argsort(b, kind="stable")
            b, e = b[order], np.maximum.accumulate(e[order]) if len(e) else e
            head = np.ones(len(b), bool)
            head[1:] = b[1:] > e[:-1]
            first = b[head].tolist()
            last = e[np.append(np.flatnonzero(head)[1:] - 1, len(e) - 1)].tolist() if len(e) else []
            kept.append(b"".join(text[x:y] for x, y in zip([0, *last], [*first, len(text)])))
            removed.append([{"begin": x, "end": y} for x, y in zip(first, last)])
            lost.append(len(text) - len(kept[-1]))
        return pa.RecordBatch.from_arrays(
            [batch.column(c) for c in own] + [pa.array(np.diff(offsets)), pa.array(lost, pa.int64()), pa.array(
                removed, pa.list_(pa.struct([("begin", pa.int32()), ("end", pa.int32())]))), pa.array(kept, pa.binary())],
            own + [f.name for f in RESULT])

    return rows.mapInArrow(texts.by_slice(work), T.StructType(base.schema.fields + RESULT))
