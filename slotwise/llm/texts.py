"""Text columns as byte arrays: slices of Arrow batches, words, hashes. All of it works on whole texts."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

SLICE_BYTES = 1 << 20
_POWER = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_STEP = np.uint64(0xD6E8FEB86659FD93)
_BYTE_VALUES = np.random.default_rng(20240607).integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_powers: list[np.ndarray] = []


def read(spark: SparkSession, sf: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{table}.parquet")


def mix(h: np.ndarray) -> np.ndarray:
    """Bijective scramble of 64-bit values."""
    h = h ^ (h >> np.uint64(32))
    h = h * np.uint64(0xD6E8FEB86659FD93)
    h = h ^ (h >> np.uint64(29))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(32))


def text_buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes and row offsets; a null text is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    wide = pa.types.is_large_string(column.type)
    _, offsets, data = column.buffers()
    kind = np.int64 if wide else np.int32
    if offsets is None or not len(column):
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    at = np.frombuffer(offsets, kind)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    bytes_ = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return bytes_[at[0] : at[-1]], at - at[0]


def slices(offsets: np.ndarray, size: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges of about ``size`` bytes; a longer text is a range of its own."""
    first, rows = 0, len(offsets) - 1
    while first < rows:
        last = int(np.searchsorted(offsets, offsets[first] + size, "right")) - 1
        last = min(max(last, first + 1), rows)
        yield first, last
        first = last


def by_slice(work: Callable, text: str = "text", size: int = SLICE_BYTES) -> Callable:
    """Function for mapInArrow: ``work(batch, data, offsets)`` on row ranges of bounded bytes gives a record batch."""

    def run(batches):
        for batch in batches:
            place = batch.schema.get_field_index(text)
            data, offsets = text_buffers(batch.column(place))
            for first, last in slices(offsets, size):
                lo, hi = offsets[first], offsets[last]
                yield work(batch.slice(first, last - first), data[lo:hi], offsets[first : last + 1] - lo)

    return run


def schema_with(df: DataFrame, *fields: T.StructField) -> T.StructType:
    return T.StructType([*df.schema.fields, *fields])


def lower_ascii(data: np.ndarray) -> np.ndarray:
    return data + ((data >= 65) & (data <= 90)).astype(np.uint8) * np.uint8(32)


def byte_table(is_word: Callable[[int], bool]) -> np.ndarray:
    return np.array([is_word(b) for b in range(256)])


#: Word bytes after lower-casing: digits, a-z and every byte of a non-ASCII character.
ALNUM = byte_table(lambda b: 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80)
#: Everything but ASCII white space.
UNSPACED = byte_table(lambda b: b != 0x20 and not 0x09 <= b <= 0x0D)


def _power_table(n: int) -> list[np.ndarray]:
    """Powers of the multiplier and of its inverse; the largest table so far is kept."""
    if not _powers or len(_powers[0]) < n:
        size = max(SLICE_BYTES + 1, 1 << int(n).bit_length())
        up, down = np.full(size, _POWER), np.full(size, _INVERSE)
        up[0] = down[0] = 1
        _powers[:] = np.multiply.accumulate(up), np.multiply.accumulate(down)
    return _powers


#: Polynomials modulo 2**64 tell short segments apart; longer ones, for which equal sums can be built, get a cryptographic hash.
SHORT = 64


def _hash_long(h: np.ndarray, data: np.ndarray, begin: np.ndarray, stop: np.ndarray) -> np.ndarray:
    """``h`` with the hashes of segments above ``SHORT`` bytes replaced."""
    for i in np.flatnonzero(stop - begin > SHORT).tolist():
        h[i] = int.from_bytes(hashlib.blake2b(data[begin[i] : stop[i]], digest_size=8).digest(), "little")
    return h


def words(data: np.ndarray, offsets: np.ndarray, table: np.ndarray, lower: bool = True):
    """Hash, first byte and end byte of every word, and word offsets of the rows.

    ``table`` tells the word bytes. Long input is hashed in pieces cut between words, so memory stays near one slice.
    """
    parts, at, n = [], 0, len(data)
    edge = np.zeros(n + 1, bool)
    edge[offsets] = True
    while at < n:
        end = min(n, at + SLICE_BYTES)
        while end < n and not edge[end] and table[_low(data[end - 1])] and table[_low(data[end])]:
            gap = np.flatnonzero(~table[lower_ascii(data[end : end + 65536])] | edge[end : end + len(data[end : end + 65536])])
            end = end + (int(gap[0]) if len(gap) else len(data[end : end + 65536]))
        parts.append(_words_of_piece(data[at:end], edge[at : end + 1], table, lower, at))
        at = end
    if parts:
        h, begin, stop = (np.concatenate([p[i] for p in parts]) for i in range(3))
    else:
        h, begin, stop = np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    return h, begin, stop, np.searchsorted(begin, offsets)


def _low(b: np.uint8) -> int:
    return int(b) + 32 if 65 <= b <= 90 else int(b)


def _words_of_piece(data, edge, table, lower, base):
    if lower:
        data = lower_ascii(data)
    inside = table[data]
    first = inside.copy()
    first[1:] &= ~inside[:-1] | edge[1:-1]
    last = inside.copy()
    last[:-1] &= ~inside[1:] | edge[1:-1]
    begin, stop = np.flatnonzero(first), np.flatnonzero(last) + 1
    up, down = _power_table(len(data) + 1)
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_BYTE_VALUES[data] * up[: len(data)], out=sums[1:])
    h = (sums[stop] - sums[begin]) * down[begin] + (stop - begin).astype(np.uint64)
    return _hash_long(mix(h), data, begin, stop), begin + base, stop + base


def segment_hash(data: np.ndarray, begin: np.ndarray, stop: np.ndarray) -> np.ndarray:
    """Hash of adjoining segments (``stop[i] == begin[i + 1]``); long input is hashed in pieces of whole segments."""
    out, i = np.zeros(len(begin), np.uint64), 0
    while i < len(begin):
        base = int(begin[i])
        j = max(i + 1, int(np.searchsorted(stop, base + SLICE_BYTES, "right")))
        part = data[base : int(stop[j - 1])]
        up, down = _power_table(len(part) + 1)
        sums = np.zeros(len(part) + 1, np.uint64)
        np.cumsum(_BYTE_VALUES[part] * up[: len(part)], out=sums[1:])
        b, e = begin[i:j] - base, stop[i:j] - base
        out[i:j] = _hash_long(mix((sums[e] - sums[b]) * down[b] + (e - b).astype(np.uint64)), part, b, e)
        i = j
    return out


def shingles(h: np.ndarray, word_offsets: np.ndarray, size: int):
    """Hash of every run of ``size`` words inside a row; a row of fewer words, but not none, is one shingle.

    Gives the hashes and their row offsets.
    """
    counts = np.diff(word_offsets)
    made = np.where(counts >= size, counts - size + 1, np.minimum(counts, 1))
    at = np.concatenate([[0], np.cumsum(made)])
    rows = np.repeat(np.arange(len(counts)), made)
    start = word_offsets[rows] + np.arange(at[-1]) - at[rows]
    length = np.minimum(counts[rows], size)
    out = length.astype(np.uint64)
    for j in range(size):
        live = length > j
        if live.all():
            out = out * _STEP + h[start + j]
        else:
            out[live] = out[live] * _STEP + h[start[live] + j]
    return mix(out), at


def sorted_distinct(values: np.ndarray, at: np.ndarray):
    """Sorted distinct values of every row, and their offsets."""
    values = values.copy()
    for first, last in zip(at[:-1].tolist(), at[1:].tolist()):
        values[first:last].sort()
    fresh = np.ones(len(values), bool)
    fresh[1:] = values[1:] != values[:-1]
    fresh[at[:-1][np.diff(at) > 0]] = True
    return values[fresh], np.concatenate([[0], np.cumsum(fresh)])[at]


def list_column(values: np.ndarray, at: np.ndarray, kind: pa.DataType) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), pa.array(values, kind))


def no_clash(df: DataFrame, *names: str) -> DataFrame:
    """Drop columns whose names the operator gives to its own results."""
    lowered = {n.lower() for n in names}
    return df.drop(*[c for c in df.columns if c.lower() in lowered])


def aside(docs: DataFrame, *used: str) -> tuple[DataFrame, list]:
    """``docs`` with every column that the operator doesn't use renamed out of the way, and columns that undo it."""
    names = {c: c if c in ("doc_id", "text", *used) else f"_own_{c}" for c in docs.columns}
    return docs.withColumnsRenamed({a: b for a, b in names.items() if a != b}), [F.col(b).alias(a) for a, b in names.items()]
