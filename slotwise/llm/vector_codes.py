"""Product codes of vectors: integer k-means per part; nearest entries by sorted coordinates and intersected bit masks."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from slotwise.llm import texts

#: A codebook has at most as many entries as a mask has bits.
MOST_ENTRIES = 64
_ONE = np.uint64(1)


@dataclass(frozen=True)
class Codebooks:
    """``entries``: integers by (part, entry, place in the part); components are floor(scale * x)."""

    entries: np.ndarray
    scale: int

    @property
    def dimensions(self) -> int:
        return self.entries.shape[0] * self.entries.shape[2]

    def text(self) -> str:
        return ",".join(map(str, self.entries.ravel().tolist()))


def usable(vector: Column, dimensions: Column | None = None) -> Column:
    """True for a vector with finite components only; with ``dimensions``, also of that length."""
    fine = vector.isNotNull() & F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce(fine & (F.size(vector) > 0) if dimensions is None else fine & (F.size(vector) == dimensions), F.lit(False))


def integers(column: pa.Array, dimensions: int, scale: int) -> np.ndarray:
    """Rows of floor(scale * x). Components so large that a squared distance could leave 64 bits are an error."""
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dimensions)
    whole = np.floor(flat * scale)
    if whole.size and (2 * np.abs(whole).max()) ** 2 * dimensions >= 2.0**62:
        raise OverflowError("a component is too large: its squared distances don't fit 64 bits")
    return whole.astype(np.int64)


class NearestEntry:
    """Exact nearest entry of one part's codebook.

    For each dimension the entries' coordinates are sorted, and place i carries the mask of the i entries before it. The entries
    inside a range of coordinates are two masks XORed; those inside a cube around a point are the AND over the dimensions. The
    distance to any entry bounds the nearest one, so the cube of that radius holds every candidate.
    """

    def __init__(self, entries: np.ndarray):
        self.entries = entries
        order = np.argsort(entries, axis=0, kind="stable")
        self.sorted = np.take_along_axis(entries, order, axis=0)
        bits = _ONE << order.astype(np.uint64)
        self.prefix = np.concatenate([np.zeros((1, entries.shape[1]), np.uint64), np.bitwise_or.accumulate(bits, axis=0)])
        self.widest = int(np.argmax(np.ptp(entries, axis=0)))
        self.order = order[:, self.widest]

    def candidates(self, points: np.ndarray, radius: np.ndarray) -> np.ndarray:
        """Mask of the entries inside the cube of each point."""
        mask = np.full(len(points), np.uint64(0xFFFFFFFFFFFFFFFF))
        for d in range(points.shape[1]):
            low = np.searchsorted(self.sorted[:, d], points[:, d] - radius, "left")
            high = np.searchsorted(self.sorted[:, d], points[:, d] + radius, "right")
            mask &= self.prefix[high, d] ^ self.prefix[low, d]
        return mask

    def distance(self, points: np.ndarray, which: np.ndarray) -> np.ndarray:
        return ((points - self.entries[which]) ** 2).sum(axis=1)

    def find(self, points: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Index and squared distance of the nearest entry; ties go to the lower index."""
        # the first radius: the better of the two entries beside the point in the widest dimension
        at = np.searchsorted(self.sorted[:, self.widest], points[:, self.widest])
        beside = (np.maximum(at - 1, 0), np.minimum(at, len(self.entries) - 1))
        bound = np.minimum(*[self.distance(points, self.order[place]) for place in beside])
        mask = self.candidates(points, _root(bound))
        index, best = np.zeros(len(points), np.int64), np.full(len(points), np.iinfo(np.int64).max)
        for entry in range(len(self.entries)):
            has = np.flatnonzero(mask & (_ONE << np.uint64(entry)))
            far = ((points[has] - self.entries[entry]) ** 2).sum(axis=1)
            nearer = far < best[has]
            index[has[nearer]], best[has[nearer]] = entry, far[nearer]
        return index, best


def _root(x: np.ndarray) -> np.ndarray:
    """Integer square root, rounded down."""
    root = np.sqrt(x.astype(np.float64)).astype(np.int64)
    root -= root * root > x
    return root + ((root + 1) ** 2 <= x)


def nearest(whole: np.ndarray, books: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Entry of every row and part, and summed squared distances of the rows."""
    parts, _, width = books.shape
    codes, error = np.empty((len(whole), parts), np.int64), np.zeros(len(whole), np.int64)
    for part in range(parts):
        codes[:, part], far = NearestEntry(books[part]).find(whole[:, part * width : (part + 1) * width])
        error += far
    return codes, error


def _sums(rows: DataFrame, vector: str, books: Codebooks) -> dict[tuple[int, int], tuple[int, list[int]]]:
    """Count and component sums of the rows of every (part, entry). The result has one row per entry."""
    entries, scale, dimensions = books.entries, books.scale, books.dimensions

    def work(batches):
        parts, size, width = entries.shape
        count = np.zeros((parts, size), np.int64)
        total = np.zeros((parts, size, width), np.int64)
        seen = 0
        for batch in batches:
            whole = integers(batch.column(0), dimensions, scale)
            codes, _ = nearest(whole, entries)
            for part in range(parts):
                count[part] += np.bincount(codes[:, part], minlength=size)
                for d in range(width):
                    np.add.at(total[part, :, d], codes[:, part], whole[:, part * width + d])
            seen += len(whole)
            if seen >= 1 << 40:  # before a sum can leave 64 bits
                yield from out(count, total)
                count[:], total[:], seen = 0, 0, 0
        yield from out(count, total)

    def out(count, total):
        part, entry = np.nonzero(count)
        if len(part):
            yield pa.RecordBatch.from_arrays(
                [pa.array(part, pa.int32()), pa.array(entry, pa.int32()), pa.array(count[part, entry]),
                 pa.array(total[part, entry].tolist(), pa.list_(pa.int64()))], ["part", "entry", "n", "total"])

    sums = rows.select(vector).mapInArrow(work, "part int, entry int, n long, total array<bigint>")
    width = entries.shape[2]
    exact = [F.sum(F.col("total")[d].cast("decimal(38,0)")).alias(f"d{d}") for d in range(width)]
    found = sums.groupBy("part", "entry").agg(F.sum(F.col("n").cast("decimal(38,0)")).alias("n"), *exact).collect()
    return {(r.part, r.entry): (int(r.n), [int(r[f"d{d}"]) for d in range(width)]) for r in found}


def fit(rows: DataFrame, vector: str = "embedding", key: str = "vec_id", parts: int = 16, entries: int = MOST_ENTRIES,
        rounds: int = 2, scale: int = 256) -> Codebooks | None:
    """Codebooks of integer k-means on every row, or None if no row is usable.

    The first entries are the parts of the rows with the smallest keys (null keys last, equal ones by their components). Each
    round puts every row to its nearest entries and replaces them by floor(sum / count); entries that no row takes stay. The
    driver sees one row per entry. Vectors of another length than the first row's are not usable.
    """
    if entries > MOST_ENTRIES:
        raise ValueError(f"a codebook has {MOST_ENTRIES} entries at most")
    ordered = rows.where(usable(F.col(vector))).select(key, F.col(vector).cast("array<double>").alias("v"))
    head = ordered.orderBy(F.col(key).asc_nulls_last(), "v").limit(1).first()
    if head is None:
        return None
    dimensions = len(head.v)
    if dimensions % parts:
        raise ValueError(f"{dimensions} components can't be cut into {parts} equal parts")
    first = ordered.where(F.size("v") == dimensions).orderBy(F.col(key).asc_nulls_last(), "v").limit(entries).collect()
    whole = integers(pa.array([r.v for r in first], pa.list_(pa.float64())), dimensions, scale)
    books = Codebooks(whole.reshape(len(first), parts, -1).transpose(1, 0, 2).copy(), scale)
    kept = rows.where(usable(F.col(vector), F.lit(dimensions))).select(F.col(vector).cast("array<double>").alias(vector))
    for _ in range(rounds):
        renewed = books.entries.copy()
        for (part, entry), (n, total) in _sums(kept, vector, books).items():
            renewed[part, entry] = [t // n for t in total]
        books = Codebooks(renewed, scale)
    return books


def encode(rows: DataFrame, books: Codebooks | None, vector: str = "embedding") -> DataFrame:
    """The usable rows with ``code`` (binary, one byte a part: its entry) and ``error`` (summed squared distances).

    Columns of ``rows`` with the result's names are replaced; repeated rows have equal codes. Without codebooks there are no rows.
    """
    base = texts.no_clash(rows, "code", "error", "_whole")
    schema = T.StructType(base.schema.fields + [T.StructField("code", T.BinaryType()), T.StructField("error", T.LongType())])
    if books is None:
        return base.withColumns({"code": F.lit(None).cast("binary"), "error": F.lit(None).cast("long")}).limit(0)
    kept = base.where(usable(F.col(vector), F.lit(books.dimensions))).withColumn("_whole", F.col(vector).cast("array<double>"))
    own, entries, scale, dimensions = base.columns, books.entries, books.scale, books.dimensions

    def work(batches):
        for batch in batches:
            codes, error = nearest(integers(batch.column("_whole"), dimensions, scale), entries)
            bytes_ = [r.tobytes() for r in codes.astype(np.uint8)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(c) for c in own] + [pa.array(bytes_, pa.binary()), pa.array(error)], own + ["code", "error"])

    return kept.mapInArrow(work, schema)


def decode(coded: DataFrame, books: Codebooks, name: str = "decoded") -> DataFrame:
    """``coded`` with the vector that its ``code`` stands for: the entries' integers over the scale, at the middle of their steps."""
    entries, scale = books.entries, books.scale
    base = texts.no_clash(coded, name)
    own = base.columns
    schema = T.StructType(base.schema.fields + [T.StructField(name, T.ArrayType(T.DoubleType()))])

    def work(batches):
        for batch in batches:
            codes = np.array([list(c) for c in batch.column("code").to_pylist()], np.int64).reshape(batch.num_rows, -1)
            vectors = np.concatenate([entries[p][codes[:, p]] for p in range(entries.shape[0])], axis=1)
            made = pa.array(((vectors + 0.5) / scale).tolist(), pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([batch.column(c) for c in own] + [made], own + [name])

    return base.mapInArrow(work, schema)
