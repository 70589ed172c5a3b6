"""Order statistics of sliding frames: one rank index per block of slots answers every frame in the same number of steps."""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from slotwise.operators.blocks import DEFAULT_BLOCK, block_of


class RankIndex:
    """The k-th smallest of any range of a sequence in one step per binary digit of the number of distinct values.

    Values are replaced by their ranks, whose digits are split off from the highest on: each level keeps, for every place, how many
    zeros stand before it, and moves its zeros before its ones. A range stays a range on every level. Missing values are left out;
    ranges are given by places of the whole sequence.
    """

    def __init__(self, values: np.ndarray):
        there = np.isfinite(values)
        self.upto = np.concatenate([[0], np.cumsum(there)])
        self.sorted, code = np.unique(values[there], return_inverse=True)
        self.zeros = []
        for shift in range(max(0, len(self.sorted) - 1).bit_length() - 1, -1, -1):
            one = (code >> shift & 1).astype(bool)
            self.zeros.append(np.concatenate([[0], np.cumsum(~one)]))
            code = np.concatenate([code[~one], code[one]])

    def count(self, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
        return self.upto[end] - self.upto[begin]

    def kth(self, begin: np.ndarray, end: np.ndarray, k: np.ndarray) -> np.ndarray:
        """The value with ``k`` smaller ones in [begin, end); NaN where there are no more than k values."""
        if not len(self.sorted):
            return np.full(len(begin), np.nan)
        low, high = self.upto[begin], self.upto[end]
        outside = (k < 0) | (k >= high - low)
        k, code = np.where(outside, 0, k), np.zeros(len(low), np.int64)
        for zeros in self.zeros:
            a, b = zeros[low], zeros[high]
            left = k < b - a
            low, high = np.where(left, a, zeros[-1] + low - a), np.where(left, b, zeros[-1] + high - b)
            k = np.where(left, k, k - (b - a))
            code = code * 2 + ~left
        return np.where(outside, np.nan, self.sorted[np.minimum(code, len(self.sorted) - 1)])

    def percentile(self, begin: np.ndarray, end: np.ndarray, share: float) -> np.ndarray:
        """Interpolated between the two values beside place (n - 1) * share."""
        place = (self.count(begin, end) - 1) * share
        under, over = np.floor(place).astype(np.int64), np.ceil(place).astype(np.int64)
        a, b = self.kth(begin, end, under), self.kth(begin, end, over)
        return np.where(a == b, a, (over - place) * a + (place - under) * b)


def frame(n: int, back: int, ahead: int = -1) -> tuple[np.ndarray, np.ndarray]:
    """Begin and end of the frame of every row, from ``back`` rows before it to ``ahead`` rows after it, cut at the ends."""
    at = np.arange(n)
    return np.clip(at - back, 0, n), np.clip(at + ahead + 1, 0, n)


def by_block(
    df: DataFrame, keys: Sequence[str], work: Callable[[dict[str, np.ndarray], int], dict[str, np.ndarray]], columns: Sequence[str],
    added: Sequence[tuple[str, T.DataType]], back: int, order: str = "pos", block: int | None = None,
) -> DataFrame:
    """``df`` with the columns that ``work`` makes of ``columns``, as arrays in the order of a block of slots.

    A block comes with the ``back`` slots before it, which are dropped afterwards; a task holds one block, never a series. Missing
    values are NaN on both sides; integer results have none.
    """
    size = max(block or DEFAULT_BLOCK, back, 1)
    here = block_of(order, size)
    spread = df.withColumn("_blk", F.explode(F.array_distinct(F.array(here, block_of(F.col(order) + back, size)))))
    schema = T.StructType([*df.schema.fields, *[T.StructField(n, t) for n, t in added]])
    schema_, own = to_arrow_schema(schema), df.columns

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by(order)
        number = table.column("_blk")[0].as_py()
        arrays = {c: table.column(c).cast(pa.float64()).to_numpy() for c in columns}
        made = work(arrays, table.num_rows)
        kept = table.column(order).to_numpy() // size == number
        out = table.select(own)
        for name, kind in added:
            values = made[name]
            missing = np.isnan(values) if values.dtype.kind == "f" else None
            out = out.append_column(name, pa.array(values, schema_.field(name).type, mask=missing))
        return out.filter(pa.array(kept)).cast(schema_)

    return spread.groupBy(*keys, "_blk").applyInArrow(run, schema)
