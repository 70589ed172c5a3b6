"""Exact nearest neighbours by a pivot index: rows lie in the cell of their nearest pivot, queries visit only cells that can win."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.window import Window

from slotwise.operators.blocks import beside, join_small
from slotwise.session import stored

#: Pieces that a key's rows are cut into, unless a piece gets more than ``PIECE`` vector components or too few rows: a query that
#: has to see all pieces is sent a fixed number of times, and not once for every so many rows.
PIECES, PIECE = 16, 1 << 22
#: Pivots a key has at most; a key has about one for every piece.
MOST_PIVOTS = 4096
#: Distances that a task holds at once, and pairs that it measures exactly at once.
TILE, EXACT = 1 << 21, 1 << 16
#: Distances computed in another order differ by less than this share.
SLACK = 1e-9


def _matrix(column: pa.ChunkedArray) -> np.ndarray:
    column = column.combine_chunks()
    return column.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(len(column), -1) if len(column) else np.zeros((0, 0))


def _gaps(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Distances of all rows of ``a`` and ``b``, as one matrix product."""
    square = (a * a).sum(axis=1)[:, None] + (b * b).sum(axis=1)[None] - 2.0 * (a @ b.T)
    return np.sqrt(np.maximum(square, 0.0))


def _meet(rows: DataFrame, small: DataFrame, keys: Sequence[str]) -> DataFrame:
    return join_small(rows, small, keys, ready=True) if keys else beside(rows, small)


def pieces(rows: DataFrame, keys: Sequence[str], chunk: int, name: str) -> DataFrame:
    """(keys, _n, name): rows of a key, and the number of pieces for them. Pieces hold ``chunk`` rows at least; beyond ``PIECES`` pieces
    they grow with the key, up to ``PIECE`` vector components."""
    n, width = F.count(F.lit(1)), F.greatest(F.max(F.size("_v")), F.lit(1))
    wanted = F.greatest(F.lit(PIECES), F.ceil(n * width / F.lit(PIECE)))
    return rows.groupBy(*keys).agg(n.alias("_n"), F.least(F.ceil(n / F.lit(chunk)), wanted).cast("int").alias(name))


def pivots_of(rows: DataFrame, keys: Sequence[str], chunk: int) -> DataFrame:
    """(keys, pivots, _parts, _n): vectors of the rows with a small hash, the number of the key's pieces and of its rows."""
    drawn = F.pmod(F.xxhash64("_id", F.lit(17)), F.lit(1 << 40)) / F.lit(float(1 << 40))
    sizes = stored(pieces(rows, keys, chunk, "_parts"))
    share = F.least("_parts", F.lit(MOST_PIVOTS)) / F.col("_n")
    held = _meet(rows.withColumn("_draw", drawn), sizes, keys)
    few = F.sort_array(F.collect_list(F.when(F.col("_draw") < share, F.struct("_draw", "_v"))))
    found = held.groupBy(*keys).agg(
        few.alias("_few"), F.min_by("_v", F.struct("_draw", "_id")).alias("_one"), F.first("_parts").alias("_parts"),
        F.first("_n").alias("_n"))
    return found.select(*keys, F.when(F.size("_few") > 0, F.col("_few._v")).otherwise(F.array("_one")).alias("pivots"), "_parts", "_n")


class Atlas:
    """Pivots and cells of one key, as the tasks see them."""

    def __init__(self, row: dict):
        self.pivots = np.array(row["pivots"], float)
        count, low, high = (np.zeros(len(self.pivots)) for _ in range(3))
        self.parts = np.zeros(len(self.pivots), int)
        for cell in row["cells"]:
            i = cell["_cell"]
            count[i], low[i], high[i], self.parts[i] = cell["n"], cell["low"], cell["high"], cell["parts"]
        self.count, self.low, self.high = count, low, high

    def home(self, gap: np.ndarray, wanted: int) -> np.ndarray:
        """True where a cell is among the nearest ones that hold ``wanted`` rows together."""
        order = np.argsort(gap, axis=1, kind="stable")
        held = self.count[order]
        before = np.cumsum(held, axis=1) - held
        out = np.zeros(gap.shape, bool)
        np.put_along_axis(out, order, (before < wanted) & (held > 0), axis=1)
        return out

    def least(self, gap: np.ndarray) -> np.ndarray:
        """What the distance to any row of a cell is at least: by the cell's ring around its pivot, and by the bisector to the nearest pivot."""
        ring = np.maximum(gap - self.high, self.low - gap)
        first = gap.argmin(axis=1)
        between = _gaps(self.pivots, self.pivots)[first]
        near = np.take_along_axis(gap, first[:, None], axis=1)
        with np.errstate(divide="ignore", invalid="ignore"):
            side = np.where(between > 1e-6, (gap**2 - near**2) / (2.0 * between), 0.0)
        return np.maximum(np.maximum(ring, side), 0.0) - SLACK * (1.0 + gap)


def _chunk(parts: str) -> Column:
    return F.pmod(F.xxhash64("_id"), F.col(parts)).cast("int")


class PivotIndex:
    """Index of (keys, ident, vector): stored cells in parts of at most a piece, and one atlas row per key.

    A key's rows pass in pieces by a hash of the identity beside the key's pivots, so a key with most rows is spread. The index is
    exact for any data; what it saves depends on how clustered they are. Rows with a null vector are left out.
    """

    def __init__(self, rows: DataFrame, keys: Sequence[str], vector: str, ident: str, chunk: int = 4096):
        self.keys, self.chunk, self.id_type = list(keys), chunk, rows.schema[ident].dataType
        base = self._side(rows, vector, ident)
        both = stored(pivots_of(base, self.keys, chunk))
        schema = T.StructType([*base.schema.fields, T.StructField("_cell", T.IntegerType()), T.StructField("_gap", T.DoubleType())])

        def place(rows: pa.Table, beside_: pa.Table) -> pa.Table:
            if not rows.num_rows or not beside_.num_rows:
                return schema_.empty_table()
            gap = _gaps(_matrix(rows.column("_v")), np.array(beside_.column("pivots")[0].as_py(), float))
            cell = gap.argmin(axis=1)
            out = rows.drop_columns(["_salt"]).append_column("_cell", pa.array(cell.astype(np.int32)))
            return out.append_column("_gap", pa.array(np.take_along_axis(gap, cell[:, None], axis=1)[:, 0]))

        schema_ = to_arrow_schema(schema)
        self.placed = stored(self._cogroup(base, both, place, schema))
        cells = self.placed.groupBy(*self.keys, "_cell").agg(
            F.count(F.lit(1)).alias("n"), F.min("_gap").alias("low"), F.max("_gap").alias("high"))
        cells = _meet(cells, both.select(*self.keys, "_parts", "_n"), self.keys).withColumn(
            "parts", F.ceil(F.col("n") * F.col("_parts") / F.col("_n")).cast("int"))
        listed = cells.groupBy(*self.keys).agg(F.collect_list(F.struct("_cell", "n", "low", "high", "parts")).alias("cells"))
        pivots = both.select(*self.keys, "pivots")
        self.atlas = stored(pivots.join(listed, self.keys) if self.keys else beside(pivots, listed))
        parts = self.atlas.select(*self.keys, F.explode("cells").alias("_c"))
        self.cells = stored(parts.select(*self.keys, F.col("_c._cell").alias("_cell"), F.col("_c.parts").alias("_parts")))

    def _side(self, rows: DataFrame, vector: str, ident: str) -> DataFrame:
        # fresh column identities: both sides usually come from the same table; single precision travels as it is
        kind = "array<float>" if rows.schema[vector].dataType.elementType == T.FloatType() else "array<double>"
        return rows.where(F.col(vector).isNotNull()).select(
            *[F.col(c).alias(c) for c in self.keys], F.col(ident).alias("_id"), F.col(vector).cast(kind).alias("_v"))

    def _cogroup(self, rows: DataFrame, table: DataFrame, work, schema: T.StructType) -> DataFrame:
        """``work`` on every piece of a key's rows beside the key's row of ``table``, which has ``_parts`` pieces."""
        parts = table.select(*self.keys, "_parts")
        salted = _meet(rows, parts, self.keys).withColumn("_salt", _chunk("_parts")).drop("_parts")
        copies = table.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.col("_parts") - 1))).drop("_parts")
        group = [*self.keys, "_salt"]
        return salted.groupBy(*group).cogroup(copies.groupBy(*group)).applyInArrow(work, schema)

    def _routed(self, asked: DataFrame, table: DataFrame, k: int, bounded: bool) -> DataFrame:
        """``asked`` (keys, _id, _v, _bound) with _cell and _part: one row for each part of each cell that a query visits.

        Without ``bounded`` the nearest cells that hold ``k`` rows, else all cells that may hold a row within ``_bound``.
        """
        schema = T.StructType([*asked.schema.fields, T.StructField("_cell", T.IntegerType()), T.StructField("_part", T.IntegerType())])
        schema_, names = to_arrow_schema(schema), asked.columns

        def route(rows: pa.Table, beside_: pa.Table) -> pa.Table:
            if not rows.num_rows or not beside_.num_rows:
                return schema_.empty_table()
            atlas = Atlas(beside_.to_pylist()[0])
            gap = _gaps(_matrix(rows.column("_v")), atlas.pivots)
            if bounded:
                visit = (atlas.count > 0) & (atlas.least(gap) <= rows.column("_bound").to_numpy()[:, None])
            else:
                visit = atlas.home(gap, k)
            row, cell = np.nonzero(visit)
            times = atlas.parts[cell]
            row, cell = np.repeat(row, times), np.repeat(cell, times)
            part = np.arange(len(row)) - np.repeat(np.cumsum(times) - times, times)
            out = rows.select(names).take(pa.array(row))
            return out.append_column("_cell", pa.array(cell.astype(np.int32))).append_column("_part", pa.array(part.astype(np.int32)))

        return self._cogroup(asked, table, route, schema)

    def _visited(self, routed: DataFrame, k: int, same: bool) -> DataFrame:
        """(keys, query, neighbour, distance): the k best of every part that a query visits.

        The queries of a part are cut into pieces as well, and a task measures one piece against one part, tile by tile.
        """
        ids = T.StructType([
            *[routed.schema[c] for c in self.keys], T.StructField("query", self.id_type), T.StructField("neighbour", self.id_type),
            T.StructField("distance", T.DoubleType())])
        keys = self.keys
        schema_ = to_arrow_schema(ids)

        def best(asked: pa.Table, held: pa.Table) -> pa.Table:
            if not asked.num_rows or not held.num_rows:
                return schema_.empty_table()
            x, y = _matrix(asked.column("_v")), _matrix(held.column("_v"))
            bound = asked.column("_bound").to_numpy()
            names, own = held.column("_id").combine_chunks(), asked.column("_id").combine_chunks()
            order = np.argsort(names.to_numpy(zero_copy_only=False), kind="stable")
            y, names = y[order], names.take(pa.array(order))
            mine, theirs = own.to_numpy(zero_copy_only=False), names.to_numpy(zero_copy_only=False)
            take = min(k + (0 if same else 1), len(y))
            # a matrix product only orders roughly: whatever may be among the best is measured exactly
            slack = 1e-6 * (1.0 + np.sqrt(np.maximum((x * x).sum(axis=1).max(), (y * y).sum(axis=1).max())))
            found = []
            step = max(TILE // len(y), 1)
            for begin in range(0, len(x), step):
                rough = _gaps(x[begin : begin + step], y)
                last = bound[begin : begin + step]
                if not np.isfinite(last).all() or (np.count_nonzero(rough <= last[:, None] + slack) > 4 * take * len(rough)):
                    last = np.minimum(last, np.partition(rough, take - 1, axis=1)[:, take - 1])
                q, c = np.nonzero(rough <= last[:, None] + slack)
                gap = np.empty(len(q))
                for i in range(0, len(q), EXACT):
                    j = slice(i, i + EXACT)
                    gap[j] = np.sqrt(((x[q[j] + begin] - y[c[j]]) ** 2).sum(axis=1))
                q = q + begin
                if not same:
                    differ = mine[q] != theirs[c]
                    q, c, gap = q[differ], c[differ], gap[differ]
                by = np.lexsort((c, gap, q))
                q, c, gap = q[by], c[by], gap[by]
                kept = np.arange(len(q)) - np.searchsorted(q, q) < k
                found.append((q[kept], c[kept], gap[kept]))
            q, c, gap = (np.concatenate(columns) for columns in zip(*found))
            parts = [asked.column(n).combine_chunks().take(pa.array(q)) for n in keys]
            return pa.Table.from_arrays([*parts, own.take(pa.array(q)), names.take(pa.array(c)), pa.array(gap)], schema=schema_)

        at = [*self.keys, "_cell", "_part"]
        load = stored(pieces(routed, at, self.chunk, "_times").drop("_n"))
        asked = join_small(routed, load, at, ready=True).withColumn("_slice", _chunk("_times")).drop("_times")
        held = join_small(self.placed, self.cells, [*self.keys, "_cell"], ready=True).withColumn("_part", _chunk("_parts"))
        held = join_small(held.select(*at, "_id", "_v"), load, at, ready=True).withColumn("_slice", F.explode(F.sequence(F.lit(0), F.col("_times") - 1)))
        group = [*at, "_slice"]
        return asked.select(*group, "_id", "_v", "_bound").groupBy(*group).cogroup(
            held.select(*group, "_id", "_v").groupBy(*group)).applyInArrow(best, ids)

    def nearest(self, queries: DataFrame, k: int, vector: str, ident: str, same: bool = True) -> DataFrame:
        """(keys, query, neighbour, distance, rank) of the k nearest rows; ties go to the smaller identity.

        Queries first visit the nearest cells that hold k rows. The k-th distance found there bounds what may be nearer, and they
        visit the cells that reach below it. ``self.visits`` tells the rows sent, as (keys, _id, _v, _bound, _cell, _part).
        """
        asked = self._side(queries, vector, ident).withColumn("_bound", F.lit(float("inf")))
        wanted = k if same else k + 1
        sizes = pieces(asked, self.keys, self.chunk, "_parts").drop("_n")
        table = stored(self.atlas.join(sizes, self.keys) if self.keys else beside(self.atlas, sizes))
        # vectors travel with their visits and are not stored with them: the routes are worked out again for every pass
        first = self._routed(asked, table, wanted, False)
        found = self._visited(first, k, same)
        self.visits = (first,)
        if self.cells.count() > self.atlas.count():  # else every key is one cell, which its queries have seen
            bound = stored(found.groupBy(*self.keys, F.col("query").alias("_id")).agg(
                F.get(F.sort_array(F.collect_list("distance")), F.lit(k - 1)).alias("_bound")))
            left = asked.drop("_bound").join(bound, [*self.keys, "_id"], "left").withColumn(
                "_bound", F.coalesce("_bound", F.lit(float("inf")))).select(*asked.columns)
            later = self._routed(left, table, wanted, True)
            self.visits = (first, later)
            found = self._visited(later, k, same)
        order = Window.partitionBy(*self.keys, "query").orderBy("distance", "neighbour")
        return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def nearest(
    queries: DataFrame, candidates: DataFrame, keys: Sequence[str], k: int, vector: str = "pattern", ident: str = "pos",
    chunk: int = 4096, same: bool = True,
) -> DataFrame:
    """Exact k nearest candidates of every query: (keys, query, neighbour, distance, rank).

    With ``same`` False a query is not its own neighbour. Identities are unique within a key.
    """
    return PivotIndex(candidates, keys, vector, ident, chunk).nearest(queries, k, vector, ident, same)
