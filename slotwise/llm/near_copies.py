"""Near-duplicate documents by circulant MinHash, banding and exact Jaccard verification."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from slotwise.llm import texts
from slotwise.llm.components import components
from slotwise.llm.shelf import Shelf


@dataclass(frozen=True)
class MinHash:
    """Bands of ``rows`` coordinates; a pair of Jaccard 0.8 misses all of them with (1 - 0.8**rows)**bands = 3e-6."""

    shingle: int = 4
    bands: int = 32
    rows: int = 5
    bits: int = 20
    seed: int = 11

    @property
    def size(self) -> int:
        return self.bands * self.rows


#: Link when PART * intersection >= LEAST * union.
PART, LEAST = 100, 80
#: Buckets up to this size compare all their members; larger ones go through pivots and then the exact rest.
SMALL_BUCKET = 3


def circulant_signatures(values: np.ndarray, at: np.ndarray, p: MinHash) -> np.ndarray:
    """Signature rows of shingle sets (concatenated, row offsets ``at``).

    The first permutation scatters the shingle's place among 2**bits; coordinate k is the smallest value that the second
    permutation, shifted by k places, gives to the set. The shifted values of one place are a run of its table.
    """
    space = 1 << p.bits
    rng = np.random.default_rng(p.seed)
    first, second = rng.permutation(space).astype(np.int64), rng.permutation(space).astype(np.int32)
    ring = np.lib.stride_tricks.sliding_window_view(np.concatenate([second, second[: p.size - 1]]), p.size)
    place = first[(values >> np.uint64(64 - p.bits)).astype(np.int64)]
    out = np.full((len(at) - 1, p.size), space, np.int32)
    for row, (lo, hi) in enumerate(zip(at[:-1].tolist(), at[1:].tolist())):
        for k in range(lo, hi, 2048):
            np.minimum(out[row], ring[place[k : min(hi, k + 2048)]].min(axis=0), out=out[row])
    return out


def band_keys(signature: np.ndarray, p: MinHash) -> np.ndarray:
    """One 64-bit key per row and band."""
    blocks = signature.astype(np.uint64).reshape(len(signature), p.bands, p.rows)
    keys = np.broadcast_to(np.arange(1, p.bands + 1, dtype=np.uint64), blocks.shape[:2])
    for j in range(p.rows):
        keys = texts.mix(keys + blocks[:, :, j] * np.uint64(0x9E3779B97F4A7C15))
    return keys.view(np.int64) if keys.flags.c_contiguous else np.ascontiguousarray(keys).view(np.int64)


def shingle_sets(docs: DataFrame, p: MinHash, spaced: np.ndarray = texts.UNSPACED) -> DataFrame:
    """(doc_id, shingles): sorted distinct 64-bit shingle hashes of every row of (doc_id, text)."""

    def work(batch, data, offsets):
        h, _, _, at = texts.words(data, offsets, spaced)
        values, at = texts.sorted_distinct(*texts.shingles(h, at, p.shingle))
        return pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), texts.list_column(values.view(np.int64), at, pa.int64())], ["doc_id", "shingles"])

    schema = T.StructType([docs.schema["doc_id"], T.StructField("shingles", T.ArrayType(T.LongType(), False))])
    return docs.select("doc_id", "text").mapInArrow(texts.by_slice(work), schema)


def signed(docs: DataFrame, p: MinHash, spaced: np.ndarray = texts.UNSPACED) -> DataFrame:
    """(doc_id, n_shingles, set_key, bands): the size, a 128-bit key and the band keys of every row's shingle set."""

    def work(batch, data, offsets):
        h, _, _, at = texts.words(data, offsets, spaced)
        values, at = texts.sorted_distinct(*texts.shingles(h, at, p.shingle))
        keys = set_keys(values, at)
        bands = band_keys(circulant_signatures(values, at, p), p)
        lists = texts.list_column(bands.ravel(), np.arange(len(at)) * p.bands, pa.int64())
        return pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), pa.array(np.diff(at)), keys, lists], ["doc_id", "n_shingles", "set_key", "bands"])

    schema = T.StructType([
        docs.schema["doc_id"], T.StructField("n_shingles", T.LongType()), T.StructField("set_key", T.BinaryType()),
        T.StructField("bands", T.ArrayType(T.LongType(), False))])
    return docs.select("doc_id", "text").mapInArrow(texts.by_slice(work), schema)


def set_keys(values: np.ndarray, at: np.ndarray) -> pa.Array:
    """128 bits of each set: equal sets have equal keys."""
    out = []
    for salt in (np.uint64(0), np.uint64(0xA5A5A5A5A5A5A5A5)):
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(texts.mix(values ^ salt), dtype=np.uint64)])
        out.append(texts.mix((sums[at[1:]] - sums[at[:-1]]) + np.diff(at).astype(np.uint64)))
    both = np.stack(out, axis=1).tobytes()
    return pa.array([both[i : i + 16] for i in range(0, len(both), 16)], pa.binary())


def near_copies(docs: DataFrame, p: MinHash = MinHash(), shelf: Shelf | None = None,
                spaced: np.ndarray = texts.UNSPACED) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) for every row of ``docs`` (doc_id, text, ...).

    Equal shingle sets are one class (partial aggregates, so thousands of copies are one row per task), named by its
    smallest doc_id; only classes are banded and verified, and rows take the result of their class. See
    ``verified_links`` for large buckets.

    Null and empty texts (no words): empty set, linked with nothing, their own component. Repeated rows: the same
    class. Rows that share a doc_id but not the text: each is compared, and a link of one is a link of the doc_id.
    Null doc_id: component_id is that of equal texts with an id, or null; kept is false. Other columns are ignored.
    """
    shelf = shelf or Shelf(docs.sparkSession)
    table = shelf.put(signed(docs, p, spaced))
    classes = shelf.put(
        table.where("n_shingles > 0").groupBy("set_key")
        .agg(F.min("doc_id").alias("id"), F.first("n_shingles").alias("n"), F.first("bands").alias("bands")))
    links = verified_links(classes.where("id is not null"), docs, p, shelf, spaced)
    roots = components(links, shelf)
    label = classes.join(roots, classes.id == roots.node, "left").select("set_key", F.coalesce("root", "id").alias("root"))
    out = table.select("doc_id", "n_shingles", "set_key").join(label, "set_key", "left").select(
        "doc_id", "n_shingles",
        F.when(F.col("n_shingles") > 0, F.col("root")).otherwise(F.col("doc_id")).alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(False)))


def verified_links(classes: DataFrame, docs: DataFrame, p: MinHash, shelf: Shelf, spaced: np.ndarray) -> DataFrame:
    """Edges (a, b) between classes (id, n, bands) that share a band and whose full sets pass the threshold.

    A bucket of up to SMALL_BUCKET classes compares all its pairs. In a larger one every member meets the pivot (the
    one whose buckets are the largest in sum, then the smallest id, so copies of one text meet the same pivot in all bands, mostly
    that text itself). What a pivot may have missed is found by ``beside_pivot``, so no link between candidates is
    lost, and near copies of one text never meet pairwise. Joins with texts or sets are sort-merge joins at every size.
    """
    bands = classes.select("id", "n", F.explode("bands").alias("band"))
    sizes = bands.groupBy("band").agg(F.count(F.lit(1)).alias("size")).where("size > 1")
    sizes = shelf.put(sizes)  # then adaptive execution can split a very large bucket
    found = shelf.put(bands.join(sizes.hint("merge"), "band"))
    weights = found.groupBy("id").agg(F.sum("size").alias("weight"))
    central = found.where(F.col("size") > SMALL_BUCKET).join(weights, "id").groupBy("band").agg(
        F.max(F.struct("weight", (-F.col("id")).alias("least"))).alias("top")).select("band", (-F.col("top.least")).alias("pivot"))
    found = shelf.put(found.join(central, "band", "left"))
    small = found.where(F.col("size") <= SMALL_BUCKET).groupBy("band").agg(
        F.sort_array(F.collect_set(F.struct("id", "n"))).alias("m"))
    pairs = small.select(F.explode(F.expr(
        "flatten(transform(m, (x, i) -> transform(slice(m, i + 2, size(m)), y -> struct(x.id as a, y.id as b, x.n as na, y.n as nb))))"
    )).alias("q")).select("q.*").where(F.expr(f"a < b and {ratio('na', 'nb')}")).select("a", "b", F.lit(0).alias("star"))
    star = found.where((F.col("size") > SMALL_BUCKET) & (F.col("id") != F.col("pivot"))).select(
        F.col("pivot").alias("a"), F.col("id").alias("b"), F.lit(1).alias("star"))
    pairs = shelf.put(pairs.unionByName(star).groupBy("a", "b").agg(F.max("star").alias("star")))
    nodes = pairs.select(F.col("a").alias("doc_id")).unionByName(pairs.select(F.col("b").alias("doc_id"))).distinct()
    sets = shelf.put(shingle_sets(docs.select("doc_id", "text").join(nodes.hint("merge"), "doc_id", "left_semi"), p, spaced))
    first = shelf.put(overlaps(pairs, sets, F.when(F.col("star") == 1, F.concat(F.array_except("sa", "sb"), F.array_except("sb", "sa"))).alias("apart")))
    links = first.where(linked()).select("a", "b")
    members = first.where("star = 1")
    if members.isEmpty():
        return links
    rest = beside_pivot(members, components(links, shelf))
    rest = shelf.put(rest.join(first.select("a", "b"), ["a", "b"], "left_anti"))
    return links.unionByName(overlaps(rest, sets).where(linked()).select("a", "b"))


def beside_pivot(members: DataFrame, roots: DataFrame) -> DataFrame:
    """Pairs (a, b) that met the same pivot, that its links leave in two components, and that can still be linked.

    ``members`` has a (pivot), b, na, nb, inter and ``apart``: the shingles that only one of b and the pivot has. A link of s
    and m needs t = need(n_s, n_m) common shingles, and so at least q = t + n_pivot - inter_s - inter_m common ones in
    ``apart``. A stray s (not in the pivot's component) has inter_s < need(n_s, n_pivot), so q is at least 1 and grows
    with the distance of both from the pivot. Both sides sort ``apart`` by rarity; at the first common
    shingle both have at least q shingles left. So a prefix of each meets by a join on (pivot, shingle), and the exact q and
    the places decide there. Edits differ from copy to copy, so such meetings are few however many copies a pivot has.
    """
    label, own = roots.withColumnRenamed("node", "b"), roots.withColumnsRenamed({"node": "a", "root": "pivot_root"})
    m = members.join(label, "b", "left").join(own, "a", "left").select(
        F.col("a").alias("pivot"), F.col("b").alias("id"), F.col("nb").alias("n"), F.col("na").alias("np"), "inter", "apart",
        F.coalesce("root", "b").alias("root"), (F.coalesce("root", "b") != F.coalesce("pivot_root", "a")).alias("stray"))
    open_pivots = m.where("stray").select("pivot").distinct()
    # the least q over all partners: any member for a stray, a stray for the others
    least = F.expr(f"greatest(1, if(stray, {need('n + np')} - inter, np - inter + 1 - greatest(0, {need('np - n')})))")
    m = m.join(open_pivots, "pivot", "left_semi").withColumn("size", F.size("apart")).withColumn("keep", F.col("size") - least + 1)
    tokens = m.where("keep > 0").select("pivot", "id", "n", "np", "inter", "root", "stray", "size", "keep", F.explode("apart").alias("shingle"))
    common = tokens.groupBy("pivot", "shingle").agg(F.count(F.lit(1)).alias("times"))
    rarity = Window.partitionBy("pivot", "id").orderBy("times", "shingle")
    tokens = tokens.join(common, ["pivot", "shingle"]).withColumn("place", F.row_number().over(rarity)).where(
        "place <= keep and times > 1")
    columns = ["id", "n", "inter", "root", "size", "place"]
    s = tokens.where("stray").select("pivot", "shingle", "np", *[F.col(c).alias(f"s_{c}") for c in columns])
    other = tokens.select("pivot", "shingle", *[F.col(c).alias(f"m_{c}") for c in columns])
    left = "least(s_size - s_place, m_size - m_place) + 1"
    met = s.join(other, ["pivot", "shingle"]).where(F.expr(
        f"s_root <> m_root and {ratio('s_n', 'm_n')} and {left} >= {need('s_n + m_n')} + np - s_inter - m_inter"))
    return met.select(F.least("s_id", "m_id").alias("a"), F.greatest("s_id", "m_id").alias("b")).distinct()


def need(total: str) -> str:
    """Common shingles that a link needs when the sets have ``total`` together."""
    return f"cast(ceil(({total}) * {LEAST} / {PART + LEAST}) as int)"


def ratio(a: str, b: str) -> str:
    """Sizes that allow a link."""
    return f"{PART} * least({a}, {b}) >= {LEAST} * greatest({a}, {b})"


def overlaps(pairs: DataFrame, sets: DataFrame, *more) -> DataFrame:
    """``pairs`` with na, nb and inter on full sets; ``more`` may use the sets sa and sb."""
    left = sets.select(F.col("doc_id").alias("a"), F.col("shingles").alias("sa"))
    right = sets.select(F.col("doc_id").alias("b"), F.col("shingles").alias("sb"))
    return pairs.join(left.hint("merge"), "a").join(right.hint("merge"), "b").select(
        *[c for c in pairs.columns], F.size("sa").alias("na"), F.size("sb").alias("nb"),
        F.size(F.array_intersect("sa", "sb")).alias("inter"), *more)


def linked():
    return F.expr(f"{PART} * inter >= {LEAST} * (na + nb - inter)")


def one_of_each(docs: DataFrame, p: MinHash = MinHash(shingle=5), shelf: Shelf | None = None) -> DataFrame:
    """``docs`` without the near copies: the row whose doc_id names the component stays; rows without a doc_id stay."""
    found = near_copies(docs, p, shelf).where("doc_id is not null and not kept").select("doc_id").distinct()
    return docs.join(found.hint("merge"), "doc_id", "left_anti").select(*docs.columns)
