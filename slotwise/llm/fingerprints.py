"""Bottom-k fingerprints of documents, with DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Words of a shingle, and hashes that a fingerprint keeps at most.
SHINGLE, SIZE = 5, 128
#: Word separators: ASCII white space.
SPACES = r"[ \t\n\x0B\f\r]+"


def bound(value: Column, body) -> Column:
    """``body(value)`` with the value computed once, however often the body uses it."""
    return F.get(F.transform(F.array(value), body), 0)


def sketch(text: Column, size: int = SIZE, shingle: int = SHINGLE) -> Column:
    """The ``size`` smallest distinct 64-bit hashes of the text's shingles, ascending.

    Words are lower-cased stretches without white space. Fewer words than a shingle, but not none, are one shingle; null and
    empty texts have an empty sketch. Fewer than ``size`` hashes are the whole set.
    """
    words = F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), SPACES), lambda w: w != "")
    runs = bound(F.transform(words, lambda w: F.xxhash64(w)), lambda h: _runs(h, shingle))
    return F.slice(F.sort_array(F.array_distinct(runs)), 1, size)


def _runs(h: Column, shingle: int) -> Column:
    starts = F.when(F.size(h) == 0, F.array().cast("array<int>")).otherwise(
        F.sequence(F.lit(0), F.greatest(F.size(h) - F.lit(shingle), F.lit(0))))
    return F.transform(starts, lambda i: F.xxhash64(*[F.get(h, i + j) for j in range(shingle)]))


def resemblance(a: Column, b: Column, size: int = SIZE) -> Column:
    """Estimated Jaccard similarity of the shingle sets: share of the union's bottom-k that both sketches hold."""
    union = F.slice(F.sort_array(F.array_union(a, b)), 1, size)
    return bound(union, lambda u: F.when(F.size(u) == 0, F.lit(1.0)).otherwise(
        F.size(F.array_intersect(u, F.array_intersect(a, b))) / F.size(u)))


def distinct_count(a: Column, size: int = SIZE) -> Column:
    """Estimated number of distinct shingles: exact below ``size``, else (k - 1) over the k-th hash's place in (0, 1)."""
    place = (F.element_at(a, size).cast("double") + F.lit(2.0**63)) / F.lit(2.0**64)
    return F.when(F.size(a) < size, F.size(a).cast("double")).otherwise(F.lit(size - 1.0) / place)


def containment(a: Column, b: Column, size: int = SIZE) -> Column:
    """Estimated share of a's shingles that b has."""
    j = resemblance(a, b, size)
    shared = j / (1 + j) * (distinct_count(a, size) + distinct_count(b, size))
    return F.when(F.size(a) == 0, F.lit(1.0)).otherwise(F.least(F.lit(1.0), shared / distinct_count(a, size)))


def merged(parts: DataFrame, keys: list[str], column: str = "sketch", size: int = SIZE) -> DataFrame:
    """Sketch of the union per key: (keys, ``column``). Rows with a null or empty sketch add nothing.

    Distinct hashes are ranked per key with a limit that Spark applies before the shuffle too, so a key with many parts
    sends at most ``size`` hashes per task.
    """
    hashes = parts.select(*keys, F.explode(column).alias("_hash")).distinct()
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy("_hash"))
    kept = hashes.withColumn("_rank", rank).where(F.col("_rank") <= size)
    return kept.groupBy(*keys).agg(F.sort_array(F.collect_list("_hash")).alias(column))


def printed(a: Column) -> Column:
    """Sketch as text: hexadecimal hashes with colons."""
    return F.array_join(F.transform(a, lambda h: F.lower(F.hex(h))), ":")


#: Most ranges of doc_id; the two-step search below keeps the plan's literals and each row's work small.
MAX_RANGES = 32768


def order():
    """Order inside a range: descending doc_id, then the rows that come from the neighbour range."""
    return Window.partitionBy("range").orderBy("halo", F.col("doc_id").desc_nulls_last(), F.col("text").desc_nulls_last())


def ranged(docs: DataFrame, range_bytes: int = 2 << 20) -> DataFrame:
    """(doc_id, text, range, halo) such that within a range, by ``order``, each row with halo 0 precedes its next document.

    The next document is the next one by descending doc_id, and the first one after the last. Cut points are doc_ids of
    the table (approximate quantiles), so rows at a cut are known where they are read and also go to the range
    above, with halo 1; the first document goes to the lowest range, with halo 1. Texts are shuffled once, by the
    window that uses the ranges.
    """
    size = docs.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).alias("n"), F.max("doc_id").alias("top")).first()
    count = max(1, min(MAX_RANGES, -(-int(size["n"]) // range_bytes)))
    cuts: list[int] = []
    if count > 1 and size["top"] is not None:
        shares = [i / count for i in range(1, count)]
        cuts = sorted(set(docs.agg(F.percentile_approx("doc_id", shares, 10 * count)).first()[0]) - {size["top"]})
    place = _place(F.col("doc_id"), cuts)
    here = F.struct(place.alias("range"), F.lit(0).alias("halo"))
    # a cut is the largest doc_id of its range: it follows the smallest one of the range above
    above = F.struct((place + 1).alias("range"), F.lit(1).alias("halo"))
    lowest = F.struct(F.lit(0).alias("range"), F.lit(1).alias("halo"))
    targets = F.when(F.col("doc_id").isin(cuts), F.array(here, above)) if cuts else F.when(F.lit(False), F.array(here))
    if size["top"] is None:  # no document has a doc_id: the first one is that of the greatest text
        first = docs.agg(F.max("text").alias("t")).first()["t"]
        targets = targets.when(F.col("text").eqNullSafe(F.lit(first)), F.array(here, lowest))
    else:
        targets = targets.when(F.col("doc_id") == F.lit(size["top"]), F.array(here, lowest))
    return docs.select("doc_id", "text", F.explode(targets.otherwise(F.array(here))).alias("t")).select("doc_id", "text", "t.*")


def _place(value: Column, cuts: list[int]) -> Column:
    """Number of cuts below the value (null: 0), by a coarse step and a fine step over literal arrays."""
    if not cuts:
        return F.lit(0)
    step = max(1, round(len(cuts) ** 0.5))
    blocks = [cuts[i : i + step] for i in range(0, len(cuts), step)]
    coarse = F.size(F.filter(F.lit([b[-1] for b in blocks]).cast("array<bigint>"), lambda c: c < value))
    fine = F.get(F.array(*[F.lit(b).cast("array<bigint>") for b in blocks]), coarse)
    inner = F.when(coarse < len(blocks), F.size(F.filter(fine, lambda c: c < value))).otherwise(F.lit(0))
    return F.when(value.isNull(), F.lit(0)).otherwise(F.least(coarse * step + inner, F.lit(len(cuts))))


def with_edited(docs: DataFrame, range_bytes: int = 2 << 20) -> DataFrame:
    """Fingerprints of every document, of its edited text, and its likeness to that and to the next document.

    (doc_id, n_chars, edited, sketch, edited_sketch, next_sketch) with sketches as arrays. The edited text has its
    last floor(n / 2) code points replaced by the first as many of the next document by descending doc_id (after the
    last: the first). Null texts are empty. Null doc_ids come last, rows with equal doc_ids by descending text;
    other columns are ignored.
    """
    text, following = F.coalesce("text", F.lit("")), F.coalesce("next_text", F.lit(""))
    half = F.floor(F.col("n_chars") / 2).cast("int")
    rows = ranged(docs, range_bytes)
    rows = rows.select("*", F.char_length(text).alias("n_chars"), F.lead("text").over(order()).alias("next_text"))
    rows = rows.select(
        "range", "halo", "doc_id", "text", "n_chars", sketch(F.col("text")).alias("sketch"),
        F.concat(F.substring(text, F.lit(1), F.col("n_chars") - half), F.substring(following, F.lit(1), half)).alias("edited"))
    rows = rows.select("*", F.lead("sketch").over(order()).alias("next_sketch")).where("halo = 0")
    return rows.select("doc_id", F.col("n_chars").cast("long").alias("n_chars"), "edited", "sketch",
                       sketch(F.col("edited")).alias("edited_sketch"), "next_sketch")
