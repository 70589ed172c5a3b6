"""Language of a text: multinomial naive Bayes over hashed character n-grams."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from slotwise.llm import texts

#: Result for a text without a letter.
UNDETERMINED = "und"
#: The model is (buckets x languages); more labels than this are refused, which bounds what is broadcast (64 MB).
MAX_LANGUAGES = 256


@dataclass(frozen=True)
class Grams:
    sizes: tuple[int, ...] = (1, 2, 3, 4)
    bits: int = 15
    smoothing: float = 0.5

    @property
    def buckets(self) -> int:
        return 1 << self.bits


@dataclass
class Model:
    languages: list[str]
    prior: np.ndarray
    logs: np.ndarray
    grams: Grams


_tables: list[np.ndarray] = []


def _letters() -> tuple[np.ndarray, np.ndarray]:
    """Per code point: whether it is a letter, and its lower case (where that is one character)."""
    if not _tables:
        chars = [chr(c) if not 0xD800 <= c < 0xE000 else " " for c in range(0x110000)]
        is_letter = np.fromiter((c.isalpha() for c in chars), bool, len(chars))
        lower = np.arange(len(chars), dtype=np.uint32)
        for c in np.flatnonzero(is_letter).tolist():
            small = chars[c].lower()
            if len(small) == 1:
                lower[c] = ord(small)
        _tables[:] = is_letter, lower
    return tuple(_tables)


def code_points(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    points = np.frombuffer(data.tobytes().decode("utf-8").encode("utf-32-le"), np.uint32)
    starts = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])
    return points, starts[offsets]


def gram_buckets(data: np.ndarray, offsets: np.ndarray, grams: Grams):
    """Bucket and row of every n-gram, size by size, and whether the row has a letter.

    Letters are lower-cased; each stretch of other characters is one space, also at the ends of a text. A gram that is
    only a space is left out.
    """
    is_letter, lower = _letters()
    points, at = code_points(data, offsets)
    letter = is_letter[points]
    rows = np.repeat(np.arange(len(at) - 1), np.diff(at))
    lettered = np.bincount(rows[letter], minlength=len(at) - 1) > 0
    head = np.zeros(len(points), bool)
    head[at[:-1][np.diff(at) > 0]] = True
    gap = ~letter
    gap[1:] &= letter[:-1] | head[1:]
    keep = letter | gap
    symbol = np.where(letter, lower[points], 32)[keep].astype(np.uint64)
    rows = rows[keep]
    # a space before and after every row
    counts = np.bincount(rows, minlength=len(at) - 1)
    wide = np.concatenate([[0], np.cumsum(counts + 2)])
    padded = np.full(wide[-1], 32, np.uint64)
    inner = np.ones(wide[-1], bool)
    inner[wide[:-1]] = inner[wide[1:] - 1] = False
    padded[inner] = symbol
    owner = np.repeat(np.arange(len(at) - 1), counts + 2)
    for size in grams.sizes:
        n = len(padded) - size + 1
        if n <= 0:
            continue
        h = np.full(n, size, np.uint64)
        for j in range(size):
            h = h * np.uint64(0x9E3779B97F4A7C15) + padded[j : j + n]
        same = owner[:n] == owner[size - 1 :]
        if size == 1:
            same &= padded != 32
        yield (texts.mix(h[same]) >> np.uint64(64 - grams.bits)).astype(np.int64), owner[:n][same], lettered


def _counter(grams: Grams):
    def run(batches):
        sums: dict[str, np.ndarray] = {}
        documents: dict[str, int] = {}
        for batch in batches:
            data, offsets = texts.text_buffers(batch.column(0))
            labels = batch.column(1).dictionary_encode()
            names, codes = labels.dictionary.to_pylist(), labels.indices.to_numpy()
            for i, name in enumerate(names):
                documents[name] = documents.get(name, 0) + int((codes == i).sum())
                sums.setdefault(name, np.zeros(grams.buckets, np.int64))
            if len(sums) > MAX_LANGUAGES:
                raise ValueError(f"more than {MAX_LANGUAGES} languages")
            for first, last in texts.slices(offsets):
                lo, hi = offsets[first], offsets[last]
                part = codes[first:last]
                for bucket, rows, _ in gram_buckets(data[lo:hi], offsets[first : last + 1] - lo, grams):
                    found = np.bincount(part[rows] * grams.buckets + bucket, minlength=len(names) * grams.buckets)
                    for i, name in enumerate(names):
                        sums[name] += found[i * grams.buckets : (i + 1) * grams.buckets]
        for name, counts in sums.items():
            used = np.flatnonzero(counts)
            yield pa.RecordBatch.from_arrays(
                [pa.array([name] * (len(used) + 1), pa.string()), pa.array(np.concatenate([[-1], used])),
                 pa.array(np.concatenate([[documents[name]], counts[used]]))], ["lang", "bucket", "n"])

    return run


def fit(labelled: DataFrame, grams: Grams = Grams()) -> Model:
    """Model from all rows of (text, lang); rows without text or language are left out.

    Tasks send one count per (language, bucket); the driver gets at most MAX_LANGUAGES x buckets sums. No labelled
    rows: a model without languages.
    """
    counts = (
        labelled.where("text is not null and lang is not null").select("text", "lang")
        .mapInArrow(_counter(grams), "lang string, bucket long, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n")))
    found = counts.toPandas()
    languages = sorted(found["lang"].unique())
    if len(languages) > MAX_LANGUAGES:
        raise ValueError(f"more than {MAX_LANGUAGES} languages")
    logs = np.zeros((grams.buckets, len(languages)), np.float32)
    prior = np.zeros(len(languages))
    for i, name in enumerate(languages):
        own = found[found["lang"] == name]
        sums = np.full(grams.buckets, grams.smoothing)
        real = own["bucket"].to_numpy() >= 0
        sums[own["bucket"].to_numpy()[real]] += own["n"].to_numpy()[real]
        prior[i] = own["n"].to_numpy()[~real].sum()
        logs[:, i] = np.log(sums / sums.sum())
    return Model(languages, np.log(prior / prior.sum()) if len(languages) else prior, logs, grams)


def posterior(data: np.ndarray, offsets: np.ndarray, model: Model) -> tuple[np.ndarray, np.ndarray]:
    """Probability of every language per row (rows x languages), and whether the row has a letter."""
    rows = len(offsets) - 1
    score = np.tile(model.prior, (rows, 1))
    lettered = np.zeros(rows, bool)
    for bucket, owner, lettered in gram_buckets(data, offsets, model.grams):
        first = np.flatnonzero(np.concatenate([[True], owner[1:] != owner[:-1]])) if len(owner) else owner
        if len(first):
            for i in range(len(model.languages)):
                score[owner[first], i] += np.add.reduceat(model.logs[:, i][bucket].astype(np.float64), first)
    score = np.exp(score - score.max(axis=1, keepdims=True))
    return score / score.sum(axis=1, keepdims=True), lettered


def predict(docs: DataFrame, model: Model) -> DataFrame:
    """``docs`` with lang_pred and score (posterior of that language).

    The language is ``und`` with score 0 for null texts, texts without a letter, and a model without languages. Columns
    of ``docs`` with these names are replaced.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    base = texts.no_clash(docs, "lang_pred", "score")

    def work(batch, data, offsets):
        model = shared.value
        rows = len(offsets) - 1
        names, score = np.full(rows, UNDETERMINED, object), np.zeros(rows)
        if model.languages:
            p, lettered = posterior(data, offsets, model)
            best = p.argmax(axis=1)
            names[lettered] = np.array(model.languages, object)[best[lettered]]
            score[lettered] = np.clip(p[np.arange(rows), best][lettered], 0, 1)
        return pa.RecordBatch.from_arrays([*batch.columns, pa.array(names, pa.string()), pa.array(score)],
                                          [*batch.schema.names, "lang_pred", "score"])

    schema = texts.schema_with(base, T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType()))
    return base.mapInArrow(texts.by_slice(work), schema)


def held_out():
    """Documents that no model learns from."""
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2


def predict_documents(docs: DataFrame, grams: Grams = Grams()) -> DataFrame:
    """(doc_id, held_out, lang_pred, score) of all rows, learnt from the labelled rows outside the held-out quarter.

    A null doc_id is neither learnt from nor held out.
    """
    model = fit(docs.where(~held_out()).select("text", "lang"), grams)
    out = predict(docs.select("doc_id", "text"), model)
    return out.select("doc_id", F.coalesce(held_out(), F.lit(False)).alias("held_out"), "lang_pred", "score")


def keep_recognised(docs: DataFrame, least: float = 0.5, grams: Grams = Grams()) -> DataFrame:
    """``docs`` whose language is recognised with a posterior of at least ``least``; columns are unchanged."""
    model = fit(docs.where(~held_out()).select("text", "lang"), grams)
    rows, back = texts.aside(docs)
    return predict(rows, model).where((F.col("lang_pred") != UNDETERMINED) & (F.col("score") >= least)).select(*back)
