"""Fill-in-the-middle training texts: two cuts by ranks in a wavelet matrix over character classes."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from slotwise.llm import texts
from slotwise.llm.wavelet_matrix import WaveletMatrix

PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
#: Classes of a byte: inside a character, first of a word, rest of a word, first of a line, other white space.
INNER, WORD_FIRST, WORD_REST, LINE_FIRST, LINE_WORD, SPACE = range(6)
#: Classes of the bytes at which a unit begins.
UNITS = {
    "chars": (WORD_FIRST, WORD_REST, LINE_FIRST, LINE_WORD, SPACE),
    "words": (WORD_FIRST, LINE_WORD),
    "lines": (LINE_FIRST, LINE_WORD),
}
FIELDS = [
    T.StructField("n", T.LongType()), T.StructField("form", T.StringType()), T.StructField("prefix_chars", T.LongType()),
    T.StructField("middle_chars", T.LongType()), T.StructField("output", T.StringType())]


def classes(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Class of every byte of UTF-8 rows; a row begins a line, and a line break is the last character of its line."""
    space = ~texts.UNSPACED[data]
    begin = np.zeros(len(data), bool)
    begin[offsets[:-1][np.diff(offsets) > 0]] = True
    line = begin.copy()
    line[1:] |= data[:-1] == 10
    word = ~space
    word[1:] &= space[:-1] | begin[1:]
    out = np.where(space, SPACE, np.where(word, WORD_FIRST, WORD_REST)).astype(np.uint8)
    out[line] = LINE_FIRST
    out[line & word] = LINE_WORD
    out[(data & 0xC0) == 0x80] = INNER
    return out


def cuts(data: np.ndarray, offsets: np.ndarray, units: str, draw: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Units of every row, byte places of its two cuts, and characters before, between and after the cuts.

    Cut i stands before unit ``draw[:, i] % (units + 1)``, the smaller first. What precedes the first unit (white space before the
    first word) belongs to the part before the first cut, unless that cut is 0.
    """
    matrix = WaveletMatrix(classes(data, offsets), len(UNITS) + 3)
    starts, chars = UNITS[units], UNITS["chars"]
    begin, end = offsets[:-1], offsets[1:]
    before = matrix.count(starts, begin)
    n = matrix.count(starts, end) - before
    cut = np.sort(draw % (n + 1)[:, None], axis=1)
    place = np.stack([matrix.select(starts, before + cut[:, i], begin, end) for i in range(2)], axis=1)
    place = np.where(cut == 0, begin[:, None], place)
    upto = [matrix.count(chars, at) for at in (begin, place[:, 0], place[:, 1], end)]
    return n, place[:, 0], place[:, 1], np.diff(np.stack(upto, axis=1), axis=1)


def fill_middle(docs: DataFrame, units: str = "chars", salt: int = 1, plain: int = 10, spm: int = 20) -> DataFrame:
    """``docs`` with n (units of the text), form, prefix_chars, middle_chars and ``output``, the training text.

    The hex sha256 of ``<salt>:<doc_id>`` gives the draws: two cuts, then the share (of 100) that stays plain, then the share of
    suffix-first texts among the others. A text that is empty or contains a marker is plain; plain texts are unchanged.
    ``units``: chars (code points), words or lines. Null text is empty; a null doc_id draws as an empty one. Rows that repeat a doc_id
    draw alike. Columns of ``docs`` with the result's names are replaced. Texts of any length are cut whole; a class takes three
    bits a byte beside the text itself.
    """
    rows = texts.no_clash(docs, *[f.name for f in FIELDS], "_draw")
    digest = F.sha2(F.concat(F.lit(f"{salt}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 256)
    draw = F.array(*[F.conv(F.substring(digest, 8 * i + 1, 8), 16, 10).cast("long") for i in range(4)])
    marked = F.lit(False)
    for marker in (PREFIX, SUFFIX, MIDDLE):
        marked = marked | F.contains(F.col("text"), F.lit(marker))
    stays = F.coalesce(marked | (F.length("text") == 0), F.lit(True)) | (draw[2] % 100 >= 100 - plain)
    form = F.when(stays, "plain").when(draw[3] % 100 < spm, "spm").otherwise("psm")
    wanted = rows.withColumns({"form": form, "_draw": F.slice(draw, 1, 2)})
    own = rows.columns

    def work(batch, data, offsets):
        draws = batch.column("_draw").flatten().to_numpy().reshape(-1, 2)
        n, first, second, length = cuts(data, offsets, units, draws)
        forms, out = batch.column("form").to_pylist(), []
        whole = data.tobytes()
        for i, kind in enumerate(forms):
            a, b, c, d = int(offsets[i]), int(first[i]), int(second[i]), int(offsets[i + 1])
            prefix, middle, suffix = whole[a:b], whole[b:c], whole[c:d]
            out.append(whole[a:d] if kind == "plain" else b"<P>" + prefix + b"<S>" + suffix + b"<M>" + middle if kind == "psm"
                       else b"<S>" + suffix + b"<P>" + prefix + b"<M>" + middle)
        skip = np.array([kind == "plain" for kind in forms], bool)
        made = [pa.array(n), batch.column("form"), pa.array(length[:, 0], mask=skip), pa.array(length[:, 1], mask=skip),
                pa.array(out, pa.binary()).cast(pa.string())]
        return pa.RecordBatch.from_arrays([batch.column(c) for c in own] + made, own + [f.name for f in FIELDS])

    return wanted.mapInArrow(texts.by_slice(work), T.StructType(rows.schema.fields + FIELDS))


def restored(output: str | Column = "output", form: str | Column = "form") -> Column:
    """The text that ``output`` was made of. The first marker of each kind is the operator's own, as such texts hold none."""
    output, form = (F.col(c) if isinstance(c, str) else c for c in (output, form))
    before = lambda s, marker: F.substring_index(s, marker, 1)
    # positions count characters, as substr does
    after = lambda s, marker: F.substr(s, F.locate(marker, s) + len(marker))
    middle, suffix = after(output, MIDDLE), before(after(output, SUFFIX), MIDDLE)
    prefix = before(after(output, PREFIX), SUFFIX)
    suffix_first, prefix_second = before(after(output, SUFFIX), PREFIX), before(after(output, PREFIX), MIDDLE)
    return F.when(form == "psm", F.concat(prefix, middle, suffix)).when(
        form == "spm", F.concat(prefix_second, middle, suffix_first)).otherwise(output)
