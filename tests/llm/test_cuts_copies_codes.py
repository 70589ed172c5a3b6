import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from slotwise.llm.byte_runs import _dealt, whole_copies, without_copies
from slotwise.llm.fill_middle import classes, cuts, fill_middle, restored
from slotwise.llm.line_runs import _document
from slotwise.llm.shelf import Shelf
from slotwise.llm.suffixes import Windows, common_prefixes, merge, suffix_array
from slotwise.llm.vector_codes import NearestEntry, decode, encode, fit
from slotwise.llm.wavelet_matrix import WaveletMatrix

DOCS = "doc_id long, text string"


# ---- fill in the middle ------------------------------------------------------------------------------------------------


def test_ranks_and_selection_equal_counting():
    rng = np.random.default_rng(1)
    symbols = rng.integers(0, 6, 1000).astype(np.uint8)
    matrix = WaveletMatrix(symbols, 6)
    at = np.array([0, 1, 63, 64, 65, 500, 999, 1000])
    for s in range(6):
        assert matrix.rank(s, at).tolist() == [int((symbols[:i] == s).sum()) for i in at]
    places = np.flatnonzero((symbols == 1) | (symbols == 4))
    nth = np.arange(len(places) + 1)
    found = matrix.select((1, 4), nth, np.zeros(len(nth), np.int64), np.full(len(nth), 1000))
    assert found.tolist() == [*places.tolist(), 1000]


def _expected(doc_id, text):
    text = text or ""
    h = hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    a, b, c, d = (int(h[i * 8 : i * 8 + 8], 16) for i in range(4))
    n = len(text)
    low, high = sorted((a % (n + 1), b % (n + 1)))
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or c % 100 >= 90:
        return (n, "plain", None, None, text)
    p, m, s = text[:low], text[low:high], text[high:]
    if d % 100 < 20:
        return (n, "spm", low, high - low, f"<S>{s}<P>{p}<M>{m}")
    return (n, "psm", low, high - low, f"<P>{p}<S>{s}<M>{m}")


def test_cut_texts_equal_their_definition(spark):
    rng = random.Random(3)
    alphabet = "ab <>PSM\né漢😀\t"
    rows = [(i, "".join(rng.choice(alphabet) for _ in range(rng.randint(0, 90)))) for i in range(150)]
    rows += [(None, "no number"), (7, None), (8, ""), (9, "one <S> marker"), (10, "漢" * 70000), (10, "漢" * 70000)]
    docs = spark.createDataFrame([(*r, "mine") for r in rows], DOCS + ", N string")
    got = fill_middle(docs).withColumn("back", restored()).collect()
    assert got[0].asDict().keys() == {"doc_id", "text", "n", "form", "prefix_chars", "middle_chars", "output", "back"}
    key = lambda r: (str(r[0]), r[1] or "", r[2:])
    want = sorted([(i, t, *_expected(i, t)) for i, t in rows], key=lambda r: key((r[0], r[1])))
    have = sorted([(r.doc_id, r.text, r.n, r.form, r.prefix_chars, r.middle_chars, r.output) for r in got], key=lambda r: key((r[0], r[1])))
    assert have == want
    assert all(r.back == (r.text or "") for r in got)
    assert {r.form for r in got} == {"plain", "psm", "spm"}
    assert fill_middle(docs.limit(0)).count() == 0


def test_cuts_at_words_and_lines():
    text = " two words\nand\n\nlast line é".encode()
    data, offsets = np.frombuffer(text, np.uint8), np.array([0, len(text)])
    n, first, second, length = cuts(data, offsets, "words", np.array([[1, 3]]))
    assert (int(n[0]), text[: first[0]], text[first[0] : second[0]]) == (6, b" two ", b"words\nand\n\n")
    assert length.tolist() == [[5, 11, 11]]
    n, first, second, _ = cuts(data, offsets, "lines", np.array([[0, 2]]))
    assert (int(n[0]), int(first[0]), text[: second[0]]) == (4, 0, b" two words\nand\n")
    assert len(classes(np.zeros(0, np.uint8), np.array([0]))) == 0


# ---- repeated byte strings ---------------------------------------------------------------------------------------------


def test_suffix_order_and_prefixes_equal_sorting():
    rng = random.Random(2)
    strings = [bytes(rng.choice(b"ab\x00") for _ in range(rng.randint(1, 40))) for _ in range(60)] + [b"a" * 50] * 2 + [b"a"]
    sizes = np.array([len(s) for s in strings], np.int32)
    stops = np.cumsum(sizes, dtype=np.int32)
    data, ends = np.frombuffer(b"".join(strings), np.uint8), np.repeat(stops, sizes)
    order = suffix_array(data, ends)
    suffix = lambda i: data[i : ends[i]].tobytes()
    assert order.tolist() == sorted(range(len(data)), key=lambda i: (suffix(i), i))
    prefix = common_prefixes(data, order, stops - sizes, stops, ends)
    for r in range(1, len(order)):
        a, b = suffix(order[r - 1]), suffix(order[r])
        same = next((k for k in range(min(len(a), len(b))) if a[k] != b[k]), min(len(a), len(b)))
        assert prefix[r] == same


def test_shards_agree_on_the_least_owner():
    rng = random.Random(4)
    base = [bytes(rng.choice(b"xyz") for _ in range(80)) for _ in range(6)]
    strings = [base[rng.randrange(6)][: rng.randint(30, 80)] for _ in range(40)]
    owners = np.array([rng.randrange(1000) for _ in strings])
    shards = [Windows(strings[i::3], owners[i::3], 30) for i in range(3)]
    merge(shards)
    least = {}
    for s, o in zip(strings, owners.tolist()):
        for i in range(len(s) - 29):
            least[s[i : i + 30]] = min(o, least.get(s[i : i + 30], o))
    for shard in shards:
        for place, owner in zip(shard.first.tolist(), shard.least.tolist()):
            assert least[shard.data[place : place + 30].tobytes()] == owner


def _brute(rows, length):
    first, out = {}, []
    order = lambda d: -(1 << 63) if d is None else d
    for doc, text in rows:
        data = (text or "").encode()
        for i in range(len(data) - length + 1):
            key = data[i : i + length]
            first[key] = min(order(doc), first.get(key, order(doc)))
    for doc, text in rows:
        data = (text or "").encode()
        gone = np.zeros(len(data), bool)
        for i in range(len(data) - length + 1):
            if first[data[i : i + length]] < order(doc):
                gone[i : i + length] = True
        runs = int((np.diff(np.concatenate([[0], gone.astype(int)])) == 1).sum())
        out.append((doc, text, len(data), int(gone.sum()), runs, bytes(b for b, g in zip(data, gone) if not g)))
    return out


@pytest.mark.parametrize("crowd", [1 << 15, 1])
def test_removed_bytes_equal_brute_force(spark, corpus, crowd):
    rows = [(r.doc_id, r.text) for r in corpus.collect()]
    long = rows[0][1] * 3 + "\n" + "-" * 400 + rows[9][1]
    rows += [(600, long), (600, long), (600, "x" + rows[5][1]), (None, rows[0][1]), (None, rows[9][1]), (601, "=" * 300), (602, "=" * 200 + "é" * 60)]
    docs = spark.createDataFrame([(*r, "mine") for r in rows], DOCS + ", KEPT string")
    got = without_copies(docs, crowd=crowd).collect()
    have = [(r.doc_id, r.text, r.n_bytes, r.n_removed, len(r.removed), bytes(r.kept)) for r in got]
    key = lambda r: (str(r[0]), r[1] or "")
    assert sorted(have, key=key) == sorted(_brute(rows, 50), key=key)
    assert sum(r[3] for r in have) > 5000
    assert without_copies(docs.limit(0)).collect() == []
    for r in got:
        data, kept = (r.text or "").encode(), bytes(r.kept)
        cut = [(0, 0), *[(s.begin, s.end) for s in r.removed], (len(data), len(data))]
        assert b"".join(data[a[1] : b[0]] for a, b in zip(cut[:-1], cut[1:])) == kept


# ---- vector codes ------------------------------------------------------------------------------------------------------


def test_candidates_hold_the_nearest_entry():
    rng = np.random.default_rng(5)
    entries = rng.integers(-40, 40, (64, 4))
    entries[10] = entries[3]
    points = np.concatenate([rng.integers(-60, 60, (500, 4)), entries])
    index, far = NearestEntry(entries).find(points)
    every = ((points[:, None] - entries[None]) ** 2).sum(axis=2)
    assert index.tolist() == every.argmin(axis=1).tolist() and far.tolist() == every.min(axis=1).tolist()
    few = NearestEntry(entries[:3])
    mask = few.candidates(points, np.full(len(points), 30))
    cube = (np.abs(points[:, None] - entries[None, :3]) <= 30).all(axis=2)
    assert mask.tolist() == (cube * (1 << np.arange(3))).sum(axis=1).tolist()


def test_codes_equal_plain_k_means(spark):
    rng = np.random.default_rng(6)
    vectors = rng.normal(0, 0.2, (200, 32)).astype(np.float32)
    vectors[50] = vectors[20]
    rows = [(int(i), [float(x) for x in v], int(i % 3) if i % 7 else None) for i, v in enumerate(vectors)]
    bad = [(900, None, 1), (901, [float("nan")] * 32, 1), (902, [float("inf")] + [0.0] * 31, 1), (903, [None] + [0.0] * 31, 1), (904, [1.0] * 16, 1), (905, [], 1)]
    table = spark.createDataFrame(rows + bad, "vec_id long, embedding array<float>, label int").withColumn("Error", F.lit("mine"))
    books = fit(table, entries=8)
    whole = np.floor(vectors.astype(np.float64) * 256).astype(np.int64).reshape(200, 16, 2)
    book = whole[:8].transpose(1, 0, 2).copy()

    def place():
        far = ((whole[:, :, None] - book[None]) ** 2).sum(axis=3)
        return far.argmin(axis=2), far.min(axis=2)

    for _ in range(2):
        code, _ = place()
        for p in range(16):
            for e in range(8):
                took = whole[code[:, p] == e, p]
                if len(took):
                    book[p, e] = took.sum(axis=0) // len(took)
    code, far = place()
    assert (books.entries == book).all()
    coded = encode(table, books)
    got = {r.vec_id: (list(r.code), r.error) for r in coded.collect()}
    assert got == {i: (code[i].tolist(), int(far[i].sum())) for i in range(200)}
    back = {r.vec_id: r.decoded for r in decode(coded, books).collect()}
    assert np.allclose(back[3], (book[np.arange(16), code[3]].ravel() + 0.5) / 256)
    assert fit(table.where("vec_id > 899 and vec_id < 904")) is None and encode(table, None).count() == 0
    assert fit(table.where("vec_id < 5")).entries.shape == (16, 5, 2)
    with pytest.raises(OverflowError):
        fit(spark.createDataFrame([(1, [1e30] * 16)], "vec_id long, embedding array<double>"))


def test_suffix_arrays_only_of_names_with_several_stretches():
    # a name's only stretch needs none; sets hold whole names, so they need no merging among each other
    names, sizes = np.array([7, 3, 7, 9, 3, 5, 7, 8, 8]), np.array([60, 60, 70, 60, 90, 60, 80, 400, 300])
    alone, sets = _dealt(names, sizes, 250)
    assert sorted(alone.tolist()) == [3, 5]
    assert [sorted(i for part in one for i in part.tolist()) for one in sets] == [[1, 4], [0, 2, 6], [7, 8]]
    assert [len(one) for one in sets] == [1, 1, 3]
    assert [len(v) for v in _dealt(np.zeros(0, np.int64), np.zeros(0, np.int64))] == [0, 0]


def test_later_copies_of_whole_texts(spark):
    text, other = "".join(chr(97 + i * i % 23) for i in range(400)), "é" * 40
    rows = [(5, text), (3, text), (3, text), (9, text), (None, other), (4, other), (2, "y" * 50), (8, "k" + text[:399])]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    copies = whole_copies(docs.select(*_document(), "text"), Shelf(spark))
    assert sorted((r.doc, r.n) for r in copies.collect()) == [(4, 80), (5, 400), (9, 400)]
    have = [(r.doc_id, r.text, r.n_bytes, r.n_removed, len(r.removed), bytes(r.kept)) for r in without_copies(docs).collect()]
    assert sorted(have, key=str) == sorted(_brute(rows, 50), key=str)
