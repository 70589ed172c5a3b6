import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest

from slotwise.llm import passages
from slotwise.llm import texts as X
from slotwise.llm.line_runs import drop_repeats, without_repeats
from slotwise.llm.passages import (
    SPAN, Chaining, _farthest, _ordered, _partners, _single, _told, _values_at, best_chains, common_words, reach, repeats, spans, told,
)
from slotwise.llm.shelf import Shelf


def test_words_of_long_text_are_cut_between_words(monkeypatch):
    rng = random.Random(2)
    rows = ["".join(rng.choice("ab é-\n") for _ in range(n)) for n in (0, 5, 4000, 0, 900)] + ["x" * 3000]
    data, offsets = X.text_buffers(pa.array(rows))
    whole = X.words(data, offsets, X.ALNUM)
    monkeypatch.setattr(X, "SLICE_BYTES", 64)
    pieces = X.words(data, offsets, X.ALNUM)
    assert all(np.array_equal(a, b) for a, b in zip(whole, pieces))
    found = [w for t in rows for w in re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", t)]
    assert len(whole[0]) == len(found) and len(set(whole[0].tolist())) == len(set(found))


def lines_brute(rows, least=6):
    first, out = {}, {}
    for doc, text in sorted(rows):
        lines = text.split("\n")
        sizes = [len(re.findall(r"[^\x20\x09-\x0D]+", x)) for x in lines]
        covered = out.setdefault(doc, set())
        for p in range(len(lines)):
            for e in range(p + 1, len(lines) + 1):
                if sum(sizes[p:e]) >= least and first.setdefault(tuple(lines[p:e]), (doc, p)) != (doc, p):
                    covered.update(range(p, e))
    return {k: sorted(v) for k, v in out.items()}


def test_line_runs_against_brute_force(spark, corpus):
    rng = random.Random(8)
    pool = ["", "a", "b c", "d e f", "g h i j k l m", "", "x y z w"]
    rows = [(i, "\n".join(rng.choice(pool) for _ in range(rng.randint(1, 12)))) for i in range(25)]
    rows += [(100, ""), (101, rows[3][1]), (102, "\n\n\n\na b c d e f g\n\n"), (103, "\n\n\n\na b c d e f g\n\n")]
    for data in (rows, [(r.doc_id, r.text) for r in corpus.collect() if r.text is not None]):
        df = spark.createDataFrame([*data, (999, None)], "doc_id long, text string")
        got = {r.doc_id: r for r in without_repeats(df).collect()}
        want = lines_brute(data)
        assert {k: got[k].deleted for k in want} == want and any(want.values())
        assert got[999].text is None and got[999].n_lines == 0
        for k, text in data:
            assert got[k].text == "\n".join(x for i, x in enumerate(text.split("\n")) if i not in set(want[k]))


def test_emptied_rows_go_and_columns_stay(spark):
    line = "one two three four five six seven"
    df = spark.createDataFrame([(1, line, "x"), (2, line, "y"), (3, line + "\nown", "z"), (4, "", "e")],
                               "doc_id long, text string, n_lines string")
    assert sorted(map(tuple, drop_repeats(df).collect())) == [(1, line, "x"), (3, "own", "z"), (4, "", "e")]


def test_chains_against_all_predecessors():
    rng = random.Random(4)
    p = Chaining(far=10**6)
    for _ in range(60):
        n = rng.randint(1, 25)
        x = sorted(rng.sample(range(200), n))
        y = [rng.randrange(200) for _ in range(n)]
        best = []
        for i in range(n):
            best.append(p.seed + max([0.0] + [best[j] - p.gap * (x[i] - x[j] + y[i] - y[j]) for j in range(i) if y[j] < y[i]]))
        found = best_chains(x, y, p)
        score = lambda c: p.seed + sum(p.seed - p.gap * (x[b] - x[a] + y[b] - y[a]) for a, b in zip(c, c[1:]))
        if max(best) > p.seed + 1e-9:
            assert abs(max(map(score, found)) - max(best)) < 1e-6
        for c in found:
            assert all(x[a] < x[b] and y[a] < y[b] for a, b in zip(c, c[1:]))
    assert common_words(np.array([1, 2, 3, 9, 4]), np.array([2, 3, 4, 5])) == 3


def test_shared_passages_are_found(spark):
    rng = random.Random(6)
    vocabulary = [f"w{i}" for i in range(5000)]
    words = lambda n: [rng.choice(vocabulary) for _ in range(n)]
    exact, fuzzy = words(55), words(90)
    edited = [w if i % 12 else rng.choice(vocabulary) for i, w in enumerate(fuzzy)]
    docs = {1: words(30) + exact + words(40), 2: words(80) + exact, 3: words(20) + fuzzy, 4: edited + words(60), 5: words(200),
            6: words(10) + exact + words(10), 7: words(80) + exact[:20]}
    df = spark.createDataFrame([(k, " ".join(v)) for k, v in docs.items()] + [(8, None), (9, ""), (None, " ".join(exact))],
                               "doc_id long, text string")
    got = {r.doc_id: r for r in repeats(df).collect()}
    assert {k: r.sources for k, r in got.items() if r.sources} == {2: [1], 6: [1], 4: [3]}
    for k, begin in ((2, 80), (6, 10)):
        (span,) = got[k].passages
        assert span.begin <= begin and begin + 55 <= span.end <= begin + 58
    assert got[4].passages[0].end >= 80 and got[5].n_repeated == 0 and got[5].n_words == 200


def test_edited_passages_with_few_intact_seeds(spark):
    rng = random.Random(11)
    words = lambda n: [f"v{rng.randrange(10**6)}" for _ in range(n)]
    plain, one = words(55), words(44)  # the second has one intact seed only
    docs = {40: words(20) + plain + words(20), 41: words(8) + [w if i % 8 else f"e{i}" for i, w in enumerate(plain)] + words(8),
            50: words(5) + one, 51: [w if i in range(20, 26) or i % 4 else f"f{i}" for i, w in enumerate(one)]}
    df = spark.createDataFrame([(k, " ".join(v)) for k, v in docs.items()], "doc_id long, text string")
    assert {r.doc_id: r.sources for r in repeats(df).collect()} == {40: [], 41: [40], 50: [], 51: [50]}


def test_passages_pieced_together_from_earlier_documents(spark):
    rng = random.Random(11)
    words = lambda n: [f"v{rng.randrange(10**6)}" for _ in range(n)]
    passage = words(60)
    docs = {1: passage[:30], 2: passage[24:], 3: words(9) + passage, 4: passage + words(9)}
    pieces = [words(30) for _ in range(5)]
    docs |= {10 + i: x for i, x in enumerate(pieces)}
    docs |= {20: sum(pieces, []), 30: pieces[0], 31: pieces[2] + pieces[1], 32: pieces[4], 33: pieces[3], 5000: words(7) + sum(pieces, [])}
    df = spark.createDataFrame([(k, " ".join(v)) for k, v in docs.items()], "doc_id long, text string")
    got = {r.doc_id: r for r in repeats(df).collect()}
    first, windows, exact = {}, [(k, x) for k in sorted(docs) for x in range(len(docs[k]) - 39)], {}
    for k, x in windows:
        if first.setdefault(tuple(docs[k][x : x + 40]), k) < k:
            exact.setdefault(k, set()).update(range(x, x + 40))
    assert set(exact) == {4, 5000}
    for k, places in exact.items():
        assert places <= {i for s in got[k].passages for i in range(s.begin, s.end)}


def test_edited_passages_whose_pieces_stand_in_other_documents(spark):
    """No seed of the passage has its first or previous place in the source; copies of a crowd of near copies add no sources."""
    rng = random.Random(12)
    words = lambda n: [f"v{rng.randrange(10**6)}" for _ in range(n)]
    plain = words(64)
    edited = [w if i % 8 else f"e{i}" for i, w in enumerate(plain)]
    pieces = [plain[i + 1 : i + 8] for i in range(0, 64, 8)]
    docs = {100: words(9) + plain + words(9), 300: words(12) + edited + words(7)}
    for i, piece in enumerate(pieces):
        docs |= {1 + i: words(20) + piece + words(20), 200 + i: words(15) + piece + words(20)}
    df = spark.createDataFrame([(k, " ".join(v)) for k, v in docs.items()], "doc_id long, text string")
    got = {r.doc_id: r for r in repeats(df).collect()}
    assert {k: r.sources for k, r in got.items() if r.sources} == {300: [100]} and got[300].n_repeated == 63


def test_pairs_of_crowded_seeds_against_brute_force():
    """Passages around one seed, from all pairs of places: for every pair its own, or one as wide from an earlier document."""
    p, rng, n = Chaining(), np.random.default_rng(7), 160
    wide, x = 2 * p.pad + p.seed, rng.integers(0, 90, 160)
    room, doc = rng.integers(0, p.pad + 1, n), rng.integers(0, 120, n)
    plain = rng.integers(1, 1 << 31, (3, wide)).astype(np.uint32)
    kind, share = rng.integers(0, 3, n), rng.choice([0.5, 0.8, 0.9, 1.0], (n, 1))
    words = np.where(rng.random((n, wide)) < share, plain[kind], rng.integers(1, 1 << 31, (n, wide)).astype(np.uint32)).astype(np.uint32)
    words[:, p.pad : p.pad + p.seed] = plain[0, p.pad : p.pad + p.seed]
    ahead = np.arange(-p.pad, p.seed + p.pad)
    words[(ahead < -x[:, None]) | (ahead >= p.seed + room[:, None])] = 0
    got = {}
    for part in _partners(np.zeros(n, np.uint64), doc, x, room, words, p):
        for i, j, left, right, matched in zip(*[v.tolist() for v in part]):
            assert doc[j] < doc[i]
            got.setdefault(i, []).append((doc[j], left, right))
    pairs = 0
    for i in range(n):
        for j in range(n):
            a, b = words[i].view(np.int32), words[j].view(np.int32)
            before, after = min(x[i], x[j], p.pad), min(room[i], room[j])
            if doc[j] >= doc[i] or before and a[p.pad - 1] == b[p.pad - 1]:
                continue
            left, more = reach(a[p.pad - before : p.pad][::-1], b[p.pad - before : p.pad][::-1], p.drop)
            right, also = reach(a[p.pad + p.seed :][:after], b[p.pad + p.seed :][:after], p.drop)
            length = left + p.seed + right
            if length >= p.least and more + p.seed + also >= p.same * length:
                pairs += 1
                assert any(d <= doc[j] and u >= left and v >= right for d, u, v in got.get(i, [])), (i, j)
    assert pairs > 100


@pytest.mark.parametrize("few", [0, 4, 20])
def test_keyed_pairs_against_brute_force(monkeypatch, few):
    monkeypatch.setattr(passages, "FEW", few)
    test_pairs_of_crowded_seeds_against_brute_force()


def test_a_line_in_many_documents_is_not_paired_with_itself(monkeypatch):
    """One line of 17 words with other words around, in 3000 documents, and one passage of 90 words, a tenth edited, in four of them:
    the passages are those of all pairs, of which few are looked at."""
    p, rng, n = Chaining(), np.random.default_rng(3), 3000
    wide = 2 * p.pad + p.seed
    words = rng.integers(1, 1 << 31, (n, wide)).astype(np.uint32)
    words[:, p.pad : p.pad + 17] = words[0, p.pad : p.pad + 17]
    for i in (700, 1500, 2999):
        same = rng.random(wide) < 0.9
        words[i, same] = words[20, same]
        words[i, p.pad : p.pad + 17] = words[20, p.pad : p.pad + 17]
        words[i, p.pad - 1] = i
    name, doc, x, room = np.zeros(n, np.uint64), np.arange(n), np.full(n, p.pad), np.full(n, p.pad)
    found = lambda: {(int(a), int(b)) for i, j, *_ in _partners(name, doc, x, room, words, p) for a, b in zip(i, j)}
    got = found()
    monkeypatch.setattr(passages, "FEW", n)
    assert got == found() and {(700, 20), (1500, 20), (2999, 20)} <= got <= {(a, b) for a in (700, 1500, 2999) for b in (20, 700, 1500)}
    monkeypatch.undo()
    judged = sum(len(i) for i, _ in passages._possible(name, x, room, words, p, doc))
    assert judged < 20 * n


def test_repeated_rows_are_one_document_in_line_runs(spark, monkeypatch):
    tables, put = [], Shelf.put
    monkeypatch.setattr(Shelf, "put", lambda self, df: tables.append(put(self, df)) or tables[-1])
    text = "\n".join("abcdefgh")
    rows = [(None, text)] * 5 + [(1, text)] * 5 + [(2, "x\n" + text)]
    got = sorted((r.doc_id or 0, r.deleted) for r in without_repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert got == [(0, [])] * 5 + [(1, list(range(8)))] * 5 + [(2, list(range(1, 9)))]
    assert max(t.count() for t in tables) <= 11 * 9


def test_lines_with_equal_polynomials_stay_apart(spark):
    morse = "a"
    while len(morse) < 2048:
        morse += morse.translate(str.maketrans("ab", "ba"))
    other = morse.translate(str.maketrans("ab", "ba"))
    h = [X.words(*X.text_buffers(pa.array([t])), X.ALNUM)[0][0] for t in (morse, other, morse)]
    assert h[0] != h[1] and h[0] == h[2]
    tail = " five more words of text"
    df = spark.createDataFrame([(1, morse + tail), (2, other + tail), (3, morse + tail)], "doc_id long, text string")
    assert {r.doc_id: r.deleted for r in without_repeats(df).collect()} == {1: [], 2: [], 3: [0]}


def test_very_many_blank_lines_cost_in_proportion(spark):
    text = "\n" * 60000 + "one two three four five six"
    df = spark.createDataFrame([(1, text), (2, text), (3, "\n\n" + text)], "doc_id long, text string")
    got = {r.doc_id: (len(r.deleted), r.text) for r in without_repeats(df).collect()}
    assert got[1] == (0, text) and got[2] == (60001, "") and got[3] == (60001, "\n")


def test_single_anchors_are_judged_without_loss():
    """A byte of the nearest words never gives less reach than the whole words, and hopeless sides are recognised."""
    p, rng = Chaining(), np.random.default_rng(5)
    for share in (0.05, 0.5, 0.75, 0.9):
        for _ in range(300):
            n, m = rng.integers(0, 70, 2)
            a = rng.integers(0, 1 << 31, n).astype(np.int32)
            b = rng.integers(0, 1 << 31, m).astype(np.int32)
            k = min(n, m)
            b[:k] = np.where(rng.random(k) < share, a[:k], b[:k])
            same = np.zeros((1, p.near), bool)
            near = min(k, p.near)
            same[0, :near] = a[:near].astype(np.uint8) == b[:near].astype(np.uint8)
            bound = _farthest(same, np.array([near]), p)[0]
            assert bound >= reach(a[: p.pad], b[: p.pad], p.drop)[0]
    assert _farthest(np.zeros((1, p.near), bool), np.array([p.near]), p)[0] == 0


def test_passages_around_single_anchors(spark):
    """Of passages with one intact run of five words and edits else, the judged ones are those of every single chain."""
    rng = np.random.default_rng(11)
    rows, k = [], 0
    for i in range(40):
        words = [f"w{v}" for v in rng.integers(0, 10**9, 60)]
        other = list(words)
        for at in list(range(3, 24, 4)) + list(range(33, 60, 4 + i % 3)):
            other[at] = f"e{k}"
            k += 1
        rows += [(2 * i, " ".join(words)), (2 * i + 1, " ".join(other))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    wide = {r["doc_id"]: r["passages"] for r in repeats(docs, Chaining(near=64)).collect()}
    found = {r["doc_id"]: r["passages"] for r in repeats(docs).collect()}
    assert found == wide and sum(bool(v) for v in found.values()) > 10


def test_chains_of_one_anchor_are_aligned_at_once():
    """For a whole batch of chains: the passages that ``spans`` gives one by one. Another text with the doc_id gives none."""
    p, rng, rows, want = Chaining(), np.random.default_rng(3), [], []
    for k in range(400):
        a = rng.integers(0, 1 << 31, rng.integers(5, 200)).astype(np.int32)
        n = int(rng.integers(1, min(len(a) - 4, 60) + 1))
        x, before, after = int(rng.integers(0, len(a) - 3 - n)), int(rng.integers(0, 90)), int(rng.integers(0, 90))
        size = n - 1 + p.seed
        b = rng.integers(0, 1 << 31, before + size + after).astype(np.int32)
        for i in range(len(b)):
            if 0 <= x + i - before < len(a) and (before <= i < before + size or rng.random() < (0.3, 0.8, 0.95)[k % 3]):
                b[i] = a[x + i - before]
        x0, y0 = max(x - p.pad, 0), max(before - p.pad, 0)
        a, b = a[x0 : x + size + p.pad], b[y0 : before + size + p.pad]
        inner = a[x - x0 : x - x0 + size]
        edges = np.concatenate([a[: x - x0], a[x - x0 + size :]])
        check = zlib.crc32(inner.tobytes()) + (k % 7 == 0)
        rows.append((k, 1000 + k, [x], [before], [n], x0, edges.tobytes(), check, y0, b.tobytes()))
        if k % 7:
            want += [(k, 1000 + k, u + x0, v + x0, s + y0, t + y0, m) for u, v, s, t, m in spans([x - x0], [before - y0], [n], a, b, p)]
    lists = pa.list_(pa.int32())
    kinds = [pa.int64(), pa.int64(), lists, lists, lists, pa.int32(), pa.binary(), pa.int64(), pa.int32(), pa.binary()]
    names = ["doc", "src", "x", "y", "n", "x0", "edges", "check", "y0", "b"]
    batch = pa.RecordBatch.from_arrays([pa.array(list(v), kind) for v, kind in zip(zip(*rows), kinds)], names)
    got = [tuple(r.values()) for r in _single(batch, p).to_pylist()]
    assert got == want and 50 < len(want) < 340
    assert _single(batch.slice(0, 0), p).num_rows == 0


def test_orders_subsequences_and_told_passages_against_brute_force():
    rng = np.random.default_rng(8)
    for n in (0, 1, 2, 1000):
        wide = rng.integers(0, 1 << 63, n).astype(np.uint64)
        near = rng.integers(0, 9, n).astype(np.uint64)  # different values with the same high bits
        for values in (wide, near, wide[rng.integers(0, max(n // 3, 1), n)] if n else wide):
            assert np.array_equal(_ordered(values), np.argsort(values, kind="stable"))
    for _ in range(200):
        a, b = (rng.integers(0, 6, rng.integers(0, 30)) for _ in range(2))
        row = [0] * (len(b) + 1)
        for u in a:
            row = _next(row, b, u)
        assert common_words(a, b) == row[-1]
    rows = np.sort(rng.integers(0, 20, 400))
    begin = rng.integers(0, 60, 400)
    end, src, start, matched = begin + rng.integers(40, 60, 400), rng.integers(0, 5, 400), rng.integers(0, 9, 400), rng.integers(30, 60, 400)
    key = lambda i: (src[i], begin[i] - end[i], -matched[i], begin[i], start[i], i)
    inside = lambda i, j: rows[i] == rows[j] and begin[j] <= begin[i] and end[i] <= end[j]
    left = {i for i in range(400) if not any(inside(i, j) and key(j) < key(i) for j in range(400))}
    assert set(_told(rows, begin, end, src, start, matched).tolist()) == left


def _next(row, b, word):
    out = [0]
    for k, other in enumerate(b):
        out.append(max(row[k] + 1 if other == word else 0, row[k + 1], out[k]))
    return out


def test_told_takes_spans_in_many_batches_and_seeds_have_the_same_values(spark):
    rng = random.Random(12)
    rows = []
    for _ in range(3000):
        begin, n, src = rng.randrange(400), rng.randint(40, 60), rng.randrange(4)
        rows.append((rng.choice([5, 5, 5, 6, 7, 900, -1]), src, begin, begin + n, begin + 1, begin + 1 + n, n - 2))
    held = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        have = {r.doc: [tuple(q) for q in r.passages] for r in told(spark.createDataFrame(rows + rows[:90], SPAN).repartition(5)).collect()}
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", held)
    want = {}
    for doc in {r[0] for r in rows}:
        own = sorted({(b, e, src, sb, se, m) for d, src, b, e, sb, se, m in rows if d == doc})
        at = [np.array([r[i] for r in own]) for i in range(6)]
        kept = _told(np.zeros(len(own), np.int64), at[0], at[1], at[2], at[3], at[5])
        want[doc] = [own[i] for i in sorted(kept.tolist())]
    assert have == want
    words = np.random.default_rng(3).integers(0, 1 << 32, 50, dtype=np.uint64).astype(np.uint32)
    starts = np.array([0, 5, 30, 50])
    whole = X.shingles(X.mix(words.astype(np.uint64)), starts, 5)[0]
    first = np.concatenate([np.arange(a, b - 4) for a, b in zip(starts[:-1], starts[1:])])
    assert (_values_at(words, first, Chaining()) == whole).all()
