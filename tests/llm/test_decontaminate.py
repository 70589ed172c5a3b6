import re

import numpy as np
import pytest

from slotwise.llm import decontaminate as D
from slotwise.llm.fm_index import FMIndex, suffix_array

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    return WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def brute(docs, items):
    windows = {}
    for r in items:
        w = words(r.text)
        for k in range(max(len(w) - 13, 0) + 1 if w else 0):
            windows.setdefault(tuple(w[k : k + 13]), set()).update([] if r.item_id is None else [str(r.item_id)])
    out = {}
    for d in docs:
        w, hit, found = words(d.text), set(), set()
        for size in {len(k) for k in windows}:
            for i in range(len(w) - size + 1):
                if tuple(w[i : i + size]) in windows:
                    hit.update(range(i, i + size))
                    found |= windows[tuple(w[i : i + size])]
        out[d.doc_id] = (len(w), hit, found)
    return out


def test_suffix_array_search_and_locate():
    rng = np.random.default_rng(3)
    for n, size in ((1, 3), (50, 3), (400, 5), (300, 40)):
        symbols = rng.integers(1, size, n)
        text = symbols.tolist()
        assert suffix_array(np.append(symbols, 0)).tolist() == sorted(range(n + 1), key=lambda i: (text + [0])[i:])
        index = FMIndex(symbols, size, sample=4)
        patterns = [text[i : i + k] for i in range(0, n, 7) for k in (1, 2, 5) if i + k <= n] + [[size - 1] * 3]
        table = np.array([p + [0] * (5 - len(p)) for p in patterns])
        low, high = index.search(table, np.array([len(p) for p in patterns]))
        for p, a, b in zip(patterns, low, high):
            want = [i for i in range(n - len(p) + 1) if text[i : i + len(p)] == p]
            assert sorted(index.locate(np.arange(a, b)).tolist()) == want


@pytest.mark.parametrize("block", [D.BLOCK_BYTES, 300])
def test_against_brute_force(corpus, benchmark_table, monkeypatch, block):
    monkeypatch.setattr(D, "BLOCK_BYTES", block)
    want = brute(corpus.collect(), benchmark_table.collect())
    rows = D.contamination(corpus, benchmark_table).collect()
    assert len(rows) == corpus.count() and sum(bool(h) for _, h, _ in want.values()) > 3
    for r in rows:
        n, hit, found = want[r.doc_id]
        assert (r.n_words, r.n_hit, r["items"]) == (n, len(hit), sorted(found))
        assert {i for s in r.hits for i in range(s.begin, s.end)} == hit


def test_cut_spans_and_dropped_rows(corpus, benchmark_table):
    want = brute(corpus.collect(), benchmark_table.collect())
    cut = {r.doc_id: r.text for r in D.without_spans(D.contamination(corpus, benchmark_table)).collect()}
    for r in corpus.collect():
        n, hit, _ = want[r.doc_id]
        assert words(cut[r.doc_id]) == [w for i, w in enumerate(words(r.text)) if i not in hit]
    left = {r.doc_id for r in D.drop_contaminated(corpus, benchmark_table).collect()}
    assert left == {k for k, (n, hit, _) in want.items() if not (hit and 20 * len(hit) >= n)}
