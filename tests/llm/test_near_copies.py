import random
import re

import pytest

from slotwise.llm import near_copies as N
from slotwise.llm.components import components
from slotwise.llm.shelf import Shelf


def sets_of(rows, size=4):
    out = {}
    for r in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", (r.text or "").lower())
        out[r.doc_id] = frozenset(tuple(w[i : i + size]) for i in range(max(len(w) - size, 0) + 1)) if w else frozenset()
    return out


def brute(sets):
    parent = {k: k for k in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[:i]:
            n = len(sets[a] & sets[b])
            if n and 100 * n >= 80 * (len(sets[a]) + len(sets[b]) - n):
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
    return {k: find(k) for k in sets}


def test_components_of_chain_and_star(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 100 + i) for i in range(1, 30)] + [(7, 7), (3, 2), (2, 3)]
    found = components(spark.createDataFrame(edges, "a long, b long"), Shelf(spark)).collect()
    assert {r.node: r.root for r in found} == {**{i: 0 for i in range(41)}, **{100 + i: 100 for i in range(30)}}
    empty = spark.createDataFrame([], "a long, b long")
    assert components(empty, Shelf(spark)).count() == 0


def test_against_all_pairs(corpus):
    rows = corpus.collect()
    sets = sets_of(rows)
    want = brute(sets)
    got = {r.doc_id: r for r in N.near_copies(corpus).collect()}
    assert {k: r.component_id for k, r in got.items()} == want
    assert all(r.n_shingles == len(sets[k]) and r.kept == (want[k] == k) for k, r in got.items())


@pytest.mark.parametrize("seed", [1, 2])
def test_large_buckets_lose_no_link(spark, monkeypatch, seed):
    """With tiny buckets everything goes through pivots and what is beside them."""
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(3000)]
    docs, heads = [], [[rng.choice(vocabulary) for _ in range(90)] for _ in range(2)]
    for k in range(90):
        words = list(rng.choice(heads))
        for _ in range(rng.randint(0, 9)):
            words[rng.randrange(len(words))] = rng.choice(vocabulary)
        if rng.random() < 0.2:
            words = words[: rng.randint(60, 90)]
        if k % 12 == 0:
            heads.append(words)
        docs.append((k * 7 % 1000, " ".join(words)))
    df = spark.createDataFrame(docs, "doc_id long, text string")
    monkeypatch.setattr(N, "SMALL_BUCKET", 2)
    got = {r.doc_id: r.component_id for r in N.near_copies(df).collect()}
    assert got == brute(sets_of(df.collect()))


def test_one_of_each_keeps_rows_without_id(spark):
    text = "one two three four five six seven"
    df = spark.createDataFrame([(4, text), (2, text), (None, text), (9, None), (8, "")], "doc_id long, text string")
    assert sorted((r.doc_id or -1) for r in N.one_of_each(df).collect()) == [-1, 2, 8, 9]
