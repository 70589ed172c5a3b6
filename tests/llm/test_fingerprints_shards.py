import hashlib
import random
import zlib

import pytest
from pyspark.sql import functions as F

from slotwise.llm import fingerprints as FP
from slotwise.llm import kd_shards as K


def shingle_set(text):
    w = [x for x in __import__("re").split(r"[ \t\n\x0B\f\r]+", (text or "").lower()) if x]
    return {tuple(w[i : i + 5]) for i in range(max(len(w) - 5, 0) + 1)} if w else set()


@pytest.mark.parametrize("range_bytes", [1 << 24, 900])
def test_edited_texts_and_likeness(corpus, range_bytes):
    rows = FP.with_edited(corpus, range_bytes).select(
        "*", FP.resemblance(F.col("sketch"), F.col("edited_sketch")).alias("a"),
        FP.resemblance(F.col("sketch"), F.col("next_sketch")).alias("b")).collect()
    docs = sorted(((r.doc_id, r.text or "") for r in corpus.collect()), reverse=True)
    got = {r.doc_id: r for r in rows}
    assert len(rows) == len(docs)
    for i, (doc, text) in enumerate(docs):
        follower = docs[(i + 1) % len(docs)][1]
        half = len(text) // 2
        edited = text[: len(text) - half] + follower[:half]
        r = got[doc]
        assert r.n_chars == len(text) and hashlib.sha256(r.edited.encode()).hexdigest() == hashlib.sha256(edited.encode()).hexdigest()
        for other, estimate in ((edited, r.a), (follower, r.b)):
            x, y = shingle_set(text), shingle_set(other)
            exact = len(x & y) / len(x | y) if x | y else 1.0
            assert abs(estimate - exact) < (1e-12 if len(x) + len(y) <= FP.SIZE else 0.2)


def test_ties_nulls_and_single_rows(spark):
    schema = "doc_id long, text string"
    one = FP.with_edited(spark.createDataFrame([(1, "abcd")], schema)).collect()
    assert [r.edited for r in one] == ["abab"]
    none = FP.with_edited(spark.createDataFrame([(None, "xy"), (None, "abcd")], schema)).collect()
    assert sorted(r.edited for r in none) == ["abxy", "xa"]
    same = FP.with_edited(spark.createDataFrame([(5, "bb"), (5, "aa"), (3, "cc"), (None, None)], schema)).collect()
    assert sorted(r.edited for r in same) == ["", "ac", "ba", "c"]
    assert FP.with_edited(spark.createDataFrame([], schema)).count() == 0


def test_merge_and_counts(spark):
    rng = random.Random(2)
    texts = [" ".join(f"w{rng.randrange(10**6)}" for _ in range(n)) for n in (3, 40, 300, 500)] + [None, ""]
    df = spark.createDataFrame([(i, i % 2, t) for i, t in enumerate(texts)], "doc_id long, part int, text string")
    sketches = df.select("part", "text", FP.sketch(F.col("text")).alias("sketch"))
    whole = {r.part: r.sketch for r in FP.merged(sketches, ["part"]).collect()}
    hashes = {p: sorted({h for r in df.where(f"part = {p}").select(FP.sketch(F.col("text"), 10**6).alias("s")).collect() for h in r.s})[: FP.SIZE]
              for p in (0, 1)}
    assert whole == hashes
    counts = sketches.select("text", FP.distinct_count(F.col("sketch")).alias("n"), FP.containment(F.col("sketch"), F.col("sketch")).alias("c")).collect()
    for r in counts:
        n = len(shingle_set(r.text))
        assert (r.n == n if n < FP.SIZE else abs(r.n - n) < 0.4 * n) and r.c == pytest.approx(1.0)


def test_shards_are_near_equal_and_gapless(spark, corpus):
    rng = random.Random(1)
    rows = [(i, "x" * rng.randrange(1, 400), rng.choice(["en", "fr", None]), "hot" if i % 3 else f"s{i}") for i in range(3000)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    out = K.sharded(df, 13, chunk=50).collect()
    assert len(out) == 3000 and {r.shard for r in out} == set(range(13))
    sizes, slots = {}, {}
    for r in out:
        sizes[r.shard] = sizes.get(r.shard, 0) + r["size"]
        slots.setdefault(r.shard, []).append(r.slot)
    assert max(sizes.values()) - min(sizes.values()) < 0.05 * sum(sizes.values()) / 13
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    texts = {r[0]: r[1] for r in rows}
    assert all(r["size"] == len(texts[r.doc_id]) + 16 and r.text_crc32 == zlib.crc32(texts[r.doc_id].encode()) for r in out)


def test_first_cut_is_the_weighted_median_of_the_widest_dimension(spark):
    rows = [(i, "y" * (1 + i % 50)) for i in range(400)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    data = K.metadata(df).cache()
    splits = K.tree(data, 2)
    node, cut, _, _ = splits[0]
    points = [(r[f"c{node.dimension}"], r["size"]) for r in data.collect()]
    spread = {i: max(r[f"c{i}"] for r in data.collect()) - min(r[f"c{i}"] for r in data.collect()) for i in range(4)}
    assert spread[node.dimension] == max(spread.values())
    below = sum(s for c, s in points if c < cut)
    assert abs(below - sum(s for _, s in points) / 2) <= 0.01 * sum(s for _, s in points)


def test_repeated_rows_and_few_rows(spark):
    same = spark.createDataFrame([(1, "abc")] * 200 + [(None, None)], "doc_id long, text string")
    out = K.sharded(same, 4).collect()
    assert len(out) == 201 and max(sum(r.shard == s for r in out) for s in range(4)) < 80
    assert K.sharded(same.limit(0), 4).count() == 0
    two = K.sharded(spark.createDataFrame([(1, "a"), (2, "b")], "doc_id long, text string"), 5).collect()
    assert len(two) == 2 and all(r.slot == 0 for r in two)
