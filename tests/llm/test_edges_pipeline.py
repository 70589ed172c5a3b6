"""Every operator and stage on nulls, empty tables, repeated rows, a very long text and clashing columns."""

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from slotwise.llm.queries import QUERIES

LONG = "lorem ipsum dolor sit amet consectetur adipiscing elit sed do " * 3000


@pytest.fixture(scope="module")
def folders(spark, tmp_path_factory):
    """Tables of odd rows: (folder, rows)."""
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    odd = [(1, None, None, None, None), (2, "", "en", "a", 0), (3, "   \n\n", "en", "a", 5), (4, LONG, "fr", "b", len(LONG)),
           (5, "same text of a few words here", "en", "a", 3), (6, "same text of a few words here", "en", "a", 3),
           (6, "same text of a few words here", "en", "a", 3), (None, "same text of a few words here", None, "a", 3),
           (7, "é\u0000 x" + "z" * 9000, "en", None, 1), (8, "password = hunter2hunter2 4111111111111111", "en", "c", 9)]
    extra = [f"{i} as {c}" for i, c in enumerate(
        "ids size shard slot hits items secrets pii label score lang_pred n_words n_hit deleted n_lines doc copy node root sketch".split())]
    out = {}
    for name, rows in (("odd", odd), ("empty", [])):
        folder = str(tmp_path_factory.mktemp(name))
        spark.createDataFrame(rows, schema).selectExpr("*", *extra).coalesce(2).write.parquet(f"{folder}/documents.parquet")
        items = [(1, "same text of a few words"), (None, None), (2, "")] if rows else []
        spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
        # as many valid vectors as documents, ties among them, and two that go
        vectors = [(i, [0.5 * (i // 2) - j for j in range(32)], "a" if i % 2 else None) for i in range(len(rows))]
        vectors += [(len(rows), None, None), (len(rows) + 1, [float("nan")] * 32, "b")] if rows else []
        spark.createDataFrame(vectors, "vec_id long, embedding array<float>, label string").write.parquet(f"{folder}/embeddings.parquet")
        out[name] = (folder, len(rows))
    return out


@pytest.mark.parametrize("name", list(QUERIES))
@pytest.mark.parametrize("table", ["odd", "empty"])
def test_queries_give_every_row(spark, folders, name, table):
    folder, rows = folders[table]
    found = QUERIES[name](spark, folder)
    assert found.count() == rows
    assert len(set(found.columns)) == len(found.columns)


@pytest.mark.parametrize("table", ["odd", "empty"])
def test_stages_keep_the_columns(spark, folders, table):
    folder, _ = folders[table]
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, folder)
        assert out.columns == docs.columns, name
        shown = [r.ids for r in out.collect()]
        assert all(i == 0 for i in shown)
    assert corpus_pipeline.STAGES[-1][1](spark, docs, folder).count() == docs.count()


def test_pipeline_by_parts(spark, corpus, benchmark_table, tmp_path):
    """What each stage keeps, against plain computations on its own input."""
    from tests.llm.test_decontaminate import brute as hits
    from tests.llm.test_near_copies import brute as groups
    from tests.llm.test_near_copies import sets_of
    from tests.llm.test_texts_lines_passages import lines_brute

    folder = str(tmp_path)
    corpus.write.parquet(f"{folder}/documents.parquet")
    benchmark_table.write.parquet(f"{folder}/benchmark.parquet")
    stages = dict(corpus_pipeline.STAGES)
    first = stages["language"](spark, corpus, folder)
    assert {r.doc_id for r in first.collect()} == {r.doc_id for r in corpus.collect() if r.text}
    first = spark.createDataFrame(first.collect(), corpus.schema)
    deleted = lines_brute([(r.doc_id, r.text) for r in first.collect()])
    second = stages["lines"](spark, first, folder).collect()
    for r in second:
        assert r.n_chars == len(r.text)
    want = {r.doc_id: "\n".join(x for i, x in enumerate(r.text.split("\n")) if i not in deleted[r.doc_id]) for r in first.collect()}
    assert {r.doc_id: r.text for r in second} == {k: t for k, t in want.items() if not deleted[k] or t.strip()}
    second = spark.createDataFrame(second, corpus.schema)
    third = stages["near_duplicates"](spark, second, folder).collect()
    roots = groups(sets_of(second.collect(), 5))
    assert {r.doc_id for r in third} == {k for k, v in roots.items() if k == v}
    third = spark.createDataFrame(third, corpus.schema)
    fourth = stages["benchmark"](spark, third, folder).collect()
    found = hits(third.collect(), benchmark_table.collect())
    assert {r.doc_id for r in fourth} == {k for k, (n, h, _) in found.items() if not (h and 20 * len(h) >= n)}
    whole = corpus_pipeline.run(spark, folder).where("round_trip").select(F.col("doc_id")).collect()
    assert {r.doc_id for r in whole} == {r.doc_id for r in fourth}
