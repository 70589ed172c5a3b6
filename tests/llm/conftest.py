import random

import pytest

SYLLABLES = "an be co du el fi go ha in jo ka lu me no or pa qui ra se tu un ve wi xo yo za".split()


def prose(rng, n, vocabulary=None):
    words = vocabulary or ["".join(rng.choices(SYLLABLES, k=rng.randint(1, 3))) for _ in range(400)]
    return [rng.choice(words) for _ in range(n)]


@pytest.fixture(scope="session")
def corpus(spark):
    """Random documents with copies, near copies, shared lines and passages, nulls and empties."""
    rng = random.Random(5)
    vocabulary = ["".join(rng.choices(SYLLABLES, k=rng.randint(1, 4))) for _ in range(600)]
    passage = prose(rng, 60, vocabulary)
    rows, base = [], prose(rng, 120, vocabulary)
    for i in range(60):
        words = prose(rng, rng.randint(1, 150), vocabulary)
        if i % 9 == 0:
            words = words[:20] + passage + words[20:]
        if i % 5 == 0:
            words = list(base)
            for _ in range(rng.randint(0, 8)):
                words[rng.randrange(len(words))] = rng.choice(vocabulary)
        text = " ".join(words)
        lines = [text[k : k + 70] for k in range(0, len(text), 70)] + ["shared notice of seven words in here"] * (i % 3 == 0)
        rows.append((i * 3 % 181, "\n".join(lines), "en" if i % 2 else "fr", f"src{i % 4}", len(text)))
    rows += [(500, rows[3][1], "en", None, 1), (501, None, None, None, None), (502, "", "fr", "src0", 0), (503, "é", None, "x", 1)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")


@pytest.fixture(scope="session")
def benchmark_table(spark, corpus):
    texts = [r.text for r in corpus.where("doc_id in (0, 27)").collect()]
    rows = [(i, t[10:330]) for i, t in enumerate(texts)] + [(7, "just three words"), (8, None), (9, ""), (None, texts[0][50:250])]
    return spark.createDataFrame(rows, "item_id long, text string")
