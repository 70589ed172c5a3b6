import random

import numpy as np
import pyarrow as pa
import pytest

from slotwise.llm import language as L
from slotwise.llm import texts as X
from slotwise.llm import unigram as U
from slotwise.llm.queries import PIECES


def test_language_model_on_held_out_rows(spark):
    rng = random.Random(3)
    alphabets = {"aa": "abcdefgé", "bb": "ghijklmñ", "cc": "nopqrstu"}
    rows = []
    for i in range(300):
        lang = rng.choice(list(alphabets))
        rows.append((i, " ".join("".join(rng.choices(alphabets[lang], k=5)) for _ in range(12)), lang if i % 7 else None))
    truth = {i: next(k for k, v in alphabets.items() if set(t) & set(v[:4])) for i, t, _ in rows}
    df = spark.createDataFrame(rows + [(900, None, "aa"), (901, "12 345 !", "aa"), (902, "", None), (None, "abc", "aa")],
                               "doc_id long, text string, lang string")
    got = {r.doc_id: r for r in L.predict_documents(df).collect()}
    assert all(got[i].lang_pred == truth[i] and 0.9 < got[i].score <= 1 for i in truth)
    assert [got[i].lang_pred for i in (900, 901, 902)] == ["und"] * 3 and got[None].held_out is False
    kept = L.keep_recognised(df.withColumnRenamed("lang", "lang").selectExpr("*", "'mine' as score"))
    assert {r.doc_id for r in kept.collect()} == set(truth) | {None} and kept.first().score == "mine"


def test_counts_add_up_over_slices():
    rows = ["Añb cd", "", "  x", "1 2"]
    data, offsets = X.text_buffers(pa.array(rows))
    grams = L.Grams(sizes=(1, 2))
    seen = [np.bincount(owner, minlength=4).tolist() for _, owner, _ in L.gram_buckets(data, offsets, grams)]
    assert seen == [[5, 0, 1, 0], [7, 1, 3, 2]]  # " añb cd ", "  ", "  x ", and stretches without letters as one space


def test_no_labels_gives_undetermined(spark):
    df = spark.createDataFrame([(1, "abc", None)], "doc_id long, text string, lang string")
    assert [(r.lang_pred, r.score) for r in L.predict_documents(df).collect()] == [("und", 0.0)]


@pytest.fixture(scope="module")
def vocabulary():
    return U.Vocabulary.load(PIECES)


def best_score(text, v):
    """Dynamic programme over a dictionary of pieces."""
    pieces, is_byte = {}, set(v.byte_ids.tolist())
    for i in range(len(v.score)):
        raw = v.piece_bytes[v.piece_at[i] : v.piece_at[i + 1]].tobytes()
        if raw and i not in is_byte:
            try:
                pieces[raw.decode()] = v.score[i]
            except UnicodeDecodeError:
                pass
    pieces.pop(" ⁇ ", None)
    text = " " + text if v.prefix and text else text
    best = [0.0] + [float("-inf")] * len(text)
    for i in range(len(text)):
        for j in range(i + 1, min(len(text), i + 20) + 1):
            s = pieces.get(text[i:j], v.unknown if j == i + 1 else None)
            if s is not None:
                best[j] = max(best[j], best[i] + s)
    return best[-1]


SAMPLES = ["", "hello world", "naïve café  au lait", "日本語 ▁ text", "a\nb\tc", "😀", "   ", "supercalifragilistic " * 9 + "x" * 200]


def test_double_array_finds_all_keys():
    rng = random.Random(1)
    keys = {bytes(rng.choices(b"abcxyz\xff\x00", k=rng.randint(1, 6))): i for i in range(500)}
    trie = U.DoubleArray(keys)

    def find(key):
        s = 0
        for c in key:
            t = int(trie.base[s]) + c
            if trie.check[t] != s:
                return -1
            s = t
        return int(trie.value[s])

    assert all(find(k) == i for k, i in keys.items())
    assert all(find(k + b"q") == -1 for k in keys)


def test_viterbi_is_best_and_alone_agrees(vocabulary):
    v = vocabulary
    data, offsets = X.text_buffers(pa.array(SAMPLES))
    ids, at = U.encode_slice(data, offsets, v)
    back, back_at = U.decode_slice(ids, at, v)
    assert np.array_equal(back, data) and np.array_equal(back_at, offsets)
    is_byte = set(v.byte_ids.tolist())
    for i, text in enumerate(SAMPLES):
        own = ids[at[i] : at[i + 1]].tolist()
        raw = ((" " if v.prefix and text else "") + text).encode()
        assert U._viterbi_alone(raw, v).tolist() == own
        if not is_byte & set(own):
            assert sum(v.score[k] for k in own) == pytest.approx(best_score(text, v))


def test_single_words_as_the_library_lattice_has_them(vocabulary):
    import sentencepiece as sp

    pb = pytest.importorskip("sentencepiece.sentencepiece_model_pb2")
    model = pb.ModelProto()
    with open(PIECES, "rb") as file:
        model.ParseFromString(file.read())
    model.trainer_spec.model_type = 1
    library = sp.SentencePieceProcessor(model_proto=model.SerializeToString())
    words = "the tokens of reading uneventful Überraschung garçon niño 12345 x".split()
    data, offsets = X.text_buffers(pa.array(words))
    ids, at = U.encode_slice(data, offsets, vocabulary)
    assert [ids[at[i] : at[i + 1]].tolist() for i in range(len(words))] == [library.nbest_encode(w, nbest_size=2)[0] for w in words]


def test_encode_and_decode_a_table(spark):
    df = spark.createDataFrame([(i, t, 1) for i, t in enumerate(SAMPLES)] + [(99, None, 1)], "doc_id long, text string, ids int")
    rows = U.encode(df, PIECES)
    got = {r.doc_id: r for r in U.decode(rows, PIECES).collect()}
    assert all(got[i].decoded == t and got[i].round_trip and got[i].n_tokens == len(got[i].ids) for i, t in enumerate(SAMPLES))
    assert got[99].ids is None and got[99].decoded is None and got[99].n_tokens == 0
