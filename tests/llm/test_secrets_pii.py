import datetime
import hashlib
import random
import re

import pytest

from slotwise.llm import automaton as A
from slotwise.llm import pseudonyms as P
from slotwise.llm.secret_scan import BASE, RULES, named, secrets, spans_in
from slotwise.llm import texts as X

import pyarrow as pa

PLAIN = [
    (re.compile(r"""((?ai:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""), lambda m: len(m[2]) >= 6),
    (re.compile("AKIA[A-Z0-9]+"), lambda m: len(m[0]) >= 20),
    (re.compile("[0-9a-f]+"), lambda m: len(m[0]) >= 24)]


def brute(text):
    return sorted((m.start(), i, m.end()) for i, (p, good) in enumerate(PLAIN) for m in p.finditer(text) if good(m))


def test_base_spans_against_the_plain_patterns():
    rng = random.Random(1)
    bits = ["token", "Secret", "apikey", "api_key", "passwd", "PASSWORD", "=", ":", " ", "  ", '"', "'", "abc", "deadbeef" * 3, "é", "\n",
            "AKIA", "ABCD1234EFGH5678", "x" * 5, "=token", "0123456789abcdef", "-", "K", "ſecret"]
    rows = ["".join(rng.choice(bits) for _ in range(rng.randint(0, 30))) for _ in range(400)] + ["", "a" * 5000 + " token=" + "b" * 3000]
    data, offsets = X.text_buffers(pa.array(rows))
    found = spans_in(data, offsets, BASE)
    assert [found.get(i, []) for i in range(len(rows))] == [brute(t) for t in rows]
    assert sum(map(len, found.values())) > 100


def test_automaton_is_minimal_and_scans_like_search():
    assert A.Dfa(["a[bc]+d|a[cb]+d"], False).states == A.Dfa(["a[bc]+d"], False).states == 5
    dfa = A.Dfa(["ab*c", "[0-9]{3}"], True)
    data, offsets = X.text_buffers(pa.array(["xabbc123", "", "12ac4567"]))
    ends, bits = A.scan(data, offsets, dfa)
    assert list(zip(ends.tolist(), bits.tolist())) == [(5, 1), (8, 2), (12, 1), (15, 2), (16, 2)]
    with pytest.raises(ValueError):
        A.Dfa([r"(a)\1"], False)


def test_secrets_of_a_table(spark):
    text = 'é token = "24be64439e3e49cf46b2d7c90f3602a3d0b907ff" -----BEGIN RSA PRIVATE KEY----- ghp_' + "A" * 36
    df = spark.createDataFrame([(1, text, 5), (2, None, None), (3, "", 1), (4, "password: short", 1)], "doc_id long, text string, secrets int")
    got = {r.doc_id: [(s.kind, s.begin, s.end) for s in r.secrets] for r in secrets(df).collect()}
    assert got[1][0] == ("assign", 2, 51) and [k for k, _, _ in got[1]] == ["assign", "hex", "private", "hub"]
    assert got[2] == got[3] == [] and got[4] == []
    assert named([(2, 0, 5)], RULES) == "assign:2:5" and len(hashlib.sha256(b"").hexdigest()) == 64


KEY = b"a key of the tests"


@pytest.mark.parametrize("size", [1, 2, 3, 10, 97, 1000])
def test_feistel_permutes(size):
    f = P.Feistel(KEY, size, "t")
    assert sorted(map(f.forward, range(size))) == list(range(size))
    assert all(f.back(f.forward(i)) == i for i in range(size))


def test_formats_links_and_inverse():
    text = ("a.b9@x.example.com 4111 1111 1111 1111 and 4111111111111111, 10.0.7.255. +1 (743) 555-3824 1984-02-29 29.02.1984 "
            "12/25/1999 123-45-6789 DE89 3704 0044 0532 0130 00 999.1.1.1 2021-02-30 4111111111111112 1.2.3")
    new, spans = P.replace(text, KEY)
    parts = {}
    for kind, begin, end in spans:
        parts.setdefault(kind, []).append(new[begin:end])
    assert P.restore(new, spans, KEY) == text
    cards = [re.sub(r"\D", "", c) for c in parts["card"]]
    assert cards[0] == cards[1] != "4111111111111111" and P.luhn_digit(cards[0][:-1]) == cards[0][-1]
    first = datetime.date.fromisoformat(parts["date_ymd"][0])
    assert parts["date_dmy"][0] == first.strftime("%d.%m.%Y") and len(parts["iban"]) == 1
    assert "999.1.1.1" in new and "2021-02-30" in new and "4111111111111112" not in new
    assert P.replace(text, b"another")[0] != new


def test_pseudonyms_of_a_table(spark):
    df = spark.createDataFrame([(1, "ssn 123-45-6789"), (2, "again 123-45-6789 é"), (3, None), (4, ""), (5, "no digits")], "doc_id long, text string")
    got = {r.doc_id: r for r in P.pseudonymise(df, KEY).collect()}
    assert got[1].text[4:] == got[2].text[6:17] != "123-45-6789"
    assert got[3].text is None and got[4].text == "" and got[5].text == "no digits" and got[5].pii == []


def test_values_next_to_other_numbers():
    spans = lambda text: {(k, text[b:e]) for k, b, e in old_spans(text)}

    def old_spans(text):
        new, found = P.replace(text, KEY)
        assert P.restore(new, found, KEY) == text and len(new) == len(text)
        return found

    spaced, plain = "4111 1111 1111 1111", "4111111111111111"
    for text in (f"{spaced} 12/25", f"card {spaced} 123", f"pos 7 {spaced}", f"{plain} 09/27", f"12 {spaced} 123 45", f"1 2 3 4 5 6 7 {spaced}"):
        assert ("card", spaced if spaced in text else plain) in spans(text)
    digits = lambda text: re.sub(r"\D", "", text)
    assert digits(P.replace(f"{spaced} 12/25", KEY)[0])[:16] == P.replace(plain, KEY)[0] == P.replace(f"{plain} 09/27", KEY)[0][:16]
    assert spans("call 415-555-1234 24 hours") == {("phone", "415-555-1234")}
    assert spans("room 23 415-555-1234") == {("phone", "415-555-1234")}
    assert spans("+1 (743) 555-3824 1984-02-29") == {("phone", "+1 (743) 555-3824"), ("date_ymd", "1984-02-29")}
    assert spans("1984-02-29 743-555-3824 ") == {("phone", "743-555-3824"), ("date_ymd", "1984-02-29")}
    assert ("iban", "DE89 3704 0044 0532 0130 00") in spans("DE89 3704 0044 0532 0130 00 2024 AB")
