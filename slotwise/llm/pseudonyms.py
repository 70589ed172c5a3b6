"""Personal numbers and dates replaced by keyed pseudonyms of the same format; equal values get equal pseudonyms."""

from __future__ import annotations

import datetime
import hashlib
import re
from collections.abc import Callable
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from slotwise.llm import texts

ROUNDS = 8


class Feistel:
    """Keyed permutation of 0 .. size - 1: a balanced Feistel network on the next even number of bits, walked until inside."""

    def __init__(self, key: bytes, size: int, tweak: str):
        self.size = size
        self.half = max(1, -(-max(size - 1, 1).bit_length() // 2))
        self.mask = (1 << self.half) - 1
        self.salt = hashlib.blake2b(f"{tweak}:{size}".encode(), key=key, digest_size=32).digest()

    def _f(self, i: int, value: int) -> int:
        width = -(-self.half // 8)
        raw = hashlib.blake2b(bytes([i]) + value.to_bytes(width, "big"), key=self.salt, digest_size=min(64, width + 8)).digest()
        return int.from_bytes(raw, "big") & self.mask

    def _once(self, value: int, rounds) -> int:
        left, right = value >> self.half, value & self.mask
        for i in rounds:
            left, right = right, left ^ self._f(i, right)
        return left << self.half | right

    def forward(self, value: int) -> int:
        while True:
            value = self._once(value, range(ROUNDS))
            if value < self.size:
                return value

    def back(self, value: int) -> int:
        while True:
            swapped = (value & self.mask) << self.half | value >> self.half
            swapped = self._once(swapped, range(ROUNDS - 1, -1, -1))
            value = (swapped & self.mask) << self.half | swapped >> self.half
            if value < self.size:
                return value


@lru_cache(maxsize=4096)
def permutation(key: bytes, size: int, tweak: str) -> Feistel:
    return Feistel(key, size, tweak)


def moved(key: bytes, value: int, size: int, tweak: str, back: bool) -> int:
    p = permutation(key, size, tweak)
    return p.back(value) if back else p.forward(value)


def _mixed(digits: list[int], sizes: list[int], key: bytes, tweak: str, back: bool) -> list[int]:
    """Permute a tuple of places with the given radixes as one number."""
    value, total = 0, 1
    for d, n in zip(digits, sizes):
        value, total = value * n + d, total * n
    value = moved(key, value, total, tweak, back)
    out = []
    for n in reversed(sizes):
        value, d = divmod(value, n)
        out.append(d)
    return out[::-1]


def _fill(shape: str, digits: str) -> str:
    """Put digits back into their places."""
    it = iter(digits)
    return "".join(next(it) if c.isdigit() else c for c in shape)


def luhn_digit(body: str) -> str:
    total = 0
    for i, c in enumerate(reversed(body)):
        d = int(c) * (2 if i % 2 == 0 else 1)
        total += d - 9 if d > 9 else d
    return str(-total % 10)


def _classes(text: str, key: bytes, tweak: str, back: bool) -> str:
    """Permute letters among letters of the same case and digits among digits, all places as one number."""
    alphabets = ["0123456789", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"]
    places = [(i, next(a for a in alphabets if c in a)) for i, c in enumerate(text) if c.isascii() and c.isalnum()]
    if not places:
        return text
    found = _mixed([a.index(text[i]) for i, a in places], [len(a) for _, a in places], key,
                   tweak + "".join("dlu"[alphabets.index(a)] for _, a in places), back)
    out = list(text)
    for (i, a), d in zip(places, found):
        out[i] = a[d]
    return "".join(out)


def email(s: str, key: bytes, back: bool) -> str | None:
    local, _, domain = s.rpartition("@")
    return _classes(local, key, "email:" + domain.lower(), back) + "@" + domain


def iban(s: str, key: bytes, back: bool) -> str | None:
    check = lambda body: int("".join(str(int(c, 36)) for c in body)) % 97
    plain = s.replace(" ", "")
    if not 15 <= len(plain) <= 34 or check(plain[4:] + plain[:4]) != 1:
        return None
    body = _classes(plain[4:], key, "iban:" + plain[:2], back)
    new = iter(plain[:2] + f"{98 - check(body + plain[:2] + '00'):02d}" + body)
    return "".join(c if c == " " else next(new) for c in s)


def ipv4(s: str, key: bytes, back: bool) -> str | None:
    parts = s.split(".")
    if any(str(int(p)) != p or int(p) > 255 for p in parts):
        return None
    least = [(0, 0, 10, 100)[len(p)] for p in parts]
    sizes = [(0, 10, 90, 156)[len(p)] for p in parts]
    new = _mixed([int(p) - a for p, a in zip(parts, least)], sizes, key, "ipv4", back)
    return ".".join(str(d + a) for d, a in zip(new, least))


#: Days are permuted inside these ranges of years, so recent dates stay recent.
YEARS = ((1, 1899), (1900, 2099), (2100, 9999))


def _day(day: datetime.date, key: bytes, back: bool) -> datetime.date:
    first, last = next(r for r in YEARS if r[0] <= day.year <= r[1])
    low, high = datetime.date(first, 1, 1).toordinal(), datetime.date(last, 12, 31).toordinal()
    return datetime.date.fromordinal(low + moved(key, day.toordinal() - low, high - low + 1, f"date{first}", back))


def date_in(order: str) -> Callable[[str, bytes, bool], str | None]:
    def change(s: str, key: bytes, back: bool) -> str | None:
        parts = re.split(r"([-/.])", s)
        try:
            found = _day(datetime.date(**{order[i]: int(parts[2 * i]) for i in range(3)}), key, back)
        except ValueError:
            return None
        for i in range(3):
            parts[2 * i] = str(getattr(found, order[i])).zfill(4 if order[i] == "year" else len(parts[2 * i]))
        return "".join(parts)

    order = [{"y": "year", "m": "month", "d": "day"}[c] for c in order]
    return change


def ssn(s: str, key: bytes, back: bool) -> str | None:
    area, group, serial = (int(p) for p in s.split("-"))
    if area in (0, 666) or area >= 900 or not group or not serial:
        return None
    area, group, serial = _mixed([area - 1 - (area > 666), group - 1, serial - 1], [898, 99, 9999], key, "ssn", back)
    return f"{area + 1 + (area + 1 >= 666):03d}-{group + 1:02d}-{serial + 1:04d}"


def card(s: str, key: bytes, back: bool) -> str | None:
    digits = re.sub(r"\D", "", s)
    if not 13 <= len(digits) <= 19 or luhn_digit(digits[:-1]) != digits[-1]:
        return None
    body = digits[0] + _classes(digits[1:-1], key, "card" + digits[0], back)
    return _fill(s, body + luhn_digit(body))


def phone(s: str, key: bytes, back: bool) -> str | None:
    digits = re.sub(r"\D", "", s)
    national = digits[-10:]
    american = len(digits) == 10 or len(digits) == 11 and digits[0] == "1"
    if american and national[0] in "23456789" and national[3] in "23456789":
        a = _mixed([int(national[:3]) - 200, int(national[3:6]) - 200, int(national[6:])], [800, 800, 10000], key, "phone", back)
        return _fill(s, digits[:-10] + f"{a[0] + 200}{a[1] + 200}{a[2]:04d}")
    if s.startswith("+") and 8 <= len(digits) <= 15:
        return _fill(s, digits[:2] + _classes(digits[2:], key, "phone" + digits[:2], back))
    return None


def account(s: str, key: bytes, back: bool) -> str | None:
    return _classes(s, key, "account", back)


#: Kind, shape and change, in order of precedence; a change gives None where the value is not valid for its kind.
KINDS: tuple[tuple[str, str, Callable[[str, bytes, bool], str | None]], ...] = (
    ("email", r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64}@(?:[A-Za-z0-9-]{1,63}\.){1,8}[A-Za-z]{2,24}", email),
    ("iban", r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]){11,30}(?![A-Za-z0-9])", iban),
    ("ipv4", r"(?<![0-9.])[0-9]{1,3}(?:\.[0-9]{1,3}){3}(?!\.?[0-9])", ipv4),
    ("date_ymd", r"(?<![0-9])[0-9]{4}([-/.])[0-9]{1,2}\1[0-9]{1,2}(?![0-9])", date_in("ymd")),
    ("date_dmy", r"(?<![0-9])[0-9]{1,2}([-/.])[0-9]{1,2}\1[0-9]{4}(?![0-9])", date_in("dmy")),
    ("date_mdy", r"(?<![0-9])[0-9]{1,2}([-/.])[0-9]{1,2}\1[0-9]{4}(?![0-9])", date_in("mdy")),
    ("ssn", r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])", ssn),
    ("card", r"(?<![0-9])[0-9](?:[ -]?[0-9]){12,18}(?![0-9])", card),
    ("phone", r"(?<![0-9+])\+?(?:[0-9]{1,3}[ .-]?)?(?:\([0-9]{2,4}\)[ .-]?)?[0-9]{2,4}(?:[ .-]?[0-9]{2,4}){1,4}(?![0-9])", phone),
    ("account", r"(?<![A-Za-z0-9])[0-9]{9,40}(?![A-Za-z0-9])", account),
)
#: Kind, pattern, what must follow a value (patterns don't see beyond a given end) and change.
_PATTERNS = [(kind, re.compile(shape), re.compile(shape[shape.rindex("(?!"):] if "(?!" in shape else ""), change) for kind, shape, change in KINDS]
_CHANGES = {kind: change for kind, _, change in KINDS}


def _values(text: str, kind: str, pattern: re.Pattern, tail: re.Pattern, change: Callable[[str], str | None], used: bytearray):
    """(begin, end, new) of the valid values of one kind outside ``used``, which is marked.

    A match is greedy and may hold other numbers beside the value. If it is not valid or overlaps, the longest valid value that
    begins and ends with groups of letters and digits in it is taken, then the rest is looked through again. Of cards, whose
    check digit also fits every tenth wrong cut, the one of the longest groups is taken.
    """
    tried: dict[tuple[int, int], str | None] = {}

    def valid(begin: int, end: int) -> str | None:
        if (begin, end) not in tried:
            whole = pattern.fullmatch(text, begin, end) and tail.match(text, end)
            tried[begin, end] = change(text[begin:end]) if whole else None
        return None if any(used[begin:end]) else tried[begin, end]

    def rank(begin: int, end: int) -> tuple[float, int]:
        size = sum(map(str.isdigit, text[begin:end]))
        return (size / len(re.findall("[0-9]+", text[begin:end])), size) if kind == "card" else (0, end - begin)

    at = 0
    while m := pattern.search(text, at):
        begin, end = m.span()
        best = (begin, end) if valid(begin, end) is not None else None
        if not best or kind == "card" and not m[0].isdigit():
            start = m
            while start and start.start() < end:
                b, e = start.span()
                while e > b:
                    if valid(b, e) is not None and (not best or rank(b, e) > rank(*best)):
                        best = b, e
                    e -= 1
                    while e > b and not (text[e - 1].isalnum() and not text[e].isalnum()):
                        e -= 1
                start = pattern.search(text, b + 1)
        if not best:
            at = begin + 1
            continue
        yield *best, valid(*best)
        used[best[0] : best[1]] = b"\1" * (best[1] - best[0])
        at = best[1] if best[0] == begin else begin


def replace(text: str, key: bytes) -> tuple[str, list[tuple[str, int, int]]]:
    """The text with pseudonyms, and (kind, begin, end) of each in the new text; kinds of higher precedence come first."""
    taken: list[tuple[int, int, str, str]] = []
    used = bytearray(len(text))
    has_digit, has_at = any(c in text for c in "0123456789"), "@" in text
    for kind, pattern, tail, change in _PATTERNS:
        if has_at if kind == "email" else has_digit:
            taken += [(b, e, kind, new) for b, e, new in _values(text, kind, pattern, tail, lambda s: change(s, key, False), used)]
    parts, spans, place, size = [], [], 0, 0
    for begin, end, kind, new in sorted(taken):
        parts += [text[place:begin], new]
        size += begin - place
        spans.append((kind, size, size + len(new)))
        size += len(new)
        place = end
    return "".join([*parts, text[place:]]), spans


def restore(text: str, spans: list[tuple[str, int, int]], key: bytes) -> str:
    """The text before ``replace``, out of its result and the key."""
    parts, place = [], 0
    for kind, begin, end in spans:
        parts += [text[place:begin], _CHANGES[kind](text[begin:end], key, True)]
        place = end
    return "".join([*parts, text[place:]])


def pseudonymise(docs: DataFrame, key: bytes) -> DataFrame:
    """``docs`` with the text's numbers and dates replaced, and ``pii``: (kind, begin, end) in the new text, by place.

    Numbers count only if valid for their kind (checksums, calendar, ranges); other runs of 9 to 40 digits that stand
    alone are accounts. Null and empty texts stay as they are and have no spans. A column ``pii`` of ``docs`` is replaced.
    """
    base = texts.no_clash(docs, "pii")
    marks = np.zeros(256, bool)
    marks[list(b"0123456789@")] = True

    def work(batch, data, offsets):
        place = batch.schema.get_field_index("text")
        seen = np.concatenate([[0], np.cumsum(marks[data])])[offsets]
        touched = np.flatnonzero(np.diff(seen) > 0).tolist()
        column, out, spans = batch.column(place), {}, [[] for _ in range(len(offsets) - 1)]
        for row in touched:
            out[row], found = replace(column[row].as_py(), key)
            spans[row] = [{"kind": k, "begin": b, "end": e} for k, b, e in found]
        changed = [r for r in touched if spans[r]]
        if changed:
            parts, at = [], 0
            for r in changed:
                parts += [column.slice(at, r - at), pa.array([out[r]], column.type)]
                at = r + 1
            column = pa.concat_arrays([*parts, column.slice(at)])
        kind = pa.list_(pa.struct([("kind", pa.string()), ("begin", pa.int64()), ("end", pa.int64())]))
        columns = [column if i == place else c for i, c in enumerate(batch.columns)]
        return pa.RecordBatch.from_arrays([*columns, pa.array(spans, kind)], [*batch.schema.names, "pii"])

    span = T.StructType([T.StructField("kind", T.StringType()), T.StructField("begin", T.LongType()), T.StructField("end", T.LongType())])
    return base.mapInArrow(texts.by_slice(work), texts.schema_with(base, T.StructField("pii", T.ArrayType(span))))
