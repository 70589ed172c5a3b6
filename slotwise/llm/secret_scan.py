"""Secrets in texts: all rules in one pass of a combined automaton, then exact spans where it fired."""

from __future__ import annotations

import hashlib
import re
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from slotwise.llm import texts
from slotwise.llm.automaton import Dfa, leftmost_longest, scan


@dataclass(frozen=True)
class Rule:
    """``pattern`` finds matches; a match stays if ``group`` of it has at least ``least`` characters."""

    kind: str
    pattern: str
    group: int = 0
    least: int = 1


# The contract's rules, in its order.
BASE = (
    Rule("assign", r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 1, 6),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 20),
    Rule("hex", r"[0-9a-f]{24,}", 0, 24),
)
#: Public token formats besides.
MORE = (
    Rule("hub", r"gh[pousr]_[A-Za-z0-9]+", 0, 40),
    Rule("private", r"-----BEGIN [A-Z ]*PRIVATE KEY-----", 0, 1),
)
RULES = BASE + MORE


@lru_cache(maxsize=4)
def compiled(rules: tuple[Rule, ...]) -> tuple[Dfa, list[Dfa], list[re.Pattern]]:
    """The combined automaton, one automaton per rule, and the patterns for the groups."""
    return (Dfa([r.pattern for r in rules], True), [Dfa([r.pattern], False) for r in rules],
            [re.compile(r.pattern.encode()) for r in rules])


def spans_in(data: np.ndarray, offsets: np.ndarray, rules: tuple[Rule, ...] = RULES, automata=None) -> dict[int, list]:
    """Row to a sorted list of (begin, rule, end) in code points; rows without secrets are absent."""
    combined, single, patterns = automata or compiled(rules)
    places, bits = scan(data, offsets, combined)
    fired: dict[int, int] = {}
    for row, b in zip((np.searchsorted(offsets, places - 1, "right") - 1).tolist(), bits.tolist()):
        fired[row] = fired.get(row, 0) | b
    out = {}
    for row, bits_ in fired.items():
        part = data[offsets[row] : offsets[row + 1]]
        raw, found = part.tobytes(), []
        point = None
        for i, rule in enumerate(rules):
            if bits_ >> i & 1:
                for begin, end in leftmost_longest(raw, single[i]):
                    match = patterns[i].fullmatch(raw, begin, end)
                    if match.end(rule.group) - match.start(rule.group) >= rule.least:
                        if point is None:
                            point = np.concatenate([[0], np.cumsum((part & 0xC0) != 0x80)])
                        found.append((int(point[begin]), i, int(point[end])))
        if found:
            out[row] = sorted(found)
    return out


def named(found: list[tuple[int, int, int]], rules: tuple[Rule, ...]) -> str:
    return ",".join(f"{rules[i].kind}:{begin}:{end}" for begin, i, end in found)


def secrets(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """``docs`` with ``secrets``: array of (kind, begin, end), code points, end exclusive, by begin and order of the rules.

    Matches are leftmost and longest, and do not overlap within a rule. Null and empty texts have none. A column
    of ``docs`` with that name is replaced.
    """
    kinds = [r.kind for r in rules]
    base = texts.no_clash(docs, "secrets")
    shared = docs.sparkSession.sparkContext.broadcast(compiled(rules))  # a transition array of under a megabyte

    def work(batch, data, offsets):
        found = spans_in(data, offsets, rules, shared.value)
        rows = [[{"kind": kinds[i], "begin": b, "end": e} for b, i, e in found.get(r, ())] for r in range(len(offsets) - 1)]
        kind = pa.list_(pa.struct([("kind", pa.string()), ("begin", pa.int64()), ("end", pa.int64())]))
        return pa.RecordBatch.from_arrays([*batch.columns, pa.array(rows, kind)], [*batch.schema.names, "secrets"])

    span = T.StructType([T.StructField("kind", T.StringType()), T.StructField("begin", T.LongType()), T.StructField("end", T.LongType())])
    return base.mapInArrow(texts.by_slice(work), texts.schema_with(base, T.StructField("secrets", T.ArrayType(span))))


def joined(found) -> str:
    """Digest text for tests."""
    return hashlib.sha256(found.encode()).hexdigest()
