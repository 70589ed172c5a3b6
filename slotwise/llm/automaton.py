"""One minimal deterministic automaton for many byte patterns, as a transition array."""

from __future__ import annotations

import re
from functools import cached_property
from re import _constants as C
from re import _parser

import numpy as np

ANY = frozenset(range(256))
_CLASSES = {
    C.CATEGORY_DIGIT: frozenset(b"0123456789"), C.CATEGORY_SPACE: frozenset(b" \t\n\r\f\v"),
    C.CATEGORY_WORD: frozenset(c for c in range(128) if chr(c).isalnum() or c == 95),
}
_CLASSES |= {getattr(C, str(k).replace("CATEGORY_", "CATEGORY_NOT_")): ANY - v for k, v in list(_CLASSES.items())}


class Nfa:
    """Thompson construction; state 0 is the start. Moves are (byte set, target), free moves are targets."""

    def __init__(self):
        self.moves: list[list[tuple[frozenset, int]]] = [[]]
        self.free: list[list[int]] = [[]]
        self.accept: dict[int, int] = {}

    def state(self) -> int:
        self.moves.append([])
        self.free.append([])
        return len(self.moves) - 1

    def add(self, pattern: str, rule: int, anywhere_from: int = 0) -> None:
        tree = _parser.parse(pattern.encode(), 0)
        folded = bool(tree.state.flags & re.IGNORECASE)
        start = self.state()
        self.free[anywhere_from].append(start)
        self.accept[self._sequence(tree, start, folded)] = rule

    def _sequence(self, items, at: int, folded: bool) -> int:
        for op, value in items:
            at = self._one(op, value, at, folded)
        return at

    def _one(self, op, value, at: int, folded: bool) -> int:
        if op in (C.LITERAL, C.NOT_LITERAL, C.IN, C.ANY):
            end = self.state()
            self.moves[at].append((_byte_set(op, value, folded), end))
            return end
        if op is C.SUBPATTERN:
            _, more, less, inner = value
            return self._sequence(inner, at, (folded or bool(more & re.IGNORECASE)) and not less & re.IGNORECASE)
        if op is C.BRANCH:
            end = self.state()
            for branch in value[1]:
                first = self.state()
                self.free[at].append(first)
                self.free[self._sequence(branch, first, folded)].append(end)
            return end
        if op is C.MAX_REPEAT:
            least, most, inner = value
            for _ in range(least):
                at = self._sequence(inner, at, folded)
            if most is C.MAXREPEAT:
                loop, end = self.state(), self.state()
                self.free[at] += [loop, end]
                self.free[self._sequence(inner, loop, folded)] += [loop, end]
                return end
            end = self.state()
            self.free[at].append(end)
            for _ in range(most - least):
                at = self._sequence(inner, at, folded)
                self.free[at].append(end)
            return end
        raise ValueError(f"not a regular byte pattern: {op}")


def _byte_set(op, value, folded: bool) -> frozenset:
    if op is C.ANY:
        return ANY - {10}
    if op is C.LITERAL:
        found = {value}
    elif op is C.NOT_LITERAL:
        return ANY - _byte_set(C.LITERAL, value, folded)
    else:
        found, negate = set(), False
        for kind, v in value:
            if kind is C.NEGATE:
                negate = True
            elif kind is C.LITERAL:
                found.add(v)
            elif kind is C.RANGE:
                found.update(range(v[0], v[1] + 1))
            else:
                found |= _CLASSES[v]
        if folded:
            found |= {ord(chr(c).swapcase()) for c in found if c < 128}
        return frozenset(ANY - found if negate else found)
    if folded:
        found |= {ord(chr(c).swapcase()) for c in found if c < 128}
    return frozenset(found)


class Dfa:
    """``table[state * 256 + byte]`` is the next state, ``accepts[state]`` a bit per rule; state 0 is the start.

    With ``anywhere`` a match may begin at every byte; otherwise only at the first one, and state ``dead`` has no way out.
    """

    def __init__(self, patterns: list[str], anywhere: bool):
        nfa = Nfa()
        if anywhere:
            nfa.moves[0].append((ANY, 0))
        for rule, pattern in enumerate(patterns):
            nfa.add(pattern, rule)
        table, accepts = _minimise(*_subsets(nfa))
        self.states = len(accepts)
        self.table = table.astype(np.uint16 if self.states < 65536 else np.uint32).ravel()
        self.accepts = accepts
        loops = (table == np.arange(self.states)[:, None]).all(axis=1) & (accepts == 0)
        self.dead = int(np.flatnonzero(loops)[0]) if loops.any() and not anywhere else -1
        self.resets = (table == 0).all(axis=0)

    @cached_property
    def lists(self) -> tuple[list[int], list[int]]:
        """Table and accepted rules for a walk byte by byte."""
        return self.table.tolist(), self.accepts.tolist()


def _closed(nfa: Nfa, states) -> frozenset:
    seen, todo = set(states), list(states)
    while todo:
        for target in nfa.free[todo.pop()]:
            if target not in seen:
                seen.add(target)
                todo.append(target)
    return frozenset(seen)


def _subsets(nfa: Nfa) -> tuple[np.ndarray, np.ndarray]:
    """Subset construction over classes of bytes that no move tells apart."""
    sets = sorted({s for moves in nfa.moves for s, _ in moves}, key=sorted)
    signature = {b: tuple(b in s for s in sets) for b in range(256)}
    classes = {sig: i for i, sig in enumerate(dict.fromkeys(signature.values()))}
    of_byte = np.array([classes[signature[b]] for b in range(256)])
    sample = {i: next(b for b in range(256) if of_byte[b] == i) for i in classes.values()}
    first = _closed(nfa, [0])
    number, todo, rows = {first: 0}, [first], []
    while todo:
        current = todo.pop(0)
        row = []
        for i in range(len(classes)):
            target = _closed(nfa, {t for s in current for bytes_, t in nfa.moves[s] if sample[i] in bytes_})
            if target not in number:
                number[target] = len(number)
                todo.append(target)
            row.append(number[target])
        rows.append(row)
    accepts = np.zeros(len(number), np.int64)
    for states, i in number.items():
        for s in states:
            if s in nfa.accept:
                accepts[i] |= 1 << nfa.accept[s]
    return np.array(rows)[:, of_byte], accepts


def _minimise(table: np.ndarray, accepts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Merge equivalent states by partition refinement; the start stays state 0."""
    block = np.unique(accepts, return_inverse=True)[1]
    while True:
        _, finer = np.unique(np.column_stack([block, block[table]]), axis=0, return_inverse=True)
        finer = finer.ravel()
        if finer.max() == block.max():
            break
        block = finer
    order = np.argsort(np.unique(block, return_index=True)[1], kind="stable")
    renamed = np.empty(len(order), np.int64)
    renamed[order] = np.arange(len(order))
    block = renamed[block]
    first = np.unique(block, return_index=True)[1]
    return block[table[first]], accepts[first]


#: Bytes of a lane before the next reset byte, and how few lanes are better followed one by one.
LANE, FEW = 1024, 12


def lanes(data: np.ndarray, offsets: np.ndarray, resets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Begin and end of stretches that can be scanned on their own: rows, cut after bytes that lead to the start state."""
    cut = np.flatnonzero(resets[data]) + 1
    begin = []
    for first, last in zip(offsets[:-1].tolist(), offsets[1:].tolist()):
        at = first
        while at < last:
            begin.append(at)
            if last - at <= 2 * LANE:
                break
            i = int(np.searchsorted(cut, at + LANE))
            at = int(cut[i]) if i < len(cut) and cut[i] < last else last
    begin = np.array(begin, np.int64)
    end = np.append(begin[1:], len(data))
    return begin, end


def scan(data: np.ndarray, offsets: np.ndarray, dfa: Dfa) -> tuple[np.ndarray, np.ndarray]:
    """(end byte, rule bits) of every place where a match ends, in order: one pass over all bytes for all rules."""
    begin, end = lanes(data, offsets, dfa.resets)
    order = np.argsort(begin - end, kind="stable")
    begin, length = begin[order], (end - begin)[order]
    state = np.zeros(len(begin), np.int64)
    table, accepting = dfa.table, dfa.accepts > 0
    places, states = [], []
    active = np.searchsorted(-length, -np.arange(1, int(length[0]) + 1 if len(length) else 1), "right")
    t = 0
    while t < len(active) and active[t] > FEW:
        n = active[t]
        state = table[state[:n] * 256 + data[begin[:n] + t]].astype(np.int64)
        hit = np.flatnonzero(accepting[state])
        if len(hit):
            places.append(begin[hit] + t + 1)
            states.append(state[hit])
        t += 1
    if t < len(active):
        flat, good = dfa.lists
        for i in range(active[t]):
            s, where = int(state[i]), int(begin[i]) + t
            for place, b in enumerate(data[where : begin[i] + length[i]].tobytes(), where + 1):
                s = flat[s * 256 + b]
                if good[s]:
                    places.append(np.array([place]))
                    states.append(np.array([s]))
    if not places:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    places, states = np.concatenate(places), np.concatenate(states)
    order = np.argsort(places, kind="stable")
    return places[order], dfa.accepts[states[order]]


def leftmost_longest(raw: bytes, dfa: Dfa) -> list[tuple[int, int]]:
    """Non-overlapping matches of a one-rule automaton that starts at a given byte."""
    (table, accepts), dead = dfa.lists, dfa.dead
    can_start = [table[b] != dead for b in range(256)]
    out, at, n = [], 0, len(raw)
    while at < n:
        if not can_start[raw[at]]:
            at += 1
            continue
        s, best = 0, -1
        for place in range(at, n):
            s = table[s * 256 + raw[place]]
            if s == dead:
                break
            if accepts[s]:
                best = place + 1
        if best > at:
            out.append((at, best))
            at = best
        else:
            at += 1
    return out
