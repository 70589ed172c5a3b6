"""Suffix arrays of many byte strings at once: Larsson-Sadakane refinement, Kasai's common prefixes, merging by binary search."""

from __future__ import annotations

import numpy as np

#: Bytes of the first keys; the low bits of a key hold how many of them the string still has.
_PACKED = 7
_FRONT = np.array([(0xFFFFFFFFFFFFFF << 8 * (7 - k)) & 0xFFFFFFFFFFFFFF for k in range(8)], np.uint64)


def words_at(data: np.ndarray, order: str) -> np.ndarray:
    """The eight bytes from every place on as one integer, zeros beyond the end."""
    return np.ndarray((len(data) + 1,), order + "u8", np.concatenate([data, np.zeros(8, np.uint8)]), strides=(1,))


def suffix_array(data: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Order of all suffixes of the strings in ``data``; ``ends`` is the end of the string of every byte.

    A string's end sorts before every byte, and equal suffixes by place. The first keys are seven bytes; then every group of
    suffixes that still ties is sorted by the group numbers found as many bytes ahead as the group has in common, which doubles
    at every pass; sorted groups are not touched again.
    """
    n = len(data)
    left = ends - np.arange(n, dtype=ends.dtype)
    inside = np.minimum(left, _PACKED)
    key = ((words_at(data, ">")[:n].astype(np.uint64) >> np.uint64(8)) & _FRONT[inside]) << np.uint64(3) | inside.astype(np.uint64)
    order = np.argsort(key).astype(np.int32)
    head = np.ones(n, bool)
    sorted_ = key[order]
    head[1:] = sorted_[1:] != sorted_[:-1]
    group = np.empty(n, np.int32)
    group[order] = np.flatnonzero(head)[np.cumsum(head) - 1]
    depth = _PACKED
    while True:
        single = head.copy()
        single[:-1] &= head[1:]
        tied = np.flatnonzero(~single)
        if not len(tied):
            return order
        at = order[tied]
        # a suffix that ended is settled: the place alone decides among its equals
        ahead = np.where(left[at] > depth, group[np.minimum(at + depth, n - 1)] + np.int32(n), at)
        both = group[at].astype(np.int64) * (2 * n + 1) + ahead
        again = np.argsort(both)
        at, both = at[again], both[again]
        order[tied] = at
        fresh = np.ones(len(tied), bool)
        fresh[1:] = both[1:] != both[:-1]
        head[tied] = fresh
        group[at] = tied[np.flatnonzero(fresh)][np.cumsum(fresh) - 1]
        depth *= 2


def common_prefixes(data: np.ndarray, order: np.ndarray, starts: np.ndarray, stops: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Length of the common prefix of suffixes with the one before them in ``order``, by Kasai's rule.

    A suffix that begins one byte later shares at most one byte less with its predecessor. All strings step through their bytes
    from ``starts`` to ``stops`` side by side, each with its own matched length; a step compares eight bytes at a time. Other
    suffixes get 0.
    """
    n = len(data)
    rank = np.empty(n, np.int32)
    rank[order] = np.arange(n, dtype=np.int32)
    before = np.concatenate([order[:1], order[:-1]])
    left = ends - np.arange(n, dtype=ends.dtype)
    words = words_at(data, "<")
    out = np.zeros(n, np.int32)
    lane = np.flatnonzero(starts < stops)
    at, matched, stop = starts[lane], np.zeros(len(lane), ends.dtype), stops[lane]
    while len(at):
        place = rank[at]
        other = before[place]
        most = np.where(place > 0, np.minimum(left[at], left[other]), 0)
        matched = np.minimum(matched, most)
        live = np.flatnonzero(matched < most)
        while len(live):
            m = matched[live]
            differ = words[at[live] + m] ^ words[other[live] + m]
            same = np.bitwise_count((differ & (~differ + np.uint64(1))) - np.uint64(1)) >> 3
            m = np.minimum(m + same, most[live])
            matched[live] = m
            live = live[(same == 8) & (m < most[live])]
        out[place] = matched
        matched = np.maximum(matched - 1, 0)
        at = at + 1
        on = at < stop
        if not on.all():
            at, matched, stop = at[on], matched[on], stop[on]
    return out


class Windows:
    """The distinct strings of ``length`` bytes in many strings, in suffix order, each with the least owner of its places."""

    def __init__(self, strings: list[bytes], owners: np.ndarray, length: int):
        sizes = np.array([len(s) for s in strings], np.int32)
        self.length = length
        self.stops = np.cumsum(sizes, dtype=np.int32)
        self.starts = self.stops - sizes
        self.data = np.frombuffer(b"".join(strings), np.uint8)
        ends = np.repeat(self.stops, sizes)
        order = suffix_array(self.data, ends)
        # only the suffixes at which a window begins count
        prefix = common_prefixes(self.data, order, self.starts, np.maximum(self.stops - length + 1, self.starts), ends)
        whole = ends[order] - order >= length
        self.places, head = order[whole], prefix[whole] < length
        self.first = self.places[head]
        self.group = np.cumsum(head) - 1
        owner = np.repeat(owners, sizes)[self.places]
        self.least = np.minimum.reduceat(owner, np.flatnonzero(head)) if len(self.first) else np.zeros(0, np.int64)
        self.words = words_at(self.data, ">")
        self.offsets = [*range(0, length - 7, 8), *([length - 8] if length % 8 else [])]

    def find(self, other: Windows) -> np.ndarray:
        """Number in ``other`` of every distinct string of this one, by binary search; -1 if it isn't there."""
        if not len(other.first) or not len(self.first):
            return np.full(len(self.first), -1)
        head = other.words[other.first].astype(np.uint64)
        mine = self.words[self.first].astype(np.uint64)
        low, high = np.searchsorted(head, mine, "left"), np.searchsorted(head, mine, "right")
        found = np.full(len(self.first), -1)
        live = np.flatnonzero(low < high)
        while len(live):
            middle = (low[live] + high[live]) >> 1
            sign = self._compare(self.first[live], other, other.first[middle])
            found[live[sign == 0]] = middle[sign == 0]
            high[live[sign < 0]] = middle[sign < 0]
            low[live[sign > 0]] = middle[sign > 0] + 1
            live = live[(sign != 0) & (low[live] < high[live])]
        return found

    def _compare(self, own: np.ndarray, other: Windows, there: np.ndarray) -> np.ndarray:
        """-1, 0 or 1; the first eight bytes are known to be equal."""
        sign, live = np.zeros(len(own), np.int8), np.arange(len(own))
        for offset in self.offsets[1:]:
            a, b = self.words[own[live] + offset], other.words[there[live] + offset]
            sign[live] = (a > b).astype(np.int8) - (a < b).astype(np.int8)
            live = live[a == b]
        return sign

    def by_place(self) -> np.ndarray:
        """Least owner at every place; the largest integer where no window begins."""
        out = np.full(len(self.data), np.iinfo(np.int64).max)
        out[self.places] = self.least[self.group]
        return out


def merge(shards: list[Windows]) -> None:
    """Let all shards agree on the least owner of the strings that they share."""
    known = [s.least.copy() for s in shards]
    for i, one in enumerate(shards):
        for j in range(i + 1, len(shards)):
            place = one.find(shards[j])
            here = np.flatnonzero(place >= 0)
            there = place[here]
            shards[i].least[here] = np.minimum(shards[i].least[here], known[j][there])
            shards[j].least[there] = np.minimum(shards[j].least[there], known[i][here])
