"""SentencePiece-style unigram encoding and decoding: Viterbi over a double-array trie, byte fallback, space marker."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from slotwise.llm import texts

MARKER = "▁"
#: Score of an unknown character below the lowest piece score (fixed value of the format).
UNKNOWN_PENALTY = 10.0
#: Units up to these lengths (bytes) are encoded together; longer ones alone.
WIDTHS = (8, 16, 32, 64, 128)


class DoubleArray:
    """Byte trie: the child of state s by byte c is ``base[s] + c`` if ``check`` there is s. ``value`` is an id or -1."""

    def __init__(self, keys: dict[bytes, int]):
        children: list[dict[int, int]] = [{}]
        value = [-1]
        for key, number in keys.items():
            node = 0
            for c in key:
                if c not in children[node]:
                    children[node][c] = len(children)
                    children.append({})
                    value.append(-1)
                node = children[node][c]
            value[node] = number
        size = 2 * len(children) + 1024
        taken = bytearray(size)
        taken[0] = 1
        base, check, values = np.zeros(size, np.int32), np.full(size, -1, np.int32), np.full(size, -1, np.int32)
        slot, open_from = {0: 0}, 1
        todo = [0]
        for node in todo:
            own = sorted(children[node])
            if not own:
                continue
            while taken[open_from]:
                open_from += 1
            place = max(open_from, own[0] + 1)
            while True:
                place = taken.find(0, place)
                start = place - own[0]
                if place < 0 or start + own[-1] >= len(taken):
                    taken.extend(bytes(len(taken)))
                    place = max(place, 1) if place >= 0 else open_from
                    place = max(place, own[0] + 1)
                    continue
                if all(not taken[start + c] for c in own):
                    break
                place += 1
            if len(taken) > len(base):
                grow = len(taken) - len(base)
                base = np.append(base, np.zeros(grow, np.int32))
                check, values = np.append(check, np.full(grow, -1, np.int32)), np.append(values, np.full(grow, -1, np.int32))
            base[slot[node]] = start
            for c in own:
                child = children[node][c]
                taken[start + c] = 1
                check[start + c] = slot[node]
                values[start + c] = value[child]
                slot[child] = start + c
                todo.append(child)
        end = int(np.flatnonzero(np.frombuffer(taken, np.uint8)).max()) + 1 + 256
        fit = lambda a, fill: np.append(a[:end], np.full(max(0, end - len(a)), fill, np.int32))
        self.base, self.check, self.value = fit(base, 0), fit(check, -1), fit(values, -1)


@dataclass
class Vocabulary:
    """Pieces of a model file. The space marker is a plain space inside, so literal markers fall back to bytes."""

    trie: DoubleArray
    score: np.ndarray
    unknown: float
    byte_ids: np.ndarray
    piece_bytes: np.ndarray
    piece_at: np.ndarray
    longest: int
    cut_at_spaces: bool
    prefix: bool

    @staticmethod
    def load(path: str) -> Vocabulary:
        model = sentencepiece.SentencePieceProcessor(model_file=path)
        count = model.get_piece_size()
        keys, byte_ids, raw = {}, np.full(256, -1, np.int32), []
        for i in range(count):
            piece = model.id_to_piece(i)
            if model.is_byte(i):
                byte_ids[int(piece[3:5], 16)] = i
                raw.append(bytes([int(piece[3:5], 16)]))
            elif model.is_control(i) or model.is_unused(i):
                raw.append(b"")
            elif model.is_unknown(i):
                raw.append(" ⁇ ".encode())
            else:
                raw.append(piece.replace(MARKER, " ").encode())
                keys[raw[-1]] = i
        if (byte_ids < 0).any():
            raise ValueError("the vocabulary needs a piece for each byte")
        score = np.array([model.get_score(i) for i in range(count)], np.float64)
        usable = list(keys.values())
        return Vocabulary(
            DoubleArray(keys), score, float(score[usable].min()) - UNKNOWN_PENALTY, byte_ids,
            np.frombuffer(b"".join(raw), np.uint8), np.concatenate([[0], np.cumsum([len(r) for r in raw])]),
            max(map(len, keys)), not any(b" " in k.lstrip(b" ") for k in keys),
            model.encode("a", out_type=str)[0].startswith(MARKER))


def units(data: np.ndarray, offsets: np.ndarray, cut: bool) -> np.ndarray:
    """First bytes of stretches that no piece crosses: rows, and (if ``cut``) each run of spaces with what follows."""
    first = np.zeros(len(data) + 1, bool)
    first[offsets] = True
    if cut and len(data):
        space = data == 32
        first[1:-1] |= space[1:] & ~space[:-1]
    first[len(data)] = False
    return np.flatnonzero(first)


def encode_slice(data: np.ndarray, offsets: np.ndarray, vocabulary: Vocabulary) -> tuple[np.ndarray, np.ndarray]:
    """Token ids of all rows and their row offsets. Equal units are encoded once.

    Where the model puts a space before a text (``prefix``), a text that is not empty gets one, and decoding takes it away.
    """
    if vocabulary.prefix:
        filled = offsets[:-1][np.diff(offsets) > 0]
        data = np.insert(data, filled, 32)
        offsets = offsets + np.searchsorted(filled, offsets)
    begin = units(data, offsets, vocabulary.cut_at_spaces)
    end = np.append(begin[1:], len(data))
    if not len(begin):
        return np.zeros(0, np.int32), np.zeros(len(offsets), np.int64)
    h = texts.segment_hash(data, begin, end)
    _, sample, which = np.unique(h, return_index=True, return_inverse=True)
    ids, at = encode_units(data, begin[sample], end[sample], vocabulary)
    count = np.diff(at)[which]
    stop = np.cumsum(count)
    take = np.repeat(at[:-1][which] - (stop - count), count) + np.arange(stop[-1])
    row_at = np.concatenate([[0], stop])[np.searchsorted(begin, offsets)]
    return ids[take], row_at


def encode_units(data, begin, end, vocabulary: Vocabulary) -> tuple[np.ndarray, np.ndarray]:
    length = end - begin
    width_of = np.searchsorted(WIDTHS, length)
    lane_parts, id_parts = [], []
    for i, width in enumerate(WIDTHS):
        own = np.flatnonzero(width_of == i)
        for k in range(0, len(own), 16384):
            some = own[k : k + 16384]
            lane, ids = _viterbi(data, begin[some], length[some], width, vocabulary)
            lane_parts.append(some[lane])
            id_parts.append(ids)
    for u in np.flatnonzero(width_of == len(WIDTHS)).tolist():
        ids = _viterbi_alone(data[begin[u] : end[u]].tobytes(), vocabulary)
        lane_parts.append(np.full(len(ids), u))
        id_parts.append(ids)
    lane, ids = np.concatenate(lane_parts), np.concatenate(id_parts)
    order = np.argsort(lane, kind="stable")
    return ids[order].astype(np.int32), np.concatenate([[0], np.cumsum(np.bincount(lane, minlength=len(begin)))])


def _viterbi(data, begin, length, width: int, v: Vocabulary):
    """Best segmentations of many units at once; gives (unit, id) in order."""
    n = len(begin)
    chars = data[np.minimum(begin[:, None] + np.arange(width), len(data) - 1)]
    best = np.full((n, width + 1), -np.inf)
    best[:, 0] = 0
    back = np.broadcast_to(np.arange(-1, width, dtype=np.int32), (n, width + 1)).copy()
    piece = np.full((n, width + 1), -1, np.int32)
    step = np.ones(256, np.int64)
    step[0xC0:0xE0], step[0xE0:0xF0], step[0xF0:] = 2, 3, 4
    base, check, value = v.trie.base, v.trie.check, v.trie.value
    for i in range(int(length.max())):
        lane = np.flatnonzero((length > i) & np.isfinite(best[:, i]))
        if not len(lane):
            continue
        start, size = best[lane, i], step[chars[lane, i]]
        alone = np.ones(len(lane), bool)
        live, state = np.arange(len(lane)), np.zeros(len(lane), np.int64)
        for j in range(i, min(width, i + v.longest)):
            inside = length[lane[live]] > j
            live, state = live[inside], state[inside]
            target = base[state] + chars[lane[live], j]
            ok = check[target] == state
            live, state = live[ok], target[ok].astype(np.int64)
            if not len(live):
                break
            found = value[state]
            hit = np.flatnonzero(found >= 0)
            if len(hit):
                who, ids = live[hit], found[hit]
                alone[who[size[who] == j + 1 - i]] = False
                score = start[who] + v.score[ids]
                better = score > best[lane[who], j + 1]
                to = lane[who[better]]
                best[to, j + 1], back[to, j + 1], piece[to, j + 1] = score[better], i, ids[better]
        if alone.any():
            to, target = lane[alone], i + size[alone]
            score = start[alone] + v.unknown
            better = score > best[to, target]
            to, target = to[better], target[better]
            best[to, target], back[to, target], piece[to, target] = score[better], target - 1, -1
    at, lane = length.copy(), np.arange(n)
    lanes, ids = [], []
    while len(lane):
        here = at[lane]
        found = piece[lane, here]
        lanes.append(lane)
        ids.append(np.where(found >= 0, found, v.byte_ids[chars[lane, here - 1]]))
        at[lane] = back[lane, here]
        lane = lane[at[lane] > 0]
    lanes, ids = np.concatenate(lanes[::-1]), np.concatenate(ids[::-1])
    order = np.argsort(lanes, kind="stable")
    return lanes[order], ids[order]


def _viterbi_alone(raw: bytes, v: Vocabulary) -> np.ndarray:
    """The same for one unit of any length."""
    n = len(raw)
    base, check, value = (a.tolist() for a in (v.trie.base, v.trie.check, v.trie.value))
    score = v.score.tolist()
    best, back, piece = [float("-inf")] * (n + 1), list(range(-1, n)), [-1] * (n + 1)
    best[0] = 0.0
    for i in range(n):
        start = best[i]
        if start == float("-inf"):
            continue
        c = raw[i]
        size = 1 if c < 0xC0 else 2 if c < 0xE0 else 3 if c < 0xF0 else 4
        alone, state = True, 0
        for j in range(i, min(n, i + v.longest)):
            target = base[state] + raw[j]
            if check[target] != state:
                break
            state = target
            found = value[state]
            if found >= 0:
                alone = alone and j + 1 - i != size
                if start + score[found] > best[j + 1]:
                    best[j + 1], back[j + 1], piece[j + 1] = start + score[found], i, found
        if alone and start + v.unknown > best[i + size]:
            best[i + size], back[i + size], piece[i + size] = start + v.unknown, i + size - 1, -1
    out, at = [], n
    while at > 0:
        out.append(piece[at] if piece[at] >= 0 else int(v.byte_ids[raw[at - 1]]))
        at = back[at]
    return np.array(out[::-1], np.int32)


def decode_slice(ids: np.ndarray, at: np.ndarray, v: Vocabulary) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all rows and their offsets. The space marker becomes a space, byte pieces their byte."""
    size = np.diff(v.piece_at)[ids]
    stop = np.concatenate([[0], np.cumsum(size)])
    take = np.repeat(v.piece_at[:-1][ids] - stop[:-1], size) + np.arange(stop[-1])
    data, offsets = v.piece_bytes[take], stop[at]
    if v.prefix:
        filled = offsets[:-1][np.diff(offsets) > 0]
        filled = filled[data[filled] == 32]
        data, offsets = np.delete(data, filled), offsets - np.searchsorted(filled, offsets)
    return data, offsets


def encode(docs: DataFrame, path: str) -> DataFrame:
    """``docs`` with ids (array of int), n_tokens, n_bytes (byte-fallback tokens) and round_trip.

    ``path`` is a SentencePiece model file on the driver; its pieces (tens of thousands) are broadcast. round_trip tells that
    the ids decode to the whole text. Null texts: null ids, zero counts, round_trip true. Empty text: no ids. Columns
    of ``docs`` with the result's names are replaced.
    """
    names = ["ids", "n_tokens", "n_bytes", "round_trip"]
    shared = docs.sparkSession.sparkContext.broadcast(Vocabulary.load(path))
    base = texts.no_clash(docs, *names)

    def work(batch, data, offsets):
        v = shared.value
        ids, at = encode_slice(data, offsets, v)
        back, back_at = decode_slice(ids, at, v)
        good = np.ones(len(offsets) - 1, bool)
        if not (np.array_equal(back_at, offsets) and np.array_equal(back, data)):
            good = np.array([np.array_equal(back[back_at[r] : back_at[r + 1]], data[offsets[r] : offsets[r + 1]])
                             for r in range(len(good))], bool)
        is_byte = np.zeros(len(v.score) + 1, bool)
        is_byte[v.byte_ids] = True
        fallback = np.concatenate([[0], np.cumsum(is_byte[ids])])[at]
        null = np.asarray(batch.column(batch.schema.get_field_index("text")).is_null())
        lists = pa.ListArray.from_arrays(pa.array(at.astype(np.int32), mask=np.append(null, False)), pa.array(ids))
        return pa.RecordBatch.from_arrays(
            [*batch.columns, lists, pa.array(np.diff(at).astype(np.int64)), pa.array(np.diff(fallback).astype(np.int64)), pa.array(good)],
            [*batch.schema.names, *names])

    schema = texts.schema_with(
        base, T.StructField("ids", T.ArrayType(T.IntegerType(), False)), T.StructField("n_tokens", T.LongType()),
        T.StructField("n_bytes", T.LongType()), T.StructField("round_trip", T.BooleanType()))
    return base.mapInArrow(texts.by_slice(work, size=2 * texts.SLICE_BYTES), schema)


def decode(rows: DataFrame, path: str) -> DataFrame:
    """``rows`` with ``decoded``, the text of ``ids``; null ids give null, bytes that are no UTF-8 a replacement character."""
    shared = rows.sparkSession.sparkContext.broadcast(Vocabulary.load(path))
    base = texts.no_clash(rows, "decoded")

    def run(batches):
        for batch in batches:
            lists = batch.column(batch.schema.get_field_index("ids"))
            out = []
            for one in lists:
                if not one.is_valid:
                    out.append(None)
                    continue
                ids = one.values.to_numpy()
                raw, _ = decode_slice(ids, np.array([0, len(ids)]), shared.value)
                out.append(raw.tobytes().decode("utf-8", "replace"))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, pa.string())], [*batch.schema.names, "decoded"])

    return base.mapInArrow(run, texts.schema_with(base, T.StructField("decoded", T.StringType())))
