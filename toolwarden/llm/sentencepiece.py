"""SentencePiece encoding and decoding, batched in numpy.

A text is cut where white space begins: no piece of a model read here has white space after
another character, so such units are encoded independently, and each distinct unit once per
worker.  Units of equal length advance together; their substrings are probed by hash in the
model's sorted piece keys.

A unigram model is decoded by Viterbi: for each end, the best of all pieces that end there, with
vectorised maxima that store backpointers.  A BPE model defines its encoding by merges, not by a
sum of scores, and a Viterbi path over its scores is another segmentation (README has figures);
for it the same probes give the scores of adjacent pairs, and in each round every unit of a
batch merges its best pair, the leftmost of equals.  Units of more than LONG characters do so
one at a time with a heap.
"""

from __future__ import annotations

import heapq
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import arrays
from .storage import unused

UNIGRAM, BPE = 1, 2
NORMAL, UNKNOWN, CONTROL, USER, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
SPACE = "▁"
LONG = 256
#: Distinct units whose pieces a worker keeps; beyond, it starts anew.
CACHE_ENTRIES = 1 << 16
#: An unknown character's score in a unigram model lies this far below the least piece.
UNKNOWN_PENALTY = 10.0

_MULT = 0xD1342543DE82EF95


def _varint(data: bytes, at: int) -> tuple[int, int]:
    value = shift = 0
    while True:
        byte = data[at]
        at += 1
        value |= (byte & 0x7F) << shift
        shift += 7
        if byte < 0x80:
            return value, at


def _fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """Field numbers and values of a protocol-buffer message."""
    at = 0
    while at < len(data):
        tag, at = _varint(data, at)
        kind = tag & 7
        if kind == 0:
            value, at = _varint(data, at)
        else:
            size, at = _varint(data, at) if kind == 2 else ({1: 8, 5: 4}[kind], at)
            value, at = data[at:at + size], at + size
        yield tag >> 3, value


def _keys(codes: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hashes of substrings: ``codes`` are (units, length) characters; start and end broadcast with units."""
    total = np.zeros((codes.shape[0], codes.shape[1] + 1), np.uint64)
    np.cumsum(arrays.mix(codes.astype(np.uint64) + np.uint64(0x1F123BB5)) * _up(codes.shape[1]), axis=1, out=total[:, 1:])
    return _span(total, np.arange(len(codes)), start, end)


def _up(n: int) -> np.ndarray:
    return np.cumprod(np.full(n + 1, _MULT, np.uint64))[:n] if n else np.zeros(0, np.uint64)


def _down(n: int) -> np.ndarray:
    steps = np.full(n + 1, pow(_MULT, -1, 1 << 64), np.uint64)
    return np.cumprod(steps)


def _span(total: np.ndarray, unit: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    back = _down(total.shape[1])[start]
    return arrays.mix((total[unit, end] - total[unit, start]) * back + (end - start).astype(np.uint64))


class Model:
    """A SentencePiece model file: pieces, scores, kinds, and what normalisation it asks for."""

    def __init__(self, data: bytes):
        pieces, scores, kinds, spec = [], [], [], {}
        self.kind = UNIGRAM
        for field, value in _fields(data):
            if field == 1:
                own = dict(_fields(value))
                pieces.append(own[1].decode())
                scores.append(struct.unpack("<f", own[2])[0] if 2 in own else 0.0)
                kinds.append(own.get(3, NORMAL))
            elif field == 2:
                self.kind = dict(_fields(value)).get(3, UNIGRAM)
            elif field == 3:
                spec = dict(_fields(value))
        self._set_up(pieces, scores, kinds, spec.get(3, 1) == 1)
        if self.kind not in (UNIGRAM, BPE) or spec.get(2) or spec.get(4, 1):
            raise ValueError("only unigram and BPE models without a character map and white-space folding are read")

    @classmethod
    def of(cls, pieces: list[str], scores: list[float], kinds: list[int], kind: int = UNIGRAM, prefix: bool = True) -> "Model":
        """A model from its parts."""
        self = cls.__new__(cls)
        self.kind = kind
        self._set_up(pieces, scores, kinds, prefix)
        return self

    def _set_up(self, pieces: list[str], scores: list[float], kinds: list[int], prefix: bool) -> None:
        self.pieces, self.kinds, self.prefix = pieces, np.array(kinds), prefix
        self.unknown = next((k for k, x in enumerate(kinds) if x == UNKNOWN), 0)
        self.bytes = np.full(256, self.unknown, np.int32)
        for k, x in enumerate(kinds):
            if x == BYTE:
                self.bytes[int(pieces[k][1:-1], 16)] = k
        self.byte_fallback = BYTE in kinds
        usable = [k for k, x in enumerate(kinds) if x in (NORMAL, USER)]
        if any(SPACE in pieces[k].lstrip(SPACE) for k in usable):
            raise ValueError("a piece has white space after another character")
        self.longest = max((len(pieces[k]) for k in usable), default=1)
        keys = np.zeros(len(usable), np.uint64)
        for size in {len(pieces[k]) for k in usable}:
            own = [n for n, k in enumerate(usable) if len(pieces[k]) == size]
            codes = np.array([[ord(c) for c in pieces[usable[n]]] for n in own], np.uint32)
            keys[own] = _keys(codes, np.zeros(1, np.int64), np.full(1, size))
        order = np.argsort(keys)
        self.keys, self.ids = keys[order], np.array(usable, np.int32)[order]
        self.scores = np.array(scores, np.float64)[self.ids]
        self.least = float(self.scores.min(initial=0.0))
        written = []
        for k, x in enumerate(kinds):
            written.append(bytes([int(pieces[k][1:-1], 16)]) if x == BYTE else b"" if x == CONTROL
                           else " ⁇ ".encode() if x == UNKNOWN else pieces[k].replace(SPACE, " ").encode())
        self.written = np.frombuffer(b"".join(written), np.uint8)
        self.bounds = np.concatenate([[0], np.cumsum([len(w) for w in written])])

    def probe(self, key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Piece ids of substring hashes (-1: none) and their scores."""
        at = np.searchsorted(self.keys, key)
        at[at == len(self.keys)] = 0
        found = self.keys[at] == key
        return np.where(found, self.ids[at], -1), np.where(found, self.scores[at], -np.inf)

    def _viterbi(self, codes: np.ndarray, total: np.ndarray) -> np.ndarray:
        """Piece starts by end, for units of one length: a (units, length + 1) table of backpointers."""
        units, length = codes.shape
        rows = np.arange(units)
        best = np.full((units, length + 1), -np.inf)
        back = np.zeros((units, length + 1), np.int64)
        best[:, 0] = 0
        for end in range(1, length + 1):
            starts = np.arange(max(0, end - self.longest), end)
            key = _span(total, rows[:, None], starts[None, :], np.full((1, len(starts)), end))
            _, score = self.probe(key.ravel())
            score = score.reshape(key.shape)
            # A character that no piece covers stands for itself.
            score[:, -1] = np.where(np.isfinite(score[:, -1]), score[:, -1], self.least - UNKNOWN_PENALTY)
            value = best[:, starts] + score
            choice = np.argmax(value, axis=1)
            best[:, end], back[:, end] = value[rows, choice], starts[choice]
        return back

    def _path(self, back: np.ndarray) -> np.ndarray:
        """Boundaries of the best paths: a (units, length + 1) table of booleans."""
        units, width = back.shape
        edge = np.zeros((units, width), bool)
        at, rows = np.full(units, width - 1), np.arange(units)
        edge[rows, at] = True
        while (live := at > 0).any():
            at = np.where(live, back[rows, at], 0)
            edge[rows, at] = True
        return edge

    def _merged(self, total: np.ndarray) -> np.ndarray:
        """Boundaries that are left when no adjacent pair is a piece any more, units of one length together."""
        units, width = total.shape
        rows = np.arange(units)
        before = np.tile(np.arange(width) - 1, (units, 1))
        after = np.tile(np.arange(width) + 1, (units, 1))
        edge = np.ones((units, width), bool)
        score = np.full((units, width), -np.inf)
        if width > 2:
            inner = np.arange(1, width - 1)
            key = _span(total, rows[:, None], (inner - 1)[None, :], (inner + 1)[None, :])
            score[:, 1:-1] = self.probe(key.ravel())[1].reshape(key.shape)
        live = rows
        while live.size:
            cut = np.argmax(score[live], axis=1)
            some = np.isfinite(score[live, cut])
            live, cut = live[some], cut[some]
            left, right = before[live, cut], after[live, cut]
            edge[live, cut], score[live, cut] = False, -np.inf
            after[live, left], before[live, right] = right, left
            for at, start, end, fine in ((left, before[live, left], right, left > 0), (right, left, after[live, right], right < width - 1)):
                own = np.flatnonzero(fine)
                if own.size:
                    key = _span(total, live[own], start[own], end[own])
                    score[live[own], at[own]] = self.probe(key)[1]
        return edge

    def _merged_long(self, total: np.ndarray) -> np.ndarray:
        """The same for one long unit, its pairs on a heap."""
        width = total.shape[1]
        before, after = list(range(-1, width - 1)), list(range(1, width + 1))
        edge = np.ones(width, bool)
        state: dict[int, tuple[int, int]] = {}
        heap: list[tuple[float, int, int, int]] = []

        def push(cuts: list[int]) -> None:
            cuts = [c for c in cuts if 0 < c < width - 1]
            if cuts:
                start, end = np.array([before[c] for c in cuts]), np.array([after[c] for c in cuts])
                for c, s, a, b in zip(cuts, self.probe(_span(total, np.zeros(len(cuts), np.int64), start, end))[1], start, end):
                    state[c] = (int(a), int(b))
                    if np.isfinite(s):
                        heapq.heappush(heap, (-float(s), c, int(a), int(b)))

        push(list(range(1, width - 1)))
        while heap:
            _, cut, start, end = heapq.heappop(heap)
            if not edge[cut] or state.get(cut) != (start, end):
                continue
            edge[cut] = False
            after[start], before[end] = end, start
            push([start, end])
        return edge

    def segments(self, codes: np.ndarray) -> np.ndarray:
        """Boundaries of the pieces of units of one length, a (units, length + 1) table of booleans."""
        total = np.zeros((codes.shape[0], codes.shape[1] + 1), np.uint64)
        np.cumsum(arrays.mix(codes.astype(np.uint64) + np.uint64(0x1F123BB5)) * _up(codes.shape[1]), axis=1, out=total[:, 1:])
        if self.kind == UNIGRAM:
            return self._path(self._viterbi(codes, total))
        if codes.shape[1] > LONG:
            return np.stack([self._merged_long(total[k:k + 1]) for k in range(len(codes))])
        return self._merged(total)

    def encode_units(self, units: list[str]) -> list[np.ndarray]:
        """Piece ids of each unit (white space written as SPACE)."""
        out: list[np.ndarray] = [np.zeros(0, np.int32)] * len(units)
        sizes = np.array([len(u) for u in units])
        for size in np.unique(sizes[sizes > 0]).tolist():
            own = np.flatnonzero(sizes == size)
            # Long units one by one: their tables are as wide as they are.
            for part in np.array_split(own, -(-len(own) * size // (1 << 20))):
                codes = np.frombuffer("".join(units[k] for k in part).encode("utf-32-le"), np.uint32).reshape(len(part), size)
                edge = self.segments(codes)
                unit, place = np.nonzero(edge)
                inner = np.flatnonzero(unit[1:] == unit[:-1])
                start, end, unit = place[inner], place[inner + 1], unit[inner]
                total = np.zeros((codes.shape[0], size + 1), np.uint64)
                np.cumsum(arrays.mix(codes.astype(np.uint64) + np.uint64(0x1F123BB5)) * _up(size), axis=1, out=total[:, 1:])
                ids, _ = self.probe(_span(total, unit, start, end))
                cut = np.searchsorted(unit, np.arange(len(part) + 1))
                missing = set(unit[ids < 0].tolist())
                for n, k in enumerate(part):
                    found = ids[cut[n]:cut[n + 1]]
                    if n in missing:
                        found = self._spelled(units[k], start[cut[n]:cut[n + 1]], end[cut[n]:cut[n + 1]], found)
                    out[k] = found.astype(np.int32)
        return out

    def _spelled(self, unit: str, start: np.ndarray, end: np.ndarray, ids: np.ndarray) -> np.ndarray:
        """Ids with characters that are no piece written as their bytes, or as unknown (a run of them once)."""
        out: list[int] = []
        last = False
        for a, b, k in zip(start, end, ids):
            if k >= 0:
                out.append(int(k))
            elif self.byte_fallback:
                out += self.bytes[list(unit[a:b].encode())].tolist()
            elif not last:
                out.append(self.unknown)
            last = k < 0
        return np.array(out, np.int32)


_models: dict[str, tuple[Model, dict]] = {}


def _model(data_or_path: str) -> tuple[Model, dict]:
    """The model of a path and this worker's cache of encoded units."""
    if data_or_path not in _models:
        with open(data_or_path, "rb") as file:
            _models[data_or_path] = Model(file.read()), {"slot": {}, "pieces": [np.zeros(0, np.int32)]}
    return _models[data_or_path]


def _units(column: pa.Array, prefix: bool) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """By piece of a column: row range, bytes, and the units' rows, starts and ends; white space is a plain space."""
    offsets, _ = arrays.utf8(column)
    for low, high in arrays.pieces(offsets):
        part = column.slice(low, high - low)
        own, data = arrays.utf8(part)
        if (data[:-2] == 0xE2).any() and ((data[:-2] == 0xE2) & (data[1:-1] == 0x96) & (data[2:] == 0x81)).any():
            own, data = arrays.utf8(pc.replace_substring(part, SPACE, " "))
        if prefix:
            some = np.flatnonzero(np.diff(own))
            data = np.insert(data, own[some], 0x20)
            own = own + np.concatenate([[0], np.cumsum(np.diff(own) > 0)])
        if not len(data):
            continue
        space = data == 0x20
        edge = np.zeros(len(data) + 1, bool)
        edge[own] = True
        first = edge[:-1].copy()
        first[1:] |= space[1:] & ~space[:-1]
        start = np.flatnonzero(first)
        row = np.searchsorted(own, start, side="right") - 1
        yield low, high, data, row, start, np.append(start[1:], len(data))


def _encoded(column: pa.Array, path: str) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """By piece of a column: row range, bounds of its rows' ids, and the ids."""
    model, cache = _model(path)
    done = 0
    for low, high, data, row, start, end in _units(column, model.prefix):
        if low > done:
            yield done, low, np.zeros(low - done + 1, np.int64), np.zeros(0, np.int32)
        done = high
        value = arrays.hashes(data, start, end)
        unique, first, back = np.unique(value, return_index=True, return_inverse=True)
        keys = unique.tolist()
        if len(cache["slot"]) + len(keys) > CACHE_ENTRIES:
            cache["slot"], cache["pieces"] = {}, [np.zeros(0, np.int32)]
        slot, pieces = cache["slot"], cache["pieces"]
        fresh = [k for k, h in enumerate(keys) if h not in slot]
        found = model.encode_units([data[start[first[k]]:end[first[k]]].tobytes().decode().replace(" ", SPACE) for k in fresh])
        for k, ids in zip(fresh, found):
            slot[keys[k]] = len(pieces)
            pieces.append(ids)
        own = [pieces[slot[h]] for h in keys]
        size = np.array([len(x) for x in own])
        flat, begin = np.concatenate(own), np.cumsum(size) - size
        count = size[back]
        at = np.repeat(begin[back] - (np.cumsum(count) - count), count) + np.arange(int(count.sum()))
        ends = np.concatenate([[0], np.cumsum(count)])
        bounds = ends[np.searchsorted(row, np.arange(high - low + 1))]
        yield low, high, bounds, flat[at].astype(np.int32)
    if done < len(column):
        yield done, len(column), np.zeros(len(column) - done + 1, np.int64), np.zeros(0, np.int32)


def _column_type(df: DataFrame, name: str) -> str:
    return df.schema[name].dataType.simpleString()


def encode(docs: DataFrame, model: str, column: str = "text", into: str = "pieces", again: str | None = None) -> DataFrame:
    """All columns and ``into``, the piece ids of ``column`` as the model file at ``model`` defines them.

    With ``again``, a column of that name has the text that the ids decode to, made in the same
    pass.  No begin or end is added.  A null or empty text has no pieces (an empty list); a
    column that is named ``into`` already is replaced.  Rows are neither joined nor merged.
    """
    rest = [c for c in docs.columns if c not in (into, again)]
    source = docs.select(*[F.col(f"`{c}`") for c in rest], F.col(f"`{column}`").cast("string").alias(unused(docs, "_text")))
    names = [*rest, into, *([again] if again else [])]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for low, high, bounds, ids in _encoded(batch.column(len(rest)), model):
                part = batch.slice(low, high - low)
                lists = pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(ids))
                yield pa.record_batch([*part.columns[:-1], lists, *([_decoded(lists, model)] if again else [])], names=names)

    schema = source.select(*[F.col(f"`{c}`") for c in rest], F.array(F.lit(0)).alias(into),
                           *([F.lit("").alias(again)] if again else [])).schema
    for field in schema.fields:
        field.nullable = True
    return source.mapInArrow(run, schema)


def _decoded(lists: pa.Array, path: str) -> pa.Array:
    model, _ = _model(path)
    offsets = lists.offsets.to_numpy(zero_copy_only=False).astype(np.int64)
    ids = lists.values.to_numpy(zero_copy_only=False)[offsets[0]:offsets[-1]]
    offsets = offsets - offsets[0]
    size = model.bounds[ids + 1] - model.bounds[ids]
    ends = np.concatenate([[0], np.cumsum(size)])
    at = np.repeat(model.bounds[ids] - ends[:-1], size) + np.arange(int(ends[-1]))
    data, bounds = model.written[at], ends[offsets]
    texts = [data[a:b].tobytes().decode("utf-8", "replace") for a, b in zip(bounds[:-1], bounds[1:])]
    if model.prefix:
        texts = [t[1:] if t.startswith(" ") else t for t in texts]
    return pa.array(texts, pa.string())


def decode(docs: DataFrame, model: str, column: str = "pieces", into: str = "text") -> DataFrame:
    """All columns and ``into``, the texts that the ids in ``column`` stand for; null ids give an empty text."""
    rest = [c for c in docs.columns if c != into]
    ids = F.coalesce(F.col(f"`{column}`").cast("array<int>"), F.array().cast("array<int>"))
    source = docs.select(*[F.col(f"`{c}`") for c in rest], ids.alias(unused(docs, "_ids")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.record_batch([*batch.columns[:-1], _decoded(batch.column(len(rest)), model)], names=[*rest, into])

    schema = source.select(*[F.col(f"`{c}`") for c in rest], F.lit("").alias(into)).schema
    for field in schema.fields:
        field.nullable = True
    return source.mapInArrow(run, schema)
