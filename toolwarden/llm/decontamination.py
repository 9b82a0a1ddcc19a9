"""Benchmark decontamination: SimHash windows of item size, Hamming index, exact verification.

Items are the query set and are worked in blocks of bounded size.  A block's index is broadcast:
the items' fingerprints (SimHash of a window's words, two 64-bit halves) in a multi-index by
Hamming blocks, and their five-word shingles as a sorted list.  Each task slides windows of every
item length over its own texts.  A window can only verify if it holds enough shingles of the
block at all, so windows are fingerprinted where the running count of such shingles allows it.
Fingerprints within RADIUS of an item's are found without exception: of BLOCKS blocks of a
fingerprint at least one then differs in at most RADIUS // BLOCKS bits, and every item is listed
under all values that near.  Candidates are verified by the weighted Jaccard similarity of their
shingles, a shingle's weight being how often it occurs.  Nothing is shuffled, and texts never
leave their task.  A text of fewer words than an item is one window as a whole.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import arrays

#: Items whose index is broadcast at once.
ITEM_ROWS = 1 << 12
#: Bits of a fingerprint, blocks of its index, and the radius within which all fingerprints are found.
BITS = 128
BLOCKS = 8
RADIUS = 31
SIMILARITY = 0.8


def _votes(value: np.ndarray) -> np.ndarray:
    """+1 and -1 by bit of each word's hash and of a second hash: (words, BITS)."""
    two = np.stack([value, arrays.mix(value ^ np.uint64(0x5851F42D4C957F2D))], axis=1)
    return np.unpackbits(two.view(np.uint8), axis=1, bitorder="little").astype(np.int32) * 2 - 1


def _fingerprint(sums: np.ndarray) -> np.ndarray:
    """(n, BITS) sums to (n, BITS // 8) bytes."""
    return np.packbits(sums > 0, axis=1, bitorder="little")


def _own_shingles(value: np.ndarray) -> np.ndarray:
    """The shingles of one run of words in order; a run shorter than a shingle is one."""
    if len(value) >= arrays.SHINGLE:
        return arrays.grams(value, np.zeros(len(value), np.int64), arrays.SHINGLE)[1]
    return arrays.grams(value, np.zeros(len(value), np.int64), len(value))[1] if len(value) else value


def similarity(a: np.ndarray, b: np.ndarray) -> float:
    """Weighted Jaccard similarity: sum of the lesser over sum of the greater counts."""
    x, y = Counter(a.tolist()), Counter(b.tolist())
    shared = (x & y).total()
    return shared / max(1, x.total() + y.total() - shared)


def item_index(items: list[tuple[int, str | None]], radius: int = RADIUS) -> dict:
    """The broadcast index of a block of items; an item without words is in no index."""
    column = pa.array([t for _, t in items], pa.string())
    offsets, data = arrays.utf8(column)
    found = arrays.words(offsets, data)
    bounds = np.searchsorted(found.row, np.arange(len(items) + 1))
    ids, lengths, prints, own = [], [], [], []
    for k, (item, _) in enumerate(items):
        value = found.hash[bounds[k]:bounds[k + 1]]
        if len(value):
            ids.append(item)
            lengths.append(len(value))
            prints.append(_fingerprint(_votes(value).sum(axis=0, keepdims=True))[0])
            own.append(_own_shingles(value))
    width = BITS // BLOCKS
    reach = radius // BLOCKS
    flips = np.array([sum(1 << b for b in c) for n in range(reach + 1) for c in combinations(range(width), n)], np.uint32)
    prints = np.array(prints, np.uint8).reshape(len(ids), BITS // 8)
    blocks = prints.view("<u2").astype(np.uint32) if len(ids) else np.zeros((0, BLOCKS), np.uint32)
    tables = []
    for b in range(BLOCKS):
        near = (blocks[:, b][:, None] ^ flips).ravel()
        order = np.argsort(near, kind="stable")
        tables.append((near[order], np.repeat(np.arange(len(ids)), len(flips))[order]))
    return {"ids": ids, "lengths": np.array(lengths, np.int64), "prints": prints, "shingles": own, "tables": tables,
            "known": {n: np.unique(np.concatenate([s for s, m in zip(own, lengths) if min(m, arrays.SHINGLE) == n]))
                      for n in {min(m, arrays.SHINGLE) for m in lengths}}, "radius": radius}


def _near(prints: np.ndarray, index: dict) -> tuple[np.ndarray, np.ndarray]:
    """All pairs (window, item) within the radius, through the blocks' tables."""
    blocks = prints.view("<u2").astype(np.uint32)
    pairs = []
    for b, (key, item) in enumerate(index["tables"]):
        low, high = np.searchsorted(key, blocks[:, b]), np.searchsorted(key, blocks[:, b], side="right")
        n = high - low
        window = np.repeat(np.arange(len(n)), n)
        at = np.arange(len(window)) - np.repeat(np.cumsum(n) - n, n) + np.repeat(low, n)
        pairs.append(window * len(index["ids"]) + item[at])
    pairs = np.unique(np.concatenate(pairs))
    window, item = pairs // len(index["ids"]), pairs % len(index["ids"])
    apart = np.bitwise_count(prints[window] ^ index["prints"][item]).sum(axis=1)
    close = apart <= index["radius"]
    return window[close], item[close]


def _enough(hit: np.ndarray, length: int, size: int, similarity_: float) -> np.ndarray:
    """Starts of windows of ``length`` words with the share of known shingles that a verified one needs."""
    wide = length - size + 1
    total = np.concatenate([[0], np.cumsum(hit)])
    if len(total) <= wide:
        return np.zeros(0, np.int64)
    return np.flatnonzero(total[wide:] - total[:-wide] >= np.ceil(similarity_ * wide - 1e-9))


def _matches(value: np.ndarray, index: dict, similarity_: float) -> list[tuple[int, int, int, float]]:
    """(item, start, words, similarity) of the best verified window of each item in one text's words."""
    best: dict[int, tuple[float, int, int]] = {}
    hits = {}
    for size, known in index["known"].items():
        _, own = arrays.grams(value, np.zeros(len(value), np.int64), size)
        at = np.searchsorted(known, own)
        at[at == len(known)] = 0
        hits[size] = (known[at] == own, own)
    if not any(hit.any() for hit, _ in hits.values()):
        return []
    votes = None
    for length in np.unique(index["lengths"]).tolist():
        size = min(length, arrays.SHINGLE)
        hit, own = hits[size]
        # A shorter text is compared as a whole.
        wide = min(length, len(value))
        if wide == length:
            start = _enough(hit, length, size, similarity_)
        else:
            start = np.zeros(int(hit.sum() >= np.ceil(similarity_ * (length - size + 1) - 1e-9)), np.int64)
        if not start.size:
            continue
        if votes is None:
            votes = np.concatenate([np.zeros((1, BITS), np.int32), np.cumsum(_votes(value), axis=0, dtype=np.int32)])
        window, item = _near(_fingerprint(votes[start + wide] - votes[start]), index)
        for w, i in zip(window.tolist(), item.tolist()):
            if index["lengths"][i] == length:
                first = int(start[w])
                s = similarity(own[first:first + wide - size + 1], index["shingles"][i])
                if s >= similarity_ and s > best.get(i, (0, 0, 0))[0]:
                    best[i] = (s, first, wide)
    return [(index["ids"][i], first, words, s) for i, (s, first, words) in best.items()]


def _candidates(found: arrays.Words, rows: int, index: dict, similarity_: float) -> np.ndarray:
    """Rows with at least as many known shingles as the shortest item needs, for a whole piece at once."""
    some = np.zeros(rows, bool)
    lengths = index["lengths"]
    for size, known in index["known"].items():
        at, own = arrays.grams(found.hash, found.row, size)
        if not len(at):
            continue
        low = np.searchsorted(known, own)
        low[low == len(known)] = 0
        count = np.bincount(found.row[at[known[low] == own]], minlength=rows)
        shortest = lengths[np.minimum(lengths, arrays.SHINGLE) == size].min() - size + 1
        some |= count >= max(1, np.ceil(similarity_ * shortest - 1e-9))
    return np.flatnonzero(some)


def _row_matches(texts: pa.Array, index: dict, similarity_: float) -> Iterator[tuple[int, list[tuple[int, int, int, float]]]]:
    """The rows of a column that match an item, with their matches."""
    offsets, data = arrays.utf8(texts)
    for low, high in arrays.pieces(offsets):
        found = arrays.words(offsets[low:high + 1] - offsets[low], data[offsets[low]:offsets[high]])
        bounds = np.searchsorted(found.row, np.arange(high - low + 1))
        for k in _candidates(found, high - low, index, similarity_).tolist():
            if own := _matches(found.hash[bounds[k]:bounds[k + 1]], index, similarity_):
                yield low + k, own


MATCHES = "doc_id bigint, item_id bigint, start bigint, words bigint, similarity double"


def matches(docs: DataFrame, items: list[tuple[int, str | None]], radius: int = RADIUS,
            similarity_: float = SIMILARITY) -> DataFrame:
    """Verified (doc_id, item_id, start word, words, similarity) of one block of items, the best window of each."""
    sent = docs.sparkSession.sparkContext.broadcast(item_index(items, radius))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = sent.value
        for batch in batches:
            ids = batch.column(0)
            out = [(ids[row].as_py(), i, first, words, s)
                   for row, found in _row_matches(batch.column(1), index, similarity_) for i, first, words, s in found]
            columns = list(zip(*out)) or [()] * 5
            yield pa.record_batch([pa.array(c, t) for c, t in zip(columns, [pa.int64()] * 4 + [pa.float64()])],
                                  names=["doc_id", "item_id", "start", "words", "similarity"])

    return docs.select(F.col("doc_id").cast("bigint"), F.col("text").cast("string")).mapInArrow(scan, MATCHES)


def leaks(docs: DataFrame, benchmark: DataFrame, radius: int = RADIUS, similarity_: float = SIMILARITY,
          item_rows: int = ITEM_ROWS) -> DataFrame:
    """All verified matches of documents and benchmark items: doc_id, item_id, start, words, similarity.

    An item matches where a window of as many words has five-word shingles of weighted Jaccard
    similarity ``similarity_`` or more (an item of fewer words: where its words stand in order).
    A text of fewer words than the item matches if the whole of it is as similar.
    Items and documents that are null, empty or without words match nothing; repeated documents
    and repeated items match each for themselves, null ids included.
    """
    out = None
    for block in _item_blocks(benchmark, item_rows):
        part = matches(docs, block, radius, similarity_)
        out = part if out is None else out.unionByName(part)
    return out


def _item_blocks(benchmark: DataFrame, item_rows: int) -> Iterator[list[tuple[int, str | None]]]:
    """The items in lists of at most ``item_rows``; one empty list if there is none."""
    block, some = [], False
    for row in benchmark.select(F.col("item_id").cast("bigint"), F.col("text").cast("string")).toLocalIterator():
        block.append((row[0], row[1]))
        if len(block) == item_rows:
            yield block
            block, some = [], True
    if block or not some:
        yield block


def contamination(docs: DataFrame, benchmark: DataFrame, radius: int = RADIUS, similarity_: float = SIMILARITY,
                  item_rows: int = ITEM_ROWS) -> DataFrame:
    """One row per document: doc_id, contaminated, n_items, item_id and similarity of the best match.

    The best match has the highest similarity, of several the smallest item id; without one it
    is null.  A repeated document id has one row per document, all with the same verdict.
    """
    best = (leaks(docs, benchmark, radius, similarity_, item_rows).groupBy("doc_id")
            .agg(F.countDistinct("item_id").alias("n_items"),
                 F.max(F.struct("similarity", (-F.col("item_id")).alias("less"))).alias("best")))
    best = best.select(F.col("doc_id").alias("_doc"), "n_items", "best")
    return (docs.select(F.col("doc_id").cast("bigint").alias("doc_id"))
            .join(best, F.col("doc_id").eqNullSafe(F.col("_doc")), "left")
            .select("doc_id", F.col("best").isNotNull().alias("contaminated"),
                    F.coalesce("n_items", F.lit(0)).alias("n_items"), (-F.col("best.less")).alias("item_id"),
                    F.col("best.similarity").alias("similarity")))


def _leaked(sent, similarity_: float):
    """The test of texts against one broadcast block of items, as an Arrow function."""
    @F.arrow_udf("boolean")
    def leaked(text: pa.Array) -> pa.Array:
        out = np.zeros(len(text), bool)
        for row, _ in _row_matches(text, sent.value, similarity_):
            out[row] = True
        return pa.array(out)

    return leaked


def decontaminated(docs: DataFrame, benchmark: DataFrame, radius: int = RADIUS,
                   similarity_: float = SIMILARITY, item_rows: int = ITEM_ROWS) -> DataFrame:
    """The documents, in all their columns and without a shuffle, whose text matches no benchmark item."""
    for block in _item_blocks(benchmark, item_rows):
        sent = docs.sparkSession.sparkContext.broadcast(item_index(block, radius))
        docs = docs.where(~_leaked(sent, similarity_)(F.col("text").cast("string")))
    return docs
