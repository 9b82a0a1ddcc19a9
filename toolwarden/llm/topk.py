"""Exact top-k inner products on a bit-sliced index.

The index holds, for a block of rows, one bitmap per dimension and bit of the quantised
components, rows in order of their id.  A query's score is a sum of shifted slices: its
components are written in signed digits, a digit of minus one adds the complemented slice and a
constant, and carry-save adders on bitmaps bring the sum down to the score's own slices.  The
best rows are then read off from the most significant slice downward; rows still tied at the
boundary share one score, and the smallest ids among them are taken.

The query set is worked in blocks of bounded size: a block is broadcast, every task holds it
against the index blocks of its own partition, and only a task's best rows per query are
shuffled.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .storage import kept

#: Rows in an index block; with 64 dimensions of 8 bits, a block is a megabyte.
BLOCK_ROWS = 1 << 14
#: Queries that are broadcast at once.
QUERY_ROWS = 1 << 12


def quantised(vector: Column, scale: int) -> Column:
    """floor(scale * component), as whole numbers; null where a component is null or not finite."""
    fine = F.forall(vector, lambda x: x.isNotNull() & (F.abs(x.cast("double")) < F.lit(float("inf"))) & ~F.isnan(x))
    return F.when(fine, F.transform(vector, lambda x: F.floor(x.cast("double") * scale).cast("bigint")))


def _vectors(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Lengths and flat values of a list column without nulls."""
    offsets = column.offsets.to_numpy(zero_copy_only=False)
    return np.diff(offsets), column.values.to_numpy(zero_copy_only=False)[offsets[0]:offsets[-1]]


def _block(ids: np.ndarray, values: np.ndarray) -> dict:
    """The slices of one block: ids in order, each dimension's least value, and bitmaps by dimension and bit."""
    order = np.argsort(ids, kind="stable")
    ids, values = ids[order], values[order]
    least = values.min(axis=0) if values.shape[1] else np.zeros(0, np.int64)
    rest = (values - least).T
    bits = max(1, int(rest.max()).bit_length()) if rest.size else 1
    spare = -len(ids) % 64
    slices = [np.packbits(np.pad((rest >> b) & 1, ((0, 0), (0, spare))).astype(bool), axis=1, bitorder="little")
              for b in range(bits)]
    return {"ids": ids.astype("<i8").tobytes(), "dims": values.shape[1], "bits": bits,
            "least": least.astype("<i8").tobytes(), "slices": np.stack(slices, axis=1).tobytes() if slices else b""}


INDEX = "dims int, bits int, ids binary, least binary, slices binary"


def build_index(vectors: DataFrame, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Index blocks of (id, values) rows; a block holds vectors of one length and one partition."""
    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list] = {}

        def flush(dims: int) -> pa.RecordBatch:
            parts = held.pop(dims)
            block = _block(np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts]))
            return pa.RecordBatch.from_pylist([block], schema=pa.schema(
                [("dims", pa.int32()), ("bits", pa.int32()), ("ids", pa.binary()), ("least", pa.binary()),
                 ("slices", pa.binary())]))

        for batch in batches:
            ids = batch.column(0).to_numpy(zero_copy_only=False)
            length, flat = _vectors(batch.column(1))
            first = np.cumsum(length) - length
            for dims in np.unique(length).tolist():
                rows = np.flatnonzero(length == dims)
                values = flat[(first[rows][:, None] + np.arange(dims)).astype(np.int64)]
                for low in range(0, len(rows), block_rows):
                    held.setdefault(dims, []).append((ids[rows][low:low + block_rows], values[low:low + block_rows]))
                    if sum(len(p[0]) for p in held[dims]) >= block_rows:
                        yield flush(dims)
        for dims in list(held):
            yield flush(dims)

    return vectors.mapInArrow(build, INDEX)


def _digits(q: int) -> list[tuple[int, int]]:
    """A whole number as (place, +1 or -1), no two places adjacent."""
    found, place = [], 0
    while q:
        if q & 1:
            d = 2 - (q & 3)
            found.append((place, d))
            q -= d
        q >>= 1
        place += 1
    return found


def _sum_slices(query: list[int], both: np.ndarray, bits: int) -> tuple[dict[int, np.ndarray], int]:
    """Score slices by place, and the constant that belongs to them.

    ``both`` has the slices by dimension, sign (plain, complemented) and bit.
    """
    columns: dict[int, list[tuple[int, int, int]]] = {}
    constant = 0
    for dim, q in enumerate(query):
        for place, digit in _digits(q):
            constant -= ((1 << bits) - 1) << place if digit < 0 else 0
            for b in range(bits):
                columns.setdefault(place + b, []).append((dim, 0 if digit > 0 else 1, b))
    out: dict[int, np.ndarray] = {}
    carried: list[np.ndarray] = []
    place, last = min(columns, default=0), max(columns, default=-1)
    while place <= last or carried:
        own = columns.get(place, [])
        stack = [both[tuple(np.array(own).T)]] if own else []
        stack = np.concatenate([*stack, *carried]) if stack or carried else np.zeros((0, both.shape[-1]), np.uint64)
        carried = []
        while len(stack) > 1:
            n = len(stack) // 3
            if n:
                x, y, z = stack[:n], stack[n:2 * n], stack[2 * n:3 * n]
                part = x ^ y
                carried.append((x & y) | (z & part))
                stack = np.concatenate([part ^ z, stack[3 * n:]])
            else:
                carried.append((stack[0] & stack[1])[None])
                stack = (stack[0] ^ stack[1])[None]
        if len(stack):
            out[place] = stack[0]
        place += 1
    return out, constant


def _best(slices: dict[int, np.ndarray], among: np.ndarray, k: int) -> np.ndarray:
    """Row numbers of the ``k`` highest sums among the rows of a bitmap, ties to smaller numbers."""
    sure, tied = np.zeros_like(among), among
    need = k
    for place in sorted(slices, reverse=True):
        high = tied & slices[place]
        n = int(np.bitwise_count(high).sum())
        if n >= need:
            tied = high
        else:
            sure, tied, need = sure | high, tied & ~slices[place], need - n
        if not need:
            break
    rows = lambda bitmap: np.flatnonzero(np.unpackbits(bitmap.view(np.uint8), bitorder="little"))
    return np.concatenate([rows(sure), rows(tied)[:need]])


def search(index: DataFrame, queries: list[tuple[int, list[int]]], k: int) -> DataFrame:
    """Each task's ``k`` best rows for each of a bounded list of queries: query_id, vec_id, score."""
    sent = index.sparkSession.sparkContext.broadcast(queries)

    def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: dict[int, list[tuple[int, int]]] = {}
        for batch in batches:
            for block in batch.to_pylist():
                ids, least = np.frombuffer(block["ids"], "<i8"), np.frombuffer(block["least"], "<i8")
                dims, bits = block["dims"], block["bits"]
                words = -(-len(ids) // 64)
                plain = np.frombuffer(block["slices"], np.uint64).reshape(dims, bits, words)
                both = np.stack([plain, ~plain], axis=1)
                every = np.packbits(np.pad(np.ones(len(ids), bool), (0, words * 64 - len(ids))),
                                    bitorder="little").view(np.uint64)
                for query_id, query in sent.value:
                    if len(query) != dims:
                        continue
                    low, high = np.searchsorted(ids, [query_id, query_id + 1])
                    among = every.copy()
                    for own in range(low, high):
                        among[own >> 6] &= ~(np.uint64(1) << np.uint64(own & 63))
                    slices, constant = _sum_slices(query, both, bits)
                    rows = _best(slices, among, k)
                    score = np.full(len(rows), constant + sum(q * m for q, m in zip(query, least.tolist())), np.int64)
                    for place, slice_ in slices.items():
                        bit = (slice_[rows >> 6] >> (rows & 63).astype(np.uint64)) & np.uint64(1)
                        score += bit.astype(np.int64) << place
                    found = best.setdefault(query_id, []) + list(zip((-score).tolist(), ids[rows].tolist()))
                    best[query_id] = sorted(found)[:k]
        rows = [(q, v, -s) for q, found in best.items() for s, v in found]
        yield pa.record_batch([pa.array([r[i] for r in rows], pa.int64()) for i in range(3)],
                              names=["query_id", "vec_id", "score"])

    return index.mapInArrow(probe, "query_id bigint, vec_id bigint, score bigint")


def top_k(vectors: DataFrame, queries: DataFrame, k: int = 5, scale: int = 256, id_: str = "vec_id",
          vector: str = "embedding", query_rows: int = QUERY_ROWS, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """The ``k`` highest inner products of each query: query_id, rank, vec_id, score.

    Components become floor(scale * x); scores are exact whole numbers, ties go to the smaller
    id.  Candidates are all rows with another id than the query's and vectors of its length.
    Rows with a null id, a null vector, or a null or non-finite component take no part; a query
    with fewer candidates has fewer rows, one without any has none.  Of repeated rows each is a
    candidate; a repeated query is answered once per distinct vector.  Further columns are not
    read, and empty tables give an empty result.
    """
    spark = vectors.sparkSession
    shape = lambda df: (df.select(F.col(id_).cast("bigint").alias("id"), quantised(F.col(vector), scale).alias("v"))
                        .where("id IS NOT NULL AND v IS NOT NULL"))
    index = kept(build_index(shape(vectors), block_rows), "bit-slices")
    found, block = [], []
    for row in shape(queries).distinct().toLocalIterator(prefetchPartitions=True):
        block.append((row.id, row.v))
        if len(block) == query_rows:
            found.append(kept(search(index, block, k), "top-rows"))
            block = []
    if block or not found:
        found.append(kept(search(index, block, k), "top-rows"))
    rows = found[0]
    for more in found[1:]:
        rows = rows.unionByName(more)
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return (rows.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
            .select("query_id", "rank", "vec_id", "score"))
