"""Shards of nearly equal bytes by Karmarkar-Karp differencing, equal texts kept together.

Differencing holds partial partitions (each a list of shard sums) and again and again combines
the two of largest spread, the fullest shard of one with the emptiest of the other.  Here it
runs at two levels.  Tasks difference their own groups of equal texts into bundles of about one
``pieces``-th of all bytes; a group that is larger is a bundle by itself, so there are at most
``2 * pieces`` bundles plus one per task, however many documents there are.  The driver
differences the bundles' sums, a bounded list, into the shards.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .storage import kept

#: Parts of the corpus that are moved as a whole: the list on the driver is at most twice as long.
PIECES = 1 << 14
#: Cells that a shard's rows are numbered in, each by its own task.
CELLS = 1 << 10


def difference(weights: list[int], parts: int) -> list[int]:
    """The part of each weight, by largest differencing over ``parts`` parts."""
    heap: list[tuple] = []
    for k, w in enumerate(weights):
        heap.append((-w, k, [w] + [0] * (parts - 1), [k] + [None] * (parts - 1)))
    heapq.heapify(heap)
    while len(heap) > 1:
        _, tie, sums, trees = heapq.heappop(heap)
        _, _, other, others = heap[0]
        joined = sorted(((a + b, s if t is None else t if s is None else (s, t)) for a, b, s, t in
                         zip(sums, reversed(other), trees, reversed(others))), key=lambda x: -x[0])
        sums, trees = [x[0] for x in joined], [x[1] for x in joined]
        heapq.heapreplace(heap, (sums[-1] - sums[0], tie, sums, trees))
    part = [0] * len(weights)
    for number, tree in enumerate(heap[0][3] if heap else []):
        stack = [tree]
        while stack:
            node = stack.pop()
            if isinstance(node, tuple):
                stack += node
            elif node is not None:
                part[node] = number
    return part


def balanced(weights: np.ndarray, parts: int) -> np.ndarray:
    """Differencing that starts from sorted runs of ``parts`` weights, one for each part."""
    order = np.argsort(-weights, kind="stable")
    rows = -(-len(order) // parts)
    members = np.append(order, np.full(rows * parts - len(order), -1)).reshape(rows, parts)
    value = np.append(weights, 0)
    heap = [(int(v[-1] - v[0]), k, v, m[None]) for k, m in enumerate(members) for v in [value[m]]]
    heapq.heapify(heap)
    while len(heap) > 1:
        _, tie, sums, own = heapq.heappop(heap)
        _, _, other, theirs = heap[0]
        sums = sums + other[::-1]
        turn = np.argsort(-sums, kind="stable")
        heapq.heapreplace(heap, (int(sums[turn[-1]] - sums[turn[0]]), tie, sums[turn],
                                 np.concatenate([own, theirs[:, ::-1]])[:, turn]))
    part = np.zeros(len(weights), np.int64)
    for number, column in enumerate(heap[0][3].T):
        part[column[column >= 0]] = number
    return part


def bundles(groups: DataFrame, keys: list[str], target: int) -> DataFrame:
    """``keys`` and ``weight`` with the bundle of each group; bundles reach ``target`` or end their task."""
    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fresh = TaskContext.get().partitionId() << 40
        open_, filled = fresh, 0
        for batch in batches:
            weight = batch.column(len(keys)).to_numpy(zero_copy_only=False)
            bundle = np.zeros(len(weight), np.int64)
            large = weight >= target
            bundle[large] = fresh + 1 + np.arange(large.sum())
            fresh += int(large.sum())
            rest = weight[~large]
            if (parts := int(rest.sum()) // target) > 1:
                bundle[~large] = fresh + 1 + balanced(rest, parts)
                fresh += parts
            else:
                bundle[~large] = open_
                filled += int(rest.sum())
                if filled >= target:
                    fresh += 1
                    open_, filled = fresh, 0
            yield pa.record_batch([*batch.columns, pa.array(bundle)], names=[*batch.schema.names, "bundle"])

    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in groups.select(*keys, "weight").schema)
    return groups.select(*keys, "weight").mapInArrow(pack, f"{schema}, bundle bigint")


def shards(docs: DataFrame, count: int = 16, pieces: int = PIECES) -> DataFrame:
    """One row per document: doc_id, size, text_crc32, law, shard, slot, grown_shard.

    The law is ``bytes``: sizes (UTF-8 bytes plus 1) near equal, and documents of equal text in
    one shard.  A group larger than a shard's share has a shard nearly by itself.  ``slot``
    numbers a shard's rows from 0 without gaps.  A null text has size 1 and checksum 0 and is a
    group of its own, apart from the empty text.  Repeated rows and null ids stay as they are;
    an empty table gives none.  ``grown_shard`` is null, as the law doesn't hold it.
    """
    spark = docs.sparkSession
    text = F.col("text").cast("string")
    keys = ["_hash", "text_crc32", "size", "_null"]
    rows = kept(docs.select(
        F.col("doc_id").cast("bigint").alias("doc_id"),
        (F.coalesce(F.octet_length(text), F.lit(0)) + 1).cast("bigint").alias("size"),
        F.crc32(F.coalesce(text, F.lit(""))).alias("text_crc32"),
        F.xxhash64(text).alias("_hash"), text.isNull().alias("_null")), "shard-rows")
    groups = rows.groupBy(*keys).agg((F.count("*") * F.col("size")).alias("weight"))
    total = rows.agg(F.sum("size")).first()[0] or 0
    packed = kept(bundles(groups, keys, max(1, total // pieces)), "shard-bundles")
    sums = packed.groupBy("bundle").agg(F.sum("weight").alias("weight")).orderBy("bundle").collect()
    part = difference([r.weight for r in sums], count)
    placed = spark.createDataFrame([(r.bundle, p) for r, p in zip(sums, part)], "bundle bigint, shard int")
    where = kept(packed.join(placed, "bundle").select(*keys, "shard"), "shard-groups")
    out = kept(rows.join(where, keys).withColumn("_cell", F.pmod(F.xxhash64("doc_id", "_hash"), F.lit(CELLS))),
               "shard-placed")
    counts = out.groupBy("shard", "_cell").agg(F.count("*").alias("_n"))
    before = Window.partitionBy("shard").orderBy("_cell").rowsBetween(Window.unboundedPreceding, -1)
    ahead = counts.select("shard", "_cell", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_ahead"))
    within = F.row_number().over(Window.partitionBy("shard", "_cell").orderBy("doc_id", "_hash"))
    return (out.withColumn("_at", within).join(ahead, ["shard", "_cell"])
            .select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard",
                    (F.col("_ahead") + F.col("_at") - 1).cast("bigint").alias("slot"),
                    F.lit(None).cast("int").alias("grown_shard")))
