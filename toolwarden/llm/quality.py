"""A quality classifier: random-indexing word vectors, pooled per document, and a small network.

A word's index vector is a sparse ternary vector derived from its hash; nothing is stored for
it.  Its word vector is the sum of the index vectors of the words around it in all documents
outside the held-out fold, kept in a table of hashed words of fixed size.  Each word also has a
form (first and last character class, length class, capitals, repetition of the word before),
whose vectors are learnt the same way from the forms around it, so that words never seen still
say how they are written.  A document's features are the means of both; a network of two layers
with a temperature fitted on rows it did not train on turns them into a probability.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import arrays
from .storage import unused

#: Rows of each table of vectors and their width: two tables of 4 MB, whatever the vocabulary.
BUCKETS = 1 << 14
WIDTH = 64
#: Non-zero entries of an index vector, and neighbours on either side.
ENTRIES = 4
WINDOW = 2
#: Rows of a table that travel together when the tasks' sums meet.
ROWS_PER_CHUNK = 64
#: Labelled rows that the network learns from, those of smallest hashed id.  The only bounded
#: sample here; vectors come from all documents.
SAMPLE_ROWS = 20_000
HIDDEN = 32

_CLASS = np.full(256, 4, np.int64)
_CLASS[97:123] = 0
_CLASS[65:91] = 1
_CLASS[48:58] = 2
_CLASS[0x80:] = 3
for _k, _c in enumerate(b".,;:!?#$%&*|@/<>=+-_()[]{}\"'"):
    _CLASS[_c] = 5 + _k
_UPPER = np.zeros(256, np.int64)
_UPPER[65:91] = 1
_LOWER = np.zeros(256, np.int64)
_LOWER[97:123] = 1


def in_fold(doc_id: Column, fold: int, folds: int = 5) -> Column:
    """Whether crc32 of the id as text leaves ``fold``; false for a null id."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % folds == fold, F.lit(False))


def _forms(found: arrays.Words) -> np.ndarray:
    """A 64-bit hash of each word's form."""
    data, start, end = found.data, found.start, found.end
    upper = np.concatenate([[0], np.cumsum(_UPPER[data])])
    lower = np.concatenate([[0], np.cumsum(_LOWER[data])])
    capitals, small = upper[end] - upper[start], lower[end] - lower[start]
    length = np.minimum(np.log2(end - start).astype(np.int64), 6)
    shout = ((capitals > 1) & (small == 0)).astype(np.int64)
    again = np.zeros(len(start), np.int64)
    again[1:] = (found.hash[1:] == found.hash[:-1]) & (found.row[1:] == found.row[:-1])
    code = (((_CLASS[data[start]] * 64 + _CLASS[data[end - 1]]) * 8 + length) * 2 + shout) * 2 + again
    return arrays.mix((code + 1).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))


def _terms(column: pa.Array) -> Iterator[tuple[int, int, np.ndarray, tuple[np.ndarray, np.ndarray]]]:
    """By piece of a column: its row range, and of its words the rows, hashes and hashes of forms."""
    offsets, data = arrays.utf8(column)
    for low, high in arrays.pieces(offsets):
        found = arrays.words(offsets[low:high + 1] - offsets[low], data[offsets[low]:offsets[high]], lower=False)
        yield low, high, found.row, (found.hash, _forms(found))


def _bucket(value: np.ndarray) -> np.ndarray:
    return (value >> np.uint64(48)).astype(np.int64) % BUCKETS


def _around(row: np.ndarray, value: np.ndarray) -> np.ndarray:
    """Sums of the index vectors around each word, by bucket of the word."""
    bucket = _bucket(value)
    cells, signs = [], []
    for k in range(ENTRIES):
        part = (value >> np.uint64(8 * k)).astype(np.int64)
        place, sign = part & (WIDTH - 1), ((part >> 6) & 1) * 2 - 1
        for step in range(WINDOW + 1):
            near = row[step:] == row[:len(row) - step]
            for mine, other in ((slice(step, None), slice(0, len(row) - step)),
                                (slice(0, len(row) - step), slice(step, None)))[:1 if not step else 2]:
                cells.append((bucket[mine] * WIDTH + place[other])[near])
                signs.append(sign[other][near])
    return np.bincount(np.concatenate(cells), np.concatenate(signs), minlength=BUCKETS * WIDTH)


def learn_vectors(docs: DataFrame) -> np.ndarray:
    """Unit vectors of words and of forms, from all given documents: (2, BUCKETS, WIDTH)."""
    chunks = BUCKETS // ROWS_PER_CHUNK

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((2, BUCKETS * WIDTH))
        for batch in batches:
            for _, _, row, terms in _terms(batch.column(0)):
                for k in range(2):
                    total[k] += _around(row, terms[k])
        parts = total.astype(np.float32).reshape(2 * chunks, -1)
        used = [k for k in range(2 * chunks) if parts[k].any()]
        yield pa.record_batch([pa.array(used, pa.int32()), pa.array([parts[k].tobytes() for k in used], pa.binary())],
                              names=["chunk", "sums"])

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            for chunk, sums in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                total[chunk] = total.get(chunk, 0.0) + np.frombuffer(sums, np.float32).astype(np.float64)
        yield pa.record_batch([pa.array(list(total), pa.int32()),
                               pa.array([v.astype(np.float32).tobytes() for v in total.values()], pa.binary())],
                              names=["chunk", "sums"])

    schema = "chunk int, sums binary"
    rows = docs.select("text").mapInArrow(add, schema).repartition("chunk").mapInArrow(join, schema).collect()
    table = np.zeros((2 * chunks, ROWS_PER_CHUNK * WIDTH), np.float32)
    for r in rows:
        table[r.chunk] = np.frombuffer(r.sums, np.float32)
    table = table.reshape(2, BUCKETS, WIDTH)
    return table / np.maximum(np.linalg.norm(table, axis=2, keepdims=True), 1e-9)


def pooled(column: pa.Array, vectors: np.ndarray) -> np.ndarray:
    """Features of each text: the means of its words' and its forms' vectors, and how long it is."""
    out = np.zeros((len(column), 2 * WIDTH + 1), np.float32)
    for low, high, row, terms in _terms(column):
        bounds = np.searchsorted(row, np.arange(high - low + 1))
        count = np.diff(bounds)
        some = np.flatnonzero(count)
        if not some.size:
            continue
        for k in range(2):
            sums = np.add.reduceat(vectors[k][_bucket(terms[k])], bounds[some], axis=0, dtype=np.float32)
            out[low + some, k * WIDTH:(k + 1) * WIDTH] = sums / count[some, None]
        out[low + some, -1] = np.log1p(count[some])
    return out


def _hidden(x: np.ndarray, net: dict) -> np.ndarray:
    return np.maximum((x - net["mean"]) / net["spread"] @ net["w1"] + net["b1"], 0)


def logits(x: np.ndarray, net: dict) -> np.ndarray:
    return (_hidden(x, net) @ net["w2"] + net["b2"]) / net["temperature"]


def train(x: np.ndarray, y: np.ndarray, epochs: int = 40, seed: int = 7) -> dict:
    """A two-layer network on features and 0/1 labels, with a calibrated temperature.

    One row in ten is kept from the training; the temperature minimises its log loss.  Without
    rows the network gives 0.5 for everything.
    """
    rng = np.random.default_rng(seed)
    width = x.shape[1]
    net = {"mean": np.zeros(width), "spread": np.ones(width), "w1": rng.normal(0, np.sqrt(2 / width), (width, HIDDEN)),
           "b1": np.zeros(HIDDEN), "w2": np.zeros(HIDDEN), "b2": np.zeros(1), "temperature": 1.0}
    if not len(y):
        return net
    net["mean"], net["spread"] = x.mean(0), x.std(0) + 1e-3
    net["w2"] = rng.normal(0, np.sqrt(1 / HIDDEN), HIDDEN)
    share = np.clip(y.mean(), 1e-3, 1 - 1e-3)
    net["b2"] = np.array([np.log(share / (1 - share))])
    aside = rng.random(len(y)) < 0.1
    own, labels = x[~aside].astype(np.float64), y[~aside].astype(np.float64)
    names = ("w1", "b1", "w2", "b2")
    first, second = {n: np.zeros_like(net[n]) for n in names}, {n: np.zeros_like(net[n]) for n in names}
    step = 0
    for epoch in range(epochs):
        rate = 3e-3 * (1 - epoch / epochs) + 1e-4
        order = rng.permutation(len(labels))
        for low in range(0, len(order), 256):
            rows = order[low:low + 256]
            scaled = (own[rows] - net["mean"]) / net["spread"]
            hidden = np.maximum(scaled @ net["w1"] + net["b1"], 0)
            off = (1 / (1 + np.exp(-(hidden @ net["w2"] + net["b2"]))) - labels[rows]) / len(rows)
            back = np.outer(off, net["w2"]) * (hidden > 0)
            slope = {"w1": scaled.T @ back + 1e-4 * net["w1"], "b1": back.sum(0),
                     "w2": hidden.T @ off + 1e-4 * net["w2"], "b2": np.array([off.sum()])}
            step += 1
            for n in names:
                first[n] = 0.9 * first[n] + 0.1 * slope[n]
                second[n] = 0.999 * second[n] + 0.001 * slope[n] ** 2
                net[n] = net[n] - rate * (first[n] / (1 - 0.9 ** step)) / (np.sqrt(second[n] / (1 - 0.999 ** step)) + 1e-8)
    if aside.any():
        z, target = logits(x[aside], net), y[aside]
        grid = np.exp(np.linspace(np.log(0.25), np.log(8), 61))
        loss = [np.logaddexp(0, z / t).mean() - (target * z / t).mean() for t in grid]
        net["temperature"] = float(grid[int(np.argmin(loss))])
    return net


def learn(docs: DataFrame, labels: DataFrame, fold: int = 0, folds: int = 5,
          sample_rows: int = SAMPLE_ROWS) -> tuple[np.ndarray, dict]:
    """Vectors and network, from documents (doc_id, text) and labels outside the held-out fold."""
    docs = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    vectors = learn_vectors(docs.where(~in_fold(F.col("doc_id"), fold, folds)))
    sent = docs.sparkSession.sparkContext.broadcast(vectors)
    sample = (labels.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("quality").cast("double").alias("quality"))
              .where(F.col("doc_id").isNotNull() & F.col("quality").isNotNull() & ~in_fold(F.col("doc_id"), fold, folds))
              .groupBy("doc_id").agg(F.max("quality").alias("quality"))
              .orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample_rows))

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = pooled(batch.column(1), sent.value)
            yield pa.record_batch([batch.column(0), pa.array([r.tobytes() for r in x], pa.binary()), batch.column(2)],
                                  names=["doc_id", "x", "quality"])

    # At most sample_rows rows of two numbers are broadcast, and as many feature rows come back.
    rows = (docs.join(F.broadcast(sample), "doc_id")
            .mapInArrow(features, "doc_id bigint, x binary, quality double")
            .dropDuplicates(["doc_id"]).orderBy("doc_id").limit(sample_rows).collect())
    x = np.array([np.frombuffer(r.x, np.float32) for r in rows]).reshape(len(rows), 2 * WIDTH + 1)
    return vectors, train(x, np.array([r.quality for r in rows]))


def with_score(docs: DataFrame, model: tuple[np.ndarray, dict], into: str = "score") -> DataFrame:
    """All columns and ``into``, the probability that the text is of quality 1; a column of that name is replaced."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    @F.arrow_udf("double")
    def score(text: pa.Array) -> pa.Array:
        vectors, net = sent.value
        return pa.array(1 / (1 + np.exp(-np.clip(logits(pooled(text, vectors), net), -500, 500))))

    return docs.withColumn(into, score(F.col("text").cast("string")))


def quality_scores(docs: DataFrame, labels: DataFrame, threshold: float = 0.3, fold: int = 0, folds: int = 5,
                   sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """One row per document: doc_id, held_out, score, predicted.

    ``score`` is the calibrated probability that ``labels.quality`` is 1, from the text alone;
    ``predicted`` is 1 from ``threshold`` upwards.  Documents whose id falls into the held-out
    fold teach neither vectors nor network.  Null and empty texts have a score too, that of a
    text without words; labels that are null are skipped; without any label every score is 0.5.
    Rows are neither joined nor merged: repeated rows and null ids (never held out) keep theirs.
    """
    scored = with_score(docs.select("doc_id", "text"), learn(docs, labels, fold, folds, sample_rows))
    return scored.select(F.col("doc_id").cast("bigint").alias("doc_id"), in_fold(F.col("doc_id"), fold, folds).alias("held_out"),
                         "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def accepted(docs: DataFrame, labels: DataFrame, threshold: float = 0.3, fold: int = 0, folds: int = 5,
             sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """The documents, in all their columns, that score ``threshold`` or more."""
    score = unused(docs, "_score")
    scored = with_score(docs, learn(docs, labels, fold, folds, sample_rows), score)
    return scored.where(F.col(score) >= threshold).drop(score)
