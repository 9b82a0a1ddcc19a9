"""Token counts of whole texts by a map-side two-tier lookup.

Byte-level BPE never merges across pre-tokens, so a text's count is the sum over its
pre-tokens.  The first tier is a compact table of the corpus' most frequent pre-tokens (sorted
64-bit hashes beside their lengths), broadcast once; the second is a cache in each Python
worker, filled by encoding the misses in one batch.  No pre-token is ever shuffled: only each
task's few thousand leading pre-tokens meet, to make the table.  The table changes the speed,
never a count.

Pre-tokens of texts in ASCII and Latin letters are found in numpy, for a whole piece of a batch
at once; texts with any other character, or with a special string, go through the pattern.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import arrays

#: The published pattern of this tokenizer's pre-tokens, a fixed value.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Pre-tokens in the broadcast table; each takes at most TABLE_BYTES.
TABLE_ENTRIES = 1 << 15
TABLE_BYTES = 32
#: A task's candidates for the table, and the pre-tokens it counts between two prunings.
TASK_CANDIDATES = 1 << 13
TASK_COUNTED = 1 << 18
#: Pre-tokens a worker's cache holds (hash and length each); a full cache is emptied.
CACHE_ENTRIES = 1 << 19

_SPACE, _LETTER, _DIGIT, _OTHER, _BEYOND = range(5)
_KIND = np.full(256, _OTHER, np.uint8)
_KIND[[0x20, *range(0x09, 0x0E)]] = _SPACE
_KIND[[*range(65, 91), *range(97, 123)]] = _LETTER
_KIND[48:58] = _DIGIT
_KIND[0x1C:0x20] = _BEYOND
_KIND[0x80:] = _BEYOND

_workers: dict[str, tuple] = {}


def _worker(path: str):
    """The tokenizer, its special strings' pattern, the pre-token pattern and the cache of this worker."""
    if path not in _workers:
        import re

        import regex
        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_file(path)
        special = [t.content for t in tokenizer.get_added_tokens_decoder().values() if t.special]
        specials = re.compile("|".join(map(re.escape, sorted(special, key=len, reverse=True)))) if special else None
        _workers[path] = tokenizer, specials, regex.compile(PATTERN), {}
    return _workers[path]


def _kinds(data: np.ndarray) -> np.ndarray:
    """The class of each byte; both bytes of a Latin letter from U+00C0 to U+00FF are letters."""
    kind = _KIND[data]
    lead = np.flatnonzero(data[:-1] == 0xC3)
    lead = lead[(data[lead + 1] != 0x97) & (data[lead + 1] != 0xB7)]
    kind[lead] = kind[lead + 1] = _LETTER
    return kind


def _starts(data: np.ndarray, kind: np.ndarray, edge: np.ndarray) -> np.ndarray:
    """Where pre-tokens start; ``edge`` marks the rows' first bytes (and the end of the data)."""
    n = len(data)
    start = edge[:n].copy()
    start[1:] |= kind[1:] != kind[:-1]
    # White space before a word: all but its last character stand alone, a last space joins the word.
    joint = np.flatnonzero((kind[:-1] == _SPACE) & (kind[1:] != _SPACE) & ~edge[1:n])
    start[joint] = True
    start[joint[data[joint] == 0x20] + 1] = False
    # Contractions: an apostrophe that no space joined, at a pre-token's start.
    wide = np.concatenate([data, np.zeros(3, np.uint8)])
    stop = np.concatenate([edge, np.ones(3, bool)])
    at = np.flatnonzero((data == 0x27) & start)
    one, two = wide[at + 1], wide[at + 2]
    single = np.isin(one, np.frombuffer(b"stmd", np.uint8)) & ~stop[at + 1]
    double = (((one == 0x72) | (one == 0x76)) & (two == 0x65) | (one == 0x6C) & (two == 0x6C)) & ~stop[at + 1] & ~stop[at + 2]
    for these, size in ((at[single], 2), (at[double], 3)):
        start[these + 1] = False
        beyond = these + size
        beyond = beyond[(beyond < n) & ~stop[beyond]]
        start[beyond[kind[beyond] == _LETTER]] = True
    return np.flatnonzero(start)


def _pretokens(column: pa.Array, worker) -> Iterator[tuple]:
    """By piece of a column: first row, the pre-tokens' rows, hashes and bytes, and what rows have besides.

    Rows for the pattern are split on their own; a special string is one token by itself, counted
    in ``extra``.
    """
    _, specials, pattern, _ = worker
    offsets, data = arrays.utf8(column)
    for low, high in arrays.pieces(offsets):
        own, part = offsets[low:high + 1] - offsets[low], data[offsets[low]:offsets[high]]
        extra = np.zeros(high - low, np.int64)
        if not len(part):
            continue
        kind = _kinds(part)
        slow = np.zeros(high - low, bool)
        if (far := np.flatnonzero(kind == _BEYOND)).size:
            slow[np.searchsorted(own, far, side="right") - 1] = True
        if specials is not None:
            for found in specials.finditer(part.tobytes().decode("latin-1")):
                slow[np.searchsorted(own, found.start(), side="right") - 1] = True
        edge = np.zeros(len(part) + 1, bool)
        edge[own] = True
        start = _starts(part, kind, edge)
        row = np.searchsorted(own, start, side="right") - 1
        end = np.append(start[1:], len(part))
        fast = ~slow[row]
        row, start, end = row[fast], start[fast], end[fast]
        value = arrays.hashes(part, start, end)
        yield low, row, value, lambda k, p=part, s=start, e=end: p[s[k]:e[k]].tobytes().decode(), extra
        for k in np.flatnonzero(slow):
            text = part[own[k]:own[k + 1]].tobytes().decode()
            split = specials.split(text) if specials is not None else [text]
            extra = np.zeros(high - low, np.int64)
            extra[k] = len(split) - 1
            found = [x for each in split for x in pattern.findall(each)]
            coded = [x.encode() for x in found]
            end = np.cumsum([len(x) for x in coded], dtype=np.int64)
            value = arrays.hashes(np.frombuffer(b"".join(coded), np.uint8), np.append(0, end[:-1])[:len(end)], end)
            yield low, np.full(len(found), k), value, found.__getitem__, extra


def frequent(docs: DataFrame, tokenizer: str, entries: int = TABLE_ENTRIES) -> tuple[np.ndarray, np.ndarray]:
    """The most frequent pre-tokens of all texts: sorted hashes and token counts, at most ``entries``.

    Each task counts its pre-tokens and, whenever it holds too many, drops the rarest; what it
    reports are its leading ones.  The sum over tasks is exact for any pre-token that leads
    everywhere and a lower bound for the rest, which is all a cache needs.
    """
    def leading(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        worker = _worker(tokenizer)
        counts: Counter = Counter()
        names: dict[int, str] = {}
        for batch in batches:
            for _, _, value, name, _ in _pretokens(batch.column(0), worker):
                unique, first, n = np.unique(value, return_index=True, return_counts=True)
                many = n > 2
                for h, k, m in zip(unique[many].tolist(), first[many].tolist(), n[many].tolist()):
                    counts[h] += m
                    if h not in names:
                        names[h] = name(k)
                if len(counts) > TASK_COUNTED:
                    counts = Counter(dict(counts.most_common(TASK_CANDIDATES)))
                    names = {h: names[h] for h in counts}
        top = [(names[h], n) for h, n in counts.most_common(TASK_CANDIDATES) if len(names[h].encode()) <= TABLE_BYTES]
        yield pa.record_batch([pa.array([w for w, _ in top], pa.string()), pa.array([n for _, n in top], pa.int64())],
                              names=["piece", "n"])

    rows = (docs.select("text").mapInArrow(leading, "piece string, n bigint").groupBy("piece")
            .agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "piece").limit(entries).collect())
    pieces = [r.piece for r in rows]
    coded = [p.encode() for p in pieces]
    end = np.cumsum([len(p) for p in coded], dtype=np.int64)
    keys = arrays.hashes(np.frombuffer(b"".join(coded), np.uint8), np.append(0, end[:-1])[:len(end)], end)
    order = np.argsort(keys)
    return keys[order], _lengths(_worker(tokenizer)[0], pieces)[order]


def _lengths(encoder, pieces: list[str]) -> np.ndarray:
    return np.array([len(e.ids) for e in encoder.encode_batch(pieces, add_special_tokens=False)], np.int64)


def token_counts(docs: DataFrame, tokenizer: str, limit: int = 512, entries: int = TABLE_ENTRIES) -> DataFrame:
    """One row per document: doc_id, n_bytes, n_tokens, over_limit (more than ``limit`` tokens).

    ``tokenizer`` is the path of a byte-level BPE file, readable on every worker.  Null and empty
    texts have 0 bytes and 0 tokens; a special string inside a text is one token, as the
    tokenizers library has it by default.  Repeated rows and null ids each give their own row,
    an empty table gives none, and further columns are not carried.
    """
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    table = spark.sparkContext.broadcast(frequent(docs, tokenizer, entries))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        worker = encoder, _, _, cache = _worker(tokenizer)
        keys, sizes = table.value
        for batch in batches:
            totals = np.zeros(batch.num_rows, np.int64)
            for low, row, value, name, extra in _pretokens(batch.column(1), worker):
                n = np.zeros(len(value), np.int64)
                at = np.searchsorted(keys, value)
                at[at == len(keys)] = 0
                known = keys[at] == value if len(keys) else np.zeros(len(value), bool)
                n[known] = sizes[at[known]]
                rest = np.flatnonzero(~known)
                if rest.size:
                    unique, first, back = np.unique(value[rest], return_index=True, return_inverse=True)
                    hashes = unique.tolist()
                    if len(cache) + len(hashes) > CACHE_ENTRIES:
                        cache.clear()
                    fresh = [k for k, h in enumerate(hashes) if h not in cache]
                    found = _lengths(encoder, [name(k) for k in rest[first[fresh]].tolist()])
                    cache.update(zip(map(hashes.__getitem__, fresh), found.tolist()))
                    n[rest] = np.fromiter(map(cache.__getitem__, hashes), np.int64, len(hashes))[back]
                totals[low:low + len(extra)] += extra + np.bincount(row, n, minlength=len(extra)).astype(np.int64)
            offsets, _ = arrays.utf8(batch.column(1))
            yield pa.record_batch([batch.column(0), pa.array(np.diff(offsets)), pa.array(totals),
                                   pa.array(totals > limit)], names=["doc_id", "n_bytes", "n_tokens", "over_limit"])

    return docs.mapInArrow(count, "doc_id bigint, n_bytes bigint, n_tokens bigint, over_limit boolean")
