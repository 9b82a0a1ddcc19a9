"""Runs of words that repeat with a period, by online dyadic square catching.

A run of period q between L and 2L, L a power of two, covers two neighbouring blocks of L words
that begin at a multiple of L.  So every completed block has a catcher: while the words appended
are one to two blocks further on, it compares the suffix of L words with its block, and an equal
suffix q words on is a square of period q or more than that.  Squares that neighbouring catchers
report at the same distance merge into one run, whose ends, less than a block beyond them, are
then compared word by word.  A square inside a run of a smaller period is no news: levels go
upward, and it is dropped as soon as it is caught.

Every word has one comparison per level, so a text of n words costs n log n whatever it
repeats.  What a word's comparison says doesn't depend on what earlier words reported, so the
words of a whole Arrow batch are appended together, level by level, in numpy.  Suffixes compare
by 64-bit hashes of twice as many words from level to level, words by their own hash.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import arrays

#: A run has at least so many words, and so many periods.
LEAST_WORDS = 6
LEAST_PERIODS = 4
#: Comparisons at the ends of runs that are made at once.
CELLS = 1 << 18

RUN = T.StructType([T.StructField(name, T.LongType()) for name in ("start", "length", "period")])
FOUND = T.StructType([T.StructField("n_words", T.LongType()), T.StructField("runs", T.ArrayType(RUN)),
                      T.StructField("collapsed", T.StringType())])


def _least(period: np.ndarray | int, words: int, periods: int) -> np.ndarray:
    return np.maximum(words, periods * period)


def _equal_run(word: np.ndarray, at: np.ndarray, step: int, period: np.ndarray, low: np.ndarray, high: np.ndarray,
               most: int) -> np.ndarray:
    """How many words from ``at`` on, in steps of ``step``, equal the word a period before, at most ``most``.

    ``low`` and ``high`` bound the texts of the places.
    """
    out = np.zeros(len(at), np.int64)
    width = max(1, CELLS // max(most, 1))
    for k in range(0, len(at) if most else 0, width):
        part = slice(k, k + width)
        place = at[part, None] + step * np.arange(most)
        fine = (place - period[part, None] >= low[part, None]) & (place < high[part, None])
        place = np.where(fine, place, high[part, None] - 1)
        same = fine & (word[place] == word[np.where(fine, place - period[part, None], place)])
        out[part] = np.where(same.all(axis=1), most, same.argmin(axis=1))
    return out


def find_runs(word: np.ndarray, row: np.ndarray, rows: int, words: int = LEAST_WORDS,
              periods: int = LEAST_PERIODS) -> np.ndarray:
    """All runs of some texts: columns row, start, length, period, sorted by row, start and period.

    ``word`` has the words' hashes and ``row`` the text of each, in order.
    """
    size = np.bincount(row, minlength=rows)
    place = np.arange(len(row)) - np.repeat(np.cumsum(size) - size, size)
    suffix = word
    covered = np.zeros(len(word), np.int64)
    found, block = [], 1
    while True:
        # Only texts that can hold a run of this level go on.
        stay = size[row] >= _least(block, words, periods)
        if not stay.any():
            break
        if not stay.all():
            word, row, place, suffix, covered = (x[stay] for x in (word, row, place, suffix, covered))
        length = size[row]
        base = np.arange(len(row)) - place
        # The catcher that watches the suffix at a place is the block before the one it begins in.
        here = np.flatnonzero((place >= block) & (place + block <= length))
        period = block + (place[here] & (block - 1))
        caught = suffix[here] == suffix[here - period]
        here, period = here[caught], period[caught]
        news = covered[here - period] < place[here] + block
        here, period = here[news], period[news]
        if here.size:
            order = np.lexsort((here, period, row[here]))
            here, period = here[order], period[order]
            fresh = np.ones(len(here), bool)
            fresh[1:] = (here[1:] != here[:-1] + block) | (period[1:] != period[:-1]) | (row[here[1:]] != row[here[:-1]])
            first = np.flatnonzero(fresh)
            blocks = np.diff(np.append(first, len(here)))
            stretch = _least(period[first], words, periods) - period[first]
            enough = blocks >= np.maximum(1, (stretch - block + 1) // block)
            first, blocks = first[enough], blocks[enough]
            begin, period = here[first], period[first]
            end = begin + blocks * block
            low, high = base[begin], base[begin] + length[begin]
            begin = begin - _equal_run(word, begin - 1, -1, period, low, high, block - 1)
            end = end + _equal_run(word, end, 1, period, low, high, block - 1)
            begin = begin - period
            real = end - begin >= _least(period, words, periods)
            begin, end, period, low = begin[real], end[real], period[real], low[real]
            if begin.size:
                found.append(np.stack([row[begin], begin - low, end - begin, period], axis=1))
                np.maximum.at(covered, begin, end - low)
                covered = np.maximum.accumulate(covered + base) - base
        # The suffix of twice the length that begins at a place.
        longer = np.zeros_like(suffix)
        longer[:-block] = arrays.mix(suffix[:-block] * np.uint64(0x9E3779B97F4A7C15) + arrays.mix(suffix[block:]))
        suffix, block = longer, 2 * block
    runs = np.concatenate(found) if found else np.zeros((0, 4), np.int64)
    return runs[np.lexsort((runs[:, 3], runs[:, 1], runs[:, 0]))]


def _collapsed(text: bytes, runs: np.ndarray) -> bytes:
    """The words that no run holds beyond its first period, joined by one space."""
    kept = text.split()  # splits bytes at 0x20 and 0x09 to 0x0D
    if len(runs):
        drop = np.zeros(len(kept) + 1, np.int64)
        np.add.at(drop, runs[:, 1] + runs[:, 3], 1)
        np.add.at(drop, runs[:, 1] + runs[:, 2], -1)
        kept = [kept[k] for k in np.flatnonzero(np.cumsum(drop[:-1]) == 0).tolist()]
    return b" ".join(kept)


def _found(column: pa.Array, words: int, periods: int) -> pa.Array:
    offsets, data = arrays.utf8(column)
    rows = len(offsets) - 1
    size, runs, texts = np.zeros(rows, np.int64), [np.zeros((0, 4), np.int64)], []
    for low, high in arrays.pieces(offsets):
        own, part = offsets[low:high + 1] - offsets[low], data[offsets[low]:offsets[high]]
        split = arrays.words(own, part, lower=False)
        size[low:high] = np.bincount(split.row, minlength=high - low)
        mine = find_runs(split.hash, split.row, high - low, words, periods)
        bounds = np.searchsorted(mine[:, 0], np.arange(high - low + 1))
        raw = part.tobytes()
        texts += [_collapsed(raw[own[k]:own[k + 1]], mine[bounds[k]:bounds[k + 1]]) for k in range(high - low)]
        runs.append(mine + np.array([low, 0, 0, 0]))
    every = np.concatenate(runs)
    bounds = np.searchsorted(every[:, 0], np.arange(rows + 1)).astype(np.int32)
    listed = pa.StructArray.from_arrays([pa.array(every[:, k]) for k in (1, 2, 3)], ["start", "length", "period"])
    return pa.StructArray.from_arrays(
        [pa.array(size), pa.ListArray.from_arrays(pa.array(bounds), listed), pa.array(texts, pa.binary()).cast(pa.string())],
        ["n_words", "runs", "collapsed"])


def found(text: Column, words: int = LEAST_WORDS, periods: int = LEAST_PERIODS) -> Column:
    """Of each text, a struct of n_words, runs (start, length, period by start and period) and collapsed text.

    ``periods`` is 3 or more: a run of fewer need not cover two whole blocks.
    """
    if periods < 3:
        raise ValueError("a run has three periods or more")

    @F.arrow_udf(FOUND)
    def find(column: pa.Array) -> pa.Array:
        return _found(column, words, periods)

    return find(text.cast("string"))


def with_runs(docs: DataFrame, words: int = LEAST_WORDS, periods: int = LEAST_PERIODS) -> DataFrame:
    """All columns of the documents, and n_words, runs and collapsed; columns of those names are replaced.

    A run is a stretch of words with smallest period q, of ``words`` words and ``periods`` periods
    or more, that neither neighbouring word extends; words compare byte by byte.  ``collapsed``
    keeps of each run the first period, and joins words by one space.  Null and empty texts have
    no words, no runs and an empty collapsed text.  Rows are worked each for itself in their
    task: repeated rows and null ids keep theirs, an empty table gives an empty one.
    """
    names = ("n_words", "runs", "collapsed")
    rest = [c for c in docs.columns if c not in names]
    result = found(F.col("text"), words, periods)
    return docs.select(*[F.col(f"`{c}`") for c in rest], *[result[c].alias(c) for c in names])
