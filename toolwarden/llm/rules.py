"""Quality rules whose cutoffs follow the corpus: quantile sketches per language and source.

Every text is measured once, whole.  What it measures becomes whole-number features, and each
feature of each (language, source) goes into a quantile sketch: counts by bucket, where a bucket
holds the values that agree in their leading bits.  Sketches merge by adding counts, so Spark
sums them before the shuffle, a hot source costs no more than a small one, and the sketch of a
language, or of the corpus, is the sum of its parts.  From the sketch come a lower and an upper
fence per feature; the documents are joined with the fences of their group and those beyond
one are rejected.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import arrays
from .storage import kept, unused

#: Words of a repeated window, and the fixed base rules.
WINDOW = 8
LEAST_WORDS = 20
REPEAT_PERCENT = 30
#: Buckets agree in this many leading bits: a quantile is at most 1/32 below the true one.
LEADING_BITS = 6
#: Documents that a group needs for fences of its own; below, it is merged upward.
GROUP_ROWS = 200
#: Fences lie this many interquartile ranges outside the quartiles.
REACH = 4

_SYMBOL = np.zeros(256, bool)
_SYMBOL[[ord(c) for c in "#*$%&|<>"]] = True
COUNTS = ("n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words")


def _repeated(row: np.ndarray, value: np.ndarray) -> np.ndarray:
    """Two flags by value: whether an equal one stands earlier in its row, and whether one stands elsewhere in it."""
    order = np.lexsort((value, row))
    same = np.zeros(len(order), bool)
    same[1:] = (value[order[1:]] == value[order[:-1]]) & (row[order[1:]] == row[order[:-1]])
    later, any_ = np.zeros(len(order), bool), np.zeros(len(order), bool)
    later[order] = same
    same[:-1] |= same[1:]
    any_[order] = same
    return np.stack([later, any_])


def measured(column: pa.Array, window: int = WINDOW) -> np.ndarray:
    """The whole-number measures of each text, one column for each of ``COUNTS``; null counts as empty."""
    offsets, data = arrays.utf8(column)
    out = np.zeros((len(offsets) - 1, len(COUNTS)), np.int64)
    for low, high in arrays.pieces(offsets):
        own, part = offsets[low:high + 1] - offsets[low], data[offsets[low]:offsets[high]]
        rows = high - low
        found = arrays.words(own, part, lower=False)
        if not len(found.row):
            continue

        def per_row(flags: np.ndarray) -> np.ndarray:
            return np.diff(np.concatenate([[0], np.cumsum(flags)])[own])

        def inside(start: np.ndarray, end: np.ndarray, total: np.ndarray) -> np.ndarray:
            return total[end] - total[start]

        count = np.bincount(found.row, minlength=rows)
        chars = np.concatenate([[0], np.cumsum((part & 0xC0) != 0x80)])
        words = inside(found.start, found.end, chars)

        breaks = np.flatnonzero(part == 10)
        filled = own[:-1][np.diff(own) > 0]
        begin = np.unique(np.concatenate([filled, breaks + 1]))
        begin = begin[begin < len(part)]
        line_row = np.searchsorted(own, begin, side="right") - 1
        stop = np.minimum(np.append(breaks, len(part))[np.searchsorted(breaks, begin)], own[line_row + 1])
        starts = np.zeros(len(part) + 1, np.int64)
        starts[found.start + 1] = 1
        worded = inside(begin, stop, np.cumsum(starts)) > 0
        begin, stop, line_row = begin[worded], stop[worded], line_row[worded]
        later = _repeated(line_row, arrays.hashes(part, begin, stop))[0]

        at, value = arrays.grams(found.hash, found.row, window)
        twice = at[_repeated(found.row[at], value)[1]]
        cover = np.zeros(len(found.row) + 1, np.int64)
        np.add.at(cover, twice, 1)
        np.add.at(cover, twice + window, -1)
        covered = np.cumsum(cover[:-1]) > 0
        out[low:high] = np.stack([
            count, np.bincount(found.row, words, rows).astype(np.int64), per_row(_SYMBOL[part]),
            np.bincount(line_row, minlength=rows), np.bincount(line_row[later], minlength=rows),
            np.bincount(found.row[covered], minlength=rows)], axis=1)
    return out


@F.arrow_udf(T.ArrayType(T.LongType()))
def _measures(text: pa.Array) -> pa.Array:
    counts = measured(text)
    return pa.ListArray.from_arrays(pa.array(np.arange(0, counts.size + 1, counts.shape[1], dtype=np.int32)),
                                    pa.array(counts.ravel()))


def _at(counts: Column) -> dict[str, Column]:
    return {name: counts[k] for k, name in enumerate(COUNTS)}


class Feature:
    """A whole number per document, by its name, its value from the measures, and its least spread."""

    def __init__(self, name: str, part: str, whole: str, scale: int, spread: int, low: bool = False):
        self.name, self.part, self.whole, self.scale, self.spread, self.low = name, part, whole, scale, spread, low

    def value(self, m: dict[str, Column]) -> Column:
        return F.floor(m[self.part] * self.scale / F.greatest(m[self.whole], F.lit(1))).cast("bigint")


#: Hundredths of a character per word, then parts of ten thousand.
FEATURES = (
    Feature("mean_chars", "word_chars", "n_words", 100, 40, low=True),
    Feature("symbols", "n_symbols", "word_chars", 10000, 100),
    Feature("dup_lines", "n_dup_lines", "n_lines", 10000, 1000),
    Feature("repeat_words", "n_repeat_words", "n_words", 10000, 500),
)


def bucket(value: Column) -> Column:
    """The least value with the same leading bits: the bucket of a value of 0 or more."""
    shift = F.greatest(F.length(F.bin(value)) - LEADING_BITS, F.lit(0))
    return F.call_function("shiftleft", F.call_function("shiftright", value, shift), shift)


def base_failed(m: dict[str, Column]) -> Column:
    return (m["n_words"] < LEAST_WORDS) | (100 * m["n_repeat_words"] > REPEAT_PERCENT * m["n_words"])


def sketches(rows: DataFrame) -> DataFrame:
    """Sketches (lang, source, feature, bucket, n) of rows (lang, source, counts) that pass the base rules.

    A row is a bucket and how many documents lie in it; a merged sketch is the sum by bucket.
    """
    m = _at(F.col("counts"))
    pairs = F.array(*[F.struct(F.lit(f.name).alias("feature"), bucket(f.value(m)).alias("bucket")) for f in FEATURES])
    return (rows.where(~base_failed(m)).select("lang", "source", F.explode(pairs).alias("x"))
            .groupBy("lang", "source", "x.feature", "x.bucket").agg(F.count("*").alias("n")))


def merged(sketch: DataFrame) -> DataFrame:
    """Sketches at three levels: 0 of each language and source, 1 of each language, 2 of all."""
    level = sketch.withColumn("level", F.explode(F.array(F.lit(0), F.lit(1), F.lit(2))))
    return (level.groupBy("level", F.when(F.col("level") < 2, F.col("lang")).alias("lang"),
                          F.when(F.col("level") < 1, F.col("source")).alias("source"), "feature", "bucket")
            .agg(F.sum("n").alias("n")))


def fences(sketch: DataFrame, group_rows: int = GROUP_ROWS, reach: int = REACH) -> DataFrame:
    """Per (lang, source) of the sketches: a column ``low`` and ``high`` of (feature: fence) structs.

    A group of fewer than ``group_rows`` documents has the fences of its language, or of all if
    that has fewer too.  No table here grows with the documents, only with the groups.
    """
    own = ["level", "lang", "source", "feature"]
    total = F.sum("n").over(Window.partitionBy(*own))
    below = F.sum("n").over(Window.partitionBy(*own).orderBy("bucket"))
    sums = merged(sketch).select(*own, "bucket", total.alias("rows"), below.alias("below"))
    at = lambda k: F.min(F.when(4 * F.col("below") >= k * F.col("rows"), F.col("bucket")))
    quartiles = sums.groupBy(*own, "rows").agg(at(1).alias("q1"), at(3).alias("q3"))
    sides = []
    for f in FEATURES:
        mine = F.col("feature") == f.name
        out = reach * F.greatest(F.col("q3") - F.col("q1"), F.lit(f.spread))
        sides += [F.max(F.when(mine, F.col("q1") - out)).alias(f"low_{f.name}"),
                  F.max(F.when(mine, F.col("q3") + out)).alias(f"high_{f.name}")]
    levels = quartiles.groupBy("level", "lang", "source").agg(F.max("rows").alias("rows"), *sides)
    language = F.sum("rows").over(Window.partitionBy("lang"))
    groups = levels.where("level = 0").select("lang", "source", "rows", language.alias("language"))
    level = F.when(F.col("rows") >= group_rows, 0).when(F.col("language") >= group_rows, 1).otherwise(2)
    wanted = groups.select(F.col("lang").alias("_lang"), F.col("source").alias("_source"), level.alias("_level"))
    return (wanted.join(levels, (F.col("_level") == F.col("level"))
                        & F.when(F.col("_level") < 2, F.col("_lang")).eqNullSafe(F.col("lang"))
                        & F.when(F.col("_level") < 1, F.col("_source")).eqNullSafe(F.col("source")))
            .drop("lang", "source", "rows", "level").withColumnsRenamed({"_lang": "lang", "_source": "source"}))


def _joined(rows: DataFrame, counts: str, lang: str, source: str, limits: DataFrame) -> tuple[DataFrame, Column]:
    """``rows`` with the fences of their group, and the first rule that each row breaks, or null."""
    names = {c: unused(rows, f"_{c}") for c in limits.columns}
    limits = limits.withColumnsRenamed(names)
    joined = rows.join(limits, F.col(lang).eqNullSafe(F.col(names["lang"]))
                       & F.col(source).eqNullSafe(F.col(names["source"])), "left")
    m = _at(F.col(counts))
    reason = F.when(base_failed(m), F.lit("base"))
    for f in FEATURES:
        value = f.value(m)
        beyond = value > F.col(names[f"high_{f.name}"])
        if f.low:
            beyond = beyond | (value < F.col(names[f"low_{f.name}"]))
        reason = reason.when(beyond, F.lit(f.name))
    return joined, reason


def _groups(docs: DataFrame) -> DataFrame:
    return docs.select(*(F.col(c).cast("string").alias(c) for c in ("lang", "source")),
                       _measures(F.col("text").cast("string")).alias("counts"))


def quality_rules(docs: DataFrame, group_rows: int = GROUP_ROWS, reach: int = REACH) -> DataFrame:
    """One row per document: doc_id, the measures, base_failed, kept, reason.

    ``reason`` is the first rule that rejects the document: ``base`` (fewer than 20 words, or more
    than 30 % of them in repeated windows), or the feature that lies beyond a fence of the
    document's language and source; null for a document that is kept.  Null and empty texts have
    no words and fail the base.  A null language or source is a group of its own.  Repeated rows
    count and are judged each for themselves, null ids too; an empty table gives no rows and
    further columns are not read.  Texts are read once; what is stored and joined is their counts.
    """
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text", "lang", "source")
    rows = kept(rows.select("doc_id", *(F.col(c).cast("string").alias(c) for c in ("lang", "source")),
                            _measures(F.col("text").cast("string")).alias("counts")), "measures")
    joined, reason = _joined(rows, "counts", "lang", "source", fences(sketches(rows), group_rows, reach))
    m = _at(F.col("counts"))
    return joined.select("doc_id", *[m[c].alias(c) for c in COUNTS], base_failed(m).alias("base_failed"),
                         reason.isNull().alias("kept"), reason.alias("reason"))


def passing(docs: DataFrame, group_rows: int = GROUP_ROWS, reach: int = REACH) -> DataFrame:
    """The documents, in all their columns, that no rule rejects."""
    limits = fences(sketches(_groups(docs)), group_rows, reach)
    counts, lang, source = (unused(docs, c) for c in ("_counts", "_lang", "_source"))
    rows = docs.withColumns({counts: _measures(F.col("text").cast("string")), lang: F.col("lang").cast("string"),
                             source: F.col("source").cast("string")})
    joined, reason = _joined(rows, counts, lang, source, limits)
    return joined.where(reason.isNull()).select(*docs.columns)
