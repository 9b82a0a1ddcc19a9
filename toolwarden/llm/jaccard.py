"""Exact Jaccard links of documents on five-word shingles, and their connected components.

Equal sets are one class.  Classes meet in an inverted index on prefixes: a set's shingles are
ordered by hash, with the corpus' most frequent ones last, and only as many first ones are
indexed as two similar sets must share one of.  An index entry holds the set's size and the
shingle's position, and both skip: two entries can only belong to similar sets if
``9 * min(size - position) >= 4 * (size + size')`` (for similarity 4/5), so whole blocks of a
list (by size class, and entries too far back to be the smaller partner) are never compared.

Lists of more than two sets are answered through set relations.  The set with the fewest shingles
of its own leads its list (one set leads nearly all lists of a group), and every
other set is compared with the leader alone.  What that comparison brings is the set's answer,
if the two are similar, and its difference from the leader.  All else is derived from the
differences: two sets of which one is not similar to the leader can only be similar if they share
differences, at least ``(d + d' - (size + size') / 9) / 2`` of them.  So the differences are an
index of their own, again on prefixes with the rarest first and skipped by position, and only
sets that meet there and are of different components by then are compared: first with the first
of their list, then what is left.  In lists of a few sets, where a leader decides little, those
left open are compared directly.  Before any text is moved, a pair's signatures (parities of
their shingles) must allow the similarity.  Nothing is capped; every comparison counts whole sets.

The text is tokenised in numpy inside its task; what is shuffled are index entries, and one text
of each class that has a candidate (deflated, a third of the bytes of its set).
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import arrays
from .graph import components
from .storage import dropped, kept, unused

#: Similar from 80 percent: the intersection has at least 4/9 of both sizes' sum.
PERCENT = 80
#: Frequent shingles that come last in every prefix; a longer list changes speed, no result.
FREQUENT = 1 << 18
FREQUENT_FROM = 16
#: A task reports a shingle as frequent from this count, and forgets the rarest beyond TASK_COUNTED.
TASK_FROM = 3
TASK_COUNTED = 1 << 20
#: Lists of two are one pair.  In longer ones every entry is compared with a leader, and what that leaves open
#: entry by entry up to SMALL_LIST entries, through differences from the leader beyond.
SHORT_LIST = 2
SMALL_LIST = 16
#: Words of a set's signature: each shingle flips one of so many times 64 bits.
SIGNATURE = 8
_SIGNS = [f"s{k}" for k in range(SIGNATURE)]
#: The filter that keeps texts without a candidate out of the shuffle has sixteen bits for each of them, so many at least and at most.
FILTER_BITS = 1 << 23
MOST_FILTER_BITS = 1 << 30


def _sets(batch: pa.RecordBatch, text: int = 1) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """By piece of a batch: its row range, and the sorted distinct shingles of its rows."""
    offsets, data = arrays.utf8(batch.column(text))
    for low, high in arrays.pieces(offsets):
        found = arrays.words(offsets[low:high + 1] - offsets[low], data[offsets[low]:offsets[high]])
        bounds, value = arrays.shingle_sets(found, high - low)
        yield low, high, bounds, value


def _class_ids(bounds: np.ndarray, value: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each set, from the sum of its mixed shingles and its size."""
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(arrays.mix(value ^ np.uint64(0xA0761D6478BD642F)))])
    return arrays.mix(total[bounds[1:]] - total[bounds[:-1]] + np.diff(bounds).astype(np.uint64) * np.uint64(0xE7037ED1A0B428DB))


def _signatures(bounds: np.ndarray, value: np.ndarray) -> np.ndarray:
    """Parities of each set's shingles by place, SIGNATURE 64-bit words a row.

    Two signatures differ in no more bits than the two sets have shingles that only one of them holds.
    """
    rows, bits = len(bounds) - 1, 64 * SIGNATURE
    row = np.repeat(np.arange(rows), np.diff(bounds))
    place = (arrays.mix(value) % np.uint64(bits)).astype(np.int64)
    odd = np.bincount(row * bits + place, minlength=rows * bits).astype(np.uint8) & 1
    return np.packbits(odd.reshape(rows, bits), axis=1, bitorder="little").view(np.int64)


def _prefix(size: np.ndarray) -> np.ndarray:
    """How many first shingles of a set are indexed: all but as many as any similar set can miss."""
    return np.where(size > 0, size - (4 * size + 4) // 5 + 1, 0)


def _ranks(bounds: np.ndarray, value: np.ndarray, frequent: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each shingle's position in its set's order (frequent ones last), and whether it is frequent."""
    at = np.searchsorted(frequent, value)
    at[at == len(frequent)] = 0
    late = frequent[at] == value if len(frequent) else np.zeros(len(value), bool)
    row = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
    ahead = np.concatenate([[0], np.cumsum(~late)])
    early = ahead[:-1] - ahead[bounds[:-1]][row]
    behind = np.arange(len(value)) - bounds[:-1][row] - early
    return np.where(late, ahead[bounds[1:]][row] - ahead[bounds[:-1]][row] + behind, early), late


def _sketch(docs: DataFrame) -> DataFrame:
    """A row per document (doc_id, n_shingles, class) and, with ``seen`` set, a row per shingle frequent in a task."""
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        value_of, count_of = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        waiting: list[np.ndarray] = []

        def add_up(least: int) -> None:
            nonlocal value_of, count_of
            every = np.concatenate([value_of, *waiting])
            weight = np.concatenate([count_of, np.ones(len(every) - len(value_of), np.int64)])
            waiting.clear()
            value_of, back = np.unique(every, return_inverse=True)
            count_of = np.bincount(back, weight, minlength=len(value_of)).astype(np.int64)
            value_of, count_of = value_of[count_of >= least], count_of[count_of >= least]

        none = lambda n, t: pa.nulls(n, t)
        names = ["doc_id", "n_shingles", "class", "shingle", "seen", "key", *_SIGNS]
        for batch in batches:
            for low, high, bounds, value in _sets(batch):
                size = np.diff(bounds)
                waiting.append(value)
                yield pa.record_batch([batch.column(0).slice(low, high - low), pa.array(size.astype(np.int64)),
                                       arrays.long(_class_ids(bounds, value)), none(high - low, pa.int64()),
                                       none(high - low, pa.int64()), batch.column(2).slice(low, high - low),
                                       *map(pa.array, np.ascontiguousarray(_signatures(bounds, value).T))], names=names)
            if len(value_of) + sum(map(len, waiting)) > TASK_COUNTED:
                add_up(1)
                if len(value_of) > TASK_COUNTED // 2:
                    value_of, count_of = value_of[count_of > 1], count_of[count_of > 1]
        add_up(TASK_FROM)
        n = len(value_of)
        yield pa.record_batch([none(n, pa.int64()), none(n, pa.int64()), none(n, pa.int64()), arrays.long(value_of),
                               pa.array(count_of), none(n, pa.string()), *[none(n, pa.int64())] * SIGNATURE], names=names)

    return docs.withColumn("key", _key()).mapInArrow(
        scan, "doc_id bigint, n_shingles bigint, class bigint, shingle bigint, seen bigint, key string, "
              + ", ".join(f"{c} bigint" for c in _SIGNS))


ENTRY = "shingle bigint, class bigint, size int, place int"


def _index(docs: DataFrame, frequent: np.ndarray, late_: bool) -> DataFrame:
    """The prefix entries of every document, of frequent shingles or of all others: shingle, class, size, place."""
    sent = docs.sparkSession.sparkContext.broadcast(frequent)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for low, high, bounds, value in _sets(batch):
                size = np.diff(bounds)
                row = np.repeat(np.arange(high - low), size)
                rank, late = _ranks(bounds, value, sent.value)
                own = (rank < _prefix(size)[row]) & (late == late_)
                row = row[own]
                yield pa.record_batch([arrays.long(value[own]), arrays.long(_class_ids(bounds, value)[row]),
                                       pa.array(size[row].astype(np.int32)), pa.array(rank[own].astype(np.int32))], names=["shingle", "class", "size", "place"])

    return docs.mapInArrow(scan, ENTRY)


def _possible(n: np.ndarray, i: np.ndarray, m: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Whether sets of sizes n <= m that first meet at positions i and j can be similar."""
    return (5 * n >= 4 * m) & (9 * np.minimum(n - i, m - j) >= 4 * (n + m))


PAIR = "shingle bigint, a bigint, b bigint, size int, place int"


def _short_lists(entries: DataFrame) -> DataFrame:
    """From sorted lists: candidate pairs (a, b), and the entries of long lists (b null)."""
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["shingle", "a", "b", "size", "place"]
        types = [pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32()]
        held = [np.zeros(0, t) for t in (np.int64, np.int64, np.int32, np.int32)]

        def lists(columns: list[np.ndarray]) -> pa.RecordBatch:
            shingle, ids, size, place = columns
            fresh = np.ones(len(shingle), bool)
            fresh[1:] = (shingle[1:] != shingle[:-1]) | (ids[1:] != ids[:-1])
            shingle, ids, size, place = (c[fresh] for c in columns)
            start = np.flatnonzero(np.append(True, shingle[1:] != shingle[:-1])) if len(shingle) else np.zeros(0, np.int64)
            length = np.diff(np.append(start, len(shingle)))
            of = np.repeat(length, length)
            long_ = of > SHORT_LIST
            out = [[shingle[long_]], [ids[long_]], [], [size[long_]], [place[long_]]]
            short = ~long_ & (of > 1)
            shingle, ids, size, place = (c[short] for c in (shingle, ids, size, place))
            firsts, seconds = [], []
            n, i = size.astype(np.int64), place.astype(np.int64)
            for step in range(1, min(SHORT_LIST, len(shingle))):
                x = np.flatnonzero(shingle[step:] == shingle[:-step])
                if not x.size:
                    break
                x = x[_possible(n[x], i[x], n[x + step], i[x + step])]
                firsts.append(ids[x])
                seconds.append(ids[x + step])
            a = np.concatenate(firsts) if firsts else np.zeros(0, np.int64)
            b = np.concatenate(seconds) if seconds else a
            low, high = np.minimum(a, b), np.maximum(a, b)
            both = np.unique(np.stack([low, high], axis=1), axis=0) if len(a) else np.zeros((0, 2), np.int64)
            m, k = len(both), int(long_.sum())
            cat = lambda x, own, t: pa.concat_arrays([pa.array(x, t), own])
            return pa.record_batch([
                cat(out[0][0], pa.nulls(m, types[0]), types[0]), cat(out[1][0], pa.array(both[:, 0]), types[1]),
                cat([None] * k, pa.array(both[:, 1]), types[2]), cat(out[3][0], pa.nulls(m, types[3]), types[3]),
                cat(out[4][0], pa.nulls(m, types[4]), types[4])], names=names)

        for batch in batches:
            columns = [np.concatenate([h, c.to_numpy(zero_copy_only=False)]) for h, c in zip(held, batch.columns)]
            # The last list may go on in the next batch.
            cut = int(np.searchsorted(columns[0], columns[0][-1])) if len(columns[0]) else 0
            held = [c[cut:] for c in columns]
            if cut:
                yield lists([c[:cut] for c in columns])
        yield lists(held)

    ordered = (entries.select("shingle", "class", "size", "place").repartition("shingle")
               .sortWithinPartitions("shingle", "size", "class"))
    return ordered.mapInArrow(scan, PAIR)


def _fits(n: str, i: str, m: str, j: str) -> Column:
    """_possible() as a column, for sizes in either order."""
    low, high = F.least(n, m), F.greatest(n, m)
    return (5 * low >= 4 * high) & (9 * F.least(F.col(n) - F.col(i), F.col(m) - F.col(j)) >= 4 * (F.col(n) + F.col(m)))


def _size_class(size: Column) -> Column:
    """Sets of similar size are in the same class or in adjacent ones."""
    return F.floor(F.log(size) / np.log(1.25)).cast("int")


def _filter(ids: DataFrame) -> np.ndarray:
    """A bitmap with a bit set for every id; never without one of them, and of at most 128 MB."""
    bits = min(MOST_FILTER_BITS, max(FILTER_BITS, 1 << (16 * ids.count()).bit_length()))
    place = F.pmod(F.xxhash64("id"), F.lit(bits))
    words = (ids.select(place.alias("p")).select(F.shiftright("p", 6).alias("w"), F.expr("shiftleft(1L, cast(p % 64 AS int))").alias("b"))
             .groupBy("w").agg(F.bit_or("b").alias("b")).toArrow())
    out = np.zeros(bits // 64, np.int64)
    out[words.column(0).to_numpy()] = words.column(1).to_numpy()
    return out


def _may_hold(bitmap: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """Which 64-bit hashes of ids the bitmap can't rule out."""
    place = hashes % (len(bitmap) * 64)
    return (bitmap[place >> 6] >> (place & 63)) & 1 == 1


def _chosen_texts(docs: DataFrame, classes: DataFrame) -> DataFrame:
    """(class, text, deflated) of the given classes (class, key); more than one where doc_ids repeat.

    Texts stand in their task's own bytes until they have been chosen, and are moved deflated: Spark's
    codecs leave 0.63 of these texts, this 0.43.
    """
    sent = docs.sparkSession.sparkContext.broadcast(_filter(classes.select(F.col("key").alias("id"))))

    def pick(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            near = batch.filter(pa.array(_may_hold(sent.value, batch.column(2).to_numpy())))
            texts = [None if x is None else zlib.compress(x, 1) for x in near.column(1).cast(pa.binary()).to_pylist()]
            yield pa.record_batch([near.column(0), pa.array(texts, pa.binary())], names=["key", "text"])

    near = (docs.select(_key().alias("key"), "text").withColumn("_hash", F.xxhash64("key"))
            .mapInArrow(pick, "key string, text binary"))
    return near.join(classes, "key").select("class", "text").dropDuplicates(["class", "text"])


def _key() -> Column:
    """What a document's text is fetched by: its id, or a hash of the text where it has none."""
    return F.coalesce(F.col("doc_id").cast("string"), F.concat(F.lit("#"), F.xxhash64("text").cast("string")))


def _text_sets(ids: list[int], column: pa.Array) -> list[tuple[np.ndarray, int]]:
    """The shingle set and the class of each deflated text; of neighbours with one id only the first is taken apart."""
    fresh = [k for k in range(len(ids)) if not k or ids[k] != ids[k - 1] or column[k] != column[k - 1]]
    found = []
    texts = pa.array([zlib.decompress(x) for x in column.take(pa.array(fresh, pa.int64())).to_pylist()], pa.binary()).cast(pa.large_string())
    for _, _, bounds, value in _sets(pa.record_batch([texts], names=["text"]), 0):
        for k, own in enumerate(_class_ids(bounds, value).view(np.int64).tolist()):
            found.append((value[bounds[k]:bounds[k + 1]], own))
    return [found[at] for at in np.searchsorted(fresh, np.arange(len(ids)), side="right") - 1]


COMPARED = "a bigint, b bigint, element bigint, place int, size int, delta int, apart boolean"


def _difference(x: np.ndarray, y: np.ndarray, hits: np.ndarray, apart: bool, frequent: np.ndarray) -> np.ndarray:
    """The first differences of ``y`` from its leader ``x``: as many as a partner's must share one of.

    Ordered with the rarest first: own shingles that are not frequent, then own frequent ones and
    those of the leader that are missing.
    """
    n, lead, shared = len(y), len(x), int(hits.sum())
    own, missing = y[~hits], np.setdiff1d(x, y[hits], assume_unique=True)
    at = np.searchsorted(frequent, own)
    at[at == len(frequent)] = 0
    late = frequent[at] == own if len(frequent) else np.zeros(len(own), bool)
    ordered = np.concatenate([own[~late], np.sort(np.concatenate([own[late], missing]))])
    size = n + lead - 2 * shared
    most = n // 4 + 1 if apart else size - (9 * size + lead - n) // 18
    return ordered[:max(0, min(size, most))]


def _compared(pairs: DataFrame, texts: DataFrame, percent: int, frequent: np.ndarray) -> DataFrame:
    """What whole sets say about pairs (a, b, wanted).

    A row with no element for each pair (a, b) that reaches the similarity; and of each wanted
    pair, b's first differences from its leader a: element, its place, b's size, the number of all
    differences, and whether the two are not similar.
    """
    sent = pairs.sparkSession.sparkContext.broadcast(frequent)
    names = [part.split()[0] for part in COMPARED.split(", ")]
    types = [pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.bool_()]

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for low in range(0, whole.num_rows, 256):
                batch = whole.slice(low, 256)
                ids = [batch.column(k).to_pylist() for k in range(3)]
                out: list[list] = [[] for _ in names]
                both = zip(*ids, _text_sets(ids[0], batch.column(3)), _text_sets(ids[1], batch.column(4)))
                for a, b, wanted, (x, own_x), (y, own_y) in both:
                    if (a, b) != (own_x, own_y):
                        continue
                    at = np.searchsorted(x, y)
                    at[at == len(x)] = 0
                    hits = x[at] == y
                    shared = int(hits.sum())
                    apart = 100 * shared < percent * (len(x) + len(y) - shared)
                    first = _difference(x, y, hits, apart, sent.value).view(np.int64).tolist() if wanted else []
                    n = len(first) + (not apart)
                    rows = [[a] * n, [b] * n, first + [None] * (not apart), list(range(n)), [len(y)] * n,
                            [len(x) + len(y) - 2 * shared] * n, [apart] * n]
                    for have, more in zip(out, rows):
                        have.extend(more)
                yield pa.record_batch([pa.array(c, t) for c, t in zip(out, types)], names=names)

    left = texts.select(F.col("class").alias("a"), F.col("text").alias("_x"))
    right = texts.select(F.col("class").alias("b"), F.col("text").alias("_y"))
    # Joined with the leader's text last: rows of one leader stand together, and its text is taken apart once.
    return (pairs.join(right, "b").join(left, "a").select("a", "b", "wanted", "_x", "_y").mapInArrow(verify, COMPARED))


def _plausible(pairs: DataFrame, classes: DataFrame) -> DataFrame:
    """The pairs (a, b, wanted) that are wanted or whose signatures allow the similarity.

    Similar sets have at most a ninth of their sizes' sum in shingles that only one holds.
    """
    of = lambda end, mark: classes.select(F.col("class").alias(end), *[F.col(c).alias(f"{mark}{c}") for c in ("size", *_SIGNS)])
    apart = sum((F.bit_count(F.col(f"_x{c}").bitwiseXOR(F.col(f"_y{c}"))) for c in _SIGNS), F.lit(0))
    near = 9 * apart <= F.col("_xsize") + F.col("_ysize")
    return pairs.join(of("a", "_x"), "a").join(of("b", "_y"), "b").where(F.col("wanted") | near).select("a", "b", "wanted")


def _texts_of(docs: DataFrame, pairs: DataFrame, classes: DataFrame) -> DataFrame:
    """(class, text) of both ends of the pairs."""
    ids = pairs.select(F.explode(F.array("a", "b")).alias("class")).distinct()
    asked = kept(ids.join(classes.select("class", "key"), "class"), "asked")
    texts = kept(_chosen_texts(docs, asked), "asked-texts")
    dropped(asked)
    return texts


def _links(compared: DataFrame) -> DataFrame:
    return compared.where("element IS NULL").select("a", "b")


def _parts(links: DataFrame, purpose: str) -> DataFrame:
    return kept(components(links).select(F.col("id").alias("class"), F.col("component").alias("part")), purpose)


def _with_parts(rows: DataFrame, parts: DataFrame) -> DataFrame:
    """``rows`` (class, ...) with the component of their class as ``part``."""
    return rows.join(parts, "class", "left").withColumn("part", F.coalesce("part", "class"))


def _small_lists(small: DataFrame, parts: DataFrame) -> DataFrame:
    """Pairs (a, b) of different components that meet in a short list and can be similar by size and position."""
    rows = _with_parts(small, parts)
    mixed = rows.groupBy("shingle", "block").agg(F.min("part").alias("_l"), F.max("part").alias("_h")).where("_l <> _h")
    rows = rows.join(mixed.select("shingle", "block"), ["shingle", "block"])
    named = lambda names: rows.select("shingle", "block", *[F.col(c).alias(n) for c, n in names.items()])
    left = named({"class": "a", "size": "_n", "place": "_i", "part": "_p", "own": "_o"})
    right = named({"class": "b", "size": "_m", "place": "_j", "part": "_q", "own": "_w"})
    # Two that are both guests of a block meet in their own.
    meet = (F.col("a") < F.col("b")) & (F.col("_p") != F.col("_q")) & (F.col("_o") | F.col("_w")) & _fits("_n", "_i", "_m", "_j")
    return left.join(right, ["shingle", "block"]).where(meet).select("a", "b").distinct()


def _derivable(d: str, i: str, n: str, e: str, j: str, m: str) -> Column:
    """Whether sets of sizes n and m with d and e differences, meeting at places i and j of them, can be similar."""
    sizes = 5 * F.least(n, m) >= 4 * F.greatest(n, m)
    enough = 18 * F.least(F.col(d) - F.col(i), F.col(e) - F.col(j)) >= 9 * (F.col(d) + F.col(e)) - F.col(n) - F.col(m)
    return sizes & enough & (9 * F.abs(F.col(d) - F.col(e)) <= F.col(n) + F.col(m))


def _open_links(small: DataFrame, differences: DataFrame, links: DataFrame, pairs: DataFrame, docs: DataFrame, classes: DataFrame) -> DataFrame:
    """All links that ``small`` lists and lists of shared differences add to ``links``, at least between components.

    ``small`` has (shingle, block, class, size, place, own), ``differences`` (leader, element, class,
    place, size, delta, apart).  Of each list of differences the first set that is apart from the
    leader is compared with all others; then what is still of different components is compared
    pair by pair.  ``pairs`` have been compared.
    """
    list_ = ["leader", "element"]

    def verified(asked: DataFrame) -> DataFrame:
        texts = _texts_of(docs, asked, classes)
        found = kept(_links(_compared(asked, texts, PERCENT, np.zeros(0, np.uint64))), "similar")
        dropped(texts)
        return found

    def opened(parts: DataFrame) -> DataFrame:
        rows = _with_parts(differences, parts)
        mixed = (rows.groupBy(*list_).agg(F.min("part").alias("_l"), F.max("part").alias("_h"), F.bool_or("apart").alias("_a"))
                 .where("_a AND _l <> _h").select(*list_))
        return rows.join(mixed, list_)

    def sides(x: DataFrame, y: DataFrame) -> DataFrame:
        named = lambda df, names: df.select(*list_, *[F.col(c).alias(n) for c, n in names.items()])
        left = named(x, {"class": "a", "delta": "_d", "place": "_i", "size": "_n", "part": "_p"})
        right = named(y, {"class": "b", "delta": "_e", "place": "_j", "size": "_m", "part": "_q", "apart": "_f"})
        # Two sets that are both apart meet twice; one meeting is enough.
        meet = (F.col("_p") != F.col("_q")) & (F.col("a") != F.col("b")) & _derivable("_d", "_i", "_n", "_e", "_j", "_m")
        return left.join(right, list_).where(meet).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"),
                                                          (~F.col("_f") | (F.col("a") < F.col("b"))).alias("_once"))

    parts = _parts(links, "parts")
    rows = kept(opened(parts), "differences")
    columns = ["class", "delta", "place", "size", "part", "apart"]
    first = (rows.where("apart").groupBy(*list_).agg(F.min(F.struct("place", *[c for c in columns if c != "place"])).alias("_l"))
             .select(*list_, *[F.col(f"_l.{c}").alias(c) for c in columns]))
    star = (sides(first, rows).select("a", "b").unionByName(_small_lists(small, parts)).distinct()
            .join(pairs, ["a", "b"], "left_anti").withColumn("wanted", F.lit(False)))
    star = kept(_plausible(star, classes), "second-pairs")
    more = links.unionByName(verified(star))
    dropped(rows, parts)
    rows = kept(opened(_parts(more, "second-parts")), "open-differences")
    rest = sides(rows.where("apart"), rows).where("_once").select("a", "b").distinct().join(star, ["a", "b"], "left_anti")
    rest = kept(_plausible(rest.withColumn("wanted", F.lit(False)), classes), "open-pairs")
    return more.unionByName(verified(rest))


def jaccard_components(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id, copies.

    Two documents link from a Jaccard similarity of 0.8 on their sets of five-word shingles (a
    shorter text has its whole sequence as one).  ``component_id`` is the smallest doc_id that
    links lead to, the document's own included; ``copies`` counts documents of the same set.
    Null and empty texts, or texts without words, have 0 shingles and link with nothing.
    Rows link by their texts: a repeated doc_id has each row's own component, and rows of a null
    doc_id link like any other; the component is null if no row in it has an id.  Further columns
    are not read.
    """
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    sketch = kept(_sketch(docs), "sketch")
    top = (sketch.where("seen IS NOT NULL").groupBy("shingle").agg(F.sum("seen").alias("n"))
           .where(F.col("n") >= FREQUENT_FROM).orderBy(F.desc("n"), "shingle").limit(FREQUENT).collect())
    frequent = np.sort(np.array([r.shingle for r in top], np.int64).view(np.uint64))
    rows = sketch.where("seen IS NULL").select("doc_id", "n_shingles", "class", "key", *_SIGNS)
    # A class is fetched by one of its documents, if it can by one with an id.
    classes = kept(rows.where("n_shingles > 0").groupBy("class").agg(
        F.min("doc_id").alias("doc_id"), F.min(F.struct(F.col("doc_id").isNull(), F.col("key")))["key"].alias("key"),
        F.count("*").alias("copies"), F.max("n_shingles").alias("size"), *[F.max(c).alias(c) for c in _SIGNS]), "classes")
    short = kept(_short_lists(_index(docs, frequent, False)), "short-lists")
    pairs = short.where("b IS NOT NULL").select("a", "b").distinct()

    # Lists of frequent shingles, and long ones: each class once, in blocks by size.
    late = kept(_index(docs, frequent, True), "frequent-lists")
    listed = (late.unionByName(short.where("b IS NULL").select("shingle", F.col("a").alias("class"), "size", "place"))
              .groupBy("shingle", "class").agg(F.min("size").alias("size"), F.min("place").alias("place")))
    # Before its first frequent shingle a set has only its own: the set with the smallest share of
    # these leads: one set for nearly all lists of a group, and the one that most others come from.
    alone = late.groupBy("class").agg(F.min(F.floor(1024 * F.col("place") / F.col("size"))).alias("alone"))
    listed = kept(listed.join(alone, "class", "left").withColumn("alone", F.coalesce("alone", F.lit(1024)))
                  .withColumn("block", _size_class(F.col("size"))), "long-lists")
    leaders = kept(listed.groupBy("shingle", "block").agg(F.min(F.struct("alone", "class", "size", "place")).alias("_l"))
                   .select("shingle", "block", F.col("_l.class").alias("leader"), F.col("_l.size").alias("_m"),
                           F.col("_l.place").alias("_j")), "leaders")
    # Entries that can be the smaller partner's are also in the list of the next block.
    ahead = 9 * (F.col("size") - F.col("place")) >= 8 * F.col("size")
    members = listed.withColumn("own", F.lit(True)).unionByName(
        listed.where(ahead).withColumn("block", F.col("block") + 1).withColumn("own", F.lit(False))).select(
        "shingle", "block", "class", "size", "place", "own")
    led = members.join(leaders, ["shingle", "block"]).where(F.col("class") != F.col("leader"))
    sizes = members.groupBy("shingle", "block").agg(F.count("*").alias("_c")).where("_c > 2")
    # Differences are wanted in long lists; the leader's own answer, where the two can be similar.
    star = (led.join(sizes, ["shingle", "block"], "left").select(
        F.col("leader").alias("a"), F.col("class").alias("b"), F.coalesce(F.col("_c") > SMALL_LIST, F.lit(False)).alias("wanted"),
        _fits("size", "place", "_m", "_j").alias("_fits")).where("wanted OR _fits").select("a", "b", "wanted"))
    pairs = pairs.withColumn("wanted", F.lit(False)).unionByName(star).groupBy("a", "b").agg(F.max("wanted").alias("wanted"))
    pairs = kept(_plausible(pairs, classes), "pairs")
    small = kept(members.join(sizes.where(F.col("_c") <= SMALL_LIST), ["shingle", "block"]).drop("_c"), "small-lists")
    dropped(late, listed, leaders)

    texts = _texts_of(docs, pairs, classes)
    compared = kept(_compared(pairs, texts, PERCENT, frequent), "compared")
    dropped(short, texts)
    differences = compared.where("element IS NOT NULL").select(
        F.col("a").alias("leader"), "element", F.col("b").alias("class"), "place", "size", "delta", "apart")
    links = _open_links(small, differences, _links(compared).distinct(), pairs.select("a", "b"), docs, classes)

    # Components of classes; the smallest doc_id of all their documents names them.
    found = components(links).select(F.col("id").alias("class"), "component")
    dropped(compared, pairs, small)
    named = classes.join(found, "class", "left").withColumn("component", F.coalesce("component", "class"))
    smallest = named.groupBy("component").agg(F.min("doc_id").alias("_component"))
    known = kept(named.join(smallest, "component").select("class", "_component", "copies"), "class-components")
    lonely = rows.where("n_shingles = 0").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"),
                                                 F.lit(1).cast("bigint").alias("copies"))
    return (rows.where("n_shingles > 0").join(known, "class")
            .select("doc_id", "n_shingles", F.col("_component").alias("component_id"), "copies").unionByName(lonely))


def representatives(docs: DataFrame) -> DataFrame:
    """The documents, in all their columns, that stand for their component: those of its smallest doc_id.

    Documents without words link with nothing and all stay.  Rows repeated under one doc_id are
    one document and stay or go together; rows of a null doc_id stay.  Only rows whose id a
    bitmap of fixed size can't rule out are joined with the ids to drop.
    """
    found = jaccard_components(docs)
    drops = kept(found.where("n_shingles > 0 AND component_id <> doc_id").select(F.col("doc_id").alias("id")).distinct(),
                 "near-duplicates")
    sent = docs.sparkSession.sparkContext.broadcast(_filter(drops))
    mark, drop = unused(docs, "_listed"), unused(docs, "_drop")

    @F.arrow_udf("boolean")
    def listed(place: pa.Array) -> pa.Array:
        return pa.array(_may_hold(sent.value, place.to_numpy(zero_copy_only=False)))

    id_ = F.col("doc_id").cast("bigint")
    maybe = F.when(id_.isNull(), F.lit(False)).otherwise(listed(F.xxhash64(id_)))
    marked = docs.withColumn(mark, maybe)
    hits = marked.where(F.col(mark)).drop(mark)
    drops = drops.withColumnRenamed("id", drop)
    return (marked.where(~F.col(mark)).drop(mark)
            .unionByName(hits.join(drops, hits["doc_id"].cast("bigint") == drops[drop], "left_anti")))
