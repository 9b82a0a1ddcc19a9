"""Fuzzy line deduplication over a whole corpus, in DataFrame operations only.

Lines are normalised to their lower-case words.  Equal lines collapse by aggregation.  Two lines
link if the edit similarity of their words is 0.8 or more, and every such pair is found.  An edit
touches at most two of a line's pairs of neighbouring words, so of any fixed order of such pairs a
prefix of both lines (two pairs for each edit allowed, and one or two more) shares one.  The order
is longest words first, which needs no table of frequencies.  Lines of so few words that one edit
is allowed meet by what is left of them without one word.  Listings that stand alone leave in the
task that counts them.  Candidates must be near in length and in a parity sketch of 128 bits (long
lines: also of 512), in which an edit changes at most two, and are verified by edit distance.

All lines of a listing are first held against its leader alone (the smallest hash), and lines
linked by then are one group that is not compared again; the join only leaves pairs of different
groups.  Of each connected group the occurrence with the smallest document id, and in it the first
line, stays.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .graph import components
from .storage import dropped, kept, unused

#: Bits in which the SimHashes of linked lines may differ: all, as edit similarity alone decides.
RADIUS = 64
#: Least edit similarity, in percent of the longer line's words.
PERCENT = 80
#: Lines of fewer words link with equal lines only.
LEAST_WORDS = 4
#: Two lines of at most so many words may differ by one edit.
ONE_EDIT = 9
#: Least words of a line that may link with one of more than ONE_EDIT words.
PAIR_WORDS = 8
#: Lines from so many words on, whose parities of 128 bits say little, also have parities of WIDE times 64 bits.
LONG_WORDS = 100
WIDE = 8
_WIDE = [f"w{j}" for j in range(WIDE)]
#: What is compared of two lines before their texts.
_NARROW = ("size", "s0", "s1")
#: Words that one set of byte lanes counts.
LANE_WORDS = 127
_LANES = 0x0101010101010101
#: Rows of a list of wanted or of much repeated lines up to which it is broadcast (16 MB); a longer one is joined by a shuffle.
WANTED_ROWS = 1 << 19
#: Open listings are joined in slices, one after the other, of about so many occurrences of lines, at most SLICES.
SLICE_LINES = 1 << 18
SLICES = 16

_NOT_WORD = r"[\s\p{Punct}]+"


def words_of(line: Column) -> Column:
    """The words of a line: lower case, without ASCII punctuation."""
    return F.array_remove(F.split(F.lower(line), _NOT_WORD), "")


def coded(line: Column) -> Column:
    """The words of a line as text of two characters per word, so that Levenshtein counts words."""
    unit = lambda v: F.lpad(F.hex(F.pmod(v, F.lit(0xC000)) + 0x100), 4, "0")
    each = F.transform(words_of(line), lambda w: F.concat(unit(F.xxhash64(w)), unit(F.shiftright(F.xxhash64(w), 32))))
    return F.decode(F.unhex(F.array_join(each, "")), "UTF-16BE")


def _key(docs: DataFrame) -> Column:
    """A row's identity: rows repeated with id and text are one document."""
    return F.xxhash64(docs["doc_id"].cast("bigint"), docs["text"].cast("string"))


def _counted(hashes: Column) -> Column:
    """Eight numbers whose byte lanes count the hashes' bits: lane l of number j has bit 8 * l + j."""
    none = F.struct(*[F.lit(0).cast("bigint").alias(f"s{j}") for j in range(8)])
    return F.aggregate(hashes, none, lambda a, h: F.struct(*[
        (a[f"s{j}"] + F.shiftrightunsigned(h, j).bitwiseAND(F.lit(_LANES))).alias(f"s{j}") for j in range(8)]))


def _majority(counts: Column, n_words: Column) -> Column:
    """The SimHash from a list of counted lanes: each bit that more than half of the words have."""
    lane = lambda c, place: F.shiftright(c[f"s{place % 8}"], 8 * (place // 8)).bitwiseAND(F.lit(127))
    bit = lambda total, place: F.when(2 * total > n_words, F.lit(1 << place if place < 63 else -(1 << 63))).otherwise(F.lit(0))

    def all_bits(total) -> Column:
        out = F.lit(0).cast("bigint")
        for place in range(64):
            out = out.bitwiseOR(bit(total(place), place))
        return out

    whole = lambda place: F.aggregate(counts, F.lit(0).cast("bigint"), lambda a, c: a + lane(c, place))
    return F.when(F.size(counts) == 1, all_bits(lambda place: lane(F.element_at(counts, 1), place))).otherwise(all_bits(whole))


def _words(docs: DataFrame) -> DataFrame:
    """A row per line with words: doc_id, key, pos, w."""
    lines = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), _key(docs).alias("key"),
                        F.posexplode(F.split(docs["text"].cast("string"), "\n")).alias("pos", "line"))
    return lines.select("doc_id", "key", "pos", words_of(F.col("line")).alias("w")).where(F.size("w") > 0)


def simhashed(docs: DataFrame) -> DataFrame:
    """A row per line with words: doc_id, key, pos, h1, h2 (of its words), size (their number), print."""
    words = _words(docs).select("doc_id", "key", "pos", *_identity(), F.transform("w", lambda w: F.xxhash64(w)).alias("_h"))
    parts = F.transform(F.sequence(F.lit(1), F.size("_h"), F.lit(LANE_WORDS)), lambda k: _counted(F.slice("_h", k, LANE_WORDS)))
    # A generator keeps the counts from being worked out again for every bit.
    counted = words.select("doc_id", "key", "pos", "h1", "h2", "size", F.explode(F.array(parts)).alias("_c"))
    return counted.select("doc_id", "key", "pos", "h1", "h2", "size", _majority(F.col("_c"), F.col("size")).alias("print"))


def _identity() -> list[Column]:
    return [F.xxhash64("w").alias("h1"), F.xxhash64(F.lit(17), "w").alias("h2"), F.size("w").cast("bigint").alias("size")]


def sketched(docs: DataFrame) -> DataFrame:
    """A row per line with words: doc_id, key, pos, h1, h2, size, s0 and s1 (parities), w0 to w7 (of long lines)."""
    words = _words(docs).select("doc_id", "key", "pos", *_identity(), F.explode(F.array(F.transform("w", lambda w: F.xxhash64(w)))).alias("_h"))
    none = F.lit(0).cast("bigint")
    one = lambda h: F.call_function("shiftleft", F.lit(1).cast("bigint"), h.bitwiseAND(F.lit(63)).cast("int"))
    part = lambda mask, j: F.aggregate("_h", none, lambda a, h: F.when(
        h.bitwiseAND(F.lit(mask)) == 64 * j, a.bitwiseXOR(one(h))).otherwise(a))
    wide = [F.when(F.col("size") >= LONG_WORDS, part(64 * (WIDE - 1), j)).alias(c) for j, c in enumerate(_WIDE)]
    return words.select("doc_id", "key", "pos", "h1", "h2", "size", part(64, 0).alias("s0"), part(64, 1).alias("s1"), *wide)


def _prefix(size: Column) -> Column:
    """Pairs at the start of the order of which similar lines share one.

    Lines of n <= m words with e = floor(m / 5) edits share m - 1 - 2e of their n - 1 and m - 1
    pairs: one is in the first 2e + 1 of the longer, and in the first 2e + 1 - (m - n) of the
    shorter; for all m the latter are at most 2 * floor(n / 5) + 1, or one more if n + 1 gives an edit more.
    """
    edits = lambda n: F.floor(n * (100 - PERCENT) / 100)
    return (edits(size) + edits(size + 1) + 1).cast("int")


def _listed(docs: DataFrame, repeated: DataFrame) -> DataFrame:
    """(word, id), a row for each listing of a line (its h1); of ``repeated`` lines (id, _key, _pos) one occurrence is listed."""
    rank = lambda w: F.shiftleft(63 - F.least(F.length(w), F.lit(63)).cast("bigint"), 57).bitwiseOR(
        F.shiftrightunsigned(F.xxhash64(w), 7))
    words = _words(docs).where(F.size("w") >= LEAST_WORDS).select(F.xxhash64("w").alias("id"), "key", "pos", "w")
    words = (words.join(F.broadcast(repeated), "id", "left")
             .where("_key IS NULL OR (_key = key AND _pos = pos)").select("id", F.explode(F.array(F.transform("w", rank))).alias("_r")))
    n = F.size("_r")
    length = lambda x: F.shiftrightunsigned(x, 57)
    pairs = F.zip_with(F.slice("_r", F.lit(1), n - 1), F.slice("_r", F.lit(2), n - 1), lambda x, y: F.shiftleft(
        length(x) + length(y), 56).bitwiseOR(F.shiftrightunsigned(F.xxhash64(x, y), 8)))
    first = F.slice(F.sort_array(pairs), F.lit(1), _prefix(n))
    less = F.transform(F.sequence(F.lit(1), n), lambda i: F.xxhash64(F.concat(F.slice("_r", F.lit(1), i - 1), F.slice("_r", i + 1, n))))
    none = F.array().cast("array<bigint>")
    each = F.when(n > ONE_EDIT, first).otherwise(F.concat(
        F.when(n >= PAIR_WORDS, first).otherwise(none), less, F.array(F.xxhash64("_r"))))
    return words.select("id", F.explode(F.array_distinct(each)).alias("word"))


def _near(sketch: tuple[str, ...]) -> Column:
    """Whether the sketches of two lines (columns with prefixes _x and _y) allow as few edits as the similarity does."""
    apart = sum((F.bit_count(F.col(f"_x{c}").bitwiseXOR(F.col(f"_y{c}"))) for c in sketch), F.lit(0))
    return F.coalesce(apart <= 2 * F.floor(F.greatest("_xsize", "_ysize") * (100 - PERCENT) / 100), F.lit(True))


def _lengths(a: str, b: str) -> Column:
    return 100 * F.least(a, b) >= PERCENT * F.greatest(a, b)


def _texts(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """(id, coded words as norm) of the wanted lines (id, key, pos), read from the documents they stand in."""
    if wanted.count() <= WANTED_ROWS:
        wanted = F.broadcast(wanted)
    own = docs.select(_key(docs).alias("key"), F.col("text").cast("string").alias("text"))
    found = own.join(wanted, "key").select("id", coded(F.element_at(F.split("text", "\n"), F.col("pos") + 1)).alias("norm"))
    return found.groupBy("id").agg(F.first("norm").alias("norm"))


def _verified(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """The pairs (a, b) whose word sequences have the edit similarity.

    Each letter that only one text has takes an edit, so long texts with too many leave before the edit distance.
    """
    most = F.floor(F.greatest(F.length("_x"), F.length("_y")) * (100 - PERCENT) / 100)
    return (pairs.join(texts.select(F.col("id").alias("a"), F.col("norm").alias("_x")), "a")
            .join(texts.select(F.col("id").alias("b"), F.col("norm").alias("_y")), "b")
            .withColumn("_most", most.cast("int"))
            .where("(length(_x) < 256 OR size(array_except(split(_x, ''), split(_y, ''))) <= _most) AND levenshtein(_x, _y, _most) >= 0")
            .select("a", "b"))


def line_groups(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Stored occurrences (doc_id, key, pos, h1, h2), and of each repeated or linked line the one to keep."""
    sketches = kept(sketched(docs), "line-sketches")
    lines = kept(sketches.groupBy("h1", "h2").agg(
        F.min(F.struct("doc_id", "key", "pos")).alias("where"), F.count("*").alias("n"), F.max("size").alias("size"),
        *[F.max(c).alias(c) for c in ("s0", "s1", *_WIDE)]), "distinct-lines")
    seen = kept(sketches.select("doc_id", "key", "pos", "h1", "h2"), "line-occurrences")
    dropped(sketches)
    count = seen.count()
    # Fewer than WANTED_ROWS lines can stand more often than this; others are listed with all their occurrences.
    often = max(1, count // WANTED_ROWS)
    slices = min(SLICES, 1 + count // SLICE_LINES)
    where = lines.select(F.col("h1").alias("id"), "where.key", "where.pos")
    repeated = (lines.where((F.col("n") > often) & (F.col("size") >= LEAST_WORDS)).groupBy(F.col("h1").alias("id"))
                .agg(F.min("where").alias("_w")).select("id", F.col("_w.key").alias("_key"), F.col("_w.pos").alias("_pos")))
    of = Window.partitionBy("word")
    listed = _listed(docs, repeated).withColumn("leader", F.min("id").over(of)).withColumn("_last", F.max("id").over(of))
    # In the order of slices, so that reading one skips the pages of the others; neighbours of a listing pack well.
    index = kept(listed.where("leader < _last").select(F.pmod(F.xxhash64("word"), F.lit(slices)).cast("int").alias("slice"), "word", "id", "leader")
                 .distinct().sortWithinPartitions("slice", "word"), "line-index")
    traits = lambda end, mark, names, which=F.lit(True): lines.where(which).select(
        F.col("h1").alias(end), *[F.col(c).alias(f"{mark}{c}") for c in names])
    similar = _lengths("_xsize", "_ysize") & _near(("s0", "s1"))

    def wide(pairs: DataFrame) -> DataFrame:
        """The pairs whose wide sketches allow the similarity; lines without one are not held back."""
        names = ("size", *_WIDE)
        long = F.col("size") >= LONG_WORDS
        return (pairs.join(traits("a", "_x", names, long), "a", "left").join(traits("b", "_y", names, long), "b", "left")
                .where(_near(_WIDE)).select("a", "b"))

    star = index.where("id <> leader").select(F.col("leader").alias("a"), F.col("id").alias("b")).distinct()
    star = kept(wide(star.join(traits("a", "_x", _NARROW), "a").join(traits("b", "_y", _NARROW), "b").where(similar).select("a", "b")),
                "line-pairs")

    def verified(pairs: DataFrame) -> DataFrame:
        ids = pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct()
        wanted = kept(where.join(ids, "id"), "wanted-lines")
        texts = kept(_texts(docs, wanted), "line-texts")
        found = kept(_verified(pairs, texts), "line-links")
        dropped(wanted, texts)
        return found

    links = verified(star)
    part = kept(components(links), "line-parts")
    known = kept(traits("id", "", _NARROW).join(part, "id", "left").withColumn("part", F.coalesce("component", "id")).drop("component"),
                 "line-traits")
    dropped(part)

    def open_pairs(k: int) -> DataFrame:
        """The pairs of different groups that meet in the listings of a slice."""
        # One exchange serves both sides.  Where all lines of a listing are one group, nothing is open.
        rows = index.where(F.col("slice") == k).select("word", "id").join(known, "id").repartition("word")
        rows = (rows.withColumn("_low", F.min("part").over(of)).withColumn("_high", F.max("part").over(of))
                .where("_low <> _high").drop("_low", "_high"))
        left = rows.withColumnsRenamed({"id": "a", "part": "_p", **{c: f"_x{c}" for c in _NARROW}})
        right = rows.withColumnsRenamed({"id": "b", "part": "_q", **{c: f"_y{c}" for c in _NARROW}})
        near = kept(left.join(right, "word").where((F.col("a") < F.col("b")) & (F.col("_p") != F.col("_q")) & similar)
                    .select("a", "b").distinct(), "near-line-pairs")
        out = kept(wide(near), "wide-line-pairs")
        dropped(near)
        return out

    met = [open_pairs(k) for k in range(slices)]
    dropped(index, known)
    rest = kept(reduce(DataFrame.unionByName, met).distinct().join(star, ["a", "b"], "left_anti"), "open-line-pairs")
    dropped(star, *met)
    links = links.unionByName(verified(rest))
    part = kept(components(links).select(F.col("id").alias("h1"), "component"), "line-components")
    named = lines.join(part, "h1", "left").withColumn("component", F.coalesce("component", "h1"))
    firsts = named.where(F.col("n") > 1).select("component").unionByName(part.select("component")).distinct()
    keep = named.join(firsts, "component").groupBy("component").agg(F.min("where").alias("keep"))
    return seen, kept(named.select("h1", "h2", "component").join(keep, "component").select("h1", "h2", "keep"), "kept-lines")


def dropped_lines(docs: DataFrame) -> DataFrame:
    """(key, positions) of the lines to remove from each document."""
    seen, keep = line_groups(docs)
    extra = seen.join(keep, ["h1", "h2"]).where(~F.struct("doc_id", "key", "pos").eqNullSafe(F.col("keep")))
    return kept(extra.groupBy("key").agg(F.collect_set("pos").alias("_drop")), "dropped-lines")


def dedup_lines(docs: DataFrame) -> DataFrame:
    """All documents with their columns; in ``text``, repeated and nearly repeated lines are removed.

    Two lines link if the edit similarity of their words is 0.8 or more; of each connected
    group one occurrence stays, that of the smallest document id
    (a null id is smallest) and the smallest position.  Lines without a word are never
    removed.  A null text stays null, an empty one empty; a document that loses all its
    lines has an empty text.  Rows repeated with id and text are one document and keep the same
    lines.  A column ``n_chars`` is brought up to date; other columns are carried as they are.
    """
    drops = dropped_lines(docs)
    lines = F.split(F.col("text").cast("string"), "\n")
    key, drop = unused(docs, "_key"), unused(docs, "_drop")
    rest = F.filter(lines, lambda line, k: ~F.array_contains(F.col(drop), k))
    out = docs.withColumn(key, _key(docs)).join(drops.withColumnsRenamed({"key": key, "_drop": drop}), key, "left")
    text = F.when(F.col(drop).isNull(), F.col("text").cast("string")).otherwise(F.array_join(rest, "\n"))
    new = {"text": text}
    if "n_chars" in docs.columns:
        changed = F.col(drop).isNotNull()
        new["n_chars"] = F.when(changed, F.length(text)).otherwise(F.col("n_chars")).cast(docs.schema["n_chars"].dataType)
    return out.withColumns(new).select(*docs.columns)


def deduplicated(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, n_lines, n_removed, text_crc32 and n_chars of the remaining text."""
    drops = dropped_lines(docs)
    lines = F.split(F.col("text"), "\n")
    rest = F.filter(lines, lambda line, k: ~F.array_contains(F.col("_drop"), k))
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"), _key(docs).alias("key"))
    out = rows.join(drops, "key", "left").select(
        "doc_id", F.coalesce(F.size(lines), F.lit(0)).cast("bigint").alias("n_lines"),
        F.coalesce(F.size("_drop"), F.lit(0)).cast("bigint").alias("n_removed"),
        F.coalesce(F.when(F.col("_drop").isNull(), F.col("text")).otherwise(F.array_join(rest, "\n")), F.lit("")).alias("text"))
    return out.select("doc_id", "n_lines", "n_removed", F.crc32("text").alias("text_crc32"),
                      F.length("text").cast("bigint").alias("n_chars"))
