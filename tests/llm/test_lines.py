import random
import re
from collections import defaultdict

from pyspark.sql import functions as F

from toolwarden.llm import lines

from . import brute


def corpus(seed):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(6))
    base = [[word() for _ in range(40)] for _ in range(8)]
    rows = []
    for doc in range(60):
        text = []
        for line in rng.sample(base, 3):
            line = list(line)
            for _ in range(rng.choice([0, 0, 1, 1, 2, 4])):
                line[rng.randrange(len(line))] = word()
            text.append(" ".join(line))
        text.append(" ".join(word() for _ in range(rng.randrange(1, 9))))
        text.append(rng.choice(["", "---", "Thanks, all.", "THANKS  all"]))
        rows.append((doc, "\n".join(text)))
    return rows


def expected(spark, df):
    """Positions to remove by id, comparing all pairs of lines; fingerprints are the operator's own."""
    seen = lines.simhashed(df).collect()
    text = {r.doc_id: (r.text or "").split("\n") for r in df.collect()}
    norm = {(r.doc_id, r.pos): [w for w in re.split(r"[\s!-/:-@\[-`{-~]+", text[r.doc_id][r.pos].lower()) if w] for r in seen}
    of = defaultdict(list)
    for r in seen:
        of[r.h1, r.h2].append(r)
    keys = sorted(of)
    links = []
    for i, a in enumerate(keys):
        for b in keys[:i]:
            x, y = of[a][0], of[b][0]
            if bin((x.print ^ y.print) & (1 << 64) - 1).count("1") <= lines.RADIUS:
                p, q = norm[x.doc_id, x.pos], norm[y.doc_id, y.pos]
                if brute.edit_distance(p, q) <= 0.2 * max(len(p), len(q)):
                    links.append((a, b))
    part = brute.groups(keys, links)
    members = defaultdict(list)
    for k in keys:
        members[part[k]] += [(r.doc_id, r.pos) for r in of[k]]
    drop = defaultdict(set)
    for found in members.values():
        for d, p in sorted(found)[1:]:
            drop[d].add(p)
    return drop, len(links)


def test_equals_brute_force(spark, docs_df):
    df = docs_df(corpus(3))
    drop, n = expected(spark, df)
    assert n > 20
    got = {r.doc_id: r for r in lines.dedup_lines(df).collect()}
    for i, text in corpus(3):
        want = "\n".join(x for k, x in enumerate(text.split("\n")) if k not in drop[i])
        assert got[i].text == want and got[i].n_chars == len(want)


def test_simhash_is_the_majority_of_word_hashes(spark, docs_df):
    df = docs_df([(1, "one two three two"), (2, "x")])
    rows = {r.doc_id: r for r in lines.simhashed(df).collect()}
    hashes = [r[0] for r in spark.createDataFrame([(w,) for w in ("one", "two", "three", "two")], "w string").select(F.xxhash64("w")).collect()]
    want = sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))
    assert rows[1].print & (1 << 64) - 1 == want
    assert rows[1].size == 4


def test_simhash_of_long_lines(spark, docs_df):
    words = [str(k % 700) for k in range(1500)]
    got = lines.simhashed(docs_df([(1, " ".join(words))])).first()
    hashes = [r[0] for r in spark.createDataFrame([(w,) for w in words], "w string").select(F.xxhash64("w")).collect()]
    assert got.size == 1500
    assert got.print & (1 << 64) - 1 == sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > 1500)


def test_edges(docs_df):
    long_ = " ".join(str(k) for k in range(6_000))
    rows = [(3, "A b.\n\nnew"), (1, "a  B\n\n***"), (None, "a b"), (2, None), (4, ""), (5, long_), (6, "0 " + long_), (7, "x\ny"), (7, "x\ny")]
    got = [(r.doc_id, r.text) for r in lines.dedup_lines(docs_df(rows)).collect()]
    assert sorted(got, key=str) == sorted([(3, "\nnew"), (1, "\n***"), (None, "a b"), (2, None), (4, ""), (5, long_), (6, ""),
                                           (7, "x\ny"), (7, "x\ny")], key=str)
    out = lines.deduplicated(docs_df(rows))
    assert {(r.doc_id, r.n_lines, r.n_removed) for r in out.collect()} >= {(3, 3, 1), (2, 0, 0), (4, 1, 0)}
    assert lines.deduplicated(docs_df([])).count() == 0
    odd = docs_df([(1, "q w"), (2, "q w")]).withColumn("key", F.lit("k")).withColumn("_drop", F.lit(1))
    assert {(r.doc_id, r.text, r.key, r._drop) for r in lines.dedup_lines(odd).collect()} == {(1, "q w", "k", 1), (2, "", "k", 1)}


def test_all_pairs_of_edit_similarity_at_any_length(spark, docs_df):
    """Against edit distance alone, without fingerprints: every length finds its partners at the very limit."""
    rng = random.Random(8)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(rng.randrange(1, 12)))
    rows = []
    for size in (1, 2, 3, 4, 5, 6, 9, 14, 15, 18, 19, 23, 30, 50, 90, 170, 400):
        for extra in (0, 0, 1):
            base = [word() for _ in range(size)]
            base[0] = base[size // 2]
            other = list(base)
            for _ in range(size // 5 + extra):
                at = rng.randrange(len(other))
                other[at:at + 1] = rng.choice([[word()], [], [other[at], word()]])
            rows += [(len(rows), " ".join(base)), (len(rows) + 1, " ".join(other))]
    norm = {i: t.split() for i, t in rows}
    near = lambda x, y: 5 * brute.edit_distance(x, y) <= max(len(x), len(y))
    links = [(i, j) for j in norm for i in range(j) if 4 * len(norm[j]) <= 5 * len(norm[i]) and 4 * len(norm[i]) <= 5 * len(norm[j])
             and near(norm[i], norm[j])]
    assert len(links) > 25
    part = brute.groups(list(norm), links)
    got = {r.doc_id for r in lines.dedup_lines(docs_df(rows)).collect() if r.text == "" and norm[r.doc_id]}
    assert got == {i for i in norm if norm[i] and part[i] != i}


def test_unrelated_lines_that_share_long_words_do_not_meet(spark, docs_df):
    rng = random.Random(4)
    word = lambda n: "".join(rng.choice("abcdefghijklmnop") for _ in range(n))
    rows = []
    for i in range(300):
        line = [word(5) for _ in range(10)]
        line[2], line[6] = "extraordinarily", "longwindedness"
        rows.append((i, " ".join(line)))
    none = spark.createDataFrame([], "id bigint, _key bigint, _pos int")
    listed = lines._listed(docs_df(rows), none)
    assert listed.groupBy("word").agg(F.countDistinct("id").alias("n")).where("n > 1").count() == 0
    assert listed.select("id").distinct().count() == 300


def test_a_much_repeated_line_is_listed_once(spark, docs_df):
    df = docs_df([(i, "one two three four five six seven eight nine ten") for i in range(50)])
    first = lines.sketched(df).orderBy("doc_id").first()
    repeated = spark.createDataFrame([(first.h1, first.key, first.pos)], "id bigint, _key bigint, _pos int")
    listed = lines._listed(df, repeated)
    assert 0 < listed.count() == listed.distinct().count()


def test_prefixes_are_as_long_as_the_limit_asks(spark):
    sizes = [r[0] for r in spark.range(8, 400).select(lines._prefix(F.col("id"))).collect()]
    for n, got in zip(range(8, 400), sizes):
        need = [2 * (m // 5) + 1 - (m - n) for m in range(max(n, lines.ONE_EDIT + 1), n * 5 // 4 + 1)]
        assert got >= max(need) and got <= max(need) + 1


def test_long_lines_have_wide_sketches_that_part_them(spark, docs_df):
    """Unrelated lines of 200 words can't be told apart by 128 bits."""
    df = docs_df([(0, " ".join(f"a{k}" for k in range(200))), (1, " ".join(f"b{k}" for k in range(200))), (2, "a b c d e f")])
    rows = lines.sketched(df)
    pairs = rows.select(*[F.col(c).alias(f"_x{c}") for c in rows.columns]).crossJoin(rows.select(*[F.col(c).alias(f"_y{c}") for c in rows.columns]))
    near = {(r._xdoc_id, r._ydoc_id): r.near for r in pairs.withColumn("near", lines._near(lines._WIDE)).collect()}
    assert not near[0, 1] and near[0, 0] and near[0, 2]


def test_open_listings_are_joined_in_slices(spark, docs_df, monkeypatch):
    """The rows are those of brute force, each slice's pairs are written apart, and listings are stored once."""
    written = []
    keep = lines.kept
    monkeypatch.setattr(lines, "SLICE_LINES", 40)
    monkeypatch.setattr(lines, "kept", lambda df, purpose: written.append((purpose, df.columns)) or keep(df, purpose))
    df = docs_df(corpus(5))
    drop, n = expected(spark, df)
    assert n > 20
    got = {r.doc_id: r.text for r in lines.dedup_lines(df).collect()}
    assert all(got[i] == "\n".join(x for k, x in enumerate(text.split("\n")) if k not in drop[i]) for i, text in corpus(5))
    purposes = [p for p, _ in written]
    assert purposes.count("near-line-pairs") == 1 + lines._words(df).count() // 40 > 3
    assert [p for p, columns in written if "word" in columns] == ["line-index"]
