import random
import re
from collections import Counter, defaultdict

from toolwarden.llm import rules

WORD = re.compile(r"[^\x20\x09-\x0d]+")


def counted(text):
    words, lines = WORD.findall(text or ""), [x for x in (text or "").split("\n") if WORD.search(x)]
    grams = Counter(tuple(words[i:i + 8]) for i in range(len(words) - 7))
    repeated = {j for i in range(len(words) - 7) if grams[tuple(words[i:i + 8])] > 1 for j in range(i, i + 8)}
    return [len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text or ""), len(lines),
            len(lines) - len(set(lines)), len(repeated)]


def features(c):
    return {"mean_chars": 100 * c[1] // max(c[0], 1), "symbols": 10000 * c[2] // max(c[1], 1),
            "dup_lines": 10000 * c[4] // max(c[3], 1), "repeat_words": 10000 * c[5] // max(c[0], 1)}


def bucket(v):
    s = max(v.bit_length() - 6, 0)
    return v >> s << s


def judged(rows, least, reach):
    """(doc_id, text, lang, source) rows: reasons by the rules, one row at a time."""
    counts = [counted(t) for _, t, _, _ in rows]
    base = [c[0] < 20 or 100 * c[5] > 30 * c[0] for c in counts]
    groups = defaultdict(list)
    for (_, _, lang, source), c, failed in zip(rows, counts, base):
        if not failed:
            for key in ((0, lang, source), (1, lang), (2,)):
                groups[key].append(features(c))
    spread = {"mean_chars": 40, "symbols": 100, "dup_lines": 1000, "repeat_words": 500}
    out = []
    for (_, _, lang, source), c, failed in zip(rows, counts, base):
        found = groups.get((0, lang, source), [])
        if 0 < len(found) < least:
            found = groups[1, lang] if len(groups[1, lang]) >= least else groups[2,]
        reason = "base" if failed else None
        for name in spread:
            if reason is None:
                v = sorted(bucket(f[name]) for f in found)
                q1, q3 = v[-(-len(v) // 4) - 1], v[-(-3 * len(v) // 4) - 1]
                wide = reach * max(q3 - q1, spread[name])
                own = features(c)[name]
                if own > q3 + wide or (name == "mean_chars" and own < q1 - wide):
                    reason = name
        out.append((counts[len(out)], reason))
    return out


def text(rng):
    kind = rng.random()
    size = rng.choice([0, 3, 19, 20, 40, 120])
    words = [rng.choice("ab éü漢 cd# x|y".split()) * rng.randint(1, 4) for _ in range(size)]
    if kind < 0.2:
        words = [w + "#$%&" * rng.randint(0, 2) for w in words]
    elif kind < 0.4:
        words = [f"w{i % rng.randint(5, 40)}" for i in range(size)]
    elif kind < 0.8:
        words = [f"w{rng.randint(0, 900)}" for _ in range(size)]
    return "".join(w + rng.choice([" ", " ", "\n", "\n\n", "\t\x0b", "  "]) for w in words)


def test_against_one_row_at_a_time(spark):
    rng = random.Random(4)
    rows = [(i, text(rng), rng.choice(["en", "en", "de", None]), rng.choice(["a", "a", "b", None])) for i in range(500)]
    rows += [(9, None, "en", "a"), (None, rows[7][1], "xx", "lone"), rows[3], rows[3], (501, "", "", ""), (502, "\n \n", "en", "a")]
    rows += [(600 + i, "line one\n" * i + " ".join(f"u{k}" for k in range(30)), "en", "a") for i in range(12)]
    plain = " ".join(f"u{k}" for k in range(70))
    rows += [(700, plain + " ##$$%%" * 7, "en", "a"), (701, " ".join(f"longword{k:09}" for k in range(60)), "en", "a"),
             (702, plain + " one two three four five six seven eight" * 2, "de", "a")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string").selectExpr(
        "*", "'x' AS n_words", "1 AS counts", "2 AS kept", "3 AS low_symbols", "4 AS _lang").repartition(5)
    for least, reach in ((30, 2), (100000, 4)):
        got = rules.quality_rules(df, least, reach).collect()
        key = lambda r: tuple((x is not None, x) for x in r)
        have = sorted(([r.doc_id, *[r[c] for c in rules.COUNTS], r.base_failed, r.kept, r.reason or ""] for r in got), key=key)
        want = sorted(([i, *c, reason == "base", reason is None, reason or ""]
                       for (i, _, _, _), (c, reason) in zip(rows, judged(rows, least, reach))), key=key)
        assert have == want
        assert len({r.reason for r in got}) >= (5 if reach == 2 else 2)
        left = rules.passing(df, least, reach)
        assert left.columns == df.columns
        assert sorted(r.text for r in left.collect()) == sorted(t for (_, t, _, _), (_, why) in zip(rows, judged(rows, least, reach)) if why is None)
    assert rules.quality_rules(df.limit(0)).count() == 0 and rules.passing(df.limit(0)).count() == 0


def test_sketches_merge_to_the_sketch_of_all(spark):
    rng = random.Random(1)
    rows = [(text(rng), rng.choice("ab"), rng.choice("xy")) for _ in range(300)]
    docs = spark.createDataFrame(rows, "text string, lang string, source string")
    parts = [rules.sketches(rules._groups(docs.where(f"source = '{s}'"))) for s in "xy"]
    whole = rules.merged(rules.sketches(rules._groups(docs)))
    again = rules.merged(parts[0].unionByName(parts[1]))
    assert sorted(map(str, whole.collect())) == sorted(map(str, again.collect()))
    values = [rng.randint(0, 10 ** rng.randint(0, 9)) for _ in range(200)]
    got = spark.createDataFrame([(v,) for v in values], "v bigint").select("v", rules.bucket(rules.F.col("v")).alias("b"))
    assert all(r.b == bucket(r.v) and 0 <= r.v - r.b <= r.v / 32 for r in got.collect())


def test_a_very_long_text_and_a_hot_group(spark):
    rng = random.Random(6)
    long = " ".join(f"w{rng.randint(0, 999)}" for _ in range(300000)) + "\nagain and again" * 2
    rows = [(i, f"some plain words of document number {i} " + " ".join(f"v{i * k}" for k in range(25)), "en", "hot") for i in range(1, 301)]
    got = {r.doc_id: r for r in rules.quality_rules(spark.createDataFrame(
        [*rows, (1000, long, "en", "hot")], "doc_id bigint, text string, lang string, source string")).collect()}
    assert got[1000].n_words == 300006 and got[1000].n_dup_lines == 1 and got[1000].kept
    assert all(got[i].kept for i in range(1, 301))


def test_clean_documents_stay(table_df):
    """Of documents that pass the base, nearly all of quality 1 are kept, and half of quality 0 go."""
    labels = table_df("labels")
    got = rules.quality_rules(table_df("documents")).join(labels, "doc_id").where("NOT base_failed").collect()
    good, bad = ([r.kept for r in got if r.quality == q] for q in (1, 0))
    assert sum(good) >= 0.98 * len(good) and sum(bad) <= 0.6 * len(bad)
