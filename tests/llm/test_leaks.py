import random

from toolwarden.llm import decontamination as D

from . import brute

ITEMS = "item_id bigint, text string"


def expected(rows, items, similarity=0.8):
    out = set()
    for i, t in rows:
        w = brute.words(t)
        for k, x in items:
            v = brute.words(x)
            size = min(5, len(v))
            grams = lambda s: [tuple(s[j:j + size]) for j in range(len(s) - size + 1)]
            for start in range(len(w) - len(v) + 1) if v else ():
                a, b = grams(w[start:start + len(v)]), grams(v)
                shared = sum(min(a.count(g), b.count(g)) for g in set(a))
                if shared >= similarity * (len(a) + len(b) - shared):
                    out.add((i, k))
    return out


def test_equals_brute_force(spark, docs_df):
    rng = random.Random(6)
    word = lambda: "".join(rng.choice("abcdefghijk") for _ in range(5))
    items = [(k, " ".join(word() for _ in range(n))) for k, n in enumerate((40, 40, 60, 25, 7, 5, 3, 1))] + [(90, None), (91, "")]
    rows = []
    for i in range(60):
        text = [word() for _ in range(rng.randrange(0, 60))]
        if i % 2:
            k = rng.randrange(6)
            item = items[k][1].upper().split(" ")
            for _ in range(rng.randrange(0, 3)):
                item[rng.randrange(len(item))] = word()
            text[len(text) // 2:len(text) // 2] = item
        rows.append((i, "\n ".join(text)))
    rows += [(100, None), (101, ""), (102, items[6][1]), (103, items[7][1])]
    df, bench = docs_df(rows).repartition(2), spark.createDataFrame(items, ITEMS)
    want = expected(rows, items)
    assert len(want) > 10
    # Every verified pair lies within the radius here; a small block size splits the items.
    got = {(r.doc_id, r.item_id) for r in D.leaks(df, bench, item_rows=4).collect()}
    assert got <= want and len(got) >= 0.95 * len(want)
    exact = {(i, k) for i, k in want if items[k][1].lower() in " ".join(brute.words(dict(rows)[i]))}
    assert exact <= got
    kept = D.decontaminated(df, bench, item_rows=4)
    assert {r.doc_id for r in kept.collect()} == {i for i, _ in rows} - {i for i, _ in got}
    verdict = {r.doc_id: r for r in D.contamination(df, bench).collect()}
    assert {i for i, r in verdict.items() if r.contaminated} == {i for i, _ in got}
    assert D.contamination(df, bench.limit(0)).where("contaminated").count() == 0


def test_radius_is_complete():
    rng = random.Random(1)
    index = D.item_index([(k, " ".join(str(rng.random()) for _ in range(20))) for k in range(30)])
    import numpy as np

    windows = []
    for _ in range(300):
        bits = np.unpackbits(index["prints"][rng.randrange(30)])
        for place in rng.sample(range(D.BITS), rng.randrange(0, 45)):
            bits[place] ^= 1
        windows.append(np.packbits(bits))
    windows = np.array(windows)
    apart = np.bitwise_count(windows[:, None] ^ index["prints"][None]).sum(axis=2)
    want = {tuple(map(int, x)) for x in np.argwhere(apart <= D.RADIUS)}
    assert set(zip(*(x.tolist() for x in D._near(windows, index)))) == want


def test_texts_shorter_than_their_item(spark, docs_df):
    rng = random.Random(4)
    word = lambda: "".join(rng.choice("abcdefghijk") for _ in range(5))
    items = [(k, " ".join(word() for _ in range(n))) for k, n in enumerate((40, 60, 25, 9, 5, 3))]
    rows = [(100 * k + 10 * cut + side, " ".join(t.split()[cut if side else 0:len(t.split()) - (0 if side else cut)]))
            for k, t in items for cut in (1, 2, 4, 7) for side in (0, 1)]
    grams = lambda w, n: [tuple(w[j:j + n]) for j in range(len(w) - n + 1)]
    want = set()
    for i, t in rows:
        for k, x in items:
            w, v = brute.words(t), brute.words(x)
            a, b = grams(w, min(5, len(v))), grams(v, min(5, len(v)))
            shared = sum(min(a.count(g), b.count(g)) for g in set(a))
            if len(w) < len(v) and shared and shared >= 0.8 * (len(a) + len(b) - shared):
                want.add((i, k, len(w)))
    assert len(want) > 12
    df, bench = docs_df(rows), spark.createDataFrame(items, ITEMS)
    assert {(r.doc_id, r.item_id, r.words) for r in D.leaks(df, bench).collect()} == want
    assert {r.doc_id for r in D.decontaminated(df, bench).collect()} == {i for i, _ in rows} - {i for i, _, _ in want}
