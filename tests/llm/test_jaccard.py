import random

from toolwarden.llm.jaccard import jaccard_components, representatives

from . import brute


def near_copies(seed, bases=6, copies=30, size=60):
    """Groups of copies with growing numbers of changed words, and passages that many texts share."""
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(5))
    passage = [word() for _ in range(25)]
    rows = []
    for _ in range(bases):
        base = [word() for _ in range(size)]
        for k in range(copies):
            text = list(base)
            for _ in range(rng.randrange(0, 4)):
                text[rng.randrange(len(text))] = word()
            if k % 5 == 0:
                text = text[:-1]
            rows.append(" ".join(text))
    rows += [" ".join(passage + [word() for _ in range(rng.randrange(0, 12))]) for _ in range(60)]
    return list(enumerate(rows))


def result(df):
    return {r.doc_id: (r.n_shingles, r.component_id) for r in df.collect()}


def test_equals_brute_force(docs_df, monkeypatch):
    import toolwarden.llm.jaccard as module

    rows = near_copies(1)
    want = brute.jaccard(rows)
    assert len({c for _, c in want.values()}) not in (1, len(rows))
    assert result(jaccard_components(docs_df(rows).repartition(4))) == want
    # Long lists and leaders, instead of short lists.
    monkeypatch.setattr(module, "SHORT_LIST", 2)
    monkeypatch.setattr(module, "FREQUENT_FROM", 4)
    assert result(jaccard_components(docs_df(rows).repartition(4))) == want


def edited(seed, copies, size=120, subgroups=4):
    """Copies with up to a fifth of their words changed, and copies of such copies: few are similar to one leader."""
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(5))
    base = [word() for _ in range(size)]
    centres = [base]
    for _ in range(subgroups):
        centre = list(base)
        for at in rng.sample(range(size), rng.randrange(4, 14)):
            centre[at] = word()
        centres.append(centre)
    rows = []
    for k in range(copies):
        text = list(rng.choice(centres))
        for at in rng.sample(range(size), rng.choice([0, 1, 2, 3, 4, 6, 8])):
            text[at] = word()
        if rng.random() < 0.2:
            text = text[: size - rng.randrange(size // 6)]
        rows.append(" ".join(text))
    return list(enumerate(rows))


def test_sets_apart_from_their_leader(docs_df, monkeypatch):
    import toolwarden.llm.jaccard as module

    for seed, small in ((0, 2), (1, 16)):
        monkeypatch.setattr(module, "SMALL_LIST", small)
        rows = edited(seed, 150) + [(1000 + i, t) for i, t in edited(seed + 50, 60, 40)]
        want = brute.jaccard(rows)
        assert len({c for _, c in want.values()}) > 5
        assert result(jaccard_components(docs_df(rows).repartition(3))) == want


def test_documents_without_id_link(docs_df):
    """A document without an id connects its neighbours, and has their component."""
    words = [f"w{i}" for i in range(100)]
    one, two, three = (" ".join(words[:k] + [f"x{i}" for i in range(n)] + words[k + n:]) for k, n in ((0, 0), (40, 4), (40, 8)))
    rows = [(1, one), (None, two), (3, three), (4, "alone " * 9), (None, "nobody has this text at all")]
    got = {(r.doc_id, r.component_id) for r in jaccard_components(docs_df(rows)).collect()}
    assert brute.jaccard([(1, one), (2, two), (3, three)]) == {1: (96, 1), 2: (96, 1), 3: (96, 1)}
    assert brute.jaccard([(1, one), (3, three)])[3][1] == 3  # without it the two are apart
    assert got == {(1, 1), (None, 1), (3, 1), (4, 4), (None, None)}


def test_pairs_grow_with_the_group_not_with_its_square(docs_df, monkeypatch):
    """Copies of one text, each with changes of its own: what is compared beyond the leader stays in proportion."""
    import toolwarden.llm.jaccard as module

    counts = {}

    def counted(df, purpose, real=module.kept):
        out = real(df, purpose)
        if purpose.endswith("pairs"):
            counts[purpose] = counts.get(purpose, 0) + out.count()
        return out

    monkeypatch.setattr(module, "kept", counted)
    total = []
    for copies in (60, 240):
        counts.clear()
        rng = random.Random(copies)
        base = [f"w{i}" for i in range(200)]
        rows = []
        for k in range(copies):
            text = list(base)
            for at in rng.sample(range(200), rng.randrange(0, 9)):
                text[at] = f"n{k}x{at}"
            rows.append((k, " ".join(text)))
        assert result(jaccard_components(docs_df(rows))) == brute.jaccard(rows)
        total.append(sum(counts.values()))
    assert total[1] <= 6 * total[0], total


def test_whole_table(table_df):
    docs = table_df("documents")
    assert result(jaccard_components(docs)) == brute.jaccard([(r.doc_id, r.text) for r in docs.collect()])


def test_edges(docs_df):
    rows = [(1, None), (2, ""), (3, " \n"), (4, "one two"), (5, "ONE\ttwo"), (6, "one two three"), (6, "one two"),
            (None, "one two three"), (7, "É two"), (8, "é two"), (9, "x " * 30_000), (10, "x " * 50)]
    got = {(r.doc_id, r.n_shingles, r.component_id) for r in jaccard_components(docs_df(rows)).collect()}
    assert got == {(1, 0, 1), (2, 0, 2), (3, 0, 3), (4, 1, 4), (5, 1, 4), (6, 1, 4), (6, 1, 6), (None, 1, 6), (7, 1, 7),
                   (8, 1, 8), (9, 1, 9), (10, 1, 9)}
    assert jaccard_components(docs_df([])).count() == 0


def test_representatives(docs_df):
    rows = near_copies(2, bases=3, copies=8)
    kept = representatives(docs_df(rows + [(900, None), (901, ""), (None, "a b c")]))
    assert kept.columns == ["doc_id", "text", "lang", "source", "n_chars"]
    want = {i for i, (_, c) in brute.jaccard(rows).items() if i == c} | {900, 901, None}
    assert {r.doc_id for r in kept.collect()} == want
