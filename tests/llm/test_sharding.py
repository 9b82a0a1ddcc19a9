import itertools
import random
import zlib
from collections import Counter, defaultdict

from toolwarden.llm import sharding


def spread(weights, parts, part):
    sums = [0] * parts
    for w, p in zip(weights, part):
        sums[p] += w
    return max(sums) - min(sums)


def test_differencing():
    assert sharding.difference([], 3) == []
    weights = [8, 7, 6, 5, 4]
    best = min(spread(weights, 2, p) for p in itertools.product(range(2), repeat=5))
    assert spread(weights, 2, sharding.difference(weights, 2)) <= best + 2
    rng = random.Random(1)
    weights = [rng.randrange(1, 5000) for _ in range(400)]
    assert spread(weights, 16, sharding.difference(weights, 16)) <= 50
    import numpy as np

    assert spread(weights, 16, sharding.balanced(np.array(weights), 16).tolist()) <= 5000


def test_shards(docs_df):
    rng = random.Random(2)
    rows = [(i, "x" * rng.randrange(0, 400)) for i in range(300)] + [(1000 + i, "same text") for i in range(150)]
    rows += [(2000, None), (2001, None), (None, "n"), (5, "again"), (5, "again")]
    got = sharding.shards(docs_df(rows).repartition(3), 16).collect()
    text = defaultdict(list)
    for i, t in rows:
        text[i].append(t)
    assert Counter(r.doc_id for r in got) == Counter(i for i, _ in rows)
    group, slots, sums = defaultdict(set), defaultdict(list), Counter()
    for r in got:
        assert (r.size, r.text_crc32) in {(len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for t in text[r.doc_id]}
        assert (r.law, r.grown_shard) == ("bytes", None)
        group[r.text_crc32, r.size, text[r.doc_id][0] is None].add(r.shard)
        slots[r.shard].append(r.slot)
        sums[r.shard] += r.size
    assert all(len(s) == 1 for s in group.values())
    assert all(sorted(s) == list(range(len(s))) for s in slots.values()) and set(sums) <= set(range(16))
    assert max(sums.values()) - min(sums.values()) <= 800
    assert sharding.shards(docs_df([]), 16).count() == 0
