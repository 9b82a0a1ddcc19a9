import random

from toolwarden.llm.graph import components

from . import brute


def test_components(spark):
    rng = random.Random(9)
    links = [(k, k + 1) for k in range(200)]  # a chain, its ids in disorder
    names = list(range(201))
    rng.shuffle(names)
    links = [(names[a], names[b]) for a, b in links] + [(500, 500 + k) for k in range(1, 60)] + [(1000, 1000)]
    links += [(rng.randrange(2000, 2100), rng.randrange(2000, 2100)) for _ in range(60)]
    got = {r.id: r.component for r in components(spark.createDataFrame(links, "a bigint, b bigint")).collect()}
    want = brute.groups({n for e in links for n in e if e[0] != e[1]}, [e for e in links if e[0] != e[1]])
    assert got == want
    assert components(spark.createDataFrame([], "a bigint, b bigint")).count() == 0
