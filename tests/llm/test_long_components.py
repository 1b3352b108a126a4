"""Components of long paths and of mixed graphs, with any labels."""

import random

import pytest

from slate.llm.graph import components
from slate.llm.simhash import links


def plain(edges):
    root = {x: x for e in edges for x in e}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        low, high = sorted((find(a), find(b)))
        root[high] = low
    return {x: find(x) for x in root}


def path(labels):
    return list(zip(labels, labels[1:], strict=False))


def shuffled(n, seed):
    labels = list(range(-n // 2, n - n // 2))
    random.Random(seed).shuffle(labels)
    return labels


def mixed(n, seed):
    own = random.Random(seed)
    star = [(n, i) for i in range(n)]
    comb = [(2 * n + i, 2 * n + i + 1) for i in range(n)] + [(2 * n + i, 4 * n + i) for i in range(n)]
    return star + comb + [(own.randrange(6 * n, 9 * n), own.randrange(6 * n, 9 * n)) for _ in range(n)]


@pytest.mark.parametrize("edges", [path(shuffled(800, 1)), path(range(400, 0, -1)), mixed(200, 3)], ids=["random", "descending", "mixed"])
def test_components_settle_whatever_the_labels(spark, edges):
    found = components(spark.createDataFrame(edges, "a long, b long"))
    assert {r.node: r.root for r in found.collect()} == plain([e for e in edges if e[0] != e[1]])


def test_a_long_chain_of_fingerprints_is_one_component(spark):
    # each of these differs from the one before by three bits, and from the others by more
    own, fp = random.Random(5), 0
    chain = [0]
    while len(chain) < 300:
        fp = chain[-1]
        for bit in own.sample(range(63), 3):
            fp ^= 1 << bit
        if all(bin(fp ^ other).count("1") > 3 for other in chain[:-1]):
            chain.append(fp)
    found = components(links(spark.createDataFrame([(x,) for x in chain], "fp long")))
    assert {r.node: r.root for r in found.collect()} == dict.fromkeys(chain, 0)
