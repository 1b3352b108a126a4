"""Crowded keys of the near-duplicate index: no link is lost, and rows grow in proportion."""

import collections
import random

import pytest
from pyspark.sql import functions as F

from slate.llm import simhash
from slate.llm.graph import components


def signed(x):
    return x - (1 << 64) if x >> 63 else x


def roots(nodes):
    """Components by all pairs."""
    up = {n: n for n in nodes}

    def top(n):
        while up[n] != n:
            n = up[n]
        return n

    for i, a in enumerate(nodes):
        for b in nodes[:i]:
            if ((a ^ b) & (1 << 64) - 1).bit_count() <= simhash.DISTANCE:
                up[top(a)] = top(b)
    groups = collections.defaultdict(set)
    for n in nodes:
        groups[top(n)].add(n)
    return {frozenset(g) for g in groups.values() if len(g) > 1}


@pytest.mark.parametrize("same", ["high", "low", "byte"])
def test_crowded_keys_lose_no_link(spark, same):
    rng = random.Random(7)
    base = rng.getrandbits(32)
    seeds = [rng.getrandbits(32) & (0xFFFFFF00 if same == "byte" else 0xFFFFFFFF) for _ in range(120)]
    made = set()
    for s in seeds:
        for _ in range(3):
            other = s
            for bit in rng.sample(range(32), rng.randrange(4)):
                other ^= 1 << bit
            made.add((base << 32 | other) if same != "low" else (other << 32 | base))
    nodes = sorted(signed(m) for m in made)
    found = components(simhash.links(spark.createDataFrame([(n,) for n in nodes], "fp long"), block=16)).collect()
    groups = collections.defaultdict(set)
    for r in found:
        groups[r.root].add(r.node)
    assert {frozenset(g) for g in groups.values()} == roots(nodes)


def test_parts_are_four_a_row(spark):
    rows = spark.range(100).select(F.xxhash64("id").alias("fp"))
    parted = rows.select("fp", F.explode(simhash._keys(F.col("fp"))).alias("key")).select(F.explode(simhash._parts(F.col("key"), F.col("fp"))).alias("part"))
    assert parted.count() == 100 * 64 * 4
    assert parted.agg(F.min("part"), F.max("part")).first()[0] >= 0
    assert parted.agg(F.max("part")).first()[0] < 1024
