"""Operators on embeddings against plain versions in numpy, with odd vectors, ties, copies and rows that are no vectors."""

import math
import random

import numpy as np
import pytest

from slate.llm import epsilon, negatives, vectors

SCHEMA = "vec_id long, embedding array<float>, label int, links string, component_id double"


def made(seed, n=300, dim=8, groups=6):
    """Vectors around some centres, near the threshold and far from it, with copies, and rows that link with nothing."""
    rng = random.Random(seed)
    centres = [[rng.gauss(0, 1) for _ in range(dim)] for _ in range(groups)]
    rows = []
    for i in range(n):
        noise = rng.choice([0.02, 0.1, 0.3])
        rows.append([rng.gauss(c, noise) for c in rng.choice(centres)])
    rows[10] = rows[11] = rows[12] = list(rows[3])
    rows[20] = [2 * x for x in rows[4]]
    rows[30], rows[31], rows[32], rows[33] = None, [0.0] * dim, [float("nan")] + [1.0] * (dim - 1), [None] + [1.0] * (dim - 1)
    rows[34], rows[35], rows[36], rows[37] = [float("inf")] * dim, [], [1.0, 2.0], [2.0, 4.0]
    rows[38] = [-0.0 if x == 0 else x for x in rows[31]]
    out = [(1000 - i, v, i % 4, "x", 0.5) for i, v in enumerate(rows)]
    out[40] = (None, rows[3], 1, "x", 0.5)
    out[41] = (out[42][0], rows[41], 2, "x", 0.5)
    out[43] = out[44]
    return out


def usable(v):
    return bool(v) and all(x is not None and math.isfinite(x) for x in v)


def plain_links(rows, similarity=0.95):
    """(n_links, component_id) by row."""
    vecs = [np.array(np.float32(r[1]), float) if usable(r[1]) and any(r[1]) else None for r in rows]
    top = list(range(len(rows)))

    def find(x):
        while top[x] != x:
            x = top[x]
        return x

    links = [0] * len(rows)
    for i, a in enumerate(vecs):
        for j, b in enumerate(vecs):
            if i != j and a is not None and b is not None and len(a) == len(b) and a @ b / np.sqrt(a @ a) / np.sqrt(b @ b) >= similarity:
                links[i] += 1
                top[find(i)] = find(j)
    least = {}
    for i, r in enumerate(rows):
        least[find(i)] = min((x for x in (least.get(find(i)), r[0]) if x is not None), default=None)
    return [(links[i], least[find(i)]) for i in range(len(rows))]


@pytest.mark.parametrize("seed", [1, 2])
def test_links_and_components(spark, seed, monkeypatch):
    monkeypatch.setattr(vectors, "BLOCK_ROWS", 16)
    rows = made(seed)
    want = sorted(((r[0], *w, r[0] == w[1]) for r, w in zip(rows, plain_links(rows), strict=True)), key=str)
    found = epsilon.near_duplicates(spark.createDataFrame(rows, SCHEMA))
    assert found.columns == ["vec_id", "n_links", "component_id", "kept"]
    assert sorted((tuple(r) for r in found.collect()), key=str) == want


def test_one_crowded_place(spark, monkeypatch):
    """A third of all rows are one vector, another third are near copies of one; no task's output has their pairs."""
    monkeypatch.setattr(vectors, "BLOCK_ROWS", 32)
    rng = random.Random(5)
    same, near = [rng.gauss(0, 1) for _ in range(6)], [rng.gauss(0, 1) for _ in range(6)]
    rows = [(i, same if i % 3 == 0 else [x + rng.gauss(0, 0.01) for x in near] if i % 3 == 1 else [rng.gauss(0, 1) for _ in range(6)], 0, "", 0.0) for i in range(360)]
    want = [(r[0], *w) for r, w in zip(rows, plain_links(rows), strict=True)]
    assert sorted(tuple(r)[:3] for r in epsilon.near_duplicates(spark.createDataFrame(rows, SCHEMA)).collect()) == want


def test_pointers_connect_what_is_linked():
    rng = np.random.default_rng(3)
    for share in (0.02, 0.1, 0.5):
        hits = rng.random((30, 20)) < share
        top = {("r", i): ("r", i) for i in range(30)} | {("c", i): ("c", i) for i in range(20)}

        def find(x):
            while top[x] != x:  # noqa: B023
                x = top[x]  # noqa: B023
            return x

        for i, j in zip(*np.nonzero(hits), strict=True):
            top[find(("r", i))] = find(("c", j))
        want = {frozenset(k for k in top if find(k) == find(x)) for x in top}
        top = {x: x for x in top}
        pairs = [p for a, b in epsilon._pointers(hits) for p in zip(a.tolist(), b.tolist(), strict=True)]
        for i, j in pairs:
            top[find(("r", i))] = find(("c", j))
        assert {frozenset(k for k in top if find(k) == find(x)) for x in top} == want
        assert len(pairs) <= 50


@pytest.mark.parametrize("kind", ["float", "double"])
def test_empty_tables_of_vectors(spark, kind):
    none = spark.createDataFrame([], f"vec_id long, embedding array<{kind}>, label int")
    assert epsilon.query(none).count() == 0 and negatives.query(none).count() == 0
    bad = spark.createDataFrame([(50, None, 1), (100, [None], 1), (150, [1.0], None)], f"vec_id long, embedding array<{kind}>, label int")
    assert negatives.query(bad).count() == 0
    assert sorted((r.vec_id, r.n_links, r.component_id, r.kept) for r in epsilon.query(bad).collect()) == [(50, 0, 50, True), (100, 0, 100, True), (150, 0, 150, True)]


def plain_negatives(rows, every=50, positives=5, negatives_=3):
    table = [(r[0], (r[2] + 1) % 10 if r[0] is not None and r[0] % 7 == 0 else r[2], np.floor(256 * np.array(np.float32(r[1]), float))) for r in rows if r[2] is not None and r[1] is not None and (usable(r[1]) or r[1] == [])]
    out = []
    key = lambda x: (-x[0], x[1] is None, x[1] or 0)
    for i, (anchor, label, q) in enumerate(table):
        if anchor is None or anchor % every:
            continue
        scored = [(int(q @ o[2]), o[0], o[1] == label) for j, o in enumerate(table) if j != i and len(o[2]) == len(q)]
        for score, positive, _ in sorted((s for s in scored if s[2]), key=key)[:positives]:
            wanted = sorted((s for s in scored if not s[2] and 50 * score <= 100 * s[0] <= 95 * score), key=key)[:negatives_]
            out += [(anchor, positive, rank, n[1], score, n[0]) for rank, n in enumerate(wanted, 1)]
    return sorted(out, key=str)


@pytest.mark.parametrize("seed", [1, 4])
def test_hard_negatives(spark, seed, monkeypatch):
    monkeypatch.setattr(vectors, "BLOCK_ROWS", 16)
    rows = made(seed, 400)
    rows[50] = (950, [0.5] * 8, None, "x", 0.5)
    found = negatives.query(spark.createDataFrame(rows, SCHEMA))
    assert found.columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    got = sorted((tuple(r) for r in found.collect()), key=str)
    assert len(got) > 50 and got == plain_negatives(rows)


def test_scores_stay_exact():
    a, b = np.array([[2.0**40, 3.0], [2.0**70, 0.0]]), np.array([[2.0**20, 5.0], [-(2.0**70), 1.0]])
    assert negatives.products(a, b).tolist() == [[2**60 + 15, -(2**63)], [2**63 - 1, -(2**63)]]
    assert negatives.products(a[:1] / 2**30, b[:1]).tolist() == [[2**30]]


def test_intervals_hold_every_product(spark):
    """Boxes of two nodes bound the inner products and distances of their rows."""
    rng = np.random.default_rng(7)
    rows = [(i, i % 2, rng.normal(size=40).tolist()) for i in range(400)]
    frame = spark.createDataFrame(rows, "id long, grp long, vec array<double>")
    same = lambda x: x
    made_ = vectors.blocks(frame, same, ("id",))
    least, most = vectors.product_bounds()
    left, right = vectors.nodes(made_, 0, "a_"), vectors.nodes(made_, 0, "b_")
    ids = {r.code: r.id for r in made_.collect()}
    vecs = {i: np.array(v) for i, _, v in rows}
    assert sorted(i for own in ids.values() for i in own) == list(range(400))
    for r in left.crossJoin(right).select("a_code", "b_code", least.alias("least"), most.alias("most"), vectors.box_distance().alias("gap")).collect():
        products = [vecs[i] @ vecs[j] for i in ids[r.a_code] for j in ids[r.b_code]]
        assert r.least <= min(products) and max(products) <= r.most
        assert r.gap <= min(((vecs[i] - vecs[j]) ** 2).sum() for i in ids[r.a_code] for j in ids[r.b_code]) + 1e-9


def test_components_of_any_size(spark):
    """Components whose squares no double holds: scores are clipped to a long, cosines are as ever, and nothing fails."""
    big = [[1e300, -1e300, 3.0], [1e300, -1e300, 4.0], [-1e300, 1e300, 1.0], [1e-300, -1e-300, 0.0], [5e307, 1e307, 0.0], [1.0, 2.0, 3.0]]
    rows = [(50 * i, v, i % 2) for i, v in enumerate(big)]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    found = {r.vec_id: (r.n_links, r.component_id) for r in epsilon.query(frame).collect()}
    assert found == {0: (2, 0), 50: (2, 0), 100: (0, 100), 150: (2, 0), 200: (0, 200), 250: (0, 250)}
    for r in negatives.query(frame).collect():
        assert 50 * r.positive_score <= 100 * r.negative_score <= 95 * r.positive_score
