"""Walk-forward fits over raw signals against plain refits of all earlier games."""

import datetime
import math
import random

import numpy as np
import pytest

from slate.operators import ratings, walk

SCHEMA = "game_id long, day date, league long, half long, least_n long, x array<double>"
ENTRIES = [walk.Entry((0,)), walk.Entry((1,), 3.0), walk.Entry((3,)), walk.Entry((0, 1)), walk.Entry((0, 1, 2, 3, 4, 5, 6, 7), 10.0), walk.Entry((0, 2), 1.0, True), walk.Entry((2,), 1.0, True)]


def games(n, days=60, seed=1):
    rng = random.Random(seed)
    out = []
    for i in range(n):
        x = [rng.gauss(0, 2), rng.random(), rng.gauss(5, 1), 1.0, float(rng.randrange(3)), rng.gauss(0, 0.1), rng.gauss(0, 30), float(i % 2)]
        chance = 1 / (1 + math.exp(-(0.7 * x[0] - x[1] + 0.2)))
        half = 1 if rng.random() < 0.1 else 2 * (rng.random() < chance)
        out.append((i, datetime.date(2024, 1, 1) + datetime.timedelta(rng.randrange(days)), i % 3, half, rng.randrange(9), x))
    return sorted(out, key=lambda r: (r[1], r[0]))


def refit(rows, entry, row, own_least=150):
    past = [r for r in rows if r[1] < row[1] and r[4] >= 2]
    own = [r for r in past if r[2] == row[2]]
    if len(past) < 30:
        return None
    use = own if entry.by_league and len(own) >= own_least else past
    x = np.array([[r[5][f] for f in entry.features] for r in use])
    fit = ratings.logistic(x, np.array([r[3] / 2 for r in use]), np.ones(len(use)), entry.ridge)
    return 1 / (1 + math.exp(-(fit[0] + sum(w * row[5][f] for w, f in zip(fit[1:], entry.features, strict=True)))))


@pytest.mark.parametrize(("n", "exact", "held", "close"), [(600, 2000, 2048, 1e-6), (1500, 200, 4096, 1e-3), (1500, 200, 128, 2e-3)])
def test_chances_are_those_of_refits(spark, n, exact, held, close):
    """Exact below ``exact`` games; beyond, earlier games stand as a quadratic, and games beyond ``held`` join it."""
    rows = games(n)
    found = {(r.entry, r.game_id): r.p for r in walk.chances(spark.createDataFrame(rows, SCHEMA), ENTRIES, exact=exact, held=held).collect()}
    for row in rows[:: n // 40]:
        for i, entry in enumerate(ENTRIES):
            want = refit(rows, entry, row)
            if want is None:
                assert (i, row[0]) not in found
            else:
                assert found[i, row[0]] == pytest.approx(want, abs=close), (i, row[:5])


def test_sums_of_scores(spark):
    rows = games(400)
    wide = spark.createDataFrame(rows, SCHEMA)
    split = (datetime.date(2024, 2, 5) - datetime.date(1970, 1, 1)).days
    p = {(r.entry, r.game_id): r.p for r in walk.chances(wide, ENTRIES).collect()}
    want = {}
    for game, day, league, half, least, _ in rows:
        for i in range(len(ENTRIES)):
            if (i, game) in p and least >= 5:
                own = want.setdefault((i, league, "train" if day <= datetime.date(2024, 2, 5) else "holdout"), [0, 0.0])
                own[0] += 1
                own[1] += (p[i, game] - half / 2) ** 2
    found = {(r.entry, r.league, r.part): (r.n, r.squares) for r in walk.scores(wide, ENTRIES, split).collect()}
    assert found.keys() == want.keys()
    assert all(found[k] == pytest.approx(tuple(want[k])) for k in want)


def test_odd_signals_and_no_games(spark):
    rows = [(i, datetime.date(2024, 1, 1 + i // 10), 0, 2 * (i % 2), 3, [None, float("nan"), float("inf"), 1.0, 0.0, float(i), 0.0, 0.0]) for i in range(80)]
    found = walk.chances(spark.createDataFrame(rows, SCHEMA), ENTRIES[:4]).collect()
    assert len(found) == 4 * 50 and all(0 < r.p < 1 for r in found)
    assert walk.chances(spark.createDataFrame([], SCHEMA), ENTRIES).count() == 0
    assert walk.scores(spark.createDataFrame([], SCHEMA), ENTRIES, None).count() == 0
