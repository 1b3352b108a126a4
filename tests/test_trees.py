"""Walk-forward trees on data with known splits, against plain sums, and without a look ahead."""

import datetime
import random

import numpy as np
import pytest

from slate.operators import trees, walk

SCHEMA = "game_id long, day date, league long, half long, least_n long, x array<double>"
BOOSTED = trees.Model("boosting", 12, 1, 2, 0.4, 1.0, 2.0)
FOREST = trees.Model("forest", 1, 12, 3, 1 / 12, 0.0, 20.0, 0.7, False)


def games(n, seed=1, days=40):
    """The home side wins with chance 0.9 where the first signal is above 1 and the second below 0, else with 0.2; the third is noise."""
    rng = random.Random(seed)
    out = []
    for i in range(n):
        x = [rng.gauss(0, 2), rng.gauss(0, 1), rng.random()]
        chance = 0.9 if x[0] > 1 and x[1] < 0 else 0.2
        out.append((i, datetime.date(2024, 1, 1) + datetime.timedelta(i * days // n), 0, 1 if rng.random() < 0.05 else 2 * (rng.random() < chance), 4, x))
    return out


def test_known_splits_are_found(spark):
    rows = games(1500)
    found = trees.chances(spark.createDataFrame(rows, SCHEMA), [BOOSTED, FOREST]).collect()
    x = {r[0]: r[5] for r in rows}
    first = min(r.day for r in found)
    assert sum(r[1] < first for r in rows) >= trees.AT_LEAST
    for name in ("boosting", "forest"):
        late = [r for r in found if r.model == name and r.day >= datetime.date(2024, 2, 1)]
        high = [r.p for r in late if x[r.game_id][0] > 1.5 and x[r.game_id][1] < -0.4]
        low = [r.p for r in late if x[r.game_id][0] < 0 or x[r.game_id][1] > 0.5]
        assert len(high) > 10 and len(low) > 50
        assert np.mean(high) > 0.75 and np.mean(low) < 0.32


def test_first_split_is_the_best_of_all(spark):
    """One tree of depth one against every split of every signal, by plain sums over games."""
    rows = games(400)
    model = trees.Model("one", 1, 1, 1, 1.0, 0.5, 5.0)
    lows, widths = np.array([[0.0] * 3, [-5.0, -2.5, 0.0]]), np.array([[1.0] * 3, [10 / trees.BINS, 5 / trees.BINS, 1 / trees.BINS]])
    frame = spark.createDataFrame([(0, r[0], r[3], r[5]) for r in rows], "block int, game_id long, half long, x array<double>").repartition(5)
    grown = trees.fitted(frame, model, lows, widths)[0]
    bins = trees._binned(np.array([r[5] for r in rows]), lows[1], widths[1])
    y = np.array([r[3] for r in rows]) / 2
    best = None
    for signal in range(3):
        for cut in range(trees.BINS - 1):
            left = bins[:, signal] <= cut
            gains = [((0.5 - y[s]).sum() ** 2 / (0.25 * s.sum() + 0.5)) for s in (left, ~left)]
            if min(0.25 * left.sum(), 0.25 * (~left).sum()) >= 5 and (best is None or sum(gains) > best[0] + 1e-9):
                best = (sum(gains), signal, cut, [-(0.5 - y[s]).sum() / (0.25 * s.sum() + 0.5) for s in (left, ~left)])
    assert (grown.signal[1, 0, 0], grown.cut[1, 0, 0]) == best[1:3]
    assert grown.value[1, 0].tolist() == pytest.approx(best[3])


def test_later_games_change_nothing(spark):
    rows = games(700)
    turned = [(*r[:3], 2 - r[3], *r[4:]) if r[1] >= datetime.date(2024, 2, 1) else r for r in rows]
    p = [{(r.model, r.game_id): r.p for r in trees.chances(spark.createDataFrame(x, SCHEMA), [FOREST]).collect() if r.day <= datetime.date(2024, 2, 1)} for x in (rows, turned)]
    assert p[0] == p[1] and p[0]


def test_weights_have_mean_one():
    w = trees._weights(np.arange(100_000), 3)
    assert abs(w.mean() - 1) < 0.02 and abs(w.var() - 1) < 0.05 and not np.array_equal(w, trees._weights(np.arange(100_000), 4))


def test_no_games(spark):
    assert trees.chances(spark.createDataFrame([], SCHEMA), [BOOSTED]).count() == 0
    odd = [(i, datetime.date(2024, 1, 1 + i // 20), 0, 2 * (i % 2), 4, [None, float("nan"), float("inf")]) for i in range(400)]
    assert all(0 < r.p < 1 for r in trees.chances(spark.createDataFrame(odd, SCHEMA), [BOOSTED._replace(rounds=1)]).collect())
    assert walk._starts(walk.prepared(spark.createDataFrame([], SCHEMA)), 200, 0.2) == [-(1 << 30)]
