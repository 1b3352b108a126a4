"""Strengths that are kept across runs: runs over parts equal one over all, and a run that was stopped is gone on with."""

import datetime
import random

import pytest

from slate.operators import models
from slate.session import scratch
from slate.streaming import ratings

OPTIONS = {"drift": 0.02, "noise": 9, "start": 3, "cap": 6}


def games(n=240, seed=2):
    rng = random.Random(seed)
    out = []
    for i in range(n):
        home, away = rng.sample(range(8), 2)
        out.append((i, datetime.date(2024, 1, 1) + datetime.timedelta(i // 6), i % 2, home, away, rng.randrange(8), rng.randrange(7)))
    return out


def plain(rows):
    """Each league's games day by day through one bank in memory."""
    out = {}
    for league in {r[2] for r in rows}:
        bank = models.Kalman([OPTIONS])
        state = models.League([bank])
        own = sorted((r for r in rows if r[2] == league), key=lambda r: (r[1], r[0]))
        for day in sorted({r[1] for r in own}):
            import numpy as np

            now = [r for r in own if r[1] == day]
            cols = [np.array([r[i] for r in now]) for i in (3, 4, 5, 6)]
            number = np.array([(day - datetime.date(1970, 1, 1)).days])
            for r, v in zip(now, state.day([number, cols[0], cols[1], cols[2].astype(float), cols[3].astype(float)])[:, 0], strict=True):
                out[r[0]] = v
    return out


def land(spark, rows, folder):
    ratings.land(spark.createDataFrame(rows, ratings.GAMES), folder)


def same(found, want):
    got = {r.game_id: r.expected for r in found.collect()}
    assert len(got) == found.count() == len(want)
    assert all(got[k] == pytest.approx(want[k], abs=1e-9) for k in want)


def test_three_runs_equal_one(spark):
    rows = games()
    folder, root = scratch(spark, "landed"), scratch(spark, "kept")
    for part in (rows[:60], rows[60:150], rows[150:]):
        land(spark, part, folder)
        found = ratings.run(spark, folder, root, OPTIONS)
    same(found, plain(rows))
    # nothing new has landed: the same results, and none twice
    same(ratings.run(spark, folder, root, OPTIONS), plain(rows))


def test_a_stopped_run_is_gone_on_with(spark):
    rows = games(180, 5)
    folder, root = scratch(spark, "landed"), scratch(spark, "kept")
    for at in range(0, 180, 30):
        land(spark, rows[at : at + 30], folder)
    query = ratings.start(spark, folder, root, OPTIONS, files=1)
    while query.isActive and not any(p["numInputRows"] for p in query.recentProgress):
        query.awaitTermination(0.05)
    query.stop()
    same(ratings.run(spark, folder, root, OPTIONS, files=1), plain(rows))


def test_games_without_goals_or_days(spark):
    rows = [*games(30), (900, None, 0, 1, 2, 3, 4), (901, datetime.date(2024, 1, 2), 0, 1, None, 3, 4), (902, datetime.date(2024, 1, 2), 0, 1, 2, None, 4)]
    folder, root = scratch(spark, "landed"), scratch(spark, "kept")
    land(spark, rows, folder)
    same(ratings.run(spark, folder, root, OPTIONS), plain(games(30)))
