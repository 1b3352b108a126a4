"""Banks that learn rows of several equal games against games one by one; values of a team that plays often in a day."""

import numpy as np
import pytest

from slate.operators import catalogue, models

LISTED = catalogue.candidates()


def made(n, seed):
    rng = np.random.default_rng(seed)
    home = rng.integers(0, 4, n)
    return np.column_stack((home, (home + rng.integers(1, 4, n)) % 4, rng.integers(0, 6, n), rng.integers(0, 5, n)))


@pytest.mark.parametrize("kind", ["massey", "bradley_terry", "poisson", "colley", "schedule", "kalman"])
def test_rows_of_several_games_are_learnt_as_such(kind):
    options = [c.options for c in LISTED if c.kind == kind]
    whole, summed, single = (models.BANKS[kind](options) for _ in range(3))
    for bank in (whole, summed, single):
        bank.grow(np.array([1.0, np.nan, 0.5, np.nan]), np.array([np.nan, 2.0, -1.0, np.nan]))
    for day in range(3):
        games = made(400, day)
        rows, n = np.unique(games, axis=0, return_counts=True)
        h, a = games[:, 0], games[:, 1]
        whole.learn(h, a, *games[:, 2:].T.astype(float), day)
        summed.learn(rows[:, 0], rows[:, 1], *rows[:, 2:].T.astype(float), day, n)
        for g in games:
            single.learn(g[:1], g[1:2], g[2:3].astype(float), g[3:].astype(float), day)
    seen = [bank.expect(h, a, 3) for bank in (whole, summed, single)]
    assert np.abs(seen[0]).max() > 0.01
    assert seen[1] == pytest.approx(seen[0], abs=1e-6)
    assert seen[2] == pytest.approx(seen[0], abs=1e-6)


def test_a_team_is_asked_once_a_day():
    bank = models.Residual([{"cap": 8, "ridge": 1, "last": 3}])
    league = models.League([bank])
    for day in range(2):
        home, away, hg, ag = made(200, day).T
        asked = len(bank.past)
        bank.past = [_Counted(p) for p in bank.past]
        values = league.day([np.full(200, day), home, away, hg.astype(float), ag.astype(float)])
        assert values.shape == (200, 1)
        assert not asked or [p.read for p in bank.past] == [1] * 4


class _Counted(models.deque):
    def __init__(self, past):
        super().__init__(past, past.maxlen)
        self.read = 0

    def __iter__(self):
        self.read += 1
        return super().__iter__()
