"""Signals of the catalogue against plain readings of each team's history, and walk-forward fits against refits."""

import datetime
import math
import random

import numpy as np
import pytest

from slate.operators import catalogue, models, ratings
from slate.plans import views

LISTED = catalogue.candidates()
NUMBER = {c.name: i for i, c in enumerate(LISTED)}


def made(seed=3, n=150, teams=6):
    rng = random.Random(seed)
    out = []
    for i in range(n):
        home, away = rng.sample(range(teams), 2)
        out.append((i, datetime.date(2024, 1, 1) + datetime.timedelta(rng.randrange(60)), home, away, rng.randrange(7), rng.randrange(6), home % 2))
    return out


def frames(spark, rows):
    games = spark.createDataFrame(rows, "game_id long, day date, home long, away long, home_goals long, away_goals long, division long")
    priors = spark.createDataFrame([(0, 1.5, None), (1, None, -0.5), (2, 0.5, 1.0), (3, -2.0, 1.0)], "team long, last double, outside double")
    return catalogue.known_games(catalogue.played(games, "division", priors), views.team_games(games))


@pytest.fixture(scope="module")
def found(spark):
    known = frames(spark, made())
    out = {}
    for r in catalogue.signals(known, LISTED).collect():
        out[r.metric, r.game_id] = r.value
    return out


def history(rows, team, day):
    """(half/2, gf, ga, opp, sign of home, day) of a team's games before a day, in order."""
    out = []
    for _, d, h, a, hg, ag, _ in sorted(rows, key=lambda r: (r[1], r[0])):
        if d < day and team in (h, a):
            gf, ga, opp, at = (hg, ag, a, 1) if team == h else (ag, hg, h, -1)
            out.append(((np.sign(gf - ga) + 1) / 2, gf, ga, opp, at, d))
    return out


def faded(past, life, value, none):
    w = [0.5 ** ((len(past) - 1 - i) / life) for i in range(len(past))]
    return sum(x * value(g) for x, g in zip(w, past, strict=True)) / sum(w) if past else none


def streak(past):
    out = 0
    for g in past:
        sign = int(np.sign(g[0] - 0.5))
        out = (out + sign if out * sign > 0 else sign) if sign else 0
    return out


mean = lambda xs, none: sum(xs) / len(xs) if xs else none
cap = lambda x, c: max(-c, min(c, x))
PLAIN = {
    "record points": lambda p, d: mean([g[0] for g in p], 0.5),
    "record wins": lambda p, d: mean([float(g[0] == 1) for g in p], 0.5),
    "record conceded": lambda p, d: -mean([g[2] for g in p], 0.0),
    "record margin cap 3": lambda p, d: mean([cap(g[1] - g[2], 3) for g in p], 0.0),
    "pythagoras 2.0": lambda p, d: (lambda a, b: a * a / (a * a + b * b))(mean([g[1] for g in p], 0.0) + 0.5, mean([g[2] for g in p], 0.0) + 0.5),
    "fade points 3": lambda p, d: faded(p, 3, lambda g: g[0], 0.5),
    "fade margin 12": lambda p, d: faded(p, 12, lambda g: g[1] - g[2], 0.0),
    "fade capped 6": lambda p, d: faded(p, 6, lambda g: cap(g[1] - g[2], 5), 0.0),
    "last points 5": lambda p, d: mean([g[0] for g in p[-5:]], 0.5),
    "last capped 8": lambda p, d: mean([cap(g[1] - g[2], 5) for g in p[-8:]], 0.0),
    "streak": lambda p, d: streak(p),
    "last result": lambda p, d: p[-1][0] - 0.5 if p else 0.0,
    "rest": lambda p, d: min(14, (d - p[-1][5]).days) if p else 14,
}


@pytest.mark.parametrize("name", PLAIN)
def test_team_signals(found, name):
    rows = made()
    for i, day, home, away, *_ in rows:
        want = PLAIN[name](history(rows, home, day), day) - PLAIN[name](history(rows, away, day), day)
        assert found[NUMBER[name], i] == pytest.approx(want, abs=1e-9)


def test_meetings(found):
    rows = made()
    for i, day, home, away, *_ in rows:
        met = [g for g in history(rows, home, day) if g[3] == away]
        assert found[NUMBER["meetings result"], i] == pytest.approx(mean([g[0] - 0.5 for g in met], 0.0))
        assert found[NUMBER["meetings margin"], i] == pytest.approx(mean([cap(g[1] - g[2], 5) for g in met], 0.0))


def earlier(rows, league, day):
    return [r for r in sorted(rows, key=lambda r: (r[1], r[0])) if r[6] == league and r[1] < day]


def squares(past, ridge, target, weight, prior, teams=6):
    x = np.zeros((len(past), teams + 1))
    for i, r in enumerate(past):
        x[i, r[2]], x[i, r[3]], x[i, teams] = 1, -1, 1
    w = np.array([weight(r) for r in past])
    pull = np.append(np.full(teams, ridge), 1e-3)
    return np.linalg.solve((x * w[:, None]).T @ x + np.diag(pull), x.T @ (w * np.array([target(r) for r in past], float)) + pull * np.append(prior, 0.0))


BLEND = np.array([1.5, -0.5, 0.75, -0.5, 0.0, 0.0])
SQUARES = {
    "massey cap 8 ridge 1": (1, lambda r: cap(r[4] - r[5], 8), 0, 0),
    "massey target sqrt cap 8 ridge 0.3": (0.3, lambda r: np.sign(r[4] - r[5]) * math.sqrt(min(8, abs(r[4] - r[5]))), 0, 0),
    "massey target result cap 1 ridge 3": (3, lambda r: np.sign(r[4] - r[5]), 0, 0),
    "massey cap 5 ridge 1 half_life 30": (1, lambda r: cap(r[4] - r[5], 5), 30, 0),
    "massey prior blend share 0.5 ridge 2 cap 8": (2, lambda r: cap(r[4] - r[5], 8), 0, 0.5),
}


@pytest.mark.parametrize("name", SQUARES)
def test_least_squares_as_of_the_day(found, name):
    rows = made()
    ridge, target, life, share = SQUARES[name]
    for i, day, home, away, _, _, league in rows:
        past = earlier(rows, league, day)
        fit = squares(past, ridge, target, lambda r: 0.5 ** ((day - r[1]).days / life) if life else 1.0, share * BLEND)  # noqa: B023
        assert found[NUMBER[name], i] == pytest.approx(fit[home] - fit[away] + fit[6], abs=1e-8)


def test_residuals_use_the_fit_of_the_day(found):
    rows = made()
    for i, day, home, away, _, _, league in rows[::7]:
        past = earlier(rows, league, day)
        fit = squares(past, 1, lambda r: cap(r[4] - r[5], 8), lambda r: 1.0, np.zeros(6))

        def over(team):
            own = history([r for r in rows if r[6] == league], team, day)[-5:]  # noqa: B023
            return mean([cap(g[1] - g[2], 8) - (fit[team] - fit[g[3]] + g[4] * fit[6]) for g in own], 0.0)  # noqa: B023

        assert found[NUMBER["residual last 5"], i] == pytest.approx(over(home) - over(away), abs=1e-8)


def loss(values, past, name):
    """Penalised loss of Bradley-Terry or Poisson ratings, written out by game."""
    total = 0.0
    if name == "bradley_terry":
        total += 0.5 * (values[:6] ** 2).sum() * 0.3 + 0.5e-3 * values[6] ** 2
        for r in past:
            p = 1 / (1 + math.exp(-(values[r[2]] - values[r[3]] + values[6])))
            y = 0.5 + 0.5 * math.tanh((r[4] - r[5]) / 4)
            total -= y * math.log(p) + (1 - y) * math.log(1 - p)
        return total
    total += 0.5 * (values[:12] ** 2).sum() * 3 + 0.5e-3 * values[13] ** 2
    for r in past:
        for goals, by, against, edge in ((r[4], r[2], r[3], 1), (r[5], r[3], r[2], 0)):
            power = values[by] - values[6 + against] + values[12] + edge * values[13]
            total += math.exp(power) - goals * power
    return total


@pytest.mark.parametrize(("kind", "options", "size"), [("bradley_terry", {"ridge": 0.3, "soft": 4}, 7), ("poisson", {"ridge": 3}, 14)])
def test_fits_are_at_their_optimum(kind, options, size):
    past = [r for r in sorted(made(), key=lambda r: r[1])]
    bank = models.BANKS[kind]([{"ridge": 9.0}, options])
    bank.grow(np.full(6, np.nan), np.full(6, np.nan))
    for r in past:
        bank.learn(*[np.array([v]) for v in (r[2], r[3])], *[np.array([float(v)]) for v in (r[4], r[5])], r[1].toordinal())
    x = bank.solved()[1]
    best = loss(x, past, kind)
    for place in range(size):
        for move in (1e-4, -1e-4):
            assert loss(x + move * np.eye(size)[place], past, kind) >= best - 1e-9


def test_ratings_in_game_order(spark, found):
    """Points and drifting strengths against the replays of whole leagues (points of a day's games all come from earlier days)."""
    rows = made()
    for name, k, edge, margins in (("elo k 48 edge 35 margins log", 48, 35, "log"), ("elo k 16 edge 0 margins 538", 16, 0, "538")):
        for i, day, home, away, _, _, league in rows:
            points = dict.fromkeys(range(6), 0.0)
            for r in earlier(rows, league, day):
                change = k * models.elo_change(points[r[2]] + edge - points[r[3]], r[4] - r[5], margins)
                points[r[2]] += change
                points[r[3]] -= change
            assert found[NUMBER[name], i] == pytest.approx((points[home] + edge - points[away]) / 400 * math.log(10))
    games = spark.createDataFrame(rows, "game_id long, day date, home long, away long, home_goals long, away_goals long, division long")
    final = {(r.division, r.team): r for r in ratings.kalman(games, "division", drift=0.0, noise=9.0, start=3.0, cap=8.0).collect()}
    later = [*rows, (999, datetime.date(2024, 6, 1), 0, 2, 0, 0, 0)]
    value = [r.value for r in catalogue.signals(frames(spark, later), [LISTED[NUMBER["kalman drift 0 noise 9 start 3 cap 8"]]]).where("game_id = 999").collect()]
    assert value == [pytest.approx(final[0, 0].rating - final[0, 2].rating + final[0, 0].edge)]


def test_later_games_change_nothing(spark, found):
    rows = made()
    last = max(r[1] for r in rows)
    other = [(*r[:4], 6 - r[4], r[5], r[6]) if r[1] == last else r for r in rows]
    again = {(r.metric, r.game_id): r.value for r in catalogue.signals(frames(spark, other), LISTED).collect()}
    assert again.keys() == found.keys()
    assert all(math.isclose(again[k], found[k], rel_tol=1e-9, abs_tol=1e-9) for k in found)


def test_names_and_numbers():
    assert len({c.name for c in LISTED}) == len(LISTED) >= 200
    assert all(set(c.features) <= set(NUMBER) for c in catalogue.combos())


def test_scores_of_entries(spark):
    """Scores of one signal, one by league and the eight together against refits of all earlier games, game by game."""
    known = frames(spark, made(5, 300))
    wanted = {f for c in catalogue.combos() for f in c.features}
    listed = [c for c in LISTED if c.name in wanted]
    chosen = [c for c in catalogue.combos() if c.name in ("eight signals ridge 10", f"{catalogue.BASE} + rest", f"{catalogue.BASE} by league")]
    wide = catalogue.wide_signals(known, listed).cache()
    rows = wide.collect()
    day = catalogue.split_day(wide).first()[0]
    place = {c.name: i for i, c in enumerate(listed)}
    table = {(r.name, r.kind, r.part): r for r in catalogue.table_of(catalogue.evaluated(wide, listed, chosen)).collect()}
    assert len({k[0] for k in table}) == len(listed) + 3
    for combo in [*chosen, catalogue.Combo("streak", ("streak",))]:
        got = {"train": [], "holdout": []}
        for g in rows:
            past = [r for r in rows if r.day < g.day and r.least_n >= 2]
            if g.least_n < 5 or len(past) < 30:
                continue
            own = [r for r in past if r.league == g.league]
            use = own if combo.by_league and len(own) >= 150 else past
            x = np.array([[r.x[place[f]] for f in combo.features] for r in use])
            fit = ratings.logistic(x, np.array([r.half / 2 for r in use]), np.ones(len(use)), combo.ridge)
            p = 1 / (1 + math.exp(-(fit[0] + sum(w * g.x[place[f]] for w, f in zip(fit[1:], combo.features, strict=True)))))
            got["train" if g.day <= day else "holdout"].append((p - g.half / 2) ** 2)
        kind = "calibrated" if combo.name == "streak" else "combo"
        for part, squares_ in got.items():
            assert table[combo.name, kind, part].n == len(squares_)
            assert table[combo.name, kind, part].brier == pytest.approx(sum(squares_) / len(squares_), abs=1e-6)


def test_all_combinations_are_there():
    assert len(catalogue.combos()) == 23
    assert max(len(c.features) for c in catalogue.combos()) == 8


def test_selection_prefers_the_simplest_near_the_best(spark):
    rows = [("a", "calibrated", 5, "train", 0.60), ("a", "calibrated", 5, "holdout", 0.610), ("b", "combo", 2, "train", 0.61), ("b", "combo", 2, "holdout", 0.611), ("c", "raw", 1, "train", 0.62), ("c", "raw", 1, "holdout", 0.65)]
    scores = spark.createDataFrame(rows, "name string, kind string, complexity int, part string, log_loss double")
    assert [r.name for r in catalogue.selected(scores).collect()] == ["b"]


def test_empty_and_unplayed(spark):
    known = frames(spark, [])
    assert catalogue.signals(known, LISTED).count() == 0
    some = frames(spark, [(1, None, 0, 1, 2, 3, 0), (2, datetime.date(2024, 1, 1), 0, 1, None, 3, 0), (3, datetime.date(2024, 1, 2), 0, 1, 2, 3, 0)])
    assert [r.game_id for r in catalogue.signals(some, [LISTED[0]]).collect()] == [3]
