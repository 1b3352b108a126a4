"""Rating fits against plain dense versions, closed forms and refits, on the games of the smallest tables."""

import collections
import math

import numpy as np
import pytest

import __spark_entry__ as entry
from slate.operators import ratings
from slate.plans import results, views

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def games(spark):
    rows = views.games(spark, SF).select("game_id", "day", "division", "home", "away", "home_goals", "away_goals").collect()
    leagues = collections.defaultdict(list)
    for r in sorted(rows, key=lambda r: (r.day, r.game_id)):
        leagues[r.division].append(r)
    return leagues


def dense(rows):
    """Teams, and one design row (home, away, edge) a game."""
    teams = sorted({t for r in rows for t in (r.home, r.away)})
    x = np.zeros((len(rows), len(teams) + 1))
    for i, r in enumerate(rows):
        x[i, teams.index(r.home)] += 1
        x[i, teams.index(r.away)] -= 1
        x[i, -1] = 1
    return teams, x, np.array([r.home_goals - r.away_goals for r in rows], float)


def by_league(rows, key="league"):
    out = collections.defaultdict(dict)
    for r in rows:
        out[r[key]][r.team] = r
    return out


def test_massey_solves_the_normal_equations(spark, games):
    found = by_league(entry.queries()["massey"](spark, SF).collect())
    for league, rows in games.items():
        teams, x, m = dense(rows)
        fit = np.array([found[league][t].rating for t in teams] + [found[league][teams[0]].edge])
        assert np.allclose(x.T @ (np.clip(m, -8, 8) - x @ fit), np.append(np.ones(len(teams)), 1e-3) * fit, atol=1e-8)


def test_colley_solves_its_equations(spark, games):
    found = by_league(entry.queries()["colley"](spark, SF).collect())
    for league, rows in games.items():
        for team, r in found[league].items():
            own = [(g.away if g.home == team else g.home, np.sign(g.home_goals - g.away_goals) * (1 if g.home == team else -1)) for g in rows if team in (g.home, g.away)]
            assert (2 + len(own)) * r.rating == pytest.approx(1 + sum(w for _, w in own) / 2 + sum(found[league][o].rating for o, _ in own))


@pytest.mark.parametrize("soft", [None, 2.0])
def test_bradley_terry_is_at_its_optimum(spark, games, soft):
    found = by_league(ratings.bradley_terry(results._counts(spark, SF), soft=soft).collect())
    for league, rows in games.items():
        teams, x, m = dense(rows)
        fit = np.array([found[league][t].rating for t in teams] + [found[league][teams[0]].edge])
        y = 0.5 + 0.5 * np.tanh(m / soft) if soft else (np.sign(m) + 1) / 2
        slope = x.T @ (1 / (1 + np.exp(-x @ fit)) - y) + np.append(np.ones(len(teams)), 1e-3) * fit
        assert np.abs(slope).max() < 1e-6


def test_poisson_is_at_its_optimum(spark, games):
    found = by_league(entry.queries()["poisson"](spark, SF).collect())
    for league, rows in games.items():
        one = next(iter(found[league].values()))
        slopes = collections.defaultdict(float)
        for t, r in found[league].items():
            slopes["attack", t], slopes["defence", t] = r.attack, r.defence
        slopes["edge"] = 1e-3 * one.edge
        for g in rows:
            for us, them, goals, home in ((g.home, g.away, g.home_goals, 1), (g.away, g.home, g.away_goals, 0)):
                off = math.exp(found[league][us].attack - found[league][them].defence + one["mean"] + one.edge * home) - goals
                slopes["attack", us] += off
                slopes["defence", them] -= off
                slopes["mean"] += off
                slopes["edge"] += off * home
        assert max(map(abs, slopes.values())) < 1e-4


def test_kalman_without_drift_is_a_ridge_fit(spark, games):
    """With no drift the filter's last mean is the posterior of one linear model over all games."""
    found = by_league(ratings.kalman(views.games(spark, SF), "division", drift=0.0).collect(), "division")
    for league, rows in games.items():
        teams, x, m = dense(rows)
        prior = np.diag([1 / 2.0] * len(teams) + [1 / 0.25])
        posterior = np.linalg.inv(prior + x.T @ x / 6.0)
        fit = posterior @ (x.T @ np.clip(m, -6, 6)) / 6.0
        assert [found[league][t].rating for t in teams] == pytest.approx(fit[:-1], abs=1e-8)
        assert [found[league][t].variance for t in teams] == pytest.approx(np.diag(posterior)[:-1], abs=1e-8)


@pytest.mark.parametrize("margins", ["none", "log", "538"])
def test_elo_against_a_plain_loop(spark, games, margins):
    got = {r.game_id: r for r in ratings.elo(views.games(spark, SF), "division", margins=margins).collect()}
    for rows in games.values():
        rating = collections.defaultdict(lambda: 1500.0)
        for g in rows:
            gap, m = rating[g.home] + 50 - rating[g.away], g.home_goals - g.away_goals
            chance = 1 / (1 + 10 ** (-gap / 400))
            size = {"none": 1.0}.get(margins, math.log(abs(m) + 1) if m else 0.5)
            if margins == "538":
                size *= 2.2 / ((gap if m >= 0 else -gap) * 0.001 + 2.2)
            assert (got[g.game_id].home_elo, got[g.game_id].away_elo, got[g.game_id].p_home) == pytest.approx((rating[g.home], rating[g.away], chance))
            moved = 20 * size * ((m > 0) + 0.5 * (m == 0) - chance)
            rating[g.home], rating[g.away] = rating[g.home] + moved, rating[g.away] - moved


def test_ceilings_against_refits(spark, games):
    found = {r.league: r for r in entry.queries()["ceilings"](spark, SF).collect()}
    for league, rows in games.items():
        teams, x, m = dense(rows)
        m = np.clip(m, -8, 8)
        ridge = np.diag([1.0] * len(teams) + [1e-3])
        whole = x @ np.linalg.solve(x.T @ x + ridge, x.T @ m)
        hit = lambda p: np.where(m == 0, 0.5, np.sign(p) == np.sign(m)).mean()
        assert found[league].games == len(rows) and found[league].hindsight == pytest.approx(hit(whole))
        left = []
        for i in range(len(rows)):
            rest = np.delete(np.arange(len(rows)), i)
            left.append(x[i] @ np.linalg.solve(x[rest].T @ x[rest] + ridge, x[rest].T @ m[rest]))
        assert found[league].left_out == pytest.approx(hit(np.array(left)))


def test_priors_draw_the_fit(spark, games):
    found = by_league(entry.queries()["massey_priors"](spark, SF).collect())
    from slate.plans.studies import _priors

    prior = {r.team: r.prior for r in _priors(spark, SF).collect()}
    for league, rows in games.items():
        teams, x, m = dense(rows)
        fit = np.array([found[league][t].rating for t in teams] + [found[league][teams[0]].edge])
        pull = np.append(np.full(len(teams), 4.0), 1e-3 + 20.0)
        towards = np.append([4.0 * 0.25 * prior.get(t, 0.0) for t in teams], 0.2 * 20.0)
        assert np.allclose(x.T @ (np.clip(m, -8, 8) - x @ fit) + towards, pull * fit, atol=1e-8)


def test_walk_forward_against_refits_of_earlier_days(spark):
    """Every chance is that of one fit on all games of earlier days; later games change nothing."""
    rows = results.walk_forward(spark, SF).collect()
    leagues = collections.defaultdict(list)
    for r in rows:
        leagues[r.division].append(r)
    checked = 0
    for own in leagues.values():
        for day in sorted({r.day for r in own})[::9]:
            past = [r for r in own if r.day < day]
            now = [r for r in own if r.day == day]
            if len(past) < 30 or len({r.signal for r in past}) < 2:
                assert all(r.p is None for r in now)
                continue
            s, y = np.array([r.signal for r in past], float), np.array([r.half_points / 2 for r in past])
            z = np.column_stack((np.ones(len(s)), (s - s.mean()) / s.std(ddof=1)))
            b = np.zeros(2)
            for _ in range(60):
                p = 1 / (1 + np.exp(-z @ b))
                pull = np.array([1e-6, 1.0])
                b -= np.linalg.solve((z * (p * (1 - p))[:, None]).T @ z + np.diag(pull), z.T @ (p - y) + pull * b)
            for r in now:
                assert r.p == pytest.approx(1 / (1 + math.exp(-(b[0] + b[1] * (r.signal - s.mean()) / s.std(ddof=1)))), abs=1e-9)
                checked += 1
    assert checked > 50


def test_ordered_logit_is_at_its_optimum(spark):
    rows = results._walked(spark, SF).collect()
    for fit in entry.queries()["ordered_logit"](spark, SF).collect():
        own = [r for r in rows if r.division == fit.division]
        scale = max(max(abs(r.signal) for r in own), 1)

        def value(slope, low, high):
            total = 0.0
            for r in own:
                x = slope * r.signal / scale
                a, b = 1 / (1 + math.exp(-(low - x))), 1 / (1 + math.exp(-(high - x)))
                total += math.log(max((a, b - a, 1 - b)[r.half_points], 1e-12))
            return total / len(own)

        best = value(fit.slope, fit.low, fit.high)
        assert best == pytest.approx(fit.log_likelihood)
        for step in (0.1, -0.1, 0.001, -0.001):
            assert value(fit.slope + step, fit.low, fit.high) <= best + 1e-9 and value(fit.slope, fit.low + step, fit.high) <= best + 1e-9 and value(fit.slope, fit.low, fit.high + step) <= best + 1e-9


def test_residual_form_against_a_plain_loop(spark, games):
    found = {r.team: r for r in entry.queries()["residual_form"](spark, SF).collect()}
    fits = by_league(entry.queries()["massey"](spark, SF).collect())
    last = collections.defaultdict(list)
    for league, rows in games.items():
        for g in rows:
            for team, other, m, home in ((g.home, g.away, g.home_goals - g.away_goals, 1), (g.away, g.home, g.away_goals - g.home_goals, -1)):
                last[team].append((g.day, g.game_id, league, other, max(-8, min(8, m)), home))
    for team, own in last.items():
        offs = []
        for _, _, league, other, m, home in sorted(own)[-5:]:
            fit = fits[league]
            if team in fit and other in fit:
                offs.append(m - (fit[team].rating - fit[other].rating + home * fit[team].edge))
        assert found[team].n == len(offs) and found[team].form == pytest.approx(np.mean(offs), abs=2e-6)


def test_ratings_as_of_each_day_against_refits(spark, games):
    """Every eleventh game: one dense fit on all games of earlier days, weighted by age."""
    from slate.plans import extras

    found = {(r.variant, r.game_id): r for r in extras.massey_asof(spark, SF).collect()}
    for name, cap, ridge, target, half in extras.VARIANTS:
        for rows in games.values():
            teams, x, m = dense(rows)
            capped = np.clip(m, -cap, cap)
            y = {"margin": capped, "sqrt": np.sign(capped) * np.sqrt(np.abs(capped)), "result": np.sign(m)}[target]
            pull = np.diag([ridge] * len(teams) + [1e-3])
            for i in range(0, len(rows), 11):
                past = [j for j in range(len(rows)) if rows[j].day < rows[i].day]
                got = found[name, rows[i].game_id]
                assert got.n_before == len(past)
                if not past:
                    assert got.expected is None
                    continue
                w = np.array([0.5 ** ((rows[i].day - rows[j].day).days / half) if half else 1.0 for j in past])
                fit = np.linalg.solve((x[past] * w[:, None]).T @ x[past] + pull, (x[past] * w[:, None]).T @ y[past])
                assert got.expected == pytest.approx(x[i] @ fit, abs=2e-6)


def test_calibrations_are_at_their_optimum(spark):
    rows = collections.defaultdict(list)
    for r in results._walked(spark, SF).collect():
        rows[r.day.year].append((r.signal, r.half_points / 2))
    fits = {r.season: r for r in entry.queries()["calibrations"](spark, SF).collect()}
    assert set(fits) == set(rows)
    for season, fit in fits.items():
        s, y = np.array(rows[season], float).T
        sd = s.std(ddof=1)
        off = 1 / (1 + np.exp(-(fit.intercept + fit.slope * s))) - y
        assert fit.n == len(s) and abs((off * (s - s.mean()) / sd).sum() + fit.slope * sd) < 1e-5 and abs(off.sum()) < 1e-4
        before = fits.get(season - 1)
        assert (fit.prior_intercept, fit.prior_slope) == ((before.intercept, before.slope) if before else (0.0, 0.52))


def test_sums_by_index_are_the_dense_ones():
    r = np.random.default_rng(1)
    h, a, n = r.integers(0, 7, 90), r.integers(0, 7, 90), r.random(90)
    x = np.zeros((90, 8))
    np.add.at(x, (np.arange(90), h), 1)
    np.add.at(x, (np.arange(90), a), -1)
    x[:, 7] = 1
    assert np.allclose(ratings.normal_matrix(h, a, n, 7), (x * n[:, None]).T @ x) and np.allclose(ratings.normal_side(h, a, n, 7), x.T @ n)
