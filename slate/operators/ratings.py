"""Team ratings. Spark reduces games to sufficient statistics; the fit itself is a small solve in numpy.

Massey and Colley need only sums per pair of teams, Bradley-Terry and Poisson counts per pair and outcome, so what
reaches a fit is bounded by teams squared times outcomes, not by games; normal matrices are summed by index from these rows, so a fit holds teams squared
numbers and its rows, and no design matrix. Elo, Kalman and ratings as of each day
stream the days of a league in order (``models``), so a task holds a day and the ratings.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from slate.operators import models


GROUP = "league"


def pair_counts(games: DataFrame, group: str) -> DataFrame:
    """(group, home, away, home_goals, away_goals, n)."""
    return games.groupBy(F.col(group).alias(GROUP), "home", "away", "home_goals", "away_goals").agg(F.count("*").alias("n"))


def _fit(counts: DataFrame, kernel: Callable[[pd.DataFrame, list[int]], dict[str, list[float]]], columns: str) -> DataFrame:
    names = [c.split()[0] for c in columns.split(", ")]

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        teams = sorted(set(rows.home) | set(rows.away))
        out = kernel(rows, teams)
        return pd.DataFrame({GROUP: rows[GROUP].iloc[0], "team": teams, **{n: out[n] for n in names}})

    return counts.groupBy(GROUP).applyInPandas(run, f"{GROUP} long, team long, {columns}")


def _sides(rows: pd.DataFrame, teams: list[int]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    place = {t: i for i, t in enumerate(teams)}
    margin = (rows.home_goals - rows.away_goals).to_numpy(float)
    return rows.home.map(place).to_numpy(), rows.away.map(place).to_numpy(), margin, rows.n.to_numpy(float)


def normal_matrix(h: np.ndarray, a: np.ndarray, n: np.ndarray, teams: int) -> np.ndarray:
    """The weighted normal matrix of rows home - away + edge; the edge is last."""
    out = np.zeros((teams + 1, teams + 1))
    edge = np.full(len(h), teams)
    signed = ((h, 1), (a, -1), (edge, 1))
    for one, x in signed:
        for other, y in signed:
            np.add.at(out, (one, other), x * y * n)
    return out


def normal_side(h: np.ndarray, a: np.ndarray, v: np.ndarray, teams: int) -> np.ndarray:
    """The sums of ``v`` over the same rows."""
    return np.append(np.bincount(h, v, teams) - np.bincount(a, v, teams), v.sum())


def massey(counts: DataFrame, cap: float = 8, ridge: float = 1, home_prior: tuple[float, float] = (0.0, 0.0)) -> DataFrame:
    """Ridge least squares: capped margin = home rating - away rating + home edge."""

    def kernel(rows: pd.DataFrame, teams: list[int]) -> dict[str, list[float]]:
        h, a, margin, n = _sides(rows, teams)
        left = normal_matrix(h, a, n, len(teams))
        right = normal_side(h, a, n * np.clip(margin, -cap, cap), len(teams))
        left[np.arange(len(teams)), np.arange(len(teams))] += ridge
        left[-1, -1] += 1e-3 + home_prior[1]
        right[-1] += home_prior[0] * home_prior[1]
        fit = np.linalg.solve(left, right)
        return {"rating": fit[:-1], "edge": [fit[-1]] * len(teams)}

    return _fit(counts, kernel, "rating double, edge double")


def massey_by_day(games: DataFrame, variants: list[tuple[str, dict]], group: str) -> DataFrame:
    """(variant, game_id, n_before, expected): the margin that a fit on games of earlier days expects; null where there are none.

    ``variants``: names with the options of ``models.Massey`` (ridge, cap, target, half_life). All variants of a group go through its days together.
    """
    names = np.array([name for name, _ in variants])

    def each(league: models.League, columns: models.Columns) -> list:
        _, day, home, away, hg, ag, game = columns
        before = league.games
        value = league.day([day, home, away, hg, ag])
        expected = [None if before == 0 else v for v in value.ravel().tolist()]
        return [np.tile(names, len(game)), np.repeat(game, len(names)), np.full(value.size, before, np.int64), pa.array(expected, pa.float64())]

    return models.through_days(models.in_order(games, group), lambda: [models.Massey([o for _, o in variants])], "variant string, game_id long, n_before long, expected double", each)


def calibrated(rows: DataFrame, ridge: float = 1.0, intercept: float = 0.0, slope: float = 0.52) -> DataFrame:
    """(season, n, intercept, slope, prior_intercept, prior_slope): a logistic fit of each season, and the one of the season before or the defaults.

    ``rows``: season, signal, half_points. They are counted first, so a fit sees counts.
    """
    counts = rows.groupBy("season", "signal", "half_points").agg(F.count("*").alias("n"))

    def run(own: pd.DataFrame) -> pd.DataFrame:
        fit = logistic(own[["signal"]].to_numpy(float), own.half_points.to_numpy(float) / 2, own.n.to_numpy(float), ridge)
        return pd.DataFrame({"season": [own.season.iloc[0]], "n": [int(own.n.sum())], "intercept": [fit[0]], "slope": [fit[1]]})

    fits = counts.groupBy("season").applyInPandas(run, "season int, n long, intercept double, slope double")
    prior = fits.select((F.col("season") + 1).alias("season"), F.col("intercept").alias("i"), F.col("slope").alias("s"))
    return fits.join(prior, "season", "left").select("season", "n", "intercept", "slope", F.coalesce("i", F.lit(intercept)).alias("prior_intercept"), F.coalesce("s", F.lit(slope)).alias("prior_slope"))


def colley(counts: DataFrame) -> DataFrame:
    def kernel(rows: pd.DataFrame, teams: list[int]) -> dict[str, list[float]]:
        h, a, margin, n = _sides(rows, teams)
        left, right = 2 * np.eye(len(teams)), np.ones(len(teams))
        np.add.at(left, (h, h), n)
        np.add.at(left, (a, a), n)
        np.add.at(left, (h, a), -n)
        np.add.at(left, (a, h), -n)
        np.add.at(right, h, n * np.sign(margin) / 2)
        np.add.at(right, a, -n * np.sign(margin) / 2)
        return {"rating": np.linalg.solve(left, right)}

    return _fit(counts, kernel, "rating double")


def _newton(gradient: Callable[[np.ndarray], tuple[np.ndarray, np.ndarray]], x: np.ndarray, steps: int, most: float = np.inf) -> np.ndarray:
    """Newton's method; no entry moves by more than ``most`` in a step, so flat starts do not overshoot."""
    for _ in range(steps):
        g, hess = gradient(x)
        step = np.linalg.solve(hess, g)
        step = step * min(1.0, most / max(np.abs(step).max(), 1e-300))
        x = x - step
        if np.abs(step).max() < 1e-7:
            break
    return x


def bradley_terry(counts: DataFrame, ridge: float = 1.0, soft: float | None = None) -> DataFrame:
    """Logistic ratings with a home term, by Newton's method."""

    def kernel(rows: pd.DataFrame, teams: list[int]) -> dict[str, list[float]]:
        h, a, margin, n = _sides(rows, teams)
        y = 0.5 + 0.5 * np.tanh(margin / soft) if soft else (np.sign(margin) + 1) / 2
        pull = np.append(np.full(len(teams), ridge), 1e-3)

        def gradient(b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            p = 1 / (1 + np.exp(-(b[h] - b[a] + b[-1])))
            return normal_side(h, a, n * (p - y), len(teams)) + pull * b, normal_matrix(h, a, n * np.maximum(p * (1 - p), 1e-9), len(teams)) + np.diag(pull)

        fit = _newton(gradient, np.zeros(len(teams) + 1), 12)
        return {"rating": fit[:-1], "edge": [fit[-1]] * len(teams)}

    return _fit(counts, kernel, "rating double, edge double")


def poisson(counts: DataFrame, ridge: float = 1.0) -> DataFrame:
    """Attack and defence of independent Poisson goals, with a mean and a home term."""

    def kernel(rows: pd.DataFrame, teams: list[int]) -> dict[str, list[float]]:
        h, a, _, n = _sides(rows, teams)
        t = len(teams)
        # a row for each side of a game: who scores, against whom, at home or not
        scorer, other = np.concatenate((h, a)), t + np.concatenate((a, h))
        at_home = np.repeat([1.0, 0.0], len(rows))
        goals, w = np.concatenate((rows.home_goals, rows.away_goals)).astype(float), np.concatenate((n, n))
        pull = np.append(np.full(2 * t, ridge), [0.0, 1e-3])
        extra = np.append(np.full(2 * t, ridge), [1e-3, 1e-3])
        mean_at, edge_at = np.full(2 * len(rows), 2 * t), np.full(2 * len(rows), 2 * t + 1)
        signed = ((scorer, 1.0), (other, -1.0), (mean_at, 1.0), (edge_at, at_home))

        def gradient(b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            mean = np.exp(b[scorer] - b[other] + b[2 * t] + b[2 * t + 1] * at_home)
            side, square = pull * b, np.diag(extra)
            for one, x in signed:
                side += np.bincount(one, x * w * (mean - goals), 2 * t + 2)
                for two, y in signed:
                    np.add.at(square, (one, two), x * y * w * mean)
            return side, square

        start = np.zeros(2 * t + 2)
        start[2 * t] = np.log(max(0.5, (w * goals).sum() / max(1.0, w.sum())))
        fit = _newton(gradient, start, 10)
        return {"attack": fit[:t], "defence": fit[t : 2 * t], "mean": [fit[2 * t]] * t, "edge": [fit[2 * t + 1]] * t}

    return _fit(counts, kernel, "attack double, defence double, mean double, edge double")


def outcomes(home: np.ndarray, away: np.ndarray, most: int = 30) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Win, tie and loss chances of pairs of independent Poisson counts, each cut at ``most``."""

    def chances(mean: np.ndarray) -> np.ndarray:
        steps = np.concatenate((np.ones((len(mean), 1)), mean[:, None] / np.arange(1, most + 1)), axis=1)
        return np.exp(-mean)[:, None] * np.cumprod(steps, axis=1)

    one, two = chances(np.asarray(home, float)), chances(np.asarray(away, float))
    below = lambda x: np.cumsum(x, axis=1) - x
    return (one * below(two)).sum(axis=1), (one * two).sum(axis=1), (two * below(one)).sum(axis=1)


def outcome(home_mean: float, away_mean: float, most: int = 30) -> tuple[float, float, float]:
    """``outcomes`` of one pair."""
    win, tie, loss = outcomes(np.array([home_mean]), np.array([away_mean]), most)
    return float(win[0]), float(tie[0]), float(loss[0])


def elo(games: DataFrame, group: str, k: float = 20, edge: float = 50, margins: str = "log") -> DataFrame:
    """Elo before every game, and what the favourite's chance was. Games of a group go by in (day, id) order; a task holds a day and the points.

    ``margins``: none, log (a tie counts one half) or 538 (log, less for big favourites).
    """
    options = [{"k": k, "edge": edge, "margins": margins}]

    def each(league: models.League, columns: models.Columns) -> list:
        _, day, home, away, hg, ag, game = columns
        h, a = league.numbered(home, away)
        bank, out = league.banks[0], []
        for i in range(len(game)):
            one = slice(i, i + 1)
            out.append((1500 + bank.points[0, h[i]], 1500 + bank.points[0, a[i]], 1 / (1 + 10 ** (-bank.gap(h[one], a[one])[0, 0] / 400))))
            league.learn(h[one], a[one], hg[one], ag[one], int(day[0]))
        return [game, *np.array(out).T]

    return models.through_days(models.in_order(games, group), lambda: [models.Elo(options)], "game_id long, home_elo double, away_elo double, p_home double", each)


def kalman(games: DataFrame, group: str, drift: float = 0.01, noise: float = 6.0, start: float = 2.0, cap: float = 6.0) -> DataFrame:
    """Strengths as random walks seen through capped margins: final mean and variance per team, and the home edge. A task holds a day and the state."""
    options = [{"drift": drift, "noise": noise, "start": start, "cap": cap}]

    def each(league: models.League, columns: models.Columns) -> list:
        _, day, home, away, hg, ag, _ = columns
        league.learn(*league.numbered(home, away), hg, ag, int(day[0]))
        return []

    def last(name: int, league: models.League) -> list:
        bank = league.banks[0]
        teams = np.array(list(league.place), np.int64)
        return [np.full(len(teams), name, np.int64), teams, bank.mean[0, 1:], np.diag(bank.cov[0])[1:], np.full(len(teams), bank.mean[0, 0])]

    return models.through_days(models.in_order(games, group), lambda: [models.Kalman(options)], f"{group} long, team long, rating double, variance double, edge double", each, last)


def logistic(x: np.ndarray, y: np.ndarray, w: np.ndarray, ridge: float = 1.0, start: np.ndarray | None = None) -> np.ndarray:
    """Ridge logistic fit of soft labels on standardised signals: intercept and slopes on the original scale. ``start``: a fit to begin from, such as yesterday's."""
    mean = np.average(x, axis=0, weights=w)
    spread = np.sqrt(np.maximum(((x - mean) ** 2 * w[:, None]).sum(axis=0) / max(w.sum() - 1, 1), 1e-12))
    z = np.column_stack((np.ones(len(x)), (x - mean) / spread))
    pull = np.append(1e-6, np.full(x.shape[1], ridge))

    def gradient(b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        p = 1 / (1 + np.exp(-(z @ b)))
        return z.T @ (w * (p - y)) + pull * b, (z * (w * np.maximum(p * (1 - p), 1e-9))[:, None]).T @ z + np.diag(pull)

    first = np.zeros(z.shape[1]) if start is None else np.append(start[0] + start[1:] @ mean, start[1:] * spread)
    fit = _newton(gradient, first, 30)
    return np.concatenate(([fit[0] - (fit[1:] * mean / spread).sum()], fit[1:] / spread))


def walk_forward(signals: DataFrame, group: str, at_least: int = 30, ridge: float = 1.0) -> DataFrame:
    """Chances from a logistic fit on games of earlier days only, refitted for every day.

    ``signals``: group, day, signal (whole number), half_points. Rows are first counted by (day, signal, half_points), so a fit
    sees counts, and predictions are made once per (day, signal). Every month of a group is a task of its own: it starts from the
    counts of all earlier months, which are running sums over the months, and adds its days.
    """
    month = F.date_trunc("month", F.col("day").cast("timestamp"))
    counts = signals.groupBy(group, "day", "signal", "half_points").agg(F.count("*").alias("n")).withColumn("month", month)
    monthly = counts.groupBy(group, "month", "signal", "half_points").agg(F.sum("n").alias("n"))
    grid = monthly.select(group, "month").distinct().join(monthly.select(group, "signal", "half_points").distinct(), group)
    earlier = Window.partitionBy(group, "signal", "half_points").orderBy("month").rowsBetween(Window.unboundedPreceding, -1)
    filled = grid.join(monthly, [group, "month", "signal", "half_points"], "left")
    known = filled.select(group, "month", F.lit(None).cast("timestamp").alias("day"), "signal", "half_points", F.sum("n").over(earlier).alias("n")).where("n > 0")
    tasks = counts.select(group, "month", F.col("day").cast("timestamp").alias("day"), "signal", "half_points", "n").unionByName(known)

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        signal, half = np.unique(rows.signal.to_numpy()), np.array([0, 1, 2])
        held = np.zeros((len(signal), 3))
        at = (np.searchsorted(signal, rows.signal.to_numpy()), rows.half_points.to_numpy(int))
        past, n = rows.day.isna().to_numpy(), rows.n.to_numpy(float)
        np.add.at(held, (at[0][past], at[1][past]), n[past])
        out: list[pd.DataFrame] = []
        fit = None
        for day, places in sorted(rows[~past].groupby("day").indices.items()):
            places = np.flatnonzero(~past)[places]
            k, y = np.nonzero(held)
            if held.sum() >= at_least:
                fit = logistic(signal[k][:, None].astype(float), half[y] / 2, held[k, y], ridge, fit)
                now = signal[np.unique(at[0][places])]
                out.append(pd.DataFrame({group: rows[group].iloc[0], "day": day, "signal": now, "p": 1 / (1 + np.exp(-(fit[0] + fit[1] * now)))}))
            np.add.at(held, (at[0][places], at[1][places]), n[places])
        return pd.concat(out) if out else pd.DataFrame({group: [], "day": pd.to_datetime([]), "signal": [], "p": []})

    # few bytes, much work: a given number of partitions is not coalesced
    parts = int(signals.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return tasks.repartition(parts, group, "month").groupBy(group, "month").applyInPandas(run, f"{group} long, day timestamp, signal long, p double").withColumn("day", F.to_date("day"))


def ordered_logit(signals: DataFrame, group: str, steps: int = 60) -> DataFrame:
    """Slope (per largest signal) and two cut points of loss / tie / win by the signal, by Newton's method with step halving, on counts."""
    counts = signals.groupBy(group, "signal", "half_points").agg(F.count("*").alias("n"))

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        s, y, n = rows.signal.to_numpy(float), rows.half_points.to_numpy(int), rows.n.to_numpy(float)
        s, n = s / max(np.abs(s).max(), 1), n / n.sum()
        zero, one = np.zeros(len(s)), np.ones(len(s))
        # how the two cut points less slope times signal depend on slope, low and high
        by_low, by_high = np.column_stack((-s, one, zero)), np.column_stack((-s, zero, one))

        def chances(b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
            low, high = 1 / (1 + np.exp(-(by_low @ b))), 1 / (1 + np.exp(-(by_high @ b)))
            return low, high, np.maximum(np.choose(y, (low, high - low, 1 - high)), 1e-12)

        def value(b: np.ndarray) -> float:
            return float((n * np.log(chances(b)[2])).sum()) if b[2] > b[1] else -np.inf

        b = np.array([0.5, -0.3, 0.3])
        best = value(b)
        for _ in range(steps):
            low, high, chance = chances(b)
            # slopes and curvatures of each outcome's chance by the two cut points
            f, g = np.where(y == 0, 1, np.where(y == 1, -1, 0)) * low * (1 - low), np.where(y == 1, 1, np.where(y == 2, -1, 0)) * high * (1 - high)
            ff, gg = f * (1 - 2 * low), g * (1 - 2 * high)
            slope = by_low.T @ (n * f / chance) + by_high.T @ (n * g / chance)
            weights = ((by_low, by_low, (f / chance) ** 2 - ff / chance), (by_high, by_high, (g / chance) ** 2 - gg / chance), (by_low, by_high, f * g / chance**2), (by_high, by_low, f * g / chance**2))
            curve = sum((x * (n * w)[:, None]).T @ z for x, z, w in weights) + 1e-9 * np.eye(3)
            move, size = np.linalg.solve(curve, slope), 1.0
            while size > 1e-8 and value(b + size * move) < best:
                size /= 2
            if size <= 1e-8 or np.abs(size * move).max() < 1e-10:
                break
            b = b + size * move
            best = value(b)
        return pd.DataFrame({group: [rows[group].iloc[0]], "slope": [b[0]], "low": [b[1]], "high": [b[2]], "log_likelihood": [best]})

    return counts.groupBy(group).applyInPandas(run, f"{group} long, slope double, low double, high double, log_likelihood double")
