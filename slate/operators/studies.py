"""Studies over games: recent over-performance, priors, hindsight and leave-one-out ceilings, pairs, three-way chances.

As in ``ratings``, Spark reduces games to counts; the small fits that are left run once per league.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from slate.operators import asof, ratings, score


def residual_form(games: DataFrame, tg: DataFrame, group: str, n: int = 5, cap: int = 8) -> DataFrame:
    """Per team: the mean of capped margin less the fit's expected margin over its last ``n`` games."""
    fit = ratings.massey(ratings.pair_counts(games, group), cap=cap)
    own = fit.select("league", "team", "rating", "edge")
    other = fit.select("league", F.col("team").alias("opp"), F.col("rating").alias("opp_rating"))
    league = games.select("game_id", F.col(group).alias("league"))
    place = F.row_number().over(Window.partitionBy("team").orderBy(F.desc("day"), F.desc("game_id")))
    last = tg.withColumn("back", place).where(F.col("back") <= n).join(league, "game_id")
    expected = F.col("rating") - F.col("opp_rating") + F.when(F.col("at_home"), F.col("edge")).otherwise(-F.col("edge"))
    margin = F.greatest(F.lit(-cap), F.least(F.lit(cap), F.col("gf") - F.col("ga")))
    rows = last.join(own, ["league", "team"]).join(other, ["league", "opp"])
    return rows.groupBy("team").agg(F.count("*").alias("n"), score.rounded(F.avg(margin - expected)).alias("form"))


def centred_priors(external: DataFrame, teams: DataFrame, key: str, group: str) -> DataFrame:
    """Pre-season means: a team's earlier rating less its group's mean; teams without one get 0. Centred values sum to 0 per group."""
    known = score.centred(external, "rating", group).select(key, F.col("centred").alias("prior"))
    return teams.join(known, key, "left").withColumn("prior", F.coalesce("prior", F.lit(0.0)))


def massey_with_priors(counts: DataFrame, priors: DataFrame, ridge: float = 4.0, home: tuple[float, float] = (0.2, 20.0), cap: float = 8, share: float = 0.25) -> DataFrame:
    """Massey ratings that are drawn towards ``share`` times a pre-season mean instead of towards zero."""
    known = priors.select(F.col("league"), F.col("team"), F.col("prior"))

    def run(key: tuple, rows: pd.DataFrame, means: pd.DataFrame) -> pd.DataFrame:
        teams = sorted(set(rows.home) | set(rows.away))
        if not teams:
            return pd.DataFrame({"league": [], "team": [], "rating": [], "edge": []})
        at = {t: i for i, t in enumerate(teams)}
        h, a, n = rows.home.map(at).to_numpy(), rows.away.map(at).to_numpy(), rows.n.to_numpy(float)
        left = ratings.normal_matrix(h, a, n, len(teams)) + np.diag([ridge] * len(teams) + [1e-3 + home[1]])
        right = ratings.normal_side(h, a, n * np.clip((rows.home_goals - rows.away_goals).to_numpy(float), -cap, cap), len(teams))
        mean = dict(zip(means.team, means.prior, strict=True))
        right[:-1] += ridge * share * np.array([mean.get(t, 0.0) for t in teams])
        right[-1] += home[0] * home[1]
        fit = np.linalg.solve(left, right)
        return pd.DataFrame({"league": key[0], "team": teams, "rating": fit[:-1], "edge": fit[-1]})

    return counts.groupBy("league").cogroup(known.groupBy("league")).applyInPandas(run, "league long, team long, rating double, edge double")


def ceilings(counts: DataFrame, cap: float = 8, ridge: float = 1.0) -> DataFrame:
    """Per league: accuracy of a fit that has seen all games, and of one that leaves out the game it is asked about.

    A game is left out by a rank-one downdate of the solved system (Sherman-Morrison), not by a new fit.
    """

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        teams = sorted(set(rows.home) | set(rows.away))
        at = {t: i for i, t in enumerate(teams)}
        n, m = rows.n.to_numpy(float), np.clip((rows.home_goals - rows.away_goals).to_numpy(float), -cap, cap)
        h, a, k = rows.home.map(at).to_numpy(), rows.away.map(at).to_numpy(), len(teams)
        inverse = np.linalg.inv(ratings.normal_matrix(h, a, n, k) + np.diag([ridge] * k + [1e-3]))
        fit = inverse @ ratings.normal_side(h, a, n * m, k)
        seen = fit[h] - fit[a] + fit[k]
        own = np.diag(inverse)
        lever = own[h] + own[a] + own[k] - 2 * inverse[h, a] + 2 * inverse[h, k] - 2 * inverse[a, k]
        without = (seen - lever * m) / (1 - lever)
        hit = lambda p: float((n * np.where(m == 0, 0.5, np.sign(p) == np.sign(m))).sum() / n.sum())
        return pd.DataFrame({"league": [rows.league.iloc[0]], "games": [int(n.sum())], "hindsight": [hit(seen)], "left_out": [hit(without)]})

    return counts.groupBy("league").applyInPandas(run, "league long, games long, hindsight double, left_out double")


def pair_shares(tg: DataFrame) -> DataFrame:
    """For every (team, opp, day): the share of earlier meetings with one phantom tie, (sum + 1/2) / (n + 1)."""
    days = tg.groupBy("team", "opp", "day").agg(F.count("*").alias("n"), F.sum("half_points").alias("half"))
    earlier = Window.partitionBy("team", "opp").orderBy("day").rowsBetween(Window.unboundedPreceding, -1)
    met, half = F.coalesce(F.sum("n").over(earlier), F.lit(0)), F.coalesce(F.sum("half").over(earlier), F.lit(0))
    return days.select("team", "opp", "day", met.alias("met"), ((half + 1) / ((met + 1) * 2)).alias("share"))


def three_way_odds(margin: Column, slope: float, low: float, high: float) -> tuple[Column, Column, Column]:
    """Win, tie and loss chances of an ordered logit."""
    loss = score.sigmoid(F.lit(low) - F.lit(slope) * margin)
    not_win = score.sigmoid(F.lit(high) - F.lit(slope) * margin)
    return F.lit(1.0) - not_win, not_win - loss, loss


def margin_band(margin: Column, low: float, high: float) -> tuple[Column, Column]:
    """The band around a margin, from the error's order statistics, made symmetric outwards and rounded to halves."""
    wide = max(abs(low), abs(high))
    half = lambda x: F.floor(x * 2 + F.lit(0.5)) / F.lit(2.0)
    return half(margin - F.lit(wide)), half(margin + F.lit(wide))


def level(p: Column) -> Column:
    # Limits of the levels.
    return F.when(p >= 0.55, "likely").when(p >= 0.40, "even").when(p >= 0.20, "unlikely").otherwise("long shot")


def next_before(tg: DataFrame, k: int = 3) -> DataFrame:
    """For each (team, opp, day): the opponent's games of the k days it plays on before that day, counted."""
    opponents = asof.daily(tg).select(F.col("team").alias("opp"), F.col("day").alias("d"), "n", "half_points")
    ordered = Window.partitionBy("opp").orderBy("d").rowsBetween(-k, -1)
    known = opponents.select("opp", F.col("d").alias("day"), F.coalesce(F.sum("n").over(ordered), F.lit(0)).alias("recent_games"), F.coalesce(F.sum("half_points").over(ordered), F.lit(0)).alias("recent_half"))
    return tg.select("team", "opp", "day", "game_id").join(known, ["opp", "day"])
