"""Queries of the studies: form, priors, ceilings, pairs, odds and bands."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from slate.operators import ratings, score, studies
from slate.plans import views
from slate.plans.views import GAMES, TEAM_GAMES

TG = f"{GAMES}, {TEAM_GAMES}"


def _counts(spark: SparkSession, sf: str) -> DataFrame:
    return ratings.pair_counts(views.games(spark, sf), "division")


def residual_form(spark: SparkSession, sf: str) -> DataFrame:
    """Last games against the division's fit; a team's own division is that of its home games."""
    games = views.games(spark, sf)
    return studies.residual_form(games, views.team_games(games), "division")


def _priors(spark: SparkSession, sf: str) -> DataFrame:
    """Earlier ratings of two thirds of the teams, centred by tier."""
    teams = spark.range(views.TEAMS).select(F.col("id").alias("team"), (F.col("id") % 4).alias("tier"))
    external = teams.where("team % 3 <> 0").withColumn("rating", F.col("team") * 7 % 11)
    return studies.centred_priors(external, teams, "team", "tier")


def prior_means(spark: SparkSession, sf: str) -> DataFrame:
    return _priors(spark, sf).select("team", "tier", score.rounded(F.col("prior")).alias("prior"))


PRIOR_MEANS = f"""WITH t AS (SELECT team, team % 4 AS tier, team * 7 % 11 AS rating FROM (SELECT unnest(range(0, {views.TEAMS})) AS team)),
e AS (SELECT team, rating - avg(rating) OVER (PARTITION BY tier) AS c FROM t WHERE team % 3 <> 0)
SELECT t.team, tier, floor(coalesce(c, 0.0) * 1000000 + 0.5) / 1000000.0 AS prior FROM t LEFT JOIN e ON e.team = t.team"""


def massey_priors(spark: SparkSession, sf: str) -> DataFrame:
    leagues = spark.range(4).select(F.col("id").alias("league"))
    return studies.massey_with_priors(_counts(spark, sf), _priors(spark, sf).select("team", "prior").crossJoin(leagues))


def ceilings(spark: SparkSession, sf: str) -> DataFrame:
    return studies.ceilings(_counts(spark, sf))


def pair_shares(spark: SparkSession, sf: str) -> DataFrame:
    rows = studies.pair_shares(views.team_games(views.games(spark, sf)))
    return rows.select("team", "opp", "day", "met", score.rounded(F.col("share")).alias("share"))


PAIR_SHARES = f"""WITH {TG}, d AS (SELECT team, opp, day, count(*) AS n, sum(half_points) AS h FROM team_games GROUP BY 1, 2, 3),
s AS (SELECT team, opp, day, coalesce(sum(n) OVER w, 0) AS met, coalesce(sum(h) OVER w, 0) AS half FROM d WINDOW w AS (PARTITION BY team, opp ORDER BY day ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))
SELECT team, opp, day, CAST(met AS BIGINT) AS met, floor((half + 1) / ((met + 1) * 2.0) * 1000000 + 0.5) / 1000000.0 AS share FROM s"""

# Slope and cuts of the shipped three-way model, and the margin error's order statistics for later games.
SLOPE, LOW, HIGH = 0.5346, -0.3038, 0.3348
ERROR_LOW, ERROR_HIGH = -3.979, 4.1501
# End of fixed values.


def odds(spark: SparkSession, sf: str) -> DataFrame:
    """Three-way chances, level and margin band of every pair, from the difference of their mean goal differences."""
    rec = score.records(views.team_games(views.games(spark, sf))).select("team", ((F.col("gf") - F.col("ga")) / F.col("games")).alias("d"))
    pairs = rec.join(rec.select(F.col("team").alias("opp"), F.col("d").alias("o")), F.col("team") < F.col("opp"))
    margin = F.col("d") - F.col("o")
    win, tie, loss = studies.three_way_odds(margin, SLOPE, LOW, HIGH)
    low, high = studies.margin_band(margin, ERROR_LOW, ERROR_HIGH)
    chances = [score.rounded(c, 4).alias(n) for c, n in ((win, "win"), (tie, "tie"), (loss, "loss"))]
    return pairs.select("team", "opp", *chances, studies.level(win + tie / F.lit(2.0)).alias("level"), low.alias("band_low"), high.alias("band_high"))


_D = lambda x: f"CAST({x} AS DOUBLE)"
ODDS = f"""WITH {TG}, r AS (SELECT team, (sum(gf) - sum(ga)) / CAST(count(*) AS DOUBLE) AS d FROM team_games GROUP BY team),
p AS (SELECT a.team, b.team AS opp, a.d - b.d AS m FROM r a JOIN r b ON a.team < b.team),
o AS (SELECT *, 1.0 / (1.0 + exp(-({_D(LOW)} - {_D(SLOPE)} * m))) AS l, 1.0 / (1.0 + exp(-({_D(HIGH)} - {_D(SLOPE)} * m))) AS nw FROM p)
SELECT team, opp, floor((1.0 - nw) * 10000 + 0.5) / 10000.0 AS win, floor((nw - l) * 10000 + 0.5) / 10000.0 AS tie, floor(l * 10000 + 0.5) / 10000.0 AS loss,
       CASE WHEN 1.0 - nw + (nw - l) / 2.0 >= 0.55 THEN 'likely' WHEN 1.0 - nw + (nw - l) / 2.0 >= 0.40 THEN 'even' WHEN 1.0 - nw + (nw - l) / 2.0 >= 0.20 THEN 'unlikely' ELSE 'long shot' END AS level,
       floor((m - {_D(ERROR_HIGH)}) * 2 + 0.5) / 2.0 AS band_low, floor((m + {_D(ERROR_HIGH)}) * 2 + 0.5) / 2.0 AS band_high FROM o"""


def warm_ups(spark: SparkSession, sf: str) -> DataFrame:
    """For each side of a game: what its opponent did on its last three playing days before."""
    return studies.next_before(views.team_games(views.games(spark, sf))).select("game_id", "team", F.col("recent_games").cast("long").alias("recent_games"), F.col("recent_half").cast("long").alias("recent_half"))


WARM_UPS = f"""WITH {TG}, d AS (SELECT team, day, count(*) AS n, sum(half_points) AS h FROM team_games GROUP BY 1, 2),
w AS (SELECT team, day, coalesce(sum(n) OVER x, 0) AS rn, coalesce(sum(h) OVER x, 0) AS rh FROM d WINDOW x AS (PARTITION BY team ORDER BY day ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING))
SELECT g.game_id, g.team, CAST(rn AS BIGINT) AS recent_games, CAST(rh AS BIGINT) AS recent_half FROM team_games g JOIN w ON w.team = g.opp AND w.day = g.day"""

QUERIES = {
    "residual_form": residual_form, "prior_means": prior_means, "massey_priors": massey_priors, "ceilings": ceilings, "pair_shares": pair_shares, "odds": odds, "warm_ups": warm_ups,
}
SQL = {"prior_means": PRIOR_MEANS, "pair_shares": PAIR_SHARES, "odds": ODDS, "warm_ups": WARM_UPS}
