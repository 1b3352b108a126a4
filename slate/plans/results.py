"""Queries over games: what was known before a day, records, strength of schedule, scores of predictions, ratings."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from slate.operators import asof, ratings, score
from slate.plans import views
from slate.plans.views import GAMES, TEAM_GAMES
from slate.session import table

TG = f"{GAMES}, {TEAM_GAMES}"
_KNOWN = f"""{TG}, known AS (
  SELECT team, day, game_id, gf, ga, half_points,
         count(*) OVER w AS n_before, coalesce(sum(half_points) OVER w, 0) AS half_before, max(day) OVER w AS last_day
  FROM team_games WINDOW w AS (PARTITION BY team ORDER BY datediff('day', DATE '1970-01-01', day) RANGE BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))"""


def _tg(spark: SparkSession, sf: str) -> DataFrame:
    return views.team_games(views.games(spark, sf))


def prior_counts(spark: SparkSession, sf: str) -> DataFrame:
    """Games that each side played on earlier days."""
    games = views.games(spark, sf)
    return asof.per_game(games, asof.before(views.team_games(games)), {"prior": F.col("n_before")}).select("game_id", "home_prior", "away_prior")


PRIOR_COUNTS = f"""WITH {_KNOWN}
SELECT g.game_id, h.n_before AS home_prior, a.n_before AS away_prior FROM games g
JOIN known h ON h.game_id = g.game_id AND h.team = g.home JOIN known a ON a.game_id = g.game_id AND a.team = g.away"""


def rest_days(spark: SparkSession, sf: str) -> DataFrame:
    """Days since each side's last earlier game, at most 14; 14 where there is none."""
    games = views.games(spark, sf)
    rest = F.least(F.lit(14), F.coalesce(F.datediff("day", "last_day"), F.lit(14))).cast("long")
    return asof.per_game(games, asof.before(views.team_games(games)), {"rest": rest}).select("game_id", "home_rest", "away_rest")


REST_DAYS = f"""WITH {_KNOWN}, rest AS (SELECT team, game_id, least(14, coalesce(datediff('day', last_day, day), 14)) AS r FROM known)
SELECT g.game_id, h.r AS home_rest, a.r AS away_rest FROM games g
JOIN rest h ON h.game_id = g.game_id AND h.team = g.home JOIN rest a ON a.game_id = g.game_id AND a.team = g.away"""


def last_n_form(spark: SparkSession, sf: str) -> DataFrame:
    return asof.last_n(_tg(spark, sf), 5)


LAST_N_FORM = f"""WITH {TG}, ordered AS (
  SELECT *, row_number() OVER (PARTITION BY team ORDER BY day, game_id) AS k,
         count(*) OVER (PARTITION BY team ORDER BY datediff('day', DATE '1970-01-01', day) RANGE BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS n_before FROM team_games),
days AS (SELECT DISTINCT team, day, n_before FROM ordered)
SELECT d.team, d.day, count(o.game_id) AS n_last, CAST(coalesce(sum(o.half_points), 0) AS BIGINT) AS half_last
FROM days d LEFT JOIN ordered o ON o.team = d.team AND o.k <= d.n_before AND o.k > d.n_before - 5 GROUP BY d.team, d.day"""


def streak(spark: SparkSession, sf: str) -> DataFrame:
    return asof.streaks(_tg(spark, sf))


STREAK = f"""WITH {TG}, signed AS (SELECT *, half_points - 1 AS sign, row_number() OVER (PARTITION BY team ORDER BY day, game_id) AS k FROM team_games),
runs AS (SELECT *, k - row_number() OVER (PARTITION BY team, sign ORDER BY k) AS run FROM signed)
SELECT team, game_id, CAST(sign * row_number() OVER (PARTITION BY team, sign, run ORDER BY k) AS BIGINT) AS streak FROM runs"""


def last_result(spark: SparkSession, sf: str) -> DataFrame:
    """Each team's last result before a day, less one half; 0 where there is none."""
    known = asof.before(_tg(spark, sf))
    return known.select("team", "day", F.coalesce(F.col("last_half_before") / 2 - 0.5, F.lit(0.0)).alias("last_result"))


LAST_RESULT = f"""WITH {TG}, daily AS (SELECT team, day, max_by(half_points, game_id) AS h FROM team_games GROUP BY team, day)
SELECT team, day, coalesce(lag(h) OVER (PARTITION BY team ORDER BY day) / 2 - 0.5, 0.0) AS last_result FROM daily"""


def decay_form(spark: SparkSession, sf: str) -> DataFrame:
    """Goal difference of the last eight games of earlier days, with weights halving every four games."""
    tg = _tg(spark, sf)
    numbered = asof._numbered(tg).withColumn("diff", F.col("gf") - F.col("ga"))
    days = numbered.select("team", "day", "n_before").distinct()
    back = days.select("team", "day", F.explode(F.sequence(F.lit(0), F.lit(7))).alias("back"), "n_before").withColumn("k", F.col("n_before") - F.col("back"))
    seen = back.join(numbered.select("team", "k", "diff"), ["team", "k"])
    # the eight weights as sums by weight, in one fixed order, so that partitions do not matter
    sums = [F.coalesce(F.sum(F.when(F.col("back") == b, F.col("diff"))), F.lit(0)) for b in range(8)]
    held = [F.coalesce(F.max(F.when(F.col("back") == b, 1)), F.lit(0)) for b in range(8)]
    top, total = F.lit(0.0), F.lit(0.0)
    for b in range(8):
        top, total = top + sums[b] * (0.5 ** (b / 4)), total + held[b] * (0.5 ** (b / 4))
    return seen.groupBy("team", "day").agg(score.rounded(top / total).alias("decayed_diff"))


DECAY_FORM = f"""WITH {TG}, ordered AS (
  SELECT *, row_number() OVER (PARTITION BY team ORDER BY day, game_id) AS k,
         count(*) OVER (PARTITION BY team ORDER BY datediff('day', DATE '1970-01-01', day) RANGE BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS n_before FROM team_games),
days AS (SELECT DISTINCT team, day, n_before FROM ordered)
SELECT d.team, d.day, floor(({" + ".join(f"CAST(coalesce(sum(o.gf - o.ga) FILTER (WHERE d.n_before - o.k = {b}), 0) AS DOUBLE) * CAST({0.5 ** (b / 4)!r} AS DOUBLE)" for b in range(8))})
  / ({" + ".join(f"coalesce(max(1) FILTER (WHERE d.n_before - o.k = {b}), 0) * CAST({0.5 ** (b / 4)!r} AS DOUBLE)" for b in range(8))}) * 1000000 + 0.5) / 1000000.0 AS decayed_diff
FROM days d JOIN ordered o ON o.team = d.team AND o.k <= d.n_before AND o.k > d.n_before - 8 GROUP BY d.team, d.day"""


def lag_meetings(spark: SparkSession, sf: str) -> DataFrame:
    """Per unordered pair: meetings, and how often the winner of one meeting won the next."""
    games = views.games(spark, sf)
    low, high = F.least("home", "away"), F.greatest("home", "away")
    sign = F.signum(F.col("home_goals") - F.col("away_goals")) * F.when(F.col("home") == low, 1).otherwise(-1)
    rows = games.select(low.alias("low"), high.alias("high"), "day", "game_id", sign.cast("long").alias("sign"))
    before = F.lag("sign").over(Window.partitionBy("low", "high").orderBy("day", "game_id"))
    return rows.withColumn("before", before).groupBy("low", "high").agg(F.count("*").alias("meetings"), F.count_if((F.col("before") == F.col("sign")) & (F.col("sign") != 0)).alias("repeats"))


LAG_MEETINGS = f"""WITH {GAMES}, signed AS (
  SELECT least(home, away) AS low, greatest(home, away) AS high, day, game_id,
         sign(home_goals - away_goals) * CASE WHEN home = least(home, away) THEN 1 ELSE -1 END AS s FROM games),
lagged AS (SELECT *, lag(s) OVER (PARTITION BY low, high ORDER BY day, game_id) AS b FROM signed)
SELECT low, high, count(*) AS meetings, count(*) FILTER (WHERE b = s AND s <> 0) AS repeats FROM lagged GROUP BY low, high"""


def split(spark: SparkSession, sf: str) -> DataFrame:
    """Games with five earlier ones on both sides; training ends at the first day boundary after 60 percent of them."""
    eligible = prior_counts(spark, sf).where("home_prior >= 5 AND away_prior >= 5").join(views.games(spark, sf).select("game_id", "day"), "game_id")
    days = eligible.groupBy("day").agg(F.count("*").alias("n"))
    upto = Window.orderBy("day")
    running = days.select("day", "n", F.sum("n").over(upto).alias("upto"), F.sum("n").over(Window.orderBy("day").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)).alias("total"))
    cut = running.agg(F.min(F.when(F.col("upto") >= F.floor(F.col("total") * 0.6), F.col("day"))).alias("cut"))
    part = F.when(F.col("day") <= F.col("cut"), "train").otherwise("holdout")
    return eligible.crossJoin(F.broadcast(cut)).groupBy(part.alias("part")).agg(F.count("*").alias("n"), F.min("day").alias("first_day"), F.max("day").alias("last_day"))


SPLIT = f"""WITH {_KNOWN}, eligible AS (
  SELECT g.game_id, g.day FROM games g JOIN known h ON h.game_id = g.game_id AND h.team = g.home JOIN known a ON a.game_id = g.game_id AND a.team = g.away
  WHERE h.n_before >= 5 AND a.n_before >= 5),
days AS (SELECT day, sum(count(*)) OVER (ORDER BY day) AS upto, sum(count(*)) OVER () AS total FROM eligible GROUP BY day),
cut AS (SELECT min(day) AS cut FROM days WHERE upto >= floor(total * 0.6))
SELECT CASE WHEN day <= cut THEN 'train' ELSE 'holdout' END AS part, count(*) AS n, min(day) AS first_day, max(day) AS last_day FROM eligible, cut GROUP BY 1"""


def running_ties(spark: SparkSession, sf: str) -> DataFrame:
    """Share of ties among the games of earlier days; one tenth where there are none."""
    days = views.games(spark, sf).groupBy("day").agg(F.count("*").alias("n"), F.count_if(F.col("home_goals") == F.col("away_goals")).alias("t"))
    earlier = Window.orderBy("day").rowsBetween(Window.unboundedPreceding, -1)
    return days.select("day", F.coalesce(F.sum("t").over(earlier) / F.sum("n").over(earlier), F.lit(0.1)).alias("tie_rate"))


RUNNING_TIES = f"""WITH {GAMES}, days AS (SELECT day, count(*) AS n, count(*) FILTER (WHERE home_goals = away_goals) AS t FROM games GROUP BY day)
SELECT day, coalesce(CAST(sum(t) OVER w AS DOUBLE) / sum(n) OVER w, 0.1) AS tie_rate FROM days WINDOW w AS (ORDER BY day ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"""


def record(spark: SparkSession, sf: str) -> DataFrame:
    return score.records(_tg(spark, sf))


RECORD = f"""WITH {TG}
SELECT team, count(*) AS games, count(*) FILTER (WHERE half_points = 2) AS wins, count(*) FILTER (WHERE half_points = 0) AS losses, count(*) FILTER (WHERE half_points = 1) AS ties,
       CAST(sum(half_points) AS BIGINT) AS points, CAST(sum(gf) AS BIGINT) AS gf, CAST(sum(ga) AS BIGINT) AS ga, CAST(sum(greatest(-3, least(3, gf - ga))) AS BIGINT) AS capped_diff
FROM team_games GROUP BY team"""


def pythag(spark: SparkSession, sf: str) -> DataFrame:
    rows = score.records(_tg(spark, sf))
    return rows.select("team", score.rounded(score.pythagoras(F.col("gf"), F.col("ga"), F.col("games"), 2.0)).alias("share"))


PYTHAG = f"""WITH rec AS ({RECORD}), r AS (SELECT team, pow(gf / games + 0.5, 2.0) AS a, pow(ga / games + 0.5, 2.0) AS b FROM rec)
SELECT team, floor(a / (a + b) * 1000000 + 0.5) / 1000000.0 AS share FROM r"""


def rpi(spark: SparkSession, sf: str) -> DataFrame:
    rows = score.schedule_strength(_tg(spark, sf))
    return rows.select("team", score.rounded(F.col("wp")).alias("wp"), score.rounded(F.col("owp")).alias("owp"), score.rounded(F.col("wp") * 0.25 + F.col("owp") * 0.5 + F.col("oowp") * 0.25).alias("rpi"))


RPI = f"""WITH {TG}, own AS (SELECT team, sum(half_points) / (2.0 * count(*)) AS wp FROM team_games GROUP BY team),
second AS (SELECT g.team, avg(o.wp) AS owp FROM team_games g JOIN own o ON o.team = g.opp GROUP BY g.team),
third AS (SELECT g.team, avg(s.owp) AS oowp FROM team_games g JOIN second s ON s.team = g.opp GROUP BY g.team)
SELECT team, floor(wp * 1000000 + 0.5) / 1000000.0 AS wp, floor(owp * 1000000 + 0.5) / 1000000.0 AS owp,
       floor((wp * 0.25 + owp * 0.5 + oowp * 0.25) * 1000000 + 0.5) / 1000000.0 AS rpi FROM own JOIN second USING (team) JOIN third USING (team)"""


def sos(spark: SparkSession, sf: str) -> DataFrame:
    """Mean goal difference, plus the mean of the opponents' means."""
    tg = _tg(spark, sf)
    pairs = tg.groupBy("team", "opp").agg(F.count("*").alias("n"), F.sum(F.col("gf") - F.col("ga")).alias("d"))
    own = pairs.groupBy("team").agg((F.sum("d") / F.sum("n")).alias("diff"))
    theirs = pairs.join(own.select(F.col("team").alias("opp"), F.col("diff").alias("opp_diff")), "opp").groupBy("team").agg((F.sum(F.col("n") * F.col("opp_diff")) / F.sum("n")).alias("opp"))
    return own.join(theirs, "team").select("team", score.rounded(F.col("diff")).alias("diff"), score.rounded(F.col("diff") + F.col("opp")).alias("adjusted"))


SOS = f"""WITH {TG}, own AS (SELECT team, sum(gf - ga) / CAST(count(*) AS DOUBLE) AS diff FROM team_games GROUP BY team),
theirs AS (SELECT g.team, avg(o.diff) AS opp FROM team_games g JOIN own o ON o.team = g.opp GROUP BY g.team)
SELECT team, floor(diff * 1000000 + 0.5) / 1000000.0 AS diff, floor((diff + opp) * 1000000 + 0.5) / 1000000.0 AS adjusted FROM own JOIN theirs USING (team)"""


def h2h(spark: SparkSession, sf: str) -> DataFrame:
    """For every game: earlier meetings of the pair, and the home side's half points in them."""
    tg = _tg(spark, sf)
    days = tg.groupBy("team", "opp", "day").agg(F.count("*").alias("n"), F.sum("half_points").alias("half"))
    earlier = Window.partitionBy("team", "opp").orderBy("day").rowsBetween(Window.unboundedPreceding, -1)
    known = days.select(F.col("team").alias("home"), F.col("opp").alias("away"), "day", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("met"), F.coalesce(F.sum("half").over(earlier), F.lit(0)).alias("half"))
    return views.games(spark, sf).join(known, ["home", "away", "day"]).select("game_id", "met", "half")


H2H = f"""WITH {TG}
SELECT g.game_id, count(t.game_id) AS met, CAST(coalesce(sum(t.half_points), 0) AS BIGINT) AS half
FROM games g LEFT JOIN team_games t ON t.team = g.home AND t.opp = g.away AND t.day < g.day GROUP BY g.game_id"""

# Points of the hand-made score.
BASE, LOST_TO, NARROW, NO_LOSS, PRIOR_LOSS, PRIOR_ROUT, PRIOR_WIN, HOME, AWAY, NO_GOALS, ANY_WIN, SCALE, LOW, HIGH = 42, 16, 10, -6, -18, -10, 12, 7, -5, -4, 8, 8, 6, 90
# End of fixed values.


def legacy_score(spark: SparkSession, sf: str) -> DataFrame:
    """A hand-made score for every pair of teams that met: records, narrow losses of the other side, the latest meeting."""
    tg = _tg(spark, sf)
    rec = score.records(tg).select("team", "games", "wins", "gf")
    lost = tg.groupBy("team").agg(F.count_if(F.col("half_points") == 0).alias("lost"), F.count_if((F.col("half_points") == 0) & (F.col("ga") - F.col("gf") == 1)).alias("narrow"))
    latest = tg.groupBy("team", "opp").agg(F.max_by(F.struct("half_points", "gf", "ga", "at_home"), F.struct("day", "game_id")).alias("last"))
    rows = latest.join(rec, "team").join(rec.select(F.col("team").alias("opp"), F.col("games").alias("o_games"), F.col("wins").alias("o_wins")), "opp").join(lost.withColumnRenamed("team", "opp"), "opp")
    case = lambda test, yes, no=0: F.when(test, yes).otherwise(no)
    prior = case(F.col("last.half_points") == 0, F.lit(PRIOR_LOSS) + case(F.col("last.ga") - F.col("last.gf") >= 5, PRIOR_ROUT), case(F.col("last.half_points") == 2, PRIOR_WIN))
    share = F.floor((F.col("wins") / F.greatest("games", F.lit(1)) - F.col("o_wins") / F.greatest("o_games", F.lit(1))) * SCALE + F.lit(0.5))
    points = (
        F.lit(BASE)
        + case(F.col("lost") > 0, F.lit(LOST_TO) + case(F.col("narrow") > 0, NARROW), case(F.col("o_games") > 0, NO_LOSS))
        + prior
        + case(F.col("last.at_home"), HOME, AWAY)
        + case((F.col("gf") == 0) & (F.col("games") > 0), NO_GOALS)
        + case(F.col("wins") > 0, ANY_WIN)
        + share
    )
    return rows.select("team", "opp", F.greatest(F.lit(LOW), F.least(F.lit(HIGH), points)).cast("long").alias("score"))


LEGACY_SCORE = f"""WITH {TG}, rec AS (SELECT team, count(*) AS games, count(*) FILTER (WHERE half_points = 2) AS wins, sum(gf) AS gf,
    count(*) FILTER (WHERE half_points = 0) AS lost, count(*) FILTER (WHERE half_points = 0 AND ga - gf = 1) AS narrow FROM team_games GROUP BY team),
latest AS (SELECT team, opp, half_points, gf, ga, at_home FROM (SELECT *, row_number() OVER (PARTITION BY team, opp ORDER BY day DESC, game_id DESC) AS rn FROM team_games) WHERE rn = 1)
SELECT l.team, l.opp, CAST(greatest({LOW}, least({HIGH}, {BASE}
  + CASE WHEN o.lost > 0 THEN {LOST_TO} + CASE WHEN o.narrow > 0 THEN {NARROW} ELSE 0 END WHEN o.games > 0 THEN {NO_LOSS} ELSE 0 END
  + CASE WHEN l.half_points = 0 THEN {PRIOR_LOSS} + CASE WHEN l.ga - l.gf >= 5 THEN {PRIOR_ROUT} ELSE 0 END WHEN l.half_points = 2 THEN {PRIOR_WIN} ELSE 0 END
  + CASE WHEN l.at_home THEN {HOME} ELSE {AWAY} END + CASE WHEN r.gf = 0 AND r.games > 0 THEN {NO_GOALS} ELSE 0 END + CASE WHEN r.wins > 0 THEN {ANY_WIN} ELSE 0 END
  + floor((r.wins / greatest(r.games, 1) - o.wins / greatest(o.games, 1)) * {SCALE} + 0.5))) AS BIGINT) AS score
FROM latest l JOIN rec r ON r.team = l.team JOIN rec o ON o.team = l.opp"""


def _predicted(spark: SparkSession, sf: str) -> DataFrame:
    """Games with a closed-form chance of the home side: from earlier win shares, null where a side has no earlier game."""
    games = views.games(spark, sf)
    known = asof.before(views.team_games(games))
    rows = asof.per_game(games, known, {"n": F.col("n_before"), "half": F.col("half_points_before")})
    p = F.when((F.col("home_n") > 0) & (F.col("away_n") > 0), (F.col("home_half") * F.col("away_n") + F.col("away_n") * F.col("home_n")) / (F.col("home_half") * F.col("away_n") + F.col("away_half") * F.col("home_n") + F.col("home_n") * F.col("away_n") * 2))
    half = F.when(F.col("home_goals") > F.col("away_goals"), 2).when(F.col("home_goals") == F.col("away_goals"), 1).otherwise(0).cast("long")
    return rows.select("game_id", "day", "division", "home", "away", "home_goals", "away_goals", p.alias("p"), half.alias("half"), F.least("home_n", "away_n").alias("least_n"))


_PREDICTED = f"""{_KNOWN}, predicted AS (
  SELECT g.*, CASE WHEN h.n_before > 0 AND a.n_before > 0 THEN (h.half_before * a.n_before + a.n_before * h.n_before) / CAST(h.half_before * a.n_before + a.half_before * h.n_before + h.n_before * a.n_before * 2 AS DOUBLE) END AS p,
         CASE WHEN home_goals > away_goals THEN 2 WHEN home_goals = away_goals THEN 1 ELSE 0 END AS half, least(h.n_before, a.n_before) AS least_n
  FROM games g JOIN known h ON h.game_id = g.game_id AND h.team = g.home JOIN known a ON a.game_id = g.game_id AND a.team = g.away)"""


def _tidy(df: DataFrame, *by: str) -> DataFrame:
    return df.select(*by, "n", *[score.rounded(F.col(c)).alias(c) for c in ("accuracy", "log_loss", "brier")])


_SCORES = """count(*) AS n, floor(avg(CASE WHEN p = 0.5 OR half = 1 THEN 0.5 WHEN (p > 0.5) = (half = 2) THEN 1.0 ELSE 0.0 END) * 1000000 + 0.5) / 1000000.0 AS accuracy,
  floor(avg(-(half / 2.0 * ln(greatest(0.000001, least(0.999999, p))) + (1.0 - half / 2.0) * ln(1.0 - greatest(0.000001, least(0.999999, p))))) * 1000000 + 0.5) / 1000000.0 AS log_loss,
  floor(avg((p - half / 2.0) * (p - half / 2.0)) * 1000000 + 0.5) / 1000000.0 AS brier"""


def score_metrics(spark: SparkSession, sf: str) -> DataFrame:
    return _tidy(score.prediction_scores(_predicted(spark, sf), F.col("p"), F.col("half"), ["division"]), "division")


SCORE_METRICS = f"WITH {_PREDICTED} SELECT division, {_SCORES} FROM predicted WHERE p IS NOT NULL GROUP BY division"


def calibration(spark: SparkSession, sf: str) -> DataFrame:
    """Tenths of the predicted chance: rows, mean prediction, mean result."""
    rows = _predicted(spark, sf).where("p IS NOT NULL")
    return rows.groupBy(F.least(F.lit(9), F.floor(F.col("p") * 10)).cast("long").alias("tenth")).agg(
        F.count("*").alias("n"), score.rounded(F.avg("p")).alias("mean_p"), score.rounded(F.sum("half") / (F.count("*") * 2)).alias("mean_y")
    )


CALIBRATION = f"""WITH {_PREDICTED}
SELECT CAST(least(9, floor(p * 10)) AS BIGINT) AS tenth, count(*) AS n, floor(avg(p) * 1000000 + 0.5) / 1000000.0 AS mean_p,
       floor(sum(half) / (count(*) * 2.0) * 1000000 + 0.5) / 1000000.0 AS mean_y FROM predicted WHERE p IS NOT NULL GROUP BY 1"""
EDGES = [0.5, 0.52, 0.55, 0.6, 0.7, 1.0]


def bands_conf(spark: SparkSession, sf: str) -> DataFrame:
    """Scores by how sure the favourite's chance is, in bands [low, high); the last takes what is beyond."""
    rows = _predicted(spark, sf).where("p IS NOT NULL").withColumn("band", score.band(F.greatest("p", F.lit(1.0) - F.col("p")), EDGES))
    return _tidy(score.prediction_scores(rows, F.col("p"), F.col("half"), ["band"]), "band")


_BAND_SQL = "CASE " + " ".join(f"WHEN greatest(p, 1.0 - p) >= {EDGES[i]} AND greatest(p, 1.0 - p) < {EDGES[i + 1]} THEN {i}" for i in range(5)) + " ELSE 4 END"
BANDS_CONF = f"WITH {_PREDICTED} SELECT CAST({_BAND_SQL} AS BIGINT) AS band, {_SCORES} FROM predicted WHERE p IS NOT NULL GROUP BY 1"


def group_stats(spark: SparkSession, sf: str) -> DataFrame:
    """Per division: games, tie rate, home share, mean margin, blowouts, upsets among decided games."""
    rows = _predicted(spark, sf)
    margin = F.abs(F.col("home_goals") - F.col("away_goals"))
    decided = (F.col("half") != 1) & F.col("p").isNotNull() & (F.col("p") != 0.5)
    return rows.groupBy("division").agg(
        F.count("*").alias("games"),
        F.count_if(F.col("half") == 1).alias("ties"),
        score.rounded(F.sum("half") / (F.count("*") * 2)).alias("home_share"),
        score.rounded(F.sum(margin) / F.count("*")).alias("mean_margin"),
        F.count_if(margin >= 5).alias("blowouts"),
        F.count_if(decided & ((F.col("p") > 0.5) != (F.col("half") == 2))).alias("upsets"),
        F.count_if(decided).alias("decided"),
    )


GROUP_STATS = f"""WITH {_PREDICTED}
SELECT division, count(*) AS games, count(*) FILTER (WHERE half = 1) AS ties, floor(sum(half) / (count(*) * 2.0) * 1000000 + 0.5) / 1000000.0 AS home_share,
       floor(sum(abs(home_goals - away_goals)) / CAST(count(*) AS DOUBLE) * 1000000 + 0.5) / 1000000.0 AS mean_margin, count(*) FILTER (WHERE abs(home_goals - away_goals) >= 5) AS blowouts,
       count(*) FILTER (WHERE half <> 1 AND p <> 0.5 AND (p > 0.5) <> (half = 2)) AS upsets, count(*) FILTER (WHERE half <> 1 AND p IS NOT NULL AND p <> 0.5) AS decided
FROM predicted GROUP BY division"""


def corr_slope(spark: SparkSession, sf: str) -> DataFrame:
    """Correlation and least-squares slope of the margin on the difference of earlier games, from whole-number sums."""
    rows = _predicted(spark, sf).select((F.col("home") - F.col("away")).alias("x"), (F.col("home_goals") - F.col("away_goals")).alias("y"))
    s = rows.agg(F.count("*").alias("n"), *[F.sum(e).alias(a) for a, e in (("sx", F.col("x")), ("sy", F.col("y")), ("sxx", F.col("x") * F.col("x")), ("sxy", F.col("x") * F.col("y")), ("syy", F.col("y") * F.col("y")))])
    cov, vx, vy = F.expr("n * sxy - sx * sy"), F.expr("n * sxx - sx * sx"), F.expr("n * syy - sy * sy")
    return s.select("n", score.rounded(cov / F.sqrt(vx.cast("double") * vy)).alias("corr"), score.rounded(cov / vx).alias("slope"))


CORR_SLOPE = f"""WITH {GAMES}, s AS (
  SELECT count(*) AS n, sum(home - away) AS sx, sum(home_goals - away_goals) AS sy, sum((home - away) * (home - away)) AS sxx,
         sum((home - away) * (home_goals - away_goals)) AS sxy, sum((home_goals - away_goals) * (home_goals - away_goals)) AS syy FROM games)
SELECT n, floor((n * sxy - sx * sy) / sqrt(CAST(n * sxx - sx * sx AS DOUBLE) * (n * syy - sy * sy)) * 1000000 + 0.5) / 1000000.0 AS corr,
       floor((n * sxy - sx * sy) / CAST(n * sxx - sx * sx AS DOUBLE) * 1000000 + 0.5) / 1000000.0 AS slope FROM s"""


def order_stat_band(spark: SparkSession, sf: str) -> DataFrame:
    """The margin's 10 and 90 percent order statistics per division."""
    rows = views.games(spark, sf).withColumn("margin", F.col("home_goals") - F.col("away_goals"))
    return score.order_statistic(rows, "margin", [0.1, 0.9], ["division"])


ORDER_STAT_BAND = f"""WITH {GAMES}, sorted AS (SELECT division, list(home_goals - away_goals ORDER BY home_goals - away_goals) AS m FROM games GROUP BY division)
SELECT division, len(m) AS n, m[CAST(least(len(m) - 1, floor(0.1 * len(m))) AS BIGINT) + 1] AS q10, m[CAST(least(len(m) - 1, floor(0.9 * len(m))) AS BIGINT) + 1] AS q90 FROM sorted"""


def centered(spark: SparkSession, sf: str) -> DataFrame:
    """Team points less their division's mean."""
    rows = score.records(_tg(spark, sf)).withColumn("division", F.col("team") % 4)
    return score.centred(rows, "points", "division").select("team", score.rounded(F.col("centred")).alias("centred"))


CENTERED = f"""WITH rec AS ({RECORD})
SELECT team, floor((points - sum(points) OVER (PARTITION BY team % 4) / CAST(count(*) OVER (PARTITION BY team % 4) AS DOUBLE)) * 1000000 + 0.5) / 1000000.0 AS centred FROM rec"""


def longest_name(spark: SparkSession, sf: str) -> DataFrame:
    """Per nation: the longest part type seen for its suppliers' numbers; ties keep the first."""
    rows = table(spark, sf, "part").select((F.col("p_partkey") % 25).alias("nation"), "p_type", "p_partkey")
    return rows.groupBy("nation").agg(F.max_by("p_type", F.struct(F.length("p_type"), -F.col("p_partkey"))).alias("name"), F.count("*").alias("n"))


LONGEST_NAME = """SELECT nation, name, n FROM (
  SELECT p_partkey % 25 AS nation, p_type AS name, count(*) OVER (PARTITION BY p_partkey % 25) AS n,
         row_number() OVER (PARTITION BY p_partkey % 25 ORDER BY length(p_type) DESC, p_partkey) AS rn FROM part) WHERE rn = 1"""


def two_rows_one_game(spark: SparkSession, sf: str) -> DataFrame:
    """Mirrored rows, one per side, folded into one row per game with its score oriented."""
    tg = _tg(spark, sf)
    home, away = F.when(F.col("at_home"), F.col("team")).otherwise(F.col("opp")), F.when(F.col("at_home"), F.col("opp")).otherwise(F.col("team"))
    goals = [F.when(F.col("at_home"), F.col(a)).otherwise(F.col(b)) for a, b in (("gf", "ga"), ("ga", "gf"))]
    rows = tg.select("game_id", "day", home.alias("home"), away.alias("away"), goals[0].alias("home_goals"), goals[1].alias("away_goals"))
    return rows.groupBy("day", "home", "away").agg(
        F.count("*").alias("n_rows"), F.min_by("home_goals", "game_id").alias("home_goals"), F.min_by("away_goals", "game_id").alias("away_goals"), F.min("game_id").alias("game_id")
    )


TWO_ROWS_ONE_GAME = f"""WITH {GAMES}
SELECT day, home, away, 2 * count(*) AS n_rows, min_by(home_goals, game_id) AS home_goals, min_by(away_goals, game_id) AS away_goals, min(game_id) AS game_id FROM games GROUP BY day, home, away"""


def perspective_unpivot(spark: SparkSession, sf: str) -> DataFrame:
    return _tg(spark, sf)


PERSPECTIVE_UNPIVOT = f"WITH {TG} SELECT game_id, day, team, opp, gf, ga, at_home, half_points FROM team_games"


def _counts(spark: SparkSession, sf: str) -> DataFrame:
    return ratings.pair_counts(views.games(spark, sf), "division")


def _walked(spark: SparkSession, sf: str) -> DataFrame:
    """Chances of every eligible game from earlier games' point difference, refitted daily within a division."""
    games = views.games(spark, sf)
    rows = asof.per_game(games, asof.before(views.team_games(games)), {"n": F.col("n_before"), "half": F.col("half_points_before")}).where("home_n >= 2 AND away_n >= 2")
    half = F.when(F.col("home_goals") > F.col("away_goals"), 2).when(F.col("home_goals") == F.col("away_goals"), 1).otherwise(0).cast("long")
    # the difference of win shares in whole hundredths
    signal = F.floor((F.col("home_half") / F.col("home_n") - F.col("away_half") / F.col("away_n")) * 50 + F.lit(0.5))
    return rows.select("game_id", "day", "division", signal.cast("long").alias("signal"), half.alias("half_points"))


def walk_forward(spark: SparkSession, sf: str) -> DataFrame:
    rows = _walked(spark, sf)
    return rows.join(ratings.walk_forward(rows, "division"), ["division", "day", "signal"], "left").select("game_id", "day", "division", "signal", "half_points", "p")


def model_select(spark: SparkSession, sf: str) -> DataFrame:
    """Of the predictors: ten best by training loss, those near the best on the holdout, the simplest of them."""
    walked = walk_forward(spark, sf).select("game_id", "day", "p", F.col("half_points").alias("half"), F.lit("walk-forward").alias("model"), F.lit(3).alias("complexity"))
    closed = _predicted(spark, sf).select("game_id", "day", "p", "half", F.lit("shares").alias("model"), F.lit(1).alias("complexity"))
    even = _predicted(spark, sf).select("game_id", "day", F.lit(0.5).alias("p"), "half", F.lit("even").alias("model"), F.lit(0).alias("complexity"))
    rows = walked.unionByName(closed).unionByName(even).withColumn("part", F.when(F.col("day") < "1999-01-01", "train").otherwise("holdout"))
    scores = score.prediction_scores(rows, F.col("p"), F.col("half"), ["model", "complexity", "part"])
    wide = scores.groupBy("model", "complexity").agg(F.max(F.when(F.col("part") == "train", F.col("log_loss"))).alias("train"), F.max(F.when(F.col("part") == "holdout", F.col("log_loss"))).alias("holdout"))
    top = wide.orderBy("train", "model").limit(10)
    near = top.crossJoin(F.broadcast(top.agg(F.min("holdout").alias("best")))).where("holdout <= best + 0.002")
    return near.orderBy("complexity", "holdout", "model").limit(1).select("model", "complexity", "train", "holdout")


def predict(spark: SparkSession, sf: str) -> DataFrame:
    """Margins and chances of all pairs of a division's teams, from its Massey fit, with the shipped calibration."""
    # Intercept and slope of the calibration.
    intercept, slope = -0.0166, 0.5221
    fit = ratings.massey(_counts(spark, sf), home_prior=(0.2, 20.0))
    other = fit.select("league", F.col("team").alias("away"), F.col("rating").alias("away_rating"))
    margin = F.col("rating") - F.col("away_rating") + F.col("edge")
    pairs = fit.join(other, "league").where("team <> away")
    return pairs.select("league", F.col("team").alias("home"), "away", score.rounded(margin, 4).alias("margin"), score.rounded(score.sigmoid(F.lit(intercept) + F.lit(slope) * margin), 4).alias("p_home"))


QUERIES = {
    "prior_counts": prior_counts, "rest_days": rest_days, "last_n_form": last_n_form, "streak": streak, "last_result": last_result, "decay_form": decay_form,
    "lag_meetings": lag_meetings, "split": split, "running_ties": running_ties, "record": record, "pythag": pythag, "rpi": rpi, "sos": sos, "h2h": h2h,
    "legacy_score": legacy_score, "score_metrics": score_metrics, "calibration": calibration, "bands_conf": bands_conf, "group_stats": group_stats,
    "corr_slope": corr_slope, "order_stat_band": order_stat_band, "centered": centered, "longest_name": longest_name, "two_rows_one_game": two_rows_one_game,
    "perspective_unpivot": perspective_unpivot, "walk_forward": walk_forward, "model_select": model_select, "predict": predict,
    "massey": lambda spark, sf: ratings.massey(_counts(spark, sf)), "colley": lambda spark, sf: ratings.colley(_counts(spark, sf)),
    "bradley_terry": lambda spark, sf: ratings.bradley_terry(_counts(spark, sf)), "poisson": lambda spark, sf: ratings.poisson(_counts(spark, sf)),
    "elo": lambda spark, sf: ratings.elo(views.games(spark, sf), "division"), "kalman": lambda spark, sf: ratings.kalman(views.games(spark, sf), "division"),
    "ordered_logit": lambda spark, sf: ratings.ordered_logit(_walked(spark, sf), "division"),
}
SQL = {
    "prior_counts": PRIOR_COUNTS, "rest_days": REST_DAYS, "last_n_form": LAST_N_FORM, "streak": STREAK, "last_result": LAST_RESULT, "decay_form": DECAY_FORM,
    "lag_meetings": LAG_MEETINGS, "split": SPLIT, "running_ties": RUNNING_TIES, "record": RECORD, "pythag": PYTHAG, "rpi": RPI, "sos": SOS, "h2h": H2H,
    "legacy_score": LEGACY_SCORE, "score_metrics": SCORE_METRICS, "calibration": CALIBRATION, "bands_conf": BANDS_CONF, "group_stats": GROUP_STATS,
    "corr_slope": CORR_SLOPE, "order_stat_band": ORDER_STAT_BAND, "centered": CENTERED, "longest_name": LONGEST_NAME, "two_rows_one_game": TWO_ROWS_ONE_GAME,
    "perspective_unpivot": PERSPECTIVE_UNPIVOT,
}
