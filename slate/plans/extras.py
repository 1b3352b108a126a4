"""Further sources, sinks, guards and joins, and ratings as of each day."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from slate.functions import times
from slate.operators import dedupe, ratings, score
from slate.plans import calendar, results, views
from slate.plans.calendar import _DUCK_LOCAL
from slate.plans.formats import PER_TEXT
from slate.plans.views import AS_OF, GAMES, RINKS, SESSIONS
from slate.session import scratch, table
from slate.sources import landed

_TIDY = lambda x: f"floor({x} * 1000000 + 0.5) / 1000000.0"


def source_paged_games(spark: SparkSession, sf: str) -> DataFrame:
    """Pages of games with a declared total: all of them or a failure; then scheduled games with a full UTC start and a place."""
    k = F.col("game_id")
    start = F.concat(F.date_format("day", "yyyy-MM-dd"), F.when(k % 10 == 0, "").otherwise("T19:30:00Z"))
    side = lambda c: F.struct(F.struct(F.col("division").cast("string").alias("title")).alias("division"), F.col(c).cast("string").alias("title"))
    item = F.struct(
        k.alias("gameId"), F.when(k % 3 == 0, "final").when(k % 3 == 1, "Scheduled").otherwise("upcoming").alias("status"), F.when(k % 11 == 0, "Practice").otherwise("Game").alias("gameType"),
        start.alias("timeStampZulu"), F.when(k % 13 != 0, F.concat(F.lit("Rink "), (k % 20).cast("string"))).alias("location"), side("home").alias("home"), side("away").alias("visitor"),
    )
    games = views.games(spark, sf)
    pages = games.groupBy((k / (4 * PER_TEXT)).cast("long").alias("source_id")).agg(F.collect_list(item).alias("data"))
    total = games.agg(F.count("*").alias("filtered"))
    texts = pages.crossJoin(F.broadcast(total)).select("source_id", F.to_json(F.struct("data", F.struct("filtered").alias("meta"))).alias("body"))
    return landed.paged_games(texts)


SOURCE_PAGED_GAMES = f"""WITH {GAMES}
SELECT game_id, CAST(day AS TIMESTAMP) + INTERVAL 1170 MINUTE AS start_ts, CAST(home AS VARCHAR) AS home, CAST(away AS VARCHAR) AS away, CAST(division AS VARCHAR) AS division, 'Rink ' || game_id % 20 AS location
FROM games WHERE game_id % 3 <> 0 AND game_id % 10 <> 0 AND game_id % 11 <> 0 AND game_id % 13 <> 0"""


def source_link_only(spark: SparkSession, sf: str) -> DataFrame:
    """Sources that are a link give no rows, with the columns of the others, and one note each."""
    rinks = views.rinks(spark, sf).withColumn("link_only", F.col("rink_id") % 7 == 0)
    rows = views.sessions(spark, sf).join(F.broadcast(rinks.where("NOT link_only").select("rink_id")), "rink_id", "left_semi").groupBy("rink_id").agg(F.count("*").alias("n"))
    return rinks.join(rows, "rink_id", "left").select("rink_id", F.coalesce("n", F.lit(0)).alias("n"), F.when(F.col("link_only"), "schedule is only linked").alias("note"))


SOURCE_LINK_ONLY = f"""WITH {SESSIONS}, n AS (SELECT rink_id, count(*) AS n FROM sessions GROUP BY 1)
SELECT r.rink_id, CASE WHEN r.rink_id % 7 = 0 THEN 0 ELSE coalesce(n, 0) END AS n, CASE WHEN r.rink_id % 7 = 0 THEN 'schedule is only linked' END AS note
FROM (SELECT unnest(range(0, 20)) AS rink_id) r LEFT JOIN n ON n.rink_id = r.rink_id"""


def offering_drives(spark: SparkSession, sf: str) -> DataFrame:
    """Offerings at rinks and at further venues, whose entry wins where both have an id, with the estimate of their slot."""
    rinks = views.rinks(spark, sf).select(F.col("rink_id").alias("venue_id"), "name", F.lit(0).alias("extra"))
    further = spark.range(15, 26).select(F.col("id").alias("venue_id"), F.concat(F.lit("Venue "), F.col("id").cast("string")).alias("name"), F.lit(1).alias("extra"))
    venues = rinks.unionByName(further).groupBy("venue_id").agg(F.max_by("name", "extra").alias("name"), F.max("extra").alias("extra"))
    offered = views.sessions(spark, sf).where("kind = 'purchase'").select("ingest_pos", F.when(F.col("ingest_pos") % 9 != 0, F.col("ingest_pos") % 30).alias("venue_id"))
    minutes = calendar.slot_join(spark, sf).select("ingest_pos", "minutes")
    return offered.join(F.broadcast(venues), "venue_id", "left").join(minutes, "ingest_pos").select("ingest_pos", "name", F.coalesce("extra", F.lit(0)).alias("extra"), F.when(F.col("name").isNotNull(), F.col("minutes")).alias("minutes"))


OFFERING_DRIVES = f"""WITH {SESSIONS}, {RINKS}, estimates AS (
  SELECT l_suppkey % 20 AS rink_id, dayofweek(l_shipdate) AS weekday, l_partkey % 96 AS quarter, min(600 + l_partkey % 1800) AS seconds FROM lineitem GROUP BY 1, 2, 3),
further AS (SELECT v AS venue_id, 'Venue ' || v AS name FROM (SELECT unnest(range(15, 26)) AS v)),
venues AS (SELECT venue_id, name, 1 AS extra FROM further UNION ALL SELECT rink_id, name, 0 FROM rinks WHERE rink_id NOT IN (SELECT venue_id FROM further)),
o AS (SELECT ingest_pos, rink_id, CASE WHEN ingest_pos % 9 <> 0 THEN ingest_pos % 30 END AS venue_id, {_DUCK_LOCAL("start_ts")} AS wall FROM sessions WHERE kind = 'purchase')
SELECT ingest_pos, v.name, coalesce(extra, 0) AS extra, CASE WHEN v.name IS NOT NULL THEN CAST(ceil(seconds / 60.0) AS BIGINT) END AS minutes
FROM o LEFT JOIN venues v ON v.venue_id = o.venue_id LEFT JOIN estimates e ON e.rink_id = o.rink_id AND e.weekday = dayofweek(wall) AND e.quarter = (hour(wall) * 60 + minute(wall)) // 15"""


def merge_offerings(spark: SparkSession, sf: str) -> DataFrame:
    """Three providers, each read by itself; what two of them give is taken from the first that has it. Counts by provider and kept rows."""
    rows = views.sessions(spark, sf).where("title RLIKE 'Clinic|Pick'")
    parts = [rows.where(F.col("ingest_pos") % (2 + i) == 0).select("rink_id", "start_ts", "title", "ingest_pos", F.lit(i).alias("provider")) for i in range(3)]
    merged = dedupe.keep_first(parts[0].unionByName(parts[1]).unionByName(parts[2]), [F.col("rink_id"), F.col("start_ts"), F.col("title")], [F.col("provider"), F.col("ingest_pos")])
    return merged.groupBy("provider").agg(F.count("*").alias("n"), F.min("start_ts").alias("first"))


MERGE_OFFERINGS = f"""WITH {SESSIONS}, p AS (SELECT s.*, i AS provider FROM sessions s, unnest(range(0, 3)) AS t(i) WHERE regexp_matches(title, 'Clinic|Pick') AND ingest_pos % (2 + i) = 0),
w AS (SELECT *, row_number() OVER (PARTITION BY rink_id, start_ts, title ORDER BY provider, ingest_pos) AS n FROM p)
SELECT CAST(provider AS INT) AS provider, count(*) AS n, min(start_ts) AS first FROM w WHERE n = 1 GROUP BY 1"""


def route_guard(spark: SparkSession, sf: str) -> DataFrame:
    """Estimates that can be kept: finite and above zero. The others count as failed and are asked for again."""
    value = F.when(F.col("event_id") % 17 == 0, F.lit(float("nan"))).when(F.col("event_id") % 19 == 0, F.lit(float("inf"))).otherwise(F.col("value") - F.lit(10.0))
    valid = (F.col("v") > 0) & ~F.isnan("v") & (F.col("v") < float("inf"))
    rows = table(spark, sf, "events").select((F.col("user_id") % 20).alias("rink_id"), value.alias("v"))
    return rows.groupBy("rink_id").agg(F.count_if(valid).alias("n_kept"), F.count_if(~F.coalesce(valid, F.lit(False))).alias("n_failed"))


ROUTE_GUARD = """WITH r AS (SELECT user_id % 20 AS rink_id, CASE WHEN event_id % 17 = 0 THEN CAST('nan' AS DOUBLE) WHEN event_id % 19 = 0 THEN CAST('inf' AS DOUBLE) ELSE value - 10.0 END AS v FROM events)
SELECT rink_id, count(*) FILTER (WHERE v > 0 AND isfinite(v)) AS n_kept, count(*) FILTER (WHERE NOT coalesce(v > 0 AND isfinite(v), false)) AS n_failed FROM r GROUP BY 1"""


def program_at_venue(spark: SparkSession, sf: str) -> DataFrame:
    """A venue's own program: sessions of its rink that the program's name is in, by local day."""
    rows = views.sessions(spark, sf).where("rink_id = 4 AND contains(lower(title), 'hockey')")
    return rows.groupBy(F.to_date(times.local(F.col("start_ts"))).alias("day")).agg(F.count("*").alias("n"))


PROGRAM_AT_VENUE = f"WITH {SESSIONS} SELECT CAST({_DUCK_LOCAL('start_ts')} AS DATE) AS day, count(*) AS n FROM sessions WHERE rink_id = 4 AND contains(lower(title), 'hockey') GROUP BY 1"


def catalog_top(spark: SparkSession, sf: str) -> DataFrame:
    """The 20 nearest venues by minutes, then miles, then id."""
    rows = table(spark, sf, "supplier").select(F.col("s_suppkey").alias("id"), (F.col("s_suppkey") * 37 % 50 + 5).alias("minutes"), ((F.col("s_suppkey") * 13 % 400) / 10).alias("miles"))
    return rows.orderBy("minutes", "miles", "id").limit(20)


CATALOG_TOP = "SELECT s_suppkey AS id, s_suppkey * 37 % 50 + 5 AS minutes, (s_suppkey * 13 % 400) / 10.0 AS miles FROM supplier ORDER BY 2, 3, 1 LIMIT 20"


def axis_scale(spark: SparkSession, sf: str) -> DataFrame:
    """Places of margins on an axis around zero, in percent: its span is the largest margin and one more, ten at least."""
    rows = views.games(spark, sf).groupBy("division", "home").agg(F.sum(F.col("home_goals") - F.col("away_goals")).alias("m"))
    spans = rows.groupBy("division").agg(F.greatest(F.lit(10), F.ceil(F.max(F.abs("m")) + 1)).cast("long").alias("span"))
    return rows.join(spans, "division").select("division", "home", "m", "span", score.rounded((F.col("m") + F.col("span")) / (F.col("span") * 2) * 100).alias("place"))


AXIS_SCALE = f"""WITH {GAMES}, r AS (SELECT division, home, CAST(sum(home_goals - away_goals) AS BIGINT) AS m FROM games GROUP BY 1, 2),
s AS (SELECT *, greatest(10, max(abs(m)) OVER (PARTITION BY division) + 1) AS span FROM r)
SELECT division, home, m, span, {_TIDY("(m + span) / CAST(span * 2 AS DOUBLE) * 100")} AS place FROM s"""


def coverage(spark: SparkSession, sf: str) -> DataFrame:
    """How many teams of a division have each kind of prior: last season's games, an outside rating, both, none."""
    teams = spark.range(views.TEAMS).select(F.col("id").alias("team"), (F.col("id") % 4).alias("division"))
    last = views.team_games(views.games(spark, sf)).where("day < '1995-01-20'").select("team").distinct().withColumn("played", F.lit(True))
    rows = teams.join(last, "team", "left").select("division", F.coalesce("played", F.lit(False)).alias("played"), (F.col("team") % 3 != 0).alias("rated"))
    return rows.groupBy("division").agg(
        F.count("*").alias("n"), F.count_if("played").alias("n_played"), F.count_if("rated").alias("n_rated"), F.count_if(F.col("played") & F.col("rated")).alias("n_both"), F.count_if(~F.col("played") & ~F.col("rated")).alias("n_none")
    )


COVERAGE = f"""WITH {GAMES}, p AS (SELECT home AS team FROM games WHERE day < DATE '1995-01-20' UNION SELECT away FROM games WHERE day < DATE '1995-01-20'),
r AS (SELECT team % 4 AS division, team IN (SELECT team FROM p) AS played, team % 3 <> 0 AS rated FROM (SELECT unnest(range(0, {views.TEAMS})) AS team))
SELECT division, count(*) AS n, count(*) FILTER (WHERE played) AS n_played, count(*) FILTER (WHERE rated) AS n_rated, count(*) FILTER (WHERE played AND rated) AS n_both, count(*) FILTER (WHERE NOT played AND NOT rated) AS n_none FROM r GROUP BY 1"""


def publish_guard(spark: SparkSession, sf: str) -> DataFrame:
    """Upcoming sessions of a rink, published only if there are any and any has a route; else the job fails and the last files stay."""
    upcoming = views.sessions(spark, sf).where(F.col("start_ts") >= F.lit(AS_OF).cast("timestamp_ntz"))
    facts = upcoming.join(F.broadcast(views.rinks(spark, sf)), "rink_id", "left").groupBy("rink_id").agg(F.count("*").alias("n"), F.min("drive_minutes").alias("nearest"))
    return landed.guarded(facts, (F.coalesce(F.sum("n"), F.lit(0)) > 0) & (F.count("nearest") > 0), "nothing to publish")


PUBLISH_GUARD = f"WITH {SESSIONS}, {RINKS} SELECT s.rink_id, count(*) AS n, min(drive_minutes) AS nearest FROM sessions s LEFT JOIN rinks r ON r.rink_id = s.rink_id WHERE start_ts >= TIMESTAMP '{AS_OF}' GROUP BY 1"


def sink_results(spark: SparkSession, sf: str) -> DataFrame:
    """Scores by part and division, written as JSON lines and read back."""
    from slate.plans import more

    path = scratch(spark, "results")
    more.metric_table(spark, sf).write.json(path)
    return spark.read.schema("part string, division string, n long, accuracy double, brier double").json(path)


#: Loss a game beyond which the predictor counts as broken on these made-up results (an even chance has 0.693).
WORST = 1.0


def sink_model(spark: SparkSession, sf: str) -> DataFrame:
    """The shipped predictor as one JSON row, written only if its holdout loss is below ``WORST``, and read back; else the job fails and writes nothing."""
    rows = results._predicted(spark, sf).where("day >= '1999-01-01' AND p IS NOT NULL")
    own = score.prediction_scores(rows, F.col("p"), F.col("half"), []).select(F.col("n").alias("games"), score.rounded(F.col("log_loss")).alias("log_loss"))
    checked = landed.guarded(own, F.max("log_loss") < WORST, "the shipped predictor has stopped winning")
    path = scratch(spark, "model")
    checked.select(F.lit("shares").alias("name"), "games", "log_loss").coalesce(1).write.json(path)
    return spark.read.schema("name string, games long, log_loss double").json(path)


SINK_MODEL = f"""WITH {results._PREDICTED}, r AS (SELECT half / 2.0 AS y, greatest(0.000001, least(0.999999, p)) AS q FROM predicted WHERE day >= DATE '1999-01-01' AND p IS NOT NULL)
SELECT 'shares' AS name, count(*) AS games, {_TIDY("avg(-(y * ln(q) + (1.0 - y) * ln(1.0 - q)))")} AS log_loss FROM r"""

#: Variants of the least-squares ratings: cap, ridge, target, half-life in days (0: none).
VARIANTS = (("plain", 8.0, 1.0, "margin", 0.0), ("root", 8.0, 1.0, "sqrt", 0.0), ("result", 8.0, 4.0, "result", 0.0), ("recent", 5.0, 1.0, "margin", 120.0))


def massey_asof(spark: SparkSession, sf: str) -> DataFrame:
    """Expected margin of every game by each variant, from games of earlier days only."""
    variants = [(name, {"cap": cap, "ridge": ridge, "target": target, "half_life": half}) for name, cap, ridge, target, half in VARIANTS]
    return ratings.massey_by_day(views.games(spark, sf), variants, "division").select("variant", "game_id", "n_before", score.rounded(F.col("expected")).alias("expected"))


def calibrations(spark: SparkSession, sf: str) -> DataFrame:
    """Per season: intercept and slope of the win chance by the signal over the whole season, and those of the season before (0 and 0.52 without one)."""
    rows = results._walked(spark, sf).select(F.year("day").alias("season"), "signal", "half_points")
    return ratings.calibrated(rows)


QUERIES = {
    "source_paged_games": source_paged_games, "source_link_only": source_link_only, "offering_drives": offering_drives, "merge_offerings": merge_offerings,
    "route_guard": route_guard, "program_at_venue": program_at_venue, "catalog_top": catalog_top, "axis_scale": axis_scale, "coverage": coverage,
    "publish_guard": publish_guard, "sink_results": sink_results, "sink_model": sink_model, "massey_asof": massey_asof, "calibrations": calibrations,
}


def _results_sql() -> str:
    from slate.plans import more

    return more.METRIC_TABLE


SQL = {
    "source_paged_games": SOURCE_PAGED_GAMES, "source_link_only": SOURCE_LINK_ONLY, "offering_drives": OFFERING_DRIVES, "merge_offerings": MERGE_OFFERINGS,
    "route_guard": ROUTE_GUARD, "program_at_venue": PROGRAM_AT_VENUE, "catalog_top": CATALOG_TOP, "axis_scale": AXIS_SCALE, "coverage": COVERAGE,
    "publish_guard": PUBLISH_GUARD, "sink_results": _results_sql(), "sink_model": SINK_MODEL,
}
