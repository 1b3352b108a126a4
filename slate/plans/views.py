"""Relations of the schedule and results model, projected from the generic tables.

Every relation exists twice: as a DataFrame and as SQL for DuckDB, with the same whole-number and timestamp arithmetic.
``AS_OF`` is the moment that queries are asked for; nothing reads a clock.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from slate.session import table

AS_OF = "2024-01-15 12:00:00"

TITLES = (
    "Stick & Puck", "Kids Stick and Puck (Ages 6-12)", "Adult Stick & Puck 18+", "Family Stick & Puck", "Public Hockey", "Lunchtime Hockey",
    "Coach's Ice", "Freestyle Session", "Public Skating", "Learn to Skate", "Youth Hockey League", "Rink Closed", "Holiday - no ice",
    "Pick-up Hockey", "Sticks and Pucks", "Birthday Party", "Varsity Practice", "Glacier Hour", "Northern Lights", "Open  Ice",
    "Drop-in Hockey", "Women's Pickup", "Skills Clinic", "Zephyr", "Free Skate", "Private lesson ice", "Figure Skating Practice",
)
_TITLE = "CASE (event_id % 9) + 9 * (length(event_type) % 3) " + " ".join("WHEN {} THEN '{}'".format(i, t.replace("'", "''")) for i, t in enumerate(TITLES)) + " END"


def _spark_string(sql: str) -> str:
    """Spark reads '' inside a literal as two literals; a backslash escapes the quote instead."""
    return sql.replace("''", "\\'")


def sessions(spark: SparkSession, sf: str) -> DataFrame:
    start = F.date_trunc("minute", "ts")
    minutes = F.expr("make_interval(0, 0, 0, 0, 0, CAST(20 + event_id % 70 AS INT), 0)")
    return table(spark, sf, "events").select(
        F.col("event_id").alias("ingest_pos"),
        (F.col("user_id") % 20).alias("rink_id"),
        start.cast("timestamp_ntz").alias("start_ts"),
        (start.cast("timestamp_ntz") + minutes).alias("end_ts"),
        F.expr(_spark_string(_TITLE)).alias("title"),
        F.expr("CASE event_id % 3 WHEN 1 THEN 'A' WHEN 2 THEN 'B' END").alias("surface"),
        (F.col("event_id") % 97 == 0).alias("all_day"),
        F.col("event_type").alias("kind"),
        F.col("value"),
    )


SESSIONS = f"""sessions AS (
  SELECT event_id AS ingest_pos, user_id % 20 AS rink_id, date_trunc('minute', ts) AS start_ts,
         date_trunc('minute', ts) + to_minutes(CAST(20 + event_id % 70 AS INT)) AS end_ts, {_TITLE} AS title,
         CASE event_id % 3 WHEN 1 THEN 'A' WHEN 2 THEN 'B' END AS surface, event_id % 97 = 0 AS all_day, event_type AS kind, value
  FROM events)"""


def rinks(spark: SparkSession, sf: str) -> DataFrame:
    ids = spark.range(20).select(F.col("id").alias("rink_id"))
    names = table(spark, sf, "supplier").groupBy((F.col("s_suppkey") % 20).alias("rink_id")).agg(F.min("s_name").alias("name"), F.min("s_nationkey").alias("nation"))
    nations = table(spark, sf, "nation").select(F.col("n_nationkey").alias("nation"), F.col("n_name").alias("town"))
    return ids.join(names, "rink_id", "left").join(nations, "nation", "left").select("rink_id", "name", "town", (F.col("rink_id") * 7 % 45 + 5).alias("drive_minutes"))


RINKS = """rinks AS (
  SELECT i.rink_id, name, n_name AS town, i.rink_id * 7 % 45 + 5 AS drive_minutes
  FROM (SELECT unnest(range(0, 20)) AS rink_id) i
  LEFT JOIN (SELECT s_suppkey % 20 AS rink_id, min(s_name) AS name, min(s_nationkey) AS nation FROM supplier GROUP BY 1) s ON s.rink_id = i.rink_id
  LEFT JOIN nation ON n_nationkey = nation)"""

TEAMS = 24


def games(spark: SparkSession, sf: str) -> DataFrame:
    home = F.col("o_custkey") % TEAMS
    return table(spark, sf, "orders").select(
        F.col("o_orderkey").alias("game_id"),
        F.to_date("o_orderdate").alias("day"),
        home.alias("home"),
        ((home + 1 + F.col("o_orderkey") % (TEAMS - 1)) % TEAMS).alias("away"),
        (F.col("o_orderkey") % 7).alias("home_goals"),
        ((F.col("o_custkey") * 3 + F.col("o_orderkey")) % 6).alias("away_goals"),
        (home % 4).alias("division"),
    )


GAMES = f"""games AS (
  SELECT o_orderkey AS game_id, CAST(o_orderdate AS DATE) AS day, o_custkey % {TEAMS} AS home,
         (o_custkey % {TEAMS} + 1 + o_orderkey % {TEAMS - 1}) % {TEAMS} AS away, o_orderkey % 7 AS home_goals,
         (o_custkey * 3 + o_orderkey) % 6 AS away_goals, o_custkey % {TEAMS} % 4 AS division
  FROM orders)"""


def team_games(games_: DataFrame) -> DataFrame:
    """One row per (game, team): both perspectives of every game. ``half_points``: 2, 1 or 0 for win, tie or loss."""
    sides = F.array(
        F.struct(F.col("home").alias("team"), F.col("away").alias("opp"), F.col("home_goals").alias("gf"), F.col("away_goals").alias("ga"), F.lit(True).alias("at_home")),
        F.struct(F.col("away").alias("team"), F.col("home").alias("opp"), F.col("away_goals").alias("gf"), F.col("home_goals").alias("ga"), F.lit(False).alias("at_home")),
    )
    rows = games_.select("game_id", "day", F.inline(sides))
    return rows.withColumn("half_points", F.when(F.col("gf") > F.col("ga"), 2).when(F.col("gf") == F.col("ga"), 1).otherwise(0).cast("long"))


TEAM_GAMES = """team_games AS (
  SELECT *, CAST(CASE WHEN gf > ga THEN 2 WHEN gf = ga THEN 1 ELSE 0 END AS BIGINT) AS half_points FROM (
    SELECT game_id, day, home AS team, away AS opp, home_goals AS gf, away_goals AS ga, true AS at_home FROM games
    UNION ALL SELECT game_id, day, away, home, away_goals, home_goals, false FROM games))"""
