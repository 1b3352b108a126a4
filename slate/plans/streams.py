"""Stream forms of the snapshot operators, over the events as landed files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from slate.functions import text
from slate.operators import score
from slate.plans import feeds, views
from slate.session import scratch
from slate.streaming import ratings, snapshots, versions


def stream_dedupe(spark: SparkSession, sf: str) -> DataFrame:
    """The (user, type, hour) keys of all events, each once."""
    stream = snapshots.landed(spark, sf, "events").select("user_id", "event_type", F.date_trunc("hour", "ts").cast("timestamp_ntz").alias("hour"))
    return snapshots.run(snapshots.first_of(stream, ["user_id", "event_type", "hour"]))


STREAM_DEDUPE = "SELECT DISTINCT user_id, event_type, date_trunc('hour', ts) AS hour FROM events"


def stream_latest(spark: SparkSession, sf: str) -> DataFrame:
    """The latest event of every user and type, folded batch by batch."""
    stream = snapshots.landed(spark, sf, "events").select("user_id", "event_type", "ts", "event_id")
    return snapshots.merged(stream, lambda kept, batch: snapshots.latest(kept, batch, ["user_id", "event_type"], ["ts", "event_id"]), "user_id long, event_type string, ts timestamp_ntz, event_id long")


STREAM_LATEST = "SELECT user_id, event_type, ts, event_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) AS rn FROM events) WHERE rn = 1"


def stream_daily(spark: SparkSession, sf: str) -> DataFrame:
    """Events per type and day, from a stream with complete state."""
    stream = snapshots.landed(spark, sf, "events").select("event_type", F.to_date("ts").alias("day"))
    fold = lambda kept, batch: kept.unionByName(batch.groupBy("event_type", "day").agg(F.count("*").alias("n"))).groupBy("event_type", "day").agg(F.sum("n").alias("n"))
    return snapshots.merged(stream, fold, "event_type string, day date, n long")


STREAM_DAILY = "SELECT event_type, CAST(ts AS DATE) AS day, count(*) AS n FROM events GROUP BY 1, 2"

#: Options of the kept Kalman strengths.
KALMAN = {"drift": 0.01, "noise": 9, "start": 3, "cap": 8}


def stream_kalman(spark: SparkSession, sf: str) -> DataFrame:
    """Expected margins of all games from strengths that are kept across three runs: games of three spans of days land and are read one after the other."""
    folder, root = scratch(spark, "landed"), scratch(spark, "kept")
    games = views.games(spark, sf).withColumnRenamed("division", "league")
    found = None
    for span in ("day < '1997-01-01'", "day >= '1997-01-01' AND day < '1999-06-01'", "day >= '1999-06-01'"):
        ratings.land(games.where(span), folder)
        found = ratings.run(spark, folder, root, KALMAN)
    return found.select("league", "game_id", "day", "n_before_sides", score.rounded(F.col("expected")).alias("expected"))


def label_loop(spark: SparkSession, sf: str) -> DataFrame:
    """Labels after two runs, the first over views alone: the second looks up what the first has learnt and judges only what is new. A length stands for the model."""
    table = versions.Versions(spark, scratch(spark, "labels"), versions.LABELS)
    rows = feeds._normal(spark, sf).where(text.title_class(F.col("title_norm")).isNull()).select("kind", F.lit("*").alias("rink_id"), "title_norm")
    judge = lambda titles: titles.withColumn("category", F.when(F.length("title_norm") % 2 == 0, "public_skate").otherwise("private_rental"))
    versions.learn(table, rows.where("kind = 'view'"), judge, 1)
    return versions.learn(table, rows, judge, 2)


LABEL_LOOP = f"""WITH {views.SESSIONS}, normal AS (SELECT kind, {text.sql_normal_title("title")} AS title_norm FROM sessions WHERE {feeds._CLASS_SQL} IS NULL)
SELECT '*' AS rink_id, title_norm, CASE WHEN length(title_norm) % 2 = 0 THEN 'public_skate' ELSE 'private_rental' END AS category, 'model' AS source,
  CAST(CASE WHEN bool_or(kind = 'view') THEN 1 ELSE 2 END AS BIGINT) AS run
FROM normal GROUP BY title_norm"""


QUERIES = {"stream_dedupe": stream_dedupe, "stream_latest": stream_latest, "stream_daily": stream_daily, "stream_kalman": stream_kalman, "label_loop": label_loop}
SQL = {"label_loop": LABEL_LOOP, "stream_dedupe": STREAM_DEDUPE, "stream_latest": STREAM_LATEST, "stream_daily": STREAM_DAILY}
