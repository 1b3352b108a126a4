"""Feeds and snapshots that are published as files, some of them broken, and read back with their checks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from slate.plans import views
from slate.plans.views import SESSIONS
from slate.session import scratch, table
from slate.sources import published

SEASON = "2024"


def source_published(spark: SparkSession, sf: str) -> DataFrame:
    """Events of every listed rink from its published feed, or what is wrong with it. Some feeds are made to be cut off, of another version, without rows, or missing."""
    rows = views.sessions(spark, sf).groupBy("rink_id").agg(F.collect_list(F.struct(F.col("ingest_pos").alias("id"), F.col("title"), F.col("value"))).alias("events"))
    k = F.col("rink_id")
    body = F.to_json(F.struct(F.when(k % 7 == 5, 2).otherwise(1).alias("version"), F.lit("2024-01-15T12:00:00Z").alias("fetchedAt"), F.when(k % 9 != 8, F.col("events")).alias("events")))
    folder = scratch(spark, "published")
    published.publish(rows.where("rink_id % 10 <> 9").select("rink_id", F.when(k % 7 == 3, F.substring(body, F.lit(1), F.length(body) - 5)).otherwise(body).alias("body")), folder, "rink_id")
    index = spark.range(22).select(F.col("id").alias("rink_id"))
    landed = published.files(spark, folder, "rink_id").withColumn("rink_id", F.col("rink_id").cast("long"))
    found = published.feeds(index, landed, "rink_id", "struct<id:bigint,title:string,value:double>", "events", 1)
    return found.select("rink_id", "error", "fetched_at", F.col("row.id").alias("event_id"), F.col("row.title").alias("title"))


SOURCE_PUBLISHED = f"""WITH {SESSIONS}, i AS (SELECT unnest(range(0, 22)) AS rink_id),
j AS (SELECT rink_id, CASE WHEN rink_id % 10 = 9 OR rink_id NOT IN (SELECT rink_id FROM sessions) THEN 'missing' WHEN rink_id % 7 = 3 THEN 'not json' WHEN rink_id % 7 = 5 THEN 'other version' WHEN rink_id % 9 = 8 THEN 'no rows' END AS error FROM i)
SELECT j.rink_id, error, CASE WHEN error IS NULL THEN '2024-01-15T12:00:00Z' END AS fetched_at, ingest_pos AS event_id, title
FROM j LEFT JOIN sessions s ON s.rink_id = j.rink_id AND error IS NULL"""


def source_snapshots(spark: SparkSession, sf: str) -> DataFrame:
    """Suppliers with their rating from whichever snapshots are of this version and season; the ratings are null where the snapshot that has them is not."""
    team = F.struct(F.col("s_suppkey").alias("id"), F.round(F.col("s_acctbal") / 100, 2).alias("rating"))
    lists = table(spark, sf, "supplier").groupBy((F.col("s_suppkey") % 4).alias("part")).agg(F.collect_list(team).alias("teams"))
    k = F.col("part")
    body = F.to_json(F.struct(F.when(k == 1, 2).otherwise(1).alias("version"), F.when(k == 2, "2023").otherwise(SEASON).alias("season"), F.when(k != 3, F.col("teams")).alias("teams")))
    folder = scratch(spark, "snapshots")
    published.publish(lists.select("part", body.alias("body")), folder, "part")
    right = (F.col("s.version") == 1) & (F.col("s.season") == SEASON)
    ratings = published.snapshot(published.files(spark, folder, "part"), "struct<id:bigint,rating:double>", "teams", right)
    return table(spark, sf, "supplier").select("s_suppkey", "s_name").join(ratings, F.col("s_suppkey") == F.col("id"), "left").select("s_suppkey", "s_name", "rating")


SOURCE_SNAPSHOTS = "SELECT s_suppkey, s_name, CASE WHEN s_suppkey % 4 = 0 THEN round(s_acctbal / 100, 2) END AS rating FROM supplier"

QUERIES = {"source_published": source_published, "source_snapshots": source_snapshots}
SQL = {"source_published": SOURCE_PUBLISHED, "source_snapshots": SOURCE_SNAPSHOTS}
