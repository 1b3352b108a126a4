"""Sources and sinks: texts in the supported formats are made from the tables, then parsed; SQL reads the tables directly."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from slate.functions import times
from slate.plans import views
from slate.plans.views import SESSIONS
from slate.session import scratch, table
from slate.sources import landed

#: Events of one landed text.
PER_TEXT = 50


def _texts(rows: DataFrame, item, open_: str = "[", close: str = "]", between: str = ",") -> DataFrame:
    """Landed texts of at most PER_TEXT rows each."""
    made = rows.select((F.col("ingest_pos") / PER_TEXT).cast("long").alias("source_id"), "ingest_pos", item.alias("item"))
    whole = made.groupBy("source_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("ingest_pos", "item"))), lambda x: x["item"]).alias("items"))
    return whole.select("source_id", F.concat(F.lit(open_), F.array_join("items", between), F.lit(close)).alias("body"))


def source_json_calendar(spark: SparkSession, sf: str) -> DataFrame:
    us = lambda c: F.date_format(c, "M/d/yyyy h:mm:ss a")
    item = F.to_json(F.struct(F.col("ingest_pos").alias("id"), F.replace(F.col("title"), F.lit("'"), F.lit("\\'")).alias("title"), us("start_ts").alias("start"), us("end_ts").alias("end"), F.col("all_day").alias("allDay")))
    return landed.calendar_json(_texts(views.sessions(spark, sf), item)).select("event_id", "title", "start_ts", "end_ts", "all_day")


SOURCE_JSON_CALENDAR = f"WITH {SESSIONS} SELECT ingest_pos AS event_id, title, start_ts, end_ts, all_day FROM sessions"


def source_nested_days(spark: SparkSession, sf: str) -> DataFrame:
    clock = lambda c: F.date_format(c, "HH:mm")
    event = F.struct(F.col("ingest_pos").cast("string").alias("eventKey"), F.col("title").alias("eventName"), clock("start_ts").alias("startTime"), clock("end_ts").alias("endTime"), F.when(F.col("ingest_pos") % 2 == 0, clock("start_ts")).otherwise("").alias("usageStartTime"))
    item = F.to_json(F.struct(F.date_format("start_ts", "yyyy-MM-dd").alias("date"), F.lit(False).alias("closed"), F.array(event).alias("eventInfo")))
    return landed.nested_days(_texts(views.sessions(spark, sf), item, '{"dayInfo":[', "]}")).select(F.col("event_key").cast("long").alias("event_id"), "title", "start_ts", "end_ts")


SOURCE_NESTED_DAYS = f"WITH {SESSIONS} SELECT ingest_pos AS event_id, title, start_ts, end_ts FROM sessions"


def source_ical(spark: SparkSession, sf: str) -> DataFrame:
    utc = lambda c: F.date_format(c, "yyyyMMdd'T'HHmmss'Z'")
    zoned = F.concat(F.lit(f"DTSTART;TZID={times.ZONE}:"), F.date_format(times.local(F.col("start_ts")), "yyyyMMdd'T'HHmmss"))
    start = F.when(F.col("ingest_pos") % 2 == 0, zoned).otherwise(F.concat(F.lit("DTSTART:"), utc("start_ts")))
    folded = F.regexp_replace("title", "^(.{4})(.+)$", "$1\n $2")
    item = F.concat_ws("\n", F.lit("BEGIN:VEVENT"), F.concat(F.lit("UID:"), "ingest_pos"), F.concat(F.lit("SUMMARY:"), folded), start, F.concat(F.lit("DTEND:"), utc("end_ts")), F.lit("RRULE:FREQ=WEEKLY;COUNT=3;BYDAY=MO,XX,1WE"), F.concat(F.lit("EXDATE:"), utc(F.col("start_ts") + F.expr("INTERVAL 7 DAYS")), F.lit(","), utc(F.col("start_ts") + F.expr("INTERVAL 14 DAYS"))), F.lit("END:VEVENT"))
    rows = landed.ical(_texts(views.sessions(spark, sf), item, "BEGIN:VCALENDAR\n", "\nEND:VCALENDAR\n", "\n"))
    return rows.select(F.col("uid").cast("long").alias("event_id"), "title", "start_ts", "end_ts", *[c.cast("string").alias(n) for c, n in zip(landed.rule_parts(F.col("rule")), ("freq", "step", "until", "most"), strict=True)], F.array_join(landed.rule_days(F.col("rule")).cast("array<string>"), ",").alias("days"), F.get("except_ts", F.lit(1)).alias("second_except")).drop("until")


SOURCE_ICAL = f"WITH {SESSIONS} SELECT ingest_pos AS event_id, title, start_ts, end_ts, 'WEEKLY' AS freq, '1' AS step, '3' AS most, '1,3' AS days, start_ts + INTERVAL 14 DAY AS second_except FROM sessions"


def source_embedded_json(spark: SparkSession, sf: str) -> DataFrame:
    kind = F.when(F.col("ingest_pos") % 11 == 0, "Conflict").otherwise(F.col("kind"))
    item = F.to_json(F.struct(F.col("ingest_pos").alias("EventId"), F.date_format("start_ts", "yyyy-MM-dd'T'HH:mm:ss").alias("EventStartTime"), F.date_format("end_ts", "yyyy-MM-dd'T'HH:mm:ss").alias("EventEndTime"), kind.alias("EventTypeName"), F.col("title").alias("SubEventTypeName"), F.lit("a ] b \" [").alias("AccountName"), (F.col("ingest_pos") % 3 == 0).alias("ShowAccount")))
    texts = _texts(views.sessions(spark, sf), item, "<script>var x = ']'; _onlineScheduleList = [", "]; var y = [1];</script>")
    return landed.embedded_json(texts).select("event_id", "title", "start_ts", "end_ts")


SOURCE_EMBEDDED_JSON = f"""WITH {SESSIONS} SELECT ingest_pos AS event_id, kind || ' - ' || title || CASE WHEN ingest_pos % 3 = 0 THEN ' - a ] b " [' ELSE '' END AS title, start_ts, end_ts
FROM sessions WHERE ingest_pos % 11 <> 0"""


def source_tolerant_json(spark: SparkSession, sf: str) -> DataFrame:
    name = lambda r, key: F.when(F.col("ingest_pos") % 3 == r, F.col("title")).alias(key)
    item = F.to_json(F.struct(name(0, "title"), name(1, "Name"), F.lit("  ").alias("label"), F.date_format("start_ts", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("StartTime")))
    return landed.tolerant_json(_texts(views.sessions(spark, sf), item), ("label", "title", "Name"), ("start", "StartTime")).groupBy("title").agg(F.count("*").alias("n"), F.min("start_ts").alias("first"))


SOURCE_TOLERANT_JSON = f"""WITH {SESSIONS} SELECT CASE WHEN ingest_pos % 3 = 2 THEN 'Session' ELSE title END AS title, count(*) AS n, min(start_ts) AS first FROM sessions GROUP BY 1"""


def source_nested_map(spark: SparkSession, sf: str) -> DataFrame:
    nation = table(spark, sf, "nation").select(F.col("n_regionkey").cast("string").alias("region"), F.col("n_nationkey").alias("id"), F.col("n_name").alias("name"))
    lists = nation.groupBy("region").agg(F.array_sort(F.collect_list(F.struct("id", "name"))).alias("rows"))
    texts = lists.select(F.lit(1).alias("source_id"), F.to_json(F.create_map("region", F.create_map(F.lit("all"), F.col("rows")))).alias("body"))
    return landed.nested_map(texts, "id:int,name:string").select(F.col("outer_key").alias("region"), "inner_key", "id", "name")


SOURCE_NESTED_MAP = "SELECT CAST(n_regionkey AS VARCHAR) AS region, 'all' AS inner_key, n_nationkey AS id, n_name AS name FROM nation"


def source_table_rows(spark: SparkSession, sf: str) -> DataFrame:
    item = F.concat(F.lit('<tr><td data-title="Activity"><b style="color:red">'), F.col("title"), F.lit('</b></td><td data-title="Date/Time">'), F.date_format("start_ts", "MM/dd/yyyy h:mm a"), F.lit("</td></tr>"))
    rows = landed.table_rows(_texts(views.sessions(spark, sf), item, "<table>", "</table>", "\n"), ("Activity", "Date/Time"))
    return rows.groupBy("activity").agg(F.count("*").alias("n"), F.min(F.to_timestamp("date_time", "MM/dd/yyyy h:mm a").cast("timestamp_ntz")).alias("first"))


SOURCE_TABLE_ROWS = rf"WITH {SESSIONS} SELECT regexp_replace(title, '\s+', ' ', 'g') AS activity, count(*) AS n, min(start_ts) AS first FROM sessions GROUP BY 1"


def source_headed_table(spark: SparkSession, sf: str) -> DataFrame:
    """Supplier tables as HTML with shuffled columns; only the rows of a whole, unrepeated table are given."""
    rows = table(spark, sf, "supplier").select(F.col("s_suppkey").alias("ingest_pos"), "s_name", "s_nationkey")
    cells = F.concat(F.lit("<tr><td>"), F.col("s_nationkey"), F.lit("</td><td><a href='/t'>"), F.col("s_name"), F.lit("</a></td><td>"), F.col("ingest_pos"), F.lit("</td></tr>"))
    texts = _texts(rows, cells, "<table><tr><th>Nation</th><th>Team</th><th>Id</th></tr>", "</table>", "\n")
    parsed = landed.headed_table(texts, {"id": "Id", "name": "Team", "nation": "Nation", "rating": "Rating"})
    typed = parsed.select(F.col("id").cast("long").alias("id"), "name", F.col("nation").cast("long").alias("nation"), "rating")
    total = table(spark, sf, "supplier").agg(F.count("*").alias("total"))
    return landed.complete(typed.crossJoin(F.broadcast(total)), "id", F.col("total")).drop("total")


SOURCE_HEADED_TABLE = "SELECT s_suppkey AS id, s_name AS name, CAST(s_nationkey AS BIGINT) AS nation, CAST(NULL AS VARCHAR) AS rating FROM supplier"


def sink_csv(spark: SparkSession, sf: str) -> DataFrame:
    """Games with a signal, written as CSV at six decimals with blanks for nulls, and read back."""
    games = views.games(spark, sf)
    signal = F.when(F.col("game_id") % 7 != 0, F.floor(F.col("home_goals") / (F.col("away_goals") + 3) * 1000000 + 0.5) / 1000000.0)
    path = scratch(spark, "features")
    games.select("game_id", "day", "home", "away", signal.alias("signal")).write.csv(path, header=True)
    return spark.read.csv(path, header=True, schema="game_id long, day date, home long, away long, signal double")


SINK_CSV = f"WITH {views.GAMES} SELECT game_id, day, home, away, CASE WHEN game_id % 7 <> 0 THEN floor(home_goals / CAST(away_goals + 3 AS DOUBLE) * 1000000 + 0.5) / 1000000.0 END AS signal FROM games"


def sink_partitioned(spark: SparkSession, sf: str) -> DataFrame:
    """Facts written by rink first, then the index over them; the index is read from the written facts, never ahead of them."""
    path = scratch(spark, "facts")
    views.sessions(spark, sf).select("rink_id", "ingest_pos", "start_ts").repartition("rink_id").write.partitionBy("rink_id").parquet(path)
    facts = spark.read.parquet(path)
    return facts.groupBy(F.col("rink_id").cast("long").alias("rink_id")).agg(F.count("*").alias("n"), F.max("start_ts").alias("last"))


SINK_PARTITIONED = f"WITH {SESSIONS} SELECT rink_id, count(*) AS n, max(start_ts) AS last FROM sessions GROUP BY rink_id"

QUERIES = {
    "source_json_calendar": source_json_calendar, "source_nested_days": source_nested_days, "source_ical": source_ical, "source_embedded_json": source_embedded_json,
    "source_tolerant_json": source_tolerant_json, "source_nested_map": source_nested_map, "source_table_rows": source_table_rows, "source_headed_table": source_headed_table,
    "sink_csv": sink_csv, "sink_partitioned": sink_partitioned,
}
SQL = {
    "source_json_calendar": SOURCE_JSON_CALENDAR, "source_nested_days": SOURCE_NESTED_DAYS, "source_ical": SOURCE_ICAL, "source_embedded_json": SOURCE_EMBEDDED_JSON,
    "source_tolerant_json": SOURCE_TOLERANT_JSON, "source_nested_map": SOURCE_NESTED_MAP, "source_table_rows": SOURCE_TABLE_ROWS, "source_headed_table": SOURCE_HEADED_TABLE,
    "sink_csv": SINK_CSV, "sink_partitioned": SINK_PARTITIONED,
}
