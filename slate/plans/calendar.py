"""Queries on times and recurring patterns, identifiers and markup."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from slate.functions import text, times
from slate.operators import recur
from slate.plans import views
from slate.plans.views import AS_OF, GAMES, SESSIONS
from slate.session import table

_DUCK_LOCAL = lambda ts: f"(({ts} AT TIME ZONE 'UTC') AT TIME ZONE '{times.ZONE}')"


def local_fields(spark: SparkSession, sf: str) -> DataFrame:
    """Order times in local fields across the whole calendar, time changes included."""
    rows = table(spark, sf, "orders").select(F.col("o_orderkey").alias("id"), (F.col("o_orderdate") + F.expr("make_interval(0, 0, 0, 0, CAST(o_orderkey % 24 AS INT), 30, 0)")).alias("ts"))
    wall = times.local(F.col("ts"))
    return rows.select(
        "id",
        times.local_day(F.col("ts")).alias("day"),
        (F.hour(wall) * 60 + F.minute(wall)).cast("long").alias("minute"),
        (F.dayofweek(wall) - 1).cast("long").alias("weekday"),
        times.iso_with_offset(F.col("ts")).alias("iso"),
        times.season_year(times.local_day(F.col("ts"))).cast("long").alias("season"),
    )


LOCAL_FIELDS = f"""WITH rows AS (SELECT o_orderkey AS id, o_orderdate + to_hours(CAST(o_orderkey % 24 AS INT)) + to_minutes(30) AS ts FROM orders),
w AS (SELECT id, ts, {_DUCK_LOCAL("ts")} AS wall FROM rows), o AS (SELECT *, CAST(datediff('minute', ts, wall) AS BIGINT) AS off FROM w)
SELECT id, CAST(wall AS DATE) AS day, hour(wall) * 60 + minute(wall) AS minute, CAST(dayofweek(wall) AS BIGINT) AS weekday,
       strftime(wall, '%Y-%m-%dT%H:%M:%S') || CASE WHEN off < 0 THEN '-' ELSE '+' END || lpad(CAST(abs(off) // 60 AS VARCHAR), 2, '0') || ':' || lpad(CAST(abs(off) % 60 AS VARCHAR), 2, '0') AS iso,
       CASE WHEN month(wall) >= 8 THEN year(wall) ELSE year(wall) - 1 END AS season FROM o"""


def clock_parse(spark: SparkSession, sf: str) -> DataFrame:
    """Clock texts in several writings, made from order numbers, read back as minutes."""
    k = F.col("o_orderkey")
    h, m = (k % 26).cast("string"), F.lpad((k % 67).cast("string"), 2, "0")
    made = F.when(k % 4 == 0, F.concat(h, F.lit(":"), m)).when(k % 4 == 1, F.concat(h, F.lit(":"), m, F.lit("P"))).when(k % 4 == 2, F.concat(h, F.lit(" AM"))).otherwise(F.concat(h, F.lit(":"), m, F.lit(" pm")))
    return table(spark, sf, "orders").select(k.alias("id"), made.alias("clock")).select("id", "clock", times.clock_minutes(F.col("clock")).alias("minute"))


CLOCK_PARSE = """WITH made AS (SELECT o_orderkey AS id, o_orderkey % 26 AS h, o_orderkey % 67 AS m, o_orderkey % 4 AS f FROM orders)
SELECT id, CASE f WHEN 0 THEN h || ':' || lpad(CAST(m AS VARCHAR), 2, '0') WHEN 1 THEN h || ':' || lpad(CAST(m AS VARCHAR), 2, '0') || 'P' WHEN 2 THEN h || ' AM' ELSE h || ':' || lpad(CAST(m AS VARCHAR), 2, '0') || ' pm' END AS clock,
       CAST(CASE WHEN f <> 2 AND m > 59 THEN NULL WHEN f = 0 THEN CASE WHEN h <= 23 THEN h * 60 + m END
            WHEN h < 1 OR h > 12 THEN NULL WHEN f = 2 THEN h % 12 * 60 ELSE (h % 12 + 12) * 60 + m END AS BIGINT) AS minute FROM made"""


def date_parse(spark: SparkSession, sf: str) -> DataFrame:
    """Order dates in four writings, read back."""
    k, d = F.col("o_orderkey"), F.col("o_orderdate")
    made = (
        F.when(k % 4 == 0, F.date_format(d, "yyyy-MM-dd")).when(k % 4 == 1, F.date_format(d, "M/d/yyyy")).when(k % 4 == 2, F.date_format(d, "MM/dd/yy")).otherwise(F.date_format(d, "MMMM d, yyyy"))
    )
    return table(spark, sf, "orders").select(k.alias("id"), made.alias("written")).select("id", "written", times.date_only(F.col("written")).alias("day"))


DATE_PARSE = """SELECT o_orderkey AS id, CASE o_orderkey % 4 WHEN 0 THEN strftime(o_orderdate, '%Y-%m-%d') WHEN 1 THEN strftime(o_orderdate, '%-m/%-d/%Y') WHEN 2 THEN strftime(o_orderdate, '%m/%d/%y') ELSE strftime(o_orderdate, '%B %-d, %Y') END AS written,
       CAST(o_orderdate AS DATE) AS day FROM orders"""


def slot_join(spark: SparkSession, sf: str) -> DataFrame:
    """Sessions with the estimate of their recurring slot: rink, local weekday, local quarter hour; none where nothing is known."""
    known = table(spark, sf, "lineitem").select((F.col("l_suppkey") % 20).alias("rink_id"), (F.dayofweek("l_shipdate") - 1).alias("weekday"), (F.col("l_partkey") % 96).alias("quarter"), (600 + F.col("l_partkey") % 1800).alias("seconds"))
    estimates = known.groupBy("rink_id", "weekday", "quarter").agg(F.min("seconds").alias("seconds"))
    wall = times.local(F.col("start_ts"))
    rows = views.sessions(spark, sf).select("ingest_pos", "rink_id", (F.dayofweek(wall) - 1).alias("weekday"), F.floor((F.hour(wall) * 60 + F.minute(wall)) / 15).alias("quarter"))
    return rows.join(estimates, ["rink_id", "weekday", "quarter"], "left").select("ingest_pos", "rink_id", F.ceil(F.col("seconds") / 60).cast("long").alias("minutes"))


SLOT_JOIN = f"""WITH {SESSIONS}, estimates AS (
  SELECT l_suppkey % 20 AS rink_id, dayofweek(l_shipdate) AS weekday, l_partkey % 96 AS quarter, min(600 + l_partkey % 1800) AS seconds FROM lineitem GROUP BY 1, 2, 3),
w AS (SELECT ingest_pos, rink_id, {_DUCK_LOCAL("start_ts")} AS wall FROM sessions)
SELECT ingest_pos, w.rink_id, CAST(ceil(seconds / 60.0) AS BIGINT) AS minutes FROM w
LEFT JOIN estimates e ON e.rink_id = w.rink_id AND e.weekday = dayofweek(wall) AND e.quarter = (hour(wall) * 60 + minute(wall)) // 15"""


def future_sample_date(spark: SparkSession, sf: str) -> DataFrame:
    """For every weekday that sessions have, a date 7 to 13 days ahead that has it."""
    today = F.to_date(F.lit(AS_OF))
    rows = views.sessions(spark, sf).groupBy((F.dayofweek("start_ts") - 1).cast("long").alias("weekday")).agg(F.count("*").alias("n"))
    return rows.select("weekday", "n", F.date_add(today, (7 + F.pmod(F.col("weekday") - (F.dayofweek(today) - 1), F.lit(7))).cast("int")).alias("sample"))


FUTURE_SAMPLE_DATE = f"""WITH {SESSIONS}, d AS (SELECT CAST(dayofweek(start_ts) AS BIGINT) AS weekday, count(*) AS n FROM sessions GROUP BY 1)
SELECT weekday, n, CAST(TIMESTAMP '{AS_OF}' AS DATE) + CAST(7 + (weekday - dayofweek(TIMESTAMP '{AS_OF}') + 7) % 7 AS INT) AS sample FROM d"""

FIRST, LAST = "2024-01-01", "2024-03-31"


def _patterns(spark: SparkSession, sf: str) -> DataFrame:
    """Weekly patterns of a supplier each: two weekdays, a start, an end that may lie past midnight, a validity."""
    k = F.col("s_suppkey")
    return table(spark, sf, "supplier").select(
        k.alias("pattern_id"),
        F.array(k % 7, (k + 3) % 7).alias("days"),
        (k * 37 % 1440).alias("start_minute"),
        ((k * 37 + 60 + k % 90) % 1440).alias("end_minute"),
        F.when(k % 3 == 0, F.date_add(F.lit(FIRST).cast("date"), (k % 30).cast("int"))).alias("valid_from"),
        F.when(k % 4 == 0, F.date_add(F.lit(FIRST).cast("date"), (k % 80).cast("int"))).alias("valid_to"),
    )


CLOSURES = (("2024-02-17", "2024-02-25"), ("2024-01-01", "2024-01-01"))


def weekly_expand(spark: SparkSession, sf: str) -> DataFrame:
    return recur.weekly(_patterns(spark, sf), FIRST, LAST)


def closure_expand(spark: SparkSession, sf: str) -> DataFrame:
    closed = spark.createDataFrame(list(CLOSURES), "a string, b string").select(F.to_date("a").alias("from_day"), F.to_date("b").alias("to_day"))
    return recur.weekly(_patterns(spark, sf), FIRST, LAST, closed)


WEEKLY_EXPAND = f"""WITH p AS (SELECT s_suppkey AS k, s_suppkey * 37 % 1440 AS a, (s_suppkey * 37 + 60 + s_suppkey % 90) % 1440 AS b,
    CASE WHEN s_suppkey % 3 = 0 THEN DATE '{FIRST}' + CAST(s_suppkey % 30 AS INT) ELSE DATE '{FIRST}' END AS f,
    CASE WHEN s_suppkey % 4 = 0 THEN DATE '{FIRST}' + CAST(s_suppkey % 80 AS INT) ELSE DATE '{LAST}' END AS t FROM supplier),
d AS (SELECT CAST(unnest(generate_series(DATE '{FIRST}', DATE '{LAST}', INTERVAL 1 DAY)) AS DATE) AS day)
SELECT k AS pattern_id, day, CAST(day AS TIMESTAMP) + to_minutes(CAST(a AS INT)) AS start_ts, CAST(day AS TIMESTAMP) + to_minutes(CAST(CASE WHEN b <= a THEN b + 1440 ELSE b END AS INT)) AS end_ts
FROM p JOIN d ON day BETWEEN f AND t AND dayofweek(day) IN (k % 7, (k + 3) % 7)"""
CLOSURE_EXPAND = WEEKLY_EXPAND + " WHERE " + " AND ".join(f"NOT day BETWEEN DATE '{a}' AND DATE '{b}'" for a, b in CLOSURES)


def rrule_expand(spark: SparkSession, sf: str) -> DataFrame:
    """Rules of the sessions: daily, weekly or neither, with steps, weekdays, ends, counts and exceptions, within a month."""
    k = F.col("ingest_pos")
    rows = views.sessions(spark, sf).select(
        k.alias("event_id"),
        F.when(k % 3 == 0, "DAILY").when(k % 3 == 1, "WEEKLY").otherwise("MONTHLY").alias("freq"),
        (k % 4 + 1).alias("step"),
        "start_ts",
        (F.lit(20) + k % 70).alias("minutes"),
        F.when(k % 5 == 0, F.col("start_ts") + F.expr("INTERVAL 9 DAYS")).alias("until_ts"),
        F.when(k % 7 == 0, k % 6 + 1).alias("max_count"),
        F.when(k % 2 == 0, F.array(k % 7, (k + 2) % 7, (k + 3) % 7)).alias("by_day"),
        F.when(k % 4 == 0, F.array(F.col("start_ts") + F.expr("INTERVAL 7 DAYS"), F.col("start_ts") + F.expr("INTERVAL 50 HOURS"))).alias("except_ts"),
    )
    return recur.rules(rows, "2024-01-10", "2024-02-10")


RRULE_EXPAND = f"""WITH {SESSIONS}, r AS (
  SELECT ingest_pos AS k, start_ts, 20 + ingest_pos % 70 AS minutes, CASE ingest_pos % 3 WHEN 0 THEN ingest_pos % 4 + 1 WHEN 1 THEN (ingest_pos % 4 + 1) * 7 ELSE 1 END AS every,
         CASE WHEN ingest_pos % 3 = 2 THEN 1 WHEN ingest_pos % 7 = 0 THEN ingest_pos % 6 + 1 ELSE 1000 END AS most,
         CASE WHEN ingest_pos % 3 = 1 AND ingest_pos % 2 = 0
              THEN list_sort(list_transform([ingest_pos % 7, (ingest_pos + 2) % 7, (ingest_pos + 3) % 7], lambda d: (d - dayofweek(start_ts + INTERVAL 5 HOUR) + 7) % 7)) ELSE [0] END AS offsets,
         CASE WHEN ingest_pos % 4 = 0 THEN [start_ts + INTERVAL 7 DAY, start_ts + INTERVAL 50 HOUR] ELSE [] END AS excepted,
         CASE WHEN ingest_pos % 5 = 0 THEN least(start_ts + INTERVAL 9 DAY, TIMESTAMP '2024-02-10') ELSE TIMESTAMP '2024-02-10' END AS stop FROM sessions),
e AS (SELECT k, i * len(offsets) + j - 1 AS n, start_ts + to_days(CAST(i * every + offsets[j] AS INT)) AS s, minutes, stop, most, excepted FROM r, unnest(range(0, 60)) AS t(i), unnest(range(1, len(offsets) + 1)) AS o(j))
SELECT k AS event_id, n AS k, s AS start_ts, s + to_minutes(CAST(minutes AS INT)) AS end_ts FROM e
WHERE n < most AND s <= stop AND s >= TIMESTAMP '2024-01-10' AND s < TIMESTAMP '2024-02-10'
  AND len(list_filter(excepted, lambda x: abs(epoch(x) - epoch(s)) < 86400 AND day(x) = day(s))) = 0"""


def tiles(spark: SparkSession, sf: str) -> DataFrame:
    """Ranges of up to four months from the nations, in pieces of 14 days."""
    k = F.col("n_nationkey")
    rows = table(spark, sf, "nation").select(k.cast("long").alias("range_id"), F.date_add(F.lit(FIRST).cast("date"), k).alias("from_day"), F.date_add(F.lit(FIRST).cast("date"), k * 6).alias("to_day"))
    return recur.tiles(rows, 14)


TILES = f"""WITH r AS (SELECT CAST(n_nationkey AS BIGINT) AS range_id, DATE '{FIRST}' + n_nationkey AS f, DATE '{FIRST}' + n_nationkey * 6 AS t FROM nation)
SELECT range_id, f + CAST(14 * i AS INT) AS tile_from, least(t, f + CAST(14 * i + 13 AS INT)) AS tile_to FROM r, unnest(range(0, (t - f) // 14 + 1)) AS x(i)"""


def month_grid(spark: SparkSession, sf: str) -> DataFrame:
    """Calendar cells of the months that have games, with the day's games."""
    games = views.games(spark, sf)
    months = games.select(F.to_date(F.date_trunc("month", "day")).alias("month")).distinct()
    counts = games.groupBy("day").agg(F.count("*").alias("n"))
    return recur.month_grid(months).join(counts, "day", "left").select("month", "cell", "day", F.coalesce("n", F.lit(0)).alias("n"))


MONTH_GRID = f"""WITH {GAMES}, m AS (SELECT DISTINCT CAST(date_trunc('month', day) AS DATE) AS month FROM games), counts AS (SELECT day, count(*) AS n FROM games GROUP BY day),
cells AS (SELECT month, i AS cell, month - CAST(dayofweek(month) AS INT) + CAST(i AS INT) AS day FROM m, unnest(range(0, 42)) AS t(i))
SELECT month, cell, c.day, coalesce(n, 0) AS n FROM cells c LEFT JOIN counts k ON k.day = c.day
WHERE cell < 35 OR date_trunc('month', month - CAST(dayofweek(month) AS INT) + 35) = month"""


def grid_clamp(spark: SparkSession, sf: str) -> DataFrame:
    """Sessions on a day grid from 05:00 to 24:00; an end that is not after its start runs to 24:00."""
    minute = lambda c: F.hour(c) * 60 + F.minute(c)
    start, end = minute("start_ts"), minute("end_ts")
    bottom = F.when(end <= start, 1440).otherwise(end)
    top = F.greatest(F.lit(300), start)
    return views.sessions(spark, sf).select("ingest_pos", top.cast("long").alias("top"), F.greatest(F.lit(20), F.least(F.lit(1440), bottom) - top).cast("long").alias("height"))


GRID_CLAMP = f"""WITH {SESSIONS}, m AS (SELECT ingest_pos, hour(start_ts) * 60 + minute(start_ts) AS a, hour(end_ts) * 60 + minute(end_ts) AS b FROM sessions)
SELECT ingest_pos, greatest(300, a) AS top, greatest(20, least(1440, CASE WHEN b <= a THEN 1440 ELSE b END) - greatest(300, a)) AS height FROM m"""


def fnv_id(spark: SparkSession, sf: str) -> DataFrame:
    rows = views.sessions(spark, sf)
    key = F.concat_ws("|", F.col("rink_id").cast("string"), F.date_format("start_ts", "yyyy-MM-dd HH:mm:ss"), F.date_format("end_ts", "yyyy-MM-dd HH:mm:ss"), F.lower("title"))
    return rows.select("ingest_pos", F.concat(F.col("rink_id").cast("string"), F.lit("-"), text.base36(text.fnv1a(key))).alias("event_key"))


FNV_ID = f"""WITH {SESSIONS}, k AS (SELECT ingest_pos, rink_id, rink_id || '|' || strftime(start_ts, '%Y-%m-%d %H:%M:%S') || '|' || strftime(end_ts, '%Y-%m-%d %H:%M:%S') || '|' || lower(title) AS key FROM sessions)
SELECT ingest_pos, rink_id || '-' || lower(to_base(list_reduce(list_prepend(CAST(2166136261 AS BIGINT), list_transform(string_split(key, ''), lambda c: CAST(ord(c) AS BIGINT))), lambda h, u: (xor(h, u) * 16777619) & 4294967295), 36)) AS event_key FROM k"""


def sha_ids(spark: SparkSession, sf: str) -> DataFrame:
    key = F.concat_ws("|", F.col("p_partkey").cast("string"), "p_name")
    return table(spark, sf, "part").select("p_partkey", F.left(F.sha1(key), F.lit(12)).alias("short"), F.left(F.sha2(key, 256), F.lit(20)).alias("long"))


SHA_IDS = "SELECT p_partkey, left(sha1(p_partkey || '|' || p_name), 12) AS short, left(sha256(p_partkey || '|' || p_name), 20) AS long FROM part"


def slug(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "part")
    return rows.select("p_partkey", text.slug(F.concat_ws(" & ", "p_name", "p_brand")).alias("slug"), text.location_key(F.concat_ws(", ", "p_type", "p_brand")).alias("location_key"))


SLUG = """SELECT p_partkey, regexp_replace(regexp_replace(lower(p_name || ' & ' || p_brand), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g') AS slug,
       trim(regexp_replace(lower(p_type || ', ' || p_brand), '[^a-z0-9]+', ' ', 'g')) AS location_key FROM part"""


def team_key(spark: SparkSession, sf: str) -> DataFrame:
    """Team names made of supplier names, years and levels, as keys."""
    k = F.col("s_suppkey")
    level = F.when(k % 3 == 0, " Elite").when(k % 3 == 1, " AAA").otherwise("")
    name = F.concat(F.col("s_name"), F.when(k % 2 == 0, " 2016").otherwise(" 11U"), level, F.when(k % 5 == 0, " (Select)").otherwise(""))
    return table(spark, sf, "supplier").select("s_suppkey", name.alias("name")).select("s_suppkey", "name", text.team_key(F.col("name")).alias("team_key"))


TEAM_KEY = r"""WITH n AS (SELECT s_suppkey, s_name || CASE WHEN s_suppkey % 2 = 0 THEN ' 2016' ELSE ' 11U' END || CASE s_suppkey % 3 WHEN 0 THEN ' Elite' WHEN 1 THEN ' AAA' ELSE '' END || CASE WHEN s_suppkey % 5 = 0 THEN ' (Select)' ELSE '' END AS name FROM supplier)
SELECT s_suppkey, name, trim(regexp_replace(regexp_replace(lower(name), '\b(?:20\d\d|\d{2}u|u\d{2}|aaa|aa|elite|select)\b', ' ', 'g'), '[^a-z0-9]+', ' ', 'g')) AS team_key FROM n"""


def html_text(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "pages").select("page_id", text.html_text(F.col("html")).alias("text"))


def _nested_replace(sql: str) -> str:
    for name, char in text.ENTITIES:
        char = "chr(32)" if char == " " else "'" + char.replace("'", "''") + "'"
        sql = f"replace({sql}, '{name}', {char})"
    return sql


HTML_TEXT = r"""WITH a AS (SELECT page_id, regexp_replace(html, '(?is)<(script|style)\b[^>]*>.*?</(script|style)>', ' ', 'g') AS t FROM pages),
b AS (SELECT page_id, regexp_replace(regexp_replace(t, '(?i)<br[^>]*>|</(p|div|li|h[1-6]|tr|article|footer)>', chr(10), 'g'), '(?s)<[^>]+>', ' ', 'g') AS t FROM a),
c AS (SELECT page_id, regexp_replace(%s, '[ \t\r\f]+', ' ', 'g') AS t FROM b)
SELECT page_id, trim(regexp_replace(t, ' ?\n[ \n]*', chr(10), 'g'), ' ' || chr(10)) AS text FROM c""" % _nested_replace("t")


def html_links(spark: SparkSession, sf: str) -> DataFrame:
    links = table(spark, sf, "pages").select("page_id", text.html_links(F.col("html")).alias("links"))
    return links.select("page_id", F.size("links").cast("long").alias("n_links"), F.array_join("links", " ").alias("links"))


HTML_LINKS = """WITH l AS (SELECT page_id, regexp_extract_all(html, '(?i)href="([^"]+)"', 1) AS l FROM pages),
u AS (SELECT page_id, x, min(i) AS i FROM (SELECT page_id, unnest(l) AS x, unnest(range(0, len(l))) AS i FROM l) GROUP BY page_id, x)
SELECT page_id, count(*) AS n_links, string_agg(x, ' ' ORDER BY i) AS links FROM u GROUP BY page_id"""

QUERIES = {
    "local_fields": local_fields, "clock_parse": clock_parse, "date_parse": date_parse, "slot_join": slot_join, "future_sample_date": future_sample_date,
    "weekly_expand": weekly_expand, "closure_expand": closure_expand, "rrule_expand": rrule_expand, "tiles": tiles, "month_grid": month_grid,
    "grid_clamp": grid_clamp, "fnv_id": fnv_id, "sha_ids": sha_ids, "slug": slug, "team_key": team_key, "html_text": html_text, "html_links": html_links,
}
SQL = {
    "local_fields": LOCAL_FIELDS, "clock_parse": CLOCK_PARSE, "date_parse": DATE_PARSE, "slot_join": SLOT_JOIN, "future_sample_date": FUTURE_SAMPLE_DATE,
    "weekly_expand": WEEKLY_EXPAND, "closure_expand": CLOSURE_EXPAND, "rrule_expand": RRULE_EXPAND, "tiles": TILES, "month_grid": MONTH_GRID,
    "grid_clamp": GRID_CLAMP, "fnv_id": FNV_ID, "sha_ids": SHA_IDS, "slug": SLUG, "team_key": TEAM_KEY, "html_text": HTML_TEXT, "html_links": HTML_LINKS,
}
