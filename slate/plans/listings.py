"""Listing parsers over texts that are made from the tables, ranked links, and order-dependent state across runs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from slate.plans import views
from slate.plans.formats import _texts
from slate.plans.views import SESSIONS
from slate.session import table
from slate.sources import pages

_us = lambda c, p: F.date_format(c, p)
_HM = "h:mm a"


def source_month_cells(spark: SparkSession, sf: str) -> DataFrame:
    item = F.concat(
        F.lit('<td id="d'), "ingest_pos", F.lit('"><span class="date">'), _us("start_ts", "M/d/yyyy"), F.lit('</span><div class="session"'), F.coalesce(F.concat(F.lit(' data-surface="'), "surface", F.lit('"')), F.lit("")), F.lit("> <b data-surface=\""),
        F.coalesce("surface", F.lit("")), F.lit('"> '), _us("start_ts", _HM), F.lit(" - "), _us("end_ts", _HM), F.lit("</b></div></td>"),
    )
    return pages.month_cells(_texts(views.sessions(spark, sf), item, "<table><tr>", "</tr></table>", "")).groupBy("surface", "start_ts", "end_ts").agg(F.count("*").alias("n"))


SOURCE_MONTH_CELLS = f"WITH {SESSIONS} SELECT surface, start_ts, end_ts, count(*) AS n FROM sessions GROUP BY 1, 2, 3"


def source_item_list(spark: SparkSession, sf: str) -> DataFrame:
    item = F.concat(F.lit("<li><h3><a href='/e'>"), "title", F.lit("</a></h3><span itemprop=\"startDate\">"), _us("start_ts", "yyyy-MM-dd'T'HH:mm:ss"), F.lit("</span><p itemprop=\"description\">At rink "), "rink_id", F.lit("</p></li>"))
    rows = pages.item_list(_texts(views.sessions(spark, sf), item, "<ul>", "</ul>", "\n"))
    return rows.groupBy("title", "about").agg(F.count("*").alias("n"), F.min("start_ts").alias("first"), F.max("end_ts").alias("last_end"))


SOURCE_ITEM_LIST = rf"""WITH {SESSIONS} SELECT regexp_replace(title, '\s+', ' ', 'g') AS title, 'At rink ' || rink_id AS about, count(*) AS n, min(start_ts) AS first, max(start_ts) + INTERVAL 1 HOUR AS last_end FROM sessions GROUP BY 1, 2"""


def source_club_rows(spark: SparkSession, sf: str) -> DataFrame:
    other = F.when(F.col("ingest_pos") % 2 == 0, F.concat(F.lit("@ "), "title")).otherwise("Team B, Team A")
    cells = [F.lit("Mon"), _us("start_ts", "MM/dd/yy"), _us("start_ts", _HM), _us("end_ts", _HM), F.lit("Practice"), F.concat(F.lit("Rink "), "rink_id"), other]
    item = F.concat(F.lit('<tr eid="'), "ingest_pos", F.lit('"><td>'), F.concat_ws("</td><td>", *cells), F.lit("</td></tr>"))
    rows = pages.club_rows(_texts(views.sessions(spark, sf), item, "<table>", "</table>", "\n"))
    return rows.groupBy("place", "start_ts", "end_ts").agg(F.count("*").alias("n"), F.min("opponent").alias("opponent"), F.max(F.array_join("shared_with", "+")).alias("shared"))


SOURCE_CLUB_ROWS = rf"""WITH {SESSIONS} SELECT 'Rink ' || rink_id AS place, start_ts, end_ts, count(*) AS n, min(CASE WHEN ingest_pos % 2 = 0 THEN regexp_replace(title, '\s+', ' ', 'g') END) AS opponent,
  max(CASE WHEN ingest_pos % 2 = 1 THEN 'Team A+Team B' END) AS shared FROM sessions GROUP BY 1, 2, 3"""


def source_listing(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("ingest_pos")
    action = F.when(k % 4 == 0, "Sold Out").when(k % 4 == 1, "Join Waitlist").when(k % 4 == 2, "CANCELED").otherwise("Add")
    length = F.when(k % 3 == 0, F.lit("")).otherwise(F.concat(F.lit(" Duration: "), (k % 70 + 20).cast("string"), F.lit(" minutes")))
    item = F.concat(
        F.lit('<div class="row product product-accordion"><h4>'), "title", F.lit("</h4> "), _us("start_ts", "M/d/yyyy"), F.lit(" at "), _us("start_ts", _HM), length, F.lit(" Price $ "), (k % 40).cast("string"), F.lit('.00 Level: 2-4 <div class="product-action">'), action, F.lit("</div></div>"),
    )
    rows = pages.listing(_texts(views.sessions(spark, sf), item, "<body>", "</body>", "\n"))
    return rows.groupBy("status", "price", "level").agg(F.count("*").alias("n"), F.min("start_ts").alias("first"), F.max("end_ts").alias("last_end"))


SOURCE_LISTING = f"""WITH {SESSIONS} SELECT CASE ingest_pos % 4 WHEN 0 THEN 'sold_out' WHEN 1 THEN 'waitlist' WHEN 2 THEN 'canceled' ELSE 'open' END AS status, '$ ' || ingest_pos % 40 || '.00' AS price, '2-4' AS level,
  count(*) AS n, min(start_ts) AS first, max(start_ts + to_minutes(CAST(CASE WHEN ingest_pos % 3 = 0 THEN 50 ELSE ingest_pos % 70 + 20 END AS INT))) AS last_end FROM sessions GROUP BY 1, 2, 3"""


def source_deep_rows(spark: SparkSession, sf: str) -> DataFrame:
    """Suppliers as rows under their nation's number, at two depths of nesting, one of them beyond a dozen maps and lists."""
    rows = table(spark, sf, "supplier").select("s_suppkey", "s_name", F.col("s_nationkey").cast("string").alias("nation"))
    item = F.struct(F.col("s_suppkey").cast("string").alias("GameDate"), F.col("s_name").alias("name"))
    lists = rows.groupBy("nation", (F.col("s_suppkey") / 50).cast("long").alias("block")).agg(F.collect_list(item).alias("rows"))
    texts = lists.select(
        F.col("block").alias("source_id"),
        F.when(F.col("block") % 2 == 0, F.to_json(F.create_map("nation", "rows"))).otherwise(F.concat(F.lit('{"in":[' * 5), F.to_json(F.struct(F.create_map("nation", F.struct(F.array("rows").alias("games"))).alias("list"))), F.lit("]}" * 5))).alias("body"),
    )
    return pages.deep_rows(texts, "GameDate", ["GameDate", "name"]).select(F.col("GameDate").cast("long").alias("id"), "name", "under")


SOURCE_DEEP_ROWS = "SELECT s_suppkey AS id, s_name AS name, CAST(s_nationkey AS VARCHAR) AS under FROM supplier"


def asset_ranks(spark: SparkSession, sf: str) -> DataFrame:
    """The five best links of every page."""
    landed = table(spark, sf, "pages").select(F.col("page_id").alias("source_id"), F.col("html").alias("body"))
    links = pages.asset_scores(landed.select("source_id", F.replace("body", F.lit('href="/th'), F.lit('href="/schedule/th')).alias("body")))
    return links.withColumn("n", F.row_number().over(Window.partitionBy("source_id").orderBy(F.desc("points"), "url"))).where("n <= 5").withColumn("n", F.col("n").cast("long"))


def schedule_assets(spark: SparkSession, sf: str) -> DataFrame:
    """The five files of every page that most look like a schedule. The pages link no files, so their links are made into some first."""
    body = F.regexp_replace("html", 'href="/([a-zA-Z]+)"', 'href="/files/$1-schedule.pdf"')
    body = F.regexp_replace(body, 'href="/files/([b-h][a-zA-Z]*)-schedule[.]pdf"', 'href="/img/$1-banner.png"')
    landed = table(spark, sf, "pages").select(F.col("page_id").alias("source_id"), "url", body.alias("body"))
    return pages.schedule_assets(landed).where("place <= 5")


#: Links of these pages are all href in double quotes, so a place in the text is the lengths of what stands before it.
ASSET_RANKS = f"""WITH p AS (SELECT page_id, replace(html, 'href="/th', 'href="/schedule/th') AS body FROM pages),
s AS (SELECT page_id, body, string_split(body, 'href="') AS s FROM p),
l AS (SELECT page_id, body, string_split(s[i + 1], '"')[1] AS url, CAST(list_sum(list_transform(s[1:i], lambda x: length(x))) + 6 * (i - 1) AS BIGINT) AS place FROM s, unnest(range(1, len(s))) AS t(i)),
c AS (SELECT page_id, url, regexp_matches(substr(body, greatest(place - {pages.AROUND}, 0) + 1, least(place, {pages.AROUND}) + 7 + length(url) + {pages.AROUND}), '(?i)schedule|public|open') AS near FROM l WHERE url <> ''),
q AS (SELECT page_id AS source_id, url, max((CASE WHEN regexp_matches(lower(url), 'schedule|calendar|hours|page') THEN 3 ELSE 0 END) - (CASE WHEN regexp_matches(lower(url), 'logo|icon|banner') THEN 4 ELSE 0 END)
             + (CASE WHEN regexp_matches(lower(url), '[.](pdf|png|jpe?g)$') THEN 2 ELSE 0 END) + (CASE WHEN near THEN 1 ELSE 0 END)) AS points FROM c GROUP BY 1, 2),
n AS (SELECT *, row_number() OVER (PARTITION BY source_id ORDER BY points DESC, url) AS n FROM q WHERE points >= 1)
SELECT source_id, url, CAST(points AS INT) AS points, n FROM n WHERE n <= 5"""


QUERIES = {
    "source_month_cells": source_month_cells, "source_item_list": source_item_list, "source_club_rows": source_club_rows, "source_listing": source_listing,
    "source_deep_rows": source_deep_rows, "asset_ranks": asset_ranks, "schedule_assets": schedule_assets,
}
SQL = {
    "source_month_cells": SOURCE_MONTH_CELLS, "source_item_list": SOURCE_ITEM_LIST, "source_club_rows": SOURCE_CLUB_ROWS, "source_listing": SOURCE_LISTING,
    "source_deep_rows": SOURCE_DEEP_ROWS, "asset_ranks": ASSET_RANKS,
}
