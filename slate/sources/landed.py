"""Parsers over landed bytes: one DataFrame function per format, from a text column to typed rows.

Input frames have ``source_id`` and ``body``; output rows carry ``source_id``. Nothing here fetches. Times without a zone are
wall-clock times of the given zone and come out as UTC.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from slate.functions import times

_US = "M/d/yyyy h:mm:ss a"


def _blank_to_null(text: Column) -> Column:
    return F.nullif(F.trim(text), F.lit(""))


def calendar_json(landed: DataFrame) -> DataFrame:
    """Arrays of {id, title, start, end, url, allDay} with US times; rows without times or title are left out."""
    rows = landed.select("source_id", F.explode(F.from_json("body", "array<struct<id:bigint,title:string,start:string,end:string,url:string,allDay:boolean>>")).alias("e"))
    start, end = F.try_to_timestamp("e.start", F.lit(_US)), F.try_to_timestamp("e.end", F.lit(_US))
    title = _blank_to_null(F.replace(F.col("e.title"), F.lit("\\'"), F.lit("'")))
    typed = rows.select("source_id", F.col("e.id").alias("event_id"), title.alias("title"), start.cast("timestamp_ntz").alias("start_ts"), end.cast("timestamp_ntz").alias("end_ts"), F.coalesce("e.allDay", F.lit(False)).alias("all_day"))
    kept = typed.where("title IS NOT NULL AND start_ts IS NOT NULL AND end_ts IS NOT NULL")
    return kept.withColumn("end_ts", F.when(F.col("all_day") & (F.col("end_ts") <= F.col("start_ts")), F.col("start_ts")).otherwise(F.col("end_ts")))


def nested_days(landed: DataFrame) -> DataFrame:
    """{dayInfo: [{date, closed, eventInfo: [...]}]}: usage times before start times; ends before starts are on the next day."""
    schema = "struct<dayInfo:array<struct<date:string,closed:boolean,eventInfo:array<struct<eventKey:string,eventName:string,startTime:string,endTime:string,usageStartTime:string,usageEndTime:string>>>>>"
    days = landed.select("source_id", F.explode(F.from_json("body", schema)["dayInfo"]).alias("d")).select("source_id", "d.date", F.explode("d.eventInfo").alias("e"))
    at = lambda main, other: F.try_to_timestamp(F.concat_ws(" ", "date", F.coalesce(_blank_to_null(F.col(main)), F.col(other))), F.lit("yyyy-MM-dd HH:mm")).cast("timestamp_ntz")
    rows = days.select("source_id", F.col("e.eventKey").alias("event_key"), F.col("e.eventName").alias("title"), at("e.usageStartTime", "e.startTime").alias("start_ts"), at("e.usageEndTime", "e.endTime").alias("end_ts"))
    return rows.withColumn("end_ts", times.rolled_end(F.col("start_ts"), F.col("end_ts"))).where("start_ts IS NOT NULL")


def ical(landed: DataFrame, zone: str = times.ZONE) -> DataFrame:
    """VEVENT blocks: summary, start, end, rule, exceptions; folded lines are joined, seconds dropped, events without summary or start left out.

    ``except_ts`` has the times of all EXDATE lines, each a comma-separated list.
    """
    unfolded = F.regexp_replace("body", "\\r?\\n[ \\t]", "")
    blocks = landed.select("source_id", F.explode(F.regexp_extract_all(unfolded, F.lit("(?s)BEGIN:VEVENT(.*?)END:VEVENT"), 1)).alias("v"))
    value = lambda name: F.nullif(F.rtrim(F.regexp_extract("v", f"(?m)^{name}(?:;[^:\\r\\n]*)?:([^\\r\\n]*)", 1)), F.lit(""))
    unescape = lambda text: F.regexp_replace(F.regexp_replace(text, "\\\\n", " "), "\\\\([,;\\\\])", "$1")

    def at(text: Column) -> Column:
        wall = F.try_to_timestamp(F.concat(F.left(text, F.lit(8)), F.coalesce(F.nullif(F.substring(text, 10, 4), F.lit("")), F.lit("0000"))), F.lit("yyyyMMddHHmm"))
        return F.when(F.endswith(text, F.lit("Z")), wall).otherwise(times.utc(wall, zone)).cast("timestamp_ntz")

    lines = F.regexp_extract_all("v", F.lit("(?m)^EXDATE(?:;[^:\\r\\n]*)?:([^\\r\\n]*)"), 1)
    excepted = F.filter(F.transform(F.flatten(F.transform(lines, lambda x: F.split(x, ","))), lambda x: at(F.trim(x))), lambda x: x.isNotNull())
    start, end = value("DTSTART"), value("DTEND")
    all_day = F.length(start) == 8
    default_end = F.when(all_day, at(start) + F.expr("INTERVAL 1 DAY")).otherwise(at(start) + F.expr("INTERVAL 1 HOUR"))
    rows = blocks.select(
        "source_id", value("UID").alias("uid"), unescape(value("SUMMARY")).alias("title"), at(start).alias("start_ts"), F.coalesce(at(end), default_end).alias("end_ts"), all_day.alias("all_day"), value("RRULE").alias("rule"), excepted.alias("except_ts")
    )
    return rows.where("title IS NOT NULL AND start_ts IS NOT NULL")


def rule_parts(rule: Column) -> tuple[Column, Column, Column, Column]:
    """freq, step, until (UTC) and count of a recurrence rule."""
    part = lambda name: F.nullif(F.regexp_extract(rule, f"(?:^|;){name}=([^;]*)", 1), F.lit(""))
    until = F.try_to_timestamp(F.rpad(F.regexp_replace(part("UNTIL"), "[TZ]", ""), 14, "0"), F.lit("yyyyMMddHHmmss")).cast("timestamp_ntz")
    return part("FREQ"), F.coalesce(part("INTERVAL").try_cast("int"), F.lit(1)), until, part("COUNT").try_cast("int")


#: Weekdays of recurrence rules.
WEEKDAYS = ("SU", "MO", "TU", "WE", "TH", "FR", "SA")


def rule_days(rule: Column) -> Column:
    """Weekdays (0 is Sunday) of a recurrence rule's BYDAY, without what no weekday is; null if it has none. Ordinals before a day are not read."""
    part = F.nullif(F.regexp_extract(rule, "(?:^|;)BYDAY=([^;]*)", 1), F.lit(""))
    days = F.transform(F.split(part, ","), lambda d: F.array_position(F.array(*map(F.lit, WEEKDAYS)), F.upper(F.right(d, F.lit(2)))).cast("int") - 1)
    return F.filter(days, lambda d: d >= 0)


def _from_array(text: Column, name: str) -> Column:
    """The text from the first bracket after a name on; null if there is none. The JSON reader stops at the bracket that closes it."""
    at = F.locate("[", F.substr(text, F.nullif(F.locate(name, text), F.lit(0))))
    return F.substr(F.substr(text, F.locate(name, text)), F.nullif(at, F.lit(0)))


# Names in the script format.
SCRIPT_LIST = "_onlineScheduleList"
SCRIPT_ROW = "EventId:bigint,EventStartTime:string,EventEndTime:string,EventTypeName:string,SubEventTypeName:string,AccountName:string,ShowAccount:boolean,Closed:boolean"
# End of fixed values.


def embedded_json(landed: DataFrame, name: str = SCRIPT_LIST) -> DataFrame:
    """An array assigned to a variable inside a script; conflicts are left out, the title is type, subtype, account without repeats."""

    rows = landed.select("source_id", F.explode(F.from_json(_from_array(F.col("body"), name), f"array<struct<{SCRIPT_ROW}>>")).alias("e"))
    names = F.array_distinct(F.filter(F.array(F.trim("e.EventTypeName"), F.trim("e.SubEventTypeName"), F.when(F.col("e.ShowAccount"), F.trim("e.AccountName"))), lambda x: x.isNotNull() & (x != "")))
    typed = rows.where("NOT coalesce(e.EventTypeName, '') = 'Conflict'").select(
        "source_id", F.col("e.EventId").alias("event_id"), F.array_join(names, " - ").alias("title"), F.col("e.EventStartTime").cast("timestamp_ntz").alias("start_ts"), F.col("e.EventEndTime").cast("timestamp_ntz").alias("end_ts")
    )
    return typed.where("start_ts IS NOT NULL")


def tolerant_json(landed: DataFrame, titles: Sequence[str], starts: Sequence[str], default: str = "Session") -> DataFrame:
    """Arrays of objects whose field names differ: the first candidate key that is not blank. What is no array gives no rows; a Z is wall clock."""
    rows = landed.select("source_id", F.posexplode(F.from_json("body", "array<map<string,string>>")).alias("pos", "m"))
    first = lambda keys: F.coalesce(*[_blank_to_null(F.element_at("m", k)) for k in keys])
    start = F.regexp_replace(first(starts), "Z$", "").cast("timestamp_ntz")
    return rows.select("source_id", F.coalesce(first(titles), F.lit(default)).alias("title"), start.alias("start_ts")).where("start_ts IS NOT NULL")


def nested_map(landed: DataFrame, row: str) -> DataFrame:
    """Two levels of maps of lists of rows, flattened: outer key, inner key, the row's fields."""
    outer = landed.select("source_id", F.explode(F.from_json("body", f"map<string,map<string,array<struct<{row}>>>>")).alias("outer_key", "m"))
    inner = outer.select("source_id", "outer_key", F.explode("m").alias("inner_key", "rows"))
    return inner.select("source_id", "outer_key", "inner_key", F.inline("rows"))


def table_rows(landed: DataFrame, labels: Sequence[str]) -> DataFrame:
    """HTML table rows whose cells carry their column's name in data-title; one text column per label."""
    rows = landed.select("source_id", F.posexplode(F.slice(F.split("body", "(?i)<tr"), 2, 1 << 30)).alias("pos", "r"))
    cell = lambda label: F.trim(F.regexp_replace(F.regexp_replace(F.regexp_extract("r", f'(?is)data-title="{label}"[^>]*>(.*?)</td>', 1), "(?s)<[^>]+>", " "), "\\s+", " "))
    return rows.select("source_id", "pos", *[cell(label).alias(label.lower().replace("/", "_")) for label in labels])


def headed_table(landed: DataFrame, columns: dict[str, str]) -> DataFrame:
    """HTML tables read by the place of their header cells; ``columns``: output name to header text."""
    strip = lambda cells: F.transform(cells, lambda c: F.trim(F.regexp_replace(c, "(?s)<[^>]+>", "")))
    heads = strip(F.regexp_extract_all("body", F.lit("(?is)<th[^>]*>(.*?)</th>"), 1))
    rows = landed.select("source_id", heads.alias("heads"), F.explode(F.regexp_extract_all("body", F.lit("(?is)<tr[^>]*>(.*?)</tr>"), 1)).alias("r"))
    cells = rows.select("source_id", "heads", strip(F.regexp_extract_all("r", F.lit("(?is)<td[^>]*>(.*?)</td>"), 1)).alias("cells")).where("size(cells) > 0")
    return cells.select("source_id", *[F.try_element_at("cells", F.nullif(F.array_position("heads", head), F.lit(0)).cast("int")).alias(name) for name, head in columns.items()])


def complete(rows: DataFrame, key: str, declared: Column, most: int = 10_000_000) -> DataFrame:
    """The rows, if they are whole: no null or repeated key, as many as declared. Else the query fails; it never gives a part."""
    facts = rows.agg(F.count("*").alias("n"), F.count_distinct(key).alias("d"), F.count_if(F.col(key).isNull()).alias("bad"), F.max(declared).alias("declared"))
    test = (F.col("n") == F.col("d")) & (F.col("bad") == 0) & (F.col("n") == F.coalesce("declared", F.lit(0))) & (F.col("n") <= most)
    checked = facts.select(F.when(test, True).otherwise(F.raise_error(F.lit("incomplete pages"))).cast("boolean").alias("whole"))
    return rows.crossJoin(F.broadcast(checked)).where("whole").drop("whole")


def guarded(rows: DataFrame, holds: Column, message: str) -> DataFrame:
    """The rows, if an aggregate condition over all of them holds; else the query fails."""
    checked = rows.agg(F.when(holds, True).otherwise(F.raise_error(F.lit(message))).cast("boolean").alias("g_holds"))
    return rows.crossJoin(F.broadcast(checked)).where("g_holds").drop("g_holds")


GAME = "gameId:bigint,status:string,gameType:string,timeStampZulu:string,location:string,home:struct<division:struct<title:string>,title:string>,visitor:struct<division:struct<title:string>,title:string>"


def paged_games(landed: DataFrame) -> DataFrame:
    """Scheduled games of {data, meta: {filtered}} pages; the query fails where a game is missing, repeated or without an id.

    Practices, and games without a place or without a time of day and a zone in their start, are left out.
    """
    pages = landed.select(F.from_json("body", f"struct<data:array<struct<{GAME}>>,meta:struct<filtered:bigint>>").alias("p"))
    rows = complete(pages.select(F.explode("p.data").alias("g"), F.col("p.meta.filtered").alias("total")).select("g.*", "total"), "gameId", F.col("total"))
    start = F.try_to_timestamp("timeStampZulu").cast("timestamp_ntz")
    kept = rows.where("status RLIKE '(?i)^(scheduled|upcoming)$' AND NOT coalesce(gameType, '') RLIKE '(?i)practice|training' AND timeStampZulu RLIKE 'T[0-9]{2}:[0-9]{2}.*(Z|[+-][0-9]{2}:[0-9]{2})$'")
    named = kept.select(F.col("gameId").alias("game_id"), start.alias("start_ts"), F.col("home.title").alias("home"), F.col("visitor.title").alias("away"), F.coalesce("home.division.title", "visitor.division.title").alias("division"), _blank_to_null(F.col("location")).alias("location"))
    return named.where("start_ts IS NOT NULL AND location IS NOT NULL AND home <> '' AND away <> ''")
