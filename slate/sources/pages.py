"""Parsers over landed HTML listings and nested JSON of unknown depth. Input frames have ``source_id`` and ``body``."""

from __future__ import annotations

import re
from collections.abc import Iterator
from html import unescape
from urllib.parse import urljoin

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from slate.functions import times
from slate.session import cut


def _strip(html: Column) -> Column:
    return F.trim(F.regexp_replace(F.regexp_replace(html, "(?s)<[^>]+>", " "), "[\\s ]+", " "))


def _at(day: Column, minute: Column) -> Column:
    return F.timestamp_seconds(F.unix_timestamp(day.cast("timestamp")) + minute * 60).cast("timestamp_ntz")


def month_cells(landed: DataFrame) -> DataFrame:
    """Month grids: one cell per day with a hidden date and any number of sessions, each a range of clock times."""
    cells = landed.select("source_id", F.explode(F.regexp_extract_all("body", F.lit("(?is)<td[^>]*id=[^>]*>(.*?)</td>"), 1)).alias("c"))
    day = times.date_only(F.regexp_extract("c", '(?is)<span[^>]*class="date"[^>]*>(.*?)</span>', 1))
    dated = cells.select("source_id", day.alias("day"), F.explode(F.regexp_extract_all("c", F.lit('(?is)<div[^>]*class="session"[^>]*>(.*?)</div>'), 1)).alias("s"))
    clock = lambda k: times.clock_minutes(F.regexp_extract(_strip(F.col("s")), r"(?i)(\d{1,2}(?::\d{2})?\s*[ap]m)\s*-\s*(\d{1,2}(?::\d{2})?\s*[ap]m)", k))
    surface = F.nullif(F.regexp_extract("s", '(?is)data-surface="([^"]*)"', 1), F.lit(""))
    rows = dated.select("source_id", "day", clock(1).alias("a"), clock(2).alias("b"), surface.alias("surface")).where("day IS NOT NULL AND a IS NOT NULL AND b IS NOT NULL")
    return rows.select("source_id", "surface", _at(F.col("day"), F.col("a")).alias("start_ts"), _at(F.col("day"), F.when(F.col("b") <= F.col("a"), F.col("b") + 1440).otherwise(F.col("b"))).alias("end_ts"))


def item_list(landed: DataFrame) -> DataFrame:
    """List items with a heading, a microdata start and a description (500 characters at most, as listings give it); an hour where no end is given."""
    items = landed.select("source_id", F.explode(F.regexp_extract_all("body", F.lit("(?is)<li[^>]*>(.*?)</li>"), 1)).alias("i"))
    start = F.try_to_timestamp(F.regexp_extract("i", '(?is)itemprop="startDate"[^>]*>([^<]*)<', 1)).cast("timestamp_ntz")
    end = times.clock_minutes(F.regexp_extract("i", r"(?is)-\s*(\d{1,2}:\d{2}\s*[AP]M)", 1))
    about = F.left(_strip(F.regexp_extract("i", '(?is)itemprop="description"[^>]*>(.*?)</', 1)), F.lit(500))
    rows = items.select("source_id", _strip(F.regexp_extract("i", "(?is)<h3[^>]*>(.*?)</h3>", 1)).alias("title"), start.alias("start_ts"), end.alias("minute"), about.alias("about"))
    rows = rows.where("title <> '' AND start_ts IS NOT NULL")
    last = F.coalesce(_at(F.to_date("start_ts"), F.col("minute")), F.col("start_ts") + F.expr("INTERVAL 1 HOUR"))
    return rows.select("source_id", "title", "start_ts", F.greatest(last, F.col("start_ts")).alias("end_ts"), "about")


def club_rows(landed: DataFrame) -> DataFrame:
    """Schedule rows of seven cells: day, date, from, to, type, place, opponent (after @ or vs) or teams that share the slot."""
    rows = landed.select("source_id", F.explode(F.regexp_extract_all("body", F.lit("(?is)<tr[^>]*eid[^>]*>(.*?)</tr>"), 1)).alias("r"))
    cells = rows.select("source_id", F.transform(F.regexp_extract_all("r", F.lit("(?is)<td[^>]*>(.*?)</td>"), 1), _strip).alias("c")).where("size(c) >= 7")
    day, start, end = times.date_only(F.col("c")[1]), times.clock_minutes(F.col("c")[2]), times.clock_minutes(F.col("c")[3])
    typed = cells.select("source_id", day.alias("day"), start.alias("a"), end.alias("b"), F.lower(F.col("c")[4]).alias("kind"), F.col("c")[5].alias("place"), F.col("c")[6].alias("other"))
    typed = typed.where("day IS NOT NULL AND a IS NOT NULL")
    versus = F.regexp_extract("other", r"(?i)^\s*(@|vs\.?)\s*(.*)$", 2)
    return typed.select(
        "source_id",
        _at(F.col("day"), F.col("a")).alias("start_ts"),
        _at(F.col("day"), F.coalesce(F.when(F.col("b") <= F.col("a"), F.col("b") + 1440).otherwise(F.col("b")), F.col("a") + 60)).alias("end_ts"),
        "kind",
        "place",
        F.nullif(versus, F.lit("")).alias("opponent"),
        F.when(versus == "", F.array_sort(F.filter(F.split("other", r"\s*,\s*"), lambda t: t != ""))).alias("shared_with"),
    )


def listing(landed: DataFrame) -> DataFrame:
    """Product blocks: title, `date at time`, duration (50 minutes where none is given), price, level, and a status from the action text."""
    blocks = landed.select("source_id", F.explode(F.slice(F.split("body", '(?i)class="[^"]*product-accordion[^"]*"'), 2, 1 << 30)).alias("b"))
    text = _strip(F.col("b"))
    day = times.date_only(F.regexp_extract(text, r"(?i)(\d{1,2}/\d{1,2}/\d{2,4})\s+at", 1))
    clock = times.clock_minutes(F.regexp_extract(text, r"(?i)at\s+(\d{1,2}:\d{2}(?:\s*[AP]M)?)", 1))
    minutes = F.coalesce(F.regexp_extract(text, r"(?i)duration[:\s]+(\d+)\s*min", 1).try_cast("long"), F.lit(50))
    action = F.lower(_strip(F.regexp_extract("b", '(?is)<div class="product-action">(.*?)</div>', 1)))
    status = F.when(action.contains("canceled"), "canceled").when(action.contains("waitlist"), "waitlist").when(action.rlike("sold\\s*out"), "sold_out").otherwise("open")
    rows = blocks.select(
        "source_id", _strip(F.regexp_extract("b", "(?is)<h4[^>]*>(.*?)</h4>", 1)).alias("title"), day.alias("day"), clock.alias("a"), minutes.alias("m"), status.alias("status"),
        F.nullif(F.regexp_extract(text, r"\$\s*\d+(?:\.\d{2})?", 0), F.lit("")).alias("price"), F.nullif(F.regexp_extract(text, r"(?i)levels?[:\s]+([0-9\- ]*[0-9])", 1), F.lit("")).alias("level"),
    )
    kept = rows.where("title <> '' AND day IS NOT NULL AND a IS NOT NULL")
    return kept.select("source_id", "title", _at(F.col("day"), F.col("a")).alias("start_ts"), _at(F.col("day"), F.col("a") + F.col("m")).alias("end_ts"), "status", "price", "level")


def deep_rows(landed: DataFrame, marker: str, fields: list[str]) -> DataFrame:
    """Objects that have the field ``marker``, at any depth of nested maps and lists; the nearest numeric key above is their ``under``. Nothing is looked for inside them.

    A level of containers is written before the next is opened, until one has none, so a level is evaluated once however deep the texts are.
    """
    tvf = landed.sparkSession.tvf
    level = landed.select("source_id", F.lit(None).cast("string").alias("under"), "body")
    whole = None
    while True:
        parsed = cut(level.withColumn("is_row", F.try_variant_get(F.try_parse_json("body"), f"$.{marker}", "string").isNotNull()))
        value = F.try_parse_json("body")
        if whole is not None and parsed.isEmpty():
            return whole
        found = parsed.where("is_row").select("source_id", "under", *[F.try_variant_get(value, f"$.{f}", "string").alias(f) for f in fields])
        whole = found if whole is None else whole.unionByName(found)
        inside = parsed.where("NOT is_row").withColumn("v", value).lateralJoin(tvf.variant_explode(F.col("v").outer()).toDF("pos", "key", "value"))
        below = inside.select("source_id", F.when(F.col("key").rlike(r"^\d+$"), F.col("key")).otherwise(F.col("under")).alias("under"), F.to_json("value").alias("body"))
        level = below.where(F.substring("body", 1, 1).isin("{", "["))


#: A link of a page: the target of an href, or a document or image that src, data-src or content name.
ASSET = r"\.(?:pdf|png|jpe?g|webp|gif)(?:\?[^\"']*)?"
LINK = re.compile(rf"""href\s*=\s*(?:"([^"]+)"|'([^']+)')|(?:src|content)\s*=\s*(?:"([^"]+?{ASSET})"|'([^']+?{ASSET})')""", re.I)
AROUND = 400
ROWS = 64
NEAR = re.compile("schedule|public|open", re.I)


def _links(body: str) -> Iterator[tuple[str, bool]]:
    """Every link of a page, and whether its surroundings, other links included, have a word of schedules."""
    for m in LINK.finditer(body):
        yield m[m.lastindex or 0], NEAR.search(body, max(0, m.start() - AROUND), m.end() + AROUND) is not None


def asset_scores(landed: DataFrame) -> DataFrame:
    """Links of a page by how much they look like a schedule: words of the link count 3, of its surroundings 1, bad words -4; the best of each link."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for one in (batch.slice(i, ROWS) for i in range(0, batch.num_rows, ROWS)):
                found = [(i, *link) for i, body in enumerate(one.column(1).to_pylist()) for link in _links(body or "")]
                at, urls, near = zip(*found, strict=True) if found else ((), (), ())
                yield pa.RecordBatch.from_arrays([one.column(0).take(pa.array(at, pa.int64())), pa.array(urls, pa.string()), pa.array(near, pa.bool_())], names=["source_id", "url", "near"])

    rows = landed.select("source_id", "body")
    links = rows.mapInArrow(run, landed.select("source_id", F.lit("").alias("url"), F.lit(True).alias("near")).schema)
    url = F.lower("url")
    case = lambda test, points: F.when(test, points).otherwise(0)
    points = (
        case(url.rlike("schedule|calendar|hours|page"), 3)
        + case(url.rlike("logo|icon|banner"), -4)
        + case(url.rlike(r"\.(pdf|png|jpe?g)$"), 2)
        + case(F.col("near"), 1)
    )
    return links.select("source_id", "url", points.alias("points")).groupBy("source_id", "url").agg(F.max("points").alias("points")).where("points >= 1")


# The files that may hold a schedule, the words of their names and surroundings, and what these count.
FILES = r"pdf|png|jpe?g|webp|gif"
GOOD = ("schedule", "skat", "stick", "hockey", "public", "calendar", "session", "hours", "flyer", "season", "freestyle", "lesson")
BAD = ("logo", "icon", "sprite", "favicon", "banner", "header", "footer", "avatar", "thumb", "social", "sponsor", "badge", "arrow", "bg-", "background", "affiliate", "usahockey", "facebook", "twitter", "instagram-icon")
NAMED_GOOD, NAMED_BAD, NEAR_GOOD, DOCUMENT, ENOUGH = 3, -4, 2, 1, 1
# End of the fixed values.
FILE = re.compile(rf"""(?:href|src|content)\s*=\s*["']([^"']+\.(?:{FILES})(?:\?[^"']*)?)["']""", re.I)


def _files(body: str, base: str | None) -> dict[str, tuple[int, int]]:
    """Points and first place of every linked document or image, by its whole URL."""
    out: dict[str, tuple[int, int]] = {}
    for m in FILE.finditer(body):
        try:
            url = urljoin(base or "", unescape(m[1]))
        except ValueError:
            continue
        low, near = url.lower(), body[max(0, m.start() - AROUND) : m.end() + AROUND].lower()
        points = NAMED_GOOD * any(w in low for w in GOOD) + NAMED_BAD * any(w in low for w in BAD) + NEAR_GOOD * any(w in near for w in GOOD) + DOCUMENT * bool(re.search(r"\.pdf(\?|$)", low))
        known = out.get(url)
        out[url] = (points, len(out)) if known is None else (max(points, known[0]), known[1])
    return out


def schedule_assets(landed: DataFrame) -> DataFrame:
    """(source_id, url, points, place): documents and images of a page (source_id, url, body) that may hold a schedule, by the words of their names and of 400 characters on both sides.

    A file that is linked more than once counts with its best surroundings; of equal points the first on the page comes first. A page without a URL keeps relative
    links as they are; null pages have none.
    """
    kinds = landed.select("source_id", F.col("url"), F.lit(0).cast("long").alias("points"), F.lit(0).cast("long").alias("first")).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for one in (batch.slice(i, ROWS) for i in range(0, batch.num_rows, ROWS)):
                found = [(i, url, *rest) for i, (base, body) in enumerate(zip(one.column(1).to_pylist(), one.column(2).to_pylist(), strict=True)) for url, rest in _files(body or "", base).items()]
                at, urls, points, first = zip(*found, strict=True) if found else ((), (), (), ())
                yield pa.RecordBatch.from_arrays([one.column(0).take(pa.array(at, pa.int64())), pa.array(urls, pa.string()), pa.array(points, pa.int64()), pa.array(first, pa.int64())], names=["source_id", "url", "points", "first"])

    links = landed.select("source_id", "url", "body").mapInArrow(run, kinds).where(F.col("points") >= ENOUGH)
    order = Window.partitionBy("source_id").orderBy(F.desc("points"), "first")
    return links.withColumn("place", F.row_number().over(order).cast("long")).select("source_id", "url", "points", "place")
