"""Recurring patterns, expanded into dated rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def weekly(patterns: DataFrame, first: str, last: str, closures: DataFrame | None = None) -> DataFrame:
    """Patterns (pattern_id, days, start_minute, end_minute, valid_from, valid_to) on each of their days in [first, last].

    ``days``: 0 is Sunday. Validity and closures (from_day, to_day) include both ends; an end that is not after its start is on
    the next day.
    """
    begin = F.greatest(F.lit(first).cast("date"), F.coalesce("valid_from", F.lit(first).cast("date")))
    stop = F.least(F.lit(last).cast("date"), F.coalesce("valid_to", F.lit(last).cast("date")))
    days = F.when(begin <= stop, F.sequence(begin, stop))
    dated = patterns.withColumn("day", F.explode(days)).where(F.array_contains("days", (F.dayofweek("day") - 1).cast("long")))
    if closures is not None:
        dated = dated.join(closures, F.col("day").between(F.col("from_day"), F.col("to_day")), "left_anti")
    at = lambda minutes: F.expr(f"CAST(day AS TIMESTAMP_NTZ) + make_interval(0, 0, 0, 0, 0, CAST({minutes} AS INT), 0)")
    return dated.select("pattern_id", "day", at("start_minute").alias("start_ts"), at("CASE WHEN end_minute <= start_minute THEN end_minute + 1440 ELSE end_minute END").alias("end_ts"))


#: Instances may stand on a later day of their week than its first one.
_WEEK = 6


def rules(events: DataFrame, first: str, last: str) -> DataFrame:
    """Daily and weekly rules (event_id, freq, step, start_ts, minutes, until_ts, max_count), within [first, last).

    Steps are fixed lengths of 24 hours from the start, in UTC. Two further columns are read if there: ``by_day`` (weekdays, 0 is Sunday) puts
    instances of a weekly rule on these days from each of its weekly steps on, in ascending distance (an empty list gives none);
    an instance within 24 hours of one of ``except_ts`` and on the same day of the month (UTC) is left out. ``max_count`` counts instances from
    the start, those before the window and those left out included. Other frequencies give their first instance only. Only steps near the window are made.
    """
    weekly = F.col("freq") == "WEEKLY"
    every = F.when(F.col("freq") == "DAILY", F.col("step")).when(weekly, F.col("step") * 7)
    stamp = lambda text: F.lit(text).cast("timestamp_ntz")
    seconds = lambda c: F.unix_timestamp(c.cast("timestamp"))
    if "by_day" in events.columns:
        # five hours on, so that a start shortly before midnight UTC is on its local day
        own_day = F.dayofweek(F.col("start_ts") + F.expr("INTERVAL 5 HOURS")) - 1
        offsets = F.when(weekly & F.col("by_day").isNotNull(), F.array_sort(F.transform("by_day", lambda d: F.pmod(d.cast("int") - own_day, F.lit(7)))))
    else:
        offsets = F.lit(None).cast("array<int>")
    stop = F.least(stamp(last), F.coalesce("until_ts", stamp(last)))
    most = F.when(every.isNull(), 1).otherwise(F.coalesce("max_count", F.lit(1 << 30)))
    length = 86400 * F.coalesce(every, F.lit(1))
    lowest = F.greatest(F.lit(0), F.ceil((seconds(stamp(first)) - seconds(F.col("start_ts")) - 86400 * _WEEK) / length)).cast("int")
    highest = F.floor((seconds(stop) - seconds(F.col("start_ts"))) / length).cast("int")
    highest = F.when(every.isNull(), F.least(highest, F.lit(0))).otherwise(highest)
    stepped = events.select(
        "*",
        F.coalesce(every, F.lit(1)).alias("every"),
        most.cast("int").alias("most"),
        F.coalesce(offsets, F.array(F.lit(0))).alias("offsets"),
        F.explode(F.when(lowest <= highest, F.sequence(lowest, highest))).alias("base"),
    ).select("*", F.posexplode("offsets").alias("place", "offset"))
    at = lambda minutes: F.expr(f"start_ts + make_interval(0, 0, 0, CAST(base * every + offset AS INT), 0, {minutes}, 0)")
    excepted = F.col("except_ts") if "except_ts" in events.columns else F.lit(None).cast("array<timestamp_ntz>")
    dated = stepped.select(
        "event_id", (F.col("base") * F.size("offsets") + F.col("place")).cast("long").alias("k"), at("0").alias("start_ts"), at("CAST(minutes AS INT)").alias("end_ts"), "most", stop.alias("stop"), excepted.alias("except_ts")
    )
    left_out = F.exists("except_ts", lambda x: (F.abs(seconds(x) - seconds(F.col("start_ts"))) < 86400) & (F.dayofmonth(x) == F.dayofmonth("start_ts")))
    kept = (F.col("k") < F.col("most")) & (F.col("start_ts") <= F.col("stop")) & (F.col("start_ts") >= stamp(first)) & (F.col("start_ts") < stamp(last)) & ~F.coalesce(left_out, F.lit(False))
    return dated.where(kept).select("event_id", "k", "start_ts", "end_ts")


def tiles(ranges: DataFrame, days: int) -> DataFrame:
    """Ranges (range_id, from_day, to_day) in pieces of so many days; the last is clipped."""
    starts = F.explode(F.sequence("from_day", "to_day", F.expr(f"INTERVAL {days} DAYS")))
    cut = ranges.select("range_id", "to_day", starts.alias("tile_from"))
    return cut.select("range_id", "tile_from", F.least("to_day", F.date_add("tile_from", days - 1)).alias("tile_to"))


def month_grid(months: DataFrame) -> DataFrame:
    """Months (month: a first day) as the 42 days from the Sunday on or before it; week six stays only where it is in the month."""
    first = F.date_sub("month", F.dayofweek("month") - 1)
    cells = months.select("month", F.posexplode(F.sequence(first, F.date_add(first, 41))).alias("cell", "day"))
    sixth = F.max(F.when(F.col("cell") >= 35, F.date_trunc("month", "day") == F.col("month").cast("timestamp"))).over(Window.partitionBy("month"))
    return cells.withColumn("sixth", sixth).where("cell < 35 OR sixth").select("month", F.col("cell").cast("long").alias("cell"), "day")
