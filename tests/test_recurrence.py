"""Weekday rules and exceptions, from the landed text to dated rows, and the entry module without a library."""

import datetime as dt
import subprocess
import sys

from pyspark.sql import functions as F

from slate.operators import recur
from slate.sources import landed

TEXT = "\r\n".join(
    """BEGIN:VCALENDAR
BEGIN:VEVENT
UID:a
SUMMARY:Public Skating
DTSTART;TZID=America/New_York:20260907T100000
DTEND;TZID=America/New_York:20260907T120000
RRULE:FREQ=WEEKLY;BYDAY=MO,WE,2FR;UNTIL=20261001T040000Z
EXDATE;TZID=America/New_York:20260916T100000,20260918T100000
EXDATE:20260923T140000Z
END:VEVENT
BEGIN:VEVENT
UID:b
SUMMARY:Evening
DTSTART:20260908T013000Z
DTEND:20260908T023000Z
RRULE:FREQ=WEEKLY;COUNT=5;BYDAY=TU,MO
END:VEVENT
BEGIN:VEVENT
UID:c
SUMMARY:None
DTSTART:20260908T013000Z
RRULE:FREQ=WEEKLY;BYDAY=XX
END:VEVENT
END:VCALENDAR""".split("\n")
)


def test_weekdays_and_exceptions(spark):
    events = landed.ical(spark.createDataFrame([(1, TEXT)], "source_id long, body string"))
    freq, step, until, most = landed.rule_parts(F.col("rule"))
    minutes = ((F.unix_timestamp(F.col("end_ts").cast("timestamp")) - F.unix_timestamp(F.col("start_ts").cast("timestamp"))) / 60).cast("long")
    rules = events.select(
        F.col("uid").alias("event_id"), freq.alias("freq"), step.cast("long").alias("step"), "start_ts", minutes.alias("minutes"), until.alias("until_ts"), most.cast("long").alias("max_count"),
        landed.rule_days(F.col("rule")).alias("by_day"), "except_ts",
    )
    got = {}
    for r in recur.rules(rules, "2026-09-13", "2026-10-10").orderBy("start_ts").collect():
        got.setdefault(r.event_id, []).append((r.start_ts.month, r.start_ts.day, r.start_ts.hour, (r.end_ts - r.start_ts) // dt.timedelta(minutes=1)))
    assert got["a"] == [(9, 14, 14, 120), (9, 21, 14, 120), (9, 25, 14, 120), (9, 28, 14, 120), (9, 30, 14, 120)]
    # the start is on a Tuesday, five hours on; the count has five instances from it, the first before the window
    assert got["b"] == [(9, 14, 1, 60), (9, 15, 1, 60), (9, 21, 1, 60), (9, 22, 1, 60)]
    assert "c" not in got


def test_a_rule_from_long_ago_makes_only_steps_near_the_window(spark):
    rows = [(1, "DAILY", 1, dt.datetime(1900, 1, 1), 60, None, None)]
    rules = spark.createDataFrame(rows, "event_id long, freq string, step long, start_ts timestamp_ntz, minutes long, until_ts timestamp_ntz, max_count long")
    assert [r.k for r in recur.rules(rules, "2024-01-01", "2024-01-03").orderBy("k").collect()] == [45290, 45291]


def test_core_queries_without_a_library_of_the_others():
    code = "import sys; sys.modules['xxhash'] = sys.modules['sentencepiece'] = None; import __spark_entry__ as e; q = e.queries(); print(len(q), [n for n in q if n.startswith('op')])"
    out = subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, check=True).stdout.split(" ", 1)
    assert int(out[0]) > 100 and out[1].strip() == "[]"
