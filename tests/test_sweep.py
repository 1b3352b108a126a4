"""Greedy matching by a sweep against a plain loop over all classes."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from slate.operators import overlap

SLOTS, CLASSES = ("r long, {} long, start_ts timestamp_ntz, end_ts timestamp_ntz, title string, url string".format(c) for c in "sc")


def intervals(n, seed, hours, span):
    rng = random.Random(seed)
    out = []
    for i in range(n):
        start = dt.datetime(2024, 1, 1) + dt.timedelta(minutes=15 * rng.randrange(hours * 4))
        out.append((rng.randrange(2), i + 1000 * seed, start, start + dt.timedelta(minutes=rng.choice(span)), rng.choice(["programs", "named"]), rng.choice([None, f"u{i}"])))
    return out


def plain(slots, classes):
    taken, out = set(), {}
    order = lambda r: (r[2], r[1])
    for s in sorted(slots, key=order):
        for c in sorted(classes, key=order):
            if c[0] == s[0] and c[1] not in taken and c[2] < s[3] and s[2] < c[3]:
                taken.add(c[1])
                out[s[1]] = c
                break
    return out


@pytest.mark.parametrize(("hours", "span"), [(200, (30, 60, 90)), (30, (15, 60, 600)), (60, (1500, 2900)), (10, (0, 15))])
def test_sweep_equals_a_plain_loop(spark, hours, span):
    """Among them touching nights, days without a gap, long spans and empty ones."""
    slots, classes = intervals(90, 1, hours, span), intervals(70, 2, hours, span)
    found = overlap.greedy(spark.createDataFrame(slots, SLOTS), spark.createDataFrame(classes, CLASSES), "r", "s", "c").collect()
    assert {r.s: r.c for r in found} == {s: c[1] for s, c in plain(slots, classes).items()}
    assert len({r.c for r in found}) == len(found)


def test_generic_bookings_take_classes_and_the_rest_is_kept(spark):
    slots, classes = intervals(60, 3, 40, (60, 90)), intervals(50, 4, 40, (45, 60))
    found = overlap.overlaid(spark.createDataFrame(slots, SLOTS), spark.createDataFrame(classes, CLASSES), F.col("title") == "programs", "r", "s", "c", ["title", "url"])
    matched = plain([s for s in slots if s[4] == "programs"], classes)
    want = [(r, s, matched[s][1] if s in matched else None, a, b, matched[s][4] if s in matched else t, (matched[s][5] or u) if s in matched else u) for r, s, a, b, t, u in slots]
    used = {c[1] for c in matched.values()}
    want += [(r, None, c, a, b, t, u) for r, c, a, b, t, u in classes if c not in used]
    assert found.columns == ["r", "s", "c", "start_ts", "end_ts", "title", "url"]
    assert sorted(map(tuple, found.collect()), key=str) == sorted(want, key=str)


def test_no_intervals(spark):
    none = spark.createDataFrame([], SLOTS), spark.createDataFrame([], CLASSES)
    assert overlap.greedy(*none, "r", "s", "c").count() == 0
    assert overlap.overlaid(*none, F.lit(True), "r", "s", "c", ["title"]).count() == 0
