"""Steps whose work once grew with pairs of rows: results against plain loops, and plans without the pairs."""

import datetime as dt
import random

from slate.operators import lookup, overlap
from slate.plans import feeds
from slate.sources import landed


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def _sides(spark, seed=5, n=250):
    rng, t0 = random.Random(seed), dt.datetime(2024, 1, 1)
    lengths = (0, 20, 60, 89, 600, 2000)
    rows = lambda first: [(rng.choice((1, 2, None)), first + i, (s := t0 + dt.timedelta(minutes=rng.randrange(4 * 1440))), s + dt.timedelta(minutes=rng.choice(lengths))) for i in range(n)]
    a, b = [*rows(0), (3, 900, t0, t0 + dt.timedelta(days=3))], [*rows(1000), (1, 2000, None, None)]
    schema = "rink_id long, {} long, start_ts timestamp_ntz, end_ts timestamp_ntz"
    return a, b, spark.createDataFrame(a, schema.format("block_id")), spark.createDataFrame(b, schema.format("event_id"))


def _meet(a, b):
    return a[0] is not None and a[0] == b[0] and b[2] is not None and a[2] < b[3] and b[2] < a[3]


def test_hosts_are_found_without_pairs(spark):
    a, b, blocks, events = _sides(spark)
    found = overlap.overlay(blocks, events, "rink_id", "block_id", "event_id")
    wanted = {e[1]: (e[0], min(((x[2], x[1]) for x in a if _meet(x, e)), default=(None, None))[1]) for e in b}
    assert {r.event_id: (r.rink_id, r.host) for r in found.collect()} == wanted
    assert found.count() == len(b)
    assert "Join" not in _plan(found)


def test_members_of_blocks_are_not_shuffled_as_pairs(spark):
    a, b, blocks, events = _sides(spark, 6)
    found = overlap.members(blocks, events, "rink_id", "block_id", "event_id")
    wanted = {}
    for x in a:
        own = sorted((e[2], e[1], int((min(x[3], e[3]) - max(x[2], e[2])).total_seconds())) for e in b if _meet(x, e))
        if own:
            wanted[x[1]] = (len(own), sum(o[2] for o in own), ",".join(str(o[1]) for o in own))
    assert {r.block_id: (r.n, r.overlap_s, r.members) for r in found.collect()} == wanted
    assert "Exchange" not in _plan(found).split("MapInArrow")[0]


def test_equal_word_sets_are_compared_once(spark, tmp_path):
    rows = spark.createDataFrame([(i, ["a", "b"] if i % 2 else ["b", "c", "b"]) for i in range(40)], "k long, w array<string>")
    others = spark.createDataFrame([(i, ["c", "b", "a"] if i % 3 else ["b", "a"]) for i in range(30)], "o long, v array<string>")
    found = lookup.containing(rows, others, "w", "v", "k", "o")
    assert {tuple(r) for r in found.collect()} == {(i, 30, 0) if i % 2 else (i, 20, 1) for i in range(40)}
    parts = spark.createDataFrame([(1, "red nut", "BIG"), (2, "red nut", None), (3, None, "BIG")], "p_partkey long, p_name string, p_type string")
    parts.write.parquet(f"{tmp_path}/part.parquet")
    assert sorted(tuple(r) for r in feeds.word_contain(spark, str(tmp_path)).collect()) == [(1, 1, 1), (2, 1, 1)]


def test_arrays_in_scripts_are_read_without_python(spark):
    row = '{"EventId": 1, "EventStartTime": "2024-01-01T10:00:00", "EventEndTime": "2024-01-01T11:00:00", "EventTypeName": "a ] [ \\" b"}'
    bodies = [f"<script>var x = [3]; _onlineScheduleList = [{row}]; var y = '[';", f"_onlineScheduleList = [{row}", "no list [1]", "_onlineScheduleList = none", None, f"[0] _onlineScheduleList=[{row},[1]] ]"]
    found = landed.embedded_json(spark.createDataFrame(list(enumerate(bodies)), "source_id long, body string"))
    assert [(r.source_id, r.event_id, r.title) for r in found.collect() if r.source_id < 5] == [(0, 1, 'a ] [ " b')]
    assert "Python" not in _plan(found)
