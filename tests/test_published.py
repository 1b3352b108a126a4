"""Feeds that are missing, cut off, of another version or without rows."""

from pyspark.sql import functions as F

from slate.sources import published

ROW = "struct<id:bigint,title:string>"


def test_each_bad_feed_is_one_row(spark):
    good = '{"version":1,"fetchedAt":"t","events":[{"id":1,"title":"a"},{"id":2}],"other":{"x":[1]}}'
    rows = [(1, good), (2, good[:-9]), (3, good.replace('"version":1', '"version":3')), (4, '{"version":1,"events":7}'), (5, '{"version":1,"events":[]}'), (6, ""), (7, None), (8, "[]"), (9, good), (1, good), (None, good)]
    landed = spark.createDataFrame(rows, "source int, body string")
    index = spark.createDataFrame([(i,) for i in (1, 1, 2, 3, 4, 5, 6, 7, 8, 77, None)], "source int")
    found = sorted(((r.source, r.error, r.row.id if r.row else None) for r in published.feeds(index, landed, "source", ROW, "events", 1).collect()), key=str)
    want = [(1, None, 1), (1, None, 2), (2, "not json", None), (3, "other version", None), (4, "no rows", None), (5, None, None), (6, "not json", None), (7, "missing", None), (77, "missing", None), (8, "other version", None)]
    assert found == sorted(want, key=str)


def test_snapshots_of_another_season_are_empty(spark):
    rows = [('{"version":1,"season":"a","teams":[{"id":1}]}',), ('{"version":1,"season":"b","teams":[{"id":2}]}',), ('{"version":1,"season":"a","teams":{}}',), ('{"version":1,"season":"a","teams":[{"id":3}',), (None,)]
    landed = spark.createDataFrame(rows, "body string")
    found = published.snapshot(landed, "struct<id:bigint>", "teams", (F.col("s.version") == 1) & (F.col("s.season") == "a"))
    assert [r.id for r in found.collect()] == [1]


def test_nothing_is_listed(spark):
    none = spark.createDataFrame([], "source int, body string")
    assert published.feeds(none.select("source"), none, "source", ROW, "events", 1).count() == 0
