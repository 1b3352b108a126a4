"""Labels that are learnt once and looked up afterwards, with two writers at a time."""

from pyspark.sql import functions as F

from slate.session import scratch
from slate.streaming import versions


def titles(spark, *rows):
    return spark.createDataFrame(list(rows), "rink_id string, title_norm string")


def test_second_run_looks_up_what_the_first_learnt(spark):
    table = versions.Versions(spark, scratch(spark, "labels"), versions.LABELS)
    asked = []

    def judge(new):
        asked.append(sorted(((r.rink_id, r.title_norm) for r in new.collect()), key=str))
        return new.withColumn("category", F.when(F.col("title_norm") != "odd", F.lit("open")))

    versions.learn(table, titles(spark, ("1", "a"), ("1", "a"), ("2", "b"), ("1", "odd"), ("1", None)), judge, 1)
    found = versions.learn(table, titles(spark, ("1", "a"), ("2", "a"), ("2", "b"), ("1", "odd"), (None, "c")), judge, 2)
    assert asked[0] == [("1", "a"), ("1", "odd"), ("2", "b")]
    assert asked[1] == sorted([("2", "a"), ("1", "odd"), (None, "c")], key=str)
    assert sorted((str(r.rink_id), r.title_norm, r.run) for r in found.collect()) == [("1", "a", 1), ("2", "a", 2), ("2", "b", 1), ("None", "c", 2)]


def test_labels_of_all_rinks(spark):
    table = versions.Versions(spark, scratch(spark, "labels"), versions.LABELS)
    assert table.swap(0, spark.createDataFrame([("*", "a", "open", "hand", 0)], versions.LABELS))
    labels = table.latest()[1]
    assert [(r.rink_id, r.title_norm) for r in versions.unknown(titles(spark, ("1", "a"), ("1", "b")), labels).collect()] == [("1", "b")]


def test_two_writers_lose_nothing(spark):
    root = scratch(spark, "labels")
    one, two = (versions.Versions(spark, root, "k string, n long") for _ in range(2))
    row = lambda k, n: spark.createDataFrame([(k, n)], "k string, n long")
    merges = []

    def slow(rows):
        # while this one merges, the other writes
        if not merges:
            two.update(lambda r: r.unionByName(row("two", 2)))
        merges.append(1)
        return rows.unionByName(row("one", 1))

    found = one.update(slow)
    assert len(merges) == 2 and sorted(r.k for r in found.collect()) == ["one", "two"]
    number, rows = two.latest()
    assert number == 2 and not one.swap(1, rows) and one.swap(2, rows)
