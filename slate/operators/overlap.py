"""Interval joins. Intervals are half open; both sides meet on (key, local day), never on the key alone."""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def with_days(df: DataFrame, start: str, end: str) -> DataFrame:
    """One row for each day that an interval touches."""
    return df.withColumn("o_day", F.explode(F.sequence(F.to_date(start), F.to_date(end))))


def overlapping(left: DataFrame, right: DataFrame, key: str, left_id: str, right_id: str, start: str = "start_ts", end: str = "end_ts") -> DataFrame:
    """Pairs (key, left_id, right_id, overlap_s) of intervals with equal keys that share time.

    A pair that shares several days is found on the first of them only.
    """
    a = with_days(left.select(key, left_id, F.col(start).alias("a_start"), F.col(end).alias("a_end")), "a_start", "a_end")
    b = with_days(right.select(key, right_id, F.col(start).alias("b_start"), F.col(end).alias("b_end")), "b_start", "b_end")
    met = a.join(b, [key, "o_day"]).where("a_start < b_end AND b_start < a_end AND o_day = to_date(greatest(a_start, b_start))")
    seconds = F.unix_timestamp(F.least("a_end", "b_end").cast("timestamp")) - F.unix_timestamp(F.greatest("a_start", "b_start").cast("timestamp"))
    return met.select(key, left_id, right_id, seconds.alias("overlap_s"))


def overlay(blocks: DataFrame, events: DataFrame, key: str, block_id: str, event_id: str) -> DataFrame:
    """Every event's host: the first block (by start, id) that it overlaps; null if there is none. Event ids are distinct.

    No pairs are made. A block that ends no later than an earlier one hosts nothing that the earlier one does not; of the others, ends grow with starts, so the
    first block that ends after an event's start is the last one met on the way down from the latest end. It hosts the event if it starts before the event's end.
    """
    by_start = Window.partitionBy(key, "o_day").orderBy("a_start", "a_id").rowsBetween(Window.unboundedPreceding, -1)
    a = with_days(blocks.where(F.col(key).isNotNull()).select(key, F.col("start_ts").alias("a_start"), F.col("end_ts").alias("a_end"), F.col(block_id).alias("a_id")), "a_start", "a_end")
    first = a.withColumn("before", F.max("a_end").over(by_start)).where("before IS NULL OR a_end > before")
    b = events.select(key, event_id, "start_ts", "end_ts", F.explode_outer(F.sequence(F.to_date("start_ts"), F.to_date("end_ts"))).alias("o_day"))
    sides = b.select(key, "o_day", F.col("start_ts").alias("at"), F.lit(0).alias("side"), event_id, "start_ts", "end_ts").unionByName(
        first.select(key, "o_day", F.col("a_end").alias("at"), F.lit(1).alias("side"), F.struct("a_start", "a_id", "a_end").alias("block")), allowMissingColumns=True
    )
    down = Window.partitionBy(key, "o_day").orderBy(F.desc("at"), "side").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    met = sides.withColumn("block", F.last("block", ignorenulls=True).over(down)).where("side = 0")
    hosts = F.col(key).isNotNull() & (F.col("block.a_start") < F.col("end_ts")) & (F.col("block.a_end") > F.col("start_ts"))
    host = F.min(F.when(hosts, F.struct("block.a_start", "block.a_id")))
    return met.groupBy(key, event_id).agg(host["a_id"].alias("host"))


def members(blocks: DataFrame, events: DataFrame, key: str, block_id: str, event_id: str) -> DataFrame:
    """For each block that overlaps any event: (block_id, n, overlap_s, members), the events' ids by start and id, comma-joined.

    Pairs are as many as the result's ids, so they are never shuffled: a block goes to the day it starts on, an event to each such day whose blocks it may
    overlap, and a sweep over a day in order of start holds what is open at one moment.
    """
    whole = lambda df: df.dropna(subset=[key, "start_ts", "end_ts"])
    a = whole(blocks).select(F.col(key).alias("g_key"), F.to_date("start_ts").alias("home"), F.lit(0).alias("side"), F.col(block_id).alias("id"), "start_ts", "end_ts")
    reach = a.groupBy("g_key", "home").agg(F.max("end_ts").alias("last")).withColumn("o_day", F.explode(F.sequence("home", F.to_date("last"))))
    days = with_days(whole(events).select(F.col(key).alias("g_key"), F.lit(1).alias("side"), F.col(event_id).alias("id"), "start_ts", "end_ts"), "start_ts", "end_ts")
    b = days.join(reach, ["g_key", "o_day"]).where("start_ts < last AND o_day = greatest(home, to_date(start_ts))").select(*a.columns)

    micros = lambda c: F.unix_micros(F.col(c).cast("timestamp"))
    sent = a.unionByName(b).select("g_key", F.unix_date("home").alias("home"), micros("start_ts").alias("start"), "side", "id", micros("end_ts").alias("end"))
    parts = int(blocks.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ordered = sent.repartition(parts, "g_key", "home").sortWithinPartitions("g_key", "home", "start", "side", "id")
    found = ordered.mapInArrow(_listed, "block long, n long, overlap_s long, members string")
    return found.withColumnRenamed("block", block_id)


#: Ids of members in one batch of results.
MEMBERS = 500_000


def _listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Members by one sweep over intervals in order of their starts. Held are the blocks whose end is not passed and the events that one of them or a later one may overlap."""
    now, out, size = None, [], 0
    empty = np.zeros((0, 3), np.int64)
    waiting = held = empty

    def decided(until: float) -> Iterator[tuple]:
        nonlocal waiting, held
        due = waiting[:, 2] <= until
        for block, start, end in waiting[due].tolist():
            near = held[: np.searchsorted(held[:, 1], end)]
            near = near[near[:, 2] > start]
            if len(near):
                seconds = np.minimum(near[:, 2], end) // 1_000_000 - np.maximum(near[:, 1], start) // 1_000_000
                yield block, len(near), int(seconds.sum()), ",".join(map(str, near[:, 0].tolist()))
        waiting = waiting[~due]
        held = held[held[:, 2] > min(until, waiting[:, 1].min(initial=np.iinfo(np.int64).max))]

    def rows() -> Iterator[tuple]:
        nonlocal now, waiting, held
        for batch in batches:
            key, home, start, side, one, end = (c.to_numpy() for c in batch.columns)
            edges = [0, *(np.flatnonzero((key[1:] != key[:-1]) | (home[1:] != home[:-1])) + 1).tolist(), len(key)]
            for i, j in zip(edges, edges[1:], strict=False):
                if i == j:
                    continue
                if (key[i], home[i]) != now:
                    yield from decided(np.inf)
                    now, held = (key[i], home[i]), empty
                part, event = np.column_stack((one, start, end))[i:j], side[i:j] == 1
                waiting, held = np.concatenate((waiting, part[~event])), np.concatenate((held, part[event]))
                yield from decided(int(start[j - 1]))
        yield from decided(np.inf)

    for row in rows():
        out.append(row)
        size += row[1]
        if size >= MEMBERS:
            yield _lists(out)
            out, size = [], 0
    if out:
        yield _lists(out)


def _lists(out: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string())
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), kinds, strict=True)], names=["block", "n", "overlap_s", "members"])


def greedy(slots: DataFrame, classes: DataFrame, key: str, slot_id: str, class_id: str) -> DataFrame:
    """Each slot, by (start, id), takes the first class by (start, id) that overlaps it and is not taken.

    A chain of overlaps never leaves its group: intervals are first cut into clusters by gaps that no interval spans, and each cluster of a key is matched by
    itself, in one sweep in order of start. A task holds the intervals that are open at one moment, so a key that never has a gap is no larger than any other.
    """
    sides = slots.select(F.col(key).alias("g_key"), F.lit(0).alias("side"), F.col(slot_id).alias("id"), "start_ts", "end_ts").unionByName(
        classes.select(F.col(key).alias("g_key"), F.lit(1).alias("side"), F.col(class_id).alias("id"), "start_ts", "end_ts")
    )
    # days without a span over midnight are independent; the cluster starts at the first day of a run of touching days
    days = with_days(sides, "start_ts", "end_ts").select("g_key", "o_day", "side", "id", "start_ts", "end_ts")
    spans = days.groupBy("g_key", "o_day").agg(F.max(F.to_date("end_ts")).alias("last"))


    by_day = Window.partitionBy("g_key").orderBy("o_day")
    marked = spans.withColumn("new", (F.max("last").over(by_day.rowsBetween(Window.unboundedPreceding, -1)) >= F.col("o_day")).eqNullSafe(F.lit(True)))
    run = marked.withColumn("cluster", F.max(F.when(~F.col("new"), F.col("o_day"))).over(by_day.rowsBetween(Window.unboundedPreceding, 0))).select("g_key", "o_day", "cluster")
    placed = sides.withColumn("o_day", F.to_date("start_ts")).join(run, ["g_key", "o_day"])

    micros = lambda c: F.unix_micros(F.col(c).cast("timestamp"))
    sent = placed.select("g_key", F.unix_date("cluster").alias("cluster"), micros("start_ts").alias("start"), "side", "id", micros("end_ts").alias("end"))
    parts = int(slots.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ordered = sent.repartition(parts, "g_key", "cluster").sortWithinPartitions("g_key", "cluster", "start", "side", "id")
    matched = ordered.mapInArrow(_swept, "g_key long, slot long, class long")
    return matched.select(F.col("g_key").alias(key), F.col("slot").alias(slot_id), F.col("class").alias(class_id))


def _swept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Matches by one sweep over intervals in order of their starts. Held are the slots that still wait and the free classes that one of them may take: a slot
    is decided, in its turn, once the sweep has passed its end, and a class that ends before the first waiting slot starts is dropped."""
    now: tuple | None = None
    waiting: deque = deque()
    free: list[tuple] = []
    out: list[tuple] = []

    def decide(until: float) -> None:
        nonlocal free
        while waiting and waiting[0][1] <= until:
            start, end, slot = waiting.popleft()
            free = [c for c in free if c[1] > start]
            first = next((i for i, c in enumerate(free) if c[0] < end), None)
            if first is not None:
                out.append((now[0], slot, free.pop(first)[2]))

    for batch in batches:
        for key, cluster, start, side, one, end in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if (key, cluster) != now:
                decide(float("inf"))
                now, free = (key, cluster), []
            decide(start)
            if side == 0:
                waiting.append((start, end, one))
            elif not waiting or end > waiting[0][0]:
                free.append((start, end, one))
            if not waiting:
                free = [c for c in free if c[1] > start]
        if out:
            yield _matches(out)
            out = []
    decide(float("inf"))
    if out:
        yield _matches(out)


def _matches(out: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out, strict=True)], names=["g_key", "slot", "class"])


def overlaid(bookings: DataFrame, classes: DataFrame, generic: Column, key: str, booking_id: str, class_id: str, taken: list[str]) -> DataFrame:
    """Bookings whose ``generic`` title gives way to the class that ``greedy`` finds for them, and after them all classes that no booking took.

    Both sides have ``key``, start_ts and end_ts. Of a booking that takes a class the columns ``taken`` are the class's where it has them. Result: key, the
    booking's id (null for a class of its own), the class's id (null where none was taken), start_ts, end_ts and ``taken``.
    """
    matched = greedy(bookings.where(generic), classes, key, booking_id, class_id).select(booking_id, class_id)
    theirs = classes.select(class_id, *[F.col(c).alias(f"class_{c}") for c in taken])
    kept = bookings.join(matched, booking_id, "left").join(theirs, class_id, "left")
    own = kept.select(key, booking_id, class_id, "start_ts", "end_ts", *[F.coalesce(f"class_{c}", c).alias(c) for c in taken])
    left = classes.join(matched, class_id, "left_anti")
    return own.unionByName(left.select(key, F.lit(None).cast(bookings.schema[booking_id].dataType).alias(booking_id), class_id, "start_ts", "end_ts", *taken))
