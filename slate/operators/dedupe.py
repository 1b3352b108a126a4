"""Keyed deduplication with stated winners, upserts, and what is kept from earlier runs.

Winners are aggregates (min_by / max_by over a total order), so they combine before the shuffle and a hot key costs
no more than others.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _whole(df: DataFrame) -> Column:
    return F.struct(*[F.col(f"`{c}`") for c in df.columns])


def keep_first(df: DataFrame, keys: Sequence[Column], order: Sequence[Column]) -> DataFrame:
    """Of the rows with equal keys (nulls equal) the one that is first in ``order``, which must be total."""
    named = [k.alias(f"k{i}") for i, k in enumerate(keys)]
    return df.groupBy(*named).agg(F.min_by(_whole(df), F.struct(*order)).alias("row")).select("row.*")


def keep_last(df: DataFrame, keys: Sequence[Column], order: Sequence[Column]) -> DataFrame:
    named = [k.alias(f"k{i}") for i, k in enumerate(keys)]
    return df.groupBy(*named).agg(F.max_by(_whole(df), F.struct(*order)).alias("row")).select("row.*")


def upsert(tables: Sequence[DataFrame], keys: Sequence[str]) -> DataFrame:
    """Union by key; later tables win. Each table has one row per key."""
    ranked = [t.withColumn("u_rank", F.lit(i)) for i, t in enumerate(tables)]
    whole = ranked[0]
    for t in ranked[1:]:
        whole = whole.unionByName(t)
    return keep_last(whole, [F.col(k) for k in keys], [F.col("u_rank")]).drop("u_rank")


def insert_only(known: DataFrame, new: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """``known`` plus the first new row of each key that is not known."""
    fresh = keep_first(new, [F.col(k) for k in keys], order).join(known.select(*keys), list(keys), "left_anti")
    return known.unionByName(fresh)


def keep_previous(now: DataFrame, before: DataFrame, group: str, failed: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows of now, and the previous rows of failed groups whose keys are not reported again."""
    kept = before.join(failed.select(group).distinct(), group, "left_semi").join(now.select(*keys), list(keys), "left_anti")
    return now.unionByName(kept)


def not_stale(now: DataFrame, before: DataFrame, group: str, failed: DataFrame, verified: str, as_of: str, hours: int = 48) -> DataFrame:
    """Sources that answered are replaced whole; the rows of failed ones stay up to ``hours`` after they were verified."""
    fresh = F.col(verified) >= F.lit(as_of).cast("timestamp_ntz") - F.expr(f"INTERVAL {hours} HOURS")
    kept = before.join(failed.select(group).distinct(), group, "left_semi").where(fresh)
    return now.join(failed.select(group).distinct(), group, "left_anti").unionByName(kept)


def slot_merge(df: DataFrame, slot: Sequence[Column], members: str, notes: Sequence[str]) -> DataFrame:
    """One row per slot: the sorted union of member names and each note's distinct values, sorted and joined."""
    named = [k.alias(f"slot{i}") for i, k in enumerate(slot)]
    joined = [F.concat_ws(" / ", F.array_sort(F.collect_set(n))).alias(n) for n in notes]
    return df.groupBy(*named).agg(F.array_join(F.array_sort(F.collect_set(members)), ",").alias(members), *joined)
