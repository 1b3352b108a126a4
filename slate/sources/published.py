"""Published feeds and snapshots as relations: whole JSON files with a version and a shape that are checked before anything of them is used.

A feed that is missing, cut off, of another version or without its rows becomes one row with an error and no data, so one bad file never empties or stops the
others. An optional snapshot that fails its checks is an empty relation. Files are read by Spark, from any store that it reads, each by one task.

Cases: an empty or null file is cut off; a feed with an empty list of rows is right and gives none; of repeated files of one source the one with the
smallest text counts; sources that the index does not list are left out, and a null source is never listed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

MISSING, CUT_OFF, VERSION, SHAPE = "missing", "not json", "other version", "no rows"


def files(spark: SparkSession, folder: str, key: str) -> DataFrame:
    """(key, body): the whole texts of a folder that is partitioned by ``key``."""
    return spark.read.option("wholetext", True).text(folder).select(F.col(key), F.col("value").alias("body"))


def publish(rows: DataFrame, folder: str, key: str) -> None:
    """Writes ``body`` as one file for each ``key``."""
    rows.select(key, "body").repartition(key).write.partitionBy(key).text(folder)


def feeds(index: DataFrame, landed: DataFrame, key: str, row: str, rows: str, version: int) -> DataFrame:
    """(key, error, fetched_at, row): the rows of every feed that ``index`` lists, or one row with what is wrong with it.

    A feed is {"version": n, "fetchedAt": text, rows: [...]}; ``row`` is the type of one of its rows. A right feed without rows has one row of nulls.
    """
    once = landed.where(F.col(key).isNotNull()).groupBy(key).agg(F.min("body").alias("body"))
    listed = index.select(key).where(F.col(key).isNotNull()).distinct().join(once, key, "left")
    envelope = F.from_json("body", f"struct<version:bigint,fetchedAt:string,`{rows}`:array<{row}>>")
    read = listed.withColumn("whole", F.try_parse_json("body").isNotNull()).withColumn("feed", envelope)
    error = (
        F.when(F.col("body").isNull(), MISSING)
        .when(~F.col("whole"), CUT_OFF)
        .when(~F.coalesce(F.col("feed.version") == version, F.lit(False)), VERSION)
        .when(F.col(f"feed.`{rows}`").isNull(), SHAPE)
    )
    judged = read.withColumn("error", error)
    good = F.when(F.col("error").isNull(), F.col(f"feed.`{rows}`"))
    return judged.select(key, "error", F.when(F.col("error").isNull(), F.col("feed.fetchedAt")).alias("fetched_at"), F.explode_outer(good).alias("row"))


def snapshot(landed: DataFrame, row: str, rows: str, holds: Column) -> DataFrame:
    """The rows of the snapshots in ``landed`` (body) for which ``holds`` is true, over s.version, s.season and s.fetchedAt; none of any other."""
    kind = f"struct<version:bigint,season:string,fetchedAt:string,`{rows}`:array<{row}>>"
    read = landed.where(F.try_parse_json("body").isNotNull()).select(F.from_json("body", kind).alias("s"))
    return read.where(F.coalesce(holds, F.lit(False)) & F.col(f"s.`{rows}`").isNotNull()).select(F.explode(F.col(f"s.`{rows}`")).alias("row")).select("row.*")
