"""Snapshot state as streams over landed files; each has a batch counterpart with the same result.

The reference behaviour is a daily batch with kept state, so streams run to the end of what has landed (availableNow).
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from slate.session import scratch


def landed(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The files of a table as a stream."""
    schema = spark.read.parquet(f"{sf_dir}/{name}.parquet").schema
    return spark.readStream.schema(schema).option("recursiveFileLookup", "true").parquet(f"{sf_dir}/{name}.parquet*")


def run(stream: DataFrame, mode: str = "append") -> DataFrame:
    """Runs a stream to the end of what has landed and gives what it wrote."""
    spark = stream.sparkSession
    out, state = scratch(spark, "stream-out"), scratch(spark, "stream-state")
    query = stream.writeStream.outputMode(mode).format("parquet").option("checkpointLocation", state).trigger(availableNow=True).start(out)
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(out)


def first_of(stream: DataFrame, keys: list[str]) -> DataFrame:
    """The keys that were met, once each; state is one row per key."""
    return stream.select(*keys).dropDuplicates(keys)


def merged(stream: DataFrame, fold: Callable[[DataFrame, DataFrame], DataFrame], schema: str) -> DataFrame:
    """Folds each micro-batch into a kept table with ``fold(kept, batch)`` and gives the table at the end.

    Every batch writes a new version under its own number and reads the one before, so a repeated batch gives the same version.
    """
    spark = stream.sparkSession
    root, state = scratch(spark, "stream-table"), scratch(spark, "stream-state")
    spark.createDataFrame([], schema).write.parquet(f"{root}/v-1")
    versions = [-1]

    def apply(batch: DataFrame, number: int) -> None:
        kept = batch.sparkSession.read.parquet(f"{root}/v{number - 1}")
        fold(kept, batch).write.mode("overwrite").parquet(f"{root}/v{number}")
        versions.append(number)

    query = stream.writeStream.foreachBatch(apply).option("checkpointLocation", state).trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.parquet(f"{root}/v{max(versions)}")


def latest(kept: DataFrame, batch: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The row of each key that is last in ``order``, of kept and new rows."""
    whole = kept.unionByName(batch.select(*kept.columns))
    names = [c for c in kept.columns if c not in keys]
    return whole.groupBy(*keys).agg(F.max_by(F.struct(*names), F.struct(*order)).alias("row")).select(*keys, "row.*")
