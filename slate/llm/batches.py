"""Small helpers for operators that work on Arrow batches of texts."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

SLICE_BYTES = 4 << 20
PARTITION_BYTES = 128 << 20


def partitions(df: DataFrame, each: int = PARTITION_BYTES) -> int:
    """Partitions for an explicit shuffle of ``df``: the session's number, or more where the files it reads have more than ``each`` bytes for each of them.

    Inputs that are no files (rows of the driver, say) have no known size and do not count.
    """
    leaves = df._jdf.queryExecution().optimizedPlan().collectLeaves()
    files = [leaf for leaf in map(leaves.apply, range(leaves.size())) if leaf.nodeName() == "LogicalRelation"]
    size = sum(int(str(leaf.stats().sizeInBytes())) for leaf in files)
    return max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), min(-(-size // each), 1 << 17))


def sliced(batches: Iterator[pa.RecordBatch], text: int, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The batches, cut where the texts of column ``text`` pass ``limit`` bytes. A longer text stands alone."""
    for batch in batches:
        lengths = pc.fill_null(pc.binary_length(batch.column(text)), 0).to_pylist() if batch.nbytes > limit else []
        start = held = 0
        for i, n in enumerate(lengths):
            if held and held + n > limit:
                yield batch.slice(start, i - start)
                start, held = i, 0
            held += n
        yield batch.slice(start)
