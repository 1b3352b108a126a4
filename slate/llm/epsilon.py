"""Near-duplicate vectors by an epsilon grid order join.

Vectors of length one whose cosine is at least ``similarity`` lie within epsilon = sqrt(2 - 2 * similarity) of each other. They are
sorted by the epsilon-wide grid cells of their leading principal axes, cell after cell, and the sorted sequence is cut into
blocks. The join opens pairs of sequence intervals, from the whole sequence down to blocks, and skips every pair whose boxes lie
further apart than epsilon. The pairs of blocks that are left are compared in full, in double precision.

A task holds one interval of eight blocks and sees its partner blocks one after the other, so memory does not grow with the
input. Tasks return the number of links of each vector and pointers that connect what is linked, never the pairs. Exact copies
are one vector with a weight, so a vector that a third of all rows share costs no more than any other; rows find their vector
again by a hash of 128 bits and one of 64 salts. Near copies that are no exact copies are compared with each other: so dense a place is quadratic,
in blocks of bounded size.

Cases: a null vector, one with null or non-finite components, an empty one and one of zeros link with nothing and are their own component; vectors of different
lengths do not link; every row is returned, repeated rows too, and each copy counts as a link; a null id names a component only where no
other id does, and is kept then; negative zeros are zeros; an empty table gives an empty table; other columns are not read, whatever their names are.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from slate.llm import vectors as V
from slate.llm.batches import partitions
from slate.llm.graph import components
from slate.session import cut

SIMILARITY = 0.95
SALTS = 64
PLACE_BITS = 16
CHUNK_BITS = 6


def unit(x: np.ndarray) -> np.ndarray:
    """Vectors scaled to length one; scaled by their largest component first, so that no square is lost."""
    largest = np.abs(x).max(axis=1, keepdims=True, initial=0)
    x = x / np.where(largest > 0, largest, 1)
    norms = np.sqrt((x * x).sum(axis=1, keepdims=True))
    return x / np.where(norms > 0, norms, 1)


def _pointers(hits: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """(row, column) pointers that connect the rows and columns of each component of a bipartite table: each column to the component's first row, each
    row to its first column."""
    rows, columns = np.flatnonzero(hits.any(axis=1)), np.flatnonzero(hits.any(axis=0))
    hits = hits[np.ix_(rows, columns)]
    free = np.ones(len(rows), bool)
    out = []
    for first in range(len(rows)):
        if not free[first]:
            continue
        own_rows = np.zeros(len(rows), bool)
        own_columns = np.zeros(len(columns), bool)
        front = np.array([first])
        own_rows[first] = True
        while len(front):
            new = hits[front].any(axis=0) & ~own_columns
            own_columns |= new
            front = np.flatnonzero(hits[:, new].any(axis=1) & ~own_rows)
            own_rows[front] = True
        free &= ~own_rows
        at = np.flatnonzero(own_columns)
        others = np.flatnonzero(own_rows)
        others = others[others != first]
        out.append((np.concatenate((np.full(len(at), rows[first]), rows[others])), np.concatenate((columns[at], np.full(len(others), columns[at[0]])))))
    return out


def _compared(similarity: float):  # noqa: ANN202
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held, counts = None, {}, {}

        def total() -> Iterator[pa.RecordBatch]:
            for code, found in counts.items():
                at = np.flatnonzero(found)
                if len(at):
                    yield _rows((code << PLACE_BITS) + at, found[at], None)

        for batch in batches:
            for task in batch.to_pylist():
                if now != (task["tile"], task["chunk"]):
                    yield from total()
                    now, held, counts = (task["tile"], task["chunk"]), {}, {}
                x = unit(V.unpacked(task["vecs"], task["size"], task["dim"]))
                weights = np.array(task["n"], np.int64)
                if task["role"] == 0:
                    held[task["code"]] = x, weights
                    counts[task["code"]] = np.zeros(len(x), np.int64)
                    continue
                base = task["tile"] << V.TILE_BITS
                own = np.zeros(len(x), np.int64)
                for i in range(1 << V.TILE_BITS):
                    if not task["mask"] >> i & 1:
                        continue
                    left, left_weights = held[base + i]
                    hits = left @ x.T >= similarity
                    same = base + i == task["code"]
                    if same:
                        np.fill_diagonal(hits, False)
                    if not hits.any():
                        continue
                    counts[base + i] += hits @ weights
                    if not same:
                        own += left_weights @ hits
                    for a, b in _pointers(hits):
                        yield _rows((base + i << PLACE_BITS) + a, np.zeros(len(a), np.int64), (task["code"] << PLACE_BITS) + b)
                at = np.flatnonzero(own)
                if len(at):
                    yield _rows((task["code"] << PLACE_BITS) + at, own[at], None)
        yield from total()

    return run


def _rows(node: np.ndarray, links: np.ndarray, other: np.ndarray | None) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(node, pa.int64()), pa.array(links, pa.int64()), pa.array(other, pa.int64()) if other is not None else pa.nulls(len(node), pa.int64())], names=["node", "links", "other"])


def joined(made: DataFrame, similarity: float) -> DataFrame:
    """(node, links, other), written: numbers of links (other is null) and pointers between linked nodes (links is zero)."""
    wide = 2 - 2 * similarity + 1e-9
    pairs = V.descend(made, made, (F.col("a_code") <= F.col("b_code")) & (V.box_distance() <= F.lit(wide)))
    tile = F.shiftright("a", V.TILE_BITS)
    bit = F.call_function("shiftleft", F.lit(1), F.col("a").bitwiseAND(F.lit((1 << V.TILE_BITS) - 1)).cast("int"))
    asked = cut(pairs.groupBy(tile.alias("tile"), F.shiftright("b", CHUNK_BITS).alias("chunk"), F.col("b").alias("code")).agg(F.bit_or(bit).alias("mask")))
    columns = ["tile", "chunk", "role", "code", "mask", "dim", "size", "n", "vecs"]
    held = asked.select("tile", "chunk").distinct().join(made.withColumn("tile", F.shiftright("code", V.TILE_BITS)), "tile").withColumns({"role": F.lit(0), "mask": F.lit(0)})
    passing = asked.join(made, "code").withColumn("role", F.lit(1))
    tasks = held.select(*columns).unionByName(passing.select(*columns))
    dealt = tasks.repartition(partitions(made), "tile", "chunk").sortWithinPartitions("tile", "chunk", "role", "code")
    return cut(dealt.mapInArrow(_compared(similarity), "node long, links long, other long"))


def near_duplicates(df: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", similarity: float = SIMILARITY) -> DataFrame:
    """id, n_links, component_id (the smallest id of the component) and kept for every row. Ids are integers; 0 < similarity <= 1."""
    if not 0 < similarity <= 1:
        raise ValueError("similarity must be above 0 and at most 1")
    vec = V.narrow(df, vec_col)
    usable = V.finite(F.col(f"`{vec_col}`")) & F.exists(F.col(f"`{vec_col}`"), lambda x: x != 0)
    rows = cut(
        df.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.when(usable, vec).alias("vec")).withColumns(
            {"h1": F.xxhash64("vec"), "h2": F.xxhash64(F.lit(1), "vec"), "salt": F.pmod(F.xxhash64("id"), F.lit(SALTS)).cast("int")}
        )
    )
    linked = rows.where("vec is not null")
    # at most 64 rows a vector are left after the first grouping, so no group of copies meets in one task
    parts = cut(linked.groupBy("h1", "h2", "salt").agg(F.min("id").alias("id"), F.count("*").alias("n"), F.any_value("vec").alias("vec")))
    texts = parts.groupBy("h1", "h2").agg(F.min("id").alias("id"), F.sum("n").alias("n"), F.any_value("vec").alias("vec"))
    made = V.blocks(texts.withColumn("grp", F.lit(0).cast("long")), unit, ("id", "n", "h1", "h2"), math.sqrt(max(2 - 2 * similarity, 1e-12)))
    found = joined(made, similarity)
    counts = found.where("other is null").groupBy("node").agg(F.sum("links").alias("links"))
    roots = components(found.where("other is not null").select(F.col("node").alias("a"), F.col("other").alias("b"))).withColumnRenamed("node", "r_node")
    lists = made.select("code", F.posexplode(F.arrays_zip("id", "n", "h1", "h2")).alias("place", "x"))
    named = lists.select((F.shiftleft("code", PLACE_BITS) + F.col("place")).alias("node"), "x.*")
    known = cut(named.join(counts, "node", "left").join(roots, F.col("node") == F.col("r_node"), "left").select("id", "n", "h1", "h2", F.coalesce("links", F.lit(0)).alias("links"), F.coalesce("root", "node").alias("root")))
    least = known.groupBy("root").agg(F.min("id").alias("component_id"))
    per_vector = known.join(least, "root").select("h1", "h2", (F.col("links") + F.col("n") - 1).alias("n_links"), "component_id")
    per_part = parts.select("h1", "h2", "salt").join(per_vector, ["h1", "h2"])
    linked = linked.select("id", "h1", "h2", "salt").join(per_part, ["h1", "h2", "salt"]).select("id", "n_links", "component_id")
    alone = rows.where("vec is null").select("id", F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"))
    both = linked.unionByName(alone)
    return both.select(F.col("id").alias(id_col), "n_links", "component_id", F.col("id").eqNullSafe(F.col("component_id")).alias("kept"))


def query(embeddings: DataFrame) -> DataFrame:
    """op12: every vector's number of links and its component."""
    return near_duplicates(embeddings)
