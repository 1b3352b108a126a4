"""Vectors in sorted blocks and boxes over intervals of the blocks: what the operators on embeddings share.

Rows are sorted by grid cells on their leading principal axes and cut into blocks of consecutive rows. Blocks are the
leaves of a tree: 32 consecutive nodes of a level make a node of the next. A node has a box of its rows' coordinates on the
axes, and the largest norm of what the axes leave out. ``descend`` goes down two trees at once, one join a level, and
keeps the pairs of nodes that a predicate over their boxes allows.

The axes are fitted on a bounded sample (``SAMPLE`` rows, the least by hash). They decide the order and how tight the boxes
are, never which rows are compared: any orthonormal axes give the same results. Vectors of different lengths never meet.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from slate.llm.batches import partitions
from slate.session import cut

AXES = 16
SAMPLE = 4096
WIDTH = 1024
BLOCK_ROWS, BLOCK_BYTES = 512, 1 << 20
FAN_BITS = 5
TILE_BITS = 3
BATCH_BYTES = 16 << 20

Prepare = Callable[[np.ndarray], np.ndarray]


def finite(vec: Column) -> Column:
    """True for a vector of numbers; false for a null one or one with null or non-finite components."""
    inside = F.forall(vec, lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) < float("inf")))
    return vec.isNotNull() & F.coalesce(inside, F.lit(False))


def narrow(df: DataFrame, vec_col: str) -> Column:
    """The vector column as floats where it has floats, else as doubles; a negative zero is zero."""
    kind = df.schema[vec_col].dataType
    element = "float" if isinstance(kind, T.ArrayType) and isinstance(kind.elementType, T.FloatType) else "double"
    return F.transform(F.col(f"`{vec_col}`").cast(f"array<{element}>"), lambda x: x + F.lit(0.0).cast(element))


def bounded_batches(df: DataFrame) -> None:
    """Arrow batches of blocks are bounded in bytes."""
    df.sparkSession.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def axes(rows: DataFrame, prepare: Prepare, column: str = "vec", sample: int = SAMPLE) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """By vector length: orthonormal axes, one a row, by falling variance in the sample, and the spread on each axis."""
    taken = rows.select(column).orderBy(F.xxhash64(column)).limit(sample).toArrow().column(0).to_pylist()
    out = {}
    for length in {len(x) for x in taken if x}:
        x = prepare(np.array([v for v in taken if len(v) == length], np.float64))[:, :WIDTH]
        with np.errstate(over="ignore", invalid="ignore"):
            spread = np.cov(x.T).reshape(x.shape[1], x.shape[1]) if len(x) > 1 else np.eye(x.shape[1])
        # where squares are beyond doubles, the coordinates themselves are the axes
        values, turned = np.linalg.eigh(spread if np.isfinite(spread).all() else np.eye(x.shape[1]))
        top = np.argsort(-values, kind="stable")[:AXES]
        whole = np.zeros((len(top), length))
        whole[:, : x.shape[1]] = turned[:, top].T
        out[length] = whole, np.sqrt(np.maximum(values[top], 1e-12))
    return out


def axes_of(fitted: dict[int, tuple[np.ndarray, np.ndarray]], length: int) -> tuple[np.ndarray, np.ndarray]:
    """The axes of one length; the first coordinates where the sample had no vector of that length."""
    return fitted.get(length) or (np.eye(min(AXES, length), length), np.ones(min(AXES, length)))


def matrix(column: pa.Array, at: np.ndarray, length: int) -> np.ndarray:
    """Rows ``at`` of a list column, all of one length, as doubles."""
    return column.take(pa.array(at)).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(at), length)


def keyed(rows: DataFrame, fitted: dict[int, tuple[np.ndarray, np.ndarray]], prepare: Prepare, cell: float | None) -> DataFrame:
    """``rows`` with v_dim (length) and v_key: one byte a cell, so that keys sort as grid cells do. A cell is as wide as ``cell`` or else as the axis' spread."""
    schema = T.StructType([*rows.schema.fields, T.StructField("v_dim", T.IntegerType()), T.StructField("v_key", T.BinaryType())])
    place = rows.columns.index("vec")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            vec = batch.column(place)
            dims = vec.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
            keys = np.empty(len(dims), object)
            for length in np.unique(dims).tolist():
                at = np.flatnonzero(dims == length)
                own, spread = axes_of(fitted, length)
                cells = np.floor(prepare(matrix(vec, at, length)) @ own.T / (cell or spread))
                for i, row in zip(at.tolist(), np.clip(cells + 128, 0, 255).astype(np.uint8), strict=True):
                    keys[i] = row.tobytes()
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(dims, pa.int32()), pa.array(keys, pa.binary())], names=schema.names)

    return rows.mapInArrow(run, schema)


BLOCK = "part int, place int, dim int, grp long, size int, vecs binary, lo array<double>, hi array<double>, res double"


def blocks(rows: DataFrame, prepare: Prepare, carry: tuple[str, ...], cell: float | None = None, extra: str = "", more: Callable[[np.ndarray, list], list[pa.Array]] | None = None) -> DataFrame:
    """Written blocks of ``rows`` (grp long, vec array and the long columns ``carry``), sorted by length, grp and grid cell.

    A block has one length, one grp and at most ``BLOCK_ROWS`` rows and ``BLOCK_BYTES`` bytes of vectors; ``code`` is its place in the whole order. The columns ``carry`` become
    lists. ``more`` makes the columns ``extra`` from a block's prepared vectors and the list of its first carried column.
    """
    bounded_batches(rows)
    single = isinstance(rows.schema["vec"].dataType.elementType, T.FloatType)
    fitted = axes(rows, prepare)
    # beyond the cell, rows are parted by hash, so that any number of rows of one cell is cut evenly
    order = ["v_dim", "grp", "v_key", "v_tie", *carry]
    ready = keyed(rows.select("grp", "vec", *carry), fitted, prepare, cell).withColumn("v_tie", F.xxhash64("vec"))
    dealt = ready.repartitionByRange(partitions(rows), *order).sortWithinPartitions(*order).select("v_dim", "grp", "vec", *carry)
    kind = np.dtype("<f4" if single else "<f8")
    schema = ", ".join([BLOCK, *[f"{c} array<long>" for c in carry], *([extra] if extra else [])])
    names = [field.split(" ")[0] for field in schema.split(", ")]

    def block(part: int, place: int, what: tuple, carried: list[list], raw: np.ndarray) -> pa.RecordBatch:
        x = prepare(raw)
        own = axes_of(fitted, what[0])[0]
        on = np.zeros((len(x), AXES))
        on[:, : len(own)] = x @ own.T
        with np.errstate(over="ignore", invalid="ignore"):
            rest = np.nan_to_num(np.sqrt(((x - on[:, : len(own)] @ own) ** 2).sum(axis=1)).max(), nan=np.inf, posinf=np.inf)
        plain = [pa.array([v], t) for v, t in ((part, pa.int32()), (place, pa.int32()), (what[0], pa.int32()), (what[1], pa.int64()), (len(x), pa.int32()), (raw.astype(kind).tobytes(), pa.binary()))]
        boxes = [pa.array([on.min(axis=0).tolist()], pa.list_(pa.float64())), pa.array([on.max(axis=0).tolist()], pa.list_(pa.float64())), pa.array([float(rest)])]
        lists = [pa.array([v], pa.list_(pa.int64())) for v in carried]
        return pa.RecordBatch.from_arrays([*plain, *boxes, *lists, *(more(x, carried[0]) if more else [])], names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, place, now = TaskContext.get().partitionId(), 0, (0, None)
        carried: list[list] = [[] for _ in carry]
        held: list[np.ndarray] = []
        for batch in batches:
            dims, grps = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            lists = [batch.column(3 + i).to_pylist() for i in range(len(carry))]
            start = 0
            while start < len(dims):
                what = dims[start], grps[start]
                room = max(1, min(BLOCK_ROWS, BLOCK_BYTES // (kind.itemsize * max(1, what[0]))))
                if held and (what != now or len(carried[0]) >= room):
                    yield block(part, place, now, carried, np.concatenate(held))
                    place, carried, held = place + 1, [[] for _ in carry], []
                now, stop = what, start
                while stop < len(dims) and len(carried[0]) + stop - start < room and (dims[stop], grps[stop]) == what:
                    stop += 1
                held.append(matrix(batch.column(2), np.arange(start, stop), what[0]))
                for own, values in zip(carried, lists, strict=True):
                    own += values[start:stop]
                start = stop
        if held:
            yield block(part, place, now, carried, np.concatenate(held))

    written = cut(dealt.mapInArrow(run, schema))
    most = written.agg(F.max("place")).first()[0]
    return written.withColumn("code", F.shiftleft(F.col("part").cast("long"), max(1, int(most or 0).bit_length())) + F.col("place"))


def unpacked(raw: bytes, size: int, dim: int) -> np.ndarray:
    """The vectors of a block as doubles."""
    kind = "<f4" if len(raw) == 4 * size * dim else "<f8"
    return np.frombuffer(raw, kind).astype(np.float64).reshape(size, dim)


def depth(made: DataFrame) -> int:
    """Levels above the blocks until one node is left."""
    return -(-int(made.agg(F.max("code")).first()[0] or 0).bit_length() // FAN_BITS)


def nodes(made: DataFrame, level: int, prefix: str, *more: Column) -> DataFrame:
    """Nodes of one level: dim, code, boxes, the largest remaining norm and the aggregates ``more``; all names get the prefix."""
    grouped = made.groupBy("dim", F.shiftright("code", FAN_BITS * level).alias("code")).agg(
        F.array(*[F.min(F.col("lo")[j]) for j in range(AXES)]).alias("lo"), F.array(*[F.max(F.col("hi")[j]) for j in range(AXES)]).alias("hi"), F.max("res").alias("res"), *more
    )
    return grouped.select([F.col(c).alias(f"{prefix}{c}") for c in grouped.columns])


def descend(a: DataFrame, b: DataFrame, meets: Column, a_more: tuple[Column, ...] = (), b_more: tuple[Column, ...] = ()) -> DataFrame:
    """(dim, a, b): pairs of a block of ``a`` and one of ``b`` whose boxes, and those of all nodes above them, satisfy ``meets``.

    ``meets`` is over the columns of ``nodes`` with the prefixes a_ and b_. It starts at the pair of the two roots. A pair opens to at most 1,024 pairs of the level
    below, so no join is larger than 1,024 times the pairs that are left, and each level is written before the next.
    """
    pairs = a.select("dim").distinct().withColumns({"a": F.lit(0).cast("long"), "b": F.lit(0).cast("long")})
    for level in range(max(1, depth(a), depth(b)) - 1, -1, -1):
        left = nodes(a, level, "a_", *a_more).withColumn("a_up", F.shiftright("a_code", FAN_BITS))
        right = nodes(b, level, "b_", *b_more).withColumn("b_up", F.shiftright("b_code", FAN_BITS))
        met = pairs.join(left, (pairs.dim == left.a_dim) & (pairs.a == left.a_up)).join(right, (F.col("dim") == right.b_dim) & (F.col("b") == right.b_up))
        pairs = cut(met.where(meets).select("dim", F.col("a_code").alias("a"), F.col("b_code").alias("b")))
    return pairs


def box_distance() -> Column:
    """The least squared distance of two nodes' rows by their boxes on the axes."""
    gap = F.zip_with(F.arrays_zip("a_lo", "a_hi"), F.arrays_zip("b_lo", "b_hi"), lambda x, y: F.greatest(x["a_lo"] - y["b_hi"], y["b_lo"] - x["a_hi"], F.lit(0.0)))
    return F.aggregate(gap, F.lit(0.0), lambda total, x: total + x * x)


def product_bounds() -> tuple[Column, Column]:
    """The least and the largest inner product of two nodes' rows, by their boxes and the norms beyond the axes; a margin covers rounding."""

    def ends(x: Column, y: Column) -> list[Column]:
        return [x["a_lo"] * y["b_lo"], x["a_lo"] * y["b_hi"], x["a_hi"] * y["b_lo"], x["a_hi"] * y["b_hi"]]

    left, right = F.arrays_zip("a_lo", "a_hi"), F.arrays_zip("b_lo", "b_hi")
    low = F.aggregate(F.zip_with(left, right, lambda x, y: F.least(*ends(x, y))), F.lit(0.0), lambda total, x: total + x)
    high = F.aggregate(F.zip_with(left, right, lambda x, y: F.greatest(*ends(x, y))), F.lit(0.0), lambda total, x: total + x)
    size = F.aggregate(F.zip_with(left, right, lambda x, y: F.greatest(*[F.abs(e) for e in ends(x, y)])), F.lit(0.0), lambda total, x: total + x)
    rest = F.col("a_res") * F.col("b_res")
    slack = (size + rest) * 1e-9 + 1e-6
    # beyond doubles a bound is no number, and then says nothing
    return F.nanvl(low - rest - slack, F.lit(float("-inf"))), F.nanvl(high + rest + slack, F.lit(float("inf")))
