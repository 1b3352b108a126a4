"""Hard negatives for anchors by a dual-tree search over integer inner products.

Components become floor(256 * x). All rows are sorted by label and by grid cells on the leading principal axes and cut into
blocks, the leaves of the candidate tree. The anchors of eight blocks of one length are a leaf of the anchor tree, which has the same order. A
pair of nodes has an interval that holds every inner product of an anchor and a candidate below it; the search goes down both trees at
once and drops a pair, with all anchors below it, as soon as its interval cannot matter:

* positives: every anchor is first scored within its own block, which gives a floor below which no row of the same label can be among its
  first ones; pairs whose interval ends below the least floor of their anchors go.
* negatives: scores are wanted between a low and a high share of the positives' scores; pairs whose interval lies outside go, as do
  pairs that have no two labels.

The leaf pairs that are left are scored exactly. A task holds eight candidate blocks and sees the leaves of anchors one after the
other; it returns the first ones of each anchor, so tasks and their output are bounded however many candidates there are. The
first ones of all tasks are merged by a window over each anchor, whose limit is applied before the shuffle.

Cases: rows with a null label, a null vector, or any null or non-finite component take no part; vectors of different lengths are
never compared; an empty vector has the product zero with its like; repeated rows are rows of their own (an anchor leaves out
itself, not its copies); a null id is no anchor, and comes last among equal scores; scores beyond a long are clipped to it; anchors
without positives and positives without negatives give no rows; an empty table gives an empty table; other columns are not read, whatever their
names are. Ids are integers, labels too.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from slate.llm import vectors as V
from slate.llm.batches import partitions
from slate.session import cut

SCALE = 256
POSITIVES, NEGATIVES = 5, 3
#: A negative's score is between these percentages of the positive's.
LOW, HIGH = 50, 95
ANCHOR_EVERY = 50
PLACE_BITS = 16
CHUNK_BITS = 9
LAST_ID = np.iinfo(np.int64).max


def whole(x: np.ndarray) -> np.ndarray:
    """Components as whole numbers, in doubles; what is beyond them is their largest."""
    with np.errstate(over="ignore"):
        return np.nan_to_num(np.floor(SCALE * x))


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Inner products of rows of whole numbers, exact: in doubles where they are exact there, else in integers of any size, clipped to a long."""
    bound = np.abs(a).max(initial=0) * np.abs(b).max(initial=0) * max(1, a.shape[1])
    if bound < 2.0**53:
        return (a @ b.T).astype(np.int64)
    exact = np.array([[int(v) for v in row] for row in a], object).reshape(a.shape) @ np.array([[int(v) for v in row] for row in b], object).reshape(b.shape).T
    return np.array([[min(max(int(v), -(2**63)), 2**63 - 1) for v in row] for row in exact], np.int64).reshape(exact.shape)


def _floors(positives: int):  # noqa: ANN202
    """For a block: its anchors, and under each the score of the last wanted positive inside the block (the least long where it has fewer)."""

    def run(x: np.ndarray, marks: list) -> list[pa.Array]:
        anchors = np.flatnonzero(np.array(marks))
        floors = np.full(len(anchors), -(2**63), np.int64)
        if len(anchors) and len(x) > positives:
            scores = products(x[anchors], x)
            scores[np.arange(len(anchors)), anchors] = -(2**63)
            floors = np.sort(scores, axis=1)[:, -positives]
        return [pa.array([v.tolist()], pa.list_(pa.int64())) for v in (anchors, floors)]

    return run


ANCHORS = "dim int, code long, grp long, size int, vecs binary, lo array<double>, hi array<double>, res double, ids array<long>, places array<long>, floors array<long>"


def _anchors(made: DataFrame) -> DataFrame:
    """Leaves of the anchor tree, written: the anchors of each block, with boxes of their own."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for row in batch.to_pylist():
                at = np.array(row["anchors"], np.int64)
                raw = np.frombuffer(row["vecs"], np.uint8).reshape(row["size"], -1)[at]
                out.append({k: row[k] for k in ("dim", "code", "grp", "lo", "hi", "res", "floors")} | {"size": len(at), "vecs": raw.tobytes(), "ids": [row["id"][i] for i in at.tolist()], "places": at.tolist()})
            yield pa.RecordBatch.from_pylist(out, schema=batches_schema)

    number, many = pa.int64(), pa.list_(pa.int64())
    kinds = {"dim": pa.int32(), "code": number, "grp": number, "size": pa.int32(), "vecs": pa.binary(), "lo": pa.list_(pa.float64()), "hi": pa.list_(pa.float64()), "res": pa.float64(), "ids": many, "places": many, "floors": many}
    batches_schema = pa.schema(list(kinds.items()))
    sent = made.where(F.size("anchors") > 0).select("dim", "code", "grp", "size", "vecs", "lo", "hi", "res", "id", "anchors", "floors")
    return cut(sent.mapInArrow(run, ANCHORS))


def _tasks(pairs: DataFrame, made: DataFrame, anchors: DataFrame) -> DataFrame:
    """Rows of tasks: for each interval of eight candidate blocks, one length of vectors and 512 anchor leaves the blocks first (role 0), then the leaves (role 1), each with the mask of its blocks."""
    bit = F.call_function("shiftleft", F.lit(1), F.col("b").bitwiseAND(F.lit((1 << V.TILE_BITS) - 1)).cast("int"))
    asked = cut(pairs.groupBy("dim", F.shiftright("b", V.TILE_BITS).alias("tile"), F.shiftright("a", CHUNK_BITS).alias("chunk"), F.col("a").alias("code")).agg(F.bit_or(bit).alias("mask")))
    blocks = asked.select("dim", "tile", "chunk").distinct().join(made.withColumn("tile", F.shiftright("code", V.TILE_BITS)), ["dim", "tile"])
    nothing = F.array().cast("array<long>")
    held = blocks.select("tile", "chunk", F.lit(0).alias("role"), "code", F.lit(0).alias("mask"), "dim", "grp", "size", "vecs", F.col("id").alias("ids"), nothing.alias("places"), nothing.alias("bounds"), nothing.alias("ranks"))
    passing = asked.join(anchors, ["dim", "code"]).select("tile", "chunk", F.lit(1).alias("role"), "code", "mask", "dim", "grp", "size", "vecs", "ids", "places", "bounds", "ranks")
    return held.unionByName(passing).repartition(partitions(made), "dim", "tile", "chunk").sortWithinPartitions("dim", "tile", "chunk", "role", "code")


class _Tile:
    """Eight candidate blocks, their rows by id (null ids last)."""

    def __init__(self, rows: list[dict]) -> None:
        ids = np.concatenate([[LAST_ID if i is None else i for i in row["ids"]] for row in rows]).astype(np.int64)
        null = np.concatenate([[i is None for i in row["ids"]] for row in rows]).astype(bool)
        node = np.concatenate([(row["code"] << PLACE_BITS) + np.arange(row["size"]) for row in rows])
        order = np.lexsort((node, ids, null))
        self.ids, self.null, self.node = ids[order], null[order], node[order]
        self.group = np.repeat([row["grp"] for row in rows], [row["size"] for row in rows])[order]
        self.block = np.repeat([row["code"] & ((1 << V.TILE_BITS) - 1) for row in rows], [row["size"] for row in rows])[order]
        self.x = whole(np.concatenate([V.unpacked(row["vecs"], row["size"], row["dim"]) for row in rows]))[order]


FOUND = "node long, rank long, score long, other_id long, other long"


def _scored(found):  # noqa: ANN001, ANN202
    """Runs ``found(leaf, tile, columns, scores)`` on every leaf of anchors; it yields (place of the anchor, rank, columns, scores) of what is first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, rows, tile = None, [], None
        for batch in batches:
            for task in batch.to_pylist():
                key = task["dim"], task["tile"], task["chunk"]
                if key != now:
                    now, rows, tile = key, [], None
                if task["role"] == 0:
                    rows.append(task)
                    continue
                if tile is None:
                    tile, rows = _Tile(rows), []
                columns = np.flatnonzero((task["mask"] >> tile.block & 1).astype(bool) & found.of(task, tile))
                scores = products(whole(V.unpacked(task["vecs"], task["size"], task["dim"])), tile.x[columns])
                made: list[list] = [[], [], [], [], []]
                for place, rank, at, values in found(task, tile, columns, scores):
                    own = columns[at]
                    made[0] += [(task["code"] << PLACE_BITS) + place] * len(own)
                    made[1] += [rank] * len(own)
                    made[2] += values.tolist()
                    made[3] += [None if null else i for i, null in zip(tile.ids[own].tolist(), tile.null[own].tolist(), strict=True)]
                    made[4] += tile.node[own].tolist()
                yield pa.RecordBatch.from_arrays([pa.array(v, pa.int64()) for v in made], names=["node", "rank", "score", "other_id", "other"])

    return run


class _Positives:
    def __init__(self, count: int) -> None:
        self.count = count

    def of(self, task: dict, tile: _Tile) -> np.ndarray:
        return tile.group == task["grp"]

    def __call__(self, task: dict, tile: _Tile, columns: np.ndarray, scores: np.ndarray) -> Iterator[tuple]:
        nodes = tile.node[columns]
        for row, (place, floor) in enumerate(zip(task["places"], task["bounds"], strict=True)):
            at = np.flatnonzero((scores[row] >= floor) & (nodes != (task["code"] << PLACE_BITS) + place))
            at = at[np.argsort(~scores[row][at], kind="stable")[: self.count]]
            yield place, 0, at, scores[row][at]


class _Negatives:
    """``bounds`` has the positives' scores here, ``places`` and ``ranks`` say whose they are."""

    def __init__(self, count: int, low: int, high: int) -> None:
        self.count, self.low, self.high = count, low, high

    def of(self, task: dict, tile: _Tile) -> np.ndarray:
        return tile.group != task["grp"]

    def __call__(self, task: dict, tile: _Tile, columns: np.ndarray, scores: np.ndarray) -> Iterator[tuple]:
        wanted: dict[int, list[tuple[int, int, int]]] = {}
        for place, row, rank, score in zip(task["places"], task["ranks"][::2], task["ranks"][1::2], task["bounds"], strict=True):
            ends = -((-self.low * score) // 100), (self.high * score) // 100
            if ends[0] <= ends[1]:
                wanted.setdefault((place, row), []).append((rank, *ends))
        for (place, row), windows in wanted.items():
            own = scores[row]
            at = np.flatnonzero((own >= min(w[1] for w in windows)) & (own <= max(w[2] for w in windows)))
            at = at[np.argsort(~own[at], kind="stable")]
            falling = own[at]
            for rank, low, high in windows:
                start = np.count_nonzero(falling > high)
                some = at[start : start + self.count]
                some = some[own[some] >= low]
                yield place, rank, some, own[some]


def mine(df: DataFrame, anchor: Column, id_col: str = "vec_id", label_col: str = "label", vec_col: str = "embedding", positives: int = POSITIVES, negatives: int = NEGATIVES, low: int = LOW, high: int = HIGH) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score and negative_score: for each anchor (rows where ``anchor`` is true) and each of its first
    ``positives`` rows of the same label, the first ``negatives`` rows of other labels whose score is ``low`` to ``high`` percent of the positive's."""
    usable = df.where(V.finite(F.col(f"`{vec_col}`")) & F.col(f"`{label_col}`").isNotNull())
    rows = usable.select(
        F.coalesce(anchor & F.col(f"`{id_col}`").isNotNull(), F.lit(False)).cast("long").alias("anchor"),
        F.col(f"`{id_col}`").cast("long").alias("id"),
        F.col(f"`{label_col}`").cast("long").alias("grp"),
        V.narrow(df, vec_col).alias("vec"),
    )
    made = V.blocks(rows, whole, ("anchor", "id"), extra="anchors array<long>, floors array<long>", more=_floors(positives))
    keen = _anchors(made)
    labels = F.min("grp").alias("g0"), F.max("grp").alias("g1")
    least, most = V.product_bounds()

    near = (F.col("a_g0") <= F.col("b_g1")) & (F.col("b_g0") <= F.col("a_g1")) & (most >= F.col("a_floor"))
    pairs = V.descend(keen, made, near, (*labels, F.min(F.array_min("floors").cast("double")).alias("floor")), labels)
    ready = keen.withColumns({"bounds": F.col("floors"), "ranks": F.array().cast("array<long>")})
    found = _tasks(pairs, made, ready).mapInArrow(_scored(_Positives(positives)), FOUND)
    first = Window.partitionBy("node").orderBy(F.desc("score"), F.asc_nulls_last("other_id"), "other")
    own = cut(found.withColumn("rank", F.row_number().over(first).cast("long")).where(F.col("rank") <= positives))

    leaf, place = F.shiftright("node", PLACE_BITS), F.col("node").bitwiseAND(F.lit((1 << PLACE_BITS) - 1))
    lists = own.groupBy(leaf.alias("l_code")).agg(F.collect_list(F.struct(place.alias("place"), "rank", "score")).alias("l"), (F.min("score") * (low / 100)).alias("w0"), (F.max("score") * (high / 100)).alias("w1"))
    row = F.transform("l", lambda x: F.struct((F.array_position("places", x["place"]) - 1).alias("row"), x["rank"].alias("rank")))
    pairs_of = F.flatten(F.transform(row, lambda x: F.array(x["row"], x["rank"])))
    asking = cut(
        keen.join(lists, F.col("code") == F.col("l_code")).withColumn("ranks", pairs_of).withColumn("places", F.col("l.place")).withColumn("bounds", F.col("l.score")).drop("l", "l_code", "floors")
    )
    # a share of a negative score is nothing, so windows with a low end above zero are all there are
    apart = (F.col("a_g0") != F.col("a_g1")) | (F.col("b_g0") != F.col("b_g1")) | (F.col("a_g0") != F.col("b_g0"))
    inside = apart & (most >= F.col("a_w0")) & (least <= F.col("a_w1"))
    pairs = V.descend(asking, made, inside, (*labels, F.min("w0").alias("w0"), F.max("w1").alias("w1")), labels)
    found = _tasks(pairs, made, asking).mapInArrow(_scored(_Negatives(negatives, low, high)), FOUND)
    best = Window.partitionBy("node", "rank").orderBy(F.desc("score"), F.asc_nulls_last("other_id"), "other")
    hard = found.withColumn("place", F.row_number().over(best)).where(F.col("place") <= negatives).select("node", "rank", "place", F.col("other_id").alias("negative_id"), F.col("score").alias("negative_score"))
    names = keen.select(F.explode(F.arrays_zip("ids", F.transform("places", lambda p: F.shiftleft("code", PLACE_BITS) + p).alias("nodes"))).alias("x")).select(F.col("x.nodes").alias("node"), F.col("x.ids").alias("anchor_id"))
    scored = own.join(names, "node").select("node", "rank", "anchor_id", F.col("other_id").alias("positive_id"), F.col("score").alias("positive_score"))
    return scored.join(hard, ["node", "rank"]).select("anchor_id", "positive_id", F.col("place").cast("int").alias("rank"), "negative_id", "positive_score", "negative_score")


def query(embeddings: DataFrame) -> DataFrame:
    """op11: hard negatives of every fiftieth vector; every seventh label is moved on by one first."""
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return mine(embeddings.select("vec_id", label.alias("label"), "embedding"), F.col("vec_id") % ANCHOR_EVERY == 0)


SQL = """
WITH usable AS (
  SELECT row_number() OVER () AS place, vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS q
  FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scored AS (
  SELECT a.place, a.vec_id AS anchor_id, b.place AS other, b.vec_id AS other_id, a.label = b.label AS alike, CAST(list_inner_product(a.q, b.q) AS BIGINT) AS score
  FROM usable a JOIN usable b ON len(a.q) = len(b.q) AND a.place <> b.place
  WHERE a.vec_id % 50 = 0),
positive AS (
  SELECT * FROM scored WHERE alike
  QUALIFY row_number() OVER (PARTITION BY place ORDER BY score DESC, other_id NULLS LAST, other) <= 5),
negative AS (
  SELECT p.anchor_id, p.other_id AS positive_id, row_number() OVER (PARTITION BY p.place, p.other ORDER BY n.score DESC, n.other_id NULLS LAST, n.other) AS rank,
         n.other_id AS negative_id, p.score AS positive_score, n.score AS negative_score
  FROM positive p JOIN scored n ON n.place = p.place AND NOT n.alike AND 50 * p.score <= 100 * n.score AND 100 * n.score <= 95 * p.score)
SELECT anchor_id, positive_id, CAST(rank AS INTEGER) AS rank, negative_id, positive_score, negative_score FROM negative WHERE rank <= 3
"""
