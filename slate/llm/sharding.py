"""Sharding by vector bin packing: bytes, tokens and rows are balanced together.

Groups are rows with equal texts. A group stays together as long as it has at most the share ``whole`` of a shard in each of the three
measures; only a heavier one, which would unbalance its shard, is split: its rows are dealt in turn to pieces of at most that share, so a text that
a third of all rows hold is spread. Groups heavier than ``1 / fine`` of a shard are packed one by one, all lighter ones
as ``bundles`` units by their text's hash. This rule is the same at every size, and what is packed is bounded by it: at most
3 * shards * fine groups, as many pieces at most, and ``bundles`` units. Only their sums go to the driver. With few groups nearly every one has a
bundle of its own; with very many a bundle is a small sample of them, and its groups go the same way.

Units are placed largest first. Each goes to the shard where the dot product of its vector with the shard's residual
capacity is highest, all measures as shares of a shard. Then the fullest and the emptiest shard trade single units as long as
that brings their bytes closer and leaves the tokens and rows of both between the least and the most that the placing gave to any shard. So trades
make no measure's spread wider. The law that holds is ``bytes``: shard sizes are near equal.

Slots number the rows of a shard from 0 in ascending id order without gaps. They come from a range-partitioned sort
and one count per (partition, shard), never from one task per shard.

Cases: a null text has 16 bytes of size and no tokens, and all null texts form a group; repeated rows and ids are
separate rows with slots of their own; null ids come first in a shard; an empty table gives an empty table. Only the
id and text columns are read.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from slate.llm.batches import partitions
from slate.session import cut

SHARDS = 40
BUNDLES = 16_384
FINE = 64
WHOLE = 0.5
TRADES = 400
#: Pairs of units that are looked at in one array.
BLOCK = 1_000_000
OVERHEAD = 16
MEASURES = ("size", "tokens", "one")
_LOW = (1 << 33) - 1


def place(vectors: np.ndarray, shards: int) -> np.ndarray:
    """The shard of every unit. ``vectors``: units by measures, in any unit of measure."""
    shares = vectors / np.maximum(vectors.sum(axis=0) / shards, 1e-12)
    residual = np.ones((shards, vectors.shape[1]))
    out = np.zeros(len(vectors), np.int64)
    for unit in np.argsort(-shares.max(axis=1), kind="stable"):
        shard = int(np.argmax(residual @ shares[unit]))
        residual[shard] -= shares[unit]
        out[unit] = shard
    return out


def even(vectors: np.ndarray, placed: np.ndarray, shards: int, trades: int = TRADES) -> np.ndarray:
    """Trades between the fullest and the emptiest shard by the first measure, which widen the spread of no other.

    A trade gives one unit and takes one or none back. It ends when no such trade narrows the gap.
    """
    out = placed.copy()
    load = np.stack([np.bincount(out, v, shards) for v in vectors.T], axis=1)
    least, most = load.min(axis=0), load.max(axis=0)
    for _ in range(trades):
        full, empty = int(load[:, 0].argmax()), int(load[:, 0].argmin())
        gap = load[full, 0] - load[empty, 0]
        give, take = np.flatnonzero(out == full), np.flatnonzero(out == empty)
        back = np.concatenate((np.zeros((1, vectors.shape[1])), vectors[take]))  # first: nothing comes back
        best, i, j = gap, -1, -1
        step = max(1, BLOCK // len(back))
        for start in range(0, len(give), step):
            moved = vectors[give[start : start + step]][:, None, :] - back[None, :, :]
            after = np.abs(gap - 2 * moved[:, :, 0])
            for m in range(1, vectors.shape[1]):
                one, other = load[full, m] - moved[:, :, m], load[empty, m] + moved[:, :, m]
                after[(np.minimum(one, other) < least[m]) | (np.maximum(one, other) > most[m])] = np.inf
            k = int(after.argmin())
            if after.flat[k] < best:
                best, (i, j) = float(after.flat[k]), divmod(k, len(back))
                i += start
        if i < 0:
            break
        out[give[i]] = empty
        if j:
            out[take[j - 1]] = full
        load[full] -= vectors[give[i]] - back[j]
        load[empty] += vectors[give[i]] - back[j]
    return out


def pack(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shards: int = SHARDS, bundles: int = BUNDLES, fine: int = FINE, whole: float = WHOLE) -> DataFrame:
    """id, size, text_crc32, law, shard, slot, grown_shard and the group's hash for every row."""
    spark = docs.sparkSession
    text = F.coalesce(F.col(text_col), F.lit(""))
    slim = cut(
        docs.select(
            F.col(id_col).alias("s_id"),
            (F.coalesce(F.octet_length(F.col(text_col)), F.lit(0)) + OVERHEAD).cast("long").alias("size"),
            F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")).cast("long").alias("tokens"),
            F.lit(1).cast("long").alias("one"),
            F.crc32(text).alias("text_crc32"),
            F.xxhash64(F.col(text_col)).alias("s_group"),
            F.monotonically_increasing_id().alias("s_row"),
        )
    )
    totals = slim.agg(*[F.coalesce(F.sum(m), F.lit(0)).alias(m) for m in MEASURES]).first()
    heaviest = F.greatest(*[F.col(m) * (shards / max(totals[m], 1)) for m in MEASURES])
    groups = slim.groupBy("s_group").agg(*[F.sum(m).alias(m) for m in MEASURES])
    # few: each of them holds 1 / fine of a shard in some measure
    heavy = groups.where(heaviest * fine > 1).select("s_group", F.ceil(heaviest / whole).cast("long").alias("s_pieces"))
    unit = slim.join(F.broadcast(heavy), "s_group", "left").select(
        *slim.columns,
        F.when(F.col("s_pieces").isNull(), F.pmod("s_group", F.lit(bundles))).otherwise(F.col("s_group")).alias("s_unit"),
        F.when(F.col("s_pieces").isNull(), F.lit(-1)).otherwise(F.pmod(F.col("s_row").bitwiseAND(F.lit(_LOW)), F.col("s_pieces"))).cast("long").alias("s_piece"),
    )
    sums = unit.groupBy("s_unit", "s_piece").agg(*[F.sum(m).alias(m) for m in MEASURES]).orderBy("s_unit", "s_piece").collect()
    vectors = np.array([[r[m] for m in MEASURES] for r in sums], float).reshape(-1, len(MEASURES))
    chosen = even(vectors, place(vectors, shards), shards)
    plan = spark.createDataFrame([(r.s_unit, r.s_piece, int(shard)) for r, shard in zip(sums, chosen, strict=True)], "s_unit long, s_piece long, shard int")
    placed = unit.join(F.broadcast(plan), ["s_unit", "s_piece"]).select("s_id", "size", "text_crc32", "s_group", "shard", "s_row")
    return numbered(placed).select(
        F.col("s_id").alias(id_col),
        "size",
        "text_crc32",
        F.lit("bytes").alias("law"),
        "shard",
        "slot",
        F.lit(None).cast("int").alias("grown_shard"),
        F.col("s_group").alias("text_group"),
    )


def numbered(placed: DataFrame) -> DataFrame:
    """Adds ``slot``: the place of a row in its shard, by ascending id."""
    spark = placed.sparkSession
    ordered = placed.repartitionByRange(partitions(placed), "shard", "s_id", "s_row").sortWithinPartitions("shard", "s_id", "s_row")
    ordered = cut(ordered.withColumn("s_at", F.monotonically_increasing_id()))
    runs = ordered.groupBy(F.shiftright("s_at", 33).alias("s_part"), "shard").agg(F.count("*").alias("n"), F.min("s_at").alias("first")).collect()
    base, before = [], {}
    for run in sorted(runs, key=lambda r: (r.s_part, r.shard)):
        base.append((run.s_part, run.shard, before.get(run.shard, 0) - run["first"]))
        before[run.shard] = before.get(run.shard, 0) + run.n
    offsets = spark.createDataFrame(base, "s_part long, shard int, s_base long")
    keyed = ordered.withColumn("s_part", F.shiftright("s_at", 33))
    return keyed.join(F.broadcast(offsets), ["s_part", "shard"]).withColumn("slot", F.col("s_at") + F.col("s_base"))


def query(documents: DataFrame) -> DataFrame:
    """op2: every document's shard and slot."""
    return pack(documents)
