"""SimHash near-duplicates by deletion-variant signatures.

A text's fingerprint has 64 bits: a bit is 1 if it is set in over half of the XXH64 hashes (seed 42) of the text's
three-word shingles, repeats included. Texts link if their fingerprints differ in three bits or fewer, and groups are
the connected components of the links.

Finding links: a fingerprint is cut into two segments of 32 bits, so at least one of them differs by one bit at most
if two fingerprints link. For each segment and each of its bits, the segment with that bit taken out (a wildcard) is an index
key; equal keys are the candidates, and every candidate is verified on all 64 bits.

Only distinct fingerprints are indexed, so exact copies cost nothing here. A crowded bucket (rows with one key) is parted
by the bytes of its other segment: two linked fingerprints differ in three bits at most, so one of its four bytes is
equal, and four rows a fingerprint are enough. A part that is still larger than ``block`` is cut into blocks, and every two blocks
of it meet in one group, so no task holds more than two blocks, however full a bucket is, and none of its pairs is missed. Inside a group the verified links are found by search from
fingerprint to fingerprint, and those of a spanning forest are emitted, never all pairs: groups give at most one link
per member. Small groups emit a link only from the first key that both sides share.

Cases: words are runs of non-white-space (ASCII white space) after ASCII capitals are lowered; one or two words make
one shingle; a null or empty text has the fingerprint zero and links like any other; repeated rows and ids are all
returned, with one component; a null id is returned too but names a component only if no other id does; an empty table gives
an empty table. Texts are never cut. Only the id and text columns are read by ``near_duplicates``; ``deduplicated`` carries
all columns whatever their names are.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from slate.llm.batches import sliced
from slate.llm.graph import components
from slate.session import cut

SHINGLE = 3
DISTANCE = 3
SEED = 42
SEGMENTS, SEGMENT_BITS = 2, 32
BLOCK = 4096
PIECE = 1 << 16


def fingerprint(text: str | None) -> int:
    """The fingerprint of one text, unsigned."""
    own = (text or "").encode().lower().split()
    if not own:
        return 0
    n = max(1, len(own) - SHINGLE + 1)
    joined = b" ".join(own)
    lengths = np.fromiter(map(len, own), np.int64, len(own))
    ends = np.cumsum(lengths + 1) - 1
    starts = (ends - lengths)[:n].tolist()
    stops = ends[SHINGLE - 1 :].tolist() if len(own) >= SHINGLE else [len(joined)]
    digest = xxhash.xxh64_intdigest
    ones = np.zeros(64, np.int64)
    for at in range(0, n, PIECE):
        hashes = np.fromiter((digest(joined[a:b], SEED) for a, b in zip(starts[at : at + PIECE], stops[at : at + PIECE], strict=True)), ">u8")
        ones += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > n).tobytes(), "big")


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(f_id, fp) for every row; fp is the fingerprint as a signed long."""
    rows = docs.select(F.col(id_col).alias("f_id"), F.col(text_col).alias("fp"))
    schema = docs.select(F.col(id_col).alias("f_id"), F.lit(0).cast("long").alias("fp")).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, 1):
            own = np.array([fingerprint(text) for text in batch.column(1).to_pylist()], np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(own.view(np.int64))], names=["f_id", "fp"])

    return rows.mapInArrow(run, schema)


def _segment(fp: Column, segment: int) -> Column:
    return F.shiftrightunsigned(fp, 32) if segment == 0 else fp.bitwiseAND(F.lit(0xFFFFFFFF))


def _keys(fp: Column) -> Column:
    """The 64 index keys: segment number (1 bit), wildcard (5 bits), the segment without that bit (32 bits)."""
    made = []
    for segment in range(SEGMENTS):
        own = _segment(fp, segment)
        for bit in range(SEGMENT_BITS):
            made.append(own.bitwiseAND(F.lit(0xFFFFFFFF ^ (1 << bit))) + F.lit(((segment << 5) | bit) << 32))
    return F.array(*made)


def _crowded(nodes: DataFrame, block: int) -> DataFrame:
    """(c_key, c_n) of keys whose bucket may pass a block, with a bound of its size.

    A bucket holds the rows of two segment values, so one of them has over half a block; those are counted first.
    There are at most 4 * rows / block of them.
    """
    segments = nodes.select(F.explode(F.array(*[F.struct(F.lit(s).alias("s"), _segment(F.col("fp"), s).alias("v")) for s in range(SEGMENTS)])).alias("x"))
    full = segments.groupBy("x.s", "x.v").agg(F.count("*").alias("n")).where(F.col("n") > block // 2)
    keys = F.transform(
        F.sequence(F.lit(0), F.lit(SEGMENT_BITS - 1)),
        lambda bit: F.col("v").bitwiseAND(F.bitwise_not(F.call_function("shiftleft", F.lit(1).cast("long"), bit)))
        + F.call_function("shiftleft", (F.col("s") * SEGMENT_BITS + bit).cast("long"), F.lit(32)),
    )
    return full.select(F.explode(keys).alias("c_key"), (F.col("n") + block // 2).alias("m")).groupBy("c_key").agg(F.sum("m").alias("c_n"))


def _parts(key: Column, fp: Column) -> Column:
    """The four bytes of the segment that the key leaves out, each with its place: 0 to 1023. Linked fingerprints differ in three bits, so one byte is equal."""
    other = F.when(F.shiftright(key, 37) == 0, _segment(fp, 1)).otherwise(_segment(fp, 0))
    return F.array(*[F.shiftright(other, 8 * i).bitwiseAND(F.lit(0xFF)) + F.lit(256 * i) for i in range(4)])


def _count(x: np.ndarray) -> np.ndarray:
    return np.bitwise_count(x)


def _first_key(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Segment and wildcard of the first key that two linked fingerprints share."""
    out = np.zeros(len(a), np.int64)
    x = a ^ b
    high, low = x >> np.uint64(32), x & np.uint64(0xFFFFFFFF)
    use_low = _count(high) > 1
    part = np.where(use_low, low, high)
    bit = np.where(part == 0, 0, _count((part - np.uint64(1)) & ~part))
    out[:] = np.where(use_low, 32, 0) + bit
    return out


SMALL = 32


def _links(keys: np.ndarray, sub: np.ndarray, fps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links inside groups of equal (key, sub); the arrays are sorted by both."""
    new = np.concatenate(([True], (keys[1:] != keys[:-1]) | (sub[1:] != sub[:-1])))
    starts = np.flatnonzero(new)
    sizes = np.diff(np.concatenate((starts, [len(keys)])))
    left, right = [], []
    small = np.repeat(sizes <= SMALL, sizes)
    group = np.cumsum(new) - 1
    for step in range(1, int(min(SMALL, sizes.max(initial=0)))):
        same = np.flatnonzero((group[step:] == group[:-step]) & small[step:])
        if not len(same):
            break
        a, b = fps[same], fps[same + step]
        close = _count(a ^ b) <= DISTANCE
        a, b, which = a[close], b[close], keys[same[close]] >> 32
        first = _first_key(a, b) == which
        left.append(a[first])
        right.append(b[first])
    for at, size in zip(starts[sizes > SMALL].tolist(), sizes[sizes > SMALL].tolist(), strict=True):
        a, b = _forest(fps[at : at + size])
        left.append(a)
        right.append(b)
    none = np.zeros(0, np.uint64)
    return np.concatenate([none, *left]), np.concatenate([none, *right])


def _forest(fps: np.ndarray, at_once: int = 256) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest of the links in one group, by breadth-first search."""
    rest = np.unique(fps)
    left, right = [], []
    while len(rest):
        front, rest = rest[:1], rest[1:]
        while len(front) and len(rest):
            close = _count(front[:at_once, None] ^ rest[None, :]) <= DISTANCE
            hit = close.any(axis=0)
            found = rest[hit]
            left.append(front[:at_once][close[:, hit].argmax(axis=0)])
            right.append(found)
            front, rest = np.concatenate((front[at_once:], found)), rest[~hit]
    none = np.zeros(0, np.uint64)
    return np.concatenate([none, *left]), np.concatenate([none, *right])


def links(nodes: DataFrame, block: int = BLOCK) -> DataFrame:
    """(a, b): links between distinct fingerprints, whose components are those of all links. ``nodes`` has distinct fp."""
    parts = int(nodes.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    keyed = nodes.select("fp", F.explode(_keys(F.col("fp"))).alias("key"))
    # written first: where it is small, as nearly always, the joins below need no shuffle
    crowded = cut(_crowded(nodes, block))
    full = keyed.join(crowded, F.col("key") == F.col("c_key"))
    parted = full.select("key", F.explode(_parts(F.col("key"), F.col("fp"))).alias("part"), "fp")
    packed = cut(parted.groupBy(F.col("key").alias("p_key"), F.col("part").alias("p_part")).agg(F.count("*").alias("p_n")).where(F.col("p_n") > block))
    placed = parted.join(packed, (F.col("key") == F.col("p_key")) & (F.col("part") == F.col("p_part")), "left")
    blocks = F.coalesce(F.ceil(F.col("p_n") / block), F.lit(1)).cast("long")
    own = F.pmod(F.xxhash64("fp"), F.col("c_blocks"))
    pairs = F.transform(F.sequence(F.lit(0).cast("long"), F.col("c_blocks") - 1), lambda other: F.least(own, other) * F.col("c_blocks") + F.greatest(own, other))
    met = placed.withColumn("c_blocks", blocks).select("key", "part", F.explode(pairs).alias("pair"), "fp").select("key", (F.col("pair") * 1024 + F.col("part")).alias("sub"), "fp")
    plain = keyed.join(crowded, F.col("key") == F.col("c_key"), "left_anti").select("key", F.lit(0).cast("long").alias("sub"), "fp")
    grouped = plain.unionByName(met).repartition(parts, "key", "sub").sortWithinPartitions("key", "sub")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64)]
        for batch in batches:
            now = [batch.column(0).to_numpy(), batch.column(1).to_numpy(), batch.column(2).to_numpy().view(np.uint64)]
            held = [np.concatenate(x) for x in zip(held, now, strict=True)]
            if len(held[0]) < 200_000 and len(now[0]):
                continue
            last = np.flatnonzero((held[0] != held[0][-1]) | (held[1] != held[1][-1]))
            if not len(last):
                continue
            stop = int(last[-1]) + 1
            yield _batch(*_links(*[x[:stop] for x in held]))
            held = [x[stop:] for x in held]
        if len(held[0]):
            yield _batch(*_links(*held))

    return grouped.mapInArrow(run, "a long, b long").distinct()


def _batch(a: np.ndarray, b: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], names=["a", "b"])


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", block: int = BLOCK) -> DataFrame:
    """id, fp (signed) and component_id (the smallest id of the component) for every row."""
    prints = cut(fingerprints(docs, id_col, text_col))
    nodes = cut(prints.groupBy("fp").agg(F.min("f_id").alias("first")))
    roots = components(links(nodes.select("fp"), block))
    rooted = nodes.join(roots, nodes.fp == roots.node, "left").select("fp", "first", F.coalesce("root", "fp").alias("root"))
    least = rooted.groupBy("root").agg(F.min("first").alias("component_id"))
    named = rooted.join(least, "root").select("fp", "component_id")
    return prints.join(named, "fp").select(F.col("f_id").alias(id_col), "fp", "component_id")


def deduplicated(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The input's columns, one row of each component: that with the smallest (id, hash of the text), null ids first.

    Rows with equal ids and texts are one; of their other columns the row with the smallest hash stays.
    """
    key = F.struct(F.col(f"`{id_col}`").alias("id"), F.xxhash64(F.col(f"`{text_col}`")).alias("hash"))
    # one text column joins without a cast, so rows are shuffled once for both the grouping and the join
    plain = lambda k: F.concat_ws(":", k["hash"].cast("string"), k["id"].cast("string"))
    keyed = docs.select(key.alias("n_key"), F.col(f"`{text_col}`").alias("n_text"))
    groups = near_duplicates(keyed, "n_key", "n_text")
    kept = groups.where(F.col("n_key") == F.col("component_id")).select(plain(F.col("n_key")).alias("n_plain")).distinct()
    rows = docs.select(plain(key).alias("n_plain"), F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("n_row"))
    once = rows.groupBy("n_plain").agg(F.min_by("n_row", F.xxhash64("n_row")).alias("n_row"))
    return once.join(kept, "n_plain", "left_semi").select("n_row.*")


def query(documents: DataFrame) -> DataFrame:
    """op1: every document's fingerprint and near-duplicate group."""
    return near_duplicates(documents).select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
