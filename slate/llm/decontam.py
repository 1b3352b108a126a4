"""Benchmark decontamination: a broadcast hash set of the benchmark's word windows, scanned over every text.

Both sides are normalised alike: ASCII capitals are lowered, words are runs of ASCII letters and digits and of
characters beyond ASCII. A benchmark item gives all its windows of ten consecutive words; a shorter item that has
words gives one window. Each window is kept as numbers of a small vocabulary with a rolling hash. A text's words are
mapped to the same numbers (0 if no item has the word); only stretches without a 0 can hold a window, their hashes
are looked up in the set, and every hit is verified against the window's own words.

The set is bounded: items are streamed to the driver and cut into sets of at most ``max_windows`` windows and ``MAX_BYTES`` of words. A benchmark that is
one set is scanned in one pass without a write or a shuffle. For a larger one the texts are written once, and each set is broadcast, scanned in a job of its own
that writes the rows that it hits, and released before the next one is built; then the hits of a row are put together. So a larger benchmark takes
more passes, and no more memory in the driver or a worker.

Cases: a null or empty text has no words and is clean; an item with null text has no windows; windows of items with a
null id count as hits but name no item; equal windows of several items name all of them; repeated rows are scanned
one by one; an empty benchmark leaves everything clean, an empty table gives an empty table. Texts are never cut.
Columns besides the id and text are carried by ``clean`` whatever their names are.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import chain, repeat

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from slate.llm.batches import sliced
from slate.session import cut

WINDOW = 10
MAX_WINDOWS = 500_000
MAX_BYTES = 64 << 20
BASE = np.uint64(0x9E3779B97F4A7C15)

#: Bytes that belong to words stay (capitals lowered), all others become spaces.
_TABLE = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))
_WORD = re.compile(rb"[^ ]+")


def words(text: str | None) -> list[bytes]:
    return (text or "").encode().translate(_TABLE).split()


class WindowSet:
    """Windows of some items: vocabulary, hashes by window length, and the items of each window."""

    def __init__(self, items: list[tuple[str | None, list[bytes]]], window: int) -> None:
        self.vocabulary: dict[bytes, int] = {}
        self.items: dict[bytes, list[str]] = {}
        by_length: dict[int, set[bytes]] = {}
        for name, item in items:
            numbers = np.array([self.vocabulary.setdefault(w, len(self.vocabulary) + 1) for w in item], np.uint32)
            n = min(window, len(numbers))
            for i in range(len(numbers) - n + 1):
                key = numbers[i : i + n].tobytes()
                by_length.setdefault(n, set()).add(key)
                names = self.items.setdefault(key, [])
                if name is not None and name not in names:
                    names.append(name)
        self.hashes = {n: np.unique(_hashes(np.frombuffer(b"".join(sorted(keys)), np.uint32), np.arange(len(keys)) * n, n)) for n, keys in by_length.items()}

    def find(self, numbers: np.ndarray) -> Iterator[tuple[int, int, list[str]]]:
        """(place, length, items) of every window that occurs."""
        zeros = np.concatenate(([0], np.cumsum(numbers == 0)))
        for n, known in self.hashes.items():
            if len(numbers) < n:
                continue
            places = np.flatnonzero(zeros[n:] == zeros[:-n])
            if not len(places):
                continue
            found = _hashes(numbers, places, n)
            at = np.minimum(np.searchsorted(known, found), len(known) - 1)
            for place in places[known[at] == found].tolist():
                if (names := self.items.get(numbers[place : place + n].tobytes())) is not None:
                    yield place, n, names


def _hashes(numbers: np.ndarray, places: np.ndarray, n: int) -> np.ndarray:
    out = np.zeros(len(places), np.uint64)
    for k in range(n):
        out = out * BASE + numbers[places + k].astype(np.uint64)
    return out


def window_sets(benchmark: DataFrame, id_col: str, text_col: str, window: int, max_windows: int) -> Iterator[WindowSet]:
    items: list[tuple[str | None, list[bytes]]] = []
    held = size = 0
    for name, text in benchmark.select(F.col(id_col).cast("string"), F.col(text_col)).toLocalIterator():
        if not (own := words(text)):
            continue
        for part in _parts(own, window, max_windows):
            n = max(1, len(part) - window + 1)
            weight = sum(map(len, part))
            if items and (held + n > max_windows or size + weight > MAX_BYTES):
                yield WindowSet(items, window)
                items, held, size = [], 0, 0
            items.append((name, part))
            held, size = held + n, size + weight
    if items:
        yield WindowSet(items, window)


def _parts(own: list[bytes], window: int, max_windows: int) -> Iterator[list[bytes]]:
    """An item with more windows than a set may hold, in overlapping parts."""
    if len(own) <= window:
        yield own
        return
    for start in range(0, len(own) - window + 1, max_windows):
        yield own[start : start + max_windows + window - 1]


_SPANS = "array<struct<first:int,last:int>>"


def _found(index: WindowSet, texts: list[str | None]) -> tuple[list[int], list[list[tuple[int, int]]], list[list[str]]]:
    """Word count, merged hit spans and sorted items of every text."""
    split = [words(text) for text in texts]
    ends = np.cumsum([len(x) + 1 for x in split])
    starts = ends - [len(x) + 1 for x in split]
    numbers = np.zeros(int(ends[-1]) if len(ends) else 0, np.uint32)
    for start, own in zip(starts.tolist(), split, strict=True):
        numbers[start : start + len(own)] = np.fromiter(map(index.vocabulary.get, own, repeat(0)), np.uint32, len(own))
    spans: list[list[tuple[int, int]]] = [[] for _ in split]
    named: list[set[str]] = [set() for _ in split]
    for place, n, names in index.find(numbers):
        row = int(np.searchsorted(ends, place, "right"))
        first = place - int(starts[row])
        spans[row].append((first, first + n - 1))
        named[row].update(names)
    return [len(x) for x in split], [_merged(s) for s in spans], [sorted(x) for x in named]


def _arrow_spans(spans: list[list[tuple[int, int]]], kind: pa.DataType) -> pa.Array:
    return pa.array([[{"first": a, "last": b} for a, b in s] for s in spans], kind)


def _pass(rows: DataFrame, held: Broadcast, only_hits: bool = False) -> DataFrame:
    """d_row, d_text, d_words, d_spans and d_items of rows of (d_row, d_text), by one set; with ``only_hits`` of the rows that it hits, and without text."""
    schema = T.StructType([*rows.schema.fields, *T.StructType.fromDDL(f"d_words long, d_spans {_SPANS}, d_items array<string>").fields])
    kinds = {f.name: to_arrow_type(f.dataType) for f in schema.fields[2:]}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, 1):
            n_words, spans, items = _found(held.value, batch.column(1).to_pylist())
            kept = [i for i, s in enumerate(spans) if s or not only_hits]
            text = pa.nulls(len(kept), batch.column(1).type) if only_hits else batch.column(1)
            row = batch.column(0).take(pa.array(kept, pa.int64())) if only_hits else batch.column(0)
            yield pa.RecordBatch.from_arrays(
                [row, text, pa.array([n_words[i] for i in kept], pa.int64()), _arrow_spans([spans[i] for i in kept], kinds["d_spans"]), pa.array([items[i] for i in kept], kinds["d_items"])],
                names=schema.names,
            )

    return rows.mapInArrow(run, schema)


def _merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for first, last in sorted(spans):
        if out and first <= out[-1][1] + 1:
            out[-1] = (out[-1][0], max(last, out[-1][1]))
        else:
            out.append((first, last))
    return out


def _merge_hits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of (d_key, lists of spans by set, items), with one merged list of spans."""
    for batch in batches:
        spans = [_merged([(s["first"], s["last"]) for s in own]) for own in batch.column(1).to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column(0), _arrow_spans(spans, batch.schema.field(1).type), batch.column(2)], names=batch.schema.names)


def _scanned(docs: DataFrame, benchmark: DataFrame, row: Column, text_col: str, item_col: str, item_text: str, window: int, max_windows: int) -> DataFrame:
    """d_row, d_text, d_words, d_spans and d_items of all rows."""
    context = docs.sparkSession.sparkContext
    rows = docs.select(row.alias("d_row"), F.col(text_col).alias("d_text"))
    sets = window_sets(benchmark, item_col, item_text, window, max_windows)
    first, second = next(sets, None), next(sets, None)
    if second is None:
        return _pass(rows, context.broadcast(first or WindowSet([], window)))
    keyed = cut(rows.withColumn("d_key", F.monotonically_increasing_id()))
    hits = None
    for index in chain((first, second), sets):
        held = context.broadcast(index)
        first = second = index = None  # one set at a time
        own = cut(_pass(keyed.select("d_key", "d_text"), held, only_hits=True).select("d_key", "d_spans", "d_items"))
        held.unpersist()
        hits = own if hits is None else hits.unionByName(own)
    together = hits.groupBy("d_key").agg(F.flatten(F.collect_list("d_spans")).alias("d_spans"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("d_items")))).alias("d_items"))
    merged = together.mapInArrow(_merge_hits, together.schema)
    return keyed.join(merged, "d_key", "left").select(
        "d_row",
        "d_text",
        F.regexp_count(F.coalesce("d_text", F.lit("")), F.lit(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")).cast("long").alias("d_words"),
        F.coalesce("d_spans", F.array().cast(_SPANS)).alias("d_spans"),
        F.coalesce("d_items", F.array().cast("array<string>")).alias("d_items"),
    )


def scan(
    docs: DataFrame,
    benchmark: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_col: str = "item_id",
    item_text: str = "text",
    window: int = WINDOW,
    max_windows: int = MAX_WINDOWS,
) -> DataFrame:
    """id, word count, hit words, the items found (sorted as strings) and the hit spans (word numbers, inclusive)."""
    rows = _scanned(docs, benchmark, F.col(id_col), text_col, item_col, item_text, window, max_windows)
    hit = F.aggregate("d_spans", F.lit(0).cast("long"), lambda total, s: total + s["last"] - s["first"] + 1)
    return rows.select(F.col("d_row").alias(id_col), F.col("d_words").alias("n_words"), hit.alias("n_hit"), F.col("d_items").alias("items"), F.col("d_spans").alias("spans"))


def cut_spans(text: str, spans: list[tuple[int, int]]) -> str:
    """The text without the words of the spans and what stands between them."""
    data = text.encode()
    places = [m.span() for m in _WORD.finditer(data.translate(_TABLE))]
    kept, at = [], 0
    for first, last in spans:
        kept.append(data[at : places[first][0]])
        at = places[last][1]
    return b"".join([*kept, data[at:]]).decode()


def clean(
    docs: DataFrame,
    benchmark: DataFrame,
    remove: str = "documents",
    text_col: str = "text",
    item_col: str = "item_id",
    item_text: str = "text",
    window: int = WINDOW,
    max_windows: int = MAX_WINDOWS,
) -> DataFrame:
    """The input's rows and columns without contamination.

    ``remove``: ``documents`` leaves out every row with a hit; ``spans`` cuts the hit words out of the text, scans what
    is left again until no window stands in it, and leaves out rows of which no word is left.
    """
    whole = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    scanned = lambda rest: _scanned(rest, benchmark, whole, text_col, item_col, item_text, window, max_windows)
    if remove == "documents":
        return scanned(docs).where(F.size("d_spans") == 0).select("d_row.*")
    if remove != "spans":
        raise ValueError(f"remove is 'documents' or 'spans', not {remove!r}")

    def shorten(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in texts:
            pairs = zip(batch.field(0).to_pylist(), batch.field(1).to_pylist(), strict=True)
            yield pa.array([cut_spans(text, [(s["first"], s["last"]) for s in spans]) for text, spans in pairs], pa.string())

    shortened = F.arrow_udf(shorten, "string")(F.struct("d_text", "d_spans"))
    columns = [F.col("d_new").alias(c) if c == text_col else F.col(f"d_row.`{c}`").alias(c) for c in docs.columns]
    rest, done = docs, None
    while True:  # every round takes words away from the rows that it goes on with
        marked = cut(scanned(rest))
        clear = marked.where(F.size("d_spans") == 0).select("d_row.*")
        done = clear if done is None else done.unionByName(clear)
        left = marked.where(F.size("d_spans") > 0).withColumn("d_new", shortened).where(F.col("d_new").rlike(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]"))
        rest = cut(left.select(*columns))
        if rest.isEmpty():
            return done


def query(documents: DataFrame, benchmark: DataFrame) -> DataFrame:
    """op5: what every document holds of the benchmark."""
    return scan(documents, benchmark).select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
    )


SQL = r"""
WITH words AS (
  SELECT row_number() OVER () AS k, doc_id,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM documents
), item_words AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM benchmark
), item_windows AS (
  SELECT item_id, list_slice(w, i, i + least(10, len(w)) - 1) AS win
  FROM item_words, unnest(range(1, len(w) - least(10, len(w)) + 2)) AS t(i) WHERE len(w) > 0
), lengths AS (SELECT DISTINCT len(win) AS n FROM item_windows),
doc_windows AS (
  SELECT k, n, i, list_slice(w, i, i + n - 1) AS win
  FROM words, lengths, unnest(range(1, len(w) - n + 2)) AS t(i) WHERE len(w) >= n
), hits AS (
  SELECT k, n, i, item_id FROM doc_windows JOIN item_windows USING (win)
), hit_words AS (
  SELECT k, count(DISTINCT i + d) AS n_hit FROM hits, unnest(range(0, n)) AS t(d) GROUP BY k
), hit_items AS (
  SELECT k, count(DISTINCT CAST(item_id AS VARCHAR)) AS n_items, array_to_string(list_sort(list_distinct(list(CAST(item_id AS VARCHAR)))), ',') AS names
  FROM hits GROUP BY k
)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
       sha256(coalesce(names, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM words LEFT JOIN hit_words USING (k) LEFT JOIN hit_items USING (k)
"""
