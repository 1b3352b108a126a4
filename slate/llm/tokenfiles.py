"""Token ids in files of directly addressable codes.

An id is split into chunks of 8 bits. Level 0 holds the lowest chunk of every id; a continuation bitmap marks the ids that
have a further chunk, which stands on the next level, and so on. A rank directory counts the marks up to every
512th, so the place of an id on the next level is one directory entry plus the marks of less than 512 bits: any id of a file
is read from a few bytes, without decoding a block.

A file is a run of segments of ``SEGMENT`` ids, a table of its documents (ids, starts), and a directory of the segments:

    segment    b"DAC1", levels (u32), ids (u64), chunks per level (u64 each), then for each level: chunks, bitmap, ranks (u32)
    documents  ids (i64), whether the id is null (u8), starts in the file (u64), one more start for the end
    directory  offset of every segment (u64), offset of the documents (u64)
    tail       segments (u64), documents (u64), ids (u64), offset of the directory (u64), b"DACEND01"

``write`` sorts the documents by id over range partitions, whose number grows with the input, encodes each partition and writes one file of it under a fresh
name; a repeated task writes another name. The driver gets one row per file, puts the names and running totals in a manifest,
and removes files that no manifest names. Files go to any file system that pyarrow.fs opens by the path's scheme.

Cases: a null or empty text is just its end id; documents of one id stand together, ordered by the text's XXH64, then the text; null ids come first;
repeated rows are all written; an empty table gives a manifest without files. Texts are never cut. Only the id
and text columns are read.
"""

from __future__ import annotations

import json
import os
import re
import struct
import uuid
from array import array
from collections.abc import Callable, Iterator
from functools import lru_cache
from pathlib import Path

import numpy as np
import pyarrow as pa
import public_tokenizers
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from slate.llm.batches import partitions, sliced
from slate.session import scratch

TOKENIZER = "word_bpe_49k.json"
END_ID = 1
SEGMENT = 1 << 20
RANK_BITS = 512
TAIL = struct.Struct("<QQQQ8s")
MAGIC, TAIL_MAGIC = b"DAC1", b"DACEND01"
MANIFEST = "manifest.json"


def pack(ids: np.ndarray) -> bytes:
    """One segment."""
    levels, rest = [], ids.astype(np.uint32)
    while True:
        low, rest = (rest & 255).astype(np.uint8), rest >> 8
        more = rest > 0
        levels.append((low, more))
        rest = rest[more]
        if not len(rest):
            break
    parts = [MAGIC, struct.pack("<IQ", len(levels), len(ids)), struct.pack(f"<{len(levels)}Q", *[len(low) for low, _ in levels])]
    for low, more in levels:
        marks = np.packbits(more, bitorder="little")
        counts = np.add.reduceat(more, np.arange(0, len(more), RANK_BITS), dtype=np.uint32) if len(more) else np.zeros(0, np.uint32)
        ranks = np.concatenate(([0], np.cumsum(counts)))[:-1].astype("<u4") if len(counts) else counts
        parts += [low.tobytes(), marks.tobytes(), ranks.tobytes()]
    return b"".join(parts)


class Segment:
    """A segment, read through ``read(offset, length)``: bytes in memory or ranges of a file."""

    def __init__(self, read, offset: int = 0) -> None:
        self.read = read
        levels, self.n = struct.unpack("<IQ", read(offset + 4, 12))
        sizes = struct.unpack(f"<{levels}Q", read(offset + 16, 8 * levels))
        self.places, at = [], offset + 16 + 8 * levels
        for n in sizes:
            marks, ranks = at + n, at + n + (n + 7) // 8
            self.places.append((at, marks, ranks))
            at = ranks + 4 * ((n + RANK_BITS - 1) // RANK_BITS)
        self.stop = at

    def _rank(self, level: int, i: int) -> int:
        """Marks before place i."""
        _, marks, ranks = self.places[level]
        block = i // RANK_BITS
        base = struct.unpack("<I", self.read(ranks + 4 * block, 4))[0] if i % RANK_BITS else 0
        if not i % RANK_BITS:
            return self._rank_at(level, block)
        start = block * RANK_BITS
        return base + int(np.unpackbits(np.frombuffer(self.read(marks + start // 8, (i - start + 7) // 8), np.uint8), bitorder="little")[: i - start].sum())

    def _rank_at(self, level: int, block: int) -> int:
        chunks, marks, ranks = self.places[level]
        blocks = (marks - chunks + RANK_BITS - 1) // RANK_BITS
        if block < blocks:
            return struct.unpack("<I", self.read(ranks + 4 * block, 4))[0]
        return self.places[level + 1][1] - self.places[level + 1][0] if level + 1 < len(self.places) else 0

    def ids(self, a: int, b: int, level: int = 0) -> np.ndarray:
        """Ids a to b of the segment (on a level: what the chunks from a to b and all above them stand for)."""
        chunks, marks, _ = self.places[level]
        out = np.frombuffer(self.read(chunks + a, b - a), np.uint8).astype(np.uint32)
        if level + 1 < len(self.places) and b > a:
            bits = np.unpackbits(np.frombuffer(self.read(marks + a // 8, (b + 7) // 8 - a // 8), np.uint8), bitorder="little")[a % 8 : a % 8 + b - a].astype(bool)
            if n := int(bits.sum()):
                at = self._rank(level, a)
                out[bits] |= self.ids(at, at + n, level + 1) << 8
        return out


class Writer:
    """Writes one file. Holds one segment and the document table in memory."""

    def __init__(self, stream) -> None:
        self.stream, self.at, self.total = stream, 0, 0
        self.offsets: list[int] = []
        self.docs: list[int] = []
        self.nulls: list[int] = []
        self.starts: list[int] = [0]
        self.held: list[np.ndarray] = []
        self.n_held = 0

    def _put(self, data: bytes) -> None:
        self.stream.write(data)
        self.at += len(data)

    def _flush(self, whole: bool) -> None:
        ids = np.concatenate(self.held) if self.held else np.zeros(0, np.uint32)
        stop = len(ids) if whole else len(ids) - len(ids) % SEGMENT
        for k in range(0, stop, SEGMENT):
            self.offsets.append(self.at)
            self._put(pack(ids[k : min(k + SEGMENT, stop)]))
        self.held, self.n_held = [ids[stop:]], len(ids) - stop

    def add(self, docs: list[int | None], lengths: list[int], ids: np.ndarray) -> None:
        """Documents with the lengths of their ids, which stand one after another in ``ids``."""
        self.docs += [doc or 0 for doc in docs]
        self.nulls += [doc is None for doc in docs]
        self.starts += (self.total + np.cumsum(lengths)).tolist()
        self.total += len(ids)
        self.held.append(ids)
        self.n_held += len(ids)
        if self.n_held >= SEGMENT:
            self._flush(False)

    def close(self) -> None:
        self._flush(True)
        table = self.at
        self._put(np.array(self.docs, "<i8").tobytes() + np.array(self.nulls, np.uint8).tobytes() + np.array(self.starts, "<u8").tobytes())
        directory = self.at
        self._put(np.array([*self.offsets, table], "<u8").tobytes())
        self._put(TAIL.pack(len(self.offsets), len(self.docs), self.total, directory, TAIL_MAGIC))


class Reader:
    """A file opened for random access."""

    def __init__(self, source) -> None:
        self.source = source
        size = source.size()
        self.n_segments, self.n_docs, self.n_ids, directory, magic = TAIL.unpack(self._read(size - TAIL.size, TAIL.size))
        if magic != TAIL_MAGIC:
            raise ValueError("not a file of directly addressable codes")
        offsets = np.frombuffer(self._read(directory, 8 * (self.n_segments + 1)), "<u8").astype(np.int64)
        self.offsets, self.table = offsets[:-1].tolist(), int(offsets[-1])
        self.loaded: tuple[int, Segment | None] = (-1, None)

    def _read(self, offset: int, length: int) -> bytes:
        self.source.seek(offset)
        return self.source.read(length)

    def documents(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        n = self.n_docs
        data = self._read(self.table, 17 * n + 8)
        return np.frombuffer(data, "<i8", n), np.frombuffer(data, np.uint8, n, 8 * n).astype(bool), np.frombuffer(data, "<u8", n + 1, 9 * n).astype(np.int64)

    def token(self, i: int) -> int:
        """Any id of the file, from a few small reads."""
        if not 0 <= i < self.n_ids:
            raise IndexError(i)
        at = i % SEGMENT
        return int(Segment(self._read, self.offsets[i // SEGMENT]).ids(at, at + 1)[0])

    def segment(self, k: int) -> Segment:
        """Segment k, read whole."""
        stop = self.offsets[k + 1] if k + 1 < self.n_segments else self.table
        data = self._read(self.offsets[k], stop - self.offsets[k])
        return Segment(lambda offset, length: data[offset : offset + length])

    def ids(self, a: int, b: int) -> np.ndarray:
        """Ids a to b of the file; segments are loaded one at a time."""
        parts = [np.zeros(0, np.uint32)]
        while a < b:
            k = a // SEGMENT
            if k != self.loaded[0]:
                self.loaded = (k, self.segment(k))
            stop = min(b, (k + 1) * SEGMENT)
            parts.append(self.loaded[1].ids(a - k * SEGMENT, stop - k * SEGMENT))
            a = stop
        return np.concatenate(parts)


_P = rb"!-/:-@\[-`{-~"
#: Chunks that the tokenizer splits anyway: at white space, and where an ASCII letter or digit meets ASCII punctuation.
CHUNK = re.compile(rb"[%b]*+[^\s%b]++(?:(?<=[a-z0-9])|(?=\s|\Z))|\S+" % (_P, _P))
#: One word for the tokenizer, whatever stands beside it.
LETTERS = re.compile(rb"[a-z]+")
HELD = 400_000
#: The normaliser and the first split of the tokenizers for which ``CHUNK`` is right.
LOWERED = {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]}
PARTED = {"type": "Split", "pattern": {"Regex": r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"}, "behavior": "Removed", "invert": True}
#: Texts of a worker's first batch that are encoded by the library too.
CHECKED = 16


def _splits_at_chunks(parts: dict) -> bool:
    """Whether a definition lowers and splits its input as ``CHUNK`` does, so that no merge crosses a chunk's end."""
    before = parts.get("pre_tokenizer") or {}
    first = before.get("pretokenizers", [before])[0]
    return parts.get("normalizer") == LOWERED and first == PARTED and parts.get("truncation") is None and not parts["model"].get("dropout")


class Encoder:
    """The tokenizers library, asked once for each distinct chunk that was not met lately.

    Where the tokenizer's definition lowers its input and splits it as ``CHUNK`` does, the ids of a text are those of its
    chunks. Texts that may hold special tokens, and all texts of other definitions, are given to the library whole. The first texts
    of every worker process are encoded in both ways, and a difference is an error.
    """

    def __init__(self, definition: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_str(definition)
        added = self.library.get_added_tokens_decoder()
        self.special = [t.content.encode() for t in added.values()]
        parts = json.loads(definition)
        self.chunked = _splits_at_chunks(parts)
        self.checked = False
        # the same tokenizer without its normaliser, for chunks that are normal already
        self.plain = Tokenizer.from_str(json.dumps(parts | {"normalizer": None}))
        suffix = parts["model"].get("end_of_word_suffix") or None
        vocabulary = self.library.get_vocab()
        #: Whether an id ends a word.
        self.ends = np.zeros(max(vocabulary.values()) + 1, bool)
        self.ends[[i for piece, i in vocabulary.items() if suffix and piece.endswith(suffix)]] = True
        # a token that the library takes out of a text before all else: it can stand between chunks
        taken = [(i, t.content.encode()) for i, t in added.items() if t.special and not (t.normalized or t.lstrip or t.rstrip or t.single_word)]
        self.between = taken[0] if taken else None
        self.known: dict[bytes, bytes] = {}
        self.older: dict[bytes, bytes] = {}

    @staticmethod
    def _ids(library, texts: list[str]) -> list[bytes]:
        return [array("I", x.ids).tobytes() for x in library.encode_batch_fast(texts, add_special_tokens=False)]

    def _chunks(self, chunks: set[bytes]) -> Iterator[tuple[bytes, bytes]]:
        """Chunks with their ids. ASCII chunks have no capitals or white space left, so normalising would not change them."""
        words = [c for c in chunks if LETTERS.fullmatch(c)] if self.ends.any() else []
        rest = chunks.difference(words)
        normal = [c for c in rest if c.isascii()]
        yield from self._joined(self.plain, words, b" ", lambda ids: np.flatnonzero(self.ends[ids]) + 1, 0)
        for own, library in ((normal, self.plain), (list(rest.difference(normal)), self.library)):
            if self.between is None:
                yield from zip(own, self._ids(library, [c.decode() for c in own]), strict=True)
                continue
            mark, content = self.between
            yield from self._joined(library, own, content, lambda ids, mark=mark: np.append(np.flatnonzero(ids == mark), len(ids)), 1)

    def _joined(self, library, chunks: list[bytes], between: bytes, stops: Callable[[np.ndarray], np.ndarray], gap: int, at_once: int = 1000) -> Iterator[tuple[bytes, bytes]]:
        """Many chunks as one text: where one's ids stop, and ``gap`` ids on, the next one's start."""
        groups = [chunks[k : k + at_once] for k in range(0, len(chunks), at_once)]
        for group, data in zip(groups, self._ids(library, [between.join(g).decode() for g in groups]), strict=True):
            cuts = (4 * stops(np.frombuffer(data, np.uint32))).tolist()
            yield from zip(group, [data[a:b] for a, b in zip([0, *[c + 4 * gap for c in cuts[:-1]]], cuts, strict=True)], strict=True)

    def encode(self, data: list[bytes]) -> list[bytes]:
        """Ids (little-endian unsigned 32-bit) of texts in UTF-8."""
        whole = [not self.chunked or any(s in x for s in self.special) for x in data]
        split = [[] if w else CHUNK.findall(x.lower()) for x, w in zip(data, whole, strict=True)]
        # two generations: what was met since the last turn, and what was met in the turn before
        if len(self.known) > HELD:
            self.older, self.known = self.known, {}
        missing = set().union(*split).difference(self.known)
        self.known.update((c, self.older[c]) for c in missing.intersection(self.older))
        self.known.update(self._chunks(missing.difference(self.known)))
        known = self.known.__getitem__
        asked = iter(self._ids(self.library, [x.decode() for x, w in zip(data, whole, strict=True) if w]))
        out = [next(asked) if w else b"".join(map(known, own)) for w, own in zip(whole, split, strict=True)]
        if not self.checked:
            self.checked = True
            if out[:CHECKED] != self._ids(self.library, [x.decode() for x in data[:CHECKED]]):
                raise RuntimeError("the ids of chunks are not those that the tokenizers library gives for whole texts")
        return out


@lru_cache(maxsize=1)
def _encoder(definition: str) -> Encoder:
    """One encoder per worker process: its next task goes on with the chunks that it has."""
    return Encoder(definition)


def write(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", tokenizer: str | None = None, end_id: int = END_ID) -> None:
    """Writes the files and the manifest of all documents under ``path``."""
    spark = docs.sparkSession
    definition = spark.sparkContext.broadcast(Path(tokenizer or public_tokenizers.path(TOKENIZER)).read_text())
    store, root = fs.FileSystem.from_uri(path)
    store.create_dir(root)
    order = ("t_id", "t_hash", "t_text")
    keyed = docs.select(F.col(id_col).cast("long").alias("t_id"), F.col(text_col).alias("t_text"), F.xxhash64(F.col(text_col)).alias("t_hash"))
    # the hash parts the rows of one id, or of none, if they are many
    ordered = keyed.repartitionByRange(partitions(docs), "t_id", "t_hash").sortWithinPartitions(*order).select("t_id", "t_text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, writer = None, None
        part, name = TaskContext.get().partitionId(), f"ids-{uuid.uuid4().hex}.dac"
        where, folder = fs.FileSystem.from_uri(path)
        end = np.array([end_id], "<u4").tobytes()
        for batch in sliced(batches, 1):
            if not batch.num_rows:
                continue
            if writer is None:
                encoder, writer = _encoder(definition.value), Writer(where.open_output_stream(f"{folder}/{name}"))
            ids = encoder.encode([t or b"" for t in batch.column(1).cast(pa.binary()).to_pylist()])
            writer.add(batch.column(0).to_pylist(), [len(x) // 4 + 1 for x in ids], np.frombuffer(end.join([*ids, b""]), "<u4"))
        if writer is not None:
            writer.close()
            writer.stream.close()
            yield pa.RecordBatch.from_pylist([{"part": part, "name": name, "n_docs": len(writer.docs), "n_ids": writer.total}])

    done = ordered.mapInArrow(run, "part long, name string, n_docs long, n_ids long").collect()
    base, files = 0, []
    for row in sorted(done, key=lambda r: r.part):
        files.append({"name": row.name, "start": base, "n_docs": row.n_docs, "n_ids": row.n_ids})
        base += row.n_ids
    with store.open_output_stream(f"{root}/{MANIFEST}") as out:
        out.write(json.dumps({"n_ids": base, "files": files}).encode())
    named = {f["name"] for f in files}
    for found in store.get_file_info(fs.FileSelector(root)):
        if found.base_name.endswith(".dac") and found.base_name not in named:
            store.delete_file(found.path)


def manifest(path: str) -> dict:
    store, root = fs.FileSystem.from_uri(path)
    with store.open_input_stream(f"{root}/{MANIFEST}") as source:
        return json.loads(source.read())


def token(path: str, i: int) -> int:
    """Id number i of all that was written."""
    store, root = fs.FileSystem.from_uri(path)
    for f in manifest(path)["files"]:
        if f["start"] <= i < f["start"] + f["n_ids"]:
            with store.open_input_file(f"{root}/{f['name']}") as source:
                return Reader(source).token(i - f["start"])
    raise IndexError(i)


def read(spark: SparkSession, path: str, id_col: str = "doc_id") -> DataFrame:
    """id, start (ids of all documents before it) and ids (little-endian unsigned 32-bit) of every document."""
    schema = f"`{id_col}` long, start long, ids binary"
    files = manifest(path)["files"]
    if not files:
        return spark.createDataFrame([], schema)
    listed = spark.createDataFrame([(f["name"], f["start"]) for f in files], "name string, start long").repartition(len(files))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = fs.FileSystem.from_uri(path)
        for batch in batches:
            for name, base in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                with store.open_input_file(f"{root}/{name}") as source:
                    yield from _rows(Reader(source), base, id_col)

    return listed.mapInArrow(run, schema)


def _rows(reader: Reader, base: int, id_col: str, at_once: int = 512) -> Iterator[pa.RecordBatch]:
    """Batches of at most so many documents and, but for a longer document, of one segment's ids."""
    docs, nulls, starts = reader.documents()
    k = 0
    while k < len(docs):
        stop = max(k + 1, min(k + at_once, int(np.searchsorted(starts, starts[k] + SEGMENT, "right")) - 1))
        ids = reader.ids(int(starts[k]), int(starts[stop])).astype("<u4").tobytes()
        places = (4 * (starts[k : stop + 1] - starts[k])).tolist()
        own = [ids[a:b] for a, b in zip(places[:-1], places[1:], strict=True)]
        yield pa.RecordBatch.from_arrays([pa.array(docs[k:stop], mask=nulls[k:stop]), pa.array(starts[k:stop] + base), pa.array(own, pa.binary())], names=[id_col, "start", "ids"])
        k = stop


def query(documents: DataFrame) -> DataFrame:
    """op8: every document's place, length and checksum, read back from the files."""
    spark = documents.sparkSession
    path = scratch(spark, "token-ids")
    write(documents, path)
    return read(spark, path).select("doc_id", "start", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), F.crc32("ids").alias("ids_crc32"))
