"""SentencePiece encoding and decoding for merge-type vocabularies.

A text becomes symbols (its characters, white space as U+2581 and one more of it in front), and an agenda of adjacent
symbol pairs that form a piece, ordered by the piece's score and then from left to right, says which pair is merged next, until
no pair forms a piece. Characters that are no piece become byte pieces.

No piece joins what stands before a run of U+2581 with what follows, none contains a line end, and in none a letter is
followed by a character that is neither letter nor digit; ``Vocabulary`` checks this of its pieces, and texts are cut there and the agenda runs once for each distinct segment
that a task has not met lately. Short segments of a batch share one agenda in numpy arrays: each round takes the best
pair of every segment at once. Long segments have a heap each.

Ids and decoded texts come from the agenda alone. Every batch is checked against the sentencepiece library, ids and decoded texts alike, and a
difference is an error: the library knows models (other normalisers, user symbols) that this module does not. ``agrees`` says that a row was
checked and equal.

Cases: a null or empty text has only the begin and end ids and decodes to an empty text; repeated rows are encoded one by
one; an empty table gives an empty table. Texts are never cut. Only the id and text columns are read by ``encoded``.
The model file is read on the driver and broadcast (its size is fixed), so executors need no copy of it.
"""

from __future__ import annotations

import heapq
import re
from array import array
from collections.abc import Iterator
from functools import lru_cache
from pathlib import Path

import numpy as np
import pyarrow as pa
import public_tokenizers
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from slate.llm.batches import sliced

MODEL = "piece_bpe_32k.model"
MARK = "▁"
#: Some of the characters that are letters.
LETTERS = "A-Za-zÀ-ÖØ-öø-ÿ"
LONG = 48
HELD = 150_000
_WIDTH = 21
_SLOT_BITS = 20
_NONE = np.int64(1) << 62


class Vocabulary:
    """Pieces, merges and bytes of a merge-type model."""

    def __init__(self, model: bytes) -> None:
        self.library = sentencepiece.SentencePieceProcessor(model_proto=model)
        get = self.library
        size = get.get_piece_size()
        self.first_free = size
        self.begin, self.end = get.bos_id(), get.eos_id()
        self.normal: dict[str, int] = {}
        self.bytes_of: list[bytes] = []
        self.byte_ids: dict[int, int] = {}
        for i in range(size):
            piece = get.id_to_piece(i)
            if get.is_byte(i):
                self.byte_ids[int(piece[3:5], 16)] = i
                self.bytes_of.append(bytes([int(piece[3:5], 16)]))
            elif get.is_control(i):
                self.bytes_of.append(b"")
            elif get.is_unknown(i):
                self.bytes_of.append(" ⁇ ".encode())
            else:
                self.normal[piece] = i
                self.bytes_of.append(piece.replace(MARK, " ").encode())
        if len(self.byte_ids) != 256:
            raise ValueError("the model has no byte pieces")
        ranks = {score: k for k, score in enumerate(sorted({get.get_score(i) for i in self.normal.values()}, reverse=True))}
        merges = {}
        whole = letters = True
        for piece, i in self.normal.items():
            whole = whole and MARK not in piece.lstrip(MARK) and not ("\n" in piece and len(piece) > 1)
            letters = letters and not any(a.isalpha() and not b.isalnum() for a, b in zip(piece, piece[1:], strict=False))
            for k in range(1, len(piece)):
                left, right = self._symbol(piece[:k]), self._symbol(piece[k:])
                if left is not None and right is not None:
                    merges[left << _WIDTH | right] = (ranks[get.get_score(i)], i)
        self.merges = merges
        self._hash(merges)
        self.symbol_of = np.arange(self.first_free, self.first_free + 0x110000)
        for piece, i in self.normal.items():
            if len(piece) == 1:
                self.symbol_of[ord(piece)] = i
        word = f"{MARK}*+[^{MARK}\n{LETTERS}]*+[{LETTERS}]++(?![^\\W_])|" if letters else ""
        self.segments = re.compile(f"{word}{MARK}*+[^{MARK}\n]++|{MARK}++|\n" if whole else "(?s).+")
        self.known: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}

    def _symbol(self, text: str) -> int | None:
        """The id of a piece; a character that is none has a number of its own beyond the ids."""
        found = self.normal.get(text)
        return found if found is not None or len(text) > 1 else self.first_free + ord(text)

    def _hash(self, merges: dict[int, tuple[int, int]]) -> None:
        """Open-addressing table of the merges, for lookups of many pairs at once."""
        keys = np.array(sorted(merges), np.int64)
        self.slots = np.full(1 << _SLOT_BITS, -1, np.int64)
        self.ranks, self.results = np.zeros(1 << _SLOT_BITS, np.int64), np.zeros(1 << _SLOT_BITS, np.int64)
        self.probes = 0
        place = self._slot(keys)
        while len(keys):
            self.probes += 1
            free = self.slots[place] < 0
            self.slots[place[free]] = keys[free]
            done = self.slots[place] == keys
            own = [merges[k] for k in keys[done].tolist()]
            self.ranks[place[done]] = [r for r, _ in own]
            self.results[place[done]] = [i for _, i in own]
            keys, place = keys[~done], (place[~done] + 1) & ((1 << _SLOT_BITS) - 1)

    @staticmethod
    def _slot(keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - _SLOT_BITS)).astype(np.int64)

    def _ids(self, symbols: list[int]) -> bytes:
        out: list[int] = []
        for s in symbols:
            if s < self.first_free:
                out.append(s)
            else:
                out += [self.byte_ids[b] for b in chr(s - self.first_free).encode()]
        return array("I", out).tobytes()

    def agenda(self, segment: str) -> bytes:
        """Ids of one segment, by a heap of (score rank, place) over a linked list of symbols."""
        symbols = [self._symbol(c) for c in segment]
        n = len(symbols)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap: list[tuple[int, int, int, int, int]] = []

        def offer(i: int, j: int) -> None:
            if (merge := self.merges.get(symbols[i] << _WIDTH | symbols[j])) is not None:
                heapq.heappush(heap, (merge[0], i, symbols[i], symbols[j], merge[1]))

        for i in range(n - 1):
            offer(i, i + 1)
        while heap:
            _, i, left, right, merged = heapq.heappop(heap)
            j = after[i] if symbols[i] == left else n
            if j >= n or symbols[j] != right:
                continue
            symbols[i], symbols[j], after[i] = merged, -1, after[j]
            if after[i] < n:
                before[after[i]] = i
                offer(i, after[i])
            if before[i] >= 0:
                offer(before[i], i)
        return self._ids([s for s in symbols if s >= 0])

    def _offers(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Place in the merge table of each pair, or -1."""
        wanted = left << _WIDTH | right
        place = self._slot(wanted)
        held = self.slots[place]
        out = np.where(held == wanted, place, -1)
        open_ = np.flatnonzero((held != wanted) & (held >= 0))
        for _ in range(self.probes):
            if not len(open_):
                break
            place[open_] = (place[open_] + 1) & ((1 << _SLOT_BITS) - 1)
            held = self.slots[place[open_]]
            hit = held == wanted[open_]
            out[open_[hit]] = place[open_[hit]]
            open_ = open_[~hit & (held >= 0)]
        return out

    def agendas(self, segments: list[str]) -> list[bytes]:
        """Ids of many short segments: in each round every segment merges the best pair on its agenda."""
        symbols = self.symbol_of[np.frombuffer("".join(segments).encode("utf-32-le"), np.uint32)]
        owner = np.repeat(np.arange(len(segments)), [len(s) for s in segments])
        out: list[bytes] = [b""] * len(segments)
        inner = np.append(owner[1:] == owner[:-1], False)
        offer = np.full(len(symbols), -1, np.int64)
        at = np.flatnonzero(inner)
        offer[at] = self._offers(symbols[at], symbols[at + 1])
        while len(symbols):
            order = np.where(offer >= 0, self.ranks[offer] << 32 | np.arange(len(symbols)), _NONE)
            starts = np.flatnonzero(np.concatenate(([True], owner[1:] != owner[:-1])))
            best = np.minimum.reduceat(order, starts)
            done = best == _NONE
            if done.any():
                ended = np.repeat(done, np.diff(np.append(starts, len(symbols))))
                self._finish(symbols[ended], owner[ended], out)
                symbols, owner, offer, order = symbols[~ended], owner[~ended], offer[~ended], None
                if not len(symbols):
                    break
                moved = np.cumsum(~ended) - 1
                place = moved[best[~done] & 0xFFFFFFFF]
            else:
                place = best & 0xFFFFFFFF
            symbols[place] = self.results[offer[place]]
            kept = np.ones(len(symbols), bool)
            kept[place + 1] = False
            new = (np.cumsum(kept) - 1)[place]
            symbols, owner, offer = symbols[kept], owner[kept], offer[kept]
            touched = np.concatenate((new, np.maximum(new - 1, 0)))
            after = np.minimum(touched + 1, len(symbols) - 1)
            same = (owner[touched] == owner[after]) & (after > touched)
            offer[touched] = np.where(same, self._offers(symbols[touched], symbols[after]), -1)
        return out

    def _finish(self, symbols: np.ndarray, owner: np.ndarray, out: list[bytes]) -> None:
        cuts = np.flatnonzero(owner[1:] != owner[:-1]) + 1
        starts = np.concatenate(([0], cuts)).tolist()
        odd = set(owner[symbols >= self.first_free].tolist())
        data = symbols.astype("<u4").tobytes()
        for a, b, k in zip(starts, [*starts[1:], len(symbols)], owner[starts].tolist(), strict=True):
            out[k] = self._ids(symbols[a:b].tolist()) if k in odd else data[4 * a : 4 * b]

    def forget(self) -> None:
        self.known, self.older = {}, {}

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids as little-endian unsigned 32-bit numbers, with begin and end ids."""
        begin, end = array("I", [self.begin]).tobytes(), array("I", [self.end]).tobytes()
        split = [self.segments.findall(MARK + t.replace(" ", MARK)) if t else [] for t in texts]
        # two generations: what was met since the last turn, and what was met in the turn before
        if len(self.known) > HELD:
            self.older, self.known = self.known, {}
        missing = set().union(*split).difference(self.known)
        self.known.update((s, self.older[s]) for s in missing.intersection(self.older))
        new = missing.difference(self.known)
        short = [s for s in new if len(s) <= LONG]
        if short:
            self.known.update(zip(short, self.agendas(short), strict=True))
        known = self.known.__getitem__
        long = {s: self.agenda(s) for s in new if len(s) > LONG}
        if long:
            known = lambda s: long[s] if len(s) > LONG else self.known[s]
        return [begin + b"".join(map(known, own)) + end for own in split]

    def decode(self, ids: bytes) -> str:
        table = self.bytes_of
        data = b"".join([table[i] for i in memoryview(ids).cast("I")])
        return (data[1:] if data.startswith(b" ") else data).decode(errors="replace")


@lru_cache(maxsize=1)
def _vocabulary(model: bytes) -> Vocabulary:
    """One vocabulary per worker process."""
    return Vocabulary(model)


def checked(own: Vocabulary, texts: list[str]) -> tuple[list[bytes], list[str]]:
    """Ids and decoded texts by the agenda; an error where the library gives others."""
    ids = own.encode(texts)
    decoded = [own.decode(x) for x in ids]
    theirs = own.library.encode(texts, add_bos=True, add_eos=True, num_threads=1)
    for text, mine, other, back, other_back in zip(texts, ids, theirs, decoded, own.library.decode(theirs, num_threads=1), strict=True):
        if mine != array("I", other).tobytes() or back != other_back:
            raise RuntimeError(f"the agenda and the sentencepiece library disagree on a text of {len(text)} characters that begins with {text[:60]!r}")
    return ids, decoded


def encoded(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", model: str | None = None) -> DataFrame:
    """id, ids (little-endian unsigned 32-bit), n_tokens, decoded text, and that the library agrees."""
    held = docs.sparkSession.sparkContext.broadcast(Path(model or public_tokenizers.path(MODEL)).read_bytes())
    fields = docs.select(F.col(id_col), F.lit(b"").alias("ids"), F.lit(0).cast("long").alias("n_tokens"), F.lit("").alias("decoded"), F.lit(True).alias("agrees"))
    names = fields.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = _vocabulary(held.value)
        try:
            for batch in sliced(batches, 1, 2 << 20):
                ids, decoded = checked(own, [t or "" for t in batch.column(1).to_pylist()])
                sizes = pa.array([len(x) // 4 for x in ids], pa.int64())
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(ids, pa.binary()), sizes, pa.array(decoded, pa.string()), pa.array([True] * len(ids), pa.bool_())], names=names)
        finally:  # the process waits for other tasks, which may need its memory
            own.forget()

    return docs.select(id_col, text_col).mapInArrow(run, fields.schema)


def query(documents: DataFrame) -> DataFrame:
    """op7: digests of every document's ids and decoded text."""
    return encoded(documents).select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"), "agrees")
