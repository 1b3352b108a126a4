"""Spelling variants of words by merging the subtrees of an errata trie.

The words stand in a trie whose nodes are prefixes. The child of a node with the most words below it is heavy, all others, and the end
of a word, are light; a word has at most log2(words) light children on its way. Only light subtrees are moved, small to large, with one character
changed at the node where they hang:

* skipped: below the node itself (the word without that character),
* replaced by the heavy character: below the heavy child,
* the heavy character put before it: below the heavy child,
* replaced by any other light character: light subtrees of one node merged with each other.

Terminals that coincide are words that differ by one inserted, deleted or replaced code point, and each such pair coincides once:
a deletion counts only at the last character of a run of equal ones. In Spark, nodes are groups of prefix hashes (128 bits), heavy children an aggregate over
them, and coinciding terminals an equality join of the changed words with the words. Light subtrees of one node are groups of at most as many words as
the alphabet has letters. So pairs are never made within a group: rows grow as words times log2(words), and near pairs.

Nodes near the root hold nearly all words. Counts are combined before the shuffle, and the join of words with nodes is salted by depth.

Cases: a null or empty text has no words; a null id stands as nothing before the colon in the hash that decides on deletions; repeated rows
count each; words of any length are taken whole (a prefix is only a hash); ties go to the larger count, then to the first word in code-point order; no words give an empty table; other
columns are not read, whatever their names are.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from slate.llm.batches import partitions, sliced
from slate.llm.graph import _ends
from slate.session import cut

RUN = re.compile("[a-zÀ-ÿ]+")
SHORTEST, OCCURRENCES, RATIO = 6, 5, 5
NOISE = 199
HELD_WORDS = 200_000
HELD_ROWS = 50_000
LONG_TEXT = 4 << 20
#: Salts of the nodes near the root, of which there are at most 1 + 90 + 90 * 90, and of all others.
ROOT_DEPTH, ROOT_SALTS, SALTS = 2, 64, 8


def word_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shortest: int = SHORTEST, noise: int | None = None) -> DataFrame:
    """(word, n): occurrences of all words of at least ``shortest`` code points.

    With ``noise``, the run whose CRC-32 together with its document's id is divisible by it loses one character, as typing errors would.
    """
    rows = docs.select(F.col(f"`{id_col}`").cast("string").alias("id"), F.col(f"`{text_col}`").cast("binary").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: Counter[str] = Counter()
        for batch in sliced(batches, 1):
            for who, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if not text:
                    continue
                lowered = text.lower().decode()
                runs = Counter(RUN.findall(lowered) if len(lowered) < LONG_TEXT else (m[0] for m in RUN.finditer(lowered)))
                before = zlib.crc32(f"{who or ''}:".encode())
                for word, n in runs.items():
                    if len(word) < shortest:
                        continue
                    if noise:
                        hashed = zlib.crc32(word.encode(), before)
                        if hashed % noise == 0:
                            at = hashed % len(word)
                            word = word[:at] + word[at + 1 :]
                            if len(word) < shortest:
                                continue
                    total[word] += n
                if len(total) > HELD_WORDS:
                    yield _counts(total)
                    total = Counter()
        yield _counts(total)

    return rows.mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


def _counts(total: Counter[str]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(total.keys(), pa.string()), pa.array(total.values(), pa.int64())], names=["word", "n"])


def _prefixes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row for each node on a word's way: the node, its depth, the next character (empty at the end) and the word's own node."""
    for batch in batches:
        columns: list[list] = [[], [], [], []]
        for word in batch.column(0).to_pylist():
            own = xxhash.xxh3_128()
            nodes = [own.digest()]
            for character in word:
                own.update(character.encode())
                nodes.append(own.digest())
            columns[0] += nodes
            columns[1] += range(len(nodes))
            columns[2] += [*word, ""]
            columns[3] += [nodes[-1]] * len(nodes)
            if len(columns[0]) > HELD_ROWS:
                yield _nodes(columns)
                columns = [[], [], [], []]
        yield _nodes(columns)


def _nodes(columns: list[list]) -> pa.RecordBatch:
    kinds = (pa.binary(), pa.int32(), pa.string(), pa.binary())
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names=["node", "depth", "next", "key"])


def _moved(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The terminals of a word's light subtrees after one change: as a word (apart is false), or as a place among the light subtrees of a node (true)."""
    for batch in batches:
        made: list[tuple] = []
        for word, n, lights in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            for light in lights:
                at, heavy = light["depth"], light["heavy"]
                before, own, after = word[:at], word[at : at + 1], word[at + 1 :]
                made.append((before + heavy + word[at:], False, word, n))
                if own:
                    made.append((before + heavy + after, False, word, n))
                    made.append((before + "\0" + after, True, word, n))
                    if after[:1] != own:
                        made.append((before + after, False, word, n))
            if len(made) > HELD_ROWS:
                yield _terminals(made)
                made = []
        yield _terminals(made)


def _terminals(made: list[tuple]) -> pa.RecordBatch:
    kinds = (("terminal", pa.string()), ("apart", pa.bool_()), ("word", pa.string()), ("n", pa.int64()))
    return pa.RecordBatch.from_arrays([pa.array([m[i] for m in made], t) for i, (_, t) in enumerate(kinds)], names=[k for k, _ in kinds])


def _salts(depth: Column) -> Column:
    return F.when(depth <= ROOT_DEPTH, F.lit(ROOT_SALTS)).otherwise(F.lit(SALTS))


def light_children(words: DataFrame) -> DataFrame:
    """(key, depth, heavy): the nodes where a word leaves by a light child or ends, with the heavy character there; key is the word's own node."""
    on_way = cut(words.select("word").mapInArrow(_prefixes, "node binary, depth int, next string, key binary"))
    below = on_way.groupBy("node", "depth", "next").agg(F.count("*").alias("n"))
    # the largest child is heavy, the end of a word never is
    heavy = F.max_by("next", F.struct(F.col("next") != "", "n", "next")).alias("heavy")
    branching = below.groupBy("node", "depth").agg(heavy, F.count("*").alias("children")).where("children > 1")
    salted = branching.select("node", "heavy", F.explode(F.sequence(F.lit(0), _salts(F.col("depth")) - 1)).alias("salt"))
    return on_way.withColumn("salt", F.pmod(F.hash("key"), _salts(F.col("depth")))).join(salted, ["node", "salt"]).where("next <> heavy").select("key", "depth", "heavy")


def near(words: DataFrame) -> DataFrame:
    """(word, n_near, best): for each word with near words their number, and the one of the largest count as a struct (less: the count's negative, word).

    ``words`` has distinct words with their counts n.
    """
    parts = partitions(words)
    lights = light_children(words).groupBy("key").agg(F.collect_list(F.struct("depth", "heavy")).alias("lights"))
    known = words.mapInArrow(_with_key, "word string, n long, key binary")
    moved = cut(known.join(lights, "key").select("word", "n", "lights").mapInArrow(_moved, "terminal string, apart boolean, word string, n long"))
    met = moved.where("not apart").join(words.select(F.col("word").alias("terminal"), F.col("n").alias("t_n")), "terminal")
    sides = F.array(F.struct(F.col("word"), F.struct((-F.col("t_n")).alias("less"), F.col("terminal").alias("word")).alias("best")), F.struct(F.col("terminal").alias("word"), F.struct((-F.col("n")).alias("less"), F.col("word")).alias("best")))
    pairs = met.select(F.inline(sides)).select("word", F.lit(1).cast("long").alias("n_near"), "best")
    # words of one group differ in one letter at one place: no more than the alphabet has letters
    groups = moved.where("apart").repartition(parts, "terminal").groupBy("terminal").agg(F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("less"), "word"))).alias("all")).where(F.size("all") > 1)
    each = groups.select("all", F.explode("all").alias("own"))
    others = each.select(F.col("own.word").alias("word"), (F.size("all") - 1).cast("long").alias("n_near"), F.when(F.col("own.word") == F.col("all")[0]["word"], F.col("all")[1]).otherwise(F.col("all")[0]).alias("best"))
    return pairs.unionByName(others).groupBy("word").agg(F.sum("n_near").alias("n_near"), F.min("best").alias("best"))


def _with_key(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        keys = [xxhash.xxh3_128_digest(word.encode()) for word in batch.column(0).to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(keys, pa.binary())], names=["word", "n", "key"])


def variants(words: DataFrame, ratio: int = RATIO) -> DataFrame:
    """word, n, n_near, form, form_n and root for every word of ``words`` (distinct words with counts n).

    A word's form is its near word of the largest count, if that is at least ``ratio`` times its own; root is where the forms end. Counts rise along the
    forms, so they end.
    """
    if ratio < 2:
        raise ValueError("ratio must be at least 2")
    found = words.join(near(words), "word", "left")
    is_form = -F.col("best.less") >= F.lit(ratio) * F.col("n")
    formed = cut(found.select("word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(is_form, F.col("best.word")).alias("form"), F.when(is_form, -F.col("best.less")).alias("form_n")))
    roots = _ends(cut(formed.where("form is not null").select(F.col("word").alias("node"), F.col("form").alias("root"))))
    return formed.join(roots, formed.word == roots.node, "left").select("word", "n", "n_near", "form", "form_n", F.coalesce("root", "word").alias("root"))


def query(documents: DataFrame) -> DataFrame:
    """op13: the words of all documents with their near words and forms."""
    words = word_counts(documents, noise=NOISE).where(F.col("n") >= OCCURRENCES)
    return variants(cut(words))
