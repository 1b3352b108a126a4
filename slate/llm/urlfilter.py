"""URL allow and block lists as a trie over reversed host labels and path segments.

The rules, ordered by their reversed host labels, are cut into tries of at most ``max_bytes`` each (``cost`` of a rule: its labels
and segments, with their texts, as objects), so hosts of one top label stand together. One trie is built on the driver, broadcast, walked by all URLs and released before the next one; the longer match of both is
kept. A list that fits into one trie, as most do, is one pass without a write; a larger one takes more passes over ids and URLs, and no more memory.
Every URL walks down its host labels from the right; each node on the way that carries rules then walks the
path segments. The longest match wins: more host labels first, then the longer path.

A rule fits its host and every subdomain if the URL's path starts with the rule's path, character by character.
Two entries for one (host, path) are settled in favour of ``block``.

Cases: a null URL, or one without ``://``, has an empty host and path and gets the default verdict; ports and
user names stay part of the host text; an empty table gives an empty table; repeated rows give repeated results.
Only the id and URL columns are read.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from slate.session import cut

MAX_BYTES = 64 << 20
#: Bytes of a node of the trie as Python objects, more than measured.
NODE_BYTES = 450
DEFAULT = "allow"


@dataclass(frozen=True)
class Entry:
    verdict: str
    host: str
    path: str

    @property
    def name(self) -> str:
        return self.host + self.path


RULES = (
    Entry("block", "net", "/"),
    Entry("allow", "example.net", "/en/"),
    Entry("block", "example.com", "/de/"),
    Entry("allow", "org", "/fr/"),
)

_LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
_HOST_END = re.compile("[/?#]")
_PATH_END = re.compile("[?#]")


def parts(url: str | None) -> tuple[str, str]:
    """Host and path of a URL."""
    if url is None or (at := url.find("://")) < 0:
        return "", ""
    rest = url[at + 3 :]
    end = m.start() if (m := _HOST_END.search(rest)) else len(rest)
    host, tail = rest[:end].translate(_LOWER), rest[end:]
    return host, tail[: m.start()] if (m := _PATH_END.search(tail)) else tail


def _segments(path: str) -> tuple[list[str], str]:
    """Whole segments, each with its closing slash, and the open rest."""
    pieces = path.split("/")
    return [piece + "/" for piece in pieces[:-1]], pieces[-1]


@dataclass
class PathNode:
    children: dict[str, PathNode] = field(default_factory=dict)
    entry: Entry | None = None
    #: Entries whose path ends inside a segment, by what stands there, and the lengths of that.
    open_ends: dict[str, Entry] = field(default_factory=dict)
    lengths: set[int] = field(default_factory=set)


@dataclass
class HostNode:
    children: dict[str, HostNode] = field(default_factory=dict)
    paths: PathNode | None = None


def cost(rule: Entry) -> int:
    """Bytes that a rule takes in a trie at most."""
    return NODE_BYTES * (rule.host.count(".") + rule.path.count("/") + 4) + 4 * len(rule.name)


def settled_rules(rules: Iterable[Entry]) -> list[Entry]:
    """One rule for each (host, path), ordered by reversed host labels, so that what shares nodes stands together."""
    one: dict[tuple[str, str], Entry] = {}
    for rule in rules:
        if one.setdefault((rule.host, rule.path), rule).verdict != "block":
            one[rule.host, rule.path] = rule
    return sorted(one.values(), key=lambda r: (r.host.split(".")[::-1], r.path))


def tries(rules: Iterable[Entry], max_bytes: int = MAX_BYTES) -> Iterator[Trie]:
    """The rules in as few tries as their sizes allow; no rules give one empty trie."""
    held, size = [], 0
    for rule in settled_rules(rules):
        if held and size + cost(rule) > max_bytes:
            yield Trie(held)
            held, size = [], 0
        held.append(rule)
        size += cost(rule)
    yield Trie(held)


class Trie:
    def __init__(self, rules: Iterable[Entry]) -> None:
        self.root = HostNode()
        for rule in settled_rules(rules):
            self._add(rule)

    def _add(self, rule: Entry) -> None:
        node = self.root
        for label in reversed(rule.host.split(".")):
            node = node.children.setdefault(label, HostNode())
        node.paths = node.paths or PathNode()
        here, (whole, rest) = node.paths, _segments(rule.path)
        for segment in whole:
            here = here.children.setdefault(segment, PathNode())
        if rest:
            here.open_ends[rest] = rule
            here.lengths.add(len(rest))
        else:
            here.entry = rule

    @staticmethod
    def _longest(node: PathNode, path: str) -> Entry | None:
        found = node.entry
        at = 0
        while True:
            if node.open_ends:
                fits = [n for n in node.lengths if path[at : at + n] in node.open_ends]
                found = node.open_ends[path[at : at + max(fits)]] if fits else found
            end = path.find("/", at) + 1
            if not end or (node := node.children.get(path[at:end])) is None:  # type: ignore[assignment]
                return found
            found, at = node.entry or found, end

    def find(self, host: str, path: str) -> Entry | None:
        node, found = self.root, None
        for label in reversed(host.split(".")):
            node = node.children.get(label)  # type: ignore[assignment]
            if node is None:
                break
            if node.paths and (entry := self._longest(node.paths, path)):
                found = entry
        return found


def _fields(df: DataFrame, id_col: str) -> T.StructType:
    return T.StructType(
        [df.select(id_col).schema[0], *(T.StructField(name, T.StringType()) for name in ("host", "path", "rule", "verdict"))]
    )


def judge(
    df: DataFrame,
    rules: tuple[Entry, ...] | list[Entry] = RULES,
    id_col: str = "page_id",
    url_col: str = "url",
    default: str = DEFAULT,
    max_bytes: int = MAX_BYTES,
) -> DataFrame:
    """id, host, path, rule (host and path of the entry that decided, else null) and verdict for every row."""
    schema = _fields(df, id_col)
    empty = F.lit(None).cast("string")
    rows = df.select(F.col(id_col), F.col(url_col).alias("u_url"), empty.alias("host"), empty.alias("path"), empty.alias("u_host"), empty.alias("u_path"), empty.alias("verdict"))
    before = None
    for trie in tries(rules, max_bytes):
        if before is not None:  # the last pass has to be done before its trie can go
            rows = cut(rows)
            before.unpersist()
        before = df.sparkSession.sparkContext.broadcast(trie)
        rows = _walked(rows, before)
    rule = F.when(F.col("u_host").isNotNull(), F.concat("u_host", "u_path"))
    return rows.select(F.col(schema.names[0]), "host", "path", rule.alias("rule"), F.coalesce("verdict", F.lit(default)).alias("verdict"))


def _walked(rows: DataFrame, trie: Broadcast) -> DataFrame:
    """Rows with their parts and the longer of their match so far and this trie's."""
    names = rows.schema.names

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tree = trie.value
        for batch in batches:
            split = [parts(url) for url in batch.column(1).to_pylist()]
            best = list(zip(*(batch.column(k).to_pylist() for k in (4, 5, 6)), strict=True))
            for i, (host, path) in enumerate(split):
                entry, old = tree.find(host, path), best[i]
                if entry and (old[0] is None or (len(entry.host), len(entry.path)) > (len(old[0]), len(old[1]))):
                    best[i] = (entry.host, entry.path, entry.verdict)
            columns = [[h for h, _ in split], [p for _, p in split], *([b[k] for b in best] for k in range(3))]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *[pa.array(c, pa.string()) for c in columns]], names=names)

    return rows.mapInArrow(run, rows.schema)


def query(pages: DataFrame) -> DataFrame:
    """op3: the verdict for every page's URL."""
    return judge(pages)


SQL = r"""
WITH parts AS (
  SELECT row_number() OVER () AS k, page_id,
         CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest
  FROM pages
), hosts AS (
  SELECT k, page_id,
         translate(regexp_extract(rest, '(?s)^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(rest, '(?s)^[^/?#]*([^?#]*)', 1) AS path
  FROM parts
), rules(verdict, r_host, r_path) AS (
  VALUES %s
), fits AS (
  SELECT k, r_host || r_path AS rule, verdict,
         row_number() OVER (PARTITION BY k ORDER BY length(r_host) DESC, length(r_path) DESC) AS n
  FROM hosts JOIN rules ON (host = r_host OR ends_with(host, '.' || r_host)) AND starts_with(path, r_path)
)
SELECT page_id, host, path, rule, coalesce(verdict, '%s') AS verdict
FROM hosts LEFT JOIN (SELECT * FROM fits WHERE n = 1) USING (k)
""" % (", ".join(f"('{r.verdict}', '{r.host}', '{r.path}')" for r in RULES), DEFAULT)
