"""Quality rules as a bitmask ledger, with DataFrame functions only.

Every rule is evaluated once per text. ``ledger`` stores the measurements and, in ``failed``, one bit per
failed rule. Policies are named bit masks over that ledger: applying another policy, or asking what a policy
would keep without one of its rules, needs no second look at the texts.

Cases: a null text counts as empty (no words, so the rule ``few_words`` fails); rows are judged one by one, so
repeated rows and ids give repeated results and a null id stays null; an empty table gives an empty table. Extra
columns of the input are not read: only the id and text columns are. Texts are never cut. Windows are compared by
64-bit hashes of their five words.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SPACE = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]"
WINDOW = 5


@dataclass(frozen=True)
class Rule:
    """``failed`` is SQL over the measurements, in whole numbers so that any engine agrees."""

    name: str
    bit: int
    failed: str


RULES = (
    Rule("few_words", 0, "n_words < 10"),
    Rule("repeated_windows", 1, "100 * n_repeat_words > 20 * n_words"),
    Rule("symbols", 2, "10 * n_symbols > n_words"),
    Rule("repeated_lines", 3, "2 * n_dup_lines > n_lines"),
    Rule("capitals", 4, "2 * n_capitals > word_chars"),
    Rule("word_length", 5, "word_chars < 2 * n_words OR word_chars > 20 * n_words"),
)
BASE = ("few_words", "repeated_windows")
#: Policy versions: the rules whose failure rejects a text.
POLICIES = {
    "base-1": BASE,
    "full-1": tuple(rule.name for rule in RULES),
}
PRODUCTION = "full-1"


def mask(names: tuple[str, ...]) -> int:
    bits = {rule.name: rule.bit for rule in RULES}
    return sum(1 << bits[name] for name in names)


def _repeats(hashes: Column) -> Column:
    """From window hashes in text order: sorted (hash, place) pairs, only for texts where a hash recurs."""
    pairs = F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    return F.when(F.size(F.array_distinct(hashes)) < F.size(hashes), pairs)


def measurements(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: the id and every measurement that the rules use."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    split = df.select(
        F.col(id_col).alias("q_id"),
        text.alias("q_text"),
        F.array_remove(F.split(text, SPACE), "").alias("q_words"),
        F.filter(F.split(text, "\n"), lambda line: line.rlike(WORD)).alias("q_lines"),
    )
    words = F.col("q_words")
    windows = F.transform(
        F.slice(words, F.lit(1), F.greatest(F.size(words) - (WINDOW - 1), F.lit(0))),
        lambda first, i: F.xxhash64(first, *[F.get(words, i + k) for k in range(1, WINDOW)]),
    )
    hashed = split.select(
        "q_id",
        F.size("q_words").cast("long").alias("n_words"),
        F.length(F.regexp_replace("q_text", SPACE, "")).cast("long").alias("word_chars"),
        F.length(F.regexp_replace("q_text", r"[^#*$%&|<>]+", "")).cast("long").alias("n_symbols"),
        F.length(F.regexp_replace("q_text", r"[^A-Z]+", "")).cast("long").alias("n_capitals"),
        F.size("q_lines").cast("long").alias("n_lines"),
        (F.size("q_lines") - F.size(F.array_distinct("q_lines"))).cast("long").alias("n_dup_lines"),
        windows.alias("q_windows"),
    )
    kept = [c for c in hashed.columns if c != "q_windows"]
    paired = hashed.select(*kept, _repeats(F.col("q_windows")).alias("q_pairs"))
    pairs = F.col("q_pairs")
    again = F.filter(
        pairs,
        lambda x, k: (x["h"] == F.get(pairs, k - 1)["h"]).eqNullSafe(F.lit(True))
        | (x["h"] == F.get(pairs, k + 1)["h"]).eqNullSafe(F.lit(True)),
    )
    placed = paired.select(*kept, F.sort_array(F.transform(again, lambda x: x["i"])).alias("q_places"))
    places = F.col("q_places")
    steps = F.transform(places, lambda p, k: F.least(F.lit(WINDOW), F.coalesce(F.get(places, k + 1) - p, F.lit(WINDOW))))
    covered = F.aggregate(steps, F.lit(0).cast("long"), lambda total, step: total + step)
    measured = F.struct(*kept, F.coalesce(covered, F.lit(0).cast("long")).alias("n_repeat_words"))
    # one row out of a list of one: keeps later filters from being pushed below, where each rule would measure again
    return placed.select(F.inline(F.array(measured)))


def ledger(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Measurements plus ``failed``: bit k is set if the rule with bit k failed."""
    bits = F.lit(0).cast("long")
    for rule in RULES:
        bits = bits + F.when(F.expr(rule.failed), F.lit(1 << rule.bit)).otherwise(F.lit(0)).cast("long")
    measured = measurements(df, id_col, text_col)
    return measured.select(F.col("q_id").alias(id_col), *measured.columns[1:], bits.alias("failed"))


def passes(policy: str = PRODUCTION) -> Column:
    """Whether a ledger row passes the policy."""
    return F.col("failed").bitwiseAND(F.lit(mask(POLICIES[policy]))) == 0


def ablations(ledger_rows: DataFrame, policy: str = PRODUCTION) -> DataFrame:
    """Per rule of a policy: rows that fail it, rows that only it rejects, and rows kept without it.

    The ledger is first counted by its bit patterns (at most 2 ** rules of them), before anything is shuffled.
    """
    whole = mask(POLICIES[policy])
    patterns = ledger_rows.groupBy(F.col("failed").bitwiseAND(F.lit(whole)).alias("bits")).agg(F.count("*").alias("n"))
    rules = F.array(*[F.struct(F.lit(r.name).alias("rule"), F.lit(1 << r.bit).cast("long").alias("bit")) for r in RULES if r.name in POLICIES[policy]])
    rows = patterns.select("bits", "n", F.inline(rules))
    rest = F.col("bits").bitwiseAND(F.bitwise_not(F.col("bit")))
    return rows.groupBy("rule").agg(
        F.sum(F.when(F.col("bits").bitwiseAND(F.col("bit")) != 0, F.col("n")).otherwise(0)).alias("n_failed"),
        F.sum(F.when(F.col("bits") == F.col("bit"), F.col("n")).otherwise(0)).alias("n_only"),
        F.sum(F.when(rest == 0, F.col("n")).otherwise(0)).alias("n_kept_without"),
        F.bit_or("bits").alias("seen_bits"),
    )


def accepted(df: DataFrame, policy: str = PRODUCTION, text_col: str = "text") -> DataFrame:
    """The input rows that pass the policy, with the input's columns.

    The text and all other columns travel as one struct beside the measurements, so extra columns may have any name.
    """
    carried = df.select(F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("q_row"))
    judged = ledger(carried.select("q_row", F.col(f"q_row.`{text_col}`").alias("q_body")), "q_row", "q_body")
    return judged.where(passes(policy)).select("q_row.*")


SQL = r"""
WITH base AS (
  SELECT row_number() OVER () AS k, doc_id, coalesce(text, '') AS body FROM documents
), parts AS (
  SELECT k, doc_id, body,
         regexp_extract_all(body, '[^\x20\x09-\x0D]+') AS w,
         list_filter(string_split(body, chr(10)), lambda l: regexp_matches(l, '[^\x20\x09-\x0D]')) AS l
  FROM base
), places AS (
  SELECT k, w, unnest(range(1, len(w) - 3)) AS i FROM parts
), windows AS (
  SELECT k, i, count(*) OVER (PARTITION BY k, w[i], w[i + 1], w[i + 2], w[i + 3], w[i + 4]) AS c FROM places
), hit AS (
  SELECT k, count(DISTINCT i + d) AS n FROM windows, unnest(range(0, 5)) AS t(d) WHERE c > 1 GROUP BY k
), measured AS (
  SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words,
         CAST(length(regexp_replace(body, '[\x20\x09-\x0D]+', '', 'g')) AS BIGINT) AS word_chars,
         CAST(length(regexp_replace(body, '[^#*$%%&|<>]+', '', 'g')) AS BIGINT) AS n_symbols,
         CAST(length(regexp_replace(body, '[^A-Z]+', '', 'g')) AS BIGINT) AS n_capitals,
         CAST(len(l) AS BIGINT) AS n_lines,
         CAST(len(l) - len(list_distinct(l)) AS BIGINT) AS n_dup_lines,
         CAST(coalesce(hit.n, 0) AS BIGINT) AS n_repeat_words
  FROM parts LEFT JOIN hit USING (k)
), judged AS (
  SELECT *, CAST(%s AS BIGINT) AS failed FROM measured
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
       (failed & %d) <> 0 AS base_failed, (failed & %d) = 0 AS kept, n_lines, n_capitals, failed
FROM judged
""" % (
    " + ".join(f"(CASE WHEN {rule.failed} THEN {1 << rule.bit} ELSE 0 END)" for rule in RULES),
    mask(BASE),
    mask(BASE) | mask(POLICIES[PRODUCTION]),
)


def query(documents: DataFrame) -> DataFrame:
    """op4: every document's measurements, the base verdict and the production policy's verdict."""
    base_failed = F.col("failed").bitwiseAND(F.lit(mask(BASE))) != 0
    return ledger(documents).select(
        "doc_id",
        "n_words",
        "word_chars",
        "n_symbols",
        "n_dup_lines",
        "n_repeat_words",
        base_failed.alias("base_failed"),
        (~base_failed & passes()).alias("kept"),
        "n_lines",
        "n_capitals",
        "failed",
    )
