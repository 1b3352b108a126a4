"""Chat formatting by schema fingerprints, with DataFrame functions only.

Records arrive in different layouts: lists of messages, a prompt with its completion, an instruction with an optional input,
a question with its answer, flat or nested. A ``Mapping`` names the field paths of one layout and says which of them become which turns. For
every mapping ``canonical`` lists those of its own paths that a record fills and hashes the sorted list (XXH64); the first
mapping whose accepted fingerprints hold this hash is selected. Fields that a mapping does not name take no part in
its fingerprint, so further columns, whatever their names are, change nothing. ``formatted`` writes the turns with a template,
together with the runs of a loss mask, and ``read_back`` recovers the turns and the masked text from the formatted
text and the mask alone.

Paths: ``a.b`` goes into a struct, ``a[]`` into every element of a list. A path that the schema lacks, or that ends at something
other than a plain value (or a list, for ``a[]``), is filled nowhere.

The template marks a turn as ``<|turn|>`` role ``<|text|>`` text ``<|end|>``. Roles and texts are escaped: a
backslash is doubled, and a backslash is put behind the first character of every control string, so no control
string of this or the common instruction templates is left; unescaping drops one backslash of each group.

Cases: null roles and texts count as empty; a record that no mapping accepts keeps its row, with the
layout ``unknown`` and no turns; a record with an empty message list has the layout ``messages`` and no turns; where a record fills the
fields of several layouts the first in the order of the mappings holds;
rows of one conversation are ordered by turn, then role and text, so ties and repeated rows have a fixed order and
all stay; rows without a conversation id are one conversation, as SQL groups them; an empty table gives an empty table. Texts are never
cut. One conversation becomes one record, whatever its length: its digest needs its whole text. All work on a record is linear in it.
"""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass
from functools import reduce
from itertools import combinations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

TURN, TEXT, END = "<|turn|>", "<|text|>", "<|end|>"
#: Strings that a template or a tokenizer gives a meaning of their own.
CONTROL = (TURN, TEXT, END, "<|im_start|>", "<|im_end|>", "<|endoftext|>", "<|startoftext|>", "<s>", "</s>", "<unk>", "<pad>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>")
LEARNED = ("assistant",)

TURNS = "array<struct<role:string,text:string>>"
RECORD = f"prompt string, completion string, instruction string, input string, output string, messages {TURNS}"


@dataclass(frozen=True)
class Each:
    """A list of turns: where it is, and the paths of an element that hold its role and its text (the first filled one)."""

    items: str
    role: str
    text: tuple[str, ...]
    #: Role names of the layout, and the names used here.
    roles: tuple[tuple[str, str], ...] = ()


@dataclass(frozen=True)
class Mapping:
    """``required`` and ``optional`` field paths, and how turns are made.

    Each of ``turns`` is a list of turns, or a fixed role with the paths whose values make its text, joined by line ends; a turn none of whose
    paths is filled is left out.
    """

    layout: str
    required: tuple[str, ...]
    turns: tuple[Each | tuple[str, tuple[str, ...]], ...]
    optional: tuple[str, ...] = ()


SPEAKERS = (("human", "user"), ("gpt", "assistant"), ("bot", "assistant"), ("model", "assistant"))
CONTENT = ("content", "content[].text", "text")


def _said(layout: str, asked: str, answer: str, *inputs: str) -> Mapping:
    """One question and one answer, with an optional system text and optional inputs below the question."""
    return Mapping(layout, (asked, answer), (("system", ("system",)), ("user", (asked, *inputs)), ("assistant", (answer,))), ("system", *inputs))


MAPPINGS = (
    Mapping("messages", ("messages[]",), (Each("messages[]", "role", CONTENT),), ("messages[].role", *[f"messages[].{c}" for c in CONTENT])),
    Mapping("conversations", ("conversations[]",), (("system", ("system",)), Each("conversations[]", "from", ("value",), SPEAKERS)), ("system", "conversations[].from", "conversations[].value")),
    Mapping("message lists", ("prompt[].content", "completion[].content"), (Each("prompt[]", "role", ("content",)), Each("completion[]", "role", ("content",))), ("prompt[].role", "completion[].role")),
    Mapping("preference lists", ("prompt[].content", "chosen[].content"), (Each("prompt[]", "role", ("content",)), Each("chosen[]", "role", ("content",))), ("prompt[].role", "chosen[].role")),
    _said("prompt", "prompt", "completion"),
    _said("prompt and response", "prompt", "response"),
    _said("nested prompt", "prompt.text", "response.text"),
    _said("request", "request.prompt", "response.text"),
    _said("instruction", "instruction", "output", "input"),
    _said("instruction and response", "instruction", "response", "context"),
    _said("question", "question", "answer", "context"),
    _said("preference", "prompt", "chosen"),
)


def _steps(path: str) -> list[str]:
    return path.replace("[]", ".[]").split(".")


def _below(kind: T.DataType, step: str) -> T.DataType | None:
    if step == "[]":
        return kind.elementType if isinstance(kind, T.ArrayType) else None
    return kind[step].dataType if isinstance(kind, T.StructType) and step in kind.names else None


def _plain(kind: T.DataType) -> bool:
    return not isinstance(kind, (T.ArrayType, T.StructType, T.MapType))


def _filled(at: Column, kind: T.DataType, steps: list[str]) -> Column | None:
    """Whether a path holds something: a plain value that is not null, or, at ``[]``, a list that is not null."""
    if not steps:
        return at.isNotNull() if _plain(kind) else None
    if (below := _below(kind, steps[0])) is None:
        return None
    if steps == ["[]"]:
        return at.isNotNull() if isinstance(below, T.StructType) else None
    if steps[0] != "[]":
        return _filled(at.getField(steps[0]), below, steps[1:])
    if _filled(at, below, steps[1:]) is None:
        return None
    return F.coalesce(F.exists(at, lambda x: _filled(x, below, steps[1:])), F.lit(False))


def _value(at: Column, kind: T.DataType, steps: list[str]) -> Column | None:
    """The text at a path, null if there is none; texts of a list are joined by line ends."""
    if not steps:
        return at.cast("string") if _plain(kind) else None
    if (below := _below(kind, steps[0])) is None:
        return None
    if steps[0] != "[]":
        return _value(at.getField(steps[0]), below, steps[1:])
    return None if _value(at, below, steps[1:]) is None else F.array_join(F.transform(at, lambda x: _value(x, below, steps[1:])), "\n")


def _first(options: Iterable[Column | None]) -> Column:
    return F.coalesce(*[c for c in options if c is not None], F.lit(None).cast("string"))


def _said_in(part: Each | tuple[str, tuple[str, ...]], record: Column, schema: T.StructType) -> Column:
    """The turns that one part of a mapping makes."""
    if isinstance(part, Each):
        *above, _ = _steps(part.items)
        at, kind = record, schema
        for step in above:
            at, kind = at.getField(step), _below(kind, step)
        element = kind.elementType

        def turn(x: Column) -> Column:
            role = _first([_value(x, element, _steps(part.role))])
            named = reduce(lambda other, pair: F.when(role == pair[0], F.lit(pair[1])).otherwise(other), part.roles, role)
            return F.struct(F.coalesce(named, F.lit("")).alias("role"), F.coalesce(_first(_value(x, element, _steps(t)) for t in part.text), F.lit("")).alias("text"))

        return F.transform(at, turn)
    role, paths = part
    values = [v for p in paths if (v := _value(record, schema, _steps(p))) is not None]
    if not values:
        return F.array().cast(TURNS)
    one = F.array(F.struct(F.lit(role).alias("role"), F.concat_ws("\n", *values).alias("text"))).cast(TURNS)
    return F.when(F.coalesce(*values).isNotNull(), one).otherwise(F.array().cast(TURNS))


def fingerprint(mapping: Mapping, record: Column, schema: T.StructType) -> Column:
    """XXH64 of the filled ones among a mapping's paths, sorted and joined by line ends."""
    paths = sorted({*mapping.required, *mapping.optional})
    tests = [(p, _filled(record, schema, _steps(p))) for p in paths]
    return F.xxhash64(F.concat_ws("\n", F.lit(None).cast("string"), *[F.when(test, F.lit(p)) for p, test in tests if test is not None]))


def accepted(mapping: Mapping) -> list[Column]:
    """The fingerprints of a layout: its required paths, with any of the optional ones. Spark folds them to constants."""
    extras = [x for n in range(len(mapping.optional) + 1) for x in combinations(mapping.optional, n)]
    return [F.xxhash64(F.lit("\n".join(sorted({*mapping.required, *extra})))) for extra in extras]


def canonical(records: DataFrame, id_col: str = "conv_id", mappings: tuple[Mapping, ...] = MAPPINGS) -> DataFrame:
    """id, layout and canonical turns of every record. Only the fields that the mappings name are read."""
    roots = {_steps(p)[0] for m in mappings for p in (*m.required, *m.optional)}
    schema = T.StructType([f for f in records.schema.fields if f.name != id_col and f.name in roots])
    held = records.select(F.col(f"`{id_col}`").alias("c_id"), F.struct(F.lit(0).alias("c_none"), *[F.col(f"`{f.name}`") for f in schema.fields]).alias("c_record"))
    record = F.col("c_record")
    usable = [m for m in mappings if all(_filled(record, schema, _steps(p)) is not None for p in m.required)]
    layout, turns = F.lit("unknown"), F.array().cast(TURNS)
    prints = [fingerprint(m, record, schema).alias(f"c_print_{i}") for i, m in enumerate(usable)]
    for i, mapping in reversed(list(enumerate(usable))):
        chosen = F.col(f"c_print_{i}").isin(*accepted(mapping))
        made = [_said_in(part, record, schema).cast(TURNS) for part in mapping.turns]
        layout = F.when(chosen, F.lit(mapping.layout)).otherwise(layout)
        turns = F.when(chosen, made[0] if len(made) == 1 else F.concat(*made)).otherwise(turns)
    return held.select("*", *prints).select(F.col("c_id").alias(id_col), layout.alias("layout"), turns.alias("turns"))


def from_rows(rows: DataFrame, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """Rows by turn, gathered into records of the layout ``messages``."""
    row = F.struct(F.col(turn_col).alias("turn"), F.col(role_col).alias("role"), F.coalesce(text_col, F.lit("")).alias("text"))
    listed = rows.groupBy(F.col(id_col)).agg(F.array_sort(F.collect_list(row)).alias("c_rows"))
    nothing = [F.lit(None).cast("string").alias(name) for name in ("prompt", "completion", "instruction", "input", "output")]
    return listed.select(id_col, *nothing, F.transform("c_rows", lambda x: F.struct(x["role"], x["text"])).cast(TURNS).alias("messages"))


_MARKED = "([<\\[])(?=" + "|".join("\\Q" + c[1:] + "\\E" for c in CONTROL) + ")"


def escaped(text: Column) -> Column:
    return F.regexp_replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), _MARKED, r"$1\\")


def unescaped(text: Column) -> Column:
    return F.regexp_replace(text, r"\\(\\?)", "$1")


def formatted(conversations: DataFrame, id_col: str = "conv_id", learned: tuple[str, ...] = LEARNED) -> DataFrame:
    """id, layout, the formatted text, and its loss mask ``loss`` as run lengths in code points.

    The mask has one entry a turn: so many code points that are not learned (``skip``), then so many that are
    (``keep``); what is left of the turn (``rest``) is not. The three sum up to the turn, so the entries cover the formatted text without a gap.
    """
    pieces = conversations.select(
        id_col,
        "layout",
        F.transform(
            "turns",
            lambda t: F.struct(
                F.concat(F.lit(TURN), escaped(t["role"]), F.lit(TEXT)).alias("head"),
                escaped(t["text"]).alias("body"),
                t["role"].isin(*learned).alias("learned"),
            ),
        ).alias("c_pieces"),
    )

    def runs(p: Column) -> Column:
        head, body = F.length(p["head"]), F.length(p["body"])
        return F.struct(
            F.when(p["learned"], head).otherwise(head + body + len(END)).alias("skip"),
            F.when(p["learned"], body).otherwise(0).alias("keep"),
            F.when(p["learned"], len(END)).otherwise(0).alias("rest"),
        )

    return pieces.select(
        id_col,
        "layout",
        F.array_join(F.transform("c_pieces", lambda p: F.concat(p["head"], p["body"], F.lit(END))), "").alias("formatted"),
        F.transform("c_pieces", runs).alias("loss"),
    )


def read_back(texts: DataFrame, id_col: str = "conv_id") -> DataFrame:
    """id, turns and masked text, from the formatted text and its mask."""
    held = texts.select(id_col, F.filter(F.split("formatted", r"\Q" + END + r"\E"), lambda p: p != "").alias("c_pieces"), "loss", F.length("formatted").cast("long").alias("formatted_chars"))
    turns = F.transform(
        F.transform("c_pieces", lambda p: F.split(p, r"\Q" + TEXT + r"\E", 2)),
        lambda p: F.struct(unescaped(F.substring(F.get(p, F.lit(0)), F.lit(len(TURN) + 1), F.length(F.get(p, F.lit(0))))).alias("role"), unescaped(F.get(p, F.lit(1))).alias("text")),
    )
    masked = F.array_join(F.zip_with("c_pieces", "loss", lambda p, run: unescaped(F.substring(p, run["skip"] + 1, run["keep"]))), "")
    return held.select(id_col, turns.alias("turns"), masked.alias("masked"), "formatted_chars")


#: The conversation that the query adds: both its turns say this.
ADDED_ID, ADDED_TEXT = -7, "</s>[INST] ok [/INST]"


def added(spark: SparkSession, id_type: str) -> DataFrame:
    """Conversation -7, in the layout ``prompt``."""
    one = spark.range(1).select(F.lit(ADDED_ID).cast(id_type).alias("conv_id"))
    absent = F.lit(None).cast("string")
    return one.select(
        "conv_id",
        F.lit(ADDED_TEXT).alias("prompt"),
        F.lit(ADDED_TEXT).alias("completion"),
        *[absent.alias(n) for n in ("instruction", "input", "output")],
        F.lit(None).cast(TURNS).alias("messages"),
    )


def query(conversations: DataFrame) -> DataFrame:
    """op10: every conversation and number -7, formatted and read back."""
    records = from_rows(conversations).unionByName(added(conversations.sparkSession, dict(conversations.dtypes)["conv_id"]))
    back = read_back(formatted(canonical(records)))
    said = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return back.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(said, 256).alias("turns_sha256"),
        F.length("masked").cast("long").alias("loss_chars"),
        F.sha2("masked", 256).alias("loss_sha256"),
        "formatted_chars",
    )


def _sql_escaped(column: str) -> str:
    """Replacements one after another do not meet: what one leaves is no control string of the others."""
    out = f"replace({column}, chr(92), chr(92) || chr(92))"
    for control in CONTROL:
        out = f"replace({out}, '{control}', '{control[0]}' || chr(92) || '{control[1:]}')"
    return out


SQL = r"""
WITH rows AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS body FROM conversations
  UNION ALL SELECT %d, 0, 'user', '%s'
  UNION ALL SELECT %d, 1, 'assistant', '%s'
)
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || body || chr(10), '' ORDER BY turn, role, body)) AS turns_sha256,
       CAST(coalesce(sum(length(body)) FILTER (WHERE role = 'assistant'), 0) AS BIGINT) AS loss_chars,
       sha256(coalesce(string_agg(body, '' ORDER BY turn, role, body) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
       CAST(sum(length(%s) + length(%s) + %d) AS BIGINT) AS formatted_chars
FROM rows GROUP BY conv_id
""" % (ADDED_ID, ADDED_TEXT, ADDED_ID, ADDED_TEXT, _sql_escaped("role"), _sql_escaped("body"), len(TURN + TEXT + END))
