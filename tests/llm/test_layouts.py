"""Records in the usual layouts, each with further columns that other layouts or this module use."""

import pytest
from pyspark.sql import functions as F

from slate.llm import chat

ASKED = [("user", "hello <s>"), ("assistant", "hi")]
MESSAGES = "messages array<struct<role:string,{}:string>>"
LAYOUTS = {
    "role and text": (MESSAGES.format("text"), (ASKED,), "messages", ASKED),
    "role and content": (MESSAGES.format("content"), (ASKED,), "messages", ASKED),
    "content parts": ("messages array<struct<role:string,content:array<struct<type:string,text:string>>>>", ([("user", [("text", "a"), ("image", None), ("text", "b")])],), "messages", [("user", "a\nb")]),
    "from and value": ("conversations array<struct<from:string,value:string>>, system string", ([("human", "q"), ("gpt", "a"), ("tool", None)], "be kind"), "conversations", [("system", "be kind"), ("user", "q"), ("assistant", "a"), ("tool", "")]),
    "system, prompt and response": ("system string, prompt string, response string", ("s", "p", "r"), "prompt and response", [("system", "s"), ("user", "p"), ("assistant", "r")]),
    "prompt and completion": ("prompt string, completion string", ("p", ""), "prompt", [("user", "p"), ("assistant", "")]),
    "nested prompt": ("prompt struct<text:string,lang:string>, response struct<text:string>", (("p", "en"), ("r",)), "nested prompt", [("user", "p"), ("assistant", "r")]),
    "request": ("request struct<prompt:string>, response struct<text:string>", (("p",), ("r",)), "request", [("user", "p"), ("assistant", "r")]),
    "instruction": ("instruction string, input string, output string", ("i", "in", "o"), "instruction", [("user", "i\nin"), ("assistant", "o")]),
    "instruction and response": ("instruction string, context string, response string", ("i", None, "o"), "instruction and response", [("user", "i"), ("assistant", "o")]),
    "question": ("question string, answer string", ("q", "a"), "question", [("user", "q"), ("assistant", "a")]),
    "message lists": ("prompt array<struct<role:string,content:string>>, completion array<struct<role:string,content:string>>", (ASKED[:1], ASKED[1:]), "message lists", ASKED),
}
CLASHES = ("source", "text", "layout", "turns", "c_id", "c_record", "c_print_0", "lang", "turn", "formatted", "loss")


@pytest.mark.parametrize("name", LAYOUTS)
def test_layout_with_clashing_columns(spark, name):
    fields, values, layout, turns = LAYOUTS[name]
    plain = spark.createDataFrame([(1, *values), (1, *values), (2, *[None] * len(values))], f"conv_id long, {fields}")
    crowded = plain.select("*", *[F.lit(f"clash {c}").alias(c) for c in CLASHES])
    for records in (plain, crowded):
        rows = chat.canonical(records).orderBy("conv_id").collect()
        assert [(r.layout, [(t.role, t.text) for t in r.turns]) for r in rows] == [(layout, turns)] * 2 + [("unknown", [])]
    assert chat.canonical(crowded.limit(0)).count() == 0
    back = chat.read_back(chat.formatted(chat.canonical(crowded))).where("conv_id = 1").first()
    assert [(t.role, t.text) for t in back.turns] == turns and back.masked == "".join(text for role, text in turns if role == "assistant")


def test_unusable_fields_are_filled_nowhere(spark):
    records = spark.createDataFrame([(1, "no list", {"a": "b"}, 5)], "conv_id long, messages string, conversations map<string,string>, prompt int")
    assert [(r.layout, r.turns) for r in chat.canonical(records).collect()] == [("unknown", [])]
    assert chat.canonical(records.withColumn("completion", F.lit(6))).first().turns[0].text == "5"


def test_mask_runs_cover_the_text_of_very_many_turns(spark):
    turns = [("user" if i % 2 else "assistant", f"<s>{i}" * (i % 7)) for i in range(20_000)]
    made = chat.formatted(chat.canonical(spark.createDataFrame([(1, turns)], f"conv_id long, {MESSAGES.format('content')}")))
    row, back = made.first(), chat.read_back(made).first()
    assert sum(run.skip + run.keep + run.rest for run in row.loss) == len(row.formatted) == back.formatted_chars
    assert [(t.role, t.text) for t in back.turns] == turns and back.masked == "".join(x for role, x in turns if role == "assistant")
    at, kept = 0, []
    for run in row.loss:
        kept.append(row.formatted[at + run.skip : at + run.skip + run.keep])
        at += run.skip + run.keep + run.rest
    assert "".join(kept).replace("\\", "") == back.masked
