"""Nulls, empty and very long texts, repeated rows, empty tables and extra columns, for every operator and stage."""

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from slate.llm import chat, decontam, htmltext, licenses, pieces, quality, sharding, simhash, tokenfiles, urlfilter
from slate.session import scratch, small_batches

LONG = " ".join(f"w{i % 5000} x{i}" for i in range(60_000))
ROWS = [
    (1, None, None),
    (2, "", "en"),
    (3, LONG, "en"),
    (4, "same text here for both of the rows that say it again", "en"),
    (4, "same text here for both of the rows that say it again", "en"),
    (None, "a text without an id, with some words in it, and some more", None),
    (7, "same text here for both of the rows that say it again", None),
    (8, "\n \t", "en"),
]
SCHEMA = "doc_id long, text string, lang string"
EXTRA = ["kept", "fp", "n_words", "failed", "q_id", "d_text", "n_row", "shard"]


@pytest.fixture(scope="module")
def docs(spark):
    small_batches(spark, 64)
    return spark.createDataFrame(ROWS, SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def crowded(docs):
    return docs.select("*", *[F.lit(i).alias(name) for i, name in enumerate(EXTRA)])


BENCH = [(1, "same text here for both of the rows that say it"), (2, None), (3, ""), (None, "w0 x0 w1 x1 w2 x2 w3 x3 w4 x4")]


def bench(spark, rows=BENCH):
    return spark.createDataFrame(rows, "item_id long, text string")


PER_ROW = {
    "simhash": simhash.query,
    "sharding": sharding.query,
    "quality": quality.query,
    "licenses": licenses.query,
    "pieces": pieces.query,
    "tokenfiles": tokenfiles.query,
    "decontam": lambda d: decontam.query(d, bench(d.sparkSession)),
}


@pytest.mark.parametrize("name", PER_ROW)
def test_one_row_per_row_whatever_it_holds(name, docs, crowded, none):
    assert PER_ROW[name](docs).count() == len(ROWS)
    assert PER_ROW[name](none).count() == 0
    a, b = (sorted(map(repr, PER_ROW[name](d).drop("shard", "slot", "text_group").collect())) for d in (docs, crowded))
    assert a == b


def test_simhash_of_null_empty_and_repeated_rows(docs):
    rows = simhash.query(docs).collect()
    by = {}
    for r in rows:
        by.setdefault(r.doc_id, []).append((r.fingerprint, r.component_id))
    assert by[1] == by[2] == by[8] == [("0" * 16, 1)]
    assert by[4][0] == by[4][1] == by[7][0] and by[7][0][1] == 4


def test_quality_of_null_is_rejected(docs):
    rows = {r.doc_id: r for r in quality.query(docs).collect() if r.doc_id in (1, 2, 3, 8)}
    assert all(not rows[k].kept and rows[k].n_words == 0 for k in (1, 2, 8)) and rows[3].n_words == 120_000


def test_contamination_of_named_and_nameless_items(docs):
    rows = {r.doc_id: r for r in decontam.query(docs, bench(docs.sparkSession)).collect()}
    assert rows[4].contaminated and rows[4].n_items == 1 and rows[4].n_hit == 11
    assert rows[3].contaminated and rows[3].n_items == 0
    assert not rows[1].contaminated and rows[1].n_words == 0
    assert decontam.query(docs, bench(docs.sparkSession, [])).where("contaminated").count() == 0


@pytest.mark.parametrize("remove", ["documents", "spans"])
def test_clean_keeps_columns(crowded, remove):
    out = decontam.clean(crowded, bench(crowded.sparkSession), remove)
    assert out.columns == crowded.columns
    kept = {r.doc_id: r.text for r in out.collect()}
    assert kept[None] == ROWS[5][1]
    assert (4 in kept) == (remove == "spans")
    if remove == "spans":
        assert kept[4] == " again"


def test_token_files_of_empty_and_sorted(docs, spark):
    path = scratch(spark, "t")
    tokenfiles.write(docs, path)
    rows = tokenfiles.read(spark, path).orderBy("start").collect()
    assert [r.doc_id for r in rows] == [None, 1, 2, 3, 4, 4, 7, 8]
    assert rows[1].ids == rows[2].ids == tokenfiles.np.array([1], "<u4").tobytes()


@pytest.mark.parametrize("name", [name for name, _ in corpus_pipeline.STAGES])
def test_stages_take_anything(name, spark, crowded, none, tmp_path):
    stage = dict(corpus_pipeline.STAGES)[name]
    bench(spark).write.parquet(f"{tmp_path}/benchmark.parquet")
    out = stage(spark, crowded, str(tmp_path))
    if name != corpus_pipeline.STAGES[-1][0]:
        assert out.columns == crowded.columns
        assert stage(spark, none, str(tmp_path)).columns == none.columns
    assert out.count() <= len(ROWS)
    assert stage(spark, none, str(tmp_path)).count() == 0


def test_dedup_stage_keeps_one_of_each_group(crowded):
    kept = sorted((r.doc_id or 0, r.text or "") for r in simhash.deduplicated(crowded).collect())
    assert [k for k, _ in kept] == [0, 1, 3, 4]


def test_urls(spark):
    pages = spark.createDataFrame(
        [(1, None), (2, ""), (3, "no scheme.net/x"), (4, "HTTP://A.B.NET/x?y"), (5, "http://example.net/en/1"), (6, "http://net"), (7, "http://net/"), (8, "s://q.org/fr/a#b"), (9, "http://a.example.com/de/"), (9, "http://badexample.com/de/"), (10, "://")],
        "page_id long, url string",
    )
    got = [(r.page_id, r.host, r.path, r.rule, r.verdict) for r in urlfilter.judge(pages.repartition(1)).collect()]
    assert got == [
        (1, "", "", None, "allow"), (2, "", "", None, "allow"), (3, "", "", None, "allow"), (4, "a.b.net", "/x", "net/", "block"), (5, "example.net", "/en/1", "example.net/en/", "allow"), (6, "net", "", None, "allow"),
        (7, "net", "/", "net/", "block"), (8, "q.org", "/fr/a", "org/fr/", "allow"), (9, "a.example.com", "/de/", "example.com/de/", "block"), (9, "badexample.com", "/de/", None, "allow"), (10, "", "", None, "allow"),
    ]
    joined = urlfilter.judge(pages, max_bytes=0)
    assert sorted(map(repr, joined.collect())) == sorted(map(repr, urlfilter.judge(pages).collect()))
    assert urlfilter.judge(spark.createDataFrame([], "page_id long, url string")).count() == 0


def test_url_precedence_and_prefixes_inside_segments():
    trie = urlfilter.Trie([urlfilter.Entry("block", "a.com", "/x"), urlfilter.Entry("allow", "a.com", "/xy/z"), urlfilter.Entry("allow", "a.com", "/x")])
    assert trie.find("b.a.com", "/xq").verdict == "block" and trie.find("a.com", "/xy/zz").verdict == "allow" and trie.find("a.com", "/w") is None


def test_conversations(spark):
    rows = [(1, 1, "assistant", "b"), (1, 0, "user", None), (1, 1, "assistant", "b"), (2, None, None, "\\[INST]\\\\<|end|> \\"), (2, 5, "assistant", "</s><s>[/INST]\n"), (None, 0, "user", "x")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("prompt", F.lit("clash"))
    made = chat.formatted(chat.canonical(chat.from_rows(df)))
    for control in chat.CONTROL:
        body = made.select(F.replace(F.replace(F.replace("formatted", F.lit(chat.TURN), F.lit("")), F.lit(chat.TEXT), F.lit("")), F.lit(chat.END), F.lit("")).alias("f"))
        assert body.where(F.contains("f", F.lit(control))).count() == 0
    back = {r.conv_id: r for r in chat.read_back(made).collect()}
    assert [(t.role, t.text) for t in back[1].turns] == [("user", ""), ("assistant", "b"), ("assistant", "b")] and back[1].masked == "bb"
    assert [(t.role, t.text) for t in back[2].turns] == [("", "\\[INST]\\\\<|end|> \\"), ("assistant", "</s><s>[/INST]\n")] and back[2].masked == "</s><s>[/INST]\n"
    assert chat.query(spark.createDataFrame([], "conv_id long, turn long, role string, text string")).count() == 1


def test_layouts_by_fingerprint(spark):
    schema = f"conv_id long, {chat.RECORD}"
    rows = [
        (1, "p", "c", None, None, None, None),
        (2, None, None, "i", "in", "o", None),
        (3, None, None, "i", None, "o", None),
        (4, None, None, None, None, None, [("user", "a"), (None, "b")]),
        (5, "p", None, None, None, None, None),
        (6, None, None, None, None, None, []),
        (7, "p", "c", "i", None, None, None),
    ]
    got = {r.conv_id: (r.layout, [(t.role, t.text) for t in r.turns]) for r in chat.canonical(spark.createDataFrame(rows, schema)).collect()}
    assert got[1] == ("prompt", [("user", "p"), ("assistant", "c")])
    assert got[2] == ("instruction", [("user", "i\nin"), ("assistant", "o")]) and got[3][1] == [("user", "i"), ("assistant", "o")]
    assert got[4] == ("messages", [("user", "a"), ("", "b")])
    assert got[5] == ("unknown", [])
    assert got[7] == ("prompt", [("user", "p"), ("assistant", "c")])  # another layout's field changes nothing
    assert got[6] == ("messages", [])


def test_pages(spark):
    pages = spark.createDataFrame([(1, "u", None), (2, None, ""), (3, "u", "<article><h1>A &amp; b</h1><p>One  two<br>three<p>Four &nbsp;five."), (3, "u", "<article><h1>A &amp; b</h1><p>One  two<br>three<p>Four &nbsp;five.")], "page_id long, url string, html string")
    rows = [(r.page_id, r.text, r.n_chars) for r in htmltext.query(pages.withColumn("text", F.lit("clash"))).orderBy("page_id").collect()]
    assert rows[:2] == [(1, "", 0), (2, "", 0)] and rows[2] == rows[3] == (3, "A & b\nOne two three\nFour five.", 30)
    assert htmltext.query(pages.limit(0)).count() == 0
