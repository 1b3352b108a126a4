"""What is broadcast stays bounded, however many windows or rules there are, with the same results."""

import random
import string

from slate.llm import decontam, urlfilter
from tests.test_queries import SF


def test_many_sets_take_the_memory_of_one(spark, monkeypatch):
    docs, bench = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/benchmark.parquet")
    one = decontam.scan(docs, bench)
    live, most, made = set(), [0], [0]
    context = spark.sparkContext
    broadcast = type(context).broadcast

    def counted(self, value):
        held = broadcast(self, value)
        if isinstance(value, decontam.WindowSet):
            made[0] += 1
            live.add(held.id if hasattr(held, "id") else id(held))
            most[0] = max(most[0], len(live))
            release = held.unpersist

            def unpersist(blocking=False):
                live.clear()
                release(blocking)

            held.unpersist = unpersist
        return held

    monkeypatch.setattr(type(context), "broadcast", counted)
    many = decontam.scan(docs, bench, max_windows=60)
    assert made[0] >= 10 and most[0] == 1
    assert many._jdf.queryExecution().toString().count("MapInArrow") <= 8  # the merging of hits in four plans, and no chain of passes
    assert sorted(map(repr, many.collect())) == sorted(map(repr, one.collect()))


def test_spans_leave_in_rounds(spark):
    docs = spark.createDataFrame([(1, "a b c d X1 e f Y1 c d g"), (2, "x a b c d"), (3, None), (4, "c d c d"), (5, "begin c X1 e f Y1 d g end"), (6, "c X1 e f Y1 d g")], "doc_id long, text string")
    bench = spark.createDataFrame([(1, "X1 e f Y1"), (2, "c d g"), (3, "c d c d")], "item_id long, text string")
    rows = {r.doc_id: r.text for r in decontam.clean(docs, bench, "spans").collect()}
    assert rows == {1: "a b c d ", 5: "begin  end", 2: "x a b c d", 3: None}
    assert {r.doc_id: r.text for r in decontam.clean(docs, bench, "spans", max_windows=1).collect()} == rows


def plain(rules, host, path):
    fits = [r for r in urlfilter.settled_rules(rules) if (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path)]
    return max(fits, key=lambda r: (len(r.host), len(r.path)), default=None)


def test_tries_of_any_size_agree_with_a_plain_reading(spark):
    r = random.Random(8)
    word = lambda: "".join(r.choice("ab") for _ in range(r.randint(1, 2)))
    host = lambda: ".".join(word() for _ in range(r.randint(1, 3)))
    path = lambda: "/" + "/".join(word() for _ in range(r.randint(0, 3))) + r.choice(("", "/"))
    rules = [urlfilter.Entry(r.choice(("allow", "block")), host(), path()) for _ in range(300)]
    urls = [(i, f"http://{host()}{path()}{r.choice(('', '?q', '#f'))}") for i in range(400)] + [(400, None), (401, "http://" + "a." * 50_000 + "b/" + "a/" * 100_000), (402, "x" * 300_000)]
    pages = spark.createDataFrame(urls, "page_id long, url string")
    wanted = {}
    for i, url in urls:
        found = plain(rules, *urlfilter.parts(url))
        wanted[i] = (found and found.name, found.verdict if found else "allow")
    for limit in (urlfilter.MAX_BYTES, 150_000):
        assert {x.page_id: (x.rule, x.verdict) for x in urlfilter.judge(pages, rules, max_bytes=limit).collect()} == wanted
    assert 3 < len(list(urlfilter.tries(rules, 150_000))) < 12


def test_very_many_rules_at_one_place(spark):
    rules = [urlfilter.Entry("block", "a.com", f"/{c}{i}") for i in range(20_000) for c in string.ascii_lowercase[:3]]
    trie = urlfilter.Trie(rules)
    assert trie.find("x.a.com", "/b19999zz").name == "a.com/b19999" and trie.find("a.com", "/d1") is None
