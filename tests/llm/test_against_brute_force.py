"""The operators against plain versions of what they compute."""

import array
import collections
import hashlib
import html as markup
import math
import random
import re
import zlib

import duckdb
import numpy as np
import pytest
import public_tokenizers
import sentencepiece
import xxhash
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from slate.llm import decontam, htmltext, pieces, quality, queries, sharding, simhash, tokenfiles
from slate.session import scratch
from tests.test_queries import SF, duck, same  # noqa: F401

DOCS = f"{SF}/documents.parquet"


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(DOCS).select("doc_id", "text").orderBy("doc_id").collect()


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_matches_sql(spark, duck, name):  # noqa: F811
    same(queries.QUERIES[name](spark, SF), duck, queries.SQL[name])


def plain_fingerprint(text):
    words = [bytes(c + 32 if 65 <= c <= 90 else c for c in w.encode()) for w in re.findall(r"[^\x20\x09-\x0D]+", text or "")]
    shingles = [b" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_components(ids, fps):
    root = list(range(len(ids)))

    def find(x):
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for i in range(len(ids)):
        for j in np.flatnonzero(np.bitwise_count(fps[i] ^ fps[i + 1 :]) <= 3).tolist():
            root[find(i)] = find(i + 1 + j)
    least = {}
    for k, i in enumerate(ids):
        least[find(k)] = min(least.get(find(k), i), i)
    return {i: least[find(k)] for k, i in enumerate(ids)}


def test_simhash(spark, docs):
    rows = {r.doc_id: r for r in simhash.query(spark.read.parquet(DOCS)).collect()}
    fps = np.array([plain_fingerprint(d.text) for d in docs], np.uint64)
    ids = [d.doc_id for d in docs]
    wanted = plain_components(ids, fps)
    assert all(rows[i].fingerprint == f"{int(f):016x}" and rows[i].component_id == wanted[i] for i, f in zip(ids, fps, strict=True))


@pytest.mark.parametrize("block", [16, 4096])
def test_links_in_dense_and_crowded_buckets(spark, block):
    """Chains and clusters of fingerprints that share most keys, with blocks far smaller than the buckets."""
    r = random.Random(5)
    fps = set()
    for _ in range(6):
        at = r.getrandbits(64)
        for _ in range(120):
            fps.add(at)
            for bit in r.sample(range(64), r.randint(1, 3)):
                at ^= 1 << bit
        centre = r.getrandbits(64)
        for _ in range(120):
            fps.add(centre ^ sum(1 << b for b in r.sample(range(64), r.randint(1, 4))))
    own = sorted(fps)
    signed = [f - (1 << 64) if f >= 1 << 63 else f for f in own]
    found = simhash.components(simhash.links(spark.createDataFrame([(f,) for f in signed], "fp long"), block))
    roots = {row.node: row.root for row in found.collect()}
    assert {f: roots.get(f, f) for f in signed} == plain_components(signed, np.array(own, np.uint64))


def spreads(rows):
    """Spread of bytes, tokens and rows over shards, as shares of a shard, counted from the texts."""
    load = np.zeros((40, 3))
    for shard, text in rows:
        load[shard] += (len((text or "").encode()) + 16, len(re.findall(r"[^\x20\x09-\x0D]+", text or "")), 1)
    return (load.max(axis=0) - load.min(axis=0)) / load.mean(axis=0), load.mean(axis=0)


def test_shards_balance_and_slots_have_no_gaps(spark):
    table = spark.read.parquet(DOCS.replace("sf0.001", "sf0.01"))  # with five rows a shard nothing balances
    rows = sharding.query(table).collect()
    assert {r.shard for r in rows} == set(range(40)) and all(r.law == "bytes" and r.grown_shard is None for r in rows)
    slots = collections.defaultdict(list)
    for r in sorted(rows, key=lambda r: r.doc_id):
        slots[r.shard].append(r.slot)
    assert all(s == list(range(len(s))) for s in slots.values())
    texts = {r.doc_id: r.text for r in table.collect()}
    assert all(r.text_crc32 == zlib.crc32(texts[r.doc_id].encode()) and r["size"] == len(texts[r.doc_id].encode()) + 16 for r in rows)
    assert len(rows) == len(texts)
    (size, tokens, count), _ = spreads([(r.shard, texts[r.doc_id]) for r in rows])
    assert size < 0.005 and tokens < 0.08 and count <= 2 / 25
    held = collections.defaultdict(set)
    for r in rows:
        held[texts[r.doc_id]].add(r.shard)
    assert all(len(s) == 1 for s in held.values())  # no group here is as heavy as half a shard


def test_trades_widen_no_measure():
    r = np.random.default_rng(3)
    for n, shards in ((300, 7), (2000, 40), (40, 40), (5, 8), (1, 3), (0, 4)):
        vectors = np.stack([r.pareto(1.5, n) * 100 + 16, r.pareto(1.3, n) * 10, r.integers(1, 9, n)], axis=1).astype(float)
        placed = sharding.place(vectors, shards)
        traded = sharding.even(vectors, placed, shards)
        before, after = (np.stack([np.bincount(p, v, shards) for v in vectors.T]) for p in (placed, traded))
        assert (np.ptp(after, axis=1) <= np.ptp(before, axis=1) + 1e-9).all()
        assert after.sum(axis=1) == pytest.approx(vectors.sum(axis=0))


def test_placing_takes_the_highest_dot_product():
    """Unit by unit against a plain reading of the rule."""
    r = np.random.default_rng(4)
    vectors = r.pareto(1.5, (60, 3)) + 0.1
    shares = vectors / (vectors.sum(axis=0) / 6)
    room, wanted = [[1.0] * 3 for _ in range(6)], [0] * 60
    for unit in sorted(range(60), key=lambda u: -max(shares[u])):
        shard = max(range(6), key=lambda s: sum(a * b for a, b in zip(room[s], shares[unit], strict=True)))
        room[shard] = [a - b for a, b in zip(room[shard], shares[unit], strict=True)]
        wanted[unit] = shard
    assert sharding.place(vectors, 6).tolist() == wanted


def test_a_third_in_one_group_is_spread(spark):
    rows = [(i, "hot text of a third of all rows" if i % 3 == 0 else f"text number {i} " + "w " * (i % 40)) for i in range(6000)]
    out = sharding.pack(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)).groupBy("shard").agg(F.sum("size").alias("b"), F.count("*").alias("n")).collect()
    sizes, counts = [r.b for r in out], [r.n for r in out]
    assert len(out) == 40 and max(sizes) - min(sizes) < 0.01 * max(sizes) and max(counts) - min(counts) < 0.1 * max(counts)


def test_pieces(spark, docs):
    library = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path(pieces.MODEL))
    rows = {r.doc_id: r for r in pieces.query(spark.read.parquet(DOCS)).collect()}
    for d in docs:
        ids = library.encode(d.text, add_bos=True, add_eos=True)
        wanted = (len(ids), hashlib.sha256(array.array("I", ids).tobytes()).hexdigest(), hashlib.sha256(library.decode(ids).encode()).hexdigest(), True)
        assert (rows[d.doc_id].n_tokens, rows[d.doc_id].ids_sha256, rows[d.doc_id].decoded_sha256, rows[d.doc_id].agrees) == wanted


ODD = [*"aeinorst  \n\t▁.,'<>|[]/s", "é", "中", "́", "😀", "\x00", "ﬁ", "İ", "ß", "th", "ing", "    ", "http://", "</s>", "<s>", "'s", "…", "—", "<|endoftext|>", "don't", "'RE", "Σ", "23"]


def odd_texts(n, seed=3):
    r = random.Random(seed)
    return ["".join(r.choice(ODD) for _ in range(r.randint(0, 120))) for _ in range(n)]


def test_pieces_of_odd_and_long_texts():
    own = pieces.Vocabulary(open(public_tokenizers.path(pieces.MODEL), "rb").read())
    texts = [*odd_texts(1500), "a" * 50_000 + " b" * 5000]
    for text, ids, wanted in zip(texts, own.encode(texts), own.library.encode(texts, add_bos=True, add_eos=True), strict=True):
        assert ids == array.array("I", wanted).tobytes() and own.decode(ids) == own.library.decode(wanted), text[:200]
        for segment in own.segments.findall(text)[:5]:
            assert own.agenda(segment) == own.agendas([segment])[0]


def test_tokenizer_chunks_of_odd_texts():
    definition = open(public_tokenizers.path(tokenfiles.TOKENIZER)).read()
    own, library = tokenfiles.Encoder(definition), Tokenizer.from_str(definition)
    texts = odd_texts(1500, 4)
    for text, ids, wanted in zip(texts, own.encode([t.encode() for t in texts]), library.encode_batch(texts, add_special_tokens=False), strict=True):
        assert ids == array.array("I", wanted.ids).tobytes(), text


def test_token_files(spark, docs):
    library = Tokenizer.from_file(public_tokenizers.path(tokenfiles.TOKENIZER))
    path = scratch(spark, "ids")
    tokenfiles.write(spark.read.parquet(DOCS), path)
    rows = {r.doc_id: r for r in tokenfiles.read(spark, path).collect()}
    at, whole = 0, []
    for d in docs:
        ids = [*library.encode(d.text, add_special_tokens=False).ids, 1]
        assert (rows[d.doc_id].start, rows[d.doc_id].ids) == (at, array.array("I", ids).tobytes())
        at += len(ids)
        whole += ids
    for i in random.Random(1).sample(range(at), 60):
        assert tokenfiles.token(path, i) == whole[i]
    query = {r.doc_id: r for r in tokenfiles.query(spark.read.parquet(DOCS)).collect()}
    assert all(query[k].ids_crc32 == zlib.crc32(r.ids) and query[k].start == r.start for k, r in rows.items())


def test_codes_of_all_widths(monkeypatch):
    r = np.random.default_rng(2)
    ids = np.concatenate([r.integers(0, 1 << bits, 3000) for bits in (1, 8, 9, 16, 17, 24, 32)]).astype(np.uint32)
    r.shuffle(ids)
    data = tokenfiles.pack(ids)
    segment = tokenfiles.Segment(lambda offset, length: data[offset : offset + length])
    assert (segment.ids(0, len(ids)) == ids).all() and segment.stop == len(data)
    for a in r.integers(0, len(ids), 300).tolist():
        assert segment.ids(a, a + 1)[0] == ids[a] and (segment.ids(a, min(a + 700, len(ids))) == ids[a : a + 700]).all()


def test_pages_of_the_tables(spark):
    """These pages keep their text in one article element, so a plain reading of it is the expected text."""
    for r in htmltext.query(spark.read.parquet(f"{SF}/pages.parquet")).join(spark.read.parquet(f"{SF}/pages.parquet").select("page_id", "html"), "page_id").collect():
        inner = re.search(r"<article>(.*?)(</article>|<footer|$)", r.html, re.S)[1].replace("<b>", "").replace("</b>", "")
        blocks = [" ".join(markup.unescape(re.sub("<[^>]*>", " ", b)).split()) for b in re.split("</?(?:p|h1)>", inner)]
        assert r.text == "\n".join(b for b in blocks if b) and r.n_chars == len(r.text)


def test_extraction_on_held_out_layouts(spark):
    model = htmltext.fit(htmltext.labelled_pages(spark, 600))
    found = kept = wanted = 0
    for i in range(200):
        page, content = htmltext._Maker(900_001 + i).page()
        ours, theirs = collections.Counter(model.text(page).split("\n")), collections.Counter(content.split("\n"))
        found, kept, wanted = found + sum((ours & theirs).values()), kept + sum(ours.values()), wanted + sum(theirs.values())
    assert found / kept > 0.95 and found / wanted > 0.98


def test_messages_are_exact_marginals():
    """Sum-product against the sum over all states of a small page."""
    import itertools

    totals = collections.Counter()
    for i in range(40):
        totals.update(htmltext.counts(*htmltext._Maker(i).page()))
    model = htmltext.model_from(totals)
    page = htmltext.parse("<body><nav><ul><li>a b</ul></nav><article class=post><p>Some words, here.<p>x</article></body>")
    seen = htmltext.features(htmltext.parse("<body><nav><ul><li>a b</ul></nav><article class=post><p>Some words, here.<p>x</article></body>"))
    weights, total = [0.0] * len(page.nodes), 0.0
    for states in itertools.product(htmltext.STATES, repeat=len(page.nodes)):
        # the model holds logarithms
        w = model.root[states[0]]
        for i, s in enumerate(states):
            w += model._potential(seen[i])[s]
            if i:
                w += model.edge.get(seen[i][0], model.edge["tag"])[states[page.nodes[i].parent]][s]
        w = math.exp(w)
        total += w
        for i, s in enumerate(states):
            weights[i] += w * (s == htmltext.CONTENT)
    assert model.marginals(page) == pytest.approx([w / total for w in weights], abs=1e-9)


def test_benchmark_in_several_sets(spark):
    docs, bench = spark.read.parquet(DOCS), spark.read.parquet(f"{SF}/benchmark.parquet")
    one = decontam.scan(docs, bench).collect()
    many = decontam.scan(docs, bench, max_windows=60).collect()
    assert sorted(map(repr, one)) == sorted(map(repr, many)) and any(r.n_hit for r in one)
    assert decontam.scan(decontam.clean(docs, bench, "spans"), bench).where("n_hit > 0").count() == 0


def test_quality_ablations(spark):
    rows = quality.ledger(spark.read.parquet(DOCS))
    failed = [r.failed for r in rows.collect()]
    for r in quality.ablations(rows).collect():
        bit = 1 << next(x.bit for x in quality.RULES if x.name == r.rule)
        assert (r.n_failed, r.n_only, r.n_kept_without) == (sum(f & bit > 0 for f in failed), sum(f == bit for f in failed), sum(f & ~bit == 0 for f in failed))


def test_pipeline(spark, docs):
    """All stages by plain means: the rows that are left, and their digests."""
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{DOCS}')")
    passed = {i for i, kept in con.execute(f"SELECT doc_id, kept FROM ({quality.SQL})").fetchall() if kept}
    left = [d for d in docs if d.doc_id in passed]
    ids = [d.doc_id for d in left]
    groups = plain_components(ids, np.array([plain_fingerprint(d.text) for d in left], np.uint64))
    windows = set()
    word = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    lower = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
    for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect():
        own = word.findall(r.text.translate(lower))
        windows |= {tuple(own[i : i + 10]) for i in range(max(1, len(own) - 9))} if own else set()
    library = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path(pieces.MODEL))
    wanted = {}
    for d in left:
        own = word.findall(d.text.translate(lower))
        hit = any(tuple(own[i : i + n]) in windows for n in {len(w) for w in windows} for i in range(len(own) - n + 1))
        if groups[d.doc_id] == d.doc_id and not hit:
            wanted[d.doc_id] = hashlib.sha256(array.array("I", library.encode(d.text, add_bos=True, add_eos=True)).tobytes()).hexdigest()
    got = {r.doc_id: r.ids_sha256 for r in corpus_pipeline.run(spark, SF).collect()}
    assert got == wanted and 0 < len(got) < len(docs)
