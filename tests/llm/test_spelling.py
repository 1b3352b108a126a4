"""Spelling variants against all pairs of words, and the counts of words against a plain reading."""

import collections
import random
import re
import zlib

import pytest

from slate.llm import spelling


def near(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) - len(a) == 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def plain(words, ratio=5):
    out = {}
    for w, n in words.items():
        beside = [o for o in words if near(w, o)]
        best = min(beside, key=lambda o: (-words[o], o), default=None)
        out[w] = [n, len(beside), best if best and words[best] >= ratio * n else None]
    for w, row in out.items():
        root = w
        while out[root][2]:
            root = out[root][2]
        row += [words.get(row[2]), root]
    return out


def check(spark, words):
    rows = spelling.variants(spark.createDataFrame(list(words.items()), "word string, n long")).collect()
    assert len(rows) == len(words)
    assert {r.word: [r.n, r.n_near, r.form, r.form_n, r.root] for r in rows} == plain(words)


@pytest.mark.parametrize(("letters", "longest", "count"), [("ab", 9, 500), ("abcé", 7, 400), ("aÿz", 12, 300)])
def test_all_pairs(spark, letters, longest, count):
    """Few letters: runs of equal ones, where a deletion has many places, and every change of heavy and light children."""
    rng = random.Random(count)
    words = {"".join(rng.choice(letters) for _ in range(rng.randrange(1, longest))): rng.choice([1, 2, 9, 50, 400]) for _ in range(count)}
    check(spark, words)


def test_ties_runs_and_prefixes(spark):
    check(spark, {"a": 5, "aa": 5, "aaa": 25, "aaaa": 125, "aaaaa": 625, "b": 25, "ab": 25, "ba": 25, "c": 1, "caa": 5, "x" * 3000: 7, "x" * 2999: 40, "x" * 2998 + "y": 1})


def test_no_words(spark):
    assert spelling.variants(spark.createDataFrame([], "word string, n long")).collect() == []
    none = spark.createDataFrame([], "doc_id long, text string")
    assert spelling.query(none).collect() == []


def plain_counts(docs, noise=199, shortest=6):
    lowered = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
    out = collections.Counter()
    for who, text, *_ in docs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            word = run.translate(lowered)
            h = zlib.crc32(f"{'' if who is None else who}:{word}".encode())
            if h % noise == 0:
                word = word[: h % len(word)] + word[h % len(word) + 1 :]
            if len(word) >= shortest:
                out[word] += 1
    return out


def test_counts_and_the_query(spark, monkeypatch):
    monkeypatch.setattr(spelling, "HELD_WORDS", 50)
    rng = random.Random(2)
    base = ["Protocol", "measure", "Éclair×naïveté", "straße", "abcdefg", "ABCDEFH", "İstanbul", "short", "zoology"]
    docs = [(i if i % 9 else None, " ".join(rng.choice(base) + rng.choice(["", "s", "_x", "1", "\n"]) for _ in range(rng.randrange(60))), "word", 3) for i in range(150)]
    docs += [(500, None, "n", 1), (501, "", None, 1), docs[3], (502, "protocol" * 2000 + " " + "abcdefg " * 3000, "n", 1)]
    frame = spark.createDataFrame(docs, "doc_id long, text string, word string, n long")
    want = plain_counts(docs)
    assert {r.word: r.n for r in spelling.word_counts(frame, noise=199).collect()} == dict(want)
    kept = {w: n for w, n in want.items() if n >= 5}
    assert {r.word: [r.n, r.n_near, r.form, r.form_n, r.root] for r in spelling.query(frame).collect()} == plain(kept)


def test_light_children_are_few(spark):
    """A word leaves by at most log2(words) light children, and ends once."""
    words = [(f"{i:b}".translate({48: "a", 49: "b"}), 1) for i in range(1, 600)]
    counts = collections.Counter(r.key for r in spelling.light_children(spark.createDataFrame(words, "word string, n long")).collect())
    assert max(counts.values()) <= 11
