"""Random inputs for the parts that need no session."""

import array
import re

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from slate.llm import decontam, pieces, simhash, tokenfiles, urlfilter

TEXT = st.text(st.characters(codec="utf-8"), max_size=80)
FEW = settings(max_examples=150, deadline=None)


@pytest.fixture(scope="module")
def vocabulary():
    return pieces.Vocabulary(open(public_tokenizers.path(pieces.MODEL), "rb").read())


@pytest.fixture(scope="module")
def encoder():
    definition = open(public_tokenizers.path(tokenfiles.TOKENIZER)).read()
    return tokenfiles.Encoder(definition), Tokenizer.from_str(definition)


@FEW
@given(text=TEXT)
def test_pieces(vocabulary, text):
    wanted = vocabulary.library.encode(text, add_bos=True, add_eos=True)
    (ids,) = vocabulary.encode([text])
    assert ids == array.array("I", wanted).tobytes() and vocabulary.decode(ids) == vocabulary.library.decode(wanted)


@FEW
@given(text=TEXT)
def test_tokenizer(encoder, text):
    own, library = encoder
    assert own.encode([text.encode()])[0] == array.array("I", library.encode(text, add_special_tokens=False).ids).tobytes()


@FEW
@given(ids=st.lists(st.integers(0, 2**32 - 1), max_size=1500), at=st.data())
def test_codes(ids, at):
    data = tokenfiles.pack(np.array(ids, np.uint32))
    segment = tokenfiles.Segment(lambda offset, length: data[offset : offset + length])
    a = at.draw(st.integers(0, len(ids)))
    b = at.draw(st.integers(a, len(ids)))
    assert segment.ids(a, b).tolist() == ids[a:b]


HOSTS = st.lists(st.sampled_from(["a", "b", "com", "net", ""]), min_size=1, max_size=4).map(".".join)
PATHS = st.lists(st.sampled_from(["", "x", "xy", "de", "d"]), max_size=4).map(lambda p: "/" + "/".join(p))


@FEW
@given(rules=st.lists(st.builds(urlfilter.Entry, st.sampled_from(["allow", "block"]), HOSTS, PATHS), max_size=8), host=HOSTS, path=st.one_of(st.just(""), PATHS))
def test_longest_rule(rules, host, path):
    fits = [r for r in rules if (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path)]
    best = max(fits, key=lambda r: (len(r.host.split(".")), len(r.path), r.verdict == "block"), default=None)
    found = urlfilter.Trie(rules).find(host, path)
    assert (found and (found.name, found.verdict)) == (best and (best.name, best.verdict))


WORDS = st.lists(st.sampled_from(["a", "b", "c", "Zé"]), max_size=30).map(" ".join)


@FEW
@given(items=st.lists(WORDS, max_size=4), text=WORDS, window=st.integers(1, 5))
def test_windows(items, text, window):
    held = decontam.WindowSet([(str(i), own) for i, item in enumerate(items) if (own := decontam.words(item))], window)
    own = decontam.words(text)
    numbers = np.array([held.vocabulary.get(w, 0) for w in own], np.uint32)
    hit = {p + k for p, n, _ in held.find(numbers) for k in range(n)}
    wanted = set()
    for item in items:
        theirs = decontam.words(item)
        n = min(window, len(theirs))
        wins = {tuple(theirs[i : i + n]) for i in range(len(theirs) - n + 1)} if theirs else set()
        wanted |= {p + k for p in range(len(own) - n + 1) if tuple(own[p : p + n]) in wins for k in range(n)}
    assert hit == wanted
    assert own == [w.encode() for w in re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(c.lower() if c.isascii() else c for c in text))]


@FEW
@given(fps=st.lists(st.integers(0, 2**64 - 1), min_size=1, max_size=6), flips=st.lists(st.tuples(st.integers(0, 5), st.lists(st.integers(0, 63), max_size=4)), max_size=40))
def test_forest_joins_what_is_linked(fps, flips):
    own = np.unique(np.array(fps + [fps[i % len(fps)] ^ sum(1 << b for b in set(bits)) for i, bits in flips], np.uint64))
    a, b = simhash._forest(own)
    assert (np.bitwise_count(a ^ b) <= simhash.DISTANCE).all()

    def parts(pairs):
        root = {int(f): int(f) for f in own}
        for x, y in pairs:
            old, new = root[int(x)], root[int(y)]
            root = {f: new if r == old else r for f, r in root.items()}
        return {frozenset(f for f in root if root[f] == r) for r in root.values()}

    linked = [(x, y) for x in own for y in own if np.bitwise_count(x ^ y) <= simhash.DISTANCE]
    assert parts(zip(a, b, strict=True)) == parts(linked)
