"""Vocabularies and tokenizer definitions that do not fit are errors or take the library's way; they never give other ids."""

import array
import json

import public_tokenizers
import pytest
from pyspark.errors import PythonException
from tokenizers import Tokenizer

from slate.llm import pieces, tokenfiles
from slate.llm.batches import partitions

TEXTS = ["This is a text of some words.", "And another one, it is", ""]


def test_a_broken_merge_table_is_an_error():
    class Broken(pieces.Vocabulary):
        def _hash(self, merges):
            super()._hash({k: v for n, (k, v) in enumerate(merges.items()) if n % 3})

    with pytest.raises(RuntimeError, match="disagree"):
        pieces.checked(Broken(open(public_tokenizers.path(pieces.MODEL), "rb").read()), TEXTS)


def test_a_disagreement_fails_the_job(spark):
    model = public_tokenizers.path(pieces.MODEL)

    def run(batches):
        own = pieces.Vocabulary(open(model, "rb").read())
        own.known[own.segments.findall(pieces.MARK + "This")[0]] = b""
        for batch in batches:
            pieces.checked(own, batch.column(0).to_pylist())
            yield batch

    with pytest.raises(PythonException, match="disagree"):
        spark.createDataFrame([(t,) for t in TEXTS], "text string").repartition(1).mapInArrow(run, "text string").collect()


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", tokenfiles.TOKENIZER])
def test_other_definitions_go_to_the_library_whole(name):
    definition = open(public_tokenizers.path(name)).read()
    encoder, library = tokenfiles.Encoder(definition), Tokenizer.from_str(definition)
    assert encoder.chunked == (name == tokenfiles.TOKENIZER)
    for text, ids in zip(TEXTS, encoder.encode([t.encode() for t in TEXTS]), strict=True):
        assert ids == array.array("I", library.encode(text, add_special_tokens=False).ids).tobytes()


def test_a_wrong_guess_about_a_definition_is_an_error(monkeypatch):
    definition = json.loads(open(public_tokenizers.path(tokenfiles.TOKENIZER)).read())
    definition["pre_tokenizer"] = {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False}
    monkeypatch.setattr(tokenfiles, "_splits_at_chunks", lambda parts: True)
    with pytest.raises((RuntimeError, ValueError)):
        tokenfiles.Encoder(json.dumps(definition)).encode([t.encode() for t in TEXTS])


def test_partitions_grow_with_the_input(spark, tmp_path):
    spark.range(100_000).selectExpr("id", "repeat('x', 20) AS t").write.parquet(f"{tmp_path}/t")
    table = spark.read.parquet(f"{tmp_path}/t")
    at_least = int(spark.conf.get("spark.sql.shuffle.partitions"))
    assert partitions(table) == at_least and partitions(table, 1000) > 10 * at_least
    assert partitions(table.join(table, "id"), 1 << 40) == at_least
    local = spark.createDataFrame([(i, "x") for i in range(100)], "id long, u string")
    assert partitions(local) == partitions(table.join(local, "id")) == at_least
