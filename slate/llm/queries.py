"""The registered queries of this subpackage and, where SQL can express them, their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

import corpus_pipeline
from slate.llm import chat, decontam, epsilon, htmltext, licenses, negatives, pieces, quality, sharding, simhash, spelling, tokenfiles, urlfilter
from slate.session import ship, small_batches, table


def _over(name: str, query: Callable[..., DataFrame], *more: str) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        ship(spark)
        small_batches(spark)
        return query(*[table(spark, sf_dir, t) for t in (name, *more)])

    return run


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_simhash": _over("documents", simhash.query),
    "op2_sharding": _over("documents", sharding.query),
    "op3_url_filters": _over("pages", urlfilter.query),
    "op4_quality_rules": _over("documents", quality.query),
    "op5_decontamination": _over("documents", decontam.query, "benchmark"),
    "op6_license_scans": _over("documents", licenses.query),
    "op7_sentencepiece": _over("documents", pieces.query),
    "op8_token_files": _over("documents", tokenfiles.query),
    "op9_html_extraction": _over("pages", htmltext.query),
    "op10_chat_formatting": _over("conversations", chat.query),
    "op11_hard_negatives": _over("embeddings", negatives.query),
    "op12_embedding_duplicates": _over("embeddings", epsilon.query),
    "op13_spelling_variants": _over("documents", spelling.query),
    "pipeline": corpus_pipeline.run,
}
SQL: dict[str, str] = {
    "op3_url_filters": urlfilter.SQL,
    "op4_quality_rules": quality.SQL,
    "op5_decontamination": decontam.SQL,
    "op6_license_scans": licenses.SQL,
    "op10_chat_formatting": chat.SQL,
    "op11_hard_negatives": negatives.SQL,
}
