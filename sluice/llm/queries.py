"""Registered queries: each applies one operator, with production parameters, to its whole table."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sluice.llm.chunk_prints import compare_fingerprints
from sluice.llm.embeddings import embedding_components
from sluice.llm.line_dedup import line_dedup
from sluice.llm.ngram_join import ngram_components
from sluice.llm.packing import pack_documents
from sluice.llm.phrases import collocations
from sluice.llm.pu_quality import quality
from sluice.llm.secrets import scan_secrets
from sluice.llm.source_mix import mixing_rates
from sluice.llm.substrings import substring_dedup
from sluice.llm.toxicity import toxicity
from sluice.llm.url_rules import Rule, judge_urls
from sluice.llm.whitening import whiten

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}

URL_RULES = [
    Rule("com", "/", "allow"), Rule("example.com", "/en/", "block"), Rule("www.example.com", "/en/", "allow"),
    Rule("net", "/es/", "block"), Rule("net", "/fr/", "block"),
]
#: Globs over host and path, for pages that no rule fits.
JUNK_GLOBS = [("*spam**", "block"), ("*casino**", "block"), ("*-pills**", "block")]


def register(fn):
    QUERIES[fn.__name__] = fn
    return fn


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@register
def op1_embedding_dedup(spark, sf_dir):
    return embedding_components(_table(spark, sf_dir, "embeddings"))


@register
def op3_substring_dedup(spark, sf_dir):
    return substring_dedup(_table(spark, sf_dir, "documents")).select("doc_id", "n_words", "n_removed", "kept_sha256")


@register
def op4_ngram_join(spark, sf_dir):
    return ngram_components(_table(spark, sf_dir, "documents"))


@register
def op5_url_filter(spark, sf_dir):
    return judge_urls(_table(spark, sf_dir, "pages"), URL_RULES, JUNK_GLOBS)


@register
def op8_chunk_fingerprints(spark, sf_dir):
    return compare_fingerprints(_table(spark, sf_dir, "documents"))


@register
def op9_best_fit_packing(spark, sf_dir, documents: DataFrame | None = None):
    docs = _table(spark, sf_dir, "documents") if documents is None else documents
    return pack_documents(docs, public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


@register
def op2_pu_quality(spark, sf_dir):
    return quality(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


@register
def op10_zstd_toxicity(spark, sf_dir):
    return toxicity(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


@register
def op6_line_dedup(spark, sf_dir):
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text", F.size(F.split("text", "\n", -1)).alias("n_lines"))
    return line_dedup(docs)


@register
def op7_source_mixing(spark, sf_dir):
    return mixing_rates(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels")).drop("row")


@register
def op11_secret_scan(spark, sf_dir):
    return scan_secrets(_table(spark, sf_dir, "documents"))


@register
def op12_embedding_whitening(spark, sf_dir):
    return whiten(_table(spark, sf_dir, "embeddings")).withColumn("deviation", F.col("deviation").try_cast("long"))


@register
def op13_phrase_mining(spark, sf_dir):
    return collocations(_table(spark, sf_dir, "documents"))
