"""A training corpus from raw documents: each stage applies one operator to all that its predecessor kept.

Stages take (spark, docs, sf_dir) and return a DataFrame, which is written and read again as the next one's docs.  All but the
last return the columns of ``documents``.  Empty tables, null texts, repeated rows and further columns pass through as the
operators' docstrings say; rows without id are never learned from and form groups of their own.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sluice.llm.line_dedup import line_dedup
from sluice.llm.ngram_join import ngram_components
from sluice.llm.packing import pack_documents
from sluice.llm.pu_quality import with_score
from sluice.llm.scratch import Scratch, fresh, passing
from sluice.llm.source_mix import draw

KEEP_SCORE = 0.7
#: Token shares after mixing; the quality classifier has taken the junk out.
SHARES = {"clean": 0.94, "toxic": 0.06}


def _labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/labels.parquet")


def quality_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier does not reject."""
    scored, score = with_score(docs, _labels(spark, sf_dir))
    return scored.where(F.col(score) >= KEEP_SCORE).drop(score)


def line_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without blocks of lines that an earlier document has.  A document that loses all its words goes."""
    words, had = F.col("text").rlike(r"[^\x20\x09-\x0D]"), fresh("had_words", docs)
    out = line_dedup(docs.withColumn(had, F.coalesce(words, F.lit(False))))
    return out.where(~F.col(had) | words).drop(had)


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents linked by 5-grams the one with the smallest id; of repeated rows one.  Rows without id stay."""
    groups = ngram_components(docs)
    others = groups.where(F.col("doc_id") != F.col("component_id")).select("doc_id").distinct()
    kept = docs.join(others, "doc_id", "left_anti").select(docs.columns)
    return kept.where("doc_id IS NOT NULL").dropDuplicates(["doc_id"]).unionByName(kept.where("doc_id IS NULL"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as its mixing rate draws it."""
    return draw(docs, _labels(spark, sf_dir), SHARES)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of the training sequences."""
    return pack_documents(docs, public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


STAGES = [("quality classifier", quality_filter), ("line dedup", line_filter), ("n-gram Jaccard join", one_of_each_group),
          ("mixing sources to target weights", mix_sources), ("best-fit packing", pack_sequences)]

#: The stages learn models, link texts by hashes and pack tokens: SQL cannot express them.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, scratch = spark.read.parquet(f"{sf_dir}/documents.parquet"), Scratch(spark, "pipeline")
    for _, stage in STAGES:
        with passing(spark):  # the stage's own tables go once its result is written
            docs = scratch.keep(stage(spark, docs, sf_dir))
    return docs
