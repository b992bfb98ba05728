"""A corpus pipeline: each stage is one operator, applied to what its predecessor kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foldwise.llm import bpe, line_dedup, mixing, ngram_join, quality_rules
from foldwise.llm.common import materialise, table


def rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that no quality rule rejects."""
    return quality_rules.keep_good(docs)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the lines that an earlier document has; one left without a word goes."""
    return line_dedup.deduplicated(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies, that of the least id."""
    return ngram_join.one_of_each(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A sample whose tokens follow the targets by source, language and topic; a document of a rare cell may come more than once."""
    return mixing.sampled(docs, copies=True)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every text as tokens, with digests of the tokens and of what they decode to."""
    coded = bpe.round_trip(docs.select("doc_id", "source", "lang", "text"), bpe.vocabulary_path())
    return coded.select(
        "doc_id", "source", "lang", bpe.n_tokens().alias("n_tokens"), "ids",
        F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


STAGES = [("quality_rules", rules), ("line_dedup", lines), ("ngram_jaccard_join", near_duplicates), ("mixing", mix), ("bpe", tokens)]

# Shingle sets with components, and tokens, are beyond SQL; tests compare with plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the whole of ``documents``, each written and read again: the last one's rows.

    Defined cases: those of each stage.  A null or short text is rejected by the first one; repeated rows are one after
    the third, and the fourth may take a row several times; an empty table gives an empty result.
    """
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES:
        docs = materialise(stage(spark, docs, sf_dir))
    return docs
