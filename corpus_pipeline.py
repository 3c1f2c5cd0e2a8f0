"""A corpus pipeline: quality rules, line dedup, near-dedup, mixing, byte-level BPE.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame; ``run`` writes each one's result
as Parquet to the shared folder and gives it to the next. All but the last return the columns
of ``documents``.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spanwell.llm import line_dedup, minhash, mixing, prefix_bpe, quality_rules
from spanwell.llm.common import column, fresh
from spanwell.llm.queries import MIN_SITES, MIX_SEED, MIX_WEIGHTS, domain
from spanwell.session import settled

#: The share of all tokens that the mixture takes, each document once at most.
MIX_SHARE = (9, 10)


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rules keep; null and empty texts go, repeated rows are judged alike, an empty table stays empty."""
    return quality_rules.filtered(docs)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without lines that many sources share; ``n_chars`` follows the text.

    Null and empty texts stay as they are, repeated rows are treated alike, an empty table stays empty.
    """
    found, gone = fresh(docs, "n_lines"), fresh(docs, "n_removed")
    cleaned = line_dedup.remove_shared_lines(docs, min_sites=MIN_SITES, spare_copies=False, lines_out=found, removed_out=gone)
    chars = F.when(column(gone) > 0, F.length("text")).otherwise(F.col("n_chars")).cast("bigint")
    return cleaned.withColumn("n_chars", chars).select(*(column(c) for c in docs.columns))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of near-duplicates (0.8 of five-word shingles), that of the smallest doc_id.

    Rows without a doc_id stay; null and empty texts are equal; of repeated rows one stays; rows that share a doc_id are judged each by its own text.
    """
    return minhash.one_of_each(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that a mixture of domains, languages and sources takes.

    Null languages and sources are values of their own, null and empty texts have no tokens, repeated rows are
    rows of their own, an empty table stays empty.
    """
    levels = {"domain": domain(), "lang": F.col("lang"), "source": F.col("source")}
    copies = fresh(docs, "copies")
    taken = mixing.mixed(docs, levels, MIX_WEIGHTS, MIX_SHARE, 1, MIX_SEED, copies=copies)
    return taken.drop(copies)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document; a null or empty text has none, an empty table stays empty."""
    asked = docs.select("doc_id", "lang", "source", "text")
    encoded = prefix_bpe.encode(
        asked, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN, keep=["doc_id", "lang", "source"]
    )
    return encoded.select("doc_id", "lang", "source", F.size("ids").cast("bigint").alias("n_tokens"), "ids")


STAGES = [
    ("quality rules", quality),
    ("line dedup", lines),
    ("near-dedup", near_duplicates),
    ("source mixing", mix),
    ("byte-level BPE", tokens),
]

#: The rules' trust comes from an iteration until convergence and near-dedup from 64-bit hashes that
#: SQL lacks; tests hold the pipeline against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The result of all stages over ``documents``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = settled(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return docs
