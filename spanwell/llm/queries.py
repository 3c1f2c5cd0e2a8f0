"""The registered queries of the operators, each over its whole table.

The queries choose the columns that an operator needs, give it production parameters, and
derive digests from its output; the work is the operators'.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from spanwell.llm import (
    embedding_dedup,
    hard_negatives,
    language_id,
    line_dedup,
    merkle,
    mixing,
    packing,
    prefix_bpe,
    quality_classifier,
    quality_rules,
    simhash,
    token_files,
    url_filters,
)
from spanwell.llm.text_stats import with_counts
from spanwell.session import settled, shared_folder

Query = Callable[[SparkSession, str], DataFrame]

#: Rules of hosts and paths.
URL_RULES = [("net/", "block"), ("example.net/en/", "allow"), ("example.com/de/", "block"), ("org/fr/", "allow")]
#: No table has labels of urls. A host with one of these words in a label counts as known to be
#: bad, every other host as good; the trees see none of the words.
BAD_HOST_WORDS = r"(^|[.-])(adult|ads|bets|casino|pills|spam)([.-]|$)"

#: Which sources make up which domain, and the weights below the root, by domain and by language.
DOMAINS = {"web": ["src0", "src1", "src2", "src3", "src4", "src5"], "books": ["src6", "src7", "src8", "src9"]}
OTHER_DOMAIN = "forums"
MIX_WEIGHTS: list[dict[tuple, int]] = [
    {("web",): 5, ("books",): 3, (OTHER_DOMAIN,): 2},
    {("en",): 4, ("de",): 2, ("fr",): 2, ("es",): 2},
    {},
]
MIX_SHARE, MIX_EPOCHS, MIX_SEED = (3, 4), 2, 2024
MIN_SITES = 10


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _remainder(divisor: int) -> Column:
    return F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % divisor


def url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rule and verdict of every page's url."""
    pages = _table(spark, sf_dir, "pages").select("page_id", "url")
    labelled = pages.select(
        "url", F.when(url_filters.host(F.col("url")).rlike(BAD_HOST_WORDS), 1).otherwise(0).alias("label")
    ).where("url is not null")
    return url_filters.judge(pages, URL_RULES, labelled)


def bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Encode every document, decode the ids, and digest both."""
    ranks = public_tokenizers.path("byte_bpe_50k.tiktoken")
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    encoded = prefix_bpe.encode(docs, ranks, public_tokenizers.PATTERN, keep=["doc_id"])
    decoded = prefix_bpe.decode(encoded, ranks)
    return decoded.select(
        "doc_id",
        F.size("ids").cast("bigint").alias("n_tokens"),
        F.sha2(F.concat_ws(" ", F.col("ids").cast("array<string>")).cast("binary"), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and component of every document."""
    return simhash.near_duplicates(_table(spark, sf_dir, "documents"))


def domain() -> Column:
    found = F.when(F.lit(False), F.lit(OTHER_DOMAIN))
    for name, sources in DOMAINS.items():
        found = found.when(F.col("source").isin(sources), F.lit(name))
    return found.otherwise(F.lit(OTHER_DOMAIN))


def domain_sql() -> str:
    cases = "".join(f" WHEN source IN ({', '.join(map(repr, sources))}) THEN '{name}'" for name, sources in DOMAINS.items())
    return f"CASE{cases} ELSE '{OTHER_DOMAIN}' END"


def mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents that a mixture of domains, languages and sources takes, and how often."""
    docs = _table(spark, sf_dir, "documents")
    levels = {"domain": domain(), "lang": F.col("lang"), "source": F.col("source")}
    taken = mixing.mixed(docs, levels, MIX_WEIGHTS, MIX_SHARE, MIX_EPOCHS, MIX_SEED)
    return taken.select("doc_id", domain().alias("domain"), "lang", "source", mixing.n_words(F.col("text")).alias("tokens"), "copies")


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document without the lines that many sources share."""
    docs = _table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    return line_dedup.remove_shared_lines(docs, min_sites=MIN_SITES, spare_copies=False).select("doc_id", "text", "n_lines", "n_removed")


def rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts of every document and the verdict of the rules."""
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    counted = settled(with_counts(docs, keep=["doc_id"]), "document-counts")
    judged = quality_rules.judge(counted, quality_rules.learn(counted))
    shown = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
    return judged.select("doc_id", *(f"counts.{c}" for c in shown), "base_failed", "quality_probability", "kept")


def classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality of every document by discriminants learnt from four fifths of the labels."""
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    counted = settled(with_counts(docs, keep=["doc_id"]), "document-counts")
    labels = _table(spark, sf_dir, "labels").select(F.col("doc_id").alias("label_id"), F.col("quality").alias("label"))
    held_out = _remainder(5) == 0
    labelled = counted.where(~held_out).join(labels, F.col("doc_id") == F.col("label_id")).select("counts", "label")
    scored = quality_classifier.score(counted, quality_classifier.fit(labelled))
    return scored.select("doc_id", held_out.alias("held_out"), "score", "predicted")


def tokens_on_disk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Write all documents' ids to files of compressed blocks and read them back."""
    path = shared_folder(spark, "token-files")
    docs = _table(spark, sf_dir, "documents")
    token_files.write(docs, path, public_tokenizers.path("word_bpe_49k.json"), end_id=1)
    return token_files.read(spark, path).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links and component of every embedding."""
    return embedding_dedup.near_vectors(_table(spark, sf_dir, "embeddings").select("vec_id", "embedding"))


def language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every document by a network that has learnt from two thirds of the languages given."""
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    held_out = _remainder(3) == 1
    network = language_id.fit(docs.where(~held_out))
    asked = docs.select("doc_id", "text", held_out.alias("held_out"))
    return language_id.predict(asked, network, keep=["doc_id", "held_out"])


def manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Proof of every document in a tree over the sources' trees, checked against texts half of which were tampered with."""
    docs = _table(spark, sf_dir, "documents")
    fields = [F.col(c) for c in ("doc_id", "source", "lang", "n_chars")]
    tampers = F.col("doc_id").isNotNull() & (F.crc32(F.col("doc_id").cast("string").cast("binary")) % 2 == 0)
    changed = F.when(tampers, merkle.leaf([*fields, F.replace(F.col("text"), F.lit("\n"), F.lit(""))]))
    proofs = merkle.manifest(
        docs, merkle.leaf([*fields, F.col("text")]), F.col("source"), F.col("doc_id"), doc_id=F.col("doc_id"), changed=changed)
    return merkle.verified(proofs, "changed", ["doc_id", "leaf", "subroot", "root"])


def packed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pieces of all documents in sequences of 2048 ids."""
    docs = _table(spark, sf_dir, "documents")
    sequences = packing.sequences(docs, public_tokenizers.path("word_bpe_49k.json"), 1, F.col("doc_id"), F.col("text"))
    return packing.pieces(sequences).select(
        "doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hard negatives of every fiftieth embedding, a seventh of whose labels are moved on by one."""
    vec_id, label = F.col("vec_id"), F.col("label")
    moved = F.when(vec_id % 7 == 0, (label + 1) % 10).otherwise(label)
    return hard_negatives.mine(_table(spark, sf_dir, "embeddings"), vec_id, F.col("embedding"), moved, vec_id % 50 == 0)


QUERIES: dict[str, Query] = {
    "op1_url_filter": url_filter,
    "op2_byte_bpe": bpe,
    "op3_simhash_dedup": simhash_dedup,
    "op4_source_mix": mix,
    "op5_line_dedup": lines,
    "op6_embedding_dedup": vectors,
    "op7_quality_rules": rules,
    "op8_quality_classifier": classifier,
    "op9_token_files": tokens_on_disk,
    "op10_language_id": language,
    "op11_merkle_manifest": manifest,
    "op12_packing": packed,
    "op13_hard_negatives": negatives,
}
SQL: dict[str, str] = {
    "op4_source_mix": mixing.sql(
        {"domain": domain_sql(), "lang": "lang", "source": "source"}, MIX_WEIGHTS, MIX_SHARE, MIX_EPOCHS, MIX_SEED
    ),
    "op5_line_dedup": line_dedup.SQL.format(min_sites=MIN_SITES),
    "op11_merkle_manifest": merkle.SQL,
    "op13_hard_negatives": hard_negatives.SQL,
}
