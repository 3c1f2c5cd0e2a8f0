"""Sweep and metric configs, and plain text corpora."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from spanwell.sources.logs import decoded_path

# The fields of sweep and metric configs.
SWEEP = (
    "system_configs array<struct<num_workers bigint, num_nodes bigint, shm_size string, mem_size string>>, "
    "workloads array<map<string,string>>"
)
METRIC = "struct<expression_type string, numer string, denom string, value string>"
METRICS = (
    "workloads array<struct<name string, description string, "
    f"key_metrics array<struct<name string, expression {METRIC}>>, cols map<string,string>>>"
)


def _documents(spark: SparkSession, paths: str | list[str], schema: str) -> DataFrame:
    """One JSON document per file; the explicit schema takes the last of a repeated key."""
    return (
        spark.read.schema(T.StructType.fromDDL(schema)).option("multiLine", True).json(paths)
        .select(decoded_path(F.col("_metadata.file_path")).alias("file"), "*")
    )


def read_sweeps(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    return _documents(spark, paths, SWEEP)


def parse_sweeps(documents: DataFrame, text: str = "value") -> DataFrame:
    kept = [c for c in documents.columns if c != text]
    return documents.select(*kept, F.from_json(text, SWEEP).alias("c")).select(*kept, "c.*")


def systems(sweeps: DataFrame) -> DataFrame:
    kept = [c for c in sweeps.columns if c not in ("system_configs", "workloads")]
    return sweeps.select(*kept, F.posexplode("system_configs").alias("system_pos", "s")).select(
        *kept, "system_pos", "s.*"
    )


def workloads(sweeps: DataFrame) -> DataFrame:
    kept = [c for c in sweeps.columns if c not in ("system_configs", "workloads")]
    return sweeps.select(*kept, F.posexplode("workloads").alias("workload_pos", "workload"))


def read_metrics(spark: SparkSession, path: str | list[str]) -> DataFrame:
    return metric_config(_documents(spark, path, METRICS).drop("file"))


def parse_metrics(documents: DataFrame, text: str = "value") -> DataFrame:
    kept = [c for c in documents.columns if c != text]
    return metric_config(documents.select(*kept, F.from_json(text, METRICS).alias("c")).select(*kept, "c.*"))


def metric_config(documents: DataFrame) -> DataFrame:
    """One row per workload name of a config; of a repeated name the last entry counts."""
    kept = [c for c in documents.columns if c != "workloads"]
    entries = documents.select(*kept, F.posexplode("workloads").alias("pos", "w")).withColumn("workload", F.col("w.name"))
    # an aggregate of whole entries sorts; before the shuffle that would be all that a scan task reads
    return (
        entries.repartition(*kept, "workload").groupBy(*kept, "workload")
        .agg(F.max_by("w", "pos").alias("w"))
        .select(*kept, "workload", "w.description", "w.key_metrics", "w.cols")
    )


def read_corpus(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """Lines of text files."""
    return spark.read.text(paths).select(
        decoded_path(F.col("_metadata.file_path")).alias("file"),
        F.col("value").alias("text"),
    )
