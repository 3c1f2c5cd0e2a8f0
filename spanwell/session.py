"""Session settings for local runs, and the folder for cut lineage."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def local_session(cores: str = "*", app: str = "spanwell", partitions: int = 8) -> SparkSession:
    """A local session for tests and the bench; clusters bring their own."""
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.driver.memory", os.environ.get("SPANWELL_DRIVER_MEMORY", "12g"))
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


#: Where intermediate tables go if ``spark.checkpoint.dir`` is unset; can be set on a running session.
WORK_CONF = "spanwell.work.dir"


def _work_folder(spark: SparkSession) -> str:
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get(WORK_CONF, None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError(f"set spark.checkpoint.dir or {WORK_CONF} to a folder all executors share")
        base = tempfile.gettempdir()
    return f"{base.rstrip('/')}/spanwell/{spark.sparkContext.applicationId}"


def shared_folder(spark: SparkSession, name: str) -> str:
    """A fresh path in the folder that all executors can reach.

    The cluster names it in ``spark.checkpoint.dir``; a machine-local folder is
    used only where nothing is set and the master is local, as in tests. Each application
    has a folder of its own.
    """
    return f"{_work_folder(spark)}/{name}-{uuid.uuid4().hex}"


def release(spark: SparkSession) -> None:
    """Remove this application's intermediate tables, once no result that reads them is needed."""
    path = spark._jvm.org.apache.hadoop.fs.Path(_work_folder(spark))
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def settled(df: DataFrame, name: str, spark: SparkSession | None = None) -> DataFrame:
    """``df`` written to the shared folder and read back, by another session (``spark``) if one is given.

    For results that several later steps use: they are computed once, survive
    the loss of executors, and have a known size for the planner.
    """
    spark = spark or df.sparkSession
    path = shared_folder(spark, name)
    df.write.parquet(path)
    table = spark.read.schema(df.schema).parquet(path)
    table.settled_at = path
    return table


def forget(*tables: DataFrame) -> None:
    """Remove settled tables that no later result reads, once all that did are settled themselves."""
    for table in tables:
        spark = table.sparkSession
        path = spark._jvm.org.apache.hadoop.fs.Path(table.settled_at)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
