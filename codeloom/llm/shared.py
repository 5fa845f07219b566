"""Paths, staging and small joins that the operators of this subpackage share."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_STAGED: list[str] = []


def table(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    """One table of a data folder, pruned to ``columns`` when given."""
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return df.select(*columns) if columns else df


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``; only a local session without one gets its own."""
    where = spark.conf.get("spark.checkpoint.dir", None)
    if not where:
        where = spark.sparkContext.getCheckpointDir()
    if not where:
        if not (spark.sparkContext.master or "").startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="codeloom-"))
        where = spark.sparkContext.getCheckpointDir()
    return where.rstrip("/")


def fresh_path(spark: SparkSession, label: str) -> str:
    """A new path below the shared folder, removed when the driver exits."""
    path = f"{shared_dir(spark)}/codeloom-{label}-{uuid.uuid4().hex}"
    if not _STAGED:
        atexit.register(_sweep, spark)
    _STAGED.append(path)
    return path


def _sweep(spark: SparkSession) -> None:
    try:
        jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
        for path in _STAGED:
            target = jvm.org.apache.hadoop.fs.Path(path)
            target.getFileSystem(conf).delete(target, True)
    except Exception:  # the session may be gone already; the folder is the cluster's scratch space
        return


def stage(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` as Parquet below the shared folder and read it back.

    It cuts the lineage, survives lost executors, and gives the optimizer the
    true size, by which it picks broadcast or shuffle.
    """
    path = fresh_path(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def small_batches(spark: SparkSession, rows: int = 1000) -> None:
    """Keep Arrow batches of whole texts small: a batch of 1000 texts of 20 KB is 20 MB."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))


def text_of(column: str = "text"):
    """The text, with null read as empty."""
    return F.coalesce(F.col(column), F.lit(""))
