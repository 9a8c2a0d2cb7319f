"""Intermediate tables in the folder that all executors share.

``spark.checkpoint.dir`` names that folder on a cluster. Only where it is unset and the master is
local (tests, a laptop) a temporary folder of this machine is used instead; on a cluster that
would lose data, so there it is an error.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The shared folder of this session; also the checkpoint folder of its context."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not named:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        named = tempfile.mkdtemp(prefix="ramify-")
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(named)
    return named.rstrip("/")


def app_dir(spark: SparkSession) -> str:
    """This application's own folder within the shared one."""
    return f"{shared_dir(spark)}/ramify-{spark.sparkContext.applicationId}"


def saved(df: DataFrame, label: str, sort_of_codec: str = "zstd") -> DataFrame:
    """Write ``df`` as Parquet to the shared folder and return the table that was written.

    Cuts the lineage: a lost executor costs a re-read, not a recomputation, and values that
    depend on how rows were partitioned stay fixed once the table is committed.
    """
    spark = df.sparkSession
    path = f"{app_dir(spark)}/{label}-{uuid.uuid4().hex}"
    df.write.option("compression", sort_of_codec).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def saved_by(df: DataFrame, label: str, column: str, buckets: int, sort_of_codec: str = "zstd") -> DataFrame:
    """Like saved(), in buckets by ``column``: grouping or joining by it later needs no shuffle of this table."""
    spark = df.sparkSession
    name = f"{label.replace('-', '_')}_{uuid.uuid4().hex}"
    writer = df.write.option("compression", sort_of_codec).option("path", f"{app_dir(spark)}/{name}")
    writer.bucketBy(buckets, column).saveAsTable(name)
    table = spark.table(name)
    spark.sql(f"DROP TABLE {name}")  # the name only; the files stay, as the table is an external one
    return table


def cleanup(spark: SparkSession) -> None:
    """Delete this application's intermediate tables; results not yet written become unreadable."""
    remove(spark, app_dir(spark))


def remove(spark: SparkSession, where: str) -> None:
    """Delete a folder, wherever Spark can reach it."""
    path = spark._jvm.org.apache.hadoop.fs.Path(where)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
