"""Session settings, table access and materialised cuts in the plan."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: Settings every operator is written for. None fixes a parallelism: that follows the data and the cluster.
SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def local_session(cores: int | str = 8, shuffle_partitions: int = 8, **conf: str) -> SparkSession:
    """A session for tests and benchmarks on one machine."""
    builder = SparkSession.builder.master(f"local[{cores}]").appName("docketry")
    for key, value in {**SETTINGS, "spark.sql.shuffle.partitions": str(shuffle_partitions), "spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false", **conf}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder for materialised tables: ``spark.checkpoint.dir``, which every executor can reach.

    Only a local session may leave it unset; it then gets a folder of its own, removed when the JVM ends.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        master = spark.sparkContext.master
        if not (master == "local" or master.startswith("local[")):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="docketry-", dir=os.environ.get("TMPDIR"))
        spark.conf.set("spark.checkpoint.dir", folder)
        _delete_on_exit(spark, folder)
    return folder.rstrip("/")


def _path(spark: SparkSession, name: str):
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(name)
    return path, path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def _delete_on_exit(spark: SparkSession, name: str) -> None:
    path, fs = _path(spark, name)
    fs.deleteOnExit(path)


def materialise(df: DataFrame, partition_by: str | None = None) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: a cut in the lineage that survives lost executors."""
    spark = df.sparkSession
    name = f"{shared_folder(spark)}/docketry-{uuid.uuid4().hex}"
    writer = df.write.partitionBy(partition_by) if partition_by else df.write
    writer.parquet(name)
    _delete_on_exit(spark, name)
    out = spark.read.schema(df.schema).parquet(name)
    out._docketry_path = name  # type: ignore[attr-defined]
    return out


def release(df: DataFrame) -> None:
    """Delete a table that :func:`materialise` wrote and no later plan reads."""
    name = getattr(df, "_docketry_path", None)
    if name:
        path, fs = _path(df.sparkSession, name)
        fs.delete(path, True)
