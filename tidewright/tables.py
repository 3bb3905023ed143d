"""Tables in the folder that all executors share: where lineage is cut."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_root(spark: SparkSession) -> str:
    """``spark.checkpoint.dir`` of the session; only local sessions without one get a new folder."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        held = spark.sparkContext._jsc.sc().getCheckpointDir()
        root = held.get() if held.isDefined() else None
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        root = "file://" + tempfile.mkdtemp(prefix="tidewright-")
        spark.sparkContext.setCheckpointDir(root)
    return root.rstrip("/")


def _home(spark: SparkSession) -> str:
    """The folder of this application's tables."""
    return f"{shared_root(spark)}/tidewright/{spark.sparkContext.applicationId}"


def new_folder(spark: SparkSession, label: str) -> str:
    return f"{_home(spark)}/{label}-{uuid.uuid4().hex}"


def _delete(spark: SparkSession, folder: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def sweep(spark: SparkSession) -> None:
    """Delete all tables this application made: call it when the results that read them have been used."""
    _delete(spark, _home(spark))


def cut(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` as a table in the shared folder and read it back: lineage ends there."""
    spark = df.sparkSession
    path = new_folder(spark, label)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._tidewright_path = path
    return out


def drop(*tables: DataFrame) -> None:
    """Delete tables made by ``cut`` that nothing reads any more."""
    for df in tables:
        _delete(df.sparkSession, df._tidewright_path)
