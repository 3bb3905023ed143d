"""Sinks: layer tables, diagnostics, summaries and the change table.

Layers of a scene are columns of one table partitioned by cluster and year, so
a rerun of a cluster-year overwrites its partition only, and readers prune.
"""

from __future__ import annotations

import json
from dataclasses import asdict, is_dataclass
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

LAYERS = ("prob_raw", "prob_refined", "water_prob", "dist_to_water_m", "mask_spatial", "water_mask")


def write_layers(df: DataFrame, path: str, keys: tuple[str, ...] = ("cluster_id", "year")) -> None:
    """Overwrite the partitions that ``df`` holds; others stay."""
    writer = df.repartition(*keys).sortWithinPartitions(*keys, "r", "c").write.mode("overwrite")
    writer.option("partitionOverwriteMode", "dynamic").option("compression", "zstd").partitionBy(*keys).parquet(path)


def append_records(df: DataFrame, path: str) -> None:
    """Append records as JSON lines; reruns append again."""
    df.write.mode("append").json(path)


def write_summaries(df: DataFrame, path: str, key: str = "cluster_id") -> None:
    """One JSON partition per cluster, overwritten by a rerun; its presence means done."""
    writer = df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
    writer.partitionBy(key).json(path)


def done_clusters(spark: SparkSession, path: str, key: str = "cluster_id") -> DataFrame:
    """(key) of the clusters that have a summary; none where nothing was written."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at):
        return spark.createDataFrame([], f"{key} int")
    return spark.read.json(path).select(F.col(key).cast("int")).distinct()


def write_changes(df: DataFrame, path: str, resume: bool = True) -> None:
    """The change table as CSV with a header: appended when resuming, else anew."""
    df.write.mode("append" if resume else "overwrite").csv(path, header=True)


def write_global(df: DataFrame, path: str) -> None:
    """The whole change table (a row a cluster and year) as one CSV part that begins with a byte-order mark."""
    first, *rest = df.columns
    df.coalesce(1).select(F.col(first).alias(f"\ufeff{first}"), *rest).write.mode("overwrite").csv(path, header=True)


def write_config(config: object, path: str) -> None:
    """A driver-side settings file."""
    data = asdict(config) if is_dataclass(config) else config
    Path(path).write_text(json.dumps(data, indent=2, ensure_ascii=False), encoding="utf-8")
