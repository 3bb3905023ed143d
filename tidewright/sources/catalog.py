"""Scene catalog, port map and pixel sources."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewright.functions import constants as K

#: Fixed value: the file-name format of scenes.
SCENE_NAME = r"(?i)^CLUSTER_(\d+)_cluster_(\d+)_((?:19|20)\d{2})_feat12_u16\.tif$"

PORT_MAP = T.StructType(
    [
        T.StructField("row_no", T.LongType()),
        T.StructField("cluster_id", T.StringType()),
        T.StructField("resolved_portids", T.StringType()),
        T.StructField("contained_portids", T.StringType()),
    ]
)
REGIONAL = "region string, ports int, area_2017_km2 double, area_2025_km2 double, net_change_km2 double, seaward_net_km2 double, landward_net_km2 double, landward_share_pct double"


def list_files(spark: SparkSession, folder: str) -> DataFrame:
    """(path, name) of a folder's files, by Spark's own listing; contents are not read."""
    found = spark.read.format("binaryFile").load(folder).select("path")
    return found.select("path", F.element_at(F.split("path", "/"), -1).alias("name"))


def scene_catalog(
    files: DataFrame,
    year_min: int = K.YEAR_MIN,
    year_max: int = K.YEAR_MAX,
    clusters: list[int] | None = None,
    exclude: list[int] | None = None,
) -> DataFrame:
    """(cluster_id, cluster_uid, year, path) from file names (columns path, name).

    Names that don't match are skipped.  Of several files of one cluster and
    year the last by name stays; the first file's uid holds for a cluster.
    Empty lists don't filter.
    """
    part = lambda k: F.regexp_extract("name", SCENE_NAME, k)
    parsed = files.where(F.col("name").rlike(SCENE_NAME)).select(
        part(1).cast("int").alias("cluster_id"), part(2).cast("int").alias("uid"), part(3).cast("int").alias("year"), "name", "path"
    )
    kept = parsed.where(F.col("year").between(year_min, year_max))
    if exclude:
        kept = kept.where(~F.col("cluster_id").isin(exclude))
    if clusters:
        kept = kept.where(F.col("cluster_id").isin(clusters))
    latest = kept.groupBy("cluster_id", "year").agg(
        F.max_by("path", "name").alias("path"), F.min(F.struct("name", "uid")).alias("_first")
    )
    uid = F.first("_first.uid").over(Window.partitionBy("cluster_id").orderBy("_first.name"))
    return latest.select("cluster_id", uid.alias("cluster_uid"), "year", "path")


def nested_catalog(catalog: DataFrame) -> DataFrame:
    """(cluster_id, cluster_uid, years map of year to path): one row a cluster."""
    return catalog.groupBy("cluster_id", "cluster_uid").agg(
        F.map_from_entries(F.array_sort(F.collect_list(F.struct("year", "path")))).alias("years")
    )


def require_rows(df: DataFrame, message: str) -> DataFrame:
    if df.isEmpty():
        raise ValueError(message)
    return df


def read_port_map(spark: SparkSession, path: str) -> DataFrame:
    """The mapping CSV's rows with a row number; a missing port column reads as null."""
    raw = spark.read.csv(path, header=True)
    numbered = raw.withColumn("row_no", F.monotonically_increasing_id())
    names = set(raw.columns)
    cols = [F.col(f.name) if f.name in {*names, "row_no"} else F.lit(None).cast("string").alias(f.name) for f in PORT_MAP]
    has = ("cluster_id" in names) and ({"resolved_portids", "contained_portids"} & names)
    return numbered.select(*cols).where(F.lit(bool(has)))


def port_map(rows: DataFrame, column: str = "resolved_portids") -> DataFrame:
    """(cluster_id, ports): the last row of each integer cluster id; no ports reads as empty."""
    last = rows.withColumn("cid", F.expr("try_cast(cluster_id as int)")).where("cid is not null")
    return last.groupBy(F.col("cid").alias("cluster_id")).agg(
        F.max_by(F.coalesce(column, F.lit("")), "row_no").alias("ports")
    )


def with_ports(df: DataFrame, ports: DataFrame) -> DataFrame:
    """Left join; unmapped clusters get an empty string."""
    return df.join(ports, "cluster_id", "left").withColumn("ports", F.coalesce("ports", F.lit("")))


def read_regional(spark: SparkSession, path: str) -> DataFrame:
    """The published regional table; a byte-order mark before the header is no part of a name."""
    return spark.read.schema(REGIONAL).csv(path, header=True, enforceSchema=True)


def missing(expected: DataFrame, actual: DataFrame, keys: list[str]) -> DataFrame:
    """Expected keys that have no actual row."""
    return expected.join(actual.select(*keys).distinct(), keys, "left_anti")


def expected_years(catalog: DataFrame, first: int, last: int) -> DataFrame:
    span = F.explode(F.sequence(F.lit(first), F.lit(last)))
    return catalog.select("cluster_id").distinct().withColumn("year", span)


def require_years(catalog: DataFrame, first: int, last: int) -> DataFrame:
    """The catalog, or an error that names the first missing years."""
    gone = missing(expected_years(catalog, first, last), catalog, ["cluster_id", "year"])
    some = gone.orderBy("cluster_id", "year").limit(6).collect()
    if some:
        raise ValueError(f"missing years: {[(r[0], r[1]) for r in some]}")
    return catalog


def pending(clusters: DataFrame, done: DataFrame, keys: list[str]) -> DataFrame:
    """Clusters without a result yet."""
    return clusters.join(done, keys, "left_anti")


def pair_labels(images: DataFrame, masks: DataFrame, keys: list[str]) -> DataFrame:
    """Pixels with their mask's label; a missing mask reads as all zero."""
    return images.join(masks, keys, "left").withColumn("label", F.coalesce("label", F.lit(0)))


def select_channels(values: Column, indices: list[int]) -> Column:
    """A 12-value array reduced to ``indices``; an array of that many values passes; others are an error."""
    want = F.array(*[F.get(values, F.lit(i)) for i in indices])
    return (
        F.when(F.size(values) == len(K.BANDS), want)
        .when(F.size(values) == len(indices), values)
        .otherwise(F.raise_error(F.lit("channel count doesn't fit")))
    )


def parse_channels(text: Column) -> Column:
    """Comma-separated channel numbers as an array; duplicates and numbers outside 0..11 are errors."""
    parts = F.filter(F.transform(F.split(text, ","), lambda x: F.trim(x)), lambda x: x != "")
    found = F.transform(parts, lambda x: x.cast("int"))
    bad = (F.size(F.array_distinct(found)) != F.size(found)) | F.exists(found, lambda i: (i < 0) | (i >= len(K.BANDS)))
    return F.when(bad, F.raise_error(F.lit("duplicate or unknown channel"))).otherwise(found)


def first_given(*sources: Column) -> Column:
    """Statistics by precedence: configured, stored, built-in."""
    return F.coalesce(*sources)


def stack_profile(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Least, greatest, mean and non-zero count of a layer per key, and whether it is all zero."""
    v = F.col(value)
    return df.groupBy(*keys).agg(
        F.min(v).alias("min_v"), F.max(v).alias("max_v"), F.avg(v).alias("mean_v"),
        F.count_if(v != 0).alias("nonzero"), F.bool_and(v == 0).alias("all_zero"),
    )
