"""Raster-shaped inputs derived from the driver tables, in Spark and in SQL.

SCENE: pixels of small 12-band scenes from ``embeddings``; STACK: yearly port
scores on a grid from ``lineitem``; LOGITS, PAIR, SERIES, CATALOG and REGION
follow the same idea.  Every table row takes part; missing bands read as 0.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidewright.functions import pixel as P
from tidewright.sources.catalog import SCENE_NAME


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def rsql(expr: str, name: str) -> str:
    """SQL twin of ``pixel.rounded``."""
    return f"round({expr}, 6) + 0.0 AS {name}"


def csql(x: str, low: str, high: str) -> str:
    return f"least(greatest({x}, {low}), {high})"


def dn_long(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(scene, band, r, c, dn)"""
    e = table(spark, sf_dir, "embeddings").select("vec_id", F.posexplode("embedding").alias("i", "e"))
    band = (F.col("vec_id") % 12).cast("int")
    gain = F.when(band <= 5, 2.5).otherwise(1.0)
    scale = F.when(band <= 5, 300.0).when(band <= 7, 30000.0).when(band == 8, 25000.0).otherwise(10000.0)
    dn = F.round(F.greatest(F.lit(0.0), 1.0 + gain * F.col("e").cast("double")) * scale).cast("int")
    return e.select(
        F.floor(F.col("vec_id") / 12).cast("int").alias("scene"),
        band.alias("band"),
        F.floor(F.col("i") / 8).cast("int").alias("r"),
        (F.col("i") % 8).cast("int").alias("c"),
        dn.alias("dn"),
    )


DN_LONG = """dn_long AS (
  SELECT scene, band, r, c, round(greatest(0.0::DOUBLE, 1 + (CASE WHEN band <= 5 THEN 2.5 ELSE 1.0 END)::DOUBLE * e)
         * (CASE WHEN band <= 5 THEN 300 WHEN band <= 7 THEN 30000 WHEN band = 8 THEN 25000 ELSE 10000 END))::INTEGER AS dn
  FROM (SELECT (vec_id // 12)::INTEGER AS scene, (vec_id % 12)::INTEGER AS band, (i // 8)::INTEGER AS r,
               (i % 8)::INTEGER AS c, e
        FROM (SELECT vec_id, unnest(embedding)::DOUBLE AS e, generate_subscripts(embedding, 1) - 1 AS i FROM embeddings)))"""


def scene(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(scene, r, c, b0..b11): decoded bands."""
    long = dn_long(spark, sf_dir)
    dn = [F.coalesce(F.max(F.when(F.col("band") == k, F.col("dn"))), F.lit(0)).alias(f"d{k}") for k in range(12)]
    wide = long.groupBy("scene", "r", "c").agg(*dn)
    return wide.select("scene", "r", "c", *[P.decode(F.col(f"d{k}"), k).alias(f"b{k}") for k in range(12)])


def _decoded(k: int) -> str:
    x = f"coalesce(max(dn) FILTER (band = {k}), 0)::DOUBLE"
    if k <= 5:
        return f"{x} * 1e-4"
    if k <= 7:
        return csql(f"({x} * 1e-3 - 35.0 + 25.0) / 30.0", "0.0", "1.0")
    return csql(f"({x} * 1e-3 - 20.0) / 15.0", "0.0", "1.0") if k == 8 else f"{x} * 1e-4 - 1.0"


SCENE = (
    DN_LONG
    + ",\nscene AS (SELECT scene, r, c, "
    + ", ".join(f"{_decoded(k)} AS b{k}" for k in range(12))
    + " FROM dn_long GROUP BY scene, r, c)"
)


def indexed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(scene, r, c, vv, vh, mndwi, ndvi, ndbi and their denominators)"""
    s = scene(spark, sf_dir)
    b = [F.col(f"b{k}") for k in range(12)]
    return s.select(
        "scene", "r", "c", F.col("b6").alias("vv"), F.col("b7").alias("vh"),
        P.normalised_difference(b[3], b[2]).alias("ndvi"), P.normalised_difference(b[1], b[4]).alias("mndwi"),
        P.normalised_difference(b[4], b[3]).alias("ndbi"), (b[3] + b[2]).alias("ndvi_den"), (b[4] + b[3]).alias("ndbi_den"),
    )


def _nd(a: str, b: str) -> str:
    return csql(f"({a} - {b}) / ({a} + {b} + 1e-6)", "-1.0", "1.0")


INDEXED = (
    SCENE
    + f""",
indexed AS (SELECT scene, r, c, b6 AS vv, b7 AS vh, {_nd('b3', 'b2')} AS ndvi, {_nd('b1', 'b4')} AS mndwi,
            {_nd('b4', 'b3')} AS ndbi, b3 + b2 AS ndvi_den, b4 + b3 AS ndbi_den FROM scene)"""
)


def stack(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(cluster_id, year, r, c, p, port, water_prob, area_m2) on a full 16 x 16 grid."""
    li = table(spark, sf_dir, "lineitem").select(
        (F.col("l_suppkey") % 4).cast("int").alias("cluster_id"), F.year("l_shipdate").alias("year"),
        (F.col("l_partkey") % 16).cast("int").alias("r"), (F.col("l_orderkey") % 16).cast("int").alias("c"),
    )
    counts = li.groupBy("cluster_id", "year", "r", "c").agg(F.count("*").alias("n"))
    side = F.sequence(F.lit(0), F.lit(15))
    grid = counts.select("cluster_id", "year").distinct()
    grid = grid.withColumn("r", F.explode(side)).withColumn("c", F.explode(side))
    full = grid.join(counts, ["cluster_id", "year", "r", "c"], "left").fillna(0, ["n"])
    top = F.max("n").over(Window.partitionBy("cluster_id", "year"))
    scored = full.withColumn("p", F.col("n").cast("double") / top)
    return scored.select(
        "cluster_id", "year", "r", "c", "p", (F.col("p") >= 0.5).alias("port"), (1.0 - F.col("p")).alias("water_prob"),
        (100.0 + 0.1 * F.col("r")).alias("area_m2"),
    )


STACK = """counts AS (
  SELECT (l_suppkey % 4)::INTEGER AS cluster_id, year(l_shipdate)::INTEGER AS year, (l_partkey % 16)::INTEGER AS r,
         (l_orderkey % 16)::INTEGER AS c, count(*) AS n FROM lineitem GROUP BY ALL),
grid AS (SELECT cluster_id, year, r::INTEGER AS r, c::INTEGER AS c
         FROM (SELECT DISTINCT cluster_id, year FROM counts), range(16) AS a(r), range(16) AS b(c)),
stack AS (
  SELECT cluster_id, year, r, c, p, p >= 0.5 AS port, 1.0 - p AS water_prob, 100.0::DOUBLE + 0.1::DOUBLE * r AS area_m2
  FROM (SELECT g.*, coalesce(n, 0)::DOUBLE / max(coalesce(n, 0)) OVER (PARTITION BY g.cluster_id, g.year) AS p
        FROM grid AS g LEFT JOIN counts USING (cluster_id, year, r, c)))"""


def pair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, gt, pred, batch, score)"""
    return table(spark, sf_dir, "labels").select(
        "doc_id", F.col("quality").alias("gt"), (1 - F.col("toxic")).alias("pred"),
        (F.col("doc_id") % 8).cast("int").alias("batch"), (((F.col("doc_id") * 37) % 101) / 100.0).alias("score"),
    )


PAIR = """pair AS (SELECT doc_id, quality AS gt, 1 - toxic AS pred, (doc_id % 8)::INTEGER AS batch,
                ((doc_id * 37) % 101)::DOUBLE / 100.0 AS score FROM labels)"""


def logits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(scene, r, c, bg, fg, p, gt): gt is null in the first row of a scene."""
    x = indexed(spark, sf_dir)
    mid = x.groupBy("scene").agg(F.percentile("mndwi", F.lit(0.5)).alias("mid"))
    gt = F.when(F.col("r") > 0, (F.col("mndwi") > F.col("mid")).cast("int"))
    out = x.join(mid, "scene").select("scene", "r", "c", F.col("vv").alias("bg"), F.col("vh").alias("fg"), gt.alias("gt"))
    return out.withColumn("p", P.softmax_fg(F.col("bg"), F.col("fg"))).withColumn("pred", P.argmax_class(F.col("bg"), F.col("fg")))


LOGITS = (
    INDEXED
    + """,
logits AS (
  SELECT scene, r, c, vv AS bg, vh AS fg, 1.0 / (1.0 + exp(vv - vh)) AS p, CASE WHEN vh > vv THEN 1 ELSE 0 END AS pred,
         CASE WHEN r > 0 THEN (mndwi > quantile_cont(mndwi, 0.5) OVER (PARTITION BY scene))::INTEGER END AS gt
  FROM indexed)"""
)


def series(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(user_id, day, p): a daily score."""
    e = table(spark, sf_dir, "events").select("user_id", F.dayofyear("ts").alias("day"), "value")
    return e.groupBy("user_id", "day").agg(F.avg(F.col("value") / (F.col("value") + 50.0)).alias("p"))


SERIES = """series AS (SELECT user_id, dayofyear(ts)::INTEGER AS day, avg(value / (value + 50.0)) AS p
            FROM events GROUP BY ALL)"""


def files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(path, name): file names of every kind a scan meets, from ``orders``."""
    k = F.col("o_orderkey")
    fields = [(k % 40), (k % 3), (F.lit(2014) + k % 14)]
    good = F.format_string("CLUSTER_%d_cluster_%d_%d_feat12_u16.tif", *fields)
    name = (
        F.when(k % 11 == 0, F.upper(good)).when(k % 13 == 0, F.concat(F.lit("x"), good))
        .when(k % 17 == 0, F.replace(good, F.lit(".tif"), F.lit(".png"))).otherwise(good)
    )
    return table(spark, sf_dir, "orders").select(F.concat(F.lit("/data/"), name).alias("path"), name.alias("name")).distinct()


FILES = """files AS (
  SELECT DISTINCT '/data/' || name AS path, name FROM (
    SELECT CASE WHEN k % 11 = 0 THEN upper(good) WHEN k % 13 = 0 THEN 'x' || good
                WHEN k % 17 = 0 THEN replace(good, '.tif', '.png') ELSE good END AS name
    FROM (SELECT o_orderkey AS k, printf('CLUSTER_%d_cluster_%d_%d_feat12_u16.tif', o_orderkey % 40, o_orderkey % 3,
                                         2014 + o_orderkey % 14) AS good FROM orders))),
parsed AS (
  SELECT name, path, TRY_CAST(regexp_extract(name, '@', 1) AS INTEGER) AS cluster_id, TRY_CAST(regexp_extract(name, '@', 2) AS INTEGER) AS uid,
         TRY_CAST(regexp_extract(name, '@', 3) AS INTEGER) AS year
  FROM files WHERE regexp_matches(name, '@')),
kept AS (SELECT * FROM parsed WHERE year BETWEEN 2017 AND 2025 AND cluster_id NOT IN (7, 8)),
catalog AS (
  SELECT cluster_id, first(uid ORDER BY name) AS cluster_uid FROM kept GROUP BY cluster_id),
scan AS (
  SELECT k.cluster_id, cluster_uid, year, last(path ORDER BY name) AS path
  FROM kept AS k JOIN catalog USING (cluster_id) GROUP BY ALL)""".replace("@", SCENE_NAME)


def regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(region, ports, area_2017, area_2025, seaward, landward)"""
    s, n, r = (table(spark, sf_dir, t) for t in ("supplier", "nation", "region"))
    li = table(spark, sf_dir, "lineitem").select("l_suppkey", F.year("l_shipdate").alias("y"), "l_quantity", "l_linenumber")
    q = lambda cond: F.sum(F.when(cond, F.col("l_quantity")).otherwise(0.0))
    old, new, sea = F.col("y") == 1995, F.col("y") == 2000, F.col("l_linenumber") == 1
    sums = li.groupBy("l_suppkey").agg(
        q(old).alias("area_2017"), q(new).alias("area_2025"), (q(new & sea) - q(old & sea)).alias("seaward"),
        (q(new & ~sea) - q(old & ~sea)).alias("landward"),
    )
    ports = s.join(sums, s["s_suppkey"] == sums["l_suppkey"], "left").fillna(0.0, ["area_2017", "area_2025", "seaward", "landward"])
    named = ports.join(n, ports["s_nationkey"] == n["n_nationkey"]).join(r, F.col("n_regionkey") == F.col("r_regionkey"))
    return named.select(F.col("r_name").alias("region"), F.lit(1).cast("long").alias("ports"), "area_2017", "area_2025", "seaward", "landward")


REGIONS = """sums AS (
  SELECT l_suppkey, sum(CASE WHEN y = 1995 THEN q ELSE 0 END) AS a, sum(CASE WHEN y = 2000 THEN q ELSE 0 END) AS b,
         sum(CASE WHEN ln = 1 AND y = 2000 THEN q WHEN ln = 1 AND y = 1995 THEN -q ELSE 0 END) AS s,
         sum(CASE WHEN ln <> 1 AND y = 2000 THEN q WHEN ln <> 1 AND y = 1995 THEN -q ELSE 0 END) AS l
  FROM (SELECT l_suppkey, year(l_shipdate) AS y, l_quantity AS q, l_linenumber AS ln FROM lineitem) GROUP BY ALL),
regions AS (
  SELECT r_name AS region, 1::BIGINT AS ports, coalesce(a, 0.0) AS area_2017, coalesce(b, 0.0) AS area_2025,
         coalesce(s, 0.0) AS seaward, coalesce(l, 0.0) AS landward
  FROM supplier LEFT JOIN sums ON l_suppkey = s_suppkey JOIN nation ON n_nationkey = s_nationkey
  JOIN region ON r_regionkey = n_regionkey)"""
