"""Scene-adaptive thresholds: quantiles per scene, joined back to its pixels.

The statistics side has one row per scene.  It is joined by scene key with no
forced hint: Spark broadcasts it while it is small, and splits a scene that is
far larger than the rest when it isn't.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewright.functions import constants as K
from tidewright.functions.pixel import clip, finite, sigmoid
from tidewright.operators.ranks import quantiles, with_quantiles


def with_statistics(df: DataFrame, keys: list[str], stats: dict[str, Column]) -> DataFrame:
    """``df`` with per-scene aggregates as columns."""
    found = df.groupBy(*keys).agg(*[v.alias(k) for k, v in stats.items()])
    return df.join(found, keys)


def intensity(vv: Column, vh: Column) -> Column:
    return F.sqrt(vv * vv + vh * vh + 1e-6)


def water_probability(df: DataFrame, keys: list[str], mndwi: str = "mndwi", vv: str = "vv", vh: str = "vh") -> DataFrame:
    """``df`` with thr_m, thr_i and water_prob: wet by index and dark by radar, both."""
    m, i = F.col(mndwi), intensity(F.col(vv), F.col(vh))
    with_i = df.withColumn("intensity", i)
    found = with_quantiles(with_i, keys, {"thr_m": (m, K.WATER_QUANTILE), "thr_i": (F.col("intensity"), K.INTENSITY_QUANTILE)})
    found = found.withColumns({"thr_m": F.coalesce("thr_m", F.lit(0.0)), "thr_i": F.coalesce("thr_i", F.lit(0.1))})
    prob = sigmoid((m - F.col("thr_m")) * K.WATER_SLOPE) * sigmoid(
        (F.col("thr_i") - F.col("intensity")) * K.INTENSITY_SLOPE
    )
    safe = F.when(F.isnan(prob) | prob.isNull(), 0.0).otherwise(clip(prob, 0, 1))
    return found.withColumn("water_prob", safe).drop("intensity")


def water_mask_quantile(df: DataFrame, keys: list[str], mndwi: str = "mndwi", q: float = K.WATER_QUANTILE) -> DataFrame:
    found = with_quantiles(df, keys, {"thr": (F.col(mndwi), q)}).withColumn("thr", F.coalesce("thr", F.lit(K.WATER_FIXED)))
    return found.withColumn("water", F.col(mndwi) > F.col("thr"))


def water_mask_fixed(df: DataFrame, mndwi: str = "mndwi", thr: float = K.WATER_FIXED) -> DataFrame:
    return df.withColumn("thr", F.lit(thr)).withColumn("water", F.col(mndwi) > thr)


def otsu_thresholds(df: DataFrame, keys: list[str], value: str = "mndwi") -> DataFrame:
    """(keys, thr): Otsu's threshold of values stretched to 256 steps between two percentiles.

    A histogram of at most 256 rows a scene carries everything after the first
    aggregation; a flat scene takes the fixed threshold.
    """
    x = F.col(value)
    ranged = with_quantiles(df, keys, {"p1": (x, K.OTSU_LOW / 100), "p99": (x, K.OTSU_HIGH / 100)})
    scaled = (clip(x, F.col("p1"), F.col("p99")) - F.col("p1")) / (F.col("p99") - F.col("p1") + 1e-6) * 255.0
    bins = ranged.withColumn("bin", clip(scaled, 0, 255).cast("int"))
    counts = bins.groupBy(*keys, "p1", "p99", "bin").agg(F.count("*").alias("n"))
    so_far = Window.partitionBy(*keys).orderBy("bin")
    whole = Window.partitionBy(*keys)
    summed = counts.select(
        *keys, "p1", "p99", "bin",
        F.sum("n").over(so_far).alias("n0"),
        F.sum(F.col("n") * F.col("bin")).over(so_far).alias("s0"),
        F.sum("n").over(whole).alias("n"),
        F.sum(F.col("n") * F.col("bin")).over(whole).alias("s"),
    )
    n0, n1 = F.col("n0"), F.col("n") - F.col("n0")
    gap = F.col("s0") / n0 - (F.col("s") - F.col("s0")) / F.greatest(n1, F.lit(1))
    between = F.when(n1 > 0, n0 * n1 * gap * gap).otherwise(0.0)
    best = summed.withColumn("between", F.round(between, 6)).groupBy(*keys, "p1", "p99").agg(
        F.max_by("bin", F.struct("between", -F.col("bin"))).alias("t")
    )
    flat = F.col("p99") <= F.col("p1") + 1e-6
    thr = F.when(flat, K.WATER_FIXED).otherwise(F.col("p1") + F.col("t") / 255.0 * (F.col("p99") - F.col("p1")))
    return best.select(*keys, thr.alias("thr"), flat.alias("flat"))


def index_water(df: DataFrame, keys: list[str], mndwi: str = "mndwi", dynamic: bool = True) -> DataFrame:
    """``df`` with ``a_water``: wetness relative to the sample's own quantile, or to the fixed threshold."""
    found = with_quantiles(df, keys, {"thr": (F.col(mndwi), K.WATER_QUANTILE)}) if dynamic else df.withColumn("thr", F.lit(K.WATER_FIXED))
    return found.withColumn("a_water", sigmoid((F.col(mndwi) - F.col("thr")) * K.WATER_SLOPE))


def summarize(df: DataFrame, keys: list[str], value: str, probes=K.PROBES) -> DataFrame:
    """(keys, n, mean, std, min, max, percentiles) of a column; all null where there is nothing."""
    x = finite(F.col(value))
    aggs = [
        F.count(x).alias("n"),
        F.avg(x).alias("mean"),
        F.stddev_pop(x).alias("std"),
        F.min(x).alias("min"),
        F.max(x).alias("max"),
        F.percentile(x, F.array(*[F.lit(float(p)) for p in probes])).alias("percentiles"),
    ]
    return df.groupBy(*keys).agg(*aggs) if keys else df.agg(*aggs)


def rgb_stretch(df: DataFrame, keys: list[str], channels: tuple[str, str, str]) -> DataFrame:
    """``df`` with red, green, blue bytes, stretched between the 2nd and 98th percentile of all three."""
    long = df.select(*keys, F.explode(F.array(*channels)).alias("v"))
    found = quantiles(long, keys, {"lo": (F.col("v"), 0.02), "hi": (F.col("v"), 0.98)})
    joined = df.join(found, keys)
    scaled = lambda c: clip((F.col(c) - F.col("lo")) / (F.col("hi") - F.col("lo") + 1e-6), 0, 1) * 255.0
    names = ("red", "green", "blue")
    # truncated as a byte cast does, but not one lower for the last bit of a quantile
    return joined.withColumns({n: (scaled(c) + 1e-9).cast("int") for n, c in zip(names, channels, strict=True)}).drop("lo", "hi")


def overlay(df: DataFrame, mask: str, colour: tuple[int, int, int], share: float = K.OVERLAY_SHARE) -> DataFrame:
    """Blend a colour into red, green, blue where ``mask`` holds."""
    names = ("red", "green", "blue")
    return df.withColumns({
        n: F.when(F.col(mask), (F.col(n) * (1.0 - share) + F.lit(float(v * share))).cast("int")).otherwise(F.col(n))
        for n, v in zip(names, colour, strict=True)
    })


def heat(df: DataFrame, value: str, top: float = K.COASTAL_ALPHA) -> DataFrame:
    """``df`` with red, green, blue of weights from 1 (blue) over green to 1 + ``top`` (red), in 256 steps."""
    step = F.floor(clip((F.col(value) - 1.0) / max(1e-6, top), 0, 1) * 255.0) / 255.0
    ramp = lambda centre: F.round(clip(1.5 - F.abs(4.0 * step - centre), 0, 1) * 255.0).cast("int")
    return df.withColumns({"red": ramp(3.0), "green": ramp(2.0), "blue": ramp(1.0)})
