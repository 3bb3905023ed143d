"""Order statistics of scenes too large for one task: equal-width bins first, exact ranks inside the bins that matter.

No aggregation buffer and no window holds more of a scene than its bins or the
pixels of one bin, and the results are exact.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewright.functions.pixel import finite

#: Bins of a scene's values.
BINS = 1024


def quantiles(df: DataFrame, keys: list[str], wanted: dict[str, tuple[Column, float]], bins: int = BINS) -> DataFrame:
    """(keys, a column per name): exact quantiles with linear interpolation, NaN and null skipped; null where nothing is left.

    ``wanted`` names pairs of a value and a quantile.  The input is read three times: for ranges, for bins, and for the
    at most two bins of each quantile.
    """
    names = list(wanted)
    pairs = F.array(*[F.struct(F.lit(k).alias("_w"), finite(x).cast("double").alias("_x")) for k, (x, _) in enumerate(wanted.values())])
    long = df.select(*keys, F.inline(pairs))
    at = [*keys, "_w"]
    spans = long.groupBy(*at).agg(F.count("_x").alias("_n"), F.min("_x").alias("_lo"), F.max("_x").alias("_hi"))
    place = F.floor((F.col("_x") - F.col("_lo")) / (F.col("_hi") - F.col("_lo")) * float(bins))
    bin_ = F.when(F.col("_hi") > F.col("_lo"), F.least(place, F.lit(bins - 1))).otherwise(F.lit(0)).cast("int")
    binned = long.where(F.col("_x").isNotNull()).join(spans, at).select(*at, "_x", bin_.alias("_b"))
    counts = binned.groupBy(*at, "_b").agg(F.count("*").alias("_c"))
    before = Window.partitionBy(*at).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    q = F.element_at(F.array(*[F.lit(float(q)) for _, q in wanted.values()]), F.col("_w") + 1)
    ranked = counts.withColumn("_before", F.coalesce(F.sum("_c").over(before), F.lit(0))).join(spans.select(*at, "_n"), at)
    ranked = ranked.withColumn("_h", q * (F.col("_n") - 1))
    inside = lambda r, first, size: (r >= F.col(first)) & (r < F.col(first) + F.col(size))
    holds = inside(F.floor("_h"), "_before", "_c") | inside(F.ceil("_h"), "_before", "_c")
    few = ranked.where(holds).select(*at, "_b", "_before", "_h")
    values = binned.join(few, [*at, "_b"]).groupBy(*at, "_b", "_before", "_h", "_x").agg(F.count("*").alias("_m"))
    upto = Window.partitionBy(*at, "_b").orderBy("_x").rowsBetween(Window.unboundedPreceding, -1)
    placed = values.withColumn("_first", F.col("_before") + F.coalesce(F.sum("_m").over(upto), F.lit(0)))
    low = F.max(F.when(inside(F.floor("_h"), "_first", "_m"), F.col("_x")))
    high = F.max(F.when(inside(F.ceil("_h"), "_first", "_m"), F.col("_x")))
    h = F.first("_h")
    value = F.when(F.ceil(h) == F.floor(h), low).otherwise((F.ceil(h) - h) * low + (h - F.floor(h)) * high)
    found = placed.groupBy(*at).agg(value.alias("_v"))
    return spans.select(*at).join(found, at, "left").groupBy(*keys).agg(*[F.max(F.when(F.col("_w") == k, F.col("_v"))).alias(n) for k, n in enumerate(names)])


def with_quantiles(df: DataFrame, keys: list[str], wanted: dict[str, tuple[Column, float]], bins: int = BINS) -> DataFrame:
    """``df`` with per-scene quantiles as columns."""
    return df.join(quantiles(df, keys, wanted, bins), keys)


def running_sums(df: DataFrame, keys: list[str], falling: str, tie: list[str], sums: dict[str, Column], bins: int = BINS) -> DataFrame:
    """``df`` with sums over the rows of a group up to each row, in falling order of ``falling`` (0 to 1), then of ``tie``."""
    place = F.least(F.floor((1.0 - F.col(falling)) * float(bins)), F.lit(bins - 1)).cast("int")
    binned = df.withColumn("_b", F.greatest(place, F.lit(0)))
    whole = binned.groupBy(*keys, "_b").agg(*[F.sum(v).alias(f"_s_{n}") for n, v in sums.items()])
    before = Window.partitionBy(*keys).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    starts = whole.select(*keys, "_b", *[F.coalesce(F.sum(f"_s_{n}").over(before), F.lit(0)).alias(f"_s_{n}") for n in sums])
    upto = Window.partitionBy(*keys, "_b").orderBy(F.desc(falling), *tie).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    joined = binned.join(starts, [*keys, "_b"])
    return joined.withColumns({n: F.col(f"_s_{n}") + F.sum(v).over(upto) for n, v in sums.items()}).drop("_b", *[f"_s_{n}" for n in sums])
