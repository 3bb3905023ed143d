"""Year-by-year operators on pixel series: window functions, one shuffle by pixel."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewright.functions import constants as K
from tidewright.functions.pixel import clip


def _series(keys: list[str], time: str):
    return Window.partitionBy(*keys).orderBy(time)


def temporal_smooth(value: Column, keys: list[str], time: str = "year", weights=K.TEMPORAL_WEIGHTS) -> Column:
    """Centred weighted mean of neighbouring years; missing ones at the ends drop their weight.

    A series of one year is returned as it is, others are clipped to [0, 1].
    """
    w, half = _series(keys, time), len(weights) // 2
    taps = [(F.lag(value, half - k).over(w), g) for k, g in enumerate(weights)]
    add = lambda parts: reduce(lambda a, b: a + b, parts)
    total = add([F.when(x.isNotNull(), g).otherwise(0.0) for x, g in taps])
    mean = F.when(total > 1e-8, add([F.coalesce(x * g, F.lit(0.0)) for x, g in taps]) / total).otherwise(value)
    return F.when(F.count("*").over(Window.partitionBy(*keys)) <= 1, value).otherwise(clip(mean, 0, 1))


def decline(value: Column, keys: list[str], time: str = "year") -> Column:
    before = F.coalesce(F.lag(value).over(_series(keys, time)), value)
    return clip(before - value, 0, 1)


def persistent_decline(df: DataFrame, value: str, keys: list[str], time: str = "year", years: int = K.RETREAT_YEARS) -> DataFrame:
    """``df`` with ``decline``: the least one-year decline of this and the next ``years - 1`` years.

    At the tail the frame is cut short, which equals padding with the last
    decline.
    """
    frame = _series(keys, time).rowsBetween(0, max(1, years) - 1)
    one = df.withColumn("_d", decline(F.col(value), keys, time))
    return one.withColumn("decline", F.min("_d").over(frame)).drop("_d")


def previous(value: Column, keys: list[str], time: str = "year") -> Column:
    """The year before; the first year is compared with itself."""
    return F.coalesce(F.lag(value).over(_series(keys, time)), value)


def base(value: Column, keys: list[str], time: str = "year") -> Column:
    """The first year's value."""
    return F.first(value).over(_series(keys, time).rowsBetween(Window.unboundedPreceding, Window.currentRow))


def early_max(df: DataFrame, keys: list[str], value: str, scene: list[str], time: str = "year", years: int = 2) -> DataFrame:
    """(keys, value): greatest value of a scene's first ``years`` years, 0 at least."""
    ranked = df.select(*scene, time).distinct().withColumn("_k", F.row_number().over(_series(scene, time)))
    early = ranked.where(F.col("_k") <= years).drop("_k")
    found = df.join(early, [*scene, time]).groupBy(*keys).agg(F.max(value).alias(value))
    return found.withColumn(value, F.greatest(F.coalesce(value, F.lit(0.0)), F.lit(0.0)))


def ema(df: DataFrame, keys: list[str], value: str, time: str, keep: float = 0.999) -> DataFrame:
    """(keys, ema): e <- keep * e + (1 - keep) * x over ordered values, from the first.

    Closed form as a weighted sum, so it is one aggregation whatever the length:
    the k-th of n values counts (1 - keep) * keep^(n - k), the first keep^(n - 1).
    """
    n = F.count("*").over(Window.partitionBy(*keys))
    k = F.row_number().over(_series(keys, time))
    share = F.when(k == 1, 1.0).otherwise(1.0 - keep)
    weighted = df.withColumn("_w", F.pow(F.lit(keep), n - k) * share)
    return weighted.groupBy(*keys).agg(F.sum(F.col("_w") * F.col(value)).alias("ema"))


def best_so_far(df: DataFrame, keys: list[str], value: str, time: str) -> DataFrame:
    """``df`` with best_before and is_best: strictly better than all before (and than 0 at first)."""
    frame = _series(keys, time).rowsBetween(Window.unboundedPreceding, -1)
    before = F.coalesce(F.max(value).over(frame), F.lit(0.0))
    return df.withColumn("best_before", before).withColumn("is_best", F.col(value) > F.col("best_before"))
