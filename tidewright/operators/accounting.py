"""Area accounting by direction, and the regional rollup."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewright.functions import constants as K
from tidewright.operators import stencil, temporal

#: Tolerance in square metres of the identities between directions and totals.
IDENTITY = 1e-3


def mask_area(df: DataFrame, keys: list[str], mask: str, area: str = "area_m2") -> DataFrame:
    """(keys, px, mask_area_m2): pixels per row first, then one product a row, in row order of magnitude."""
    rows = df.where(F.col(mask)).groupBy(*keys, "r").agg(F.count("*").alias("_n"), F.first(area).alias("_a"))
    return rows.groupBy(*keys).agg(F.sum("_n").alias("px"), F.sum(F.col("_n") * F.col("_a")).alias("mask_area_m2"))


def sea_domain(df: DataFrame, scene: list[str], port: str, water: str, threshold: float, time: str = "year", block: int = K.BLOCK) -> DataFrame:
    """(scene, r, c, sea): wet in one of the first two years, widened, and no port in the first."""
    at = [*scene, "r", "c"]
    wet = temporal.early_max(df, at, water, scene, time).select(*at, (F.col(water) >= threshold).alias("sea"))
    wide = stencil.dilate(wet, scene, "sea", K.SEA_DILATE // 2, block)
    first = df.withColumn("_base", temporal.base(F.col(port), at, time)).groupBy(*at).agg(F.first("_base").alias("_base"))
    return wide.join(first, at).select(*at, (F.col("sea") & ~F.col("_base")).alias("sea"))


def account(
    df: DataFrame,
    scene: list[str],
    port: str = "port",
    water: str = "water_prob",
    area: str = "area_m2",
    time: str = "year",
    threshold: float = K.SEA_WATER,
    block: int = K.BLOCK,
    flag: bool = False,
) -> DataFrame:
    """Area per scene and year and its change against the base and the previous year, by direction.

    One window by pixel compares years; conditional counts per raster row and
    two-level sums keep float sums short.  A broken identity raises; with
    ``flag`` a column ``broken`` tells of it instead.
    """
    at = [*scene, "r", "c"]
    sea = sea_domain(df, scene, port, water, threshold, time, block)
    now = F.col(port)
    compared = (
        df.withColumn("_base", temporal.base(now, at, time))
        .withColumn("_prev", temporal.previous(now, at, time))
        .join(sea, at)
    )
    one = lambda b: b.cast("int")
    change = one(now) - one(F.col("_base"))
    step = one(now) - one(F.col("_prev"))
    counts = {
        "area_m2": one(now),
        "base_m2": one(F.col("_base")),
        "prev_m2": one(F.col("_prev")),
        "seaward_net_change_m2_from_base": F.when(F.col("sea"), change).otherwise(0),
        "landward_net_change_m2_from_base": F.when(~F.col("sea"), change).otherwise(0),
        "annual_seaward_net_change_m2": F.when(F.col("sea"), step).otherwise(0),
        "annual_landward_net_change_m2": F.when(~F.col("sea"), step).otherwise(0),
    }
    rows = compared.groupBy(*scene, time, "r").agg(
        F.first(area).alias("_a"), *[F.sum(v).alias(f"_{k}") for k, v in counts.items()]
    )
    sums = rows.groupBy(*scene, time).agg(*[F.sum(F.col(f"_{k}") * F.col("_a")).alias(k) for k in counts])
    total = F.col("seaward_net_change_m2_from_base") + F.col("landward_net_change_m2_from_base")
    yearly = F.col("annual_seaward_net_change_m2") + F.col("annual_landward_net_change_m2")
    off = (F.abs(total - (F.col("area_m2") - F.col("base_m2"))) > IDENTITY) | (
        F.abs(yearly - (F.col("area_m2") - F.col("prev_m2"))) > IDENTITY
    )
    checked = total if flag else F.when(off, F.raise_error(F.lit("directional area identity failed")).cast("double")).otherwise(total)
    first_year = F.min(time).over(Window.partitionBy(*scene))
    return sums.select(
        *scene,
        time,
        first_year.alias("base_year"),
        F.lit("WGS84 pixel area by raster row").alias("area_method"),
        "area_m2",
        "seaward_net_change_m2_from_base",
        "landward_net_change_m2_from_base",
        checked.alias("total_net_change_m2_from_base"),
        "annual_seaward_net_change_m2",
        "annual_landward_net_change_m2",
        yearly.alias("annual_total_net_change_m2"),
        *([off.alias("broken")] if flag else []),
    )


def rows_of_arrays(df: DataFrame, keys: list[str], arrays: list[str]) -> DataFrame:
    """Parallel arrays to rows, in order."""
    return df.select(*keys, F.inline(F.arrays_zip(*arrays)))


def arrays_of_rows(df: DataFrame, keys: list[str], time: str, values: list[str]) -> DataFrame:
    """Rows to parallel arrays ordered by ``time``; a series' length bounds the arrays."""
    packed = df.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct(time, *values))).alias("_rows"))
    return packed.select(*keys, *[F.col(f"_rows.{c}").alias(c) for c in [time, *values]])


def landward_share(net: Column, landward: Column) -> Column:
    """Percent of a net gain that is landward; null where there is no net gain."""
    return F.when(net > 0, 100.0 * landward / net)


def regional_rollup(df: DataFrame, region: str = "region") -> DataFrame:
    """Sums by region and a ``Global`` row (columns ports, area_2017, area_2025, seaward, landward)."""
    sums = [F.sum(c).alias(c) for c in ("ports", "area_2017", "area_2025", "seaward", "landward")]
    rolled = df.rollup(region).agg(*sums, F.grouping(region).alias("_all"))
    net = F.col("area_2025") - F.col("area_2017")
    return rolled.select(
        F.when(F.col("_all") == 1, "Global").otherwise(F.col(region)).alias(region),
        "ports", "area_2017", "area_2025", net.alias("net_change"), "seaward", "landward",
        landward_share(net, F.col("landward")).alias("landward_share_pct"),
    )
