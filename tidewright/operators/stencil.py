"""Neighbourhood operators: morphology by tile kernels, the rest by windows."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidewright.functions import constants as K
from tidewright.functions import kernels as N
from tidewright.operators.tiles import apply_tiles
from tidewright.tables import cut, drop


def _morph(df: DataFrame, keys: list[str], mask: str, kernel, reach: int, block: int) -> DataFrame:
    return apply_tiles(df, keys, [mask], {mask: "boolean"}, kernel, reach, block)


def close_open(df: DataFrame, keys: list[str], mask: str, close_r: int = K.CLOSE_R, open_r: int = K.OPEN_R, block: int = K.BLOCK) -> DataFrame:
    """Closing, then opening, with elliptic elements; the halo covers all four steps."""
    reach = 2 * (close_r + open_r)
    return _morph(df, keys, mask, lambda p, m: (N.close_open(m, p, close_r, open_r),), reach, block)


def dilate(df: DataFrame, keys: list[str], mask: str, radius: int = K.SEA_DILATE // 2, block: int = K.BLOCK) -> DataFrame:
    return _morph(df, keys, mask, lambda p, m: (N.dilate(m, p, radius),), radius, block)


def edge_target(df: DataFrame, keys: list[str], mask: str, widen: int = 1, block: int = K.BLOCK) -> DataFrame:
    """Gradient of a mask, widened by ``widen`` pixels."""
    return _morph(df, keys, mask, lambda p, m: (N.edge_band(m, p, widen),), 1 + widen, block)


def boundary_ignore(df: DataFrame, keys: list[str], mask: str, radius: int = 2, block: int = K.BLOCK) -> DataFrame:
    """Band around a mask's border; none for a radius of 0 and for scenes all of one kind."""
    if radius <= 0:
        return df.select(*keys, "r", "c", F.lit(False).alias(mask))
    band = edge_target(df, keys, mask, radius, block)
    mixed = df.groupBy(*keys).agg((F.bool_or(mask) & ~F.bool_and(mask)).alias("mixed"))
    return band.join(mixed, keys).select(*keys, "r", "c", (F.col(mask) & F.col("mixed")).alias(mask))


def local_variance(df: DataFrame, keys: list[str], value: str, size: int = 5) -> DataFrame:
    """``df`` with local_var: E[x^2] - E[x]^2 over a square; zeros outside the image count."""
    half, n = size // 2, float(size * size)
    down = Window.partitionBy(*keys, "c").orderBy("r").rangeBetween(-half, half)
    across = Window.partitionBy(*keys, "r").orderBy("c").rangeBetween(-half, half)
    x = F.col(value)
    first = df.withColumn("_s", F.sum(x).over(down)).withColumn("_q", F.sum(x * x).over(down))
    mean, square = F.sum("_s").over(across) / n, F.sum("_q").over(across) / n
    return first.withColumn("local_var", F.greatest(square - mean * mean, F.lit(0.0))).drop("_s", "_q")


def contrast_weights(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """``df`` with contrast: 1 + gain * exp(-gradient / decay), the gradient scaled per slice."""
    def slope(axis: str, other: str):
        w = Window.partitionBy(*keys, other).orderBy(axis)
        x, a, b = F.col(value), F.lag(value).over(w), F.lead(value).over(w)
        inside = (b - a) / 2.0
        return F.coalesce(inside, b - x, x - a, F.lit(0.0))

    graded = df.withColumn("_gy", slope("r", "c")).withColumn("_gx", slope("c", "r"))
    graded = graded.withColumn("_g", F.sqrt(F.col("_gy") * F.col("_gy") + F.col("_gx") * F.col("_gx")))
    top = graded.groupBy(*keys).agg(F.max("_g").alias("_top"))
    scaled = F.col("_g") / (F.col("_top") + 1e-6)
    weight = 1.0 + K.CONTRAST_GAIN * F.exp(-scaled / K.CONTRAST_DECAY)
    return graded.join(top, keys).withColumn("contrast", weight).drop("_gy", "_gx", "_g", "_top")


def aniso_weights(df: DataFrame, dist_m: str, contrast: str = "contrast") -> DataFrame:
    near = K.ANISO_BASE + K.ANISO_GAIN * F.exp(-F.col(dist_m) / K.ANISO_DECAY_M)
    return df.withColumn("weight", near * F.col(contrast))


def strip_pool(df: DataFrame, keys: list[str], value: str, row_gain: float = 1.0, col_gain: float = 1.0) -> DataFrame:
    """``df`` with ``pooled``: the value plus gains times its row's and its column's mean."""
    rows = df.groupBy(*keys, "r").agg(F.avg(value).alias("_row"))
    cols = df.groupBy(*keys, "c").agg(F.avg(value).alias("_col"))
    joined = df.join(rows, [*keys, "r"]).join(cols, [*keys, "c"])
    return joined.withColumn("pooled", F.col(value) + row_gain * F.col("_row") + col_gain * F.col("_col")).drop("_row", "_col")


def affine_warp(df: DataFrame, keys: list[str], value: str, degrees: float, scale: float, dr: float, dc: float, nearest: bool = False) -> DataFrame:
    """Warp whole samples (training crops, of bounded size) about their centre."""
    kernel = lambda p, x: (N.affine_warp(x, degrees, scale, dr, dc, nearest),)
    return apply_tiles(df, keys, [value], {value: "double"}, kernel, 0, 1 << 30)


def distance_to(df: DataFrame, keys: list[str], mask: str, block: int | None = None, reach: int = 96) -> DataFrame:
    """(keys, r, c, dist_px): chamfer distance to the nearest set pixel.

    Whole scenes by default, a task each.  With ``block`` tiles work together:
    first each with a halo of ``reach`` pixels, then the tiles' outer rings of
    pixels are exchanged between neighbours until no distance changes, as many
    rounds as tiles lie between a pixel and the reach of its nearest source.
    Only rings move in a round, and the result is that of whole scenes.
    """
    if block is None:
        return apply_tiles(df, keys, [mask], {"dist_px": "double"}, lambda p, m: (N.chamfer(m & p),), 0, 1 << 30)

    def near(p: np.ndarray, m: np.ndarray) -> tuple[np.ndarray]:
        return (N.relax(np.where(m & p, 0.0, np.inf)),)

    def further(p: np.ndarray, d: np.ndarray) -> tuple[np.ndarray]:
        return (N.relax(np.where(p, d, np.inf)),)

    outer = [(F.col(x) % block == 0) | (F.col(x) % block == block - 1) for x in ("r", "c")]
    ring = cut(apply_tiles(df, keys, [mask], {"d": "double"}, near, reach, block).where(outer[0] | outer[1]), "ring")
    state = F.bit_xor(F.xxhash64(*keys, "r", "c", "d"))
    seen = ring.agg(state).first()[0]
    while True:
        moved = cut(apply_tiles(ring, keys, ["d"], {"d": "double"}, further, 1, block), "ring")
        drop(ring)
        ring, last, seen = moved, seen, moved.agg(state).first()[0]
        if seen == last:
            break
    known = F.when(F.col(mask), 0.0).otherwise(F.coalesce("d", F.lit(float("inf"))))
    joined = df.select(*keys, "r", "c", mask).join(ring, [*keys, "r", "c"], "left").withColumn("d", known)
    found = apply_tiles(joined, keys, ["d"], {"dist_px": "double"}, further, 1, block)
    # rounded: sums of steps differ in the last bits with the way they were taken
    far = F.when(F.col("dist_px") < float("inf"), F.round("dist_px", 9)).otherwise(K.NO_WATER_PX)
    return found.withColumn("dist_px", far)
