"""Tiles with halo: the way neighbourhood kernels run on a cluster.

A pixel table is dealt to square blocks; each block also gets the pixels
within ``pad`` of it.  A group is one block, so a task's memory is bounded by
``(block + 2 * pad)^2`` pixels whatever the scene's size.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewright.functions import constants as K


def _blocks(x: str, block: int, pad: int) -> Column:
    at = lambda v: F.floor(v / block).cast("int")
    span = F.sequence(at(F.col(x) - pad), at(F.col(x) + pad))
    return F.explode(F.filter(span, lambda b: b >= 0))


def halo_blocks(df: DataFrame, block: int = K.BLOCK, pad: int = K.PAD) -> DataFrame:
    """``df`` with block numbers br, bc, a row per block that holds the pixel or its halo."""
    return df.withColumn("br", _blocks("r", block, pad)).withColumn("bc", _blocks("c", block, pad))


def apply_tiles(
    df: DataFrame,
    keys: list[str],
    inputs: list[str],
    outputs: dict[str, str],
    kernel: Callable[..., tuple[np.ndarray, ...]],
    pad: int,
    block: int = K.BLOCK,
    time: str | None = None,
    origin: bool = False,
) -> DataFrame:
    """Run ``kernel(present, *inputs)`` on every tile; (keys, r, c, outputs).  With ``origin`` it gets the tile's first row and column too.

    Arrays are 2-D, or with ``time`` 3-D with the tile's sorted times first
    (then ``time`` is a result column too).  Missing pixels are 0 or False and
    not ``present``.  The kernel returns an array per output; pixels of the
    block itself that are present come out.
    """
    times = [time] if time else []
    schema = T.StructType(
        [df.schema[k] for k in [*keys, *times, "r", "c"]]
        + [T.StructField(n, T._parse_datatype_string(t)) for n, t in outputs.items()]
    )
    names = list(outputs)
    boolean = {c for c in inputs if isinstance(df.schema[c].dataType, T.BooleanType)}

    def run(group: pd.DataFrame) -> pd.DataFrame:
        br, bc = int(group["br"].iloc[0]), int(group["bc"].iloc[0])
        if not ((group["r"] // block == br) & (group["c"] // block == bc)).any():
            return pd.DataFrame({f.name: [] for f in schema}).astype({k: group[k].dtype for k in [*keys, *times, "r", "c"]})
        r0, c0 = int(group["r"].min()), int(group["c"].min())
        shape = (int(group["r"].max()) - r0 + 1, int(group["c"].max()) - c0 + 1)
        at = (group["r"].to_numpy() - r0, group["c"].to_numpy() - c0)
        if time:
            years, t = np.unique(group[time].to_numpy(), return_inverse=True)
            shape, at = (len(years), *shape), (t, *at)
        present = np.zeros(shape, bool)
        present[at] = True
        fields = []
        for c in inputs:
            a = np.zeros(shape, bool if c in boolean else float)
            a[at] = group[c].fillna(False if c in boolean else 0.0).to_numpy(a.dtype)
            fields.append(a)
        made = kernel(present, *fields, *((r0, c0) if origin else ()))
        where = np.nonzero(present)
        rr, cc = where[-2] + r0, where[-1] + c0
        own = (rr // block == br) & (cc // block == bc)
        out = {k: group[k].iloc[0] for k in keys}
        if time:
            out[time] = years[where[0]][own]
        out |= {"r": rr[own], "c": cc[own]}
        out |= {n: a[where][own] for n, a in zip(names, made, strict=True)}
        return pd.DataFrame(out)

    tiles = halo_blocks(df.select(*keys, *times, "r", "c", *inputs), block, pad)
    return tiles.groupBy(*keys, "br", "bc").applyInPandas(run, schema)


def tile_cover(df: DataFrame, patch: int = K.PATCH, stride: int = K.STRIDE) -> DataFrame:
    """``df`` with tile origins y0, x0: every overlapping patch that covers the pixel.

    Origins are the multiples of ``stride`` from 0; a pixel meets at most
    ``ceil(patch / stride)`` of them a way, so this is an explode, not a join.
    """
    def origins(x: str) -> Column:
        last = F.floor(F.col(x) / stride).cast("int")
        first = F.greatest(F.floor((F.col(x) - patch) / stride).cast("int") + 1, F.lit(0))
        return F.explode(F.transform(F.sequence(first, last), lambda k: k * stride))

    return df.withColumn("y0", origins("r")).withColumn("x0", origins("c"))


def overlap_blend(tiles: DataFrame, keys: list[str], prob: str = "p", weight: str = "w") -> DataFrame:
    """Weighted mean of overlapping tile scores per pixel, clipped to [0, 1]."""
    blended = F.sum(F.col(prob) * F.col(weight)) / (F.sum(weight) + 1e-6)
    return tiles.groupBy(*keys, "r", "c").agg(F.least(F.greatest(blended, F.lit(0.0)), F.lit(1.0)).alias(prob))


def crop(df: DataFrame, top: int, left: int, height: int, width: int) -> DataFrame:
    inside = F.col("r").between(top, top + height - 1) & F.col("c").between(left, left + width - 1)
    return df.where(inside).withColumns({"r": F.col("r") - top, "c": F.col("c") - left})


def center_crop(df: DataFrame, height: int, width: int, size: int) -> DataFrame:
    return crop(df, max(0, (height - size) // 2), max(0, (width - size) // 2), min(size, height), min(size, width))


def reflect_pad(df: DataFrame, height: int, width: int, patch: int) -> DataFrame:
    """Pad below and to the right to ``patch``: mirrored, or repeated for a side of one pixel.

    Every pixel lists the places it fills, so nothing is joined.
    """
    def places(x: str, n: int) -> Column:
        if n >= patch:
            return F.explode(F.array(F.col(x)))
        span = F.sequence(F.lit(0), F.lit(patch - 1))
        if n == 1:
            return F.explode(span)
        cycle = 2 * (n - 1)
        mirror = lambda i: F.when(i % cycle < n, i % cycle).otherwise(cycle - i % cycle)
        return F.explode(F.filter(span, lambda i: mirror(i) == F.col(x)))

    out = df.withColumn("_r", places("r", height)).withColumn("_c", places("c", width))
    return out.withColumns({"r": F.col("_r").cast("int"), "c": F.col("_c").cast("int")}).drop("_r", "_c")


def flip(df: DataFrame, height: int, width: int, horizontal: bool = False, vertical: bool = False, turns: int = 0) -> DataFrame:
    """Mirror and then turn by 90 degrees counter-clockwise, by index arithmetic."""
    r = height - 1 - F.col("r") if vertical else F.col("r")
    c = width - 1 - F.col("c") if horizontal else F.col("c")
    for _ in range(turns % 4):
        r, c = width - 1 - c, r
        height, width = width, height
    return df.withColumns({"r": r.cast("int"), "c": c.cast("int")})


def bilinear_resize(df: DataFrame, keys: list[str], value: str, size: tuple[int, int], to: tuple[int, int]) -> DataFrame:
    """Resize without aligned corners: each target pixel blends its four source pixels.

    Source pixels list the targets they feed with their weights, so the plan is
    an explode and one aggregation.
    """
    def feeds(x: str, n: int, m: int) -> Column:
        def weight(i: Column) -> Column:
            s = F.greatest((i + 0.5) * (n / m) - 0.5, F.lit(0.0))
            low = F.least(F.floor(s).cast("int"), F.lit(n - 1))
            high = F.least(low + 1, F.lit(n - 1))
            f = s - low
            return F.when(F.col(x) == low, 1.0 - f).otherwise(0.0) + F.when(F.col(x) == high, f).otherwise(0.0)

        span = F.transform(F.sequence(F.lit(0), F.lit(m - 1)), lambda i: F.struct(i.alias("i"), weight(i).alias("w")))
        return F.explode(F.filter(span, lambda s: s["w"] > 0))

    fed = df.withColumn("a", feeds("r", size[0], to[0])).withColumn("b", feeds("c", size[1], to[1]))
    return fed.groupBy(*keys, F.col("a.i").alias("r"), F.col("b.i").alias("c")).agg(
        F.sum(F.col("a.w") * F.col("b.w") * F.col(value)).alias(value)
    )
