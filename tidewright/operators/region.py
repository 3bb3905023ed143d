"""Connected components and what is built on them.

Tiles label their own pixels by a run-based kernel, with the first pixel of
each component; labels of neighbouring tiles are united over the pixels along
the seams, a list as long as the seams, not the scene.  Seams are united level
by level: those inside a square of ``FAN`` by ``FAN`` tiles first, then those
inside a square of such squares, so no task holds all seams of a large scene.
No iteration over the pixel table takes place.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewright.functions import constants as K
from tidewright.functions import kernels as N
from tidewright.operators.ranks import quantiles
from tidewright.operators.tiles import apply_tiles
from tidewright.tables import cut

_ROW = 1 << 31  # label of a component: row * _ROW + column of its first pixel


def _united(group: pd.DataFrame) -> pd.DataFrame:
    """(keys, label, root) from one scene's seam pairs."""
    up: dict[int, int] = {}

    def find(x: int) -> int:
        while up.get(x, x) != x:
            up[x] = up.get(up[x], up[x])
            x = up[x]
        return x

    for a, b in zip(group["a"].tolist(), group["b"].tolist(), strict=True):
        a, b = find(a), find(b)
        up[max(a, b)] = min(a, b)
    labels = list(set(group["a"]) | set(group["b"]))
    keys = group.drop(columns=["a", "b"]).iloc[[0] * len(labels)].reset_index(drop=True)
    return keys.assign(label=labels, root=[find(x) for x in labels])


#: Tiles along one side of the square whose seams one task unites.
FAN = 16


def _seams(tiled: DataFrame, keys: list[str], block: int) -> DataFrame:
    """(keys, a, b, level, sr, sc): touching labels of different tiles, and the least square that holds both tiles."""
    edge = lambda x: (F.col(x) % block == 0) | (F.col(x) % block == block - 1)
    tile = [F.floor(F.col(x) / block).cast("int").alias(n) for x, n in (("r", "br"), ("c", "bc"))]
    rim = tiled.where(edge("r") | edge("c")).select(*keys, "r", "c", *tile, "label")
    steps = F.array(*[F.struct(F.lit(a).alias("dr"), F.lit(b).alias("dc")) for a, b in ((0, 1), (1, -1), (1, 0), (1, 1))])
    near = rim.select(*keys, F.col("br").alias("abr"), F.col("bc").alias("abc"), F.col("label").alias("a"), "r", "c", F.explode(steps).alias("s")).select(
        *keys, "abr", "abc", "a", (F.col("r") + F.col("s.dr")).alias("r"), (F.col("c") + F.col("s.dc")).alias("c"),
    )
    pairs = near.join(rim.withColumnRenamed("label", "b"), [*keys, "r", "c"]).where("abr != br or abc != bc")
    apart = lambda n: (F.floor(F.col("abr") / n) != F.floor(F.col("br") / n)) | (F.floor(F.col("abc") / n) != F.floor(F.col("bc") / n))
    level = F.lit(1)
    for k in range(1, 7):  # 16^6 tiles along a side are more than any scene has
        level = level + apart(FAN**k).cast("int")
    square = lambda x: F.floor(F.col(x) / F.pow(F.lit(float(FAN)), F.col("level"))).cast("int")
    return pairs.withColumn("level", level).select(*keys, "a", "b", "level", square("abr").alias("sr"), square("abc").alias("sc")).distinct()


def _roots(seams: DataFrame, keys: list[str], schema: T.StructType) -> DataFrame:
    """(keys, label, root) of all labels that touch another tile's, from squares of tiles to squares of squares."""
    levels = seams.agg(F.max("level")).first()[0] or 1
    roots = None
    for level in range(1, levels + 1):
        mine = seams.where(F.col("level") == level)
        if roots is not None:
            for end in ("a", "b"):
                known = roots.select(*keys, F.col("label").alias(end), F.col("root").alias("_r"))
                mine = mine.join(known, [*keys, end], "left").withColumn(end, F.coalesce("_r", end)).drop("_r")
            mine = mine.where("a != b").distinct()
        made = mine.groupBy(*keys, "sr", "sc").applyInPandas(lambda g: _united(g.drop(columns=["level", "sr", "sc"])), schema)
        if levels == 1:
            return made
        made = cut(made, "level-roots")
        if roots is not None:
            later = made.select(*keys, F.col("label").alias("root"), F.col("root").alias("_r"))
            moved = roots.join(later, [*keys, "root"], "left").select(*keys, "label", F.coalesce("_r", "root").alias("root"))
            made = cut(moved.unionByName(made.join(roots.select(*keys, "label"), [*keys, "label"], "left_anti")), "roots")
        roots = made
    return roots


def components(df: DataFrame, keys: list[str], mask: str, block: int = K.BLOCK) -> DataFrame:
    """(keys, r, c, label) of set pixels; ``label`` codes the component's first pixel in row-major order."""
    def kernel(present, m, r0, c0):
        lab = N.components(m & present)
        return ((r0 + lab // m.shape[1]) * _ROW + c0 + lab % m.shape[1],)

    set_pixels = df.where(F.col(mask)).select(*keys, "r", "c", mask)
    tiled = cut(apply_tiles(set_pixels, keys, [mask], {"label": "bigint"}, kernel, 0, block, origin=True), "tile-labels")
    schema = T.StructType([*(df.schema[k] for k in keys), T.StructField("label", T.LongType()), T.StructField("root", T.LongType())])
    seams = cut(_seams(tiled, keys, block), "seams")
    named = tiled.join(_roots(seams, keys, schema), [*keys, "label"], "left")
    return named.select(*keys, "r", "c", F.coalesce("root", "label").alias("label"))


def drop_small(df: DataFrame, keys: list[str], mask: str, least: str | int, block: int = K.BLOCK) -> DataFrame:
    """``df`` with components of fewer than ``least`` pixels (a number or a column) unset; 0 or less keeps all."""
    at = F.col(least) if isinstance(least, str) else F.lit(least)
    labelled = components(df, keys, mask, block)
    sized = labelled.join(labelled.groupBy(*keys, "label").agg(F.count("*").alias("_n")), [*keys, "label"])
    joined = df.join(sized.select(*keys, "r", "c", "_n"), [*keys, "r", "c"], "left")
    return joined.withColumn(mask, F.col(mask) & ((at <= 0) | (F.col("_n") >= at))).drop("_n")


def hysteresis(df: DataFrame, keys: list[str], prob: str, land: str, block: int = K.BLOCK) -> DataFrame:
    """``df`` with ``mask``: components of low-threshold land that hold a seed.

    Seeds reach the high threshold; in a scene without any, if it has more than
    1000 land pixels, seeds are those at its land's upper quantile (they need
    not reach the low threshold).
    """
    p, on = F.col(prob), F.col(land)
    stats = df.groupBy(*keys).agg(
        F.bool_or((p >= K.SEED_HIGH) & on).alias("_any"),
        F.count_if(on).alias("_land"),
    )
    # only scenes without a seed, and with much land, need the quantile of their land
    poor = df.join(stats.where(~F.col("_any") & (F.col("_land") > K.SEED_LAND_PX)).select(*keys), keys, "left_semi")
    stats = stats.join(quantiles(poor.where(on), keys, {"_q": (p, K.SEED_QUANTILE)}), keys, "left")
    bar = F.when(F.col("_any"), F.lit(K.SEED_HIGH)).when(F.col("_land") > K.SEED_LAND_PX, F.col("_q"))
    seeded = df.join(stats, keys).withColumn("_low", on & (p >= K.SEED_LOW)).withColumn("_seed", F.coalesce(on & (p >= bar), F.lit(False)))
    labelled = components(seeded, keys, "_low", block)
    at = [*keys, "r", "c"]
    good = labelled.join(seeded.where("_seed").select(*at), at, "left_semi").select(*keys, "label").distinct()
    kept = labelled.join(good, [*keys, "label"], "left_semi").select(*at, F.lit(True).alias("mask"))
    return df.join(kept, at, "left").withColumn("mask", F.coalesce("mask", F.lit(False)))


def water_mask_otsu(df: DataFrame, keys: list[str], mndwi: str = "mndwi", block: int = K.BLOCK, least: int = K.OTSU_MIN_PX) -> DataFrame:
    """(keys, r, c, thr, water): Otsu threshold, opening, closing, small parts dropped; flat scenes as they are."""
    from tidewright.operators.adaptive import otsu_thresholds
    from tidewright.operators.stencil import _morph

    wet = df.join(otsu_thresholds(df, keys, mndwi), keys).withColumn("water", F.col(mndwi) > F.col("thr"))
    reach = 2 * (K.OTSU_OPEN + K.OTSU_CLOSE)
    kernel = lambda p, m: (N.open_close(m, p, K.OTSU_OPEN, K.OTSU_CLOSE),)
    smooth = drop_small(_morph(wet, keys, "water", kernel, reach, block), keys, "water", least, block)
    at = [*keys, "r", "c"]
    joined = wet.select(*at, "thr", "flat", F.col("water").alias("_raw")).join(smooth, at)
    return joined.select(*at, "thr", F.when(F.col("flat"), F.col("_raw")).otherwise(F.col("water")).alias("water"))
