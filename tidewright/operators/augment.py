"""Random augmentation of training samples, by hashed numbers: the same sample, seed and key give the same result.

A sample is a group of pixels (keys, r, c); its size is that of a training
crop, so the affine warp may take a whole sample in one task.  Gates and
ranges are the published ones.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewright.functions import constants as K
from tidewright.functions import kernels as N
from tidewright.functions.pixel import clip, hashed_normal, hashed_uniform
from tidewright.operators.tiles import apply_tiles

#: Seeds of the numbers that a sample draws, in order.
FLIP_LR, FLIP_UD, ROTATE, TURNS, WARP, ANGLE, SCALE, SHIFT_X, SHIFT_Y, JITTER, GAIN, BIAS, NOISE = range(1, 14)
#: Seed of the noise of the first radar band; each takes two.
NOISE_SEED = 100


def _between(seed: int, low: float, high: float, keys: list[Column]) -> Column:
    return low + (high - low) * hashed_uniform(seed, *keys)


def turn(df: DataFrame, keys: list[str], seed: int = 0) -> DataFrame:
    """``df`` with pixels moved by random mirroring and quarter turns; samples keep their first row and column at 0."""
    k = [F.col(x) for x in keys]
    on = lambda which, p: hashed_uniform(seed + which, *k) < p
    size = df.groupBy(*keys).agg((F.max("r") + 1).alias("_h"), (F.max("c") + 1).alias("_w"))
    x = df.join(size, keys)
    x = x.withColumn("c", F.when(on(FLIP_LR, K.FLIP_SHARE), F.col("_w") - 1 - F.col("c")).otherwise(F.col("c")))
    x = x.withColumn("r", F.when(on(FLIP_UD, K.FLIP_SHARE), F.col("_h") - 1 - F.col("r")).otherwise(F.col("r")))
    turns = F.when(on(ROTATE, K.FLIP_SHARE), F.floor(4 * hashed_uniform(seed + TURNS, *k))).otherwise(F.lit(0))
    r, c, down, right = F.col("r"), F.col("c"), F.col("_h") - 1 - F.col("r"), F.col("_w") - 1 - F.col("c")
    moved = x.withColumn("_t", turns)
    which = lambda *four: F.when(F.col("_t") == 1, four[1]).when(F.col("_t") == 2, four[2]).when(F.col("_t") == 3, four[3]).otherwise(four[0])
    return moved.withColumns({"r": which(r, right, down, c), "c": which(c, r, right, down)}).drop("_h", "_w", "_t")


def warp(df: DataFrame, keys: list[str], bands: list[str], labels: list[str], seed: int = 0) -> DataFrame:
    """(keys, r, c, bands, labels): random rotation, scaling and shift; bands bilinear, labels nearest."""
    k = [F.col(x) for x in keys]
    drawn = {
        "_on": (hashed_uniform(seed + WARP, *k) < K.WARP_SHARE).cast("double"),
        "_deg": _between(seed + ANGLE, -K.WARP_DEGREES, K.WARP_DEGREES, k),
        "_scale": _between(seed + SCALE, 1 - K.WARP_SCALE, 1 + K.WARP_SCALE, k),
        "_x": _between(seed + SHIFT_X, -K.WARP_SHIFT, K.WARP_SHIFT, k),
        "_y": _between(seed + SHIFT_Y, -K.WARP_SHIFT, K.WARP_SHIFT, k),
    }
    near = [False] * len(bands) + [True] * len(labels)

    def kernel(present, *fields):
        images, (on, degrees, scale, x, y) = fields[: len(near)], [f[present][0] for f in fields[len(near) :]]
        if not on:
            return images
        h, w = present.shape
        return tuple(N.affine_warp(i, degrees, scale, y * h, x * w, n) for i, n in zip(images, near, strict=True))

    made = apply_tiles(
        df.withColumns(drawn), keys, [*bands, *labels, *drawn], {c: "double" for c in [*bands, *labels]}, kernel, 0, 1 << 30
    )
    return made.withColumns({c: F.col(c).cast(df.schema[c].dataType) for c in labels})


def disturb(df: DataFrame, keys: list[str], optical: list[str], radar: list[str], seed: int = 0) -> DataFrame:
    """``df`` with optical bands under a random gain and bias, clipped to 0..1, and noise on radar bands, not clipped."""
    k, at = [F.col(x) for x in keys], [F.col(x) for x in [*keys, "r", "c"]]
    jitter = hashed_uniform(seed + JITTER, *k) < K.JITTER_SHARE
    noisy = hashed_uniform(seed + NOISE, *k) < K.NOISE_SHARE
    gain, bias = _between(seed + GAIN, 1 - K.JITTER_GAIN, 1 + K.JITTER_GAIN, k), _between(seed + BIAS, -K.JITTER_BIAS, K.JITTER_BIAS, k)
    new = {b: F.when(jitter, clip(F.col(b) * gain + bias, 0, 1)).otherwise(F.col(b)) for b in optical}
    for i, b in enumerate(radar):
        noise = K.NOISE_STD * hashed_normal(seed + NOISE_SEED + 2 * i, *at)
        new[b] = F.when(noisy, F.col(b) + noise).otherwise(F.col(b))
    return df.withColumns(new)


def augment(df: DataFrame, keys: list[str], optical: list[str], radar: list[str], others: list[str], labels: list[str], seed: int = 0) -> DataFrame:
    """Mirroring, quarter turns, warp, jitter and noise, in this order; ``others`` are bands that are only moved."""
    bands = [*optical, *radar, *others]
    moved = turn(df.select(*keys, "r", "c", *bands, *labels), keys, seed)
    return disturb(warp(moved, keys, bands, labels, seed), keys, optical, radar, seed)
