"""Tile scoring with a pluggable scorer, flip averaging and overlap blending.

A scorer is a function of a batch of tiles, ``(n, 12, h, w)`` normalised bands,
to logits ``(n, 2, h, w)`` (background, foreground).  The default is a transparent logistic
stand-in on two indices, not a trained network.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewright.functions import constants as K
from tidewright.functions.pixel import hann2d
from tidewright.operators.tiles import overlap_blend, tile_cover

Scorer = Callable[[np.ndarray], np.ndarray]


def index_scorer(x: np.ndarray) -> np.ndarray:
    """Built-up and dry: a fixed logistic model on bands 9-11 (NDVI, MNDWI, NDBI)."""
    fg = 1.5 * x[:, 11] - 1.0 * x[:, 10] - 0.5 * x[:, 9]
    return np.stack([np.zeros_like(fg), fg], axis=1)


def with_flips(scorer: Scorer) -> Scorer:
    """Mean of the logits of tiles and their three mirror images."""
    def run(x: np.ndarray) -> np.ndarray:
        total = scorer(x)
        for axes in ((3,), (2,), (2, 3)):
            total = total + np.flip(scorer(np.flip(x, axes)), axes)
        return total / 4.0

    return run


def score_scenes(
    df: DataFrame,
    keys: list[str],
    mean: list[float],
    std: list[float],
    scorer: Scorer = index_scorer,
    patch: int = K.PATCH,
    stride: int = K.STRIDE,
    batch: int = K.BATCH,
) -> DataFrame:
    """(keys, r, c, p): scores of overlapping tiles blended with Hann weights.

    Bands b0..b11 are cleaned, padded by reflection to a full patch and
    normalised.  A group is a batch of up to ``batch`` tiles side by side, so
    the scorer sees several at a time and memory is bounded by the batch.
    """
    bands = [f"b{i}" for i in range(len(K.BANDS))]
    tiles = tile_cover(df.select(*keys, "r", "c", *bands), patch, stride)
    mu, sd = np.array(mean), np.array(std) + 1e-6
    schema = ", ".join(
        [f"{k} {df.schema[k].dataType.simpleString()}" for k in keys] + ["r int", "c int", "h int", "w int", "ry int", "rx int", "p double"]
    )
    scorer = with_flips(scorer)

    def run(group: pd.DataFrame) -> pd.DataFrame:
        parts = [part for _, part in group.groupby("x0", sort=True)]
        made, images = [], []
        for part in parts:
            y0, x0 = int(part["y0"].iloc[0]), int(part["x0"].iloc[0])
            r, c = part["r"].to_numpy() - y0, part["c"].to_numpy() - x0
            h, w = int(r.max()) + 1, int(c.max()) + 1
            x = np.zeros((len(bands), h, w))
            x[:, r, c] = np.nan_to_num(part[bands].to_numpy(float).T, nan=0.0, posinf=0.0, neginf=0.0)
            mode = "reflect" if h > 1 and w > 1 else "edge"
            images.append(np.pad(x, ((0, 0), (0, patch - h), (0, patch - w)), mode=mode))
            made.append({k: part[k].iloc[0] for k in keys} | {"r": r + y0, "c": c + x0, "h": h, "w": w, "ry": r, "rx": c})
        z = scorer((np.stack(images) - mu[:, None, None]) / sd[:, None, None])
        p = 1.0 / (1.0 + np.exp(z[:, 0] - z[:, 1]))
        return pd.concat([pd.DataFrame(cols | {"p": q[cols["ry"], cols["rx"]]}) for cols, q in zip(made, p, strict=True)])

    batches = tiles.withColumn("xb", F.floor(F.col("x0") / (stride * batch)))
    scored = batches.groupBy(*keys, "y0", "xb").applyInPandas(run, schema)
    weighted = scored.withColumn("w8", hann2d(F.col("ry"), F.col("rx"), F.col("h"), F.col("w")))
    return overlap_blend(weighted, keys, "p", "w8")
