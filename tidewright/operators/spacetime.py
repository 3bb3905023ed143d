"""Space-time labelling: two minimum cuts per block, both true.

Blocks are solved on their own with a halo, so the result depends on block and
halo; both are explicit and never changed by a size guard.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewright.functions import constants as K
from tidewright.functions import kernels as N
from tidewright.operators.region import drop_small
from tidewright.operators.tiles import apply_tiles


def minimum_cut(df: DataFrame, scene: list[str], true_cost: str, false_cost: str, weight: str, grow: str, shrink: str, time: str = "year", block: int = K.BLOCK, pad: int = K.PAD) -> DataFrame:
    """(scene, year, r, c, label): one binary cut from cost, weight and penalty columns."""
    def kernel(present, t, f, w, g, s):
        return (N.min_cut(t, f, N.edge_capacities(w, g, s)),)

    cols = [true_cost, false_cost, weight, grow, shrink]
    return apply_tiles(df, scene, cols, {"label": "boolean"}, kernel, pad, block, time)


def label_ports(df: DataFrame, scene: list[str], water: str = "water_prob", port: str = "prob_refined", dist_m: str = "dist_to_water_m", time: str = "year", block: int = K.BLOCK, pad: int = K.PAD, lenient: bool = False) -> DataFrame:
    """(scene, year, r, c, port): the two-layer labelling of each block; with ``lenient`` null where a block fails."""
    def kernel(present, w, p, d):
        try:
            return (N.label_block(w, p, d),)
        except (ArithmeticError, ValueError):
            if not lenient:
                raise
            return (np.full(w.shape, None, object),)

    return apply_tiles(df, scene, [water, port, dist_m], {"port": "boolean"}, kernel, pad, block, time)


def least_pixels(pixel_area):
    """Pixels of the least component: ceil(area limit / pixel area)."""
    area = pixel_area if not isinstance(pixel_area, int | float) else F.lit(float(pixel_area))
    return F.ceil(F.lit(K.MIN_COMPONENT_M2) / area)


def final_cleanup(df: DataFrame, keys: list[str], mask: str, pixel_area: str, block: int = K.BLOCK) -> DataFrame:
    """Drop components below the least area, year by year."""
    sized = df.withColumn("_least", least_pixels(F.col(pixel_area)))
    return drop_small(sized, keys, mask, "_least", block).drop("_least")
