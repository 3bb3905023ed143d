"""Segmentation metrics and losses as aggregations.  Ignored pixels have a null label."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewright.functions import constants as K
from tidewright.functions.pixel import aux_ramp, clip
from tidewright.operators.ranks import running_sums

EPS = 1e-6


def _agg(df: DataFrame, keys: list[str], *aggs: Column) -> DataFrame:
    return df.groupBy(*keys).agg(*aggs) if keys else df.agg(*aggs)


def confusion(df: DataFrame, keys: list[str], pred: str, gt: str) -> DataFrame:
    """tp, fp, tn, fn and the ratios made of them."""
    p, g = F.col(pred) == 1, F.col(gt) == 1
    ok = F.col(gt).isNotNull()
    counts = _agg(
        df, keys,
        F.count_if(ok & p & g).alias("tp"), F.count_if(ok & p & ~g).alias("fp"),
        F.count_if(ok & ~p & ~g).alias("tn"), F.count_if(ok & ~p & g).alias("fn"),
    )
    tp, fp, tn, fn = (F.col(c) for c in ("tp", "fp", "tn", "fn"))
    rated = counts.withColumn("precision", tp / (tp + fp + EPS)).withColumn("recall", tp / (tp + fn + EPS))
    both = F.col("precision") + F.col("recall")
    return rated.withColumns({
        "f1": 2.0 * F.col("precision") * F.col("recall") / (both + EPS),
        "specificity": tn / (tn + fp + EPS),
        "fpr": fp / (fp + tn + EPS),
    })


def batch_iou(df: DataFrame, keys: list[str], batch: str, pred: str, gt: str) -> DataFrame:
    """iou_bg, iou_fg, miou: means over batches of each batch's ratio."""
    ok = F.col(gt).isNotNull()
    def ratio(k: int) -> Column:
        p, g = F.col(pred) == k, F.col(gt) == k
        return F.count_if(ok & p & g) / (F.count_if(ok & (p | g)) + EPS)

    each = df.groupBy(*keys, batch).agg(ratio(0).alias("bg"), ratio(1).alias("fg"))
    return _agg(each, keys, F.avg("bg").alias("iou_bg"), F.avg("fg").alias("iou_fg"), F.avg((F.col("bg") + F.col("fg")) / 2.0).alias("miou"))


def boundary_iou(df: DataFrame, keys: list[str], p_edge: str, g_edge: str, valid: str) -> DataFrame:
    p, g, v = F.col(p_edge), F.col(g_edge), F.col(valid)
    found = _agg(df, keys, F.count_if(v & p & g).alias("b_inter"), F.count_if(v & (p | g)).alias("b_union"))
    return found.withColumn("boundary_iou", F.col("b_inter") / (F.col("b_union") + EPS))


def coastal_fpr(df: DataFrame, keys: list[str], pred: str, gt: str, water: str, dist_px: str) -> DataFrame:
    """False positives among non-port land pixels near water."""
    zone = ~F.col(water) & (F.col(dist_px) <= K.COASTAL_MAX_PX) & (F.col(gt) == 0)
    found = _agg(df, keys, F.count_if(zone & (F.col(pred) == 1)).alias("coastal_fp"), F.count_if(zone).alias("coastal_total"))
    return found.withColumn("coastal_non_port_fpr", F.col("coastal_fp") / (F.col("coastal_total") + EPS))


def thresholds(low: float = K.THRESHOLDS[0], high: float = K.THRESHOLDS[1], step: float = K.THRESHOLDS[2]) -> list[float]:
    return [round(low + step * k, 9) for k in range(int((high - low) / step + 1e-9) + 1)]


def threshold_sweep(df: DataFrame, prob: str, gt: str, grid: list[float] | None = None) -> DataFrame:
    """(thr, iou_fg, iou_bg, miou, is_best): IoU of prob > thr on a grid; the first best threshold is marked.

    All thresholds are conditional counts of one pass; pixels are not repeated.
    """
    grid = grid or thresholds()
    g, ok = F.col(gt) == 1, F.col(gt).isNotNull()
    aggs = []
    for k, t in enumerate(grid):
        p = F.col(prob) > t
        aggs += [
            F.count_if(ok & p & g).alias(f"a{k}"), F.count_if(ok & (p | g)).alias(f"b{k}"),
            F.count_if(ok & ~p & ~g).alias(f"c{k}"), F.count_if(ok & (~p | ~g)).alias(f"d{k}"),
        ]
    rows = F.array(*[
        F.struct(F.lit(t).alias("thr"), *[F.col(f"{x}{k}").alias(x) for x in "abcd"]) for k, t in enumerate(grid)
    ])
    long = df.agg(*aggs).select(F.inline(rows))
    rated = long.select(
        "thr", (F.col("a") / (F.col("b") + EPS)).alias("iou_fg"), (F.col("c") / (F.col("d") + EPS)).alias("iou_bg")
    ).withColumn("miou", (F.col("iou_fg") + F.col("iou_bg")) / 2.0)
    # the grid is a handful of rows: one window over it is no single-task bottleneck
    place = F.row_number().over(Window.orderBy(F.desc("iou_fg"), "thr"))
    return rated.withColumn("is_best", place == 1)


def cross_entropy(bg: Column, fg: Column, gt: Column) -> Column:
    """-log softmax of the true class, in the stable form."""
    other_less_own = F.when(gt == 1, bg - fg).otherwise(fg - bg)
    return F.greatest(other_less_own, F.lit(0.0)) + F.log1p(F.exp(-F.abs(other_less_own)))


def weighted_ce(df: DataFrame, keys: list[str], bg: str, fg: str, gt: str, weight: str | None = None) -> DataFrame:
    """Class weights count in the numerator only; the denominator is 1 at least."""
    ok, g = F.col(gt).isNotNull(), F.col(gt)
    w = F.col(weight) if weight else F.lit(1.0)
    own = F.when(g == 1, K.CLASS_WEIGHTS[1]).otherwise(K.CLASS_WEIGHTS[0])
    loss = F.sum(F.when(ok, own * cross_entropy(F.col(bg), F.col(fg), g) * w).otherwise(0.0))
    return _agg(df, keys, (loss / F.greatest(F.sum(F.when(ok, w).otherwise(0.0)), F.lit(1.0))).alias("ce"))


def soft_dice(df: DataFrame, keys: list[str], image: list[str], prob: str, gt: str) -> DataFrame:
    """1 - mean over images of (2 I + eps) / (D + eps)."""
    ok = F.col(gt).isNotNull()
    p = F.when(ok, F.col(prob)).otherwise(0.0)
    g = F.when(ok & (F.col(gt) == 1), 1.0).otherwise(0.0)
    each = df.groupBy(*keys, *image).agg(((2.0 * F.sum(p * g) + EPS) / (F.sum(p) + F.sum(g) + EPS)).alias("_d"))
    return _agg(each, keys, (1.0 - F.avg("_d")).alias("dice"))


def lovasz(df: DataFrame, keys: list[str], prob: str, gt: str, tie: list[str]) -> DataFrame:
    """Lovasz softmax per key: mean over the classes present of sorted errors times Jaccard steps.

    ``keys`` is what one loss covers (a batch); ``tie`` orders equal errors.  Errors are sorted bin by bin, so a batch
    and class is no one task.
    """
    ok = df.where(F.col(gt).isNotNull())
    long = ok.select(*keys, *tie, F.explode(F.array(F.lit(0), F.lit(1))).alias("k"), F.col(gt).alias("_g"), F.col(prob).alias("_p"))
    y = F.when(F.col("_g") == F.col("k"), 1.0).otherwise(0.0)
    p = F.when(F.col("k") == 1, F.col("_p")).otherwise(1.0 - F.col("_p"))
    graded = long.select(*keys, *tie, "k", y.alias("y"), F.abs(y - p).alias("e"))
    totals = graded.groupBy(*keys, "k").agg(F.sum("y").alias("_t")).where("_t > 0")
    summed = running_sums(graded, [*keys, "k"], "e", tie, {"_y": F.col("y"), "_n": F.lit(1)}).join(totals, [*keys, "k"])

    def jaccard(hit: Column, n: Column) -> Column:
        """Loss where the first ``n`` errors, ``hit`` of them at the class's pixels, are taken for wrong."""
        return 1.0 - (F.col("_t") - hit) / F.greatest(F.col("_t") + n - hit, F.lit(1.0))

    step = jaccard(F.col("_y"), F.col("_n")) - jaccard(F.col("_y") - F.col("y"), F.col("_n") - 1)
    each = summed.groupBy(*keys, "k").agg(F.sum(F.col("e") * step).alias("_l"))
    return _agg(each, keys, F.avg("_l").alias("lovasz"))


def edge_bce(df: DataFrame, keys: list[str], logit: str, edge: str) -> DataFrame:
    """Mean binary cross entropy with logits, edges weighted."""
    x, y = F.col(logit), F.col(edge).cast("double")
    soft = F.log1p(F.exp(-F.abs(x))) + F.greatest(-x, F.lit(0.0))  # -log sigmoid(x)
    loss = K.EDGE_POSITIVE * y * soft + (1.0 - y) * (soft + x)
    return _agg(df, keys, F.avg(loss).alias("edge_bce"))


def aux_ce(df: DataFrame, keys: list[str], logits: str, label: str) -> DataFrame:
    """Mean cross entropy over an array of class logits, null labels left out."""
    z = F.col(logits)
    top = F.array_max(z)
    total = F.aggregate(z, F.lit(0.0), lambda a, x: a + F.exp(x - top))
    loss = top + F.ln(total) - F.get(z, F.col(label))
    return _agg(df.where(F.col(label).isNotNull()), keys, F.avg(loss).alias("aux_ce"))


def total_loss(df: DataFrame, epoch: str = "epoch") -> DataFrame:
    """``df`` (ce, dice, lovasz, aux_ce, edge_bce by epoch) with ``loss``: terms switched on by epoch."""
    e = F.col(epoch)
    late = lambda start, w, c: F.when(e > start, w * F.col(c)).otherwise(0.0)
    return df.withColumn(
        "loss",
        F.col("ce") + F.col("dice") + late(K.LOVASZ_START, K.LOVASZ_WEIGHT, "lovasz")
        + K.AUX_WEIGHT * aux_ramp(e) * F.col("aux_ce") + late(K.EDGE_START, K.EDGE_WEIGHT, "edge_bce"),
    )


def aux_labels(df: DataFrame, sample: list[str], label: str) -> DataFrame:
    """``df`` with y_bin (label > 0) and y_aux: null where a sample's labels are only 0/1 or 0/255, else 0..8."""
    stats = df.groupBy(*sample).agg(F.max(label).alias("_m"), F.count_distinct(label).alias("_u"))
    binary = (F.col("_m") <= 1) | ((F.col("_m") == 255) & (F.col("_u") <= 2))
    aux = F.when(~binary, clip(F.col(label).cast("double"), 0, K.AUX_CLASSES - 1).cast("int"))
    return df.join(stats, sample).withColumns({"y_bin": (F.col(label) > 0).cast("int"), "y_aux": aux}).drop("_m", "_u")

