"""Scalar formulas as Column functions; all of them stay in code generation.

Doubles throughout.  NaN is the largest double in Spark, so inputs are cleaned
(``clean``) before clips and quantiles.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidewright.functions import constants as K

Value = Column | float | int


def _c(x: Value) -> Column:
    return x if isinstance(x, Column) else F.lit(float(x))


def clip(x: Column, low: Value, high: Value) -> Column:
    return F.least(F.greatest(x, _c(low)), _c(high))


def rounded(x: Column, digits: int = 6) -> Column:
    """Rounded and without a negative zero."""
    return F.round(x, digits) + F.lit(0.0)


def clean(x: Column) -> Column:
    """NaN, infinities and null become 0."""
    bad = x.isNull() | F.isnan(x) | (F.abs(x) == F.lit(float("inf")))
    return F.when(bad, 0.0).otherwise(x)


def finite(x: Column) -> Column:
    """NaN becomes null, so that aggregates skip it."""
    return F.when(~F.isnan(x), x)


def decode(dn: Column, band: int) -> Column:
    """Physical value of a packed digital number; other bands pass through."""
    x = dn.cast("double")
    if band <= 5:
        return x * 1e-4
    if band in (6, 7):
        return clip((x * 1e-3 - 35.0 + 25.0) / 30.0, 0, 1)
    if band == 8:
        return clip((x * 1e-3 - 20.0) / 15.0, 0, 1)
    return x * 1e-4 - 1.0 if band in (9, 10, 11) else x


def decode_by_band(dn: Column, band: Column) -> Column:
    """``decode`` where the band is a column."""
    return (
        F.when(band.between(0, 5), decode(dn, 0))
        .when(band.between(6, 7), decode(dn, 6))
        .when(band == 8, decode(dn, 8))
        .when(band.between(9, 11), decode(dn, 9))
        .otherwise(dn.cast("double"))
    )


def normalised_difference(a: Column, b: Column) -> Column:
    return clip((a - b) / (a + b + 1e-6), -1, 1)


def denominator_confidence(den: Column) -> Column:
    share = clip((den - K.TRUST_LOW) / (K.TRUST_HIGH - K.TRUST_LOW + 1e-6), 0, 1)
    return share if K.TRUST_POWER == 1.0 else F.pow(share, F.lit(K.TRUST_POWER))


def sigmoid(x: Column) -> Column:
    return 1.0 / (1.0 + F.exp(-x))


def logit(p: Column) -> Column:
    q = clip(p, 1e-6, 1 - 1e-6)
    return F.ln(q / (1.0 - q))


def coast_score(dist_m: Column, water: Column) -> Column:
    near = ~water & (dist_m <= K.COAST_MAX_M)
    return F.when(near, F.exp(-dist_m / K.COAST_SIGMA_M)).otherwise(0.0)


def geo_prior(ndvi: Column, ndbi: Column, coast: Column) -> Column:
    v, b = (clip(x, -1, 1) * 0.5 + 0.5 for x in (ndvi, ndbi))
    x = F.lit(K.PRIOR_W0) + K.PRIOR_COAST * coast + K.PRIOR_NDBI * (b - 0.5) + K.PRIOR_NDVI * (0.5 - v)
    return clip(sigmoid(x), 0.02, 0.98)


def fuse_prior(prob: Column, prior: Column, water_prob: Column) -> Column:
    fused = sigmoid(logit(prob) + K.PRIOR_LAMBDA * logit(prior))
    return F.when(water_prob > K.WATER_FORBID, 0.0).otherwise(fused)


def normalise(x: Column, mean: Column, std: Column) -> Column:
    return (x - mean) / (std + 1e-6)


def denormalise(z: Column, mean: Column, std: Column) -> Column:
    return z * (std + 1e-6) + mean


def softmax_fg(bg: Column, fg: Column) -> Column:
    return 1.0 / (1.0 + F.exp(bg - fg))


def argmax_class(bg: Column, fg: Column) -> Column:
    """1 if the foreground logit is greater; a tie is background."""
    return F.when(fg > bg, 1).otherwise(0)


def log_cost(p: Column) -> Column:
    """-ln p, p kept off zero."""
    return -F.ln(clip(p, 1e-6, 1.0))


def l1_penalties(water: Column) -> tuple[Column, Column]:
    """(growth, shrink) penalties of the water layer."""
    return F.lit(K.L1_FORWARD), K.L1_BACKWARD * (1.0 - water)


def l2_penalties(p: Column, decline: Column, dist_m: Column) -> tuple[Column, Column]:
    """(growth, shrink) penalties of the port layer."""
    sure = sigmoid((p - K.EXPAND_MID) * K.EXPAND_SLOPE)
    fwd = (K.L2_FWD_BASE + K.L2_FWD_GAIN * p) * (1.0 - K.RETREAT_RELAX * decline)
    bonus = K.L2_BWD_BONUS * F.exp(-dist_m / K.L2_DECAY_M) * sure
    bwd = K.L2_BWD_BASE + K.L2_BWD_GAIN * (1.0 - sure) - bonus
    return F.greatest(fwd, F.lit(K.FWD_MIN)), F.greatest(bwd, F.lit(K.L2_BWD_MIN))


def coastal_weight(dist_px: Column, water: Column) -> Column:
    near = ~water & (dist_px <= K.COASTAL_MAX_PX)
    return F.when(near, 1.0 + K.COASTAL_ALPHA * F.exp(-dist_px / K.COASTAL_SIGMA_PX)).otherwise(1.0)


def hann(i: Column, n: Value) -> Column:
    """Weight of place ``i`` of a Hann window of ``n`` places; a window of one is 1."""
    n = n if isinstance(n, Column) else F.lit(int(n))
    w = 0.5 - 0.5 * F.cos(2.0 * F.pi() * i / F.greatest(n - 1, F.lit(1)))
    return F.when(n == 1, 1.0).otherwise(w)


def hann2d(r: Column, c: Column, h: Value, w: Value) -> Column:
    return clip(hann(r, h) * hann(c, w), 1e-3, 1.0)


def pixel_size(dx: Column, dy: Column, lat: Column, metric: Column) -> tuple[Column, Column]:
    """(mean side, area) of a pixel in metres, of a metric or a degree grid centred at ``lat``."""
    a = F.radians(lat)
    per_lat = 111132.92 - 559.82 * F.cos(2.0 * a) + 1.175 * F.cos(4.0 * a)
    per_lon = 111412.84 * F.cos(a) - 93.5 * F.cos(3.0 * a)
    x = F.when(metric, F.abs(dx)).otherwise(F.abs(dx) * per_lon)
    y = F.when(metric, F.abs(dy)).otherwise(F.abs(dy) * per_lat)
    return (x + y) * 0.5, x * y


def is_metric(wkt: Column) -> Column:
    low = F.lower(F.coalesce(wkt, F.lit("")))
    return low.startswith("projcs") | low.startswith("projcrs") | low.contains("metre") | low.contains("meter")


def effective_crs(wkt: Column) -> Column:
    """Local systems named Pseudo-Mercator are EPSG:3857; a missing system is an error."""
    known = F.when(wkt.contains("LOCAL_CS") & wkt.contains("Pseudo-Mercator"), "EPSG:3857").otherwise(wkt)
    return F.when(wkt.isNull(), F.raise_error(F.lit("raster has no CRS"))).otherwise(known)


def row_area(lat_mid: Column, dlat_deg: Column, dlon_deg: Column) -> Column:
    """WGS84 area in square metres of a small cell: M * N * cos(lat) * dlat * dlon at its middle."""
    e2 = K.EARTH_F * (2 - K.EARTH_F)
    s = F.sin(F.radians(lat_mid))
    q = 1.0 - e2 * s * s
    m = K.EARTH_A * (1 - e2) / F.pow(q, F.lit(1.5))
    n = K.EARTH_A / F.sqrt(q)
    return m * n * F.cos(F.radians(lat_mid)) * F.abs(F.radians(dlat_deg)) * F.abs(F.radians(dlon_deg))


def mercator_lat(y: Column) -> Column:
    """Latitude in degrees of a Pseudo-Mercator northing."""
    return F.degrees(F.atan(F.sinh(y / K.MERCATOR_R)))


def warmup_cosine(step: Column, warmup: int, total: int, floor: float) -> Column:
    """Learning-rate factor: linear warm-up, then a cosine down to ``floor``."""
    progress = (step - warmup) / float(max(1, total - warmup))
    cosine = 0.5 * (1.0 + F.cos(F.pi() * progress))
    return F.when(step < warmup, (step + 1) / float(max(1, warmup))).otherwise(floor + (1.0 - floor) * cosine)


def aux_ramp(epoch: Column) -> Column:
    return F.when(epoch > K.AUX_WARMUP, F.least(F.lit(1.0), (epoch - K.AUX_WARMUP + 1) / 10.0)).otherwise(0.0)


def hashed_uniform(seed: int, *keys: Column) -> Column:
    """A number in [0, 1) that depends on seed and keys alone: 48 bits of the MD5 of ``seed:key:...``."""
    text = F.concat_ws(":", F.lit(str(seed)), *[k.cast("string") for k in keys])
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, 12), 16, 10).cast("double") / float(1 << 48)


def hashed_normal(seed: int, *keys: Column) -> Column:
    """A standard normal number, made of the uniform ones of ``seed`` and ``seed + 1``."""
    u, v = hashed_uniform(seed, *keys), hashed_uniform(seed + 1, *keys)
    return F.sqrt(-2.0 * F.ln(1.0 - u)) * F.cos(2.0 * F.pi() * v)
