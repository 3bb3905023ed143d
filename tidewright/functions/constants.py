"""Fixed values of the raster model, in natural order."""

BANDS = ("B2", "B3", "B4", "B8", "B11", "B12", "VV", "VH", "VV_VH", "NDVI", "MNDWI", "NDBI")
YEAR_MIN, YEAR_MAX, YEAR_REF = 2017, 2025, 2022
PATCH, STRIDE, BATCH = 512, 256, 6
BLOCK, PAD = 256, 64

COAST_MAX_M, COAST_SIGMA_M, PRIOR_LAMBDA = 800.0, 120.0, 0.55
MIN_COMPONENT_M2, CLOSE_R, OPEN_R = 12_000.0, 3, 2
PRIOR_W0, PRIOR_COAST, PRIOR_NDBI, PRIOR_NDVI = -0.3, 2.0, 1.0, 0.9
SEED_HIGH, SEED_LOW, SEED_QUANTILE, SEED_LAND_PX = 0.65, 0.40, 0.995, 1000
WATER_SLOPE, INTENSITY_SLOPE, WATER_QUANTILE, INTENSITY_QUANTILE, WATER_FORBID = 10.0, 10.0, 0.85, 0.20, 0.95
TRUST_LOW, TRUST_HIGH, TRUST_POWER = 0.02, 0.08, 1.0

ANISO_BASE, ANISO_GAIN, ANISO_DECAY_M = 0.5, 1.5, 500.0
CONTRAST_GAIN, CONTRAST_DECAY = 5.0, 0.1
L1_FORWARD, L1_BACKWARD = 2.0, 50.0
L2_DECAY_M, L2_FWD_BASE, L2_FWD_GAIN = 200.0, 20.0, 50.0
L2_BWD_BASE, L2_BWD_GAIN, L2_BWD_BONUS, L2_BWD_MIN = 2.0, 40.0, 6.0, 1.0
TEMPORAL_WEIGHTS = (1.0, 2.0, 3.0, 2.0, 1.0)
RETREAT_YEARS, RETREAT_RELAX, FWD_MIN, EXPAND_MID, EXPAND_SLOPE = 2, 0.60, 2.0, 0.55, 6.0
SEA_WATER, SEA_DILATE = 0.20, 5

CHAMFER_STRAIGHT, CHAMFER_DIAGONAL = 0.955, 1.3693
NO_WATER_PX = 1e6  # distance where an image has no water at all

WATER_FIXED, OTSU_LOW, OTSU_HIGH, OTSU_OPEN, OTSU_CLOSE, OTSU_MIN_PX = -0.05, 1.0, 99.0, 2, 3, 128
COASTAL_ALPHA, COASTAL_SIGMA_PX, COASTAL_MAX_PX = 1.2, 10.0, 50.0
CLASS_WEIGHTS = (0.25, 1.0)
LOVASZ_WEIGHT, LOVASZ_START, EDGE_WEIGHT, EDGE_POSITIVE, EDGE_START = 0.30, 20, 0.12, 4.0, 10
AUX_WEIGHT, AUX_WARMUP, AUX_CLASSES = 0.15, 5, 9
THRESHOLDS = (0.25, 0.75, 0.025)
SWEEP_BATCHES = 80
PROBES = (0.001, 0.01, 0.05, 0.25, 0.5, 0.75, 0.95, 0.99, 0.999)
EARTH_A, EARTH_F, MERCATOR_R = 6378137.0, 1 / 298.257223563, 6378137.0

OVERLAY_SHARE = 0.45  # of the mask's colour

# Augmentation: shares of samples, and how far numbers reach.
FLIP_SHARE = 0.5  # mirrored left to right; up and down; given quarter turns: each on its own
WARP_SHARE = 0.35
WARP_DEGREES = 8.0  # to either side
WARP_SCALE = 0.05  # of 1
WARP_SHIFT = 0.03  # of width and of height
JITTER_SHARE = 0.3
JITTER_GAIN = 0.1  # of 1
JITTER_BIAS = 0.02
NOISE_SHARE = 0.25
NOISE_STD = 0.02
