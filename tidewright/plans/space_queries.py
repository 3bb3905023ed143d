"""Queries of neighbourhood and region operators, metrics and losses, with their SQL twins."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidewright.functions import pixel as P
from tidewright.functions.kernels import ellipse
from tidewright.operators import metrics, region, spacetime, stencil
from tidewright.plans import clusters
from tidewright.plans import fixtures as X
from tidewright.plans import pixel_queries as Q
from tidewright.plans.fixtures import rsql

QUERIES, ORACLES = {}, {}
KEYS = ["cluster_id", "year"]
AT = [*KEYS, "r", "c"]
R = P.rounded


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = sql
        return f

    return add


def _table(radius: int) -> str:
    return "(VALUES " + ", ".join(f"({a}, {b})" for a, b in ellipse(radius)) + ") AS e(dr, dc)"


def _morph(name: str, source: str, radius: int, agg: str) -> str:
    """CTE: dilation (bool_or) or erosion (bool_and) of boolean ``m`` of ``source``."""
    return f"""{name} AS (SELECT a.cluster_id, a.year, a.r, a.c, {agg}(b.m) AS m FROM {source} AS a, {_table(radius)}
  JOIN {source} AS b ON b.cluster_id = a.cluster_id AND b.year = a.year AND b.r = a.r + e.dr AND b.c = a.c + e.dc GROUP BY ALL)"""


_MASK = "m0 AS (SELECT cluster_id, year, r, c, port AS m FROM stack)"
_dil = lambda n, s, r: _morph(n, s, r, "bool_or")
_ero = lambda n, s, r: _morph(n, s, r, "bool_and")
_GRADIENT = f"{_dil('gd', 'm0', 1)}, {_ero('ge', 'm0', 1)}, g AS (SELECT gd.cluster_id, gd.year, gd.r, gd.c, gd.m AND NOT ge.m AS m FROM gd JOIN ge USING (cluster_id, year, r, c))"


def _mask(s, d):
    return X.stack(s, d).select(*AT, F.col("port").alias("m"))


@query(f"WITH {X.STACK}, {_MASK}, {_dil('a', 'm0', 3)}, {_ero('b', 'a', 3)}, {_ero('c1', 'b', 2)}, {_dil('c2', 'c1', 2)} SELECT cluster_id, year, r, c, m FROM c2")
def morph_close_open(s, d):
    return stencil.close_open(_mask(s, d), KEYS, "m", block=8)


@query(f"WITH {X.STACK}, {_MASK}, {_dil('a', 'm0', 2)} SELECT cluster_id, year, r, c, m FROM a")
def dilate5(s, d):
    return stencil.dilate(_mask(s, d), KEYS, "m", block=8)


@query(f"WITH {X.STACK}, {_MASK}, {_GRADIENT}, {_dil('w', 'g', 1)} SELECT cluster_id, year, r, c, m FROM w")
def edge_target(s, d):
    return stencil.edge_target(_mask(s, d), KEYS, "m", block=8)


@query(f"""WITH {X.STACK}, {_MASK}, {_GRADIENT}, {_dil('w', 'g', 2)}, k AS (SELECT cluster_id, year, bool_or(m) AND NOT bool_and(m) AS mixed FROM m0 GROUP BY ALL)
SELECT cluster_id, year, r, c, m AND mixed AS m FROM w JOIN k USING (cluster_id, year)""")
def boundary_ignore(s, d):
    return stencil.boundary_ignore(_mask(s, d), KEYS, "m", block=8)


def _labels(where: str, source: str = "stack", tag: str = "") -> str:
    """CTEs: components of pixels of ``source`` with ``where``; label is the first pixel's code."""
    px, reach = f"px{tag}", f"reach{tag}"
    return f"""{px} AS (SELECT cluster_id, year, r, c, r::BIGINT * 2147483648 + c AS code FROM {source} WHERE {where}),
{reach} AS (SELECT cluster_id, year, r, c, r AS r2, c AS c2, code FROM {px}
  UNION SELECT a.cluster_id, a.year, a.r, a.c, b.r, b.c, b.code FROM {reach} AS a JOIN {px} AS b ON a.cluster_id = b.cluster_id AND a.year = b.year AND abs(a.r2 - b.r) <= 1 AND abs(a.c2 - b.c) <= 1),
lab{tag} AS (SELECT cluster_id, year, r, c, min(code) AS label FROM {reach} GROUP BY ALL)"""


@query(f"WITH RECURSIVE {X.STACK}, {_labels('port')} SELECT cluster_id, year, r, c, label FROM lab")
def components(s, d):
    return region.components(_mask(s, d), KEYS, "m", block=5)


@query(f"""WITH RECURSIVE {X.STACK}, {_labels('port')}, n AS (SELECT cluster_id, year, label, count(*) AS n FROM lab GROUP BY ALL)
SELECT s.cluster_id, s.year, s.r, s.c, coalesce(n >= 4, false) AS m FROM stack AS s LEFT JOIN lab USING (cluster_id, year, r, c) LEFT JOIN n USING (cluster_id, year, label)""")
def drop_small(s, d):
    return region.drop_small(_mask(s, d), KEYS, "m", 4, block=5)


@query(f"""WITH RECURSIVE {X.STACK}, {_labels('port')}, n AS (SELECT cluster_id, year, label, count(*) AS n FROM lab GROUP BY ALL)
SELECT s.cluster_id, s.year, s.r, s.c, coalesce(n >= ceil(12000.0 / (area_m2 * 0 + 3600.0)), false) AS m FROM stack AS s LEFT JOIN lab USING (cluster_id, year, r, c) LEFT JOIN n USING (cluster_id, year, label)""")
def final_cleanup(s, d):
    sized = _mask(s, d).withColumn("px_area", F.lit(3600.0))
    return spacetime.final_cleanup(sized, KEYS, "m", "px_area", block=5).select(*AT, "m")


_HYST = """good AS (SELECT DISTINCT cluster_id, year, label FROM lab JOIN stack USING (cluster_id, year, r, c) WHERE p >= 0.65 AND water_prob < 0.9)"""


@query(f"""WITH RECURSIVE {X.STACK}, {_labels('p >= 0.40 AND water_prob < 0.9')}, {_HYST}
SELECT s.cluster_id, s.year, s.r, s.c, g.label IS NOT NULL AS mask FROM stack AS s LEFT JOIN lab USING (cluster_id, year, r, c) LEFT JOIN good AS g ON g.cluster_id = s.cluster_id AND g.year = s.year AND g.label = lab.label""")
def hysteresis(s, d):
    x = X.stack(s, d).select(*AT, "p", (F.col("water_prob") < 0.9).alias("land"))
    return region.hysteresis(x, KEYS, "p", "land", block=5).select(*AT, "mask")


@query(f"""WITH RECURSIVE {X.STACK}, {_labels('p >= 0.40 AND water_prob < 0.9')}, {_HYST}
SELECT cluster_id, year, r, c, label FROM lab SEMI JOIN good USING (cluster_id, year, label)""")
def seed_semijoin(s, d):
    x = X.stack(s, d).where("water_prob < 0.9").withColumn("m", F.col("p") >= 0.40)
    lab = region.components(x, KEYS, "m", block=5)
    seeds = x.where("p >= 0.65").select(*AT)
    good = lab.join(seeds, AT, "left_semi").select(*KEYS, "label").distinct()
    return lab.join(good, [*KEYS, "label"], "left_semi").select(*AT, "label")


_FAR = """wet AS (SELECT *, p < 0.15 AS w FROM stack),
far AS (SELECT a.cluster_id, a.year, a.r, a.c, a.w, a.p, min(CASE WHEN b.r IS NULL THEN 1e6 ELSE 0.955 * abs(abs(a.r - b.r) - abs(a.c - b.c)) + 1.3693 * least(abs(a.r - b.r), abs(a.c - b.c)) END) AS px
  FROM wet AS a LEFT JOIN wet AS b ON a.cluster_id = b.cluster_id AND a.year = b.year AND b.w GROUP BY ALL)"""


def _far(s, d):
    x = X.stack(s, d).withColumn("w", F.col("p") < 0.15)
    return x.join(stencil.distance_to(x, KEYS, "w"), AT)


@query(f"WITH {X.STACK}, {_FAR} SELECT cluster_id, year, r, c, {rsql('px', 'dist_px')} FROM far")
def dist_to_water(s, d):
    return _far(s, d).select(*AT, R(F.col("dist_px")).alias("dist_px"))


@query(f"WITH {X.STACK}, {_FAR} SELECT cluster_id, year, r, c, {rsql('CASE WHEN w OR px > 50 THEN 1.0 ELSE 1.0 + 1.2 * exp(-px / 10.0) END', 'weight')} FROM far")
def coastal_weight(s, d):
    return _far(s, d).select(*AT, R(P.coastal_weight(F.col("dist_px"), F.col("w"))).alias("weight"))


@query(f"""WITH {X.STACK}, n AS (SELECT a.cluster_id, a.year, a.r, a.c, sum(ln(1 + b.p)) / 25.0 AS m, sum(ln(1 + b.p) * ln(1 + b.p)) / 25.0 AS q FROM stack AS a JOIN stack AS b ON a.cluster_id = b.cluster_id AND a.year = b.year AND abs(a.r - b.r) <= 2 AND abs(a.c - b.c) <= 2 GROUP BY ALL)
SELECT cluster_id, year, r, c, {rsql('greatest(q - m * m, 0.0)', 'local_var')} FROM n""")
def local_variance(s, d):
    found = stencil.local_variance(X.stack(s, d).withColumn("v", F.log1p("p")), KEYS, "v")
    return found.select(*AT, R(F.col("local_var")).alias("local_var"))


_SLOPE = lambda x, y: f"coalesce((lead(p) OVER {x} - lag(p) OVER {x}) / 2.0, lead(p) OVER {x} - p, p - lag(p) OVER {x}, 0.0) AS {y}"
_CONTRAST = f"""gr AS (SELECT *, {_SLOPE('v', 'gy')}, {_SLOPE('h', 'gx')} FROM stack WINDOW v AS (PARTITION BY cluster_id, year, c ORDER BY r), h AS (PARTITION BY cluster_id, year, r ORDER BY c)),
ct AS (SELECT *, 1.0 + 5.0 * exp(-(sqrt(gy * gy + gx * gx) / (max(sqrt(gy * gy + gx * gx)) OVER (PARTITION BY cluster_id, year) + 1e-6)) / 0.1) AS contrast FROM gr)"""


@query(f"WITH {X.STACK}, {_CONTRAST} SELECT cluster_id, year, r, c, {rsql('contrast', 'contrast')} FROM ct")
def contrast_weights(s, d):
    return stencil.contrast_weights(X.stack(s, d), KEYS, "p").select(*AT, R(F.col("contrast")).alias("contrast"))


@query(f"WITH {X.STACK}, {_CONTRAST} SELECT cluster_id, year, r, c, {rsql('(0.5 + 1.5 * exp(-area_m2 / 500.0)) * contrast', 'weight')} FROM ct")
def aniso_weights(s, d):
    found = stencil.aniso_weights(stencil.contrast_weights(X.stack(s, d), KEYS, "p"), "area_m2")
    return found.select(*AT, R(F.col("weight")).alias("weight"))


@query(f"WITH {X.STACK} SELECT cluster_id, year, r, c, {rsql('ln(1 + p) + 0.5 * avg(ln(1 + p)) OVER (PARTITION BY cluster_id, year, r) + 0.25 * avg(ln(1 + p)) OVER (PARTITION BY cluster_id, year, c)', 'pooled')} FROM stack")
def strip_pool(s, d):
    found = stencil.strip_pool(X.stack(s, d).withColumn("v", F.log1p("p")), KEYS, "v", 0.5, 0.25)
    return found.select(*AT, R(F.col("pooled")).alias("pooled"))


# metrics and losses

_CONF = "count(*) FILTER (pred = 1 AND gt = 1) AS tp, count(*) FILTER (pred = 1 AND gt = 0) AS fp, count(*) FILTER (pred = 0 AND gt = 0) AS tn, count(*) FILTER (pred = 0 AND gt = 1) AS fn"
_RATES = ", ".join([
    rsql("pr", "precision"), rsql("re", "recall"), rsql("2.0 * pr * re / (pr + re + 1e-6)", "f1"),
    rsql("tn / (tn + fp + 1e-6)", "specificity"), rsql("fp / (fp + tn + 1e-6)", "fpr"),
])
_RATED = "r AS (SELECT *, tp / (tp + fp + 1e-6) AS pr, tp / (tp + fn + 1e-6) AS re FROM k)"
_RATE_NAMES = ("precision", "recall", "f1", "specificity", "fpr")


@query(f"WITH {X.PAIR}, k AS (SELECT {_CONF} FROM pair), {_RATED} SELECT tp, fp, tn, fn, {_RATES} FROM r")
def confusion_metrics(s, d):
    found = metrics.confusion(X.pair(s, d), [], "pred", "gt")
    return found.withColumns({c: R(F.col(c)) for c in _RATE_NAMES})


def _iou(k: int) -> str:
    return f"count(*) FILTER (pred = {k} AND gt = {k}) / (count(*) FILTER (gt IS NOT NULL AND (pred = {k} OR gt = {k})) + 1e-6)"


@query(f"""WITH {X.PAIR}, b AS (SELECT batch, {_iou(0)} AS bg, {_iou(1)} AS fg FROM pair GROUP BY batch)
SELECT {rsql('avg(bg)', 'iou_bg')}, {rsql('avg(fg)', 'iou_fg')}, {rsql('avg((bg + fg) / 2)', 'miou')} FROM b""")
def batch_iou(s, d):
    found = metrics.batch_iou(X.pair(s, d), [], "batch", "pred", "gt")
    return found.select(*[R(F.col(c)).alias(c) for c in ("iou_bg", "iou_fg", "miou")])


@query(f"""WITH {X.STACK}, {_MASK}, {_GRADIENT}, {_dil('pe', 'g', 1)}, m1 AS (SELECT cluster_id, year, r, c, p >= 0.45 AS m FROM stack),
{_dil('hd', 'm1', 1)}, {_ero('he', 'm1', 1)}, h AS (SELECT hd.cluster_id, hd.year, hd.r, hd.c, hd.m AND NOT he.m AS m FROM hd JOIN he USING (cluster_id, year, r, c)), {_dil('gt', 'h', 1)},
k AS (SELECT pe.year, count(*) FILTER (pe.m AND gt.m) AS b_inter, count(*) FILTER (pe.m OR gt.m) AS b_union FROM pe JOIN gt USING (cluster_id, year, r, c) WHERE pe.r > 0 GROUP BY pe.year)
SELECT year, b_inter, b_union, {rsql('b_inter / (b_union + 1e-6)', 'boundary_iou')} FROM k""")
def boundary_iou(s, d):
    x = X.stack(s, d)
    a = stencil.edge_target(x.select(*AT, F.col("port").alias("pe")), KEYS, "pe", block=8)
    b = stencil.edge_target(x.select(*AT, (F.col("p") >= 0.45).alias("ge")), KEYS, "ge", block=8)
    both = a.join(b, AT).withColumn("valid", F.col("r") > 0)
    return metrics.boundary_iou(both, ["year"], "pe", "ge", "valid").withColumn("boundary_iou", R(F.col("boundary_iou")))


@query(f"""WITH {X.STACK}, {_FAR}, z AS (SELECT year, p >= 0.5 AS pred, NOT w AND px <= 50 AND p < 0.55 AS zone FROM far), k AS (SELECT year, count(*) FILTER (zone AND pred) AS f, count(*) FILTER (zone) AS n FROM z GROUP BY ALL)
SELECT year, f AS coastal_fp, n AS coastal_total, {rsql('f / (n + 1e-6)', 'coastal_non_port_fpr')} FROM k""")
def coastal_fpr(s, d):
    x = _far(s, d).withColumns({"pred": F.col("port").cast("int"), "gt": (F.col("p") >= 0.55).cast("int")})
    return metrics.coastal_fpr(x, ["year"], "pred", "gt", "w", "dist_px").withColumn("coastal_non_port_fpr", R(F.col("coastal_non_port_fpr")))


_SWEEP = f"""t AS (SELECT 0.25 + 0.025 * i AS thr FROM range(21) AS x(i)),
k AS (SELECT thr, count(*) FILTER (score > thr AND gt = 1) / (count(*) FILTER (score > thr OR gt = 1) + 1e-6) AS fg, count(*) FILTER (score <= thr AND gt = 0) / (count(*) FILTER (score <= thr OR gt = 0) + 1e-6) AS bg
      FROM (SELECT score::DECIMAL(9, 3) AS score, gt, thr::DECIMAL(9, 3) AS thr FROM pair, t) GROUP BY ALL)"""


@query(f"WITH {X.PAIR}, {_SWEEP} SELECT {rsql('thr', 'thr')}, {rsql('fg', 'iou_fg')}, {rsql('bg', 'iou_bg')}, {rsql('(fg + bg) / 2', 'miou')}, row_number() OVER (ORDER BY fg DESC, thr) = 1 AS is_best FROM k".replace("round(thr, 6) + 0.0", "thr::DOUBLE"))
def threshold_sweep(s, d):
    found = metrics.threshold_sweep(X.pair(s, d), "score", "gt")
    return found.select(*[R(F.col(c)).alias(c) for c in ("thr", "iou_fg", "iou_bg", "miou")], "is_best")


_CE = "ln(1 + exp(CASE WHEN gt = 1 THEN bg - fg ELSE fg - bg END))"


@query(f"WITH {X.LOGITS} SELECT scene, {rsql(f'sum(CASE WHEN gt = 1 THEN 1.0 WHEN gt = 0 THEN 0.25 END * {_CE} * (1 + c)) / greatest(sum(1.0 + c) FILTER (gt IS NOT NULL), 1.0)', 'ce')} FROM logits GROUP BY scene")
def weighted_ce(s, d):
    x = X.logits(s, d).withColumn("w", 1.0 + F.col("c"))
    return metrics.weighted_ce(x, ["scene"], "bg", "fg", "gt", "w").withColumn("ce", R(F.col("ce")))


@query(f"""WITH {X.LOGITS}, e AS (SELECT scene % 4 AS batch, scene, (2 * sum(p) FILTER (gt = 1) + 1e-6) / (sum(p) FILTER (gt IS NOT NULL) + count(*) FILTER (gt = 1) + 1e-6) AS d FROM logits GROUP BY ALL)
SELECT batch, {rsql('1.0 - avg(coalesce(d, 1.0))', 'dice')} FROM e GROUP BY batch""")
def soft_dice(s, d):
    x = X.logits(s, d).withColumn("batch", F.col("scene") % 4)
    return metrics.soft_dice(x, ["batch"], ["scene"], "p", "gt").withColumn("dice", R(F.col("dice")))


@query(f"""WITH {X.LOGITS}, x AS (SELECT scene, r, c, k, (gt = k)::INTEGER AS y, abs((gt = k)::INTEGER - CASE WHEN k = 1 THEN p ELSE 1.0 - p END) AS e FROM logits, (VALUES (0), (1)) AS t(k) WHERE gt IS NOT NULL),
j AS (SELECT *, sum(y) OVER (PARTITION BY scene, k) AS tot, 1.0 - (sum(y) OVER (PARTITION BY scene, k) - sum(y) OVER o)::DOUBLE / greatest(sum(y) OVER (PARTITION BY scene, k) + sum(1 - y) OVER o, 1) AS jac FROM x WINDOW o AS (PARTITION BY scene, k ORDER BY e DESC, r, c ROWS UNBOUNDED PRECEDING)),
l AS (SELECT scene, k, sum(e * dj) AS loss FROM (SELECT *, jac - coalesce(lag(jac) OVER (PARTITION BY scene, k ORDER BY e DESC, r, c), 0.0) AS dj FROM j) WHERE tot > 0 GROUP BY ALL)
SELECT scene, {rsql('avg(loss)', 'lovasz')} FROM l GROUP BY scene""")
def lovasz(s, d):
    return metrics.lovasz(X.logits(s, d), ["scene"], "p", "gt", ["r", "c"]).withColumn("lovasz", R(F.col("lovasz")))


_BCE = "4.0 * y * ln(1 + exp(-x)) + (1.0 - y) * ln(1 + exp(x))"


@query(f"WITH {X.LOGITS}, e AS (SELECT scene, fg - bg AS x, (p > 0.5)::INTEGER AS y FROM logits) SELECT scene, {rsql(f'avg({_BCE})', 'edge_bce')} FROM e GROUP BY scene")
def edge_bce(s, d):
    x = X.logits(s, d).withColumns({"x": F.col("fg") - F.col("bg"), "y": F.col("p") > 0.5})
    return metrics.edge_bce(x, ["scene"], "x", "y").withColumn("edge_bce", R(F.col("edge_bce")))


_Z = [f"b{k}" for k in range(9)]


@query(f"WITH {X.SCENE}, z AS (SELECT scene, CASE WHEN r > 0 THEN (r + c) % 9 END AS y, [{', '.join(_Z)}] AS z FROM scene) SELECT scene, {rsql('avg(ln(list_sum(list_transform(z, lambda x: exp(x)))) - z[y + 1])', 'aux_ce')} FROM z WHERE y IS NOT NULL GROUP BY scene")
def aux_ce(s, d):
    x = X.scene(s, d).select("scene", F.array(*_Z).alias("z"), F.when(F.col("r") > 0, (F.col("r") + F.col("c")) % 9).alias("y"))
    return metrics.aux_ce(x, ["scene"], "z", "y").withColumn("aux_ce", R(F.col("aux_ce")))


@query(f"""WITH e AS (SELECT DISTINCT l_linenumber * 5 AS epoch FROM lineitem) SELECT epoch, {rsql('0.5 + 0.4 + CASE WHEN epoch > 20 THEN 0.30 * 0.3 ELSE 0 END + 0.15 * CASE WHEN epoch > 5 THEN least(1.0, (epoch - 4) / 10.0) ELSE 0 END * 0.2 + CASE WHEN epoch > 10 THEN 0.12 * 0.1 ELSE 0 END', 'loss')} FROM e""".replace("round(0.5", "round(0.5::DOUBLE"))
def loss_total(s, d):
    e = X.table(s, d, "lineitem").select((F.col("l_linenumber") * 5).alias("epoch")).distinct()
    terms = {"ce": 0.5, "dice": 0.4, "lovasz": 0.3, "aux_ce": 0.2, "edge_bce": 0.1}
    found = metrics.total_loss(e.withColumns({k: F.lit(v) for k, v in terms.items()}))
    return found.select("epoch", R(F.col("loss")).alias("loss"))


_DIAG = f"""far2 AS (SELECT cluster_id, year, p, w, px, port FROM (SELECT f.*, port FROM far AS f JOIN stack AS s USING (cluster_id, year, r, c))),
each AS (SELECT cluster_id, year, avg(port::INTEGER) AS pos_frac, avg(w::INTEGER) AS water_frac, avg((NOT w AND px <= 50)::INTEGER) AS band_frac, avg(p) FILTER (port) AS fg, avg(p) FILTER (NOT port) AS bg FROM far2 GROUP BY ALL),
cc AS (SELECT cluster_id, year, count(*) AS n, median(a) AS med FROM (SELECT cluster_id, year, label, count(*) AS a FROM lab GROUP BY ALL) GROUP BY ALL)"""


@query(f"""WITH RECURSIVE {X.STACK}, {_FAR}, {_labels('port')}, {_DIAG}
SELECT year, count(*) AS n_files, {rsql('avg(pos_frac)', 'pos_frac')}, {rsql('avg(coalesce(n, 0))', 'cc_count')}, {rsql('avg(coalesce(med, 0.0))', 'cc_area_median')}, {rsql('avg(water_frac)', 'water_frac')}, {rsql('avg(band_frac)', 'coastal_land_band_frac')}, {rsql('avg(fg)', 'fg_mean')}, {rsql('avg(bg)', 'bg_mean')}
FROM each LEFT JOIN cc USING (cluster_id, year) GROUP BY year""")
def dataset_diag(s, d):
    x = _far(s, d)
    share = lambda e: F.avg(e.cast("int"))
    each = x.groupBy(*KEYS).agg(
        share(F.col("port")).alias("pos_frac"), share(F.col("w")).alias("water_frac"), share(~F.col("w") & (F.col("dist_px") <= 50)).alias("band"),
        F.avg(F.when(F.col("port"), F.col("p"))).alias("fg"), F.avg(F.when(~F.col("port"), F.col("p"))).alias("bg"),
    )
    lab = region.components(x, KEYS, "port", block=5).groupBy(*KEYS, "label").agg(F.count("*").alias("a"))
    cc = lab.groupBy(*KEYS).agg(F.count("*").alias("n"), F.percentile("a", F.lit(0.5)).alias("med"))
    both = each.join(cc, KEYS, "left").fillna(0, ["n", "med"])
    mean = lambda c: R(F.avg(c))
    return both.groupBy("year").agg(
        F.count("*").alias("n_files"), mean("pos_frac").alias("pos_frac"), mean("n").alias("cc_count"), mean("med").alias("cc_area_median"),
        mean("water_frac").alias("water_frac"), mean("band").alias("coastal_land_band_frac"), mean("fg").alias("fg_mean"), mean("bg").alias("bg_mean"),
    )


@query(f"""WITH {X.PAIR}, k AS (SELECT {_CONF} FROM pair), {_RATED}, b AS (SELECT batch, {_iou(0)} AS bg, {_iou(1)} AS fg FROM pair GROUP BY batch), i AS (SELECT avg(bg) AS ib, avg(fg) AS ig FROM b), {_SWEEP.replace('k AS (SELECT thr', 'k2 AS (SELECT thr')},
best AS (SELECT thr, fg FROM k2 ORDER BY fg DESC, thr LIMIT 1)
SELECT tp, fp, tn, fn, {_RATES}, {rsql('ib', 'iou_bg')}, {rsql('ig', 'iou_fg')}, {rsql('(ib + ig) / 2', 'miou')}, best.thr::DOUBLE AS best_thr, {rsql('best.fg', 'iou_fg_best_thr')} FROM r, i, best""")
def validation_record(s, d):
    x = X.pair(s, d)
    rates = metrics.confusion(x, [], "pred", "gt").withColumns({c: R(F.col(c)) for c in _RATE_NAMES})
    iou = metrics.batch_iou(x, [], "batch", "pred", "gt").select(*[R(F.col(c)).alias(c) for c in ("iou_bg", "iou_fg", "miou")])
    best = metrics.threshold_sweep(x, "score", "gt").where("is_best").select(R(F.col("thr")).alias("best_thr"), R(F.col("iou_fg")).alias("iou_fg_best_thr"))
    one = lambda df: df.withColumn("_one", F.lit(1))  # noqa: E731  single rows side by side
    return one(rates).join(one(iou), "_one").join(one(best), "_one").drop("_one")



# masks of scenes: one year each, so the CTEs of stacks serve them too

_SCENE_YEAR = "scene AS cluster_id, 0 AS year, r, c"


@query(f"""WITH RECURSIVE {X.INDEXED}, {Q.OTSU}, wet AS (SELECT {_SCENE_YEAR}, {Q.OTSU_THR} AS thr, p99 <= p1 + 1e-6 AS flat, mndwi > {Q.OTSU_THR} AS m FROM indexed JOIN m USING (scene)),
{_ero('o1', 'wet', 2)}, {_dil('o2', 'o1', 2)}, {_dil('s1', 'o2', 3)}, {_ero('s2', 's1', 3)}, {_labels('m', 's2')}, n AS (SELECT cluster_id, label, count(*) AS n FROM lab GROUP BY ALL)
SELECT w.cluster_id AS scene, w.r, w.c, {rsql('w.thr', 'thr')}, CASE WHEN flat THEN w.m ELSE coalesce(n >= 20, false) END AS water
FROM wet AS w LEFT JOIN lab AS l USING (cluster_id, year, r, c) LEFT JOIN n ON n.cluster_id = w.cluster_id AND n.label = l.label""")
def otsu_water_mask(s, d):
    found = region.water_mask_otsu(X.indexed(s, d), ["scene"], block=8, least=20)
    return found.select("scene", "r", "c", R(F.col("thr")).alias("thr"), "water")


@query(f"""WITH RECURSIVE {X.INDEXED}, {Q.WATER}, {Q.REFINE}, stack AS (SELECT {_SCENE_YEAR}, {Q.REFINED_SQL} AS p, water_prob FROM h),
{_labels('p >= 0.40 AND water_prob < 0.5')}, good AS (SELECT DISTINCT cluster_id, label FROM lab JOIN stack USING (cluster_id, year, r, c) WHERE p >= 0.65 AND water_prob < 0.5),
k0 AS (SELECT s.cluster_id, s.year, s.r, s.c, g.label IS NOT NULL AS m FROM stack AS s LEFT JOIN lab USING (cluster_id, year, r, c) LEFT JOIN good AS g ON g.cluster_id = s.cluster_id AND g.label = lab.label),
{_dil('k1', 'k0', 3)}, {_ero('k2', 'k1', 3)}, {_ero('k3', 'k2', 2)}, {_dil('k4', 'k3', 2)}, {_labels('m', 'k4', '2')}, n AS (SELECT cluster_id, label, count(*) AS n FROM lab2 GROUP BY ALL)
SELECT k.cluster_id AS scene, k.r, k.c, coalesce(n >= ceil(12000.0 / 900.0), false) AS mask
FROM k4 AS k LEFT JOIN lab2 AS l USING (cluster_id, year, r, c) LEFT JOIN n ON n.cluster_id = k.cluster_id AND n.label = l.label""")
def refine_mask(s, d):
    return clusters.spatial_mask(Q.refined(s, d), ["scene"], 30.0, 8)
