"""Queries of temporal operators, accounting, tiles and the space-time cut, with their SQL twins."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidewright.functions import pixel as P
from tidewright.functions.constants import TEMPORAL_WEIGHTS
from tidewright.operators import accounting, adaptive, spacetime, temporal, tiles
from tidewright.operators.scoring import score_scenes
from tidewright.plans import clusters
from tidewright.plans import fixtures as X
from tidewright.plans.fixtures import csql, rsql

QUERIES, ORACLES = {}, {}
CELL = ["cluster_id", "r", "c"]
AT = ["cluster_id", "year", "r", "c"]
R = P.rounded


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = sql
        return f

    return add


_TAPS = [(k - 2, w) for k, w in enumerate(TEMPORAL_WEIGHTS)]
_TAP = lambda k: f"lag(p, {-k}) OVER s" if k < 0 else f"lead(p, {k}) OVER s"
_SMOOTH = (
    "(" + " + ".join(f"coalesce({_TAP(k)}, 0.0) * {w}" for k, w in _TAPS) + ") / ("
    + " + ".join(f"CASE WHEN {_TAP(k)} IS NULL THEN 0.0 ELSE {w} END" for k, w in _TAPS) + ")"
)
_SMOOTHED = f"smoothed AS (SELECT *, CASE WHEN count(*) OVER (PARTITION BY cluster_id, r, c) <= 1 THEN p ELSE {csql(_SMOOTH, '0.0', '1.0')} END AS ps FROM stack WINDOW s AS (PARTITION BY cluster_id, r, c ORDER BY year))"


@query(f"WITH {X.STACK}, {_SMOOTHED} SELECT cluster_id, year, r, c, {rsql('ps', 'ps')} FROM smoothed")
def temporal_smooth(s, d):
    x = X.stack(s, d)
    return x.select(*AT, R(temporal.temporal_smooth(F.col("p"), CELL)).alias("ps"))


@query(f"""WITH {X.SERIES}, d AS (SELECT *, {csql('coalesce(lag(p) OVER s, p) - p', '0.0', '1.0')} AS one FROM series WINDOW s AS (PARTITION BY user_id ORDER BY day))
SELECT user_id, day, {rsql('least(one, coalesce(lead(one) OVER s, one))', 'decline')} FROM d WINDOW s AS (PARTITION BY user_id ORDER BY day)""")
def persistent_decline(s, d):
    found = temporal.persistent_decline(X.series(s, d), "p", ["user_id"], "day")
    return found.select("user_id", "day", R(F.col("decline")).alias("decline"))


@query(f"WITH {X.STACK} SELECT cluster_id, year, r, c, port::INTEGER - coalesce(lag(port) OVER (PARTITION BY cluster_id, r, c ORDER BY year), port)::INTEGER AS change FROM stack")
def annual_change(s, d):
    x = X.stack(s, d)
    before = temporal.previous(F.col("port"), CELL)
    return x.select(*AT, (F.col("port").cast("int") - before.cast("int")).alias("change"))


@query(f"WITH {X.STACK} SELECT cluster_id, year, r, c, port::INTEGER - first_value(port) OVER (PARTITION BY cluster_id, r, c ORDER BY year)::INTEGER AS change FROM stack")
def base_change(s, d):
    x = X.stack(s, d)
    return x.select(*AT, (F.col("port").cast("int") - temporal.base(F.col("port"), CELL).cast("int")).alias("change"))


@query(f"""WITH {X.SERIES}, k AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY day) AS k, count(*) OVER (PARTITION BY user_id) AS n FROM series)
SELECT user_id, {rsql('sum(p * pow(0.999, n - k) * CASE WHEN k = 1 THEN 1.0 ELSE 0.001 END)', 'ema')} FROM k GROUP BY ALL""")
def ema_fold(s, d):
    found = temporal.ema(X.series(s, d), ["user_id"], "p", "day")
    return found.select("user_id", R(F.col("ema")).alias("ema"))


@query(f"""WITH {X.SERIES}, b AS (SELECT *, coalesce(max(p) OVER (PARTITION BY user_id ORDER BY day ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0) AS m FROM series)
SELECT user_id, day, {rsql('m', 'best_before')}, p > m AS is_best FROM b""")
def best_checkpoint(s, d):
    found = temporal.best_so_far(X.series(s, d), ["user_id"], "p", "day")
    return found.select("user_id", "day", R(F.col("best_before")).alias("best_before"), "is_best")


_EARLY = """early AS (SELECT cluster_id, r, c, greatest(max(water_prob), 0.0) AS wet FROM stack
  WHERE (cluster_id, year) IN (SELECT (cluster_id, year) FROM (SELECT cluster_id, year, dense_rank() OVER (PARTITION BY cluster_id ORDER BY year) AS k FROM stack) WHERE k <= 2) GROUP BY ALL)"""


@query(f"WITH {X.STACK}, {_EARLY} SELECT cluster_id, r, c, {rsql('wet', 'water_prob')} FROM early")
def sea_domain_base(s, d):
    found = temporal.early_max(X.stack(s, d), CELL, "water_prob", ["cluster_id"])
    return found.select(*CELL, R(F.col("water_prob")).alias("water_prob"))


@query(f"WITH {X.STACK} SELECT cluster_id, year, count(*) AS px, {rsql('sum(area_m2)', 'mask_area_m2')} FROM stack WHERE port GROUP BY ALL")
def mask_area(s, d):
    found = accounting.mask_area(X.stack(s, d), ["cluster_id", "year"], "port")
    return found.withColumn("mask_area_m2", R(F.col("mask_area_m2")))


_ELLIPSE5 = "(VALUES " + ", ".join(f"({a}, {b})" for a, n in ((-2, 0), (-1, 2), (0, 2), (1, 2), (2, 0)) for b in range(-n, n + 1)) + ") AS e(dr, dc)"
_CHANGES = ("area_m2", "seaward_net_change_m2_from_base", "landward_net_change_m2_from_base", "total_net_change_m2_from_base", "annual_seaward_net_change_m2", "annual_landward_net_change_m2", "annual_total_net_change_m2")


def _net(sign: str, step: str) -> str:
    return f"coalesce(sum(area_m2 * {step}) FILTER ({sign}), 0.0)"


_ACCOUNT = f"""{_EARLY}, wide AS (SELECT DISTINCT cluster_id, r + dr AS r, c + dc AS c FROM early, {_ELLIPSE5} WHERE wet >= 0.9),
m AS (SELECT s.*, port::INTEGER - first_value(port) OVER t::INTEGER AS fb, port::INTEGER - coalesce(lag(port) OVER t, port)::INTEGER AS fp,
      w.r IS NOT NULL AND NOT first_value(port) OVER t AS sea FROM stack AS s LEFT JOIN wide AS w USING (cluster_id, r, c) WINDOW t AS (PARTITION BY s.cluster_id, s.r, s.c ORDER BY year)),
a AS (SELECT cluster_id, year, coalesce(sum(area_m2) FILTER (port), 0.0) AS area_m2, {_net('sea', 'fb')} AS sb, {_net('NOT sea', 'fb')} AS lb, {_net('sea', 'fp')} AS sa, {_net('NOT sea', 'fp')} AS la FROM m GROUP BY ALL)"""


@query(f"""WITH {X.STACK}, {_ACCOUNT}
SELECT cluster_id, year, min(year) OVER (PARTITION BY cluster_id) AS base_year, 'WGS84 pixel area by raster row' AS area_method, {rsql('area_m2', _CHANGES[0])}, {rsql('sb', _CHANGES[1])}, {rsql('lb', _CHANGES[2])},
{rsql('sb + lb', _CHANGES[3])}, {rsql('sa', _CHANGES[4])}, {rsql('la', _CHANGES[5])}, {rsql('sa + la', _CHANGES[6])} FROM a""")
def area_accounting(s, d):
    found = accounting.account(X.stack(s, d), ["cluster_id"], threshold=0.9, block=8)
    return found.withColumns({c: R(F.col(c)) for c in _CHANGES})


@query(f"""WITH {X.STACK}, {_ACCOUNT}
SELECT cluster_id, cluster_id + 100 AS cluster_uid, year, min(year) OVER (PARTITION BY cluster_id) AS base_year, 'WGS84 pixel area by raster row' AS area_method, {rsql('area_m2', 'area_m2_hstgo')},
{rsql('sb', _CHANGES[1])}, {rsql('lb', _CHANGES[2])}, {rsql('sb + lb', _CHANGES[3])}, {rsql('sa', _CHANGES[4])}, {rsql('la', _CHANGES[5])}, {rsql('sa + la', _CHANGES[6])},
CASE WHEN cluster_id % 2 = 0 THEN 'P' || cluster_id ELSE '' END AS resolved_portids FROM a""")
def result_rows(s, d):
    """The change table as a run writes it, thirteen columns in order."""
    x = X.stack(s, d)
    every = x.select("cluster_id").distinct()
    ports = every.where("cluster_id % 2 = 0").withColumn("ports", F.concat(F.lit("P"), F.col("cluster_id").cast("string")))
    changes = accounting.account(x, ["cluster_id"], threshold=0.9, block=8)
    found = clusters.result_rows(changes, every.withColumn("cluster_uid", F.col("cluster_id") + 100), ports)
    return found.withColumns({c: R(F.col(c)) for c in ("area_m2_hstgo", *_CHANGES[1:])})


@query(f"WITH {X.STACK}, a AS (SELECT cluster_id, year, count(*) FILTER (port) AS px FROM stack GROUP BY ALL) SELECT cluster_id, year, px FROM a")
def arrays_zip_rows(s, d):
    px = X.stack(s, d).groupBy("cluster_id", "year").agg(F.count_if("port").alias("px"))
    packed = accounting.arrays_of_rows(px, ["cluster_id"], "year", ["px"])
    return accounting.rows_of_arrays(packed, ["cluster_id"], ["year", "px"])


@query(f"""WITH {X.STACK}, x AS (SELECT *, p AS cv, 1.0 - p AS cb FROM stack)
SELECT cluster_id, year, 10.0::DOUBLE AS pixel_size_m, 100.0::DOUBLE AS projected_pixel_area_m2, {rsql('min(area_m2)', 'geodesic_pixel_area_m2_min')}, {rsql('max(area_m2)', 'geodesic_pixel_area_m2_max')},
{rsql('avg((water_prob >= 0.5)::INTEGER)', 'water_frac')}, count(*) FILTER (port) AS mask_px, {rsql('coalesce(sum(area_m2) FILTER (port), 0.0)', 'mask_area_m2')},
{rsql('avg((cv < 0.1)::INTEGER)', 'lowconf_ndvi_frac')}, {rsql('avg((cb < 0.1)::INTEGER)', 'lowconf_ndbi_frac')} FROM x GROUP BY cluster_id, year""")
def scene_diag(s, d):
    x = X.stack(s, d).withColumns({"mask": F.col("port"), "conf_ndvi": F.col("p"), "conf_ndbi": 1.0 - F.col("p")})
    found = clusters.diagnostics(x, ["cluster_id", "year"], 10.0)
    floats = ("geodesic_pixel_area_m2_min", "geodesic_pixel_area_m2_max", "water_frac", "mask_area_m2", "lowconf_ndvi_frac", "lowconf_ndbi_frac")
    return found.withColumns({c: R(F.col(c)) for c in floats})


@query(f"""WITH {X.REGIONS}, g AS (SELECT CASE WHEN grouping(region) = 1 THEN 'Global' ELSE region END AS region, sum(ports)::BIGINT AS ports, sum(area_2017) AS a, sum(area_2025) AS b, sum(seaward) AS s, sum(landward) AS l FROM regions GROUP BY ROLLUP (region))
SELECT region, ports, {rsql('a', 'area_2017')}, {rsql('b', 'area_2025')}, {rsql('b - a', 'net_change')}, {rsql('s', 'seaward')}, {rsql('l', 'landward')}, {rsql('CASE WHEN b - a > 0 THEN 100.0 * l / (b - a) END', 'landward_share_pct')} FROM g""")
def regional_rollup(s, d):
    found = accounting.regional_rollup(X.regions(s, d))
    return found.withColumns({c: R(F.col(c)) for c in ("area_2017", "area_2025", "net_change", "seaward", "landward", "landward_share_pct")})


# tiles


@query(f"""WITH {X.STACK}, o AS (SELECT y::INTEGER AS y FROM range(0, 16, 4) AS t(y))
SELECT cluster_id, year, r, c, a.y AS y0, b.y AS x0 FROM stack, o AS a, o AS b WHERE r BETWEEN a.y AND a.y + 7 AND c BETWEEN b.y AND b.y + 7""")
def tile_cover(s, d):
    found = tiles.tile_cover(X.stack(s, d).select(*AT), 8, 4)
    return found.select(*AT, F.col("y0").cast("int"), F.col("x0").cast("int"))


_H = lambda x: f"(0.5 - 0.5 * cos(2 * pi() * {x} / 7))"


@query(f"""WITH {X.STACK}, o AS (SELECT y::INTEGER AS y FROM range(0, 16, 4) AS t(y)),
t AS (SELECT cluster_id, year, r, c, p * (1 + (a.y + b.y) / 100.0) AS p, {csql(_H('(r - a.y)') + ' * ' + _H('(c - b.y)'), '1e-3', '1.0')} AS w FROM stack, o AS a, o AS b WHERE r BETWEEN a.y AND a.y + 7 AND c BETWEEN b.y AND b.y + 7)
SELECT cluster_id, year, r, c, {rsql(csql('sum(p * w) / (sum(w) + 1e-6)', '0.0', '1.0'), 'p')} FROM t GROUP BY ALL""".replace("GROUP BY ALL", "GROUP BY cluster_id, year, r, c"))
def overlap_blend(s, d):
    t = tiles.tile_cover(X.stack(s, d).select(*AT, "p"), 8, 4)
    w = P.hann2d(F.col("r") - F.col("y0"), F.col("c") - F.col("x0"), 8, 8)
    scored = t.withColumn("p", F.col("p") * (1.0 + (F.col("y0") + F.col("x0")) / 100.0)).withColumn("w", w)
    return tiles.overlap_blend(scored, ["cluster_id", "year"]).withColumn("p", R(F.col("p")))


@query(f"""WITH {X.STACK}, b AS (SELECT i::INTEGER AS i FROM range(0, 3) AS t(i))
SELECT cluster_id, year, x.i AS br, y.i AS bc, count(*) AS px, count(*) FILTER (r // 8 = x.i AND c // 8 = y.i) AS own FROM stack, b AS x, b AS y
WHERE r BETWEEN x.i * 8 - 2 AND x.i * 8 + 9 AND c BETWEEN y.i * 8 - 2 AND y.i * 8 + 9 GROUP BY ALL""")
def halo_blocks(s, d):
    found = tiles.halo_blocks(X.stack(s, d).select(*AT), 8, 2)
    own = (F.floor(F.col("r") / 8) == F.col("br")) & (F.floor(F.col("c") / 8) == F.col("bc"))
    return found.groupBy("cluster_id", "year", "br", "bc").agg(F.count("*").alias("px"), F.count_if(own).alias("own"))


@query(f"""WITH {X.SCENE}, p AS (SELECT i::INTEGER AS i, (CASE WHEN i % 14 < 8 THEN i % 14 ELSE 14 - i % 14 END)::INTEGER AS k FROM range(12) AS t(i))
SELECT scene, a.i AS r, b.i AS c, {rsql('b6', 'v')} FROM scene, p AS a, p AS b WHERE a.k = r AND b.k = c""")
def reflect_pad(s, d):
    found = tiles.reflect_pad(X.scene(s, d).select("scene", "r", "c", "b6"), 8, 8, 12)
    return found.select("scene", "r", "c", R(F.col("b6")).alias("v"))


@query(f"WITH {X.SCENE} SELECT scene, r - 2 AS r, c - 2 AS c, {rsql('b6', 'v')} FROM scene WHERE r BETWEEN 2 AND 5 AND c BETWEEN 2 AND 5")
def center_crop(s, d):
    found = tiles.center_crop(X.scene(s, d), 8, 8, 4)
    return found.select("scene", "r", "c", R(F.col("b6")).alias("v"))


@query(f"""WITH {X.SCENE}, g AS (SELECT scene, r // 4 AS y, c // 4 AS x, avg((b6 > 0.3)::INTEGER) AS f FROM scene GROUP BY ALL)
SELECT scene, y::INTEGER AS y, x::INTEGER AS x, {rsql('f', 'pos_frac')} FROM g WHERE f >= 0.05""")
def crop_accept(s, d):
    half = lambda x: F.floor(F.col(x) / 4).cast("int")
    share = F.avg((F.col("b6") > 0.3).cast("int"))
    found = X.scene(s, d).groupBy("scene", half("r").alias("y"), half("c").alias("x")).agg(share.alias("f"))
    return found.where("f >= 0.05").select("scene", "y", "x", R(F.col("f")).alias("pos_frac"))


@query(f"""WITH {X.SCENE}, u AS (SELECT scene, r, c, b6 AS v FROM scene UNION ALL SELECT scene, r, 7 - c, b6 FROM scene UNION ALL SELECT scene, 7 - r, c, b6 FROM scene UNION ALL SELECT scene, 7 - r, 7 - c, b6 FROM scene)
SELECT scene, r, c, {rsql('avg(v)', 'v')} FROM u GROUP BY scene, r, c""")
def flip_tta(s, d):
    x = X.scene(s, d).select("scene", "r", "c", F.col("b6").alias("v"))
    all4 = x
    for h, v in ((True, False), (False, True), (True, True)):
        all4 = all4.unionByName(tiles.flip(x, 8, 8, horizontal=h, vertical=v))
    return all4.groupBy("scene", "r", "c").agg(R(F.avg("v")).alias("v"))


_SRC = "greatest((i + 0.5) * (8.0::DOUBLE / 5) - 0.5, 0.0)"


@query(f"""WITH {X.SCENE}, t AS (SELECT i::INTEGER AS i, {_SRC} AS s, least(floor({_SRC})::INTEGER, 7) AS lo FROM range(5) AS t(i)),
f AS (SELECT i, lo AS k, 1.0 - (s - lo) AS w FROM t UNION ALL SELECT i, least(lo + 1, 7), s - lo FROM t)
SELECT scene, a.i AS r, b.i AS c, {rsql('sum(a.w * b.w * b6)', 'v')} FROM scene JOIN f AS a ON a.k = r JOIN f AS b ON b.k = c GROUP BY scene, a.i, b.i""")
def bilinear_resize(s, d):
    x = X.scene(s, d).select("scene", "r", "c", F.col("b6").alias("v"))
    found = tiles.bilinear_resize(x, ["scene"], "v", (8, 8), (5, 5))
    return found.withColumn("v", R(F.col("v")))


_MIRROR = lambda i: f"(CASE WHEN abs({i}) % 14 < 8 THEN abs({i}) % 14 ELSE 14 - abs({i}) % 14 END)"


@query(f"""WITH {X.SCENE}, g AS (SELECT r::INTEGER AS r, c::INTEGER AS c, r - 4 - 0.2::DOUBLE AS y, c - 4 + 0.1::DOUBLE AS x FROM range(8) AS a(r), range(8) AS b(c)),
p AS (SELECT r, c, (sin(radians(5.0)) * x + cos(radians(5.0)) * y) / 1.03 + 4 AS sy, (cos(radians(5.0)) * x - sin(radians(5.0)) * y) / 1.03 + 4 AS sx FROM g),
f AS (SELECT r, c, floor(sy)::INTEGER AS y0, floor(sx)::INTEGER AS x0, sy - floor(sy) AS fy, sx - floor(sx) AS fx FROM p),
t AS (SELECT r, c, y0 + i AS y, x0 + j AS x, (CASE i WHEN 0 THEN 1 - fy ELSE fy END) * (CASE j WHEN 0 THEN 1 - fx ELSE fx END) AS w FROM f, range(2) AS k(i), range(2) AS l(j)),
m AS (SELECT r, c, {_MIRROR('y')} AS y, {_MIRROR('x')} AS x, w FROM t)
SELECT scene, m.r, m.c, {rsql('sum(w * b6)', 'v')} FROM m JOIN scene AS s ON s.r = m.y AND s.c = m.x GROUP BY scene, m.r, m.c""")
def affine_warp(s, d):
    from tidewright.operators.stencil import affine_warp as warp

    found = warp(X.scene(s, d).select("scene", "r", "c", "b6"), ["scene"], "b6", 5.0, 1.03, 0.2, -0.1)
    return found.select("scene", "r", "c", R(F.col("b6")).alias("v"))


_N = lambda i, n: f"(CASE WHEN {n} = 1 THEN 1.0 ELSE 0.5 - 0.5 * cos(2 * pi() * {i} / greatest({n} - 1, 1)) END)"


@query(f"""WITH {X.SCENE}, o AS (SELECT y::INTEGER AS y, least(6, 8 - y)::INTEGER AS n FROM range(0, 8, 3) AS t(y)),
s AS (SELECT scene, r, c, 1.0 / (1.0 + exp(-(1.5 * (b11 - 0.1) - (b10 - 0.1) - 0.5 * (b9 - 0.1)) / (0.5 + 1e-6))) AS p FROM scene),
w AS (SELECT scene, r, c, p, {csql(_N('(r - a.y)', 'a.n') + ' * ' + _N('(c - b.y)', 'b.n'), '1e-3', '1.0')} AS w FROM s, o AS a, o AS b WHERE r BETWEEN a.y AND a.y + 5 AND c BETWEEN b.y AND b.y + 5)
SELECT scene, r, c, {rsql(csql('sum(p * w) / (sum(w) + 1e-6)', '0.0', '1.0'), 'p')} FROM w GROUP BY scene, r, c""")
def score_scene(s, d):
    found = score_scenes(X.scene(s, d), ["scene"], [0.1] * 12, [0.5] * 12, patch=6, stride=3)
    return found.withColumn("p", R(F.col("p")))


_RAMP = lambda k, n: f"round(least(greatest(1.5 - abs(4.0 * floor((w - 1.0::DOUBLE) / 2.0::DOUBLE * 255.0::DOUBLE) / 255.0::DOUBLE - {k}), 0.0), 1.0) * 255.0)::INTEGER AS {n}"


@query(f"""WITH {X.STACK}, weighed AS (SELECT cluster_id, year, r, c, 1.0::DOUBLE + 2.0::DOUBLE * p AS w FROM stack)
SELECT cluster_id, year, r, c, {_RAMP(3.0, 'red')}, {_RAMP(2.0, 'green')}, {_RAMP(1.0, 'blue')} FROM weighed""")
def heat_map(s, d):
    found = adaptive.heat(X.stack(s, d).withColumn("w", 1.0 + 2.0 * F.col("p")), "w", 2.0)
    return found.select(*AT, "red", "green", "blue")


# space-time cut


def _layers(s, d):
    return X.stack(s, d).select(*AT, F.col("p").alias("prob_refined"), "water_prob", (F.col("area_m2") * 2).alias("dist_to_water_m"), "area_m2")


@query()
def stmincut(s, d):
    x = _layers(s, d)
    p = F.col("prob_refined")
    costs = x.select(*AT, P.log_cost(p).alias("t"), P.log_cost(1.0 - p).alias("f"), F.lit(0.3).alias("w"), F.lit(1.0).alias("g"), F.lit(2.0).alias("b"))
    return spacetime.minimum_cut(costs, ["cluster_id"], "t", "f", "w", "g", "b", block=16, pad=0)


@query(f"""WITH RECURSIVE {X.STACK}, k AS (SELECT cluster_id, r, c, row_number() OVER (PARTITION BY cluster_id, r, c ORDER BY year) AS k,
  -ln({csql('p', '1e-6', '1.0')}) AS t, -ln({csql('1.0 - p', '1e-6', '1.0')}) AS f FROM stack),
best AS (SELECT cluster_id, r, c, k, f AS e0, t AS e1 FROM k WHERE k = 1
  UNION ALL SELECT n.cluster_id, n.r, n.c, n.k, least(e0, e1 + 2.0) + n.f, least(e1, e0 + 1.0) + n.t FROM best AS b JOIN k AS n ON n.cluster_id = b.cluster_id AND n.r = b.r AND n.c = b.c AND n.k = b.k + 1)
SELECT cluster_id, r, c, {rsql('least(e0, e1)', 'energy')} FROM best WHERE k = (SELECT max(k) FROM k)""")
def mincut_energy(s, d):
    """Least energy per pixel series without spatial weights, as the labels of the cut pay it."""
    x = _layers(s, d)
    p = F.col("prob_refined")
    costs = x.select(*AT, P.log_cost(p).alias("t"), P.log_cost(1.0 - p).alias("f"), F.lit(0.0).alias("w"), F.lit(1.0).alias("g"), F.lit(2.0).alias("b"))
    labels = spacetime.minimum_cut(costs, ["cluster_id"], "t", "f", "w", "g", "b", block=16, pad=0)
    paid = labels.join(costs, AT).withColumn("was", temporal.previous(F.col("label"), CELL))
    now, was = F.col("label"), F.col("was")
    step = F.when(now & ~was, F.col("g")).when(~now & was, F.col("b")).otherwise(0.0)
    return paid.groupBy(*CELL).agg(R(F.sum(F.when(now, F.col("t")).otherwise(F.col("f")) + step)).alias("energy"))


@query()
def space_time_block(s, d):
    return spacetime.label_ports(_layers(s, d), ["cluster_id"], block=8, pad=4)


@query()
def label_and_account(s, d):
    found = clusters.label_and_account(_layers(s, d), clusters.RunConfig(block=8, pad=4, pixel_m=60.0, sea_water=0.9))
    return found.withColumns({c: R(F.col(c)) for c in _CHANGES})
