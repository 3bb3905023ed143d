"""Queries of sources, scalar formulas and adaptive thresholds, with their SQL twins."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidewright.functions import constants as K
from tidewright.functions import pixel as P
from tidewright.operators import adaptive, metrics
from tidewright.operators import augment as A
from tidewright.plans import clusters
from tidewright.plans import fixtures as X
from tidewright.plans.fixtures import csql, rsql
from tidewright.sources import catalog

QUERIES, ORACLES = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = sql
        return f

    return add


AT = ["scene", "r", "c"]
R = P.rounded


def _pick(df, keys, **cols):
    return df.select(*keys, *[R(v).alias(k) for k, v in cols.items()])


# sources


def _scan(s, d):
    return catalog.scene_catalog(X.files(s, d), exclude=[7, 8])


@query(f"WITH {X.FILES} SELECT cluster_id, cluster_uid, year, path FROM scan")
def scan_catalog(s, d):
    return _scan(s, d)


_PORT_ROWS = """rows AS (SELECT c_custkey AS row_no, CASE WHEN c_custkey % 9 = 0 THEN 'bad' ELSE (c_custkey % 50)::VARCHAR END AS cluster_id,
  CASE WHEN c_custkey % 7 = 0 THEN NULL ELSE c_name END AS resolved FROM customer),
ports AS (SELECT cluster_id::INTEGER AS cluster_id, last(coalesce(resolved, '') ORDER BY row_no) AS ports
          FROM rows WHERE cluster_id <> 'bad' GROUP BY ALL)"""


def _ports(s, d):
    k = F.col("c_custkey")
    rows = X.table(s, d, "customer").select(
        k.alias("row_no"), F.when(k % 9 == 0, "bad").otherwise((k % 50).cast("string")).alias("cluster_id"),
        F.when(k % 7 != 0, F.col("c_name")).alias("resolved_portids"),
    )
    return catalog.port_map(rows)


@query(f"WITH {_PORT_ROWS} SELECT cluster_id, ports FROM ports")
def port_map(s, d):
    return _ports(s, d)


@query(f"WITH {X.FILES}, {_PORT_ROWS} SELECT cluster_id, year, coalesce(ports, '') AS ports FROM scan LEFT JOIN ports USING (cluster_id)")
def port_lookup_left(s, d):
    return catalog.with_ports(_scan(s, d).select("cluster_id", "year"), _ports(s, d))


@query(f"WITH {X.DN_LONG} SELECT scene, r, c, dn FROM dn_long WHERE band = 3")
def band_scan(s, d):
    return X.dn_long(s, d).where("band = 3").select(*AT, "dn")


@query(f"WITH {X.DN_LONG} SELECT scene, band, r, c, dn FROM dn_long WHERE r BETWEEN 4 AND 7 AND c BETWEEN 0 AND 3")
def tile_window(s, d):
    from tidewright.operators.tiles import crop

    tile = crop(X.dn_long(s, d), 4, 0, 4, 4)
    return tile.select("scene", "band", (F.col("r") + 4).alias("r"), "c", "dn")


@query("""WITH images AS (SELECT doc_id, (doc_id % 5)::INTEGER AS k FROM documents)
SELECT doc_id, k, coalesce(quality, 0) AS label FROM images LEFT JOIN labels USING (doc_id)""")
def pair_left_join(s, d):
    images = X.table(s, d, "documents").select("doc_id", (F.col("doc_id") % 5).cast("int").alias("k"))
    masks = X.table(s, d, "labels").select("doc_id", F.col("quality").alias("label"))
    return catalog.pair_labels(images, masks, ["doc_id"])


@query(f"WITH {X.SCENE} SELECT scene, r, c, {rsql('b6', 'x0')}, {rsql('b7', 'x1')}, {rsql('b10', 'x2')} FROM scene")
def channel_select(s, d):
    df = X.scene(s, d)
    picked = df.select(*AT, catalog.select_channels(F.array(*[f"b{k}" for k in range(12)]), [6, 7, 10]).alias("x"))
    return _pick(picked, AT, **{f"x{i}": F.get("x", F.lit(i)) for i in range(3)})


@query(f"""WITH {X.STACK} SELECT cluster_id, year, {rsql('min(p)', 'min_v')}, {rsql('max(p)', 'max_v')}, {rsql('avg(p)', 'mean_v')},
count(*) FILTER (p <> 0) AS nonzero, bool_and(p = 0) AS all_zero FROM stack GROUP BY ALL""")
def stack_profile(s, d):
    found = catalog.stack_profile(X.stack(s, d), ["cluster_id", "year"], "p")
    return found.withColumns({c: R(F.col(c)) for c in ("min_v", "max_v", "mean_v")})


@query("""SELECT p_partkey, coalesce(CASE WHEN p_size > 25 THEN p_retailprice END, CASE WHEN p_partkey % 2 = 0 THEN 2.0::DOUBLE END, 1.0::DOUBLE) AS mean
FROM part""")
def stats_precedence(s, d):
    given = F.when(F.col("p_size") > 25, F.col("p_retailprice"))
    stored = F.when(F.col("p_partkey") % 2 == 0, 2.0)
    return X.table(s, d, "part").select("p_partkey", catalog.first_given(given, stored, F.lit(1.0)).alias("mean"))


@query(f"""WITH {X.FILES} SELECT cluster_id, y::INTEGER AS year FROM (SELECT DISTINCT cluster_id FROM scan), range(2017, 2026) AS t(y)
WHERE (cluster_id, y) NOT IN (SELECT (cluster_id, year) FROM scan)""")
def missing_years(s, d):
    found = _scan(s, d)
    return catalog.missing(catalog.expected_years(found, 2017, 2025), found, ["cluster_id", "year"])


@query(f"""WITH {X.FILES}, want AS (SELECT cluster_id, year, layer FROM scan, (VALUES ('dist_to_water_m'), ('prob_refined'), ('water_prob')) AS l(layer))
SELECT cluster_id, year, layer FROM want WHERE NOT (layer = 'water_prob' AND cluster_id % 2 = 0) AND NOT (layer <> 'water_prob' AND year % 2 = 0)""")
def missing_inputs(s, d):
    layers = F.explode(F.array(*[F.lit(x) for x in ("dist_to_water_m", "prob_refined", "water_prob")]))
    want = _scan(s, d).select("cluster_id", "year", layers.alias("layer"))
    water = F.col("layer") == "water_prob"
    have = want.where((water & (F.col("cluster_id") % 2 == 0)) | (~water & (F.col("year") % 2 == 0)))
    return catalog.missing(want, have, ["cluster_id", "year", "layer"])


@query(f"WITH {X.FILES} SELECT DISTINCT cluster_id, cluster_uid FROM scan WHERE cluster_id NOT IN (SELECT n_nationkey FROM nation)")
def resume_antijoin(s, d):
    todo = _scan(s, d).select("cluster_id", "cluster_uid").distinct()
    return catalog.pending(todo, X.table(s, d, "nation").select(F.col("n_nationkey").alias("cluster_id")), ["cluster_id"])


@query("""SELECT p_partkey, concat_ws(',', p_partkey % 12, (p_partkey + 1) % 12, (p_partkey + 5) % 12) AS channels FROM part""")
def parse_channels(s, d):
    k = F.col("p_partkey")
    text = F.concat(F.lit(" "), (k % 12).cast("string"), F.lit(", "), ((k + 1) % 12).cast("string"), F.lit(",,"), ((k + 5) % 12).cast("string"))
    return X.table(s, d, "part").select("p_partkey", F.array_join(catalog.parse_channels(text).cast("array<string>"), ",").alias("channels"))


@query(f"WITH {X.SCENE}, g AS (SELECT scene, [avg(b6), avg(b7), avg(b10)] AS v FROM scene GROUP BY ALL) SELECT scene, {rsql('atan(v[1])', 'm0')}, {rsql('atan(v[3])', 'm2')} FROM g")
def stats_slice(s, d):
    df = X.scene(s, d).groupBy("scene").agg(F.array(*[F.avg(f"b{k}") for k in range(12)]).alias("v"))
    cut = df.select("scene", catalog.select_channels(F.col("v"), [6, 7, 10]).alias("v"))
    return _pick(cut, ["scene"], m0=F.atan(F.get("v", F.lit(0))), m2=F.atan(F.get("v", F.lit(2))))


# scalar formulas


@query(f"WITH {X.SCENE} SELECT scene, r, c, " + ", ".join(rsql(f"b{k}", f"b{k}") for k in range(12)) + " FROM scene")
def decode_u16(s, d):
    return _pick(X.scene(s, d), AT, **{f"b{k}": F.col(f"b{k}") for k in range(12)})


@query(f"""WITH {X.DN_LONG} SELECT scene, band, r, c, {rsql(f'''CASE WHEN band <= 5 THEN dn * 1e-4 WHEN band <= 7 THEN {csql("(dn * 1e-3 - 35.0 + 25.0) / 30.0", "0.0", "1.0")}
WHEN band = 8 THEN {csql("(dn * 1e-3 - 20.0) / 15.0", "0.0", "1.0")} ELSE dn * 1e-4 - 1.0 END''', 'v')} FROM dn_long""")
def decode_band_long(s, d):
    return _pick(X.dn_long(s, d), ["scene", "band", "r", "c"], v=P.decode_by_band(F.col("dn"), F.col("band")))


@query("""WITH x AS (SELECT event_id, CASE event_id % 5 WHEN 0 THEN 'NaN'::DOUBLE WHEN 1 THEN 'Infinity'::DOUBLE WHEN 2 THEN NULL ELSE value END AS v FROM events)
SELECT event_id, CASE WHEN v IS NULL OR isnan(v) OR isinf(v) THEN 0.0::DOUBLE ELSE v END AS v FROM x""")
def nan_clean(s, d):
    k = F.col("event_id") % 5
    v = F.when(k == 0, float("nan")).when(k == 1, float("inf")).when(k != 2, F.col("value"))
    return X.table(s, d, "events").select("event_id", P.clean(v).alias("v"))


@query(f"WITH {X.INDEXED} SELECT scene, r, c, {rsql('ndvi', 'ndvi')}, {rsql('mndwi', 'mndwi')}, {rsql('ndbi', 'ndbi')} FROM indexed")
def spectral_indices(s, d):
    return _pick(X.indexed(s, d), AT, ndvi=F.col("ndvi"), mndwi=F.col("mndwi"), ndbi=F.col("ndbi"))


def _conf(x: str) -> str:
    return csql(f"({x} - 0.02) / (0.06 + 1e-6)", "0.0", "1.0")


@query(f"WITH {X.INDEXED} SELECT scene, r, c, {rsql(_conf('ndvi_den'), 'conf_ndvi')}, {rsql(_conf('ndbi_den'), 'conf_ndbi')}, {rsql('ndvi * ' + _conf('ndvi_den'), 'ndvi')} FROM indexed")
def index_confidence(s, d):
    v = P.denominator_confidence(F.col("ndvi_den"))
    return _pick(X.indexed(s, d), AT, conf_ndvi=v, conf_ndbi=P.denominator_confidence(F.col("ndbi_den")), ndvi=F.col("ndvi") * v)


_LOGIT = "ln({0} / (1.0 - {0}))"


def _lg(x: str) -> str:
    return _LOGIT.format(csql(x, "1e-6", "(1 - 1e-6)"))


def _sg(x: str) -> str:
    return f"(1.0 / (1.0 + exp(-({x}))))"


@query(f"WITH {X.STACK} SELECT cluster_id, year, r, c, {rsql(_sg('p * 4 - 2'), 'sig')}, {rsql(_lg('p'), 'lg')} FROM stack")
def sigmoid_logit(s, d):
    return _pick(X.stack(s, d), ["cluster_id", "year", "r", "c"], sig=P.sigmoid(F.col("p") * 4 - 2), lg=P.logit(F.col("p")))


@query("SELECT o_orderkey, " + rsql("CASE WHEN o_custkey % 7 = 0 OR o_totalprice / 100.0 > 800.0 THEN 0.0 ELSE exp(-(o_totalprice / 100.0) / 120.0) END", "coast") + " FROM orders")
def coast_score(s, d):
    return _pick(X.table(s, d, "orders"), ["o_orderkey"], coast=P.coast_score(F.col("o_totalprice") / 100.0, F.col("o_custkey") % 7 == 0))


_PRIOR = csql(_sg("-0.3 + 2.0 * vv + 1.0 * ((ndbi + 1) * 0.5 - 0.5) + 0.9 * ((1.0 - (ndvi + 1) * 0.5) - 0.5)"), "0.02", "0.98")


@query(f"WITH {X.INDEXED} SELECT scene, r, c, {rsql(_PRIOR, 'prior')} FROM indexed")
def geo_prior(s, d):
    return _pick(X.indexed(s, d), AT, prior=P.geo_prior(F.col("ndvi"), F.col("ndbi"), F.col("vv")))


@query(f"WITH {X.INDEXED}, q AS (SELECT *, {_PRIOR} AS prior FROM indexed) SELECT scene, r, c, {rsql(f'CASE WHEN vv > 0.95 THEN 0.0 ELSE {_sg(_lg("vh") + " + 0.55 * " + _lg("prior"))} END', 'fused')} FROM q")
def prior_fusion(s, d):
    x = X.indexed(s, d)
    return _pick(x, AT, fused=P.fuse_prior(F.col("vh"), P.geo_prior(F.col("ndvi"), F.col("ndbi"), F.col("vv")), F.col("vv")))


@query(f"""WITH {X.SCENE}, m AS (SELECT scene, avg(b3) AS mu, stddev_pop(b3) AS sd FROM scene GROUP BY ALL),
z AS (SELECT scene, r, c, (b3 - mu) / (sd + 1e-6) AS z, mu, sd FROM scene JOIN m USING (scene))
SELECT scene, r, c, {rsql('z', 'z')}, {rsql('z * (sd + 1e-6) + mu', 'back')} FROM z""")
def normalize_bands(s, d):
    df = adaptive.with_statistics(X.scene(s, d), ["scene"], {"mu": F.avg("b3"), "sd": F.stddev_pop("b3")})
    z = df.withColumn("z", P.normalise(F.col("b3"), F.col("mu"), F.col("sd")))
    return _pick(z, AT, z=F.col("z"), back=P.denormalise(F.col("z"), F.col("mu"), F.col("sd")))


@query(f"WITH {X.LOGITS} SELECT scene, r, c, {rsql('p', 'p')} FROM logits")
def softmax_fg(s, d):
    return _pick(X.logits(s, d), AT, p=F.col("p"))


@query(f"WITH {X.LOGITS} SELECT scene, r, c, pred FROM logits")
def argmax_class(s, d):
    return X.logits(s, d).select(*AT, "pred")


_HANN = csql("(0.5 - 0.5 * cos(2 * pi() * (l_partkey % 16) / 15)) * (0.5 - 0.5 * cos(2 * pi() * (l_suppkey % 16) / 15))", "1e-3", "1.0")


@query(f"SELECT DISTINCT (l_partkey % 16)::INTEGER AS r, (l_suppkey % 16)::INTEGER AS c, {rsql(_HANN, 'w')} FROM lineitem")
def hann_weights(s, d):
    li = X.table(s, d, "lineitem").select((F.col("l_partkey") % 16).cast("int").alias("r"), (F.col("l_suppkey") % 16).cast("int").alias("c")).distinct()
    return _pick(li, ["r", "c"], w=P.hann2d(F.col("r"), F.col("c"), 16, 16))


@query(f"WITH {X.STACK} SELECT cluster_id, year, r, c, {rsql('-ln(' + csql('p', '1e-6', '1.0') + ')', 'fg')}, {rsql('-ln(' + csql('1.0 - p', '1e-6', '1.0') + ')', 'bg')} FROM stack")
def unary_costs(s, d):
    return _pick(X.stack(s, d), ["cluster_id", "year", "r", "c"], fg=P.log_cost(F.col("p")), bg=P.log_cost(1.0 - F.col("p")))


@query(f"""WITH {X.STACK}, q AS (SELECT *, 1.0 / (1.0 + exp(-((p - 0.55) * 6.0))) AS e, area_m2 AS dist, p * p AS decline FROM stack)
SELECT cluster_id, year, r, c, {rsql('2.0::DOUBLE', 'f1')}, {rsql('50.0 * (1.0 - water_prob)', 'b1')}, {rsql('greatest((20.0 + 50.0 * p) * (1.0 - 0.6 * decline), 2.0)', 'f2')},
{rsql('greatest(2.0 + 40.0 * (1.0 - e) - 6.0 * exp(-dist / 200.0) * e, 1.0)', 'b2')} FROM q""")
def transition_penalties(s, d):
    x = X.stack(s, d)
    f1, b1 = P.l1_penalties(F.col("water_prob"))
    f2, b2 = P.l2_penalties(F.col("p"), F.col("p") * F.col("p"), F.col("area_m2"))
    return _pick(x, ["cluster_id", "year", "r", "c"], f1=f1, b1=b1, f2=f2, b2=b2)


_LON, _LAT = "(111412.84 * cos(a) - 93.5 * cos(3 * a))", "(111132.92 - 559.82 * cos(2 * a) + 1.175 * cos(4 * a))"


@query(f"""WITH x AS (SELECT c_custkey, c_custkey % 2 = 0 AS metric, (c_acctbal / 200.0) AS lat, radians(c_acctbal / 200.0) AS a, (c_custkey % 30 + 1) * 1e-4 AS dx, (c_custkey % 20 + 1) * 1e-4 AS dy FROM customer),
y AS (SELECT c_custkey, CASE WHEN metric THEN dx ELSE dx * {_LON} END AS px, CASE WHEN metric THEN dy ELSE dy * {_LAT} END AS py FROM x)
SELECT c_custkey, {rsql('(px + py) * 0.5', 'side')}, {rsql('px * py', 'area')} FROM y""")
def pixel_metrics(s, d):
    k = F.col("c_custkey")
    wkt = F.when(k % 2 == 0, 'PROJCS["UTM"]').otherwise('GEOGCS["WGS 84"]')
    side, area = P.pixel_size((k % 30 + 1) * 1e-4, -(k % 20 + 1) * 1e-4, F.col("c_acctbal") / 200.0, P.is_metric(wkt))
    return _pick(X.table(s, d, "customer"), ["c_custkey"], side=side, area=area)


@query("""SELECT p_partkey, CASE WHEN p_partkey % 3 = 0 THEN 'EPSG:3857' WHEN p_partkey % 3 = 1 THEN 'GEOGCS["WGS 84"]' ELSE 'LOCAL_CS["x"]' END AS crs FROM part""")
def crs_fix(s, d):
    k = F.col("p_partkey") % 3
    wkt = F.when(k == 0, 'LOCAL_CS["WGS 84 / Pseudo-Mercator"]').when(k == 1, 'GEOGCS["WGS 84"]').otherwise('LOCAL_CS["x"]')
    return X.table(s, d, "part").select("p_partkey", P.effective_crs(wkt).alias("crs"))


_E2 = "(1 / 298.257223563::DOUBLE * (2 - 1 / 298.257223563::DOUBLE))"


@query(f"""WITH x AS (SELECT DISTINCT l_partkey % 1000 AS r FROM lineitem), y AS (SELECT r, radians(30.0 - (r + 0.5) * 1e-4) AS a FROM x),
z AS (SELECT r, a, 1.0 - {_E2} * sin(a) * sin(a) AS q FROM y)
SELECT r, {rsql(f'6378137.0 * (1 - {_E2}) / pow(q, 1.5) * (6378137.0 / sqrt(q)) * cos(a) * radians(1e-4) * radians(1e-4)', 'area_m2')} FROM z""")
def row_areas(s, d):
    rows = X.table(s, d, "lineitem").select((F.col("l_partkey") % 1000).alias("r")).distinct()
    return _pick(rows, ["r"], area_m2=P.row_area(30.0 - (F.col("r") + 0.5) * 1e-4, F.lit(1e-4), F.lit(1e-4)))


@query("""WITH x AS (SELECT l_orderkey, l_linenumber, (l_orderkey % 4)::INTEGER AS sample, CASE l_orderkey % 4 WHEN 0 THEN (l_partkey % 2)::INTEGER WHEN 1 THEN ((l_partkey % 2) * 255)::INTEGER WHEN 2 THEN (l_partkey % 12)::INTEGER ELSE (l_partkey % 9)::INTEGER END AS label FROM lineitem),
g AS (SELECT sample, max(label) AS m, count(DISTINCT label) AS u FROM x GROUP BY ALL)
SELECT l_orderkey, l_linenumber, sample, label, (label > 0)::INTEGER AS y_bin, CASE WHEN NOT (m <= 1 OR (m = 255 AND u <= 2)) THEN least(greatest(label, 0), 8) END AS y_aux FROM x JOIN g USING (sample)""")
def aux_labels(s, d):
    k, p = F.col("l_orderkey") % 4, F.col("l_partkey")
    label = F.when(k == 0, p % 2).when(k == 1, p % 2 * 255).when(k == 2, p % 12).otherwise(p % 9)
    x = X.table(s, d, "lineitem").select("l_orderkey", "l_linenumber", k.cast("int").alias("sample"), label.cast("int").alias("label"))
    return metrics.aux_labels(x, ["sample"], "label").select("l_orderkey", "l_linenumber", "sample", "label", "y_bin", "y_aux")


def hsql(seed: int, *keys: str) -> str:
    """SQL twin of ``pixel.hashed_uniform``."""
    return f"(('0x' || substr(md5(concat_ws(':', '{seed}', {', '.join(keys)})), 1, 12))::BIGINT / {1 << 48}.0::DOUBLE)"


def _noisy(i: int) -> str:
    u, v = (hsql(A.NOISE_SEED + 2 * i + k, "scene", "r", "c") for k in (0, 1))
    return f"CASE WHEN {hsql(A.NOISE, 'scene')} < 0.25 THEN b{6 + i} + 0.02 * sqrt(-2.0 * ln(1.0 - {u})) * cos(2.0 * pi() * {v}) ELSE b{6 + i} END"


_GAINED = [csql(f"b{i} * (0.9 + 0.2 * {hsql(A.GAIN, 'scene')}) + (-0.02 + 0.04 * {hsql(A.BIAS, 'scene')})", "0.0", "1.0") for i in range(6)]


@query(f"WITH {X.SCENE} SELECT scene, r, c, " + ", ".join(
    [rsql(f"CASE WHEN {hsql(A.JITTER, 'scene')} < 0.3 THEN {_GAINED[i]} ELSE b{i} END", f"b{i}") for i in range(6)] + [rsql(_noisy(i), f"b{6 + i}") for i in range(3)]
) + " FROM scene")
def augment_jitter(s, d):
    bands = [f"b{i}" for i in range(9)]
    found = A.disturb(X.scene(s, d).select(*AT, *bands), ["scene"], bands[:6], bands[6:])
    return _pick(found, AT, **{b: F.col(b) for b in bands})


_TURNED = f"""k AS (SELECT DISTINCT scene, {hsql(A.FLIP_LR, 'scene')} < 0.5 AS lr, {hsql(A.FLIP_UD, 'scene')} < 0.5 AS ud,
  CASE WHEN {hsql(A.ROTATE, 'scene')} < 0.5 THEN floor(4 * {hsql(A.TURNS, 'scene')}) ELSE 0 END AS t FROM scene),
f AS (SELECT scene, t, CASE WHEN ud THEN 7 - r ELSE r END AS r, CASE WHEN lr THEN 7 - c ELSE c END AS c, b6 FROM scene JOIN k USING (scene))"""


@query(f"""WITH {X.SCENE}, {_TURNED} SELECT scene, (CASE t WHEN 1 THEN 7 - c WHEN 2 THEN 7 - r WHEN 3 THEN c ELSE r END)::INTEGER AS r,
(CASE t WHEN 1 THEN r WHEN 2 THEN 7 - c WHEN 3 THEN 7 - r ELSE c END)::INTEGER AS c, {rsql('b6', 'b6')} FROM f""")
def augment_turns(s, d):
    found = A.turn(X.scene(s, d).select(*AT, "b6"), ["scene"])
    return _pick(found.withColumns({x: F.col(x).cast("int") for x in ("r", "c")}), AT, b6=F.col("b6"))


@query(f"""SELECT l_orderkey AS step, {rsql("CASE WHEN l_orderkey < 500 THEN (l_orderkey + 1) / 500.0::DOUBLE ELSE 0.05 + 0.95 * (0.5 * (1 + cos(pi() * (l_orderkey - 500) / 100000.0::DOUBLE))) END", 'lr')},
{rsql("CASE WHEN l_linenumber * 3 > 5 THEN least(1.0::DOUBLE, (l_linenumber * 3 - 5 + 1) / 10.0::DOUBLE) ELSE 0.0 END", 'ramp')} FROM (SELECT DISTINCT l_orderkey, l_linenumber FROM lineitem)""")
def lr_schedule(s, d):
    x = X.table(s, d, "lineitem").select(F.col("l_orderkey").alias("step"), (F.col("l_linenumber") * 3).alias("e")).distinct()
    return _pick(x, ["step"], lr=P.warmup_cosine(F.col("step"), 500, 100_500, 0.05), ramp=P.aux_ramp(F.col("e")))


@query(f"SELECT i::INTEGER AS i, {rsql('0.25::DOUBLE + 0.025 * i', 'thr')} FROM range(21) AS t(i)")
def threshold_grid(s, d):
    rows = s.range(1).select(F.posexplode(F.array(*[F.lit(t) for t in metrics.thresholds()])).alias("i", "thr"))
    return _pick(rows, ["i"], thr=F.col("thr"))


# adaptive thresholds

WATER = f"""w AS (SELECT *, sqrt(vv * vv + vh * vh + 1e-6) AS inten FROM indexed),
t AS (SELECT scene, quantile_cont(mndwi, 0.85) AS thr_m, quantile_cont(inten, 0.2) AS thr_i FROM w GROUP BY ALL),
water AS (SELECT w.*, thr_m, thr_i, {_sg('(mndwi - thr_m) * 10.0')} * {_sg('(thr_i - inten) * 10.0')} AS water_prob FROM w JOIN t USING (scene))"""


@query(f"WITH {X.INDEXED}, {WATER} SELECT scene, r, c, {rsql('thr_m', 'thr_m')}, {rsql('thr_i', 'thr_i')}, {rsql('water_prob', 'water_prob')} FROM water")
def water_prob(s, d):
    found = adaptive.water_probability(X.indexed(s, d), ["scene"])
    return _pick(found, AT, **{c: F.col(c) for c in ("thr_m", "thr_i", "water_prob")})


@query(f"WITH {X.INDEXED}, t AS (SELECT scene, quantile_cont(mndwi, 0.85) AS thr FROM indexed GROUP BY ALL) SELECT scene, r, c, {rsql('thr', 'thr')}, mndwi > thr AS water FROM indexed JOIN t USING (scene)")
def water_mask_quantile(s, d):
    found = adaptive.water_mask_quantile(X.indexed(s, d), ["scene"])
    return found.select(*AT, R(F.col("thr")).alias("thr"), "water")


@query(f"WITH {X.INDEXED} SELECT scene, r, c, mndwi > -0.05 AS water FROM indexed")
def water_mask_fixed(s, d):
    return adaptive.water_mask_fixed(X.indexed(s, d)).select(*AT, "water")


OTSU = """q AS (SELECT scene, quantile_cont(mndwi, 0.01) AS p1, quantile_cont(mndwi, 0.99) AS p99 FROM indexed GROUP BY ALL),
b AS (SELECT scene, p1, p99, trunc(least(greatest((least(greatest(mndwi, p1), p99) - p1) / (p99 - p1 + 1e-6) * 255.0, 0), 255))::INTEGER AS bin FROM indexed JOIN q USING (scene)),
h AS (SELECT scene, p1, p99, bin, count(*) AS n FROM b GROUP BY ALL),
cs AS (SELECT *, sum(n) OVER o AS n0, sum(n * bin) OVER o AS s0, sum(n) OVER (PARTITION BY scene) AS nn, sum(n * bin) OVER (PARTITION BY scene) AS ss FROM h WINDOW o AS (PARTITION BY scene ORDER BY bin)),
v AS (SELECT scene, p1, p99, bin, round(CASE WHEN nn > n0 THEN n0 * (nn - n0) * pow(s0 / n0::DOUBLE - (ss - s0) / (nn - n0)::DOUBLE, 2) ELSE 0.0 END, 6) AS sb FROM cs),
m AS (SELECT scene, p1, p99, first(bin ORDER BY sb DESC, bin) AS t FROM v GROUP BY ALL)"""
OTSU_THR = "CASE WHEN p99 <= p1 + 1e-6 THEN -0.05 ELSE p1 + t / 255.0::DOUBLE * (p99 - p1) END"


@query(f"WITH {X.INDEXED}, {OTSU} SELECT scene, {rsql(OTSU_THR, 'thr')} FROM m")
def otsu_threshold(s, d):
    return _pick(adaptive.otsu_thresholds(X.indexed(s, d), ["scene"]), ["scene"], thr=F.col("thr"))


@query(f"WITH {X.INDEXED}, t AS (SELECT scene, quantile_cont(mndwi, 0.85) AS thr FROM indexed GROUP BY ALL) SELECT scene, r, c, {rsql('thr', 'thr')}, mndwi > thr AS water FROM indexed JOIN t USING (scene)")
def water_mask_quantile(s, d):
    found = adaptive.water_mask_quantile(X.indexed(s, d), ["scene"])
    return found.select(*AT, R(F.col("thr")).alias("thr"), "water")


@query(f"WITH {X.INDEXED} SELECT scene, r, c, mndwi > -0.05 AS water FROM indexed")
def water_mask_fixed(s, d):
    return adaptive.water_mask_fixed(X.indexed(s, d)).select(*AT, "water")


OTSU = """q AS (SELECT scene, quantile_cont(mndwi, 0.01) AS p1, quantile_cont(mndwi, 0.99) AS p99 FROM indexed GROUP BY ALL),
b AS (SELECT scene, p1, p99, trunc(least(greatest((least(greatest(mndwi, p1), p99) - p1) / (p99 - p1 + 1e-6) * 255.0, 0), 255))::INTEGER AS bin FROM indexed JOIN q USING (scene)),
h AS (SELECT scene, p1, p99, bin, count(*) AS n FROM b GROUP BY ALL),
cs AS (SELECT *, sum(n) OVER o AS n0, sum(n * bin) OVER o AS s0, sum(n) OVER (PARTITION BY scene) AS nn, sum(n * bin) OVER (PARTITION BY scene) AS ss FROM h WINDOW o AS (PARTITION BY scene ORDER BY bin)),
v AS (SELECT scene, p1, p99, bin, round(CASE WHEN nn > n0 THEN n0 * (nn - n0) * pow(s0 / n0::DOUBLE - (ss - s0) / (nn - n0)::DOUBLE, 2) ELSE 0.0 END, 6) AS sb FROM cs),
m AS (SELECT scene, p1, p99, first(bin ORDER BY sb DESC, bin) AS t FROM v GROUP BY ALL)"""
OTSU_THR = "CASE WHEN p99 <= p1 + 1e-6 THEN -0.05 ELSE p1 + t / 255.0::DOUBLE * (p99 - p1) END"


@query(f"WITH {X.INDEXED}, {OTSU} SELECT scene, {rsql(OTSU_THR, 'thr')} FROM m")
def otsu_threshold(s, d):
    return _pick(adaptive.otsu_thresholds(X.indexed(s, d), ["scene"]), ["scene"], thr=F.col("thr"))


@query()
def otsu_water_mask(s, d):
    found = region.water_mask_otsu(X.indexed(s, d), ["scene"], block=8)
    return found.select(*AT, R(F.col("thr")).alias("thr"), "water")


@query(f"WITH {X.INDEXED}, t AS (SELECT scene, quantile_cont(mndwi, 0.85) AS thr FROM indexed GROUP BY ALL) SELECT scene, r, c, {rsql(_sg('(mndwi - thr) * 10.0'), 'a_water')} FROM indexed JOIN t USING (scene)")
def paim_water(s, d):
    return _pick(adaptive.index_water(X.indexed(s, d), ["scene"]), AT, a_water=F.col("a_water"))


_PROBES = ", ".join(f"quantile_cont(mndwi, {q})" for q in K.PROBES)


@query(f"WITH {X.INDEXED}, q AS (SELECT scene, [{_PROBES}] AS v FROM indexed GROUP BY ALL) SELECT scene, (k - 1)::INTEGER AS k, {rsql('v[k]', 'v')} FROM q, range(1, 10) AS t(k)")
def robust_percentiles(s, d):
    found = adaptive.summarize(X.indexed(s, d), ["scene"], "mndwi")
    return _pick(found.select("scene", F.posexplode("percentiles").alias("k", "v")), ["scene", "k"], v=F.col("v"))


@query(f"""WITH {X.INDEXED} SELECT scene, count(*) AS n, {rsql('avg(ndvi)', 'mean')}, {rsql('stddev_pop(ndvi)', 'std')}, {rsql('min(ndvi)', 'min')}, {rsql('max(ndvi)', 'max')},
{rsql('quantile_cont(ndvi, 0.5)', 'median')} FROM indexed GROUP BY ALL""")
def summarize_1d(s, d):
    found = adaptive.summarize(X.indexed(s, d), ["scene"], "ndvi")
    return _pick(found, ["scene", "n"], mean=F.col("mean"), std=F.col("std"), min=F.col("min"), max=F.col("max"), median=F.get("percentiles", F.lit(4)))


@query(f"""WITH {X.SCENE}, u AS (SELECT scene, unnest([b2, b1, b0]) AS v FROM scene), q AS (SELECT scene, quantile_cont(v, 0.02) AS lo, quantile_cont(v, 0.98) AS hi FROM u GROUP BY ALL)
SELECT scene, r, c, """ + ", ".join(f"trunc({csql(f'({b} - lo) / (hi - lo + 1e-6)', '0.0', '1.0')} * 255.0 + 1e-9)::INTEGER AS {n}" for b, n in (("b2", "red"), ("b1", "green"), ("b0", "blue"))) + " FROM scene JOIN q USING (scene)")
def rgb_stretch(s, d):
    return adaptive.rgb_stretch(X.scene(s, d), ["scene"], ("b2", "b1", "b0")).select(*AT, "red", "green", "blue")


# composed scene layers up to the refined score

REFINE = f"""f AS (SELECT scene, r, c, mndwi, ndvi * {_conf('ndvi_den')} AS ndvi, ndbi * {_conf('ndbi_den')} AS ndbi, vv, vh, water_prob, water_prob >= 0.5 AS wet FROM water),
far AS (SELECT a.scene, a.r, a.c, min(CASE WHEN b.r IS NULL THEN 1e6 ELSE 0.955 * abs(abs(a.r - b.r) - abs(a.c - b.c)) + 1.3693 * least(abs(a.r - b.r), abs(a.c - b.c)) END) AS px
        FROM f AS a LEFT JOIN f AS b ON a.scene = b.scene AND b.wet GROUP BY ALL),
g AS (SELECT f.*, px * 10.0 AS dist, CASE WHEN wet OR px * 10.0 > 800.0 THEN 0.0 ELSE exp(-px * 10.0 / 120.0) END AS coast FROM f JOIN far USING (scene, r, c)),
h AS (SELECT *, {csql(_sg('-0.3 + 2.0 * coast + 1.0 * ((ndbi + 1) * 0.5 - 0.5) + 0.9 * ((1.0 - (ndvi + 1) * 0.5) - 0.5)'), '0.02', '0.98')} AS prior FROM g)"""


REFINED_SQL = f'CASE WHEN water_prob > 0.95 THEN 0.0 ELSE {_sg(_lg("vh") + " + 0.55 * " + _lg("prior"))} END'


def refined(s, d):
    raw = X.scene(s, d).withColumn("prob_raw", F.col("b7"))
    return clusters.refine(raw, ["scene"], 10.0)


@query(f"""WITH {X.INDEXED}, {WATER}, {REFINE} SELECT scene, r, c, {rsql('water_prob', 'water_prob')}, {rsql('dist', 'dist_to_water_m')}, {rsql('coast', 'coast')},
{rsql(REFINED_SQL, 'prob_refined')} FROM h""")
def refine_scene(s, d):
    return _pick(refined(s, d), AT, **{c: F.col(c) for c in ("water_prob", "dist_to_water_m", "coast", "prob_refined")})
