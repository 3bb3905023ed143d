"""Operators on small tables: missing values, tiling, whole runs, streaming, entry."""

import hashlib
import importlib
import sys

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidewright.functions import kernels as N
from tidewright.functions import pixel as P
from tidewright.operators import accounting, adaptive, augment, metrics, ranks, region, spacetime, stencil, temporal
from tidewright import __main__ as command
from tidewright.operators import scoring
from tidewright.plans import clusters
from tidewright.streaming.ingest import ingest, yearly_counts


def grid(spark, arrays, keys=("k",)):
    """A pixel table from {name: (T, H, W) array}; the first axis is the key."""
    names = list(arrays)
    shape = arrays[names[0]].shape
    rows = [(t, r, c, *[arrays[n][t, r, c].item() for n in names]) for t, r, c in np.ndindex(shape)]
    kinds = ["boolean" if arrays[n].dtype == bool else "double" for n in names]
    schema = f"{keys[0]} int, r int, c int, " + ", ".join(f"{n} {k}" for n, k in zip(names, kinds, strict=True))
    return spark.createDataFrame(rows, schema)


def back(df, value, shape, key="k"):
    out = np.zeros(shape, object)
    for r in df.collect():
        out[r[key], r.r, r.c] = r[value]
    return out


@pytest.fixture(scope="module")
def noise():
    return np.random.default_rng(3).random((2, 13, 17))


def test_missing_values_in_quantiles(spark):
    rows = [(1, float("nan")), (1, 1.0), (1, 3.0), (2, float("nan")), (2, None), (3, 2.0)]
    df = spark.createDataFrame(rows, "k int, mndwi double").withColumns({"vv": F.lit(0.1), "vh": F.lit(0.1)})
    thr = {r.k: r.thr_m for r in adaptive.water_probability(df, ["k"]).select("k", "thr_m").distinct().collect()}
    assert thr == {1: pytest.approx(2.7), 2: 0.0, 3: 2.0}
    assert adaptive.water_probability(df, ["k"]).where("isnan(water_prob) or water_prob is null").count() == 0
    stats = {r.k: r for r in adaptive.summarize(df, ["k"], "mndwi").collect()}
    assert stats[2].n == 0 and stats[2].mean is None and stats[3].std == 0.0
    empty = df.where("false")
    assert adaptive.water_probability(empty, ["k"]).count() == 0
    flat = adaptive.otsu_thresholds(df.where("k = 3"), ["k"]).first()
    assert flat.flat and flat.thr == -0.05


def test_tiles_give_the_whole_scene_result(spark, noise):
    m = noise > 0.6
    df = grid(spark, {"m": m})
    for k in range(2):
        want = N.close_open(m[k], np.ones_like(m[k]), 3, 2)
        assert (back(stencil.close_open(df, ["k"], "m", block=5), "m", m.shape)[k].astype(bool) == want).all()
    whole, tiled = (region.components(df, ["k"], "m", block=b) for b in (100, 4))
    assert whole.exceptAll(tiled).count() == 0 and whole.count() == m.sum()


def test_distance_within_reach_is_exact_in_tiles(spark, noise):
    m = noise > 0.97
    df = grid(spark, {"m": m})
    whole = back(stencil.distance_to(df, ["k"], "m"), "dist_px", m.shape)
    tiled = back(stencil.distance_to(df, ["k"], "m", block=4, reach=4), "dist_px", m.shape)
    near = whole <= 0.955 * 4 + 1e-9
    assert (np.abs((whole - tiled)[near].astype(float)) < 1e-9).all() and (tiled[~near] > 0.955 * 4 - 1e-9).all()


def test_hysteresis_without_seeds_is_empty(spark):
    p = np.full((1, 6, 6), 0.5)
    df = grid(spark, {"p": p}).withColumn("land", F.lit(True))
    assert region.hysteresis(df, ["k"], "p", "land").where("mask").count() == 0


def test_hysteresis_falls_back_to_a_quantile(spark):
    p = np.linspace(0.3, 0.6, 1600).reshape(1, 40, 40)
    df = grid(spark, {"p": p}).withColumn("land", F.lit(True))
    assert region.hysteresis(df, ["k"], "p", "land").where("mask").count() == int((p >= 0.4).sum())


def test_drop_small_keeps_all_at_zero(spark, noise):
    df = grid(spark, {"m": noise > 0.7})
    assert region.drop_small(df, ["k"], "m", 0, block=5).where("m").count() == int((noise > 0.7).sum())


def test_temporal_columns_equal_kernels(spark, noise):
    df = grid(spark, {"p": noise}, ("year",))
    cols = df.withColumn("s", temporal.temporal_smooth(F.col("p"), ["r", "c"]))
    assert back(cols, "s", noise.shape, "year").astype(float) == pytest.approx(N.temporal_smooth(noise))
    one = df.where("year = 0").withColumn("s", temporal.temporal_smooth(F.col("p") + 1.0, ["r", "c"]))
    assert one.where("s <= 1").count() == 0  # a single year passes unclipped


def test_account_of_one_pixel(spark):
    rows = [(1, y, 0, 0, y == 2, 0.0, 4.0) for y in (1, 2)]
    df = spark.createDataFrame(rows, "s int, year int, r int, c int, port boolean, water_prob double, area_m2 double")
    out = accounting.account(df, ["s"]).orderBy("year").collect()
    assert [r.area_m2 for r in out] == [0.0, 4.0] and out[1].annual_landward_net_change_m2 == 4.0


def test_broken_identity_raises(spark):
    # an area that is no number breaks every identity
    rows = [(1, y, 0, 0, y == 2, 0.0, float("inf")) for y in (1, 2)]
    df = spark.createDataFrame(rows, "s int, year int, r int, c int, port boolean, water_prob double, area_m2 double")
    with pytest.raises(Exception, match="identity"):
        accounting.account(df, ["s"]).collect()


def test_losses_against_numpy(spark):
    rng = np.random.default_rng(5)
    z = rng.normal(size=(40, 2))
    gt = rng.integers(0, 2, 40)
    rows = [(int(i), float(a), float(b), int(g) if i % 7 else None) for i, ((a, b), g) in enumerate(zip(z, gt, strict=True))]
    df = spark.createDataFrame(rows, "i int, bg double, fg double, gt int").withColumn("p", P.softmax_fg(F.col("bg"), F.col("fg")))
    ok = np.array([i % 7 != 0 for i in range(40)])
    p = 1 / (1 + np.exp(z[:, 0] - z[:, 1]))
    own = np.where(gt == 1, p, 1 - p)
    w = np.where(gt == 1, 1.0, 0.25)
    assert metrics.weighted_ce(df, [], "bg", "fg", "gt").first().ce == pytest.approx((w * -np.log(own))[ok].sum() / ok.sum())
    losses = []
    for k in (0, 1):
        y = (gt[ok] == k).astype(float)
        e = np.abs(y - (p if k else 1 - p)[ok])
        order = np.argsort(-e)
        ys = y[order]
        jac = 1 - (ys.sum() - ys.cumsum()) / (ys.sum() + (1 - ys).cumsum())
        losses.append((e[order] * np.diff(jac, prepend=0)).sum())
    assert metrics.lovasz(df, [], "p", "gt", ["i"]).first().lovasz == pytest.approx(np.mean(losses))
    wild = spark.createDataFrame([(800.0, -800.0, 1), (-800.0, 800.0, 1)], "bg double, fg double, gt int")
    assert metrics.weighted_ce(wild, [], "bg", "fg", "gt").first().ce == pytest.approx(800.0)


@pytest.mark.parametrize("bins", [1, 4, 1024])
def test_quantiles_by_bins_are_exact(spark, bins):
    rng = np.random.default_rng(2)
    groups = [rng.normal(size=500), np.full(7, 2.0), np.array([1.0]), np.array([]), np.round(rng.normal(size=300), 1), np.array([-1e30, 0.0, 1e30, 5.0])]
    lone = np.append(groups[5], np.inf)
    rows = [(k, float(x), float(-x)) for k, g in enumerate(groups) for x in g] + [(0, float("nan"), None), (3, None, None), (5, float("inf"), None)]
    df = spark.createDataFrame(rows, "k int, x double, z double")
    wanted = {"a": (F.col("x"), 0.25), "b": (F.col("x"), 0.0), "c": (F.col("z"), 0.995), "d": (F.col("x"), 0.5)}
    found = {r.k: r for r in ranks.quantiles(df, ["k"], wanted, bins).collect()}
    assert sorted(found) == list(range(6))
    for k, g in enumerate(groups):
        for name, (sign, q) in {"a": (1, 0.25), "b": (1, 0.0), "c": (-1, 0.995), "d": (1, 0.5)}.items():
            g = lone if k == 5 and name != "c" else groups[k]
            with np.errstate(invalid="ignore"):
                assert found[k][name] == (pytest.approx(np.quantile(sign * g, q)) if len(g) else None)


def test_running_sums_across_bins(spark):
    rng = np.random.default_rng(5)
    rows = [(int(rng.integers(2)), round(float(rng.random()), 1), i, float(rng.integers(5))) for i in range(200)] + [(0, 0.0, 900, 1.0), (0, 1.0, 901, 1.0)]
    df = spark.createDataFrame(rows, "k int, e double, i int, v double")
    found = {r.i: r.s for r in ranks.running_sums(df, ["k"], "e", ["i"], {"s": F.col("v")}, 7).collect()}
    for k in (0, 1):
        total = 0.0
        for _, e, i, v in sorted((r for r in rows if r[0] == k), key=lambda r: (-r[1], r[2])):
            total += v
            assert found[i] == pytest.approx(total)


def test_empty_validation_is_all_zero(spark):
    empty = spark.createDataFrame([], "pred int, gt int")
    row = metrics.confusion(empty, [], "pred", "gt").first()
    assert (row.tp, row.f1, row.fpr) == (0, 0.0, 0.0)


def scenes(spark, clusters_=2, years=3, side=10):
    rng = np.random.default_rng(1)
    rows = [
        (k, k + 10, 2017 + y, r, c, *rng.random(12).tolist(), float(rng.random()), 100.0 + r)
        for k in range(clusters_) for y in range(years) for r in range(side) for c in range(side)
    ]
    bands = ", ".join(f"b{i} double" for i in range(12))
    return spark.createDataFrame(rows, f"cluster_id int, cluster_uid int, year int, r int, c int, {bands}, prob_raw double, area_m2 double")


def test_whole_run_and_resume(spark):
    df = scenes(spark)
    ports = spark.createDataFrame([(0, "P1")], "cluster_id int, ports string")
    none = spark.createDataFrame([], "cluster_id int")
    config = clusters.RunConfig(block=6, pad=3, pixel_m=60.0)
    out = clusters.run_clusters(df, ports, none, config).collect()
    assert len(out) == 6 and {r.ports for r in out} == {"P1", ""} and {r.folder for r in out} == {"cluster_010", "cluster_011"}
    tiled = clusters.RunConfig(block=6, pad=3, pixel_m=60.0, distance_block=6, distance_reach=20)
    assert sorted(clusters.run_clusters(df, ports, none, tiled).collect()) == sorted(out)
    done = spark.createDataFrame([(0,)], "cluster_id int")
    again = clusters.run_clusters(df, ports, done, config).collect()
    assert {r.cluster_id for r in again} == {1} and len(again) == 3


@pytest.mark.parametrize("reach", [0, 3])
def test_distances_far_beyond_the_reach(spark, reach):
    """Tiles of 4 by 4 pixels, sources up to ten tiles away: the distances of whole scenes."""
    m = np.zeros((3, 37, 30), bool)
    m[0, 1, 2] = m[0, 36, 0] = m[1, 18, 29] = True  # the last scene has none
    df = grid(spark, {"m": m})
    found = back(stencil.distance_to(df, ["k"], "m", block=4, reach=reach), "dist_px", m.shape).astype(float)
    for k in range(3):
        assert found[k] == pytest.approx(N.chamfer(m[k]))
    assert (found[2] == 1e6).all()
    holes = df.where("not (r between 10 and 20 and c between 5 and 25)")
    some = {(r.k, r.r, r.c): r.dist_px for r in stencil.distance_to(holes, ["k"], "m", block=4, reach=reach).collect()}
    assert len(some) == holes.count() and all(v >= 0 for v in some.values())


def test_seams_are_united_level_by_level(spark, monkeypatch):
    monkeypatch.setattr(region, "FAN", 2)
    rng = np.random.default_rng(8)
    m = rng.random((3, 40, 33)) < 0.45
    m[2] = False
    m[2, :, 7] = m[2, 3, :] = m[2, 39, :] = True
    found = back(region.components(grid(spark, {"m": m}), ["k"], "m", block=3), "label", m.shape)
    for k in range(3):
        want = N.components(m[k])
        codes = np.where(m[k], (want // 33) * (1 << 31) + want % 33, 0)
        assert (np.where(m[k], found[k], 0).astype(int) == codes).all()


def test_a_run_with_all_outputs(spark, tmp_path):
    """One cluster without a year and one with broken areas fail by themselves; the others are written and marked done."""
    df = scenes(spark, clusters_=4)
    df = df.where("not (cluster_id = 1 and year = 2018)").withColumn("area_m2", F.when(F.col("cluster_id") == 2, float("nan")).otherwise(F.col("area_m2")))
    ports = spark.createDataFrame([(0, "P1")], "cluster_id int, ports string")
    config = clusters.RunConfig(year_max=2019, block=6, pad=3, pixel_m=60.0)
    out = str(tmp_path / "run")
    failed = clusters.run_to_folder(df, ports, out, config).collect()
    assert sorted((r.cluster_id, r.reason) for r in failed) == [(1, "missing years"), (2, "labelling or area identity failed")]
    written = spark.read.csv(f"{out}/changes", header=True)
    assert tuple(written.columns) == clusters.RESULT and len(clusters.RESULT) == 13
    assert {(r.cluster_id, r.cluster_uid, r.resolved_portids) for r in written.collect()} == {("0", "10", "P1"), ("3", "13", None)}
    want = clusters.run_clusters(df.where("cluster_id in (0, 3)"), ports, spark.createDataFrame([], "cluster_id int"), config)
    near = lambda rows, c: sorted((int(r.cluster_id), int(r.year), round(float(r[c]), 3)) for r in rows)
    assert near(written.collect(), "area_m2_hstgo") == near(want.collect(), "area_m2")
    layers = spark.read.parquet(f"{out}/layers")
    assert layers.select("cluster_id", "year").distinct().count() == 9 and {"mask_spatial", "water_mask"} <= set(layers.columns)
    assert spark.read.json(f"{out}/diagnostics").count() == 9
    marks = spark.read.json(f"{out}/summaries")
    assert {(r.cluster_id, len(r.years)) for r in marks.collect()} == {(0, 3), (3, 3)}
    again = clusters.run_to_folder(scenes(spark, clusters_=4), ports, out, config)
    assert again.count() == 0 and spark.read.csv(f"{out}/changes", header=True).count() == 12
    assert spark.read.json(f"{out}/summaries").select("cluster_id").distinct().count() == 4


def test_command_line_runs(spark, tmp_path, capsys):
    scenes(spark).where("not (cluster_id = 1 and year = 2018)").write.parquet(f"{tmp_path}/scenes")
    (tmp_path / "ports.csv").write_text("cluster_id,resolved_portids\n0,P7\n")
    args = [f"{tmp_path}/scenes", f"{tmp_path}/ports.csv", f"{tmp_path}/out", "--year-max", "2019", "--block", "6", "--pad", "3", "--pixel-m", "60"]
    assert command.main(args) == 1 and "cluster 1 failed: missing years" in capsys.readouterr().out
    assert command.main([*args, "--no-strict-years", "--exclude", "5"]) == 0
    (part,) = (tmp_path / "out" / "global").glob("part-*.csv")
    text = part.read_bytes()
    assert text.startswith(b"\xef\xbb\xbfcluster_id,cluster_uid,year") and text.count(b"\n") == 6
    assert command.config(command.parser().parse_args(["s", "p", "f", "--clusters", "3", "4"])).clusters == (3, 4)


def test_scorer_sees_batches(spark):
    seen = []

    def scorer(x):
        assert x.shape[1:] == (12, 6, 6) and 1 <= len(x) <= 2
        return np.stack([x[:, 0] * 0, x[:, 0] + x[:, 1] * 2], axis=1)

    rng = np.random.default_rng(3)
    df = grid(spark, {f"b{i}": rng.random((2, 11, 14)) for i in range(12)})
    one, two = (scoring.score_scenes(df, ["k"], [0.0] * 12, [1.0] * 12, scorer, 6, 3, batch=n).collect() for n in (1, 2))
    near = lambda rows: [(r.k, r.r, r.c, round(r.p, 9)) for r in sorted(rows)]
    assert near(one) == near(two) and len(one) == 2 * 11 * 14 and not seen


def test_sweep_leaves_nothing(spark):
    from tidewright import tables

    folder = tables.new_folder(spark, "x").rsplit("/", 1)[0]
    df = tables.cut(spark.range(5).toDF("x"), "x")
    assert df.count() == 5
    tables.sweep(spark)
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    assert not path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path)


def test_augmentation_equals_arrays(spark):
    rng = np.random.default_rng(4)
    shape = (40, 6, 6)
    arrays = {"b0": rng.random(shape), "b6": rng.random(shape), "b9": rng.random(shape) - 0.5, "y": np.floor(rng.random(shape) * 3)}
    df = grid(spark, arrays).withColumn("y", F.col("y").cast("int"))
    found = augment.augment(df, ["k"], ["b0"], ["b6"], ["b9"], ["y"], seed=20)
    rows = found.collect()
    draw = [{s: int(hashlib.md5(f"{20 + s}:{k}".encode()).hexdigest()[:12], 16) / 2**48 for s in range(1, 14)} for k in range(40)]
    turned = warped = 0
    for k in range(40):
        u = draw[k]
        got = {n: np.full((6, 6), np.nan) for n in arrays}
        for r in rows:
            if r.k == k:
                for n in arrays:
                    got[n][r.r, r.c] = r[n]
        for n in ("b9", "y"):  # only moved
            x = arrays[n][k]
            x = x[:, ::-1] if u[1] < 0.5 else x
            x = x[::-1] if u[2] < 0.5 else x
            x = np.rot90(x, int(4 * u[4])) if u[3] < 0.5 else x
            turned += u[3] < 0.5
            if u[5] < 0.35:
                warped += 1
                x = N.affine_warp(x, -8 + 16 * u[6], 0.95 + 0.1 * u[7], (-0.03 + 0.06 * u[9]) * 6, (-0.03 + 0.06 * u[8]) * 6, n == "y")
            assert got[n] == pytest.approx(x)
        assert u[10] >= 0.3 or (got["b0"].min() >= 0 and got["b0"].max() <= 1)
    assert turned > 10 and warped > 10
    noisy = [r.b6 for r in rows if draw[r.k][13] < 0.25]
    assert min(noisy) < 0 or max(noisy) > 1  # not clipped


def test_block_labels_beat_thresholding(spark, noise):
    water, dist = np.zeros_like(noise), np.full_like(noise, 100.0)
    df = grid(spark, {"water_prob": water, "prob_refined": noise, "dist_to_water_m": dist}, ("year",)).withColumn("k", F.lit(0))
    found = back(spacetime.label_ports(df, ["k"], block=100, pad=0), "port", noise.shape, "year").astype(bool)
    assert (found == N.label_block(water, noise, dist)).all()


def test_stream_ingests_each_file_once(spark, tmp_path):
    schema = "cluster_id int, year int, r int, c int, p double"
    source, sink, mark = (str(tmp_path / n) for n in ("in", "out", "mark"))
    df = spark.createDataFrame([(1, 2017, 0, 0, 0.5)], schema)
    df.write.mode("append").parquet(source)
    ingest(spark, source, schema, sink, mark).awaitTermination()
    df.withColumn("year", F.lit(2018)).write.mode("append").parquet(source)
    ingest(spark, source, schema, sink, mark).awaitTermination()
    assert {(r.year, r.p) for r in spark.read.parquet(sink).collect()} == {(2017, 0.5), (2018, 0.5)}


def test_windowed_stream_counts(spark, tmp_path):
    df = spark.createDataFrame([(1, 2.0)], "k int, value double").withColumn("ts", F.lit("2024-01-01 10:00:00").cast("timestamp"))
    df.write.parquet(str(tmp_path / "ev"))
    stream = spark.readStream.schema("k int, value double, ts timestamp").parquet(str(tmp_path / "ev"))
    q = yearly_counts(stream, "ts", ["k"]).writeStream.outputMode("complete").format("memory").queryName("yc").start()
    q.processAllAvailable()
    q.stop()
    assert [(r.k, r.n) for r in spark.table("yc").collect()] == [(1, 1)]


def test_entry_works_without_corpus_part(spark, monkeypatch):
    for name in [m for m in sys.modules if m.startswith(("tidewright.llm", "corpus_pipeline", "__spark_entry__"))]:
        monkeypatch.delitem(sys.modules, name)
    monkeypatch.setitem(sys.modules, "corpus_pipeline", None)
    entry = importlib.import_module("__spark_entry__")
    assert "area_accounting" in entry.queries() and not any(k.startswith("op1_") for k in entry.queries())
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert entry.entry(spark).count() > 0
    monkeypatch.delitem(sys.modules, "__spark_entry__")


def test_overlay_blends_where_the_mask_holds(spark):
    df = spark.createDataFrame([(100, 0, 255, True), (100, 0, 255, False)], "red int, green int, blue int, m boolean")
    found = {r.m: (r.red, r.green, r.blue) for r in adaptive.overlay(df, "m", (0, 0, 255)).collect()}
    assert found == {True: (55, 0, 255), False: (100, 0, 255)}  # the published share, 0.45
