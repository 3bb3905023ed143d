"""Catalog, port map, published regional table, sinks and settings."""

import json

import pytest
from pyspark.sql import functions as F

from tidewright.operators.accounting import landward_share, regional_rollup
from tidewright.plans import clusters
from tidewright.sources import catalog, sinks

#: Fixed value: header of the published regional table.
REGIONAL = "region,ports,area_2017_km2,area_2025_km2,net_change_km2,seaward_net_km2,landward_net_km2,landward_share_pct\n"


def test_catalog_rules(spark):
    names = [
        "CLUSTER_1_cluster_7_2017_feat12_u16.tif",
        "cluster_1_CLUSTER_9_2017_FEAT12_U16.TIF",
        "CLUSTER_1_cluster_8_2018_feat12_u16.tif",
        "CLUSTER_2_cluster_3_2030_feat12_u16.tif",
        "CLUSTER_3_cluster_3_2020_feat12_u16.png",
        "CLUSTER_4_cluster_5_2020_feat12_u16.tif",
        "note.txt",
    ]
    files = spark.createDataFrame([("/d/" + n, n) for n in names], "path string, name string")
    found = {(r.cluster_id, r.cluster_uid, r.year, r.path) for r in catalog.scene_catalog(files).collect()}
    assert found == {(1, 7, 2017, "/d/" + names[1]), (1, 7, 2018, "/d/" + names[2]), (4, 5, 2020, "/d/" + names[5])}
    assert catalog.scene_catalog(files, exclude=[4]).count() == 2
    assert catalog.scene_catalog(files, clusters=[4]).count() == 1
    nested = {r.cluster_id: r.years for r in catalog.nested_catalog(catalog.scene_catalog(files)).collect()}
    assert sorted(nested[1]) == [2017, 2018]
    with pytest.raises(ValueError):
        catalog.require_years(catalog.scene_catalog(files), 2017, 2025)
    with pytest.raises(ValueError):
        catalog.require_rows(catalog.scene_catalog(files, clusters=[99]), "no files")


def test_port_map_last_row_wins(spark, tmp_path):
    path = tmp_path / "map.csv"
    path.write_text("cluster_id,resolved_portids\n1,A\nx,B\n2,\n1,C\n")
    rows = catalog.read_port_map(spark, str(path))
    found = {r.cluster_id: r.ports for r in catalog.port_map(rows).collect()}
    assert found == {1: "C", 2: ""}
    df = spark.createDataFrame([(1,), (3,)], "cluster_id int")
    assert {r.cluster_id: r.ports for r in catalog.with_ports(df, catalog.port_map(rows)).collect()} == {1: "C", 3: ""}


def test_port_map_without_columns_is_empty(spark, tmp_path):
    path = tmp_path / "map.csv"
    path.write_text("cluster_id,other\n1,A\n")
    assert catalog.port_map(catalog.read_port_map(spark, str(path))).count() == 0


def test_regional_csv_with_byte_order_mark(spark, tmp_path):
    path = tmp_path / "r.csv"
    text = REGIONAL + "A,2,10.0,12.5,2.5,0.5,2.0,80.0\nB,1,5.0,4.5,-0.5,0.1,-0.6,\n"
    path.write_bytes(b"\xef\xbb\xbf" + text.encode())
    df = catalog.read_regional(spark, str(path))
    rows = {r.region: r for r in df.collect()}
    assert rows["B"].landward_share_pct is None and rows["A"].ports == 2
    named = df.select(
        "region", F.col("ports").cast("long").alias("ports"), F.col("area_2017_km2").alias("area_2017"),
        F.col("area_2025_km2").alias("area_2025"), F.col("seaward_net_km2").alias("seaward"),
        F.col("landward_net_km2").alias("landward"),
    )
    rolled = {r.region: r for r in regional_rollup(named).collect()}
    assert rolled["Global"].ports == 3 and rolled["Global"].net_change == pytest.approx(2.0)
    assert rolled["A"].landward_share_pct == pytest.approx(80.0) and rolled["B"].landward_share_pct is None


def test_landward_share_of_published_totals(spark):
    # Published global net and landward change in square kilometres, and share.
    row = spark.range(1).select(landward_share(F.lit(250.909883), F.lit(192.281089)).alias("s")).first()
    assert row.s == pytest.approx(76.633525, abs=1e-4)


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([(1, 2017, 0, 0, 0.5), (1, 2018, 0, 0, 0.6)], "cluster_id int, year int, r int, c int, p double")
    path = str(tmp_path / "layers")
    sinks.write_layers(df, path)
    sinks.write_layers(df.where("year = 2018").withColumn("p", F.lit(0.9)), path)
    found = {r.year: r.p for r in spark.read.parquet(path).collect()}
    assert found == {2017: 0.5, 2018: 0.9}
    log = str(tmp_path / "log")
    for _ in range(2):
        sinks.append_records(df, log)
    assert spark.read.json(log).count() == 4
    sinks.write_summaries(df, str(tmp_path / "sum"))
    assert spark.read.json(str(tmp_path / "sum")).count() == 2
    sinks.write_changes(df, str(tmp_path / "csv"))
    sinks.write_changes(df, str(tmp_path / "csv"), resume=False)
    assert spark.read.csv(str(tmp_path / "csv"), header=True).count() == 2
    sinks.write_config(clusters.RunConfig(), str(tmp_path / "c.json"))
    assert json.loads((tmp_path / "c.json").read_text())["block"] == 256


def test_settings_are_checked():
    assert clusters.local_channels((6, 7, 10)) == {6: 0, 7: 1, 10: 2}
    assert clusters.slice_statistics(list(range(12)), (6, 10)) == [6, 10]
    assert clusters.slice_statistics([1.0, 2.0], (6, 10)) == [1.0, 2.0]
    assert len(clusters.presets()) == 7
    for bad in (
        lambda: clusters.TrainConfig(channels=(0, 0)),
        lambda: clusters.TrainConfig(channels=(0, 1)),
        lambda: clusters.TrainConfig(water_mode="x"),
        lambda: clusters.RunConfig(year_min=2020, year_max=2019),
        lambda: clusters.slice_statistics([1.0], (0, 1)),
    ):
        with pytest.raises(ValueError):
            bad()


def test_list_files(spark, tmp_path):
    (tmp_path / "CLUSTER_1_cluster_7_2017_feat12_u16.tif").write_bytes(b"x")
    found = catalog.scene_catalog(catalog.list_files(spark, str(tmp_path))).collect()
    assert [(r.cluster_id, r.year) for r in found] == [(1, 2017)]
