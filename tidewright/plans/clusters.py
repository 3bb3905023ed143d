"""The whole run over all clusters at once: refine, label, clean, account.

No loop over clusters: keys are (cluster_id, year), and finished clusters are
left out by an anti join on the summaries that exist.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewright.functions import constants as K
from tidewright.functions import pixel as P
from tidewright.operators import accounting, adaptive, region, spacetime, stencil
from tidewright.sources import sinks
from tidewright.tables import cut, drop


@dataclass(frozen=True)
class RunConfig:
    """Settings of a run; defaults are the published ones."""

    year_min: int = K.YEAR_MIN
    year_max: int = K.YEAR_MAX
    clusters: tuple[int, ...] = ()
    exclude: tuple[int, ...] = ()
    strict_years: bool = True
    block: int = K.BLOCK
    pad: int = K.PAD
    pixel_m: float = 10.0
    sea_water: float = K.SEA_WATER
    #: Tile side of the distance layer; None takes whole scenes, a task each. Tiles first see ``distance_reach``
    #: pixels beyond their side, then exchange their rings: the result is the same.
    distance_block: int | None = None
    distance_reach: int = 96

    def __post_init__(self) -> None:
        if self.year_min > self.year_max:
            raise ValueError("year_min is after year_max")
        if self.block <= 0 or self.pad < 0:
            raise ValueError("block must be positive and pad not negative")
        if self.distance_block is not None and (self.distance_block <= 0 or self.distance_reach < 0):
            raise ValueError("distance_block must be positive and distance_reach not negative")


@dataclass(frozen=True)
class TrainConfig:
    """Evaluation-side settings of a training run."""

    channels: tuple[int, ...] = tuple(range(12))
    index_water: bool = True
    coastal: bool = True
    aux: bool = True
    edge: bool = True
    lovasz: bool = True
    water_mode: str = "quantile"
    notes: dict = field(default_factory=dict)

    def __post_init__(self) -> None:
        if len(set(self.channels)) != len(self.channels) or not all(0 <= c < 12 for c in self.channels):
            raise ValueError("duplicate or unknown channel")
        if self.index_water and not {6, 7, 10} <= set(self.channels):
            raise ValueError("the water inducer needs bands 6, 7 and 10")
        if self.water_mode not in ("fixed", "quantile", "otsu"):
            raise ValueError(f"unsupported water mode {self.water_mode!r}")


def presets() -> dict[str, TrainConfig]:
    """Ablations: each leaves out or adds one part."""
    optical = tuple(range(6))
    return {
        "rgb": TrainConfig((0, 1, 2), False, False, False, False, False),
        "optical": TrainConfig(optical, False, False, False, False, False),
        "all_bands": TrainConfig(index_water=False, coastal=False, aux=False, edge=False, lovasz=False),
        "coastal": TrainConfig(index_water=False, aux=False, edge=False, lovasz=False),
        "multi_task": TrainConfig(index_water=False, lovasz=False),
        "physics": TrainConfig(lovasz=False),
        "full": TrainConfig(),
    }


def local_channels(channels: tuple[int, ...]) -> dict[int, int]:
    """Raw band number to place in a subset."""
    return {raw: k for k, raw in enumerate(channels)}


def slice_statistics(values: list[float], channels: tuple[int, ...]) -> list[float]:
    """Twelve statistics cut to a subset; a list that is cut already passes."""
    if len(values) == len(K.BANDS):
        return [values[c] for c in channels]
    if len(values) == len(channels):
        return list(values)
    raise ValueError("statistics don't fit the channels")


def indices(df: DataFrame) -> DataFrame:
    """Indices and their confidence from decoded bands b2, b3, b4, b8-like columns red, nir, green, swir."""
    ndvi_den, ndbi_den = F.col("nir") + F.col("red"), F.col("swir") + F.col("nir")
    named = df.withColumns({
        "conf_ndvi": P.denominator_confidence(ndvi_den),
        "conf_ndbi": P.denominator_confidence(ndbi_den),
        "mndwi": P.normalised_difference(F.col("green"), F.col("swir")),
    })
    return named.withColumns({
        "ndvi": P.normalised_difference(F.col("nir"), F.col("red")) * F.col("conf_ndvi"),
        "ndbi": P.normalised_difference(F.col("swir"), F.col("nir")) * F.col("conf_ndbi"),
    })


def refine(df: DataFrame, keys: list[str], pixel_m: float, block: int | None = None, reach: int = 96) -> DataFrame:
    """Scene layers from decoded bands b0..b11 and raw scores ``prob_raw``, up to prob_refined.

    Adds indices, water_prob, water, dist_to_water_m, coast, prior and
    prob_refined, in this order; indices are made anew from bands.
    """
    bands = {"green": "b1", "red": "b2", "nir": "b3", "swir": "b4", "vv": "b6", "vh": "b7"}
    named = indices(df.withColumns({n: P.clean(F.col(b)) for n, b in bands.items()}))
    wet = adaptive.water_probability(named, keys).withColumn("water", F.col("water_prob") >= 0.5)
    far = stencil.distance_to(wet, keys, "water", block, reach)
    at = [*keys, "r", "c"]
    joined = wet.join(far, at).withColumn("dist_to_water_m", F.col("dist_px") * pixel_m)
    coast = joined.withColumn("coast", P.coast_score(F.col("dist_to_water_m"), F.col("water")))
    prior = coast.withColumn("prior", P.geo_prior(F.col("ndvi"), F.col("ndbi"), F.col("coast")))
    return prior.withColumn("prob_refined", P.fuse_prior(F.col("prob_raw"), F.col("prior"), F.col("water_prob")))


def spatial_mask(df: DataFrame, keys: list[str], pixel_m: float, block: int = K.BLOCK) -> DataFrame:
    """(keys, r, c, mask): hysteresis on land, closing and opening, small parts dropped."""
    land = df.select(*keys, "r", "c", "prob_refined", (F.col("water_prob") < 0.5).alias("land"))
    seeded = region.hysteresis(cut(land, "land"), keys, "prob_refined", "land", block)
    smooth = cut(stencil.close_open(seeded, keys, "mask", block=block), "closed")
    sized = smooth.withColumn("_least", spacetime.least_pixels(pixel_m * pixel_m))
    return region.drop_small(sized, keys, "mask", "_least", block).drop("_least")


def diagnostics(df: DataFrame, keys: list[str], pixel_m: float) -> DataFrame:
    """One record a scene (columns mask, water_prob, conf_ndvi, conf_ndbi, area_m2 by row)."""
    rows = df.groupBy(*keys, "r").agg(
        F.count("*").alias("_n"), F.first("area_m2").alias("_a"), F.count_if("mask").alias("_m"),
        F.count_if(F.col("water_prob") >= 0.5).alias("_w"),
        F.count_if(F.col("conf_ndvi") < 0.1).alias("_v"), F.count_if(F.col("conf_ndbi") < 0.1).alias("_b"),
    )
    n = F.sum("_n")
    return rows.groupBy(*keys).agg(
        F.lit(pixel_m).alias("pixel_size_m"), F.lit(pixel_m * pixel_m).alias("projected_pixel_area_m2"),
        F.min("_a").alias("geodesic_pixel_area_m2_min"), F.max("_a").alias("geodesic_pixel_area_m2_max"),
        (F.sum("_w") / n).alias("water_frac"), F.sum("_m").alias("mask_px"),
        F.sum(F.col("_m") * F.col("_a")).alias("mask_area_m2"),
        (F.sum("_v") / n).alias("lowconf_ndvi_frac"), (F.sum("_b") / n).alias("lowconf_ndbi_frac"),
    )


#: Names and order of the columns of the published change table.
RESULT = (
    "cluster_id", "cluster_uid", "year", "base_year", "area_method", "area_m2_hstgo",
    "seaward_net_change_m2_from_base", "landward_net_change_m2_from_base", "total_net_change_m2_from_base",
    "annual_seaward_net_change_m2", "annual_landward_net_change_m2", "annual_total_net_change_m2", "resolved_portids",
)


def label_and_account(layers: DataFrame, config: RunConfig, flag: bool = False) -> DataFrame:
    """From stored layers (solve-only entry): label, clean up and account per cluster and year.

    With ``flag`` a column ``broken`` marks rows of broken identities and clusters whose labelling failed; else both raise.
    """
    at = ["cluster_id", "year", "r", "c"]
    labelled = cut(spacetime.label_ports(layers, ["cluster_id"], block=config.block, pad=config.pad, lenient=flag), "ports")
    sized = labelled.withColumn("port", F.coalesce("port", F.lit(False))).withColumn("_area", F.lit(config.pixel_m * config.pixel_m))
    tidy = spacetime.final_cleanup(sized, ["cluster_id", "year"], "port", "_area", config.block).drop("_area")
    table = cut(tidy.join(layers.select(*at, "water_prob", "area_m2"), at), "masks")
    found = accounting.account(table, ["cluster_id"], threshold=config.sea_water, block=config.block, flag=flag)
    if flag:
        lost = labelled.where("port is null").select("cluster_id").distinct().withColumn("_lost", F.lit(True))
        found = found.join(lost, "cluster_id", "left").withColumn("broken", F.col("broken") | F.col("_lost").isNotNull()).drop("_lost")
    return found


def selected(scenes: DataFrame, done: DataFrame, config: RunConfig) -> DataFrame:
    """Scenes of the years and clusters that are asked for and not done."""
    todo = scenes.where(F.col("year").between(config.year_min, config.year_max))
    if config.exclude:
        todo = todo.where(~F.col("cluster_id").isin(list(config.exclude)))
    if config.clusters:
        todo = todo.where(F.col("cluster_id").isin(list(config.clusters)))
    return todo.join(done.select("cluster_id").distinct(), "cluster_id", "left_anti")


def result_rows(changes: DataFrame, uids: DataFrame, ports: DataFrame) -> DataFrame:
    """The change table's columns from cluster-year changes, cluster_uid by cluster and ports by cluster (empty if none)."""
    named = changes.join(uids, "cluster_id").join(ports.select("cluster_id", F.col("ports").alias("resolved_portids")), "cluster_id", "left")
    full = named.withColumn("resolved_portids", F.coalesce("resolved_portids", F.lit("")))
    return full.withColumnRenamed("area_m2", "area_m2_hstgo").select(*RESULT)


def _uids(scenes: DataFrame) -> DataFrame:
    return scenes.groupBy("cluster_id").agg(F.min("cluster_uid").alias("cluster_uid"))


def run_clusters(scenes: DataFrame, ports: DataFrame, done: DataFrame, config: RunConfig) -> DataFrame:
    """Cluster-year change rows of all clusters that aren't done, from decoded and scored scenes.

    ``scenes``: cluster_id, cluster_uid, year, r, c, b0..b11, prob_raw, area_m2.
    """
    todo = selected(scenes, done, config)
    scene = ["cluster_id", "year"]
    layers = cut(refine(todo, scene, config.pixel_m, config.distance_block, config.distance_reach), "layers")
    changes = label_and_account(layers, config)
    named = changes.join(_uids(todo), "cluster_id").join(ports, "cluster_id", "left")
    return named.withColumn("ports", F.coalesce("ports", F.lit(""))).withColumn(
        "folder", F.format_string("cluster_%03d", "cluster_uid")
    )


def run_to_folder(scenes: DataFrame, ports: DataFrame, folder: str, config: RunConfig, resume: bool = True) -> DataFrame:
    """A whole run with all its outputs under ``folder``; (cluster_id, reason) of the clusters that failed.

    ``layers`` (with mask_spatial and water_mask), ``diagnostics`` (JSON
    lines), ``changes`` (CSV of ``RESULT``) and ``summaries`` (JSON by
    cluster, written last: its presence means done, and a run that resumes
    leaves that cluster out).  A cluster fails by itself: without all years
    (``strict_years``), by a labelling that fails or by a broken identity; the
    others go on, and it is tried again by the next run.
    """
    spark = scenes.sparkSession
    done = sinks.done_clusters(spark, f"{folder}/summaries") if resume else spark.createDataFrame([], "cluster_id int")
    todo = selected(scenes, done, config)
    failed = spark.createDataFrame([], "cluster_id int, reason string")
    if config.strict_years:
        have = todo.select("cluster_id", "year").distinct().groupBy("cluster_id").agg(F.count("*").alias("n"))
        short = cut(have.where(F.col("n") < config.year_max - config.year_min + 1).select(F.col("cluster_id").cast("int"), F.lit("missing years").alias("reason")), "short")
        todo, failed = todo.join(short, "cluster_id", "left_anti"), short
    scene, at = ["cluster_id", "year"], ["cluster_id", "year", "r", "c"]
    layers = cut(refine(todo, scene, config.pixel_m, config.distance_block, config.distance_reach), "layers")
    masked = layers.join(spatial_mask(layers, scene, config.pixel_m, config.block).withColumnRenamed("mask", "mask_spatial"), at)
    full = cut(masked.withColumn("water_mask", F.col("water")), "masked-layers")
    changes = cut(label_and_account(layers, config, flag=True), "changes")
    broken = changes.groupBy("cluster_id").agg(F.bool_or("broken").alias("broken")).where("broken")
    bad = cut(broken.select(F.col("cluster_id").cast("int"), F.lit("labelling or area identity failed").alias("reason")), "broken")
    good = changes.drop("broken").join(bad, "cluster_id", "left_anti")
    rows = result_rows(good, _uids(todo), ports)
    sinks.write_layers(full.select(*at, *sinks.LAYERS), f"{folder}/layers")
    sinks.append_records(diagnostics(full.withColumn("mask", F.col("mask_spatial")), scene, config.pixel_m), f"{folder}/diagnostics")
    sinks.write_changes(rows, f"{folder}/changes", resume)
    sinks.write_summaries(summaries(rows), f"{folder}/summaries")
    drop(layers, full, changes)
    return failed.union(bad)


def summaries(rows: DataFrame) -> DataFrame:
    """One row a cluster with its years' values as arrays, in order of years."""
    values = [c for c in RESULT if c not in ("cluster_id", "cluster_uid", "year", "base_year", "area_method", "resolved_portids")]
    fixed = ["cluster_id", "cluster_uid", "base_year", "area_method", "resolved_portids"]
    return accounting.arrays_of_rows(rows, fixed, "year", values).withColumnRenamed("year", "years")
