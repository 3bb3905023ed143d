"""Command line of a whole run: ``python -m tidewright SCENES PORTS FOLDER [settings]``."""

from __future__ import annotations

import argparse
from dataclasses import asdict, fields

from tidewright.plans.clusters import RunConfig, run_to_folder
from tidewright.sources import catalog, sinks


def parser() -> argparse.ArgumentParser:
    """Arguments: the inputs, and every setting of ``RunConfig`` under its own name."""
    out = argparse.ArgumentParser(prog="tidewright", description="Refine, label and account scored scenes cluster by cluster.")
    out.add_argument("scenes", help="Parquet table: cluster_id, cluster_uid, year, r, c, b0..b11, prob_raw, area_m2")
    out.add_argument("ports", help="CSV of clusters and their ports")
    out.add_argument("folder", help="where layers, diagnostics, changes and summaries go")
    out.add_argument("--no-resume", action="store_true", help="do finished clusters again")
    for f in fields(RunConfig):
        name, default = "--" + f.name.replace("_", "-"), f.default
        if isinstance(default, bool):
            out.add_argument(name, action=argparse.BooleanOptionalAction, default=default)
        elif isinstance(default, tuple):
            out.add_argument(name, type=int, nargs="*", default=default)
        else:
            out.add_argument(name, type=type(default) if default is not None else int, default=default)
    return out


def config(args: argparse.Namespace) -> RunConfig:
    given = {f.name: getattr(args, f.name) for f in fields(RunConfig)}
    return RunConfig(**{k: tuple(v) if isinstance(v, list) else v for k, v in given.items()})


def check_runtime() -> None:
    """Say at once what is missing, not in the middle of a run."""
    import importlib.util

    gone = [m for m in ("pyspark", "numpy", "pandas", "pyarrow") if importlib.util.find_spec(m) is None]
    if gone:
        raise RuntimeError(f"missing packages: {', '.join(gone)}")


def main(argv: list[str] | None = None) -> int:
    """Exit code 0, or 1 if a cluster failed."""
    args = parser().parse_args(argv)
    settings = config(args)
    check_runtime()
    from pyspark.sql import SparkSession

    spark = SparkSession.builder.appName("tidewright").getOrCreate()
    ports = catalog.port_map(catalog.read_port_map(spark, args.ports))
    failed = run_to_folder(spark.read.parquet(args.scenes), ports, args.folder, settings, not args.no_resume).collect()
    sinks.write_global(spark.read.csv(f"{args.folder}/changes", header=True), f"{args.folder}/global")
    spark.createDataFrame([(k, str(v)) for k, v in asdict(settings).items()], "name string, value string").coalesce(1).write.mode("overwrite").json(f"{args.folder}/settings")
    for row in failed:
        print(f"cluster {row.cluster_id} failed: {row.reason}")
    return 1 if failed else 0


if __name__ == "__main__":
    raise SystemExit(main())
