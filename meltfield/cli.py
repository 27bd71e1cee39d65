"""Command line: a run from a YAML file; the exit code says whether it went well."""

from __future__ import annotations

import argparse
import logging
import sys

from pyspark.sql import SparkSession

from meltfield.plans.pipeline import RunConfig, run


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    parser = argparse.ArgumentParser(prog="meltfield", description="Lack-of-fusion porosity of a laser powder-bed build")
    parser.add_argument("config_file", help="YAML file of the run")
    parser.add_argument("--seed", type=int, default=0, help="seed of random segment phases")
    args = parser.parse_args(argv)
    logging.basicConfig(level=logging.INFO, format="%(message)s")
    try:
        config = RunConfig.load(args.config_file)
    except KeyError as e:
        print(f"Error: missing key {e} in {args.config_file}", file=sys.stderr)
        return 1
    except Exception as e:  # a broken file of any kind ends the run with a message
        print(f"Error: cannot load {args.config_file}: {e}", file=sys.stderr)
        return 1
    print_summary(config)
    spark = spark or SparkSession.builder.appName("meltfield").getOrCreate()
    try:
        out = run(spark, config, args.seed)
    except (FileNotFoundError, ValueError) as e:
        print(f"Error: {e}", file=sys.stderr)
        return 1
    grid = out["grid"]
    print(f"Melted {grid.n_voxels - out['n_porous']} of {grid.n_voxels} voxels")
    print("Seconds:", ", ".join(f"{name} {s:.2f}" for name, s in out["seconds"].items()))
    if "n_pores" in out:
        print(f"Morphology of {out['n_pores']} pores written to {config.morphology_path}")
    return 0


def print_summary(config: RunConfig) -> None:
    print("Scan paths:", *(f"\n  {p}" for p in config.scan_paths))
    print(f"Random phases: {config.random_phases}\nVoxel resolution: {config.voxel_resolution:.2e} m")
    if config.layer_height is not None:
        print(f"Layer height: {config.layer_height:.2e} m")
    for dim, p in config.pool.items():
        print(f"{dim}: {p.kind} {p.path}, {p.n_modes} modes, scale {p.scale}, shape {p.shape}")
    print(f"Box: {config.bound_box}\nRaster: {config.vtk_path}\nMorphology: {config.morphology_path} {config.morphology_fields}")


def console() -> None:
    sys.exit(main())


if __name__ == "__main__":
    console()
