"""From inputs to porosity, raster and morphology."""

from __future__ import annotations

import logging
import os
import time
from dataclasses import dataclass, field

import yaml
from pyspark.sql import DataFrame, SparkSession

from meltfield.functions import geometry
from meltfield.operators import mask, morphology, spectral
from meltfield.schema import GridSpec, MeltPoolSpec
from meltfield.sinks.text import write_morphology
from meltfield.sinks.vti import write_vtk
from meltfield.sources.grid import create_grid
from meltfield.sources.scan import read_scan_path
from meltfield.sources.series import read_data

log = logging.getLogger("meltfield")


def compute_porosity(spark: SparkSession, grid: GridSpec, vectors: DataFrame, pool: MeltPoolSpec, strategy: str = "auto") -> DataFrame:
    """Porous voxels ``(voxel_id, ix, iy, iz, x, y, z)`` of a grid; without vectors, all of them."""
    return mask.porosity(spark, geometry.prepare(vectors, pool), grid, pool, strategy)


@dataclass(frozen=True)
class PoolInput:
    kind: str
    path: str
    n_modes: int
    scale: float
    shape: float


@dataclass(frozen=True)
class RunConfig:
    """A validated run: scan files, melt pool inputs, box and outputs."""

    scan_paths: list[str]
    layer_height: float | None
    voxel_resolution: float
    random_phases: bool
    pool: dict[str, PoolInput]
    bound_box: tuple | None = None
    vtk_path: str | None = None
    morphology_path: str | None = None
    morphology_fields: list[str] = field(default_factory=list)

    @classmethod
    def load(cls, path: str) -> RunConfig:
        """A YAML file; relative paths count from its folder (melt pool files also from the working folder)."""
        if not os.path.exists(path):
            raise FileNotFoundError(path)
        with open(path) as f:
            raw = yaml.safe_load(f) or {}
        folder = os.path.dirname(os.path.abspath(path))

        def place(name):
            return name if name is None or os.path.isabs(name) or "://" in name else os.path.join(folder, name)

        def data_place(name):
            here = place(name)
            return here if os.path.exists(here) or not os.path.exists(name) else name

        parameters = raw.get("parameters") or {}
        if "voxel_resolution" not in parameters:
            raise KeyError("parameters.voxel_resolution")
        pool = {}
        for dim, entry in (raw.get("melt_pool_data") or {}).items():
            kind = entry["type"]
            if kind not in ("time_series", "spectral_components"):
                raise ValueError(f"melt_pool_data.{dim}.type is time_series or spectral_components, not {kind}")
            shape = 2.0 if dim == "width" else float(entry["shape"])
            pool[dim] = PoolInput(kind, data_place(entry["file_name"]), int(float(entry.get("nmodes", 0))), float(entry.get("scale", 1.0)), shape)
        rve, output = raw.get("rve") or {}, raw.get("output") or {}
        box = (tuple(map(float, rve["min_point"])), tuple(map(float, rve["max_point"]))) if "min_point" in rve and "max_point" in rve else None
        vtk, table = output.get("vtk") or {}, output.get("morphology") or {}
        return cls(
            [place(p) for p in raw.get("scan_paths") or []], parameters.get("layer_height"), float(parameters["voxel_resolution"]), bool(parameters.get("enable_random_segment_phase", True)),
            pool, box, place(vtk.get("file_name")), place(table.get("file_name")), list(table.get("fields") or []),
        )


def run(spark: SparkSession, config: RunConfig, seed: int = 0) -> dict:
    """Executes a configuration; returns the grid, the counts, the tables, and the seconds of each phase."""
    seconds: dict[str, float] = {}

    def phase(name: str, since: float) -> float:
        now = time.perf_counter()
        seconds[name] = now - since
        log.info("%s: %.2f s", name, seconds[name])
        return now

    at = time.perf_counter()
    vectors = read_scan_path(spark, config.scan_paths)
    inputs = {d: (read_data(spark, p.path), p.n_modes, p.scale, p.shape) for d, p in config.pool.items()}
    pool = spectral.create_melt_pool(inputs, config.random_phases, seed)
    grid = create_grid(config.voxel_resolution, path_vectors=vectors, bound_box=config.bound_box)
    log.info("grid %s, %d voxels, %d modes", grid.shape, grid.n_voxels, pool.n_modes)
    at = phase("inputs", at)
    porous = compute_porosity(spark, grid, vectors, pool).cache()
    out = {"grid": grid, "pool": pool, "porous": porous, "n_porous": porous.count(), "seconds": seconds}
    at = phase("melt mask", at)
    log.info("melted %d of %d voxels", grid.n_voxels - out["n_porous"], grid.n_voxels)
    if config.vtk_path:
        write_vtk(porous, grid, config.vtk_path)
        at = phase("raster", at)
    if config.morphology_fields:
        out["morphology"] = morphology.compute_morphology(porous, config.voxel_resolution, config.morphology_fields)
        if config.morphology_path:
            out["n_pores"] = write_morphology(out["morphology"], config.morphology_path)
            phase("morphology", at)
    return out
