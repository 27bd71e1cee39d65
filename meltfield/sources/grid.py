"""Voxel grids."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from meltfield.schema import GridSpec


def extent(vectors: DataFrame) -> tuple[tuple[float, float, float], tuple[float, float, float]]:
    """Least and greatest coordinates of all end points: one partial aggregate."""
    row = vectors.agg(*[F.min(F.least(f"s{a}", f"e{a}")).alias(f"l{a}") for a in "xyz"], *[F.max(F.greatest(f"s{a}", f"e{a}")).alias(f"h{a}") for a in "xyz"]).first()
    if row["lx"] is None:
        raise ValueError("a grid over scan vectors needs at least one vector")
    return tuple(row[f"l{a}"] for a in "xyz"), tuple(row[f"h{a}"] for a in "xyz")


def create_grid(voxel_resolution: float, *, path_vectors: DataFrame | None = None, bound_box=None) -> GridSpec:
    """A grid over a box, or over the unpadded extent of scan vectors; the box wins if both are given."""
    if voxel_resolution <= 0:
        raise ValueError("voxel_resolution must be positive")
    if bound_box is not None:
        return GridSpec.from_box(voxel_resolution, bound_box)
    if path_vectors is None:
        raise ValueError("give bound_box or path_vectors")
    if not isinstance(path_vectors, DataFrame):
        raise ValueError("path_vectors must be a DataFrame of scan vectors")
    return GridSpec.from_extent(voxel_resolution, *extent(path_vectors))


def coordinate(grid: GridSpec, axis: int, index: Column) -> Column:
    return F.lit(grid.origin[axis]) + index * F.lit(grid.step(axis))


def with_coordinates(ids: DataFrame, grid: GridSpec) -> DataFrame:
    """Adds ix, iy, iz, x, y, z to a table with ``voxel_id``."""
    _, ny, nz = grid.shape
    indexed = ids.withColumns({"ix": F.expr(f"cast(voxel_id div {ny * nz} as int)"), "iy": F.expr(f"cast((voxel_id div {nz}) % {ny} as int)"), "iz": F.expr(f"cast(voxel_id % {nz} as int)")})
    return indexed.withColumns({c: coordinate(grid, a, F.col(f"i{c}")) for a, c in enumerate("xyz")})


def voxels(spark: SparkSession, grid: GridSpec, partitions: int | None = None) -> DataFrame:
    """Every voxel: a range with index arithmetic, no join and no shuffle."""
    ids = spark.range(0, grid.n_voxels, 1, partitions) if partitions else spark.range(grid.n_voxels)
    return with_coordinates(ids.withColumnRenamed("id", "voxel_id"), grid)
