"""Scan-vector geometry and the melt predicate as column expressions."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from meltfield.schema import DIMS, MeltPoolSpec

#: A vector shorter than this in the plane keeps the default axes; a squared length up to the second has no time fraction.
FLAT, POINT = 1e-12, 1e-24


def with_frame(vectors: DataFrame) -> DataFrame:
    """Displacement, centre, duration and the horizontal axes across (e0) and along (e1) each vector."""
    c = F.col
    out = vectors.withColumns({f"d{a}": c(f"e{a}") - c(f"s{a}") for a in "xyz"} | {f"c{a}": (c(f"s{a}") + c(f"e{a}")) / 2.0 for a in "xyz"} | {"duration": c("t1") - c("t0")})
    out = out.withColumns({"lxy": F.hypot("dx", "dy"), "len2": c("dx") * c("dx") + c("dy") * c("dy") + c("dz") * c("dz")})
    flat = c("lxy") < FLAT
    safe = F.when(flat, 1.0).otherwise(c("lxy"))
    return out.withColumns(
        {
            "e0x": F.when(flat, 1.0).otherwise(-c("dy") / safe), "e0y": F.when(flat, 0.0).otherwise(c("dx") / safe),
            "e1x": F.when(flat, 0.0).otherwise(c("dx") / safe), "e1y": F.when(flat, 1.0).otherwise(c("dy") / safe),
        }
    )


def with_bounds(vectors: DataFrame, pool: MeltPoolSpec) -> DataFrame:
    """Axis-aligned box and half-lengths of the oriented box of each framed vector."""
    half, depth, height = pool.maximum("width") / 2, pool.maximum("depth"), pool.maximum("height")
    c = F.col
    return vectors.withColumns(
        {
            "xmin": F.least("sx", "ex") - half, "xmax": F.greatest("sx", "ex") + half, "ymin": F.least("sy", "ey") - half, "ymax": F.greatest("sy", "ey") + half,
            "zmin": F.least("sz", "ez") - depth, "zmax": F.greatest("sz", "ez") + height,
            "l0": F.lit(half), "l1": c("lxy") / 2.0, "l2": F.lit(float(max(height, depth))),
        }
    )


def with_phases(vectors: DataFrame, pool: MeltPoolSpec) -> DataFrame:
    """Phases of each vector: those of the width, or uniform ones from a hash of (seed, vector, mode), 0 for the mean.

    A hash gives the same phases whenever a task is run again.
    """
    if not pool.random_phases:
        return vectors.withColumn("phases", F.array(*[F.lit(p) for p in pool.phases]))
    def uniform(k):
        return F.pmod(F.xxhash64(F.lit(pool.seed), F.col("vector_id"), k), F.lit(1 << 53)) / F.lit(float(1 << 53)) * F.lit(2 * math.pi)
    # one expression for all modes: written out, many modes make a method too long to compile
    return vectors.withColumn("phases", F.transform(F.sequence(F.lit(0), F.lit(max(pool.n_modes, 1) - 1)), lambda k: F.when(k == 0, 0.0).otherwise(uniform(k))))


def prepare(vectors: DataFrame, pool: MeltPoolSpec) -> DataFrame:
    """Frame, bounds and phases."""
    return _settled(with_phases(with_bounds(_settled(with_frame(_settled(vectors))), pool), pool))


def _settled(rows: DataFrame) -> DataFrame:
    """The same rows through an explode of one, which keeps the optimizer from writing the columns' formulas into every later use (that made methods too long to compile)."""
    return rows.select(F.explode_outer(F.array(F.struct(*(F.col(c) for c in rows.columns)))).alias("settled")).select("settled.*")


def in_aabb() -> Column:
    c = F.col
    return c("x").between(c("xmin"), c("xmax")) & c("y").between(c("ymin"), c("ymax")) & c("z").between(c("zmin"), c("zmax"))


def _across(axis: str) -> Column:
    c = F.col
    return (c("x") - c("cx")) * c(f"{axis}x") + (c("y") - c("cy")) * c(f"{axis}y")


def in_obb() -> Column:
    """Within the oriented box across and along the vector; there is no padding along it."""
    c = F.col
    return (_across("e0") * _across("e0") <= c("l0") * c("l0")) & (_across("e1") * _across("e1") <= c("l1") * c("l1"))


def time_fraction() -> Column:
    """Where on the vector, 0 to 1, the source is closest to the voxel."""
    c = F.col
    dot = (c("x") - c("sx")) * c("dx") + (c("y") - c("sy")) * c("dy") + (c("z") - c("sz")) * c("dz")
    return F.when(c("len2") > POINT, F.greatest(F.lit(0.0), F.least(F.lit(1.0), dot / F.when(c("len2") > POINT, c("len2")).otherwise(1.0)))).otherwise(0.0)


def with_path(pairs: DataFrame) -> DataFrame:
    """Time fraction, time, and cross-section coordinates of voxel and vector pairs."""
    c = F.col
    out = pairs.withColumn("tf", time_fraction())
    return out.withColumns(
        {
            "t": c("t0") + c("tf") * (c("t1") - c("t0")),
            "local_y": (c("x") - (c("sx") + c("tf") * c("dx"))) * c("e0x") + (c("y") - (c("sy") + c("tf") * c("dy"))) * c("e0y"),
            "local_z": c("z") - (c("sz") + c("tf") * c("dz")),
        }
    )


def modal(pool: MeltPoolSpec, dim: str, t: Column | None = None) -> Column:
    """A dimension at time ``t``: its modes written out, with the phases of the vector."""
    t = F.col("t") if t is None else t
    total = None
    for k, (a, f, _) in enumerate(pool.modes[dim]):
        if a == 0.0 and k:
            continue
        term = F.lit(a) * F.cos(F.lit(2 * math.pi * f) * t + F.col("phases")[k])
        total = term if total is None else total + term
    return total


def inside(y: Column, z: Column, width: Column, height: Column, depth: Column, height_shape: float, depth_shape: float) -> Column:
    """Inside or on the modified Lame curve; a vanishing or invalid dimension is not inside."""
    b = F.when(z >= 0, height).otherwise(depth)
    n = F.when(z >= 0, F.lit(float(height_shape))).otherwise(F.lit(float(depth_shape)))
    across = F.try_divide(y, width / 2.0)
    return F.coalesce(across * across + F.pow(F.try_divide(F.abs(z), b), n) <= 1.0, F.lit(False))


def melts(pool: MeltPoolSpec) -> Column:
    """The whole predicate of a pair from ``with_path`` columns."""
    w, d, h = (modal(pool, dim) for dim in DIMS)
    return inside(F.col("local_y"), F.col("local_z"), w, h, d, pool.height_shape, pool.depth_shape)
