"""Formula goldens and the melt mask against a loop over voxels and vectors."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from meltfield.functions import geometry as G
from meltfield.operators import mask
from meltfield.schema import SCAN_VECTOR, GridSpec, MeltPoolSpec
from meltfield.sources.grid import create_grid, voxels

CORE = MeltPoolSpec(
    {
        "width": ((1e-4, 0, 0), (2e-5, 5, 0), (1e-5, 10, 0)),
        "depth": ((8e-5, 0, 0), (1e-5, 5, 0), (1e-5, 10, 0)),
        "height": ((6e-5, 0, 0), (1e-5, 5, 0), (1e-5, 10, 0)),
    }
)


def vectors(spark, rows):
    return spark.createDataFrame([(i, None, *map(float, r)) for i, r in enumerate(rows)], SCAN_VECTOR)


def three(spark):
    return vectors(spark, [(0, i * 1e-4, 0, 1e-3, i * 1e-4, 0, i * 1e-3, (i + 1) * 1e-3) for i in range(3)])


def naive(rows, grid, pool, phases=None):
    """Every voxel against every vector, from the formulas."""
    out = []
    nx, ny, nz = grid.shape
    for ix in range(nx):
        for iy in range(ny):
            for iz in range(nz):
                v = np.array([grid.origin[a] + i * grid.step(a) for a, i in enumerate((ix, iy, iz))])
                for j, (sx, sy, sz, ex, ey, ez, t0, t1) in enumerate(rows):
                    s, e = np.array([sx, sy, sz]), np.array([ex, ey, ez])
                    d, c = e - s, (s + e) / 2
                    half = pool.maximum("width") / 2
                    low = np.minimum(s, e) - [half, half, pool.maximum("depth")]
                    high = np.maximum(s, e) + [half, half, pool.maximum("height")]
                    if (v < low).any() or (v > high).any():
                        continue
                    lxy = math.hypot(d[0], d[1])
                    e0, e1 = (np.array([1, 0, 0]), np.array([0, 1, 0])) if lxy < 1e-12 else (np.array([-d[1], d[0], 0]) / lxy, np.array([d[0], d[1], 0]) / lxy)
                    if ((v - c) @ e0) ** 2 > half**2 or ((v - c) @ e1) ** 2 > (lxy / 2) ** 2:
                        continue
                    tf = min(1.0, max(0.0, (v - s) @ d / (d @ d))) if d @ d > 1e-24 else 0.0
                    t = t0 + tf * (t1 - t0)
                    r = v - (s + tf * d)
                    y, z = r @ e0, r[2]
                    p = pool.phases if phases is None else phases[j]
                    w, dep, h = (sum(a * math.cos(2 * math.pi * f * t + q) for (a, f, _), q in zip(pool.modes[k], p)) for k in ("width", "depth", "height"))
                    b, n = (h, pool.height_shape) if z >= 0 else (dep, pool.depth_shape)
                    if w == 0 or b == 0 or (b < 0 and n != int(n)):
                        continue
                    if (y / (w / 2)) ** 2 + (abs(z) / b) ** n <= 1:
                        out.append((ix * ny + iy) * nz + iz)
                        break
    return sorted(out)


def ids(df):
    return sorted(r["voxel_id"] for r in df.select("voxel_id").collect())


@pytest.mark.parametrize(
    "y, z, height_shape, depth_shape, expected",
    [
        (0, 0, 2, 2, True), (1e-4, 0, 2, 2, True), (0, 1e-4, 2, 2, True), (2e-4, 1e-4, 2, 2, False), (4e-4, 2e-4, 2, 2, False),
        (1e-4 * math.cos(math.pi / 4), 1e-4 * math.sin(math.pi / 4), 2, 2, True), (0, 5e-5, 2, 2, True), (0, -4e-5, 2, 2, True),
        (5e-5, 3e-5, 2, 10, True), (5e-5, 3e-5, 1, 1, True), (5e-5, 6e-5, 0.5, 0.5, False), (5e-5, 8e-5, 1, 1, False), (9e-5, 5e-5, 10, 10, True), (5e-5, -7e-5, 2, 1, False), (5e-5, -7e-5, 1, 2, False),
    ],
)
def test_lame_curve(spark, y, z, height_shape, depth_shape, expected):
    hit = G.inside(F.lit(float(y)), F.lit(float(z)), F.lit(2e-4), F.lit(1e-4), F.lit(8e-5), height_shape, depth_shape)
    assert spark.range(1).select(hit.alias("h")).first()["h"] is expected


@pytest.mark.parametrize("width, height, depth, n", [(0.0, 1.0, 1.0, 2), (1.0, 0.0, 1.0, 2), (1.0, -1.0, 1.0, 0.5)])
def test_vanishing_dimensions_are_outside(spark, width, height, depth, n):
    hit = G.inside(F.lit(0.1), F.lit(0.1), F.lit(width), F.lit(height), F.lit(depth), n, n)
    assert spark.range(1).select(hit.alias("h")).first()["h"] is False


def test_fixture_voxels_along_the_vector(spark):
    grid = GridSpec.from_extent(5e-4, (0, 0, 0), (1e-3, 0, 0))
    assert grid.shape == (3, 1, 1)
    for strategy in ("sql", "tiles"):
        assert mask.porosity(spark, G.prepare(three(spark), CORE), grid, CORE, strategy).count() == 0


def test_fixture_150_voxels(spark):
    rows = [(i * 1e-3 / 9, j * 1.25e-4, k * 1e-4) for i in range(10) for j in range(5) for k in range(3)]
    pts = spark.createDataFrame([(n, *map(float, p)) for n, p in enumerate(rows)], "voxel_id long, x double, y double, z double")
    pairs = G.with_path(pts.crossJoin(G.prepare(three(spark), CORE)).where(G.in_aabb() & G.in_obb())).where(G.melts(CORE))
    melted = {r["voxel_id"] for r in pairs.select("voxel_id").distinct().collect()}
    assert len(melted) == 30
    assert {(round(rows[i][1], 9), rows[i][2]) for i in melted} == {(0.0, 0.0), (1.25e-4, 0.0), (2.5e-4, 0.0)}


@pytest.mark.parametrize("seed", range(4))
def test_mask_matches_the_loop(spark, seed):
    rng = np.random.default_rng(seed)
    rows = [(*(rng.uniform(0, 40, 2)), rng.uniform(0, 12), *(rng.uniform(0, 40, 2)), rng.uniform(0, 12), t, t + 1.0) for t in range(6)]
    rows += [(*rows[0][:3], *rows[0][:3], 0.0, 1.0), (5.0, 5.0, 0.0, 5.0, 5.0, 10.0, 0.0, 1.0)]  # a point, and a vertical one
    pool = MeltPoolSpec(
        {"width": ((6.0, 0, 0), (1.5, 0.3, 0.7)), "depth": ((4.0, 0, 0), (1.0, 0.7, 0), (0.5, 1.1, 0)), "height": ((3.0, 0, 0),)},
        2.0, float(rng.choice([0.5, 1.0, 2.0])), float(rng.choice([1.0, 2.0, 10.0])),
    )
    grid = GridSpec.from_box(1.7, [[0.137, 0.271, 0.113], [40.2, 41.3, 12.4]])
    prepared = G.prepare(vectors(spark, rows), pool)
    expected = naive(rows, grid, pool)
    assert expected
    assert ids(mask.melted_sql(voxels(spark, grid), prepared, grid, pool)) == expected
    assert ids(mask.mask(spark, prepared, grid, pool, melted=True)) == expected
    porous = ids(mask.porosity(spark, prepared, grid, pool, "tiles"))
    assert sorted(porous + expected) == list(range(grid.n_voxels))
    assert ids(mask.porous_sql(voxels(spark, grid), prepared, grid, pool)) == porous


def test_random_phases_are_repeatable_and_used(spark):
    rows = [(0, 10 * i, 0, 40, 10 * i, 0, i, i + 1) for i in range(4)]
    pool = MeltPoolSpec({"width": ((6, 0, 0), (2, 0.9, 0)), "depth": ((4, 0, 0), (1, 0.4, 0)), "height": ((3, 0, 0), (1, 2, 0))}, random_phases=True, seed=3)
    prepared = G.prepare(vectors(spark, rows), pool).repartition(3)
    phases = {r["vector_id"]: r["phases"] for r in prepared.select("vector_id", "phases").collect()}
    assert all(p[0] == 0.0 and 0 <= p[1] < 2 * math.pi for p in phases.values()) and len({p[1] for p in phases.values()}) == 4
    assert phases == {r["vector_id"]: r["phases"] for r in G.prepare(vectors(spark, rows), pool).select("vector_id", "phases").collect()}
    grid = GridSpec.from_box(1.3, [[0.1, 0.2, -3.9], [40, 31, 3]])
    assert ids(mask.mask(spark, prepared, grid, pool, melted=True)) == naive(rows, grid, pool, [phases[i] for i in range(4)])


def test_pruning_and_partitions_do_not_matter(spark):
    rows = [(0, 10 * i, 0, 40, 10 * i, 0, i, i + 1) for i in range(8)]
    pool = MeltPoolSpec({"width": ((6, 0, 0),), "depth": ((4, 0, 0),), "height": ((3, 0, 0),)})
    grid = GridSpec.from_box(1.1, [[10.03, 20.07, -4.1], [30, 39, 3]])
    prepared = G.prepare(vectors(spark, rows), pool)
    assert mask.prune(prepared, grid).count() < 8
    expected = naive(rows, grid, pool)
    assert ids(mask.mask(spark, prepared.repartition(5), grid, pool, melted=True)) == expected
    assert ids(mask.mask(spark, prepared.orderBy(F.desc("vector_id")), grid, pool, melted=True)) == expected


def test_no_vectors_leave_all_porous(spark):
    grid = GridSpec.from_box(1.0, [[0, 0, 0], [3, 2, 1]])
    empty = G.prepare(spark.createDataFrame([], SCAN_VECTOR), CORE)
    assert mask.porosity(spark, empty, grid, CORE, "tiles").count() == grid.n_voxels == 4 * 3 * 2
    assert mask.porosity(spark, empty, grid, CORE, "sql").count() == grid.n_voxels


def test_grids(spark):
    assert GridSpec.from_box(0.01, [[0, 0, 0], [1, 1, 0.5]]).shape == (101, 101, 51)
    assert GridSpec.from_box(5e-6, [[0.002, -5e-4, -5e-4], [0.006, 5e-4, 5e-4]]).shape == (801, 201, 201)
    g = GridSpec.from_box(0.37, [[0.11, -2, 5], [3, 1, 6.2]])
    rows = voxels(spark, g).orderBy("voxel_id").collect()
    axes = [np.arange(o, h + 0.37 / 2, 0.37) for o, h in zip((0.11, -2, 5), (3, 1, 6.2))]
    expected = np.stack([a.ravel() for a in np.meshgrid(*axes, indexing="ij")], axis=1)
    assert np.array_equal(np.array([(r["x"], r["y"], r["z"]) for r in rows]), expected)
    assert create_grid(1e-4, path_vectors=three(spark)).shape == (11, 3, 1)
    for bad in (lambda: create_grid(0.0, bound_box=[[0] * 3, [1] * 3]), lambda: create_grid(1.0), lambda: create_grid(1.0, bound_box=[[0, 0, 0], [1, -1, 1]]), lambda: create_grid(1.0, path_vectors=[123, "invalid", None])):
        with pytest.raises(ValueError):
            bad()
