"""Which voxels are melted: a bounded range join of voxels and scan vectors.

Two physical strategies give the same mask:

``sql``   vectors are exploded over the z planes they reach and joined to the voxels on that key with the box tests as residual;
          pairs that pass the melt predicate give the melted ids for a left semi or left anti join.  Meant for few modes.
``tiles`` the grid is cut into cubes of ``TILE`` voxels; (tile, vector) pairs are shuffled, voxels never are.  Each tile is
          computed by numpy from the grid's arithmetic and skips voxels already melted; a tile with very many vectors is split
          by salt, and the partial bitmaps are merged by OR.  Memory is one tile and one Arrow batch.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from meltfield.functions import geometry as G
from meltfield.schema import GridSpec, MeltPoolSpec
from meltfield.sources.grid import voxels as grid_voxels

TILE = 32
#: Rows of exploded vectors up to which the build side is broadcast (about 300 bytes each).
BROADCAST_ROWS = 200_000
SALTS = 4


def prune(vectors: DataFrame, grid: GridSpec) -> DataFrame:
    """Drops bounded vectors whose box misses the grid; they cannot melt any of its voxels."""
    (lx, ly, lz), (hx, hy, hz) = grid.origin, grid.high
    c = F.col
    return vectors.where((c("xmax") >= lx) & (c("xmin") <= hx) & (c("ymax") >= ly) & (c("ymin") <= hy) & (c("zmax") >= lz) & (c("zmin") <= hz))


def _index_range(grid: GridSpec, axis: int, low, high, tile: int = 1):
    """Grid indices (or tiles of them) from below ``low`` to above ``high``: padded by one, never exact."""
    step, n = grid.step(axis), grid.shape[axis]
    a = F.greatest(F.lit(0), F.floor((low - grid.origin[axis]) / step).cast("int") - 1)
    b = F.least(F.lit(n - 1), F.ceil((high - grid.origin[axis]) / step).cast("int") + 1)
    a, b = F.least(a, F.lit(n - 1)), F.greatest(b, F.lit(0))
    return F.sequence(F.expr("0") + F.floor(a / tile).cast("int"), F.greatest(F.floor(a / tile), F.floor(b / tile)).cast("int"))


def binned(vectors: DataFrame, grid: GridSpec) -> DataFrame:
    """Pruned vectors, a row for each z plane they may reach (``bin_z``)."""
    return prune(vectors, grid).withColumn("bin_z", F.explode(_index_range(grid, 2, F.col("zmin"), F.col("zmax"))))


def _build(rows: DataFrame) -> DataFrame:
    """Broadcast only behind a count; more rows are shuffled by the join key."""
    return F.broadcast(rows) if rows.count() <= BROADCAST_ROWS else rows


def candidates(voxels: DataFrame, vectors: DataFrame, grid: GridSpec) -> DataFrame:
    """Voxel and vector pairs within the axis-aligned and the oriented box, with path columns."""
    build = _build(binned(vectors, grid))
    return G.with_path(voxels.join(build, (F.col("iz") == F.col("bin_z")) & G.in_aabb() & G.in_obb()).drop("bin_z"))


def melted_ids(voxels: DataFrame, vectors: DataFrame, grid: GridSpec, pool: MeltPoolSpec) -> DataFrame:
    """``voxel_id`` of the voxels that some vector melts.

    The cheap tests are the join's condition.  Time and cross-section come out of an explode, which keeps the optimizer from
    writing their formulas into every use in the modal sums (that made methods too long to compile).
    """
    c = F.col
    build = _build(binned(vectors, grid))
    pairs = voxels.join(build, (c("iz") == c("bin_z")) & G.in_aabb() & G.in_obb()).withColumn("tf", G.time_fraction())
    tf = c("tf")
    path = F.struct(
        (c("t0") + tf * (c("t1") - c("t0"))).alias("t"),
        ((c("x") - (c("sx") + tf * c("dx"))) * c("e0x") + (c("y") - (c("sy") + tf * c("dy"))) * c("e0y")).alias("local_y"),
        (c("z") - (c("sz") + tf * c("dz"))).alias("local_z"),
    )
    held = pairs.select("voxel_id", "phases", F.explode_outer(F.array(path)).alias("path")).select("voxel_id", "phases", "path.t", "path.local_y", "path.local_z")
    return held.where(G.melts(pool)).select(F.col("voxel_id").alias("melted_id")).distinct()


def melted_sql(voxels: DataFrame, vectors: DataFrame, grid: GridSpec, pool: MeltPoolSpec) -> DataFrame:
    """Voxels with a vector that melts them (semi join)."""
    return voxels.join(melted_ids(voxels, vectors, grid, pool), F.col("voxel_id") == F.col("melted_id"), "left_semi")


def porous_sql(voxels: DataFrame, vectors: DataFrame, grid: GridSpec, pool: MeltPoolSpec) -> DataFrame:
    """Voxels that no vector melts (anti join)."""
    return voxels.join(melted_ids(voxels, vectors, grid, pool), F.col("voxel_id") == F.col("melted_id"), "left_anti")


_NEEDS = ("sx", "sy", "sz", "dx", "dy", "dz", "cx", "cy", "cz", "e0x", "e0y", "e1x", "e1y", "l0", "l1", "t0", "t1", "len2", "xmin", "xmax", "ymin", "ymax", "zmin", "zmax")


class TileKernel:
    """Melts the voxels of one tile by one vector after another."""

    def __init__(self, grid: GridSpec, pool: MeltPoolSpec):
        self.grid, self.pool = grid, pool
        self.tiles = tuple(-(-n // TILE) for n in grid.shape)
        modes = {d: np.array(m, float) for d, m in pool.modes.items()}
        self.amplitude = {d: m[:, 0] for d, m in modes.items()}
        self.omega = {d: 2 * math.pi * m[:, 1] for d, m in modes.items()}

    def box(self, tile: int) -> list[tuple[int, int]]:
        _, ty, tz = self.tiles
        at = (tile // (ty * tz), tile // tz % ty, tile % tz)
        return [(a * TILE, min(n, (a + 1) * TILE)) for a, n in zip(at, self.grid.shape)]

    def axes(self, box) -> list[np.ndarray]:
        return [self.grid.origin[a] + np.arange(low, high) * self.grid.step(a) for a, (low, high) in enumerate(box)]

    def melt(self, axes, mask: np.ndarray, v: dict, phases: np.ndarray) -> None:
        """Marks the voxels of ``mask`` (nx, ny, nz) that vector ``v`` melts."""
        cut = [slice(np.searchsorted(x, v[f"{a}min"], "left"), np.searchsorted(x, v[f"{a}max"], "right")) for a, x in zip("xyz", axes)]
        part = mask[tuple(cut)]
        if part.size == 0 or part.all():
            return
        x, y = axes[0][cut[0]][:, None], axes[1][cut[1]][None, :]
        across = (x - v["cx"]) * v["e0x"] + (y - v["cy"]) * v["e0y"]
        along = (x - v["cx"]) * v["e1x"] + (y - v["cy"]) * v["e1y"]
        column = (across * across <= v["l0"] ** 2) & (along * along <= v["l1"] ** 2)
        if not column.any():
            return
        i, j, k = np.nonzero(column[:, :, None] & ~part)
        if not len(i):
            return
        px, py, pz = axes[0][cut[0]][i], axes[1][cut[1]][j], axes[2][cut[2]][k]
        tf = np.zeros(len(i))
        if v["len2"] > G.POINT:
            tf = np.clip(((px - v["sx"]) * v["dx"] + (py - v["sy"]) * v["dy"] + (pz - v["sz"]) * v["dz"]) / v["len2"], 0.0, 1.0)
        t = v["t0"] + tf * (v["t1"] - v["t0"])
        ly = (px - (v["sx"] + tf * v["dx"])) * v["e0x"] + (py - (v["sy"] + tf * v["dy"])) * v["e0y"]
        lz = pz - (v["sz"] + tf * v["dz"])
        # many voxels of a horizontal vector share a time
        moments, back = np.unique(t, return_inverse=True)
        size = {d: self.modal(d, moments, phases)[back] for d in ("width", "depth", "height")}
        up = lz >= 0
        b = np.where(up, size["height"], size["depth"])
        n = np.where(up, self.pool.height_shape, self.pool.depth_shape)
        with np.errstate(all="ignore"):
            value = (ly / (size["width"] / 2)) ** 2 + np.power(np.abs(lz) / b, n)
            part[i, j, k] |= (value <= 1.0) & (b != 0) & (size["width"] != 0)

    def modal(self, dim: str, t: np.ndarray, phases: np.ndarray) -> np.ndarray:
        out = np.zeros(len(t))
        for a, w, p in zip(self.amplitude[dim], self.omega[dim], phases):
            if a:
                out += a * np.cos(w * t + p)
        return out


def tile_pairs(vectors: DataFrame, grid: GridSpec) -> DataFrame:
    """A row for each vector and tile that its box reaches and its axis passes close enough."""
    _, ny, nz = (-(-n // TILE) for n in grid.shape)
    out = prune(vectors, grid)
    for a, name in enumerate("xyz"):
        out = out.withColumn(f"tile_{name}", F.explode(_index_range(grid, a, F.col(f"{name}min"), F.col(f"{name}max"), TILE)))
    # the oriented box against the circle around the tile
    c = F.col
    middle = {a: F.lit(grid.origin[i]) + (c(f"tile_{a}") * TILE + (TILE - 1) / 2) * F.lit(grid.step(i)) for i, a in enumerate("xy")}
    radius = math.sqrt(2) * TILE / 2 * grid.resolution
    across = (middle["x"] - c("cx")) * c("e0x") + (middle["y"] - c("cy")) * c("e0y")
    along = (middle["x"] - c("cx")) * c("e1x") + (middle["y"] - c("cy")) * c("e1y")
    near = (F.abs(across) <= c("l0") + radius) & (F.abs(along) <= c("l1") + radius)
    return out.where(near).withColumn("tile", ((c("tile_x") * ny + c("tile_y")) * nz + c("tile_z")).cast("long"))


def melted_tiles(vectors: DataFrame, grid: GridSpec, pool: MeltPoolSpec) -> DataFrame:
    """``(tile, bits BINARY)`` of the tiles with melted voxels."""
    kernel = TileKernel(grid, pool)
    n = int(vectors.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    pairs = tile_pairs(vectors, grid).select("tile", F.pmod("vector_id", F.lit(SALTS)).alias("salt"), "vector_id", *_NEEDS, "phases")
    dealt = pairs.repartition(n, "tile", "salt").sortWithinPartitions("tile", "salt")

    def run(batches):
        key = mask = axes = None

        def done():
            return pa.RecordBatch.from_arrays([pa.array([key[0]], pa.int64()), pa.array([np.packbits(mask).tobytes()], pa.binary())], ["tile", "bits"])

        for batch in batches:
            columns = {c: batch.column(c).to_numpy(zero_copy_only=False) for c in ("tile", "salt", *_NEEDS)}
            phases = batch.column("phases").to_pylist()
            for r in range(batch.num_rows):
                now = (int(columns["tile"][r]), int(columns["salt"][r]))
                if now != key:
                    if key is not None and mask.any():
                        yield done()
                    key, box = now, kernel.box(now[0])
                    axes, mask = kernel.axes(box), np.zeros([h - l for l, h in box], bool)
                kernel.melt(axes, mask, {c: columns[c][r] for c in _NEEDS}, np.array(phases[r]))
        if key is not None and mask.any():
            yield done()

    parts = dealt.mapInArrow(run, "tile long, bits binary")
    # a tile has one bitmap for each salt at most
    return parts.groupBy("tile").agg(F.collect_list("bits").alias("parts"))


def _tile_voxels(tiles: DataFrame, grid: GridSpec, pool: MeltPoolSpec, melted: bool | None) -> DataFrame:
    kernel = TileKernel(grid, pool)
    _, ny, nz = grid.shape

    def run(batches):
        for batch in batches:
            for tile, parts in zip(batch.column("tile").to_pylist(), batch.column("parts").to_pylist()):
                box = kernel.box(tile)
                shape = [h - l for l, h in box]
                mask = np.zeros(math.prod(shape), bool)
                for bits in parts or ():
                    mask |= np.unpackbits(np.frombuffer(bits, np.uint8), count=mask.size).astype(bool)
                mask = mask.reshape(shape)
                i, j, k = (np.arange(*b) for b in box)
                ids = ((i[:, None, None] * ny + j[None, :, None]) * nz + k[None, None, :]).astype(np.int64)
                keep = np.ones(shape, bool) if melted is None else mask == melted
                if keep.any():
                    yield pa.RecordBatch.from_arrays([pa.array(ids[keep]), pa.array(mask[keep])], ["voxel_id", "melted"])

    return tiles.mapInArrow(run, "voxel_id long, melted boolean")


def mask(spark: SparkSession, vectors: DataFrame, grid: GridSpec, pool: MeltPoolSpec, melted: bool | None = None) -> DataFrame:
    """``(voxel_id, melted)`` of all voxels, or only of the melted (True) or porous (False) ones, by tiles.

    ``vectors`` have the columns of ``geometry.prepare``; an empty table leaves every voxel porous.
    """
    found = melted_tiles(vectors, grid, pool)
    if melted:
        return _tile_voxels(found, grid, pool, True)
    tiles = spark.range(math.prod(-(-n // TILE) for n in grid.shape)).withColumnRenamed("id", "tile")
    joined = tiles.join(found.withColumnRenamed("tile", "found_tile"), F.col("tile") == F.col("found_tile"), "left").select("tile", "parts")
    return _tile_voxels(joined, grid, pool, melted)


def porosity(spark: SparkSession, vectors: DataFrame, grid: GridSpec, pool: MeltPoolSpec, strategy: str = "auto") -> DataFrame:
    """Porous voxels ``(voxel_id, ix, iy, iz, x, y, z)``; ``strategy`` is auto, sql or tiles."""
    from meltfield.sources.grid import with_coordinates

    if strategy == "sql" or (strategy == "auto" and pool.n_modes <= 1):
        return porous_sql(grid_voxels(spark, grid), vectors, grid, pool)
    return with_coordinates(mask(spark, vectors, grid, pool, melted=False).select("voxel_id"), grid)


def dense_field(spark: SparkSession, vectors: DataFrame, grid: GridSpec, pool: MeltPoolSpec) -> DataFrame:
    """``(voxel_id, ix, iy, iz, porosity TINYINT)`` of every voxel, written by the tile kernel: no voxel is shuffled."""
    from meltfield.sources.grid import with_coordinates

    every = with_coordinates(mask(spark, vectors, grid, pool), grid)
    return every.select("voxel_id", "ix", "iy", "iz", F.when(F.col("melted"), 0).otherwise(1).cast("byte").alias("porosity"))


def dense(spark: SparkSession, porous: DataFrame, grid: GridSpec) -> DataFrame:
    """``(voxel_id, ix, iy, iz, porosity TINYINT)`` of every voxel: 1 porous, 0 melted."""
    hit = porous.select(F.col("voxel_id").alias("porous_id"))
    every = grid_voxels(spark, grid).select("voxel_id", "ix", "iy", "iz")
    return every.join(hit, F.col("voxel_id") == F.col("porous_id"), "left").select("voxel_id", "ix", "iy", "iz", F.when(F.col("porous_id").isNull(), 0).otherwise(1).cast("byte").alias("porosity"))
