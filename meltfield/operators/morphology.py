"""Pores: 26-connected components of porous voxels and their region properties.

Labels: voxels are grouped in cubes of ``BLOCK``; each cube is labelled by numpy, only voxels on cube faces are joined to
neighbours in other cubes, and the small graph of cube-local components goes through the checkpointed star iteration.
A label is the rank of a component by its first voxel in C order, over all components, before small ones are dropped.
"""

from __future__ import annotations

import math
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from meltfield.functions.hull import convex_image, longest
from meltfield.operators.components import connected_components, ensure_checkpoint_dir, smallest_reachable
from meltfield.schema import GridSpec

BLOCK = 32
OFFSETS = [(a, b, c) for a in (-1, 0, 1) for b in (-1, 0, 1) for c in (-1, 0, 1) if (a, b, c) > (0, 0, 0)]
MIN_VOXELS = 2
#: Fewer voxels cannot enclose a hole: the shell around one voxel has 26.
SHELL = 26

FIELDS = (
    "label num_pixels area bbox area_bbox extent centroid equivalent_diameter_area area_filled euler_number inertia_tensor inertia_tensor_eigvals "
    "axis_major_length axis_minor_length moments moments_central moments_normalized coords coords_scaled slice image image_filled surface_area "
    "area_convex solidity feret_diameter_max image_convex"
).split()


def _label_block(pdf: pd.DataFrame) -> pd.DataFrame:
    """Smallest voxel id of each voxel's component within its cube."""
    at = pdf[["ix", "iy", "iz"]].to_numpy() % BLOCK + 1
    n = len(pdf)
    place = np.full((BLOCK + 2,) * 3, n, np.int64)
    ids = pdf["voxel_id"].to_numpy()
    order = np.argsort(ids, kind="stable")
    at, ids = at[order], ids[order]
    place[at[:, 0], at[:, 1], at[:, 2]] = np.arange(n)
    a, b = [], []
    for o in OFFSETS:
        other = place[at[:, 0] + o[0], at[:, 1] + o[1], at[:, 2] + o[2]]
        hit = np.flatnonzero(other < n)
        a.append(hit)
        b.append(other[hit])
    a, b = np.concatenate(a), np.concatenate(b)
    root = smallest_reachable(n, a, b)
    out = pdf.iloc[order].copy()
    out["part"] = ids[root]
    return out[["voxel_id", "ix", "iy", "iz", "part"]]


def roots(porous: DataFrame) -> DataFrame:
    """``(voxel_id, ix, iy, iz, root)``: the smallest voxel id of each porous voxel's component."""
    ensure_checkpoint_dir(porous.sparkSession)
    voxels = porous.select("voxel_id", "ix", "iy", "iz")
    block = F.struct(*[F.floor(F.col(c) / BLOCK).cast("int").alias(c) for c in ("ix", "iy", "iz")])
    local = voxels.withColumn("block", block).groupBy("block").applyInPandas(_label_block, "voxel_id long, ix int, iy int, iz int, part long").checkpoint()
    # links between cubes: only voxels on a face have neighbours in another one
    face = local.where(" or ".join(f"pmod(i{a}, {BLOCK}) in (0, {BLOCK - 1})" for a in "xyz"))
    steps = F.array(*[F.struct(*[F.lit(v).alias(n) for n, v in zip(("ox", "oy", "oz"), o)]) for o in OFFSETS])
    reach = face.select("ix", "iy", "iz", "part", F.explode(steps).alias("o")).select(*[(F.col(f"i{a}") + F.col(f"o.o{a}")).alias(f"n{a}") for a in "xyz"], *[F.col(f"i{a}") for a in "xyz"], F.col("part").alias("a"))
    reach = reach.where(" or ".join(f"floor(n{a} / {BLOCK}) <> floor(i{a} / {BLOCK})" for a in "xyz")).select("nx", "ny", "nz", "a")
    other = face.select(*[F.col(f"i{a}").alias(f"f{a}") for a in "xyz"], F.col("part").alias("b"))
    edges = reach.join(other, (F.col("nx") == F.col("fx")) & (F.col("ny") == F.col("fy")) & (F.col("nz") == F.col("fz"))).select("a", "b").distinct()
    merged = connected_components(edges)
    return local.join(merged, F.col("part") == F.col("node"), "left").select("voxel_id", "ix", "iy", "iz", F.coalesce("root", "part").alias("root"))


def ranked(roots_table: DataFrame) -> DataFrame:
    """``(root, label)``: dense rank of the distinct roots without a single-task sort; only a count for each range part reaches the driver."""
    spark = roots_table.sparkSession
    distinct = roots_table.select("root").distinct()
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    parts = distinct.repartitionByRange(n, "root").withColumn("part", F.spark_partition_id()).checkpoint()
    counts = {r["part"]: r["count"] for r in parts.groupBy("part").count().collect()}
    offset, offsets = 0, {}
    for p in sorted(counts):
        offsets[p] = offset
        offset += counts[p]
    if not offsets:
        return distinct.select("root", F.lit(0).cast("long").alias("label"))
    start = F.create_map(*[F.lit(v) for pair in offsets.items() for v in pair])
    return parts.select("root", (F.row_number().over(Window.partitionBy("part").orderBy("root")) + start[F.col("part")]).cast("long").alias("label"))


def labels(porous: DataFrame) -> DataFrame:
    """``pore_voxel (voxel_id, label, ix, iy, iz)`` of every porous voxel."""
    r = roots(porous).checkpoint()
    rank = ranked(r).withColumnRenamed("root", "ranked_root")
    return r.join(rank, F.col("root") == F.col("ranked_root")).select("voxel_id", "label", "ix", "iy", "iz")


def without_small(labelled: DataFrame, least: int = MIN_VOXELS) -> DataFrame:
    """Drops components under ``least`` voxels; the others keep their labels."""
    big = labelled.groupBy("label").count().where(F.col("count") >= least).select(F.col("label").alias("big_label"))
    return labelled.join(big, F.col("label") == F.col("big_label"), "left_semi")


def _powers() -> list[tuple[int, int, int]]:
    return [(i, j, k) for i in range(4) for j in range(4) for k in range(4)]


def region_table(labelled: DataFrame, resolution: float, fields: list[str]) -> DataFrame:
    """One row for each label with the requested properties; several values are numbered ``name-0``, ``name-1``...

    Lengths are in units of ``resolution``; centroids count from grid index 0, the origin is not added.
    """
    unknown = [f for f in fields if f not in FIELDS]
    if unknown:
        raise ValueError(f"unsupported morphology fields {unknown}; supported: {', '.join(FIELDS)}")
    s = float(resolution)
    need = set(fields)
    aggregates = [F.count("*").alias("n")]
    for c in ("ix", "iy", "iz"):
        aggregates += [F.min(c).alias(f"min_{c}"), (F.max(c) + 1).alias(f"max_{c}"), F.avg(F.col(c).cast("double")).alias(f"avg_{c}")]
    moments = need & {"inertia_tensor", "inertia_tensor_eigvals", "axis_major_length", "axis_minor_length", "moments", "moments_central", "moments_normalized"}
    if moments:
        def power(*n):
            return math.prod((F.col(f"l{a}{e}") for a, e in zip("xyz", n) if e), start=F.lit(1.0))

        aggregates += [F.sum(power(i, j, k)).alias(f"m{i}{j}{k}") for i, j, k in _powers()]
    if need & {"coords", "coords_scaled", "image", "image_filled"}:
        aggregates.append(F.array_sort(F.collect_list(F.struct("ix", "iy", "iz"))).alias("voxels"))
    source = labelled
    if moments:
        # powers of the places in the bounding box; its corner comes from a grouped minimum, so a great pore is no single window
        low = labelled.groupBy("label").agg(*[F.min(f"i{a}").alias(f"low_{a}") for a in "xyz"]).withColumnRenamed("label", "low_label")
        source = labelled.join(low, F.col("label") == F.col("low_label"))
        place = {a: (F.col(f"i{a}") - F.col(f"low_{a}")).cast("double") for a in "xyz"}
        source = source.select("label", "ix", "iy", "iz", F.explode(F.array(F.struct(*[math.prod([place[a]] * e).alias(f"l{a}{e}") for a in "xyz" for e in (1, 2, 3)]))).alias("p")).select("label", "ix", "iy", "iz", "p.*")
    g = source.groupBy("label").agg(*aggregates)
    c = F.col
    area = c("n") * (s**3)
    box = F.lit(s**3) * (c("max_ix") - c("min_ix")) * (c("max_iy") - c("min_iy")) * (c("max_iz") - c("min_iz"))
    if need & {"euler_number", "surface_area"}:
        g = g.join(lattice_counts(labelled).withColumnRenamed("label", "lattice_label"), F.col("label") == F.col("lattice_label")).drop("lattice_label")
    if need & {"area_filled", "image_filled"}:
        g = g.join(filled(labelled).withColumnRenamed("label", "filled_label"), F.col("label") == F.col("filled_label")).drop("filled_label")
    if need & {"area_convex", "solidity", "feret_diameter_max", "image_convex"}:
        g = g.join(convex(labelled).withColumnRenamed("label", "convex_label"), F.col("label") == F.col("convex_label")).drop("convex_label")
    if moments:
        g = _with_moments(g, s)
    columns = []
    for f in fields:
        columns += {
            "label": lambda: [c("label")],
            "num_pixels": lambda: [c("n").alias("num_pixels")],
            "area": lambda: [area.alias("area")],
            "bbox": lambda: [c(f"{m}_{a}").cast("long").alias(f"bbox-{i}") for i, (m, a) in enumerate((m, a) for m in ("min", "max") for a in ("ix", "iy", "iz"))],
            "area_bbox": lambda: [box.alias("area_bbox")],
            "extent": lambda: [(area / box).alias("extent")],
            "centroid": lambda: [(c(f"avg_i{a}") * s).alias(f"centroid-{i}") for i, a in enumerate("xyz")],
            "equivalent_diameter_area": lambda: [F.pow(area * 6 / math.pi, F.lit(1 / 3)).alias("equivalent_diameter_area")],
            "area_filled": lambda: [(c("n_filled") * (s**3)).alias("area_filled")],
            "euler_number": lambda: [c("euler_number")],
            "surface_area": lambda: [(c("faces") * (s**2)).alias("surface_area")],
            "inertia_tensor": lambda: [c("tensor")[i].alias(f"inertia_tensor-{i // 3}-{i % 3}") for i in range(9)],
            "inertia_tensor_eigvals": lambda: [c("eigen")[i].alias(f"inertia_tensor_eigvals-{i}") for i in range(3)],
            "axis_major_length": lambda: [F.sqrt(F.greatest(F.lit(0.0), 10 * (c("eigen")[0] + c("eigen")[1] - c("eigen")[2]))).alias("axis_major_length")],
            "axis_minor_length": lambda: [F.sqrt(F.greatest(F.lit(0.0), 10 * (-c("eigen")[0] + c("eigen")[1] + c("eigen")[2]))).alias("axis_minor_length")],
            "moments": lambda: [c("raw")[n].alias(f"moments-{i}-{j}-{k}") for n, (i, j, k) in enumerate(_powers())],
            "moments_central": lambda: [c("central")[n].alias(f"moments_central-{i}-{j}-{k}") for n, (i, j, k) in enumerate(_powers())],
            "moments_normalized": lambda: [F.coalesce(c("normal")[n], F.lit(float("nan"))).alias(f"moments_normalized-{i}-{j}-{k}") for n, (i, j, k) in enumerate(_powers())],
            "coords": lambda: [c("voxels").alias("coords")],
            "coords_scaled": lambda: [F.transform("voxels", lambda v: F.array(v["ix"] * s, v["iy"] * s, v["iz"] * s)).alias("coords_scaled")],
            "slice": lambda: [F.array(*[F.struct(c(f"min_i{a}").alias("start"), c(f"max_i{a}").alias("stop")) for a in "xyz"]).alias("slice")],
            "image": lambda: [F.transform("voxels", lambda v: F.struct((v["ix"] - c("min_ix")).alias("i"), (v["iy"] - c("min_iy")).alias("j"), (v["iz"] - c("min_iz")).alias("k"))).alias("image")],
            "image_filled": lambda: [c("image_filled")],
            "area_convex": lambda: [(c("n_convex") * (s**3)).alias("area_convex")],
            "solidity": lambda: [(c("n") / c("n_convex")).alias("solidity")],
            "feret_diameter_max": lambda: [(c("feret") * s).alias("feret_diameter_max")],
            "image_convex": lambda: [c("image_convex")],
        }[f]()
    return g.select(*columns)


def _with_moments(g: DataFrame, s: float) -> DataFrame:
    """Raw, central and normalised moments up to the third power of each axis, inertia tensor and its eigenvalues, from power sums."""
    keep = [f for f in g.schema.fields if not (f.name.startswith("m") and f.name[1:].isdigit())]
    powers = _powers()

    def run(batches):
        for pdf in batches:
            m = np.stack([pdf[f"m{i}{j}{k}"].to_numpy(float) for i, j, k in powers], axis=1).reshape(-1, 4, 4, 4) if len(pdf) else np.zeros((0, 4, 4, 4))
            scale = np.array([[[s ** (i + j + k) for k in range(4)] for j in range(4)] for i in range(4)])
            raw = m * scale
            zero = raw[:, 0, 0, 0]
            centre = [raw[:, 1, 0, 0] / zero, raw[:, 0, 1, 0] / zero, raw[:, 0, 0, 1] / zero]
            shift = np.zeros((3, len(pdf), 4, 4))
            for a in range(3):
                for p in range(4):
                    for q in range(p + 1):
                        shift[a, :, p, q] = math.comb(p, q) * (-centre[a]) ** (p - q)
            central = np.einsum("nai,nbj,nck,nijk->nabc", shift[0], shift[1], shift[2], raw)
            normal = np.full_like(central, np.nan)
            for i, j, k in powers:
                if i + j + k >= 2:
                    normal[:, i, j, k] = central[:, i, j, k] / s ** (i + j + k) / zero ** ((i + j + k) / 3 + 1)
            mu = {"xx": central[:, 2, 0, 0] / zero, "yy": central[:, 0, 2, 0] / zero, "zz": central[:, 0, 0, 2] / zero, "xy": central[:, 1, 1, 0] / zero, "xz": central[:, 1, 0, 1] / zero, "yz": central[:, 0, 1, 1] / zero}
            tensor = np.stack([mu["yy"] + mu["zz"], -mu["xy"], -mu["xz"], -mu["xy"], mu["xx"] + mu["zz"], -mu["yz"], -mu["xz"], -mu["yz"], mu["xx"] + mu["yy"]], axis=1)
            eigen = np.clip(np.linalg.eigvalsh(tensor.reshape(-1, 3, 3))[:, ::-1], 0, None) if len(pdf) else np.zeros((0, 3))
            out = pdf[[f.name for f in keep]].copy()
            for name, value in (("raw", raw), ("central", central), ("normal", normal), ("tensor", tensor), ("eigen", eigen)):
                out[name] = list(value.reshape(len(pdf), -1))
            yield out

    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in keep] + [f"{n} array<double>" for n in ("raw", "central", "normal", "tensor", "eigen")])
    return g.mapInPandas(run, schema)


def _lattice_elements():
    """The 27 corners, edges, faces and inside of a voxel: the earlier neighbours that share each one, and its sign."""
    out = []
    for element in np.ndindex(3, 3, 3):
        sharing = [o for o in np.ndindex(3, 3, 3) if all(d == 1 or e == d for e, d in zip(element, o))]
        earlier = [tuple(d - 1 for d in o) for o in sharing if tuple(o) < (1, 1, 1)]
        out.append((earlier, -1 if sum(e == 1 for e in element) % 2 else 1))
    return out


def lattice_counts(labelled: DataFrame) -> DataFrame:
    """``(label, euler_number, faces)``: the alternating count of the lattice elements of the union of voxel cubes, and its outer faces.

    An element belongs to the first voxel that has it, so a voxel's part needs its neighbours only.  Voxels go to their cube of
    ``BLOCK`` and, at its faces, to the cubes that touch them; every cube sends one row a label.  Voxels that touch have one label.
    """
    elements = _lattice_elements()

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        at = pdf[["ix", "iy", "iz"]].to_numpy() - pdf[["bx", "by", "bz"]].to_numpy() * BLOCK + 1
        solid = np.zeros((BLOCK + 2,) * 3, bool)
        solid[at[:, 0], at[:, 1], at[:, 2]] = True
        own = np.flatnonzero(((at >= 1) & (at <= BLOCK)).all(1))
        x, y, z = at[own].T

        def has(o):
            return solid[x + o[0], y + o[1], z + o[2]]

        chi = np.zeros(len(own), np.int64)
        for earlier, sign in elements:
            taken = np.logical_or.reduce([has(o) for o in earlier]) if earlier else False
            chi += sign * ~np.broadcast_to(taken, len(own))
        faces = sum((~has(o)).astype(np.int64) for o in ((1, 0, 0), (-1, 0, 0), (0, 1, 0), (0, -1, 0), (0, 0, 1), (0, 0, -1)))
        return pd.DataFrame({"label": pdf["label"].to_numpy()[own], "euler": chi, "faces": faces}).groupby("label", as_index=False).sum()

    reach = [F.explode(F.array_distinct(F.array(*[F.floor((F.col(f"i{a}") + d) / BLOCK).cast("int") for d in (-1, 0, 1)]))).alias(f"b{a}") for a in "xyz"]
    sent = labelled.select("label", "ix", "iy", "iz")
    for column in reach:
        sent = sent.select("*", column)
    parts = sent.groupBy("bx", "by", "bz").applyInPandas(run, "label long, euler long, faces long")
    return parts.groupBy("label").agg(F.sum("euler").alias("euler_number"), F.sum("faces").alias("faces"))


def _fill(mask: np.ndarray) -> np.ndarray:
    """A mask with its holes: what background that is connected from outside over faces, edges and corners cannot reach."""
    free = np.pad(~mask, 1, constant_values=True)
    out = np.zeros_like(free)
    out[0] = out[-1] = True
    out[:, 0] = out[:, -1] = True
    out[:, :, 0] = out[:, :, -1] = True
    while True:
        grown = out
        for a in range(3):
            ahead, behind = [slice(None)] * 3, [slice(None)] * 3
            ahead[a], behind[a] = slice(1, None), slice(None, -1)
            wider = grown.copy()
            wider[tuple(ahead)] |= grown[tuple(behind)]
            wider[tuple(behind)] |= grown[tuple(ahead)]
            grown = wider
        grown &= free
        if (grown == out).all():
            return ~out[1:-1, 1:-1, 1:-1]
        out = grown


def filled(labelled: DataFrame) -> DataFrame:
    """``(label, n_filled, image_filled)``: voxels of each pore with its holes, within its bounding box."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        at = pdf[["ix", "iy", "iz"]].to_numpy()
        low = at.min(0)
        mask = np.zeros(at.max(0) - low + 1, bool)
        mask[tuple((at - low).T)] = True
        whole = _fill(mask)
        cells = [{"i": int(i), "j": int(j), "k": int(k)} for i, j, k in zip(*np.nonzero(whole))]
        return pd.DataFrame({"label": [pdf["label"].iloc[0]], "n_filled": [int(whole.sum())], "image_filled": [cells]})

    schema = "label long, n_filled long, image_filled array<struct<i:int,j:int,k:int>>"
    sizes = labelled.groupBy("label").agg(F.count("*").alias("size"), *[F.min(f"i{a}").alias(f"low_{a}") for a in "xyz"]).withColumnRenamed("label", "sized")
    sized = labelled.select("label", "ix", "iy", "iz").join(sizes, F.col("label") == F.col("sized"))
    large = sized.where(F.col("size") >= SHELL).select("label", "ix", "iy", "iz").groupBy("label").applyInPandas(run, schema)
    cell = F.struct(*[(F.col(f"i{a}") - F.col(f"low_{a}")).alias(n) for a, n in zip("xyz", "ijk")])
    small = sized.where(F.col("size") < SHELL).groupBy("label").agg(F.count("*").alias("n_filled"), F.array_sort(F.collect_list(cell)).alias("image_filled"))
    return small.union(large)


@lru_cache(maxsize=4096)
def _convex_shape(shape: bytes) -> tuple[int, float, list]:
    """Hull voxels, extent and cells of a shape; small pores share few shapes."""
    mask = convex_image(np.frombuffer(shape, np.int64).reshape(-1, 3))
    return int(mask.sum()), longest(mask), np.argwhere(mask).tolist()


def convex(labelled: DataFrame) -> DataFrame:
    """``(label, n_convex, feret, image_convex)``: voxels of each pore's convex hull and its greatest extent in voxels."""

    def run(batches):
        for pdf in batches:
            rows = []
            for cells in pdf["cells"]:
                at = np.array([list(c) for c in cells], np.int64)
                rows.append(_convex_shape((at[np.lexsort(at.T)] - at.min(0)).tobytes()))
            yield pd.DataFrame({"label": pdf["label"], "n_convex": [r[0] for r in rows], "feret": [r[1] for r in rows], "image_convex": [[dict(zip("ijk", c)) for c in r[2]] for r in rows]})

    cells = labelled.groupBy("label").agg(F.collect_list(F.array("ix", "iy", "iz")).alias("cells"))
    return cells.mapInPandas(run, "label long, n_convex long, feret double, image_convex array<struct<i:int,j:int,k:int>>")


def compute_morphology(porous: DataFrame, voxel_resolution: float, morphology_fields: list[str]) -> DataFrame:
    """Region table of the pores with at least two voxels; no pore gives an empty table with the columns."""
    return region_table(without_small(labels(porous)), voxel_resolution, list(morphology_fields))


def boundary_cells(porous: DataFrame, grid: GridSpec) -> DataFrame:
    """Porous voxels with a melted voxel, inside the grid, across one of their faces: the cells an isosurface runs through."""
    steps = [(1, 0, 0), (-1, 0, 0), (0, 1, 0), (0, -1, 0), (0, 0, 1), (0, 0, -1)]
    nx, ny, nz = grid.shape
    step = F.array(*[F.struct(*[F.lit(v).alias(n) for n, v in zip(("ox", "oy", "oz"), o)]) for o in steps])
    near = porous.select("voxel_id", "ix", "iy", "iz", F.explode(step).alias("o")).select("voxel_id", "ix", "iy", "iz", *[(F.col(f"i{a}") + F.col(f"o.o{a}")).alias(f"n{a}") for a in "xyz"])
    near = near.where((F.col("nx") >= 0) & (F.col("nx") < nx) & (F.col("ny") >= 0) & (F.col("ny") < ny) & (F.col("nz") >= 0) & (F.col("nz") < nz))
    other = porous.select(F.col("ix").alias("px"), F.col("iy").alias("py"), F.col("iz").alias("pz"))
    open_ = near.join(other, (F.col("nx") == F.col("px")) & (F.col("ny") == F.col("py")) & (F.col("nz") == F.col("pz")), "left_anti")
    return open_.select("voxel_id", "ix", "iy", "iz").distinct()


def porous_from_field(spark: SparkSession, field: np.ndarray) -> DataFrame:
    """Porous voxels of a small dense array, as tests and single-node callers have it."""
    at = np.argwhere(np.asarray(field) != 0)
    _, ny, nz = field.shape
    rows = pd.DataFrame({"voxel_id": (at[:, 0] * ny + at[:, 1]) * nz + at[:, 2], "ix": at[:, 0], "iy": at[:, 1], "iz": at[:, 2]}).astype({"voxel_id": "int64", "ix": "int32", "iy": "int32", "iz": "int32"})
    schema = "voxel_id long, ix int, iy int, iz int"
    return spark.createDataFrame(rows, schema) if len(rows) else spark.createDataFrame([], schema)
