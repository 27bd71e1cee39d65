"""Pores, sinks, whole runs, the command line and the stream."""

import base64
import csv
import math
import re
import struct
import zlib

import numpy as np
import pytest

import __spark_entry__
from meltfield import cli
from meltfield.functions import geometry as G
from meltfield.operators import components, mask, morphology
from meltfield.operators.components import connected_components
from meltfield.plans.pipeline import compute_porosity
from meltfield.schema import GridSpec, MeltPoolSpec
from meltfield.sinks.text import write_morphology
from meltfield.sinks.vti import read_vtk, read_vtk_table, write_vtk
from meltfield.sources.hatch import ScanStrategy
from meltfield.streaming import layers


def flood(field):
    """Labels by a plain flood over faces, edges and corners, in C order."""
    out, n = np.zeros(field.shape, int), 0
    for start in map(tuple, np.argwhere(field)):
        if out[start]:
            continue
        n += 1
        out[start], todo = n, [start]
        while todo:
            p = todo.pop()
            for a in (-1, 0, 1):
                for b in (-1, 0, 1):
                    for c in (-1, 0, 1):
                        q = (p[0] + a, p[1] + b, p[2] + c)
                        if all(0 <= v < s for v, s in zip(q, field.shape)) and field[q] and not out[q]:
                            out[q] = n
                            todo.append(q)
    return out


@pytest.mark.parametrize("shape, share, seed", [((40, 37, 35), 0.05, 0), ((70, 20, 33), 0.12, 1), ((33, 33, 33), 0.6, 2), ((5, 4, 3), 1.0, 3)])
def test_labels_match_a_flood(spark, shape, share, seed):
    field = np.random.default_rng(seed).random(shape) < share
    expected = flood(field)
    got = np.zeros(shape, int)
    for r in morphology.labels(morphology.porous_from_field(spark, field)).collect():
        got[r["ix"], r["iy"], r["iz"]] = r["label"]
    assert np.array_equal(got, expected)


@pytest.mark.parametrize("small", [components.SMALL, -1])
def test_long_chain_of_components(spark, small, monkeypatch):
    monkeypatch.setattr(components, "SMALL", small)
    n = 300
    order = np.random.default_rng(5).permutation(n)
    edges = [(int(order[i]), int(order[i + 1])) for i in range(n - 1)] + [(1000, 1001), (1001, 1001), (None, 5)]
    found = {r["node"]: r["root"] for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert found == {i: 0 for i in range(n)} | {1000: 1000, 1001: 1000}
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_two_pores(spark):
    field = np.zeros((20, 20, 20), np.uint8)
    field[5:8, 5:8, 5:8] = field[15:18, 15:18, 15:18] = 1
    field[0, 0, 0] = 1  # a single voxel takes label 1 and goes
    t = morphology.compute_morphology(morphology.porous_from_field(spark, field), 0.01, ["label", "area", "centroid", "bbox", "extent", "equivalent_diameter_area", "euler_number"]).orderBy("label").collect()
    assert [r["label"] for r in t] == [2, 3] and [r["area"] for r in t] == pytest.approx([2.7e-5] * 2)
    assert [t[0][f"centroid-{i}"] for i in range(3)] == pytest.approx([0.06] * 3) and [t[0][f"bbox-{i}"] for i in range(6)] == [5, 5, 5, 8, 8, 8]
    assert t[0]["extent"] == pytest.approx(1) and t[0]["euler_number"] == 1 and t[0]["equivalent_diameter_area"] == pytest.approx((6 * 2.7e-5 / math.pi) ** (1 / 3))


def euler_of(spark, cells):
    field = np.zeros((6, 6, 6), bool)
    field[tuple(np.array(cells).T)] = True
    labelled = morphology.labels(morphology.porous_from_field(spark, field))
    (r,) = morphology.region_table(labelled, 1.0, ["num_pixels", "area_filled", "euler_number", "surface_area", "image_filled"]).collect()
    return r


def test_topology(spark):
    shell = [(i, j, k) for i in range(1, 4) for j in range(1, 4) for k in range(1, 4) if (i, j, k) != (2, 2, 2)]
    r = euler_of(spark, shell)
    assert (r["euler_number"], r["area_filled"], len(r["image_filled"]), r["surface_area"]) == (2, 27.0, 27, 60.0)
    assert euler_of(spark, [(i, j, 0) for i in range(3) for j in range(3) if (i, j) != (1, 1)])["euler_number"] == 0
    r = euler_of(spark, [(0, 0, 0), (1, 1, 1)])
    assert (r["euler_number"], r["area_filled"], r["surface_area"]) == (1, 2.0, 12.0)


def test_hulls(spark):
    from meltfield.functions.hull import convex_image, longest, planes

    rng = np.random.default_rng(4)
    for _ in range(20):
        p = rng.integers(-6, 7, (rng.integers(5, 60), 3))
        p = np.concatenate([p, [[0, 0, 0], [1, 0, 0], [0, 1, 0], [0, 0, 1]]])
        n, d = planes(p)
        assert (p @ n.T <= d).all()
        # every face holds three points or more, and every pair of opposite directions is supported by the points
        assert all((p @ a == b).sum() >= 3 for a, b in zip(n, d) if a.any())
        inside = rng.dirichlet(np.ones(len(p)), 50) @ p
        assert (inside @ n.T <= d + 1e-9).all()
        away = rng.normal(size=(50, 3))
        top = (p @ away.T).max(0)
        outside = p[(p @ away.T).argmax(0)] + away * 1e-3
        assert ((outside @ n.T > d - 1e-12).any(1)).all() and len(top) == 50
    bar = np.array([(i, 0, 0) for i in range(5)])
    assert convex_image(bar).all() and longest(convex_image(bar)) == pytest.approx(5.0)
    ell = np.array([(i, 0, 0) for i in range(5)] + [(0, j, 0) for j in range(5)])
    assert convex_image(ell)[1, 1, 0] and not convex_image(ell)[4, 4, 0]
    field = np.zeros((6, 6, 6), bool)
    field[tuple(ell.T)] = True
    (r,) = morphology.region_table(morphology.labels(morphology.porous_from_field(spark, field)), 0.5, ["area", "area_convex", "solidity", "feret_diameter_max"]).collect()
    n = convex_image(ell).sum()
    assert (r["area_convex"], r["solidity"]) == (pytest.approx(n / 8), pytest.approx(9 / n)) and r["feret_diameter_max"] == pytest.approx(0.5 * longest(convex_image(ell)))


def test_moments_and_inertia(spark):
    rng = np.random.default_rng(1)
    field = np.zeros((12, 11, 10), bool)
    field[2:9, 3:6, 4:8] = rng.random((7, 3, 4)) < 0.9
    labelled = morphology.without_small(morphology.labels(morphology.porous_from_field(spark, field)), 20)
    (r,) = morphology.region_table(labelled, 0.5, ["bbox", "centroid", "inertia_tensor", "inertia_tensor_eigvals", "moments", "moments_central", "moments_normalized", "axis_major_length", "axis_minor_length", "coords", "coords_scaled", "slice", "image"]).collect()
    at = np.array([tuple(c) for c in r["coords"]]) * 0.5
    d = at - at.mean(0)
    mu = np.einsum("ni,nj->ij", d, d) / len(at)
    assert np.allclose([[r[f"inertia_tensor-{i}-{j}"] for j in range(3)] for i in range(3)], np.trace(mu) * np.eye(3) - mu)
    local = at - at.min(0)
    assert r["moments-2-1-0"] == pytest.approx((local[:, 0] ** 2 * local[:, 1]).sum()) and r["moments_central-1-0-2"] == pytest.approx((d[:, 0] * d[:, 2] ** 2).sum(), abs=1e-9)
    assert math.isnan(r["moments_normalized-1-0-0"]) and r["moments_normalized-2-0-0"] == pytest.approx((d[:, 0] ** 2).sum() / 0.25 / len(at) ** (5 / 3))
    e = sorted(np.linalg.eigvalsh(np.trace(mu) * np.eye(3) - mu))[::-1]
    assert r["axis_major_length"] == pytest.approx(math.sqrt(10 * (e[0] + e[1] - e[2]))) and r["axis_minor_length"] == pytest.approx(math.sqrt(10 * (-e[0] + e[1] + e[2])))


def test_no_pores_and_unknown_fields(spark, tmp_path):
    none = morphology.porous_from_field(spark, np.zeros((10, 10, 10)))
    t = morphology.compute_morphology(none, 0.01, ["area", "centroid"])
    assert t.columns == ["area", "centroid-0", "centroid-1", "centroid-2"] and t.count() == 0
    assert write_morphology(t, str(tmp_path / "m.csv")) == 0 and (tmp_path / "m.csv").read_text().strip() == "area,centroid-0,centroid-1,centroid-2"
    with pytest.raises(ValueError):
        morphology.compute_morphology(none, 0.01, ["perimeter"])


def test_raster_round_trip(spark, tmp_path):
    rng = np.random.default_rng(2)
    field = (rng.random((7, 5, 4)) < 0.4).astype(np.uint8)
    grid = GridSpec(0.01, (0.5, -1.0, 2.0), field.shape)
    porous = morphology.porous_from_field(spark, field)
    assert write_vtk(porous, grid, str(tmp_path / "p.vti")) == field.sum()
    g, back = read_vtk(str(tmp_path / "p.vti"))
    assert g == grid and np.array_equal(back, field)
    assert read_vtk_table(spark, str(tmp_path / "p.vti")).count() == field.sum()
    assert write_vtk(morphology.porous_from_field(spark, field * 0), grid, str(tmp_path / "q.vti")) == 0 and not read_vtk(str(tmp_path / "q.vti"))[1].any()


def plain_raster(path):
    """Dimensions and points of an image-data file, read by its format and not by the library."""
    text = path.read_text()
    extent = list(map(int, re.search(r'WholeExtent="([^"]*)"', text)[1].split()))
    assert 'header_type="UInt64"' in text and 'byte_order="LittleEndian"' in text and 'type="UInt8"' in text
    data = base64.b64decode(re.search(r"<DataArray[^>]*>\s*([A-Za-z0-9+/=]*)\s*</DataArray>", text)[1], validate=True)
    assert struct.unpack("<Q", data[:8])[0] == len(data) - 8
    return [extent[1] + 1, extent[3] + 1, extent[5] + 1], data[8:]


@pytest.mark.parametrize("shape", [(7, 5, 4), (1, 1, 1), (2, 3, 1), (5, 5, 5)])
def test_raster_is_one_unit_with_its_length(spark, tmp_path, shape):
    field = (np.random.default_rng(3).random(shape) < 0.5).astype(np.uint8)
    write_vtk(morphology.porous_from_field(spark, field), GridSpec(0.01, (0.0, 0.0, 0.0), shape), str(tmp_path / "r.vti"))
    (nx, ny, nz), data = plain_raster(tmp_path / "r.vti")
    assert (nx, ny, nz) == shape and all(data[i + nx * (j + ny * k)] == field[i, j, k] for i in range(nx) for j in range(ny) for k in range(nz))


@pytest.mark.parametrize("word, header", [("<I", "UInt32"), ("<Q", "UInt64")])
def test_rasters_of_other_writers_are_read(tmp_path, word, header):
    field = (np.random.default_rng(4).random((3, 4, 5)) < 0.5).astype(np.uint8)
    raw = field.transpose(2, 1, 0).tobytes()
    def unit(*parts):
        return base64.b64encode(b"".join(parts)).decode()
    def head(*numbers):
        return b"".join(struct.pack(word, n) for n in numbers)
    blocks = [zlib.compress(raw[i : i + 32]) for i in (0, 32)]
    bodies = {("ascii", ""): " ".join(map(str, raw)), ("binary", ""): unit(head(len(raw)), raw), ("binary", ' compressor="vtkZLibDataCompressor"'): unit(head(2, 32, 28, *map(len, blocks))) + unit(*blocks)}
    for (kind, compressor), body in bodies.items():
        path = tmp_path / "x.vti"
        path.write_text(f'<VTKFile type="ImageData" byte_order="LittleEndian" header_type="{header}"{compressor}><ImageData WholeExtent="0 2 0 3 0 4" Origin="0 0 0" Spacing="1 1 1"><Piece Extent="0 2 0 3 0 4"><PointData><DataArray type="UInt8" Name="porosity" format="{kind}">{body}</DataArray></PointData></Piece></ImageData></VTKFile>')
        assert np.array_equal(read_vtk(str(path))[1], field)


@pytest.mark.parametrize("seed", range(3))
def test_lattice_counts_by_their_definition(spark, seed):
    """Euler numbers and faces of random fields over several cubes, element by element."""
    shape = (37, 34, 8)
    field = np.random.default_rng(seed).random(shape) < (0.04, 0.12, 0.5)[seed]
    labelled = morphology.labels(morphology.porous_from_field(spark, field)).cache()
    elements, faces = {}, {}
    for r in labelled.collect():
        at = (r["ix"], r["iy"], r["iz"])
        for o in np.ndindex(3, 3, 3):
            elements.setdefault(r["label"], set()).add(tuple(2 * a + e for a, e in zip(at, o)))
        for axis in range(3):
            for step in (-1, 1):
                n = tuple(a + (step if i == axis else 0) for i, a in enumerate(at))
                free = not (all(0 <= c < m for c, m in zip(n, shape)) and field[n])
                faces[r["label"]] = faces.get(r["label"], 0) + free
    got = {r["label"]: (r["euler_number"], r["faces"]) for r in morphology.lattice_counts(labelled).collect()}
    assert got == {k: (sum(1 - 2 * (sum(c % 2 for c in e) % 2) for e in v), faces[k]) for k, v in elements.items()}


POOL = MeltPoolSpec({d: ((1e-4, 0, 0), (4.0876165465e-08, 0.99, -1.5393804003), (9.3202056060e-08, 1.98, -1.5079644737)) for d in ("width", "depth", "height")})


def test_full_workflow(spark):
    box = [[0, 0, 0], [1, 1, 0.5]]
    strategy = ScanStrategy(box, 200, 1, 0.1, 0.05, 67, 0.1, 0)
    grid = GridSpec.from_box(0.01, box)
    porous = compute_porosity(spark, grid, strategy.vectors(spark), POOL, "tiles")
    melted = grid.n_voxels - porous.count()
    assert grid.n_voxels == 520251 and abs(melted - 1209) <= 60  # voxels lie on boundaries


def test_stream_of_layers(spark, tmp_path):
    box = [[0, 0, 0], [40, 30, 12]]
    strategy = ScanStrategy(box, 200, 1, 7.0, 3.0, 67, 5.0, 0)
    pool = MeltPoolSpec({"width": ((6, 0, 0),), "depth": ((4, 0, 0),), "height": ((3, 0, 0),)})
    grid = GridSpec.from_box(1.3, [[0.1, 0.2, 0.3], [40, 30, 12]])
    for k in range(strategy.last_layer + 1):
        strategy.vectors(spark).where(f"layer = {k}").coalesce(1).write.parquet(str(tmp_path / f"staged/{k}"))
    (tmp_path / "in").mkdir()
    for k, f in enumerate(sorted((tmp_path / "staged").glob("*/*.parquet"))):
        f.rename(tmp_path / "in" / f"{k}.parquet")
    q = layers.start(layers.vector_stream(spark, str(tmp_path / "in"), 2), grid, pool, str(tmp_path / "out"), str(tmp_path / "state"))
    q.awaitTermination(120)
    assert q.exception() is None
    got = sorted(r["voxel_id"] for r in layers.porosity_so_far(spark, grid, pool, str(tmp_path / "out")).collect())
    expected = sorted(r["voxel_id"] for r in mask.mask(spark, G.prepare(strategy.vectors(spark), pool), grid, pool, melted=False).collect())
    assert got == expected and 0 < len(got) < grid.n_voxels


CONFIG = """
scan_paths: [scan.txt]
parameters: {{layer_height: 5.0e-5, voxel_resolution: 2.0e-5, enable_random_segment_phase: false}}
melt_pool_data:
  width: {{type: time_series, file_name: width.csv, nmodes: 5., scale: 1.0}}
  depth: {{type: time_series, file_name: width.csv, nmodes: 3., scale: 0.7, shape: 1.0}}
  height: {{type: spectral_components, file_name: height.csv, nmodes: 2, scale: 1.0, shape: 2.0}}
{rve}
output:
  vtk: {{file_name: out.vti}}
  morphology: {{file_name: out.csv, fields: [label, area, euler_number]}}
"""


def test_command_line(spark, tmp_path):
    (tmp_path / "scan.txt").write_text("Mode X Y Z Power t\n1 0 0 0 0 0\n0 .001 0 0 200 1.7\n1 0 .0003 0 0 0\n0 .001 .0003 0 200 1.7\n")
    t = np.arange(64) * 1e-5
    (tmp_path / "width.csv").write_text("\n".join(f"{a},{1e-4 + 1e-5 * math.sin(2 * math.pi * 4687.5 * a)}" for a in t))
    (tmp_path / "height.csv").write_text("6e-5,0,0\n1e-5,4687.5,0\n")
    path = tmp_path / "run.yaml"
    path.write_text(CONFIG.format(rve="rve: {min_point: [0.0002, -0.0001, -0.0002], max_point: [0.0008, 0.0004, 0.0001]}"))
    assert cli.main([str(path)], spark) == 0
    grid, field = read_vtk(str(tmp_path / "out.vti"))
    assert grid.shape == (31, 26, 16) and 0 < field.sum() < field.size
    rows = list(csv.DictReader(open(tmp_path / "out.csv")))
    assert rows and sum(float(r["area"]) for r in rows) <= field.sum() * 8e-15 * 1.0001
    path.write_text(CONFIG.format(rve=""))  # without a box, the grid covers the vectors
    assert cli.main([str(path)], spark) == 0 and read_vtk(str(tmp_path / "out.vti"))[0].shape == (51, 16, 1)


@pytest.mark.parametrize("text", ["scan_paths: [a", "parameters: {}", "parameters: {voxel_resolution: 1.0}\nscan_paths: [none.txt]\nrve: {min_point: [0,0,0], max_point: [1,1,1]}"])
def test_command_line_errors(spark, tmp_path, text):
    (tmp_path / "bad.yaml").write_text(text)
    assert cli.main([str(tmp_path / "bad.yaml")], spark) == 1
    assert cli.main([str(tmp_path / "missing.yaml")], spark) == 1


def test_entry_and_oracle(spark):
    assert __spark_entry__.entry(spark).count() > 0
    names = __spark_entry__.queries()
    assert set(__spark_entry__.oracle_sql()) <= set(names)
