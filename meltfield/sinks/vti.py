"""VTK XML image data: one byte a grid point, x fastest."""

from __future__ import annotations

import base64
import struct
import xml.etree.ElementTree as ET
import zlib

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from meltfield.schema import GridSpec

NAME = "porosity"


def vti_order(porous: DataFrame, grid: GridSpec) -> DataFrame:
    """Adds ``vti_index``, the place of a voxel in the file."""
    nx, ny, _ = grid.shape
    return porous.withColumn("vti_index", F.col("ix").cast("long") + F.lit(nx) * (F.col("iy") + F.lit(ny) * F.col("iz").cast("long")))


def slabs(porous: DataFrame, grid: GridSpec) -> DataFrame:
    """``(iz, bits BINARY)``: a packed plane of points for each z that has porous voxels, made on the executors."""
    nx, ny, _ = grid.shape
    size = nx * ny

    def run(pdf):
        import pandas as pd

        plane = np.zeros(size, np.uint8)
        plane[pdf["at"].to_numpy()] = 1
        return pd.DataFrame({"iz": [pdf["iz"].iloc[0]], "bits": [np.packbits(plane).tobytes()]})

    return porous.select("iz", (F.col("ix") + F.lit(nx) * F.col("iy")).alias("at")).groupBy("iz").applyInPandas(run, "iz int, bits binary")


def write_vtk(porous: DataFrame, grid: GridSpec, path: str) -> int:
    """Writes the field; returns the number of porous points.

    A VTI file is one file, so planes stream through the driver in z order, one partition at a time; the driver holds a
    plane, not the field.
    """
    nx, ny, nz = grid.shape
    extent = f"0 {nx - 1} 0 {ny - 1} 0 {nz - 1}"
    total = 0
    planes = slabs(porous, grid).orderBy("iz").toLocalIterator()
    ahead = next(planes, None)
    with open(path, "w") as f:
        f.write('<?xml version="1.0"?>\n<VTKFile type="ImageData" version="1.0" byte_order="LittleEndian" header_type="UInt64">\n')
        f.write(f'  <ImageData WholeExtent="{extent}" Origin="{" ".join(map(repr, grid.origin))}" Spacing="{" ".join([repr(grid.resolution)] * 3)}">\n')
        f.write(f'    <Piece Extent="{extent}">\n      <PointData Scalars="{NAME}">\n        <DataArray type="UInt8" Name="{NAME}" format="binary" RangeMin="0" RangeMax="1">\n          ')
        held = struct.pack("<Q", grid.n_voxels)  # number of bytes and bytes are one base64 unit
        for z in range(nz):
            plane = np.zeros(nx * ny, np.uint8)
            if ahead is not None and ahead["iz"] == z:
                plane = np.unpackbits(np.frombuffer(ahead["bits"], np.uint8), count=nx * ny)
                ahead = next(planes, None)
            total += int(plane.sum())
            held += plane.tobytes()
            whole = len(held) - len(held) % 3
            f.write(base64.b64encode(held[:whole]).decode())
            held = held[whole:]
        f.write(base64.b64encode(held).decode())
        f.write("\n        </DataArray>\n      </PointData>\n      <CellData>\n      </CellData>\n    </Piece>\n  </ImageData>\n</VTKFile>\n")
    return total


def read_vtk(path: str) -> tuple[GridSpec, np.ndarray]:
    """Grid and dense field ``[ix, iy, iz]`` of an image-data file with inline point data of bytes: ASCII, or base64 with or without deflated blocks."""
    root = ET.parse(path).getroot()
    image = root.find("ImageData")
    e = list(map(int, image.get("WholeExtent").split()))
    shape = tuple(e[2 * a + 1] - e[2 * a] + 1 for a in range(3))
    origin = tuple(map(float, image.get("Origin").split()))
    resolution = float(image.get("Spacing").split()[0])
    data = image.find("Piece/PointData/DataArray")
    if data.get("format") == "ascii":
        values = np.array(data.text.split(), np.uint8)
    elif data.get("format") == "binary":
        order = "<" if root.get("byte_order", "LittleEndian") == "LittleEndian" else ">"
        values = np.frombuffer(_inline("".join(data.text.split()), order + ("Q" if root.get("header_type") == "UInt64" else "I"), root.get("compressor")), np.uint8)
    else:
        raise ValueError(f"data of format {data.get('format')} is not supported")
    if data.get("type") not in ("UInt8", "Int8") or len(values) != shape[0] * shape[1] * shape[2]:
        raise ValueError("the file does not hold one byte a point")
    return GridSpec(resolution, origin, shape), values.reshape(shape[2], shape[1], shape[0]).transpose(2, 1, 0)


def _inline(text: str, word: str, compressor: str | None) -> bytes:
    """Bytes of an inline array; ``word`` is the format of the numbers in its head."""
    width = struct.calcsize(word)
    if not compressor:
        held = base64.b64decode(text)
        return held[width : width + struct.unpack_from(word, held)[0]]
    if compressor != "vtkZLibDataCompressor":
        raise ValueError(f"data compressed by {compressor} is not supported")
    # a unit with the number of blocks, their size, that of the last, and the deflated sizes; then a unit with the blocks
    (blocks,) = struct.unpack_from(word, base64.b64decode(text[: -(-width // 3) * 4]))
    head = -(-(3 + blocks) * width // 3) * 4
    sizes = [struct.unpack_from(word, base64.b64decode(text[:head]), width * (3 + i))[0] for i in range(blocks)]
    held, out, at = base64.b64decode(text[head:]), [], 0
    for size in sizes:
        out.append(zlib.decompress(held[at : at + size]))
        at += size
    return b"".join(out)


def read_vtk_table(spark: SparkSession, path: str) -> DataFrame:
    """Porous voxels of a file as a table."""
    from meltfield.operators.morphology import porous_from_field

    return porous_from_field(spark, read_vtk(path)[1])
