"""The melt mask as a stream of scan vectors.

A voxel is melted if any vector melts it, so the mask only grows: each micro-batch of vectors (a layer, say) adds the
tiles it melts, and the porosity so far is the complement of the union.  Results are appended as one folder for each batch and
written again under the same name if a batch is repeated, so a replay changes nothing.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from meltfield.functions import geometry
from meltfield.operators import mask
from meltfield.schema import SCAN_VECTOR, GridSpec, MeltPoolSpec


def vector_stream(spark: SparkSession, folder: str, files_each: int = 1) -> DataFrame:
    """A stream of ``scan_vector`` Parquet files."""
    return spark.readStream.schema(SCAN_VECTOR).option("maxFilesPerTrigger", files_each).parquet(folder)


def start(vectors: DataFrame, grid: GridSpec, pool: MeltPoolSpec, out: str, checkpoint: str):
    """A query that keeps ``out/batch=<id>`` with the melted tiles of each batch."""

    def each(batch: DataFrame, batch_id: int) -> None:
        melted = mask.melted_tiles(geometry.prepare(batch, pool), grid, pool)
        melted.write.mode("overwrite").parquet(f"{out}/batch={batch_id}")

    return vectors.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def porosity_so_far(spark: SparkSession, grid: GridSpec, pool: MeltPoolSpec, out: str) -> DataFrame:
    """Porous voxels ``(voxel_id, melted)`` after all batches so far."""
    tiles = spark.read.schema("tile long, parts array<binary>").option("basePath", out).parquet(out)
    merged = tiles.groupBy("tile").agg(F.flatten(F.collect_list("parts")).alias("parts"))
    every = spark.range(_tiles(grid)).withColumnRenamed("id", "every_tile")
    joined = every.join(merged, F.col("every_tile") == F.col("tile"), "left").select(F.col("every_tile").alias("tile"), "parts")
    return mask._tile_voxels(joined, grid, pool, False)


def _tiles(grid: GridSpec) -> int:
    n = 1
    for size in grid.shape:
        n *= -(-size // mask.TILE)
    return n
