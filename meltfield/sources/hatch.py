"""Generated scan strategies: parallel lines, rotated from layer to layer."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from meltfield.sources.scan import LEAST_SPEED


@dataclass(frozen=True)
class ScanStrategy:
    """Process parameters of a hatch over ``bound_box``; ``rotation`` in degrees."""

    bound_box: tuple
    power: float
    scan_speed: float
    hatch_spacing: float
    layer_height: float
    rotation: float
    scan_extension: float
    extra_layers: int = 0

    @property
    def low(self):
        return tuple(float(v) for v in self.bound_box[0])

    @property
    def high(self):
        return tuple(float(v) for v in self.bound_box[1])

    @property
    def last_layer(self) -> int:
        """Layers run from 0 to this one; floor division of floats, as the number of layers was always counted."""
        return int((self.high[2] - self.low[2]) // self.layer_height + 1 + self.extra_layers)

    @property
    def first_line(self) -> float:
        return self.low[1] - self.scan_extension

    @property
    def line_step(self) -> float:
        return (self.first_line + self.hatch_spacing) - self.first_line

    @property
    def lines(self) -> int:
        return max(0, math.ceil(((self.high[1] + self.scan_extension) - self.first_line) / self.hatch_spacing))

    def hatch(self, spark: SparkSession) -> DataFrame:
        """``hatch`` rows ``(layer, line, sx, sy, ex, ey, z)``: one range, no join."""
        m = max(self.lines, 1)
        n = (self.last_layer + 1) * self.lines
        rows = spark.range(n).select(F.expr(f"cast(id div {m} as int)").alias("layer"), F.expr(f"cast(id % {m} as int)").alias("line"))
        cx, cy = ((l + h) / 2 for l, h in zip(self.low[:2], self.high[:2]))
        y = F.lit(self.first_line) + F.col("line") * F.lit(self.line_step)
        angle = F.col("layer") * F.lit(math.radians(self.rotation))
        ends = {"s": F.lit(self.low[0] - self.scan_extension), "e": F.lit(self.high[0] + self.scan_extension)}
        out = rows
        for end, x in ends.items():
            rx, ry = rotate(x - cx, y - cy, angle)
            base = F.col("layer") == 0  # layer 0 is not turned, not even by the identity
            out = out.withColumns({f"{end}x": F.when(base, x).otherwise(rx + cx), f"{end}y": F.when(base, y).otherwise(ry + cy)})
        return out.withColumn("z", F.col("layer") * F.lit(float(self.layer_height))).select("layer", "line", "sx", "sy", "ex", "ey", "z")

    def vectors(self, spark: SparkSession) -> DataFrame:
        """``scan_vector`` rows with the schedule in closed form.

        Lines of a layer follow one another; a layer starts when the last line of the layer before it starts.
        """
        duration = ((self.high[0] + self.scan_extension) - (self.low[0] - self.scan_extension)) / self.scan_speed if self.scan_speed > LEAST_SPEED else 0.0
        m = self.lines
        place = F.col("layer") * F.lit(max(m - 1, 0)) + F.col("line")
        return self.hatch(spark).select(
            (F.col("layer").cast("long") * m + F.col("line")).alias("vector_id"), "layer", "sx", "sy", F.col("z").alias("sz"), "ex", "ey", F.col("z").alias("ez"),
            (place * F.lit(duration)).alias("t0"), ((place + 1) * F.lit(duration)).alias("t1"),
        )

    def export_rows(self, spark: SparkSession) -> DataFrame:
        """Text rows of the export: a jump to the start and a raster move to the end of each line."""
        h = self.hatch(spark)
        jump = F.struct(F.lit(0).alias("part"), F.lit(1).alias("mode"), F.col("sx").alias("x"), F.col("sy").alias("y"), F.lit(0.0).alias("power"), F.lit(0.0).alias("param"))
        move = F.struct(F.lit(1).alias("part"), F.lit(0).alias("mode"), F.col("ex").alias("x"), F.col("ey").alias("y"), F.lit(float(self.power)).alias("power"), F.lit(float(self.scan_speed)).alias("param"))
        rows = h.select("layer", "line", "z", F.explode(F.array(jump, move)).alias("r")).select("layer", "line", "r.part", "r.mode", "r.x", "r.y", "z", "r.power", "r.param")
        return rows.withColumn("text", F.format_string("%d %.6f %.6f %.6f %.6f %.6f", "mode", "x", "y", "z", "power", "param"))


def rotate(x: Column, y: Column, angle: Column) -> tuple[Column, Column]:
    """A point turned about the origin."""
    return F.cos(angle) * x - F.sin(angle) * y, F.sin(angle) * x + F.cos(angle) * y


def create_path_vectors(spark: SparkSession, bound_box, power, scan_speed, hatch_spacing, layer_height, rotation, scan_extension, extra_layers) -> DataFrame:
    """Vectors of a strategy in one call."""
    return ScanStrategy(bound_box, power, scan_speed, hatch_spacing, layer_height, rotation, scan_extension, extra_layers).vectors(spark)


class ScanPathBuilder:
    """Two-step use of a strategy: ``generate_layers``, then ``process_vectors`` or ``write_layers``."""

    def __init__(self, bound_box, power, scan_speed, hatch_spacing, layer_height, rotation, scan_extension, extra_layers):
        self.strategy = ScanStrategy(bound_box, power, scan_speed, hatch_spacing, layer_height, rotation, scan_extension, extra_layers)
        self.layers: DataFrame | None = None

    def generate_layers(self, spark: SparkSession | None = None) -> DataFrame:
        self.layers = self.strategy.hatch(spark or SparkSession.getActiveSession())
        return self.layers

    def process_vectors(self, spark: SparkSession | None = None) -> DataFrame:
        return self.strategy.vectors(spark or SparkSession.getActiveSession())

    def write_layers(self, output_name: str, mode: str = "layers", spark: SparkSession | None = None) -> list[str]:
        from meltfield.sinks.text import write_layers

        return write_layers(self.strategy, spark or SparkSession.getActiveSession(), output_name, mode)
