"""Scan-path text files: rows, timeline, raster vectors."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from meltfield.sources.lines import numbered_lines

#: A raster parameter (speed) up to this takes no time.
LEAST_SPEED = 1e-12


def scan_rows(spark: SparkSession, paths: list[str] | str) -> DataFrame:
    """``scan_row`` from white-space separated files: the header line is skipped, rows under six tokens are dropped.

    ``file_id`` is the place of the file in the list, so files keep their order; ``seq`` is the line. Missing local files raise.
    """
    paths = [paths] if isinstance(paths, str) else list(paths)
    if not paths:
        return spark.createDataFrame([], "file_id string, seq long, mode int, x double, y double, z double, power double, param double")
    lines = numbered_lines(spark, paths).where("seq > 0")
    parts = lines.select("file_id", "seq", F.split(F.trim(F.regexp_replace("line", r"\s+", " ")), " ").alias("p")).where("size(p) >= 6")
    p = F.col("p")
    return parts.select(
        "file_id", "seq", p[0].cast("double").cast("int").alias("mode"),
        *[p[i].cast("double").alias(c) for i, c in enumerate(("x", "y", "z", "power", "param"), 1)],
    )


def timeline(rows: DataFrame) -> DataFrame:
    """Adds the time a row takes (``dt``), the time it ends (``t1``), and the previous row's place and time.

    A row of mode 1 takes its parameter; any other one its length over its parameter (the speed), except the first row of a file.
    """
    w = Window.partitionBy("file_id").orderBy("seq")
    c = F.col
    prev = rows.withColumns({f"p{a}": F.lag(a).over(w) for a in "xyz"})
    gap = [c(a) - c(f"p{a}") for a in "xyz"]
    length = F.sqrt(gap[0] * gap[0] + gap[1] * gap[1] + gap[2] * gap[2])
    dt = F.when(c("mode") == 1, c("param")).when(c("px").isNull(), 0.0).when(c("param") > LEAST_SPEED, length / F.when(c("param") > LEAST_SPEED, c("param")).otherwise(1.0)).otherwise(0.0)
    timed = prev.withColumn("dt", dt).withColumn("t1", F.sum("dt").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return timed.withColumn("t0", F.lag("t1").over(w))


def raster_vectors(timed: DataFrame) -> DataFrame:
    """Rows of mode 0 with a predecessor, as vectors from its place and time to theirs."""
    v = timed.where((F.col("mode") == 0) & F.col("px").isNotNull())
    return v.select("file_id", "seq", F.col("px").alias("sx"), F.col("py").alias("sy"), F.col("pz").alias("sz"), F.col("x").alias("ex"), F.col("y").alias("ey"), F.col("z").alias("ez"), "t0", "t1")


def numbered(vectors: DataFrame) -> DataFrame:
    """``scan_vector`` rows; the id packs the file's place and the line, so it needs no global sort."""
    number = F.col("file_id").cast("long") * F.lit(1 << 40) + F.col("seq")
    return vectors.select(number.alias("vector_id"), F.lit(None).cast("int").alias("layer"), "sx", "sy", "sz", "ex", "ey", "ez", "t0", "t1")


def read_scan_path(spark: SparkSession, paths: list[str] | str) -> DataFrame:
    """Scan vectors of one or more files; times start at 0 in each file."""
    return numbered(raster_vectors(timeline(scan_rows(spark, paths))))
