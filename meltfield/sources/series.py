"""Time series and spectra from comma-separated text."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from meltfield.sources.lines import numbered_lines


def read_data(spark: SparkSession, path: str, precision: str = "float64") -> DataFrame:
    """Rows ``(n, c0, c1[, c2])`` of a numeric file in file order; ``#`` starts a comment.

    ``precision="float32"`` rounds values to single precision on the way in.  A missing local file raises; a row
    width other than two or three raises ``ValueError`` when the table is used as a series or spectrum.
    """
    lines = numbered_lines(spark, [path])
    clean = lines.select(F.col("seq").alias("n"), F.trim(F.regexp_replace("line", "#.*|\r", "")).alias("line")).where("line <> ''")
    parts = clean.select(F.col("n").cast("long").alias("n"), F.split("line", r"\s*,\s*").alias("p"))
    width = parts.agg(F.max(F.size("p")).alias("w")).first()["w"] or 0
    kind = "float" if precision == "float32" else "double"
    return parts.select("n", *[F.col("p")[i].cast(kind).cast("double").alias(f"c{i}") for i in range(width)])


def kind_of(data: DataFrame) -> str:
    """``series`` of two columns or ``spectrum`` of three."""
    width = len([c for c in data.columns if c.startswith("c") and c[1:].isdigit()])
    if width == 2:
        return "series"
    if width == 3:
        return "spectrum"
    raise ValueError(f"a melt-pool table has two columns (time, value) or three (amplitude, frequency, phase), not {width}")


def as_series(data: DataFrame, series_id: str) -> DataFrame:
    """``series`` rows of a two-column table; ``n`` counts from 0."""
    from pyspark.sql.window import Window

    w = Window.partitionBy("series_id").orderBy("n")
    tagged = data.select(F.lit(series_id).alias("series_id"), "n", F.col("c0").alias("t"), F.col("c1").alias("value"))
    return tagged.select("series_id", (F.row_number().over(w) - 1).cast("long").alias("n"), "t", "value")
