"""Text sinks: scan files and the morphology table."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Fixed value: the header of a scan file.
SCAN_HEADER = "Mode X(m) Y(m) Z(m) Power(W) tParam"


def write_layers(strategy, spark: SparkSession, output_name: str, mode: str = "layers") -> list[str]:
    """Scan files of a strategy: ``{name}_layer_{k}.txt`` for each layer, or ``{name}.txt`` for all.

    Rows are streamed to the driver in order, one partition at a time, because a scan file is one file.
    """
    if mode not in ("layers", "all"):
        raise ValueError("mode is 'layers' or 'all'")
    rows = strategy.export_rows(spark).orderBy("layer", "line", "part").select("layer", "text")
    written, handle, current = [], None, None
    try:
        for r in rows.toLocalIterator():
            key = r["layer"] if mode == "layers" else "all"
            if key != current:
                if handle:
                    handle.close()
                current = key
                written.append(f"{output_name}_layer_{key}.txt" if mode == "layers" else f"{output_name}.txt")
                handle = open(written[-1], "w")
                handle.write(SCAN_HEADER + "\n")
            handle.write(r["text"] + "\n")
    finally:
        if handle:
            handle.close()
    return written


def write_layer_folder(strategy, spark: SparkSession, folder: str) -> None:
    """The same rows as a distributed text table, a folder for each layer, for strategies beyond one machine."""
    rows = strategy.export_rows(spark)
    rows.repartition("layer").sortWithinPartitions("layer", "line", "part").select("layer", F.col("text").alias("value")).write.mode("overwrite").partitionBy("layer").text(folder)


def write_morphology(table: DataFrame, path: str) -> int:
    """A CSV file with a header from a region table (one row a pore); returns the number of rows."""
    from pyspark.sql.types import ArrayType, MapType, StructType

    flat = [F.to_json(c).alias(c) if isinstance(table.schema[c].dataType, (ArrayType, MapType, StructType)) else F.col(f"`{c}`") for c in table.columns]
    columns, n = table.columns, 0
    os.makedirs(os.path.dirname(os.path.abspath(path)), exist_ok=True)
    import csv

    with open(path, "w", newline="") as f:
        out = csv.writer(f)
        out.writerow(columns)
        ordered = table.select(*flat).orderBy("label") if "label" in columns else table.select(*flat)
        for r in ordered.toLocalIterator():
            out.writerow(list(r))
            n += 1
    return n


def write_morphology_folder(table: DataFrame, folder: str) -> None:
    """The same table as a distributed CSV folder."""
    table.write.mode("overwrite").option("header", True).csv(folder)
