"""Numbered lines of text files, read in splits."""

from __future__ import annotations

import os
import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def numbered_lines(spark: SparkSession, paths: list[str]) -> DataFrame:
    """``(file_id, seq, line)``: ``file_id`` is the place of the file in the list, ``seq`` counts the lines of a file from 0.

    One scan reads all files; a large one is cut into splits, and the offset of a split with the order of the rows in it
    gives the order of the lines.  A path that is listed twice is two files.  Missing local files raise.
    """
    places = []
    for n, path in enumerate(paths):
        if not re.match("[A-Za-z][A-Za-z0-9+.-]*:/", path) and not os.path.exists(path):
            raise FileNotFoundError(path)
        at = spark._jvm.org.apache.hadoop.fs.Path(path)
        places.append((_plain(at.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(at).toUri().toString()), f"{n:06d}"))
    lines = spark.read.text(sorted(set(paths))).select("value", F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("start"), F.monotonically_increasing_id().alias("row"))
    w = Window.partitionBy("path").orderBy("start", "row")
    ordered = lines.select(F.regexp_replace("path", "^file:/+", "file:/").alias("path"), (F.row_number().over(w) - 1).cast("long").alias("seq"), F.col("value").alias("line"))
    listed = F.broadcast(spark.createDataFrame(places, "listed string, file_id string"))  # a row a file
    return ordered.join(listed, (F.col("path") == F.col("listed")) | F.startswith(F.col("path"), F.concat("listed", F.lit("/")))).select("file_id", "seq", "line")


def _plain(uri: str) -> str:
    return "file:/" + uri[5:].lstrip("/") if uri.startswith("file:") else uri
