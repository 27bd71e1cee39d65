"""Arrow batch plumbing shared by the text operators."""

from __future__ import annotations

import pickle
import uuid
import zlib
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from meltfield.operators.components import ensure_checkpoint_dir

#: Text bytes handled at once; a longer single text is a chunk of its own.
CHUNK_BYTES = 4 << 20


def chunks(batches: Iterable[pa.RecordBatch], text: str, limit: int = CHUNK_BYTES) -> Iterator[pa.RecordBatch]:
    """The batches again, cut so that each piece holds about ``limit`` bytes of column ``text``."""
    for batch in batches:
        if not batch.num_rows:
            continue
        size = pc.fill_null(pc.binary_length(batch.column(text)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        piece = (np.cumsum(size) - size) // limit
        cuts = [0, *(np.flatnonzero(np.diff(piece)) + 1).tolist(), batch.num_rows]
        for a, b in zip(cuts, cuts[1:]):
            yield batch.slice(a, b - a)


def map_text(df: DataFrame, text: str, fn: Callable[[pa.RecordBatch], dict], schema: str, limit: int = CHUNK_BYTES) -> DataFrame:
    """``mapInArrow`` with ``fn`` from a bounded piece to columns named as in ``schema``."""
    names = [part.split()[0] for part in _split_schema(schema)]

    def run(batches):
        for piece in chunks(batches, text, limit):
            out = fn(piece)
            yield pa.RecordBatch.from_arrays([out[n] if isinstance(out[n], pa.Array) else pa.array(out[n]) for n in names], names)

    return df.mapInArrow(run, schema)


def _split_schema(schema: str) -> list[str]:
    parts, depth, last = [], 0, 0
    for i, c in enumerate(schema):
        depth += (c == "<") - (c == ">")
        if c == "," and not depth:
            parts.append(schema[last:i].strip())
            last = i + 1
    return [*parts, schema[last:].strip()]


def first_by_hash(df: DataFrame, n: int, salt: int = 17) -> DataFrame:
    """The ``n`` rows of ``df`` with the smallest hashes of all their columns, in that order; repeated rows count once."""
    own = f"hash_{uuid.uuid4().hex}"
    return df.withColumn(own, F.xxhash64(*(F.col(c).cast("string") for c in df.columns), F.lit(salt))).dropDuplicates([own]).orderBy(own).limit(n).drop(own)


def bounded_sample(df: DataFrame, n: int, salt: int = 17) -> DataFrame:
    """At most ``n`` rows of ``df``, chosen by a hash of all their columns alone; repeated rows count once."""
    total = df.count()
    if total > n:  # a quarter more than is needed passes the filter
        below = int(1.25 * n / total * (1 << 40)) + 1
        df = df.where(F.pmod(F.xxhash64(F.lit(salt + 1), *(F.col(c).cast("string") for c in df.columns)), F.lit(1 << 40)) < F.lit(below))
    return first_by_hash(df, n, salt)


def learn(sample: DataFrame, text: str, learner: Callable):
    """What a learner (``add`` for pieces of rows, then ``model``) makes of a bounded sample.

    One task streams over the sample, so texts of any length are held a piece at a time, and only the model reaches the driver.
    """

    def run(batches):
        one = learner()
        for piece in chunks(batches, text):
            one.add(piece)
        yield pa.RecordBatch.from_arrays([pa.array([zlib.compress(pickle.dumps(one.model()), 1)], pa.binary())], ["model"])

    rows = sample.coalesce(1).mapInArrow(run, "model binary").collect()
    return pickle.loads(zlib.decompress(rows[0]["model"])) if rows else learner().model()


def crc32_of_id(doc_id) -> int:
    return zlib.crc32(str(doc_id).encode())


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """A string column, nulls empty, as one byte array and the n + 1 offsets of its rows."""
    column = pc.fill_null(column, "")
    if pa.types.is_string(column.type):
        column = column.cast(pa.large_string())
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[offsets[0] : offsets[-1]], offsets - offsets[0]


#: Drops the shuffle files of an execution when it ends.
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def _path(spark, path: str):
    path = spark._jvm.org.apache.hadoop.fs.Path(path)
    return path.getFileSystem(spark._jsc.hadoopConfiguration()), path


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` written as Parquet into the shared checkpoint folder and reread: its lineage ends there, and so do its shuffle files.

    The table goes with ``discard``, or when the driver ends.
    """
    spark = df.sparkSession
    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    before = spark.conf.get(_CLEANUP, "false")
    spark.conf.set(_CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(_CLEANUP, before)
    system, place = _path(spark, path)
    system.deleteOnExit(place)
    out = spark.read.schema(df.schema).parquet(path)
    out.written_path = path
    return out


def discard(df: DataFrame) -> None:
    """Deletes a table that ``written`` made, once nothing reads it any more."""
    system, place = _path(df.sparkSession, df.written_path)
    system.delete(place, True)


def table_bytes(df: DataFrame, text: str) -> int:
    """Bytes of a plan's tables if the optimizer knows them, else those of column ``text``."""
    known = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return known if known < 1 << 60 else df.agg(F.coalesce(F.sum(F.octet_length(text)), F.lit(0))).first()[0]
