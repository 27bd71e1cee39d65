"""Connected components of an edge table by alternating large-star and small-star steps.

A graph of up to ``SMALL`` distinct edges, which are counted first, is contracted by one executor task in memory.  Beyond, each round is two grouped minima and two joins back, so a hub with very many neighbours is
pre-aggregated map-side and its join side can be split by adaptive skew handling.  The edge
table is cut with ``checkpoint()`` every round: its files live in the shared checkpoint
folder and survive the loss of any executor.
"""

from __future__ import annotations

import tempfile

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Edges (two 64-bit numbers each) that one task contracts.
SMALL = 2_000_000


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The session's checkpoint folder; a private one is made only where none is configured (tests, local runs)."""
    sc = spark.sparkContext
    current = sc._jsc.sc().getCheckpointDir()
    if current.isDefined():
        return current.get()
    configured = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
    if not configured and not sc.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all machines share")
    sc.setCheckpointDir(configured or tempfile.mkdtemp(prefix="meltfield-checkpoint-"))
    return sc._jsc.sc().getCheckpointDir().get()


def smallest_reachable(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """For each of ``n`` nodes the smallest node of its component, from edges between nodes."""
    root = np.arange(n)
    while len(a):
        ra, rb = root[a], root[b]
        live = ra != rb
        if not live.any():
            break
        a, b, ra, rb = a[live], b[live], ra[live], rb[live]
        np.minimum.at(root, np.maximum(ra, rb), np.minimum(ra, rb))
        while (root[root] != root).any():
            root = root[root]
    return root


def _contracted(edges: DataFrame) -> DataFrame:
    """``(node, root)`` of a counted, small edge table, in one task."""
    kind = edges.schema["a"].dataType.simpleString()

    def run(batches):
        parts = [(x.column("a").to_numpy(), x.column("b").to_numpy()) for x in batches if x.num_rows]
        if parts:
            a, b = (np.concatenate(x) for x in zip(*parts))
            nodes, place = np.unique(np.concatenate([a, b]), return_inverse=True)
            roots = nodes[smallest_reachable(len(nodes), place[: len(a)], place[len(a) :])]
            for at in range(0, len(nodes), 1 << 16):
                yield pa.RecordBatch.from_arrays([pa.array(nodes[at : at + (1 << 16)]), pa.array(roots[at : at + (1 << 16)])], ["node", "root"])

    return edges.select("a", "b").coalesce(1).mapInArrow(run, f"node {kind}, root {kind}").checkpoint()


def _signature(edges: DataFrame):
    return edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()


def connected_components(edges: DataFrame, max_rounds: int = 64) -> DataFrame:
    """Components of the undirected graph with edges ``(a, b)``.

    Returns ``(node, root)`` for every node that has an edge to another node, ``root`` the smallest
    node of its component.  Null ends and self-loops are ignored; repeated edges count once; an
    empty edge table gives an empty result.
    """
    spark = edges.sparkSession
    ensure_checkpoint_dir(spark)
    e = (
        edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        .where("a is not null and b is not null and a <> b")
        .distinct()
        .checkpoint()
    )
    before = _signature(e)
    if before[0] <= SMALL and e.schema["a"].dataType.simpleString() in ("bigint", "int"):
        return _contracted(e)
    for _ in range(max_rounds):
        both = e.union(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("u"), F.least("a", "m").alias("m"))
        # large star: every larger neighbour of u is linked to the smallest of u and its neighbours
        large = (
            both.where("b > a").join(low, F.col("a") == F.col("u"))
            .select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        )
        low2 = large.groupBy("a").agg(F.min("b").alias("m")).withColumnRenamed("a", "u")
        # small star: every smaller neighbour of u, and u itself, is linked to the smallest of them
        small = (
            large.join(low2, F.col("a") == F.col("u"))
            .select(F.explode(F.array("a", "b")).alias("a"), F.col("m").alias("b"))
            .where("a <> b").distinct().checkpoint()
        )
        e, now = small, _signature(small)
        if now == before:
            break
        before = now
    else:
        raise RuntimeError("connected_components did not settle")
    roots = e.groupBy("a").agg(F.min("b").alias("root")).withColumnRenamed("a", "node")
    return roots.union(e.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
