"""SimHash near-duplicates through an inverted index on byte positions with count filtering.

A fingerprint has eight positional bytes.  Two fingerprints that differ in at most two bits differ in at
most two bytes, so they share at least six positional bytes: that is the guaranteed minimum of the
count filter.  Bytes are posted in four position pairs; at most two pairs are hit by the differing
bytes, so every link shares two whole pairs and meets under one of the six pair-of-pairs keys (four
bytes of the fingerprint).  Under a key, whatever its size, shared positional bytes are tallied by sorting: for each choice of two of the
four bytes outside the key, members that agree in the other six stand together.  Only such pairs, the ones that reach the minimum,
are formed, and they are verified by the exact number of differing bits.

Scale: rows with equal fingerprints are one class from the start (a partial aggregate), so only distinct
fingerprints are posted.  Members that agree in six bytes differ in sixteen bits at most, so a run of them looks up the 136 ways to
differ in one or two of these bits if it is longer than that.  Links of each batch are reduced to a
spanning forest, so the edge table is linear in the postings, and components come from
the checkpointed star iteration.

Defined results: a text without words, a null or an empty one has fingerprint zero and is linked like any
other; equal texts fall into one class; a null doc_id counts as larger than any other (its component_id is null only
if no document of its component has an id); repeated rows each return a row; extra columns are not read.
"""

from __future__ import annotations

import uuid
from functools import partial

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from meltfield.llm._batches import map_text, written
from meltfield.operators.components import connected_components, ensure_checkpoint_dir, smallest_reachable

#: Words in a shingle, seed of the shingle hash, greatest number of differing bits of a link.
SHINGLE, SEED, MAX_BITS = 3, 42, 2
#: Row numbers (a long each) up to which the rows that go are broadcast; more are shuffled with the texts.
BROADCAST_ROWS = 1_000_000
#: A fingerprint with more than this part of all rows is joined apart.
HOT = 1000

_hash = partial(xxhash.xxh64_intdigest, seed=SEED)
#: Position pairs, and the six choices of two of them.
PAIRS = [(0, 1), (2, 3), (4, 5), (6, 7)]
KEYS = [(a, b) for a in range(4) for b in range(a + 1, 4)]


def shingle_hashes(text: bytes) -> np.ndarray:
    """XXH64 of each word shingle of a text, repeats included; of the whole sequence if it has fewer words; none without words."""
    words = text.lower().split()  # of bytes: A-Z only, and exactly the six ASCII white space characters
    n = len(words)
    if n == 0:
        return np.zeros(0, np.uint64)
    joined = b" ".join(words)
    if n <= SHINGLE:
        return np.array([_hash(joined)], np.uint64)
    size = np.fromiter(map(len, words), np.int64, n) + 1
    ends = np.cumsum(size) - 1
    starts = (ends - size + 1).tolist()
    return np.array([_hash(joined[a:b]) for a, b in zip(starts, ends[SHINGLE - 1 :].tolist())], np.uint64)


def fingerprint(hashes: np.ndarray) -> int:
    """Bit i is set if it is set in more than half of the hashes."""
    n, ones = len(hashes), np.zeros(64, np.int64)
    for at in range(0, n, 1 << 16):
        block = hashes[at : at + (1 << 16)].astype("<u8").view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(block, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > n, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", row: str | None = None) -> DataFrame:
    """``(doc_id, fp LONG)`` of every whole text; ``fp`` holds the 64 bits.  With a column ``row`` also ``(text_hash LONG, row LONG)``."""
    also = ["text_hash", "row"] if row else []

    def run(piece: pa.RecordBatch) -> dict:
        fps = [fingerprint(shingle_hashes(t or b"")) for t in piece.column("text").cast(pa.binary()).to_pylist()]
        return {"doc_id": piece.column("doc_id"), "fp": pa.array(np.array(fps, np.uint64).view(np.int64))} | {c: piece.column(c) for c in also}

    kind = docs.select(doc_id).schema[0].dataType.simpleString()
    given = [F.col(doc_id).alias("doc_id"), F.col(text).alias("text")] + ([F.xxhash64(text).alias("text_hash"), F.col(row).alias("row")] if row else [])
    return map_text(docs.select(*given), "text", run, ", ".join([f"doc_id {kind}", "fp long", *(f"{c} long" for c in also)]))


def postings(fps: DataFrame) -> DataFrame:
    """The inverted index: for each distinct fingerprint six rows ``(k, v, fp)``, the choice of position pairs and their four bytes."""
    fp = F.col("fp")

    def pair(i):
        return F.shiftrightunsigned(fp, 16 * i).bitwiseAND(F.lit(0xFFFF))

    keys = [F.struct(F.lit(k).alias("k"), F.shiftleft(pair(a), 16).bitwiseOR(pair(b)).alias("v")) for k, (a, b) in enumerate(KEYS)]
    return fps.select("fp", F.explode(F.array(*keys)).alias("p")).select("p.k", "p.v", "fp")


#: Bytes of a fingerprint, as masks.
_BYTES = [np.uint64(0xFF << (8 * i)) for i in range(8)]


def free_masks(key: int) -> list[np.uint64]:
    """For a choice of position pairs, the masks of two bytes outside it: links under the key agree in all but one of these."""
    outside = [2 * p + i for p in range(4) if p not in KEYS[key] for i in (0, 1)]
    return [_BYTES[a] | _BYTES[b] for x, a in enumerate(outside) for b in outside[x + 1 :]]


def key_links(members: np.ndarray, key: int) -> tuple[np.ndarray, np.ndarray]:
    """Links among the distinct fingerprints posted under one choice of position pairs, whatever their values there."""
    found = [(members[:0], members[:0])]
    for free in free_masks(key):
        six = members & ~free
        order = np.lexsort((members, six))
        m, six = members[order], six[order]
        # a run agrees in six positional bytes, the minimum of the count filter
        start = np.flatnonzero(np.concatenate([[True], six[1:] != six[:-1]]))
        size = np.diff(np.append(start, len(m)))
        bits = [np.uint64(1 << i) for i in range(64) if int(free) >> i & 1]
        ways = [x | y for i, x in enumerate(bits) for y in bits[i:]]
        longest = np.repeat(size, size)
        short = m[longest <= len(ways)], six[longest <= len(ways)]
        for d in range(1, int(min(size.max(initial=0), len(ways)))):
            a, b = short[0][:-d], short[0][d:]
            near = np.flatnonzero((short[1][:-d] == short[1][d:]) & (np.bitwise_count(a ^ b) <= MAX_BITS))
            found.append((a[near], b[near]))
        if len(long := np.sort(m[longest > len(ways)])):
            for way in ways:
                other = long ^ way
                at = np.minimum(np.searchsorted(long, other), len(long) - 1)
                hit = np.flatnonzero((long[at] == other) & (long < other))
                found.append((long[hit], other[hit]))
                if len(found) > 64:
                    found = [_forest(*map(np.concatenate, zip(*found)))]
    return _forest(*map(np.concatenate, zip(*found)))


def _forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Edges from the smallest fingerprint of each component to its others."""
    nodes, place = np.unique(np.concatenate([a, b]), return_inverse=True)
    root = smallest_reachable(len(nodes), place[: len(a)], place[len(a) :])
    other = np.flatnonzero(root != np.arange(len(nodes)))
    return nodes[root[other]], nodes[other]


def links(fps: DataFrame) -> DataFrame:
    """Edges ``(a, b)`` between distinct fingerprints that differ in at most two bits; within each batch of keys a spanning forest of them."""
    spark = fps.sparkSession
    spread = postings(fps).repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "k", "v").sortWithinPartitions("k", "v", "fp")

    def run(batches):
        def flush(k, v, f):
            out = [key_links(f[k == key], key) for key in np.unique(k)]
            a, b = (np.concatenate(x).view(np.int64) for x in zip(*out))
            if len(a):
                return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])

        hold = [np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64)]
        for batch in batches:
            if not batch.num_rows:
                continue
            k, v, f = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("k", "v", "fp"))
            hold = [np.concatenate([h, x]) for h, x in zip(hold, (k.astype(np.int64), v, f.view(np.uint64)))]
            k, v, f = hold
            # the last key may go on in the next batch
            open_ = int(np.flatnonzero((k != k[-1]) | (v != v[-1]))[-1]) + 1 if (k[0], v[0]) != (k[-1], v[-1]) else 0
            if open_ and (out := flush(k[:open_], v[:open_], f[:open_])) is not None:
                yield out
            hold = [k[open_:], v[open_:], f[open_:]]
        if len(hold[0]) and (out := flush(*hold)) is not None:
            yield out

    return spread.mapInArrow(run, "a long, b long")


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``(doc_id, fp LONG, component_id)`` for every row of ``docs``.

    ``component_id`` is the smallest doc_id among the documents reachable over links, the row itself included.
    """
    spark = docs.sparkSession
    ensure_checkpoint_dir(spark)
    rows = fingerprints(docs, doc_id, text).checkpoint()
    classes = rows.groupBy("fp").agg(F.min("doc_id").alias("low"), F.count("*").alias("n")).checkpoint()
    roots = connected_components(links(classes.select("fp")))
    component = (
        classes.join(roots, F.col("fp") == F.col("node"))
        .groupBy("root").agg(F.min("low").alias("component_low"))
        .join(roots, "root").select("node", "component_low")
    )
    settled = classes.join(component, F.col("fp") == F.col("node"), "left").select(F.col("fp").alias("class_fp"), "n", F.coalesce("component_low", "low").alias("component_id")).checkpoint()
    # a fingerprint with more than 1 / HOT of all rows: there are fewer than HOT of them, so they are broadcast, and no task gets all their rows
    hot = settled.where(F.col("n") > rows.count() / HOT)
    few = F.broadcast(hot.select(F.col("class_fp").alias("hot_fp"), F.col("component_id").alias("hot_component")))
    marked = rows.join(few, F.col("fp") == F.col("hot_fp"), "left")
    rest = marked.where("hot_fp is null").join(settled, F.col("fp") == F.col("class_fp")).select("doc_id", "fp", "component_id")
    return rest.union(marked.where("hot_fp is not null").select("doc_id", "fp", F.col("hot_component").alias("component_id")))


def survivors(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row of each component, all columns: the smallest by (doc_id, hash of the text, row number), null ids last.

    Rows are told apart by a number that is written with them, so neither a repeated nor a null id keeps or drops another row.
    """
    row = f"row_{uuid.uuid4().hex}"
    numbered = written(docs.withColumn(row, F.monotonically_increasing_id()), "numbered")
    rows = fingerprints(numbered, doc_id, text, row).checkpoint()
    place = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "text_hash", "row")
    classes = rows.groupBy("fp").agg(F.min(place).alias("low")).checkpoint()
    roots = connected_components(links(classes.select("fp")))
    # both minima are combined before the shuffle: a group with very many rows or fingerprints is not dealt to one task
    component = classes.join(roots, F.col("fp") == F.col("node"), "left").groupBy(F.coalesce("root", "fp").alias("component")).agg(F.min("low").alias("low"))
    kept = component.select(F.col("low.row").alias("kept_row"))
    gone = written(rows.select(F.col("row").alias("gone_row")).join(kept, F.col("gone_row") == F.col("kept_row"), "left_anti"), "gone")
    few = F.broadcast(gone) if gone.count() <= BROADCAST_ROWS else gone
    return numbered.join(few, numbered[row] == few["gone_row"], "left_anti").drop(row)


def digest(found: DataFrame) -> DataFrame:
    """The query's columns from the operator's output."""
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
