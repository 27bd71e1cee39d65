"""Removal of repeated passages by difference-cover anchors.

A window is ``WINDOW`` consecutive words of one document.  With the difference cover ``COVER`` modulo ``PERIOD``
(every residue is a difference of two of its members), two equal windows that start at any two places have an
offset below ``PERIOD`` at which both meet a cover position; from there ``ANCHOR`` words still lie inside
the window.  So only anchors at cover positions are hashed and shuffled, four in thirteen positions, and any
repeated window shares an aligned anchor with every other occurrence.

1. Anchors that occur more than once are found: each task combines equal anchors of its own chunk first, so a
   passage that a third of all documents share reaches the shuffle once a chunk, not once a document.
2. Repeated anchors extend to all windows that contain them; these windows are compared by 64 and 32 bits from two
   independent kinds of word hashes, again
   combined by chunk, and every occurrence but the first in the order of (doc_id, start) is a repeat.
3. Words covered by a repeated window go.

Hashes travel in buckets as packed arrays, a row for each chunk and bucket, so a window costs about a dozen bytes of shuffle.
The numbers of buckets and partitions grow with the input, so neither a bucket nor a task does.
Both intermediate results are written to the shared checkpoint folder, which also bounds the shuffle files held
at one time.

Defined results: null and empty texts have no words; a null doc_id counts as the largest id; rows that repeat both doc_id
and text count as one document and get the same answer; rows that repeat a doc_id with another text are
documents of their own (an id that is no whole number raises), told apart and ordered by a 64-bit hash of the text; texts under ``WINDOW`` words stay whole; very long texts are hashed in bounded blocks;
extra columns are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from meltfield.llm import _words
from meltfield.llm._batches import chunks, discard, table_bytes, utf8, written

#: Words in a window; period and difference cover; words in an anchor.
WINDOW, PERIOD, COVER = 20, 13, (0, 1, 3, 9)
ANCHOR = WINDOW - PERIOD + 1
#: Hashes that a task combines before it sends them on; known positions in one row; input bytes for which there are a bucket and a partition.
COMBINE, KNOWN, BUCKET_BYTES, PARTITION_BYTES = 1 << 20, 1 << 15, 16 << 20, 128 << 20

_NO_ID = (1 << 63) - 1
_KEY = ("k", "variant")

_IN_COVER = np.zeros(PERIOD, bool)
_IN_COVER[list(COVER)] = True


def _keyed(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    """Document key, 64-bit hash of the text where keys repeat (no such column if they do not), text."""
    key = F.coalesce(F.col(doc_id).cast("long"), F.lit(_NO_ID)).alias("k")
    unique = docs.select(key).groupBy("k").count().where("count > 1").limit(1).count() == 0
    variant = [] if unique else [F.xxhash64(F.coalesce(F.col(text), F.lit(""))).alias("variant")]
    return docs.select(F.col(doc_id).alias("doc_id"), key, *variant, F.col(text).alias("text"))


def _key_of(keyed: DataFrame) -> list[str]:
    """The columns that tell documents apart."""
    return [c for c in _KEY if c in keyed.columns]


def _with_positions(keyed: DataFrame, positions: DataFrame, how: str) -> DataFrame:
    """``keyed`` joined to ``at`` of its documents."""
    key = _key_of(keyed)
    own = positions.select(*(F.col(c).alias(f"own_{c}") for c in key), "at")
    return keyed.join(own, [F.col(c) == F.col(f"own_{c}") for c in key], how)


def _words_of(piece: pa.RecordBatch, other: bool = False):
    """Word hashes of a piece (of the other kind), document row and position in the document of every word, and words in each document."""
    raw, offsets = utf8(piece.column("text"))
    starts, ends, rows = _words.spans(raw, offsets)
    n = np.diff(rows)
    doc = np.repeat(np.arange(len(n)), n)
    return (_words.other_hashes if other else _words.hashes)(raw, starts, ends), doc, np.arange(len(doc)) - rows[doc], n


def anchors_of(h: np.ndarray, position: np.ndarray, left: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Indices and hashes of the anchors among words with hashes ``h``; ``left`` counts the words from each to its document's end."""
    at = np.flatnonzero(_IN_COVER[position % PERIOD] & (left >= ANCHOR))
    return at, _words.windows(h, ANCHOR, 0xA24BAED4963EE407)[at] if len(h) else np.zeros(0, np.uint64)


def planes(values: np.ndarray) -> bytes:
    """The bytes of equally wide values, first all first bytes, then all second ones: sorted or small values leave runs that compress."""
    return values.view(np.uint8).reshape(len(values), values.dtype.itemsize).T.tobytes()


def from_planes(data: bytes, at: int, n: int, kind: str) -> tuple[np.ndarray, int]:
    """Values from planes that begin at byte ``at``, and where they end."""
    width = np.dtype(kind).itemsize
    raw = np.frombuffer(data, np.uint8, n * width, at).reshape(width, n)
    return np.ascontiguousarray(raw.T).reshape(-1).view(kind), at + n * width


def pack(*columns: np.ndarray) -> bytes:
    return len(columns[0]).to_bytes(4, "little") + b"".join(map(planes, columns))


def unpack(data: bytes, *kinds: str) -> list[np.ndarray]:
    n, at, out = int.from_bytes(data[:4], "little"), 4, []
    for kind in kinds:
        values, at = from_planes(data, at, n, kind)
        out.append(values)
    return out


def _later(place: list[np.ndarray], first: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Which entries of groups in the order of ``place`` are not the group's first place (a repeated row is at the same place)."""
    return np.logical_or.reduce([c != np.repeat(c[first], size) for c in place])


def _places(piece: pa.RecordBatch, key: list[str], doc: np.ndarray, position: np.ndarray) -> list[np.ndarray]:
    """Key columns of the documents ``doc`` and the positions."""
    return [piece.column(c).to_numpy(zero_copy_only=False)[doc] for c in key] + [position]


class _Combined:
    """Hashes of one task's chunk, combined: a representative of each goes to the hash's bucket, what the chunk already knows goes along.

    ``only_later``: every occurrence but the first is known to be a repeat, and the first is the representative; else all
    occurrences of a hash with more than one are known, and any of them stands for it.
    """

    def __init__(self, buckets: int, only_later: bool):
        self.buckets, self.only_later = buckets, only_later
        self.parts: list[tuple] = []
        self.held = self.spread = 0

    def add(self, *columns: np.ndarray) -> None:
        self.parts.append(columns)
        self.held += len(columns[0])

    def flush(self) -> pa.RecordBatch | None:
        """Rows ``(bucket, known, data)``."""
        if not self.held:
            return None
        h1, h2, *place = (np.concatenate(x) for x in zip(*self.parts))
        self.parts, self.held = [], 0
        order = np.lexsort((*reversed(place), h2, h1)) if self.only_later else np.argsort(h1, kind="stable")
        h1, h2, place = h1[order], h2[order], [c[order] for c in place]
        new = np.ones(len(h1), bool)
        new[1:] = (h1[1:] != h1[:-1]) | (h2[1:] != h2[:-1])
        first = np.flatnonzero(new)
        size = np.diff(np.append(first, len(h1)))
        known = _later(place, first, size) if self.only_later else np.repeat(size > 1, size)
        rows = []
        h1, h2, stands = h1[first], h2[first], [c[first] for c in place]
        bucket = (h1 >> np.uint64(32)) * np.uint64(self.buckets) >> np.uint64(32)  # ascending, as h1 is
        cuts = np.searchsorted(bucket, np.arange(self.buckets + 1, dtype=np.uint64))
        for b in np.flatnonzero(np.diff(cuts)):
            s = slice(cuts[b], cuts[b + 1])
            rows.append((int(b), False, pack(h1[s], h2[s], *(c[s] for c in stands))))
        place = [c[known] for c in place]
        order = np.lexsort(place[::-1])
        place = [c[order] for c in place]
        for at in range(0, len(order), KNOWN):
            self.spread += 1
            rows.append(((self.spread * 7919 + int(place[0][at]) % 7907) % self.buckets, True, pack(*(c[at : at + KNOWN] for c in place))))
        return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows), (pa.int32(), pa.bool_(), pa.binary()))], ["bucket", "known", "data"])


def _grouped(place: list[np.ndarray]) -> pa.RecordBatch | None:
    """Rows of key columns and positions from single positions."""
    if not len(place[0]):
        return None
    order = np.lexsort(place[::-1])
    *key, loc = (c[order] for c in place)
    new = np.ones(len(loc), bool)
    new[1:] = np.logical_or.reduce([c[1:] != c[:-1] for c in key])
    first = np.flatnonzero(new)
    offsets = np.concatenate([first, [len(loc)]]).astype(np.int32)
    at = pa.ListArray.from_arrays(pa.array(offsets), pa.array(loc.astype(np.int32)))
    return pa.RecordBatch.from_arrays([*(pa.array(c[first]) for c in key), at], [*_KEY[: len(key)], "at"])


def _single(place: list[np.ndarray]) -> pa.RecordBatch | None:
    """The same columns, a row for each position: positions of one document that met in a bucket are few."""
    *key, loc = place
    if not len(loc):
        return None
    at = pa.ListArray.from_arrays(pa.array(np.arange(len(loc) + 1, dtype=np.int32)), pa.array(loc.astype(np.int32)))
    return pa.RecordBatch.from_arrays([*map(pa.array, key), at], [*_KEY[: len(key)], "at"])


def _repeated(docs: DataFrame, find, buckets: int, partitions: int, only_later: bool) -> DataFrame:
    """Key columns and ``at``: positions whose hash occurs elsewhere (before them, if ``only_later``), from the rows of ``docs`` by ``find``."""
    key = _key_of(docs)

    def spread(batches):
        held = _Combined(buckets, only_later)
        for piece in chunks(batches, "text"):
            held.add(*find(piece, key))
            if held.held >= COMBINE and (out := held.flush()) is not None:
                yield out
        if (out := held.flush()) is not None:
            yield out

    place_kinds = ["<i8"] * (len(key) + 1)
    kinds = ("<u8", "<u4" if only_later else "<u1", *place_kinds)

    def settle(rows):
        h1, h2, *place = (np.concatenate(x) for x in zip(*(unpack(r, *kinds) for r in rows)))
        order = np.lexsort((*reversed(place), h2, h1))
        h1, h2, place = h1[order], h2[order], [c[order] for c in place]
        new = np.ones(len(h1), bool)
        new[1:] = (h1[1:] != h1[:-1]) | (h2[1:] != h2[:-1])
        first = np.flatnonzero(new)
        size = np.diff(np.append(first, len(h1)))
        again = _later(place, first, size) if only_later else np.repeat(size > 1, size)
        return [c[again] for c in place]

    def meet(batches):
        bucket, rows = None, []
        known: list = []
        for batch in batches:
            for b, passed, data in zip(*(batch.column(c).to_pylist() for c in ("bucket", "known", "data"))):
                if passed:
                    known.append(unpack(data, *place_kinds))
                    continue
                if b != bucket:
                    if rows and (out := _single(settle(rows))) is not None:
                        yield out
                    bucket, rows = b, []
                rows.append(data)
            if known:
                if (out := _grouped([np.concatenate(x) for x in zip(*known)])) is not None:
                    yield out
                known = []
        if rows and (out := _single(settle(rows))) is not None:
            yield out

    dealt = docs.mapInArrow(spread, "bucket int, known boolean, data binary").repartition(partitions, "bucket")
    found = dealt.sortWithinPartitions("known", "bucket").mapInArrow(meet, ", ".join([*(f"{c} long" for c in key), "at array<int>"]))
    return found.groupBy(*key).agg(F.flatten(F.collect_list("at")).alias("at"))


def _sizes(docs: DataFrame) -> tuple[int, int]:
    """Buckets and partitions for the hashes of ``docs``, by the size of the input; two buckets a partition at least."""
    size = table_bytes(docs, "text")
    partitions = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), size // PARTITION_BYTES)
    return max(2 * partitions, size // BUCKET_BYTES), partitions


def _find_anchors(piece: pa.RecordBatch, key: list[str]):
    h, doc, position, n = _words_of(piece)
    at, a = anchors_of(h, position, n[doc] - position)
    return a, np.zeros(len(a), np.uint8), *_places(piece, key, doc[at], position[at])


def _find_windows(piece: pa.RecordBatch, key: list[str]):
    """The windows that contain a repeated anchor of their document at an offset below the period."""
    h, doc, position, n = _words_of(piece)
    anchors = piece.column("at")
    rows = np.concatenate([[0], np.cumsum(n)])[:-1]
    lengths = np.diff(anchors.offsets.to_numpy())
    flat = anchors.flatten().to_numpy()
    # +1 at the first window that reaches the anchor, -1 behind the last that holds it
    mark = np.zeros(len(h) + 1, np.int32)
    base = np.repeat(rows, lengths)
    ok = flat + ANCHOR <= np.repeat(n, lengths)  # positions of another text with the same key and hash may not fit
    low = np.maximum(flat - (PERIOD - 1), 0)
    np.add.at(mark, (base + low)[ok], 1)
    np.add.at(mark, (base + flat + 1)[ok], -1)
    at = np.flatnonzero((np.cumsum(mark[:-1]) > 0) & (n[doc] - position >= WINDOW))
    if not len(at):
        none = np.zeros(0, np.int64)
        return none.view(np.uint64), none.astype(np.uint32), *_places(piece, key, none, none)
    other, *_ = _words_of(piece, True)
    hashes = _words.windows(h, WINDOW, 0x9FB21C651E98DF25)[at], (_words.windows(other, WINDOW, 0xC2B2AE3D27D4EB4F)[at] >> np.uint64(32)).astype(np.uint32)
    return *hashes, *_places(piece, key, doc[at], position[at])


def repeated_windows(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Key columns and ``at``: starts of the windows of each document that also start earlier."""
    keyed = _keyed(docs, doc_id, text).drop("doc_id")
    size = _sizes(keyed)
    anchors = written(_repeated(keyed, _find_anchors, *size, False), "anchors")
    held = _with_positions(keyed, anchors, "inner").select(*_key_of(keyed), "text", "at")
    windows = written(_repeated(held, _find_windows, *size, True), "windows")
    discard(anchors)
    return windows


def dedup(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``(doc_id, n_words LONG, n_removed LONG, kept STRING)`` for every row; kept words are joined by one space."""
    keyed = _keyed(docs, doc_id, text)
    joined = _with_positions(keyed, repeated_windows(docs, doc_id, text), "left").select("doc_id", "text", "at")

    def run(batches):
        for piece in chunks(batches, "text"):
            texts = piece.column("text").cast(pa.binary()).to_pylist()
            total, removed, kept = [], [], []
            for t, at in zip(texts, piece.column("at")):
                words = (t or b"").split()  # of bytes: exactly the six ASCII white space characters
                total.append(len(words))
                if at.is_valid and len(at):
                    mark = np.zeros(len(words) + 1, np.int32)
                    starts = at.values.to_numpy()
                    starts = starts[starts + WINDOW <= len(words)]
                    np.add.at(mark, starts, 1)
                    np.add.at(mark, starts + WINDOW, -1)
                    stay = np.cumsum(mark[:-1]) == 0
                    words = [w for w, s in zip(words, stay.tolist()) if s]
                removed.append(total[-1] - len(words))
                kept.append(b" ".join(words))
            yield pa.RecordBatch.from_arrays([piece.column("doc_id"), pa.array(total, pa.int64()), pa.array(removed, pa.int64()), pa.array(kept, pa.binary()).cast(pa.string())], ["doc_id", "n_words", "n_removed", "kept"])

    kind = docs.select(doc_id).schema[0].dataType.simpleString()
    return joined.mapInArrow(run, f"doc_id {kind}, n_words long, n_removed long, kept string")


def digest(found: DataFrame) -> DataFrame:
    """The query's columns from the operator's output."""
    return found.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))


#: The same rows in DuckDB: every window of every document, the first place of each kept.
ORACLE_SQL = r"""
with d as materialized (select doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') as w from documents),
win as (select doc_id, i, array_to_string(w[i:i + 19], ' ') as k from (select doc_id, w, unnest(range(1, len(w) - 18)) as i from d)),
rep as (select doc_id, i from (select doc_id, i, row_number() over (partition by k order by doc_id, i) as r from win) where r > 1),
cov as (select distinct doc_id, unnest(range(i, i + 20)) as p from rep),
pos as (select doc_id, unnest(range(1, len(w) + 1)) as p, unnest(w) as word from d),
kept as (select doc_id, string_agg(word, ' ' order by p) as t from pos anti join cov using (doc_id, p) group by doc_id),
gone as (select doc_id, count(*) as n from cov group by doc_id)
select doc_id, len(w) as n_words, coalesce(gone.n, 0) as n_removed, sha256(coalesce(kept.t, '')) as kept_sha256 from d left join gone using (doc_id) left join kept using (doc_id)
"""
