"""Quality rules: gradient-boosted trees over document statistics, after two fixed rules.

Statistics of each whole text are computed by numpy over Arrow batches.  The trees are grown here on histograms of a
bounded hash sample of ``TRAIN_DOCS`` labels and their whole documents (at most twice as many), with logistic loss.  Chosen
features are monotonic: more symbols, repeated words, repeated lines, capitals or shouting never raise the
score; a split that breaks this is not taken, and the bounds of both sides hold in the whole subtree.  The
model is a set of flat node arrays, scored level by level for a whole batch.

Defined results: a null or empty text has zero statistics and fails the base rule; very long texts are processed whole;
repeated rows are scored independently; without labels (or with one class only) no model is grown and the verdict is
the base rule alone; extra columns are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from meltfield.llm import _words
from meltfield.llm._batches import bounded_sample, first_by_hash, learn, map_text, utf8

TRAIN_DOCS = 4000
TREES, DEPTH, RATE, BINS, RIDGE, LEAST = 60, 3, 0.15, 64, 1.0, 8
MIN_WORDS, REPEAT_SHARE, KEEP = 50, 50, 0.5

BASE = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
#: Features and the direction in which each may move the score: -1 never up, 0 free.
FEATURES = {"log_words": 0, "word_length": 0, "symbol_share": -1, "dup_line_share": -1, "repeat_share": -1, "capital_share": -1, "digit_share": 0, "shout_share": -1, "distinct_share": 0, "line_words": 0, "stop_share": 0, "bar_share": -1}
_SYMBOLS = np.isin(np.arange(256), list(b"#*$%&|<>"))
_SPACES = np.isin(np.arange(256), [0x20, *range(0x09, 0x0E)])


def _sums(mask: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    total = np.concatenate([[0], np.cumsum(mask)])
    return (total[offsets[1:]] - total[offsets[:-1]]).astype(np.int64)


def duplicate_lines(text: bytes) -> int:
    """Lines with a word that equal an earlier line."""
    seen, n = set(), 0
    for line in text.split(b"\n"):
        if line.strip():
            n += line in seen
            seen.add(line)
    return n


def statistics(column: pa.Array) -> dict[str, np.ndarray]:
    """Base statistics and features of each text."""
    raw, offsets = utf8(column)
    starts, ends, rows = _words.spans(raw, offsets)
    n_words = np.diff(rows)
    n = len(n_words)
    doc = np.repeat(np.arange(n), n_words)
    h = _words.hashes(raw, starts, ends)
    salt = _words.mix(np.arange(1, n + 1, dtype=np.uint64))[doc]
    # three-word windows that occur twice in one text, first occurrence included
    whole = np.flatnonzero(rows[1:][doc] - np.arange(len(doc)) >= 3) if len(doc) else np.zeros(0, np.int64)
    keys = _words.mix(_words.windows(h, 3, 0xA0761D6478BD642F)[whole] ^ salt[whole]) if len(whole) else np.zeros(0, np.uint64)
    order = np.argsort(keys, kind="stable")
    s = keys[order]
    twin = np.zeros(len(s), bool)
    twin[1:] = s[1:] == s[:-1]
    twin[:-1] |= twin[1:]
    mark = np.zeros(len(doc) + 3, bool)
    hit = whole[order[twin]]
    for i in range(3):
        mark[hit + i] = True
    n_repeat = _sums(mark[: len(doc)], rows)
    order = np.argsort(h ^ salt, kind="stable")
    s = (h ^ salt)[order]
    distinct = np.ones(len(s), bool)
    distinct[1:] = s[1:] != s[:-1]
    distinct_of = np.bincount(doc[order[distinct]], minlength=n)
    points = _sums((raw & 0xC0) != 0x80, offsets)
    spaces = _sums(_SPACES[raw], offsets)
    dup = np.array([duplicate_lines(t) if t else 0 for t in column.cast(pa.binary()).to_pylist()], np.int64)
    lines = _sums(raw == 10, offsets) + 1
    word_chars = points - spaces
    symbols = _sums(_SYMBOLS[raw], offsets)
    w, c = np.maximum(n_words, 1), np.maximum(word_chars, 1)
    letters = _sums(((raw | 0x20) >= 97) & ((raw | 0x20) <= 122), offsets)
    features = {
        "log_words": np.log1p(n_words), "word_length": word_chars / w, "symbol_share": symbols / c, "dup_line_share": dup / lines, "repeat_share": n_repeat / w,
        "capital_share": _sums((raw >= 65) & (raw <= 90), offsets) / np.maximum(letters, 1), "digit_share": _sums((raw >= 48) & (raw <= 57), offsets) / c, "shout_share": _sums(raw == 33, offsets) / w,
        "distinct_share": distinct_of / w, "line_words": np.log1p(n_words / lines), "stop_share": _sums((raw == 46) | (raw == 44), offsets) / w, "bar_share": _sums(raw == 124, offsets) / w,
    }
    return {"n_words": n_words, "word_chars": word_chars, "n_symbols": symbols, "n_dup_lines": dup, "n_repeat_words": n_repeat, "x": np.stack([features[f] for f in FEATURES], axis=1)}


def grow(x: np.ndarray, y: np.ndarray) -> dict | None:
    """Flat node arrays (trees x nodes) of boosted trees for labels 0/1; None if one class is missing."""
    if len(y) < 2 * LEAST or y.min() == y.max():
        return None
    direction = np.array(list(FEATURES.values()))
    edges = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, BINS + 1)[1:-1])) for f in range(x.shape[1])]
    binned = np.stack([np.searchsorted(e, x[:, f], side="left") for f, e in enumerate(edges)], axis=1)  # value <= edge i: bin <= i
    start = float(np.log(y.mean() / (1 - y.mean())))
    score, nodes = np.full(len(y), start), 2 ** (DEPTH + 1) - 1
    feature, threshold, value = np.zeros((TREES, nodes), np.int32), np.full((TREES, nodes), np.inf), np.zeros((TREES, nodes))
    for t in range(TREES):
        p = 1 / (1 + np.exp(-score))
        g, h = p - y, np.maximum(p * (1 - p), 1e-9)
        where = np.zeros(len(y), np.int64)
        bounds = {0: (-np.inf, np.inf)}
        for node in range(nodes):
            low, high = bounds.get(node, (-np.inf, np.inf))
            rows = np.flatnonzero(where == node)
            if node not in bounds:
                continue
            value[t, node] = np.clip(-g[rows].sum() / (h[rows].sum() + RIDGE), low, high)
            if 2 * node + 2 < nodes:
                best = _split(binned[rows], g[rows], h[rows], [len(e) for e in edges], direction, low, high)
                if best is None:
                    f, cut, left, right = 0, None, value[t, node], value[t, node]
                    threshold[t, node] = np.inf  # all rows go left, to the same value
                    bounds[2 * node + 1] = (left, left)
                    where[rows] = 2 * node + 1
                else:
                    f, cut, left, right = best
                    feature[t, node], threshold[t, node] = f, edges[f][cut]
                    middle = (left + right) / 2
                    bounds[2 * node + 1], bounds[2 * node + 2] = (low, high), (low, high)
                    if direction[f] < 0:
                        bounds[2 * node + 1], bounds[2 * node + 2] = (middle, high), (low, middle)
                    elif direction[f] > 0:
                        bounds[2 * node + 1], bounds[2 * node + 2] = (low, middle), (middle, high)
                    where[rows] = np.where(binned[rows, f] <= cut, 2 * node + 1, 2 * node + 2)
        value[t] *= RATE
        score += value[t][where]
    return {"start": start, "feature": feature, "threshold": threshold, "value": value}


def _split(binned, g, h, cuts, direction, low, high):
    """The best (feature, cut, left value, right value), or None."""
    total_g, total_h = g.sum(), h.sum()
    best, chosen = 1e-6, None
    for f, m in enumerate(cuts):
        if not m:
            continue
        gl = np.cumsum(np.bincount(binned[:, f], g, m + 1))[:-1]
        hl = np.cumsum(np.bincount(binned[:, f], h, m + 1))[:-1]
        nl = np.cumsum(np.bincount(binned[:, f], minlength=m + 1))[:-1]
        gr, hr = total_g - gl, total_h - hl
        left, right = np.clip(-gl / (hl + RIDGE), low, high), np.clip(-gr / (hr + RIDGE), low, high)
        gain = -(gl * left + 0.5 * (hl + RIDGE) * left**2 + gr * right + 0.5 * (hr + RIDGE) * right**2)
        here = np.clip(-total_g / (total_h + RIDGE), low, high)
        gain += total_g * here + 0.5 * (total_h + RIDGE) * here**2
        gain[(nl < LEAST) | (len(g) - nl < LEAST) | (direction[f] * (right - left) < 0)] = -np.inf
        i = int(np.argmax(gain))
        if gain[i] > best:
            best, chosen = gain[i], (f, i, left[i], right[i])
    return chosen


def score(model: dict, x: np.ndarray) -> np.ndarray:
    """Probability of label 1 of each row; all trees go down one level at a time."""
    n, trees = len(x), np.arange(len(model["feature"]))[None, :]
    at = np.zeros((n, trees.shape[1]), np.int64)
    for _ in range(DEPTH):
        go = np.take_along_axis(x, model["feature"][trees, at], axis=1) > model["threshold"][trees, at]
        at = 2 * at + 1 + go
    return 1 / (1 + np.exp(-(model["start"] + model["value"][trees, at].sum(axis=1))))


class Learner:
    """Statistics of labelled texts, then trees."""

    def __init__(self):
        self.x, self.y = [], []

    def add(self, piece: pa.RecordBatch) -> None:
        self.x.append(statistics(piece.column("text"))["x"])
        self.y += piece.column("label").to_pylist()

    def model(self) -> dict | None:
        return grow(np.concatenate(self.x), np.array(self.y, float)) if self.y else None


def fit(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", label: str = "quality") -> dict | None:
    """Trees from a bounded sample of the labelled documents; only the trees reach the driver."""
    known = labels.select(F.col(doc_id).alias("label_id"), F.col(label).cast("int").alias("label")).where("label_id is not null and label is not null")
    ids = bounded_sample(known, TRAIN_DOCS)
    some = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")).join(F.broadcast(ids), F.col("doc_id") == F.col("label_id")).select("doc_id", "label", "text")
    return learn(first_by_hash(some, 2 * TRAIN_DOCS), "text", Learner)


def assess(docs: DataFrame, model: dict | None, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Base statistics, ``base_failed``, ``kept`` and the trees' ``score`` (null without a model) of every row."""

    def run(piece: pa.RecordBatch) -> dict:
        s = statistics(piece.column("text"))
        failed = (s["n_words"] < MIN_WORDS) | (100 * s["n_repeat_words"] > REPEAT_SHARE * s["n_words"])
        p = score(model, s["x"]) if model else None
        kept = ~failed & (p >= KEEP) if model else ~failed
        return {"doc_id": piece.column("doc_id")} | {b: pa.array(s[b].astype(np.int64)) for b in BASE} | {"base_failed": pa.array(failed), "kept": pa.array(kept), "score": pa.array(p if model else [None] * len(failed), pa.float64())}

    kind = docs.select(doc_id).schema[0].dataType.simpleString()
    schema = f"doc_id {kind}, {', '.join(f'{b} long' for b in BASE)}, base_failed boolean, kept boolean, score double"
    return map_text(docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")), "text", run, schema)


def digest(found: DataFrame) -> DataFrame:
    """The query's columns."""
    return found.select("doc_id", *BASE, "base_failed", "kept", F.round("score", 6).alias("score"))


def base(found: DataFrame) -> DataFrame:
    """The statistics and the base rule alone."""
    return found.select("doc_id", *BASE, "base_failed")


#: The rows of ``base`` in DuckDB.
BASE_SQL = r"""
with d as materialized (select row_number() over () as row, doc_id, coalesce(text, '') as t, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') as w from documents),
win as (select row, i, array_to_string(w[i:i + 2], ' ') as k from (select row, w, unnest(range(1, len(w) - 1)) as i from d)),
rep as (select row, i from (select row, i, count(*) over (partition by row, k) as n from win) where n > 1),
cov as (select row, count(distinct p) as n from (select row, unnest(range(i, i + 3)) as p from rep) group by row),
lines as (select row, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) as l from d),
s as (select doc_id, len(w) as n_words, coalesce(length(array_to_string(w, '')), 0) as word_chars, length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) as n_symbols,
  (len(l) - len(list_distinct(l)))::bigint as n_dup_lines, coalesce(cov.n, 0) as n_repeat_words from d join lines using (row) left join cov using (row))
select *, n_words < 50 or 100 * n_repeat_words > 50 * n_words as base_failed from s
"""
