"""Toxicity severity by cumulative-link ordinal regression on sparse text features.

A text's features are hashes of its words (runs of letters and marks, lower-cased) and of the four- and
five-byte n-grams inside them; only slots that training found to go with toxic text carry a weight, so the
representation is sparse.  One weight vector is shared by all ordered thresholds: P(severity >= j) = logistic(w.x - t_j) with
t_1 < t_2 < t_3, and the result is the expected severity, the sum of the three.

Training takes a bounded hash sample of ``TRAIN_DOCS`` labels and their whole documents (at most twice as many), in two passes: document
counts of all slots, then the sparse features in the chosen ones; only counts and weights reach the driver.  Labels say toxic or not; the
grades 1 to 3 of toxic documents are the terciles of how much of the selected words and n-grams they hold.

Defined results: null and empty texts have no feature and the severity of the thresholds alone; without labels, or with
one class only, every severity is 0; very long texts are processed whole; repeated rows and null ids are scored like any other;
extra columns are not read.
"""

from __future__ import annotations

from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from meltfield.llm import _words
from meltfield.llm._batches import bounded_sample, chunks, discard, first_by_hash, learn, map_text, written
from meltfield.llm.op01_langid import prepare

TRAIN_DOCS = 6000
#: Text bytes taken apart at once.
PIECE = 1 << 20
BITS, GRAMS = 20, (4, 5)
#: A slot is selected by at least so many toxic documents and this share of them, this ratio of document rates, and among the strongest.
LEAST_DOCS, LEAST_SHARE, LEAST_RATIO, MOST_SLOTS = 4, 0.02, 15.0, 4096
GRADES, STEPS, RIDGE, GAP, REJECT = 3, 600, 1e-5, 0.1, 0.5


def slots(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Text row and slot of every word and n-gram of the texts."""
    raw, starts, ends, rows, *_ = prepare(column)
    doc = np.repeat(np.arange(len(rows) - 1), np.diff(rows))
    found = [(_words.hashes(raw, starts, ends) >> np.uint64(64 - BITS)).astype(np.int64)]
    docs = [doc]
    # n-grams that lie in one word and the spaces around it
    b = raw.astype(np.uint64)
    left = np.zeros(len(raw) + 1, np.int64)
    word_of = np.full(len(raw), -1, np.int64)
    if len(starts):
        left[starts] = 1
        word_of = np.cumsum(left[:-1]) - 1
    for n in GRAMS:
        if len(raw) < n:
            continue
        key = np.zeros(len(raw) - n + 1, np.uint64)
        for i in range(n):
            key = key * np.uint64(0x100000001B3) + b[i : len(raw) - n + 1 + i] + np.uint64(1)
        # from the space before a word (or inside it) to the space behind it at most
        w = word_of[n - 1 :]
        at = np.arange(len(key))
        ok = w >= 0
        safe = np.maximum(w, 0)
        if len(starts):
            ok &= (at >= starts[safe]) & (at + n - 1 <= ends[safe])
        else:
            ok[:] = False
        at = np.flatnonzero(ok)
        found.append((_words.mix(key[at] + np.uint64(n)) >> np.uint64(64 - BITS)).astype(np.int64))
        docs.append(doc[w[at]])
    return np.concatenate(docs), np.concatenate(found)


def _counts(doc: np.ndarray, slot: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct (doc, slot) pairs and how often each occurs."""
    pair, n = np.unique(doc * (1 << BITS) + slot, return_counts=True)
    return pair >> BITS, pair & ((1 << BITS) - 1), n


class _Slots:
    """Documents of each class that hold each slot, and from them the slots that get a weight."""

    def __init__(self):
        self.seen, self.docs = np.zeros((2, 1 << BITS), np.int64), np.zeros(2, np.int64)

    def add(self, piece: pa.RecordBatch) -> None:
        for part in chunks([piece], "text", PIECE // 2):
            y = np.array(part.column("label").to_pylist()) > 0
            d, s, _ = _counts(*slots(part.column("text")))
            for c in (0, 1):
                self.seen[c] += np.bincount(s[y[d] == c], minlength=1 << BITS)
                self.docs[c] += (y == c).sum()

    def model(self) -> np.ndarray:
        """The chosen slots, ascending; none if a class is missing."""
        if not self.docs.all():
            return np.zeros(0, np.int64)
        rate = [(self.seen[c] + 0.1) / (self.docs[c] + 0.2) for c in (0, 1)]
        ok = (self.seen[1] >= max(LEAST_DOCS, LEAST_SHARE * self.docs[1])) & (rate[1] >= LEAST_RATIO * rate[0])
        strength = np.where(ok, self.seen[1] * np.log(rate[1] / rate[0]), 0)
        return np.sort(np.argsort(-strength, kind="stable")[: min(MOST_SLOTS, int(ok.sum()))])


class _Weights:
    """Sparse features of the documents in the chosen slots, and from them the regression."""

    def __init__(self, chosen: np.ndarray):
        self.chosen = chosen
        self.column_of = np.full(1 << BITS, -1, np.int32)
        self.column_of[chosen] = np.arange(len(chosen))
        none = np.zeros(0)
        self.rows, self.cols, self.values, self.toxic, self.amount = [none.astype(int)], [none.astype(int)], [none], [], [none]

    def add(self, piece: pa.RecordBatch) -> None:
        for part in chunks([piece], "text", PIECE // 2):
            doc, slot = slots(part.column("text"))
            hit = self.column_of[slot] >= 0
            d, s, n = _counts(doc[hit], slot[hit])
            self.rows.append(len(self.toxic) + d), self.cols.append(self.column_of[s]), self.values.append(np.log1p(n))
            self.amount.append(np.bincount(d, np.log1p(n), part.num_rows))
            self.toxic += [x > 0 for x in part.column("label").to_pylist()]

    def model(self) -> dict:
        y, amount = np.array(self.toxic, bool), np.concatenate(self.amount)
        cuts = np.quantile(amount[y], [1 / 3, 2 / 3])
        grade = np.where(y, 1 + (amount > cuts[0]) + (amount > cuts[1]), 0)
        w, thresholds = fit_ordinal(*map(np.concatenate, (self.rows, self.cols, self.values)), grade, len(self.chosen))
        return {"slots": self.chosen, "weights": w, "thresholds": thresholds}


def train(texts: list[str], toxic: list[int]) -> dict | None:
    """Slots, weights and thresholds from texts in memory; None if a class is missing."""
    piece = pa.RecordBatch.from_arrays([pa.array(texts, pa.string()), pa.array(toxic, pa.int32())], ["text", "label"])
    first = _Slots()
    first.add(piece)
    if not len(chosen := first.model()):
        return None
    second = _Weights(chosen)
    second.add(piece)
    return second.model()


def fit_ordinal(rows, cols, values, grade, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Maximum likelihood with a ridge by projected, accelerated gradient steps.

    The loss is convex in weights and thresholds.  Every selected slot goes with toxic text, so weights stay
    at zero or above; thresholds stay ordered, ``GAP`` apart.  Toxic and other documents weigh the same in sum.
    """
    n = len(grade)
    weight = np.where(grade > 0, 0.5 / (grade > 0).sum(), 0.5 / (grade == 0).sum())
    # the step is the inverse of a bound on the curvature, by power iteration on the weighted design
    q, curve = np.ones(width + 1), 1.0
    for _ in range(20):
        z = np.bincount(rows, values * q[cols], n) + q[-1]
        g = np.append(np.bincount(cols, values * (weight * z)[rows], width), (weight * z).sum())
        curve = np.linalg.norm(g)
        q = g / curve
    step = 1.0 / curve
    each = np.arange(n)
    x = np.concatenate([np.zeros(width), 1.0 + np.arange(GRADES)])
    ahead, momentum = x.copy(), 1.0
    for _ in range(STEPS):
        w, cut = ahead[:width], ahead[width:]
        z = np.bincount(rows, values * w[cols], n)
        up = 1 / (1 + np.exp(-np.clip(z[:, None] - cut, -500, 500)))  # P(severity >= j), j = 1..3
        edge = np.concatenate([np.ones((n, 1)), up, np.zeros((n, 1))], axis=1)
        slope = np.concatenate([np.zeros((n, 1)), up * (1 - up), np.zeros((n, 1))], axis=1)
        p = np.maximum(edge[each, grade] - edge[each, grade + 1], 1e-12)
        low, high = weight * slope[each, grade] / p, weight * slope[each, grade + 1] / p
        dcut = np.bincount(grade, low, GRADES + 2)[1:-1] - np.bincount(grade + 1, high, GRADES + 2)[1:-1]
        dw = np.bincount(cols, values * (high - low)[rows], width) + RIDGE * w
        new = ahead - step * np.concatenate([dw, dcut])
        np.maximum(new[:width], 0, out=new[:width])
        for j in range(width + 1, width + GRADES):
            new[j] = max(new[j], new[j - 1] + GAP)
        after = (1 + np.sqrt(1 + 4 * momentum**2)) / 2
        ahead = new + (momentum - 1) / after * (new - x)
        x, momentum = new, after
    return x[:width], x[width:]


def severity(model: dict | None, column: pa.Array) -> np.ndarray:
    """P(severity >= j) for j = 1..3 of each text."""
    if model is None:
        return np.zeros((len(column), GRADES))
    doc, slot = slots(column)
    table = np.zeros(1 << BITS, np.float64)
    table[model["slots"]] = model["weights"]
    used = np.zeros(1 << BITS, bool)
    used[model["slots"]] = True
    hit = used[slot]
    d, s, n = _counts(doc[hit], slot[hit])
    z = np.bincount(d, np.log1p(n) * table[s], len(column))
    return 1 / (1 + np.exp(-np.clip(z[:, None] - model["thresholds"], -500, 500)))


def fit(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", label: str = "toxic") -> dict | None:
    """A model from a bounded sample of the labelled documents."""
    known = labels.select(F.col(doc_id).alias("label_id"), F.col(label).cast("int").alias("label")).where("label_id is not null and label is not null")
    ids = bounded_sample(known, TRAIN_DOCS, salt=31)
    some = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")).join(F.broadcast(ids), F.col("doc_id") == F.col("label_id")).select("doc_id", "text", "label")
    sample = written(first_by_hash(some, 2 * TRAIN_DOCS, salt=31), "labelled")
    chosen = learn(sample, "text", _Slots)
    model = learn(sample, "text", partial(_Weights, chosen)) if len(chosen) else None
    discard(sample)
    return model


def grade(docs: DataFrame, model: dict | None, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``(doc_id, severity, grade, toxic)``: expected severity 0 to 3, the likeliest grade, and whether grade 1 or more has probability 0.5."""

    def run(piece: pa.RecordBatch) -> dict:
        up = severity(model, piece.column("text"))
        edge = np.concatenate([np.ones((len(up), 1)), up, np.zeros((len(up), 1))], axis=1)
        return {"doc_id": piece.column("doc_id"), "severity": pa.array(up.sum(1)), "grade": pa.array((edge[:, :-1] - edge[:, 1:]).argmax(1).astype(np.int32)), "toxic": pa.array(up[:, 0] >= REJECT)}

    kind = docs.select(doc_id).schema[0].dataType.simpleString()
    return map_text(docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")), "text", run, f"doc_id {kind}, severity double, grade int, toxic boolean", PIECE)


def reject(docs: DataFrame, model: dict | None) -> DataFrame:
    """The rows of ``docs``, all columns, that are not toxic."""
    columns = docs.columns

    def run(batches):
        for piece in chunks(batches, "text", PIECE):
            yield piece.filter(pa.array(severity(model, piece.column("text"))[:, 0] < REJECT))

    return docs.select(*columns).mapInArrow(run, docs.schema)
