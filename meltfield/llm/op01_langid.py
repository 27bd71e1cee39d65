"""Language identification of mixed-language text.

A word (a run of letters and marks; an ideograph or kana is a word by itself) is scored for every language by hashed byte
n-grams of two to four bytes.  The script of its characters narrows the candidates: a language stays in the race for a
word only if its training text uses that script.  Viterbi over the words of a document, with a penalty for each switch,
labels spans; the prediction is the language of most of the letters.

Training counts n-grams in a bounded hash sample of at most ``TRAIN_DOCS`` whole labelled documents whose crc32(doc_id as
text) mod 4 is not 2; only their text and label are used.

Defined results: ``und`` with score 0 and no spans if the text is null or has no letter, or if nothing could be learned;
letters in a script that no language uses are scored by all languages; equal totals go to the language that sorts
first; very long texts are walked word by word, whole; repeated rows and null ids are predicted like any
other; extra columns are not read.
"""

from __future__ import annotations

import unicodedata

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from meltfield.llm._batches import bounded_sample, learn, map_text, utf8

TRAIN_DOCS = 2500
#: n-gram orders with the bits of their tables, smoothing, weight of a word's log likelihood, cost of a switch.
ORDERS = {2: 16, 3: 16, 4: 17}
SMOOTHING, TEMPER, SWITCH = 0.5, 0.35, 9.0
#: Share of a language's letters from which a script counts as its own.
SCRIPT_SHARE = 0.01
UNKNOWN = "und"

#: Scripts by the first word of their characters' names; letters of others share the last place.
SCRIPTS = (
    *"latin greek cyrillic armenian hebrew arabic devanagari bengali gurmukhi gujarati oriya tamil telugu kannada malayalam sinhala thai lao tibetan myanmar georgian hangul ethiopic khmer mongolian cjk hiragana katakana".split(),
    "other",
)
#: Scripts written without spaces whose characters are words; marks that any script may have; no part of a word.
SINGLE, COMMON, NO_WORD = tuple(SCRIPTS.index(s) for s in ("cjk", "hiragana", "katakana")), 254, 255
_TABLE: list[np.ndarray] = []


def script_table() -> np.ndarray:
    """The script of each code point, by category and name of the character."""
    if not _TABLE:
        place = {name.upper(): i for i, name in enumerate(SCRIPTS)} | {"COMBINING": COMMON, "MODIFIER": COMMON}
        table = np.full(0x110000, NO_WORD, np.uint8)
        for p in (*range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0xD800), *range(0xF900, 0x34000)):
            c = chr(p)
            if unicodedata.category(c)[0] in "LM":
                table[p] = place.get(unicodedata.name(c, "OTHER").split()[0], len(SCRIPTS) - 1)
        _TABLE.append(table)
    return _TABLE[0]


def crc_fold(doc_id):
    """crc32 of the id as text, modulo 4."""
    return F.pmod(F.crc32(F.col(doc_id).cast("string").cast("binary")), F.lit(4))


def _ngrams(raw: np.ndarray):
    """For each order the table slot of the n-gram that ends at each byte."""
    b = raw.astype(np.uint64)
    key = b.copy()
    for order in range(2, max(ORDERS) + 1):
        shifted = np.zeros_like(b)
        shifted[order - 1 :] = b[: len(b) - order + 1] if len(b) >= order else 0
        key = key | (shifted << np.uint64(8 * (order - 1)))
        if order in ORDERS:
            bits = ORDERS[order]
            yield order, (key if order == 2 else (key * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - bits)).astype(np.int64)


def prepare(column: pa.Array):
    """Lower-cased bytes with all separators as spaces, word starts and ends in them, word offsets of the rows, byte offsets of the rows, script of each byte's character."""
    table = script_table()
    lowered = pc.utf8_lower(pc.fill_null(column, ""))
    raw, offsets = utf8(pc.binary_join_element_wise(lowered, " ", ""))
    script = table[:256].take(raw)  # right for ASCII
    lead = np.flatnonzero(raw >= 0xC0)
    cut = np.zeros(0, np.int64)
    if len(lead):
        script[raw >= 0x80] = NO_WORD
        first = raw[lead].astype(np.int64)
        size = 2 + (first >= 0xE0) + (first >= 0xF0)
        point = first & (0xFF >> (size + 1))
        for i in (1, 2, 3):
            longer = size > i
            point[longer] = point[longer] << 6 | (raw[lead[longer] + i] & 0x3F)
        code = table.take(point)
        for i in range(4):
            longer = size > i
            script[lead[longer] + i] = code[longer]
        single = np.isin(code, SINGLE)
        cut = np.concatenate([lead[single], (lead + size)[single]])
    word = script != NO_WORD
    raw = np.where(word, raw, np.uint8(0x20))
    padded = np.concatenate([[False], word, [False]])
    edge = padded[1:] != padded[:-1]
    edge[cut] = True
    starts, ends = np.flatnonzero(edge & padded[1:]), np.flatnonzero(edge & padded[:-1])
    return raw, starts, ends, np.searchsorted(starts, offsets), offsets, script


class Learner:
    """Counts n-grams and scripts of labelled texts."""

    def __init__(self):
        self.grams: dict[str, dict[int, np.ndarray]] = {}
        self.scripts: dict[str, np.ndarray] = {}

    def add(self, piece: pa.RecordBatch) -> None:
        langs = np.array(piece.column("lang").to_pylist(), object)
        for name in sorted(set(langs)):
            raw, *_, script = prepare(piece.column("text").filter(pa.array(langs == name)))
            counts = self.grams.setdefault(name, {n: np.zeros(1 << bits, np.int64) for n, bits in ORDERS.items()})
            for order, slot in _ngrams(raw):
                counts[order] += np.bincount(slot, minlength=1 << ORDERS[order])
            self.scripts[name] = self.scripts.get(name, 0) + np.bincount(script[script < len(SCRIPTS)], minlength=len(SCRIPTS))

    def model(self) -> dict | None:
        """Log likelihoods (slots x languages) of each order, and the scripts of each language; None without training text."""
        names = sorted(self.grams)
        if not names:
            return None
        counts = {n: np.stack([self.grams[x][n] for x in names], axis=1) for n in ORDERS}
        scripts = np.stack([self.scripts[x] for x in names])
        # only slots that training text has seen carry evidence; the rest are even for all languages
        tables = {n: np.where(c.sum(1, keepdims=True) > 0, np.log((c + SMOOTHING) / (c.sum(0) + SMOOTHING * len(c))), 0).astype(np.float32) for n, c in counts.items()}
        return {"langs": names, "tables": tables, "scripts": scripts >= SCRIPT_SHARE * np.maximum(scripts.sum(1, keepdims=True), 1)}


def train(texts: list[str], langs: list[str]) -> dict | None:
    """A model from texts and their languages."""
    one = Learner()
    if texts:
        one.add(pa.RecordBatch.from_arrays([pa.array(texts, pa.string()), pa.array(langs, pa.string())], ["text", "lang"]))
    return one.model()


#: By script of a byte: its place in a set of scripts.
_BIT = np.array([1 << i if i < len(SCRIPTS) else 0 for i in range(256)], np.int32)


def word_scores(model: dict, raw: np.ndarray, starts: np.ndarray, ends: np.ndarray, scripts: np.ndarray) -> np.ndarray:
    """Tempered log likelihood of each word (with the space behind it) for each language; excluded languages far below."""
    k = len(model["langs"])
    out = np.zeros((len(starts), k), np.float32)
    at, block = 0, 1 << 19
    while at < len(starts):
        low = max(int(starts[at]) - 3, 0)
        stop = max(int(np.searchsorted(ends, starts[at] + block, side="right")), at + 1)
        part = raw[low : ends[stop - 1] + 1]
        total = np.zeros((len(part), k), np.float32)
        for order, slot in _ngrams(part):
            total += model["tables"][order][slot]
        cuts = np.stack([starts[at:stop] - low, ends[at:stop] + 1 - low], axis=1).ravel()
        if cuts[-1] >= len(total):
            total = np.concatenate([total, np.zeros((1, k), np.float32)])
        out[at:stop] = np.add.reduceat(total, cuts, axis=0)[::2]
        bit = np.append(_BIT.take(scripts[low : low + len(part)]), np.int32(0))
        used = np.bitwise_or.reduceat(bit, cuts)[::2]
        bits = _BIT[: len(SCRIPTS)]
        for value in np.unique(used):
            fits = (model["scripts"] | ((value & bits) == 0)).all(1) if value else np.ones(k, bool)
            if fits.any() and not fits.all():
                out[at:stop][used == value] += np.where(fits, 0, -200).astype(np.float32)
        at = stop
    return out * np.float32(TEMPER)


def viterbi(scores: np.ndarray, rows: np.ndarray, switch: float = SWITCH) -> np.ndarray:
    """Best language of each word; documents (word offsets ``rows``) are walked together, one word at a time."""
    k = scores.shape[1]
    label = np.zeros(len(scores), np.int16)
    sizes = np.diff(rows)
    order = np.argsort(-sizes, kind="stable")
    sizes, first = sizes[order], rows[:-1][order]
    if not len(sizes) or not sizes[0] or k == 1:
        return label
    active = np.searchsorted(-sizes, -np.arange(sizes[0]), side="left")  # documents with more than t words
    came = np.empty((len(scores), k), np.int16)
    best = np.zeros((len(sizes), k), np.float64)
    own = np.arange(k, dtype=np.int16)
    for t in range(sizes[0]):
        m = active[t]
        at = first[:m] + t
        if t:
            v = best[:m]
            top = v.argmax(1)
            jump = v[np.arange(m), top][:, None] - switch
            stay = v >= jump
            came[at] = np.where(stay, own, top[:, None].astype(np.int16))
            v = np.where(stay, v, jump)
            best[:m] = v - v.max(1, keepdims=True) + scores[at]
        else:
            best[:m] = scores[at]
    state = np.zeros(len(sizes), np.int64)
    for t in range(sizes[0] - 1, -1, -1):
        m = active[t]
        at = first[:m] + t
        ending = sizes[:m] == t + 1
        state[:m] = np.where(ending, best[:m].argmax(1), state[:m])
        label[at] = state[:m]
        if t:
            state[:m] = came[at, state[:m]]
    return label


SPANS = "array<struct<start:int,end:int,lang:string>>"


def predict(docs: DataFrame, model: dict | None, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``(doc_id, lang_pred, score, spans)`` of every whole text; span offsets count code points."""
    kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("lang", pa.string())]))

    def run(piece: pa.RecordBatch) -> dict:
        n = piece.num_rows
        column = piece.column("text")
        lettered = pc.fill_null(pc.match_substring_regex(column, r"\p{L}"), False).to_numpy(zero_copy_only=False)
        if model is None or not lettered.any():
            return {"doc_id": piece.column("doc_id"), "lang_pred": pa.array([UNKNOWN] * n), "score": pa.array([0.0] * n), "spans": pa.array([[]] * n, kind)}
        names = np.array(model["langs"])
        raw, starts, ends, rows, offsets, script = prepare(column)
        label = viterbi(word_scores(model, raw, starts, ends, script), rows)
        doc = np.repeat(np.arange(n), np.diff(rows))
        points = np.concatenate([[0], np.cumsum((raw & 0xC0) != 0x80)])
        letters = points[ends] - points[starts]
        share = np.zeros((n, len(names)))
        np.add.at(share, (doc, label), letters)
        total = share.sum(1)
        best = share.argmax(1)
        ok = lettered & (total > 0)
        score = np.where(ok, share[np.arange(n), best] / np.maximum(total, 1), 0.0)
        predicted = np.where(ok, names[best], UNKNOWN)
        # a span runs from the first to the last word of consecutive words with one label
        new = np.ones(len(label), bool)
        new[1:] = (label[1:] != label[:-1]) | (doc[1:] != doc[:-1])
        first = np.flatnonzero(new)
        last = np.concatenate([first[1:], [len(label)]]) - 1 if len(first) else first
        base = points[offsets[:-1]][doc[first]] if len(first) else first
        count = np.bincount(doc[first], minlength=n)
        flat = pa.StructArray.from_arrays([pa.array((points[starts[first]] - base).astype(np.int32)), pa.array((points[ends[last]] - base).astype(np.int32)), pa.array(names[label[first]])], fields=list(kind.value_type))
        spans = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(count)]).astype(np.int32)), flat)
        return {"doc_id": piece.column("doc_id"), "lang_pred": pa.array(predicted), "score": pa.array(score), "spans": spans}

    id_type = docs.select(doc_id).schema[0].dataType.simpleString()
    return map_text(docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")), "text", run, f"doc_id {id_type}, lang_pred string, score double, spans {SPANS}")


def fit(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang") -> dict | None:
    """A model from the labelled documents outside the held-out fold."""
    some = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"), F.col(lang).alias("lang"))
    some = some.where("lang is not null and text is not null").where(crc_fold("doc_id") != 2).select("text", "lang")
    return learn(bounded_sample(some, TRAIN_DOCS, salt=29), "text", Learner)


def digest(found: DataFrame) -> DataFrame:
    """The query's columns; spans as start:end:lang."""
    spans = F.concat_ws(",", F.transform("spans", lambda s: F.concat_ws(":", s["start"].cast("string"), s["end"].cast("string"), s["lang"])))
    return found.select("doc_id", F.coalesce(crc_fold("doc_id") == 2, F.lit(False)).alias("held_out"), "lang_pred", "score", spans.alias("spans"))
