"""BPE encoding and decoding by merge ranks.

Every pre-token is a doubly linked list of symbols; a priority queue holds the merge rank of each
adjacent pair, entries made stale by an earlier merge are skipped when they surface, and the lowest
rank (leftmost on ties) is merged until no ranked pair is left.  Whole batches of texts are cut into pre-tokens by numpy; each
distinct pre-token is merged once while it is remembered.  Decoding concatenates vocabulary
strings; the vocabulary file names no decoder, so the strings are joined by single spaces.

Defined results: a null text counts as empty; an empty text, or one of white space only, has no ids
and decodes to the empty string; repeated rows are encoded independently; further columns of the
input are not read.  Texts with characters that Python and the tokenizers library know differently (they
follow different versions of Unicode) are normalised and split by the library's own objects.
"""

from __future__ import annotations

import heapq
import json
import unicodedata

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from meltfield.llm._batches import map_text

#: Pre-tokens kept in each worker; beyond it the older generation is forgotten.
CACHE_WORDS = 120_000
#: Text bytes cut into pre-tokens at once; their working arrays take some forty times as much.
PIECE = 1 << 20


#: Code points that have classes: planes 0 to 3 without surrogates, and 14; the rest is unassigned or private.
_POINTS = (*range(0xD800), *range(0xE000, 0x34000), *range(0xE0000, 0xE1000))


def library_class(pattern: str) -> np.ndarray:
    """Code points that a pattern of one character class matches, by the tokenizers library."""
    from tokenizers import Regex, pre_tokenizers

    points, out = np.array(_POINTS), []
    for _, (a, b) in pre_tokenizers.Split(Regex(pattern), "removed", invert=True).pre_tokenize_str("".join(map(chr, _POINTS))):
        out.append(points[a:b])
    return np.concatenate(out)


LETTER, NUMBER, WHITE, OTHER = 1, 2, 3, 0
_CLASS: list[np.ndarray] = []


def classes() -> np.ndarray:
    """Letter, number, white space or other, for each code point."""
    if not _CLASS:
        table = np.zeros(0x110000, np.uint8)
        for kind, found in ((LETTER, r"\p{L}+"), (NUMBER, r"\p{N}+"), (WHITE, r"\s+")):
            table[library_class(found)] = kind
        _CLASS.append(table)
    return _CLASS[0]


def pretokens(points: np.ndarray, begins: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and classes of the pre-tokens, and of the white space between them, of texts that begin at ``begins``.

    The rule in words: runs of letters, single numbers, runs of other signs; an apostrophe that starts such a run takes s, t, m, d,
    re, ve or ll behind it.
    """
    n = len(points)
    kind = classes().take(points)
    new = kind == NUMBER
    new[1:] |= kind[1:] != kind[:-1]
    edge = np.zeros(n + 3, bool)
    edge[begins] = edge[n:] = True
    new |= edge[:n]
    quote = np.flatnonzero((points == 0x27) & new)
    quote = quote[~edge[quote + 1]]
    if len(quote):
        a = points[quote + 1]
        b = np.where(edge[quote + 2], 0, points[np.minimum(quote + 2, n - 1)])
        one = np.isin(a, list(map(ord, "stmd")))
        two = ((a == ord("r")) | (a == ord("v"))) & (b == ord("e")) | (a == ord("l")) & (b == ord("l"))
        hit = one | two
        stop = (quote + 2 + two)[hit]
        new[quote[hit] + 1] = False
        new[stop[stop < n]] = True
    starts = np.flatnonzero(new)
    return starts, kind[starts]


def byte_alphabet() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies: printable Latin-1 bytes stand for themselves, the others for code points from 256 on."""
    own = {*range(33, 127), *range(161, 173), *range(174, 256)}
    out, extra = [], 256
    for b in range(256):
        out.append(chr(b if b in own else extra))
        extra += b not in own
    return out


class Merger:
    """Merge-rank BPE over one vocabulary."""

    def __init__(self, vocab: dict[str, int], merges: list, suffix: str):
        self.vocab, self.suffix = vocab, suffix
        pairs = [m if isinstance(m, list | tuple) else m.split(" ") for m in merges]
        self.merged = [vocab[a + b] for a, b in pairs]
        # a pair of ids is one number, and so is an entry of the queue: its rank above the place of its left symbol
        self.ranks = {vocab[a] << 32 | vocab[b]: rank for rank, (a, b) in enumerate(pairs)}

    def encode(self, symbols: str) -> list[int]:
        """Ids of one pre-token, given as characters of the byte alphabet."""
        last = len(symbols) - 1
        ids = [self.vocab.get(c + self.suffix if i == last else c) for i, c in enumerate(symbols)]
        ids = [i for i in ids if i is not None]
        n = len(ids)
        if n < 2:
            return ids
        rank, merged = self.ranks.get, self.merged
        before, after = list(range(-1, n - 1)), [*range(1, n), -1]
        queue = [r << 32 | i for i, (a, b) in enumerate(zip(ids, ids[1:])) if (r := rank(a << 32 | b)) is not None]
        heapq.heapify(queue)
        while queue:
            entry = heapq.heappop(queue)
            i = entry & 0xFFFFFFFF
            j = after[i]
            if j < 0 or ids[i] is None or rank(ids[i] << 32 | ids[j]) != entry >> 32:
                continue  # stale: one side has been merged since
            ids[i], ids[j] = new, _ = merged[entry >> 32], None
            after[i] = k = after[j]
            if k >= 0:
                before[k] = i
                if (r := rank(new << 32 | ids[k])) is not None:
                    heapq.heappush(queue, r << 32 | i)
            if (h := before[i]) >= 0 and (r := rank(ids[h] << 32 | new)) is not None:
                heapq.heappush(queue, r << 32 | h)
        return [x for x in ids if x is not None]


class Codec:
    """Text to ids and back with a tokenizer file of kind: NFC, lower case, split by pattern, byte-level BPE with a word end."""

    def __init__(self, path: str):
        from tokenizers import Regex, Tokenizer, pre_tokenizers

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        self.merger = Merger(model["vocab"], model["merges"], model.get("end_of_word_suffix") or "")
        self.strings = {i: s for s, i in model["vocab"].items()} | {t["id"]: t["content"] for t in spec["added_tokens"]}
        split = next(p for p in spec["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split")
        self.pattern = regex.compile(split["pattern"]["Regex"])
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.special_pattern = regex.compile("|".join(map(regex.escape, self.special))) if self.special else None
        self.normalizer = Tokenizer.from_file(path).normalizer
        self.split = pre_tokenizers.Split(Regex(split["pattern"]["Regex"]), "removed", invert=True)
        self.odd = self._odd_characters()
        self.alphabet = byte_alphabet()
        self.young: dict[str, tuple[bytes, str]] = {}
        self.old: dict[str, tuple[bytes, str]] = {}

    def _piece(self, word: str) -> tuple[bytes, str]:
        if (hit := self.old.get(word)) is None:
            ids = self.merger.encode("".join(map(self.alphabet.__getitem__, word.encode())))
            hit = (b"".join(i.to_bytes(4, "little") for i in ids), self.decode(ids))
        if len(self.young) >= CACHE_WORDS:
            self.old, self.young = self.young, {}
        if len(word) <= 64:
            self.young[word] = hit
        return hit

    def _odd_characters(self) -> np.ndarray:
        """Characters that Python does not know, or normalises or classes in another way than the library."""
        every = "".join(map(chr, _POINTS))
        odd = {c for c in every if unicodedata.category(c) == "Cn" or self.normalizer.normalize_str(c) != (" " if c.isspace() else unicodedata.normalize("NFC", c).lower())}
        odd -= {"\u03a3"}  # the capital sigma is lowered apart
        for pattern in (r"\p{L}+", r"\p{N}+", r"\s+"):
            odd.update(map(chr, {ord(c) for m in regex.finditer(pattern, every) for c in m[0]} ^ set(library_class(pattern).tolist())))
        table = np.zeros(0x110000, bool)
        table[[*map(ord, odd), *range(0x34000, 0xE0000), *range(0xE1000, 0x110000)]] = True
        return table

    def _is_odd(self, text: str) -> bool:
        return not text.isascii() and bool(self.odd.take(np.frombuffer(text.encode("utf-32-le"), np.uint32)).any())

    def _words(self, text: str) -> list[str]:
        if self._is_odd(text):
            return [word for word, _ in self.split.pre_tokenize_str(self.normalizer.normalize_str(text))]
        return self.pattern.findall(self._lowered(text))

    @staticmethod
    def _lowered(text: str) -> str:
        """NFC and lower case."""
        if text.isascii():
            return text.lower()
        text = unicodedata.normalize("NFC", text)
        if "Σ" in text:  # the normaliser lowers each character by itself, without a final sigma
            text = text.replace("Σ", "σ")
        return text.lower()

    def _append(self, text: str, out: list) -> None:
        get = self.young.get
        for word in self._words(text):
            out.append(get(word) or self._piece(word))

    def pieces(self, text: str) -> list[tuple[bytes, str]]:
        """(ids as little-endian uint32, their vocabulary strings joined by spaces) of each pre-token with ids."""
        out: list = []
        if self.special_pattern is None or "<|" not in text:
            self._append(text, out)
        else:
            last = 0
            for m in self.special_pattern.finditer(text):
                self._append(text[last : m.start()], out)
                out.append((self.special[m[0]].to_bytes(4, "little"), m[0]))
                last = m.end()
            self._append(text[last:], out)
        return [p for p in out if p[0]]

    def encode_bytes(self, text: str) -> bytes:
        return b"".join([p[0] for p in self.pieces(text)])

    def _usual(self, text: str) -> bool:
        """Whether Python's normalisation and the classes' table are right for a text without special strings."""
        return not self._is_odd(text) and not any(s in text for s in self.special)

    def batch(self, texts: list[str]) -> tuple[np.ndarray, pa.Array, pa.Array]:
        """Numbers of ids, ids (little-endian uint32) and decoded texts of whole texts."""
        usual = [self._usual(t) for t in texts]
        n, ids, decoded = self._together([t for t, u in zip(texts, usual) if u])
        if all(usual):
            return n, ids, decoded
        own = iter(zip(ids.to_pylist(), decoded.to_pylist()))
        rows = [next(own) if u else (b"".join([p[0] for p in parts]), " ".join([p[1] for p in parts])) for u, parts in ((u, None if u else self.pieces(t)) for t, u in zip(texts, usual))]
        return np.array([len(r[0]) // 4 for r in rows], np.int64), pa.array([r[0] for r in rows], pa.binary()), pa.array([r[1] for r in rows], pa.string())

    def _together(self, texts: list[str]) -> tuple[np.ndarray, pa.Array, pa.Array]:
        lowered = [self._lowered(t) for t in texts]
        joined = "".join(lowered)
        if not joined:
            return np.zeros(len(texts), np.int64), pa.array([b""] * len(texts), pa.binary()), pa.array([""] * len(texts), pa.string())
        raw = joined.encode()
        points = np.frombuffer(joined.encode("utf-32-le"), np.uint32)
        sizes = np.fromiter(map(len, lowered), np.int64, len(lowered))
        ends = np.cumsum(sizes)
        starts, kind = pretokens(points, (ends - sizes)[sizes > 0])
        at = np.append(starts, len(points))
        if len(raw) != len(points):
            at = np.append(np.flatnonzero((np.frombuffer(raw, np.uint8) & 0xC0) != 0x80), len(raw))[at]
        every = pa.Array.from_buffers(pa.binary(), len(starts), [None, pa.py_buffer(at.astype(np.int32)), pa.py_buffer(raw)])
        token = kind != WHITE
        words = every.filter(pa.array(token)).dictionary_encode()
        get = self.young.get
        coded = [get(w) or self._piece(w) for w in map(bytes.decode, words.dictionary.to_pylist())]
        length = np.fromiter((len(c[0]) for c in coded), np.int64, len(coded)) // 4
        index = words.indices.to_numpy()
        each = length[index]
        total = np.concatenate([[0], np.cumsum(each)])
        flat = np.frombuffer(b"".join([c[0] for c in coded]), "<u4")
        out = flat.take(np.repeat((np.cumsum(length) - length)[index] - total[:-1], each) + np.arange(total[-1]))
        # words of a text, and of these the ones with ids
        cut = np.searchsorted(starts[token], ends)
        offsets = np.concatenate([[0], total[cut]])
        some = np.concatenate([[0], np.cumsum(each > 0)])
        strings = pa.array([c[1] for c in coded], pa.string()).take(words.indices.filter(pa.array(each > 0)))
        lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], some[cut]]).astype(np.int32)), strings)
        ids = pa.Array.from_buffers(pa.binary(), len(texts), [None, pa.py_buffer((4 * offsets).astype(np.int32)), pa.py_buffer(out.astype("<u4").tobytes())])
        return np.diff(offsets), ids, pc.binary_join(lists, " ")

    def decode(self, ids) -> str:
        return " ".join([self.strings[i] for i in ids])


_CODECS: dict[str, Codec] = {}


def codec(path: str) -> Codec:
    """The codec of a tokenizer file, read once in each process."""
    if path not in _CODECS:
        _CODECS[path] = Codec(path)
    return _CODECS[path]


def encode(docs: DataFrame, vocabulary: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``(doc_id, n_tokens LONG, ids BINARY, decoded STRING)`` of every whole text.

    ``ids`` are little-endian unsigned 32-bit integers; ``vocabulary`` is a tokenizer file that exists
    on every machine (it comes with the Python environment).
    """

    def run(piece: pa.RecordBatch) -> dict:
        n, ids, decoded = codec(vocabulary).batch([t or "" for t in piece.column("text").to_pylist()])
        return {"doc_id": piece.column("doc_id"), "n_tokens": pa.array(n, pa.int64()), "ids": ids, "decoded": decoded}

    kind = docs.select(doc_id).schema[0].dataType.simpleString()
    return map_text(docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")), "text", run, f"doc_id {kind}, n_tokens long, ids binary, decoded string", PIECE)


def decode(encoded: DataFrame, vocabulary: str, doc_id: str = "doc_id", ids: str = "ids") -> DataFrame:
    """``(doc_id, decoded)`` from binary ids as ``encode`` makes them; null ids count as none."""

    def run(piece: pa.RecordBatch) -> dict:
        c = codec(vocabulary)
        rows = [c.decode(memoryview(x or b"").cast("I")) if x else "" for x in piece.column("ids").to_pylist()]
        return {"doc_id": piece.column("doc_id"), "decoded": pa.array(rows, pa.string())}

    kind = encoded.select(doc_id).schema[0].dataType.simpleString()
    return map_text(encoded.select(F.col(doc_id).alias("doc_id"), F.col(ids).alias("ids")), "ids", run, f"doc_id {kind}, decoded string")


def digest(encoded: DataFrame) -> DataFrame:
    """The query's columns from the operator's output."""
    return encoded.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))
