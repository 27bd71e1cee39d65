"""Personal data by patterns and a skip-chain conditional random field.

Base spans come from four patterns, leftmost and non-overlapping per kind, checked by octet range, digit
count or Luhn sum.  The field then labels whole values that the patterns may miss, its nodes: tokens with an ``@`` (and dotted
tokens of a text that has one), dotted quads, and runs of seven digits and more with their separators.  A run that holds the
digits of base spans is cut at each of them; what is left between stays a node if it has seven digits.

Neighbouring nodes of a document are joined by a chain potential.  All distant occurrences of one value share a hub node, and hubs
of similar values (one edit apart, one the front or the end of the other, or the last seven digits in common; of eight characters
or seven digits and more) are joined, so evidence reaches every occurrence in a few steps, however many there are.  Every two similar
values are joined: directly, or, where three and more differ in one place alone or share their last seven digits, by a group node whose
two edges weigh as much as one direct edge.  Loopy sum-product passes run until the messages
settle, however far evidence has to go; a node outside every base span whose marginal for a kind reaches ``MIN_MARGINAL`` becomes a span of the method.
Base nodes are observed, so base spans always stay.

Training takes a bounded hash sample of at most ``TRAIN_DOCS`` whole documents that hold a digit.  What the field has to find has no label
there, so labels are made by withholding: a base span is broken in a way that the patterns miss (no plus sign, a digit less,
no dot ...), it and its broken form keep their kind, values of the same shapes with other characters get none; they and the nodes outside
base spans train a multinomial logistic unary on shape alone, and broken and whole form a pair for the table of similar values.

Defined results: null and empty texts have no spans (the digest of nothing is the hash of the empty string);
a very long text is scanned in linear time and memory; repeated rows are labelled independently; other columns are not read.
"""

from __future__ import annotations

import re
import zlib
from bisect import bisect_left
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from meltfield.llm._batches import bounded_sample, chunks, learn, map_text

KINDS = ("email", "ip", "card", "phone")
TRAIN_DOCS = 1500
#: Marginal of a span, passes over all messages before only unsettled ones are passed on, change of a message at which it is settled, damping.
MIN_MARGINAL, PASSES, SETTLED, DAMPING = 0.9, 60, 1e-4, 0.3
#: Digits in a run that is a node; characters in a token with an ``@`` that is one; characters from which values are compared; span of a chain edge.
MIN_DIGITS, MIN_TOKEN, MIN_VALUE, NEAR = 7, 5, 8, 40

_LOCAL = re.compile(r"[A-Za-z0-9._%+-]+")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_NOT_DIGIT = re.compile(r"[^0-9]")
_LOCAL_SET = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")


def luhn(digits: str) -> bool:
    odd = sum(map(int, digits[-1::-2]))
    even = sum((2 * d) // 10 + (2 * d) % 10 for d in map(int, digits[-2::-2]))
    return (odd + even) % 10 == 0


def emails(text: str) -> list[tuple[int, int]]:
    """Leftmost matches, found from each ``@`` outwards so that long runs cost linear time."""
    out, free, at = [], 0, text.find("@")
    while at >= 0:
        left = at
        while left > free and text[left - 1] in _LOCAL_SET:
            left -= 1
        m = _DOMAIN.match(text, at + 1) if left < at else None
        if m:
            out.append((left, m.end()))
        free = m.end() if m else at + 1
        at = text.find("@", free)
    return out


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """The pattern spans, by kind as listed, then start."""
    out = [("email", a, b) for a, b in emails(text)] if "@" in text else []
    for m in _IP.finditer(text):
        if all(int(p[-4:]) <= 255 and len(p.lstrip("0")) <= 3 for p in m[0].split(".")):
            out.append(("ip", m.start(), m.end()))
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 16:
            digits = _NOT_DIGIT.sub("", m[0])
            if 16 <= len(digits) <= 19 and luhn(digits):
                out.append(("card", m.start(), m.end()))
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 8 <= len(_NOT_DIGIT.sub("", m[0])) <= 15:
                out.append(("phone", m.start(), m.end()))
    return out


_EDGE = "()[]{}<>,;:!?\"'."
_MARK = re.compile(r"[0-9@]")
_RUN = re.compile(r"\+?\(?[0-9](?:[\x20().-]{0,2}[0-9])*")
_WITHIN = re.compile(r"[0-9][\x20().-]{0,2}[0-9]")
_QUAD = re.compile(r"(?<![0-9.])[0-9]+(?:\.[0-9]+){3}(?![0-9.])")
_DOTTED = re.compile(r"[A-Za-z0-9_%+-]+(?:\.[A-Za-z0-9_-]+)+")


def _at_tokens(text: str):
    """White-space tokens with an ``@``, without punctuation at their ends, in linear time."""
    last, at = 0, text.find("@")
    while at >= 0:
        a = at
        while a > last and not text[a - 1].isspace():
            a -= 1
        b = at + 1
        while b < len(text) and not text[b].isspace():
            b += 1
        last, at = b, text.find("@", b)
        while a < b and text[a] in _EDGE:
            a += 1
        while b > a and text[b - 1] in _EDGE:
            b -= 1
        if b - a >= MIN_TOKEN:
            yield a, b


def nodes(text: str, base: list[tuple[str, int, int]] = ()) -> list[tuple[int, int, str]]:
    """Values of the field in the order of the text: (start, end, text); no two overlap."""
    known = {digits for kind, a, b in base if kind != "email" and len(digits := _NOT_DIGIT.sub("", text[a:b])) >= MIN_DIGITS}  # digits of base spans
    heads, lengths = {v[:MIN_DIGITS] for v in known}, sorted({len(v) for v in known}, reverse=True)
    spans: list[tuple[int, int]] = []
    if "@" in text:
        spans += _at_tokens(text)
        spans += [(m.start(), m.end()) for m in _DOTTED.finditer(text) if m.end() - m.start() >= MIN_VALUE and not m[0].replace(".", "").isdigit()]
    spans += [(m.start(), m.end()) for m in _QUAD.finditer(text)]
    for m in _RUN.finditer(text):
        if m.end() - m.start() < MIN_DIGITS:
            continue
        places = [i for i in range(m.start(), m.end()) if text[i] in "0123456789"]
        if len(places) < MIN_DIGITS:
            continue
        cuts = [0]  # where values of base spans start and end, from left to right, the longest first
        digits = _NOT_DIGIT.sub("", m[0]) if known else ""
        if digits not in known:
            i = 0
            while i <= len(digits) - MIN_DIGITS:
                size = next((len(v) for n in lengths if (v := digits[i : i + n]) in known), 0) if digits[i : i + MIN_DIGITS] in heads else 0
                cuts += [i, i + size] if size else []
                i += size or 1
        if len(cuts) == 1:
            spans.append((m.start(), m.end()))
        else:
            spans += [(m.start() if first else places[i], places[j - 1] + 1) for first, i, j in zip([True] + [False] * len(cuts), cuts, [*cuts[1:], len(places)]) if j - i >= MIN_DIGITS]
    out, last = [], 0
    for a, b in sorted(spans, key=lambda s: (s[0], -s[1])):
        if a >= last:
            out.append((a, b, text[a:b]))
            last = b
    return out


def value_of(token: str) -> str:
    """What makes two nodes the same value: the digits of numbers but for quads, else the lower-cased text."""
    if any(c.isalpha() or c == "@" for c in token) or token.count(".") == 3:
        return token.lower()
    return _NOT_DIGIT.sub("", token)


def comparable(value: str) -> bool:
    """Whether a value is long enough to be similar to others."""
    return len(value) >= MIN_VALUE or (len(value) >= MIN_DIGITS and value.isdigit())


def similar(a: str, b: str) -> bool:
    """Whether two values are one edit apart, one the front or end of the other, or numbers that share the last seven digits."""
    if len(a) > len(b):
        a, b = b, a
    if not (comparable(a) and comparable(b)):
        return False
    if b.startswith(a) or b.endswith(a) or (a.isdigit() and b.isdigit() and a[-MIN_DIGITS:] == b[-MIN_DIGITS:]):
        return True
    if len(b) - len(a) > 1:
        return False
    i = 0
    while i < len(a) and a[i] == b[i]:
        i += 1
    return a[i + 1 :] == b[i + 1 :] if len(a) == len(b) else a[i:] == b[i + 1 :]


def shape(token: str, before: str, after: str) -> list[float]:
    """Unary features of a value between two characters; nothing here runs the patterns."""
    n, digits = len(token), sum(c.isdigit() for c in token)
    at, dots = token.count("@"), token.count(".")
    number = digits + sum(c in " ().-+" for c in token) == n
    return [
        1.0, float(at == 1), float(at == 1 and "." in token[token.find("@") :]), float(number and dots == 3), float(number and dots == 2), float(dots > 0 and not number and not at),
        *(float(number and low <= digits <= high) for low, high in ((7, 7), (8, 9), (10, 11), (12, 14), (15, 15), (16, 16), (17, 19), (20, n))),
        float(token[:1] == "+"), float("-" in token), float(" " in token), float("(" in token), float(before == "+"), float(before.isalnum()), float(after.isalnum()), digits / max(n, 1),
    ]


def cover(spans, found) -> tuple[np.ndarray, np.ndarray]:
    """For each node: 0 or 1 + the kind of a base span that covers most of it, and whether any base span touches it."""
    order = sorted(spans, key=lambda s: (s[1], s[2]))
    starts = [s[1] for s in order]
    reach = list(accumulate((s[2] for s in order), max))
    label, touched = np.zeros(len(found), np.int64), np.zeros(len(found), bool)
    for n, (a, b, _) in enumerate(found):
        i = bisect_left(starts, b) - 1
        while i >= 0 and reach[i] > a:
            kind, s, e = order[i]
            if e > a:
                touched[n] = True
                if 2 * (min(b, e) - max(a, s)) >= b - a:
                    label[n] = 1 + KINDS.index(kind)
            i -= 1
    return label, touched


#: Kinds of edges.
CHAIN, SAME, SIMILAR, GROUP = 0, 1, 2, 3

#: Base of the hashes that propose values one edit apart, its inverse modulo 2**64, and factors that tell lengths and places apart.
_BASE = 0x9E3779B97F4A7C15
_INVERSE, _BY_LENGTH, _BY_PLACE = (np.uint64(x) for x in (pow(_BASE, -1, 1 << 64), 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9))


def _one_edit(values: list[str]) -> tuple[set[tuple[int, int]], list[list[int]]]:
    """Of distinct values: all pairs of which one lacks a character of the other, and all groups that differ in one place alone.

    Hashes of the values without each of their characters propose them, in time and memory linear in the characters; the values decide.
    """
    length = np.array([len(v) for v in values], np.int64)
    stop = np.cumsum(length)
    row = np.repeat(np.arange(len(values)), length)
    place = np.arange(stop[-1]) - (stop - length)[row]
    power = np.cumprod(np.array([1] + [_BASE] * (int(length.max()) - 1), np.uint64))
    term = (np.frombuffer("".join(values).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64) + np.uint64(1)) * power[place]
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(term)])
    whole = total[stop] - total[stop - length]
    before = total[:-1] - total[(stop - length)[row]]
    by_length = length.astype(np.uint64) * _BY_LENGTH

    full = whole + by_length
    order = np.argsort(full, kind="stable")
    without = before + (whole[row] - before - term) * _INVERSE + by_length[row] - _BY_LENGTH
    low, high = (np.searchsorted(full[order], without, side) for side in ("left", "right"))
    proposed = {(v, k) for v, a, b in zip(*(x[high > low].tolist() for x in (row, low, high))) for k in range(a, b)}
    at = order.tolist()
    pairs = {(min(v, at[k]), max(v, at[k])) for v, k in proposed if len(values[at[k]]) + 1 == len(values[v]) and similar(values[at[k]], values[v])}

    rest = whole[row] - term + by_length[row] + place.astype(np.uint64) * _BY_PLACE
    order = np.argsort(rest, kind="stable")
    twin = rest[order][1:] == rest[order][:-1]
    order = order[np.append(twin, False) | np.insert(twin, 0, False)]
    groups: dict[tuple, list[int]] = {}
    for v, i in zip(row[order].tolist(), place[order].tolist()):
        groups.setdefault((values[v][:i], values[v][i + 1 :]), []).append(v)
    return pairs, [g for g in groups.values() if len(g) > 1]


def partners(values: list[str]) -> tuple[list[tuple[int, int]], list[list[int]]]:
    """All links between similar ones of distinct values: pairs, and groups of three and more of which every two are similar."""
    own = [h for h, v in enumerate(values) if comparable(v)]
    if len(own) < 2:
        return [], []
    pairs: set[tuple[int, int]] = set()
    for turn in (1, -1):  # in sorted order the fronts of a value stand before it; a value has fewer of them than characters
        fronts: list[tuple[str, int]] = []
        for v, h in sorted((values[h][::turn], h) for h in own):
            while fronts and not v.startswith(fronts[-1][0]):
                fronts.pop()
            pairs.update((min(h, other), max(h, other)) for _, other in fronts)
            fronts.append((v, h))
    ends = {h: values[h][-MIN_DIGITS:] for h in own if values[h].isdigit()}
    shared: dict[str, list[int]] = {}
    for h, end in ends.items():
        shared.setdefault(end, []).append(h)
    edits, groups = _one_edit([values[h] for h in own])
    pairs |= {(own[a], own[b]) for a, b in edits}
    groups = [[own[a] for a in g] for g in groups]
    # numbers with the same end have that link alone
    pairs = {(a, b) for a, b in pairs if a not in ends or ends[a] != ends.get(b)}
    groups = [g for g in groups if any(h not in ends or ends[h] != ends.get(g[0]) for h in g)] + [g for g in shared.values() if len(g) > 1]
    pairs.update((min(g), max(g)) for g in groups if len(g) == 2)
    return sorted(pairs), [g for g in groups if len(g) > 2]


def graph(found: list[tuple[int, int, str]], text: str = "", covered=None) -> tuple[int, list[tuple[int, int, int]]]:
    """Number of hubs and groups, which come behind the nodes, and edges (node, node, kind).

    A value that stands alone has no chain edge to what was cut out of the same run, unless a base span covers it: it does not speak against a known value.
    """
    n = len(found)
    hub: dict[str, int] = {}
    of = [hub.setdefault(value_of(token), len(hub)) for _, _, token in found]
    pairs, groups = partners(list(hub))
    links = np.bincount(np.array([*of, *(h for members in (*pairs, *groups) for h in members)], np.int64), minlength=len(hub))

    def apart(i):
        if covered is None or covered[i] or covered[i + 1] or min(links[of[i]], links[of[i + 1]]) > 1:
            return False
        return _WITHIN.fullmatch(text, found[i][1] - 1, found[i + 1][0] + 1) is not None

    edges = [(i, i + 1, CHAIN) for i in range(n - 1) if found[i + 1][0] - found[i][1] <= NEAR and not apart(i)]
    edges += [(i, n + h, SAME) for i, h in enumerate(of)]
    edges += [(n + a, n + b, SIMILAR) for a, b in pairs]
    edges += [(n + h, n + len(hub) + g, GROUP) for g, members in enumerate(groups) for h in members]
    return len(hub) + len(groups), edges


def broken(kind: str, value: str) -> list[str]:
    """Forms of a value that the patterns miss or that have another kind's length."""
    if kind == "email":
        name, _, host = value.partition("@")
        return [f"{name}@{host.split('.')[0]}", value.replace("@", "."), value.replace(".", ",")]
    if kind == "ip":
        return [value + "77", value.rpartition(".")[0] + value.rpartition(".")[2] + ".", value.replace(".", "-", 1)]
    if kind == "card":
        return [value[:-1], value[1:], value[:4] + value[5:], value[:-1] + str((int(value[-1]) + 1) % 10)]
    return [value[1:], value[2:].lstrip(" (.-"), value[:3] + value[4:]]


def grouped(value: str) -> str:
    """The digits of a value in groups of four."""
    digits = _NOT_DIGIT.sub("", value)
    return " ".join(digits[i : i + 4] for i in range(0, len(digits), 4))


def decoy(value: str) -> str:
    """Another value of the same shape."""
    return "".join(str((int(c) + 3 + i) % 10) if c in "0123456789" else chr((ord(c) - 97 + 5 + i) % 26 + 97) if "a" <= c <= "z" else c for i, c in enumerate(value))


class Learner:
    """Unary weights (features x labels) and log potentials of the kinds of edges, from documents and their base spans."""

    def __init__(self):
        k = 1 + len(KINDS)
        self.x, self.y, self.made = [], [], []
        self.tables = [np.ones((k, k)), np.full((k, k), 0.05) + np.eye(k), np.full((k, k), 0.05) + np.eye(k)]

    def add(self, piece: pa.RecordBatch) -> None:
        for text in piece.column("text").to_pylist():
            self.document(text or "")

    def document(self, text: str) -> None:
        base = base_spans(text)
        found = nodes(text, base)
        label, covered = cover(base, found)
        hubs, edges = graph(found, text, covered)
        groups: dict[int, list[int]] = {}
        of = np.full(len(found) + hubs, -1)  # a hub takes the label of its first occurrence
        of[: len(found)] = label
        known = np.concatenate([covered, np.zeros(hubs, bool)])
        for i, j, kind in edges:
            if kind == SAME:
                if of[j] < 0:
                    of[j], known[j] = of[i], known[i]
                else:
                    self.tables[SAME][of[i], of[j]] += 1
            elif kind == GROUP:
                groups.setdefault(j, []).append(i)
            elif known[i] == known[j]:  # a value beside a base span is not known to be none
                self.tables[kind][of[i], of[j]] += 1
        for members in groups.values():  # all pairs of a group, which weigh as much as one for two members
            for observed in (True, False):
                count = np.bincount([of[i] for i in members if known[i] == observed], minlength=1 + len(KINDS))
                self.tables[SIMILAR] += (np.outer(count, count) - np.diag(count)) / (2 * max(count.sum() - 1, 1))
        for i in np.flatnonzero(~covered):
            self._learn(found[i], text, 0, False)
        for kind, a, b in base:
            forms = broken(kind, text[a:b])
            pick = zlib.crc32(text[a:b].encode())
            form = forms[pick % len(forms)]
            if kind in ("card", "phone") and pick & 64:
                form = grouped(form)
            for v, label in ((form, 1 + KINDS.index(kind)), (decoy(form), 0), (text[a:b], 1 + KINDS.index(kind)), (decoy(text[a:b]), 0)):
                line = f"{v} @" if kind == "email" else v  # dotted tokens are nodes beside an @ only
                for part in nodes(line)[:1]:
                    self._learn(part, line, label, True)
                    if label and similar(value_of(part[2]), value_of(text[a:b])):
                        self.tables[SIMILAR][label, label] += 1

    def _learn(self, node: tuple[int, int, str], text: str, label: int, made: bool) -> None:
        self.x.append(_shape_in(node, text))
        self.y.append(label)
        self.made.append(made)

    def model(self) -> dict:
        k, d = 1 + len(KINDS), len(shape("", "", ""))
        w = np.zeros((d, k))
        if self.x:
            x, target, made = np.array(self.x), np.eye(k)[self.y], np.array(self.made)
            # the values of the text weigh as much as the made ones at most: a shape alone never speaks for a kind, nor too loud against it
            weight = np.where(made, 1.0, min(1.0, made.sum() / max((~made).sum(), 1)) if made.any() else 1.0)
            weight /= weight.sum()
            for _ in range(400):
                z = x @ w
                p = np.exp(z - z.max(1, keepdims=True))
                p /= p.sum(1, keepdims=True)
                w -= 1.0 * (x.T @ (weight[:, None] * (p - target)) + 1e-4 * w)

        def apart(t):
            """How much likelier neighbours' labels are than each by itself."""
            p = (t + t.T) / (2 * t.sum())
            return np.clip(np.log(p / (p.sum(1, keepdims=True) * p.sum(0, keepdims=True))), -1, 1)

        def agree(t):
            """How much rarer a pair of labels is than agreement on either, so that a rare label binds as much as a common one."""
            return np.clip(np.log((t + t.T) / (2 * np.sqrt(np.outer(np.diag(t), np.diag(t))))), -5, 0)

        def half(psi):
            """Log potential of each of two edges over a node between that make one of log potential ``psi``."""
            value, vector = np.linalg.eigh(np.exp(psi))
            return np.log(np.maximum((vector * np.sqrt(np.maximum(value, 0))) @ vector.T, 1e-6))

        pair = agree(self.tables[SIMILAR])
        return {"unary": w, "psi": np.stack([apart(self.tables[CHAIN]), agree(self.tables[SAME]), pair, half(pair)])}


def train(texts: list[str]) -> dict:
    """A model from texts in memory."""
    one = Learner()
    for text in texts:
        one.document(text or "")
    return one.model()


def marginals(unary: np.ndarray, edges: np.ndarray, psi: np.ndarray) -> np.ndarray:
    """Loopy sum-product: node log potentials (n, k), edges (m, 3) of two nodes and a kind, log potentials of the kinds; marginals (n, k)."""
    n, k = unary.shape
    edges = edges[np.argsort(edges[:, 2], kind="stable")]
    m, cuts = len(edges), np.searchsorted(edges[:, 2], np.arange(len(psi) + 1))
    src, dst = np.concatenate([edges[:, 0], edges[:, 1]]), np.concatenate([edges[:, 1], edges[:, 0]])
    back = np.concatenate([np.arange(m, 2 * m), np.arange(m)])
    strength = np.exp(psi)
    strength = np.concatenate([strength, strength.transpose(0, 2, 1)])
    cuts = np.concatenate([cuts, m + cuts[1:]])
    message = np.zeros((2 * m, k))

    def beliefs():
        return unary + np.stack([np.bincount(dst, message[:, c], n) for c in range(k)], axis=1)

    def passed(rows, belief, cuts, step):
        """Changes of the messages ``rows``, which ``cuts`` divides by their potentials."""
        out = belief[src[rows]] - message[back[rows]]
        out = np.exp(out - out.max(1, keepdims=True))
        new = np.empty_like(out)
        for e, (a, b) in enumerate(zip(cuts, cuts[1:])):
            new[a:b] = out[a:b] @ strength[e]
        new = np.log(new)
        new -= new.max(1, keepdims=True)
        return step * (new - message[rows])

    change = np.zeros((2 * m, k))
    for _ in range(PASSES if m else 0):
        change = passed(slice(None), beliefs(), cuts, 1 - DAMPING)
        message += change
        if np.abs(change).max() < SETTLED:
            break
    # what has not settled is passed on alone, as far as it changes anything; a message that swings moves less and less
    rows, belief, turns = np.arange(2 * m), beliefs(), np.zeros(2 * m, np.int64)
    by_source = np.argsort(src, kind="stable")
    first = np.searchsorted(src[by_source], np.arange(n + 1))
    while len(moved := np.unique(dst[rows[np.abs(change).max(1) >= SETTLED]])):
        size = first[moved + 1] - first[moved]
        rows = np.sort(by_source[np.repeat(first[moved] - np.cumsum(size) + size, size) + np.arange(size.sum())])
        change = passed(rows, belief, np.searchsorted(rows, cuts), (1 - DAMPING) * 0.5 ** (turns[rows] // PASSES)[:, None])
        message[rows] += change
        np.add.at(belief, dst[rows], change)
        turns[rows] += 1
    belief = beliefs()
    p = np.exp(belief - belief.max(1, keepdims=True))
    return p / p.sum(1, keepdims=True)


def _shape_in(node: tuple[int, int, str], text: str) -> list[float]:
    a, b, token = node
    return shape(token, text[a - 1 : a], text[b : b + 1])


def field_spans(text: str, base: list[tuple[str, int, int]], model: dict) -> list[tuple[str, int, int]]:
    """Spans that the field adds to the base spans of a text."""
    found = nodes(text, base)
    labels, covered = cover(base, found)
    if covered.all():
        return []
    hubs, edges = graph(found, text, covered)
    unary = np.array([_shape_in(x, text) for x in found]) @ model["unary"]
    observed = np.eye(1 + len(KINDS))[labels] * 60 - 60
    unary = np.concatenate([np.where(covered[:, None], observed, unary - unary.max(1, keepdims=True)), np.zeros((hubs, 1 + len(KINDS)))])
    p = marginals(unary, np.array(edges, np.int64), model["psi"])[: len(found)]
    best = p.argmax(1)
    return [(KINDS[best[i] - 1], *found[i][:2]) for i in range(len(found)) if best[i] and not covered[i] and p[i, best[i]] >= MIN_MARGINAL]


def all_spans(text: str, model: dict) -> tuple[list, list]:
    """(base spans, spans added by the field)."""
    if not text or _MARK.search(text) is None:
        return [], []
    base = base_spans(text)
    return base, field_spans(text, base, model)


def fit(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> dict:
    """A model from a bounded sample of the documents that hold a digit; one without training data if none does."""
    some = docs.select(F.col(text).alias("text")).where(F.col("text").rlike("[0-9]"))
    return learn(bounded_sample(some, TRAIN_DOCS), "text", Learner)


SPANS = "array<struct<kind:string,start:int,end:int,origin:string>>"


def detect(docs: DataFrame, model: dict | None = None, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``(doc_id, spans)`` of every whole text; spans are ordered by kind as listed, then start, offsets count code points."""
    model = model or fit(docs, doc_id, text)

    def run(piece: pa.RecordBatch) -> dict:
        rows = []
        for t in piece.column("text").to_pylist():
            base, more = all_spans(t or "", model)
            row = [(k, a, b, "base") for k, a, b in base] + [(k, a, b, "field") for k, a, b in more]
            row.sort(key=lambda s: (KINDS.index(s[0]), s[1], s[2]))
            rows.append([dict(zip(("kind", "start", "end", "origin"), s)) for s in row])
        kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("origin", pa.string())]))
        return {"doc_id": piece.column("doc_id"), "spans": pa.array(rows, kind)}

    kind = docs.select(doc_id).schema[0].dataType.simpleString()
    return map_text(docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")), "text", run, f"doc_id {kind}, spans {SPANS}")


def digest(found: DataFrame) -> DataFrame:
    """The query's columns: base counts, the hash of the base spans, and all spans joined."""
    base = F.filter("spans", lambda s: s["origin"] == "base")

    def joined(spans):
        return F.concat_ws(",", F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))))

    counts = [F.expr(f"size(filter(spans, s -> s.origin = 'base' and s.kind = '{k}'))").cast("long").alias(f"n_{k}") for k in KINDS]
    return found.select("doc_id", *counts, F.sha2(joined(base).cast("binary"), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"))


def base_counts(found: DataFrame) -> DataFrame:
    """The counts of base spans alone."""
    return digest(found).select("doc_id", *(f"n_{k}" for k in KINDS))


#: The rows of ``base_counts`` in DuckDB.
COUNTS_SQL = r"""
with m as (select doc_id, regexp_extract_all(coalesce(text, ''), '[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+') as email, regexp_extract_all(coalesce(text, ''), '[0-9]+(?:\.[0-9]+)(?:\.[0-9]+)(?:\.[0-9]+)') as ip,
  list_transform(regexp_extract_all(coalesce(text, ''), '[0-9](?:[ -]?[0-9])+'), lambda x: reverse(regexp_replace(x, '[ -]', '', 'g'))) as card,
  list_transform(regexp_extract_all(coalesce(text, ''), '\+[0-9][ ().0-9-]+[0-9]'), lambda x: regexp_replace(x, '[^0-9]', '', 'g')) as phone from documents)
select doc_id, len(email) as n_email,
len(list_filter(ip, lambda x: len(list_filter(string_split(x, '.'), lambda p: p::hugeint > 255)) = 0)) as n_ip,
len(list_filter(card, lambda x: length(x) between 16 and 19 and list_sum(list_transform(range(1, length(x) + 1), lambda i: case when i % 2 = 1 then substr(x, i, 1)::int else (2 * substr(x, i, 1)::int) // 10 + (2 * substr(x, i, 1)::int) % 10 end)) % 10 = 0)) as n_card,
len(list_filter(phone, lambda x: length(x) between 8 and 15)) as n_phone from m
"""


def redact(docs: DataFrame, model: dict | None = None) -> DataFrame:
    """``documents`` with every span replaced by its kind in brackets, overlapping spans as one; ``n_chars`` follows the text.

    Null texts stay null; other columns are kept as they are.
    """
    model = model or fit(docs)
    columns = docs.columns

    def run(batches):
        for batch in chunks(batches, "text"):
            texts = batch.column("text").to_pylist()
            new = []
            for t in texts:
                base, more = all_spans(t or "", model)
                new.append(_replace(t, spans) if (spans := [*base, *more]) else t)
            arrays = [pa.array(new, pa.string()) if c == "text" else batch.column(c) for c in columns]
            if "n_chars" in columns:
                old = batch.column("n_chars")
                n = [x if a == b else len(b) for x, a, b in zip(old.to_pylist(), texts, new)]
                arrays[columns.index("n_chars")] = pa.array(n, old.type)
            yield pa.RecordBatch.from_arrays(arrays, columns)

    return docs.mapInArrow(run, docs.schema)


def _replace(text: str, spans: list[tuple[str, int, int]]) -> str:
    out, last = [], 0
    for kind, a, b in sorted(spans, key=lambda s: (s[1], -s[2])):
        if a >= last:
            out += [text[last:a], f"[{kind.upper()}]"]
        last = max(last, b)
    return "".join([*out, text[last:]])
