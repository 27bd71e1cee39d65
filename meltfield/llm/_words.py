"""Words of many texts at once: spans and hashes of the runs between ASCII white space, by numpy."""

from __future__ import annotations

import hashlib

import numpy as np

_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True

#: Bytes hashed at once, which bounds the working arrays for texts of any length.
BLOCK = 1 << 20

_rng = np.random.Generator(np.random.PCG64(20240229))
_BYTE = _rng.integers(0, 1 << 64, 256, dtype=np.uint64)
_BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))


def _powers(base: np.uint64, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[0] = 1
    return np.cumprod(out, dtype=np.uint64)


_POWER, _INVERSE_POWER = _powers(_BASE, BLOCK + 1), _powers(_INVERSE, BLOCK + 1)


def mix(x: np.ndarray) -> np.ndarray:
    """Bijective scrambling of 64-bit values."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def spans(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends (bytes) of the words of all rows, in order, and the n + 1 word offsets of the rows."""
    n = len(raw)
    word = np.empty(n + 2, bool)
    word[0] = word[-1] = False
    np.logical_not(_SPACE[raw], out=word[1:-1])
    edge = word[1:] != word[:-1]  # edge[i]: a word starts or ends before byte i
    starts, ends = np.flatnonzero(edge & word[1:]), np.flatnonzero(edge & word[:-1])
    cut = offsets[1:-1]
    cut = cut[(cut > 0) & (cut < n)]
    cut = cut[word[cut] & word[cut + 1]] if len(cut) else cut  # rows that meet within a run are two words
    if len(cut):
        cut = np.unique(cut)
        starts, ends = np.sort(np.concatenate([starts, cut])), np.sort(np.concatenate([ends, cut]))
    return starts, ends, np.searchsorted(starts, offsets)


def hashes(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each word's bytes."""
    out = np.empty(len(starts), np.uint64)
    at = 0
    while at < len(starts):
        low = starts[at]
        stop = int(np.searchsorted(ends, low + BLOCK, side="right"))
        if stop <= at:  # one word longer than a block
            out[at] = _long(raw[low : ends[at]])
            at += 1
            continue
        part = raw[low : ends[stop - 1]]
        total = np.zeros(len(part) + 1, np.uint64)
        np.cumsum(_BYTE[part] * _POWER[: len(part)], out=total[1:])
        s, e = starts[at:stop] - low, ends[at:stop] - low
        out[at:stop] = (total[e] - total[s]) * _INVERSE_POWER[s]
        at = stop
    return mix(out + (ends - starts).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))


def _long(part: np.ndarray) -> np.uint64:
    total, scale = np.uint64(0), np.uint64(1)
    with np.errstate(over="ignore"):
        for at in range(0, len(part), BLOCK):
            block = part[at : at + BLOCK]
            total += scale * np.sum(_BYTE[block] * _POWER[: len(block)], dtype=np.uint64)
            scale *= _POWER[len(block)]
    return total


def other_hashes(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A second 64-bit hash of each word, of another kind than ``hashes``: a chain over the word's eight-byte parts.

    Words of up to eight bytes have hashes of their own; words of more than 256 bytes are hashed one by one.
    """
    n = ends - starts
    out = mix(n.astype(np.uint64) + np.uint64(0x51ED270B9F652295))
    if not len(n):
        return out
    view = np.lib.stride_tricks.sliding_window_view(np.concatenate([raw, np.zeros(8, np.uint8)]), 8)
    active = np.flatnonzero(n <= 256)
    for k in range(32):
        active = active[n[active] > 8 * k]
        if not len(active):
            break
        part = np.ascontiguousarray(view[starts[active] + 8 * k]).view("<u8").ravel()
        cut = np.uint64(64) - np.uint64(8) * np.minimum(n[active] - 8 * k, 8).astype(np.uint64)
        out[active] = mix((out[active] ^ (part << cut >> cut)) * np.uint64(0xD6E8FEB86659FD93) + np.uint64(k))
    for i in np.flatnonzero(n > 256):
        out[i] = int.from_bytes(hashlib.blake2b(raw[starts[i] : ends[i]].tobytes(), digest_size=8).digest(), "little")
    return out


def windows(h: np.ndarray, width: int, multiplier: int) -> np.ndarray:
    """Polynomial hash of the ``width`` consecutive values from each position; the last ``width - 1`` entries are meaningless."""
    c = np.uint64(multiplier | 1)
    out, done, power = None, 0, {}
    step, size, scale = h.copy(), 1, c
    left = width
    with np.errstate(over="ignore"):
        while left:
            if left & 1:
                if out is None:
                    out, done = step.copy(), size
                else:
                    out = out * scale + _shifted(step, done)
                    done += size
            left >>= 1
            if left:
                step = step * scale + _shifted(step, size)
                size, scale = size * 2, scale * scale
    return mix(out)


def _shifted(x: np.ndarray, by: int) -> np.ndarray:
    out = np.zeros_like(x)
    if by < len(x):
        out[: len(x) - by] = x[by:]
    return out
