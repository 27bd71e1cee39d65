"""Token ids in a binary format, coded by an adaptive context-mixing range coder.

Text is encoded by the tokenizers library.  The ids of whole documents, in ascending doc_id order, fill frames; a frame
is cut into blocks of ``BLOCK`` ids.  Every block starts from the same model, that of its frame's head, and its coded words
carry a CRC-32 of the ids, so any block can be decoded, and any damage found, by itself.

Model: three distributions of the next id are mixed.

* Order 0: how often each id occurs in the frame, quantised, written in the frame's head.
* Order 1: the last ``WAYS`` ids that followed the previous id in this block, in a list where each hit moves an id towards the
  front.  Adaptive shares of the places, and of "none of them", are learned for each state of a list (places in use, where the
  last hit was).
* Order 2: the id that last followed the two previous ids in this block.  The weight of this prediction adapts for each length
  of its run of hits.

The probability of a place of the list is (1 - weight) times its share plus, for the place of order 2's id, the weight; the
rest goes to order 0.  A range coder with 63-bit range, 32-bit words and carries codes the outcome.  All arithmetic is in whole
numbers, so every machine decodes alike.  All blocks of a chunk are coded in step, one id of each at a time, on numpy arrays.

Files: Parquet rows ``(part, frame, start, n_tokens, docs, payload)`` written by a job sorted by doc_id; ``start`` counts
the ids before the frame within its part.  Payload: see ``pack``.

Defined results: ids are 0 to ``MAX_ID`` (a vocabulary beyond raises ``ValueError``); null and empty texts are the end id alone;
null ids sort last; rows that repeat a doc_id are ordered by a hash of the text and each keeps its place; very long texts make
a frame of their own; an empty table gives no frames; extra columns are not read; a doc_id that is no whole number raises.
"""

from __future__ import annotations

import hashlib
import os
import struct
import zlib
from array import array

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from meltfield.llm._batches import chunks, table_bytes, written
from meltfield.llm._words import mix
from meltfield.llm.op07_bpe import LETTER, WHITE, classes

#: Ids in a block, ids from which a frame is closed, ids coded together.
BLOCK, FRAME, TOGETHER = 4096, 1 << 20, 1 << 23
MAX_ID = (1 << 17) - 1
#: Places of a list of order 1; lists and predictions of order 2 that a block remembers; greatest run of hits that counts.
WAYS, LIST_BITS, SECOND_BITS, TOP = 8, 10, 12, 7
#: Bits of the shares of the outcomes, least share, speed of learning (a power of two) of shares and weights, greatest weight.
SHARE_BITS, LEAST, LEARN, WEIGH = 14, 16, 5, 5
ONE = 1 << SHARE_BITS
MOST = ONE - ONE // LEAST
END_ID = 0
MAGIC = b"MFT2"
#: Pre-tokens kept in each worker before those met in the fewest calls are forgotten, and the greatest length of one that is kept then.
CACHE_WORDS, LONG_WORD = 800_000, 64
#: Characters split, and pre-tokens joined, at once: their arrays stay in the processor's cache.
SPLIT, SPLIT_WORDS = 1 << 16, 1 << 15
#: Unknown pre-tokens in one call of the library.
JOINED = 500
#: Characters tokenised at once; input bytes for which there is a partition; rows of one id from which they are dealt by their texts.
PIECE, PARTITION_BYTES, HOT_ROWS = 8 << 20, 128 << 20, 10_000
#: Rows of texts that go to a worker at once: both sides hold them outside the heap.
BATCH_ROWS = 1000
_BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"

#: The low end has 63 bits and one for a carry; a word leaves it when the range falls below 31 bits.
_U31, _U32 = np.uint64(31), np.uint64(32)
_LOW, _FULL = np.uint64(1 << 31), np.uint64(1 << 63)
_REST, _HALF = np.uint64((1 << 31) - 1), np.uint64((1 << 32) - 1)

#: A list's state is 4 * places in use + where the last outcome was: the front, the next two places, further back, none.
STATES = 4 * (WAYS + 1)
_NONE = WAYS
_WHERE = [0, 1, 1, *[2] * (WAYS - 3), 3]


def _start_shares() -> np.ndarray:
    """Bounds (states x WAYS + 2) of the shares of the places and of none, from which every block starts learning."""
    out = np.zeros((STATES, WAYS + 2), np.int32)
    for state in range(STATES):
        used, where = divmod(state, 4)
        none = 100 if not used else min(97, (35, 50, 60, 80)[where] + 10 * (WAYS - used) // WAYS)  # of 100
        whole = sum(840 // (j + 1) for j in range(used))  # places get shares as 1, 1/2, 1/3 ...
        below = 0
        for j in range(WAYS):
            below += (100 - none) * (840 // (j + 1)) * (ONE - LEAST * (WAYS + 1)) // (100 * whole) if j < used else 0
            out[state, j + 1] = below + LEAST * (j + 1)
        out[state, WAYS + 1] = ONE
    return out


def _targets() -> np.ndarray:
    """For each outcome the inner bounds, as one value, that give it all but the least shares of the others."""
    k = np.arange(WAYS + 2)
    out = LEAST * k[None, :] + (k[None, :] > np.arange(WAYS + 1)[:, None]) * (ONE - LEAST * (WAYS + 1))
    return np.ascontiguousarray(out[:, 1:-1].astype(np.int16)).reshape(-1).view(np.complex128)


def _moves() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For state * (WAYS + 1) + outcome: the next state, the place that gives up its id, and the place that the coded id takes."""
    state, leaves, takes = (np.zeros((STATES, WAYS + 1), np.int64) for _ in range(3))
    for s in range(STATES):
        used = s // 4
        for j in range(WAYS + 1):
            place = min(used, WAYS - 1)
            state[s, j] = 4 * (min(used + 1, WAYS) if j == _NONE else used) + _WHERE[j]
            leaves[s, j] = place if j == _NONE else j
            takes[s, j] = (place + 1) // 2 if j == _NONE else j // 2
    return state.astype(np.uint8).ravel(), leaves.ravel(), takes.ravel()


_SHARES, _TARGET = _start_shares(), _targets()
_NEXT, _LEAVES, _TAKES = _moves()
#: Weights of order 2 by run of hits at the start of a block; without a prediction there is none.
_WEIGHTS = np.array([0, *(ONE * k // 16 for k in (3, 7, 9, 10, 11, 12, 13))], np.int32)


class Frequencies:
    """Order 0 of a frame: its ids by falling frequency and their shares of ``1 << bits``."""

    def __init__(self, ids: np.ndarray, freq: np.ndarray):
        order = np.lexsort((ids, -freq))
        self.ids, self.freq = ids[order].astype(np.int64), freq[order].astype(np.int64)
        self.below = np.cumsum(self.freq) - self.freq
        self.bits = int(self.freq.sum()).bit_length() - 1

    @classmethod
    def of(cls, ids: np.ndarray) -> Frequencies:
        count = np.bincount(ids)
        found = np.flatnonzero(count)
        if found[-1] > MAX_ID:
            raise ValueError(f"ids must not exceed {MAX_ID}")
        whole = 1 << max(16, min(17, len(found).bit_length() + 2))
        freq = 1 + count[found] * (whole - len(found)) // len(ids)
        freq[np.argsort(-count[found], kind="stable")[: whole - int(freq.sum())]] += 1
        return cls(found, freq)

    def symbols(self, ids: np.ndarray) -> np.ndarray:
        """Places of ids in the order of frequency."""
        place = np.zeros(int(self.ids.max()) + 1, np.int32)
        place[self.ids] = np.arange(len(self.ids))
        return place[ids]

    def head(self) -> bytes:
        order = np.argsort(self.ids)
        step = np.diff(self.ids[order], prepend=0).astype("<u4")
        planes = np.stack([step, self.freq[order].astype("<u4")]).view(np.uint8).reshape(2, -1, 4).transpose(0, 2, 1)
        return struct.pack("<I", len(order)) + planes.tobytes()

    @classmethod
    def from_head(cls, data: bytes) -> Frequencies:
        (n,) = struct.unpack_from("<I", data)
        planes = np.frombuffer(data, np.uint8, 8 * n, 4).reshape(2, 4, n).transpose(0, 2, 1)
        step, freq = np.ascontiguousarray(planes).view("<u4").reshape(2, n)
        return cls(np.cumsum(step.astype(np.int64)), freq.astype(np.int64))


#: Four times the same 16-bit number in a 64-bit one; symbols from ``FREE`` on are not remembered, and stand for a free place.
_FOURFOLD = np.uint64(0x0001000100010001)
FREE = 0xFFFF


class _Model:
    """Orders 1 and 2 of many independent blocks, coded in step.

    A list and the inner bounds of its shares are rows of eight 16-bit numbers; rows are moved as one 16-byte value each.  What
    is taken from the tables becomes 64-bit numbers, and conditions become masks of all bits or none, as numpy is slow on mixed types.
    """

    def __init__(self, lanes: int):
        self.lists = np.full((lanes << LIST_BITS) * WAYS, FREE, np.uint16).view(np.complex128)
        self.states = np.zeros(lanes << LIST_BITS, np.uint8)
        self.shares = np.tile(_SHARES[:, 1:-1].astype(np.int16), (lanes, 1)).reshape(-1).view(np.complex128)
        self.weights = np.tile(_WEIGHTS.astype(np.int64), lanes)
        self.second = np.full(lanes << SECOND_BITS, FREE - 1 << 3, np.int32)  # symbol * 8 + run of hits
        self.last = np.zeros(lanes, np.int64)
        self.mark = np.zeros(lanes, np.uint32)  # what the symbol before the last adds to the hash
        lane = np.arange(lanes, dtype=np.int64)
        self.list0, self.second0, self.state0, self.weight0, self.row0 = lane << LIST_BITS, lane << SECOND_BITS, lane * STATES, lane * (TOP + 1), lane * 2 * WAYS + WAYS - 1
        self.own0 = lane * WAYS
        self.eight = np.empty((lanes, 2), np.uint64)
        # all bounds of a lane lie from its ``row0`` on: 0, the inner ones, and ONE, where the next lane begins
        self.bound = np.zeros((lanes + 1) * 2 * WAYS, np.int16)
        self.bound[:: 2 * WAYS] = ONE
        self.inner = self.bound.view(np.complex128)[1::2]

    def predict(self, m: int) -> None:
        """Distributions of the first ``m`` lanes: bounds of order 1's shares, order 2's place in the list and weight."""
        last = self.last[:m]
        self.at1 = self.list0[:m] + (last & ((1 << LIST_BITS) - 1))
        self.hash = last.astype(np.uint32) * np.uint32(0x9E3779B1)
        self.at2 = self.second0[:m] + (((self.hash ^ self.mark[:m]) * np.uint32(0x27D4EB2F)) >> np.uint32(32 - SECOND_BITS)).astype(np.int64)
        self.rows = self.lists.take(self.at1)
        self.list = self.rows.view(np.uint16)
        self.state = self.states.take(self.at1).astype(np.int64)
        self.row_at = self.state0[:m] + self.state
        row = self.shares.take(self.row_at)
        self.inner[:m] = row
        self.row = row.view(np.int16)
        entry = self.second.take(self.at2).astype(np.int64)
        self.guess = entry >> 3
        self.place2 = self.place_of(self.guess)
        self.run = entry & TOP
        self.guessed = (self.place2 - _NONE) >> 63
        self.weight_at = self.weight0[:m] + (self.run & self.guessed)
        self.weight = self.weights.take(self.weight_at)
        self.rest = ONE - self.weight

    def eightfold(self, x: np.ndarray) -> np.ndarray:
        """The low 16 bits of each number, eight times."""
        out = self.eight[: len(x)]
        four = (x & 0xFFFF).astype(np.uint64) * _FOURFOLD
        out[:, 0] = four
        out[:, 1] = four
        return out.reshape(-1).view(np.uint16)

    def place_of(self, x: np.ndarray) -> np.ndarray:
        """Place of each lane's symbol in its list; ``_NONE`` if it is not there (a symbol stands in a list once)."""
        hit = (self.list == self.eightfold(x)).view(np.uint64)
        return (np.bitwise_count(hit - np.uint64(1)) >> np.uint8(3)).astype(np.int64)

    def bounds(self, place: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Mixed lower bound and share of an outcome of each lane."""
        at = self.row0[: len(place)] + place
        before = self.place2 - place
        low = ((self.bound.take(at).astype(np.int64) * self.rest) >> SHARE_BITS) + (self.weight & (before >> 63))
        high = ((self.bound.take(at + 1).astype(np.int64) * self.rest) >> SHARE_BITS) + (self.weight & ((before - 1) >> 63))
        return low.view(np.uint64), (high - low).view(np.uint64)

    def outcome(self, value: np.ndarray) -> np.ndarray:
        """The outcome whose mixed share holds ``value``."""
        at = self.row0[: len(value)] + self.place2
        low = (self.bound.take(at).astype(np.int64) * self.rest) >> SHARE_BITS
        high = ((self.bound.take(at + 1).astype(np.int64) * self.rest) >> SHARE_BITS) + self.weight
        own = ((low - 1 - value) & (value - high)) >> 63  # order 2's place
        # without order 2's part, the greatest bound of order 1 that a place may start at
        alone = (((value - (self.weight & ~((value - high) >> 63))) << SHARE_BITS) | (ONE - 1)).astype(np.uint32) // self.rest.astype(np.uint32)
        place = np.bitwise_count((self.row.view(np.uint16) <= self.eightfold(alone)).view(np.uint64)).astype(np.int64)
        return place ^ ((place ^ self.place2) & own)

    def update(self, m: int, x: np.ndarray, place: np.ndarray) -> None:
        """Learns that ``x`` came, at ``place`` of the list."""
        move = self.state * (WAYS + 1) + place
        self.shares[self.row_at] = (self.row + ((_TARGET.take(place).view(np.int16) - self.row) >> LEARN)).view(np.complex128)
        right = (((self.place2 ^ place) - 1) >> 63) & self.guessed
        self.weights[self.weight_at] = self.weight + (((right & MOST) - self.weight) >> WEIGH)
        same = ((self.guess ^ x) - 1) >> 63
        self.second[self.at2] = (((x << 3) | 1) + (same & np.minimum(self.run, TOP - 1))).astype(np.int32)
        at = self.own0[:m]
        takes = at + _TAKES.take(move)
        self.list[at + _LEAVES.take(move)] = self.list.take(takes)
        self.list[takes] = np.minimum(x, FREE).astype(np.uint16)
        self.lists[self.at1] = self.rows
        self.states[self.at1] = _NEXT.take(move)
        np.right_shift(self.hash, np.uint32(7), out=self.mark[:m])
        self.last[:m] = x


#: Blocks that are turned together.
_TILE = 16


class _Lanes:
    """Blocks by falling size, their active number at each step, and their frames' order 0."""

    def __init__(self, sizes: np.ndarray, frame: np.ndarray, tables: list[Frequencies]):
        self.order = np.argsort(-sizes, kind="stable")
        self.sizes = sizes[self.order]
        self.first = (np.cumsum(sizes) - sizes)[self.order]
        self.top = int(self.sizes[0])
        self.active = np.searchsorted(-self.sizes, -np.arange(self.top), side="left").tolist()
        own = frame[self.order]
        width = np.array([len(t.ids) for t in tables])
        self.base = (np.cumsum(width) - width)[own]
        self.bits = np.array([t.bits for t in tables], np.uint64)[own]
        self.shift = self.bits + np.uint64(SHARE_BITS)
        # by base + symbol: the part of order 0, its lower bound in the high half
        self.zero = np.concatenate([(t.below << 32) | t.freq for t in tables]).astype(np.uint64)
        self.whole = np.uint64(1) << self.bits
        self.inverse0 = np.array([0, *np.cumsum([1 << t.bits for t in tables])])[own]
        self.wide = int(width.max()) > FREE

    def by_step(self, symbols: np.ndarray) -> np.ndarray:
        """Symbols of the blocks one after the other as (steps x lanes)."""
        out = np.zeros((self.top, len(self.order)), np.int32)
        for k in range(0, len(self.order), _TILE):
            some = np.zeros((min(_TILE, len(self.order) - k), self.top + _TILE), np.int32)  # rows of a width that does not fall on the same cache lines
            for row, a, n in zip(some, self.first[k : k + _TILE].tolist(), self.sizes[k : k + _TILE].tolist()):
                row[:n] = symbols[a : a + n]
            out[:, k : k + _TILE] = some[:, : self.top].T
        return out

    def by_block(self, steps: np.ndarray) -> np.ndarray:
        """The reverse."""
        out = np.zeros(int(self.sizes.sum()), np.int32)
        for k in range(0, len(self.order), _TILE):
            some = np.zeros((min(_TILE, len(self.order) - k), self.top + _TILE), np.int32)
            some[:, : self.top] = steps[:, k : k + _TILE].T
            for row, a, n in zip(some, self.first[k : k + _TILE].tolist(), self.sizes[k : k + _TILE].tolist()):
                out[a : a + n] = row[:n]
        return out


def encode_blocks(symbols: np.ndarray, sizes: np.ndarray, frame: np.ndarray, tables: list[Frequencies]) -> list[bytes]:
    """Coded 32-bit words of each block; ``symbols`` holds the blocks one after the other, places in the order of their frame's table."""
    if not len(sizes):
        return []
    by = _Lanes(sizes, frame, tables)
    lanes = len(sizes)
    steps = by.by_step(symbols)
    del symbols
    model = _Model(lanes)
    low, span = np.zeros(lanes, np.uint64), np.full(lanes, _FULL, np.uint64)
    height = by.top + 6  # an id takes a word at most
    words = np.zeros(height * lanes, np.uint64)  # a word holds its carry until the end
    at = np.arange(lanes, dtype=np.int64)
    for t, m in enumerate(by.active):
        x = steps[t, :m].astype(np.int64)
        model.predict(m)
        place = model.place_of(x)
        if by.wide:
            place[x >= FREE] = _NONE
        cum, freq = model.bounds(place)
        r = span[:m] >> by.shift[:m]
        bits = by.bits[:m]
        cum <<= bits
        share = freq << bits
        none = np.flatnonzero(place == _NONE)  # these go on to order 0
        part, own = by.zero.take(by.base.take(none) + x.take(none)), freq.take(none)
        cum[none] += (part >> _U32) * own
        share[none] = (part & _HALF) * own
        new = low[:m]
        cum *= r
        new += cum
        r *= share
        span[:m] = r
        need = np.flatnonzero(r < _LOW)
        # a word that leaves takes its carry with it
        here, some = at.take(need), new.take(need)
        words[here] = some >> _U31
        low[need] = (some & _REST) << _U32
        span[need] = r.take(need) << _U32
        at[need] = here + lanes
        model.update(m, x, place)
    for _ in range(2):  # the rest of the low end
        words[at] = low >> _U31
        low = (low & _REST) << _U32
        at += lanes
    height = int(at.max()) // lanes  # rows in use
    words = words[: height * lanes].reshape(height, lanes)
    for j in range(height - 1, 0, -1):
        over = words[j] >> _U32
        if over.any():
            words[j - 1] += over
    small = np.ascontiguousarray(words.astype("<u4").T)
    length = at // lanes
    out: list = [b""] * lanes
    for k, i in enumerate(by.order.tolist()):
        out[i] = small[k, : length[k]].tobytes()
    return out


def decode_blocks(coded: list[bytes], sizes: np.ndarray, frame: np.ndarray, tables: list[Frequencies]) -> np.ndarray:
    """Symbols of the blocks, one after the other."""
    if not len(sizes):
        return np.zeros(0, np.int32)
    by = _Lanes(sizes, frame, tables)
    lanes = len(sizes)
    inverse = np.concatenate([np.repeat(np.arange(len(t.ids), dtype=np.int32), t.freq) for t in tables])
    steps = np.zeros((by.top, lanes), np.int32)
    length = np.array([len(coded[i]) // 4 for i in by.order.tolist()], np.int64)
    start = np.cumsum(length) - length
    words = np.frombuffer(b"".join([coded[i] for i in by.order.tolist()]) + b"\0" * 16, "<u4")
    model = _Model(lanes)
    # the code less the low end has 63 bits: all of a word and all but the last bit of the next, which waits in ``spare``
    second = words.take(start + 1).astype(np.uint64)
    ahead, spare = (words.take(start).astype(np.uint64) << _U31) | (second >> np.uint64(1)), second & np.uint64(1)
    at, span = start + 2, np.full(lanes, _FULL, np.uint64)
    limit = (np.uint64(1) << by.shift) - np.uint64(1)
    for t, m in enumerate(by.active):
        model.predict(m)
        bits = by.bits[:m]
        r = span[:m] >> by.shift[:m]
        value = np.minimum(ahead[:m] // r, limit[:m])
        place = model.outcome((value >> bits).view(np.int64))
        cum, freq = model.bounds(place)
        cum <<= bits
        share = freq << bits
        x = model.list.take(model.own0[:m] + np.minimum(place, WAYS - 1)).astype(np.int64)
        none = np.flatnonzero(place == _NONE)  # of these the part of order 0 that holds the value
        own, begin = freq.take(none), cum.take(none)
        part = np.minimum((value.take(none) - begin) // own, by.whole.take(none) - np.uint64(1)).view(np.int64)
        zero = inverse.take(by.inverse0.take(none) + part).astype(np.int64)
        x[none] = zero
        part = by.zero.take(by.base.take(none) + zero)
        cum[none] = begin + (part >> _U32) * own
        share[none] = (part & _HALF) * own
        cum *= r
        rest = ahead[:m]
        rest -= cum
        r *= share
        span[:m] = r
        need = np.flatnonzero(r < _LOW)
        here = at.take(need)
        word = words.take(np.minimum(here, len(words) - 1)).astype(np.uint64)
        ahead[need] = (rest.take(need) << _U32) | (spare.take(need) << _U31) | (word >> np.uint64(1))
        spare[need] = word & np.uint64(1)
        span[need] = r.take(need) << _U32
        at[need] = here + 1
        steps[t, :m] = x
        model.update(m, x, place)
    return by.by_block(steps)


def block_sizes(n: int) -> list[int]:
    return [BLOCK] * (n // BLOCK) + ([n % BLOCK] if n % BLOCK else [])


def encode_frames(frames: list[np.ndarray]) -> list[bytes]:
    """Payloads of frames (the ids of each), coded together."""
    tables = [Frequencies.of(ids) for ids in frames]
    sizes = [block_sizes(len(ids)) for ids in frames]
    frame = np.repeat(np.arange(len(frames)), [len(s) for s in sizes])
    coded, at, out = encode_blocks(np.concatenate([t.symbols(ids) for t, ids in zip(tables, frames)]) if frames else np.zeros(0, np.int32), np.array([s for x in sizes for s in x], np.int64), frame, tables), 0, []
    for table, ids, s in zip(tables, frames, sizes):
        out.append(pack(ids, table, coded[at : at + len(s)]))
        at += len(s)
    return out


def decode_frames(payloads: list[bytes]) -> list[np.ndarray]:
    """Ids of each payload; damage raises ``ValueError``."""
    unpacked = [unpack(p) for p in payloads]
    sizes = [block_sizes(n) for n, *_ in unpacked]
    frame = np.repeat(np.arange(len(payloads)), [len(s) for s in sizes])
    tables = [u[1] for u in unpacked]
    symbols, at, out = decode_blocks([c for u in unpacked for c in u[2]], np.array([s for x in sizes for s in x], np.int64), frame, tables), 0, []
    for n, table, _, sums in unpacked:
        ids = table.ids.astype(np.int32).take(symbols[at : at + n], mode="clip")  # damage may decode to symbols that the table lacks
        verify(ids, sums)
        out.append(ids)
        at += n
    return out


def pack(ids: np.ndarray, table: Frequencies, coded: list[bytes]) -> bytes:
    """A payload: magic, number of ids and blocks, bytes of the head and their CRC-32, the head (order 0, deflated), then for each block its bytes and CRC-32, then the coded blocks."""
    sums = [zlib.crc32(ids[k * BLOCK : (k + 1) * BLOCK].astype("<u4").tobytes()) for k in range(len(coded))]
    head = zlib.compress(table.head(), 6)
    return MAGIC + struct.pack("<QIII", len(ids), len(coded), len(head), zlib.crc32(head)) + head + b"".join(struct.pack("<II", len(c), s) for c, s in zip(coded, sums)) + b"".join(coded)


def unpack(payload: bytes) -> tuple[int, Frequencies, list[bytes], list[int]]:
    """Number of ids, order 0, coded blocks, checksums."""
    if payload[:4] != MAGIC:
        raise ValueError("not a token frame")
    n, blocks, size, check = struct.unpack_from("<QIII", payload, 4)
    at = 24 + size
    if zlib.crc32(payload[24:at]) != check or len(payload) < at + 8 * blocks or blocks != len(block_sizes(n)):
        raise ValueError("the head of the frame is damaged")
    table = Frequencies.from_head(zlib.decompress(payload[24:at]))
    lengths = struct.unpack_from(f"<{2 * blocks}I", payload, at)
    at, coded = at + 8 * blocks, []
    for size in lengths[::2]:
        coded.append(payload[at : at + size])
        at += size
    if at != len(payload):
        raise ValueError("the frame is cut")
    return n, table, coded, list(lengths[1::2])


def verify(ids: np.ndarray, sums: list[int]) -> None:
    for k, s in enumerate(sums):
        if zlib.crc32(ids[k * BLOCK : (k + 1) * BLOCK].astype("<u4").tobytes()) != s:
            raise ValueError(f"block {k} is damaged")


def pretokens(points: np.ndarray, begins: np.ndarray) -> np.ndarray:
    """True where a pre-token of byte-level BPE starts, for the code points of texts that begin at ``begins``.

    The rule in words: runs of letters, of numbers, or of other signs take one space before them; of white space, the last
    character before a run stands apart; an apostrophe that starts a run of its own takes s, t, m, d, re, ve or ll.
    """
    n = len(points)
    kind = classes().take(points)
    new = np.zeros(n + 1, bool)
    new[begins] = True
    new[n] = True
    edge = new.copy()  # starts and the end of texts
    new[1:n] |= kind[1:] != kind[:-1]
    white = kind == WHITE
    # a space goes with the run behind it
    taken = np.zeros(n, bool)
    taken[1:] = ~white[1:] & (points[:-1] == 0x20) & ~edge[1:n]
    run = new.copy()
    new[:n] &= ~taken
    last = np.zeros(n, bool)
    last[:-1] = white[:-1] & ~white[1:] & ~edge[1:n]
    new[:n] |= last
    quote = np.flatnonzero((points[:-1] == 0x27) & run[: n - 1] & ~taken[:-1] & (kind[1:] == LETTER) & ~edge[1:n]) if n else np.zeros(0, np.int64)
    if len(quote):
        a = points[quote + 1]
        b = np.where((quote + 2 < n) & ~edge[np.minimum(quote + 2, n)], points[np.minimum(quote + 2, n - 1)], 0)
        one = np.isin(a, list(map(ord, "stmd")))
        two = ((a == ord("r")) & (b == ord("e"))) | ((a == ord("v")) & (b == ord("e"))) | ((a == ord("l")) & (b == ord("l")))
        hit = one | two
        stop = (quote + 2 + two)[hit]
        new[quote[hit] + 1] = False
        inside = stop[(stop < n) & ~edge[np.minimum(stop, n)]]
        new[inside[kind[inside] == LETTER]] = True
    return new[:n]


class Encoder:
    """Whole texts to ids by the library; each pre-token is given to it once while it is remembered."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.special = [t.content for t in self.library.get_added_tokens_decoder().values()]
        known = self.library.get_vocab()
        if max(known.values()) > MAX_ID:
            raise ValueError(f"the vocabulary has ids beyond {MAX_ID}")
        self.width = np.zeros(max(known.values()) + 1, np.int64)  # bytes of each id: a character of the byte alphabet each
        for string, i in known.items():
            self.width[i] = len(string)
        # known pre-tokens, their hashes, the place and number of the ids of each, their ids, the call that last met each, and in how many it was met
        self.words, self.keys = pa.array([], pa.binary()), np.zeros(0, np.uint64)
        self.first, self.length, self.flat, self.met, self.often = (np.zeros(0, np.int32) for _ in range(5))
        self.slots = np.zeros(0, np.int32)  # an open hash table of the places of the known, -1 if free
        self.calls = 0

    def _ids(self, text: str) -> np.ndarray:
        return np.array(self.library.encode(text, add_special_tokens=False).ids, np.int32)

    def _ask(self, words: list[bytes]) -> list[bytes]:
        """Ids of unknown pre-tokens.  Those of a space and letters split the same way when joined, so many go in one call; the
        bytes of their ids tell where each ends."""
        out: list = [None] * len(words)
        runs = [i for i, w in enumerate(words) if w[:1] == b" " and w[1:].decode().isalpha()]
        texts = [b"".join([words[i] for i in runs[k : k + JOINED]]).decode() for k in range(0, len(runs), JOINED)]
        if texts:
            ids = np.concatenate([np.array(e.ids, np.uint32) for e in self.library.encode_batch_fast(texts, add_special_tokens=False)])
            ends = np.cumsum(np.fromiter((len(words[i]) for i in runs), np.int64, len(runs)))
            total = np.cumsum(self.width[ids])
            at = np.searchsorted(total, ends)
            if total[-1] == ends[-1] and (total[at] == ends).all():
                raw, stop = ids.tobytes(), (4 * (at + 1)).tolist()
                for i, a, b in zip(runs, [0, *stop], stop):
                    out[i] = raw[a:b]
        rest = [i for i, o in enumerate(out) if o is None]
        for i, e in zip(rest, self.library.encode_batch_fast([words[i].decode() for i in rest], add_special_tokens=False)):
            out[i] = array("I", e.ids).tobytes()
        return out

    def _find(self, keys: np.ndarray) -> np.ndarray:
        """Places of hashes among the known ones, -1 if not there."""
        if not len(self.keys):
            return np.full(len(keys), -1, np.int32)
        at = self._slot(keys)
        index = self.slots.take(at)
        left = np.flatnonzero((index >= 0) & (self.keys.take(index, mode="clip") != keys))
        while len(left):
            at[left] = next_ = (at[left] + 1) & (len(self.slots) - 1)
            index[left] = found = self.slots.take(next_)
            left = left[(found >= 0) & (self.keys.take(found, mode="clip") != keys.take(left))]
        return index

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return (keys >> np.uint64(65 - len(self.slots).bit_length())).astype(np.int64)

    def _enter(self, begin: int) -> None:
        """Puts the known from place ``begin`` on into the table, which is kept less than half full."""
        if 2 * len(self.keys) >= len(self.slots):
            self.slots = np.zeros(1 << max(12, (4 * len(self.keys)).bit_length()), np.int32)
            begin = 0
        if not begin:
            self.slots.fill(-1)
        place = np.arange(begin, len(self.keys), dtype=np.int32)
        at = self._slot(self.keys[begin:])
        while len(place):
            free = self.slots.take(at) < 0
            self.slots[at[free]] = place[free]
            left = self.slots.take(at) != place
            place, at = place[left], (at[left] + 1) & (len(self.slots) - 1)

    def _look_up(self, words: pa.Array, keys: np.ndarray) -> np.ndarray | None:
        """Places of pre-tokens among the known ones, which the unknown join; nothing if two of them share a hash."""
        if len(self.words) > CACHE_WORDS:
            self._forget()
        known = len(self.words)
        index = self._find(keys)
        unknown = np.flatnonzero(index < 0)
        if len(unknown):
            fresh, first, place = np.unique(keys.take(unknown), return_index=True, return_inverse=True)
            index[unknown] = known + place
            own = words.take(pa.array(unknown.take(first)))
            ends, letters = _bytes(own)
            ends, letters = ends.tolist(), letters.tobytes()
            coded = self._ask([letters[a:b] for a, b in zip(ends, ends[1:])])
            length = np.fromiter(map(len, coded), np.int32, len(coded)) // 4
            self.words, self.keys = pa.concat_arrays([self.words, own]), np.append(self.keys, fresh)
            self.first = np.append(self.first, (len(self.flat) + np.cumsum(length) - length).astype(np.int32))
            self.length = np.append(self.length, length)
            self.flat = np.append(self.flat, np.frombuffer(b"".join(coded), np.int32))
            self.met, self.often = (np.append(x, np.zeros(len(coded), np.int32)) for x in (self.met, self.often))
            self._enter(known)
        self.calls += 1
        now = np.zeros(len(self.words), bool)
        now[index] = True
        self.met[now] = self.calls
        self.often += now
        return index if self._same(words, index) else None

    def _same(self, words: pa.Array, index: np.ndarray) -> bool:
        """Whether each pre-token has the bytes of its place; hashes of up to ``SURE`` bytes tell that."""
        offsets, raw = _bytes(words)
        known, letters = _bytes(self.words)
        own, size = np.diff(offsets), np.diff(known)
        for k in range(0, len(index), SPLIT_WORDS):
            some, each = index[k : k + SPLIT_WORDS], own[k : k + SPLIT_WORDS]
            if not np.array_equal(size.take(some), each):
                return False
            long = np.flatnonzero(each > SURE)
            each = each.take(long)
            if not np.array_equal(letters.take(_places(known.take(some.take(long)), each)), raw.take(_places(offsets.take(k + long), each))):
                return False
        return True

    def _forget(self) -> None:
        """Keeps the half of the known pre-tokens that was met in most calls, the older of which count half, and of equal ones those met last."""
        size = np.diff(_bytes(self.words)[0])
        kept = np.lexsort((-self.met, -self.often))[: CACHE_WORDS // 2]
        kept = np.sort(kept[size[kept] <= LONG_WORD])
        self.words, self.keys = self.words.take(pa.array(kept)), self.keys[kept]
        at = _places(self.first[kept], self.length[kept])
        self.flat, self.length, self.met, self.often = self.flat[at], self.length[kept], self.met[kept], (self.often[kept] + 1) >> 1
        self.first = np.cumsum(self.length, dtype=np.int32) - self.length
        self._enter(0)

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """Ids of each text."""
        plain = [not any(s in t for s in self.special) for t in texts]
        if not all(plain):
            own = iter(self.encode([t for t, p in zip(texts, plain) if p]))
            return [next(own) if p else self._ids(t) for t, p in zip(texts, plain)]
        if not any(texts):
            return [np.zeros(0, np.int32)] * len(texts)
        sizes = np.fromiter(map(len, texts), np.int64, len(texts))
        cuts = np.flatnonzero(np.diff((np.cumsum(sizes) - sizes) // SPLIT)) + 1
        raw, size, keys, count = zip(*(_split(texts[a:b], sizes[a:b]) for a, b in zip([0, *cuts.tolist()], [*cuts.tolist(), len(texts)])))
        raw, offsets = b"".join(raw), np.append(np.int32(0), np.cumsum(np.concatenate(size), dtype=np.int32))
        index = self._look_up(pa.Array.from_buffers(pa.binary(), len(offsets) - 1, [None, pa.py_buffer(offsets), pa.py_buffer(raw)]), np.concatenate(keys))
        if index is None:
            return [self._ids(t) for t in texts]
        parts, each = [], self.length.take(index)
        for k in range(0, len(index), SPLIT_WORDS):
            parts.append(self.flat.take(_places(self.first.take(index[k : k + SPLIT_WORDS]), each[k : k + SPLIT_WORDS])))
        cuts = np.append(0, np.cumsum(each))[np.cumsum(np.concatenate(count))]
        return np.split(np.concatenate(parts), cuts[:-1])


def _split(texts: list[str], sizes: np.ndarray) -> tuple[bytes, np.ndarray, np.ndarray, np.ndarray]:
    """The bytes of texts, the bytes and the hash of each pre-token, and how many pre-tokens each text has."""
    joined = "".join(texts)
    raw = joined.encode()
    begins = np.cumsum(sizes) - sizes
    new = pretokens(np.frombuffer(joined.encode("utf-32-le"), np.uint32), begins[sizes > 0])
    starts = np.flatnonzero(new)
    count = np.diff(np.searchsorted(starts, np.append(begins, len(joined))))
    if len(raw) > len(joined):
        lead = np.zeros(len(raw), bool)
        lead[(np.frombuffer(raw, np.uint8) & 0xC0) != 0x80] = new
        starts = np.flatnonzero(lead)
    size = np.diff(starts, append=len(raw))
    return raw, size, word_keys(raw, starts, size), count


#: Words of so many bytes have hashes of their own.
SURE = 7
#: The first 0 to 8 bytes of a little-endian number.
_FIRST = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)


def word_keys(raw: bytes, starts: np.ndarray, size: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each word, from its eight-byte parts; of words of more than 256 bytes one by one."""
    eight = np.ndarray((len(raw) + 1,), "<u8", buffer=raw + bytes(8), strides=(1,))  # the eight bytes from each byte on
    out = mix((eight[starts] & _FIRST.take(np.minimum(size, 8))) ^ (size.astype(np.uint64) << np.uint64(56)))
    long = np.flatnonzero(size > 256)
    active, k = np.flatnonzero((size > 8) & (size <= 256)), 8
    while len(active):
        left = size[active] - k
        out[active] = mix((out[active] ^ (eight[starts[active] + k] & _FIRST.take(np.minimum(left, 8)))) * np.uint64(0xD6E8FEB86659FD93))
        active, k = active[left > 8], k + 8
    for i in long.tolist():
        out[i] = int.from_bytes(hashlib.blake2b(raw[starts[i] : starts[i] + size[i]], digest_size=8).digest(), "little")
    return out


def _bytes(words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Offsets and bytes of a binary array."""
    data = words.buffers()[2]
    return np.frombuffer(words.buffers()[1] or bytes(4), np.int32)[words.offset :][: len(words) + 1], np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)


def _places(first: np.ndarray, length: np.ndarray) -> np.ndarray:
    """The places of runs that start at ``first``, one after the other."""
    end = np.cumsum(length, dtype=np.int32)
    return np.repeat(first - (end - length), length) + np.arange(end[-1] if len(end) else 0, dtype=np.int32)


_ENCODERS: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]


def _gathered(pieces):
    """Ids and texts, nulls empty, of pieces taken together up to ``PIECE`` characters; a longer piece stays whole."""
    keys, texts, size = [], [], 0
    for piece in pieces:
        more = [t or "" for t in piece.column("text").to_pylist()]
        own = sum(map(len, more))
        if texts and size + own > PIECE:
            yield keys, texts
            keys, texts, size = [], [], 0
        keys += piece.column("doc_id").to_pylist()
        texts += more
        size += own
    if texts:
        yield keys, texts


_DOCS = pa.list_(pa.struct([("doc_id", pa.int64()), ("n_tokens", pa.int64())]))


def write(docs: DataFrame, vocabulary: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Frames of all documents in ascending doc_id order, written to files in the shared folder and reread.

    ``(part, frame, start, n_tokens, docs, payload)``; parts and frames in ascending order hold ascending doc_ids.
    """
    spark = docs.sparkSession
    chosen = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), table_bytes(chosen, "text") // PARTITION_BYTES)
    order = [F.col("doc_id").asc_nulls_last()]
    # texts are read for the bounds of the ranges only if some id has more rows than one range should hold
    if chosen.groupBy("doc_id").count().where(F.col("count") > HOT_ROWS).limit(1).count():
        order.append(F.xxhash64("text").asc())
    ordered = chosen.repartitionByRange(parts, *order).sortWithinPartitions(F.col("doc_id").asc_nulls_last(), F.xxhash64("text"))

    def run(batches):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # a task has one core; idle threads of the library take CPU from the others
        part, e = TaskContext.get().partitionId(), encoder(vocabulary)
        end = np.array([END_ID], np.int32)
        frame = start = 0
        waiting: list[tuple[list, np.ndarray]] = []
        members, held, size = [], [], 0

        def close():
            nonlocal members, held, size
            if members:
                waiting.append((members, np.concatenate(held)))
            members, held, size = [], [], 0

        def flush():
            nonlocal frame, start
            if not waiting:
                return None
            pa.default_memory_pool().release_unused()
            rows = []
            for (own, ids), payload in zip(waiting, encode_frames([ids for _, ids in waiting])):
                rows.append((part, frame, start, len(ids), own, payload))
                frame, start = frame + 1, start + len(ids)
            waiting.clear()
            columns = list(zip(*rows))
            kinds = (pa.int32(), pa.int64(), pa.int64(), pa.int64(), _DOCS, pa.binary())
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], ["part", "frame", "start", "n_tokens", "docs", "payload"])

        for keys, texts in _gathered(chunks(batches, "text", PIECE)):
            for i, ids in zip(keys, e.encode(texts)):
                members.append({"doc_id": i, "n_tokens": len(ids) + 1})
                held += [ids, end]
                size += len(ids) + 1
                if size >= FRAME:
                    close()
            if sum(len(ids) for _, ids in waiting) >= TOGETHER:
                yield flush()
        close()
        if (last := flush()) is not None:
            yield last

    frames = ordered.mapInArrow(run, "part int, frame long, start long, n_tokens long, docs array<struct<doc_id:long,n_tokens:long>>, payload binary")
    before = spark.conf.get(_BATCH)
    if not 0 < int(before) <= BATCH_ROWS:
        spark.conf.set(_BATCH, str(BATCH_ROWS))
    try:
        return written(frames, "tokens")
    finally:
        spark.conf.set(_BATCH, before)


def documents_of(batches, offsets: dict[int, int]):
    """Batches of the documents of written frames, one a frame; frames are decoded together.

    A step over few blocks takes as long as one over many, so the last frames join those before unless they are half as many.
    """
    _ENCODERS.clear()  # a worker that has written holds a vocabulary and its pre-tokens

    def documents(frames):
        for (part, begin, own, _, _), mine in zip(frames, decode_frames([f[3] for f in frames])):
            count = np.array([d["n_tokens"] for d in own], np.int64)
            end = np.cumsum(count)
            raw = mine.astype("<u4").tobytes()
            payload = [raw[4 * a : 4 * b] for a, b in zip((end - count).tolist(), end.tolist())]
            yield pa.RecordBatch.from_arrays([pa.array([d["doc_id"] for d in own], pa.int64()), pa.array(offsets[part] + begin + end - count), pa.array(count), pa.array(payload, pa.binary())], ["doc_id", "start", "n_tokens", "ids"])

    waiting, size = [], 0
    for batch in batches:
        for row in zip(*(batch.column(c).to_pylist() for c in ("part", "start", "docs", "payload", "n_tokens"))):
            waiting.append(row)
            size += row[4]
            if size >= TOGETHER + TOGETHER // 2:
                k = int(np.searchsorted(np.cumsum([f[4] for f in waiting]), TOGETHER)) + 1
                first, waiting = waiting[:k], waiting[k:]
                size = sum(f[4] for f in waiting)
                yield from documents(first)
                del first
    if waiting:
        yield from documents(waiting)


def read(frames: DataFrame) -> DataFrame:
    """``(doc_id, start, n_tokens, ids BINARY)`` of every document from written frames; damage raises an error."""
    totals = {r["part"]: r["n"] for r in frames.groupBy("part").agg(F.sum("n_tokens").alias("n")).collect()}  # one row a part
    offsets, total = {}, 0
    for part in sorted(totals):
        offsets[part] = total
        total += totals[part]

    def run(batches):
        return documents_of(batches, offsets)

    return frames.select("part", "start", "docs", "payload", "n_tokens").mapInArrow(run, "doc_id long, start long, n_tokens long, ids binary")


def digest(documents: DataFrame) -> DataFrame:
    """The query's columns; the CRC-32 is Spark's, over the little-endian ids."""
    return documents.select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))
