"""A coder of id sequences: adaptive context mixing drives range coding in independent blocks.

A block holds up to ``BLOCK`` ids and is coded without knowledge of any other. It starts with its alphabet, the
sorted distinct ids (Elias-Fano), and its ids become positions in it. Then, for every id, a candidate is taken from
the order-2 context (what followed the two ids before, the last time), else from the order-1 context. Three
predictions that the candidate is right are mixed in the logistic domain with weights that learn while coding: how
often order 2 was right at its present confidence, the same for order 1, given whether it agrees, and the
candidate's order-0 frequency. The mixture codes hit or miss; a miss is followed by the id under its order-0
frequencies, which count all ids and are brought up to date at fixed steps.

Blocks are coded side by side, one lane each, so every operation is one over all lanes. The state is integers; the
weights are single-precision numbers that see only sums and products of one element each, and all tables are made
with exact arithmetic, so that any machine decodes what another one wrote.

Block bytes: crc32 of what follows (u32), crc32 of the ids as u32 (u32), number of ids, number of distinct ids, low
bits per id of the alphabet, number of code words (u32 each); the alphabet; the code words (u32).
"""

from __future__ import annotations

import struct
import zlib
from decimal import Decimal
from functools import cache

import numpy as np

# Ids of a block; blocks coded side by side, and counts that they hold together at most.
BLOCK = 1 << 13
LANES = 1 << 10
CELLS = 1 << 23
# Slots of a block's order-2 contexts, what an id adds to its order-0 count, steps between updates of the counts.
SLOTS = 1 << 13
STEP = 16
REFRESH = 512
# Confidence runs from 0 (context not seen) to 15.
TOP = 15
# Speed of the hit rates (a shift) and of the mixing weights; first weights of orders 2, 1 and 0.
RATE = 5
LEARN = np.float32(0.02)
FIRST_WEIGHTS = (0.6, 0.35, 0.1)
HEADER = struct.Struct("<IIIIII")
_ONE = np.uint64(1)
_HALF = np.uint64(32)
_LOW = np.uint64(0xFFFFFFFF)
_LN2_16 = np.float32(0.0433)


@cache
def tables() -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Squash (of 1/256, offset 2048) to 16-bit probabilities, its inverse on 12-bit ones, logarithms of
    counts, and the change of a confidence at a miss or hit."""
    squash = [int((65536 / (1 + (Decimal(-k) / 256).exp())).to_integral_value()) for k in range(-2048, 2048)]
    squash = np.clip(np.array(squash, dtype=np.int32), 48, 65536 - 48)
    middle = (np.arange(4096, dtype=np.int64) << 4) + 8
    stretch = ((np.searchsorted(squash, middle) - 2048) / 256).astype(np.float32)
    logs = np.array([0, *(log2_16(v) for v in range(1, 4096))], dtype=np.float32) * _LN2_16
    change = np.array([(-(c >> 1), int(c < TOP)) for c in range(TOP + 1)], dtype=np.int32).reshape(-1)
    return squash, stretch, logs, change


def log2_16(v: int) -> int:
    """Sixteen times the binary logarithm, rounded down."""
    return (int(v) ** 16).bit_length() - 1


class Lanes:
    """The models of several blocks, each in a lane of its own. Rows of two are order 2 and order 1."""

    def __init__(self, distinct: np.ndarray):
        n = len(distinct)
        self.depth = int(distinct.max()).bit_length()
        self.n, self.width = n, 1 << self.depth
        self.squash, self.stretch, self.logs, self.change = tables()
        lane = np.arange(n, dtype=np.int64)
        self.at0 = lane * self.width
        self.at = np.stack([lane * SLOTS, n * SLOTS + self.at0])
        self.at_rate = np.stack([lane * 48, lane * 48 + 16])
        self.after = np.zeros(n * (SLOTS + self.width), dtype=np.int32)
        self.rates = np.full(n * 48, 1 << 15, dtype=np.int32)
        self.weights = np.repeat(np.array([FIRST_WEIGHTS], dtype=np.float32).T * 256, n, axis=1)
        self.inputs = np.zeros((3, n), dtype=np.float32)
        self.counts = (np.arange(self.width) < distinct[:, None]).astype(np.int32).reshape(-1)
        self.sums = np.zeros((n, self.width), dtype=np.int32)
        self.context = np.zeros((2, n), dtype=np.int64)  # hash of the two ids before; the id before
        self.low = np.zeros(n, dtype=np.uint64)
        self.range = np.full(n, 0xFFFFFFFFFFFFFFFF, dtype=np.uint64)

    def refresh(self, k: int) -> None:
        """Bring the order-0 frequencies up to date: sums of the counts before each symbol."""
        counts = self.counts.reshape(self.n, -1)
        np.cumsum(counts[:k, :-1], axis=1, out=self.sums[:k, 1:])
        total = self.sums[:k, -1] + counts[:k, -1]
        self.flat = self.sums.reshape(-1)
        self.ends, self.total = total, total.astype(np.uint64)
        self.log_total = np.array([log2_16(v) for v in total], dtype=np.float32) * _LN2_16

    def predict(self, k: int) -> None:
        """Candidate and its probability (of 65536) in the first k lanes."""
        self.i = self.at[:, :k] + self.context[:, :k]
        self.entry = self.after.take(self.i)
        self.conf, self.known = self.entry & TOP, self.entry >> 4
        self.candidate = np.where(self.conf[0] > 0, self.known[0], self.known[1])
        self.r = self.at_rate[:, :k] + self.conf
        self.r[1] += (self.known[1] != self.candidate) << 4
        self.rate = self.rates.take(self.r)
        x = self.inputs[:, :k]
        x[:2] = self.stretch.take(self.rate >> 4)
        seen = self.counts.take(self.at0[:k] + self.candidate)
        np.subtract(self.logs.take(seen, mode="clip"), self.log_total[:k], out=x[2])
        part = self.weights[:, :k] * x
        dot = part[0] + part[1]
        dot += part[2]
        dot += np.float32(2048)
        self.odds = self.squash.take(dot.astype(np.int64), mode="clip")

    def narrow(self, k: int, hit: np.ndarray) -> None:
        """Take the part of the range that hit or miss has."""
        part = self.range[:k] >> np.uint64(16)
        size = np.where(hit, self.odds, 65536 - self.odds)
        self.low[:k] += part * (self.odds - self.odds * hit).astype(np.uint64)
        self.range[:k] = part * size.astype(np.uint64)

    def narrow_missed(self, missed: np.ndarray, at: np.ndarray, part: np.ndarray) -> None:
        """Take the part of the range that the symbol at this place of the sums has."""
        below = self.flat.take(at)
        lane_end = (at + 1) & (self.width - 1) == 0
        above = np.where(lane_end, self.ends[missed], self.flat.take(at + 1, mode="clip"))
        self.low[missed] += part * below.astype(np.uint64)
        self.range[missed] = part * (above - below).astype(np.uint64)

    def settle(self, k: int) -> np.ndarray:
        """Lanes whose range has become short; their high word is final afterwards. If the range lies across a
        border of high words, the longer side is kept."""
        short = np.flatnonzero(self.range[:k] <= _LOW)
        low, size = self.low[short], self.range[short]
        last = low + size - _ONE
        split = np.flatnonzero((low ^ last) >> _HALF)
        if len(split):
            over = (last[split] & _LOW) + _ONE  # what lies beyond the border
            left = size[split] - over
            upper = over > left
            low[split] = np.where(upper, last[split] & ~_LOW, low[split])
            size[split] = np.where(upper, over, left)
        self.low[short] = low << _HALF
        self.range[short] = size << _HALF
        self.words = low >> _HALF
        return short

    def learn(self, k: int, symbol: np.ndarray, hit: np.ndarray) -> None:
        target = hit * np.int32(65535)
        self.rates[self.r] = self.rate + ((target - self.rate) >> RATE)
        error = (target - self.odds).astype(np.float32)
        error *= LEARN / np.float32(256)
        self.weights[:, :k] += error * self.inputs[:, :k]
        right = self.known == symbol
        kept = self.entry + self.change.take((self.conf << 1) + right)
        self.after[self.i] = np.where(right | (self.conf > 1), kept, (symbol << 4) | 1)
        at = self.at0[:k] + symbol
        self.counts[at] = self.counts.take(at) + STEP
        self.context[0, :k] = (self.context[1, :k] * 7919 + symbol * 31) & (SLOTS - 1)
        self.context[1, :k] = symbol


def _refresh_at(step: int) -> bool:
    return step % REFRESH == 0 or step in (16, 32, 64, 128, 256)


def _alphabet(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct ids, and each id's place among them."""
    if int(ids.max()) >= 1 << 18:
        return np.unique(ids, return_inverse=True)
    seen = np.zeros(int(ids.max()) + 1, dtype=bool)
    seen[ids] = True
    alphabet = np.flatnonzero(seen)
    place = np.zeros(len(seen), dtype=np.int32)
    place[alphabet] = np.arange(len(alphabet), dtype=np.int32)
    return alphabet.astype(np.uint32), place[ids]


def _groups(widths: list[int]) -> list[tuple[int, int]]:
    """Consecutive blocks that are coded side by side."""
    out, start, widest = [], 0, 1
    for i, w in enumerate(widths):
        widest = max(widest, w)
        if i > start and (i - start == LANES or (i + 1 - start) << widest.bit_length() > CELLS):
            out.append((start, i))
            start, widest = i, w
    return [*out, (start, len(widths))] if widths else []


def _pack_alphabet(alphabet: np.ndarray) -> tuple[int, bytes]:
    """Elias-Fano: low bits as they are, high parts in unary."""
    n, top = len(alphabet), int(alphabet[-1]) + 1
    bits = max(0, (top // n).bit_length() - 1)
    values = alphabet.astype(np.int64)
    low = (values[:, None] >> np.arange(bits)) & 1
    high = np.zeros(int(values[-1] >> bits) + n, dtype=np.uint8)
    high[(values >> bits) + np.arange(n)] = 1
    return bits, np.packbits(low.astype(np.uint8)).tobytes() + np.packbits(high).tobytes()


def _unpack_alphabet(data: bytes, at: int, n: int, bits: int, end: int) -> np.ndarray:
    n_low = (n * bits + 7) // 8
    raw = np.frombuffer(data, dtype=np.uint8, count=end - at, offset=at)
    low = np.unpackbits(raw[:n_low], count=n * bits).reshape(n, bits).astype(np.int64)
    high = np.flatnonzero(np.unpackbits(raw[n_low:]))[:n] - np.arange(n)
    return ((high << bits) + (low << np.arange(bits)).sum(axis=1)).astype(np.uint32)


def encode(blocks: list[np.ndarray]) -> list[bytes]:
    """Bytes of each block of unsigned 32-bit ids, none of them empty."""
    found = [_alphabet(b) for b in blocks]
    out: list[bytes] = []
    for i, j in _groups([len(alphabet) for alphabet, _ in found]):
        out += _encode(blocks[i:j], found[i:j])
    return out


def _encode(blocks: list[np.ndarray], found: list[tuple[np.ndarray, np.ndarray]]) -> list[bytes]:
    order = sorted(range(len(blocks)), key=lambda i: -len(blocks[i]))
    sizes = np.array([len(blocks[i]) for i in order])
    rows = np.zeros((len(order), int(sizes[0])), dtype=np.int32)
    for lane, i in enumerate(order):
        rows[lane, : sizes[lane]] = found[i][1]
    symbols = np.ascontiguousarray(rows.T)
    m = Lanes(np.array([len(found[i][0]) for i in order]))
    lanes, words = [], []
    k = len(order)
    for step in range(len(symbols)):
        while sizes[k - 1] <= step:
            k -= 1
        if _refresh_at(step):
            m.refresh(k)
        symbol = symbols[step, :k]
        m.predict(k)
        hit = symbol == m.candidate
        m.narrow(k, hit)
        missed = np.flatnonzero(~hit)
        m.narrow_missed(missed, m.at0[missed] + symbol[missed], m.range[missed] // m.total[missed])
        lanes.append(m.settle(k))
        words.append(m.words)
        m.learn(k, symbol, hit)
    lane_of, word = np.concatenate(lanes), np.concatenate(words).astype("<u4")
    by_lane = np.argsort(lane_of, kind="stable")
    ends = np.cumsum(np.bincount(lane_of, minlength=len(order)))
    word = word[by_lane]
    out: list[bytes] = [b""] * len(order)
    for lane, i in enumerate(order):
        # two more words name the low end of the range
        low = int(m.low[lane])
        code = word[ends[lane - 1] if lane else 0 : ends[lane]].tobytes() + struct.pack("<II", low >> 32, low & 0xFFFFFFFF)
        bits, alphabet = _pack_alphabet(found[i][0])
        raw = zlib.crc32(blocks[i].astype("<u4"))
        rest = struct.pack("<IIIII", raw, len(blocks[i]), len(found[i][0]), bits, len(code) // 4) + alphabet + code
        out[i] = struct.pack("<I", zlib.crc32(rest)) + rest
    return out


def decode(blocks: list[bytes]) -> list[np.ndarray]:
    """Ids of each block; a block that is not what was written raises."""
    heads = []
    for data in blocks:
        if len(data) < HEADER.size or zlib.crc32(memoryview(data)[4:]) != HEADER.unpack_from(data)[0]:
            raise ValueError("damaged block: its bytes do not match their checksum")
        heads.append(HEADER.unpack_from(data))
    out: list[np.ndarray] = []
    for i, j in _groups([head[3] for head in heads]):
        out += _decode(blocks[i:j], heads[i:j])
    return out


def _decode(blocks: list[bytes], heads: list[tuple]) -> list[np.ndarray]:
    order = sorted(range(len(blocks)), key=lambda i: -heads[i][2])
    sizes = np.array([heads[i][2] for i in order])
    width = max(head[5] for head in heads) + 1
    words = np.zeros((len(order), width), dtype=np.uint32)
    alphabets = []
    for lane, i in enumerate(order):
        _, _, _, n, bits, n_words = heads[i]
        code = len(blocks[i]) - 4 * n_words
        alphabets.append(_unpack_alphabet(blocks[i], HEADER.size, n, bits, code))
        words[lane, :n_words] = np.frombuffer(blocks[i], dtype="<u4", offset=code)
    m = Lanes(np.array([len(a) for a in alphabets]))
    code = (words[:, 0].astype(np.uint64) << _HALF) | words[:, 1]
    words = words.reshape(-1)
    next_word = np.arange(len(order)) * width + 2
    symbols = np.zeros((int(sizes[0]), len(order)), dtype=np.int32)
    k = len(order)
    for step in range(len(symbols)):
        while sizes[k - 1] <= step:
            k -= 1
        if _refresh_at(step):
            m.refresh(k)
        m.predict(k)
        hit = code[:k] - m.low[:k] < (m.range[:k] >> np.uint64(16)) * m.odds.astype(np.uint64)
        m.narrow(k, hit)
        symbol = m.candidate
        missed = np.flatnonzero(~hit)
        total = m.total[missed]
        part = m.range[missed] // total
        value = np.minimum((code[missed] - m.low[missed]) // part, total - _ONE).astype(np.int32)
        at = m.at0[missed]
        for bit in range(m.depth - 1, -1, -1):  # the last symbol with no more counts before it
            at += (m.flat.take(at + (1 << bit)) <= value) << bit
        m.narrow_missed(missed, at, part)
        symbol[missed] = at - m.at0[missed]
        done = m.settle(k)
        at = next_word[done]
        code[done] = (code[done] << _HALF) | words.take(at)
        next_word[done] = at + 1
        symbols[step, :k] = symbol
        m.learn(k, symbol, hit)
    rows = np.ascontiguousarray(symbols.T)
    out: list[np.ndarray] = [np.zeros(0, np.uint32)] * len(order)
    for lane, i in enumerate(order):
        ids = alphabets[lane][rows[lane, : sizes[lane]]]
        if zlib.crc32(ids.astype("<u4")) != heads[i][1]:
            raise ValueError("damaged block: its ids do not match their checksum")
        out[i] = ids
    return out
