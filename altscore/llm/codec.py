"""Adaptive context-mixing range coder for token ids, many blocks at a time.

Every block is coded on its own, from a fresh model; the blocks of a batch are
lanes of numpy arrays and advance in step, one id each.  All arithmetic is on
integers, so what one machine writes any other reads.

*Model of a lane.*  The two ids before and the one id before select an entry in
a hashed table each; an entry predicts one id and knows how often it was right.
The order-2 prediction, or the order-1 prediction where there is none, is the
candidate.  Three probabilities that it is right (by the confidence at order 2,
by that at order 1 and agreement, by how often order 0 saw ids like it and the
last hits) are mixed in the logistic domain with weights learned on the way.  An
id that isn't the candidate is coded by order-0 frequencies: its four hexadecimal
digits, each given those before (the last one by a hash of them).  A row of
frequencies moves fast at first and slowly once it is known.

*Coder.*  A carry-less range coder with 62-bit state and 16-bit output words;
wide enough to code a whole id at once.
"""

from __future__ import annotations

import zlib
from functools import lru_cache

import numpy as np

BLOCK = 4096               # ids of a block
SLOTS = 11                 # bits of the hashed tables
DIGITS = 4                 # hexadecimal digits of an id
DIGIT_BITS = 10            # coded frequencies of a digit add up to 2^10, kept ones to 2^15
ID_BITS = DIGITS * DIGIT_BITS
LAST = 10                  # bits of the hashed table of the last digits' rows
ROWS = 1 + 16 + 256 + (1 << LAST)   # rows of digits a lane
SLOWEST = 6                # a well-known row's frequencies move by 1/64 of the way

TOP_BIT = 46
MASK, TOP, BOT = (1 << 62) - 1, 1 << TOP_BIT, 1 << 42

_P = (np.arange(4096) + 0.5) / 4096
STRETCH = np.round(np.log(_P / (1 - _P)) * 256).astype(np.int32)                    # of a probability's upper 12 bits
SQUASH = np.clip(np.round(65536 / (1 + np.exp(-(np.arange(4096) - 2047.5) / 256))), 32, 65536 - 32).astype(np.int32)


class Lanes:
    """State of ``n`` range coders."""

    def __init__(self, n: int):
        self.low, self.range = np.zeros(n, np.int64), np.full(n, MASK, np.int64)

    def narrow(self, k: np.ndarray | None, start, size, bits: int) -> None:
        """Narrow lanes ``k`` (None: all) to [start, start + size) of 2^bits."""
        low, rng = (self.low, self.range) if k is None else (self.low[k], self.range[k])
        r = rng >> bits
        low, rng = low + r * start, r * size              # 64 bits
        # nearly all lanes need no word or one
        todo = np.flatnonzero(((low ^ (low + rng)) < TOP) | (rng < BOT))
        while len(todo):
            a, b = low[todo], rng[todo]
            b = np.where((a ^ (a + b)) < TOP, b, -a & (BOT - 1))
            self.word(todo if k is None else k[todo], a)
            a, b = (a << 16) & MASK, b << 16
            low[todo], rng[todo] = a, b
            todo = todo[((a ^ (a + b)) < TOP) | (b < BOT)]
        if k is None:
            self.low, self.range = low, rng
        else:
            self.low[k], self.range[k] = low, rng


class Writer(Lanes):
    def __init__(self, n: int):
        super().__init__(n)
        self.words, self.used = np.zeros((n, 1024), "<u2"), np.zeros(n, np.int64)

    def word(self, lanes, low) -> None:
        at = self.used[lanes]
        if at.max() >= self.words.shape[1]:
            self.words = np.pad(self.words, ((0, 0), (0, self.words.shape[1])))
        self.words[lanes, at] = low >> TOP_BIT
        self.used[lanes] = at + 1

    def finish(self) -> list[bytes]:
        every, low = np.arange(len(self.low)), self.low
        for _ in range(4):
            self.word(every, low)
            low = (low << 16) & MASK
        return [w[:n].tobytes() for w, n in zip(self.words, self.used.tolist())]


class Reader(Lanes):
    def __init__(self, blobs: list[bytes]):
        n = len(blobs)
        super().__init__(n)
        size = np.array([len(b) // 2 for b in blobs])
        self.words = np.zeros((n, int(size.max(initial=0)) + 8), "<u2")
        for i, b in enumerate(blobs):
            self.words[i, :size[i]] = np.frombuffer(b, "<u2")
        w = self.words[:, :4].astype(np.int64)
        # 62 bits: four words, the last without its two lowest bits' worth
        self.code = w[:, 0] << 46 | w[:, 1] << 30 | w[:, 2] << 14 | w[:, 3] >> 2
        self.spare = w[:, 3] & 3                          # bits read and not yet in ``code``
        self.used = np.full(n, 4)

    def word(self, lanes, low) -> None:
        at = self.used[lanes]
        w = self.words[lanes, np.minimum(at, self.words.shape[1] - 1)].astype(np.int64)
        self.used[lanes] = at + 1
        both = self.spare[lanes] << 16 | w
        self.code[lanes] = (self.code[lanes] << 16) & MASK | both >> 2
        self.spare[lanes] = both & 3

    def below(self, bound: np.ndarray, bits: int) -> np.ndarray:
        """Whether each lane stands below ``bound`` of 2^bits."""
        return self.code - self.low < (self.range >> bits) * bound

    def peek(self, k, bits: int) -> np.ndarray:
        """Where in 2^bits lanes ``k`` stand."""
        return np.minimum((self.code[k] - self.low[k]) // (self.range[k] >> bits), (1 << bits) - 1)


def hashed(above: np.ndarray) -> np.ndarray:
    """Row of the last digit, by the three above it."""
    return (above * 2531 & 4095) >> 12 - LAST


class Model:
    """Predictions of ``n`` lanes.

    Tables of all lanes are flat; the two hashed tables lie one after the other,
    and so do the three of probabilities, so that one access serves all.
    """

    def __init__(self, n: int):
        self.one, self.two = np.zeros(n, np.int32), np.zeros(n, np.int32)
        # an entry: the id predicted, above it the times it was right (4 bits)
        self.table = np.zeros(2 * n << SLOTS, np.int32)
        self.base = np.arange(2 * n).reshape(2, n) << SLOTS
        # probabilities (16 bits) by context, and the weights (16 bits after the point) that mix them
        lane = np.arange(n)
        self.p = np.full(n * 112, 32768, np.int32)
        self.first = np.stack([lane * 16, n * 16 + lane * 32, n * 48 + lane * 64])
        self.w = np.full((3, n), 26000, np.int32)
        self.hits = np.zeros(n, np.int32)
        # cumulative frequencies (15 bits) of each digit by those before it, and how often a row was used
        self.digits = np.tile(np.arange(0, 32768, 2048, dtype=np.int16), n * ROWS).view(ROW)
        self.seen = np.zeros(n * ROWS, np.uint8)
        self.start = [0, n, n * 17, n * 273]
        self.last = (lane << LAST) + n * 273
        self.sixteens = np.arange(0, 16 * DIGITS * n, 16)

    def candidate(self) -> tuple[np.ndarray, np.ndarray]:
        """The candidate of each lane and the probability (16 bits) that it is right."""
        h = self.one * 40503
        self.at = self.base + (np.stack([h >> 4, (h ^ self.two * 24859) >> 5]) & ((1 << SLOTS) - 1))
        self.e = e = self.table.take(self.at)
        # confidence and id at once: entries without a past are zero
        best = np.where(e[1] > 0xFFFF, e[1], e[0])
        cand = best & 0xFFFF
        times = e >> 16
        agree = ((e[0] ^ best) & 0xFFFF == 0) * np.int32(16)
        # order 0: how often ids like the candidate came so far
        often = OFTEN.take(self.seen.take(self.last + hashed(cand >> 4)))
        self.k = self.first + np.stack([times[1], times[0] + agree, often + self.hits])
        self.old = self.p.take(self.k)
        self.x = STRETCH.take(self.old >> 4)
        # weights in steps of 1/4096 here, so that 32 bits are enough
        mixed = ((self.w >> 4) * self.x).sum(axis=0, dtype=np.int32) >> 12
        self.mixed = SQUASH.take(mixed + 2048, mode="clip")
        return cand, self.mixed

    def learn(self, hit: np.ndarray, ids: np.ndarray) -> None:
        goal = hit * np.int32(65535)
        self.w = np.clip(self.w + ((self.x * ((goal - self.mixed) >> 3)) >> 10), -500000, 500000)
        self.p[self.k] = self.old + ((goal - self.old) >> RATES)
        self.hits = (self.hits << 1 | hit) & 3
        e = self.e
        right = (e ^ ids) & 0xFFFF == 0
        # right: surer; wrong: half as sure, and replaced when nothing is left
        times = np.where(right, np.minimum((e >> 16) + 1, 15), e >> 17)
        self.table[self.at] = np.where(right | (times > 0), e & 0xFFFF, ids) | np.maximum(times, 1) << 16
        self.two, self.one = self.one, ids

    def rows(self, depth: int, lanes: np.ndarray, above: np.ndarray) -> np.ndarray:
        """Rows of digits at a depth (0 to 3), given the digits above."""
        if depth == 3:
            return self.last.take(lanes) + hashed(above)
        return self.start[depth] + (lanes << 4 * depth) + above

    def cumulative(self, rows: np.ndarray) -> np.ndarray:
        return self.digits.take(rows).view(np.int16).reshape(-1, 16)

    def frequency(self, rows: np.ndarray, cdf: np.ndarray, digit: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Start and size of digits; their frequencies grow."""
        at = self.sixteens[:len(rows)] + digit
        flat = cdf.reshape(-1)
        start = flat.take(at).astype(np.int64) >> CUT
        size = np.where(digit < 15, flat.take(at + 1, mode="clip") >> CUT, 1 << DIGIT_BITS) - start
        # every start moves towards where it were if all was this digit; no size falls below 2^CUT
        n = self.seen.take(rows)
        step = GOALS.take(digit, axis=0)
        step -= cdf
        step >>= RATE.take(n, axis=0)
        step += cdf
        self.digits[rows] = step.reshape(-1).view(ROW)
        self.seen[rows] = n + (n < 255)
        return start, size


RATES = np.array([[4], [4], [5]], np.int32)
CUT = 15 - DIGIT_BITS
ROW = np.dtype("V32")      # 16 frequencies as one item
# start of each digit, by the digit that was seen, if it had all but the least frequency
GOALS = (np.where(np.arange(16) > np.arange(16)[:, None], 32768 - (16 << CUT), 0) + (np.arange(16) << CUT)).astype(np.int16)
# a row's first digits move its frequencies most: by 1/2, 1/4, ... of the way (16 times, for the row's entries)
RATE = np.repeat(np.minimum([(2 * k // 3 + 2).bit_length() - 1 for k in range(256)], SLOWEST).astype(np.int16), 16).reshape(256, 16)
# contexts by the times a row was used
OFTEN = np.minimum([((k + 1) ** 2).bit_length() - 1 for k in range(256)], 15).astype(np.int32) * 4


def encode(blocks: np.ndarray) -> list[bytes]:
    """Payloads of blocks of ids (a matrix with a row for each block)."""
    n, length = blocks.shape
    out, model = Writer(n), Model(n)
    columns = np.ascontiguousarray(blocks.T).astype(np.int32)
    for ids in columns:
        cand, p = model.candidate()
        hit = cand == ids
        out.narrow(None, np.where(hit, 0, p), np.where(hit, p, 65536 - p), 16)
        k = np.flatnonzero(~hit)
        if len(k):
            own = ids[k].astype(np.int64)
            # all digits at once: their rows are different ones
            rows = np.concatenate([model.rows(d, k, own >> 16 - 4 * d) for d in range(DIGITS)])
            digit = np.concatenate([own >> 12 - 4 * d & 15 for d in range(DIGITS)])
            starts, sizes = model.frequency(rows, model.cumulative(rows), digit)
            start, scale, shift = 0, 1, ID_BITS
            for s, z in zip(starts.reshape(DIGITS, -1), sizes.reshape(DIGITS, -1)):
                shift -= DIGIT_BITS
                start = start + scale * (s << shift)
                scale = scale * z
            out.narrow(k, start, scale, ID_BITS)
        model.learn(hit, ids)
    return out.finish()


def decode(payloads: list[bytes], length: int) -> np.ndarray:
    """The blocks that ``encode`` made of ``length`` ids each."""
    n = len(payloads)
    src, model = Reader(payloads), Model(n)
    columns = np.empty((length, n), "<u2")
    for t in range(length):
        cand, p = model.candidate()
        hit = src.below(p, 16)
        src.narrow(None, np.where(hit, 0, p), np.where(hit, p, 65536 - p), 16)
        ids = np.where(hit, cand, np.int32(0))
        k = np.flatnonzero(~hit)
        if len(k):
            rest, own, start, scale = src.peek(k, ID_BITS), np.zeros(len(k), np.int64), 0, 1
            for depth in range(DIGITS):
                shift = ID_BITS - DIGIT_BITS * (depth + 1)
                rows = model.rows(depth, k, own)
                cdf = model.cumulative(rows)
                # starts rise, so the digit is the number of them that are not above, less one
                stand = np.repeat((rest >> shift << CUT | (1 << CUT) - 1).astype(np.int16), 16).reshape(-1, 16)
                under = np.bitwise_count((cdf <= stand).view(np.uint64))
                digit = (under[:, 0] + under[:, 1]).astype(np.int64) - 1
                s, z = model.frequency(rows, cdf, digit)
                start = start + scale * (s << shift)
                scale = scale * z
                # at most 40 bits by at most 10: the quotient of doubles, cut, is exact
                rest = ((rest - (s << shift)) / z).astype(np.int64)
                own = own << 4 | digit
            src.narrow(k, start, scale, ID_BITS)
            ids[k] = own
        columns[t] = ids
        model.learn(hit, ids)
    return np.ascontiguousarray(columns.T)


def crc_of(ids: np.ndarray) -> int:
    """crc32 of ids as little-endian unsigned 32-bit integers."""
    return zlib.crc32(ids.astype("<u4"))


def _apply(m: list[int], v: int) -> int:
    """Product of a bit matrix (a row for each bit of ``v``) and ``v``."""
    out, k = 0, 0
    while v:
        if v & 1:
            out ^= m[k]
        v >>= 1
        k += 1
    return out


@lru_cache(maxsize=64)
def _zero_bytes(k: int) -> list[int]:
    """Matrix that appends 2^k zero bytes to a crc32."""
    if k == 0:
        m = [0xEDB88320] + [1 << i for i in range(31)]          # one zero bit
        for _ in range(3):
            m = [_apply(m, r) for r in m]
        return m
    half = _zero_bytes(k - 1)
    return [_apply(half, r) for r in half]


def crc_join(a: int, b: int, size: int) -> int:
    """crc32 of two strings together from theirs and the size of the second.

    A crc is linear over bits: appending zero bytes multiplies by a matrix.
    """
    k = 0
    while size:
        if size & 1:
            a = _apply(_zero_bytes(k), a)
        size >>= 1
        k += 1
    return a ^ b
