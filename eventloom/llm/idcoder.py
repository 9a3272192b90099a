"""Token ids in checksummed blocks, coded by an adaptive context-mixing range coder.

A frame of up to FRAME ids is coded on its own: all model state starts anew, and a CRC-32 of its ids is kept. What
followed the last two ids before (order 2), what followed the last one (order 1) and the frame's own frequencies (order 0)
share one distribution: its weights are the mean of two adaptive estimates, one by the predictors' confidence and one by
the last decisions. An id is coded as the first order that names it, in one step of three, and behind order 0 as a
dictionary number by its frequency; the orders and the numbers have code words of their own, so that every step has work
for all lanes. All arithmetic is exact, so files decode alike everywhere.

A frame is cut into strips of up to STRIP ids, which are coded side by side as lanes of numpy arrays, one id of every lane
per step. The strips of a frame share what it learns of contexts; of two that learn of one context in the same step, the
later lane's word stands.

Segment, a row of the file: magic, number of documents, how many of them, the first ones, have a null id, number of ids
before it in its part, bytes of the index, the index (varints of the documents' id differences, zigzag, and of their
lengths), then the frames. Frame: number of ids, of distinct ids, bytes of the dictionary and of the strips' counts,
CRC-32, dictionary (varint differences of the sorted ids), a half byte of frequency for each distinct id, counts (varints:
each strip's ids of order 0, each strip's code words of the orders, each strip's of the numbers), 16-bit code words of the
orders, and of the numbers, strip by strip.
"""

from __future__ import annotations

import struct
import zlib
from dataclasses import dataclass

import numpy as np

FRAME, STRIP = 8_192, 1_024
#: Frames coded side by side at most; bounds memory.
LANES = 1_024
#: Ids after which a segment is closed, behind the document that passes them.
SEGMENT = 8 * FRAME
MAGIC = b"CMR2"
HEAD = struct.Struct("<4sIIQI")
FRAME_HEAD = struct.Struct("<IIIII")

SLOTS1, SLOTS2 = 2_048, 4_096
#: Bits of the shares of orders and of dictionary numbers.
BITS, NUMBER_SHARE = 16, 14
#: Frequencies that a half byte tells. Up to FRAME ids of them add up to less than all shares.
LEVELS = np.array([1, 2, 3, 4, 5, 6, 8, 11, 16, 23, 32, 64, 128, 512, 2_048, 8_192])
BETWEEN = (LEVELS[1:] + LEVELS[:-1]) / 2
U64, U16 = np.uint64, np.uint16
NUMBER_BITS = U16(13)
NUMBER = U16((1 << 13) - 1)
#: A predictor's confidence, 0 to 3, stands above its guess: one step of it, its top, and from where a guess is kept once it was wrong.
SURER, SUREST, SURE = U16(1 << 13), U16(3 << 13), U16(2 << 13)
#: Two shares side by side: of order 2, and of orders 1 and 2 together. They move by a 32nd towards what was seen; the
#: ends they move to leave room for each order.
U32, HALF = np.uint32, 16
RATE, RATE_MASK = U32(5), U32((1 << 11) - 1 << HALF | (1 << 11) - 1)
TOWARDS = np.array([4 | 8 << HALF, 4 | 2_036 << HALF, 2_030 | 2_036 << HALF], U32)
START = 1 << 13 | 1 << 14 + HALF
LOW, HALVES = U32((1 << HALF) - 1), U32((1 << 15) - 1 << HALF | (1 << 15) - 1)
#: Bounds have 48 bits; a range below 32 shifts a word out.
FULL, BOTTOM, WORD = (1 << 48) - 1, 1 << 32, 16


# --- varints ---------------------------------------------------------------------------------------------------
def varints(values: np.ndarray) -> bytes:
    """Unsigned 64-bit values, 7 bits a byte, low bits first, the high bit set on all but a value's last byte."""
    return varint_rows(values, np.array([len(values)]))[0]


def varint_rows(values: np.ndarray, counts: np.ndarray) -> list[bytes]:
    """So many values for each row."""
    v = np.asarray(values, U64)
    if not len(v):
        return [b""] * len(counts)
    size = np.ones(len(v), np.int64)
    top = int(v.max())
    for k in range(1, 10):
        if top < 1 << 7 * k:
            break
        size += v >= U64(1 << 7 * k)
    ends = np.cumsum(size)
    inside = np.arange(ends[-1]) - np.repeat(ends - size, size)
    out = (np.repeat(v, size) >> (inside * 7).astype(U64)) & U64(127)
    more = np.ones(len(out), bool)
    more[ends - 1] = False
    out |= more.astype(U64) << U64(7)
    data, cuts = out.astype(np.uint8).tobytes(), np.concatenate([[0], ends])[np.concatenate([[0], np.cumsum(counts)])].tolist()
    return [data[a:b] for a, b in zip(cuts, cuts[1:], strict=False)]


def from_varints(data: np.ndarray, count: int) -> tuple[np.ndarray, int]:
    """`count` values from the start of a byte array, and the bytes they took."""
    if not count:
        return np.empty(0, U64), 0
    last = np.flatnonzero(data < 128)[:count]
    first = np.concatenate([[0], last[:-1] + 1])
    end = int(last[-1]) + 1
    inside = np.arange(end) - np.repeat(first, last - first + 1)
    return np.add.reduceat((data[:end].astype(U64) & U64(127)) << (inside * 7).astype(U64), first), end


# --- the model and the coder, for lanes -------------------------------------------------------------------------
class Strips:
    """The strips of frames: of frame k those from `begin[k]` on. Lanes are strips by falling length, in `order`; `lane`
    tells each strip's."""

    def __init__(self, sizes: np.ndarray) -> None:
        per = -(-sizes // STRIP)
        self.begin = np.cumsum(per) - per
        self.frame = np.repeat(np.arange(len(sizes)), per)
        self.n = len(self.frame)
        self.sizes = np.minimum(sizes[self.frame] - (np.arange(self.n) - self.begin[self.frame]) * STRIP, STRIP)
        self.order, self.lane, self.running = lanes_of(self.sizes)


def lanes_of(sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[int]]:
    """The order of sizes by falling size, each one's place in it, and how many are left in each step."""
    order = np.argsort(-sizes, kind="stable")
    lane = np.empty_like(order)
    lane[order] = np.arange(len(order))
    return order, lane, np.searchsorted(-sizes[order], -np.arange(int(sizes.max())), side="left").tolist()


class Orders:
    """What orders 1 and 2 guess in lanes, and the shares of the orders; the first `n` lanes are still running.

    Arrays of a step are written again in each."""

    def __init__(self, frame: np.ndarray) -> None:
        lanes, frames = len(frame), int(frame.max()) + 1
        # What followed a context: a dictionary number of 13 bits and how sure it is, 0 to 3.
        self.after1, self.after2 = np.zeros(frames * SLOTS1, U16), np.zeros(frames * SLOTS2, U16)
        self.by_trust, self.by_past = np.full(lanes * 16, START, U32), np.full(lanes * 16, START, U32)
        long = [frame * SLOTS1, frame * SLOTS2, np.arange(lanes) * 16, *np.zeros((8, lanes), np.int64)]
        self.whole = [*long, *np.zeros((4, lanes), U32), *np.zeros((8, lanes), U16), *np.zeros((2, lanes), np.uint8)]
        self.n = -1

    def running(self, n: int) -> None:
        self.n = n
        (
            self.first1, self.first2, self.first, self.one, self.two, self.slot1, self.slot2, self.at_trust, self.at_past, self.share2, self.share,
            self.a, self.b, self.x, self.y, self.v1, self.v2, self.guess1, self.guess2, self.t, self.u, self.w, self.ids, self.past, self.order,
        ) = (x[:n] for x in self.whole)

    def guesses(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        """The share of order 2, and of orders 1 and 2 together, for the next id of the first `n` lanes."""
        if n != self.n:
            self.running(n)
        one, slot1, slot2, x, y, t, u = self.one, self.slot1, self.slot2, self.x, self.y, self.t, self.u
        np.bitwise_and(one, SLOTS1 - 1, out=slot1)
        slot1 += self.first1
        np.multiply(one, 31, out=slot2)
        slot2 += self.two
        slot2 &= SLOTS2 - 1
        slot2 += self.first2
        self.after1.take(slot1, out=self.v1, mode="clip")
        self.after2.take(slot2, out=self.v2, mode="clip")
        np.bitwise_and(self.v1, NUMBER, out=self.guess1)
        np.bitwise_and(self.v2, NUMBER, out=self.guess2)
        np.right_shift(self.v2, NUMBER_BITS - U16(2), out=t)
        t &= U16(12)
        np.right_shift(self.v1, NUMBER_BITS, out=u)
        t |= u
        np.add(self.first, t, out=self.at_trust)
        np.add(self.first, self.past, out=self.at_past)
        self.by_trust.take(self.at_trust, out=self.a, mode="clip")
        self.by_past.take(self.at_past, out=self.b, mode="clip")
        # Their mean, rounded down on both sides.
        np.bitwise_xor(self.a, self.b, out=x)
        x >>= U32(1)
        x &= HALVES
        np.bitwise_and(self.a, self.b, out=y)
        x += y
        np.bitwise_and(x, LOW, out=self.share2)
        np.right_shift(x, U32(HALF), out=self.share)
        return self.share2, self.share

    def learned(self, n: int, second: np.ndarray, named: np.ndarray, ids: np.ndarray) -> None:
        """The next ids, whether order 2, and whether any of orders 1 and 2, was told to name them."""
        order, x, y, t, u, w = self.order, self.x, self.y, self.t, self.u, self.w
        np.add(second.view(np.uint8), named.view(np.uint8), out=order)
        TOWARDS.take(order, out=y, mode="clip")
        for table, at, share in ((self.by_trust, self.at_trust, self.a), (self.by_past, self.at_past, self.b)):
            np.right_shift(share, RATE, out=x)
            x &= RATE_MASK
            share -= x
            share += y
            table[at] = share
        self.past <<= 2
        self.past &= 15
        self.past |= order
        np.bitwise_or(ids, SURER, out=self.ids)
        for after, slot, v, guess in ((self.after1, self.slot1, self.v1, self.guess1), (self.after2, self.slot2, self.v2, self.guess2)):
            # Wrong: less sure, or, if it wasn't sure, the new one. Right: surer.
            np.subtract(v, SURER, out=t)
            chosen(v >= SURE, t, self.ids, w, u)
            np.add(v, SURER, out=t)
            v |= SUREST
            np.minimum(t, v, out=t)
            chosen(guess == ids, t, w, w, u)
            after[slot] = w
        np.multiply(self.one, 5_741, out=self.two)
        self.one[:] = ids


def chosen(test: np.ndarray, yes: np.ndarray, no: np.ndarray, out: np.ndarray, mask: np.ndarray) -> None:
    """`yes` where the test holds, else `no`, of 16-bit values; `yes` is changed."""
    np.multiply(test, U16(0xFFFF), out=mask)
    yes ^= no
    yes &= mask
    np.bitwise_xor(yes, no, out=out)


class Writer:
    """Range coders side by side. A word that a later carry changes is mended at the end."""

    def __init__(self, lanes: int, steps: int) -> None:
        self.first = np.arange(lanes) * (steps + 4)
        self.at, self.out = self.first.copy(), np.zeros(lanes * (steps + 4), np.uint32)
        self.low, self.range, self.rest = np.zeros(lanes, np.int64), np.full(lanes, FULL), np.zeros(lanes, np.int64)

    def put(self, n: int, above: np.ndarray, size: np.ndarray) -> None:
        """Narrows the first `n` lanes to `size`, beginning `above` their lower bounds."""
        low, at, rest = self.low[:n], self.at[:n], self.rest[:n]
        low += above
        go = size < BOTTOM
        # Written in each lane; where no word is settled yet, the next one overwrites it.
        np.right_shift(low, 32, out=rest)
        self.out[at] = rest
        at += go
        # What is settled leaves the lower bound.
        rest <<= 32
        rest *= go
        low -= rest
        np.multiply(go, WORD, out=rest)
        low <<= rest
        np.left_shift(size, rest, out=self.range[:n])

    def words(self, lane: np.ndarray) -> tuple[np.ndarray, bytes]:
        """How many code words each lane has, and all of them, both in the order of `lane`."""
        for shift in (32, 16, 0):
            word = self.low >> shift
            self.out[self.at] = word if shift == 32 else word & 0xFFFF
            self.at += 1
        over = np.flatnonzero(self.out > 0xFFFF)
        while len(over):
            self.out[over] -= 1 << WORD
            over -= 1
            self.out[over] += 1
            over = over[self.out[over] > 0xFFFF]
        short = self.out.astype("<u2")
        ends = zip(self.first[lane].tolist(), self.at[lane].tolist(), strict=True)
        return (self.at - self.first)[lane], b"".join([short[a:b].tobytes() for a, b in ends])


class Reader:
    """The inverse of `Writer`, from all words, in the order of strips, and how many each has: `above` is how far the code
    lies above the lower bound."""

    def __init__(self, words: bytes, counts: np.ndarray, order: np.ndarray) -> None:
        self.code = np.frombuffer(words, "<u2")
        self.at = (np.cumsum(counts) - counts)[order]
        self.above, self.range = np.zeros(len(order), np.int64), np.full(len(order), FULL)
        for _ in range(3):
            self.above = self.above << WORD | self.code.take(self.at, mode="clip")
            self.at += 1

    def taken(self, n: int, above: np.ndarray, size: np.ndarray) -> None:
        """Narrows the first `n` lanes as `Writer.put` did; `above` is measured from the new lower bounds."""
        go = size < BOTTOM
        # A broken code may run beyond the words; its sum tells.
        word = self.code.take(self.at[:n], mode="clip")
        word *= go
        self.at[:n] += go
        shift = np.multiply(go, WORD, dtype=np.int64)
        np.left_shift(above, shift, out=self.above[:n])
        self.above[:n] |= word
        np.left_shift(size, shift, out=self.range[:n])


def bounds(second: np.ndarray, named: np.ndarray, two: np.ndarray, both: np.ndarray, whole: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where the part of order 2, of order 1 or of order 0 begins, and its size. `two` and `both` are changed."""
    size = np.where(second, two, np.where(named, both, whole))
    # What lies below: nothing, order 2, or both.
    two *= named & ~second
    both *= ~named
    both += two
    size -= both
    return both, size


def shares(levels: np.ndarray, distinct: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For the dictionary numbers of all frames in a row: the sum of the shares before each in its frame, and its share.
    The shares of a frame add up to 1 << NUMBER_SHARE, and none is 0."""
    sums = np.concatenate([[0], np.cumsum(LEVELS[levels])])
    ends = np.cumsum(distinct)
    start = sums[ends - distinct]
    start, total = np.repeat(start, distinct), np.repeat(sums[ends] - start, distinct)
    before = (sums[:-1] - start << NUMBER_SHARE) // total
    return before, (sums[1:] - start << NUMBER_SHARE) // total - before


@dataclass
class Code:
    """Frames side by side: frequencies of all their dictionary numbers, and of each strip the ids of order 0, the code words
    of orders and those of numbers."""

    levels: np.ndarray
    rest: np.ndarray
    n_orders: np.ndarray
    n_numbers: np.ndarray
    orders: bytes
    numbers: bytes


def coded(symbols: list[np.ndarray], distinct: np.ndarray) -> Code:
    """Frames of dictionary numbers."""
    s = Strips(np.array([len(x) for x in symbols]))
    flat = np.zeros(s.n * STRIP, U16)
    for at, x in zip((s.begin * STRIP).tolist(), symbols, strict=True):
        flat[at : at + len(x)] = x
    grid = flat.reshape(s.n, STRIP)[s.order, : len(s.running)].T.copy()
    rest = np.zeros(grid.shape, bool)
    orders, w = Orders(s.frame[s.order]), Writer(s.n, len(grid))
    for step, n in enumerate(s.running):
        ids = grid[step, :n]
        two, both = orders.guesses(n)
        second = orders.guess2 == ids
        named = second | (orders.guess1 == ids)
        share = w.range[:n] >> BITS
        two *= share
        both *= share
        above, size = bounds(second, named, two, both, w.range[:n])
        w.put(n, above, size)
        orders.learned(n, second, named, ids)
        np.logical_not(named, out=rest[step, :n])
    left = rest.T[s.lane]
    counts, numbers = left.sum(1), flat.reshape(s.n, STRIP)[:, : len(grid)][left]
    # Dictionary numbers from here on run through all frames.
    numbers = numbers + np.repeat((np.cumsum(distinct) - distinct)[s.frame], counts)
    levels = np.searchsorted(BETWEEN, np.bincount(numbers, minlength=int(distinct.sum()))).astype(np.uint8)
    return Code(levels, counts, *alternately(w.words(s.lane), numbers_coded(numbers, counts, *shares(levels, distinct))))


def alternately(orders: tuple[np.ndarray, bytes], numbers: tuple[np.ndarray, bytes]) -> tuple[np.ndarray, np.ndarray, bytes, bytes]:
    return orders[0], numbers[0], orders[1], numbers[1]


def numbers_coded(numbers: np.ndarray, counts: np.ndarray, before: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, bytes]:
    order, lane, running = lanes_of(counts)
    rows = np.zeros((len(counts), len(running)), np.int32)
    rows[np.arange(len(running)) < counts[:, None]] = numbers
    grid = rows[order].T.copy()
    w = Writer(len(counts), len(grid))
    both = before << 15 | size
    for step, n in enumerate(running):
        share, x = w.range[:n] >> NUMBER_SHARE, both[grid[step, :n]]
        w.put(n, (x >> 15) * share, (x & 0x7FFF) * share)
    return w.words(lane)


def numbers_decoded(code: Code, distinct: np.ndarray, frame: np.ndarray) -> np.ndarray:
    """The dictionary numbers of order 0 of all strips in a row."""
    order, lane, running = lanes_of(code.rest)
    before, size = shares(code.levels, distinct)
    first = np.cumsum(distinct) - distinct
    number = np.repeat((np.arange(len(size)) - np.repeat(first, distinct)).astype(U16), size)
    both, first, base = before << 15 | size, first[frame[order]], frame[order] << NUMBER_SHARE
    r, found = Reader(code.numbers, code.n_numbers, order), np.zeros((len(running), len(order)), U16)
    for step, n in enumerate(running):
        above, share = r.above[:n], r.range[:n] >> NUMBER_SHARE
        # Both have at most 48 bits, so the double's whole part is exact.
        at = np.minimum((above / share).astype(np.int64), (1 << NUMBER_SHARE) - 1)
        found[step, :n] = x = number[at + base[:n]]
        x = both[x + first[:n]]
        r.taken(n, above - (x >> 15) * share, (x & 0x7FFF) * share)
    return found.T[lane][np.arange(len(running)) < code.rest[:, None]]


def decoded(code: Code, sizes: np.ndarray, distinct: np.ndarray) -> list[np.ndarray]:
    """The inverse of `coded`."""
    s = Strips(sizes)
    # One more behind them, so that the next one can be looked at in every step.
    numbers = np.append(numbers_decoded(code, distinct, s.frame), U16(0))
    at = (np.cumsum(code.rest) - code.rest)[s.order]
    orders, r = Orders(s.frame[s.order]), Reader(code.orders, code.n_orders, s.order)
    grid = np.zeros((len(s.running), s.n), U16)
    for step, n in enumerate(s.running):
        two, both = orders.guesses(n)
        share, above = r.range[:n] >> BITS, r.above[:n]
        two *= share
        both *= share
        second, named = above < two, above < both
        ids = np.where(named, np.where(second, orders.guess2, orders.guess1), numbers.take(at[:n], mode="clip"))
        at[:n] += ~named
        start, size = bounds(second, named, two, both, r.range[:n])
        r.taken(n, above - start, size)
        orders.learned(n, second, named, ids)
        grid[step, :n] = ids
    flat = np.zeros((s.n, STRIP), U16)
    flat[:, : len(grid)] = grid.T[s.lane]
    flat = flat.ravel()
    return [flat[a : a + n] for a, n in zip((s.begin * STRIP).tolist(), sizes.tolist(), strict=True)]


# --- frames and segments -----------------------------------------------------------------------------------------
@dataclass
class Segment:
    doc_ids: np.ndarray
    lengths: np.ndarray
    before: int
    ids: np.ndarray
    #: So many of the first documents have a null id; their doc_ids say 0.
    nulls: int = 0


def named(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct ids in order and each id's number among them."""
    top = int(ids.max()) + 1
    if top > 1 << 20:
        return np.unique(ids, return_inverse=True)
    seen, number = np.zeros(top, bool), np.empty(top, U16)
    seen[ids] = True
    found = np.flatnonzero(seen)
    number[found] = np.arange(len(found))
    return found, number[ids]


def frames_of(chunks: list[np.ndarray]) -> list[bytes]:
    """Each chunk of at most FRAME ids as a frame; LANES at a time."""
    out = []
    for at in range(0, len(chunks), LANES):
        group = chunks[at : at + LANES]
        dictionaries, symbols = zip(*map(named, group), strict=True)
        distinct = np.array([len(d) for d in dictionaries])
        code = coded(list(symbols), distinct)
        gaps = np.diff(np.concatenate(dictionaries).astype(np.int64), prepend=0)
        gaps[np.cumsum(distinct) - distinct] = [d[0] for d in dictionaries]
        dictionary = strip = orders = numbers = 0
        for ids, d, names in zip(group, dictionaries, varint_rows(gaps, distinct), strict=True):
            its = slice(strip, strip := strip + -(-len(ids) // STRIP))
            counts = varints(np.concatenate([code.rest[its], code.n_orders[its], code.n_numbers[its]]))
            told = code.orders[orders : (orders := orders + 2 * int(code.n_orders[its].sum()))]
            rest = code.numbers[numbers : (numbers := numbers + 2 * int(code.n_numbers[its].sum()))]
            levels = halves(code.levels[dictionary : (dictionary := dictionary + len(d))])
            crc = zlib.crc32(ids.astype("<u4", copy=False).tobytes())
            out.append(b"".join([FRAME_HEAD.pack(len(ids), len(d), len(names), len(counts), crc), names, levels, counts, told, rest]))
    return out


def halves(levels: np.ndarray) -> bytes:
    """Values below 16, two in a byte, the first one low."""
    even = np.zeros(len(levels) + 1 & ~1, np.uint8)
    even[: len(levels)] = levels
    return (even[::2] | even[1::2] << 4).tobytes()


def from_halves(data: np.ndarray, count: int) -> np.ndarray:
    return np.stack([data & 15, data >> 4], 1).ravel()[:count]


def packed_segments(segments: list[Segment]) -> list[bytes]:
    cuts = [range(0, len(s.ids), FRAME) for s in segments]
    frames = iter(frames_of([s.ids[a : a + FRAME] for s, c in zip(segments, cuts, strict=True) for a in c]))
    out = []
    for s, c in zip(segments, cuts, strict=True):
        steps = np.diff(s.doc_ids.astype(np.int64), prepend=0)
        zigzag = (steps.astype(np.int64) << 1 ^ steps >> 63).view(U64)
        index = varints(zigzag) + varints(s.lengths)
        out.append(HEAD.pack(MAGIC, len(s.doc_ids), s.nulls, s.before, len(index)) + index + b"".join(next(frames) for _ in c))
    return out


def unpacked_segments(rows: list[bytes]) -> list[Segment]:
    """Checks every frame's sum; a broken one raises ValueError."""
    heads, parts = [], []
    for k, row in enumerate(rows):
        magic, docs, nulls, before, index = HEAD.unpack_from(row)
        if magic != MAGIC:
            raise ValueError("not a segment")
        data = np.frombuffer(row, np.uint8)
        told, _ = from_varints(data[HEAD.size : HEAD.size + index], 2 * docs)
        zigzag, lengths = told[:docs], told[docs:]
        steps = (zigzag >> U64(1)).astype(np.int64) ^ -(zigzag & U64(1)).astype(np.int64)
        heads.append((np.cumsum(steps), lengths.astype(np.int64), before, nulls))
        at = HEAD.size + index
        while at < len(row):
            n, distinct, names, counts, crc = FRAME_HEAD.unpack_from(row, at)
            at += FRAME_HEAD.size
            ends = np.cumsum([at, names, (distinct + 1) // 2, counts]).tolist()
            levels, strips = from_halves(data[ends[1] : ends[2]], distinct), -(-n // STRIP)
            of = from_varints(data[ends[2] : ends[3]], 3 * strips)[0].astype(np.int64).reshape(3, strips)
            middle = ends[3] + 2 * int(of[1].sum())
            at = middle + 2 * int(of[2].sum())
            if at > len(row):
                raise ValueError("a frame runs beyond its segment")
            parts.append((k, n, distinct, row[ends[0] : ends[1]], crc, Code(levels, *of, row[ends[3] : middle], row[middle:at])))
    ids: list[np.ndarray] = []
    for start in range(0, len(parts), LANES):
        _, sizes, distinct, names, crcs, codes = zip(*parts[start : start + LANES], strict=True)
        gaps, _ = from_varints(np.frombuffer(b"".join(names), np.uint8), sum(distinct))
        # Sums of the gaps of all frames: each frame's begin at 0.
        known, cuts = np.concatenate([[0], np.cumsum(gaps.astype(np.int64))]), np.cumsum(distinct)[:-1]
        names = [x - base for x, base in zip(np.split(known[1:], cuts), known[np.concatenate([[0], cuts])].tolist(), strict=True)]
        joined = [np.concatenate([getattr(c, x) for c in codes]) for x in ("levels", "rest", "n_orders", "n_numbers")]
        code = Code(*joined, b"".join([c.orders for c in codes]), b"".join([c.numbers for c in codes]))
        for symbols, name, crc in zip(decoded(code, np.array(sizes), np.array(distinct)), names, crcs, strict=True):
            if symbols.max() >= len(name) or zlib.crc32((x := name[symbols].astype("<u4")).tobytes()) != crc:
                raise ValueError("a frame's sum doesn't match")
            ids.append(x)
    whole: list[list[np.ndarray]] = [[] for _ in rows]
    for (k, *_), x in zip(parts, ids, strict=True):
        whole[k].append(x)
    return [Segment(d, n, before, np.concatenate(x) if x else np.empty(0, "<u4"), nulls) for (d, n, before, nulls), x in zip(heads, whole, strict=True)]
