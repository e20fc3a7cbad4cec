"""Adaptive context-mixing range coder for blocks of token ids, coded in lanes that advance in lockstep.

A block's ids are dealt to lanes, stretches of equal length with a code of their own, which advance together, one id a
step, as numpy arrays. All lanes of a block share one model, which starts empty, so blocks are independent. For each id
the order-2 context (last two ids) and the order-1 context (last id) predict one id each; the higher order's is the
candidate. Whether it holds is a binary decision, whose probability mixes in the logistic domain, with weights learnt as
it goes, what the confidence of either order and of both together have meant so far. Any other id is coded by order 0,
with the frequencies of the ids that were not predicted; ids of over 17 bits in several digits. The model learns behind
every few steps, from all lanes at once: what has the same state is counted, and the mixing is done once for each state.
All arithmetic that the code depends on is exact, so any machine decodes alike.

The range coder has a window of 48 bits and moves by whole 16-bit words, twice an id at most. The coder keeps its
carries in the words it has written and settles them at the end.

Layout of a block: 4 bytes magic and version, uint32 CRC-32 of all bytes that follow, uint32 number of ids, uint32 CRC-32
of the ids as little-endian uint32, uint8 bits per id, uint32 number of lanes, uint32 words of each lane's code, then the
lanes' codes as little-endian 16-bit words. Ids that fill up the last lane are zeros.
"""

from __future__ import annotations

import math
import struct
import zlib

import numpy as np

MAGIC = b"CMR3"
HEAD, SUM = struct.Struct("<IIBI"), struct.Struct("<4sI")
#: The range is kept from 2 ** 32 to 2 ** 48; frequencies add up to 2 ** 20, decisions have 16 bits.
LEAST, MASK, TOTAL = 1 << 32, (1 << 32) - 1, 1 << 20
#: Fewest steps of a lane; ids behind which the model learns, in whole steps, and the most steps that this takes.
STEPS, LEARNS, PATIENCE = 256, 16_384, 16
#: Most bits of a digit of order 0, of order 1's table and of order 2's.
DIGIT, ONE, TWO = 17, 17, 19
FIRST, SECOND = np.uint32(0x9E3779B1), np.uint32(0x85EBCA6B)

#: ln(p / (1 - p)) on 12 bits in units of 1/256, and its inverse.
STRETCH = np.array([round(math.log((i + 0.5) / (4095.5 - i)) * 256) for i in range(4096)], dtype=np.int64).clip(-2047, 2047)
SQUASH = np.array([min(4095, max(1, round(4096 / (1 + math.exp(-x / 256))))) for x in range(-2400, 2401)], dtype=np.int64)
HEAVIEST = 400_000
#: A prediction's confidence (1 to 7; 0: none) after it failed, and after it held.
SURER = np.array([1, 1, 1, 1, 2, 2, 3, 3, 1, 2, 3, 4, 5, 6, 7, 7], dtype=np.uint32)
#: What a confidence means before anything is learnt, in 1/65536.
TRUST = np.array([64, 16_000, 26_000, 36_000, 42_000, 48_000, 52_000, 56_000], dtype=np.int64)
#: The state of a decision: confidence of order 2 and of order 1 (3 bits each), and whether they agree.
STATE = np.arange(128)
SURE2, SURE1, AGREE = STATE >> 4, STATE >> 1 & 7, STATE & 1
NONE = (SURE2 == 0) & (SURE1 == 0)


def _either(mask: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """np.where for whole numbers, without branches: conditions here are hard to foresee."""
    return b ^ ((a ^ b) & -mask.astype(a.dtype))


class _Order0:
    """Frequencies of one digit, counted anew when half as many have come as were counted."""

    def __init__(self, bits: int, reads: bool) -> None:
        self.size, self.reads = 1 << bits, reads
        self.counts, self.counted = np.zeros(self.size, np.int64), 0
        self.new: list[np.ndarray] = []
        self.waiting = 0
        self._set(np.arange(self.size + 1) * (TOTAL // self.size))

    def _set(self, ends: np.ndarray) -> None:
        self.begin, self.width = ends[:-1].copy(), np.diff(ends)
        if self.reads:
            self.found = np.repeat(np.arange(self.size, dtype=np.uint32), self.width)

    def learn(self, digits: np.ndarray) -> None:
        self.new.append(digits)
        self.waiting += len(digits)
        if self.waiting < max(64, self.counted >> 1):
            return
        self.counts += np.bincount(np.concatenate(self.new), minlength=self.size)
        self.counted, self.waiting, self.new = self.counted + self.waiting, 0, []
        ends = np.arange(self.size + 1)  # one for each, the rest by their numbers
        ends[1:] += np.cumsum(self.counts) * (TOTAL - self.size) // self.counted
        self._set(ends)


class _Model:
    def __init__(self, bits: int, n: int, reads: bool) -> None:
        kind = np.int64 if bits > 29 else np.uint32
        two = min(TWO, max(8, n.bit_length()))
        self.direct, self.shift = bits <= ONE, np.uint32(32 - two)
        self.one = np.zeros(1 << min(bits, ONE), kind)  # id and 3 bits of confidence
        self.two = np.zeros(1 << two, kind)
        parts = -(-bits // DIGIT)
        cuts = [bits * k // parts for k in range(parts, -1, -1)]
        self.digits = [(lo, (1 << hi - lo) - 1, _Order0(hi - lo, reads)) for hi, lo in zip(cuts[:-1], cuts[1:])]
        self.inputs = np.stack([SURE2 * 2 + AGREE, 16 + SURE1 * 4 + AGREE * 2 + (SURE2 == 0), 48 + STATE])  # cells of trust
        self.trust = np.empty(48 + 128, np.int64)
        self.trust[self.inputs] = TRUST[np.stack([SURE2, SURE1, np.where(SURE2 == 0, SURE1, SURE2)])]
        self.sets = np.where(SURE2 == 0, 3, 0) + np.arange(3)[:, None]
        self.weight = np.full(6, 24_000, np.int64)
        self._mix()

    def _mix(self) -> None:
        """Probability (1/65536) that the candidate holds, for each state."""
        self.stretched = STRETCH[self.trust[self.inputs] >> 4]
        reach = (self.stretched * self.weight[self.sets]).sum(axis=0) >> 16
        self.mixed = SQUASH[reach.clip(-2400, 2400) + 2400]
        self.p = np.where(NONE, 0, self.mixed << 4)

    def look(self, last: np.ndarray, before: np.ndarray) -> tuple[np.ndarray, ...]:
        """Places in both tables, what is there, and the state."""
        at1 = (last if self.direct else (last * FIRST) >> np.uint32(32 - ONE)).astype(np.intp)
        at2 = ((last * FIRST + before * SECOND) >> self.shift).astype(np.intp)
        known1, known2 = self.one.take(at1), self.two.take(at2)
        state = ((known2 & 7) << 4) | ((known1 & 7) << 1) | ((known1 ^ known2) < 8)
        return at1, at2, known1, known2, state

    def learn(self, seen: tuple[np.ndarray, ...], want: np.ndarray, held: np.ndarray) -> None:
        """From some steps at once: where several lanes came to one place of a table, the last one's stays."""
        at1, at2, known1, known2, state = seen
        anew = (want.astype(known1.dtype) << 3) | 1  # also what an empty place, 0, becomes
        for table, at, known in ((self.one, at1, known1), (self.two, at2, known2)):
            sure = known & 7
            right = (known ^ anew) < 8
            table[at] = _either(right | (sure > 1), known - sure + SURER.take(sure + (right.view(np.uint8) << 3)).astype(known.dtype), anew)
        rest = want.take((~held).nonzero()[0])
        for low, mask, order0 in self.digits:
            order0.learn(rest >> np.uint32(low) & np.uint32(mask))
        both = np.bincount(state.astype(np.intp) * 2 + held, minlength=256).reshape(128, 2)
        hits, n = both[:, 1] * ~NONE, both.sum(axis=1) * ~NONE
        errors = hits * 4096 - n * self.mixed
        total = lambda cells, x: np.bincount(cells.reshape(-1), np.broadcast_to(x, cells.shape).reshape(-1)).astype(np.int64)  # noqa: E731  (exact: below 2 ** 53)
        steps, times = total(self.sets, self.stretched * errors), total(self.sets, n)
        self.weight = (self.weight + (steps * 6 >> 10) * 16 // (times + 16)).clip(-HEAVIEST, HEAVIEST)
        own, right = total(self.inputs, n), total(self.inputs, hits)
        self.trust += (right * 65_535 - own * self.trust) // (own + 24)
        self._mix()


def _chunks(steps: int, lanes: int) -> list[tuple[int, int]]:
    """Steps behind which the model learns."""
    size = max(1, min(PATIENCE, LEARNS // lanes))
    return [(a, min(a + size, steps)) for a in range(0, steps, size)]


def _encode(grid: np.ndarray, bits: int) -> tuple[np.ndarray, bytes]:
    """Ids of steps x lanes -> words of each lane, and all words."""
    steps, lanes = grid.shape
    model = _Model(bits, grid.size, False)
    out = np.zeros((steps * 5 // 8 + 8, lanes), np.uint32)
    low, size, at, lane = np.zeros(lanes, np.int64), np.full(lanes, (1 << 48) - 1), np.zeros(lanes, np.int64), np.arange(lanes)
    shown = np.concatenate([np.zeros((2, lanes), np.uint32), grid])  # the same two steps earlier

    def shift(few: np.ndarray) -> np.ndarray:
        own, place, range_ = low[few], at[few], size[few] << 16
        out.reshape(-1)[place * lanes + few] = own >> 32
        low[few], size[few], at[few] = (own & MASK) << 16, range_, place + 1
        return few[range_ < LEAST]

    for a, b in _chunks(steps, lanes):
        want = grid[a:b].reshape(-1)
        seen = model.look(shown[a + 1 : b + 1].reshape(-1), shown[a:b].reshape(-1))
        known1, known2, state = seen[2:]
        held = (_either((known2 & 7) > 0, known2, known1) >> 3 == want) & (state > 1)
        p = model.p.take(state).reshape(b - a, lanes)
        coded = [(o.begin.take(d).reshape(p.shape), o.width.take(d).reshape(p.shape)) for x, m, o in model.digits for d in [(want >> np.uint32(x) & np.uint32(m)).astype(np.intp)]]
        hit = held.reshape(p.shape)
        missed = -(~hit).astype(np.int64)  # all bits
        most = int(at.max()) + 2 * (b - a) * len(coded) + 2
        if most > len(out):
            out = np.concatenate([out, np.zeros((max(most - len(out), len(out) // 4), lanes), np.uint32)])
        for k in range(b - a):
            part = (size >> 16) * p[k]
            rest = size - part
            if len(coded) == 1:
                (begin, width), = coded
                step = rest >> 20
                low += (part + step * begin[k]) & missed[k]
                size = part ^ ((part ^ step * width[k]) & missed[k])
                few = (size < LEAST).nonzero()[0]
                if len(few) and len(few := shift(few)):
                    shift(few)
                continue
            low += part & missed[k]
            size = part ^ ((part ^ rest) & missed[k])
            few = (size < LEAST).nonzero()[0]
            if len(few):
                shift(few)
            miss = (~hit[k]).nonzero()[0]
            for begin, width in coded:
                step = size[miss] >> 20
                low[miss] += step * begin[k][miss]
                size[miss] = step * width[k][miss]
                few = miss[size[miss] < LEAST]
                if len(few) and len(few := shift(few)):
                    shift(few)
        model.learn(seen, want, held)
    out[at, lane] = (low + MASK) >> 32
    for k in range(int(at.max()), 0, -1):
        out[k - 1] += out[k] >> 16
    used = np.arange(len(out))[:, None] <= at
    return at + 1, out.astype("<u2").T[used.T].tobytes()


def _decode(lengths: np.ndarray, code: np.ndarray, steps: int, bits: int) -> np.ndarray:
    """Ids of steps x lanes."""
    lanes = len(lengths)
    model = _Model(bits, steps * lanes, True)
    words = np.zeros((lanes, int(lengths.max()) + 4), np.uint16)
    words[np.arange(words.shape[1]) < lengths[:, None]] = code
    words = np.ascontiguousarray(words.T)
    flat, final = words.reshape(-1), len(words) - 1
    first = words[:3].astype(np.int64)
    low, size, at = (first[0] << 32) | (first[1] << 16) | first[2], np.full(lanes, (1 << 48) - 1), np.full(lanes, 3)
    grid = np.zeros((steps + 2, lanes), np.uint32)  # the first two steps are empty

    def shift(few: np.ndarray) -> np.ndarray:
        place, range_ = np.minimum(at[few], final), size[few] << 16  # zeros follow
        low[few] = (low[few] << 16) | flat.take(place * lanes + few)
        size[few], at[few] = range_, place + 1
        return few[range_ < LEAST]

    for a, b in _chunks(steps, lanes):
        seen, hits = [], []
        for k in range(a, b):
            one = model.look(grid[k + 1], grid[k])
            known1, known2, state = one[2:]
            part = (size >> 16) * model.p.take(state)
            hit = low < part
            miss = (~hit).nonzero()[0]
            own, rest = (low - part).take(miss), (size - part).take(miss)
            found = np.zeros(len(miss), np.uint32)
            if len(model.digits) > 1:
                low[miss], size = own, part
                size[miss] = rest
                few = (size < LEAST).nonzero()[0]
                if len(few):
                    shift(few)
                own, rest = low[miss], size[miss]
            else:
                size = part
            for i, (place, _, order0) in enumerate(model.digits):
                step = rest >> 20
                # exact: own has 48 bits, step 28, and a quotient below a whole number of 20 bits is 2 ** -28 below it at least
                digit = order0.found.take(np.minimum((own / step).astype(np.int64), TOTAL - 1))
                low[miss] = own - step * order0.begin.take(digit)
                size[miss] = step * order0.width.take(digit)
                found |= digit << np.uint32(place)
                few = (size < LEAST).nonzero()[0]
                if len(few) and len(few := shift(few)):
                    shift(few)
                if i + 1 < len(model.digits):
                    own, rest = low[miss], size[miss]
            want = (_either((known2 & 7) > 0, known2, known1) >> 3).astype(np.uint32)
            want[miss] = found
            grid[k + 2] = want
            seen.append(one)
            hits.append(hit)
        model.learn(tuple(np.concatenate(x) for x in zip(*seen)), grid[a + 2 : b + 2].reshape(-1), np.concatenate(hits))
    return grid[2:]


def bits_for(largest: int) -> int:
    return max(1, largest.bit_length())


def encode_blocks(blocks: list[np.ndarray], bits: int, lanes: int = 4096) -> list[bytes]:
    """Each block of ids (uint32) as self-contained bytes, of so many lanes at most. All ids must fit in `bits` bits."""
    out = []
    for ids in blocks:
        steps = max(STEPS, -(-len(ids) // lanes))
        own = -(-len(ids) // steps)
        body = HEAD.pack(len(ids), zlib.crc32(ids.astype("<u4").tobytes()), bits, own)
        if own:
            steps = -(-len(ids) // own)
            grid = np.zeros(own * steps, np.uint32)
            grid[: len(ids)] = ids
            lengths, code = _encode(np.ascontiguousarray(grid.reshape(own, steps).T), bits)
            body += lengths.astype("<u4").tobytes() + code
        out.append(SUM.pack(MAGIC, zlib.crc32(body)) + body)
    return out


def decode_blocks(coded: list[bytes], lanes: int = 4096) -> list[np.ndarray]:
    """The ids (uint32) of each block; a ValueError tells of a damaged one, or of one that has more lanes."""
    out = []
    for c in coded:
        if len(c) < SUM.size + HEAD.size or c[:4] != MAGIC:
            raise ValueError("not a block of this format")
        body = memoryview(c)[SUM.size :]
        if zlib.crc32(body) != SUM.unpack_from(c)[1]:
            raise ValueError("a block is damaged")
        n, crc, bits, own = HEAD.unpack_from(body)
        if own > lanes:
            raise ValueError("a block has more lanes")
        ids = np.empty(0, np.uint32)
        if own:
            lengths = np.frombuffer(body, "<u4", own, HEAD.size).astype(np.int64)
            grid = _decode(lengths, np.frombuffer(body, "<u2", -1, HEAD.size + 4 * own), -(-n // own), bits)
            ids = np.ascontiguousarray(grid.T).reshape(-1)[:n]
        if zlib.crc32(ids.astype("<u4").tobytes()) != crc:
            raise ValueError("a block's checksum does not match")
        out.append(ids)
    return out
