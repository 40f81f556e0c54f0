"""An adaptive context-mixing range coder for token ids, over many independent blocks at once.

A block starts from fresh models. The ids of a block are coded one after the other; blocks are
coded side by side, one NumPy lane each, LANES at a time.

Order-2 and order-1 models each predict the next id: the id last seen after the same two ids and
after the same one id. The coder first codes which prediction holds: order 2, else order 1, else
none. Its distribution mixes three adaptive ones, kept by the confidence of the order-2 prediction,
by that of the order-1 prediction and by none; the mixing weights follow what each of them gave to
the outcomes. When none holds, the id is coded by the order-0 model: an adaptive distribution of
its class, then evenly within it. A class holds the ids between two half powers of two, since the
ids of a learned vocabulary ascend as their frequency falls.

The predictions learn from every id, the distributions are made anew from their counts after 8, 16,
32 and 64 ids and then after every REFRESH ids, which costs a lane little and the decoder repeats.

All arithmetic is on integers, so that decoding is exact on any machine. The coder keeps a low end
and a range of 64 bits and puts out words of 32 bits.
"""

from __future__ import annotations

from functools import cache

import numpy as np

LANES = 2_048
TABLE_BITS = 7
EVENT_BITS = 9
CLASS_BITS = 8
REFRESH = 128
_DEEP = 32 - EVENT_BITS - CLASS_BITS  # bits within a class that the step of its id has room for
_U = np.uint64
_LOW = _U(2**32 - 1)
_S32 = _U(32)
_ONE = _U(1)
_MASK = 1023
_STEP = np.array([1, 2, 3, 3, 0], dtype=np.int32)  # the next confidence by the last one; 0 after another id
_PARTS = 12  # probabilities before they are mixed


@cache
def _classes(id_bits: int) -> tuple[np.ndarray, np.ndarray]:
    """(first id, bits within) of each class, and a last entry for an id that a prediction gave."""
    edges = sorted({min(b, 1 << id_bits) for e in range(id_bits + 1) for b in ((1 << e) - 1, (3 << e >> 1) - 1)} | {1 << id_bits})
    bits = [(b - a - 1).bit_length() for a, b in zip(edges, edges[1:])]
    return np.array([*edges[:-1], 0], dtype=np.int64), np.array([*bits, 0], dtype=np.int64)


@cache
def _class_of(id_bits: int) -> np.ndarray:
    first = _classes(id_bits)[0][:-1]
    return np.repeat(np.arange(len(first), dtype=np.uint8), np.diff(np.append(first, 1 << id_bits)))


def _class(ids: np.ndarray, id_bits: int) -> np.ndarray:
    if id_bits <= 20:
        return _class_of(id_bits).take(ids)
    return (np.searchsorted(_classes(id_bits)[0][:-1], ids, "right") - 1).astype(np.uint8)


class _Coder:
    """Range coding in lanes; `words` are read when decoding, written otherwise."""

    def __init__(self, words: np.ndarray, decoding: bool):
        lanes, self.width = words.shape
        self.low = np.zeros(lanes, dtype=_U)
        self.range = np.full(lanes, 2**64 - 1, dtype=_U)
        self.words = words.reshape(-1)
        self.used = np.arange(lanes) * self.width
        self.decoding = decoding
        if decoding:
            self.code = (words[:, 0].astype(_U) << _S32) | words[:, 1]
            self.used += 2

    def resize(self, lanes: int) -> None:
        """Code only the first lanes from here on; views, so that the rest keep their ends."""
        self.now = [a[:lanes] for a in (self.low, self.range, self.used)]
        self.now.append(self.code[:lanes] if self.decoding else None)

    def settle(self) -> None:
        """Put out, or take in, a word where the range has become narrow."""
        low, width, used, code = self.now
        need = np.flatnonzero(width <= _LOW)
        if len(need):
            lo, wi = low.take(need), width.take(need)
            cross = np.flatnonzero((lo ^ (lo + (wi - _U(1)))) > _LOW)  # the leading word isn't settled: stay below its change
            if len(cross):
                wi[cross] = _U(2**32) - (lo[cross] & _LOW)
            at = used.take(need)
            if self.decoding:
                code[need] = (code.take(need) << _S32) | self.words.take(at)
            else:
                self.words[at] = lo >> _S32
            used[need] = at + 1
            low[need], width[need] = lo << _S32, wi << _S32

    def finish(self) -> None:
        for k in (0, 1):
            self.words[self.used] = self.low >> _S32 if k == 0 else self.low & _LOW
            self.used += 1


class _Models:
    def __init__(self, lanes: int, id_bits: int, decoding: bool):
        self.lanes, self.decoding = lanes, decoding
        self.first_id, self.bits = (a.astype(np.int32) for a in _classes(id_bits))
        self.none = len(self.bits) - 1  # the class of an id that a prediction gave
        self.table1 = np.zeros(lanes << TABLE_BITS, dtype=np.int32)  # id * 4 + confidence
        self.table2 = np.zeros(lanes << TABLE_BITS, dtype=np.int32)
        self.events = np.empty((REFRESH, lanes), dtype=np.int64)  # since the last count: where they are in event_span,
        self.kinds = np.empty((REFRESH, lanes), dtype=np.int64)  # and in class_span
        self.held = 0
        self.seen = np.zeros((4, 4, 3, lanes), dtype=np.int32)  # by confidence of order 2, of order 1, outcome
        self.total = [np.ones((n, 3, lanes), dtype=np.int32) for n in (4, 4, 1)]
        self.given = [np.full((n, 3, lanes), (1 << _PARTS) // 3, dtype=np.int32) for n in (4, 4, 1)]
        self.weight = [np.full(lanes, 85, dtype=np.int64) for _ in range(3)]
        self.seen_class = np.zeros((self.none + 1, lanes), dtype=np.int32)
        self.class_span = np.empty((self.none + 1, lanes), dtype=np.int32)  # start, size and bits within in 10, 10 and 5 bits
        self.class_span[-1] = 1 << CLASS_BITS + 5
        self.steps = 0
        self.before, self.carried = np.zeros(lanes, np.uint32), np.zeros(lanes, np.uint32)
        self.spans()
        self.resize(lanes)

    def resize(self, lanes: int) -> None:
        """Code only the first lanes from here on; blocks are in descending order of length."""
        if self.held:
            self.tally()  # no more than that: what a block learns must not depend on the others
        self.row = np.arange(lanes)
        self.row32 = self.row.astype(np.int32)
        self.base = self.row.astype(np.uint32) << np.uint32(TABLE_BITS)
        self.before, self.carried = self.before[:lanes], self.carried[:lanes]

    def predict(self) -> None:
        h = self.before * np.uint32(0x9E3779B1)
        self.slot1 = ((h >> np.uint32(32 - TABLE_BITS)) + self.base).astype(np.intp)
        h += self.carried
        self.slot2 = ((h >> np.uint32(32 - TABLE_BITS)) + self.base).astype(np.intp)
        self.s1, self.s2 = self.table1.take(self.slot1), self.table2.take(self.slot2)
        self.cell = (((self.s2 & 3) << 2) | (self.s1 & 3)) * np.int32(3 * self.lanes) + self.row32

    def learn(self, event_at: np.ndarray, class_at: np.ndarray, ids: np.ndarray) -> None:
        n = len(ids)
        self.events[self.held, :n], self.kinds[self.held, :n] = event_at, class_at
        self.held += 1
        fresh = ids << 2
        for table, slot, was in ((self.table1, self.slot1, self.s1), (self.table2, self.slot2, self.s2)):
            was ^= fresh
            table[slot] = fresh + _STEP.take(np.minimum(was, 4))
        self.carried = self.before * np.uint32(0x85EBCA6B)
        self.before = ids.view(np.uint32)
        self.steps += 1
        if self.steps % REFRESH == 0 or self.steps in (8, 16, 32, 64):
            self.count()
            self.spans()

    def tally(self) -> None:
        n = self.lanes
        seen, kinds = (np.bincount(a[:self.held, :len(self.row)].reshape(-1), minlength=k * n).astype(np.int32).reshape(k, n)
                       for a, k in ((self.events, 48), (self.kinds, self.none + 1)))
        self.held = 0
        self.seen_class += kinds
        self.seen += seen.reshape(4, 4, 3, n)

    def count(self) -> None:
        self.tally()
        by2, by1 = self.seen.sum(axis=1, dtype=np.int32), self.seen.sum(axis=0, dtype=np.int32)
        self.seen[:] = 0
        fresh = [by2, by1, by2.sum(axis=0, dtype=np.int32, keepdims=True)]
        gave = [w * (f * g).sum(axis=(0, 1), dtype=np.int64) for w, f, g in zip(self.weight, fresh, self.given)]
        every = np.maximum(sum(gave), 1)
        for k in (0, 1):
            self.weight[k] = 8 + gave[k] * 232 // every
        self.weight[2] = 256 - self.weight[0] - self.weight[1]
        for k, f in enumerate(fresh):
            self.total[k] += f
            self.given[k] = (self.total[k] << _PARTS) // self.total[k].sum(axis=1, dtype=np.int32, keepdims=True)

    def spans(self) -> None:
        """Distributions from the counts; every outcome and class stays possible."""
        w2, w1, w0 = (w.astype(np.int32) for w in self.weight)
        mixed = (self.given[0] * w2)[:, None] + (self.given[1] * w1 + self.given[2] * w0)
        every = 1 << EVENT_BITS
        a, b = (1 + (mixed[:, :, e] * (every - 3) >> _PARTS + 8) for e in (0, 1))
        self.event_span = np.stack([a, (a << 10) | b, ((a + b) << 10) | (every - a - b)], axis=2)
        counts = self.seen_class[:-1] * 4 + 1
        upto = np.cumsum(counts, axis=0, dtype=np.int32)
        n = self.none
        upto = upto * np.int32((1 << CLASS_BITS) - n) // upto[-1]
        upto += np.arange(1, n + 1, dtype=np.int32)[:, None]
        span = self.class_span[:-1]
        span[0] = upto[0] << 5
        span[1:] = (upto[:-1] << 15) | ((upto[1:] - upto[:-1]) << 5)
        span |= self.bits[:-1, None]
        if self.decoding:
            mark = np.zeros((1 << CLASS_BITS, self.lanes), dtype=np.uint8)
            mark.reshape(-1)[upto[:-1] * np.int64(self.lanes) + np.arange(self.lanes)] = 1
            for above, here in zip(mark, mark[1:]):  # faster than accumulate along the first axis
                here += above
            self.class_at = mark


def encode(blocks: list[np.ndarray], id_bits: int) -> list[bytes]:
    """The coded form of each block of ids below 2^id_bits; an empty block has the coder's ends alone, other ids raise."""
    flat = np.concatenate([np.empty(0, np.uint8), *blocks])
    if len(flat) and (int(flat.max()) >> id_bits or int(flat.min()) < 0):
        raise ValueError(f"an id does not fit {id_bits} bits")
    order = sorted(range(len(blocks)), key=lambda k: -len(blocks[k]))
    out: list[bytes] = [b""] * len(blocks)
    for a in range(0, len(order), LANES):
        some = order[a:a + LANES]
        for k, coded in zip(some, _encode([blocks[k] for k in some], id_bits)):
            out[k] = coded
    return out


def _live(sizes: list[int]) -> list[int]:
    """How many blocks, in descending order of length, have an id at each place."""
    return np.searchsorted(-np.array(sizes), -np.arange(sizes[0]), "left").tolist()


def _encode(blocks: list[np.ndarray], id_bits: int) -> list[bytes]:
    live = _live([len(b) for b in blocks])
    ids = np.zeros((len(blocks), len(live)), dtype=np.int32)
    for lane, b in enumerate(blocks):
        ids[lane, :len(b)] = b
    ids = np.ascontiguousarray(ids.T)
    m = _Models(len(blocks), id_bits, False)
    deep = int(m.bits.max()) > _DEEP
    kinds, none = _class(ids, id_bits), np.uint8(m.none)
    c = _Coder(np.zeros((len(blocks), (1 + deep) * len(live) + 4), dtype=np.uint32), False)
    lanes = 0
    for t, n in enumerate(live):
        if n != lanes:
            lanes = n
            m.resize(n)
            c.resize(n)
        now = ids[t, :n]
        m.predict()
        other1, other2 = (m.s1 >> 2) != now, (m.s2 >> 2) != now
        missed = other1 & other2
        event_at = (m.cell + (other2.view(np.int8) + missed.view(np.int8)) * np.int32(m.lanes)).astype(np.intp)
        kind = np.where(missed, kinds[t, :n], none)
        class_at = (kind * np.int32(m.lanes) + m.row32).astype(np.intp)
        event, span = m.event_span.reshape(-1).take(event_at), m.class_span.reshape(-1).take(class_at)
        size = event & _MASK
        start = ((event >> 10) << CLASS_BITS) + (span >> 15) * size
        rest = (now - m.first_id.take(kind)) * missed
        low, width = c.now[:2]
        unit = width >> _U(EVENT_BITS + CLASS_BITS)
        low += start.astype(_U) * unit
        unit *= (size * ((span >> 5) & _MASK)).astype(_U)
        bits = span & 31
        if deep:
            below = np.maximum(bits - _DEEP, 0)
            bits -= below
            unit >>= bits.astype(_U)
            low += (rest >> below).astype(_U) * unit
            width[:] = unit
            c.settle()
            unit = width >> below.astype(_U)
            rest &= (1 << below) - 1
        else:
            unit >>= bits.astype(_U)
        low += rest.astype(_U) * unit
        width[:] = unit
        c.settle()
        m.learn(event_at, class_at, now)
    c.finish()
    words, begin = c.words.astype("<u4", copy=False), np.arange(len(blocks)) * c.width
    return [words[a:b].tobytes() for a, b in zip(begin.tolist(), c.used.tolist())]


def decode(coded: list[bytes], sizes: list[int], id_bits: int) -> list[np.ndarray]:
    """The ids of coded blocks with the given numbers of ids."""
    order = sorted(range(len(coded)), key=lambda k: -sizes[k])
    out: list[np.ndarray] = [np.empty(0, np.int64)] * len(coded)
    for a in range(0, len(order), LANES):
        some = order[a:a + LANES]
        for k, ids in zip(some, _decode([coded[k] for k in some], [sizes[k] for k in some], id_bits)):
            out[k] = ids
    return out


def _decode(coded: list[bytes], sizes: list[int], id_bits: int) -> list[np.ndarray]:
    live = _live(sizes)
    words = np.zeros((len(coded), max(len(b) // 4 for b in coded) + 4), dtype=np.uint32)
    for lane, b in enumerate(coded):
        w = np.frombuffer(b, dtype="<u4")
        words[lane, :len(w)] = w
    m, c = _Models(len(coded), id_bits, True), _Coder(words, True)
    deep = int(m.bits.max()) > _DEEP
    ids, none = np.zeros((len(live), len(coded)), dtype=np.int32), np.uint8(m.none)
    top = _U((1 << EVENT_BITS + CLASS_BITS) - 1)
    lanes = 0
    for t, n in enumerate(live):
        if n != lanes:
            lanes = n
            m.resize(n)
            c.resize(n)
        m.predict()
        low, width, _, code = c.now
        unit = width >> _U(EVENT_BITS + CLASS_BITS)
        left = code - low
        target = np.minimum(left // unit, top).astype(np.int32)
        spans = m.event_span.reshape(-1)
        want = target >> CLASS_BITS
        middle = spans.take(m.cell + np.int32(m.lanes))
        begin = middle >> 10
        hit2 = want < begin
        missed = want >= begin + (middle & _MASK)
        event_at = (m.cell + (missed.view(np.int8) - hit2.view(np.int8) + np.int8(1)) * np.int32(m.lanes)).astype(np.intp)
        event = spans.take(event_at)
        size = event & _MASK
        begin = (event >> 10) << CLASS_BITS
        place = (target - begin) // size
        kind = np.where(missed, m.class_at.reshape(-1).take(place * np.int32(m.lanes) + m.row32), none)
        class_at = (kind * np.int32(m.lanes) + m.row32).astype(np.intp)
        span = m.class_span.reshape(-1).take(class_at)
        gone = (begin + (span >> 15) * size).astype(_U) * unit
        low += gone
        left -= gone
        unit *= (size * ((span >> 5) & _MASK)).astype(_U)
        bits = (span & 31).astype(_U)
        below = np.maximum(bits, _U(_DEEP)) - _U(_DEEP) if deep else None
        if deep:
            bits -= below
        unit >>= bits
        rest = np.minimum(left // unit, (_ONE << bits) - _ONE)
        low += rest * unit
        width[:] = unit
        c.settle()
        if deep:
            unit = width >> below
            more = np.minimum((code - low) // unit, (_ONE << below) - _ONE)
            low += more * unit
            width[:] = unit
            c.settle()
            rest = (rest << below) | more
        now = np.where(missed, m.first_id.take(kind) + rest.astype(np.int32), np.where(hit2, m.s2, m.s1) >> 2)
        m.learn(event_at, class_at, now)
        ids[t, :n] = now
    ids = np.ascontiguousarray(ids.T)
    return [ids[lane, :s] for lane, s in enumerate(sizes)]
