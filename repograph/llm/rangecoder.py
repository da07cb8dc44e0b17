"""Token-id blocks coded by an adaptive context-mixing range coder, many blocks at a time.

Every block starts from the same state, so blocks can be read alone and a damaged one harms no other; a block carries a CRC-32 of its ids.
Three predictions of the next id are mixed:

* order 2 and order 1: the id that followed last after the same two (one) ids, with how unsure it is by how often in a row it was right;
* order 0: how often ids of each class have occurred in the block, over a fixed prior in which smaller ids are likelier. A class is a stretch of
  neighbouring ids: small ids have one each, larger ones share theirs, so that the state of a block is of the same few KB for any vocabulary.

Order 0 has 2**FREQ_BITS parts, whole slots for each class. What order 2 and 1 predict comes before them, with parts by how often predictions of the same
pair of degrees have been right in this block; where both predict the same id, it has the parts of both (what a predicted id has in order 0 stays unused).
The range is narrowed by this one cumulative distribution; 24 bits leave it at a time. Order 0 and the parts of predictions are brought up to date at fixed
steps, so what lies between two of them is worked out for many steps at once where the ids are known.

All blocks of a batch advance together, as numpy arrays with one entry for each block. Numbers of the range are whole and below 2**53, in doubles, which
hold them exactly. Memory goes with LANES times the longest block; callers keep blocks short.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator
from functools import cache

import numpy as np

MAGIC = b"RGTB3\0"
VOCABULARY = 1 << 16
#: Parts of order 0, and of one of its slots. All parts together are 2**MOST_BITS at most.
FREQ_BITS, SLOT_BITS, MOST_BITS = 20, 7, 24
SLOTS = 1 << FREQ_BITS - SLOT_BITS
#: Entries of the tables of contexts.
CONTEXTS = 1 << 12
#: Order 0 and weights are brought up to date at these steps, and after as many as REFRESH from the last of them.
EARLY, REFRESH = (64, 192, 448, 960), 1024
#: Ids with a class of their own; beyond, each doubling of the id has SPLIT classes.
SINGLE, SPLIT = 256, 32
#: Blocks that advance together, and steps that are worked out at once.
LANES, STEPS = 1024, 64
#: Occurrences that weigh as much as the prior of all classes, and as that of a pair of degrees.
PRIOR, PRIOR_PAIR = 256, 16
#: Degrees of how unsure a prediction is: 0 if it was right three times in a row, or more often.
UNSURE = 4
#: How often in 64 a prediction of each degree is right, before any was made.
RIGHT = (48, 16, 8, 1)
#: The range is from 2**LEAST_BITS to 2**(LEAST_BITS + DIGIT_BITS).
DIGIT_BITS, LEAST_BITS = 24, 28
_DIGIT, _LEAST = float(1 << DIGIT_BITS), float(1 << LEAST_BITS)
_HASH = 0x9E5


@cache
def _classes(vocabulary: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """For each id its class and its place in it; for each class its first id, the logarithm of its size and its prior."""
    first, bits = [], []
    at = 0
    while at < vocabulary:
        wide = 0 if at < SINGLE else max(0, at.bit_length() - 1 - SPLIT.bit_length() + 1)
        first.append(at)
        bits.append(wide)
        at += 1 << wide
    first_, bits_ = np.array(first), np.array(bits)
    of = np.repeat(np.arange(len(first)), 1 << bits_)
    place = np.arange(len(of)) - np.repeat(first_, 1 << bits_)
    # Whole numbers throughout, so that sums are the same on all machines.
    prior = np.add.reduceat((1 << 24) // (np.arange(len(of)) + 64), first_)
    return of[:vocabulary], place[:vocabulary], first_, bits_, (prior << 16) // prior.sum() + 1


class _Model:
    """The state of all blocks of a batch."""

    def __init__(self, lanes: int, vocabulary: int, slots: bool = False):
        if not 0 < vocabulary <= VOCABULARY:
            raise ValueError("a vocabulary has 1 to 65536 ids")
        self.of, self.place, self.first, self.bits, self.prior = _classes(vocabulary)
        self.n = len(self.first)
        lane = np.arange(lanes)
        # All tables are flat, with one stretch for each block. A context's entry is an id and, in its last two bits, how unsure it is.
        self.contexts_at = np.stack([lane * 2 * CONTEXTS, (lane * 2 + 1) * CONTEXTS])
        self.table = np.full(lanes * 2 * CONTEXTS, UNSURE - 1, dtype=np.int32)
        self.pair_at, self.class_at, self.slot_at = lane * UNSURE**2, lane * self.n, lane * SLOTS
        self.counts = np.zeros((lanes, self.n), dtype=np.int64)
        self.tried, self.right = np.zeros((lanes, UNSURE**2)), np.zeros((2, lanes, UNSURE**2))
        # A class's first part and the parts of each of its ids; the parts of both predictions and of that of order 2. Pairs, held as complex numbers.
        self.held, self.parts = np.zeros((lanes, self.n), dtype=complex), np.zeros((lanes, UNSURE**2), dtype=complex)
        # The class of each slot, if wanted.
        self.slots = np.zeros((lanes * slots, SLOTS), dtype=np.int16)

    def update(self, k: int, ids: np.ndarray, seen: np.ndarray) -> None:
        """Take the ids(step, block) of the first k blocks since the last time into order 0, and what was ``seen`` of pairs and hits into the weights."""
        least = np.maximum(1, 1 << self.bits >> SLOT_BITS)
        before = np.concatenate([[0], np.cumsum(least)])
        for a in range(0, k, 128):
            b = min(k, a + 128)
            n = b - a
            if len(ids):
                self.counts[a:b] += np.bincount((self.of.take(ids[:, a:b]) + np.arange(n) * self.n).ravel(), minlength=n * self.n).reshape(n, self.n)
                pairs = np.bincount((seen[:, a:b] + np.arange(n) * 64).ravel(), minlength=n * 64).reshape(n, 16, 4)
                self.tried[a:b] += pairs.sum(axis=2)
                self.right[:, a:b] += pairs[:, :, 2], pairs[:, :, 1]
            ends = np.zeros((n, self.n + 1), dtype=np.int64)
            upto = np.cumsum(self.prior * PRIOR + (self.counts[a:b] << 16), axis=1)
            ends[:, 1:] = upto * ((SLOTS - before[-1]) / upto[:, -1:])
            ends[:, -1] = SLOTS - before[-1]
            ends += before
            wide = np.diff(ends, axis=1)
            self.held.real[a:b], self.held.imag[a:b] = ends[:, :-1] << SLOT_BITS, wide << SLOT_BITS >> self.bits
            if len(self.slots):
                self.slots[a:b] = np.repeat(np.tile(np.arange(self.n, dtype=np.int16), n), wide.ravel()).reshape(n, SLOTS)
        # Order 1 counts where order 2 is wrong.
        tried, (right2, right1) = self.tried[:k], self.right[:, :k]
        prior = np.array(RIGHT) / 64
        share2 = (np.repeat(prior, UNSURE) * PRIOR_PAIR + right2) / (tried + PRIOR_PAIR)
        share1 = (1 - share2) * (np.tile(prior, UNSURE) * PRIOR_PAIR + right1) / (tried - right2 + PRIOR_PAIR)
        # Order 0 keeps a sixteenth or somewhat more.
        scale = (1 << FREQ_BITS) / np.maximum(1 - share2 - share1, 1 / 15)
        parts2 = np.floor(share2 * scale) + 16
        self.parts.real[:k], self.parts.imag[:k] = parts2 + np.floor(share1 * scale) + 16, parts2


def _contexts(ids: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Where the entries of order 2 and 1 are after these ids(earlier and last, ..., block)."""
    earlier, last = ids
    return (np.stack([last + earlier * _HASH, last]) & CONTEXTS - 1) + at


def _seen(known: np.ndarray, marked: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of the entries(order, step, block) and ids times four: the pair of how unsure, whether order 2 is right, and order 1."""
    hit2, hit1 = known ^ marked < UNSURE
    unsure2, unsure1 = known & UNSURE - 1
    return unsure2 * UNSURE + unsure1, hit2, hit1


def _stretches(lengths: np.ndarray) -> Iterator[tuple[int, int, int]]:
    """Stretches of at most STEPS steps (from, to) with the number of blocks, sorted from the longest, that have ids in all of them; cut where the model is updated."""
    longest = int(lengths[0]) if len(lengths) else 0
    ends = sorted({*map(int, lengths), *range(STEPS, longest, STEPS), longest} - {0})
    at = 0
    for end in ends:
        yield at, end, int(np.searchsorted(-lengths, -at, side="left"))
        at = end


def _updates(step: int) -> bool:
    return step == 0 or step in EARLY or (step > EARLY[-1] and (step - EARLY[-1]) % REFRESH == 0)


def encode(blocks: list[np.ndarray], vocabulary: int = VOCABULARY) -> list[bytes]:
    """Each block of ids (whole numbers below vocabulary) as bytes."""
    out: list[bytes] = [b""] * len(blocks)
    by_length = sorted(range(len(blocks)), key=lambda i: -len(blocks[i]))
    for a in range(0, len(blocks), LANES):
        which = by_length[a : a + LANES]
        for i, coded in zip(which, _encode([blocks[i] for i in which], vocabulary), strict=True):
            ids = np.ascontiguousarray(blocks[i], dtype="<u4")
            out[i] = MAGIC + struct.pack("<III", len(ids), vocabulary, zlib.crc32(ids)) + coded
    return out


def _encode(blocks: list[np.ndarray], vocabulary: int) -> list[bytes]:
    lanes, lengths = len(blocks), np.array([len(b) for b in blocks])
    longest = int(lengths.max(initial=0))
    rows = np.zeros((lanes, longest + 2), dtype=np.int32)
    for i, b in enumerate(blocks):
        rows[i, 2 : len(b) + 2] = b
    ids = np.ascontiguousarray(rows.T).astype(np.int64)
    model = _Model(lanes, vocabulary)
    low, width = np.zeros(lanes), np.full(lanes, _LEAST * _DIGIT)
    digits, leaves = np.zeros((longest, lanes), dtype=np.int32), np.zeros((longest, lanes), dtype=bool)
    seen, updated = np.zeros((longest, lanes), dtype=np.int8), 0
    one, four = np.ones((2, lanes), dtype=np.int32), np.full((2, lanes), UNSURE, dtype=np.int32)
    for begin, end, k in _stretches(lengths):
        if _updates(begin):
            model.update(k, ids[updated + 2 : begin + 2, :k], seen[updated:begin, :k])
            updated = begin
        n, now = end - begin, ids[begin + 2 : end + 2, :k]
        at = np.ascontiguousarray(_contexts(np.stack([ids[begin:end, :k], ids[begin + 1 : end + 1, :k]]), model.contexts_at[:, None, :k]).swapaxes(0, 1))
        marked = (now << 2).astype(np.int32)
        entry, known, one_, four_ = marked - 1, np.empty((n, 2, k), dtype=np.int32), one[:, :k], four[:, :k]
        for step in range(n):
            model.table.take(at[step], out=known[step], mode="clip")
            # One step surer where the entry was right (at most), else as unsure as can be.
            model.table[at[step]] = np.minimum(np.maximum(known[step] ^ marked[step], one_), four_) + entry[step]
        known = known.swapaxes(0, 1)
        pair, hit2, hit1 = _seen(known, marked)
        seen[begin:end, :k] = pair << 2 | np.where(hit2, 2, hit1)
        parts = model.parts.ravel().take(pair + model.pair_at[:k])
        upto = parts.real
        parts2 = np.where(known[0] ^ known[1] < UNSURE, upto, parts.imag)
        held = model.held.ravel().take(model.of.take(now) + model.class_at[:k])
        start = np.where(hit2, 0.0, np.where(hit1, parts2, upto + held.real + model.place.take(now) * held.imag))
        size = np.where(hit2, parts2, np.where(hit1, upto - parts2, held.imag))
        total = upto + (1 << FREQ_BITS)
        low_, width_ = low[:k], width[:k]
        least, scale, digit_, same = np.full(k, _LEAST), np.full(k, 1 / _LEAST), np.full(k, _DIGIT), np.ones(k)
        for step in range(n):
            part = np.floor(width_ / total[step])
            low_ = low_ + start[step] * part
            width_ = size[step] * part
            # A part is 16 or more before and so is the range after it: at most one digit leaves.
            full = width_ < least
            digit = np.floor(low_ * scale) * full
            digits[begin + step, :k], leaves[begin + step, :k] = digit, full
            moved = np.where(full, digit_, same)
            low_ = (low_ - digit * least) * moved
            width_ = width_ * moved
        low[:k], width[:k] = low_, width_
    rest = low.astype(np.int64)
    tail = np.stack([rest >> LEAST_BITS, rest >> LEAST_BITS - DIGIT_BITS & 0xFFFFFF, (rest & 0xF) << 20], axis=1)
    digits, leaves = np.ascontiguousarray(digits.T), np.ascontiguousarray(leaves.T)
    out = []
    for i in range(lanes):
        own = np.concatenate([digits[i][leaves[i]], tail[i]])
        while (carry := own >> DIGIT_BITS).any():
            own &= 0xFFFFFF
            own[:-1] += carry[1:]
        out.append(own.astype(">u4").view(np.uint8).reshape(-1, 4)[:, 1:].tobytes())
    return out


def decode(coded: list[bytes]) -> list[np.ndarray]:
    """The ids of each block; raises ValueError for a block that was damaged. Blocks may differ in their vocabulary."""
    heads = []
    for raw in coded:
        if raw[: len(MAGIC)] != MAGIC or len(raw) < len(MAGIC) + 12:
            raise ValueError("not a block of token ids")
        heads.append(struct.unpack_from("<III", raw, len(MAGIC)))
    out: list[np.ndarray] = [np.zeros(0, dtype=np.uint32)] * len(coded)
    for vocabulary in {v for _, v, _ in heads}:
        by_length = sorted((i for i in range(len(coded)) if heads[i][1] == vocabulary), key=lambda i: -heads[i][0])
        for a in range(0, len(by_length), LANES):
            which = by_length[a : a + LANES]
            body = [np.frombuffer(coded[i], dtype=np.uint8, offset=len(MAGIC) + 12) for i in which]
            for i, ids in zip(which, _decode(body, np.array([heads[i][0] for i in which]), vocabulary), strict=True):
                if zlib.crc32(ids.astype("<u4")) != heads[i][2]:
                    raise ValueError("a block of token ids is damaged")
                out[i] = ids
    return out


def _decode(body: list[np.ndarray], lengths: np.ndarray, vocabulary: int) -> list[np.ndarray]:
    lanes, longest = len(body), int(lengths.max(initial=0))
    room = max((len(b) // 3 for b in body), default=0) + 4
    digits = np.zeros((lanes, room), dtype=np.int64)
    for i, b in enumerate(body):
        parts = b[: len(b) // 3 * 3].reshape(-1, 3).astype(np.int64)
        digits[i, : len(parts)] = parts[:, 0] << 16 | parts[:, 1] << 8 | parts[:, 2]
    code = ((digits[:, 0] << 28) + (digits[:, 1] << 4) + (digits[:, 2] >> 20)).astype(float)
    # What comes in after so many digits that left; the range does not begin at the edge of a digit.
    flat = np.concatenate([(digits[:, 2:-1] & 0xFFFFF) << 4 | digits[:, 3:] >> 20, np.zeros((lanes, 1), dtype=np.int64)], axis=1)
    used, flat = np.arange(lanes) * flat.shape[1], flat.ravel().astype(float)
    model = _Model(lanes, vocabulary, slots=True)
    slots, held, parts, first = model.slots.ravel(), model.held.ravel(), model.parts.ravel(), model.first.astype(float)
    width = np.full(lanes, _LEAST * _DIGIT)
    ids, seen, updated = np.zeros((longest + 2, lanes), dtype=np.int64), np.zeros((longest, lanes), dtype=np.int8), 0
    for begin, end, k in _stretches(lengths):
        if _updates(begin):
            model.update(k, ids[updated + 2 : begin + 2, :k], seen[updated:begin, :k])
            updated = begin
        # Arrays for numbers: numpy takes them in half the time.
        zero, same, most, slot, all0, least, digit = (np.full(k, float(x)) for x in (0, 1, vocabulary - 1, 0.5**SLOT_BITS, 1 << FREQ_BITS, _LEAST, _DIGIT))
        one, three, four = (np.full((2, k), x, dtype=np.int32) for x in (1, 3, 4))
        mask, hash_, two = np.full((2, k), CONTEXTS - 1), np.full(k, _HASH), np.full(k, 2)
        contexts_at, pair_at, class_at, slot_at = model.contexts_at[:, :k], model.pair_at[:k], model.class_at[:k], model.slot_at[:k]
        at, knowns = np.empty((2, k), dtype=np.int64), np.empty((end - begin, 2, k), dtype=np.int32)
        code_, width_, used_ = code[:k], width[:k], used[:k]
        for step in range(begin, end):
            last = ids[step + 1, :k]
            at[1] = last
            np.add(ids[step, :k] * hash_, last, out=at[0])
            at &= mask
            at += contexts_at
            known = knowns[step - begin]
            model.table.take(at, out=known, mode="clip")
            known2, known1 = known
            unsure = known & three
            both = parts.take(unsure[0] * four[0] + unsure[1] + pair_at)
            upto = both.real
            parts2 = np.where((known2 ^ known1) < four[0], upto, both.imag)
            # No division rounds up to a whole number, as divisor times quotient is 2**52 at most.
            part = np.floor(width_ / (upto + all0))
            value = np.floor(code_ / part)
            sought = value - upto
            of = slots.take((np.maximum(sought, zero) * slot).astype(np.int64) + slot_at, mode="clip")
            has = held.take(of + class_at)
            size, start = has.imag, has.real
            place = np.floor((sought - start) / size)
            now = first.take(of) + place
            start = start + upto + place * size
            hit, hit2 = sought < zero, value < parts2
            now = np.where(hit, np.where(hit2, known2, known1) >> two, now)
            start = np.where(hit, np.where(hit2, zero, parts2), start)
            size = np.where(hit, np.where(hit2, parts2, upto - parts2), size)
            # Beyond the vocabulary leads damage only, which the checksum shows.
            found = ids[step + 2, :k]
            found[:] = np.minimum(now, most)
            code_ = code_ - start * part
            width_ = size * part
            full = width_ < least
            moved = np.where(full, digit, same)
            code_ = code_ * moved + flat.take(used_, mode="clip") * full
            used_ = used_ + full
            width_ = width_ * moved
            marked = (found << two).astype(np.int32)
            model.table[at] = np.minimum(np.maximum(known ^ marked, one), four) + (marked - one[0])
        code[:k], width[:k], used[:k] = code_, width_, used_
        pair, hit2, hit1 = _seen(knowns.swapaxes(0, 1), (ids[begin + 2 : end + 2, :k] << 2).astype(np.int32))
        seen[begin:end, :k] = pair << 2 | np.where(hit2, 2, hit1)
    rows = np.ascontiguousarray(ids.astype(np.uint32).T)
    return [rows[i, 2 : lengths[i] + 2] for i in range(lanes)]
