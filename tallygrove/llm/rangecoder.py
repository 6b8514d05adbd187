"""An adaptive context-mixing range coder for token ids, run in lockstep over many independent blocks with numpy.

Within a block each context of the two last ids (order 2) and of the last id (order 1) holds the id that followed it last and
a standing, which grows while it comes true. The two are mixed into one prediction: the id is that of the highest order that
has one, its probability is learnt for each state of both standings and of their agreement, and decides the share of the
range. What is left goes to order 0, the frequencies of all ids of the frame, which stand in its head. One arithmetic coding
step codes an id. Every block begins with empty orders 1 and 2 and the same probabilities, and has a CRC-32 of its ids.

A frame holds up to LANES blocks:
    magic "TGR2", number of ids (8 bytes), number of blocks (4), bytes of the frequency table (4) and their CRC-32 (4); the
    table, compressed: number of distinct ids (4), their differences (4 each), their frequencies of TOTAL (4 each); for each
    block: ids (4 bytes), 32-bit code words (4), CRC-32 of the ids as little-endian 32-bit integers (4); then all code words.
    All numbers are little-endian.
"""

from __future__ import annotations

import zlib

import numpy as np

MAGIC = b"TGR2"
BLOCK, LANES = 2048, 4096
#: Ids are held in 16 bits.
MOST_ID = (1 << 16) - 1
TOTAL_BITS = 18
TOTAL = 1 << TOTAL_BITS
ORDER1, ORDER2 = 1024, 2048
#: States of two standings of 0 (an empty context) to 3 and of their agreement; probabilities of 2**24.
STATES, STRONG, WEAK, RATE = 32, 61_000 << 8, 200 << 8, 4
STEPS = 128
_U = np.uint64
_32, _24 = _U(32), _U(24)
_WORD = _U(1 << 32)
_HEAD = [("ids", "<u4"), ("words", "<u4"), ("crc", "<u4")]


def _take(values: np.ndarray, at: np.ndarray) -> np.ndarray:
    return values.take(at, mode="clip")  # without the checks that cost as much as the reading


def frequencies(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct ids, and integers in proportion to their counts, 1 at least, that sum to TOTAL."""
    counts = np.bincount(ids, minlength=1)
    names = np.flatnonzero(counts)
    counts = counts[names]
    out = np.maximum(1, counts * TOTAL // max(1, counts.sum()))
    # What is missing goes to the most frequent one; what is too much is taken from those that have more than their least.
    over = int(out.sum()) - TOTAL
    while over > 0:
        cut = np.minimum(out - 1, -(-out * over // out.sum()))
        cut = np.minimum(cut, np.maximum(0, over - (np.cumsum(cut) - cut)))
        out -= cut
        over -= int(cut.sum())
    if len(out):
        out[out.argmax()] -= over
    return names, out


class _Model:
    """Orders 1 and 2 of every lane. An entry holds an id and, in its two lowest bits, its standing."""

    def __init__(self, lanes: int) -> None:
        lane = np.arange(lanes)
        self.base1, self.base2, self.row = lane * ORDER1, lane * ORDER2, lane * STATES
        self.held1, self.held2 = np.zeros(lanes * ORDER1, np.int32), np.zeros(lanes * ORDER2, np.int32)
        self.trust = np.full(lanes * STATES, 1 << 22, np.int32)

    def slots(self, last: np.ndarray, older: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where the contexts of orders 1 and 2 are kept."""
        mixed = last * 40503
        return (mixed >> 5 & (ORDER1 - 1)) + self.base1, (mixed + older * 60493 >> 5 & (ORDER2 - 1)) + self.base2

    def predict(self, slot1: np.ndarray, slot2: np.ndarray) -> None:
        """Sets the predicted ids, their shares of 2**24, and what is left."""
        self.slot1, self.slot2 = slot1, slot2
        self.one, self.two = one, two = _take(self.held1, slot1), _take(self.held2, slot2)
        self.said = np.where(two > 0, two, one) >> 2
        self.now1, self.now2 = one & 3, two & 3
        state = (((one ^ two) < 4).view(np.int8) << 4) + (self.now2 << 2) + self.now1
        self.at = self.row + state
        self.share = _take(self.trust, self.at)
        self.rest = (1 << 24) - self.share.astype(np.int64)

    def learn(self, entries: np.ndarray, hit: np.ndarray) -> None:
        """entries: the ids, shifted by two bits, with a standing of 1."""
        self.trust[self.at] = self.share + ((hit * np.int32(STRONG - WEAK) + (np.int32(WEAK) - self.share)) >> RATE)
        # An entry for the same id differs in its lowest bits alone.
        self.held1[self.slot1] = entries + ((entries ^ self.one) < 4) * np.minimum(self.now1, 2)
        self.held2[self.slot2] = entries + ((entries ^ self.two) < 4) * np.minimum(self.now2, 2)

    def span(self, hit: np.ndarray, below: np.ndarray, above: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Begin and size of the ids' shares; below and above bound their frequencies."""
        low = self.rest * below >> TOTAL_BITS
        wide = (self.rest * above >> TOTAL_BITS) - low
        missed = hit.astype(np.int64) - 1  # a mask: choosing by bits costs a third of choosing by condition
        return ((self.share + low) & missed).view(_U), (self.share ^ ((self.share ^ wide) & missed)).view(_U)


def _settled(low: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The lanes whose next code word is due, their lows and sizes; a range across a word's boundary is cut there."""
    ready = np.flatnonzero(size < _WORD)
    some, wide = low[ready], size[ready]
    across = (some ^ (some + wide)) >= _WORD
    if across.any():
        wide[across] = (_U(0) - some[across]) & (_WORD - _U(1))
    return ready, some, wide << _32


def _lengths(n: int) -> np.ndarray:
    """Blocks of BLOCK ids, the last one of the rest."""
    return np.array([BLOCK] * (n // BLOCK) + [n % BLOCK] * (n % BLOCK > 0), np.int64)


def encode(ids: np.ndarray) -> bytes:
    """A frame of at most LANES * BLOCK ids, each at most MOST_ID."""
    ids = np.ascontiguousarray(ids)
    if len(ids) > LANES * BLOCK or (len(ids) and not 0 <= ids.min() <= ids.max() <= MOST_ID):
        raise ValueError("too many ids for a frame, or an id out of range")
    lengths = _lengths(len(ids))
    lanes = len(lengths)
    names, share = frequencies(ids)
    bounds = np.zeros(MOST_ID + 2, np.int64)
    bounds[names + 1] = share
    np.cumsum(bounds, out=bounds)
    table = np.zeros((lanes, BLOCK), np.uint16)
    table.ravel()[: len(ids)] = ids
    columns = np.ascontiguousarray(table.T)
    del table
    model = _Model(lanes)
    low, size = np.zeros(lanes, _U), np.full(lanes, _U(2**64 - 1))
    width = BLOCK + 2
    out = np.zeros(lanes * width, np.uint32)
    begin_at = np.arange(lanes) * width
    at = begin_at.copy()
    older, last = np.zeros((1, lanes), np.uint16), np.zeros((1, lanes), np.uint16)
    for step in range(int(lengths[0]) if lanes else 0):
        here = step % STEPS
        if not here:  # what doesn't depend on the model, for many steps at once
            some = columns[step : step + STEPS]
            known = np.concatenate([older, last, some]).astype(np.int64)
            older, last = some[-2:-1], some[-1:]
            slots1, slots2 = model.slots(known[1:-1], known[:-2])
            below, above = _take(bounds, known[2:]), _take(bounds, known[2:] + 1)
            entries = (known[2:] << 2).astype(np.int32) + np.int32(1)
        if step == lengths[-1]:  # the last block is over; its lane goes on with zeros that nobody reads
            tail = (out[begin_at[-1] : at[-1]].copy(), low[-1])
        now = entries[here]
        model.predict(slots1[here], slots2[here])
        hit = now >> 2 == model.said
        begin, wide = model.span(hit, below[here], above[here])
        unit = size >> _24
        low += unit * begin
        size = unit * np.maximum(wide, _U(1)) if step >= lengths[-1] else unit * wide
        ready, some_low, some_size = _settled(low, size)
        out[at[ready]] = some_low >> _32
        at[ready] += 1
        low[ready] = some_low << _32
        size[ready] = some_size
        model.learn(now, hit)
    used = at - begin_at
    parts = [out[b : b + n] for b, n in zip(begin_at, used)]
    if lanes and lengths[-1] < lengths[0]:
        parts[-1], low[-1] = tail
    # A last word that lies in the range, whatever follows it.
    ends = ((low + (_WORD - _U(1))) >> _32).astype(np.uint32)
    parts = [np.append(p, e).astype("<u4") for p, e in zip(parts, ends)]
    packed = zlib.compress(np.concatenate([[len(names)], np.diff(names, prepend=0), share]).astype("<u4").tobytes(), 6)
    wide = ids.astype("<u4")
    head = np.zeros(lanes, _HEAD)
    head["ids"], head["words"] = lengths, [len(p) for p in parts]
    head["crc"] = [zlib.crc32(wide[i * BLOCK : i * BLOCK + n].tobytes()) for i, n in enumerate(lengths)]
    numbers = [len(ids).to_bytes(8, "little"), *(x.to_bytes(4, "little") for x in (lanes, len(packed), zlib.crc32(packed)))]
    return b"".join([MAGIC, *numbers, packed, head.tobytes(), *(p.tobytes() for p in parts)])


def decode(frame: bytes) -> np.ndarray:
    """The ids of a frame, checked block by block."""
    if frame[:4] != MAGIC:
        raise ValueError("not a frame of token ids")
    total = int.from_bytes(frame[4:12], "little")
    lanes, size_of_table, crc_of_table = (int.from_bytes(frame[i : i + 4], "little") for i in (12, 16, 20))
    packed = frame[24 : 24 + size_of_table]
    if zlib.crc32(packed) != crc_of_table:
        raise ValueError("the frequencies of a frame are damaged")
    numbers = np.frombuffer(zlib.decompress(packed), "<u4").astype(np.int64)
    names, share = np.cumsum(numbers[1 : 1 + numbers[0]]), numbers[1 + numbers[0] :]
    symbol = np.repeat(names, share)  # of each of TOTAL parts
    bounds = np.zeros(MOST_ID + 2, np.int64)
    bounds[names + 1] = share
    np.cumsum(bounds, out=bounds)
    head = np.frombuffer(frame, _HEAD, lanes, 24 + size_of_table)
    lengths, words = head["ids"].astype(np.int64), head["words"].astype(np.int64)
    if lengths.sum() != total or 24 + size_of_table + head.nbytes + 4 * words.sum() != len(frame):
        raise ValueError("a frame is cut short")
    code = np.frombuffer(frame, "<u4", int(words.sum()), 24 + size_of_table + head.nbytes).astype(_U)
    code = np.r_[code, np.zeros(1, _U)]
    start = np.cumsum(words) - words
    end = start + words

    def following(at, end):
        return np.where(at < end, _take(code, at), _U(0))  # zeros behind the last word

    value = following(start, end) << _32 | following(start + 1, end)
    at = start + 2
    model = _Model(lanes)
    low, size = np.zeros(lanes, _U), np.full(lanes, _U(2**64 - 1))
    out = np.zeros((BLOCK, lanes), np.uint16)
    older = last = np.zeros(lanes, np.int64)
    for step in range(int(lengths.max()) if lanes else 0):
        model.predict(*model.slots(last, older))
        unit = size >> _24
        target = np.minimum((value - low) // unit, _U((1 << 24) - 1)).view(np.int64)
        hit = target < model.share
        left = target - model.share + 1
        # The last part that begins at or before the target: bounds up to this quotient do (if it isn't a hit). Numbers below 2**53
        # divide exactly.
        part = (((left << TOTAL_BITS) - 1) / model.rest).astype(np.int64)
        now = np.where(hit, model.said, _take(symbol, part))
        out[step] = now
        begin, wide = model.span(hit, _take(bounds, now), _take(bounds, now + 1))
        low += unit * begin
        size = unit * np.maximum(wide, _U(1)) if step >= lengths[-1] else unit * wide
        ready, some_low, some_size = _settled(low, size)
        value[ready] = value[ready] << _32 | following(at[ready], end[ready])
        at[ready] += 1
        low[ready] = some_low << _32
        size[ready] = some_size
        model.learn((now << 2).astype(np.int32) + np.int32(1), hit)
        older, last = last, now
    ids = np.ascontiguousarray(out.T).ravel()[:total]
    wide = ids.astype("<u4")
    for i, (n, crc) in enumerate(zip(lengths, head["crc"])):
        if zlib.crc32(wide[i * BLOCK : i * BLOCK + n].tobytes()) != crc:
            raise ValueError(f"block {i} is damaged")
    return ids
