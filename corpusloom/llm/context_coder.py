"""Adaptive context-mixing range coder for token ids, over many blocks at once.

A frame holds ids cut into blocks of BLOCK ids, and a list of its distinct ids with their counts; ids are coded as their
numbers in that list. Blocks are coded on their own: each starts with an empty history, fresh tables and fresh mixing
weights, has its checksum and can be decoded without any other. In a block each id is coded by a mixture of three
predictions. Order 1 and 2 predict the id that last followed the same one or two ids; order 0 gives an id the share that
it has of the block's history, which is counted anew whenever the history has quadrupled. How much of the range the two
predicted ids get is learned while coding, from how often predictions of the same confidence have come true. An id that
the counted history lacks takes the order 0's escape and is then coded by its count in the frame. Blocks advance
together, up to LANES at a time, so that one NumPy call codes an id of each.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np

MAGIC = b"CMR3"
#: Ids in a block, ids in a frame as a rule, and blocks that advance together at most.
BLOCK, FRAME, LANES = 2048, 8 << 20, 5120
#: Slots of each order in a block's table; states of its mixing weights. The table's rows are chosen by the last symbol
#: and hold 16 slots of order 1, then as many of order 2: both predictions are near each other in memory.
SLOTS, STATES, _SET = 1 << 9, 32, 16
_PLACES, _SPREAD = 2 * SLOTS - 1 - _SET, np.int32(40503)
#: The mixture is 2 ** ALL_BITS wide, weights are parts of 2 ** WEIGHT_BITS.
ALL_BITS, WEIGHT_BITS = 28, 10
#: A block's history is counted anew at these lengths.
RECOUNTS = [64, 256, 1024]
_WORD, _ALL, _ONE = np.uint64(32), np.uint64(ALL_BITS), np.uint64(1)
_LOW = np.uint64(0xFFFFFFFF)
_WHOLE, _SHIFT = 1 << ALL_BITS, ALL_BITS - WEIGHT_BITS
#: An order-0 entry: where an id starts in the sorted history, and its count, of _PART bits each. Behind a number of an
#: id, both are one integer.
_PART = 11
#: Lanes whose histories are put in order at a time, so that what it takes stays in the cache.
_SLICE = 64
_COUNT, _ENTRY = (1 << _PART) - 1, (1 << 2 * _PART) - 1
#: Both weights are one integer, order 2's above order 1's. Each step takes a sixteenth and adds _STEP, and _RIGHT to
#: that whose prediction came true, which keeps their sum below 2 ** WEIGHT_BITS.
_FIRST, _STEP, _SIXTEENTHS, _RIGHT2, _RIGHT1 = np.array([256 << 16 | 128, 1 << 16 | 1, 0x0FFF0FFF, 59 << 16, 59], np.int32)


class _Model:
    """Predictions for one id of each lane (block); encoder and decoder run the same steps.

    Symbols are numbers of ids from 1; 0 is none. A slot of the tables is its predicted symbol and two bits of
    confidence, 0 in an empty slot. Arrays of two rows are of order 2 and order 1.
    """

    def __init__(self, lanes: int, symbols: int):
        self.tables = np.zeros(2 * lanes * SLOTS, np.uint16 if symbols < 1 << 14 else np.int32)
        self.prev, self.before = np.zeros(lanes, np.int32), np.full(lanes, _SET, np.int32)
        self.weights = np.full(lanes * STATES, _FIRST)
        self.slots, self.states = np.arange(lanes) * 2 * SLOTS, np.arange(lanes) * STATES
        self.counted, self.parts = 0, np.ones(lanes)

    def shrink(self, n: int) -> None:
        """Only the first n lanes go on."""
        for name in ("prev", "before", "slots", "states", "parts"):
            setattr(self, name, getattr(self, name)[:n])

    def weigh(self, t: int, distinct: np.ndarray) -> None:
        """Order 0 from now on tells of the first t symbols of each lane."""
        # an escape's weight is the number of distinct ids
        self.counted, self.parts = t, 1.0 / (t + np.maximum(distinct, 1))

    def predict(self) -> None:
        spread = self.prev * _SPREAD
        one = spread & _PLACES
        self.at = at = np.empty((2, len(one)), np.int64)
        np.add(self.slots, one ^ self.before, out=at[0])
        np.add(self.slots, one, out=at[1])
        self.before = spread >> 8 & _SET - 1 | _SET
        self.e = e = self.tables[at].astype(np.int32, copy=False)
        self.p, sure = e >> 2, e & 3
        apart = self.p[0] != self.p[1]
        self.state = (sure[0] << 3 | sure[1] << 1 | apart) + self.states
        self.w = w = self.weights.take(self.state, mode="clip")
        self.m2 = w >> 16 << _SHIFT
        self.rest = self.m2 + ((w & 0xFFFF) * apart << _SHIFT)
        self.unit = ((_WHOLE - self.rest) * self.parts).astype(np.int32)

    def update(self, s: np.ndarray) -> None:
        """s are the symbols that came."""
        hit, w = self.hit, self.w
        self.weights[self.state] = w - (w >> 4 & _SIXTEENTHS) + _STEP + np.where(hit[0], _RIGHT2, hit[1] * _RIGHT1)
        # a true prediction gains confidence; a false one loses it and, without any left, its slot
        e = self.e
        slot = np.where(e & 2, e - 1, s << 2 | 1)
        np.copyto(slot, np.minimum(e + 1, e | 3), where=hit)
        self.tables[self.at] = slot.astype(self.tables.dtype, copy=False)
        self.prev = s


def _shapes(n: int) -> np.ndarray:
    return np.minimum(BLOCK, n - np.arange(0, n, BLOCK))


def _groups(sizes: np.ndarray) -> Iterator[tuple[int, int]]:
    """Blocks that advance together: as few groups as LANES allows, of the same size."""
    stops = np.linspace(0, len(sizes), -(-len(sizes) // LANES) + 1).astype(int).tolist()
    yield from zip(stops[:-1], stops[1:], strict=True)


def encode_frame(ids: np.ndarray) -> bytes:
    """ids (below 2 ** 32) as bytes: magic, numbers of ids and blocks, distinct ids with counts, size and checksum of each
    block, blocks."""
    sizes, top = _shapes(len(ids)), int(ids.max(initial=0))
    if top >= 1 << 32 or ids.min(initial=0) < 0:
        raise ValueError("ids are unsigned 32-bit integers")
    if top < max(1 << 20, len(ids)):
        counts = np.bincount(ids)
        distinct = np.flatnonzero(counts)
        numbers = np.zeros(top + 1, np.int32)
        numbers[distinct] = np.arange(1, len(distinct) + 1)
        counts, s = counts[distinct], numbers[ids]
    else:
        distinct, s, counts = np.unique(ids, return_inverse=True, return_counts=True)
        s = s.astype(np.int32) + np.int32(1)
    named = zlib.compress(np.concatenate([np.diff(distinct, prepend=0), counts]).astype("<u4").tobytes())
    ends = np.concatenate([[0, 0], np.cumsum(counts)]).astype(np.uint64)
    crcs = [zlib.crc32(ids[a : a + BLOCK].astype("<u4").tobytes()) for a in range(0, len(ids), BLOCK)]
    blocks = [b for x, y in _groups(sizes) for b in _encode(s[x * BLOCK : y * BLOCK], sizes[x:y], ends)]
    head = MAGIC + struct.pack("<QIII", len(ids), len(sizes), len(distinct), len(named))
    index = np.array([(len(b), c) for b, c in zip(blocks, crcs, strict=True)], "<u4").tobytes()
    return b"".join([head, named, index, *blocks])


class _Writer:
    """The range of each lane and the words written, in twice the room: what is carried into them stays above their bits
    until the end."""

    def __init__(self, lanes: int):
        # an id takes at most two words, one for its interval and one for its count in the frame; words are by place, then
        # lane, as the lanes are at about the same place
        self.lanes = lanes
        self.out, self.pos = np.zeros((2 * BLOCK + 8) * lanes, np.uint64), np.arange(lanes)
        self.low, self.span = np.zeros(lanes, np.uint64), np.full(lanes, 2**64 - 1, np.uint64)

    def narrow(self, n: int, start: np.ndarray, size: np.ndarray) -> None:
        """The first n lanes go on in the part of their ranges that start and size tell."""
        low, span = self.low[:n], self.span[:n]
        r = span >> _ALL
        new = low + r * start
        self._carry((new < low).nonzero()[0])
        low[:] = new
        np.multiply(r, size, out=span)
        self._shift((span <= _LOW).nonzero()[0])

    def narrow_some(self, lanes: np.ndarray, start: np.ndarray, size: np.ndarray, among: np.uint64) -> None:
        """Lanes go on in `size` of `among` equal parts of their ranges."""
        low, r = self.low[lanes], self.span[lanes] // among
        new = low + r * start
        self._carry(lanes[new < low])
        r *= size
        self.low[lanes], self.span[lanes] = new, r
        self._shift(lanes[r <= _LOW])

    def _carry(self, lanes: np.ndarray) -> None:
        if len(lanes):
            self.out[self.pos[lanes] - self.lanes] += _ONE

    def _shift(self, lanes: np.ndarray) -> None:
        if len(lanes):
            part, at = self.low[lanes], self.pos[lanes]
            self.out[at] = part >> _WORD
            self.pos[lanes] = at + self.lanes
            self.low[lanes] = part << _WORD
            self.span[lanes] <<= _WORD

    def bytes(self) -> list[bytes]:
        self.out[self.pos], self.out[self.pos + self.lanes] = self.low >> _WORD, self.low & _LOW
        sizes, blocks = self.pos // self.lanes + 2, []
        rows = self.out.reshape(-1, self.lanes)[: sizes.max()]
        for k in range(len(rows) - 1, 0, -1):
            rows[k - 1] += rows[k] >> _WORD
        for a in range(0, self.lanes, _SLICE):
            part = _turned(rows[:, a : a + _SLICE].astype("<u4"))
            blocks += [p[:k].tobytes() for p, k in zip(part, sizes[a : a + _SLICE].tolist(), strict=True)]
        return blocks


def _turned(rows: np.ndarray) -> np.ndarray:
    """The transpose, from a copy whose rows do not start at equal places of the cache."""
    out = np.empty((len(rows), rows.shape[1] + 16), rows.dtype)[:, : rows.shape[1]]
    out[:] = rows
    return out.T


def _known(s: np.ndarray, distinct: int) -> tuple[np.ndarray, dict[int, np.ndarray]]:
    """For the encoder, which knows its blocks (rows of s): the order-0 entry of each place, as counted before it, and the
    numbers of distinct symbols of each counted history. A symbol that the history lacks starts behind it."""
    kind = np.int32 if distinct < 1 << 30 - _PART else np.int64
    both = s.astype(kind) << _PART | np.arange(BLOCK, dtype=kind)
    both.sort(axis=1)
    place = (both & _COUNT).astype(np.int16)
    both >>= _PART
    new = np.ones(both.shape, bool)
    new[:, 1:] = both[:, 1:] != both[:, :-1]
    starts = np.flatnonzero(new)
    lengths, lane = np.diff(starts, append=new.size), starts // BLOCK
    sorted_told, found = np.zeros(s.shape, np.int32), {}
    for a, b in zip(RECOUNTS, [*RECOUNTS[1:], BLOCK], strict=True):
        # of each run of equal symbols, how many places of its lane lie before the run, and how many in it
        before = place < a
        through = np.cumsum(before, axis=1, dtype=np.int16).ravel()
        left = through[starts] - before.ravel()[starts]
        n = through[starts + lengths - 1] - left
        found[a] = np.bincount(lane[n > 0], minlength=len(s))
        entry = np.where(n > 0, left.astype(np.int32) << _PART | n, np.int32(a << _PART))
        np.copyto(sorted_told, np.repeat(entry, lengths).reshape(s.shape), where=place >= a)
    told = np.empty(s.shape, np.int32)
    np.put_along_axis(told, place.astype(np.int64), sorted_told, axis=1)
    return told, found


def _encode(s: np.ndarray, sizes: np.ndarray, ends: np.ndarray) -> list[bytes]:
    """The blocks of s; ends are where the symbols' counts in the frame end."""
    lanes = n = len(sizes)
    # the last block is filled up with a symbol of its own
    rows = np.full(lanes * BLOCK, len(ends) - 1, np.int32)
    rows[: len(s)] = s
    rows = rows.reshape(lanes, BLOCK)
    # by place, then lane
    symbols, told = np.empty((2, BLOCK, lanes), np.int32)
    found = {t: np.empty(lanes) for t in RECOUNTS}
    for a in range(0, lanes, _SLICE):
        part = slice(a, a + _SLICE)
        symbols[:, part] = _turned(rows[part])
        entries, distinct = _known(rows[part], len(ends))
        told[:, part] = _turned(entries)
        for t in RECOUNTS:
            found[t][part] = distinct[t]
    model, writer = _Model(lanes, len(ends)), _Writer(lanes)
    for t in range(int(sizes[0])):
        if t == sizes[-1] and n == lanes:
            n -= 1
            model.shrink(n)
        if t in found:
            model.weigh(t, found[t][:n])
        now, entry = symbols[t, :n], told[t, :n]
        model.predict()
        count = entry & _COUNT
        start = model.unit * (entry >> _PART) + model.rest
        size = model.unit * count
        lacks = count == 0
        size += (_WHOLE - start) * lacks
        model.hit = model.p == now
        hit2, hit1 = model.hit
        np.copyto(start, model.m2, where=hit1)
        np.copyto(size, model.rest - model.m2, where=hit1)
        np.copyto(start, 0, where=hit2)
        np.copyto(size, model.m2, where=hit2)
        writer.narrow(n, start.astype(np.uint64), size.astype(np.uint64))
        escape = (lacks & ~(hit2 | hit1)).nonzero()[0]
        if len(escape):
            which = now[escape]
            first = ends[which]
            writer.narrow_some(escape, first, ends[which + 1] - first, ends[-1])
        model.update(now)
    return writer.bytes()


def frame_blocks(data: bytes) -> tuple[int, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of a frame the number of ids, the distinct ids and their counts, and of each block where its bytes start, their size
    and checksum."""
    if data[:4] != MAGIC:
        raise ValueError("not a frame of coded ids")
    n, blocks, distinct, size = struct.unpack_from("<QIII", data, 4)
    named = np.frombuffer(zlib.decompress(data[24 : 24 + size]), "<u4").astype(np.int64)
    index = np.frombuffer(data, "<u4", 2 * blocks, 24 + size).reshape(-1, 2).astype(np.int64)
    starts = 24 + size + 8 * blocks + np.cumsum(index[:, 0]) - index[:, 0]
    return n, np.cumsum(named[:distinct]), named[distinct:], starts, index


def decode_frame(data: bytes, blocks: slice = slice(None)) -> np.ndarray:
    """The ids of a frame, or of some blocks of it, as unsigned 32-bit integers; an error names the first block with a
    wrong checksum."""
    n, distinct, counts, starts, index = frame_blocks(data)
    which = np.arange(len(starts))[blocks]
    sizes, out = _shapes(n)[which], []
    names, ends = np.append(0, distinct).astype("<u4"), np.concatenate([[0, 0], np.cumsum(counts)]).astype(np.uint64)
    for a, b in _groups(sizes):
        parts = [np.frombuffer(data, "<u4", index[i, 0] // 4, starts[i]) for i in which[a:b]]
        out.append(names[_decode(parts, sizes[a:b], ends)])
    ids = np.concatenate([np.zeros(0, "<u4"), *out])
    at = 0
    for i, size in zip(which.tolist(), sizes.tolist(), strict=True):
        if zlib.crc32(ids[at : at + size]) != index[i, 1]:
            raise ValueError(f"block {i} has a wrong checksum")
        at += size
    return ids


def _counted(past: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each lane (column of past) its symbols in order, each with its order-0 entry, all lanes in a row; and the lanes'
    numbers of distinct symbols."""
    t, lanes = past.shape
    told, distinct = np.empty(lanes * t, np.int64), np.empty(lanes)
    for a in range(0, lanes, _SLICE):
        s = _turned(past[:, a : a + _SLICE]).copy()
        s.sort(axis=1)
        new = np.ones(s.shape, bool)
        new[:, 1:] = s[:, 1:] != s[:, :-1]
        starts = np.flatnonzero(new)
        n = np.diff(starts, append=new.size)
        told[a * t : a * t + s.size] = np.repeat(s.ravel()[starts].astype(np.int64) << 2 * _PART | starts % t << _PART | n, n)
        distinct[a : a + _SLICE] = new.sum(1)
    return told, distinct


def _decode(parts: list[np.ndarray], sizes: np.ndarray, ends: np.ndarray) -> np.ndarray:
    lanes = n = len(sizes)
    # words are by place, then lane; two more for each lane, which a damaged one may read again
    words = np.zeros((max(map(len, parts)) + 2, lanes), np.uint32)
    for a in range(0, lanes, _SLICE):
        rows = np.zeros((len(parts[a : a + _SLICE]), len(words)), np.uint32)
        for row, p in zip(rows, parts[a : a + _SLICE], strict=True):
            row[: len(p)] = p
        words[:, a : a + _SLICE] = _turned(rows)
    code, span = words[0].astype(np.uint64) << _WORD | words[1], np.full(lanes, 2**64 - 1, np.uint64)
    words, last, pos = words.reshape(-1), words.size - lanes, np.arange(lanes) + 2 * lanes
    model, past, lane = _Model(lanes, len(ends)), np.zeros((BLOCK, lanes), np.int32), np.arange(lanes)
    most, among, order = np.uint64(_WHOLE - 1), ends[-1], np.zeros(1, np.int64)

    def refill(at: np.ndarray | None, c: np.ndarray, p: np.ndarray) -> None:
        small = (p <= _LOW).nonzero()[0]
        if len(small):
            which = small if at is None else at[small]
            place = pos[which]
            c[small] = c[small] << _WORD | words[place].astype(np.uint64)
            p[small] <<= _WORD
            pos[which] = np.minimum(place + lanes, last + which)

    for t in range(int(sizes[0])):
        if t == sizes[-1] and n == lanes:
            n -= 1
            model.shrink(n)
            code, span, lane = code[:n], span[:n], lane[:n]
        if t in RECOUNTS:
            order, distinct = _counted(past[:t, :n])
            model.weigh(t, distinct)
        model.predict()
        r = span >> _ALL
        v = np.minimum(code // r, most).view(np.int64)
        rest, counted = v - model.rest, model.counted
        if counted:
            # the quotient of numbers below 2 ** 31 is right but where it should be whole, for which half is added
            k = ((rest + 0.5) / model.unit).astype(np.int64)
            told = order.take(lane * counted + k, mode="clip")
            lacks = k >= counted
            told = np.where(lacks, counted << _PART, told)
            now = (told >> 2 * _PART).astype(np.int32)
            start = model.unit * (told >> _PART & _COUNT) + model.rest
            size = model.unit * (told & _COUNT) + (_WHOLE - start) * lacks
        else:
            now, lacks, start = np.zeros(n, np.int32), rest >= 0, model.rest.astype(np.int64)
            size = _WHOLE - start
        hit2, hit = v < model.m2, rest < 0
        np.copyto(start, model.m2, where=hit)
        np.copyto(size, model.rest - model.m2, where=hit)
        np.copyto(now, model.p[1], where=hit)
        np.copyto(start, 0, where=hit2)
        np.copyto(size, model.m2, where=hit2)
        np.copyto(now, model.p[0], where=hit2)
        escape = lacks.nonzero()[0]
        code -= r * start.view(np.uint64)
        np.multiply(r, size.view(np.uint64), out=span)
        refill(None, code, span)
        if len(escape):
            c, p = code[escape], span[escape] // among
            which = np.searchsorted(ends, np.minimum(c // p, among - np.uint64(1)), "right") - 1
            first = ends[which]
            c -= p * first
            p *= ends[which + 1] - first
            refill(escape, c, p)
            now[escape], code[escape], span[escape] = which, c, p
        model.hit = model.p == now
        model.update(now)
        past[t, :n] = now
    out = np.empty((lanes, int(sizes[0])), np.int32)
    for a in range(0, lanes, _SLICE):
        out[a : a + _SLICE] = _turned(past[: sizes[0], a : a + _SLICE])
    return out.reshape(-1)[: sizes.sum()]
