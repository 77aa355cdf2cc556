"""Context-mixing range coder for id sequences, many blocks side by side.

Each block is coded alone from a fresh model; blocks stand in the lanes of
numpy arrays, so one step codes one id of every block.  Three models give one
distribution, and an id is one interval of it: the id that followed the last
two ids (order 2) and the last id (order 1) before, by adaptive tables, and
the block's own counts of ids (order 0), which its header holds.  How far the
first two are trusted is mixed in the logistic domain, for each pair of
confidences, with weights that learn; chances and weights are renewed after
16, 64, 256 and 1024 ids.  A range coder of 48 bits takes the intervals.  Whatever
decides an interval is arithmetic on integers (divisions in double precision
are of such sizes that their floors are exact), so every machine decodes alike.
"""

from __future__ import annotations

import zlib

import numpy as np

#: Ids in a block at most, and blocks coded side by side.
BLOCK, LANES = 4096, 2048
#: Cells a lane has for the last two ids and for the last one.
_CELLS = (512, 256)
_BITS = 12
_ONE = 1 << _BITS
#: Size of a whole distribution. An interval has 4 at least, so that one unit of 16 bits a step fills the range again.
_TOTAL, _LEAST = 1 << 18, 4
_UNIT = 1 << 32
#: What stays of the lower end of a range if nothing is moved out, and if a unit is.
_KEPT = np.array([-1, _UNIT - 1])
_TAKEN = np.array([0, 0xFFFF], np.uint16)
#: Steps after which what they moved out is taken together.
_STRIPE = 128
_PAIRS = 32  # order 2 and order 1 name one id or not, 4 degrees of trust each
#: Steps after which chances and weights are renewed.
_RENEWALS = {16, 64, 256, 1024}

_x = np.arange(_ONE) + 0.5
_STRETCH = np.round(np.log(_x / (_ONE - _x)) * 256).astype(np.int64)
_SQUASH = np.clip(np.round(_ONE / (1 + np.exp(-np.arange(-2047, 2048) / 256))), 1, _ONE - 1).astype(np.int64)
#: What is expected of a degree of trust before any count.
_EXPECTED = np.array([40, 400, 1000, 3000])
#: Bits of a cell that hold its trust, of order 2 and of order 1; above them is the id.
_TRUST = np.array([[12], [3]], np.uint16)
#: Change of a cell by its trust, missed or hit, for both orders; a missed cell of little trust takes the new id.
_CHANGE = np.zeros(32, np.uint16)
for _k, _change in enumerate((0, 0, -1, -2, 1, 1, 1, 0)):
    _CHANGE[_k // 4 * 16 + _k % 4], _CHANGE[_k // 4 * 16 + _k % 4 * 4] = _change % (1 << 16), _change * 4 % (1 << 16)
_FRESH = np.array([[4], [1]], np.uint16)
_REPLACED = np.isin(np.arange(32), (0, 1, 4))
#: Steps counted for the renewals: the first ones, then every fourth.
_COUNTED, _EVERY = 64, 3
#: What a step adds to its pair's count: 1, and at bits 20 and 40 a hit of order 2 and of order 1 alone.
_SEEN = np.array([1, 1 + (1 << 20), 1 + (1 << 40), 1 + (1 << 20)])


class Model:
    """State of the lanes of blocks of ``sizes`` ids; an id is its place among the ids of its block."""

    def __init__(self, sizes: np.ndarray):
        n = len(sizes)
        self.sizes = sizes
        self.cells = np.zeros(n * sum(_CELLS), np.uint16)
        self.base = np.stack((np.arange(n) * _CELLS[0], np.arange(n) * _CELLS[1] + n * _CELLS[0]))
        self.lanes, self.all = np.arange(n), n  # tables of pairs hold the lanes of a pair side by side
        self.last, self.mark = np.zeros(n, np.int64), np.zeros(n, np.int64)
        self.slots = np.zeros((2, n), np.int64)
        self.seen = np.zeros(n * _PAIRS, np.int64)
        self.counts = np.zeros((3, 2, 4, 4, n), np.int64)
        self.weight = np.full((2, 2, n), 1 << 15, np.int64)
        self.mixed: list | None = None
        self.renew()
        self.narrow(n)

    def narrow(self, m: int) -> None:
        """Goes on with the first ``m`` lanes."""
        self.slots, self.base, self.lanes = self.slots[:, :m], self.base[:, :m], self.lanes[:m]
        self.last, self.mark = self.last[:m], self.mark[:m]

    def renew(self) -> None:
        """Weights learn from what was seen since the last time, chances from all that was seen, and the intervals follow."""
        seen = self.seen.reshape(2, 4, 4, -1)
        new = np.stack((seen & 0xFFFFF, (seen >> 20) & 0xFFFFF, seen >> 40))
        trials, hits = (new[0], new[0] - new[1]), (new[1], new[2])
        if self.mixed is not None:
            for d, (inputs, p) in enumerate(self.mixed):
                err = hits[d] * (_ONE - 1) - trials[d] * p
                total = trials[d].sum((0, 1, 2)) + 1
                for i in (0, 1):
                    step = (inputs[i] * err).sum((0, 1, 2)) // total
                    self.weight[d, i] = np.clip(self.weight[d, i] + (step >> 3), -(1 << 17), 1 << 17)
        self.counts = (self.counts >> 1) + new
        self.seen[:] = 0
        tried = (self.counts[0], self.counts[0] - self.counts[1])
        self.mixed, chance = [], []
        for d in (0, 1):
            inputs = []
            for axes, expected in (((0, 2), _EXPECTED[:, None, None]), ((1,), _EXPECTED[:, None])):
                p = (self.counts[d + 1].sum(axes, keepdims=True) * _ONE + 2 * expected) // (tried[d].sum(axes, keepdims=True) + 2)
                inputs.append(_STRETCH.take(np.clip(p, 16, _ONE - 17)))
            dot = (self.weight[d, 0] * inputs[0] + self.weight[d, 1] * inputs[1]) >> 16
            chance.append(_SQUASH.take(np.clip(dot, -2047, 2047) + 2047))
            self.mixed.append((inputs, chance[d]))
        first = chance[0]
        second = ((_ONE - first) * chance[1]) >> _BITS
        second[1] = 0  # both name one id
        unit = _TOTAL // self.sizes
        share = np.clip((unit * (_ONE - first - second)) >> _BITS, np.maximum(unit >> 4, _LEAST), unit - (unit >> 4))
        rest = _TOTAL - share * self.sizes
        size = np.clip(rest * first // np.maximum(first + second, 1), _LEAST, rest - _LEAST)
        self.named = ((size << 20) | (rest - size)).reshape(-1)
        self.other = ((rest << 20) | share).reshape(-1)

    def predict(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The two predicted ids, the sizes of their intervals (the first one's from bit 20), and where those of order 0 begin (from bit 20) with the size of one count."""
        slots = self.slots
        np.multiply(self.last, 37, out=slots[0])
        slots[0] += self.mark
        slots[0] &= _CELLS[0] - 1
        np.bitwise_and(self.last, _CELLS[1] - 1, out=slots[1])
        slots += self.base
        self.was = self.cells.take(slots)
        self.trust = self.was & _TRUST
        named = self.was >> 4
        pair = (named[0] == named[1]).astype(np.int64)
        pair <<= 4
        pair += self.trust[0] | self.trust[1]
        pair *= self.all
        pair += self.lanes
        self.pair = pair
        return named, self.named.take(pair), self.other.take(pair)

    def learn(self, ids: np.ndarray, hits: np.ndarray, counted: bool) -> None:
        """``hits``: which of the two predictions were the id that came; ``counted``: whether the next renewal shall know."""
        hits = hits.view(np.uint8)
        if counted:
            self.seen[self.pair] = self.seen.take(self.pair) + _SEEN.take(hits[0] + hits[1] * 2)
        trust = self.trust
        trust += hits << 4
        new = self.was + _CHANGE.take(trust)
        self.cells[self.slots] = np.where(_REPLACED.take(trust), (ids << 4) | _FRESH, new)
        np.multiply(self.last, 677, out=self.mark)
        self.last[:] = ids


def _packed(x: np.ndarray) -> bytes:
    coder = zlib.compressobj(1, strategy=zlib.Z_RLE)
    return coder.compress(x.astype(np.uint8).tobytes()) + coder.flush()


def _headers(blocks: list[np.ndarray], grid: np.ndarray) -> tuple[list[bytes], np.ndarray, np.ndarray]:
    """Fills the rows of ``grid`` with the ids' places among those of their block.

    Returns each block's ids and counts as bytes, the spans of all blocks' ids
    (how many smaller ones the block has, from bit 20, and how often the id
    comes, less one), and where those of a block begin.
    """
    found = np.zeros(1 << 16, bool)
    for ids in blocks:
        found[ids] = True
    known = np.flatnonzero(found)
    rank = (np.cumsum(found) - 1).astype(np.uint16)
    mark = np.zeros(len(known), np.uint16)
    heads, spans = [], []
    for k, ids in enumerate(blocks):
        place = rank.take(ids)
        counts = np.bincount(place, minlength=len(known))
        mine = np.flatnonzero(counts)
        few = counts[mine]
        spans.append(((np.cumsum(few) - few) << 20) + few - 1)
        mark[mine] = np.arange(len(mine))
        grid[k, : len(ids)] = mark.take(place)
        gaps, few = np.diff(known[mine], prepend=0), few - 1
        heads.append(_packed(np.concatenate((gaps & 255, few & 255, gaps >> 8, few >> 8))))
    kinds = np.array([len(x) for x in spans])
    return heads, np.concatenate(spans), np.cumsum(kinds) - kinds


def _intervals(hit2: np.ndarray, hit1: np.ndarray, two: np.ndarray, other: np.ndarray, first: np.ndarray, share: np.ndarray, span: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where the intervals of ids begin and how wide they are; ``two`` and ``other`` are those of ``predict``, ``first`` and ``share`` parts of them."""
    both = np.where(hit2, first, np.where(hit1, two, other + span * share))
    return both >> 20, both & 0xFFFFF


def encode(blocks: list[np.ndarray]) -> list[bytes]:
    """Each block of at most ``BLOCK`` ids (0 to 65535; others raise) as bytes that decode without any other."""
    if any(len(b) > BLOCK or len(b) and not 0 <= int(np.min(b)) <= int(np.max(b)) <= 0xFFFF for b in blocks):
        raise ValueError("ids beyond 65535 and longer blocks cannot be coded")
    out: list[bytes] = [b""] * len(blocks)
    order = [i for i in np.argsort([-len(b) for b in blocks], kind="stable").tolist() if len(blocks[i])]
    for g in range(0, len(order), LANES):
        group = order[g : g + LANES]
        sizes = np.array([len(blocks[i]) for i in group])
        n, length = len(group), int(sizes[0])
        places = np.zeros((n, length), np.uint16)
        headers, spans, offset = _headers([blocks[i] for i in group], places)
        places = np.ascontiguousarray(places.T)
        # What a step moves out, with a carry at bit 16, and -1 where it moves nothing.
        units = np.full((length + 1, n), -1, np.int32)
        lows, moved = np.zeros((_STRIPE, n), np.int64), np.zeros((_STRIPE, n), bool)
        low, size, at = np.zeros(n, np.int64), np.full(n, 1 << 48, np.int64), offset
        whole = low
        model, lanes = Model(sizes), n
        for t, m in enumerate(np.searchsorted(-sizes, -np.arange(length), "left").tolist()):
            if m < lanes:
                model.narrow(m)
                low, size, at, lanes = low[:m], size[:m], at[:m], m
            if t in _RENEWALS:
                model.renew()
            ids, now, move = places[t, :m], lows[t % _STRIPE, :m], moved[t % _STRIPE, :m]
            named, two, other = model.predict()
            hits = named == ids
            start, wide = _intervals(hits[0], hits[1], two, other, two >> 20, other & 0xFFFFF, spans.take(at + ids))
            size >>= 18
            start *= size
            np.add(low, start, out=now)
            size *= wide
            np.less(size, _UNIT, out=move)
            shift = move.astype(np.int64)
            np.bitwise_and(now, _KEPT.take(shift), out=low)
            shift <<= 4
            low <<= shift
            size <<= shift
            model.learn(ids, hits, t < _COUNTED or not t & _EVERY)
            if t % _STRIPE == _STRIPE - 1 or t == length - 1:
                rows = t % _STRIPE + 1
                np.copyto(units[t + 1 - rows : t + 1], lows[:rows] >> 32, where=moved[:rows], casting="same_kind")
                moved[:] = False
        # The range holds a value whose lower units are zeros, which need no writing.
        units[length] = (whole + _UNIT - 1) >> 32
        columns = [np.ascontiguousarray(units[:, k : k + 128].T) for k in range(0, n, 128)]
        del units
        ends = np.cumsum(np.concatenate([(c >= 0).sum(1) for c in columns])) * 2
        flat = np.concatenate([c[c >= 0] for c in columns])
        del columns
        while len(over := np.flatnonzero(flat > 0xFFFF)):  # carries
            flat[over] &= 0xFFFF
            flat[over - 1] += 1
        raw = flat.astype("<u2").tobytes()
        for i, header, a, b in zip(group, headers, [0, *ends[:-1].tolist()], ends.tolist(), strict=True):
            out[i] = len(header).to_bytes(2, "little") + header + raw[a:b]
    return out


def decode(data: list[bytes], sizes: list[int]) -> list[np.ndarray]:
    """The blocks of ids that ``encode`` made ``data`` from; ``sizes`` are their lengths."""
    out: list[np.ndarray] = [np.zeros(0, np.int32)] * len(data)
    order = [i for i in np.argsort(-np.asarray(sizes, np.int64), kind="stable").tolist() if sizes[i]]
    for g in range(0, len(order), LANES):
        group = order[g : g + LANES]
        lengths = np.array([sizes[i] for i in group])
        n, length = len(group), int(lengths[0])
        heads = [int.from_bytes(data[i][:2], "little") + 2 for i in group]
        planes = [np.frombuffer(zlib.decompress(data[i][2:h]), np.uint8).astype(np.int64).reshape(4, -1) for i, h in zip(group, heads, strict=True)]
        kinds = np.array([p.shape[1] for p in planes])
        counts = np.concatenate([p[1] + (p[3] << 8) + 1 for p in planes])
        offset = np.cumsum(kinds) - kinds
        begin = np.cumsum(counts) - counts
        spans = ((begin - np.repeat(begin[offset], kinds)) << 20) + counts - 1
        # Which id of its block a place among the sorted ids of the block is.
        sorted_ids = np.repeat((np.arange(len(counts)) - np.repeat(offset, kinds)).astype(np.uint16), counts)
        base = np.cumsum(lengths) - lengths
        tails = [data[i][h:] for i, h in zip(group, heads, strict=True)]
        units = np.frombuffer(b"".join(x + bytes(4) for x in tails) + bytes(2), "<u2")
        words = np.array([len(x) // 2 + 2 for x in tails])
        at = np.cumsum(words) - words
        code = (units[at].astype(np.int64) << 32) | (units[at + 1].astype(np.int64) << 16) | units[at + 2]
        at, size = at + 3, np.full(n, 1 << 48, np.int64)
        grid = np.zeros((length, n), np.uint16)
        model, lanes, begin = Model(lengths), n, offset
        for t, m in enumerate(np.searchsorted(-lengths, -np.arange(length), "left").tolist()):
            if m < lanes:
                model.narrow(m)
                code, size, at, base, begin, lanes = code[:m], size[:m], at[:m], base[:m], begin[:m], m
            if t in _RENEWALS:
                model.renew()
            named, two, other = model.predict()
            first, rest, share = two >> 20, other >> 20, other & 0xFFFFF
            size >>= 18
            value = (code / size).astype(np.int64)
            known, hit = value < rest, value < first
            value -= rest
            np.maximum(value, 0, out=value)
            place = sorted_ids.take((value / share).astype(np.int64) + base)
            ids = np.where(hit, named[0], np.where(known, named[1], place))
            start, wide = _intervals(hit, known, two, other, first, share, spans.take(begin + place))
            start *= size
            code -= start
            size *= wide
            move = (size < _UNIT).astype(np.int64)
            shift = move << 4
            code <<= shift
            code |= units.take(at) & _TAKEN.take(move)
            size <<= shift
            at += move
            grid[t, :m] = ids
            model.learn(ids, named == ids, t < _COUNTED or not t & _EVERY)
        ids = [np.cumsum(p[0] + (p[2] << 8)).astype(np.int32) for p in planes]
        for a in range(0, n, 128):
            whole = grid[:, a : a + 128].T.astype(np.int64, order="C")
            for k, places in enumerate(whole, a):
                out[group[k]] = ids[k].take(places[: lengths[k]])
    return out
