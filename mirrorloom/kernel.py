"""NumPy kernels: mirror-repeat detection over one stretch of sequence.

The right arm decides purity, so the places where an arm may begin at all are found first, for all spacers together:
with ``F[i] = 100 * count(class, i) - P * i`` an arm from ``r`` of ``k`` bases is pure iff ``F[r + k] >= F[r]``.  A table of
range maxima tells whether any allowed ``k`` qualifies, and a descent in it finds the longest, which bounds the arm.
Only those places are paired with their centres, and all pairs grow together, one base per step, until they end or
their mismatches rule out every longer arm.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator, Sequence

import numpy as np

from .params import ScanParams

_CLASS = np.zeros(256, dtype=np.uint8)
for _bases, _value in ((b"gaGA", 1), (b"ctCT", 2)):
    _CLASS[list(_bases)] = _value
_PLACES = 1 << 17  # right arms paired with all their spacers at once
#: Bases of sequences that go through the kernel together: short ones share the cost of its array operations.
TOGETHER = 1 << 19
#: Midpoints whose hits are held at once.
STRETCH = 1 << 15


class Strand:
    """Sequences one after the other, with a separator that no arm crosses: bases, their classes and prefix counts, what belongs to whom."""

    def __init__(self, seqs: Sequence[bytes], owns: Sequence[tuple[int, int] | None]):
        self.lengths = np.array([len(s) for s in seqs], dtype=np.int64)
        self.starts = np.cumsum(self.lengths + 1) - self.lengths - 1
        self.d = np.frombuffer(b"\n".join(s.lower() for s in seqs) + b"\n", dtype=np.uint8)
        self.cls = _CLASS[self.d]
        self.ga = np.concatenate([[0], np.cumsum(self.cls == 1, dtype=np.int32)]).astype(np.int32)
        self.ct = np.concatenate([[0], np.cumsum(self.cls == 2, dtype=np.int32)]).astype(np.int32)
        self.begin = np.repeat(self.starts, self.lengths + 1).astype(np.int32)
        self.own = None if all(o is None for o in owns) else self._owned(owns)
        self._upto: dict[bytes, np.ndarray] = {}
        self._words: tuple[list[np.ndarray], list[np.ndarray]] | None = None

    def upto(self, letters: bytes) -> np.ndarray:
        """Prefix counts of the bases among ``letters``."""
        if letters not in self._upto:
            mine = np.zeros(256, dtype=bool)
            mine[list(letters)] = True
            self._upto[letters] = np.concatenate([[0], np.cumsum(mine[self.d], dtype=np.int64)])
        return self._upto[letters]

    def words(self) -> tuple[list[np.ndarray], list[np.ndarray]]:
        """For each bit of a letter's number, that bit of the 64 letters from every place on, and of those from every place back."""
        if self._words is None:
            seen = np.zeros(256, dtype=bool)
            seen[self.d] = True
            number = (np.cumsum(seen) - 1).astype(np.uint8)[self.d]
            bits = [(number >> b & 1).astype(np.uint64) for b in range(max(1, int(seen.sum() - 1).bit_length()))]
            self._words = [_packed(b) for b in bits], [_packed(b[::-1])[::-1] for b in bits]
            two = (number & 3).astype(np.uint64)
            self._short = _packed(two, 2), _packed(two[::-1], 2)[::-1]
        return self._words

    def short_words(self) -> tuple[np.ndarray, np.ndarray]:
        """Two bits of the numbers of the 32 letters from every place on, and of those from every place back: where they differ the letters do."""
        self.words()
        return self._short

    def differ(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Bit ``k`` tells whether ``left - k`` and ``right + k`` differ, for 64 bases; what lies beyond the ends counts for nothing."""
        on, back = self.words()
        out = on[0].take(right, mode="clip")
        out ^= back[0].take(left, mode="clip")
        for x, y in zip(on[1:], back[1:], strict=True):
            other = x.take(right, mode="clip")
            other ^= y.take(left, mode="clip")
            out |= other
        return out

    def _owned(self, owns: Sequence[tuple[int, int] | None]) -> np.ndarray:
        own = np.zeros(len(self.d), dtype=bool)
        for at, n, o in zip(self.starts.tolist(), self.lengths.tolist(), owns, strict=True):
            lo, hi = o or (0, n)
            own[at + max(lo, 0) : at + max(min(hi, n), 0)] = True
        return own


def _packed(values: np.ndarray, bits: int = 1) -> np.ndarray:
    """64 bits of values from every place on, each of 1 or 2 ``bits``."""
    out, width = np.concatenate([values, np.zeros(64, dtype=np.uint64)]), 1
    while width * bits < 64:
        out[:-width] |= out[width:] << np.uint64(width * bits)
        width *= 2
    return out[: len(values)]


def bounded(s: Strand, left: np.ndarray, right: np.ndarray, most: np.ndarray, minrep: np.ndarray, mismatch_percent: np.ndarray) -> np.ndarray:
    """``most`` of each pair, not beyond the last length at which its mismatches allow an arm; 0 if there is none.

    The shortest arm with a budget of ``c`` mismatches stands for all with it, so 64 bases are judged by one count for each ``c``.
    """
    out = np.zeros_like(most)
    for percent, shortest in itertools.product(np.flatnonzero(np.bincount(mismatch_percent)).tolist(), np.flatnonzero(np.bincount(minrep)).tolist()):
        mine = np.flatnonzero((mismatch_percent == percent) & (minrep == shortest))
        top, at, mis = int(most[mine].max(initial=0)), 0, np.zeros(len(mine), dtype=np.int64)
        # (shortest arm with this budget, longest one, budget)
        arms = [(max(shortest, -(-100 * c // percent)), -(-100 * (c + 1) // percent) - 1, c) for c in range(percent * shortest // 100, percent * top // 100 + 1)] if percent else [(shortest, top, 0)]
        while len(mine):
            word = s.differ(left[mine] - at, right[mine] + at)
            for least, longest, c in arms:
                if at < least <= at + 64:
                    few = mis + np.bitwise_count(word & np.uint64((1 << (least - at)) - 1)) <= c
                    out[mine[few & (most[mine] >= least)]] = longest
            mis, at = mis + np.bitwise_count(word), at + 64
            go = (most[mine] > at) & (mis * 100 <= percent * most[mine])
            mine, mis = mine[go], mis[go]
    return np.minimum(out, most)


def _range_maxima(f: np.ndarray, longest: int) -> list[np.ndarray]:
    levels, span = [f], 1
    while 2 * span <= longest + 1:
        below = levels[-1]
        levels.append(np.maximum(below[:-span], below[span:]) if len(below) > span else below[:0])
        span *= 2
    return levels


def _last_at_least(levels: list[np.ndarray], lo: np.ndarray, hi: np.ndarray, value: np.ndarray) -> np.ndarray:
    """For each query the last index in [lo, hi] whose entry is at least ``value``, or lo - 1."""
    out = lo - 1
    # whether there is one at all, by two overlapping ranges; few queries go on
    power = np.frexp(hi - lo + 1)[1] - 1
    some = np.zeros(len(lo), dtype=bool)
    for level in range(len(levels)):
        mine = np.flatnonzero(power == level) if level < len(levels) - 1 else np.flatnonzero(power >= level)
        if not len(mine) or not len(levels[level]):
            continue
        table, size = levels[level], 1 << level
        if level < len(levels) - 1 or (1 << len(levels)) > int((hi[mine] - lo[mine]).max()) + 1:
            some[mine] = np.maximum(table[lo[mine]], table[hi[mine] - size + 1]) >= value[mine]
        else:
            some[mine] = True
    ids = np.flatnonzero(some)
    lo, pos, value = lo[ids], hi[ids].copy(), value[ids]
    for level in range(len(levels) - 1, -1, -1):
        size = 1 << level
        table = levels[level]
        if not len(table):
            continue
        for _ in range(2 if level == len(levels) - 1 else 1):
            first = pos - size + 1
            fits = first >= lo
            skip = np.zeros(len(pos), dtype=bool)
            skip[fits] = table[first[fits]] < value[fits]
            pos = np.where(skip, pos - size, pos)
    # what is left is shorter than the smallest power tried; one entry may remain
    out[ids] = np.where((pos >= lo) & (levels[0][np.maximum(pos, 0)] >= value), pos, lo - 1)
    return out


def places(s: Strand, minrep: int, maxrep: int, percents: Sequence[int]) -> tuple[np.ndarray, np.ndarray]:
    """(right, reach [percentage, place]): where a right arm can be pure by the first of the ascending ``percents``, and for each a bound of its length, 0 if none is pure."""
    n = len(s.d)
    place = np.arange(n, dtype=np.int32)
    bad = np.flatnonzero(s.cls == 0).astype(np.int32)  # the last base is a separator
    longest = np.minimum(bad[np.searchsorted(bad, place)] - place, maxrep)
    r = np.flatnonzero((longest >= minrep) & (place - s.begin >= minrep)).astype(np.int32)
    longest, top = longest[r], int(longest[r].max(initial=0))
    reach = np.zeros((len(percents), len(r)), dtype=np.int32)
    for i, percent in enumerate(percents):
        mine = np.flatnonzero(reach[i - 1]) if i else np.arange(len(r))
        if not len(mine):
            break
        far = np.zeros(len(mine), dtype=np.int32)
        steps = percent * np.arange(n + 1, dtype=np.int64)
        for counts in (s.ga, s.ct):
            f = 100 * counts.astype(np.int64) - steps
            f = f.astype(np.int32) if 100 * n < 1 << 31 else f
            far = np.maximum(far, _last_at_least(_range_maxima(f, top), r[mine] + minrep, r[mine] + (reach[i - 1] if i else longest)[mine], f[r[mine]]) - r[mine])
        reach[i, mine] = np.where(far >= minrep, far, 0)
    some = reach[0] > 0
    return r[some], reach[:, some]


def paired(s: Strand, r: np.ndarray, reach: np.ndarray, minrep: int, maxspacer: int, mismatch_percent: int) -> tuple[np.ndarray, ...]:
    """What :func:`pairs` yields for some places."""
    depth = min(4, minrep)
    left = r[:, None] - 1 - np.arange(maxspacer + 1, dtype=np.int32)
    most = np.minimum(reach[:, None], left - s.begin[r][:, None] + 1)
    mis = np.zeros(left.shape, dtype=np.int32)
    for k in range(depth):
        mis += s.d.take(left - k, mode="wrap") != s.d[r + k][:, None]  # wraps where the arm has no room, which ``most`` rules out
    i, j = np.nonzero((most >= minrep) & (mis * 100 <= mismatch_percent * most))
    right, left, most, mis = (x.astype(np.int64) for x in (r[i], left[i, j], most[i, j], mis[i, j]))
    keep = s.cls[left] != 0
    if s.own is not None:
        keep &= s.own[(left + right) >> 1]
    return left[keep], right[keep], most[keep], mis[keep], depth


def likely(s: Strand, r: np.ndarray, reach: np.ndarray, minrep: np.ndarray, maxspacer: np.ndarray, mismatch_percent: np.ndarray, shortest: int, widest: int) -> tuple[np.ndarray, ...]:
    """(left, right, most, place in ``r``) of what :func:`paired` yields, without most of the pairs that their mismatches rule out.

    An arm of up to twice a length has no more mismatches than its budget before that length; 32 bases are counted at once.
    """
    on, back = s.short_words()
    left = r[:, None] - 1 - np.arange(widest + 1, dtype=np.int32)
    most = np.minimum(reach[:, None], left - s.begin[r][:, None] + 1)
    x = back.take(left, mode="clip")
    x ^= on[r][:, None]
    x |= x >> np.uint64(1)
    x &= np.uint64(0x5555555555555555)
    percent = mismatch_percent.astype(np.int32)[:, None]
    some = (most > 32) & (np.bitwise_count(x) * np.int32(100) <= percent * most)
    length = shortest
    while length <= 32:
        some |= np.bitwise_count(x & np.uint64((1 << 2 * length) - 1)) <= (percent * 2 * length // 100).astype(np.uint8)
        length *= 2
    i, j = np.nonzero(some & (most >= minrep[:, None]) & (np.arange(widest + 1) <= maxspacer[:, None]))
    right, left, most = (a.astype(np.int64) for a in (r[i], left[i, j], most[i, j]))
    keep = s.cls[left] != 0
    if s.own is not None:
        keep &= s.own[(left + right) >> 1]
    return left[keep], right[keep], most[keep], i[keep]


def pairs(s: Strand, minrep: int, maxrep: int, maxspacer: int, percent: int, mismatch_percent: int) -> Iterator[tuple[np.ndarray, ...]]:
    """(left, right, most, mismatches, k): innermost bases of all arm pairs whose midpoint is owned and whose right arm can be pure, a bound of its
    length, and the mismatches of the first ``k`` bases, which do not yet rule the pair out.
    """
    for stretch in pairs_by_stretch(s, minrep, maxrep, maxspacer, percent, mismatch_percent, len(s.d)):
        yield from stretch


def pairs_by_stretch(s: Strand, minrep: int, maxrep: int, maxspacer: int, percent: int, mismatch_percent: int, size: int) -> Iterator[Iterator[tuple[np.ndarray, ...]]]:
    """:func:`pairs`, those of every ``size`` midpoints apart from the others."""
    r, (reach,) = places(s, minrep, maxrep, [percent])
    step = max(1, _PLACES // (maxspacer + 1))

    def stretch(first: int) -> Iterator[tuple[np.ndarray, ...]]:
        lo, hi = np.searchsorted(r, [first, first + size + maxspacer // 2 + 1])
        for at in range(lo, hi, step):
            mine = slice(at, min(at + step, hi))
            left, right, most, mis, depth = paired(s, r[mine], reach[mine], minrep, maxspacer, mismatch_percent)
            middle = (left + right) >> 1
            keep = (middle >= first) & (middle < first + size)
            yield left[keep], right[keep], most[keep], mis[keep], depth

    for first in range(0, len(s.d), size):
        yield stretch(first)


def centre_spacer_pairs(s: Strand, p: ScanParams) -> list[int]:
    """For each sequence, pairs of a centre and a spacer that leave room for both arms and whose midpoint it owns: what a scan has to look at."""
    known = s.cls != 0
    total = np.zeros(len(s.lengths), dtype=np.int64)
    for at, (start, n) in enumerate(zip(s.starts.tolist(), s.lengths.tolist(), strict=True)):
        for sp in range(p.maxspacer + 1):
            lo, hi = start + p.minrep - 1, start + n - p.minrep - sp
            if hi > lo:
                half = (sp + 1) // 2
                total[at] += int((known[lo:hi] & (True if s.own is None else s.own[lo + half : hi + half])).sum())
    return total.tolist()


def detect_stretches(seqs: Sequence[bytes], owns: Sequence[tuple[int, int] | None], p: ScanParams, extend: bool = True, counters: dict[str, list[int]] | None = None, composed: bool = False, size: int = STRETCH) -> Iterator[dict[str, np.ndarray]]:
    """Longest valid arm per (centre, spacer) whose midpoint lies in its sequence's ``own``, extended inwards and without repeats.

    Extension keeps the midpoint and equal spans share it, so ownership by midpoint leaves no repeats between stretches.

    Hits come by stretches of ``size`` midpoints, as one long repeat has a hit for each of its bases and spacers.

    Yields arrays ``row`` (of the sequence), ``start`` (0-based), ``end`` (exclusive), ``arm``, ``spacer``, ``ga``, ``ct``, ``mis``.
    ``composed`` leaves out what the composition filters of ``p`` drop, judged by prefix counts before any span is cut.
    ``counters`` gets, for each sequence, the pairs of centre and spacer it owns and the comparisons of bases made for them.
    """
    s = Strand(seqs, owns)
    d, ga, ct = s.d, s.ga, s.ct
    if counters is not None:
        counters["ctr_sp_pairs"] = centre_spacer_pairs(s, p)
        counters["inner_iters"] = [0] * len(seqs)
    row_of = lambda at: np.searchsorted(s.starts, at, side="right") - 1

    def count(at: np.ndarray, times: int = 1) -> None:
        for i, c in enumerate(np.bincount(row_of(at), minlength=len(seqs)).tolist()):
            counters["inner_iters"][i] += c * times

    P, M, B = p.purity_percent, p.mismatch_percent, p.mismatch_budget
    for stretch in pairs_by_stretch(s, p.minrep, p.maxrep, p.maxspacer, P, M, size):
        found = []
        for left, right, most, mis, k in stretch:
            if counters is not None:
                count(right, k)
            best, best_mis = np.zeros(len(left), dtype=np.int64), np.zeros(len(left), dtype=np.int64)
            limit = M * most // 100
            state = [np.arange(len(left)), left, right, most, limit, mis, ga[right].astype(np.int64), ct[right].astype(np.int64)]
            before = mis
            while len(state[0]):
                ids, ll, rr, most, limit, mis, ga0, ct0 = state
                if k >= p.minrep:
                    at = rr + k
                    # at the shortest arm the budget does not count yet
                    ok = (mis * 100 <= M * k) & (np.maximum(ga.take(at) - ga0, ct.take(at) - ct0) * 100 >= P * k)
                    if k > p.minrep:
                        ok &= before <= B
                    if ok.any():
                        which = ids if ok.all() else ids[ok]
                        best[which], best_mis[which] = k, mis if len(which) == len(ids) else mis[ok]
                alive = (most > k) & (mis <= (np.minimum(limit, B) if k >= p.minrep else limit))
                if not alive.all():
                    state = [x[alive] for x in state]
                    ids, ll, rr, most, limit, mis, ga0, ct0 = state
                if counters is not None:
                    count(rr)
                before = mis
                state[5] = mis + (d.take(ll - k) != d.take(rr + k))
                k += 1
            hit = best > 0
            found.append((left[hit], right[hit], best[hit], best_mis[hit]))
        if not found:
            continue
        left, right, arm, mis = (np.concatenate(x).astype(np.int64) for x in zip(*found, strict=True))
        if extend:
            left, right, arm = _extend(s, left, right, arm, P, p.maxrep)
        start, end = left - arm + 1, right + arm
        order = np.lexsort((arm, end, start))
        start, end, arm, right, mis = (x[order] for x in (start, end, arm, right, mis))
        first = np.ones(len(start), dtype=bool)
        first[1:] = (start[1:] != start[:-1]) | (end[1:] != end[:-1]) | (arm[1:] != arm[:-1])
        start, end, arm, right, mis = (x[first] for x in (start, end, arm, right, mis))
        if composed:
            keep = passes(s, p, start, end, arm, right)
            start, end, arm, right, mis = (x[keep] for x in (start, end, arm, right, mis))
        row = row_of(start)
        shift = s.starts[row]
        counts = {"ga": ga[right + arm] - ga[right], "ct": ct[right + arm] - ct[right]}
        yield {"row": row, "start": start - shift, "end": end - shift, "arm": arm, "spacer": end - start - 2 * arm, "mis": mis} | {k: v.astype(np.int64) for k, v in counts.items()}


def detect_many(seqs: Sequence[bytes], owns: Sequence[tuple[int, int] | None], p: ScanParams, extend: bool = True, counters: dict[str, list[int]] | None = None, composed: bool = False) -> dict[str, np.ndarray]:
    """All hits of :func:`detect_stretches` in order."""
    names, parts = ("row", "start", "end", "arm", "spacer", "mis", "ga", "ct"), list(detect_stretches(seqs, owns, p, extend, counters, composed))
    got = {n: np.concatenate([x[n] for x in parts]) if parts else np.zeros(0, dtype=np.int64) for n in names}
    order = np.lexsort((got["arm"], got["end"], got["start"], got["row"]))
    return {n: x[order] for n, x in got.items()}


def passes(s: Strand, p: ScanParams, start: np.ndarray, end: np.ndarray, arm: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Which hits (half-open, in places of the strand) the A/T and the G-rate filter of ``p`` keep."""
    keep = np.ones(len(start), dtype=bool)
    if p.at_threshold is not None:
        warm = s.upto(b"at")
        keep &= (warm[end] - warm[start]) / (end - start) < p.at_threshold
    if p.min_g_rate:
        purine = s.ga[right + arm] - s.ga[right] >= s.ct[right + arm] - s.ct[right]
        g, c = s.upto(b"g"), s.upto(b"c")
        most = lambda n: np.maximum(n[start + arm] - n[start], n[end] - n[end - arm])
        keep &= np.where(purine, most(g), most(c)) / arm >= p.min_g_rate
    return keep


def detect(seq: bytes, p: ScanParams, own: tuple[int, int] | None = None, extend: bool = True) -> dict[str, np.ndarray]:
    """:func:`detect_many` of one sequence."""
    return detect_many([seq], [own], p, extend)


def together(lengths: Sequence[int], most: int = TOGETHER) -> Iterator[tuple[int, int]]:
    """Ranges of sequences that go through the kernel together: up to ``most`` bases, or one longer sequence."""
    start, total = 0, 0
    for i, n in enumerate(lengths):
        if i > start and total + n > most:
            yield start, i
            start, total = i, 0
        total += n
    if lengths:
        yield start, len(lengths)


def _extend(s: Strand, left, right, arm, percent, maxrep):
    """Move both arms into the spacer while its outer bases agree and the right arm stays pure."""
    d, cls, ga, ct = s.d, s.cls, s.ga, s.ct
    left, right, arm = left.copy(), right.copy(), arm.copy()
    ids = np.arange(len(left))
    while len(ids):
        ids = ids[(right[ids] - left[ids] - 1 >= 2) & (arm[ids] < maxrep)]
        a, b, k = left[ids] + 1, right[ids] - 1, arm[ids] + 1
        end = right[ids] + arm[ids]
        pure = (100 * (ga[end] - ga[b]) >= percent * k) | (100 * (ct[end] - ct[b]) >= percent * k)
        ids = ids[(d[a] == d[b]) & (cls[a] != 0) & pure]
        left[ids] += 1
        right[ids] -= 1
        arm[ids] += 1
    return left, right, arm


def percentages(ga: np.ndarray, ct: np.ndarray, mis: np.ndarray, arm: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Shares in percent, in single precision as the output format has them."""
    inverse = np.float32(1) / arm.astype(np.float32)
    hundred = np.float32(100)
    share = lambda x: x.astype(np.float32) * inverse * hundred
    return share(ga).astype(np.float64), share(ct).astype(np.float64), ((np.float32(1) - mis.astype(np.float32) * inverse) * hundred).astype(np.float64)
