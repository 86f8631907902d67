"""A whole parameter grid in one pass over the bases.

All arm pairs grow once, for the loosest of the configurations; for every (purity, mismatch) of the grid the longest arm that
satisfies it is noted on the way, and the shortest arm and the widest spacer only decide afterwards which of the noted arms
count.  Equal geometries of all configurations become one hit with a bit mask of the configurations that have it.  Overlap
removal and the homopolymer filter, whose outcome differs between configurations, sweep over these hits once, with a
state per configuration, and stop as soon as every configuration of the record is settled.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np

from .functions.scoring import MIN_WINDOW, score_hit
from .kernel import _PLACES, Strand, _extend, bounded, likely, pairs, places
from .params import ScanParams
from .schema import NO_SPACER

#: States of the composition filters (A/T threshold, homopolymers) by name.
FILTERS = {"none": (None, False), "at": (0.8, False), "homopolymer": (None, True), "both": (0.8, True)}


@dataclass(frozen=True)
class Grid:
    """Values of each axis; ``config_id`` counts through them with the last axis the fastest.  Overlap removal is greedy."""

    filters: tuple[str, ...] = tuple(FILTERS)
    purity: tuple[float, ...] = (0.85, 0.90, 0.95, 1.0)
    mismatch: tuple[float, ...] = (0.0, 0.05, 0.10, 0.15)
    minrep: tuple[int, ...] = (8, 10, 12)
    maxspacer: tuple[int, ...] = (5, 10, 15)
    base: ScanParams = field(default_factory=ScanParams)

    def __post_init__(self) -> None:
        if list(self.minrep) != sorted(set(self.minrep)) or list(self.maxspacer) != sorted(set(self.maxspacer)):
            raise ValueError("minrep and maxspacer must ascend")
        if self.base.overlap_strategy != "greedy" or not self.base.remove_overlaps:
            raise ValueError("the grid removes overlaps greedily")
        for p in self.params():
            if p.mismatch_percent * p.minrep > 100 * p.mismatch_budget + 99:
                raise ValueError("the mismatch budget must cover the shortest arm")

    def configs(self) -> list[dict]:
        names = ("filters", "purity", "mismatch", "minrep", "maxspacer")
        return [dict(zip(names, c, strict=True)) for c in itertools.product(*(getattr(self, n) for n in names))]

    def params(self) -> list[ScanParams]:
        out = []
        for c in self.configs():
            at, homopolymers = FILTERS[c.pop("filters")]
            out.append(self.base.but(at_threshold=at, filter_homopolymers=homopolymers, **c))
        return out

    @property
    def size(self) -> int:
        return len(self.filters) * self.detections

    @property
    def detections(self) -> int:
        """Configurations that differ in what they detect."""
        return len(self.purity) * len(self.mismatch) * len(self.minrep) * len(self.maxspacer)

    @property
    def detection_words(self) -> int:
        return -(-self.detections // 64)

    @property
    def words(self) -> int:
        return -(-self.size // 64)


def _tables(g: Grid) -> np.ndarray:
    """[purity, mismatch, number of minreps met, first spacer allowed] -> configurations that detect such an arm, as words of packed bits."""
    P, M, J, L = len(g.purity), len(g.mismatch), len(g.minrep), len(g.maxspacer)
    out = np.zeros((P, M, J + 1, L, P, M, J, L), dtype=bool)
    for p, m, j, s in itertools.product(range(P), range(M), range(J + 1), range(L)):
        out[p, m, j, s, p, m, :j, s:] = True
    bits = np.zeros((P, M, J + 1, L, 64 * g.detection_words), dtype=bool)
    bits[..., : g.detections] = out.reshape(P, M, J + 1, L, g.detections)
    return np.packbits(bits, axis=-1).view(np.uint64)


def _grown(s: Strand, g: Grid, tables: np.ndarray, chunk: tuple[np.ndarray, ...], mismatch: int | np.ndarray) -> list[tuple[np.ndarray, ...]]:
    """(start, end, arm, right, mask) of the hits of some pairs, extended inwards; ``mismatch`` is the percentage beyond which a pair is not looked for."""
    d, ga, ct = s.d, s.ga, s.ct
    some = [g.base.but(purity=p) for p in g.purity], [g.base.but(mismatch=m) for m in g.mismatch]
    percents = [p.purity_percent for p in some[0]]
    limits = [(p.mismatch_percent, p.mismatch_budget) for p in some[1]]
    shortest, loosest, most_mis, budget = g.minrep[0], min(percents), max(m for m, _ in limits), max(b for _, b in limits)
    left, right, most, mis, k = chunk
    # what a purity or a mismatch allows, a lower purity or a higher mismatch allows too: per number of purities and of mismatches that
    # allow an arm, the longest one
    rising, falling, n = sorted(percents), sorted(limits, reverse=True), len(left)
    last = np.zeros((len(percents) + 1, len(limits) + 1, n), dtype=np.int16 if g.base.maxrep < 1 << 15 else np.int64)
    rows: list[tuple[np.ndarray, ...]] = []
    state = [np.arange(n), left, right, mismatch * most // 100, most, mis, ga[right], ct[right]]
    before = mis
    while len(state[0]):
        ids, ll, rr, limit, most_, mis, ga0, ct0 = state
        if k >= shortest:
            at = rr + k
            share = 100 * np.maximum(ga.take(at) - ga0, ct.take(at) - ct0)
            ok = (share >= loosest * k) & (mis * 100 <= most_mis * k)
            if k > shortest:
                ok &= before <= budget
            which = np.flatnonzero(ok)
            if len(which):
                share, now, was = share[which], mis[which] * 100, before[which]
                pure, few = np.zeros(len(which), dtype=np.int64), np.zeros(len(which), dtype=np.int64)
                for percent in rising:
                    pure += share >= percent * k
                for m, b in falling:
                    few += ((now <= m * k) & (was <= b)) if k > shortest else (now <= m * k)
                last.reshape(-1)[(pure * (len(limits) + 1) + few) * n + ids[which]] = k
        alive = (most_ > k) & (mis <= (np.minimum(limit, budget) if k >= shortest else limit))
        if not alive.all():
            state = [x[alive] for x in state]
            ids, ll, rr, limit, most_, mis, ga0, ct0 = state
        before = mis
        state[5] = mis + (d.take(ll - k) != d.take(rr + k))
        k += 1
    last = np.maximum.accumulate(np.maximum.accumulate(last[::-1, ::-1], axis=0), axis=1)[::-1, ::-1]
    best = np.stack([[last[rising.index(p) + 1, falling.index(m) + 1] for m in limits] for p in percents])
    spacer = np.searchsorted(g.maxspacer, right - left - 1)
    for i, percent in enumerate(percents):
        mask = np.zeros((len(left), tables.shape[-1]), dtype=np.uint64)
        for j in range(len(limits)):
            arm = best[i, j]
            at = np.flatnonzero(arm)
            mask[at] |= tables[i, j, np.searchsorted(g.minrep, arm[at], side="right"), spacer[at]]
            if j + 1 < len(limits):  # an arm that the next limit has too goes with it
                at = at[best[i, j + 1, at] != arm[at]]
            if len(at):
                a, b, n = _extend(s, left[at], right[at], arm[at].astype(np.int64), percent, g.base.maxrep)
                rows.append((a - n + 1, b + n, n, b, mask[at]))
                mask[at] = 0
    return rows


def _merged(s: Strand, g: Grid, rows: list[tuple[np.ndarray, ...]]) -> dict[str, np.ndarray]:
    """Every geometry once, with the configurations of all its pairs."""
    if not rows:
        none = np.zeros(0, dtype=np.int64)
        return {"start": none, "end": none, "arm": none, "ga": none, "ct": none, "mask": np.zeros((0, g.detection_words), dtype=np.uint64)}
    start, end, arm, right, mask = (np.concatenate(x) for x in zip(*rows, strict=True))
    order = np.lexsort((arm, end, start))
    start, end, arm, right, mask = (x[order] for x in (start, end, arm, right, mask))
    first = np.flatnonzero(np.concatenate([[True], (start[1:] != start[:-1]) | (end[1:] != end[:-1]) | (arm[1:] != arm[:-1])]))
    mask = np.bitwise_or.reduceat(mask, first, axis=0)
    start, end, arm, right = (x[first] for x in (start, end, arm, right))
    return {"start": start, "end": end, "arm": arm, "ga": s.ga[right + arm] - s.ga[right], "ct": s.ct[right + arm] - s.ct[right], "mask": mask}


def _loosest(g: Grid) -> tuple[int, int]:
    return min(g.base.but(purity=p).purity_percent for p in g.purity), max(g.base.but(mismatch=m).mismatch_percent for m in g.mismatch)


def detect_grid(s: Strand, g: Grid) -> dict[str, np.ndarray]:
    """Every geometry that a configuration detects, in places of the strand: ``start``, ``end`` (exclusive), ``arm``, ``ga``, ``ct``, and ``mask`` [hits, words]."""
    percent, mismatch = _loosest(g)
    tables = _tables(g)
    return _merged(s, g, [row for chunk in pairs(s, g.minrep[0], g.base.maxrep, g.maxspacer[-1], percent, mismatch) for row in _grown(s, g, tables, chunk, mismatch)])


def with_filters(s: Strand, found: dict[str, np.ndarray], g: Grid) -> dict[str, np.ndarray]:
    """``found`` with ``spacer``, in the order of the sweep, without the hits that no configuration keeps before it.

    The mask has two halves, configurations without and with the A/T filter.
    """
    start, end, arm, mask = (found[k] for k in ("start", "end", "arm", "mask"))
    spacer = end - start - 2 * arm
    keep = np.lexsort((spacer, -arm, start))
    if g.base.min_g_rate:
        n = {b: s.upto(b) for b in (b"g", b"c")}
        rate = {b: np.maximum(x[start + arm] - x[start], x[end] - x[end - arm]) / arm for b, x in n.items()}
        ok = np.where(found["ga"] >= found["ct"], rate[b"g"], rate[b"c"]) >= g.base.min_g_rate
        keep = keep[ok[keep]]
    start, end, arm, spacer, mask = (x[keep] for x in (start, end, arm, spacer, mask))
    warm = s.upto(b"at")
    cool = (warm[end] - warm[start]) / (end - start) < FILTERS["at"][0]
    return {"start": start, "end": end, "arm": arm, "spacer": spacer, "mask": np.concatenate([mask, np.where(cool[:, None], mask, np.uint64(0))], axis=1)}


def is_uniform(s: str) -> bool:
    return bool(s) and not s.strip(s[0])


def mixed(span: str, arm: int) -> bool:
    """Whether a hit passes the homopolymer filter after scoring."""
    if is_uniform(span):
        return False
    got = score_hit(span[:arm], span[arm:-arm] or NO_SPACER, span[-arm:])
    return got is None or not is_uniform(got[3].replace("[", "").replace("]", ""))


class Sweep:
    """Greedy selection with a state per configuration, reduced to which configurations have a hit at all and a mixed one that stays."""

    def __init__(self, g: Grid):
        self.g, n = g, 2 * 64 * g.detection_words
        self.any, self.mixed = np.zeros(n, dtype=bool), np.zeros(n, dtype=bool)
        self.end, self.arm, self.spacer, self.at = (np.full(n, -1, dtype=np.int64) for _ in range(4))
        self.held: dict[int, tuple[str, int]] = {}
        self.count = 0
        self.low_end, self.low_arm = -1, -1  # a hit that begins before the one and has a shorter arm than the other takes no place

    def _keep(self, which: np.ndarray) -> None:
        for i in np.unique(self.at[which]).tolist():
            if i >= 0 and mixed(*self.held[i]):
                self.mixed |= which & (self.at == i)

    def hit(self, start: int, end: int, arm: int, spacer: int, span: str, mask: np.ndarray) -> None:
        """The next hit in order of (start, -arm, spacer); ``end`` exclusive, ``mask`` in bytes."""
        has = np.unpackbits(mask).view(bool)
        self.any |= has
        has = has & ~self.mixed
        if not has.any():
            return
        apart = has & (start >= self.end)
        closing = apart & (self.at >= 0)
        if closing.any():
            self._keep(closing)
        taken = apart | (has & ((arm > self.arm) | ((arm == self.arm) & (spacer < self.spacer))))
        if not taken.any():
            return
        if len(self.held) > 4096:
            used = set(np.unique(self.at).tolist())
            self.held = {k: v for k, v in self.held.items() if k in used}
        self.held[self.count] = (span, arm)
        self.end[taken], self.arm[taken], self.spacer[taken], self.at[taken] = end, arm, spacer, self.count
        self.count += 1
        open_ = self.any & ~self.mixed
        self.low_end, self.low_arm = (int(x[open_].min(initial=1 << 62)) for x in (self.end, self.arm))

    def island(self) -> None:
        """What comes next overlaps nothing before."""
        self._keep(~self.mixed & (self.at >= 0))
        self.end[:], self.arm[:], self.spacer[:], self.at[:] = -1, -1, -1, -1
        self.held = {}
        self.low_end, self.low_arm = -1, -1

    def words(self) -> list[int]:
        """The record's calls, bit ``config_id``, as signed 64-bit integers."""
        self.island()
        n, half = self.g.detections, len(self.any) // 2
        bits = []
        for name in self.g.filters:
            at, homopolymers = FILTERS[name]
            source = self.mixed if homopolymers else self.any
            bits.append(source[half : half + n] if at is not None else source[:n])
        flat = np.concatenate(bits)
        padded = np.zeros(64 * self.g.words, dtype=bool)
        padded[: len(flat)] = flat
        return np.packbits(padded, bitorder="little").view("<i8").tolist()


def surely_mixed(s: Strand, start: np.ndarray, end: np.ndarray, arm: np.ndarray) -> np.ndarray:
    """Hits that pass the homopolymer filter whatever window scores best: what every window's triplex holds, the spacer and the bases of
    the shortest window on both sides of it, is not one base alone.
    """
    inner = arm - np.minimum(arm, MIN_WINDOW)
    changes = np.concatenate([[0], np.cumsum(s.d[1:] != s.d[:-1])])
    return changes[end - inner - 1] > changes[start + inner]


_FIRST = 16  # places of a record in its first round; each round after it has eight times as many
_PAIRS = 1 << 15  # pairs that grow together


def _long_runs(s: Strand, least: int) -> np.ndarray:
    """Which bases lie in a run of ``least`` equal ones that an arm may hold."""
    edge = np.flatnonzero(np.concatenate([[True], s.d[1:] != s.d[:-1], [True]]))
    length = np.diff(edge)
    return np.repeat(length >= least, length) & (s.cls != 0)


def _wanted(g: Grid, settled: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """[record, purity, minrep] -> greatest mismatch in percent (-1: none) and greatest spacer of the configurations that are not settled; purities ascend."""
    shape = (len(settled), 2, len(g.purity), len(g.mismatch), len(g.minrep), len(g.maxspacer))
    bits = np.unpackbits(settled.view(np.uint8), axis=1).reshape(len(settled), 2, -1)[:, :, : g.detections]
    open_ = (bits == 0).reshape(shape).any(axis=1)[:, np.argsort(g.purity)]
    mismatch = np.array([g.base.but(mismatch=m).mismatch_percent for m in g.mismatch])
    return np.where(open_.any(axis=4), mismatch[:, None], -1).max(axis=2), np.where(open_.any(axis=2), np.array(g.maxspacer), -1).max(axis=3)


class _Calls:
    """Which configurations have a hit at all in each record, and which surely keep a mixed one; both with and without the A/T filter."""

    def __init__(self, s: Strand, g: Grid):
        self.s, self.g, self.tables = s, g, _tables(g)
        n = len(s.lengths)
        self.any = np.zeros((n, 2 * g.detection_words), dtype=np.uint64)
        self.mixed = self.any.copy()
        whole = np.zeros(64 * g.detection_words, dtype=bool)
        whole[: g.detections] = True
        self.whole = np.tile(np.packbits(whole).view(np.uint64), 2)
        self.r, self.reach = places(s, g.minrep[0], g.base.maxrep, sorted(g.base.but(purity=p).purity_percent for p in g.purity))
        self.row = np.searchsorted(s.starts, self.r, side="right") - 1
        self.free = s.starts.copy()  # from here on every hit of the record is surely mixed
        self.runs = np.zeros(n, dtype=bool)
        self.kept: list[dict[str, np.ndarray]] = []

    def settled(self) -> np.ndarray:
        return (self.mixed == self.whole).all(axis=1)

    def look(self, which: np.ndarray) -> Iterator[dict[str, np.ndarray]]:
        """Hits of some places for configurations that are not settled in their record when their turn comes."""
        g, widest = self.g, self.g.maxspacer[-1]
        step = max(1, _PLACES // (widest + 1))
        held: list[tuple[np.ndarray, ...]] = []
        for at in range(0, len(which), step):
            mine = np.sort(which[at : at + step])
            rows = np.unique(self.row[mine])
            mismatch, spacer = (x[np.searchsorted(rows, self.row[mine])] for x in _wanted(g, self.mixed[rows]))
            reach, n = self.reach[:, mine], len(mine)
            most, least, limit, far = np.zeros(n, dtype=np.int32), np.full(n, g.minrep[-1]), np.full(n, -1), np.full(n, -1)
            for i in range(len(g.purity)):
                for j, shortest in enumerate(g.minrep):
                    fits = (reach[i] >= shortest) & (mismatch[:, i, j] >= 0)
                    most = np.maximum(most, np.where(fits, reach[i], 0))
                    least = np.minimum(least, np.where(fits, shortest, g.minrep[-1]))
                    limit = np.maximum(limit, np.where(fits, mismatch[:, i, j], -1))
                    far = np.maximum(far, np.where(fits, spacer[:, i, j], -1))
            some = limit >= 0
            if some.any():
                r, limit = self.r[mine[some]], limit[some]
                left, right, most, place = likely(self.s, r, most[some], least[some], far[some], limit, g.minrep[0], widest)
                limit = limit[place]
                most = bounded(self.s, left, right, most, least[some][place], limit)
                few = most > 0
                left, right, most, limit = left[few], right[few], most[few], limit[few]
                held.append((left, right, most, (self.s.d[left] != self.s.d[right]).astype(np.int64), limit))
            # what is left of many places grows together
            if held and (at + step >= len(which) or sum(len(x[0]) for x in held) > _PAIRS):
                *pair, limit = (np.concatenate(x) for x in zip(*held, strict=True))
                held = []
                hits = with_filters(self.s, _merged(self.s, g, _grown(self.s, g, self.tables, (*pair, 1), limit)), g)
                yield hits | {"row": np.searchsorted(self.s.starts, hits["start"], side="right") - 1}

    def note(self, hits: dict[str, np.ndarray]) -> None:
        row = hits["row"]
        if not len(row):
            return
        first = np.flatnonzero(np.concatenate([[True], row[1:] != row[:-1]]))
        late = hits["start"] >= self.free[row]
        self.any[row[first]] |= np.bitwise_or.reduceat(hits["mask"], first, axis=0)
        self.mixed[row[first]] |= np.bitwise_or.reduceat(np.where(late[:, None], hits["mask"], np.uint64(0)), first, axis=0)
        if self.runs[row].any():
            self.kept.append({k: v[self.runs[row]] for k, v in hits.items()})

    def words(self) -> list[list[int]]:
        """The calls of every record, bit ``config_id``, as signed 64-bit integers."""
        g, n = self.g, len(self.any)
        halves = lambda x: np.unpackbits(x.view(np.uint8), axis=1).reshape(n, 2, -1)[:, :, : g.detections]
        any_, mixed_ = halves(self.any), halves(self.mixed)
        bits = [(mixed_ if homopolymers else any_)[:, 1 if at is not None else 0] for at, homopolymers in (FILTERS[f] for f in g.filters)]
        padded = np.zeros((n, 64 * g.words), dtype=np.uint8)
        padded[:, : g.size] = np.concatenate(bits, axis=1)
        return np.packbits(padded, axis=1, bitorder="little").view("<i8").tolist()


def scan_grid_many(seqs: Sequence[bytes], g: Grid) -> list[list[int]]:
    """Which configurations call each of the sequences, as words of bits.

    Records are scanned in rounds of places, and what a record's configurations have settled is not looked for again in it.  Only a hit whose
    midpoint lies in a long run may not be mixed.  A hit that begins where the last of those has ended settles its configurations: in the
    sweep, whatever is kept at that place or after it is surely mixed.  So runs come last, and what is still open then is swept, in islands
    that are not all surely mixed.
    """
    s = Strand(seqs, [None] * len(seqs))
    calls = _Calls(s, g)
    run = _long_runs(s, 2 * min(g.minrep[0], MIN_WINDOW))
    near = np.zeros(0, dtype=np.int64)
    if run.any():
        upto = np.concatenate([[0], np.cumsum(run)])
        near = np.flatnonzero(upto[calls.r + 1] > upto[np.maximum(calls.r - g.maxspacer[-1] // 2 - 2, 0)])
        np.maximum.at(calls.free, calls.row[near], calls.r[near].astype(np.int64) + calls.reach[0, near])
        calls.runs[calls.row[near]] = True
        s.own = ~run
    rank = np.empty(len(calls.r), dtype=np.int64)
    order = np.lexsort((calls.r, calls.r < calls.free[calls.row], calls.row))
    rank[order] = np.arange(len(order)) - np.searchsorted(calls.row, calls.row)
    turn = np.ceil(np.log2(rank // _FIRST + 1) / 3).astype(np.int64)
    for i in range(int(turn.max(initial=-1)) + 1):
        for hits in calls.look(np.flatnonzero((turn == i) & ~calls.settled()[calls.row])):
            calls.note(hits)
    near = near[~calls.settled()[calls.row[near]]]
    if len(near):
        s.own = run
        found = list(calls.look(near))
        calls.free = s.starts.copy()
        for hits in found:
            unsure = ~surely_mixed(s, hits["start"], hits["end"], hits["arm"])
            np.maximum.at(calls.free, hits["row"][unsure], hits["end"][unsure])
        found, calls.kept = calls.kept + found, []
        for hits in found:
            calls.note(hits)
        _swept(calls)
    return calls.words()


def _swept(calls: _Calls) -> None:
    """Settle what is open in records with hits that may not be mixed."""
    s, g, settled = calls.s, calls.g, calls.settled()
    kept = [{k: v[~settled[h["row"]]] for k, v in h.items()} for h in calls.kept]
    if not sum(len(h["row"]) for h in kept):
        return
    hits = {k: np.concatenate([h[k] for h in kept]) for k in kept[0]}
    order = np.lexsort((hits["spacer"], -hits["arm"], hits["start"]))
    start, end, arm, spacer, mask, row = (hits[k][order] for k in ("start", "end", "arm", "spacer", "mask", "row"))
    island = np.flatnonzero(np.concatenate([[True], start[1:] >= np.maximum.accumulate(end)[:-1]]))
    sure = np.repeat(np.logical_and.reduceat(surely_mixed(s, start, end, arm), island), np.diff(np.append(island, len(start))))
    first = np.flatnonzero(np.concatenate([[True], row[1:] != row[:-1]]))
    calls.mixed[row[first]] |= np.bitwise_or.reduceat(np.where(sure[:, None], mask, np.uint64(0)), first, axis=0)
    opens = np.zeros(len(start), dtype=bool)
    opens[island] = True
    sweeps: dict[int, Sweep] = {}
    for i in np.flatnonzero(~sure).tolist():
        at = int(row[i])
        if at not in sweeps:
            sweeps[at] = sweep = Sweep(g)
            sweep.any, sweep.mixed = (np.unpackbits(x[at].view(np.uint8)).view(bool) for x in (calls.any, calls.mixed))
        elif opens[i]:
            sweeps[at].island()
        if start[i] < sweeps[at].low_end and arm[i] < sweeps[at].low_arm:
            continue  # its record's configurations are known beforehand
        sweeps[at].hit(int(start[i]), int(end[i]), int(arm[i]), int(spacer[i]), bytes(s.d[start[i] : end[i]]).decode("latin-1"), mask[i].view(np.uint8))
    for at, sweep in sweeps.items():
        sweep.island()
        calls.mixed[at] |= np.packbits(sweep.mixed).view(np.uint64)


def scan_grid(seq: str, g: Grid) -> list[int]:
    """Which configurations call a whole record, as words of bits."""
    return scan_grid_many([seq.lower().encode("latin-1", "replace")], g)[0]
