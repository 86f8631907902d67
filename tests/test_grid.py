"""The grid scan against one plain scan per configuration."""

import random

import numpy as np
import pytest

from mirrorloom import grid, kernel
from mirrorloom.grid import FILTERS, Grid, mixed, scan_grid, scan_grid_many
from mirrorloom.operators import evaluation as E
from mirrorloom.operators.grid import grid_calls, grid_confusion, grid_counts, grid_predictions
from mirrorloom.params import ScanParams
from mirrorloom.plans.scan import scan


def sequence(rng: random.Random, pieces: int) -> str:
    return "".join(rng.choice(["GA" * rng.randint(1, 9), "AAGG" * rng.randint(1, 5), "ACGT", "TTC" * rng.randint(1, 8), "N", rng.choice("ACGT") * rng.randint(1, 40), "GGAGAAGGG", "CATG"]) for _ in range(pieces))


def called(seq: str, p: ScanParams) -> bool:
    """Detection, composition filters, greedy overlap removal, homopolymers, one configuration at a time."""
    seq = seq.lower()
    got, rows, kept = kernel.detect(seq.encode(), p), [], []
    for a, b, arm, ga, ct in zip(*(got[k].tolist() for k in ("start", "end", "arm", "ga", "ct")), strict=True):
        span, base = seq[a:b], "g" if ga >= ct else "c"
        if max(span[:arm].count(base), span[-arm:].count(base)) / arm < p.min_g_rate:
            continue
        if p.at_threshold is None or (span.count("a") + span.count("t")) / len(span) < p.at_threshold:
            rows.append((a, -arm, b - a - 2 * arm, b, span))
    for row in sorted(rows):
        if not kept or row[0] >= kept[-1][3]:
            kept.append(row)
        elif (-row[1], -row[2]) > (-kept[-1][1], -kept[-1][2]):
            kept[-1] = row
    return any(not p.filter_homopolymers or mixed(span, -arm) for _, arm, _, _, span in kept)


def bits(words: list[int], n: int) -> list[int]:
    return [words[i // 64] >> (i % 64) & 1 for i in range(n)]


def test_whole_grid_equals_single_scans():
    rng, g = random.Random(4), Grid()
    assert g.size == len(g.configs()) == 576 and len(FILTERS) == 4
    for _ in range(8):
        seq = sequence(rng, rng.randint(1, 12))
        assert bits(scan_grid(seq, g), g.size) == [called(seq, p) for p in g.params()]
    assert bits(scan_grid("", g), g.size) == [0] * 576


@pytest.fixture(scope="module")
def small():
    return Grid(purity=(0.8, 1.0), mismatch=(0.0, 0.2), minrep=(6, 8), maxspacer=(3, 10), base=ScanParams(maxrep=50))


def test_cut_records_equal_whole_ones(spark, small):
    rng = random.Random(9)
    rows = [(i, f"s{i}", sequence(rng, n), 1) for i, n in enumerate([0, 1, 3, 30, 60, 150])]
    records = spark.createDataFrame(rows, "record_ix long, seq_id string, seq string, seq_offset long")
    want = {i: scan_grid(seq, small) for i, _, seq, _ in rows}
    for size in (1 << 18, 300, 40):
        assert {r.record_ix: r.words for r in grid_calls(records, small, size).collect()} == want
    matrix = {(r.config_id, r.record_ix): r.p for r in grid_predictions(grid_calls(records, small), small).collect()}
    assert matrix == {(c, i): b for i, w in want.items() for c, b in enumerate(bits(w, small.size))}
    c = 37  # and one of them by the scan itself
    hits = {r.record_ix for r in scan(records, small.params()[c]).select("record_ix").distinct().collect()}
    assert hits == {i for i in want if matrix[c, i]}


def test_confusion_of_every_configuration(spark, small):
    rng = random.Random(3)
    rows = [(i, f"s{i}", sequence(rng, 2), 1) for i in range(20)]
    records = spark.createDataFrame(rows, "record_ix long, seq_id string, seq string, seq_offset long")
    truth = spark.createDataFrame([(i, i % 2) for i in range(20)], "record_ix long, y int")
    calls = grid_calls(records, small)
    pred = grid_predictions(calls, small).join(truth, "record_ix")
    want = {r.config_id: (r.tp, r.fp, r.tn, r.fn) for r in E.confusion(pred, by=["config_id"]).collect()}
    assert {r.config_id: (r.tp, r.fp, r.tn, r.fn) for r in grid_confusion(calls, truth, small).collect()} == want


def test_grid_checks():
    for bad in ({"minrep": (10, 8)}, {"maxspacer": (5, 5)}, {"base": ScanParams(overlap_strategy="score")}):
        with pytest.raises(ValueError):
            Grid(**bad)


def test_counts_shuffle_a_row_per_group(spark, small):
    """Confusions per fold from sums of bits; the explode of every configuration for every record is gone."""
    rng = random.Random(5)
    rows = [(i, f"s{i}", sequence(rng, 2), 1) for i in range(20)]
    records = spark.createDataFrame(rows, "record_ix long, seq_id string, seq string, seq_offset long")
    truth = spark.createDataFrame([(i, i % 2, i % 3) for i in range(20)], "record_ix long, y int, fold int")
    calls = grid_calls(records, small)
    want = E.confusion(grid_predictions(calls, small).join(truth, "record_ix"), by=["fold", "config_id"])
    got = grid_confusion(calls, truth, small, by=["fold"])
    assert sorted(got.collect()) == sorted(want.select(got.columns).collect())
    assert {(r.config_id, r.total) for r in grid_counts(calls, small).collect()} == {(i, 20) for i in range(small.size)}


def test_records_scanned_together_equal_single_ones():
    """Islands of long runs are swept, all others settled at once."""
    rng, g = random.Random(6), Grid()
    seqs = [sequence(rng, rng.randint(0, 6)).lower().encode() for _ in range(6)] + [b"", b"g" * 60, b"g" * 20 + b"ttac" + b"ga" * 9]
    assert [bits(w, g.size) for w in scan_grid_many(seqs, g)] == [[called(s.decode(), p) for p in g.params()] for s in seqs]


def test_what_is_settled_is_not_looked_for_again(monkeypatch):
    """A long repeat settles all configurations in its first places."""
    grown, whole = [], grid._grown
    monkeypatch.setattr(grid, "_grown", lambda s, g, tables, chunk, mismatch: (grown.append(len(chunk[0])), whole(s, g, tables, chunk, mismatch))[1])
    g = Grid()
    assert bits(scan_grid("ga" * 2000, g), g.size) == [1] * 576
    assert 0 < sum(grown) < 1000  # of some 30,000 pairs


def test_runs_anywhere_equal_single_scans():
    """Runs, which may not be mixed, at the start, inside, at the end, twice, and nothing else."""
    rng, g = random.Random(11), Grid(purity=(0.85, 1.0), mismatch=(0.0, 0.15), minrep=(8, 12), maxspacer=(5, 15), base=ScanParams(maxrep=60))
    repeat = lambda: rng.choice(["ggaag", "gagg", "tcctc", "gggac", "ctctt"]) * rng.randint(4, 30)
    long = lambda: rng.choice("gatc") * rng.randint(14, 120)
    shapes = [(long, repeat), (repeat, long), (repeat, long, repeat), (long, long), (long, repeat, long, repeat), (repeat, repeat), (long,)]
    seqs = ["".join(part() + rng.choice(["", "n", "acgt"]) for part in shape).encode() for shape in shapes for _ in range(6)]
    assert [bits(w, g.size) for w in scan_grid_many(seqs, g)] == [[called(s.decode(), p) for p in g.params()] for s in seqs]


def test_bounds_of_pairs_are_those_of_their_mismatches():
    rng = random.Random(12)
    s = kernel.Strand(["".join(rng.choice("gggagn") for _ in range(400)).encode()], [None])
    d = s.d.tolist()
    pairs = [(i, i + 1 + rng.randint(0, 5), rng.randint(1, 190), rng.choice([6, 12, 70]), rng.choice([0, 5, 15, 40])) for i in range(190, 205) for _ in range(60)]
    left, right, most, minrep, percent = (np.array(x) for x in zip(*pairs, strict=True))
    got = kernel.bounded(s, left, right, most, minrep, percent).tolist()
    for (a, b, far, shortest, m), bound in zip(pairs, got, strict=True):
        mis = np.cumsum([d[a - k] != d[b + k] for k in range(far)])
        fits = [k for k in range(shortest, far + 1) if mis[k - 1] * 100 <= m * k]
        assert bound == 0 if not fits else max(fits) <= bound <= far
