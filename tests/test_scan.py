"""Detection, scoring, selection and pipelines: published values, literal loops, invariants."""

import random

import pytest

from mirrorloom.functions.scoring import best_window, reverse_complement, score_hit, stacking_steps
from mirrorloom.kernel import detect
from mirrorloom.operators.detect import deduplicate_geometry, raw_candidates
from mirrorloom.operators.overlap import best_first, best_first_lazily, islands, remove_overlaps
from mirrorloom.params import ScanParams
from mirrorloom.plans import scan as P


def literal(s, p, extend=True):
    s, out = s.lower(), set()
    n, of = len(s), lambda b: 1 if b in "ag" else 2 if b in "ct" else 0
    P_, M, B = p.purity_percent, p.mismatch_percent, p.mismatch_budget
    for c in range(p.minrep - 1, n - p.minrep):
        if not of(s[c]):
            continue
        for sp in range(p.maxspacer + 1):
            r, best, mis, ga, ct, k = c + sp + 1, None, 0, 0, 0, 0
            while k < p.maxrep and c - k >= 0 and r + k < n and of(s[r + k]):
                before = mis
                mis, ga, ct, k = mis + (s[c - k] != s[r + k]), ga + (of(s[r + k]) == 1), ct + (of(s[r + k]) == 2), k + 1
                if k >= p.minrep and (ga * 100 >= P_ * k or ct * 100 >= P_ * k) and mis * 100 <= M * k and (k == p.minrep or before <= B):
                    best = (k, ga, ct, mis)
            if best:
                (k, ga, ct, mis), left = best, c
                while extend and r - left - 1 >= 2 and k < p.maxrep and s[left + 1] == s[r - 1] and of(s[r - 1]):
                    g, t = ga + (of(s[r - 1]) == 1), ct + (of(s[r - 1]) == 2)
                    if g * 100 < P_ * (k + 1) and t * 100 < P_ * (k + 1):
                        break
                    ga, ct, k, left, r = g, t, k + 1, left + 1, r - 1
                out.add((left - k + 1, r + k, k, r - left - 1, ga, ct, mis))
    return out


def test_kernel_equals_literal_loop():
    rng = random.Random(3)
    for _ in range(200):
        n = rng.randint(0, 120)
        s = "".join(rng.choice(rng.choice(["ACGT", "AAGGCT", "GAN", "AG"])) for _ in range(n))
        if rng.random() < 0.5:
            s = s[: n // 2] + "ac"[: rng.randint(0, 2)] + s[: n // 2][::-1]
        p = ScanParams(minrep=rng.randint(1, 9), maxrep=rng.choice([9, 12, 50, 1000]), maxspacer=rng.randint(0, 8), purity=rng.choice([0, 0.5, 0.8, 1]), mismatch=rng.choice([0, 0.1, 0.125, 0.5]))
        e = rng.random() < 0.7
        g = detect(s.encode(), p, extend=e)
        assert set(zip(*(g[k].tolist() for k in ("start", "end", "arm", "spacer", "ga", "ct", "mis")), strict=True)) == literal(s, p, e)


def test_result_does_not_depend_on_chunks(spark):
    rng = random.Random(5)
    half = "".join(rng.choice("GGAC") for _ in range(300))
    records = P.records_of(spark, half + "A" + half[::-1], "r", 101)
    p = ScanParams(maxrep=60, purity=0.6, mismatch=0.2)
    key = ["start", "end", "arm_length", "ga", "ct", "mismatches"]
    whole = sorted(map(tuple, deduplicate_geometry(raw_candidates(records, p)).select(key).collect()))
    for size in (7, 50, 64):
        assert sorted(map(tuple, deduplicate_geometry(raw_candidates(records, p, size=size)).select(key).collect())) == whole
    assert len(whole) > 10


@pytest.mark.parametrize("bad", [{"minrep": 0}, {"minrep": 9, "maxrep": 8}, {"maxspacer": -1}, {"purity": 1.1}, {"mismatch": -0.1}, {"overlap_strategy": "x"}, {"overlap_strategy": "score", "score": False}])
def test_parameters(bad):
    with pytest.raises(ValueError):
        ScanParams(**bad)


def test_scores():
    assert score_hit("GCGGGAGG", "GGCGCTTAT", "GGAGGGGG")[:3] == pytest.approx((15, 43.715, 58.715))
    assert [sum(stacking_steps([c == "1" for c in s])) for s in ("1111111", "1110111", "11100111", "111000111")] == [30, 10, -2.5, -65]
    assert score_hit("GANGAGAG", ".", "GAGAGAGA") is None
    assert reverse_complement("ACgtN") == "NacGT"


def test_window_search_equals_naive():
    rng = random.Random(1)
    for _ in range(200):
        arm = rng.randint(1, 30)
        a = "".join(rng.choice("GGGAAC") for _ in range(arm))
        b = "".join(x if rng.random() < 0.85 else rng.choice("ACGT") for x in a)
        loop, best = rng.randint(0, 12), None
        good = [x == y and x in "GA" for x, y in zip(a, b, strict=True)]
        for lo in range(arm):
            for hi in range(lo + min(8, arm), arm + 1):
                if 2 * (arm - hi) + loop <= hi - lo:
                    v = round(sum((7.6 if a[j] == "G" else 3.83) if good[j] else -5.715 for j in range(lo, hi)) + sum(stacking_steps(good[lo:hi])), 3)
                    if best is None or v > best[0]:
                        best = (v, lo, hi)
        assert best_window(a, b, loop) == (best[1:] if best else (0, arm))


EXAMPLES = [
    ("GGGAAATTAAAGGG", {"minrep": 6, "purity": 0.8, "mismatch": 0.2}, [(1, 14)]),
    ("GAGAAAAGAGGGAGAAAAAGGAA", {"minrep": 7, "maxrep": 25, "maxspacer": 5, "mismatch": 0.2}, [(1, 21)]),
    ("GGAAGAAGAAGGAGGAGAGAGGGAAGGAA", {"minrep": 7, "maxrep": 25, "maxspacer": 5, "mismatch": 0.2}, [(9, 29)]),
    ("GGAAGAAGAAGGAGGAGAGAGGGAAGGAA", {"minrep": 7, "maxrep": 25, "maxspacer": 5, "mismatch": 0.2, "overlap_strategy": "score"}, [(1, 15)]),
    ("GAAGGAAAGAAAGAAAGGG", {"minrep": 8, "maxrep": 22, "maxspacer": 5, "mismatch": 0.15}, [(1, 17)]),
    ("GAAGGAAAGAAAGAAAGGG", {"minrep": 8, "maxrep": 22, "maxspacer": 5, "mismatch": 0.15, "overlap_strategy": "score"}, [(3, 19)]),
    ("GA" * 21, {"minrep": 8, "maxrep": 25, "maxspacer": 5, "overlap_strategy": "score"}, [(1, 41)]),
    ("", {}, []),
]


@pytest.mark.parametrize(("seq", "params", "want"), EXAMPLES)
def test_examples(spark, seq, params, want):
    got = P.scan_sequence(spark, seq, **params).orderBy("start").collect()
    assert [(r.start, r.end) for r in got] == want
    for r in got:
        assert r.end - r.start + 1 == r.total_length == 2 * r.arm_length + r.spacer_length and r.full_sequence == r.full_sequence.lower()


def random_hits(rng, n):
    return [dict(seq_id=rng.choice("ab"), start=s, end=s + rng.randint(0, 20), arm_length=rng.randint(6, 9), spacer_length=rng.randint(0, 3), full_sequence="g", total_score=rng.choice([None, 1.0, 2.0, 3.0, 3.0])) for s in (rng.randint(1, 100) for _ in range(n))]


def test_selection_equals_global_loops(spark):
    rng = random.Random(2)
    hits = random_hits(rng, 120)
    df = spark.createDataFrame(hits, "seq_id string, start long, end long, arm_length int, spacer_length int, full_sequence string, total_score double")
    kept = []
    for h in sorted(hits, key=lambda h: (h["seq_id"], h["start"], -h["arm_length"], h["spacer_length"])):
        if not kept or kept[-1]["seq_id"] != h["seq_id"] or h["start"] > kept[-1]["end"]:
            kept.append(h)
        elif (h["arm_length"], -h["spacer_length"]) > (kept[-1]["arm_length"], -kept[-1]["spacer_length"]):
            kept[-1] = h
    got = remove_overlaps(df, "greedy").collect()
    for how in ("greedy", "score"):
        assert sorted(map(tuple, remove_overlaps(df, how, by_island=True).collect()), key=repr) == sorted(map(tuple, remove_overlaps(df, how).collect()), key=repr)
    assert sorted((r.seq_id, r.start, r.arm_length, r.spacer_length) for r in got) == sorted((h["seq_id"], h["start"], h["arm_length"], h["spacer_length"]) for h in kept)
    by = {s: [(i, h) for i, h in enumerate(hits) if h["seq_id"] == s] for s in "ab"}
    want = sorted(i for own in by.values() for i in best_first(own))
    got = remove_overlaps(df, "score").collect()
    assert sorted((r.seq_id, r.start, r.end) for r in got) == sorted((hits[i]["seq_id"], hits[i]["start"], hits[i]["end"]) for i in want)
    assert islands(df).groupBy("seq_id", "island").count().count() >= 2
    with pytest.raises(ValueError):
        remove_overlaps(df.drop("total_score"), "score")


def test_lazy_selection_equals_exhaustive():
    rng = random.Random(4)
    for _ in range(150):
        island = []
        for _ in range(rng.randint(1, 15)):
            arm, sp, start = rng.randint(8, 14), "g" * rng.randint(0, 3), rng.randint(1, 60)
            a = "".join(rng.choice("GGAAC" if rng.random() < 0.97 else "N") for _ in range(arm))
            b = a[::-1] if rng.random() < 0.5 else "".join(rng.choice("GA") for _ in range(arm))
            island.append(dict(start=start, end=start + 2 * arm + len(sp) - 1, arm_length=arm, spacer_length=len(sp), left_arm=a, spacer=sp or ".", right_arm=b, full_sequence=a + sp + b))
        scored = [h | {"total_score": (score_hit(h["left_arm"], h["spacer"], h["right_arm"]) or (0, 0, None))[2]} for h in island]
        assert [(island[i]["start"], island[i]["end"]) for i in best_first(list(enumerate(scored)))] == [(h["start"], h["end"]) for h in best_first_lazily(island)]


def test_ablation_ends_like_the_pipeline(spark):
    records = P.records_of(spark, "GAAGGAAAGAAAGAAAGGG" * 3, "r")
    p = ScanParams(remove_overlaps=False)
    a = P.scan_ablation(records, "complete", p).select("start", "end", "total_score").collect()
    assert sorted(a) == sorted(P.scan(records, p).select("start", "end", "total_score").collect())
    with pytest.raises(ValueError):
        P.scan_ablation(records, "x")


def test_profile_does_not_depend_on_chunks(spark):
    from mirrorloom.plans.profile import ScanProfile
    from mirrorloom.plans.scan import detect_candidates

    p = ScanParams(maxrep=20, maxspacer=4)
    records = spark.createDataFrame([(0, "a", "GA" * 400 + "NN" + "AAGGAAGGAC" * 30, 1), (1, "b", "ACGT", 1), (2, "c", "", 1)], "record_ix long, seq_id string, seq string, seq_offset long")
    profile, seen = ScanProfile(), []
    for size in (1 << 18, 97, 30):
        hits = profile.detect(records, p, size)
        assert sorted(map(repr, hits.collect())) == sorted(map(repr, detect_candidates(records, p).collect()))
        seen.append(profile.info())
    assert len({(s["ctr_sp_pairs"], s["inner_iters"]) for s in seen}) == 1 and seen[0]["inner_iters"] > 0
    n = 800 + 2 + 300  # by the definition: every centre but the unknown bases, every spacer that leaves room for an arm
    assert seen[0]["ctr_sp_pairs"] == sum(min(4, n - 8 - c - 1) + 1 for c in range(7, n - 8) if c not in (800, 801))
    assert seen[2]["total_inner_iters"] == 3 * seen[0]["inner_iters"] and seen[2]["scans_completed"] == 3
    profile.detect(records.where("record_ix = 2"), p).collect()
    last = profile.info()
    assert last["inner_iters"] == last["ctr_sp_pairs"] == 0 and last["total_inner_iters"] == seen[2]["total_inner_iters"] and last["scans_completed"] == 4
    profile.reset()
    assert profile.info()["scans_completed"] == 0


#: Runs of one base and one mixed motif.
PANEL = [("poly_a15", "A" * 15), ("poly_a30", "A" * 30), ("poly_t25", "T" * 25), ("poly_g30", "G" * 30), ("poly_c20", "C" * 20), ("mixed", "GGAAGAAGAAGGAGGAGAGAGGGAAGGAA")]


def test_homopolymer_panel(spark):
    from mirrorloom.plans.scan import panel
    from mirrorloom.queries import PANEL_FILTERS

    records = spark.createDataFrame([(i, n, x, 1) for i, (n, x) in enumerate(PANEL)], "record_ix long, seq_id string, seq string, seq_offset long")
    got = {r.seq_id: r.asDict() for r in panel(records, PANEL_FILTERS, ScanParams(minrep=7, mismatch=0.2, min_g_rate=0.0)).collect()}
    assert all(got[n]["none"] for n, _ in PANEL) and [n for n, _ in PANEL if got[n]["both"]] == ["mixed"]
    assert [n for n, _ in PANEL if got[n]["at_only"]] == ["poly_g30", "poly_c20", "mixed"] and [n for n, _ in PANEL if got[n]["homopolymer_only"]] == ["mixed"]


def test_files_in_order_and_by_stage(spark, tmp_path):
    from mirrorloom.plans.scan import scan_ablation, scan_fasta_ablation, scan_fasta_iter
    from mirrorloom.sources.fasta import read_fasta

    body = "".join(f">r{9 - i}\n{'GAAGGAAAGAAAGAAAGGG' * (i + 2)}\n" for i in range(9))
    (tmp_path / "x.fa").write_text(body)
    path = str(tmp_path / "x.fa")
    rows = list(scan_fasta_iter(spark, path, range_bytes=50))
    # records in the order of the file, whatever their names and however it was cut, and hits in order within them
    assert [r.seq_id for r in rows] == sorted((r.seq_id for r in rows), reverse=True) and len({r.seq_id for r in rows}) == 9
    assert all(a.start < b.start for a, b in zip(rows, rows[1:], strict=False) if a.seq_id == b.seq_id)
    for model in ("composition", "complete"):
        got, want = scan_fasta_ablation(spark, path, model), scan_ablation(read_fasta(spark, path), model)
        assert sorted(map(repr, got.collect())) == sorted(map(repr, want.collect())) and got.count() > 0


def test_kernel_filters_equal_predicates(spark):
    from mirrorloom.operators import detect as D
    from mirrorloom.plans.scan import composition, detect_candidates

    rng = random.Random(8)
    rows = [(i, "s", "".join(rng.choice(["GA" * 5, "AATA" * 4, "TTC" * 5, "GGAAGG", "N", "acgt", "TATA"]) for _ in range(rng.randint(0, 30))), 1) for i in range(40)]
    records = spark.createDataFrame(rows, "record_ix long, seq_id string, seq string, seq_offset long")
    for p in (ScanParams(), ScanParams(at_threshold=0.6), ScanParams(at_threshold=0.8, min_g_rate=0.0, purity=0.8)):
        got, want = D.materialise(D.raw_candidates(records, p, composed=True)), composition(detect_candidates(records, p), p)
        assert sorted(map(repr, got.collect())) == sorted(map(repr, want.collect())) and got.count() > 0


def test_batches_of_hits_are_bounded():
    """Hits of many sequences of one Arrow batch leave in slices."""
    import pyarrow as pa

    from mirrorloom.operators import detect as D

    n = 400
    batch = pa.RecordBatch.from_pydict({
        "record_ix": pa.array(range(n), pa.int64()), "seq_id": [f"s{i}" for i in range(n)], "seq_offset": pa.array([1] * n, pa.int64()), "shift": pa.array([0] * n, pa.int64()),
        "own_from": pa.array([0] * n, pa.int32()), "own_to": pa.array([400] * n, pa.int32()), "b": pa.array([b"ga" * 200] * n, pa.binary())})
    got = list(D._hits(ScanParams(), True)(iter([batch])))
    assert max(b.num_rows for b in got) <= D.ROWS < sum(b.num_rows for b in got)
    assert {c for b in got for c in b.column("record_ix").to_pylist()} == set(range(n))


def test_pieces_follow_the_rows(spark, tmp_path):
    from mirrorloom.sources import tables as S

    spark.range(50 * 1000).repartition(16).write.parquet(f"{tmp_path}/t")
    few = spark.read.parquet(f"{tmp_path}/t")
    assert S.spread(few).rdd.getNumPartitions() >= 32 or few.rdd.getNumPartitions() >= 8
    spark.range(400 * 1000).repartition(16).write.parquet(f"{tmp_path}/u")
    assert S.spread(spark.read.parquet(f"{tmp_path}/u")).rdd.getNumPartitions() >= 400_000 // S.PIECE


def test_streamed_rows_stay_where_they_are(spark, tmp_path):
    """Pieces of many rows are not moved for work that holds one row at a time; too few pieces still are."""
    from mirrorloom.sources import tables as S

    spark.range(400 * 1000).repartition(16).write.parquet(f"{tmp_path}/m")
    many = spark.read.parquet(f"{tmp_path}/m")
    moved = lambda df: "Exchange" in df._jdf.queryExecution().executedPlan().toString()
    assert moved(S.spread(many)) and not moved(S.spread(many, streamed=True))
    spark.range(100).coalesce(1).write.parquet(f"{tmp_path}/one")
    assert moved(S.spread(spark.read.parquet(f"{tmp_path}/one"), streamed=True))


def test_hits_of_a_long_repeat_come_by_stretches():
    """What is held at once follows the stretch and not the repeat; together they are the hits of the whole."""
    from mirrorloom.kernel import detect_many, detect_stretches

    p, seqs = ScanParams(maxrep=60), [b"ga" * 1500 + b"ttcagg" * 40, b"", b"ggaag" * 300]
    parts = list(detect_stretches(seqs, [None] * 3, p, size=256))
    assert max(len(x["row"]) for x in parts) <= 256 * (p.maxspacer + 1) < sum(len(x["row"]) for x in parts)
    rows = lambda x: list(zip(*(x[k].tolist() for k in ("row", "start", "end", "arm", "spacer", "mis", "ga", "ct")), strict=True))
    assert sorted(r for x in parts for r in rows(x)) == sorted(rows(detect_many(seqs, [None] * 3, p))) == sorted(rows(next(detect_stretches(seqs, [None] * 3, p, size=1 << 20))))
