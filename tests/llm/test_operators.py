"""Every operator against a brute-force version, on odd rows and on empty tables."""

import collections
import hashlib
import itertools
import random
import re

import numpy as np
import public_tokenizers
import pytest
import xxhash
from pyspark.sql import functions as F

from mirrorloom.llm import attention_lm, bpe, exact_dedup, language_id, line_dedup, mixing, pii, quality_fm, rule_ledger, simhash_pigeonring
from mirrorloom.llm.common import keyed

from .conftest import ODD

VOCAB = public_tokenizers.path("byte_bpe_50k.json")
SPACE = re.compile(r"[\x20\x09-\x0D]+")


def prose(n, seed=0, words=60):
    rng = random.Random(seed)
    bag = ["".join(rng.choice("thernaoi") for _ in range(rng.randint(2, 7))) for _ in range(200)]
    return [" ".join(rng.choice(bag) for _ in range(rng.randint(5, words))) for _ in range(n)]


# 1


def test_exact_dedup(spark, odd, none):
    got = exact_dedup.exact_dedup(odd).collect()
    assert len(got) == len(ODD)
    groups = collections.defaultdict(list)
    for r in ODD:
        groups[SPACE.sub(" ", r[1] or "")].append(r[0])
    want = sorted((str(i), str(min((x for x in g if x is not None), default=None)), len(g), hashlib.sha256(t.encode()).hexdigest()) for t, g in groups.items() for i in g)
    assert sorted((str(r.doc_id), str(r.keep_id), r.group_size, r.text_sha256) for r in got) == want
    assert sorted(r.text_sha256 for r in got if r.kept) == sorted(hashlib.sha256(t.encode()).hexdigest() for t in groups)  # one row of each group
    assert all(r.doc_id == r.keep_id for r in got if r.kept)
    assert exact_dedup.exact_dedup(none).count() == 0
    left = exact_dedup.drop_duplicates(odd)
    assert left.columns == odd.columns and left.count() == len(groups)


def test_index_with_small_buckets(spark):
    rng = random.Random(7)
    rows = [(i, f"text {rng.randrange(300)}") for i in range(500)] + [(None, "only null"), (None, "only null")]
    got = exact_dedup.exact_dedup(spark.createDataFrame(rows, "doc_id long, text string"), capacity=4).collect()
    least = {}
    for i, t in rows:
        least[t] = min((x for x in (i, least.get(t)) if x is not None), default=None)
    assert len(got) == len(rows) and len({r.bucket for r in got}) > 16
    assert collections.Counter((r.doc_id, r.keep_id) for r in got) == collections.Counter((i, least[t]) for i, t in rows)
    assert sum(r.kept for r in got) == len(least)


def test_directory_doubles_and_splits():
    counts = [(p, 3) for p in range(256)]
    depth, slots = exact_dedup.grow_directory(counts, 100, 1, 8)
    assert depth == 3 and len(slots) == 8  # 768 keys in buckets of at most 100
    depth, slots = exact_dedup.grow_directory([(0, 500), (255, 1)], 100, 1, 8)
    assert depth == 8 and len({b for _, b, _ in slots}) == 9
    assert exact_dedup.grow_directory([], 10, 2, 8)[0] == 2


def test_colliding_keys_are_chained_by_bytes(spark, monkeypatch):
    monkeypatch.setattr(exact_dedup.F, "xxhash64", lambda *c: F.lit(7).cast("long"))
    docs = spark.createDataFrame([(1, "a"), (2, "b"), (3, "a"), (4, "c")], "doc_id long, text string")
    got = {r.doc_id: (r.keep_id, r.chain) for r in exact_dedup.exact_dedup(docs).collect()}
    assert {k: v[0] for k, v in got.items()} == {1: 1, 2: 2, 3: 1, 4: 4}
    assert sorted({v[1] for v in got.values()}) == [1, 2, 3]


# 2


def test_targets_cap_and_reshare():
    got = mixing.targets({"sa": 10, "sb": 100, "n": 1000})
    assert got["sa"] == 30 and got["sb"] == 300 and got["n"] == pytest.approx(780)
    assert mixing.targets({}) == {}


def test_mix(spark, odd, none):
    docs = spark.createDataFrame([(i, t, f"s{i % 5}") for i, t in enumerate(prose(600, 3))], "doc_id long, text string, source string")
    a = mixing.mix(docs).collect()
    per = collections.defaultdict(lambda: [0, 0.0])
    for r in a:
        per[r.doc_id % 5][0] += r.taken
        per[r.doc_id % 5][1] = r.target
        assert r.taken <= 3 * r.size and 0 < r.rate <= 3 + 1e-9
    assert all(abs(t - want) <= 0.02 * want for t, want in per.values())
    assert sorted(map(tuple, a)) == sorted(map(tuple, mixing.mix(docs.repartition(5)).collect()))
    got = mixing.mix(odd).collect()
    assert len(got) == len(ODD) and sum(r.size == 0 for r in got) == 3
    assert mixing.mix(none).count() == 0
    assert mixing.repeat_documents(odd).columns == odd.columns


def test_mix_rates_equal_bisection(spark):
    rng = random.Random(12)
    rows = [(i, "w " * rng.choice([1, 3, 10, 40, 200]), rng.choice(["a", "b", "c", None])) for i in range(400)]
    got = mixing.mix(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()
    sizes = collections.defaultdict(list)
    for _, t, s in rows:
        sizes[s].append(len(t.split()))
    goal = mixing.targets({"n" if s is None else f"s{s}": sum(v) for s, v in sizes.items()})
    for source, own in sizes.items():
        mean, target = sum(own) / len(own), goal["n" if source is None else f"s{source}"]
        lo, hi = -60.0 * (1 + mean), 60.0 * (1 + mean)
        for _ in range(200):
            mid = (lo + hi) / 2
            if sum(min(3.0, np.exp(min(50.0, mid * x / mean))) * x for x in own) < target:
                lo = mid
            else:
                hi = mid
        for r in got:
            if rows[r.doc_id][2] == source:
                assert r.rate == pytest.approx(min(3.0, np.exp(min(50.0, lo * r.size / mean))), rel=1e-3)


# 3


def test_lm_scores(spark, odd, none):
    texts = prose(150, 5)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").unionByName(odd.select("doc_id", "text"))
    got = attention_lm.score(docs, VOCAB, hot=50, sample=60).collect()
    rows = [(i, t or "") for i, t in [*enumerate(texts), *[(r[0], r[1]) for r in ODD]]]
    import zlib

    held = lambda i: zlib.crc32((str(i) if i is not None else "").encode()) % 5 == 1
    tokens = lambda t: [*t.encode().lower().split(), None]
    counts = collections.Counter(w for i, t in rows if not held(i) for w in tokens(t))
    n, v = sum(counts.values()), len(counts)
    base = sorted(round(float(sum(np.log10((counts[w] + 0.5) / (n + 0.5 * (v + 1))) for w in tokens(t))), 5) for _, t in rows)
    assert sorted(round(r.base_score, 5) for r in got) == pytest.approx(base, abs=2e-5)
    assert {r.train_tokens for r in got} == {n}
    assert sorted(r.n_known for r in got) == sorted(sum(counts[w] > 0 for w in tokens(t)) for _, t in rows)
    assert all(r.score < 0 for r in got)
    assert attention_lm.score(none, VOCAB, sample=10).count() == 0


def test_lm_score_does_not_depend_on_the_table_of_common_words(spark, odd):
    docs = spark.createDataFrame(list(enumerate(prose(150, 5))), "doc_id long, text string").unionByName(odd.select("doc_id", "text"))
    few, all_ = ([(r.n_known, r.base_score, r.score) for r in attention_lm.score(docs, VOCAB, hot=hot, sample=60).collect()] for hot in (50, 1_000_000))
    assert np.array(sorted(few)) == pytest.approx(np.array(sorted(all_)), rel=1e-6)


def test_lm_learns_from_every_document(spark, monkeypatch):
    texts = prose(300, 6)
    docs = spark.createDataFrame([(i, t, i) for i, t in enumerate(texts)], "doc_id long, t string, h long")
    own = attention_lm.encoder(VOCAB)
    ids = [own.document(t.encode().lower().split()) for t in texts]
    counts = np.bincount(np.concatenate(ids), minlength=own.size).astype(float)
    bucket = attention_lm._buckets(counts)
    pairs = attention_lm.pair_counts(docs.select("t"), bucket, VOCAB)
    a, b = attention_lm.Model(counts, pairs), attention_lm.Model(counts, ids)
    assert (a.cls == b.cls).all() and a.after == pytest.approx(b.after, abs=1e-5)
    assert sum(r.n for r in pairs.table.collect()) == sum(map(len, ids))
    used = [attention_lm.train_windows(a, docs.where(f"doc_id < {n}").select("h", "t"), VOCAB).count() for n in (100, 200, 300)]
    assert 100 <= used[0] and used[0] + 100 <= used[1] and used[1] + 100 <= used[2]
    seen = []
    monkeypatch.setattr(attention_lm, "train_all", lambda model, train, *_: seen.append(train.count()) or model)
    model = attention_lm.train(docs, attention_lm.word_counts(docs, "doc_id", "t", 5, 9)[0], 300, VOCAB, "doc_id", "t", 5, 9, sample=5)
    assert seen == [300] and model.after == pytest.approx(a.after, abs=1e-5)  # not the counts of the five documents


def test_lm_learns_from_every_place(spark, monkeypatch):
    """Of a long document all windows, not one in so many: every place of every text is learned once, and texts of several pieces lose none."""
    texts = [*prose(20, 6), "", "a", "one two three four five six seven eight nine ten " * 700]
    docs = spark.createDataFrame(list(enumerate(texts)), "h long, t string")
    own = attention_lm.encoder(VOCAB)
    ids = [own.document(t.encode().lower().split()) for t in texts]
    model = attention_lm.Model(np.bincount(np.concatenate(ids), minlength=own.size).astype(float), ids)
    monkeypatch.setattr(attention_lm, "PIECE", 20)
    rows = attention_lm.train_windows(model, docs, VOCAB).collect()
    assert len(rows) > len(texts)
    places, want = collections.Counter(), collections.Counter()
    got, target, ok = attention_lm.cut([r.first for r in rows], [bytes(r.rows) for r in rows], [bytes(r.target) for r in rows])
    places.update(zip(got[ok].tolist(), target[ok].tolist(), strict=True))
    for x in ids:
        want.update(zip(model.row[np.append(x[-1:], x[:-1])].tolist(), model.cls[x].tolist(), strict=True))
    assert places == want


def test_each_place_is_scored_once():
    for n in (1, 7, 8, 31, 32, 33, 100, 1000):
        doc, first, skip = attention_lm.windows(np.array([n, 5]))
        seen = collections.Counter()
        for d, f, s in zip(doc, first, skip, strict=True):
            seen.update((d, p) for p in range(f + s, min(f + attention_lm.WINDOW, (n, 5)[d])))
        assert set(seen.values()) == {1} and len(seen) == n + 5


def test_lm_step_follows_the_gradient():
    """The first moments after one step are a tenth of the slopes of the loss, by differences; places that are not marked count nothing."""
    rng = np.random.default_rng(3)
    ids = [rng.integers(0, 300, 70) for _ in range(6)]
    m = attention_lm.Model(np.bincount(np.concatenate(ids), minlength=4000).astype(float), ids)
    m.p = {n: x.astype(float) for n, x in m.p.items()}
    m.p["r"] += rng.standard_normal(attention_lm.WINDOW) * 0.1
    rows, target = m.row[rng.integers(0, 300, (4, attention_lm.WINDOW))].astype(np.int64), rng.integers(0, m.k, (4, attention_lm.WINDOW))
    ok = rng.random(rows.shape) < 0.7

    def loss():
        logit = m.attend(rows)[0] @ m.p["o"] + m.p["d"] + m.after[rows]
        each = np.log(np.exp(logit).sum(axis=2)) - np.take_along_axis(logit, target[:, :, None], 2)[:, :, 0]
        return each[ok].mean()

    slopes = {}
    for name, x in m.p.items():
        for _ in range(4):
            at = tuple(rng.integers(0, n) for n in x.shape) if name != "e" else (int(rng.choice(rows.ravel())), int(rng.integers(x.shape[1])))
            was, parts = x[at], []
            for step in (1e-5, -1e-5):
                x[at] = was + step
                parts.append(loss())
            x[at] = was
            slopes[name, at] = (parts[0] - parts[1]) / 2e-5
    moments = m.moments()
    m.learn(rows, target, ok, moments, 1, 0.001)
    for (name, at), slope in slopes.items():
        assert abs(moments[0][name][at] * 10 - slope) < 1e-5 + 1e-3 * abs(slope), (name, at)


def test_attention_is_causal_and_sums_to_one():
    own = attention_lm.encoder(VOCAB)
    ids = [own.document(t.encode().split()) for t in prose(30, 8)]
    counts = np.bincount(np.concatenate(ids), minlength=own.size).astype(float)
    m = attention_lm.Model(counts, ids).train(ids, steps=20)
    assert np.bincount(m.cls, weights=np.exp(m.share.astype(float)))[np.unique(m.cls)] == pytest.approx(1, abs=1e-3)
    a, b = ids[0][:20], np.concatenate([ids[0][:10], ids[1][:10]])
    end = ids[0][-1:]
    sa, sb = m.score([np.append(a, end)]), m.score([np.append(b, end)])
    assert sa[:10] == pytest.approx(sb[:10], abs=1e-5)


def test_lm_scores_equal_masked_attention():
    """Scoring by tables over many windows against the plain forward pass with an explicit mask, window by window."""
    own = attention_lm.encoder(VOCAB)
    ids = [own.document(t.encode().split()) for t in prose(40, 9, 90)]
    counts = np.bincount(np.concatenate(ids), minlength=own.size).astype(float)
    m = attention_lm.Model(counts, ids).train(ids, steps=30)
    got, want = m.score(ids), []
    for x in ids:
        before = np.append(x[-1:], x[:-1])
        _, first, skip = attention_lm.windows(np.array([len(x)]))
        for f, s in zip(first, skip, strict=True):
            rows = m.row[before[f : f + attention_lm.WINDOW]]
            e = m.p["e"][rows]
            q, k, v = e @ m.p["q"], e @ m.p["k"], e @ m.p["v"]
            for t in range(s, len(rows)):
                a = np.array([q[t] @ k[j] / np.sqrt(attention_lm.WIDTH) + m.p["r"][t - j] for j in range(t + 1)])
                w = np.exp(a - a.max())
                h = np.tanh(e[t] @ m.p["a"] + (w / w.sum()) @ v[: t + 1] @ m.p["b"] + m.p["c"])
                z = h @ m.p["o"] + m.p["d"] + m.after[rows[t]]
                want.append(z[m.cls[x[f + t]]] - z.max() - np.log(np.exp(z - z.max()).sum()) + m.share[x[f + t]])
    assert len(got) == len(want) and got == pytest.approx(np.array(want), abs=2e-3)


# 4


def test_quality(spark, odd, none):
    good, bad = prose(200, 1), [" ".join(f"{w}$$$" for w in t.split()) for t in prose(200, 2)]
    docs = spark.createDataFrame([(i, t, len(t)) for i, t in enumerate(good + bad)], "doc_id long, text string, n_chars long")
    labels = spark.createDataFrame([(i, int(i < 200)) for i in range(400)] + [(None, 1), (5, None)], "doc_id long, quality int")
    machine = quality_fm.fit(docs, labels)
    got = quality_fm.score(docs, machine).collect()
    assert sum((r.score >= 0.5) == (r.doc_id < 200) for r in got) >= 396
    assert len(quality_fm.score(odd, machine).collect()) == len(ODD)
    assert quality_fm.score(none, machine).count() == 0
    untrained = quality_fm.fit(none, labels)
    assert all(0 <= r.score <= 1 for r in quality_fm.score(odd, untrained).collect())
    assert quality_fm.keep_good(odd, labels).columns == odd.columns


def test_quality_scores_equal_brute_force(spark):
    m = quality_fm.Machine(3)
    m.bias, m.linear[:] = 0.2, np.linspace(-1, 1, len(m.linear))
    m.factors *= 20
    texts = ["the cat sat on the mat", "A B C | $ $", "", "é 12 34"]
    docs = spark.createDataFrame([(i, t, len(t)) for i, t in enumerate(texts)], "doc_id long, text string, n_chars long")
    for r in quality_fm.score(docs, m).collect():
        _, f, x = quality_fm.features([texts[r.doc_id]], [len(texts[r.doc_id])])
        y = m.bias + sum(m.linear[a] * b for a, b in zip(f, x, strict=True))
        y += sum(m.factors[f[i]] @ m.factors[f[j]] * x[i] * x[j] for i in range(len(f)) for j in range(i))
        assert r.score == pytest.approx(1 / (1 + np.exp(-y)), abs=1e-4)


def test_one_label_of_an_id_counts(spark):
    docs = spark.createDataFrame([(i, t, 5) for i, t in enumerate(prose(60, 3))], "doc_id long, text string, n_chars long")
    once = [(i, i % 2) for i in range(60)]
    a = quality_fm.fit(docs, spark.createDataFrame(once, "doc_id long, quality int"))
    b = quality_fm.fit(docs, spark.createDataFrame(once + [(i, 1) for i in range(60)] + once, "doc_id long, quality int"))
    assert (a.linear == b.linear).all()


def test_sum_of_squares_identity():
    m = quality_fm.Machine()
    ends, f, x = quality_fm.features(["a b c d e", "a a b"], [9, None])
    m.linear[:] = 0
    got = m.raw(ends, f, x)[0]
    for i, (a, b) in enumerate(zip([0, ends[0]], ends, strict=True)):
        want = sum(m.factors[f[p]] @ m.factors[f[q]] * x[p] * x[q] for p, q in itertools.combinations(range(a, b), 2))
        assert got[i] == pytest.approx(want, abs=1e-5)


# 5


BASE = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def luhn(d):
    return sum(int(c) if i % 2 == 0 else int(c) * 2 - 9 * (c > "4") for i, c in enumerate(reversed(d))) % 10 == 0


def base_spans(t):
    out = []
    for i, (k, p) in enumerate(BASE.items()):
        for m in re.finditer(p, t):
            d = re.sub("[^0-9]", "", m[0])
            ok = {"email": True, "ip": k == "ip" and all(int(x) <= 255 for x in m[0].split(".")), "card": 14 <= len(d) <= 19 and luhn(d), "phone": 10 <= len(d) <= 15}[k]
            if ok:
                out.append((m.start(), i, m.end(), k))
    return ",".join(f"{k}:{s}:{e}" for s, i, e, k in sorted(out))


PII = [
    "Mail a@b.c_d@e.fg and x.y@z.co. ok 1.2.3.4.5 300.1.2.3.4 009.1.1.1 é 4111 1111 1111 1111, call +1 (555) 123-4567 99 and 12 4785380592391139 end",
    "bob [at] host.com 4111-1111-1111-1111+49 30 12345678 " + "7" * 400 + " " + "1.1.1." * 60, "a@b", "@@..@a.b", "+12345678901 (", "1 2 3 4 5 6 7 8 9 0 1 2 3 4", "", None,
]


def test_pii_base_spans(spark, odd, none):
    rng = random.Random(4)
    texts = PII + ["".join(rng.choice("ab@.-+_ 0123456789()") for _ in range(120)) for _ in range(150)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    found = pii.find(docs, {}).withColumn("b", pii.span_text(F.col("base")))
    for r in found.collect():
        assert r.b == base_spans(texts[r.doc_id] or ""), texts[r.doc_id]
    assert pii.find(odd, {}).count() == len(ODD) and pii.find(none).count() == 0


def test_pii_added_spans(spark):
    rng = random.Random(9)

    def card():
        d = "4" + "".join(rng.choice("0123456789") for _ in range(14))
        return d + next(c for c in "0123456789" if luhn(d + c))

    texts = [f"the card {card()} was lost" if rng.random() < 0.5 else f"see {card()}-1 or " + " ".join(str(rng.randrange(1000, 9999)) for _ in range(3)) + f" of {card()[:15]}" for _ in range(600)]
    texts += ["token = \"" + "".join(rng.choice("0123456789abcdef") for _ in range(40)) + "\" here" if i % 2 else f"(name_{i}_of_a_long_thing{i} here" for i in range(200)]
    key = "9a" * 20
    texts += [f"pay 4111111111111112 {card()} now", f"lost {key} here", "a@b.de 1.2.3.4 " * 4_000]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r for r in pii.find(docs).collect()}
    assert [(x.kind, x.s, x.e) for x in got[801].added] == [(4, 5, 45)]
    assert len(got[802].base) == 8_000 and not got[802].added
    for r in got.values():
        assert all(a.e <= b.s or b.e <= a.s for a in r.added for b in [*r.base[:50], *r.added] if a != b)
    redacted = {r.doc_id: r.redacted for r in pii.redact(docs.where("doc_id = 0 or doc_id = 600 or doc_id between 601 and 611"), {}).collect()}
    assert redacted[0] in ("the card <card> was lost", texts[0])


def test_pii_trees_equal_brute_force(spark):
    """Depth-two trees by listing every pair of splits, against those that the operator fits, and as a column."""
    rng = random.Random(5)
    table = [(rng.randrange(1 << pii.CODE_BITS), rng.randrange(5), rng.randrange(5)) for _ in range(60)]
    model = pii.boost(table)
    at, values = 0, {}
    for name, bits in pii.FEATURES.items():
        values[name] = lambda c, at=at, bits=bits: c >> at & ((1 << bits) - 1)
        at += bits
    offset, trees = model
    score = {c: offset for c, *_ in table}
    for f, cut, low, high in trees:
        g = {c: p * (1 - 1 / (1 + np.exp(-score[c]))) - n / (1 + np.exp(-score[c])) for c, n, p in table}
        h = {c: (n + p) * (1 / (1 + np.exp(-score[c]))) * (1 - 1 / (1 + np.exp(-score[c]))) for c, n, p in table}
        gain = lambda cs: sum(g[c] for c in cs) ** 2 / (sum(h[c] for c in cs) + 1)

        def best(cs):
            options = [(gain([c for c in cs if values[n](c) <= t]) + gain([c for c in cs if values[n](c) > t])) for n in pii.FEATURES for t in sorted({values[n](c) for c in cs})[:-1]]
            return max(options, default=None)

        names = list(pii.FEATURES)
        sides = [[c for c in score if values[names[f]](c) <= cut], [c for c in score if values[names[f]](c) > cut]]
        assert gain(sides[0]) + gain(sides[1]) == pytest.approx(best(list(score)))
        for cs, (f2, cut2, a, b) in zip(sides, (low, high), strict=True):
            for part, leaf in (([c for c in cs if values[names[f2]](c) <= cut2], a), ([c for c in cs if values[names[f2]](c) > cut2], b)):
                if part:
                    assert leaf == pytest.approx(pii.SHRINK * sum(g[c] for c in part) / (sum(h[c] for c in part) + 1))
                for c in part:
                    score[c] += leaf
    column = spark.createDataFrame([(c,) for c in score], "c int").select("c", pii.score_column(F.col("c"), model).alias("s")).collect()
    assert {r.c: r.s for r in column} == pytest.approx(score)


# 6


def brute_lines(rows):
    seen, first, gone = [], {}, set()
    for i, t in rows:
        for p, line in enumerate((t or "").split("\n")):
            words = frozenset(line.encode().split())
            if not words:
                continue
            if line in first or any(9 * len(words & w) >= 4 * (len(words) + len(w)) for w in seen):
                gone.add((i, p))
            if line not in first:
                first[line] = (i, p)
                seen.append(words)
    return {i: None if t is None else "\n".join(x for p, x in enumerate(t.split("\n")) if (i, p) not in gone) for i, t in rows}


def brute_links(rows):
    first = {}
    for i, t in rows:
        for line in (t or "").split("\n"):
            if line.encode().split():
                first.setdefault(line, i)
    out = dict.fromkeys((i for i, _ in rows), 0)
    for (a, i), (b, j) in itertools.combinations(first.items(), 2):
        x, y = set(a.encode().split()), set(b.encode().split())
        if 5 * len(x & y) >= 4 * len(x | y):
            out[i] += 1
            out[j] += 1
    return out


def test_line_dedup(spark, odd, none):
    rng, lines, rows = random.Random(2), prose(60, 7, 25), []
    for i in range(120):
        own = []
        for _ in range(rng.randint(1, 5)):
            w = rng.choice(lines).split()
            if rng.random() < 0.6:
                w[rng.randrange(len(w))] = f"x{rng.randrange(50)}"
            own.append(" ".join(w))
        rows.append((i, "\n".join(own)))
    rows += [(500, None), (501, ""), (502, "\n \n"), (503, "a\n" * 3000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    found = line_dedup.dedup_lines(docs).collect()
    got = {r.doc_id: r.text for r in found}
    assert got == brute_lines(rows)
    assert {r.doc_id: r.text for r in line_dedup.rewrite_documents(docs).collect()} == got  # links for removal alone
    assert {r.doc_id: r.n_links for r in found} == brute_links(rows)
    assert line_dedup.dedup_lines(odd).count() == len(ODD) and line_dedup.dedup_lines(none).count() == 0
    assert line_dedup.rewrite_documents(odd).columns == odd.columns


def test_links_of_families_are_counted_not_listed(spark, monkeypatch):
    """Two families of near copies that are near each other, one apart and other lines: the same links and texts, few of them as pairs."""
    rng = random.Random(4)

    def family(words, n, most, others):
        for _ in range(n):
            own = list(words)
            for _ in range(rng.randint(0, most)):
                at, new = rng.randrange(len(own)), rng.choice(others)
                own[at : at + rng.randint(0, 1)] = [new] if rng.random() < 0.7 else []
            yield " ".join(own)

    base = [f"w{i}" for i in range(40)]
    lines = [*family(base, 150, 9, ["x1", "x2", "x3", "x4"]), *family([*base[:36], "q1", "q2", "q3", "q4"], 120, 7, ["x1", "x2", "x3"]), *family([f"v{i}" for i in range(22)], 90, 4, [f"y{i}" for i in range(300)]), *prose(40, 7, 25)]
    rng.shuffle(lines)
    rows = [(i, "\n".join(lines[3 * i : 3 * i + 3])) for i in range(len(lines) // 3)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    monkeypatch.setattr(line_dedup, "FAMILY", 16)
    got = line_dedup.dedup_lines(docs).collect()
    want = brute_links(rows)
    assert {r.doc_id: r.n_links for r in got} == want and {r.doc_id: r.text for r in got} == brute_lines(rows)
    _, links, sure = line_dedup.similar_lines(docs)
    assert sure is not None and links.count() < sum(want.values()) // 4  # each link counts for two lines


def test_prefix_rows_build_the_sets_once(spark, monkeypatch):
    """No filter that the joins ask for goes below the sets, where each of its columns would build them again."""
    plans, keep = [], line_dedup.stored
    monkeypatch.setattr(line_dedup, "stored", lambda df, name: plans.append(df._jdf.queryExecution().optimizedPlan().toString()) or keep(df, name))
    line_dedup.similar_lines(spark.createDataFrame([(i, t) for i, t in enumerate(prose(20, 7))], "doc_id long, text string"))
    filters = [x for p in plans for x in p.split("\n") if x.lstrip(" :+-").startswith("Filter")]
    assert filters and not any("array_distinct" in x for x in filters)


# 7


def test_bpe_equals_the_library(spark, odd, none):
    from tokenizers import Tokenizer

    library, own = Tokenizer.from_file(VOCAB), bpe.load(VOCAB)
    rng = random.Random(1)
    texts = [r[1] or "" for r in ODD] + ["a<|endoftext|>b", "I'll 'S 12 ½ ²", "   \n\t x", "a" * 3000] + ["".join(rng.choice("abehtinors  '.\n0ßü€🙂") for _ in range(200)) for _ in range(200)]
    for t in texts:
        want = library.encode(t, add_special_tokens=False).ids
        assert own.encode(t).tolist() == want
        assert own.decode(own.encode(t)) == library.decode(want, skip_special_tokens=False)
    got = bpe.encode_decode(odd, VOCAB).collect()
    assert sorted(r.decoded for r in got) == sorted(r[1] or "" for r in ODD)
    assert bpe.encode_decode(none, VOCAB).count() == 0


# 8


def test_language_id(spark, odd, none):
    rng = random.Random(3)
    words = {"en": ["the", "and", "ther", "ing"], "de": ["der", "ung", "schen", "und"], "fr": ["le", "eaux", "que", "ment"]}
    rows = [(i, " ".join(rng.choice(words[k]) for _ in range(30)), k) for i, k in enumerate(list(words) * 60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    trees = language_id.learn(docs, sample=40)
    got = language_id.identify(docs, trees).collect()
    assert all(r.lang_pred == rows[r.doc_id][2] for r in got)
    strange = {r.lang_pred for r in language_id.identify(odd.where("text is null or text = '' or doc_id = 10"), trees).collect()}
    assert strange == {"und"} and language_id.identify(odd, trees).count() == len(ODD)
    assert language_id.identify(odd, language_id.learn(none)).select("lang_pred").distinct().collect()[0][0] == "und"
    assert language_id.identify(none, trees).count() == 0


def brute_bits(texts, text):
    """Code length of ``text`` under the escapes, from counts of every context by a literal loop."""
    seen = [collections.Counter() for _ in range(4)]
    for t in texts:
        sym = bytes(3) + t
        for i in range(3, len(sym)):
            for o in range(4):
                seen[o][sym[i - o : i + 1]] += 1
    total, sym = 0.0, bytes(3) + text
    for i in range(3, len(sym)):
        for o in range(3, -2, -1):
            if o < 0:
                total += 8
                break
            here = {k: v for k, v in seen[o].items() if k[:-1] == sym[i - o : i]}
            n, k = sum(here.values()), len(here)
            if sym[i - o : i + 1] in here:
                total -= np.log2(here[sym[i - o : i + 1]] / (n + k))
                break
            if n:
                total -= np.log2(k / (n + k))
    return total


def test_language_id_equals_brute_force(spark):
    learnt = {"xx": ["abracadabra", "ñandú 你好"], "yy": ["cadabra dabra", "zebra Ä"]}
    rows = [(i, t, k) for i, (k, t) in enumerate((k, t) for k, ts in learnt.items() for t in ts)]
    trees = language_id.learn(spark.createDataFrame(rows, "doc_id long, text string, lang string"), held=9)
    asked = ["abba cadd", "ñ Ä zebra 你", "dabra" * 40, "Qx"]
    for r in language_id.identify(spark.createDataFrame(list(enumerate(asked)), "doc_id long, text string"), trees).collect():
        bits = np.array([brute_bits([t.encode() for t in learnt[k]], asked[r.doc_id].encode()) for k in ("xx", "yy")])
        assert trees.code_lengths(asked[r.doc_id].encode()) == pytest.approx(bits)
        assert r.lang_pred == ("xx", "yy")[int(np.argmin(bits))] and r.score == pytest.approx(1 / np.exp2(bits.min() - bits).sum())


# 9


def test_repeated_words():
    rng = random.Random(6)
    for _ in range(300):
        w = [rng.randrange(3) for _ in range(rng.randint(0, 40))]
        spans = collections.Counter(tuple(w[i : i + 8]) for i in range(len(w) - 7))
        want = len({j for i in range(len(w) - 7) if spans[tuple(w[i : i + 8])] > 1 for j in range(i, i + 8)})
        assert rule_ledger.repeated_words(np.array(w, dtype=np.int64)) == want


def test_ledger(spark, odd, none):
    rows = rule_ledger.apply_policy(rule_ledger.ledger(odd))
    got = rows.collect()
    assert len(got) == len(ODD)
    empty = next(r for r in got if r.doc_id == 2)
    assert (empty.n_words, empty.failures, empty.kept) == (0, 1, False)
    for r in rule_ledger.ablations(rows).collect():
        assert r.kept_without == sum((x.failures & rule_ledger.POLICIES[3] & ~(1 << r.bit)) == 0 for x in got)
    assert sum(r.n for r in rule_ledger.mask_histogram(rows).collect()) == len(ODD)
    assert rule_ledger.apply_policy(rule_ledger.ledger(none)).count() == 0


def test_rows_that_share_an_id_or_have_none_are_apart(spark):
    same, own = "alpha beta gamma delta", [f"only{i} here{i} once{i} said{i}" for i in range(4)]
    rows = [(1, same, "a"), (7, f"{same}\n{own[0]}", "a"), (7, f"{own[1]}\n{same} ", "b"), (None, f"{same}\n{own[2]}", "a"), (None, own[3], "b"), (None, own[3], "c")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    left = [r.text for r in line_dedup.rewrite_documents(docs).collect()]
    assert sorted(x for t in left for x in t.split("\n") if x.strip()) == sorted([same, *own])
    once = simhash_pigeonring.drop_near_duplicates(docs.where("doc_id is null"))
    assert sorted(r.text for r in once.collect()) == sorted([rows[3][1], own[3]])
    texts = spark.createDataFrame([(None if i % 2 else 5, "word " * (1 + 40 * i), "a") for i in range(6)], docs.schema)
    with_keys = keyed(texts, "doc_id")
    plan = {r["__row"]: r.copies for r in mixing.mix(with_keys, "__row").collect()}
    want = collections.Counter({r.text: plan[r["__row"]] for r in with_keys.collect() if plan[r["__row"]]})
    assert len(plan) == 6 and collections.Counter(r.text for r in mixing.repeat_documents(with_keys.drop("__row")).collect()) == want


# 10


def brute_print(t):
    w = t.encode().lower().split()
    sh = [b" ".join(w[i : i + 3]) for i in range(max(1, len(w) - 2))] if w else []
    h = [xxhash.xxh64_intdigest(s, 42) for s in sh]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h)) if h else 0


def test_simhash(spark, odd, none):
    rng, texts = random.Random(5), prose(40, 11, 80)
    for t in list(texts):
        for _ in range(4):
            w = t.split()
            w[rng.randrange(len(w))] = "changed"
            texts.append(" ".join(w))
    rows = [(i * 3, t) for i, t in enumerate(texts)] + [(r[0], r[1]) for r in ODD if r[0] is not None and r[0] != 6]
    prints = [brute_print(t or "") for _, t in rows]
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in itertools.combinations(range(len(rows)), 2):
        if (prints[a] ^ prints[b]).bit_count() <= 3:
            root[find(a)] = find(b)
    least = {}
    for i, (d, _) in enumerate(rows):
        least[find(i)] = min(d, least.get(find(i), d))
    want = sorted((d, f"{prints[i]:016x}", least[find(i)]) for i, (d, _) in enumerate(rows))
    got = simhash_pigeonring.simhash_groups(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted(map(tuple, got)) == want
    assert simhash_pigeonring.simhash_groups(odd).count() == len(ODD)
    assert simhash_pigeonring.simhash_groups(none).count() == 0


def test_ring_keys_find_every_close_pair(spark):
    rng, rows = random.Random(8), set()
    for _ in range(60):
        x = rng.getrandbits(64)
        for _ in range(6):
            y = x
            for b in rng.sample(range(64), rng.randint(0, 4)):
                y ^= 1 << b
            rows.add(y - (1 << 64) if y >> 63 else y)
    got = {tuple(r) for r in simhash_pigeonring.links(spark.createDataFrame([(x,) for x in rows], "fp long")).collect()}
    assert got == {(a, b) for a, b in itertools.combinations(sorted(rows), 2) if ((a ^ b) & ((1 << 64) - 1)).bit_count() <= 3}


def test_components_of_a_long_chain(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 101)], "a long, b long")
    got = {r.node: r.root for r in simhash_pigeonring.components(edges).collect()}
    assert got == {**{i: 0 for i in range(41)}, 100: 100, 101: 100}
