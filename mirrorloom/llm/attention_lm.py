"""Language-model scoring with a causal self-attention model trained in NumPy on subword ids.

Words, lower-cased, are encoded into subword ids of a public vocabulary; a document is its words' ids and one end id.
The probability of an id is that of its class, given the ids before it, times its share of the class:

* Classes.  The commonest ids have a class each, the others share classes of ids with similar neighbours (k-means).
* Shares come from the counts of all training documents, half a count added, so every id has a probability.
* The class is predicted from the log of smoothed counts after the previous id, plus a correction by one head of causal
  self-attention with relative positions and a tanh layer.
* Neighbours and counts after an id come from one table of all pairs of adjoining ids of all training documents.
* The correction is trained by Adam, first on windows of ``SAMPLE`` documents, then by shards over all windows of every
  training document; the weights of the shards are averaged.

A word's probability is the mean, weighted ``ATTENTION`` to the model, of the product over its ids and its unigram share
among all training words, however rare; a word that no training document has gets the share of an unseen word, so
the probabilities of all texts add up to no more than one.

Long documents are cut into overlapping windows: the first ``CONTEXT`` places of a window are context only, so each id is
scored exactly once, with masked attention over batches of windows.

What is counted over the corpus is every word of every training document.  The commonest words, a bounded table, go to
the workers; the others carry the model's probability of each of their places to a join with the counts, where their
mixture is finished.  Trained words of that join are rare by construction.
"""

from __future__ import annotations

import math
import pickle
from collections import Counter
from collections.abc import Iterator
from itertools import compress, repeat

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe import load
from .common import drop_stored, fold, stored, text_or_empty

#: Documents whose windows start the weights, in the order of a hash of the id; counts cover all documents.
SAMPLE = 2500
#: Documents of a shard of the training that follows, about; windows that are put in random order together, and windows of a piece of a text.
SHARD, MIXED, PIECE = 2500, 4096, 1024
#: Words that are looked up on the workers, at most.
HOT_WORDS = 120_000
WINDOW, CONTEXT = 32, 8
OWN, SHARED, ROWS = 60, 34, 3000
WIDTH, HIDDEN = 16, 32
ATTENTION = 0.5
STEPS, BATCH, RATE, PRIOR = 800, 64, 0.006, 20.0
#: Windows that are scored at once.
SCORED = 48
_FLUSH, _REMEMBERED = 400_000, 200_000
_LN10 = math.log(10)


# Counting.


def _count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counts: Counter = Counter()

    def out() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(list(counts), pa.binary()), pa.array(list(counts.values()), pa.int64())], names=["w", "n"])

    for batch in batches:
        for text in batch.column(0).to_pylist():
            counts.update(text.encode().lower().split())
            if len(counts) > _FLUSH:
                yield out()
                counts.clear()
    yield out()


def word_counts(docs: DataFrame, id_col: str, text_col: str, folds: int, held: int) -> tuple[DataFrame, int, int]:
    """(w, n) of all training words, the number of training tokens with one end per document, and of distinct ones."""
    train = docs.where(fold(id_col, folds) != held).select(text_or_empty(text_col).alias("t"))
    words = stored(train.mapInArrow(_count_words, "w binary, n long").groupBy("w").agg(F.sum("n").alias("n")), "lm-words")
    total, distinct = words.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count(F.lit(1))).first()
    documents = train.count()
    return words, total + documents, distinct + (documents > 0)


def hot_words(words: DataFrame, most: int = HOT_WORDS) -> tuple[dict[bytes, int], int]:
    """The commonest words by count, at most ``most``, and the count from which on all words are among them."""
    by = sorted(((r.n, r.k) for r in words.groupBy("n").agg(F.count(F.lit(1)).alias("k")).orderBy(F.col("n").desc()).limit(most).collect()), reverse=True)
    least, held = None, 0
    for n, k in by:
        if held + k > most:
            break
        least, held = n, held + k
    if least is None:
        return {}, 1 << 62
    table = words.where(F.col("n") >= least).toArrow()
    return dict(zip(table.column("w").to_pylist(), table.column("n").to_pylist(), strict=True)), least


class Encoder:
    """Subword ids of whole words; remembers recent ones in two tables of bounded size, the newer and the older."""

    def __init__(self, vocabulary: str):
        self.bpe = load(vocabulary)
        self.size = max(self.bpe.bytes_of) + 1
        # The merges of this vocabulary give ids in their order, so a merge by the id made is the merge by rank.
        plain = {t: i for i, t in self.bpe.bytes_of.items() if i not in self.bpe.added.values()}
        self.merged = tiktoken.Encoding("words", pat_str=r"[\s\S]+", mergeable_ranks=plain, special_tokens={})._core_bpe.encode_single_piece
        self.end = self.size - 1
        self.known: dict[bytes, bytes] = {}
        self.older: dict[bytes, bytes] = {}

    def word(self, w: bytes) -> bytes:
        got = self.known.get(w)
        if got is None:
            got = self.older.get(w) or np.array(self.merged(b" " + w), dtype="<i4").tobytes()
            if len(self.known) >= _REMEMBERED:  # words in use come over from the older table, the others go with it
                self.known, self.older = {}, self.known
            if len(w) <= 64:
                self.known[w] = got
        return got

    def document(self, words: list[bytes]) -> np.ndarray:
        return self.parts(words)[0]

    def parts(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the words and the end, and how many belong to each."""
        get, make = self.known.get, self.word
        each = [get(w) or make(w) for w in words]
        ids = np.frombuffer(b"".join(each), dtype="<i4")
        sizes = np.fromiter(map(len, each), dtype=np.int64, count=len(each)) // 4
        return np.append(ids, np.int32(self.end)), np.append(sizes, 1)


_ENCODERS: dict[str, Encoder] = {}


def encoder(vocabulary: str) -> Encoder:
    if vocabulary not in _ENCODERS:
        _ENCODERS[vocabulary] = Encoder(vocabulary)
    return _ENCODERS[vocabulary]


def subword_counts(words: DataFrame, vocabulary: str, documents: int) -> np.ndarray:
    """Count of every id over the training documents, from the distinct words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(vocabulary)
        total = np.zeros(own.size, dtype=np.int64)
        for batch in batches:
            for w, n in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                np.add.at(total, np.frombuffer(own.word(w), dtype="<i4"), n)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(total[at])], names=["id", "n"])

    own = encoder(vocabulary)
    out = np.zeros(own.size, dtype=np.float64)
    for r in words.select("w", "n").mapInArrow(run, "id int, n long").groupBy("id").agg(F.sum("n").alias("n")).collect():  # a row per id
        out[r.id] = r.n
    out[own.end] += documents
    return out


# The model.


def _buckets(counts: np.ndarray) -> np.ndarray:
    """Bucket of every id: its rank by count among the first ``ROWS``, and two for all others."""
    order = np.lexsort((np.arange(len(counts)), -counts))
    out = (ROWS + np.arange(len(counts)) % 2).astype(np.int32)
    out[order[:ROWS]] = np.arange(min(ROWS, len(order)))
    return out


class Pairs:
    """Counts of adjoining buckets (a, b), an end standing before each document, as arrays."""

    def __init__(self, a: np.ndarray, b: np.ndarray, n: np.ndarray):
        self.a, self.b, self.n = a, b, n

    @classmethod
    def of(cls, bucket: np.ndarray, documents: list[np.ndarray]) -> Pairs:
        code = np.concatenate([_codes(bucket, ids) for ids in documents] or [np.zeros(0, np.int64)])
        return cls(code // (ROWS + 2), code % (ROWS + 2), np.ones(len(code)))

    def neighbours(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(rank, neighbour, n): neighbours are the 199 commonest ids and all others, before and, from 200 on, after."""
        before, after = self.b < ROWS, self.a < ROWS
        return np.concatenate([self.b[before], self.a[after]]), np.concatenate([np.minimum(self.a, 199)[before], 200 + np.minimum(self.b, 199)[after]]), np.concatenate([self.n[before], self.n[after]])

    def after(self, cls: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(bucket, class that follows, n), with the class of each bucket."""
        return self.a, cls[self.b], self.n


class StoredPairs(Pairs):
    """The same of a table (a, b, n) with a row per pair; only its sums by neighbour or class come to the driver."""

    def __init__(self, table: DataFrame):
        self.table = table

    def _sums(self, rows: DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        got = rows.groupBy("x", "y").agg(F.sum("n").alias("n")).toArrow()
        return tuple(got.column(c).to_numpy() for c in ("x", "y", "n"))

    def neighbours(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        key = lambda c: F.least(F.col(c), F.lit(199))
        before = self.table.where(F.col("b") < ROWS).select(F.col("b").alias("x"), key("a").alias("y"), "n")
        return self._sums(before.unionByName(self.table.where(F.col("a") < ROWS).select(F.col("a").alias("x"), (key("b") + 200).alias("y"), "n")))

    def after(self, cls: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        of = F.split(F.lit(",".join(map(str, cls.tolist()))), ",").cast("array<int>")
        return self._sums(self.table.select(F.col("a").alias("x"), F.get(of, F.col("b")).alias("y"), "n"))


def _codes(bucket: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """The pairs of one document, its end standing before it, as numbers."""
    of = bucket[ids].astype(np.int64)
    return np.append(of[-1:], of[:-1]) * (ROWS + 2) + of


def pair_counts(train: DataFrame, bucket: np.ndarray, vocabulary: str) -> StoredPairs:
    """Pairs of all texts (column t): a table of fixed size in each task, summed over the tasks."""
    shared = train.sparkSession.sparkContext.broadcast(bucket)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mine, of = encoder(vocabulary), shared.value
        total, kept, held = np.zeros((ROWS + 2) ** 2, np.int32), [], 0

        def add() -> None:
            code, n = np.unique(np.concatenate(kept), return_counts=True)
            total[code] += n.astype(np.int32)

        def out() -> Iterator[pa.RecordBatch]:
            at = np.flatnonzero(total)
            for i in range(0, len(at), 1 << 17):
                code = at[i : i + (1 << 17)]
                yield pa.RecordBatch.from_arrays([pa.array(code.astype(np.int32)), pa.array(total[code].astype(np.int64))], names=["code", "n"])

        seen = 0
        for batch in batches:
            for text in batch.column(0).to_pylist():
                kept.append(_codes(of, mine.document(text.encode().lower().split())))
                held += len(kept[-1])
                if held > _FLUSH * 4:
                    add()
                    seen, kept, held = seen + held, [], 0
                    if seen > 1 << 29:  # well before a 32-bit count overflows
                        yield from out()
                        total[:], seen = 0, 0
        if kept:
            add()
        yield from out()

    each = train.mapInArrow(run, "code int, n long").groupBy("code").agg(F.sum("n").alias("n"))
    return StoredPairs(stored(each.select(F.floor(F.col("code") / (ROWS + 2)).cast("int").alias("a"), (F.col("code") % (ROWS + 2)).alias("b"), "n"), "lm-pairs"))


def _classes(counts: np.ndarray, pairs: Pairs, rng: np.random.Generator) -> np.ndarray:
    """Class of every id: ``OWN`` single ones, ``SHARED`` by k-means on the neighbours, and two for all others."""
    order = np.lexsort((np.arange(len(counts)), -counts))
    cls = np.where(np.arange(len(counts)) % 2 == 0, OWN + SHARED, OWN + SHARED + 1).astype(np.int32)
    cls[order[:OWN]] = np.arange(OWN)
    rest = order[OWN:ROWS]
    rest = rest[counts[rest] > 0]
    rank, key, n = pairs.neighbours()
    if not len(rest) or not len(n):
        return cls
    seen = np.zeros((ROWS, 400))
    np.add.at(seen, (rank, key), n)
    seen = seen[OWN : OWN + len(rest)]
    mass = seen.sum(axis=1)
    x = np.sqrt((seen + 0.02) / (mass + 8)[:, None])
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    weight = np.sqrt(mass + 1)
    centre = x[rng.choice(len(x), min(SHARED, len(x)), replace=False, p=weight / weight.sum())]
    for _ in range(12):
        near = np.argmax(x @ centre.T, axis=1)
        for k in range(len(centre)):
            if (near == k).any():
                centre[k] = (x[near == k] * weight[near == k][:, None]).sum(axis=0)
        centre /= np.linalg.norm(centre, axis=1, keepdims=True)
    cls[rest] = OWN + np.argmax(x @ centre.T, axis=1)
    return cls


def windows(lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(document, first place, first scored place in the window) of the windows of documents of given lengths."""
    step = WINDOW - CONTEXT
    n = np.maximum(1, -(-(lengths - CONTEXT) // step))
    doc = np.repeat(np.arange(len(lengths)), n)
    k = np.arange(len(doc)) - np.repeat(np.cumsum(n) - n, n)
    return doc, k * step, np.where(k == 0, 0, CONTEXT)


def _along(x: np.ndarray, w: np.ndarray) -> np.ndarray:
    """``x @ w`` as one product of two matrices, not one for each window."""
    return (x.reshape(-1, x.shape[-1]) @ w).reshape(*x.shape[:-1], w.shape[-1])


class Model:
    def __init__(self, counts: np.ndarray, pairs: Pairs | list[np.ndarray], seed: int = 5):
        """From the count of every id and the pairs of adjoining ones, or the documents that hold them."""
        rng = np.random.default_rng(seed)
        if isinstance(pairs, list):
            pairs = Pairs.of(_buckets(counts), pairs)
        self.cls = _classes(counts, pairs, rng)
        self.k = OWN + SHARED + 2
        size = np.bincount(self.cls, minlength=self.k)
        mass = np.bincount(self.cls, weights=counts, minlength=self.k)
        self.share = np.log((counts + 0.5) / (mass + 0.5 * size)[self.cls]).astype(np.float32)
        order = np.lexsort((np.arange(len(counts)), -counts))
        self.row = (ROWS + self.cls).astype(np.int32)
        self.row[order[:ROWS]] = np.arange(ROWS)
        rows = ROWS + self.k
        prior = (mass + 1) / (mass + 1).sum()
        after = np.zeros((rows, self.k))
        row_of = np.append(np.arange(ROWS), [ROWS + OWN + SHARED, ROWS + OWN + SHARED + 1])
        class_of = np.full(ROWS + 2, OWN + SHARED)
        class_of[: len(order[:ROWS])], class_of[ROWS + 1] = self.cls[order[:ROWS]], OWN + SHARED + 1
        bucket, follows, n_pairs = pairs.after(class_of)
        np.add.at(after, (row_of[bucket], follows), n_pairs)
        self.after = np.log((after + PRIOR * prior) / (after.sum(axis=1, keepdims=True) + PRIOR)).astype(np.float32)
        n = lambda *shape: (rng.standard_normal(shape) / math.sqrt(shape[0])).astype(np.float32)
        self.p = {"e": (rng.standard_normal((rows, WIDTH)) * 0.3).astype(np.float32), "q": n(WIDTH, WIDTH), "k": n(WIDTH, WIDTH), "v": n(WIDTH, WIDTH), "r": np.zeros(WINDOW, np.float32), "a": n(WIDTH, HIDDEN), "b": n(WIDTH, HIDDEN), "c": np.zeros(HIDDEN, np.float32), "o": n(HIDDEN, self.k) * np.float32(0.1), "d": np.zeros(self.k, np.float32)}
        t = np.arange(WINDOW)
        self.far = np.maximum(t[:, None] - t[None, :], 0)
        self.causal = (t[:, None] >= t[None, :]).astype(np.float32)
        self.scored_by: dict[str, np.ndarray] | None = None  # tables for scoring, made after training

    def attend(self, rows: np.ndarray, keep: bool = True) -> tuple:
        """rows: (windows, WINDOW) of input rows.  Hidden states and, with ``keep``, what backpropagation needs."""
        p = self.p
        e = p["e"].take(rows, axis=0)
        q, k, v = (_along(e, p[n]) for n in "qkv")
        s = q @ k.transpose(0, 2, 1)
        s *= np.float32(1 / math.sqrt(WIDTH))
        s += p["r"][self.far]
        w = np.exp(np.minimum(s, np.float32(60), out=s), out=s)
        w *= self.causal
        total = w @ np.ones((WINDOW, 1), np.float32)
        if not keep:
            return (np.tanh(_along(e, p["a"]) + _along((w @ v) / total, p["b"]) + p["c"]),)
        w /= total
        m = w @ v
        h = _along(e, p["a"])
        h += _along(m, p["b"])
        h += p["c"]
        return np.tanh(h, out=h), e, q, k, v, w, m

    def train(self, sample: list[np.ndarray], seed: int = 6, steps: int = STEPS) -> Model:
        if not sample:
            return self
        rng, p = np.random.default_rng(seed), self.p
        self.scored_by = None
        lengths = np.array([len(x) for x in sample])
        ends = np.cumsum(lengths)
        flat = np.concatenate(sample)
        before = np.concatenate([[self._end(sample)], flat[:-1]])
        doc, first, skip = windows(lengths)
        base = (ends - lengths)[doc] + first
        left = lengths[doc] - first
        moments = self.moments()
        for step in range(1, steps + 1):
            pick = rng.integers(0, len(doc), BATCH)
            at = np.minimum(base[pick][:, None] + np.arange(WINDOW), len(flat) - 1)
            ok = (np.arange(WINDOW) < left[pick][:, None]) & (np.arange(WINDOW) >= skip[pick][:, None])
            self.learn(self.row[before[at]], self.cls[flat[at]], ok, moments, step, RATE * min(1.0, step / 50) * (1 - 0.9 * step / steps))
        return self

    def moments(self) -> tuple[dict, dict]:
        return tuple({n: np.zeros_like(x) for n, x in self.p.items()} for _ in range(2))

    def learn(self, rows: np.ndarray, target: np.ndarray, ok: np.ndarray, moments: tuple[dict, dict], step: int, rate: float) -> None:
        """One step of Adam on windows of input rows and target classes, at the places that ``ok`` marks."""
        p, (m1, m2) = self.p, moments
        scale = np.float32(1 / math.sqrt(WIDTH))
        h, e, q, k, v, w, mm = self.attend(rows)
        flat2 = lambda x: x.reshape(-1, x.shape[-1])
        at = np.flatnonzero(ok)  # the gradient of all other places is zero
        some, h2 = np.arange(len(at)), flat2(h).take(at, axis=0)
        g = h2 @ p["o"]
        g += p["d"]
        g += self.after.take(rows.ravel().take(at), axis=0)
        g -= g.max(axis=1, keepdims=True)
        np.exp(g, out=g)
        g /= g @ np.ones((self.k, 1), np.float32)
        g[some, target.ravel().take(at)] -= 1
        g *= np.float32(1 / max(1, len(at)))
        d = {"o": h2.T @ g, "d": np.ones(len(at), np.float32) @ g}
        gh = np.zeros_like(h)
        flat2(gh)[at] = (g @ p["o"].T) * (1 - h2 * h2)
        d |= {"a": flat2(e).T @ flat2(gh), "b": flat2(mm).T @ flat2(gh), "c": np.ones(rows.size, np.float32) @ flat2(gh)}
        gm = _along(gh, p["b"].T)
        gs = gm @ v.transpose(0, 2, 1)
        gs -= (gm * mm) @ np.ones((WIDTH, 1), np.float32)  # the sum of gs * w over a place's keys, since mm is w @ v
        gs *= w
        gv = w.transpose(0, 2, 1) @ gm
        gq, gk = gs @ k, gs.transpose(0, 2, 1) @ q
        gq *= scale
        gk *= scale
        d |= {"q": flat2(e).T @ flat2(gq), "k": flat2(e).T @ flat2(gk), "v": flat2(e).T @ flat2(gv)}
        d["r"] = np.bincount(self.far[self.causal > 0], weights=gs.sum(axis=0)[self.causal > 0], minlength=WINDOW).astype(np.float32)
        ge = _along(gh, p["a"].T)
        for x, n in ((gq, "q"), (gk, "k"), (gv, "v")):
            ge += _along(x, p[n].T)
        cells = rows.reshape(-1, 1) * WIDTH + np.arange(WIDTH)
        d["e"] = np.bincount(cells.ravel(), weights=ge.ravel(), minlength=p["e"].size).astype(np.float32).reshape(p["e"].shape)
        first, second = np.float32(rate / (1 - 0.9**step)), np.float32(1 / math.sqrt(1 - 0.99**step))
        for name, x in d.items():
            a, b = m1[name], m2[name]
            a *= np.float32(0.9)
            a += np.float32(0.1) * x
            b *= np.float32(0.99)
            x *= x
            x *= np.float32(0.01)
            b += x
            by = np.sqrt(b, out=x)
            by *= second
            by += np.float32(1e-8)
            np.divide(a, by, out=by)
            by *= first
            p[name] -= by

    @staticmethod
    def _end(sample: list[np.ndarray]) -> int:
        return int(sample[0][-1])

    def score(self, documents: list[np.ndarray]) -> np.ndarray:
        """Natural log probability of every id of the documents, one after the other, each id scored once."""
        lengths = np.array([len(x) for x in documents])
        ends = np.cumsum(lengths)
        flat = np.concatenate(documents)
        rows = self.row[np.concatenate([[flat[-1]], flat[:-1]])]  # before a document stands the end of another
        target = self.cls[flat]
        doc, first, skip = windows(lengths)
        base, left = (ends - lengths)[doc] + first, lengths[doc] - first
        total = self.share[flat].astype(np.float64)
        t = self.scored_by = self.scored_by or self.tables()
        for start in (0, CONTEXT):  # the places before it are context only, so no query is made there
            of = np.flatnonzero(skip == start)
            for a in range(0, len(of), SCORED):  # bounded memory however long the texts are, and small enough for a core's cache
                own = of[a : a + SCORED]
                at = np.minimum(base[own][:, None] + np.arange(WINDOW), len(flat) - 1)
                ok = np.arange(start, WINDOW) < left[own][:, None]
                places = at[:, start:][ok]
                h = self._hidden(t, rows[at], start)[ok]
                logit = h @ self.p["o"]
                logit += t["bias"].take(rows[places], axis=0)
                got = logit[np.arange(len(places)), target[places]]
                np.exp(logit, out=logit)
                total[places] += got - np.log(logit @ t["ones"])
        return total

    def tables(self) -> dict[str, np.ndarray]:
        """What depends on an input row alone: its query, key, value with a one, part of the hidden layer, and bias."""
        p = self.p
        e = p["e"]
        far = p["r"][self.far] + np.where(self.causal > 0, np.float32(0), np.float32(-1e4))  # exp() of it is 0
        value = np.concatenate([e @ p["v"], np.ones((len(e), 1), np.float32)], axis=1)
        q, k = e @ p["q"] * np.float32(1 / math.sqrt(WIDTH)), e @ p["k"]
        small = np.linalg.norm(q, axis=1).max() * np.linalg.norm(k, axis=1).max() + np.abs(p["r"]).max() < 60  # no weight needs the limit
        return {"q": q, "k": k, "small": small, "v": value, "h": e @ p["a"] + p["c"], "far": far, "bias": self.after + p["d"], "ones": np.ones(self.k, np.float32)}

    def _hidden(self, t: dict[str, np.ndarray], rows: np.ndarray, start: int) -> np.ndarray:
        """Hidden states at the places from ``start`` on, as :meth:`attend` gives them."""
        asked = rows[:, start:]
        s = t["q"].take(asked, axis=0) @ t["k"].take(rows, axis=0).transpose(0, 2, 1)
        s += t["far"][start:]
        w = np.exp(s if t["small"] else np.minimum(s, np.float32(60), out=s), out=s)
        m = w @ t["v"].take(rows, axis=0)  # the last column is the sum of the weights
        h = (m[:, :, :WIDTH] / m[:, :, WIDTH:]) @ self.p["b"]
        h += t["h"].take(asked, axis=0)
        return np.tanh(h, out=h)


def by_words(ids: np.ndarray, each: np.ndarray) -> np.ndarray:
    """The model's natural log probability of each word from those of its ids, ``ids`` per word."""
    return np.add.reduceat(each, np.cumsum(ids) - ids)


def mixed(model: np.ndarray, shares: np.ndarray) -> np.ndarray:
    """Natural log probability of each word: the model's mixed with its unigram share."""
    return np.logaddexp(model + math.log(ATTENTION), shares + math.log(1 - ATTENTION))


def train(docs: DataFrame, words: DataFrame, n_documents: int, vocabulary: str, id_col: str, text_col: str, folds: int, held: int, sample: int = SAMPLE) -> Model:
    counts = subword_counts(words, vocabulary, n_documents)
    own = encoder(vocabulary)
    chosen = docs.where(fold(id_col, folds) != held).select(F.xxhash64(F.col(id_col).cast("string")).alias("h"), text_or_empty(text_col).alias("t"))
    # a threshold on the hash passes about twice the sample, so that only those texts are ordered
    limit = min((1 << 63) - 1, int(min(1.0, 2.0 * (sample + 50) / max(1, n_documents)) * float(1 << 64)) - (1 << 63))

    def encoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mine = encoder(vocabulary)
        for batch in batches:
            ids = [mine.document(t.encode().lower().split()) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([x.tobytes() for x in ids], pa.binary())], names=["h", "ids"])

    pairs = pair_counts(chosen.select("t"), _buckets(counts), vocabulary)
    near = chosen.where(F.col("h") <= limit).mapInArrow(encoded, "h long, ids binary").orderBy("h", "ids").limit(sample)
    rows = [np.frombuffer(r.ids, dtype="<i4") for r in near.toLocalIterator()]
    model = Model(counts, pairs).train(rows)
    drop_stored(pairs.table)
    return train_all(model, chosen, n_documents, vocabulary)


def train_windows(model: Model, train: DataFrame, vocabulary: str) -> DataFrame:
    """(h, first, rows, target) of every document (columns h, t), in pieces of ``PIECE`` windows that together hold every place once.

    ``rows`` and ``target`` are the input rows and classes of the piece's places, windows are cut by :func:`cut` where they are learned
    from, so that nothing is sent twice but a piece's context.
    """
    shared = train.sparkSession.sparkContext.broadcast((model.row, model.cls))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mine, (row, cls) = encoder(vocabulary), shared.value
        step = PIECE * (WINDOW - CONTEXT)
        for batch in batches:
            out: list[tuple] = []
            for h, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                ids = mine.document(text.encode().lower().split())
                before = row[np.append(ids[-1:], ids[:-1])].astype("<i2")  # an end stands before the text
                target = cls[ids].astype(np.uint8)
                for at in range(0, max(1, len(ids) - CONTEXT), step):
                    part = slice(at, at + step + CONTEXT)
                    out.append((h, at == 0, before[part].tobytes(), target[part].tobytes()))
            columns = zip(*out, strict=True) if out else [()] * 4
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.bool_(), pa.binary(), pa.binary()), strict=True)], names=["h", "first", "rows", "target"])

    return train.mapInArrow(run, "h long, first boolean, rows binary, target binary").withColumn("h", F.xxhash64("h", "rows", "target"))  # copies go apart


def cut(first: list[bool], rows: list[bytes], target: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(rows, target, ok) of the windows of pieces of texts; ``ok`` marks each place once, but for the context of a piece that is not its text's first."""
    flat, classes = np.frombuffer(b"".join(rows), "<i2"), np.frombuffer(b"".join(target), np.uint8)
    lengths = np.array([len(x) for x in target])
    doc, at, skip = windows(lengths)
    skip = np.where((at > 0) | np.array(first)[doc], skip, CONTEXT)
    place = np.arange(WINDOW)
    ok = (place < (lengths[doc] - at)[:, None]) & (place >= skip[:, None])
    where = np.minimum(((np.cumsum(lengths) - lengths)[doc] + at)[:, None] + place, len(flat) - 1)
    return flat[where], classes[where], ok


def train_all(model: Model, train: DataFrame, n_documents: int, vocabulary: str) -> Model:
    """Goes on from ``model`` by shards over all windows of all documents, at the rate at which it ended, and averages them."""
    shards = max(1, n_documents // SHARD)
    spark = train.sparkSession
    shared = spark.sparkContext.broadcast(pickle.dumps(model))
    tasks = min(shards, max(1, int(spark.conf.get("spark.sql.shuffle.partitions"))))
    names = sorted(model.p)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, weight, now, own, moments, step, seen, mix = None, 0, None, None, None, 0, 0, None
        pieces: list[tuple] = []
        held, waiting = 0, None  # places of the pieces; windows that did not fill a batch

        def learn(last: bool) -> None:
            """Cuts the pieces and learns from their windows in a random order, by whole batches unless it is the last time."""
            nonlocal step, seen, held, waiting
            if pieces:
                got = cut(*map(list, zip(*pieces, strict=True)))
                waiting = got if waiting is None else tuple(np.concatenate(x) for x in zip(waiting, got, strict=True))
                pieces.clear()
                held = 0
            if waiting is None:
                return
            order = mix.permutation(len(waiting[0]))
            upto = len(order) if last else len(order) // BATCH * BATCH
            for at in range(0, upto, BATCH):
                rows, target, ok = (x[order[at : min(at + BATCH, upto)]] for x in waiting)
                step, seen = step + 1, seen + len(rows)
                own.learn(rows.astype(np.int64), target.astype(np.int64), ok, moments, step, RATE * 0.1)
            waiting = None if upto == len(order) else tuple(x[order[upto:]] for x in waiting)

        def close() -> None:
            nonlocal total, weight
            if own is not None:
                learn(True)
                flat = np.concatenate([own.p[n].ravel() for n in names]).astype(np.float64) * seen
                total, weight = flat if total is None else total + flat, weight + seen

        for batch in batches:
            for shard, *piece in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if shard != now:
                    close()
                    now, own, step, seen, mix = shard, pickle.loads(shared.value), 0, 0, np.random.default_rng(shard)
                    moments = own.moments()
                pieces.append(piece)
                held += len(piece[2])
                if held >= MIXED * (WINDOW - CONTEXT):
                    learn(False)
        close()
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary()), pa.array([weight], pa.int64())], names=["p", "n"])

    dealt = train_windows(model, train, vocabulary).withColumn("shard", F.pmod("h", F.lit(shards)).cast("int")).repartition(tasks, "shard").sortWithinPartitions("shard", "h", "first", "rows", "target")
    got = stored(dealt.select("shard", "first", "rows", "target").mapInArrow(run, "p binary, n long"), "lm-weights")  # a row a task
    total, weight = 0.0, 0
    for r in got.toLocalIterator():
        total, weight = total + np.frombuffer(r.p, dtype=np.float64), weight + r.n
    if weight:
        at = 0
        for n in names:
            size = model.p[n].size
            model.p[n] = (total[at : at + size] / weight).reshape(model.p[n].shape).astype(np.float32)
            at += size
    model.scored_by = None
    return model


# Scoring.


def score(docs: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text", folds: int = 5, held: int = 1, hot: int = HOT_WORDS, sample: int = SAMPLE) -> DataFrame:
    """id, held_out, n_tokens, n_known, train_tokens, base_score, score of every document.

    base_score is the unigram log10 probability of the words and one end under the training counts, half a count added.
    Defined cases: a null or empty text is its end token alone; without training documents all counts are 0 and the
    model knows only the vocabulary; ids pass through, null or repeated; an empty table gives no rows; other columns
    of ``docs`` are not read.
    """
    words, tokens, distinct = word_counts(docs, id_col, text_col, folds, held)
    n_documents = tokens - (words.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0])
    model = train(docs, words, n_documents, vocabulary, id_col, text_col, folds, held, sample)
    common, least = hot_words(words, hot)
    under = math.log10(tokens + 0.5 * (distinct + 1))
    shared = docs.sparkSession.sparkContext.broadcast(pickle.dumps((model, common)))  # HOT_WORDS entries, fixed model sizes
    end_score = math.log10(n_documents + 0.5) - under

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, known = pickle.loads(shared.value)
        value = {w: math.log10(n + 0.5) - under for w, n in known.items()}
        mine = encoder(vocabulary)
        for whole in batches:
            for at in range(0, whole.num_rows, 64):
                batch = whole.slice(at, 64)
                ids, sizes, shares, base, n_tokens, n_known, rare = [], [], [], [], [], [], []
                for text in batch.column(2).to_pylist():
                    tokens_ = text.encode().lower().split()
                    own_ids, own_sizes = mine.parts(tokens_)
                    ids.append(own_ids)
                    sizes.append(own_sizes)
                    got = np.fromiter(map(value.get, tokens_, repeat(math.nan)), dtype=np.float64, count=len(tokens_))
                    outside = np.isnan(got)
                    base.append(float(got[~outside].sum()) + end_score)
                    shares.append(np.append(got, end_score))
                    n_tokens.append(len(tokens_) + 1)
                    n_known.append(len(tokens_) - int(outside.sum()) + (n_documents > 0))
                    rare.append(list(compress(tokens_, outside.tolist())))
                model = by_words(np.concatenate(sizes), own.score(ids))
                share = np.concatenate(shares)
                open_ = np.isnan(share)  # their counts come with the join
                words_ = np.where(open_, 0.0, mixed(model, share * _LN10) / _LN10)
                starts = np.concatenate([[0], np.cumsum(n_tokens)[:-1]])
                cuts = pa.array(np.cumsum([0, *map(len, rare)]).astype(np.int32))
                flat = pa.StructArray.from_arrays([pa.array([w for r in rare for w in r], pa.binary()), pa.array(model[open_], pa.float64())], names=["w", "m"])
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(n_tokens, pa.int64()), pa.array(n_known, pa.int64()), pa.array(base, pa.float64()), pa.array(np.add.reduceat(words_, starts), pa.float64()), pa.ListArray.from_arrays(cuts, flat)], names=["id", "held_out", "n_tokens", "n_known", "base", "score", "rare"])

    base = docs.select(F.col(id_col).alias("id"), (fold(id_col, folds) == held).alias("held_out"), text_or_empty(text_col).alias("t"))
    schema = f"id {base.schema['id'].dataType.simpleString()}, held_out boolean, n_tokens long, n_known long, base double, score double, rare array<struct<w:binary,m:double>>"
    rows = stored(base.mapInArrow(run, schema).withColumn("key", F.monotonically_increasing_id()), "lm-rows")
    rare = rows.select("key", F.explode("rare").alias("r")).select("key", F.col("r.w").alias("w"), F.col("r.m").alias("m"))
    seen = rare.join(words.where(F.col("n") < least), "w", "left")
    share = F.log10(F.coalesce("n", F.lit(0)) + F.lit(0.5)) - under
    x, y = F.col("m") + math.log(ATTENTION), F.col("share") * _LN10 + math.log(1 - ATTENTION)
    word = (F.greatest(x, y) + F.log1p(F.exp(-F.abs(x - y)))) / _LN10  # as in mixed()
    part = seen.select("key", "n", "m", share.alias("share")).groupBy("key").agg(F.sum("share").alias("more"), F.sum(word).alias("words"), F.count_if(F.col("n") > 0).alias("known"))
    both = rows.drop("rare").join(part, "key", "left")
    return both.select(
        F.col("id").alias(id_col), "held_out", "n_tokens", (F.col("n_known") + F.coalesce("known", F.lit(0))).alias("n_known"), F.lit(tokens).cast("long").alias("train_tokens"),
        (F.col("base") + F.coalesce("more", F.lit(0.0))).alias("base_score"), (F.col("score") + F.coalesce("words", F.lit(0.0))).alias("score"),
    )
