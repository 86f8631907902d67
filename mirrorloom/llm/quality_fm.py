"""Quality classifier: a factorisation machine over hashed words, structure statistics and metadata.

A document's score is ``sigmoid(w0 + sum w_i x_i + sum_{i<j} <v_i, v_j> x_i x_j)``.  The pairwise sum is taken in linear
time as half of ``(sum v_i x_i)^2 - sum (v_i x_i)^2`` per factor.  Features are the counts of hashed words, scaled to
unit length, one indicator per binned structure statistic of the text, and one for the binned ``n_chars`` column.
Neither labels nor language, source or id are read for a score.

Fitting (Adagrad on the logistic loss, on the driver) takes at most ``SAMPLE`` labelled rows outside the held-out fold,
in the order of a hash of the id; their features are made on the executors.  Scoring is one narrow pass.
"""

from __future__ import annotations

import pickle
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import fold, small_batches, text_or_empty

#: Labelled rows at most that fitting reads.
SAMPLE = 12_000
WORD_BITS, FACTORS, EPOCHS, BATCH, RATE, DECAY = 15, 8, 10, 128, 0.12, 1e-5
#: From this score on a document is kept.
THRESHOLD = 0.3
#: Structure statistics, each with so many bins.
STATISTICS = ["words", "word_bytes", "symbols", "upper", "digits", "distinct", "line_words", "marks", "bars", "repeats", "echoes", "n_chars"]
BINS = 16
WIDTH = (1 << WORD_BITS) + BINS * len(STATISTICS)
_REMEMBERED = 300_000
_SYMBOLS = np.frombuffer(b"#*$%&|<>", dtype=np.uint8)
_MARKS = np.frombuffer(b"!?.,;:", dtype=np.uint8)


class _Buckets(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) >= _REMEMBERED:
            self.clear()
        self[word] = at = zlib.crc32(word) & ((1 << WORD_BITS) - 1)
        return at


_BUCKETS = _Buckets()


def _bin(x: float) -> int:
    return int(min(BINS - 1, max(0.0, x)))


def features(texts: list[str], n_chars: list[int | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sparse rows: (end of each row, feature numbers, values)."""
    keys, extra = [], []
    for i, (text, chars) in enumerate(zip(texts, n_chars, strict=True)):
        raw = text.encode()
        words = raw.split()
        n = len(words)
        ids = np.fromiter(map(_BUCKETS.__getitem__, words), dtype=np.int64, count=n)
        keys.append(ids + (i << WORD_BITS))
        hist = np.bincount(np.frombuffer(raw, dtype=np.uint8), minlength=256)
        upper, lower, digits = (int(hist[a:b].sum()) for a, b in ((65, 91), (97, 123), (48, 58)))
        triples = ids[:-2] * 1_000_003 + ids[1:-1] * 8191 + ids[2:] if n > 2 else ids[:0]
        solid, m = max(1, len(raw) - int(hist[9:14].sum()) - int(hist[32])), max(1, n)
        stats = [
            np.log2(n + 1), solid / m, 4 * hist[_SYMBOLS].sum() / m, 15 * upper / max(1, upper + lower), 30 * digits / solid,
            15 * len(set(words)) / m, 2 * np.log2(1 + m / (1 + int(hist[10]))), 8 * hist[_MARKS].sum() / m, 15 * int(hist[124]) / m,
            24 * (1 - len(np.unique(triples)) / max(1, len(triples))) if n > 2 else 0,
            24 * int((ids[1:] == ids[:-1]).sum()) / m,
            0 if chars is None or chars < 0 else 1 + np.log2(chars + 1) * 0.8,
        ]
        extra.append([_bin(float(s)) for s in stats])
    rows = len(texts)
    key, count = np.unique(np.concatenate(keys) if keys else np.zeros(0, dtype=np.int64), return_counts=True)
    row, word = key >> WORD_BITS, key & ((1 << WORD_BITS) - 1)
    length = np.sqrt(np.bincount(row, weights=count.astype(float) ** 2, minlength=rows))
    fixed = np.array(extra, dtype=np.int64).reshape(rows, len(STATISTICS)) + (1 << WORD_BITS) + BINS * np.arange(len(STATISTICS))
    all_row = np.concatenate([row, np.repeat(np.arange(rows), len(STATISTICS))])
    order = np.argsort(all_row, kind="stable")
    feature = np.concatenate([word, fixed.ravel()])[order]
    value = np.concatenate([count / length[row] if len(row) else np.zeros(0), np.full(fixed.size, 0.5)])[order]
    return np.cumsum(np.bincount(all_row, minlength=rows)), feature.astype(np.int32), value.astype(np.float32)


class Machine:
    def __init__(self, seed: int = 7):
        rng = np.random.default_rng(seed)
        self.bias = 0.0
        self.linear = np.zeros(WIDTH, dtype=np.float32)
        self.factors = (rng.standard_normal((WIDTH, FACTORS)) * 0.02).astype(np.float32)

    def raw(self, ends: np.ndarray, feature: np.ndarray, value: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Scores before the sigmoid, the factor sums by row, and the scaled factors."""
        starts = np.concatenate([[0], ends[:-1]]).astype(np.int64)
        vx = self.factors[feature] * value[:, None]
        sums = np.add.reduceat(vx, starts, axis=0)  # every row has its statistics, so none is empty
        pairs = 0.5 * ((sums**2).sum(axis=1) - np.add.reduceat((vx**2).sum(axis=1), starts))
        return self.bias + np.add.reduceat(self.linear[feature] * value, starts) + pairs, sums, vx

    def score(self, ends: np.ndarray, feature: np.ndarray, value: np.ndarray) -> np.ndarray:
        if not len(ends):
            return np.zeros(0)
        return 1.0 / (1.0 + np.exp(-np.clip(self.raw(ends, feature, value)[0].astype(np.float64), -40, 40)))

    def fit(self, ends: np.ndarray, feature: np.ndarray, value: np.ndarray, label: np.ndarray, epochs: int = EPOCHS, seed: int = 11) -> Machine:
        rng = np.random.default_rng(seed)
        n = len(ends)
        if not n:
            return self
        starts = np.concatenate([[0], ends[:-1]]).astype(np.int64)
        share = float(np.clip(label.mean(), 0.01, 0.99))
        self.bias = float(np.log(share / (1 - share)))
        g_lin, g_fac, g_bias = np.full(WIDTH, 1e-3, np.float32), np.full((WIDTH, FACTORS), 1e-3, np.float32), 1e-3
        for _ in range(epochs):
            for pick in np.array_split(rng.permutation(n), max(1, n // BATCH)):
                sizes = ends[pick] - starts[pick]
                own_ends = np.cumsum(sizes)
                at = np.repeat(starts[pick] - np.concatenate([[0], own_ends[:-1]]), sizes) + np.arange(own_ends[-1])
                f, x = feature[at], value[at]
                y, sums, vx = self.raw(own_ends, f, x)
                gap = (1.0 / (1.0 + np.exp(-np.clip(y, -40, 40))) - label[pick]) / len(pick)
                per = np.repeat(gap, sizes).astype(np.float32)
                used, where = np.unique(f, return_inverse=True)
                d_lin = np.bincount(where, weights=per * x).astype(np.float32) + DECAY * self.linear[used]
                d_fac = np.zeros((len(used), FACTORS), np.float32)
                np.add.at(d_fac, where, (per * x)[:, None] * (np.repeat(sums, sizes, axis=0) - vx))
                d_fac += DECAY * self.factors[used]
                g_lin[used] += d_lin**2
                g_fac[used] += d_fac**2
                g_bias += float(gap.sum()) ** 2
                self.linear[used] -= RATE * d_lin / np.sqrt(g_lin[used])
                self.factors[used] -= RATE * 0.3 * d_fac / np.sqrt(g_fac[used])
                self.bias -= RATE * float(gap.sum()) / np.sqrt(g_bias)
        return self


def _featured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for whole in batches:
        for at in range(0, whole.num_rows, 512):
            batch = whole.slice(at, 512)
            ends, feature, value = features(batch.column(1).to_pylist(), batch.column(2).to_pylist())
            cut = pa.array(np.concatenate([[0], ends]).astype(np.int32))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(cut, pa.array(feature)), pa.ListArray.from_arrays(cut, pa.array(value))], names=["label", "feature", "value"])


def _inputs(docs: DataFrame, text_col: str, chars_col: str | None) -> list:
    chars = F.col(chars_col).cast("long") if chars_col and chars_col in docs.columns else F.lit(None).cast("long")
    return [text_or_empty(text_col).alias("text"), chars.alias("chars")]


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", chars_col: str | None = "n_chars", folds: int = 5, held: int = 0, sample: int = SAMPLE) -> Machine:
    """A machine from at most ``sample`` labelled rows outside the held-out fold; untrained if there is none.

    Of several labels of one id the smallest counts, so a document is learnt once however often it is labelled.
    """
    usable = labels.where((fold(id_col, folds) != held) & F.col(label_col).isNotNull() & F.col(id_col).isNotNull())
    one = usable.groupBy(F.col(id_col).alias("id")).agg(F.min(F.col(label_col).cast("int")).alias("label"))
    chosen = one.orderBy(F.xxhash64(F.col("id").cast("string")), "id").limit(sample)
    rows = docs.select(F.col(id_col).alias("id"), *_inputs(docs, text_col, chars_col)).join(F.broadcast(chosen), "id")  # sample rows at most
    got = rows.select("label", "text", "chars").mapInArrow(_featured, "label int, feature array<int>, value array<float>").toArrow()
    if not got.num_rows:
        return Machine()
    got = got.combine_chunks()
    label, feature, value = (got.column(i).combine_chunks() for i in range(3))
    label = label.to_numpy(zero_copy_only=False)
    sizes = np.diff(feature.offsets.to_numpy())
    f, v = feature.flatten().to_numpy(), value.flatten().to_numpy()
    order = np.lexsort((np.add.reduceat(f.astype(np.int64) * 31, np.concatenate([[0], np.cumsum(sizes)[:-1]])), label))  # rows come in any order; reruns agree
    starts = np.concatenate([[0], np.cumsum(sizes)[:-1]])
    ends = np.cumsum(sizes[order])
    at = np.repeat(starts[order] - np.concatenate([[0], ends[:-1]]), sizes[order]) + np.arange(ends[-1])
    return Machine().fit(ends, f[at], v[at], label[order].astype(np.float64))


def score_column(docs: DataFrame, machine: Machine, text_col: str, chars_col: str | None) -> Column:
    """Score of a row as a column: only text and ``n_chars`` go to the Python workers, and a number comes back."""
    shared = docs.sparkSession.sparkContext.broadcast(pickle.dumps(machine))  # 2^15 words by 9 numbers: 1.2 MB
    small_batches(docs.sparkSession)

    @F.arrow_udf("double")
    def of(parts: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        own = pickle.loads(shared.value)
        for texts, chars in parts:
            got = [own.score(*features(texts.slice(at, 256).to_pylist(), chars.slice(at, 256).to_pylist())) for at in range(0, len(texts), 256)]
            yield pa.array(np.concatenate(got) if got else np.zeros(0), pa.float64())
        _BUCKETS.clear()  # the worker lives on

    return of(*_inputs(docs, text_col, chars_col))


def score(docs: DataFrame, machine: Machine, id_col: str = "doc_id", text_col: str = "text", chars_col: str | None = "n_chars") -> DataFrame:
    """id and score of every document.

    Defined cases: a null text counts as empty; an empty text is scored by its statistics alone; a null ``n_chars``
    has an indicator of its own; ids pass through; an empty table gives no rows.
    """
    return docs.select(F.col(id_col), score_column(docs, machine, text_col, chars_col).alias("score"))


def keep_good(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", chars_col: str | None = "n_chars", threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs`` whose score reaches the threshold, with all their columns."""
    machine = fit(docs, labels, id_col, text_col, chars_col=chars_col)
    shown = docs.columns
    at = {c: f"c{i}" for i, c in enumerate(shown)}
    renamed = docs.toDF(*at.values())
    return renamed.where(score_column(renamed, machine, at[text_col], at.get(chars_col)) >= threshold).toDF(*shown)
