"""Language identification by prediction by partial matching over bytes.

Each language has a context tree of orders 3 to 0: what follows the last three bytes, the last two, one, none.  A byte
seen in the longest context costs ``-log2(c / (n + k))`` bits, with ``n`` bytes and ``k`` distinct ones seen there (escape
method C); otherwise the escape ``-log2(k / (n + k))`` is paid and the next shorter context asked, down to a uniform
code.  The statistics are frozen, so the cost of any byte is a fixed sum and a text's code length is exact.

Texts are scored whole.  The trees are sparse: sorted arrays of the contexts and continuations that were seen, in which a
batch of places is looked up at once; costs of all languages lie side by side in a row.  Counting reads a documented
sample of labelled rows per language, on the executors.
"""

from __future__ import annotations

import pickle
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import fold, small_batches

#: Learning rows per language at most, taken in the order of a hash of the id.
SAMPLE = 1500
ORDER = 3
_BLOCK = 1 << 17
UNKNOWN = "und"


def grams(raw: bytes) -> np.ndarray:
    """For each byte the number of its last ``ORDER`` bytes and itself; a text begins after zero bytes."""
    sym = np.zeros(len(raw) + ORDER, dtype=np.uint32)
    sym[ORDER:] = np.frombuffer(raw, dtype=np.uint8)
    code = sym[ORDER:].copy()
    for k in range(1, ORDER + 1):
        code |= sym[ORDER - k : len(sym) - k] << np.uint32(8 * k)
    return code


def _find(table: np.ndarray, asked: np.ndarray) -> np.ndarray:
    """Place of each number in a sorted table, or -1."""
    if not len(table):
        return np.full(len(asked), -1, dtype=np.int64)
    at = np.minimum(np.searchsorted(table, asked), len(table) - 1)
    return np.where(table[at] == asked, at, -1)


class Trees:
    """Frozen context trees of all languages.

    From (gram, language, count) of the longest order; shorter orders are their sums.
    """

    def __init__(self, langs: list[str], gram: np.ndarray, lang: np.ndarray, count: np.ndarray):
        self.langs, self.source = langs, (gram, lang, count)
        n_lang = len(langs)
        self.seen: list[np.ndarray] = []  # by order: contexts with what follows, sorted
        self.cost: list[np.ndarray] = []  # bits of each by language, inf where the language has not seen it
        self.context: list[np.ndarray] = []
        self.escape: list[np.ndarray] = []  # bits of leaving each context; 0 where the language has not seen it
        for order in range(ORDER + 1):
            mask = np.int64((1 << 8 * (order + 1)) - 1)
            seen, inverse = np.unique((gram & mask) * n_lang + lang, return_inverse=True)
            c = np.bincount(inverse, weights=count)
            g, w = seen // max(1, n_lang), seen % max(1, n_lang)
            ctx, ctx_of = np.unique(g >> 8, return_inverse=True)
            n, k = np.zeros((len(ctx), n_lang)), np.zeros((len(ctx), n_lang))
            np.add.at(n, (ctx_of, w), c)
            np.add.at(k, (ctx_of, w), 1)
            with np.errstate(divide="ignore", invalid="ignore"):
                escape = np.where(n > 0, -np.log2(k / (n + k)), 0.0)
                bits = -np.log2(c / (n[ctx_of, w] + k[ctx_of, w]))
            rows, row_of = np.unique(g, return_inverse=True)
            cost = np.full((len(rows), n_lang), np.inf)
            cost[row_of, w] = bits
            self.seen.append(rows.astype(np.uint32))
            self.cost.append(cost)
            self.context.append(ctx.astype(np.uint32))
            self.escape.append(escape)
        # Where a gram of the longest order is known to any language, its cost is worked out for all of them.
        self.whole = self._by_escapes(self.seen[ORDER].astype(np.int64))

    def _by_escapes(self, code: np.ndarray) -> np.ndarray:
        """Bits of each gram in each language, from the longest context down."""
        total = np.zeros((len(code), len(self.langs)))
        open_ = np.ones((len(code), len(self.langs)), dtype=bool)
        for order in range(ORDER, -1, -1):
            g = (code & ((1 << 8 * (order + 1)) - 1)).astype(np.uint32)
            row = _find(self.seen[order], g)
            bits = np.full_like(total, np.inf)
            bits[row >= 0] = self.cost[order][row[row >= 0]]
            here = open_ & np.isfinite(bits)
            total[here] += bits[here]
            open_ &= ~here
            ctx = _find(self.context[order], g >> np.uint32(8))
            esc = np.zeros_like(total)
            esc[ctx >= 0] = self.escape[order][ctx[ctx >= 0]]
            total += np.where(open_, esc, 0.0)
        return total + np.where(open_, 8.0, 0.0)

    def code_lengths(self, raw: bytes) -> np.ndarray:
        """Bits of the whole text in each language."""
        total = np.zeros(len(self.langs))
        for at in range(0, len(raw), _BLOCK):  # bounded memory for very long texts
            lead = max(0, at - ORDER)
            code = grams(raw[lead : at + _BLOCK])[at - lead :]
            row = _find(self.seen[ORDER], code)
            known = row >= 0
            total += self.whole[row[known]].sum(axis=0)
            if not known.all():
                total += self._by_escapes(code[~known].astype(np.int64)).sum(axis=0)
        return total

    def predict(self, text: str | None) -> tuple[str, float]:
        """Language of the shortest code and its share of probability; ties go to the first by code point."""
        if not self.langs or not text or not any(map(str.isalpha, text)):
            return UNKNOWN, 0.0
        bits = self.code_lengths(text.encode())
        best = int(np.argmin(bits))
        return self.langs[best], float(1.0 / np.exp2(np.clip(bits[best] - bits, -1000, 0)).sum())


def _count_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: dict[int, tuple[np.ndarray, np.ndarray]] = {}
    for batch in batches:
        by: dict[int, list[np.ndarray]] = {}
        for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            by.setdefault(lang, []).append(grams(text.encode()))
        for lang, parts in by.items():
            g, c = np.unique(np.concatenate(parts), return_counts=True)
            if lang in held:
                g, inverse = np.unique(np.concatenate([held[lang][0], g]), return_inverse=True)
                c = np.bincount(inverse, weights=np.concatenate([held[lang][1], c])).astype(np.int64)
            held[lang] = (g, c)
    for lang, (g, c) in held.items():
        for at in range(0, len(g), 1 << 16):
            part = slice(at, at + (1 << 16))
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(g[part]), lang), pa.int32()), pa.array(g[part].astype(np.int64)), pa.array(c[part].astype(np.int64))], names=["lang", "gram", "n"])


def learn(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", folds: int = 3, held: int = 1, sample: int = SAMPLE) -> Trees:
    """Trees from at most ``sample`` rows per language, outside the held-out fold, with a language and a text."""
    rows = docs.where((fold(id_col, folds) != held) & F.col(lang_col).isNotNull() & F.col(text_col).isNotNull())
    rows = rows.select(F.col(lang_col).cast("string").alias("lang"), F.col(text_col).alias("text"), F.xxhash64(F.col(id_col).cast("string")).alias("h"))
    per = {r.lang: r.n for r in rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}  # a row per language
    langs = sorted(per, key=lambda s: s.encode())
    if not langs:
        return Trees([], *(np.zeros(0, dtype=np.int64) for _ in range(3)))
    # A hash threshold that lets about twice the sample through, then the exact number by rank.
    limits = [(s, i, min((1 << 63) - 1, int(min(1.0, 2.0 * (sample + 50) / per[s]) * float(1 << 64)) - (1 << 63))) for i, s in enumerate(langs)]
    wanted = F.broadcast(docs.sparkSession.createDataFrame(limits, "lang string, k int, upto long"))
    near = rows.join(wanted, "lang").where("h <= upto")
    chosen = near.withColumn("r", F.row_number().over(Window.partitionBy("k").orderBy("h", "text"))).where(F.col("r") <= sample).select("k", "text")
    small_batches(docs.sparkSession)
    # a bounded sample's grams: at most ``sample`` texts a language
    table = chosen.mapInArrow(_count_batches, "lang int, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n")).toArrow()
    return Trees(langs, *(table.column(c).to_numpy().astype(np.int64) for c in ("gram", "lang", "n")))


def identify(docs: DataFrame, trees: Trees, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, lang_pred, score.  One narrow pass; the trees, the counts of a bounded sample, are broadcast.

    Defined cases: a null text and a text without a letter are ``und`` with score 0, and so is every text if nothing
    was learned; ids pass through; an empty table gives no rows; other columns of ``docs`` are not read.
    """
    key = uuid.uuid4().hex
    shared = docs.sparkSession.sparkContext.broadcast(pickle.dumps((trees.langs, *trees.source)))
    base = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = _restored(key, shared.value)
        for batch in batches:
            found = [own.predict(t) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([f[0] for f in found], pa.string()), pa.array([f[1] for f in found], pa.float64())], names=["id", "lang_pred", "score"])

    kind = base.schema["id"].dataType.simpleString()
    return base.mapInArrow(run, f"id {kind}, lang_pred string, score double").withColumnRenamed("id", id_col)


_WORKER: dict[str, Trees] = {}


def _restored(key: str, data: bytes) -> Trees:
    if key not in _WORKER:
        _WORKER.clear()
        _WORKER[key] = Trees(*pickle.loads(data))
    return _WORKER[key]
