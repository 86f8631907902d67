"""Quality rules as a bitmask ledger.

Every rule is evaluated once per document.  The ledger stores the measurements and one integer whose bit ``i`` says
that rule ``i`` failed.  A policy is a versioned set of rules; applying one is ``failures & policy = 0``, and an
ablation (what would stay without rule ``i``) is the same test with one bit cleared, so no text is read again.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import text_or_empty

#: Symbols that count as noise.
SYMBOLS = "#*$%&|<>"
SPACES = " \t\n\x0b\x0c\r"
WINDOW = 8

#: Rules by bit: name and SQL over the measurements that is true if the document fails.
RULES = [
    ("too_few_words", "n_words < 20"),
    ("repeated_words", "100 * n_repeat_words > 30 * n_words"),
    ("symbol_noise", "4 * n_symbols > n_words"),
    ("word_length", "n_words > 0 and (word_chars < 2 * n_words or word_chars > 20 * n_words)"),
    ("repeated_lines", "n_lines > 0 and 10 * n_dup_lines > 5 * n_lines"),
    ("shouting", "n_upper > 5 * n_lower and n_upper > 50"),
]
#: Rules that belong to the base, and the policies by version.
BASE = 0b000011
POLICIES = {1: BASE, 2: 0b001111, 3: 0b111111}
LATEST = 3

FIELDS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper", "n_lower"]


def repeated_words(ids: np.ndarray, window: int = WINDOW) -> int:
    """Words that lie in a window of ``window`` words which occurs at least twice; windows may overlap.

    Exact: ranks of 1, 2, 4 and 8 words are built by doubling, so equal ranks mean equal words.
    """
    n = len(ids) - window + 1
    if n < 2:
        return 0
    rank, span = ids, 1
    while span < window:
        step = min(span, window - span)
        pair = rank[: len(rank) - step] * (int(rank.max()) + 1) + rank[step:]
        _, rank = np.unique(pair, return_inverse=True)
        span += step
        if int(rank.max()) + 1 == len(rank):  # nothing of this span occurs twice, so no longer one does
            return 0
    often = np.bincount(rank)[rank] > 1
    edge = np.zeros(len(ids) + 1, dtype=np.int64)
    edge[:n] += often
    edge[window:] -= often
    return int((np.cumsum(edge)[:-1] > 0).sum())


def measure(text: str) -> tuple[int, ...]:
    raw = text.encode()
    words = raw.split()
    place: dict[bytes, int] = {}
    ids = np.fromiter((place.setdefault(w, len(place)) for w in words), dtype=np.int64, count=len(words))
    lines = [x for x in text.split("\n") if x.strip(SPACES)]
    dup = len(lines) - len(set(lines))
    symbols = sum(map(text.count, SYMBOLS))
    chars = len(text) - sum(map(text.count, SPACES))
    as_bytes = np.frombuffer(raw, dtype=np.uint8)
    upper = int(((as_bytes >= 65) & (as_bytes <= 90)).sum())
    lower = int(((as_bytes >= 97) & (as_bytes <= 122)).sum())
    return len(words), chars, symbols, dup, repeated_words(ids) if len(place) < len(words) else 0, len(lines), upper, lower


def _measure_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = [measure(t) for t in batch.column(1).to_pylist()]
        columns = list(zip(*found, strict=True)) if found else [[] for _ in FIELDS]
        yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, pa.int64()) for c in columns)], names=["id", *FIELDS])


def ledger(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, the measurements, and ``failures`` (bit i: rule i failed).  One narrow pass, no shuffle.

    Defined cases: a null text has no words, so it fails ``too_few_words`` alone; the id, null or repeated, passes
    through; an empty table gives no rows; other columns of ``docs`` are not read.
    """
    base = docs.select(F.col(id_col).alias("id"), text_or_empty(text_col).alias("text"))
    kind = base.schema["id"].dataType.simpleString()
    seen = base.mapInArrow(_measure_batches, f"id {kind}, " + ", ".join(f"{f} long" for f in FIELDS))
    bits = [F.when(F.expr(rule), F.lit(1 << i)).otherwise(F.lit(0)) for i, (_, rule) in enumerate(RULES)]
    failures = bits[0]
    for b in bits[1:]:
        failures = failures.bitwiseOR(b)
    return seen.withColumn("failures", failures).withColumnRenamed("id", id_col)


def apply_policy(kept_by: DataFrame, version: int = LATEST) -> DataFrame:
    mask = POLICIES[version]
    return kept_by.withColumn("base_failed", F.col("failures").bitwiseAND(F.lit(BASE)) != 0).withColumn("kept", F.col("failures").bitwiseAND(F.lit(mask | BASE)) == 0)


def ablations(kept_by: DataFrame, version: int = LATEST) -> DataFrame:
    """One row per rule of the policy: documents that fail it, fail only it, and stay if it is left out."""
    mask = POLICIES[version] | BASE
    used = [i for i in range(len(RULES)) if mask >> i & 1]
    col = F.col("failures").bitwiseAND(F.lit(mask))
    sums = [F.count(F.lit(1)).alias("n"), F.count_if(col == 0).alias("kept")]
    for i in used:
        sums += [F.count_if(col.bitwiseAND(F.lit(1 << i)) != 0).alias(f"fail_{i}"), F.count_if(col == (1 << i)).alias(f"only_{i}")]
    one = kept_by.agg(*sums)
    rows = F.array(*[F.struct(F.lit(RULES[i][0]).alias("rule"), F.lit(i).alias("bit"), F.col(f"fail_{i}").alias("failing"), F.col(f"only_{i}").alias("failing_alone"), (F.col("kept") + F.col(f"only_{i}")).alias("kept_without")) for i in used])
    return one.select(F.explode(rows).alias("r")).select("r.*")


def mask_histogram(kept_by: DataFrame) -> DataFrame:
    """Documents by failure mask: at most 2^rules rows, from which any policy can be evaluated."""
    return kept_by.groupBy("failures").agg(F.count(F.lit(1)).alias("n"))


__all__ = ["BASE", "POLICIES", "RULES", "ablations", "apply_policy", "ledger", "mask_histogram", "measure", "repeated_words"]
