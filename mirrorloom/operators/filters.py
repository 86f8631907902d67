"""Predicates on hit tables, all as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

PRE, POST = "pre", "post"


def count_of(s: Column, letters: str) -> Column:
    """Characters of ``s`` that are among ``letters``."""
    return F.length(s) - F.length(F.translate(s, letters, ""))


def filter_at_content(hits: DataFrame, threshold: float) -> DataFrame:
    """Keep hits with less than ``threshold`` of A and T over the whole span; empty spans stay."""
    s = F.col("full_sequence")
    return hits.where((F.length(s) == 0) | (count_of(s, "atAT") / F.greatest(F.length(s), F.lit(1)) < threshold))


def arm_g_rate(arm: Column, purine_is_ga: Column) -> Column:
    """Share of G in a GA arm, of C in a CT arm; 0 for an empty arm."""
    n = F.when(purine_is_ga, count_of(arm, "gG")).otherwise(count_of(arm, "cC"))
    return F.when(F.length(arm) == 0, 0.0).otherwise(n / F.greatest(F.length(arm), F.lit(1)))


def filter_g_rate(hits: DataFrame, least: float) -> DataFrame:
    """Keep hits of which one arm reaches the G rate, read on the strand that the right arm's percentages name."""
    ga = F.col("ga_pct") >= F.col("ct_pct")
    return hits.where(F.greatest(arm_g_rate(F.col("left_arm"), ga), arm_g_rate(F.col("right_arm"), ga)) >= least)


def is_homopolymer(s: Column) -> Column:
    return (F.length(s) > 0) & (F.replace(s, F.substring(s, 1, 1), F.lit("")) == "")


def filter_homopolymers(hits: DataFrame, mode: str = PRE) -> DataFrame:
    """Drop hits of one single base; in POST mode also those whose triplex, brackets off, is one."""
    if mode not in (PRE, POST):
        raise ValueError(f"unknown homopolymer mode {mode!r}")
    bad = is_homopolymer(F.col("full_sequence"))
    if mode == POST:
        bad = bad | is_homopolymer(F.translate(F.coalesce("putative_triplex", F.lit("")), "[]", ""))
    return hits.where(~bad)


def filter_table(hits: DataFrame, q: str = "", min_arm: int | None = None, max_arm: int | None = None, min_mirror: float = 0, perfect_only: bool = False, min_ga: bool = False, min_ct: bool = False, min_score: float | None = None) -> DataFrame:
    """The hit page's predicates; each applies only where it differs from its default.  A null score never passes a bound."""
    if q:
        hits = hits.where(F.contains(F.lower("seq_id"), F.lower(F.lit(q))))
    if min_arm is not None:
        hits = hits.where(F.col("arm_length") >= min_arm)
    if max_arm is not None:
        hits = hits.where(F.col("arm_length") <= max_arm)
    if min_mirror:
        hits = hits.where(F.col("mirror_identity") >= min_mirror)
    if perfect_only:
        hits = hits.where("is_perfect")
    if min_ga:
        hits = hits.where("ga_pct >= 80")
    if min_ct:
        hits = hits.where("ct_pct >= 80")
    return hits if min_score is None else hits.where(F.col("total_score") >= min_score)


def acgt_only(records: DataFrame, col: str = "seq") -> DataFrame:
    return records.where(F.col(col).rlike("^[ACGTacgt]+$"))


def label_of(label: Column) -> Column:
    """1 for ``forming``, 0 for ``non-forming`` in any spelling of case, spaces and underscores; null otherwise."""
    plain = F.replace(F.lower(F.trim(label)), F.lit("_"), F.lit("-"))
    return F.when(plain == "forming", 1).when(plain == "non-forming", 0)


def curated(records: DataFrame, subset: str = "all", seq: str = "seq") -> DataFrame:
    """Rows of a labelled table that belong in an analysis, with ``y`` from ``label`` and ``valid``, whether the sequence has only A, C, G and T.

    A table with a column ``curation_decision`` keeps the rows that say ``kept``; a ``subset`` other than ``all`` keeps the rows of
    that ``record_type``, which the table must then have.
    """
    if "curation_decision" in records.columns:
        records = records.where(F.trim("curation_decision") == "kept")
    if subset != "all":
        if "record_type" not in records.columns:
            raise ValueError(f"the subset {subset!r} needs a column record_type")
        records = records.where(F.trim("record_type") == subset)
    clean = F.coalesce(F.upper(F.trim(seq)).rlike("^[ACGT]+$"), F.lit(False))
    return records.withColumn("y", label_of(F.col("label"))).withColumn("valid", clean)


def composition_group(s: Column) -> Column:
    return F.when(is_homopolymer(s), "homopolymer").when(count_of(s, "atAT") >= 0.8 * F.length(s), "at_rich").otherwise("mixed")
