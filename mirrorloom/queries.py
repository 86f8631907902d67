"""Registered queries of the engine and their DuckDB equivalents, named after the operators they show."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import detector_sql as Q
from .functions import scoring, stats
from .grid import Grid
from .operators import evaluation as E
from .operators import filters as C
from .operators import intervals as G
from .operators import generators as N
from .operators import reporting as A
from .operators.grid import grid_calls, grid_confusion, grid_counts, grid_predictions
from .operators.inside import best_first_inside, greedy_inside
from .operators.overlap import islands, remove_overlaps
from .operators.ranks import stored
from .params import ScanParams
from .plans import scan as P
from .sources import tables
from .sources.fasta import read_fasta, read_fasta_named, write_fasta, write_hits
from .views import DNA_SQL, HITS_SQL, INSERTS_SQL, LABELLED_SQL, MOTIFS_SQL, POINTS_SQL, dna, dna_of, hits, inserts, labelled, motifs, points

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}
HIT_KEY = ["seq_id", "start", "end", "arm_length", "spacer_length"]


def query(name: str, sql: str | None = None, views: str = ""):
    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLE_SQL[name] = f"WITH {views} {sql}" if views else sql
        return f

    return add


# Scans of whole documents as sequences, with all places, spacers and lengths in both engines.


@query("x1_raw_candidates", Q.x1_sql(ScanParams()))
def x1(spark: SparkSession, sf: str) -> DataFrame:
    from .operators.detect import raw_candidates

    return raw_candidates(dna(spark, sf), ScanParams(), extend=False).select("seq_id", "start", "end", "arm_length", "spacer_length", "ga", "ct", "mismatches")


@query("p5_detect_candidates", Q.p5_sql(ScanParams()))
def p5(spark: SparkSession, sf: str) -> DataFrame:
    return P.detect_candidates(dna(spark, sf)).drop("record_ix")


def rounded_scores(hits: DataFrame) -> DataFrame:
    """Parts of a score to three places, the precision of the model's weights; the sums differ in their last bits."""
    return hits.drop("record_ix").withColumns({c: F.round(c, 3) for c in ("stacking_score", "pairing_score")})


@query("p1_scan_hits", Q.p1_sql(ScanParams()))
def p1(spark: SparkSession, sf: str) -> DataFrame:
    return rounded_scores(P.scan(dna(spark, sf)))


#: Arms of up to twelve bases.  Listing every window of every candidate's arm is beyond SQL where a text is one long repeat,
#: so what scores all candidates is compared for short arms, next to the scan with all lengths.
SHORT = ScanParams(maxrep=12, maxspacer=3)


@query("p1_scan_score_selection", Q.p1_sql(ScanParams(overlap_strategy="score"), scores_sql=Q.linear_scores_sql))
def p1_score(spark: SparkSession, sf: str) -> DataFrame:
    return rounded_scores(P.scan(dna(spark, sf), ScanParams(overlap_strategy="score")))


@query("p1_score_selection_short", Q.p1_sql(SHORT.but(overlap_strategy="score")))
def p1_score_short(spark: SparkSession, sf: str) -> DataFrame:
    return rounded_scores(P.scan(dna(spark, sf), SHORT.but(overlap_strategy="score")))


def stages(records: DataFrame, p: ScanParams) -> DataFrame:
    """Hits, mean and highest score of each stage of the pipeline but the first."""
    out = None
    for i, (model, hits) in enumerate(P.scan_stages(records, p, P.ABLATION[1:]).items()):
        got = hits.agg(F.count(F.lit(1)).alias("hits"), F.round(F.avg("total_score"), 6).alias("mean_score"), F.max("total_score").alias("max_score")).select(F.lit(i).alias("step"), F.lit(model).alias("stage"), "*")
        out = got if out is None else out.unionByName(got)
    return out


@query("p6_ablation_stages", Q.stages_sql(ScanParams(), Q.linear_scores_sql))
def p6(spark: SparkSession, sf: str) -> DataFrame:
    return stages(dna(spark, sf), ScanParams())


@query("p6_ablation_stages_short", Q.stages_sql(SHORT))
def p6_short(spark: SparkSession, sf: str) -> DataFrame:
    return stages(dna(spark, sf), SHORT)


@query("p6_detection_stage", Q.detection_sql(SHORT))
def p6_detection(spark: SparkSession, sf: str) -> DataFrame:
    """The first stage, without purity, for arms of up to twelve bases."""
    return P.scan_ablation(dna(spark, sf), "detection", SHORT).select(HIT_KEY)


@query("c2_score_components", Q.c2_sql(ScanParams()))
def c2(spark: SparkSession, sf: str) -> DataFrame:
    base = P.scan(dna(spark, sf), ScanParams(score=False))
    out = scoring.with_model_scores(base.select("seq_id", "start", "end", "arm_length", "left_arm", "spacer", "right_arm", F.round(scoring.upper_bound(F.col("left_arm")), 3).alias("bound")))
    return out.select("seq_id", "start", "end", "arm_length", "bound", *[F.col(f"_{m}.total_score").alias(f"score_{m}") for m in scoring.MODELS])


@query("d14_scan_profile", f"WITH {DNA_SQL}, {Q.candidates_sql(ScanParams())}, n AS (SELECT record_ix, count(*) AS c FROM cand GROUP BY 1) SELECT lang, count(*) AS records, CAST(sum(length(seq)) AS BIGINT) AS bases, CAST(sum(coalesce(c, 0)) AS BIGINT) AS candidates FROM dna JOIN documents ON doc_id = record_ix LEFT JOIN n USING (record_ix) GROUP BY 1")
def d14(spark: SparkSession, sf: str) -> DataFrame:
    """Sequences, bases and candidates per document language, the scan's volume counters."""
    records = dna(spark, sf)
    found = P.detect_candidates(records).groupBy("record_ix").agg(F.count(F.lit(1)).alias("c"))
    langs = spark.read.parquet(f"{sf}/documents.parquet").select(F.col("doc_id").alias("record_ix"), "lang")
    per = records.select("record_ix", F.length("seq").cast("long").alias("b")).join(found, "record_ix", "left").join(langs, "record_ix")
    return per.groupBy("lang").agg(F.count(F.lit(1)).alias("records"), F.sum("b").alias("bases"), F.sum(F.coalesce("c", F.lit(0))).alias("candidates"))


@query("x8_centre_spacer_pairs", f"WITH {DNA_SQL}, c AS (SELECT record_ix, length(seq) AS n, unnest(range(1, length(seq) + 1)) AS i, unnest(string_split(seq, '')) AS b FROM dna WHERE seq <> '') SELECT record_ix, CAST(coalesce(sum(least(10, n - 8 - i) + 1) FILTER (b IN ('a', 'c', 'g', 't') AND i >= 8 AND i <= n - 8), 0) AS BIGINT) AS ctr_sp_pairs FROM (SELECT record_ix, n, i, b FROM c UNION ALL SELECT record_ix, 0, 0, '' FROM dna WHERE seq = '') GROUP BY 1")
def x8(spark: SparkSession, sf: str) -> DataFrame:
    """The scan's counter of centre-spacer pairs by record, summed over its chunks."""
    from .operators import detect as D

    p = ScanParams()
    counted = D.counted_candidates(D.chunked(dna(spark, sf), p), p).where("start is null")
    return counted.groupBy("record_ix").agg(F.sum("ctr_sp_pairs").alias("ctr_sp_pairs"))


# Grids, ladders and panels of scans over the benchmark's passages as short records.

_BENCH = DNA_SQL.replace("doc_id", "item_id").replace("documents", "benchmark")


def passages(spark: SparkSession, sf: str) -> DataFrame:
    return dna_of(spark.read.parquet(f"{sf}/benchmark.parquet"), "item_id")


GRID = [{"minrep": m, "mismatch": x, "at_threshold": t} for m in (8, 10) for x in (0.1, 0.2) for t in (None, 0.8)]


@query("e10_prediction_matrix", " UNION ALL ".join(f"SELECT {i} AS config_id, record_ix, CASE WHEN record_ix IN (SELECT record_ix FROM ({Q.p1_sql(ScanParams(**c), _BENCH, 'DISTINCT record_ix')})) THEN 1 ELSE 0 END AS p FROM (SELECT item_id AS record_ix FROM benchmark)" for i, c in enumerate(GRID)))
def e10(spark: SparkSession, sf: str) -> DataFrame:
    records = passages(spark, sf)
    return E.prediction_matrix(records, GRID, lambda r, c: P.scan(r, ScanParams(**c)))


# The whole grid over all documents in one scan.  SQL scans once per configuration, so it repeats a drawn few of the 576.

WHOLE_GRID = Grid()
DRAWN = [199, 375, 464]


def _drawn_sql() -> str:
    calls = [f"SELECT {i} AS config_id, record_ix FROM ({Q.p1_sql(WHOLE_GRID.params()[i], columns='DISTINCT record_ix')})" for i in DRAWN]
    return f"WITH called AS ({' UNION ALL '.join(calls)}) SELECT CAST(c.config_id AS INTEGER) AS config_id, d.doc_id AS record_ix, CAST(k.record_ix IS NOT NULL AS INTEGER) AS p FROM documents d, (SELECT unnest({DRAWN}) AS config_id) c LEFT JOIN called k ON k.config_id = c.config_id AND k.record_ix = d.doc_id"


@query("e10_grid_drawn", _drawn_sql())
def e10_drawn(spark: SparkSession, sf: str) -> DataFrame:
    """Calls of the drawn configurations for every document, from the scan of all 576."""
    return grid_predictions(grid_calls(dna(spark, sf), WHOLE_GRID), WHOLE_GRID, only=DRAWN)


@query("e9_parameter_grid")
def e9(spark: SparkSession, sf: str) -> DataFrame:
    """All configurations with the number of documents that each calls."""
    called = grid_counts(grid_calls(dna(spark, sf), WHOLE_GRID), WHOLE_GRID).drop("total")
    axes = {k: list(getattr(WHOLE_GRID, k)) for k in ("filters", "purity", "mismatch", "minrep", "maxspacer")}
    return E.parameter_grid(spark, **axes).join(called, "config_id")


def grid_metrics(spark: SparkSession, sf: str) -> DataFrame:
    calls = grid_calls(dna(spark, sf), WHOLE_GRID)
    truth = spark.read.parquet(f"{sf}/labels.parquet").select(F.col("doc_id").alias("record_ix"), F.col("quality").alias("y"))
    return E.with_metrics(grid_confusion(calls, truth, WHOLE_GRID))


@query("e11_grid_selection")
def e11_grid(spark: SparkSession, sf: str) -> DataFrame:
    """Of the whole grid the configuration with the best MCC, by the order of ties."""
    axes = {k: list(getattr(WHOLE_GRID, k)) for k in ("filters", "purity", "mismatch", "minrep", "maxspacer")}
    simple = F.array_position(F.array(*map(F.lit, WHOLE_GRID.filters)), F.col("filters"))
    m = grid_metrics(spark, sf).withColumn("mcc", F.round("mcc", 9)).join(E.parameter_grid(spark, **axes), "config_id")
    return m.orderBy(F.col("mcc").desc(), F.col("sensitivity").desc(), simple, F.col("minrep").desc(), "maxspacer", "mismatch", "config_id").limit(1).select("config_id", *axes, *E.COUNTS, "mcc")


@query("e15_grid_nested_cv")
def e15_grid(spark: SparkSession, sf: str) -> DataFrame:
    """Out-of-fold metrics of the configuration selected from the whole grid, five folds, four repeats."""
    truth = spark.read.parquet(f"{sf}/labels.parquet").select(F.col("doc_id").alias("record_id"), F.col("quality").alias("y"))
    calls = grid_calls(dna(spark, sf), WHOLE_GRID).withColumnRenamed("record_ix", "record_id")
    each = truth.withColumn("rep", F.explode(F.sequence(F.lit(0), F.lit(3))))
    folds = E.stratified_folds(each, "record_id", ["y"], 5, F.col("rep"), ["rep"]).select("rep", "record_id", "fold")
    per = grid_confusion(calls, truth.join(folds, "record_id"), WHOLE_GRID, "record_id", ["rep", "fold"])
    return E.nested_cv_of(per, [F.round("mcc", 9).desc(), F.col("config_id")]).select("rep", *E.COUNTS, F.round("mcc", 9).alias("mcc"))


VARY = [("minrep", 8), ("minrep", 10), ("maxspacer", 4), ("maxspacer", 10), ("purity", 0.8), ("mismatch", 0.2)]


@query("e27_one_at_a_time", " UNION ALL ".join(f"SELECT '{n}' AS parameter, {v}::DOUBLE AS value, {str(getattr(ScanParams(), n) == v).lower()} AS is_default, count(DISTINCT record_ix) AS called, count(*) AS hits FROM ({Q.p1_sql(ScanParams(**{n: v}), _BENCH, 'record_ix')})" for n, v in VARY))
def e27(spark: SparkSession, sf: str) -> DataFrame:
    """Called records and hits with one parameter changed at a time."""
    records, out = passages(spark, sf), None
    for name, value in VARY:
        got = P.scan(records, ScanParams(**{name: value})).agg(F.countDistinct("record_ix").alias("called"), F.count(F.lit(1)).alias("hits"))
        row = got.select(F.lit(name).alias("parameter"), F.lit(float(value)).alias("value"), F.lit(getattr(ScanParams(), name) == value).alias("is_default"), "called", "hits")
        out = row if out is None else out.unionByName(row)
    return out


MODES = {"retain_all": {"remove_overlaps": False}, "greedy": {}, "score": {"overlap_strategy": "score"}}


@query("e28_overlap_modes", " UNION ALL ".join(f"SELECT '{m}' AS overlap_mode, record_ix, count(*) AS n_hits, max(total_score) AS max_score FROM ({Q.p1_sql(ScanParams(**k), _BENCH, 'record_ix, total_score')}) GROUP BY ALL" for m, k in MODES.items()))
def e28(spark: SparkSession, sf: str) -> DataFrame:
    """Hits and highest score of each called record under each way to treat overlaps."""
    records, out = passages(spark, sf), None
    for mode, kw in MODES.items():
        row = P.scan(records, ScanParams(**kw)).groupBy("record_ix").agg(F.count(F.lit(1)).alias("n_hits"), F.max("total_score").alias("max_score")).select(F.lit(mode).alias("overlap_mode"), "record_ix", "n_hits", "max_score")
        out = row if out is None else out.unionByName(row)
    return out


_STRICT = ScanParams(minrep=10, at_threshold=0.8)
_STEPS = P.ladder(_STRICT)


@query("g25_reasons", f"WITH m AS (SELECT item_id AS record_ix, length(seq) // 3 + 1 AS s, 2 * (length(seq) // 3) AS e FROM (WITH {_BENCH} SELECT record_ix AS item_id, seq FROM dna)), met AS (" + " UNION ALL ".join(f"SELECT DISTINCT record_ix, {i} AS step FROM ({Q.p1_sql(p, _BENCH, 'record_ix, start, "end"')}) h JOIN m USING (record_ix) WHERE h.start <= m.e AND h.\"end\" >= m.s" for i, (_, p) in enumerate(_STEPS))
       + f"), f AS (SELECT record_ix, min(step) AS step FROM met GROUP BY 1) SELECT record_ix, coalesce(list_extract({[n for n, _ in _STEPS]}, CAST(step + 1 AS INTEGER)), 'not recovered by any relaxation') AS reason FROM m LEFT JOIN f USING (record_ix)")
def g25(spark: SparkSession, sf: str) -> DataFrame:
    """For the middle third of each passage the first relaxation of a strict scan that has a hit on it."""
    records = passages(spark, sf)
    third = F.floor(F.length("seq") / 3)
    return P.reasons(records, records.select("record_ix", (third + 1).alias("start"), (2 * third).alias("end")), _STRICT)


PANEL_FILTERS = {"none": {"at_threshold": None, "filter_homopolymers": False}, "at_only": {"at_threshold": 0.8, "filter_homopolymers": False}, "homopolymer_only": {"at_threshold": None}, "both": {"at_threshold": 0.8}}

@query("e35_homopolymer_panel", f"WITH calls AS (" + " UNION ALL ".join(f"SELECT '{f}' AS state, seq_id FROM ({Q.p1_sql(ScanParams(**k), _BENCH, 'seq_id')})" for f, k in PANEL_FILTERS.items()) + "), names AS (SELECT 'd' || item_id AS seq_id FROM benchmark) SELECT seq_id, " + ", ".join(f"count(*) FILTER (state = '{f}') > 0 AS {f}" for f in PANEL_FILTERS) + " FROM names LEFT JOIN calls USING (seq_id) GROUP BY seq_id")
def e35(spark: SparkSession, sf: str) -> DataFrame:
    """Whether each passage is called under each state of the filters."""
    return P.panel(passages(spark, sf), PANEL_FILTERS)


@query("e28_stage_metrics", Q.stage_metrics_sql(ScanParams(), "SELECT doc_id AS record_ix, quality AS y FROM labels WHERE doc_id IN (SELECT doc_id FROM documents)"))
def e28_stages(spark: SparkSession, sf: str) -> DataFrame:
    """Confusion and AUROC of the stages' calls against the labels of quality."""
    records = dna(spark, sf)
    truth = spark.read.parquet(f"{sf}/labels.parquet").select(F.col("doc_id").alias("record_ix"), F.col("quality").alias("y")).join(records.select("record_ix"), "record_ix", "left_semi")
    got = P.stage_metrics(records.join(truth.select("record_ix"), "record_ix", "left_semi"), truth, ScanParams(), P.ABLATION[1:])
    return got.select("step", "stage", *E.COUNTS, F.round("auroc", 6).alias("auroc"))


_CURATED = """r AS (SELECT doc_id, replace(lower(trim(CASE WHEN doc_id % 3 = 0 THEN ' Forming' WHEN doc_id % 3 = 1 THEN 'non_forming ' ELSE 'other' END)), '_', '-') AS label, trim(CASE WHEN doc_id % 5 = 0 THEN 'removed' ELSE ' kept' END) AS decision, trim(coalesce(lang, '')) AS kind, upper(trim(split_part(coalesce(text, ''), ' ', 1))) AS s FROM documents)"""


@query("f6_curated_rows", f"WITH {_CURATED} SELECT doc_id, CASE label WHEN 'forming' THEN 1 WHEN 'non-forming' THEN 0 END AS y, regexp_full_match(s, '[ACGT]+') AS valid FROM r WHERE decision = 'kept' AND kind = 'en'")
def f6(spark: SparkSession, sf: str) -> DataFrame:
    """Documents as curated rows: decision and label by id, type by language, the first word as the sequence."""
    i = F.col("doc_id")
    t = spark.read.parquet(f"{sf}/documents.parquet").select(
        "doc_id", F.when(i % 3 == 0, " Forming").when(i % 3 == 1, "non_forming ").otherwise("other").alias("label"), F.when(i % 5 == 0, "removed").otherwise(" kept").alias("curation_decision"),
        F.coalesce("lang", F.lit("")).alias("record_type"), F.split_part(F.coalesce("text", F.lit("")), F.lit(" "), F.lit(1)).alias("seq"))
    return C.curated(t, "en").select("doc_id", "y", "valid")


# Filters and projections over lines as spans.


@query("f1_at_content", "SELECT doc_id, pos FROM motifs WHERE (length(full_sequence) - length(translate(full_sequence, 'at', ''))) / length(full_sequence) < 0.45", MOTIFS_SQL)
def f1(spark: SparkSession, sf: str) -> DataFrame:
    return C.filter_at_content(motifs(spark, sf), 0.45).select("doc_id", "pos")


@query("f3_g_rate", """SELECT doc_id, pos FROM motifs WHERE CASE WHEN ga_pct >= ct_pct
  THEN greatest(length(left_arm) - length(replace(left_arm, 'g', '')), length(right_arm) - length(replace(right_arm, 'g', '')))
  ELSE greatest(length(left_arm) - length(replace(left_arm, 'c', '')), length(right_arm) - length(replace(right_arm, 'c', ''))) END / arm_length >= 0.3""", MOTIFS_SQL)
def f3(spark: SparkSession, sf: str) -> DataFrame:
    return C.filter_g_rate(motifs(spark, sf), 0.3).select("doc_id", "pos")


@query("f4_homopolymers", "SELECT doc_id, CAST(count(*) AS BIGINT) AS spans, CAST(count(*) FILTER (full_sequence <> repeat(full_sequence[1], length(full_sequence))) AS BIGINT) AS kept FROM motifs GROUP BY doc_id", MOTIFS_SQL)
def f4(spark: SparkSession, sf: str) -> DataFrame:
    return motifs(spark, sf).groupBy("doc_id").agg(F.count(F.lit(1)).alias("spans"), F.count_if(~C.is_homopolymer(F.col("full_sequence"))).alias("kept"))


@query("f7_composition_group", """SELECT CASE WHEN full_sequence = repeat(full_sequence[1], length(full_sequence)) THEN 'homopolymer'
  WHEN length(full_sequence) - length(translate(full_sequence, 'at', '')) >= 0.8 * length(full_sequence) THEN 'at_rich' ELSE 'mixed' END AS composition, count(*) AS n FROM motifs GROUP BY 1""", MOTIFS_SQL)
def f7(spark: SparkSession, sf: str) -> DataFrame:
    return motifs(spark, sf).groupBy(C.composition_group(F.col("full_sequence")).alias("composition")).agg(F.count(F.lit(1)).alias("n"))


@query("c9_reverse_complement", "SELECT doc_id, pos, reverse(translate(full_sequence, 'acgt', 'tgca')) AS rc FROM motifs", MOTIFS_SQL)
def c9(spark: SparkSession, sf: str) -> DataFrame:
    return motifs(spark, sf).select("doc_id", "pos", scoring.reverse_complement_column(F.col("full_sequence")).alias("rc"))


@query("g26_motif_features", """SELECT doc_id, pos, CAST(length(full_sequence) AS INTEGER) AS n, CAST(length(full_sequence) - length(translate(full_sequence, 'at', '')) AS INTEGER) AS at_bases,
  CAST((length(full_sequence) - length(translate(full_sequence, 'ga', ''))) - (length(full_sequence) - length(translate(full_sequence, 'ct', ''))) AS INTEGER) AS purine_skew,
  CAST(list_max(list_transform(regexp_extract_all(full_sequence, 'a+|c+|g+|t+|n+'), lambda x: length(x))) AS INTEGER) AS longest_run,
  CAST(coalesce(list_first(list_filter(range(1, least(4, length(full_sequence) - 1) + 1), lambda k: (length(full_sequence) - k) - hamming(full_sequence[1:length(full_sequence) - k], full_sequence[k + 1:]) >= 0.9 * (length(full_sequence) - k))), 0) AS INTEGER) AS period FROM motifs""", MOTIFS_SQL)
def g26(spark: SparkSession, sf: str) -> DataFrame:
    m = motifs(spark, sf)
    f = G.motif_features(F.col("full_sequence"))
    whole = lambda c: F.round(c * F.length("full_sequence")).cast("int")
    return m.select("doc_id", "pos", F.length("full_sequence").alias("n"), whole(f["at"]).alias("at_bases"), whole(f["skew"]).alias("purine_skew"), whole(f["run"]).alias("longest_run"), f["period"].cast("int").alias("period"))


# The hit table: predicates, selection, summaries.


@query("f5_hit_table", "SELECT id, arm_length, total_score FROM hits WHERE contains(lower(seq_id), 's1') AND arm_length >= 12 AND arm_length <= 25 AND mirror_identity >= 95 AND ga_pct >= 80 AND total_score >= 10", HITS_SQL)
def f5(spark: SparkSession, sf: str) -> DataFrame:
    return C.filter_table(hits(spark, sf), q="S1", min_arm=12, max_arm=25, min_mirror=95, min_ga=True, min_score=10).select("id", "arm_length", "total_score")


@query("o1_greedy_sweep", """, ranked AS (SELECT *, row_number() OVER (PARTITION BY seq_id ORDER BY start, arm_length DESC, spacer_length) AS r FROM hits),
walk AS (SELECT seq_id, r, start, "end", arm_length, spacer_length, r AS keeper, CAST(NULL AS BIGINT) AS closed FROM ranked WHERE r = 1
  UNION ALL SELECT n.seq_id, n.r,
    CASE WHEN n.start > w."end" OR n.arm_length > w.arm_length OR (n.arm_length = w.arm_length AND n.spacer_length < w.spacer_length) THEN n.start ELSE w.start END,
    CASE WHEN n.start > w."end" OR n.arm_length > w.arm_length OR (n.arm_length = w.arm_length AND n.spacer_length < w.spacer_length) THEN n."end" ELSE w."end" END,
    CASE WHEN n.start > w."end" OR n.arm_length > w.arm_length OR (n.arm_length = w.arm_length AND n.spacer_length < w.spacer_length) THEN n.arm_length ELSE w.arm_length END,
    CASE WHEN n.start > w."end" OR n.arm_length > w.arm_length OR (n.arm_length = w.arm_length AND n.spacer_length < w.spacer_length) THEN n.spacer_length ELSE w.spacer_length END,
    CASE WHEN n.start > w."end" OR n.arm_length > w.arm_length OR (n.arm_length = w.arm_length AND n.spacer_length < w.spacer_length) THEN n.r ELSE w.keeper END,
    CASE WHEN n.start > w."end" THEN w.keeper END
  FROM walk w JOIN ranked n ON n.seq_id = w.seq_id AND n.r = w.r + 1),
kept AS (SELECT seq_id, closed AS r FROM walk WHERE closed IS NOT NULL UNION SELECT seq_id, arg_max(keeper, r) FROM walk GROUP BY seq_id)
SELECT ranked.seq_id, start, "end", arm_length, spacer_length FROM ranked JOIN kept USING (seq_id, r)""", "RECURSIVE " + HITS_SQL)
def o1(spark: SparkSession, sf: str) -> DataFrame:
    return remove_overlaps(hits(spark, sf), "greedy").select(HIT_KEY)


@query("o2_score_selection", """, ranked AS (SELECT *, row_number() OVER (PARTITION BY seq_id ORDER BY total_score IS NULL, total_score DESC, arm_length DESC, spacer_length, start, "end") AS r FROM hits),
walk AS (SELECT seq_id, r, [{'s': start, 'e': "end"}] AS taken, true AS ok FROM ranked WHERE r = 1
  UNION ALL SELECT n.seq_id, n.r, CASE WHEN len(list_filter(w.taken, lambda x: x.s <= n."end" AND x.e >= n.start)) = 0 THEN list_append(w.taken, {'s': n.start, 'e': n."end"}) ELSE w.taken END,
    len(list_filter(w.taken, lambda x: x.s <= n."end" AND x.e >= n.start)) = 0
  FROM walk w JOIN ranked n ON n.seq_id = w.seq_id AND n.r = w.r + 1)
SELECT ranked.seq_id, start, "end", arm_length, spacer_length FROM ranked JOIN walk USING (seq_id, r) WHERE ok""", "RECURSIVE " + HITS_SQL)
def o2(spark: SparkSession, sf: str) -> DataFrame:
    return remove_overlaps(hits(spark, sf), "score").select(HIT_KEY)


@query("o1_greedy_inside", ORACLE_SQL["o1_greedy_sweep"])
def o1_inside(spark: SparkSession, sf: str) -> DataFrame:
    """The greedy sweep by successors and pointer jumping."""
    return greedy_inside(hits(spark, sf).select(*HIT_KEY, "full_sequence")).select(HIT_KEY)


@query("o2_score_inside", ORACLE_SQL["o2_score_selection"])
def o2_inside(spark: SparkSession, sf: str) -> DataFrame:
    """Selection by score in rounds of hits that outrank all their open neighbours."""
    return best_first_inside(hits(spark, sf).select(*HIT_KEY, "total_score", "full_sequence"))[0].select(HIT_KEY)


@query("o3_islands", """, marked AS (SELECT *, CASE WHEN max("end") OVER (PARTITION BY seq_id ORDER BY start, "end" ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) >= start THEN 0 ELSE 1 END AS n FROM hits),
numbered AS (SELECT *, sum(n) OVER (PARTITION BY seq_id ORDER BY start, "end" ROWS UNBOUNDED PRECEDING) AS island FROM marked)
SELECT seq_id, CAST(island AS BIGINT) AS island, count(*) AS n, min(start) AS start, max("end") AS "end" FROM numbered GROUP BY 1, 2""", HITS_SQL)
def o3(spark: SparkSession, sf: str) -> DataFrame:
    # places alone: what a task sorts does not hold the hits' other columns
    return islands(stored(hits(spark, sf).select("seq_id", "start", "end"), "islands-places"), keep=False).groupBy("seq_id", "island").agg(F.count(F.lit(1)).alias("n"), F.min("start").alias("start"), F.max("end").alias("end"))


@query("a1_stats", """SELECT count(*) AS total, count(*) FILTER (is_perfect) AS perfect, count(*) FILTER (NOT is_perfect) AS imperfect, round(count(*) FILTER (is_perfect) * 100.0 / count(*), 1) AS perfect_pct,
  count(DISTINCT seq_id) AS sequences, round(avg(arm_length), 1) AS mean_arm, round(avg(spacer_length), 1) AS mean_spacer, round(avg(mirror_identity), 1) AS mean_mirror, min(arm_length) AS min_arm, max(arm_length) AS max_arm,
  round(avg(total_score), 1) AS mean_score, max(total_score) AS max_score, count(total_score) AS scored FROM hits""", HITS_SQL)
def a1(spark: SparkSession, sf: str) -> DataFrame:
    return A.compute_stats(hits(spark, sf))


@query("a2_top_sequences", "SELECT seq_id, count(*) AS hits FROM hits GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 25", HITS_SQL)
def a2(spark: SparkSession, sf: str) -> DataFrame:
    return A.top_sequences(hits(spark, sf))


@query("a3_perfect_split", "SELECT is_perfect, count(*) AS n FROM hits GROUP BY 1", HITS_SQL)
def a3(spark: SparkSession, sf: str) -> DataFrame:
    return A.value_counts(hits(spark, sf), "is_perfect")


@query("a4_arm_counts", "SELECT arm_length, count(*) AS n FROM hits GROUP BY 1", HITS_SQL)
def a4(spark: SparkSession, sf: str) -> DataFrame:
    return A.value_counts(hits(spark, sf), "arm_length")


@query("a5_mirror_histogram", "SELECT CAST(least(floor(mirror_identity / 2), 49) AS INTEGER) AS bin, count(*) AS n FROM hits GROUP BY 1", HITS_SQL)
def a5(spark: SparkSession, sf: str) -> DataFrame:
    return A.histogram(hits(spark, sf), "mirror_identity", 50, 0, 100)


@query("a6_score_histogram", """, r AS (SELECT min(total_score) AS a, (max(total_score) - min(total_score)) / 50 AS w FROM hits)
SELECT CAST(least(floor((total_score - a) / w), 49) AS INTEGER) AS bin, count(*) AS n FROM hits, r WHERE total_score IS NOT NULL GROUP BY 1""", HITS_SQL)
def a6(spark: SparkSession, sf: str) -> DataFrame:
    return A.histogram(hits(spark, sf), "total_score")


@query("a7_arm_by_spacer", "SELECT arm_length, spacer_length, count(*) AS n FROM hits GROUP BY 1, 2", HITS_SQL)
def a7(spark: SparkSession, sf: str) -> DataFrame:
    return A.value_counts(hits(spark, sf), "arm_length", "spacer_length")


@query("a8_seeded_sample", "SELECT * EXCLUDE (n), '' AS full_sequence FROM (SELECT *, row_number() OVER (ORDER BY md5(concat_ws(':', 42, id)), id) AS n FROM hits) WHERE n <= 4000", HITS_SQL)
def a8(spark: SparkSession, sf: str) -> DataFrame:
    return A.seeded_sample(hits(spark, sf), 4000, ["id"])


@query("a9_locus_map", """, top AS (SELECT seq_id FROM hits GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 15), r AS (SELECT *, row_number() OVER (PARTITION BY seq_id ORDER BY md5(concat_ws(':', 42, start, "end", arm_length)), start, "end") AS r FROM hits JOIN top USING (seq_id))
SELECT seq_id, (start + "end") / 2 AS mid, least(arm_length, 30) * 0.65::DOUBLE AS size FROM r WHERE r <= 600""", HITS_SQL)
def a9(spark: SparkSession, sf: str) -> DataFrame:
    return A.locus_map(hits(spark, sf))


@query("a10_page", 'SELECT id, seq_id, start, "end" FROM hits ORDER BY seq_id, start, id LIMIT 50 OFFSET 100', HITS_SQL)
def a10(spark: SparkSession, sf: str) -> DataFrame:
    return A.page(hits(spark, sf), 3, 50, ["seq_id", "start", "id"]).select("id", "seq_id", "start", "end")


@query("a10_page_count", "SELECT count(*) AS total, CAST(greatest(1, ceil(count(*) / 50)) AS BIGINT) AS pages FROM hits", HITS_SQL)
def a10_count(spark: SparkSession, sf: str) -> DataFrame:
    return A.page_count(hits(spark, sf), 50)


@query("a12_score_range", ", s AS (SELECT total_score AS v, row_number() OVER (ORDER BY total_score) - 1 AS i, count(*) OVER () AS n FROM hits WHERE total_score IS NOT NULL) SELECT min(v) AS min_score, max(v) FILTER (i = n // 2) AS median_score, max(v) AS max_score FROM s", HITS_SQL)
def a12(spark: SparkSession, sf: str) -> DataFrame:
    return A.score_range(hits(spark, sf))


@query("a15_interval_strings", """SELECT seq_id, string_agg(start || '-' || "end", ';' ORDER BY start, "end") AS intervals FROM hits GROUP BY 1""", HITS_SQL)
def a15(spark: SparkSession, sf: str) -> DataFrame:
    return A.interval_strings(hits(spark, sf))


@query("a16_record_calls", """, per AS (SELECT seq_id, max(total_score) AS s, count(*) AS n FROM hits GROUP BY 1), recs AS (SELECT DISTINCT seq_id FROM inserts)
SELECT seq_id, coalesce(s, 0.0) AS max_score, coalesce(n, 0) AS n_hits, coalesce(n, 0) > 0 AS called FROM recs LEFT JOIN per USING (seq_id)""", f"{HITS_SQL}, {INSERTS_SQL}")
def a16(spark: SparkSession, sf: str) -> DataFrame:
    return A.record_calls(inserts(spark, sf).select("seq_id").distinct(), hits(spark, sf), "seq_id")


@query("a17_best_hit", """SELECT seq_id, arg_max(start, (coalesce(total_score, -1.0), mirror_identity, -start, arm_length, spacer_length)) AS start, max(coalesce(total_score, -1.0)) AS score FROM hits GROUP BY 1""", HITS_SQL)
def a17(spark: SparkSession, sf: str) -> DataFrame:
    h = hits(spark, sf).withColumn("score", F.coalesce("total_score", F.lit(-1.0)))
    return A.best_hit(h, "seq_id", [F.col("score"), F.col("mirror_identity"), -F.col("start"), F.col("arm_length"), F.col("spacer_length")], ["start", "score"])


# Intervals.


@query("g3_best_matches", """, pairs AS (SELECT i.id, i.start, i."end", h.start AS hs, h."end" AS he, h.total_score AS t, least(i."end", h."end") - greatest(i.start, h.start) + 1 AS o FROM inserts i JOIN hits h ON i.seq_id = h.seq_id AND i.start <= h."end" AND i."end" >= h.start),
m AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY CASE WHEN t IS NULL THEN -1 ELSE -t END, o DESC, hs, he, t) AS r, count(*) OVER (PARTITION BY id) AS c FROM pairs WHERE o / ("end" - start + 1) >= 0.5 OR o / (he - hs + 1) >= 0.5)
SELECT inserts.id, coalesce(c, 0) AS n_matches, hs AS best_start, he AS best_end, o AS best_overlap, t AS best_score FROM inserts LEFT JOIN (SELECT * FROM m WHERE r = 1) m USING (id)""", f"{HITS_SQL}, {INSERTS_SQL}")
def g3(spark: SparkSession, sf: str) -> DataFrame:
    return G.best_matches(inserts(spark, sf), hits(spark, sf), 0.5).select("id", "n_matches", "best_start", "best_end", "best_overlap", "best_score")


@query("g4_overlap_sweep", """, best AS (SELECT i.id, max(greatest((least(i."end", h."end") - greatest(i.start, h.start) + 1) / (i."end" - i.start + 1), (least(i."end", h."end") - greatest(i.start, h.start) + 1) / (h."end" - h.start + 1))) AS c FROM inserts i JOIN hits h ON i.seq_id = h.seq_id AND i.start <= h."end" AND i."end" >= h.start GROUP BY 1),
f AS (SELECT unnest([0.25, 0.5, 0.75, 1.0]::DOUBLE[]) AS fraction) SELECT fraction, (SELECT count(*) FROM best WHERE c >= fraction) AS matched FROM f""", f"{HITS_SQL}, {INSERTS_SQL}")
def g4(spark: SparkSession, sf: str) -> DataFrame:
    return G.overlap_sweep(inserts(spark, sf), hits(spark, sf), [0.25, 0.5, 0.75, 1.0])


@query("g5_coverage", """SELECT i.id, coalesce(max(CASE WHEN h.start IS NOT NULL THEN (least(i."end", h."end") - greatest(i.start, h.start) + 1) / (i."end" - i.start + 1) END), 0.0) AS max_coverage FROM inserts i LEFT JOIN hits h ON i.seq_id = h.seq_id AND i.start <= h."end" AND i."end" >= h.start GROUP BY 1""", f"{HITS_SQL}, {INSERTS_SQL}")
def g5(spark: SparkSession, sf: str) -> DataFrame:
    return G.coverage(inserts(spark, sf), hits(spark, sf))


@query("g7_any_overlap", """SELECT id FROM inserts i WHERE EXISTS (SELECT 1 FROM hits h WHERE h.seq_id = i.seq_id AND h.start <= i."end" AND h."end" >= i.start)""", f"{HITS_SQL}, {INSERTS_SQL}")
def g7(spark: SparkSession, sf: str) -> DataFrame:
    return G.any_overlap(inserts(spark, sf), hits(spark, sf)).select("id")


@query("g11_padded_exclusion", """SELECT id FROM inserts i WHERE NOT EXISTS (SELECT 1 FROM hits h WHERE h.seq_id = i.seq_id AND h.start - 5 <= i."end" AND h."end" + 5 >= i.start)""", f"{HITS_SQL}, {INSERTS_SQL}")
def g11(spark: SparkSession, sf: str) -> DataFrame:
    return G.outside(inserts(spark, sf), hits(spark, sf), 5).select("id")


@query("g8_as_of_region", """, b AS (SELECT id, seq_id, start, "end", start // 100 * 100 + 1 AS rs, start // 100 * 100 + 70 AS re0 FROM inserts), regions AS (SELECT DISTINCT seq_id, rs, re0 AS re FROM b)
SELECT i.id, CASE WHEN r.re >= i.start THEN r.rs END AS region_start, CASE WHEN r.re >= i.start THEN r.re END AS region_end FROM inserts i ASOF LEFT JOIN regions r ON i.seq_id = r.seq_id AND i."end" >= r.rs""", INSERTS_SQL)
def g8(spark: SparkSession, sf: str) -> DataFrame:
    i = inserts(spark, sf)
    first = F.floor(F.col("start") / 100) * 100 + 1
    regions = i.select("seq_id", first.alias("start"), (first + 69).alias("end")).distinct()
    return G.as_of_region(i, regions).select("id", "region_start", "region_end")


@query("g9_overlapping_neighbours", """, n AS (SELECT seq_id, lead(start) OVER (PARTITION BY seq_id ORDER BY start, "end") <= "end" AS o FROM inserts) SELECT seq_id, coalesce(bool_or(o), false) AS has_overlap FROM n GROUP BY 1""", INSERTS_SQL)
def g9(spark: SparkSession, sf: str) -> DataFrame:
    return G.overlapping_neighbours(inserts(spark, sf))


@query("g10_compare_sets", """, a AS (SELECT DISTINCT seq_id, start FROM hits), b AS (SELECT DISTINCT seq_id, start FROM inserts)
SELECT (SELECT count(*) FROM (SELECT * FROM a INTERSECT SELECT * FROM b)) AS shared, (SELECT count(*) FROM (SELECT * FROM a EXCEPT SELECT * FROM b)) AS only_a, (SELECT count(*) FROM (SELECT * FROM b EXCEPT SELECT * FROM a)) AS only_b""", f"{HITS_SQL}, {INSERTS_SQL}")
def g10(spark: SparkSession, sf: str) -> DataFrame:
    return G.compare_sets(hits(spark, sf), inserts(spark, sf), ["seq_id", "start"])


@query("g15_bin_counts", "SELECT chrom, CAST((pos - 1) // 200 AS BIGINT) AS bin, count(*) AS n FROM points GROUP BY 1, 2", POINTS_SQL)
def g15(spark: SparkSession, sf: str) -> DataFrame:
    return G.bin_counts(points(spark, sf))


@query("g16_enriched_bins", """, a AS (SELECT chrom, (pos - 1) // 200 AS bin, count(*) AS c, count(*) FILTER (weight < 20) AS n FROM points GROUP BY 1, 2), g AS (SELECT chrom, unnest(range(min(bin), max(bin) + 1)) AS bin FROM a GROUP BY 1),
b AS (SELECT chrom, bin, coalesce(c, 0) AS c, coalesce(n, 0) AS n FROM g LEFT JOIN a USING (chrom, bin)), l AS (SELECT *, 0.1 * greatest(c::DOUBLE, sum(c) OVER (PARTITION BY chrom ORDER BY bin ROWS BETWEEN 25 PRECEDING AND 24 FOLLOWING) / 50, 1.0) AS lam FROM b),
t AS (SELECT *, CASE WHEN n = 0 THEN 1.0 ELSE greatest(0.0, 1 - list_sum(list_transform(range(0, n), lambda i: exp(i * ln(lam) - lam - lgamma(i + 1.0))))) END AS p FROM l),
r AS (SELECT *, p * count(*) OVER () / count(*) OVER (ORDER BY p) AS raw FROM t), q AS (SELECT *, least(1.0, min(raw) OVER (ORDER BY p DESC)) AS q FROM r)
SELECT chrom, CAST(bin AS BIGINT) AS bin, n, round(lam, 6) AS lam, round(p, 9) AS p, round(q, 9) AS q FROM q WHERE q <= 0.01""", POINTS_SQL)
def g16(spark: SparkSession, sf: str) -> DataFrame:
    """Bins of large weights enriched over all points, on a grid without gaps."""
    p = points(spark, sf)
    all_ = G.bin_counts(p)
    grid = all_.groupBy("chrom").agg(F.explode(F.sequence(F.min("bin"), F.max("bin"))).alias("bin"))
    full = lambda c: grid.join(c, ["chrom", "bin"], "left").select("chrom", "bin", F.coalesce("n", F.lit(0)).alias("n"))
    got = G.enriched_bins(full(G.bin_counts(p.where("weight < 20"))), full(all_), 0.1, 1.0)
    return got.select("chrom", "bin", "n", F.round("lam", 6).alias("lam"), F.round("p", 9).alias("p"), F.round("q", 9).alias("q"))


@query("g17_merge_bins", """, b AS (SELECT DISTINCT chrom, (pos - 1) // 200 AS bin FROM points WHERE weight < 5), g AS (SELECT chrom, bin, bin - row_number() OVER (PARTITION BY chrom ORDER BY bin) AS g FROM b)
SELECT chrom, CAST(min(bin) * 200 AS BIGINT) AS start0, CAST((max(bin) + 1) * 200 AS BIGINT) AS end0 FROM g GROUP BY chrom, g""", POINTS_SQL)
def g17(spark: SparkSession, sf: str) -> DataFrame:
    return G.merge_bins(G.bin_counts(points(spark, sf).where("weight < 5")))


@query("g18_rpkm", ", c AS (SELECT chrom, count(*) AS n, max(pos) AS len FROM points GROUP BY 1), t AS (SELECT count(*) AS total FROM points) SELECT chrom, round(n * 1e9 / (len * total), 6) AS rpkm FROM c, t", POINTS_SQL)
def g18(spark: SparkSession, sf: str) -> DataFrame:
    p = points(spark, sf)
    total = p.agg(F.count(F.lit(1)).alias("total"))
    c = p.groupBy("chrom").agg(F.count(F.lit(1)).alias("n"), F.max("pos").alias("len"))
    return c.join(F.broadcast(total)).select("chrom", F.round(G.rpkm(F.col("n"), F.col("len"), F.col("total")), 6).alias("rpkm"))  # one row


@query("g19_signal_means", """, b AS (SELECT chrom, (pos - 1) // 500 AS bin, count(*) AS v FROM points GROUP BY 1, 2), f AS (SELECT DISTINCT chrom, (pos - 1) // 2500 * 5 AS b0 FROM points),
s AS (SELECT f.chrom, f.b0, sum(v) AS t FROM f LEFT JOIN b ON b.chrom = f.chrom AND b.bin >= f.b0 AND b.bin < f.b0 + 5 GROUP BY 1, 2) SELECT chrom, CAST(b0 AS BIGINT) AS b0, CAST(t AS DOUBLE) / 5 AS mean_signal FROM s""", POINTS_SQL)
def g19(spark: SparkSession, sf: str) -> DataFrame:
    p = points(spark, sf)
    b0 = (F.floor((F.col("pos") - 1) / 2500) * 5).alias("b0")
    intervals = p.select("chrom", b0).distinct().withColumn("b1", F.col("b0") + 5)
    ends = intervals.agg(F.max("b1").alias("top"))
    counts = p.groupBy("chrom", F.floor((F.col("pos") - 1) / 500).alias("bin")).agg(F.count(F.lit(1)).alias("v"))
    grid = intervals.select("chrom").distinct().join(F.broadcast(ends)).select("chrom", F.explode(F.sequence(F.lit(0).cast("long"), F.col("top"))).alias("bin"))  # one row
    track = grid.join(counts, ["chrom", "bin"], "left").withColumn("v", F.coalesce("v", F.lit(0)))
    return G.signal_means(intervals, track).select("chrom", "b0", F.col("mean_signal").cast("double").alias("mean_signal"))


@query("g23_injection", """SELECT id, start + coalesce(sum("end" - start + 1) OVER (PARTITION BY seq_id ORDER BY start, id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS new_start FROM inserts""", INSERTS_SQL)
def g23(spark: SparkSession, sf: str) -> DataFrame:
    i = inserts(spark, sf).select("id", "seq_id", F.col("start").alias("pos"), (F.col("end") - F.col("start") + 1).alias("len"))
    return G.injected_places(i).select("id", F.col("start").alias("new_start"))


_WINDOWS = "w{n} AS (SELECT seq_id, pos, (200 - length(translate(w, 'GC', ''))) / 200 AS gc, abs((200 - length(translate(w, 'GA', ''))) - (200 - length(translate(w, 'CT', '')))) / 200 AS asymmetry FROM (SELECT seq_id, pos, upper(substr(seq, pos + 1, 200)) AS w FROM (SELECT seq_id, seq, unnest(range(0, greatest(length(seq) - 200, 0) + 1, {n})) AS pos FROM dna)) WHERE regexp_full_match(w, '[ACGT]{{200}}'))"


@query("g12_windows", f"WITH {DNA_SQL}, {_WINDOWS.format(n=100)} SELECT CAST(round(gc * 200) AS INTEGER) AS gc_bases, count(*) AS n FROM w100 GROUP BY 1")
def g12(spark: SparkSession, sf: str) -> DataFrame:
    return G.windows_of(dna(spark, sf), 200, 100).groupBy(F.round(F.col("gc") * 200).cast("int").alias("gc_bases")).agg(F.count(F.lit(1)).alias("n"))


_CELLS = "CAST(round(gc * 20) AS INTEGER) AS gc_cell, CAST(round(asymmetry * 10) AS INTEGER) AS skew_cell"
_CASES = f"""cases AS (SELECT seq_id || ':' || pos AS id, seq_id, pos AS start, pos + 199 AS "end", {_CELLS} FROM w100 WHERE asymmetry >= 0.3),
pool AS (SELECT seq_id, pos, {_CELLS} FROM w10 WHERE asymmetry < 0.35 AND NOT EXISTS (SELECT 1 FROM cases c WHERE c.seq_id = w10.seq_id AND c.start - 100 <= w10.pos + 199 AND c."end" + 100 >= w10.pos))"""


def cases_and_pool(spark: SparkSession, sf: str, own: bool = False) -> tuple[DataFrame, DataFrame]:
    """Lopsided windows, and windows every ten bases that keep a hundred away from them, with their composition cells; with ``own`` only
    those in a sequence and cell that hold a case, all that controls of the same sequence can come from.
    """
    cells = {"gc_cell": F.round(F.col("gc") * 20).cast("int"), "skew_cell": F.round(F.col("asymmetry") * 10).cast("int")}
    seqs = dna(spark, sf)
    cases = G.windows_of(seqs, 200, 100).where("asymmetry >= 0.3").withColumns(cells).select(F.concat_ws(":", "seq_id", F.col("pos").cast("string")).alias("id"), "seq_id", F.col("pos").alias("start"), (F.col("pos") + 199).alias("end"), *cells)
    pool = G.windows_of(seqs, 200, 10).where("asymmetry < 0.35").withColumns(cells).select(F.concat_ws(":", "seq_id", F.col("pos").cast("string")).alias("id"), "seq_id", "pos", F.col("pos").alias("start"), (F.col("pos") + 199).alias("end"), *cells)
    cases = stored(cases, "cases")  # both are read several times
    if own:
        pool = pool.join(cases.select("seq_id", *cells).distinct(), ["seq_id", *cells], "left_semi")
    return cases, stored(G.outside(pool, cases, 100).select("seq_id", "pos", *cells), "pool")


@query("g13_matched_controls", f"""WITH {DNA_SQL}, {_WINDOWS.format(n=100)}, {_WINDOWS.format(n=10)}, {_CASES},
kept AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY gc_cell, skew_cell, seq_id ORDER BY md5(concat_ws(':', 1, seq_id, pos)), seq_id, pos) AS r FROM pool) WHERE r <= 200),
wide AS (SELECT seq_id, pos, gc_cell, CAST(skew_cell + d AS INTEGER) AS skew_cell, abs(d) AS far FROM (SELECT *, unnest([-2, -1, 0, 1, 2]) AS d FROM kept)), near AS (SELECT *, min(far) OVER (PARTITION BY gc_cell, skew_cell) AS least FROM wide),
num AS (SELECT *, row_number() OVER (PARTITION BY gc_cell, skew_cell ORDER BY md5(concat_ws(':', 1, seq_id, pos)), seq_id, pos) - 1 AS k FROM near WHERE far <= least), size AS (SELECT gc_cell, skew_cell, count(*) AS n, any_value(least) AS widened FROM near WHERE far <= least GROUP BY ALL),
each AS (SELECT id, gc_cell, skew_cell, n, widened, unnest(range(1, 11)) AS draw FROM cases JOIN size USING (gc_cell, skew_cell)), drawn AS (SELECT *, CAST(floor((('0x' || md5(concat_ws(':', 1, id, draw))[1:8])::BIGINT + 0.5) / 4294967296.0 * n) AS BIGINT) AS k FROM each)
SELECT id, gc_cell, skew_cell, CAST(draw AS INTEGER) AS draw, CAST(d.widened AS INTEGER) AS widened, num.seq_id AS control_seq_id, CAST(num.pos AS INTEGER) AS control_pos FROM drawn d JOIN num USING (gc_cell, skew_cell, k)""")
def g13(spark: SparkSession, sf: str) -> DataFrame:
    cases, pool = cases_and_pool(spark, sf)
    return G.matched_controls(cases, pool, ["gc_cell", "skew_cell"], widen="skew_cell")


@query("g14_local_controls", f"""WITH {DNA_SQL}, {_WINDOWS.format(n=100)}, {_WINDOWS.format(n=10)}, {_CASES},
loc AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY md5(concat_ws(':', 1, id, pos)), pos) AS r FROM (SELECT c.id, p.pos FROM cases c JOIN pool p USING (seq_id, gc_cell, skew_cell) WHERE p.pos >= c.start - 1000 AND p.pos < c."end" + 1000)),
num AS (SELECT *, row_number() OVER (PARTITION BY seq_id, gc_cell, skew_cell ORDER BY md5(concat_ws(':', 1, pos)), pos) - 1 AS k FROM pool), size AS (SELECT seq_id, gc_cell, skew_cell, count(*) AS n FROM pool GROUP BY ALL),
asked AS (SELECT id, seq_id, gc_cell, skew_cell, n, unnest(range(0, least(30, n))) AS i FROM cases JOIN size USING (seq_id, gc_cell, skew_cell)), numbered AS (SELECT *, CAST(floor((('0x' || md5(concat_ws(':', 1, id))[1:8])::BIGINT + 0.5) / 4294967296.0 * n) + i AS BIGINT) % n AS k FROM asked)
SELECT id, 'local' AS scope, CAST(pos AS INTEGER) AS pos FROM loc WHERE r <= 30 UNION ALL SELECT id, 'chromosome', CAST(pos AS INTEGER) FROM numbered JOIN num USING (seq_id, gc_cell, skew_cell, k)""")
def g14(spark: SparkSession, sf: str) -> DataFrame:
    cases, pool = cases_and_pool(spark, sf, own=True)
    return G.local_controls(cases, pool, ["gc_cell", "skew_cell"], reach=1000)


# Evaluation.

_CONF = "count(*) FILTER (y = 1 AND p = 1) AS tp, count(*) FILTER (y = 0 AND p = 1) AS fp, count(*) FILTER (y = 0 AND p = 0) AS tn, count(*) FILTER (y = 1 AND p = 0) AS fn"
_CALLED = LABELLED_SQL + ", called AS (SELECT *, CASE WHEN s >= 0.95 THEN 1 ELSE 0 END AS p FROM labelled)"


def called(spark: SparkSession, sf: str) -> DataFrame:
    return labelled(spark, sf).withColumn("p", (F.col("s") >= 0.95).cast("int"))


@query("e1_confusion", f"SELECT lang, {_CONF} FROM called GROUP BY lang", _CALLED)
def e1(spark: SparkSession, sf: str) -> DataFrame:
    return E.confusion(called(spark, sf), by=["lang"])


@query("e2_metrics", f""", c AS (SELECT lang, {_CONF} FROM called GROUP BY lang)
SELECT lang, tp, fp, tn, fn, round(coalesce(tp / nullif(tp + fn, 0), 0), 6) AS sensitivity, round(coalesce(tn / nullif(tn + fp, 0), 0), 6) AS specificity, round(coalesce(2 * tp / nullif(2 * tp + fp + fn, 0), 0), 6) AS f1,
  round(coalesce((tp::DOUBLE * tn - fp::DOUBLE * fn) / nullif(sqrt((tp + fp)::DOUBLE * (tp + fn) * (tn + fp) * (tn + fn)), 0), 0), 6) AS mcc FROM c""", _CALLED)
def e2(spark: SparkSession, sf: str) -> DataFrame:
    m = E.with_metrics(E.confusion(called(spark, sf), by=["lang"]))
    return m.select("lang", *E.COUNTS, *[F.round(c, 6).alias(c) for c in ("sensitivity", "specificity", "f1", "mcc")])


@query("e4_wilson", f""", c AS (SELECT lang, {_CONF} FROM called GROUP BY lang), r AS (SELECT lang, tp AS k, tp + fn AS n FROM c WHERE tp + fn > 0), z AS (SELECT 1.959963985::DOUBLE AS z)
SELECT lang, round(greatest(0, (k / n + z * z / (2 * n) - z * sqrt((k / n) * (1 - k / n) / n + z * z / (4 * n * n))) / (1 + z * z / n)), 6) AS sens_lo,
  round(least(1, (k / n + z * z / (2 * n) + z * sqrt((k / n) * (1 - k / n) / n + z * z / (4 * n * n))) / (1 + z * z / n)), 6) AS sens_hi FROM r, z""", _CALLED)
def e4(spark: SparkSession, sf: str) -> DataFrame:
    w = E.with_wilson(E.confusion(called(spark, sf), by=["lang"])).where("tp + fn > 0")
    return w.select("lang", F.round("sens_lo", 6).alias("sens_lo"), F.round("sens_hi", 6).alias("sens_hi"))


@query("e5_auroc", """, r AS (SELECT lang, y, (rank() OVER (PARTITION BY lang ORDER BY s) + rank() OVER (PARTITION BY lang ORDER BY s DESC)) AS x, count(*) OVER (PARTITION BY lang) AS n,
  rank() OVER (PARTITION BY lang ORDER BY s) + (count(*) OVER (PARTITION BY lang, s) - 1) / 2 AS avg_rank FROM labelled),
t AS (SELECT lang, sum(avg_rank) FILTER (y = 1) AS sr, count(*) FILTER (y = 1) AS p, count(*) FILTER (y = 0) AS q FROM r GROUP BY 1) SELECT lang, round((sr - p * (p + 1) / 2) / nullif(p * q, 0), 6) AS auroc FROM t""", LABELLED_SQL)
def e5(spark: SparkSession, sf: str) -> DataFrame:
    return E.auroc(labelled(spark, sf), by=["lang"]).select("lang", F.round("auroc", 6).alias("auroc"))


@query("e6_roc_points", """, t AS (SELECT DISTINCT s::DOUBLE AS threshold FROM labelled UNION SELECT 'infinity'::DOUBLE UNION SELECT '-infinity'::DOUBLE)
SELECT threshold, count(*) FILTER (y = 1 AND s >= threshold) AS tp, count(*) FILTER (y = 0 AND s >= threshold) AS fp, count(*) FILTER (y = 0 AND s < threshold) AS tn, count(*) FILTER (y = 1 AND s < threshold) AS fn FROM t, labelled GROUP BY 1""", LABELLED_SQL)
def e6(spark: SparkSession, sf: str) -> DataFrame:
    return E.roc_points(labelled(spark, sf)).select("threshold", *E.COUNTS)


@query("e8_best_youden", """, t AS (SELECT DISTINCT s AS threshold FROM labelled WHERE s > 0), r AS (SELECT threshold, count(*) FILTER (y = 1 AND s >= threshold) / count(*) FILTER (y = 1) AS sensitivity, count(*) FILTER (y = 0 AND s < threshold) / count(*) FILTER (y = 0) AS specificity FROM t, labelled GROUP BY 1)
SELECT threshold, round(sensitivity + specificity - 1, 9) AS j, round(sensitivity, 9) AS sensitivity, round(specificity, 9) AS specificity FROM r ORDER BY round(sensitivity + specificity - 1, 12) DESC, threshold LIMIT 1""", LABELLED_SQL)
def e8(spark: SparkSession, sf: str) -> DataFrame:
    b = E.best_youden(E.roc_points(labelled(spark, sf)))
    return b.select("threshold", *[F.round(c, 9).alias(c) for c in ("j", "sensitivity", "specificity")])


_GRID = [0.7, 0.8, 0.9, 0.95, 0.97, 0.99]


def predictions(spark: SparkSession, sf: str) -> DataFrame:
    """Calls of each threshold configuration: (config_id, record_id, y, p)."""
    configs = F.array(*[F.struct(F.lit(i).alias("config_id"), F.lit(t).alias("t")) for i, t in enumerate(_GRID)])
    return labelled(spark, sf).select("record_id", "y", "s", "source", "lang", F.inline(configs)).withColumn("p", (F.col("s") >= F.col("t")).cast("int"))


_PRED = LABELLED_SQL + ", configs AS (SELECT unnest(range(6)) AS config_id, unnest([0.7, 0.8, 0.9, 0.95, 0.97, 0.99]::DOUBLE[]) AS t), pred AS (SELECT CAST(config_id AS INTEGER) AS config_id, record_id, y, source, lang, CASE WHEN s >= t THEN 1 ELSE 0 END AS p FROM labelled, configs)"
_MCC = "round(coalesce((tp::DOUBLE * tn - fp::DOUBLE * fn) / nullif(sqrt((tp + fp)::DOUBLE * (tp + fn) * (tn + fp) * (tn + fn)), 0), 0), 9)"


@query("e11_select_config", f", c AS (SELECT config_id, {_CONF} FROM pred GROUP BY 1) SELECT config_id, tp, fp, tn, fn, {_MCC} AS mcc FROM c ORDER BY mcc DESC, config_id LIMIT 1", _PRED)
def e11(spark: SparkSession, sf: str) -> DataFrame:
    m = E.with_metrics(E.confusion(predictions(spark, sf), by=["config_id"])).withColumn("mcc", F.round("mcc", 9))
    return m.orderBy(F.col("mcc").desc(), "config_id").limit(1).select("config_id", *E.COUNTS, "mcc")


@query("e17_leave_one_group_out", f""", c AS (SELECT source, config_id, {_CONF} FROM pred GROUP BY 1, 2), tr AS (SELECT source, config_id, tp AS otp, fp AS ofp, tn AS otn, fn AS ofn, sum(tp) OVER w - tp AS tp, sum(fp) OVER w - fp AS fp, sum(tn) OVER w - tn AS tn, sum(fn) OVER w - fn AS fn FROM c WINDOW w AS (PARTITION BY config_id)),
r AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY {_MCC} DESC, config_id) AS k FROM tr) SELECT source, config_id, otp AS tp, ofp AS fp, otn AS tn, ofn AS fn FROM r WHERE k = 1""", _PRED)
def e17(spark: SparkSession, sf: str) -> DataFrame:
    return E.leave_one_group_out(predictions(spark, sf).drop("s", "t", "lang"), "source", [F.round("mcc", 9).desc(), F.col("config_id")])


@query("e15_nested_cv", f""", fo AS (SELECT record_id, rep, (row_number() OVER (PARTITION BY rep, y ORDER BY md5(concat_ws(':', rep, record_id)), record_id) - 1) % 5 AS fold FROM (SELECT record_id, y, unnest(range(4)) AS rep FROM labelled)),
c AS (SELECT rep, fold, config_id, {_CONF} FROM pred JOIN fo USING (record_id) GROUP BY 1, 2, 3), tr AS (SELECT rep, fold, config_id, tp AS otp, fp AS ofp, tn AS otn, fn AS ofn, sum(tp) OVER w - tp AS tp, sum(fp) OVER w - fp AS fp, sum(tn) OVER w - tn AS tn, sum(fn) OVER w - fn AS fn FROM c WINDOW w AS (PARTITION BY rep, config_id)),
r AS (SELECT *, row_number() OVER (PARTITION BY rep, fold ORDER BY {_MCC} DESC, config_id) AS k FROM tr), o AS (SELECT rep, CAST(sum(otp) AS BIGINT) AS tp, CAST(sum(ofp) AS BIGINT) AS fp, CAST(sum(otn) AS BIGINT) AS tn, CAST(sum(ofn) AS BIGINT) AS fn FROM r WHERE k = 1 GROUP BY 1)
SELECT CAST(rep AS INTEGER) AS rep, tp, fp, tn, fn, {_MCC} AS mcc FROM o""", _PRED)
def e15(spark: SparkSession, sf: str) -> DataFrame:
    """Out-of-fold metrics of the selected threshold, five folds, four repeats."""
    each = labelled(spark, sf).select("record_id", "y").withColumn("rep", F.explode(F.sequence(F.lit(0), F.lit(3))))
    folds = E.stratified_folds(each, "record_id", ["y"], 5, F.col("rep"), ["rep"]).select("rep", "record_id", "fold")
    got = E.nested_cv(predictions(spark, sf).drop("s", "t", "lang", "source"), folds, [F.round("mcc", 9).desc(), F.col("config_id")])
    return got.select("rep", *E.COUNTS, F.round("mcc", 9).alias("mcc"))


@query("e14_stratified_folds", "SELECT record_id, y, lang, CAST((row_number() OVER (PARTITION BY y, lang ORDER BY md5(concat_ws(':', 0, record_id)), record_id) - 1) % 5 AS INTEGER) AS fold FROM labelled", LABELLED_SQL)
def e14(spark: SparkSession, sf: str) -> DataFrame:
    return E.stratified_folds(labelled(spark, sf), "record_id", ["y", "lang"], 5).select("record_id", "y", "lang", "fold")


@query("e18_collapse", "SELECT source, y, min(record_id) AS record_id FROM labelled GROUP BY 1, 2", LABELLED_SQL)
def e18(spark: SparkSession, sf: str) -> DataFrame:
    return E.collapse(labelled(spark, sf), ["source", "y"], "record_id").select("source", "y", "record_id")


_WEIGHT = " + ".join(f"(u > {t!r}::DOUBLE)::INTEGER" for t in E.POISSON)


def _boot(of: str, cols: str) -> str:
    """Sums of ``cols`` over 200 Poisson resamples of the values of ``of``."""
    return f"""per AS (SELECT {of} AS g, {cols} FROM src GROUP BY 1), u AS (SELECT *, (('0x' || md5(concat_ws(':', 1, g, b))[1:8])::BIGINT + 0.5) / 4294967296.0 AS u FROM (SELECT *, unnest(range(1, 201)) AS b FROM per)), wt AS (SELECT *, {_WEIGHT} AS w FROM u)"""


def _mcc_interval(of: str) -> str:
    return f""", src AS (SELECT * FROM called), {_boot(of, _CONF)}, boots AS (SELECT b, sum(tp * w) AS tp, sum(fp * w) AS fp, sum(tn * w) AS tn, sum(fn * w) AS fn FROM wt WHERE w > 0 GROUP BY 1), m AS (SELECT {_MCC} AS mcc FROM boots), s AS (SELECT list_sort(list(mcc)) AS v FROM m) SELECT v[6] AS lo, v[least(len(v), 196)] AS hi FROM s"""


@query("e19_bootstrap_mcc", _mcc_interval("record_id"), _CALLED)
def e19(spark: SparkSession, sf: str) -> DataFrame:
    boots = E.with_metrics(E.bootstrap_counts(E.indicator_counts(called(spark, sf)), 200))
    return E.percentile_interval(boots.withColumn("mcc", F.round("mcc", 9)), "mcc", 200)


@query("e20_cluster_bootstrap", _mcc_interval("source"), _CALLED)
def e20(spark: SparkSession, sf: str) -> DataFrame:
    boots = E.with_metrics(E.bootstrap_counts(E.indicator_counts(called(spark, sf)), 200, cluster="source"))
    return E.percentile_interval(boots.withColumn("mcc", F.round("mcc", 9)), "mcc", 200)


@query("e22_mcnemar_counts", ", b AS (SELECT y, CASE WHEN s >= 0.9 THEN 1 ELSE 0 END AS a, CASE WHEN n >= 300 THEN 1 ELSE 0 END AS b FROM labelled) SELECT count(*) FILTER (a = y AND b <> y) AS only_a, count(*) FILTER (a <> y AND b = y) AS only_b FROM b", LABELLED_SQL)
def e22(spark: SparkSession, sf: str) -> DataFrame:
    a, b = (F.col("s") >= 0.9).cast("int") == F.col("y"), (F.col("n") >= 300).cast("int") == F.col("y")
    return labelled(spark, sf).agg(F.count_if(a & ~b).alias("only_a"), F.count_if(~a & b).alias("only_b"))


@query("e24_leakage_flags", ", test AS (SELECT * FROM labelled WHERE lang = 'de'), train AS (SELECT * FROM labelled WHERE lang <> 'de') SELECT record_id, source IN (SELECT source FROM train) AS source_in_train FROM test", LABELLED_SQL)
def e24(spark: SparkSession, sf: str) -> DataFrame:
    d = labelled(spark, sf)
    return E.leakage_flags(d.where("lang = 'de'"), d.where("lang <> 'de'"), ["source"]).select("record_id", "source_in_train")


@query("e26_selection_frequency", ", l AS (SELECT 'lang' AS parameter, lang AS value FROM labelled UNION ALL SELECT 'source', source FROM labelled) SELECT parameter, value, count(*) AS n, round(count(*) / sum(count(*)) OVER (PARTITION BY parameter), 9) AS share FROM l GROUP BY 1, 2", LABELLED_SQL)
def e26(spark: SparkSession, sf: str) -> DataFrame:
    return E.selection_frequency(labelled(spark, sf), ["lang", "source"]).withColumn("share", F.round("share", 9))


@query("e30_odds_ratio", f", c AS (SELECT {_CONF} FROM called) SELECT round((tp + 0.5) * (tn + 0.5) / ((fp + 0.5) * (fn + 0.5)), 6) AS odds_ratio, round(sqrt(1 / (tp + 0.5) + 1 / (fp + 0.5) + 1 / (fn + 0.5) + 1 / (tn + 0.5)), 6) AS log_se FROM c", _CALLED)
def e30(spark: SparkSession, sf: str) -> DataFrame:
    o, se = stats.odds_ratio(F.col("tp"), F.col("fp"), F.col("fn"), F.col("tn"))
    return E.confusion(called(spark, sf)).select(F.round(o, 6).alias("odds_ratio"), F.round(se, 6).alias("log_se"))


@query("e31_spearman", ", r AS (SELECT rank() OVER (ORDER BY s) + (count(*) OVER (PARTITION BY s) - 1) / 2 AS a, rank() OVER (ORDER BY n) + (count(*) OVER (PARTITION BY n) - 1) / 2 AS b FROM labelled) SELECT round(corr(a, b), 6) AS rho FROM r", LABELLED_SQL)
def e31(spark: SparkSession, sf: str) -> DataFrame:
    return E.spearman(labelled(spark, sf), "s", "n").select(F.round("rho", 6).alias("rho"))


@query("e31_rank_sum", ", r AS (SELECT y, rank() OVER (ORDER BY n) + (count(*) OVER (PARTITION BY n) - 1) / 2 AS a FROM labelled), t AS (SELECT sum(a) FILTER (y = 1) AS sr, count(*) FILTER (y = 1) AS n1, count(*) FILTER (y = 0) AS n2 FROM r) SELECT sr - n1 * (n1 + 1) / 2 AS u, n1, n2 FROM t", LABELLED_SQL)
def e31_ranks(spark: SparkSession, sf: str) -> DataFrame:
    return E.rank_sum(labelled(spark, sf), "y", "n").select("u", "n1", "n2")


@query("e32_quartile_means", ", q AS (SELECT quantile_cont(s, 0.25) AS a, quantile_cont(s, 0.5) AS b, quantile_cont(s, 0.75) AS c FROM labelled) SELECT CAST(1 + (s > a)::INT + (s > b)::INT + (s > c)::INT AS INTEGER) AS quartile, round(avg(n), 6) AS mean, count(*) AS n FROM labelled, q GROUP BY 1", LABELLED_SQL)
def e32(spark: SparkSession, sf: str) -> DataFrame:
    return E.quartile_means(labelled(spark, sf), "s", "n").select("quartile", F.round("mean", 6).alias("mean"), "n")


@query("e33_superiority", ", p AS (SELECT c.record_id, avg(CASE WHEN c.n > d.n THEN 1.0 WHEN c.n = d.n THEN 0.5 ELSE 0.0 END) AS p FROM labelled c JOIN labelled d ON c.source = d.source AND d.y = 0 WHERE c.y = 1 GROUP BY 1) SELECT round(avg(p), 6) AS superiority, count(*) AS cases FROM p", LABELLED_SQL)
def e33(spark: SparkSession, sf: str) -> DataFrame:
    d = labelled(spark, sf)
    return E.superiority(d.where("y = 1"), d.where("y = 0"), "source", "n").select(F.round("superiority", 6).alias("superiority"), "cases")


@query("a18_false_positives", ", c AS (SELECT lang, CASE WHEN s >= 0.9 THEN 1 ELSE 0 END AS t1, CASE WHEN n >= 300 THEN 1 ELSE 0 END AS t2 FROM labelled WHERE y = 0) SELECT lang, CAST(sum(t1) AS BIGINT) AS by_marks, CAST(sum(t2) AS BIGINT) AS by_length FROM c GROUP BY 1", LABELLED_SQL)
def a18(spark: SparkSession, sf: str) -> DataFrame:
    d = labelled(spark, sf).withColumn("by_marks", (F.col("s") >= 0.9).cast("int")).withColumn("by_length", (F.col("n") >= 300).cast("int"))
    return E.false_positives_by_class(d, "lang", ["by_marks", "by_length"])


@query("e36_roc_band", f""", u AS (SELECT b, s, y, (('0x' || md5(concat_ws(':', 1, record_id, b))[1:8])::BIGINT + 0.5) / 4294967296.0 AS u FROM (SELECT *, unnest(range(1, 101)) AS b FROM labelled) WHERE s IS NOT NULL), wt AS (SELECT *, {_WEIGHT} AS w FROM u),
per AS (SELECT b, s, sum(CASE WHEN y = 1 THEN w ELSE 0 END) AS pos, sum(CASE WHEN y <> 1 THEN w ELSE 0 END) AS neg FROM wt GROUP BY 1, 2), pts AS (SELECT b, sum(pos) OVER d / nullif(sum(pos) OVER (PARTITION BY b), 0) AS tpr, sum(neg) OVER d / nullif(sum(neg) OVER (PARTITION BY b), 0) AS fpr FROM per WINDOW d AS (PARTITION BY b ORDER BY s DESC)),
at_ AS (SELECT b, x, coalesce(max(CASE WHEN fpr <= x THEN tpr END), 0.0) AS tpr FROM (SELECT *, unnest([0.0, 0.1, 0.25, 0.5, 0.75, 1.0]::DOUBLE[]) AS x FROM pts) GROUP BY 1, 2)
SELECT x, round(quantile_cont(tpr, 0.025), 9) AS lo, round(quantile_cont(tpr, 0.5), 9) AS mid, round(quantile_cont(tpr, 0.975), 9) AS hi FROM at_ GROUP BY 1""", LABELLED_SQL)
def e36(spark: SparkSession, sf: str) -> DataFrame:
    band = E.roc_band(labelled(spark, sf), 100, [0.0, 0.1, 0.25, 0.5, 0.75, 1.0])
    return band.select("x", *[F.round(c, 9).alias(c) for c in ("lo", "mid", "hi")])


@query("e3_rates", f", c AS (SELECT lang, {_CONF} FROM called GROUP BY lang) SELECT lang, round(coalesce(tp / nullif(tp + fp, 0), 0), 6) AS precision, round(coalesce(tn / nullif(tn + fn, 0), 0), 6) AS npv, round((tp + tn) / (tp + fp + tn + fn), 6) AS accuracy FROM c", _CALLED)
def e3(spark: SparkSession, sf: str) -> DataFrame:
    m = E.with_metrics(E.confusion(called(spark, sf), by=["lang"]))
    return m.select("lang", *[F.round(c, 6).alias(c) for c in ("precision", "npv", "accuracy")])


@query("e4_wilson_specificity", f""", c AS (SELECT lang, {_CONF} FROM called GROUP BY lang), r AS (SELECT lang, tn AS k, tn + fp AS n FROM c WHERE tn + fp > 0), z AS (SELECT 1.959963985::DOUBLE AS z)
SELECT lang, round(greatest(0, (k / n + z * z / (2 * n) - z * sqrt((k / n) * (1 - k / n) / n + z * z / (4 * n * n))) / (1 + z * z / n)), 6) AS spec_lo,
  round(least(1, (k / n + z * z / (2 * n) + z * sqrt((k / n) * (1 - k / n) / n + z * z / (4 * n * n))) / (1 + z * z / n)), 6) AS spec_hi FROM r, z""", _CALLED)
def e4_spec(spark: SparkSession, sf: str) -> DataFrame:
    w = E.with_wilson(E.confusion(called(spark, sf), by=["lang"])).where("tn + fp > 0")
    return w.select("lang", F.round("spec_lo", 6).alias("spec_lo"), F.round("spec_hi", 6).alias("spec_hi"))


@query("e7_youden_of_all_points", """, t AS (SELECT DISTINCT s::DOUBLE AS threshold FROM labelled UNION SELECT 'infinity'::DOUBLE UNION SELECT '-infinity'::DOUBLE), r AS (SELECT threshold, count(*) FILTER (y = 1 AND s >= threshold) / count(*) FILTER (y = 1) AS a, count(*) FILTER (y = 0 AND s < threshold) / count(*) FILTER (y = 0) AS b FROM t, labelled GROUP BY 1)
SELECT threshold, round(a + b - 1, 9) AS j FROM r ORDER BY round(a + b - 1, 12) DESC, threshold LIMIT 1""", LABELLED_SQL)
def e7(spark: SparkSession, sf: str) -> DataFrame:
    return E.best_youden(E.roc_points(labelled(spark, sf)), positive_only=False).select("threshold", F.round("j", 9).alias("j"))


@query("e11_select_by_six_keys", f", c AS (SELECT config_id, {_CONF} FROM pred GROUP BY 1) SELECT config_id, {_MCC} AS mcc FROM c ORDER BY {_MCC} DESC, tp / (tp + fn) DESC, config_id % 2, config_id // 2 DESC, config_id % 3, config_id LIMIT 1", _PRED)
def e11_six(spark: SparkSession, sf: str) -> DataFrame:
    """The tie-break order: MCC, sensitivity, fewer filters, larger arms, smaller spacers, fewer mismatches."""
    c = F.col("config_id")
    order = [F.round("mcc", 9).desc(), F.col("sensitivity").desc(), c % 2, F.floor(c / 2).desc(), c % 3, c]
    m = E.with_metrics(E.confusion(predictions(spark, sf), by=["config_id"]))
    return E.select_config(m.withColumn("all", F.lit(1)), order, ["all"]).select("config_id", F.round("mcc", 9).alias("mcc"))


@query("e12_tool_grid", f", c AS (SELECT source, config_id, {_CONF} FROM pred GROUP BY 1, 2), r AS (SELECT source, config_id, row_number() OVER (PARTITION BY source ORDER BY {_MCC} DESC, config_id) AS k FROM c) SELECT source, config_id FROM r WHERE k = 1", _PRED)
def e12(spark: SparkSession, sf: str) -> DataFrame:
    """Per tool, here a source, the first configuration of the highest MCC."""
    m = E.with_metrics(E.confusion(predictions(spark, sf), by=["source", "config_id"]))
    return E.select_config(m, [F.round("mcc", 9).desc(), F.col("config_id")], ["source"]).select("source", "config_id")


_SPLIT = "SELECT record_id, y, seed, row_number() OVER (PARTITION BY seed, y ORDER BY md5(concat_ws(':', seed, record_id)), record_id) <= round(count(*) OVER (PARTITION BY seed, y) * 0.7) AS train FROM (SELECT record_id, y, unnest(range({n})) AS seed FROM labelled)"


@query("e13_stratified_split", f", t AS ({_SPLIT.format(n=1)}) SELECT record_id, train FROM t", LABELLED_SQL)
def e13(spark: SparkSession, sf: str) -> DataFrame:
    return E.stratified_split(labelled(spark, sf), "record_id", ["y"], 0.7).select("record_id", "train")


@query("e25_split_stability", f""", sp AS ({_SPLIT.format(n=10)}), c AS (SELECT seed, train, config_id, {_CONF} FROM pred JOIN (SELECT record_id, seed, train FROM sp) USING (record_id) GROUP BY 1, 2, 3), m AS (SELECT seed, train, config_id, {_MCC} AS mcc FROM c),
ch AS (SELECT seed, config_id FROM (SELECT *, row_number() OVER (PARTITION BY seed ORDER BY mcc DESC, config_id) AS k FROM m WHERE train) WHERE k = 1) SELECT CAST(seed AS INTEGER) AS seed, config_id, h.mcc, d.mcc AS default_mcc, round(h.mcc - d.mcc, 9) AS delta FROM ch JOIN m h USING (seed, config_id) JOIN m d USING (seed) WHERE NOT h.train AND NOT d.train AND d.config_id = 2""", _PRED)
def e25(spark: SparkSession, sf: str) -> DataFrame:
    each = labelled(spark, sf).select("record_id", "y", F.explode(F.sequence(F.lit(0), F.lit(9))).alias("seed"))
    splits = E.stratified_split(each, "record_id", ["seed", "y"], 0.7, F.col("seed")).select("seed", "record_id", "train")
    got = E.split_stability(predictions(spark, sf).drop("s", "t", "lang", "source"), splits, [F.round("mcc", 9).desc(), F.col("config_id")], 2)
    return got.select("seed", "config_id", *[F.round(c, 9).alias(c) for c in ("mcc", "default_mcc", "delta")])


@query("e16_group_assignment", ", r AS (SELECT record_id, CASE WHEN record_id % 3 = 0 THEN record_id - 1 END AS source_record, CASE WHEN record_id % 2 = 0 THEN source ELSE '' END AS family_id FROM labelled) SELECT a.record_id, coalesce(nullif(b.family_id, ''), nullif(a.family_id, ''), CAST(a.record_id AS VARCHAR)) AS group_id FROM r a LEFT JOIN r b ON b.record_id = a.source_record", LABELLED_SQL)
def e16(spark: SparkSession, sf: str) -> DataFrame:
    i = F.col("record_id")
    r = labelled(spark, sf).select("record_id", F.when(i % 3 == 0, i - 1).alias("source_record"), F.when(i % 2 == 0, F.col("source")).otherwise("").alias("family_id"))
    return E.assign_groups(r).select("record_id", "group_id")


_PAIR = LABELLED_SQL + ", src AS (SELECT *, CASE WHEN s >= 0.95 THEN 1 ELSE 0 END AS p, CASE WHEN n >= 300 THEN 1 ELSE 0 END AS q FROM labelled)"
_PAIR_COLS = _CONF.replace(" AS ", " AS a_") + ", " + _CONF.replace("p = ", "q = ").replace(" AS ", " AS b_")


def _pair_mcc(t: str) -> str:
    out = _MCC.replace("round(", "", 1).rsplit(", 9)", 1)[0]
    for c in ("tp", "fp", "tn", "fn"):
        out = out.replace(c, f"{t}_{c}")
    return out


@query("e21_paired_difference", f", {_boot('record_id', _PAIR_COLS)}, boots AS (SELECT b, " + ", ".join(f"sum({t}_{c} * w) AS {t}_{c}" for t in "ab" for c in ("tp", "fp", "tn", "fn")) + f" FROM wt WHERE w > 0 GROUP BY 1) SELECT CAST(b AS INTEGER) AS b, round({_pair_mcc('a')} - {_pair_mcc('b')}, 9) AS d_mcc, round(a_tp / (a_tp + a_fn) - b_tp / (b_tp + b_fn), 9) AS d_sensitivity, round(a_tn / (a_tn + a_fp) - b_tn / (b_tn + b_fp), 9) AS d_specificity FROM boots WHERE a_tp + a_fn > 0 AND a_tn + a_fp > 0", _PAIR)
def e21(spark: SparkSession, sf: str) -> DataFrame:
    """Differences of two calls on the same 200 resamples."""
    both = called(spark, sf).withColumn("q", (F.col("n") >= 300).cast("int"))
    return E.paired_difference(both, "p", "q", 200).select("b", *[F.round(c, 9).alias(c) for c in ("d_mcc", "d_sensitivity", "d_specificity")])


@query("e23_verdict", "SELECT lo, hi, p, CASE WHEN lo > 0 AND p < 0.05 THEN 'better' WHEN hi < 0 AND p < 0.05 THEN 'worse' WHEN lo > 0 OR hi < 0 THEN 'inconclusive' ELSE 'equivalent' END AS verdict FROM (SELECT l_discount - 0.05 AS lo, l_tax - 0.03 AS hi, l_quantity / 500 AS p FROM lineitem)")
def e23(spark: SparkSession, sf: str) -> DataFrame:
    t = spark.read.parquet(f"{sf}/lineitem.parquet").select((F.col("l_discount") - 0.05).alias("lo"), (F.col("l_tax") - 0.03).alias("hi"), (F.col("l_quantity") / 500).alias("p"))
    return t.withColumn("verdict", E.verdict(F.col("lo"), F.col("hi"), F.col("p")))


@query("e24_nearest_train", ", m AS (SELECT doc_id * 1000 + pos AS record_id, upper(full_sequence) AS s FROM motifs), p AS (SELECT a.record_id, b.record_id AS nearest, hamming(a.s, b.s) AS d, length(a.s) AS n FROM m a JOIN m b ON length(a.s) = length(b.s) WHERE a.record_id % 50 = 0 AND b.record_id % 50 <> 0), b AS (SELECT record_id, min((d, nearest, n)) AS m FROM p GROUP BY 1) SELECT m.record_id, b.m[2] AS nearest, 1 - b.m[1] / b.m[3] AS identity FROM m LEFT JOIN b USING (record_id) WHERE m.record_id % 50 = 0", MOTIFS_SQL)
def e24_nearest(spark: SparkSession, sf: str) -> DataFrame:
    """The search as a stated query set: records whose id is divisible by 50 against all others."""
    m = stored(motifs(spark, sf, streamed=True).select((F.col("doc_id") * 1000 + F.col("pos")).alias("record_id"), F.col("full_sequence").alias("seq")), "motifs")  # both sides read it
    return E.nearest_train(m.where("record_id % 50 = 0"), m.where("record_id % 50 <> 0")).select("record_id", "nearest", "identity")


@query("e29_ratio_of_means", f", src AS (SELECT * FROM labelled), {_boot('record_id', 'sum(n) AS a, count(*) AS c')}, boots AS (SELECT b, sum(a * w)::DOUBLE / sum(c * w) AS r FROM wt WHERE w > 0 GROUP BY 1), s AS (SELECT list_sort(list(r)) AS v FROM boots) SELECT round(v[6], 6) AS lo, round(v[196], 6) AS hi FROM s", LABELLED_SQL)
def e29(spark: SparkSession, sf: str) -> DataFrame:
    d = labelled(spark, sf).withColumn("one", F.lit(1))
    return E.ratio_of_means(d, "n", "one", 200).select(F.round("lo", 6).alias("lo"), F.round("hi", 6).alias("hi"))


@query("e34_cohort_checks", ", r AS (SELECT record_id, lang AS seq, y AS label FROM labelled WHERE record_id % 7 <> 0 UNION ALL SELECT record_id, upper(source), 5 FROM labelled WHERE record_id % 11 = 0), g AS (SELECT record_id, count(*) AS k FROM r GROUP BY 1) SELECT count(*) FILTER (k > 1) AS repeated, count(*) FILTER (k IS NULL) AS missing, count(*) FILTER (e.record_id IS NULL) AS unexpected FROM g FULL JOIN (SELECT record_id FROM labelled WHERE record_id % 5 <> 0) e USING (record_id)", LABELLED_SQL)
def e34(spark: SparkSession, sf: str) -> DataFrame:
    d = labelled(spark, sf)
    r = d.where("record_id % 7 <> 0").select("record_id", F.col("lang").alias("seq"), F.col("y").alias("label")).unionByName(d.where("record_id % 11 = 0").select("record_id", F.upper("source").alias("seq"), F.lit(5).alias("label")))
    return E.validate_cohort(r, d.where("record_id % 5 <> 0").select("record_id", F.col("lang").alias("seq"))).select("repeated", "missing", "unexpected")


@query("g20_analysed_universe", """SELECT id FROM inserts i WHERE NOT EXISTS (SELECT 1 FROM hits h WHERE h.seq_id = i.seq_id AND h.start <= (i.start + i."end") // 2 + 50 AND h."end" >= (i.start + i."end") // 2 - 50)""", f"{HITS_SQL}, {INSERTS_SQL}")
def g20(spark: SparkSession, sf: str) -> DataFrame:
    return G.analysed_universe(inserts(spark, sf), hits(spark, sf), 50).select("id")


@query("g21_selectivity", """, b AS (SELECT i.id, i.id % 2 = 0 AS plus, max(h.total_score) AS best, count(h.start) AS n FROM inserts i LEFT JOIN hits h ON h.seq_id = i.seq_id AND h.start <= i."end" AND h."end" >= i.start GROUP BY 1, 2),
c AS (SELECT count(*) FILTER (n > 0 AND plus) AS hit_plus, count(*) FILTER (n > 0 AND NOT plus) AS hit_minus, count(*) FILTER (n = 0 AND plus) AS no_hit_plus, count(*) FILTER (n = 0 AND NOT plus) AS no_hit_minus, round(avg(best) FILTER (plus), 6) AS score_plus, round(avg(best) FILTER (NOT plus), 6) AS score_minus FROM b)
SELECT *, round((hit_plus + 0.5) * (no_hit_minus + 0.5) / ((hit_minus + 0.5) * (no_hit_plus + 0.5)), 6) AS odds_ratio FROM c""", f"{HITS_SQL}, {INSERTS_SQL}")
def g21(spark: SparkSession, sf: str) -> DataFrame:
    got = G.selectivity(inserts(spark, sf), hits(spark, sf), F.col("id") % 2 == 0)
    return got.withColumns({c: F.round(c, 6) for c in ("score_plus", "score_minus", "odds_ratio")})


@query("g22_recall", """, m AS (SELECT count(*) AS overlapped FROM inserts i WHERE EXISTS (SELECT 1 FROM hits h WHERE h.seq_id = i.seq_id AND h.start <= i."end" AND h."end" >= i.start)) SELECT count(*) AS called, any_value(overlapped) AS overlapped, any_value(overlapped)::DOUBLE / count(*) AS fraction FROM inserts, m""", f"{HITS_SQL}, {INSERTS_SQL}")
def g22(spark: SparkSession, sf: str) -> DataFrame:
    return G.recall(inserts(spark, sf), hits(spark, sf))


@query("g24_manifest", f"WITH {DNA_SQL}, m AS (SELECT record_ix AS id, seq_id, CAST(1 + record_ix % 20 AS BIGINT) AS start, substr(seq, CAST(1 + record_ix % 20 + CASE WHEN record_ix % 4 = 0 THEN 1 ELSE 0 END AS BIGINT), 30) AS sequence FROM dna) SELECT id, substr(seq, start, length(sequence)) = sequence AS found, count(*) OVER (PARTITION BY m.seq_id, start) = 1 AS \"unique\" FROM m JOIN dna USING (seq_id)")
def g24(spark: SparkSession, sf: str) -> DataFrame:
    records = dna(spark, sf)
    i = F.col("record_ix")
    shift = F.when(i % 4 == 0, 1).otherwise(0)
    m = records.select(i.alias("id"), "seq_id", (1 + i % 20).alias("start"), F.substring("seq", (1 + i % 20 + shift).cast("int"), F.lit(30)).alias("sequence"))
    return G.verify_manifest(m, records).select("id", "found", "unique")


@query("w3_isolated", """, m AS (SELECT *, (id % 10) / 10 AS mappability, CAST(8 + id % 15 AS INTEGER) AS arm_length FROM inserts WHERE id % 3 = 0), o AS (SELECT seq_id, start, "end" FROM inserts WHERE id % 3 = 1), t AS (SELECT seq_id, start, start AS "end" FROM inserts WHERE id % 97 = 2)
SELECT id, CAST((arm_length >= 8)::INT + (arm_length >= 10)::INT + (arm_length >= 12)::INT + (arm_length >= 15)::INT + (arm_length >= 20)::INT AS INTEGER) AS arm_class FROM m WHERE mappability >= 0.5
  AND NOT EXISTS (SELECT 1 FROM o WHERE o.seq_id = m.seq_id AND o.start - 100 <= m."end" AND o."end" + 100 >= m.start) AND NOT EXISTS (SELECT 1 FROM t WHERE t.seq_id = m.seq_id AND t.start - 2000 <= m."end" AND t."end" + 2000 >= m.start)""", INSERTS_SQL)
def w3(spark: SparkSession, sf: str) -> DataFrame:
    i = inserts(spark, sf)
    m = i.where("id % 3 = 0").withColumn("mappability", F.col("id") % 10 / 10).withColumn("arm_length", (8 + F.col("id") % 15).cast("int"))
    return G.isolated(m, i.where("id % 3 = 1"), i.where("id % 97 = 2").withColumn("end", F.col("start")), "mappability").select("id", "arm_class")


@query("w4_same_hits", ", a AS (SELECT * FROM hits), b AS (SELECT * REPLACE (ga_pct + CASE WHEN start % 5 = 0 THEN 1 ELSE 0.00001 END AS ga_pct) FROM hits WHERE start % 7 <> 0) SELECT count(*) FILTER (b.id IS NOT NULL AND a.start % 5 <> 0) AS shared, count(*) FILTER (b.id IS NULL OR a.start % 5 = 0) AS only_a, count(*) FILTER (b.id IS NOT NULL AND a.start % 5 = 0) AS only_b FROM a LEFT JOIN b USING (id)", HITS_SQL)
def w4(spark: SparkSession, sf: str) -> DataFrame:
    h = hits(spark, sf)
    return G.same_hits(h, h.where("start % 7 <> 0").withColumn("ga_pct", F.col("ga_pct") + F.when(F.col("start") % 5 == 0, 1.0).otherwise(0.00001)))


# Sources and sinks: what is written is read back.


def _folder(spark: SparkSession, name: str) -> str:
    """A new place for files that all executors can reach."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        if spark.sparkContext.master.split("[")[0] != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        base = tempfile.mkdtemp(prefix="mirrorloom-")  # one process, as in tests
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


@query("s1_fasta_round_trip", f"WITH {DNA_SQL} SELECT seq_id, upper(seq) AS seq, CAST(1 AS BIGINT) AS seq_offset FROM dna WHERE length(seq) > 0")
def s1(spark: SparkSession, sf: str) -> DataFrame:
    path = _folder(spark, "fasta")
    write_fasta(dna(spark, sf), path)
    return read_fasta(spark, path).select("seq_id", "seq", "seq_offset")


@query("s1_scan_by_ranges", Q.p1_sql(ScanParams(), columns='seq_id, start, "end", arm_length, spacer_length, total_score'))
def s1_ranges(spark: SparkSession, sf: str) -> DataFrame:
    """All documents as FASTA, scanned by ranges of a mebibyte that do not care where records begin."""
    path = _folder(spark, "fasta")
    write_fasta(dna(spark, sf), path)
    return P.scan_fasta(spark, path, range_bytes=1 << 20).select("seq_id", "start", "end", "arm_length", "spacer_length", "total_score")


@query("s4_named_fasta", f"WITH {DNA_SQL} SELECT seq_id, upper(seq) AS seq FROM dna WHERE length(seq) > 0 AND record_ix < 10")
def s4(spark: SparkSession, sf: str) -> DataFrame:
    path = _folder(spark, "fasta")
    write_fasta(dna(spark, sf), path)
    return read_fasta_named(spark, path, [f"d{i}" for i in range(10)]).select("seq_id", "seq")


@query("s6_hits_round_trip", Q.p1_sql(ScanParams(), columns='seq_id, start, "end", arm_length, spacer_length, is_perfect, spacer, total_score'))
def s6(spark: SparkSession, sf: str) -> DataFrame:
    path = _folder(spark, "hits")
    write_hits(P.scan(dna(spark, sf)), path)
    return tables.read_hits(spark, path).select("seq_id", "start", "end", "arm_length", "spacer_length", "is_perfect", "spacer", "total_score")


@query("s7_bed_round_trip", 'SELECT seq_id AS chrom, start - 1 AS start0, "end" AS end0 FROM hits', HITS_SQL)
def s7(spark: SparkSession, sf: str) -> DataFrame:
    path = _folder(spark, "bed")
    G.to_bed(hits(spark, sf)).select(F.concat_ws("\t", "chrom", F.col("start0").cast("string"), F.col("end0").cast("string")).alias("value")).write.option("compression", "gzip").text(path)
    return tables.read_bed(spark, path).select("chrom", "start0", "end0")


@query("n2_strong_mirror", f"""WITH {_BENCH}, c AS (SELECT record_ix, upper(seq) AS s FROM dna), l AS (SELECT record_ix, s, unnest(range(8, length(s) - 7)) AS l FROM c WHERE length(s) >= 16), p AS (SELECT *, unnest(range(0, 13)) AS sp FROM l), k AS (SELECT record_ix, s, l, l + sp + 1 AS r, unnest(range(8, least(l, length(s) - l - sp) + 1)) AS k FROM p WHERE l + sp + 8 <= length(s)),
b AS (SELECT record_ix, max((1 - hamming(reverse(s[l - k + 1:l]), s[r:r + k - 1]) / k, k)) AS m FROM k GROUP BY 1) SELECT c.record_ix, coalesce(round(m[1], 9), 0) AS identity, CAST(coalesce(m[2], 0) AS INTEGER) AS arm, coalesce(m[1], 0) >= 0.8 AS strong FROM c LEFT JOIN b USING (record_ix)""")
def n2(spark: SparkSession, sf: str) -> DataFrame:
    """The best mirror of each passage, and whether it is a strong one."""
    s = passages(spark, sf).select("record_ix", F.upper("seq").alias("seq"))
    return s.select("record_ix", N.best_mirror_column(F.col("seq")).alias("m"), N.strong_mirror_column(F.col("seq")).alias("strong")).select("record_ix", F.round("m.identity", 9).alias("identity"), "m.arm", "strong")


@query("g10_covered_sets", """, a AS (SELECT DISTINCT seq_id, start, "end" FROM hits), b AS (SELECT DISTINCT seq_id, start, "end" FROM inserts), c AS (SELECT (SELECT count(*) FROM a) AS a_loci, (SELECT count(*) FROM b) AS b_loci, (SELECT count(*) FROM (SELECT * FROM a INTERSECT SELECT * FROM b)) AS shared,
(SELECT count(*) FROM a WHERE EXISTS (SELECT 1 FROM b WHERE b.seq_id = a.seq_id AND b.start <= a."end" AND b."end" >= a.start)) AS a_covered, (SELECT count(*) FROM b WHERE NOT EXISTS (SELECT 1 FROM a WHERE b.seq_id = a.seq_id AND b.start <= a."end" AND b."end" >= a.start)) AS b_alone) SELECT *, a_covered::DOUBLE / a_loci AS a_covered_fraction FROM c""", f"{HITS_SQL}, {INSERTS_SQL}")
def g10_covered(spark: SparkSession, sf: str) -> DataFrame:
    return G.coverage_of_sets(hits(spark, sf), inserts(spark, sf))


@query("g18_log2_enrichment", ", c AS (SELECT chrom, count(*) FILTER (weight < 20) AS a, count(*) AS b, max(pos) AS len FROM points GROUP BY 1), t AS (SELECT sum(a) AS ta, sum(b) AS tb FROM c) SELECT chrom, round(log2((a * 1e9 / (len * ta) + 0.5) / (b * 1e9 / (len * tb) + 0.5)), 6) AS enrichment FROM c, t", POINTS_SQL)
def g18_log2(spark: SparkSession, sf: str) -> DataFrame:
    c = points(spark, sf).groupBy("chrom").agg(F.count_if(F.col("weight") < 20).alias("a"), F.count(F.lit(1)).alias("b"), F.max("pos").alias("len"))
    t = c.agg(F.sum("a").alias("ta"), F.sum("b").alias("tb"))
    both = c.join(F.broadcast(t))  # one row
    return both.select("chrom", F.round(G.log2_enrichment(G.rpkm(F.col("a"), F.col("len"), F.col("ta")), G.rpkm(F.col("b"), F.col("len"), F.col("tb"))), 6).alias("enrichment"))


@query("e33_placebo", ", d AS (SELECT source, n, row_number() OVER (PARTITION BY source ORDER BY md5(concat_ws(':', 1, record_id)), record_id) AS r FROM labelled WHERE y = 0), p AS (SELECT c.source, avg(CASE WHEN c.n > o.n THEN 1.0 WHEN c.n = o.n THEN 0.5 ELSE 0.0 END) AS p FROM d c JOIN d o ON c.source = o.source AND c.r = 1 AND o.r > 1 GROUP BY 1) SELECT round(avg(p), 6) AS superiority, count(*) AS cases FROM p", LABELLED_SQL)
def e33_placebo(spark: SparkSession, sf: str) -> DataFrame:
    return E.placebo(labelled(spark, sf).where("y = 0"), "source", "n", "record_id").select(F.round("superiority", 6).alias("superiority"), "cases")
