"""Scan pipelines: chains of DataFrame stages in the order that gives the documented results.

Composition filters come before overlap removal, so that a long hit that fails cannot hide a shorter one that passes.
Under greedy selection homopolymers go after it, under selection by score before.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from ..functions.scoring import MODELS, with_model_scores, with_scores
from ..operators import detect as D
from ..operators import filters as C
from ..operators.overlap import remove_overlaps
from ..operators.ranks import stored
from ..params import ScanParams
from ..schema import HIT_COLUMNS, SCORES

ABLATION = ("detection", "composition", "pairing", "pairing_stacking", "complete")


def records_of(spark: SparkSession, seq: str, seq_id: str = "", seq_offset: int = 1) -> DataFrame:
    """One record from a string."""
    return spark.createDataFrame([(0, seq_id, seq, seq_offset)], "record_ix long, seq_id string, seq string, seq_offset long")


def detect_candidates(records: DataFrame, p: ScanParams | None = None, size: int = D.CHUNK, rebalance: bool = False) -> DataFrame:
    """Detection, inward extension and geometry dedup, without filters or selection."""
    p = p or ScanParams()
    return D.materialise(D.raw_candidates(records, p, True, size, rebalance))


def composition(hits: DataFrame, p: ScanParams) -> DataFrame:
    """The composition filters as predicates, for hits from elsewhere; scans apply them to prefix counts in the kernel."""
    if p.at_threshold is not None:
        hits = C.filter_at_content(hits, p.at_threshold)
    return C.filter_g_rate(hits, p.min_g_rate) if p.min_g_rate else hits


def _finish(hits: DataFrame) -> DataFrame:
    missing = [c.split() for c in SCORES.split(", ") if c.split()[0] not in hits.columns]
    hits = hits.withColumns({n: F.lit("" if n == "putative_triplex" else None).cast(t) for n, t in missing})
    return hits.select("record_ix", *HIT_COLUMNS)


def scan(records: DataFrame, p: ScanParams | None = None, size: int = D.CHUNK, rebalance: bool = False, per: tuple[str, ...] = ("record_ix",), by_island: bool = False) -> DataFrame:
    """The whole scan of a table of records.  ``per`` names what overlap removal works within; ``by_island`` suits few long records."""
    p = p or ScanParams()
    return after_detection(D.materialise(D.raw_candidates(records, p, True, size, rebalance, composed=True)), p, per, by_island)


def _without_overlaps(hits: DataFrame, strategy: str, per: tuple[str, ...], by_island: bool = False) -> DataFrame:
    """:func:`remove_overlaps` of materialised hits; their arms are cut again afterwards and do not go through the shuffle and the workers."""
    parts = D.parts()
    return remove_overlaps(hits.drop(*parts), strategy, per, by_island).withColumns(parts)


def after_detection(hits: DataFrame, p: ScanParams, per: tuple[str, ...] = ("record_ix",), by_island: bool = False) -> DataFrame:
    """Overlap removal, scores and homopolymers in the order of the parameters, for hits that the composition filters have passed."""
    if p.remove_overlaps and p.overlap_strategy != "greedy":
        # scored where they are found: arms of one length together cost less than the search for hits that need no score
        hits = with_scores(C.filter_homopolymers(hits, C.PRE) if p.filter_homopolymers else hits)
        if p.filter_homopolymers:
            hits = C.filter_homopolymers(hits, C.POST)
        return _finish(_without_overlaps(hits, p.overlap_strategy, per, by_island))
    if p.remove_overlaps:
        hits = _without_overlaps(hits, "greedy", per, by_island)
    if p.score:
        hits = with_scores(hits)
    if p.filter_homopolymers:
        hits = C.filter_homopolymers(hits, C.POST if p.score else C.PRE)
    return _finish(hits)


def scan_sequence(spark: SparkSession, seq: str, seq_offset: int = 1, **kwargs) -> DataFrame:
    return scan(records_of(spark, seq, seq_offset=seq_offset), ScanParams(**kwargs))


def scan_fasta(spark: SparkSession, path: str, parser: str = "biopython", chunk_size: int = 1_000_000, range_bytes: int | None = None, **kwargs) -> DataFrame:
    """Scan a FASTA file: greedy selection works per record, selection by score per sequence name.

    Plain files that Arrow can open are read by ranges of ``range_bytes``, so a long record is scanned by many tasks and never
    assembled; compressed files and other stores are read by Spark, a record a row.
    """
    from ..sources import fasta_ranges as R
    from ..sources.fasta import read_fasta

    p = ScanParams(**kwargs)
    per = ("record_ix",) if p.overlap_strategy == "greedy" else ("seq_id",)
    if not R.splittable(path):
        return scan(read_fasta(spark, path, parser), p, chunk_size, rebalance=True, per=per, by_island=True)
    size = range_bytes or R.RANGE
    chunks = R.range_chunks(spark, path, *D.context(p), parser, size, min(chunk_size, D.CHUNK))
    found = R.placed(D.candidates_of(chunks, p, composed=True), R.places(spark, path, parser, size))
    return after_detection(D.materialise(found), p, per, by_island=True)


def scan_fasta_iter(spark: SparkSession, path: str, **kwargs) -> Iterator[Row]:
    """Hits one by one, a partition of memory at a time."""
    yield from scan_fasta(spark, path, **kwargs).orderBy("record_ix", "start").toLocalIterator()


def _ablation_hits(records: DataFrame, model: str, p: ScanParams) -> DataFrame:
    """What a stage starts from: everything detected without purity, or what the composition filters pass."""
    if model == "detection":
        return detect_candidates(records, p.but(purity=0.0))
    return D.materialise(D.raw_candidates(records, p, composed=True))


def _ablation_stage(hits: DataFrame, model: str, p: ScanParams) -> DataFrame:
    if f"_{model}" in hits.columns:
        hits = hits.select("*", f"_{model}.*")
    elif model in MODELS:
        hits = with_scores(hits, model)
    hits = hits.drop(*[f"_{m}" for m in MODELS])
    if model == "complete" and p.filter_homopolymers:
        hits = C.filter_homopolymers(hits, C.POST)
    if p.remove_overlaps:
        strategy = p.overlap_strategy if "total_score" in hits.columns else "greedy"
        hits = _without_overlaps(hits, strategy, ("record_ix",))
    return _finish(hits)


def scan_ablation(records: DataFrame, model: str = "complete", p: ScanParams | None = None) -> DataFrame:
    """The pipeline up to one stage, then overlap removal if the parameters ask for it, last."""
    if model not in ABLATION:
        raise ValueError(f"unknown model {model!r}")
    p = p or ScanParams()
    return _ablation_stage(_ablation_hits(records, model, p), model, p)


def scan_stages(records: DataFrame, p: ScanParams | None = None, models: tuple[str, ...] = ABLATION) -> dict[str, DataFrame]:
    """:func:`scan_ablation` of several stages; those after the first share one detection, whose hits are stored with the scores of all models: they are
    scored in the tasks that find them, which are many, and not in those that read them back, which are as few as their bytes.
    """
    p, shared, out = p or ScanParams(), None, {}
    scored, parts = tuple(m for m in models if m in MODELS), D.parts()
    for model in models:
        if model == "detection":
            out[model] = scan_ablation(records, model, p)
            continue
        if shared is None:
            shared = stored(with_model_scores(_ablation_hits(records, model, p), scored).drop(*parts), "stages").withColumns(parts)
        out[model] = _ablation_stage(shared, model, p)
    return out


def scan_fasta_ablation(spark: SparkSession, path: str, model: str = "complete", parser: str = "biopython", **kwargs) -> DataFrame:
    """One stage of the pipeline over all records of a FASTA file."""
    from ..sources.fasta import read_fasta

    return scan_ablation(read_fasta(spark, path, parser), model, ScanParams(**kwargs))


def stage_metrics(records: DataFrame, truth: DataFrame, p: ScanParams | None = None, models: tuple[str, ...] = ABLATION) -> DataFrame:
    """Per stage the confusion of its calls with ``truth`` (record_ix, y), the metrics, and the AUROC of the records' highest scores.

    A record without a hit is not called and scores 0; a stage without a model scores every record 0.
    """
    from ..operators import evaluation as E

    calls = None
    for i, (model, hits) in enumerate(scan_stages(records, p, models).items()):
        per = hits.groupBy("record_ix").agg(F.coalesce(F.max("total_score"), F.lit(0.0)).alias("s")).select(F.lit(i).alias("step"), F.lit(model).alias("stage"), "record_ix", "s")
        calls = per if calls is None else calls.unionByName(per)
    calls = stored(calls, "stage-calls")  # read for the confusion and for the areas
    steps = F.array(*[F.struct(F.lit(i).alias("step"), F.lit(m).alias("stage")) for i, m in enumerate(models)])
    every = truth.select("record_ix", "y", F.inline(steps)).join(calls, ["step", "stage", "record_ix"], "left")
    scored = every.select("step", "stage", "y", F.coalesce("s", F.lit(0.0)).alias("s"), F.col("s").isNotNull().cast("int").alias("p"))
    areas = E.auroc(scored, by=["step", "stage"])
    return E.with_metrics(E.confusion(scored, by=["step", "stage"])).join(areas, ["step", "stage"])


#: Steps by which a scan is relaxed one after the other; a step that relaxes nothing is left out.
LADDER = (
    ("AT filter", {"at_threshold": None}), ("homopolymer filter", {"filter_homopolymers": False}), ("arm length 8-9", {"minrep": 8}), ("arm length 6-7", {"minrep": 6}),
    ("mirror mismatch 10-20%", {"mismatch": 0.2}), ("purity 80-90%", {"purity": 0.8}),
)
KEPT, NEVER = "overlap removal", "not recovered by any relaxation"


def ladder(p: ScanParams) -> list[tuple[str, ScanParams]]:
    """(reason, parameters) of the scan itself and of every relaxation so far."""
    out = [(KEPT, p)]
    for reason, change in LADDER:
        name, value = next(iter(change.items()))
        now = getattr(p, name)
        if {"at_threshold": now is not None, "filter_homopolymers": now is True}.get(name, now is not None and value is not None and (now < value if name == "mismatch" else now > value)):
            p = p.but(**change)
            out.append((reason, p))
    return out


def reasons(windows: DataFrame, motifs: DataFrame, p: ScanParams) -> DataFrame:
    """(record_ix, reason): why a scan of the genome missed the motif (start, end) that each window holds.

    The first parameters of the ladder under which a scan of the window has a hit on the motif; a hit with none relaxed
    means that in the whole sequence a longer neighbour was kept instead.
    """
    steps, met = ladder(p), None
    for i, (_, q) in enumerate(steps):
        hits = scan(windows, q).select("record_ix", F.col("start").alias("s"), F.col("end").alias("e"), F.lit(i).alias("step"))
        met = hits if met is None else met.unionByName(hits)
    on = met.join(motifs, "record_ix").where("s <= end and e >= start").groupBy("record_ix").agg(F.min("step").alias("step"))
    names = F.array(*[F.lit(n) for n, _ in steps])
    return motifs.join(on, "record_ix", "left").select("record_ix", F.coalesce(F.get(names, F.col("step")), F.lit(NEVER)).alias("reason"))


def panel(records: DataFrame, filters: dict[str, dict], p: ScanParams | None = None) -> DataFrame:
    """Per record whether it is called under each named change of the parameters."""
    p, out = p or ScanParams(), records.select("record_ix", "seq_id")
    for name, change in filters.items():
        called = scan(records, p.but(**change)).select("record_ix").distinct().withColumn(name, F.lit(True))
        out = out.join(called, "record_ix", "left").withColumn(name, F.coalesce(name, F.lit(False)))
    return out.drop("record_ix")
