"""Command line: scan a FASTA file and write its hits as tab-separated text."""

from __future__ import annotations

import argparse
import sys

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from .plans.scan import scan_fasta
from .sources.fasta import PARSERS, write_hits
from .sources.tables import read_hits


def arguments() -> argparse.ArgumentParser:
    a = argparse.ArgumentParser(prog="mirrorloom", description=__doc__)
    a.add_argument("-seq", required=True, help="FASTA file, plain or gzip")
    a.add_argument("-out", required=True, help="prefix of the output folder")
    a.add_argument("-minrep", type=int, default=8)
    a.add_argument("-maxrep", type=int, default=1000)
    a.add_argument("-maxspacer", type=int, default=10)
    a.add_argument("-purity", type=float, default=0.9)
    a.add_argument("-mismatch", type=float, default=0.1)
    a.add_argument("-at-threshold", type=float, default=None)
    a.add_argument("-min-g-rate", type=float, default=0.2)
    a.add_argument("-overlap-strategy", default="greedy", choices=["greedy", "score", "stability"])
    a.add_argument("-skipoverlap", "-keep-overlaps", action="store_true", help="keep overlapping hits")
    a.add_argument("-score", action="store_true", default=True)
    a.add_argument("-no-score", action="store_false", dest="score")
    a.add_argument("-parser", default="biopython", choices=PARSERS)
    a.add_argument("-chunk-size", type=int, default=1_000_000)
    a.add_argument("-workers", type=int, default=None, help="cores of a local session; a submitted one has its own")
    a.add_argument("-purity-rmq", action="store_true", help="accepted; the prefilter is always on and changes no result")
    a.add_argument("-v", action="store_true", help="hits per sequence on standard error")
    return a


def main(argv: list[str] | None = None) -> int:
    o = arguments().parse_args(argv)
    builder = SparkSession.builder.appName("mirrorloom")
    spark = (builder.master(f"local[{o.workers}]") if o.workers else builder).getOrCreate()
    hits = scan_fasta(
        spark, o.seq, o.parser, o.chunk_size, minrep=o.minrep, maxrep=o.maxrep, maxspacer=o.maxspacer, purity=o.purity, mismatch=o.mismatch, at_threshold=o.at_threshold,
        min_g_rate=o.min_g_rate, overlap_strategy=o.overlap_strategy, remove_overlaps=not o.skipoverlap, score=o.score,
    )
    path = f"{o.out}_HDNA.tsv"
    write_hits(hits, path, single=True)
    per = read_hits(spark, path).groupBy("seq_id").agg(F.count(F.lit(1)).alias("n"))
    if o.v:
        for r in per.orderBy("seq_id").toLocalIterator():
            print(f"{r.seq_id}\t{r.n}", file=sys.stderr)
    records, total = per.agg(F.count(F.lit(1)), F.coalesce(F.sum("n"), F.lit(0))).first()
    print(f"records with hits: {records}\nhits: {total}\noutput: {path}", file=sys.stderr)
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
