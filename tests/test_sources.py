import gzip
import random

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from mirrorloom.operators import filters
from mirrorloom.params import ScanParams
from mirrorloom.plans.scan import scan, scan_fasta, scan_fasta_iter
from mirrorloom.sources import fasta_ranges as R
from mirrorloom.sources import tables
from mirrorloom.sources.fasta import read_fasta, read_fasta_named, write_fasta, write_hits
from mirrorloom.streaming.scan_stream import read_fasta_stream, scan_stream

TEXT = ">chr1:101-130 description\r\nga ga\r\nGAga\r\n>empty x\n>plain a > b\nGGGGnN n\n>\nACGT\n"
WANT = [("chr1:101-130", "GAGAGAGA", 101), ("plain", "GGGGNNN", 1), ("unknown", "ACGT", 1)]


@pytest.mark.parametrize("packed", [False, True])
def test_fasta(spark, tmp_path, packed):
    path = str(tmp_path / ("x.fa.gz" if packed else "x.fa"))
    with (gzip.open if packed else open)(path, "wb") as f:
        f.write(TEXT.encode())
    got = read_fasta(spark, path).orderBy("record_ix").collect()
    assert [(r.seq_id, r.seq, r.seq_offset) for r in got] == WANT
    assert read_fasta_named(spark, path, ["plain"]).count() == 1
    # a block between two signs has its header up to the line's end, and one that begins with a space has no name
    assert ("unknown", "GGGGNNN", 1) in [(r.seq_id, r.seq, r.seq_offset) for r in read_fasta(spark, path, "inhouse").collect()]
    with pytest.raises(ValueError):
        read_fasta(spark, path, "other")


def by_lines(text: str, parser: str) -> list[tuple[str, str]]:
    """(header, bases) of the records that have any, read line by line."""
    out, text = [], text.replace("\r\n", "\n").replace("\r", "\n")
    if parser == "biopython":
        for line in text.split("\n"):
            if line.startswith(">"):
                out.append([line[1:], ""])
            elif out:
                out[-1][1] += line.replace(" ", "")
    else:
        for block in filter(str.strip, text.split(">")):
            header, _, body = block.partition("\n")
            out.append([header, body.replace("\n", "").replace(" ", "")])
    return [(h, s.upper()) for h, s in out if s]


@pytest.mark.parametrize("parser", ["biopython", "inhouse"])
def test_ranges_of_any_size_read_the_same_records(parser):
    """Bases, records, own stretches and contexts of all ranges of random texts, at every length of a range."""
    rng = random.Random(7)
    for _ in range(300):
        raw = "".join(rng.choice(["a", "c", "gt", "A", "\n", "\n", ">", "\n>", "x ", " ", "\r\n"]) for _ in range(rng.randint(0, 40))).encode()
        lead, tail, size = 3, 4, rng.choice([1, 2, 100])
        for step in (1, 2, 3, 5, 7, 1000):
            records, open_, chunks = {}, None, []
            for a in range(0, len(raw), step):
                reader = R.Reader(pa.BufferReader(raw), R.Range("", 0, a, min(a + step, len(raw))), parser)
                base = {}
                for part in reader.parts():
                    if part.header is not None:
                        open_ = (part.number, part.header.decode().rstrip("\r\n"))
                        records[open_] = ""
                    if open_:
                        base[part.number] = (open_, len(records[open_]))
                        records[open_] += part.bases.decode()
                chunks += [(*base[n], *rest) for n, _, *rest in R.pieces(reader, lead, tail, size) if n in base]
            assert [(h, s) for (_, h), s in sorted(records.items()) if s] == by_lines(raw.decode(), parser)
            owned = {}
            for of, before, lo, own_from, own_to, b in chunks:
                at, whole = before + lo, records[of]
                assert at == max(0, at + own_from - lead) and whole[at : at + len(b)] == b.decode() and at + len(b) == min(len(whole), at + own_to + tail)
                owned.setdefault(of, []).extend(range(at + own_from, at + own_to))
            assert {k: sorted(v) for k, v in owned.items()} == {k: list(range(len(s))) for k, s in records.items() if s}


@pytest.mark.parametrize("parser", ["biopython", "inhouse"])
def test_one_record_in_many_tasks(spark, tmp_path, parser):
    rng = random.Random(11)
    bases = "".join(rng.choice(["GA" * 9, "AAGG" * 4, "ACGT", "TTC" * 6, "N", rng.choice("ACGT") * rng.randint(1, 30)]) for _ in range(4000))
    body = "\n".join(bases[i : i + 60] for i in range(0, len(bases), 60))
    (tmp_path / "x.fa").write_text(f">chr1:101-999999 one record\n{body}\n>empty\n>unwrapped\n{bases[:9000]}\n")
    path = str(tmp_path / "x.fa")
    for strategy in ("greedy", "score"):
        p = ScanParams(overlap_strategy=strategy, maxrep=60)
        per = ("record_ix",) if strategy == "greedy" else ("seq_id",)
        want = scan(read_fasta(spark, path, parser), p, per=per).drop("record_ix")
        got = scan_fasta(spark, path, parser, range_bytes=3000, chunk_size=700, overlap_strategy=strategy, maxrep=60).drop("record_ix")
        assert sorted(map(repr, got.collect())) == sorted(map(repr, want.collect())) and got.count() > 100
    pieces = R.read_fasta_pieces(spark, path, parser, 3000, 700)
    assert R.range_chunks(spark, path, 0, 0, parser, 3000).rdd.getNumPartitions() == -(-(tmp_path / "x.fa").stat().st_size // 3000)
    whole = {}
    for r in sorted(pieces.collect()):
        assert r.at == (101 if r.seq_id.startswith("chr1") else 1) + len(whole.setdefault(r.seq_id, ""))
        whole[r.seq_id] += r.seq
    assert whole == {r.seq_id: r.seq for r in read_fasta(spark, path, parser).collect()}


def test_sinks_round_trip(spark, tmp_path):
    fasta = tmp_path / "in.fa"
    fasta.write_text(">a:11-40\n" + "GAAGGAAAGAAAGAAAGGG" * 2 + "\n>b\n" + "GA" * 30 + "\n")
    records = read_fasta(spark, str(fasta))
    hits = scan(records)
    write_hits(hits, str(tmp_path / "hits"), single=True)
    back = tables.read_hits(spark, str(tmp_path / "hits"))
    assert sorted((r.seq_id, r.start, r.end, r.total_score) for r in back.collect()) == sorted((r.seq_id, r.start, r.end, r.total_score) for r in hits.collect())
    assert sum(1 for _ in scan_fasta_iter(spark, str(fasta))) == hits.count() > 0
    assert (tmp_path / "hits").is_file() and not (tmp_path / "hits.parts").exists()
    write_hits(hits.where("false"), str(tmp_path / "none"), single=True)
    assert (tmp_path / "none").read_bytes().startswith(b"seq_id\tsource\tstart") and tables.read_hits(spark, str(tmp_path / "none")).count() == 0
    write_fasta(records, str(tmp_path / "out"))
    assert sorted(r.seq for r in read_fasta(spark, str(tmp_path / "out")).collect()) == sorted(r.seq for r in records.collect())
    assert tables.checksums(spark, str(fasta)).first().length == fasta.stat().st_size


def test_tables(spark, tmp_path):
    (tmp_path / "x.csv").write_bytes(b"\xef\xbb\xbfid,v\n1,2\n")
    assert tables.read_csv(spark, str(tmp_path / "x.csv")).columns == ["id", "v"]
    (tmp_path / "x.bed").write_text("track name=x\nchr1\t5\t9\tn\n")
    assert tuple(tables.read_bed(spark, str(tmp_path / "x.bed")).first()) == ("chr1", 5, 9, "n")
    (tmp_path / "x.wig").write_text("variableStep chrom=c1 span=10\n1 2.5\n11 3\nvariableStep chrom=c2\n5 1\n")
    assert sorted(map(tuple, tables.read_wig(spark, str(tmp_path / "x.wig")).collect())) == [("c1", 1, 10, 2.5), ("c1", 11, 10, 3.0), ("c2", 5, 1, 1.0)]
    a, b = spark.createDataFrame([(1, [1.0])], "a int, l array<double>"), spark.createDataFrame([(2,)], "b int")
    tables.write_csv([a, b], str(tmp_path / "u"))
    assert sorted(spark.read.csv(str(tmp_path / "u"), header=True).columns) == ["a", "b", "l"]
    assert tables.read_columns(spark, str(tmp_path / "x.bed"), {"c": (0, "string")}).count() == 2


def test_command_line(spark, tmp_path):
    from mirrorloom import cli

    (tmp_path / "in.fa").write_text(">b\n" + "GAAGGAAAGAAAGAAAGGG" * 2 + "\n>a\n" + "GA" * 21 + "GG\n")
    assert cli.main(["-seq", str(tmp_path / "in.fa"), "-out", str(tmp_path / "x"), "-v", "-purity-rmq", "-skipoverlap"]) == 0
    lines = (tmp_path / "x_HDNA.tsv").read_text().splitlines()
    ids = [x.split("\t")[0] for x in lines[1:]]
    assert len(lines[0].split("\t")) == 19 and ids == sorted(ids) and set(ids) == {"a", "b"}


def test_stream(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.fa").write_text(">a\n" + "GAAGGAAAGAAAGAAAGGG" * 2 + "\n>b\n" + "GA" * 30 + "\n")
    seen = {}
    q = scan_stream(read_fasta_stream(spark, str(tmp_path / "in")), str(tmp_path / "cp"), lambda hits, n: seen.update({n: hits.count()}))
    q.awaitTermination(120)
    assert sum(seen.values()) == scan(read_fasta(spark, str(tmp_path / "in" / "a.fa"))).count()


def test_homopolymer_mode(spark):
    with pytest.raises(ValueError):
        filters.filter_homopolymers(spark.range(1), "x")


def test_one_file_from_many_parts(spark, tmp_path):
    rows = spark.range(3000).select(F.concat(F.lit("s"), F.col("id") % 7).alias("seq_id"), F.lit("GA" * 40).alias("seq"), F.lit(1).alias("seq_offset"), F.col("id").alias("record_ix"))
    hits = scan(rows).withColumn("start", F.col("start") + F.monotonically_increasing_id())  # no ties
    write_hits(hits.repartition(5), str(tmp_path / "joined"), single=True)
    hits.select(*tables.HIT_COLUMNS).orderBy("seq_id", "start").coalesce(1).write.csv(str(tmp_path / "one"), sep="\t", header=True, lineSep="\r\n", nullValue="", emptyValue="")
    assert (tmp_path / "joined").read_bytes() == next((tmp_path / "one").glob("part-*")).read_bytes()


def test_wig_headers_cross_tasks(spark, tmp_path):
    lines = []
    for c in range(4):
        lines += [f"variableStep chrom=c{c} span={c + 1}", *[f"{i} {i / 10}" for i in range(1, 500)]]
    (tmp_path / "x.wig").write_text("\n".join(["track type=wiggle", *lines]) + "\n")
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", "1500")
        got = tables.read_wig(spark, str(tmp_path / "x.wig")).collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert sorted((r.chrom, r.pos, r.span, r.value) for r in got) == sorted((f"c{c}", i, c + 1, i / 10) for c in range(4) for i in range(1, 500))


def test_outputs_of_other_finders(spark, tmp_path):
    from mirrorloom.sources import comparators as K

    rows = lambda df: sorted((tuple(r) for r in df.collect()), key=repr)
    put = lambda name, text: ((tmp_path / name).write_text(text), str(tmp_path / name))[1]
    assert rows(K.read_triplex(spark, put("t.csv", "start,end,score,record_id,more\n3,9,1.5,r1,x\n"))) == [("r1", 3, 9, 1.5)]
    sites = put("sites", "# head\n\nr1\t2\t9\t4.5\tx\nr2\t0\t3\t1\tx\n")
    assert rows(K.read_triplexator(spark, sites)) == [("r1", 3, 9, 4.5), ("r2", 1, 3, 1.0)]
    pairs = put("pairs", "# head\nr1\t0\t5\tr1\t2\t9\t4.5\nr1\t0\t5\tr2\t2\t9\t4.5\n")
    assert rows(K.read_triplexator(spark, pairs, same_molecule=True)) == [("r1", 3, 9, 4.5)]
    table = put("n.tsv", "Sequence_name\tStart\tStop\tSubset\nr1\t1\t5\t0\nr1\t7\t9\t1\n")
    assert rows(K.read_nbmst(spark, table)) == [("r1", 1, 5, None), ("r1", 7, 9, None)] and rows(K.read_nbmst(spark, table, True)) == [("r1", 7, 9, None)]
    blocks = "$|9|lost\n>r1 text\n@indexes:4|\n$|12|a\n@indexes:5|8|\n$|7|b\n@indexes:|\n>r2\n$|3|c\nother\n@indexes: 0|\n"
    want = [("r1", 6, 17, None, 12), ("r1", None, None, None, 7), ("r2", 1, 3, None, 3)]
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        for size in ("10", before):  # blocks over many tasks and in one
            spark.conf.set("spark.sql.files.maxPartitionBytes", size)
            assert rows(K.read_nessie(spark, put("n", blocks))) == sorted(want, key=repr)
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
