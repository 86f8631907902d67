"""FASTA by byte ranges: a record may span any number of tasks.

A file is cut into ranges of bytes, each a task.  A range finds out by itself whether it begins inside a header (it reads back to
the last line break), takes the bases that lie in it, and reads on before and after for the context that a scan needs.  So the
bases of a chromosome are neither assembled nor shuffled.  What a range cannot know is which record the bases before its first
header belong to, and where in it they lie: a second, small table has one row per range with its number of bases and its
last header, and prefix sums over these rows give record and offset.  They are joined to what a scan finds, not to the bases.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import StructType

from .fasta import PARSERS, header_columns

RANGE = 64 << 20
#: A line without a break in so many bytes is sequence: a longer header is not recognised across ranges.
MAX_HEADER = 1 << 20
#: A record's number is its file's place in the list and the byte at which it begins.
FILE_BITS = 44

_SPACE = b"\r\n "
_STARTS = {"biopython": re.compile(rb"(?<![^\r\n])>"), "inhouse": re.compile(rb">")}
_ENDS = {"biopython": re.compile(rb"[\r\n]"), "inhouse": re.compile(rb"[\r\n>]")}


@dataclass
class Range(InputPartition):
    path: str
    file: int
    start: int
    end: int


@dataclass
class Part:
    """Bases of one record in a range: number (of the record, or of the range for a record that began before), header, bases."""

    number: int
    header: bytes | None
    bases: bytes


class Reader:
    """One range of a file, as parts with their context."""

    def __init__(self, source: pa.NativeFile, r: Range, parser: str):
        self.source, self.r, self.size = source, r, source.size()
        self.starts, self.ends = _STARTS[parser], _ENDS[parser]
        self.parser, self.base = parser, r.file << FILE_BITS
        self.data = self.at(r.start, r.end)
        # a '>' at the first byte starts a record of this range, which the look-behind would grant in any case
        self.continues = r.start > 0 and not self._line_start(r.start)

    def at(self, a: int, b: int) -> bytes:
        a, b = max(a, 0), min(b, self.size)
        return self.source.read_at(b - a, a) if b > a else b""

    def _line_start(self, a: int) -> bool:
        return a == 0 or self.at(a - 1, a) in (b"\n", b"\r")

    def in_header(self) -> bool:
        """Whether the first byte of the range lies in a header line that began before it."""
        a, step = self.r.start, 4096
        if a == 0:
            return False
        while True:
            before = self.at(a - step, a)
            breaks = [m.start() for m in self.ends.finditer(before)]
            if breaks:
                last = breaks[-1]
                if self.parser == "inhouse":
                    return before[last : last + 1] == b">"
                return before[last + 1 : last + 2] == b">"
            if len(before) == a:  # the file's first line
                return before[:1] == b">" or self.parser == "inhouse"
            if step >= MAX_HEADER:
                return False
            step *= 4

    def _header_end(self, s: int) -> int:
        """Place in the file at which the header that begins at ``s`` ends, with its line break."""
        at = s + 1
        while at < self.size:
            block = self.at(at, at + 65536)
            m = self.ends.search(block)
            if m:
                return at + m.start() + (block[m.start() : m.end()] != b">")
            at += len(block)
        return self.size

    def parts(self) -> list[Part]:
        a, b = self.r.start, self.r.end
        found: list[Part] = []
        first = min(self._header_end(a - 1), b) if self.in_header() else a
        starts = [a + m.start() for m in self.starts.finditer(self.data) if a + m.start() >= first]
        if starts and starts[0] == a and self.continues and self.parser == "biopython":
            starts = starts[1:]  # not at the beginning of a line
        if a == 0 and self.parser == "inhouse" and self.data and self.data[:1] != b">":
            end = self._header_end(-1)  # text before the first '>' is a record of its own
            found.append(Part(self.base, self.at(0, end), self._bases(end, min([*starts, b]))))
        elif a > 0:
            found.append(Part(self.base + a, None, self._bases(first, min([*starts, b]))))
        for s, nxt in zip(starts, [*starts, b][1:], strict=True):
            end = self._header_end(s)
            found.append(Part(self.base + s, self.at(s + 1, end), self._bases(end, nxt)))
        return found

    def _bases(self, a: int, b: int) -> bytes:
        return self.data[a - self.r.start : b - self.r.start].translate(None, _SPACE).upper() if b > a else b""

    def before(self, need: int) -> bytes:
        """Up to ``need`` bases of the record that the range continues, from before it."""
        if self.r.start == 0 or self.in_header():
            return b""
        step = need + 256
        while True:
            lo = max(self.r.start - step, 0)
            text = self.at(lo, self.r.start)
            # whether its first byte begins a line is not known, unless it is the file's; one more round looks further
            starts = [m for m in self.starts.finditer(text) if m.start() > 0 or self.parser == "inhouse" or self._line_start(lo)]
            if starts:
                m = self.ends.search(text, starts[-1].end())
                return text[m.end() :].translate(None, _SPACE).upper()[-need:] if m else b""
            if lo == 0:
                if self.parser == "biopython":
                    return b""
                m = self.ends.search(text)
                return text[m.end() :].translate(None, _SPACE).upper()[-need:] if m else b""
            # the block's first line may be the rest of a header, unless it is longer than any
            cut = self.ends.search(text)
            known = text[cut.end() :] if cut else b"" if step < MAX_HEADER else text
            bases = known.translate(None, _SPACE)
            if len(bases) >= need or step >= MAX_HEADER:
                return bases.upper()[-need:]
            step *= 4

    def after(self, need: int) -> bytes:
        """Up to ``need`` bases of the range's last record, from after it."""
        b, step = self.r.end, need + 256
        if b >= self.size:
            return b""
        while True:
            text = self.at(b, b + step)
            starts = [m.start() for m in self.starts.finditer(text) if m.start() > 0 or self.parser == "inhouse" or self._line_start(b)]
            bases = text[: starts[0] if starts else len(text)].translate(None, _SPACE)
            if starts or len(bases) >= need or b + step >= self.size:
                return bases.upper()[:need]
            step *= 4


def pieces(reader: Reader, lead: int, tail: int, size: int) -> Iterator[tuple]:
    """(number, header, shift, own_from, own_to, bases) of the range: own stretches of ``size`` bases with context on both sides."""
    parts = reader.parts()
    for i, part in enumerate(parts):
        if not part.bases:
            continue
        left = reader.before(lead) if part.header is None and lead else b""
        last = i == len(parts) - 1
        whole = left + part.bases + (reader.after(tail) if last and tail else b"")
        for c0 in range(0, len(part.bases), size):
            lo = max(c0 - lead, -len(left))
            mine = min(size, len(part.bases) - c0)
            yield part.number, part.header, lo, c0 - lo, c0 - lo + mine, whole[lo + len(left) : c0 + mine + tail + len(left)]


PIECES = "number long, header string, shift long, own_from int, own_to int, b binary"
INDEX = "file long, at long, n long, last_number long, last_header string, before_last long"


class _Ranges(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.paths = options["paths"].split("\n")
        self.parser, self.bytes, self.index = options["parser"], int(options["rangebytes"]), options["index"] == "true"
        self.lead, self.tail, self.chunk = (int(options[k]) for k in ("lead", "tail", "chunk"))

    def partitions(self) -> list[Range]:
        out = []
        for i, path in enumerate(files(self.paths)):
            system, at = fs.FileSystem.from_uri(path)
            size = system.get_file_info(at).size
            out += [Range(path, i, a, min(a + self.bytes, size)) for a in range(0, size, self.bytes)]
        return out

    def read(self, r: Range) -> Iterator[pa.RecordBatch]:
        system, at = fs.FileSystem.from_uri(r.path)
        with system.open_input_file(at) as source:
            reader = Reader(source, r, self.parser)
            text = lambda h: None if h is None else h.decode("utf-8", "replace").rstrip("\r\n")
            if self.index:
                parts = reader.parts()
                counts = [len(p.bases) for p in parts]
                started = [i for i, p in enumerate(parts) if p.header is not None]
                last = started[-1] if started else None
                row = [r.file, r.start, sum(counts), None if last is None else parts[last].number, None if last is None else text(parts[last].header), None if last is None else sum(counts[:last])]
                types = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64()]
                yield pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(row, types, strict=True)], names=[c.split()[0] for c in INDEX.split(", ")])
                return
            types = [pa.int64(), pa.string(), pa.int64(), pa.int32(), pa.int32(), pa.binary()]
            for number, header, *rest in pieces(reader, self.lead, self.tail, self.chunk):
                yield pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip((number, text(header), *rest), types, strict=True)], names=[c.split()[0] for c in PIECES.split(", ")])


class FastaRanges(DataSource):
    @classmethod
    def name(cls) -> str:
        return "mirrorloom_fasta_ranges"

    def schema(self) -> str:
        return INDEX if self.options["index"] == "true" else PIECES

    def reader(self, schema: StructType) -> DataSourceReader:
        return _Ranges(self.options)


def files(paths: list[str]) -> list[str]:
    """The files that ``paths`` (files and folders; URIs that Arrow can open, or absolute paths) name, in order of their names."""
    out = []
    for path in paths:
        system, at = fs.FileSystem.from_uri(path)
        info = system.get_file_info(at)
        if info.type == fs.FileType.NotFound:
            raise FileNotFoundError(path)
        found = system.get_file_info(fs.FileSelector(at)) if info.type == fs.FileType.Directory else [info]
        head = path.split("://")[0] + "://" if "://" in path else ""
        out += [head + f.path for f in found if f.is_file and not f.base_name.startswith(("_", ".")) and f.size]
    return sorted(out)


def splittable(path: str | list[str]) -> bool:
    """Whether the files can be read by ranges: Arrow opens them and none is compressed."""
    try:
        found = files([path] if isinstance(path, str) else path)
    except (OSError, ValueError, pa.ArrowInvalid):
        return False
    return not any(f.endswith(".gz") for f in found)


def _load(spark: SparkSession, path: str | list[str], parser: str, range_bytes: int, index: bool, lead: int = 0, tail: int = 0, chunk: int = 1 << 18) -> DataFrame:
    if parser not in PARSERS:
        raise ValueError(f"unknown parser {parser!r}")
    spark.dataSource.register(FastaRanges)
    options = {"paths": path if isinstance(path, str) else "\n".join(path), "parser": parser, "rangeBytes": range_bytes, "index": str(index).lower(), "lead": lead, "tail": tail, "chunk": chunk}
    return spark.read.format(FastaRanges.name()).options(**options).load()


def places(spark: SparkSession, path: str | list[str], parser: str = "biopython", range_bytes: int = RANGE) -> DataFrame:
    """(number, record_ix, seq_id, seq_offset, before) of every range that continues a record: which, and how many of its bases come before.

    The window runs over one row per range of a file.
    """
    index = _load(spark, path, parser, range_bytes, True)
    earlier = Window.partitionBy("file").orderBy("at").rowsBetween(Window.unboundedPreceding, -1)
    sums = index.withColumn("total", F.coalesce(F.sum("n").over(earlier), F.lit(0)))
    start = F.when(F.col("last_number").isNotNull(), F.struct("last_number", "last_header", (F.col("total") + F.col("before_last")).alias("base")))
    open_ = sums.withColumn("open", F.last(start, ignorenulls=True).over(earlier)).where(F.col("open").isNotNull())
    seq_id, offset = header_columns(F.col("open.last_header"))
    number = F.shiftleft(F.col("file"), FILE_BITS) + F.col("at")
    return open_.select(number.alias("number"), F.col("open.last_number").alias("record_ix"), seq_id.alias("seq_id"), offset.alias("seq_offset"), (F.col("total") - F.col("open.base")).alias("before"))


def range_chunks(spark: SparkSession, path: str | list[str], lead: int, tail: int, parser: str = "biopython", range_bytes: int = RANGE, size: int = 1 << 18) -> DataFrame:
    """Chunks for the detection kernel (record_ix, seq_id, seq_offset, shift, own_from, own_to, b).

    The name is null for chunks whose record began in another range; what is found in them gets its record and place by :func:`placed`.
    """
    raw = _load(spark, path, parser, range_bytes, False, lead, tail, size)
    seq_id, offset = header_columns(F.col("header"))
    named = F.col("header").isNotNull()
    return raw.select(F.col("number").alias("record_ix"), F.when(named, seq_id).alias("seq_id"), F.when(named, offset).otherwise(1).alias("seq_offset"), "shift", "own_from", "own_to", "b")


def placed(found: DataFrame, places: DataFrame, columns: tuple[str, ...] = ("start", "end")) -> DataFrame:
    """What was found in :func:`range_chunks`, with the records of continued ranges and places along them; text before the first header is no record."""
    at = places.select(F.col("number").alias("_number"), *[F.col(c).alias(f"_{c}") for c in ("record_ix", "seq_id", "seq_offset", "before")])
    # named rows need no place; their keys match nothing but differ, so that they are not dealt to one task
    key = F.when(F.col("seq_id").isNull(), F.col("record_ix")).otherwise(-1 - F.col("record_ix"))
    joined = found.join(at, key == F.col("_number"), "left").where("seq_id is not null or _number is not null")
    moved = {c: F.col(c) + F.coalesce(F.col("_before") + F.col("_seq_offset") - 1, F.lit(0)) for c in columns}
    changed = {"record_ix": F.coalesce("_record_ix", "record_ix"), "seq_id": F.coalesce("seq_id", "_seq_id"), **moved}
    return joined.select(*[changed[c].alias(c) if c in changed else F.col(c) for c in found.columns])


def read_fasta_pieces(spark: SparkSession, path: str | list[str], parser: str = "biopython", range_bytes: int = RANGE, size: int = 1 << 18) -> DataFrame:
    """(record_ix, seq_id, at, seq): stretches of up to ``size`` bases of all records, ``at`` the coordinate of the first.

    Header lines of over ``MAX_HEADER`` bytes that cross a range are not recognised; empty records have no piece.
    """
    raw = range_chunks(spark, path, 0, 0, parser, range_bytes, size)
    found = raw.select("record_ix", "seq_id", (F.col("shift") + F.col("seq_offset")).alias("at"), F.col("b").cast("string").alias("seq"))
    return placed(found, places(spark, path, parser, range_bytes), ("at",))
