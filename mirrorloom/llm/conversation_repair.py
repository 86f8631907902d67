"""Repair of conversation structure by the cheapest edits.

The turns of a conversation are edited (keep, rerole, delete, insert) until their role initials read ``(s?(ua)+)?``.  The edits are a
path through the lattice of (turns read, grammar state), whose edges are made as they are needed: Dijkstra's search with the
key (cost, audit), where the audit is the edits' initials, ends at the first accepting end node that it takes from the queue.
Two paths of one cost to one node differ before either ends (what one has more would be insertions, which cost), so the least
audit of a prefix stays the least.

Conversations go whole to tasks, many to one, as long as they have at most ``SEGMENT`` rows.  Longer ones are cut into
segments of that many: their duplicates are found by an aggregation, the search runs in each segment from every entry state to
every exit state, and the results are chained along the segments.  Only the digest of the repaired text, which is sequential by
its definition, reads the rows of a long conversation in one stream, batch by batch.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterable, Iterator
from hashlib import sha256
from itertools import pairwise

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import drop_stored, positions, stored

SEGMENT = 1000

# Costs, roles that an edit gives, the grammar's states (nothing yet, after s, after u, after a) and legal neighbours.
KEEP, REROLE, DELETE, INSERT, TRUNCATED_COST = 0, 2, 3, 2, 1
START, SYSTEM, USER, ASSISTANT = range(4)
MOVES = {(START, "s"): SYSTEM, (START, "u"): USER, (SYSTEM, "u"): USER, (ASSISTANT, "u"): USER, (USER, "a"): ASSISTANT}
GIVEN = {START: ("u", "user"), SYSTEM: ("u", "user"), USER: ("a", "assistant"), ASSISTANT: ("u", "user")}
ACCEPTING = frozenset([START, ASSISTANT])
LEGAL = frozenset(["su", "ua", "au"])
NONE, BLANK, DUPLICATE, TRUNCATED = range(4)


def search(initials: str, faults: bytes, start: int = START, wanted: frozenset[int] = ACCEPTING) -> Iterator[tuple[int, int, str]]:
    """(end state, cost, audit) of the end nodes in ``wanted`` in the order in which Dijkstra's search takes them from its queue."""
    n, queue, done = len(faults), [(0, "", 0, start)], set()
    while queue:
        cost, audit, i, state = heapq.heappop(queue)
        if (i, state) in done:
            continue
        done.add((i, state))
        if i == n and state in wanted:
            yield state, cost, audit
        given = MOVES[state, GIVEN[state][0]]
        heapq.heappush(queue, (cost + INSERT, audit + "I", i, given))
        if i == n:
            continue
        heapq.heappush(queue, (cost + DELETE, audit + "D", i + 1, state))
        if faults[i] in (BLANK, DUPLICATE):
            continue
        extra = TRUNCATED_COST if faults[i] == TRUNCATED else 0
        heapq.heappush(queue, (cost + REROLE + extra, audit + "R", i + 1, given))
        kept = MOVES.get((state, initials[i]))
        if kept is not None:
            heapq.heappush(queue, (cost + KEEP + extra, audit + "K", i + 1, kept))


def repair(initials: str, faults: bytes) -> tuple[int, str]:
    _, cost, audit = next(search(initials, faults))
    return cost, audit


class Repaired:
    """Digest of the repaired conversation, fed with its rows in order."""

    def __init__(self, audit: str):
        self.edits, self.at, self.state, self.first, self.digest = audit, 0, START, True, sha256()

    def _say(self, role: str, text: str) -> None:
        self.digest.update(("" if self.first else "\n").encode() + f"{role}:{text}".encode())
        self.first = False

    def _inserted(self) -> None:
        while self.edits[self.at : self.at + 1] == "I":
            initial, role = GIVEN[self.state]
            self._say(role, "")
            self.state, self.at = MOVES[self.state, initial], self.at + 1

    def row(self, role: str, text: str) -> None:
        self._inserted()
        edit = self.edits[self.at]
        self.at += 1
        if edit == "D":
            return
        initial = role[:1]
        if edit == "R":
            initial, role = GIVEN[self.state]
        self._say(role, text)
        self.state = MOVES[self.state, initial]

    def hexdigest(self) -> str:
        self._inserted()
        return self.digest.hexdigest()


def illegal_pairs(initials: Iterable[str]) -> int:
    return sum(a + b not in LEGAL for a, b in pairwise(initials))


def _initial(role: str) -> str:
    return role[:1] or "\0"  # an empty role has no initial, so no state may keep it


# The result's columns, but for the conversation's id.
FIELDS = "gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"


def whole(rows: list[tuple]) -> tuple:
    """The result of one conversation from its rows (turn, role, text, blank, closed) in order."""
    seen: set[tuple[str, str]] = set()
    faults = bytearray()
    for _, role, text, blank, closed in rows:
        faults.append(BLANK if blank else DUPLICATE if (role, text) in seen else NONE if closed else TRUNCATED)
        seen.add((role, text))
    initials = "".join(_initial(r[1]) for r in rows)
    cost, audit = repair(initials, bytes(faults))
    done = Repaired(audit)
    for r in rows:
        done.row(r[1], r[2])
    turns = {r[0] for r in rows if r[0] is not None}
    gaps = max(turns) - min(turns) + 1 - len(turns) if turns else 0
    return gaps, faults.count(BLANK), faults.count(DUPLICATE), faults.count(TRUNCATED), illegal_pairs(initials), cost, audit, done.hexdigest()


def _short(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ["id", *(f.split()[0] for f in FIELDS.split(", "))]
    key, ids, rows = None, [], []
    for batch in batches:
        out: list[tuple] = []
        columns = [batch.column(batch.schema.names.index(c)).to_pylist() for c in ("key", "turn", "role", "text", "blank", "closed", "gone")]
        of = batch.column(batch.schema.names.index("id"))
        for i, (k, turn, role, text, blank, closed, gone) in enumerate(zip(*columns, strict=True)):
            if k != key:
                if key is not None:
                    out.append((ids[0], *whole(rows)))
                key, ids, rows = k, [of[i].as_py()], []
            if not gone:
                rows.append((turn, role, text, blank, closed))
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, of.type if i == 0 else None) for i, c in enumerate(zip(*out, strict=True))], names=names)
    if key is not None:
        yield pa.RecordBatch.from_arrays([pa.array([v], of.type if i == 0 else None) for i, v in enumerate((ids[0], *whole(rows)))], names=names)


def _segments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per segment: counts, first and last initial, and the best way from every entry state to every exit state."""
    key, initials, faults = None, [], bytearray()

    def close() -> pa.RecordBatch:
        text = "".join(initials)
        ways = [(a, b, cost, audit) for a in range(4) for b, cost, audit in search(text, bytes(faults), a, frozenset(range(4)))]
        a, b, cost, audit = (list(c) for c in zip(*ways, strict=True))
        one = [[key[0]], [key[1]], [faults.count(BLANK)], [faults.count(DUPLICATE)], [faults.count(TRUNCATED)], [illegal_pairs(text)], [text[0]], [text[-1]], [a], [b], [cost], [audit]]
        return pa.RecordBatch.from_arrays([pa.array(v) for v in one], names=SEGMENT_COLUMNS)

    for batch in batches:
        col = lambda c: batch.column(batch.schema.names.index(c)).to_pylist()  # noqa: B023, E731
        for k, seg, initial, fault in zip(col("key"), col("segment"), col("initial"), col("fault"), strict=True):
            if (k, seg) != key:
                if key is not None:
                    yield close()
                key, initials, faults = (k, seg), [], bytearray()
            initials.append(initial)
            faults.append(fault)
    if key is not None:
        yield close()


SEGMENT_COLUMNS = ["key", "segment", "blank", "duplicate", "truncated", "illegal", "head", "tail", "entry", "leave", "cost", "audit"]
SEGMENT_SCHEMA = "key string, segment long, blank long, duplicate long, truncated long, illegal long, head string, tail string, entry array<long>, leave array<long>, cost array<long>, audit array<string>"


def _chain(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Segments of whole conversations in order: the best way along all of them."""
    key, best, counts, tail = None, {}, [0] * 4, ""
    names = ["key", "blank", "duplicate", "truncated", "illegal", "cost", "audit"]

    def close() -> pa.RecordBatch:
        cost, audit = min(best[s] for s in ACCEPTING if s in best)
        return pa.RecordBatch.from_arrays([pa.array([v]) for v in (key, *counts, cost, audit)], names=names)

    for batch in batches:
        for r in batch.to_pylist():
            if r["key"] != key:
                if key is not None:
                    yield close()
                key, best, counts, tail = r["key"], {START: (0, "")}, [0] * 4, ""
            counts = [c + r[k] for c, k in zip(counts, ("blank", "duplicate", "truncated", "illegal"), strict=True)]
            counts[3] += bool(tail) and tail + r["head"] not in LEGAL
            tail = r["tail"]
            after: dict[int, tuple[int, str]] = {}
            for a, b, cost, audit in zip(r["entry"], r["leave"], r["cost"], r["audit"], strict=True):
                if a in best:
                    way = (best[a][0] + cost, best[a][1] + audit)
                    if b not in after or way < after[b]:
                        after[b] = way
            best = after
    if key is not None:
        yield close()


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of whole conversations in order, the audit first: the digest of the repaired text."""
    key, done = None, None
    for batch in batches:
        col = lambda c: batch.column(batch.schema.names.index(c)).to_pylist()  # noqa: B023, E731
        for k, pos, role, text in zip(col("key"), col("pos"), col("role"), col("text"), strict=True):
            if pos < 0:
                if done is not None:
                    yield pa.RecordBatch.from_arrays([pa.array([key]), pa.array([done.hexdigest()])], names=["key", "repaired_sha256"])
                key, done = k, Repaired(text)
            else:
                done.row(role, text)
    if done is not None:
        yield pa.RecordBatch.from_arrays([pa.array([key]), pa.array([done.hexdigest()])], names=["key", "repaired_sha256"])


def damaged(conversations: DataFrame) -> DataFrame:
    """Rows (id, key, turn, role, text, copy, gone) after damage by crc32 of ``conv_id:turn``; ``gone`` marks dropped rows, whose conversation remains."""
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(text("conv_id"), F.lit(":"), text("turn")).cast("binary")) % 20
    rows = conversations.select(F.col("conv_id").alias("id"), F.coalesce(F.concat(F.lit("="), F.col("conv_id").cast("string")), F.lit("")).alias("key"), "turn", text("role").alias("role"), text("text").alias("text"), kind.alias("kind"))
    return rows.select(
        "id", "key", "turn", F.when(F.col("kind") == 4, "user").otherwise(F.col("role")).alias("role"),
        F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text")).alias("text"),
        F.explode(F.when(F.col("kind") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))).alias("copy"), (F.col("kind") == 0).alias("gone"),
    )


def marked(rows: DataFrame) -> DataFrame:
    """Adds ``blank`` (no character but white space) and ``closed`` (the last such character ends a sentence)."""
    last = F.expr(r"right(trim(TRAILING ' \t\n\u000B\f\r' FROM text), 1)")
    return rows.withColumn("blank", last == "").withColumn("closed", last.isin(".", "!", "?"))


def repair_long(rows: DataFrame, segment: int = SEGMENT) -> DataFrame:
    """The result for conversations of any length, cut into segments (see the module)."""
    alive = rows.where("not gone")
    ranked = positions(alive, "key", ["turn", "role", "text", "copy"], "conversation-places")
    placed = stored(ranked, "conversation-long")
    drop_stored(ranked)
    same = placed.select("key", "pos", F.sha2(F.concat(F.octet_length("role").cast("string"), F.lit(":"), "role", "text"), 256).alias("said"))
    first = same.groupBy("key", "said").agg(F.min("pos").alias("first"))
    repeated = same.join(first, ["key", "said"]).where("pos > first").select("key", "pos", F.lit(True).alias("again"))
    small = placed.select("key", "pos", F.substring("role", 1, 1).alias("initial"), "blank", "closed").join(repeated, ["key", "pos"], "left")
    fault = F.when(F.col("blank"), BLANK).when(F.col("again"), DUPLICATE).when(F.col("closed"), NONE).otherwise(TRUNCATED)
    cut = small.select("key", "pos", F.floor(F.col("pos") / segment).alias("segment"), F.when(F.col("initial") == "", "\0").otherwise(F.col("initial")).alias("initial"), fault.alias("fault"))
    ways = cut.repartition("key", "segment").sortWithinPartitions("key", "segment", "pos").select("key", "segment", "initial", "fault").mapInArrow(_segments, SEGMENT_SCHEMA)
    chained = stored(ways.repartition("key").sortWithinPartitions("key", "segment").mapInArrow(_chain, "key string, blank long, duplicate long, truncated long, illegal long, cost long, audit string"), "conversation-ways")
    lines = placed.select("key", "pos", "role", "text").unionByName(chained.select("key", F.lit(-1).cast("long").alias("pos"), F.lit("").alias("role"), F.col("audit").alias("text")))
    digests = lines.repartition("key").sortWithinPartitions("key", "pos").mapInArrow(_digests, "key string, repaired_sha256 string")
    turns = alive.groupBy("key").agg(F.coalesce(F.max("turn") - F.min("turn") + 1 - F.count_distinct("turn"), F.lit(0)).cast("long").alias("gaps"))
    every = rows.groupBy("key").agg(F.first("id").alias("id"))
    out = every.join(chained, "key", "left").join(digests, "key", "left").join(turns, "key", "left")
    empty = {"gaps": 0, "blank": 0, "duplicate": 0, "truncated": 0, "illegal": 0, "cost": 0, "audit": "", "repaired_sha256": sha256().hexdigest()}
    return out.fillna(empty).select("id", *empty)


def repair_conversations(rows: DataFrame, segment: int = SEGMENT) -> DataFrame:
    """Per conversation of ``rows`` (as :func:`damaged` makes them): id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256.

    Defined cases: null role and text are one space, so such a row is blank; a null conversation id is one conversation; null
    turns come first and count for no gap; rows of one turn stand in the order of role and text; a role other than those of
    the grammar, the empty one included, can only be replaced or deleted; a conversation without rows has zeros and the digest of the empty
    string; very long texts pass in batches of bounded size; an empty table gives no rows; other columns are not read.
    """
    sizes = rows.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > segment)
    kinds = f"id {rows.schema['id'].dataType.simpleString()}, {FIELDS}"
    short, rest = rows, None
    if not sizes.isEmpty():
        long = stored(sizes.select("key"), "conversation-sizes")
        short, rest = rows.join(long, "key", "left_anti"), repair_long(marked(rows.join(long, "key", "left_semi").select(*rows.columns)), segment)
    dealt = marked(short).repartition("key").sortWithinPartitions("key", F.col("turn").asc_nulls_first(), "role", "text", "copy")
    out = dealt.mapInArrow(_short, kinds)
    return out if rest is None else out.unionByName(rest)


__all__ = ["damaged", "repair", "repair_conversations", "repair_long", "search", "whole"]
