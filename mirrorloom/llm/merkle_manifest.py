"""Merkle manifest of a dataset: a tree per source over its rows, and one over the sources' roots.

Every node is the SHA-256 of its children's digests as hex text; ``ARITY`` consecutive nodes share a parent, and a last run of
fewer, even of one, still gets its own as long as more than one node remains.  Rows find their place in their source by a
distributed ranking (``common.positions``).  Aligned blocks of ``ARITY ** HEIGHT`` nodes are whole subtrees, so each is one
postorder traversal in a task: it returns the subtree's digest and, while it unwinds, appends the siblings of each child to the
proofs of the leaves that the child holds.  The blocks' roots are the nodes of the next, equally distributed traversal, until
one node of each source is left; then the same goes over the sources.  No task holds more than one block.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import sha256
from itertools import count

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import drop_stored, positions, stored

ARITY, HEIGHT = 3, 7
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


def field(col: Column) -> Column:
    """``-`` for null, else the length in bytes, a colon and the value as text."""
    text = col.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf(fields: list[Column]) -> Column:
    return F.unhex(F.sha2(F.concat(*map(field, fields)), 256))


def parent(digests: list[bytes]) -> bytes:
    return sha256("".join(d.hex() for d in digests).encode()).digest()


def traverse(digests: list[bytes], height: int, arity: int = ARITY) -> tuple[bytes, list[bytearray]]:
    """Root of the subtree of ``height`` levels over ``digests`` and the proof of each, by recursion.

    A proof has a byte per level, (own place among the run) * 16 + run length, and then the siblings, left to right.
    """
    proofs = [bytearray() for _ in digests]

    def visit(at: int, level: int) -> bytes:
        if level == 0:
            return digests[at]
        step = arity ** (level - 1)
        starts = range(at, min(at + step * arity, len(digests)), step)
        children = [visit(s, level - 1) for s in starts]
        for own, s in enumerate(starts):
            siblings = bytes([own * 16 + len(children)]) + b"".join(children[:own] + children[own + 1 :])
            for i in range(s, min(s + step, len(digests))):
                proofs[i] += siblings
        return parent(children)

    return visit(0, height), proofs


def steps(proof: bytes) -> Iterator[tuple[int, list[bytes]]]:
    """(own place, siblings) level by level."""
    at = 0
    while at < len(proof):
        own, run = divmod(proof[at], 16)
        yield own, [proof[at + 1 + 32 * i : at + 33 + 32 * i] for i in range(run - 1)]
        at += 1 + 32 * (run - 1)


def fold(digest: bytes, proof: bytes) -> bytes:
    """The root that a leaf and the siblings of its proof lead to."""
    for own, siblings in steps(proof):
        digest = parent([*siblings[:own], digest, *siblings[own:]])
    return digest


def tree_height(n: int, arity: int = ARITY) -> int:
    return next(h for h in count() if arity**h >= n)


def _blocks(arity: int, height: int):
    """Rows sorted by group and place, of which whole blocks come to one task: adds each node's proof in its block and, to a block's first node, the root."""
    size = arity**height

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        key, rows = None, 0

        def close() -> pa.RecordBatch:
            block = pa.concat_batches(held)
            n = block.column(block.schema.names.index("n"))[0].as_py()
            digests = block.column(block.schema.names.index("digest")).to_pylist()
            root, proofs = traverse(digests, height if n > size else tree_height(n, arity), arity)
            roots = [root] + [None] * (len(digests) - 1)
            return pa.RecordBatch.from_arrays([*block.columns, pa.array(map(bytes, proofs), pa.binary()), pa.array(roots, pa.binary())], names=[*block.schema.names, "proof", "block_root"])

        for batch in batches:
            names = batch.schema.names
            keys = list(zip(batch.column(names.index("tree")).to_pylist(), batch.column(names.index("block")).to_pylist(), strict=True))
            start = 0
            for i in range(len(keys) + 1):
                if i == len(keys) or keys[i] != key:
                    if i > start:
                        held.append(batch.slice(start, i - start))
                        rows += i - start
                    if i < len(keys):
                        if rows:
                            yield close()
                        held, rows, key, start = [], 0, keys[i], i
        if rows:
            yield close()

    return run


def climb(nodes: DataFrame, arity: int, height: int) -> tuple[list[DataFrame], DataFrame]:
    """All rounds of a forest: the stored rounds, each with ``proof`` within the block, and the last one's roots (tree, digest).

    ``nodes`` has ``tree``, ``pos``, ``n``, ``digest`` and may have more columns, which the first round carries along.
    """
    rounds, size = [], arity**height
    while True:
        placed = nodes.withColumn("block", F.floor(F.col("pos") / size))
        types = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in placed.schema) + ", proof binary, block_root binary"
        dealt = placed.repartition("tree", "block").sortWithinPartitions("tree", "block", "pos")
        done = stored(dealt.mapInArrow(_blocks(arity, height), types), "merkle-round")
        rounds.append(done)
        roots = done.where("block_root is not null")
        if roots.where(F.col("n") > size).isEmpty():
            return rounds, roots.select("tree", F.col("block_root").alias("digest"))
        nodes = roots.select("tree", F.col("block").alias("pos"), F.ceil(F.col("n") / size).alias("n"), F.col("block_root").alias("digest"))


def _descend(rounds: list[DataFrame], above: DataFrame) -> DataFrame:
    """The first round's rows with the proofs of all rounds joined up; ``above`` has (tree, up, root, subroot) of every tree."""
    up = above
    on = ["tree"]
    for r in reversed(rounds):
        joined = r.join(up, on).withColumn("proof", F.concat("proof", "up"))
        if r is rounds[0]:
            return joined.drop("up", "block_root", "block")
        up = joined.select("tree", F.col("pos").alias("block"), F.col("proof").alias("up"), "root", "subroot")
        on = ["tree", "block"]
    raise ValueError("no round")


def _fold_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        names = batch.schema.names
        claimed, proofs = batch.column(names.index("claimed")).to_pylist(), batch.column(names.index("proof")).to_pylist()
        digests = [sha256("".join(s.hex() for _, siblings in steps(p) for s in siblings).encode()).hexdigest() for p in proofs]
        folded = [fold(c, p).hex() for c, p in zip(claimed, proofs, strict=True)]
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(digests, pa.string()), pa.array(folded, pa.string())], names=[*names, "proof_sha256", "folded_root"])


def manifest(docs: DataFrame, id_col: str = "doc_id", group_col: str = "source", fields: tuple[str, ...] = FIELDS, claimed: Column | None = None, arity: int = ARITY, height: int = HEIGHT) -> DataFrame:
    """Per row ``id_col``, ``leaf``, ``subroot``, ``root`` (hex), ``proof`` (see :func:`traverse`), ``proof_sha256`` (over the siblings as hex text), ``folded_root``, ``verified``.

    ``claimed`` is the leaf that is folded with the proof, by default the row's own: a digest of another version of the row
    tells whether that version is the one of the manifest.

    Defined cases: null fields count as ``-``, so they differ from empty ones; a null source is a tree of its own, the first;
    null ids come first in their source, and rows of one id stand in the order of their leaves (equal rows have equal leaves,
    so their order changes nothing but which of them has which proof); a lone row is its subroot, a lone source's subroot
    the root, and then the proof is empty; long texts are hashed by Spark where they lie; an empty table gives no rows; other
    columns are not read.
    """
    if not 2 <= arity <= 15:
        raise ValueError("arity must be from 2 to 15")
    own = leaf([F.col(f) for f in fields])
    tree = F.coalesce(F.concat(F.lit("="), F.col(group_col).cast("string")), F.lit(""))
    leaves = docs.select(F.col(id_col).alias("id"), tree.alias("tree"), own.alias("digest"), (own if claimed is None else claimed).alias("claimed"))
    placed = positions(leaves, "tree", ["id", "digest"], "merkle-leaves")
    rounds, subroots = climb(placed, arity, height)
    drop_stored(placed)  # the first round is written
    forest = subroots.select(F.lit("").alias("tree"), F.col("tree").alias("member"), "digest")
    members = positions(forest, "tree", ["member"], "merkle-subroots")
    tops, roots = climb(members, arity, height)
    drop_stored(members)
    crown = _descend(tops, roots.select("tree", F.lit(b"").alias("up"), F.col("digest").alias("root"), F.lit(None).cast("binary").alias("subroot")))
    above = crown.select(F.col("member").alias("tree"), F.col("proof").alias("up"), "root", F.col("digest").alias("subroot"))
    rows = _descend(rounds, above).select("id", "digest", "claimed", "proof", "root", "subroot")
    kind = rows.schema["id"].dataType.simpleString()
    out = rows.mapInArrow(_fold_batches, f"id {kind}, digest binary, claimed binary, proof binary, root binary, subroot binary, proof_sha256 string, folded_root string")
    hexed = lambda c: F.lower(F.hex(c))
    return out.select(F.col("id").alias(id_col), hexed("digest").alias("leaf"), hexed("subroot").alias("subroot"), hexed("root").alias("root"), "proof", "proof_sha256", "folded_root", (F.col("folded_root") == hexed("root")).alias("verified"))
