"""Byte-level BPE by per-prefix dynamic programming.

For a piece of text ``s`` the state is one number per prefix: the last token of that prefix's encoding, which is
unique.  The candidates at a prefix are the vocabulary entries that are its suffixes, found for all prefixes in one
pass of an Aho-Corasick automaton over the vocabulary, whose links go from each match to its longest suffix that is an
entry; it reports the same suffixes as a suffix automaton of the vocabulary would, from fewer states.  A candidate ``t`` is the last token if it may follow the last token
of the prefix it leaves: ``(u, t)`` is compatible when undoing the merges of both from the highest rank down never
meets a merge across the border that would have been made earlier.  Following the back-pointers from the whole piece
gives the ids, exactly those of the merge procedure.

Texts are cut by the vocabulary's published pattern, so pieces are short; ids of frequent pieces are kept in a bounded
table per worker.  Nothing is shuffled: one narrow pass.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator
from functools import lru_cache

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import small_batches, text_or_empty

#: Fixed value: the pattern that cuts a text before merges, as the vocabulary's publisher states it.
PIECES = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Pieces and pairs of tokens that a worker remembers; when full, the table starts anew.
REMEMBERED, REMEMBERED_PAIRS = 200_000, 500_000
NONE = -1


def byte_names() -> dict[str, int]:
    """The published naming of bytes by printable characters: printable Latin-1 as itself, the rest from U+0100 on."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    names = {chr(b): b for b in shown}
    hidden = [b for b in range(256) if b not in set(shown)]
    return names | {chr(0x100 + i): b for i, b in enumerate(hidden)}


class Bpe:
    def __init__(self, file: str):
        with open(file, encoding="utf-8") as f:
            spec = json.load(f)
        names = byte_names()
        vocab = {bytes(names[c] for c in t): i for t, i in spec["model"]["vocab"].items()}
        self.added = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
        self.bytes_of = dict((i, t) for t, i in vocab.items()) | {i: t.encode() for t, i in self.added.items()}
        self.rank: dict[int, int] = {}  # of the merge that makes a token; single bytes have none
        self.parts: dict[int, tuple[int, int]] = {}
        self.merge: dict[tuple[int, int], int] = {}
        for n, m in enumerate(spec["model"]["merges"]):
            a, b = m if isinstance(m, list) else m.split(" ")
            a, b = (bytes(names[c] for c in x) for x in (a, b))
            left, right, made = vocab[a], vocab[b], vocab[a + b]
            self.merge.setdefault((left, right), n)
            if made not in self.rank:
                self.rank[made], self.parts[made] = n, (left, right)
        self.automaton = ahocorasick.Automaton()
        for t, i in vocab.items():
            self.automaton.add_word(t.decode("latin-1"), (len(t), i))
        self.automaton.make_automaton()
        self.cut = regex.compile(PIECES)
        self.cut_added = regex.compile("(" + "|".join(map(regex.escape, sorted(self.added, key=len, reverse=True))) + ")") if self.added else None
        self.pairs: dict[int, bool] = {}
        self.pieces: dict[str, bytes] = {}

    def compatible(self, left: int, right: int) -> bool:
        """True if the encoding of the two tokens' joined bytes is just these two tokens.

        Undo merges from the latest: of the two tokens at the border, the one made later is opened, and what then
        touches the border is tested.  A merge across the border wins if its rank is below that of every opened token
        on the way, with the leftmost first on equal ranks.
        """
        rank, parts, merge = self.rank, self.parts, self.merge
        limit = 1 << 60  # a border merge of a lower rank would have come before what has been undone so far
        while True:
            across = merge.get((left, right))
            if across is not None and across < limit:
                return False
            a, b = rank.get(left, NONE), rank.get(right, NONE)
            if a == NONE and b == NONE:
                return True
            # the later merge is undone first; of equal ones the right, which was made after the left
            if a > b:
                limit = a
                left = parts[left][1]
            else:
                limit = b + 1  # the border lies left of this merge: at equal rank the border would have won
                right = parts[right][0]

    def piece_ids(self, piece: bytes) -> list[int]:
        """Ids of one piece, by the table of last tokens of all its prefixes."""
        n = len(piece)
        last, back = [NONE] * (n + 1), [0] * (n + 1)
        pairs, compatible = self.pairs, self.compatible
        for end, (size, token) in self.automaton.iter(piece.decode("latin-1")):  # at each end, longest first
            end += 1
            if last[end] >= 0:
                continue
            start = end - size
            if start:
                key = last[start] << 32 | token
                fits = pairs.get(key)
                if fits is None:
                    if len(pairs) >= REMEMBERED_PAIRS:
                        pairs.clear()
                    fits = pairs[key] = compatible(last[start], token)
                if not fits:
                    continue
            last[end], back[end] = token, start
        out = []
        while n:
            out.append(last[n])
            n = back[n]
        return out[::-1]

    def make(self, piece: str) -> bytes:
        if len(self.pieces) >= REMEMBERED:
            self.pieces.clear()
        made = np.array(self.piece_ids(piece.encode()), dtype="<u4").tobytes()
        if len(piece) <= 64:
            self.pieces[piece] = made
        return made

    def encode(self, text: str) -> np.ndarray:
        """Ids of the whole text, special tokens included where their strings stand in it."""
        out = []
        get, make = self.pieces.get, self.make
        for part in self.cut_added.split(text) if self.cut_added and any(t in text for t in self.added) else [text]:
            if part in self.added:
                out.append(np.array([self.added[part]], dtype="<u4").tobytes())
            else:
                out.extend([get(p) or make(p) for p in self.cut.findall(part)])
        return np.frombuffer(b"".join(out), dtype="<u4")

    def decode(self, ids: np.ndarray) -> str:
        """The text of the ids, special tokens included; bytes that are no UTF-8 become U+FFFD."""
        return b"".join(map(self.bytes_of.__getitem__, ids.tolist())).decode("utf-8", "replace")


@lru_cache(maxsize=4)
def load(file: str) -> Bpe:
    return Bpe(file)


def encode_decode(docs: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = ("ids", "decoded")) -> DataFrame:
    """id, n_tokens, ids_sha256, decoded_sha256 and what ``keep`` names: ids (array<int>), decoded (string).

    ``vocabulary`` is the path of a tokenizer file that every worker can read.  Defined cases: a null or empty text
    has no tokens and decodes to the empty text; a null or repeated id passes through, row by row; an empty table gives
    no rows; texts are encoded whole, whatever their length; other columns of ``docs`` are not read.
    """
    base = docs.select(F.col(id_col).alias("id"), text_or_empty(text_col).alias("text"))
    small_batches(docs.sparkSession)
    fields = {"n_tokens": ("long", pa.int64()), "ids_sha256": ("string", pa.string()), "decoded_sha256": ("string", pa.string()), "ids": ("array<int>", pa.list_(pa.int32())), "decoded": ("string", pa.string())}
    fields = {n: t for n, t in fields.items() if n not in ("ids", "decoded") or n in keep}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = load(vocabulary)
        for whole in batches:
            for at in range(0, whole.num_rows, 256):
                batch = whole.slice(at, 256)
                cols: dict[str, list] = {n: [] for n in fields}
                for text in batch.column(1).to_pylist():
                    ids = bpe.encode(text)
                    decoded = bpe.decode(ids)
                    made = {"n_tokens": len(ids), "ids_sha256": hashlib.sha256(ids.tobytes()).hexdigest(), "decoded_sha256": hashlib.sha256(decoded.encode()).hexdigest(), "ids": ids.astype(np.int32), "decoded": decoded}
                    for n, col in cols.items():
                        col.append(made[n])
                yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, fields[n][1]) for n, c in cols.items())], names=["id", *fields])
        bpe.pieces.clear()  # the worker lives on
        bpe.pairs.clear()

    schema = f"id {base.schema['id'].dataType.simpleString()}, " + ", ".join(f"{n} {t}" for n, (t, _) in fields.items())
    return base.mapInArrow(run, schema).withColumnRenamed("id", id_col)
