"""Nearest sequences of equal length by differing places, on packed bits."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np

#: Pairs compared at once; their words stay in a core's cache.
TILE = 1 << 15


def _codes(texts: Sequence[str], length: int) -> np.ndarray:
    joined = "".join(texts)
    flat = np.frombuffer(joined.encode("ascii"), dtype=np.uint8) if joined.isascii() else np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    return flat.reshape(len(texts), length)


def _planes(rows: np.ndarray, alphabet: np.ndarray) -> list[np.ndarray]:
    """[bit of a letter's number] -> [word, row]: that bit of 64 letters in each word."""
    numbers = np.searchsorted(alphabet, rows) if rows.dtype != np.uint8 else np.searchsorted(alphabet, np.arange(256)).astype(np.uint16)[rows]
    out = []
    for bit in range(max(1, int(len(alphabet) - 1).bit_length())):
        packed = np.packbits((numbers >> bit & 1).astype(np.uint8), axis=1)
        words = np.zeros((len(rows), -(-packed.shape[1] // 8) * 8), dtype=np.uint8)
        words[:, : packed.shape[1]] = packed
        out.append(np.ascontiguousarray(words.view(np.uint64).T))
    return out


def nearest(asked: Sequence[str], known: Sequence[str], length: int) -> tuple[np.ndarray, np.ndarray]:
    """For each of ``asked`` the place in ``known`` of the first with the fewest differing letters, and how many differ; all of ``length`` letters."""
    if not length:
        return np.zeros(len(asked), dtype=np.int64), np.zeros(len(asked), dtype=np.int64)
    both = [_codes(asked, length), _codes(known, length)]
    seen = [np.flatnonzero(np.bincount(x.ravel(), minlength=256)) if x.dtype == np.uint8 else np.unique(x) for x in both]
    a, b = (_planes(x, np.union1d(*seen)) for x in both)
    kind = np.uint16 if length < 1 << 16 else np.uint32
    at, least = np.zeros(len(asked), dtype=np.int64), np.full(len(asked), length + 1, dtype=np.int64)
    wide = min(len(known), 4096)
    high = max(1, TILE // wide)
    for i in range(0, len(asked), high):
        mine = slice(i, i + high)
        for j in range(0, len(known), wide):
            n, m = len(at[mine]), min(wide, len(known) - j)
            differ, other, total = np.empty((n, m), dtype=np.uint64), np.empty((n, m), dtype=np.uint64), np.zeros((n, m), dtype=kind)
            for w in range(len(a[0])):
                np.bitwise_xor(a[0][w, mine, None], b[0][w, None, j : j + m], out=differ)
                for x, y in zip(a[1:], b[1:], strict=True):
                    np.bitwise_xor(x[w, mine, None], y[w, None, j : j + m], out=other)
                    np.bitwise_or(differ, other, out=differ)
                total += np.bitwise_count(differ)
            best = total.argmin(axis=1)
            few = total[np.arange(n), best].astype(np.int64)
            better = few < least[mine]
            at[mine] = np.where(better, best + j, at[mine])
            least[mine] = np.where(better, few, least[mine])
    return at, least
