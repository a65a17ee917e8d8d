"""Character n-grams hashed to buckets, over whole texts in blocks, and sums of bucket counts over a corpus."""

from __future__ import annotations

import numpy as np
import pyarrow as pa

#: Code points hashed at a time, so that a very long text takes bounded memory.
BLOCK = 200_000


def buckets(text: str, orders: tuple[int, ...], bits: int):
    """Arrays of bucket numbers, one for each order and block; every n-gram of the text is in one of them."""
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")
    for at in range(0, len(points), BLOCK):
        for n in orders:
            part = points[at : at + BLOCK + n - 1].astype(np.uint64)
            if len(part) < n:
                continue
            m = len(part) - n + 1
            h = part[:m] + np.uint64(n << 40)
            for k in range(1, n):
                h *= np.uint64(0x9E3779B97F4A7C15)
                h += part[k : k + m]
            h *= np.uint64(0xFF51AFD7ED558CCD)
            h ^= h >> np.uint64(32)
            h *= np.uint64(0xC4CEB9FE1A85EC53)
            yield (h >> np.uint64(64 - bits)).astype(np.int64)


def counted(text: str, orders: tuple[int, ...], bits: int) -> tuple[np.ndarray, np.ndarray]:
    """The buckets that the text has, and how often."""
    counts = np.zeros(1 << bits, np.int64)
    for b in buckets(text, orders, bits):
        counts += np.bincount(b, minlength=1 << bits)
    at = np.nonzero(counts)[0]
    return at, counts[at]


class Presence:
    """The distinct buckets of texts, with one buffer for all of them."""

    def __init__(self, orders: tuple[int, ...], bits: int):
        self.orders, self.bits, self.seen = orders, bits, np.zeros(1 << bits, bool)

    def __call__(self, text: str) -> np.ndarray:
        for b in buckets(text, self.orders, self.bits):
            self.seen[b] = True
        at = np.nonzero(self.seen)[0]
        self.seen[at] = False
        return at


#: Counts travel in this many pieces, so that they are added up by many tasks.
PIECES = 32


def pieces(counts: np.ndarray) -> dict[str, list]:
    """Counts of shape (rows, buckets) as rows (piece, counts) for the shuffle."""
    parts = np.split(counts.astype("<i8"), PIECES, axis=1)
    return {"piece": list(range(PIECES)), "counts": [p.tobytes() for p in parts]}


def add_pieces(key: tuple, group: pa.Table) -> pa.Table:
    total = 0
    for x in group.column("counts").to_pylist():
        total = total + np.frombuffer(x, "<i8")
    return pa.table({"piece": pa.array([key[0].as_py()], pa.int32()), "counts": pa.array([total.tobytes()], pa.binary())})


def joined(rows: list, n_rows: int, bits: int) -> np.ndarray:
    """The sums back in shape (rows, buckets), zero where no row came."""
    out = np.zeros((n_rows, PIECES, (1 << bits) // PIECES), np.int64)
    for piece, counts in rows:
        out[:, piece, :] = np.frombuffer(counts, "<i8").reshape(n_rows, -1)
    return out.reshape(n_rows, -1)
