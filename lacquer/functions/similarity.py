"""Similarities of strings from 0 to 1. Scores are ratios of small integers, divided once, so equal ratios are equal numbers.

Each is defined for a pair of strings; over columns they are worked out for many pairs at a time, the
table of common subsequences a row at a time in the bits of one machine word for each pair.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Pairs worked out together, and the longest string that fits the bits of a machine word.
BATCH, WORD = 4096, 64


def common_length(a: str, b: str) -> int:
    """Length of the longest common subsequence, a row of the table at a time in the bits of an integer."""
    places: dict[str, int] = {}
    for k, c in enumerate(a):
        places[c] = places.get(c, 0) | 1 << k
    full = (1 << len(a)) - 1
    row = full
    for c in b:
        hit = row & places.get(c, 0)
        row = (row + hit | row - hit) & full
    return len(a) - row.bit_count()


def ratio(a: str, b: str) -> float:
    """Twice the common length by the sum of the lengths; 1 for two empty strings."""
    size = len(a) + len(b)
    return 2 * common_length(a, b) / size if size else 1.0


def same_initial_ratio(a: str, b: str) -> float:
    return ratio(a, b) if a[:1] == b[:1] else 0.0


def partial_ratio(a: str, b: str) -> float:
    """The best ratio of the shorter string with a window of the longer: its length, or cut off at either end."""
    if len(a) > len(b):
        a, b = b, a
    if not a:
        return 1.0 if not b else 0.0
    m = len(a)
    best = max(ratio(a, b[max(0, k) : k + m]) for k in range(1 - m, len(b)))
    return max(best, partial_one_way(b, a)) if m == len(b) else best


def partial_one_way(a: str, b: str) -> float:
    return max(ratio(a, b[max(0, k) : k + len(a)]) for k in range(1 - len(a), len(b)))


def ratio_or_partial(a: str, b: str) -> float:
    return max(ratio(a, b), partial_ratio(a, b))


def codes(texts: list[str], width: int, filler: int) -> np.ndarray:
    """The code points of each text in a row, filled up to width."""
    out = np.full((len(texts), width), filler, np.uint32)
    for k, t in enumerate(texts):
        out[k, : len(t)] = np.frombuffer(t.encode("utf-32-le", "surrogatepass"), "<u4")
    return out


def hits(a: np.ndarray, b: np.ndarray) -> list[np.ndarray]:
    """For each place of b, one word a pair with a bit for each place of a that has the same character."""
    out = []
    for j in range(b.shape[1]):
        same = np.zeros((len(a), WORD), bool)
        same[:, : a.shape[1]] = a == b[:, j : j + 1]
        out.append(np.packbits(same, axis=1, bitorder="little").view("<u8").ravel())
    return out


def common_lengths(n: int, found: list[np.ndarray]) -> np.ndarray:
    """The length of the longest common subsequence of each of n pairs, from hits()."""
    row = np.full(n, ~np.uint64(0))
    for hit in found:
        both = row & hit
        row = (row + both) | (row - both)
    return np.bitwise_count(~row).astype(np.int64)


def ratios(left: list[str], right: list[str]) -> np.ndarray:
    """ratio() of each pair."""
    out = np.empty(len(left))
    sizes = np.array([(min(len(a), len(b)), max(len(a), len(b))) for a, b in zip(left, right, strict=True)]).reshape(-1, 2)
    order = np.lexsort((sizes[:, 1], sizes[:, 0]))
    for at in range(0, len(order), BATCH):
        part = order[at : at + BATCH]
        short, long = sizes[part, 0].max(), sizes[part, 1].max()
        pairs = [(left[i], right[i]) if len(left[i]) <= len(right[i]) else (right[i], left[i]) for i in part]
        if short > WORD:
            out[part] = [ratio(a, b) for a, b in pairs]
            continue
        total = sizes[part].sum(1)
        common = common_lengths(len(part), hits(codes([a for a, _ in pairs], short, 0xFFFFFFFE), codes([b for _, b in pairs], long, 0xFFFFFFFF)))
        out[part] = np.where(total > 0, 2 * common / np.maximum(total, 1), 1.0)
    return out


def same_initial_ratios(left: list[str], right: list[str]) -> np.ndarray:
    same = np.array([a[:1] == b[:1] for a, b in zip(left, right, strict=True)], bool)
    return np.where(same, ratios(left, right), 0.0)


def one_way(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The best ratio of each row of a with a window of its row of b; all rows of a, and all of b, are equally long."""
    m, n = a.shape[1], b.shape[1]
    found, best = hits(a, b), np.zeros(len(a))
    for k in range(1 - m, n):
        window = found[max(0, k) : k + m]
        best = np.maximum(best, 2 * common_lengths(len(a), window) / (m + len(window)))
    return best


def partial_ratios(left: list[str], right: list[str]) -> np.ndarray:
    """partial_ratio() of each pair; pairs of the same two lengths are worked out together."""
    out = np.empty(len(left))
    groups: dict[tuple[int, int], list[int]] = {}
    for i, (a, b) in enumerate(zip(left, right, strict=True)):
        groups.setdefault((min(len(a), len(b)), max(len(a), len(b))), []).append(i)
    for (short, long), members in groups.items():
        for at in range(0, len(members), BATCH):
            part = members[at : at + BATCH]
            pairs = [(left[i], right[i]) if len(left[i]) <= len(right[i]) else (right[i], left[i]) for i in part]
            if not 0 < short <= WORD or short == long > WORD:
                out[part] = [partial_ratio(a, b) for a, b in pairs]
                continue
            a, b = codes([p[0] for p in pairs], short, 0), codes([p[1] for p in pairs], long, 0)
            best = one_way(a, b)
            out[part] = np.maximum(best, one_way(b, a)) if short == long else best
    return out


def ratios_or_partials(left: list[str], right: list[str]) -> np.ndarray:
    return np.maximum(ratios(left, right), partial_ratios(left, right))


#: The scorers that have a form for many pairs.
BATCHED = {ratio: ratios, same_initial_ratio: same_initial_ratios, partial_ratio: partial_ratios, ratio_or_partial: ratios_or_partials}


def scored(scorer, a: Column, b: Column) -> Column:
    """The scorer over two columns, in Arrow batches. It has to see both strings, so built-in functions don't do."""
    return scored_by({}, scorer, F.lit(""), a, b)


def scored_by(scorers: dict, default, field: Column, a: Column, b: Column) -> Column:
    """The scorer of each row's field, or the default one, over two columns."""

    @F.pandas_udf("double")
    def score(f: pd.Series, x: pd.Series, y: pd.Series) -> pd.Series:
        out, left, right = np.empty(len(x)), x.tolist(), y.tolist()
        members: dict = {}
        for i, name in enumerate(f.tolist()):
            members.setdefault(scorers.get(name, default), []).append(i)
        for scorer, at in members.items():
            pairs = [left[i] for i in at], [right[i] for i in at]
            batched = BATCHED.get(scorer)
            out[at] = batched(*pairs) if batched else [float(scorer(p, q)) for p, q in zip(*pairs, strict=True)]
        return pd.Series(out, dtype="float64")

    return score(field, a, b)
