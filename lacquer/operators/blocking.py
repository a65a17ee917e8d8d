"""Candidate pairs for similarities, without losing a pair at or over the threshold.

At a threshold, a string can lose only so many characters to a similar one, and have so many put in
between. One deletion or insertion breaks at most one of several separate runs of characters. So of
one run more than there can be changes, the similar string has at least one whole: the shorter string
gives that many runs, the rarest ones in the corpus that don't overlap, and the longer one all its runs
of that length. Pairs meet by a run, at places that the changes can bring about, and if the shorter
string has no more characters that the longer one lacks than it can lose, by themselves and in their
order. For runs of single characters deletions alone count, so that there always are enough of them.
Runs of half the length are taken too, so that a string with a common part of its own length gives runs
of the rest of it.

Lengths of partners are taken in bands, since partners of nearly the same length allow longer runs.
A run's counts, in buckets of a bounded number, say which runs are rare, which buckets go to one task,
and to how many tasks the longer strings of hot ones are dealt; they never decide whether a pair is found.
A string goes to a task once, whatever the number of its runs there and on either side, and pairs are
met and sieved in the task and leave it with their strings, so what is written grows with the strings
and neither with the pairs that share a run nor with those that are then scored.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

EPSILON = 1e-9
#: Buckets in which runs are counted; the longer side's runs and the pairs of equal runs that a task may have; pairs that are worth a task.
BUCKET_BITS = 17
PART_ROWS = 4_000_000
TASK_PAIRS = 4_000_000_000
FEW_PAIRS = 10_000_000
#: Places times runs of texts that are worked out together; pairs that are sieved together, by one word of each and further.
CELLS = 1 << 22
SIEVED = 1 << 17
ANYWHERE = 1 << 30
MIX = np.uint64(0x9E3779B97F4A7C15)
SHIFT = np.uint64(64 - BUCKET_BITS)
#: The longest string that fits the bits of a machine word.
WORD = 64


class Search(NamedTuple):
    """What pairs are sought among values of a field: at a threshold over 0, by windows too, or only with the same first character."""

    threshold: float
    partial: bool = False
    same_initial: bool = False


def bands(la: int, threshold: float, partial: bool) -> list[tuple[int, int, int, int, int, int, int]]:
    """(run length, runs, least and most length of the partner, places before and after, characters lost at most) of a string of la characters."""
    t = threshold
    longest = int(la * (2 - t) / t + EPSILON)
    if partial:
        # a window is no longer than la, and begins no later than the longer one's surplus and the deletions; of the whole partner, the longest that the threshold allows counts
        changes, deletions = int((1 - t) * 2 * la / t + EPSILON), int(la - la * t / (2 - t) + EPSILON)
        return [(*runs_of(la, changes, deletions), la, ANYWHERE, deletions, deletions + changes, deletions)]
    out, low, width = [], 0, 1
    while la + low <= longest:
        high = min(low + width - 1, longest - la)
        deletions = max((most_changes(la, d, t) - d) // 2 for d in range(low, high + 1))
        insertions = max((most_changes(la, d, t) + d) // 2 for d in range(low, high + 1))
        changes = max(most_changes(la, d, t) for d in range(low, high + 1))
        if deletions >= 0:
            out.append((*runs_of(la, changes, deletions), la + low, la + high, deletions, insertions, deletions))
        low, width = high + 1, width * 2
    return out


def most_changes(la: int, more: int, threshold: float) -> int:
    """Deletions and insertions between strings of la and la + more characters, which are as even or odd as the lengths' sum."""
    changes = int((1 - threshold) * (2 * la + more) + EPSILON)
    return changes - (changes + more) % 2


def runs_of(la: int, changes: int, deletions: int) -> tuple[int, int]:
    """The length of the runs and how many of them a string gives."""
    length = la // (changes + 1)
    return (length, changes + 1) if length > 1 else (1, min(la, deletions + 1))


def lengths_of(length: int) -> tuple[int, ...]:
    """The lengths that runs may have where this one always gives enough of them."""
    half = (length + 1) // 2
    return (length, half) if half > 1 and half < length else (length,)


def rarest(counts: dict[int, np.ndarray], size: int, runs: int) -> tuple[np.ndarray, np.ndarray]:
    """Starts and lengths of `runs` runs that don't overlap, whose counts add up to the least, for each of many texts of a size.

    counts has by length a row for each text and a column for each place. Of no text fewer runs are given.
    """
    n = len(next(iter(counts.values())))
    if list(counts) == [1]:
        at = np.argsort(counts[1], axis=1, kind="stable")[:, :runs]
        return at, np.ones_like(at)
    # best[i]: for each text the least sum of k runs from place i on; taken[k][i]: the length of the run that starts there, 0 for none
    width = size + max(counts) + 1
    last, taken = np.zeros((width, n)), np.zeros((runs, size, n), np.int16)
    for k in range(runs):
        best = np.full((width, n), np.inf)
        for i in range(size - 1, -1, -1):
            best[i] = best[i + 1]
            for length, held in counts.items():
                if i < held.shape[1]:
                    with_it = held[:, i] + last[i + length]
                    less = with_it < best[i]
                    best[i][less] = with_it[less]
                    taken[k, i, less] = length
        last = best
    out, of, i, texts = np.zeros((n, runs), np.int64), np.zeros((n, runs), np.int64), np.zeros(n, np.int64), np.arange(n)
    for k in range(runs - 1, -1, -1):
        while (skip := taken[k, i, texts] == 0).any():
            i += skip
        out[:, k], of[:, k] = i, taken[k, i, texts]
        i = i + of[:, k]
    return out, of


class Reach:
    """Bands and lengths of runs for the lengths of values that there are in each field."""

    def __init__(self, searches: dict[str, Search], default: Search, there: dict[str, set[int]]):
        self.searches, self.default, self.there, self.fields = searches, default, there, list(there)
        self.known_bands: dict[tuple[str, int], list[tuple]] = {}
        self.known_lengths: dict[tuple[str, int], frozenset[int]] = {}

    def bands(self, field: str, la: int) -> list[tuple[int, int, int, int, int, int, int]]:
        """The bands of a value of la characters in which there are partners."""
        if (field, la) not in self.known_bands:
            s = self.searches.get(field, self.default)
            self.known_bands[field, la] = [b for b in bands(la, s.threshold, s.partial) if any(b[2] <= n <= b[3] for n in self.there[field])]
        return self.known_bands[field, la]

    def lengths(self, field: str, lb: int) -> frozenset[int]:
        """The lengths of runs by which a value of lb characters can be met as the longer one."""
        if (field, lb) not in self.known_lengths:
            self.known_lengths[field, lb] = frozenset(n for la in self.there[field] if la <= lb for b in self.bands(field, la) if b[2] <= lb <= b[3] for n in lengths_of(b[0]))
        return self.known_lengths[field, lb]


class Texts:
    """Values of a batch as one row of code points, and the hashes of their runs."""

    def __init__(self, batch: pa.RecordBatch, searches: dict[str, Search], default: Search):
        self.fields, self.vids = batch.column("field").to_pylist(), batch.column("vid").to_numpy()
        texts = batch.column("value").to_pylist()
        self.searches = [searches.get(f, default) for f in self.fields]
        self.codes = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64)
        self.sizes = np.fromiter(map(len, texts), np.int64, len(texts))
        heads = [(f, t[0] if s.same_initial else "") for f, t, s in zip(self.fields, texts, self.searches, strict=True)]
        hashed = {(f, c): xxhash.xxh64_intdigest(f"{f}\x00{c}" if c else f"{f}") for f, c in set(heads)}
        self.heads = np.fromiter(map(hashed.__getitem__, heads), np.uint64, len(texts))
        self.owner = np.repeat(np.arange(len(texts)), self.sizes)
        self.starts = np.concatenate(([0], np.cumsum(self.sizes)))
        self.known: dict[int, tuple] = {}

    def bags(self) -> np.ndarray:
        """Three words for each text, with a bit for the hash of each character and of which one of its like it is, in the first word or in the other two.

        Of the bits of one text that another lacks there are no more than of its characters.
        """
        out = np.zeros((3, len(self.sizes)), np.uint64)
        one, last = np.uint64(1), np.uint64(63)
        for size in np.unique(self.sizes):
            mine = np.nonzero(self.sizes == size)[0]
            code = np.sort(self.codes[self.starts[mine][:, None] + np.arange(size)].astype(np.uint32), axis=1)
            code, nth = np.ascontiguousarray(code.T).astype(np.uint64), np.zeros(len(mine), np.uint64)
            bags = np.zeros((3, len(mine)), np.uint64)
            for j in range(size):
                nth = (nth + one) * (code[j] == code[j - 1]) if j else nth
                mixed = (code[j] * np.uint64(64) + nth) * MIX
                bit, upper = one << (mixed >> np.uint64(57) & last), mixed >> last
                bags[0] |= one << (mixed >> np.uint64(58))
                bags[1] |= bit * (one - upper)
                bags[2] |= bit * upper
            out[:, mine] = bags
        return out

    def letters(self) -> np.ndarray:
        """A number under WORD for each character; equal characters have the same."""
        return (self.codes * MIX >> np.uint64(58)).astype(np.uint8)

    def runs(self, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Text, place and hash of each run of this length, and where each text's runs begin."""
        if length not in self.known:
            n = max(0, len(self.codes) - length + 1)
            at = np.nonzero(self.owner[:n] == self.owner[length - 1 :][:n])[0]
            of = self.owner[at]
            self.known[length] = of, at - self.starts[of], self.hashed(of, at, length), np.concatenate(([0], np.cumsum(np.maximum(self.sizes - length + 1, 0))))
        return self.known[length]

    def hashed(self, of: np.ndarray, at: np.ndarray, length: int) -> np.ndarray:
        """The hashes of runs of texts that begin at these code points of all."""
        h = self.heads[of].copy()
        for k in range(length):
            h = (h ^ self.codes[at + k]) * MIX
            h ^= h >> np.uint64(29)
        h *= np.uint64(0xBF58476D1CE4E5B9)
        h ^= h >> np.uint64(32)
        return h


class Routes(NamedTuple):
    """For each bucket of runs the first task that has it, -1 for none, and to how many tasks its longer strings are dealt."""

    first: np.ndarray
    parts: np.ndarray
    tasks: int


def routes(met: np.ndarray, given: np.ndarray, cores: int) -> Routes:
    """Buckets to tasks in their order, by the pairs of equal runs: met counts those of longer strings, given those that shorter ones give."""
    used = np.nonzero(met * given)[0]
    first, parts = np.full(len(met), -1, np.int64), np.ones(len(met), np.int64)
    if not len(used):
        return Routes(first, parts, 1)
    load = met[used].astype(np.float64) * given[used]
    total = load.sum()
    n = int(min(len(used), 1 + max(met[used].sum() // PART_ROWS, total // TASK_PAIRS, min(cores, total // FEW_PAIRS))))
    slot = np.minimum((np.cumsum(load) - load / 2) * n / total, n - 1).astype(np.int64)
    of_slot = lambda x: np.bincount(slot, x, n)
    dealt = np.maximum(of_slot(met[used]) // PART_ROWS, of_slot(load) // (2 * TASK_PAIRS)).astype(np.int64) + (of_slot(None) > 0)
    first[used], parts[used] = (np.cumsum(dealt) - dealt)[slot], dealt[slot]
    return Routes(first, parts, int(dealt.sum()))


def packed(strings: pa.RecordBatch, fields: dict[str, int], runs: np.ndarray, given: list[np.ndarray]) -> bytes:
    """Strings (field, value, vid), how many runs each of them gives, and places, lengths and bands of these, as bytes."""
    text = strings.column("value").cast(pa.large_string())
    ends = np.frombuffer(text.buffers()[1], np.int64)[text.offset : text.offset + len(text) + 1]
    data = text.buffers()[2].slice(ends[0], ends[-1] - ends[0]).to_pybytes()
    field = np.fromiter(map(fields.__getitem__, strings.column("field").to_pylist()), np.int64, len(text))
    numbers = np.concatenate([[len(text)], field, np.diff(strings.column("vid").to_numpy(), prepend=0), np.diff(ends), runs, *given], dtype=np.int64)
    # bytes of the same place in a number stand together, as most of them are zero
    planes = numbers.view(np.uint8).reshape(-1, 8).T.tobytes()
    return np.array([len(planes), len(data)]).tobytes() + pa.compress(planes + data, "zstd", asbytes=True)


def unpacked(data: bytes, fields: list[str]) -> tuple[pa.RecordBatch, np.ndarray, list[np.ndarray]]:
    """What packed() was given."""
    size, more = np.frombuffer(data, np.int64, 2).tolist()
    raw = pa.decompress(memoryview(data)[16:], size + more, "zstd", asbytes=True)
    numbers = np.ascontiguousarray(np.frombuffer(raw, np.uint8, size).reshape(8, -1).T).view(np.int64).ravel()
    n = int(numbers[0])
    field, steps, sizes, runs = numbers[1 : 1 + 4 * n].reshape(4, n)
    ends = np.concatenate(([0], np.cumsum(sizes)))
    value = pa.Array.from_buffers(pa.large_string(), n, [None, pa.py_buffer(ends), pa.py_buffer(raw).slice(size)])
    strings = pa.RecordBatch.from_arrays([pa.array([fields[k] for k in field.tolist()], pa.string()), value, pa.array(np.cumsum(steps))], ["field", "value", "vid"])
    return strings, runs, list(numbers[1 + 4 * n :].reshape(3, -1))


class Side:
    """Strings in a task: themselves, vids, sizes, bags and letters, read a batch at a time."""

    def __init__(self):
        self.kept: list[tuple] = []
        self.strings: list[pa.RecordBatch] = []
        self.n = 0

    def add(self, texts: Texts, strings: pa.RecordBatch) -> None:
        self.kept.append((texts.vids, texts.sizes, texts.bags(), texts.letters()))
        self.strings.append(strings)
        self.n += len(texts.sizes)

    def close(self) -> None:
        self.vids, self.sizes, self.bags, self.letters = (np.concatenate(x, axis=-1) for x in zip(*self.kept, strict=True))
        self.starts = np.concatenate(([0], np.cumsum(self.sizes)))
        self.field, self.value = (pa.concat_arrays([x.column(n) for x in self.strings]) for n in ("field", "value"))
        self.kept, self.strings = [], []


def lost_in_order(side: Side, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Of each pair of a shorter string of no more than WORD characters and a longer one, how many characters at least the shorter one loses.

    The longest common subsequence of their letters, which is no shorter than that of their characters.
    """
    mark = np.zeros(len(side.sizes), bool)
    mark[a] = True
    mine = np.nonzero(mark)[0]
    rank = np.empty(len(mark), np.int64)
    rank[mine] = np.arange(len(mine)) * WORD
    places = np.zeros(len(mine) * WORD, np.uint64)
    for i in range(int(side.sizes[mine].max())):
        there = mine[side.sizes[mine] > i]
        places[rank[there] + side.letters[side.starts[there] + i]] |= np.uint64(1 << i)
    base, begin, size = rank[a], side.starts[b], side.sizes[b]
    least, most = int(size.min()), int(size.max())
    row = np.full(len(a), ~np.uint64(0))
    for j in range(most):
        if j < least:
            hit = places[base + side.letters[begin + j]]
        else:
            hit = places[base + side.letters[np.minimum(begin + j, len(side.letters) - 1)]] * (size > j)
        both = row & hit
        row = (row + both) | (row - both)
    return side.sizes[a] - np.bitwise_count(~row)


def meetings(bags: np.ndarray, lacks: np.ndarray, low: np.ndarray, high: np.ndarray, lost: np.ndarray, group: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Runs of the shorter side, and of the longer one among those from low to high, where the first's bags have no more bits that the second's lack than it can lose.

    Runs with the same group, which follow each other, have the same low, high and lost.
    """
    few = lambda a, b, most: np.bitwise_count(bags[1][a] & lacks[1][b]) + np.bitwise_count(bags[2][a] & lacks[2][b]) <= most
    begins = np.concatenate(([0], np.nonzero(np.diff(group))[0] + 1)) if len(group) else np.zeros(0, np.int64)
    sizes, widths = np.diff(np.concatenate((begins, [len(group)]))), high[begins] - low[begins]
    large = sizes * widths >= 4096
    for begin, size, width in zip(begins[large].tolist(), sizes[large].tolist(), widths[large].tolist(), strict=True):
        lo, most = int(low[begin]), lost[begin]
        for x in range(lo, lo + width, SIEVED):
            right = lacks[0, x : min(x + SIEVED, lo + width)]
            step = max(1, SIEVED // len(right))
            for y in range(begin, begin + size, step):
                a, b = np.nonzero(np.bitwise_count(bags[0, y : min(y + step, begin + size), None] & right) <= most)
                a, b = a + y, b + x
                both = np.nonzero(few(a, b, most))[0]
                if len(both):
                    yield a[both], b[both]
    rest = np.nonzero(np.repeat(~large, sizes) & (high > low))[0]
    wide = high[rest] - low[rest]
    ends = np.cumsum(wide)
    at = 0
    while at < len(rest):
        to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + SIEVED, "right")))
        a = np.repeat(rest[at:to], wide[at:to])
        b = np.arange(len(a)) + np.repeat(low[rest[at:to]] - (ends[at:to] - wide[at:to] - (ends[at - 1] if at else 0)), wide[at:to])
        mine = np.nonzero(np.bitwise_count(bags[0][a] & lacks[0][b]) <= lost[a])[0]
        a, b = a[mine], b[mine]
        both = np.nonzero(few(a, b, lost[a]))[0]
        yield a[both], b[both]
        at = to


def met_in(task: int, sent: list[bytes], reach: Reach, route: Routes) -> Iterator[pa.RecordBatch]:
    """Pairs (field, a, b, va, vb) of vids and strings that meet in a task, each of them a few times at most."""
    side, runs, kinds = Side(), [], {}
    for data in sent:
        strings, times, (place, length, band) = unpacked(data, reach.fields)
        texts, of = Texts(strings, reach.searches, reach.default), np.repeat(np.arange(len(times)), times)
        kind = np.fromiter((kinds.setdefault((texts.fields[k], n, b), len(kinds)) for k, n, b in zip(of.tolist(), texts.sizes[of].tolist(), band.tolist(), strict=True)), np.int64, len(of))
        h = np.empty(len(of), np.uint64)
        for m in np.unique(length):
            mine = length == m
            h[mine] = texts.hashed(of[mine], texts.starts[of[mine]] + place[mine], m)
        runs.append((side.n + of, place, length, kind, h))
        side.add(texts, strings)
    side.close()
    own, place, length, kind, h = (np.concatenate(x) for x in zip(*runs, strict=True))
    if not len(own):
        return
    least, most, before, after, lost = np.array([reach.bands(f, n)[k][2:] for f, n, k in kinds], np.int64).T
    both = np.array([reach.searches.get(f, reach.default).partial for f, _, _ in kinds])
    keys, key = np.unique(h, return_inverse=True)

    found, n = [], 0
    for data in sent:
        texts = Texts(unpacked(data, reach.fields)[0], reach.searches, reach.default)
        for m in np.unique(length).tolist():
            of, at, h, _ = texts.runs(m)
            nth = np.minimum(np.searchsorted(keys, h), len(keys) - 1)
            bucket = (h >> SHIFT).astype(np.int64)
            mine = np.nonzero((keys[nth] == h) & (route.first[bucket] + texts.vids[of] % route.parts[bucket] == task))[0]
            found.append((nth[mine].astype(np.int32), at[mine].astype(np.int32), (n + of[mine]).astype(np.int32)))
        n += len(texts.sizes)
    nth, at, who = (np.concatenate(x) for x in zip(*found, strict=True))
    if not len(nth):
        return
    width = int(at.max()) + 2
    spot = nth.astype(np.int64) * width + at
    ordered = np.argsort(spot, kind="stable")
    at, who, spot = at[ordered], who[ordered], spot[ordered]
    del nth, ordered, found
    low = np.searchsorted(spot, key * width + np.maximum(place - before[kind], 0).clip(max=width - 1))
    surplus = both[kind] * (side.sizes.max() - side.sizes[own])
    high = np.searchsorted(spot, key * width + np.minimum(place + after[kind] + surplus, width - 1), "right")
    del spot
    by = np.lexsort((kind, high, low))
    low, high, kind, place, own = low[by], high[by], kind[by], place[by], own[by]
    lost = lost[kind]
    new = (np.diff(low) != 0) | (np.diff(high) != 0) | (np.diff(kind) != 0)
    group = np.concatenate(([0], np.cumsum(new)))

    def sieved(parts: list[tuple[np.ndarray, np.ndarray]]) -> pa.RecordBatch:
        x, y = (np.concatenate(p) for p in zip(*parts, strict=True))
        k, i, j = kind[x], own[x], who[y].astype(np.int64)
        va, vb, la, lb = side.vids[i], side.vids[j], side.sizes[i], side.sizes[j]
        # of two equally long strings, the shorter one is that with the smaller vid, or either if windows are taken of both
        ok = (lb >= least[k]) & (lb <= most[k]) & (va != vb) & ((la < lb) | (va < vb) | both[k])
        ok = np.nonzero(ok & (~both[k] | (at[y] - place[x] <= after[k] + lb - la)))[0]
        x, i, j, la = x[ok], i[ok], j[ok], la[ok]
        ok = la > WORD
        fits = np.nonzero(~ok)[0]
        if len(fits):
            ok[fits] = lost_in_order(side, i[fits], j[fits]) <= lost[x[fits]]
        i, j = i[ok], j[ok]
        swap = side.vids[i] > side.vids[j]
        i, j = np.divmod(np.unique(np.where(swap, j, i) * side.n + np.where(swap, i, j)), side.n)
        columns = {"field": side.field.take(pa.array(i)), "a": pa.array(side.vids[i]), "b": pa.array(side.vids[j]), "va": side.value.take(pa.array(i)), "vb": side.value.take(pa.array(j))}
        return pa.RecordBatch.from_pydict(columns | {n: columns[n].cast(pa.string()) for n in ("va", "vb")})

    parts, waiting = [], 0
    for pair in meetings(side.bags[:, own], ~side.bags[:, who], low, high, lost, group):
        parts.append(pair)
        waiting += len(pair[0])
        if waiting >= SIEVED // 4:
            yield sieved(parts)
            parts, waiting = [], 0
    if parts:
        yield sieved(parts)


def met_pairs(values: DataFrame, searches: dict[str, Search], default: Search) -> DataFrame:
    """Pairs (field, a, b, va, vb) of values (field, value, vid) that can reach the threshold of their field's search, some of them more than once.

    values are read several times, so they should be staged.
    """
    context = values.sparkSession.sparkContext
    keyed = values.where(F.length("value") > 0).select("field", "value", "vid")
    # a length is a row for each field; only bands and runs for lengths that there are matter
    there: dict[str, set[int]] = {}
    for r in keyed.groupBy("field", F.length("value").alias("n")).count().collect():
        there.setdefault(r["field"], set()).add(r["n"])

    reach = Reach(searches, default, there)

    def met_by(texts: Texts) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Text and hash of the runs by which texts can be met as the longer ones."""
        lengths = [reach.lengths(f, n) for f, n in zip(texts.fields, texts.sizes.tolist(), strict=True)]
        for length in sorted(set().union(*lengths)):
            wanted = np.fromiter((length in x for x in lengths), bool, len(lengths))
            of, _, h, _ = texts.runs(length)
            yield of[wanted[of]], h[wanted[of]]

    def given_by(texts: Texts, counts: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, int]]:
        """Text, place, length and hash of the runs that texts give as the shorter ones, for one of their bands."""
        groups: dict[tuple[str, int], list[int]] = {}
        for k, of in enumerate(zip(texts.fields, texts.sizes.tolist(), strict=True)):
            groups.setdefault(of, []).append(k)
        for (field, size), members in groups.items():
            for band, (length, n, *_) in enumerate(reach.bands(field, size)):
                step = max(1, CELLS // (size * n))
                for x in range(0, len(members), step):
                    mine, hashes, held = np.array(members[x : x + step]), {}, {}
                    for m in lengths_of(length):
                        _, _, h, starts = texts.runs(m)
                        hashes[m] = h[starts[mine][:, None] + np.arange(size - m + 1)]
                        held[m] = counts[(hashes[m] >> SHIFT).astype(np.int64)]
                    at, of = rarest(held, size, n)
                    h = np.empty(at.shape, np.uint64)
                    for m in hashes:
                        t, k = np.nonzero(of == m)
                        h[t, k] = hashes[m][t, at[t, k]]
                    yield np.repeat(mine, at.shape[1]), at.ravel(), of.ravel(), h.ravel(), band

    def counted(hashes_of) -> np.ndarray:
        """How many runs of all texts fall in each bucket."""

        def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = np.zeros(1 << BUCKET_BITS, np.int64)
            for batch in batches:
                for h in hashes_of(Texts(batch, searches, default)):
                    total += np.bincount((h >> SHIFT).astype(np.int64), minlength=1 << BUCKET_BITS)
            used = np.nonzero(total)[0]
            yield pa.RecordBatch.from_pydict({"bucket": pa.array(used, pa.int32()), "n": pa.array(total[used])})

        counts = np.zeros(1 << BUCKET_BITS, np.int64)
        for r in keyed.mapInArrow(count, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect():
            counts[r["bucket"]] = r["n"]
        return counts

    met = counted(lambda texts: (h for _, h in met_by(texts)))
    sent = context.broadcast(met)
    route = routes(met, counted(lambda texts: (h for _, _, _, h, _ in given_by(texts, sent.value))), context.defaultParallelism)
    way = context.broadcast(tuple(route))

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The strings of each batch that a task has, as bytes, with the runs that they give it as shorter ones."""
        first, parts, _ = way.value
        fields = {f: k for k, f in enumerate(reach.fields)}
        for batch in batches:
            batch = batch.take(pa.array(np.argsort(batch.column("vid").to_numpy())))
            texts, rows = Texts(batch, searches, default), []
            n = len(texts.sizes)
            sendings = [np.zeros(0, np.int64)]
            for of, h in met_by(texts):
                bucket = (h >> SHIFT).astype(np.int64)
                task = first[bucket]
                sendings.append(np.unique((task + texts.vids[of] % parts[bucket])[task >= 0] * n + of[task >= 0]))
            given = []
            for of, place, length, h, band in given_by(texts, sent.value):
                bucket = (h >> SHIFT).astype(np.int64)
                times = parts[bucket] * (first[bucket] >= 0)
                nth = np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)
                given.append(np.stack([(np.repeat(first[bucket], times) + nth) * n + np.repeat(of, times), *(np.repeat(x, times) for x in (place, length)), np.full(len(nth), band)]))
            given = np.concatenate(given, axis=1) if given else np.zeros((4, 0), np.int64)
            given = given[:, np.argsort(given[0], kind="stable")]
            told = np.unique(np.concatenate([*sendings, given[0]]))
            ends = np.searchsorted(given[0], told, "right")
            runs, (task, of) = np.diff(ends, prepend=0), np.divmod(told, n)
            for x in np.split(np.arange(len(told)), np.nonzero(np.diff(task))[0] + 1):
                if len(x):
                    rows.append((task[x[0]], packed(batch.take(pa.array(of[x])), fields, runs[x], list(given[1:, ends[x[0]] - runs[x[0]] : ends[x[-1]]]))))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.binary())], ["task", "data"])

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list[bytes]] = {}
        for batch in batches:
            for r in batch.to_pylist():
                held.setdefault(r["task"], []).append(r["data"])
        for task, data in held.items():
            yield from met_in(task, data, reach, Routes(*way.value))

    # few bytes can be many pairs, so tasks are not merged by their bytes
    return keyed.mapInArrow(send, "task int, data binary").repartitionById(route.tasks, "task").mapInArrow(meet, "field string, a long, b long, va string, vb string")


def candidate_pairs(values: DataFrame, searches: dict[str, Search], default: Search) -> DataFrame:
    """Distinct pairs (field, a, b, va, vb) of values (field, value, vid) that can reach the threshold of their field's search."""
    return met_pairs(values, searches, default).dropDuplicates(["a", "b"])
