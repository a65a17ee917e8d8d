"""SimHash near-duplicates by meet-in-the-middle ball hashing.

Fingerprints at most `radius` bits apart share a value at most radius/2 bits from both: each distinct
fingerprint emits every value of that ball, 2081 of them for a radius of 4, and fingerprints that emit
the same value are linked. Of radius + 1 blocks of bits, the flips that lead from two such fingerprints
to the shared value leave one block untouched, in both and in the value. So the shuffle is on the
variants' blocks: a fingerprint travels once for each block, to where all variants with that block lie,
and its variants that flip only other bits are written out there. That is radius + 1 rows a fingerprint
in a corpus of any size. Each group of equal variants is linked as a star from its smallest member and
every such link is verified, which keeps the components without emitting all pairs.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators.components import components
from .common import slices, stage, table, texts_of, unused

BITS = 64
#: Shingles hashed at a time, so that a very long text takes bounded memory.
BLOCK = 50_000
#: Variants written out at a time, and by a task.
CHUNK_VARIANTS, TASK_VARIANTS = 3_000_000, 60_000_000


def fingerprint(text: bytes, shingle: int = 4, seed: int = 42) -> int:
    """SimHash of the word shingles of a text: A-Z in lower case, repeats counted; 0 without words."""
    words = text.lower().split()
    n = max(1, len(words) - shingle + 1)
    if not words:
        return 0
    counts = np.zeros(BITS, np.int64)
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))[:n].tolist()
    stops = ends[min(shingle, len(words)) - 1 :].tolist()
    digest = xxhash.xxh64_intdigest
    for at in range(0, n, BLOCK):
        h = np.fromiter((digest(joined[i:j], seed) for i, j in zip(starts[at : at + BLOCK], stops[at : at + BLOCK], strict=True)), "<u8")
        counts += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * counts > n, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, shingle: int = 4, seed: int = 42, keep: Column | None = None) -> DataFrame:
    """(doc_id, fp) for each row of docs; fp holds the 64 bits as a signed long. keep: a long to carry along as `kept`."""
    kept = ["kept"] if keep is not None else []

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            fps = np.array([fingerprint(t, shingle, seed) for t in texts_of(batch)], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(fps), *map(batch.column, kept)], ["doc_id", "fp", *kept])

    taken = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", *[keep.alias(k) for k in kept])
    return taken.mapInArrow(run, ", ".join(f"{c} long" for c in ("doc_id", "fp", *kept)))


def flips(bits: range, most: int) -> list[np.ndarray]:
    """For each number of flipped bits up to most, the masks of all ways to flip that many of bits."""
    return [np.array([sum(1 << b for b in c) for c in combinations(bits, k)], np.uint64) for k in range(most + 1)]


def collisions(variants: np.ndarray, owners: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(least, other) owners of equal variants: a star for each variant that is there more than once."""
    none = np.empty(0, owners.dtype)
    in_order = np.sort(variants)
    twice = in_order[1:][in_order[1:] == in_order[:-1]]
    if not len(twice):
        return none, none
    slots = np.zeros(1 << 20, bool)
    mixed = lambda v: ((v * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(44)).astype(np.int64)
    slots[mixed(twice)] = True
    at = np.nonzero(slots[mixed(variants)])[0]
    v, o = variants[at], owners[at]
    order = np.lexsort((o, v))
    v, o = v[order], o[order]
    first = np.concatenate(([True], v[1:] != v[:-1]))
    least = o[np.maximum.accumulate(np.where(first, np.arange(len(v)), 0))]
    return least[~first], o[~first]


def ball_links(fps: np.ndarray, top: int, radius: int, known: dict | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Links (smaller, larger) between distinct fingerprints, sorted, whose shared values differ from them below the `top` leading bits only.

    Fingerprints of many values of those leading bits may come together, as long as their variants fit
    a chunk; a longer row has to have one value, and is written out in parts by further leading bits.
    known holds masks from one call to the next.
    """
    half, free = radius // 2, BITS - top
    size, extra = sum(comb(free, k) for k in range(half + 1)), 0
    while (len(fps) * size) >> extra > CHUNK_VARIANTS and extra < free:
        extra += 1
    known = {} if known is None else known
    if free - extra not in known:
        known[free - extra] = flips(range(free - extra), half)
    shift, masks = np.uint64(free - extra), known[free - extra]
    found: list[np.ndarray] = []
    heads = [None] if not extra else np.arange(1 << extra, dtype=np.uint64) | (fps[0] >> np.uint64(free)) << np.uint64(extra)
    for head in heads:
        off = np.zeros(len(fps), np.uint64) if head is None else (fps >> shift) ^ head
        apart = np.bitwise_count(off)
        variants, owners = [], []
        for e in range(half + 1):
            mine = np.nonzero(apart == e)[0]
            if len(mine):
                moved = fps[mine] ^ (off[mine] << shift)
                flip = np.concatenate(masks[: half - e + 1])
                variants.append((moved[:, None] ^ flip[None, :]).ravel())
                owners.append(np.repeat(mine.astype(np.int32), len(flip)))
        if variants:
            least, other = collisions(np.concatenate(variants), np.concatenate(owners))
            found.append(np.unique(least.astype(np.int64) * len(fps) + other))
    pair = np.unique(np.concatenate(found)) if found else np.empty(0, np.int64)
    a, b = fps[pair // max(1, len(fps))], fps[pair % max(1, len(fps))]
    near = (np.bitwise_count(a ^ b) <= radius) & (a != b)
    return a[near], b[near]


def blocks(radius: int) -> list[tuple[int, int]]:
    """(rotation, bits) of radius + 1 blocks of bits: a rotation brings a block to the front."""
    widths = [BITS // (radius + 1) + (k < BITS % (radius + 1)) for k in range(radius + 1)]
    return [(sum(widths[:k]), w) for k, w in enumerate(widths)]


def rotated(fps: np.ndarray, by: int) -> np.ndarray:
    return fps if not by % BITS else (fps << np.uint64(by % BITS)) | (fps >> np.uint64(BITS - by % BITS))


def near_links(fps: DataFrame, n_distinct: int, radius: int = 4) -> DataFrame:
    """Star links (a, b) between distinct fingerprints (fp) at most radius bits apart; their closure is that of all links."""
    if radius % 2:
        raise ValueError("the radius must be even, so that both balls meet halfway")
    parts = blocks(radius)

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fp = batch.column("fp").to_numpy().view(np.uint64)
            turned = np.concatenate([rotated(fp, by) for by, _ in parts])
            block = np.repeat(np.arange(len(parts), dtype=np.int32), len(fp))
            value = np.concatenate([(rotated(fp, by) >> np.uint64(BITS - bits)).astype(np.int32) for by, bits in parts])
            yield pa.RecordBatch.from_arrays([pa.array(block), pa.array(value), pa.array(turned.view(np.int64))], ["block", "value", "fp"])

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come sorted by block and value; whole values are held until their variants fill a chunk."""
        held: list[np.ndarray] = []
        known: dict[int, list[np.ndarray]] = {}
        block, n = -1, 0

        def done() -> pa.RecordBatch:
            by, bits = parts[block]
            found = [ball_links(np.unique(group), bits, radius, known) for group in chunks(held, bits)]
            a, b = (rotated(np.concatenate([f[k] for f in found]), BITS - by) for k in (0, 1))
            return pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], ["a", "b"])

        def chunks(groups: list[np.ndarray], bits: int) -> Iterator[np.ndarray]:
            """The groups one by one if they are large, else joined up to a chunk."""
            most, joined, size = CHUNK_VARIANTS // sum(comb(BITS - bits, k) for k in range(radius // 2 + 1)), [], 0
            for g in groups:
                if joined and size + len(g) > most:
                    yield np.concatenate(joined)
                    joined, size = [], 0
                joined.append(g)
                size += len(g)
            if joined:
                yield np.concatenate(joined)

        for batch in batches:
            of, value = batch.column("block").to_numpy(), batch.column("value").to_numpy()
            fp = batch.column("fp").to_numpy().view(np.uint64)
            key = of.astype(np.int64) << 32 | value
            cuts = np.concatenate(([0], np.nonzero(np.diff(key))[0] + 1, [len(key)])).tolist()
            for start, stop in zip(cuts, cuts[1:], strict=False):
                if start == stop:
                    continue
                same = bool(held) and (block, last) == (int(of[start]), int(value[start]))
                if held and not same and (n > 50_000 or block != int(of[start])):
                    yield done()
                    held, n = [], 0
                block, last = int(of[start]), int(value[start])
                if same:
                    held[-1] = np.concatenate((held[-1], fp[start:stop]))
                else:
                    held.append(fp[start:stop])
                n += stop - start
        if held:
            yield done()

    per_fp = sum(sum(comb(BITS - bits, k) for k in range(radius // 2 + 1)) for _, bits in parts)
    tasks = max(24, -(-n_distinct * per_fp // TASK_VARIANTS))
    sent = fps.mapInArrow(send, "block int, value int, fp long").repartition(tasks, "block", "value").sortWithinPartitions("block", "value")
    return sent.mapInArrow(meet, "a long, b long")


def _roots(distinct: DataFrame, radius: int) -> DataFrame:
    """(fp, root) for each distinct fingerprint (fp): the same root for all of a component."""
    roots = components(near_links(distinct.select("fp"), distinct.count(), radius))
    return distinct.join(roots, distinct.fp == roots.node, "left").withColumn("root", F.coalesce("root", "fp")).drop("node")


def near_duplicates(docs: DataFrame, radius: int = 4, shingle: int = 4, seed: int = 42) -> DataFrame:
    """(doc_id, fingerprint, component_id) for each row of docs (doc_id, text).

    Texts without words, null ones included, have fingerprint 0 and link like any other. Repeated
    doc_ids give a row each. A null doc_id links too, but never names a component unless all its ids
    are null. An empty table gives no rows.
    """
    marked = stage(fingerprints(docs, shingle, seed), "fingerprints")
    distinct = stage(marked.groupBy("fp").agg(F.min("doc_id").alias("first_id")), "distinct")
    named = _roots(distinct, radius)
    least = named.groupBy("root").agg(F.min("first_id").alias("component_id"))
    by_fp = named.join(least, "root").select("fp", "component_id")
    hexed = F.lower(F.lpad(F.hex("fp"), 16, "0"))
    return marked.join(by_fp, "fp").select("doc_id", hexed.alias("fingerprint"), "component_id")


def keep_one(docs: DataFrame, radius: int = 4, shingle: int = 4, seed: int = 42) -> DataFrame:
    """One row of docs, with all its columns, of each near-duplicate group: the one with the smallest doc_id.

    A null doc_id comes after all others; of rows with the same doc_id in a group, that with the smallest
    hash of all its columns stays, and rows equal in all of them are one row. docs may have any other
    columns, whatever their names. The rows to keep are named by ids and hashes; whole rows are shuffled
    once, to meet these, and once more only if rows to keep are repeated.
    """
    columns = docs.columns
    of, same, whole, nth = unused(columns, "id", "same", "hash", "nth")
    row_hash = F.xxhash64(*[F.col(f"`{c}`") for c in columns])
    marked = stage(fingerprints(docs, shingle, seed, keep=row_hash), "fingerprints")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "kept"))
    distinct = stage(marked.groupBy("fp").agg(first.alias("first")), "distinct")
    named = _roots(distinct, radius).groupBy("root").agg(F.min("first").alias("first"))
    stays = stage(named.select(F.col("first.doc_id").alias(of), F.col("first.kept").alias(same)), "stays")
    found = docs.withColumn(whole, row_hash).join(stays, F.col("doc_id").cast("long").eqNullSafe(F.col(of)) & (F.col(whole) == F.col(same)), "left_semi")
    if marked.join(stays, F.col("doc_id").eqNullSafe(F.col(of)) & (F.col("kept") == F.col(same)), "left_semi").count() > stays.count():
        numbered = Window.partitionBy("doc_id", whole).orderBy(F.lit(0))  # of equal rows any is as good
        found = found.withColumn(nth, F.row_number().over(numbered)).where(F.col(nth) == 1)
    return found.select(*[F.col(f"`{c}`") for c in columns])


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))
