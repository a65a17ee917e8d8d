"""Benchmark decontamination by greedy string tiling.

Texts and benchmark items are compared as lower-case word tokens without punctuation. A document and
an item that share a seed, that is a run of `shortest` tokens, are tiled: the longest common runs that
do not overlap are marked again and again, found with Karp-Rabin hashes of falling length. The share
of the item's tokens under tiles decides, in whatever order its passages stand in the document.

Documents are read once. A filter of bounded size tells most seeds that no item has, so that only a
document's tokens in the others, and these seeds, go on; then the seeds of documents and items are
joined. An item that is covered to the share has a number of its seeds in the document, so it can do
without as many of its seeds less one: those that most documents have are left out of the join. No
pair that can reach the share is lost. Neither documents nor items go to the driver.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import BitFilter, slices, stage, table, unused, window_hashes, word_hashes

TOKEN = re.compile(r"[^\W_]+")
SEED_BASE = 0x9E3779B97F4A7C15
SHORTEST = 5
COVERAGE = 0.6
#: Bits of the filter of the items' seeds: 8 MB at most. With more seeds than bits, more of the documents' seeds pass.
FILTER_BITS = 26


def tokens(text: str | None) -> np.ndarray:
    """Hashes of the tokens of a text."""
    return word_hashes([w.encode() for w in TOKEN.findall((text or "").lower())])


def tiles(item: np.ndarray, doc: np.ndarray, shortest: int = SHORTEST) -> list[tuple[int, int, int]]:
    """Greedy tiling of two token sequences: (start in item, start in doc, length), longest first, never overlapping.

    Of equally long matches the one earliest in the item, then in the document, is marked first.
    """
    free_item, free_doc = np.ones(len(item), bool), np.ones(len(doc), bool)
    out: list[tuple[int, int, int]] = []
    length = max(shortest, min(len(item), len(doc)))
    while length >= shortest:
        found = longest_matches(item, doc, free_item, free_doc, length)
        if not found:
            # no match of this length: a run of half of it still may be, and no length between is passed over
            if length == shortest:
                break
            length = longest_common(item, doc, free_item, free_doc, shortest, length - 1)
            continue
        for i, j in found:
            if free_item[i : i + length].all() and free_doc[j : j + length].all():
                free_item[i : i + length] = False
                free_doc[j : j + length] = False
                out.append((i, j, length))
        length = longest_common(item, doc, free_item, free_doc, shortest, length)
    return out


def open_windows(seq: np.ndarray, free: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Starts and Karp-Rabin hashes of the windows without marked tokens."""
    h = window_hashes(seq, length, SEED_BASE)
    if not len(h):
        return np.empty(0, np.int64), h
    taken = np.concatenate(([0], np.cumsum(~free)))
    at = np.nonzero(taken[length:] == taken[:-length])[0]
    return at, h[at]


def longest_matches(item, doc, free_item, free_doc, length) -> list[tuple[int, int]]:
    """Pairs of unmarked windows of this length that are equal, checked token by token, in item order.

    A window that the document repeats is paired at each place until one is free, so it is given once
    for each place, by turns over the item's windows of that hash.
    """
    ai, hi = open_windows(item, free_item, length)
    aj, hj = open_windows(doc, free_doc, length)
    order = np.argsort(hj, kind="stable")
    low = np.searchsorted(hj[order], hi, "left")
    high = np.searchsorted(hj[order], hi, "right")
    out, used = [], np.zeros(len(doc), bool)
    busy = np.zeros(len(item), bool)
    for i, a, b in zip(ai.tolist(), low.tolist(), high.tolist(), strict=True):
        if a == b or busy[i : i + length].any():
            continue
        for k in range(a, b):
            j = int(aj[order[k]])
            if not used[j : j + length].any() and np.array_equal(item[i : i + length], doc[j : j + length]):
                out.append((i, j))
                used[j : j + length] = True
                busy[i : i + length] = True
                break
    return out


def longest_common(item, doc, free_item, free_doc, shortest: int, most: int) -> int:
    """The greatest length up to most at which unmarked windows are equal; 0 if that is under shortest.

    Equal windows of a length hold equal ones of every smaller length, so halving finds it.
    """
    low, high = shortest - 1, most
    while low < high:
        mid = (low + high + 1) // 2
        hits = np.isin(open_windows(item, free_item, mid)[1], open_windows(doc, free_doc, mid)[1]).any()
        low, high = (mid, high) if hits else (low, mid - 1)
    return low if low >= shortest else 0


def seed_hashes(t: np.ndarray, width: int) -> np.ndarray:
    return window_hashes(t, width, SEED_BASE)


def item_seeds(benchmark: DataFrame, shortest: int) -> DataFrame:
    """(item_id, tokens, width, seeds, weights) of items with tokens: the hashes of the tokens and of each seed, and in how many places the item has it.

    An item shorter than a seed is one seed by itself.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            rows = []
            for item_id, text in zip(batch.column("item_id").to_pylist(), batch.column("text").to_pylist(), strict=True):
                t = tokens(text)
                if len(t):
                    width = min(shortest, len(t))
                    seeds, n = np.unique(seed_hashes(t, width), return_counts=True)
                    rows.append((item_id, t.view(np.int64).tolist(), width, seeds.view(np.int64).tolist(), n.tolist()))
            cols = list(zip(*rows, strict=True)) or [()] * 5
            kinds = (pa.int64(), pa.list_(pa.int64()), pa.int32(), pa.list_(pa.int64()), pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], ["item_id", "tokens", "width", "seeds", "weights"])

    given = benchmark.where(F.col("item_id").isNotNull() & F.col("text").isNotNull()).select(F.col("item_id").cast("long").alias("item_id"), "text")
    return given.mapInArrow(run, "item_id long, tokens array<long>, width int, seeds array<long>, weights array<long>")


def doc_seeds(docs: DataFrame, key: Column, held: BitFilter, widths: list[int]) -> DataFrame:
    """(row, key, doc_id, part, seeds) of documents with seeds that pass the filter: the tokens in these, gaps closed by a mark that no item has.

    row is a number of its own for each row of the table, once that is written.
    """
    # as plain arrays, which workers read without this package
    sent = docs.sparkSession.sparkContext.broadcast((held.bits, held.words))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        own, row = BitFilter(*sent.value), TaskContext.get().partitionId() << 33
        for batch in slices(batches):
            rows = []
            for k, doc_id, text in zip(*(batch.column(c).to_pylist() for c in ("key", "doc_id", "text")), strict=True):
                t = tokens(text)
                step, found = np.zeros(len(t) + 1, np.int64), []
                for width in widths:
                    h = seed_hashes(t, width)
                    at = np.nonzero(own.may_have(h))[0]
                    if len(at):
                        found.append(np.unique(h[at]))
                        step[at] += 1
                        step[at + width] -= 1
                if found:
                    at = np.nonzero(np.cumsum(step[:-1]) > 0)[0]
                    part = np.insert(t[at], np.nonzero(np.diff(at) > 1)[0] + 1, np.uint64(0))
                    rows.append((row, k, doc_id, part.tobytes(), np.unique(np.concatenate(found)).view(np.int64).tolist()))
                    row += 1
            cols = list(zip(*rows, strict=True)) or [()] * 5
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([pa.array(c, x) for c, x in zip(cols, kinds, strict=True)], ["row", "key", "doc_id", "part", "seeds"])

    given = docs.select(key.alias("key"), F.col("doc_id").cast("long").alias("doc_id"), "text")
    return given.mapInArrow(run, "row long, key long, doc_id long, part binary, seeds array<long>")


def candidates(found: DataFrame, items: DataFrame, least: float) -> DataFrame:
    """Distinct (row, uid) of documents and items that share one of the item's seeds that the share can't do without."""
    each = items.select("uid", F.ceil(F.size("tokens") * least / F.col("width") - 1e-9).alias("need"), F.explode(F.arrays_zip("seeds", "weights")).alias("s")).select("uid", "need", F.col("s.seeds").alias("seed"), F.col("s.weights").alias("weight"))
    places = found.select("row", F.explode("seeds").alias("seed"))
    common = places.groupBy("seed").agg(F.count("*").alias("n"))
    ranked = each.join(common, "seed")  # a seed of no document joins nothing
    by_count = Window.partitionBy("uid").orderBy(F.desc("n"), "seed")
    left = ranked.withColumn("dropped", F.sum("weight").over(by_count)).where((F.col("dropped") >= F.col("need")) | (F.col("need") <= 0))
    return places.join(left.select("uid", "seed"), "seed").select("row", "uid").distinct()


def covered(docs: DataFrame, benchmark: DataFrame, least: float, shortest: int, key: Column) -> DataFrame:
    """(row, key, doc_id, item_id, item_tokens, covered_tokens, tiles) of documents and items that cover the item to the share."""
    items = stage(item_seeds(benchmark, shortest).withColumn("uid", F.monotonically_increasing_id()), "items")
    seeds = items.select(F.explode("seeds").alias("seed"))
    widths = sorted(r[0] for r in items.select("width").distinct().collect())
    held = BitFilter.of(seeds, "seed", seeds.count(), FILTER_BITS)
    found = stage(doc_seeds(docs, key, held, widths), "doc-seeds")
    pairs = candidates(found, items, least).join(found.select("row", "key", "doc_id", "part"), "row").join(items.select("uid", "item_id", "tokens"), "uid")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            rows = []
            for row, k, doc_id, part, item_id, item in zip(*(batch.column(c).to_pylist() for c in ("row", "key", "doc_id", "part", "item_id", "tokens")), strict=True):
                t = np.array(item, np.int64).view(np.uint64)
                marked = tiles(t, np.frombuffer(part, np.uint64), min(shortest, len(t)))
                n = sum(size for _, _, size in marked)
                if marked and n >= least * len(t):
                    rows.append((row, k, doc_id, item_id, len(t), n, len(marked)))
            cols = list(zip(*rows, strict=True)) or [()] * 7
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], ["row", "key", "doc_id", "item_id", "item_tokens", "covered_tokens", "tiles"])

    n = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return pairs.select("row", "key", "doc_id", "part", "item_id", "tokens").repartition(n, "row", "item_id").mapInArrow(run, "row long, key long, doc_id long, item_id long, item_tokens long, covered_tokens long, tiles long")


def contaminated(docs: DataFrame, benchmark: DataFrame, least: float = COVERAGE, shortest: int = SHORTEST) -> DataFrame:
    """(doc_id, item_id, item_tokens, covered_tokens, coverage, tiles) of documents that cover an item to the share `least`.

    docs has doc_id and text, benchmark item_id and text; other columns are not looked at. Null texts
    and texts without tokens match nothing; an item of fewer tokens than a seed counts if it stands in
    the document whole. Null doc_ids are given as they are, null item_ids left out; repeated rows of
    either table give a row each. Without documents or items there are no rows.
    """
    found = covered(docs, benchmark, least, shortest, F.lit(0).cast("long"))
    return found.select("doc_id", "item_id", "item_tokens", "covered_tokens", (F.col("covered_tokens") / F.col("item_tokens")).alias("coverage"), "tiles")


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, least: float = COVERAGE, shortest: int = SHORTEST) -> DataFrame:
    """The rows of docs, with all their columns, that contaminated() would not name; they are told by doc_id and a hash of the text."""
    of, ident, key = unused(docs.columns, "of", "ident", "key")
    text_hash = F.xxhash64("text")
    bad = stage(covered(docs, benchmark, least, shortest, text_hash).select(F.col("key").alias(of), F.col("doc_id").alias(ident)).distinct(), "contaminated")
    same = (F.col(key) == F.col(of)) & F.col("doc_id").cast("long").eqNullSafe(F.col(ident))
    return docs.withColumn(key, text_hash).join(bad, same, "left_anti").select(*[F.col(f"`{c}`") for c in docs.columns])


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
