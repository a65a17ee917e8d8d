"""Repeated passages by fixed-block anchors.

A window of W words that repeats an earlier document's window covers one of the earlier document's
non-overlapping blocks of B words whole, when W >= 2 * B - 1. So the blocks of all documents are the
index, and every rolling B-word window probes it. Hits are extended to every W-word window around
them, which are then compared by full hashes of 96 bits, 64 from one hash of the words and 32 from
another; the union of the repeated windows is the maximal repeat.

Documents are dealt to packs by a hash of doc_id. A pack sends each of its distinct window hashes once
to a slot (by hash), four bytes each in reading order with the slot's bits apart, with the smallest and
largest doc_id that has it there; each slot answers a pack with one bit for each hash it was sent.
Nothing but documents, hashes and bits is shuffled, and a passage that a large share of all documents
holds takes as many rows of a slot as there are packs, not documents.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import groups_for, slices, table, texts_of, total_bytes, window_hashes

#: Bytes of text in a pack, and of text whose hashes meet in a slot; both in the mean. A pack sends a row
#: to each slot, so rows hold fewer hashes the larger the corpus is: some 500 at 30 GB, 15 at 1 TB and
#: never less than one. Beyond 1 TB both should be raised with the memory of the workers.
PACK_BYTES = 6_000_000
SLOT_BYTES = 12_000_000
#: Odd multipliers of the polynomial hashes of anchors and of windows.
ANCHOR_BASE, WINDOW_BASE, SECOND_BASE = 0x9E3779B97F4A7C15, 0xD1B54A32D192ED03, 0x8CB92BA72F3D8DD7

SENT = "slot int, pack int, n long, docs binary, back binary, hashes binary, more binary"
ANSWER = "pack int, slot int, hit binary, hit2 binary"


class Pack:
    """The documents of one pack in a fixed order, with the positions of all their words."""

    def __init__(self, group: pa.Table):
        ids, texts = group.column("doc_id").to_pylist(), group.column("text").to_pylist()
        order = sorted(range(len(ids)), key=lambda i: (ids[i], texts[i] or ""))
        self.ids = [ids[i] for i in order]
        self.texts = [(texts[i] or "").encode() for i in order]
        counts = np.empty(len(order), np.int64)
        parts = []
        for k, t in enumerate(self.texts):
            h = two_hashes(t.split())
            counts[k] = len(h)
            parts.append(h)
        both = np.concatenate(parts) if parts else np.empty((0, 2), np.uint64)
        self.hashes, self.second = np.ascontiguousarray(both[:, 0]), np.ascontiguousarray(both[:, 1])
        self.counts = counts
        self.starts = np.concatenate(([0], np.cumsum(counts)))
        self.id_of = np.array(self.ids, np.int64)

    def windows(self, width: int, base: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Start position, hash and document of each window that lies in one document."""
        n = len(self.hashes) - width + 1
        doc = np.repeat(np.arange(len(self.ids)), self.counts)
        if n <= 0:
            return np.empty(0, np.int64), np.empty(0, np.uint64), np.empty(0, np.int64)
        at = np.nonzero(doc[:n] == doc[width - 1 :])[0]
        return at, window_hashes(self.hashes, width, base)[at], doc[at]


    def second_hashes(self, at: np.ndarray, width: int) -> np.ndarray:
        """32 more bits of the windows at these places, from other hashes of the words."""
        return (window_hashes(self.second, width, SECOND_BASE)[at] >> np.uint64(32)).astype(np.uint32)


def two_hashes(words: list[bytes]) -> np.ndarray:
    """Two independent hashes of each word."""
    return np.frombuffer(b"".join(map(xxhash.xxh3_128_digest, words)), "<u8").reshape(-1, 2)


def deal(h: np.ndarray, slots: int) -> np.ndarray:
    """The slot of a hash, from its high half; what a slot is sent comes from the low half."""
    return ((h >> np.uint64(32)) % np.uint64(slots)).astype(np.int64)


def _sorted_by_slot(slot: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    # a stable sort of 16-bit numbers is by radix
    order = np.argsort(slot.astype(np.uint16) if slot.max(initial=0) < 1 << 16 else slot, kind="stable")
    in_order = slot[order]
    first = np.nonzero(np.diff(in_order, prepend=-1))[0]
    return order, in_order[first], np.append(first, len(order))


def _planes(values: np.ndarray, dtype: str) -> bytes:
    """Byte planes: the high bytes of small numbers lie together, which compresses well."""
    v = values.astype(dtype)
    return v.view(np.uint8).reshape(-1, v.itemsize).T.tobytes()


def _unplanes(data: bytes, n: int, dtype: str) -> np.ndarray:
    size = np.dtype(dtype).itemsize
    return np.frombuffer(data, np.uint8).reshape(size, n).T.copy().view(dtype).ravel()


def grouped(h: np.ndarray, more: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
    """A stable order in which equal hashes lie together, and where in it a new one starts."""
    order = np.argsort(h, kind="stable")
    new = np.ones(len(h), bool)
    new[1:] = h[order][1:] != h[order][:-1]
    if more is not None and (~new[1:] & (more[order][1:] != more[order][:-1])).any():
        order = np.lexsort((more, h))
        new[1:] = (h[order][1:] != h[order][:-1]) | (more[order][1:] != more[order][:-1])
    return order, new


def distinct(h: np.ndarray, more: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """The first place of each distinct hash, in reading order, and for each hash its number among these."""
    order, new = grouped(h, more)
    starts = np.nonzero(new)[0]
    firsts = np.minimum.reduceat(order, starts) if len(h) else order
    is_first = np.zeros(len(h), bool)
    is_first[firsts] = True
    of = np.empty(len(h), np.int64)
    of[order] = (np.cumsum(is_first) - 1)[firsts][np.cumsum(new) - 1]
    return np.nonzero(is_first)[0], of


def send(pack: int, h: np.ndarray, ids: np.ndarray, back: np.ndarray | None, slots: int, more: np.ndarray | None = None) -> pa.Table:
    """Distinct hashes of a pack by slot, in the order given, with a doc_id each.

    With back, the ids are the largest of their hashes; where back is not negative, the hash is of an
    indexed block, which is marked in place of its lowest bit, and back is how much less the smallest
    doc_id of such a block is.
    """
    order, names, first = _sorted_by_slot(deal(h, slots))
    rows: dict[str, list] = {"slot": [], "pack": [], "n": [], "docs": [], "back": [], "hashes": [], "more": []}
    for k, slot in enumerate(names.tolist()):
        i = order[first[k] : first[k + 1]]
        if back is None:
            own, less = _planes(h[i], "<u8"), b""
        else:
            own = (h[i].astype(np.uint32) & np.uint32(0xFFFFFFFE) | (back[i] >= 0).astype(np.uint32)).astype("<u4").tobytes()
            less = _planes(np.maximum(back[i], 0), "<i8")
        rows["slot"].append(slot)
        rows["pack"].append(pack)
        rows["n"].append(len(i))
        rows["docs"].append(_planes(np.diff(ids[i], prepend=np.int64(0)), "<i8"))
        rows["back"].append(less)
        rows["hashes"].append(own)
        rows["more"].append(b"" if more is None else _planes(more[i], "<u4"))
    return pa.table(rows, schema=pa.schema([("slot", pa.int32()), ("pack", pa.int32()), ("n", pa.int64()), ("docs", pa.binary()), ("back", pa.binary()), ("hashes", pa.binary()), ("more", pa.binary())]))


def answer(group: pa.Table, anchors: bool) -> pa.Table:
    """For each pack's hashes: hit if an id sent is over the smallest of an indexed block anywhere, hit2 if an indexed block's is under the largest."""
    slot = group.column("slot")[0].as_py()
    sizes = group.column("n").to_pylist()
    ids = np.concatenate([np.cumsum(_unplanes(d, n, "<i8")) for d, n in zip(group.column("docs").to_pylist(), sizes, strict=True)])
    raw = group.column("hashes").to_pylist()
    if anchors:
        h = np.concatenate([np.frombuffer(x, "<u4") for x in raw])
        ref = (h & 1).astype(bool)
        h, more = h & np.uint32(0xFFFFFFFE), None
        low = ids - np.concatenate([_unplanes(d, n, "<i8") for d, n in zip(group.column("back").to_pylist(), sizes, strict=True)])
    else:
        h = np.concatenate([_unplanes(x, n, "<u8") for x, n in zip(raw, sizes, strict=True)])
        more = np.concatenate([_unplanes(x, n, "<u4") for x, n in zip(group.column("more").to_pylist(), sizes, strict=True)])
        ref, low = np.ones(len(h), bool), ids
    order, new = grouped(h, more)
    group_of = np.cumsum(new) - 1
    first = np.nonzero(new)[0]
    least = np.minimum.reduceat(np.where(ref, low, np.iinfo(np.int64).max)[order], first)
    most = np.maximum.reduceat(ids[order], first)
    hit, hit2 = np.empty(len(h), bool), np.empty(len(h), bool)
    hit[order] = ids[order] > least[group_of]
    hit2[order] = ref[order] & (low[order] < most[group_of])
    packs, rows = group.column("pack").to_pylist(), {"pack": [], "slot": [], "hit": [], "hit2": []}
    start = 0
    for pack, n in zip(packs, sizes, strict=True):
        mine, mine2 = hit[start : start + n], hit2[start : start + n]
        start += n
        if mine.any() or mine2.any():
            rows["pack"].append(pack)
            rows["slot"].append(slot)
            rows["hit"].append(np.packbits(mine).tobytes())
            rows["hit2"].append(np.packbits(mine2).tobytes() if anchors else b"")
    return pa.table(rows, schema=pa.schema([("pack", pa.int32()), ("slot", pa.int32()), ("hit", pa.binary()), ("hit2", pa.binary())]))


def marked(answers: pa.Table, h: np.ndarray, slots: int, *columns: str) -> np.ndarray:
    """Whether any of the columns of the slots' answers is set, put back in the order of the hashes that were sent."""
    out = np.zeros(len(h), bool)
    order, names, first = _sorted_by_slot(deal(h, slots))
    where = {s: k for k, s in enumerate(names.tolist())}
    for slot, *bits in zip(*(answers.column(c).to_pylist() for c in ("slot", *columns)), strict=True):
        i = order[first[where[slot]] : first[where[slot] + 1]]
        for b in bits:
            out[i] |= np.unpackbits(np.frombuffer(b, np.uint8), count=len(i)).astype(bool)
    return out


def spread(marks: np.ndarray, back: int, ahead: int) -> np.ndarray:
    """True from `back` places before each mark to `ahead` places after it."""
    step = np.zeros(len(marks) + 1, np.int64)
    at = np.nonzero(marks)[0]
    np.add.at(step, np.maximum(at - back, 0), 1)
    np.add.at(step, np.minimum(at + ahead + 1, len(marks)), -1)
    return np.cumsum(step[:-1]) > 0


def remove_repeats(docs: DataFrame, window: int = 13, with_text: bool = False, pack_bytes: int = PACK_BYTES, slot_bytes: int = SLOT_BYTES) -> DataFrame:
    """(doc_id, n_words, n_removed, kept_sha256[, kept_text]) for each row of docs (doc_id, text).

    A word goes if a window of `window` words over it also starts in a document with a smaller doc_id.
    A null text has no words; a row with a null doc_id neither loses words nor takes any; rows with the
    same doc_id take none from each other. Texts under `window` words lose none. An empty table gives
    no rows.
    """
    block = (window + 1) // 2
    n_bytes = total_bytes(docs, "text")
    packs, slots = groups_for(n_bytes, pack_bytes), groups_for(n_bytes, slot_bytes)
    given = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    dealt = given.where("doc_id IS NOT NULL").withColumn("pack", F.pmod(F.xxhash64("doc_id"), F.lit(packs)).cast("int")).repartition(groups_for(n_bytes, 4 * pack_bytes), "pack")

    def candidates(pack: Pack, answers: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """The windows around hits, on either side, as start, hashes and document."""
        at, h, _ = pack.windows(block, ANCHOR_BASE)
        first, of = distinct(h)
        hit = marked(answers, h[first], slots, "hit", "hit2")
        around = np.zeros(len(pack.hashes), bool)
        around[at[hit[of]]] = True
        around = spread(around, window - block, 0)
        at, h, doc = pack.windows(window, WINDOW_BASE)
        keep = around[at]
        return at[keep], h[keep], pack.second_hashes(at[keep], window), doc[keep]

    def index(key: tuple, group: pa.Table) -> pa.Table:
        pack = Pack(group)
        at, h, doc = pack.windows(block, ANCHOR_BASE)
        first, of = distinct(h)
        # ids rise in reading order, so the last to be put is the largest and, backwards, the smallest
        ids, blocks = pack.id_of[doc], np.nonzero((at - pack.starts[doc]) % block == 0)[0][::-1]
        most, back = np.empty(len(first), np.int64), np.full(len(first), -1, np.int64)
        most[of] = ids
        back[of[blocks]] = most[of[blocks]] - ids[blocks]
        return send(key[0].as_py(), h[first], most, back, slots)

    def extend(key: tuple, group: pa.Table, answers: pa.Table) -> pa.Table:
        if not answers.num_rows or not group.num_rows:
            return send(0, np.empty(0, np.uint64), np.empty(0, np.int64), None, slots, np.empty(0, np.uint32))
        pack = Pack(group)
        _, h, more, doc = candidates(pack, answers)
        first, _ = distinct(h, more)
        return send(key[0].as_py(), h[first], pack.id_of[doc][first], None, slots, more[first])

    def cut(_: tuple, group: pa.Table, probed: pa.Table, compared: pa.Table) -> pa.Table:
        pack = Pack(group)
        gone = np.zeros(len(pack.hashes), bool)
        if probed.num_rows:
            at, h, more, doc = candidates(pack, probed)
            first, of = distinct(h, more)
            ids = pack.id_of[doc]
            smaller_elsewhere = marked(compared, h[first], slots, "hit")
            gone[at[smaller_elsewhere[of] | (ids > ids[first][of])]] = True
            gone = spread(gone, 0, window - 1)
        n_removed, kept = [], []
        for k, t in enumerate(pack.texts):
            mine = gone[pack.starts[k] : pack.starts[k + 1]]
            words = t.split()
            n_removed.append(int(mine.sum()))
            kept.append(b" ".join(words if not n_removed[-1] else [w for w, g in zip(words, mine.tolist(), strict=True) if not g]))
        return result(pa.array(pack.ids, pa.int64()), pack.counts.tolist(), n_removed, kept)

    def result(ids: pa.Array, counts: list[int], n_removed: list[int], kept: list[bytes]) -> pa.Table:
        out = {"doc_id": ids, "n_words": pa.array(counts, pa.int64()), "n_removed": pa.array(n_removed, pa.int64()), "kept_sha256": pa.array([hashlib.sha256(x).hexdigest() for x in kept], pa.string())}
        if with_text:
            out["kept_text"] = pa.array([x.decode() for x in kept], pa.string())
        return pa.table(out)

    def without_id(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows with a null doc_id lose nothing, and need no shuffle."""
        for batch in slices(batches):
            words = [t.split() for t in texts_of(batch)]
            yield from result(batch.column("doc_id"), list(map(len, words)), [0] * len(words), list(map(b" ".join, words))).to_batches()

    def both(key: tuple, group: pa.Table, answers: pa.Table) -> pa.Table:
        """cut() with the answers of both rounds in one table: the first round's have round 1."""
        of = np.array(answers.column("round").to_pylist(), np.int64)
        return cut(key, group, answers.filter(pa.array(of == 1)), answers.filter(pa.array(of == 2)))

    meet_anchors, meet_windows = (lambda g: answer(g, True)), (lambda g: answer(g, False))
    first = dealt.groupBy("pack").applyInArrow(index, SENT).groupBy("slot").applyInArrow(meet_anchors, ANSWER)
    second = dealt.groupBy("pack").cogroup(first.groupBy("pack")).applyInArrow(extend, SENT).groupBy("slot").applyInArrow(meet_windows, ANSWER)
    answers = first.withColumn("round", F.lit(1)).unionByName(second.withColumn("round", F.lit(2)))
    out = "doc_id long, n_words long, n_removed long, kept_sha256 string" + ", kept_text string" * with_text
    cleaned = dealt.groupBy("pack").cogroup(answers.groupBy("pack")).applyInArrow(both, out)
    return cleaned.unionByName(given.where("doc_id IS NULL").mapInArrow(without_id, out))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(table(spark, sf_dir, "documents"))


ORACLE = r"""
WITH words AS (
  SELECT doc_id, coalesce(regexp_extract_all(text, '[^\x20\x09-\x0D]+'), []) AS w FROM documents
), windows AS (
  SELECT doc_id, unnest(range(1, len(w) - 11)) AS nth, unnest(list_transform(range(1, len(w) - 11), lambda i: list_slice(w, i, i + 12))) AS words
  FROM words WHERE len(w) >= 13
), least AS (SELECT words, min(doc_id) AS first_id FROM windows GROUP BY words
), hit AS (
  SELECT doc_id, list(nth) AS starts FROM windows JOIN least USING (words) WHERE doc_id > first_id GROUP BY doc_id
), gone AS (
  SELECT doc_id, list_distinct(flatten(list_transform(starts, lambda s: range(s, s + 13)))) AS g FROM hit
), cut AS (
  SELECT d.doc_id, w, coalesce(g, []) AS g FROM words d LEFT JOIN gone USING (doc_id)
)
SELECT doc_id, len(w)::BIGINT AS n_words, len(g)::BIGINT AS n_removed,
       sha256(coalesce(array_to_string(CASE WHEN len(g) = 0 THEN w ELSE list_transform(list_filter(range(1, len(w) + 1), lambda i: NOT list_contains(g, i)), lambda i: w[i]) END, ' '), '')) AS kept_sha256
FROM cut
"""
