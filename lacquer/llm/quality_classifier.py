"""Quality classification by Naive Bayes support vectors.

Indicators of character n-grams are scaled by the log ratio of their counts in the two classes, which
are taken over all labelled rows that may be learned from. A linear hinge-loss model over them is
fitted by dual coordinate descent on a bounded sample of those rows; the part of the sample set aside
turns its margins into probabilities.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import BitFilter, held_out, slices, stage, table, training_row
from .ngrams import PIECES, Presence, add_pieces, joined, pieces

ORDERS, BITS = (1, 2, 3, 4), 17
MARK = "\u21ba"
#: Bits of the filter of labelled ids: 8 MB at most, on the driver and in the tasks.
FILTER_BITS = 26


def with_repeats_marked(text: str | None) -> str:
    """The text with a mark for each word that equals the one before, so that n-grams can tell stuttering."""
    words = (text or "").split(" ")
    if any(map(str.__eq__, words, words[1:])):
        words = [words[0], *(MARK if w == v else w for v, w in zip(words, words[1:], strict=False))]
    return " ".join(words)


def log_ratios(positive: np.ndarray, negative: np.ndarray, smooth: float = 1.0) -> np.ndarray:
    p, q = positive + smooth, negative + smooth
    return np.log(p / p.sum()) - np.log(q / q.sum())


def dual_coordinate_descent(rows: list[np.ndarray], y: np.ndarray, r: np.ndarray, cost: np.ndarray, epochs: int = 25, seed: int = 7) -> tuple[np.ndarray, float]:
    """Weights and bias of the L2-regularised hinge-loss model over x = r at the row's buckets, scaled to length 1.

    Each step solves the dual exactly in one coordinate, within its box from 0 to the row's cost. The
    bias is a further feature of value 1.
    """
    w, bias = np.zeros(len(r)), 0.0
    values = [r[a] / max(np.sqrt(r[a] @ r[a]), 1e-12) for a in rows]
    alpha = np.zeros(len(rows))
    order = np.random.default_rng(seed)
    for _ in range(epochs):
        moved = 0.0
        for i in order.permutation(len(rows)).tolist():
            a, x = rows[i], values[i]
            slope = y[i] * (w[a] @ x + bias) - 1
            new = min(max(alpha[i] - slope / 2.0, 0.0), cost[i])  # x.x + 1 = 2
            if new != alpha[i]:
                step = (new - alpha[i]) * y[i]
                moved = max(moved, abs(step))
                alpha[i] = new
                w[a] += step * x
                bias += step
        if moved < 1e-3:
            break
    return w, bias


def platt(margins: np.ndarray, labels: np.ndarray, weight: np.ndarray) -> tuple[float, float]:
    """Slope and offset of the logistic curve through weighted margins, by Newton's method; the slope stays positive."""
    if not len(margins) or labels.min() == labels.max():
        return 2.0, 0.0
    # targets off 0 and 1 keep a clean split finite
    t = np.where(labels == 1, 1 - 1 / (labels.sum() + 2), 1 / ((1 - labels).sum() + 2))
    a, b = 1.0, 0.0
    x = np.stack((margins, np.ones_like(margins)), 1)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a * margins + b, -40, 40)))
        g = x.T @ (weight * (p - t)) + 1e-6 * np.array([a, b])
        h = (x * (weight * p * (1 - p))[:, None]).T @ x + 1e-4 * np.eye(2)
        step = np.clip(np.linalg.solve(h, g), -2, 2)
        a, b = max(a - step[0], 1e-3), b - step[1]
    return float(a), float(b)


class QualityModel:
    def __init__(self, weights: np.ndarray, ratios: np.ndarray, bias: float, slope: float, offset: float):
        self.weights, self.ratios, self.bias, self.slope, self.offset = weights, ratios, bias, slope, offset

    def margin(self, at: np.ndarray) -> float:
        r = self.ratios[at]
        return float(r @ self.weights[at]) / max(float(np.sqrt(r @ r)), 1e-12) + self.bias if len(at) else self.bias

    def score(self, at: np.ndarray) -> float:
        return float(1 / (1 + np.exp(-np.clip(self.slope * self.margin(at) + self.offset, -40, 40))))


def train(docs: DataFrame, labels: DataFrame, per_class: int = 2000) -> QualityModel:
    """Fit on rows of docs (doc_id, text) with a label (doc_id, quality), of ids that may be learned from.

    A document's label is 1 if at least half of its non-null labels are; a null label says nothing.
    Counts cover all labelled rows; the support vectors come from at most per_class rows of each class,
    those with the smallest hashes of their ids and texts, a quarter of which is set aside for the
    probabilities; repeated rows are one row of the sample.
    Without both classes every score is the share of label 1, or a half without labels.
    """
    known = labels.where(training_row(F.col("doc_id")) & F.col("quality").isNotNull()).groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg((F.avg("quality") >= 0.5).cast("int").alias("label"))
    known = stage(known, "quality-labels")
    sizes = dict(known.groupBy("label").count().collect())
    bound = {c: min(2**63 - 1, int(-(2**63) + 2**64 * min(1.0, 1.2 * per_class / n))) for c, n in sizes.items()}
    ids = docs.where(training_row(F.col("doc_id"))).select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    texts = labelled(ids, known, sum(sizes.values())).select(F.xxhash64("doc_id", "text").alias("h"), "text", "label")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Class counts of buckets in pieces, and the buckets of sampled rows."""
        seen, total, n, taken = Presence(ORDERS, BITS), np.zeros((2, 1 << BITS), np.int64), 0, set()
        schema = pa.schema([("piece", pa.int32()), ("counts", pa.binary()), ("h", pa.int64()), ("label", pa.int32())])
        for batch in slices(batches):
            picked: dict[str, list] = {"piece": [], "counts": [], "h": [], "label": []}
            for h, text, label in zip(*(batch.column(c).to_pylist() for c in ("h", "text", "label")), strict=True):
                at = seen(with_repeats_marked(text))
                total[label, at] += 1
                n += 1
                if h <= bound[label] and h not in taken:
                    taken.add(h)
                    for k, v in (("piece", -1), ("counts", at.astype("<i4").tobytes()), ("h", h), ("label", label)):
                        picked[k].append(v)
            if picked["h"]:
                yield pa.RecordBatch.from_pydict(picked, schema=schema)
        if n:
            yield pa.RecordBatch.from_pydict(pieces(total) | {"h": [None] * PIECES, "label": [None] * PIECES}, schema=schema)

    gathered = stage(texts.mapInArrow(run, "piece int, counts binary, h long, label int"), "quality-counts")
    sums = gathered.where("piece >= 0").select("piece", "counts").groupBy("piece").applyInArrow(add_pieces, "piece int, counts binary").collect()
    counts = joined(sums, 2, BITS)
    # rows that are repeated, in other tasks too, are one row of the sample; the cut is made before anything is collected
    by_hash = Window.partitionBy("label").orderBy("h")
    chosen = gathered.where("piece < 0").select("label", "h", "counts").dropDuplicates(["label", "h"]).withColumn("nth", F.row_number().over(by_hash)).where(F.col("nth") <= per_class)
    sample = sorted(chosen.select("label", "h", "counts").collect(), key=lambda r: (r[0], r[1]))
    r = log_ratios(counts[1].astype(float), counts[0].astype(float))
    taken, rows, y = {0: 0, 1: 0}, [], []
    for label, _, at in sample:
        if taken[label] < per_class:
            taken[label] += 1
            rows.append(np.frombuffer(at, "<i4").astype(np.int64))
            y.append(label)
    labels_ = np.array(y)
    if len(set(y)) < 2:
        p = float(labels_.mean()) if y else 0.5
        return QualityModel(np.zeros(1 << BITS), r, 0.0, 1.0, float(np.log((p + 1e-6) / (1 - p + 1e-6))))
    aside = np.zeros(len(y), bool)
    for c in (0, 1):
        aside[np.nonzero(labels_ == c)[0][3::4]] = True
    fit = np.nonzero(~aside)[0]
    w, bias = dual_coordinate_descent([rows[i] for i in fit], np.where(labels_[fit] == 1, 1.0, -1.0), r, np.full(len(fit), 1.0))
    model = QualityModel(w, r, bias, 1.0, 0.0)
    # the sample has both classes alike; weights bring back their shares in the corpus
    share = np.where(labels_[aside] == 1, sizes[1] / max(1, (labels_ == 1).sum()), sizes[0] / max(1, (labels_ == 0).sum()))
    margins = np.array([model.margin(rows[i]) for i in np.nonzero(aside)[0]])
    model.slope, model.offset = platt(margins, labels_[aside], share / share.mean())
    return model


def labelled(texts: DataFrame, known: DataFrame, n: int) -> DataFrame:
    """Rows of texts (doc_id, text) with their label from known (doc_id, label), n distinct ids.

    Labels grow with the texts, so both are joined by sorting. Most texts have no label: a filter of
    known size, FILTER_BITS bits at most, lets few of those pass, so that little more than the texts
    with labels is shuffled.
    """
    hashed = F.xxhash64("doc_id")
    # as plain arrays, which workers read without this package
    held = BitFilter.of(known.select(hashed.alias("h")), "h", n, FILTER_BITS)
    sent = texts.sparkSession.sparkContext.broadcast((held.bits, held.words))

    def pass_on(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = BitFilter(*sent.value)
        for batch in batches:
            yield batch.filter(pa.array(own.may_have(batch.column("h").to_numpy())))

    few = texts.withColumn("h", hashed).mapInArrow(pass_on, "doc_id long, text string, h long").drop("h")
    return few.join(known.hint("merge"), "doc_id")


def rate(docs: DataFrame, model: QualityModel) -> DataFrame:
    """(doc_id, held_out, score, predicted) for each row of docs (doc_id, text).

    The score is the chance of label 1, from the text alone; an empty or null text has no n-grams and
    gets the score of the bias. A null doc_id is not held out. Repeated rows give a row each; an empty
    table gives none.
    """
    product = (model.weights * model.ratios).astype(np.float32)
    square = (model.ratios**2).astype(np.float32)
    bias, slope, offset = model.bias, model.slope, model.offset

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = Presence(ORDERS, BITS)
        for batch in slices(batches):
            margins = []
            for text in batch.column("text").to_pylist():
                at = seen(with_repeats_marked(text))
                margins.append(float(product[at].sum(dtype=float)) / max(float(np.sqrt(square[at].sum(dtype=float))), 1e-12) + bias if len(at) else bias)
            p = 1 / (1 + np.exp(-np.clip(slope * np.array(margins, float) + offset, -40, 40)))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("held_out"), pa.array(p), pa.array((p >= 0.5).astype(np.int32))], ["doc_id", "held_out", "score", "predicted"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out(F.col("doc_id")).alias("held_out"), "text").mapInArrow(run, "doc_id long, held_out boolean, score double, predicted int")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return rate(docs, train(docs, table(spark, sf_dir, "labels")))
