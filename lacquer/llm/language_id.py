"""Language identification by sparse multinomial logistic regression on TF-IDF character n-grams.

Document frequencies are counted over all rows that may be learned from. The regression is fitted by
follow-the-regularised-leader with elastic-net penalties on a bounded sample of those rows, whose part
set aside then fits the temperature that calibrates the scores.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import held_out, slices, table, training_row
from .ngrams import add_pieces, counted, joined, pieces

ORDERS, BITS = (1, 2, 3), 15
NOT_LETTERS = re.compile(r"[\W\d_]+")
UNKNOWN = "und"
#: Languages that are learned, and rows that the weights are fitted on, at most.
MOST_LANGUAGES, MOST_ROWS = 1000, 50_000


def letters(text: str | None) -> str:
    """Lower-case letters with a space for each run of anything else; empty if there are no letters."""
    plain = NOT_LETTERS.sub(" ", (text or "").lower()).strip()
    return f" {plain} " if any(map(str.isalpha, plain)) else ""


def vector(text: str, idf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Buckets and values of the TF-IDF vector of a text, of length 1."""
    at, n = counted(text, ORDERS, BITS)
    x = (1 + np.log(n)) * idf[at]
    return at, x / max(np.sqrt(x @ x), 1e-12)


class Ftrl:
    """Multinomial logistic regression; each example moves its own coordinates (FTRL-proximal)."""

    def __init__(self, n_classes: int, n_features: int, alpha: float = 1.0, beta: float = 1.0, l1: float = 0.05, l2: float = 0.05):
        self.z, self.n = np.zeros((n_features, n_classes)), np.zeros((n_features, n_classes))
        self.alpha, self.beta, self.l1, self.l2 = alpha, beta, l1, l2

    def weights(self, at) -> np.ndarray:
        z, n = self.z[at], self.n[at]
        w = (np.sign(z) * self.l1 - z) / ((self.beta + np.sqrt(n)) / self.alpha + self.l2)
        return np.where(np.abs(z) <= self.l1, 0.0, w)

    def learn(self, at: np.ndarray, x: np.ndarray, label: int) -> None:
        w = self.weights(at)
        g = softmax(x @ w)
        g[label] -= 1
        g = x[:, None] * g[None, :]
        rise = (np.sqrt(self.n[at] + g * g) - np.sqrt(self.n[at])) / self.alpha
        self.z[at] += g - rise * w
        self.n[at] += g * g


def softmax(s: np.ndarray) -> np.ndarray:
    e = np.exp(s - s.max())
    return e / e.sum()


def temperature(scores: np.ndarray, labels: np.ndarray) -> float:
    """The temperature with the least negative log-likelihood, by golden-section search on its logarithm.

    The labels count as wrong once in len(labels) + 2 times, so that a set without errors keeps it off zero.
    """
    doubt = 1 / (len(labels) + 2)

    def loss(t: float) -> float:
        s = scores / np.exp(t)
        s = s - s.max(1, keepdims=True)
        right = (1 - doubt) * s[np.arange(len(s)), labels] + doubt * s.mean(1)
        return float((np.log(np.exp(s).sum(1)) - right).mean())

    low, high, g = -3.0, 3.0, (5**0.5 - 1) / 2
    for _ in range(50):
        a, b = high - g * (high - low), low + g * (high - low)
        low, high = (low, b) if loss(a) < loss(b) else (a, high)
    return float(np.exp((low + high) / 2))


class LanguageModel:
    def __init__(self, languages: list[str], idf: np.ndarray, weights: np.ndarray, heat: float):
        self.languages, self.idf, self.weights, self.heat = languages, idf, weights, heat

    def predict(self, text: str | None) -> tuple[str, float]:
        plain = letters(text)
        if not plain or not self.languages:
            return UNKNOWN, 0.0
        at, x = vector(plain, self.idf)
        p = softmax((x @ self.weights[at]) / self.heat)
        k = int(p.argmax())  # a tie goes to the first language by name
        return self.languages[k], float(p[k])


def train(docs: DataFrame, per_language: int = 500, epochs: int = 6) -> LanguageModel:
    """Fit on rows of docs (doc_id, text, lang) that have a language and whose id may be learned from.

    Document frequencies cover all of them. The weights come from at most per_language of them for each
    language, those with the smallest hashes of their ids and texts; every fifth of these is set aside for
    the temperature. MOST_LANGUAGES of them at most, those with the most rows, are learned,
    from MOST_ROWS rows in all. Of each sampled text a short stretch is learned from as well, so that the weights also
    suit short texts.
    """
    rows = docs.where(training_row(F.col("doc_id")) & F.col("lang").isNotNull()).select("doc_id", "text", "lang")

    def frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((1, 1 << BITS), np.int64)
        n = 0
        for batch in slices(batches):
            for text in batch.column("text").to_pylist():
                plain = letters(text)
                if plain:
                    total[0, counted(plain, ORDERS, BITS)[0]] += 1
                    n += 1
        if n:
            yield pa.RecordBatch.from_pydict(pieces(total), schema=pa.schema([("piece", pa.int32()), ("counts", pa.binary())]))

    df = joined(rows.select("text").mapInArrow(frequencies, "piece int, counts binary").groupBy("piece").applyInArrow(add_pieces, "piece int, counts binary").collect(), 1, BITS)[0]
    # a model has a column of weights for each language, so their number is bounded
    sizes = {r[0]: r[1] for r in rows.groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(MOST_LANGUAGES).collect()}
    languages = sorted(sizes)
    idf = np.log((1 + rows.count()) / (1 + df)) + 1
    if not languages:
        return LanguageModel([], idf, np.zeros((1 << BITS, 0)), 1.0)
    per_language = max(1, min(per_language, MOST_ROWS // len(languages)))

    # twice the share that gives per_language rows, so that the cut below has enough to take
    low = F.lit(None).cast("long")
    for name, n in sizes.items():
        share = min(1.0, 2 * per_language / n)
        low = F.when(F.col("lang") == name, F.lit(int(-(2**63) + (2**64 - 1) * share) if share < 1 else 2**63 - 1)).otherwise(low)

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            at, n = [], []
            hashes = batch.column("h").to_pylist()
            for text, h in zip(batch.column("text").to_pylist(), hashes, strict=True):
                plain = letters(text)
                start = (h % 1_000_003) % max(1, len(plain) - 80)
                for piece in (plain, plain[start : start + 80]):
                    a, c = counted(piece, ORDERS, BITS)
                    at.append(a.astype("<i4").tobytes())
                    n.append(np.minimum(c, 65535).astype("<u2").tobytes())
            lang = [x for x in batch.column("lang").to_pylist() for _ in (0, 1)]
            yield pa.RecordBatch.from_pydict({"h": pa.array([h for h in hashes for _ in (0, 1)], pa.int64()), "lang": pa.array(lang, pa.string()), "at": pa.array(at, pa.binary()), "n": pa.array(n, pa.binary())})

    # repeated rows are one row of the sample; the cut is made before texts are looked at, and nothing beyond it is collected
    by_hash = Window.partitionBy("lang").orderBy("h")
    low_rows = rows.withColumn("h", F.xxhash64("doc_id", "text")).where(F.col("h") <= low).select("h", "text", "lang").dropDuplicates(["lang", "h"])
    sampled = low_rows.withColumn("nth", F.row_number().over(by_hash)).where(F.col("nth") <= per_language).drop("nth")
    found = sorted(sampled.mapInArrow(features, "h long, lang string, at binary, n binary").collect(), key=lambda r: (r[1], r[0], -len(r[2]), bytes(r[2])))
    seen: dict[str, int] = {}
    examples: list[list] = [[], []]
    for h, lang, at, n in found:
        k = seen[lang] = seen.get(lang, 0) + 1
        if k <= 2 * per_language and at:
            a, c = np.frombuffer(at, "<i4"), np.frombuffer(n, "<u2").astype(float)
            x = (1 + np.log(c)) * idf[a]
            examples[(k - 1) // 2 % 5 == 4].append((h, a, x / max(np.sqrt(x @ x), 1e-12), languages.index(lang)))
    fit, aside = (sorted(e, key=lambda e: (e[0], e[3])) for e in examples)
    model = Ftrl(len(languages), 1 << BITS)
    for epoch in range(epochs):
        for k in np.random.default_rng(epoch).permutation(len(fit)).tolist():
            _, a, x, label = fit[k]
            model.learn(a, x, label)
    w = model.weights(slice(None))
    heat = temperature(np.array([x @ w[a] for _, a, x, _ in aside]), np.array([e[3] for e in aside])) if aside else 1.0
    return LanguageModel(languages, idf, w, heat)


def identify(docs: DataFrame, model: LanguageModel) -> DataFrame:
    """(doc_id, held_out, lang_pred, score) for each row of docs (doc_id, text).

    A null text or one without letters is `und` with score 0, and so is every text if there was nothing
    to learn from. A null doc_id is neither learned from nor held out. Repeated rows give a row each;
    an empty table gives none. Only the text is looked at for a prediction.
    """
    languages, heat = model.languages, model.heat
    idf, weights = model.idf.astype(np.float32), model.weights.astype(np.float32)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = LanguageModel(languages, idf.astype(float), weights, heat)
        for batch in slices(batches):
            found = [own.predict(t) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("held_out"), pa.array([f[0] for f in found], pa.string()), pa.array([f[1] for f in found], pa.float64())], ["doc_id", "held_out", "lang_pred", "score"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out(F.col("doc_id")).alias("held_out"), "text").mapInArrow(run, "doc_id long, held_out boolean, lang_pred string, score double")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return identify(docs, train(docs))
