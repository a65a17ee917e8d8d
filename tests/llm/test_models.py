"""Language and quality models: their arithmetic against plain solvers, held-out accuracy, and odd rows."""

import math
import random
from collections import Counter

import numpy as np
import pytest

from lacquer.llm import language_id as li
from lacquer.llm import ngrams
from lacquer.llm import quality_classifier as qc

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def documents(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


def test_languages_of_held_out_documents(documents):
    found = {r["doc_id"]: r for r in li.identify(documents, li.train(documents)).collect()}
    rows = [r for r in documents.collect() if r["lang"] is not None and found[r["doc_id"]]["held_out"] and found[r["doc_id"]]["lang_pred"] != "und"]
    right = [found[r["doc_id"]]["lang_pred"] == r["lang"] for r in rows]
    assert len(rows) > 250 and sum(right) >= 0.99 * len(rows)
    # a score of p is right in about p of the cases
    mean = sum(found[r["doc_id"]]["score"] for r in rows) / len(rows)
    assert abs(mean - sum(right) / len(rows)) < 0.05


def test_quality_of_held_out_documents(spark, documents):
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    known = {r["doc_id"]: r["quality"] for r in labels.collect() if r["quality"] is not None}
    found = {r["doc_id"]: r for r in qc.rate(documents, qc.train(documents, labels)).collect()}
    held = [i for i in known if i in found and found[i]["held_out"]]
    assert len(held) > 80 and sum(found[i]["predicted"] == known[i] for i in held) >= 0.95 * len(held)
    good, bad = ([found[i]["score"] for i in held if known[i] == v] for v in (1, 0))
    assert sum(g > b for g in good for b in bad) >= 0.97 * len(good) * len(bad)


def test_counts_of_grams_against_plain_counting():
    r = random.Random(1)
    text = "".join(r.choice("abé中😀 ") for _ in range(3000))
    grams = Counter()
    for n in (1, 2, 3):
        for k in range(len(text) - n + 1):
            grams[text[k : k + n]] += 1
    at, counts = ngrams.counted(text, (1, 2, 3), 20)
    by_bucket = Counter()
    for g, c in grams.items():
        (b,) = [b for b in ngrams.buckets(g, (len(g),), 20)]
        by_bucket[int(b[0])] += c
    assert dict(zip(at.tolist(), counts.tolist(), strict=True)) == by_bucket
    assert ngrams.Presence((1, 2, 3), 20)(text).tolist() == sorted(by_bucket)
    old, ngrams.BLOCK = ngrams.BLOCK, 100
    try:
        assert [x.tolist() for x in ngrams.counted(text, (1, 2, 3), 20)] == [at.tolist(), counts.tolist()]
    finally:
        ngrams.BLOCK = old


def test_document_frequencies(spark):
    rows = [(k, t, "aa") for k, t in enumerate(["ab ab", "ab", "b", None, "12", "ab"])] + [(5, "ab", "aa")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = li.train(docs)
    import zlib

    texts = [li.letters(t) for k, t, _ in rows if zlib.crc32(str(k).encode()) % 3 != 1]
    n = len(texts)
    (bucket,) = [int(b[0]) for b in ngrams.buckets("ab", (2,), li.BITS)]
    df = sum("ab" in t for t in texts)
    assert model.idf[bucket] == pytest.approx(math.log((1 + n) / (1 + df)) + 1)


def test_one_step_of_the_regression():
    """FTRL-proximal with elastic net, coordinate by coordinate."""
    r = np.random.default_rng(4)
    model = li.Ftrl(3, 6, alpha=0.7, beta=1.1, l1=0.02, l2=0.3)
    z, n = np.zeros((6, 3)), np.zeros((6, 3))
    for _ in range(25):
        at = np.sort(r.choice(6, 3, replace=False))
        x, label = r.random(3), int(r.integers(3))
        w = np.zeros((6, 3))
        for i in range(6):
            for c in range(3):
                if abs(z[i, c]) > 0.02:
                    w[i, c] = -(z[i, c] - math.copysign(0.02, z[i, c])) / ((1.1 + math.sqrt(n[i, c])) / 0.7 + 0.3)
        scores = [sum(x[k] * w[i, c] for k, i in enumerate(at)) for c in range(3)]
        e = [math.exp(s) for s in scores]
        for c in range(3):
            p = e[c] / sum(e) - (c == label)
            for k, i in enumerate(at):
                g = p * x[k]
                sigma = (math.sqrt(n[i, c] + g * g) - math.sqrt(n[i, c])) / 0.7
                z[i, c] += g - sigma * w[i, c]
                n[i, c] += g * g
        model.learn(at, x, label)
    assert np.allclose(model.z, z) and np.allclose(model.n, n)
    assert (model.weights(slice(None)) == 0).any() or np.abs(z).min() > 0.02


def test_temperature_is_the_best_of_a_grid():
    r = np.random.default_rng(5)
    labels = r.integers(0, 3, 200)
    scores = r.normal(size=(200, 3)) * 3
    scores[np.arange(200), labels] += 2
    doubt = 1 / 202

    def loss(t):
        s = scores / t
        log_p = s - np.log(np.exp(s).sum(1, keepdims=True))
        return -((1 - doubt) * log_p[np.arange(200), labels] + doubt * log_p.mean(1)).mean()

    best = min((loss(t), t) for t in np.exp(np.linspace(-3, 3, 3000)))[1]
    assert li.temperature(scores, labels) == pytest.approx(best, rel=0.01)


def test_log_ratios():
    positive, negative = np.array([3.0, 0.0, 1.0]), np.array([1.0, 4.0, 1.0])
    want = [math.log((p + 1) / 7) - math.log((q + 1) / 9) for p, q in zip(positive, negative, strict=True)]
    assert qc.log_ratios(positive, negative).tolist() == pytest.approx(want)


def test_dual_solution_against_a_plain_solver():
    """The optimum of the same box-constrained dual, by projected gradient over all coordinates."""
    r = np.random.default_rng(6)
    rows = [np.sort(r.choice(12, 5, replace=False)) for _ in range(30)]
    ratios, y = r.normal(size=12), np.where(r.random(30) < 0.5, 1.0, -1.0)
    cost = np.full(30, 0.8)
    w, bias = qc.dual_coordinate_descent(rows, y, ratios, cost, epochs=4000)
    x = np.zeros((30, 13))
    for k, a in enumerate(rows):
        x[k, a] = ratios[a] / np.linalg.norm(ratios[a])
        x[k, 12] = 1.0
    q = (y[:, None] * x) @ (y[:, None] * x).T
    alpha = np.zeros(30)
    for _ in range(200_000):
        alpha = np.clip(alpha - (q @ alpha - 1) / np.linalg.norm(q, 2), 0, cost)
    best = x.T @ (alpha * y)
    primal = lambda v: 0.5 * v @ v + (cost * np.maximum(0, 1 - y * (x @ v))).sum()
    assert primal(np.append(w, bias)) == pytest.approx(primal(best), rel=1e-3)


def test_probabilities_of_margins():
    r = np.random.default_rng(7)
    margins = r.normal(size=4000)
    labels = (r.random(4000) < 1 / (1 + np.exp(-(2.5 * margins - 0.7)))).astype(float)
    a, b = qc.platt(margins, labels, np.ones(4000))
    assert a == pytest.approx(2.5, rel=0.15) and b == pytest.approx(-0.7, abs=0.15)
    assert qc.platt(margins[:0], labels[:0], margins[:0]) == (2.0, 0.0)


def test_repeated_and_long_rows(spark):
    """One id repeated very often is one row of the sample; ties, long texts, nulls and unlabelled rows do no harm."""
    hot = [(0, "abcde bcdea cdeab " * 5, "aa", "x")] * 400
    rows = hot + [(k, "vwxyz wxyzv" if k % 2 else "abcde bcdea", "zz" if k % 2 else "aa", "x") for k in range(1, 80)] + [(100, "vwxyz wxyzv " * 60_000, "zz", "x"), (101, None, "aa", None), (102, "", None, "x"), (None, "abcde", "aa", "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, h string")
    model = li.train(docs, per_language=10)
    found = Counter((r["doc_id"], r["lang_pred"]) for r in li.identify(docs, model).collect())
    assert found[0, "aa"] == 400 and found[100, "zz"] == found[101, "und"] == found[102, "und"] == found[None, "aa"] == 1
    labels = spark.createDataFrame([(0, 1)] * 50 + [(k, 1 - k % 2) for k in range(1, 80)] + [(100, 0), (3, None), (999, 1), (None, 1)], "doc_id long, quality int")
    scored = {r["doc_id"]: r["predicted"] for r in qc.rate(docs, qc.train(docs, labels, per_class=10)).collect()}
    assert scored[0] == 1 and scored[100] == 0 and all(scored[k] == 1 - k % 2 for k in range(1, 80))


def test_the_filter_keeps_all_labelled_texts(spark, monkeypatch):
    docs = spark.createDataFrame([(k, f"t{k}") for k in range(500)], "doc_id long, text string")
    known = spark.createDataFrame([(k, k % 2) for k in range(0, 900, 7)], "doc_id long, label int")
    for bits in (26, 8):
        monkeypatch.setattr(qc, "FILTER_BITS", bits)
        assert sorted((r["doc_id"], r["label"]) for r in qc.labelled(docs, known, 129).collect()) == [(k, k % 2) for k in range(0, 500, 7)]
