"""Quality rules: counts against plain Python over a whole table, the field against enumeration, and verdicts against labels."""

import itertools
import math
import random
import re

import numpy as np
import pytest

from lacquer.llm import quality_rules as q

SF = "/root/testdata/sf0.01"


def plain_counts(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = {}
    for i in range(len(words) - 7):
        windows.setdefault(tuple(words[i : i + 8]), []).append(i)
    covered = {j for at in windows.values() if len(at) > 1 for i in at for j in range(i, i + 8)}
    seen, dup = set(), 0
    for line in text.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in seen
            seen.add(line)
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), dup, len(covered)


@pytest.fixture(scope="module")
def documents(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


@pytest.fixture(scope="module")
def judged(documents):
    return {r["doc_id"]: r for r in q.judge(documents).collect()}


def test_counts_of_a_whole_table(documents, judged):
    rows = documents.select("doc_id", "text").collect()
    assert len(rows) == len(judged)
    for r in rows:
        got, want = judged[r["doc_id"]], plain_counts(r["text"] or "")
        assert (got["n_words"], got["word_chars"], got["n_symbols"], got["n_dup_lines"], got["n_repeat_words"]) == want
        assert got["base_failed"] == (want[0] < 20 or 100 * want[4] > 30 * want[0])
        assert not (got["kept"] and got["base_failed"])


def test_counts_of_random_texts():
    r = random.Random(4)
    for _ in range(3000):
        text = "".join(r.choice("ab  \n\n\t#|é　\x1c") for _ in range(r.randint(0, 120)))
        assert q.base_counts(text) == plain_counts(text)


def test_field_is_better_than_its_seeds(spark, documents, judged):
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{SF}/labels.parquet").collect() if r["quality"] is not None}
    texts = documents.where("text is not null").selectExpr("doc_id as h", "text")
    wanted = {line for one in q.sampled_lines(texts, 10**9, np.zeros(1 << q.WORD_BITS, bool)) for *_, line in one}
    df, n_docs, repeats = q.corpus_counts(documents, wanted)
    frequent = df >= max(2, q.FREQUENT * n_docs)
    runs = q.sampled_lines(texts, 10**9, frequent)
    usual = sum(f for one in runs for _, _, f, _ in one) / sum(n for one in runs for _, n, _, _ in one)
    right = {"seeds": 0, "field": 0}
    differ = 0
    for r in texts.collect():
        label, found = labels.get(r["h"]), judged[r["h"]]
        if label is None or found["base_failed"]:
            continue
        content = 0
        for line, words in q.word_lines(r["text"]):
            f = int(frequent[q.buckets([w for w in words if re.search(r"[^\W\d_]", w.decode())])].sum())
            content += len(words) * (q.seed_label(len(words), f, usual, *repeats.get(q.hash_of(line), (0, 0))) != 0)
        by_seeds = content >= 0.5 * found["n_words"]
        right["seeds"] += by_seeds == bool(label)
        right["field"] += found["kept"] == bool(label)
        differ += by_seeds != found["kept"]
    assert differ and right["field"] > right["seeds"] and right["field"] >= 0.99 * sum(1 for i, v in labels.items() if v is not None and not judged[i]["base_failed"])


def path_score(masks, labels, states, moves):
    score = sum(states[k][lab] for m, lab in zip(masks, labels, strict=True) for k in range(len(q.FEATURES)) if m >> k & 1)
    return score + sum(moves[a][b] for a, b in zip(labels, labels[1:], strict=False))


def test_field_against_enumeration():
    r = random.Random(2)
    for _ in range(40):
        field = q.LineField.__new__(q.LineField)
        field.states, field.moves = np.random.default_rng(r.randint(0, 99)).normal(size=(len(q.FEATURES), 2)), np.random.default_rng(r.randint(0, 99)).normal(size=(2, 2))
        masks = [r.randrange(1 << len(q.FEATURES)) for _ in range(r.randint(1, 7))]
        allowed = [r.choice([(0,), (1,), (0, 1)]) for _ in masks]
        paths = list(itertools.product((0, 1), repeat=len(masks)))
        best = max(paths, key=lambda p: path_score(masks, p, field.states, field.moves))
        assert q.viterbi(masks, field.scorer(), field.moves.tolist()) == list(best)
        inside = [p for p in paths if all(a in ok for a, ok in zip(p, allowed, strict=True))]
        weights = [math.exp(path_score(masks, p, field.states, field.moves)) for p in inside]
        want = [sum(w for p, w in zip(inside, weights, strict=True) if p[k]) / sum(weights) for k in range(len(masks))]
        # padded beside a longer sequence
        x = np.zeros((2, 9, len(q.FEATURES)))
        ok, there = np.ones((2, 9, 2)), np.zeros((2, 9), bool)
        x[0, : len(masks)] = [[m >> k & 1 for k in range(len(q.FEATURES))] for m in masks]
        ok[0, : len(masks)] = [[0 in a, 1 in a] for a in allowed]
        there[0, : len(masks)], there[1] = True, True
        p, moves = q.expected(x @ field.states, ok, there, field.moves)
        assert p[0, : len(masks), 1] == pytest.approx(want) and p[0, len(masks) :].sum() == 0
        assert moves.sum() == pytest.approx(len(masks) - 1 + 8)


def test_chosen_runs():
    assert q.chosen_runs(0, 400, 1) == [] and q.chosen_runs(90, 400, 1) == [(0, 40), (40, 80), (80, 90)]
    runs = q.chosen_runs(100_000, 400, 7)
    assert len(runs) == 10 and runs == q.chosen_runs(100_000, 400, 7) and runs[-1][1] > 20_000


def test_small_and_odd_corpora(spark):
    prose = "The council met on Monday to discuss the new bridge, and the plan was passed by a margin of two after a long debate."
    one = spark.createDataFrame([(1, prose + "\nWork should begin in spring, when the river is low.")], "doc_id long, text string")
    assert q.judge(one).first()["kept"] and q.keep_good(one).count() == 1
    rows = [(i, f"{prose} Number {i}.", "x") for i in range(5)] + [(1, f"{prose} Number 1.", "x")] * 30 + [(9, None, None), (None, "", ""), (10, prose + "\nplain line number\n", "x"), (11, "\n".join(f"{prose} {k}" for k in range(5000)), "x")]
    found = q.judge(spark.createDataFrame(rows, "doc_id long, text string, kept string")).collect()
    assert len(found) == len(rows) and {r["kept"] for r in found if r["doc_id"] == 1} == {True} and not any(r["kept"] for r in found if r["doc_id"] in (9, None))
    nothing = q.LineField([])
    assert nothing.states.shape == (len(q.FEATURES), 2)
