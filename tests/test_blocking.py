import random

import numpy as np
import pyarrow as pa
import pytest

from lacquer.functions import similarity
from lacquer.operators import blocking, dedupe
from lacquer.operators.blocking import Search, candidate_pairs
from lacquer.operators.dedupe import BLOCKED


@pytest.mark.parametrize("scorer", list(BLOCKED))
@pytest.mark.parametrize("threshold", [0.3, 0.6, 0.8, 0.9])
def test_no_pair_at_the_threshold_is_lost(spark, scorer, threshold):
    """Against all pairs, on short strings of few characters, copies with edits and windows of longer ones."""
    r = random.Random(5)
    texts = {"".join(r.choice("abcde") for _ in range(r.randint(1, 9))) for _ in range(40)}
    texts |= {t[: r.randint(1, len(t))] for t in sorted(texts)} | {t + r.choice("xyz") * r.randint(1, 3) for t in sorted(texts)}
    values = sorted(texts)
    df = spark.createDataFrame([("f", t, k) for k, t in enumerate(values)], "field string, value string, vid long")
    found = {tuple(sorted((x["a"], x["b"]))) for x in candidate_pairs(df, {}, Search(threshold, **BLOCKED[scorer])).select("a", "b").collect()}
    want = {(i, j) for i in range(len(values)) for j in range(i + 1, len(values)) if scorer(values[i], values[j]) >= threshold}
    assert want <= found


def test_no_similar_long_string_is_lost(spark):
    """Longer strings, with edits anywhere, and one run that all have."""
    r = random.Random(8)
    texts = []
    for _ in range(40):
        one = "".join(r.choice("0123456789abcdef") for _ in range(r.randint(14, 30))) + "有限公司"
        texts.append(one)
        for _ in range(3):
            chars = list(one)
            for _ in range(r.randint(1, 6)):
                at = r.randrange(len(chars))
                chars[at : at + r.randint(0, 1)] = r.choice(["", "x", "5"])
            texts.append("".join(chars))
        texts.append(one[r.randint(0, 6) : r.randint(12, 40)] + r.choice(["", "乙", "丙丁"]))
    values = sorted(set(filter(None, texts)))
    df = spark.createDataFrame([("f", t, k) for k, t in enumerate(values)], "field string, value string, vid long")
    for scorer, options in BLOCKED.items():
        for threshold in (0.8, 0.85, 0.95):
            found = {tuple(sorted((x["a"], x["b"]))) for x in candidate_pairs(df, {"f": Search(threshold, **options)}, Search(1.0)).select("a", "b").collect()}
            want = {(i, j) for i in range(len(values)) for j in range(i + 1, len(values)) if scorer(values[i], values[j]) >= threshold}
            assert want <= found and (threshold < 0.95 or len(found) < len(values) ** 2 // 8)


def test_hot_runs_are_dealt_to_parts(spark, monkeypatch):
    monkeypatch.setattr(blocking, "PART_ROWS", 5)
    values = [f"王{chr(0x4E00 + k)}" for k in range(60)]
    df = spark.createDataFrame([("f", t, k) for k, t in enumerate(values)], "field string, value string, vid long")
    assert candidate_pairs(df, {}, Search(0.5, same_initial=True)).count() == 60 * 59 // 2


def drawn(r, letters, size, n):
    return sorted({"".join(r.choice(letters) for _ in range(size)) for _ in range(n)})


def test_firms_with_characters_in_common_are_few_candidates(spark):
    """Firms of eight drawn characters and eight that all have: bags of characters left a tenth of all pairs."""
    firms = [p + b + "贸易集团有限公司" for b in drawn(random.Random(3), "甲乙丙丁戊己庚辛壬癸子丑寅卯辰巳", 8, 300) for p in ("", "嘉兴")]
    df = spark.createDataFrame([("company", t, k) for k, t in enumerate(firms)], "field string, value string, vid long")
    search = Search(0.9, **BLOCKED[similarity.ratio_or_partial])
    found = [(x["a"], x["b"], x["va"], x["vb"]) for x in candidate_pairs(df, {}, search).collect()]
    assert {(k, k + 1) for k in range(0, len(firms), 2)} <= {(a, b) for a, b, _, _ in found}
    assert len(found) == len({f[:2] for f in found}) < len(firms) ** 2 // 200
    scores = similarity.ratios_or_partials([f[2] for f in found], [f[3] for f in found])
    pairs = [(a, b) for a in range(len(firms)) for b in range(a + 1, len(firms))]
    every = similarity.ratios_or_partials([firms[a] for a, _ in pairs], [firms[b] for _, b in pairs])
    assert {f[:2] for f, s in zip(found, scores, strict=True) if s >= 0.9} == {p for p, s in zip(pairs, every, strict=True) if s >= 0.9}


def shuffled(spark):
    return sum(spark._jsc.sc().statusStore().executorList(False).apply(k).totalShuffleWrite() for k in range(spark._jsc.sc().statusStore().executorList(False).size()))


def test_a_string_is_sent_to_a_task_once(spark):
    """Codes of 32 characters have 61 runs of three and two; they used to be sent once for each of them."""
    codes = [c[:31] + e for c in drawn(random.Random(4), "0123456789abcdef", 32, 1500) for e in "yz"]
    df = spark.createDataFrame([("code", t, k) for k, t in enumerate(codes)], "field string, value string, vid long")
    before = shuffled(spark)
    assert {(k, k + 1) for k in range(0, len(codes), 2)} <= {(x["a"], x["b"]) for x in candidate_pairs(df, {}, Search(0.85)).collect()}
    assert shuffled(spark) - before < 500 * len(codes)


def test_strings_are_shuffled_once_for_each_task_and_not_for_pairs(spark, monkeypatch):
    """One copy of a string in a task serves both sides, and pairs are scored where they meet; shorter ones were sent again and all strings joined to pairs twice."""
    monkeypatch.setattr(blocking, "PART_ROWS", 40_000)
    codes = [c[:31] + e for c in drawn(random.Random(6), "0123456789abcdef", 32, 2000) for e in "yz"]
    df = spark.createDataFrame([("code", t, k) for k, t in enumerate(codes)], "field string, value string, vid long")
    before = shuffled(spark)
    pairs = dedupe.scored_pairs(df, {}, dedupe.Rule()).collect()
    assert {(k, k + 1) for k in range(0, len(codes), 2)} <= {(x["a"], x["b"]) for x in pairs} and len(pairs) == len({x[:3] for x in pairs})
    assert {(x["a"], x["b"]): x["score"] for x in pairs}[0, 1] == similarity.ratio(codes[0], codes[1])
    assert shuffled(spark) - before < 170 * len(codes)


def test_strings_are_packed_with_their_runs():
    strings = pa.RecordBatch.from_pydict({"field": ["f", None, "f", "g"], "value": ["abé中😀", "x", "q", "yz"], "vid": [3, 10, 900, 2**40]})
    given = [np.array([0, 1, 300]), np.array([1, 2, 1]), np.array([0, 1, 2])]
    got, runs, back = blocking.unpacked(blocking.packed(strings, {None: 0, "f": 1, "g": 2}, np.array([2, 0, 1, 0]), given), [None, "f", "g"])
    assert got.to_pydict() == strings.to_pydict() and runs.tolist() == [2, 0, 1, 0] and [x.tolist() for x in back] == [x.tolist() for x in given]


def test_scores_of_many_pairs_are_those_of_each():
    r = random.Random(1)
    text = lambda: "".join(r.choice("abcé中😀") for _ in range(r.choice([0, 1, 2, 3, 5, 9, 20, 63, 64, 65])))
    left, right = [text() for _ in range(300)], [text() for _ in range(300)]
    right = [a[: r.randint(0, len(a))] + b[:2] if r.random() < 0.4 else b for a, b in zip(left, right, strict=True)]
    for scorer, batched in similarity.BATCHED.items():
        assert batched(left, right).tolist() == [scorer(a, b) for a, b in zip(left, right, strict=True)]
        assert batched([], []).tolist() == []
    assert similarity.ratio("", "") == similarity.partial_ratio("", "") == 1.0 and similarity.partial_ratio("", "a") == 0.0
