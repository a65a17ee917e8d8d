"""Decontamination against tiling of every document with every item, token by token."""

import random
import re
from collections import Counter

import numpy as np
import pytest

from lacquer.llm import decontamination as d
from lacquer.llm.common import BitFilter, word_hashes

SF = "/root/testdata/sf0.001"


def plain_tokens(text):
    return re.findall(r"[^\W_]+", (text or "").lower())


def naive_tiles(a, b, shortest):
    """Tokens of a under greedy tiles, and how many tiles."""
    free_a, free_b, covered, tiles = [True] * len(a), [True] * len(b), 0, 0
    while True:
        best, found = 0, []
        for i in range(len(a)):
            for j in range(len(b)):
                n = 0
                while i + n < len(a) and j + n < len(b) and a[i + n] == b[j + n] and free_a[i + n] and free_b[j + n]:
                    n += 1
                if n > best:
                    best, found = n, []
                if n == best and n:
                    found.append((i, j))
        if best < shortest:
            return covered, tiles
        for i, j in found:
            if all(free_a[i : i + best]) and all(free_b[j : j + best]):
                free_a[i : i + best], free_b[j : j + best] = [False] * best, [False] * best
                covered, tiles = covered + best, tiles + 1


def brute(docs, items, least=0.6, shortest=5):
    out = Counter()
    for doc_id, text in docs:
        t = plain_tokens(text)
        for item_id, item in items:
            i = plain_tokens(item)
            if item_id is None or not i or not t:
                continue
            covered, _ = naive_tiles(i, t, min(shortest, len(i)))
            if covered and covered >= least * len(i):
                out[doc_id, item_id, len(i), covered] += 1
    return out


def found(docs, items, **options):
    return Counter((r["doc_id"], r["item_id"], r["item_tokens"], r["covered_tokens"]) for r in d.contaminated(docs, items, **options).collect())


def small_tables():
    r = random.Random(12)
    words = [f"w{k}" for k in range(60)]
    text = lambda n: [r.choice(words) for _ in range(n)]
    items = [(k, text(r.randint(8, 30))) for k in range(12)]
    hot = text(6)  # a run that all items and most documents have
    items = [(k, hot + w) for k, w in items] + [(50, hot), (51, ["w1", "w2"]), (52, hot + hot + hot), (53, text(5))]
    docs = []
    for n in range(60):
        w = text(r.randint(0, 40)) + (hot if n % 4 else [])
        if n % 3 == 0:  # an item cut in two whose halves change places
            i = r.choice(items)[1]
            cut = r.randint(0, len(i))
            w = w[:5] + i[cut:] + w[5:] + i[:cut]
        docs.append((n, " ".join(w).replace("w1 ", "W1, ")))
    docs += [(3, docs[3][1]), (None, docs[0][1]), (70, None), (71, ""), (72, "-- !!")]
    items = [(k, " ".join(w)) for k, w in items] + [(0, " ".join(items[0][1])), (None, "w1 w2 w3 w4 w5"), (60, None), (61, "..."), (62, "")]
    return docs, items


@pytest.mark.parametrize("least", [0.3, 0.6, 1.0])
def test_small_tables_against_brute_force(spark, least):
    docs, items = small_tables()
    frames = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    want = brute(docs, items, least)
    assert want and found(*frames, least=least) == want
    bad = {k[0] for k in want}
    texts = {t for i, t in docs if i in bad}
    kept = Counter(map(tuple, d.drop_contaminated(*frames, least=least).collect()))
    assert kept == Counter((i, t) for i, t in docs if not (i in bad and t in texts))


def test_a_filter_that_passes_all_loses_nothing(spark, monkeypatch):
    docs, items = small_tables()
    monkeypatch.setattr(d, "FILTER_BITS", 7)
    assert found(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")) == brute(docs, items)


def test_whole_table(spark):
    """All documents that share 5 tokens in a row with an item, tiled by plain loops."""
    docs, items = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "benchmark"))
    grams = lambda t, n=5: {tuple(t[k : k + n]) for k in range(len(t) - n + 1)}
    item_rows = [(r["item_id"], r["text"], grams(plain_tokens(r["text"]))) for r in items.collect()]
    want = Counter()
    for r in docs.collect():
        mine = grams(plain_tokens(r["text"]))
        want += brute([(r["doc_id"], r["text"])], [(i, t) for i, t, g in item_rows if mine & g])
    assert want and found(docs, items) == want


def test_empty_tables_long_texts_and_other_columns(spark):
    docs = spark.createDataFrame([(1, "a b c d e f g " * 30_000, "k", 1), (2, "x", None, 2)], "doc_id long, text string, `_key` string, row int")
    items = spark.createDataFrame([(9, "a b c d e f g a b c", "z")], "item_id long, text string, doc_id string")
    assert [(r["doc_id"], r["item_id"], r["covered_tokens"], r["coverage"]) for r in d.contaminated(docs, items).collect()] == [(1, 9, 10, 1.0)]
    left = d.drop_contaminated(docs, items)
    assert left.columns == docs.columns and [tuple(r) for r in left.collect()] == [(2, "x", None, 2)]
    assert d.contaminated(docs.limit(0), items).count() == d.contaminated(docs, items.limit(0)).count() == 0
    assert d.drop_contaminated(docs.limit(0), items).count() == 0 and d.drop_contaminated(docs, items.limit(0)).count() == 2


def test_tiles_against_plain_loops():
    r = random.Random(1)
    for _ in range(80):
        a, b = [r.choice("abc") for _ in range(r.randint(5, 30))], [r.choice("abc") for _ in range(r.randint(5, 40))]
        tiles = d.tiles(word_hashes([x.encode() for x in a]), word_hashes([x.encode() for x in b]), 3)
        assert sum(n for _, _, n in tiles) == naive_tiles(a, b, 3)[0]
        assert all(a[i : i + n] == b[j : j + n] for i, j, n in tiles)


def test_the_filter_tells_all_it_holds(spark):
    r = np.random.default_rng(3)
    held, others = r.integers(-(2**63), 2**63 - 1, 2000), r.integers(-(2**63), 2**63 - 1, 20_000)
    f = BitFilter.of(spark.createDataFrame([(int(x),) for x in held], "h long"), "h", 2000, 26)
    assert f.may_have(held).all() and f.may_have(others.astype(np.int64)).mean() < 0.01
    assert BitFilter.of(spark.createDataFrame([(int(x),) for x in held], "h long"), "h", 2000, 8).may_have(held).all()
