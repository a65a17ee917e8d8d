"""Ball hashing against all pairs, and one row of each group, whatever else the rows hold."""

from collections import Counter

import numpy as np
import pytest

from lacquer.llm import simhash
from lacquer.operators.components import components

from .test_operators import fingerprint

SF = "/root/testdata/sf0.001"


def near_fingerprints(n=60):
    r = np.random.default_rng(1)
    base = r.integers(0, 2**63, n).astype(np.uint64)
    out = [base]
    for k in (1, 2, 3, 4, 4, 5, 6):
        flipped = base.copy()
        for i in range(n):
            for b in r.choice(64, k, replace=False):
                flipped[i] ^= np.uint64(1) << np.uint64(b)
        out.append(flipped)
    return np.unique(np.concatenate(out))


def roots(pairs, nodes):
    root = {x: x for x in nodes}
    changed = True
    while changed:
        changed = False
        for a, b in pairs:
            low = min(root[a], root[b])
            if (root[a], root[b]) != (low, low):
                root[a] = root[b] = low
                changed = True
    return root


@pytest.mark.parametrize("most", [3_000_000, 20_000])
def test_links_have_the_closure_of_all_pairs(spark, monkeypatch, most):
    """Also when a chunk holds few variants, so that groups are written out in parts."""
    fps = near_fingerprints()
    monkeypatch.setattr(simhash, "CHUNK_VARIANTS", most)
    df = spark.createDataFrame([(int(x),) for x in fps.view(np.int64)], "fp long")
    found = {(np.int64(r["a"]).astype(np.uint64).item(), np.int64(r["b"]).astype(np.uint64).item()) for r in simhash.near_links(df, len(fps)).collect()}
    near = {(int(x), int(y)) for i, x in enumerate(fps) for y in fps[i + 1 :] if np.bitwise_count(x ^ y) <= 4}
    assert found and {tuple(sorted(p)) for p in found} <= near
    assert roots(found, fps.tolist()) == roots(near, fps.tolist())


def test_a_large_group_is_written_out_in_parts(monkeypatch):
    r = np.random.default_rng(2)
    fps = np.unique((np.uint64(5) << np.uint64(51)) | np.bitwise_xor(r.integers(0, 2**20, 400).astype(np.uint64), np.uint64(77)))
    whole = {tuple(p) for p in zip(*(x.tolist() for x in simhash.ball_links(fps, 13, 4)), strict=True)}
    monkeypatch.setattr(simhash, "CHUNK_VARIANTS", 10_000)
    parts = {tuple(p) for p in zip(*(x.tolist() for x in simhash.ball_links(fps, 13, 4)), strict=True)}
    near = {(int(x), int(y)) for i, x in enumerate(fps) for y in fps[i + 1 :] if np.bitwise_count(x ^ y) <= 4}
    assert parts <= near and roots(whole, fps.tolist()) == roots(parts, fps.tolist()) == roots(near, fps.tolist())


def test_rows_sent_do_not_grow_with_the_corpus():
    assert [len(simhash.blocks(r)) for r in (0, 2, 4)] == [1, 3, 5]
    assert all(sum(w for _, w in simhash.blocks(r)) == 64 and max(w for _, w in simhash.blocks(r)) <= 64 for r in (0, 2, 4))
    x = near_fingerprints(4)
    assert (simhash.rotated(simhash.rotated(x, 13), 64 - 13) == x).all() and (simhash.rotated(x, 0) == x).all()


def test_whole_table_against_all_pairs(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = {r["doc_id"]: fingerprint(r["text"]) for r in docs.collect()}
    ids = sorted(rows)
    pairs = [(a, b) for k, a in enumerate(ids) for b in ids[k + 1 :] if (rows[a] ^ rows[b]).bit_count() <= 4]
    root = roots(pairs, ids)
    found = {r["doc_id"]: (r["fingerprint"], r["component_id"]) for r in simhash.near_duplicates(docs).collect()}
    assert found == {i: (f"{rows[i]:016x}", root[i]) for i in ids} and len(set(root.values())) < len(ids)


def test_one_row_of_each_group(spark):
    text = "one two three four five six seven eight nine ten"
    rows = [(3, text, "b", 1), (3, text, "a", 1), (3, text, "a", 1), (4, text, "z", 2), (None, text, "n", 3), (7, "quite another text of some other words here", "k", 4), (None, None, None, None), (8, "", "e", 0), (None, "a third text that is like none of the two", "m", 5)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, `_hash` string, `fp` int")
    kept = [Counter(map(tuple, simhash.keep_one(d).collect())) for d in (docs, docs.repartition(3), docs.orderBy("_hash"))]
    assert kept[0] == kept[1] == kept[2] and sum(kept[0].values()) == 4
    assert {r[0] for r in kept[0]} == {3, 7, 8, None} and simhash.keep_one(docs).columns == docs.columns
    alone = spark.createDataFrame([(1, "x", "y")] * 5, "doc_id long, text string, nth string")
    assert [tuple(r) for r in simhash.keep_one(alone).collect()] == [(1, "x", "y")]


def test_components_of_chains_and_stars(spark):
    edges = [(k, k + 1) for k in range(40)] + [(100, 100 + k) for k in range(1, 300)] + [(500, 500), (601, 600), (600, 601)]
    found = {r["node"]: r["root"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert found == {**{k: 0 for k in range(41)}, **{100 + k: 100 for k in range(300)}, 600: 600, 601: 600}
