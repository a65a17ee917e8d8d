"""The pipeline's stages against plain Python, each on its own input; and on tables of odd rows."""

import re
from collections import Counter, defaultdict

import corpus_pipeline
import numpy as np
import pytest
from lacquer.llm import pii, quality_rules
from lacquer.sources.scratch import stage

from .test_decontamination import brute, plain_tokens
from .test_operators import fingerprint
from .test_pii import base
from .test_quality_rules import path_score, plain_counts

SF = "/root/testdata/sf0.001"


def stages(spark, docs, sf_dir):
    """The rows that each stage leaves."""
    out = [docs]
    for _, function in corpus_pipeline.STAGES:
        out.append(stage(function(spark, out[-1], sf_dir), "test"))
    return out


def check(spark, docs, sf_dir):
    seen = stages(spark, docs, sf_dir)
    columns = docs.columns
    for table in seen[:-1]:
        assert table.columns == columns
    rows = [[r.asDict() for r in t.collect()] for t in seen]
    bag = lambda rs: Counter(tuple(r[c] for c in columns) for r in rs)

    # quality rules: counts by plain Python, and lines labelled by trying out or, for longer texts, by the tested Viterbi
    field = quality_rules.train(docs)
    score = field.scorer()

    def good(text):
        n, _, _, _, repeated = plain_counts(text or "")
        if n < 20 or 100 * repeated > 30 * n:
            return False
        lines = quality_rules.line_features(text.split("\n"))
        masks = [m for m, _ in lines]
        labels = quality_rules.viterbi(masks, score, field.moves.tolist())
        if len(masks) <= 6:
            paths = np.ndindex(*[2] * len(masks))
            assert path_score(masks, labels, field.states, field.moves) == pytest.approx(max(path_score(masks, p, field.states, field.moves) for p in paths))
        return sum(w for (_, w), label in zip(lines, labels, strict=True) if label) >= 0.5 * n

    assert bag(rows[1]) == bag([r for r in rows[0] if good(r["text"])])

    # near duplicates: one row of each component of fingerprints
    fps = [fingerprint(r["text"]) for r in rows[1]]
    root = list(range(len(fps)))
    changed = True
    while changed:
        changed = False
        for i, a in enumerate(fps):
            for j in range(i):
                if (a ^ fps[j]).bit_count() <= 4 and root[i] != root[j]:
                    root[i] = root[j] = min(root[i], root[j])
                    changed = True
    groups = defaultdict(list)
    for k, r in enumerate(rows[1]):
        groups[root[k]].append(r)
    least = lambda ids: min((i for i in ids if i is not None), default=None)
    assert Counter(r["doc_id"] for r in rows[2]) == Counter(least(r["doc_id"] for r in g) for g in groups.values())
    assert not bag(rows[2]) - bag(rows[1])

    # decontamination: every document that shares five tokens with an item, tiled by loops
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
    grams = lambda t, n=5: {tuple(t[k : k + n]) for k in range(len(t) - n + 1)}
    known = [(i, t, grams(plain_tokens(t))) for i, t in items if i is not None]
    clean = [r for r in rows[2] if not brute([(r["doc_id"], r["text"])], [(i, t) for i, t, g in known if len(plain_tokens(t)) < 5 or g & grams(plain_tokens(r["text"]))])]
    assert bag(rows[3]) == bag(clean)

    # personal data: strict kinds are gone and nothing else of a document without any span changes
    model = pii.train(seen[3])
    assert len(rows[4]) == len(rows[3])
    want = Counter()
    for r in rows[3]:
        text = r["text"]
        spans = sorted(set(base(text)) | set(pii.all_spans(text, model.accepts)[1]))
        new, at = [], 0
        for s, k, e in spans:
            if s >= at:
                new += [text[at:s], f"[{pii.KINDS[k].upper()}]"]
            at = max(at, e)
        text = "".join([*new, text[at:]])
        want[tuple({**r, "text": text, "n_chars": len(text)}[c] if c in ("text", "n_chars") else r[c] for c in columns)] += 1
    assert bag(rows[4]) == want

    # mixing: targets by filling up sources in turn, and every source's words cut at its target
    sizes = defaultdict(int)
    for r in rows[4]:
        sizes[r["source"]] += len(re.findall(r"[^\x20\x09-\x0D]+", r["text"] or ""))
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: k % 3 + 1 for k, s in enumerate(order)}
    target, free, left = {}, set(order), float(sum(sizes.values()))
    while free:
        level = left / sum(weight[s] for s in free)
        full = {s for s in free if level * weight[s] > 3 * sizes[s]}
        if not full:
            target |= {s: level * weight[s] for s in free}
            break
        target |= {s: 3.0 * sizes[s] for s in full}
        left -= sum(target[s] for s in full)
        free -= full
    taken = Counter()
    texts = Counter((r["doc_id"], r["text"]) for r in rows[4])
    for r in rows[5]:
        taken[r["source"]] += r["taken"]
        assert r["target"] == pytest.approx(target[r["source"]]) and r["source_size"] == sizes[r["source"]]
        assert 0 < r["taken"] <= 3 * r["size"] and texts[r["doc_id"], r["text"]]
    assert all(taken[s] == int(target[s] + 1e-6) for s in order)
    return rows


def test_stages_against_plain_python(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = check(spark, docs, SF)
    counts = [len(r) for r in rows]
    assert counts[0] > counts[1] > counts[2] > counts[3] == counts[4] > 0
    whole = corpus_pipeline.run(spark, SF)
    assert Counter(r["doc_id"] for r in whole.collect()) == Counter(r["doc_id"] for r in rows[5])


def test_odd_rows(spark, tmp_path):
    """Nulls, empty texts, repeated rows, other columns with telling names, and texts of personal data."""
    prose = "The council met on Monday to discuss the new bridge number {}, and after a long debate the plan was passed by a margin of two; write to a{}@mail.example or call."
    item = "What did the committee of the northern region decide about the old railway line in the end"
    rows = [(k, prose.format(k, k) + " " + " ".join(f"w{k * 7 + i}" for i in range(12)), "en", f"s{k % 4}", 1, "x") for k in range(24)]
    rows += [rows[3]] * 3 + [(30, None, None, None, None, None), (31, "", "en", "s0", 0, ""), (None, prose.format("x", "x") + " none of the others has these words at its end here", "en", None, 1, None), (32, rows[5][1] + " " + item, "en", "s1", 1, "y")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, `size` string")
    folder = f"file://{tmp_path}"
    spark.createDataFrame([(1, item), (2, None), (None, "x y z"), (3, "")], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    docs.write.parquet(f"{folder}/documents.parquet")
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    check(spark, docs, folder)
    for columns in (["doc_id", "text", "source"], docs.columns):
        none = docs.limit(0).select(*columns)
        for table in stages(spark, none, folder):
            assert table.count() == 0
