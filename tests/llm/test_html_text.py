"""Page texts are decided by tag-path ratios: held against plain recomputation, articles and pages without telling names."""

import html as entities
import math
import re
from collections import defaultdict

import pytest

from lacquer.llm import html_text

FIRST = "The council met on Monday to discuss the new bridge, which has been planned for years. Several members spoke against it, citing the cost; others said that the old one is no longer safe."
SECOND = "After three hours of debate, the plan was put to a vote and passed by a margin of two. Work should begin in spring, when the river is low."


def article(source: str) -> str:
    """The article of a page of the test tables, by its one template."""
    inner = re.search(r"<article>(.*?)(?:</article>|$)", source, re.S)[1].replace("<br>", " ")
    parts = (" ".join(entities.unescape(re.sub("<[^>]*>", "", p)).split()) for p in re.split(r"</?(?:p|h1)>", inner))
    return " ".join(p for p in parts if p)


@pytest.fixture(scope="module")
def sources(spark):
    return [r["html"] for r in spark.read.parquet("/root/testdata/sf0.01/pages.parquet").collect()]


def test_recall_and_precision_over_all_pages(sources):
    hits = found = wanted = 0
    for s in sources:
        got, want = html_text.main_text(s).split(), article(s).split()
        hits, found, wanted = hits + len(set(got) & set(want)), found + len(set(got)), wanted + len(set(want))
    assert hits >= 0.99 * wanted and hits >= 0.99 * found


def test_scores_decide(sources, monkeypatch):
    right = [html_text.main_text(s) for s in sources]
    monkeypatch.setattr(html_text, "path_scores", lambda page: ([1.0] * len(page.parent), 0.5))
    assert sum(html_text.main_text(s) != r for s, r in zip(sources, right, strict=True)) > 0.9 * len(sources)
    monkeypatch.setattr(html_text, "path_scores", lambda page: ([0.0] * len(page.parent), 0.5))
    assert not any(map(html_text.main_text, sources))


def brute_scores(page):
    """The fused ratio of each path with text, worked out path by path from the definition."""
    marks = lambda t: sum(c in ".,;:!?…。，；：！？" for c in t)
    by_path, by_parent = defaultdict(list), defaultdict(list)
    for b in page.blocks:
        by_path[b[1]].append(b)
        if not page.heading[b[1]]:
            by_parent[page.parent[b[1]]].append(b)

    def plain(blocks):
        size = sum(len(t) for t, _, _ in blocks)
        return (size - sum(n for _, _, n in blocks)) / len(blocks) * (1 + 10 * sum(marks(t) for t, _, _ in blocks) / size)

    rows = []
    for k in range(len(page.blocks)):
        after = [b for b in page.blocks[k:] if not page.heading[b[1]]]
        rows.append((plain(by_path[after[0][1]]), plain(by_parent[page.parent[after[0][1]]])) if after else (0.0, 0.0))
    scores = {}
    for path in by_path:
        at = [k for k, b in enumerate(page.blocks) if b[1] == path]
        own, near = (sum(rows[k][j] for k in at) / len(at) for j in (0, 1))
        around = 0.0
        for k in at:
            weights = {i: math.exp(-((i - k) ** 2) / 4.5) for i in range(len(rows)) if abs(i - k) <= 4}
            around += sum(w * rows[i][0] for i, w in weights.items()) / sum(weights.values()) / len(at)
        scores[path] = own**0.4 * near**0.3 * around**0.3 * page.names[path]
    return scores


def test_scores_against_brute_force(sources):
    for s in [*sources[:60], *PLAIN]:
        page = html_text.Page(s)
        scores, _ = html_text.path_scores(page)
        for path, want in brute_scores(page).items():
            assert scores[path] == pytest.approx(want)


REPLIES = "".join(f'<div class="k5"><span>{n}</span><p>{t}</p></div>' for n, t in (("Bob", "Nice article, thanks!"), ("Ann", "I like the old bridge. Keep it."), ("Joe", "First!")))
PLAIN = [
    f'<html><body><div class="k1"><div class="k2"><a href=/>Home</a> <a href=/n>News</a></div><div class="k9">We use cookies. Fine?</div><div class="k3"><h1>Bridge plan passes</h1><p>{FIRST}</p><p>{SECOND}</p><h2>What comes next</h2><p>{SECOND} {FIRST}</p>'
    f'<ul><li>Plans are drawn, in May.</li><li>Work begins, in June.</li></ul><p>{SECOND}</p></div><div class="k4"><h3>Replies</h3>{REPLIES}</div><div class="k6">Copyright 2020 The Paper. All rights reserved.</div></div></body></html>',
    f'<body><h1>Bridge plan passes</h1><p>{FIRST}<p>{SECOND}<div class="n">Terms apply.</div>',
]


def test_pages_without_telling_names():
    assert html_text.main_text(PLAIN[0]) == f"Bridge plan passes {FIRST} {SECOND} What comes next {SECOND} {FIRST} Plans are drawn, in May. Work begins, in June. {SECOND}"
    assert html_text.main_text(PLAIN[1]) == f"Bridge plan passes {FIRST} {SECOND}"


def test_names_are_one_factor():
    long_comments = f'<div id="comments"><p>{FIRST * 3}</p></div><article><p>A short text, here.</p></article>'
    assert html_text.main_text(long_comments) == "A short text, here."
    nested = f'<header>Site</header><main><h1>T</h1><div class="x"><p>{FIRST}</p><blockquote><p>A quotation, of it.</p></blockquote></div><aside><p>{SECOND}</p></aside></main><footer>{SECOND}</footer>'
    assert html_text.main_text(nested) == f"T {FIRST} A quotation, of it."
    assert html_text.main_text("<p>Hi</p><p hidden>no</p><p style='display: none'>no</p>") == "Hi"
