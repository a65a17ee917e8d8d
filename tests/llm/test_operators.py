import hashlib
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
import xxhash

from lacquer.llm import decontamination, html_text, language_id, mixing, pii, quality_classifier, quality_rules, simhash, substrings, warc

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, kept string"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def corpus():
    """Nulls, empty and long texts, ties, repeated rows and a column whose name clashes."""
    r = random.Random(3)
    words = ["".join(r.choice("abcdefgh") for _ in range(5)) for _ in range(300)]
    rows = [(i, " ".join(r.choice(words) for _ in range(40)) + ".", "en" if i % 2 else "de", f"s{i % 3}", 1, "x") for i in range(30)]
    passage = rows[3][1]
    rows += [(40, "Start here " + passage + " mail a.b@c.example.org or +1 (555) 123-4567", "en", None, 1, None), (41, passage, "en", "s1", 1, "y"), (41, passage, "en", "s1", 1, "y")]
    rows += [(50, None, None, None, None, None), (51, "", "en", "s0", 0, ""), (None, passage, "en", "s0", 1, ""), (52, "x " * 5000 + "4111 1111 1111 1111 at 10.0.0.1 999.1.1.1", "en", "s0", 1, "")]
    return rows


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(corpus(), SCHEMA).cache()


def test_empty_tables(spark, docs):
    none = docs.limit(0)
    labels = spark.createDataFrame([], "doc_id long, quality int")
    assert mixing.mix_sources(none).count() == 0
    assert simhash.near_duplicates(none).count() == 0
    assert substrings.remove_repeats(none).count() == 0
    assert pii.find_pii(none).count() == 0
    assert quality_rules.judge(none).count() == 0
    assert language_id.identify(none, language_id.train(none)).count() == 0
    assert quality_classifier.rate(none, quality_classifier.train(none, labels)).count() == 0
    assert decontamination.contaminated(none, spark.createDataFrame([], "item_id long, text string")).count() == 0
    pages = spark.createDataFrame([], "page_id long, url string, html string")
    assert html_text.extract(pages).count() == 0 and warc.round_trip(pages).count() == 0
    assert simhash.keep_one(none).count() == quality_rules.keep_good(none).count() == pii.redact(none).count() == 0


def test_mixing_meets_targets(docs):
    rows = mixing.mix_sources(docs, rows_per_range=5).collect()
    assert len(rows) == len(corpus())
    taken, target, size = Counter(), {}, {}
    for r in rows:
        key = r["source_size"], r["target"]
        taken[key] += r["taken"]
        assert 0 <= r["taken"] <= 3 * r["size"]
    for (size, target), n in taken.items():
        assert n == int(target) and target <= 3 * size + 1e-6


def fingerprint(text):
    lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    w = WORD.findall(lower)
    if not w:
        return 0
    shingles = [" ".join(w[i : i + 4]) for i in range(len(w) - 3)] or [" ".join(w)]
    hs = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def test_simhash_components(docs):
    rows = corpus()
    fps = [fingerprint(r[1]) for r in rows]
    root = list(range(len(rows)))
    for _ in rows:
        for i, a in enumerate(fps):
            for j, b in enumerate(fps):
                if (a ^ b).bit_count() <= 4:
                    root[i] = root[j] = min(root[i], root[j])
    least = defaultdict(list)
    for i, r in enumerate(rows):
        least[root[i]].append(r[0])
    want = Counter((r[0], f"{fps[i]:016x}", min(x for x in least[root[i]] if x is not None)) for i, r in enumerate(rows))
    assert Counter(map(tuple, simhash.near_duplicates(docs).collect())) == want
    kept = simhash.keep_one(docs).collect()
    assert len(kept) == len(least) and kept[0].__fields__ == docs.columns


def test_repeats_against_brute_force(docs):
    rows = corpus()
    words = [WORD.findall(r[1] or "") for r in rows]
    first = {}
    for r, w in zip(rows, words, strict=True):
        for i in range(len(w) - 12):
            if r[0] is not None:
                k = tuple(w[i : i + 13])
                first[k] = min(first.get(k, r[0]), r[0])
    want = Counter()
    for r, w in zip(rows, words, strict=True):
        gone = {j for i in range(len(w) - 12) if r[0] is not None and first[tuple(w[i : i + 13])] < r[0] for j in range(i, i + 13)}
        kept = " ".join(x for j, x in enumerate(w) if j not in gone)
        want[(r[0], len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest())] += 1
    assert Counter(map(tuple, substrings.remove_repeats(docs).collect())) == want


def test_pii_base_spans(docs):
    found = {r["doc_id"]: r for r in pii.find_pii(docs).collect()}
    assert (found[40]["n_email"], found[40]["n_phone"]) == (1, 1)
    assert (found[52]["n_card"], found[52]["n_ip"]) == (1, 1)
    assert found[50]["spans"] == "" and found[50]["base_sha256"] == hashlib.sha256(b"").hexdigest()
    assert "a.b@c" not in pii.redact(docs).where("doc_id = 40").first()["text"]


@pytest.mark.parametrize("text", ["a@b.c_d@e.f", "x@@y.z", "1.2.3.4.5 01.002.3.255", "4111-1111 1111 1111", "+1 (017) 555-7713.", "@.a@b-.c.", "é a@b.co"])
def test_strict_spans_against_plain_patterns(text):
    email, ip = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"), re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
    want = [(m.start(), 0, m.end()) for m in email.finditer(text)] + [(m.start(), 1, m.end()) for m in ip.finditer(text) if all(int(x) <= 255 for x in m[0].split("."))]
    assert [s for s in pii.strict_spans(text) if s[1] < 2] == sorted(want)


def test_quality_counts(docs):
    rows = {r["doc_id"]: r for r in quality_rules.judge(docs).collect()}
    assert rows[50]["n_words"] == 0 and rows[50]["base_failed"] and not rows[50]["kept"]
    assert rows[52]["n_repeat_words"] == 5000 and rows[52]["base_failed"]
    assert rows[3]["kept"] and not rows[3]["base_failed"]
    assert quality_rules.base_counts("a b\na b\n \n# $") == (6, 6, 2, 1, 0)


def test_language_and_quality_learn(spark):
    r = random.Random(5)
    make = lambda letters: " ".join("".join(r.choice(letters) for _ in range(4)) for _ in range(12))
    rows = [(i, make("abcde" if i % 2 else "vwxyz"), "aa" if i % 2 else "zz") for i in range(120)] + [(200, None, None), (201, "12 !", "aa")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    found = {x["doc_id"]: x for x in language_id.identify(docs, language_id.train(docs)).collect()}
    assert all(found[i]["lang_pred"] == ("aa" if i % 2 else "zz") for i in range(120)) and found[200]["lang_pred"] == found[201]["lang_pred"] == "und"
    labels = spark.createDataFrame([(i, i % 2) for i in range(120)] + [(3, None)], "doc_id long, quality int")
    scored = quality_classifier.rate(docs, quality_classifier.train(docs, labels)).collect()
    assert len(scored) == 122 and all(x["predicted"] == x["doc_id"] % 2 for x in scored if x["doc_id"] < 120)


def test_decontamination_of_reordered_passages(spark, docs):
    w = corpus()[5][1].split()
    items = spark.createDataFrame([(7, " ".join(w[20:35] + w[:15])), (8, None), (None, "x"), (9, "nothing like it at all in there")], "item_id long, text string")
    assert [(x["doc_id"], x["item_id"], x["tiles"]) for x in decontamination.contaminated(docs, items).collect()] == [(5, 7, 2)]
    assert docs.count() - decontamination.drop_contaminated(docs, items).count() == 1


def test_main_text():
    page = """<html><body class="has-sidebar"><header><h1>Site</h1></header><div id="nav-menu"><a href=x>Home</a></div><div class="cookie-notice">We use cookies. OK?</div>
    <div class="post-content"><h2>A title</h2><p>First paragraph, with some text &amp; <a href=z>a link</a> in it.<p>Second one; it has more text. Yes.<script>var t="</p>"</script><div class="advert">Buy now!</div></div>
    <section id="comments"><p>Nice article, thank you for it! I like it very much.</p></section><footer>&copy; me</footer></body></html>"""
    assert html_text.main_text(page) == "A title First paragraph, with some text & a link in it. Second one; it has more text. Yes."
    assert html_text.main_text(None) == html_text.main_text("") == html_text.main_text("<nav>a</nav>") == ""


def test_warc_round_trip(spark):
    rows = [(1, "http://a.b/x", "hi"), (1, "http://a.b/x", "ho"), (None, None, None), (2, "http://www.Ä.b:8080/ y\n?q", None), (1, "http://a.b/x", "hi"), (3, "::::", "hi")]
    found = Counter((r[0], r[1], r[3], r[4]) for r in warc.round_trip(spark.createDataFrame(rows, "page_id long, url string, html string")).collect())
    assert found == Counter([(1, 2, "revisit", 3)] * 2 + [(1, 2, "response", None), (None, 0, "revisit", 2), (2, 0, "response", None), (3, 2, "response", None)])
    member = warc.write_record(1, "u", b"payload", warc.base32_sha1(b"payload"), None)
    assert warc.read_record(member)[1] == b"payload"


def test_distinct_hashes():
    h = np.array([5, 9, 5, 2, 9, 9, 7], np.uint64)
    first, of = substrings.distinct(h)
    assert first.tolist() == [0, 1, 3, 6] and of.tolist() == [0, 1, 0, 2, 1, 1, 3]
    assert [x.tolist() for x in substrings.distinct(h[:0])] == [[], []]
    more = np.array([1, 9, 1, 2, 8, 9, 7], np.uint32)
    first, of = substrings.distinct(h, more)
    assert first.tolist() == [0, 1, 3, 4, 6] and of.tolist() == [0, 1, 0, 2, 3, 1, 4]


def test_hashes_that_collide_in_64_bits(monkeypatch):
    """With almost no bits in the first hash of windows, the second still tells different windows apart."""
    plain = substrings.Pack.windows

    def poor(self, width, base):
        at, h, doc = plain(self, width, base)
        return at, (h % np.uint64(3) if base == substrings.WINDOW_BASE else h), doc

    monkeypatch.setattr(substrings.Pack, "windows", poor)
    r = random.Random(2)
    words = [[f"w{r.randint(0, 40)}" for _ in range(60)] for _ in range(20)]
    for k in range(1, 20, 2):
        words[k][10:40] = words[k - 1][5:35]
    first = {}
    for i, w in enumerate(words):
        for k in range(48):
            first.setdefault(tuple(w[k : k + 13]), i)
    want = {i: len({j for k in range(48) if first[tuple(w[k : k + 13])] < i for j in range(k, k + 13)}) for i, w in enumerate(words)}
    group = {"doc_id": list(range(20)), "text": [" ".join(w) for w in words]}
    pack = substrings.Pack(pa.table(group))
    at, h, doc = pack.windows(13, substrings.WINDOW_BASE)
    more = pack.second_hashes(at, 13)
    head, of = substrings.distinct(h, more)
    gone = np.zeros(len(pack.hashes), bool)
    gone[at[doc > doc[head][of]]] = True
    gone = substrings.spread(gone, 0, 12)
    assert {i: int(gone[60 * i : 60 * i + 60].sum()) for i in range(20)} == want


def test_repeats_of_a_hot_passage(spark):
    """One passage in every text, at odd places, with ids out of order and packs that hold many of them."""
    r = random.Random(9)
    word = lambda: "".join(r.choice("abcdefghij") for _ in range(6))
    passage = [word() for _ in range(30)]
    ids = r.sample(range(-500, 1500), 150)
    texts = [[word() for _ in range(r.randint(0, 9))] + passage[r.randint(0, 3) :] + [word() for _ in range(r.randint(0, 9))] for _ in ids]
    first = {}
    for i, w in zip(ids, texts, strict=True):
        for k in range(len(w) - 12):
            key = tuple(w[k : k + 13])
            first[key] = min(first.get(key, i), i)
    want = {i: len({j for k in range(len(w) - 12) if first[tuple(w[k : k + 13])] < i for j in range(k, k + 13)}) for i, w in zip(ids, texts, strict=True)}
    docs = spark.createDataFrame([(i, " ".join(w)) for i, w in zip(ids, texts, strict=True)], "doc_id long, text string")
    assert {x["doc_id"]: x["n_removed"] for x in substrings.remove_repeats(docs).collect()} == want


def test_columns_with_clashing_names(spark):
    names = ("_id", "_hash", "_nth", "__id", "kept", "key", "size", "range", "pack", "fp", "h", "label", "held_out", "target", "taken", "spans", "score")
    rows = corpus()
    docs = spark.createDataFrame([(*r[:5], *names) for r in rows], "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"{c} string" for c in names))
    labels = spark.createDataFrame([(i, i % 2, "x") for i in range(30)], "doc_id long, quality int, text string")
    items = spark.createDataFrame([(1, "nothing like it at all in there", "x")], "item_id long, text string, doc_id string")
    for out in (mixing.mix_sources(docs), simhash.near_duplicates(docs), substrings.remove_repeats(docs), pii.find_pii(docs), quality_rules.judge(docs), language_id.identify(docs, language_id.train(docs)), quality_classifier.rate(docs, quality_classifier.train(docs, labels)), decontamination.drop_contaminated(docs, items), pii.redact(docs)):
        assert out.count() == len(rows)
    for out in (simhash.keep_one(docs), quality_rules.keep_good(docs)):
        assert out.columns == docs.columns and 0 < out.count() < len(rows)


def test_pages_with_nulls_and_repeats(spark):
    page = "<html><body><article><p>One &amp; only text, with a comma.</p></article></body></html>"
    rows = [(1, "u", page, "x"), (1, "u", page, "x"), (None, None, None, None), (2, None, "", "x"), (3, "u", "<p>" + "long words, here. " * 20000 + "</p>", "x")]
    found = html_text.extract(spark.createDataFrame(rows, "page_id long, url string, html string, text string")).collect()
    got = Counter((r["page_id"], r["n_chars"]) for r in found)
    assert got == Counter([(1, 30), (1, 30), (None, 0), (2, 0), (3, 20000 * 18 - 1)])
