"""Personal data: the base kinds against plain patterns over a whole table, the model against plain arithmetic and for stability."""

import hashlib
import math
import random
import re
from collections import Counter

import pytest

from lacquer.llm import pii

EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def luhn(digits):
    doubled = [int(d) * (1 + k % 2) for k, d in enumerate(reversed(digits))]
    return sum(d // 10 + d % 10 for d in doubled) % 10 == 0


def base(text):
    """(start, kind, end) by the patterns as they are written in the agreement."""
    digits = lambda s: re.sub("[^0-9]", "", s)
    out = [(m.start(), 0, m.end()) for m in EMAIL.finditer(text)]
    out += [(m.start(), 1, m.end()) for m in IP.finditer(text) if all(int(x) <= 255 for x in m[0].split("."))]
    out += [(m.start(), 2, m.end()) for m in CARD.finditer(text) if 14 <= len(digits(m[0])) <= 19 and luhn(digits(m[0]))]
    out += [(m.start(), 3, m.end()) for m in PHONE.finditer(text) if 10 <= len(digits(m[0])) <= 15]
    return sorted(out)


def listed(spans):
    return ",".join(f"{pii.KINDS[k]}:{s}:{e}" for s, k, e in spans)


@pytest.mark.parametrize("sf", ["0.001", "0.01"])
def test_base_columns_of_whole_tables(spark, sf):
    docs = spark.read.parquet(f"/root/testdata/sf{sf}/documents.parquet")
    texts = {r["doc_id"]: r["text"] or "" for r in docs.select("doc_id", "text").collect()}
    found = pii.find_pii(docs).collect()
    assert len(found) == len(texts) and sum(len(base(t)) for t in texts.values()) > 20
    for r in found:
        want = base(texts[r["doc_id"]])
        kinds = Counter(k for _, k, _ in want)
        assert (r["n_email"], r["n_ip"], r["n_card"], r["n_phone"]) == tuple(kinds[k] for k in range(4))
        assert r["base_sha256"] == hashlib.sha256(listed(want).encode()).hexdigest()
        every = r["spans"].split(",") if r["spans"] else []
        assert r["n_spans"] == len(every) and not set(filter(None, listed(want).split(","))) - set(every)
        # every assigned 40-digit hexadecimal secret is found, whatever the size of the table
        for m in re.finditer(r'(?i)token = "([0-9a-f]{40})"', texts[r["doc_id"]]):
            assert f"secret:{m.start(1)}:{m.end(1)}" in every


def test_base_kinds_on_random_strings():
    r = random.Random(11)
    for _ in range(20_000):
        text = "".join(r.choice("0123456789..@@ab-+() é\n") for _ in range(r.randint(0, 50)))
        assert pii.strict_spans(text) == base(text)


def plain_model(counts, kind, rounds=60):
    """The expectation-maximisation of one kind, candidate by candidate."""
    before = list(pii.LABELERS.values())
    right = {(k, c): b for k, b in enumerate(before) for c in "+-"}
    for _ in range(rounds + 1):
        yes = {}
        for p in counts:
            odds = 0.0
            for k, c in enumerate(p[:7]):
                if c != "0":
                    q = right[k, c]
                    odds += (math.log(q / (1 - min(q, 0.999)))) * (1 if c == "+" else -1)
            yes[p] = 1 / (1 + math.exp(-odds))
        old = dict(right)
        for k, b in enumerate(before):
            for c in "+-":
                cast = [p for p in counts if p[k] == c]
                if cast:
                    seen = sum(counts[p] * (yes[p] if c == "+" else 1 - yes[p]) for p in cast) / sum(counts[p] for p in cast)
                    right[k, c] = max(0.5 * b + 0.5 * seen, 0.55)
    return yes, old


def test_reliabilities_against_plain_arithmetic():
    counts = {"0-+000072": 61, "0-0000072": 97, "0++000072": 2, "0+0+00072": 5}
    model = pii.SpanModel(counts)
    yes, right = plain_model(counts, 7)
    for p, v in yes.items():
        assert model.likelihood[p] == pytest.approx(v, abs=1e-6) and model.accepts(p) == (v > 0.5)
    for k, name in enumerate(pii.LABELERS):
        assert model.reliability["account", name] == pytest.approx((right[k, "+"], right[k, "-"]), abs=1e-6)


def test_same_verdict_in_corpora_of_any_size():
    mixed = {"0-+000072": 3, "0-0000072": 5, "0++000072": 1, "00++00+84": 8, "+00000051": 1, "00000-084": 2}
    models = [pii.SpanModel({p: n * size for p, n in mixed.items()}) for size in (1, 100, 10**7)]
    assert len({tuple(m.accepts(p) for p in mixed) for m in models}) == 1
    few = pii.SpanModel({"0-+000072": 1})
    assert [few.accepts(p) for p in mixed] == [models[0].accepts(p) for p in mixed] == [False, False, True, True, True, False]
    assert not few.accepts("000000072") and pii.SpanModel({}).accepts("00++00+84")


def test_redaction_and_loose_kinds(spark):
    text = 'write to jo at mail dot example or jo dot org; call 555-123-4567, ssn 123-45-6789, key = "a1b2c3d4e5f6a7b8c9d0", x=aaaaaaaaaaaaaaaaaaaa, a@b.example'
    docs = spark.createDataFrame([(1, text, "x"), (2, None, "x"), (3, "", None)], "doc_id long, text string, n_spans string")
    out = {r["doc_id"]: r for r in pii.redact(docs).collect()}
    assert out[2]["text"] is None and out[3]["text"] == "" and out[1]["n_spans"] == "x"
    assert "555-123" not in out[1]["text"] and "123-45" not in out[1]["text"] and "a1b2" not in out[1]["text"] and "a@b" not in out[1]["text"]
    assert "x=aaaaaaaaaaaaaaaaaaaa" in out[1]["text"]


def test_very_long_text(spark):
    text = "a@b.example 10.0.0.1 " * 20_000
    row = pii.find_pii(spark.createDataFrame([(1, text), (1, text)], "doc_id long, text string")).collect()
    assert [(r["n_email"], r["n_ip"], r["n_spans"]) for r in row] == [(20_000, 20_000, 40_000)] * 2
