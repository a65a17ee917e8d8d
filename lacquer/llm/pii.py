"""Personal data by weak supervision.

Candidates come from strict patterns (e-mail, IP address, card, phone) and from loose ones. Strict
matches always stay. On each loose candidate, labelers of three kinds, by pattern, by word list and by
context, vote yes, no or nothing. Expectation-maximisation over the counts of vote patterns estimates
how reliable each labeler is and how likely each pattern is personal data; a logistic classifier over
votes, kind and shape is trained on those likelihoods and decides about the candidates.

Nothing-votes are no evidence, both classes are equally likely beforehand, and a labeler is never taken
to be worse than chance; what is known of it beforehand weighs half, however large the corpus is. So
votes that agree decide alike in any corpus, and where votes differ, shares in the corpus decide and not
its size. The model learns from the counts of all loose candidates; there are
at most as many different patterns as votes, kinds and shapes allow, so what reaches the driver is bounded.
"""

from __future__ import annotations

import hashlib
import re
from collections import Counter
from collections.abc import Callable, Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import slices, table

#: Kinds in the order in which spans with the same start are listed; the first four are the strict ones.
KINDS = ("email", "ip", "card", "phone", "masked_email", "local_phone", "id_number", "account", "secret")
STRICT = KINDS[:4]

# The patterns of the four strict kinds, as agreed.
IP = re.compile(r"(?<![0-9])[0-9]++(\.[0-9]++)(\.[0-9]++)(\.[0-9]++)")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")

MASKED = re.compile(r"\x20?[\[(\x20]at[\])\x20]\x20?[A-Za-z0-9-]++\x20?[\[(\x20]dot[\])\x20]\x20?[A-Za-z]{2,24}")
LOCAL_PHONE = re.compile(r"(?<![0-9+])(?:\([0-9]{3}\)\x20?|[0-9]{3}[\x20.-])[0-9]{3}[\x20.-][0-9]{4}(?![0-9])")
ID_NUMBER = re.compile(r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])")
ACCOUNT = re.compile(r"(?<![0-9])[0-9]{12,19}(?![0-9])")
SECRET = re.compile(r"[:=]\x20?[\"']?([A-Za-z0-9_./+=-]{16,})")
DIGIT = re.compile(r"[0-9]")
HEX = re.compile(r"[0-9a-f]{32,64}|[0-9A-F]{32,64}")

# Word lists of the gazetteer and context labelers.
CUES = {
    "email": "email mail e-mail contact write reach",
    "ip": "ip host server address from client",
    "card": "card visa mastercard amex credit debit pay",
    "phone": "phone tel call mobile fax telephone cell",
    "masked_email": "email mail e-mail contact write reach",
    "local_phone": "phone tel call mobile fax telephone cell",
    "id_number": "ssn social security id passport tax",
    "account": "account iban card acct bank number",
    "secret": "token key secret password passwd apikey api_key credential",
}
COUNTER_CUES = frozenset("version isbn issn order page chapter build release doi sku score total year section fig".split())
MAIL_ENDINGS = frozenset("com org net edu gov io de fr es uk cn info biz eu us".split())
CUE_SETS = {k: frozenset(v.split()) for k, v in CUES.items()}

#: Labelers in the order of the votes, with how often each is right as far as is known before seeing a corpus.
LABELERS = {"form": 0.8, "checksum": 0.95, "gazetteer": 0.65, "context": 0.9, "counter_context": 0.85, "boundary": 0.75, "variety": 0.7}
#: What that knowledge weighs against the corpus, whatever its size; and the least that a labeler is right.
KNOWN_SHARE, LEAST_RIGHT = 0.5, 0.55


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        if k % 2:
            d = d * 2 - 9 * (d > 4)
        total += d
    return total % 10 == 0


def emails(text: str) -> Iterator[tuple[int, int]]:
    """Leftmost matches of the e-mail pattern, found from each @ so that no text takes quadratic time."""
    end, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > end and text[start - 1] in LOCAL:
            start -= 1
        m = DOMAIN.match(text, at + 1) if start < at else None
        if m:
            end = m.end()
            yield start, end
        at = text.find("@", max(at + 1, end))


def strict_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the four strict kinds, sorted."""
    out = [(s, 0, e) for s, e in emails(text)]
    if not DIGIT.search(text):
        return out
    for m in IP.finditer(text):
        if all(len(p := x.lstrip("0")) < 4 and int(p or 0) <= 255 for x in m[0].split(".")):
            out.append((m.start(), 1, m.end()))
    for m in CARD.finditer(text):
        if m.end() - m.start() >= 14:
            digits = m[0].replace(" ", "").replace("-", "")
            if 14 <= len(digits) <= 19 and luhn(digits):
                out.append((m.start(), 2, m.end()))
    for m in PHONE.finditer(text):
        if 10 <= sum("0" <= c <= "9" for c in m[0]) <= 15:
            out.append((m.start(), 3, m.end()))
    out.sort()
    return out


def loose_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of candidates that no strict pattern has to match."""
    out = []
    if " dot" in text or "[dot" in text or "(dot" in text:
        end = 0
        for m in MASKED.finditer(text):
            start = m.start()
            while start > end and text[start - 1] in LOCAL:
                start -= 1
            if start < m.start():
                out.append((start, 4, m.end()))
                end = m.end()
    if DIGIT.search(text):
        out += [(m.start(), 5, m.end()) for m in LOCAL_PHONE.finditer(text)]
        out += [(m.start(), 6, m.end()) for m in ID_NUMBER.finditer(text)]
        out += [(m.start(), 7, m.end()) for m in ACCOUNT.finditer(text)]
        out += [(m.start(1), 8, m.end(1)) for m in SECRET.finditer(text)]
    return out


def votes(text: str, start: int, kind: int, end: int) -> str:
    """One of + - 0 from each labeler on a loose candidate."""
    span, name = text[start:end], KINDS[kind]
    digits = "".join(c for c in span if "0" <= c <= "9")
    before = set(re.findall(r"[a-z_-]+", text[max(0, start - 40) : start].lower())[-4:])
    number, secret = name == "account", name == "secret"
    known = digits[:1] in "3456" and len(digits) in (14, 15, 16) if number else bool(HEX.fullmatch(span)) if secret else False
    if name == "masked_email":
        ending = "+" if re.split(r"[^a-z]+", span.lower())[-1] in MAIL_ENDINGS else "-"
    else:
        ending = "+" if known else "0"
    return "".join(
        (
            "0" if number or secret else "+",
            ("+" if luhn(digits) else "-") if number else "0",
            ending,
            "+" if CUE_SETS[name] & before else "0",
            "-" if COUNTER_CUES & before else "0",
            "-" if text[start - 1 : start].isalnum() or text[end : end + 1].isalnum() else "0",
            "-" if len(set(span)) < 4 else "+" if secret and digits and len(digits) < len(span) and len(set(span)) >= 8 else "0",
        )
    )


def pattern(text: str, start: int, kind: int, end: int) -> str:
    """Votes, kind and shape of a loose candidate: all that the model sees."""
    return f"{votes(text, start, kind, end)}{kind}{min(4, (end - start) // 8)}"


def free_of(spans: list[tuple[int, int, int]], taken: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """The spans, leftmost first, that overlap neither a taken one nor an earlier one of their own."""
    out, at, k, ends = [], 0, 0, sorted(taken)
    reach = 0
    for s, kind, e in sorted(spans):
        while k < len(ends) and ends[k][0] <= s:
            reach = max(reach, ends[k][2])
            k += 1
        if s >= reach and s >= at and (k == len(ends) or ends[k][0] >= e):
            out.append((s, kind, e))
            at = e
    return out


class SpanModel:
    """Reliabilities by expectation-maximisation, and the classifier trained on their likelihoods.

    counts has how often each pattern occurs. A labeler has reliabilities of its own for each kind:
    reliability has, for (kind, labeler), how often its yes and its no are right. likelihood has how
    likely each pattern is personal data. The classifier also learns from one imagined candidate for
    each single vote, so that votes which the corpus lacks, or has once, weigh what is known of them.
    """

    def __init__(self, counts: dict[str, int], rounds: int = 60):
        self.likelihood: dict[str, float] = {}
        self.reliability: dict[tuple[str, str], tuple[float, float]] = {}
        before, x, target, weight = np.array(list(LABELERS.values())), [], [], []
        for kind in range(len(STRICT), len(KINDS)):
            patterns = sorted(p for p in counts if p[len(LABELERS)] == str(kind))
            n = np.array([counts[p] for p in patterns], float)
            v = np.array([["0+-".index(c) for c in p[: len(LABELERS)]] for p in patterns], int).reshape(len(patterns), len(LABELERS))
            right = np.stack((before, before))  # of yes votes, and of no votes
            yes = likelihood(v, right)
            for _ in range(rounds if patterns else 0):
                for k, agrees in enumerate((yes, 1 - yes)):
                    cast = v == k + 1
                    size = (cast * n[:, None]).sum(0)
                    seen = np.where(size > 0, (cast * (n * agrees)[:, None]).sum(0) / np.maximum(size, 1), before)
                    right[k] = np.maximum(KNOWN_SHARE * before + (1 - KNOWN_SHARE) * seen, LEAST_RIGHT)
                yes = likelihood(v, right)
            self.likelihood |= dict(zip(patterns, yes.tolist(), strict=True))
            self.reliability |= {(KINDS[kind], name): (float(right[0, k]), float(right[1, k])) for k, name in enumerate(LABELERS)}
            # a pattern weighs by the logarithm of its count, so that rare ones are fitted too
            x += map(self.features, patterns)
            target += yes.tolist()
            weight += np.log1p(n).tolist()
            for k in range(len(LABELERS)):
                for vote, sure in (("+", right[0, k]), ("-", 1 - right[1, k])):
                    x.append(self.features("0" * k + vote + "0" * (len(LABELERS) - k - 1) + str(kind)))
                    target.append(float(sure))
                    weight.append(1.0)
        self.weights = fit_logistic(np.array(x), np.array(target), np.array(weight))

    @staticmethod
    def features(p: str) -> np.ndarray:
        """A place for each yes and no of each labeler on each kind, and one for each size; an imagined candidate has no size."""
        votes, kind, size = p[: len(LABELERS)], int(p[len(LABELERS)]) - len(STRICT), p[len(LABELERS) + 1 :]
        each = 2 * len(LABELERS)
        x = np.zeros(each * (len(KINDS) - len(STRICT)) + 5)
        for k, c in enumerate(votes):
            if c != "0":
                x[each * kind + 2 * k + (c == "+")] = 1
        if size:
            x[int(size) - 5] = 1
        return x

    def accepts(self, p: str) -> bool:
        """Whether the classifier calls a pattern personal data; a pattern without any vote is not."""
        return p[: len(LABELERS)].strip("0") != "" and float(self.features(p) @ self.weights) > 0


def likelihood(v: np.ndarray, right: np.ndarray) -> np.ndarray:
    """How likely candidates with votes (0 nothing, 1 yes, 2 no) are personal data, by how often yes and no votes are right."""
    odds = np.log(right) - np.log1p(-np.minimum(right, 0.999))
    return 1 / (1 + np.exp(-((v == 1) * odds[0] - (v == 2) * odds[1]).sum(1)))


def fit_logistic(x: np.ndarray, target: np.ndarray, weight: np.ndarray, ridge: float = 1e-2, rounds: int = 40) -> np.ndarray:
    """Logistic regression without a bias on targets from 0 to 1, by Newton's method."""
    w = np.zeros(x.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        slope = x.T @ (weight * (target - p)) - ridge * w
        bend = (x * (weight * p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(w))
        step = np.linalg.solve(bend, slope)
        w += np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-9:
            break
    return w


def train(docs: DataFrame) -> SpanModel:
    """Fit on the loose candidates of all documents, gathered as counts of patterns."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter[str] = Counter()
        for batch in slices(batches):
            for text in batch.column("text").to_pylist():
                if text:
                    seen.update(pattern(text, *s) for s in free_spans(text)[1])
        yield pa.RecordBatch.from_pydict({"pattern": pa.array(list(seen), pa.string()), "n": pa.array(list(seen.values()), pa.int64())})

    rows = docs.select("text").mapInArrow(count, "pattern string, n long").groupBy("pattern").agg(F.sum("n").alias("n")).collect()
    return SpanModel({r[0]: r[1] for r in rows})


def free_spans(text: str) -> tuple[list[tuple[int, int, int]], list[tuple[int, int, int]]]:
    """The strict spans, and the loose ones that overlap none of them."""
    strict, loose = strict_spans(text), loose_spans(text)
    return strict, free_of(loose, strict) if loose else []


def all_spans(text: str, accepts: Callable[[str], bool]) -> tuple[list[tuple[int, int, int]], list[tuple[int, int, int]]]:
    """The strict spans; and those with the loose ones that the model accepts."""
    strict, loose = free_spans(text)
    return strict, sorted(strict + [s for s in loose if accepts(pattern(text, *s))])


def listed(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in spans)


def redacted(text: str, spans: list[tuple[int, int, int]]) -> str:
    """The text with each span, or run of overlapping spans, replaced by the kind of its first in brackets."""
    out, at = [], 0
    for s, k, e in spans:
        if s >= at:
            out += [text[at:s], f"[{KINDS[k].upper()}]"]
        at = max(at, e)
    return "".join([*out, text[at:]])


def find_pii(docs: DataFrame, model: SpanModel | None = None) -> DataFrame:
    """(doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_spans) for each row of docs (doc_id, text).

    A null text counts as empty: no spans, and the hash of the empty string. Rows with a null or
    repeated doc_id give a row each. An empty table gives no rows. Offsets are in code points.
    """
    model = model or train(docs)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        accepts = cache(model.accepts)
        for batch in slices(batches):
            n: list[list[int]] = [[], [], [], []]
            digests, spans, sizes = [], [], []
            for text in batch.column("text").to_pylist():
                strict, every = all_spans(text or "", accepts)
                kinds = Counter(k for _, k, _ in strict)
                for k in range(4):
                    n[k].append(kinds[k])
                digests.append(hashlib.sha256(listed(strict).encode()).hexdigest())
                spans.append(listed(every))
                sizes.append(len(every))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *[pa.array(x, pa.int64()) for x in n], pa.array(digests, pa.string()), pa.array(spans, pa.string()), pa.array(sizes, pa.int64())], ["doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans", "n_spans"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_spans long")


def redact(docs: DataFrame, model: SpanModel | None = None) -> DataFrame:
    """docs with every span of text replaced by its kind, and n_chars, if there, counted anew. A null text stays null."""
    model = model or train(docs)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        accepts = cache(model.accepts)
        for batch in slices(batches):
            texts = batch.column("text").to_pylist()
            clean = pa.array([t and redacted(t, all_spans(t, accepts)[1]) for t in texts], pa.string())
            yield batch.set_column(batch.schema.get_field_index("text"), "text", clean)

    out = docs.mapInArrow(run, docs.schema)
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_pii(table(spark, sf_dir, "documents"))
