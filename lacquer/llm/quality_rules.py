"""Quality rules with line sequence labelling.

A linear-chain conditional random field labels the lines of a text as content or boilerplate; its
best labelling (Viterbi) gives the share of words in content lines, which decides on retention. The
field reads what a line looks like: length, symbols, capitals, repeats inside the text and so on. It is
trained from signals that it does not read: how many of a line's words are frequent in the corpus, and
whether the line stands in several documents between different neighbours. Lines of which these say
nothing are left open, and the field is fitted to the lines that are not (the gradient is the
difference of two forward-backward passes), starting from plain rules of thumb.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import slices, stage, table
from .ngrams import PIECES, add_pieces, joined, pieces

SYMBOLS = "#*$%&|<>"
FEATURES = ("bias", "words_1_3", "words_4_8", "words_9_20", "words_over_20", "some_symbols", "many_symbols", "capitals", "shouting", "sentence_end", "digits", "repeated", "odd_word_length", "notice", "few_distinct", "stutter", "first", "last")
BIT = {name: k for k, name in enumerate(FEATURES)}
NOTICE = re.compile(r"(?i)licen[sc]e|copyright|all rights reserved|cookie|privacy policy|terms of (?:use|service)|subscribe|sign in|log in|click here|newsletter")
#: What the field holds of a feature before it is trained, as a score for content; what that weighs, in lines.
RULES_OF_THUMB = {"many_symbols": -2.0, "shouting": -2.0, "notice": -2.0, "stutter": -2.0, "capitals": -0.5, "digits": -0.5, "sentence_end": 0.5, "words_9_20": 0.5, "words_over_20": 0.5}
THUMB_WEIGHT = 3.0

#: A document passes with at least MIN_WORDS words, at most MOST_REPEATED percent of them in repeated windows, and LEAST_CONTENT of them in content lines.
MIN_WORDS, MOST_REPEATED, LEAST_CONTENT = 20, 30, 0.5

#: A word is frequent if this share of the documents has it, and two of them. Words are counted in 2 ** WORD_BITS buckets.
FREQUENT, WORD_BITS = 0.05, 16
#: A line's share of frequent words, as a multiple of the corpus's: from HIGH on it is content, under LOW boilerplate.
HIGH, LOW = 0.5, 0.2
#: A line in so many documents and between so many different neighbours is boilerplate.
REPEATS, NEIGHBOURS = 3, 3
#: Lines that are learned from together; a longer text is cut into such runs.
RUN = 40


def line_features(lines: list[str]) -> list[tuple[int, int]]:
    """(bit mask of features, words) of each line that has a word."""
    out, seen = [], set()
    for line in lines:
        words = line.encode().split()
        n = len(words)
        if not n:
            continue
        size = len(line)
        symbols = sum(map(line.count, SYMBOLS))
        letters = sum(map(len, words))
        mask = 1 | 1 << (1 if n <= 3 else 2 if n <= 8 else 3 if n <= 20 else 4)
        if symbols:
            mask |= 1 << BIT["some_symbols"]
            if symbols * 3 >= n:
                mask |= 1 << BIT["many_symbols"]
        if line.isupper():
            mask |= 1 << BIT["capitals"]
        if line.count("!") * 3 >= n:
            mask |= 1 << BIT["shouting"]
        if line.rstrip()[-1:] in (".", "!", "?", ":", '"', "。"):
            mask |= 1 << BIT["sentence_end"]
        if n < 40 and sum(map(str.isdigit, line)) * 5 > size:
            mask |= 1 << BIT["digits"]
        if line in seen:
            mask |= 1 << BIT["repeated"]
        seen.add(line)
        if not 2 * n <= letters <= 14 * n:
            mask |= 1 << BIT["odd_word_length"]
        if n <= 60 and NOTICE.search(line):
            mask |= 1 << BIT["notice"]
        if n > 8 and 2 * len(set(words)) < n:
            mask |= 1 << BIT["few_distinct"]
            if 3 * sum(map(bytes.__eq__, words, words[1:])) > n:
                mask |= 1 << BIT["stutter"]
        out.append((mask, n))
    if out:
        out[0] = (out[0][0] | 1 << BIT["first"], out[0][1])
        out[-1] = (out[-1][0] | 1 << BIT["last"], out[-1][1])
    return out


def seed_label(words: int, frequent: int, usual: float, documents: int, neighbours: int) -> int:
    """0 boilerplate, 1 content, -1 open, by the share of frequent words (usual is the corpus's) and by repeats across documents."""
    if documents >= REPEATS and neighbours >= NEIGHBOURS:
        return 0
    if words < 4:
        return -1
    share = frequent / words
    return 1 if share >= HIGH * usual else 0 if share < LOW * usual else -1


class LineField:
    """A linear-chain conditional random field with two labels over binary features of lines.

    It is fitted to sequences of (mask, seed label), with weights drawn to the rules of thumb.
    """

    def __init__(self, sequences: list[list[tuple[int, int]]], steps: int = 60, rate: float = 0.15):
        thumb = np.zeros((len(FEATURES) + 2, 2))
        for name, v in RULES_OF_THUMB.items():
            thumb[BIT[name]] = -v / 2, v / 2
        sequences = [s for s in sequences if s]
        long = max(map(len, sequences), default=1)
        x = np.zeros((len(sequences), long, len(FEATURES)))
        ok, there = np.ones((len(sequences), long, 2)), np.zeros((len(sequences), long), bool)
        for k, one in enumerate(sequences):
            x[k, : len(one)] = [[m >> b & 1 for b in range(len(FEATURES))] for m, _ in one]
            ok[k, : len(one)] = [[label != 1, label != 0] for _, label in one]
            there[k, : len(one)] = True
        total = max(1, int(there.sum()))
        w, mean, square = thumb.copy(), np.zeros_like(thumb), np.zeros_like(thumb)
        for step in range(1, steps + 1 if sequences else 1):
            scores = x @ w[:-2]
            (p, q), (pf, qf) = expected(scores, ok, there, w[-2:]), expected(scores, np.ones_like(ok), there, w[-2:])
            slope = np.concatenate((np.einsum("slf,slc->fc", x, p - pf), q - qf)) / total - THUMB_WEIGHT / total * (w - thumb)
            mean, square = 0.9 * mean + 0.1 * slope, 0.99 * square + 0.01 * slope**2
            w = w + rate * (mean / (1 - 0.9**step)) / (np.sqrt(square / (1 - 0.99**step)) + 1e-4)
        self.states, self.moves = w[:-2], w[-2:]

    def scorer(self):
        """mask -> (score as boilerplate, score as content), remembered by mask."""
        known: dict[int, tuple[float, float]] = {}
        states = self.states.tolist()

        def score(mask: int) -> tuple[float, float]:
            if mask not in known:
                on = [states[k] for k in range(len(FEATURES)) if mask >> k & 1]
                known[mask] = (sum(s[0] for s in on), sum(s[1] for s in on))
            return known[mask]

        return score


def expected(scores: np.ndarray, ok: np.ndarray, there: np.ndarray, moves: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Expected labels of each place of each sequence, and moves in all, by forward-backward over the labels that ok leaves.

    scores and ok are (sequences, places, labels); there tells places from padding at the end.
    """
    s = np.exp(scores - scores.max(2, keepdims=True)) * ok
    m, last = np.exp(moves), s.shape[1] - 1
    ahead, back = np.empty_like(s), np.ones_like(s)
    for t in range(last + 1):
        ahead[:, t] = s[:, t] if t == 0 else (ahead[:, t - 1] @ m) * s[:, t]
        ahead[:, t] /= ahead[:, t].sum(1, keepdims=True)
    for t in range(last - 1, -1, -1):
        b = (s[:, t + 1] * back[:, t + 1]) @ m.T
        back[:, t] = np.where(there[:, t + 1, None], b / b.sum(1, keepdims=True), 1.0)
    p = ahead * back
    p = p / p.sum(2, keepdims=True) * there[:, :, None]
    joint = ahead[:, :-1, :, None] * m[None, None] * (s * back)[:, 1:, None, :]
    joint = joint / joint.sum((2, 3), keepdims=True) * there[:, 1:, None, None]
    return p, joint.sum((0, 1))


def viterbi(masks: list[int], score, moves: list[list[float]]) -> list[int]:
    """The best labelling, 0 boilerplate and 1 content; a tie goes to content."""
    if not masks:
        return []
    (m00, m01), (m10, m11) = moves
    b, c = score(masks[0])
    steps = []
    for mask in masks[1:]:
        s0, s1 = score(mask)
        from0, to0 = (0, b + m00) if b + m00 > c + m10 else (1, c + m10)
        from1, to1 = (0, b + m01) if b + m01 > c + m11 else (1, c + m11)
        steps.append((from0, from1))
        b, c = to0 + s0, to1 + s1
    label = int(c >= b)
    out = [label]
    for step in reversed(steps):
        label = step[label]
        out.append(label)
    return out[::-1]


def repeat_words(words: list[bytes], width: int = 8) -> int:
    """Words in windows of width (a power of two) words that are found twice or more in the text, the first included."""
    if len(words) <= width:
        return 0
    known: dict[bytes, int] = {}
    ids = np.fromiter((known.setdefault(w, len(known)) for w in words), np.int64, len(words))
    if len(known) == len(words):
        return 0
    # exact ids of runs of 2, 4 and 8 words: each doubles the last
    size = 1
    while size < width:
        pair = ids[:-size] * np.int64(len(ids) + 1) + ids[size:]
        _, ids, counts = np.unique(pair, return_inverse=True, return_counts=True)
        if len(counts) == len(ids):
            return 0
        size *= 2
    hit = counts[ids] > 1
    step = np.zeros(len(words) + 1, np.int64)
    at = np.nonzero(hit)[0]
    step[at] += 1
    step[at + width] -= 1
    return int((np.cumsum(step[:-1]) > 0).sum())


def base_counts(text: str) -> tuple[int, int, int, int, int]:
    """Words, code points in words, symbols, repeated lines, words in repeated windows."""
    words = text.encode().split()
    n_symbols = sum(map(text.count, SYMBOLS))
    blanks = sum(map(text.count, " \t\n\v\f\r"))
    seen: set[str] = set()
    dup = 0
    for line in text.split("\n"):
        if line in seen:
            dup += 1
        elif line.strip(" \t\n\v\f\r"):
            seen.add(line)
    return len(words), len(text) - blanks, n_symbols, dup, repeat_words(words)


def chosen_runs(n_lines: int, most: int, seed: int) -> list[tuple[int, int]]:
    """Runs (start, stop) of up to RUN lines over a whole text of n_lines, of most lines in all; which ones of a longer text is up to the seed."""
    runs = [(a, min(a + RUN, n_lines)) for a in range(0, n_lines, RUN)]
    least = max(1, most // RUN)
    if len(runs) > least:
        runs = [runs[k] for k in sorted(np.random.default_rng(seed % 2**63).choice(len(runs), least, replace=False).tolist())]
    return runs


def word_lines(text: str) -> list[tuple[str, list[bytes]]]:
    """The lines that have words, with these."""
    return [(line, words) for line in text.split("\n") if (words := line.encode().split())]


def neighbours(lines: list[tuple[str, list[bytes]]], hashes: list[int], k: int) -> int:
    """One of 61 bits for the lines before and after line k."""
    before, after = hashes[k - 1] if k else 0, hashes[k + 1] if k + 1 < len(hashes) else 0
    return 1 << (before * 31 + after) % 61


def hash_of(line: str) -> int:
    return xxhash.xxh64_intdigest(line.encode()) >> 1


def sampled_texts(docs: DataFrame, sample_docs: int) -> DataFrame:
    """(h, text) of the sample_docs different texts with the smallest hashes of id and text.

    Only rows whose hash lies under a bound that ten times as many are expected under are sorted.
    """
    texts = docs.where("text is not null").select(F.xxhash64("doc_id", "text").alias("h"), "text")
    n = texts.count()
    low = texts.where(F.col("h") <= (2**64 - 1) * min(n, 10 * sample_docs) // max(1, n) - 2**63).dropDuplicates(["h"])
    return stage(low.orderBy("h").limit(sample_docs), "quality-sample")


def sampled_lines(sample: DataFrame, lines_per_text: int, frequent: np.ndarray) -> list[list[tuple[int, int, int, int]]]:
    """Runs of (features, words, frequent words with letters, hash) of lines of the sample; frequent tells for each bucket of words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            for h, text in zip(batch.column("h").to_pylist(), batch.column("text").to_pylist(), strict=True):
                lines, masks = word_lines(text), line_features(text.split("\n"))
                for a, b in chosen_runs(len(lines), lines_per_text, h & 2**63 - 1):
                    rows = [(m, n, int(frequent[buckets([x for x in w if any(map(str.isalpha, x.decode()))])].sum()), hash_of(line)) for (line, w), (m, n) in zip(lines[a:b], masks[a:b], strict=True)]
                    yield pa.RecordBatch.from_pydict({"h": pa.array([h], pa.int64()), "at": pa.array([a], pa.int64())} | {c: pa.array([v], pa.list_(pa.int64())) for c, v in zip(("masks", "n", "f", "lines"), zip(*rows, strict=True), strict=True)})

    rows = sample.mapInArrow(run, "h long, at long, masks array<long>, n array<long>, f array<long>, lines array<long>").collect()
    return [list(zip(r["masks"], r["n"], r["f"], r["lines"], strict=True)) for r in sorted(rows, key=lambda r: (r["h"], r["at"]))]


def buckets(words) -> np.ndarray:
    return np.fromiter(map(zlib.crc32, words), np.uint32, len(words)) & np.uint32((1 << WORD_BITS) - 1)


def corpus_counts(docs: DataFrame, wanted: set[int]) -> tuple[np.ndarray, int, dict[int, tuple[int, int]]]:
    """Over all documents: how many have each bucket of words, how many have words, and (documents, different neighbours) of each wanted line."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, n = np.zeros((1, 1 << WORD_BITS), np.int64), 0
        found: dict[int, list[int]] = {}
        for batch in slices(batches):
            for text in batch.column("text").to_pylist():
                words = set((text or "").encode().split())
                if not words:
                    continue
                n += 1
                total[0, np.unique(buckets(words))] += 1
                lines = word_lines(text)
                hashes = [hash_of(line) for line, _ in lines]
                for h in wanted.intersection(hashes):
                    one = found.setdefault(h, [0, 0])
                    one[0] += 1
                    one[1] |= neighbours(lines, hashes, hashes.index(h))
        if n:
            parts = pieces(total)
            none = [None] * PIECES
            yield pa.RecordBatch.from_pydict({**parts, "line": none, "n": [n, *none[1:]], "bits": none}, schema=schema)
        if found:
            lost = [None] * len(found)
            yield pa.RecordBatch.from_pydict({"piece": lost, "counts": lost, "line": list(found), "n": [v[0] for v in found.values()], "bits": [v[1] for v in found.values()]}, schema=schema)

    schema = pa.schema([("piece", pa.int32()), ("counts", pa.binary()), ("line", pa.int64()), ("n", pa.int64()), ("bits", pa.int64())])
    gathered = stage(docs.select("text").mapInArrow(run, "piece int, counts binary, line long, n long, bits long"), "quality-counts")
    counted = gathered.where("piece is not null")
    df = joined(counted.select("piece", "counts").groupBy("piece").applyInArrow(add_pieces, "piece int, counts binary").collect(), 1, WORD_BITS)[0]
    lines = gathered.where("line is not null").groupBy("line").agg(F.sum("n").alias("n"), F.expr("bit_or(bits)").alias("bits")).collect()
    return df, counted.agg(F.sum("n")).first()[0] or 0, {r["line"]: (r["n"], r["bits"].bit_count()) for r in lines}


def seeded(docs: DataFrame, sample_docs: int = 300, lines_per_text: int = 400) -> list[list[tuple[int, int]]]:
    """Sequences of (features, seed label) of lines of at most sample_docs texts, of each at most lines_per_text lines from all over it.

    The signals of the seed labels are counted over all documents.
    """
    sample = sampled_texts(docs, sample_docs)
    wanted = {line for one in sampled_lines(sample, lines_per_text, np.zeros(1 << WORD_BITS, bool)) for *_, line in one}
    df, n_docs, repeats = corpus_counts(docs, wanted)
    runs = sampled_lines(sample, lines_per_text, df >= max(2, FREQUENT * n_docs))
    usual = sum(f for one in runs for _, _, f, _ in one) / max(1, sum(n for one in runs for _, n, _, _ in one))
    return [[(mask, seed_label(n, f, usual, *repeats.get(line, (0, 0)))) for mask, n, f, line in one] for one in runs]


def train(docs: DataFrame, sample_docs: int = 300, lines_per_text: int = 400) -> LineField:
    """Fit the field on the lines that seeded() gives."""
    return LineField(seeded(docs, sample_docs, lines_per_text))


class Judge:
    """The rules' counts and the verdict on a text."""

    def __init__(self, field: LineField, least_content: float, min_words: int, most_repeated: int):
        self.score, self.moves = field.scorer(), field.moves.tolist()
        self.least_content, self.min_words, self.most_repeated = least_content, min_words, most_repeated

    def failed(self, n: int, repeated: int) -> bool:
        return n < self.min_words or 100 * repeated > self.most_repeated * n

    def content_words(self, text: str) -> int:
        lines = line_features(text.split("\n"))
        labels = viterbi([m for m, _ in lines], self.score, self.moves)
        return sum(w for (_, w), label in zip(lines, labels, strict=True) if label)

    def keeps(self, text: str | None) -> bool:
        words = (text or "").encode().split()
        return not self.failed(len(words), repeat_words(words)) and self.content_words(text) >= self.least_content * len(words)


def judge(docs: DataFrame, field: LineField | None = None, least_content: float = LEAST_CONTENT, min_words: int = MIN_WORDS, most_repeated: int = MOST_REPEATED) -> DataFrame:
    """One row for each row of docs (doc_id, text), with the rules' counts and the verdict.

    A null text has no words, so it fails. base_failed: under min_words words, or over most_repeated
    percent of them in repeated windows. kept: not base_failed, and at least least_content of the words
    in lines that the field labels content. Null and repeated doc_ids give a row each; an empty table
    gives no rows. docs may hold other columns; they are not looked at.
    """
    field = field or train(docs)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Judge(field, least_content, min_words, most_repeated)
        for batch in slices(batches):
            rows = []
            for text in batch.column("text").to_pylist():
                counts = base_counts(text or "")
                failed, content = own.failed(counts[0], counts[4]), own.content_words(text or "")
                rows.append((*counts, failed, not failed and content >= least_content * counts[0], content))
            cols = list(zip(*rows, strict=True))
            kinds = [pa.int64()] * 5 + [pa.bool_()] * 2 + [pa.int64()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *[pa.array(c, k) for c, k in zip(cols, kinds, strict=True)]], ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "content_words"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, content_words long")


def keep_good(docs: DataFrame, field: LineField | None = None, least_content: float = LEAST_CONTENT, min_words: int = MIN_WORDS, most_repeated: int = MOST_REPEATED) -> DataFrame:
    """The rows of docs that judge() keeps, with all their columns."""
    field = field or train(docs)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Judge(field, least_content, min_words, most_repeated)
        for batch in slices(batches):
            yield batch.filter(pa.array(map(own.keeps, batch.column("text").to_pylist()), pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(table(spark, sf_dir, "documents"))
