"""Registered queries on small tables of their own, against plain Python."""

from hashlib import md5
from itertools import combinations

from pyspark.sql import functions as F

from lacquer.functions import similarity
from lacquer.operators import dedupe
from lacquer.plans import evaluate, generate
from lacquer.plans.queries import QUERIES, SPARK, SWEEP_ROWS


def write_customers(spark, folder, first, last):
    spark.range(first, last + 1).withColumnRenamed("id", "c_custkey").write.parquet(f"file://{folder}/customer.parquet")
    return f"file://{folder}"


def test_pair_queries_take_all_customers(spark, tmp_path):
    sf_dir = write_customers(spark, tmp_path, 501, 1000)
    pairs = list(combinations(range(501, 1001), 2))
    same_id, same_value = ({(a, b) for a, b in pairs if (b - a) % n == 0} for n in (100, 150))
    found = {r["field"]: (r["tp"], r["true_pairs"], r["pred_pairs"]) for r in QUERIES["eval_pair_prf"](spark, sf_dir).collect()}
    assert found["code"] == found[None] == (len(same_id & same_value), len(same_id), len(same_value))
    errors = QUERIES["eval_error_pairs"](spark, sf_dir).collect()
    for kind, want in (("missed", same_id - same_value), ("wrong_merge", same_value - same_id)):
        rows = [r for r in errors if r["type"] == kind]
        assert sorted((r["a"], r["b"]) for r in rows) == sorted(want)[:50]
        assert all(r["value_b"] == md5(str(r["b"] % 150).encode()).hexdigest() for r in rows)


def test_the_sweep_takes_all_customers_and_the_whole_grid(spark, tmp_path):
    sf_dir = write_customers(spark, tmp_path, 200, 299)
    swept = {r["threshold"]: (r["tp"], r["true_pairs"], r["pred_pairs"]) for r in QUERIES["eval_threshold_sweep"](spark, sf_dir).collect()}
    rows = spark.sql(SWEEP_ROWS.format(**SPARK)).orderBy("_pos").collect()
    assert len({r["value"] for r in rows}) == 100
    pairs = list(combinations(range(100), 2))
    scores = {(a, b): similarity.ratio(rows[a]["value"], rows[b]["value"]) for a, b in pairs}
    true = {(a, b) for a, b in pairs if rows[a]["id"] == rows[b]["id"]}
    want = {}
    for t in evaluate.GRID:
        group = list(range(100))
        for (a, b), score in scores.items():
            if score >= t:
                group = [group[a] if g == group[b] else g for g in group]
        same = {(a, b) for a, b in pairs if group[a] == group[b]}
        want[t] = (len(same & true), len(true), len(same))
    assert swept == want and len({w[2] for w in want.values()}) == len(evaluate.GRID)


def test_plain_duplicates_take_all_customers(spark, tmp_path):
    sf_dir = write_customers(spark, tmp_path, 600, 619)
    found = QUERIES["dedupe_plain"](spark, sf_dir).orderBy("_pos").collect()
    assert [(r["_pos"], r["_group"]) for r in found] == [(k, (k - 600) // 2) for k in range(600, 620)]
    assert {r["value"].endswith("z") for r in found} == {True, False}


def test_more_rows_are_drawn_than_a_field_has_values(spark, monkeypatch):
    monkeypatch.setitem(generate.MAKERS, "date", (lambda x: [F.lit("2001"), x.number("month", 1, 12, 2), F.lit("05")], "-"))
    rows = generate.clean_values(spark, 40, fields=("phone", "date"), repeats=True).orderBy("_pos").collect()
    assert [r["id"] for r in rows] == [f"{f}-{k:04d}" for f in ("phone", "date") for k in range(1, 41)]
    assert len({r["value"] for r in rows[:40]}) == 40 and len({r["value"] for r in rows[40:52]}) == len({r["value"] for r in rows[40:]}) == 12
    clean, spoilt = generate.build(spark, 40, fields=("phone",))
    assert clean.count() == 40 and spoilt.count() == 200


def test_a_sweep_seeks_similar_values_once(spark, tmp_path, monkeypatch):
    sought, search = [], dedupe.scored_pairs
    monkeypatch.setattr(dedupe, "scored_pairs", lambda *args: sought.append(args) or search(*args))
    rows = spark.createDataFrame([(k, str(k // 2), "code", v, "train") for k, v in enumerate(("abcdefghij", "abcdefghijk", "klmnopqrst", "klmnopqrs"))], "_pos long, id string, field string, value string, split string")
    best, scores = evaluate.threshold_sweep(rows, (0.9, 0.95))
    assert best == 0.9 and len(sought) == 1 and [r["tp"] for r in scores.orderBy("threshold").collect()] == [2, 1]
