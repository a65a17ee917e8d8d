import json

import pytest
from pyspark.sql import functions as F

from lacquer.cli import main
from lacquer.plans import evaluate, generate
from lacquer.sources import benchmark
from lacquer.sources.scratch import stage


@pytest.fixture(scope="module")
def sets(spark):
    clean, dirty = generate.build(spark, 40)
    return stage(clean, "test-clean"), stage(dirty, "test-dirty")


def test_sets_are_whole(sets):
    clean, dirty = sets
    counts = clean.groupBy("field").agg(F.count("*").alias("n"), F.count_distinct("value").alias("d"), F.min("id").alias("a"), F.max("id").alias("z")).collect()
    assert {(r["field"], r["n"], r["d"], r["a"], r["z"]) for r in counts} == {(f, 40, 40, f"{f}-0001", f"{f}-0040") for f in generate.FIELDS}
    assert dirty.count() == 40 * 8 * 5 and dirty.where("value = truth").count() == 0
    splits = dirty.groupBy("field", "split").agg(F.count_distinct("id").alias("n"), F.count("*").alias("rows")).collect()
    assert {(r["split"], r["n"], r["rows"]) for r in splits} == {("heldout", 8, 40), ("train", 32, 160)}


def test_the_same_seed_gives_the_same_values(spark, sets):
    again = generate.clean_values(spark.newSession(), 40)
    assert {tuple(r) for r in again.select("id", "value").collect()} == {tuple(r) for r in sets[0].select("id", "value").collect()}


def test_clean_values_stay_and_lossless_variants_come_back(sets):
    clean, dirty = sets
    same = stage(evaluate.scored(clean.withColumn("truth", F.col("value"))), "test-same")
    assert same.where("NOT ok OR confidence <> 0.95").count() == 0
    found = evaluate.summary(stage(evaluate.scored(dirty), "test-scored"))
    cells = found["by_field_perturbation"]
    for field in generate.FIELDS:
        for kind in ("space", "sep", "noise"):
            assert cells[field][kind]["rate"] == (0.0 if (field, kind) == ("email", "sep") else 1.0), (field, kind)
    for field in ("phone", "amount", "idcard"):
        assert found["by_field"][field]["rate"] == 1.0
    assert cells["person"]["abbrev"]["correct"] == cells["email"]["abbrev"]["correct"] == 0
    assert found["total"]["total"] == 1600 and "100.00%" in evaluate.summary_table(found)


def test_error_pairs_against_all_pairs(spark):
    rows = [(i, f"id{i * 7 % 5}", "person", f"v{i}", i * 3 % 4) for i in range(40)]
    df = spark.createDataFrame(rows, "_pos long, id string, field string, value string, _group int")
    found = [tuple(r) for r in evaluate.error_pairs(df, 25).select("type", "a", "b").orderBy("type", "a", "b").collect()]
    pairs = [(x, y) for x in rows for y in rows if x[0] < y[0]]
    missed = sorted((x[0], y[0]) for x, y in pairs if x[1] == y[1] and x[4] != y[4])[:25]
    wrong = sorted((x[0], y[0]) for x, y in pairs if x[4] == y[4] and x[1] != y[1])[:25]
    assert found == [("missed", *p) for p in missed] + [("wrong_merge", *p) for p in wrong]


def test_bad_sets(spark, tmp_path):
    def put(folder, rows):
        (tmp_path / folder).mkdir(exist_ok=True)
        (tmp_path / folder / "person.jsonl").write_text("".join(json.dumps(r) + "\n" for r in rows))
        return f"file://{tmp_path / folder}"

    row = {"id": "a", "field": "person", "value": "x", "truth": "y", "perturbation": "typo", "split": "train"}
    clean = put("clean", [{k: row[k] for k in ("id", "field", "value")}])
    load = lambda dirty, split="train": benchmark.load_pairs(spark, clean, dirty, split, ("person",))
    assert [tuple(r) for r in load(put("d0", [row])).orderBy("_pos").select("_pos", "kind").collect()] == [(0, "clean"), (1, "dirty")]
    for name, rows, message in (("d1", [row, {**row, "split": "heldout"}], "splits"), ("d2", [{**row, "id": "b"}], "no dirty rows"), ("d3", [], "empty")):
        with pytest.raises(ValueError, match=message):
            load(put(name, rows))
    with pytest.raises(ValueError, match="no rows"):
        load(put("d4", [row]), "heldout")
    with pytest.raises(ValueError, match="split"):
        benchmark.load_dirty(spark, clean, "test")


def test_benchmark_commands(spark, tmp_path):
    out, results = tmp_path / "sets", tmp_path / "results"
    assert main(["generate", "--per-field", "10", "--out", str(out)], spark) == 0
    assert len((out / "clean" / "person.jsonl").read_text().splitlines()) == 10
    first = json.loads((out / "dirty" / "phone.jsonl").read_text().splitlines()[0])
    assert list(first) == ["id", "field", "value", "truth", "perturbation", "split"] and first["perturbation"] == "space"
    assert main(["evaluate", "--impl", "perfect", "--split", "all", "--dirty-dir", str(out / "dirty"), "--out", str(results)], spark) == 0
    assert json.loads((results / "summary-perfect-all.json").read_text())["total"] == {"correct": 400, "total": 400, "rate": 1.0}
    assert (results / "failures-perfect-all.jsonl").read_text() == ""
    assert main(["evaluate-dedupe", "--adaptive", "--clean-dir", str(out / "clean"), "--dirty-dir", str(out / "dirty"), "--out", str(results)], spark) == 0
    found = json.loads((results / "dedupe-summary-heldout.json").read_text())
    assert found["rows"] == 2 * 6 * 4 and found["true_groups"] == 8 and found["total"]["true_pairs"] == 8 * 15
    assert main(["evaluate", "--dirty-dir", str(tmp_path / "none"), "--out", str(results)], spark) == 1
