"""Duplicate groups: values that are not text, links, rules and their validation."""

import json

import pytest
from pyspark.sql import functions as F

from lacquer.functions import similarity
from lacquer.operators import dedupe, tables
from lacquer.sources import files


def parsed(spark, rows):
    lines = spark.createDataFrame([(k, json.dumps(r, ensure_ascii=False)) for k, r in enumerate(rows)], "k long, value string").orderBy("k").select("value")
    return files.parsed_rows(files.numbered_lines(lines.coalesce(1))).withColumn("_pos", F.col("line") - 1)


def groups(spark, values, field="other", **options):
    rows = spark.createDataFrame([(k, field, v) for k, v in enumerate(values)], "_pos long, field string, value string")
    return [r["_group"] for r in dedupe.dedupe(rows, **options).orderBy("_pos").collect()]


def test_values_that_are_not_text(spark):
    values = [13800138000, 13900139000, None, None, 1, 1.0, True, 0, False, [1], [1], {"a": 1}, {"a": 1}, 13800138000, "1", 2.50, 2.5, 1e300, 1e300]
    rows = parsed(spark, [{"field": "phone", "value": v} for v in values])
    found = [r["_group"] for r in dedupe.dedupe_exact(rows).orderBy("_pos").collect()]
    want, keys = [], {}
    for k, v in enumerate(values):
        key = k if isinstance(v, (list, dict)) else ("text", v) if isinstance(v, str) else ("other", v)
        want.append(keys.setdefault(key, len(keys)))
    assert found == want
    assert [r["_group"] for r in dedupe.dedupe_adaptive(rows).orderBy("_pos").collect()] == want
    s = dedupe.group_statistics(dedupe.dedupe_exact(rows)).first()
    assert (s["rows"], s["removable"]) == (len(values), len(values) - len(keys))


def test_nulls_without_json_are_one_group(spark):
    assert groups(spark, [None, "a", None], exact_only=True) == [0, 1, 0]


def test_threshold_bounds(spark):
    assert groups(spark, ["abcd", "abce", "zzzz"], threshold=0.75) == [0, 0, 1]
    assert groups(spark, ["abcd", "abce", "zzzz"], threshold=0.76) == [0, 1, 2]
    assert groups(spark, ["abcd", "zzzz", "abcd"], threshold=1) == [0, 1, 0]
    assert groups(spark, ["abcd", "zzzz", "y"], threshold=0) == [0, 0, 0]
    for bad in (1.1, -0.1, float("nan")):
        with pytest.raises(ValueError):
            dedupe.checked_threshold(bad)
    for bad in (True, "0.5", None):
        with pytest.raises(TypeError):
            dedupe.checked_threshold(bad)
    assert dedupe.checked_threshold(1) == 1.0 and isinstance(dedupe.checked_threshold(0), float)


def test_null_fields_are_one_field(spark):
    rows = spark.createDataFrame([(0, None, "abcd"), (1, "x", "abcd"), (2, None, "abce"), (3, None, "abcd"), (4, "x", None), (5, None, None)], "_pos long, field string, value string")
    assert [r["_group"] for r in dedupe.dedupe(rows, 0.7).orderBy("_pos").collect()] == [0, 1, 0, 0, 2, 3]
    assert [r["_group"] for r in dedupe.dedupe(rows, 0.7, dedupe.ADAPTIVE).orderBy("_pos").collect()] == [0, 1, 0, 0, 2, 3]


def test_best_links_and_ties(spark):
    # the middle value is as near to either neighbour, so it links to neither; each of these links to it
    rule = lambda link: {"other": {"scorer": similarity.ratio, "threshold": 0.5, "link": link}}
    assert groups(spark, ["abcd", "abcx", "abcy"], overrides=rule("all")) == [0, 0, 0]
    assert groups(spark, ["abcd", "abcx", "abcy"], overrides=rule("best")) == [0, 1, 2]
    assert groups(spark, ["abcdef", "abcdeg", "abcxyz"], overrides=rule("best")) == [0, 0, 1]


def test_adaptive_rules(spark):
    assert groups(spark, ["范童言", "范童", "李童言"], field="person", overrides=dedupe.ADAPTIVE) == [0, 0, 1]
    assert groups(spark, ["嘉兴数联贸易集团有限公司", "数联贸易集团有限公司", "云图科技有限公司"], field="company", overrides=dedupe.ADAPTIVE) == [0, 0, 1]
    assert groups(spark, ["贵州省贵阳市云岩区人民路1号", "贵阳市云岩区人民路1号", "贵州省遵义市云岩区人民路9号"], field="address", overrides=dedupe.ADAPTIVE) == [0, 0, 1]
    described = dedupe.describe_adaptive()
    assert json.loads(json.dumps(described))["person"] == {"scorer": "same_initial_ratio", "threshold": 0.6, "link": "best"}
    assert set(described) == {"person", "company", "address"}


def last_letter(a, b):
    return 1.0 if a[-1] == b[-1] else 0.0


def test_a_scorer_of_ones_own(spark):
    own = {"scorer": last_letter, "threshold": 1}
    with pytest.raises(ValueError, match="block"):
        dedupe.rules_of({"other": own})
    by_end = own | {"block": lambda v: F.substring(v, -1, 1)}
    assert groups(spark, ["ax", "by", "cx", "dz"], overrides={"other": by_end}) == [0, 1, 0, 2]
    assert groups(spark, ["ax", "by", "cx", "dz"], overrides={"other": own | {"block": lambda v: F.lit(0)}}) == [0, 1, 0, 2]


@pytest.mark.parametrize(("given", "error"), [
    ([], TypeError), ({"a": 1}, ValueError), ({"a": {"scorer": similarity.ratio}}, ValueError), ({"a": {"threshold": 0.5}}, ValueError),
    ({"a": {"scorer": similarity.ratio, "threshold": 0.5, "tresh": 1}}, ValueError), ({"a": {"scorer": "x", "threshold": 0.5}}, TypeError),
    ({"a": {"scorer": similarity.ratio, "threshold": 2}}, ValueError), ({"a": {"scorer": similarity.ratio, "threshold": "x"}}, TypeError),
    ({"a": {"scorer": similarity.ratio, "threshold": 0.5, "link": "none"}}, ValueError), ({"a": {"scorer": similarity.ratio, "threshold": 0.5, "block": 3}}, TypeError),
])
def test_rules_are_checked(given, error):
    with pytest.raises(error):
        dedupe.rules_of(given)
    assert dedupe.rules_of(None) == {}


def test_column_maps_are_checked():
    assert tables.column_map(["phone", "x"]) == {"phone": "phone"} and tables.column_map(["a"], {"a": "phone"}) == {"a": "phone"}
    for bad, error in (([], TypeError), ({"a": "nothing"}, ValueError), ({"b": "phone"}, ValueError)):
        with pytest.raises(error):
            tables.column_map(["a"], bad)
