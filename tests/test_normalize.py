import pytest

from lacquer.functions import dictionaries as d
from lacquer.functions import similarity
from lacquer.operators import audit, dedupe, routing, tables
from lacquer.operators.normalize import normalize_rows

GOLDEN = """person|王　小明|王小明|0.9
person|李至钢|李志刚|0.7
person|范童|范童|0.95
phone|8615745524079|15745524079|0.9
phone|1574S524079|15745524079|0.7
phone|12745524079|12745524079|0.1
company|焦作嘉禾智能股份公司|焦作嘉禾智能股份有限公司|0.7
company|焦作嘉禾智能有限责任工司|焦作嘉禾智能有限责任公司|0.7
company|焦作嘉禾智能|焦作嘉禾智能|0.1
address|贵州贵阳城关区建设路596号|贵州省贵阳市城关区建设路596号|0.7
address|湖北省武汉市江北曲人民路758号|湖北省武汉市江北区人民路758号|0.7
address|云南省曲靖市南区世纪大道1号|云南省曲靖市南区世纪大道1号|0.95
address|香港特别行政曲城东区1号|香港特别行政区城东区1号|0.7
address|贵州省贵阳市建设路1号2式|贵州省贵阳市建设路1号2室|0.7
address|地址：贵州省 贵阳市建设路1号（收货）|贵州省贵阳市建设路1号|0.9
amount|12，800元|12800元|0.9
amount|2.0001万元|20001元|0.7
amount|12元3角|12元3角|0.1
amount|1.28万元|12800元|0.7
amount|l.28万元|l.28万元|0.1
amount|128S元|1285元|0.7
date|2026-1-5|2026-01-05|0.9
date|2026-10-0T|2026-10-07|0.7
date|1969-01-01|1969-01-01|0.1
date|2026/01/05|2026-01-05|0.9
date|2026-01-05|2026-01-05|0.95
idcard|1160471988-05-081999|116047198805081999|0.9
idcard|116047880508199|116047198805081999|0.7
idcard|116047198805081998|116047198805081998|0.1
email|um7dy@h0tmail.com|um7dy@hotmail.com|0.7
email|a232zx_b3s@139.com|a232zx_b3s@139.com|0.95
email|a@@b.com|a@@b.com|0.1
email|Email: a1@gmail.com|a1@gmail.com|0.9
email|a1@gmail.c0m|a1@gmail.com|0.7
email|a1 @13g.com|a1@13g.com|0.9
email|a1@13g.com|a1@136.com|0.7
other|随便什么|随便什么|0.1
person|||0.1
person|王小明先生|王小明|0.9
person|欧阳娜|欧阳娜|0.95
phone|+86 157-4552-4079|15745524079|0.9"""


def test_golden_values(spark):
    rows = [tuple(x.split("|")) for x in GOLDEN.split("\n")]
    found = normalize_rows(spark.createDataFrame([(i, r[0], r[1]) for i, r in enumerate(rows)], "i long, field string, value string")).collect()
    for r in found:
        assert (r["normalized"], r["confidence"]) == (rows[r["i"]][2], float(rows[r["i"]][3])), rows[r["i"]]


def test_all_city_names_are_known(spark):
    """Of the provinces that had few names: regions completed, and typos repaired in them."""
    want = {
        "四川绵阳涪城区长虹路1号": "四川省绵阳市涪城区长虹路1号", "内蒙古包头昆都仑区1号": "内蒙古自治区包头市昆都仑区1号", "贵州遵义红花岗区1号": "贵州省遵义市红花岗区1号",
        "广西壮族自治区柳洲市城中区1号": "广西壮族自治区柳州市城中区1号", "广西壮族自治区钦洲市钦南区1号": "广西壮族自治区钦州市钦南区1号",
    }
    rows = normalize_rows(spark.createDataFrame([("address", v) for v in want], "field string, value string")).collect()
    assert {r["value"]: (r["normalized"], r["confidence"]) for r in rows} == {v: (w, 0.7) for v, w in want.items()}
    assert len(d.CITIES) == 345


def test_null_is_not_text(spark):
    r = normalize_rows(spark.createDataFrame([("phone", None)], "field string, value string")).first()
    assert r["normalized"] is None and r["confidence"] == 0.0


def lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        last = 0
        for j, y in enumerate(b):
            last, row[j + 1] = row[j + 1], last + 1 if x == y else max(row[j + 1], row[j])
    return row[-1]


@pytest.mark.parametrize("pair", [("范童言", "范童"), ("abcabba", "cbabac"), ("", "a"), ("a", "a")])
def test_common_length(pair):
    assert similarity.common_length(*pair) == lcs(*pair)


def test_groups(spark):
    values = [("person", "王小明"), ("person", "王 小明"), ("company", "华为"), ("person", "华为"), ("x", "ABCDEFGHIJ"), ("x", "ABCDEFGHIX"), ("x", "ABCDEFGHYX"), ("x", None), ("x", None)]
    rows = spark.createDataFrame([(i, *v) for i, v in enumerate(values)], "_pos long, field string, value string")
    assert [r["_group"] for r in dedupe.dedupe(rows, 0.9).orderBy("_pos").collect()] == [0, 0, 1, 2, 3, 3, 3, 4, 4]
    with pytest.raises(ValueError):
        dedupe.dedupe(rows, 1.5)
    with pytest.raises(TypeError):
        dedupe.dedupe(rows, True)


def test_report_and_rollback(spark):
    rows = spark.createDataFrame([(0, "a", "phone", "+8615745524079"), (1, "b", "phone", "15745524079"), (2, "c", "phone", "x")], "_pos long, id string, field string, value string")
    found = audit.report(rows, most=1)
    assert (found["total"], found["changed"], found["truncated"]) == (3, 1, False)
    assert found["by_confidence"] == {"0.95": 1, "0.9": 1, "0.7": 0, "0.1": 1, "other": 0}
    cleaned = audit.apply(rows)
    mark = audit.checksum(rows, cleaned)
    assert audit.rollback(cleaned, rows, mark).count() == 3
    with pytest.raises(ValueError):
        audit.rollback(cleaned.limit(2), rows, mark)


def test_routing(spark):
    rows = spark.createDataFrame([(0, "phone", "15745524079"), (1, "phone", "x"), (2, "", "x"), (3, "phone", "y")], "_pos long, field string, value string")
    assert [r["bucket"] for r in routing.route(rows).orderBy("_pos").collect()] == ["cleaned", "unchanged", "errors", "unchanged"]
    asked = routing.route(rows, llm_fn=lambda v, f: (v + "!", 0.85), llm_max_calls=1).orderBy("_pos").collect()
    assert [(r["bucket"], r["value"]) for r in asked] == [("cleaned", "15745524079"), ("cleaned", "x!"), ("errors", "x"), ("hitl", "y")]


def test_ragged_table(spark):
    rows = spark.createDataFrame([(0, ["范童言", "13800138000", "over"]), (1, ["范 童言"]), (2, ["孟露峰", "13800138000"])], "_pos long, cells array<string>")
    out = tables.clean_table(rows, ["person", "phone"], dedupe=True)
    assert [r["_pos"] for r in out["rows"].orderBy("_pos").collect()] == [0, 2]
    assert out["changed_cells"] == 1 and out["report"]["dedupe"]["removed"] == 1
