import io
import json

from lacquer.cli import main


def test_round_trips(spark, tmp_path):
    source = tmp_path / "a.jsonl"
    lines = [{"id": 1, "field": "phone", "value": "+86 15745524079", "more": "x"}, {"id": 2, "field": "phone", "value": "15745524079"}]
    source.write_text("".join(json.dumps(x) + "\n\n" for x in lines), encoding="utf-8")
    out = tmp_path / "out.jsonl"
    assert main(["normalize", "--input", str(source), "--out", str(out)], spark) == 0
    found = [json.loads(x) for x in out.read_text().splitlines()]
    assert found == [{**x, "normalized": "15745524079", "confidence": c} for x, c in zip(lines, (0.9, 0.95), strict=True)]
    assert main(["dedupe", "--input", str(source), "--out", str(out)], spark) == 0
    assert [json.loads(x)["_group"] for x in out.read_text().splitlines()] == [0, 0]
    applied, back = tmp_path / "c.jsonl", tmp_path / "back.jsonl"
    assert main(["audit", "--input", str(source), "--apply", "--out", str(applied)], spark) == 0
    assert json.loads(applied.read_text().splitlines()[0]) == {**lines[0], "value": "15745524079", "_before": "+86 15745524079"}
    assert main(["audit", "--input", str(source), "--apply", "--out", str(applied)], spark) == 1
    assert main(["rollback", "--cleaned", str(applied), "--backup", str(tmp_path / "c.backup.json"), "--out", str(back)], spark) == 0
    assert [json.loads(x) for x in back.read_text().splitlines()] == lines
    sheet = tmp_path / "t.csv"
    sheet.write_text('phone,备注\n+8615745524079,"a,b"\n , \n', encoding="utf-8")
    assert main(["table", "--input", str(sheet), "--out", str(out)], spark) == 0
    assert out.read_text() == 'phone,备注\n15745524079,"a,b"\n'


def test_exit_codes(spark, tmp_path):
    bad = tmp_path / "bad.jsonl"
    bad.write_text('{"field": "phone", "value": "1"}\nnot json\n')
    assert main(["normalize", "--input", str(bad)], spark) == 1
    assert main(["normalize", "--input", str(tmp_path / "none")], spark) == 1
    assert main(["dedupe", "--input", str(bad), "--threshold", "2"], spark) == 2
    assert main([], spark) == 2


def lines(text):
    return [json.loads(x) for x in text.splitlines()]


def give(monkeypatch, text):
    monkeypatch.setattr("sys.stdin", io.TextIOWrapper(io.BytesIO(text.encode()), encoding="utf-8"))


def test_standard_input(spark, tmp_path, monkeypatch, capsys):
    give(monkeypatch, '﻿{"field":"phone","value":"+86 13800138000"}\n')
    assert main(["normalize"], spark) == 0
    assert lines(capsys.readouterr().out) == [{"field": "phone", "value": "+86 13800138000", "normalized": "13800138000", "confidence": 0.9}]
    give(monkeypatch, '{"id":"1","value":"138 0013 8000"}\n')
    assert main(["normalize", "--field", "phone", "--input", "-"], spark) == 0
    assert lines(capsys.readouterr().out)[0]["normalized"] == "13800138000"
    for flag in ([], ["--adaptive"], ["--plain"]):
        give(monkeypatch, '{"field":"person","value":"范童言"}\n{"field":"person","value":"范童"}\n')
        assert main(["dedupe", *flag], spark) == 0
        assert [r["_group"] for r in lines(capsys.readouterr().out)] == ([0, 1] if flag == ["--plain"] else [0, 0])
    give(monkeypatch, "phone,备注\n+8613800138000,x\n")
    assert main(["table"], spark) == 0
    assert capsys.readouterr().out == "phone,备注\n13800138000,x\n"
    give(monkeypatch, '{"field":"person","value":"王 小明"}\n')
    assert main(["audit"], spark) == 0 and "总行数 1" in capsys.readouterr().out
    give(monkeypatch, '{"field":"person","value":"王 小明"}\n')
    assert main(["audit", "--apply"], spark) == 1 and "--out" in capsys.readouterr().err
    assert main(["dedupe", "--adaptive", "--plain"], spark) == 2


def test_values_that_are_not_text_and_keys_that_are_there(spark, tmp_path):
    source, out = tmp_path / "a.jsonl", tmp_path / "b.jsonl"
    rows = [{"field": "phone", "value": 13800138000}, {"field": "phone", "value": None}, {"field": "phone", "value": [1, {"a": "中"}]}, {"normalized": "old", "field": "phone", "value": "138 0013 8000", "confidence": "x", "more": 1.5}]
    source.write_text("".join(json.dumps(r) + "\n" for r in rows))
    assert main(["normalize", "--input", str(source), "--out", str(out)], spark) == 0
    want = [{**r, "normalized": r["value"], "confidence": 0.0} for r in rows[:3]] + [{**rows[3], "normalized": "13800138000", "confidence": 0.9}]
    found = out.read_text()
    assert lines(found) == want and [list(r) for r in lines(found)] == [list(r) for r in want] and found.count("normalized") == 4
    # cleaned again, the line stays as it is
    assert main(["normalize", "--input", str(out), "--out", str(source)], spark) == 0
    assert lines(source.read_text()) == want


def test_the_backup_is_one_document(spark, tmp_path):
    source = tmp_path / "a.jsonl"
    rows = [{"id": 1, "field": "person", "value": "王 小明", "_before": "x"}, {"field": "person", "value": "李四"}, {"field": "phone", "value": 5}]
    source.write_text("".join(json.dumps(r, ensure_ascii=False) + "\n" for r in rows))
    assert main(["audit", "--input", str(source), "--apply"], spark) == 0
    cleaned, backup, back = tmp_path / "a.cleaned.jsonl", tmp_path / "a.cleaned.backup.json", tmp_path / "back.jsonl"
    assert lines(cleaned.read_text()) == [{"id": 1, "field": "person", "value": "王小明", "_before": "王 小明"}, *rows[1:]]
    document = json.loads(backup.read_text())
    assert document["rows"] == rows and document["checksum"]
    roll = ["rollback", "--cleaned", str(cleaned), "--backup", str(backup), "--out", str(back)]
    assert main(roll, spark) == 0 and lines(back.read_text()) == rows
    backup.write_text(json.dumps(document, ensure_ascii=False, indent=1))  # laid out anew
    assert main(roll, spark) == 0 and lines(back.read_text()) == rows
    backup.write_text(json.dumps({**document, "rows": rows[:2]}))
    assert main(roll, spark) == 1
    for bad in ("{}", "not json", '{"rows": 3, "checksum": "x"}', '{"rows": [], "checksum": "x"}'):
        backup.write_text(bad)
        assert main(roll, spark) == 1
    assert main(["rollback", "--cleaned", str(cleaned), "--backup", str(tmp_path / "none")], spark) == 1


def test_places_with_a_scheme(spark, tmp_path):
    source = tmp_path / "a.jsonl"
    source.write_text('{"field":"phone","value":"138 0013 8000"}\n')
    assert main(["normalize", "--input", source.as_uri(), "--out", (tmp_path / "out").as_uri()], spark) == 0
    assert [json.loads(r[0])["normalized"] for r in spark.read.text((tmp_path / "out").as_uri()).collect()] == ["13800138000"]
