"""Folders of files whose sizes are not in the order of their names."""

import json

from lacquer.sources import benchmark, files


def test_rows_of_a_folder_follow_the_names_of_its_files(spark, tmp_path):
    sheet, rows = tmp_path / "sheet", tmp_path / "person.jsonl"
    sheet.mkdir()
    rows.mkdir()
    for k in range(6):
        values = [f"{k}-{i}" for i in range(10**(k % 3))]
        (sheet / f"part-{k}.txt").write_text("".join(f"{v},x\n" for v in (["name"] if k == 0 else values)))
        (rows / f"part-{k}.txt").write_text("".join(json.dumps({"id": v, "field": "person", "value": v}) + "\n" for v in values))
    want = [f"{k}-{i}" for k in range(6) for i in range(10**(k % 3))]
    for multiline in (False, True):
        header, cells = files.read_cells(spark, sheet.as_uri(), multiline)
        found = sorted(cells.collect(), key=lambda r: r["_pos"])
        assert header == ["name", "x"] and [(r["_pos"], r["cells"]) for r in found] == [(i, [v, "x"]) for i, v in enumerate(want[1:])]
    assert [(r["_pos"], r["id"]) for r in files.read_rows(spark, rows.as_uri()).orderBy("_pos").collect()] == list(enumerate(want))
    sets = benchmark.read_sets(spark, tmp_path.as_uri(), benchmark.CLEAN, ("person",)).orderBy("line").collect()
    assert [(r["line"], r["id"]) for r in sets] == [(i + 1, v) for i, v in enumerate(want)]
