"""Archives and their index: round trips of odd pages, and look-ups against a plain table."""

import base64
import hashlib
from collections import Counter

import pytest

from lacquer.llm import warc

SCHEMA = "page_id long, url string, html string, `key` string, file string, offset string, length int, digest string, sha1 string, payload string, refers_to string"


def pages():
    out = [(k, f"http://host{k % 5}.example/p/{k}?q=Ä {k}", f"<p>{'text ' * (k % 4)}</p>") for k in range(40)]
    out += [(41, "https://a.example/", "x" * 3_000_000), (42, "https://a.example/long", "é" * 1_000_000), (43, "https://a.example/copy", "x" * 3_000_000)]
    out += [(3, out[3][1], out[3][2])] * 2 + [(None, None, None), (50, "", ""), (51, "::not a url::", "\r\n\r\n"), (52, "http://a.example:8080/x#y", None)]
    return [(*r, "k", "f", "o", 1, "d", "s", "p", "r") for r in out]


def want(rows):
    newest = {}
    for r in rows:
        if r[0] is not None:
            newest[r[2] or ""] = max(newest.get(r[2] or "", r[0]), r[0])
    out = Counter()
    for r in rows:
        data = (r[2] or "").encode()
        to = newest.get(r[2] or "")
        revisit = to is not None and r[0] != to
        out[r[0], len(data), base64.b32encode(hashlib.sha1(data).digest()).decode(), "revisit" if revisit else "response", to if revisit else None] += 1
    return out


def test_round_trip_of_odd_pages(spark):
    found = warc.round_trip(spark.createDataFrame(pages(), SCHEMA))
    assert found.columns == ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]
    assert Counter(map(tuple, found.collect())) == want(pages())


def test_payloads_come_back(spark):
    frame = spark.createDataFrame(pages(), SCHEMA)
    archive = warc.write_archive(frame, warc.scratch_path(spark, "warc"))
    read = warc.fetch(archive, warc.look_up(archive, warc.keys_of(frame))).where("record_type = 'response'").collect()
    assert {r["payload"].decode() for r in read} == {r[2] or "" for r in pages()}
    assert all(len(r["payload"]) == r["payload_bytes"] and warc.base32_sha1(r["payload"]) == r["payload_digest"] for r in read)


@pytest.mark.parametrize(("block_lines", "file_rows"), [(1, 3), (4, 10), (3000, 200_000)])
def test_look_ups_against_a_plain_table(spark, block_lines, file_rows):
    frame = spark.createDataFrame(pages(), SCHEMA)
    base = warc.scratch_path(spark, "warc")
    files = warc.Files(base)
    files.fs.create_dir(files.path)
    entries = warc.write_records(frame, base)
    archive = warc.Archive(base, warc.write_index(entries, base, block_lines, file_rows), entries)
    rows = entries.collect()
    asked = [(r["key"],) for r in rows] + [("",), ("zzz) 1",), ("example,host1)/p 0",), (rows[0]["key"] + "0",)]
    found = warc.look_up(archive, spark.createDataFrame(asked, "key string").distinct()).collect()
    assert Counter((r["key"], r["file"], r["offset"], r["length"]) for r in found) == Counter((r["key"], r["file"], r["offset"], r["length"]) for r in rows)


def test_damage_is_noticed():
    member = warc.write_record(1, "u", b"payload", warc.base32_sha1(b"payload"), None)
    assert warc.read_record(member)[1] == b"payload"
    wrong = warc.write_record(1, "u", b"payload", warc.base32_sha1(b"other"), None)
    with pytest.raises(ValueError, match="damaged"):
        warc.read_record(wrong)


def test_keys_sort_by_host_and_number():
    keys = [warc.capture_key(u, i) for u, i in (("http://b.a.example/", 1), ("http://a.example/z", 1), ("http://www.a.example:80/z", 10), ("HTTP://A.example/z#f", 2), ("http://a.example/z", None), ("http://a.example/z", -5))]
    assert sorted(keys) == [keys[4], keys[5], keys[1], keys[3], keys[2], keys[0]] and warc.surt("http://www.A.example:80/x?Q=1#f") == "example,a)/x?Q=1"
