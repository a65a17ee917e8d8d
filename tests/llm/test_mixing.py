"""Mixing with other columns: reruns agree, ties, repeated rows and names that clash."""

from collections import Counter, defaultdict

from lacquer.llm import mixing

SCHEMA = "doc_id long, text string, source string, size string, `key` int, taken string, `range` int, target string"


def rows():
    out = [(k, "w " * (k % 7 + 1), "abc"[k % 3], "s", k, "t", 1, "x") for k in range(60)]
    # equal in doc_id and size with other texts; equal in all columns; nulls and empty texts
    out += [(5, "q " * 6, "c", "s", 1, "t", 1, "x"), (5, "r " * 6, "c", "s", 2, "t", 1, "x")]
    out += [(7, "y y y", "b", None, 3, None, None, None)] * 4 + [(None, "n n", "a", None, None, None, None, None)] * 2
    return out + [(80, None, "a", "s", 1, "t", 1, "x"), (81, "", None, "s", 1, "t", 1, "x"), (82, "one two three", None, "s", 1, "t", 1, "x")]


def test_columns_are_kept_and_reruns_agree(spark):
    docs = spark.createDataFrame(rows(), SCHEMA)
    found = [Counter(map(tuple, mixing.with_taken(d, rows_per_range=7).collect())) for d in (docs, docs.repartition(5), docs.orderBy("text"))]
    assert found[0] == found[1] == found[2] and sum(found[0].values()) == len(rows())
    out = mixing.with_taken(docs)
    assert out.columns == ["doc_id", "text", "source", "key", "range", "size", "source_size", "target", "taken"]
    sizes, targets, taken = defaultdict(int), {}, defaultdict(int)
    for r in out.collect():
        assert r["size"] == len((r["text"] or "").split()) and 0 <= r["taken"] <= 3 * r["size"]
        sizes[r["source"]] += r["size"]
        targets[r["source"]], taken[r["source"]] = (r["source_size"], r["target"]), taken[r["source"]] + r["taken"]
    assert all(targets[s][0] == sizes[s] and taken[s] == int(targets[s][1]) for s in sizes)


def test_the_same_words_are_taken_with_and_without_other_columns(spark):
    docs = spark.createDataFrame(rows(), SCHEMA).dropDuplicates(["doc_id"])
    plain = Counter(map(tuple, mixing.mix_sources(docs).collect()))
    assert plain == Counter(map(tuple, mixing.with_taken(docs).select("doc_id", "size", "source_size", "target", "taken").collect()))


def test_empty_tables(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert mixing.with_taken(none).count() == mixing.mix_sources(none).count() == 0
    silent = spark.createDataFrame([(1, "", "a"), (2, None, "b")], "doc_id long, text string, source string")
    assert {(r["size"], r["taken"]) for r in mixing.with_taken(silent).collect()} == {(0, 0)}
