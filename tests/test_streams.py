"""Streams: the same results as on tables, first rows within a watermark, counts by window, and plans of bounded size."""

import time

from pyspark.sql import functions as F

from lacquer.operators.normalize import normalize_rows
from lacquer.streaming.normalize import changes_by_window, first_seen, normalize_stream

ROWS = [("2024-01-01 00:00:10", "phone", "+86 13800138000"), ("2024-01-01 00:00:20", "phone", "13800138000"), ("2024-01-01 00:07:00", "phone", "1380013800x"), ("2024-01-01 00:07:30", "person", "王 小明")]
SCHEMA = "at timestamp, field string, value string"


def written(spark, folder, rows=ROWS):
    spark.createDataFrame([(r[0], *r[1:]) for r in rows], "at string, field string, value string").select(F.col("at").cast("timestamp").alias("at"), "field", "value").write.parquet(f"{folder}/in")
    return spark.readStream.schema(SCHEMA).parquet(f"{folder}/in")


def result(stream, name, mode="append"):
    stream.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start().awaitTermination()
    return stream.sparkSession.table(name)


def test_rows_as_in_a_table(spark, tmp_path):
    found = result(normalize_stream(written(spark, tmp_path)), "rows_found")
    want = normalize_rows(spark.read.parquet(f"{tmp_path}/in"))
    assert sorted(map(tuple, found.select("value", "normalized", "confidence").collect())) == sorted(map(tuple, want.select("value", "normalized", "confidence").collect()))


def test_first_rows(spark, tmp_path):
    found = result(first_seen(written(spark, tmp_path), "at", "1 hour"), "first_found")
    assert sorted(r["normalized"] for r in found.collect()) == sorted(["13800138000", "1380013800x", "王小明"])


def test_changes_by_window(spark, tmp_path):
    found = result(changes_by_window(written(spark, tmp_path), "at", "10 minutes", "5 minutes"), "window_found", "complete")
    rows = sorted((str(r["window"]["start"])[11:16], r["field"], r["total"], r["changed"]) for r in found.collect())
    assert rows == [("00:00", "phone", 2, 1), ("00:05", "person", 1, 1), ("00:05", "phone", 1, 0)]


def test_filters_on_results_are_planned_quickly(spark):
    rows = spark.createDataFrame([(k, f, v) for k, (_, f, v) in enumerate(ROWS)], "k long, field string, value string")
    began = time.perf_counter()
    done = normalize_rows(rows).where("normalized <> value AND confidence > 0.5 AND length(normalized) > 2").where("k < 100")
    plan = done._jdf.queryExecution().optimizedPlan().toString()
    assert time.perf_counter() - began < 20 and "rand" not in plan
    assert done.count() == 2 and done.select("k").where("k = 0").count() == 1
