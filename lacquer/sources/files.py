"""Rows from JSON lines and cells from CSV, and both back to text."""

from __future__ import annotations

import csv
import io
import json
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .scratch import forget, scratch_path, with_positions

BOM = "﻿"


class SourceError(ValueError):
    """Input that can't be read as asked; the message names the line, counted from 1."""


#: Where a piece of text stands: Spark reads large files first, whatever their names.
PLACE = ("_file", "_block")


def text_lines(spark: SparkSession, path: str, whole: bool = False) -> DataFrame:
    """The lines (value) of a file or of a folder of files, or whole files, with their PLACE."""
    return spark.read.text(path, wholetext=whole).select("value", F.col("_metadata.file_path").alias("_file"), F.col("_metadata.file_block_start").alias("_block"))


def numbered_lines(lines: DataFrame) -> DataFrame:
    """lines (value) with `line`, from 1, in the order of their PLACE if they have one, without a byte-order mark at the start."""
    at = with_positions(lines, "line", tuple(c for c in PLACE if c in lines.columns))
    return at.select((F.col("line") + 1).alias("line"), F.when(F.col("line") == 0, F.regexp_replace("value", f"^{BOM}", "")).otherwise(F.col("value")).alias("raw"))


def parsed_rows(lines: DataFrame) -> DataFrame:
    """(line, raw, id, field, value, is_object, has_field, has_value) of JSON lines (line, raw); blank lines are left out.

    value is null unless it is a string; value_json has it as JSON text whatever it is.
    """
    v = F.try_parse_json("raw")
    at = lines.where(F.trim(F.regexp_replace("raw", r"\s", " ")) != "").withColumn("_v", v)
    kind = F.schema_of_variant("_v")
    at = at.withColumns({"is_object": F.coalesce(kind.startswith("OBJECT"), F.lit(False))})
    inner = {k: F.when(F.col("is_object"), F.try_variant_get("_v", f"$.{k}", "variant")) for k in ("field", "value")}
    at = at.withColumns({f"_{k}": x for k, x in inner.items()})
    text = {k: F.when(F.schema_of_variant(f"_{k}") == "STRING", F.try_variant_get("_v", f"$.{k}", "string")) for k in ("field", "value")}
    ident = F.when(F.col("is_object"), F.try_variant_get("_v", "$.id", "string"))
    return at.select("line", "raw", ident.alias("id"), text["field"].alias("field"), text["value"].alias("value"), F.to_json("_value").alias("value_json"), F.col("_v").isNotNull().alias("is_json"), "is_object", F.col("_field").isNotNull().alias("has_field"), F.col("_value").isNotNull().alias("has_value"))


def checked(rows: DataFrame, need_field: bool = True) -> DataFrame:
    """rows, if all are objects with value (and field); else SourceError for the first that is not."""
    wrong = F.when(~F.col("is_json"), "is not valid JSON").when(~F.col("is_object"), "is not a JSON object")
    if need_field:
        wrong = wrong.when(~F.col("has_field"), "has no field")
    wrong = wrong.when(~F.col("has_value"), "has no value")
    first = rows.withColumn("wrong", wrong).where("wrong IS NOT NULL").orderBy("line").select("line", "wrong").first()
    if first:
        raise SourceError(f"line {first[0]} {first[1]}")
    return rows


def read_rows(spark: SparkSession, path: str, need_field: bool = True) -> DataFrame:
    """Rows of a JSON lines file with _pos, their dense position; fails at the first bad line."""
    rows = checked(parsed_rows(numbered_lines(text_lines(spark, path))), need_field)
    return with_positions(rows.orderBy("line"), "_pos")


def json_text(value: Column) -> Column:
    """A value as JSON text; a null is null."""
    return F.regexp_extract(F.to_json(F.array(value), {"ignoreNullFields": "false"}), r"(?s)^\[(.*)\]$", 1)


def json_value(value: Column, value_json: Column) -> Column:
    """The JSON text of a text column, or of what stands in its place if it is null."""
    return F.when(value.isNull(), F.coalesce(value_json, F.lit("null"))).otherwise(json_text(value))


def spliced(raw: Column, **added: Column) -> Column:
    """The JSON object of a line with keys set to values, given as JSON text: in place if it has them, else at its end in order.

    All else stands as it does in a line that has none of the keys; a line that has one is written anew.
    """
    tail = F.concat_ws(", ", *[F.concat(F.lit(json.dumps(k, ensure_ascii=False) + ": "), v) for k, v in added.items()])
    head = F.regexp_replace(raw, r"\s*\}\s*\z", "")
    plain = F.concat(head, F.when(head.rlike(r"^\s*\{\s*\z"), "").otherwise(", "), tail, F.lit("}"))
    entries = F.map_entries(F.from_json(raw, "map<string,variant>"))
    new = F.create_map(*[x for k, v in added.items() for x in (F.lit(k), v)])
    there = F.transform(entries, lambda e: F.concat(json_text(e["key"]), F.lit(": "), F.coalesce(F.element_at(new, e["key"]), F.to_json(e["value"]))))
    names = F.transform(entries, lambda e: e["key"])
    late = F.transform(F.filter(F.map_entries(new), lambda e: ~F.array_contains(names, e["key"])), lambda e: F.concat(json_text(e["key"]), F.lit(": "), e["value"]))
    again = F.concat(F.lit("{"), F.array_join(F.concat(there, late), ", "), F.lit("}"))
    has = F.exists(F.json_object_keys(raw), lambda k: k.isin(list(added)))
    return F.when(has, again).otherwise(plain)


def read_cells(spark: SparkSession, path: str, multiline: bool = False) -> tuple[list[str], DataFrame]:
    """Header and rows (_pos, cells) of a CSV file; rows of blank cells are left out, ragged ones kept.

    Lines are parsed in parallel. Cells with line breaks need multiline, which parses each file by one
    task.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, of = [], []
            for k, text in enumerate(batch.column("value").to_pylist()):
                found = [r for r in csv.reader(io.StringIO((text or "").removeprefix(BOM), newline="")) if any(c.strip() for c in r)]
                rows += found
                of += [k] * len(found)
            at = pa.array(of, pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(rows, pa.list_(pa.string())), *[batch.column(c).take(at) for c in PLACE]], ["cells", *PLACE])

    lines = text_lines(spark, path, multiline)
    rows = with_positions(lines.mapInArrow(run, "cells array<string>, _file string, _block long"), "_pos", PLACE)
    first = rows.where("_pos = 0").first()
    return (list(first["cells"]) if first else []), rows.where("_pos > 0").withColumn("_pos", F.col("_pos") - 1)


def csv_line(cells: Column) -> Column:
    """A row as CSV text: cells with a quote, comma or line break are quoted; a lone empty cell is quoted too."""
    quoted = F.transform(cells, lambda c: F.when(c.rlike('[",\r\n]'), F.concat(F.lit('"'), F.replace(c, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(c))
    line = F.array_join(quoted, ",")
    return F.when((F.size(cells) == 1) & (line == ""), F.lit('""')).otherwise(line)


def write_lines(lines: DataFrame, path: str, by: str = "_pos") -> None:
    """The column `text` as a folder of text files whose names follow the order of `by`."""
    lines.orderBy(by).select("text").write.text(path)


def parts_of(spark: SparkSession, lines: DataFrame, by: str = "_pos") -> Iterator[str]:
    """The column `text` in the order of `by`, as pieces of text of whole lines; tasks format and order it, and the pieces pass one at a time."""
    path = scratch_path(spark, "lines")
    write_lines(lines, path, by)
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = at.getFileSystem(spark._jsc.hadoopConfiguration())
    names = sorted(f.getPath().getName() for f in fs.listStatus(at) if f.getPath().getName().startswith("part-"))
    for name in names:
        reader = spark._jvm.java.io.BufferedInputStream(fs.open(spark._jvm.org.apache.hadoop.fs.Path(at, name)))
        rest = b""
        while chunk := bytes(reader.readNBytes(1 << 20)):
            whole, found, rest = (rest + chunk).rpartition(b"\n")
            yield (whole + found).decode()
        reader.close()
        if rest:
            yield rest.decode()
    forget(spark, path)
