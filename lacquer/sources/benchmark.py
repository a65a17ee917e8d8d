"""Clean and dirty benchmark sets as JSON lines, a file or a folder of files for each field, in and out."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import files
from .scratch import stage, with_positions

FIELDS = ("person", "address", "phone", "company", "amount", "date", "idcard", "email")
#: The fields whose duplicates are scored.
PAIR_FIELDS = FIELDS[:4]
SPLITS = ("heldout", "train")
CLEAN = "id string, field string, value string"
DIRTY = CLEAN + ", truth string, perturbation string, split string"


def read_sets(spark: SparkSession, folder: str, schema: str, fields=FIELDS) -> DataFrame:
    """Rows of all fields' files with rank, the field's place, and line; blank lines are left out."""
    parts = []
    for rank, field in enumerate(fields):
        lines = files.numbered_lines(files.text_lines(spark, f"{folder}/{field}.jsonl")).where(F.trim("raw") != "")
        parts.append(lines.select(F.lit(rank).alias("rank"), "line", F.from_json("raw", schema).alias("row")).select("rank", "line", "row.*"))
    return reduce(DataFrame.unionByName, parts)


def load_dirty(spark: SparkSession, folder: str, split: str = "heldout") -> DataFrame:
    """(_pos, id, field, value, truth, perturbation, split) of a split, or of all, in the order of fields and lines."""
    if split not in (*SPLITS, "all"):
        raise ValueError(f"the split has to be one of {(*SPLITS, 'all')}, not {split!r}")
    rows = read_sets(spark, folder, DIRTY)
    if split != "all":
        rows = rows.where(F.col("split") == split)
    return with_positions(rows.orderBy("rank", "line")).drop("rank", "line")


def load_pairs(spark: SparkSession, clean_folder: str, dirty_folder: str, split: str = "heldout", fields=PAIR_FIELDS) -> DataFrame:
    """(_pos, id, field, value, kind, split, perturbation): the clean rows of each field, then its dirty ones, without truth.

    A clean row is in its id's split. Raises for an empty file, an id in two splits, a clean id without
    dirty rows, and a split without rows.
    """
    if split not in SPLITS:
        raise ValueError(f"the split has to be one of {SPLITS}, not {split!r}")
    clean, dirty = stage(read_sets(spark, clean_folder, CLEAN, fields), "clean-set"), stage(read_sets(spark, dirty_folder, DIRTY, fields), "dirty-set")
    for name, rows in (("clean", clean), ("dirty", dirty)):
        there = {r["rank"] for r in rows.select("rank").distinct().collect()}
        for rank, field in enumerate(fields):
            if rank not in there:
                raise ValueError(f"the {name} set of {field} is empty")
    splits = dirty.groupBy("rank", "id").agg(F.min("split").alias("split"), F.max("split").alias("other"))
    twice = splits.where("split <> other").orderBy("rank", "id").first()
    if twice:
        raise ValueError(f"id {twice['id']} is in the splits {twice['split']} and {twice['other']}")
    lone = clean.join(splits, ["rank", "id"], "left_anti").orderBy("rank", "line").first()
    if lone:
        raise ValueError(f"the clean id {lone['id']} has no dirty rows")
    none = F.lit(None).cast("string")
    plain = clean.join(splits.drop("other"), ["rank", "id"]).select("rank", F.lit(0).alias("nth"), "line", "id", "field", "value", F.lit("clean").alias("kind"), "split", none.alias("perturbation"))
    spoilt = dirty.select("rank", F.lit(1).alias("nth"), "line", "id", "field", "value", F.lit("dirty").alias("kind"), "split", "perturbation")
    out = with_positions(plain.unionByName(spoilt).where(F.col("split") == split).orderBy("rank", "nth", "line")).drop("rank", "nth", "line")
    if not out.limit(1).count():
        raise ValueError(f"there are no rows in the split {split}")
    return out


def write_sets(rows: DataFrame, folder: str, fields=FIELDS) -> None:
    """rows (_pos, id, field, value, ...) as JSON lines in the order of _pos, a folder of files for each field."""
    text = F.to_json(F.struct(*[c for c in rows.columns if c != "_pos"]), {"ignoreNullFields": "false"})
    for field in fields:
        files.write_lines(rows.where(F.col("field") == field).select("_pos", text.alias("text")), f"{folder}/{field}.jsonl")
