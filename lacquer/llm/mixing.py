"""Mixing sources to target weights, with DataFrame functions only.

Each document gets a hash-random key. Within its source the keys are cut into ranges; sums over the
ranges give each range its offset, and a window inside the range completes the prefix sum. Thus no
task holds a whole source. A source's budget is cut at exactly the word where it ends; a budget over
the source's size repeats whole epochs first.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import WORD_PATTERN, stage, table, unused

KEY_BITS = 60


def source_targets(per_source: DataFrame, weights=(1, 2, 3), max_epochs: int = 3) -> DataFrame:
    """Targets of sources; takes (source, source_size, n) with one row a source, adds sid, weight, target.

    Sources in code-point order, null last, take the weights in turn and share the sum of all sizes.
    A target stops at max_epochs times the size and its excess goes to the others by weight: that is
    one water level over weights, found by ordering the sources by the level at which they fill up.
    The windows without a key run over one row per source, never over documents: fine to some 10**5
    sources. A source's ranges are one window too, of a row for each rows_per_range documents.
    """
    in_order = Window.orderBy(F.col("source").asc_nulls_last())
    every = Window.partitionBy(F.lit(1))
    rank = F.row_number().over(in_order)
    ranked = per_source.withColumn("sid", rank).withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), ((F.col("sid") - 1) % len(weights) + 1).cast("int")).cast("long"))
    ranked = ranked.withColumn("cap", F.col("source_size") * max_epochs)
    filling = Window.partitionBy(F.lit(1)).orderBy(F.col("cap") / F.col("weight"), "sid").rowsBetween(Window.unboundedPreceding, -1)
    levels = ranked.withColumns(
        {
            "level": (F.sum("source_size").over(every) - F.coalesce(F.sum("cap").over(filling), F.lit(0))) / (F.sum("weight").over(every) - F.coalesce(F.sum("weight").over(filling), F.lit(0))),
            "at": F.row_number().over(Window.partitionBy(F.lit(1)).orderBy(F.col("cap") / F.col("weight"), "sid")),
        }
    )
    fits = F.col("level") * F.col("weight") <= F.col("cap")
    level = F.min_by(F.when(fits, F.col("level")), F.when(fits, F.col("at"))).over(every)
    return levels.withColumn("target", F.least(F.col("cap").cast("double"), level * F.col("weight"))).drop("level", "at", "cap")


def mix_sources(docs: DataFrame, weights=(1, 2, 3), max_epochs: int = 3, rows_per_range: int = 4_000, seed: str = "mix") -> DataFrame:
    """(doc_id, size, source_size, target, taken) for each row of docs (doc_id, text, source).

    taken counts the words that the mix takes from the row, repeats included: whole epochs, then the
    words before the source's cut in key order. A null text has size 0 and is taken 0 times; a null
    source is a source of its own, after the others; a null doc_id has a key of its own. Rows equal in
    doc_id are ordered by size. An empty table gives no rows.
    """
    return _taken(_sized(docs, seed), weights, max_epochs, rows_per_range).select("doc_id", "size", "source_size", "target", "taken")


def with_taken(docs: DataFrame, weights=(1, 2, 3), max_epochs: int = 3, rows_per_range: int = 4_000, seed: str = "mix") -> DataFrame:
    """docs, whatever its other columns, with size, source_size, target and taken; columns of these names are replaced.

    Budgets are cut on rows without texts, ordered by key, doc_id, size and a hash of the whole row, so
    that reruns agree however rows come in; then the texts meet the result once. Rows equal in all
    columns are as one row that is there several times: they share what is taken of them, the first ones first.
    """
    new = ("size", "source_size", "target", "taken")
    kept = [c for c in docs.columns if c.lower() not in new]
    row, of, ident, nth, first = unused(kept, "row", "of", "ident", "nth", "first")
    told = docs.withColumn(row, F.xxhash64(*[F.col(f"`{c}`") for c in docs.columns]))
    cut = stage(_taken(_sized(told, seed, F.col(row)), weights, max_epochs, rows_per_range).select(F.col("tie").alias(of), F.col("doc_id").alias(ident), *new, F.col("nth").alias(first)), "mix-cut")
    told = told.drop(*[c for c in docs.columns if c not in kept])
    same = (F.col(row) == F.col(of)) & F.col("doc_id").eqNullSafe(F.col(ident))
    if cut.where(F.col(first) > 1).limit(1).count():  # some rows are repeated; which of them is which doesn't matter
        told = told.withColumn(nth, F.row_number().over(Window.partitionBy("doc_id", row).orderBy(F.lit(0))))
        same = same & (F.col(nth) == F.col(first))
    return told.join(cut, same).select(*[F.col(f"`{c}`") for c in kept], *new)


def _sized(docs: DataFrame, seed: str, tie=None) -> DataFrame:
    """(doc_id, source, size, key, tie) of docs, without texts; staged, since all else is worked out from it."""
    key = F.conv(F.substring(F.md5(F.concat(F.lit(seed + ":"), F.coalesce(F.col("doc_id").cast("string"), F.lit("null")))), 1, KEY_BITS // 4), 16, 10).cast("long")
    size = F.coalesce(F.regexp_count("text", F.lit(WORD_PATTERN)), F.lit(0)).cast("long")
    last = F.lit(0).cast("long") if tie is None else tie
    return stage(docs.select("doc_id", "source", size.alias("size"), key.alias("key"), last.alias("tie")), "mix-sizes")


def _taken(sized: DataFrame, weights, max_epochs: int, rows_per_range: int) -> DataFrame:
    """sized rows with source_size, target, taken and nth, the number of the row among those equal to it."""
    sources = source_targets(sized.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n")), weights, max_epochs)
    sources = sources.withColumn("ranges", F.ceil(F.col("n") / rows_per_range)).withColumnRenamed("source", "of").drop("n", "weight")
    placed = sized.join(sources, F.col("source").eqNullSafe(F.col("of"))).drop("of")
    placed = placed.withColumn("range", F.floor(F.col("key") * (F.col("ranges") / F.lit(float(2**KEY_BITS)))))

    before = Window.partitionBy("sid").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = placed.groupBy("sid", "range").agg(F.sum("size").alias("held")).select("sid", "range", F.coalesce(F.sum("held").over(before), F.lit(0)).alias("offset"))

    in_order = Window.partitionBy("sid", "range").orderBy("key", "doc_id", "size", "tie")
    equal = Window.partitionBy("sid", "range", "key", "doc_id", "size", "tie").orderBy("key")
    budget = F.floor("target")
    epochs = F.when(F.col("source_size") > 0, F.floor(budget / F.col("source_size"))).otherwise(0)
    inside = F.sum("size").over(in_order.rowsBetween(Window.unboundedPreceding, -1))
    out = placed.join(offsets, ["sid", "range"]).withColumn("prefix", F.col("offset") + F.coalesce(inside, F.lit(0))).withColumn("nth", F.row_number().over(equal))
    rest = budget - epochs * F.col("source_size") - F.col("prefix")
    return out.withColumn("taken", (epochs * F.col("size") + F.greatest(F.lit(0), F.least(F.col("size"), rest))).cast("long"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_sources(table(spark, sf_dir, "documents"))


ORACLE = r"""
WITH sized AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
         ('0x' || substr(md5('mix:' || coalesce(doc_id::VARCHAR, 'null')), 1, 15))::BIGINT AS key
  FROM documents
), per_source AS (
  SELECT source, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY source COLLATE "binary" ASC NULLS LAST) AS sid
  FROM sized GROUP BY source
), weighted AS (
  SELECT *, ((sid - 1) % 3 + 1)::BIGINT AS weight, 3 * source_size AS cap FROM per_source
), levels AS (
  SELECT *,
         (sum(source_size) OVER () - coalesce(sum(cap) OVER f, 0))::DOUBLE / (sum(weight) OVER () - coalesce(sum(weight) OVER f, 0))::DOUBLE AS level,
         row_number() OVER (ORDER BY cap::DOUBLE / weight, sid) AS nth
  FROM weighted WINDOW f AS (ORDER BY cap::DOUBLE / weight, sid ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), water AS (SELECT arg_min(level, nth) AS level FROM levels WHERE level * weight <= cap),
targets AS (
  SELECT source, source_size, least(cap::DOUBLE, (SELECT level FROM water) * weight) AS target FROM levels
), cut AS (
  SELECT doc_id, size, t.source_size, target, floor(target)::BIGINT AS budget,
         CASE WHEN t.source_size > 0 THEN floor(target)::BIGINT // t.source_size ELSE 0 END AS epochs,
         coalesce(sum(size) OVER (PARTITION BY s.source ORDER BY key, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS prefix
  FROM sized s JOIN targets t ON s.source IS NOT DISTINCT FROM t.source
)
SELECT doc_id, size, source_size, target,
       (epochs * size + greatest(0, least(size, budget - epochs * source_size - prefix)))::BIGINT AS taken
FROM cut
"""
