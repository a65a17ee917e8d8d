"""Routing of rows by confidence: cleaned, unchanged, to a person, or in error; optionally a model call between rules and person."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.scratch import stage, with_positions
from .normalize import normalize_rows

LEAST_CONFIDENCE = 0.2


def _asked(llm_fn: Callable[[str, str], tuple[str, float]]) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = []
            for value, field in zip(batch["value"], batch["field"], strict=True):
                try:
                    found.append(llm_fn(value, field))
                except Exception:  # noqa: BLE001  a call that fails tells nothing about the value
                    found.append((value, 0.0))
            yield pd.DataFrame({"_pos": batch["_pos"], "_said": [v for v, _ in found], "_sure": [float(c) for _, c in found]})

    return run


def route(rows: DataFrame, max_steps: int | None = None, least: float = LEAST_CONFIDENCE, llm_fn: Callable[[str, str], tuple[str, float]] | None = None, llm_max_calls: int | None = None) -> DataFrame:
    """rows (field, value, ..., _pos) with bucket, confidence, error and _before; value is the cleaned one in the bucket cleaned.

    Rows under the confidence `least` are unchanged if the rules left them alone, and otherwise go to a
    person (hitl). With a model function they are asked about instead, the first llm_max_calls of them
    by position, and cleaned if it is sure. Columns has_field and has_value, where there are any, tell
    keys that are missing. Only the first max_steps rows are looked at.
    """
    if max_steps is not None:
        rows = rows.where(F.col("_pos") < max(0, max_steps))
    missing = F.lit(None).cast("string")
    for key in ("value", "field"):
        if f"has_{key}" in rows.columns:
            missing = F.when(~F.col(f"has_{key}"), F.lit(f"缺字段：{key}")).otherwise(missing)
    bad_field = F.col("field").isNull() | (F.col("field") == "")
    error = F.coalesce(missing, F.when(bad_field, F.concat(F.lit("ValueError: field 须是非空字符串，收到 "), F.coalesce(F.concat(F.lit("'"), F.col("field"), F.lit("'")), F.lit("None")))))
    ruled = normalize_rows(rows.withColumn("error", error))
    changed = ~F.col("normalized").eqNullSafe(F.col("value"))
    sure = F.col("confidence") >= least
    if llm_fn is None:
        bucket = F.when(F.col("error").isNotNull(), "errors").when(sure, "cleaned").when(changed, "hitl").otherwise("unchanged")
        out = ruled.withColumns({"bucket": bucket, "_new": F.col("normalized")})
    else:
        ruled = stage(ruled, "ruled")
        low = ruled.where(F.col("error").isNull() & ~sure).select("_pos", "value", "field")
        if llm_max_calls is not None:
            low = with_positions(low.orderBy("_pos"), "_nth").where(F.col("_nth") < llm_max_calls).drop("_nth")
        # staged, so that no call is made twice
        said = stage(low.mapInPandas(_asked(llm_fn), "_pos long, _said string, _sure double"), "said").withColumnRenamed("_pos", "_asked")
        joined = ruled.join(said, F.col("_pos") == F.col("_asked"), "left")
        settled = F.coalesce(F.col("_sure") >= least, F.lit(False))
        bucket = F.when(F.col("error").isNotNull(), "errors").when(sure | settled, "cleaned").otherwise("hitl")
        out = joined.withColumns({"bucket": bucket, "_new": F.when(sure, F.col("normalized")).otherwise(F.col("_said"))}).drop("_asked", "_said", "_sure")
    cleaned = F.col("bucket") == "cleaned"
    moved = cleaned & ~F.col("_new").eqNullSafe(F.col("value"))
    return out.withColumns(
        {
            "_before": F.when(moved, F.col("value")),
            "value": F.when(cleaned, F.col("_new")).otherwise(F.col("value")),
            "confidence": F.when(F.col("bucket").isin("hitl", "unchanged"), F.col("confidence")),
            "line": F.when(F.col("error").isNotNull(), F.col("_pos") + 1),
        }
    ).drop("_new", "normalized")
