"""Normalization of rows (field, value) by the field's normalizer."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.dictionaries import NONE, NOT_TEXT
from ..functions.fields import REGISTRY, Normalizer

Registry = dict[str, Normalizer | Callable[[Column], Column]]


def unknown(value: Column) -> Column:
    """What a value of an unknown field gives: itself, at the lowest tier."""
    return F.struct(value.alias("value"), F.when(value.isNull(), F.lit(NOT_TEXT)).otherwise(F.lit(NONE)).alias("confidence"))


def by_field(field: Column, columns: dict[str, Column], default: Column) -> Column:
    out = F.when(F.lit(False), default)
    for name, column in columns.items():
        out = out.when(field == name, column)
    return out.otherwise(default)


def with_result(rows: DataFrame, value: Column, normalizer, name: str) -> DataFrame:
    """rows with the column `name` (value, confidence) by one normalizer, its parts in columns of their own until then."""
    if not isinstance(normalizer, Normalizer):
        return rows.withColumn(name, normalizer(value))
    core = F.col(f"{name}_core")
    out = rows.withColumn(f"{name}_noise", normalizer.noise(value)).withColumn(f"{name}_core", normalizer.core(F.col(f"{name}_noise")))
    parts = {f"{name}_{k}": x for k, x in enumerate(normalizer.inferences(core))}
    out = out.withColumns(parts).withColumn(name, normalizer.decide(value, core, tuple(map(F.col, parts))))
    return out.drop(f"{name}_noise", f"{name}_core", *parts)


def with_results(rows: DataFrame, value: Column, field: Column, registry: Registry, name: str) -> DataFrame:
    """rows with the column `name` (value, confidence) by each row's field; the parts are worked out as in with_result()."""
    whole = {f: n for f, n in registry.items() if isinstance(n, Normalizer)}
    none, core, noise = F.lit(None).cast("string"), F.col(f"{name}_core"), F.col(f"{name}_noise")
    out = rows.withColumn(f"{name}_noise", by_field(field, {f: n.noise(value) for f, n in whole.items()}, none))
    out = out.withColumn(f"{name}_core", by_field(field, {f: n.core(noise) for f, n in whole.items()}, none))
    inferred = {f: n.inferences(core) for f, n in whole.items()}
    most = max(map(len, inferred.values()), default=0)
    parts = {f"{name}_{k}": by_field(field, {f: x[k] for f, x in inferred.items() if len(x) > k}, none) for k in range(most)}
    out = out.withColumns(parts)
    decided = {f: n.decide(value, core, tuple(F.col(p) for p in list(parts)[: len(inferred[f])])) if f in whole else n(value) for f, n in registry.items()}
    return out.withColumn(name, by_field(field, decided, unknown(value))).drop(f"{name}_noise", f"{name}_core", *parts)


def normalize_rows(rows: DataFrame, field: str | None = None, value: str = "value", out: str = "normalized", registry: Registry | None = None) -> DataFrame:
    """rows with columns `out` and confidence. field forces one normalizer; else the column `field` names it.

    One pass without a shuffle. An unknown or null field leaves the value, at the lowest tier; a null
    value gives null and confidence 0.
    """
    v, registry = F.col(value), registry or REGISTRY
    if field is None:
        done = with_results(rows, v, F.col("field"), registry, "_result")
    else:
        done = with_result(rows, v, registry.get(field, unknown), "_result")
    # the result leaves by a generator of one row, through which the optimizer moves filters on other
    # columns, but does not copy the long expression into filters on its own
    kept = [c for c in done.columns if c not in ("_result", out, "confidence")]
    return done.select(*kept, F.inline(F.array("_result")).alias(out, "confidence"))


def normalize_with_confidence(value: Column, field: str) -> Column:
    """struct(value, confidence), as one expression."""
    return REGISTRY.get(field, unknown)(value)


def normalize(value: Column, field: str) -> Column:
    """The normalized value alone."""
    return normalize_with_confidence(value, field).getField("value")
