"""Reports of what normalization changes, applying it, and taking it back."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.scratch import stage
from .normalize import normalize_rows

#: Bands of confidence in the order of reports: key, value, reason.
BANDS = (("0.95", 0.95, "clean"), ("0.9", 0.9, "structural"), ("0.7", 0.7, "infer"), ("0.1", 0.1, "none"))
OTHER = "other"
MOST_CHANGES = 1000


def banded(confidence: Column, reason: bool = False) -> Column:
    """The band's key, or its reason; bands match but for rounding."""
    out = F.when(F.lit(False), F.lit(OTHER))
    for key, value, why in BANDS:
        out = out.when(F.abs(confidence - value) <= 1e-9 * F.greatest(F.abs(confidence), F.lit(value)), F.lit(why if reason else key))
    return out.otherwise(F.lit(OTHER))


def changes(rows: DataFrame) -> DataFrame:
    """rows (field, value, ...) with normalized, confidence, band, reason and changed.

    The normalized rows are staged, so that the parts of a report read them instead of cleaning again.
    """
    return marked(stage(normalize_rows(rows), "normalized"))


def marked(normalized: DataFrame) -> DataFrame:
    """normalize_rows() of rows or of a stream, with band, reason and changed."""
    return normalized.withColumns({"band": banded(F.col("confidence")), "reason": banded(F.col("confidence"), True), "changed": ~F.col("normalized").eqNullSafe(F.col("value"))})


def totals(changed: DataFrame) -> DataFrame:
    return changed.agg(F.count("*").alias("total"), F.count_if("changed").alias("changed"), F.count_if(~F.col("changed")).alias("unchanged"))


def by_field(changed: DataFrame) -> DataFrame:
    """Counts by field, with the first position of the field if rows have positions."""
    first = [F.min("_pos").alias("first_pos")] if "_pos" in changed.columns else []
    return changed.groupBy("field").agg(F.count("*").alias("total"), F.count_if("changed").alias("changed"), F.count_if(~F.col("changed")).alias("unchanged"), *first)


def by_confidence(changed: DataFrame) -> DataFrame:
    """Rows of each band, bands without rows included."""
    bands = changed.sparkSession.createDataFrame([(k,) for k, _, _ in BANDS] + [(OTHER,)], "band string")
    counted = changed.groupBy("band").agg(F.count("*").alias("n"))
    return bands.join(counted, "band", "left").select("band", F.coalesce("n", F.lit(0)).alias("n"))


def change_list(changed: DataFrame, most: int = MOST_CHANGES) -> DataFrame:
    """The first `most` changed rows by position: id, field, before, after, confidence, reason."""
    if isinstance(most, bool) or not isinstance(most, int) or most < 0:
        raise ValueError(f"the number of changes has to be an integer of 0 or more, not {most!r}")
    return changed.where("changed").orderBy("_pos").limit(most).select("id", "field", F.col("value").alias("before"), F.col("normalized").alias("after"), "confidence", "reason")


def report(rows: DataFrame, dry_run: bool = True, most: int = MOST_CHANGES) -> dict:
    """The whole report as a document; rows need id, field, value and _pos. Only sums and the list reach the driver."""
    changed = changes(rows)
    listed = [r.asDict() for r in change_list(changed, most).collect()]
    total, n_changed, unchanged = totals(changed).first()
    fields = {r["field"]: {k: r[k] for k in ("total", "changed", "unchanged")} for r in by_field(changed).orderBy("first_pos").collect()}
    bands = dict(map(tuple, by_confidence(changed).collect()))
    return {
        "dry_run": dry_run,
        "total": total,
        "changed": n_changed,
        "unchanged": unchanged,
        "by_field": fields,
        "by_confidence": {k: bands[k] for k in [*(b[0] for b in BANDS), OTHER]},
        "changes": listed,
        "truncated": n_changed > len(listed),
    }


# What a printed report has to say.
HEADLINES = {True: "dry-run 预览，未应用", False: "已应用，可回滚"}
COUNTED, MOVED, KEPT, LISTED, CUT = "总行数", "改动", "未改", "列出", "已截断"


def format_report(found: dict) -> str:
    """A report as text: the sums, a line for each field with its share of changes, a line for the tiers, and the length of the list."""

    def sums(label: str, of: dict) -> str:
        return f"{label} {of['total']} | {MOVED} {of['changed']} | {KEPT} {of['unchanged']}" + (f" | {of['changed'] / of['total']:.1%}" if of["total"] else "")

    tiers = " | ".join(f"{band} × {n}" for band, n in found["by_confidence"].items())
    fields = [f"- {sums(field, of)}" for field, of in found["by_field"].items()]
    tail = f"{LISTED} {len(found['changes'])} 条" + f" ({CUT})" * found["truncated"]
    return "\n".join([f"[{HEADLINES[bool(found.get('dry_run', True))]}]", sums(COUNTED, found), *fields, tiers, tail])


def apply(rows: DataFrame) -> DataFrame:
    """rows with the normalized value in place and _before, the old one, on changed rows; null on others."""
    out = normalize_rows(rows)
    changed = ~F.col("normalized").eqNullSafe(F.col("value"))
    return out.withColumns({"_before": F.when(changed, F.col("value")), "value": F.col("normalized")}).drop("normalized", "confidence")


def row_digest(rows: DataFrame) -> Column:
    """A digest of all columns of a row, by name, nulls included."""
    return F.sha2(F.to_json(F.struct(*sorted(rows.columns)), {"ignoreNullFields": "false"}), 256)


def checksum(original: DataFrame, cleaned: DataFrame) -> str:
    """A digest over both tables whatever order their rows are read in: rows have positions, and digests add up.

    Each row's digest, of which its position is a part, counts as four numbers; their sums and the
    number of rows of either table are digested once more.
    """
    sums = []
    for df in (original, cleaned):
        d = row_digest(df)
        parts = [F.sum(F.conv(F.substring(d, 1 + 15 * k, 15), 16, 10).cast("decimal(38,0)")).alias(f"s{k}") for k in range(4)]
        sums.append(df.agg(F.count("*").alias("n"), *parts))
    texts = ["|".join(str(x) for x in df.first()) for df in sums]
    return original.sparkSession.range(1).select(F.sha2(F.lit(";".join(texts)), 256)).first()[0]


def rollback(cleaned: DataFrame, backup: DataFrame, expected: str) -> DataFrame:
    """The original rows, if cleaned and backup are those of one apply()."""
    if checksum(backup, cleaned) != expected:
        raise ValueError("the checksum does not match: backup and cleaned rows are not of one run, so nothing is rolled back")
    return backup
