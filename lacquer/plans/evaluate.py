"""Making dirty data and scoring what comes out: shares right by field and perturbation, and pairs of duplicates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..operators import dedupe as dd
from ..operators.normalize import normalize_rows
from ..sources.scratch import stage

GRID = (0.80, 0.85, 0.90, 0.95)
MOST_ERRORS = 50
PERTURBATIONS = ("space", "typo", "abbrev", "sep", "noise")
TYPO_PAIRS = {"phone": ("0", "O"), "amount": ("0", "O"), "date": ("0", "O"), "idcard": ("0", "O"), "email": ("o", "0"), "person": ("明", "鸣"), "company": ("有", "友"), "address": ("区", "曲")}
LABELS = {"person": "姓名：", "address": "地址：", "phone": "电话：", "company": "单位：", "amount": "金额：", "date": "日期：", "idcard": "证件号：", "email": "邮箱："}
SHORTENED = {"address": ("省", ""), "company": ("股份有限公司", "股份公司"), "date": ("-0", "-"), "email": (".com", ".co")}


def _by_field(field: Column, cases: dict[str, Column], default: Column) -> Column:
    out = F.when(F.lit(False), default)
    for name, column in cases.items():
        out = out.when(field == name, column)
    return out.otherwise(default)


def perturbed(clean: DataFrame, seed: int = 42) -> DataFrame:
    """Five variants (value, truth, perturbation) of each row (id, field, value), at places that a hash of the id picks."""
    v, field = F.col("value"), F.col("field")
    cut = F.pmod(F.xxhash64(F.lit(seed), "id", "field"), F.greatest(F.length(v) - 1, F.lit(1))).cast("int") + 1
    head, tail = F.substr(v, F.lit(1), cut), F.substr(v, cut + 1)
    first = lambda old, new: F.when(F.instr(v, old) > 0, F.concat(F.substr(v, F.lit(1), F.instr(v, old) - 1), F.lit(new), F.substr(v, F.instr(v, old) + len(old)))).otherwise(v)
    kinds = {
        "space": F.concat(head, F.lit("　"), tail),
        "typo": _by_field(field, {f: first(*p) for f, p in TYPO_PAIRS.items()}, v),
        "abbrev": _by_field(field, {f: first(*p) for f, p in SHORTENED.items()} | {"phone": F.concat(F.lit("86"), v), "idcard": F.concat(F.substr(v, F.lit(1), F.lit(6)), F.substr(v, F.lit(9), F.lit(9))), "person": F.substr(v, F.lit(1), F.length(v) - 1)}, v),
        "sep": F.concat(head, _by_field(field, {"amount": F.lit(","), "email": F.lit(".")}, F.lit("-")), tail),
        "noise": F.concat(_by_field(field, {f: F.lit(t) for f, t in LABELS.items()}, F.lit("标签：")), v),
    }
    each = F.array(*[F.struct(F.lit(k).alias("perturbation"), kinds[k].alias("value")) for k in PERTURBATIONS])
    return clean.select("id", "field", v.alias("truth"), F.explode(each).alias("_p")).select("id", "field", "_p.value", "truth", "_p.perturbation")


def split_rows(rows: DataFrame, share: float = 0.2, seed: int = 42, rows_per_range: int = 100_000) -> DataFrame:
    """rows (id, field, ...) with split: round(n * share) ids of each field, in the order of a hash, are held out.

    Hashes are cut into ranges, so that no task ranks a whole field: a range's rank starts at the sum of
    the ranges before it.
    """
    key = F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:"), F.col("id").cast("string"))), 1, 15), 16, 10).cast("long")
    ids = stage(rows.select("field", "id").distinct().withColumn("key", key), "split-ids")
    sizes = ids.groupBy("field").agg(F.count("*").alias("n")).withColumn("ranges", F.ceil(F.col("n") / rows_per_range))
    placed = ids.join(sizes, "field").withColumn("range", F.floor(F.col("key") * (F.col("ranges") / F.lit(float(2**60)))))
    before = Window.partitionBy("field").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    starts = placed.groupBy("field", "range").agg(F.count("*").alias("held")).select("field", "range", F.coalesce(F.sum("held").over(before), F.lit(0)).alias("start"))
    rank = F.col("start") + F.row_number().over(Window.partitionBy("field", "range").orderBy("key", "id"))
    named = placed.join(starts, ["field", "range"]).select("field", "id", F.when(rank <= F.round(F.col("n") * share), "heldout").otherwise("train").alias("split"))
    return rows.join(named, ["field", "id"])


def scored(rows: DataFrame, implementation=None) -> DataFrame:
    """rows (field, value, truth, perturbation) with normalized and ok. implementation: DataFrame to DataFrame with normalized."""
    out = (implementation or normalize_rows)(rows)
    return out.withColumn("ok", F.col("normalized").eqNullSafe(F.col("truth")))


#: What can be scored: values as they are, the truth itself, and the normalizers.
IMPLEMENTATIONS = {"stub": lambda rows: rows.withColumn("normalized", F.col("value")), "perfect": lambda rows: rows.withColumn("normalized", F.col("truth")), "rules": normalize_rows}


def rollups(results: DataFrame) -> DataFrame:
    """(field, perturbation, correct, total, rate) by both, by either and in all, from one pass; null stands for all."""
    grouped = results.groupingSets([[F.col("field"), F.col("perturbation")], [F.col("field")], [F.col("perturbation")], []], "field", "perturbation")
    return grouped.agg(F.count_if("ok").alias("correct"), F.count("*").alias("total"), F.grouping_id().alias("level")).withColumn("rate", F.when(F.col("total") > 0, F.round(F.col("correct") / F.col("total"), 6)).otherwise(0.0)).where("total > 0")


def failures(results: DataFrame) -> DataFrame:
    return results.where("NOT ok").select("id", "field", "value", "normalized", "truth", "perturbation")


def pair_counts(grouped: DataFrame) -> DataFrame:
    """(field, tp, true_pairs, pred_pairs) of rows (id, field, _group, _pos): pairs counted from sizes, never made."""
    n2 = lambda c: F.sum(F.col(c) * (F.col(c) - 1) / 2).cast("long")
    cells = grouped.groupBy("field", "id", "_group").agg(F.count("*").alias("n"), F.min_by("field", "_pos").alias("first"), F.min("_pos").alias("at"))
    tp = cells.groupBy("field").agg(n2("n").alias("tp"))
    true = cells.groupBy("field", "id").agg(F.sum("n").alias("n")).groupBy("field").agg(n2("n").alias("true_pairs"))
    pred = cells.groupBy("_group").agg(F.sum("n").alias("n"), F.min_by("first", "at").alias("field")).groupBy("field").agg(n2("n").alias("pred_pairs"))
    return tp.join(true, "field").join(pred, "field", "full").select("field", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("tp", "true_pairs", "pred_pairs")])


def with_rates(counts: DataFrame) -> DataFrame:
    """counts with precision, recall and f1, each 0 where it has no denominator."""
    share = lambda a, b: F.when(b > 0, a / b).otherwise(0.0)
    p, r = share(F.col("tp"), F.col("pred_pairs")), share(F.col("tp"), F.col("true_pairs"))
    return counts.withColumns({"precision": F.round(p, 6), "recall": F.round(r, 6), "f1": F.round(F.when(p + r > 0, 2 * p * r / (p + r)).otherwise(0.0), 6)})


def pair_scores(grouped: DataFrame) -> DataFrame:
    counts = pair_counts(grouped)
    total = counts.agg(F.lit(None).cast("string").alias("field"), *[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("tp", "true_pairs", "pred_pairs")])
    return with_rates(counts.unionByName(total))


def _first_errors(grouped: DataFrame, key: str, other: str, most: int, kind: str) -> DataFrame:
    """The first `most` pairs, by positions, of rows equal in key and different in other.

    Whether a row has a partner after it follows from the last positions of its key's two latest values
    of other. So only the first rows that have one are paired, `most` of them at most, and no group's
    pairs are made.
    """
    cells = grouped.groupBy(key, other).agg(F.max("_pos").alias("last"))
    latest = cells.groupBy(key).agg(F.max(F.struct("last", other)).alias("latest"))
    second = cells.join(latest, key).where(F.col(other) != F.col(f"latest.{other}")).groupBy(key).agg(F.max("last").alias("second"))
    reach = F.when(F.col(other) != F.col(f"latest.{other}"), F.col("latest.last")).otherwise(F.col("second"))
    brief = [c for c in ("id", "value", "kind", "perturbation") if c in grouped.columns]
    side = lambda df, n: df.select(F.col("_pos").alias(n), F.col(key).alias(f"key_{n}"), F.col(other).alias(f"other_{n}"), *[F.col(c).alias(f"{c}_{n}") for c in (*brief, "field")])
    first = grouped.join(latest, key).join(second, key).where(reach > F.col("_pos")).orderBy("_pos").limit(most)
    a, b = side(first.select(grouped.columns), "a"), side(grouped, "b")
    pairs = b.join(F.broadcast(a), F.col("key_a") == F.col("key_b")).where("a < b AND other_a <> other_b").orderBy("a", "b").limit(most)
    return pairs.select(F.lit(kind).alias("type"), F.col("field_a").alias("field"), "a", "b", *[f"{c}_{n}" for n in "ab" for c in brief])


def error_pairs(grouped: DataFrame, most: int = MOST_ERRORS) -> DataFrame:
    """The first `most` pairs of each kind of error: missed ones share an id, wrong ones a group.

    grouped has id, field, value, _pos and _group; kind and perturbation are given too, where there are any.
    """
    return _first_errors(grouped, "id", "_group", most, "missed").unionByName(_first_errors(grouped, "_group", "id", most, "wrong_merge"))


def summary(results: DataFrame) -> dict:
    """The shares right in all, by field, by perturbation and by both, of scored() rows; the driver gets a row a cell."""
    out: dict = {"total": {"correct": 0, "total": 0, "rate": 0.0}, "by_field": {}, "by_perturbation": {}, "by_field_perturbation": {}}
    for r in rollups(results).collect():
        one = {k: r[k] for k in ("correct", "total", "rate")}
        # a bit of level is set for each column that the row is over all of
        if r["level"] == 3:
            out["total"] = one
        elif r["level"] == 1:
            out["by_field"][r["field"]] = one
        elif r["level"] == 2:
            out["by_perturbation"][r["perturbation"]] = one
        else:
            out["by_field_perturbation"].setdefault(r["field"], {})[r["perturbation"]] = one
    return out


def summary_table(found: dict) -> str:
    """The shares as text: a line a field, a column a perturbation."""
    kinds = sorted(found["by_perturbation"])
    rate = lambda x: f"{x['rate']:.2%}" if x else "-"
    lines = [("field", *kinds, "all")]
    for f in sorted(found["by_field"]):
        lines.append((f, *[rate(found["by_field_perturbation"][f].get(k)) for k in kinds], rate(found["by_field"][f])))
    lines.append(("all", *[rate(found["by_perturbation"][k]) for k in kinds], rate(found["total"])))
    return "\n".join(" ".join(f"{cell:>9}" for cell in line) for line in lines)


def pair_summary(grouped: DataFrame) -> dict:
    """Counts of rows, groups and wrong pairs, and precision, recall and f1 in all and by field."""
    keys = ("tp", "true_pairs", "pred_pairs", "precision", "recall", "f1")
    rates = {r["field"]: {k: r[k] for k in keys} for r in pair_scores(grouped).collect()}
    total = rates.pop(None)
    n = grouped.agg(F.count("*").alias("rows"), F.count_distinct("id").alias("true_groups"), F.count_distinct("_group").alias("pred_groups")).first().asDict()
    return {**n, "missed_pairs": total["true_pairs"] - total["tp"], "wrong_merge_pairs": total["pred_pairs"] - total["tp"], "total": total, "by_field": rates}


def pair_table(found: dict) -> str:
    lines = [("field", "recall", "precision", "f1", "tp", "true", "pred")]
    for name, x in [*sorted(found["by_field"].items()), ("all", found["total"])]:
        lines.append((name, *[f"{x[k]:.2%}" for k in ("recall", "precision", "f1")], *[str(x[k]) for k in ("tp", "true_pairs", "pred_pairs")]))
    return "\n".join(" ".join(f"{cell:>9}" for cell in line) for line in lines)


def threshold_sweep(train: DataFrame, grid=GRID, group=dd.dedupe) -> tuple[float, DataFrame]:
    """The threshold with the best f1 on train rows, the first of equals, and the scores of all of the grid."""
    if train.where("split <> 'train'").limit(1).count() or not train.limit(1).count():
        raise ValueError("thresholds are chosen on train rows only, and on some")
    out = None
    every = dd.dedupe_each(train, grid) if group is dd.dedupe else ((t, group(train, t)) for t in grid)
    for k, (t, found) in enumerate(every):
        # staged one by one, so that the driver plans one threshold at a time
        scores = pair_scores(stage(found, "sweep-groups")).where("field IS NULL")
        row = stage(scores.select(F.lit(t).alias("threshold"), F.lit(k).alias("nth"), "tp", "true_pairs", "pred_pairs", "precision", "recall", "f1"), "sweep")
        out = row if out is None else out.unionByName(row)
    best = out.orderBy(F.desc("f1"), "nth").first()["threshold"]
    return best, out.drop("nth")
