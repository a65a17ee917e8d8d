"""Command line: normalize, dedupe, audit, rollback and table; generate, evaluate and evaluate-dedupe for benchmark sets.

Input is a file, standard input (`-`, or no --input), or a place that Spark reads, given with its
scheme. Output goes to a file, to standard output, or, with a scheme, to a folder that the tasks write.
Exit codes: 0 done, 1 bad data or files, 2 bad arguments.
"""

from __future__ import annotations

import argparse
import json
import re
import sys
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions.fields import REGISTRY
from .operators import audit, dedupe, tables
from .operators.normalize import normalize_rows
from .plans import evaluate, generate
from .sources import benchmark, files
from .sources.scratch import scratch_path, stage, with_positions

FAILED, USAGE = 1, 2
STDIN = "-"


class Failure(Exception):
    """Something about the data or the files that the user is told in one line."""


def threshold(text: str) -> float:
    try:
        return dedupe.checked_threshold(float(text))
    except ValueError:
        raise argparse.ArgumentTypeError(f"the threshold has to be a number in [0, 1], not {text!r}") from None


def columns(text: str) -> dict[str, str]:
    """name=field,name=field"""
    out: dict[str, str] = {}
    for part in filter(None, map(str.strip, text.split(","))):
        name, equals, field = map(str.strip, part.partition("="))
        if not equals or not name or field not in REGISTRY or name in out:
            raise argparse.ArgumentTypeError(f"columns are written name=field, each name once and fields of {tuple(REGISTRY)}; not {part!r}")
        out[name] = field
    if not out:
        raise argparse.ArgumentTypeError("no columns")
    return out


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="lacquer", description=__doc__)
    sub = p.add_subparsers(dest="command", required=True)
    add = lambda name, *options: [sub_.add_argument(*o[0], **o[1]) for sub_ in [sub.add_parser(name)] for o in options]
    source, out = (("--input",), {"default": STDIN}), (("--out",), {})
    add("normalize", source, out, (("--field",), {"choices": tuple(REGISTRY)}))
    add("dedupe", source, out, (("--threshold",), {"type": threshold, "default": dedupe.THRESHOLD}))
    add("audit", source, out, (("--apply",), {"action": "store_true"}), (("--force",), {"action": "store_true"}))
    add("rollback", (("--cleaned",), {"required": True}), (("--backup",), {"required": True}), out)
    add("table", source, out, (("--columns",), {"type": columns}), (("--dedupe",), {"action": "store_true"}))
    way = sub.choices["dedupe"].add_mutually_exclusive_group()
    way.add_argument("--adaptive", action="store_true", help="rules of their own for person, company and address (this is what is done without --plain)")
    way.add_argument("--plain", action="store_true")
    out = (("--out",), {"required": True})
    add("generate", (("--seed",), {"type": int, "default": 42}), (("--per-field",), {"type": int, "default": 200}), (("--split-ratio",), {"type": float, "default": 0.2}), out)
    add("evaluate", (("--impl",), {"choices": tuple(evaluate.IMPLEMENTATIONS), "default": "rules"}), (("--split",), {"choices": (*benchmark.SPLITS, "all"), "default": "heldout"}), (("--dirty-dir",), {"required": True}), out)
    add("evaluate-dedupe", (("--split",), {"choices": benchmark.SPLITS, "default": "heldout"}), (("--adaptive",), {"action": "store_true"}), (("--clean-dir",), {"required": True}), (("--dirty-dir",), {"required": True}), out)
    chosen = sub.choices["evaluate-dedupe"].add_mutually_exclusive_group()
    chosen.add_argument("--threshold", type=threshold)
    chosen.add_argument("--select-threshold", action="store_true")
    return p


def has_scheme(path: str) -> bool:
    return "://" in path


def source_of(spark: SparkSession, path: str) -> str:
    """Where Spark reads an input: standard input is copied to the shared folder, a local file is read where it is."""
    if has_scheme(path):
        return path
    if path != STDIN:
        if not Path(path).is_file():
            raise Failure(f"there is no file {path}")
        return "file://" + str(Path(path).resolve())
    at = scratch_path(spark, "stdin")
    to = spark._jvm.org.apache.hadoop.fs.Path(at)
    stream = to.getFileSystem(spark._jsc.hadoopConfiguration()).create(to)
    given = getattr(sys.stdin, "buffer", None)
    for chunk in iter(lambda: given.read(1 << 20) if given else sys.stdin.read(1 << 20).encode(), b""):
        stream.write(bytearray(chunk))
    stream.close()
    return at


def rows_of(spark: SparkSession, path: str, need_field: bool = True) -> DataFrame:
    return stage(files.read_rows(spark, source_of(spark, path), need_field), "cli-rows")


def write(lines: DataFrame, out: str | None, head: tuple[str, ...] = ()) -> None:
    """The column `text` in the order of _pos: to a folder that tasks write, or their files joined to a local file or standard output."""
    spark = lines.sparkSession
    if out and has_scheme(out):
        for k, text in enumerate(head):
            lines = lines.unionByName(spark.createDataFrame([(k - len(head), text)], "_pos long, text string"))
        files.write_lines(lines, out)
        return
    target = open(out, "w", encoding="utf-8", newline="\n") if out else sys.stdout
    try:
        for text in head:
            target.write(text + "\n")
        for part in files.parts_of(spark, lines):
            target.write(part)
    finally:
        if out:
            target.close()


def write_document(document: dict, path: Path) -> None:
    path.write_text(json.dumps(document, ensure_ascii=False, indent=2, sort_keys=True) + "\n", encoding="utf-8")


def as_lines(rows: DataFrame, order: tuple[str, ...] = ("_pos",)) -> DataFrame:
    """The rows as JSON text, in an order that _pos keeps."""
    text = F.to_json(F.struct(*[c for c in rows.columns if c not in order]), {"ignoreNullFields": "false"}).alias("text")
    return rows.select(F.struct(*order).alias("_pos"), text)


def run_benchmark(spark: SparkSession, a: argparse.Namespace) -> str:
    """generate, evaluate and evaluate-dedupe: sets and results as files in the folder --out."""
    out = Path(a.out)
    local = lambda folder: "file://" + str(Path(folder).resolve())
    for folder in (getattr(a, "clean_dir", None), getattr(a, "dirty_dir", None)):
        if folder and not Path(folder).is_dir():
            raise Failure(f"there is no folder {folder}")
    if a.command == "generate":
        clean, dirty = generate.build(spark, a.per_field, a.seed, a.split_ratio)
        dirty = stage(dirty.select("_pos", "id", "field", "value", "truth", "perturbation", "split"), "cli-dirty")
        for name, rows in (("clean", clean), ("dirty", dirty)):
            (out / name).mkdir(parents=True, exist_ok=True)
            for field in benchmark.FIELDS:
                write(as_lines(rows.where(F.col("field") == field)), str(out / name / f"{field}.jsonl"))
        counts = generate.split_counts(dirty).orderBy("field", "split").collect()
        return "\n".join(f"{r['field']:<9} {r['split']:<8} {r['clean']:>7} {r['dirty']:>7}" for r in counts)
    out.mkdir(parents=True, exist_ok=True)
    if a.command == "evaluate":
        results = stage(evaluate.scored(benchmark.load_dirty(spark, local(a.dirty_dir), a.split), evaluate.IMPLEMENTATIONS[a.impl]), "cli-scored")
        found = evaluate.summary(results)
        write_document({"impl": a.impl, "split": a.split, **found}, out / f"summary-{a.impl}-{a.split}.json")
        wrong = results.where("NOT ok").select("_pos", "id", "field", "value", "normalized", "truth", "perturbation")
        write(as_lines(wrong), str(out / f"failures-{a.impl}-{a.split}.jsonl"))
        return evaluate.summary_table(found)
    group, chosen, sweep = dedupe.dedupe_adaptive if a.adaptive else dedupe.dedupe, a.threshold, None
    sets = (local(a.clean_dir), local(a.dirty_dir))
    if a.select_threshold:
        chosen, scores = evaluate.threshold_sweep(benchmark.load_pairs(spark, *sets, "train"), group=group)
        sweep = {"on_split": "train", "grid": list(evaluate.GRID), "by": "f1", "sweep": [r.asDict() for r in scores.orderBy("threshold").collect()]}
    used = dedupe.THRESHOLD if chosen is None else chosen
    grouped = stage(group(benchmark.load_pairs(spark, *sets, a.split), used), "cli-pairs")
    found = evaluate.pair_summary(grouped)
    source = "select@train" if sweep else "default" if a.threshold is None else "explicit"
    head = {"split": a.split, "threshold": used, "threshold_source": source, "selection": sweep, "adaptive": a.adaptive, "adaptive_config": dedupe.describe_adaptive() if a.adaptive else None}
    write_document({**head, **found}, out / f"dedupe-summary-{a.split}.json")
    errors = evaluate.error_pairs(grouped)
    sides = [F.struct(*[F.col(f"{c}_{n}").alias(c) for c in ("id", "value", "kind", "perturbation")]).alias(n) for n in "ab"]
    places = [F.col("type").alias("_type"), F.col("a").alias("_a"), F.col("b").alias("_b")]
    write(as_lines(errors.select(*places, "type", "field", *sides), ("_type", "_a", "_b")), str(out / f"dedupe-errors-{a.split}.jsonl"))
    return evaluate.pair_table(found)


def cleaned_lines(rows: DataFrame) -> DataFrame:
    """The lines of rows with the normalized value in place and _before on those that changed."""
    done = normalize_rows(rows)
    changed = F.col("normalized").isNotNull() & (F.col("normalized") != F.col("value"))
    new = files.spliced(F.col("raw"), value=files.json_text(F.col("normalized")), _before=files.json_text(F.col("value")))
    return stage(done.select("_pos", F.when(changed, new).otherwise(F.col("raw")).alias("text")), "cli-cleaned")


def write_backup(rows: DataFrame, mark: str, path: Path) -> None:
    """One JSON document: the checksum, and the rows, a line each in their order."""
    with open(path, "w", encoding="utf-8", newline="\n") as out:
        out.write(f'{{\n  "checksum": {json.dumps(mark)},\n  "rows": [')
        before = "\n"
        for part in files.parts_of(rows.sparkSession, rows.select("_pos", F.col("raw").alias("text"))):
            for line in filter(None, part.split("\n")):
                out.write(f"{before}    {line}")
                before = ",\n"
        out.write("\n  ]\n}\n")


def read_backup(spark: SparkSession, path: str) -> tuple[DataFrame, str]:
    """The rows of a backup document and its checksum. Lines as write_backup() writes them are read in parallel; any other document that has both keys is parsed whole."""
    if not Path(path).is_file():
        raise Failure(f"there is no file {path}")
    with open(path, encoding="utf-8-sig") as text:
        head = [text.readline() for _ in range(3)]
    mark = re.fullmatch(r'  "checksum": ("[^"]*"),\n', head[1])
    if head[0] == "{\n" and mark and head[2] == '  "rows": [\n':
        lines = files.text_lines(spark, "file://" + str(Path(path).resolve())).where(F.col("value").startswith("    "))
        lines = lines.select(F.regexp_replace(F.substr("value", F.lit(5)), r",$", "").alias("value"))
        rows = files.checked(files.parsed_rows(files.numbered_lines(lines)))
        return stage(with_positions(rows.orderBy("line")), "cli-backup"), json.loads(mark[1])
    try:
        document = json.loads(Path(path).read_text(encoding="utf-8-sig"))
        given = [json.dumps(r, ensure_ascii=False) for r in document["rows"]]
        lines = spark.createDataFrame([(x,) for x in given], "value string")
        rows = files.checked(files.parsed_rows(files.numbered_lines(lines)))
        return stage(with_positions(rows.orderBy("line")), "cli-backup"), document["checksum"]
    except (ValueError, KeyError, TypeError) as e:
        raise Failure(f"{path} is no backup: {e}") from None


def line_digest(lines: DataFrame, column: str) -> str:
    """A digest of lines in their order: of the positions' and lines' own digests, added up."""
    d = F.sha2(F.concat_ws(":", "_pos", column), 256)
    return "|".join(str(x) for x in lines.agg(F.count("*"), *[F.sum(F.conv(F.substring(d, 1 + 15 * k, 15), 16, 10).cast("decimal(38,0)")) for k in range(4)]).first())


def run(spark: SparkSession, a: argparse.Namespace) -> str:
    if a.command in ("generate", "evaluate", "evaluate-dedupe"):
        return run_benchmark(spark, a)
    if a.command == "normalize":
        rows = rows_of(spark, a.input, a.field is None)
        done = stage(normalize_rows(rows, a.field), "cli-normalized")
        kept = files.json_value(F.col("normalized"), F.col("value_json"))
        write(done.select("_pos", files.spliced(F.col("raw"), normalized=kept, confidence=files.json_text(F.col("confidence"))).alias("text")), a.out)
        return f"{done.count()} rows, {done.where('NOT (normalized <=> value)').count()} changed"
    if a.command == "dedupe":
        rows = rows_of(spark, a.input)
        found = stage((dedupe.dedupe if a.plain else dedupe.dedupe_adaptive)(rows, a.threshold), "cli-groups")
        write(found.select("_pos", files.spliced(F.col("raw"), _group=F.col("_group").cast("string")).alias("text")), a.out)
        s = dedupe.group_statistics(found).first()
        return f"{s['rows']} rows in {s['groups']} groups, {s['multi']} of several rows; {s['removable']} rows could go"
    if a.command == "audit":
        rows = rows_of(spark, a.input)
        if not a.apply:
            return audit.format_report(audit.report(rows))
        if a.input == STDIN and not a.out:
            raise Failure("rows from standard input that are applied need --out")
        named = a.out or a.input.removesuffix(".jsonl").removesuffix(".json") + ".cleaned.jsonl"
        if has_scheme(named):
            raise Failure("audit --apply writes local files, so that the backup is one document")
        out = Path(named)
        backup = out.with_name((out.stem if out.suffix == ".jsonl" else out.name) + ".backup.json")
        for path in () if a.force else (out, backup):
            if path.exists():
                raise Failure(f"{path} is there already; --force overwrites it")
        lines = cleaned_lines(rows)
        write_backup(rows, line_digest(rows, "raw") + ";" + line_digest(lines, "text"), backup)
        write(lines, str(out))
        return audit.format_report(audit.report(rows, dry_run=False)) + f"\n{out}\n{backup}"
    if a.command == "rollback":
        cleaned, (backup, mark) = rows_of(spark, a.cleaned), read_backup(spark, a.backup)
        if mark != line_digest(backup, "raw") + ";" + line_digest(cleaned, "raw"):
            raise Failure("the checksum does not match: backup and cleaned rows are not of one run, so nothing is rolled back")
        write(backup.select("_pos", F.col("raw").alias("text")), a.out)
        return f"{backup.count()} rows are back"
    header, cells = files.read_cells(spark, source_of(spark, a.input), multiline=True)
    done = tables.clean_table(cells, header, a.columns, a.dedupe)
    head = spark.createDataFrame([(header,)], "cells array<string>").select(files.csv_line(F.col("cells"))).first() if header else ()
    write(done["rows"].select("_pos", files.csv_line(F.col("cells")).alias("text")), a.out, tuple(head))
    return f"{done['report']['rows_in']} rows of {len(header)} columns, {done['changed_cells']} cells changed, {done['rows_out']} rows left"


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    try:
        a = parser().parse_args(argv)
    except SystemExit as e:
        return e.code if isinstance(e.code, int) else USAGE
    spark = spark or SparkSession.builder.appName("lacquer").getOrCreate()
    try:
        print(run(spark, a), file=sys.stdout if a.out or a.command == "audit" else sys.stderr)
    except (Failure, ValueError) as e:
        print(f"error: {e}", file=sys.stderr)
        return FAILED
    return 0


if __name__ == "__main__":
    sys.exit(main())
