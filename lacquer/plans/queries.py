"""Queries over the test tables, and what they have to give in closed form.

The tables hold no Chinese text, so dirty values are made from keys. CASES writes, for each field, how
a key's value is spoilt and what has to come out, in SQL that Spark and DuckDB both read; the queries
take the dirty values only, and the oracles state the results without any cleaning.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import dictionaries as d
from ..functions import similarity
from ..operators import audit, dedupe, routing, tables
from ..operators.normalize import normalize_rows
from ..sources import benchmark, files
from ..sources.scratch import scratch_path, stage
from . import evaluate, generate

def cell(words: list[str], at: str) -> str:
    """SQL for word number `at` of a list, from 0; both dialects cut it from one text of words of equal width."""
    width = max(map(len, words))
    return f"replace(substr('{''.join(w.ljust(width, '_') for w in words)}', CAST({at} AS INT) * {width} + 1, {width}), '_', '')"


# What the values of person, company and address are made of: all of the closed sets.
SURNAMES = [*sorted(d.SURNAMES), *d.COMPOUND_SURNAMES]
NAME_TYPOS = [(wrong, right) for wrong, right in d.PERSON_TYPOS.items() if right not in d.PERSON_TYPOS]
#: Without 那曲, whose second character is itself taken for a mistyped 区 wherever no other repair is found.
PLACES = [(short, d.PROVINCES[short], city) for short, cities in d.CITIES_OF.items() for city in cities.split() if city != "那曲"]
TRADES = sorted(d.INDUSTRIES)
#: Every form and trade of a company with one character mistyped in it, and what it has to become.
COMPANY_CASES = [(form[:k] + wrong + form[k + 1 :], form) for form in sorted(d.ORGANISATIONS) for k, c in enumerate(form) for wrong, right in d.COMPANY_TYPOS.items() if right == c]
TRADE_CASES = [(trade[:k] + wrong + trade[k + 1 :], trade) for trade in TRADES for k, c in enumerate(trade) for wrong, right in d.COMPANY_TYPOS.items() if right == c]


def mistyped_city(city: str) -> str:
    """The city with its first character that has a wrong one mistyped, or as it is."""
    for k, c in enumerate(city):
        for wrong, right in d.ADDRESS_TYPOS.items():
            if right == c:
                return city[:k] + wrong + city[k + 1 :]
    return city


CENTS = "CAST(round(o_totalprice * 100) AS BIGINT)"
DAY = "substr(CAST(o_orderdate AS {str}), 1, 10)"
ID17 = "'11' || lpad(CAST(c_custkey % 10000 AS {str}), 4, '0') || CAST(1970 + c_custkey % 30 AS {str}) || lpad(CAST(1 + c_custkey % 12 AS {str}), 2, '0') || lpad(CAST(1 + c_custkey % 28 AS {str}), 2, '0') || lpad(CAST(c_custkey % 1000 AS {str}), 3, '0')"
WEIGHTS = (7, 9, 10, 5, 8, 4, 2, 1, 6, 3, 7, 9, 10, 5, 8, 4, 2)
CHECK = "substr('10X98765432', CAST((" + " + ".join(f"CAST(substr(s, {k + 1}, 1) AS INT) * {w}" for k, w in enumerate(WEIGHTS)) + ") % 11 AS INT) + 1, 1)"

#: field: (source with key k and clean value v, [(dirty, right, confidence) by k modulo their number])
CASES = {
    "phone": (
        "SELECT c_custkey AS k, '138' || lpad(CAST(c_custkey AS {str}), 8, '0') AS v FROM customer",
        [("v", "v", 0.95), ("substr(v, 1, 3) || ' ' || substr(v, 4)", "v", 0.9), ("'+86' || v", "v", 0.9), ("'电话：' || v", "v", 0.9), ("'13B' || substr(v, 4)", "v", 0.7), ("substr(v, 1, 10)", "substr(v, 1, 10)", 0.1), ("substr(v, 1, 3) || '-' || substr(v, 4, 4) || '-' || substr(v, 8)", "v", 0.9), ("v || '（本人）'", "v", 0.9)],
    ),
    "amount": (
        f"SELECT o_orderkey AS k, CAST({CENTS} {{div}} 100 AS {{str}}) || '.' || lpad(CAST({CENTS} % 100 AS {{str}}), 2, '0') AS n, CAST({CENTS} {{div}} 1000000 AS {{str}}) AS w, CAST({CENTS} {{div}} 1000000 * 10000 AS {{str}}) AS t FROM orders",
        [("n || '元'", "n || '元'", 0.95), ("n || ' 元'", "n || '元'", 0.9), ("substr(n, 1, 1) || ',' || substr(n, 2) || '元'", "n || '元'", 0.9), ("'金额：' || n || '元'", "n || '元'", 0.9), ("'l' || n || '元'", "'1' || n || '元'", 0.7), ("w || '万元'", "t || '元'", 0.7), ("n || '元整'", "n || '元整'", 0.1)],
    ),
    "date": (
        f"SELECT o_orderkey AS k, {DAY} AS v FROM orders",
        [("v", "v", 0.95), ("replace(v, '-', '/')", "v", 0.9), ("substr(v, 1, 4) || '-' || CAST(CAST(substr(v, 6, 2) AS INT) AS {str}) || '-0' || CAST(CAST(substr(v, 9, 2) AS INT) % 10 AS {str})", None, None), ("'日期:' || v", "v", 0.9), ("CASE WHEN substr(v, 1, 1) = '1' THEN 'l' ELSE 'Z' END || substr(v, 2)", "v", 0.7), ("substr(v, 6)", "substr(v, 6)", 0.1)],
    ),
    "idcard": (
        f"SELECT k, s || {CHECK} AS v, substr(s, 1, 6) || substr(s, 9) AS old, s || CASE WHEN {CHECK} = '0' THEN '1' ELSE '0' END AS bad FROM (SELECT c_custkey AS k, {ID17} AS s FROM customer) b",
        [("v", "v", 0.95), ("substr(v, 1, 6) || ' ' || substr(v, 7)", "v", 0.9), ("'l' || substr(v, 2)", "v", 0.7), ("old", "v", 0.7), ("bad", "bad", 0.1), ("'证件号：' || v", "v", 0.9)],
    ),
    "email": (
        "SELECT c_custkey AS k, 'user' || CAST(c_custkey AS {str}) AS u FROM customer",
        [("u || '@hotmail.com'", "u || '@hotmail.com'", 0.95), ("u || ' @hotmail.com'", "u || '@hotmail.com'", 0.9), ("'Email: ' || u || '@hotmail.com'", "u || '@hotmail.com'", 0.9), ("u || '@h0tmail.com'", "u || '@hotmail.com'", 0.7), ("u || '@hotmail.c0m'", "u || '@hotmail.com'", 0.7), ("u || '.hotmail.com'", "u || '.hotmail.com'", 0.1), ("'5ser' || substr(u, 5) || '@hotmail.com'", "'sser' || substr(u, 5) || '@hotmail.com'", 0.7)],
    ),
    "person": (
        f"SELECT k, {cell(SURNAMES, f'j % {len(SURNAMES)}')} AS s, substr('小大建国新立海春秋成', CAST(k % 10 AS INT) + 1, 1) AS g, {cell([r for _, r in NAME_TYPOS], f'j % {len(NAME_TYPOS)}')} AS h, {cell([w for w, _ in NAME_TYPOS], f'j % {len(NAME_TYPOS)}')} AS x FROM (SELECT c_custkey AS k, c_custkey {{div}} 9 AS j FROM customer) c",
        [("s || g || h", "s || g || h", 0.95), ("s || '　' || g || h", "s || g || h", 0.9), ("s || g || h || '先生'", "s || g || h", 0.9), ("s || '·' || g || h", "s || g || h", 0.9), ("s || g || x", "s || g || h", 0.7), ("'x' || g || h", "'x' || g || h", 0.1), ("'姓名：' || s || g || h", "s || g || h", 0.9), ("s || x || h", "s || h || h", 0.7), ("s || x || ' ' || h || '教授'", "s || x || h", 0.9)],
    ),
    "company": (
        f"SELECT k, {cell([c for _, _, c in PLACES], f'k % {len(PLACES)}')} || '嘉禾' AS c, {cell(TRADES, f'k % {len(TRADES)}')} AS t, {cell([w for w, _ in COMPANY_CASES], f'j % {len(COMPANY_CASES)}')} AS fx, {cell([r for _, r in COMPANY_CASES], f'j % {len(COMPANY_CASES)}')} AS f, {cell([w for w, _ in TRADE_CASES], f'j % {len(TRADE_CASES)}')} AS tx, {cell([r for _, r in TRADE_CASES], f'j % {len(TRADE_CASES)}')} AS tr FROM (SELECT c_custkey AS k, c_custkey {{div}} 7 AS j FROM customer) x",
        [("c || t || f", "c || t || f", 0.95), ("c || ' ' || t || f", "c || t || f", 0.9), ("c || t || f || '（总部）'", "c || t || f", 0.9), ("c || t || fx", "c || t || f", 0.7), ("c || t || '股份公司'", "c || t || '股份有限公司'", 0.7), ("c || tx || '有限公司'", "c || tr || '有限公司'", 0.7), ("c || t", "c || t", 0.1)],
    ),
    "address": (
        f"SELECT k, {cell([p for p, _, _ in PLACES], f'k % {len(PLACES)}')} AS p, {cell([f for _, f, _ in PLACES], f'k % {len(PLACES)}')} AS f, {cell([c for _, _, c in PLACES], f'k % {len(PLACES)}')} AS c, {cell([mistyped_city(c) for _, _, c in PLACES], f'k % {len(PLACES)}')} AS x, '江北区人民路' || CAST(k AS {{str}}) || '号' AS r FROM (SELECT c_custkey AS k FROM customer) n",
        [("f || c || '市' || r", "f || c || '市' || r", 0.95), ("f || ' ' || c || '市' || r", "f || c || '市' || r", 0.9), ("'地址：' || f || c || '市' || r", "f || c || '市' || r", 0.9), ("p || c || r", "f || c || '市' || r", 0.7), ("p || c || '市' || r", "f || c || '市' || r", 0.7), ("f || x || '市' || r", "f || c || '市' || r", "CASE WHEN x = c THEN 0.95 ELSE 0.7 END"), ("f || c || '市' || replace(r, '区', '曲')", "f || c || '市' || r", 0.7), ("f || c || '市' || replace(r, '路', '露')", "f || c || '市' || r", 0.7), ("f || c || '市江北区'", "f || c || '市江北区'", 0.1), ("f || c || r", "f || c || '市' || r", 0.7), ("f || c || '市' || r || '3式'", "f || c || '市' || r || '3室'", 0.7),
         # directions are repaired only before 区 or 城, whether by a word or by one character
         ("f || c || '市城茜' || substr(r, 3)", "f || c || '市城西' || substr(r, 3)", 0.7), ("f || c || '市江北区河冬路' || substr(r, 7)", "f || c || '市江北区河冬路' || substr(r, 7)", 0.95), ("f || c || '市江北区式中路' || substr(r, 7)", "f || c || '市江北区式中路' || substr(r, 7)", 0.95), ("f || c || '市曲阜路' || substr(r, 7)", "f || c || '市曲阜路' || substr(r, 7)", 0.95)],
    ),
}
# a date without a leading zero in the month and with only the last digit of the day, which is no date if that is 0
CASES["date"][1][2] = (CASES["date"][1][2][0], "substr(v, 1, 8) || '0' || CAST(CAST(substr(v, 9, 2) AS INT) % 10 AS {str})", 0.9)
SPARK, DUCK = {"str": "STRING", "div": "DIV"}, {"str": "VARCHAR", "div": "//"}
FIELDS = tuple(CASES)


def case_sql(field: str, dialect: dict[str, str]) -> str:
    """(id, field, k, variant, value, want, sure, _pos) of a field."""
    source, cases = CASES[field]
    n, at = len(cases), FIELDS.index(field)
    pick = lambda j: "CASE CAST(k % {n} AS INT) ".replace("{n}", str(n)) + " ".join(f"WHEN {i} THEN {c[j]}" for i, c in enumerate(cases)) + " END"
    sure = "CASE CAST(k % {n} AS INT) ".replace("{n}", str(n)) + " ".join(f"WHEN {i} THEN CAST({c[2]} AS DOUBLE)" for i, c in enumerate(cases)) + " END"
    text = f"SELECT '{field}-' || CAST(k AS {{str}}) AS id, '{field}' AS field, CAST(k % {n} AS INT) AS variant, {pick(0)} AS value, {pick(1)} AS want, {sure} AS sure, CAST(k * {len(FIELDS)} + {at} AS BIGINT) AS _pos FROM ({source}) src"
    return text.format(**dialect)


def cases(dialect: dict[str, str], fields=FIELDS) -> str:
    text = " UNION ALL ".join(case_sql(f, dialect) for f in fields)
    short = "field = 'date' AND variant = 2"
    sure = f"CASE WHEN {short} AND want LIKE '%-00' THEN CAST(0.1 AS DOUBLE) WHEN {short} AND value = want THEN CAST(0.95 AS DOUBLE) ELSE sure END"
    return f"SELECT id, field, variant, value, CASE WHEN {short} AND want LIKE '%-00' THEN value ELSE want END AS want, {sure} AS sure, _pos FROM ({text}) every"


def dirty(spark: SparkSession, sf_dir: str, fields=FIELDS) -> DataFrame:
    """(id, field, variant, value, _pos): the dirty values alone."""
    for t in ("customer", "orders", "supplier"):
        spark.read.parquet(f"{sf_dir}/{t}.parquet").createOrReplaceTempView(t)
    return spark.sql(cases(SPARK, fields)).drop("want", "sure")


def normalized(*fields: str):
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        return normalize_rows(dirty(spark, sf_dir, fields), fields[0] if len(fields) == 1 else None).select("id", "value", "normalized", "confidence")

    return query, f"SELECT id, value, want AS normalized, sure AS confidence FROM ({cases(DUCK, fields)}) c"


def audited(plan, sql: str, fields=FIELDS):
    return (lambda spark, sf_dir: plan(audit.changes(dirty(spark, sf_dir, fields)))), sql.format(cases=f"({cases(DUCK, fields)}) c")


BAND = "CASE sure WHEN 0.95 THEN '0.95' WHEN 0.9 THEN '0.9' WHEN 0.7 THEN '0.7' WHEN 0.1 THEN '0.1' ELSE 'other' END"
REASON = "CASE sure WHEN 0.95 THEN 'clean' WHEN 0.9 THEN 'structural' WHEN 0.7 THEN 'infer' WHEN 0.1 THEN 'none' ELSE 'other' END"
COUNTS = "count(*) AS total, count(*) FILTER (value <> want) AS changed, count(*) FILTER (value = want) AS unchanged"


def rolled_back(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = stage(dirty(spark, sf_dir, ("phone", "amount")), "audit-rows")
    cleaned = stage(audit.apply(rows), "audit-cleaned")
    return audit.rollback(cleaned, rows, audit.checksum(rows, cleaned)).select("id", "value")


def routed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return routing.route(dirty(spark, sf_dir)).groupBy("field", "bucket").agg(F.count("*").alias("n"))


def model(value: str, field: str) -> tuple[str, float]:
    return value + "?", 0.85


def routed_with_budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    return routing.route(dirty(spark, sf_dir, ("phone",)), llm_fn=model, llm_max_calls=50).select("id", "bucket", "value", F.col("_before").alias("before"))


def routed_steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return routing.route(dirty(spark, sf_dir), max_steps=4000).groupBy("bucket").agg(F.count("*").alias("n"))


CODES = "SELECT CAST(c_custkey AS BIGINT) AS _pos, 'code' AS field, CASE WHEN c_custkey % 3 = 0 THEN md5(CAST(c_custkey {div} 2 AS {str})) ELSE substr(md5(CAST(c_custkey {div} 2 AS {str})), 1, 31) || 'z' END AS value FROM customer"
BRAND = "translate(substr(md5(CAST(s_suppkey {div} 2 AS {str})), 1, 8), '0123456789abcdef', '甲乙丙丁戊己庚辛壬癸子丑寅卯辰巳')"
FIRMS = f"SELECT s_suppkey AS _pos, 'company' AS field, CASE WHEN s_suppkey % 2 = 0 THEN '嘉兴' ELSE '' END || {BRAND} || '贸易集团有限公司' AS value FROM supplier"
#: Characters that no normalizer knows, so that two keys share none.
UNKNOWN = [c for c in map(chr, range(0x5200, 0x9E00)) if c not in set("".join(d.PERSON_TYPOS) + "".join(d.PERSON_TYPOS.values()) + "".join(map("".join, PLACES)) + "".join(d.ADDRESS_WORDS | d.DIRECTION_WORDS) + "".join(d.ADDRESS_TYPOS) + "".join(d.SURNAMES) + "".join(d.TITLES) + "贵州省贵阳市云岩区路号")]
SIGNS = [f"substr('{''.join(UNKNOWN[j * 2000 : j * 2000 + p])}', CAST(s_suppkey {{div}} 2 % {p} AS INT) + 1, 1)" for j, p in enumerate((1999, 1997, 1993, 1987, 1979, 1973, 1951, 1949))]
PEOPLE = f"SELECT s_suppkey AS _pos, 'person' AS field, {cell(SURNAMES, f's_suppkey {{div}} 2 % {len(SURNAMES)}')} || {SIGNS[0]} || CASE WHEN s_suppkey % 2 = 0 THEN {SIGNS[1]} ELSE '' END AS value FROM supplier"
HOUSES = f"SELECT s_suppkey AS _pos, 'address' AS field, CASE WHEN s_suppkey % 2 = 0 THEN '贵州省' ELSE '' END || '贵阳市云岩区' || {' || '.join(SIGNS[2:])} || '路1号' AS value FROM supplier"
ADAPTIVE = " UNION ALL ".join(f"SELECT _pos * 3 + {n} AS _pos, field, value, _pos {{div}} 2 AS pair FROM ({text}) t{n}" for n, text in enumerate((PEOPLE, FIRMS, HOUSES)))


def grouped(text: str, table: str, group):
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        spark.read.parquet(f"{sf_dir}/{table}.parquet").createOrReplaceTempView(table)
        return group(spark.sql(text.format(**SPARK))).select("_pos", "value", F.col("_group").cast("long").alias("_group"))

    return query


def group_sql(text: str, key: str) -> str:
    return f"SELECT _pos, value, (dense_rank() OVER (ORDER BY first) - 1)::BIGINT AS _group FROM (SELECT *, min(_pos) OVER (PARTITION BY {key}) AS first FROM ({text.format(**DUCK)}) v) w"


#: JSON values of all kinds: text, whole numbers, null, lists, numbers with a zero decimal, true, objects.
NOT_TEXT = "SELECT CAST(c_custkey AS BIGINT) AS _pos, CAST(c_custkey % 7 AS INT) AS kind, CAST(c_custkey % 20 AS {str}) AS n, CASE CAST(c_custkey % 7 AS INT) WHEN 0 THEN '\"' || CAST(c_custkey % 20 AS {str}) || '\"' WHEN 1 THEN CAST(c_custkey % 20 AS {str}) WHEN 2 THEN 'null' WHEN 3 THEN '[1]' WHEN 4 THEN CAST(c_custkey % 20 AS {str}) || '.0' WHEN 5 THEN 'true' ELSE '{{\"a\": 1}}' END AS value FROM customer"


def not_text_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    spark.read.parquet(f"{sf_dir}/customer.parquet").createOrReplaceTempView("customer")
    raw = spark.sql(NOT_TEXT.format(**SPARK)).select("_pos", F.col("_pos").alias("line"), F.concat(F.lit('{"field": "other", "value": '), "value", F.lit("}")).alias("raw"))
    rows = files.parsed_rows(raw).withColumn("_pos", F.col("line"))
    return dedupe.dedupe_exact(rows).select("_pos", F.col("_group").cast("long").alias("_group"))


def exact_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedupe.dedupe_exact(dirty(spark, sf_dir, ("person", "company", "phone"))).select("id", F.col("_group").cast("long").alias("_group"))


def statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedupe.group_statistics(dedupe.dedupe_exact(dirty(spark, sf_dir, ("person", "company"))))


def ratios(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Beginnings of a text against all of it: whole ones, and ones after whose first half something stands that it has not."""
    t = spark.read.parquet(f"{sf_dir}/customer.parquet")
    a, n = F.md5(F.col("c_custkey").cast("string")), (F.col("c_custkey") % 15 + 1).cast("int")
    t = t.select("c_custkey", a.alias("a"), F.substr(a, F.lit(1), (F.col("c_custkey") % 31 + 1).cast("int")).alias("b"), F.concat(F.substr(a, F.lit(1), n), F.repeat(F.lit("z"), n)).alias("spoilt"))
    pair = lambda scorer, b: similarity.scored(scorer, F.col("a"), F.col(b))
    return t.select("c_custkey", pair(similarity.ratio, "b").alias("ratio"), pair(similarity.ratio_or_partial, "b").alias("with_partial"), pair(similarity.ratio, "spoilt").alias("spoilt_ratio"), pair(similarity.partial_ratio, "spoilt").alias("spoilt_partial"), pair(similarity.same_initial_ratio, "spoilt").alias("spoilt_same_initial"))


HEADER = ["编号", "phone", "email", "备注"]
SHEET = "SELECT CAST(p.k AS {str}) AS c0, p.value AS c1, p.want AS w1, p.sure AS s1, e.value AS c2, e.want AS w2, e.sure AS s2, 'n,' || CAST(p.k % 3 AS {str}) AS c3, p.k AS _pos FROM (SELECT *, CAST(substr(id, 7) AS BIGINT) AS k FROM ({phone}) x) p JOIN (SELECT *, CAST(substr(id, 7) AS BIGINT) AS k FROM ({email}) y) e ON p.k = e.k"


def sheet(dialect: dict[str, str]) -> str:
    return SHEET.format(**dialect, phone=cases(dialect, ("phone",)), email=cases(dialect, ("email",)))


def sheet_rows(spark: SparkSession, sf_dir: str, more: str = "") -> DataFrame:
    spark.read.parquet(f"{sf_dir}/customer.parquet").createOrReplaceTempView("customer")
    return spark.sql(sheet(SPARK)).select("_pos", F.array("c0", "c1", "c2", "c3").alias("cells"))


def sheet_clean(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = tables.clean_cells(sheet_rows(spark, sf_dir), HEADER, tables.column_map(HEADER))
    return out.select("_pos", *[F.get("clean", F.lit(j)).alias(f"c{j}") for j in range(4)])


def sheet_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    mapping = tables.column_map(HEADER)
    return tables.cell_report(tables.clean_cells(sheet_rows(spark, sf_dir), HEADER, mapping), HEADER, mapping)


def sheet_deduped(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A table of firms and, after it, every third row once more with spaces in the name; the first row of each firm stays."""
    spark.read.parquet(f"{sf_dir}/supplier.parquet").createOrReplaceTempView("supplier")
    firms = spark.sql(FIRMS.format(**SPARK))
    rows = firms.select("_pos", F.array(F.col("_pos").cast("string"), "value").alias("cells"))
    again = firms.where("_pos % 3 = 0").select((F.col("_pos") + 1_000_000).alias("_pos"), F.array(F.lit("x"), F.concat(F.lit(" "), "value"), F.lit("over")).alias("cells"))
    return tables.clean_table(rows.unionByName(again), ["编号", "firm"], {"firm": "company"}, dedupe=True)["rows"].select("_pos")


def evaluated(spark: SparkSession, sf_dir: str) -> DataFrame:
    for t in ("customer", "orders", "supplier"):
        spark.read.parquet(f"{sf_dir}/{t}.parquet").createOrReplaceTempView(t)
    rows = spark.sql(cases(SPARK)).select("field", "value", F.col("want").alias("truth"), F.concat(F.lit("v"), "variant").alias("perturbation"))
    shifted = F.when(F.col("perturbation") == "v4", F.concat("truth", F.lit("!"))).otherwise(F.col("truth"))
    return evaluate.rollups(evaluate.scored(rows.withColumn("truth", shifted))).select("field", "perturbation", "correct", "total", "rate")


PAIR_ROWS = "SELECT CAST(c_custkey AS BIGINT) AS _pos, CAST(c_custkey % 100 AS {str}) AS id, 'code' AS field, md5(CAST(c_custkey % 150 AS {str})) AS value, 'train' AS split FROM customer"


def pair_scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    spark.read.parquet(f"{sf_dir}/customer.parquet").createOrReplaceTempView("customer")
    return evaluate.pair_scores(dedupe.dedupe_exact(spark.sql(PAIR_ROWS.format(**SPARK))))


#: Ten characters from a key's fifth part, each of a set of its own; a prime of keys apart, two keys share one of them.
PRIMES = (1999, 1997, 1993, 1987, 1979, 1973, 1951, 1949, 1933, 1931)
MARKS = [f"substr('{''.join(chr(0x4E00 + 2000 * j + i) for i in range(p))}', CAST(c_custkey {{div}} 5 % {p} AS INT) + 1, 1)" for j, p in enumerate(PRIMES)]
#: (value, the grid's highest threshold at which it joins the first variant)
SWEPT = [("h || i || j", 1.0), ("h || i || j || 'A'", 0.95), ("h || i || 'B'", 0.9), ("h || i || 'CD'", 0.85), ("h || 'EF'", 0.8)]
SWEEP_ROWS = f"SELECT CAST(c_custkey AS BIGINT) AS _pos, CAST(c_custkey {{div}} 4 AS {{str}}) AS id, 'code' AS field, CASE CAST(c_custkey % 5 AS INT) {' '.join(f'WHEN {v} THEN {text}' for v, (text, _) in enumerate(SWEPT))} END AS value, 'train' AS split FROM (SELECT c_custkey, {' || '.join(MARKS[:8])} AS h, {MARKS[8]} AS i, {MARKS[9]} AS j FROM customer) m"


def swept(spark: SparkSession, sf_dir: str) -> DataFrame:
    spark.read.parquet(f"{sf_dir}/customer.parquet").createOrReplaceTempView("customer")
    return evaluate.threshold_sweep(stage(spark.sql(SWEEP_ROWS.format(**SPARK)), "sweep-rows"))[1]


def chosen_threshold(spark: SparkSession, sf_dir: str) -> DataFrame:
    spark.read.parquet(f"{sf_dir}/customer.parquet").createOrReplaceTempView("customer")
    best = evaluate.threshold_sweep(stage(spark.sql(SWEEP_ROWS.format(**SPARK)), "sweep-rows"))[0]
    return spark.range(1).select(F.lit(best).cast("double").alias("threshold"))


SWEEP_SQL = f"""
WITH r AS (SELECT t::DOUBLE AS threshold, c_custkey // 4 AS id, c_custkey // 5 * 5 + CASE WHEN CASE c_custkey % 5 {' '.join(f'WHEN {v} THEN {near}' for v, (_, near) in enumerate(SWEPT))} END >= t THEN 0 ELSE c_custkey % 5 END AS value FROM customer, (VALUES {', '.join(f'({t})' for t in evaluate.GRID)}) v(t)),
cells AS (SELECT threshold, id, value, count(*) AS n FROM r GROUP BY ALL),
s AS (SELECT threshold, sum(n * (n - 1) // 2)::BIGINT AS tp FROM cells GROUP BY threshold),
a AS (SELECT threshold, sum(n * (n - 1) // 2)::BIGINT AS true_pairs FROM (SELECT threshold, sum(n) AS n FROM cells GROUP BY threshold, id) GROUP BY threshold),
b AS (SELECT threshold, sum(n * (n - 1) // 2)::BIGINT AS pred_pairs FROM (SELECT threshold, sum(n) AS n FROM cells GROUP BY threshold, value) GROUP BY threshold),
rates AS (SELECT *, CASE WHEN pred_pairs > 0 THEN tp / pred_pairs ELSE 0.0 END AS p, CASE WHEN true_pairs > 0 THEN tp / true_pairs ELSE 0.0 END AS r FROM s JOIN a USING (threshold) JOIN b USING (threshold))
"""
PAIR_SQL = """
WITH r AS ({rows}), cells AS (SELECT id, value, count(*) AS n FROM r GROUP BY ALL),
s AS (SELECT 'code' AS field, (SELECT sum(n * (n - 1) // 2) FROM cells)::BIGINT AS tp, (SELECT sum(n * (n - 1) // 2) FROM (SELECT sum(n) AS n FROM cells GROUP BY id))::BIGINT AS true_pairs, (SELECT sum(n * (n - 1) // 2) FROM (SELECT sum(n) AS n FROM cells GROUP BY value))::BIGINT AS pred_pairs),
rates AS (SELECT *, CASE WHEN pred_pairs > 0 THEN tp / pred_pairs ELSE 0.0 END AS p, CASE WHEN true_pairs > 0 THEN tp / true_pairs ELSE 0.0 END AS r FROM s)
"""
RATES = "tp, true_pairs, pred_pairs, round(p, 6) AS precision, round(r, 6) AS recall, round(CASE WHEN p + r > 0 THEN 2 * p * r / (p + r) ELSE 0.0 END, 6) AS f1"


def split_held_out(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = dirty(spark, sf_dir, ("person", "phone", "company")).select("id", "field")
    return evaluate.split_rows(rows, rows_per_range=200).select("field", "id", "split")


def perturbed_back(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of the perturbations that lose nothing, how many values come back, by field and kind."""
    spark.read.parquet(f"{sf_dir}/customer.parquet").createOrReplaceTempView("customer")
    clean = spark.sql(cases(SPARK, ("phone", "idcard"))).where("sure > 0.1").select("id", "field", F.col("want").alias("value"))
    results = evaluate.scored(evaluate.perturbed(clean)).where("perturbation IN ('space', 'sep', 'noise')")
    return results.groupBy("field", "perturbation").agg(F.count_if("ok").alias("correct"), F.count("*").alias("total"))


def lines_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows written as JSON lines, read again, cleaned, written with their keys added, and read once more."""
    path = scratch_path(spark, "jsonl")
    rows = dirty(spark, sf_dir, ("phone", "amount")).select("_pos", F.to_json(F.struct("id", "field", "value", F.lit("甲").alias("more"))).alias("text"))
    files.write_lines(rows, path + "-in")
    cleaned = normalize_rows(files.read_rows(spark, path + "-in"))
    files.write_lines(cleaned.select("_pos", files.spliced(F.col("raw"), normalized=files.json_text(F.col("normalized")), confidence=files.json_text(F.col("confidence"))).alias("text")), path + "-out")
    return spark.read.schema("id string, field string, value string, more string, normalized string, confidence double").json(path + "-out")


def lines_cleaned_again(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines that have the keys already, first, last and twice cleaned; each key is there once in the end."""
    rows = dirty(spark, sf_dir, ("phone",)).withColumn("line", F.col("_pos"))
    for _ in range(2):
        old = [F.lit("old").alias("normalized"), "id", "field", "value", F.lit(True).alias("confidence")]
        raw = rows.select("line", F.to_json(F.struct(*old)).alias("raw")) if "raw" not in rows.columns else rows.select("line", "raw")
        done = normalize_rows(files.parsed_rows(raw))
        rows = stage(done.select("line", files.spliced(F.col("raw"), normalized=files.json_text(F.col("normalized")), confidence=files.json_text(F.col("confidence"))).alias("raw")), "cleaned-again")
    read = F.from_json("raw", "id string, normalized string, confidence double")
    return rows.select(read.alias("row"), F.regexp_count("raw", F.lit('"normalized"')).alias("n_normalized")).select("row.*", "n_normalized")


def sheet_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "csv")
    head = spark.createDataFrame([(-1, HEADER)], "_pos long, cells array<string>")
    files.write_lines(head.unionByName(sheet_rows(spark, sf_dir)).select("_pos", files.csv_line(F.col("cells")).alias("text")), path)
    header, rows = files.read_cells(spark, path)
    return rows.select(*[F.get("cells", F.lit(j)).alias(f"c{j}") for j in range(len(header))])


def streamed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The phone rows as a stream from files, normalized by the expressions that tables take, into a table."""
    from ..streaming.normalize import normalize_stream

    path = scratch_path(spark, "stream")
    dirty(spark, sf_dir, ("phone",)).select("id", "field", "value").write.parquet(path + "-in")
    stream = spark.readStream.schema("id string, field string, value string").parquet(path + "-in")
    normalize_stream(stream).writeStream.format("parquet").option("path", path + "-out").option("checkpointLocation", path + "-state").trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(path + "-out").select("id", "value", "normalized", "confidence")


def run_stream(spark: SparkSession, rows: DataFrame, schema: str, plan, mode: str) -> DataFrame:
    """The plan over the rows as a stream from files, its last result as a table."""
    path = scratch_path(spark, "stream")
    rows.write.parquet(path + "-in")
    stream = plan(spark.readStream.schema(schema).parquet(path + "-in"))
    put = lambda batch, n: batch.write.mode("overwrite" if mode == "complete" else "append").parquet(path + "-out")
    stream.writeStream.outputMode(mode).foreachBatch(put).option("checkpointLocation", path + "-state").trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(path + "-out")


def windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Changes of the date rows by weeks of their keys, as minutes after the epoch, counted in a stream."""
    from ..streaming.normalize import changes_by_window

    rows = dirty(spark, sf_dir, ("phone", "email")).select(F.timestamp_seconds(F.col("_pos") * 60).alias("at"), "field", "value")
    found = run_stream(spark, rows, "at timestamp, field string, value string", lambda r: changes_by_window(r, "at", "1 hour", "2 hours"), "complete")
    return found.select((F.unix_timestamp(F.col("window.start")) / 7200).cast("long").alias("nth"), "field", "total", "changed")


def first_of_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..streaming.normalize import first_seen

    rows = dirty(spark, sf_dir, ("person",)).select(F.timestamp_seconds(F.col("_pos")).alias("at"), "field", "value")
    return run_stream(spark, rows, "at timestamp, field string, value string", lambda r: first_seen(r, "at", "365 days"), "append").select("field", "normalized")


def drawn(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clean values of every field, one for each supplier: how many, how many distinct, and how many that the normalizers call clean.

    There are 19,152 dates to draw, and 21,204 that could be clean; with more suppliers, dates come more than once.
    """
    rows = stage(normalize_rows(generate.clean_values(spark, suppliers(spark, sf_dir), repeats=True)), "drawn")
    return rows.groupBy("field").agg(F.count("*").alias("n"), F.count_distinct("value").alias("different"), F.count_if((F.col("confidence") == 0.95) & (F.col("normalized") == F.col("value"))).alias("clean"))


def suppliers(spark: SparkSession, sf_dir: str) -> int:
    return spark.read.parquet(f"{sf_dir}/supplier.parquet").count()


def drawn_and_spoilt(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Variants of drawn values that come back, for the cells in which all or none have to."""
    spoilt = stage(generate.dirty_values(stage(generate.clean_values(spark, suppliers(spark, sf_dir), repeats=True), "drawn")), "spoilt")
    cells = stage(evaluate.rollups(stage(evaluate.scored(spoilt), "scored")), "cells")
    sure = F.col("perturbation").isin("space", "sep", "noise") | F.col("field").isin("phone", "amount", "idcard") | F.concat_ws("/", "field", "perturbation").isin("person/abbrev", "email/abbrev", "date/typo")
    return cells.where(F.col("field").isNotNull() & F.col("perturbation").isNotNull() & sure).select("field", "perturbation", "correct", "total")


def sets_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Drawn sets, written and read again as rows for scoring duplicates, counted."""
    path = scratch_path(spark, "sets")
    clean, spoilt = generate.build(spark, suppliers(spark, sf_dir), fields=benchmark.PAIR_FIELDS)
    benchmark.write_sets(clean, path + "/clean", benchmark.PAIR_FIELDS)
    benchmark.write_sets(spoilt, path + "/dirty", benchmark.PAIR_FIELDS)
    parts = [benchmark.load_pairs(spark, path + "/clean", path + "/dirty", s) for s in benchmark.SPLITS]
    return parts[0].unionByName(parts[1]).groupBy("field", "kind", "split").agg(F.count("*").alias("n"))


def wrong_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    spark.read.parquet(f"{sf_dir}/customer.parquet").createOrReplaceTempView("customer")
    grouped = stage(dedupe.dedupe_exact(spark.sql(PAIR_ROWS.format(**SPARK))), "pair-groups")
    return evaluate.error_pairs(grouped).select("type", "a", "b", "id_a", "id_b", "value_a", "value_b")


DRAWN = "(SELECT count(*) FROM supplier)"
FIELD_VALUES = ", ".join(f"('{f}')" for f in generate.FIELDS)
WRONG = "SELECT '{kind}' AS type, a._pos AS a, b._pos AS b, a.id AS id_a, b.id AS id_b, a.value AS value_a, b.value AS value_b FROM r a JOIN r b ON a.{same} = b.{same} AND a.{other} <> b.{other} AND a._pos < b._pos ORDER BY a._pos, b._pos LIMIT 50"

QUERIES, ORACLES = {}, {}


def add(name: str, query, sql: str) -> None:
    QUERIES[name], ORACLES[name] = query, sql


for one in FIELDS:
    add(f"norm_{one}", *normalized(one))
add("norm_dispatch", *normalized(*FIELDS))
add("audit_totals", *audited(audit.totals, f"SELECT {COUNTS} FROM {{cases}}"))
add("audit_by_field", *audited(lambda c: audit.by_field(c).drop("first_pos"), f"SELECT field, {COUNTS} FROM {{cases}} GROUP BY field"))
add("audit_by_confidence", *audited(audit.by_confidence, f"SELECT band, count(b) AS n FROM (VALUES ('0.95'), ('0.9'), ('0.7'), ('0.1'), ('other')) v(band) LEFT JOIN (SELECT {BAND} AS b FROM {{cases}}) x ON b = band GROUP BY band"))
add("audit_changes_top", *audited(audit.change_list, f"SELECT id, field, value AS before, want AS after, sure AS confidence, {REASON} AS reason FROM {{cases}} WHERE value <> want ORDER BY _pos LIMIT 1000"))
add("apply_before", lambda spark, sf_dir: audit.apply(dirty(spark, sf_dir, ("phone", "email"))).select("id", "value", F.col("_before").alias("before")), f"SELECT id, want AS value, CASE WHEN value <> want THEN value END AS before FROM ({cases(DUCK, ('phone', 'email'))}) c")
add("rollback_roundtrip", rolled_back, f"SELECT id, value FROM ({cases(DUCK, ('phone', 'amount'))}) c")
add("route_buckets", routed, f"SELECT field, CASE WHEN sure >= 0.2 THEN 'cleaned' WHEN value <> want THEN 'hitl' ELSE 'unchanged' END AS bucket, count(*) AS n FROM ({cases(DUCK)}) c GROUP BY ALL")
add("route_llm_budget", routed_with_budget, f"SELECT id, CASE WHEN sure >= 0.2 OR nth <= 50 THEN 'cleaned' ELSE 'hitl' END AS bucket, CASE WHEN sure >= 0.2 THEN want WHEN nth <= 50 THEN value || '?' ELSE value END AS value, CASE WHEN sure >= 0.2 AND value <> want OR sure < 0.2 AND nth <= 50 THEN value END AS before FROM (SELECT *, row_number() OVER (PARTITION BY sure < 0.2 ORDER BY _pos) AS nth FROM ({cases(DUCK, ('phone',))}) c) d")
add("route_max_steps", routed_steps, f"SELECT CASE WHEN sure >= 0.2 THEN 'cleaned' WHEN value <> want THEN 'hitl' ELSE 'unchanged' END AS bucket, count(*) AS n FROM ({cases(DUCK)}) c WHERE _pos < 4000 GROUP BY ALL")
add("dedupe_exact", exact_groups, f"SELECT id, (dense_rank() OVER (ORDER BY first) - 1)::BIGINT AS _group FROM (SELECT *, min(_pos) OVER (PARTITION BY field, want) AS first FROM ({cases(DUCK, ('person', 'company', 'phone'))}) c) d")
add("dedupe_plain", grouped(CODES, "customer", dedupe.dedupe), group_sql(CODES, "substr(value, 1, 31)"))
add("dedupe_adaptive", grouped(ADAPTIVE, "supplier", dedupe.dedupe_adaptive), group_sql(ADAPTIVE, "field, pair"))
add("dedupe_non_text", not_text_groups, group_sql(NOT_TEXT, "CASE kind WHEN 0 THEN 't' || n WHEN 1 THEN 'n' || n WHEN 2 THEN 'null' WHEN 3 THEN 'row' || _pos WHEN 4 THEN 'n' || n WHEN 5 THEN 'n1' ELSE 'row' || _pos END").replace("SELECT _pos, value,", "SELECT _pos,"))
add("jsonl_renormalized", lines_cleaned_again, f"SELECT id, want AS normalized, sure AS confidence, 1 AS n_normalized FROM ({cases(DUCK, ('phone',))}) c")
add("dedupe_group_stats", statistics, f"SELECT sum(n)::BIGINT AS rows, count(*) AS groups, count(*) FILTER (n > 1) AS multi, sum(n - 1)::BIGINT AS removable FROM (SELECT count(*) AS n FROM ({cases(DUCK, ('person', 'company'))}) c GROUP BY field, want) d")
add("similarity_ratio", ratios, "SELECT c_custkey, 2.0::DOUBLE * (c_custkey % 31 + 1) / (32 + c_custkey % 31 + 1) AS ratio, 1.0::DOUBLE AS with_partial, 2.0::DOUBLE * n / (32 + 2 * n) AS spoilt_ratio, 2.0::DOUBLE * n / (2 * n + n) AS spoilt_partial, 2.0::DOUBLE * n / (32 + 2 * n) AS spoilt_same_initial FROM (SELECT c_custkey, c_custkey % 15 + 1 AS n FROM customer) c")
add("table_clean", sheet_clean, f"SELECT _pos, c0, w1 AS c1, w2 AS c2, c3 FROM ({sheet(DUCK)}) s")
add("table_report", sheet_report, f"SELECT 'phone' AS field, count(*) FILTER (c1 <> w1) AS changed, count(*) FILTER (c1 = w1) AS unchanged, count(*) FILTER (s1 < 0.2) AS hitl FROM ({sheet(DUCK)}) s UNION ALL SELECT 'email', count(*) FILTER (c2 <> w2), count(*) FILTER (c2 = w2), count(*) FILTER (s2 < 0.2) FROM ({sheet(DUCK)}) s")
add("eval_grouping_sets", evaluated, f"SELECT field, 'v' || variant AS perturbation, count(*) FILTER (variant <> 4) AS correct, count(*) AS total, round(count(*) FILTER (variant <> 4) / count(*), 6) AS rate FROM ({cases(DUCK)}) c GROUP BY GROUPING SETS ((field, perturbation), (field), (perturbation), ())")
add("eval_pair_prf", pair_scored, PAIR_SQL.format(rows=PAIR_ROWS.format(**DUCK)) + f"SELECT field, {RATES} FROM rates UNION ALL SELECT NULL, {RATES} FROM rates")
add("eval_threshold_sweep", swept, SWEEP_SQL + f"SELECT threshold, {RATES} FROM rates")
add("split_heldout", split_held_out, f"SELECT field, id, CASE WHEN row_number() OVER (PARTITION BY field ORDER BY ('0x' || substr(md5('42:' || id), 1, 15))::BIGINT, id) <= round(count(*) OVER (PARTITION BY field) * 0.2) THEN 'heldout' ELSE 'train' END AS split FROM ({cases(DUCK, ('person', 'phone', 'company'))}) c")
add("perturb_variants", perturbed_back, f"SELECT field, p AS perturbation, count(*) AS correct, count(*) AS total FROM ({cases(DUCK, ('phone', 'idcard'))}) c, (VALUES ('space'), ('sep'), ('noise')) v(p) WHERE sure > 0.1 GROUP BY ALL")
add("jsonl_roundtrip", lines_round_trip, f"SELECT id, field, value, '甲' AS more, want AS normalized, sure AS confidence FROM ({cases(DUCK, ('phone', 'amount'))}) c")
add("csv_roundtrip", sheet_round_trip, f"SELECT c0, c1, c2, c3 FROM ({sheet(DUCK)}) s")
add("stream_normalize", streamed, f"SELECT id, value, want AS normalized, sure AS confidence FROM ({cases(DUCK, ('phone',))}) c")
add("eval_threshold_choice", lambda spark, sf_dir: chosen_threshold(spark, sf_dir), SWEEP_SQL + "SELECT threshold FROM rates ORDER BY round(CASE WHEN p + r > 0 THEN 2 * p * r / (p + r) ELSE 0.0 END, 6) DESC, threshold LIMIT 1")
add("stream_changes_by_window", windows, f"SELECT _pos // 120 AS nth, field, count(*) AS total, count(*) FILTER (value <> want) AS changed FROM ({cases(DUCK, ('phone', 'email'))}) c GROUP BY ALL")
add("stream_first_seen", first_of_stream, f"SELECT DISTINCT field, want AS normalized FROM ({cases(DUCK, ('person',))}) c")
add("table_dedupe", sheet_deduped, f"SELECT min(_pos) AS _pos FROM ({FIRMS.format(**DUCK)}) f GROUP BY replace(value, '嘉兴', '')")
add("generate_clean", drawn, f"SELECT field, {DRAWN}::BIGINT AS n, {DRAWN}::BIGINT AS different, {DRAWN}::BIGINT AS clean FROM (VALUES {FIELD_VALUES}) f(field)")
add("generate_variants", drawn_and_spoilt, f"SELECT field, p AS perturbation, CASE WHEN p = 'abbrev' AND field IN ('person', 'email') OR p = 'sep' AND field = 'email' THEN 0 ELSE {DRAWN} END::BIGINT AS correct, {DRAWN}::BIGINT AS total FROM (VALUES {FIELD_VALUES}) f(field), (VALUES ('space'), ('typo'), ('abbrev'), ('sep'), ('noise')) v(p) WHERE p IN ('space', 'sep', 'noise') OR field IN ('phone', 'amount', 'idcard') OR field || '/' || p IN ('person/abbrev', 'email/abbrev', 'date/typo')")
add("benchmark_sets", sets_round_trip, f"SELECT field, kind, split, (CASE split WHEN 'heldout' THEN round({DRAWN} * 0.2) ELSE {DRAWN} - round({DRAWN} * 0.2) END * CASE kind WHEN 'clean' THEN 1 ELSE 5 END)::BIGINT AS n FROM (VALUES ('person'), ('address'), ('phone'), ('company')) f(field), (VALUES ('clean'), ('dirty')) k(kind), (VALUES ('heldout'), ('train')) s(split)")
add("eval_error_pairs", wrong_pairs, f"WITH r AS ({PAIR_ROWS.format(**DUCK)}) (" + WRONG.format(kind="missed", same="id", other="value") + ") UNION ALL (" + WRONG.format(kind="wrong_merge", same="value", other="id") + ")")
