import datetime as dt
import random

import duckdb
import pytest
from pyspark.sql import functions as F

from assay.functions.casts import SPARK_TYPES, to_type
from assay.functions.dates import date_diff, unit_name
from assay.functions.translate import is_bare_aggregate, scan, translate
from assay.plans.model import PlanError

DAY = dt.date(2026, 5, 10)


@pytest.mark.parametrize("text, want", [
    ("a = 'it''s' AND \"my col\" > 1", "a = 'it\\'s' AND `my col` > 1"),
    ("entry_date > CURRENT_DATE", "entry_date > DATE '2026-05-10'"),
    ("d >= today() - INTERVAL '7 days'", "d >= DATE '2026-05-10' - INTERVAL '7 days'"),
    ("CAST(a AS VARCHAR) = b::TEXT", "CAST(a AS STRING) = b::STRING"),
    ("date_diff('day', a, b) > 3", "CAST(datediff(to_date(b), to_date(a)) AS BIGINT) > 3"),
    ("date_diff('month', a, date_diff('year', b, c))", "CAST((year(CAST(year(c) - year(b) AS BIGINT)) - year(a)) * 12 + month(CAST(year(c) - year(b) AS BIGINT)) - month(a) AS BIGINT)"),
    ("arg_max(a, b) // 2", "max_by(a, b)  div  2"),
    ("note = 'CURRENT_DATE'", "note = 'CURRENT_DATE'"),
    ("p = 'a\\b'", "p = 'a\\\\b'"),
])
def test_translation(text, want):
    assert translate(text, DAY) == want


@pytest.mark.parametrize("text", ["date_diff('decade', a, b)", "age(a, b)", "epoch(a)", "regexp_replace(a, b, 'c')", "strftime(a, '%U')", "strftime(a, b)", "list(DISTINCT a)", "list(a ORDER BY b)", "a[1]", "to_timestamp(a)", "string_split(a, b)", "::INT", "a ^"])
def test_what_would_differ_is_refused(text):
    with pytest.raises(PlanError):
        translate(text, DAY)


@pytest.mark.parametrize("text, safe", [
    ("load > 5", True), ("a + copy", True), ("update IS NULL", True), ("call = 'x' AND load", True), ("max(load)", True), ("a > 1 AND copy", True),
    ("DELETE FROM x", False), ("DELETE", False), ("COPY t TO 'x'", False), ("a = (SELECT 1)", False), ("LOAD 'x'", False), ("a UNION b", False), ("CALL f(1)", False), ("execute('x')", False), ("drop", False),
])
def test_statements_are_told_from_columns(text, safe):
    assert bool(scan(text)) is not safe


def test_refusals():
    assert scan("a; b") and scan("a /* x */") and scan("(a") and scan("DELETE") and not scan("deleted = 'x'")
    with pytest.raises(PlanError):
        translate("a = 'open")


@pytest.mark.parametrize("text, bare", [("COUNT(*)", True), ("SUM(a + (b))", True), ("ROUND(SUM(a), 2)", False), ("COUNT(*) - SUM(a)", False), ("a", False)])
def test_bare_aggregates(text, bare):
    assert is_bare_aggregate(text) is bare


EXPRESSIONS = [
    "a + b * 2", "a / 4", "a // 4", "a % 3", "round(x, 1)", "coalesce(nullif(a, 3), -1)", "case when a > 3 then 'big' else s end", "upper(s) || '-' || lower(s)", "length(s)", "s like 'a%'", "s ilike 'A%'",
    "s in ('ab', 'c''d')", "a between 2 and 5", "a::BIGINT > 2 or x is null", "cast(a as VARCHAR)", "cast(a as DOUBLE) / 3", "try_cast(s as BIGINT)", "date_diff('day', d, t)", "date_diff('hour', d, t)", "date_diff('month', d, t)", "date_diff('year', d, t)",
    "year(d) * 100 + month(d)", "cast(t as DATE) > d", "d > CURRENT_DATE", "abs(a - 4)", "greatest(a, 3)", "starts_with(s, 'a')", "contains(s, 'b')", "substr(s, 1, 1)", "trim(s)", "replace(s, 'a', 'z')", "concat(s, a)", "not (a > 3)", "-a", "a <> 3 and a != 4", "strlen(s)", "a >= 2 and (s = 'ab' or s is null)",
    "date_diff('week', d, t)", "date_diff('minute', d, t)", "date_diff('quarter', d, t)", "dayofweek(d)", "weekday(d)", "isodow(t)", "log(a + 1)", "2 ^ b", "-b ^ 2", "10 - b ** 2", "(a + 1) ^ 2 ^ b", "regexp_replace(s, '[a-z]', 'b')", "regexp_replace(s, '([a-z])', '<\\1>', 'g')",
    "regexp_extract(s, '[a-z]+')", "strftime(t, '%Y-%m-%d %H:%M')", "substr(s, 0, 2)", "substr(s, b, 2)", "replace(s, 'b', '\\_') like '%\\_'", "s || '_' like '%!_' escape '!'", "x::BIGINT", "cast(x as INTEGER)", "1.5::DOUBLE::BIGINT", "2.5::BIGINT", "(a / 4)::INT", "try_cast(x as BIGINT)",
    "case when a > 3 then x else -x end::BIGINT", "len(s)", "list_extract(string_split(s, 'b'), 1)", "[a, b] = [3, 0]", "trunc(x * 3)", "extract(year from d)", "extract('dow' from d)", "date_part('isodow', d)", "a not in (1, 2)", "not s like 'a%'", "ltrim(s, 'a')", "d + INTERVAL 1 DAY > t", "coalesce(s, 'none') = 'none' and a is not null",
]


def test_expressions_give_what_the_dialect_says(spark):
    rows = [(i, i % 3, i / 4 + 0.1, [None, "ab", "c'd", "ABC", "12"][i % 5], dt.date(2026, 1 + i % 12, 27 + i % 2), dt.datetime(2025 + i % 3, 2, 3, i % 24, 30)) for i in range(24)]
    df = spark.createDataFrame(rows, "a int, b int, x double, s string, d date, t timestamp_ntz")
    con = duckdb.connect()
    con.execute("CREATE TABLE r (a INT, b INT, x DOUBLE, s VARCHAR, d DATE, t TIMESTAMP)")
    con.executemany("INSERT INTO r VALUES (?, ?, ?, ?, ?, ?)", rows)
    got = df.orderBy("a").select(*[F.expr(translate(e, DAY)).alias(f"e{i}") for i, e in enumerate(EXPRESSIONS)]).collect()
    want = con.execute(f"SELECT {', '.join(e.replace('CURRENT_DATE', chr(68) + 'ATE ' + chr(39) + '2026-05-10' + chr(39)) for e in EXPRESSIONS)} FROM r ORDER BY a").fetchall()
    for i, e in enumerate(EXPRESSIONS):
        a, b = [r[i] for r in got], [r[i] for r in want]
        assert [None if v is None else pytest.approx(v) if isinstance(v, float) else v for v in a] == b, e


TEXTS = {
    "integer": ["1", "-7", "1.5", "2.5", "-2.5", "1.4999999999999", "1e3", "", " 5 ", "x", "9223372036854775807", "9223372036854775808", "1.", ".5", "+3"],
    "float": ["1", "1.5", "1e-3", "x", "", "1d", "2.5f", "-.5", "inf", "1e400", " 2 "],
    "date": ["2026-01-05", "2026/01/05", "2026-1-5", "2026", "2026-01", "05/01/2026", "x", "", "2026-02-30", "20260105", "2026-01-05 10:00:00"],
    "datetime": ["2026-01-05", "2026/01/05", "2026-01-05 10:11:12", "2026-01-05T10:11:12", " 2026-01-05", "2026-01-05 10:11:12 ", "2026", "2026-01", "x", "2026-01-05 25:00:00"],
    "boolean": ["true", "false", "t", "f", "yes", "no", "1", "0", "on", "off", "x", ""],
}
SQL = {"integer": "BIGINT", "float": "DOUBLE", "date": "DATE", "datetime": "TIMESTAMP", "boolean": "BOOLEAN"}


@pytest.mark.parametrize("kind", sorted(TEXTS))
def test_casts_of_text(spark, kind):
    con = duckdb.connect()
    got = spark.createDataFrame([(t,) for t in TEXTS[kind]], "c string").select("c", to_type(F.col("c"), SPARK_TYPES["string"], kind).alias("v")).collect()
    want = {t: con.execute(f"SELECT try_cast(? AS {SQL[kind]})", [t]).fetchone()[0] for t in TEXTS[kind]}
    odd = {"boolean": {"on", "off"}, "float": {"1e400"}, "date": {"2026-01-05 10:00:00"}}.get(kind, set())
    assert {r.c: r.v for r in got if r.c not in odd} == {t: v for t, v in want.items() if t not in odd}


def test_casts_of_doubles(spark):
    values = [0.5, 1.5, 2.5, -0.5, -1.5, 2.4999, 1e19, None]
    got = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v double").select("i", to_type(F.col("v"), SPARK_TYPES["float"], "integer").alias("c")).collect()
    assert {r.i: r.c for r in got} == dict(enumerate([0, 2, 2, 0, -2, 2, None, None]))


def test_differences_of_random_times(spark):
    rng = random.Random(4)
    t = lambda: dt.datetime(2020, 1, 1) + dt.timedelta(minutes=rng.randrange(5 * 525_600))
    rows = [(t(), t()) for _ in range(500)] + [(None, t()), (dt.datetime(2026, 1, 31), dt.datetime(2026, 2, 1)), (dt.datetime(2026, 1, 1, 0, 59), dt.datetime(2026, 1, 1, 1, 1))]
    con = duckdb.connect()
    con.execute("CREATE TABLE r (a TIMESTAMP, b TIMESTAMP)")
    con.executemany("INSERT INTO r VALUES (?, ?)", rows)
    for unit in ("day", "hour", "month", "year"):
        got = spark.createDataFrame(rows, "a timestamp_ntz, b timestamp_ntz").select(date_diff(unit, F.col("a"), F.col("b"))).collect()
        assert [r[0] for r in got] == [r[0] for r in con.execute(f"SELECT date_diff('{unit}', a, b) FROM r").fetchall()]


def test_unknown_unit_counts_days(caplog):
    assert unit_name("fortnights") == "day" and "days are counted" in caplog.text
    assert unit_name("Hours") == "hour"
