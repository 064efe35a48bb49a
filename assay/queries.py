"""The engine's queries over the driver's tables, each with the SQL that an independent engine runs for the same rows.

Every query is a plan of the plan language, as a dict, and goes through validation, translation and planning like a user's.
"""

from __future__ import annotations

import datetime as dt
import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from assay.operators import Context
from assay.operators.base import expression
from assay.pipeline import run_control
from assay.plans.model import Group, control_from, plan_from
from assay.plans.planner import build, empty_result
from assay.results import all_violations, checks_evaluated, metrics, severity_summary
from assay.sources.store import ingest, scratch

AS_OF = dt.date(1996, 6, 30)
NOW = dt.datetime(2026, 1, 1)

SCHEMAS = {
    "customer": {"c_custkey": "integer", "c_name": "string", "c_acctbal": "float", "c_mktsegment": "string"},
    "texts": {"event_id": "integer", "as_int": "integer", "as_float": "float", "as_date": "date", "as_time": "datetime", "as_bool": "boolean", "event_type": "string"},
}


def _n(dataset: str, alias: str | None = None) -> dict:
    return {"type": "NORMALIZE", "dataset": dataset, "output_alias": alias or f"n_{dataset}"}


def _texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Text columns of events that casts read or not: numbers of several forms, dates with dashes and slashes, booleans."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    k = F.col("event_id") % 7
    number = F.col("event_id").cast("string")
    return e.select(
        number.alias("event_id"),
        F.when(k == 0, F.concat(number, F.lit(".5"))).when(k == 1, F.lit("n/a")).when(k == 2, F.concat(F.lit("-"), number)).otherwise(number).alias("as_int"),
        F.when(k == 0, F.lit("1.25e2")).when(k == 1, F.lit("1.5d")).when(k == 2, F.lit("")).otherwise(F.concat(number, F.lit(".25"))).alias("as_float"),
        F.when(k == 0, F.date_format("ts", "yyyy/MM/dd")).when(k == 1, F.lit("2026-13-01")).when(k == 2, F.lit("2026")).otherwise(F.date_format("ts", "yyyy-MM-dd")).alias("as_date"),
        F.when(k == 0, F.date_format("ts", "yyyy/MM/dd")).when(k == 1, F.lit("soon")).otherwise(F.date_format("ts", "yyyy-MM-dd HH:mm:ss")).alias("as_time"),
        F.when(k < 2, F.lit("yes")).when(k == 2, F.lit("maybe")).when(k == 3, F.lit("0")).otherwise(F.lit("true")).alias("as_bool"),
        F.concat(F.lit("  "), "event_type", F.lit(" ")).alias("event_type"),
    )


_TEXTS_SQL = """SELECT event_id::VARCHAR AS event_id,
  CASE event_id % 7 WHEN 0 THEN event_id || '.5' WHEN 1 THEN 'n/a' WHEN 2 THEN '-' || event_id ELSE event_id::VARCHAR END AS as_int,
  CASE event_id % 7 WHEN 0 THEN '1.25e2' WHEN 1 THEN '1.5d' WHEN 2 THEN '' ELSE event_id || '.25' END AS as_float,
  CASE event_id % 7 WHEN 0 THEN strftime(ts, '%Y/%m/%d') WHEN 1 THEN '2026-13-01' WHEN 2 THEN '2026' ELSE strftime(ts, '%Y-%m-%d') END AS as_date,
  CASE event_id % 7 WHEN 0 THEN strftime(ts, '%Y/%m/%d') WHEN 1 THEN 'soon' ELSE strftime(ts, '%Y-%m-%d %H:%M:%S') END AS as_time,
  CASE WHEN event_id % 7 < 2 THEN 'yes' WHEN event_id % 7 = 2 THEN 'maybe' WHEN event_id % 7 = 3 THEN '0' ELSE 'true' END AS as_bool,
  '  ' || event_type || ' ' AS event_type FROM events"""

_ORDERS_ITEMS = [_n("orders"), _n("lineitem"), {"type": "JOIN", "left": "n_orders", "right": "n_lineitem", "left_key": "o_orderkey", "right_key": "l_orderkey", "output_alias": "joined"}]
_DOC_LABELS = [_n("documents"), _n("labels")]


def _diff(unit: str, **more) -> list[dict]:
    return [*_ORDERS_ITEMS, {"type": "DATE_DIFF", "input": "joined", "from_field": "o_orderdate", "to_field": "l_shipdate", "unit": unit, "output_alias": "diffed", **more}]


def _diff_sql(expr: str, name: str, where: str = "") -> str:
    return f"SELECT o_orderkey, l_linenumber, {expr} AS {name} FROM orders JOIN lineitem ON o_orderkey = l_orderkey {where}"


#: name -> (steps, alias that is returned, columns to keep or None, SQL). A terminal's frame starts with result_type.
_PLANS: dict[str, tuple[list[dict], str, list[str] | None, str]] = {
    "flagship": (
        [_n("orders"), _n("customer"), {"type": "JOIN", "left": "n_orders", "right": "n_customer", "left_key": "o_custkey", "right_key": "c_custkey", "output_alias": "j"},
         {"type": "FILTER", "input": "j", "conditions": ["o_orderstatus = 'F'", "c_acctbal < 0"], "output_alias": "v", "check_id": "CHK-1"}],
        "v", None,
        "SELECT 'row_level' AS result_type, o.*, c_custkey, trim(c_name) AS c_name, c_acctbal, trim(c_mktsegment) AS c_mktsegment, 'CHK-1' AS check_id, 'Violation detected by CHK-1' AS reason, 'CHK-1' AS _check_id FROM orders o JOIN customer ON o_custkey = c_custkey WHERE o_orderstatus = 'F' AND c_acctbal < 0",
    ),
    "normalize_customer": ([_n("customer")], "n_customer", None, "SELECT c_custkey, trim(c_name) AS c_name, c_acctbal, trim(c_mktsegment) AS c_mktsegment FROM customer"),
    "normalize_text_casts": (
        [_n("texts")], "n_texts", None,
        f"SELECT try_cast(event_id AS BIGINT) AS event_id, try_cast(as_int AS BIGINT) AS as_int, try_cast(as_float AS DOUBLE) AS as_float, try_cast(as_date AS DATE) AS as_date, try_cast(as_time AS TIMESTAMP) AS as_time, try_cast(as_bool AS BOOLEAN) AS as_bool, trim(event_type) AS event_type FROM ({_TEXTS_SQL})",
    ),
    "normalize_no_schema": ([_n("nation")], "n_nation", None, "SELECT * FROM nation"),
    "join_inner": (_ORDERS_ITEMS, "joined", ["o_orderkey", "o_custkey", "l_orderkey", "l_linenumber", "l_quantity"], "SELECT o_orderkey, o_custkey, l_orderkey, l_linenumber, l_quantity FROM orders JOIN lineitem ON o_orderkey = l_orderkey"),
    "join_left": (
        [*_DOC_LABELS, {"type": "JOIN", "left": "n_documents", "right": "n_labels", "left_key": "doc_id", "right_key": "doc_id", "join_type": "left", "output_alias": "j"}],
        "j", ["doc_id", "source", "doc_id_1", "quality", "toxic"], "SELECT d.doc_id, source, l.doc_id AS doc_id_1, quality, toxic FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id",
    ),
    "join_full": (
        [*_DOC_LABELS, {"type": "JOIN", "left": "n_documents", "right": "n_labels", "left_key": "doc_id", "right_key": "doc_id", "join_type": "full", "output_alias": "j"}],
        "j", ["doc_id", "lang", "source", "doc_id_1", "quality", "toxic"], "SELECT d.doc_id, d.lang, d.source, l.doc_id AS doc_id_1, l.quality, l.toxic FROM documents d FULL JOIN labels l ON d.doc_id = l.doc_id",
    ),
    "join_full_two_sided": (
        [_n("customer"), _n("supplier"), {"type": "JOIN", "left": "n_customer", "right": "n_supplier", "left_key": "c_custkey", "right_key": "s_nationkey", "join_type": "full", "output_alias": "j"}],
        "j", ["c_custkey", "c_acctbal", "s_suppkey", "s_nationkey"], "SELECT c_custkey, c_acctbal, s_suppkey, s_nationkey FROM customer FULL JOIN supplier ON c_custkey = s_nationkey",
    ),
    "join_collision": (
        [*_DOC_LABELS, {"type": "JOIN", "left": "n_documents", "right": "n_labels", "left_key": "doc_id", "right_key": "doc_id", "output_alias": "j"}],
        "j", ["doc_id", "doc_id_1", "lang", "toxic"], "SELECT d.doc_id, l.doc_id AS doc_id_1, lang, toxic FROM documents d JOIN labels l ON d.doc_id = l.doc_id",
    ),
    "join_chain": (
        [_n("region", "a"), _n("region", "b"), _n("region", "c"), {"type": "JOIN", "left": "a", "right": "b", "left_key": "r_regionkey", "right_key": "r_regionkey", "output_alias": "ab"},
         {"type": "JOIN", "left": "ab", "right": "c", "left_key": "r_regionkey", "right_key": "r_regionkey", "output_alias": "abc"}],
        "abc", None,
        "SELECT a.r_regionkey, a.r_name, b.r_regionkey AS r_regionkey_1, b.r_name AS r_name_1, c.r_regionkey AS r_regionkey_2, c.r_name AS r_name_2 FROM region a JOIN region b ON a.r_regionkey = b.r_regionkey JOIN region c ON a.r_regionkey = c.r_regionkey",
    ),
    "filter_multi": (
        [_n("lineitem"), {"type": "FILTER", "input": "n_lineitem", "conditions": ["l_quantity > 45", "l_returnflag = 'R' OR l_discount >= 0.09"], "output_alias": "f", "check_id": "CHK-2"}],
        "f", ["check_id", "l_orderkey", "l_linenumber", "reason", "result_type"],
        "SELECT 'CHK-2' AS check_id, l_orderkey, l_linenumber, 'Violation detected by CHK-2' AS reason, 'row_level' AS result_type FROM lineitem WHERE l_quantity > 45 AND (l_returnflag = 'R' OR l_discount >= 0.09)",
    ),
    "filter_date_asof": (
        [_n("orders"), {"type": "FILTER", "input": "n_orders", "conditions": ["CAST(o_orderdate AS DATE) > CURRENT_DATE - INTERVAL '30 days'", "date_diff('month', o_orderdate, CURRENT_DATE) <= 1"], "output_alias": "f"}],
        "f", ["o_orderkey", "_check_id"],
        "SELECT o_orderkey, '' AS _check_id FROM orders WHERE CAST(o_orderdate AS DATE) > DATE '1996-06-30' - INTERVAL '30 days' AND date_diff('month', o_orderdate, DATE '1996-06-30') <= 1",
    ),
    "filter_null_predicate": (
        [*_DOC_LABELS, {"type": "JOIN", "left": "n_documents", "right": "n_labels", "left_key": "doc_id", "right_key": "doc_id", "join_type": "left", "output_alias": "j"},
         {"type": "FILTER", "input": "j", "conditions": ["NOT (quality = 1)"], "output_alias": "f"}],
        "f", ["doc_id", "quality"], "SELECT d.doc_id, quality FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id WHERE NOT (quality = 1)",
    ),
    "aggregate_global": (
        [_n("lineitem"), {"type": "AGGREGATE", "input": "n_lineitem", "check_id": "CHK-3", "metrics": [
            {"name": "n_rows", "formula": "COUNT(*)"}, {"name": "sum_qty", "formula": "ROUND(SUM(l_quantity), 2)"}, {"name": "min_price", "formula": "MIN(l_extendedprice)"}, {"name": "n_parts", "formula": "COUNT(DISTINCT l_partkey)"}, {"name": "best_key", "formula": "arg_max(l_orderkey, l_orderkey)"}]}],
        "agg_metrics", None,
        "SELECT 'aggregate' AS result_type, 'CHK-3' AS check_id, COUNT(*) AS n_rows, ROUND(SUM(l_quantity), 2) AS sum_qty, MIN(l_extendedprice) AS min_price, COUNT(DISTINCT l_partkey) AS n_parts, max(l_orderkey) AS best_key FROM lineitem",
    ),
    "aggregate_filtered": (
        [_n("lineitem"), {"type": "AGGREGATE", "input": "n_lineitem", "metrics": [{"name": "n_returned", "formula": "COUNT(*)", "filter": "l_returnflag = 'R'"}, {"name": "n_all", "formula": "COUNT(*)"}, {"name": "qty_a", "formula": "SUM(l_quantity)", "filter": "l_returnflag = 'A' AND l_linestatus = 'F'"}]}],
        "agg_metrics", None,
        "SELECT 'aggregate' AS result_type, NULL::VARCHAR AS check_id, COUNT(*) FILTER (WHERE l_returnflag = 'R') AS n_returned, COUNT(*) AS n_all, SUM(l_quantity) FILTER (WHERE l_returnflag = 'A' AND l_linestatus = 'F') AS qty_a FROM lineitem",
    ),
    "aggregate_ratio": (
        [_n("orders"), {"type": "AGGREGATE", "input": "n_orders", "check_id": "CHK-4", "metrics": [{"name": "rate", "formula": "ROUND(COUNT(*) FILTER (WHERE o_orderstatus = 'F')::DOUBLE / NULLIF(COUNT(*), 0), 4)"}]}],
        "agg_metrics", None,
        "SELECT 'aggregate' AS result_type, 'CHK-4' AS check_id, ROUND(COUNT(*) FILTER (WHERE o_orderstatus = 'F')::DOUBLE / NULLIF(COUNT(*), 0), 4) AS rate FROM orders",
    ),
    "aggregate_passed": (
        [_n("orders"), {"type": "AGGREGATE", "input": "n_orders", "check_id": "CHK-5", "metrics": [{"name": "n", "formula": "COUNT(*)"}, {"name": "passed", "formula": "COUNT(*) FILTER (WHERE o_totalprice < 0) = 0"}]}],
        "agg_metrics", None, "SELECT 'aggregate' AS result_type, 'CHK-5' AS check_id, COUNT(*) AS n, COUNT(*) FILTER (WHERE o_totalprice < 0) = 0 AS passed FROM orders",
    ),
    "aggregate_empty": (
        [_n("orders"), {"type": "FILTER", "input": "n_orders", "conditions": ["o_totalprice < -1"], "output_alias": "none", "terminal": False},
         {"type": "AGGREGATE", "input": "none", "metrics": [{"name": "n", "formula": "COUNT(*)"}, {"name": "total", "formula": "SUM(o_totalprice)"}]}],
        "agg_metrics", None, "SELECT 'aggregate' AS result_type, NULL::VARCHAR AS check_id, COUNT(*) AS n, SUM(o_totalprice) AS total FROM orders WHERE o_totalprice < -1",
    ),
    "aggregate_grouped": (
        [_n("orders"), {"type": "AGGREGATE", "input": "n_orders", "group_by": ["o_orderstatus", "o_orderpriority"], "metrics": [{"name": "n", "formula": "COUNT(*)"}, {"name": "total", "formula": "ROUND(SUM(o_totalprice), 1)"}]}],
        "agg_metrics", ["o_orderstatus", "o_orderpriority", "n"], "SELECT o_orderstatus, o_orderpriority, COUNT(*) AS n FROM orders GROUP BY ALL",
    ),
    "date_diff_day": (_diff("days"), "diffed", ["o_orderkey", "l_linenumber", "o_orderdate_to_l_shipdate_days"], _diff_sql("date_diff('day', o_orderdate, l_shipdate)", "o_orderdate_to_l_shipdate_days")),
    "date_diff_month": (_diff("month"), "diffed", ["o_orderkey", "l_linenumber", "o_orderdate_to_l_shipdate_months"], _diff_sql("date_diff('month', o_orderdate, l_shipdate)", "o_orderdate_to_l_shipdate_months")),
    "date_diff_year": (_diff("years"), "diffed", ["o_orderkey", "l_linenumber", "o_orderdate_to_l_shipdate_years"], _diff_sql("date_diff('year', o_orderdate, l_shipdate)", "o_orderdate_to_l_shipdate_years")),
    "date_diff_hour": (
        [_n("event_pairs"), {"type": "DATE_DIFF", "input": "n_event_pairs", "from_field": "ts", "to_field": "later", "unit": "hours", "output_alias": "d"}],
        "d", None, "SELECT event_id, ts, ts + (value * 60)::BIGINT * INTERVAL 1 SECOND AS later, date_diff('hour', ts, ts + (value * 60)::BIGINT * INTERVAL 1 SECOND) AS ts_to_later_hours FROM events",
    ),
    "date_diff_prefilter": (
        _diff("days", filter={"field": "l_returnflag", "op": "eq", "value": "R"}), "diffed", ["o_orderkey", "l_linenumber", "o_orderdate_to_l_shipdate_days"],
        _diff_sql("date_diff('day', o_orderdate, l_shipdate)", "o_orderdate_to_l_shipdate_days", "WHERE l_returnflag = 'R'"),
    ),
    "threshold_flag": (
        [*_DOC_LABELS, {"type": "JOIN", "left": "n_documents", "right": "n_labels", "left_key": "doc_id", "right_key": "doc_id", "join_type": "left", "output_alias": "j"},
         {"type": "THRESHOLD", "input": "j", "condition": "quality >= 1", "flag_field": "good", "output_alias": "t"}],
        "t", ["doc_id", "good"], "SELECT d.doc_id, quality >= 1 AS good FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id",
    ),
    "sla_rate": (
        [*_diff("days"), {"type": "THRESHOLD", "input": "diffed", "condition": "o_orderdate_to_l_shipdate_days <= 30", "flag_field": "within", "output_alias": "t"},
         {"type": "AGGREGATE", "input": "t", "check_id": "CHK-6", "metrics": [{"name": "n_within", "formula": "COUNT(*)", "filter": "within"}, {"name": "n_all", "formula": "COUNT(*)"}, {"name": "rate", "formula": "ROUND(COUNT(*) FILTER (WHERE within)::DOUBLE / NULLIF(COUNT(*), 0), 4)"}]}],
        "agg_metrics", None,
        "SELECT 'aggregate' AS result_type, 'CHK-6' AS check_id, COUNT(*) FILTER (WHERE d <= 30) AS n_within, COUNT(*) AS n_all, ROUND(COUNT(*) FILTER (WHERE d <= 30)::DOUBLE / NULLIF(COUNT(*), 0), 4) AS rate FROM (SELECT date_diff('day', o_orderdate, l_shipdate) AS d FROM orders JOIN lineitem ON o_orderkey = l_orderkey)",
    ),
    "completeness": (
        [*_DOC_LABELS, {"type": "JOIN", "left": "n_documents", "right": "n_labels", "left_key": "doc_id", "right_key": "doc_id", "join_type": "left", "output_alias": "j"},
         {"type": "COMPLETENESS", "input": "j", "check_field": "quality", "output_alias": "c", "check_id": "CHK-7"}],
        "c", ["check_id", "doc_id", "reason", "result_type"],
        "SELECT 'CHK-7' AS check_id, d.doc_id, 'Required field quality is NULL or missing' AS reason, 'completeness' AS result_type FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id WHERE quality IS NULL",
    ),
    "completeness_prefilter": (
        [_n("texts"), {"type": "COMPLETENESS", "input": "n_texts", "check_field": "as_date", "filter": {"field": "event_type", "op": "eq", "value": "error"}, "output_alias": "c"}],
        "c", ["check_id", "event_id", "reason"],
        f"SELECT NULL::VARCHAR AS check_id, event_id::BIGINT AS event_id, 'Required field as_date is NULL or missing' AS reason FROM ({_TEXTS_SQL}) WHERE trim(event_type) = 'error' AND try_cast(as_date AS DATE) IS NULL",
    ),
    "uniqueness_single": (
        [_n("lineitem"), {"type": "UNIQUENESS", "input": "n_lineitem", "key_columns": ["l_orderkey"], "output_alias": "u"}],
        "u", ["l_orderkey", "l_linenumber", "_dup_count", "reason"],
        "SELECT l_orderkey, l_linenumber, n AS _dup_count, 'Duplicate row detected on key columns: l_orderkey' AS reason FROM (SELECT *, COUNT(*) OVER (PARTITION BY l_orderkey) AS n FROM lineitem) WHERE n > 1",
    ),
    "uniqueness_composite": (
        [_n("lineitem"), {"type": "UNIQUENESS", "input": "n_lineitem", "key_fields": ["l_orderkey", "l_partkey"], "output_alias": "u", "check_id": "CHK-8"}],
        "u", ["check_id", "l_orderkey", "l_partkey", "l_linenumber", "_dup_count", "result_type"],
        "SELECT 'CHK-8' AS check_id, l_orderkey, l_partkey, l_linenumber, n AS _dup_count, 'uniqueness' AS result_type FROM (SELECT *, COUNT(*) OVER (PARTITION BY l_orderkey, l_partkey) AS n FROM lineitem) WHERE n > 1",
    ),
    "uniqueness_null_key": (
        [*_DOC_LABELS, {"type": "JOIN", "left": "n_documents", "right": "n_labels", "left_key": "doc_id", "right_key": "doc_id", "join_type": "left", "output_alias": "j"},
         {"type": "UNIQUENESS", "input": "j", "key_columns": ["quality", "source"], "output_alias": "u"}],
        "u", ["doc_id", "quality", "_dup_count"],
        "SELECT doc_id, quality, n AS _dup_count FROM (SELECT d.doc_id, quality, COUNT(*) OVER (PARTITION BY quality, source) AS n FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id) WHERE n > 1",
    ),
    "reconciliation": (
        [*_DOC_LABELS, {"type": "RECONCILIATION", "left": "n_documents", "right": "n_labels", "on": {"left_key": "doc_id", "right_key": "doc_id"}, "output_alias": "r", "check_id": "CHK-9"}],
        "r", ["check_id", "doc_id", "reason", "result_type"],
        "SELECT 'CHK-9' AS check_id, doc_id, 'Record present in n_documents but absent from n_labels' AS reason, 'reconciliation' AS result_type FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)",
    ),
    "reconciliation_none": (
        [_n("customer"), _n("orders"), {"type": "RECONCILIATION", "left": "n_orders", "right": "n_customer", "left_key": "o_custkey", "right_key": "c_custkey", "output_alias": "r"}],
        "r", ["o_orderkey", "o_custkey"], "SELECT o_orderkey, o_custkey FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer)",
    ),
}


def _context(spark: SparkSession, sf_dir: str, names: set[str]) -> Context:
    made = {"texts": lambda: _texts(spark, sf_dir), "event_pairs": lambda: _event_pairs(spark, sf_dir)}
    frames = {n: made[n]() if n in made else spark.read.parquet(f"{sf_dir}/{n}.parquet") for n in names}
    return Context(frames, SCHEMAS, AS_OF)


def _event_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    later = F.col("ts") + F.make_dt_interval(secs=F.rint(F.col("value") * 60).cast("decimal(18,6)"))
    return e.select("event_id", "ts", later.alias("later"))


def _planned(spark: SparkSession, sf_dir: str, steps: list[dict]):
    plan = plan_from({"group_id": "g1", "steps": steps})
    return build(plan, _context(spark, sf_dir, {s.dataset for s in plan.steps if s.kind == "NORMALIZE"}))


def _run(name: str) -> Callable[[SparkSession, str], DataFrame]:
    steps, alias, columns, _ = _PLANS[name]

    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        planned = _planned(spark, sf_dir, steps)
        out = next((t.frame for t in planned.terminals if t.step.output_alias == alias), None)
        out = planned.env[alias] if out is None else out
        return out.select(*columns) if columns else out

    return query


#: name -> (table, key, names and expressions of the plan language, which is the oracle's own dialect).
_EXPRESSIONS: dict[str, tuple[str, str, dict[str, str]]] = {
    "expr_dates": ("events", "event_id", {
        "weeks": "date_diff('week', ts, TIMESTAMP '2026-02-01 00:00:00')", "quarters": "date_diff('quarter', ts, TIMESTAMP '2026-02-01 00:00:00')",
        "minutes": "date_diff('minute', ts, TIMESTAMP '2026-02-01 00:00:30')", "seconds": "datediff('second', ts, TIMESTAMP '2026-02-01 00:00:30')",
        "sunday_0": "dayofweek(ts)::BIGINT", "weekday_0": "weekday(ts)::BIGINT", "monday_1": "isodow(ts)::BIGINT", "dow": "date_part('dow', ts)::BIGINT", "in_year": "dayofyear(ts)::BIGINT",
        "iso_week": "week(ts)::BIGINT", "iso_year": "isoyear(ts)::BIGINT", "month_of": "extract(month FROM ts)::BIGINT", "dow_of": "extract(dow FROM ts)::BIGINT",
        "shown": "strftime(ts, '%d/%m/%Y at %H:%M:%S, day %j')", "hour_12": "strftime(ts, '%I %p %a %b')", "day_name": "dayname(ts)", "month_name": "monthname(ts)",
        "whole_months": "date_sub('month', ts, TIMESTAMP '2026-02-01 00:00:30')", "next_day": "strftime(date_add(ts, INTERVAL 1 DAY), '%Y-%m-%d')",
    }),
    "expr_strings": ("part", "p_partkey", {
        "first_only": "regexp_replace(p_name, '[aeiou]', '*')", "every": "regexp_replace(p_name, '[aeiou]', '$', 'g')", "swapped": r"regexp_replace(p_name, '([a-z])([a-z])', '\2\1')",
        "last_word": "regexp_extract(p_name, '[a-z]+$')", "initial": "regexp_extract(p_type, '^(.)(.)', 2)", "from_0": "substr(p_name, 0, 3)", "from_2": "substr(p_name, 2, 3)", "end_3": "substr(p_name, -3)",
        "from_any": "substring(p_name, p_size % 3, 3)", "plain_backslash": r"replace(p_name, ' ', '\_') LIKE '%\_%'", "escaped": r"replace(p_name, ' ', '_') LIKE '%!_%' ESCAPE '!'", "whole": "regexp_full_match(p_brand, 'Brand#[0-9]')",
        "part_of": "regexp_matches(p_brand, '#1')", "both_ends": "trim(p_name, 'cdt')", "left_end": "ltrim(p_name, 'cold')", "right_end": "rtrim(p_name, 'tge')", "second_word": "split_part(p_name, ' ', 2)",
        "word_1": "list_extract(string_split(p_name, ' '), 1)", "n_words": "len(string_split(p_name, ' '))::BIGINT", "place": "strpos(p_name, 'w')::BIGINT", "digest": "sha256(p_name)",
    }),
    "expr_math": ("part", "p_partkey", {
        "log_10": "round(log(p_retailprice), 6)", "log_e": "round(ln(p_retailprice), 6)", "log_b": "round(log(2, p_retailprice), 6)", "squared": "p_size ^ 2", "twice_over": "2 ^ 3 ^ 2 + p_size ** 2", "negative": "10 - p_size ^ 2", "of_sign": "-p_size ^ 2",
        "in_parens": "(p_size - 3) ^ (1 + 1)", "cut_off": "trunc(-p_retailprice / 7)", "half_even": "(p_size / 2)::BIGINT", "half_even_cast": "CAST(p_size * 0.5::DOUBLE AS BIGINT)", "half_away": "(p_size * 0.5)::BIGINT", "of_text": "'2.5'::BIGINT",
        "of_case": "CASE WHEN p_size > 20 THEN 2.5::DOUBLE ELSE 3.5::DOUBLE END::BIGINT", "either": "xor(p_size, 5)::BIGINT", "whole": "(p_size // 4)::BIGINT",
    }),
}


def _expressions(name: str) -> tuple[Callable[[SparkSession, str], DataFrame], str]:
    table, key, found = _EXPRESSIONS[name]

    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        df = _planned(spark, sf_dir, [_n(table)]).env[f"n_{table}"]
        return df.select(key, *[expression(e, Context(as_of=AS_OF)).alias(n) for n, e in found.items()])

    return query, f"SELECT {key}, {', '.join(f'{e} AS {n}' for n, e in found.items())} FROM {table}"


#: Metrics with values in lists, which keep nulls, and none for no rows.
_LISTS = {"n_all": "len(list(CASE WHEN o_totalprice > 100000 THEN o_custkey END))::BIGINT", "n_some": "len(array_agg(o_custkey) FILTER (WHERE o_totalprice > 300000))::BIGINT", "smallest": "list_extract(list_sort(list(o_custkey)), 1)", "missing": "len(list(o_custkey) FILTER (WHERE o_totalprice < 0))::BIGINT"}
_LISTS_PLAN = [_n("orders"), {"type": "AGGREGATE", "input": "n_orders", "check_id": "CHK-L", "group_by": ["o_orderpriority"], "metrics": [{"name": n, "formula": f} for n, f in _LISTS.items()]}]
_LISTS_SQL = f"SELECT o_orderpriority, {', '.join(f'{f} AS {n}' for n, f in _LISTS.items())} FROM orders GROUP BY o_orderpriority"

_GROUP = [
    _n("orders"), _n("customer"), _n("labels"), _n("documents"), {"type": "JOIN", "left": "n_orders", "right": "n_customer", "left_key": "o_custkey", "right_key": "c_custkey", "output_alias": "j"},
    {"type": "FILTER", "input": "j", "conditions": ["c_acctbal < -900"], "output_alias": "poor", "check_id": "CHK-A"},
    {"type": "FILTER", "input": "j", "conditions": ["o_totalprice > 400000"], "output_alias": "large", "check_id": "CHK-B"},
    {"type": "RECONCILIATION", "left": "n_documents", "right": "n_labels", "left_key": "doc_id", "right_key": "doc_id", "output_alias": "unlabelled", "check_id": "CHK-C"},
]
_SEVERITIES = {"CHK-A": "high", "CHK-B": "critical"}
_GROUP_SQL = """SELECT 'CHK-A' AS check_id, 'high' AS severity, o_orderkey AS k FROM orders JOIN customer ON o_custkey = c_custkey WHERE c_acctbal < -900
UNION ALL SELECT 'CHK-B', 'critical', o_orderkey FROM orders JOIN customer ON o_custkey = c_custkey WHERE o_totalprice > 400000
UNION ALL SELECT 'CHK-C', 'medium', doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)"""


def _violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return all_violations(_planned(spark, sf_dir, _GROUP), "CTL-1", _SEVERITIES, NOW, spark)


def _checks_evaluated(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the engine says about each check of a group; a row a check."""
    planned = _planned(spark, sf_dir, _GROUP)
    said = checks_evaluated(all_violations(planned, "CTL-1", _SEVERITIES, NOW, spark), planned, [])
    return spark.createDataFrame([(c["check_id"], c["type"], c["violations"], c["passed"]) for c in said], "check_id string, type string, n long, passed boolean")


def _multi_terminal(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.coalesce(F.get_json_object("evidence", "$.o_orderkey"), F.get_json_object("evidence", "$.doc_id")).cast("long")
    return _violations(spark, sf_dir).select("control_id", "group_id", "check_id", "severity", "reason", key.alias("evidence_key"))


_SIGNS = (">=", ">", "<=", "<", "==", "=", "!=", "<>")


def _metric_threshold(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A group's metric under every sign that a threshold may have; a row a check."""
    made = {"name": "rate", "formula": "ROUND(COUNT(*) FILTER (WHERE o_orderstatus = 'F')::DOUBLE / NULLIF(COUNT(*), 0), 4)"}, {"name": "n", "formula": "COUNT(*)"}
    steps = [_n("orders")] + [{"type": "AGGREGATE", "input": "n_orders", "check_id": f"CHK-{i}", "output_alias": f"a{i}", "metrics": made} for i in range(len(_SIGNS))]
    steps = [s | {"metrics": list(s["metrics"])} if "metrics" in s else s for s in steps]
    control = control_from({"control_id": "CTL-1", "checks": [{"check_id": f"CHK-{i}", "type": "aggregate", "severity": "high", "threshold": {"operator": sign, "value": 0.4}} for i, sign in enumerate(_SIGNS)]})
    own = metrics(_planned(spark, sf_dir, steps), "CTL-1", control, NOW)
    return spark.createDataFrame([(m.check_id, m.metric_name, m.metric_value, m.passed, int(m.supporting["n"])) for m in own], "check_id string, metric_name string, metric_value double, passed boolean, n long")


_METRIC_SQL = "SELECT ROUND(COUNT(*) FILTER (WHERE o_orderstatus = 'F')::DOUBLE / NULLIF(COUNT(*), 0), 4) AS rate, COUNT(*) AS n FROM orders"

def _ingested(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as a raw CSV file with odd headers, null tokens and dates as text, ingested: types are found again."""
    folder = f"{scratch(spark)}/raw-{uuid.uuid4().hex}"
    k = F.col("c_custkey")
    day = F.date_format(F.date_add(F.lit(AS_OF), (k % 300).cast("int")), "yyyy-MM-dd")
    raw = spark.read.parquet(f"{sf_dir}/customer.parquet").select(
        k.alias("Cust Key"), F.concat(F.lit(" "), "c_name").alias("Name (full)"), F.round("c_acctbal", 2).alias("Balance"), F.when(k % 10 == 0, "N/A").otherwise(day).alias("Opened-On"), F.when(k % 7 == 0, "-").otherwise(F.col("c_mktsegment")).alias("1st Segment"),
    )
    raw.write.option("header", True).option("ignoreLeadingWhiteSpace", False).csv(f"{folder}/customer.csv")
    with tempfile.TemporaryDirectory() as schemas:
        return ingest(spark, f"{folder}/customer.csv", f"{folder}/customer", f"{schemas}/customer.yaml", "customer", required=("cust_key",))


_INGESTED_SQL = f"""SELECT c_custkey AS cust_key, trim(c_name) AS name_full, round(c_acctbal, 2) AS balance, CASE WHEN c_custkey % 10 <> 0 THEN DATE '{AS_OF}' + (c_custkey % 300)::INT END AS opened_on,
  CASE WHEN c_custkey % 7 <> 0 THEN c_mktsegment END AS col_1st_segment FROM customer"""


def _controlled(spark: SparkSession, sf_dir: str):
    """A control of two groups through the whole run, one of which fails at a row."""
    bad = [_n("orders"), {"type": "THRESHOLD", "input": "n_orders", "condition": "1 / (o_custkey - o_custkey) > 1", "flag_field": "odd", "output_alias": "t"}, {"type": "COMPLETENESS", "input": "t", "check_field": "odd", "output_alias": "c", "check_id": "CHK-Z"}]
    groups = [Group("g0", 1, ("orders",), (), plan_from({"group_id": "g0", "steps": bad})), Group("g1", 2, (), (), plan_from({"group_id": "g1", "steps": _GROUP}))]
    control = control_from({"control_id": "CTL-1", "checks": [{"check_id": c, "severity": _SEVERITIES.get(c, "medium")} for c in ("CHK-A", "CHK-B", "CHK-C", "CHK-Z")]})
    datasets = {d: spark.read.parquet(f"{sf_dir}/{d}.parquet") for d in ("orders", "customer", "documents", "labels")}
    return run_control(spark, "CTL-1", groups, datasets, control=control, as_of=AS_OF, now=NOW)


def _control_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.coalesce(F.get_json_object("evidence", "$.o_orderkey"), F.get_json_object("evidence", "$.doc_id")).cast("long")
    return _controlled(spark, sf_dir).violations.select("control_id", "group_id", "check_id", "severity", key.alias("evidence_key"))


def _control_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    run = _controlled(spark, sf_dir)
    rows = [(a.group_id, a.status, c["check_id"], c["violations"]) for a in run.audit for c in a.checks or [{"check_id": None, "violations": 0}]]
    return spark.createDataFrame([(*r, run.overall) for r in rows], "group_id string, status string, check_id string, n long, overall string")


_FIRST = [_n("events"), {"type": "THRESHOLD", "input": "n_events", "condition": "row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id) = 1 OR SUM(value) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) > 900", "flag_field": "noted", "output_alias": "t"}]
_FIRST_SQL = f"SELECT event_id, {_FIRST[1]['condition']} AS noted FROM events"

_OTHER: dict[str, tuple[Callable[[SparkSession, str], DataFrame], str]] = {
    "multi_terminal_union": (
        _multi_terminal,
        f"SELECT 'CTL-1' AS control_id, 'g1' AS group_id, check_id, severity, CASE check_id WHEN 'CHK-C' THEN 'Record present in n_documents but absent from n_labels' ELSE 'Violation detected by ' || check_id END AS reason, k AS evidence_key FROM ({_GROUP_SQL})",
    ),
    "severity_summary": (lambda spark, sf_dir: severity_summary(_violations(spark, sf_dir)), f"SELECT severity, COUNT(*) AS n_violations FROM ({_GROUP_SQL}) GROUP BY severity"),
    "checks_evaluated": (
        _checks_evaluated,
        f"SELECT c.check_id, c.type, COUNT(g.check_id) AS n, COUNT(g.check_id) = 0 AS passed FROM (VALUES ('CHK-A', 'row_level'), ('CHK-B', 'row_level'), ('CHK-C', 'reconciliation')) c(check_id, type) LEFT JOIN ({_GROUP_SQL}) g ON g.check_id = c.check_id GROUP BY c.check_id, c.type",
    ),
    "metric_threshold": (
        _metric_threshold,
        " UNION ALL ".join(f"SELECT 'CHK-{i}' AS check_id, 'rate' AS metric_name, rate AS metric_value, rate {'=' if sign == '==' else sign} 0.4 AS passed, n FROM ({_METRIC_SQL})" for i, sign in enumerate(_SIGNS)),
    ),
    "ingest_csv": (_ingested, _INGESTED_SQL),
    "control_violations": (_control_violations, f"SELECT 'CTL-1' AS control_id, 'g1' AS group_id, check_id, severity, k AS evidence_key FROM ({_GROUP_SQL})"),
    "control_audit": (
        _control_audit,
        f"SELECT 'g1' AS group_id, 'success' AS status, c.check_id, COUNT(g.check_id) AS n, 'FAIL' AS overall FROM (VALUES ('CHK-A'), ('CHK-B'), ('CHK-C')) c(check_id) LEFT JOIN ({_GROUP_SQL}) g ON g.check_id = c.check_id GROUP BY c.check_id UNION ALL SELECT 'g0', 'error', NULL, 0, 'FAIL'",
    ),
    "window_functions": (lambda spark, sf_dir: _planned(spark, sf_dir, _FIRST).env["t"].select("event_id", "noted"), _FIRST_SQL),
    "expr_lists": (lambda spark, sf_dir: _planned(spark, sf_dir, _LISTS_PLAN).terminals[0].frame.select("o_orderpriority", *_LISTS), _LISTS_SQL),
    "empty_plan": (lambda spark, sf_dir: empty_result(spark), "SELECT NULL::VARCHAR AS result_type WHERE FALSE"),
}
_OTHER |= {name: _expressions(name) for name in _EXPRESSIONS}


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: _run(name) for name in _PLANS} | {name: q for name, (q, _) in _OTHER.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for name, (_, _, _, sql) in _PLANS.items()} | {name: sql for name, (_, sql) in _OTHER.items()}
