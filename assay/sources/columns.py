"""Nulls and types of raw text columns: tokens that mean null, stripping, dates and numbers.

All decisions about a table are made from one aggregation over all its rows; only date formats look at a first few values.
"""

from __future__ import annotations

import datetime as dt
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from assay.functions.casts import SPARK_TYPES, to_float, to_integer
from assay.functions.translate import quoted

#: Texts that mean null, and date formats in the order in which they are tried (as strptime has them, and as Spark does).
NULL_TOKENS = ("", "N/A", "NULL", "null", "None", "NONE", "-")
DATE_FORMATS = (("%Y-%m-%d", "yyyy-M-d"), ("%m/%d/%Y", "M/d/yyyy"), ("%d-%m-%Y", "d-M-yyyy"), ("%Y%m%d", "yyyyMMdd"), ("%d/%m/%Y", "d/M/yyyy"))
#: Values looked at, and the share of them, and then of all, that must be dates.
SNIFFED, LOOKS_LIKE, READS_AS = 50, 0.7, 0.6
#: Rows that are looked at first; columns with fewer than SNIFFED values in them are looked at on their own.
LOOKED_AT = 1_000


def cleaned(c: Column, tokens: tuple[str, ...] = NULL_TOKENS) -> Column:
    """Without white space around, and null where a token, in any case, is all there is."""
    text = F.regexp_replace(F.regexp_replace(c, r"(?U)^\s+", ""), r"(?U)\s+$", "")
    return F.when(~F.lower(text).isin(*sorted({t.lower() for t in tokens})), text)


def _reads(value: str, fmt: str) -> bool:
    try:
        dt.datetime.strptime(value, fmt)
    except ValueError:
        return False
    return True


def looks_like_dates(values: list[str]) -> bool:
    """At least LOOKS_LIKE of a column's first values, nulls left out, can be read in some format."""
    values = values[:SNIFFED]
    good = sum(any(_reads(v.strip(), f) for f, _ in DATE_FORMATS) for v in values)
    return bool(values) and good / len(values) >= LOOKS_LIKE


@dataclass(frozen=True)
class ColumnSchema:
    source_name: str
    normalized_name: str
    type: str
    nullable: bool = True
    date_formats_tried: tuple[str, ...] | None = None


def as_date(c: Column, fmt: str) -> Column:
    return F.try_to_timestamp(c, F.lit(fmt)).cast("date")


def _first_values(df: DataFrame, names: list[str]) -> dict[str, list[str]]:
    """The first values of each column, nulls left out: from one look at all columns where that has enough."""
    if not names:
        return {}
    rows = df.select(*[quoted(c) for c in names]).limit(LOOKED_AT).collect()
    out = {c: [r[i] for r in rows if r[i] is not None][:SNIFFED] for i, c in enumerate(names)}
    for c in names if len(rows) == LOOKED_AT else ():
        if len(out[c]) < SNIFFED:
            out[c] = [r[0] for r in df.select(quoted(c)).where(F.col(quoted(c)).isNotNull()).limit(SNIFFED).collect()]
    return out


def typed(df: DataFrame, headers: list[str], overrides: dict[str, str] | None = None, tokens: tuple[str, ...] = NULL_TOKENS) -> tuple[DataFrame, list[ColumnSchema]]:
    """The table with cleaned and typed columns, and its schema.

    Text columns become integers or floats if all their values are such, else dates if the first values look like it and a
    format reads READS_AS of all (values it can't read become null). Overrides act on text columns, for the types date,
    integer and float; a date that no format reads stays text. Other columns keep their types.
    """
    overrides = overrides or {}
    text = {f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType)}
    df = df.select(*[(cleaned(df[quoted(c)], tokens) if c in text else df[quoted(c)]).alias(c) for c in df.columns])
    firsts = _first_values(df, sorted(text))
    dates = {c for c in text if overrides.get(c) == "date" or c not in overrides and looks_like_dates(firsts[c])}
    asked = []
    for i, c in enumerate(df.columns):
        col = df[quoted(c)]
        asked.append(F.count(col).alias(f"n_{i}"))
        if c in text:
            asked.append(F.count(F.when(col.rlike(r"^[+-]?\d+$"), col.try_cast("bigint"))).alias(f"i_{i}"))
            asked.append(F.count(F.when(col.rlike(r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$"), to_float(col, T.StringType()))).alias(f"f_{i}"))
            if c in dates:
                asked += [F.count(as_date(col, f)).alias(f"d_{i}_{k}") for k, (_, f) in enumerate(DATE_FORMATS)]
    seen = df.agg(F.count(F.lit(1)).alias("rows"), *asked).first().asDict()
    cols, schema = [], []
    for i, (c, source) in enumerate(zip(df.columns, headers, strict=True)):
        col, n, want = df[quoted(c)], seen[f"n_{i}"], overrides.get(c)
        kind = _type_name(df.schema[c].dataType)
        if c in text:
            kind = "string"
            if want == "integer" or want is None and n and seen[f"i_{i}"] == n:
                kind, col = "integer", to_integer(col, T.StringType())
            elif want == "float" or want is None and n and seen[f"f_{i}"] == n:
                kind, col = "float", to_float(col, T.StringType())
            if c in dates and kind == "string" or c in dates and want is None and kind == "integer" and n and all(len(v) == 8 for v in firsts[c]):
                k = next((k for k in range(len(DATE_FORMATS)) if n and seen[f"d_{i}_{k}"] >= READS_AS * n), None)
                if k is not None:
                    kind, col = "date", as_date(df[quoted(c)], DATE_FORMATS[k][1])
        cols.append(col.alias(c))
        schema.append(ColumnSchema(source, c, kind, not (kind == "boolean" and n == seen["rows"])))
    return df.select(*cols), schema


def _type_name(kind: T.DataType) -> str:
    if isinstance(kind, T.IntegralType):
        return "integer"
    if isinstance(kind, (T.FractionalType, T.DecimalType)):
        return "float"
    return {T.DateType: "date", T.TimestampType: "datetime", T.TimestampNTZType: "datetime", T.BooleanType: "boolean"}.get(type(kind), "string")


def spark_schema(schema: list[ColumnSchema]) -> T.StructType:
    return T.StructType([T.StructField(c.normalized_name, SPARK_TYPES[c.type], c.nullable) for c in schema])
