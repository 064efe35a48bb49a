"""Raw evidence files: CSV, Excel and Parquet."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .names import column_names

SUFFIXES = (".csv", ".xlsx", ".parquet")


def exists(spark: SparkSession, path: str) -> bool:
    """Whether there is a file or folder, in any store that Spark reads."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)


def read_raw(spark: SparkSession, path: str, sheet: str | None = None, multiline: bool | None = None) -> tuple[DataFrame, list[str]]:
    """The table with clean column names, and its headers. CSV columns are text; types are found later.

    ``multiline`` says whether CSV values may hold line breaks, in which case a file is one task; None looks for lines with a
    quote that isn't closed. A missing file is a FileNotFoundError, another suffix a ValueError (old .xls workbooks too);
    both at once, not when rows are read.
    """
    suffix = "." + path.rstrip("/").rsplit(".", 1)[-1].lower() if "." in path.rsplit("/", 1)[-1] else ""
    if suffix not in SUFFIXES:
        raise ValueError(f"unsupported file type {suffix or path!r}; supported are {', '.join(SUFFIXES)}")
    if not exists(spark, path):
        raise FileNotFoundError(path)
    if suffix == ".parquet":
        df = spark.read.parquet(path)
        return df.toDF(*column_names(df.columns)), df.columns
    if suffix == ".csv":
        lines = spark.read.text(path)
        first = lines.limit(1).collect()
        if multiline is None:
            quotes = F.length("value") - F.length(F.replace("value", F.lit('"'), F.lit("")))
            multiline = not lines.where(quotes % 2 == 1).isEmpty()
        df = spark.read.option("header", True).option("inferSchema", False).option("multiLine", multiline).option("quote", '"').option("escape", '"').csv(path)
        headers = _headers(first[0][0], df.columns) if first else list(df.columns)
        return df.toDF(*column_names(headers)), headers
    return _read_excel(spark, path, sheet)


def _headers(line: str, spark_names: list[str]) -> list[str]:
    """Headers as they stand in the file: Spark numbers repeated and empty ones."""
    import csv

    own = next(csv.reader([line.lstrip("﻿")]))
    return own if len(own) == len(spark_names) else spark_names


def _read_excel(spark: SparkSession, path: str, sheet: str | None) -> tuple[DataFrame, list[str]]:
    """One sheet, read on the driver: a workbook holds at most 1,048,576 rows a sheet."""
    try:
        import io

        import openpyxl
    except ImportError as e:
        raise ImportError("reading Excel files needs openpyxl") from e
    data = spark.read.format("binaryFile").load(path).select("content").first()[0]
    book = openpyxl.load_workbook(io.BytesIO(data), read_only=True, data_only=True)
    rows, headers = sheet_rows(book, sheet)
    table = spark.createDataFrame(rows, ", ".join(f"`{i}` string" for i in range(len(headers)))) if headers else spark.createDataFrame([], "col string")
    return table.toDF(*column_names(headers)), headers


def sheet_rows(book, sheet: str | None) -> tuple[list[list[str | None]], list[str]]:
    """The rows of a sheet as text, and its headers. Which sheet must be said if there are several; empty ones are errors.

    Header cells without text are called col_0 and so on; short rows end in nulls, longer ones are cut at the headers.
    """
    names = book.sheetnames
    if sheet is None and len(names) > 1:
        raise ValueError(f"there are several sheets ({', '.join(names)}): name one")
    if sheet is not None and sheet not in names:
        raise ValueError(f"no sheet {sheet!r} among {', '.join(names)}")
    found = [list(r) for r in book[sheet or names[0]].iter_rows(values_only=True)]
    if not found:
        raise ValueError(f"sheet {sheet or names[0]!r} is empty")
    headers = [str(h) if h is not None and str(h).strip() else f"col_{i}" for i, h in enumerate(found[0])]
    text = lambda v: None if v is None else v.date().isoformat() if hasattr(v, "date") and v.time().isoformat() == "00:00:00" else str(v)
    return [[text(v) for v in (r + [None] * len(headers))[: len(headers)]] for r in found[1:]], headers


def sample_rows(df: DataFrame, n: int = 10) -> list[dict[str, str | None]]:
    """The first rows as text, as context for whoever writes a plan."""
    return [r.asDict() for r in df.select(*[F.col(f"`{c}`").cast("string").alias(c) for c in df.columns]).limit(n).collect()]
