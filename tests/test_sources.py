import datetime as dt

import pytest

from assay.sources.columns import cleaned, looks_like_dates, typed
from assay.sources.names import column_names, sanitize, unique
from assay.sources.reader import read_raw, sample_rows, sheet_rows
from assay.sources.store import ingest, load_schema, save

CSV = '''\
Account ID,Amount ($),Opened On,Note,1st,,Opened On
7,10.50,2026-01-05, fine ,a,1,x
8,N/A,2026-02-30,"a, ""quoted""",b,2,y
9,-3,2026-03-01,none,,3,-
10,1e2,2026-04-02,,d,4,z
'''


@pytest.mark.parametrize("header, name", [("Amount ($)", "amount"), ("First  Name", "first_name"), ("1st column", "col_1st_column"), ("", "col"), (None, "col"), ("a.b-c d", "a_b_c_d"), ("__X__", "x"), ("Größe", "größe"), ("%%", "col")])
def test_sanitize(header, name):
    assert sanitize(header) == name


def test_unique_names_never_collide():
    assert unique(["x", "x", "x"]) == ["x", "x_1", "x_2"]
    assert len(set(unique(["a", "a_1", "a", "a"]))) == 4
    assert column_names(["A", "a ", "A-1"]) == ["a", "a_2", "a_1"] or len(set(column_names(["A", "a ", "A-1"]))) == 3


def test_null_tokens_and_stripping(spark):
    rows = [("N/A",), (" NULL ",), ("none",), ("\t-",), ("",), ("  Alice ",), ("nothing",), (None,)]
    got = spark.createDataFrame(rows, "v string").select(cleaned(__import__("pyspark").sql.functions.col("v")).alias("v")).collect()
    assert [r.v for r in got] == [None] * 5 + ["Alice", "nothing", None]


def test_dates_are_sniffed():
    assert looks_like_dates(["2026-01-05", "01/02/2026", "x"][:2]) and not looks_like_dates(["2026-01", "2026-02"]) and not looks_like_dates([])
    assert looks_like_dates(["2026-01-05"] * 7 + ["x"] * 3) and not looks_like_dates(["2026-01-05"] * 6 + ["x"] * 4)


def test_csv_is_typed_and_stored_once(spark, tmp_path):
    raw = tmp_path / "evidence.csv"
    raw.write_text(CSV, encoding="utf-8")
    args = (spark, str(raw), str(tmp_path / "out"), tmp_path / "s.yaml", "evidence")
    df = ingest(*args, required=("account_id",))
    assert [(f.name, f.dataType.simpleString()) for f in df.schema.fields] == [("account_id", "bigint"), ("amount", "double"), ("opened_on", "date"), ("note", "string"), ("col_1st", "string"), ("col", "bigint"), ("opened_on_1", "string")]
    rows = sorted(map(tuple, df.collect()))
    assert rows[0] == (7, 10.5, dt.date(2026, 1, 5), "fine", "a", 1, "x") and rows[1] == (8, None, None, 'a, "quoted"', "b", 2, "y") and rows[2][3] is None and rows[2][6] is None
    raw.write_text("Account ID\n1\n")
    assert ingest(*args).count() == 4
    assert ingest(*args, force=True).columns == ["account_id"]
    with pytest.raises(ValueError, match="amount"):
        ingest(*args, required=("amount",), force=True)


def test_edited_schema_is_followed(spark, tmp_path):
    raw = tmp_path / "e.csv"
    raw.write_text("k,d,p\n1,05/01/2026,x\n2,06/01/2026,y\n")
    args = (spark, str(raw), str(tmp_path / "out"), tmp_path / "s.yaml", "e")
    assert dict(ingest(*args).dtypes) == {"k": "bigint", "d": "date", "p": "string"}
    from assay.sources.store import load

    schema = load(tmp_path / "s.yaml")
    schema["columns"][0]["type"], schema["columns"][1]["type"], schema["columns"][2]["type"] = "float", "string", "date"
    save(tmp_path / "s.yaml", schema)
    df = ingest(*args, force=True)
    assert dict(df.dtypes) == {"k": "double", "d": "string", "p": "string"}
    assert load_schema(tmp_path / "s.yaml")[0].type == "float"


def test_other_files(spark, tmp_path):
    with pytest.raises(FileNotFoundError):
        read_raw(spark, str(tmp_path / "no.csv"))
    with pytest.raises(ValueError, match="unsupported"):
        read_raw(spark, str(tmp_path / "x.json"))
    spark.range(3).withColumnRenamed("id", "An ID").write.parquet(str(tmp_path / "t.parquet"))
    df, headers = read_raw(spark, str(tmp_path / "t.parquet"))
    assert df.columns == ["an_id"] and headers == ["An ID"] and len(sample_rows(df, 2)) == 2
    typed_df, schema = typed(df, headers)
    assert schema[0].type == "integer" and typed_df.count() == 3


class Book(dict):
    sheetnames = property(list)


class Sheet(list):
    def iter_rows(self, values_only):
        return iter(self)


def test_sheets():
    one = Book(s=Sheet([("A", None, "B"), (1, 2), (dt.datetime(2026, 1, 5), None, "x", "more")]))
    assert sheet_rows(one, None) == ([["1", "2", None], ["2026-01-05", None, "x"]], ["A", "col_1", "B"])
    for book, name, said in ((Book(a=Sheet(), b=Sheet()), None, "several"), (one, "z", "no sheet"), (Book(a=Sheet()), None, "empty")):
        with pytest.raises(ValueError, match=said):
            sheet_rows(book, name)


def test_line_breaks_in_values(spark, tmp_path):
    """Found by quotes that a line leaves open; a file without them is split into several tasks."""
    (tmp_path / "a.csv").write_text('k,s\n1,"one\ntwo"\n2,"a ""quoted"" word"\n')
    (tmp_path / "b.csv").write_text('k,s\n1,"a ""quoted"" word, and more"\n2,x\n')
    rows = lambda f, **more: sorted(map(tuple, read_raw(spark, str(tmp_path / f), **more)[0].collect()))
    assert rows("a.csv") == [("1", "one\ntwo"), ("2", 'a "quoted" word')] and rows("b.csv") == [("1", 'a "quoted" word, and more'), ("2", "x")]
    assert len(rows("a.csv", multiline=False)) == 3 and rows("b.csv", multiline=True) == rows("b.csv")


def test_first_values_beyond_the_first_rows(spark, monkeypatch):
    from assay.sources import columns

    monkeypatch.setattr(columns, "LOOKED_AT", 4)
    df = spark.createDataFrame([("a", None)] * 5 + [("b", "2026-01-05")], "x string, y string").coalesce(1)
    assert columns._first_values(df, ["x", "y"]) == {"x": ["a"] * 5 + ["b"], "y": ["2026-01-05"]}
    assert columns._first_values(df.limit(2), ["x", "y"]) == {"x": ["a", "a"], "y": []} and columns._first_values(df, []) == {}


def test_workbooks(spark, tmp_path):
    with pytest.raises(ValueError, match="unsupported"):
        read_raw(spark, str(tmp_path / "old.xls"))
    openpyxl = pytest.importorskip("openpyxl")
    book = openpyxl.Workbook()
    book.active.append(["An ID", None, "Day"])
    book.active.append([1, "x", dt.datetime(2026, 1, 5)])
    book.save(tmp_path / "b.xlsx")
    df, headers = read_raw(spark, str(tmp_path / "b.xlsx"))
    assert df.columns == ["an_id", "col_1", "day"] and [tuple(r) for r in df.collect()] == [("1", "x", "2026-01-05")]
