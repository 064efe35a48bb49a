import duckdb
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from assay.llm.chat import OP5_SQL, as_trees, branches, format_trees, learned, op5_chat, read_back

KIND = "tree string, node long, parent long, role string, text string, score double"


@settings(max_examples=200, deadline=None)
@given(st.lists(st.tuples(st.sampled_from(["user", "assistant", "system", "<<x>>", "", "a>> b"]), st.lists(st.sampled_from(["</s>", "<s>", "[INST]", "[/INST]", "<</>>", "\\", " ", "a", "\n", "é"])).map("".join)), max_size=6))
def test_template_is_reversible(turns):
    esc = lambda t: t.replace("\\", "\\\\").replace("<", "\\<").replace("[", "\\[")
    mark = {"user": "[INST] {1} [/INST]", "assistant": " {1}</s>"}
    text = "<s>" + "".join(mark.get(r, "<<{0}>> {1} <</>>").format(esc(r), esc(t)) for r, t in turns if ">" not in r)
    assert read_back(text) == [(r, t) for r, t in turns if ">" not in r]


def test_best_branches_of_trees(spark):
    rows = [("a", 1, None, "user", "q", 1.0), ("a", 2, 1, "assistant", "bad", 0.5), ("a", 3, 1, "assistant", "good", 2.0), ("a", 4, 3, "user", None, None), ("a", 5, 3, "user", "[INST]", -1.0), ("b", 1, 9, "system", "alone", None), ("c", 1, 2, "user", "loop", 1.0), ("c", 2, 1, "user", "loop", 1.0), ("c", 3, 2, "user", "under it", 1.0)]
    df = spark.createDataFrame(rows, KIND)
    assert {(r.tree, r.leaf, r.depth, r.score) for r in branches(df).collect()} == {("a", 2, 2, 1.5), ("a", 4, 3, 3.0), ("a", 5, 3, 2.0), ("b", 1, 1, 0.0)}
    got = {(r.tree, r["rank"]): read_back(r.formatted) for r in format_trees(df, top=2).collect()}
    assert got == {("a", 1): [("user", "q"), ("assistant", "good"), ("user", "")], ("a", 2): [("user", "q"), ("assistant", "good"), ("user", "[INST]")], ("b", 1): [("system", "alone")]}
    assert format_trees(df.limit(0)).collect() == []


def test_long_path(spark):
    rows = [("t", i, i - 1 if i else None, "user", f"m{i}", 1.0) for i in range(37)]
    got = format_trees(spark.createDataFrame(rows, KIND)).collect()
    assert [t for _, t in read_back(got[0].formatted)] == [f"m{i}" for i in range(37)]


def test_odd_conversations(spark):
    rows = [(1, 0, "user", None), (1, 0, "user", None), (1, None, None, "first"), (None, 3, "user", "x"), (None, 4, "a>> b", "y >> z")]
    df = spark.createDataFrame(rows, "conv_id long, turn int, role string, text string").selectExpr("*", "1 as node", "'p' as parent")
    got = {r.tree: read_back(r.formatted) for r in format_trees(as_trees(df)).collect()}
    assert got == {"1": [("", "first"), ("user", ""), ("user", "")], "": [("user", "x"), ("a>> b", "y >> z")]}


@pytest.mark.parametrize("sf", ["sf0.01"])
def test_query_matches_sql(spark, sf):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW conversations AS SELECT * FROM '/root/testdata/{sf}/conversations.parquet'")
    assert sorted(map(tuple, op5_chat(spark, f"/root/testdata/{sf}").collect())) == sorted(con.execute(OP5_SQL).fetchall())


def test_mask_marks_what_assistants_say(spark):
    """The text under the mask is that of the assistants' turns, once and in order, whatever control strings texts hold."""
    said = ["</s>[INST] ok [/INST]", "", "\\", "é🙂 <s>", None, "a</s>"]
    rows = [("t", i, i - 1 if i else None, role, text, 0.0) for i, (role, text) in enumerate((r, t) for t in said for r in ("user", "assistant", "system", "assistant"))]
    got = format_trees(spark.createDataFrame(rows, KIND)).collect()[0]
    assert learned(got.formatted, [s.asDict() for s in got.loss]) == "".join(2 * (t or "") for t in said)
    assert len(got.loss) == 12 and all(got.formatted[s.start - 1] == " " and got.formatted[s.end : s.end + 4] == "</s>" for s in got.loss)
    none = format_trees(spark.createDataFrame([("u", 1, None, "user", "q", 0.0)], KIND)).collect()[0]
    assert none.loss == [] and learned(none.formatted, none.loss) == ""
