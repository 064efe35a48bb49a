"""Chat formatting of reply trees.

Messages name their parent. Iterative self-joins enumerate the paths from roots to leaves: each round joins every message
with the ancestor found so far of its ancestor, so that paths of length n take log2(n) rounds. The sum of the scores along
a path ranks the branches of a tree; each chosen path becomes one conversation, formatted by a template that marks turns
and escapes its control strings in texts, so that the turns can be read back.

Template: ``<s>``, then for a user ``[INST] text [/INST]``, for an assistant a space, the text and ``</s>``, for any other
role ``<<role>> text <</>>``. In texts and roles ``\\``, ``<`` and ``[`` stand after a ``\\``, in roles ``>`` too.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import stored, tidy


BEGIN = "<s>"


def _escaped(text: Column) -> Column:
    text = F.replace(text, F.lit("\\"), F.lit("\\\\"))
    return F.replace(F.replace(text, F.lit("<"), F.lit("\\<")), F.lit("["), F.lit("\\["))


def _marked(role: Column, text: Column) -> Column:
    """One turn as it stands in the formatted text."""
    said = _escaped(F.coalesce(text, F.lit("")))
    other = F.replace(_escaped(F.coalesce(role, F.lit(""))), F.lit(">"), F.lit("\\>"))
    named = F.concat(F.lit("<<"), other, F.lit(">> "), said, F.lit(" <</>>"))
    return F.when(role == "user", F.concat(F.lit("[INST] "), said, F.lit(" [/INST]"))).when(role == "assistant", F.concat(F.lit(" "), said, F.lit("</s>"))).otherwise(named)


@tidy
def branches(messages: DataFrame) -> DataFrame:
    """(tree, leaf, depth, score) of every root-to-leaf path of messages (tree, node, parent, score).

    ``node`` is unique in its tree and its parent null or absent for roots. A null score counts 0. Messages on a cycle, or
    below one, reach no root and are on no path.
    """
    nodes = messages.select("tree", "node", "parent", F.coalesce(F.col("score").cast("double"), F.lit(0.0)).alias("score"))
    known = nodes.select("tree", F.col("node").alias("up"), F.lit(1).alias("there"))
    state = nodes.withColumnRenamed("parent", "up").join(known, ["tree", "up"], "left")
    # up: the ancestor that the sums reach, itself not counted; null: they reach the root
    state = state.select("tree", "node", F.when(F.col("there") == 1, F.col("up")).alias("up"), "score", F.lit(1).cast("long").alias("depth"))
    parents = state.select("tree", F.col("up").alias("node")).where("node is not null").distinct()
    state = stored(state, "paths")
    open_before = None
    while True:
        n_open = state.where("up is not null").count()
        if n_open == 0 or (open_before is not None and n_open == open_before and _looping(state)):
            break
        open_before = n_open
        above = state.select("tree", F.col("node").alias("up"), F.col("up").alias("up2"), F.col("score").alias("score2"), F.col("depth").alias("depth2"))
        done, rest = state.where("up is null"), state.where("up is not null").join(above, ["tree", "up"])
        rest = rest.select("tree", "node", F.col("up2").alias("up"), (F.col("score") + F.col("score2")).alias("score"), (F.col("depth") + F.col("depth2")).alias("depth"))
        state = stored(done.unionByName(rest), "paths")
    leaves = state.where("up is null").join(parents, ["tree", "node"], "left_anti")
    return leaves.select("tree", F.col("node").alias("leaf"), "depth", "score")


def _looping(state: DataFrame) -> bool:
    """All sums that are open belong to cycles: none of them points at one that reaches a root."""
    open_, done = state.where("up is not null"), state.where("up is null").select("tree", F.col("node").alias("up"))
    return open_.join(done, ["tree", "up"], "left_semi").isEmpty()


@tidy
def chosen_paths(messages: DataFrame, top: int = 1) -> DataFrame:
    """(tree, leaf, rank, node, depth) of the ``top`` best branches of each tree, each with all its messages.

    Ranked by score, then by depth, then by leaf. Paths are followed back from the leaves by ancestors at distances of
    powers of two, farthest first, again in log2 rounds.
    """
    ranked = branches(messages).withColumn("rank", F.row_number().over(Window.partitionBy("tree").orderBy(F.desc("score"), F.desc("depth"), "leaf")))
    best = stored(ranked.where(F.col("rank") <= top), "best")
    longest = best.agg(F.max("depth")).first()[0] or 0
    steps = [stored(messages.select("tree", "node", F.col("parent").alias("up")), "ups")]
    while 1 << len(steps) < longest:
        last = steps[-1]
        far = last.select("tree", F.col("node").alias("up"), F.col("up").alias("up2"))
        steps.append(stored(last.join(far, ["tree", "up"]).where("up2 is not null").select("tree", "node", F.col("up2").alias("up")), "ups"))
    on_path = best.select("tree", "leaf", "rank", F.col("leaf").alias("node"), "depth")
    for k in reversed(range(len(steps))):
        higher = on_path.join(steps[k], ["tree", "node"]).where(F.col("depth") > (1 << k))
        on_path = on_path.unionByName(higher.select("tree", "leaf", "rank", F.col("up").alias("node"), (F.col("depth") - (1 << k)).alias("depth")))
        on_path = stored(on_path, "path")  # each round reads it twice
    return on_path


@tidy
def format_trees(messages: DataFrame, top: int = 1) -> DataFrame:
    """(tree, rank, formatted, loss) of the chosen paths of messages (tree, node, parent, role, text, score).

    ``loss`` is the mask of what a model is to learn: the spans (start, end), in characters of ``formatted``, of the texts of
    assistants, without marks. Null texts and roles count as empty. A tree that has no root has no path. One conversation
    is one row, however long.
    """
    turns = chosen_paths(messages.select("tree", "node", "parent", "score"), top)
    turns = turns.join(messages.select("tree", "node", (F.col("role") == "assistant").alias("learned"), _marked(F.col("role"), F.col("text")).alias("turn")), ["tree", "node"])
    earlier = Window.partitionBy("tree", "rank").orderBy("depth").rowsBetween(Window.unboundedPreceding, -1)
    turns = turns.withColumn("start", F.lit(len(BEGIN)) + F.coalesce(F.sum(F.char_length("turn")).over(earlier), F.lit(0)))
    span = F.struct((F.col("start") + 1).alias("start"), (F.col("start") + F.char_length("turn") - len("</s>")).alias("end"))
    whole = turns.groupBy("tree", "rank").agg(F.sort_array(F.collect_list(F.struct("depth", "turn", F.when(F.col("learned"), span).alias("span")))).alias("turns"))
    spans = F.filter(F.col("turns.span"), lambda s: s.isNotNull())
    return whole.select("tree", "rank", F.concat(F.lit(BEGIN), F.array_join(F.col("turns.turn"), "")).alias("formatted"), spans.alias("loss"))


def as_trees(rows: DataFrame) -> DataFrame:
    """Conversations (conv_id, turn, role, text) as trees in which each row replies to the one before it.

    Order: turn, then role, then text; repeated rows follow each other. Null ids are one conversation. Scores are 0.
    """
    order = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    nodes = rows.select("conv_id", "turn", "role", "text").withColumn("node", F.row_number().over(order))
    tree = F.coalesce(F.col("conv_id").cast("string"), F.lit(""))
    return nodes.select(tree.alias("tree"), "conv_id", F.col("node").cast("long").alias("node"), F.when(F.col("node") > 1, F.col("node") - 1).cast("long").alias("parent"), "role", "text", F.lit(0.0).alias("score"))


_TURN = re.compile(r"\[INST\] ((?:\\.|[^\\\[])*) \[/INST\]| ((?:\\.|[^\\<])*)</s>|<<((?:\\.|[^\\>])*)>> ((?:\\.|[^\\<])*) <</>>", re.DOTALL)
_ESCAPE = re.compile(r"\\(.)", re.DOTALL)


def unescaped(text: str) -> str:
    return _ESCAPE.sub(r"\1", text)


def learned(formatted: str, loss: list[dict]) -> str:
    """All text under the mask, as it was before escaping."""
    return "".join(unescaped(formatted[s["start"] : s["end"]]) for s in loss)


def read_back(formatted: str) -> list[tuple[str, str]]:
    """(role, text) of each turn of a formatted conversation. Raises ValueError if it isn't one."""
    if not formatted.startswith(BEGIN):
        raise ValueError("no <s> at the start")
    at, turns = len(BEGIN), []
    while at < len(formatted):
        m = _TURN.match(formatted, at)
        if not m:
            raise ValueError(f"no turn at {at}")
        user, assistant, role, said = m.groups()
        found = ("user", user) if user is not None else ("assistant", assistant) if assistant is not None else (role, said)
        turns.append(tuple(map(unescaped, found)))
        at = m.end()
    return turns


@tidy
def op5_chat(spark, sf_dir: str) -> DataFrame:
    """Every conversation, and number -1, formatted and read back."""
    more = spark.createDataFrame([(-1, 0, "user", "</s>[INST] ok [/INST]"), (-1, 1, "assistant", "</s>[INST] ok [/INST]")], "conv_id long, turn int, role string, text string")
    rows = spark.read.parquet(f"{sf_dir}/conversations.parquet").select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("int").alias("turn"), "role", "text").unionByName(more)
    messages = stored(as_trees(rows), "messages")
    formatted = format_trees(messages).join(messages.where("node = 1").select("tree", "conv_id"), "tree").select("conv_id", "formatted", "loss")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, sha, loss_n, loss_sha, chars = [], [], [], [], []
            for text, mask in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                turns, loss = read_back(text), learned(text, mask)
                n.append(len(turns))
                sha.append(hashlib.sha256("".join(f"{role}\n{said}\n" for role, said in turns).encode()).hexdigest())
                loss_n.append(len(loss))
                loss_sha.append(hashlib.sha256(loss.encode()).hexdigest())
                chars.append(len(text))
            cols = [batch.column(0), pa.array(n, pa.int64()), pa.array(sha, pa.string()), pa.array(loss_n, pa.int64()), pa.array(loss_sha, pa.string()), pa.array(chars, pa.int64())]
            yield pa.RecordBatch.from_arrays(cols, names=["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"])

    return formatted.mapInArrow(run, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")


OP5_SQL = r"""
WITH c AS (SELECT conv_id::BIGINT AS conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
           UNION ALL VALUES (-1, 0, 'user', '</s>[INST] ok [/INST]'), (-1, 1, 'assistant', '</s>[INST] ok [/INST]')),
e AS (SELECT *, replace(replace(replace(text, '\', '\\'), '<', '\<'), '[', '\[') AS t FROM c)
SELECT conv_id, count(*)::BIGINT AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
       coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0)::BIGINT AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
       (3 + sum(length(t) + CASE role WHEN 'user' THEN 15 WHEN 'assistant' THEN 5 ELSE 11 + length(replace(replace(replace(replace(role, '\', '\\'), '<', '\<'), '[', '\['), '>', '\>')) END))::BIGINT AS formatted_chars
FROM e GROUP BY conv_id
"""
