"""Chat formatting over reply trees.

Messages name their parent. Pointer doubling - a self-join per doubling - gives every message its
depth and the score of its branch down from the root; leaves are ranked by branch score, and the
same jump tables, joined once more each, list the messages on the chosen root-to-leaf paths. Each
path becomes one formatted conversation with a loss mask over its assistant texts.

Defined cases: null role or text count as empty; a message whose parent does not exist is a root;
messages that reach no root (a cycle) are left out; equal branch scores go to the smaller leaf;
repeated rows of a linear conversation are turns of their own; rows with a null conv_id are one
conversation, whose conv_id comes back null; an empty table gives no conversation; other columns are
left out.
"""

from __future__ import annotations

import hashlib
import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from . import common

#: stands for a null conv_id between the steps
NO_ID = -(2**63)
#: Fixed by the template: what opens and closes a turn. A control string begins with < or [, and
#: these two and the backslash are escaped by a backslash wherever text or role hold them.
USER, ASSISTANT, OTHER = ("[INST] ", " [/INST]"), (" ", " </s>"), ("<<", ">>", "<</>>")
_ESCAPE, _UNESCAPE = re.compile(r"[\\<\[]"), re.compile(r"\\(.)", re.S)
_BODY = r"((?:[^\\<\[]|\\.)*)"
_TURN = re.compile(rf"\[INST\] {_BODY} \[/INST\]| {_BODY} </s>|<<((?:[^\\<\[>]|\\.|>(?!>))*)>>{_BODY}<</>>", re.S)


def escape(text: str) -> str:
    return _ESCAPE.sub(lambda m: "\\" + m[0], text)


def unescape(text: str) -> str:
    return _UNESCAPE.sub(r"\1", text)


def render(turns) -> tuple[str, list[tuple[int, int]]]:
    """The formatted conversation of (role, text) turns, and the spans of assistant text in it."""
    out, spans, at = [], [], 0
    for role, text in turns:
        body = escape(text)
        if role == "user":
            before, after = USER
        elif role == "assistant":
            before, after = ASSISTANT
            spans.append((at + len(before), at + len(before) + len(body)))
        else:
            before, after = OTHER[0] + escape(role).replace(">", "\\>") + OTHER[1], OTHER[2]
        out += [before, body, after]
        at += len(before) + len(body) + len(after)
    return "".join(out), spans


def parse(formatted: str) -> list[tuple[str, str]]:
    turns, at = [], 0
    while at < len(formatted):
        m = _TURN.match(formatted, at)
        if not m:
            raise ValueError(f"no turn at character {at}")
        if m[1] is not None:
            turns.append(("user", unescape(m[1])))
        elif m[2] is not None:
            turns.append(("assistant", unescape(m[2])))
        else:
            turns.append((unescape(m[3]), unescape(m[4])))
        at = m.end()
    return turns


def branches(nodes: DataFrame, per_tree: int = 1) -> DataFrame:
    """(tree, leaf, node, depth, branch_score): the messages on the best ``per_tree`` paths of each tree.
    ``nodes``: tree, node, parent (null: root), score."""
    base = nodes.select("tree", "node", "parent", F.coalesce(F.col("score"), F.lit(0.0)).alias("score"))
    known = base.select("tree", F.col("node").alias("parent"), F.lit(True).alias("_known"))
    base = base.join(known, ["tree", "parent"], "left").select("tree", "node", F.when(F.col("_known"), F.col("parent")).alias("up"), "score")
    state = common.cut(base.select("tree", "node", "up", F.col("score").alias("sum"), F.lit(1).cast("long").alias("depth")), "tree")
    jumps, before = [], None
    while (left := state.where("up is not null").count()) and left != before:
        before = left
        jumps.append(state.where("up is not null").select("tree", "node", "up"))
        over = state.select("tree", F.col("node").alias("up"), F.col("up").alias("_up"), F.col("sum").alias("_sum"), F.col("depth").alias("_depth"))
        joined = state.where("up is not null").join(over, ["tree", "up"], "left")  # rows at their root are done
        joined = joined.select("tree", "node", F.col("_up").alias("up"), (F.col("sum") + F.coalesce("_sum", F.lit(0.0))).alias("sum"), (F.col("depth") + F.coalesce("_depth", F.lit(0))).alias("depth"))
        state = common.cut(state.where("up is null").unionByName(joined), "tree")
    rooted = state.where("up is null")
    inner = jumps[0].select("tree", F.col("up").alias("node")).distinct() if jumps else None
    leaves = rooted.join(inner, ["tree", "node"], "left_anti") if inner is not None else rooted
    best = leaves.withColumn("_rank", F.row_number().over(W.partitionBy("tree").orderBy(F.desc("sum"), "node"))).where(F.col("_rank") <= per_tree)
    members = common.cut(best.select("tree", F.col("node").alias("leaf"), "node", F.col("sum").alias("branch_score")), "path")
    for jump in jumps:  # ancestors 1, then 2, 4, ... steps above what is listed already
        more = members.join(jump, ["tree", "node"]).select("tree", "leaf", F.col("up").alias("node"), "branch_score")
        members = common.cut(members.unionByName(more), "path")
    return members.join(rooted.select("tree", "node", "depth"), ["tree", "node"]).select("tree", "leaf", "node", "depth", "branch_score")


def format_paths(messages: DataFrame, per_tree: int = 1) -> DataFrame:
    """tree, leaf, formatted, loss_spans: ``messages`` has tree, node, parent, score, role, text."""
    path = branches(messages, per_tree)
    text = messages.select("tree", "node", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    turns = path.join(text, ["tree", "node"]).groupBy("tree", "leaf").agg(F.sort_array(F.collect_list(F.struct("depth", "node", "role", "text"))).alias("turns"))

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            made = [render([(t["role"], t["text"]) for t in x]) for x in batch.column(2).to_pylist()]
            spans = pa.array([[{"start": a, "stop": b} for a, b in s] for _, s in made], pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())])))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([m for m, _ in made], pa.string()), spans], ["tree", "leaf", "formatted", "loss_spans"])

    return turns.mapInArrow(run, "tree long, leaf long, formatted string, loss_spans array<struct<start:long,stop:long>>")


def linear(conversations: DataFrame) -> DataFrame:
    """Conversations by turn as reply trees of one branch: each row answers the row before it."""
    c = conversations.select(F.col("conv_id").cast("long").alias("tree"), "turn", "role", "text")
    c = c.withColumn("node", F.row_number().over(W.partitionBy("tree").orderBy(F.asc_nulls_first("turn"), "role", "text")).cast("long"))
    return c.select(F.coalesce("tree", F.lit(NO_ID)).alias("tree"), "node", F.when(F.col("node") > 1, F.col("node") - 1).alias("parent"), F.lit(0.0).alias("score"), "role", "text")


def read_back(formatted: DataFrame) -> DataFrame:
    """Digests of what the formatted rows say: tree, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars."""

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            rows = []
            for tree, text, spans in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                turns = parse(text)
                loss = "".join(unescape(text[s["start"] : s["stop"]]) for s in spans)
                said = "".join(f"{r}\n{t}\n" for r, t in turns)
                rows.append((tree, len(turns), hashlib.sha256(said.encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest(), len(text)))
            cols = list(zip(*rows)) or [[]] * 6
            kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], ["tree", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"])

    schema = "tree long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"
    return formatted.select("tree", "formatted", "loss_spans").mapInArrow(run, schema)


#: Conversation -1, as the contract gives it.
EXTRA = [(-1, 0, "user", "</s>[INST] ok [/INST]"), (-1, 1, "assistant", "</s>[INST] ok [/INST]")]


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = common.read(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    rows = rows.unionByName(spark.createDataFrame(EXTRA, "conv_id long, turn long, role string, text string"))
    conv_id = F.when(F.col("tree") != NO_ID, F.col("tree"))
    return read_back(format_paths(linear(rows))).select(conv_id.alias("conv_id"), "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars")


SQL = """
WITH c AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]'
  UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'
), e AS (
  SELECT *, length(text) + length(text) - length(replace(text, chr(92), ''))
         + length(text) - length(replace(text, '<', '')) + length(text) - length(replace(text, '[', '')) AS body FROM c
)
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
       CAST(sum(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END) AS BIGINT) AS loss_chars,
       sha256(coalesce(string_agg(CASE WHEN role = 'assistant' THEN text END, '' ORDER BY turn, role, text), '')) AS loss_sha256,
       CAST(sum(body + CASE role WHEN 'user' THEN 15 WHEN 'assistant' THEN 6 ELSE 9 + length(role) END) AS BIGINT) AS formatted_chars
FROM e GROUP BY conv_id
"""
