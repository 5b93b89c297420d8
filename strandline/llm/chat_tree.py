"""Chat formatting as prefix trees.

Conversations that share initial turns are merged: in the order of their paths (the list of turn
hashes) those with a common beginning stand together, and that order is a depth-first walk, so each
turn is written when it is first met and never again. A shard is a self-contained forest of bounded
length: its flat text, and for each node (turn) parent, start and stop in the text, position of its
first character within its conversation, the loss interval, and the intervals of the text that its
characters may attend to besides their own node's earlier ones: its ancestors, neighbours merged.
The unit is the character; `position_ids` expands a shard. Sorting is a range exchange over
(path, conversation), so neither a common first turn nor copies of one conversation meet in one task;
only where a shard ends is a shared beginning written again.

Template: `[INST] text [/INST]` for user, ` text </s>` for assistant, `<<SYS>> text <</SYS>>` for system and
`[ROLE name] text [/ROLE]` for any other role. Inside texts and names a backslash is doubled and control strings get
a backslash behind their first character, which `unescape` takes away again.

Null texts and roles are empty. Turns go by number, then role, then text; equal turns are kept.
A null conversation id is a conversation of its own. Empty table: empty result.
"""

from __future__ import annotations

import hashlib
import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import buckets_for, table, written

SHARD_CHARS = 1 << 19
FORMS = {"user": ("[INST] ", " [/INST]"), "assistant": (" ", " </s>"), "system": ("<<SYS>> ", " <</SYS>>")}
CONTROL = ("[INST]", "[/INST]", "</s>", "<<SYS>>", "<</SYS>>", "[ROLE", "[/ROLE]")
_CONTROL = re.compile("|".join(re.escape(x) for x in CONTROL))
_TURN = re.compile(r"\[INST\] (?P<user>.*?) \[/INST\]|<<SYS>> (?P<system>.*?) <</SYS>>|\[ROLE (?P<name>.*?)\] (?P<other>.*?) \[/ROLE\]| (?P<assistant>.*?) </s>", re.S)


def escape(text: str) -> str:
    return _CONTROL.sub(lambda m: m[0][0] + "\\" + m[0][1:], text.replace("\\", "\\\\"))


def unescape(text: str) -> str:
    return re.sub(r"\\(.)", r"\1", text, flags=re.S)


def escape_name(name: str) -> str:
    return escape(name).replace("]", "\\]")


def format_turn(role: str, text: str) -> tuple[str, int, int]:
    """(formatted turn, start and stop of the text in it)."""
    inner = escape(text)
    if role in FORMS:
        head, tail = FORMS[role]
    else:
        head, tail = f"[ROLE {escape_name(role)}] ", " [/ROLE]"
    return head + inner + tail, len(head), len(head) + len(inner)


def parse(text: str) -> list[tuple[str, str]]:
    """The turns of a formatted conversation."""
    out, at = [], 0
    name = re.compile(r"\[ROLE ((?:\\.|[^\\\]])*)\] (.*?) \[/ROLE\]", re.S)
    while at < len(text):
        if text.startswith("[ROLE ", at):
            m = name.match(text, at)
            out.append((unescape(m[1]), unescape(m[2])))
        else:
            m = _TURN.match(text, at)
            role = m.lastgroup
            out.append((role, unescape(m[role])))
        at = m.end()
    return out


class Forest:
    """A shard being written; add conversations in path order."""

    def __init__(self):
        self.text, self.length, self.stack = [], 0, []
        self.nodes: dict[str, list] = {k: [] for k in ("parent", "start", "stop", "position", "loss_start", "loss_stop", "attend")}
        self.convs: list[tuple] = []

    def add(self, conv_id, turns: list[tuple[str, str]]) -> None:
        k = 0
        while k < len(self.stack) and k < len(turns) and self.stack[k][1] == turns[k]:
            k += 1
        del self.stack[k:]
        n = self.nodes
        for turn in turns[k:]:
            formatted, a, b = format_turn(*turn)
            parent = self.stack[-1][0] if self.stack else -1
            above: list = []
            if parent >= 0:
                above = [list(x) for x in n["attend"][parent]]
                if above and above[-1][1] == n["start"][parent]:
                    above[-1][1] = n["stop"][parent]
                else:
                    above.append([n["start"][parent], n["stop"][parent]])
            loss = (self.length + a, self.length + b) if turn[0] == "assistant" else (self.length, self.length)
            here = len(n["parent"])
            position = n["position"][parent] + n["stop"][parent] - n["start"][parent] if parent >= 0 else 0
            for key, v in (("parent", parent), ("start", self.length), ("stop", self.length + len(formatted)), ("position", position), ("loss_start", loss[0]), ("loss_stop", loss[1]), ("attend", above)):
                n[key].append(v)
            self.text.append(formatted)
            self.length += len(formatted)
            self.stack.append((here, turn))
        self.convs.append((conv_id, self.stack[-1][0]))

    def row(self) -> dict:
        return {"text": "".join(self.text), **self.nodes, "conv_ids": [c for c, _ in self.convs], "leaves": [x for _, x in self.convs]}


SHARD = "text string, parent array<int>, start array<int>, stop array<int>, position array<int>, loss_start array<int>, loss_stop array<int>, attend array<array<int>>, conv_ids array<long>, leaves array<int>"


def _flat_attend(row: dict) -> dict:
    return row | {"attend": [[v for pair in x for v in pair] for x in row["attend"]]}


def format_conversations(conv: DataFrame, shard_chars: int = SHARD_CHARS) -> DataFrame:
    """The table of shards of conversations (conv_id, turn, role, text), written and read back."""
    turns = conv.select(F.col("conv_id").cast("long").alias("conv_id"), F.struct("turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text")).alias("t"))
    whole = turns.groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("turns"))
    whole = whole.withColumn("path", F.transform("turns", lambda t: F.xxhash64(t["role"], t["text"])))
    n = buckets_for(conv.sparkSession, conv, 4 << 20)
    ordered = whole.repartitionByRange(n, "path", "conv_id").sortWithinPartitions("path", "conv_id").select("conv_id", "turns")

    def run(batches):
        import pyarrow as pa

        forest, schema = Forest(), None
        schema = pa.schema([("text", pa.string()), *[(k, pa.list_(pa.int32())) for k in ("parent", "start", "stop", "position", "loss_start", "loss_stop")], ("attend", pa.list_(pa.list_(pa.int32()))), ("conv_ids", pa.list_(pa.int64())), ("leaves", pa.list_(pa.int32()))])
        for batch in batches:
            for k in range(batch.num_rows):
                forest.add(batch.column(0)[k].as_py(), [(t["role"], t["text"]) for t in batch.column(1)[k].as_py()])
                if forest.length >= shard_chars:
                    yield pa.RecordBatch.from_pylist([_flat_attend(forest.row())], schema=schema)
                    forest = Forest()
        if forest.convs:
            yield pa.RecordBatch.from_pylist([_flat_attend(forest.row())], schema=schema)

    return written(ordered.mapInArrow(run, SHARD), "chat-forest")


def position_ids(row: dict) -> list[int]:
    """The position of every character of a shard within its conversations."""
    out = [0] * len(row["text"])
    for start, stop, position in zip(row["start"], row["stop"], row["position"], strict=True):
        out[start:stop] = range(position, position + stop - start)
    return out


def conversation_text(row: dict, leaf: int) -> str:
    """What a leaf attends to, its own turn included: the formatted conversation."""
    a = row["attend"][leaf]
    return "".join(row["text"][a[k] : a[k + 1]] for k in range(0, len(a), 2)) + row["text"][row["start"][leaf] : row["stop"][leaf]]


def loss_texts(row: dict, leaf: int) -> list[str]:
    """The texts under the loss mask along a conversation, in order, unescaped."""
    out = []
    while leaf >= 0:
        if row["loss_stop"][leaf] > row["loss_start"][leaf]:
            out.append(unescape(row["text"][row["loss_start"][leaf] : row["loss_stop"][leaf]]))
        leaf = row["parent"][leaf]
    return out[::-1]


def read_conversations(shards: DataFrame) -> DataFrame:
    """Per conversation, from the shards: counts and digests of its turns and of its loss mask."""

    def run(batches):
        import pyarrow as pa

        schema = pa.schema([("conv_id", pa.int64()), ("n_turns", pa.int64()), ("turns_sha256", pa.string()), ("loss_chars", pa.int64()), ("loss_sha256", pa.string()), ("formatted_chars", pa.int64()), ("new_chars", pa.int64())])
        for batch in batches:
            for row in batch.to_pylist():
                out, seen = [], set()
                for conv, leaf in zip(row["conv_ids"], row["leaves"], strict=True):
                    text = conversation_text(row, leaf)
                    turns, loss = parse(text), "".join(loss_texts(row, leaf))
                    digest = hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in turns).encode())
                    new, node = 0, leaf
                    while node >= 0 and node not in seen:
                        seen.add(node)
                        new += row["stop"][node] - row["start"][node]
                        node = row["parent"][node]
                    out.append({"conv_id": conv, "n_turns": len(turns), "turns_sha256": digest.hexdigest(), "loss_chars": len(loss), "loss_sha256": hashlib.sha256(loss.encode()).hexdigest(), "formatted_chars": len(text), "new_chars": new})
                yield pa.RecordBatch.from_pylist(out, schema=schema)

    return shards.mapInArrow(run, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, new_chars long")


PLANTED = "</s>[INST] ok [/INST]"


def op6_chat_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    conv = table(spark, sf_dir, "conversations").select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), "role", "text")
    more = spark.range(2).select(F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(PLANTED).alias("text"))
    return read_conversations(format_conversations(conv.unionByName(more))).drop("new_chars")


def _escaped_sql(x: str) -> str:
    out = f"replace({x}, '\\', '\\\\')"
    for c in CONTROL:
        out = f"replace({out}, '{c}', '{c[0]}\\{c[1:]}')"
    return out


SQL = rf"""
WITH c AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '{PLANTED}' UNION ALL SELECT -7, 1, 'assistant', '{PLANTED}'
)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
       sum(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END)::BIGINT AS loss_chars,
       sha256(coalesce(string_agg(CASE WHEN role = 'assistant' THEN text END, '' ORDER BY turn, role, text), '')) AS loss_sha256,
       sum(length({_escaped_sql('text')}) + CASE role WHEN 'user' THEN 15 WHEN 'assistant' THEN 6 WHEN 'system' THEN 17
           ELSE length(replace({_escaped_sql('role')}, ']', '\]')) + 16 END)::BIGINT AS formatted_chars
FROM c GROUP BY conv_id
"""
