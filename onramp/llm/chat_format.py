r"""Operator 11: chat formatting by a finite-state machine over roles and a declarative template.

A ``Template`` lists the marks of a turn, the label of each known role, the roles whose
text is learned from, and the moves of the machine. ``format_turns`` makes three segments
of every row (head, body, end), each with its loss flag; only the body of a learned role is
under the loss mask. Inside texts the first character of every control string becomes the
escape sign and a digit, the escape sign itself becomes the sign and 9; no control string
is left in a body, and ``read_back`` undoes it exactly. ``turn_order`` runs the machine:
narrow rows (no texts) are sorted into ranges of (conversation, turn), every range is
turned into one map of states per conversation, and the few maps of a conversation are
composed in order, so that a conversation with a third of all rows is spread over tasks.

``digests`` is sequential within one conversation, as a hash of all its turns must be: its
rows stream through one task in order, a batch at a time, and are never collected.

Edge cases: a null text is empty; a null role is the empty role; a role without a label is
written as ``=`` and its escaped name and has no move, so its conversation is not valid but
is formatted all the same; rows of equal turn are ordered by role and text, a null turn comes
first, repeated rows are turns of their own; rows with a null conv_id form one conversation;
very long texts are one segment; other columns, also of clashing names, are ignored; an
empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import pick, table

ESCAPE = "\\"


@dataclass(frozen=True)
class Template:
    """Marks, labels and moves. A turn is ``opening label closing body ending``."""

    opening: str = "### "
    closing: str = ": "
    ending: str = "</turn>\n"
    controls: tuple[str, ...] = ("###", "</turn>")
    labels: tuple[tuple[str, str], ...] = (("system", "System"), ("user", "User"), ("assistant", "Assistant"))
    learned: tuple[str, ...] = ("assistant",)
    start: str = "start"
    accepted: tuple[str, ...] = ("assistant",)
    moves: tuple[tuple[str, str, str], ...] = (
        ("start", "system", "system"), ("start", "user", "user"), ("system", "user", "user"),
        ("user", "assistant", "assistant"), ("assistant", "user", "user"))

    def __post_init__(self) -> None:
        marks = (*self.controls, self.closing)
        if len(marks) > 9 or any(not s or ESCAPE in s or s[0].isdigit() for s in marks):
            raise ValueError("up to eight control strings, without the escape sign and not starting with a digit")
        if not any(self.opening.startswith(s) for s in self.controls) or not any(self.ending.startswith(s) for s in self.controls):
            raise ValueError("opening and ending start with a control string")
        if any(label.startswith("=") or ESCAPE in label or any(s in label for s in marks) for _, label in self.labels):
            raise ValueError("labels hold no control string and do not start with =")

    @property
    def states(self) -> list[str]:
        return sorted({self.start, *(s for a, _, b in self.moves for s in (a, b))})


CHAT = Template()


# --- segments --------------------------------------------------------------------------

def _quoted(s: str) -> str:
    return "\\Q" + s + "\\E" if s else ""


def escaped(text: Column, controls: tuple[str, ...]) -> Column:
    out = F.replace(text, F.lit(ESCAPE), F.lit(ESCAPE + "9"))
    for i, s in enumerate(controls):
        # a look-ahead finds overlapping occurrences too
        out = F.regexp_replace(out, _quoted(s[0]) + (f"(?={_quoted(s[1:])})" if s[1:] else ""), ESCAPE * 2 + str(i))
    return out


def unescaped(text: Column, controls: tuple[str, ...]) -> Column:
    for i, s in enumerate(controls):
        text = F.replace(text, F.lit(ESCAPE + str(i)), F.lit(s[0]))
    return F.replace(text, F.lit(ESCAPE + "9"), F.lit(ESCAPE))


def format_turns(turns: DataFrame, template: Template = CHAT, conv_col: str = "conv_id", turn_col: str = "turn",
                 role_col: str = "role", text_col: str = "text") -> DataFrame:
    """conv_id, turn and ``segments`` (text, loss) of every row; no shuffle."""
    d = pick(turns, conv_id=conv_col, turn=turn_col, role=role_col, text=text_col)
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    label = F.concat(F.lit("="), escaped(role, (*template.controls, template.closing)))
    for name, mark in template.labels:
        label = F.when(role == name, F.lit(mark)).otherwise(label)
    head = F.concat(F.lit(template.opening), label, F.lit(template.closing))

    def segment(value: Column, loss: Column) -> Column:
        return F.struct(value.alias("text"), loss.alias("loss"))

    off = F.lit(False)
    return d.select("conv_id", "turn", F.array(
        segment(head, off), segment(escaped(text, template.controls), role.isin(*template.learned) if template.learned else off),
        segment(F.lit(template.ending), off)).alias("segments"))


def read_back(formatted: DataFrame, template: Template = CHAT) -> DataFrame:
    """conv_id, turn, role, text, learned text and length of each formatted turn, parsed from
    the joined segments and the loss flags alone."""
    whole = F.array_join(F.transform("segments", lambda s: s["text"]), "")
    pattern = f"(?s)^{_quoted(template.opening)}(.*?){_quoted(template.closing)}(.*){_quoted(template.ending)}$"
    label = F.regexp_extract("whole", pattern, 1)
    role = unescaped(F.substring(label, 2, 1 << 30), (*template.controls, template.closing))
    for name, mark in template.labels:
        role = F.when(label == mark, F.lit(name)).otherwise(role)
    learned = F.array_join(F.transform(F.filter("segments", lambda s: s["loss"]), lambda s: s["text"]), "")
    return formatted.select("conv_id", "turn", whole.alias("whole"), learned.alias("learned")).select(
        "conv_id", "turn", role.alias("role"), unescaped(F.regexp_extract("whole", pattern, 2), template.controls).alias("text"),
        unescaped(F.col("learned"), template.controls).alias("learned"), F.length("whole").cast("long").alias("chars"))


# --- machine ---------------------------------------------------------------------------

def turn_order(turns: DataFrame, template: Template = CHAT, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role") -> DataFrame:
    """conv_id, valid, and broken_at: the place (from 1) of the first turn without a move, one
    past the last turn where the machine does not stop in an accepted state, null if valid."""
    d = pick(turns, conv_id=conv_col, turn=turn_col, role=role_col).withColumn("role", F.coalesce("role", F.lit("")))
    states = template.states
    dead = len(states)
    go = {role: [dead] * (dead + 1) for _, role, _ in template.moves}
    for a, role, b in template.moves:
        go[role][states.index(a)] = states.index(b)
    nowhere = [dead] * (dead + 1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        conv, ends, broken, n, out = None, None, None, 0, []

        def rows():
            return pa.RecordBatch.from_arrays(
                [pa.array([o[0] for o in out], kind), pa.array([part] * len(out), pa.int32()), pa.array([o[3] for o in out], pa.int64()),
                 pa.array([o[1] for o in out], pa.list_(pa.int32())), pa.array([o[2] for o in out], pa.list_(pa.int64()))],
                names=["conv_id", "part", "n", "ends", "broken"])

        for b in batches:
            kind = b.column("conv_id").type
            for c, role in zip(b.column("conv_id").to_pylist(), b.column("role").to_pylist()):
                if ends is None or c != conv:
                    if ends is not None:
                        out.append((conv, ends, broken, n))
                    conv, ends, broken, n = c, list(range(dead + 1)), [None] * (dead + 1), 0
                n += 1
                move = go.get(role, nowhere)
                for s in range(dead):
                    if ends[s] != dead:
                        ends[s] = move[ends[s]]
                        if ends[s] == dead:
                            broken[s] = n
            if len(out) >= 10_000:
                yield rows()
                out = []
        if ends is not None:
            out.append((conv, ends, broken, n))
            yield rows()

    schema = T.StructType([d.schema["conv_id"], *(T.StructField(n, t) for n, t in (
        ("part", T.IntegerType()), ("n", T.LongType()), ("ends", T.ArrayType(T.IntegerType())), ("broken", T.ArrayType(T.LongType()))))])
    stretches = d.repartitionByRange("conv_id", "turn", "role").sortWithinPartitions("conv_id", "turn", "role").mapInArrow(run, schema)
    # one small row a range that a conversation lies in
    begin = F.struct(F.lit(states.index(template.start)).alias("state"), F.lit(0).cast("long").alias("seen"), F.lit(None).cast("long").alias("broken"))
    folded = F.aggregate("own", begin, lambda a, s: F.struct(
        F.get(s["ends"], a["state"]).alias("state"), (a["seen"] + s["n"]).alias("seen"),
        F.coalesce(a["broken"], a["seen"] + F.get(s["broken"], a["state"])).alias("broken")))
    ends_well = F.col("f.state").isin(*[states.index(s) for s in template.accepted])
    return (stretches.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("part", "n", "ends", "broken"))).alias("own"))
            .select("conv_id", folded.alias("f"))
            .select("conv_id", (F.col("f.broken").isNull() & ends_well).alias("valid"),
                    F.coalesce("f.broken", F.when(~ends_well, F.col("f.seen") + 1)).alias("broken_at")))


# --- digests ---------------------------------------------------------------------------

def digests(turns: DataFrame) -> DataFrame:
    """One row per conversation of ``read_back``: number and hash of its turns, length and hash
    of what is learned from, formatted length."""
    ordered = turns.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")
    schema = T.StructType([turns.schema["conv_id"], *(T.StructField(n, t) for n, t in (
        ("n_turns", T.LongType()), ("turns_sha256", T.StringType()), ("loss_chars", T.LongType()), ("loss_sha256", T.StringType()),
        ("formatted_chars", T.LongType())))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, out = None, []

        def closed(o):
            return o[0], o[1], o[2].hexdigest(), o[3], o[4].hexdigest(), o[5]

        def rows():
            cols = list(zip(*out))
            return pa.RecordBatch.from_arrays([pa.array(cols[0], kind), *(pa.array(c) for c in cols[1:])], names=schema.names)

        for b in batches:
            kind = b.column("conv_id").type
            binary = [b.column(c).cast(pa.binary()) for c in ("role", "text", "learned")]
            lengths = pc.utf8_length(b.column("learned")).to_pylist()
            for i, conv in enumerate(b.column("conv_id").to_pylist()):
                if own is None or own[0] != conv:
                    if own is not None:
                        out.append(closed(own))
                    own = [conv, 0, hashlib.sha256(), 0, hashlib.sha256(), 0]
                own[1] += 1
                for part in (binary[0][i].as_buffer(), b"\n", binary[1][i].as_buffer(), b"\n"):
                    own[2].update(part)
                own[3] += lengths[i]
                own[4].update(binary[2][i].as_buffer())
                own[5] += b.column("chars")[i].as_py()
            if len(out) >= 10_000:
                yield rows()
                out = []
        if own is not None:
            out.append(closed(own))
            yield rows()

    return ordered.mapInArrow(run, schema)


# Fixed value: the text of both turns of the added conversation.
ADDED = "\\### Assistant: </turn> ok"


def op11_chat_format(spark, sf_dir: str) -> DataFrame:
    """Every conversation and the added conversation -7, formatted and read back, with the
    machine's verdict."""
    given = pick(table(spark, sf_dir, "conversations"), conv_id="conv_id", turn="turn", role="role", text="text")
    role = F.when(F.col("id") == 0, F.lit("user")).otherwise(F.lit("assistant"))
    added = spark.range(2).select(F.lit(-7).cast(given.schema["conv_id"].dataType).alias("conv_id"), F.col("id").cast(given.schema["turn"].dataType).alias("turn"),
                                  role.alias("role"), F.lit(ADDED).alias("text"))
    turns = given.unionByName(added)
    order = turn_order(turns).withColumnRenamed("conv_id", "c")
    made = digests(read_back(format_turns(turns)))
    return made.join(order, F.col("conv_id").eqNullSafe(F.col("c"))).drop("c")


_BODY = (r"length(text) + length(text) - length(replace(text, '\', '')) + (length(text) - length(replace(text, '</turn>', ''))) // 7"
         " + coalesce(list_sum(list_transform(regexp_extract_all(text, '#{3,}'), lambda x: length(x) - 2)), 0)")
ORACLE = rf"""
WITH t AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
           UNION ALL SELECT -7, 0, 'user', '{ADDED}' UNION ALL SELECT -7, 1, 'assistant', '{ADDED}'),
r AS (SELECT *, row_number() OVER w AS place, lag(role) OVER w AS prev FROM t
      WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text)),
m AS (SELECT *, CASE WHEN place = 1 THEN role IN ('system', 'user') WHEN prev IN ('system', 'assistant') THEN role = 'user'
      WHEN prev = 'user' THEN role = 'assistant' ELSE false END AS moved,
      4 + CASE WHEN role IN ('system', 'user', 'assistant') THEN length(role) ELSE 1 + length(role) END + 2 + 8 + {_BODY} AS chars FROM r),
g AS (SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY place)) AS turns_sha256,
      coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
      sha256(coalesce(string_agg(text, '' ORDER BY place) FILTER (role = 'assistant'), '')) AS loss_sha256, sum(chars)::BIGINT AS formatted_chars,
      min(place) FILTER (NOT moved) AS bad, last(role ORDER BY place) AS ended FROM m GROUP BY conv_id)
SELECT conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars, bad IS NULL AND ended = 'assistant' AS valid,
       coalesce(bad, CASE WHEN ended <> 'assistant' THEN n_turns + 1 END) AS broken_at FROM g"""
