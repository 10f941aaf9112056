"""Chat formatting (native): a finite-state machine over roles and a declarative template.

The template gives each role a header, the end of a turn, and which roles carry the loss.
The machine's transitions say which role may follow which; a conversation is valid if every
step is a transition and it ends in an accepting state.

``format_turns`` is the operator: one row per turn with its formatted segments and their
loss flags. It needs only the turn before, a streaming window over the sorted turns, and
gathers nothing. ``join_turns`` gathers a conversation into one string; ``read_back`` parses
such a string again. Control strings inside texts are escaped reversibly: a backslash becomes
two, and the i-th control string a backslash and the i-th letter; afterwards no control
string is left in the text, because none of them holds a backslash.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import rows_frame, table


@dataclass(frozen=True)
class Template:
    """Headers by role, other roles' header, the marks, the loss roles and the machine."""

    headers: tuple[tuple[str, str], ...] = (
        ("system", "### System: "), ("user", "### User: "), ("assistant", "### Assistant: "))
    other: str = "### Other: "
    role_end: str = "</role>"
    turn_end: str = "</turn>"
    after: str = "\n"
    loss_roles: tuple[str, ...] = ("assistant",)
    transitions: tuple[tuple[str, str], ...] = (
        ("start", "system"), ("start", "user"), ("system", "user"), ("user", "assistant"), ("assistant", "user"))
    accepting: tuple[str, ...] = ("assistant",)

    @property
    def controls(self) -> tuple[str, ...]:
        return (*(h for _, h in self.headers), self.other, self.role_end, self.turn_end)


DEFAULT = Template()


def escape(text: Column, t: Template = DEFAULT) -> Column:
    """Backslashes doubled, control strings replaced by a backslash and a letter."""
    out = F.replace(text, F.lit("\\"), F.lit("\\\\"))
    for i, control in enumerate(t.controls):
        out = F.replace(out, F.lit(control), F.lit("\\" + chr(ord("a") + i)))
    return out


def unescape(text: Column, t: Template = DEFAULT) -> Column:
    """The inverse of ``escape``, in one pass over the escapes."""
    codes = F.create_map(
        F.lit("\\\\"), F.lit("\\"),
        *[F.lit(x) for i, c in enumerate(t.controls) for x in ("\\" + chr(ord("a") + i), c)],
    )
    parts = F.regexp_extract_all(text, F.lit(r"(?s)\\.|[^\\]+"), F.lit(0))
    return F.array_join(F.transform(parts, lambda p: F.coalesce(F.element_at(codes, p), p)), "")


def format_turns(turns: DataFrame, t: Template = DEFAULT) -> DataFrame:
    """One row per turn: conv_id, turn, role, text, state, step_ok, segments.

    ``segments`` is an array of (text, loss): header, escaped text, end of turn. Null texts are
    empty; a null role is the empty role; roles without a header of their own use ``other`` and
    keep their name in the output. Turns are ordered by (turn, role, text), nulls first, so ties
    and repeated rows have one defined order. Null conv_ids form one conversation. Other
    columns are dropped."""
    clean = turns.select(
        "conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text")
    )
    order = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    known = F.create_map(*[F.lit(x) for pair in t.headers for x in pair])
    header = F.coalesce(
        F.element_at(known, F.col("role")),
        F.concat(F.lit(t.other), escape(F.col("role"), t), F.lit(t.role_end)),
    )
    steps = F.array(*[F.lit(f"{a}\x00{b}") for a, b in t.transitions])
    loss = F.col("role").isin(*t.loss_roles)
    seg = lambda x, flag: F.struct(x.alias("text"), flag.alias("loss"))
    return (
        clean.withColumn("before", F.coalesce(F.lag("role").over(order), F.lit("start")))
        .withColumn("position", F.row_number().over(order))
        .withColumn("last_turn", F.lead("role").over(order).isNull())
        .withColumn("step_ok", F.array_contains(steps, F.concat("before", F.lit("\x00"), "role"))
                    & (~F.col("last_turn") | F.col("role").isin(*t.accepting)))
        .withColumn("segments", F.array(
            seg(header, F.lit(False)), seg(escape(F.col("text"), t), loss),
            seg(F.lit(t.turn_end + t.after), F.lit(False))))
        .drop("before", "last_turn")
    )


def join_turns(formatted: DataFrame) -> DataFrame:
    """One row per conversation: conv_id, n_turns, valid, segments, formatted, loss_spans.

    ``loss_spans`` is the loss mask: (start, chars) in code points of ``formatted``, in order.
    A conversation is one training example and so must fit into one row, very long texts included; this is the only
    gathering here. Null conv_ids are one conversation."""
    turn = F.struct("position", "step_ok", "segments")
    spans = F.aggregate(
        "segments", F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,chars:int>>").alias("spans")),
        lambda acc, s: F.struct((acc["at"] + F.length(s["text"])).alias("at"), F.when(s["loss"], F.array_append(acc["spans"], F.struct(
            acc["at"].alias("start"), F.length(s["text"]).alias("chars")))).otherwise(acc["spans"]).alias("spans")),
        lambda acc: acc["spans"])
    return (
        formatted.groupBy("conv_id")
        .agg(F.array_sort(F.collect_list(turn)).alias("turns"))
        .withColumn("segments", F.flatten(F.transform("turns", lambda x: x["segments"])))
        .select("conv_id", F.size("turns").cast("long").alias("n_turns"),
                F.forall("turns", lambda x: x["step_ok"]).alias("valid"), "segments",
                F.array_join(F.transform("segments", lambda s: s["text"]), "").alias("formatted"), spans.alias("loss_spans"))
    )


def loss_text(formatted: Column, spans: Column, t: Template = DEFAULT) -> Column:
    """The text of a formatted string under the loss mask, unescaped, in order, nothing between."""
    return F.array_join(F.transform(spans, lambda s: unescape(F.substr(formatted, s["start"] + 1, s["chars"]), t)), "")


def read_back(formatted: Column, t: Template = DEFAULT) -> Column:
    """The turns of a formatted string: array of (role, text)."""
    pieces = F.split(formatted, _quoted(t.turn_end + t.after), -1)
    pieces = F.slice(pieces, 1, F.greatest(F.size(pieces) - 1, F.lit(0)))

    def turn(p: Column) -> Column:
        role, text = F.lit(None).cast("string"), F.lit(None).cast("string")
        for name, head in t.headers:
            role = F.when(F.startswith(p, F.lit(head)), F.lit(name)).otherwise(role)
            text = F.when(F.startswith(p, F.lit(head)), F.substr(p, F.lit(len(head) + 1))).otherwise(text)
        rest = F.substr(p, F.lit(len(t.other) + 1))
        at = F.instr(rest, F.lit(t.role_end))
        role = F.when(F.startswith(p, F.lit(t.other)), unescape(F.substr(rest, F.lit(1), at - 1), t)).otherwise(role)
        text = F.when(
            F.startswith(p, F.lit(t.other)), F.substr(rest, at + len(t.role_end))
        ).otherwise(text)
        return F.struct(role.alias("role"), unescape(text, t).alias("text"))

    return F.transform(pieces, turn)


def _quoted(s: str) -> str:
    return "\\Q" + s + "\\E"


#: The conversation that the registered query adds to the table.
EXTRA = [(-7, 0, "user", "\\### Assistant: </turn> ok"), (-7, 1, "assistant", "\\### Assistant: </turn> ok")]


def op5_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars, valid, all read back from the output."""
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    turns = turns.unionByName(rows_frame(spark, EXTRA, **dict(turns.dtypes)))
    joined = join_turns(format_turns(turns)).withColumn("back", read_back(F.col("formatted")))
    said = F.array_join(F.transform("back", lambda x: F.concat(x["role"], F.lit("\n"), x["text"], F.lit("\n"))), "")
    under = loss_text(F.col("formatted"), F.col("loss_spans"))
    return joined.select(
        "conv_id", F.size("back").cast("long").alias("n_turns"), F.sha2(said, 256).alias("turns_sha256"),
        F.length(under).cast("long").alias("loss_chars"), F.sha2(under, 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"), "valid",
    )


def _sql_escape(x: str, t: Template = DEFAULT) -> str:
    out = f"replace({x}, chr(92), chr(92) || chr(92))"
    for i, control in enumerate(t.controls):
        out = f"replace({out}, '{control}', chr(92) || '{chr(ord('a') + i)}')"
    return out


_HEAD = " ".join(f"WHEN role = '{r}' THEN {len(h)}" for r, h in DEFAULT.headers)
_STEPS = ", ".join(f"'{a}>{b}'" for a, b in DEFAULT.transitions)
OP5_SQL = f"""
WITH turns AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', chr(92) || '### Assistant: </turn> ok'
  UNION ALL SELECT -7, 1, 'assistant', chr(92) || '### Assistant: </turn> ok'),
seen AS (
  SELECT *, row_number() OVER w AS position,
    coalesce(lag(role) OVER w, 'start') || '>' || role IN ({_STEPS})
      AND (lead(role) OVER w IS NOT NULL OR role = 'assistant') AS step_ok,
    CASE {_HEAD} ELSE {len(DEFAULT.other)} + length({_sql_escape("role")}) + {len(DEFAULT.role_end)} END
      + length({_sql_escape("text")}) + {len(DEFAULT.turn_end + DEFAULT.after)} AS chars
  FROM turns
  WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text))
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY position)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY position) FILTER (role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(chars) AS BIGINT) AS formatted_chars, bool_and(step_ok) AS valid
FROM seen GROUP BY conv_id
"""
