"""Chat formatting with a checked grammar round trip, in DataFrame functions only.

    conversation := "<s>" turn*
    turn         := "[INST]" role "[/INST]" text "</s>"

A turn is rendered as it is and parsed again; where the parse does not give back role and text, the control
strings inside them are escaped and the turn is rendered and parsed once more, level by level until both are
identical. Escaping puts one more backslash behind the first character of a control string that has any number
of them there already, so it is undone by taking one away and its image contains no control string: the first
level that escapes is a fixed point, and ``ESCAPE_LEVELS`` has one more to show it. The parser always unescapes.
Whole conversations are parsed again in the end (``round_trip``).

The loss mask is the byte ranges of the assistant texts in the UTF-8 output; byte ranges can be cut out
without a walk from the start of a long conversation.

Defined cases: null text or role is empty; a null turn comes first and equal turns are ordered by role and
text; repeated rows are repeated turns; rows of a null conv_id are one conversation; an empty table gives an
empty result; extra columns are ignored. A conversation is one output row, so it must fit in one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.window import Window

#: Control strings of the template.
BOS, OPEN, CLOSE, END = "<s>", "[INST]", "[/INST]", "</s>"
CONTROL = r"([<\[])(\\*)(/?s>|/?INST\])"
ESCAPED = r"([<\[])\\(\\*)(/?s>|/?INST\])"
ESCAPE_LEVELS = 3
LOSS_ROLES = ["assistant"]
TURN = "array<struct<role:string,text:string>>"


def escape(text: Column) -> Column:
    return F.regexp_replace(text, CONTROL, r"$1\\$2$3")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, ESCAPED, "$1$2$3")


def render(role: Column, text: Column) -> Column:
    return F.concat(F.lit(OPEN), role, F.lit(CLOSE), text, F.lit(END))


def parse(rendered: Column) -> Column:
    """Array of (role, text) of a run of turns; a piece that is no turn has a null role."""
    pieces = F.split(rendered, r"\Q</s>\E", -1)

    def turn(piece: Column) -> Column:
        at = F.instr(piece, CLOSE)
        ok = piece.startswith(OPEN) & (at > 0)
        role = F.substring(piece, F.lit(len(OPEN) + 1), at - len(OPEN) - 1)
        text = F.substring(piece, at + len(CLOSE), F.length(piece))
        return F.struct(F.when(ok, unescape(role)).alias("role"), F.when(ok, unescape(text)).otherwise(piece).alias("text"))

    # the last piece follows the last turn: it must be empty and is dropped, else it counts as a broken turn
    whole = F.filter(pieces, lambda p, i: (i < F.size(pieces) - 1) | (p != ""))
    return F.transform(whole, turn)


def format_conversations(turns: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """Per conversation: conv_id, n_turns, formatted, loss_spans (start and length in bytes of ``formatted``), turns (as parsed from ``formatted``), escaped_turns and round_trip."""
    rows = turns.select(F.col(conv_id).alias("conv_id"), F.col(turn).alias("turn"), F.coalesce(F.col(role), F.lit("")).alias("role"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    source = F.array(F.struct("role", "text"))
    r, t, level, done = F.col("role"), F.col("text"), F.lit(0), None
    rows = rows.withColumn("o_role", r).withColumn("o_text", t).withColumn("level", level)
    for _ in range(ESCAPE_LEVELS - 1):
        done = parse(render(F.col("o_role"), F.col("o_text"))).eqNullSafe(source)
        rows = rows.withColumn("done", done)
        rows = rows.withColumn("o_role", F.when(F.col("done"), F.col("o_role")).otherwise(escape(r))).withColumn("o_text", F.when(F.col("done"), F.col("o_text")).otherwise(escape(t))).withColumn("level", F.col("level") + (~F.col("done")).cast("int"))
    rows = rows.withColumn("out", render(F.col("o_role"), F.col("o_text")))
    order = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    before = F.coalesce(F.sum(F.octet_length("out")).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    head = F.lit(len(OPEN) + len(CLOSE) + len(BOS))
    rows = rows.withColumn("place", F.row_number().over(order)).withColumn("start", (before + head + F.octet_length("o_role")).cast("long"))
    item = F.struct("place", "out", "start", F.octet_length("o_text").cast("long").alias("length"), F.col("role").isin(LOSS_ROLES).alias("loss"), "role", "text", "level")
    whole = rows.groupBy("conv_id").agg(F.sort_array(F.collect_list(item)).alias("items"))
    whole = whole.select(
        "conv_id",
        F.concat(F.lit(BOS), F.array_join(F.transform("items", lambda x: x.out), "")).alias("formatted"),
        F.transform(F.filter("items", lambda x: x.loss), lambda x: F.struct(x.start.alias("start"), x.length.alias("length"))).alias("loss_spans"),
        F.size(F.filter("items", lambda x: x.level > 0)).cast("long").alias("escaped_turns"),
        F.transform("items", lambda x: F.struct(x.role.alias("role"), x.text.alias("text"))).alias("source"),
    )
    whole = whole.withColumn("turns", parse(F.substring("formatted", len(BOS) + 1, 1 << 30)))
    return whole.select("conv_id", F.size("turns").cast("long").alias("n_turns"), "formatted", "loss_spans", "turns", "escaped_turns", F.col("turns").eqNullSafe(F.col("source")).alias("round_trip"))


def digests(formatted: DataFrame) -> DataFrame:
    """conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars and round_trip, all read back from the output."""
    told = F.array_join(F.transform("turns", lambda x: F.concat(x.role, F.lit("\n"), x.text, F.lit("\n"))), "")
    raw = F.encode("formatted", "UTF-8")
    texts = F.transform("loss_spans", lambda s: unescape(F.decode(F.substring(raw, (s.start + 1).cast("int"), s.length.cast("int")), "UTF-8")))
    return formatted.withColumn("loss", F.array_join(texts, "")).select(
        "conv_id", "n_turns", F.sha2(told.cast("binary"), 256).alias("turns_sha256"), F.length("loss").cast("long").alias("loss_chars"),
        F.sha2(F.col("loss").cast("binary"), 256).alias("loss_sha256"), F.length("formatted").cast("long").alias("formatted_chars"), "round_trip",
    )


#: The conversation that the production query adds: its texts are control strings of the template.
PROBE = "</s>[INST] ok [/INST]"

ORACLE = r"""
WITH t AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
           UNION ALL VALUES (-1, 0, 'user', '</s>[INST] ok [/INST]'), (-1, 1, 'assistant', '</s>[INST] ok [/INST]')),
e AS (SELECT *, length(role) + length(text)
                + CASE WHEN regexp_matches(role || chr(10) || text, '[<\[]\\*(/?s>|/?INST\])') AND (contains(role, '</s>') OR contains(text, '</s>') OR contains(role, '[/INST]') OR regexp_matches(role || chr(10) || text, '[<\[]\\+(/?s>|/?INST\])'))
                       THEN len(regexp_extract_all(role, '[<\[]\\*(/?s>|/?INST\])')) + len(regexp_extract_all(text, '[<\[]\\*(/?s>|/?INST\])')) ELSE 0 END AS chars FROM t)
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
       CAST(sum(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END) AS BIGINT) AS loss_chars,
       sha256(coalesce(string_agg(CASE WHEN role = 'assistant' THEN text END, '' ORDER BY turn NULLS FIRST, role, text), '')) AS loss_sha256,
       CAST(3 + sum(17 + chars) AS BIGINT) AS formatted_chars, true AS round_trip
FROM e GROUP BY conv_id
"""
