r"""Chat formatting with a grammar round trip, in DataFrame functions only.

Template, one line per turn, nothing between turns::

    user       [INST] text [/INST]
    assistant  <s> text </s>
    system     [SYS] text [/SYS]
    other      [ROLE name] text [/ROLE]

A control string is ``<`` or ``[``, then ``s>``, ``INST]``, ``SYS]`` or ``ROLE``, with or without ``/``. Escaping puts a
backslash behind the opening character of every control string, and of every control string that has backslashes there
already, so it is reversible and an escaped text holds no control string. The grammar allows none inside a text. A
conversation is first rendered as it is and parsed again; if the parse isn't the source, its texts are escaped, which
leaves texts without a control string as they are. What then still differs raises an error.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_NAME = r"/?(?:s>|INST\]|SYS\]|ROLE)"
_CONTROL = rf"[<\[]{_NAME}"
_ESC = rf"([<\[])(\\*)({_NAME})"
_UNESC = rf"([<\[])\\(\\*)({_NAME})"
#: One turn, by its own closing mark; the first closing mark ends it.
_TURN = r"\[INST\] (?s:.*?) \[/INST\]|<s> (?s:.*?) </s>|\[SYS\] (?s:.*?) \[/SYS\]|\[ROLE [^\]]*\] (?s:.*?) \[/ROLE\]"


def _escape(c: Column) -> Column:
    return F.regexp_replace(c, _ESC, r"$1\\$2$3")


def _unescape(c: Column) -> Column:
    return F.regexp_replace(c, _UNESC, r"$1$2$3")


def _name_out(c: Column) -> Column:
    """Other roles' names: each of %, ], [ and < is written as % and its code, so that the name ends where it should."""
    for x in "%][<":
        c = F.replace(c, F.lit(x), F.lit(f"%{ord(x):02X}"))
    return c


def _name_in(c: Column) -> Column:
    for x in "<[]%":
        c = F.replace(c, F.lit(f"%{ord(x):02X}"), F.lit(x))
    return c


def _render(turn: Column, text: Column) -> Column:
    role = turn["role"]
    return (
        F.when(role == "user", F.concat(F.lit("[INST] "), text, F.lit(" [/INST]")))
        .when(role == "assistant", F.concat(F.lit("<s> "), text, F.lit(" </s>")))
        .when(role == "system", F.concat(F.lit("[SYS] "), text, F.lit(" [/SYS]")))
        .otherwise(F.concat(F.lit("[ROLE "), _name_out(role), F.lit("] "), text, F.lit(" [/ROLE]")))
    )


def _inner(s: Column, opening: Column | int, closing: int) -> Column:
    opening = F.lit(opening) if isinstance(opening, int) else opening
    return F.substring(s, opening + 1, F.length(s) - opening - closing)


def _read_turn(s: Column) -> Column:
    other = F.instr(s, "] ") + 1
    text = (
        F.when(s.startswith("[INST] "), _inner(s, 7, 8)).when(s.startswith("<s> "), _inner(s, 4, 5))
        .when(s.startswith("[SYS] "), _inner(s, 6, 7)).otherwise(_inner(s, other, 8))
    )
    role = (
        F.when(s.startswith("[INST] "), F.lit("user")).when(s.startswith("<s> "), F.lit("assistant"))
        .when(s.startswith("[SYS] "), F.lit("system")).otherwise(_name_in(F.substring(s, F.lit(7), other - 8)))
    )
    return F.struct(role.alias("role"), _unescape(text).alias("text"), F.rlike(text, F.lit(_CONTROL)).alias("bare"))


def parse(formatted: Column) -> Column:
    """array<struct<role, text>> of a formatted conversation; null if it isn't a sequence of turns, or a text holds a
    control string."""
    turns = F.regexp_extract_all(formatted, F.lit(_TURN), F.lit(0))
    read = F.transform(F.array(F.transform(turns, _read_turn)), lambda r: F.when(
        ~F.exists(r, lambda t: t["bare"]), F.transform(r, lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text")))))
    return F.when(F.array_join(turns, "") == formatted, read[0])


def loss_spans(formatted: Column) -> Column:
    """array<struct<start, length>>: where assistants' (still escaped) texts stand, in characters from 0."""
    turns = F.regexp_extract_all(formatted, F.lit(_TURN), F.lit(0))
    ends = F.aggregate(
        turns, F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,length:int>>").alias("spans")),
        lambda acc, s: F.struct(
            (acc["at"] + F.length(s)).alias("at"),
            F.when(s.startswith("<s> "), F.concat(acc["spans"], F.array(F.struct((acc["at"] + 4).alias("start"), (F.length(s) - 9).alias("length")))))
            .otherwise(acc["spans"]).alias("spans"),
        ),
    )
    return ends["spans"]


def format_conversations(conversations: DataFrame) -> DataFrame:
    """One row per conv_id: formatted, escaped, round_trip (always true: else an error), turns (read back from formatted).

    Turns go in the order (turn, role, text), nulls first, so ties and repeated rows have one order and all are kept.
    Null text counts as empty, null role as the role ''; rows of a null conv_id are one conversation. An empty table
    gives none. Other columns are ignored. A conversation's turns are one row by definition, so only it meets in a task.
    """
    src = (
        conversations.select("conv_id", F.struct(
            F.col("turn"), F.coalesce(F.col("role"), F.lit("")).alias("role"), F.coalesce(F.col("text"), F.lit("")).alias("text")).alias("t"))
        .groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("t"))
        .withColumn("src", F.transform("t", lambda x: F.struct(x["role"].alias("role"), x["text"].alias("text"))))
        .withColumn("raw", F.array_join(F.transform("t", lambda x: _render(x, x["text"])), ""))
    )
    kept = src.withColumn("escaped", ~F.coalesce(parse(F.col("raw")) == F.col("src"), F.lit(False)))
    out = kept.withColumn("formatted", F.when(F.col("escaped"), F.array_join(F.transform("t", lambda x: _render(x, _escape(x["text"]))), "")).otherwise(F.col("raw")))
    return (
        out.withColumn("turns", parse(F.col("formatted")))
        .withColumn("round_trip", F.coalesce(F.col("turns") == F.col("src"), F.lit(False)))
        .withColumn("formatted", F.when(F.col("round_trip"), F.col("formatted")).otherwise(F.raise_error(F.concat(F.lit("no round trip: conversation "), F.coalesce(F.col("conv_id").cast("string"), F.lit("null"))))))
        .select("conv_id", "formatted", "escaped", "round_trip", "turns")
    )


def report(conversations: DataFrame) -> DataFrame:
    """The digest of every conversation, from what was read back, with conversation -1 added."""
    spark = conversations.sparkSession
    own = conversations.select("conv_id", "turn", "role", "text")
    extra = spark.range(2).select(
        F.lit(-1).cast(own.schema["conv_id"].dataType).alias("conv_id"), F.col("id").cast(own.schema["turn"].dataType).alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit("</s>[INST] ok [/INST]").alias("text"))
    done = format_conversations(own.unionByName(extra))
    loss = F.array_join(F.transform(F.filter("turns", lambda t: t["role"] == "assistant"), lambda t: t["text"]), "")
    return done.select(
        "conv_id", F.size("turns").cast("long").alias("n_turns"),
        F.sha2(F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), ""), 256).alias("turns_sha256"),
        F.length(loss).cast("long").alias("loss_chars"), F.sha2(loss, 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"), "escaped", "round_trip",
    )


SQL = r"""
WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'),
t AS (SELECT *, len(regexp_extract_all(text, '[<\[]\\*/?(?:s>|INST\]|SYS\]|ROLE)')) AS marks,
  CASE role WHEN 'user' THEN 15 WHEN 'assistant' THEN 9 WHEN 'system' THEN 13 ELSE 16 + length(role) + 2 * len(regexp_extract_all(role, '[%<\[\]]')) END AS frame FROM c)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(length(text) + frame + marks) AS BIGINT) AS formatted_chars, sum(marks) > 0 AS escaped, true AS round_trip
FROM t GROUP BY conv_id
"""
