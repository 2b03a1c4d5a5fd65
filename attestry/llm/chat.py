"""Chat formatting with Spark expressions alone.

A conversation becomes one string of blocks, one for each run of turns of the same role:
``### role: text</turn>text</turn>`` and a newline. Control strings inside roles and texts are
escaped, so that an unescaped marker is always the template's and reading back is exact:
a backslash becomes ``\\s``, ``##`` becomes ``\\h#``, ``</turn>`` becomes ``\\l/turn>`` and, in roles
only, ``:`` becomes ``\\c``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

OPEN, COLON, CLOSE, BREAK = "### ", ": ", "</turn>", "\n"


def escaped(text: Column) -> Column:
    text = F.replace(text, F.lit("\\"), F.lit("\\s"))
    text = F.replace(text, F.lit("##"), F.lit("\\h#"))
    return F.replace(text, F.lit(CLOSE), F.lit("\\l/turn>"))


def escaped_role(role: Column) -> Column:
    return F.replace(escaped(role), F.lit(":"), F.lit("\\c"))


def unescaped(text: Column) -> Column:
    for mark, plain in (("\\c", ":"), ("\\l", "<"), ("\\h", "#"), ("\\s", "\\")):
        text = F.replace(text, F.lit(mark), F.lit(plain))
    return text


def merged(turns: Column) -> Column:
    """Runs of turns of the same role: array of struct<role, texts>, in order."""
    block = lambda role, texts: F.struct(role.alias("role"), texts.alias("texts"))
    # where a run starts, and where the next one does: slices, so the cost stays linear
    n = F.size(turns)
    starts = F.filter(F.sequence(F.lit(0), n), lambda i: (i == 0) | (i == n) | (F.get(turns, i)["role"] != F.get(turns, i - 1)["role"]))
    return F.transform(
        F.arrays_zip(F.slice(starts, F.lit(1), F.size(starts) - 1).alias("lo"), F.slice(starts, F.lit(2), F.size(starts) - 1).alias("hi")),
        lambda r: block(F.get(turns, r["lo"])["role"], F.transform(F.slice(turns, r["lo"] + 1, r["hi"] - r["lo"]), lambda t: t["text"])),
    )


def formatted(blocks: Column) -> Column:
    return F.array_join(
        F.transform(blocks, lambda b: F.concat(F.lit(OPEN), escaped_role(b["role"]), F.lit(COLON), F.array_join(F.transform(b["texts"], lambda t: F.concat(escaped(t), F.lit(CLOSE))), ""), F.lit(BREAK))),
        "",
    )


def read_turns(text: Column) -> Column:
    """The turns that a formatted conversation holds: array of struct<role, text>."""
    blocks = F.filter(F.split(text, OPEN), lambda b: F.length(b) > 0)

    def turns(b: Column) -> Column:
        role = F.substring_index(b, COLON, 1)
        parts = F.split(F.substring(b, F.length(role) + len(COLON) + 1, F.length(b)), CLOSE)
        return F.transform(F.slice(parts, F.lit(1), F.size(parts) - 1), lambda t: F.struct(unescaped(role).alias("role"), unescaped(t).alias("text")))

    return F.flatten(F.transform(blocks, turns))


def format_chats(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """(conv_id, formatted, n_blocks) of every conversation.

    Turns are sorted by turn number, then role and text; a null number comes first. Repeated rows
    stay. Null roles and texts are empty strings. Rows without a conv_id form one conversation. Turns of any length
    are taken whole; an empty table gives an empty result. Other columns are ignored, so their names cannot clash."""
    rows = turns.select(
        F.col(conv_col).cast("long").alias("conv_id"),
        F.struct(F.col(turn_col).cast("long").alias("turn"), F.coalesce(F.col(role_col), F.lit("")).alias("role"), F.coalesce(F.col(text_col), F.lit("")).alias("text")).alias("t"),
    )
    chats = rows.groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("turns"))
    chats = chats.select("conv_id", merged(F.col("turns")).alias("blocks"))
    return chats.select("conv_id", formatted(F.col("blocks")).alias("formatted"), F.size("blocks").cast("long").alias("n_blocks"))


def read_chats(chats: DataFrame, loss_role: str = "assistant") -> DataFrame:
    """Digests of what the formatted strings hold, read back from them alone."""
    read = chats.select("conv_id", "formatted", "n_blocks", read_turns(F.col("formatted")).alias("turns"))
    told = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    loss = F.array_join(F.transform(F.filter("turns", lambda t: t["role"] == loss_role), lambda t: t["text"]), "")
    read = read.select("conv_id", F.size("turns").cast("long").alias("n_turns"), told.alias("told"), loss.alias("loss"), F.length("formatted").cast("long").alias("formatted_chars"), "n_blocks")
    return read.select(
        "conv_id",
        "n_turns",
        F.sha2("told", 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"),
        F.sha2("loss", 256).alias("loss_sha256"),
        "formatted_chars",
        "n_blocks",
    )


def oracle(extra: str = "\\### Assistant: </turn> ok") -> str:
    """The digests straight from the turns, in DuckDB."""
    esc = lambda c: f"replace(replace(replace({c}, '\\', '\\s'), '##', '\\h#'), '</turn>', '\\l/turn>')"
    return f"""
WITH t AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, k, r, '{extra}' FROM (VALUES (0, 'user'), (1, 'assistant')) v(k, r)),
n AS (SELECT *, row_number() OVER o AS i, coalesce(lag(role) OVER o <> role, true) AS opens FROM t WINDOW o AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text))
SELECT conv_id, count(*)::BIGINT AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY i)) AS turns_sha256,
  sum(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY i) FILTER (role = 'assistant'), '')) AS loss_sha256,
  sum(length({esc("text")}) + 7 + CASE WHEN opens THEN length(replace({esc("role")}, ':', '\\c')) + 7 ELSE 0 END)::BIGINT AS formatted_chars,
  count(*) FILTER (opens)::BIGINT AS n_blocks
FROM n GROUP BY conv_id"""
