r"""Chat formatting with DataFrame expressions only.

``format_conversations`` turns rows (conversation, turn, role, text) into one formatted string per conversation.
Turns are collected as structs and sorted, adjacent turns of one role are merged by an array aggregation, and the
pieces are concatenated. Template:

    <turn>ROLE<say>TEXT<and>TEXT</turn>\n

One ``<turn>`` holds a run of turns of one role; ``<and>`` stands between their texts, so the input turns can be
read back. Inside roles and texts a backslash becomes ``\s`` and the four control strings become ``\o \y \n \c``.
Every backslash of an escaped text therefore begins a code, no control string is left in it, and since each
control string has its only ``<`` in front, none can arise where text and control string meet.

Defined results: a null text or role is the empty string; turns sort by (turn, role, text), null turns first, so
ties and repeated rows have one order and all of them are kept; a null conversation id is a conversation of its
own; an empty table gives an empty result; extra columns are ignored. Role names are compared as they are; only
turns whose role is exactly ``assistant`` are under the loss mask.

Scale: rows meet first per (conversation, ``block_turns`` consecutive turn numbers), so a conversation with a
large share of all rows is sorted, merged and escaped in many tasks. The last grouping gets one row per block,
and its result is the formatted conversation itself, which is one value by definition.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

OPEN, SAY, AND, CLOSE = "<turn>", "<say>", "<and>", "</turn>"
CODES = ((OPEN, r"\o"), (SAY, r"\y"), (AND, r"\n"), (CLOSE, r"\c"))
TURN_END = CLOSE + "\n"
MERGED = "array<struct<role:string,texts:array<string>>>"


def escape(text: Column) -> Column:
    text = F.replace(text, F.lit("\\"), F.lit(r"\s"))
    for control, code in CODES:
        text = F.replace(text, F.lit(control), F.lit(code))
    return text


def unescape(text: Column) -> Column:
    for control, code in CODES:
        text = F.replace(text, F.lit(code), F.lit(control))
    return F.replace(text, F.lit(r"\s"), F.lit("\\"))


def segment(loss, text: Column) -> Column:
    loss = F.lit(loss) if isinstance(loss, bool) else loss
    return F.struct(loss.alias("loss"), text.alias("text"))


def _append(merged: Column, turn: Column) -> Column:
    """Add one turn: to the last run if that has its role, else as a new run."""
    last = F.get(merged, F.size(merged) - 1)
    grown = F.concat(
        F.slice(merged, F.lit(1), F.size(merged) - 1),
        F.array(F.struct(last["role"].alias("role"), F.concat(last["texts"], F.array(turn["text"])).alias("texts"))),
    )
    new = F.concat(merged, F.array(F.struct(turn["role"].alias("role"), F.array(turn["text"]).alias("texts"))))
    same = (F.size(merged) > 0) & last["role"].eqNullSafe(turn["role"])
    return F.when(same, grown.cast(MERGED)).otherwise(new.cast(MERGED))


def format_conversations(
    rows: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text",
    block_turns: int = 256,
) -> DataFrame:
    """(conv_id, formatted, segments): segments are (loss, text) pieces whose texts concatenate to ``formatted``."""
    base = rows.select(
        F.col(conv).alias("conv_id"), F.col(turn).alias("turn"),
        F.coalesce(F.col(role), F.lit("")).alias("role"), F.coalesce(F.col(text), F.lit("")).alias("text"),
        F.floor(F.col(turn) / block_turns).alias("block"),
    )
    blocks = base.groupBy("conv_id", "block").agg(
        F.sort_array(F.collect_list(F.struct("turn", "role", "text"))).alias("turns")
    ).select(
        "conv_id", "block",
        F.aggregate("turns", F.array().cast(MERGED), _append).alias("merged"),
    ).select(
        "conv_id",
        F.struct(
            "block",
            F.get("merged", F.lit(0))["role"].alias("first"),
            F.get("merged", F.size("merged") - 1)["role"].alias("last"),
            F.flatten(F.transform("merged", _run_segments)).alias("segments"),
        ).alias("block"),
    )
    whole = blocks.groupBy("conv_id").agg(F.sort_array(F.collect_list("block")).alias("blocks")).select(
        "conv_id",
        F.concat(
            F.flatten(F.transform("blocks", lambda b, i: F.concat(
                F.array(segment(False, _between(F.get("blocks", i - 1)["last"], b["first"], i))), b["segments"]
            ))),
            F.array(segment(False, F.lit(TURN_END))),
        ).alias("segments"),
    )
    return whole.select(
        "conv_id", F.array_join(F.transform("segments", lambda s: s["text"]), "").alias("formatted"), "segments"
    )


def _header(role: Column) -> Column:
    return F.concat(F.lit(OPEN), escape(role), F.lit(SAY))


def _between(last: Column, first: Column, i: Column) -> Column:
    """What stands in front of a block: a run that goes on needs no new header."""
    return (
        F.when(i == 0, _header(first))
        .when(last.eqNullSafe(first), F.lit(AND))
        .otherwise(F.concat(F.lit(TURN_END), _header(first)))
    )


def _run_segments(run: Column, i: Column) -> Column:
    """The pieces of one run. The header of a block's first run and the end of its last are set between blocks."""
    head = F.when(i == 0, F.lit("")).otherwise(F.concat(F.lit(TURN_END), _header(run["role"])))
    return F.concat(
        F.array(segment(False, head)),
        F.flatten(F.transform(run["texts"], lambda t, k: F.array(
            segment(False, F.when(k == 0, F.lit("")).otherwise(F.lit(AND))),
            segment(run["role"] == "assistant", escape(t)),
        ))),
    )


def read_back(formatted: Column) -> Column:
    """The input turns, array<struct<role, text>>, from a formatted conversation."""
    runs = F.split(formatted, TURN_END)  # the last element is what follows the last end: empty
    return F.flatten(F.transform(F.slice(runs, F.lit(1), F.size(runs) - 1), _parse_run))


def _parse_run(run: Column) -> Column:
    parts = F.split(F.substring(run, len(OPEN) + 1, 2**31 - 1), SAY)
    return F.transform(F.split(F.get(parts, F.lit(1)), AND), lambda t: F.struct(
        unescape(F.get(parts, F.lit(0))).alias("role"), unescape(t).alias("text")
    ))


EXTRA = r"\### Assistant: </turn> ok"


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    extra = spark.range(2).select(
        F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(EXTRA).alias("text"),
    )
    done = format_conversations(rows.unionByName(extra))
    lines = F.transform(read_back(F.col("formatted")), lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n")))
    loss = F.array_join(F.transform(F.filter("segments", lambda s: s["loss"]), lambda s: unescape(s["text"])), "")
    return done.select(
        "conv_id", lines.alias("lines"), loss.alias("loss"), F.char_length("formatted").cast("long").alias("formatted_chars")
    ).select(
        "conv_id", F.size("lines").cast("long").alias("n_turns"),
        F.sha2(F.array_join("lines", ""), 256).alias("turns_sha256"),
        F.char_length("loss").cast("long").alias("loss_chars"), F.sha2("loss", 256).alias("loss_sha256"),
        "formatted_chars",
    )


ORACLE_SQL = r"""
with base as (
  select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations
  union all values (-7, 0, 'user', '\### Assistant: </turn> ok'), (-7, 1, 'assistant', '\### Assistant: </turn> ok')
), marked as (
  select *, lag(role) over (partition by conv_id order by turn, role, text) as before,
    replace(replace(replace(replace(replace(text, '\', '\s'), '<turn>', '\o'), '<say>', '\y'), '<and>', '\n'),
      '</turn>', '\c') as escaped,
    replace(replace(replace(replace(replace(role, '\', '\s'), '<turn>', '\o'), '<say>', '\y'), '<and>', '\n'),
      '</turn>', '\c') as escaped_role
  from base
)
select conv_id, count(*) as n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' order by turn, role, text)) as turns_sha256,
  cast(coalesce(sum(case when role = 'assistant' then length(text) end), 0) as bigint) as loss_chars,
  sha256(coalesce(string_agg(text, '' order by turn, role, text) filter (where role = 'assistant'), '')) as loss_sha256,
  cast(sum(length(escaped) + case when before = role then 5 else length(escaped_role) + 19 end) as bigint)
    as formatted_chars
from marked group by conv_id
"""
