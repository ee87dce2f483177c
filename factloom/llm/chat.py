"""Multi-party perspective rotation of dialogues.

For every participant of a conversation, the dialogue is rendered with that speaker as the assistant, all others as users
who carry their names, and narrators (`system`) as system. The loss mask holds the spans, in code points of the
rendered text, of what the speaker says, end marks included.

A message is `<|im_start|>ROLE[ name=NAME]\\nCONTENT<|im_end|>\\n`. In contents and names a backslash is doubled and `<|` is written
`<\\|`; in names, line ends are written `\\n` and `\\r` too. So neither can forge a mark, and what was written can be read back. The
rendered dialogue comes in segments of `turns` turn numbers each, in order; concatenated by segment and `overflow` they are the whole
dialogue. A segment with a turn of more than `crowd` different messages is cut at its turns, and that turn after every `crowd` messages
in their order; its pieces are numbered by `overflow` (0 elsewhere). So no row holds a conversation, or a turn, of unbounded length, and
segments meet the participants by blocks of segments, so that no task does either.

Defined results: participants are the distinct speakers that aren't narrators. A conversation without any has no rows. A null role speaks as
`unknown`; a null text is empty; a null turn comes last; a null conv_id is one conversation. Rows that are repeated whole
count once; several messages of one turn are ordered by speaker, then text. Very long texts are rendered whole. An empty table gives no
rows. Other columns of the input are ignored, whatever their names.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from factloom.llm.common import cut, running_totals
from factloom.operators.numbering import number_rows

UNKNOWN = "unknown"
START, END = "<|im_start|>", "<|im_end|>"
_LAST = (1 << 63) - 1


@dataclass(frozen=True)
class Rotation:
    narrators: tuple = ("system",)
    turns: int = 128
    crowd: int = 10_000


def _same(a: DataFrame, b: DataFrame, *names: str) -> Column:
    on = F.lit(True)
    for n in names:
        on = on & a[n].eqNullSafe(b[f"__{n}"])
    return on


def _escaped(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), F.lit("<|"), F.lit("<\\|"))


def _message(m: Column, speaker: Column, narrators: tuple) -> Column:
    role = (
        F.when(m["role"] == speaker, F.lit("assistant"))
        .when(m["role"].isin(*narrators), F.lit("system"))
        .otherwise(F.concat(F.lit("user name="), F.replace(F.replace(_escaped(m["role"]), F.lit("\n"), F.lit("\\n")), F.lit("\r"), F.lit("\\r"))))
    )
    head = F.concat(F.lit(START), role, F.lit("\n"))
    body = F.concat(_escaped(m["text"]), F.lit(END))
    return F.struct(
        F.concat(head, body, F.lit("\n")).alias("shown"),
        F.length(head).cast("bigint").alias("head"),
        F.length(body).cast("bigint").alias("body"),
        (m["role"] == speaker).alias("own"),
    )


#: Segments (and pieces of one) that meet the participants together.
_BLOCK = 64


def _in_pieces(messages: DataFrame, crowded: DataFrame, conf: Rotation) -> DataFrame:
    """`messages` with overflow, where the turns of `crowded` (conv_id, turn) are cut in their order."""
    def joined(a: DataFrame, b: DataFrame, *names: str, how: str = "inner") -> DataFrame:
        right = b.select(*[F.col(c).alias(f"__{c}" if c in names else c) for c in b.columns])
        return a.join(right, _same(a, right, *names), how).drop(*[f"__{n}" for n in names])

    hot = number_rows(joined(messages, crowded, "conv_id", "turn", how="left_semi"), ["conv_id", "turn", "role", "text"])
    firsts = hot.groupBy("conv_id", "turn").agg(F.min("rn").alias("first"))
    piece = F.floor((F.col("rn") - F.col("first")) / conf.crowd).cast("bigint")
    hot = joined(hot, firsts, "conv_id", "turn").withColumn("piece", piece).drop("rn", "first")
    cut_up = hot.select("conv_id", "segment").distinct()
    rest = joined(messages, crowded, "conv_id", "turn", how="left_anti")
    beside = joined(rest, cut_up, "conv_id", "segment", how="left_semi").withColumn("piece", F.lit(0).cast("bigint"))
    pieces = cut(hot.unionByName(beside))
    # One row a piece: a turn, or `crowd` messages of one.
    nth = F.row_number().over(Window.partitionBy("conv_id", "segment").orderBy("turn", "piece")) - 1
    places = pieces.select("conv_id", "segment", "turn", "piece").distinct().withColumn("overflow", nth.cast("int"))
    told = joined(pieces, places, "conv_id", "segment", "turn", "piece").drop("piece")
    return told.unionByName(joined(rest, cut_up, "conv_id", "segment", how="left_anti").withColumn("overflow", F.lit(0)))


def rotate(conversations: DataFrame, conf: Rotation | None = None) -> DataFrame:
    """conv_id, speaker, segment, overflow, n_messages, n_own, rendered, mask (array<struct<start, stop>>)."""
    conf = conf or Rotation()
    turn = F.coalesce(F.col("turn").cast("bigint"), F.lit(_LAST))
    messages = conversations.select(
        "conv_id",
        turn.alias("turn"),
        F.coalesce(F.col("role").cast("string"), F.lit(UNKNOWN)).alias("role"),
        F.coalesce(F.col("text"), F.lit("")).alias("text"),
        F.when(turn == _LAST, _LAST).otherwise(F.floor(turn / conf.turns)).cast("bigint").alias("segment"),
    ).distinct()
    speakers = messages.select("conv_id", "role").distinct().where(~F.col("role").isin(*conf.narrators))
    speakers = speakers.select(F.col("conv_id").alias("__conv_id"), F.col("role").alias("speaker"))
    crowded = cut(messages.groupBy("conv_id", "turn").agg(F.count("*").alias("n")).where(F.col("n") > conf.crowd).drop("n"))
    dealt = messages.withColumn("overflow", F.lit(0)) if crowded.isEmpty() else _in_pieces(messages, crowded, conf)
    segments = dealt.groupBy("conv_id", "segment", "overflow").agg(F.array_sort(F.collect_list(F.struct("turn", "role", "text"))).alias("messages"))
    block = F.struct(F.floor(F.col("segment") / _BLOCK).alias("s"), F.floor(F.col("overflow") / _BLOCK).alias("o")).alias("block")
    blocks = dealt.select("conv_id", block).distinct()
    pairs = blocks.join(speakers, _same(blocks, speakers, "conv_id")).select("__conv_id", F.col("block").alias("__block"), "speaker")
    segments = segments.withColumn("block", block)
    each = segments.join(pairs, _same(segments, pairs, "conv_id", "block"))
    shown = each.select("conv_id", "speaker", "segment", "overflow", F.transform("messages", lambda m: _message(m, F.col("speaker"), conf.narrators)).alias("shown"))
    starts = running_totals(F.transform("shown", lambda s: s["head"] + s["body"] + 1))
    spans = F.zip_with(F.col("shown"), starts, lambda s, at: F.when(s["own"], F.struct((at + s["head"]).alias("start"), (at + s["head"] + s["body"]).alias("stop"))))
    return shown.select(
        "conv_id",
        "speaker",
        "segment",
        "overflow",
        F.size("shown").cast("bigint").alias("n_messages"),
        F.size(F.filter("shown", lambda s: s["own"])).cast("bigint").alias("n_own"),
        F.array_join(F.transform("shown", lambda s: s["shown"]), "").alias("rendered"),
        F.filter(spans, lambda s: s.isNotNull()).alias("mask"),
    )


def rotated(conversations: DataFrame) -> DataFrame:
    """The result of `rotate` with the mask as text: start:stop, comma-joined."""
    mask = F.array_join(F.transform("mask", lambda s: F.concat_ws(":", s["start"], s["stop"])), ",")
    return rotate(conversations).withColumn("mask", mask)


def oracle(conf: Rotation | None = None) -> str:
    conf = conf or Rotation()
    narrators = ", ".join(f"'{n}'" for n in conf.narrators)
    escaped = lambda c: f"replace(replace({c}, '\\', '\\\\'), '<|', '<\\|')"
    return f"""
        WITH m AS (
            SELECT *, CASE WHEN turn = {_LAST} THEN turn ELSE floor(turn / {conf.turns})::BIGINT END AS segment
            FROM (SELECT DISTINCT conv_id, coalesce(turn, {_LAST}) AS turn, coalesce(role, '{UNKNOWN}') AS role, coalesce(text, '') AS text FROM conversations)
        ), c AS (
            SELECT *, count(*) OVER (PARTITION BY conv_id, turn) > {conf.crowd} AS crowded, (row_number() OVER (PARTITION BY conv_id, turn ORDER BY role, text) - 1) // {conf.crowd} AS piece FROM m
        ), o AS (
            SELECT *, CASE WHEN bool_or(crowded) OVER (PARTITION BY conv_id, segment) THEN dense_rank() OVER (PARTITION BY conv_id, segment ORDER BY turn, CASE WHEN crowded THEN piece ELSE 0 END) - 1 ELSE 0 END::INTEGER AS overflow FROM c
        ), s AS (SELECT DISTINCT conv_id AS c, role AS speaker FROM m WHERE role NOT IN ({narrators})
        ), r AS (
            SELECT o.*, speaker,
                   '{START}' || CASE WHEN role = speaker THEN 'assistant' WHEN role IN ({narrators}) THEN 'system'
                       ELSE 'user name=' || replace(replace({escaped("role")}, chr(10), '\\n'), chr(13), '\\r') END || chr(10) AS head,
                   {escaped("text")} || '{END}' AS body
            FROM o JOIN s ON o.conv_id IS NOT DISTINCT FROM s.c
        ), p AS (
            SELECT *, coalesce(sum(length(head) + length(body) + 1) OVER (
                PARTITION BY conv_id, speaker, segment, overflow ORDER BY turn, role, text
                ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS pos
            FROM r
        )
        SELECT conv_id, speaker, segment, overflow, count(*)::BIGINT AS n_messages,
               count(*) FILTER (WHERE role = speaker)::BIGINT AS n_own,
               string_agg(head || body || chr(10), '' ORDER BY turn, role, text) AS rendered,
               coalesce(string_agg((pos + length(head)) || ':' || (pos + length(head) + length(body)), ',' ORDER BY turn, role, text)
                   FILTER (WHERE role = speaker), '') AS mask
        FROM p GROUP BY conv_id, speaker, segment, overflow"""
