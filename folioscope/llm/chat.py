"""Chat formatting by perspective rotation.

Every participant of a conversation is in turn the assistant: the dialogue is
rendered with that speaker's messages under ``assistant`` and everyone else's
under ``user`` with a name, and the stretches to learn from are those of the
speaker. A mask is a list of start:end offsets (code points, end exclusive) of
the speaker's words and their closing mark in the rendered text.

A conversation may be of any length, so the rendering is handed out in pieces of
``PIECE`` consecutive messages: the pieces in order, joined, are the whole
rendering, and all offsets count from its start. Messages are numbered, and
pieces placed, from sums over narrow rows, so a long conversation meets no
single task.

Markers and the line of a speaker cannot be forged: in texts and names ``<|``
becomes ``< |``, and in names a line break becomes a space.

Defined results: messages are ordered by turn (null last), then role, then
text; rows that repeat are messages of their own; a null role is the speaker
"unknown"; a null text is empty; a null conv_id is a conversation of its own; a
piece in which the speaker says nothing has an empty mask, as it is context for
the others; further columns are not looked at; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import text_or_empty, written

PIECE = 64
UNKNOWN = "unknown"
#: Turns in a slice, for numbering messages.
SLICE = 1024
OPEN, CLOSE = "<|im_start|>", "<|im_end|>"


def numbered(turns: DataFrame) -> DataFrame:
    """conv_id, ck, role, turn, text, number: the place of each message in its conversation, from 0."""
    rows = turns.select(
        "conv_id",
        F.coalesce(F.concat(F.lit("c"), F.col("conv_id").cast("string")), F.lit("n")).alias("ck"),
        "turn",
        F.coalesce(F.col("role").cast("string"), F.lit(UNKNOWN)).alias("role"),
        text_or_empty().alias("text"),
    ).withColumn("slice", F.coalesce(F.floor(F.col("turn") / SLICE), F.lit(2**62)))
    counts = rows.groupBy("ck", "slice").agg(F.count(F.lit(1)).alias("n"))
    earlier = Window.partitionBy("ck").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("ck", "slice", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("start"))
    inside = Window.partitionBy("ck", "slice").orderBy(F.col("turn").asc_nulls_last(), "role", "text")
    placed = rows.join(starts, ["ck", "slice"]).withColumn("number", F.col("start") + F.row_number().over(inside) - 1)
    return placed.select("conv_id", "ck", "role", "turn", "text", "number")


def plain(text: Column) -> Column:
    """Text in which no marker can begin."""
    return F.replace(text, F.lit("<|"), F.lit("< |"))


def _heads(role: Column) -> tuple[Column, Column]:
    """How a message opens as the assistant's, and as the named user's."""
    name = F.translate(plain(role), "\r\n", "  ")
    return F.lit(f"{OPEN}assistant\n"), F.concat(F.lit(f"{OPEN}user name="), name, F.lit("\n"))


def rotated(turns: DataFrame, piece: int = PIECE) -> DataFrame:
    """One row per conversation, speaker and piece: conv_id, speaker, piece, start (of the piece in the whole), n_messages, n_own, text, mask."""
    own, named = _heads(F.col("role"))
    placed = numbered(turns).select(
        "conv_id", "ck", "role", "number", F.floor(F.col("number") / piece).alias("piece"), F.concat(plain(F.col("text")), F.lit(CLOSE)).alias("body"), named.alias("named")
    )
    placed = written(placed, "messages")
    body = F.length("body") + 1  # and a line break
    per_role = placed.groupBy("ck", "piece", "role").agg(
        F.sum(body + F.length("named")).alias("as_user"), F.sum(F.length(own) - F.length("named")).alias("change"), F.count(F.lit(1)).alias("n_own")
    )
    pieces = per_role.groupBy("ck", "piece").agg(F.sum("as_user").alias("as_user"))
    speakers = per_role.select("ck", F.col("role").alias("speaker")).distinct()
    mine = per_role.select("ck", "piece", F.col("role").alias("speaker"), "change", "n_own")
    sizes = pieces.join(speakers, "ck").join(mine, ["ck", "piece", "speaker"], "left")
    before = Window.partitionBy("ck", "speaker").orderBy("piece").rowsBetween(Window.unboundedPreceding, -1)
    size = F.col("as_user") + F.coalesce("change", F.lit(0))
    views = sizes.select("ck", "piece", "speaker", F.coalesce("n_own", F.lit(0)).alias("n_own"), F.coalesce(F.sum(size).over(before), F.lit(0)).alias("start"))
    message = F.struct("number", "role", "named", "body")
    held = placed.groupBy("ck", "piece").agg(F.first("conv_id").alias("conv_id"), F.sort_array(F.collect_list(message)).alias("messages"))
    speaker = F.col("speaker")
    parts = F.transform("messages", lambda m: F.struct(F.when(m.role == speaker, own).otherwise(m.named).alias("head"), m.body.alias("body"), (m.role == speaker).alias("mine")))
    with_parts = held.join(views, ["ck", "piece"]).withColumn("parts", parts)
    # running lengths: where each message's words start and end
    zero = F.struct(F.col("start").alias("at"), F.array().cast("array<string>").alias("spans"))

    def step(a: Column, p: Column) -> Column:
        start = a["at"] + F.length(p["head"])
        end = start + F.length(p["body"])
        span = F.concat_ws(":", start.cast("string"), end.cast("string"))
        spans = F.when(p["mine"], F.concat(a["spans"], F.array(span))).otherwise(a["spans"])
        return F.struct((end + 1).alias("at"), spans.alias("spans"))

    mask = F.aggregate("parts", zero, step, lambda a: F.concat_ws(",", a["spans"]))
    rendered = F.concat_ws("", F.transform("parts", lambda p: F.concat(p["head"], p["body"], F.lit("\n"))))
    return with_parts.select(
        "conv_id", "speaker", "piece", "start", F.size("messages").cast("long").alias("n_messages"), "n_own", rendered.alias("text"), mask.alias("mask")
    )


def op4_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rotated(spark.read.parquet(f"{sf_dir}/conversations.parquet"))


OP4_SQL = r"""
WITH m AS (
  SELECT conv_id, coalesce(role, 'unknown') AS role, replace(coalesce(text, ''), '<|', '< |') AS text,
    row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS LAST, coalesce(role, 'unknown'), coalesce(text, '')) - 1 AS number
  FROM conversations
), s AS (SELECT DISTINCT conv_id, role AS speaker FROM m
), p AS (
  SELECT m.conv_id, number, speaker, role = speaker AS mine,
    CASE WHEN role = speaker THEN '<|im_start|>assistant' ELSE '<|im_start|>user name=' || translate(replace(role, '<|', '< |'), chr(13) || chr(10), '  ') END || chr(10) AS head,
    text || '<|im_end|>' AS body
  FROM m JOIN s ON m.conv_id IS NOT DISTINCT FROM s.conv_id
), o AS (
  SELECT *, CAST(coalesce(sum(length(head) + length(body) + 1) OVER (PARTITION BY conv_id, speaker ORDER BY number ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS begins FROM p
)
SELECT conv_id, speaker, CAST(number // 64 AS BIGINT) AS piece, min(begins) AS start, count(*) AS n_messages, count(*) FILTER (WHERE mine) AS n_own,
  string_agg(head || body || chr(10), '' ORDER BY number) AS text,
  coalesce(string_agg((begins + length(head)) || ':' || (begins + length(head) + length(body)), ',' ORDER BY number) FILTER (WHERE mine), '') AS mask
FROM o GROUP BY conv_id, speaker, number // 64
"""
