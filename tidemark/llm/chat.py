"""Multi-party perspective rotation, in DataFrame operations only.

For every participant of a conversation the whole dialogue is rendered with that
speaker as the assistant and all others as named users; only the assistant's own
words are trained on. The rendering is kept as one row a turn with its place in the
rendered text, so that no conversation has to fit into one row or one task; offsets
come from running sums at two levels, over blocks of turns and inside them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Roles that set the scene and are nobody's perspective.
CONTEXT = ("system",)
#: Marks around a turn: opening by kind, closing.
OPEN, CLOSE = "<|{}|>\n", "<|end|>\n"
#: Turns of a conversation that are numbered together.
BLOCK = 64


def rotate(turns: DataFrame, block: int = BLOCK) -> DataFrame:
    """(conv_id, turn, role, text) to one row for each participant and turn.

    Columns: conv_id, speaker (whose perspective), turn, role (system, assistant or
    user), name (of a user), segment (the rendered turn), start and end (characters of
    the segment in the rendered dialogue), train_start and train_end (the masked-in
    characters: the assistant's text and closing mark; elsewhere an empty span at the end).

    Null texts are empty; a null role is the participant `unknown`; a null turn sorts
    first. Turns with one number stand in order of role and text, and repeated rows
    stay repeated. Rows with a null conv_id form one conversation. A conversation
    without participants but the context roles gives no rows.
    """
    said = turns.select(
        "conv_id",
        "turn",
        F.coalesce(F.col("role"), F.lit("unknown")).alias("who"),
        F.coalesce(F.col("text"), F.lit("")).alias("body"),
    ).withColumn("_block", F.coalesce(F.floor(F.col("turn") / block), F.lit(-(2**62))))
    speakers = said.where(~F.col("who").isin(*CONTEXT)).select(F.col("conv_id").alias("_conv"), F.col("who").alias("speaker")).distinct()
    seen = said.join(speakers, F.col("conv_id").eqNullSafe(F.col("_conv"))).drop("_conv")
    mine = F.col("who") == F.col("speaker")
    seen = seen.withColumn("role", F.when(F.col("who").isin(*CONTEXT), F.col("who")).when(mine, F.lit("assistant")).otherwise(F.lit("user")))
    seen = seen.withColumn("name", F.when(F.col("role") == "user", F.col("who")))
    head = F.concat(F.lit("<|"), F.col("role"), F.lit("|>\n"), F.when(F.col("name").isNotNull(), F.concat(F.col("name"), F.lit(": "))).otherwise(F.lit("")))
    seen = seen.withColumn("segment", F.concat(head, F.col("body"), F.lit(CLOSE))).withColumn("_len", F.char_length("segment").cast("long")).withColumn("_head", F.char_length(head).cast("long"))
    key = ["conv_id", "speaker"]
    blocks = seen.groupBy(*key, "_block").agg(F.sum("_len").alias("_sum"))
    before = Window.partitionBy(*key).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = blocks.select(F.col("conv_id").alias("_c"), F.col("speaker").alias("_s"), F.col("_block").alias("_b"), F.coalesce(F.sum("_sum").over(before), F.lit(0)).alias("_base"))
    inside = Window.partitionBy(*key, "_block").orderBy("turn", "who", "body").rowsBetween(Window.unboundedPreceding, -1)
    placed = seen.withColumn("_in", F.coalesce(F.sum("_len").over(inside), F.lit(0)))
    same = F.col("conv_id").eqNullSafe(F.col("_c")) & (F.col("speaker") == F.col("_s")) & (F.col("_block") == F.col("_b"))
    placed = placed.join(blocks, same).withColumn("start", F.col("_base") + F.col("_in"))
    own = F.col("role") == "assistant"
    return placed.select(
        "conv_id", "speaker", "turn", "role", "name", "segment", "start", (F.col("start") + F.col("_len")).alias("end"),
        (F.col("start") + F.when(own, F.col("_head")).otherwise(F.col("_len"))).alias("train_start"), (F.col("start") + F.col("_len")).alias("train_end"),
    )


def op9_perspectives(spark, sf_dir: str) -> DataFrame:
    """Every conversation from every participant's side, a row a turn."""
    from tidemark.llm.common import table

    return rotate(table(spark, sf_dir, "conversations"))


ORACLE_OP9 = """
WITH said AS (SELECT conv_id, turn, coalesce(role, 'unknown') AS who, coalesce(text, '') AS body FROM conversations),
speakers AS (SELECT DISTINCT conv_id AS c, who AS speaker FROM said WHERE who <> 'system'),
seen AS (
  SELECT said.*, speaker, CASE WHEN who = 'system' THEN who WHEN who = speaker THEN 'assistant' ELSE 'user' END AS role
  FROM said JOIN speakers ON conv_id IS NOT DISTINCT FROM c
), rendered AS (
  SELECT *, CASE WHEN role = 'user' THEN who END AS name,
    '<|' || role || '|>' || chr(10) || CASE WHEN role = 'user' THEN who || ': ' ELSE '' END AS head FROM seen
), sized AS (
  SELECT *, head || body || '<|end|>' || chr(10) AS segment FROM rendered
), placed AS (
  SELECT *, coalesce(sum(length(segment)) OVER (PARTITION BY conv_id, speaker ORDER BY turn NULLS FIRST, who, body ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS s FROM sized
)
SELECT conv_id, speaker, turn, role, name, segment, s AS start, s + length(segment) AS "end",
  s + CASE WHEN role = 'assistant' THEN length(head) ELSE length(segment) END AS train_start,
  s + length(segment) AS train_end
FROM placed
"""
