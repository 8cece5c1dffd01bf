"""Operator 6, chat formatting with cumulative-snapshot collapse, in DataFrame operations only.

A chat log often holds snapshots: the same conversation, logged again after each exchange. Rolling hashes of turn prefixes (hash of the hash so far, role and text) tell them:
a conversation whose whole hash is the hash of a shorter prefix of another is a snapshot and goes (an anti-join against the distinct prefix hashes); of
equal conversations the one of the smallest conv_id stays. What stays is maximal, and is rendered with a chat template.

A conversation's turns are ordered by turn, then role, then text; turns repeated in all of these count once. Null role renders as ``unknown``, null text as empty; a null turn
sorts first; rows of null conv_id are one conversation. A conversation is one training document, so its turns meet in one row (2 GB at most, as any row; log rows without conv_id should be kept out beforehand); no other group does: the hashes of
a common first turn, or of equal conversations, are counted map-side. Empty tables give empty results; other columns are left alone.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import settle, table

START, MIDDLE, END, BLOCK = "<|im_start|>", "\n", "<|im_end|>\n", 256


def rolled(turns: Column) -> Column:
    """Hash of each prefix of an array of turns (role, text): SHA-256 of the last prefix's hash, the role's length, role and text."""
    step = lambda so_far, t: F.sha2(F.concat(so_far, F.length(t["role"]).cast("string"), F.lit(":"), t["role"], F.lit(":"), t["text"]).cast("binary"), 256)
    none, lists = F.array().cast("array<string>"), F.array().cast("array<array<string>>")
    begin = F.struct(F.lit("").alias("last"), none.alias("now"), lists.alias("done"))

    def add(so_far: Column, t: Column) -> Column:
        now = step(so_far["last"], t)
        own = F.concat(so_far["now"], F.array(now))
        full = F.size(so_far["now"]) >= BLOCK - 1  # in blocks, so that no long array is copied for each turn
        return F.struct(now.alias("last"), F.when(full, none).otherwise(own).alias("now"), F.when(full, F.concat(so_far["done"], F.array(own))).otherwise(so_far["done"]).alias("done"))

    return F.aggregate(turns, begin, add, lambda x: F.concat(F.flatten(x["done"]), x["now"]))


def rendered(turns: Column) -> Column:
    return F.array_join(F.transform(turns, lambda t: F.concat(F.lit(START), t["role"], F.lit(MIDDLE), t["text"], F.lit(END))), "")


def collapse(logs: DataFrame) -> DataFrame:
    """conv_id, n_turns, n_equal (conversations equal to it) and chat (rendered) of the maximal conversations."""
    rows = logs.select("conv_id", "turn", F.coalesce("role", F.lit("unknown")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    convs = rows.groupBy("conv_id").agg(F.sort_array(F.collect_set(F.struct("turn", "role", "text"))).alias("turns"))  # one shuffle; repeated turns meet before it
    convs = settle(convs.withColumn("hashes", rolled(F.col("turns"))), "conversations")
    whole = convs.select("conv_id", F.size("turns").cast("long").alias("n_turns"), F.element_at("hashes", -1).alias("hash"))
    unique = whole.groupBy("hash", "n_turns").agg(F.min("conv_id").alias("conv_id"), F.count(F.lit(1)).alias("n_equal"))
    shorter = convs.select(F.explode(F.expr("slice(hashes, 1, greatest(size(hashes) - 1, 0))")).alias("hash")).distinct()
    stay = unique.join(shorter, "hash", "left_anti").select(F.col("conv_id").alias("c"), "n_turns", "n_equal")
    out = convs.join(stay, F.col("conv_id").eqNullSafe(F.col("c")))
    return out.select("conv_id", "n_turns", "n_equal", rendered(F.col("turns")).alias("chat"))


def op6_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collapse(table(spark, sf_dir, "conversations"))


OP6_SQL = """
WITH r AS (
  SELECT DISTINCT conv_id, turn, coalesce(role, 'unknown') AS role, coalesce(text, '') AS text FROM conversations
), p AS (
  SELECT conv_id, turn, role, text, row_number() OVER w AS k, count(*) OVER (PARTITION BY conv_id) AS n_turns,
    string_agg(length(role) || ':' || role || ':' || length(text) || ':' || text, '|') OVER (w ROWS UNBOUNDED PRECEDING) AS prefix
  FROM r WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text)
), h AS (
  SELECT min(conv_id) AS conv_id, n_turns, count(*) AS n_equal, prefix FROM p WHERE k = n_turns GROUP BY n_turns, prefix
), m AS (
  SELECT conv_id, n_turns, n_equal FROM h WHERE prefix NOT IN (SELECT prefix FROM p WHERE k < n_turns)
)
SELECT m.conv_id, m.n_turns, m.n_equal, string_agg('<|im_start|>' || role || chr(10) || text || '<|im_end|>' || chr(10), '' ORDER BY turn NULLS FIRST, role, text) AS chat
FROM m JOIN p ON m.conv_id IS NOT DISTINCT FROM p.conv_id GROUP BY ALL
"""
