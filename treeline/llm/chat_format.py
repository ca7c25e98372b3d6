"""Conversations as training text, by array expressions over sorted turn structs.

The turns of a conversation are collected as structs and sorted by (turn, role, text), nulls first as Spark sorts them.
A turn whose role equals the one before continues its message; a null role is the role "unknown" and a null text is
empty. Rows with a null conversation id make one conversation of their own. Turns of one number are ordered by role and
text, and repeated rows stay as turns of their own. An empty table gives no rows; further columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from treeline.llm._spark import table

BEGIN, END, JOIN = "<|im_start|>", "<|im_end|>\n", "\n\n"
UNKNOWN = "unknown"


def render(turns: Column, begin: str = BEGIN, end: str = END, join: str = JOIN) -> Column:
    """Text of a sorted array of (turn, role, text): a header where the role changes, its end before the next one."""
    size = F.size(turns)

    def one(x: Column, i: Column) -> Column:
        first = (i == 0) | (F.try_element_at(turns, i) ["role"] != x["role"])
        last = (i == size - 1) | (F.try_element_at(turns, i + 2)["role"] != x["role"])
        return F.concat(F.when(first, F.concat(F.lit(begin), x["role"], F.lit("\n"))).otherwise(F.lit(join)), x["text"], F.when(last, F.lit(end)).otherwise(F.lit("")))

    return F.array_join(F.transform(turns, one), "")


def messages(turns: Column) -> Column:
    """Number of messages after merging."""
    return F.aggregate(F.transform(turns, lambda x, i: F.when((i > 0) & (F.try_element_at(turns, F.greatest(i, F.lit(1)))["role"] == x["role"]), 0).otherwise(1)), F.lit(0), lambda a, x: a + x)


def format_chats(df: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", **marks: str) -> DataFrame:
    """(conv_id, n_turns, n_messages, formatted) of every conversation."""
    turns = df.select(
        F.col(f"`{conv_col}`").alias("conv_id"),
        F.struct(
            F.col(f"`{turn_col}`").alias("turn"),
            F.coalesce(F.col(f"`{role_col}`").cast("string"), F.lit(UNKNOWN)).alias("role"),
            F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")).alias("text"),
        ).alias("t"),
    )
    grouped = turns.groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("turns"))
    return grouped.select("conv_id", F.size("turns").cast("bigint").alias("n_turns"), messages(F.col("turns")).cast("bigint").alias("n_messages"), render(F.col("turns"), **marks).alias("formatted"))


def op6_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    return format_chats(table(spark, sf_dir, "conversations"))


SQL = """
WITH t AS (
  SELECT conv_id, turn, coalesce(role, 'unknown') AS role, coalesce(text, '') AS text,
         row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, 'unknown'), coalesce(text, '')) AS i
  FROM conversations),
s AS (SELECT *, CASE WHEN lag(role) OVER w = role THEN 0 ELSE 1 END AS starts FROM t WINDOW w AS (PARTITION BY conv_id ORDER BY i)),
m AS (SELECT *, sum(starts) OVER (PARTITION BY conv_id ORDER BY i) AS message FROM s),
g AS (
  SELECT conv_id, message, any_value(role) AS role, count(*) AS turns, string_agg(text, chr(10) || chr(10) ORDER BY i) AS body
  FROM m GROUP BY conv_id, message)
SELECT conv_id, sum(turns)::BIGINT AS n_turns, count(*)::BIGINT AS n_messages,
       string_agg('<|im_start|>' || role || chr(10) || body || '<|im_end|>' || chr(10), '' ORDER BY message) AS formatted
FROM g GROUP BY conv_id
"""
