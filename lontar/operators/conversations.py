"""Chats to instruction pairs, rendered prompts and trimmed histories."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lontar.functions import text as T


def first_pairs(turns: DataFrame) -> DataFrame:
    """``conv_id``, ``instruction``, ``response``: the first user turn with text and the first later assistant turn with text.

    Conversations without both give no row; repeated rows change nothing; of several texts of one
    turn the first in order of text counts; turns without number are left out.
    """
    said = turns.where(F.col("conv_id").isNotNull() & F.col("turn").isNotNull()).withColumn("text", T.strip(F.col("text"))).where("text <> ''")
    asked = said.where("role = 'user'").groupBy("conv_id").agg(F.min(F.struct("turn", "text")).alias("u"))
    replies = said.where("role = 'assistant'").join(asked, "conv_id").where(F.col("turn") > F.col("u.turn"))
    first = replies.groupBy("conv_id").agg(F.min("u").alias("u"), F.min(F.struct("turn", "text")).alias("a"))
    return first.select("conv_id", F.col("u.text").alias("instruction"), F.col("a.text").alias("response"))


def rendered(turns: DataFrame, generation_prompt: bool = False) -> DataFrame:
    """``conv_id``, ``prompt``: all turns with text in order, between turn marks; repeated rows count once.

    One conversation is one array, so its length is bounded by what a chat can hold.
    """
    rows = turns.where("conv_id is not null and turn is not null and role is not null and text is not null").select("conv_id", "turn", "role", "text").distinct()
    parts = rows.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role", "text"))).alias("m"))
    body = F.array_join(F.transform("m", lambda m: T.chat_turn(m["role"], m["text"])), "")
    return parts.select("conv_id", (F.concat(body, F.lit("<|im_start|>assistant\n")) if generation_prompt else body).alias("prompt"))


def last_turns(turns: DataFrame, count: int = 6) -> DataFrame:
    """The last turns of user and assistant with text, out of the last ``count`` turns of each conversation."""
    recent = Window.partitionBy("conv_id").orderBy(F.desc("turn"), F.desc("role"), F.desc("text"))
    rows = turns.where("conv_id is not null and turn is not null").select("conv_id", "turn", "role", "text").distinct()
    last = rows.withColumn("back", F.row_number().over(recent)).where(F.col("back") <= count)
    return last.where(F.col("role").isin("user", "assistant") & (T.strip(F.col("text")) != "")).select("conv_id", "turn", "role", "text")


def prompt_of(conversation: Column) -> Column:
    """A transcript up to and with its last assistant mark; the whole where there is none."""
    found = F.regexp_extract(conversation, r"(?s)^(.*\n\nAssistant:)", 1)
    return F.when(found != "", found).otherwise(conversation)
