"""Conversations as exchanges: what a user says and what is answered, up to the user's next word."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def exchanges(messages: DataFrame, key: str, order: str) -> DataFrame:
    """(key, ordinal, user_text, assistant_text, at): the completed exchanges of messages (key, order, role, text, and maybe at).

    An exchange ends where a user speaks after an answer. Other roles and blank texts go first; an exchange without a
    user or without an answer is dropped, and the others are numbered from 0. at is the user's first time.
    """
    said = messages.filter(F.col("role").isin("user", "assistant") & (F.trim("text") != ""))
    w = Window.partitionBy(key).orderBy(order)
    turn = F.when((F.col("role") == "user") & (F.lag("role").over(w) == "assistant"), 1).otherwise(0)
    said = said.withColumn("new", turn).withColumn("ex", F.sum("new").over(w))
    at = F.col("at") if "at" in messages.columns else F.lit(None).cast("string")
    line = F.struct(F.col(order).alias("o"), F.trim("text").alias("t"))
    sides = {s: F.sort_array(F.collect_list(F.when(F.col("role") == s, line))) for s in ("user", "assistant")}
    first = F.min_by(at, F.when((F.col("role") == "user") & at.isNotNull(), F.col(order))).alias("at")
    rows = said.groupBy(key, "ex").agg(*(v.alias(k) for k, v in sides.items()), first)
    rows = rows.filter((F.size("user") > 0) & (F.size("assistant") > 0))
    number = F.row_number().over(Window.partitionBy(key).orderBy("ex")) - 1
    texts = [F.array_join(F.transform(F.col(s), lambda x: x["t"]), "\n\n").alias(f"{s}_text") for s in ("user", "assistant")]
    return rows.select(key, number.alias("ordinal"), *texts, "at")


def content(user, assistant):
    return F.concat(F.lit("User: "), user, F.lit("\n\nAssistant: "), assistant)
