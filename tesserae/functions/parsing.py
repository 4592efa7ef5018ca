"""Replies of language models, dates and file names, read by built-in functions alone."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

FACT_TYPES = ("preference", "about", "person", "event", "goal", "work", "fact")
ISO = r"^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}(\.\d{1,9})?Z$"


def _between_brackets(text: Column) -> Column:
    """From the first [ to the last ]; null if there is no such stretch."""
    start, end = F.instr(text, "["), F.length(text) - F.instr(F.reverse(text), "]") + 1
    return F.when((start > 0) & F.contains(text, F.lit("]")) & (end > start), F.substring(text, start, end - start + 1))


def facts(replies: DataFrame, reply: str = "response") -> DataFrame:
    """A row for each valid fact of each reply: the other columns, then ordinal, type, content, reasoning, durable.

    Items without a text for type and content, blank ones and those marked as not durable go; an unknown type is a
    fact. A reply without a JSON array gives no rows.
    """
    plain = F.trim(F.col(reply))
    plain = F.regexp_replace(F.regexp_replace(plain, r"(?i)^```(json)?\s*", ""), r"\s*```\s*$", "")
    items = F.from_json(_between_brackets(plain), "array<map<string,string>>")
    rest = [c for c in replies.columns if c != reply]
    rows = replies.select(*rest, F.posexplode(items).alias("ordinal", "item"))
    kind, content, durable, why = (F.col("item")[k] for k in ("type", "content", "durable_beyond_current_task", "reasoning"))
    ok = kind.isNotNull() & (F.trim(content) != "") & ~F.coalesce(durable == "false", F.lit(False))
    return rows.filter(ok).select(
        *rest,
        "ordinal",
        F.when(kind.isin(*FACT_TYPES), kind).otherwise("fact").alias("type"),
        F.trim(content).alias("content"),
        F.when(F.trim(why) != "", F.trim(why)).alias("reasoning"),
        F.when(durable == "true", True).alias("durable"),
    )


ENRICHED = "array<struct<id:int,type:string,temporal_state:string,temporal_anchor:string,sub_segments:array<struct<content:string,type:string,temporal_state:string,temporal_anchor:string>>>>"


def enrichments(replies: DataFrame, reply: str = "response") -> DataFrame:
    """A row for each segment that a reply describes: id, type, temporal_state, temporal_anchor, sub_segments.

    A fenced block is read first, else the reply from [ to ]. Missing types are observations and missing states none.
    """
    fenced = F.regexp_extract(F.col(reply), r"(?is)```(?:json)?\s*(.*?)```", 1)
    plain = F.trim(F.when(fenced != "", fenced).otherwise(F.col(reply)))
    plain = F.when(F.startswith(plain, F.lit("[")), plain).otherwise(_between_brackets(plain))
    rest = [c for c in replies.columns if c != reply]
    rows = replies.select(*rest, F.explode(F.from_json(plain, ENRICHED)).alias("e")).filter("e is not null")
    return rows.select(
        *rest,
        "e.id",
        F.coalesce("e.type", F.lit("observation")).alias("type"),
        F.coalesce("e.temporal_state", F.lit("none")).alias("temporal_state"),
        F.when(F.col("e.temporal_anchor") != "", F.col("e.temporal_anchor")).alias("temporal_anchor"),
        "e.sub_segments",
    )


def valid_iso(text: Column) -> Column:
    """Whether a text is a UTC time in ISO form of a day that exists."""
    return F.coalesce(text.rlike(ISO) & F.try_to_timestamp(text).isNotNull(), F.lit(False))


def date_of_file(name: Column) -> Column:
    """The day that a file is named for, or null."""
    day = F.regexp_extract(name, r"^(\d{4}-\d{2}-\d{2})\.md$", 1)
    return F.when(day != "", day)


def date_of_time(at: Column) -> Column:
    """The day that an ISO time starts with, or null."""
    day = F.regexp_extract(at, r"^(\d{4}-\d{2}-\d{2})", 1)
    return F.when(day != "", day)


def evergreen(path: Column) -> Column:
    """Whether a relative path is the memory file of the root."""
    return F.lower(path) == "memory.md"


def sleep_debt(last: Column, memories: Column, now: Column) -> Column:
    """'never' if nothing was consolidated though there are memories, 'overdue' after 48 hours, else an empty text."""
    hours = (F.unix_micros(now) - F.unix_micros(last)) / 3.6e9
    return F.when(last.isNull(), F.when(memories > 0, "never").otherwise("")).when(hours > 48, "overdue").otherwise("")
