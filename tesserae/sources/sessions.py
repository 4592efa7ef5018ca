"""Sessions: files of JSON lines with a conversation's messages, read as exchanges."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tesserae.functions import parsing
from tesserae.operators import exchanges

ENTRY = "type string, timestamp string, message struct<role:string,content:string>"
BLOCKS = "array<struct<type:string,text:string>>"


def lines(spark: SparkSession, folder: str) -> DataFrame:
    """(path, line_no, line) of the .jsonl files of a folder; path is the folder's name and the file's."""
    rows = spark.read.option("wholetext", True).option("pathGlobFilter", "*.jsonl").text(folder).select(F.array_join(F.slice(F.split("_metadata.file_path", "/"), -2, 2), "/").alias("path"), "value")
    return rows.select("path", F.posexplode(F.split("value", "\n")).alias("line_no", "line"))


def messages(rows: DataFrame) -> DataFrame:
    """(path, line_no, role, text, at, session_date) of the user's and the assistant's texts in (path, line_no, line).

    Lines that aren't JSON, other entries and roles, and blank texts go. A content is a text or blocks, of which the
    text ones are joined by blank lines. session_date is the day of the file's first line with a time that names one.
    """
    entry = rows.filter(F.trim("line") != "").select("path", "line_no", F.from_json("line", ENTRY).alias("e")).filter("e is not null")
    entry = entry.select("path", "line_no", F.col("e.type").alias("type"), F.col("e.timestamp").alias("at"), F.col("e.message.role").alias("role"), F.col("e.message.content").alias("content"))
    day = parsing.date_of_time(F.col("at"))
    days = entry.groupBy("path").agg(F.min_by(day, F.when(day.isNotNull(), F.col("line_no"))).alias("session_date"))
    blocks = F.from_json("content", BLOCKS)
    texts = F.transform(F.filter(blocks, lambda b: (b["type"] == "text") & (b["text"] != "")), lambda b: b["text"])
    text = F.when(F.startswith("content", F.lit("[")) & blocks.isNotNull(), F.array_join(texts, "\n\n")).otherwise(F.col("content"))
    said = entry.filter((F.col("type") == "message") & F.col("role").isin("user", "assistant")).select("path", "line_no", "role", F.trim(text).alias("text"), "at")
    return said.filter("text <> ''").join(days, "path")


def segments(rows: DataFrame) -> DataFrame:
    """Segments (SEGMENT) of (path, line_no, line): one for each exchange, dated by its first user message, else by its session."""
    said = messages(rows)
    days = said.groupBy("path").agg(F.first("session_date").alias("session_date"))
    found = exchanges.exchanges(said, "path", "line_no").join(days, "path")
    content = exchanges.content(F.col("user_text"), F.col("assistant_text"))
    date = F.coalesce(parsing.date_of_time(F.col("at")), "session_date")
    return found.select(F.col("ordinal").cast("int").alias("id"), F.col("path").alias("source_file"), F.lit(None).cast("string").alias("heading"), F.lit(None).cast("int").alias("heading_level"), date.alias("date"), F.lit(False).alias("evergreen"), F.lit(True).alias("session"), content.alias("content"), F.length(content).alias("char_count"))
