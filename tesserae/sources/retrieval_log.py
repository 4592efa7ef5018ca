"""The retrieval log: a line for each search, recall, feedback and store, as text files that grow."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

LINE = r"^(\S+)\s+(search|recall|feedback|store)\s+(.+)$"


def parsed(lines: DataFrame, column: str = "value") -> DataFrame:
    """(timestamp, event, ids, ratings, comment, context_ids) of the lines that have the log's form; the others go."""
    v = F.col(column)
    rows = lines.filter(v.rlike(LINE)).select(F.regexp_extract(v, LINE, 1).alias("timestamp"), F.regexp_extract(v, LINE, 2).alias("event"), F.regexp_extract(v, LINE, 3).alias("rest"))
    parts = F.filter(F.split("rest", r"\s+"), lambda x: x != "")
    quoted = r'"([^"\\]*(?:\\.[^"\\]*)*)"$'
    has_comment = F.col("rest").rlike(quoted)
    rated = F.trim(F.regexp_replace(F.regexp_replace("rest", quoted, ""), r'\s*"[^"]*"?\s*$', ""))
    pairs = F.filter(F.split(rated, r"\s+"), lambda x: x.rlike("^[^:]+:[^:]+"))
    entries = F.transform(pairs, lambda x: F.struct(F.substring_index(x, ":", 1).alias("key"), F.regexp_extract(x, r"^[^:]+:\s*([+-]?\d+)", 1).try_cast("int").alias("value")))
    # the last rating of an id counts
    ids = F.transform(pairs, lambda x: F.substring_index(x, ":", 1))
    last = F.map_from_entries(F.transform(F.array_distinct(ids), lambda i: F.struct(i, F.element_at(F.filter(entries, lambda e: e["key"] == i), -1)["value"])))
    context = F.filter(parts, lambda x: F.startswith(x, F.lit("context:")))
    is_feedback, is_store = F.col("event") == "feedback", F.col("event") == "store"
    return rows.select(
        "timestamp",
        "event",
        F.when(is_feedback, ids).when(is_store, F.slice(parts, 1, 1)).otherwise(parts).alias("ids"),
        F.when(is_feedback, last).alias("ratings"),
        F.when(is_feedback & has_comment, F.replace(F.regexp_extract("rest", quoted, 1), F.lit('\\"'), F.lit('"'))).alias("comment"),
        F.when(is_store & (F.size(context) > 0), F.split(F.substring_index(F.element_at(context, 1), "context:", -1), ",")).alias("context_ids"),
    )


def read(spark: SparkSession, path: str) -> DataFrame:
    """The log's entries; a folder that isn't there has none."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p):
        return parsed(spark.createDataFrame([], "value string"))
    return parsed(spark.read.text(path))


def lines(entries: DataFrame) -> DataFrame:
    """(value): the line of each entry; searches, recalls and feedback without ids have none."""
    ids = F.array_join("ids", " ")
    rated = F.array_join(F.transform(F.map_entries("ratings"), lambda e: F.concat(e["key"], F.lit(":"), e["value"].cast("string"))), " ")
    said = F.when(F.col("comment") != "", F.concat(F.lit(' "'), F.replace("comment", F.lit('"'), F.lit('\\"')), F.lit('"'))).otherwise("")
    context = F.when(F.size("context_ids") > 0, F.concat(F.lit(" context:"), F.array_join("context_ids", ","))).otherwise("")
    rest = F.when(F.col("event") == "feedback", F.concat(rated, said)).when(F.col("event") == "store", F.concat(F.element_at("ids", 1), context)).otherwise(ids)
    full = F.when(F.col("event") == "feedback", F.size("ratings") > 0).otherwise(F.size("ids") > 0)
    return entries.filter(full).select(F.concat("timestamp", F.lit(" "), F.rpad("event", 8, " "), F.lit(" "), rest).alias("value"))


def append(entries: DataFrame, path: str) -> None:
    lines(entries).write.mode("append").text(path)
