"""The synthetic tables seen as a memory store: fixed rules turn documents, events and embeddings into its tables.

The clock stands still at NOW. Everything follows from doc_id and event_id, so other engines can do the same.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tesserae import schema as S
from tesserae.operators import dml, graph
from tesserae.sources.store import Store, conformed, empty

NOW = "2024-02-15 00:00:00"
#: The last run, and the time up to which exposures made the first edges.
LAST, SEED_UNTIL = "2024-01-25 00:00:00", "2024-01-15 00:00:00"
TYPES = ("fact", "preference", "decision", "plan", "observation")


def now():
    return F.lit(NOW).cast("timestamp")


def last():
    return F.lit(LAST).cast("timestamp")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _pick(by, values):
    out = F.lit(values[-1])
    for i, v in reversed(list(enumerate(values[:-1]))):
        out = F.when(by == i, v).otherwise(out)
    return out


def memories_with_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The memories, with the doc_id that each comes from: of equal texts the smallest.

    Texts are grouped by their ids, so where the content isn't used no text is shuffled.
    """
    docs = table(spark, sf_dir, "documents").filter("text is not null and doc_id is not null")
    m = docs.select("doc_id", "text", S.content_id(F.col("text")).alias("id"))
    m = m.groupBy("id").agg(F.min("doc_id").alias("doc_id"), F.max("text").alias("text"))
    d = F.col("doc_id")
    anchor = F.when(d % 4 != 0, F.expr("timestampadd(DAY, cast(doc_id % 60 as int), timestamp'2024-01-01 00:00:00')"))
    return m.select(
        "id",
        _pick(d % 5, TYPES).alias("type"),
        F.col("text").alias("content"),
        _pick(d % 4, ("none", "future", "present", "past")).alias("temporal_state"),
        anchor.alias("temporal_anchor"),
        F.expr("timestampadd(HOUR, cast(doc_id % 720 as int), timestamp'2024-01-01 00:00:00')").alias("created_at"),
        (((d * 37) % 101).cast("double") / 100.0).alias("strength"),
        _pick(d % 4, ("agent_tool", "auto_capture", "consolidation", "import")).alias("source"),
        (d % 7 == 0).alias("consolidated"),
        "doc_id",
    )


def ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, memory_id) of the documents that are memories."""
    return memories_with_docs(spark, sf_dir).select("doc_id", F.col("id").alias("memory_id"))


def exposure_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exposures with their event_id, before repeated keys go; k: a small number of the event."""
    n = table(spark, sf_dir, "documents").agg(F.count(F.lit(1)).alias("n"))
    e = table(spark, sf_dir, "events").crossJoin(F.broadcast(n))
    kind = F.col("event_type")
    at = F.col("ts").cast("timestamp")
    e = e.select(
        F.col("user_id").cast("string").alias("session_id"),
        F.concat(F.col("user_id").cast("string"), F.lit(":"), F.date_format(at, "yyyy-MM-dd")).alias("turn_id"),
        ((F.col("event_id") * 7919) % F.col("n")).alias("doc_id"),
        F.when(kind == "view", "auto_injected").when(kind.isin("click", "error"), "tool_search_returned").when(kind == "purchase", "tool_get").otherwise("tool_store").alias("mode"),
        F.col("value").alias("score"),
        F.when(kind.isin("view", "click"), "hybrid").when(kind == "error", "bm25_only").alias("retrieval_mode"),
        at.alias("created_at"),
        "event_id",
        F.get_json_object("props", "$.k").cast("int").alias("k"),
    )
    return e.join(ids(spark, sf_dir), "doc_id").drop("doc_id")


def exposures(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = dml.first_of(exposure_events(spark, sf_dir), dml.EXPOSURE_KEY, ["event_id"])
    return conformed(rows, "exposures")


def attribution_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Attributions one by one: (message_id, memory_id, turn_id, created_at, evidence, confidence, seq)."""
    from tesserae.functions.scoring import confidence_of, feedback_evidence

    rows = exposure_events(spark, sf_dir)
    rows = rows.withColumn("evidence", F.when(F.col("mode") != "tool_store", F.col("mode")).otherwise(feedback_evidence(1 + F.col("k") % 5)))
    return rows.select(F.concat("turn_id", F.lit(":msg:0")).alias("message_id"), "memory_id", "turn_id", "created_at", "evidence", confidence_of(F.col("evidence")).alias("confidence"), F.col("event_id").alias("seq"))


def attributions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conformed(dml.merged_attributions(attribution_events(spark, sf_dir)), "attributions")


def embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("doc_id"), "embedding")
    return v.join(ids(spark, sf_dir), "doc_id").select(F.col("memory_id").alias("id"), F.col("embedding").cast("array<float>").alias("embedding"))


def associations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edges from what was shown together before SEED_UNTIL."""
    from tesserae.functions.scoring import either

    shown = exposures(spark, sf_dir).filter(F.col("created_at") < F.lit(SEED_UNTIL).cast("timestamp"))
    pairs = graph.co_retrieved(shown, ids(spark, sf_dir).select(F.col("memory_id").alias("id")))
    made = pairs.groupBy("memory_a", "memory_b").agg(either(F.col("weight")).alias("weight"))
    return conformed(made.withColumn("created_at", F.lit(SEED_UNTIL).cast("timestamp")), "associations")


def aliases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chains: every third document points to the next such one, up to the next multiple of 30."""
    m = ids(spark, sf_dir)
    old = m.filter("doc_id % 3 = 0 and doc_id % 30 <> 0")
    new = m.select((F.col("doc_id") - 3).alias("doc_id"), F.col("memory_id").alias("new_id"))
    return old.join(new, "doc_id").select(F.col("memory_id").alias("old_id"), "new_id", F.lit("merged").alias("reason"), F.lit(SEED_UNTIL).cast("timestamp").alias("created_at"))


def store(spark: SparkSession, sf_dir: str) -> Store:
    """All of it; each table is a plan of its own, so a query reads only what it uses."""
    return empty(
        spark,
        memories=conformed(memories_with_docs(spark, sf_dir), "memories"),
        associations=associations(spark, sf_dir),
        embeddings=embeddings(spark, sf_dir),
        exposures=exposures(spark, sf_dir),
        attributions=attributions(spark, sf_dir),
        aliases=aliases(spark, sf_dir),
        state=spark.createDataFrame([("last_consolidation_at", LAST.replace(" ", "T") + "Z")], S.struct("state")),
    )
