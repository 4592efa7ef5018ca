"""Tables of the memory store: their columns, closed string domains, and the numbers that the operators share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

SCHEMA_VERSION = 5

STATES = ("future", "present", "past", "none")
SOURCES = ("agent_tool", "auto_capture", "consolidation", "import")
MODES = ("auto_injected", "tool_search_returned", "tool_get", "tool_store")
FEEDBACK = ("agent_feedback_neutral", "agent_feedback_positive", "agent_feedback_negative")
EVIDENCE = (*MODES[:3], *FEEDBACK)
RETRIEVAL_MODES = ("hybrid", "bm25_only")

#: Kept per cycle: of a working memory's strength, of a consolidated one's, of an edge's weight.
WORKING_DECAY, CONSOLIDATED_DECAY, EDGE_DECAY = 0.906, 0.977, 0.9
MOST_CYCLES = 30
LEARNING_RATE, BM25_ONLY_WEIGHT = 0.7, 0.5
SAME_CHANNEL, CROSS_CHANNEL = 0.05, 0.15
LEAST_TRANSITIVE, TRANSITIVE_UPDATES = 0.1, 100
PRUNE_STRENGTH, PRUNE_WEIGHT = 0.05, 0.01
EXPOSURE_DAYS = 30
MERGE_JACCARD, MERGE_COSINE = 0.4, 0.6
MERGE_COMBINED, MERGE_JACCARD_ALONE = 0.5, 0.6
MERGE_SOURCES, MERGE_TARGETS, MERGE_PAIRS = 500, 1000, 20
#: The least strength of a source and of a target.
MERGE_SOURCE_STRENGTH, MERGE_TARGET_STRENGTH = 0.5, 0.3
WEAKENED = 0.3

TABLES: dict[str, str] = {
    "memories": "id string, type string, content string, temporal_state string, temporal_anchor timestamp, created_at timestamp, strength double, source string, consolidated boolean",
    "associations": "memory_a string, memory_b string, weight double, created_at timestamp, last_updated_at timestamp",
    "embeddings": "id string, embedding array<float>",
    "exposures": "session_id string, turn_id string, memory_id string, mode string, score double, retrieval_mode string, message_index int, created_at timestamp",
    "attributions": "message_id string, memory_id string, evidence string, confidence double, turn_id string, created_at timestamp, updated_at timestamp, reinforcement_applied boolean",
    "aliases": "old_id string, new_id string, reason string, created_at timestamp",
    "state": "key string, value string",
}

SEGMENT = "id int, source_file string, heading string, heading_level int, date string, evergreen boolean, session boolean, content string, char_count int"


def struct(table: str) -> T.StructType:
    return T.StructType.fromDDL(TABLES[table])


def content_id(content: Column) -> Column:
    """The id of a memory: the SHA-256 of its content."""
    return F.sha2(content, 256)


def iso(at: Column) -> Column:
    """A timestamp as UTC text of milliseconds; the session's time zone must be UTC."""
    return F.date_format(at, "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")


def valid_memories(memories: DataFrame) -> DataFrame:
    """Rows whose state and source are of their domains; an empty content reads '(content not found)'."""
    ok = F.col("temporal_state").isin(*STATES) & F.col("source").isin(*SOURCES)
    return memories.filter(ok).withColumn("content", F.when(F.col("content") == "", "(content not found)").otherwise(F.col("content")))


def valid_exposure() -> Column:
    score = F.col("score")
    finite = score.isNull() | ~(F.isnan(score) | (F.abs(score) == float("inf")))
    mode = F.col("retrieval_mode")
    return F.col("mode").isin(*MODES) & finite & (mode.isNull() | mode.isin(*RETRIEVAL_MODES))


def valid_attribution() -> Column:
    return F.col("evidence").isin(*EVIDENCE) & F.col("confidence").between(-1.0, 1.0)


def valid_strength() -> Column:
    s = F.col("strength")
    return (s >= 0) & ~F.isnan(s) & (s < float("inf"))
