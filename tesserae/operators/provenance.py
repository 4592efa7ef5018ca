"""What turns showed and used: exposures, attributions, feedback, and the reinforcement that follows from them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tesserae import schema as S
from tesserae.functions import scoring, turns
from tesserae.operators import dml, scans
from tesserae.sources.store import Store

#: Of the exposures of one turn and memory, the mode that comes first here says how it was retrieved.
MODE_ORDER = {m: i for i, m in enumerate(S.MODES)}

LEDGER = "session_id string, turn_id string, memory_id string, channel string, score double, bm25_only boolean, created_at timestamp, seq long"
TURNS = f"session_id string, turn_id string, prior_messages int, created_at timestamp, seq long, messages {turns.MESSAGES}, feedback array<struct<memory_id:string,rating:double>>"


def mode_rank(mode: Column) -> Column:
    out = F.lit(len(MODE_ORDER))
    for m, i in MODE_ORDER.items():
        out = F.when(mode == m, i).otherwise(out)
    return out


def retrieval_modes(exposures: DataFrame) -> DataFrame:
    """(memory_id, turn_id, retrieval_mode): of each turn and memory, that of the first mode."""
    return exposures.groupBy("memory_id", "turn_id").agg(F.min_by("retrieval_mode", F.struct(mode_rank(F.col("mode")), "session_id")).alias("retrieval_mode"))


def reinforcements(attributions: DataFrame, exposures: DataFrame) -> DataFrame:
    """(memory_id, total): what the attributions that weren't applied yet add to each memory's strength."""
    pending = scans.unreinforced(attributions)
    rows = pending.join(retrieval_modes(exposures), ["memory_id", "turn_id"], "left")
    weight = F.when(F.col("retrieval_mode") == "bm25_only", S.BM25_ONLY_WEIGHT).otherwise(1.0)
    return rows.groupBy("memory_id").agg(F.sum(S.LEARNING_RATE * F.col("confidence") * weight).alias("total"))


def reinforced(store: Store, given: DataFrame | None = None) -> Store:
    """Adds the reinforcements, strengths staying from 0 to 1, and marks all attributions as applied.

    given: what `reinforcements` says of the store, if it is at hand.
    """
    given = reinforcements(store.attributions, store.exposures) if given is None else given
    sums = given.select(F.col("memory_id").alias("id"), "total")
    m = store.memories.join(sums, "id", "left")
    new = F.when(F.coalesce("total", F.lit(0.0)) == 0, F.col("strength")).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("strength") + F.col("total"))))
    memories = m.withColumn("strength", new).select(*store.memories.columns)
    return store.with_(memories=memories, attributions=store.attributions.withColumn("reinforcement_applied", F.lit(True)))


def exposures_of(ledger: DataFrame) -> DataFrame:
    """The exposures that a ledger (LEDGER) of turns amounts to, each key once."""
    shown = F.col("channel").isin("auto_injected", "tool_search_returned")
    rows = ledger.select(
        "session_id",
        "turn_id",
        "memory_id",
        F.col("channel").alias("mode"),
        F.when(shown, F.col("score")).alias("score"),
        F.when(shown, F.when(F.col("bm25_only"), "bm25_only").otherwise("hybrid")).alias("retrieval_mode"),
        F.lit(None).cast("int").alias("message_index"),
        "created_at",
        "seq",
    )
    return dml.first_of(rows, dml.EXPOSURE_KEY, ["seq"]).drop("seq")


def answers(turn: DataFrame) -> DataFrame:
    """(turn_id, message_id): the last answer of each turn that has one."""
    at = turns.last_index(F.col("messages"), "assistant", F.col("prior_messages"))
    return turn.select("turn_id", at.alias("at")).filter("at >= 0").select("turn_id", F.concat_ws(":msg:", "turn_id", F.col("at").cast("string")).alias("message_id"))


def implicit_attributions(ledger: DataFrame, turn: DataFrame) -> DataFrame:
    """(message_id, memory_id, evidence, confidence, turn_id, created_at, seq): what the answers owe to the memories shown.

    What a turn stored itself isn't attributed.
    """
    shown = ledger.filter(F.col("channel").isin("auto_injected", "tool_search_returned", "tool_get"))
    rows = shown.join(answers(turn), "turn_id")
    order = F.col("seq") * 8 + mode_rank(F.col("channel"))
    return rows.select("message_id", "memory_id", F.col("channel").alias("evidence"), scoring.confidence_of(F.col("channel")).alias("confidence"), "turn_id", "created_at", order.alias("seq"))


def feedback_calls(turn: DataFrame) -> DataFrame:
    """(turn_id, memory_id, rating, created_at, seq): the last valid rating of each memory in each turn."""
    calls = turn.select("turn_id", "created_at", "seq", F.posexplode("feedback").alias("at", "call"))
    calls = calls.select("turn_id", "created_at", "seq", "at", "call.memory_id", "call.rating").filter(F.col("memory_id").isNotNull() & scoring.valid_rating(F.col("rating")))
    return calls.groupBy("turn_id", "memory_id").agg(F.max_by("rating", "at").cast("int").alias("rating"), F.first("created_at").alias("created_at"), F.first("seq").alias("seq"))


def feedback_attributions(calls: DataFrame, turn: DataFrame, known: DataFrame) -> DataFrame:
    """Feedback as attribution rows: on the newest attribution of its memory, else on the turn's own answer.

    known: attributions that came before, those of the same turns included. A rating with neither is lost.
    """
    newest = scans.latest_attributions(known).select("memory_id", F.col("message_id").alias("newest"))
    rows = calls.join(newest, "memory_id", "left").join(answers(turn), "turn_id", "left")
    kind = scoring.feedback_evidence(F.col("rating"))
    rows = rows.withColumn("target", F.coalesce("newest", "message_id")).filter("target is not null")
    return rows.select(F.col("target").alias("message_id"), "memory_id", kind.alias("evidence"), scoring.confidence_of(kind).alias("confidence"), "turn_id", "created_at", (F.col("seq") * 8 + 7).alias("seq"))


def ingested(store: Store, ledger: DataFrame, turn: DataFrame) -> Store:
    """The store after turns ended: ledger (LEDGER) and turn (TURNS). Running it again with the same turns changes nothing more.

    Feedback finds the newest attribution among all that were known before and those of the batch.
    """
    exposures = dml.inserted_or_ignored(store.exposures, exposures_of(ledger).withColumn("seq", F.lit(0)), dml.EXPOSURE_KEY, ["seq"])
    shown = dml.attributions_upserted(store.attributions, implicit_attributions(ledger, turn))
    given = feedback_attributions(feedback_calls(turn), turn, shown)
    return store.with_(exposures=exposures, attributions=dml.attributions_upserted(shown, given))


def visible(ledger: DataFrame) -> DataFrame:
    """(turn_id, memory_id): memories that tools already show in a turn."""
    return ledger.filter(F.col("channel").isin("tool_search_returned", "tool_get", "tool_store")).select("turn_id", "memory_id").distinct()


def ledger_versions(ledger: DataFrame) -> DataFrame:
    """(turn_id, version): how many distinct things tools showed in each turn."""
    seen = ledger.filter(F.col("channel").isin("tool_search_returned", "tool_get", "tool_store"))
    return seen.groupBy("turn_id").agg(F.count_distinct("channel", "memory_id").alias("version"))
