"""Reads of the store's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tesserae import schema as S
from tesserae.functions import text as tx
from tesserae.sources.store import Store


def newest_first(memories: DataFrame) -> DataFrame:
    return memories.orderBy(F.desc("created_at"), "id")


def working(memories: DataFrame) -> DataFrame:
    return memories.filter(~F.col("consolidated"))


def consolidated(memories: DataFrame) -> DataFrame:
    return memories.filter("consolidated")


def by_id(memories: DataFrame, id: str) -> DataFrame:
    return memories.filter(F.col("id") == id)


class Ambiguous(ValueError):
    """More memories than one have this prefix."""


def by_prefix(memories: DataFrame, prefix: str) -> DataFrame:
    """The memory of this id, or the only one whose id starts so; raises Ambiguous if there are more."""
    if len(prefix) >= 64:
        return by_id(memories, prefix)
    found = memories.filter(F.startswith("id", F.lit(prefix)))
    two = [r["id"] for r in found.select("id").limit(2).collect()]
    if prefix not in two and len(two) > 1:
        raise Ambiguous(f"more than one memory has an id that starts with {prefix}")
    return by_id(memories, two[0]) if two else found.limit(0)


def by_ids(memories: DataFrame, ids: DataFrame, column: str = "id") -> DataFrame:
    """The memories whose id is in a table of ids."""
    return memories.join(ids.select(F.col(column).alias("id")), "id", "left_semi")


def usable_embeddings(embeddings: DataFrame) -> DataFrame:
    from tesserae.functions.vectors import usable

    return embeddings.filter(usable(F.col("embedding")))


def strengths(memories: DataFrame) -> DataFrame:
    return memories.select("id", "strength")


def exposures_of_turn(exposures: DataFrame, session_id: str, turn_id: str) -> DataFrame:
    return exposures.filter((F.col("session_id") == session_id) & (F.col("turn_id") == turn_id))


def exposures_of_memory(exposures: DataFrame, id: str) -> DataFrame:
    return exposures.filter(F.col("memory_id") == id).orderBy("created_at", "turn_id", "mode")


def unreinforced(attributions: DataFrame) -> DataFrame:
    return attributions.filter(~F.coalesce("reinforcement_applied", F.lit(False)))


def latest_attributions(attributions: DataFrame) -> DataFrame:
    """The newest attribution of each memory; of equally new ones the greatest message_id."""
    rest = [c for c in attributions.columns if c != "memory_id"]
    newest = F.max_by(F.struct(*rest), F.struct("created_at", "message_id")).alias("r")
    return attributions.groupBy("memory_id").agg(newest).select("memory_id", "r.*")


def directed(associations: DataFrame) -> DataFrame:
    """(node, neighbour, weight, created_at, last_updated_at): each edge from either end."""
    ends = F.explode(F.array(F.struct(F.col("memory_a").alias("node"), F.col("memory_b").alias("neighbour")), F.struct(F.col("memory_b").alias("node"), F.col("memory_a").alias("neighbour"))))
    return associations.select(ends.alias("e"), "weight", "created_at", "last_updated_at").select("e.node", "e.neighbour", "weight", "created_at", "last_updated_at")


def associations_of(associations: DataFrame, ids: DataFrame, column: str = "id") -> DataFrame:
    """The directed edges that leave the given nodes."""
    return directed(associations).join(ids.select(F.col(column).alias("node")), "node", "left_semi")


def state_value(state: DataFrame, key: str) -> str | None:
    row = state.filter(F.col("key") == key).first()
    return row["value"] if row else None


def listing(memories: DataFrame, type: str | None = None, state: str | None = None, least: float = 0.0, limit: int = 50) -> DataFrame:
    """The newest memories of a type and state, of a strength of at least `least` if that is above 0; contents cut."""
    found = memories
    if type is not None:
        found = found.filter(F.col("type") == type)
    if state is not None:
        found = found.filter(F.col("temporal_state") == state)
    if least > 0:
        found = found.filter(F.col("strength") >= least)
    top = found.orderBy(F.desc("created_at"), "id").limit(limit)
    return top.select(F.substring("id", 1, 8).alias("id_short"), "id", "type", tx.shortened(F.col("content"), 100).alias("content"), F.round("strength", 3).alias("strength"), "temporal_state", "temporal_anchor", "created_at", "source", "consolidated")


def strongest(memories: DataFrame, limit: int) -> DataFrame:
    top = memories.filter(F.col("strength") > S.PRUNE_STRENGTH)
    return top.orderBy(F.desc("strength"), F.desc("created_at"), "id").limit(limit)


def upcoming(memories: DataFrame, start, end, limit: int | None = 10) -> DataFrame:
    """Future and present memories with an anchor from start to end, both included, the earliest first."""
    found = memories.filter(F.col("temporal_state").isin("future", "present") & F.col("temporal_anchor").between(start, end) & (F.col("strength") > S.PRUNE_STRENGTH))
    found = found.orderBy("temporal_anchor", "id")
    return found if limit is None else found.limit(limit)


def due(memories: DataFrame, now) -> DataFrame:
    """Memories that a transition is due for: future ones whose anchor is reached, present ones over a day past it."""
    from tesserae.functions.scoring import days_between

    age = days_between(F.col("temporal_anchor"), now)
    state = F.col("temporal_state")
    return memories.filter(((state == "future") & (age >= 0)) | ((state == "present") & (age > 1)))


def merge_sources(store: Store, least: float, since=None, limit: int = S.MERGE_SOURCES) -> DataFrame:
    """The strongest memories; after a first run, only those that were made or shown since."""
    found = store.memories.filter(F.col("strength") >= least)
    if since is not None:
        made = store.memories.filter(F.col("created_at") > since).select("id")
        shown = store.exposures.filter(F.col("created_at") > since).select(F.col("memory_id").alias("id"))
        found = found.join(made.union(shown).distinct(), "id", "left_semi")
    return found.orderBy(F.desc("strength"), "id").limit(limit)


def merge_targets(memories: DataFrame, least: float, limit: int = S.MERGE_TARGETS) -> DataFrame:
    return memories.filter(F.col("strength") >= least).orderBy(F.desc("strength"), "id").limit(limit)


def resolved_aliases(aliases: DataFrame, hops: int = 10) -> DataFrame:
    """(old_id, canonical): where each alias ends after `hops` steps at most; a cycle ends before it would repeat an id.

    Each round joins only the chains that are still open, and stops when none is.
    """
    steps = aliases.select(F.col("old_id").alias("step_from"), F.col("new_id").alias("step_to"))
    chains = aliases.select("old_id", F.col("new_id").alias("at"), F.array("old_id", "new_id").alias("seen"), F.lit(True).alias("open"))
    for _ in range(hops - 1):
        joined = chains.join(steps, F.col("open") & (F.col("at") == F.col("step_from")), "left")
        go = F.col("step_to").isNotNull() & ~F.array_contains("seen", F.col("step_to"))
        chains = joined.select("old_id", F.when(go, F.col("step_to")).otherwise(F.col("at")).alias("at"), F.when(go, F.array_append("seen", F.col("step_to"))).otherwise(F.col("seen")).alias("seen"), go.alias("open"))
    return chains.select("old_id", F.col("at").alias("canonical"))


def top_associations(associations: DataFrame, seeds: DataFrame, least: float = 0.15, most: int = 5) -> DataFrame:
    """(node, neighbour, weight): the heaviest edges of each seed (id), the newest first among equals."""
    edges = associations_of(associations.filter(F.col("weight") >= least), seeds)
    order = Window.partitionBy("node").orderBy(F.desc("weight"), F.desc(F.coalesce("last_updated_at", "created_at")), "neighbour")
    return edges.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= most).select("node", "neighbour", "weight")
