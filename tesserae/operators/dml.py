"""Changes of the store, set-wise: each takes tables and returns what they are afterwards."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tesserae import schema as S
from tesserae.session import written
from tesserae.sources.store import Store, conformed


def first_of(df: DataFrame, keys: list[str], order: list) -> DataFrame:
    """The first row of each key."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("__row", F.row_number().over(w)).filter("__row = 1").drop("__row")


def stored(store: Store, new: DataFrame, now) -> Store:
    """Inserts by content: new (content, type, source, and optionally temporal_state, temporal_anchor, created_at, strength, embedding).

    What the store holds stays as it is; of new rows of one content the first by created_at, then by type, goes in, with
    strength 1 and the state none if it has neither. Embeddings come along where they are usable.
    """
    from tesserae.functions.vectors import usable

    have = set(new.columns)
    col = lambda name, default: F.coalesce(F.col(name), default) if name in have else default
    rows = new.filter("content is not null").select(
        S.content_id(F.col("content")).alias("id"),
        "type",
        "content",
        col("temporal_state", F.lit("none")).alias("temporal_state"),
        (F.col("temporal_anchor") if "temporal_anchor" in have else F.lit(None)).cast("timestamp").alias("temporal_anchor"),
        col("created_at", now).cast("timestamp").alias("created_at"),
        col("strength", F.lit(1.0)).cast("double").alias("strength"),
        "source",
        F.lit(False).alias("consolidated"),
        *([F.col("embedding")] if "embedding" in have else []),
    )
    rows = first_of(rows, ["id"], ["created_at", "type", "source"])
    fresh = rows.join(store.memories.select("id"), "id", "left_anti")
    memories = store.memories.unionByName(conformed(fresh, "memories"))
    if "embedding" not in have:
        return store.with_(memories=memories)
    vectors = fresh.filter(usable(F.col("embedding"))).select("id", F.col("embedding").cast("array<float>").alias("embedding"))
    return store.with_(memories=memories, embeddings=upserted(store.embeddings, vectors, ["id"]))


def upserted(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """old with the rows of new in place of those of equal keys; new has each key once."""
    return old.join(new.select(*keys), keys, "left_anti").unionByName(new)


def inserted_or_ignored(old: DataFrame, new: DataFrame, keys: list[str], order: list) -> DataFrame:
    """old and those rows of new whose keys it lacks, of equal keys the first by order."""
    first = first_of(new, keys, order).select(*old.columns)
    return old.unionByName(first.join(old.select(*keys), keys, "left_anti").select(*old.columns))


def updated(memories: DataFrame, changes: DataFrame, **columns: str) -> DataFrame:
    """memories with columns set from columns of changes (id, ...) where those aren't null; changes has each id once."""
    marked = changes.select("id", *(F.col(source).alias(f"__{target}") for target, source in columns.items()))
    out = memories.join(marked, "id", "left")
    return out.select(*(F.coalesce(F.col(f"__{c}"), F.col(c)).alias(c) if c in columns else F.col(c) for c in memories.columns))


def deleted(store: Store, ids: DataFrame) -> Store:
    """The store without memories (id), their vectors, edges and exposures; attributions stay."""
    ids = ids.select("id").distinct()
    gone = lambda df, key: df.join(ids.withColumnRenamed("id", key), key, "left_anti").select(*df.columns)
    return store.with_(
        memories=gone(store.memories, "id"),
        embeddings=gone(store.embeddings, "id"),
        associations=gone(gone(store.associations, "memory_a"), "memory_b"),
        exposures=gone(store.exposures, "memory_id"),
    )


def edges_set(edges: DataFrame, new: DataFrame, at: Column) -> DataFrame:
    """Edges with the weights of new (memory_a, memory_b, weight), in either order of ends; made edges keep created_at."""
    ends = new.select(F.least("memory_a", "memory_b").alias("memory_a"), F.greatest("memory_a", "memory_b").alias("memory_b"), F.col("weight").alias("w")).filter("memory_a <> memory_b")
    out = edges.join(ends, ["memory_a", "memory_b"], "full")
    was = F.col("created_at").isNotNull()
    return out.select("memory_a", "memory_b", F.coalesce("w", "weight").alias("weight"), F.coalesce("created_at", at).alias("created_at"), F.when(F.col("w").isNotNull() & was, at).otherwise(F.col("last_updated_at")).alias("last_updated_at"))


def edges_joined(edges: DataFrame, deltas: DataFrame, at: Column) -> DataFrame:
    """Edges with all deltas (memory_a, memory_b, weight) added as independent chances; any number a pair."""
    from tesserae.functions.scoring import either

    ends = deltas.select(F.least("memory_a", "memory_b").alias("memory_a"), F.greatest("memory_a", "memory_b").alias("memory_b"), "weight").filter("memory_a <> memory_b")
    sums = ends.groupBy("memory_a", "memory_b").agg(either(F.col("weight")).alias("d"))
    out = edges.join(sums, ["memory_a", "memory_b"], "full")
    w, d = F.coalesce("weight", F.lit(0.0)), F.coalesce("d", F.lit(0.0))
    return out.select("memory_a", "memory_b", (w + d - w * d).alias("weight"), F.coalesce("created_at", at).alias("created_at"), F.when(F.col("d").isNotNull() & F.col("created_at").isNotNull(), at).otherwise(F.col("last_updated_at")).alias("last_updated_at"))


def strong_edges(edges: DataFrame, least: float = S.PRUNE_WEIGHT) -> DataFrame:
    return edges.filter(F.col("weight") >= least)


def recent_exposures(exposures: DataFrame, now, days: int = S.EXPOSURE_DAYS) -> DataFrame:
    """Exposures that aren't older than so many days."""
    return exposures.filter(F.col("created_at") >= now - F.make_dt_interval(F.lit(days)))


EXPOSURE_KEY = ["session_id", "turn_id", "memory_id", "mode"]
ATTRIBUTION_KEY = ["message_id", "memory_id"]


def merged_attributions(rows: DataFrame, order: str = "seq") -> DataFrame:
    """One attribution of each message and memory, as if rows had come one by one in order.

    Feedback beats what was only shown, whatever the confidences; of one kind the higher confidence wins and a tie
    changes nothing. turn_id is the first row's, created_at the least, updated_at the time of the last change, null
    if there was none; reinforcement_applied is the first row's.
    """
    explicit = F.startswith("evidence", F.lit("agent_feedback_"))
    rank = F.struct(explicit, "confidence", -F.col(order))
    changed = F.coalesce("updated_at", "created_at") if "updated_at" in rows.columns else F.col("created_at")
    own = F.col("updated_at") if "updated_at" in rows.columns else F.lit(None).cast("timestamp")
    applied = F.coalesce("reinforcement_applied", F.lit(False)) if "reinforcement_applied" in rows.columns else F.lit(False)
    best = F.max_by(F.struct("evidence", "confidence", F.col(order).alias("at"), changed.alias("changed")), rank).alias("best")
    first = F.min_by(F.struct("turn_id", F.col(order).alias("at"), own.alias("own"), applied.alias("applied")), order).alias("first")
    out = rows.groupBy(*ATTRIBUTION_KEY).agg(best, first, F.min("created_at").alias("created_at"))
    updated_at = F.when(F.col("best.at") == F.col("first.at"), F.col("first.own")).otherwise(F.col("best.changed"))
    return out.select(*ATTRIBUTION_KEY, "best.evidence", "best.confidence", "first.turn_id", "created_at", updated_at.alias("updated_at"), F.col("first.applied").alias("reinforcement_applied"))


def attributions_upserted(old: DataFrame, new: DataFrame, order: str = "seq") -> DataFrame:
    """old with new rows (and their order) merged in; keys that no new row has aren't touched."""
    touched = new.select(*ATTRIBUTION_KEY).distinct()
    have = set(new.columns)
    rows = new.select(*ATTRIBUTION_KEY, "evidence", "confidence", "turn_id", "created_at", (F.col("updated_at") if "updated_at" in have else F.lit(None)).cast("timestamp").alias("updated_at"), F.lit(False).alias("reinforcement_applied"), F.col(order).cast("long").alias("seq"))
    before = old.join(touched, ATTRIBUTION_KEY, "left_semi").withColumn("seq", F.lit(-(2**62)).cast("long"))
    rest = old.join(touched, ATTRIBUTION_KEY, "left_anti")
    merged = merged_attributions(before.select(*rows.columns).unionByName(rows))
    return rest.select(*old.columns).unionByName(merged.select(*old.columns))


def renamed(store: Store, changes: DataFrame) -> Store:
    """Gives memories new contents and ids: changes (old_id, new_content), each old_id once.

    Raises ValueError if a new id is there already. Exposures keep the first of equal keys; attributions merge by the
    policy; edges keep the greatest weight, the least created_at and the greatest last_updated_at, and lose loops.
    The ids alone are written to the shared folder, so contents are read once for them and again only for the memories.
    """
    ids = written(changes.select("old_id", S.content_id(F.col("new_content")).alias("new_id")), "renamed-ids")
    if not store.memories.select("id").join(ids, F.col("id") == F.col("new_id"), "left_semi").isEmpty():
        raise ValueError("a memory of the new content is there already")
    to = ids.select(F.col("old_id").alias("__old"), F.col("new_id").alias("__new"))

    def moved(df: DataFrame, key: str) -> DataFrame:
        out = df.join(to, F.col(key) == F.col("__old"), "left")
        return out.select(*(F.coalesce("__new", key).alias(c) if c == key else F.col(c) for c in df.columns), F.col("__new").isNotNull().alias("__moved"))

    m = store.memories.join(ids.withColumnRenamed("old_id", "id"), "id", "left").join(changes.select(F.col("old_id").alias("id"), "new_content"), "id", "left")
    memories = m.select(*(F.coalesce("new_id", "id").alias("id") if c == "id" else F.coalesce("new_content", "content").alias("content") if c == "content" else F.col(c) for c in store.memories.columns))
    exposures = first_of(moved(store.exposures, "memory_id"), EXPOSURE_KEY, ["__moved", "created_at"]).drop("__moved")
    a = moved(store.attributions, "memory_id")
    a = a.withColumn("seq", F.col("__moved").cast("long")).drop("__moved")
    attributions = merged_attributions(a).select(*store.attributions.columns)
    e = moved(moved(store.associations, "memory_a").drop("__moved"), "memory_b").filter("memory_a <> memory_b")
    e = e.groupBy(F.least("memory_a", "memory_b").alias("a"), F.greatest("memory_a", "memory_b").alias("b"))
    edges = e.agg(F.max("weight").alias("weight"), F.min("created_at").alias("created_at"), F.max("last_updated_at").alias("last_updated_at"))
    edges = edges.withColumnsRenamed({"a": "memory_a", "b": "memory_b"})
    return store.with_(memories=memories, embeddings=moved(store.embeddings, "id").drop("__moved"), exposures=exposures, attributions=attributions, associations=edges)


def state_set(state: DataFrame, **values: str) -> DataFrame:
    new = state.sparkSession.createDataFrame(list(values.items()), S.struct("state"))
    return upserted(state, new, ["key"])


def counts(store: Store) -> DataFrame:
    """One row: total, working, consolidated, associations, last_consolidation_at."""
    m = store.memories.agg(F.count(F.lit(1)).alias("total"), F.count_if(~F.col("consolidated")).alias("working"), F.count_if("consolidated").alias("consolidated"))
    e = store.associations.agg(F.count(F.lit(1)).alias("associations"))
    last = store.state.agg(F.max(F.when(F.col("key") == "last_consolidation_at", F.col("value"))).alias("last_consolidation_at"))
    return m.crossJoin(F.broadcast(e)).crossJoin(F.broadcast(last))
