"""Questions about single memories and the whole store, as the command line asks them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tesserae.functions import text as tx
from tesserae.operators import scans
from tesserae.sources.store import Store


def inspected(store: Store, ids: DataFrame | None = None) -> DataFrame:
    """A row for each memory (of ids): itself, its edges, attributions and exposures as arrays, and its alias."""
    m = store.memories if ids is None else scans.by_ids(store.memories, ids)
    edges = scans.directed(store.associations).groupBy(F.col("node").alias("id")).agg(F.sort_array(F.collect_list(F.struct(F.col("neighbour"), F.col("weight")))).alias("associations"))
    given = store.attributions.groupBy(F.col("memory_id").alias("id")).agg(F.sort_array(F.collect_list(F.struct("created_at", "message_id", "evidence", "confidence"))).alias("attributions"))
    shown = store.exposures.groupBy(F.col("memory_id").alias("id")).agg(F.sort_array(F.collect_list(F.struct("created_at", "turn_id", "mode"))).alias("exposures"))
    alias = scans.resolved_aliases(store.aliases).select(F.col("old_id").alias("id"), F.col("canonical").alias("alias"))
    for more in (edges, given, shown, alias):
        m = m.join(more, "id", "left")
    return m


def history(store: Store, id: str) -> DataFrame:
    """(event, at, detail): how a memory was made, attributed and shown, in the order of time."""
    made = store.memories.filter(F.col("id") == id).select(F.lit("created").alias("event"), F.col("created_at").alias("at"), F.concat(F.lit("source="), "source", F.lit(", type="), "type").alias("detail"))
    given = store.attributions.filter(F.col("memory_id") == id).select(F.lit("attributed"), "created_at", F.concat("evidence", F.lit(" conf="), F.col("confidence").cast("string"), F.lit(" msg="), F.substring("message_id", 1, 20)))
    shown = store.exposures.filter(F.col("memory_id") == id).select(F.lit("exposed"), "created_at", F.concat("mode", F.lit(" turn="), F.substring("turn_id", 1, 20)))
    order = F.when(F.col("event") == "created", 0).when(F.col("event") == "attributed", 1).otherwise(2)
    return made.union(given).union(shown).orderBy("at", order, "detail")


def predecessors(store: Store, id: str) -> DataFrame:
    return store.aliases.filter(F.col("new_id") == id).select("old_id").orderBy("old_id")


def graph_nodes(memories: DataFrame) -> DataFrame:
    return memories.select("id", F.substring("id", 1, 8).alias("id_short"), "type", "strength", "consolidated")


def graph_edges(store: Store) -> DataFrame:
    """(a, b, weight) of the edges with a living end, ids short and weights of 3 places."""
    live = store.memories.select("id")
    a = store.associations.join(live.withColumnRenamed("id", "memory_a"), "memory_a", "left_semi")
    b = store.associations.join(live.withColumnRenamed("id", "memory_a"), "memory_a", "left_anti").join(live.withColumnRenamed("id", "memory_b"), "memory_b", "left_semi")
    return a.unionByName(b).select(F.substring("memory_a", 1, 8).alias("a"), F.substring("memory_b", 1, 8).alias("b"), F.round("weight", 3).alias("weight"))


def dot(store: Store) -> DataFrame:
    """(part, line): the graph in DOT, a line a row; in the order of part and line it is a file."""
    label = tx.dot_label(tx.shortened(F.col("content"), 30))
    short = F.substring("id", 1, 8)
    node = F.concat(F.lit('  "'), short, F.lit('" [label="'), short, F.lit("\\n"), F.when(F.col("consolidated"), "C").otherwise("W"), F.lit(" str="), tx.two_places(F.col("strength")), F.lit("\\n"), label, F.lit('"];'))
    edge = F.concat(F.lit('  "'), "a", F.lit('" -- "'), "b", F.lit('" [label="'), tx.two_places(F.col("weight")), F.lit('"];'))
    nodes = store.memories.select(F.lit(1).alias("part"), node.alias("line"))
    edges = graph_edges(store).select(F.lit(2).alias("part"), edge.alias("line"))
    frame = store.spark.createDataFrame([(0, "graph associations {\n  node [shape=box, style=rounded];"), (3, "}")], "part int, line string")
    return frame.unionByName(nodes).unionByName(edges)


def evidence_counts(attributions: DataFrame) -> DataFrame:
    return attributions.groupBy("evidence").agg(F.count(F.lit(1)).alias("n"), F.avg("confidence").alias("mean_confidence"))


def log_counts(log: DataFrame) -> DataFrame:
    return log.groupBy("event").agg(F.count(F.lit(1)).alias("n"), F.sum(F.size("ids")).alias("ids"))

