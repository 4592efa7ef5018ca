"""The graph of associations: what is seen together, and what hangs together over a third."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tesserae import schema as S
from tesserae.functions.scoring import either
from tesserae.operators import scans
from tesserae.operators.dml import edges_joined, edges_set


def co_retrievals(exposures: DataFrame, since: Column | None = None) -> DataFrame:
    """(turn_id, memory_id, modes): the memories of each turn that shows two or more, with their sorted modes."""
    rows = exposures if since is None else exposures.filter(F.col("created_at") > since)
    modes = rows.groupBy("turn_id", "memory_id").agg(F.array_sort(F.collect_set("mode")).alias("modes"))
    n = F.count(F.lit(1)).over(Window.partitionBy("turn_id"))
    return modes.withColumn("n", n).filter("n >= 2").drop("n")


def co_retrieved(exposures: DataFrame, memories: DataFrame, since: Column | None = None) -> DataFrame:
    """(turn_id, memory_a, memory_b, cross, weight): the pairs of living memories that a turn shows."""
    live = co_retrievals(exposures.join(memories.select(F.col("id").alias("memory_id")), "memory_id", "left_semi"), since)
    # all members of a turn in one row: the pairs need no join of the table with itself
    turns = live.groupBy("turn_id").agg(F.array_sort(F.collect_list(F.struct("memory_id", "modes"))).alias("m"))
    pairs = turns.select("turn_id", F.posexplode("m").alias("i", "a"), "m").select("turn_id", "a", F.explode(F.slice("m", F.col("i") + 2, F.size("m"))).alias("b"))
    cross = F.col("a.modes") != F.col("b.modes")
    return pairs.select("turn_id", F.col("a.memory_id").alias("memory_a"), F.col("b.memory_id").alias("memory_b"), cross.alias("cross"), F.when(cross, S.CROSS_CHANNEL).otherwise(S.SAME_CHANNEL).alias("weight"))


def with_co_retrievals(edges: DataFrame, exposures: DataFrame, memories: DataFrame, now: Column, since: Column | None = None) -> DataFrame:
    return edges_joined(edges, co_retrieved(exposures, memories, since).select("memory_a", "memory_b", "weight"), now)


def transitive(edges: DataFrame, most: int = S.TRANSITIVE_UPDATES, least: float = S.LEAST_TRANSITIVE) -> DataFrame:
    """(memory_a, memory_b, weight): new weights of the pairs that paths of two edges join, the largest gains first.

    All paths are of the given edges; those of one pair count as independent chances. An edge of a weight under `least`
    is on no path that counts, so it is left out before the join.
    """
    strong = scans.directed(edges.filter(F.col("weight") >= least)).select("node", "neighbour", "weight")
    # neighbours of a node in one row would be large at hubs, so this is a join; AQE splits hot nodes
    other = strong.select("node", F.col("neighbour").alias("memory_b"), F.col("weight").alias("w2"))
    paths = strong.join(other, "node").filter((F.col("neighbour") < F.col("memory_b")) & (F.col("weight") * F.col("w2") >= least))
    gains = paths.groupBy(F.col("neighbour").alias("memory_a"), "memory_b").agg(either(F.col("weight") * F.col("w2")).alias("gain"))
    now = gains.join(edges.select("memory_a", "memory_b", "weight"), ["memory_a", "memory_b"], "left")
    was = F.coalesce("weight", F.lit(0.0))
    delta = F.col("gain") - was * F.col("gain")
    rows = now.select("memory_a", "memory_b", (was + delta).alias("weight"), F.round(delta, 12).alias("delta")).filter("delta >= 1e-9")
    return rows.orderBy(F.desc("delta"), "memory_a", "memory_b").limit(most).select("memory_a", "memory_b", "weight")


def transitive_in_order(memories: DataFrame, edges: DataFrame, most: int = S.TRANSITIVE_UPDATES, least: float = S.LEAST_TRANSITIVE) -> DataFrame:
    """The same as a walk over the memories, the newest first, whose later steps see what the earlier ones wrote.

    Bounded by `most` updates but not in its reading: the edges come to the driver, so this is for small stores.
    """
    graph: dict[str, dict[str, float]] = {}
    for r in edges.select("memory_a", "memory_b", "weight").collect():
        graph.setdefault(r[0], {})[r[1]] = r[2]
        graph.setdefault(r[1], {})[r[0]] = r[2]
    changed: dict[tuple[str, str], float] = {}
    n = 0
    for r in scans.newest_first(memories.select("id", "created_at")).collect():
        near = sorted(graph.get(r["id"], {}).items())
        for i, (a, wa) in enumerate(near):
            for b, wb in near[i + 1 :]:
                if n >= most:
                    break
                was = graph.get(a, {}).get(b, 0.0)
                new = was + wa * wb - was * wa * wb
                if wa * wb < least or new - was < 1e-9:
                    continue
                graph.setdefault(a, {})[b] = graph.setdefault(b, {})[a] = changed[a, b] = new
                n += 1
    return memories.sparkSession.createDataFrame([(*k, w) for k, w in changed.items()], "memory_a string, memory_b string, weight double")


def with_transitive(edges: DataFrame, now: Column, most: int = S.TRANSITIVE_UPDATES) -> DataFrame:
    return edges_set(edges, transitive(edges, most), now)


def inherited(edges: DataFrame, sources: DataFrame, taken: DataFrame) -> DataFrame:
    """(memory_a, memory_b, weight): edges that merged memories hand on to neighbours that no merge takes part in.

    sources: (node, canonical), a few rows; taken: (id) of all memories of the merges. The weights of all sources of a
    canonical memory, and of the edge that it has itself, count as independent chances.
    """
    handed = scans.directed(edges).select("node", "neighbour", "weight").join(F.broadcast(sources), "node")
    handed = handed.join(F.broadcast(taken.select(F.col("id").alias("neighbour"))), "neighbour", "left_anti")
    new = handed.groupBy("canonical", "neighbour").agg(either(F.col("weight")).alias("w"))
    new = new.select(F.least("canonical", "neighbour").alias("memory_a"), F.greatest("canonical", "neighbour").alias("memory_b"), "w")
    out = new.join(edges.select("memory_a", "memory_b", "weight"), ["memory_a", "memory_b"], "left")
    was = F.coalesce("weight", F.lit(0.0))
    return out.select("memory_a", "memory_b", (was + F.col("w") - was * F.col("w")).alias("weight"))


def inherited_in_order(weights: dict[tuple[str, str], float], merges: list[tuple[str, list[str], list[str]]]) -> dict[tuple[str, str], float]:
    """New weights of the edges between memories of merges (canonical, weakened, deleted), one merge after another.

    weights has the edges between these memories alone. The deleted ones lose their edges before any are handed on.
    """
    now, changed = dict(weights), {}
    for to, weak, dead in merges:
        now = {k: w for k, w in now.items() if not set(k) & set(dead)}
        own = {to, *weak, *dead}
        sums: dict[str, float] = {}
        for x in weak:
            for k, w in now.items():
                if x in k and (y := k[0] if k[1] == x else k[1]) not in own:
                    sums[y] = sums.get(y, 0.0) + w - sums.get(y, 0.0) * w
        for y, w in sums.items():
            k = (min(to, y), max(to, y))
            now[k] = changed[k] = now.get(k, 0.0) + w - now.get(k, 0.0) * w
    return changed
