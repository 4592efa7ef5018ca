"""Merges: pairs of memories become one, which inherits their edges."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field
from hashlib import sha256

from pyspark.sql import Column
from pyspark.sql import functions as F

from tesserae import schema as S
from tesserae.operators import dml, graph
from tesserae.operators.similarity import disjoint
from tesserae.sources.store import Store, conformed

#: (a, b) with id, content and type each, to the content and type of both together.
Producer = Callable[[dict, dict], tuple[str, str]]


def longest(a: dict, b: dict) -> tuple[str, str]:
    """The longer content with its type; of equally long ones that of the smaller id."""
    one = min((a, b), key=lambda m: (-len(m["content"]), m["id"]))
    return one["content"], one["type"]


@dataclass(frozen=True)
class Merged:
    new_id: str
    merged_from: tuple[str, str]
    outcome: str
    weakened: list[str] = field(default_factory=list)
    deleted: list[str] = field(default_factory=list)


def merged(store: Store, pairs: list[tuple[str, str]], produce: Producer = longest, now: Column | None = None, embed: Callable[[str], list[float] | None] | None = None) -> tuple[Store, list[Merged]]:
    """The store after the merges of disjoint pairs, in order, and what became of each.

    pairs are a few (the candidates' bound), so their memories and new contents pass the driver; edges and tables never
    do; edges among the merged memories, which are few as well, are handed on merge by merge. Only weakened sources
    hand edges on: deleted ones have lost theirs by then. A content that is a source's own absorbs the other; one that is there already is used again; else it is new,
    consolidated and of strength 1. Sources that merges made are deleted and get an alias, others are weakened. A pair
    that isn't there any more, as one that an earlier merge took, is passed over.
    """
    now = F.current_timestamp() if now is None else now
    spark = store.spark
    pairs = disjoint(pairs)
    ids = sorted({x for p in pairs for x in p})
    if not ids:
        return store, []
    wanted = spark.createDataFrame([(i,) for i in ids], "id string")
    known = {r["id"]: r.asDict() for r in store.memories.join(F.broadcast(wanted), "id", "left_semi").collect()}
    made = {}
    for a, b in pairs:
        if a in known and b in known:
            content, kind = produce(known[a], known[b])
            made[a, b] = (sha256(content.encode()).hexdigest(), content, kind)
    if not made:
        return store, []
    targets = spark.createDataFrame([(x[0],) for x in made.values()], "id string").distinct()
    there = {r["id"] for r in store.memories.join(F.broadcast(targets), "id", "left_semi").select("id").collect()}
    strength: dict[str, float] = {i: m["strength"] for i, m in known.items()}
    out, new, gone, used, aliases = [], {}, [], set(), []
    for (a, b), (to, content, kind) in made.items():
        if {a, b} & (used | set(gone)):
            continue
        outcome = "absorption" if to in (a, b) else "reuse" if to in there or to in new else "new"
        if outcome == "new":
            new[to] = (content, kind)
        strength[to] = 1.0
        weak, dead = [], []
        for x in (a, b):
            if x != to:
                (dead if known[x]["source"] == "consolidation" else weak).append(x)
        strength |= {x: max(0.0, strength[x] * S.WEAKENED) for x in weak}
        gone += dead
        aliases += [(x, to) for x in dead]
        used |= {a, b, to}
        out.append(Merged(to, (a, b), outcome, weak, dead))
    taken = spark.createDataFrame([(x,) for x in sorted({x for m in out for x in (*m.merged_from, m.new_id)})], "id string")
    ends = [F.broadcast(taken.select(F.col("id").alias(c))) for c in ("memory_a", "memory_b")]
    inner = store.associations.join(ends[0], "memory_a", "left_semi").join(ends[1], "memory_b", "left_semi")
    weights = {(r["memory_a"], r["memory_b"]): r["weight"] for r in inner.collect()}
    changed = graph.inherited_in_order(weights, [(m.new_id, m.weakened, m.deleted) for m in out])
    sources = spark.createDataFrame([(x, m.new_id) for m in out for x in m.weakened], "node string, canonical string")
    inherited = graph.inherited(store.associations, sources, taken)
    inherited = inherited.unionByName(spark.createDataFrame([(*k, w) for k, w in changed.items()], "memory_a string, memory_b string, weight double"))
    changes = spark.createDataFrame(sorted(strength.items()), "id string, new double")
    memories = dml.updated(store.memories, F.broadcast(changes), strength="new")
    if new:
        rows = spark.createDataFrame([(i, k, c) for i, (c, k) in new.items()], "id string, type string, content string")
        rows = rows.withColumns({"temporal_state": F.lit("none"), "created_at": now, "strength": F.lit(1.0), "source": F.lit("consolidation"), "consolidated": F.lit(True)})
        memories = memories.unionByName(conformed(rows, "memories"))
        if embed is not None:
            found = [(i, embed(c)) for i, (c, _) in new.items()]
            vectors = spark.createDataFrame([(i, [float(x) for x in v]) for i, v in found if v is not None], S.struct("embeddings"))
            store = store.with_(embeddings=dml.upserted(store.embeddings, vectors, ["id"]))
    store = store.with_(memories=memories, associations=dml.edges_set(store.associations, inherited, now))
    if gone:
        store = dml.deleted(store, F.broadcast(spark.createDataFrame([(x,) for x in gone], "id string")))
        more = spark.createDataFrame([(*x, "merged") for x in aliases], "old_id string, new_id string, reason string").withColumn("created_at", now.cast("timestamp"))
        store = store.with_(aliases=dml.upserted(store.aliases, more, ["old_id"]))
    return store, out
