"""Ranked search, recall along edges, and browsing.

Every step keeps what it sends small by construction: candidate pools, seeds and neighbours are bounded by the limit of
the query, so they are broadcast whatever the store's size, and contents are read for the final rows alone.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tesserae.functions import scoring, vectors
from tesserae.functions import text as tx
from tesserae.operators import lexical, scans
from tesserae.sources.store import Store

SEED, BOOST, LEAST_WEIGHT, LEAST_STRENGTH, PER_SEED = 0.3, 0.6, 0.15, 0.1, 5


def scored(store: Store, query: str, limit: int, now: Column, vector: list[float] | None, index: DataFrame | None = None) -> DataFrame:
    """(id, score): the best `limit` memories; vector None means by words alone."""
    light = store.memories.select("id", "strength", "created_at")
    pool = limit * (4 if vector is not None else 8)
    found = lexical.waterfall(lexical.index(store.memories) if index is None else index, query, pool)
    terms = tx.query_terms(query)
    if found is None:
        found = light.select("id", F.lit(None).cast("int").alias("pass"), F.lit(None).cast("double").alias("bm25")).limit(0)
    words = found.select("id", scoring.bm25_share(F.col("bm25")).alias("lexical"))
    if vector is None:
        rows = store.memories.select("id", "strength", "created_at", "content").join(F.broadcast(words), "id")
        score = F.col("lexical")
        if len(terms) > 1:
            score = score * F.pow(tx.coverage(terms, F.col("content")), F.lit(2.0))
        rows = rows.select("id", (score * scoring.recency(F.col("created_at"), now, 180.0) * F.col("strength")).alias("score"))
    else:
        alike = scans.usable_embeddings(store.embeddings).select("id", vectors.cosine(F.col("embedding"), vectors.literal(vector)).alias("alike"))
        rows = light.select("id", "strength").join(alike, "id", "left").join(F.broadcast(words), "id", "left")
        rows = rows.filter("alike is not null or lexical is not null")
        score = scoring.hybrid(F.coalesce("alike", F.lit(0.0)), F.coalesce("lexical", F.lit(0.0)), scoring.ALPHA)
        rows = rows.select("id", (score * F.col("strength")).alias("score"))
    return ranked(rows, limit)


def ranked(rows: DataFrame, limit: int) -> DataFrame:
    """The best `limit` of rows (id, score) as a local table, so that what uses it more than once doesn't search again."""
    top = rows.orderBy(F.desc("score"), "id").limit(limit).select("id", "score").collect()
    return rows.sparkSession.createDataFrame(top, "id string, score double")


def hydrated(store: Store, ranked: DataFrame) -> DataFrame:
    """The memories of (id, score), the best first; ranked is as small as its query's limit."""
    return store.memories.join(F.broadcast(ranked), "id").orderBy(F.desc("score"), "id")


def search(store: Store, query: str, limit: int = 5, now: Column | None = None, vector: list[float] | None = None, index: DataFrame | None = None) -> DataFrame:
    """The best memories for a query with their score; with a vector by words and meaning, without by words and age."""
    return hydrated(store, scored(store, query, limit, F.current_timestamp() if now is None else now, vector, index))


def expanded(store: Store, direct: DataFrame, limit: int) -> DataFrame:
    """(id, score, via): direct (id, score) and what their strong ones' edges lead to, the best `limit`; via: direct or edge."""
    direct = F.broadcast(direct)
    seeds = direct.filter(F.col("score") >= SEED)
    strong = seeds.select(F.col("id").alias("node"), F.col("score").alias("seed"))
    top = scans.top_associations(store.associations, seeds, LEAST_WEIGHT, PER_SEED).join(F.broadcast(strong), "node")
    top = top.join(direct.select(F.col("id").alias("neighbour")), "neighbour", "left_anti")
    found = top.groupBy(F.col("neighbour").alias("id")).agg(scoring.either(F.col("seed") * F.col("weight") * BOOST).alias("activation"))
    rows = store.memories.select("id", "strength").filter(F.col("strength") >= LEAST_STRENGTH).join(F.broadcast(found), "id")
    more = rows.select("id", (F.col("activation") * F.col("strength")).alias("score"), F.lit("edge").alias("via"))
    return direct.select("id", "score", F.lit("direct").alias("via")).unionByName(more).orderBy(F.desc("score"), "id").limit(limit)


def recall(store: Store, prompt: str, limit: int = 3, now: Column | None = None, vector: list[float] | None = None) -> DataFrame:
    """Search, and one step along the edges of what it finds."""
    return hydrated(store, expanded(store, scored(store, prompt, limit, F.current_timestamp() if now is None else now, vector), limit))


def selected(rows: list[tuple[str, str]], limit: int) -> list[int]:
    """Which of ranked (type, content), both normalized, are shown: first with a cap for each type, then without; never near duplicates."""
    cap, out, count = max(2, math.ceil(limit / 3)), [], {}
    for capped in (True, False):
        for i, (kind, content) in enumerate(rows):
            if len(out) >= limit:
                break
            if i in out or any(tx.near_duplicate(content, rows[j][1]) for j in out):
                continue
            if capped and count.get(kind, 0) >= cap:
                continue
            out.append(i)
            count[kind] = count.get(kind, 0) + 1
    return out


def browse(store: Store, limit: int = 50, now: Column | None = None) -> DataFrame:
    """(position, id, type, score): strong and recent memories, varied by type and without near duplicates.

    The pool has 200 rows at most, so the choice, which goes row by row, is one task.
    """
    if limit <= 0:
        return store.memories.select(F.lit(0).alias("position"), "id", "type", F.col("strength").alias("score")).limit(0)
    now = F.current_timestamp() if now is None else now
    pool = scans.strongest(store.memories, min(200, max(20, limit * 4)))
    # the reference's sort is stable: of equal scores the stronger and newer stays first
    rows = pool.select("id", "type", F.lower(F.trim("type")).alias("kind"), tx.normalized(F.col("content")).alias("content"), F.round(scoring.broad(F.col("strength"), F.col("created_at"), now), 12).alias("score"), "strength", "created_at")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        every = pd.concat(list(batches), ignore_index=True)
        every = every.sort_values(["score", "strength", "created_at", "id"], ascending=[False, False, False, True], kind="stable").reset_index(drop=True)
        take = selected(list(zip(every["kind"], every["content"], strict=True)), limit)
        out = every.loc[take, ["id", "type", "score"]].reset_index(drop=True)
        out.insert(0, "position", range(1, len(out) + 1))
        yield out

    return rows.coalesce(1).mapInPandas(run, "position int, id string, type string, score double")
