"""Pairs of like memories, and which of them to merge."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tesserae import schema as S
from tesserae.functions import scoring, vectors
from tesserae.functions import text as tx
from tesserae.functions.columns import once


def prepared(memories: DataFrame, embeddings: DataFrame) -> DataFrame:
    """(id, type, features, embedding): what a comparison needs, worked out once a memory."""
    words = once(memories, "id", "type", words=tx.words(F.col("content")))
    light = once(words, "id", "type", features=tx.features_of(F.col("words")))
    return light.join(embeddings.select("id", "embedding"), "id", "left")


def _compared(pairs: DataFrame) -> DataFrame:
    a, b = F.col("a.embedding"), F.col("b.embedding")
    both = (F.size(a) > 0) & (F.size(b) > 0) & (F.size(a) == F.size(b))
    alike = F.when(both, F.greatest(F.lit(0.0), vectors.cosine(a, b)))
    rows = pairs.select(F.col("a.id").alias("i"), F.col("b.id").alias("j"), tx.jaccard(F.col("a.features"), F.col("b.features")).alias("jaccard"), alike.alias("cosine"))
    score, threshold = scoring.merge_score(F.col("jaccard"), F.col("cosine"))
    rows = rows.withColumn("score", score).filter(F.col("score") >= threshold)
    return rows.select(F.least("i", "j").alias("a"), F.greatest("i", "j").alias("b"), "jaccard", "cosine", "score")


def _best(rows: DataFrame, most: int | None) -> DataFrame:
    rows = rows.orderBy(F.desc(F.round("score", 12)), "a", "b")
    return rows if most is None else rows.limit(most)


def merge_candidates(memories: DataFrame, most: int | None = S.MERGE_PAIRS) -> DataFrame:
    """(a, b, jaccard, cosine, score): the most alike pairs of one type among prepared memories."""
    pairs = memories.alias("a").join(memories.alias("b"), (F.col("a.type") == F.col("b.type")) & (F.col("a.id") < F.col("b.id")))
    return _best(_compared(pairs), most)


def merge_candidates_between(sources: DataFrame, targets: DataFrame, most: int | None = S.MERGE_PAIRS) -> DataFrame:
    """The same for pairs of a source and a target; a pair that is both ways round counts once."""
    pairs = targets.alias("a").join(sources.alias("b"), (F.col("a.type") == F.col("b.type")) & (F.col("a.id") != F.col("b.id")))
    return _best(_compared(pairs).dropDuplicates(["a", "b"]), most)


def near_duplicate_pairs(texts: DataFrame, parts: int | None = None) -> DataFrame:
    """(doc_id, other_id), the smaller first: the pairs of texts (doc_id, c), normalized, that are near duplicates.

    In order, what starts with a text comes right behind it. So each part of the order is walked with the texts that the
    current one starts with at hand, and the work is that of sorting and of the pairs found, however many texts begin alike.
    Sampled texts cut the order into parts; a text goes to each later part too whose first text may start with it.
    """
    spark = texts.sparkSession
    parts = parts or int(spark.conf.get("spark.sql.shuffle.partitions"))
    sample = texts.select(F.substring("c", 1, 1000).alias("c"), F.xxhash64("doc_id").alias("h")).orderBy("h").limit(10 * parts)
    cuts = F.lit(sorted({r["c"] for r in sample.collect()}, key=str.encode)[5::10]).cast("array<string>")
    rows = once(texts, "doc_id", c=F.col("c"))
    rows = once(rows, "doc_id", "c", own=F.size(F.filter(cuts, lambda s: s <= F.col("c"))), more=F.when(F.length("c") >= tx.LONG, F.size(F.filter(cuts, lambda s: (s > F.col("c")) & F.startswith(s, F.col("c"))))).otherwise(0))
    rows = rows.select("doc_id", "c", "own", F.explode(F.sequence("own", F.col("own") + F.col("more"))).alias("part"))
    rows = rows.select("part", (F.col("part") == F.col("own")).alias("own"), "doc_id", "c").repartition("part").sortWithinPartitions("part", "c", "doc_id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, begins = None, []  # the texts, with their ids, that the current one starts with, the shortest first
        out: tuple[list[int], list[int]] = ([], [])
        for batch in batches:
            for p, own, i, c in zip(*(batch.column(k).to_pylist() for k in range(4)), strict=True):
                if p != part:
                    part, begins = p, []
                while begins and not c.startswith(begins[-1][0]):
                    begins.pop()
                for text, ids in begins if own else ():
                    if len(text) >= tx.LONG or text == c:
                        for j in ids:
                            if i != j:
                                out[0].append(min(i, j))
                                out[1].append(max(i, j))
                        if len(out[0]) >= 1 << 16:
                            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in out], ["doc_id", "other_id"])
                            out = ([], [])
                if begins and begins[-1][0] == c:
                    begins[-1][1].append(i)
                else:
                    begins.append((c, [i]))
        yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in out], ["doc_id", "other_id"])

    return rows.mapInArrow(run, "doc_id long, other_id long")


def disjoint(pairs: list[tuple[str, str]]) -> list[tuple[str, str]]:
    """The pairs, in order, of which no earlier one took an end."""
    used: set[str] = set()
    out = []
    for a, b in pairs:
        if a != b and a not in used and b not in used:
            out.append((a, b))
            used |= {a, b}
    return out
