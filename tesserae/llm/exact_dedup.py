"""Exact dedup against immutable snapshots: static binary-fuse filters screen digests, positives meet exact buckets.

A snapshot's distinct digests are spread over buckets by their leading bits, and each bucket gets its own 3-wise
binary-fuse filter of one byte a fingerprint: about 9 bits a digest, held as rows of a table and joined by bucket,
never broadcast, since filters grow with the snapshot. Incoming digests that no filter holds are new without
touching the snapshot. Positives (duplicates, and 1 in 256 others) join the snapshot's buckets on the digest, and
only for those do texts move, to be compared byte by byte. Duplicates inside the new batch are grouped apart.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tesserae.llm import text as tx
from tesserae.session import written

#: Digests that a bucket's filter is meant for; the number of buckets follows the snapshot's size.
BUCKET_DIGESTS = 50_000
FILTER = "bucket int, seed long, segment int, segments int, prints binary"


def _spots(keys: np.ndarray, seed: int, segment: int, segments: int) -> tuple[np.ndarray, np.ndarray]:
    """Three slots of each key in consecutive segments, and its fingerprint of one byte."""
    h = tx.mixed(keys + np.uint64(seed) * np.uint64(tx.BASE))
    first = ((h >> np.uint64(32)) * np.uint64(segments)) >> np.uint64(32)
    mask = np.uint64(segment - 1)
    base = first * np.uint64(segment)
    spots = np.stack([base + (h & mask), base + np.uint64(segment) + ((h >> np.uint64(18)) & mask), base + np.uint64(2 * segment) + ((tx.mixed(h) >> np.uint64(20)) & mask)])
    return spots.astype(np.int64), (tx.mixed(h ^ np.uint64(0xA5A5)) >> np.uint64(56)).astype(np.uint8)


def build_filter(keys: np.ndarray) -> tuple[int, int, int, np.ndarray]:
    """(seed, segment length, segments, fingerprints) of a binary-fuse filter that holds all of the 64-bit keys.

    Peels whole layers at a time: slots that one key alone still uses give up that key, and the layers are then
    filled in reverse. A seed that leaves keys unpeeled is followed by the next.
    """
    keys = np.unique(np.asarray(keys, np.uint64))
    n = len(keys)
    segment = 1 << max(2, int(np.floor(np.log(max(n, 2)) / np.log(3.33) + 2.25)))
    size = int(n * max(1.125, 0.875 + 0.25 * np.log(1e6) / np.log(max(n, 3)))) + 1
    segments = max(1, -(-size // segment) - 2)
    for seed in range(1, 1000):
        if seed % 20 == 0:
            segments += 1 + segments // 10
        spots, prints = _spots(keys, seed, segment, segments)
        slots = segment * (segments + 2)
        count = np.bincount(spots.ravel(), minlength=slots)
        which = np.zeros(slots, np.uint64)
        index = np.arange(n, dtype=np.uint64)
        for row in spots:
            np.bitwise_xor.at(which, row, index)
        layers, left = [], n
        while left:
            alone = np.flatnonzero(count == 1)
            if not len(alone):
                break
            key, pick = np.unique(which[alone].astype(np.int64), return_index=True)
            layers.append((key, alone[pick]))
            for row in spots:
                np.subtract.at(count, row[key], 1)
                np.bitwise_xor.at(which, row[key], key.astype(np.uint64))
            left -= len(key)
        if not left:
            table = np.zeros(slots, np.uint8)
            for key, slot in reversed(layers):
                # a layer's own slots are read as 0: no slot of it serves another key of the layer
                table[slot] = prints[key] ^ table[spots[0][key]] ^ table[spots[1][key]] ^ table[spots[2][key]]
            return seed, segment, segments, table
    raise RuntimeError("no seed peels these keys")


def in_filter(keys: np.ndarray, seed: int, segment: int, segments: int, table: np.ndarray) -> np.ndarray:
    """Whether each key may be in the filter; a key that was built in always is."""
    (a, b, c), prints = _spots(np.asarray(keys, np.uint64), seed, segment, segments)
    return (table[a] ^ table[b] ^ table[c]) == prints


def digests(docs: DataFrame) -> DataFrame:
    """(id, d1, d2): 128 bits of each text that isn't null."""
    return docs.filter("text is not null").select(
        F.col("doc_id").alias("id"), F.xxhash64("text").alias("d1"), F.xxhash64(F.lit("second"), "text", F.octet_length("text")).alias("d2")
    )


def bucketed(d: DataFrame, buckets: int) -> DataFrame:
    return d.withColumn("bucket", F.pmod(F.col("d1"), F.lit(buckets)).cast("int"))


def filters_of(snapshot: DataFrame) -> DataFrame:
    """One filter for each bucket of a snapshot's digests (bucket, d1)."""

    def build(t: pa.Table) -> pa.Table:
        seed, segment, segments, table = build_filter(t.column("d1").to_numpy().view(np.uint64))
        return pa.table([[t.column("bucket")[0].as_py()], [seed], [segment], [segments], [table.tobytes()]], pa.schema([("bucket", pa.int32()), ("seed", pa.int64()), ("segment", pa.int32()), ("segments", pa.int32()), ("prints", pa.binary())]))

    return snapshot.select("bucket", "d1").distinct().groupBy("bucket").applyInArrow(build, FILTER)


def screened(incoming: DataFrame, filters: DataFrame) -> DataFrame:
    """The incoming digests (bucket, id, d1, d2) that the filter of their bucket doesn't rule out."""

    def screen(left: pa.Table, right: pa.Table) -> pa.Table:
        if not len(right) or not len(left):
            return left.slice(0, 0)
        f = right.slice(0, 1).to_pylist()[0]
        hit = in_filter(left.column("d1").to_numpy().view(np.uint64), f["seed"], f["segment"], f["segments"], np.frombuffer(f["prints"], np.uint8))
        return left.filter(pa.array(hit))

    return incoming.groupBy("bucket").cogroup(filters.groupBy("bucket")).applyInArrow(screen, incoming.schema)


def first_of(d: DataFrame) -> DataFrame:
    """(d1, d2, first, n) of digests: the smallest id and the number of each."""
    return d.groupBy("d1", "d2").agg(F.min("id").alias("first"), F.count(F.lit(1)).alias("n"))


def exact_duplicates(snapshot: DataFrame, incoming: DataFrame) -> DataFrame:
    """(doc_id, keeper_id) of every document whose text, byte for byte, is that of a document before it.

    The snapshot comes before the incoming batch, and inside either the smaller doc_id comes first; keeper_id is the
    first document of the text. Null texts and null ids equal nothing; empty texts equal each other. Of rows that
    repeat a doc_id the smallest text counts. Either table may be empty. Other columns are not read.
    """
    texts = [tx.unique_documents(t.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))) for t in (snapshot, incoming)]
    old, new = (written(digests(t), "digests") for t in texts)
    buckets = max(1, -(-old.count() // BUCKET_DIGESTS))
    old, new = bucketed(old, buckets), bucketed(new, buckets)
    filters = written(filters_of(old), "fuse-filters")
    known = first_of(old)
    fresh = first_of(new)
    # exact buckets of the snapshot, for positives alone
    hits = screened(new, filters).join(known.select("d1", "d2", "first"), ["d1", "d2"]).select("id", "first")
    within_old = old.join(known.filter("n > 1"), ["d1", "d2"]).filter("id <> first").select("id", "first")
    within_new = new.join(fresh.filter("n > 1"), ["d1", "d2"]).filter("id <> first").select("id", "first")
    pairs = within_old.withColumn("old", F.lit(True)).withColumn("first_old", F.lit(True))
    pairs = pairs.unionByName(hits.withColumn("old", F.lit(False)).withColumn("first_old", F.lit(True)))
    pairs = pairs.unionByName(within_new.withColumn("old", F.lit(False)).withColumn("first_old", F.lit(False)))
    return _same_bytes(written(pairs, "digest-pairs"), *texts)


def _same_bytes(pairs: DataFrame, old: DataFrame, new: DataFrame) -> DataFrame:
    """The pairs whose texts are equal; texts are read for the documents of a pair only.

    A text is compared with its first document through a grouping of both on the digest's pair, by the text itself.
    """
    every = old.select("doc_id", "text", F.lit(True).alias("is_old")).unionByName(new.select("doc_id", "text", F.lit(False).alias("is_old")))
    later = pairs.join(every, (F.col("id") == F.col("doc_id")) & (F.col("old") == F.col("is_old"))).select("id", "old", "first", "first_old", F.col("text").alias("mine"))
    first = every.select(F.col("doc_id").alias("fid"), F.col("is_old").alias("fold"), F.col("text").alias("theirs"))
    same = later.join(first, (F.col("first") == F.col("fid")) & (F.col("first_old") == F.col("fold"))).filter("mine = theirs")
    # a document of the batch that both the snapshot and its batch hold keeps the snapshot's
    return same.groupBy(F.col("id").alias("doc_id"), "old").agg(F.min_by("first", F.struct(~F.col("first_old"), F.col("first"))).alias("keeper_id")).select("doc_id", "keeper_id")


def halves(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """docs as an older snapshot and a new batch, cut at the middle of the range of doc_id."""
    r = docs.agg(F.min("doc_id").alias("a"), F.max("doc_id").alias("b")).first()
    middle = 0 if r["a"] is None else (int(r["a"]) + int(r["b"])) // 2
    return docs.filter(F.col("doc_id") <= middle), docs.filter(F.col("doc_id") > middle)


def keep_first(docs: DataFrame) -> DataFrame:
    """docs with one document of each text, that of the smallest doc_id; null texts stay, rows of null doc_id go."""
    docs = tx.unique_documents(docs)
    return tx.without_ids(docs, exact_duplicates(*halves(docs)).select("doc_id"))
