"""MinHash near-dedup: universal-hash minima, banding, checks of whole signatures, components by alternating stars.

Plan: one scan makes a signature for each document (Arrow, no row loop). Documents of equal signatures fold into
one node before anything is compared, so thousands of copies cost one node. Band keys are counted with map-side
combine; only keys that two nodes share bring back their nodes, and only those nodes' signatures move. A bucket of more than
BLOCK nodes is compared as pairs of blocks, so no task holds more than two of them. Inside a
bucket a breadth-first walk compares each reached node with the nodes not yet reached: the components are those of
all pairs, without forming pairs inside a component. Components then spread by large-star and small-star rounds,
each written to the shared folder.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tesserae.llm import text as tx
from tesserae.session import dropped, written

SHINGLE = 3
HASHES = 192
ROWS = 4
SIMILAR = 0.45
#: Nodes of one band that are compared in one go; larger buckets are split.
BLOCK = 4096


def coefficients(hashes: int, seed: int = 77) -> tuple[np.ndarray, np.ndarray]:
    """Odd multipliers and offsets of the universal hashes a*x + b modulo 2**32."""
    r = np.random.default_rng(seed)
    return r.integers(0, 2**31, hashes, dtype=np.uint32) * np.uint32(2) + np.uint32(1), r.integers(0, 2**32, hashes, dtype=np.uint32)


def signatures_of(texts: pa.Array, shingle: int, hashes: int) -> tuple[np.ndarray, np.ndarray]:
    """Indices of the texts that have a word, and their minima."""
    a, b = coefficients(hashes)
    found, rows = [], []
    for s in tx.slices(texts):
        grams, text = tx.ngrams(s.words(tx.MARKS, fold_case=True), shingle)
        if not len(grams):
            continue
        x = (grams >> np.uint64(32)).astype(np.uint32)
        first = np.flatnonzero(np.r_[True, text[1:] != text[:-1]])
        out = np.empty((len(first), hashes), np.uint32)
        for i in range(hashes):
            out[:, i] = np.minimum.reduceat(x * a[i] + b[i], first)
        found.append(text[first] + s.first)
        rows.append(out)
    if not found:
        return np.zeros(0, np.int64), np.zeros((0, hashes), np.uint32)
    return np.concatenate(found), np.concatenate(rows)


def row_hashes(m: np.ndarray, seed: int) -> np.ndarray:
    out = np.full(len(m), np.uint64(seed))
    for i in range(m.shape[1]):
        out = tx.mixed(out * np.uint64(tx.BASE) + m[:, i])
    return out


def sign(docs: DataFrame, shingle: int = SHINGLE, hashes: int = HASHES, rows: int = ROWS) -> DataFrame:
    """(id, sig, s1, s2, bands): the minima as bytes, 128 bits that name them, a key for each band of `rows` minima."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, m = signatures_of(batch.column(1), shingle, hashes)
            if not len(at):
                continue
            bands = np.stack([row_hashes(m[:, i : i + rows], i + 1) for i in range(0, hashes, rows)], 1)
            width = bands.shape[1]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0).take(pa.array(at)),
                    pa.array([r.tobytes() for r in m], pa.binary()),
                    pa.array(row_hashes(m, 901).view(np.int64)),
                    pa.array(row_hashes(m, 902).view(np.int64)),
                    tx.lists(bands.view(np.int64).ravel(), np.arange(0, (len(at) + 1) * width, width)),
                ],
                ["id", "sig", "s1", "s2", "bands"],
            )

    whole = docs.select(F.col("doc_id").cast("long").alias("id"), F.lower("text").alias("text"))
    return whole.mapInArrow(run, "id long, sig binary, s1 long, s2 long, bands array<long>")


def linked(ids: np.ndarray, m: np.ndarray, similar: float) -> tuple[list[int], list[int]]:
    """Edges that span the components of the graph of all pairs whose minima agree in a share of `similar` or more."""
    a, b = [], []
    left = np.arange(len(ids))
    need = int(np.ceil(similar * m.shape[1]))
    while len(left) > 1:
        edge, left = [left[0]], left[1:]
        while edge and len(left):
            p = edge.pop()
            same = (m[left] == m[p]).sum(1) >= need
            reached = left[same]
            a += [int(ids[p])] * len(reached)
            b += [int(x) for x in ids[reached]]
            edge += list(reached)
            left = left[~same]
    return a, b


def verified(buckets: DataFrame, similar: float) -> DataFrame:
    """Edges (a, b) inside each bucket (key, x, y, id, sig)."""

    def run(t: pa.Table) -> pa.Table:
        ids = t.column("id").to_numpy()
        m = np.frombuffer(b"".join(t.column("sig").to_pylist()), np.uint32).reshape(len(ids), -1)
        order = np.argsort(ids, kind="stable")
        a, b = linked(ids[order], m[order], similar)
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    return buckets.groupBy("key", "x", "y").applyInArrow(run, "a long, b long").distinct()


def in_blocks(entries: DataFrame, key: str, block: int) -> DataFrame:
    """(key, x, y, id, n): buckets of the ids of entries (id, key), each pair once, where two ids or more share a key; n of them.

    Keys are counted first, with partial sums, and only rows of keys that two ids share are written. Keys of the same ids
    make one bucket: of each only two 64-bit sums of their hashes are gathered, so no bucket is ever one row. A bucket of
    more than `block` ids is cut by a hash of the ids into blocks of about that size, and each pair of blocks (x, y) is a
    group of its own: every two ids of the bucket meet in one.
    """
    shared = entries.groupBy(key).agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    common = written(entries.join(shared, key).select(key, "id", "n"), "shared-keys")
    one = common.groupBy(key, "n").agg(F.bit_xor(F.xxhash64("id")).alias("h1"), F.bit_xor(F.xxhash64(F.lit("second"), "id")).alias("h2"))
    kept = one.groupBy("n", "h1", "h2").agg(F.min(key).alias(key)).select(key, F.ceil(F.col("n") / block).cast("int").alias("blocks"))
    found = common.join(kept, key).select(F.col(key).alias("key"), "id", "n", "blocks", F.pmod(F.xxhash64("id", F.lit(7)), "blocks").cast("int").alias("own"))
    # a block meets each other block once; one that is alone meets itself
    other = F.explode(F.when(F.col("blocks") == 1, F.array(F.lit(0))).otherwise(F.filter(F.sequence(F.lit(0), F.col("blocks") - 1), lambda b: b != F.col("own"))))
    found = found.select("key", "id", "n", "own", other.alias("other"))
    return found.select("key", F.least("own", "other").alias("x"), F.greatest("own", "other").alias("y"), "id", "n")


def components(edges: DataFrame, name: str = "stars") -> DataFrame:
    """(id, group): the smallest id of each connected component, for every id of an edge, by large-star and small-star.

    edges: (a, b) of longs, in any order, loops and repeats allowed. No edges: no rows.
    """

    def stamp(e: DataFrame) -> tuple:
        r = e.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")), F.lit(0))).first()
        return r[0], r[1]

    now = written(edges.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), name)
    mark = stamp(now)
    while mark[0]:
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.filter("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        small = large.groupBy("a").agg(F.min("b").alias("m"))
        after = large.join(small, "a").filter("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        after = after.unionByName(small.select("a", F.col("m").alias("b"))).distinct()
        after = written(after, name)
        was, mark = mark, stamp(after)
        dropped(now)
        now = after
        if mark == was:
            break
    return now.groupBy(F.col("a").alias("id")).agg(F.min("b").alias("group")).unionByName(now.select(F.col("b").alias("id"), F.col("b").alias("group")).distinct())


def near_duplicates(docs: DataFrame, shingle: int = SHINGLE, hashes: int = HASHES, rows: int = ROWS, similar: float = SIMILAR, block: int = BLOCK) -> DataFrame:
    """(doc_id, group_id) of every document that has a near copy; group_id is the smallest doc_id of its component.

    Documents are near when at least `similar` of their minima over runs of `shingle` words agree and a band of
    `rows` minima does. Words are runs of letters and digits in lower case. Rows of null doc_id, and null texts or
    texts without a word, are near nothing. A text shorter than a shingle is one shingle. Of rows that repeat a
    doc_id the smallest text counts. Empty tables give no rows; other columns are not read.
    """
    signed = written(sign(tx.unique_documents(docs.select("doc_id", "text")), shingle, hashes, rows), "signatures")
    nodes = signed.groupBy("s1", "s2").agg(F.min("id").alias("rep"), F.count(F.lit(1)).alias("n"))
    copies = signed.join(nodes.filter("n > 1"), ["s1", "s2"]).filter("id <> rep").select(F.col("id").alias("a"), F.col("rep").alias("b"))
    reps = signed.join(nodes.select("rep"), F.col("id") == F.col("rep"), "left_semi")
    banded = reps.select("id", F.explode("bands").alias("band"))
    buckets = in_blocks(banded, "band", block)
    checked = verified(buckets.join(signed.select("id", "sig"), "id").select("key", "x", "y", "id", "sig"), similar)
    return components(checked.unionByName(copies)).select(F.col("id").alias("doc_id"), F.col("group").alias("group_id"))


def keep_one(docs: DataFrame, **how) -> DataFrame:
    """docs without the near copies of a document of a smaller doc_id: one of each group stays. Rows of null doc_id go."""
    docs = tx.unique_documents(docs)
    return tx.without_ids(docs, near_duplicates(docs, **how).filter("doc_id <> group_id").select("doc_id"))
