"""Document fingerprints by context-triggered piecewise hashing, compared by edit distance at compatible block sizes.

A hash rolls over windows of WINDOW bytes; where it is -1 modulo the block size 3 * 2**k, a chunk ends, and each chunk
gives six bits of its hash as one character. A document's block size is the largest that leaves it HALF characters
or more, and it has a second signature at twice that size, so that documents of up to twice the size stay comparable.
Signatures are compared only at one block size and if they share a run of GRAM characters. That rule makes the search
an exact join on runs: equal signatures fold into one node, runs that only one node has are dropped early, buckets of
more than BLOCK nodes are compared as pairs of blocks, and inside a bucket a breadth-first walk compares each reached node with those not yet reached, so a group of thousands of like
documents costs a few comparisons each. Comparisons of many buckets go on together, 64 bits a step. Where thousands of unlike
nodes share a run, most pairs are ruled out by the characters that they have in common in any order, a few words of bits a pair, and
two nodes whose most frequent run is the same one are compared in the bucket of that run alone.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tesserae.llm import text as tx
from tesserae.llm.near_dedup import components, in_blocks
from tesserae.session import written

WINDOW = 7
LEAST = 3
MOST, HALF = 64, 32
GRAM = 7
#: Nodes of one bucket that are compared in one go; larger buckets are split.
BLOCK = 4096
#: Signatures of at least this score of 100 are alike.
ALIKE = 60
LEVELS = 32
NONE = np.uint64(0xFFFFFFFFFFFFFFFF)
ALPHABET = np.frombuffer(b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/", np.uint8)
_code = np.full(256, 64, np.uint8)
_code[ALPHABET] = np.arange(64)


def triggers(s: tx.Slice) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(end, level, text) of the bytes where a chunk ends at block sizes LEAST * 2**k for all k up to level."""
    size = np.diff(s.offsets)
    shift = np.repeat(np.arange(1, len(s) + 1) * WINDOW, size)
    place = np.arange(len(s.data)) + shift  # every text has WINDOW zeros before it
    padded = np.zeros(len(s.data) + (len(s) + 1) * WINDOW, np.uint32)
    padded[place] = s.data
    n = len(padded) - WINDOW + 1
    sums, mixed = np.zeros(n, np.uint32), np.zeros(n, np.uint32)
    for k in range(WINDOW):  # k bytes back
        c = padded[WINDOW - 1 - k : WINDOW - 1 - k + n]
        sums += c * np.uint32(WINDOW - k + 1)
        mixed ^= c << np.uint32(5 * k) if 5 * k < 32 else np.uint32(0)
    r = (sums + mixed)[place - WINDOW + 1].astype(np.int64) + 1
    at = np.flatnonzero(r % LEAST == 0)
    x = r[at] // LEAST
    level = np.minimum(np.bitwise_count((x & -x) - 1), LEVELS - 1).astype(np.int64)
    return at + 1, level, np.searchsorted(s.offsets, at, "right") - 1


def signatures(s: tx.Slice) -> tuple[np.ndarray, list[pa.Array], np.ndarray]:
    """The level of each text's block size, its signatures at that level and the next, and a hash of the whole text."""
    n, size = len(s), np.diff(s.offsets)
    end, level, text = triggers(s)
    count = np.bincount(text * LEVELS + level, minlength=n * LEVELS).reshape(n, LEVELS)[:, ::-1].cumsum(1)[:, ::-1]
    first = np.ceil(np.log2(np.maximum(size / (LEAST * MOST), 1))).astype(np.int64)
    fits = (count + 1 >= HALF) & (np.arange(LEVELS) <= first[:, None])
    k = np.where(fits.any(1), LEVELS - 1 - fits[:, ::-1].argmax(1), 0)
    sums = tx.prefix_sums(tx._values[s.data])
    return k, [_characters(s, sums, end, level, text, k + up) for up in (0, 1)], tx.span_hashes(sums, s.offsets[:-1], s.offsets[1:]).view(np.int64)


def _characters(s: tx.Slice, sums: np.ndarray, end: np.ndarray, level: np.ndarray, text: np.ndarray, k: np.ndarray) -> pa.Array:
    on = level >= k[text]
    end, text = end[on], text[on]
    first = np.searchsorted(text, np.arange(len(s) + 1))
    # the last character is for all that is left; bytes behind the last trigger make one too
    early = np.arange(len(end)) - first[text] < MOST - 1
    end, text = end[early], text[early]
    tail = np.flatnonzero(np.diff(s.offsets) > 0)
    end, text = np.concatenate([end, s.offsets[tail + 1]]), np.concatenate([text, tail])
    order = np.lexsort((end, text))
    end, text = end[order], text[order]
    if len(end):
        fresh = np.r_[True, (end[1:] != end[:-1]) | (text[1:] != text[:-1])]
        end, text = end[fresh], text[fresh]
    begin = np.r_[0, end[:-1]]
    begin = np.maximum(begin, s.offsets[text]) if len(end) else end
    chars = ALPHABET[(tx.span_hashes(sums, begin, end) >> np.uint64(58)).astype(np.int64)] if len(end) else np.zeros(0, np.uint8)
    offsets = np.searchsorted(text, np.arange(len(s) + 1)).astype(np.int32)
    return pa.StringArray.from_buffers(len(s), pa.py_buffer(offsets.tobytes()), pa.py_buffer(chars.tobytes()))


def fingerprints(docs: DataFrame) -> DataFrame:
    """(doc_id, block_size, signature, double_signature) of every row of docs (doc_id, text).

    A null text has nulls, an empty one empty signatures at the least block size; null doc_ids and repeated rows have
    theirs as well. Other columns are not read.
    """
    return _fingerprints(docs).drop("whole")


def _fingerprints(docs: DataFrame) -> DataFrame:
    """`fingerprints` with `whole`, a hash of the text, where the signature is too short to compare."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for s in tx.slices(batch.column(1)):
                k, (one, two), whole = signatures(s)
                null = batch.column(1).slice(s.first, len(s)).is_null()
                full = pa.array(np.ones(len(s), bool)) if not null.true_count else pa.compute.invert(null)
                size = pa.array((LEAST << k).astype(np.int64))
                one, two, size = (x if not null.true_count else pa.compute.if_else(full, x, None) for x in (one, two, size))
                brief = pa.compute.less(pa.compute.binary_length(one), GRAM)
                columns = [batch.column(0).slice(s.first, len(s)), size, one, two, pa.compute.if_else(brief, pa.array(whole), None)]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "block_size", "signature", "double_signature", "whole"])

    columns = (F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return docs.select(*columns).mapInArrow(run, "doc_id long, block_size long, signature string, double_signature string, whole long")


def coded(found: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Signatures as rows of codes, 64 where they are over, without what exceeds three equal characters; their lengths."""
    data, offsets = tx.flat(found)
    row = np.repeat(np.arange(len(found)), np.diff(offsets))
    dull = np.zeros(len(data), bool)
    if len(data) > 3:
        dull[3:] = (data[3:] == data[2:-1]) & (data[3:] == data[1:-2]) & (data[3:] == data[:-3]) & (row[3:] == row[:-3])
    data, row = data[~dull], row[~dull]
    at = np.searchsorted(row, np.arange(len(found) + 1))
    out = np.full((len(found), MOST), 64, np.uint8)
    out[row, np.arange(len(data)) - at[row]] = _code[data]
    return out, np.diff(at)


def common(codes: np.ndarray, sizes: np.ndarray, a: np.ndarray, b: np.ndarray, masks: np.ndarray) -> np.ndarray:
    """Lengths of the longest common subsequences of rows a and b; masks: the places of each code in each row."""
    flat, out = masks.ravel(), np.zeros(len(a), np.int64)
    for i in range(0, len(a), 4096):  # so many pairs stay in the processor's cache
        x, y = a[i : i + 4096], b[i : i + 4096]
        chars, at = np.ascontiguousarray(codes[y].T), x * masks.shape[1]
        v = np.full(len(x), np.uint64(0xFFFFFFFFFFFFFFFF))
        for j in range(int(sizes[y].max())):
            u = flat.take(at + chars[j])
            u &= v
            rest = v - u
            v += u
            v |= rest
        inside = np.where(sizes[x] >= 64, np.uint64(0xFFFFFFFFFFFFFFFF), (np.uint64(1) << np.minimum(sizes[x], 63).astype(np.uint64)) - np.uint64(1))
        out[i : i + 4096] = np.bitwise_count(~v & inside)
    return out


def masks_of(codes: np.ndarray) -> np.ndarray:
    out = np.zeros((len(codes), 65), np.uint64)
    rows = np.arange(len(codes))
    for j in range(MOST):
        out[rows, codes[:, j]] |= np.uint64(1) << np.uint64(j)
    out[:, 64] = 0
    return out


def scores(codes: np.ndarray, sizes: np.ndarray, a: np.ndarray, b: np.ndarray, masks: np.ndarray, block: np.ndarray) -> np.ndarray:
    """100 less the share of characters to insert or delete, at most what signatures of that size and length can tell."""
    both = sizes[a] + sizes[b]
    distance = both - 2 * common(codes, sizes, a, b, masks)
    value = 100 - (100 * distance) // np.maximum(both, 1)
    return np.minimum(value, block // LEAST * np.minimum(sizes[a], sizes[b]))


def repeats_of(codes: np.ndarray) -> list[np.ndarray]:
    """For t = 0, 1, ... the codes that each row has more than t times, as bits."""
    count = np.zeros((len(codes), 65), np.uint8)
    rows = np.arange(len(codes))
    for j in range(MOST):
        count[rows, codes[:, j]] += 1
    count = count[:, :64]
    return [np.packbits(count > t, axis=1).view(np.uint64).ravel() for t in range(int(count.max()) if len(codes) else 0)]


def possible(sizes: np.ndarray, a: np.ndarray, b: np.ndarray, repeats: list[np.ndarray], alike: int) -> np.ndarray:
    """Whether rows a and b have so many characters in common, in any order, that they may score `alike`."""
    most = np.zeros(len(a), np.int64)
    for x in repeats:
        most += np.bitwise_count(x[a] & x[b])
    both = sizes[a] + sizes[b]
    return 100 - (100 * (both - 2 * most)) // np.maximum(both, 1) >= alike


def linked(
    ids: np.ndarray, codes: np.ndarray, sizes: np.ndarray, bucket: np.ndarray, block: np.ndarray, alike: int, elsewhere: np.ndarray | None = None
) -> tuple[np.ndarray, np.ndarray]:
    """Edges that span, in each bucket, the components of the graph of all pairs of score `alike` or more.

    Rows come bucket by bucket. In each round every bucket that isn't done takes one reached row, or if there is
    none a new one, and compares it with its rows that weren't reached yet; rows that were compared as first are done.
    Pairs of rows of one number other than 0 in `elsewhere` are left out, since another bucket has them.
    """
    masks, repeats = masks_of(codes), repeats_of(codes)
    n = int(bucket[-1]) + 1 if len(bucket) else 0
    left = np.arange(len(ids))  # not reached
    queue: list[list[int]] = [[] for _ in range(n)]
    out = [], []
    while len(left):
        of = bucket[left]
        at = np.flatnonzero(np.r_[True, of[1:] != of[:-1]])
        now = np.full(n, -1)
        stay = np.ones(len(left), bool)
        for k, i, b in zip(at.tolist(), left[at].tolist(), of[at].tolist(), strict=True):
            if queue[b]:
                now[b] = queue[b].pop()
            else:
                now[b] = i
                stay[k] = False
        left, p = left[stay], now[of[stay]]
        maybe = np.arange(len(left))
        if elsewhere is not None:
            maybe = np.flatnonzero((elsewhere[left] == 0) | (elsewhere[left] != elsewhere[p]))
        maybe = maybe[possible(sizes, p[maybe], left[maybe], repeats, alike)]
        hit = np.zeros(len(left), bool)
        hit[maybe] = scores(codes, sizes, p[maybe], left[maybe], masks, block[left[maybe]]) >= alike
        out[0].append(ids[p[hit]])
        out[1].append(ids[left[hit]])
        for i in left[hit]:
            queue[bucket[i]].append(int(i))
        left = left[~hit]
    return tuple(np.concatenate(x) if x else np.zeros(0, np.int64) for x in out)


def grams(nodes: DataFrame) -> DataFrame:
    """(id, gram): the runs of GRAM characters of the signatures of nodes (id, block, sig), with the block size."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            codes, sizes = coded(batch.column(2))
            block = batch.column(1).to_numpy().astype(np.uint64)
            key = np.zeros((len(codes), MOST - GRAM + 1), np.uint64)
            for j in range(GRAM):
                key = key << np.uint64(6) | codes[:, j : j + MOST - GRAM + 1].astype(np.uint64)
            # each run once: all runs in order, those that a signature lacks last
            value = tx.mixed(key + block[:, None] * np.uint64(tx.BASE))
            value[np.arange(MOST - GRAM + 1) + GRAM > sizes[:, None]] = NONE
            value.sort(1)
            fresh = value != NONE
            fresh[:, 1:] &= value[:, 1:] != value[:, :-1]
            row, j = np.nonzero(fresh)
            yield pa.RecordBatch.from_arrays([pa.array(batch.column(0).to_numpy()[row]), pa.array(value[row, j].view(np.int64))], ["id", "gram"])

    return nodes.select("id", "block", "sig").mapInArrow(run, "id long, gram long")


def _edges(buckets: DataFrame, alike: int) -> DataFrame:
    """(a, b) of buckets (members: rep, block, sig, elsewhere)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            members = batch.column(0)
            count = members.value_lengths().to_numpy()
            inner = members.flatten()
            ids, block = inner.field("rep").to_numpy(), inner.field("block").to_numpy()
            codes, sizes = coded(inner.field("sig"))
            a, b = linked(ids, codes, sizes, np.repeat(np.arange(len(count)), count), block, alike, inner.field("elsewhere").to_numpy())
            yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])

    return buckets.select("members").mapInArrow(run, "a long, b long").distinct()


def grouped(docs: DataFrame, alike: int = ALIKE) -> DataFrame:
    """(doc_id, block_size, signature, double_signature, group_id) of every document; group_id joins those that are alike.

    Two documents are alike if at a block size that both have a signature of, the signatures share a run of GRAM
    characters and score at least `alike`; group_id is the smallest doc_id of the component, and a document's own if
    nothing is like it. Texts with a signature of fewer than GRAM characters, empty ones too, are alike where they are equal,
    null texts are like nothing. Rows of null doc_id go, and of rows that repeat a doc_id the smallest text counts. No rows give no rows; other columns are
    not read.
    """
    docs = tx.unique_documents(docs.select("doc_id", "text"))
    found = written(_fingerprints(docs), "fingerprints")
    one = found.select("doc_id", F.col("block_size").alias("block"), F.col("signature").alias("sig"))
    two = found.select("doc_id", (F.col("block_size") * 2).alias("block"), F.col("double_signature").alias("sig"))
    entries = one.unionByName(two).filter(F.length("sig") >= GRAM)
    nodes = written(entries.groupBy("block", "sig").agg(F.min("doc_id").alias("rep"), F.count(F.lit(1)).alias("n")).withColumn("id", F.xxhash64("block", "sig")), "signature-nodes")
    copies = entries.join(nodes.filter("n > 1").select("block", "sig", "rep"), ["block", "sig"]).filter("doc_id <> rep").select(F.col("doc_id").alias("a"), F.col("rep").alias("b"))
    # texts with a signature too short to compare are alike where they are equal: by both signatures and a hash of all bytes
    short = found.filter("whole is not null")
    names = ["block_size", "signature", "double_signature", "whole"]
    first = short.groupBy(*names).agg(F.min("doc_id").alias("rep"), F.count(F.lit(1)).alias("n")).filter("n > 1").drop("n")
    equal = short.join(first, names).filter("doc_id <> rep").select(F.col("doc_id").alias("a"), F.col("rep").alias("b"))
    members = in_blocks(grams(nodes), "gram", BLOCK).join(nodes.select("id", "rep", "block", "sig"), "id")
    # the largest bucket of each node compares it with the nodes whose largest it is too; the others need not
    largest = F.max(F.struct("n", "key")).over(Window.partitionBy("id"))["key"]
    members = members.withColumn("largest", largest).withColumn("elsewhere", F.when(F.col("largest") == F.col("key"), 0).otherwise(F.col("largest")))
    buckets = members.groupBy("key", "x", "y").agg(F.collect_list(F.struct("rep", "block", "sig", "elsewhere")).alias("members"))
    groups = components(_edges(buckets, alike).unionByName(copies).unionByName(equal), "signature-stars")
    return found.join(groups, F.col("doc_id") == F.col("id"), "left").select("doc_id", "block_size", "signature", "double_signature", F.coalesce("group", "doc_id").alias("group_id"))
