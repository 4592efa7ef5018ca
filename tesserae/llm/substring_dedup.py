"""Substring dedup: an FM-index per shard, through which documents stream for their matching statistics.

Winnowing comes first and loses nothing: of the GRAM-word runs in a passage of LENGTH words the least hash is always
picked, so two occurrences of a passage share a picked hash at one place. Only stretches of LENGTH words around
hashes that repeat (regions) go on. Identical regions fold into one; where nothing but their copies shares their
hashes they need no search. Each other region goes to the shard of each hash that it shares, cut to the surroundings of
the hashes of that shard: what is sent is a few times the text that repeats, however many documents share a hash. A
shard's index holds the distinct stretches that came to it, and each of them streams through it. Shards get about
SHARD_WORDS words, so their number follows the text that repeats and an index fits a worker. A hash that more than HOT
regions share would fill a shard by itself: the runs of words around it are counted by key, with partial sums, which
gives the same stretches and gathers no group. The stretches of a document
found in different shards unite to those that one index of the whole corpus would give.

Words are maximal runs without ASCII white space, compared in 31 bits of their hashes inside a shard: for a false match
LENGTH of them in a row would have to collide.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tesserae.llm import text as tx
from tesserae.llm.fm_index import Matcher
from tesserae.session import dropped, unused, written

LENGTH = 50
GRAM = 8
SHARD_WORDS = 400_000
#: A hash that more regions share goes to no shard: the runs of LENGTH words around it are counted by key instead.
HOT = 4_000
#: Words of streams that are searched at a time.
BLOCK_WORDS = 400_000
#: Starts of passages in one search; longer streams are cut with an overlap of LENGTH - 1 words, which loses nothing.
CHUNK = 256


def picked(w: tx.Words, length: int, gram: int) -> tuple[np.ndarray, np.ndarray]:
    """(hash, word) of the runs of `gram` words that winnowing picks in texts of at least `length` words."""
    n = len(w.hash)
    if n < length:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    sums = tx.prefix_sums(w.hash)
    begin = np.arange(n - gram + 1)
    g = tx.span_hashes(sums, begin, begin + gram)
    text = w.text
    within = text[: n - length + 1] == text[length - 1 :]
    width = length - gram + 1
    least = np.where(within, tx.slide(g, width, np.minimum), np.uint64(0))
    pad = np.zeros(width - 1, np.uint64)
    most = tx.slide(np.concatenate([pad, least, pad]), width, np.maximum)
    at = np.flatnonzero(most == g)
    at = at[thinned(g[at], at, text[at], width)]
    return g[at], at


def thinned(g: np.ndarray, at: np.ndarray, text: np.ndarray, width: int) -> np.ndarray:
    """Which picks stay: of a run of one hash over and over its first, its last, and one in each half of `width` places.

    A passage has picks at `width` places, so one that held a pick of such a run still holds one.
    """
    half = max(1, width // 2)
    if not len(at):
        return np.zeros(0, bool)
    new = np.r_[True, (g[1:] != g[:-1]) | (text[1:] != text[:-1]) | (at[1:] - at[:-1] > half)]
    step = (at - at[np.maximum.accumulate(np.where(new, np.arange(len(at)), 0))]) // half
    return new | np.r_[new[1:], True] | np.r_[True, step[1:] != step[:-1]]


def fingerprints(docs: DataFrame, length: int, gram: int) -> DataFrame:
    """(fp, doc, pos): the picked hashes of docs (doc_id, text), and the word at which each starts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0).to_numpy(zero_copy_only=False)
            for s in tx.slices(batch.column(1)):
                w = s.words()
                g, at = picked(w, length, gram)
                text = w.text[at]
                yield pa.RecordBatch.from_arrays([pa.array(g.view(np.int64)), pa.array(ids[text + s.first]), pa.array((at - w.at[text]).astype(np.int32))], ["fp", "doc", "pos"])

    return docs.select("doc_id", "text").mapInArrow(run, "fp long, doc long, pos int")


def united(start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The union of spans in the order of start; spans that touch unite."""
    if not len(start):
        return start, end
    reach = np.maximum.accumulate(end)
    new = np.r_[True, start[1:] > reach[:-1]]
    return start[new], reach[np.r_[np.flatnonzero(new)[1:] - 1, len(start) - 1]]


def regions(marked: DataFrame, length: int, gram: int) -> DataFrame:
    """(doc, start, n, words, fps, places, content): the surroundings of the marked hashes of each document.

    marked: (doc_id, text, marks: array of (pos, fp)). words are 31-bit hashes as bytes, places are counted from start.
    """
    around = length - gram
    schema = "doc long, start int, n int, words binary, fps array<long>, places array<int>, content long"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0).to_numpy(zero_copy_only=False)
            marks = batch.column(2)
            offsets = marks.offsets.to_numpy()
            flat = marks.values
            pos, fp = (flat.field(k).to_numpy(zero_copy_only=False) for k in (0, 1))
            for s in tx.slices(batch.column(1)):
                w = s.words()
                sums = tx.prefix_sums(w.hash)
                short = (w.hash >> np.uint64(33)).astype(np.int32)
                a, z = offsets[s.first], offsets[s.first + len(s)]
                text = np.repeat(np.arange(len(s)), np.diff(offsets[s.first : s.first + len(s) + 1]))
                at = pos[a:z] + w.at[text]
                order = np.argsort(at)
                at, text, f = at[order], text[order], fp[a:z][order]
                begin, end = np.maximum(at - around, w.at[text]), np.minimum(at + length, w.at[text + 1])
                # texts lie apart by one more place each, so that regions of neighbours don't unite
                b, e = united(begin + text, end + text)
                owner = text[np.searchsorted(begin + text, b)]
                b, e = b - owner, e - owner
                first = np.searchsorted(at, b)
                last = np.append(first[1:], len(at))
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(ids[owner + s.first]),
                        pa.array((b - w.at[owner]).astype(np.int32)),
                        pa.array((e - b).astype(np.int32)),
                        pa.array([short[i:j].tobytes() for i, j in zip(b, e, strict=True)], pa.binary()),
                        tx.lists(f, np.append(first, len(at))),
                        tx.lists((at - np.repeat(b, last - first)).astype(np.int32), np.append(first, len(at))),
                        pa.array(tx.span_hashes(sums, b, e).view(np.int64)),
                    ],
                    ["doc", "start", "n", "words", "fps", "places", "content"],
                )

    return marked.select("doc_id", "text", "marks").mapInArrow(run, schema)


def shipped(routed: DataFrame, length: int, gram: int) -> DataFrame:
    """(shard, doc, start, words) of routed regions (doc, start, n, words, routes: array of (shard, places))."""
    around = length - gram

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [[] for _ in range(4)]
            for doc, start, n, words, routes in zip(*(batch.column(k).to_pylist() for k in range(5)), strict=True):
                words = np.frombuffer(words, np.int32)
                for r in routes:
                    at = np.sort(np.array(r["places"], np.int64))
                    for b, e in zip(*united(np.maximum(at - around, 0), np.minimum(at + length, n)), strict=True):
                        for k, x in enumerate((r["shard"], doc, start + int(b), words[b:e].tobytes())):
                            out[k].append(x)
            kinds = (pa.int32(), pa.int64(), pa.int32(), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(out, kinds, strict=True)], ["shard", "doc", "start", "words"])

    return routed.select("doc", "start", "n", "words", "routes").mapInArrow(run, "shard int, doc long, start int, words binary")


def matched(streams: DataFrame, length: int, earlier: bool) -> DataFrame:
    """(doc, start, end): the stretches of the streams of each shard that its index holds twice, or before them."""

    def run(t: pa.Table) -> pa.Table:
        doc, start = t.column("doc").to_numpy(), t.column("start").to_numpy().astype(np.int64)
        order = np.lexsort((start, doc))
        doc, start = doc[order], start[order]
        data, offsets = tx.flat(t.column("words").combine_chunks().take(pa.array(order)))
        words, offsets = data.view(np.int32), offsets // 4
        size = np.diff(offsets)
        # equal streams: the first of them stands for all
        names = tx.span_hashes(tx.prefix_sums(words.astype(np.uint32).astype(np.uint64)), offsets[:-1], offsets[1:])
        _, first, copy, copies = np.unique(names, return_index=True, return_inverse=True, return_counts=True)
        own = first[copy] == np.arange(len(doc))
        known = (~own if earlier else copies[copy] > 1) & (size >= length)
        found = [(doc[known], start[known], start[known] + size[known])]
        segments = np.flatnonzero(own)
        where = np.r_[0, np.cumsum(size[segments])]
        index = Matcher((words[np.arange(where[-1]) + np.repeat(offsets[segments] - where[:-1], size[segments])], where), length, earlier)
        # the streams that are left, in chunks
        asked = np.flatnonzero(own & ~known & (size >= length))
        place = index.starts[np.searchsorted(segments, asked)]
        pieces = -(-(size[asked] - length + 1) // CHUNK)
        of = np.repeat(np.arange(len(asked)), pieces)
        skip = (np.arange(len(of)) - np.repeat(np.cumsum(pieces) - pieces, pieces)) * CHUNK
        count = np.minimum(skip + CHUNK + length - 1, size[asked[of]]) - skip
        begin, bound, one = offsets[asked[of]] + skip, place[of] + skip, np.ones(len(of), np.int64)
        block = np.cumsum(count) // BLOCK_WORDS
        edges = np.r_[np.flatnonzero(np.r_[True, block[1:] != block[:-1]]), len(of)] if len(of) else np.zeros(1, np.int64)
        for i, j in zip(edges[:-1], edges[1:], strict=True):
            at = np.r_[0, np.cumsum(count[i:j])]
            chunks = words[np.arange(at[-1]) + np.repeat(begin[i:j] - at[:-1], count[i:j])]
            k, b, e = index.stretches(chunks, at, one[i:j], *((bound[i:j], one[i:j]) if earlier else ()))
            left = (start[asked[of]] + skip)[i:j][k]
            found.append((doc[asked[of]][i:j][k], left + b, left + e))
        d, b, e = (np.concatenate(x) for x in zip(*found, strict=True))
        return pa.table({"doc": d, "start": b.astype(np.int32), "end": e.astype(np.int32)})

    return streams.groupBy("shard").applyInArrow(run, "doc long, start int, end int")


def windows(routed: DataFrame, length: int, gram: int) -> DataFrame:
    """(doc, pos, w1, w2): 128 bits of each run of `length` words around the given places of regions (doc, start, n, words, places)."""
    around = length - gram

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            doc, start = (batch.column(k).to_numpy() for k in (0, 1))
            for i, (words, places) in enumerate(zip(batch.column(3), batch.column(4).to_pylist(), strict=True)):
                h = np.frombuffer(words.as_py(), np.int32).astype(np.uint64)
                place = np.array(places, np.int64)
                at = np.unique((place[:, None] - np.arange(around + 1)).ravel())
                at = at[(at >= 0) & (at <= len(h) - length)]
                w = [tx.span_hashes(tx.prefix_sums(tx.mixed(h + np.uint64(seed))), at, at + length).view(np.int64) for seed in (1 << 40, 1 << 50)]
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), doc[i])), pa.array((start[i] + at).astype(np.int32)), *map(pa.array, w)], ["doc", "pos", "w1", "w2"])

    return routed.select("doc", "start", "n", "words", "places").mapInArrow(run, "doc long, pos int, w1 long, w2 long")


def counted(routed: DataFrame, length: int, gram: int, earlier: bool) -> DataFrame:
    """(doc, start, end): what `matched` gives, for hashes of any number of regions: runs are counted, none is gathered."""
    every = written(windows(routed, length, gram), "hot-windows")
    twice = every.groupBy("w1", "w2").agg(F.count(F.lit(1)).alias("k"), F.min(F.struct("doc", "pos")).alias("first")).filter("k > 1")
    found = every.join(twice, ["w1", "w2"])
    if earlier:
        found = found.filter((F.col("doc") != F.col("first.doc")) | (F.col("pos") != F.col("first.pos")))
    return found.select("doc", F.col("pos").alias("start"), (F.col("pos") + length).alias("end"))


def merged(spans: DataFrame) -> DataFrame:
    """(doc, start, end): for each document the union of its spans."""
    w = Window.partitionBy("doc").orderBy("start", "end")
    reach = F.max("end").over(w.rowsBetween(Window.unboundedPreceding, -1))
    new = F.when(reach.isNull() | (F.col("start") > reach), 1).otherwise(0)
    spans = spans.distinct().withColumn("new", new)
    spans = spans.withColumn("run", F.sum("new").over(w))
    return spans.groupBy("doc", "run").agg(F.min("start").alias("start"), F.max("end").alias("end")).drop("run")


def repeated(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, earlier: bool = False, shard_words: int = SHARD_WORDS, hot: int = HOT) -> DataFrame:
    """(doc_id, start_word, end_word, n_words): the stretches of each document whose every run of `length` words occurs twice.

    The other occurrence may be in any document, or elsewhere in the same one; with `earlier` it must come before, in
    the order of doc_id and place, so that what is left out is all but the first. Stretches are unions of such runs,
    as word numbers from 0, the end not included. Null ids, null texts and texts of fewer than `length` words have
    none. Of rows that repeat a doc_id the smallest text counts. Other columns are not read.
    """
    docs = tx.unique_documents(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")))
    prints = written(fingerprints(docs, length, gram), "fingerprints")
    twice = prints.groupBy("fp").agg(F.count(F.lit(1)).alias("k")).filter("k > 1").select("fp")
    marks = prints.join(twice, "fp").groupBy("doc").agg(F.collect_list(F.struct("pos", "fp")).alias("marks"))
    found = written(regions(docs.join(marks, F.col("doc_id") == F.col("doc")), length, gram), "regions")
    dropped(prints)

    # identical regions: the first stands for all
    alike = found.groupBy("content", "n").agg(F.min(F.struct("doc", "start")).alias("first"), F.count(F.lit(1)).alias("copies"))
    light = found.select("doc", "start", "n", "content", "fps", "places").join(alike, ["content", "n"])
    is_first = (F.col("doc") == F.col("first.doc")) & (F.col("start") == F.col("first.start"))
    known = F.col("copies") > 1 if not earlier else ~is_first
    whole = light.filter(known & (F.col("n") >= length)).select("doc", "start", (F.col("start") + F.col("n")).alias("end"))

    # hashes that distinct regions share, or that one holds twice
    marks = light.filter(is_first).select("doc", "start", F.explode(F.arrays_zip("fps", "places")).alias("m"))
    marks = marks.select("doc", "start", F.col("m.fps").alias("fp"), F.col("m.places").alias("place"))
    shared = marks.groupBy("fp").agg(F.count(F.lit(1)).alias("k")).filter("k > 1")
    active = written(marks.join(shared, "fp"), "shared-marks")
    # a hash sends up to 2 * length words; the number of shards follows what is sent
    cool, heated = active.filter(F.col("k") <= hot), active.filter(F.col("k") > hot)
    size = cool.count() * (2 * length - gram)
    shards = max(1, -(-size // shard_words))
    routes = cool.groupBy("doc", "start", F.pmod("fp", F.lit(shards)).cast("int").alias("shard")).agg(F.collect_set("place").alias("places"))
    routes = routes.groupBy("doc", "start").agg(F.collect_list(F.struct("shard", "places")).alias("routes"))
    routed = found.select("doc", "start", "n", "words").join(routes, ["doc", "start"])
    places = heated.groupBy("doc", "start").agg(F.collect_set("place").alias("places"))
    crowded = found.select("doc", "start", "n", "words").join(places, ["doc", "start"])
    spans = matched(shipped(routed, length, gram), length, earlier).unionByName(counted(crowded, length, gram, earlier)).unionByName(whole)
    out = merged(spans)
    return out.select(F.col("doc").alias("doc_id"), F.col("start").alias("start_word"), F.col("end").alias("end_word"), (F.col("end") - F.col("start")).alias("n_words"))


def cut(docs: DataFrame, length: int = LENGTH, **how) -> DataFrame:
    """docs with every passage of `length` words or more cut out of its text but where it occurs first.

    Rows keep all their columns; n_chars, if there, follows the text. Rows that nothing is cut from stay as they are,
    null texts too; rows of null doc_id go. A cut takes the words and the white space after them.
    """
    docs = tx.unique_documents(docs)
    doc, cuts, left = (unused(c, docs) for c in ("doc_", "cuts_", "left_"))
    spans = repeated(docs, length, earlier=True, **how).groupBy(F.col("doc_id").alias(doc)).agg(F.sort_array(F.collect_list(F.struct("start_word", "end_word"))).alias(cuts))
    text, none = F.col("text"), F.col(cuts).isNull()
    joined = docs.join(spans, F.col("doc_id") == F.col(doc), "left").withColumn(left, F.when(none, text).otherwise(without(text.cast("string"), F.col(cuts))))
    columns = []
    for c in docs.columns:
        if c == "text":
            columns.append(F.col(left).alias("text"))
        elif c == "n_chars":
            columns.append(F.when(none, F.col("n_chars")).otherwise(F.length(left)).cast(docs.schema["n_chars"].dataType).alias("n_chars"))
        else:
            columns.append(F.col(f"`{c}`"))
    return joined.select(*columns)


def _without(texts, cuts):
    import pandas as pd

    out = []
    for text, spans in zip(texts, cuts, strict=True):
        if text is None or spans is None:
            out.append(text)
            continue
        raw = text.encode()
        w = tx.Slice(0, np.frombuffer(raw, np.uint8), np.array([0, len(raw)])).words()
        edges, kept = np.append(w.start, len(raw)), []
        at = 0
        for span in spans:
            kept.append(raw[at : edges[span["start_word"]]])
            at = edges[span["end_word"]]
        kept.append(raw[at:])
        out.append(b"".join(kept).decode())
    return pd.Series(out, dtype=object)


def without(text, cuts):
    """The text without the words of the cuts."""
    return F.pandas_udf(_without, "string")(text, cuts)
