"""Quality by co-training: a classifier of the text and one of the metadata teach each other, then both are combined.

The text view has shares of kinds of bytes, repetition and hashed words; the metadata view has the language, the
source and the length in logarithmic steps, with pairs of them. One scan of whole texts writes both views of every
document as a compact table, which all that follows reads. Both views start as logistic regressions on a bounded
sample of labelled rows (LABELLED). In each round each view labels all other documents of which it is sure, whatever their
number, and the other view is fitted again on the labelled rows and on these (on those of the round before, if there are none): documents of one pseudo-label and one cell of the
metadata add up to one weighted mean, in sums that Spark gathers in two steps, so what reaches the fit is bounded
(CELLS) while every sure document takes part. A class's pseudo-labels weigh, all together, PSEUDO times its share of the labelled
rows. Each view is calibrated on a tenth of the labelled rows that is held out (Platt), and the score is the calibrated
log-odds of both, weighted by a last logistic fit on another held-out tenth.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tesserae.llm import text as tx
from tesserae.session import written

#: The most labelled rows that a model is fitted on, by the order of a hash of their ids.
LABELLED = 6_000
ROUNDS = 3
WORD_BITS, META_BITS = 10, 10
#: Cells of the metadata whose documents add up to one mean for each class, and the weight of all pseudo-labels.
CELLS, PSEUDO = 16, 0.5
#: Calibrated log-odds from which a view is sure.
SURE = float(np.log(9))
#: What is added to the spread of each number of the text view, so that a word of few labelled rows stays small.
LEAST_SPREAD = 0.02
#: Bits of a hashed word's share in the table of views.
SHARE_BITS = 32 - WORD_BITS
#: Documents of a lower score are rejected.
KEEP = 0.05

_kinds = np.zeros(256, np.int8)
_kinds[tx.SPACES] = 1
_kinds[65:91], _kinds[97:123], _kinds[48:58] = 2, 3, 4
_kinds[128:] = 5
_kinds[[33, 34, 39, 40, 41, 44, 45, 46, 58, 59, 63]] = 6
KINDS = 7
#: Numbers of a text's shape.
SHAPE = KINDS + 8


def shape_features(s: tx.Slice, w: tx.Words) -> np.ndarray:
    """Shares of kinds of bytes, of repeated words, of word ends that aren't letters, mean word length, and lengths."""
    n = len(s)
    sizes = np.diff(s.offsets)
    kind = _kinds[s.data]
    shares = np.zeros((n, KINDS))
    for k in range(KINDS):
        c = np.zeros(len(kind) + 1, np.int64)
        np.cumsum(kind == k, out=c[1:])
        shares[:, k] = np.diff(c[s.offsets]) / np.maximum(sizes, 1)
    count = np.maximum(w.counts, 1)
    text = w.text
    last = kind[w.end - 1] if len(w.end) else np.zeros(0, np.int8)
    odd_end = np.bincount(text, weights=(last == 0), minlength=n) / count
    loud = np.bincount(text, weights=(kind[w.start] == 2) & (last != 3) if len(text) else None, minlength=n) / count
    short = np.bincount(text, weights=(w.end - w.start) == 1, minlength=n) / count
    length = np.bincount(text, weights=w.end - w.start, minlength=n) / count
    again = np.zeros(len(text), bool)
    again[1:] = (w.hash[1:] == w.hash[:-1]) & (text[1:] == text[:-1])
    again = np.bincount(text, weights=again, minlength=n) / count
    grams, owner = tx.ngrams(w, 4)
    distinct = np.zeros(n)
    if len(grams):
        order = np.lexsort((grams, owner))
        g, o = grams[order], owner[order]
        fresh = np.r_[True, (g[1:] != g[:-1]) | (o[1:] != o[:-1])]
        distinct = np.bincount(o[fresh], minlength=n) / np.maximum(np.bincount(o, minlength=n), 1)
    return np.column_stack([shares, odd_end, loud, short, again, np.log1p(length), distinct, np.log1p(sizes) / 10, np.log1p(count) / 10])


def text_view(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The shape of each text; its hashed words, as coordinate and root of their share in one number each; their offsets."""
    shapes, packed, sizes = [], [], []
    for s in tx.slices(texts):
        shapes.append(shape_features(s, s.words()))
        plain = s.words(tx.MARKS, fold_case=True)
        key, n = np.unique(plain.text << WORD_BITS | (plain.hash >> np.uint64(64 - WORD_BITS)).astype(np.int64), return_counts=True)
        text = key >> WORD_BITS
        share = np.sqrt(n / np.maximum(plain.counts, 1)[text])
        packed.append(((key & ((1 << WORD_BITS) - 1)) << SHARE_BITS | np.round(share * ((1 << SHARE_BITS) - 1)).astype(np.int64)).astype(np.uint32))
        sizes.append(np.bincount(text, minlength=len(s)))
    if not shapes:
        return np.zeros((0, SHAPE)), np.zeros(0, np.uint32), np.zeros(1, np.int64)
    return np.concatenate(shapes), np.concatenate(packed), np.r_[0, np.cumsum(np.concatenate(sizes))]


def meta_view(lang: pa.Array, source: pa.Array, sizes: np.ndarray) -> np.ndarray:
    """Hashed coordinates of each row's metadata, three singles and three pairs, in order; a null is a value of its own."""

    def named(column: pa.Array, seed: int) -> np.ndarray:
        data, offsets = tx.flat(column)
        h = tx.span_hashes(tx.prefix_sums(tx._values[data]), offsets[:-1], offsets[1:])
        return tx.mixed(h + np.uint64(seed) + column.is_null().to_numpy(zero_copy_only=False).astype(np.uint64))

    a, b, c = named(lang, 11), named(source, 22), tx.mixed(np.log2(sizes + 1).astype(np.uint64) + np.uint64(33))
    base = np.uint64(tx.BASE)
    every = np.stack([tx.mixed(x + np.uint64(k)) for k, x in enumerate((a, b, c, a * base + b, a * base + c, b * base + c))], 1)
    return np.sort((every >> np.uint64(64 - META_BITS)).astype(np.int64), 1)


def viewed(docs: DataFrame) -> DataFrame:
    """(doc_id, size, shape, words, meta): both views of every row of docs (doc_id, text, lang, source); size: bytes of the text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = np.diff(tx.flat(batch.column(1))[1])
            shape, words, offsets = text_view(batch.column(1))
            meta = meta_view(batch.column(2), batch.column(3), sizes).astype(np.int16)
            rows = [shape.astype(np.float32), meta]
            fixed = [pa.Array.from_buffers(pa.binary(x.shape[1] * x.itemsize), len(x), [None, pa.py_buffer(x.tobytes())]).cast(pa.binary()) for x in rows]
            words = pa.Array.from_buffers(pa.binary(), len(sizes), [None, pa.py_buffer((4 * offsets).astype(np.int32).tobytes()), pa.py_buffer(words.tobytes())])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes), fixed[0], words, fixed[1]], ["doc_id", "size", "shape", "words", "meta"])

    columns = [F.col("doc_id").cast("long").alias("doc_id"), *(F.col(c).cast("string").alias(c) for c in ("text", "lang", "source"))]
    return docs.select(*columns).mapInArrow(run, "doc_id long, size long, shape binary, words binary, meta binary")


class Views:
    """A batch of `viewed` as arrays: shape by row, owner, at and share of each word, and meta with doubles of a row at -1."""

    def __init__(self, batch: pa.RecordBatch | pa.Table):
        column = lambda name: tx.flat(batch.column(name).combine_chunks() if isinstance(batch, pa.Table) else batch.column(name))
        self.n = batch.num_rows
        self.size = batch.column("size").to_numpy()
        self.shape = column("shape")[0].view(np.float32).reshape(-1, SHAPE).astype(float)
        data, offsets = column("words")
        packed = np.frombuffer(data.tobytes(), np.uint32)
        self.owner = np.repeat(np.arange(self.n), np.diff(offsets) // 4)
        self.at, self.share = (packed >> SHARE_BITS).astype(np.int64), (packed & ((1 << SHARE_BITS) - 1)) / ((1 << SHARE_BITS) - 1)
        self.meta = np.frombuffer(column("meta")[0].tobytes(), np.int16).reshape(-1, 6).astype(np.int64)
        self.cell = (tx.span_hashes(tx.prefix_sums(self.meta.ravel().astype(np.uint64)), np.arange(self.n) * 6, np.arange(1, self.n + 1) * 6) % np.uint64(CELLS)).astype(np.int64)
        self.meta[:, 1:][self.meta[:, 1:] == self.meta[:, :-1]] = -1

    def odds(self, w: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        text = self.shape @ w[0][:SHAPE] + np.bincount(self.owner, self.share * w[0][SHAPE:-1][self.at], self.n) + w[0][-1]
        return text, np.append(w[1][:-1], 0)[self.meta].sum(1) + w[1][-1]

    def sums(self, group: np.ndarray, groups: int, view: int) -> np.ndarray:
        """The sum of a view's rows of each group; rows of group -1 are left out."""
        on = group >= 0
        if view == 0:
            shape = np.zeros((groups, SHAPE))
            np.add.at(shape, group[on], self.shape[on])
            word = on[self.owner]
            words = np.bincount(group[self.owner[word]] << WORD_BITS | self.at[word], self.share[word], groups << WORD_BITS)
            return np.column_stack([shape, words.reshape(groups, -1)])
        ok = on[:, None] & (self.meta >= 0)
        return np.bincount((group[:, None] << META_BITS | self.meta)[ok], minlength=groups << META_BITS).reshape(groups, -1).astype(float)

    def dense(self, view: int) -> np.ndarray:
        return self.sums(np.arange(self.n), self.n, view).astype(np.float32)


def logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray | None = None, l2: float = 1e-4, steps: int = 250, rate: float = 0.1) -> np.ndarray:
    """Weights, the bias last, by full-batch Adam on a weighted logistic loss."""
    w = np.zeros(x.shape[1] + 1)
    v = np.ones(len(y)) if weight is None else weight
    v = v / v.sum()
    m1, m2 = np.zeros_like(w), np.zeros_like(w)
    for t in range(1, steps + 1):
        r = v * (1 / (1 + np.exp(-np.clip(x @ w[:-1].astype(x.dtype) + w[-1], -35, 35))) - y)
        g = np.append(r.astype(x.dtype) @ x + l2 * w[:-1], r.sum())
        m1, m2 = 0.9 * m1 + 0.1 * g, 0.99 * m2 + 0.01 * g * g
        w -= rate * (m1 / (1 - 0.9**t)) / (np.sqrt(m2 / (1 - 0.99**t)) + 1e-9)
    return w


def refit(views: list[np.ndarray], y: np.ndarray, taught: list[list[tuple[int, int, np.ndarray]]]) -> dict:
    """The model of labelled rows and of means (class, documents, mean) that each view was taught by the other.

    Every fifth labelled row is held out, by turns for the calibration and for the mix.
    """
    n = len(y)
    held = np.arange(n) % 5 == 0
    first = np.arange(n) % 10 == 0
    if n < 20 or any(y[on].min() == y[on].max() for on in (~held, first, held & ~first)):
        base = float(np.clip(y.mean() if n else 0.5, 0.01, 0.99))
        return {"w": [[0.0] * (v.shape[1] + 1) for v in views], "calibration": [[0.0, 0.0]] * 2, "mix": [0.0, 0.0, float(np.log(base / (1 - base)))], "usable": False}
    rate = y[~held].mean()
    weights, out = [], []
    for k, view in enumerate(views):
        c, d = (view[~held].mean(0), view[~held].std(0) + LEAST_SPREAD) if k == 0 else (np.zeros(view.shape[1]), np.ones(view.shape[1]))
        x, t, v = [(view[~held] - c) / d], [y[~held]], [np.ones((~held).sum())]
        for cls in (0, 1):
            some = [m for m in taught[k] if m[0] == cls]
            if some:
                many = np.array([m[1] for m in some], float)
                x.append((np.array([m[2] for m in some]) - c) / d)
                t.append(np.full(len(some), float(cls)))
                v.append(many / many.sum() * PSEUDO * (~held).sum() * (rate if cls else 1 - rate))
        w = logistic(np.concatenate(x).astype(np.float32), np.concatenate(t), np.concatenate(v), l2=1e-3)
        inner = w[:-1] / d  # the scaling goes into the weights
        w = np.append(inner, w[-1] - np.sum(inner * c))
        weights.append(w)
        out.append(view @ w[:-1] + w[-1])
    calibration = [logistic(o[first][:, None], y[first], steps=400).tolist() for o in out]
    rest = held & ~first
    both = np.column_stack([a * o[rest] + b for (a, b), o in zip(calibration, out, strict=True)])
    return {"w": [w.tolist() for w in weights], "calibration": calibration, "mix": logistic(both, y[rest], steps=400).tolist(), "usable": True}


def taught_by(views: DataFrame, model: dict, sample: np.ndarray) -> list[list[tuple[int, int, np.ndarray]]]:
    """For each view the means of all documents that the other one is sure of, but for the labelled ones of `sample` (ids, sorted)."""
    w, groups = [np.array(x) for x in model["w"]], 2 * CELLS

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        total = [np.zeros((groups, x - 1)) for x in map(len, w)]
        count = np.zeros((2, groups), np.int64)
        for batch in batches:
            v = Views(batch)
            ids = batch.column("doc_id").to_numpy(zero_copy_only=False)
            free = (v.size > 0) & ~np.isin(ids, sample)
            for k, (other, (a, b)) in enumerate(zip(v.odds(w)[::-1], model["calibration"][::-1], strict=True)):
                other = a * other + b
                group = np.where(free & (np.abs(other) > SURE), 2 * v.cell + (other > 0), -1)
                total[k] += v.sums(group, groups, k)
                count[k] += np.bincount(group[group >= 0], minlength=groups)
        part = TaskContext.get().partitionId()
        found = [(k, g, part, int(count[k, g]), total[k][g].tobytes()) for k in (0, 1) for g in range(groups) if count[k, g]]
        yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*found, strict=True) if found else [[]] * 5, KINDS_OF_SUMS, strict=True)], [f.name for f in SUMS])

    def added(t: pa.Table) -> pa.Table:
        t = t.take(pa.compute.sort_indices(t, [("part", "ascending")]))
        sums = np.sum([np.frombuffer(x, float) for x in t.column("sums").to_pylist()], 0)
        return pa.table([[t.column(c)[0].as_py()] for c in ("view", "group", "part")] + [[sum(t.column("n").to_pylist())], [sums.tobytes()]], SUMS)

    plain = "view int, group int, part int, n long, sums binary"
    some = views.mapInArrow(run, plain).groupBy("view", "group", F.pmod("part", F.lit(64))).applyInArrow(added, plain)
    rows = some.groupBy("view", "group").applyInArrow(added, plain).collect()
    out: list[list] = [[], []]
    for r in sorted(rows, key=lambda r: (r["view"], r["group"])):
        out[r["view"]].append((r["group"] % 2, r["n"], np.frombuffer(bytes(r["sums"]), float) / r["n"]))
    return out


SUMS = pa.schema([("view", pa.int32()), ("group", pa.int32()), ("part", pa.int32()), ("n", pa.int64()), ("sums", pa.binary())])
KINDS_OF_SUMS = SUMS.types


def fit(views: DataFrame, labels: DataFrame, most: int = LABELLED, rounds: int = ROUNDS) -> dict:
    """The model of a written table of `viewed` documents and labels (doc_id, quality); null labels and empty texts are left out."""
    known = labels.select(F.col("doc_id").cast("long").alias("known"), F.col("quality").cast("double").alias("y")).dropna().groupBy("known").agg(F.min("y").alias("y"))
    chosen = F.broadcast(known.orderBy(F.xxhash64("known"), "known").limit(most))
    sample = views.filter("size > 0").join(chosen, F.col("doc_id") == F.col("known")).select(*views.columns, "y")
    sample = written(sample.dropDuplicates(["doc_id"]).withColumn("turn", F.xxhash64("doc_id")), "labelled")
    ids = np.sort(np.array([r["doc_id"] for r in sample.select("doc_id").collect()], np.int64))

    def train(taught: list) -> Callable[[pa.Table], pa.Table]:
        def run(t: pa.Table) -> pa.Table:
            t = t.take(pa.array(np.lexsort((t.column("doc_id").to_numpy(), t.column("turn").to_numpy()))))
            v = Views(t)
            return pa.table({"model": [json.dumps(refit([v.dense(0), v.dense(1)], t.column("y").to_numpy(), taught))]})

        return run

    taught: list[list] = [[], []]
    for turn in range(rounds + 1):
        made = sample.groupBy(F.lit(1).alias("one")).applyInArrow(train(taught), "model string").collect()
        if not made:
            return {"w": None}
        model = json.loads(made[0]["model"])
        if turn == rounds or not model["usable"]:
            return model
        taught = [new or old for new, old in zip(taught_by(views, model, ids), taught, strict=True)]
    raise AssertionError


def score(views: DataFrame, model: dict) -> DataFrame:
    """(doc_id, score) of every row of `viewed` documents: the probability of good quality; a null or empty text has score 0."""
    plain = json.dumps(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = json.loads(plain)
        w = [np.array(x) for x in m["w"]] if m["w"] else None
        for batch in batches:
            v = Views(batch)
            total = np.zeros(v.n)
            if w:
                total += m["mix"][2]
                for share, (a, b), odds in zip(m["mix"], m["calibration"], v.odds(w), strict=False):
                    total += share * (a * odds + b)
            out = np.where(v.size > 0, 1 / (1 + np.exp(-np.clip(total, -35, 35))), 0)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(out)], ["doc_id", "score"])

    return views.mapInArrow(run, "doc_id long, score double")


def scored(docs: DataFrame, labels: DataFrame, keep: float = KEEP, **how) -> DataFrame:
    """(doc_id, score, keep) of every row of docs (doc_id, text, lang, source), by a model of labels (doc_id, quality).

    Null ids keep their score under a null id; repeated rows are scored each; null language or source is a value of
    its own; a null or empty text has score 0 and isn't kept. Labels of no document are left out; of several labels
    of one document the lowest counts; with too few labels, or of one class, the score is their mean, 0.5 if there
    are none at all. Other columns, whatever their names, are not read.
    """
    views = written(viewed(docs), "views")
    return score(views, fit(views, labels, **how)).withColumn("keep", F.col("score") >= keep)


def keep_good(docs: DataFrame, labels: DataFrame, keep: float = KEEP, **how) -> DataFrame:
    """The rows of docs that `scored` keeps, with all their columns; rows of null doc_id go."""
    docs = tx.unique_documents(docs)
    return tx.without_ids(docs, scored(docs, labels, keep, **how).filter("not keep").select("doc_id"))
