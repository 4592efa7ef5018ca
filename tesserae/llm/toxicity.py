"""Toxicity: FTRL-proximal logistic regression over hashed word n-grams and skip-grams.

Training takes a bounded sample of labelled documents (LABELLED) into one task, where per-coordinate rates and L1
leave a few thousand weights that aren't zero. Only those go to the executors; scoring is one scan of whole texts.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tesserae.llm import text as tx

BITS = 20
#: The most labelled documents that a model is fitted on, by the order of a hash of their ids.
LABELLED = 20_000
THRESHOLD = 0.3


def features(words: tx.Words, bits: int = BITS) -> tuple[np.ndarray, np.ndarray]:
    """(coordinate, text) of each word, each pair of neighbours, each triple, and each pair that skips one word."""
    h, text = words.hash, words.text
    coordinate, owner = [h], [text]
    for shape, gap in ((1, (1,)), (2, (1, 2)), (3, (2,))):
        far = max(gap)
        if len(h) <= far:
            continue
        ok = text[far:] == text[:-far]
        x = h[:-far].copy()
        for g in gap:
            x = x * np.uint64(tx.BASE) + h[g : len(h) - far + g]
        coordinate.append(tx.mixed(x + np.uint64(shape))[ok])
        owner.append(text[:-far][ok])
    return (np.concatenate(coordinate) >> np.uint64(64 - bits)).astype(np.int64), np.concatenate(owner)


def documents_of(texts: pa.Array, bits: int) -> Iterator[np.ndarray]:
    """The distinct coordinates of each text."""
    for s in tx.slices(texts):
        w = s.words(tx.MARKS, fold_case=True)
        c, owner = features(w, bits)
        order = np.argsort(owner, kind="stable")
        c, at = c[order], np.searchsorted(owner[order], np.arange(len(s) + 1))
        for i in range(len(s)):
            yield np.unique(c[at[i] : at[i + 1]])


class Ftrl:
    """FTRL-proximal for logistic loss; z and n hold each coordinate's state, and the last coordinate is the bias."""

    def __init__(self, size: int, alpha: float = 1.0, beta: float = 1.0, l1: float = 4.0, l2: float = 0.0):
        self.z, self.n = np.zeros(size + 1), np.zeros(size + 1)
        self.alpha, self.beta, self.l1, self.l2, self.bias = alpha, beta, l1, l2, size

    def weights(self, at: np.ndarray | None = None) -> np.ndarray:
        z, n = (self.z, self.n) if at is None else (self.z[at], self.n[at])
        return self._weights(z, np.sqrt(n))

    def _weights(self, z: np.ndarray, root: np.ndarray) -> np.ndarray:
        """The bias comes last and has no L1."""
        over = np.abs(z) - self.l1
        over[-1] = abs(z[-1])
        return -np.sign(z) * np.maximum(over, 0) / ((self.beta + root) / self.alpha + self.l2)

    def learn(self, coordinates: np.ndarray, label: float) -> None:
        at = np.append(coordinates, self.bias)
        z, n = self.z[at], self.n[at]
        root = np.sqrt(n)
        w = self._weights(z, root)
        g = 1 / (1 + np.exp(-np.clip(w.sum(), -35, 35))) - label
        n += g * g
        self.z[at] = z + g - (np.sqrt(n) - root) / self.alpha * w
        self.n[at] = n


def fit(labelled: DataFrame, bits: int = BITS, most: int = LABELLED, passes: int = 3, **rates) -> pd.DataFrame:
    """(coordinate, weight) that aren't zero, of a model of labelled (doc_id, text, label in 0 and 1); -1 is the bias.

    At most `most` rows, in the order of a hash of doc_id, are used; ties go by doc_id, then text. Rows with a null
    are left out. No rows give a bias that finds nothing toxic, one class alone gives its bias only.
    """
    some = labelled.dropna(subset=["doc_id", "text", "label"]).select("doc_id", F.lower("text").alias("text"), F.col("label").cast("double").alias("label"))
    some = some.orderBy(F.xxhash64("doc_id"), "doc_id", "text").limit(most)

    def train(t: pa.Table) -> pa.Table:
        t = t.take(pa.array(np.lexsort((t.column("doc_id").to_numpy(), t.column("mix").to_numpy()))))
        y = t.column("label").to_numpy()
        model, texts = Ftrl(1 << bits, **rates), t.column("text").combine_chunks()
        known = [d.astype(np.int32) for d in documents_of(texts, bits)]  # hashed once for all passes
        for _ in range(passes):
            for d, label in zip(known, y, strict=True):
                model.learn(d, label)
        w = model.weights()
        at = np.flatnonzero(w[:-1])
        return pa.table({"coordinate": np.append(at, -1), "weight": np.append(w[at], w[-1])})

    one = some.withColumn("mix", F.xxhash64("doc_id")).groupBy(F.lit(1).alias("one"))
    out = one.applyInArrow(train, "coordinate long, weight double").toPandas()
    return out if len(out) else pd.DataFrame({"coordinate": [-1], "weight": [-35.0]})


def score(docs: DataFrame, model: pd.DataFrame, bits: int = BITS) -> DataFrame:
    """(doc_id, score) of every row: the probability that the text is toxic; a null or wordless text has score 0."""
    inner = model[model.coordinate >= 0]
    bias = float(model.loc[model.coordinate < 0, "weight"].sum())
    at, weight = inner.coordinate.to_numpy(), inner.weight.to_numpy(np.float32)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        dense = np.zeros(1 << bits, np.float32)
        dense[at] = weight
        for batch in batches:
            out = np.zeros(batch.num_rows)
            for s in tx.slices(batch.column(1)):
                w = s.words(tx.MARKS, fold_case=True)
                c, owner = features(w, bits)
                value = dense[c]
                hit = np.flatnonzero(value)
                # a coordinate counts once in a document
                key = np.unique(owner[hit] << bits | c[hit])
                total = np.bincount(key >> bits, weights=dense[key & ((1 << bits) - 1)], minlength=len(s))
                out[s.first : s.first + len(s)] = np.where(w.counts > 0, 1 / (1 + np.exp(-np.clip(total + bias, -35, 35))), 0)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out)], ["doc_id", "score"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.lower("text").alias("text")).mapInArrow(run, "doc_id long, score double")


def toxic_documents(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD, **how) -> DataFrame:
    """(doc_id, score) of the documents of a score of at least `threshold`, by a model of labels (doc_id, toxic).

    Null ids keep their score under a null id; repeated rows are scored each; null and empty texts are never toxic.
    A label of a document that isn't there, or null, is left out; without labels nothing is toxic. Other columns,
    whatever their names, are not read.
    """
    known = labels.select(F.col("doc_id").alias("__id"), F.col("toxic").alias("label")).dropna().groupBy("__id").agg(F.max("label").alias("label"))
    labelled = docs.select("doc_id", "text").join(sample_of(known, how.get("most", LABELLED)), F.col("doc_id") == F.col("__id")).select("doc_id", "text", "label")
    return score(docs, fit(labelled, **how), how.get("bits", BITS)).filter(F.col("score") >= threshold)


def sample_of(known: DataFrame, most: int) -> DataFrame:
    """A bounded sample of labels by the order of a hash of their ids, small enough to be sent to every executor."""
    return F.broadcast(known.orderBy(F.xxhash64("__id"), "__id").limit(most))
