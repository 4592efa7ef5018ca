"""Whole Arrow batches of texts as flat numpy arrays: words, their hashes and n-grams without a loop over rows.

A word is a maximal run of bytes that a table of separators doesn't name. Hashes are polynomial prefix sums
modulo 2**64, so the hash of any span of bytes or words costs one subtraction and one product.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tesserae.session import unused, written

U = np.uint64
BASE = 0x9E3779B97F4A7C15
#: Bytes of text that are worked on at a time; a longer text is worked on alone.
SLICE_BYTES = 1 << 19

#: Separators of white-space words.
SPACES = np.zeros(256, bool)
SPACES[[9, 10, 11, 12, 13, 28, 29, 30, 31, 32]] = True
#: Separators of plain words: all ASCII but letters and digits.
MARKS = np.ones(256, bool)
MARKS[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = False

_values = np.random.default_rng(20240215).integers(1, 2**63, 256, dtype=np.uint64) * U(2) + U(1)
_folded = _values.copy()
_folded[65:91] = _values[97:123]
_powers: list[np.ndarray] = [np.ones(1, U), np.ones(1, U)]


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of BASE and of its inverse."""
    if len(_powers[0]) < n:
        m = max(n, SLICE_BYTES + 4096)
        for k, b in enumerate((BASE, pow(BASE, -1, 2**64))):
            p = np.full(m, U(b))
            p[0] = 1
            _powers[k] = np.multiply.accumulate(p)
    return _powers[0][:n], _powers[1][:n]


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit values."""
    x = x ^ (x >> U(30))
    x *= U(0xBF58476D1CE4E5B9)
    x ^= x >> U(27)
    x *= U(0x94D049BB133111EB)
    x ^= x >> U(31)
    return x


def prefix_sums(values: np.ndarray) -> np.ndarray:
    p, _ = powers(len(values))
    out = np.zeros(len(values) + 1, U)
    np.cumsum(values * p, out=out[1:])
    return out


def span_hashes(sums: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hashes of the spans [start, end) of the values behind `sums`; equal spans get equal hashes."""
    _, inverse = powers(len(sums))
    return mixed((sums[end] - sums[start]) * inverse[start] + U(BASE) * (end - start).astype(U))


class Slice:
    """Some texts in a row: flat bytes, offsets of the texts, and on demand their words."""

    def __init__(self, first: int, data: np.ndarray, offsets: np.ndarray):
        self.first, self.data, self.offsets = first, data, offsets

    def __len__(self) -> int:
        return len(self.offsets) - 1

    def words(self, separators: np.ndarray = SPACES, fold_case: bool = False) -> Words:
        return Words(self, separators, fold_case)


class Words:
    """start, end: bytes of each word; at: index of each text's first word, and their number at the end; hash."""

    def __init__(self, s: Slice, separators: np.ndarray, fold_case: bool):
        inside = ~separators[s.data]
        n = len(s.data)
        edge = np.zeros(n + 1, bool)
        edge[s.offsets] = True
        starts, ends = inside.copy(), inside
        if n:
            starts[1:] &= ~inside[:-1] | edge[1:n]
            ends = inside.copy()
            ends[:-1] &= ~inside[1:] | edge[1:n]
        self.start, self.end = np.flatnonzero(starts), np.flatnonzero(ends) + 1
        self.at = np.searchsorted(self.start, s.offsets)
        sums = prefix_sums((_folded if fold_case else _values)[s.data])
        self.hash = span_hashes(sums, self.start, self.end)

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.at)

    @property
    def text(self) -> np.ndarray:
        """The index of the text of each word."""
        return np.repeat(np.arange(len(self.at) - 1), self.counts)


def flat(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of an array of strings; a null is empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    if texts.null_count:
        texts = texts.fill_null("")
    kind = np.int64 if pa.types.is_large_string(texts.type) or pa.types.is_large_binary(texts.type) else np.int32
    if not len(texts):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, where, what = texts.buffers()
    offsets = np.frombuffer(where, kind)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    data = np.frombuffer(what, np.uint8) if what is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def slices(texts: pa.Array, most: int = SLICE_BYTES) -> Iterator[Slice]:
    """The texts of a batch in slices of bounded size; every text is whole."""
    data, offsets = flat(texts)
    first, n = 0, len(offsets) - 1
    while first < n:
        last = max(first + 1, int(np.searchsorted(offsets, offsets[first] + most, "right")) - 1)
        o = offsets[first : last + 1]
        yield Slice(first, data[o[0] : o[-1]], o - o[0])
        first = last


def ngrams(words: Words, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of n words of one text, and the index of the text of each.

    A text of fewer than n words, but of some, gives one hash of all its words.
    """
    count, h = words.counts, words.hash
    text = words.text
    if not len(h):
        return np.zeros(0, U), np.zeros(0, np.int64)
    sums = prefix_sums(h)
    begin = np.arange(len(h))
    stop = words.at[1:][text]
    ok = (begin + n <= stop) | ((count[text] < n) & (begin == words.at[:-1][text]))
    begin, text = begin[ok], text[ok]
    return span_hashes(sums, begin, np.minimum(begin + n, words.at[1:][text])), text


def slide(values: np.ndarray, width: int, f: np.ufunc) -> np.ndarray:
    """f (minimum or maximum) over each run of `width` values, by doubling."""
    out, span = values, 1
    while span * 2 <= width:
        out = f(out[:-span], out[span:])
        span *= 2
    return f(out[: len(out) - (width - span)], out[width - span :]) if span < width else out


def lists(values: np.ndarray, offsets: np.ndarray) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(values))


def unique_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs without rows of no id, each id once: of several rows with one id the smallest text stands, null last.

    Ids alone are counted first, so that texts move only where an id does repeat.
    """
    docs = docs.filter(F.col(id_col).isNotNull())
    key, row, n = (unused(c, docs) for c in ("id_", "row_", "n_"))
    ids = docs.groupBy(F.col(id_col).alias(key)).agg(F.count(F.lit(1)).alias(n)).filter(F.col(n) > 1).select(key)
    if ids.isEmpty():
        return docs
    same = F.col(id_col) == F.col(key)
    order = Window.partitionBy(id_col).orderBy(F.col(text_col).asc_nulls_last(), *other_columns(docs, id_col, text_col))
    # an exchange of its own: Spark 4.1 takes some unions for partitioned by id that aren't
    again = docs.join(ids, same, "left_semi").repartition(F.col(id_col)).withColumn(row, F.row_number().over(order)).filter(F.col(row) == 1).drop(row)
    return docs.join(ids, same, "left_anti").unionByName(again)


def without_ids(docs: DataFrame, ids: DataFrame, id_col: str = "doc_id", how: str = "left_anti") -> DataFrame:
    """docs without the rows of the ids (first column of `ids`), or with `how` left_semi those alone; any columns may be there.

    The ids are written first: where their files are small, Spark sends them to the documents and moves no text.
    """
    key = unused("id_", docs)
    return docs.join(written(ids.select(F.col(ids.columns[0]).alias(key)), "ids"), F.col(id_col) == F.col(key), how)


def other_columns(docs: DataFrame, *but: str) -> list[Column]:
    """The sortable columns besides those named, to order rows that are otherwise alike."""
    kinds = ("string", "bigint", "int", "double", "float", "boolean", "date", "timestamp", "smallint", "tinyint")
    return [F.col(f"`{c}`").asc_nulls_last() for c, t in docs.dtypes if c not in but and t in kinds]
