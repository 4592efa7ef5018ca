"""BPE encoding and decoding through a minimal acyclic transducer of frequent words, with exact merges for the rest.

One scan counts the words of all texts; the most frequent ones, LEXICON at most, are merged once on the driver and compiled
into a minimal automaton, whose states are shared by all words with the same endings. Its arcs carry numbers that add
up to a word's rank in the sorted lexicon, and the rank finds the word's ids in a flat table. The automaton is a file
in the shared folder that Spark hands to each executor once and its workers map into memory. A second scan looks up
the distinct words of each slice in lockstep, a byte a step, and merges only those that the lexicon lacks. The lexicon
changes the speed alone: ids are those of the merges, whatever it holds.
"""

from __future__ import annotations

import base64
import heapq
import uuid
from collections import Counter
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import SparkFiles
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tesserae.llm import text as tx
from tesserae.session import dropped, shared_dir, written

RANKS = "/opt/tokenizers/byte_bpe_50k.tiktoken"
PATTERN = r"'(?:s|t|re|ve|m|ll|d)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Words of the automaton at most, and the bytes of the longest.
LEXICON, WORD_BYTES = 65_536, 48
#: Distinct words that a counting task holds before it hands them on, and merged words that a worker remembers.
HELD, REMEMBERED = 300_000, 200_000
#: Words of more bytes than this are merged with a heap.
LONG = 64


def read_ranks(path: str = RANKS) -> dict[bytes, int]:
    """Ranks of byte strings, of lines of base64 and number; a rank is also the id."""
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


def merge(word: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Ids of a word: the adjacent pair of least rank merges first, of equal ranks the leftmost."""
    if len(word) > LONG:
        return _merge_long(word, ranks)
    parts = [word[i : i + 1] for i in range(len(word))]
    pair = [ranks.get(a + b) for a, b in zip(parts, parts[1:], strict=False)]
    while True:
        best, at = None, -1
        for i, r in enumerate(pair):
            if r is not None and (best is None or r < best):
                best, at = r, i
        if best is None:
            return [ranks[p] for p in parts]
        parts[at : at + 2] = [parts[at] + parts[at + 1]]
        del pair[at]
        if at < len(pair):
            pair[at] = ranks.get(parts[at] + parts[at + 1])
        if at:
            pair[at - 1] = ranks.get(parts[at - 1] + parts[at])


def _merge_long(word: bytes, ranks: dict[bytes, int]) -> list[int]:
    n = len(word)
    end = list(range(1, n + 1))  # of the part that starts here; 0 where none starts any more
    before = list(range(-1, n - 1))
    heap = [(r, i, i + 2) for i in range(n - 1) if (r := ranks.get(word[i : i + 2])) is not None]
    heapq.heapify(heap)
    while heap:
        _, i, stop = heapq.heappop(heap)
        j = end[i]
        if not j or j >= n or end[j] != stop:
            continue
        end[i], end[j] = stop, 0
        if stop < n:
            before[stop] = i
            if (r := ranks.get(word[i : end[stop]])) is not None:
                heapq.heappush(heap, (r, i, end[stop]))
        k = before[i]
        if k >= 0 and (r := ranks.get(word[k:stop])) is not None:
            heapq.heappush(heap, (r, k, stop))
    out, i = [], 0
    while i < n:
        out.append(ranks[word[i : end[i]]])
        i = end[i]
    return out


class Lexicon:
    """A minimal acyclic transducer from words to lists of ids, as six arrays in one buffer.

    keys: state * 256 + byte of each arc, sorted; to: its target; add: what it adds to the rank; final: whether words
    end in each state; offsets, ids: the ids of the word of each rank. The first state is the last one.
    """

    KINDS = (np.int64, np.int32, np.int32, np.uint8, np.int64, np.int32)

    def __init__(self, arrays: list[np.ndarray]):
        self.keys, self.to, self.add, self.final, self.offsets, self.ids = arrays
        self.root = len(self.final) - 1

    @classmethod
    def build(cls, entries: dict[bytes, list[int]]) -> Lexicon:
        """Adds the words in sorted order; the path of the last word stays open, what it leaves is shared at once."""
        words = sorted(entries)
        known: dict[tuple, int] = {}
        final: list[int] = []
        arcs: list[tuple[tuple[int, int], ...]] = []

        def close(ends: bool, out: list[tuple[int, int]]) -> int:
            key = (ends, *out)
            if key not in known:
                known[key] = len(final)
                final.append(int(ends))
                arcs.append(tuple(out))
            return known[key]

        path: list[list] = [[False, []]]  # (ends, closed arcs) of the open states; the arc between two is its word's byte
        last = b""
        for word in [*words, None]:
            same = 0
            if word is not None:
                top = min(len(word), len(last))
                while same < top and word[same] == last[same]:
                    same += 1
            while len(path) - 1 > same:
                ends, out = path.pop()
                path[-1][1].append((last[len(path) - 1], close(ends, out)))
            if word is None:
                break
            path += [[False, []] for _ in word[same:]]
            path[-1][0] = True
            last = word
        final.append(int(path[0][0]))  # the first state is never shared
        arcs.append(tuple(path[0][1]))
        below = [0] * len(final)  # words that end at or below each state; targets come before their sources
        keys, to, add = [], [], []
        for s, out in enumerate(arcs):
            n = final[s]
            for byte, target in out:
                keys.append(s << 8 | byte)
                to.append(target)
                add.append(n)
                n += below[target]
            below[s] = n
        lists = [entries[w] for w in words]
        offsets = np.zeros(len(words) + 1, np.int64)
        np.cumsum([len(x) for x in lists], out=offsets[1:])
        parts = (keys, to, add, final, offsets, [i for x in lists for i in x])
        return cls([np.array(x, k) for x, k in zip(parts, cls.KINDS, strict=True)])

    def dump(self) -> bytes:
        parts = [self.keys, self.to, self.add, self.final, self.offsets, self.ids]
        body = [np.array([len(p) for p in parts], np.int64).tobytes()]
        return b"".join(body + [p.tobytes() + bytes(-p.nbytes % 8) for p in parts])

    @classmethod
    def mapped(cls, path: str) -> Lexicon:
        """The lexicon of a file, mapped into memory: workers of one machine share its pages."""
        raw = np.memmap(path, np.uint8, "r")
        sizes, at, parts = raw[:48].view(np.int64), 48, []
        for n, kind in zip(sizes.tolist(), cls.KINDS, strict=True):
            width = n * np.dtype(kind).itemsize
            parts.append(raw[at : at + width].view(kind))
            at += width + -width % 8
        return cls(parts)

    def find(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """The rank of each word (bytes of data between offsets), or -1."""
        n = len(offsets) - 1
        size = np.diff(offsets)
        out = np.full(n, -1, np.int64)
        if not len(self.keys):
            return out
        at = np.flatnonzero((size <= WORD_BYTES) & (size > 0))
        state, rank = np.full(len(at), self.root, np.int64), np.zeros(len(at), np.int64)
        step = 0
        while len(at):
            key = state << 8 | data[offsets[at] + step]
            arc = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
            ok = self.keys[arc] == key
            at, arc, rank = at[ok], arc[ok], rank[ok]
            state, rank = self.to[arc].astype(np.int64), rank + self.add[arc]
            step += 1
            over = size[at] == step
            full = over & (self.final[state] == 1)
            out[at[full]] = rank[full]
            at, state, rank = at[~over], state[~over], rank[~over]
        return out


def _splitter():
    import regex

    return regex.compile(PATTERN).findall


def word_counts(docs: DataFrame, longest: int = WORD_BYTES) -> DataFrame:
    """(word, n): how often each word of at most `longest` bytes occurs in all texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        split, held = _splitter(), Counter()

        def handed() -> pa.RecordBatch:
            words = pa.array(list(held), pa.string())
            return pa.RecordBatch.from_arrays([words, pa.array(held.values(), pa.int64())], ["word", "n"])

        for batch in batches:
            for s in tx.slices(batch.column(0)):
                for t in batch.column(0).slice(s.first, len(s)).to_pylist():
                    if t:
                        held.update(split(t))
                if len(held) > HELD:
                    yield handed()
                    held.clear()
        yield handed()

    part = docs.select(F.col("text").cast("string").alias("text")).mapInArrow(run, "word string, n long")
    return part.filter(F.octet_length("word") <= longest).groupBy("word").agg(F.sum("n").alias("n"))


def _step(n: Column) -> Column:
    """The step of a count: the count itself up to 64, then 64 steps for each power of two, so a few thousand at most."""
    return F.when(n <= 64, n).otherwise(F.floor(F.log2(n) * 64) - 320).cast("int")


def frequent_words(docs: DataFrame, most: int = LEXICON) -> list[str]:
    """The words that occur most often, at most `most`: all of the highest steps of counts that fit together.

    Words that occur once are not among them. Only a histogram of the steps and the words themselves come to the driver.
    """
    counts = written(word_counts(docs).filter("n > 1"), "word-counts")
    sizes = {r["step"]: r["k"] for r in counts.groupBy(_step(F.col("n")).alias("step")).agg(F.count(F.lit(1)).alias("k")).collect()}
    least, taken = None, 0
    for step in sorted(sizes, reverse=True):
        taken += sizes[step]
        if taken > most:
            break
        least = step
    words = [] if least is None else [r["word"] for r in counts.filter(_step(F.col("n")) >= least).select("word").collect()]
    dropped(counts)
    return sorted(words)


def shipped(spark, lexicon: Lexicon) -> str:
    """Writes the lexicon into the shared folder, from where Spark brings it to each executor; its file's name."""
    name = f"lexicon-{uuid.uuid4().hex}.fst"
    where = f"{shared_dir(spark).rstrip('/')}/{name}"
    path = spark._jvm.org.apache.hadoop.fs.Path(where)
    out = path.getFileSystem(spark._jsc.hadoopConfiguration()).create(path, True)
    out.write(bytearray(lexicon.dump()))
    out.close()
    spark.sparkContext.addFile(where)
    return name


class Encoder:
    """Ids of texts, and texts of ids; lexicon may be None."""

    def __init__(self, ranks: dict[bytes, int], lexicon: Lexicon | None = None):
        self.ranks, self.lexicon, self.split = ranks, lexicon, _splitter()
        self.merged: dict[str, list[int]] = {}
        top = max(ranks.values(), default=-1) + 1
        pieces = [b""] * top
        for piece, rank in ranks.items():
            pieces[rank] = piece
        self.size = np.array([len(p) for p in pieces], np.int64)
        self.begin = np.r_[0, np.cumsum(self.size)][:-1]
        self.bytes = np.frombuffer(b"".join(pieces), np.uint8)

    def encode(self, texts: Iterable[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """All ids one after another, and each text's offset in them."""
        words, counts = [], []
        for t in texts:
            found = self.split(t) if t else ()
            words += found
            counts.append(len(found))
        at = np.r_[0, np.cumsum(counts, dtype=np.int64)]
        if not words:
            return np.zeros(0, np.int32), at
        coded = pa.array(words, pa.large_string()).dictionary_encode()
        distinct, index = coded.dictionary, coded.indices.to_numpy()
        data, offsets = tx.flat(distinct)
        rank = self.lexicon.find(data, offsets) if self.lexicon is not None else np.full(len(distinct), -1, np.int64)
        new = np.flatnonzero(rank < 0)
        extra = self._merge(distinct.take(pa.array(new)).to_pylist())
        # ids of the lexicon, then those of the merged words
        table = np.concatenate([self.lexicon.ids if self.lexicon is not None else np.zeros(0, np.int32), np.array([i for x in extra for i in x], np.int32)])
        begin, size = np.zeros(len(distinct), np.int64), np.zeros(len(distinct), np.int64)
        old = rank >= 0
        if old.any():
            begin[old] = self.lexicon.offsets[rank[old]]
            size[old] = self.lexicon.offsets[rank[old] + 1] - begin[old]
        size[new] = [len(x) for x in extra]
        begin[new] = len(table) - size[new].sum() + np.r_[0, np.cumsum(size[new])][:-1]
        ids, where = _gathered(table, begin[index], size[index])
        return ids, where[at]

    def _merge(self, words: list[str]) -> list[list[int]]:
        known, out = self.merged, []
        if len(known) > REMEMBERED:
            known.clear()
        for w in words:
            ids = known.get(w)
            if ids is None:
                ids = merge(w.encode(), self.ranks)
                if len(ids) <= LONG:
                    known[w] = ids
            out.append(ids)
        return out

    def decode(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The bytes of ids, and the offset of each id's."""
        return _gathered(self.bytes, self.begin[ids], self.size[ids])


def _gathered(table: np.ndarray, begin: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The stretches of a table, one after another, and their offsets."""
    where = np.r_[0, np.cumsum(size)]
    return table[np.arange(where[-1]) + np.repeat(begin - where[:-1], size)], where


_encoders: dict[tuple, Encoder] = {}


def _encoder(ranks: str, lexicon: str | None) -> Encoder:
    """A worker's encoder; ranks: the vocabulary file's path, the same on every executor."""
    if (ranks, lexicon) not in _encoders:
        _encoders.clear()
        _encoders[ranks, lexicon] = Encoder(read_ranks(ranks), Lexicon.mapped(SparkFiles.get(lexicon)) if lexicon else None)
    return _encoders[ranks, lexicon]


def encoded(docs: DataFrame, path: str = RANKS, lexicon_words: int = LEXICON) -> DataFrame:
    """(doc_id, n_tokens, token_ids, exact) of every row of docs (doc_id, text); exact: the ids decode to the text.

    A null text has null ids, null exact and 0 tokens, an empty one an empty list; null doc_ids keep their ids; repeated
    rows are encoded each. Strings of special tokens are ordinary text. Other columns are not read. An empty table
    gives no rows.
    """
    spark = docs.sparkSession
    ranks = read_ranks(path)
    words = frequent_words(docs, lexicon_words) if lexicon_words else []
    name = shipped(spark, Lexicon.build({w.encode(): merge(w.encode(), ranks) for w in words})) if words else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(path, name)
        for batch in batches:
            for s in tx.slices(batch.column(1)):
                texts = batch.column(1).slice(s.first, len(s))
                ids, at = encoder.encode(texts.to_pylist())
                data, where = encoder.decode(ids)
                if np.array_equal(where[at], s.offsets) and np.array_equal(data, s.data):
                    exact = np.ones(len(s), bool)
                else:
                    exact = np.array([np.array_equal(data[where[a] : where[b]], s.data[i:j]) for a, b, i, j in zip(at, at[1:], s.offsets, s.offsets[1:], strict=False)])
                null = texts.is_null().to_numpy(zero_copy_only=False)
                lists = pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), pa.array(ids.astype(np.int32)), mask=pa.array(null))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(s.first, len(s)), pa.array(np.diff(at)), lists, pa.array(exact, mask=null)], ["doc_id", "n_tokens", "token_ids", "exact"])

    columns = (F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return docs.select(*columns).mapInArrow(run, "doc_id long, n_tokens long, token_ids array<int>, exact boolean")


def decoded(tokens: DataFrame, path: str = RANKS) -> DataFrame:
    """(doc_id, text) of tokens (doc_id, token_ids); null ids give a null text, an empty list an empty one.

    Bytes that aren't UTF-8, as in a list that was cut inside a character, become U+FFFD. Ids outside the vocabulary
    and null ids in a list stand for nothing.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(path, None)
        for batch in batches:
            out = []
            for ids in batch.column(1):
                if not ids.is_valid:
                    out.append(None)
                    continue
                known = ids.values.drop_null().to_numpy(zero_copy_only=False)
                known = known[(known >= 0) & (known < len(encoder.size))]
                out.append(encoder.decode(known)[0].tobytes().decode("utf-8", "replace"))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.string())], ["doc_id", "text"])

    return tokens.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("token_ids").cast("array<int>").alias("token_ids")).mapInArrow(run, "doc_id long, text string")
