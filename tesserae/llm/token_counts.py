"""Token counts of a unigram tokenizer by a Viterbi that keeps counts only: no segmentation is ever built.

An Aho-Corasick automaton of the vocabulary enumerates all pieces that end at each character; the best score and the
number of pieces on the way to it go along. Texts are normalized as the model file says: one mark before the text, each
space a mark, and all other white space as it is, by its own piece or by its bytes. A text is cut only where no piece
can lie across, before a run of marks and around newlines, so the best path of a text is that of its runs, white space
with them, and each distinct run of a batch is worked out once.

Tie rules are those of the tokenizer: scores add up from the left in double precision, a path gives way only to a
strictly better one, and of equal paths that with the earliest start of its last piece stays. A character that is no
piece by itself costs the lowest score less 10 and counts its UTF-8 bytes, which are the pieces it falls back to.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tesserae.llm import text as tx

PIECES = "/opt/tokenizers/piece_bpe_32k.model"
MARK = "▁"
UNKNOWN = 10.0
#: Runs whose counts a worker remembers; when there are more it starts afresh.
REMEMBERED = 400_000


def vocabulary(path: str = PIECES) -> list[tuple[str, float]]:
    """(piece, score) of the ordinary pieces of a sentencepiece file; its scores are taken for unigram scores."""
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    return [(sp.id_to_piece(i), sp.get_score(i)) for i in range(sp.get_piece_size()) if not (sp.is_unknown(i) or sp.is_control(i) or sp.is_byte(i) or sp.is_unused(i))]


class Counter:
    """Numbers of pieces of runs of text."""

    def __init__(self, pieces: list[tuple[str, float]]):
        import ahocorasick

        self.automaton = ahocorasick.Automaton()
        for piece, score in pieces:
            self.automaton.add_word(piece, (len(piece), score))
        self.automaton.make_automaton()
        self.unknown = min((s for _, s in pieces), default=0.0) - UNKNOWN
        self.single = {p for p, _ in pieces if len(p) == 1}
        #: No piece has a newline, or a mark behind another character.
        self.cuts = not any("\n" in p or MARK in p.lstrip(MARK) for p, _ in pieces)
        self.known: dict[str, int] = {}

    def count(self, word: str) -> int:
        n = len(word)
        score: list[float | None] = [None] * (n + 1)
        pieces = [0] * (n + 1)
        start = [0] * (n + 1)
        score[0] = 0.0
        at = 0

        def close(end: int) -> None:
            # a character that is no piece may be reached as unknown, from right before it
            c = word[end - 1]
            if c not in self.single and score[end - 1] is not None:
                s = score[end - 1] + self.unknown
                if score[end] is None or s > score[end]:
                    score[end], pieces[end], start[end] = s, pieces[end - 1] + len(c.encode()), end - 1

        for last, (length, value) in self.automaton.iter(word):
            end = last + 1
            while at < last:
                at += 1
                close(at)
            begin = end - length
            if score[begin] is None:
                continue
            s = score[begin] + value
            if score[end] is None or s > score[end] or (s == score[end] and begin < start[end]):
                score[end], pieces[end], start[end] = s, pieces[begin] + 1, begin
        while at < n:
            at += 1
            close(at)
        return pieces[n]

    def counts(self, runs: list[str]) -> np.ndarray:
        known = self.known
        if len(known) > REMEMBERED:
            known.clear()
        out = np.empty(len(runs), np.int64)
        for i, r in enumerate(runs):
            n = known.get(r)
            if n is None:
                n = known[r] = self.count(r.replace(" ", MARK))
            out[i] = n
        return out


_counters: dict[int, Counter] = {}


def counter_of(name: int, pieces: list[tuple[str, float]]) -> Counter:
    """The worker's counter of a vocabulary, made once."""
    if name not in _counters:
        _counters.clear()
        _counters[name] = Counter(pieces)
    return _counters[name]


def split(texts: pa.Array, cuts: bool = True) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """The runs of texts, the offsets of each text's runs, and the number of newlines of each text, which no run has.

    A run goes from a run of spaces or marks, or a newline, to the next; the space that the tokenizer sets before a text
    is in its first. Null and empty texts have none. Without cuts each text is one run, newlines and all.
    """
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = texts.fill_null("")
    whole = pc.if_else(pc.equal(pc.binary_length(texts), 0), "", pc.binary_join_element_wise(" ", texts, ""))
    if cuts:
        newlines = pc.count_substring(texts, "\n").to_numpy(zero_copy_only=False).astype(np.int64)
        # a newline before each space; those inside a run of spaces go again, in two rounds as matches can't overlap
        marked = pc.replace_substring(pc.replace_substring(whole, MARK, " "), " ", "\n ")
        for _ in range(2):
            marked = pc.replace_substring(marked, " \n ", "  ")
        found = pc.split_pattern(marked, "\n")
        runs, offsets = found.flatten(), found.offsets.to_numpy().astype(np.int64)
        offsets = offsets - offsets[0]
    else:
        runs, offsets, newlines = whole, np.arange(len(whole) + 1), np.zeros(len(whole), np.int64)
    # newlines at either end or next to each other leave empty runs, as do empty texts
    full = pc.greater(pc.binary_length(runs), 0)
    if pc.all(full).as_py() is False:
        kept = np.r_[0, np.cumsum(full.to_numpy(zero_copy_only=False))]
        runs, offsets = runs.filter(full), kept[offsets]
    return runs, offsets, newlines


def token_counts(docs: DataFrame, path: str = PIECES) -> DataFrame:
    """(doc_id, n_tokens) of every row of docs (doc_id, text).

    Null and empty texts have 0 tokens, white space counts like any text; null ids keep their count under a null id; repeated
    rows are counted each. Other columns are not read. The vocabulary (about 1 MB, whatever the data) goes along with
    the tasks.
    """
    pieces = vocabulary(path)
    shared = docs.sparkSession.sparkContext.broadcast(pieces)
    name = hash(tuple(pieces))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = counter_of(name, shared.value)
        newline = counter.count("\n")
        for batch in batches:
            out = np.zeros(batch.num_rows, np.int64)
            for s in tx.slices(batch.column(1), 16 * tx.SLICE_BYTES):
                runs, offsets, newlines = split(batch.column(1).slice(s.first, len(s)), counter.cuts)
                if not len(runs):
                    continue
                coded = runs.dictionary_encode()
                each = counter.counts(coded.dictionary.to_pylist())[coded.indices.to_numpy()]
                total = np.r_[0, np.cumsum(each)]
                out[s.first : s.first + len(s)] = np.diff(total[offsets]) + newlines * newline
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out)], ["doc_id", "n_tokens"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id long, n_tokens long")
