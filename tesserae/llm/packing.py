"""Cost-balanced packing: documents, largest first, each go to the cheapest sequence that has room.

The cost of n tokens is linear * n + quadratic * n * n, for attention inside a document. Documents are spread by a
hash of their ids over groups of about GROUP_TOKENS tokens, as many as the corpus needs, and each group is packed by
itself in one task, so the work of a task doesn't grow with the corpus. Only ids and counts move, never texts.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tesserae.llm import text as tx
from tesserae.llm.token_counts import PIECES, token_counts
from tesserae.session import written

CAPACITY = 4096
LINEAR, QUADRATIC = 1.0, 1.0 / 4096
GROUP_TOKENS = 8_000_000


def pack(tokens: np.ndarray, capacity: int = CAPACITY, linear: float = LINEAR, quadratic: float = QUADRATIC) -> np.ndarray:
    """The sequence of each piece; pieces come in descending order of tokens, none above the capacity.

    There are as many sequences as the tokens need at least, and one more whenever a piece fits nowhere. Of equally
    cheap sequences the first is taken.
    """
    n = max(1, -(-int(tokens.sum()) // capacity))
    cost, room = np.zeros(n + len(tokens)), np.full(n + len(tokens), capacity)
    out = np.empty(len(tokens), np.int64)
    for i, t in enumerate(tokens.tolist()):
        here = np.where(room[:n] >= t, cost[:n], np.inf)
        k = int(here.argmin())
        if here[k] == np.inf:
            k, n = n, n + 1
        cost[k] += linear * t + quadratic * t * t
        room[k] -= t
        out[i] = k
    return out


def packed(counts: DataFrame, capacity: int = CAPACITY, linear: float = LINEAR, quadratic: float = QUADRATIC, group_tokens: int = GROUP_TOKENS) -> DataFrame:
    """(doc_id, part, start_token, n_tokens, cost, sequence_id) for counts (doc_id, n_tokens).

    A document of more than `capacity` tokens is cut into parts of `capacity` and a rest. Documents without tokens
    go to a sequence as well. Equal sizes go by doc_id, then part. Rows of null doc_id or null count are left out;
    no rows give no rows. sequence_id is the group's number times 2**32 plus the sequence's in the group.
    """
    counts = written(counts.dropna(subset=["doc_id", "n_tokens"]), "token-counts")
    total = counts.agg(F.sum("n_tokens")).first()[0] or 0
    groups = max(1, -(-total // group_tokens))
    last = F.greatest(F.ceil(F.col("n_tokens") / capacity) - 1, F.lit(0)).cast("long")
    parts = counts.select(F.pmod(F.xxhash64("doc_id"), F.lit(groups)).alias("pack"), "doc_id", "n_tokens", F.explode(F.sequence(F.lit(0).cast("long"), last)).alias("part"))
    start = F.col("part") * capacity
    parts = parts.select("pack", "doc_id", F.col("part").cast("int").alias("part"), start.alias("start_token"), F.least(F.col("n_tokens") - start, F.lit(capacity)).cast("int").alias("size"))

    def run(t: pa.Table) -> pa.Table:
        size = t.column("size").to_numpy().astype(np.int64)
        doc, part = t.column("doc_id").to_numpy(), t.column("part").to_numpy()
        order = np.lexsort((part, doc, -size))
        size = size[order]
        sequence = pack(size, capacity, linear, quadratic) + (int(t.column("pack")[0].as_py()) << 32)
        start = t.column("start_token").to_numpy()[order]
        cost = linear * size + quadratic * size * size
        return pa.table({"doc_id": doc[order], "part": part[order], "start_token": start, "n_tokens": size, "cost": cost, "sequence_id": sequence})

    return parts.groupBy("pack").applyInArrow(run, "doc_id long, part int, start_token long, n_tokens long, cost double, sequence_id long")


def pack_documents(docs: DataFrame, path: str = PIECES, **how) -> DataFrame:
    """`packed` for docs (doc_id, text), of the tokens that `token_counts` gives each whole text.

    Of rows that repeat a doc_id the smallest text counts; a null text has no tokens. Other columns are not read.
    """
    docs = tx.unique_documents(docs.select("doc_id", "text"))
    return packed(token_counts(docs, path), **how)
