"""BM25 over token arrays, and the waterfall of phrase, all and any.

The index is a table (id, content_tokens, type_tokens); it can be kept beside the store or made on the way. A query's
terms are few and known when the plan is made, so a pass over the index counts each term's places with array
expressions, one row of corpus statistics is broadcast, and only the top rows of each pass move.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tesserae.functions import text as tx
from tesserae.functions.columns import once
from tesserae.operators.dml import first_of
from tesserae.session import written

K1, B = 1.2, 0.75
LEAST_IDF = 1e-6
CONTENT_WEIGHT, TYPE_WEIGHT = 1.0, 0.5


def index(memories: DataFrame) -> DataFrame:
    """(id, content_tokens, type_tokens)."""
    return once(memories, "id", content_tokens=tx.tokens(F.col("content")), type_tokens=tx.tokens(F.col("type")))


def places(tokens: Column, phrase: list[str]) -> Column:
    """How often the terms of a phrase stand one after another."""
    if len(phrase) == 1:
        return F.size(tokens) - F.size(F.array_remove(tokens, phrase[0]))
    if len(phrase) > 26:
        raise ValueError("a phrase has 26 terms at most")

    def same(z: Column) -> Column:
        return reduce(Column.__and__, (z[c] == t for c, t in zip("abcdefghijklmnopqrstuvwxyz", phrase, strict=False)))

    return F.size(F.filter(tx.shifted(tokens, len(phrase)), same))


def statistics(ix: DataFrame) -> DataFrame:
    """One row: the number of rows and the mean number of tokens."""
    return ix.agg(F.count(F.lit(1)).alias("n_rows"), F.avg(F.size("content_tokens") + F.size("type_tokens")).alias("mean_tokens"))


def matches(ix: DataFrame, phrases: list[list[str]], weights: tuple[float, float] = (CONTENT_WEIGHT, TYPE_WEIGHT)) -> DataFrame:
    """(id, c_0.., s_0..): for each phrase whether a row has it, and the part that it adds to the row's score.

    Statistics count every row of the index; rows that have no phrase are left out. The counts, a few numbers a row, are
    written to the shared folder: statistics and scores both read them, so texts are read and parted into tokens once.
    """
    cells = {"d": F.col("size") if "size" in ix.columns else F.size("content_tokens") + F.size("type_tokens")}
    for i, p in enumerate(phrases):
        cells |= {f"a_{i}": places(F.col("content_tokens"), p), f"b_{i}": places(F.col("type_tokens"), p)}
    counted = written(once(ix, "id", **cells), "counts")
    has = [(F.col(f"a_{i}") + F.col(f"b_{i}")) > 0 for i in range(len(phrases))]
    stats = counted.agg(F.count(F.lit(1)).alias("n"), F.avg("d").alias("mean"), *(F.count_if(h).alias(f"n_{i}") for i, h in enumerate(has)))
    rows = counted.filter(reduce(Column.__or__, has)).crossJoin(F.broadcast(stats))
    out = []
    for i, h in enumerate(has):
        k = F.col(f"n_{i}")
        raw = F.log((F.col("n") - k + 0.5) / (k + 0.5))
        idf = F.when(raw <= 0, LEAST_IDF).otherwise(raw)
        f = weights[0] * F.col(f"a_{i}") + weights[1] * F.col(f"b_{i}")
        out += [h.alias(f"c_{i}"), (idf * f * (K1 + 1) / (f + K1 * (1 - B + B * F.col("d") / F.col("mean")))).alias(f"s_{i}")]
    return rows.select("id", *out)


def passes(query: str) -> tuple[list[str], list[list[str]], list[tuple[list[int], str]]]:
    """(terms, phrases, passes): each pass is the numbers of its phrases and whether all or any must occur."""
    terms = tx.query_terms(query)
    plain = [t for t in tx.fold_terms(terms)]
    if not plain:
        return terms, [], []
    if len(plain) == 1:
        return terms, [plain], [([0], "all")]
    one = list(range(1, len(plain) + 1))
    return terms, [plain, *([t] for t in plain)], [([0], "all"), (one, "all"), (one, "any")]


def waterfall(ix: DataFrame, query: str, pool: int, weights: tuple[float, float] = (CONTENT_WEIGHT, TYPE_WEIGHT)) -> DataFrame | None:
    """(id, pass, bm25): the best `pool` rows of each pass, each id by its first pass; None without terms.

    A pass counts only if the passes before it found fewer than `pool` ids.
    """
    _, phrases, steps = passes(query)
    if not steps:
        return None
    found = matches(ix, phrases, weights)
    cells = []
    for n, (parts, how) in enumerate(steps):
        join = Column.__and__ if how == "all" else Column.__or__
        ok = reduce(join, (F.col(f"c_{i}") for i in parts))
        score = reduce(Column.__add__, (F.col(f"s_{i}") for i in parts))
        cells.append(F.when(ok, F.struct(F.lit(n).alias("pass"), score.alias("bm25"))))
    rows = found.select("id", F.explode(F.array_compact(F.array(*cells))).alias("p")).select("id", "p.pass", "p.bm25")
    rank = F.row_number().over(Window.partitionBy("pass").orderBy(F.desc("bm25"), "id"))
    # of each pass at most `pool` rows are left, so what they say together fits one task
    top, every = rows.withColumn("rank", rank).filter(F.col("rank") <= pool).drop("rank"), Window.partitionBy(F.lit(0))
    c0, c1 = F.count_if(F.col("pass") == 0).over(every), F.size(F.collect_set(F.when(F.col("pass") <= 1, F.col("id"))).over(every))
    use = (F.col("pass") == 0) | (F.col("c0") < pool) & ((F.col("pass") == 1) | (F.col("c1") < pool))
    return first_of(top.withColumns({"c0": c0, "c1": c1}).filter(use).select("id", "pass", "bm25"), ["id"], ["pass"])


def search_rows(memories: DataFrame, query: str, limit: int = 20, weights: tuple[float, float] = (1.0, 1.0)) -> DataFrame:
    """(id, type, content, strength, bm25): the rows that hold all terms, the best first, as the command line finds them.

    Words in double quotes are a phrase, OR between terms means any of them, and a trailing * any word that starts so.
    """
    ix = index(memories)
    groups = parsed(query)
    if not groups:
        return memories.select("id", "type", "content", "strength", F.lit(None).cast("double").alias("bm25")).limit(0)
    prefixes = {i: p for i, p in enumerate(x for g in groups for x in g) if p[-1].endswith("*")}
    if prefixes:
        ix = _with_prefixes(ix, [p[-1][:-1] for p in prefixes.values()])
    flat = [[t if not t.endswith("*") else f"*{t[:-1]}" for t in p] for g in groups for p in g]
    found = matches(ix, flat, weights)
    at, ok = 0, []
    for g in groups:
        ok.append(reduce(Column.__and__, (F.col(f"c_{at + i}") for i in range(len(g)))))
        at += len(g)
    score = reduce(Column.__add__, (F.col(f"s_{i}") for i in range(at)))
    top = found.filter(reduce(Column.__or__, ok)).select("id", score.alias("bm25")).orderBy(F.desc("bm25"), "id").limit(limit)
    return memories.select("id", "type", "content", "strength").join(F.broadcast(top), "id").orderBy(F.desc("bm25"), "id")


def _with_prefixes(ix: DataFrame, prefixes: list[str]) -> DataFrame:
    """The index, each token that starts with a prefix followed by a mark of that prefix of its own; places stay countable."""

    def hits(tokens: Column, prefix: str) -> Column:
        # lambdas of two parameters would get an element's place as the second
        return F.transform(F.filter(tokens, lambda t: F.startswith(t, F.lit(prefix))), lambda t: F.lit(f"*{prefix}"))

    def marked(tokens: Column) -> Column:
        return F.concat(tokens, *(hits(tokens, p) for p in prefixes))

    size = (F.size("content_tokens") + F.size("type_tokens")).alias("size")
    return ix.select("id", marked(F.col("content_tokens")).alias("content_tokens"), marked(F.col("type_tokens")).alias("type_tokens"), size)


def parsed(query: str) -> list[list[list[str]]]:
    """A query as alternatives of phrases that must all occur."""
    import re

    groups: list[list[list[str]]] = [[]]
    for quoted, word in re.findall(r'"([^"]*)"|(\S+)', query):
        if word == "OR":
            groups.append([])
        elif word != "AND":
            terms = tx.fold_terms(tx.query_terms(quoted or word))
            if terms:
                if not quoted and word.endswith("*"):
                    terms[-1] += "*"
                groups[-1].append(terms)
    return [g for g in groups if g]
