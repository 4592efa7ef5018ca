"""Search, recall, browsing and similarity."""

from __future__ import annotations

from pyspark.sql import functions as F

from tesserae.functions import scoring, vectors
from tesserae.operators import lexical, retrieval, scans
from tesserae.plans import consolidation
from tesserae.queries.prelude import NOW, sql
from tesserae.sources import fixtures as fx

TEXT, ONE = "and the with", "und"
LIMIT = 20


def _vector(spark, d):
    row = fx.table(spark, d, "embeddings").filter("vec_id = 7").select(F.col("embedding").cast("array<double>").alias("e")).first()
    return list(row["e"])


def browse_scores(spark, d):
    """The flagship: strong and recent memories."""
    m = fx.memories_with_docs(spark, d).filter("strength > 0.05").select("doc_id", "id", F.round(scoring.broad(F.col("strength"), F.col("created_at"), fx.now()), 6).alias("score"))
    return m.orderBy(F.desc("score"), "id").limit(20)


def corpus_statistics(spark, d):
    return lexical.statistics(lexical.index(fx.memories_with_docs(spark, d))).select(F.col("n_rows"), F.round("mean_tokens", 6).alias("mean_tokens"))


def bm25(spark, d):
    ix = lexical.index(fx.memories_with_docs(spark, d))
    terms = [[t] for t in TEXT.split()]
    rows = lexical.matches(ix, [TEXT.split(), *terms])
    return rows.select("id", F.col("c_0").alias("phrase"), F.round("s_0", 6).alias("phrase_score"), F.round(F.col("s_1") + F.col("s_2") + F.col("s_3"), 6).alias("any_score"))


def waterfall(spark, d):
    rows = lexical.waterfall(lexical.index(fx.memories_with_docs(spark, d)), TEXT, LIMIT * 8)
    return rows.select("id", "pass", F.round("bm25", 6).alias("bm25"))


def cosine_scan(spark, d):
    v = vectors.literal(_vector(spark, d))
    return fx.embeddings(spark, d).select("id", F.round(vectors.cosine(F.col("embedding"), v), 6).alias("cosine"))


def search_words(spark, d):
    return retrieval.search(fx.store(spark, d), TEXT, LIMIT, fx.now()).select("id", F.round("score", 6).alias("score"))


def search_hybrid(spark, d):
    return retrieval.search(fx.store(spark, d), TEXT, LIMIT, fx.now(), _vector(spark, d)).select("id", F.round("score", 6).alias("score"))


def recall(spark, d):
    return retrieval.recall(fx.store(spark, d), TEXT, LIMIT, fx.now(), _vector(spark, d)).select("id", F.round("score", 6).alias("score"))


def cli_search(spark, d):
    return lexical.search_rows(fx.memories_with_docs(spark, d), ONE, 20).select("id", F.round("bm25", 6).alias("bm25"))


def browse(spark, d):
    return retrieval.browse(fx.store(spark, d), 15, fx.now()).select("position", "id", F.round("score", 6).alias("score"))


def seeds_edges(spark, d):
    return scans.top_associations(fx.associations(spark, d), fx.memories_with_docs(spark, d).select("id"), 0.15, 5).select("node", F.round("weight", 6).alias("weight"))


def _candidates(spark, d, since):
    out = consolidation.candidates(fx.store(spark, d), since, 0.3)
    return out.select("a", "b", F.round("jaccard", 6).alias("jaccard"), F.round("cosine", 6).alias("cosine"), F.round("score", 6).alias("score"))


def merge_candidates(spark, d):
    """Those of a first run: the strongest memories against the targets."""
    return _candidates(spark, d, None)


def merge_candidates_delta(spark, d):
    """Those of a later run: memories that are new or were shown against the targets."""
    return _candidates(spark, d, fx.last())


def _occ(tokens, term):
    return f"len(list_filter({tokens}, lambda x: x = '{term}'))"


def _phrase(tokens, terms):
    zipped = ", ".join(f"{tokens}[{i + 1}:]" for i in range(len(terms)))
    same = " AND ".join(f"z[{i + 1}] = '{t}'" for i, t in enumerate(terms))
    return f"len(list_filter(list_zip({zipped}, true), lambda z: {same}))"


def _scores(phrases, a=1.0, b=0.5):
    """CTEs: counts of each phrase, their numbers of rows, and scores s0.. with matches c0.."""
    count = ", ".join(f"{_phrase('ct', p) if len(p) > 1 else _occ('ct', p[0])} AS a{i}, {_phrase('tt', p) if len(p) > 1 else _occ('tt', p[0])} AS b{i}" for i, p in enumerate(phrases))
    n = ", ".join(f"count(*) FILTER (a{i} + b{i} > 0) AS n{i}" for i in range(len(phrases)))
    idf = lambda i: f"CASE WHEN ln((n - n{i} + 0.5) / (n{i} + 0.5)) > 0 THEN ln((n - n{i} + 0.5) / (n{i} + 0.5)) ELSE 0.000001 END"
    score = ", ".join(f"a{i} + b{i} > 0 AS c{i}, {idf(i)} * ({a} * a{i} + {b} * b{i}) * 2.2 / ({a} * a{i} + {b} * b{i} + 1.2 * (0.25 + 0.75 * dl / mean)) AS s{i}" for i in range(len(phrases)))
    return {"q_cnt": f"SELECT id, strength, created_at, content, len(ct) + len(tt) AS dl, {count} FROM t_tok", "q_n": f"SELECT count(*) AS n, avg(dl) AS mean, {n} FROM q_cnt", "q_s": f"SELECT id, strength, created_at, content, {score} FROM q_cnt, q_n"}


T = TEXT.split()
FOUR = _scores([T, *([t] for t in T)])
WATER = lambda pool: FOUR | {
    "q_p0": f"SELECT id, s0 AS r FROM q_s WHERE c0 ORDER BY s0 DESC, id LIMIT {pool}",
    "q_p1": f"SELECT id, s1 + s2 + s3 AS r FROM q_s WHERE c1 AND c2 AND c3 AND (SELECT count(*) FROM q_p0) < {pool} ORDER BY s1 + s2 + s3 DESC, id LIMIT {pool}",
    "q_p2": f"SELECT id, s1 + s2 + s3 AS r FROM q_s WHERE (c1 OR c2 OR c3) AND (SELECT count(*) FROM (SELECT id FROM q_p0 UNION SELECT id FROM q_p1)) < {pool} ORDER BY s1 + s2 + s3 DESC, id LIMIT {pool}",
    "q_w": "SELECT id, arg_min(r, p) AS r, min(p) AS p FROM (SELECT id, r, 0 AS p FROM q_p0 UNION ALL SELECT id, r, 1 FROM q_p1 UNION ALL SELECT id, r, 2 FROM q_p2) GROUP BY id",
}
VEC = "(SELECT embedding FROM embeddings WHERE vec_id = 7)::DOUBLE[]"
HYBRID = WATER(LIMIT * 4) | {"q_h": f"SELECT m.id, (0.6 * coalesce(list_cosine_similarity(e.embedding::DOUBLE[], {VEC}), 0) + 0.4 * coalesce(r / (1 + r), 0)) * strength AS score FROM t_mem m LEFT JOIN t_emb e ON e.id = m.id LEFT JOIN q_w w ON w.id = m.id WHERE e.id IS NOT NULL OR w.id IS NOT NULL ORDER BY score DESC, m.id LIMIT {LIMIT}"}
RECALL = HYBRID | {
    "q_e": "SELECT node, neighbour, weight * score * 0.6 AS act FROM q_h JOIN t_dir ON node = id WHERE score >= 0.3 AND weight >= 0.15 QUALIFY row_number() OVER (PARTITION BY node ORDER BY weight DESC, neighbour) <= 5",
    "q_a": "SELECT id, (1 - product(1 - act)) * any_value(strength) AS score FROM q_e JOIN t_mem ON id = neighbour WHERE strength >= 0.1 AND neighbour NOT IN (SELECT id FROM q_h) GROUP BY id",
}
FEATS = "list_distinct(w || list_transform(list_zip(w, w[2:], w[3:], true), lambda z: array_to_string(list_sort([z[1], z[2], z[3]]), ' ')))"
PAIRS = {
    "q_f": f"SELECT m.id, type, strength, created_at, e.embedding::DOUBLE[] AS v, {FEATS} AS f FROM (SELECT *, list_filter(regexp_split_to_array(regexp_replace(lower(content), '[^\\p{{L}}\\p{{N}}\\s]+', ' ', 'g'), '\\s+'), lambda x: x <> '') AS w FROM t_mem WHERE strength >= 0.3) m LEFT JOIN t_emb e ON e.id = m.id",
}
COMPARED = "SELECT least(a.id, b.id) AS a, greatest(a.id, b.id) AS b, len(list_intersect(a.f, b.f))::DOUBLE / greatest(1, len(a.f) + len(b.f) - len(list_intersect(a.f, b.f))) AS j, CASE WHEN a.v IS NOT NULL AND b.v IS NOT NULL THEN greatest(0, list_cosine_similarity(a.v, b.v)) END AS c FROM q_src b JOIN q_tgt a ON a.type = b.type AND {on}"
BEST = "SELECT a, b, round(j, 6) AS jaccard, round(c, 6) AS cosine, round(coalesce(0.4 * j + 0.6 * c, j), 6) AS score FROM (SELECT DISTINCT * FROM q_cmp) WHERE CASE WHEN c IS NULL THEN j >= 0.6 ELSE 0.4 * j + 0.6 * c >= 0.5 END ORDER BY round(coalesce(0.4 * j + 0.6 * c, j), 12) DESC, a, b LIMIT 20"
LAST = "TIMESTAMP '2024-01-25 00:00:00'"

QUERIES = {
    "browse_scores": (browse_scores, sql(f"SELECT doc_id, id, round(0.8 * strength + 0.2 * exp(-date_diff('hour', created_at, {NOW}) / 720.0::DOUBLE), 6) AS score FROM t_mem WHERE strength > 0.05 ORDER BY score DESC, id LIMIT 20")),
    "ag_corpus_statistics": (corpus_statistics, sql("SELECT count(*) AS n_rows, round(avg(len(ct) + len(tt)), 6) AS mean_tokens FROM t_tok")),
    "fn_bm25": (bm25, sql("SELECT id, c0 AS phrase, round(s0, 6) AS phrase_score, round(s1 + s2 + s3, 6) AS any_score FROM q_s WHERE c1 OR c2 OR c3", **FOUR)),
    "wn_waterfall": (waterfall, sql("SELECT id, p::INT AS pass, round(r, 6) AS bm25 FROM q_w", **WATER(LIMIT * 8))),
    "jn_vector_scan": (cosine_scan, sql(f"SELECT id, round(list_cosine_similarity(embedding::DOUBLE[], {VEC}), 6) AS cosine FROM t_emb")),
    "cq_search_words": (search_words, sql(f"SELECT m.id, round(r / (1 + r) * ((contains(lower(content), '{T[0]}')::INT + contains(lower(content), '{T[1]}')::INT + contains(lower(content), '{T[2]}')::INT) / 3.0::DOUBLE) ** 2 * exp(-epoch({NOW} - created_at) / 86400 / 180) * strength, 6) AS score FROM q_w JOIN t_mem m ON m.id = q_w.id ORDER BY score DESC, m.id LIMIT {LIMIT}", **WATER(LIMIT * 8))),
    "cq_search_hybrid": (search_hybrid, sql("SELECT id, round(score, 6) AS score FROM q_h", **HYBRID)),
    "cq_recall": (recall, sql(f"SELECT id, round(score, 6) AS score FROM (SELECT id, score FROM q_h UNION ALL SELECT id, score FROM q_a) ORDER BY score DESC, id LIMIT {LIMIT}", **RECALL)),
    "cq_cli_search": (cli_search, sql("SELECT id, round(s0, 6) AS bm25 FROM q_s WHERE c0 ORDER BY s0 DESC, id LIMIT 20", **_scores([[ONE]], 1.0, 1.0))),
    "cq_browse": (browse, None),
    "wn_top_associations": (seeds_edges, sql("SELECT node, round(weight, 6) AS weight FROM t_dir JOIN t_mem ON id = node WHERE weight >= 0.15 QUALIFY row_number() OVER (PARTITION BY node ORDER BY weight DESC, neighbour) <= 5")),
    "jn_merge_candidates": (merge_candidates, sql(BEST, **PAIRS, q_src="SELECT * FROM q_f ORDER BY strength DESC, id LIMIT 500", q_tgt="SELECT * FROM q_f ORDER BY strength DESC, id LIMIT 1000", q_cmp=COMPARED.format(on="a.id <> b.id"))),
    "jn_merge_candidates_delta": (merge_candidates_delta, sql(BEST, **PAIRS, q_src=f"SELECT * FROM q_f WHERE created_at > {LAST} OR id IN (SELECT memory_id FROM t_exp WHERE created_at > {LAST}) ORDER BY strength DESC, id LIMIT 500", q_tgt="SELECT * FROM q_f ORDER BY strength DESC, id LIMIT 1000", q_cmp=COMPARED.format(on="a.id <> b.id"))),
}
