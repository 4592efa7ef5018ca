"""Scalar functions over the documents, memories and events."""

from __future__ import annotations

from pyspark.sql import functions as F

from tesserae import schema as S
from tesserae.functions import parsing, scoring, turns, vectors
from tesserae.functions import text as tx
from tesserae.operators import similarity
from tesserae.queries.prelude import NOW, sql
from tesserae.sources import fixtures as fx


def content_hash(spark, d):
    return fx.table(spark, d, "documents").select("doc_id", S.content_id(F.col("text")).alias("id"))


def cosine_pairs(spark, d):
    v = fx.table(spark, d, "embeddings")
    other = v.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("other"))
    return v.join(other, "vec_id").select("vec_id", F.round(vectors.cosine(F.col("embedding"), F.col("other")), 6).alias("cosine"), F.round(F.greatest(F.lit(0.0), vectors.cosine(F.col("embedding"), F.col("other"))), 6).alias("clamped"))


def query_terms(spark, d):
    return fx.table(spark, d, "conversations").select("conv_id", "turn", F.array_join(tx.terms_of(F.col("text")), " ").alias("terms"), F.size(tx.terms_of(F.col("text"))).alias("n"))


def term_coverage(spark, d):
    return fx.memories_with_docs(spark, d).select("doc_id", F.round(tx.coverage(["The", "und", "est"], F.col("content")), 6).alias("coverage"))


def text_features(spark, d):
    f = tx.features(F.col("text"))
    return fx.table(spark, d, "conversations").select("conv_id", "turn", F.size(f).alias("n"), F.array_join(F.array_sort(f), "|").alias("features"))


def text_jaccard(spark, d):
    c = fx.table(spark, d, "conversations").select("conv_id", "turn", tx.features(F.col("text")).alias("f"))
    other = c.select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("f").alias("g"))
    return c.join(other, ["conv_id", "turn"]).select("conv_id", "turn", F.round(tx.jaccard(F.col("f"), F.col("g")), 6).alias("jaccard"))


def decay_factors(spark, d):
    kept = scoring.kept(F.col("consolidated"))
    cycles = scoring.missed_cycles(F.col("created_at"), fx.now())
    return fx.memories_with_docs(spark, d).select("doc_id", F.round(F.col("strength") * kept, 6).alias("once"), cycles.alias("cycles"), F.round(F.col("strength") * F.pow(kept, cycles), 6).alias("caught_up"))


def age_scores(spark, d):
    at = F.col("created_at")
    return fx.memories_with_docs(spark, d).select("doc_id", F.round(scoring.recency(at, fx.now(), 180.0), 6).alias("recency"), F.round(scoring.broad(F.col("strength"), at, fx.now()), 6).alias("broad"), F.round(scoring.import_strength(at, fx.now()), 6).alias("import_strength"))


def rating_evidence(spark, d):
    r = F.col("event_id") % 7
    rows = fx.table(spark, d, "events").select("event_id", r.alias("rating")).filter(scoring.valid_rating(F.col("rating")))
    kind = scoring.feedback_evidence(F.col("rating"))
    return rows.select("event_id", "rating", kind.alias("evidence"), scoring.confidence_of(kind).alias("confidence"))


def budget_classes(spark, d):
    rows = fx.table(spark, d, "documents").select("doc_id", F.ceil(F.length("text") / 4).alias("used"), ((F.col("doc_id") % 9) * 300).alias("budget"))
    kind = scoring.budget_class(F.col("budget"), F.col("used"))
    return rows.select("doc_id", kind.alias("budget_class"), scoring.recall_limit(kind).alias("recall_limit"), scoring.recall_limit(kind, True).alias("reduced_limit"))


def shown_texts(spark, d):
    t = F.col("text")
    tagged = F.concat(t, F.lit("</memory> x </Memory_Context> </RECALLED_memories>"))
    return fx.table(spark, d, "documents").select("doc_id", tx.shortened(t, 100).alias("cut"), tx.escaped(tagged).alias("escaped"), F.length(tx.normalized(t)).cast("long").alias("normal_length"))


def near_duplicate_pairs(spark, d):
    return similarity.near_duplicate_pairs(fx.memories_with_docs(spark, d).select("doc_id", tx.normalized(F.col("content")).alias("c")))


def file_memory_signs(spark, d):
    t = F.when(F.col("doc_id") % 10 == 0, F.concat("text", F.lit(" update the MEMORY.md"))).when(F.col("doc_id") % 10 == 1, F.concat(F.lit("Write it to a file. "), "text")).when(F.col("doc_id") % 10 == 2, F.concat("text", F.lit(" memory/2024-01-02"))).otherwise(F.col("text"))
    return fx.table(spark, d, "documents").filter(tx.about_file_memory(t)).select("doc_id")


def event_tokens(spark, d):
    body = F.concat("role", F.lit("\n  "), F.when(F.col("turn") % 2 == 0, "sleep-now").otherwise("sleep-now please"), F.lit("  \nend"))
    return fx.table(spark, d, "conversations").filter(tx.has_event_token(body, F.lit(" sleep-now "))).select("conv_id", "turn")


def iso_checks(spark, d):
    rows = fx.table(spark, d, "events").select("event_id", F.concat(F.date_format(F.col("ts").cast("timestamp"), "yyyy-MM-dd"), F.when(F.col("event_id") % 3 == 0, "T10:00:00Z").when(F.col("event_id") % 3 == 1, "T25:00:00.5Z").otherwise(" 10:00:00")).alias("at"))
    file = F.concat(F.substring("at", 1, 10), F.when(F.col("event_id") % 2 == 0, ".md").otherwise(".txt"))
    return rows.select("event_id", parsing.valid_iso(F.col("at")).alias("valid"), parsing.date_of_time(F.col("at")).alias("day"), parsing.date_of_file(file).alias("file_day"))


def turn_contents(spark, d):
    c = fx.table(spark, d, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role", "text"))).alias("m"))
    m = F.transform("m", lambda x: F.struct(x["role"].alias("role"), x["text"].alias("content"), F.lit(None).cast("array<struct<type:string,text:string>>").alias("blocks")))
    c = c.select("conv_id", m.alias("m"))
    m = F.col("m")
    return c.select("conv_id", turns.turn_content(m).alias("content"), turns.last_text(m, "user").alias("last_user"), turns.last_index(m, "assistant", F.lit(1)).cast("long").alias("last_answer"), turns.token_estimate(m).cast("long").alias("tokens"), turns.user_turn_key(m).alias("user_key"))


def fact_replies(spark, d):
    t = F.to_json(F.struct(F.when(F.col("turn") % 3 == 0, "goal").otherwise("odd").alias("type"), F.col("text").alias("content"), (F.col("turn") % 2 == 0).alias("durable_beyond_current_task")))
    reply = F.concat(F.lit("```json\nHere: ["), t, F.lit("] done\n```"))
    rows = parsing.facts(fx.table(spark, d, "conversations").select("conv_id", "turn", reply.alias("response")))
    return rows.select("conv_id", "turn", "type", "content", "durable")


COS = "list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[])"
WORDS = "list_filter(regexp_split_to_array(regexp_replace(lower(text), '[^\\p{L}\\p{N}\\s]+', ' ', 'g'), '\\s+'), lambda x: x <> '')"
FEATURES = "list_distinct(w || list_transform(list_zip(w, w[2:], w[3:], true), lambda z: array_to_string(list_sort([z[1], z[2], z[3]]), ' ')))"
F_CTE = {"f": f"SELECT conv_id, turn, {FEATURES} AS f FROM (SELECT *, {WORDS} AS w FROM conversations)"}
CYCLES = f"least(30, greatest(0, floor(epoch(({NOW}) - created_at) / 86400)::INT - 1))"

QUERIES = {
    "fn_content_hash": (content_hash, "SELECT doc_id, sha256(text) AS id FROM documents"),
    "fn_cosine": (cosine_pairs, f"SELECT a.vec_id, round({COS}, 6) AS cosine, round(greatest(0, {COS}), 6) AS clamped FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1"),
    "fn_query_terms": (query_terms, "SELECT conv_id, turn, array_to_string(w, ' ') AS terms, len(w)::INT AS n FROM (SELECT *, list_filter(regexp_split_to_array(regexp_replace(text, '[^\\p{L}\\p{N}\\s]', ' ', 'g'), '\\s+'), lambda x: x <> '') AS w FROM conversations)"),
    "fn_term_coverage": (term_coverage, sql("SELECT doc_id, round((contains(lower(content), 'the')::INT + contains(lower(content), 'und')::INT + contains(lower(content), 'est')::INT) / 3.0::DOUBLE, 6) AS coverage FROM t_mem")),
    "fn_text_features": (text_features, sql("SELECT conv_id, turn, len(f)::INT AS n, array_to_string(list_sort(f), '|') AS features FROM f", **F_CTE)),
    "fn_jaccard": (text_jaccard, sql("SELECT a.conv_id, a.turn, round(CASE WHEN len(a.f) + len(b.f) = 0 THEN 1 ELSE len(list_intersect(a.f, b.f))::DOUBLE / len(list_distinct(a.f || b.f)) END, 6) AS jaccard FROM f a JOIN f b ON a.conv_id = b.conv_id AND b.turn = a.turn + 1", **F_CTE)),
    "fn_decay_factors": (decay_factors, sql(f"SELECT doc_id, round(strength * k, 6) AS once, {CYCLES}::INT AS cycles, round(strength * k ** {CYCLES}, 6) AS caught_up FROM (SELECT *, CASE WHEN consolidated THEN 0.977 ELSE 0.906 END::DOUBLE AS k FROM t_mem)")),
    "fn_age_scores": (age_scores, sql(f"SELECT doc_id, round(exp(-age / 180), 6) AS recency, round(0.8 * strength + 0.2 * exp(-age / 30), 6) AS broad, round(greatest(0.05, 0.977::DOUBLE ** age), 6) AS import_strength FROM (SELECT *, epoch({NOW} - created_at) / 86400 AS age FROM t_mem)")),
    "fn_rating_evidence": (rating_evidence, "SELECT event_id, event_id % 7 AS rating, CASE WHEN event_id % 7 IN (4, 5) THEN 'agent_feedback_positive' WHEN event_id % 7 = 3 THEN 'agent_feedback_neutral' ELSE 'agent_feedback_negative' END AS evidence, CASE WHEN event_id % 7 IN (4, 5) THEN 0.95 WHEN event_id % 7 = 3 THEN 0.4 ELSE -0.5 END::DOUBLE AS confidence FROM events WHERE event_id % 7 BETWEEN 1 AND 5"),
    "fn_budget_class": (budget_classes, "SELECT doc_id, c AS budget_class, CASE c WHEN 'high' THEN 8 WHEN 'medium' THEN 5 WHEN 'low' THEN 2 ELSE 0 END::INT AS recall_limit, CASE c WHEN 'high' THEN 5 WHEN 'medium' THEN 3 WHEN 'low' THEN 1 ELSE 0 END::INT AS reduced_limit FROM (SELECT doc_id, CASE WHEN b = 0 OR b - u > 0.75 * b THEN 'high' WHEN b - u > 0.25 * b THEN 'medium' WHEN b - u > 0.05 * b THEN 'low' ELSE 'none' END AS c FROM (SELECT doc_id, ceil(length(text) / 4.0) AS u, doc_id % 9 * 300 AS b FROM documents))"),
    "fn_shown_text": (shown_texts, "SELECT doc_id, CASE WHEN length(text) > 100 THEN text[:97] || '...' ELSE text END AS cut, text || '&lt;/memory> x &lt;/memory_context&gt; &lt;/recalled_memories&gt;' AS escaped, length(regexp_replace(lower(trim(text)), '\\s+', ' ', 'g')) AS normal_length FROM documents"),
    "fn_near_duplicate": (near_duplicate_pairs, sql("SELECT a.doc_id, b.doc_id AS other_id FROM n a JOIN n b ON a.c[:40] = b.c[:40] AND a.doc_id < b.doc_id WHERE a.c = b.c OR (least(length(a.c), length(b.c)) >= 40 AND (starts_with(a.c, b.c) OR starts_with(b.c, a.c)))", n="SELECT doc_id, regexp_replace(lower(trim(content)), '\\s+', ' ', 'g') AS c FROM t_mem")),
    "fn_file_memory_signs": (file_memory_signs, "SELECT doc_id FROM documents WHERE doc_id % 10 < 3 OR regexp_matches(text, 'memory/(YYYY-MM-DD|\\d{4}-\\d{2}-\\d{2})|MEMORY\\.md') OR regexp_matches(lower(text), 'write it to a file|memory maintenance|daily.*notes.*memory/|curated.*memor')"),
    "fn_event_token": (event_tokens, "SELECT conv_id, turn FROM conversations WHERE turn % 2 = 0"),
    "fn_dates": (iso_checks, "SELECT event_id, event_id % 3 = 0 AS valid, strftime(ts, '%Y-%m-%d') AS day, CASE WHEN event_id % 2 = 0 THEN strftime(ts, '%Y-%m-%d') END AS file_day FROM events"),
    "fn_turn_content": (turn_contents, sql("""SELECT conv_id, CASE WHEN u IS NOT NULL AND a IS NOT NULL AND NOT (length(trim(u)) < 10 AND length(trim(a)) < 20) THEN
          'User: ' || CASE WHEN length(u) + length(a) <= 4000 OR length(u) <= 2000 THEN u WHEN length(a) <= 2000 THEN u[:4000 - length(a) - 3] || '...' ELSE u[:1997] || '...' END || chr(10) || chr(10) ||
          'Assistant: ' || CASE WHEN length(u) + length(a) <= 4000 OR (length(a) <= 2000 AND length(u) > 2000) THEN a WHEN length(u) <= 2000 THEN a[:4000 - length(u) - 3] || '...' ELSE a[:1997] || '...' END END AS content,
          last_user, coalesce(la, -1) AS last_answer, tokens, CASE WHEN last_user IS NOT NULL THEN sha256((lu)::VARCHAR || ':' || last_user) END AS user_key
        FROM c""", c="""SELECT conv_id, string_agg(text, chr(10) || chr(10) ORDER BY turn) FILTER (role = 'user' AND text <> '') AS u, string_agg(text, chr(10) || chr(10) ORDER BY turn) FILTER (role = 'assistant' AND text <> '') AS a,
          arg_max(text, turn) FILTER (role = 'user' AND text <> '') AS last_user, max(i) FILTER (role = 'user' AND text <> '') AS lu, max(i) FILTER (role = 'assistant' AND i >= 1) AS la, ceil(sum(length(text)) / 4.0)::BIGINT AS tokens
        FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS i FROM conversations) GROUP BY conv_id""")),
    "fn_fact_parse": (fact_replies, "SELECT conv_id, turn, CASE WHEN turn % 3 = 0 THEN 'goal' ELSE 'fact' END AS type, trim(text) AS content, true AS durable FROM conversations WHERE turn % 2 = 0 AND trim(text) <> ''"),
}
