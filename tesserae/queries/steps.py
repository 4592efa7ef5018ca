"""The steps of the consolidation, provenance, conversations and imports."""

from __future__ import annotations

from pyspark.sql import functions as F

from tesserae import schema as S
from tesserae.operators import exchanges, graph, merging, provenance
from tesserae.plans import consolidation, importing
from tesserae.queries.prelude import LAST, NOW, iso, sql
from tesserae.sources import fixtures as fx
from tesserae.sources import markdown, sessions
from tesserae.streaming import ingest


def catch_up(spark, d):
    out = consolidation.caught_up(fx.store(spark, d), fx.now(), fx.last())
    m = out.memories.select(F.lit("memory").alias("kind"), F.col("id").alias("a"), F.lit("").alias("b"), F.round("strength", 6).alias("value"))
    return m.union(out.associations.select(F.lit("edge"), "memory_a", "memory_b", F.round("weight", 6)))


def reinforced(spark, d):
    return provenance.reinforced(fx.store(spark, d)).memories.select("id", F.round("strength", 6).alias("strength"))


def decayed(spark, d):
    out = consolidation.decayed(fx.store(spark, d))
    m = out.memories.select(F.lit("memory").alias("kind"), F.col("id").alias("a"), F.lit("").alias("b"), F.round("strength", 6).alias("value"))
    return m.union(out.associations.select(F.lit("edge"), "memory_a", "memory_b", F.round("weight", 6)))


def co_retrieval_groups(spark, d):
    return graph.co_retrievals(fx.exposures(spark, d), fx.last()).select("turn_id", "memory_id", F.array_join("modes", ",").alias("modes"))


def co_retrieval_pairs(spark, d):
    p = graph.co_retrieved(fx.exposures(spark, d), fx.memories_with_docs(spark, d), fx.last())
    return p.select("turn_id", "memory_a", "memory_b", "cross", "weight")


def co_retrieval_edges(spark, d):
    e = graph.with_co_retrievals(fx.associations(spark, d), fx.exposures(spark, d), fx.memories_with_docs(spark, d), fx.now(), fx.last())
    return e.select("memory_a", "memory_b", F.round("weight", 6).alias("weight"), F.col("last_updated_at").isNotNull().alias("again"))


def transitive(spark, d):
    e = fx.associations(spark, d).withColumn("weight", F.least(F.lit(1.0), F.col("weight") * 3))
    return graph.transitive(e, 100).select("memory_a", "memory_b", F.round("weight", 6).alias("weight"))


def pruned(spark, d):
    out = consolidation.pruned(fx.store(spark, d))
    m = out.memories.select(F.lit("memory").alias("kind"), F.col("id").alias("a"), F.lit("").alias("b"))
    return m.union(out.associations.select(F.lit("edge"), "memory_a", "memory_b"))


def promoted(spark, d):
    return consolidation.promoted(fx.memories_with_docs(spark, d)).groupBy("consolidated").agg(F.count(F.lit(1)).alias("n"))


def merges(spark, d):
    """The pairs that the candidate search finds in the whole store are merged: the longer content stays."""
    st = fx.store(spark, d)
    pairs = [(r["a"], r["b"]) for r in consolidation.candidates(st, None).select("a", "b").collect()]
    out, _ = merging.merged(st, pairs, merging.longest, fx.now())
    rows = out.memories.select(F.lit("memory").alias("kind"), F.col("id").alias("a"), F.lit("").alias("b"), F.round("strength", 6).alias("value"))
    return rows.union(out.aliases.filter("created_at = timestamp'2024-02-15 00:00:00'").select(F.lit("alias"), "old_id", "new_id", F.lit(0.0)))


def consolidated(spark, d):
    _, s = consolidation.consolidated(fx.store(spark, d), fx.now())
    return s.row(spark)


def exchange_rows(spark, d):
    x = exchanges.exchanges(fx.table(spark, d, "conversations"), "conv_id", "turn")
    return x.select("conv_id", F.col("ordinal").cast("long").alias("ordinal"), exchanges.content(F.col("user_text"), F.col("assistant_text")).alias("content"))


def session_segments(spark, d):
    """Conversations as session files of JSON lines."""
    c = fx.table(spark, d, "conversations")
    block = F.array(F.struct(F.lit("text").alias("type"), F.col("text").alias("text")), F.struct(F.lit("thinking").alias("type"), F.lit("no").alias("text")))
    line = F.to_json(F.struct(F.lit("message").alias("type"), F.concat(F.lit("2024-01-"), F.lpad((F.col("conv_id") % 28 + 1).cast("string"), 2, "0"), F.lit("T10:00:00Z")).alias("timestamp"), F.struct("role", block.alias("content")).alias("message")))
    rows = c.select(F.concat(F.lit("sessions/"), F.col("conv_id").cast("string"), F.lit(".jsonl")).alias("path"), F.col("turn").cast("int").alias("line_no"), line.alias("line"))
    return sessions.segments(rows).select("source_file", "id", "date", "content", "char_count")


def _file(spark, d):
    """Each document's whole text as a file's first section, before a second one."""
    docs = fx.table(spark, d, "documents")
    head = F.concat(F.lit("---\ntitle: x\n---\n# One "), F.col("doc_id").cast("string"), F.lit(" #\n\n"))
    name = F.concat(F.lit("memory/2024-01-"), F.lpad((F.col("doc_id") % 28 + 1).cast("string"), 2, "0"), F.lit(".md"))
    return docs.select("doc_id", F.concat(head, "text", F.lit("\r\n## Two\r\n```\n# no heading\n```\n"), F.repeat(F.lit("word "), 60)).alias("text"), F.concat(F.col("doc_id").cast("string"), F.lit("/"), name).alias("path"))


def markdown_segments(spark, d):
    rows = markdown.segmented(_file(spark, d)).select("source_file", "id", "heading", "heading_level", "date", "evergreen", "content")
    return rows.withColumn("id", F.col("id").cast("long")).withColumn("heading_level", F.col("heading_level").cast("long"))


def file_info(spark, d):
    return importing.file_info(markdown.segmented(_file(spark, d)))


def imports(spark, d):
    st = fx.store(spark, d)
    c = fx.table(spark, d, "conversations")
    seg = exchanges.exchanges(c, "conv_id", "turn")
    day = F.concat(F.lit("2024-01-"), F.lpad((F.col("conv_id") % 28 + 1).cast("string"), 2, "0"))
    seg = seg.select(F.col("conv_id").cast("string").alias("source_file"), F.col("ordinal").alias("id"), exchanges.content(F.col("user_text"), F.col("assistant_text")).alias("content"), F.when(F.col("conv_id") % 3 > 0, day).alias("date"), (F.col("conv_id") % 5 == 0).alias("evergreen"))
    out = importing.imported(st.with_(memories=st.memories.limit(0)), importing.enriched(seg), fx.now())
    return out.memories.select("id", "type", "temporal_state", F.round("strength", 6).alias("strength"))


def ingested(spark, d):
    """All turns ended anew, from what their exposures say, into a store that has none."""
    st = fx.store(spark, d)
    e = fx.exposure_events(spark, d)
    ledger = e.select("session_id", "turn_id", "memory_id", F.col("mode").alias("channel"), "score", (F.col("retrieval_mode") == "bm25_only").alias("bm25_only"), "created_at", F.col("event_id").alias("seq"))
    said = F.array(*(F.struct(F.lit(r).alias("role"), F.lit("x").alias("content"), F.lit(None).cast("array<struct<type:string,text:string>>").alias("blocks")) for r in ("user", "assistant", "user")))
    calls = F.array_sort(F.collect_list(F.when(F.col("mode") == "tool_store", F.struct("event_id", "memory_id", (1 + F.col("k") % 5).cast("double").alias("rating")))))
    calls = F.transform(calls, lambda c: F.struct(c["memory_id"].alias("memory_id"), c["rating"].alias("rating")))
    turn = e.groupBy("session_id", "turn_id").agg(F.max("created_at").alias("created_at"), F.max("event_id").alias("seq"), calls.alias("feedback"))
    turn = turn.select("session_id", "turn_id", F.lit(0).alias("prior_messages"), "created_at", "seq", said.alias("messages"), "feedback")
    st = st.with_(exposures=st.exposures.limit(0), attributions=st.attributions.limit(0))
    out = provenance.ingested(st, ledger, turn)
    return out.attributions.select("message_id", "memory_id", "evidence", "confidence")


def exposure_windows(spark, d):
    w = ingest.exposure_counts(fx.exposures(spark, d))
    return w.select(S.iso(F.col("start")).alias("start"), "mode", "n")


KEPT = "CASE WHEN consolidated THEN 0.977 ELSE 0.906 END::DOUBLE"
SINCE = f"SELECT turn_id, memory_id, list_sort(list(DISTINCT mode)) AS modes FROM t_exp WHERE created_at > {LAST} GROUP BY ALL"
REINF = {"q_r": "SELECT memory_id AS id, sum(0.7 * confidence * CASE WHEN rm = 'bm25_only' THEN 0.5 ELSE 1 END) AS total FROM t_att LEFT JOIN (SELECT turn_id, memory_id, arg_min(coalesce(retrieval_mode, ''), CASE mode WHEN 'auto_injected' THEN 0 WHEN 'tool_search_returned' THEN 1 WHEN 'tool_get' THEN 2 ELSE 3 END) AS rm FROM t_exp GROUP BY ALL) USING (turn_id, memory_id) GROUP BY memory_id"}
EX = {
    "q_t": "SELECT *, sum(CASE WHEN role = 'user' AND pr = 'assistant' THEN 1 ELSE 0 END) OVER (PARTITION BY conv_id ORDER BY turn) AS ex FROM (SELECT *, lag(role) OVER (PARTITION BY conv_id ORDER BY turn) AS pr FROM conversations WHERE role IN ('user', 'assistant') AND trim(text) <> '')",
    "q_x": "SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY ex) - 1 AS ordinal, 'User: ' || u || chr(10) || chr(10) || 'Assistant: ' || a AS content FROM (SELECT conv_id, ex, string_agg(trim(text), chr(10) || chr(10) ORDER BY turn) FILTER (role = 'user') AS u, string_agg(trim(text), chr(10) || chr(10) ORDER BY turn) FILTER (role = 'assistant') AS a FROM q_t GROUP BY conv_id, ex) WHERE u IS NOT NULL AND a IS NOT NULL",
}
AFTER = {
    "q_s": "SELECT turn_id || ':msg:1' AS message_id, memory_id, arg_max(mode, c) AS evidence, max(c) AS confidence, min(created_at) AS created_at FROM (SELECT *, CASE mode WHEN 'auto_injected' THEN 0.15 WHEN 'tool_search_returned' THEN 0.3 ELSE 0.6 END::DOUBLE AS c FROM t_raw WHERE mode <> 'tool_store') GROUP BY turn_id, memory_id",
    "q_n": "SELECT memory_id, message_id AS newest FROM q_s QUALIFY row_number() OVER (PARTITION BY memory_id ORDER BY created_at DESC, message_id DESC) = 1",
    "q_c": "SELECT turn_id, memory_id, arg_max(1 + k % 5, event_id) AS r FROM t_raw WHERE mode = 'tool_store' GROUP BY turn_id, memory_id",
    "q_g": "SELECT message_id, memory_id, arg_max(evidence, confidence) AS evidence, max(confidence) AS confidence FROM (SELECT coalesce(newest, turn_id || ':msg:1') AS message_id, memory_id, CASE WHEN r >= 4 THEN 'agent_feedback_positive' WHEN r = 3 THEN 'agent_feedback_neutral' ELSE 'agent_feedback_negative' END AS evidence, CASE WHEN r >= 4 THEN 0.95 WHEN r = 3 THEN 0.4 ELSE -0.5 END::DOUBLE AS confidence FROM q_c LEFT JOIN q_n USING (memory_id)) GROUP BY message_id, memory_id",
}
DAY = "'2024-01-' || lpad((conv_id % 28 + 1)::VARCHAR, 2, '0')"
MD = {
    "q_d": "SELECT doc_id, doc_id || '/memory/2024-01-' || lpad((doc_id % 28 + 1)::VARCHAR, 2, '0') || '.md' AS source_file, '2024-01-' || lpad((doc_id % 28 + 1)::VARCHAR, 2, '0') AS date, '# One ' || doc_id AS h, trim(regexp_replace(text, '\\s+', ' ', 'g')) AS body FROM documents WHERE length(text) <= 1500 AND text NOT LIKE '%' || chr(10) || '#%' AND text NOT LIKE '#%' AND text NOT LIKE '%```%' AND text NOT LIKE '%~~~%'",
    "q_m": "SELECT *, h || chr(10) || chr(10) || body AS first, '## Two' || chr(10) || chr(10) || '```' || chr(10) || '# no heading' || chr(10) || '```' || chr(10) || trim(repeat('word ', 60)) AS second FROM q_d",
}

QUERIES = {
    "cq_catch_up_decay": (catch_up, sql(f"SELECT 'memory' AS kind, id AS a, '' AS b, round(strength * {KEPT} ** least(30, greatest(0, floor(epoch({NOW} - greatest(created_at, {LAST})) / 86400) - 1)), 6) AS value FROM t_mem UNION ALL SELECT 'edge', memory_a, memory_b, round(weight * 0.9::DOUBLE ** 20, 6) FROM t_edge")),
    "cq_reinforcement": (reinforced, sql("SELECT id, round(CASE WHEN coalesce(total, 0) = 0 THEN strength ELSE greatest(0, least(1, strength + total)) END, 6) AS strength FROM t_mem LEFT JOIN q_r USING (id)", **REINF)),
    "cq_decay": (decayed, sql(f"SELECT 'memory' AS kind, id AS a, '' AS b, round(strength * {KEPT}, 6) AS value FROM t_mem UNION ALL SELECT 'edge', memory_a, memory_b, round(weight * 0.9, 6) FROM t_edge")),
    "ag_co_retrieval_groups": (co_retrieval_groups, sql("SELECT turn_id, memory_id, array_to_string(modes, ',') AS modes FROM q_s QUALIFY count(*) OVER (PARTITION BY turn_id) >= 2", q_s=SINCE)),
    "jn_co_retrieval_pairs": (co_retrieval_pairs, sql("SELECT a.turn_id, a.memory_id AS memory_a, b.memory_id AS memory_b, a.modes <> b.modes AS \"cross\", CASE WHEN a.modes <> b.modes THEN 0.15 ELSE 0.05 END::DOUBLE AS weight FROM q_s a JOIN q_s b ON a.turn_id = b.turn_id AND a.memory_id < b.memory_id", q_s=SINCE)),
    "cq_co_retrieval": (co_retrieval_edges, sql("SELECT memory_a, memory_b, round(1 - product(1 - w), 6) AS weight, count(DISTINCT k) = 2 AS again FROM (SELECT memory_a, memory_b, weight AS w, 0 AS k FROM t_edge UNION ALL SELECT a.memory_id, b.memory_id, CASE WHEN a.modes <> b.modes THEN 0.15 ELSE 0.05 END::DOUBLE, 1 FROM q_s a JOIN q_s b ON a.turn_id = b.turn_id AND a.memory_id < b.memory_id) GROUP BY ALL".replace("GROUP BY ALL", "GROUP BY memory_a, memory_b"), q_s=SINCE)),
    "cq_transitive": (transitive, sql("SELECT memory_a, memory_b, round(weight, 6) AS weight FROM (SELECT memory_a, memory_b, w0 + g - w0 * g AS weight, round(g - w0 * g, 12) AS dw FROM (SELECT x.neighbour AS memory_a, y.neighbour AS memory_b, 1 - product(1 - x.weight * y.weight) AS g FROM q_d x JOIN q_d y ON x.node = y.node AND x.neighbour < y.neighbour WHERE x.weight * y.weight >= 0.1 GROUP BY 1, 2) LEFT JOIN (SELECT node AS memory_a, neighbour AS memory_b, weight AS w1 FROM q_d) USING (memory_a, memory_b), LATERAL (SELECT coalesce(w1, 0) AS w0)) WHERE dw >= 1e-9 ORDER BY dw DESC, memory_a, memory_b LIMIT 100", q_d="SELECT node, neighbour, least(1, weight * 3) AS weight FROM t_dir")),
    "cq_pruning": (pruned, sql("SELECT 'memory' AS kind, id AS a, '' AS b FROM q_k UNION ALL SELECT 'edge', memory_a, memory_b FROM t_edge WHERE weight >= 0.01 AND memory_a IN (SELECT id FROM q_k) AND memory_b IN (SELECT id FROM q_k)", q_k="SELECT id FROM t_mem WHERE strength > 0.05")),
    "cq_promote": (promoted, sql("SELECT true AS consolidated, count(*) AS n FROM t_mem")),
    "cq_merge": (merges, sql("SELECT 'memory' AS kind, id AS a, '' AS b, round(CASE WHEN id IN (SELECT keep FROM q_p) THEN 1 WHEN id IN (SELECT lose FROM q_p) THEN strength * 0.3 ELSE strength END, 6) AS value FROM t_mem WHERE NOT (source = 'consolidation' AND id IN (SELECT lose FROM q_p)) UNION ALL SELECT 'alias', lose, keep, 0 FROM q_p JOIN t_mem ON id = lose WHERE source = 'consolidation'", q_p="SELECT CASE WHEN first THEN x.id ELSE y.id END AS keep, CASE WHEN first THEN y.id ELSE x.id END AS lose FROM (SELECT x, y, length(x.content) > length(y.content) OR (length(x.content) = length(y.content) AND x.id < y.id) AS first FROM t_mem x JOIN t_mem y ON y.doc_id = x.doc_id + 1 WHERE x.doc_id % 10 = 1 AND x.doc_id < 400)")),
    "cq_consolidation": (consolidated, None),
    "sx_exchanges": (exchange_rows, sql("SELECT conv_id, ordinal, content FROM q_x", **EX)),
    "sx_sessions": (session_segments, sql(f"SELECT 'sessions/' || conv_id || '.jsonl' AS source_file, ordinal::INT AS id, {DAY} AS date, content, length(content)::INT AS char_count FROM q_x", **EX)),
    "sx_markdown": (markdown_segments, sql("SELECT source_file, 0 AS id, h AS heading, 1 AS heading_level, date, false AS evergreen, CASE WHEN length(first) < 200 THEN first || chr(10) || chr(10) || second ELSE first END AS content FROM q_m UNION ALL SELECT source_file, 1, '## Two', 2, date, false, second FROM q_m WHERE length(first) >= 200", **MD)),
    "ag_file_info": (file_info, sql("SELECT source_file, CASE WHEN length(first) < 200 THEN 1 ELSE 2 END::BIGINT AS segments, false AS evergreen, date FROM q_m", **MD)),
    "cq_import": (imports, sql(f"SELECT sha256(content) AS id, any_value(CASE WHEN conv_id % 5 = 0 THEN 'fact' ELSE 'observation' END) AS type, any_value(CASE WHEN conv_id % 3 > 0 THEN 'past' ELSE 'none' END) AS temporal_state, round(min(CASE WHEN conv_id % 3 > 0 THEN 0.977::DOUBLE ** date_diff('day', ({DAY})::DATE, DATE '2024-02-15') ELSE 1 END), 6) AS strength FROM q_x GROUP BY content", **EX)),
    "cq_after_turn": (ingested, sql("SELECT message_id, memory_id, coalesce(g.evidence, s.evidence) AS evidence, coalesce(g.confidence, s.confidence) AS confidence FROM q_s s FULL JOIN q_g g USING (message_id, memory_id)", **AFTER)),
    "st_exposure_windows": (exposure_windows, sql(f"SELECT {iso("date_trunc('day', created_at)::TIMESTAMP")} AS start, mode, count(*) AS n FROM t_exp GROUP BY ALL")),
}

