"""Scans, filters, changes and aggregates of the store's tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from tesserae import schema as S
from tesserae.functions import scoring
from tesserae.operators import dml, provenance, scans
from tesserae.plans import context, inspection
from tesserae.queries.prelude import LAST, NOW, iso, sql
from tesserae.sources import fixtures as fx
from tesserae.sources import retrieval_log


def _memories(spark, d):
    return fx.memories_with_docs(spark, d)


def newest(spark, d):
    m = scans.newest_first(_memories(spark, d))
    return m.select("id", S.iso(F.col("created_at")).alias("created_at"))


def working_split(spark, d):
    m = _memories(spark, d)
    w = scans.working(m).agg(F.lit("working").alias("part"), F.count(F.lit(1)).alias("n"), F.round(F.sum("strength"), 6).alias("strength"))
    c = scans.consolidated(m).agg(F.lit("consolidated"), F.count(F.lit(1)), F.round(F.sum("strength"), 6))
    return w.union(c)


def prefix_lookup(spark, d):
    first = S.content_id(F.col("text"))
    one = fx.table(spark, d, "documents").filter("doc_id = 1").select(first.alias("id")).first()
    return scans.by_prefix(_memories(spark, d), one["id"][:12]).select("doc_id", "id")


def bulk_lookup(spark, d):
    wanted = fx.exposures(spark, d).filter("mode = 'tool_store'").select("memory_id").distinct()
    return scans.by_ids(_memories(spark, d), wanted, "memory_id").select("doc_id")


def embedding_scan(spark, d):
    return scans.usable_embeddings(fx.embeddings(spark, d)).select("id", F.size("embedding").alias("size"))


def exposures_first(spark, d):
    return fx.exposures(spark, d).select("session_id", "turn_id", "memory_id", "mode", "score", "retrieval_mode", S.iso(F.col("created_at")).alias("created_at"))


def attributions_merged(spark, d):
    return fx.attributions(spark, d).select("message_id", "memory_id", "evidence", "confidence", "turn_id", S.iso(F.col("created_at")).alias("created_at"), S.iso(F.col("updated_at")).alias("updated_at"))


def latest_attribution(spark, d):
    return scans.latest_attributions(fx.attributions(spark, d)).select("memory_id", "message_id", "evidence", "confidence")


def listing(spark, d):
    top = scans.listing(_memories(spark, d), type="plan", state="past", least=0.25, limit=40)
    return top.select("id_short", "id", "content", "strength")


def strongest(spark, d):
    return scans.strongest(_memories(spark, d), 100).select("doc_id", "strength")


def upcoming(spark, d):
    start = F.lit("2024-02-01").cast("timestamp")
    return scans.upcoming(_memories(spark, d), start, F.lit("2024-02-08").cast("timestamp"), 10).select("doc_id", S.iso(F.col("temporal_anchor")).alias("anchor"))


def due(spark, d):
    return scans.due(_memories(spark, d), fx.now()).select("doc_id", "temporal_state")


def merge_sources(spark, d):
    return scans.merge_sources(fx.store(spark, d), 0.3, fx.last()).select("id", "strength")


def merge_targets(spark, d):
    return scans.merge_targets(_memories(spark, d), 0.3).select("id", "strength")


def aliases_resolved(spark, d):
    return scans.resolved_aliases(fx.aliases(spark, d))


def alias_scans(spark, d):
    a = fx.aliases(spark, d)
    return a.groupBy(F.col("new_id").alias("id")).agg(F.count(F.lit(1)).alias("n"), F.min("old_id").alias("old_id"))


def log_events(spark, d):
    """The events as a log of lines, and the lines read again."""
    e = fx.table(spark, d, "events")
    kind = F.when(F.col("event_type") == "view", "recall").when(F.col("event_type") == "click", "search").when(F.col("event_type") == "purchase", "feedback").when(F.col("event_type") == "signup", "store").otherwise("other")
    at = F.concat(F.date_format(F.col("ts").cast("timestamp"), "yyyy-MM-dd"), F.lit("T00:00:00.000Z"))
    u, k = F.col("user_id").cast("string"), F.col("event_id").cast("string")
    rest = F.when(kind == "feedback", F.concat(F.lit("m"), u, F.lit(":"), (F.col("event_id") % 5 + 1).cast("string"), F.lit(' "it is \\"'), k, F.lit('\\""'))).when(kind == "store", F.concat(F.lit("m"), u, F.lit(" context:a"), k, F.lit(",b"))).otherwise(F.concat(F.lit("m"), u, F.lit(" m"), k))
    lines = e.select(F.concat_ws(" ", at, F.rpad(kind, 8, " "), rest).alias("value"))
    p = retrieval_log.parsed(lines)
    return p.select("timestamp", "event", F.array_join("ids", " ").alias("ids"), F.element_at(F.map_values("ratings"), 1).alias("rating"), "comment", F.array_join("context_ids", " ").alias("context"))


def inserts(spark, d):
    """Every document stored into a store of those with even numbers: contents that are there stay."""
    st = fx.store(spark, d)
    m = _memories(spark, d)
    half = st.with_(memories=m.filter("doc_id % 2 = 0").drop("doc_id"))
    new = fx.table(spark, d, "documents").select(F.col("text").alias("content"), F.lit("fact").alias("type"), F.lit("import").alias("source"))
    out = dml.stored(half, new, fx.now()).memories
    return out.select("id", "type", "source", F.round("strength", 6).alias("strength"))


def cascade_delete(spark, d):
    st = fx.store(spark, d)
    out = dml.deleted(st, st.memories.filter("strength < 0.5").select("id"))
    n = lambda name: getattr(out, name).agg(F.lit(name).alias("name"), F.count(F.lit(1)).alias("n"))
    return n("memories").union(n("associations")).union(n("exposures")).union(n("embeddings")).union(n("attributions"))


def renames(spark, d):
    """All memories get ! behind their contents."""
    st = fx.store(spark, d)
    changes = _memories(spark, d).select(F.col("id").alias("old_id"), F.concat("content", F.lit("!")).alias("new_content"))
    out = dml.renamed(st, changes)
    e = out.associations.select(F.lit("edge").alias("kind"), "memory_a", "memory_b", F.round("weight", 6).alias("weight"))
    m = out.memories.select(F.lit("memory").alias("kind"), F.col("id").alias("memory_a"), F.lit("").alias("memory_b"), F.round("strength", 6).alias("weight"))
    x = out.exposures.groupBy("memory_id").agg(F.count(F.lit(1)).cast("double").alias("weight")).select(F.lit("exposures"), "memory_id", F.lit(""), "weight")
    return e.union(m).union(x)


def edges_set(spark, d):
    e = fx.associations(spark, d)
    new = e.filter("weight > 0.1").select(F.col("memory_b").alias("memory_a"), F.col("memory_a").alias("memory_b"), F.lit(0.9).alias("weight"))
    out = dml.edges_set(e, new, fx.now())
    return out.select("memory_a", "memory_b", F.round("weight", 6).alias("weight"), F.col("last_updated_at").isNotNull().alias("touched"))


def edges_pruned(spark, d):
    e = fx.associations(spark, d).withColumn("weight", F.col("weight") * 0.15)
    kept = dml.strong_edges(e)
    return e.agg(F.count(F.lit(1)).alias("before")).crossJoin(kept.agg(F.count(F.lit(1)).alias("kept"), F.round(F.sum("weight"), 6).alias("weight")))


def exposure_gc(spark, d):
    x = fx.exposures(spark, d)
    kept = dml.recent_exposures(x, fx.now())
    return x.agg(F.count(F.lit(1)).alias("before")).crossJoin(kept.agg(F.count(F.lit(1)).alias("kept")))


def state_kept(spark, d):
    st = dml.state_set(fx.store(spark, d).state, schema_version=str(S.SCHEMA_VERSION))
    return dml.state_set(st, last_consolidation_at="2024-02-15T00:00:00Z")


def counts(spark, d):
    return dml.counts(fx.store(spark, d))


def reinforcement_sums(spark, d):
    return provenance.reinforcements(fx.attributions(spark, d), fx.exposures(spark, d)).select("memory_id", F.round("total", 6).alias("total"))


def ledger_hidden(spark, d):
    """Of each turn, what was injected and no tool shows."""
    x = fx.exposures(spark, d).withColumnRenamed("mode", "channel")
    shown = provenance.visible(x)
    out = x.filter("channel = 'auto_injected'").join(shown, ["turn_id", "memory_id"], "left_anti")
    return out.groupBy("turn_id").agg(F.count(F.lit(1)).alias("n")).join(provenance.ledger_versions(x), "turn_id", "left").select("turn_id", "n", F.coalesce("version", F.lit(0)).cast("long").alias("version"))


def context_lines(spark, d):
    top = scans.strongest(_memories(spark, d), 20).withColumns({"position": F.lit(0), "temporal": F.col("doc_id") % 4 == 1})
    return context.lines(top, "medium").select("line")


def temporal_upcoming(spark, d):
    st = fx.store(spark, d)
    strong = st.memories.filter("strength > 0.9").select("id")
    early = F.lit("2024-02-05 10:00:00").cast("timestamp")
    return context.upcoming(st, early, strong).select("id", S.iso(F.col("temporal_anchor")).alias("anchor"))


def inspect_all(spark, d):
    out = inspection.inspected(fx.store(spark, d))
    n = lambda c: F.coalesce(F.size(c), F.lit(0)).cast("int")
    size = lambda c: F.greatest(n(c), F.lit(0)).alias(c)
    return out.select("id", size("associations"), size("attributions"), size("exposures"), "alias", F.round(F.aggregate(F.coalesce("associations", F.array()), F.lit(0.0), lambda s, x: s + x["weight"]), 6).alias("weight"))


def history(spark, d):
    st = fx.store(spark, d)
    one = fx.table(spark, d, "documents").filter("doc_id = 1").select(S.content_id(F.col("text")).alias("id")).first()["id"]
    return inspection.history(st, one).select("event", S.iso(F.col("at")).alias("at"), "detail")


def graph_export(spark, d):
    st = fx.store(spark, d)
    return inspection.graph_edges(st)


def graph_dot(spark, d):
    return inspection.dot(fx.store(spark, d))


def evidence_counts(spark, d):
    return inspection.evidence_counts(fx.attributions(spark, d)).select("evidence", "n", F.round("mean_confidence", 6).alias("mean_confidence"))


def due_later(spark, d):
    from tesserae.plans import consolidation

    m = consolidation.transitioned(_memories(spark, d), fx.now())
    return m.select("doc_id", "temporal_state")


def sleep_debt(spark, d):
    from tesserae.functions import parsing

    m = _memories(spark, d)
    last = F.when(F.col("doc_id") % 2 == 0, F.col("created_at"))
    return m.select("doc_id", parsing.sleep_debt(last, F.col("doc_id") % 3, F.lit("2024-02-01").cast("timestamp")).alias("debt"))


def import_strengths(spark, d):
    m = _memories(spark, d)
    return m.select("doc_id", F.round(scoring.import_strength(F.col("temporal_anchor"), F.lit("2024-02-01").cast("timestamp")), 6).alias("strength"))


R = "sha256(content || '!')"
QUERIES = {
    "sc_newest_first": (newest, sql(f"SELECT id, {iso('created_at')} AS created_at FROM t_mem")),
    "sc_working_consolidated": (working_split, sql("SELECT CASE WHEN consolidated THEN 'consolidated' ELSE 'working' END AS part, count(*) AS n, round(sum(strength), 6) AS strength FROM t_mem GROUP BY 1")),
    "sc_prefix_lookup": (prefix_lookup, sql("SELECT doc_id, id FROM t_mem WHERE id = (SELECT sha256(text) FROM documents WHERE doc_id = 1)")),
    "sc_bulk_lookup": (bulk_lookup, sql("SELECT doc_id FROM t_mem WHERE id IN (SELECT memory_id FROM t_exp WHERE mode = 'tool_store')")),
    "sc_embeddings": (embedding_scan, sql("SELECT id, len(embedding)::INT AS size FROM t_emb WHERE len(embedding) > 0")),
    "sc_latest_attribution": (latest_attribution, sql("SELECT memory_id, message_id, evidence, confidence FROM t_att QUALIFY row_number() OVER (PARTITION BY memory_id ORDER BY created_at DESC, message_id DESC) = 1")),
    "sc_aliases": (alias_scans, sql("SELECT new_id AS id, count(*) AS n, min(old_id) AS old_id FROM t_alias GROUP BY new_id")),
    "sc_retrieval_log": (log_events, "SELECT strftime(ts, '%Y-%m-%d') || 'T00:00:00.000Z' AS timestamp, CASE event_type WHEN 'view' THEN 'recall' WHEN 'click' THEN 'search' WHEN 'purchase' THEN 'feedback' ELSE 'store' END AS event, 'm' || user_id || CASE WHEN event_type IN ('view', 'click') THEN ' m' || event_id ELSE '' END AS ids, CASE WHEN event_type = 'purchase' THEN (event_id % 5 + 1)::INT END AS rating, CASE WHEN event_type = 'purchase' THEN 'it is \"' || event_id || '\"' END AS comment, CASE WHEN event_type = 'signup' THEN 'a' || event_id || ' b' END AS context FROM events WHERE event_type <> 'error'"),
    "dm_store": (inserts, sql("SELECT id, CASE WHEN doc_id % 2 = 0 THEN type ELSE 'fact' END AS type, CASE WHEN doc_id % 2 = 0 THEN source ELSE 'import' END AS source, CASE WHEN doc_id % 2 = 0 THEN round(strength, 6) ELSE 1 END::DOUBLE AS strength FROM t_mem")),
    "dm_cascade_delete": (cascade_delete, sql("SELECT 'memories' AS name, count(*) AS n FROM t_mem WHERE strength >= 0.5 UNION ALL SELECT 'associations', count(*) FROM t_edge WHERE memory_a IN (FROM live) AND memory_b IN (FROM live) UNION ALL SELECT 'exposures', count(*) FROM t_exp WHERE memory_id IN (FROM live) UNION ALL SELECT 'embeddings', count(*) FROM t_emb WHERE id IN (FROM live) UNION ALL SELECT 'attributions', count(*) FROM t_att", live="SELECT id FROM t_mem WHERE strength >= 0.5")),
    "dm_rename": (renames, sql("SELECT 'edge' AS kind, least(x.new, y.new) AS memory_a, greatest(x.new, y.new) AS memory_b, round(weight, 6) AS weight FROM t_edge JOIN r x ON x.id = memory_a JOIN r y ON y.id = memory_b UNION ALL SELECT 'memory', new, '', round(strength, 6) FROM r UNION ALL SELECT 'exposures', new, '', count(*)::DOUBLE FROM t_exp JOIN r ON r.id = memory_id GROUP BY new", r=f"SELECT id, {R} AS new, strength FROM t_mem")),
    "dm_edge_upsert": (edges_set, sql("SELECT memory_a, memory_b, CASE WHEN weight > 0.1 THEN 0.9 ELSE round(weight, 6) END::DOUBLE AS weight, weight > 0.1 AS touched FROM t_edge")),
    "dm_edge_prune": (edges_pruned, sql("SELECT count(*) AS before, count(*) FILTER (weight * 0.15 >= 0.01) AS kept, round(sum(weight * 0.15) FILTER (weight * 0.15 >= 0.01), 6) AS weight FROM t_edge")),
    "dm_exposure_insert": (exposures_first, sql(f"SELECT session_id, turn_id, memory_id, mode, score, retrieval_mode, {iso('created_at')} AS created_at FROM t_exp")),
    "dm_exposure_gc": (exposure_gc, sql(f"SELECT count(*) AS before, count(*) FILTER (created_at >= {NOW} - INTERVAL 30 DAY) AS kept FROM t_exp")),
    "dm_attribution_upsert": (attributions_merged, sql(f"SELECT message_id, memory_id, evidence, confidence, turn_id, {iso('created_at')} AS created_at, {iso('updated_at')} AS updated_at FROM t_att")),
    "dm_state": (state_kept, "SELECT * FROM (VALUES ('last_consolidation_at', '2024-02-15T00:00:00Z'), ('schema_version', '5')) t(key, value)"),
    "pf_listing": (listing, sql("SELECT id[:8] AS id_short, id, CASE WHEN length(content) > 100 THEN content[:97] || '...' ELSE content END AS content, round(strength, 3) AS strength FROM t_mem WHERE type = 'plan' AND temporal_state = 'past' AND strength >= 0.25 ORDER BY created_at DESC, id LIMIT 40")),
    "pf_strongest": (strongest, sql("SELECT doc_id, strength FROM t_mem WHERE strength > 0.05 ORDER BY strength DESC, created_at DESC, id LIMIT 100")),
    "pf_upcoming": (upcoming, sql(f"SELECT doc_id, {iso('temporal_anchor')} AS anchor FROM t_mem WHERE temporal_state IN ('future', 'present') AND temporal_anchor >= DATE '2024-02-01' AND temporal_anchor <= DATE '2024-02-08' AND strength > 0.05 ORDER BY temporal_anchor, id LIMIT 10")),
    "pf_merge_sources": (merge_sources, sql(f"SELECT id, strength FROM t_mem WHERE strength >= 0.3 AND id IN (SELECT id FROM t_mem WHERE created_at > {LAST} UNION SELECT memory_id FROM t_exp WHERE created_at > {LAST}) ORDER BY strength DESC, id LIMIT 500")),
    "pf_merge_targets": (merge_targets, sql("SELECT id, strength FROM t_mem WHERE strength >= 0.3 ORDER BY strength DESC, id LIMIT 1000")),
    "pf_due_transitions": (due, sql(f"SELECT doc_id, temporal_state FROM t_mem WHERE (temporal_state = 'future' AND temporal_anchor <= {NOW}) OR (temporal_state = 'present' AND temporal_anchor < {NOW} - INTERVAL 1 DAY)")),
    "pf_ledger_dedup": (ledger_hidden, sql("SELECT turn_id, n, coalesce(version, 0) AS version FROM (SELECT turn_id, count(*) AS n FROM t_exp x WHERE mode = 'auto_injected' AND NOT EXISTS (FROM t_exp y WHERE y.turn_id = x.turn_id AND y.memory_id = x.memory_id AND y.mode <> 'auto_injected') GROUP BY turn_id) LEFT JOIN (SELECT turn_id, count(DISTINCT mode || memory_id) AS version FROM t_exp WHERE mode <> 'auto_injected' GROUP BY turn_id) USING (turn_id)")),
    "pf_temporal_injection": (temporal_upcoming, sql(f"SELECT id, {iso('temporal_anchor')} AS anchor FROM (SELECT * FROM t_mem WHERE temporal_state IN ('future', 'present') AND temporal_anchor BETWEEN DATE '2024-02-05' AND DATE '2024-02-12' AND strength > 0.05 ORDER BY temporal_anchor, id LIMIT 10) WHERE strength <= 0.9")),
    "jn_alias_chain": (aliases_resolved, sql("SELECT old_id, arg_max(new_id, n) AS canonical FROM c GROUP BY old_id", c="SELECT old_id, new_id, 1 AS n FROM t_alias UNION ALL " + " UNION ALL ".join(f"SELECT a0.old_id, a{k}.new_id, {k + 1} FROM t_alias a0 " + " ".join(f"JOIN t_alias a{i} ON a{i}.old_id = a{i - 1}.new_id" for i in range(1, k + 1)) for k in range(1, 10)))),
    "jn_inspect": (inspect_all, sql("SELECT m.id, coalesce(e, 0)::INT AS associations, coalesce(a, 0)::INT AS attributions, coalesce(x, 0)::INT AS exposures, canonical AS alias, coalesce(w, 0)::DOUBLE AS weight FROM t_mem m LEFT JOIN (SELECT node AS id, count(*) AS e, round(sum(weight), 6) AS w FROM t_dir GROUP BY node) USING (id) LEFT JOIN (SELECT memory_id AS id, count(*) AS a FROM t_att GROUP BY memory_id) USING (id) LEFT JOIN (SELECT memory_id AS id, count(*) AS x FROM t_exp GROUP BY memory_id) USING (id) LEFT JOIN (SELECT old_id AS id, arg_max(new_id, n) AS canonical FROM c GROUP BY old_id) USING (id)", c="SELECT old_id, new_id, 1 AS n FROM t_alias UNION ALL " + " UNION ALL ".join(f"SELECT a0.old_id, a{k}.new_id, {k + 1} FROM t_alias a0 " + " ".join(f"JOIN t_alias a{i} ON a{i}.old_id = a{i - 1}.new_id" for i in range(1, k + 1)) for k in range(1, 10)))),
    "ag_table_stats": (counts, sql("SELECT (SELECT count(*) FROM t_mem) AS total, (SELECT count(*) FROM t_mem WHERE NOT consolidated) AS working, (SELECT count(*) FROM t_mem WHERE consolidated) AS consolidated, (SELECT count(*) FROM t_edge) AS associations, '2024-01-25T00:00:00Z' AS last_consolidation_at")),
    "ag_reinforcement": (reinforcement_sums, sql("SELECT memory_id, round(sum(0.7 * confidence * CASE WHEN rm = 'bm25_only' THEN 0.5 ELSE 1 END), 6) AS total FROM t_att LEFT JOIN (SELECT turn_id, memory_id, arg_min(coalesce(retrieval_mode, ''), CASE mode WHEN 'auto_injected' THEN 0 WHEN 'tool_search_returned' THEN 1 WHEN 'tool_get' THEN 2 ELSE 3 END) AS rm FROM t_exp GROUP BY ALL) USING (turn_id, memory_id) GROUP BY memory_id")),
    "ag_evidence": (evidence_counts, sql("SELECT evidence, count(*) AS n, round(avg(confidence), 6) AS mean_confidence FROM t_att GROUP BY evidence")),
    "wn_history": (history, sql(f"SELECT 'created' AS event, {iso('created_at')} AS at, 'source=' || source || ', type=' || type AS detail FROM t_mem WHERE doc_id = one.one UNION ALL SELECT 'attributed', {iso('created_at')}, evidence || ' conf=' || confidence::VARCHAR || ' msg=' || message_id[:20] FROM t_att, one WHERE memory_id = one.id UNION ALL SELECT 'exposed', {iso('created_at')}, mode || ' turn=' || turn_id[:20] FROM t_exp, one WHERE memory_id = one.id".replace("FROM t_mem WHERE doc_id = one.one", "FROM t_mem JOIN one USING (id)"), one="SELECT sha256(text) AS id FROM documents WHERE doc_id = 1")),
    "cq_graph": (graph_export, sql("SELECT memory_a[:8] AS a, memory_b[:8] AS b, round(weight, 3) AS weight FROM t_edge")),
    "cq_graph_dot": (graph_dot, sql("""SELECT 0 AS part, 'graph associations {' || chr(10) || '  node [shape=box, style=rounded];' AS line UNION ALL SELECT 3, '}'
        UNION ALL SELECT 1, '  "' || id[:8] || '" [label="' || id[:8] || '\\n' || CASE WHEN consolidated THEN 'C' ELSE 'W' END || ' str=' || format('{:.2f}', floor(strength * 100 + 0.5) / 100) || '\\n' || replace(replace(replace(CASE WHEN length(content) > 30 THEN content[:27] || '...' ELSE content END, '\\', '\\\\'), chr(10), '\\n'), '"', '\\"') || '"];' FROM t_mem
        UNION ALL SELECT 2, '  "' || memory_a[:8] || '" -- "' || memory_b[:8] || '" [label="' || format('{:.2f}', floor(round(weight, 3) * 100 + 0.5) / 100) || '"];' FROM t_edge""")),
    "fn_context_lines": (context_lines, sql("""SELECT '- [' || id[:8] || '|' || type || '|' || CASE WHEN doc_id % 4 = 1 THEN strftime(temporal_anchor, '%Y-%m-%d') ELSE 'strength=' || format('{:.2f}', floor(strength * 100 + 0.5) / 100) END || '] "' || CASE WHEN length(content) > 200 AND doc_id % 4 <> 1 THEN content[:197] || '...' ELSE content END || '"' AS line FROM (FROM t_mem WHERE strength > 0.05 ORDER BY strength DESC, created_at DESC, id LIMIT 20)""")),
    "fn_sleep_debt": (sleep_debt, sql("SELECT doc_id, CASE WHEN doc_id % 2 = 1 THEN CASE WHEN doc_id % 3 > 0 THEN 'never' ELSE '' END WHEN created_at < TIMESTAMP '2024-01-30 00:00:00' THEN 'overdue' ELSE '' END AS debt FROM t_mem")),
    "fn_import_strength": (import_strengths, sql("SELECT doc_id, round(CASE WHEN temporal_anchor IS NULL OR temporal_anchor >= DATE '2024-02-01' THEN 1 ELSE greatest(0.05, 0.977::DOUBLE ** date_diff('day', temporal_anchor, TIMESTAMP '2024-02-01')) END, 6) AS strength FROM t_mem")),
    "cq_temporal_transition": (due_later, sql(f"SELECT doc_id, CASE WHEN temporal_state = 'future' AND temporal_anchor <= {NOW} THEN 'present' WHEN temporal_state = 'present' AND temporal_anchor <= {NOW} - INTERVAL 1 DAY THEN 'past' ELSE temporal_state END AS temporal_state FROM t_mem")),
}
