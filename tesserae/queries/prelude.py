"""The memory store of the synthetic tables in DuckDB SQL, as common table expressions that a query takes as needed."""

from __future__ import annotations

import re

NOW = "TIMESTAMP '2024-02-15 00:00:00'"
LAST = "TIMESTAMP '2024-01-25 00:00:00'"

PARTS: dict[str, str] = {
    "t_mem": """
        SELECT sha256(text) AS id, ['fact','preference','decision','plan','observation'][(doc_id % 5 + 1)::INT] AS type, text AS content,
          ['none','future','present','past'][(doc_id % 4 + 1)::INT] AS temporal_state,
          CASE WHEN doc_id % 4 > 0 THEN TIMESTAMP '2024-01-01 00:00:00' + to_days((doc_id % 60)::INT) END AS temporal_anchor,
          TIMESTAMP '2024-01-01 00:00:00' + to_hours(doc_id % 720) AS created_at,
          (doc_id * 37 % 101)::DOUBLE / 100 AS strength,
          ['agent_tool','auto_capture','consolidation','import'][(doc_id % 4 + 1)::INT] AS source, doc_id % 7 = 0 AS consolidated, doc_id
        FROM documents WHERE text IS NOT NULL AND doc_id IS NOT NULL
        QUALIFY row_number() OVER (PARTITION BY text ORDER BY doc_id) = 1""",
    "t_raw": """
        SELECT user_id::VARCHAR AS session_id, user_id::VARCHAR || ':' || strftime(ts, '%Y-%m-%d') AS turn_id, id AS memory_id,
          CASE event_type WHEN 'view' THEN 'auto_injected' WHEN 'purchase' THEN 'tool_get' WHEN 'signup' THEN 'tool_store' ELSE 'tool_search_returned' END AS mode,
          value AS score, CASE event_type WHEN 'error' THEN 'bm25_only' WHEN 'view' THEN 'hybrid' WHEN 'click' THEN 'hybrid' END AS retrieval_mode,
          ts::TIMESTAMP AS created_at, event_id, json_extract_string(props, '$.k')::INT AS k
        FROM events JOIN t_mem ON t_mem.doc_id = event_id * 7919 % (SELECT count(*) FROM documents)""",
    "t_exp": """
        SELECT * FROM t_raw QUALIFY row_number() OVER (PARTITION BY session_id, turn_id, memory_id, mode ORDER BY event_id) = 1""",
    "t_att_raw": """
        SELECT turn_id || ':msg:0' AS message_id, memory_id, turn_id, created_at, event_id AS seq, evidence,
          CASE evidence WHEN 'auto_injected' THEN 0.15 WHEN 'tool_search_returned' THEN 0.3 WHEN 'tool_get' THEN 0.6 WHEN 'agent_feedback_positive' THEN 0.95 WHEN 'agent_feedback_neutral' THEN 0.4 ELSE -0.5 END::DOUBLE AS confidence
        FROM (SELECT *, CASE WHEN mode <> 'tool_store' THEN mode WHEN k % 5 >= 3 THEN 'agent_feedback_positive' WHEN k % 5 = 2 THEN 'agent_feedback_neutral' ELSE 'agent_feedback_negative' END AS evidence FROM t_raw)""",
    "t_att": """
        SELECT message_id, memory_id, evidence, confidence, first_value(turn_id) OVER w AS turn_id, min(created_at) OVER w AS created_at,
          CASE WHEN seq = first_value(seq) OVER w THEN NULL ELSE own_at END AS updated_at
        FROM (SELECT *, created_at AS own_at FROM t_att_raw)
        WINDOW w AS (PARTITION BY message_id, memory_id ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)
        QUALIFY row_number() OVER (PARTITION BY message_id, memory_id ORDER BY evidence LIKE 'agent_feedback_%' DESC, confidence DESC, seq) = 1""",
    "t_emb": "SELECT id, embedding::FLOAT[] AS embedding FROM embeddings JOIN t_mem ON vec_id = doc_id",
    "t_sets": """
        SELECT turn_id, memory_id, list_sort(list(DISTINCT mode)) AS modes, min(created_at) AS a, max(created_at) AS z FROM t_exp WHERE created_at < TIMESTAMP '2024-01-15 00:00:00' GROUP BY ALL""",
    "t_edge": """
        SELECT a.memory_id AS memory_a, b.memory_id AS memory_b, 1 - product(1 - CASE WHEN a.modes = b.modes THEN 0.05 ELSE 0.15 END::DOUBLE) AS weight,
          TIMESTAMP '2024-01-15 00:00:00' AS created_at
        FROM t_sets a JOIN t_sets b ON a.turn_id = b.turn_id AND a.memory_id < b.memory_id GROUP BY a.memory_id, b.memory_id""",
    "t_dir": "SELECT memory_a AS node, memory_b AS neighbour, weight FROM t_edge UNION ALL SELECT memory_b, memory_a, weight FROM t_edge",
    "t_alias": """
        SELECT a.id AS old_id, b.id AS new_id FROM t_mem a JOIN t_mem b ON b.doc_id = a.doc_id + 3 WHERE a.doc_id % 3 = 0 AND a.doc_id % 30 <> 0""",
    "t_tok": """
        SELECT id, strength, created_at, content, regexp_extract_all(strip_accents(lower(content)), '[\\p{L}\\p{N}]+') AS ct, regexp_extract_all(strip_accents(lower(type)), '[\\p{L}\\p{N}]+') AS tt FROM t_mem""",
}


def sql(body: str, **parts: str) -> str:
    """A query with those common table expressions in front that it or they name; parts are more of them, in order."""
    every = PARTS | parts
    need: set[str] = set()

    def look(text: str) -> None:
        for name in every:
            if name not in need and re.search(rf"\b{name}\b", text):
                need.add(name)
                look(every[name])

    look(body)
    if not need:
        return body
    return "WITH " + ",\n".join(f"{name} AS ({every[name].strip()})" for name in every if name in need) + "\n" + body


def iso(column: str) -> str:
    return f"strftime({column}, '%Y-%m-%dT%H:%M:%S.%gZ')"
