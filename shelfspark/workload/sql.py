"""SQL of the derived tables, as named parts of a WITH clause."""

from __future__ import annotations

import re

_USER = "'u' || CAST({0} % 5 AS VARCHAR)"
_FILE_ID = "lpad(CAST({0} AS VARCHAR), 32, '0')"
_KB = "'KB_u' || CAST(doc_id % 5 AS VARCHAR) || '_' || source"
_NAME = (
    "source || '_' || CAST(doc_id AS VARCHAR) || CASE doc_id % 4 WHEN 0 THEN '.txt' "
    "WHEN 1 THEN '.md' WHEN 2 THEN '.csv' ELSE '.eml' END"
)

PARTS: dict[str, str] = {
    "users": f"""
        SELECT DISTINCT {_USER.format('doc_id')} AS user_id,
               'user ' || {_USER.format('doc_id')} AS user_name FROM documents""",
    "kbs": f"""
        SELECT DISTINCT {_KB} AS kb_id, {_USER.format('doc_id')} AS user_id, source AS kb_name,
               CASE WHEN source = 'src7' THEN 1 ELSE 0 END AS deleted FROM documents""",
    "files": f"""
        SELECT {_FILE_ID.format('doc_id')} AS file_id, {_KB} AS kb_id, {_NAME} AS file_name,
               CASE WHEN doc_id % 17 = 0 THEN 'red' WHEN doc_id % 13 = 0 THEN 'yellow'
                    WHEN doc_id % 11 = 0 THEN 'gray' ELSE 'green' END AS status,
               '202401' || lpad(CAST(doc_id % 28 + 1 AS VARCHAR), 2, '0') || '0930' AS timestamp,
               CASE WHEN doc_id % 19 = 0 THEN 1 ELSE 0 END AS deleted,
               n_chars AS file_size FROM documents""",
    "live_files": "SELECT * FROM files WHERE deleted = 0",
    "texts": f"""
        SELECT {_FILE_ID.format('doc_id')} AS file_id, text FROM documents""",
    "numbers10": "SELECT CAST(i AS INTEGER) AS chunk_idx FROM range(10) t(i)",
    "chunks": f"""
        SELECT {_USER.format('doc_id')} AS user_id, {_KB} AS kb_id,
               {_FILE_ID.format('doc_id')} AS file_id, {_NAME} AS file_name, chunk_idx,
               {_FILE_ID.format('doc_id')} || '_' || CAST(chunk_idx AS VARCHAR) AS chunk_id,
               substring(text, chunk_idx * length(text) // 10 + 1,
                         (chunk_idx + 1) * length(text) // 10
                         - chunk_idx * length(text) // 10) AS content
        FROM documents CROSS JOIN numbers10""",
    "vectors": f"""
        SELECT {_USER.format('doc_id')} AS user_id, {_KB} AS kb_id,
               {_FILE_ID.format('doc_id')} AS file_id, chunk_idx,
               list_concat(embedding[turned + 1:], embedding[:turned]) AS embedding
        FROM (SELECT d.doc_id, d.source, c.chunk_idx, e.embedding,
                     (d.doc_id * 10 + c.chunk_idx) // n.n % len(e.embedding) AS turned
              FROM documents d CROSS JOIN numbers10 c CROSS JOIN (SELECT count(*) AS n FROM embeddings) n
              JOIN embeddings e ON e.vec_id = (d.doc_id * 10 + c.chunk_idx) % n.n)""",
    "spoken": """
        SELECT *, lead(role) OVER w AS next_role, lead(text) OVER w AS next_text
        FROM conversations WHERE role IN ('user', 'assistant')
        WINDOW w AS (PARTITION BY conv_id ORDER BY turn, role, text)""",
    "pairs": """
        SELECT conv_id, turn, text AS q, next_text AS a FROM spoken
        WHERE role = 'user' AND next_role = 'assistant'""",
    "first_pairs": """
        SELECT conv_id, q, a FROM (
          SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS n FROM pairs)
        WHERE n = 1""",
    "queries": f"""
        SELECT CAST(e.vec_id AS VARCHAR) AS query_id, {_USER.format('e.vec_id')} AS user_id,
               b.text AS question, e.embedding AS qvec, p.q AS hq, p.a AS ha
        FROM (SELECT vec_id, embedding, vec_id % n AS item
              FROM embeddings CROSS JOIN (SELECT count(*) AS n FROM benchmark)) e
        JOIN benchmark b ON b.item_id = e.item
        LEFT JOIN first_pairs p ON p.conv_id = e.vec_id""",
    "scored": """
        SELECT q.query_id, q.user_id, v.file_id, v.chunk_idx, v.kb_id,
               round(list_inner_product(CAST(q.qvec AS DOUBLE[]), CAST(v.embedding AS DOUBLE[])),
                     10) AS ip
        FROM queries q JOIN vectors v ON v.user_id = q.user_id""",
    "ranked": """
        SELECT *, row_number() OVER (PARTITION BY query_id
                                     ORDER BY ip DESC, file_id, chunk_idx) AS rank FROM scored""",
    "service_events": """
        SELECT event_type AS service, ts, event_id AS seq,
               CASE WHEN event_type = 'error' OR value > 100 THEN 'unhealthy' ELSE 'healthy' END
                 AS status,
               CASE WHEN k % 3 <> 0 THEN 'k=' || CAST(k AS VARCHAR) END AS detail,
               CASE WHEN k % 4 <> 0 THEN value END AS latency_ms
        FROM (SELECT *, CAST(regexp_extract(props, '"k": *([0-9]+)', 1) AS INTEGER) AS k
              FROM events)""",
}


def retrieval(k: int, max_distance: float = 1.1) -> dict[str, str]:
    """Hits up to ordered contexts for top ``k``."""
    return {
        "hits": f"""
        SELECT query_id, user_id, file_id, chunk_idx, 1 - ip AS dist, rank
        FROM ranked WHERE rank <= {k}""",
        "near": f"""
        SELECT query_id, user_id, file_id, chunk_idx, dist, rank FROM (
          SELECT *, bool_or(dist <= {max_distance}) OVER (PARTITION BY query_id) AS any_near
          FROM hits) WHERE dist <= {max_distance} OR NOT any_near""",
        "named": """
        SELECT h.*, c.file_name, c.content,
               regexp_matches(lower(c.file_name), '(^|\\.)(csv|xlsx)$') AS tabular
        FROM near h JOIN chunks c ON c.file_id = h.file_id AND c.chunk_idx = h.chunk_idx""",
        "walk": """
        SELECT h.query_id, h.file_id, h.chunk_idx AS centre, c.chunk_idx AS idx,
               sum(length(c.content)) OVER (
                 PARTITION BY h.query_id, h.file_id, h.chunk_idx
                 ORDER BY 2 * abs(c.chunk_idx - h.chunk_idx)
                          + CASE WHEN c.chunk_idx < h.chunk_idx THEN 1 ELSE 0 END) AS total
        FROM named h JOIN chunks c ON c.file_id = h.file_id
         AND c.chunk_idx BETWEEN h.chunk_idx - 199 AND h.chunk_idx + 199
        WHERE NOT h.tabular""",
        "kept": "SELECT DISTINCT query_id, file_id, idx FROM walk WHERE total <= 800 OR idx = centre",
        "members": """
        SELECT k.query_id, k.file_id, k.idx, h.dist, c.file_name, c.content,
               k.idx - row_number() OVER (PARTITION BY k.query_id, k.file_id ORDER BY k.idx)
                 AS island
        FROM kept k JOIN chunks c ON c.file_id = k.file_id AND c.chunk_idx = k.idx
        LEFT JOIN near h ON h.query_id = k.query_id AND h.file_id = k.file_id
                        AND h.chunk_idx = k.idx""",
        "runs": """
        SELECT query_id, file_id, min(file_name) AS file_name, min(idx) AS run_start,
               max(idx) AS run_end, string_agg(content, ' ' ORDER BY idx) AS content,
               string_agg(content, '|' ORDER BY idx) FILTER (WHERE dist IS NOT NULL) AS kernel,
               round(1 - coalesce(min(dist), sqrt(2)), 4) AS score
        FROM members GROUP BY query_id, file_id, island""",
        "found": """
        SELECT query_id, file_id, file_name, chunk_idx AS run_start, chunk_idx AS run_end, content,
               content AS kernel, 1 - dist AS score, 0 AS arrival, rank AS arrival_rank
        FROM named WHERE tabular
        UNION ALL
        SELECT query_id, file_id, file_name, run_start, run_end, content, coalesce(kernel, ''),
               score, 1, 0 FROM runs""",
        "unique_found": """
        SELECT * FROM (
          SELECT *, row_number() OVER (PARTITION BY query_id, content
                      ORDER BY arrival, arrival_rank, file_id, run_start) AS seen FROM found)
        WHERE seen = 1""",
        "ordered": """
        SELECT *, row_number() OVER (PARTITION BY query_id
                    ORDER BY score DESC, arrival, arrival_rank, file_id, run_start) AS position
        FROM unique_found""",
    }


def budgeted(token_window: int, template_tokens: int) -> dict[str, str]:
    """Token budget over ordered contexts."""
    fixed = token_window - token_window // 2 - 50
    return {
        "budgets": f"""
        SELECT query_id, question, {fixed} - (length(question) // 4 + 3)
               - (coalesce(length(hq) // 4, 0) + coalesce(length(ha) // 4, 0) + 3)
               - {template_tokens} AS budget FROM queries""",
        "sized": """
        SELECT o.*, b.budget, length(o.content) // 4 AS tokens,
               sum(length(o.content) // 4) OVER (PARTITION BY o.query_id ORDER BY o.position) AS used
        FROM ordered o JOIN budgets b ON b.query_id = o.query_id""",
        "overs": """
        SELECT *, sum(CASE WHEN used > budget THEN 1 ELSE 0 END) OVER (
                    PARTITION BY query_id ORDER BY position) AS n_over,
               length(content) - greatest(0, CAST(ceil((length(content)
                 - (4 * (budget - (used - tokens) - 3) + 3)) / 100.0) AS BIGINT)) * 100 AS rest
        FROM sized""",
        "packed": """
        SELECT query_id, file_id, file_name, run_start, position, score, kernel,
               CASE WHEN used <= budget THEN content
                    WHEN rest > 0 THEN substring(content, (length(content) - rest) // 2 + 1, rest)
                    ELSE '' END AS content
        FROM overs WHERE used <= budget OR n_over = 1""",
    }


# Parts that are read several times or dear to compute.
MATERIALIZED = {"chunks", "vectors", "queries", "scored", "hits", "named", "found", "ordered", "packed"}


def with_parts(body: str, extra: dict[str, str] | None = None) -> str:
    """``body`` behind a WITH clause of the parts it needs, in dependency order."""
    known = {**PARTS, **(extra or {})}
    order: list[str] = []

    def visit(text: str) -> None:
        for word in re.findall(r"\b[a-z_0-9]+\b", text):
            if word in known and word not in order and word not in pending:
                pending.add(word)
                visit(known[word])
                order.append(word)

    pending: set[str] = set()
    visit(body)
    parts = ",\n".join(
        f"{name} AS {'MATERIALIZED ' * (name in MATERIALIZED)}({known[name].strip()})"
        for name in order
    )
    return f"WITH {parts}\n{body}" if parts else body


def registry(parts: dict[str, str] | None = None):
    """(queries, sqls, decorator) of one module; the decorator files a query with its SQL."""
    queries: dict = {}
    sqls: dict[str, str] = {}

    def register(name: str, sql: str | None = None, more: dict[str, str] | None = None):
        def keep(query):
            queries[name] = query
            if sql is not None:
                sqls[name] = with_parts(sql, {**(parts or {}), **(more or {})})
            return query

        return keep

    return queries, sqls, register
