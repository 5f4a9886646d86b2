"""Queries with their SQL; the SQL may name the derived views, which are put in front."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ..sources.tables import Table, tables

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}

VIEWS = {
    "v_books": """SELECT concat('book-', doc_id) AS book_id, concat('Title ', doc_id) AS title, source AS author, lower(trim(source)) AS author_norm,
  CAST(1990 + doc_id % 35 AS INTEGER) AS year, [lang, concat('t', doc_id % 5)] AS tags_norm,
  CASE WHEN doc_id % 2 = 0 THEN 'application/pdf' ELSE 'application/epub+zip' END AS media_type,
  TIMESTAMP '2024-01-01 00:00:00' + to_minutes(CAST(doc_id // 3 AS INTEGER)) AS created_at, sha256(text) AS source_sha256, doc_id AS book_no FROM documents""",
    "v_pages": """SELECT concat('book-', doc_id) AS book_id, page_no,
  concat(CASE WHEN page_no % 5 = 1 THEN concat('Chapter ', (page_no - 1) // 5 + 1, ': ', source, chr(10))
              WHEN page_no % 5 = 3 THEN concat('Section ', page_no, '. ', source, chr(10)) ELSE '' END, body) AS text
FROM (SELECT doc_id, source, CAST((line_no - 1) // 4 + 1 AS INTEGER) AS page_no, string_agg(line, chr(10) ORDER BY line_no) AS body
      FROM (SELECT doc_id, source, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS line_no FROM documents) GROUP BY ALL)""",
    "v_index_jobs": """SELECT concat('job-', doc_id, '-v', v) AS job_id, concat('book-', doc_id) AS book_id, CAST(v AS BIGINT) AS lifecycle_version,
  CASE WHEN doc_id % 13 = 0 AND v = 2 THEN 'pending' WHEN doc_id % 17 = 0 THEN 'failed' ELSE 'indexed' END AS state
FROM documents, (VALUES (1),(2)) t(v) WHERE v = 1 OR doc_id % 4 = 0""",
    "v_book_lifecycle": """SELECT book_id, latest AS lifecycle_version, CASE WHEN v IS NULL THEN NULL ELSE concat('job-', substr(book_id, 6), '-v', v) END AS active_job_id,
  CASE WHEN CAST(substr(book_id, 6) AS BIGINT) % 10 = 0 THEN 'deleting' WHEN v < latest THEN 'reindexing' ELSE 'active' END AS state
FROM (SELECT book_id, max(lifecycle_version) FILTER (WHERE state = 'indexed') AS v, max(lifecycle_version) AS latest FROM v_index_jobs GROUP BY 1)""",
    "v_evidence": """SELECT concat(j.job_id, ':p', p.page_no) AS evidence_id, concat('p', p.page_no) AS chunk_id, j.job_id, p.book_id,
  b.title, b.author, b.author_norm, b.year, b.tags_norm, p.page_no AS page_start, p.page_no AS page_end, p.text AS passage
FROM v_pages p JOIN v_index_jobs j USING (book_id) JOIN v_books b USING (book_id)""",
    "v_active": """SELECT j.book_id, j.job_id FROM v_index_jobs j JOIN v_book_lifecycle l ON l.book_id = j.book_id AND l.active_job_id = j.job_id
WHERE j.state = 'indexed' AND l.state IN ('active', 'reindexing')""",
    "v_chunk_vectors": """SELECT concat('vjob-', label, ':c', vec_id) AS evidence_id, concat('c', vec_id) AS chunk_id, concat('vjob-', label) AS job_id, concat('vbook-', label) AS book_id,
  concat('author ', label % 3) AS author_norm, CAST(2000 + vec_id % 25 AS INTEGER) AS year, [concat('t', vec_id % 2), concat('u', vec_id % 3)] AS tags_norm,
  CAST(vec_id % 40 + 1 AS INTEGER) AS page_start, CAST(vec_id % 40 + 2 AS INTEGER) AS page_end, vec_id, label, CAST(embedding AS DOUBLE[]) AS embedding FROM embeddings""",
    "v_scored": """SELECT q.vec_id AS query_id, c.*, round(list_dot_product(CAST(q.embedding AS DOUBLE[]), c.embedding), 6) AS score
FROM v_chunk_vectors c, (SELECT * FROM embeddings WHERE vec_id % 100 = 0) q""",
    "v_facts": """SELECT concat('ev-', event_id) AS event_id, concat('book-', user_id) AS book_id, ts AS occurred_at,
  CASE event_type WHEN 'signup' THEN 'uploaded' WHEN 'view' THEN 'started' WHEN 'click' THEN 'chunks_ready' WHEN 'purchase' THEN 'indexed' ELSE 'failed' END AS kind,
  CAST(1 + event_id % 3 AS BIGINT) AS lifecycle_version, sha256(props) AS payload_digest, event_id AS n FROM events""",
    "v_deliveries": """SELECT event_id, book_id, occurred_at, kind, lifecycle_version, payload_digest FROM v_facts UNION ALL
SELECT event_id, book_id, occurred_at, kind, lifecycle_version, CASE WHEN n % 100 = 0 THEN sha256('x') ELSE payload_digest END FROM v_facts WHERE n % 10 = 0""",
    "v_outbox": """SELECT concat('ob-', l_orderkey, '-', l_linenumber) AS event_id, l_orderkey AS aggregate_id, l_linenumber AS sequence,
  l_shipdate AS next_attempt_at, (l_linestatus = 'F') AS published, CAST(l_quantity AS BIGINT) % 6 AS attempts FROM lineitem""",
    "v_questions": """SELECT concat(conv_id, '-', turn) AS query_id, text AS question FROM conversations WHERE role = 'user'""",
    "v_words": r"""SELECT query_id, question, list_filter(string_split_regex(regexp_replace(lower(question), '[^\p{L}\p{N}]', ' ', 'g'), '\s+'), lambda w: w <> '') AS words FROM v_questions""",
}


def _needed(sql: str, found: list[str]) -> list[str]:
    for name in VIEWS:
        if name not in found and re.search(rf"\b{name}\b", sql):
            _needed(VIEWS[name], found)
            if name not in found:
                found.append(name)
    return found


def with_views(sql: str) -> str:
    views = ",\n".join(f"{n} AS ({VIEWS[n]})" for n in _needed(sql, []))
    sql = sql.strip()
    if not views:
        return sql
    return f"WITH {views},\n{sql[5:]}" if sql[:5].upper() == "WITH " else f"WITH {views}\n{sql}"


def query(sql: str | None = None):
    """Registers a function of the tables under its name, with SQL where SQL can express it."""

    def register(f: Callable[[Table], DataFrame]):
        QUERIES[f.__name__] = lambda spark, sf_dir: f(tables(spark, sf_dir))
        if sql is not None:
            ORACLE[f.__name__] = with_views(sql)
        return f

    return register
