"""Registered queries over whole files: chunking, reports, limits; tests hold those without SQL against brute force."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators.chunkers import chunk_files
from ..operators.corpus import searchable, unique_files
from ..operators.maintain import audit_events, audit_time
from ..operators.retrieval import keyword_chunks
from ..sources.tables import read
from ..streaming.limits import limited_requests
from . import oracle as O
from . import report
from .search import SECOND


def rate_limit_exact(s, d):
    """Requests of the audit log that pass three a day and actor."""
    e = audit_events(read(s, d, "audit_log")).withColumn("at", audit_time(F.col("logged_at")))
    return limited_requests(e, "actor_id", "at", "audit_id", limit=3, seconds=86_400)


def markdown_sections(s, d):
    """Chunks of the Markdown files that have headings; a section of more than two chunks comes in pieces."""
    c = chunk_files(unique_files(read(s, d, "files"))).where("language = 'markdown' and symbol_type = 'section'")
    return c.select("repository_id", "file_path", "chunk_index", F.col("start_line").cast("bigint").alias("start_line"), "symbol_name", "content")


def fallback_answer(s, d):
    c = searchable(read(s, d, "chunks"))
    return report.evidence(keyword_chunks(c, SECOND, 5), c)


def queries():
    return {
        "chunk_files": lambda s, d: chunk_files(unique_files(read(s, d, "files"))),
        "markdown_sections": markdown_sections,
        "project_reports": lambda s, d: report.reports(read(s, d, "files")),
        "front_pages": lambda s, d: report.front_pages(read(s, d, "files")),
        "fallback_answer": fallback_answer,
        "rate_limit_exact": rate_limit_exact,
    }


def oracle_sql():
    from .repository import _ENDS, _LANGUAGE, _redact

    ls = f"CASE WHEN content = '' THEN [] ELSE string_split_regex(regexp_replace(content, '(?:{_ENDS})$', ''), '{_ENDS}') END"
    sections = f"""WITH {O.FILES}, p AS (SELECT repository_id, file_path, {ls} AS ls FROM f WHERE content IS NOT NULL AND {_LANGUAGE} = 'markdown'),
l AS (SELECT repository_id, file_path, ls, unnest(ls) AS text, generate_subscripts(ls, 1) AS line FROM p),
h AS (SELECT *, lead(line) OVER (PARTITION BY repository_id, file_path ORDER BY line) AS next FROM l WHERE text LIKE '#%'),
c AS (SELECT repository_id, file_path, line, regexp_replace(regexp_replace(text, '^#+', ''), '^\\s+|\\s+$', '', 'g') AS symbol_name, regexp_replace(array_to_string(ls[line:coalesce(next - 1, len(ls))], chr(10)), '^\\s+|\\s+$', '', 'g') AS content FROM h)
SELECT repository_id, file_path, CAST(row_number() OVER (PARTITION BY repository_id, file_path ORDER BY line) - 1 AS INTEGER) AS chunk_index, line AS start_line, symbol_name, content FROM c WHERE content <> ''"""
    # requests in the order of an actor, each with the times that passed before it and still count
    limits = """WITH RECURSIVE a AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY audit_id ORDER BY arrived_at NULLS FIRST, logged_at NULLS FIRST, event NULLS FIRST, outcome NULLS FIRST, actor_id NULLS FIRST, repository_fingerprint NULLS FIRST) AS rn FROM audit_log WHERE audit_id IS NOT NULL) WHERE rn = 1),
t AS (SELECT audit_id, actor_id, CASE WHEN regexp_full_match(trim(logged_at), '\\d{9,11}(\\.\\d+)?') THEN trim(logged_at)::DOUBLE
  WHEN regexp_matches(trim(logged_at), '^\\d{4}-\\d\\d-\\d\\d[T ]\\d\\d:\\d\\d') THEN epoch(TRY_CAST(regexp_replace(replace(trim(logged_at), 'T', ' '), '(?:Z|\\+00:?00| UTC)$', '') AS TIMESTAMP)) END AS ts FROM a),
q AS (SELECT *, row_number() OVER (PARTITION BY actor_id ORDER BY ts, audit_id) AS i FROM t WHERE actor_id IS NOT NULL AND ts IS NOT NULL),
r AS (SELECT audit_id, actor_id, ts, i, [ts] AS passed, true AS allowed FROM q WHERE i = 1
  UNION ALL SELECT x.audit_id, x.actor_id, x.ts, x.i, CASE WHEN len(x.p) < 3 THEN list_append(x.p, x.ts) ELSE x.p END, len(x.p) < 3
  FROM (SELECT q.*, list_filter(r.passed, lambda v: v >= q.ts - 86400) AS p FROM r JOIN q ON q.actor_id = r.actor_id AND q.i = r.i + 1) x)
SELECT audit_id, actor_id, allowed FROM r"""
    flat = f"trim(regexp_replace({_redact('content')}, '\\s+', ' ', 'g'))"
    answer = f"""WITH {O.CHUNKS}, {O.keyword_list("k", SECOND, 5)}, x AS (SELECT k.repository_id, k.rank, file_path, chunk_index, start_line, end_line, symbol_name, {flat} AS flat FROM k JOIN c USING (repository_id, file_path, chunk_index))
SELECT repository_id, string_agg(rank || '. ' || CASE WHEN length(flat) > 260 THEN substring(flat, 1, 260) || '...' ELSE flat END || chr(10) || '   `' || file_path || '#' || chunk_index || ' lines ' || coalesce(start_line::VARCHAR, '?') || '-' || coalesce(end_line::VARCHAR, '?')
  || CASE WHEN coalesce(symbol_name, '') <> '' THEN ' symbol=' || symbol_name ELSE '' END || '`', chr(10) ORDER BY rank) AS answer FROM x GROUP BY 1"""
    return {"markdown_sections": sections, "rate_limit_exact": limits, "fallback_answer": answer}
