"""Registered queries over repositories -- filters, statistics, manifests, catalog, audit, analyses -- and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import filters as FL
from ..functions import languages as LG
from ..functions import text as TX
from ..operators import analyze as A
from ..operators import maintain as M
from ..operators import stats as S
from ..operators.corpus import KEY, unique_chunks, unique_files
from ..sources.tables import read
from . import oracle as O


def _files(fn, **kw):
    return lambda s, d: fn(read(s, d, "files"), **kw)


def path_filter(s, d):
    p = F.col("file_path")
    return read(s, d, "files").where("file_path is not null").select("file_path").distinct().select("file_path", FL.in_ignored_folder(p).alias("ignored_folder"), FL.file_rule(p).alias("rule"), FL.included(p).alias("included"))


def language_lookup(s, d):
    p = F.col("file_path")
    return read(s, d, "files").where("file_path is not null").groupBy(LG.language(p).alias("language"), LG.extension(p).alias("extension")).agg(F.count(F.lit(1)).alias("files"))


def redact_chunks(s, d):
    c = unique_chunks(read(s, d, "chunks"))
    return c.select(*KEY, TX.redact(F.col("content")).alias("redacted")).where("redacted like '%[REDACTED]%'")


def debug_preview(s, d):
    c = unique_chunks(read(s, d, "chunks")).withColumn("content", F.coalesce("content", F.lit("")))
    return c.select(*KEY, F.substring(TX.redact(F.col("content")), 1, 260).alias("preview"), TX.preview(F.col("content")).alias("line"))


def incremental_diff(s, d):
    out = M.diff_manifest(M.build_manifest(read(s, d, "chunks")), read(s, d, "index_manifest"))
    return out.select("repository_id", "file_path", "change", F.size("delete_ids").alias("deleted"), F.size("insert_ids").alias("inserted"))


def catalog_list(s, d):
    return M.catalog(read(s, d, "repo_catalog"), read(s, d, "index_manifest"), read(s, d, "chunks"))


def sliding_request_count(s, d):
    return M.requests_in_window(read(s, d, "events"), "user_id", "ts", "event_id", 3600).select("event_id", "user_id", "requests")


def json_props(s, d):
    e = read(s, d, "events").withColumn("p", F.from_json("props", "map<string,string>"))
    return e.select("event_type", F.explode(F.map_keys("p")).alias("key")).groupBy("event_type", "key").agg(F.count(F.lit(1)).alias("events"))


def validate_sources(s, d):
    r = read(s, d, "repo_catalog").select("repository_id", "github_url").distinct()
    return r.select("repository_id", "github_url", TX.valid_repository_id(F.col("repository_id")).alias("valid_id"), TX.canonical_repository_url(F.col("github_url")).alias("canonical"))


def source_citations(s, d):
    return M.citations(read(s, d, "chunks"), read(s, d, "repo_catalog"))


def _models(s, d):
    m = A.database_models(read(s, d, "files"), None)
    return m.select("repository_id", "technology", "file_path", F.col("line").cast("bigint").alias("line"), "detail", "model_name", F.array_join("fields", ",").alias("fields"), F.array_join("relationships", ",").alias("relationships"))


def _routes(s, d):
    return A.api_endpoints(read(s, d, "files"), None).withColumn("line", F.col("line").cast("bigint"))


def _imports(s, d):
    return A.script_imports(read(s, d, "files")).withColumn("line", F.col("line").cast("bigint"))


def queries():
    return {
        "path_filter": path_filter,
        "language_lookup": language_lookup,
        "redact_chunks": redact_chunks,
        "debug_preview": debug_preview,
        "core_modules": _files(S.core_modules),
        "largest_files": _files(S.largest_files),
        "repository_counts": _files(S.repository_counts),
        "directory_tree": _files(S.directory_tree),
        "entry_points": _files(S.entry_points),
        "within_budget": _files(S.within_budget, max_files=60, max_bytes=100_000),
        "tree_signature": _files(M.tree_signature),
        "file_hash_manifest": lambda s, d: M.build_manifest(read(s, d, "chunks")).withColumn("chunk_ids", F.array_join("chunk_ids", " ")),
        "incremental_diff": incremental_diff,
        "index_result": lambda s, d: M.index_result(M.diff_manifest(M.build_manifest(read(s, d, "chunks")), read(s, d, "index_manifest"))),
        "catalog_list": catalog_list,
        "audit_summary": lambda s, d: M.audit_summary(read(s, d, "audit_log"), read(s, d, "repo_catalog")),
        "sliding_request_count": sliding_request_count,
        "json_props": json_props,
        "validate_sources": validate_sources,
        "source_citations": source_citations,
        "api_endpoints": _routes,
        "database_models": _models,
        "entrypoint_findings": _files(A.entrypoint_findings, limit=None),
        "script_imports": _imports,
        "python_imports": _files(A.python_imports),
        "module_dependencies": _files(A.module_dependencies, limit=None),
        "module_dependencies_shown": _files(A.module_dependencies),
        "call_graph": _files(A.call_graph, limit=None),
        "call_graph_shown": _files(A.call_graph),
        "technology_stack": _files(A.technology_stack),
        "startup_hints": _files(A.startup_hints),
        "deployment_methods": _files(A.deployment_methods),
        "environment_variables": _files(A.environment_variables, limit=None),
    }


# -- SQL ------------------------------------------------------------------------

_NAME = "lower(string_split(file_path, '/')[-1])"
_EXT = f"regexp_extract({_NAME}, '^.+(\\.[^.]*)$', 1)"


def _in(x: str, words) -> str:
    return f"{x} IN ({', '.join(O.quote(w) for w in words)})"


def _case(x: str, table: dict[str, str]) -> str:
    by: dict[str, list[str]] = {}
    for k, v in table.items():
        by.setdefault(v, []).append(k)
    return " ".join(f"WHEN {_in(x, ks)} THEN {O.quote(v)}" for v, ks in by.items())


_LANGUAGE = f"CASE {_case(_NAME, LG.LANGUAGE_BY_FILENAME)} {_case(_EXT, LG.LANGUAGE_BY_EXTENSION)} ELSE 'text' END"
_RULE = (
    f"CASE WHEN {_in(_NAME, FL.IGNORED_NAMES)} THEN 'name' WHEN {O.any_of(_NAME, FL.SENSITIVE_PARTS)} THEN 'sensitive' WHEN {_in(_EXT, FL.IGNORED_EXTENSIONS)} THEN 'extension' "
    f"WHEN {_in(_NAME, FL.KEPT_NAMES)} THEN 'kept_name' WHEN {_in(_EXT, LG.LANGUAGE_BY_EXTENSION)} THEN 'known' ELSE 'unknown' END"
)
_IGNORED = f"list_has_any(string_split(file_path, '/')[:-2], [{', '.join(O.quote(x) for x in FL.IGNORED_FOLDERS)}])"
_KEPT = f"NOT {_IGNORED} AND {_RULE} IN ('kept_name', 'known')"
_LISTED = f"l AS (SELECT repository_id, file_path, CAST(coalesce(size_bytes, 0) AS BIGINT) AS size_bytes, {_LANGUAGE} AS language FROM f WHERE {_KEPT})"
_SOURCE = f"src AS (SELECT repository_id, file_path, coalesce(content, '') AS content, {_EXT} AS ext, string_split(file_path, '/')[-1] AS name FROM f WHERE {_KEPT})"
_ENDS = "\\r\\n|[\\n\\r\\x0b\\x0c\\x1c-\\x1e\\x{85}\\x{2028}\\x{2029}]"


def _lines(name: str, where: str) -> str:
    return (
        f"{name} AS (SELECT repository_id, file_path, content, unnest(ls) AS text, generate_subscripts(ls, 1) AS line FROM "
        f"(SELECT *, CASE WHEN content = '' THEN [] ELSE string_split_regex(regexp_replace(content, '(?:{_ENDS})$', ''), '{_ENDS}') END AS ls FROM src WHERE {where}))"
    )


_ASSIGN = O.quote(TX.ASSIGNMENT)[1:-1].removeprefix("(?i)")


def _redact(x: str) -> str:
    # no back references here: one pattern a kind of quote; quoted values first, then bare ones that no quote follows as before
    def one(e: str, q: str) -> str:
        qq = q.replace("'", "''")
        return f"regexp_replace({e}, '(?i){_ASSIGN}{qq}[^\"''\\s,;]+{qq}', '\\1\\2{qq}[REDACTED]{qq}', 'g')"

    out = one(one(one(x, '"'), "'"), "")
    out = f"regexp_replace({out}, {O.quote(TX.BEARER)}, 'Bearer [REDACTED]', 'g')"
    return f"regexp_replace({out}, {O.quote(TX.DATABASE_URL)}, '\\1://[REDACTED]', 'g')"


_MANIFEST = """m AS (SELECT repository_id, file_path, sha256(string_agg(chunk_index::VARCHAR || coalesce(start_line::VARCHAR, '') || coalesce(end_line::VARCHAR, '') || coalesce(language, '') || coalesce(symbol_name, '') || coalesce(symbol_type, '') || content, '' ORDER BY chunk_index)) AS hash,
  CAST(count(*) AS INTEGER) AS chunk_count, string_agg(repository_id || ':' || file_path || ':' || chunk_index, ' ' ORDER BY chunk_index) AS chunk_ids FROM c GROUP BY 1, 2)"""
_DIFF = """o AS (SELECT * FROM (SELECT repository_id, file_path, hash, chunk_ids, row_number() OVER (PARTITION BY repository_id, file_path ORDER BY hash DESC NULLS LAST, chunk_ids DESC NULLS LAST) AS rn FROM index_manifest WHERE repository_id IS NOT NULL AND file_path IS NOT NULL) WHERE rn = 1),
d AS (SELECT coalesce(m.repository_id, o.repository_id) AS repository_id, coalesce(m.file_path, o.file_path) AS file_path,
  CASE WHEN o.rn IS NULL THEN 'added' WHEN m.hash IS NULL THEN 'removed' WHEN m.hash = o.hash THEN 'unchanged' ELSE 'changed' END AS change, coalesce(len(o.chunk_ids), 0) AS n_old, coalesce(m.chunk_count, 0) AS n_new
  FROM m FULL JOIN o ON m.repository_id = o.repository_id AND m.file_path = o.file_path),
x AS (SELECT repository_id, file_path, change, CAST(CASE WHEN change IN ('changed', 'removed') THEN n_old ELSE 0 END AS INTEGER) AS deleted, CAST(CASE WHEN change IN ('changed', 'added') THEN n_new ELSE 0 END AS INTEGER) AS inserted FROM d)"""


def _url() -> str:
    from_path = "list_filter(string_split(replace(file_path, '\\', '/'), '/'), lambda x: x <> '')"
    shape = "^https://github\\.com/+([^/?#]+)/+([^/?#]+?)(?:\\.git)?/*$"
    quoted = f"array_to_string(list_transform({from_path}, lambda x: url_encode(x)), '/')"
    anchor = "CASE WHEN start_line > 0 THEN '#L' || start_line || CASE WHEN end_line >= start_line THEN '-L' || end_line ELSE '' END ELSE '' END"
    return (
        f"CASE WHEN regexp_matches(github_url, '{shape}') AND NOT list_has_any({from_path}, ['.', '..']) AND len({from_path}) > 0 THEN "
        f"'https://github.com/' || regexp_extract(github_url, '{shape}', 1) || '/' || regexp_extract(github_url, '{shape}', 2) || '/blob/HEAD/' || {quoted} || coalesce({anchor}, '') END"
    )


_TREE = """d AS (SELECT DISTINCT repository_id, unnest(list_transform(generate_series(1, len(ps)), lambda i: array_to_string(ps[1:i], '/'))) AS entry, true AS folder
  FROM (SELECT repository_id, string_split(file_path, '/')[:-2] AS ps FROM l) WHERE len(ps) > 0),
e AS (SELECT repository_id, entry, folder, string_split(entry, '/') AS parts FROM d UNION ALL SELECT repository_id, file_path, false, string_split(file_path, '/') FROM l),
k AS (SELECT *, len(parts) AS n, list_transform(generate_series(1, len(parts)), lambda i: {'k': CASE WHEN i = len(parts) AND NOT folder THEN 1 ELSE 0 END, 'name': lower(parts[i]), 'exact': parts[i]}) AS key FROM e WHERE len(parts) <= 3)"""
#: the files a scan takes, by recursion over a repository's files in path order
_BUDGET = """q AS (SELECT repository_id, file_path, size_bytes, row_number() OVER (PARTITION BY repository_id ORDER BY file_path) AS i FROM l WHERE size_bytes <= 1000000),
r AS (SELECT repository_id, file_path, size_bytes, i, size_bytes <= 100000 AS ok, CASE WHEN size_bytes <= 100000 THEN 1 ELSE 0 END AS taken, CASE WHEN size_bytes <= 100000 THEN size_bytes ELSE 0 END AS used FROM q WHERE i = 1
  UNION ALL SELECT x.repository_id, x.file_path, x.size_bytes, x.i, x.ok, x.taken + x.ok::INTEGER, x.used + CASE WHEN x.ok THEN x.size_bytes ELSE 0 END
  FROM (SELECT q.*, r.taken, r.used, r.taken < 60 AND r.used + q.size_bytes <= 100000 AS ok FROM r JOIN q ON q.repository_id = r.repository_id AND q.i = r.i + 1) x)"""


def _script_imports() -> str:
    q = "[\"''`]"
    patterns = {
        "es import": rf"\bimport\s+(?:[^\"''`]+?\s+from\s+)?{q}([^\"''`]+){q}", "commonjs require": rf"\brequire\(\s*{q}([^\"''`]+){q}\s*\)", "dynamic import": rf"\bimport\(\s*{q}([^\"''`]+){q}\s*\)",
    }
    found = " UNION ".join(f"SELECT repository_id, file_path, line, unnest(regexp_extract_all(text, '{p}', 1)) AS target, '{kind}' AS import_type FROM p" for kind, p in patterns.items())
    tries = [f"{{'o': {i}, 'c': stem || '{x}'}}" for i, x in enumerate((".js", ".jsx", ".ts", ".tsx"))] + [f"{{'o': {4 + i}, 'c': base || '/index{x}'}}" for i, x in enumerate((".js", ".jsx", ".ts", ".tsx"))]
    return f"""i AS ({found}),
w AS (SELECT DISTINCT repository_id, file_path, target, list_reduce(list_concat([array_to_string(string_split(file_path, '/')[:-2], '/')], list_filter(string_split(target, '/'), lambda x: x <> '' AND x <> '.')),
  lambda a, x: CASE WHEN x = '..' THEN regexp_replace(a, '(^|/)[^/]*$', '') WHEN a = '' THEN x ELSE a || '/' || x END) AS base FROM i WHERE target LIKE '.%'),
t AS (SELECT repository_id, file_path, target, unnest([{", ".join(tries)}]) AS t FROM (SELECT *, regexp_replace(base, '([^/])\\.[^./]*$', '\\1') AS stem FROM w)),
h AS (SELECT t.repository_id, t.file_path, target, arg_min(t.c, t.o) AS hit FROM t JOIN src ON src.repository_id = t.repository_id AND src.file_path = t.c GROUP BY 1, 2, 3)
SELECT DISTINCT i.repository_id, i.file_path AS source_file, i.target, coalesce(hit, i.target) AS resolved_target, import_type, line FROM i LEFT JOIN h ON h.repository_id = i.repository_id AND h.file_path = i.file_path AND h.target = i.target"""


def oracle_sql():
    f = O.FILES
    route = r"(?i)@(\w+)\.(get|post|put|delete|patch|options|head)\(\s*[\"']([^\"']+)[\"']".replace("'", "''")
    root = lambda names: f"SELECT DISTINCT repository_id, file_path FROM f WHERE {_in('file_path', names)}"
    stack = " UNION ALL ".join(
        f"SELECT repository_id, '{c}' AS category, {O.quote(label)} AS label FROM t WHERE regexp_matches(text, {O.quote('|'.join(A._needle(w) for w in ws))})" + (" OR regexp_matches(text, '\\.py\\b|python')" if label == "Python" else "")
        for c, rules in A.STACK.items()
        for label, ws in rules.items()
    )
    signals = f"list_position([{', '.join(O.quote(x) for x in A.SIGNAL_FILES)}], file_path)"
    return {
        "path_filter": f"SELECT DISTINCT file_path, {_IGNORED} AS ignored_folder, {_RULE} AS rule, ({_KEPT}) AS included FROM files WHERE file_path IS NOT NULL",
        "language_lookup": f"SELECT {_LANGUAGE} AS language, {_EXT} AS extension, count(*) AS files FROM files WHERE file_path IS NOT NULL GROUP BY 1, 2",
        "redact_chunks": f"WITH {O.CHUNKS} SELECT repository_id, file_path, chunk_index, {_redact('content')} AS redacted FROM c WHERE contains({_redact('content')}, '[REDACTED]')",
        "debug_preview": f"WITH {O.CHUNKS}, p AS (SELECT *, trim(regexp_replace(content, '\\s+', ' ', 'g')) AS flat FROM c) SELECT repository_id, file_path, chunk_index, substring({_redact('content')}, 1, 260) AS preview, CASE WHEN length(flat) > 260 THEN substring(flat, 1, 260) || '...' ELSE flat END AS line FROM p",
        "core_modules": f"""WITH {f}, {_LISTED}, g AS (SELECT repository_id, CASE WHEN NOT contains(file_path, '/') OR file_path LIKE '.%' THEN '.' ELSE string_split(file_path, '/')[1] END AS module, count(*) AS files,
  CAST(sum(size_bytes) AS BIGINT) AS bytes, array_to_string(list_sort(list_distinct(list(language))), ',') AS languages FROM l GROUP BY 1, 2)
SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY repository_id ORDER BY files DESC, bytes DESC, module) AS place FROM g) WHERE place <= 12""",
        "largest_files": f"WITH {f}, {_LISTED} SELECT repository_id, file_path, size_bytes, language, place FROM (SELECT *, row_number() OVER (PARTITION BY repository_id ORDER BY size_bytes DESC, file_path) AS place FROM l) WHERE place <= 10",
        "repository_counts": f"""WITH {f}, {_LISTED}, p AS (SELECT repository_id, string_split(file_path, '/')[:-2] AS ps FROM l),
d AS (SELECT repository_id, count(DISTINCT folder) AS folders FROM (SELECT repository_id, unnest(list_transform(generate_series(1, len(ps)), lambda i: array_to_string(ps[1:i], '/'))) AS folder FROM p WHERE len(ps) > 0) GROUP BY 1)
SELECT repository_id, count(*) AS files, CAST(sum(size_bytes) AS BIGINT) AS bytes, array_to_string(list_sort(list_distinct(list(language))), ',') AS languages, coalesce(max(folders), 0) AS folders FROM l LEFT JOIN d USING (repository_id) GROUP BY 1""",
        "directory_tree": f"WITH {f}, {_LISTED}, {_TREE} SELECT repository_id, place, repeat('    ', n - 1) || parts[n] || CASE WHEN folder THEN '/' ELSE '' END AS line FROM (SELECT *, row_number() OVER (PARTITION BY repository_id ORDER BY key) AS place FROM k) WHERE place <= 220",
        "within_budget": f"WITH RECURSIVE {f}, {_LISTED}, {_BUDGET} SELECT repository_id, file_path, size_bytes FROM r WHERE ok",
        "script_imports": f"""WITH {f}, {_SOURCE}, {_lines("p", "ext IN ('.js', '.jsx', '.ts', '.tsx')")}, {_script_imports()}""",
        "entry_points": f"WITH {f}, {_LISTED} SELECT DISTINCT repository_id, file_path FROM l WHERE {_in('string_split(file_path, chr(47))[-1]', S.ENTRY_NAMES)} OR {_in('file_path', S.ENTRY_PATHS)}",
        "tree_signature": f"WITH {f} SELECT repository_id, 4 AS version, count(*) AS files, CAST(coalesce(sum(size_bytes), 0) AS BIGINT) AS bytes, max(ord) AS latest FROM f GROUP BY 1",
        "file_hash_manifest": f"WITH {O.CHUNKS}, {_MANIFEST} SELECT * FROM m",
        "incremental_diff": f"WITH {O.CHUNKS}, {_MANIFEST}, {_DIFF} SELECT * FROM x",
        "index_result": f"""WITH {O.CHUNKS}, {_MANIFEST}, {_DIFF} SELECT repository_id, count(*) FILTER (change = 'added') AS added_files, count(*) FILTER (change = 'changed') AS changed_files, count(*) FILTER (change = 'removed') AS removed_files,
  count(*) FILTER (change = 'unchanged') AS unchanged_files, CAST(sum(inserted) AS BIGINT) AS inserted_chunks, CAST(sum(deleted) AS BIGINT) AS deleted_chunks, count(*) FILTER (change <> 'unchanged') = 0 AS cached FROM x GROUP BY 1""",
        "catalog_list": f"""WITH {O.CHUNKS}, b AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY repository_id ORDER BY updated_at DESC NULLS LAST, created_at DESC NULLS LAST, status DESC NULLS LAST, files_indexed DESC NULLS LAST, github_url DESC NULLS LAST,
  default_branch DESC NULLS LAST, source DESC NULLS LAST, source_name DESC NULLS LAST, source_type DESC NULLS LAST, display_name DESC NULLS LAST, upload_name DESC NULLS LAST) AS rn FROM repo_catalog WHERE repository_id IS NOT NULL) WHERE rn = 1),
i AS (SELECT repository_id, count(DISTINCT file_path) AS n FROM index_manifest WHERE repository_id IS NOT NULL AND file_path IS NOT NULL GROUP BY 1), k AS (SELECT repository_id, count(*) AS n FROM c GROUP BY 1),
s AS (SELECT b.*, i.n AS index_files, k.n AS n_chunks, coalesce(nullif(source, ''), CASE WHEN github_url IS NOT NULL THEN 'github' END) AS src FROM b LEFT JOIN i USING (repository_id) LEFT JOIN k USING (repository_id)),
t AS (SELECT *, coalesce(nullif(source_type, ''), CASE WHEN src = 'zip_upload' THEN 'zip_upload' WHEN github_url IS NOT NULL THEN 'github' ELSE src END) AS kind FROM s)
SELECT repository_id, CASE WHEN index_files IS NOT NULL THEN 'ready' ELSE 'incomplete' END AS status, coalesce(index_files, files_indexed, 0) AS files_indexed, coalesce(n_chunks, 0) AS chunks_indexed, created_at, updated_at, github_url, default_branch, src AS source,
  nullif(source_name, '') AS source_name, kind AS source_type, coalesce(nullif(display_name, ''), nullif(source_name, ''), nullif(regexp_extract(github_url, '([^/]+?)(?:\\.git)?/*$', 1), '')) AS display_name,
  coalesce(nullif(upload_name, ''), CASE WHEN kind = 'zip_upload' THEN nullif(source_name, '') END) AS upload_name, row_number() OVER (ORDER BY coalesce(updated_at, 0) DESC, repository_id DESC) AS newest FROM t""",
        "audit_summary": """WITH a AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY audit_id ORDER BY arrived_at NULLS FIRST, logged_at NULLS FIRST, event NULLS FIRST, outcome NULLS FIRST, actor_id NULLS FIRST, repository_fingerprint NULLS FIRST) AS rn FROM audit_log WHERE audit_id IS NOT NULL) WHERE rn = 1),
k AS (SELECT DISTINCT repository_id, sha256(repository_id) AS repository_fingerprint FROM repo_catalog WHERE repository_id IS NOT NULL)
SELECT event, repository_id, count(*) AS events, count(*) FILTER (coalesce(outcome, '') <> 'success') AS other_outcomes, count(DISTINCT actor_id) AS actors FROM a LEFT JOIN k USING (repository_fingerprint) GROUP BY 1, 2""",
        "sliding_request_count": "SELECT event_id, user_id, count(*) OVER (PARTITION BY user_id ORDER BY ts RANGE BETWEEN INTERVAL 3600 SECONDS PRECEDING AND CURRENT ROW) AS requests FROM events WHERE user_id IS NOT NULL AND ts IS NOT NULL",
        "json_props": "SELECT event_type, key, count(*) AS events FROM (SELECT event_type, unnest(json_keys(props)) AS key FROM events WHERE props IS NOT NULL) GROUP BY 1, 2",
        "validate_sources": r"""SELECT DISTINCT repository_id, github_url, coalesce(regexp_full_match(repository_id, '[A-Za-z0-9_.-]{1,140}'), false) AS valid_id,
  CASE WHEN regexp_matches(trim(github_url), '^https://(?i:github\.com)/+([A-Za-z0-9_.-]+)/+([A-Za-z0-9_.-]+?)(?:\.git)?/*$') THEN 'https://github.com/' || regexp_extract(trim(github_url), '^https://(?i:github\.com)/+([A-Za-z0-9_.-]+)/+([A-Za-z0-9_.-]+?)(?:\.git)?/*$', 1)
  || '/' || regexp_extract(trim(github_url), '^https://(?i:github\.com)/+([A-Za-z0-9_.-]+)/+([A-Za-z0-9_.-]+?)(?:\.git)?/*$', 2) || '.git' END AS canonical FROM repo_catalog""",
        "source_citations": f"WITH {O.CHUNKS}, g AS (SELECT repository_id, max(github_url) AS github_url FROM repo_catalog WHERE repository_id IS NOT NULL GROUP BY 1) SELECT repository_id, file_path, chunk_index, start_line, end_line, language, symbol_name, symbol_type, {_url()} AS url FROM c LEFT JOIN g USING (repository_id)",
        "api_endpoints": f"""WITH {f}, {_SOURCE}, {_lines("p", "ext = '.py' AND contains(content, '@')")},
h AS (SELECT *, first_value(d IGNORE NULLS) OVER (PARTITION BY repository_id, file_path ORDER BY line ROWS BETWEEN 1 FOLLOWING AND 8 FOLLOWING) AS handler FROM
  (SELECT *, nullif(regexp_extract(text, '^\\s*(?:async\\s+)?def\\s+(\\w+)\\s*\\(', 1), '') AS d FROM p))
SELECT DISTINCT repository_id, 'FastAPI' AS framework, upper(regexp_extract(text, '{route}', 2)) AS method, '/' || trim(regexp_extract(text, '{route}', 3), '/') AS path, coalesce(handler, '') AS handler, file_path, line FROM h WHERE regexp_matches(text, '{route}')""",
        "database_models": f"""WITH {f}, {_SOURCE}, {_lines("p", "ext = '.py'")}, k AS (SELECT *, regexp_extract(text, '^\\s*class\\s+(\\w+)\\(([^)]*)\\):', 1) AS model, regexp_extract(text, '^\\s*class\\s+(\\w+)\\(([^)]*)\\):', 2) AS bases FROM p)
SELECT DISTINCT repository_id, CASE WHEN contains(bases, 'models.Model') THEN 'Django ORM' ELSE 'SQLAlchemy' END AS technology, file_path, line, 'model ' || model AS detail, model AS model_name, '' AS fields, '' AS relationships FROM k
WHERE model <> '' AND (contains(bases, 'models.Model') OR regexp_matches(bases, '\\b(?:Base|DeclarativeBase|db\\.Model)\\b'))""",
        "entrypoint_findings": f"""WITH {f}, {_SOURCE} SELECT DISTINCT repository_id, file_path, 'startup' AS kind, 'recognized entry filename `' || name || '`' AS reason FROM src WHERE {_in("name", A.STARTUP_NAMES)}
UNION SELECT repository_id, file_path, 'application', 'creates a Python web application object' FROM src WHERE ext = '.py' AND regexp_matches(content, '\\b(?:FastAPI|Flask)\\s*\\(')
UNION SELECT repository_id, file_path, 'application', 'creates or starts a Node web application' FROM src WHERE ext IN ('.js', '.ts') AND regexp_matches(content, '\\b(?:express\\(\\)|createServer|app\\.listen)\\b')
UNION SELECT repository_id, file_path, 'configuration', 'recognized configuration file `' || name || '`' FROM src WHERE {_in("name", A.CONFIG_NAMES)}""",
        "technology_stack": f"""WITH {f}, r AS (SELECT repository_id, {signals} AS n, '# ' || file_path || chr(10) || content AS part FROM f WHERE {_in("file_path", A.SIGNAL_FILES)} AND coalesce(content, '') <> ''
  UNION ALL SELECT DISTINCT repository_id, 91, '.github/workflows' FROM f WHERE file_path LIKE '.github/workflows/%'), t AS (SELECT repository_id, lower(string_agg(part, chr(10) ORDER BY n)) AS text FROM r GROUP BY 1) {stack}""",
        "deployment_methods": f"WITH {f} SELECT DISTINCT repository_id, CASE {_case('file_path', A.DEPLOYMENT)} ELSE 'GitHub Actions' END AS method FROM f WHERE {_in('file_path', A.DEPLOYMENT)} OR file_path LIKE '.github/workflows/%'",
        "environment_variables": f"""WITH {f}, r AS (SELECT repository_id, content FROM f WHERE {_in("file_path", [".env.example", "README.md", "docker-compose.yml", "docker-compose.yaml"])}),
v AS (SELECT repository_id, unnest(regexp_extract_all(content, '(?m)^\\s*([A-Z][A-Z0-9_]{{2,}})\\s*=', 1)) AS variable FROM r UNION SELECT repository_id, variable FROM (SELECT repository_id, unnest(regexp_extract_all(content, '\\b[A-Z][A-Z0-9_]{{2,}}\\b')) AS variable FROM r) WHERE regexp_matches(variable, '{TX.SETTING_MARKS}'))
SELECT repository_id, variable FROM v""",
    }
