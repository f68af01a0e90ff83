"""Registered queries over texts, ids and digests, and the shown parts of capped analyses, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as TX
from ..operators import analyze as A
from ..operators import maintain as M
from ..operators.corpus import KEY, searchable, unique_files
from ..operators.stats import listed
from ..sources import store, trees
from ..sources.tables import read
from . import oracle as O
from . import repository as R


def repository_ids(s, d):
    """Id of every address of the catalog."""
    u = read(s, d, "repo_catalog").where("github_url is not null").select("github_url").distinct()
    return u.select("github_url", TX.repository_id(F.col("github_url")).alias("id"))


def file_digests(s, d):
    """SHA-256 of every file's text."""
    return unique_files(read(s, d, "files")).where("content is not null").select("repository_id", "file_path", F.sha2("content", 256).alias("sha256"))


def line_ranges(s, d):
    """Lines two to five of every file."""
    f = unique_files(read(s, d, "files")).where("content is not null")
    return f.select("repository_id", "file_path", TX.line_range(TX.lines(F.col("content")), F.lit(2), F.lit(5)).alias("text"))


def embedding_tokens(s, d):
    """Tokens of every chunk as the hashed embedding sees them: runs of ideographs are one."""
    c = searchable(read(s, d, "chunks"))
    return c.select(*KEY, F.size(F.regexp_extract_all(F.lower("content"), F.lit(TX.EMBED_TOKEN), F.lit(0))).alias("tokens"))


def decoded_files(s, d):
    """Files whose bytes are a text, by its length: binary and blank ones have none."""
    f = unique_files(read(s, d, "files")).where("content is not null")
    t = f.select("repository_id", "file_path", trees.text_of(F.encode("content", "UTF-8"), F.col("file_path")).alias("text"))
    return t.where("text is not null").select("repository_id", "file_path", F.length("text").alias("chars"))


def archive_names(s, d):
    """Names of uploads as they arrive in an address, decoded, or null if they aren't plain archive names."""
    u = read(s, d, "repo_catalog").where("upload_name is not null").select("upload_name").distinct()
    return u.select("upload_name", trees.archive_name(F.replace(F.url_encode("upload_name"), F.lit("+"), F.lit("%20"))).alias("name"))


def walk_order(s, d):
    """Files in the order of the walk over all repositories."""
    return store.numbered(listed(read(s, d, "files")), ["repository_id", "file_path"], "place")


def unindexed_files(s, d):
    """Files that the analyses see and of which the index knows nothing."""
    return store.unparsed(listed(read(s, d, "files")), read(s, d, "index_manifest").where("repository_id is not null and file_path is not null")).select("repository_id", "file_path")


def report_cache(s, d):
    """Whether a report made when only the indexed files were there is still good."""
    f = read(s, d, "files")
    known = read(s, d, "index_manifest").select("repository_id", "file_path").distinct()
    return M.cached_reports(M.tree_signature(f), M.tree_signature(f.join(known, ["repository_id", "file_path"], "left_semi")))


def _shown(fn, **kw):
    def run(s, d):
        out = fn(read(s, d, "files"), **kw)
        return out.withColumn("line", F.col("line").cast("bigint")) if "line" in out.columns else out

    return run


def queries():
    return {
        "repository_ids": repository_ids,
        "file_digests": file_digests,
        "line_ranges": line_ranges,
        "embedding_tokens": embedding_tokens,
        "decoded_files": decoded_files,
        "archive_names": archive_names,
        "walk_order": walk_order,
        "unindexed_files": unindexed_files,
        "report_cache": report_cache,
        "api_endpoints_shown": _shown(A.api_endpoints, limit=5),
        "entrypoint_findings_shown": _shown(A.entrypoint_findings, limit=5),
        "environment_variables_shown": _shown(A.environment_variables),
    }


def oracle_sql():
    f, rest = O.FILES, R.oracle_sql()
    ends = R._ENDS
    ls = f"CASE WHEN content = '' THEN [] ELSE string_split_regex(regexp_replace(content, '(?:{ends})$', ''), '{ends}') END"
    plain = "regexp_replace(github_url, '/+$', '')"
    path = f"list_filter(string_split(regexp_replace(regexp_replace({plain}, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*', ''), '[?#].*$', ''), '/'), lambda x: x <> '')"
    readable = f"regexp_replace(regexp_replace(CASE WHEN len({path}) >= 2 THEN array_to_string({path}[-2:], '-') ELSE 'repository' END, '[^a-zA-Z0-9_-]+', '-', 'g'), '^-+|-+$', '', 'g')"
    n = "trim(upload_name)"
    bad = f"length({n}) > 180 OR regexp_matches({n}, '[/\\\\:\\x00-\\x1f\\x7f]|\\p{{Cf}}|\\x{{fffd}}') OR lower({n}) NOT LIKE '%.zip' OR regexp_replace(substring({n}, 1, greatest(length({n}) - 4, 0)), '[ .]', '') = ''"
    shown = lambda name, order, limit: f"SELECT * EXCLUDE (shown_place) FROM (SELECT *, row_number() OVER (PARTITION BY repository_id ORDER BY {order}) AS shown_place FROM ({rest[name]})) WHERE shown_place <= {limit}"
    return {
        "repository_ids": f"SELECT DISTINCT github_url, {readable} || '-' || substring(sha1({plain}), 1, 10) AS id FROM repo_catalog WHERE github_url IS NOT NULL",
        "file_digests": f"WITH {f} SELECT repository_id, file_path, sha256(content) AS sha256 FROM f WHERE content IS NOT NULL",
        "line_ranges": f"WITH {f} SELECT repository_id, file_path, regexp_replace(array_to_string(({ls})[2:5], chr(10)), '^\\s+|\\s+$', '', 'g') AS text FROM f WHERE content IS NOT NULL",
        "embedding_tokens": f"WITH {O.CHUNKS} SELECT repository_id, file_path, chunk_index, CAST(len(regexp_extract_all(lower(content), '[a-zA-Z_][a-zA-Z0-9_]*|[\\x{{4e00}}-\\x{{9fff}}]+|\\d+')) AS INTEGER) AS tokens FROM c",
        "decoded_files": f"""WITH {f} SELECT repository_id, file_path, CAST(length(content) AS INTEGER) AS chars FROM f WHERE content IS NOT NULL AND NOT regexp_full_match(content, '[\\s\\x0b\\x1c-\\x1f\\x{{85}}\\x{{a0}}]*') AND NOT contains(content, chr(0))
  AND length(regexp_replace(substring(content, 1, 4096), '[^\\x01-\\x08\\x0e-\\x1f]', '', 'g')) <= 0.18 * length(substring(content, 1, 4096))""",
        "archive_names": f"SELECT DISTINCT upload_name, CASE WHEN {n} <> '' AND NOT ({bad}) THEN {n} END AS name FROM repo_catalog WHERE upload_name IS NOT NULL",
        "walk_order": f"WITH {f}, {R._LISTED} SELECT repository_id, file_path, size_bytes, row_number() OVER (ORDER BY repository_id, file_path) AS place FROM l",
        "unindexed_files": f"WITH {f}, {R._LISTED} SELECT repository_id, file_path FROM l WHERE NOT EXISTS (SELECT 1 FROM index_manifest m WHERE m.repository_id = l.repository_id AND m.file_path = l.file_path)",
        "report_cache": f"""WITH {f}, a AS (SELECT repository_id, count(*) AS n, coalesce(sum(size_bytes), 0) AS b, max(ord) AS o FROM f GROUP BY 1),
k AS (SELECT repository_id, count(*) AS n, coalesce(sum(size_bytes), 0) AS b, max(ord) AS o FROM f WHERE EXISTS (SELECT 1 FROM index_manifest m WHERE m.repository_id = f.repository_id AND m.file_path = f.file_path) GROUP BY 1)
SELECT a.repository_id, coalesce(a.n = k.n AND a.b = k.b AND a.o = k.o, false) AS use_cache FROM a LEFT JOIN k ON a.repository_id = k.repository_id""",
        "api_endpoints_shown": shown("api_endpoints", "file_path, line, framework, method, path, handler", 5),
        "entrypoint_findings_shown": shown("entrypoint_findings", "file_path, kind", 5),
        "environment_variables_shown": shown("environment_variables", "variable", 80),
    }
