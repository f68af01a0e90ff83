"""SQL pieces for the oracle versions of the queries."""

from __future__ import annotations

from ..functions.text import intents, keywords

TOKEN = r"[a-zA-Z_][a-zA-Z0-9_]*|[\x{4e00}-\x{9fff}]|[0-9]+"

#: canonical chunks with their searched text
CHUNKS = """
c AS (SELECT repository_id, file_path, chunk_index, start_line, end_line, language, symbol_name, symbol_type, parent_symbol,
             coalesce(content, '') AS content, file_path || chr(10) || coalesce(content, '') AS full_text
      FROM (SELECT *, row_number() OVER (PARTITION BY repository_id, file_path, chunk_index ORDER BY content DESC NULLS LAST, start_line DESC NULLS LAST,
              end_line DESC NULLS LAST, language DESC NULLS LAST, symbol_name DESC NULLS LAST, symbol_type DESC NULLS LAST, parent_symbol DESC NULLS LAST) AS rn
            FROM chunks WHERE repository_id IS NOT NULL AND file_path IS NOT NULL AND chunk_index IS NOT NULL) WHERE rn = 1)"""

FILES = """
f AS (SELECT repository_id, file_path, max(content) AS content, max(size_bytes) AS size_bytes, max(ord) AS ord
      FROM files WHERE repository_id IS NOT NULL AND file_path IS NOT NULL GROUP BY 1, 2)"""


def quote(x: str) -> str:
    return "'" + x.replace("'", "''") + "'"


def values(words: list[str]) -> str:
    return "(VALUES " + ", ".join(f"({quote(w)})" for w in words) + ")"


def any_of(text: str, words: list[str]) -> str:
    return "(" + " OR ".join(f"instr({text}, {quote(w)}) > 0" for w in words) + ")"


def path_priority(path: str, question: str) -> str:
    overview = "overview" in intents(question)
    p = f"lower({path})"
    parts = [f"CASE WHEN {p} = 'readme.md' THEN {42 if overview else 18} WHEN instr({p}, 'readme') > 0 THEN {6 if overview else 9} ELSE 0 END"]
    if overview:
        parts.append(f"CASE WHEN length({p}) - length(replace({p}, '/', '')) >= 2 AND {p} LIKE '%readme.md' THEN -8 ELSE 0 END")
        parts.append(f"CASE WHEN {any_of(p, ['tool', 'lint', 'bench', 'script'])} THEN -4 ELSE 0 END")
    parts.append(f"CASE WHEN {any_of(p, ['overview', 'introduction', 'architecture', 'guide', 'docs/', 'spec'])} THEN 5 ELSE 0 END")
    parts.append(f"CASE WHEN {any_of(p, ['quickstart', 'install', 'contributing', 'development'])} THEN 5 ELSE 0 END")
    ends = " OR ".join(f"{p} LIKE '%{e}'" for e in ("pyproject.toml", "setup.py", "requirements.txt", "mkdocs.yml", "package.json"))
    parts.append(f"CASE WHEN {ends} THEN 3 ELSE 0 END")
    parts.append(f"CASE WHEN {any_of(p, ['test', 'snapshot', 'fixture', 'locale', '/de/', '/ru/', '/uk/', '/ko/'])} THEN -6 ELSE 0 END")
    return "CAST(" + " + ".join(f"({x})" for x in parts) + " AS DOUBLE)"


def ranked(name: str, source: str, limit: int) -> str:
    return f"""
{name} AS (SELECT repository_id, file_path, chunk_index, -score AS distance, rank FROM
  (SELECT *, row_number() OVER (PARTITION BY repository_id ORDER BY score DESC, file_path, chunk_index) AS rank FROM {source} WHERE score > 0) WHERE rank <= {limit})"""


def keyword_list(name: str, question: str, limit: int) -> str:
    ks = values(keywords(question))
    weight = path_priority("file_path", question)
    return f"""
{name}_len AS (SELECT *, len(regexp_extract_all(content, '{TOKEN}')) AS n, len(regexp_extract_all(lower(full_text), '{TOKEN}')) AS m FROM c),
{name}_avg AS (SELECT repository_id, avg(n) AS average FROM {name}_len GROUP BY 1),
{name}_kw AS (SELECT repository_id, file_path, chunk_index, sum(CASE WHEN n > 0 THEN 1 + least(n, 10) * 1.4::DOUBLE + CASE WHEN instr(lower(file_path), w) > 0 THEN 2.5 ELSE 0 END ELSE 0 END) AS s
  FROM (SELECT repository_id, file_path, chunk_index, w, (length(lower(full_text)) - length(replace(lower(full_text), w, ''))) / length(w) AS n FROM c, {ks} k(w)) GROUP BY 1, 2, 3),
{name}_tf AS (SELECT repository_id, file_path, chunk_index, t, count(*) AS tf FROM (SELECT repository_id, file_path, chunk_index, unnest(regexp_extract_all(lower(full_text), '{TOKEN}')) AS t FROM c)
  WHERE t IN (SELECT w FROM {ks} k(w)) GROUP BY 1, 2, 3, 4),
{name}_bm AS (SELECT l.repository_id, l.file_path, l.chunk_index, sum(tf * 2.5::DOUBLE / (tf + 1.5::DOUBLE * (0.25 + 0.75::DOUBLE * m / greatest(average, 1.0::DOUBLE)))) AS s
  FROM {name}_tf JOIN {name}_len l USING (repository_id, file_path, chunk_index) JOIN {name}_avg USING (repository_id) GROUP BY 1, 2, 3),
{name}_all AS (SELECT repository_id, file_path, chunk_index, round(k.s + {weight} + 2 * CASE WHEN m > 0 THEN coalesce(b.s, 0) + {weight} ELSE 0 END, 9) AS score
  FROM {name}_len JOIN {name}_kw k USING (repository_id, file_path, chunk_index) LEFT JOIN {name}_bm b USING (repository_id, file_path, chunk_index)),
{ranked(name, name + "_all", limit).strip()}"""


def okapi_list(name: str, question: str, limit: int) -> str:
    ks = values(keywords(question))
    return f"""
{name}_tok AS (SELECT repository_id, file_path, chunk_index, unnest(regexp_extract_all(lower(full_text), '{TOKEN}')) AS t FROM c),
{name}_dl AS (SELECT repository_id, file_path, chunk_index, len(regexp_extract_all(lower(full_text), '{TOKEN}')) AS dl FROM c),
{name}_n AS (SELECT repository_id, count(*) AS docs, avg(dl) AS average FROM {name}_dl GROUP BY 1),
{name}_tf AS (SELECT repository_id, file_path, chunk_index, t, count(*) AS tf FROM {name}_tok GROUP BY 1, 2, 3, 4),
{name}_df AS (SELECT repository_id, t, ln(docs - count(*) + 0.5::DOUBLE) - ln(count(*) + 0.5::DOUBLE) AS idf FROM {name}_tf JOIN {name}_n USING (repository_id) GROUP BY repository_id, t, docs),
{name}_floor AS (SELECT repository_id, 0.25 * avg(idf) AS floor FROM {name}_df GROUP BY 1),
{name}_idf AS (SELECT repository_id, t, CASE WHEN idf < 0 THEN floor ELSE idf END AS idf FROM {name}_df JOIN {name}_floor USING (repository_id) WHERE t IN (SELECT w FROM {ks} k(w))),
{name}_s AS (SELECT tf.repository_id, tf.file_path, tf.chunk_index, sum(idf * tf * 2.5::DOUBLE / (tf + 1.5::DOUBLE * (0.25 + 0.75::DOUBLE * dl / average))) AS s
  FROM {name}_tf tf JOIN {name}_idf USING (repository_id, t) JOIN {name}_dl USING (repository_id, file_path, chunk_index) JOIN {name}_n USING (repository_id) GROUP BY 1, 2, 3),
{name}_all AS (SELECT repository_id, file_path, chunk_index, round(coalesce(s, 0) + {path_priority("file_path", question)}, 9) AS score FROM c LEFT JOIN {name}_s USING (repository_id, file_path, chunk_index)),
{ranked(name, name + "_all", limit).strip()}"""


def anchor_list(name: str, question: str, limit: int) -> str:
    own = intents(question)
    p = "lower(file_path)"
    keep = [f"({p} = 'readme.md' AND chunk_index <= 6)", f"({p} IN ('package.json', 'pyproject.toml', 'setup.py', 'go.mod') AND chunk_index <= 2)"]
    if "startup" in own:
        keep.append(f"({p} IN ('docs/install.md', 'install.md') AND chunk_index <= 4)")
    if "overview" in own:
        keep.append(f"(chunk_index <= 3 AND {any_of(p, ['overview', 'introduction', 'architecture'])})")
    return f"""
{name} AS (SELECT repository_id, file_path, chunk_index, -10000.0::DOUBLE + chunk_index AS distance, rank FROM
  (SELECT *, row_number() OVER (PARTITION BY repository_id ORDER BY {p} <> 'readme.md', file_path, chunk_index) AS rank FROM c WHERE {" OR ".join(keep) if own else "false"}) WHERE rank <= {limit})"""


def fused_list(name: str, lists: list[str], limit: int) -> str:
    parts = " UNION ALL ".join(f"SELECT repository_id, file_path, chunk_index, rank, {i} AS list FROM {x}" for i, x in enumerate(lists))
    return f"""
{name}_p AS (SELECT repository_id, file_path, chunk_index, sum(CAST(round(1e12::DOUBLE / (60 + rank)) AS BIGINT)) AS points, min(list * 100000 + rank) AS first FROM ({parts}) GROUP BY 1, 2, 3),
{name} AS (SELECT repository_id, file_path, chunk_index, -(points / 1e12::DOUBLE) AS distance, rank FROM
  (SELECT *, row_number() OVER (PARTITION BY repository_id ORDER BY points DESC, first) AS rank FROM {name}_p) WHERE rank <= {limit})"""


def appended_list(name: str, first: str, second: str, limit: int) -> str:
    return f"""
{name}_b AS (SELECT repository_id, file_path, chunk_index, min(o) AS o, arg_min(distance, o) AS distance FROM
  (SELECT *, rank AS o FROM {first} UNION ALL SELECT *, 100000 + rank AS o FROM {second}) GROUP BY 1, 2, 3),
{name} AS (SELECT * FROM (SELECT repository_id, file_path, chunk_index, distance, row_number() OVER (PARTITION BY repository_id ORDER BY o) AS rank FROM {name}_b) WHERE rank <= {limit})"""


def neighbour_list(name: str, source: str, window: int, limit: int) -> str:
    return f"""
{name}_n AS (SELECT s.repository_id, s.file_path, c.chunk_index, s.distance, s.rank AS src FROM {source} s JOIN c ON c.repository_id = s.repository_id AND c.file_path = s.file_path AND c.chunk_index BETWEEN s.chunk_index - {window} AND s.chunk_index + {window}),
{name}_d AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY repository_id, file_path, chunk_index ORDER BY src) AS rn FROM {name}_n) WHERE rn = 1),
{name} AS (SELECT repository_id, file_path, chunk_index, distance, rank FROM (SELECT *, row_number() OVER (PARTITION BY repository_id ORDER BY src, chunk_index) AS rank FROM {name}_d) WHERE rank <= {limit})"""


def reranked(name: str, source: str, question: str, limit: int) -> str:
    ks, q = keywords(question), question.lower().strip()
    sym = "coalesce(symbol_name, '')"
    return f"""
{name}_c AS (SELECT c.*, s.distance, s.rank AS retrieval_rank FROM {source} s JOIN c USING (repository_id, file_path, chunk_index)),
{name}_t AS (SELECT repository_id, file_path, chunk_index, t, count(*) AS n FROM (SELECT repository_id, file_path, chunk_index,
    unnest(list_concat(list_concat(regexp_extract_all(lower(content), '{TOKEN}'), regexp_extract_all(lower(file_path), '{TOKEN}')), regexp_extract_all(lower({sym}), '{TOKEN}'))) AS t FROM {name}_c) GROUP BY 1, 2, 3, 4),
{name}_k AS (SELECT x.repository_id, x.file_path, x.chunk_index,
    sum(CASE WHEN n IS NULL THEN 0 ELSE 3 + least(n, 8) * 1.3::DOUBLE END + CASE WHEN instr(lower(x.file_path), w) > 0 THEN 5 ELSE 0 END + CASE WHEN {sym} <> '' AND instr(lower({sym}), w) > 0 THEN 6 ELSE 0 END) AS s, count(n) AS hits
  FROM {name}_c x CROSS JOIN {values(ks)} k(w) LEFT JOIN {name}_t t ON t.repository_id = x.repository_id AND t.file_path = x.file_path AND t.chunk_index = x.chunk_index AND t.t = w GROUP BY 1, 2, 3),
{name}_s AS (SELECT repository_id, file_path, chunk_index, distance, retrieval_rank, round(greatest(0, -distance) * 28.0::DOUBLE + {path_priority("file_path", question)} * 1.7::DOUBLE
    + CASE WHEN instr(lower(file_path || chr(10) || {sym} || chr(10) || content), {quote(q)}) > 0 THEN 18 ELSE 0 END + s + hits / {len(ks)} * 24.0::DOUBLE
    + CASE WHEN {sym} <> '' THEN 4 ELSE 0 END + CASE WHEN symbol_type IN ('class', 'function', 'section') THEN 2 ELSE 0 END + CASE WHEN start_line <> 0 AND end_line <> 0 THEN 1 ELSE 0 END
    - CASE WHEN length(content) > 7000 THEN 6 WHEN length(content) < 120 THEN 3 ELSE 0 END, 6) AS rerank_score
  FROM {name}_c JOIN {name}_k USING (repository_id, file_path, chunk_index)),
{name} AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY repository_id ORDER BY rerank_score DESC, retrieval_rank) AS rank FROM {name}_s) WHERE rank <= {limit})"""
