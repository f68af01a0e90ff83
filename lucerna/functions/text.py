"""Text expressions: tokens, counts, path weights, redaction, source links and names.

All are column expressions that stay inside the JVM; null in gives null out unless said otherwise.
"""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

# The token pattern (one token a Chinese character) and that of the hashed embedding (runs of them).
TOKEN = r"[a-zA-Z_][a-zA-Z0-9_]*|[\x{4e00}-\x{9fff}]|[0-9]+"
TOKEN_PYTHON = r"[a-zA-Z_][a-zA-Z0-9_]*|[一-鿿]|[0-9]+"
EMBED_TOKEN = r"[a-zA-Z_][a-zA-Z0-9_]*|[\x{4e00}-\x{9fff}]+|\d+"
EMBED_TOKEN_PYTHON = r"[a-zA-Z_][a-zA-Z0-9_]*|[一-鿿]+|\d+"

# Words in a question that show an intent, and the vocabulary that the intent adds.
STARTUP_WORDS = ["启动", "运行", "部署", "安装", "start", "run", "install", "deploy"]
OVERVIEW_WORDS = ["功能", "能力", "作用", "用途", "做什么", "是什么", "介绍", "概览", "模块", "架构", "feature", "features", "capability", "purpose", "overview", "architecture", "module", "component"]
OVERVIEW_VOCABULARY_WORDS = ["功能", "能力", "作用", "用途", "做什么", "是什么", "介绍", "概览", "模块", "架构", "feature", "features", "capability", "purpose", "overview", "architecture", "module", "capabilities"]
STARTUP_VOCABULARY = ["readme", "install", "installation", "run", "running", "start", "serve", "server", "dev", "development", "setup", "quickstart", "uvicorn", "fastapi", "pip", "python"]
OVERVIEW_VOCABULARY = ["readme", "overview", "introduction", "feature", "features", "capability", "capabilities", "purpose", "usage", "module", "modules", "architecture", "component", "components", "docs", "spec", "guide", "tool", "tools", "server", "sdk", "client"]


def tokens(text: Column) -> Column:
    """Array of the lower-case tokens of a text."""
    return F.regexp_extract_all(F.lower(text), F.lit(TOKEN), F.lit(0))


def intents(question: str) -> set[str]:
    """'startup' and 'overview', as far as a question's words show them (words count inside others, too)."""
    q = question.lower()
    return {name for name, words in (("startup", STARTUP_WORDS), ("overview", OVERVIEW_WORDS)) if any(w in q for w in words)}


def keywords(question: str) -> list[str]:
    """Sorted keywords of a question with its intents' vocabulary; words of one character are left out."""
    q = question.lower()
    out = set(re.findall(TOKEN_PYTHON, q))
    if any(w in q for w in STARTUP_WORDS):
        out.update(STARTUP_VOCABULARY)
    if any(w in q for w in OVERVIEW_VOCABULARY_WORDS):
        out.update(OVERVIEW_VOCABULARY)
    return sorted(w for w in out if len(w) > 1)


def _any(text: Column, words: list[str]) -> Column:
    return F.greatest(*[F.instr(text, w) for w in words]) > 0 if len(words) > 1 else F.instr(text, words[0]) > 0


def path_priority(path: Column, question_intents: set[str]) -> Column:
    """Weight of a path for a question: front pages, guides and manifests up, tests and translations down."""
    overview = "overview" in question_intents
    p = F.lower(path)
    score = F.when(p == "readme.md", 42.0 if overview else 18.0).when(F.instr(p, "readme") > 0, 6.0 if overview else 9.0).otherwise(0.0)
    if overview:
        deep = F.length(p) - F.length(F.regexp_replace(p, "/", "")) >= 2
        score = score - F.when(deep & p.endswith("readme.md"), 8.0).otherwise(0.0)
    score = score + F.when(_any(p, ["overview", "introduction", "architecture", "guide", "docs/", "spec"]), 5.0).otherwise(0.0)
    score = score + F.when(_any(p, ["quickstart", "install", "contributing", "development"]), 5.0).otherwise(0.0)
    ends = p.endswith("pyproject.toml") | p.endswith("setup.py") | p.endswith("requirements.txt") | p.endswith("mkdocs.yml") | p.endswith("package.json")
    score = score + F.when(ends, 3.0).otherwise(0.0)
    score = score - F.when(_any(p, ["test", "snapshot", "fixture", "locale", "/de/", "/ru/", "/uk/", "/ko/"]), 6.0).otherwise(0.0)
    if overview:
        score = score - F.when(_any(p, ["tool", "lint", "bench", "script"]), 4.0).otherwise(0.0)
    return score


def occurrences(text: Column, word: Column) -> Column:
    """How often a word occurs in a text, not overlapping itself; counted in bytes, whose number a string knows."""
    return (F.octet_length(text) - F.octet_length(F.replace(text, word, F.lit("")))) / F.octet_length(word)


# What is redacted before a text is shown.
ASSIGNMENT = (
    r"(?i)\b([A-Za-z0-9_.-]*(?:api[_-]?key|access[_-]?token|auth[_-]?token|bearer[_-]?token|token|password|passwd|pwd|secret|private[_-]?key|connection[_-]?string)[A-Za-z0-9_.-]*)\b"
    r"(\s*[:=]\s*)"
)
BEARER = r"(?i)\bBearer\s+[A-Za-z0-9._~+/=-]{12,}"
DATABASE_URL = r"(?i)\b(postgres|postgresql|mysql|mongodb)://[^\s\"']+"


def redact(text: Column) -> Column:
    """Values of secret-like assignments, bearer tokens and database addresses replaced by a marker."""
    out = F.regexp_replace(text, ASSIGNMENT + r"([\"']?)[^\"'\s,;]+(\3)", "$1$2$3[REDACTED]$4")
    out = F.regexp_replace(out, BEARER, "Bearer [REDACTED]")
    return F.regexp_replace(out, DATABASE_URL, "$1://[REDACTED]")


def preview(text: Column, length: int = 260) -> Column:
    """The text in one line, cut after length characters with '...'."""
    flat = F.trim(F.regexp_replace(text, r"\s+", " "))
    return F.when(F.length(flat) > length, F.concat(F.substring(flat, 1, length), F.lit("..."))).otherwise(flat)


def strip(text: Column) -> Column:
    """The text without white space of any kind at its ends."""
    return F.regexp_replace(text, r"^\s+|\s+$", "")


# Ends of lines, as text readers see them.
LINE_END = r"\r\n|[\n\r\x0b\x0c\x1c-\x1e\x85\x{2028}\x{2029}]"


def lines(text: Column) -> Column:
    """The lines of a text; a line end at the end of the text begins no further line, an empty text has no line."""
    cut = F.regexp_replace(text, f"(?:{LINE_END})\\z", "")
    return F.when(text == "", F.array().cast("array<string>")).otherwise(F.split(cut, LINE_END))


def line_range(all_lines: Column, start: Column, end: Column) -> Column:
    """Lines start to end (from 1, inclusive) joined and stripped."""
    return strip(F.array_join(F.slice(all_lines, start, F.greatest(end - start + 1, F.lit(0))), "\n"))


def join_route(*parts: Column) -> Column:
    """Route parts joined by single slashes; '/' if nothing is left."""
    kept = F.filter(F.array(*[F.coalesce(p, F.lit("")) for p in parts]), lambda x: (x != "") & (x != "/"))
    return F.concat(F.lit("/"), F.array_join(F.transform(kept, lambda x: F.regexp_replace(x, "^/+|/+$", "")), "/"))


def source_url(repository_url: Column, path: Column, start: Column, end: Column) -> Column:
    """Link to a file's lines; null unless the address is https://github.com/owner/name and the path has no '.' or '..' part."""
    owner = F.regexp_extract(repository_url, r"^https://github\.com/+([^/?#]+)/+([^/?#]+?)(?:\.git)?/*$", 1)
    name = F.regexp_extract(repository_url, r"^https://github\.com/+([^/?#]+)/+([^/?#]+?)(?:\.git)?/*$", 2)
    parts = F.filter(F.split(F.replace(path, F.lit("\\"), F.lit("/")), "/"), lambda x: x != "")
    bad = F.exists(parts, lambda x: x.isin(".", "..")) | (F.size(parts) == 0)
    # url_encode writes a space as '+' and leaves '*'; path segments need %20 and %2A, and keep '~'
    quoted = F.transform(parts, lambda x: F.replace(F.replace(F.replace(F.url_encode(x), F.lit("+"), F.lit("%20")), F.lit("*"), F.lit("%2A")), F.lit("%7E"), F.lit("~")))
    anchor = F.when(start > 0, F.concat(F.lit("#L"), start.cast("string"), F.when(end >= start, F.concat(F.lit("-L"), end.cast("string"))).otherwise(""))).otherwise("")
    url = F.concat(F.lit("https://github.com/"), owner, F.lit("/"), name, F.lit("/blob/HEAD/"), F.array_join(quoted, "/"), F.coalesce(anchor, F.lit("")))
    return F.when((owner != "") & (name != "") & ~bad, url)


def canonical_repository_url(url: Column) -> Column:
    """https://github.com/owner/name.git of a valid repository address; null for any other scheme, host, port, user, query or path."""
    shape = r"^https://(?i:github\.com)/+([A-Za-z0-9_.-]+)/+([A-Za-z0-9_.-]+?)(?:\.git)?/*$"
    owner, name = F.regexp_extract(F.trim(url), shape, 1), F.regexp_extract(F.trim(url), shape, 2)
    return F.when((name != "") & ~owner.isin(".", "..") & ~name.isin(".", ".."), F.concat(F.lit("https://github.com/"), owner, F.lit("/"), name, F.lit(".git")))


def valid_repository_id(repository_id: Column) -> Column:
    """Whether an id has 1 to 140 letters, digits, '_', '.' or '-'."""
    return F.coalesce(repository_id.rlike(r"^[A-Za-z0-9_.-]{1,140}$"), F.lit(False))


# Parts of upper-case names that make them settings.
SETTING_MARKS = "KEY|TOKEN|SECRET|URL|HOST|PORT|DATABASE|MODEL"


def environment_names(text: Column) -> Column:
    """Array of the settings a text assigns at the start of a line, or names in capitals with a telling part."""
    assigned = F.regexp_extract_all(text, F.lit(r"(?m)^\s*([A-Z][A-Z0-9_]{2,})\s*="), F.lit(1))
    named = F.filter(F.regexp_extract_all(text, F.lit(r"\b[A-Z][A-Z0-9_]{2,}\b"), F.lit(0)), lambda x: x.rlike(SETTING_MARKS))
    return F.array_union(assigned, named)


def json_array(text: Column) -> Column:
    """The first JSON array of objects or values in a text that may be fenced, as array<string>; null if there is none."""
    bare = F.regexp_replace(F.regexp_replace(strip(text), r"^```(?:json)?\s*", ""), r"\s*```$", "")
    return F.coalesce(F.from_json(bare, "array<string>"), F.from_json(F.nullif(F.regexp_extract(bare, r"(\[[\s\S]*\])", 1), F.lit("")), "array<string>"))


def repository_id(url: Column) -> Column:
    """Readable id of a repository address: its last two path parts and ten digits of the SHA-1 of the address without trailing slashes."""
    plain = F.regexp_replace(url, "/+$", "")
    path = F.filter(F.split(F.regexp_replace(F.regexp_replace(plain, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*", ""), r"[?#].*$", ""), "/"), lambda x: x != "")
    last = F.when(F.size(path) >= 2, F.array_join(F.slice(path, F.size(path) - 1, F.lit(2)), "-")).otherwise("repository")
    readable = F.regexp_replace(F.regexp_replace(last, r"[^a-zA-Z0-9_-]+", "-"), r"^-+|-+$", "")
    return F.concat(readable, F.lit("-"), F.substring(F.sha1(plain.cast("binary")), 1, 10))


def embedding_signature(provider: str, model: str) -> Column:
    """Name of an embedding: the provider and eight digits of the SHA-1 of provider and model."""
    return F.concat(F.lit(provider.lower().strip().replace("-", "_") + "_"), F.substring(F.sha1(F.lit(f"{provider.lower().strip()}:{model}").cast("binary")), 1, 8))
