"""Markdown reports and front pages of every repository, as one row each.

Sections are built from the analyses' tables by ordered aggregation per repository; each
analysis is capped, which bounds a section.  A repository without findings gets the section's
empty sentence.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..operators import analyze as A
from ..operators import stats as S
from ..sources.store import written

# Categories in the order they are shown.
CATEGORIES = ["backend", "frontend", "database", "devops", "ai"]


def _section(rows: DataFrame, line: Column, order: list[str], name: str, limit: int | None = None) -> DataFrame:
    """(repository_id, name): the lines of a repository joined in order."""
    if limit is not None:
        w = Window.partitionBy("repository_id").orderBy(*order)
        rows = rows.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= limit)
    grouped = rows.groupBy("repository_id").agg(F.array_sort(F.collect_list(F.struct(*order, line.alias("_line")))).alias("ls"))
    return grouped.select("repository_id", F.array_join("ls._line", "\n").alias(name))


def sections(files: DataFrame) -> DataFrame:
    """One row a repository with the text of every section; null where an analysis found nothing."""
    counts = S.repository_counts(files)
    relations = written(A.python_relations(files))
    entry = S.entry_points(files).groupBy("repository_id").agg(F.array_sort(F.collect_set("file_path")).alias("entries"))
    stack = A.technology_stack(files)
    labels = stack.groupBy("repository_id", "category").agg(F.array_sort(F.collect_set("label")).alias("labels"))
    by = labels.groupBy("repository_id").agg(F.map_from_entries(F.collect_list(F.struct("category", "labels"))).alias("stack"))
    code = lambda c: F.concat(F.lit("`"), F.col(c), F.lit("`"))
    place = lambda f, n: F.concat(F.lit(" ("), F.col(f), F.lit(":"), F.col(n).cast("string"), F.lit(")"))
    dash = F.lit("- ")
    routes = _section(
        A.api_endpoints(files),
        F.concat(dash, "framework", F.lit(" "), code("method"), F.lit(" "), code("path"), F.lit(" handler=`"), F.when(F.col("handler") == "", "unknown").otherwise(F.col("handler")), F.lit("`"), place("file_path", "line")),
        ["file_path", "line", "method", "path"], "routes",
    )
    extras = F.array_compact(F.array(
        F.when(F.col("model_name") != "", F.concat(F.lit("model="), "model_name")), F.when(F.size("fields") > 0, F.concat(F.lit("fields="), F.array_join("fields", ", "))),
        F.when(F.size("relationships") > 0, F.concat(F.lit("relationships="), F.array_join("relationships", ", "))),
    ))
    suffix = F.when(F.size(extras) > 0, F.concat(F.lit(" ["), F.array_join(extras, "; "), F.lit("]"))).otherwise("")
    models = _section(A.database_models(files), F.concat(dash, "technology", F.lit(": "), "detail", suffix, place("file_path", "line")), ["file_path", "line", "detail"], "models")
    starts = _section(A.entrypoint_findings(files), F.concat(dash, "kind", F.lit(": "), code("file_path"), F.lit(" - "), "reason"), ["file_path", "kind"], "entrypoints")
    deps = _section(A.module_dependencies(files, relations=relations), F.concat(dash, code("source_file"), F.lit(" -> "), code("resolved_target"), F.lit(" via "), "import_type", place("source_file", "line")), ["source_file", "line", "target"], "dependencies", 80)
    calls = _section(
        A.call_graph(files, relations=relations), F.concat(dash, F.lit("`"), "caller_file", F.lit(":"), "caller_symbol", F.lit("` -> `"), "callee_file", F.lit(":"), "callee_symbol", F.lit("` via "), "call_type", place("caller_file", "line")),
        ["caller_file", "line", "caller_symbol", "callee_symbol"], "calls", 80,
    )
    settings = _section(A.environment_variables(files), F.concat(dash, code("variable")), ["variable"], "settings")
    deploy = _section(A.deployment_methods(files), F.concat(dash, "method"), ["method"], "deployment")
    hints = _section(A.startup_hints(files), F.concat(dash, "hint"), ["place", "hint"], "hints")
    modules = _section(S.core_modules(files), F.concat(dash, code("module"), F.lit(": "), F.col("files").cast("string"), F.lit(" files, languages="), F.replace("languages", F.lit(","), F.lit(", "))), ["place"], "modules")
    tree = _section(S.directory_tree(files), F.col("line"), ["place"], "tree")
    out = counts
    for part in (entry, by, routes, models, starts, deps, calls, settings, deploy, hints, modules, tree):
        out = out.join(part, "repository_id", "left")
    return out


def _overview() -> Column:
    shown = F.flatten(F.array(*[F.coalesce(F.col("stack")[c], F.array().cast("array<string>")) for c in CATEGORIES]))
    stack = F.when(F.size(shown) > 0, F.array_join(F.slice(shown, 1, 8), ", ")).otherwise("no dominant framework detected")
    entry = F.coalesce(F.array_join(F.slice("entries", 1, 5), ", "), F.lit("no obvious entry point detected"))
    return F.concat(
        F.lit("`"), "repository_id", F.lit("` contains "), F.col("files").cast("string"), F.lit(" readable files across "), F.col("folders").cast("string"), F.lit(" directories. Detected stack: "), stack, F.lit(". Likely entry points: "), entry, F.lit(".")
    )


def _stack() -> Column:
    return F.concat_ws("\n", *[F.concat(F.lit(f"- {c}: "), F.coalesce(F.array_join(F.col("stack")[c], ", "), F.lit("Not detected"))) for c in CATEGORIES])


_NO_START = "No explicit startup guide was found. Check README, package manager files, or container config."
_NO_ROUTES = "No FastAPI, Flask, or Express routes were detected by static analysis."


def _tree() -> Column:
    return F.concat(F.lit("```text\n"), "repository_id", F.lit("/\n"), F.coalesce("tree", F.lit("")), F.lit("\n```"))


def reports(files: DataFrame) -> DataFrame:
    """(repository_id, overview, markdown): the report in twelve sections."""
    s = sections(files)
    parts = [
        ("Project Overview", _overview()), ("Technology Stack", _stack()), ("Startup Guide", F.coalesce("hints", F.lit(_NO_START))), ("Directory Structure", _tree()), ("Core Modules", F.coalesce("modules", F.lit("No core modules detected."))),
        ("API Analysis", F.coalesce("routes", F.lit(_NO_ROUTES))), ("Database Analysis", F.coalesce("models", F.lit("No SQLAlchemy, Django ORM, Prisma, or Mongoose definitions were detected by static analysis."))),
        ("Entrypoint Analysis", F.coalesce("entrypoints", F.lit("No obvious startup, application, or configuration entry points were detected."))),
        ("Module Dependency Analysis", F.coalesce("dependencies", F.lit("No Python or JS/TS module dependencies were detected by static analysis."))),
        ("Python Function Call Analysis", F.coalesce("calls", F.lit("No statically resolvable Python function calls were detected."))),
        ("Environment Variables", F.coalesce("settings", F.lit("No explicit environment variables were detected from env files, README, or compose files."))), ("Deployment Method", F.coalesce("deployment", F.lit("No explicit deployment method was detected."))),
    ]
    return s.select("repository_id", _overview().alias("overview"), F.concat_ws("\n\n", *[F.concat(F.lit(f"# {t}\n\n"), c) for t, c in parts]).alias("markdown"))


def front_pages(files: DataFrame) -> DataFrame:
    """(repository_id, markdown): a front page in eight sections."""
    s = sections(files)
    features = F.concat_ws(
        "\n", F.concat(F.lit("- Readable files indexed: "), F.col("files").cast("string")), F.concat(F.lit("- Detected languages: "), F.when(F.col("languages") == "", "unknown").otherwise(F.replace("languages", F.lit(","), F.lit(", ")))),
        F.concat(F.lit("- Entry points: "), F.array_join(F.slice("entries", 1, 5), ", ")),
    )
    install = "Install dependencies according to the detected package files such as `requirements.txt`, `pyproject.toml`, or `package.json`."
    parts = [("Project Overview", _overview()), ("Features", features), ("Tech Stack", _stack()), ("Installation", F.lit(install)), ("Startup", F.coalesce("hints", F.lit(_NO_START))), ("API", F.coalesce("routes", F.lit(_NO_ROUTES))), ("Directory Structure", _tree())]
    return s.select("repository_id", F.concat_ws("\n\n", F.concat(F.lit("# "), "repository_id"), *[F.concat(F.lit(f"## {t}\n\n"), c) for t, c in parts]).alias("markdown"))


def route_of(task: str) -> str:
    """Which plan a task asks for: readme, report or search."""
    t = task.lower()
    return "readme" if "readme" in t else "report" if "report" in t or "analysis" in t else "search"


def evidence(ranked: DataFrame, corpus: DataFrame, limit: int = 5) -> DataFrame:
    """(repository_id, answer): the first chunks of a ranked list as numbered, redacted previews with their sources."""
    from ..functions.text import preview, redact
    from ..operators.corpus import KEY

    c = ranked.where(F.col("rank") <= limit).join(corpus, KEY)
    ref = F.concat("file_path", F.lit("#"), F.col("chunk_index").cast("string"), F.lit(" lines "), F.coalesce(F.col("start_line").cast("string"), F.lit("?")), F.lit("-"), F.coalesce(F.col("end_line").cast("string"), F.lit("?")), F.when(F.coalesce("symbol_name", F.lit("")) != "", F.concat(F.lit(" symbol="), "symbol_name")).otherwise(""))
    line = F.concat(F.col("rank").cast("string"), F.lit(". "), preview(redact(F.col("content"))), F.lit("\n   `"), ref, F.lit("`"))
    return _section(c, line, ["rank"], "answer")
