"""Static analysis as tables: routes, data models, entry points, imports, calls, technology, settings.

Line-based analyses explode only files whose text can hold a finding, and look around with
windows over one file's lines.  Python syntax trees are read by a small per-file helper that
emits plain relations; every resolution (module to file, name to definition) is a join.
Findings are distinct; caps per repository follow path and line order and can be lifted.
"""

from __future__ import annotations

import ast
import warnings
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.filters import included
from ..functions.languages import extension
from ..functions.text import environment_names, join_route, lines
from ..sources.store import written
from .corpus import unique_files

REPO, FILE = ["repository_id"], ["repository_id", "file_path"]
# HTTP methods of route declarations.
METHODS = "get|post|put|delete|patch|options|head"


def source(files: DataFrame) -> DataFrame:
    """Files that are analysed, with their text; null text is read as ''."""
    return unique_files(files).where(included(F.col("file_path"))).select("repository_id", "file_path", F.coalesce("content", F.lit("")).alias("content"))


def file_lines(src: DataFrame, *more: str) -> DataFrame:
    """(repository_id, file_path, line, text) and the named columns; lines count from 1."""
    return src.select(*FILE, *more, F.posexplode(lines(F.col("content"))).alias("line", "text")).withColumn("line", F.col("line") + 1)


def _pairs(text: Column, pattern: str) -> Column:
    """All (name, value) of a pattern with two groups."""
    return F.arrays_zip(F.regexp_extract_all(text, F.lit(pattern), F.lit(1)).alias("name"), F.regexp_extract_all(text, F.lit(pattern), F.lit(2)).alias("value"))


def _last(pairs: str, name: Column) -> Column:
    """Value of the last pair with a name, '' without one."""
    found = F.filter(F.col(pairs), lambda x: x["name"] == name)
    return F.coalesce(F.try_element_at(found, F.lit(-1))["value"], F.lit(""))


def capped(found: DataFrame, limit: int | None, *order: str) -> DataFrame:
    """At most limit rows a repository in the given order; all rows for None."""
    if limit is None:
        return found
    w = Window.partitionBy("repository_id").orderBy(*order)
    return found.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= limit).drop("_n")


def api_endpoints(files: DataFrame, limit: int | None = 160) -> DataFrame:
    """(repository_id, framework, method, path, handler, file_path, line) of route declarations.

    Python: decorators with their router's and its inclusion's prefix in the same file, or a blueprint's; the
    handler is the first def in the eight lines below.  JavaScript: direct routes, route chains, and routes of a
    router used under a prefix, in addition to the unprefixed row.
    """
    src = source(files)
    py = src.where((extension(F.col("file_path")) == ".py") & F.col("content").rlike(rf"(?i)@\w+\.(?:{METHODS}|route)\("))
    py = py.withColumn("routers", _pairs(F.col("content"), r"(?is)(\w+)\s*=\s*(?:fastapi\.)?APIRouter\([^)]*prefix\s*=\s*[\"']([^\"']+)[\"']"))
    py = py.withColumn("included", _pairs(F.col("content"), r"(?is)\.include_router\(\s*(\w+)(?:[^)]*?prefix\s*=\s*[\"']([^\"']+)[\"'])?"))
    py = py.withColumn("blueprints", _pairs(F.col("content"), r"(?is)(\w+)\s*=\s*Blueprint\([^)]*url_prefix\s*=\s*[\"']([^\"']+)[\"']"))
    at = Window.partitionBy(*FILE).orderBy("line").rowsBetween(1, 8)
    rows = file_lines(py, "routers", "included", "blueprints").withColumn("def", F.nullif(F.regexp_extract("text", r"^\s*(?:async\s+)?def\s+(\w+)\s*\(", 1), F.lit("")))
    rows = rows.withColumn("handler", F.coalesce(F.first("def", ignorenulls=True).over(at), F.lit(""))).where(F.col("text").contains("@"))
    fast_p = rf"(?i)@(\w+)\.({METHODS})\(\s*[\"']([^\"']+)[\"']"
    fast = rows.select("*", F.explode(F.arrays_zip(*[F.regexp_extract_all("text", F.lit(fast_p), F.lit(i)).alias(n) for i, n in ((1, "target"), (2, "method"), (3, "path"))])).alias("m"))
    fast = fast.select(
        "repository_id", F.lit("FastAPI").alias("framework"), F.upper("m.method").alias("method"),
        join_route(_last("included", F.col("m.target")), _last("routers", F.col("m.target")), F.col("m.path")).alias("path"), "handler", "file_path", "line",
    )
    flask_p = r"(?i)@(\w+)\.route\(\s*[\"']([^\"']+)[\"'](?:,\s*methods\s*=\s*\[([^\]]+)\])?"
    flask = rows.select("*", F.explode(F.arrays_zip(*[F.regexp_extract_all("text", F.lit(flask_p), F.lit(i)).alias(n) for i, n in ((1, "target"), (2, "path"), (3, "methods"))])).alias("m"))
    named = F.regexp_extract_all(F.upper("m.methods"), F.lit("[A-Z]+"), F.lit(0))
    flask = flask.select("*", F.explode(F.when(F.size(named) > 0, named).otherwise(F.array(F.lit("GET")))).alias("method"))
    flask = flask.select("repository_id", F.lit("Flask").alias("framework"), "method", join_route(_last("blueprints", F.col("m.target")), F.col("m.path")).alias("path"), "handler", "file_path", "line")

    js = src.where(extension(F.col("file_path")).isin(".js", ".jsx", ".ts", ".tsx", ".mjs", ".cjs") & F.col("content").rlike(rf"(?i)\.(?:{METHODS}|route)\("))
    js = js.withColumn("used", _pairs(F.col("content"), r"(?i)\bapp\.use\(\s*[\"'`]([^\"'`]+)[\"'`]\s*,\s*(\w+)"))
    js_rows = file_lines(js, "used").where(F.col("text").rlike(rf"(?i)\.(?:{METHODS}|route)\("))
    call = rf"(?i)\b(\w+)\.({METHODS})\(\s*[\"'`]([^\"'`]+)[\"'`]\s*,\s*([A-Za-z_$][\w$]*)?"
    calls = js_rows.select("*", F.explode(F.arrays_zip(*[F.regexp_extract_all("text", F.lit(call), F.lit(i)).alias(n) for i, n in ((1, "target"), (2, "method"), (3, "path"), (4, "handler"))])).alias("m"))
    out = [F.lit("Express").alias("framework"), F.upper("m.method").alias("method")]
    direct = calls.where(F.lower("m.target").isin("app", "router")).select("repository_id", *out, F.col("m.path").alias("path"), F.col("m.handler").alias("handler"), "file_path", "line")
    # pairs of app.use are (prefix, router)
    prefixed = calls.select("*", F.explode(F.filter("used", lambda u: F.lower(u["value"]) == F.lower(F.col("m.target")))).alias("u"))
    prefixed = prefixed.select("repository_id", *out, join_route(F.col("u.name"), F.col("m.path")).alias("path"), F.col("m.handler").alias("handler"), "file_path", "line")
    chain = rf"(?i)\b(?:app|router)\.route\(\s*[\"'`]([^\"'`]+)[\"'`]\s*\)((?:\s*\.(?:{METHODS})\([^)]*\))+)"
    chains = js_rows.select("*", F.explode(F.arrays_zip(F.regexp_extract_all("text", F.lit(chain), F.lit(1)).alias("path"), F.regexp_extract_all("text", F.lit(chain), F.lit(2)).alias("rest"))).alias("m"))
    chains = chains.select("*", F.explode(F.regexp_extract_all("m.rest", F.lit(rf"(?i)\.({METHODS})\("), F.lit(1))).alias("method"))
    chains = chains.select("repository_id", F.lit("Express").alias("framework"), F.upper("method").alias("method"), F.col("m.path").alias("path"), F.lit("").alias("handler"), "file_path", "line")
    found = fast.unionByName(flask).unionByName(direct).unionByName(prefixed).unionByName(chains).distinct()
    return capped(found, limit, "file_path", "line", "framework", "method", "path", "handler")


def database_models(files: DataFrame, limit: int | None = 160) -> DataFrame:
    """(repository_id, technology, file_path, line, detail, model_name, fields, relationships) of object-relational and document models.

    A column belongs to the last class above it in its file, whether that class is a model or not.
    """
    src = source(files)
    none = F.array().cast("array<string>")
    py = src.where((extension(F.col("file_path")) == ".py") & F.col("content").rlike(r"\b(?:Column|mapped_column|relationship|ForeignKey|declarative_base|sqlalchemy|Mapped\[|models\.|Base|DeclarativeBase|db\.Model)\b|Mapped\["))
    rows = file_lines(py)
    rows = rows.withColumn("class", F.nullif(F.regexp_extract("text", r"^\s*class\s+(\w+)\(([^)]*)\):", 1), F.lit(""))).withColumn("bases", F.regexp_extract("text", r"^\s*class\s+(\w+)\(([^)]*)\):", 2))
    above = Window.partitionBy(*FILE).orderBy("line").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("model", F.coalesce(F.last("class", ignorenulls=True).over(above), F.lit("")))
    kind = F.when(F.col("bases").contains("models.Model"), "Django ORM").when(F.col("bases").rlike(r"\b(?:Base|DeclarativeBase|db\.Model)\b"), "SQLAlchemy")
    models = rows.where(F.col("class").isNotNull() & kind.isNotNull()).select(*FILE, kind.alias("technology"), "line", F.concat(F.lit("model "), "class").alias("detail"), F.col("class").alias("model_name"), none.alias("fields"), none.alias("relationships"))
    name, expr = F.regexp_extract("text", r"^\s*(\w+)\s*=\s*(.+)", 1), F.regexp_extract("text", r"^\s*(\w+)\s*=\s*(.+)", 2)
    alchemy = expr.rlike(r"\b(?:Column|mapped_column|relationship|ForeignKey)\b")
    django = expr.rlike(r"\bmodels\.(?:CharField|TextField|IntegerField|BigIntegerField|BooleanField|DateTimeField|DateField|ForeignKey|OneToOneField|ManyToManyField|JSONField|DecimalField)\b")
    linked = F.when(alchemy, expr.rlike(r"\b(?:relationship|ForeignKey)\b")).otherwise(expr.rlike(r"\bmodels\.(?:ForeignKey|OneToOneField|ManyToManyField)\b"))
    bare = F.regexp_replace("text", r"^\s+|\s+$", "")
    columns = rows.where((name != "") & (alchemy | django)).select(
        *FILE, F.when(alchemy, "SQLAlchemy").otherwise("Django ORM").alias("technology"), "line", F.concat(name, F.lit(": "), F.substring(bare, 1, 140)).alias("detail"), F.col("model").alias("model_name"),
        F.when(linked, none).otherwise(F.array(name)).alias("fields"), F.when(linked, F.array(name)).otherwise(none).alias("relationships"),
    )
    marks = rows.where((name == "") & F.col("text").rlike(r"\b(?:declarative_base|sqlalchemy|Mapped\[)\b")).select(
        *FILE, F.lit("SQLAlchemy").alias("technology"), "line", F.substring(bare, 1, 160).alias("detail"), F.lit("").alias("model_name"), none.alias("fields"), none.alias("relationships")
    )

    prisma = file_lines(src.where(extension(F.col("file_path")) == ".prisma")).withColumn("text", F.regexp_replace("text", r"^\s+|\s+$", ""))
    model = F.nullif(F.regexp_extract("text", r"^model\s+(\w+)\s+\{", 1), F.lit(""))
    # a closing brace ends the model: the last of both decides
    prisma = prisma.withColumn("opened", model).withColumn("mark", F.when(model.isNotNull(), model).when(F.col("text") == "}", F.lit("")))
    prisma = prisma.withColumn("inside", F.coalesce(F.last("mark", ignorenulls=True).over(Window.partitionBy(*FILE).orderBy("line").rowsBetween(Window.unboundedPreceding, -1)), F.lit("")))
    data, provider = F.regexp_extract("text", r"^datasource\s+(\w+)\s+\{", 1), F.regexp_extract("text", r"^provider\s*=\s*[\"']([^\"']+)[\"']", 1)
    field, kind2 = F.regexp_extract("text", r"^(\w+)\s+([A-Za-z][\w\[\]?]*)", 1), F.regexp_extract("text", r"^(\w+)\s+([A-Za-z][\w\[\]?]*)", 2)
    relation = kind2.rlike("^[A-Z]") | (F.col("text").contains("@") & F.col("text").contains("relation"))
    is_field = (F.col("inside") != "") & (field != "") & ~F.col("text").startswith("//")
    detail = F.when(F.col("opened").isNotNull(), F.concat(F.lit("model "), "opened")).when(data != "", F.concat(F.lit("datasource "), data)).when(provider != "", F.concat(F.lit("provider "), provider))
    detail = detail.when(is_field, F.concat("inside", F.lit("."), field, F.lit(": "), kind2))
    as_field = (F.col("opened").isNull()) & (data == "") & (provider == "") & is_field
    schema = prisma.where(detail.isNotNull()).select(
        *FILE, F.lit("Prisma").alias("technology"), "line", detail.alias("detail"), F.when(F.col("opened").isNotNull(), F.col("opened")).when(as_field, F.col("inside")).otherwise("").alias("model_name"),
        F.when(as_field & ~relation, F.array(field)).otherwise(none).alias("fields"), F.when(as_field & relation, F.array(field)).otherwise(none).alias("relationships"),
    )

    js = src.where(extension(F.col("file_path")).isin(".js", ".jsx", ".ts", ".tsx", ".mjs", ".cjs") & F.col("content").rlike(r"(?i)mongoose\.(?:schema|model)\("))
    # the line of a match is one more than the line breaks before it; what precedes the n-th match is what splitting leaves
    mongo = []
    for pattern, text, group in ((r"(?i)\b(?:new\s+)?mongoose\.Schema\(\s*\{", "schema definition", 0), (r"(?i)\bmongoose\.model\(\s*[\"'`]([^\"'`]+)[\"'`]", "model ", 1)):
        hits = F.regexp_extract_all("content", F.lit(pattern), F.lit(group))
        whole = F.regexp_extract_all("content", F.lit(pattern), F.lit(0))
        m = js.select(*FILE, F.split("content", pattern).alias("around"), whole.alias("whole"), F.posexplode(hits).alias("n", "hit"))
        before = F.concat(F.array_join(F.slice("around", F.lit(1), F.col("n") + 1), ""), F.array_join(F.slice("whole", F.lit(1), F.col("n")), ""))
        line = F.length(before) - F.length(F.replace(before, F.lit("\n"), F.lit(""))) + 1
        named = F.col("hit") if group else F.lit("")
        mongo.append(m.select(*FILE, F.lit("Mongoose").alias("technology"), line.alias("line"), F.concat(F.lit(text), named).alias("detail"), named.alias("model_name"), none.alias("fields"), none.alias("relationships")))
    found = models.unionByName(columns).unionByName(marks).unionByName(schema).unionByName(mongo[0]).unionByName(mongo[1]).distinct()
    return capped(found, limit, "file_path", "line", "detail")


# Names of files that start or configure a program.
STARTUP_NAMES = ["main.py", "app.py", "manage.py", "server.js", "server.ts", "index.js", "index.ts"]
CONFIG_NAMES = [".env", ".env.example", "settings.py", "config.py", "config.js", "config.ts", "pyproject.toml", "package.json", "Dockerfile", "docker-compose.yml", "docker-compose.yaml"]


def entrypoint_findings(files: DataFrame, limit: int | None = 80) -> DataFrame:
    """(repository_id, kind, file_path, reason): startup files, web applications and configuration."""
    src = source(files).withColumn("name", F.element_at(F.split("file_path", "/"), -1)).withColumn("ext", extension(F.col("file_path")))
    start = src.where(F.col("name").isin(*STARTUP_NAMES)).select(*FILE, F.lit("startup").alias("kind"), F.concat(F.lit("recognized entry filename `"), "name", F.lit("`")).alias("reason"))
    py = src.where((F.col("ext") == ".py") & F.col("content").rlike(r"\b(?:FastAPI|Flask)\s*\(")).select(*FILE, F.lit("application").alias("kind"), F.lit("creates a Python web application object").alias("reason"))
    js = src.where(F.col("ext").isin(".js", ".ts") & F.col("content").rlike(r"\b(?:express\(\)|createServer|app\.listen)\b")).select(*FILE, F.lit("application").alias("kind"), F.lit("creates or starts a Node web application").alias("reason"))
    conf = src.where(F.col("name").isin(*CONFIG_NAMES)).select(*FILE, F.lit("configuration").alias("kind"), F.concat(F.lit("recognized configuration file `"), "name", F.lit("`")).alias("reason"))
    found = start.unionByName(py).unionByName(js).unionByName(conf).distinct()
    return capped(found, limit, "file_path", "kind")


# -- Python syntax trees ----------------------------------------------------------

_RELATIONS = "repository_id string, file_path string, kind string, line int, scope string, owner string, name string, attribute string, level int"


def _read_tree(text: str) -> list[tuple]:
    """(kind, line, scope, owner, name, attribute, level) of the definitions, imports and calls of a Python text; [] if it doesn't parse."""
    try:
        with warnings.catch_warnings():
            warnings.simplefilter("ignore")
            tree = ast.parse(text)
    except (SyntaxError, ValueError, RecursionError, MemoryError):
        return []
    out: list[tuple] = []
    for node in tree.body:
        if isinstance(node, ast.FunctionDef | ast.AsyncFunctionDef):
            out.append(("def", node.lineno, "", "", node.name, "", 0))
        elif isinstance(node, ast.ClassDef):
            out += [("def", x.lineno, "", "", f"{node.name}.{x.name}", "", 0) for x in node.body if isinstance(x, ast.FunctionDef | ast.AsyncFunctionDef)]
    top = {id(n) for n in tree.body}
    todo: list[tuple[ast.AST, tuple[str, ...], tuple[str, ...]]] = [(tree, (), ())]
    while todo:
        node, classes, functions = todo.pop()
        if isinstance(node, ast.Import):
            for a in node.names:
                out.append(("import", node.lineno, "top" if id(node) in top else "", a.asname or a.name.split(".")[0], a.name, "", 0))
        elif isinstance(node, ast.ImportFrom):
            for a in node.names:
                out.append(("from", node.lineno, "top" if id(node) in top else "", a.asname or a.name, node.module or "", a.name, node.level))
        elif isinstance(node, ast.Call) and (classes or functions):
            scope, own = ".".join((*classes, *functions)), classes[-1] if classes else ""
            f = node.func
            if isinstance(f, ast.Name):
                out.append(("call", node.lineno, scope, own, f.id, "", 0))
            elif isinstance(f, ast.Attribute) and isinstance(f.value, ast.Name):
                out.append(("call", node.lineno, scope, own, f.value.id, f.attr, 0))
        if isinstance(node, ast.ClassDef):
            classes = (*classes, node.name)
        elif isinstance(node, ast.FunctionDef | ast.AsyncFunctionDef):
            functions = (*functions, node.name)
        todo += [(x, classes, functions) for x in ast.iter_child_nodes(node)]
    return out


def python_relations(files: DataFrame) -> DataFrame:
    """Definitions, imports and calls of every Python file, one row each; a file that doesn't parse has none.

    What several resolutions need is written once, so that each file is parsed once.
    """
    src = source(files).where(extension(F.col("file_path")) == ".py")

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [x.split()[0] for x in _RELATIONS.split(", ")]
        kinds = [pa.int32() if x.endswith(" int") else pa.string() for x in _RELATIONS.split(", ")]
        for b in batches:
            rows = [(r, p, *x) for r, p, t in zip(*(b.column(i).to_pylist() for i in range(3)), strict=True) for x in _read_tree(t)]
            cols = list(zip(*rows, strict=True)) or [()] * len(names)
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names)

    return src.mapInArrow(read, _RELATIONS)


def _module(path: Column) -> Column:
    return F.replace(F.regexp_replace(path, r"\.py$", ""), F.lit("/"), F.lit("."))


def module_index(files: DataFrame) -> DataFrame:
    """(repository_id, module, target): dotted names of Python files; a package's name means its __init__ file."""
    py = source(files).where(extension(F.col("file_path")) == ".py").select("repository_id", _module(F.col("file_path")).alias("module"), F.col("file_path").alias("target"))
    packages = py.where(F.col("module").endswith(".__init__")).withColumn("module", F.regexp_replace("module", r"\.__init__$", ""))
    return py.unionByName(packages).groupBy("repository_id", "module").agg(F.max("target").alias("target"))


def prefixes(module: Column) -> Column:
    """All dotted prefixes of a name, itself included."""
    parts = F.split(module, r"\.")
    return F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, F.lit(1), i), "."))


def resolve_modules(imports: DataFrame, index: DataFrame) -> DataFrame:
    """imports(repository_id, module, ...) with resolved: the file of the longest known prefix of module, else module itself.

    Distinct names are resolved once, by an equality join on their prefixes.
    """
    names = imports.select("repository_id", "module").distinct().withColumn("prefix", F.explode(prefixes(F.col("module"))))
    hits = names.join(index.withColumnRenamed("module", "prefix"), ["repository_id", "prefix"]).groupBy("repository_id", "module").agg(F.max(F.struct(F.length("prefix").alias("n"), "target")).alias("hit"))
    return imports.join(hits, ["repository_id", "module"], "left").withColumn("resolved", F.coalesce("hit.target", "module")).drop("hit")


def python_imports(files: DataFrame, relations: DataFrame | None = None) -> DataFrame:
    """(repository_id, source_file, target, resolved_target, import_type, line) of imports; 'from . import x' has no module and is left out.

    The level of a relative import shows in target and is ignored in resolution.
    """
    rel = written(python_relations(files)) if relations is None else relations
    one = rel.where("kind = 'import'").select(*FILE, F.col("name").alias("module"), F.col("name").alias("target"), F.lit("python import").alias("import_type"), "line")
    many = rel.where("kind = 'from' and name <> ''").select(*FILE, F.col("name").alias("module"), F.concat(F.repeat(F.lit("."), F.col("level")), "name").alias("target"), F.lit("python from-import").alias("import_type"), "line")
    out = resolve_modules(one.unionByName(many).distinct(), module_index(files))
    return out.select("repository_id", F.col("file_path").alias("source_file"), "target", F.col("resolved").alias("resolved_target"), "import_type", "line").distinct()


def script_imports(files: DataFrame) -> DataFrame:
    """The same of JavaScript and TypeScript: import, require and dynamic import; relative targets are looked up as files.

    A target is tried with each suffix in the order js, jsx, ts, tsx in place of its own, then as a folder's index.
    """
    src = source(files)
    js = src.where(extension(F.col("file_path")).isin(".js", ".jsx", ".ts", ".tsx") & F.col("content").rlike(r"\b(?:import|require)\b"))
    rows = file_lines(js).where(F.col("text").rlike(r"\b(?:import|require)\b"))
    found = None
    for pattern, kind in (
        (r"\bimport\s+(?:[^\"'`]+?\s+from\s+)?[\"'`]([^\"'`]+)[\"'`]", "es import"),
        (r"\brequire\(\s*[\"'`]([^\"'`]+)[\"'`]\s*\)", "commonjs require"),
        (r"\bimport\(\s*[\"'`]([^\"'`]+)[\"'`]\s*\)", "dynamic import"),
    ):
        one = rows.select(*FILE, "line", F.explode(F.regexp_extract_all("text", F.lit(pattern), F.lit(1))).alias("target"), F.lit(kind).alias("import_type"))
        found = one if found is None else found.unionByName(one)
    found = found.distinct()
    # the path the target names: the folder of the importing file, '..' taking one away
    folder = F.slice(F.split("file_path", "/"), F.lit(1), F.size(F.split("file_path", "/")) - 1)
    steps = F.filter(F.split("target", "/"), lambda x: (x != "") & (x != "."))
    walked = F.aggregate(steps, folder, lambda acc, x: F.when(x == "..", F.slice(acc, F.lit(1), F.greatest(F.size(acc) - 1, F.lit(0)))).otherwise(F.concat(acc, F.array(x))))
    base = F.array_join(walked, "/")
    stem = F.regexp_replace(base, r"(?<=[^/])\.[^./]*$", "")
    tries = F.array(*[F.struct(F.lit(i).alias("order"), F.concat(stem, F.lit(s)).alias("candidate")) for i, s in enumerate((".js", ".jsx", ".ts", ".tsx"))], *[F.struct(F.lit(4 + i).alias("order"), F.concat(base, F.lit("/index" + s)).alias("candidate")) for i, s in enumerate((".js", ".jsx", ".ts", ".tsx"))])
    near = found.where(F.col("target").startswith(".")).select(*FILE, "target").distinct().withColumn("t", F.explode(tries)).select(*FILE, "target", "t.order", "t.candidate")
    known = src.select("repository_id", F.col("file_path").alias("candidate"))
    hit = near.join(known, ["repository_id", "candidate"]).groupBy(*FILE, "target").agg(F.min(F.struct("order", "candidate")).alias("hit"))
    out = found.join(hit, [*FILE, "target"], "left")
    return out.select("repository_id", F.col("file_path").alias("source_file"), "target", F.coalesce("hit.candidate", "target").alias("resolved_target"), "import_type", "line").distinct()


def module_dependencies(files: DataFrame, limit: int | None = 240, relations: DataFrame | None = None) -> DataFrame:
    """Imports of both language families, distinct by file, target, kind and line."""
    both = python_imports(files, relations).unionByName(script_imports(files))
    one = both.groupBy("repository_id", "source_file", "target", "import_type", "line").agg(F.min("resolved_target").alias("resolved_target"))
    return capped(one, limit, "source_file", "line", "target", "import_type")


def call_graph(files: DataFrame, limit: int | None = 240, relations: DataFrame | None = None) -> DataFrame:
    """(repository_id, caller_file, caller_symbol, callee_file, callee_symbol, call_type, line) of Python calls that resolve safely.

    A name resolves to a definition of its own file, else to an imported symbol's; self and cls to a method of the
    class; another base to an imported module's function.  Each is an equality join; a call that two ways reach
    keeps the first.
    """
    rel = written(python_relations(files)) if relations is None else relations
    defs = rel.where("kind = 'def'").select("repository_id", F.col("file_path").alias("callee_file"), F.col("name").alias("callee_symbol")).distinct()
    calls = rel.where("kind = 'call'").select(*FILE, "line", "scope", "owner", "name", "attribute").distinct()
    index = module_index(files).select("repository_id", "module", F.col("target").alias("callee_file"))
    tops = rel.where("scope = 'top'")
    package = F.slice(F.split(_module(F.col("file_path")), r"\."), F.lit(1), F.greatest(F.size(F.split(_module(F.col("file_path")), r"\.")) - F.col("level"), F.lit(0)))
    absolute = F.when(F.col("level") == 0, F.col("name")).otherwise(F.array_join(F.filter(F.concat(package, F.array("name")), lambda x: x != ""), "."))
    # of several imports under a name the last line counts
    symbols = tops.where("kind = 'from' and attribute <> '*'").select(*FILE, F.col("owner").alias("name"), F.struct("line", absolute.alias("module"), F.col("attribute").alias("symbol")).alias("i"))
    symbols = symbols.groupBy(*FILE, "name").agg(F.max("i").alias("i")).select(*FILE, "name", "i.module", F.col("i.symbol").alias("callee_symbol")).where("module <> ''")
    modules = tops.where("kind = 'import'").select(*FILE, F.col("owner").alias("name"), F.struct("line", F.col("name").alias("module")).alias("i")).groupBy(*FILE, "name").agg(F.max("i.module").alias("module"))
    plain, dotted = calls.where("attribute = ''"), calls.where("attribute <> ''")
    local = plain.withColumn("callee_file", F.col("file_path")).withColumn("callee_symbol", F.col("name")).join(defs, ["repository_id", "callee_file", "callee_symbol"], "left_semi").withColumn("call_type", F.lit("local function"))
    rest = plain.join(local.select(*FILE, "name").distinct(), [*FILE, "name"], "left_anti")
    on = ["repository_id", "callee_file", "callee_symbol"]
    imported = rest.join(symbols, [*FILE, "name"]).join(index, ["repository_id", "module"]).join(defs, on, "left_semi").withColumn("call_type", F.lit("imported function"))
    own = dotted.where("name in ('self', 'cls') and owner <> ''").withColumn("callee_file", F.col("file_path")).withColumn("callee_symbol", F.concat("owner", F.lit("."), "attribute"))
    method = own.join(defs, on, "left_semi").withColumn("call_type", F.lit("local method"))
    other = dotted.where("not (name in ('self', 'cls') and owner <> '')").join(modules, [*FILE, "name"]).join(index, ["repository_id", "module"]).withColumn("callee_symbol", F.col("attribute"))
    through = other.join(defs, on, "left_semi").withColumn("call_type", F.lit("imported module function"))
    cols = ["repository_id", F.col("file_path").alias("caller_file"), F.col("scope").alias("caller_symbol"), "callee_file", "callee_symbol", "call_type", "line"]
    found = local.select(*cols).unionByName(imported.select(*cols)).unionByName(method.select(*cols)).unionByName(through.select(*cols))
    one = found.groupBy("repository_id", "caller_file", "caller_symbol", "callee_file", "callee_symbol", "line").agg(F.min("call_type").alias("call_type"))
    return capped(one, limit, "caller_file", "line", "caller_symbol", "callee_file", "callee_symbol")


# -- files at the root ----------------------------------------------------------

# Technologies and the words that show them.
STACK = {
    "backend": {"Python": ["python"], "FastAPI": ["fastapi"], "Django": ["django"], "Flask": ["flask"], "Express": ["express"], "Node.js": ["node", "nodejs"], "Celery": ["celery"]},
    "frontend": {"React": ["react"], "Vue": ["vue", "@vue/"], "Next.js": ["next"], "Vite": ["vite"], "Svelte": ["svelte"], "TypeScript": ["typescript"]},
    "database": {
        "PostgreSQL": ["postgresql", "postgres", "psycopg", "asyncpg", "pg"], "MySQL": ["mysql", "pymysql", "mysqlclient"], "Redis": ["redis"], "SQLite": ["sqlite"],
        "MongoDB": ["mongodb", "mongoose", "pymongo"], "Prisma": ["prisma"], "SQLAlchemy": ["sqlalchemy"], "Django ORM": ["django.db", "models.model"],
    },
    "devops": {"Docker": ["dockerfile", "containerfile", "docker-compose", "compose.yml", "compose.yaml"], "GitHub Actions": [".github/workflows"], "Nginx": ["nginx"], "Gunicorn": ["gunicorn"], "Uvicorn": ["uvicorn"]},
    "ai": {"LangChain": ["langchain"], "LangGraph": ["langgraph"], "OpenAI SDK": ["openai"], "Chroma": ["chromadb", "chroma"], "SentenceTransformers": ["sentence-transformers", "sentence_transformers"], "Transformers": ["transformers"]},
}
SIGNAL_FILES = ["requirements.txt", "pyproject.toml", "package.json", "Dockerfile", "docker-compose.yml", "docker-compose.yaml", "compose.yml", "compose.yaml", "Pipfile", "go.mod", "Cargo.toml", "README.md"]


def signal_text(files: DataFrame) -> DataFrame:
    """(repository_id, text): the lower-case texts of the telling files at the root, the names of package dependencies, and the mark of workflows."""
    f = unique_files(files)
    order = F.array_position(F.array(*[F.lit(x) for x in SIGNAL_FILES]), F.col("file_path"))
    root = f.where(F.col("file_path").isin(*SIGNAL_FILES) & (F.coalesce("content", F.lit("")) != ""))
    deps = F.from_json("content", "dependencies map<string,string>, devDependencies map<string,string>")
    names = F.array_join(F.concat(F.coalesce(F.map_keys(deps["dependencies"]), F.array()), F.coalesce(F.map_keys(deps["devDependencies"]), F.array())), " ")
    parts = root.select("repository_id", order.cast("int").alias("n"), F.concat(F.lit("# "), "file_path", F.lit("\n"), "content").alias("part"))
    package = root.where("file_path = 'package.json'").select("repository_id", F.lit(90).alias("n"), F.coalesce(names, F.lit("")).alias("part"))
    flows = f.where(F.col("file_path").startswith(".github/workflows/")).select("repository_id", F.lit(91).alias("n"), F.lit(".github/workflows").alias("part")).distinct()
    all_ = parts.unionByName(package).unionByName(flows)
    return all_.groupBy("repository_id").agg(F.lower(F.array_join(F.array_sort(F.collect_list(F.struct("n", "part")))["part"], "\n")).alias("text"))


def _needle(word: str) -> str:
    quoted = "".join("\\" + c if c in ".+*?()[]{}|^$\\" else c for c in word)
    return rf"(?:^|[^a-z0-9_\-]){quoted}(?:[^a-z0-9_\-]|$)"


def technology_stack(files: DataFrame) -> DataFrame:
    """(repository_id, category, label) of the technologies that the signal text shows as whole words."""
    t = signal_text(files)
    found = []
    for category, rules in STACK.items():
        for label, words in rules.items():
            hit = F.col("text").rlike("|".join(_needle(w) for w in words))
            if label == "Python":
                hit = hit | F.col("text").rlike(r"\.py\b|python")
            found.append(F.when(hit, F.struct(F.lit(category).alias("category"), F.lit(label).alias("label"))))
    return t.select("repository_id", F.explode(F.array_compact(F.array(*found))).alias("f")).select("repository_id", "f.category", "f.label")


def startup_hints(files: DataFrame) -> DataFrame:
    """(repository_id, place, hint) in the order the hints are shown: scripts of package.json, then files that tell how to start."""
    f = unique_files(files)
    package = f.where("file_path = 'package.json'").withColumn("scripts", F.from_json("content", "scripts map<string,string>")["scripts"])
    names = F.array(*[F.struct(F.lit(i).alias("place"), F.lit(n).alias("name")) for i, n in enumerate(("dev", "start", "serve", "build"))])
    scripts = package.select("repository_id", "scripts", F.explode(names).alias("s")).where(F.col("scripts")[F.col("s.name")].isNotNull())
    scripts = scripts.select("repository_id", "s.place", F.concat(F.lit("`npm run "), "s.name", F.lit("` -> `"), F.col("scripts")[F.col("s.name")], F.lit("`")).alias("hint"))
    rules = [
        ("requirements.txt", "Python dependencies detected: install with `pip install -r requirements.txt`."),
        ("pyproject.toml", "Python project metadata detected in `pyproject.toml`; use the configured build tool or `pip install -e .`."),
        ("manage.py", "Django entry point detected: try `python manage.py runserver`."),
        ("app/main.py", "FastAPI-style `app/main.py` detected: try `uvicorn app.main:app --reload`."),
        ("main.py", "Python `main.py` detected: try `python main.py`."),
        ("Dockerfile", "Dockerfile detected: build with `docker build -t <name> .` and run the resulting image."),
        ("docker-compose.yml", "Docker Compose config detected: try `docker compose up --build`."),
        ("docker-compose.yaml", "Docker Compose config detected: try `docker compose up --build`."),
    ]
    hint = F.create_map(*[F.lit(x) for r in rules for x in r])
    place = F.create_map(*[F.lit(x) for i, r in enumerate(rules) for x in (r[0], 4 + min(i, 6))])
    known = f.where(F.col("file_path").isin(*[r[0] for r in rules])).select("repository_id", place[F.col("file_path")].alias("place"), hint[F.col("file_path")].alias("hint"))
    return scripts.unionByName(known).distinct()


# Files that say how a project is deployed.
DEPLOYMENT = {"Dockerfile": "Dockerfile", "docker-compose.yml": "Docker Compose", "docker-compose.yaml": "Docker Compose", "vercel.json": "Vercel", "netlify.toml": "Netlify", "Procfile": "Procfile"}


def deployment_methods(files: DataFrame) -> DataFrame:
    """(repository_id, method) of the ways of deployment that files at the root show."""
    f = unique_files(files.select("repository_id", "file_path", F.lit(None).cast("string").alias("content"), F.lit(None).cast("bigint").alias("size_bytes"), F.lit(None).cast("int").alias("ord")))
    method = F.create_map(*[F.lit(x) for kv in DEPLOYMENT.items() for x in kv])[F.col("file_path")]
    method = F.when(F.col("file_path").startswith(".github/workflows/"), "GitHub Actions").otherwise(method)
    return f.select("repository_id", method.alias("method")).where("method is not null").distinct()


def environment_variables(files: DataFrame, limit: int | None = 80) -> DataFrame:
    """(repository_id, variable) named in the example settings, front page and compose files at the root."""
    f = unique_files(files).where(F.col("file_path").isin(".env.example", "README.md", "docker-compose.yml", "docker-compose.yaml"))
    out = f.select("repository_id", F.explode(environment_names(F.col("content"))).alias("variable")).distinct()
    return capped(out, limit, "variable")
