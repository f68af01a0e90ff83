"""Filters, text functions, manifests, statistics and analyses on small repositories."""

import hashlib
import random

import pytest
from pyspark.sql import functions as F

from lucerna.functions import filters as FL
from lucerna.functions import languages as LG
from lucerna.functions import text as TX
from lucerna.operators import analyze as A
from lucerna.operators import maintain as M
from lucerna.operators import stats as S
from lucerna.operators.corpus import unique_files
from lucerna.plans import report


def _one(spark, value, fn, kind="string"):
    return spark.createDataFrame([(value,)], f"x {kind}").select(fn(F.col("x")).alias("y")).first().y


@pytest.mark.parametrize(("path", "kept", "language"), [
    ("src/a.py", True, "python"), ("node_modules/a.js", False, "javascript"), ("a/vendor", False, "text"), (".env", False, "text"), (".env.example", False, "text"), ("secretary.py", False, "python"), ("x.png", False, "text"), ("Dockerfile", True, "dockerfile"),
    ("README", True, "text"), ("a.unknown", False, "text"), ("Node_Modules/a.js", True, "javascript"), ("go.mod", True, "go"), ("a.tar.gz", False, "text"), ("yarn.lock", False, "text"), ("b.TSX", True, "typescript"),
])
def test_filters(spark, path, kept, language):
    assert _one(spark, path, FL.included) is kept and _one(spark, path, LG.language) == language


def test_redaction(spark):
    text = 'api_key = "abc123"\npassword: hunter2;\nAuthorization: Bearer abcdefghijklmnop\nurl = postgres://u:p@h/db\nname = value'
    out = _one(spark, text, TX.redact)
    assert out == 'api_key = "[REDACTED]"\npassword: [REDACTED];\nAuthorization: Bearer [REDACTED]\nurl = postgres://[REDACTED]\nname = value'
    assert _one(spark, None, TX.redact) is None and _one(spark, "", TX.redact) == ""


def test_text_functions(spark):
    assert _one(spark, "a\r\nb\x0bc\x1cd\u2028e\n", TX.lines) == "a\r\nb\x0bc\x1cd\u2028e\n".splitlines() and _one(spark, "", TX.lines) == [] and _one(spark, "\n\n", TX.lines) == ["", ""]
    assert _one(spark, "```json\n[1, 2]\n```", TX.json_array) == ["1", "2"] and _one(spark, 'x ["a"] y', TX.json_array) == ["a"] and _one(spark, "none", TX.json_array) is None
    assert _one(spark, "A_KEY=1\nDB_HOST x URL\n lower=2\n  PLAIN_X = 3", TX.environment_names) == ["A_KEY", "PLAIN_X", "DB_HOST", "URL"]
    assert _one(spark, "aXaXa", lambda c: TX.occurrences(c, F.lit("aXa"))) == "aXaXa".count("aXa")
    assert TX.keywords("How to RUN?") == sorted({"how", "to", "run", *TX.STARTUP_VOCABULARY}) and TX.intents("prune") == {"startup"} and TX.keywords("模块")[0] != "模"
    assert _one(spark, "/a/", lambda c: TX.join_route(F.lit("/"), F.lit(""), c, F.lit("b/"))) == "/a/b" and _one(spark, "/", TX.join_route) == "/"


@pytest.mark.parametrize(("url", "want"), [
    ("https://github.com/a/b", "https://github.com/a/b.git"), (" https://github.com/a/b.git/ ", "https://github.com/a/b.git"), ("http://github.com/a/b", None), ("https://evil.com/a/b", None), ("https://github.com/a", None), ("https://github.com/a/b/c", None),
    ("https://u:p@github.com/a/b", None), ("https://github.com/a/b?x=1", None), ("https://github.com/a/..", None), ("https://github.com:443/a/b", None), ("https://github.com/a/b#f", None), (None, None),
])
def test_repository_urls(spark, url, want):
    assert _one(spark, url, TX.canonical_repository_url) == want


def test_source_urls(spark):
    rows = [("https://github.com/a/b.git", "src/x y.py", 3, 9, "https://github.com/a/b/blob/HEAD/src/x%20y.py#L3-L9"), ("https://github.com/a/b", "ü/+*~.md", 0, 5, "https://github.com/a/b/blob/HEAD/%C3%BC/%2B%2A~.md"), ("https://github.com/a/b", "../x", 1, 1, None), ("https://x.com/a/b", "x", 1, 1, None), (None, "x", 1, 1, None), ("https://github.com/a/b", "x", 4, 2, "https://github.com/a/b/blob/HEAD/x#L4")]
    df = spark.createDataFrame(rows, "u string, p string, s int, e int, want string")
    assert [r.got for r in df.select("want", TX.source_url(F.col("u"), F.col("p"), F.col("s"), F.col("e")).alias("got")).collect()] == [r[4] for r in rows]


def test_manifest_and_changes(spark, chunks_of):
    v1 = [{"path": "a", "index": 0, "content": "one", "language": "text"}, {"path": "a", "index": 1, "content": "two"}, {"path": "b", "content": "three"}, {"path": "c", "content": "same"}]
    m = M.build_manifest(chunks_of(v1))
    a = {r.file_path: r for r in m.collect()}
    assert a["a"].hash == hashlib.sha256(b"012textfunctionone112functiontwo").hexdigest() and a["a"].chunk_ids == ["r:a:0", "r:a:1"] and a["a"].chunk_count == 2
    v2 = [*v1[:1], {"path": "a", "index": 1, "content": "changed"}, {"path": "c", "content": "same"}, {"path": "d", "content": "new"}]
    changes = M.diff_manifest(M.build_manifest(chunks_of(v2)), m)
    assert {r.file_path: (r.change, len(r.delete_ids), len(r.insert_ids)) for r in changes.collect()} == {"a": ("changed", 2, 2), "b": ("removed", 1, 0), "c": ("unchanged", 0, 0), "d": ("added", 0, 1)}
    r = M.index_result(changes).first()
    assert (r.added_files, r.changed_files, r.removed_files, r.unchanged_files, r.inserted_chunks, r.deleted_chunks, r.cached) == (1, 1, 1, 1, 3, 3, False)
    after = M.apply_changes(chunks_of(v1), chunks_of(v2), changes)
    assert sorted((x.file_path, x.chunk_index, x.content) for x in after.collect()) == sorted((x["path"], x.get("index", 0), x["content"]) for x in v2)
    assert {r.change for r in M.diff_manifest(m, m).collect()} == {"unchanged"} and {r.change for r in M.diff_manifest(m, m.limit(0)).collect()} == {"added"}


def test_requests_in_window(spark):
    rng = random.Random(8)
    rows = [(i, rng.choice(["hot", "hot", "b"]), rng.randrange(3000) / 2) for i in range(700)] + [(900, None, 1.0), (901, "b", None), (902, "hot", 600.0), (903, "hot", 540.0)]
    df = spark.createDataFrame(rows, "id bigint, who string, t double").withColumn("at", F.timestamp_seconds("t"))
    want = {i: sum(1 for _, v, u in rows if v == w and u is not None and t - 60 <= u <= t) for i, w, t in rows if w and t is not None}
    for block in (1, 100, 86_400):
        assert {r.id: r.requests for r in M.requests_in_window(df, "who", "at", "id", 60, block).collect()} == want


def test_catalog_entry(spark):
    c = spark.createDataFrame([("a", 1), ("bad id!", 2)], "repository_id string, n int")
    assert [r.n for r in M.catalog_entry(c, "a").collect()] == [1] and M.catalog_entry(c, "bad id!").count() == M.catalog_entry(c, "x").count() == 0


def test_report_cache(spark, files_of):
    f = files_of({"a.py": "x", "b.py": "yy"})
    s = M.tree_signature(f)
    assert s.first().bytes == 3 and M.cached_reports(s, s).first().use_cache and not M.cached_reports(s, M.tree_signature(files_of({"a.py": "x"}))).first().use_cache and not M.cached_reports(s, s.limit(0)).first().use_cache


def test_audit_time(spark):
    rows = [("2025-01-02T03:04:05Z", True), ("2025-01-02 03:04:05", True), ("2025-01-02T03:04:05+00:00", True), ("1735787045", True), ("", False), ("yesterday", False), (None, False)]
    got = spark.createDataFrame(rows, "t string, ok boolean").select("ok", M.audit_time(F.col("t")).cast("string").alias("at")).collect()
    assert all((r.at == "2025-01-02 03:04:05") == r.ok for r in got)


def test_statistics(spark, files_of):
    tree = {f"src/m{i}.py": "x" * i for i in range(5)} | {"README.md": "r" * 50, ".github/workflows/ci.yml": "on: x", "web/app/main.js": "m", "node_modules/x.js": "n", "deep/a/b/c/d.py": "d"}
    f = files_of([("r", p, c) for p, c in tree.items()] + [("r", "src/m1.py", "x"), (None, "a.py", "x"), ("r", None, "x")])
    mods = [(r.module, r.files, r.languages) for r in sorted(S.core_modules(f).collect(), key=lambda r: r.place)]
    assert mods[0] == ("src", 5, "python") and (".", 2, "markdown,yaml") in mods and not any(m == "node_modules" for m, _, _ in mods)
    c = S.repository_counts(f).first()
    assert (c.files, c.folders) == (9, 9)
    assert S.largest_files(f).where("place = 1").first().file_path == "README.md"
    lines = [r.line for r in sorted(S.directory_tree(f).collect(), key=lambda r: r.place)]
    assert lines[:2] == [".github/", "    workflows/"] and lines[-1] == "README.md" and "            c/" not in lines and lines.index("deep/") < lines.index("src/") < lines.index("web/")
    assert [r.file_path for r in S.entry_points(f).collect()] == []
    sized = spark.createDataFrame([("r", f"f{i}.py", None, s, i) for i, s in enumerate([50, 60, 30, 20, 90])] + [("q", "a.py", None, 10, 0)], "repository_id string, file_path string, content string, size_bytes bigint, ord int")
    assert sorted(r.file_path for r in S.within_budget(sized, 3, 100, 80).where("repository_id = 'r'").collect()) == ["f0.py", "f2.py", "f3.py"]
    assert S.within_budget(sized, 3, 100, 80).where("repository_id = 'q'").count() == 1


APP = '''from fastapi import APIRouter, FastAPI
import os.path as osp
from .util import helper as h, missing
from pkg.util import other
import pkg.util
router = APIRouter(
    tags=["x"], prefix="/v1")
app = FastAPI()
app.include_router(router, prefix="/api")

@router.get("/items/{id}")
@cached
async def items(id: int):
    h(id)
    return pkg.util.other()

@app.post('/')
def root():
    other()
    items(1)

class Row(Base):
    name = Column(String)
    owner = relationship("User")
    def save(self):
        self.check()
    def check(self): pass

class Plain:
    other = models.CharField()
'''


@pytest.fixture(scope="module")
def repo(files_of):
    return files_of({
        "pkg/app.py": APP, "pkg/util.py": "def helper(x): return x\ndef other():\n    return helper(1)\n", "pkg/__init__.py": "", "broken.py": "def f(:\n",
        "flask_app.py": "bp = Blueprint('a', __name__, url_prefix='/b')\n@bp.route('/x', methods=['GET', \"POST\"])\ndef view(): pass\n@app.route('/y')\ndef other(): pass\napp = Flask(__name__)\n",
        "web/server.js": "const r = require('./routes');\napp.use('/p', users);\nusers.get('/list', show);\nrouter.get('/raw', handler)\napp.route('/c').get(a).post(b)\napp.listen(1)\nimport(`./lazy.js`)\nimport x from '../lib'\n", "web/routes/index.js": "", "lib.ts": "", "web/lazy.ts": "",
        "schema.prisma": "datasource db {\n  provider = \"postgresql\"\n}\nmodel User {\n  id Int @id\n  // note x\n  name string\n}\n", "db/m.js": "const s = new mongoose.Schema({\n});\nmongoose.model('Cat', s);",
        "package.json": '{"scripts": {"start": "node x", "dev": "vite"}, "dependencies": {"express": "1", "react": "2"}}', "requirements.txt": "fastapi\npsycopg[binary]\n", "Dockerfile": "FROM node:20\n", ".github/workflows/ci.yml": "x", "docker-compose.yml": "API_TOKEN=1\nx: ${DB_HOST}\n", "README.md": "Uses redis. NOT_A_MATCH\nSECRET_X = y", "manage.py": None,
    })


def test_routes(repo):
    got = {(r.framework, r.method, r.path, r.handler, r.file_path, r.line) for r in A.api_endpoints(repo).collect()}
    assert got == {
        ("FastAPI", "GET", "/api/v1/items/{id}", "items", "pkg/app.py", 11), ("FastAPI", "POST", "/", "root", "pkg/app.py", 17), ("Flask", "GET", "/b/x", "view", "flask_app.py", 2), ("Flask", "POST", "/b/x", "view", "flask_app.py", 2),
        ("Flask", "GET", "/y", "other", "flask_app.py", 4), ("Express", "GET", "/p/list", "show", "web/server.js", 3), ("Express", "GET", "/raw", "handler", "web/server.js", 4), ("Express", "GET", "/c", "", "web/server.js", 5), ("Express", "POST", "/c", "", "web/server.js", 5),
    }
    assert A.api_endpoints(repo, 2).count() == 2 and A.api_endpoints(repo.limit(0)).count() == 0


def test_models(repo):
    got = {(r.technology, r.file_path, r.line, r.model_name, tuple(r.fields), tuple(r.relationships)) for r in A.database_models(repo).collect()}
    assert got == {
        ("SQLAlchemy", "pkg/app.py", 22, "Row", (), ()), ("SQLAlchemy", "pkg/app.py", 23, "Row", ("name",), ()), ("SQLAlchemy", "pkg/app.py", 24, "Row", (), ("owner",)), ("Django ORM", "pkg/app.py", 30, "Row", ("other",), ()),
        ("Prisma", "schema.prisma", 1, "", (), ()), ("Prisma", "schema.prisma", 2, "", (), ()), ("Prisma", "schema.prisma", 4, "User", (), ()), ("Prisma", "schema.prisma", 5, "User", (), ("id",)), ("Prisma", "schema.prisma", 7, "User", ("name",), ()),
        ("Mongoose", "db/m.js", 1, "", (), ()), ("Mongoose", "db/m.js", 3, "Cat", (), ()),
    }


def test_imports(repo):
    got = {(r.source_file, r.target, r.resolved_target, r.import_type) for r in A.module_dependencies(repo).collect()}
    assert got == {
        ("pkg/app.py", "fastapi", "fastapi", "python from-import"), ("pkg/app.py", "os.path", "os.path", "python import"), ("pkg/app.py", ".util", "util", "python from-import"), ("pkg/app.py", "pkg.util", "pkg/util.py", "python from-import"), ("pkg/app.py", "pkg.util", "pkg/util.py", "python import"),
        ("web/server.js", "./routes", "web/routes/index.js", "commonjs require"), ("web/server.js", "./lazy.js", "web/lazy.ts", "dynamic import"), ("web/server.js", "../lib", "lib.ts", "es import"),
    }


def test_calls(repo):
    got = {(r.caller_symbol, r.callee_file, r.callee_symbol, r.call_type) for r in A.call_graph(repo).collect()}
    assert got == {
        ("items", "pkg/util.py", "helper", "imported function"), ("root", "pkg/util.py", "other", "imported function"), ("root", "pkg/app.py", "items", "local function"), ("Row.save", "pkg/app.py", "Row.check", "local method"), ("other", "pkg/util.py", "helper", "local function"),
    }


def test_root_files(repo):
    stack = {(r.category, r.label) for r in A.technology_stack(repo).collect()}
    assert stack == {("backend", "FastAPI"), ("backend", "Express"), ("backend", "Node.js"), ("frontend", "React"), ("database", "PostgreSQL"), ("database", "Redis"), ("devops", "Docker"), ("devops", "GitHub Actions"), ("frontend", "Vite")}
    assert [r.hint.split("`")[1] for r in sorted(A.startup_hints(repo).collect(), key=lambda r: (r.place, r.hint))] == ["npm run dev", "npm run start", "pip install -r requirements.txt", "python manage.py runserver", "docker build -t <name> .", "docker compose up --build"]
    assert sorted(r.method for r in A.deployment_methods(repo).collect()) == ["Docker Compose", "Dockerfile", "GitHub Actions"]
    assert sorted(r.variable for r in A.environment_variables(repo).collect()) == ["API_TOKEN", "DB_HOST", "SECRET_X"]
    kinds = {(r.kind, r.file_path) for r in A.entrypoint_findings(repo).collect()}
    assert {("startup", "manage.py"), ("startup", "pkg/app.py"), ("application", "pkg/app.py"), ("application", "flask_app.py"), ("application", "web/server.js"), ("startup", "web/server.js"), ("configuration", "Dockerfile"), ("configuration", "package.json"), ("startup", "web/routes/index.js"), ("configuration", "docker-compose.yml")} == kinds


def test_reports(repo, files_of):
    r = report.reports(repo).first()
    assert r.markdown.count("\n# ") + 1 >= 12 and "`GET` `/api/v1/items/{id}` handler=`items` (pkg/app.py:11)" in r.markdown and "- `pkg/app.py:Row.save` -> `pkg/app.py:Row.check` via local method" in r.markdown
    empty = report.reports(files_of({"notes.txt": "x"})).first()
    assert "no dominant framework detected" in empty.overview and "No statically resolvable Python function calls were detected." in empty.markdown
    page = report.front_pages(repo).first().markdown
    assert page.startswith("# r\n\n## Project Overview") and "## Directory Structure" in page
    assert [report.route_of(t) for t in ("Make a README", "full analysis", "why?")] == ["readme", "report", "search"]
    assert report.reports(repo.limit(0)).count() == 0


def test_unique_files(spark, files_of):
    f = files_of([("r", "a", "x"), ("r", "a", "x"), ("r", "a", None), (None, "a", "x")]).withColumn("repository", F.lit(1))
    assert [(r.file_path, r.content) for r in unique_files(f).collect()] == [("a", "x")]
