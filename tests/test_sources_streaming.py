"""Chunkers, folders, archives, manifests, limits and streams."""

import ast
import base64
import html
import io
import json
import random
import zipfile
from collections import Counter
from datetime import datetime, timedelta

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lucerna.operators import chunkers as C
from lucerna.sources import trees as TR
from lucerna.streaming import limits as LM
from lucerna.streaming import reindex as RX


def test_python_chunks():
    text = "import x\n\n@deco\nclass A:\n    def m(self):\n        def inner(): pass\n        return 1\n\nasync def f():\n    pass\n"
    got = [(s, e, n, k, p) for s, e, n, k, p, _ in C.split_text(text, "python")]
    assert got == [(4, 7, "A", "class", ""), (5, 7, "m", "method", "A"), (6, 6, "inner", "function", ""), (9, 10, "f", "function", "")]
    assert [k for _, _, _, k, _, _ in C.split_text("def f(:\n", "python")] == ["text"] and C.split_text(" \n", "python") == [] and C.split_text(None, "go") == []


def test_declarations():
    js = "export const f = async (a) => {\n  if (a) {\n  }\n};\nclass B {\n}\nfunction g() {}\n"
    assert [(s, e, n, k) for s, e, n, k, _, _ in C.split_text(js, "javascript")] == [(1, 4, "f", "export"), (5, 6, "B", "class"), (7, 7, "g", "function")]
    go = "package a\ntype T struct {\n}\n\nfunc (s *S) F(a int) {\n}\n"  # a match may begin on the blank line before
    assert [(n, k) for _, _, n, k, _, _ in C.split_text(go, "go")] == [("struct", "class"), ("F", "function")]
    java = "public class A {\n  private static int f(int a) {\n  }\n}\n"
    assert [(n, k) for _, _, n, k, _, _ in C.split_text(java, "java")] == [("A", "class"), ("f", "method")]


def test_sections():
    md = "lost\n# One\na\n```\n# in fence\n```\n## Two\nb\n"
    assert [(s, e, n) for s, e, n, _, _, _ in C.split_text(md, "markdown")] == [(2, 4, "One"), (5, 6, "in fence"), (7, 8, "Two")]
    assert [k for _, _, _, k, _, _ in C.split_text("no heading", "markdown")] == ["text"]


@settings(max_examples=80, deadline=None)
@given(st.text(alphabet="ab \n", max_size=400), st.integers(5, 40), st.integers(0, 4))
def test_split_by_size(text, size, overlap):
    pieces = C.split_by_size(text, size, overlap)
    assert all(0 < len(p) <= size for p in pieces)
    at = 0
    for p in pieces:  # every piece comes from the text, in order
        at = text.find(p, max(0, at - size))
        assert at >= 0
    assert not Counter("".join(text.split())) - Counter("".join("".join(pieces).split()))  # and nothing is lost


def test_chunk_files(spark, files_of):
    long = "x = 1\n" * 2000
    got = C.chunk_files(files_of({"a.py": "def f():\n    pass\n", "b.txt": long, "c.md": "# T\n" + "word " * 1000, "d.py": None, "e.js": ""}).withColumn("language", F.lit("clash"))).collect()
    by = {p: sorted(r.chunk_index for r in got if r.file_path == p) for p in ("a.py", "b.txt", "c.md")}
    assert by["a.py"] == [0] and all(v == list(range(len(v))) for v in by.values()) and len(by["b.txt"]) > 8 and {r.file_path for r in got} == set(by)
    assert all(len(r.content) <= C.CHUNK_SIZE for r in got) and {r.symbol_type for r in got if r.file_path == "c.md"} == {"section"}


def test_read_tree(spark, tmp_path):
    for p, c in {"src/a.py": b"x = 1", "node_modules/b.js": b"x", "bin.py": b"\0\1", "blank.py": b" \n", "gbk.txt": "你好".encode("gb18030"), "big.txt": b"x" * 2000, "README.md": "\ufeffé".encode(), ".env": b"A=1", "noext": b"x"}.items():
        (tmp_path / p).parent.mkdir(exist_ok=True)
        (tmp_path / p).write_bytes(c)
    got = {r.file_path: (r.content, r.ord) for r in TR.read_tree(spark, str(tmp_path), "r", max_file_bytes=1000).collect()}
    assert got == {"README.md": ("\ufeffé", 1), "gbk.txt": ("你好", 2), "src/a.py": ("x = 1", 3)}
    listed = TR.scan_tree(spark, str(tmp_path), "r")
    assert sorted(r.file_path for r in listed.collect()) == ["README.md", "big.txt", "bin.py", "blank.py", "gbk.txt", "src/a.py"]


def _zip(entries, **kw):
    b = io.BytesIO()
    with zipfile.ZipFile(b, "w", zipfile.ZIP_DEFLATED, **kw) as z:
        for n, c in entries:
            z.writestr(n, c)
    return b.getvalue()


def _docx():
    w = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'
    t = lambda x: f"<w:p><w:r><w:t>{x}</w:t></w:r></w:p>"
    return _zip([("word/document.xml", f"<w:document {w}><w:body>{t('Hello')}{t('')}<w:tbl><w:tr><w:tc>{t('a')}</w:tc><w:tc>{t('b')}</w:tc></w:tr></w:tbl></w:body></w:document>")])


def _xlsx():
    s = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
    return _zip([
        ("xl/workbook.xml", f'<workbook {s}><sheets><sheet name="One"/><sheet name="Empty"/></sheets></workbook>'), ("xl/sharedStrings.xml", f"<sst {s}><si><t>key</t></si></sst>"),
        ("xl/worksheets/sheet1.xml", f'<worksheet {s}><sheetData><row><c t="s"><v>0</v></c><c><v>5</v></c></row><row><c t="inlineStr"><is><t>x</t></is></c></row></sheetData></worksheet>'), ("xl/worksheets/sheet2.xml", f"<worksheet {s}><sheetData/></worksheet>"),
    ])


def test_office_texts():
    assert TR.docx_text(_docx()) == "Hello\na | b" and TR.xlsx_text(_xlsx()) == "# Sheet: One\nkey | 5\nx"
    assert TR.docx_text(b"junk") is None and TR.xlsx_text(_docx()) is None and TR.pdf_text(b"junk") is None
    assert TR.docx_text(_zip([("word/document.xml", "<a>" + " " * 3_000_000 + "</a>")])) is None  # compression ratio


def test_archives(spark):
    good = _zip([("src/a.py", "x = 1"), ("README.md", "# Hi"), (".env", "A=1"), ("inner.zip", _zip([("x", "y")])), ("doc.docx", _docx()), ("t.xlsx", _xlsx())])
    cases = {
        "good": (good, None), "traversal": (_zip([("../x.py", "1")]), "unsafe_entry_path"), "absolute": (_zip([("/x.py", "1")]), "unsafe_entry_path"), "device": (_zip([("a/CON.txt", "1")]), "unsafe_entry_path"), "twice": (_zip([("a.py", "1"), ("A.py", "2")]), "unsafe_entry_path"),
        "clash": (_zip([("a", "1"), ("a/b.py", "2")]), "unsafe_entry_path"), "deep": (_zip([("/".join("d" * 40), "1")]), "path_depth_exceeded"), "bomb": (_zip([("a.txt", "0" * 5_000_000)]), "compression_ratio_exceeded"), "junk": (b"junk", "invalid_zip"), "cut": (good[:-30], "invalid_zip"),
        "dot": (_zip([("a/ b./c", "1")]), "unsafe_entry_path"), "many": (_zip([(f"d{i}/", "") for i in range(2100)]), "directory_limit_exceeded"), "drive": (_zip([("C:x", "1")]), "unsafe_entry_path"),
    }
    a = spark.createDataFrame([(k, bytearray(v)) for k, (v, _) in cases.items()] + [("null", None)], "archive string, raw binary")
    got = {r.archive: r for r in TR.inspect_archives(TR.archive_entries(a)).collect()}
    assert {k: got[k].error for k in cases} == {k: e for k, (_, e) in cases.items()} and got["null"].error == "invalid_zip" and got["good"].files == 6 and got["good"].folders == 1
    files = TR.read_archives(a).collect()
    assert {r.file_path: r.content for r in files} == {"src/a.py": "x = 1", "README.md": "# Hi", "doc.docx": "Hello\na | b", "t.xlsx": "# Sheet: One\nkey | 5\nx"} and len({r.repository_id for r in files}) == 1


def test_preflight():
    plain = _zip([("a.py", "x = 1")])
    end = plain.rfind(b"PK\x05\x06")
    with_comment = lambda c: plain[: end + 20] + len(c).to_bytes(2, "little") + c
    patched = lambda at, value, size: plain[: end + at] + value.to_bytes(size, "little") + plain[end + at + size :]
    assert TR.preflight(plain) is None and TR.preflight(with_comment(b"hello")) is None
    assert TR.preflight(with_comment(b"say PK\x05\x06 and more text that is long enough")) is None  # a mark inside the comment
    assert TR.preflight(plain + b"x") == TR.preflight(b"") == TR.preflight(plain[:-1]) == TR.preflight(patched(4, 1, 2)) == TR.preflight(patched(8, 2, 2)) == "invalid_zip"
    assert TR.preflight(patched(16, 1, 4)) == "invalid_zip"  # a gap before the end record
    many = plain[: end + 8] + (7000).to_bytes(2, "little") * 2 + plain[end + 12 :]
    assert TR.preflight(many) == "file_limit_exceeded" and TR.preflight(patched(12, 6_000_000, 4)) == "central_directory_limit_exceeded"
    assert TR.preflight(plain[: end + 8] + b"\xff" * 4 + plain[end + 12 :]) == "invalid_zip"


def test_remote_files(spark):
    tree = {"tree": [{"type": "blob", "path": p, "size": 5, "sha": s} for p, s in (("a.py", "1"), ("b.py", "2"), ("c.py", "3"), ("d.py", "4"), ("e.py", "5"))]}
    listings = spark.createDataFrame([("r", json.dumps(tree)), ("cut", json.dumps(tree | {"truncated": True})), ("bad", "{"), ("none", None)], "repository_id string, json string")
    assert {(r.repository_id, r.error) for r in TR.remote_problems(listings).collect()} == {("cut", "truncated"), ("bad", "invalid"), ("none", "invalid")}
    b64 = lambda raw: json.dumps({"content": base64.encodebytes(raw).decode(), "encoding": "base64"})
    blobs = [("r", "1", b64("x = 'é'".encode() * 30)), ("r", "1", b64("x = 'é'".encode() * 30)), ("r", "2", json.dumps({"content": "x", "encoding": "utf-8"})), ("r", "3", b64(b"\0\1")), ("r", "4", json.dumps({"content": "***", "encoding": "base64"})), ("r", "9", b64(b"x")), ("q", "5", b64(b"x"))]
    got = TR.remote_files(TR.remote_tree(listings), spark.createDataFrame(blobs, "repository_id string, sha string, json string")).collect()
    assert [(r.repository_id, r.file_path, r.content, r.ord) for r in got] == [("r", "a.py", "x = 'é'" * 30, 1)]


@pytest.mark.parametrize(("name", "want"), [("a%20b.zip", "a b.zip"), ("x.ZIP", "x.ZIP"), ("..%2Fx.zip", None), (".zip", None), ("a.tar", None), ("a%00.zip", None), ("%FF.zip", None), ("a:b.zip", None), ("a+b.zip", "a+b.zip"), ("e%CC%81.zip", "\u00e9.zip"), ("", None), (None, None)])
def test_archive_names(spark, name, want):
    assert spark.createDataFrame([(name,)], "n string").select(TR.archive_name(F.col("n")).alias("x")).first().x == want


def test_remote(spark, tmp_path):
    tree = {"tree": [{"type": "blob", "path": p, "size": s, "sha": "1"} for p, s in (("b.py", 5), ("a.py", 9), (".env", 1), ("huge.py", 9 << 20))] + [{"type": "tree", "path": "d", "size": None, "sha": "2"}], "truncated": False}
    j = spark.createDataFrame([("r", json.dumps(tree)), ("cut", json.dumps(tree | {"truncated": True})), ("bad", "{"), ("null", None)], "repository_id string, json string")
    assert [(r.repository_id, r.file_path, r.ord) for r in TR.remote_tree(j).orderBy("ord").collect()] == [("r", "a.py", 1), ("r", "b.py", 2)]
    pages = spark.createDataFrame([("p", '<a href="/o/n/blob/main/src/a%20b.py">x</a><a href="/o/n/tree/main/docs">d</a><a href="/o/other/blob/main/x">y</a>')], "page string, html string")
    assert {(r.kind, r.path) for r in TR.page_links(pages, "o", "n").collect()} == {("blob", "src/a b.py"), ("tree", "docs")}
    items = {"payload": {"codeViewRepoRoute": {"tree": {"items": [{"path": "src/x&y.py", "contentType": "file"}, {"path": "/docs/", "contentType": "directory"}, {"path": "m", "contentType": "submodule"}, {"path": None, "contentType": "file"}]}}}}
    embedded = f'<script type="application/json" data-target="react-app.embeddedData">{html.escape(json.dumps(items))}</script>'
    pages = spark.createDataFrame([("p", embedded + '<a href="/o/n/blob/main/a&amp;b.py">x</a>'), ("q", '<script data-target="react-app.embeddedData">{</script>'), ("n", None)], "page string, html string")
    assert {(r.page, r.kind, r.path) for r in TR.page_links(pages, "o", "n").collect()} == {("p", "blob", "src/x&y.py"), ("p", "tree", "docs"), ("p", "blob", "a&b.py")}
    (tmp_path / "a.json").write_text('{"repository_id": "r", "chunk_count": 3}')
    (tmp_path / "b.json").write_text('{"repository_id": ')
    assert [r.repository_id for r in TR.read_manifests(spark, str(tmp_path), "repository_id string, chunk_count int").collect()] == ["r"]


def test_limits(spark):
    rng = random.Random(1)
    start = datetime(2025, 1, 1)
    rows = [(i, rng.choice("abc"), start + timedelta(seconds=rng.choice([rng.randrange(40), 500 + rng.randrange(30), 60, 61]))) for i in range(90)] + [(500, None, start), (501, "a", None)]
    df = spark.createDataFrame(rows, "id bigint, who string, at timestamp")
    want = {}
    for k in "abc":
        passed = []
        for i, _, t in sorted([r for r in rows if r[1] == k and r[2]], key=lambda r: (r[2], r[0])):
            passed = [p for p in passed if p >= t - timedelta(seconds=60)]
            want[i] = len(passed) < 5
            if want[i]:
                passed.append(t)
    assert {r.id: r.allowed for r in LM.limited_requests(df, "who", "at", "id", 5, 60).collect()} == want and False in want.values()


def test_limit_stream(spark, tmp_path):
    start = datetime(2025, 1, 1)
    for n in range(2):
        spark.createDataFrame([("a", start + timedelta(seconds=10 * n + i), 10 * n + i) for i in range(4)], "who string, at timestamp, id bigint").coalesce(1).write.parquet(str(tmp_path / f"in/{n}"))
    s = spark.readStream.schema("who string, at timestamp, id bigint").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in/*"))
    q = LM.limit_stream(s, 5, 60).writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination()
    assert {r.id: r.allowed for r in spark.read.parquet(str(tmp_path / "out")).collect()} == {0: True, 1: True, 2: True, 3: True, 10: True, 11: False, 12: False, 13: False}


def test_reindex_stream(spark, files_of, tmp_path):
    src, index, cp = (str(tmp_path / x) for x in ("src", "index", "cp"))
    files_of([("r", "a.py", "def f(): pass\n"), ("r", "b.txt", "gone"), ("q", "c.txt", "stays"), ("007", "e.txt", "empty soon")]).write.parquet(src)
    RX.reindex_stream(spark, src, index, cp).awaitTermination()
    untouched = {p: p.stat().st_mtime_ns for p in (tmp_path / "index" / "repository_id=q").glob("*.parquet")}
    files_of([("r", "a.py", "def g(): pass\n"), ("r", "d.txt", "new"), ("007", "e.txt", " "), (None, "f.txt", "x")]).write.mode("append").parquet(src)
    RX.reindex_stream(spark, src, index, cp).awaitTermination()
    read = lambda: sorted((x.repository_id, x.file_path, x.symbol_name) for x in spark.read.schema(C.SCHEMA).parquet(index).collect())
    assert read() == [("q", "c.txt", ""), ("r", "a.py", "g"), ("r", "d.txt", "")]
    assert untouched and all(p.stat().st_mtime_ns == t for p, t in untouched.items())
    again = files_of([("r", "a.py", "def g(): pass\n"), ("r", "d.txt", "new")])
    assert {r.change for r in RX.update_index(spark, again, index).collect()} == {"unchanged"} and len(read()) == 3
    assert RX.update_index(spark, again.limit(0), index).count() == 0 and len(read()) == 3


def test_audit_stream(spark, tmp_path):
    rows = [("login", "success", "1.2.3.4", None), ("import", "failure", None, "r-1"), ("other", "success", "x", "r"), ("delete", "success", "y", "bad id!")]
    spark.createDataFrame(rows, "event string, outcome string, client string, repository_id string").write.parquet(str(tmp_path / "in"))
    s = spark.readStream.schema("event string, outcome string, client string, repository_id string").parquet(str(tmp_path / "in"))
    RX.audit_stream(s, str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()
    got = {r.event: r for r in spark.read.json(str(tmp_path / "out")).collect()}
    assert set(got) == {"login", "import", "delete"} and len(got["login"].actor_id) == 16 and got["import"].repository_fingerprint and got["delete"].repository_fingerprint is None


def test_chunk_helper_never_runs_code():
    assert all(isinstance(n, ast.AST) for n in [ast.parse("raise SystemExit")]) and C.split_text("raise SystemExit", "python")[0][3] == "text"
