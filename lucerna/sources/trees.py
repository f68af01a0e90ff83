"""Files of a folder, of archives and of remote listings as DataFrames."""

from __future__ import annotations

import html
import io
import re
import stat
import struct
import unicodedata
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.filters import included
from ..functions.languages import extension
from ..operators.stats import folders
from .store import numbered

# Encodings that are tried in this order; limits of single files and of office containers.
ENCODINGS = ["utf-8", "utf-8-sig", "gb18030", "cp936", "cp1252", "latin-1"]
MAX_FILE_BYTES = 1_000_000
OFFICE_FILES, OFFICE_BYTES, OFFICE_RATIO, OFFICE_ROWS, OFFICE_CELLS, OFFICE_SHEETS, OFFICE_CHARS = 2000, 50 << 20, 100, 100_000, 1_000_000, 100, 5_000_000


def is_binary(raw: bytes) -> bool:
    """A NUL anywhere, or more than 18 % control bytes in the first 4,096."""
    head = raw[:4096]
    return b"\0" in raw or bool(head) and sum(x < 9 or 14 <= x < 32 for x in head) / len(head) > 0.18


def decode(raw: bytes | None) -> str | None:
    """Text of a file in the first encoding that fits; None for binary or blank content."""
    if raw is None or is_binary(raw):
        return None
    for e in ENCODINGS:
        try:
            text = raw.decode(e)
        except UnicodeDecodeError:
            continue
        return text if text.strip() else None
    return None


def _container_ok(z: zipfile.ZipFile) -> bool:
    entries = z.infolist()
    files = [e for e in entries if not e.is_dir()]
    total, packed = sum(e.file_size for e in files), sum(e.compress_size for e in files)
    bad = any(e.flag_bits & 0x2061 or e.compress_type not in (zipfile.ZIP_STORED, zipfile.ZIP_DEFLATED) for e in entries)
    tight = any(e.file_size and (e.compress_size <= 0 or e.file_size / e.compress_size > OFFICE_RATIO) for e in files)
    return len(entries) <= OFFICE_FILES and not bad and total <= OFFICE_BYTES and not tight and (not total or packed > 0 and total / packed <= OFFICE_RATIO)


_W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
_S = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"


def docx_text(raw: bytes) -> str | None:
    """Paragraphs, then table rows with ' | ' between cells; None if the container is damaged or beyond a limit."""
    try:
        with zipfile.ZipFile(io.BytesIO(raw)) as z:
            if not _container_ok(z):
                return None
            body = ElementTree.fromstring(z.read("word/document.xml")).find(f"{_W}body")
    except (zipfile.BadZipFile, KeyError, ElementTree.ParseError, RuntimeError, OSError):
        return None
    if body is None:
        return None
    text = lambda e: "".join(t.text or "" for t in e.iter(f"{_W}t")).strip()
    out = [t for p in body.findall(f"{_W}p") if (t := text(p))]
    for row in body.iter(f"{_W}tr"):
        if cells := [t for c in row.findall(f"{_W}tc") if (t := text(c))]:
            out.append(" | ".join(cells))
    joined = "\n".join(out).strip()
    return joined if joined and len(joined) <= OFFICE_CHARS else None


def xlsx_text(raw: bytes) -> str | None:
    """'# Sheet: name' and rows with ' | ' between cells for each sheet that has values; None beyond a limit."""
    try:
        with zipfile.ZipFile(io.BytesIO(raw)) as z:
            if not _container_ok(z):
                return None
            names = set(z.namelist())
            shared = []
            if "xl/sharedStrings.xml" in names:
                shared = ["".join(t.text or "" for t in si.iter(f"{_S}t")) for si in ElementTree.fromstring(z.read("xl/sharedStrings.xml")).findall(f"{_S}si")]
            titles = [s.get("name", "") for s in ElementTree.fromstring(z.read("xl/workbook.xml")).iter(f"{_S}sheet")]
            if len(titles) > OFFICE_SHEETS:
                return None
            sections, rows, cells = [], 0, 0
            for i, title in enumerate(titles, 1):
                if f"xl/worksheets/sheet{i}.xml" not in names:
                    continue
                lines = []
                for row in ElementTree.fromstring(z.read(f"xl/worksheets/sheet{i}.xml")).iter(f"{_S}row"):
                    rows += 1
                    values = []
                    for c in row.findall(f"{_S}c"):
                        cells += 1
                        v = c.find(f"{_S}v")
                        s = "".join(t.text or "" for t in c.iter(f"{_S}t")) if c.get("t") == "inlineStr" else (v.text or "") if v is not None else ""
                        s = shared[int(s)] if c.get("t") == "s" and s.isdigit() and int(s) < len(shared) else s
                        if s.strip():
                            values.append(s.strip())
                    if rows > OFFICE_ROWS or cells > OFFICE_CELLS:
                        return None
                    if values:
                        lines.append(" | ".join(values))
                if lines:
                    sections.append("\n".join([f"# Sheet: {title}", *lines]))
    except (zipfile.BadZipFile, KeyError, ElementTree.ParseError, RuntimeError, OSError, ValueError):
        return None
    joined = "\n\n".join(sections).strip()
    return joined if joined and len(joined) <= OFFICE_CHARS else None


def pdf_text(raw: bytes) -> str | None:
    """Pages with a blank line between; None without a PDF library, or beyond 500 pages or five million characters."""
    try:
        from pypdf import PdfReader
    except ImportError:
        return None
    try:
        pages = PdfReader(io.BytesIO(raw)).pages
        joined = "\n\n".join(t for p in pages if (t := (p.extract_text() or "").strip())) if len(pages) <= 500 else ""
    except Exception:  # noqa: BLE001 - a damaged file has no text
        return None
    return joined if joined and len(joined) <= OFFICE_CHARS else None


_READERS = {".pdf": pdf_text, ".docx": docx_text, ".xlsx": xlsx_text}


def text_of(raw: Column, path: Column) -> Column:
    """Text of a file's bytes by its suffix; null for what has no text."""

    @F.pandas_udf(T.StringType())
    def run(raws: pd.Series, suffixes: pd.Series) -> pd.Series:
        return pd.Series([None if r is None else _READERS.get(s, decode)(r) for r, s in zip(raws, suffixes, strict=True)])

    return run(raw, extension(path))


def relative_path(path: Column, root: str) -> Column:
    """Path below root; null outside of it or with a '..' part."""
    base = re.sub(r"^file:/*", "/", root).rstrip("/")
    plain = F.regexp_replace(path, r"^file:/*", "/")
    below = F.when(plain.startswith(base + "/"), F.substr(plain, F.lit(len(base) + 2)))
    return F.when(~F.array_contains(F.split(below, "/"), ".."), below)


def scan_tree(spark: SparkSession, root: str, repository_id: str) -> DataFrame:
    """Files below a folder that are read, with size and time but without contents: only the listing is touched."""
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    f = raw.select(relative_path(F.col("path"), root).alias("file_path"), F.col("length").alias("size_bytes"), "modificationTime")
    return f.where(F.col("file_path").isNotNull() & included(F.col("file_path"))).withColumn("repository_id", F.lit(repository_id))


def read_tree(spark: SparkSession, root: str, repository_id: str, max_file_bytes: int = MAX_FILE_BYTES) -> DataFrame:
    """files(repository_id, file_path, content, size_bytes, ord) of a folder: ignored, large, binary and blank files are left out.

    The filter on length is pushed to the listing, so large files are never opened; ord follows the path, in ranges
    of paths, so that no task gets the whole folder.
    """
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root).where(F.col("length") <= max_file_bytes)
    f = raw.select(relative_path(F.col("path"), root).alias("file_path"), F.col("length").alias("size_bytes"), F.col("content").alias("raw"))
    f = f.where(F.col("file_path").isNotNull() & included(F.col("file_path")))
    t = f.select(F.lit(repository_id).alias("repository_id"), "file_path", text_of(F.col("raw"), F.col("file_path")).alias("content"), "size_bytes").where("content is not null")
    return numbered(t, ["file_path"], "ord").withColumn("ord", F.col("ord").cast("int"))


# -- archives -----------------------------------------------------------------

# Names that some systems keep for devices, and the limits of an archive.
DEVICES = ["CON", "PRN", "AUX", "NUL", *[f"COM{i}" for i in range(1, 10)], *[f"LPT{i}" for i in range(1, 10)]]
ARCHIVE_FILES, ARCHIVE_FOLDERS, ARCHIVE_BYTES, ARCHIVE_RATIO, ARCHIVE_DEPTH, ARCHIVE_PATH, DIRECTORY_BYTES = 5000, 1000, 80_000_000, 100, 24, 512, 5_000_000
ENTRY_SCHEMA = "archive string, name string, is_dir boolean, file_size bigint, compress_size bigint, flag_bits int, compress_type int, external_attr bigint, problem string"


_END = struct.Struct("<4s4H2LH")


def preflight(raw: bytes) -> str | None:
    """None if the end record of an archive is sound and whole, else the reason why it isn't.

    The end record is the last mark whose comment reaches exactly to the end of the file; marks inside a comment don't
    fit.  Nothing may lie between the central directory and it, and archives over several disks or of 64-bit sizes aren't read.
    """
    tail = max(0, len(raw) - _END.size - 0xFFFF)
    records = [(at, _END.unpack_from(raw, at)) for at in (tail + m.start() for m in re.finditer(b"PK\x05\x06", raw[tail:])) if at + _END.size <= len(raw)]
    whole = [(at, r) for at, r in records if at + _END.size + r[7] == len(raw)]
    if not whole:
        return "invalid_zip"
    at, (_, disk, first_disk, here, total, size, offset, _) = whole[-1]
    if (disk, first_disk) != (0, 0) or here != total or total == 0xFFFF or 0xFFFFFFFF in (size, offset):
        return "invalid_zip"
    if total > ARCHIVE_FILES + ARCHIVE_FOLDERS:
        return "file_limit_exceeded"
    if size > DIRECTORY_BYTES:
        return "central_directory_limit_exceeded"
    return None if offset + size == at else "invalid_zip"


def archive_entries(archives: DataFrame) -> DataFrame:
    """One row an entry of archives(archive string, raw binary); an unreadable archive gives one row with a null name and its problem."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        cols = [x.split()[0] for x in ENTRY_SCHEMA.split(", ")]
        for b in batches:
            rows = []
            for name, raw in zip(b["archive"], b["raw"], strict=True):
                problem = "invalid_zip" if raw is None else preflight(bytes(raw))
                if problem:
                    rows.append((name, *[None] * 7, problem))
                    continue
                try:
                    with zipfile.ZipFile(io.BytesIO(raw)) as z:
                        rows += [(name, unicodedata.normalize("NFC", e.orig_filename), e.is_dir(), e.file_size, e.compress_size, e.flag_bits, e.compress_type, e.external_attr, None) for e in z.infolist()]
                except (zipfile.BadZipFile, zipfile.LargeZipFile, RuntimeError, OSError):
                    rows.append((name, *[None] * 7, "invalid_zip"))
            yield pd.DataFrame(rows, columns=cols).astype({"file_size": "Int64", "compress_size": "Int64", "flag_bits": "Int32", "compress_type": "Int32", "external_attr": "Int64", "is_dir": "boolean"})

    return archives.select("archive", "raw").mapInPandas(run, ENTRY_SCHEMA)


def entry_error(name: Column, is_dir: Column, flags: Column, method: Column, attributes: Column) -> Column:
    """Why an entry may not be read: the first rule it breaks, or null."""
    folder = is_dir | name.endswith("/")
    path = F.when(folder, F.regexp_replace(name, "/$", "")).otherwise(name)
    parts = F.split(path, "/")
    bad_part = F.exists(
        parts,
        lambda p: (p == "") | (F.length(p) > 255) | p.isin(".", "..") | p.rlike(r"[\x00-\x1f\x7f<>\"|?*:]|\p{Cf}") | p.rlike(r"[ .]$") | F.upper(F.substring_index(p, ".", 1)).isin(*DEVICES),
    )
    kind = F.shiftright(attributes, 28).bitwiseAND(F.lit(15))
    out = F.when(name.isNull(), "invalid_zip").when((name == "") | name.rlike(r"[\x00\\]|^/|^[A-Za-z]:"), "unsafe_entry_path").when(F.length(path) > ARCHIVE_PATH, "path_length_exceeded")
    out = out.when(bad_part, "unsafe_entry_path").when(F.size(parts) > ARCHIVE_DEPTH, "path_depth_exceeded").when(flags.bitwiseAND(F.lit(0x2041)) != 0, "encrypted_archive")
    out = out.when((flags.bitwiseAND(F.lit(0x20)) != 0) | ~method.isin(zipfile.ZIP_STORED, zipfile.ZIP_DEFLATED), "unsupported_compression")
    return out.when(~kind.isin(0, F.when(folder, stat.S_IFDIR >> 12).otherwise(stat.S_IFREG >> 12)), "special_file")


def inspect_archives(entries: DataFrame) -> DataFrame:
    """(archive, files, folders, bytes, packed_bytes, error): counts and the first reason an archive is refused, or null.

    Names that differ in case only, and files that are folders elsewhere, are found by grouping the entries'
    lower-case paths with the folders above them.
    """
    e = entries.withColumn("error", F.coalesce("problem", entry_error(F.col("name"), F.col("is_dir"), F.col("flag_bits"), F.col("compress_type"), F.col("external_attr"))))
    e = e.withColumn("folder", F.col("is_dir") | F.col("name").endswith("/")).withColumn("path", F.lower(F.regexp_replace("name", "/$", "")))
    above = e.where("path is not null").select("archive", F.explode(folders(F.col("path"))).alias("path"), F.lit(False).alias("entry"), F.lit(True).alias("folder"))
    paths = e.where("path is not null").select("archive", "path", F.lit(True).alias("entry"), "folder").unionByName(above)
    flag = lambda c: F.col(c).cast("int")
    per = paths.groupBy("archive", "path").agg(F.sum(flag("entry")).alias("entries"), F.max(flag("folder")).alias("as_folder"), F.max((flag("entry") == 1).cast("int") * (1 - flag("folder"))).alias("as_file"))
    clash = per.groupBy("archive").agg(F.max(((F.col("entries") > 1) | (F.col("as_folder") + F.col("as_file") > 1)).cast("int")).alias("clash"), F.sum("as_folder").alias("folders"))
    size = e.groupBy("archive").agg(
        F.sum((~F.col("folder")).cast("bigint")).alias("files"), F.sum(F.when(~F.col("folder"), F.col("file_size"))).alias("bytes"), F.sum(F.when(~F.col("folder"), F.col("compress_size"))).alias("packed_bytes"),
        F.min("error").alias("entry_error"), F.max(((F.col("file_size") > 0) & ~F.col("folder") & ((F.col("compress_size") <= 0) | (F.col("file_size") > F.col("compress_size") * ARCHIVE_RATIO))).cast("int")).alias("tight"),
    )
    j = size.join(clash, "archive", "left")
    error = F.when(F.col("entry_error").isNotNull(), F.col("entry_error")).when(F.col("clash") == 1, "unsafe_entry_path").when(F.col("files") > ARCHIVE_FILES, "file_limit_exceeded")
    error = error.when(F.col("bytes") > ARCHIVE_BYTES, "uncompressed_limit_exceeded").when((F.col("tight") == 1) | (F.col("bytes") > F.col("packed_bytes") * ARCHIVE_RATIO), "compression_ratio_exceeded")
    error = error.when(F.col("folders") > ARCHIVE_FOLDERS, "directory_limit_exceeded")
    return j.select("archive", F.coalesce("files", F.lit(0)).alias("files"), F.coalesce("folders", F.lit(0)).alias("folders"), F.coalesce("bytes", F.lit(0)).alias("bytes"), F.coalesce("packed_bytes", F.lit(0)).alias("packed_bytes"), error.alias("error"))


def composed(text: Column) -> Column:
    """A text with its characters composed (NFC); null stays null."""

    @F.pandas_udf(T.StringType())
    def run(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: None if t is None else unicodedata.normalize("NFC", t))

    return run(text)


def archive_name(encoded: Column) -> Column:
    """Decoded name of an upload, or null if it isn't a plain .zip name."""
    name = composed(F.trim(F.try_url_decode(F.regexp_replace(encoded, r"\+", "%2B"))))
    bad = (F.length(name) > 180) | name.rlike(r"[/\\:\x00-\x1f\x7f]|\p{Cf}|�") | ~F.lower(name).endswith(".zip") | (F.regexp_replace(F.substr(name, F.lit(1), F.greatest(F.length(name) - 4, F.lit(0))), r"[ .]", "") == "")
    return F.when((name != "") & ~bad, name)


def archive_repository_id(name: Column, raw: Column) -> Column:
    """Readable part of an archive's name and the first twelve digits of its SHA-256."""
    stem = F.lower(F.regexp_replace(F.regexp_replace(F.regexp_replace(name, r"(?i)\.zip$", ""), r"[^A-Za-z0-9_-]+", "-"), r"^-+|-+$", ""))
    short = F.regexp_replace(F.substring(stem, 1, 96), r"-+$", "")
    return F.concat(F.when(short == "", "archive").otherwise(short), F.lit("-"), F.substring(F.sha2(raw, 256), 1, 12))


def read_archives(archives: DataFrame) -> DataFrame:
    """files of the archives that pass inspection; archives(archive, raw). The repository's id comes from name and digest."""
    good = inspect_archives(archive_entries(archives)).where("error is null").select("archive")
    named = archives.join(good, "archive", "left_semi").select(archive_repository_id(F.col("archive"), F.col("raw")).alias("repository_id"), "raw")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for repo, raw in zip(b["repository_id"], b["raw"], strict=True):
                with zipfile.ZipFile(io.BytesIO(raw)) as z:
                    rows = [(repo, e.filename, z.read(e), e.file_size) for e in z.infolist() if not e.is_dir() and e.file_size <= MAX_FILE_BYTES]
                yield pd.DataFrame(rows, columns=["repository_id", "file_path", "raw", "size_bytes"])

    f = named.mapInPandas(run, "repository_id string, file_path string, raw binary, size_bytes bigint").where(included(F.col("file_path")))
    t = f.select("repository_id", "file_path", text_of(F.col("raw"), F.col("file_path")).alias("content"), "size_bytes").where("content is not null")
    return t.withColumn("ord", F.row_number().over(Window.partitionBy("repository_id").orderBy("file_path")))


# -- remote listings and manifests --------------------------------------------


_LISTING = "tree array<struct<type:string,path:string,size:bigint,sha:string>>, truncated boolean"


def remote_problems(listings: DataFrame) -> DataFrame:
    """(repository_id, error) of the listings(repository_id, json) that can't be used: 'truncated' by the sender, or 'invalid'."""
    j = F.from_json("json", _LISTING)
    error = F.when(j["truncated"], "truncated").when(j["tree"].isNull(), "invalid")
    return listings.select("repository_id", error.alias("error")).where("error is not null")


def remote_tree(listings: DataFrame) -> DataFrame:
    """(repository_id, file_path, size_bytes, sha) of the blobs in listings(repository_id, json) that are read, in path order by ord.

    Listings that remote_problems() names give no rows. A listing is one answer of a server, which bounds a repository's rows.
    """
    t = listings.select("repository_id", F.from_json("json", _LISTING).alias("j")).where(~F.coalesce(F.col("j.truncated"), F.lit(False)))
    b = t.select("repository_id", F.explode("j.tree").alias("e")).where("e.type = 'blob'").select("repository_id", F.col("e.path").alias("file_path"), F.col("e.size").alias("size_bytes"), F.col("e.sha").alias("sha"))
    b = b.where(included(F.col("file_path")) & F.col("size_bytes").between(1, MAX_FILE_BYTES))
    return b.withColumn("ord", F.row_number().over(Window.partitionBy("repository_id").orderBy("file_path")))


def remote_files(tree: DataFrame, blobs: DataFrame) -> DataFrame:
    """files(repository_id, file_path, content, size_bytes, ord) of a remote_tree() and the answers blobs(repository_id, sha, json) for its blobs.

    An answer holds base64 text in lines; answers in another encoding, that don't decode, that are larger than
    a file may be, or hold binary or blank content leave their file out. Of several answers for a blob the greatest counts.
    """
    got = F.from_json("json", "content string, encoding string")
    raw = F.try_to_binary(F.regexp_replace(got["content"], r"\s", ""), F.lit("base64"))
    b = blobs.where(got["encoding"] == "base64").select("repository_id", "sha", raw.alias("raw")).where(F.octet_length("raw") <= MAX_FILE_BYTES)
    b = b.groupBy("repository_id", "sha").agg(F.max("raw").alias("raw"))
    t = tree.join(b, ["repository_id", "sha"])
    return t.select("repository_id", "file_path", text_of(F.col("raw"), F.col("file_path")).alias("content"), "size_bytes", "ord").where("content is not null")


def unescaped(text: Column) -> Column:
    """Character references of a text resolved; null stays null."""

    @F.pandas_udf(T.StringType())
    def run(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: None if t is None else html.unescape(t))

    return run(text)


_EMBEDDED = "payload struct<codeViewRepoRoute:struct<tree:struct<items:array<struct<path:string,contentType:string>>>>>"


def page_links(pages: DataFrame, owner: str, name: str) -> DataFrame:
    """(page, kind, path) of the files ('blob') and folders ('tree') of a repository in pages(page, html).

    Entries come from the data embedded in a page and from its links; data that doesn't parse has none.
    """
    pattern = rf"href=\"/{re.escape(owner)}/{re.escape(name)}/(blob|tree)/[^/\"]+/([^\"#?]+)"
    hits = F.arrays_zip(F.regexp_extract_all("html", F.lit(pattern), F.lit(1)).alias("kind"), F.regexp_extract_all("html", F.lit(pattern), F.lit(2)).alias("path"))
    links = pages.select("page", F.explode(hits).alias("h")).select("page", "h.kind", F.try_url_decode(F.regexp_replace(unescaped(F.col("h.path")), r"\+", "%2B")).alias("path"))
    data = F.nullif(F.regexp_extract("html", r"(?s)<script[^>]+data-target=\"react-app\.embeddedData\"[^>]*>(.*?)</script>", 1), F.lit(""))
    items = F.from_json(unescaped(data), _EMBEDDED)["payload"]["codeViewRepoRoute"]["tree"]["items"]
    kind = F.when(F.col("e.contentType") == "directory", "tree").when(F.col("e.contentType") == "file", "blob")
    inside = pages.select("page", F.explode(items).alias("e")).select("page", kind.alias("kind"), F.regexp_replace("e.path", "^/+|/+$", "").alias("path"))
    return links.unionByName(inside).where("kind is not null and path is not null").distinct()


def read_manifests(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """JSON manifests of a folder, one a file; those that don't parse are left out."""
    raw = spark.read.option("multiLine", "true").option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_corrupt").schema(f"{schema}, _corrupt string").json(path)
    return raw.where("_corrupt is null").drop("_corrupt")


def write_manifests(manifest: DataFrame, path: str) -> None:
    """A table of manifests as JSON, replacing what is there."""
    manifest.write.mode("overwrite").json(path)
