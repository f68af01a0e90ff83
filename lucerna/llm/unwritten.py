"""Problem 5: generated, minified, vendored and data files among source code.

A multi-pattern automaton finds generation and vendoring notices in the comments at the
head and the end of a file; path rules know vendored folders, lock and checksum files,
generated and minified suffixes; the shape of the text tells minified code and bulk data.
Copies of third-party code that bear no mark are found because the same code lies in other
repositories too.  Files with the same set of shingles of five words are one class; MinHash
bands propose pairs of classes of different repositories, and a pair counts when the exact
Jaccard similarity of its sets is at least 0.8.  Each class is tried with two representatives
of its band groups first; a class that they don't confirm is tried with all other members,
so only groups of many files that are alike in bands but not in fact cost their square.

Null and blank contents are judged by their path alone; small files (package markers) are
never taken for copies; repeated rows count once.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from hashlib import blake2b
from functools import lru_cache

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..sources.store import written

HASHES, BANDS, MIN_SHINGLES, SIMILARITY = 64, 16, 40, 0.8
#: Of 64 hashes of sets alike to 0.8, fewer than 0.6 agree in about one pair of ten thousand.
LIKELY = 0.6

# Notices of generated files.
GENERATED_NOTICES = [
    "code generated by", "do not edit", "do not modify", "don't edit this file", "auto-generated file", "autogenerated file", "auto generated file", "auto-generated by", "autogenerated by",
    "auto generated by", "automatically generated", "@generated", "<auto-generated", "generated by", "generated from", "machine-made", "machine generated", "machine-generated",
    "emitted by", "end of generated", "generated file", "generated code", "file is generated", "file was generated", "自动生成", "changes will be lost", "edits are overwritten",
    "edits will be overwritten", "changes will be overwritten", "generated output", "output of the generator", "compiled from", "produced by",
]
# Notices of third-party copies.
VENDORED_NOTICES = ["upstream release", "upstream version", "vendored from", "vendored copy", "third-party code", "third party code", "bundled copy", "copied verbatim from", "imported from upstream"]
# Words that turn a notice into talk about one.
NEGATIONS = ["written by hand", "hand-written", "handwritten", "hand written", "replaces", "no longer", "not generated", "isn't generated", "used to be", "instead of", "edit freely", "please fill", "please replace", "stub", "docstring", "safe to edit", "may be edited", "was once", "formerly"]
_VENDOR_DIR = re.compile(
    r"(?i)(?:^|/)(?:vendor|_vendor|vendored|third[_-]?party|thirdparty|3rdparty|external|externals|extern|deps|node_modules|bower_components|jspm_packages|site-packages|Pods|Carthage|Godeps|submodules)/|(?:^|/)static/(?:lib|libs|vendor)/[^/]+/"
)
_GENERATED_PATH = re.compile(
    r"(?i)(?:^|/)(?:gen|generated|__generated__|_generated|autogen|auto_generated|codegen_out|generated[-_]src)/|(?:_pb2(?:_grpc)?\.pyi?|\.pb(?:\.gw)?\.(?:go|cc|h|c)|_pb\.(?:js|ts|d\.ts)|\.g\.(?:dart|cs|ts)|\.gen\.\w+|[._-]generated\.\w+|zz_generated[\w.]*|_parsetab\.py|parsetab\.py|\.designer\.cs|\.freezed\.dart|_gen\.go|lextab\.py)$"
)
_LOCK = re.compile(r"(?i)(?:^|/)(?:package-lock\.json|npm-shrinkwrap\.json|yarn\.lock|pnpm-lock\.ya?ml|bun\.lockb?|go\.sum|go\.work\.sum|cargo\.lock|poetry\.lock|pdm\.lock|uv\.lock|pipfile\.lock|composer\.lock|gemfile\.lock|podfile\.lock|mix\.lock|flake\.lock|pubspec\.lock|packages\.lock\.json|(?:sha\d+|md5)sums?(?:\.txt)?|checksums?\.txt)$|\.(?:sum|sha\d+|md5|map)$")
_MINIFIED = re.compile(r"(?i)[.-]min\.(?:js|css|mjs|cjs)$|\.(?:bundle|chunk|packed)\.(?:js|mjs|css)$|[.-][0-9a-f]{8,}(?:\.chunk|\.min)?\.(?:js|mjs|css)$")
_SCRIPTS = re.compile(r"(?i)\.(?:js|mjs|cjs|css|jsx|ts|html?)$")
_PROSE = re.compile(r"(?i)\.(?:md|mdx|rst|adoc|txt|json|ya?ml|toml|ini|cfg|conf|properties|csv|tsv)$")
_COMMENT = re.compile(r"^\s*(?:#|//|/\*|\*|--|<!--|;|%|\"\"\"|'''|<auto-generated)")
#: What may stand between the comments of a head.
_PREAMBLE = re.compile(r"^\s*(?:package\s+[\w.]+\s*;?|<\?\w*.*|[\"']use strict[\"'];?|syntax\s*=.*)\s*$")
_ONE_LINE = re.compile(r"\s*(?:/\*.*?\*/\s*)+(?:/[/*].*)?")
_ROW = re.compile(
    r"""(?x)^\s*(?:[\[({]?\s*(?:["'][^"']*["']|-?[\d.]+(?:e-?\d+)?[fL]?|0x[0-9a-fA-F]+|true|false|null|None)\s*[\])}]?\s*(?:[,:]\s*|(?=[\])}]*[,;]*\s*$)))+[\])}]*[,;]*\s*$
    |^\s*(?:INSERT\s+INTO\b.*\bVALUES\b.*|\(.*\)[,;])\s*$|^\s*["']?[A-Za-z0-9+/=]{40,}["']?,?\s*$|^\s*[0-9a-fA-F]{32,}\b.*$"""
)
_LITERAL = re.compile(r"\"(?:[^\"\\\n]|\\.)*\"|'(?:[^'\\\n]|\\.)*'|\b(?:0x[0-9a-fA-F]+|[\d.]+(?:e-?\d+)?)\b|[\s\[\](){},:;-]+")
_STRING = re.compile(r"\"(?:[^\"\\\n]|\\.)*\"|'(?:[^'\\\n]|\\.)*'|`[^`]*`|/(?![*/ ])(?:[^\n/\\\[]|\\.|\[[^\]\n]*\])+/[a-z]*")


@lru_cache(maxsize=1)
def _automaton() -> ahocorasick.Automaton:
    a = ahocorasick.Automaton()
    for kind, words in (("generated", GENERATED_NOTICES), ("vendored", VENDORED_NOTICES), ("negated", NEGATIONS)):
        for w in words:
            a.add_word(w, kind)
    a.make_automaton()
    return a


def _notice(text: str, path: str) -> str | None:
    """The notice in the leading comments, however long, in comments of the first ten lines or in those of the last three, or None."""
    text = text.lstrip("\ufeff")
    prose = bool(_PROSE.search(path)) and path.lower().endswith((".md", ".mdx", ".rst", ".adoc", ".txt", ".json"))
    at, number, inside, leading = 0, 0, "", True
    while at < len(text) and (leading or number < 10):
        end = text.find("\n", at)
        line = text[at : end if end >= 0 else len(text)]
        at, number = (end + 1 if end >= 0 else len(text)), number + 1
        why, inside, comment = _in_line(line, inside, prose)
        if why:
            return why
        leading = leading and (comment or not line.strip() or bool(_PREAMBLE.match(line)))
    inside = ""
    for line in text.rstrip().rsplit("\n", 3)[-3:] if at < len(text) else ():
        why, inside, _ = _in_line(line, inside, prose)
        if why:
            return why
    return None


def _in_line(line: str, inside: str, prose: bool) -> tuple[str | None, str, bool]:
    """The notice in the line's comment, what ends the comment that goes on behind it, and whether the line is one."""
    comment = line.lstrip().startswith("<!--") if prose else bool(inside) or bool(_COMMENT.match(line))
    said = line
    if inside:
        if inside in line:
            said, inside = line[: line.index(inside)], ""
    else:
        s = line.lstrip()
        if s.startswith("/*"):
            if "*/" not in s:
                inside = "*/"
            elif m := _ONE_LINE.match(line):
                said = m[0]
        elif s.startswith("<!--") and "-->" not in s:
            inside = "-->"
        elif s[:3] in ('"""', "'''") and s.count(s[:3]) == 1 and line[:1] not in " \t":
            inside = s[:3]
    if comment:
        kinds = {k for _, k in _automaton().iter(said.lower())}
        if kinds and "negated" not in kinds:
            return "vendored" if "vendored" in kinds else "generated", inside, comment
    return None, inside, comment


def _minified(text: str) -> bool:
    """Long dense lines that remain long without their strings, making up most of the text."""
    if len(text) < 400:
        return False
    long_ = 0
    for line in text.split("\n"):
        if len(line) >= 300:
            bare = _STRING.sub("", line)
            if len(bare) >= 0.4 * len(line) and sum(c.isspace() for c in bare) < 0.12 * len(bare) and len(re.findall(r"[{};,()=:]", bare)) > 0.1 * len(bare):
                long_ += len(line)
    return long_ >= 0.5 * len(text)


def _bulk(text: str) -> bool:
    """Whether nearly all of the text are rows of literals, or little is left without its literals."""
    if len(text) >= 600 and len(_LITERAL.sub("", text)) < 0.12 * len(text):
        return True
    lines = [x.rstrip("\r") for x in text.split("\n") if x.strip()]
    if len(lines) < 12 or len(text) < 600:
        return False
    rest = 0.15 * sum(map(len, lines))
    for x in lines:
        if not (_ROW.match(x) or len(x) > 4000 and x.count(",") > 50 and len(_LITERAL.sub("", x)) < 0.12 * len(x)):
            rest -= len(x)
            if rest < 0:
                return False
    return True


def reason(path: str, text: str | None) -> str | None:
    """Why a file isn't hand-written as far as the file itself tells: generated, vendored, lock, minified, data or None."""
    if _LOCK.search(path):
        return "lock"
    if _VENDOR_DIR.search(path):
        return "vendored"
    if _GENERATED_PATH.search(path):
        return "generated"
    if _MINIFIED.search(path):
        return "minified"
    if not text or not text.strip():
        return None
    if why := _notice(text, path):
        return why
    if _SCRIPTS.search(path) and _minified(text):
        return "minified"
    if not _PROSE.search(path) and _bulk(text):
        return "data"
    return None


_RNG = np.random.default_rng(20240607)
_A = _RNG.integers(1, 1 << 62, HASHES, dtype=np.uint64) | np.uint64(1)
_B = _RNG.integers(0, 1 << 62, HASHES, dtype=np.uint64)
_WORD = re.compile(r"\w+")


def shingles(text: str) -> np.ndarray | None:
    """Sorted hashes of the shingles of five words; None for texts with fewer than MIN_SHINGLES."""
    words = _WORD.findall(text)
    if len(words) < MIN_SHINGLES + 4:
        return None
    h = np.fromiter((zlib.crc32(w.encode()) for w in words), np.uint64, len(words))
    s = h[:-4]
    for k in range(1, 5):
        s = s * np.uint64(0x9E3779B97F4A7C15) + h[k : len(h) - 4 + k]
    s = np.unique(s ^ (s >> np.uint64(29)))
    return s if len(s) >= MIN_SHINGLES else None


def _whole(s: np.ndarray) -> int:
    return int.from_bytes(blake2b(s.tobytes(), digest_size=8).digest(), "little", signed=True)


def signature(s: np.ndarray) -> np.ndarray:
    """MinHash signature of a set of shingles, 16 bits a hash."""
    out = np.full(HASHES, np.uint64(0xFFFFFFFFFFFFFFFF))
    for a in range(0, len(s), 4096):  # long texts in blocks
        block = s[a : a + 4096, None] * _A + _B
        block ^= block >> np.uint64(31)
        out = np.minimum(out, block.min(axis=0))
    return (out >> np.uint64(16)).astype(np.uint16)  # of a least hash the high bits are nearly all 0


def _judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        whys, sigs, wholes = [], [], []
        for path, text in zip(b.column("file_path").to_pylist(), b.column("content").to_pylist(), strict=True):
            why = reason(path, text) if path is not None else None
            s = shingles(text) if text and path is not None and why in (None, "vendored") and not _PROSE.search(path) else None
            wholes.append(None if s is None else _whole(s))
            whys.append(why)
            sigs.append(None if s is None else signature(s).tobytes())
        yield pa.RecordBatch.from_arrays([b.column("repository_id"), b.column("file_path"), pa.array(whys, pa.string()), pa.array(sigs, pa.binary()), pa.array(wholes, pa.int64())], ["repository_id", "file_path", "reason", "sig", "whole"])


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        texts = b.column("content")
        for a in range(0, len(texts), 256):
            sets = [s for t in texts.slice(a, 256).to_pylist() if t and (s := shingles(t)) is not None]
            short = [np.unique(s.astype(np.uint32)).view(np.int32) for s in sets]
            yield pa.RecordBatch.from_arrays([pa.array([_whole(s) for s in sets], pa.int64()), pa.array(short, pa.list_(pa.int32()))], ["whole", "shingles"])


def _bands(sig: Column) -> Column:
    """The keys of a signature's bands."""
    size = 2 * HASHES // BANDS
    return F.array(*[F.xxhash64(F.substring(sig, i * size + 1, size), F.lit(i)) for i in range(BANDS)])


@F.pandas_udf(T.DoubleType())
def _similarity(a, b):
    import pandas as pd

    return pd.Series([float(np.mean(np.frombuffer(x, np.uint16) == np.frombuffer(y, np.uint16))) for x, y in zip(a, b, strict=True)])


def _likely(classes: DataFrame, links: DataFrame) -> DataFrame:
    """The links (whole, other) with the likeness of their signatures; those far below the threshold are left out."""
    sigs = classes.select("whole", "sig")
    both = links.join(sigs, "whole").join(sigs.select(F.col("whole").alias("other"), F.col("sig").alias("other_sig")), "other")
    return both.select("whole", "other", _similarity("sig", "other_sig").alias("likeness")).where(F.col("likeness") >= LIKELY)


def _alike(files: DataFrame, classes: DataFrame, links: DataFrame) -> DataFrame:
    """Distinct whole of the links (whole, other) whose sets are alike; the texts of one file a class are read for it."""
    # written, so that its size is known before the texts are read: they aren't shuffled to meet a small table
    wanted = written(classes.join(links.select(F.explode(F.array("whole", "other")).alias("whole")).distinct(), "whole", "left_semi").select("id"))
    texts = files.withColumn("id", F.xxhash64("repository_id", "file_path")).join(wanted, "id", "left_semi").select("content")
    sets = texts.mapInArrow(_sets, "whole bigint, shingles array<int>")
    pairs = links.join(sets, "whole").join(sets.select(F.col("whole").alias("other"), F.col("shingles").alias("other_shingles")), "other")
    both = F.size(F.array_intersect("shingles", "other_shingles"))
    return pairs.where(both / (F.size("shingles") + F.size("other_shingles") - both) >= SIMILARITY).select("whole").distinct()


def judged_files(files: DataFrame) -> DataFrame:
    """(repository_id, file_path, reason) of the files that nobody on the team wrote; the reason 'copy' comes from other repositories."""
    base = files.select("repository_id", "file_path", "content").mapInArrow(_judge, "repository_id string, file_path string, reason string, sig binary, whole bigint")
    base = written(base.withColumn("id", F.xxhash64("repository_id", "file_path")).withColumn("repo", F.xxhash64("repository_id")))
    classes = written(base.where("whole is not null").groupBy("whole").agg(F.min("repo").alias("lo"), F.max("repo").alias("hi"), F.min("id").alias("id"), F.first("sig").alias("sig")))
    members = classes.select("whole", "lo", "hi", F.explode(_bands(F.col("sig"))).alias("band"))
    ends = members.groupBy("band").agg(F.min(F.struct("lo", "whole")).alias("first"), F.max(F.struct("hi", "whole")).alias("last")).where("first.lo <> last.hi")
    single = written(members.where("lo = hi").join(ends, "band"))
    partner = F.when(F.col("first.lo") != F.col("lo"), F.col("first.whole")).otherwise(F.col("last.whole"))
    best = _likely(classes, single.select("whole", partner.alias("other")).distinct()).groupBy("whole").agg(F.max(F.struct("likeness", "other")).alias("b")).select("whole", "b.other")
    near = written(_alike(files, classes, written(best)))
    rest = single.select("whole", "lo", "band").join(near, "whole", "left_anti")
    others = members.select(F.col("whole").alias("other"), F.col("lo").alias("other_lo"), F.col("hi").alias("other_hi"), "band")
    links = rest.join(others, "band").where("other_lo <> lo or other_hi <> lo").select("whole", "other").distinct()
    far = _alike(files, classes, written(_likely(classes, links).select("whole", "other")))
    copies = classes.where("lo <> hi").select("whole").unionByName(near).unionByName(far)
    flagged = base.where("reason is not null").select("repository_id", "file_path", "reason")
    copied = base.where("reason is null").join(copies, "whole", "left_semi").select("repository_id", "file_path", F.lit("copy").alias("reason"))
    return flagged.unionByName(copied).groupBy("repository_id", "file_path").agg(F.min("reason").alias("reason"))


def unwritten_files(files: DataFrame) -> DataFrame:
    """Distinct (repository_id, file_path) of the files that weren't written by hand."""
    return judged_files(files).select("repository_id", "file_path")


def hand_written(files: DataFrame) -> DataFrame:
    """Keys and sizes of the files that stay: those in no class of judged_files."""
    keys = ["repository_id", "file_path"]
    own = files.groupBy(*keys).agg(F.max(F.length("content")).cast("bigint").alias("chars"))
    return own.join(judged_files(files), keys, "left_anti")
