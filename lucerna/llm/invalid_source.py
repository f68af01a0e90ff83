"""Problem 1: source files that aren't valid in the language their name stands for.

Every file is parsed by a generalised LL recogniser over a graph-structured stack; the
dialects of a language (script and module, statement and expression forms of different
versions) are start rules of one run, and a file is flagged when all of them reject it.
In scripts what the grammar derives and the language refuses all the same (a jump out of
nothing, a constant without a value, a name declared twice) is looked for afterwards.

Null and blank contents and a leading byte-order mark are no faults; repeated rows count
once; files in other languages and rows with a null path aren't judged.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.languages import file_name, language

#: Suffixes of the script dialects with markup.
MARKUP = {".jsx": "jsx", ".tsx": "tsx"}
CHECKED = ("python", "javascript", "typescript", "go", "java", "json")


def checked_language(path: Column) -> Column:
    """The language a file is checked in; null where it isn't checked (module lists of Go are no Go source)."""
    lang = language(path)
    return F.when(lang.isin(*CHECKED) & (file_name(path) != "go.mod"), lang)


def _invalid(text: str | None, lang: str, path: str) -> bool:
    from . import syntax

    if lang == "json" and path.lower().endswith(".jsonl"):
        return any(syntax.rejected(line, lang) for line in (text or "").split("\n"))
    dialect = MARKUP.get(path.lower()[-4:], lang)
    try:
        return syntax.rejected(text, dialect)
    except RecursionError:  # templates or markup nested hundreds deep: a level is three calls and more than three characters
        limit = sys.getrecursionlimit()
        sys.setrecursionlimit(limit + 1000 + len(text))
        try:
            return syntax.rejected(text, dialect)
        finally:
            sys.setrecursionlimit(limit)


def _check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        cols = [b.column(x).to_pylist() for x in ("content", "language", "file_path")]
        bad = [_invalid(*row) for row in zip(*cols, strict=True)]
        yield pa.RecordBatch.from_arrays([b.column("repository_id"), b.column("file_path"), b.column("language"), pa.array(bad, pa.bool_())], ["repository_id", "file_path", "language", "invalid"])


def check_files(files: DataFrame) -> DataFrame:
    """(repository_id, file_path, language, invalid) of every checked row of files(repository_id, file_path, content)."""
    src = files.select("repository_id", "file_path", "content", checked_language(F.col("file_path")).alias("language")).where("language is not null")
    return src.mapInArrow(_check, "repository_id string, file_path string, language string, invalid boolean")


def invalid_files(files: DataFrame) -> DataFrame:
    """Distinct (repository_id, file_path) of the files that every dialect rejects."""
    return check_files(files).where("invalid").select("repository_id", "file_path").distinct()


def invalid_rates(files: DataFrame) -> DataFrame:
    """Per repository and language: files, invalid files and their share. A key that occurs again counts once."""
    once = check_files(files).groupBy("repository_id", "language", "file_path").agg(F.max("invalid").alias("invalid"))
    out = once.groupBy("repository_id", "language").agg(F.count(F.lit(1)).alias("files"), F.sum(F.col("invalid").cast("bigint")).alias("invalid_files"))
    return out.withColumn("invalid_rate", F.round(F.col("invalid_files") / F.col("files"), 6))
