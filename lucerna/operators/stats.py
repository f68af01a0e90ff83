"""Repository statistics: modules, sizes, languages, trees, entry points."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.languages import language
from ..functions.filters import included
from .corpus import unique_files

# Names of files that start programs.
ENTRY_NAMES = ["main.py", "app.py", "manage.py", "server.py", "run.py", "wsgi.py", "asgi.py", "server.js", "server.ts", "index.js", "index.ts", "app.js", "app.ts", "main.go", "main.rs", "Program.cs", "Dockerfile"]
ENTRY_PATHS = ["src/main.py", "src/index.ts", "src/index.js", "app/main.py"]


def listed(files: DataFrame) -> DataFrame:
    """The files an analysis sees, without their contents: one row a key, ignored folders and files left out, null sizes read as 0."""
    return unique_files(files.drop("content").withColumn("content", F.lit(None).cast("string"))).where(included(F.col("file_path"))).select("repository_id", "file_path", F.coalesce("size_bytes", F.lit(0)).cast("bigint").alias("size_bytes"))


def _top(df: DataFrame, order: list, limit: int, name: str = "place") -> DataFrame:
    w = Window.partitionBy("repository_id").orderBy(*order)
    return df.withColumn(name, F.row_number().over(w).cast("bigint")).where(F.col(name) <= limit)


def core_modules(files: DataFrame, limit: int = 12) -> DataFrame:
    """The folders at the root with the most files: files, bytes and languages; hidden folders and root files count as '.'."""
    first = F.split("file_path", "/")[0]
    module = F.when(~F.col("file_path").contains("/") | first.startswith("."), ".").otherwise(first)
    f = listed(files).select("repository_id", module.alias("module"), "size_bytes", language(F.col("file_path")).alias("language"))
    g = f.groupBy("repository_id", "module").agg(F.count(F.lit(1)).alias("files"), F.sum("size_bytes").alias("bytes"), F.array_join(F.array_sort(F.collect_set("language")), ",").alias("languages"))
    return _top(g, [F.col("files").desc(), F.col("bytes").desc(), F.col("module")], limit)


def largest_files(files: DataFrame, limit: int = 10) -> DataFrame:
    """The largest files of each repository."""
    return _top(listed(files).withColumn("language", language(F.col("file_path"))), [F.col("size_bytes").desc(), F.col("file_path")], limit)


def folders(path: Column) -> Column:
    """All folders above a file, from the root down."""
    parts = F.split(path, "/")
    return F.when(F.size(parts) > 1, F.transform(F.sequence(F.lit(1), F.size(parts) - 1), lambda i: F.array_join(F.slice(parts, F.lit(1), i), "/"))).otherwise(F.array().cast("array<string>"))


def repository_counts(files: DataFrame) -> DataFrame:
    """Files, folders, languages and bytes of each repository."""
    f = listed(files)
    own = f.groupBy("repository_id").agg(F.count(F.lit(1)).alias("files"), F.sum("size_bytes").alias("bytes"), F.array_join(F.array_sort(F.collect_set(language(F.col("file_path")))), ",").alias("languages"))
    dirs = f.select("repository_id", F.explode(folders(F.col("file_path"))).alias("folder")).groupBy("repository_id").agg(F.count_distinct("folder").alias("folders"))
    return own.join(dirs, "repository_id", "left").withColumn("folders", F.coalesce("folders", F.lit(0)))


def directory_tree(files: DataFrame, depth: int = 3, limit: int = 220) -> DataFrame:
    """(repository_id, place, line): the first limit entries of the tree down to depth, folders first, in the order they are printed.

    Entries are folders and files with their sort path; a window numbers them, so no tree is built in one place.
    """
    f = listed(files)
    dirs = f.select("repository_id", F.explode(folders(F.col("file_path"))).alias("entry")).distinct().withColumn("folder", F.lit(True))
    entries = dirs.unionByName(f.select("repository_id", F.col("file_path").alias("entry"), F.lit(False).alias("folder")))
    parts = F.split("entry", "/")
    # a folder's children come right after it; at each level folders (0) sort before files (1)
    n = F.size(parts)
    key = F.transform(F.sequence(F.lit(1), n), lambda i: F.struct(F.when((i == n) & ~F.col("folder"), 1).otherwise(0).alias("k"), F.lower(F.element_at(parts, i)).alias("name"), F.element_at(parts, i).alias("exact")))
    rows = entries.withColumn("level", n).where(F.col("level") <= depth).withColumn("key", key)
    line = F.concat(F.repeat(F.lit("    "), F.col("level") - 1), F.element_at(F.split("entry", "/"), -1), F.when(F.col("folder"), "/").otherwise(""))
    return _top(rows, [F.col("key")], limit).select("repository_id", "place", line.alias("line"))


def entry_points(files: DataFrame) -> DataFrame:
    """Files that by name start a program."""
    last = F.element_at(F.split("file_path", "/"), -1)
    return listed(files).where(last.isin(*ENTRY_NAMES) | F.col("file_path").isin(*ENTRY_PATHS)).select("repository_id", "file_path").distinct()


def within_budget(files: DataFrame, max_files: int = 5000, max_bytes: int = 80_000_000, max_file_bytes: int = 1_000_000) -> DataFrame:
    """The files a scan takes, in path order: at most max_files, skipping each that would exceed the remaining bytes.

    Skipping and going on isn't a running sum.  Where a repository's files fit as a whole -- nearly always --
    two aggregates decide for all at once.  The files of a repository beyond a limit stream in path order through a task that
    holds two counters; only paths and sizes take part, and the sort before it spills.
    """
    f = listed(files).where(F.col("size_bytes") <= max_file_bytes)
    total = f.groupBy("repository_id").agg(F.count(F.lit(1)).alias("n"), F.sum("size_bytes").alias("b"))
    fits = (F.col("n") <= max_files) & (F.col("b") <= max_bytes)
    easy = f.join(total.where(fits).select("repository_id"), "repository_id", "left_semi")
    hard = f.join(total.where(~fits).select("repository_id"), "repository_id", "left_semi")

    def stream(batches):
        repo, taken, used = None, 0, 0
        for b in batches:
            keep = []
            for r, size in zip(b["repository_id"].tolist(), b["size_bytes"].tolist(), strict=True):
                if r != repo:
                    repo, taken, used = r, 0, 0
                keep.append(taken < max_files and used + size <= max_bytes)
                if keep[-1]:
                    taken, used = taken + 1, used + size
            yield b[keep]

    ordered = hard.repartition("repository_id").sortWithinPartitions("repository_id", "file_path")
    return easy.unionByName(ordered.mapInPandas(stream, "repository_id string, file_path string, size_bytes bigint"))
