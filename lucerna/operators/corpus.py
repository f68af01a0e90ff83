"""The chunk table in its canonical form."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

KEY = ["repository_id", "file_path", "chunk_index"]
FIELDS = ["start_line", "end_line", "language", "symbol_name", "symbol_type", "parent_symbol", "content"]


def unique_chunks(chunks: DataFrame) -> DataFrame:
    """One row a key (repository_id, file_path, chunk_index): the greatest by content, then by the other fields.

    Rows without a repository, path or index have no identity and are left out; other columns are dropped.
    """
    rest = ["content", *[c for c in FIELDS if c != "content"]]
    best = chunks.where("repository_id is not null and file_path is not null and chunk_index is not null").groupBy(*KEY).agg(F.max(F.struct(*rest)).alias("r"))
    return best.select(*KEY, *[F.col(f"r.{c}").alias(c) for c in FIELDS])


def searchable(chunks: DataFrame) -> DataFrame:
    """Canonical chunks with content null read as '', and the text that is searched: path, line break, content."""
    c = unique_chunks(chunks).withColumn("content", F.coalesce("content", F.lit("")))
    return c.withColumn("full_text", F.concat_ws("\n", "file_path", "content"))


def unique_files(files: DataFrame) -> DataFrame:
    """One row a key (repository_id, file_path) with its greatest content, size and ord; rows without a key are left out."""
    own = files.where("repository_id is not null and file_path is not null")
    return own.groupBy("repository_id", "file_path").agg(F.max("content").alias("content"), F.max("size_bytes").alias("size_bytes"), F.max("ord").alias("ord"))
