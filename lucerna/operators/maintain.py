"""Index manifests, incremental differences, signatures, catalog and audit summaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import valid_repository_id
from ..sources.store import numbered
from .corpus import KEY, unique_chunks, unique_files


def chunk_id(repository_id: Column, file_path: Column, chunk_index: Column) -> Column:
    """repository:path:index."""
    return F.concat_ws(":", repository_id, file_path, chunk_index.cast("string"))


def build_manifest(chunks: DataFrame) -> DataFrame:
    """(repository_id, file_path, hash, chunk_count, chunk_ids): SHA-256 over the chunks' fields in index order, without separators.

    Null fields add nothing to the hash.  A file's chunks meet in one row, which a file bounds.
    """
    fields = ["chunk_index", "start_line", "end_line", "language", "symbol_name", "symbol_type", "content"]
    part = F.concat_ws("", *[F.col(c).cast("string") for c in fields])
    rows = unique_chunks(chunks).select("repository_id", "file_path", F.struct("chunk_index", part.alias("part")).alias("c"))
    files = rows.groupBy("repository_id", "file_path").agg(F.array_sort(F.collect_list("c")).alias("cs"))
    return files.select(
        "repository_id", "file_path", F.sha2(F.array_join("cs.part", ""), 256).alias("hash"), F.size("cs").alias("chunk_count"),
        F.transform("cs", lambda c: chunk_id(F.col("repository_id"), F.col("file_path"), c["chunk_index"])).alias("chunk_ids"),
    )


def diff_manifest(current: DataFrame, indexed: DataFrame) -> DataFrame:
    """(repository_id, file_path, change, delete_ids, insert_ids) against what is indexed: added, changed, removed or unchanged.

    An indexed file with another hash is changed; of several indexed rows of a file the greatest hash counts; a null list of ids deletes by file.
    """
    old = indexed.where("repository_id is not null and file_path is not null").groupBy("repository_id", "file_path").agg(F.max(F.struct("hash", "chunk_ids")).alias("o"))
    new = current.select("repository_id", "file_path", "hash", "chunk_ids")
    j = new.join(old, ["repository_id", "file_path"], "full_outer")
    change = F.when(F.col("o").isNull(), "added").when(F.col("hash").isNull(), "removed").when(F.col("hash").eqNullSafe(F.col("o.hash")), "unchanged").otherwise("changed")
    none = F.array().cast("array<string>")
    j = j.withColumn("change", change)
    return j.select(
        "repository_id", "file_path", "change",
        F.when(F.col("change").isin("changed", "removed"), F.coalesce("o.chunk_ids", none)).otherwise(none).alias("delete_ids"),
        F.when(F.col("change").isin("changed", "added"), F.coalesce("chunk_ids", none)).otherwise(none).alias("insert_ids"),
    )


def index_result(changes: DataFrame) -> DataFrame:
    """Counters of an incremental run per repository; cached tells that nothing changed."""
    n = lambda kind: F.sum((F.col("change") == kind).cast("bigint"))
    out = changes.groupBy("repository_id").agg(
        n("added").alias("added_files"), n("changed").alias("changed_files"), n("removed").alias("removed_files"), n("unchanged").alias("unchanged_files"),
        F.sum(F.size("insert_ids")).cast("bigint").alias("inserted_chunks"), F.sum(F.size("delete_ids")).cast("bigint").alias("deleted_chunks"),
    )
    return out.withColumn("cached", F.col("added_files") + F.col("changed_files") + F.col("removed_files") == 0)


def apply_changes(indexed_chunks: DataFrame, current_chunks: DataFrame, changes: DataFrame) -> DataFrame:
    """The index after a run: chunks of unchanged files as they are, those of added and changed files anew."""
    keep = changes.where("change = 'unchanged'").select("repository_id", "file_path")
    take = changes.where("change in ('added', 'changed')").select("repository_id", "file_path")
    on = ["repository_id", "file_path"]
    return indexed_chunks.join(keep, on, "left_semi").unionByName(current_chunks.join(take, on, "left_semi"), allowMissingColumns=True)


def tree_signature(files: DataFrame, version: int = 4) -> DataFrame:
    """Per repository what decides whether a cached report is still good: version, files, bytes and the latest ord."""
    f = unique_files(files)
    return f.groupBy("repository_id").agg(F.lit(version).alias("version"), F.count(F.lit(1)).alias("files"), F.coalesce(F.sum("size_bytes"), F.lit(0)).cast("bigint").alias("bytes"), F.max("ord").alias("latest"))


def cached_reports(signatures: DataFrame, cached: DataFrame) -> DataFrame:
    """Which repositories can use their cached report: all parts of the signature are equal."""
    on = ["repository_id"]
    c = cached.select("repository_id", F.struct("version", "files", "bytes", "latest").alias("had"))
    j = signatures.withColumn("has", F.struct("version", "files", "bytes", "latest")).join(c, on, "left")
    return j.select("repository_id", F.coalesce(F.col("has") == F.col("had"), F.lit(False)).alias("use_cache"))


def catalog(repo_catalog: DataFrame, manifest: DataFrame, chunks: DataFrame) -> DataFrame:
    """One row a repository with counts from the index, newest first.

    Of repeated catalog rows the one with the latest update counts.  Status is 'ready' with an index and
    'incomplete' without; names fall back from display to source name to the last part of the address.
    """
    best = repo_catalog.where("repository_id is not null").groupBy("repository_id").agg(
        F.max(F.struct(*["updated_at", "created_at", "status", "files_indexed", "github_url", "default_branch", "source", "source_name", "source_type", "display_name", "upload_name"])).alias("c")
    )
    files = manifest.where("repository_id is not null and file_path is not null").groupBy("repository_id").agg(F.count_distinct("file_path").alias("index_files"))
    n = unique_chunks(chunks).groupBy("repository_id").agg(F.count(F.lit(1)).alias("chunks_indexed"))
    j = best.join(files, "repository_id", "left").join(n, "repository_id", "left")
    blank = lambda c: F.nullif(F.col(f"c.{c}"), F.lit(""))
    name_in_url = F.nullif(F.regexp_extract("c.github_url", r"([^/]+?)(?:\.git)?/*$", 1), F.lit(""))
    source = F.coalesce(blank("source"), F.when(F.col("c.github_url").isNotNull(), "github"))
    kind = F.coalesce(blank("source_type"), F.when(source == "zip_upload", "zip_upload").when(F.col("c.github_url").isNotNull(), "github").otherwise(source))
    out = j.select(
        "repository_id", F.when(F.col("index_files").isNotNull(), "ready").otherwise("incomplete").alias("status"),
        F.coalesce("index_files", F.col("c.files_indexed").cast("bigint"), F.lit(0)).alias("files_indexed"), F.coalesce("chunks_indexed", F.lit(0)).alias("chunks_indexed"),
        "c.created_at", "c.updated_at", "c.github_url", "c.default_branch", source.alias("source"), blank("source_name").alias("source_name"), kind.alias("source_type"),
        F.coalesce(blank("display_name"), blank("source_name"), name_in_url).alias("display_name"), F.coalesce(blank("upload_name"), F.when(kind == "zip_upload", blank("source_name"))).alias("upload_name"),
    )
    return numbered(out, [F.coalesce("updated_at", F.lit(0)).desc(), F.col("repository_id").desc()], "newest")


def catalog_entry(entries: DataFrame, repository_id: str) -> DataFrame:
    """The catalog's row of one repository; none for an unknown or invalid id."""
    return entries.where((F.col("repository_id") == repository_id) & valid_repository_id(F.col("repository_id")))


def audit_time(logged_at: Column) -> Column:
    """Timestamp (UTC) of the notations in the log: ISO 8601 with or without zone, a blank for the T, or epoch seconds; null otherwise."""
    t = F.trim(logged_at)
    iso = F.try_to_timestamp(F.regexp_replace(F.replace(t, F.lit("T"), F.lit(" ")), r"(?:Z|\+00:?00| UTC)$", ""))
    return F.when(t.rlike(r"^\d{9,11}(\.\d+)?$"), F.timestamp_seconds(t.cast("double"))).when(t.rlike(r"^\d{4}-\d\d-\d\d[T ]\d\d:\d\d"), iso)


def audit_events(audit_log: DataFrame) -> DataFrame:
    """One row an audit_id: that which arrived first."""
    return audit_log.where("audit_id is not null").groupBy("audit_id").agg(F.min(F.struct("arrived_at", "logged_at", "event", "outcome", "actor_id", "repository_fingerprint")).alias("a")).select("audit_id", "a.*")


def audit_summary(audit_log: DataFrame, repo_catalog: DataFrame) -> DataFrame:
    """Events and failures per event and repository; a fingerprint is the SHA-256 of a repository's id, unknown ones stay null."""
    known = repo_catalog.where("repository_id is not null").select("repository_id").distinct().withColumn("repository_fingerprint", F.sha2("repository_id", 256))
    e = audit_events(audit_log).join(known, "repository_fingerprint", "left")
    return e.groupBy("event", "repository_id").agg(F.count(F.lit(1)).alias("events"), F.sum((F.coalesce("outcome", F.lit("")) != "success").cast("bigint")).alias("other_outcomes"), F.count_distinct("actor_id").alias("actors"))


def requests_in_window(events: DataFrame, key: str, time: str, order: str, seconds: int = 60, block: int = 86_400) -> DataFrame:
    """Per event how many events of its key lie in the seconds up to and including it.

    Time is cut into blocks no shorter than the window; an event counts in its own block and, as one that is only looked
    at, in the next if it lies within its reach.  A busy key is so spread over as many tasks as it has blocks.
    """
    at = F.col(time).cast("timestamp").cast("double")
    size = max(block, seconds)
    e = events.where(F.col(key).isNotNull() & F.col(time).isNotNull()).select(order, key, time, at.alias("_at"), F.floor(at / size).alias("_own"))
    reach = (F.col("_own") + 1) * size - F.col("_at") <= seconds
    e = e.withColumn("_block", F.explode(F.when(reach, F.array(F.col("_own"), F.col("_own") + 1)).otherwise(F.array("_own"))))
    w = Window.partitionBy(key, "_block").orderBy("_at").rangeBetween(-seconds, 0)
    return e.withColumn("requests", F.count(F.lit(1)).over(w)).where("_block = _own").select(order, key, time, "requests")


def citations(chunks: DataFrame, repo_catalog: DataFrame) -> DataFrame:
    """Citation of every chunk: place, symbol and, for public addresses, a link to its lines."""
    from ..functions.text import source_url

    url = repo_catalog.where("repository_id is not null").groupBy("repository_id").agg(F.max("github_url").alias("github_url"))
    c = unique_chunks(chunks).join(url, "repository_id", "left")
    return c.select(*KEY, "start_line", "end_line", "language", "symbol_name", "symbol_type", source_url(F.col("github_url"), F.col("file_path"), F.col("start_line"), F.col("end_line")).alias("url"))
