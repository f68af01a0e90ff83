"""Keeping a chunk index up to date from a stream of files, and appending audit records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.chunkers import SCHEMA, chunk_files
from ..operators.maintain import apply_changes, build_manifest, diff_manifest
from ..sources.store import drop_repositories, write_chunks, written

FILES = "repository_id string, file_path string, content string, size_bytes bigint, ord int"


def _exists(spark: SparkSession, path: str) -> bool:
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)


def update_index(spark: SparkSession, files: DataFrame, index: str) -> DataFrame:
    """Brings the chunk index at the folder index to the newest state of some repositories' files; returns the changes.

    The index is partitioned by repository.  Only partitions of repositories in which a file changed are written, each
    replaced as a whole when all of them are complete; other repositories are neither read nor copied.  A run that
    fails before leaves the index as it was, and running a batch again gives the same result.  Rows without a repository are left out.
    """
    known = files.where("repository_id is not null")
    current, repos = written(chunk_files(known)), known.select("repository_id").distinct()
    had = _exists(spark, index)
    old = spark.read.schema(SCHEMA).parquet(index) if had else spark.createDataFrame([], SCHEMA)
    mine = old.join(repos, "repository_id", "left_semi")
    changes = written(diff_manifest(build_manifest(current), build_manifest(mine)))
    touched = changes.where("change <> 'unchanged'").select("repository_id").distinct()
    on = changes.join(touched, "repository_id", "left_semi")
    write_chunks(apply_changes(mine, current, on).select(*current.columns), index)
    # a repository that has no chunk any more has no rows that could replace its partition
    gone = on.groupBy("repository_id").agg(F.min((F.col("change") == "removed").cast("int")).alias("empty")).where("empty = 1")
    for r in gone.select("repository_id").toLocalIterator():
        drop_repositories(spark, index, [r.repository_id])
    return changes


def reindex_stream(spark: SparkSession, source: str, index: str, checkpoint: str):
    """Starts a query that takes the files waiting in source and brings the index up to date a batch; call awaitTermination() on it."""
    stream = spark.readStream.schema(FILES).parquet(source)

    def batch(df: DataFrame, number: int) -> None:
        update_index(spark, df, index)

    return stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


# Events and outcomes that are recorded.
EVENTS = ["login", "logout", "import", "upload", "delete", "question", "report", "readme"]
OUTCOMES = ["success", "failure", "denied", "rejected"]


def audit_records(events: DataFrame, at: Column, allowed: list[str] | None = None) -> DataFrame:
    """(timestamp, event, outcome, actor_id, repository_fingerprint) of events(event, outcome, client, repository_id).

    Clients and repositories are recorded by digest only; events outside the allowed ones are left out.
    """
    fits = F.col("event").isin(*(allowed or EVENTS)) & F.col("outcome").isin(*OUTCOMES)
    valid = F.col("repository_id").rlike(r"^[A-Za-z0-9_.-]{1,140}$")
    return events.where(fits).select(
        F.date_format(at, "yyyy-MM-dd'T'HH:mm:ss'+00:00'").alias("timestamp"), "event", "outcome", F.substring(F.sha2("client", 256), 1, 16).alias("actor_id"), F.when(valid, F.sha2("repository_id", 256)).alias("repository_fingerprint")
    )


def audit_stream(stream: DataFrame, path: str, checkpoint: str):
    """Starts a query that appends audit records of a stream as JSON lines."""
    return audit_records(stream, F.current_timestamp()).writeStream.format("json").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
