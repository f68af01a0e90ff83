"""Keeping tables of an index on disk: whole replacement with a way back, dropping repositories, pruning."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def _fs(spark: SparkSession, path: str):
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def _path(spark: SparkSession, path: str):
    return spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)


def replace_table(table: DataFrame, path: str, partition_by: list[str] | None = None) -> None:
    """Replaces the table at path as a whole: written beside it, then moved in; if that fails the old one is put back.

    The table may be read from path itself, since the old files are moved only after the new ones are written.
    """
    spark = table.sparkSession
    fs, mark = _fs(spark, path), uuid.uuid4().hex
    staged, old = f"{path}.new-{mark}", f"{path}.old-{mark}"
    writer = table.write.mode("errorifexists")
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(staged)
    had = fs.exists(_path(spark, path))
    if had and not fs.rename(_path(spark, path), _path(spark, old)):
        fs.delete(_path(spark, staged), True)
        raise OSError(f"{path} can't be moved")
    if not fs.rename(_path(spark, staged), _path(spark, path)):
        if had:
            fs.rename(_path(spark, old), _path(spark, path))
        raise OSError(f"{staged} can't be moved")
    if had:
        fs.delete(_path(spark, old), True)


def written(table: DataFrame) -> DataFrame:
    """The same table, computed once: written beside the cluster's checkpoints and read back.

    What several branches of a plan read is then neither computed twice nor lost with an executor.  The folder is
    that of spark.checkpoint.dir; a local session without one gets its own, a cluster must name one.
    """
    spark = table.sparkSession
    sc = spark.sparkContext
    base = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not base:
        if not sc.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        base = tempfile.mkdtemp(prefix="lucerna-")
        sc.setCheckpointDir(base)
    path = f"{base}/{uuid.uuid4().hex}"
    table.write.parquet(path)
    return spark.read.schema(table.schema).parquet(path)


def numbered(table: DataFrame, order: list[str | Column], name: str) -> DataFrame:
    """The table with row numbers from 1 in an order, without one task that sees all rows.

    Rows are spread by ranges of the order and numbered within each; the numbers of rows of the ranges before, one row a
    range, are added.  The ranges are written first, since a range partition computed twice may be cut in other places.
    """
    ranges = written(table.repartitionByRange(*order).withColumn("_range", F.spark_partition_id()))
    counts = ranges.groupBy("_range").agg(F.count(F.lit(1)).alias("_n"))
    before = counts.select("_range", (F.sum("_n").over(Window.orderBy("_range")) - F.col("_n")).alias("_before"))
    here = F.row_number().over(Window.partitionBy("_range").orderBy(*order))
    return ranges.join(before, "_range").withColumn(name, here + F.col("_before")).drop("_range", "_before")


#: Into how many tasks one repository's chunks are spread when they are written.
SPREAD = 64


def spread(chunks: DataFrame) -> DataFrame:
    """Chunks laid out for a table partitioned by repository: few files for a small repository, up to SPREAD tasks for a large one."""
    return chunks.repartition(F.col("repository_id"), F.pmod(F.xxhash64("file_path"), F.lit(SPREAD)))


def write_chunks(chunks: DataFrame, path: str) -> None:
    """Writes chunks partitioned by repository, replacing only the partitions of the repositories they belong to."""
    spread(chunks).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("repository_id").parquet(path)


def drop_repositories(spark: SparkSession, path: str, repository_ids: list[str]) -> int:
    """Deletes the partitions of the given repositories from a chunk table; returns how many were there.

    Partitions are matched by their exact value, never by a prefix.
    """
    fs, gone = _fs(spark, path), 0
    quote = spark.sparkContext._jvm.org.apache.spark.sql.catalyst.catalog.ExternalCatalogUtils.escapePathName
    for r in repository_ids:
        p = _path(spark, f"{path}/repository_id={quote(r)}")
        gone += bool(fs.exists(p) and fs.delete(p, True))
    return gone


def unparsed(listed: DataFrame, parsed: DataFrame) -> DataFrame:
    """Listed files from which nothing was read: those a snapshot leaves out."""
    return listed.join(parsed.select("repository_id", "file_path"), ["repository_id", "file_path"], "left_anti")


def cached_logs(logs: DataFrame, cached: DataFrame) -> DataFrame:
    """Stage logs (repository_id, agent, action, duration_ms) as shown for a report from the cache: marked, and without time.

    cached(repository_id, use_cache); repositories that are built anew keep their logs.
    """
    j = logs.join(cached.select("repository_id", "use_cache"), "repository_id", "left").withColumn("cached", F.coalesce("use_cache", F.lit(False)))
    action = F.when(F.col("cached"), F.concat(F.lit("Using cached result: "), "action")).otherwise(F.col("action"))
    return j.select("repository_id", "agent", action.alias("action"), F.when(F.col("cached"), 0.0).otherwise(F.col("duration_ms")).alias("duration_ms"), "cached")
