"""Tables on disk, ids and cached logs."""

import hashlib

from pyspark.sql import functions as F

from lucerna.functions.text import embedding_signature, repository_id
from lucerna.sources import store


def test_replace_and_drop(spark, chunks_of, tmp_path):
    path = str(tmp_path / "chunks")
    store.write_chunks(chunks_of([{"repo": r, "path": p, "content": r + p} for r in ("a", "a b", "ab") for p in "xy"]), path)
    store.write_chunks(chunks_of([{"repo": "a", "path": "z", "content": "new"}]), path)
    read = lambda: sorted((r.repository_id, r.file_path) for r in spark.read.parquet(path).select(F.col("repository_id").cast("string"), "file_path").collect())
    assert read() == [("a", "z"), ("a b", "x"), ("a b", "y"), ("ab", "x"), ("ab", "y")]
    assert store.drop_repositories(spark, path, ["a", "none"]) == 1 and {r for r, _ in read()} == {"a b", "ab"}
    store.replace_table(spark.read.parquet(path).where("file_path = 'x'"), path, ["repository_id"])
    spark.catalog.refreshByPath(path)
    assert read() == [("a b", "x"), ("ab", "x")] and sorted(p.name for p in tmp_path.iterdir()) == ["chunks"]


def test_ids(spark):
    url = "https://github.com/Own-er/re.po"
    got = spark.createDataFrame([(url + "/",), ("x",), (None,)], "u string").select(repository_id(F.col("u")).alias("i"), embedding_signature("sentence-x", "m").alias("s")).collect()
    assert got[0].i == f"Own-er-re-po-{hashlib.sha1(url.encode()).hexdigest()[:10]}" and got[1].i.startswith("repository-") and got[2].i is None
    assert got[0].s == "sentence_x_" + hashlib.sha1(b"sentence-x:m").hexdigest()[:8]


def test_unparsed_and_logs(spark, files_of):
    f = files_of({"a": "x", "b": None})
    assert [r.file_path for r in store.unparsed(f, f.where("content is not null")).collect()] == ["b"]
    logs = spark.createDataFrame([("r", "api", "Reading", 5.0), ("q", "api", "Reading", 7.0)], "repository_id string, agent string, action string, duration_ms double")
    flags = spark.createDataFrame([("r", True)], "repository_id string, use_cache boolean")
    got = {r.repository_id: (r.action, r.duration_ms, r.cached) for r in store.cached_logs(logs, flags).collect()}
    assert got == {"r": ("Using cached result: Reading", 0.0, True), "q": ("Reading", 7.0, False)}


def test_written_tables_are_computed_once(spark):
    runs = spark.sparkContext.accumulator(0)

    def count(batches):
        for b in batches:
            runs.add(len(b))
            yield b

    t = store.written(spark.range(10).mapInPandas(count, "id bigint"))
    assert t.count() == 10 and t.join(t, "id").count() == 10 and runs.value == 10
    assert store.written(t.limit(0)).count() == 0


def test_numbered(spark):
    t = spark.range(500).select((F.col("id") * 7919 % 500).alias("x"), (F.col("id") % 3).alias("y")).repartition(5)
    got = store.numbered(t, [F.col("y").desc(), F.col("x")], "n").collect()
    assert [(r.y, r.x) for r in sorted(got, key=lambda r: r.n)] == sorted(((r.y, r.x) for r in got), key=lambda v: (-v[0], v[1])) and sorted(r.n for r in got) == list(range(1, 501))
    assert store.numbered(t.limit(0), ["x"], "n").count() == 0


def test_large_repositories_are_written_by_several_tasks(spark, chunks_of, tmp_path):
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        store.write_chunks(chunks_of([{"repo": "a", "path": f"p{i}", "content": "x"} for i in range(300)] + [{"repo": "b", "path": "q"}]), str(tmp_path / "c"))
        assert len(list((tmp_path / "c" / "repository_id=a").glob("*.parquet"))) > 1 and spark.read.parquet(str(tmp_path / "c")).count() == 301
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
