import os
import sys
from pathlib import Path

import pytest
from pyspark.sql import SparkSession

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))
os.environ.setdefault("PYSPARK_PYTHON", sys.executable)


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    s = (
        SparkSession.builder.master("local[4]")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.ui.enabled", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "4g")
        .config("spark.sql.warehouse.dir", str(tmp_path_factory.mktemp("warehouse")))
        .getOrCreate()
    )
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()


FILES = "repository_id string, file_path string, content string, size_bytes bigint, ord int"
CHUNKS = "repository_id string, file_path string, chunk_index int, start_line int, end_line int, language string, symbol_name string, symbol_type string, parent_symbol string, content string"


@pytest.fixture(scope="session")
def files_of(spark):
    def make(rows: dict | list, repo: str = "r"):
        items = [(repo, p, c) for p, c in rows.items()] if isinstance(rows, dict) else rows
        return spark.createDataFrame([(r, p, c, len(c or ""), i) for i, (r, p, c) in enumerate(items)], FILES)

    return make


@pytest.fixture(scope="session")
def chunks_of(spark):
    def make(rows):
        return spark.createDataFrame([(r.get("repo", "r"), r.get("path"), r.get("index", 0), r.get("start", 1), r.get("end", 2), r.get("language"), r.get("name"), r.get("type", "function"), r.get("parent"), r.get("content")) for r in rows], CHUNKS)

    return make
