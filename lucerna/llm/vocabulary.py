"""Public tokenizer vocabularies, sent with the job to every worker."""

from __future__ import annotations

import base64
import os
from functools import lru_cache

from pyspark import SparkFiles
from pyspark.sql import SparkSession

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"


def shipped(spark: SparkSession, path: str) -> str:
    """Sends a vocabulary file, which only the driver must have, along with the session's jobs; returns its name for encoding()."""
    spark.sparkContext.addFile(path)
    return os.path.basename(path)


@lru_cache(maxsize=4)
def encoding(name: str):
    """The encoder of a vocabulary by its path, or by the name under which it was sent."""
    import tiktoken

    with open(name if os.path.isabs(name) else SparkFiles.get(name), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    pattern = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
    return tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
