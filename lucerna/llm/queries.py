"""Queries of the training-data problems; ``oracle_sql`` has those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ..sources.tables import read
from . import abuse, documented, encodings, invalid_source, leakage, mixing, secrets, unwritten

Query = Callable[[SparkSession, str], DataFrame]


def queries() -> dict[str, Query]:
    return {
        "p1_found": lambda s, d: invalid_source.invalid_files(read(s, d, "files")),
        "p1_rates": lambda s, d: invalid_source.invalid_rates(read(s, d, "files")),
        "p2_found": lambda s, d: secrets.found_secrets(read(s, d, "files")),
        "p2_redacted_files": lambda s, d: secrets.redacted(read(s, d, "files"), ["repository_id", "file_path"]).where("secrets > 0").distinct(),
        "p2_redacted_chunks": lambda s, d: secrets.redacted(read(s, d, "chunks"), ["repository_id", "file_path", "chunk_index"]).where("secrets > 0").distinct(),
        "p3_found": lambda s, d: encodings.garbled_files(read(s, d, "files")),
        "p3_restored": lambda s, d: encodings.restored_files(read(s, d, "files")),
        "p4_found": lambda s, d: documented.documented_functions(read(s, d, "chunks")),
        "p4_pairs": lambda s, d: documented.pairs(read(s, d, "chunks")).distinct(),
        "p5_found": lambda s, d: unwritten.unwritten_files(read(s, d, "files")),
        "p5_reasons": lambda s, d: unwritten.judged_files(read(s, d, "files")),
        "p5_hand_written": lambda s, d: unwritten.hand_written(read(s, d, "files")),
        "p6_found": lambda s, d: leakage.leaks(read(s, d, "documents"), read(s, d, "eval_items")),
        "p6_items": lambda s, d: leakage.leaks_by_item(read(s, d, "documents"), read(s, d, "eval_items")),
        "p6_cleaned": lambda s, d: leakage.cleaned(read(s, d, "documents"), read(s, d, "eval_items")),
        "p7_mix": lambda s, d: mixing.mix(read(s, d, "documents"), read(s, d, "mix_targets")),
        "p7_shares": lambda s, d: mixing.shares(read(s, d, "documents"), read(s, d, "mix_targets")),
        "p8_found": lambda s, d: abuse.abusive(read(s, d, "documents"), read(s, d, "doc_labels")),
        "p8_scores": lambda s, d: abuse.scores(read(s, d, "documents"), read(s, d, "doc_labels")),
        "p8_rates": lambda s, d: abuse.rates(read(s, d, "documents"), read(s, d, "doc_labels")),
    }


def oracle_sql() -> dict[str, str]:
    return {}
