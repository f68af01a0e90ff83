"""All registered queries outside the optional subpackage."""

from __future__ import annotations

from . import files, repository, search, texts

MODULES = [search, repository, files, texts]


def queries() -> dict:
    return {k: v for m in MODULES for k, v in m.queries().items()}


def oracle_sql() -> dict:
    return {k: v for m in MODULES for k, v in m.oracle_sql().items()}
