"""Which files of a repository are read."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .languages import LANGUAGE_BY_EXTENSION, extension, file_name

# Folders, names, extensions and name parts that are left out, and names without a known extension that are kept.
IGNORED_FOLDERS = [".git", "node_modules", ".venv", "venv", "dist", "build", "__pycache__", ".cache", ".codebase_agent", ".pytest_cache", ".mypy_cache", ".ruff_cache", ".next", ".nuxt", "coverage", "target", "vendor"]
IGNORED_NAMES = [".env", ".env.local", ".env.development", ".env.production", ".env.test", ".npmrc", ".pypirc", "id_rsa", "id_dsa", "id_ecdsa", "id_ed25519", "credentials", "credentials.json", "secrets.json", "package-lock.json", "yarn.lock"]
IGNORED_EXTENSIONS = [
    ".png", ".jpg", ".jpeg", ".gif", ".webp", ".ico", ".svg", ".mp4", ".mov", ".avi", ".mkv", ".mp3", ".wav", ".zip", ".tar", ".gz", ".rar", ".7z", ".exe", ".dll", ".so", ".dylib", ".class", ".jar", ".pyc", ".pem", ".key", ".crt",
    ".cer", ".cert", ".p12", ".pfx", ".jks", ".keystore",
]
SENSITIVE_PARTS = [".env.", "secret", "credential", "private-key", "private_key"]
KEPT_NAMES = ["dockerfile", "containerfile", "makefile", "cmakelists.txt", "requirements.txt", "readme", "license", "notice", "changelog", "contributing", "pipfile", "gemfile", "rakefile", "cargo.toml", "go.mod", "go.sum", "package.json", "pyproject.toml", "setup.py"]


def in_ignored_folder(path: Column) -> Column:
    """Whether any folder above the file is one that is left out."""
    parts = F.split(path, "/")
    return F.arrays_overlap(F.slice(parts, F.lit(1), F.greatest(F.size(parts) - 1, F.lit(0))), F.array(*[F.lit(x) for x in IGNORED_FOLDERS]))


def file_rule(path: Column) -> Column:
    """Which rule decides about a file, the first that holds: name, sensitive, extension, kept_name, known or unknown."""
    name, ext = file_name(path), extension(path)
    sensitive = F.greatest(*[F.instr(name, p) for p in SENSITIVE_PARTS]) > 0
    rule = F.when(name.isin(*IGNORED_NAMES), "name").when(sensitive, "sensitive").when(ext.isin(*IGNORED_EXTENSIONS), "extension")
    return rule.when(name.isin(*KEPT_NAMES), "kept_name").when(ext.isin(*LANGUAGE_BY_EXTENSION), "known").otherwise("unknown")


def included(path: Column) -> Column:
    """Whether a file is read."""
    return ~in_ignored_folder(path) & file_rule(path).isin("kept_name", "known")
