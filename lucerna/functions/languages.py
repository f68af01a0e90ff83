"""Language of a file by its name."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The languages of file extensions.
LANGUAGE_BY_EXTENSION = {
    ".py": "python", ".js": "javascript", ".jsx": "javascript", ".mjs": "javascript", ".cjs": "javascript", ".ts": "typescript",
    ".tsx": "typescript", ".java": "java", ".go": "go", ".rs": "rust", ".c": "c", ".cc": "cpp", ".cpp": "cpp", ".cxx": "cpp",
    ".h": "c", ".hpp": "cpp", ".cs": "csharp", ".php": "php", ".rb": "ruby", ".kt": "kotlin", ".kts": "kotlin", ".swift": "swift",
    ".vue": "vue", ".svelte": "svelte", ".html": "html", ".htm": "html", ".css": "css", ".scss": "scss", ".sass": "sass",
    ".less": "less", ".sh": "shell", ".bash": "shell", ".zsh": "shell", ".ps1": "powershell", ".bat": "batch", ".cmd": "batch",
    ".md": "markdown", ".mdx": "markdown", ".rst": "text", ".adoc": "text", ".json": "json", ".jsonl": "json", ".yaml": "yaml",
    ".yml": "yaml", ".toml": "toml", ".ini": "ini", ".cfg": "config", ".conf": "config", ".properties": "properties", ".xml": "xml",
    ".sql": "sql", ".graphql": "graphql", ".gql": "graphql", ".proto": "protobuf", ".prisma": "prisma", ".gradle": "gradle",
    ".csv": "csv", ".tsv": "tsv", ".txt": "text", ".pdf": "pdf", ".docx": "docx", ".xlsx": "xlsx",
}
# The languages of whole file names, which come before extensions.
LANGUAGE_BY_FILENAME = {
    "dockerfile": "dockerfile", "containerfile": "dockerfile", "makefile": "makefile", "cmakelists.txt": "cmake",
    "requirements.txt": "requirements", "pipfile": "toml", "gemfile": "ruby", "rakefile": "ruby", "cargo.toml": "toml",
    "go.mod": "go", "go.sum": "text", "package.json": "json", "pyproject.toml": "toml", "setup.py": "python",
}


def file_name(path: Column) -> Column:
    """Last component of a path, in lower case."""
    return F.lower(F.element_at(F.split(path, "/"), -1))


def extension(path: Column) -> Column:
    """Suffix of the file name with its dot, in lower case; '' without one or for a name that only begins with a dot."""
    return F.regexp_extract(file_name(path), r"^.+(\.[^.]*)$", 1)


def language(path: Column) -> Column:
    """Language of a file: by its whole name, else by its extension, else 'text'; null for a null path."""
    by_map = F.create_map(*[F.lit(x) for kv in LANGUAGE_BY_EXTENSION.items() for x in kv])
    by_name = F.create_map(*[F.lit(x) for kv in LANGUAGE_BY_FILENAME.items() for x in kv])
    return F.when(path.isNotNull(), F.coalesce(by_name[file_name(path)], by_map[extension(path)], F.lit("text")))
