"""Problem 4: functions and methods with their own documentation, as code-description pairs.

A packrat parser with one parsing-expression grammar a language reads the head of each
chunk: documentation comments, annotations and the function's header, or header and
docstring in Python.  Its actions keep source offsets, from which the pair is cut; what an
inner function, a class or the body says is never reached by the grammar.  The text is then
cleaned of parameter lists, tool notes, disabled code, rulers and licences, and the pair is
kept if enough words are left that say more than the function's name.

Null and blank contents and chunks that aren't functions give no pair; a null language is
taken from the file name; repeated rows count once.
"""

from __future__ import annotations

import re
import sys
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.languages import language
from .packrat import Peg

MIN_WORDS, MIN_HAN = 5, 8

_SHARED = r"""
S <- ~"[ \t\r\n]*"
Name: <- ~"[^\W\d][\w$]*"
Paren <- "(" Inner* ")"
Brack <- "[" Inner* "]"
Brace <- "{" Inner* "}"
"""
_C_BASE = (
    _SHARED
    + r"""
Note <- ~"//[^\n]*" / ~"/\*(?:[^*]|\*(?!/))*\*/"
Docs: <- (~"\s*" Comment)*
Comment: <- ~"//[^\n]*(?:\r?\n[ \t]*//[^\n]*)*" / ~"/\*(?:[^*]|\*(?!/))*\*/"
Gap <- (~"\s+" / Note)*
Inner <- String / Note / Paren / Brack / Brace / ~"[^()\[\]{}\"'`/]+" / "/"
Angle <- "<" (Angle / Paren / Brack / Brace / String / "=>" / ~"[^<>()\[\]{}\"'`=;]+" / "=")* ">"
"""
)
_C_SHARED = (
    _C_BASE
    + r"""
String <- ~"\"(?:[^\"\\\n]|\\.)*\"" / ~"'(?:[^'\\\n]|\\.)*'" / ~"`(?:[^`\\]|\\[\s\S])*`"
"""
)
GRAMMARS = {
    "python": r"""
Chunk <- ~"﻿?\s*" (Decorator ~"\s*")* (~"async[ \t]+")? ~"def[ \t]+" Name S Brack? S Paren S ("->" Type)? ":" Body
Decorator <- "@" (String / Paren / ~"[^\n(\"']+")* ~"\r?\n"
Type <- (String / Brack / Paren / ~"[^\[\](){}\"':\n]+")+
Body <- (~"[ \t\r\n\\]+" / Hash)* Doc? 
Doc: <- Text (~"[ \t]*" Text)* &End
Text: <- ~"[rRuU]?" (~"\"{3}(?:[^\"\\]|\\[\s\S]|\"(?!\"\"))*\"{3}" / ~"'{3}(?:[^'\\]|\\[\s\S]|'(?!''))*'{3}" / ~"\"(?:[^\"\\\n]|\\[\s\S])*\"" / ~"'(?:[^'\\\n]|\\[\s\S])*'")
End <- ~"[ \t]*(?:#|;|\r?\n|\Z)"
Hash <- ~"#[^\n]*"
String <- ~"[rRbBuUfFtT]{0,2}" (~"\"{3}(?:[^\"\\]|\\[\s\S]|\"(?!\"\"))*\"{3}" / ~"'{3}(?:[^'\\]|\\[\s\S]|'(?!''))*'{3}" / ~"\"(?:[^\"\\\n]|\\[\s\S])*\"" / ~"'(?:[^'\\\n]|\\[\s\S])*'")
Inner <- String / Hash / Paren / Brack / Brace / ~"[^()\[\]{}\"'#]+?(?=[()\[\]{}\"'#]|[rRbBuUfFtT]{1,2}[\"'])" / ~"[^()\[\]{}\"'#]"
"""
    + _SHARED,
    "script": r"""
Chunk <- Docs Gap (Decorator Gap)* (~"export\b" Gap (~"default\b" Gap)?)? (Function / Variable / Assigned / Method)
Decorator <- ~"@[\w.$]+" Gap Paren?
Function <- (~"declare\b" Gap)? (~"async\b" Gap)? ~"function\b" Gap ~"\*?" Gap Name? Gap Angle? Gap Paren
Variable <- ~"(?:const|let|var)\b" Gap Name Gap (":" ~"[^=;]*(?:=>[^=;]*)*")? "=" Gap Value
Assigned <- ~"(?:module\.)?exports(?:\.[\w$]+)?|[\w$.]+\.prototype\.[\w$]+|[\w$]+(?:\.[\w$]+)+" Gap "=" Gap Value
Value <- (~"async\b" Gap)? (~"function\b" / Arrow)
Arrow <- (Angle? Gap Paren Gap (":" ~"[^={;]*(?:\{[^{}]*\})?[^={;]*")? / ~"[\w$]+" Gap) "=>"
Method <- (~"(?:public|private|protected|static|async|override|abstract|readonly|get|set|declare)\b(?!\s*[(<=?:])" Gap)* ~"\*?" Gap !Other (Name / ~"#[\w$]+" / Brack / String) ~"\??" Gap Angle? Gap Paren
Other <- ~"(?:class|interface|enum|type|namespace|if|for|while|switch|return|new|throw|import|function|catch|do|else|try|super|await|typeof|const|let|var)\b"
"""
    + _C_SHARED,
    "go": r"""
Chunk <- Docs Gap ~"func\b" Gap (Paren Gap)? Name Gap Brack? Gap Paren
"""
    + _C_SHARED,
    "java": r"""
Chunk <- Docs Gap (Annotation Gap)* (Modifier Gap)* (Angle Gap)? !Kind (Type Gap)? !Kind Name Gap Paren
Annotation <- ~"@(?!interface)[\w.$]+" (~"[ \t]*" Paren)?
Modifier <- ~"(?:public|private|protected|static|final|abstract|synchronized|native|default|strictfp|transient|inline|extern|const|unsigned|signed|struct)\b" / Annotation
Kind <- ~"(?:class|interface|enum|record|new|return|if|for|while|switch|throw|import|package|else|do|try|catch|super|this)\b"
Type <- ~"[^\W\d][\w$.:]*" Gap Angle? (Gap Brack)* ~"(?:[ \t]*[*&]+|\.{3})?" &(Gap ~"[^\W\d]")
"""
    + _C_SHARED,
    "rust": r"""
Chunk <- Docs Gap (Attribute Gap)* (~"pub\b" Gap (Paren Gap)?)? (~"(?:default|const|async|unsafe|extern)\b" Gap (String Gap)?)* ~"fn\b" Gap Name Gap Angle? Gap Paren
Attribute <- ~"#!?" Brack
"""
    + _C_BASE
    + r"""
String <- ~"\"(?:[^\"\\]|\\[\s\S])*\"" / ~"'(?:[^'\\\n]|\\[^'\n]+|\\')'" / ~"'[^\W\d]\w*"
""",
    "php": r"""
Chunk <- Docs Gap (~"#" Brack Gap)* (~"(?i:public|private|protected|static|final|abstract|readonly)\b" Gap)* ~"(?i:function)\b" Gap ~"&?" Gap Name Gap Paren
"""
    + _C_SHARED,
    "swift": r"""
Chunk <- Docs Gap (~"@\w+" Paren? Gap)* (~"(?:public|private|fileprivate|internal|open|static|class|final|override|mutating|nonmutating|nonisolated|convenience|required)\b" Gap)* ~"func\b" Gap Name Gap Angle? Gap Paren
"""
    + _C_SHARED,
    "ruby": r"""
Chunk <- ~"\s*" Docs ~"\s*def[ \t]+(?:self\.)?" Name
Docs: <- (~"\s*" Comment)*
Comment: <- ~"#[^\n]*(?:\r?\n[ \t]*#[^\n]*)*"
"""
    + _SHARED.partition("Paren <-")[0],
}
_PEGS: dict[str, Peg] = {}
FAMILY = {"python": "python", "javascript": "script", "typescript": "script", "go": "go", "java": "java", "c": "java", "cpp": "java", "csharp": "java", "kotlin": "java", "rust": "rust", "php": "php", "swift": "swift", "ruby": "ruby"}

_TOOL = re.compile(
    r"(?ix)^\W*(?:eslint|tslint|jshint|jslint|prettier|stylelint|biome|istanbul|c8|v8|webpack\w*|@ts-|ts-(?:ignore|nocheck|expect)|@flow|nolint|lint:|go:|\+build|noinspection|nosonar|nosec|sonar|checkstyle|spotbugs|suppress|pmd|formatter:|"
    r"noqa|pylint|flake8|mypy|type:\s*ignore|pragma|fmt:|isort|yapf|black:|ruff|pyright|coverage|bandit|clang-|cppcheck|codeql|codecov|region|endregion|vim:|-\*-|jscpd|deepsource|skipcq|@formatter|language=|@suppress\w*|@generated|@internal|@ignore|\#__pure__)"
)
_LICENCE = re.compile(r"(?i)copyright|\(c\)\s*\d{4}|spdx-|licen[sc]ed?\b.{0,40}(?:under|mit|apache|gpl|bsd|mpl)|all rights reserved|许可|版权|permission is hereby granted|redistribution and use")
_PLACEHOLDER = re.compile(
    r"(?ix)^\W*(?:todo|fixme|xxx|hack|tbd|wip|deprecated\.?\W*$|undocumented|no\ (?:doc|description)|n/a|placeholder|待补充|待办|暂无|此处|自动生成|请补充|请填写|在此|待完善|"
    r"(?:add|write|insert|fill\ in|put|enter|provide|describe|document|complete|update|missing|needs?|your)\b.{0,25}\b(?:doc|docs|documentation|docstring|description|summary|comment|here|this\ (?:function|method))|"
    r"(?:documentation|description|docstring|docs?|summary|comment)\b.{0,20}\b(?:here|goes|pending|missing|needed|tbd|to\ follow|later|todo|wanted)|"
    r"auto[-\ ]?generated\ (?:method|function|constructor|catch|stub|doc)|please\ (?:add|write|fill|describe|document|replace|provide|complete)|replace\ this\ (?:text|comment)|generated\ (?:method|stub)|lorem\ ipsum|\{@inheritdoc\}|@inheritdoc|@see\b|see\ (?:above|below|docs?)\b|description\ of)"
)
_TAG = re.compile(r"(?i)^\s*(?:[@\\](?:param|arg|argument|return|returns|throws|exception|type|typedef|template|see|since|author|version|deprecated|private|public|protected|internal|async|static|override|inheritdoc|memberof|class|function|method|name|default|example|todo|yields?|raises?|prop|property|callback|this|readonly|access|ignore|hidden|category|module|export)\b|:(?:param|type|return|returns|rtype|raises?|arg|keyword|var|ivar|yields?|meta)\b)")
_SECTION = re.compile(r"(?i)^\s*(?:args|arguments|parameters|params|returns?|yields?|raises|throws|keyword args|other parameters|attributes|examples?|see also|references|参数|返回值?|inputs?|outputs?|errors?|exceptions?)\s*[:：]?\s*$")
_FIELD = re.compile(r"^\s*[-*•]?\s*`?\*{0,2}[\w.$]+`?\s*(?:\([^)]*\))?\s*(?::|--?|–|—)\s")
_CODE = re.compile(
    r"[;{]\s*$|^\s*[})\]]+[;,]?\s*$|^\s*(?:return|if|for|while|switch|const|let|var|import|from|raise|throw|await|try|catch|else|elif|except|break|continue|print|defer|func|def|class|public|private|export|assert|del|pass)\b.*[=(){};:]|^\s*[\w.$\[\]\"']+\s*(?::=|[-+*/|&]?=(?!=))\s*\S|^\s*[\w.$]+\([^)]*\)\s*[;.]?\s*$|=>|\b\w++\(.*\)\s*;|;\s*\w+\s*="
)
_HAN = re.compile(r"[㐀-鿿]")
_WORD = re.compile(r"[^\W\d_]+(?:['’][^\W\d_]+)?")
_STOP = set("a an the this that these those it its is are was be been being to of for from in on at by with and or as if not no do does did function method func def class object value given which when will can may so".split())


def _words_of_name(name: str) -> set[str]:
    parts = re.findall(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+|[㐀-鿿]+", name)
    return {_stem(p.lower()) for p in parts}


def _stem(w: str) -> str:
    for end in ("ings", "ing", "ies", "ied", "ers", "er", "ors", "or", "es", "ed", "s", "e", "y"):
        if w.endswith(end) and len(w) - len(end) >= 3:
            return w[: -len(end)]
    return w


def _lines(comment: str, python: bool) -> list[str]:
    """The lines of a comment or docstring without its marks."""
    if python:
        body = re.sub(r"^[rRuU]?(\"{3}|'{3}|\"|')", "", comment)
        body = re.sub(r"(\"{3}|'{3}|\"|')$", "", body)
        return body.split("\n")
    if comment.startswith("/*"):
        return [re.sub(r"^\s*\*+(?!\S*\*)[ ]?|^\s*\*(?=\s|$)", "", x) for x in re.sub(r"^/\*+!?|\**/$", "", comment).split("\n")]
    return [re.sub(r"^\s*(?://+[/!]?|#+)", "", x) for x in comment.split("\n")]


def description(lines: list[str], name: str) -> str:
    """The prose of a documentation text; '' where nothing is left that says what the function does."""
    kept: list[str] = []
    section = False
    indent = 0
    for raw in lines:
        line = raw.rstrip()
        text = line.strip()
        if not text or not re.search(r"\w", text):
            if not text:
                section = False if indent == 0 else section
            continue
        depth = len(line) - len(line.lstrip())
        if _SECTION.match(text) or re.match(r"^-{3,}$", text):
            section, indent = True, depth
            continue
        if section and (depth > indent or _FIELD.match(text)):
            continue
        section = False
        if _TAG.match(text):
            section, indent = True, depth
            continue
        if _TOOL.match(text):
            continue
        text = re.sub(r"(?i)\{@(?:link|code|linkplain|literal)\s+([^}]*)\}", r"\1", text)
        if _PLACEHOLDER.match(text) or "{@inheritDoc}" in text:
            if re.match(r"(?i)^\W*(?:todo|fixme|xxx|hack)", text):
                break
            continue
        if _CODE.search(text) and not _HAN.search(text) and not re.match(r"^[A-Z][a-z]+ [a-z]+ .*[a-z]\.$", text):
            continue
        if _FIELD.match(text) and len(_WORD.findall(text)) < 8 and re.match(r"^\s*[-*•]?\s*`?[a-z_$][\w$]*`?\s*(?:\([^)]*\))?\s*(?::|--|–)", text):
            continue
        kept.append(text)
    out = " ".join(kept)
    body = re.sub(r"<[^>]*>|https?://\S+", " ", out)
    if name:
        body = re.sub(rf"^\W*{re.escape(name)}\b[\s:：()-]*", "", body, flags=re.I)
    words = [w.lower() for w in _WORD.findall(_HAN.sub(" ", body))]
    said = _words_of_name(name)
    new = [w for w in words if w not in _STOP and _stem(w) not in said]
    han = len(_HAN.findall(body))
    if han >= MIN_HAN or (han >= 4 and len(words) + han // 2 >= MIN_WORDS + 2):
        return out
    return out if len(words) >= MIN_WORDS and len(new) >= 2 else ""


def documented(content: str | None, lang: str | None) -> tuple[str, str, int, int] | None:
    """(name, description, start, end of the documentation) of a chunk's own function, or None."""
    family = FAMILY.get(lang or "")
    if not content or family is None:
        return None
    if family not in _PEGS:
        _PEGS[family] = Peg(GRAMMARS[family])
    if family == "python":
        if '"' not in content and "'" not in content:
            return None
    elif not content.lstrip("﻿ \t\r\n").startswith("#" if family == "ruby" else "/"):
        return None
    content = content.removeprefix("﻿")
    try:
        kept = _PEGS[family].parse(content)
    except RecursionError:  # brackets nested hundreds deep: a level is some dozen calls and at least one character
        limit = sys.getrecursionlimit()
        sys.setrecursionlimit(limit + 1000 + 30 * len(content))
        try:
            kept = _PEGS[family].parse(content)
        finally:
            sys.setrecursionlimit(limit)
    if kept is None:
        return None
    docs = [(a, b) for r, a, b in kept if r == ("Text" if family == "python" else "Comment")]
    if not docs:
        return None
    name = next((content[a:b] for r, a, b in kept if r == "Name"), "")
    docs = [(a, b) for a, b in docs if not _LICENCE.search(content, a, b)]
    if not docs:
        return None
    lines = [x for a, b in docs for x in [*_lines(content[a:b], family == "python"), ""]]
    text = description(lines, name)
    return (name, text, docs[0][0], docs[-1][1]) if text else None


def pairs(chunks: DataFrame) -> DataFrame:
    """(repository_id, file_path, chunk_index, name, description, code, doc_start, doc_end) of the documented functions."""
    by_name = language(F.col("file_path"))
    own = F.when(by_name.isin(*FAMILY), by_name).otherwise(F.lower(F.trim("language")))
    src = chunks.where(F.lower(F.trim("symbol_type")).isin("function", "method", "export")).select("repository_id", "file_path", "chunk_index", own.alias("language"), "content")
    schema = "repository_id string, file_path string, chunk_index int, name string, description string, code string, doc_start int, doc_end int"

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [pa.string(), pa.string(), pa.int32(), pa.string(), pa.string(), pa.string(), pa.int32(), pa.int32()]
        names = [x.split()[0] for x in schema.split(", ")]
        for b in batches:
            rows = []
            for repo, path, index, lang, text in zip(*(b.column(i).to_pylist() for i in range(5)), strict=True):
                if got := documented(text, lang):
                    name, words, a, e = got
                    rows.append((repo, path, index, name, words, text[:a] + text[e:], a, e))
            cols = list(zip(*rows, strict=True)) or [()] * 8
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names)

    return src.mapInArrow(extract, schema)


def documented_functions(chunks: DataFrame) -> DataFrame:
    """Distinct keys of the chunks whose function has informative documentation of its own."""
    return pairs(chunks).select("repository_id", "file_path", "chunk_index").distinct()
