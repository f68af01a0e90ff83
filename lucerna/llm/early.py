"""Early errors of scripts: what the grammar of a script derives and the language still refuses.

The check walks the tokens of one accepted text with a stack of brackets.  A brace is a block
of a known statement, a function's body, or of unknown kind (objects, classes, bodies behind a
return type); where a brace of unknown kind could make a construct valid it counts as valid.
"""

from __future__ import annotations

NUM, STR, TEMPLATE, REGEX = "0", '"', "`", "/re/"
_LOOPS = {"for", "while"}
_HEADS = {"if", "with", "catch", *_LOOPS}
_BLOCKS = {"else", "try", "finally", "catch"}
_GOES_ON = {"else", "catch", "finally", "while"}
_FIXED = {NUM, STR, TEMPLATE, "true", "false", "null"}
_ASSIGN = {"=", "+=", "-=", "*=", "%=", "**=", "<<=", "&=", "|=", "^=", "&&=", "||=", "??="}


class _Scope:
    """A bracket: what opened it, the word before its head, and the names it declares."""

    __slots__ = ("bracket", "kind", "head", "lexical", "other", "begun")

    def __init__(self, bracket: str, kind: str, head: str, begun: int) -> None:
        self.bracket, self.kind, self.head, self.begun = bracket, kind, head, begun
        self.lexical: set[str] = set()
        self.other: set[str] = set()


def _brace(prev: str, closed: str, at: _Scope) -> str:
    """Kind of a brace: block, loop, switch, function or '' for unknown."""
    if prev == ")":
        return "loop" if closed in _LOOPS else "switch" if closed == "switch" else "block" if closed in _HEADS else "function"
    if prev == "=>":
        return "function"
    if prev == "do":
        return "loop"
    if prev in _BLOCKS or prev in ("", ";") or prev in ("{", "}") and at.kind:
        return "block"
    return ""


def early_error(tokens: list[str], typed: bool) -> bool:
    """Whether a text refused by the language: return, break or continue outside of what they leave, a constant without a
    value, a lexical name declared twice in a scope, a value that is assigned to.

    tokens: names, words, brackets and operators as written; other tokens by their mark.  Of the typed dialect
    only jumps are checked, since ambient declarations and literal types have the shape of the other errors.
    """
    stack = [_Scope("", "top", "", 0)]
    closed = prev = before = ""
    n = len(tokens)
    for i, t in enumerate(tokens):
        at = stack[-1]
        nxt = tokens[i + 1] if i + 1 < n else ""
        if t in ("(", "[", "{"):
            kind = _brace(prev, closed, at) if t == "{" else ""
            word = prev if prev != "await" else before
            stack.append(_Scope(t, kind, word, i + 1))
        elif t in (")", "]", "}"):
            if len(stack) > 1:
                closed = stack.pop().head
            if t == "}" and nxt not in _GOES_ON:
                stack[-1].begun = i + 1
        elif t == ";":
            at.begun = at.begun if nxt in _GOES_ON else i + 1
        elif prev in (".", "?.", "function") or nxt == ":" and t != "default":
            pass  # a property's name, a label or a type's
        elif t == "return":
            if nxt not in ("(", "=", ",") and all(s.kind in ("top", "block", "loop", "switch") for s in stack if s.bracket in ("", "{")) and stack[-1].bracket in ("", "{"):
                return True
        elif t in ("break", "continue"):
            if nxt in (";", "}", "") and not _leaves(stack, tokens, i, t):
                return True
        elif not typed and at.kind:
            if t in ("const", "let", "class", "var", "function") and (nxt[:1].isalpha() or nxt[:1] in "_$") and prev not in ("=", "(", ",", ":", "?", "=>", "return", "default", "async"):
                if t == "const" and at.bracket != "(" and nxt != "enum" and i + 2 < n and tokens[i + 2] in (";", ",", "}"):
                    return True
                if t == "const" and i + 2 == n:
                    return True
                if nxt in at.lexical or t in ("const", "let", "class") and nxt in at.other:
                    return True
                (at.lexical if t in ("const", "let", "class") else at.other).add(nxt)
            elif t in _ASSIGN and prev in _FIXED and not (before == "." or tokens[i - 2 : i - 1] == ["?."]):
                return True
        before, prev = prev, t
    return False


def _leaves(stack: list[_Scope], tokens: list[str], i: int, word: str) -> bool:
    """Whether a loop or switch, or something of unknown kind, is around a jump without a label."""
    for s in reversed(stack):
        if s.bracket in ("(", "[") or s.kind in ("", "loop") or s.kind == "switch" and word == "break":
            return True
        # a loop without braces around what stands here
        if any(t in ("for", "while", "do") for t in tokens[s.begun : i]):
            return True
        if s.kind in ("function", "top"):
            return False
    return False
