"""Tokens, bracket structure and block structure of the checked languages, and the file verdict."""

from __future__ import annotations

import re

from . import early
from . import grammars as G
from .gll import Grammar

_SCRIPT_TOKEN = re.compile(
    r"((?>(?:[^\S\n\r  ]+|[\n\r  ]+|//[^\n\r  ]*|/\*(?:[^*]|\*(?!/))*\*/)*))"
    r"(?:([A-Za-z_$][\w$‌‍]*|(?:\\u\{?[0-9a-fA-F]+\}?|[^\W\d])[\w$‌‍]*)"
    r"|((?:0[xX][\da-fA-F_]+|0[oO][0-7_]+|0[bB][01_]+|(?:\d[\d_]*\.?[\d_]*|\.\d[\d_]*)(?:[eE][+-]?[\d_]+)?)n?(?![\w$]))"
    r"|(\"(?:[^\"\\\n\r]|\\(?:\r\n|[\s\S]))*\"|'(?:[^'\\\n\r]|\\(?:\r\n|[\s\S]))*')"
    r"|(#[^\W\d][\w$]*)"
    r"|(===|!==|\*\*=|<<=|&&=|\|\|=|\?\?=|\.\.\.|=>|==|!=|<=|>=|&&|\|\||\?\?|\?\.(?!\d)|\+\+|--|\+=|-=|\*=|%=|&=|\|=|\^=|<<|\*\*|[{}()\[\];,<>+\-*%&|^!~?:=.@]))"
)
_REGEX = re.compile(r"/(?![*/])(?:[^\n\r\\/\[]|\\[^\n\r]|\[(?:[^\n\r\\\]]|\\[^\n\r])*\])+/[\w$]*")
_JAVA_TOKEN = re.compile(
    r"((?>(?:\s+|//[^\n\r]*|/\*(?:[^*]|\*(?!/))*\*/)*))"
    r"(?:([^\W\d][\w$]*|\$[\w$]*)"
    r"|((?:0[xX][\da-fA-F_.]+(?:[pP][+-]?\d+)?|0[bB][01_]+|(?:\d[\d_]*\.?[\d_]*|\.\d[\d_]*)(?:[eE][+-]?[\d_]+)?)[lLfFdD]?(?![\w$]))"
    r"|(\"\"\"[^\S\n\r]*\r?\n(?:[^\"\\]|\\[\s\S]|\"(?!\"\"))*\"\"\"|\"(?!\"\")(?:[^\"\\\n\r]|\\.)*\"|\"\"(?!\"))"
    r"|('(?:[^'\\\n\r]|\\u+[\da-fA-F]{4}|\\[0-7]{1,3}|\\.)'|'[\ud800-\udbff][\udc00-\udfff]')"
    r"|(\.\.\.|<<=|->|::|\+\+|--|&&|\|\||==|!=|<=|>=|\+=|-=|\*=|/=|&=|\|=|\^=|%=|<<|[{}()\[\];,<>+\-*/%&|^!~?:=.@]))"
)
_GO_TOKEN = re.compile(
    r"((?>(?:[^\S\n]+|\n|//[^\n]*|/\*(?:[^*]|\*(?!/))*\*/)*))"
    r"(?:([^\W\d]\w*)"
    r"|((?:0[xX][\da-fA-F_.]+(?:[pP][+-]?\d+)?|0[bB][01_]+|0[oO][0-7_]+|(?:\d[\d_]*\.?[\d_]*|\.\d[\d_]*)(?:[eE][+-]?[\d_]+)?)i?(?!\w))"
    r"|(`[^`]*`|\"(?:[^\"\\\n]|\\[^\n])*\")"
    r"|('(?:[^'\\\n]|\\(?:x[\da-fA-F]{2}|u[\da-fA-F]{4}|U[\da-fA-F]{8}|[0-7]{3}|[^\n]))')"
    r"|(<<=|>>=|&\^=|\.\.\.|&&|\|\||<-|\+\+|--|==|!=|<=|>=|:=|\+=|-=|\*=|/=|%=|&=|\|=|\^=|<<|>>|&\^|[{}()\[\];,<>+\-*/%&|^!=:.~]))"
)
_JSON_TOKEN = re.compile(
    r"((?>[ \t\n\r]*))(?:(true|false|null)\b|(-?(?:0|[1-9]\d*)(?:\.\d+)?(?:[eE][+-]?\d+)?(?![\w.]))|(\"(?:[^\"\\\x00-\x1f]|\\(?:[\"\\/bfnrt]|u[\da-fA-F]{4}))*\")|(?!)()|([{}\[\]:,]))"
)
_TAIL = {
    "script": re.compile(r"(?:\s+|﻿|//[^\n\r]*|/\*(?:[^*]|\*(?!/))*\*/|<!--[^\n]*)*\Z"),
    "java": re.compile(r"(?:\s+|//[^\n\r]*|/\*(?:[^*]|\*(?!/))*\*/|\x1a)*\Z"),
    "go": re.compile(r"(?:\s+|//[^\n]*|/\*(?:[^*]|\*(?!/))*\*/)*\Z"),
    "json": re.compile(r"[ \t\n\r]*\Z"),
}
_CLOSE = {")": "(", "]": "[", "}": "{"}
#: Rules that derive every row of texts each of which they derive; others are never recognised in pieces.
_JOINED = frozenset(("Script", "Module", "Block", "ClassBody", "File", "Tops", "Fields", "Iface", "Specs", "VSpecs", "TSpecs"))


def _comma_list(g: Grammar, items: dict, rules: tuple[str, ...], s: str, comma: str) -> frozenset:
    """The rules that derive a long list because one item rule derives each piece; the rest is for derive() to decide.

    items: rule -> (item rules, whether a comma may end the list). What this names, derive() names too.
    """
    if s.count(comma) <= 6:
        return frozenset()
    pieces = s.split(comma)
    ended = pieces[-1] == ""
    if ended:
        pieces.pop()
    done = set()
    for rule in rules:
        alternatives, trailing = items.get(rule, ((), False))
        if (trailing or not ended) and any(all(p and g.derive((item,), p) for p in pieces) for item in alternatives):
            done.add(rule)
    return frozenset(done)


class Brackets:
    """A language whose structure is brackets, separators and semicolons."""

    def __init__(self, text, classes, token, tail, tops, inside, items, breaks=False, slash=False, auto=False, markup=False) -> None:
        self.g = Grammar(text, classes)
        self.token, self.tail, self.tops, self.breaks, self.slash, self.auto = token, _TAIL[tail], tops, breaks, slash, auto
        #: bracket -> (rules joined by nothing, rules joined by commas, others)
        self.inside, self.items = inside, items
        k = self.g.kinds
        for x in "()[]{}":
            k.literal(x)
        self.name, self.num, self.str = (k.literal(x) for x in ("NAME", "NUM", "STR"))
        self.semi, self.comma = k.literal(";"), k.literal(",")
        self.glue = {k.literal(x) for x in ("else", "catch", "finally", "while")}
        self.heads = {k.literal(x) for x in ("if", "for", "switch")} if auto else set()
        self.colon = k.literal(":")
        #: after these a slash begins a regular expression
        self.operand = {self.name, self.num, self.str} | {k.literal(x) for x in ("this", "super", "null", "true", "false", "TEMPLATE", "REGEX", "PRIV", "++", "--", ")", "]", "}")}
        if slash:
            self.operand |= {k.literal(x) for x in G._WORDS + G._TWORDS} - {k.literal(x) for x in ("of", "await", "yield")}
        self.ends = {self.name, self.num, self.str} | {k.literal(x) for x in ("CHAR", ")", "]", "}", "break", "continue", "fallthrough", "return", "++", "--")} if auto else set()
        self.k = dict(k.of)
        self.markup, self.typed = markup, "TArgs" in self.g.start
        #: ends of the embedded expressions of the text at hand, and the tokens of each accepted part of it
        self.nested: dict = {}
        self.parts: list[list[str]] = []
        self.odd = {c: chr(ord(c) | 1) for c in self.k.values()}
        self.gmemo: dict = {}

    def _split(self, s: str) -> list[str]:
        """Pieces that end where a statement or member most likely ends."""
        out, a, groups, n = [], 0, self.g.kinds.groups, len(s)
        semi, glue, heads = self.semi, self.glue, self.heads
        brace = self.brace
        head = braced = False
        for i, ch in enumerate(s):
            c = chr(ord(ch) & ~1)
            if i == a:
                head, braced = c in heads, False
            if c == semi:
                if head and not braced:
                    continue
                if i + 1 < n and chr(ord(s[i + 1]) & ~1) in glue:
                    continue
                out.append(s[a : i + 1])
                a = i + 1
            elif c in groups and c in brace:
                braced = True
                if not self.auto and i + 1 < n:
                    nxt = s[i + 1]
                    if (ord(nxt) & 1 or not self.breaks) and chr(ord(nxt) & ~1) not in glue and chr(ord(nxt) & ~1) in self.openers:
                        out.append(s[a : i + 1])
                        a = i + 1
        if a < n:
            out.append(s[a:])
        return out

    def _group(self, bracket: str, s: str) -> str:
        key = (bracket, s)
        got = self.gmemo.get(key)
        if got is not None:
            return got
        g, (stmts, lists, others) = self.g, self.inside[bracket]
        rules: frozenset = frozenset()
        if stmts:
            rules |= g.lists(stmts, s, self._split(s))
        if lists and self.semi not in s:
            left = _comma_list(g, self.items, lists, s, self.comma)
            rules |= left
            rest = tuple(r for r in lists if r not in left)
            if rest:
                rules |= g.derive(rest, s)
        if others:
            rules |= g.derive(others, s)
        c = g.kinds.group(rules)
        if bracket == "{":
            self.brace.add(c)
        if len(self.gmemo) > 300_000:
            self.gmemo.clear()
        self.gmemo[key] = c
        return c

    brace: set
    openers: set

    def accepts(self, text: str, regex_after_bracket: bool = False) -> bool:
        self.nested.clear()
        self.parts.clear()
        return self._parse(text, 0, self.tops, regex_after_bracket) >= 0 and not any(early.early_error(p, self.typed) for p in self.parts)

    def _parse(self, text: str, pos: int, tops: tuple[str, ...], regex_after_bracket: bool, inner: bool = False) -> int:
        """End of what tops derive: the end of the text, or of the inner part the place after its closing brace; -1 if they derive nothing."""
        kinds, name = self.k, self.name
        num, strk = self.num, self.str
        char = kinds.get("CHAR", strk)
        breaks, slash, auto = self.breaks, self.slash, self.auto
        stack: list = []
        cur: list[str] = []
        seen: list[str] = []
        n, prev, at = len(text), "", "(" if inner else "{"
        closed_head = False
        scan = self.token.scanner(text, pos).match
        odd, semi, ends, before_cond, private = self.odd, self.semi, self.ends, self.before_cond, kinds.get("PRIV", char)
        group, gmemo, get = self._group, self.gmemo, kinds.get
        while True:
            m = scan()
            if m is None:
                if slash:
                    gap = _SCRIPT_SKIP.match(text, pos)
                    p = gap.end()
                    if p < n and text[p] in "/`":
                        nl = breaks and at == "{" and ("\n" in gap[0] or "\r" in gap[0])
                        if text[p] == "`":
                            pos, c = self._template(text, p, regex_after_bracket), kinds["TEMPLATE"]
                            if pos < 0:
                                return -1
                        elif self._after_operand(prev, closed_head, regex_after_bracket):
                            c = kinds["/="] if text.startswith("/=", p) else kinds["/"]
                            pos = p + (2 if c == kinds["/="] else 1)
                        else:
                            m = _REGEX.match(text, p)
                            if not m:
                                return -1
                            pos, c = m.end(), kinds["REGEX"]
                        prev = c
                        seen.append(early.TEMPLATE if text[p] == "`" else "/" if c == kinds["/"] else "/=" if c == kinds["/="] else early.REGEX)
                        cur.append(chr(ord(c) | 1) if nl else c)
                        scan = self.token.scanner(text, pos).match
                        continue
                if inner or not self.tail.match(text, pos):
                    return -1
                break
            kind = m.lastindex
            if auto and prev in ends and "\n" in m[1]:
                cur.append(semi)
            if slash:
                seen.append(m[kind] if kind in (2, 6) else early.STR if kind == 4 else early.NUM if kind == 3 else "#")
            if kind == 2:
                c = get(m[2], name)
            elif kind == 6:
                p = m[6]
                if p == "<" and self.markup and not self._after_operand(prev, closed_head, regex_after_bracket):
                    end = self._markup(text, m.start(6), regex_after_bracket)
                    if end >= 0:
                        pos, prev = end, kinds["REGEX"]
                        seen[-1] = early.REGEX
                        cur.append(odd[prev] if breaks and at == "{" and "\n" in m[1] else prev)
                        scan = self.token.scanner(text, pos).match
                        continue
                if p in "([{":
                    stack.append((at, cur, breaks and at == "{" and "\n" in m[1], closed_head, prev in before_cond))
                    at, cur, prev = p, [], kinds[p]
                    pos = m.end()
                    continue
                if p in ")]}":
                    if inner and not stack and p == "}":
                        pos = m.end()
                        break
                    if not stack or _CLOSE[p] != at:
                        return -1
                    body = "".join(cur)
                    c = gmemo.get((at, body)) or group(at, body)
                    at, cur, nl, _, closed_head = stack.pop()
                    cur.append(chr(ord(c) | 1) if nl else c)
                    prev = kinds[p]
                    pos = m.end()
                    continue
                c = get(p)
                if c is None:
                    return -1
            elif kind == 4:
                c = strk
            elif kind == 3:
                c = num
            else:
                c = private if slash else char
            pos = m.end()
            prev = c
            if breaks and at == "{" and "\n" in m[1]:
                c = odd[c]
            cur.append(c)
        if stack:
            return -1
        s = "".join(cur)
        pieces = self._split(s) if _JOINED.issuperset(tops) else [s]
        if not self.g.lists(tops, s, pieces):
            return -1
        if slash:
            self.parts.append(seen[:-1] if inner else seen)
        return pos

    def _after_operand(self, prev: str, closed_head: bool, regex_after_bracket: bool) -> bool:
        """Whether a slash or '<' after the token is an operator."""
        close, brace = self.k[")"], self.k["}"]
        return prev in self.operand and not (closed_head and prev == close) and not (regex_after_bracket and prev in (close, brace))

    def _inner(self, text: str, pos: int, tops: tuple[str, ...], regex_after_bracket: bool) -> int:
        """_parse() of an embedded expression, in either reading of a slash; each place is parsed once."""
        for again in (False, True) if regex_after_bracket else (False,):
            key = (text, pos, tops, again)
            end = self.nested.get(key)
            if end is None:
                end = self.nested[key] = self._parse(text, pos, tops, again, True)
            if end >= 0:
                return end
        return -1

    def _template(self, text: str, p: int, regex_after_bracket: bool) -> int:
        """End of the template literal at p with its embedded expressions parsed; -1 if it has none."""
        n = len(text)
        i = p + 1
        while i < n:
            ch = text[i]
            if ch == "\\":
                i += 2
            elif ch == "`":
                return i + 1
            elif ch == "$" and text.startswith("${", i):
                i = self._inner(text, i + 2, ("Expr",), regex_after_bracket)
                if i < 0:
                    return -1
            else:
                i += 1
        return -1

    def _markup(self, text: str, p: int, regex_after_bracket: bool) -> int:
        """End of the JSX element or fragment at p with its attributes, texts and embedded expressions; -1 if it has none."""
        n, tags, skip = len(text), [], _SCRIPT_SKIP.match
        while True:
            p = skip(text, p + 1).end()
            closing = text.startswith("/", p)
            if closing:
                p = skip(text, p + 1).end()
            m = _TAG.match(text, p)
            tag = re.sub(r"\s", "", m[0]) if m else ""
            p = skip(text, m.end() if m else p).end()
            if not closing and tag:
                p = self._attributes(text, p, regex_after_bracket)
                if p < 0:
                    return -1
            if not closing and tag and text.startswith("/", p):
                p = skip(text, p + 1).end()
            elif not closing:
                tags.append(tag)
            elif not tags or tags.pop() != tag:
                return -1
            if not text.startswith(">", p):
                return -1
            p += 1
            if not tags:
                return p
            while p < n and text[p] != "<":
                if m := _MARKUP_TEXT.match(text, p):
                    p = m.end()
                elif text[p] != "{" or (p := self._inner(text, p + 1, ("Hole", "Expr"), regex_after_bracket)) < 0:
                    return -1
            if p >= n:
                return -1

    def _attributes(self, text: str, p: int, regex_after_bracket: bool) -> int:
        """The place after the type arguments and attributes at p; -1 if one of them is broken."""
        skip = _SCRIPT_SKIP.match
        if self.typed and text.startswith("<", p):
            depth, a = 0, p
            for m in _ANGLE.finditer(text, p):
                depth += (m[0] == "<") - (m[0] == ">")
                if not depth:
                    p = m.end()
                    break
            if depth or self._parse(text[a:p], 0, ("TArgs",), False) < 0:
                return -1
        while True:
            p = skip(text, p).end()
            if text.startswith("{", p):
                p = self._inner(text, p + 1, ("Spreading",), regex_after_bracket)
            elif m := _ATTRIBUTE.match(text, p):
                p = skip(text, m.end()).end()
                if not text.startswith("=", p):
                    continue
                p = skip(text, p + 1).end()
                if text.startswith(('"', "'"), p):
                    p = text.find(text[p], p + 1) + 1 or -1
                elif text.startswith("{", p):
                    p = self._inner(text, p + 1, ("Expr",), regex_after_bracket)
                else:
                    p = self._markup(text, p, regex_after_bracket) if text.startswith("<", p) else -1
            else:
                return p
            if p < 0:
                return -1


_TAG = re.compile(r"(?:[^\W\d]|\$)[\w$-]*(?:(?:\s*\.\s*(?:[^\W\d]|\$)[\w$-]*)+|\s*:\s*(?:[^\W\d]|\$)[\w$-]*)?")
_ATTRIBUTE = re.compile(r"(?:[^\W\d]|\$)[\w$-]*(?:\s*:\s*(?:[^\W\d]|\$)[\w$-]*)?")
_MARKUP_TEXT = re.compile(r"[^{}<>]+")
_ANGLE = re.compile(r"=>|[<>]|\"(?:[^\"\\\n]|\\.)*\"|'(?:[^'\\\n]|\\.)*'")
_SCRIPT_SKIP = re.compile(r"(?:\s+|//[^\n\r  ]*|/\*(?:[^*]|\*(?!/))*\*/)*")
_GO_SKIP = re.compile(r"(?:\s+|//[^\n]*|/\*(?:[^*]|\*(?!/))*\*/)*")


def _script(text: str, typed: bool, markup: bool) -> Brackets:
    x = Brackets(
        text, G._JS_CLASSES, _SCRIPT_TOKEN, "script", ("Script", "Module"),
        {
            "{": (("Block", "ClassBody", *(("Module",) if typed else ())), ("Obj", "Names", *(("Enum",) if typed else ())), ("Switch", *(("TypeLit",) if typed else ()))),
            "(": ((), ("Args", "Paren", "Params", *(("PParen",) if typed else ())), ("ForHead", "CatchP")),
            "[": ((), ("Arr", "Index", "Computed", *(("Tuple", "TIndex") if typed else ())), ("IndexSig",) if typed else ()),
        },
        {
            "Obj": (("Prop",), True), "Names": (("NameAs",), True), "Enum": (("EItem",), True), "Args": (("Spread",), True), "Params": (("Param",), True),
            "Arr": (("Spread",), True), "Tuple": (("TElem",), True), "Paren": (("Assign",), False), "Index": (("Assign",), False),
        },
        breaks=True, slash=True, markup=markup,
    )
    return x


class Python:
    """Logical lines are recognised first, then blocks of line symbols, indentation being the bracket."""

    LINES = (
        "Simple", "IfH", "IfI", "ElifH", "ElifI", "ElseH", "ElseI", "LoopH", "LoopI", "TryH", "TryI", "ExceptH", "ExceptI",
        "FinH", "FinI", "DefH", "DefI", "Deco", "MatchH", "CaseH", "CaseI",
    )
    INSIDE = {"(": ("Paren", "Args", "Params", "Names", "WItems", "PSeq", "PArgs"), "[": ("Items", "Index", "TParams", "PSeq"), "{": ("Braces", "PMap")}
    ITEMS = {
        "Paren": (("StarExpr",), True), "Args": (("Arg",), True), "Items": (("StarExpr",), True), "Braces": (("Pair", "StarExpr"), True), "Index": (("Sub",), True), "Params": (("Param",), True),
    }
    _STR = r"[rRbBuUfFtT]{0,2}(?:'''(?:[^'\\]|\\[\s\S]|'(?!''))*'''|\"\"\"(?:[^\"\\]|\\[\s\S]|\"(?!\"\"))*\"\"\"|'(?!'')(?:[^'\\\n]|\\[\s\S])*'|''(?!')|\"(?!\"\")(?:[^\"\\\n]|\\[\s\S])*\"|\"\"(?!\"))"
    TOKEN = re.compile(
        r"((?>(?:[ \t\f]+|\\\r?\n)*))(?:(" + _STR + r")|([^\W\d]\w*)|((?:0[xX][\da-fA-F_]+|0[oO][0-7_]+|0[bB][01_]+|(?:\d[\d_]*\.?[\d_]*|\.\d[\d_]*)(?:[eE][+-]?[\d_]+)?[jJ]?)(?![^\W_a-z]))"
        r"|((?:#[^\n\r]*)?(?:\r?\n|\r|\Z))"
        r"|(\*\*=|//=|>>=|<<=|\.\.\.|!=|->|:=|==|<=|>=|\+=|-=|\*=|/=|%=|&=|\|=|\^=|@=|\*\*|//|<<|>>|[()\[\]{},:;.=+\-*/%@&|^~<>]))"
    )

    def __init__(self) -> None:
        self.g = Grammar(G.PYTHON, G.PYTHON_CLASSES)
        k = self.g.kinds
        self.k = dict(k.of)
        self.gmemo: dict = {}
        self.cont = {"ElifH", "ElifI", "ElseH", "ElseI", "ExceptH", "ExceptI", "FinH", "FinI", "Suite", "Cases"}

    def _inside(self, bracket: str, s: str) -> str:
        got = self.gmemo.get((bracket, s))
        if got is None:
            if len(self.gmemo) > 300_000:
                self.gmemo.clear()
            starts = self.INSIDE[bracket]
            left = _comma_list(self.g, self.ITEMS, starts, s, self.k[","])
            rest = tuple(r for r in starts if r not in left)
            got = self.gmemo[bracket, s] = self.g.kinds.group(left | self.g.derive(rest, s))
        return got

    def _line(self, s: str) -> str:
        got = self.gmemo.get(s)
        if got is None:
            if len(self.gmemo) > 300_000:
                self.gmemo.clear()
            got = self.gmemo[s] = self.g.kinds.group(self.g.derive(self.LINES, s))
        return got

    def _pieces(self, s: str) -> list[str]:
        out: list[str] = []
        groups, deco = self.g.kinds.groups, False
        for ch in s:
            rules = groups[ch]
            if out and (deco or rules & self.cont):
                out[-1] += ch
            else:
                out.append(ch)
            deco = "Deco" in rules
        return out

    def _suite(self, s: str) -> str:
        got = self.gmemo.get(("", s))
        if got is None:
            rules = self.g.lists(("Suite",), s, self._pieces(s)) | self.g.derive(("Cases",), s)
            got = self.gmemo["", s] = self.g.kinds.group(rules)
        return got

    def accepts(self, text: str) -> bool:
        if "\0" in text:
            return False
        kinds, scan, g = self.k, self.TOKEN.scanner(text).match, self.g
        name, num, strk = kinds["NAME"], kinds["NUM"], kinds["STR"]
        n = len(text)
        levels: list[tuple[int, list[str]]] = [(0, [])]
        brackets: list[tuple[str, list[str]]] = []
        cur: list[str] = []
        at, indent = "", 0
        while True:
            m = scan()
            if m is None:
                return False
            if not cur and not at:
                gap = m[1]
                indent = len(gap.partition("\\")[0].expandtabs(8)) if gap else 0
            kind = m.lastindex
            if kind == 3:
                cur.append(kinds.get(m[3], name))
            elif kind == 6:
                w = m[6]
                if w in "([{":
                    brackets.append((at, cur))
                    at, cur = w, []
                    if len(brackets) > 199:
                        return False
                elif w in ")]}":
                    if not at or _CLOSE[w] != at:
                        return False
                    c = self._inside(at, "".join(cur))
                    at, cur = brackets.pop()
                    cur.append(c)
                else:
                    c = kinds.get(w)
                    if c is None:
                        return False
                    cur.append(c)
            elif kind == 2:
                cur.append(strk)
            elif kind == 4:
                cur.append(num)
            else:  # end of a line or of the text
                if not at and cur:
                    c = self._line("".join(cur))
                    cur = []
                    rules = g.kinds.groups[c]
                    if not rules:
                        return False
                    width, lines = levels[-1]
                    if indent > width:
                        if not lines and len(levels) == 1:
                            return False
                        levels.append((indent, [c]))
                    else:
                        while indent < levels[-1][0]:
                            _, body = levels.pop()
                            levels[-1][1].append(self._suite("".join(body)))
                        if indent != levels[-1][0]:
                            return False
                        levels[-1][1].append(c)
                if m.end() >= n:
                    break
        if at:
            return False
        while len(levels) > 1:
            _, body = levels.pop()
            levels[-1][1].append(self._suite("".join(body)))
        s = "".join(levels[0][1])
        return bool(g.lists(("Block",), s, self._pieces(s)))


_PARSERS: dict = {}
#: jsx and tsx are the dialects with markup; tsx has no casts in angle brackets.
SCRIPTS = {"javascript": G.JAVASCRIPT, "typescript": G.TYPESCRIPT, "jsx": G.JAVASCRIPT, "tsx": G.TSX}


def parser(language: str):
    """The language's parser, built once a Python worker."""
    if language not in _PARSERS:
        if language == "python":
            _PARSERS[language] = Python()
            return _PARSERS[language]
        if language in SCRIPTS:
            x = _script(SCRIPTS[language], language in ("typescript", "tsx"), language in ("jsx", "tsx"))
            x.before_cond = {x.g.kinds.literal(w) for w in ("if", "while", "for", "with")}
        elif language == "java":
            x = Brackets(
                G.JAVA, G.JAVA_CLASSES, _JAVA_TOKEN, "java", ("File",),
                {
                    "{": (("Block", "ClassBody"), ("ArrInit", "ElemVals"), ("Switch", "EnumBody", "ModBody")),
                    "(": ((), ("Args", "Params", "LParams"), ("Paren", "ForHead", "CatchP", "Res", "CastType", "AnnArgs", "Patterns")),
                    "[": ((), (), ("Empty", "Index")),
                },
                {"ArrInit": (("ArrItem",), True), "ElemVals": (("ElemVal",), True), "Args": (("Expr",), False), "Params": (("Param",), False), "LParams": (("Param",), False)},
            )
        elif language == "go":
            x = Brackets(
                G.GO, G.GO_CLASSES, _GO_TOKEN, "go", ("Tops",),
                {
                    "{": (("Block", "Fields", "Iface"), ("Lit",), ("Switch",)),
                    "(": (("Specs", "VSpecs", "TSpecs"), ("Args", "Params"), ("Paren", "PType", "Assert")),
                    "[": ((), (), ("Len", "Index", "TParams", "TArgs")),
                },
                {"Lit": (("LElem",), True), "Args": (("Arg",), True), "Params": (("Param",), True)},
                auto=True,
            )
        else:
            x = Brackets(G.JSON, G.JSON_CLASSES, _JSON_TOKEN, "json", ("Value",), {"{": ((), ("Object",), ()), "[": ((), ("Array",), ()), "(": ((), (), ())}, {"Object": (("Pair",), False), "Array": (("Value",), False)})
        x.brace = set()
        x.openers = _AnyKind()
        if not hasattr(x, "before_cond"):
            x.before_cond = set()
        _PARSERS[language] = x
    return _PARSERS[language]


class _AnyKind:
    def __contains__(self, _) -> bool:
        return True


def rejected(text: str | None, language: str) -> bool:
    """Whether every dialect of the language rejects the text; null and blank texts are never rejected."""
    if text is None or not text.strip("﻿ \t\r\n\f\v"):
        return False
    if text[0] == "﻿":
        text = text[1:]
    p = parser(language)
    if language == "python":
        return not p.accepts(text)
    if language in SCRIPTS:
        if text.startswith("#!"):
            text = text.partition("\n")[2]
            if not text.strip():
                return False
        if p.accepts(text):
            return False
        return "/" not in text or not p.accepts(text, True)
    if language == "go":
        first = _GO_SKIP.match(text).end()
        if not re.compile(r"package\b").match(text, first):
            return text[first:].strip() != ""
        head = re.compile(r"package\s+[^\W\d]\w*[ \t]*(?:;|//[^\n]*|\r?\n|\Z|/\*)").match(text, first)
        if not head:
            return True
        text = text[head.end() :] if head[0][-1] in ";\n" else "\n" + text[head.end() :] if not head[0].endswith("/*") else text[head.end() - 2 :]
        return not p.accepts(text)
    return not p.accepts(text)
