"""Packrat parsing of parsing-expression grammars with source offsets.

Grammar text: ``Rule <- expression`` a rule; "text" a literal, ~"regex" a regular
expression, / ordered choice, & and ! lookahead, * + ? and parentheses as usual.  A rule
whose name is written ``Name:`` on its definition keeps its matches: the semantic result of
a parse is the list of (rule, start, end) of the kept rules on the successful path.
Every (rule, position) is parsed once.
"""

from __future__ import annotations

import re

_LEX = re.compile(r'\s*(?:(~"(?:[^"\\]|\\.)*")|("(?:[^"\\]|\\.)*")|([A-Za-z_]\w*:?\s*<-)|([A-Za-z_]\w*)|([/&!*+?()]))')


class Peg:
    def __init__(self, text: str) -> None:
        toks, pos, text = [], 0, text.rstrip()
        while pos < len(text):
            m = _LEX.match(text, pos)
            if not m:
                raise ValueError(f"grammar: {text[pos:pos + 50]!r}")
            toks.append(m[m.lastindex])
            pos = m.end()
        self.rules: dict = {}
        self.top = ""
        i = 0
        while i < len(toks):
            name = toks[i][:-2].strip()
            keep = name.endswith(":")
            name = name.rstrip(":")
            self.top = self.top or name
            body, i = self._choice(toks, i + 1)
            self.rules[name] = self._rule(name, body, keep)

    def _rule(self, name, body, keep):
        def run(s, i, memo):
            key = (name, i)
            if key in memo:
                return memo[key]
            got = body(s, i, memo)
            if keep and got is not None:
                got = (got[0], ((name, i, got[0]), *got[1]))
            memo[key] = got
            return got

        return run

    def _choice(self, t, i):
        options = []
        while True:
            seq, i = self._sequence(t, i)
            options.append(seq)
            if i >= len(t) or t[i] != "/":
                break
            i += 1
        if len(options) == 1:
            return options[0], i

        def run(s, i, memo):
            for o in options:
                if (got := o(s, i, memo)) is not None:
                    return got
            return None

        return run, i

    def _sequence(self, t, i):
        parts = []
        while i < len(t) and t[i] not in ("/", ")") and not t[i].endswith("<-"):
            p, i = self._item(t, i)
            parts.append(p)
        if len(parts) == 1:
            return parts[0], i

        def run(s, i, memo):
            caps = ()
            for p in parts:
                got = p(s, i, memo)
                if got is None:
                    return None
                i = got[0]
                if got[1]:
                    caps += got[1]
            return i, caps

        return run, i

    def _item(self, t, i):
        x = t[i]
        if x in ("&", "!"):
            inner, i = self._item(t, i + 1)
            want = x == "&"

            def look(s, k, memo):
                return (k, ()) if (inner(s, k, memo) is not None) == want else None

            return look, i
        if x == "(":
            p, i = self._choice(t, i + 1)
            i += 1
        elif x[0] == "~":
            match = re.compile(x[2:-1].replace('\\"', '"')).match

            def p(s, k, memo):
                m = match(s, k)
                return None if m is None else (m.end(), ())

            i += 1
        elif x[0] == '"':
            lit = x[1:-1].replace('\\"', '"')

            def p(s, k, memo):
                return (k + len(lit), ()) if s.startswith(lit, k) else None

            i += 1
        else:
            rules = self.rules

            def p(s, k, memo):
                return rules[x](s, k, memo)

            i += 1
        if i < len(t) and t[i] in ("*", "+", "?"):
            op, one, i = t[i], p, i + 1

            def p(s, k, memo):
                caps, n = (), 0
                while (got := one(s, k, memo)) is not None:
                    n += 1
                    if got[1]:
                        caps += got[1]
                    if got[0] == k or op == "?":
                        k = got[0]
                        break
                    k = got[0]
                return None if op == "+" and not n else (k, caps)

        return p, i

    def parse(self, s: str, i: int = 0) -> list[tuple[str, int, int]] | None:
        """Kept rules of a match of the first rule at i (it need not reach the end), or None."""
        got = self.rules[self.top](s, i, {})
        return None if got is None else list(got[1])
