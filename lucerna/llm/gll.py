"""Generalised LL recognition over a graph-structured stack.

Grammars are written as EBNF text (see :mod:`grammars`).  Every rule becomes a small
transition network; the recogniser walks the networks with descriptors
``(state, stack node, position)``, shares stack nodes by (rule, position) and explores
all alternatives, so several start rules -- the dialects of a language -- are run
together over one graph.

Two things keep this affordable on millions of files:

* the bracket structure is reduced from the inside out: a matched bracket pair becomes
  one symbol that carries the set of rules its inside derives, so each run is short;
* rules that are lists (statements, members, arguments) are closed under concatenation
  or under joining with commas, so their pieces are recognised on their own and
  remembered by their token kinds; only where a piece fails alone is the list run as
  a whole.  Neither changes the accepted language.
"""

from __future__ import annotations

import re

END = ""
_EBNF = re.compile(r"\s*(?:('[^']*')|(@?[A-Za-z_]\w*)|([|()*+?;=]))")


class Kinds:
    """Characters standing for token kinds; the odd neighbour of a kind means 'after a line break'."""

    def __init__(self) -> None:
        self.of: dict[str, str] = {}
        self.groups: dict[str, frozenset] = {}
        self.by_set: dict[frozenset, str] = {}
        self.next = 256

    def new(self) -> str:
        c = chr(self.next)
        self.next += 2
        if self.next in range(0xD7F0, 0xE001):  # surrogates can't be hashed portably
            self.next = 0xE002
        return c

    def literal(self, text: str) -> str:
        if text not in self.of:
            self.of[text] = self.new()
        return self.of[text]

    def group(self, rules: frozenset) -> str:
        c = self.by_set.get(rules)
        if c is None:
            c = self.by_set[rules] = self.new()
            self.groups[c] = rules
        return c


class Grammar:
    """A set of transition networks with lazily filled lookahead tables.

    classes: token classes, name -> the literals and class names that belong to it.
    """

    def __init__(self, text: str, classes: dict[str, list[str]]) -> None:
        self.kinds = Kinds()
        self.eps: list[list[int]] = []
        self.arcs: list[list[tuple[str, int]]] = []
        self.final: list[bool] = []
        self.start: dict[str, int] = {}
        self.table: list[dict] = []
        self.begins: dict[tuple[str, str], tuple[bool, bool]] = {}
        self.memo: dict = {}
        self.class_names = set(classes)
        for m in re.finditer(r"'([^']*)'", text):
            self.kinds.literal(m[1])
        for name in classes:
            self.kinds.literal(name)
        self.members = {n: {self.kinds.literal(x) for x in [n, *xs]} for n, xs in classes.items()}
        self._read(text)

    # -- building ---------------------------------------------------------------

    def _state(self) -> int:
        self.eps.append([])
        self.arcs.append([])
        self.final.append(False)
        self.table.append({})
        return len(self.eps) - 1

    def _read(self, text: str) -> None:
        text = re.sub(r"#[^\n]*", "", text)
        toks, pos = [], 0
        while pos < len(text.rstrip()):
            m = _EBNF.match(text, pos)
            if not m:
                raise ValueError(f"grammar: {text[pos:pos + 40]!r}")
            toks.append(m[1] or m[2] or m[3])
            pos = m.end()
        i = 0
        while i < len(toks):
            name = toks[i]
            if toks[i + 1] != "=":
                raise ValueError(f"grammar: rule {toks[i:i + 6]}")
            a, b, i = self._alts(toks, i + 2)
            if toks[i] != ";":
                raise ValueError(f"grammar: end of {name}: {toks[i - 3:i + 4]}")
            self.start[name] = a
            self.final[b] = True
            i += 1
        for arcs in self.arcs:
            for label, _ in arcs:
                if label[0] not in "'@" and label not in self.start and label not in self.class_names and label != "ASI":
                    raise ValueError(f"grammar: unknown {label}")

    def _alts(self, t: list[str], i: int) -> tuple[int, int, int]:
        a, b = self._state(), self._state()
        while True:
            x = cur = self._state()
            self.eps[a].append(x)
            while t[i] not in "|);":
                p, q, i = self._atom(t, i)
                self.eps[cur].append(p)
                cur = q
            self.eps[cur].append(b)
            if t[i] != "|":
                return a, b, i
            i += 1

    def _atom(self, t: list[str], i: int) -> tuple[int, int, int]:
        if t[i] == "(":
            p, q, i = self._alts(t, i + 1)
            i += 1
        else:
            p, q = self._state(), self._state()
            self.arcs[p].append((t[i], q))
            i += 1
        while i < len(t) and t[i] in "*+?":
            a, b = self._state(), self._state()
            self.eps[a].append(p)
            self.eps[q].append(b)
            if t[i] in "*?":
                self.eps[a].append(b)
            if t[i] in "*+":
                self.eps[q].append(p)
            p, q, i = a, b, i + 1
        return p, q, i

    # -- lookahead --------------------------------------------------------------

    def _matches(self, label: str, ch: str) -> bool:
        if ch == END:
            return False
        base = chr(ord(ch) & ~1)
        if label[0] == "'":
            return self.kinds.of.get(label[1:-1]) == base
        if label[0] == "@":
            return label[1:] in self.kinds.groups.get(base, ())
        return base in self.members[label]

    def _begin(self, rule: str, ch: str, open_: tuple = ()) -> tuple[bool, bool]:
        """Whether the rule can start with this symbol, and whether it can be empty before it."""
        got = self.begins.get((rule, ch))
        if got is not None or rule in open_:
            return got or (False, False)
        shift = empty = False
        todo, seen = [self.start[rule]], set()
        while todo:
            s = todo.pop()
            if s in seen:
                continue
            seen.add(s)
            empty |= self.final[s]
            todo += self.eps[s]
            for label, to in self.arcs[s]:
                if label == "ASI":
                    if ch == END or ord(ch) & 1:
                        todo.append(to)
                elif label in self.start:
                    x, e = self._begin(label, ch, (*open_, rule))
                    shift |= x
                    if e:
                        todo.append(to)
                elif self._matches(label, ch):
                    shift = True
        if not open_:
            self.begins[rule, ch] = (shift, empty)
        return shift, empty

    def _acts(self, state: int, ch: str) -> tuple:
        shifts, calls, pop = [], [], False
        todo, seen = [state], set()
        while todo:
            s = todo.pop()
            if s in seen:
                continue
            seen.add(s)
            pop |= self.final[s]
            todo += self.eps[s]
            for label, to in self.arcs[s]:
                if label == "ASI":
                    if ch == END or ord(ch) & 1:
                        todo.append(to)
                elif label in self.start:
                    x, e = self._begin(label, ch)
                    if x:
                        calls.append((label, to))
                    if e:
                        todo.append(to)
                elif self._matches(label, ch):
                    shifts.append(to)
        got = self.table[state][ch] = (tuple(dict.fromkeys(shifts)), tuple(dict.fromkeys(calls)), pop)
        return got

    # -- running ----------------------------------------------------------------

    def run(self, starts: tuple[str, ...], s: str) -> frozenset:
        """The start rules that derive all of s, found in one run over a shared stack graph."""
        n, table, start = len(s), self.table, self.start
        nodes: dict = {}
        todo, seen = [], set()
        for rule in starts:
            node = nodes[rule, 0] = ([], set(), rule)
            todo.append((start[rule], node, 0))
        while todo:
            state, node, i = todo.pop()
            while True:
                ch = s[i] if i < n else END
                shifts, calls, pop = table[state].get(ch) or self._acts(state, ch)
                if pop and i not in node[1]:
                    node[1].add(i)
                    for ret, up in node[0]:
                        if (key := (ret, id(up), i)) not in seen:
                            seen.add(key)
                            todo.append((ret, up, i))
                for rule, ret in calls:
                    sub = nodes.get((rule, i))
                    if sub is None:
                        sub = nodes[rule, i] = ([], set(), rule)
                        todo.append((start[rule], sub, i))
                    if (key := (ret, id(node), id(sub))) not in seen:
                        seen.add(key)
                        sub[0].append((ret, node))
                        for j in sub[1]:
                            if (key := (ret, id(node), j)) not in seen:
                                seen.add(key)
                                todo.append((ret, node, j))
                if not shifts:
                    break
                i += 1
                for to in shifts[1:]:
                    if (key := (to, id(node), i)) not in seen:
                        seen.add(key)
                        todo.append((to, node, i))
                state = shifts[0]
                if (key := (state, id(node), i)) in seen:
                    break
                seen.add(key)
        return frozenset(r for r in starts if n in nodes[r, 0][1])

    def derive(self, starts: tuple[str, ...], s: str) -> frozenset:
        """run(), remembered by token kinds; the memory is emptied when it holds 300,000 entries."""
        got = self.memo.get((starts, s))
        if got is None:
            if len(self.memo) > 300_000:
                self.memo.clear()
            got = self.memo[starts, s] = self.run(starts, s)
        return got

    def lists(self, starts: tuple[str, ...], s: str, pieces: list[str]) -> frozenset:
        """derive() for rules closed under joining the pieces: all pieces, else the whole."""
        if len(pieces) < 2:
            return self.derive(starts, s)
        left = frozenset(starts)
        for p in pieces:
            left &= self.derive(starts, p)
            if not left:
                break
        rest = tuple(r for r in starts if r not in left)
        return left | self.derive(rest, s) if rest else left
