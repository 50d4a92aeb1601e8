"""Regular expressions over bytes as deterministic automata: parse, subset construction, minimisation, arrays.

The syntax: literals, \\xHH and escaped characters, [classes] with ranges and ^, (groups), |, ?, * and +. fold makes
letters match in either case. Counts are left to checks on what was matched.
"""

from __future__ import annotations

ALL = (1 << 256) - 1


def parse(pattern: str, fold: bool = False):
    """A tree of ("set", bits), ("cat", ...), ("alt", ...), ("star", x)."""
    at = 0

    def bit(c: int) -> int:
        out = 1 << c
        if fold and chr(c).isalpha() and c < 128:
            out |= 1 << (c ^ 32)
        return out

    def escaped() -> int:
        nonlocal at
        at += 1
        c = pattern[at]
        at += 1
        if c == "x":
            at += 2
            return int(pattern[at - 2 : at], 16)
        return ord({"n": "\n", "t": "\t", "r": "\r"}.get(c, c))

    def charset():
        nonlocal at
        at += 1
        no = pattern[at] == "^"
        at += no
        out = 0
        while pattern[at] != "]":
            lo = escaped() if pattern[at] == "\\" else ord(pattern[at])
            at += pattern[at - 1] != "\\" and chr(lo) == pattern[at]
            hi = lo
            if pattern[at] == "-" and pattern[at + 1] != "]":
                at += 1
                if pattern[at] == "\\":
                    hi = escaped()
                else:
                    hi = ord(pattern[at])
                    at += 1
            for c in range(lo, hi + 1):
                out |= bit(c)
        at += 1
        return ("set", ALL & ~out if no else out)

    def atom():
        nonlocal at
        c = pattern[at]
        if c == "(":
            at += 1
            out = alternatives()
            at += 1
            return out
        if c == "[":
            return charset()
        if c == "\\":
            return ("set", bit(escaped()))
        at += 1
        return ("set", bit(ord(c)))

    def sequence():
        nonlocal at
        out = []
        while at < len(pattern) and pattern[at] not in "|)":
            x = atom()
            while at < len(pattern) and pattern[at] in "?*+":
                x = {"?": ("alt", x, ("cat",)), "*": ("star", x), "+": ("cat", x, ("star", x))}[pattern[at]]
                at += 1
            out.append(x)
        return ("cat", *out)

    def alternatives():
        nonlocal at
        out = [sequence()]
        while at < len(pattern) and pattern[at] == "|":
            at += 1
            out.append(sequence())
        return ("alt", *out)

    return alternatives()


def reverse(tree):
    if tree[0] == "set":
        return tree
    parts = [reverse(x) for x in tree[1:]]
    return (tree[0], *(parts[::-1] if tree[0] == "cat" else parts))


class Automaton:
    """rows[s] is a list of 256 next rows and, at 256, the rules that accept there (a tuple of numbers, or None), and at 257 whether nothing can follow."""

    def __init__(self, trees: list, anywhere: bool):
        self.steps: list[list[tuple[int, int]]] = []
        self.empty: list[list[int]] = []
        start = self._state()
        accepts: dict[int, int] = {}
        for i, tree in enumerate(trees):
            a, b = self._build(tree)
            self.empty[start].append(a)
            accepts[b] = i
        if anywhere:
            self.steps[start].append((ALL, start))
        self._subsets(start, accepts)

    def _state(self) -> int:
        self.steps.append([])
        self.empty.append([])
        return len(self.steps) - 1

    def _build(self, tree) -> tuple[int, int]:
        a, b = self._state(), self._state()
        if tree[0] == "set":
            self.steps[a].append((tree[1], b))
        elif tree[0] == "cat":
            at = a
            for x in tree[1:]:
                p, q = self._build(x)
                self.empty[at].append(p)
                at = q
            self.empty[at].append(b)
        else:
            for x in tree[1:]:
                p, q = self._build(x)
                self.empty[a].append(p)
                self.empty[q].append(p if tree[0] == "star" else b)
                if tree[0] == "star":
                    self.empty[q].append(b)
            if tree[0] == "star":
                self.empty[a].append(b)
        return a, b

    def _closure(self, states) -> frozenset:
        seen, todo = set(states), list(states)
        while todo:
            for x in self.empty[todo.pop()]:
                if x not in seen:
                    seen.add(x)
                    todo.append(x)
        return frozenset(seen)

    def _subsets(self, start: int, accepts: dict[int, int]) -> None:
        # Bytes that no set tells apart share a column.
        sets = list({s for x in self.steps for s, _ in x})
        column: dict[tuple, int] = {}
        of = [column.setdefault(tuple(s >> c & 1 for s in sets), len(column)) for c in range(256)]
        sample = [of.index(k) for k in range(len(column))]
        first = self._closure([start])
        number, todo, table = {first: 0}, [first], []
        while todo:
            now = todo.pop(0)
            row = []
            for c in sample:
                to = self._closure({b for x in now for s, b in self.steps[x] if s >> c & 1})
                if to not in number:
                    number[to] = len(number)
                    todo.append(to)
                row.append(number[to])
            table.append(row)
        says = [tuple(sorted(accepts[x] for x in s if x in accepts)) for s in number]
        # Minimisation: parts are split until states of a part go to the same parts.
        names: dict = {}
        part = [names.setdefault(x, len(names)) for x in says]
        while True:
            names = {}
            new = [names.setdefault((part[i], *(part[x] for x in row)), len(names)) for i, row in enumerate(table)]
            if len(names) == len(set(part)):
                break
            part = new
        self.rows: list[list] = [[None] * 258 for _ in range(len(set(new)))]
        for i, row in enumerate(table):
            out = self.rows[new[i]]
            out[:256] = [self.rows[new[row[of[c]]]] for c in range(256)]
            out[256] = says[i] or None
        for row in self.rows:
            row[257] = not row[256] and all(x is row for x in row[:256])
        self.start = self.rows[new[0]]
