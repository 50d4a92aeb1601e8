"""Secret scans by one combined deterministic automaton.

The rules' expressions are compiled together (subset construction, minimisation) into transition arrays; a text is
read once, byte by byte, and an accepting state names the rules that end there. Such an end is settled by two small
automata of the rule: backwards for the leftmost start, forwards from there for the longest match. The scan of a rule
goes on after its match. What the expressions leave open (lengths) is checked on the match, and failing ones are dropped.

Matches are leftmost, longest, and don't overlap within a kind. This holds for rules of which no match can begin
inside an unfinished match of the same rule and end before it; rules of another sort are refused.

Cases: null and empty texts have no spans; offsets count code points; texts of any length are read whole; rows that
repeat give their result each; other columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import re
from typing import NamedTuple

from pyspark.sql import DataFrame

from .automaton import Automaton, parse, reverse


class Rule(NamedTuple):
    kind: str
    pattern: str
    fold: bool = False
    least: int = 0  # bytes of the match
    least_value: int = 0  # bytes of group 2


#: The first three are the base; the others are added by this method.
RULES = (
    Rule("assign", r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", True, 0, 8),
    Rule("access", r"AKIA[A-Z0-9]+", False, 16),
    Rule("hex", r"[0-9a-f]+", False, 32),
    Rule("github", r"gh(p|o|u|s|r)_[A-Za-z0-9]+", False, 40),
    Rule("slack", r"xox(a|b|p|r|s)-[A-Za-z0-9-]+", False, 24),
    Rule("google", r"AIza[A-Za-z0-9_-]+", False, 39),
    Rule("private_key", r"-----BEGIN( RSA| EC| DSA| OPENSSH| PGP|) PRIVATE KEY( BLOCK|)-----"),
)
BASE = 3


def _shadows(start: list) -> bool:
    """Whether a match can begin inside an unfinished match of the automaton and end before it."""
    states, todo = {id(start): start}, [start]
    while todo:
        for x in todo.pop()[:256]:
            if id(x) not in states:
                states[id(x)] = x
                todo.append(x)
    # Bytes that lead alike from every state are one.
    sample = {tuple(id(s[b]) for s in states.values()): b for b in range(256)}.values()
    open_ = lambda s: not s[257] and s[256] is None
    begun, todo = {}, [start]
    while todo:  # states of unfinished matches
        now = todo.pop()
        for x in (now[b] for b in sample):
            if open_(x) and id(x) not in begun:
                begun[id(x)] = x
                todo.append(x)
    pairs = [(x, start) for x in begun.values()]
    seen = {(id(x), id(y)) for x, y in pairs}
    while pairs:
        x, y = pairs.pop()
        for b in sample:
            p, q = x[b], y[b]
            if open_(p) and not q[257]:
                if q[256] is not None:
                    return True
                if (id(p), id(q)) not in seen:
                    seen.add((id(p), id(q)))
                    pairs.append((p, q))
    return False


class Scanner:
    def __init__(self, rules: tuple[Rule, ...] = RULES):
        self.rules = rules
        trees = [parse(r.pattern, r.fold) for r in rules]
        self.all = Automaton(trees, True)
        self.forward = [Automaton([t], False) for t in trees]
        self.backward = [Automaton([reverse(t)], False) for t in trees]
        for rule, made in zip(rules, self.forward):
            if _shadows(made.start):
                raise ValueError(f"rule {rule.kind}: a match could begin inside an unfinished one and end before it")
        self.checks = [re.compile(r.pattern.encode(), re.I if r.fold else 0) if r.least_value else None for r in rules]

    def scan(self, data: bytes) -> list[tuple[int, int, int]]:
        """(start, rule, end) in bytes, sorted."""
        found: list[tuple[int, int, int]] = []
        after = [0] * len(self.rules)
        row, i = self.all.start, 0
        for b in data:
            i += 1
            row = row[b]
            if row[256] is not None:
                for r in row[256]:
                    if i > after[r]:
                        self._settle(r, i, after, data, found)
        return sorted(found)

    def _settle(self, r: int, end: int, after: list[int], data: bytes, found: list) -> None:
        start, row = -1, self.backward[r].start
        for i in range(end - 1, after[r] - 1, -1):
            row = row[data[i]]
            if row[256] is not None:
                start = i
            elif row[257]:
                break
        if start < 0:
            return
        row, stop = self.forward[r].start, end
        for i in range(start, len(data)):
            row = row[data[i]]
            if row[256] is not None:
                stop = i + 1
            elif row[257]:
                break
        after[r] = stop
        rule = self.rules[r]
        if stop - start < rule.least:
            return
        if rule.least_value and len(self.checks[r].fullmatch(data, start, stop)[2]) < rule.least_value:
            return
        found.append((start, r, stop))

    def spans(self, text: str) -> list[tuple[int, int, int]]:
        """scan() of a text, in code points."""
        data = text.encode()
        found = self.scan(data)
        if found and len(data) != len(text):
            place, at, n = {}, 0, 0
            for x in sorted({x for a, _, b in found for x in (a, b)}):  # each byte is decoded once, however many spans
                n += len(data[at:x].decode())
                at, place[x] = x, n
            found = [(place[a], r, place[b]) for a, r, b in found]
        return found


_scanner: list[Scanner] = []


def scan_secrets(docs: DataFrame) -> DataFrame:
    """doc_id, text and spans: an array of (start, kind, end) by start, then by kind as the rules are listed."""

    def run(batches):
        import pyarrow as pa

        if not _scanner:
            _scanner.append(Scanner())
        kinds = [r.kind for r in RULES]
        for batch in batches:
            spans = [[{"start": a, "kind": kinds[r], "end": b} for a, r, b in _scanner[0].spans(t or "")] for t in batch.column(1).to_pylist()]
            kind = pa.list_(pa.struct([("start", pa.int64()), ("kind", pa.string()), ("end", pa.int64())]))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(spans, kind)], ["doc_id", "spans"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, spans array<struct<start:long,kind:string,end:long>>")


def op7_secrets(spark, sf_dir: str) -> DataFrame:
    """Counts, the digest of the base spans and all spans, for each document."""
    found = scan_secrets(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    said = "array_join(transform({0}, s -> concat(s.kind, ':', s.start, ':', s.end)), ',')"
    base = [r.kind for r in RULES[:BASE]]
    is_base = "filter(spans, s -> s.kind IN ({}))".format(", ".join(f"'{k}'" for k in base))
    return found.selectExpr(
        "doc_id",
        *[f"cast(size(filter(spans, s -> s.kind = '{k}')) as bigint) AS n_{k}" for k in base],
        f"sha2({said.format(is_base)}, 256) AS base_sha256",
        f"{said.format('spans')} AS spans",
    )


