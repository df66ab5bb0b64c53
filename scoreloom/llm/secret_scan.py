"""Secret scans by one combined deterministic automaton.

The regexes of all rules are parsed to one nondeterministic automaton of bytes,
made deterministic by subset construction over classes of bytes, and minimised by
partition refinement into one transition array. Two such arrays exist: ``search``
may start anywhere and finds in one pass over the bytes where any rule has a valid
match; ``match`` starts at a given byte and tells the longest end of every rule.

A byte that no rule can use (``RESET``) ends every match. The pass cuts the texts
of a batch at such bytes into lanes of about equal length and steps all lanes
together; only the cells between two such bytes that hold a hit are looked at
again, from each start, with ``match``.

A rule's matches are leftmost, longest and do not overlap; those that its ``keep``
pattern does not accept are dropped afterwards, and nothing inside them is tried
again. Rules do not disturb each other.

Defined results: a null text is an empty one without spans; whole texts of any
length are scanned; spans are code points of the text, also behind characters of
several bytes; repeated rows have equal results; other columns, whatever their
names, are not read; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scoreloom.llm.shared import rows_of

_VALUE = "[A-Za-z0-9+/_.=-]"
_ASSIGN = "([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])[\"']?\\x20*[:=]\\x20*[\"']?"


@dataclass(frozen=True)
class Rule:
    """``pattern`` takes up text; a match counts if it has ``least`` bytes and ``keep``, when given, accepts the same bytes.

    A length in ``keep`` costs states, and lengths of rules that share bytes multiply; so only
    rules whose pattern alone would hit everywhere count in the automaton.
    """

    kind: str
    pattern: str
    keep: str | None = None
    least: int = 0


#: The base kinds, then what the automaton adds at no further pass.
RULES = (
    Rule("assign", f"{_ASSIGN}{_VALUE}+", f"{_ASSIGN}{_VALUE}{{6,}}"),
    Rule("access", "AKIA[A-Z0-9]+", least=20),
    Rule("hex", "[0-9a-f]+", "[0-9a-f]{24,}"),
    Rule("hub", "gh[oprsu]_[A-Za-z0-9]+", least=40),
    Rule("chat", "xox[abprs]-([0-9]+-)+[A-Za-z0-9]+", least=24),
    Rule("pem", "-----BEGIN ([A-Z]+ )*PRIVATE KEY-----"),
)
BASE = ("assign", "access", "hex")
#: Bytes of a lane, and lanes under which single ones are stepped by themselves.
LANE, FEW = 4096, 6


class Nfa:
    """Thompson's construction from a regex of literals, classes, groups, ``|``, ``?``, ``*``, ``+`` and ``{m,n}`` over ASCII bytes."""

    def __init__(self) -> None:
        self.moves: list[list[tuple[frozenset[int], int]]] = []
        self.free: list[list[int]] = []

    def state(self) -> int:
        self.moves.append([])
        self.free.append([])
        return len(self.moves) - 1

    def add(self, regex: str) -> tuple[int, int]:
        """First and last state of ``regex``."""
        tree, at = self._either(regex, 0)
        if at != len(regex):
            raise ValueError(f"{regex!r}: {regex[at:]!r} is left")
        return self._build(tree)

    def _either(self, r: str, at: int) -> tuple[tuple, int]:
        ways = []
        while True:
            parts = []
            while at < len(r) and r[at] not in "|)":
                part, at = self._repeated(r, at)
                parts.append(part)
            ways.append(("all", parts))
            if at >= len(r) or r[at] == ")":
                return (ways[0] if len(ways) == 1 else ("any", ways)), at
            at += 1

    def _repeated(self, r: str, at: int) -> tuple[tuple, int]:
        if r[at] == "(":
            part, at = self._either(r, at + 1)
            at += 1
        elif r[at] == "[":
            chosen, at = set(), at + 1
            other = r[at] == "^"
            at += other
            while r[at] != "]":
                low, at = self._char(r, at)
                high = low
                if r[at] == "-" and r[at + 1] != "]":
                    high, at = self._char(r, at + 1)
                chosen |= set(range(low, high + 1))
            part, at = ("byte", frozenset(set(range(256)) - chosen if other else chosen)), at + 1
        elif r[at] == ".":
            part, at = ("byte", frozenset(range(256)) - {10}), at + 1
        else:
            byte, at = self._char(r, at)
            part = ("byte", frozenset([byte]))
        while at < len(r) and r[at] in "?*+{":
            if r[at] == "{":
                end = r.index("}", at)
                low, _, high = r[at + 1 : end].partition(",")
                bounds = (int(low), int(high) if high else None if "," in r[at:end] else int(low))
                at = end
            else:
                bounds = {"?": (0, 1), "*": (0, None), "+": (1, None)}[r[at]]
            part, at = ("times", part, *bounds), at + 1
        return part, at

    @staticmethod
    def _char(r: str, at: int) -> tuple[int, int]:
        if r[at] != "\\":
            return ord(r[at]), at + 1
        if r[at + 1] == "x":
            return int(r[at + 2 : at + 4], 16), at + 4
        return ord({"n": "\n", "t": "\t", "r": "\r"}.get(r[at + 1], r[at + 1])), at + 2

    def _build(self, tree: tuple) -> tuple[int, int]:
        first = last = self.state()
        if tree[0] == "byte":
            last = self.state()
            self.moves[first].append((tree[1], last))
        elif tree[0] == "all":
            for part in tree[1]:
                a, b = self._build(part)
                self.free[last].append(a)
                last = b
        elif tree[0] == "any":
            last = self.state()
            for way in tree[1]:
                a, b = self._build(way)
                self.free[first].append(a)
                self.free[b].append(last)
        else:
            _, part, low, high = tree
            for _ in range(low):
                a, b = self._build(part)
                self.free[last].append(a)
                last = b
            if high is None:
                a, b = self._build(part)
                self.free[last].append(a)
                self.free[b].append(a)
                end = self.state()
                self.free[last].append(end)
                self.free[b].append(end)
                last = end
            else:
                end = self.state()
                for _ in range(high - low):
                    a, b = self._build(part)
                    self.free[last] += [a, end]
                    last = b
                self.free[last].append(end)
                last = end
        return first, last

    def closed(self, states) -> frozenset[int]:
        seen, todo = set(states), list(states)
        while todo:
            for t in self.free[todo.pop()]:
                if t not in seen:
                    seen.add(t)
                    todo.append(t)
        return frozenset(seen)


@dataclass(frozen=True)
class Dfa:
    """``next[state, byte]``, the bits of the patterns that a state accepts, the first state, and the state that leads nowhere (-1: none)."""

    next: np.ndarray
    accepts: np.ndarray
    first: int
    dead: int

    def ahead(self) -> np.ndarray:
        """The bits of the patterns that each state or a later one accepts."""
        seen = self.accepts
        while ((more := seen | np.bitwise_or.reduce(seen[self.next], axis=1)) != seen).any():
            seen = more
        return seen


def compile_patterns(patterns: list[str], anywhere: bool) -> Dfa:
    """One automaton for all ``patterns`` (at most 63), whose bits are their places; ``anywhere``: a match may start at every byte."""
    nfa = Nfa()
    ends = [nfa.add(p) for p in patterns]
    start = nfa.closed([a for a, _ in ends])
    bit = {last: 1 << i for i, (_, last) in enumerate(ends)}
    # Bytes that all sets of the patterns treat alike are one class.
    sets = list(dict.fromkeys(s for m in nfa.moves for s, _ in m))
    classes: dict[tuple, list[int]] = {}
    for byte in range(256):
        classes.setdefault(tuple(byte in s for s in sets), []).append(byte)
    inside = [frozenset(i for i, s in enumerate(sets) if key[i]) for key in classes]
    place = {s: i for i, s in enumerate(sets)}
    subsets, rows = {start: 0}, []
    todo = [start]
    for now in todo:
        row = []
        for own in inside:
            after = nfa.closed({t for q in now for s, t in nfa.moves[q] if place[s] in own} | (start if anywhere else set()))
            if after not in subsets:
                subsets[after] = len(subsets)
                todo.append(after)
            row.append(subsets[after])
        rows.append(row)
    table, accepts = np.array(rows), np.array([sum(bit.get(q, 0) for q in s) for s in subsets], np.int64)
    # States stay together while they accept alike and lead to the same groups.
    group = np.unique(accepts, return_inverse=True)[1]
    while True:
        finer = np.unique(np.column_stack([group, group[table]]), axis=0, return_inverse=True)[1].ravel()
        if finer.max() == group.max():
            break
        group = finer
    one = np.unique(group, return_index=True)[1]
    small = group[table[one]]
    wide = np.empty((len(one), 256), np.int32)
    for i, members in enumerate(classes.values()):
        wide[:, members] = small[:, [i]]
    dead = [s for s in range(len(one)) if accepts[one[s]] == 0 and (wide[s] == s).all()] if not anywhere else []
    return Dfa(wide, accepts[one], int(group[0]), dead[0] if dead else -1)


class Scanner:
    """Finds the spans of ``rules`` in texts."""

    def __init__(self, rules: tuple[Rule, ...] = RULES) -> None:
        self.rules = rules
        keeps = [r.keep or r.pattern for r in rules]
        self.search = compile_patterns(keeps, True)
        self.match = compile_patterns([*(r.pattern for r in rules), *keeps], False)
        self.reset = (self.match.next == self.match.dead).all(axis=0)
        if not self.reset.any():
            raise ValueError("the rules use every byte; none is left to part texts")
        self.rows, self.bits, self.ahead = self.match.next.tolist(), self.match.accepts.tolist(), self.match.ahead().tolist()

    def hits(self, data: np.ndarray) -> np.ndarray:
        """Where in ``data``, which ends with a reset byte, a valid match of any rule ends: one pass of the search automaton."""
        flat, accepts = self.search.next.ravel(), self.search.accepts != 0
        parts = np.flatnonzero(self.reset[data])
        starts = np.unique(np.r_[0, parts[np.searchsorted(parts, np.arange(LANE, len(data), LANE))] + 1])
        starts = starts[starts < len(data)]
        sizes = np.diff(np.r_[starts, len(data)])
        order = np.argsort(-sizes, kind="stable")
        starts, sizes = starts[order], sizes[order]
        state, found, left, at = np.full(len(starts), self.search.first, np.int64), [], len(starts), 0
        while left > FEW:
            until = int(sizes[left - 1])
            now, own = state[:left], starts[:left]
            for at in range(at, until):
                now = flat[now * 256 + data[own + at]]
                if (hit := accepts[now]).any():
                    found.append(own[hit] + at)
            state[:left] = now
            at = until
            left = int(np.searchsorted(-sizes, -at, "left"))
        rows, ends = self.search.next, set(np.flatnonzero(accepts).tolist())
        if left:
            rows = rows.tolist()
        for lane in range(left):
            now, base, own = int(state[lane]), int(starts[lane]) + at, []
            for i, byte in enumerate(data[base : starts[lane] + sizes[lane]].tobytes(), base):
                now = rows[now][byte]
                if now in ends:
                    own.append(i)
            found.append(np.array(own, np.int64))
        return np.sort(np.concatenate(found)) if found else np.empty(0, np.int64)

    def spans_of(self, cell: bytes) -> list[tuple[int, int, int]]:
        """``(rule, start, end)`` in bytes of a cell, by rule."""
        n, rows, bits, ahead = len(self.rules), self.rows, self.bits, self.ahead
        free, found, until = [0] * n, [], 0
        for start in range(len(cell)):
            # Rules whose last match still covers this byte are not followed.
            if start >= until:
                wanted = sum(1 << r for r in range(n) if free[r] <= start)
                until = min((f for f in free if f > start), default=len(cell))
            now, longest = self.match.first, {}
            for at in range(start, len(cell)):
                now = rows[now][cell[at]]
                if not ahead[now] & wanted:
                    break
                if own := bits[now] & wanted:
                    for r in range(n):
                        if own >> r & 1:
                            longest[r] = (at + 1, bits[now] >> n + r & 1)
            for r, (end, kept) in longest.items():
                free[r], until = end, start
                if kept and end - start >= self.rules[r].least:
                    found.append((r, start, end))
        return found

    def find(self, texts: list[str]) -> list[list[tuple[str, int, int]]]:
        """``(kind, start, end)`` in code points for each text, by start, then kind as listed."""
        mark = bytes([int(np.flatnonzero(self.reset)[0])])
        coded = [t.encode("utf-8", "surrogatepass") for t in texts]
        out: list[list] = [[] for _ in texts]
        data = np.frombuffer(mark.join(coded) + mark, np.uint8)
        ends = self.hits(data)
        if not len(ends):
            return out
        first = np.cumsum([0, *(len(c) + 1 for c in coded)])
        parts = np.flatnonzero(self.reset[data])
        # The cells of the hits, each once.
        after = np.unique(np.searchsorted(parts, ends))
        for k in after.tolist():
            low, high = int(parts[k - 1]) + 1 if k else 0, int(parts[k])
            doc = int(np.searchsorted(first, low, "right")) - 1
            shift = len(coded[doc][: low - first[doc]].decode("utf-8", "surrogatepass"))
            # Rules are of ASCII bytes and other bytes end a cell, so inside it bytes are code points.
            out[doc] += [(r, s + shift, e + shift) for r, s, e in self.spans_of(data[low:high].tobytes())]
        return [[(self.rules[r].kind, s, e) for r, s, e in sorted(spans, key=lambda x: (x[1], x[0], x[2]))] for spans in out]


@cache
def scanner(rules: tuple[Rule, ...] = RULES) -> Scanner:
    return Scanner(rules)


def find_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """``(id, spans)``: the spans of every row as ``array<struct<kind, start, end>>``."""
    for r in rules:
        if any(max(s, default=0) > 127 for s in _sets(r)):
            raise ValueError(f"{r.kind}: rules are of ASCII bytes")

    # Compiled once, on the driver: some thousand states whatever the table holds.
    find = scanner(rules).find

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))
        for batch in batches:
            for part, texts in rows_of(batch, "text"):
                spans = [[{"kind": k, "start": s, "end": e} for k, s, e in found] for found in find(texts)]
                yield pa.RecordBatch.from_arrays([part.column("id"), pa.array(spans, kind)], ["id", "spans"])

    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(scan, "id long, spans array<struct<kind:string,start:long,end:long>>")


def _sets(rule: Rule) -> list[frozenset[int]]:
    nfa = Nfa()
    for p in filter(None, (rule.pattern, rule.keep)):
        nfa.add(p)
    return [s for m in nfa.moves for s, _ in m]


def secret_digest(found: DataFrame) -> DataFrame:
    """``(id, n_<base kind>..., base_sha256, spans)`` from what ``find_secrets`` returns."""
    base = F.filter("spans", lambda s: s["kind"].isin(*BASE))
    joined = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    of = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long")
    counts = [of(k).alias(f"n_{k}") for k in BASE]
    return found.select("id", *counts, F.sha2(joined(base).cast("binary"), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"))
