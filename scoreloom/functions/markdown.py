"""Structure of Markdown texts: tags, tables and trees from one pass of line kinds.

``line_kinds`` names what each line is; the three features are folds over its
result. They run as Arrow UDFs, a batch of texts at a time. Tags are single
letters, so that their edit distance is a built-in function; trees are arrays in
pre-order, as columns cannot recurse.
"""

from __future__ import annotations

import re
from itertools import accumulate, groupby, takewhile
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F
from pyspark.sql import types as T

# The shapes of lines.
_ATX = re.compile(r"(#{1,6})\s+(.+)")
_SEPARATOR = re.compile(r"\s*\|?\s*:?-{3,}:?\s*(\|\s*:?-{3,}:?\s*)+\|?\s*")
_ITEM = re.compile(r"(\s*)(?:[-*+]|(\d+[.)]))\s+(.+)")
_RULE_CELL = re.compile(r":?-{3,}:?")
_FENCE = re.compile(r"```[\s\S]*?```")
_CODE = "<code_block/>"
#: Costs of changes that one comparison of trees keeps at hand.
TABLE_CELLS = 1 << 22
#: Cells up to which plain numbers are faster than arrays.
FEW_CELLS = 1024

#: A letter for each tag: headings in pairs, then blocks.
TAGS = {f"{slash}h{n}": chr(ord("A") + 2 * (n - 1) + bool(slash)) for n in range(1, 7) for slash in ("", "/")} | dict(
    zip(("pre", "/pre", "table", "/table", "sep", "tr", "/tr", "td", "ol", "/ol", "ul", "/ul", "li", "/li", "p", "/p"), "abcdefghijklmnop", strict=True)
)


class Line(NamedTuple):
    """What a line is: ``kind``, its heading level, number of cells or list indent, and the list that its marker asks for."""

    kind: str
    number: int = 0
    list: str | None = None
    separator: bool = False


def _cells(line: str) -> tuple[str, ...]:
    return tuple(c.strip() for c in line.strip().removeprefix("|").removesuffix("|").split("|"))


def line_kinds(text: str) -> list[Line]:
    """Underlined titles take two lines and are one entry here."""
    lines = _FENCE.sub(f"\n{_CODE}\n", text or "").splitlines()
    found, skip = [], False
    for at, line in enumerate(lines):
        if skip:
            skip = False
            continue
        body = line.strip()
        item = _ITEM.fullmatch(line)
        marker = ("ol" if item[2] else "ul") if item else None
        under = lines[at + 1].strip() if at + 1 < len(lines) else ""
        if not body:
            found.append(Line("blank"))
        elif body == _CODE:
            found.append(Line("code"))
        elif m := _ATX.fullmatch(body):
            found.append(Line("heading", len(m[1])))
        elif body[0] != "#" and "|" not in body and not item and under and (set(under) == {"="} or set(under) == {"-"} and len(under) >= 3):
            found.append(Line("heading", 1 if under[0] == "=" else 2))
            skip = True
        elif "|" in body and len(cells := _cells(body)) >= 2:
            found.append(Line("row", len(cells), marker, bool(_SEPARATOR.fullmatch(body))))
        elif item:
            found.append(Line("item", len(item[1].replace("\t", "    ")) // 2, marker))
        else:
            found.append(Line("text"))
    return found


def awareness_tags(text: str) -> str:
    """The tag letters of a text; its words do not matter."""
    out: list[str] = []
    depth = {"ul": 0, "ol": 0}

    def leave_lists():
        for tag in depth:
            out.extend([f"/{tag}"] * depth[tag])
            depth[tag] = 0

    for in_table, run in groupby(line_kinds(text), lambda x: x.kind == "row"):
        if in_table:
            leave_lists()
            out.append("table")
            for row in run:
                out.extend(["sep"] if row.separator else ["tr", *["td"] * row.number, "/tr"])
            out.append("/table")
            continue
        for line in run:
            if line.kind == "item":
                change = line.number + 1 - depth[line.list]
                out.extend([line.list] * change if change > 0 else [f"/{line.list}"] * -change)
                depth[line.list] = line.number + 1
                out.extend(["li", "/li"])
                continue
            leave_lists()
            if line.kind != "blank":
                name = {"code": "pre", "heading": f"h{line.number}", "text": "p"}[line.kind]
                out.extend([name, f"/{name}"])
    leave_lists()
    return "".join(TAGS[t] for t in out)


def extract_tables(text: str) -> list[list[list[str]]]:
    """Runs of two or more pipe rows, without their separator rows."""
    tables, run = [], []
    for line in [*_FENCE.sub(f"\n{_CODE}\n", text or "").splitlines(), ""]:
        body = line.strip()
        if "|" in body and not body.startswith("```") and len(cells := _cells(body)) >= 2:
            run.append(list(cells))
            continue
        if len(run) >= 2 and (rows := [r for r in run if not all(_RULE_CELL.fullmatch(c.replace(" ", "")) for c in r)]):
            tables.append(rows)
        run = []
    return tables


class Tree(NamedTuple):
    """An ordered tree in pre-order."""

    labels: list[str]
    parents: list[int]
    sizes: list[int]


def _tree(labels: list[str], parents: list[int]) -> Tree:
    sizes = [1] * len(labels)
    for i in range(len(labels) - 1, 0, -1):
        sizes[parents[i]] += sizes[i]
    return Tree(labels, parents, sizes)


def table_tree(widths: list[int]) -> Tree:
    """A table by the number of cells of its rows; the first row is the head."""
    labels, parents = ["table"], [-1]
    for i, width in enumerate(widths):
        row = len(labels)
        labels += ["tr", *(["td" if i else "th"] * width)]
        parents += [0, *([row] * width)]
    return _tree(labels, parents)


def document_tree(text: str) -> Tree:
    """Headings nest; tables need two rows, else a row is an item or a paragraph; lists are flat."""
    labels, parents, open_ = ["doc"], [-1], [(0, 0)]

    def add(label: str, parent: int) -> int:
        labels.append(label)
        parents.append(parent)
        return len(labels) - 1

    lines, at = line_kinds(text), 0
    while at < len(lines):
        line, here = lines[at], open_[-1][1]
        rows = list(takewhile(lambda x: x.kind == "row", (lines[k] for k in range(at, len(lines))))) if line.kind == "row" else []
        widths = [r.number for r in rows if not r.separator]
        if len(rows) >= 2 and widths:
            table, base = table_tree(widths), len(labels)
            labels += table.labels
            parents += [here, *(p + base for p in table.parents[1:])]
            at += len(rows)
        elif line.list:
            run = list(takewhile(lambda x, kind=line.list: x.list == kind, (lines[k] for k in range(at, len(lines)))))
            top = add(line.list, here)
            for _ in run:
                add("li", top)
            at += len(run)
        else:
            if line.kind == "heading":
                while open_[-1][0] >= line.number:
                    open_.pop()
                open_.append((line.number, add(f"h{line.number}", open_[-1][1])))
            elif line.kind != "blank":
                add("pre" if line.kind == "code" else "p", here)
            at += 1
    return _tree(labels, parents)


def _children(tree: Tree) -> list[list[int]]:
    found: list[list[int]] = [[] for _ in tree.labels]
    for i, p in enumerate(tree.parents):
        if p >= 0:
            found[p].append(i)
    return found


def tree_distance(a: Tree, b: Tree) -> int:
    """Top-down ordered distance: a subtree costs its size to insert or delete, a label one to change.

    Equal subtrees are recognised by their shape, so only pairs of different shapes
    are compared, each once. A row of the table of two long lists of children is an array.
    """
    kids = _children(a), _children(b)
    shapes: dict = {}

    def shape_of(tree, children):
        out = [0] * len(tree.labels)
        for i in range(len(tree.labels) - 1, -1, -1):
            out[i] = shapes.setdefault((tree.labels[i], tuple(out[c] for c in children[i])), len(shapes))
        return out

    forms = shape_of(a, kids[0]), shape_of(b, kids[1])
    known: dict[tuple[int, int], int] = {}

    def compare(i: int, j: int) -> int | None:
        """The distance of two nodes, or None after asking for shapes of children that are not known yet."""
        left, right = kids[0][i], kids[1][j]
        some, other = ({forms[side][x]: x for x in nodes} for side, nodes in ((0, left), (1, right)))
        need = [(x, y) for f, x in some.items() for g, y in other.items() if (f, g) not in known]
        if need:
            todo.extend(need)
            return None
        if len(left) * len(right) <= FEW_CELLS:
            row = list(accumulate((b.sizes[y] for y in right), initial=0))
            for x in left:
                f, size, new = forms[0][x], a.sizes[x], [row[0] + a.sizes[x]]
                for k, y in enumerate(right):
                    new.append(min(row[k] + known[f, forms[1][y]], row[k + 1] + size, new[k] + b.sizes[y]))
                row = new
            return row[-1] + (a.labels[i] != b.labels[j])
        place = {g: k for k, g in enumerate(other)}
        at = np.array([place[forms[1][y]] for y in right], np.int64)
        costs = {f: np.array([known[f, g] for g in other], np.int64)[at] if right else at for f in some} if len(some) * len(right) < TABLE_CELLS else None
        grown = np.cumsum([0, *(b.sizes[y] for y in right)])
        row = grown
        for x in left:
            f = forms[0][x]
            change = costs[f] if costs is not None else np.array([known[f, g] for g in other], np.int64)[at]
            new = row + a.sizes[x]
            new[1:] = np.minimum(new[1:], row[:-1] + change)
            # An insertion reaches on to the right: the least start, and the sizes from there.
            row = np.minimum.accumulate(new - grown) + grown
        return int(row[-1]) + (a.labels[i] != b.labels[j])

    todo = [(0, 0)]
    while todo:
        i, j = todo[-1]
        key = forms[0][i], forms[1][j]
        if key in known or forms[0][i] == forms[1][j]:
            known.setdefault(key, 0)
            todo.pop()
        elif (d := compare(i, j)) is not None:
            known[key] = d
            todo.pop()
    return known[forms[0][0], forms[1][0]]


_WORDS, _NUMBERS = T.ArrayType(T.StringType()), T.ArrayType(T.IntegerType())
TREE = T.StructType([T.StructField("labels", _WORDS), T.StructField("parents", _NUMBERS), T.StructField("sizes", _NUMBERS)])


@F.arrow_udf(T.StringType())
def awareness(texts: pa.Array) -> pa.Array:
    """Tag letters of each text."""
    return pa.array([None if t is None else awareness_tags(t) for t in texts.to_pylist()], pa.string())


@F.arrow_udf(T.ArrayType(T.ArrayType(_WORDS)))
def tables(texts: pa.Array) -> pa.Array:
    return pa.array([None if t is None else extract_tables(t) for t in texts.to_pylist()], pa.list_(pa.list_(pa.list_(pa.string()))))


@F.arrow_udf(TREE)
def tree(texts: pa.Array) -> pa.Array:
    kind = pa.struct([("labels", pa.list_(pa.string())), ("parents", pa.list_(pa.int32())), ("sizes", pa.list_(pa.int32()))])
    return pa.array([None if t is None else document_tree(t)._asdict() for t in texts.to_pylist()], kind)


@F.arrow_udf(T.IntegerType())
def tree_edit_distance(left: pa.Array, right: pa.Array) -> pa.Array:
    """Distance of two tree columns."""
    return pa.array([None if x is None or y is None else tree_distance(Tree(**x), Tree(**y)) for x, y in zip(left.to_pylist(), right.to_pylist(), strict=True)], pa.int32())


@F.arrow_udf(T.IntegerType())
def table_distance(left: pa.Array, right: pa.Array) -> pa.Array:
    """Distance of two tables given by the widths of their rows."""
    return pa.array([tree_distance(table_tree(x), table_tree(y)) for x, y in zip(left.to_pylist(), right.to_pylist(), strict=True)], pa.int32())
