"""Newick text, and trees as tables: small per-tree helpers that Spark maps over rows."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandweave.plans.durable import durable

_TOKEN = re.compile(r"[(),;:]|\[|'(?:[^']|'')*'|[^\s(),;:\[\]]+")
EDGES = "node int, parent int, name string, length double, is_tip boolean"


@dataclass
class Node:
    name: str | None = None
    length: float | None = None
    children: list[Node] = field(default_factory=list)

    def walk(self) -> Iterator[Node]:
        """Pre-order, without recursion: trees may be deep."""
        stack = [self]
        while stack:
            n = stack.pop()
            yield n
            stack += reversed(n.children)

    def tips(self) -> list[str]:
        return [n.name or "" for n in self.walk() if not n.children]


def _uncommented(text: str) -> tuple[str, float]:
    """The text without its nested [comments]; a number alone in brackets is the tree's weight."""
    out, depth, weight, held = [], 0, 1.0, ""
    for c in text:
        if c == "[":
            depth += 1
            held = "" if depth == 1 else held
        elif c == "]" and depth:
            depth -= 1
            if not depth and re.fullmatch(r"\s*[+-]?\d*\.?\d+(?:[eE][+-]?\d+)?\s*", held):
                weight = float(held)
        elif depth:
            held += c
        else:
            out.append(c)
    if depth:
        raise ValueError("a comment isn't closed")
    return "".join(out), weight


def parse(text: str) -> tuple[Node, float]:
    """Root and weight of the first tree. `_` in names means a space. ValueError on text that is no tree."""
    text, weight = _uncommented(text)
    root = at = Node()
    stack: list[Node] = []
    number = False
    for t in _TOKEN.findall(text):
        if t == ";":
            break
        if t == "(":
            stack.append(at)
            at.children.append(at := Node())
        elif t == ",":
            if not stack:
                raise ValueError("a comma outside of the tree")
            stack[-1].children.append(at := Node())
        elif t == ")":
            if not stack:
                raise ValueError("too many closing brackets")
            at = stack.pop()
        elif t == ":":
            number = True
        elif number:
            at.length, number = float(t), False
        else:
            at.name = (t[1:-1].replace("''", "'") if t[0] == "'" else t).replace("_", " ")
    if stack:
        raise ValueError("brackets aren't closed")
    if not root.children and root.name is None:
        raise ValueError("no tree")
    return root, weight


def render(root: Node, decimals: int = 5) -> str:
    """Newick text; lengths with so many decimals, spaces in names as `_`."""
    done: dict[int, str] = {}
    for n in reversed(list(root.walk())):
        own = (n.name or "").replace(" ", "_") + ("" if n.length is None else f":{n.length:.{decimals}f}")
        done[id(n)] = (f"({','.join(done.pop(id(c)) for c in n.children)})" if n.children else "") + own
    return done[id(root)] + ";"


def count_tips(text: str) -> int:
    return len(parse(text)[0].tips())


def split_table(root: Node, trivial: bool = True) -> dict[tuple[str, ...], float]:
    """Splits of the unrooted tree, each as the sorted tips of its side without the first tip in string order, with lengths; two edges at a root of two are one."""
    everyone = set(root.tips())
    first = min(everyone)
    below: dict[int, frozenset[str]] = {}
    out: dict[tuple[str, ...], float] = {}
    for n in reversed(list(root.walk())):
        s = frozenset().union(*(below.pop(id(c)) for c in n.children)) if n.children else frozenset((n.name or "",))
        below[id(n)] = s
        if n is root:
            continue
        side = frozenset(everyone - s) if first in s else s
        if side and (trivial or 1 < len(side) < len(everyone) - 1):
            key = tuple(sorted(side))
            out[key] = out.get(key, 0.0) + (n.length or 0.0)
    return out


def unroot(root: Node) -> Node:
    """A root of two children joined into one of three, if one of them has children."""
    if len(root.children) == 2:
        a, b = root.children
        inner, other = (a, b) if a.children else (b, a)
        if inner.children:
            both = None if a.length is None and b.length is None else (a.length or 0.0) + (b.length or 0.0)
            return Node(root.name, None, [*inner.children, Node(other.name, both, other.children)])
    return root


def reroot(root: Node, outgroup: str) -> Node:
    """The unrooted tree, hung up at the node next to the tip `outgroup`, which comes first."""
    root = unroot(root)
    above: dict[int, Node] = {id(c): n for n in root.walk() for c in n.children}
    tip = next((n for n in root.walk() if not n.children and n.name == outgroup), None)
    if tip is None:
        raise ValueError(f"no tip {outgroup}")
    path = [above[id(tip)]] if id(tip) in above else [tip]
    while id(path[-1]) in above:
        path.append(above[id(path[-1])])
    for low, high in reversed(list(zip(path, path[1:], strict=False))):
        high.children = [c for c in high.children if c is not low]
        low.children.append(high)
        high.length, low.length = low.length, None
    new = path[0]
    new.children = [tip, *[c for c in new.children if c is not tip]]
    for n in list(new.walk()):  # an old root of two leaves a node of one child
        n.children = [_spliced(c) for c in n.children]
    new.length = None
    return new


def _spliced(n: Node) -> Node:
    while len(n.children) == 1:
        c = n.children[0]
        c.length = None if n.length is None and c.length is None else (n.length or 0.0) + (c.length or 0.0)
        n = c
    return n


def trim_tips(root: Node, by: float) -> Node:
    """Every tip's branch shortened by `by`."""
    for n in root.walk():
        if not n.children and n.length is not None:
            n.length -= by
    return root


def edges(trees: DataFrame, *keep: str) -> DataFrame:
    """(keep, node, parent, name, length, is_tip) of a table of trees (keep, newick); null texts give no row."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in parts:
            out = []
            for row in p.itertuples(index=False):
                if row.newick:
                    nodes = list(parse(row.newick)[0].walk())
                    number = {id(n): i for i, n in enumerate(nodes)}
                    above = {id(c): number[id(n)] for n in nodes for c in n.children}
                    out += [(*row[:-1], i, above.get(id(n)), n.name, n.length, not n.children) for i, n in enumerate(nodes)]
            yield _frame(out, [*keep, "node", "parent", "name", "length", "is_tip"], Int32=["node", "parent"])

    return trees.select(*keep, "newick").mapInPandas(run, f"{_ddl(trees, keep)}{EDGES}")


def splits(trees: DataFrame, *keep: str, trivial: bool = True) -> DataFrame:
    """(keep, split ARRAY<STRING>, length, weight) of a table of trees (keep, newick); null texts give no row."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in parts:
            out = []
            for row in p.itertuples(index=False):
                if row.newick:
                    root, weight = parse(row.newick)
                    out += [(*row[:-1], list(s), x, weight) for s, x in split_table(root, trivial).items()]
            yield _frame(out, [*keep, "split", "length", "weight"])

    return trees.select(*keep, "newick").mapInPandas(run, f"{_ddl(trees, keep)}split array<string>, length double, weight double")


def rerooted(trees: DataFrame, outgroup: str, *keep: str) -> DataFrame:
    """(keep, newick) of trees (keep, newick, outgroup): each hung up at the node next to the tip named in the column `outgroup`.

    A null text or outgroup, or one that isn't a tip of its tree, gives a null text."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in parts:
            text = [_hung_at(t, o) for t, o in zip(p["newick"], p["_outgroup"], strict=True)]
            yield p[list(keep)].assign(newick=pd.Series(text, index=p.index, dtype=object))

    return trees.select(*keep, "newick", F.col(outgroup).alias("_outgroup")).mapInPandas(run, f"{_ddl(trees, keep)}newick string")


def trimmed(trees: DataFrame, by: str | float, *keep: str) -> DataFrame:
    """(keep, newick) of trees (keep, newick): every tip's branch shortened by a number or by the column `by`; a null text stays null, and a null number leaves the text as it is."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in parts:
            text = [render(trim_tips(parse(t)[0], x)) if t and not pd.isna(x) else t for t, x in zip(p["newick"], p["_by"], strict=True)]
            yield p[list(keep)].assign(newick=pd.Series(text, index=p.index, dtype=object))

    shorten = F.col(by) if isinstance(by, str) else F.lit(float(by))
    return trees.select(*keep, "newick", shorten.cast("double").alias("_by")).mapInPandas(run, f"{_ddl(trees, keep)}newick string")


def _hung_at(text: str | None, outgroup: str | None) -> str | None:
    root = parse(text)[0] if text else None
    return render(reroot(root, outgroup)) if root and outgroup in root.tips() else None


def tip_problems(trees: DataFrame, group: str, key: str) -> DataFrame:
    """(group, key, name, problem) of trees (group, key, newick): `repeated` for a name that a tree has more than once, `missing` for one that another tree of the group has and it hasn't."""
    trees = durable(trees.select(group, key, "newick"))
    tips = edges(trees, group, key).where("is_tip").groupBy(group, key, "name").agg(F.count(F.lit(1)).alias("n"))
    repeated = tips.where("n > 1").select(group, key, "name", F.lit("repeated").alias("problem"))
    ids = trees.where("newick is not null").groupBy(group).agg(F.count_distinct(key).alias("_trees"))
    known = tips.groupBy(group, "name").agg(F.count(F.lit(1)).alias("_held")).join(ids, group).where("_held < _trees").select(group, "name")
    lacking = trees.where("newick is not null").select(group, key).distinct().join(known, group).join(tips, [group, key, "name"], "left_anti")
    return repeated.unionByName(lacking.select(group, key, "name", F.lit("missing").alias("problem")))


def _ddl(df: DataFrame, keep: tuple[str, ...]) -> str:
    return "".join(f"{f.name} {f.dataType.simpleString()}, " for f in df.select(*keep).schema.fields)


def _frame(rows: list[tuple], names: list[str], **types: list[str]) -> pd.DataFrame:
    f = pd.DataFrame(rows, columns=names)
    for t, cols in types.items():
        f = f.astype(dict.fromkeys(cols, t))
    return f
