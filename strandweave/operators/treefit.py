"""Weighted least-squares trees from distances: one tree a group, groups in parallel.

A topology is a set of edges between nodes; an edge is a split of the tips, and a path's length is the sum of the edges whose split separates its
ends. Lengths are the non-negative least-squares solution, found by an active-set method on the normal equations. Tips are added one by one at the branch
that fits best, followed by nearest-neighbour interchanges while they improve the fit.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from strandweave.functions.formulas import LEAST_DISTANCE
from strandweave.operators.newick import Node, parse, render, split_table
from strandweave.plans.durable import spread

#: Fixed value: share of the best fit by which another must be better.
BETTER = 1e-6
FIT = "newick string, ss double, percent_sd double"


@dataclass
class Options:
    """negative: branches may be negative. evolution: least sum of lengths instead of least squares. everywhere: at the end each tip is tried at all branches.
    jumbles: so many random orders, of which the best tree counts; 0 keeps the order. outgroup: the tip at which the tree is hung up (default: the first)."""

    negative: bool = False
    evolution: bool = False
    everywhere: bool = False
    jumbles: int = 0
    seed: int = 1
    outgroup: str | None = None
    decimals: int = 5


def weights(d: np.ndarray, k: int, reps: np.ndarray | None = None) -> np.ndarray:
    x = np.exp(-k * np.maximum(d, LEAST_DISTANCE))
    w = x / (1 - x) * (1 if reps is None else reps)
    np.fill_diagonal(w, 0)
    return w


class Fit:
    """Lengths and quality of topologies over some tips of one matrix."""

    def __init__(self, d: np.ndarray, w: np.ndarray, o: Options) -> None:
        self.d, self.w, self.o = np.maximum(d, LEAST_DISTANCE), w, o

    def lengths(self, tips: list[int], masks: np.ndarray) -> tuple[np.ndarray, float, float]:
        """Branch lengths for splits (edges x tips, 0/1), the weighted sum of squares over ordered pairs, and what is to be minimised."""
        i, j = np.triu_indices(len(tips), 1)
        a = (masks[:, i] != masks[:, j]).T.astype(float)
        d, w = self.d[np.ix_(tips, tips)][i, j], self.w[np.ix_(tips, tips)][i, j]
        g, h = a.T @ (a * w[:, None]), a.T @ (w * d)
        x = np.linalg.lstsq(g, h, rcond=None)[0] if self.o.negative or self.o.evolution else non_negative(g, h)
        ss = 2 * float(w @ (d - a @ x) ** 2)
        return x, ss, float(x.sum()) if self.o.evolution else ss


def _solve(g: np.ndarray, h: np.ndarray) -> np.ndarray:
    """gx = h; of least norm where g is singular."""
    try:
        x = np.linalg.solve(g, h)
        if np.isfinite(x).all() and np.abs(g @ x - h).max(initial=0) <= 1e-9 * max(1e-300, np.abs(h).max(initial=0)):
            return x
    except np.linalg.LinAlgError:
        pass
    return np.linalg.lstsq(g, h, rcond=None)[0]


def non_negative(g: np.ndarray, h: np.ndarray) -> np.ndarray:
    """The x >= 0 with least x'gx - 2h'x: Lawson and Hanson's active sets, begun at what is left of the unconstrained solution when its negative parts are fixed at 0."""
    n = len(h)
    x, free = np.zeros(n), np.ones(n, bool)
    while free.any():
        at = np.flatnonzero(free)
        y = _solve(g[np.ix_(at, at)], h[at])
        if (y > 0).all():
            x[at] = y
            break
        free[at[y <= 0]] = False
    if free.all():
        return x
    small = 1e-12 * max(1.0, float(np.abs(h).max(initial=0)))
    for _ in range(10 * n):
        slope = h - g @ x
        slope[free] = -np.inf
        j = int(np.argmax(slope))
        if slope[j] <= small:
            break
        free[j] = True
        while True:
            at = np.flatnonzero(free)
            y = _solve(g[np.ix_(at, at)], h[at])
            if (y > 0).all():
                x[:] = 0
                x[at] = y
                break
            bad = y <= 0
            step = np.min(x[at][bad] / np.maximum(x[at][bad] - y[bad], 1e-300))
            x[at] += step * (y - x[at])
            free[at[(x[at] <= 1e-15) & bad]] = False
            x[~free] = 0
            if not free.any():
                break
    return x


Edges = list[tuple[int, int]]


def _masks(edges: Edges, tips: list[int]) -> np.ndarray:
    near: dict[int, list[int]] = {}
    for a, b in edges:
        near.setdefault(a, []).append(b)
        near.setdefault(b, []).append(a)
    place = {t: i for i, t in enumerate(tips)}
    below: dict[tuple[int, int], np.ndarray] = {}
    root = tips[0]
    order, stack = [], [(near[root][0], root)]
    while stack:
        n, up = stack.pop()
        order.append((n, up))
        stack += [(m, n) for m in near[n] if m != up]
    for n, up in reversed(order):
        m = np.zeros(len(tips), bool)
        if n in place:
            m[place[n]] = True
        for c in near[n]:
            if c != up:
                m |= below[c, n]
        below[n, up] = m
    return np.array([below[(a, b)] if (a, b) in below else below[(b, a)] for a, b in edges])


def _try(fit: Fit, tips: list[int], edges: Edges, best: tuple | None) -> tuple | None:
    """(goal, ss, lengths, edges) if better than the best by a share of BETTER."""
    x, ss, goal = fit.lengths(tips, _masks(edges, tips))
    return (goal, ss, x, edges) if best is None or goal < best[0] - BETTER * abs(best[0]) - 1e-15 else None


def _interchange(fit: Fit, tips: list[int], best: tuple) -> tuple:
    """Nearest-neighbour interchanges while any of them is better."""
    going = True
    while going:
        going = False
        for a, b in [e for e in best[3] if min(e) >= fit.d.shape[0]]:
            around = lambda n, other: [(y if x == n else x) for x, y in best[3] if n in (x, y) and other not in (x, y)]  # noqa: B023, E731
            sides = around(a, b)
            for c in around(b, a):
                moved = _swap(best[3], (a, sides[-1]), (b, c))
                if better := _try(fit, tips, moved, best):
                    best, going = better, True
                    break
            if going:
                break
    return best


def _swap(edges: Edges, one: tuple[int, int], two: tuple[int, int]) -> Edges:
    (a, x), (b, y) = one, two
    out = [e for e in edges if set(e) not in ({a, x}, {b, y})]
    return [*out, (a, y), (b, x)]


def _insert(edges: Edges, at: tuple[int, int], tip: int, node: int) -> Edges:
    a, b = at
    return [*[e for e in edges if e != at], (a, node), (node, b), (node, tip)]


def _remove(edges: Edges, tip: int) -> tuple[Edges, int]:
    node = next(b if a == tip else a for a, b in edges if tip in (a, b))
    ends = [(b if a == node else a) for a, b in edges if node in (a, b) and tip not in (a, b)]
    return [*[e for e in edges if node not in e], (ends[0], ends[1])], node


def _search(fit: Fit, order: list[int]) -> tuple:
    n = fit.d.shape[0]
    tips, node = order[:3], n
    best = _try(fit, tips, [(t, node) for t in tips], None)
    for t in order[3:]:
        node += 1
        tips = [*tips, t]
        found = None
        for e in best[3]:
            found = _try(fit, tips, _insert(best[3], e, t, node), found) or found
        best = _interchange(fit, tips, found)
    if fit.o.everywhere and len(order) > 3:
        going = True
        while going:
            going = False
            for t in order:
                rest, free = _remove(best[3], t)
                for e in rest:
                    if better := _try(fit, tips, _insert(rest, e, t, free), best):
                        best, going = better, True
                        break
                if going:
                    break
    return (*best, tips)


def fit_tree(names: list[str], d: np.ndarray, k: int, options: Options | None = None, reps: np.ndarray | None = None, user_tree: str | None = None) -> tuple[str, float, float]:
    """(newick, weighted sum of squares over ordered pairs, average percent SD) of the best tree found, or of `user_tree` with lengths fitted.

    One name gives that tip, two their distance. The text hangs at the node next to the outgroup."""
    o = options or Options()
    n = len(names)
    if n < 3:
        return ("" if not n else f"{names[0]};" if n == 1 else f"({names[0]}:{d[0, 1] / 2:.{o.decimals}f},{names[1]}:{d[0, 1] / 2:.{o.decimals}f});"), 0.0, 0.0
    fit = Fit(d, weights(d, k, reps), o)
    if user_tree:
        keys = list(split_table(parse(user_tree)[0]))
        x, ss, _ = fit.lengths(list(range(n)), np.array([[m in set(s) for m in names] for s in keys]))
        return render(_hung({tuple(s): v for s, v in zip(keys, x, strict=True)}, names, o), o.decimals), ss, 100 * float(np.sqrt(ss / (n * (n - 1) - 2)))
    rng = np.random.default_rng(o.seed)
    orders = [rng.permutation(n).tolist() for _ in range(o.jumbles)] or [list(range(n))]
    goal, ss, x, edges, tips = min((_search(fit, r) for r in orders), key=lambda t: t[0])
    masks = _masks(edges, tips)
    first = names.index(min(names))
    table = {}
    for m, v in zip(masks, x, strict=True):
        side = {names[t] for t, inside in zip(tips, m, strict=True) if inside != m[tips.index(first)]}
        table[tuple(sorted(side))] = float(v)
    return render(_hung(table, names, o), o.decimals), ss, 100 * float(np.sqrt(ss / (n * (n - 1) - 2)))


def _hung(table: dict[tuple[str, ...], float], names: list[str], o: Options) -> Node:
    from strandweave.operators.consensus import assemble
    from strandweave.operators.newick import reroot

    return reroot(assemble(table, sorted(names)), o.outgroup or names[0])


def _matrix(p: pd.DataFrame) -> tuple[list[str], np.ndarray]:
    """Names and matrix of pairs (s1, s2, d); missing pairs are at distance 1."""
    names = sorted({*p.s1, *p.s2})
    place = {s: i for i, s in enumerate(names)}
    d = np.ones((len(names), len(names)))
    i, j = p.s1.map(place).to_numpy(), p.s2.map(place).to_numpy()
    d[i, j] = d[j, i] = p.d.to_numpy(float)
    np.fill_diagonal(d, 0)
    return names, d


def fit_trees(distances: DataFrame, group: str, k: int, options: Options | None = None) -> DataFrame:
    """(group, newick, ss, percent_sd): one tree for each group of distances (group, s1, s2, d), each pair once or in both orders.

    A missing pair is at distance 1. A group is a matrix of samples, so its size doesn't grow with the reads. Groups run in parallel."""

    def run(p: pd.DataFrame) -> pd.DataFrame:
        names, d = _matrix(p)
        return pd.DataFrame([(p[group].iloc[0], *fit_tree(names, d, k, options))], columns=[group, "newick", "ss", "percent_sd"])

    kind = dict(distances.dtypes)[group]
    return spread(distances.select(group, "s1", "s2", "d"), group).groupBy(group).applyInPandas(run, f"{group} {kind}, {FIT}")


def fit_user_trees(distances: DataFrame, trees: DataFrame, group: str, k: int, options: Options | None = None) -> DataFrame:
    """(group, tree, newick, ss, percent_sd): lengths fitted to given topologies, for each tree (group, tree, newick) of a group of distances.

    A tree whose tips aren't the matrix' names, each once, has a null text and no fit; trees of groups without distances, and null texts, give no row.
    Each pair (group, tree) is a task of its own."""
    kinds = dict(trees.dtypes)

    def run(p: pd.DataFrame) -> pd.DataFrame:
        names, d = _matrix(p)
        given = p.newick.iloc[0]
        fits = sorted(parse(given)[0].tips()) == names
        return pd.DataFrame([(p[group].iloc[0], p.tree.iloc[0], *(fit_tree(names, d, k, options, user_tree=given) if fits else (None, None, None)))], columns=[group, "tree", "newick", "ss", "percent_sd"])

    rows = trees.where("newick is not null").select(group, "tree", "newick").join(distances.select(group, "s1", "s2", "d"), group)
    return spread(rows, group, "tree").groupBy(group, "tree").applyInPandas(run, f"{group} {kinds[group]}, tree {kinds['tree']}, {FIT}")
