"""The two path searches of ``graph``, pair by pair in the tasks.

Where the whole graph fits a worker, a pair's rounds need no shuffle: each task holds the
graph as sorted arrays and runs a pair's rounds on its own, the same rounds with the same
sums and the same ties as the search over tables, so it gives the same paths.
"""

from __future__ import annotations

import math

import numpy as np

CACHED = 1 << 16  # nodes whose legs a task keeps as Python lists


class Legs:
    """Legs of one direction, by node: ``(next, cost)``."""

    def __init__(self, node: np.ndarray, following: np.ndarray, cost: np.ndarray):
        order = np.lexsort((following, node))
        node = node[order]
        self.first = np.flatnonzero(np.diff(node, prepend=node[:1] - 1)) if len(node) else np.zeros(0, np.int64)
        self.nodes, self.end = node[self.first], np.append(self.first[1:], len(node))
        self.following, self.cost, self.known = following[order], cost[order], {}

    def of(self, node: int) -> list[tuple[int, float]]:
        legs = self.known.get(node)
        if legs is None:
            k = int(np.searchsorted(self.nodes, node))
            at = slice(self.first[k], self.end[k]) if k < len(self.nodes) and self.nodes[k] == node else slice(0, 0)
            legs = list(zip(self.following[at].tolist(), self.cost[at].tolist()))
            if len(self.known) >= CACHED:
                self.known.clear()
            self.known[node] = legs
        return legs


def meet(ahead: Legs, behind: Legs, step: float, source: int, target: int, any_path: bool):
    """``(cost, hops, path)`` of the cheapest path (any path with ``any_path``), or None: the rounds of ``graph._meet``."""
    f, b = {source: (0.0, 1, (source,))}, {target: (0.0, 1, (target,), ())}
    open_f, open_b = {source: 0.0}, {target: 0.0}
    whole = {}

    def joined(node):
        x, y = f[node], b[node]
        total = x[0]
        for w in y[3]:
            total += w
        whole[node] = total, x[1] + y[1] - 2, x[2] + y[2][1:]

    if source == target:
        joined(source)
    while True:
        best = min(whole.values()) if whole else None
        if not open_f or not open_b or (best is not None and any_path):
            return best
        tf, tb = min(open_f.values()), min(open_b.values())
        if best is not None and not tf + tb < best[0]:
            return best
        left = math.inf if best is None else best[0]
        back = len(open_b) < len(open_f)
        mine, its, other, legs = (b, open_b, f, behind) if back else (f, open_f, b, ahead)
        top, far = (tb, tf) if back else (tf, tb)
        new: dict = {}
        out = [(node, mine[node]) for node, c in its.items() if c <= top + step and c + far < left]
        for node, label in out:
            for following, w in legs.of(node):
                at = label[0] + w
                if not at < left:
                    continue
                had = new.get(following)
                if had is not None and had[0] < at:
                    continue
                if back:
                    made = at, label[1] + 1, (following, *label[2]), (w, *label[3])
                else:
                    made = at, label[1] + 1, (*label[2], following)
                if had is None or made < had:
                    new[following] = made
            del its[node]
        limit = left - far
        for node, label in new.items():
            had = mine.get(node)
            if had is None:
                if node not in other and not label[0] < limit:
                    continue
            elif not label < had:
                continue
            mine[node] = label
            if had is None or label[0] < had[0]:
                its[node] = label[0]
            if node in other:
                joined(node)


class Goal:
    """Weighted distance of nodes from one goal: ``weight * (1 - cos)``, 0 where a vector is missing."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, weight: float, goal: int):
        self.ids, self.vectors, self.weight, self.known = ids, vectors, weight, {}
        at = self.rows([goal])[0]
        self.goal = None if at < 0 else vectors[at].astype(np.float64)
        self.length = None if at < 0 else lengths(self.goal[None, :])[0]

    def rows(self, nodes) -> np.ndarray:
        nodes = np.asarray(nodes, dtype=np.int64)
        at = np.minimum(np.searchsorted(self.ids, nodes), len(self.ids) - 1)
        return np.where(self.ids[at] == nodes, at, -1)

    def of(self, nodes: list[int]) -> list[float]:
        todo = [n for n in nodes if n not in self.known]
        if todo:
            h = np.zeros(len(todo))
            at = self.rows(todo)
            if self.goal is not None and (at >= 0).any():
                x = self.vectors[at[at >= 0]].astype(np.float64)
                # summed one by one, as the column expression does
                dot = np.cumsum(x * self.goal, axis=1)[:, -1]
                h[at >= 0] = self.weight * (1.0 - dot / (lengths(x) * self.length))
            self.known.update(zip(todo, h.tolist()))
        return [self.known[n] for n in nodes]


def lengths(x: np.ndarray) -> np.ndarray:
    return np.sqrt(np.cumsum(x * x, axis=1)[:, -1])


def relax(ahead: Legs, goal: Goal, source: int, target: int, beam: int):
    """``(cost, path)`` or None of one beam search, and whether it left out a node: the rounds of ``graph._relax``."""
    state = {source: (0.0, (source,))}
    frontier, pruned = [(source, *state[source])], False
    while True:
        bound = state[target][0] if target in state else math.inf
        found: dict = {}
        for node, c, path in frontier:
            for following, w in ahead.of(node):
                cost = c + w
                old = state.get(following)
                if not cost < bound or (old is not None and not cost < old[0]) or following in path:
                    continue
                had = found.get(following)
                if had is None or cost <= had[0]:
                    made = cost, (*path, following)
                    if had is None or made < had:
                        found[following] = made
        if not found:
            return state.get(target), pruned
        state.update(found)
        nodes = list(found)
        if len(nodes) > beam:
            pruned = True
            ranked = sorted((found[n][0] + h, n) for n, h in zip(nodes, goal.of(nodes)))
            nodes = [n for _, n in ranked[:beam]]
        frontier = [(n, *found[n]) for n in nodes]
