"""Query graphs: a handful of vertices on the driver, with orders, checks and families."""

from __future__ import annotations

import random
from collections.abc import Sequence
from dataclasses import dataclass, field

# Edges of the topology family and of the small shapes.
SHAPES: dict[str, list[tuple[int, int]]] = {
    "path3": [(0, 1), (1, 2)],
    "triangle": [(0, 1), (1, 2), (0, 2)],
    "path4": [(0, 1), (1, 2), (2, 3)],
    "star4": [(0, 1), (0, 2), (0, 3)],
    "cycle4": [(0, 1), (1, 2), (2, 3), (0, 3)],
    "tree5": [(0, 1), (0, 2), (1, 3), (1, 4)],
    "tailed": [(0, 1), (1, 2), (0, 2), (2, 3)],
    "path6": [(0, 1), (1, 2), (2, 3), (3, 4), (4, 5)],
    "star6": [(0, 1), (0, 2), (0, 3), (0, 4), (0, 5)],
    "tree6": [(0, 1), (0, 2), (1, 3), (1, 4), (2, 5)],
    "cycle6": [(0, 1), (1, 2), (2, 3), (3, 4), (4, 5), (0, 5)],
    "dense6": [(0, 1), (0, 2), (0, 3), (1, 2), (1, 3), (2, 3), (3, 4), (4, 5), (3, 5)],
}


@dataclass
class Query:
    vectors: list[list[float]]
    edges: list[tuple[int, int]]
    sources: list[int] = field(default_factory=list)

    def __post_init__(self) -> None:
        k = len(self.vectors)
        self.edges = sorted({(min(a, b), max(a, b)) for a, b in self.edges if a != b})
        if any(not (0 <= a and b < k) for a, b in self.edges):
            raise ValueError("a query edge leaves the query")
        if len({len(v) for v in self.vectors}) > 1:
            raise ValueError("query vectors differ in dimension")

    @property
    def size(self) -> int:
        return len(self.vectors)

    @property
    def neighbours(self) -> list[list[int]]:
        out: list[list[int]] = [[] for _ in self.vectors]
        for a, b in self.edges:
            out[a].append(b)
            out[b].append(a)
        return [sorted(n) for n in out]

    def connected(self) -> bool:
        if not self.vectors:
            return False
        seen, todo, near = {0}, [0], self.neighbours
        while todo:
            for w in near[todo.pop()]:
                if w not in seen:
                    seen.add(w)
                    todo.append(w)
        return len(seen) == self.size

    def require_connected(self) -> None:
        if not self.connected():
            raise ValueError("the query graph must be connected and not empty")

    def distances(self, hops: int) -> list[dict[int, int]]:
        near, out = self.neighbours, []
        for s in range(self.size):
            dist, ring = {s: 0}, [s]
            for d in range(1, hops + 1):
                ring = sorted({w for u in ring for w in near[u] if w not in dist})
                dist.update(dict.fromkeys(ring, d))
            out.append(dist)
        return out

    def order(self, start: int, key=lambda u: u) -> list[int]:  # noqa: ANN001
        """Breadth first from start, neighbours by key; what is not reached comes last."""
        near, seen, queue = self.neighbours, {start}, [start]
        for u in queue:
            for w in sorted(near[u], key=key):
                if w not in seen:
                    seen.add(w)
                    queue.append(w)
        return queue + [u for u in range(self.size) if u not in seen]

    def join_order(self, counts: Sequence[int]) -> list[int]:
        """Smallest candidate set first, then the smallest that touches what is placed, most edges to it first."""
        near = self.neighbours
        out = [min(range(self.size), key=lambda u: (counts[u], -len(near[u]), u))]
        while len(out) < self.size:
            touching = [u for u in range(self.size) if u not in out and any(w in out for w in near[u])]
            out.append(min(touching, key=lambda u: (-sum(w in out for w in near[u]), counts[u], u)))
        return out


def nested(edges: list[tuple[int, int]], order: list[int], k: int) -> list[tuple[int, int]]:
    """Induced edges of the first k vertices of an order, renamed to places in it."""
    place = {v: i for i, v in enumerate(order[:k])}
    return sorted((min(place[a], place[b]), max(place[a], place[b])) for a, b in edges if a in place and b in place)


def densities(k: int, least: int, seed: int = 42) -> list[list[tuple[int, int]]]:
    """Edge sets on k vertices from complete down to ``least`` edges, each connected and within the one before."""
    r = random.Random(seed)
    edges = [(a, b) for a in range(k) for b in range(a + 1, k)]
    out = [list(edges)]
    while len(edges) > max(least, k - 1):
        for e in r.sample(edges, len(edges)):
            rest = [x for x in edges if x != e]
            if Query([[0.0]] * k, rest).connected():
                edges = rest
                break
        out.append(sorted(edges))
    return out
