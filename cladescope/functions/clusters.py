"""Clustering kernels for one group."""

from __future__ import annotations


class UnionFind:
    def __init__(self, nodes):
        self.top = {n: n for n in nodes}

    def find(self, x):
        while self.top[x] != x:
            self.top[x] = x = self.top[self.top[x]]
        return x

    def join(self, a, b) -> None:
        a, b = self.find(a), self.find(b)
        if a != b:
            self.top[max(a, b)] = min(a, b)

    def groups(self) -> list[list]:
        out: dict = {}
        for n in sorted(self.top):
            out.setdefault(self.find(n), []).append(n)
        return list(out.values())


def components(nodes, edges) -> list[list]:
    """Components of (a, b, ...) edges, each sorted, by smallest member."""
    found = UnionFind(nodes)
    for a, b, *_ in edges:
        found.join(a, b)
    return sorted(found.groups())


def capped_split(nodes, edges, cap: int, steps: int = 25) -> list[list]:
    """Components after the fewest of the weakest edges go so that none exceeds ``cap``.

    Edges (a, b, score) are cut by their place in the order of (score, a, b); the
    place is found by bisection and the bisection's upper end is taken.
    """
    ordered = sorted(edges, key=lambda e: (e[2], e[0], e[1]))
    low, high = 0, len(ordered)
    for _ in range(steps):
        if high - low <= 1:
            break
        middle = (low + high) // 2
        if max(map(len, components(nodes, ordered[middle:]))) <= cap:
            high = middle
        else:
            low = middle
    if max(map(len, components(nodes, ordered)), default=0) <= cap:
        high = 0
    return components(nodes, ordered[high:])


def bounded_clusters(items: list, near, most: int = 50) -> list[list]:
    """Grow clusters of at most ``most`` from the last remaining item, along ``near(a, b)``."""
    left, out = list(items), []
    while left:
        cluster, waiting = [], [left.pop()]
        while waiting and len(cluster) < most:
            x = waiting.pop()
            cluster.append(x)
            found = [y for y in left if near(x, y)]
            room = most - len(cluster) - len(waiting)
            for y in found[: max(room, 0)]:
                left.remove(y)
                waiting.append(y)
        cluster += waiting
        out.append(cluster)
    return out
