"""Islands of locus families: rearrangement parsimony and agglomeration at one species node."""

from __future__ import annotations

from cladescope.functions.trees import Tree


def side_cost(tree: Tree, node: str, near: dict[str, bool]) -> tuple[int, int]:
    """Fewest changes below ``node`` if two families are apart there, and if they are together.

    Leaves follow what the strains show; a change along a branch costs one.
    """
    value: dict[str, tuple[int, int]] = {}
    for n in tree.postorder(node):
        kids = tree.children.get(n)
        if not kids:
            together = near.get(n, False)
            value[n] = (int(together), int(not together))
        else:
            value[n] = (sum(min(value[c][0], 1 + value[c][1]) for c in kids), sum(min(value[c][1], 1 + value[c][0]) for c in kids))
    return value[node]


def cost_difference(tree: Tree, node: str, near: dict[str, bool]) -> int:
    """How much dearer it is that two families were apart at ``node`` than together."""
    apart, together = side_cost(tree, node, near)
    return apart - together


#: Ends of the first and second island that meet: 0 last-first, 1 last-last, 2 first-first, 3 first-last.
ENDS = ((-1, 0), (-1, -1), (0, 0), (0, -1))


def merged(a: list[int], b: list[int], orientation: int) -> list[int]:
    return (a + b, a + b[::-1], b[::-1] + a, b + a)[orientation]


def best_orientation(a: list[int], b: list[int], difference) -> tuple[float, int]:
    """Highest difference over the four ways that ends can meet; the first of equals."""
    found = [difference(a[i], b[j]) for i, j in ENDS]
    best = max(found)
    return best, found.index(best)


def agglomerate(islands: dict[int, list[int]], difference, least: float = 0) -> dict[int, list[int]]:
    """Merge the best pair while it reaches ``least``; the lower id stays and comes first. Ties by ids."""
    now = {k: list(v) for k, v in islands.items()}
    scores = {}
    ids = sorted(now)
    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            scores[a, b] = best_orientation(now[a], now[b], difference)
    while scores:
        pair = min(scores, key=lambda p: (-scores[p][0], p))
        value, orientation = scores[pair]
        if value < least:
            break
        a, b = pair
        now[a] = merged(now[a], now.pop(b), orientation)
        scores = {p: v for p, v in scores.items() if b not in p and a not in p}
        for c in now:
            if c != a:
                p = (min(a, c), max(a, c))
                scores[p] = best_orientation(now[p[0]], now[p[1]], difference)
    return now
