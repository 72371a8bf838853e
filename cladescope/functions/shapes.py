"""Work on families that differ in the numbers of their genes only is done once.

Genes that are numbers as text are replaced by their ranks, which sort as they do,
and put back into what comes out. Families named otherwise are worked on as they are.
"""

from __future__ import annotations

import hashlib
import itertools
import marshal
import re
from collections.abc import Callable

_LENGTH = re.compile(r":[^,()]*")
_LEAF = re.compile(r"(?:(?<=[(,])|^)(\d+)(?=[:,);])")
_PLAIN = re.compile(r"(?!.*\)\d)[^\s'\[\]]*", re.ASCII)

#: Results kept by a worker, at most.
MOST = 160_000


def ranked(names: list[str]) -> dict[str, str] | None:
    """Name -> its rank as text of one width, if all names are digits; names of other nodes sort after both."""
    joined = "".join(names)
    if not (joined.isascii() and joined.isdigit() and all(names)):
        return None
    wide = len(str(len(names)))
    return {x: f"{i:0{wide}d}" for i, x in enumerate(sorted(names))}


def cut(newick: str) -> list[str]:
    """Text between leaves and the leaves (at odd places)."""
    return _LEAF.split(newick)


def pasted(parts: list[str], names: dict[str, str]) -> str:
    return "".join([names[x] if i % 2 else x for i, x in enumerate(parts)])


class Kept:
    """Results by key, both packed, so that many fit; when there are ``MOST`` the first of them go."""

    def __init__(self):
        self.found: dict[bytes, bytes] = {}

    def get(self, key: tuple, make: Callable):
        # without references between equal parts, which would tell equal keys apart
        short = hashlib.blake2b(marshal.dumps(key, 2), digest_size=16).digest()
        packed = self.found.get(short)
        if packed is not None:
            return marshal.loads(packed)
        out = make()
        if len(self.found) >= MOST:
            for old in list(itertools.islice(self.found, MOST // 8)):
                del self.found[old]
        self.found[short] = marshal.dumps(out)
        return out


class Histories:
    """``work(newick, species, locus)`` -> (texts, newick of the rooted tree, event lists), once for families of one shape."""

    def __init__(self, work: Callable):
        self.work, self.kept = work, Kept()

    def __call__(self, newick: str, genes: list[str], species: list[str], loci: list[int]) -> tuple:
        named = ranked(genes) if _PLAIN.fullmatch(newick) else None
        parts = cut(_LENGTH.sub("", newick)) if named else []
        if not named or len(parts) != 2 * len(genes) + 1 or len(named) != len(genes) or set(parts[1::2]) != named.keys():
            return self.work(newick, dict(zip(genes, species)), dict(zip(genes, loci)))
        known = sorted(set(loci))
        at = {x: i for i, x in enumerate(known)}
        plain = pasted(parts, named)
        # in the order given, which the work may go by
        own = tuple((named[g], s, at[x]) for g, s, x in zip(genes, species, loci))
        texts, tree, lists = self.kept.get((plain, own), lambda: self._made(plain, own))
        back = {v: k for k, v in named.items()}
        events = [[(back.get(g, g), p, e, s, b, None if x is None else known[x]) for g, p, e, s, b, x in rows] for rows in lists]
        return texts, pasted(tree, back), events

    def _made(self, plain: str, own: tuple) -> tuple:
        texts, tree, lists = self.work(plain, {g: s for g, s, _ in own}, {g: x for g, _, x in own})
        return texts, cut(tree), lists


class NearTrees:
    """``work(names, distances)`` -> newick, once for families whose genes are apart alike."""

    def __init__(self, work: Callable):
        self.work, self.kept = work, Kept()

    def __call__(self, names: list[str], distance: dict[tuple[str, str], float]) -> str:
        named = ranked(names)
        if not named or len(named) != len(names):
            return self.work(names, distance)
        order = sorted(names)
        key = tuple([distance.get((a, b), 0.0) for i, a in enumerate(order) for b in order[i + 1 :]])
        pairs = lambda: [(named[a], named[b]) for i, a in enumerate(order) for b in order[i + 1 :]]
        tree = self.kept.get((len(names), key), lambda: cut(self.work([named[x] for x in order], dict(zip(pairs(), key)))))
        return pasted(tree, {v: k for k, v in named.items()})
