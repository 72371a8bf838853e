"""Pairs of genes dealt by where both genes lie, and scores that look at a pair's surroundings.

Genes have places in one row of numbers. A tile is a square of places; a pair goes to
the bucket of its tile, and to those of the tiles whose pairs see it over the border.
Rows are packed by columns on their way, several times smaller than single rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Places along a tile's side; of 7 places seen, about a fortieth of the pairs goes to a second bucket.
SIDE = 512
#: Rows packed at once.
PACKED = 1 << 19
#: The place of a gene that has none.
NOWHERE = -1
_PAIR = ("g1", "g2", "p1", "p2", "w1", "w2")


def _count(parts: int) -> int:
    """Buckets, of which a task unpacks one at a time; many even where partitions are few, as rows aren't spilled there."""
    return max(16 * parts, 1024)


def _mixed(a: np.ndarray, b: np.ndarray, buckets: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = a.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + b.astype(np.uint64)
        x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
        return ((x ^ (x >> np.uint64(29))) % np.uint64(buckets)).astype(np.int32)


def _home(g1: np.ndarray, g2: np.ndarray, p1: np.ndarray, p2: np.ndarray, buckets: int) -> np.ndarray:
    """The bucket that scores a pair."""
    placed = (p1 >= 0) & (p2 >= 0)
    a, b = np.minimum(p1, p2) // SIDE, np.maximum(p1, p2) // SIDE
    return _mixed(np.where(placed, a, g1), np.where(placed, b, g2), buckets)


def _seen(c: dict[str, np.ndarray], reach: int, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows and buckets: every bucket once in which a row is scored or seen by another pair."""
    home = _home(*(c[x] for x in _PAIR[:4]), buckets)
    a, b = np.minimum(c["p1"], c["p2"]), np.maximum(c["p1"], c["p2"])
    low, high = lambda p: np.maximum(p - reach, 0) // SIDE, lambda p: (p + reach) // SIDE
    edge = np.flatnonzero((a >= 0) & ((low(a) != high(a)) | (low(b) != high(b))))
    ends = [(f(a[edge]), g(b[edge])) for f in (low, high) for g in (low, high)]
    at = [_mixed(np.minimum(x, y), np.maximum(x, y), buckets) for x, y in ends]
    one = np.concatenate([np.arange(len(home)) * buckets + home, *(edge * buckets + x for x in at)])
    one = np.unique(one) if len(edge) else one
    return one // buckets, (one % buckets).astype(np.int32)


def _columns(batches: list[pa.RecordBatch], names: tuple[str, ...]) -> dict[str, np.ndarray]:
    table = pa.Table.from_batches(batches)
    return {x: table.column(x).to_numpy() for x in names}


def _summed(c: dict[str, np.ndarray], *first: np.ndarray) -> tuple[list[np.ndarray], dict[str, np.ndarray]]:
    """One row for each pair of genes (and value of ``first``), in their order."""
    by = np.lexsort((c["g2"], c["g1"], *first))
    c, first = {x: v[by] for x, v in c.items()}, [x[by] for x in first]
    new = np.ones(len(by), bool)
    new[1:] = np.any([x[1:] != x[:-1] for x in (*first, c["g1"], c["g2"])], axis=0)
    at = np.flatnonzero(new)
    return [x[at] for x in first], {x: np.add.reduceat(v, at) if x in ("w1", "w2") else v[at] for x, v in c.items()}


def _pack(c: dict[str, np.ndarray]) -> bytes:
    """Bytes of one significance lie together; the first gene ascends, so its steps are small."""
    rows = np.array([np.diff(c["g1"], prepend=0), c["g2"] - c["g1"], *(c[x] for x in _PAIR[2:])], "<i8")
    return pa.compress(np.ascontiguousarray(rows.view(np.uint8).reshape(6, -1, 8).transpose(0, 2, 1)), "zstd", asbytes=True)


def _unpack(n: int, packed: pa.Buffer) -> np.ndarray:
    rows = np.frombuffer(pa.decompress(packed, n * 48, "zstd"), np.uint8).reshape(6, 8, n).transpose(0, 2, 1)
    out = np.ascontiguousarray(rows).view("<i8").reshape(6, n).copy()
    out[0] = np.cumsum(out[0])
    out[1] += out[0]
    return out


def _groups(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, list[pa.RecordBatch]]]:
    """The rows of one bucket after the other; they lie together."""
    now, held = -1, []
    for batch in batches:
        b = batch.column("bucket").to_numpy()
        cuts = [0, *(np.flatnonzero(b[1:] != b[:-1]) + 1), len(b)] if len(b) else []
        for i, j in zip(cuts, cuts[1:]):
            if held and b[i] != now:
                yield now, held
                held = []
            now = int(b[i])
            held.append(batch.slice(i, j - i))
    if held:
        yield now, held


def summed_pairs(pairs: DataFrame, parts: int, reach: int) -> DataFrame:
    """bucket, g1, g2, p1, p2, w1, w2: weights of a pair of genes summed, in every bucket that scores or sees it.

    pairs: g1 < g2, their places p1, p2 (NOWHERE without one), whole weights w1, w2; a pair may
    come often. Buckets lie together in the rows, ``parts`` partitions hold them.
    """
    buckets = _count(parts)

    def pack(batches):
        held, n = [], 0

        def flushed():
            c = _columns(held, _PAIR)
            held.clear()
            rows, at = _seen(c, reach, buckets)
            (at,), c = _summed({x: v[rows] for x, v in c.items()}, at)
            cuts = np.flatnonzero(np.diff(at, prepend=-1, append=buckets))
            ends = list(zip(cuts, cuts[1:]))
            packed = [_pack({x: v[i:j] for x, v in c.items()}) for i, j in ends]
            yield pa.RecordBatch.from_arrays([pa.array(at[cuts[:-1]], pa.int32()), pa.array([j - i for i, j in ends], pa.int64()), pa.array(packed, pa.binary())], ["bucket", "n", "packed"])

        for batch in batches:
            held.append(batch)
            n += batch.num_rows
            if n >= PACKED:
                yield from flushed()
                n = 0
        if n:
            yield from flushed()

    def unpack(batches):
        for bucket, rows in _groups(batches):
            found = np.concatenate([_unpack(n.as_py(), x.as_buffer()) for r in rows for n, x in zip(r.column("n"), r.column("packed"))], axis=1)
            _, c = _summed(dict(zip(_PAIR, found)))
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(c["g1"]), bucket, np.int32)), *(pa.array(c[x]) for x in _PAIR)], ["bucket", *_PAIR])

    dealt = pairs.select(*(F.col(x).cast("long") for x in _PAIR)).mapInArrow(pack, "bucket int, n long, packed binary")
    dealt = dealt.repartition(parts, "bucket").sortWithinPartitions("bucket")
    return dealt.mapInArrow(unpack, "bucket int, " + ", ".join(f"{x} long" for x in _PAIR))


def _greedy(pair: np.ndarray, score: np.ndarray, x: np.ndarray, y: np.ndarray, n: int, take: int) -> np.ndarray:
    """``scores.greedy_matching`` for the candidates of n pairs at once."""
    by = np.lexsort((y, x, -score, pair))
    pair, score, x, y = pair[by], score[by], x[by], y[by]
    total = np.zeros(n)
    for _ in range(take):
        if not len(pair):
            break
        first = np.flatnonzero(np.diff(pair, prepend=-1))
        total[pair[first]] += score[first]
        of = np.repeat(first, np.diff(first, append=len(pair)))
        left = (x != x[of]) & (y != y[of])
        pair, score, x, y = pair[left], score[left], x[left], y[left]
    return total / take


def synteny_scores(edges: DataFrame, parts: int, size: int = 8, take: int = 3) -> DataFrame:
    """g1, g2, syn_sc of edges in buckets (bucket, g1, g2, p1, p2, raw_sc), as ``scores.synteny_scores``
    has it with the neighbours of ``order.synteny_neighbours``: half of ``size`` back and one less forward.

    The rows come from ``summed_pairs`` with these parts and a reach of half of ``size`` at least; of
    rows of one edge the best counts. A bucket's edges are sorted by both places, each way round,
    so a pair's candidates are a few ranges of them.
    """
    back, ahead, buckets = size // 2, size // 2 - 1, _count(parts)
    names = ("g1", "g2", "p1", "p2", "raw_sc")

    def run(batches):
        for bucket, rows in _groups(batches):
            c = _columns(rows, names)
            by = np.lexsort((-c["raw_sc"], c["g2"], c["g1"]))
            by = by[np.flatnonzero(np.concatenate([[True], np.diff(c["g1"][by]) | np.diff(c["g2"][by])]))]
            g1, g2, p1, p2, raw = (c[x][by] for x in names)
            if max(p1.max(), p2.max()) + size >= 1 << 31:
                raise ValueError("too many places")
            own, placed = _home(g1, g2, p1, p2, buckets) == bucket, (p1 >= 0) & (p2 >= 0)
            key, other = (p1 << 32 | p2), (p2 << 32 | p1)
            table, score = np.concatenate([key[placed], other[placed]]), np.concatenate([raw[placed], raw[placed]])
            order = np.argsort(table, kind="stable")
            table, score = table[order], score[order]
            asked = np.flatnonzero(own & placed)
            asked = asked[np.argsort(key[asked])]
            found = []
            for d in range(-back, ahead + 1):
                if d:
                    at = key[asked] + (d << 32)
                    low, high = np.searchsorted(table, at - back), np.searchsorted(table, at + ahead, "right")
                    some = np.flatnonzero(high > low)
                    n = (high - low)[some]
                    found.append((np.repeat(some, n), np.repeat(low[some] - np.cumsum(n) + n, n) + np.arange(n.sum())))
            pair, hit = (np.concatenate(x) for x in zip(*found))
            beside = (table[hit] & 0xFFFFFFFF) != p2[asked[pair]]
            pair, hit = pair[beside], hit[beside]
            out = np.zeros(len(g1))
            out[asked] = _greedy(pair, score[hit], table[hit] >> 32, table[hit] & 0xFFFFFFFF, len(asked), take)
            if own.any():
                yield pa.RecordBatch.from_arrays([pa.array(g1[own]), pa.array(g2[own]), pa.array(out[own])], ["g1", "g2", "syn_sc"])

    return edges.select("bucket", *names[:4], F.col("raw_sc").cast("double")).mapInArrow(run, "g1 long, g2 long, syn_sc double")
