"""Approximate nearest neighbours by a hierarchical navigable small-world graph per shard.

Equal vectors are one node that names its smallest ids, so copies of a common
vector neither crowd a graph's links nor gather in a task. Distinct vectors are
dealt evenly to shards of about SHARD nodes by a hash. A shard inserts its nodes
in hash order: a search of the graph so far finds the candidates of a new node on
every layer up to its level; it links to diverse ones of them, and they back. The
graph is stored as flat neighbour arrays, one row a shard, in the shared folder.

Queries go in blocks of BLOCK bytes to every shard (a block and a shard meet in a
task), descend the layers, search the lowest with a beam, and the shards' results
are merged by score. Both sides of a task have fixed bounds; nothing is
broadcast or gathered. Each shard sees every query: vectors without clusters (the
nearest of the test tables' have a cosine of 0.4) have their neighbours in all
parts of a space, so to route queries to a few shards would lose them.

Defined cases: vectors that are null, empty, zero or hold null or non-finite
components take no part, nor do rows with a null id; rows equal in id and vector
are one row; vectors are compared with vectors of their own length; ties go to
the smaller id; fewer candidates than asked for are all returned; an empty table
gives an empty one; extra columns are ignored.
"""

from __future__ import annotations

import heapq
import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cladescope.llm.common import materialize

#: Nodes of a shard, bytes of the vectors of a block of queries, neighbours returned.
SHARD, BLOCK, NEAREST = 4096, 1 << 25, 5
#: Links of a node on upper layers and on the lowest; candidates of an insertion; beam of a search.
LINKS, LINKS_0, CANDIDATES, BEAM = 12, 24, 64, 128


def _levels(keys: np.ndarray) -> np.ndarray:
    """Geometric levels from the nodes' hashes."""
    u = ((keys.astype(np.uint64) >> np.uint64(11)).astype(np.float64) + 1) / (1 << 53)
    return np.minimum((-np.log(np.minimum(u, 1.0)) / math.log(LINKS)).astype(np.int64), 12)


def _diverse(order: list[int], near: np.ndarray, most: int) -> list[int]:
    """Of candidates in falling nearness those that are nearer to the node than to any chosen before; filled up with the rest."""
    to_node, among = near[0], near[1:]
    chosen: list[int] = []
    rest: list[int] = []
    closest = np.full(len(order), -np.inf)
    for i in range(len(order)):
        if closest[i] < to_node[i]:
            chosen.append(i)
            if len(chosen) == most:
                break
            np.maximum(closest, among[i], out=closest)
        else:
            rest.append(i)
    return [order[i] for i in chosen + rest[: max(0, min(most // 2, most - len(chosen)))]]


class Graph:
    """Layers of flat neighbour arrays: ``nodes[l]`` ascending, ``links[l]`` one row of member numbers a node, -1 where free."""

    def __init__(self, unit: np.ndarray, nodes: list[np.ndarray], links: list[np.ndarray], entry: int):
        self.nodes, self.links, self.entry = nodes, links, entry
        self.vectors = [unit[n] if len(n) < len(unit) else unit for n in nodes]
        self.counts = [(x >= 0).sum(1) for x in links]
        self.seen = [np.zeros(len(n), np.int64) for n in nodes]
        self.turn = 0

    @staticmethod
    def build(unit: np.ndarray, keys: np.ndarray) -> "Graph":
        """unit: normalised vectors in insertion order; keys: their hashes."""
        levels = _levels(keys)
        nodes = [np.flatnonzero(levels >= layer) for layer in range(int(levels.max()) + 1)]
        links = [np.full((len(n), LINKS if layer else LINKS_0), -1, np.int32) for layer, n in enumerate(nodes)]
        graph = Graph(unit, nodes, links, 0)
        top = int(levels[0])
        for i in range(1, len(unit)):
            graph._insert(i, int(levels[i]), top)
            if levels[i] > top:
                graph.entry, top = i, int(levels[i])
        return graph

    def _insert(self, i: int, level: int, top: int) -> None:
        """Link node ``i`` on its layers to diverse ones of the near nodes that a search from the entry finds."""
        q = self.vectors[0][i]
        start = [self._descend(q, top, level)]
        for layer in range(min(level, top), -1, -1):
            members, links, counts = self.nodes[layer], self.links[layer], self.counts[layer]
            found = self._beam(layer, q, np.searchsorted(members, start).tolist(), CANDIDATES)
            start = members[[x for _, x in found]].tolist()
            most = links.shape[1]
            own = int(np.searchsorted(members, i))
            chosen = self._choose(layer, np.array([s for s, _ in found]), [x for _, x in found], most if layer else most // 2)
            links[own, : len(chosen)] = chosen
            counts[own] = len(chosen)
            for j in chosen:
                if counts[j] < most:
                    links[j, counts[j]] = own
                    counts[j] += 1
                    continue
                back = np.append(links[j], own)
                near = self.vectors[layer][back] @ self.vectors[layer][j]
                turn = np.argsort(-near, kind="stable")
                kept = self._choose(layer, near[turn], back[turn].tolist(), most)
                links[j] = -1
                links[j, : len(kept)] = kept
                counts[j] = len(kept)

    def _choose(self, layer: int, near: np.ndarray, order: list[int], most: int) -> list[int]:
        v = self.vectors[layer][order]
        return _diverse(order, np.concatenate([near[None], v @ v.T]), most)

    def _descend(self, q: np.ndarray, top: int, level: int) -> int:
        """The node that greedy steps on the layers from ``top`` to above ``level`` reach."""
        node = self.entry
        for layer in range(top, level, -1):
            members, vectors, links, counts = self.nodes[layer], self.vectors[layer], self.links[layer], self.counts[layer]
            at = int(np.searchsorted(members, node))
            best = float(vectors[at] @ q)
            while counts[at]:
                row = links[at, : counts[at]]
                near = vectors[row] @ q
                k = int(near.argmax())
                if near[k] <= best:
                    break
                at, best = int(row[k]), float(near[k])
            node = int(members[at])
        return node

    def _beam(self, layer: int, q: np.ndarray, start: list[int], beam: int) -> list[tuple[float, int]]:
        """(nearness, member) of the best members found on a layer, nearest first."""
        vectors, links, counts, seen = self.vectors[layer], self.links[layer], self.counts[layer], self.seen[layer]
        self.turn += 1
        turn = self.turn
        seen[start] = turn
        found = [(s, x) for s, x in zip((vectors[start] @ q).tolist(), start)]
        todo = [(-s, x) for s, x in found]
        heapq.heapify(found)
        heapq.heapify(todo)
        while todo:
            d, x = heapq.heappop(todo)
            if len(found) >= beam and -d < found[0][0]:
                break
            row = links[x, : counts[x]]
            row = row[seen[row] != turn]
            if not len(row):
                continue
            seen[row] = turn
            near = vectors[row] @ q
            if len(found) >= beam:
                keep = near > found[0][0]
                near, row = near[keep], row[keep]
            for s, y in zip(near.tolist(), row.tolist()):
                if len(found) < beam:
                    heapq.heappush(found, (s, y))
                elif s > found[0][0]:
                    heapq.heapreplace(found, (s, y))
                else:
                    continue
                heapq.heappush(todo, (-s, y))
        return sorted(found, key=lambda x: (-x[0], x[1]))

    def search(self, q: np.ndarray, beam: int) -> list[tuple[float, int]]:
        """(nearness, node) of the best nodes found, nearest first."""
        return self._beam(0, q, [self._descend(q, len(self.nodes) - 1, 0)], beam)


def _unit(vectors: np.ndarray) -> np.ndarray:
    scale = np.abs(vectors).max(1, keepdims=True)
    scaled = vectors / scale
    return scaled / np.sqrt((scaled * scaled).sum(1, keepdims=True))


def cosine(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Cosines of one vector with the rows of ``b``, in double precision."""
    return (b @ a) / (np.sqrt((b * b).sum(1)) * math.sqrt(float(a @ a)))


def _usable(vectors: DataFrame) -> DataFrame:
    x = F.col("vector")
    finite = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    rows = vectors.select(vectors["vec_id"].cast("long").alias("vec_id"), vectors["embedding"].cast("array<double>").alias("vector"))
    rows = rows.where(F.col("vec_id").isNotNull() & x.isNotNull() & finite & F.exists(x, lambda v: v != 0))
    return rows.withColumn("vector", F.transform(x, lambda v: v + 0.0)).withColumn("key", F.xxhash64("vector"))


def build_index(vectors: DataFrame, shard_rows: int = SHARD, ids: int = NEAREST + 1) -> DataFrame:
    """dim, shard, n, ids (smallest ``ids`` of each node, flat with counts), vectors, layers: a row per shard."""
    first = Window.partitionBy("key", "vector").orderBy("vec_id")
    # rows that repeat go first, so a rank is an id's; it is cut before the shuffle as well, so copies of one vector don't meet in numbers
    few = _usable(vectors).dropDuplicates(["vec_id", "key", "vector"]).withColumn("rank", F.row_number().over(first)).where(F.col("rank") <= ids)
    few = few.groupBy("key", "vector").agg(F.slice(F.array_sort(F.collect_set("vec_id")), 1, ids).alias("ids"))
    distinct = materialize(few.withColumn("dim", F.size("vector")), "vectors")
    # vectors of another length have as many shards; those hold less
    shards = max(1, math.ceil(distinct.count() / shard_rows))
    dealt = distinct.withColumn("shard", F.pmod(F.xxhash64("key", F.lit("shard")), F.lit(shards)).cast("int"))
    # a number of its own, else Spark would join the few small partitions into one task
    dealt = dealt.repartition(shards, "dim", "shard")

    def build(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("key", kind="stable")
        raw = np.array(frame["vector"].tolist(), np.float64)
        graph = Graph.build(_unit(raw), frame["key"].to_numpy())
        held = frame["ids"].tolist()
        return pd.DataFrame(
            {
                "dim": [raw.shape[1]],
                "shard": [frame["shard"].iloc[0]],
                "ids": [np.concatenate(held).astype("<i8").tobytes()],
                "counts": [np.array([len(x) for x in held], "<i4").tobytes()],
                "vectors": [raw.tobytes()],
                "nodes": [[x.astype("<i4").tobytes() for x in graph.nodes]],
                "links": [[x.astype("<i4").tobytes() for x in graph.links]],
                "entry": [graph.entry],
            }
        )

    schema = "dim int, shard int, ids binary, counts binary, vectors binary, nodes array<binary>, links array<binary>, entry int"
    return materialize(dealt.groupBy("dim", "shard").applyInPandas(build, schema), "graphs")


class _Shard:
    """A shard read back from its row."""

    def __init__(self, row):
        self.vectors = np.frombuffer(row["vectors"], np.float64).reshape(-1, row["dim"])
        counts = np.frombuffer(row["counts"], "<i4")
        self.ids = np.frombuffer(row["ids"], "<i8")
        self.at = np.concatenate([[0], np.cumsum(counts)])
        nodes = [np.frombuffer(x, "<i4") for x in row["nodes"]]
        links = [np.frombuffer(x, "<i4").reshape(len(n), -1) for n, x in zip(nodes, row["links"])]
        self.graph = Graph(_unit(self.vectors), nodes, links, row["entry"])

    def nearest(self, own: int, q: np.ndarray, k: int, beam: int) -> list[tuple[float, int]]:
        """(score, id) of the best k other rows found."""
        found = [x for _, x in self.graph.search(_unit(q[None])[0], beam)]
        out: list[tuple[float, int]] = []
        scores = cosine(q, self.vectors[found])
        for i in np.lexsort((self.ids[self.at[found]], -scores)).tolist():
            if len(out) >= k and scores[i] < out[k - 1][0]:
                break
            node = found[i]
            out += [(float(scores[i]), int(x)) for x in self.ids[self.at[node] : self.at[node + 1]] if x != own][: k + 1]
        return sorted(out, key=lambda x: (-x[0], x[1]))[:k]


def search_index(index: DataFrame, queries: DataFrame, k: int = NEAREST, beam: int = BEAM, block_bytes: int = BLOCK) -> DataFrame:
    """query_id, rank, vec_id, score of the ``k`` nearest other rows found for every row of ``queries`` (vec_id, embedding)."""
    asked = materialize(_usable(queries).dropDuplicates(["vec_id", "key", "vector"]).withColumn("dim", F.size("vector")), "queries")
    size = asked.agg(F.count("*").alias("n"), F.max("dim").alias("dim")).first()
    blocks = max(1, math.ceil(size["n"] * 8 * (size["dim"] or 1) / block_bytes))
    asked = asked.withColumn("block", F.pmod(F.xxhash64("vec_id"), F.lit(blocks)).cast("int"))
    # one small row a shard: its list of shards meets the queries of its length
    shards = index.groupBy(F.col("dim").alias("of_dim")).agg(F.collect_list("shard").alias("of_shards"))
    left = index.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    right = asked.join(shards, F.col("dim") == F.col("of_dim")).select(F.col("dim").alias("q_dim"), F.explode("of_shards").alias("q_shard"), F.col("block").alias("q_block"), "vec_id", "vector")
    tasks = max(1, index.count() * blocks)
    left, right = left.repartition(tasks, "dim", "shard", "block"), right.repartition(tasks, "q_dim", "q_shard", "q_block")

    def run(key, one: pd.DataFrame, asked: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(one) and len(asked):
            shard = _Shard(one.iloc[0])
            for own, v in zip(asked["vec_id"], asked["vector"]):
                out += [(own, x, s) for s, x in shard.nearest(own, np.array(v, np.float64), k, beam)]
        return pd.DataFrame(out, columns=["query_id", "vec_id", "score"]).astype({"query_id": "int64", "vec_id": "int64", "score": "float64"})

    found = left.groupBy("dim", "shard", "block").cogroup(right.groupBy("q_dim", "q_shard", "q_block")).applyInPandas(run, "query_id long, vec_id long, score double")
    merged = found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return merged.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
