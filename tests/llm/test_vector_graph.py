"""Recall and exact scores against brute force; copies, odd vectors, few rows."""

import numpy as np

from cladescope.llm import vector_graph as V


def brute(ids, vectors, queries, k):
    out = {}
    for i in queries:
        at = ids.index(i)
        score = V.cosine(vectors[at], vectors)
        order = sorted((j for j in range(len(ids)) if ids[j] != i), key=lambda j: (-score[j], ids[j]))[:k]
        out[i] = [(ids[j], score[j]) for j in order]
    return out


def test_recall(spark):
    rows = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    frame = rows.toPandas().sort_values("vec_id")
    ids, vectors = frame["vec_id"].tolist(), np.array(frame["embedding"].tolist(), np.float64)
    queries = [i for i in ids if i % 50 == 0]
    want = brute(ids, vectors, queries, 5)
    index = V.build_index(rows, shard_rows=512)
    assert index.count() == 4
    got: dict = {}
    for r in V.search_index(index, rows.where("vec_id % 50 = 0"), block_bytes=16 * 64 * 8).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    assert set(got) == set(queries) and all([r for r, *_ in got[i]] == [1, 2, 3, 4, 5] for i in queries)
    hit = sum(len({x for _, x, _ in got[i]} & {x for x, _ in want[i]}) for i in queries)
    assert hit / (5 * len(queries)) >= 0.97
    at = {i: k for k, i in enumerate(ids)}
    for i in queries:
        for _, x, s in got[i]:
            assert abs(s - float(vectors[at[i]] @ vectors[at[x]] / np.linalg.norm(vectors[at[i]]) / np.linalg.norm(vectors[at[x]]))) < 1e-12
        assert [s for *_, s in got[i]] == sorted((s for *_, s in got[i]), reverse=True)


def test_copies_and_odd_vectors(spark):
    rng = np.random.default_rng(3)
    common = [1.0, 2.0, 3.0, 4.0]
    rows = [(i, common) for i in range(0, 300)] + [(1000 + i, rng.normal(size=4).round(2).tolist()) for i in range(40)]
    rows += [(5000, None), (5001, []), (5002, [0.0] * 4), (5003, [1.0, None, 0.0, 0.0]), (5004, [float("nan"), 1.0, 1.0, 1.0]), (5005, [float("inf"), 1.0, 1.0, 1.0]), (None, common), (0, common), (7000, [1.0, 1.0]), (7050, [1.0, 2.0])]
    vectors = spark.createDataFrame([(*r, "x", 1) for r in rows], "vec_id long, embedding array<float>, key string, shard int")
    found = V.search_index(V.build_index(vectors), vectors.where("vec_id % 50 = 0")).orderBy("query_id", "rank").collect()
    got: dict = {}
    for r in found:
        got.setdefault(r.query_id, []).append((r.vec_id, r.score))
    assert [x for x, _ in got[0]] == [1, 2, 3, 4, 5] and [x for x, _ in got[50]] == [0, 1, 2, 3, 4]
    assert all(abs(s - 1) < 1e-12 for _, s in got[0])
    assert [x for x, _ in got[7000]] == [7050] and [x for x, _ in got[7050]] == [7000]
    assert 5000 not in got and not {x for v in got.values() for x, _ in v} & set(range(5000, 5006))
    kept = [(i, v) for i, v in dict((r[0], r[1]) for r in rows if r[0] is not None and r[1] and len(r[1]) == 4 and r[0] < 5000).items()]
    ids, array = [i for i, _ in kept], np.array([v for _, v in kept], np.float32).astype(np.float64)
    want = brute(ids, array, [1000], 5)[1000]
    assert [x for x, _ in got[1000]] == [x for x, _ in want]
    assert V.search_index(V.build_index(vectors.limit(0)), vectors.limit(0)).count() == 0
    one = vectors.where("vec_id = 1")
    assert V.search_index(V.build_index(one), one).count() == 0


def test_repeated_rows_take_no_places(spark):
    common = [1.0, 2.0, 3.0, 4.0]
    rows = [(i, common) for i in range(300)] * 2 + [(0, common)] * 20 + [(1000 + i, [4.0, 3.0, 2.0, float(i)]) for i in range(10)]
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got: dict = {}
    for r in V.search_index(V.build_index(vectors), vectors.where("vec_id in (0, 3, 200)")).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.vec_id, r.score))
    assert {q: [x for x, _ in v] for q, v in got.items()} == {0: [1, 2, 3, 4, 5], 3: [0, 1, 2, 4, 5], 200: [0, 1, 2, 3, 4]}
    assert all(abs(s - 1) < 1e-12 for v in got.values() for _, s in v)


def test_recall_with_production_parameters(spark):
    rows = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    frame = rows.toPandas().sort_values("vec_id")
    ids, vectors = frame["vec_id"].tolist(), np.array(frame["embedding"].tolist(), np.float64)
    queries = [i for i in ids if i % 50 == 0]
    want = brute(ids, vectors, queries, 5)
    got: dict = {}
    for r in V.search_index(V.build_index(rows), rows.where("vec_id % 50 = 0")).collect():
        got.setdefault(r.query_id, set()).add(r.vec_id)
    assert sum(len(got[i] & {x for x, _ in want[i]}) for i in queries) / (5 * len(queries)) >= 0.97


def test_insertions_find_their_neighbours_through_the_graph():
    rng = np.random.default_rng(2)
    unit = V._unit(rng.normal(size=(1500, 16)))
    graph = V.Graph.build(unit, rng.integers(0, 1 << 63, 1500))
    for layer, links in enumerate(graph.links):
        assert links.shape[1] == (V.LINKS if layer else V.LINKS_0) and links.max() < len(graph.nodes[layer])
        assert all(i not in row for i, row in enumerate(links))
    hit = sum(len({x for _, x in graph.search(unit[i], V.BEAM)[:6]} & set(np.argsort(-(unit @ unit[i]))[:6].tolist())) for i in range(0, 1500, 30))
    assert hit / 300 >= 0.97
