"""Maximal segments against their definition; the learned score on planted words and held-out rows."""

import itertools

import numpy as np
import pytest

from cladescope.llm import toxic_segments as T


def by_definition(values):
    """Split recursively at the maximal segment (shortest, leftmost of equals)."""
    n = len(values)
    best = max(((sum(values[a:b]), -(b - a), -a) for a, b in itertools.combinations(range(n + 1), 2)), default=(0, 0, 0))
    if best[0] <= 0:
        return []
    a, b = -best[2], -best[2] - best[1]
    return [*by_definition(values[:a]), (a, b, best[0]), *[(a2 + b, b2 + b, s) for a2, b2, s in by_definition(values[b:])]]


def test_segments():
    rng = np.random.default_rng(1)
    for _ in range(300):
        values = (rng.normal(-0.2, 1, rng.integers(0, 14))).round(3)
        got = T.maximal_segments(values)
        want = by_definition(values.tolist())
        assert [x[:2] for x in got] == [x[:2] for x in want]
        assert np.allclose([x[2] for x in got], [x[2] for x in want])


def test_backoff_and_contradiction():
    rows = [
        {"word": "vile ", "t": 40, "c": 0, "t_tokens": 60, "c_tokens": 0},
        {"word": "vile", "t": 40, "c": 0, "t_tokens": 60, "c_tokens": 0},
        {"word": "viler", "t": 2, "c": 0, "t_tokens": 2, "c_tokens": 0},
        {"word": "loser ", "t": 40, "c": 0, "t_tokens": 60, "c_tokens": 0},
        {"word": "lose", "t": 42, "c": 80, "t_tokens": 62, "c_tokens": 90},
    ]
    lexicon = T.choose(rows, 100, 1000, 10_000, 100_000)
    assert set(lexicon) == {"vile ", "vile", "loser "}
    model = T.ToxicityModel(lexicon, 0.1)
    assert model.scores["viles"] > 0 and model.scores["loses"] < 0 and model.scores["loser"] > 0


@pytest.fixture(scope="module")
def learned(spark):
    d = "/root/testdata/sf0.1"
    docs, labels = spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/labels.parquet")
    return docs, labels, T.learn(docs, labels)


def test_held_out_accuracy(learned):
    docs, labels, model = learned
    rows = T.score(docs, model).join(labels, "doc_id").where("held_out").toPandas()
    hit = (rows["predicted"] == 1) & (rows["toxic"] == 1)
    assert hit.sum() / (rows["toxic"] == 1).sum() > 0.8
    assert hit.sum() / (rows["predicted"] == 1).sum() > 0.9
    assert rows["score"].between(0, 1).all() and ((rows["score"] >= 0.3) == (rows["predicted"] == 1)).all()


def test_edges(spark, learned):
    *_, model = learned
    odd = spark.createDataFrame([(None, None, 1.0), (1, "", 2.0), (2, "idiot", 3.0), (2, "idiot", 3.0), (3, "word " * 200_000, 4.0)], "doc_id long, text string, score double")
    got = sorted((r.doc_id or 0, r.predicted, r.n_passages) for r in T.score(odd, model).collect())
    assert got == [(0, 0, 0), (1, 0, 0), (2, 1, 1), (2, 1, 1), (3, 0, 0)]
    assert T.score(odd.limit(0), model).count() == 0
    none = T.learn(odd.select("doc_id", "text"), spark.createDataFrame([], "doc_id long, quality int, toxic int"))
    assert [r.score for r in T.score(odd, none).collect()] == [0.0] * 5


def test_filter_keeps_columns(spark, learned):
    docs, labels, _ = learned
    some = docs.selectExpr("*", "'x' as score", "1 as predicted")
    kept = T.reject_toxic(some, labels)
    assert kept.columns == some.columns and 0.8 < kept.count() / docs.count() < 0.97


def test_scores_do_not_hang_on_the_order_of_rows(spark):
    d = "/root/testdata/sf0.01"
    docs, labels = (spark.read.parquet(f"{d}/{t}.parquet") for t in ("documents", "labels"))
    first = {r.doc_id: r.score for r in T.score(docs, T.learn(docs, labels)).collect()}
    turned = docs.repartition(7).sortWithinPartitions("text")
    again = {r.doc_id: r.score for r in T.score(docs, T.learn(turned, labels.repartition(3))).collect()}
    assert max(abs(first[i] - again[i]) for i in first) < 1e-9
