"""Targets by plain resharing, copies against rates, odd rows."""

import pytest

from cladescope.llm import source_mixing as X


def by_resharing(sizes, weights=(5, 2, 1), most=3.0):
    names = sorted((s for s in sizes if s is not None)) + ([None] if None in sizes else [])
    w = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    total, stopped = sum(sizes.values()), {}
    while True:
        open_ = [s for s in names if s not in stopped]
        left = total - sum(stopped.values())
        share = {s: left * w[s] / sum(w[x] for x in open_) for s in open_} if open_ else {}
        over = [s for s in open_ if share[s] > most * sizes[s]]
        if not over:
            return stopped | share
        stopped |= {s: most * sizes[s] for s in over}


CASES = [
    {"a": 100, "b": 100, "c": 100},
    {"a": 1, "b": 1000, "c": 10, "d": 500, None: 70},
    {"a": 0, "b": 7},
    {"é": 50, "Z": 50, "a": 5000, "b": 1, "c": 1, "d": 1},
    {None: 9},
    {"a": 0},
]


@pytest.mark.parametrize("sizes", CASES, ids=range(len(CASES)))
def test_targets(spark, sizes):
    rows = [(k * 1000 + j, "w " * (n // 5 + (j < n % 5)), s) for k, (s, n) in enumerate(sizes.items()) for j in range(5)]
    docs = spark.createDataFrame([(*r, 1.0, 2) for r in rows], "doc_id long, text string, source string, target double, size int")
    got = X.mixing_plan(docs).collect()
    want = by_resharing(sizes)
    assert len(got) == len(rows)
    for r in got:
        s = dict((i, x) for i, _, x in rows)[r.doc_id]
        assert r.target == pytest.approx(want[s]) and r.source_size == sizes[s] and r.taken <= 3 * r["size"]


def test_near_targets_and_reruns(spark):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    plan = X.mixing_plan(docs).toPandas()
    for _, part in plan.groupby("source"):
        assert part["taken"].sum() == pytest.approx(part["target"].iloc[0], rel=0.01)
        assert (part["taken"] >= (part["target"] // part["source_size"]) * part["size"]).all()
    again = X.mixing_plan(docs.repartition(7)).toPandas()
    assert again.sort_values("doc_id")["taken"].tolist() == plan.sort_values("doc_id")["taken"].tolist()


def test_emit(spark):
    rows = [(1, "a b c", "s"), (1, "a b c", "s"), (2, None, "s"), (None, "x", None), (3, "y " * 40, "t")]
    docs = spark.createDataFrame([(*r, 9, "z") for r in rows], "doc_id long, text string, source string, copies int, rate string")
    plan = X.mixing_plan(docs).collect()
    out = X.emit(docs)
    assert out.columns == docs.columns
    got = sorted((r.doc_id or 0, r.text or "") for r in out.collect())
    want = sorted(x for r in plan for x in [(r.doc_id or 0, next(t or "" for i, t, _ in rows if i == r.doc_id))] * r.copies)
    assert got == want
    assert X.emit(docs.limit(0)).count() == 0 and X.mixing_plan(docs.limit(0)).count() == 0


def test_no_text_moves_by_its_source(spark):
    plan = X.emit(spark.read.parquet("/root/testdata/sf0.001/documents.parquet"))._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "Exchange hashpartitioning" not in plan


def test_many_sources(spark, monkeypatch):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    first = sorted(X.mixing_plan(docs).collect(), key=str)
    mixed = sorted(X.emit(docs).collect(), key=str)
    monkeypatch.setattr(X, "FEW", 0)
    assert sorted(X.mixing_plan(docs).collect(), key=str) == first
    assert sorted(X.emit(docs).collect(), key=str) == mixed
