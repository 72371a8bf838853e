"""Base statistics by definition, estimates against numpy, planted outliers, odd rows."""

import re

import numpy as np
import pytest

from cladescope.llm import quality_outliers as Q

WORD = re.compile(r"[^\x20\x09-\x0D]+")
ODD = [None, "", " \n\t", "one", "a b c a b c", "a b c\na b c\n\n a b c", "x x x x x", "# * $ %&|<> word#", "é 日本 🙂\né 日本 🙂", "w " * 50_000, "a b\n" * 30, "\x1c\x85 nel"]


def by_definition(text):
    text = text or ""
    words, seen = WORD.findall(text), {}
    for i in range(len(words) - 2):
        seen.setdefault(tuple(words[i : i + 3]), []).append(i)
    repeat = {j for v in seen.values() if len(v) > 1 for i in v for j in (i, i + 1, i + 2)}
    lines = [x for x in text.split("\n") if WORD.search(x)]
    return [len(words), sum(map(len, words)), sum(text.count(c) for c in "#*$%&|<>"), len(lines), len(lines) - len(set(lines)), len(repeat)]


def test_statistics():
    got = np.stack(Q.statistics(ODD), 1).tolist()
    assert got == [by_definition(t) for t in ODD]


def test_statistics_of_documents(spark):
    texts = [r.text for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()]
    assert np.stack(Q.statistics(texts), 1).tolist() == [by_definition(t) for t in texts]


def test_chi_square():
    for p, d, want in ((0.5, 2, 1.3862943611), (0.95, 5, 11.0704976935), (0.99, 1, 6.6348966010)):
        assert Q.chi_square_quantile(p, d) == pytest.approx(want, rel=1e-8)
    x = np.random.default_rng(0).normal(size=(200_000, 5))
    near = x[(x * x).sum(1) <= Q.chi_square_quantile(0.75, 5)]
    assert np.cov(near.T)[0, 0] * Q.consistency(0.75, 5) == pytest.approx(1, abs=0.02)


def prose(rng, n, symbols=0.0):
    words = ["".join(rng.choice(list("etaoinshr"), rng.integers(2, 9))) for _ in range(n)]
    return " ".join(w + ("###" if rng.random() < symbols else "") for w in words)


def test_planted_outliers(spark):
    rng = np.random.default_rng(5)
    rows = [(i, prose(rng, int(rng.integers(60, 400))), "en", "a") for i in range(600)]
    rows += [(1000 + i, prose(rng, 200, 0.9), "en", "a") for i in range(60)]  # symbols on most words
    rows += [(2000 + i, prose(rng, 120), None, None) for i in range(5)]  # a small group of nulls
    rows += [(3000, None, "en", "a"), (3001, "", None, "b"), (None, prose(rng, 90), "en", "a")]
    docs = spark.createDataFrame([(*r, 1, 2.0) for r in rows], "doc_id long, text string, lang string, source string, grp int, distance double")
    got = {r.doc_id: r for r in Q.assess(docs).collect()}
    assert len(got) == len(rows)
    assert all(got[i].kept for i in [*range(600), *range(2000, 2005), None])
    assert not any(got[i].kept or got[i].base_failed for i in range(1000, 1060))
    assert got[3000].base_failed and not got[3000].kept and got[3001].n_words == 0


def naive(rows):
    """Distances by per-group minimum covariance determinants in numpy, from rows (lang, source, vector)."""
    d = len(Q.DIMENSIONS)
    factor, floor = Q.consistency(Q.HALF, d), np.diag([f * f for f in Q.FLOORS.values()])

    def mcd(x):
        best = None
        median = np.median(x, 0)
        starts = [(median, np.diag((1.4826 * np.median(abs(x - median), 0)) ** 2)), (x.mean(0), np.cov(x.T, bias=True))]
        for m, s in starts:
            det = np.inf
            for _ in range(Q.STEPS):
                gap = x - m
                d2 = np.einsum("ij,jk,ik->i", gap, np.linalg.inv(s + floor), gap)
                klass = np.floor(Q.CLASSES * np.log2(d2 + 1e-6))
                order = np.sort(klass)
                near = x[klass <= order[int(np.ceil(Q.HALF * len(x))) - 1]]
                m_new, s_new = near.mean(0), factor * np.cov(near.T, bias=True)
                det_new = np.linalg.slogdet(s_new + floor)[1]
                if not det_new < det - 1e-9:
                    break
                m, s, det = m_new, s_new, det_new
            if best is None or det < best[0]:
                best = (det, m, s)
        return len(x), *best[1:]

    def drawn(own, m, s):
        n, a, b = own
        return (n * a + Q.SHRINK * m) / (n + Q.SHRINK), (n * b + Q.SHRINK * s) / (n + Q.SHRINK)

    x = np.array([r[2] for r in rows])
    _, *top = mcd(x)
    out = np.zeros(len(rows))
    for lang in {r[0] for r in rows}:
        mine = [i for i, r in enumerate(rows) if r[0] == lang]
        upper = drawn(mcd(x[mine]), *top)
        for source in {rows[i][1] for i in mine}:
            group = [i for i in mine if rows[i][1] == source]
            m, s = drawn(mcd(x[group]), *upper)
            gap = x[group] - m
            out[group] = np.einsum("ij,jk,ik->i", gap, np.linalg.inv(s + floor), gap)
    return out


def test_verdicts_equal_naive_estimates(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    passed = Q.text_statistics(docs).where("not base_failed").collect()
    want = naive([(r.lang, r.source, [r[x] / Q.SCALE for x in Q.DIMENSIONS]) for r in passed])
    got = {r.doc_id: r for r in Q.assess(docs.repartition(7)).collect()}
    cut = Q.chi_square_quantile(1 - Q.TAIL, len(Q.DIMENSIONS))
    for r, d2 in zip(passed, want):
        assert got[r.doc_id].distance == pytest.approx(d2, rel=1e-6) and got[r.doc_id].kept == (d2 <= cut)
    assert 0.02 < (want > cut).mean() < 0.15
    # the scatter is the rows' own: floors are well below it where there is any
    spread = np.array([[r[x] / Q.SCALE for x in Q.DIMENSIONS] for r in passed]).std(0)
    assert Q.FLOORS["x_length"] < spread[0] / 5 and Q.FLOORS["x_word"] < spread[1] / 2


def test_each_dimension_rejects(spark):
    rng = np.random.default_rng(8)
    rows = [(i, "\n".join(prose(rng, int(n)) for n in rng.integers(20, 60, rng.integers(3, 9))), "en", "a") for i in range(500)]
    line = prose(rng, 12)
    odd = {
        "length": prose(rng, 60_000),
        "word": " ".join("x" * int(k) for k in rng.integers(60, 90, 200)),
        "symbol": prose(rng, 200, 0.5),
        "dup": "\n".join([prose(rng, 60), *(f"w{k}" for k in rng.integers(0, 20, 300))]),
        # half of the words may repeat by the base rule: such a text goes for its lines as well
        "repeat": "\n".join([line] * 5 + [prose(rng, 10) for _ in range(6)]),
    }
    rows += [(1000 + i, t, "en", "a") for i, t in enumerate(odd.values())]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    got = {r.doc_id: r for r in Q.assess(docs).collect()}
    assert sum(got[i].kept for i in range(500)) == 500
    for i, name in enumerate(odd):
        assert not got[1000 + i].kept and not got[1000 + i].base_failed, name


def test_groups_that_are_not_broadcast(spark, monkeypatch):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    first = sorted(Q.assess(docs).collect(), key=str)
    monkeypatch.setattr(Q, "FEW", 0)
    assert sorted(Q.assess(docs.repartition(5)).collect(), key=str) == first


def test_labelled_quality(spark):
    d = "/root/testdata/sf0.1"
    labels = spark.read.parquet(f"{d}/labels.parquet")
    rows = Q.assess(spark.read.parquet(f"{d}/documents.parquet")).join(labels, "doc_id").where("not base_failed").toPandas()
    assert (rows["kept"][rows["quality"] == 1]).mean() > 0.999 and (rows["kept"][rows["quality"] == 0]).mean() < 0.02


def test_empty(spark):
    docs = spark.createDataFrame([], "doc_id long, text string, lang string, source string")
    assert Q.assess(docs).count() == 0
    one = spark.createDataFrame([(1, "few words", None, None)], "doc_id long, text string, lang string, source string")
    assert [(r.base_failed, r.kept) for r in Q.assess(one).collect()] == [(True, False)]
