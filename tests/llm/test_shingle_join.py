"""The similarity join against all pairs, on hot buckets and odd rows too."""

import re

import numpy as np
import pytest

from cladescope.llm import shingle_join as S

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def shingles(text):
    words = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if len(words) < 5:
        return {tuple(words)} if words else set()
    return {tuple(words[i : i + 5]) for i in range(len(words) - 4)}


def by_all_pairs(rows):
    sets = [shingles(t) for _, t in rows]
    top = list(range(len(rows)))

    def find(i):
        while top[i] != i:
            i = top[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and 100 * both >= 80 * len(sets[i] | sets[j]):
                top[find(i)] = find(j)
    least = {}
    for i, (doc_id, _) in enumerate(rows):
        if doc_id is not None:
            least[find(i)] = min(least.get(find(i), doc_id), doc_id)
    return sorted(((d, len(sets[i]), least.get(find(i))) for i, (d, _) in enumerate(rows)), key=repr)


def corpus():
    rng = np.random.default_rng(3)
    words = [f"w{i}" for i in range(400)]
    base = [words[i] for i in rng.integers(0, 400, 120)]
    passage = " ".join(words[i] for i in rng.integers(0, 400, 60))
    rows = []
    for _ in range(160):  # a large group of near copies, some of them drifting away
        own = list(base)
        for k in rng.integers(0, 120, rng.integers(0, 6)):
            own[k] = words[rng.integers(0, 400)]
        rows.append(" ".join(own))
    for n in rng.integers(5, 90, 60):  # one common passage in texts of their own
        rows.append(" ".join(words[i] for i in rng.integers(0, 400, n)) + " " + passage)
    chain = [words[i] for i in rng.integers(0, 400, 300)]
    rows += [" ".join(chain[k : k + 150]) for k in range(0, 60, 3)]  # each like the next only
    rows += ["short text", "SHORT  text\n", "short text!", "a b c d e", "A b c d E f", " ", "", None, None, "é É", "é É", "x " * 3000, "x " * 9]
    rows += [rows[0]] * 40
    ids = rng.permutation(len(rows)).tolist()
    ids[5] = ids[6] = ids[-1] = None
    return list(zip(ids, rows))


def test_equals_all_pairs(spark):
    rows = corpus()
    docs = spark.createDataFrame([(i, t, "a", 7) for i, t in rows], "doc_id long, text string, n string, cls int")
    got = sorted(((r.doc_id, r.n_shingles, r.component_id) for r in S.similar_groups(docs).collect()), key=repr)
    assert got == by_all_pairs(rows)
    assert S.similar_groups(docs.limit(0)).count() == 0


def test_keep_one(spark):
    rows = corpus()
    docs = spark.createDataFrame([(i, t, 7) for i, t in rows], "doc_id long, text string, grp int")
    kept = S.keep_one(docs)
    assert kept.columns == docs.columns
    sets = {(d, t) for d, t in rows if not shingles(t)}
    got = kept.collect()
    full = [r for r in got if shingles(r.text)]
    want = {c for d, n, c in by_all_pairs(rows) if n}
    assert len(full) == len(want) and {r.doc_id for r in full} == want
    assert len(got) - len(full) == sum(1 for d, t in rows if (d, t) in sets)


@pytest.mark.parametrize("size", [1, 2, 7, 400])
def test_bucket_stream(size):
    rng = np.random.default_rng(size)
    rows = np.stack([np.sort(rng.integers(0, 200, 400)), rng.integers(0, 60, 400), rng.integers(20, 30, 400), rng.integers(0, 5, 400)], 1)
    rows[:, 2] = 20 + rows[:, 1] % 7
    rows = rows[np.lexsort((rows[:, 1], rows[:, 2], rows[:, 0]))]
    stream, got = S.BucketStream(), []
    for i in range(0, len(rows), size):
        got += map(tuple, stream.take(rows[i : i + size])[:, :2].tolist())
    keys = sorted({tuple(x) for x in rows[:, :2].tolist()})
    assert sorted(got) == [k for k in keys if sum(x[0] == k[0] for x in keys) > 1]


def test_filters_lose_nothing():
    rng = np.random.default_rng(9)
    for _ in range(200):
        a = np.unique(rng.integers(0, 1 << 47, rng.integers(1, 60)).astype(np.uint64) << np.uint64(1))
        b = np.unique(np.concatenate([a[rng.random(len(a)) > 0.1], rng.integers(0, 1 << 48, 3).astype(np.uint64)]))
        both = len(np.intersect1d(a, b))
        if 100 * both < 80 * (len(a) + len(b) - both):
            continue
        frequent = np.sort(rng.choice(a, min(len(a), 5), replace=False))
        p, q = (S.prefix(x, frequent, np.arange(10, 10 + len(frequent))) for x in (a, b))
        common = np.intersect1d(p, q)
        assert len(common)
        for x in common:
            i, j = int(np.flatnonzero(p == x)[0]), int(np.flatnonzero(q == x)[0])
            assert S.may_reach(*map(np.int64, (len(a), i, len(np.intersect1d(p[:i], q)), len(b), j, len(np.intersect1d(q[:j], p)))))
        apart = sum(int(x ^ y).bit_count() if x ^ y >= 0 else (int(x ^ y) & (1 << 64) - 1).bit_count() for x, y in zip(S._parities(a, S.RANGES), S._parities(b, S.RANGES)))
        assert 180 * apart <= 20 * (len(a) + len(b))


def test_buckets_and_sets_move_seldom(spark, monkeypatch):
    """Sets are found without a shuffle, the pivots of all rounds with the buckets' one and that of the pairs."""
    moved, write = [], S.materialize

    def counted(df, label):
        moved.append((label, str(df._jdf.queryExecution().executedPlan().toString()).count("Exchange hashpartitioning")))
        return write(df, label)

    monkeypatch.setattr(S, "materialize", counted)
    rows = corpus()
    got = S.similar_groups(spark.createDataFrame(rows, "doc_id long, text string"))
    assert {r.doc_id for r in got.collect()} == {r[0] for r in rows}
    assert [n for label, n in moved if label == "paired"] and not any(n for label, n in moved if label == "paired")
    assert [n for label, n in moved if label == "pivots"] == [2] and [n for label, n in moved if label == "others"][0] <= 3
