"""Held-out accuracy, mixtures against plain EM, odd rows."""

import numpy as np

from cladescope.llm import language_mixture as M
from cladescope.llm.common import held_out

TEN = "/root/testdata/sf0.01"


def test_held_out_accuracy(spark):
    docs = spark.read.parquet(f"{TEN}/documents.parquet")
    model = M.learn(docs)
    assert model.labels == ("de", "en", "es", "fr")
    rows = M.predict(docs, model).join(docs.select("doc_id", "lang"), "doc_id").where("held_out").toPandas()
    assert len(rows) > 200 and (rows["lang_pred"] == rows["lang"]).mean() > 0.98
    assert rows["score"].between(0, 1).all()
    assert docs.where(held_out(docs.doc_id)).count() == len(rows)


def plain_em(p, rounds=3000):
    share = np.full(p.shape[1], 1 / p.shape[1])
    for _ in range(rounds):
        r = p * share
        share = (r / r.sum(1, keepdims=True)).mean(0)
    return share


def test_mixture_equals_plain_em():
    rng = np.random.default_rng(0)
    p = np.full((M.GRAMS, 3), 1e-6, np.float32)
    ids = [M.gram_ids([t])[0] for t in ("aaa bab aab " * 40, "ccd dcc cdc " * 40, "eef fee efe " * 40)]
    for k, x in enumerate(ids):
        p[np.unique(x), k] = 0.1
        p[np.unique(x), (k + 1) % 3] += 0.02 * rng.random(len(np.unique(x)))
    model = M.LanguageModel(("a", "c", "e"), p)
    for text in ("aab bab " * 300, "aab bab ccd " * 300, "aab ccd efe " * 200):
        (share, n), grams = model.mixtures([text])[0], M.gram_ids([text])[0]
        want = plain_em(p[grams].astype(float))
        assert n == len(grams) and np.abs(share - np.where(want < 0.01, 0, want)).max() < 0.02


def test_slices_do_not_matter():
    texts = ["Ünter den", "", "x", "été là", "A1b!c", "日本 語"]
    ids, edges = M.gram_ids(texts)
    for i, t in enumerate(texts):
        alone, _ = M.gram_ids([t])
        assert ids[edges[i] : edges[i + 1]].tolist() == alone.tolist()


def test_odd_rows(spark):
    rows = [(1, None, None), (2, "", "en"), (3, "123 !?", "en"), (4, "the thing and the other " * 9, "en"), (4, "the thing and the other " * 9, "en"), (None, "der und die " * 9, "de"), (6, "der und die " * 9, "de"), (8, "²", None), (9, "x " * 200_000, None)]
    docs = spark.createDataFrame([(*r, 0.5) for r in rows], "doc_id long, text string, lang string, score double")
    got = M.predict(docs, M.learn(docs)).collect()
    by = {}
    for r in got:
        by.setdefault(r.doc_id, []).append((r.lang_pred, r.held_out))
    assert len(got) == len(rows) and by[1][0][0] == by[2][0][0] == by[3][0][0] == by[8][0][0] == "und"
    assert [x for x, _ in by[4]] == ["en", "en"] and by[None] == [("de", False)]
    assert all(0 <= r.score <= 1 for r in got)
    none = M.learn(docs.where("doc_id < 0"))
    assert {r.lang_pred for r in M.predict(docs, none).collect()} == {"und"}
    assert M.predict(docs.limit(0), none).count() == 0
