"""Every stage on its own input: columns kept, decisions in effect, clean documents kept."""

import hashlib
import importlib.util

import pytest

if importlib.util.find_spec("corpus_pipeline") is None:
    pytest.skip("corpus_pipeline is optional", allow_module_level=True)

import corpus_pipeline as P
from cladescope.llm import shingle_join, source_mixing, toxic_segments
from cladescope.llm.queries import tokenizer_path

D = "/root/testdata/sf0.01"


def test_stages(spark, tmp_path):
    first = docs = spark.read.parquet(f"{D}/documents.parquet")
    seen = {}
    for name, stage in P.STAGES:
        stage(spark, docs, D).write.parquet(str(tmp_path / name))
        seen[name] = (docs, spark.read.parquet(str(tmp_path / name)))
        docs = seen[name][1]
        if name != P.STAGES[-1][0]:
            assert docs.columns == first.columns
    into, out = seen["toxicity"]
    scored = toxic_segments.score(into, toxic_segments.learn(into, spark.read.parquet(f"{D}/labels.parquet")))
    assert sorted(r.doc_id for r in out.collect()) == sorted(r.doc_id for r in scored.where("predicted = 0").collect())
    into, out = seen["ngram_jaccard_join"]
    groups = shingle_join.similar_groups(into).collect()
    assert sorted(r.doc_id for r in out.collect()) == sorted({r.component_id for r in groups})
    into, out = seen["secret_scans"]
    before, after = ({r.doc_id: r.text for r in x.collect()} for x in (into, out))
    assert set(before) == set(after) and any(before[k] != after[k] for k in before)
    assert all("[SECRET]" in after[k] for k in before if before[k] != after[k])
    into, out = seen["source_mixing"]
    plan = {r.doc_id: r.copies for r in source_mixing.mixing_plan(into).collect()}
    assert sorted(r.doc_id for r in out.collect()) == sorted(k for k, n in plan.items() for _ in range(n))
    import sentencepiece

    into, out = seen["piece_encoding"]
    model = sentencepiece.SentencePieceProcessor(model_file=tokenizer_path("piece_bpe_32k.model"))
    want = sorted((r.doc_id, hashlib.sha256(",".join(map(str, model.encode(r.text))).encode()).hexdigest()) for r in into.collect())
    assert sorted((r.doc_id, r.ids_sha256) for r in out.collect()) == want
    assert P.run(spark, D).count() == len(want)


def test_stages_on_odd_rows(spark, tmp_path):
    text = "these are plain words of a clean text that nobody would remove from a corpus at all"
    rows = [(1, None, None, None, None), (2, "", "en", "a", 0), (3, " ", "en", "a", 1), (4, text, "en", "a", 80), (4, text, "en", "a", 80), (None, text + " more", None, "b", None), (6, "word " * 100_000, "de", None, 5), (7, "token=q7w8e9r1t2y3u4i5o6p0", "en", "b", 1)]
    docs = spark.createDataFrame([(*r, "x", 1, 2.0) for r in rows], "doc_id long, text string, lang string, source string, n_chars long, doc string, `predicted x` int, score double")
    for name, stage in P.STAGES:
        stage(spark, docs, D).write.parquet(str(tmp_path / name))
        out = spark.read.parquet(str(tmp_path / name))
        if name != P.STAGES[-1][0]:
            assert out.columns == docs.columns and out.dtypes == docs.dtypes, name
        got = out.collect()
        if name in ("toxicity", "secret_scans", "piece_encoding"):
            assert len(got) == len(rows), name
        if name == "ngram_jaccard_join":  # the two equal rows and the nearly equal one are a group
            assert sorted((r.doc_id or 0) for r in got) == [1, 2, 3, 4, 6, 7]
        assert stage(spark, docs.limit(0), D).count() == 0, name


def test_written_tables_do_not_copy_long_values(spark):
    """Texts and packed sets have no dictionary, columns no least and largest values; other columns keep their dictionary."""
    import pyarrow.parquet as pq

    from cladescope.llm.common import discard, materialize

    docs = spark.createDataFrame([(k, f"text {k % 3}", "a", bytearray(b"x" * 50)) for k in range(40)], "doc_id long, text string, source string, packed binary")
    table = materialize(docs.coalesce(1), "long")
    assert table.exceptAll(docs).isEmpty() and docs.exceptAll(table).isEmpty()
    part = next(f for f in table.inputFiles())
    group = pq.ParquetFile(part.removeprefix("file://")).metadata.row_group(0)
    columns = {group.column(k).path_in_schema: group.column(k) for k in range(group.num_columns)}
    assert {k: c.has_dictionary_page for k, c in columns.items() if k != "doc_id"} == {"text": False, "source": True, "packed": False}
    assert not any(c.is_stats_set and c.statistics.has_min_max for c in columns.values())
    discard(table)
