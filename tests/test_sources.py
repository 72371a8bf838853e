"""Round trips of every format, and readers on hand-written files."""

import pandas as pd
import pytest

from cladescope.sources import genbank, scores, text

RECORD = """LOCUS       CTG{n}  60 bp DNA
VERSION     CTG{n}.1
FEATURES             Location/Qualifiers
     source          1..60
                     /organism="x"
     gene            1..9
                     /locus_tag="t{n}"
     CDS             1..9
                     /gene="abc"
                     /locus_tag="t{n}"
                     /product="long
                     name"
                     /protein_id="P{n}"
                     /translation="MK"
     CDS             complement(join(10..12,16..21))
                     /product="other"
                     /translation="M
                     A"
     CDS             30..40
                     /product="pseudo"
ORIGIN
        1 atgaaataat tacatcatgc ataaaaaaaa aaaaaaaaaa aaaaaaaaaa aaaaaaaaaa
//
"""


def test_genbank(spark, tmp_path):
    (tmp_path / "a.gbff").write_text(RECORD.format(n=1) + RECORD.format(n=2))
    (tmp_path / "b.gbff").write_text(RECORD.format(n=3).replace("/translation", "/note"))
    genes = genbank.read_genbank(spark, str(tmp_path), dna=True)
    rows = genes.orderBy("file", "record", "feature").collect()
    assert [(r.chrom, r.start, r.end, r.strand, r.descrip, r.protein) for r in rows[:2]] == [("CTG1.1", 0, 9, "+", "abc - long name", "MK"), ("CTG1.1", 9, 21, "-", "other", "MA")]
    assert rows[0].dna == "atgaaataa" and len(rows[1].dna) == 9
    bad = genbank.problems(spark, str(tmp_path), genes, dna=True)
    assert [r.file.split("/")[-1] for r in bad.collect()] == ["b.gbff"]
    with pytest.raises(ValueError, match="b.gbff"):
        genbank.require_sound(bad)
    names = spark.createDataFrame([(rows[0].file, "A", 0)], "file string, strain string, ord int")
    found = genbank.catalogue(genes, names)
    assert [(r.gene, r.name) for r in found.orderBy("gene").collect()] == [(0, "0_A-t1"), (1, "1_A-9_21"), (2, "2_A-t2"), (3, "3_A-9_21")]
    order = genbank.gene_order(found)
    assert sorted((r.contig, r.pos, r.gene) for r in order.collect()) == [(0, 0, 0), (0, 1, 1), (1, 0, 2), (1, 1, 3)]


def test_text_formats(spark, tmp_path):
    at = lambda name: str(tmp_path / name)
    (tmp_path / "x.fa").write_text(">1_A-t one\nMK\nLL\n>2_A-u\n M V \n")
    assert [(r.header, r.sequence) for r in text.read_fasta(spark, at("x.fa")).orderBy("header").collect()] == [("1_A-t one", "MKLL"), ("2_A-u", "MV")]
    text.write_fasta(spark.createDataFrame([("h", "MK")], "header string, sequence string"), at("fa"))
    assert text.read_fasta(spark, at("fa")).select("header", "sequence").collect() == [("h", "MK")]
    (tmp_path / "A_-VS-_B.out").write_text("1_A-t 9_B-u 1e-30 100 1 90 110 2 91 55.5 200\n2_A-x other 1e-3 10 1 9 11 2 9 5 20\n")
    rows = text.read_hits(spark, at("A_-VS-_B.out")).orderBy("line_no").collect()
    assert (rows[0].strain_q, rows[0].strain_s, rows[0].q, rows[0].s, rows[0].pident, rows[0].score, rows[1].s) == ("A", "B", 1, 9, 55.5, 200, None)
    (tmp_path / "info").write_text("# A\n0\tn0\tc\tt\tp\td\tch\t5\t9\t+\n# B\n1\tn1\tc\tt\tp\td\tch\t6\t9\t-\n")
    assert [(r.gene, r.strain, r.start) for r in text.read_gene_info(spark, at("info")).orderBy("gene").collect()] == [(0, "A", 5), (1, "B", 6)]
    assert text.read_gene_info(spark, at("info"), ["B"]).count() == 1
    order = spark.createDataFrame([("A", 0, 0, 7), ("A", 0, 1, 3), ("A", 1, 0, 9), ("B", 0, 0, 4)], "strain string, contig int, pos int, gene long")
    text.write_gene_order(order, at("order"))
    assert sorted(text.read_gene_order(spark, at("order")).collect()) == sorted(order.collect())
    islands = spark.createDataFrame([(1, "s2", [4, 5]), (2, "s1", [6])], "id long, mrca string, lfs array<long>")
    text.write_islands(islands, at("islands"))
    assert sorted(text.read_islands(spark, at("islands")).collect()) == sorted(islands.collect())
    sets = spark.createDataFrame([(0, [1, 2, 3])], "grp int, genes array<long>")
    text.write_orthologs(sets, at("sets"))
    assert text.read_orthologs(spark, at("sets")).collect() == sets.collect()
    fam = spark.createDataFrame([(1, "s2", "(a,b);", None), (2, "s1", "c;", 1)], "fam long, mrca string, tree string, source_fam long")
    lf = spark.createDataFrame([(5, 1, "s2", 3, "g0", [7, 8]), (6, 1, "s2", None, "g1", [9])], "lf long, fam long, lf_mrca string, locus long, root_node string, genes array<long>")
    text.write_families(fam, lf, at("fams"))
    got_fam, got_lf = text.read_families(spark, at("fams"))
    assert sorted(got_fam.collect(), key=str) == sorted(fam.collect(), key=str) and sorted(got_lf.collect(), key=str) == sorted(lf.collect(), key=str)
    (tmp_path / "map").write_text("f1 A\n  skipped x\nf2\tB\n")
    assert sorted(text.read_name_map(spark, at("map")).collect()) == [("f1", "A"), ("f2", "B")]
    (tmp_path / "fam000012.tre").write_text("(a,b);\n")
    assert text.read_gene_trees(spark, at("fam000012.tre")).collect() == [(12, "(a,b);")]


def test_score_files(spark, tmp_path):
    rows = pd.DataFrame({"s1": [0, 0, 1], "s2": [0, 1, 1], "g1": [1, 1, 5], "g2": [2, 7, 6], "raw_sc": [0.5, 0.25, 1.0], "syn_sc": [0.0, 0.1, 0.2], "core_syn_sc": [1.0, 0.0, 0.5]})
    blob = scores.encode(rows)
    assert len(blob) == 16 + 32 * 3 + 48 * 3 and scores.decode(blob).equals(rows)
    (tmp_path / "s.bout").write_bytes(blob)
    got = scores.read_binary(spark, str(tmp_path / "s.bout")).toPandas().sort_values(["s1", "s2"]).reset_index(drop=True)
    assert got.equals(rows)
    frame = spark.createDataFrame(rows)
    scores.write_text(frame, str(tmp_path / "t"))
    assert scores.read_text(spark, str(tmp_path / "t")).toPandas().sort_values(["s1", "s2"]).reset_index(drop=True).equals(rows)
    assert [(r.first, r.after) for r in scores.edge_ranges(frame).orderBy("s1", "s2").collect()] == [(0, 1), (1, 2), (2, 3)]
    import numpy as np

    for top in (5, 70_000):
        values = np.array([0, -1, top])
        assert scores.decode_map(scores.encode_map(values)).tolist() == values.tolist()


def test_binary_scores_of_a_large_pair(spark, tmp_path):
    """All edges of one strain pair are many files, read again in parts."""
    edges = spark.range(45_000).selectExpr("1L as s1", "if(id % 9000 = 0, 3L, 2L) as s2", "id as g1", "id * 7 as g2", "id / 8 as raw_sc", "0.5D as syn_sc", "if(id % 3 = 0, null, 0.25D) as core_syn_sc")
    scores.write_binary(edges, str(tmp_path / "s"))
    assert spark.read.parquet(str(tmp_path / "s")).selectExpr("max(length(content))").first()[0] <= 16 + 32 * 2 + 48 * scores.PART
    got = scores.read_binary(spark, str(tmp_path / "s")).selectExpr("s1", "s2", "g1", "g2", "raw_sc", "syn_sc", "if(isnan(core_syn_sc), null, core_syn_sc) as core_syn_sc")
    assert got.count() == 45_000 and got.exceptAll(edges).isEmpty()
    (tmp_path / "s.bout").write_bytes(scores.encode(edges.toPandas()))
    got = scores.read_binary(spark, str(tmp_path / "s.bout")).selectExpr("s1", "s2", "g1", "g2", "raw_sc", "syn_sc", "if(isnan(core_syn_sc), null, core_syn_sc) as core_syn_sc")
    assert got.count() == 45_000 and got.exceptAll(edges).isEmpty()


def test_binary_scores_have_few_files(spark, tmp_path, monkeypatch):
    """Many forms make few files, of small row groups; a batch for Python is bounded."""
    import pyarrow.parquet as pq

    monkeypatch.setattr(scores, "PART", 100)
    edges = spark.range(40_000).selectExpr("1L as s1", "2L as s2", "id as g1", "id * 7 as g2", "id / 8 as raw_sc", "0.5D as syn_sc", "if(id % 3 = 0, null, 0.25D) as core_syn_sc")
    scores.write_binary(edges, str(tmp_path / "s"))
    files = list((tmp_path / "s").glob("*.parquet"))
    groups = [g.row_group(k).num_rows for g in (pq.ParquetFile(f).metadata for f in files) for k in range(g.num_row_groups)]
    assert len(files) <= 16 and sum(groups) >= 400 and max(groups) <= 8
    got = scores.read_binary(spark, str(tmp_path / "s"))
    assert spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch") in ("4m", "4194304", "4194304b")
    assert got.count() == 40_000 and got.exceptAll(edges).isEmpty()


def test_binary_scores_are_written_in_small_parts(spark, tmp_path, monkeypatch):
    """Tasks sort a range each, and a form is a row group without a dictionary or least and largest values."""
    import pyarrow.parquet as pq

    monkeypatch.setattr(scores, "RANGE", 5_000, raising=False)
    monkeypatch.setattr(scores, "FILES", 10)
    spark.range(40_000).selectExpr("1L as s1", "2L as s2", "id as g1", "id * 7 as g2", "id / 8 as raw_sc", "0.5D as syn_sc", "if(id % 3 = 0, null, 0.25D) as core_syn_sc").coalesce(1).write.option("parquet.block.row.count.limit", 1000).parquet(str(tmp_path / "e"))
    edges = spark.read.parquet(str(tmp_path / "e"))
    name = "spark.sql.files.maxPartitionBytes"
    value = spark.conf.get(name)
    scores.write_binary(edges, str(tmp_path / "s"))
    assert spark.conf.get(name) == value
    files = [pq.ParquetFile(f).metadata for f in (tmp_path / "s").glob("*.parquet")]
    columns = [m.row_group(k).column(0) for m in files for k in range(m.num_row_groups)]
    assert len(files) == 8 and {m.row_group(k).num_rows for m in files for k in range(m.num_row_groups)} == {1}
    assert not any(c.has_dictionary_page or c.is_stats_set and c.statistics.has_min_max for c in columns)
    got = scores.read_binary(spark, str(tmp_path / "s"))
    assert got.count() == 40_000 and got.exceptAll(edges).isEmpty()
    scores.write_binary(edges.limit(0), str(tmp_path / "none"))
    assert scores.read_binary(spark, str(tmp_path / "none")).count() == 0


def test_binary_scores_have_a_file_a_core(spark, tmp_path, monkeypatch):
    """However many ranges there are, executors make a file for each core and give as many parts."""
    monkeypatch.setattr(scores, "RANGE", 500)
    edges = spark.range(40_000).selectExpr("1L as s1", "2L as s2", "id as g1", "id * 7 as g2", "id / 8 as raw_sc", "0.5D as syn_sc", "if(id % 3 = 0, null, 0.25D) as core_syn_sc")
    scores.write_binary(edges, str(tmp_path / "s"))
    cores = spark.sparkContext.defaultParallelism
    assert len(list((tmp_path / "s").glob("*.parquet"))) <= cores
    got = scores.read_binary(spark, str(tmp_path / "s"))
    assert got.rdd.getNumPartitions() <= cores
    assert got.count() == 40_000 and got.exceptAll(edges).isEmpty()
