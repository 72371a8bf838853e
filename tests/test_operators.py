"""Table operators on hand-checked instances, and the driver contract."""

import glob
import os
import shutil
import subprocess
import sys
import time

import numpy as np
import pandas as pd
import pyarrow as pa
import pytest
from conftest import SMALL
from pyspark.sql import functions as F

import __spark_entry__
from cladescope import streaming
from cladescope.functions.reconcile import Costs
from cladescope.operators import families, graph, hits, islands, order, refine, reports, scores, tiles, tree
from cladescope.plans import adapters as A
from cladescope.plans import registry


def test_filter_is_strict(spark):
    base = {"strain_q": 0, "strain_s": 1, "line_no": 0, "q": 1, "s": 2, "evalue": 1e-20, "qlen": 100, "slen": 100, "qstart": 1, "sstart": 1, "pident": 50.0, "score": 9}
    rows = [{**base, "qend": e, "send": e} for e in (66, 67)] + [{**base, "qend": 90, "send": 90, "evalue": 1e-8}]
    assert [r.qend for r in hits.filter_hits(spark.createDataFrame(rows)).collect()] == [67]


def test_best_hit_ties_and_cliques(spark):
    h = spark.createDataFrame([(0, 1, 0, 1, 10, 50), (0, 1, 1, 1, 11, 50)], "strain_q int, strain_s int, line_no long, q long, s long, score int")
    assert hits.best_hits(h).select("s").collect() == [(10,)]
    pairs = [(0, 1, 1, 2), (0, 2, 1, 3), (1, 2, 2, 3)]
    both = lambda ps: spark.createDataFrame([x for a, b, p, q in ps for x in ((a, b, p, q), (b, a, q, p))], "strain_q int, strain_s int, q long, s long")
    assert sorted(hits.all_around_best(both(pairs), [0, 1, 2]).collect()) == [(1, 0, 1), (1, 1, 2), (1, 2, 3)]
    assert hits.all_around_best(both(pairs[:2]), [0, 1, 2]).count() == 0
    assert hits.all_around_best(both(pairs), [0]).count() == 0


def test_identity(spark):
    rbh = spark.createDataFrame([("A", "B", 90.0, 100.0, 80.0, 50.0)], "strain_q string, strain_s string, pident double, al_len double, pident_r double, al_len_r double")
    strains = spark.createDataFrame([("A",), ("B",), ("C",)], "strain string")
    got = {(r.strain_q, r.strain_s): round(r.aai, 3) for r in hits.identity(rbh, strains).collect()}
    assert got["A", "B"] == got["B", "A"] == 86.667 and got["A", "A"] == 100 and got["B", "C"] == 0 and len(got) == 9


def contig(spark, genes, cores=None):
    return spark.createDataFrame([("A", 0, i, g, (cores or {}).get(i)) for i, g in enumerate(genes)], "strain string, contig int, pos int, gene long, core long")


def test_ordered_neighbourhoods(spark):
    ten = contig(spark, range(10))
    near = {r.gene: r.neighbours for r in order.synteny_neighbours(ten, 8).collect()}
    assert near[0] == [1, 2, 3] and near[5] == [1, 2, 3, 4, 6, 7, 8] and near[9] == [5, 6, 7, 8]
    five = contig(spark, range(5), {0: 100, 2: 101, 3: 102})
    context = {r.gene: r.context for r in order.core_context(five, 2).collect()}
    assert context == {0: [101], 1: [101, 100], 2: [102, 100], 3: [101], 4: [102]}
    three = contig(spark, [7, 3, 9])
    assert sorted(order.proximity(three, 2).collect()) == [(3, 7, 1), (3, 9, 1), (7, 9, 2)]
    targets = spark.createDataFrame([(1,)], "gene long")
    assert sorted(r.gene for r in order.nearby(ten, targets, 2).collect()) == [0, 2, 3]
    assert order.nearby(ten, targets, 2, wrap=True).count() == 0
    assert sorted(r.gene for r in order.nearby(ten, spark.createDataFrame([(5,)], "gene long"), 2, wrap=True).collect()) == [3, 4, 6, 7]


def test_core_score_and_quantile(spark):
    c = spark.createDataFrame([(1, [1, 2, 3]), (2, [2, 3, 9]), (3, []), (4, [1])], "gene long, context array<long>")
    pairs = spark.createDataFrame([(1, 2), (3, 4), (3, 3)], "g1 long, g2 long")
    assert [round(r.core_syn_sc, 4) for r in scores.core_synteny_scores(pairs, c).orderBy("g1", "g2").collect()] == [0.6667, 0.0, 0.0]
    q = spark.createDataFrame([("a", x) for x in (0.0, 0.3, 0.5, 1.0)], "s string, score double")
    assert scores.quantile_thresholds(q, ["s"]).first().threshold == pytest.approx(0.045)
    assert scores.summary(q.limit(1), ["s"]).first().sd is None


def test_synteny_scores(spark):
    near = spark.createDataFrame([(1, [11, 12]), (2, [21, 22])], "gene long, neighbours array<long>")
    edges = spark.createDataFrame([(11, 21, 0.9), (11, 22, 0.8), (12, 22, 0.5)], "g1 long, g2 long, raw_sc double")
    pairs = spark.createDataFrame([(1, 2), (1, 1)], "g1 long, g2 long")
    got = {(r.g1, r.g2): r.syn_sc for r in scores.synteny_scores(pairs, near, edges, 3).collect()}
    assert got[1, 2] == pytest.approx((0.9 + 0.5) / 3) and got[1, 1] == 0.0


def test_every_edge_gets_a_synteny_score(spark):
    near = {r.gene: r.neighbours for r in order.synteny_neighbours(A.part_order(spark, SMALL), 8).collect()}
    raw = {(r.g1, r.g2): float(r.raw_sc) for r in registry._edges(spark, SMALL).collect()}
    got = {(r.g1, r.g2): r.syn_sc for r in __spark_entry__.queries()["synteny_scores"](spark, SMALL).collect()}
    assert set(got) == set(raw) and any(b - a >= 100 for a, b in got)
    for a, b in raw:
        found = [(raw[min(x, y), max(x, y)], i, j) for i, x in enumerate(near[a]) for j, y in enumerate(near[b]) if (min(x, y), max(x, y)) in raw]
        assert got[a, b] == pytest.approx(scores.greedy_matching(found, 3))


def test_graph(spark):
    e = spark.createDataFrame([(1, 2), (2, 3), (4, 4), (None, 7)], "a long, b long")
    assert sorted(graph.connected_components(e).collect()) == [(1, 1), (2, 1), (3, 1), (4, 4)]
    path = spark.createDataFrame([(i, i + 1) for i in range(200)], "a long, b long")
    assert {r.component for r in graph.connected_components(path).collect()} == {0}
    assert graph.connected_components(e.limit(0)).count() == 0


def test_tree_tables(spark):
    rows = [("s0", None, None), ("s1", "s0", 1.0), ("D", "s0", 3.0), ("s2", "s1", 1.0), ("C", "s1", 2.0), ("A", "s2", 1.0), ("B", "s2", 1.0)]
    nodes = spark.createDataFrame(rows, "node string, parent string, branch_len double")
    paths = tree.closure(nodes)
    assert {(r.node, tuple(r.ancestors)) for r in tree.ancestors(paths).where("node in ('A', 's2')").collect()} == {("A", ("s2", "s1", "s0")), ("s2", ("s1", "s0"))}
    sets = spark.createDataFrame([(1, "A"), (1, "B"), (2, "A"), (2, "D"), (3, "C")], "grp int, node string")
    assert dict(tree.common_ancestor(paths, sets).collect()) == {1: "s2", 2: "s0", 3: "C"}
    assert sorted(r.neighbour for r in tree.nearest_neighbours(nodes, paths).where("leaf = 'C'").collect()) == ["A", "B"]
    assert tree.tip_distances(paths, tree.leaves(nodes)).where("a = 'A' and b = 'D'").first().dist == 6.0
    cut = {r.node: (r.parent, r.branch_len) for r in tree.prune(nodes, paths, spark.createDataFrame([("A",), ("D",)], "node string")).collect()}
    assert cut == {"A": ("s0", 3.0), "D": ("s0", 3.0), "s0": (None, None)}
    assert [r.node for r in tree.preorder(nodes, paths).orderBy("ord").collect()] == ["s0", "D", "s1", "C", "s2", "A", "B"]


SPECIES = "(((A,B)s2,C)s1,D)s0;"


def test_reconciliation_tables(spark):
    rows = [(1, "(1,2)r;", [("1", "A", 1), ("2", "B", 1)]), (2, "(3,4)r;", [("3", "A", 1), ("4", "B", 2)]), (3, "5;", [("5", "D", 4)])]
    fam = spark.createDataFrame(rows, "fam long, newick string, genes array<struct<gene:string,species:string,locus:long>>")
    found = families.reconcile(fam, SPECIES, Costs()).cache()
    assert {r.fam: (r.cost, r.chosen_cost) for r in found.collect()} == {1: ("6", "6"), 2: ("12", "12"), 3: ("6", "6")}
    origins = families.origin_families(found)
    assert sorted((r.source_fam, r.mrca, len(r.genes)) for r in origins.collect()) == [(1, "s2", 2), (2, "A", 1), (2, "B", 1), (3, "D", 1)]
    nodes = spark.createDataFrame([("s0", None), ("s1", "s0"), ("D", "s0"), ("s2", "s1"), ("C", "s1"), ("A", "s2"), ("B", "s2")], "node string, parent string")
    classes = families.classify(origins.withColumn("mrca", origins.mrca), tree.closure(nodes), "s2")
    assert {r["class"] for r in classes.collect()} == {"X"}
    events = families.recon_events(found)
    assert dict(families.event_counts(events).collect())["O"] == 4
    loose = families.permissive(fam, spark.createDataFrame([(1,)], "fam long"), SPECIES)
    assert loose.first().cost.startswith("-")
    alone = spark.createDataFrame([], "fam long, lfs array<struct<lf:long,mrca:string,genes:array<long>>>")
    apart = spark.createDataFrame([], "fam long, pairs array<struct<g1:long,g2:long>>")
    numbers = fam.withColumns({"newick": F.translate("newick", "abcd", "1234"), "genes": F.transform("genes", lambda g: F.struct(F.translate(g["gene"], "abcd", "1234").alias("gene"), g["species"], g["locus"]))})
    chosen = refine.refine(numbers, alone, apart, spark.createDataFrame([], "gene long, strain string"), SPECIES)
    assert {r.fam: r.n_islands for r in chosen.collect()} == {1: 1, 2: 2, 3: 1}
    found.unpersist()


def test_islands_table(spark):
    members = spark.createDataFrame([(1, "A", 10), (1, "B", 20), (2, "A", 11), (2, "B", 21), (3, "A", 15), (3, "B", 29)], "lf long, strain string, gene long")
    genes = [("A", 0, i, 10 + i, None) for i in range(6)] + [("B", 0, i, 20 + i, None) for i in range(10)]
    near = islands.near_families(members, order.proximity(spark.createDataFrame(genes, "strain string, contig int, pos int, gene long, core long"), 2), 2)
    got = islands.make_islands(members.select("lf").distinct().selectExpr("lf", "'s2' as mrca"), near, SPECIES)
    assert sorted((r.id, r.lfs) for r in got.collect()) == [(1, [1, 2]), (3, [3])]
    assert islands.size_table(got).count() == 2


def test_locus_islands_take_every_event(spark, tmp_path):
    rows = [(1 + i, user, "click", f"2026-01-01 00:00:{i:02d}", 1.0) for i, user in enumerate([4, 4, 9, 9])]  # strain 4 only
    events = spark.createDataFrame([(g + 2, *r) for g, *r in rows], "event_id long, user_id long, event_type string, ts string, value double")
    both = events.withColumn("event_id", events.event_id * 5 - 2)  # families of the root
    both.selectExpr("event_id", "user_id", "event_type", "cast(ts as timestamp) ts", "value").write.parquet(str(tmp_path / "events.parquet"))
    got = sorted((r.mrca, r.lfs) for r in __spark_entry__.queries()["locus_islands"](spark, str(tmp_path)).collect())
    assert got == [("s0", "13,18"), ("s0", "23,28")]


def test_reports(spark, tmp_path):
    rows = spark.createDataFrame([(1, "abc", None), (2, "x", "zab")], "gene long, name string, descrip string")
    assert [r.gene for r in reports.search(rows, ["name", "descrip"], "ab").orderBy("gene").collect()] == [1, 2]
    colours = reports.colour_islands([1, 2, 1, 3], ["r", "g", "b"], {2: "g"})
    assert colours[2] == "g" and colours[1] != "g"
    cover = spark.createDataFrame([("A", "B", 5), ("B", "A", 1), ("B", "C", 9), ("C", "A", 2)], "strain string, other string, n long")
    assert reports.greedy_cover(cover, 2) == ["B", "C"]
    assert reports.same_table(rows, rows) and not reports.same_table(rows, rows.limit(1))
    lines = spark.createDataFrame([("A", 0, 0, "x"), ("A", 0, 1, "y"), ("B", 0, 0, "z")], "strain string, contig int, pos int, value string")
    reports.write_strain_files(lines, str(tmp_path / "genes"))
    assert spark.read.text(str(tmp_path / "genes" / "strain=A")).count() == 3


def test_incremental(spark):
    wanted = spark.createDataFrame([("a", 5), ("b", 5), ("c", 9)], "key string, modified long")
    done = spark.createDataFrame([("a", 6), ("c", 8)], "key string, modified long")
    assert sorted(r.key for r in streaming.missing_outputs(wanted, done).collect()) == ["b", "c"]


def test_stream_of_hits(spark, tmp_path):
    rows = spark.createDataFrame([("2026-01-01 00:00:00", "A", "B", 1, 2, 9), ("2026-01-01 00:00:01", "A", "B", 1, 2, 9)], "ts string, strain_q string, strain_s string, q long, s long, score int")
    rows.selectExpr("cast(ts as timestamp) ts", "strain_q", "strain_s", "q", "s", "score").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("ts timestamp, strain_q string, strain_s string, q long, s long, score int").parquet(str(tmp_path / "in"))
    run = streaming.new_hits(stream).writeStream.format("memory").queryName("hits_seen").option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
    assert run.awaitTermination(60) and spark.table("hits_seen").count() == 1


def test_entry_runs(spark):
    assert __spark_entry__.entry(spark).count() == 16
    known = __spark_entry__.queries()
    assert set(__spark_entry__.oracle_sql()) <= set(known)


@pytest.mark.parametrize("name", ["capped_families", "homolog_peaks", "raw_scores", "synteny_scores", "reconciliation", "reconciliation_events", "origin_families", "locus_islands", "representatives"])
def test_queries_without_sql_run(spark, name):
    known = __spark_entry__.queries()
    assert known[name](spark, SMALL).count() > 0


def test_every_order_is_reconciled(spark):
    lines = spark.read.parquet(f"{SMALL}/lineitem.parquet").select("l_orderkey", "l_partkey").distinct().collect()
    want: dict = {}
    for r in lines:
        want.setdefault(r.l_orderkey, set()).add(str(r.l_partkey))
    got = registry._recon_input(spark, SMALL).select("fam", "genes.gene").collect()
    assert len(got) == len(want) and {r.fam: set(r.gene) for r in got} == want


def test_costs_add_up(spark):
    rows = __spark_entry__.queries()["reconciliation"](spark, SMALL).collect()
    assert all(r.cost == r.chosen_cost and int(r.n_mprs) > 0 for r in rows)


@pytest.mark.parametrize("how", ["deleted", "broken"])
def test_imports_without_the_optional_parts(tmp_path, how):
    """In a copy of the repository: the parts are gone, or can't be imported."""
    gone = shutil.ignore_patterns("llm", "corpus_pipeline.py", ".git", "tests", "__pycache__")
    shutil.copytree(__spark_entry__._HERE, tmp_path / "repo", ignore=gone)
    if how == "broken":
        (tmp_path / "repo/cladescope/llm").mkdir()
        (tmp_path / "repo/cladescope/llm/__init__.py").write_text("")
        (tmp_path / "repo/cladescope/llm/queries.py").write_text("import a_module_that_is_not_there\n")
        (tmp_path / "repo/corpus_pipeline.py").write_text("from cladescope.llm import gone\n")
    code = "import __spark_entry__ as e; q = set(e.queries()); assert 'best_hits' in q and not [n for n in q if n[:2] == 'op' and n[2].isdigit() or n == 'pipeline'] and set(e.oracle_sql()) <= q"
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    subprocess.run([sys.executable, "-c", code], check=True, cwd=tmp_path / "repo", env=env)


def test_running_numbers(spark):
    from cladescope.operators.numbering import numbered

    rows = spark.range(1000).select(((F.col("id") * 7919) % 1000).alias("k"))
    got = {r.k: r.n for r in numbered(rows, [F.desc("k")], "n").collect()}
    assert got == {k: 1000 - k for k in range(1000)}
    assert numbered(rows.limit(0), ["k"], "n").count() == 0


def test_trees_of_many_children_are_reconciled(spark):
    genes = [("a", "A", 0), ("b", "B", 0), ("c", "C", 1), ("d", "D", 0), ("e", "A", 1)]
    rows = [(1, "(a,b,c,d,e);"), (2, "((a,b,c,d),e);"), (3, "(a,b,(c,d,e));")]
    table = spark.createDataFrame([(f, t, genes) for f, t in rows], "fam long, newick string, genes array<struct<gene:string,species:string,locus:long>>")
    for rooted in (False, True):
        found = families.reconcile(table, "(((A,B)s2,C)s1,D)s0;", rooted=rooted).collect()
        assert len(found) == 3 and all(r.cost == r.chosen_cost for r in found)


def test_islands_by_id_and_hard_core(spark):
    i = spark.createDataFrame([(1, "s1", [4]), (1, "s0", [5]), (2, "s2", [6])], "id long, mrca string, lfs array<long>")
    got = islands.by_id(i, spark.createDataFrame([(1,), (1,), (9,)], "id long")).collect()
    assert [(r.id, r.mrca, r.lfs) for r in got] == [(1, "s0", [5])]
    sets = spark.createDataFrame([(0, 1), (0, 2), (1, 1), (1, 3)], "grp int, gene long")
    fams = spark.createDataFrame([(7, 1), (7, 2), (5, 1), (5, 2), (5, 9), (6, 3)], "fam long, gene long")
    assert [(r.grp, r.fam) for r in families.first_holding(sets, fams).collect()] == [(0, 5)]


def test_bed_files_have_a_track_line(spark, tmp_path):
    rows = spark.createDataFrame([("A", "c", 5, "c\t5"), ("A", "b", 9, "b\t9"), ("B", "c", 1, "c\t1")], "strain string, chrom string, start long, value string")
    reports.write_bed(rows, str(tmp_path / "bed"))
    found = {p.name: [line for f in sorted(p.glob("part-*")) for line in f.read_text().splitlines()] for p in (tmp_path / "bed").glob("strain=*")}
    assert found == {"strain=A": ['track name="islands A" itemRgb="On"', "b\t9", "c\t5"], "strain=B": ['track name="islands B" itemRgb="On"', "c\t1"]}


def test_functions_in_sql(spark):
    from cladescope.functions import sql

    sql.register(spark)
    row = spark.sql("select back_align('M-K', 'ATGAAATAA') a, raw_score('MKV', 'MKV') b, newick_leaves('((a,b),c);') c, newick_size('((a,b),c);') d, back_align(null, 'x') e").first()
    assert (row.a, row.b, row.c, row.d, row.e) == ("ATG---AAA", 1.0, ["a", "b", "c"], 5, None)
    genes = "array(named_struct('gene','a','species','A','locus',1L), named_struct('gene','b','species','B','locus',2L))"
    found = spark.sql(f"select * from optimal_histories('(a,b);', {genes}, '(((A,B)s2,C)s1,D)s0;', 5)").collect()
    assert sorted((r.event, r.gene_node) for r in found if r.event == "O") == [("O", "a"), ("O", "b")] and {r.solution for r in found} == {0}


@pytest.fixture(scope="module")
def duck():
    import duckdb

    con = duckdb.connect()
    for path in glob.glob(f"{SMALL}/*.parquet"):
        con.execute(f"create view {os.path.basename(path).removesuffix('.parquet')} as select * from read_parquet('{path}')")
    return con


@pytest.mark.parametrize("name", sorted(n for n, f in registry.queries().items() if f.__module__.endswith("derived") and n in registry.oracle_sql()))
def test_derived_queries_equal_their_sql(spark, duck, name):
    mine, its = registry.queries()[name](spark, SMALL).toPandas(), duck.execute(registry.oracle_sql()[name]).fetchdf()
    assert sorted(mine.columns) == sorted(its.columns)
    one = lambda x: None if pd.isna(x) else x if isinstance(x, str) else round(float(x), 9)
    plain = lambda t: sorted((tuple(map(one, r)) for r in t[sorted(t.columns)].itertuples(index=False)), key=repr)
    assert plain(mine) == plain(its)


def test_synteny_scores_broadcast_no_genes(spark):
    """No table of all genes goes through the driver, small as the planner thinks it."""
    o = spark.range(100).selectExpr("0 as strain", "0 as contig", "id as pos", "id as gene")
    edges = spark.range(99).selectExpr("id as g1", "id + 1 as g2", "0.5D as raw_sc")
    for runs in (None, o.selectExpr("gene", "gene div 8 as run")):
        found = scores.synteny_scores(edges, order.synteny_neighbours(o, 8), edges, runs=runs)
        assert "BroadcastExchange" not in found._jdf.queryExecution().executedPlan().toString()
        assert found.count() == 99


def test_tip_distances_in_blocks(spark):
    """Each pair is made once, at its lowest common ancestor, however the tips are dealt."""
    nodes = spark.createDataFrame([("r", None, None), ("x", "r", 1.0), ("y", "r", 2.0)] + [(f"t{i}", "xyr"[i % 3], float(i)) for i in range(30)], "node string, parent string, branch_len double")
    paths, tips = tree.closure(nodes), tree.leaves(nodes)
    got = {(r.a, r.b): r.dist for r in tree.tip_distances(paths, tips, 4).collect()}
    above = {"x": 1.0, "y": 2.0, "r": 0.0}
    place = {f"t{i}": ("xyr"[i % 3], float(i)) for i in range(30)}
    want = {(a, b): place[a][1] + place[b][1] + (0.0 if place[a][0] == place[b][0] else above[place[a][0]] + above[place[b][0]]) for a in place for b in place if a < b}
    assert got == want
    plan = tree.tip_distances(paths, tips)._jdf.queryExecution().optimizedPlan().toString()
    assert "min_by" not in plan


def test_histories_equal_the_table_function(spark):
    """The operator and SQL's table function list the same histories, and families run in more than one task."""
    from cladescope.functions import sql

    sql.register(spark)
    small = registry._recon_input(spark, SMALL).where("size(genes) > 2")
    assert small.rdd.getNumPartitions() == int(spark.conf.get("spark.sql.shuffle.partitions"))
    small = small.where("fam % 5 = 0")
    small.createOrReplaceTempView("some_families")
    its = spark.sql(f"SELECT f.fam, h.* FROM some_families f, LATERAL optimal_histories(f.newick, f.genes, '{registry.SPECIES}', 3) h")
    mine = families.histories(small, registry.SPECIES, most=3)
    assert mine.columns == its.columns and mine.count() == its.count() > 100
    assert mine.exceptAll(its).isEmpty()


def _shuffled_bytes(spark):
    sc = spark.sparkContext._jsc.sc()
    sc.listenerBus().waitUntilEmpty()
    executors = sc.statusStore().executorList(False)
    return sum(executors.apply(k).totalShuffleWrite() for k in range(executors.size()))


def test_synteny_scores_shuffle_little(spark):
    """The disk holds what is shuffled: lines twice and packed pairs once, less than four times the input."""
    before = _shuffled_bytes(spark)
    __spark_entry__.queries()["synteny_scores"](spark, SMALL).write.format("noop").mode("overwrite").save()
    time.sleep(1)
    assert 0 < _shuffled_bytes(spark) - before < 4 * os.path.getsize(f"{SMALL}/lineitem.parquet")


def test_synteny_scores_of_odd_lines_equal_their_sql(spark, tmp_path):
    """Contigs over several tiles, repeated parts in an order, nulls, parts without a contig and parts that aren't listed."""
    import duckdb

    con, d = duckdb.connect(), tmp_path / "odd"
    d.mkdir()
    con.execute("create table part as select k::BIGINT as p_partkey, case when k % 97 = 5 then null else 'b' || (k % 3) end as p_brand from range(9000) r(k)")
    con.execute("""create table lineitem as select case when h % 53 = 0 then null else (k // 5)::BIGINT end as l_orderkey,
      case when h % 59 = 0 then null when h % 61 = 0 then -h % 50 when k % 5 = 4 and h % 7 = 0 then base else (base + [0, 12, 4021, 4033, 24][k % 5 + 1] + 12 * (h % 3)) % 9300 end::BIGINT as l_partkey,
      case when h % 31 = 0 then null else (20 + h % 30)::DOUBLE end as l_quantity
      from (select k, hash(k // 5) % 9300 // 4 as base, (hash(k * 3 + 1) % 1000003)::BIGINT as h from range(60000) r(k))""")
    for x in ("part", "lineitem"):
        con.execute(f"copy {x} to '{d}/{x}.parquet' (format parquet)")
    its = con.execute(registry.oracle_sql()["synteny_scores"]).fetchdf().sort_values(["g1", "g2"])
    mine = registry.queries()["synteny_scores"](spark, str(d)).toPandas().sort_values(["g1", "g2"])
    assert mine[["g1", "g2"]].values.tolist() == its[["g1", "g2"]].values.tolist()
    assert mine.syn_sc.values == pytest.approx(its.syn_sc.values, abs=2e-9) and (mine.syn_sc > 0).mean() > 0.1
    none = spark.read.parquet(f"{d}/lineitem.parquet").limit(0)
    none.write.parquet(str(tmp_path / "empty/lineitem.parquet"))
    con.execute(f"copy part to '{tmp_path}/empty/part.parquet' (format parquet)")
    assert registry.queries()["synteny_scores"](spark, str(tmp_path / "empty")).count() == 0


def test_tiles_keep_every_pair():
    rng = np.random.default_rng(5)
    n, ends = 3000, [-(2**63), 2**63 - 1, 0, -1]
    c = {x: np.sort(rng.choice([*ends, *rng.integers(-(2**40), 2**40, 50)], n)) if x == "g1" else rng.integers(-(2**62), 2**62, n) for x in tiles._PAIR}
    assert (tiles._unpack(n, pa.py_buffer(tiles._pack(c))) == [c[x] for x in tiles._PAIR]).all()
    # a pair and all that it sees are in its bucket
    size, buckets = 4 * tiles.SIDE, 97
    p = rng.integers(8, size, (2, 20000))
    at = lambda p1, p2: dict(zip(tiles._PAIR, (p1, p2, p1, p2)))
    rows, found = tiles._seen(at(*p), 4, buckets)
    assert len(set(zip(rows, found))) == len(rows)
    sent = set(zip(*p[:, rows], found))
    seen = p + rng.integers(-3, 5, p.shape)
    home = tiles._home(*seen, *seen, buckets)
    assert set(zip(*p, home)) <= sent and len(rows) < 1.1 * p.shape[1]


def test_greedy_choice_of_many_pairs():
    rng = np.random.default_rng(6)
    rows = np.unique(rng.integers(0, [50, 7, 7], (900, 3)), axis=0)
    pair, x, y = rows.T
    score = rng.integers(1, 4, len(rows)) / 2.0
    want = [scores.greedy_matching([(s, i, j) for k, i, j, s in zip(pair, x, y, score) if k == n], 3) for n in range(51)]
    assert tiles._greedy(pair, score, x, y, 51, 3).tolist() == want
