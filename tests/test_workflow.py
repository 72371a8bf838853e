"""The workflow on a small planted clade."""

import random

import pytest

from cladescope.config import Params
from cladescope.operators.scores import AMINO, raw_score
from cladescope.plans.workflow import STAGES, Workflow

SPECIES = "(((A:1,B:1)s2:1,C:2)s1:1,D:3)s0;"


@pytest.fixture(scope="module")
def flow(spark):
    """Eight core genes in every strain, and two that A and B share next to each other in the middle."""
    rng = random.Random(3)
    protein = {k: "".join(rng.choice(AMINO[:20]) for _ in range(60)) for k in range(10)}
    genes, order, seqs, kind = [], [], [], {}
    number = 0
    for i, strain in enumerate("ABCD"):
        line = [0, 1, 2, 3, 8, 9, 4, 5, 6, 7] if strain in "AB" else list(range(8))
        for pos, k in enumerate(line):
            text = list(protein[k])
            for _ in range(3 * i):
                text[rng.randrange(60)] = rng.choice(AMINO[:20])
            genes.append((number, f"{number}_{strain}-t{k}", strain))
            order.append((strain, 0, pos, number))
            seqs.append((number, "".join(text)))
            kind[number] = k
            number += 1
    hits = []
    strain_of = {g: s for g, _, s in genes}
    seq = dict(seqs)
    for q in kind:
        for n, s in enumerate(kind):
            if q != s and kind[q] == kind[s]:
                hits.append((strain_of[q], strain_of[s], n, q, s, 1e-30, 60, 1, 60, 60, 1, 60, 90.0, int(100 * raw_score(seq[q], seq[s]))))
    names = "strain_q string, strain_s string, line_no long, q long, s long, evalue double, qlen int, qstart int, qend int, slen int, sstart int, send int, pident double, score int"
    inputs = {
        "strains": spark.createDataFrame([(i, s) for i, s in enumerate("ABCD")], "strain_idx int, strain string"),
        "genes": spark.createDataFrame(genes, "gene long, name string, strain string"),
        "order": spark.createDataFrame(order, "strain string, contig int, pos int, gene long"),
        "sequences": spark.createDataFrame(seqs, "gene long, protein string"),
        "hits": spark.createDataFrame(hits, names),
    }
    return Workflow(spark, inputs, SPECIES, Params(focal_root="s2")), kind, strain_of


def test_stages(flow):
    w, kind, strain = flow
    assert w["orthologs"].select("grp").distinct().count() == 8
    assert {kind[r.gene] for r in w["orthologs"].collect()} == set(range(8))
    fams = {}
    for r in w["blast_families"].collect():
        fams.setdefault(r.fam, set()).add(kind[r.gene])
    assert sorted(map(len, fams.values())) == [1] * 10
    assert w["edges"].count() == 8 * 6 + 2 and w["identity"].count() == 16
    classes = {kind[int(r.genes[0])]: (r["class"], r.mrca, len(r.genes)) for r in w["origins"].collect()}
    assert all(classes[k] == ("C", "s0", 4) for k in range(8)) and classes[8] == classes[9] == ("X", "s2", 2)
    together = [sorted(r.lfs) for r in w["locus_islands"].where("mrca = 's2'").collect()]
    assert len(together) == 1 and len(together[0]) == 2
    rows = {r.gene: r for r in w["assignments"].collect()}
    assert len(rows) == 36 and len({rows[g].island for g in rows if kind[g] in (8, 9)}) == 1
    assert {rows[g].history for g in rows if kind[g] == 8} == {"OS"}


def test_every_stage_runs(flow):
    w, *_ = flow
    for name in STAGES:
        assert w[name].columns, name


LOOSE = Params(O=1, L=1, D=6, T=6, R=6)


@pytest.mark.parametrize(("near", "islands", "origins"), [([(50, "A", 5), (60, "C", 6)], 2, ["A", "C"]), ([(50, "s1", 5), (60, "s1", 6)], 1, ["s1"])])
def test_refinement_takes_the_history_with_fewer_islands(spark, near, islands, origins):
    """One origin with a loss costs as much as two origins: the neighbours decide."""
    from cladescope.operators import order, refine
    from cladescope.operators.order import proximity

    lines = [("A", 0, 0, 5), ("A", 0, 1, 1), ("C", 0, 0, 6), ("C", 0, 1, 2)]
    table = spark.createDataFrame(lines, "strain string, contig int, pos int, gene long")
    own = spark.createDataFrame([(1, 1), (1, 2)], "fam long, gene long")
    lf = {50: 7, 60: 7 if near[0][1] == "s1" else 8}
    members = spark.createDataFrame([(g, lf[k], lf[k], k, m) for k, m, g in near] + [(1, 90, 90, 1, "s1"), (2, 90, 90, 1, "s1")], "gene long, lf long, ofam long, source_fam long, mrca string")
    loci = refine.near_loci(own, table, members, 4)
    pairs = refine.near_pairs(own, loci, proximity(table, 1), 1)
    genes = [("1", "A", 0), ("2", "C", 0)]
    asked = spark.createDataFrame([(1, "(1,2);", genes)], "fam long, newick string, genes array<struct<gene:string,species:string,locus:long>>")
    row = refine.refine(asked, loci, pairs, table.select("gene", "strain"), SPECIES, LOOSE.costs).first()
    assert row.n_islands == islands and sorted(e.sp_node for e in row.events if e.event == "O") == origins


def test_drawn_solutions_are_optimal():
    from cladescope.functions.reconcile import Reconciliation
    from cladescope.functions.trees import parse_newick

    found = Reconciliation(parse_newick(SPECIES), parse_newick("((1,2),3);", "g"), {"1": "A", "2": "C", "3": "D"}, {"1": 0, "2": 0, "3": 1}, LOOSE.costs)
    drawn = [tuple(sorted(s, key=repr)) for s in found.drawn(400, 5)]
    every = {tuple(sorted(s, key=repr)) for s in found.solutions()}
    assert set(drawn) == every and len(every) == found.count() > 1
    assert min(drawn.count(s) for s in every) > 400 / len(every) / 2
    assert drawn == [tuple(sorted(s, key=repr)) for s in found.drawn(400, 5)]
