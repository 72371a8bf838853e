"""Gene families: blast families, single linkage by locus, reconciliation, origin and locus families, refinement."""

from __future__ import annotations

import itertools

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cladescope.functions.clusters import capped_split
from cladescope.functions.reconcile import PERMISSIVE, Costs, Reconciliation, best_rooting, gene_histories, split_by_origin
from cladescope.functions.shapes import Histories, NearTrees
from cladescope.functions.trees import Tree, Unrooted, binarise, forced_split, neighbour_joining, parse_newick, split_long_branches, to_newick
from cladescope.operators.graph import connected_components
from cladescope.operators.numbering import numbered


def number_by_size(groups: DataFrame, member: str = "gene") -> DataFrame:
    """fam (from 1, largest first, then by smallest member), ``member`` from (component, member)."""
    per = groups.groupBy("component").agg(F.count("*").alias("n"), F.min(member).alias("least"))
    ranked = numbered(per, [F.desc("n"), F.col("least")], "fam")
    return groups.join(ranked.select("component", "fam"), "component").select("fam", member)


def blast_families(edges: DataFrame, genes: DataFrame, cap: int | None = None) -> DataFrame:
    """fam, gene: components of the edge table, single genes included; those over ``cap`` are split.

    Only components over the cap go to one task each, with their own edges.
    """
    own = genes.select(F.col("gene").alias("g1"), F.col("gene").alias("g2"))
    found = connected_components(edges.select("g1", "g2").unionByName(own), "g1", "g2").withColumnRenamed("node", "gene")
    if cap is None:
        return number_by_size(found)
    big = found.groupBy("component").agg(F.count("*").alias("n")).where(F.col("n") > cap).select("component")
    inside = edges.where("g1 != g2").join(found.withColumnRenamed("gene", "g1").join(big, "component"), "g1").select("component", "g1", "g2", "raw_sc")

    def split(frame: pd.DataFrame) -> pd.DataFrame:
        nodes = sorted({*frame["g1"], *frame["g2"]})
        parts = capped_split(nodes, list(zip(frame["g1"], frame["g2"], frame["raw_sc"])), cap)
        return pd.DataFrame([(p[0], g) for p in parts for g in p], columns=["component", "gene"])

    parts = inside.groupBy("component").applyInPandas(split, "component long, gene long")
    rest = found.join(big, "component", "left_anti").select(F.col("component").cast("long").alias("component"), F.col("gene").cast("long").alias("gene"))
    return number_by_size(rest.unionByName(parts))


def single_linkage(edges: DataFrame, families: DataFrame) -> DataFrame:
    """lf (from 1), fam, gene: components within each family over the edges given."""
    a = families.select(F.col("gene").alias("g1"), F.col("fam"))
    b = families.select(F.col("gene").alias("g2"), F.col("fam").alias("fam2"))
    inside = edges.join(a, "g1").join(b, "g2").where("fam = fam2").select("g1", "g2")
    own = families.select(F.col("gene").alias("g1"), F.col("gene").alias("g2"))
    found = connected_components(inside.unionByName(own), "g1", "g2").withColumnRenamed("node", "gene").join(families, "gene")
    per = numbered(found.select("fam", "component").distinct(), ["fam", "component"], "lf")
    return found.join(per, ["fam", "component"]).select("lf", "fam", "gene")


def gene_trees(distances: DataFrame, members: DataFrame) -> DataFrame:
    """fam, newick by neighbour joining: distances (fam, a, b, dist), members (fam, gene). A family is a row."""
    own = members.groupBy("fam").agg(F.array_sort(F.collect_list(F.col("gene").cast("string"))).alias("names"))
    apart = F.struct(F.col("a").cast("string").alias("a"), F.col("b").cast("string").alias("b"), F.col("dist").cast("double").alias("dist"))
    far = distances.groupBy(F.col("fam").alias("of_fam")).agg(F.collect_list(apart).alias("apart"))

    def build(batches):
        joined = _worker_state(("trees",), lambda: NearTrees(_joined_tree))
        for batch in batches:
            names, (apart, a, b, dist) = _lists(batch.column("names")), _lists(batch.column("apart"), "a", "b", "dist")
            out = []
            for own, (x, y) in zip(names, apart):
                d = {(p, q) if p < q else (q, p): z for p, q, z in zip(a[x:y], b[x:y], dist[x:y])}
                out.append(own[0] + ";" if len(own) == 1 else joined(own, d))
            yield pa.RecordBatch.from_arrays([batch.column("fam").cast(pa.int64()), pa.array(out, pa.string())], ["fam", "newick"])

    return own.join(far, F.col("fam") == F.col("of_fam"), "left").select("fam", "names", "apart").mapInArrow(build, "fam long, newick string")


def _joined_tree(names: list[str], distance: dict[tuple[str, str], float]) -> str:
    tree = neighbour_joining(names, distance)
    return to_newick(tree.rooted(*tree.branches()[0]))


_STATE: dict = {}


def _worker_state(key: tuple, make):
    """What a worker keeps from task to task, for the few settings of a session."""
    if key not in _STATE:
        if len(_STATE) > 8:
            _STATE.clear()
        _STATE[key] = make()
    return _STATE[key]


def _lists(column: pa.Array, *fields: str):
    """The lists of a column; of structs the lists' bounds, and each field's values over all lists."""
    values, at = column.values, column.offsets.to_pylist()
    if not fields:
        flat = values.to_pylist()
        return [flat[x:y] for x, y in zip(at, at[1:])]
    return list(zip(at, at[1:])), *(values.field(f).to_pylist() for f in fields)


def _event_columns(events: list[tuple]) -> list[pa.Array]:
    columns = list(zip(*events)) if events else [()] * 6
    return [pa.array(c, pa.string()) for c in columns[:5]] + [pa.array(columns[5], pa.int64())]


def split_threshold(trees: DataFrame, quantile: float = 0.95, times: float = 1.5) -> float:
    """``times`` the quantile of the longest branches of trees (newick) of ortholog sets; infinite without any."""

    def longest(batches):
        for batch in batches:
            found = [max(Unrooted.of(parse_newick(t, "g")).length.values(), default=0.0) for t in batch["newick"]]
            yield pd.DataFrame({"x": found})

    x = trees.select("newick").mapInPandas(longest, "x double").agg(F.percentile("x", quantile)).first()[0]
    return float("inf") if x is None else float(x) * times


def initial_families(trees: DataFrame, sets: DataFrame, longest: float, cap: int, balance: float = 10.0) -> DataFrame:
    """fam, part, newick, genes: trees (fam, newick) cut at branches over ``longest``, and on until no part exceeds ``cap``.

    No ortholog set (grp, gene) of a family is parted. A family is one task's row.
    """

    def cut(key, tree: pd.DataFrame, own: pd.DataFrame) -> pd.DataFrame:
        groups = [set(g["gene"].astype(str)) for _, g in own.groupby("grp")]
        rows = []
        for newick in tree["newick"]:
            whole = parse_newick(newick, "g")
            todo = split_long_branches(Unrooted.of(whole), longest, groups) if len(whole.leaves()) > 2 else []
            if not todo:
                rows.append((newick, whole.leaves()))
            while todo:
                now = todo.pop()
                halves = forced_split(now, groups, balance) if len(now.leaves()) > cap else None
                if halves:
                    todo += halves
                elif len(now.leaves()) < 2:
                    rows.append((f"{now.leaves()[0]};", now.leaves()))
                else:
                    rows.append((to_newick(now.rooted(*now.branches()[0], root="g_root")), now.leaves()))
        rows.sort(key=lambda r: sorted(r[1]))
        return pd.DataFrame({"fam": key[0], "part": range(len(rows)), "newick": [r[0] for r in rows], "genes": [sorted(r[1]) for r in rows]})

    inside = sets.select(F.col("fam").alias("of_fam"), "grp", "gene")
    return trees.groupBy("fam").cogroup(inside.groupBy("of_fam")).applyInPandas(cut, "fam long, part int, newick string, genes array<string>")


def resolved(tree: Tree, locus: dict[str, int], rooted: bool) -> Tree:
    """``tree`` with two children at every node, but for an unrooted tree's top, which may have three.

    Children whose genes share their locations with few of the others join first.
    """
    if all(len(kids) <= 2 or len(kids) == 3 and node == tree.root and not rooted for node, kids in tree.children.items()):
        return tree
    spread: dict[str, int] = {}
    for kids in tree.children.values():
        own = {k: {locus[x] for x in tree.leaves(k)} for k in kids}
        spread |= {k: sum(bool(own[k] & own[o]) for o in kids if o != k) for k in kids}
    return binarise(tree, spread)


def reconcile(families: DataFrame, species_newick: str, costs: Costs = Costs(), rooted: bool = False) -> DataFrame:
    """Per family: fam, cost (text, may be large), n_mprs (text), tree, events.

    families: fam, newick, genes array<struct<gene string, species string, locus long>>.
    One family is one row; rows are independent and never gathered.
    """

    def median(found: Reconciliation) -> tuple:
        chosen = found.solution(found.median())
        return (f"{found.cost:g}", f"{found.total(chosen):g}", str(found.count())), [found.events_of(chosen)]

    def run(batches):
        for fams, found in _worked(batches, "median", median, species_newick, costs, rooted):
            events = [e for _, _, (rows,) in found for e in rows]
            bounds = [0, *itertools.accumulate(len(rows) for _, _, (rows,) in found)]
            order = [i for a, b in itertools.pairwise(bounds) for i in range(b - a)]
            gene_node, nb, event, sp_node, sp_nb, locus = _event_columns(events)
            rows = pa.StructArray.from_arrays([gene_node, nb, pa.array(order, pa.int32()), event, sp_node, sp_nb, locus], ["gene_node", "nb", "ord", "event", "sp_node", "sp_nb", "locus"])
            texts = [pa.array([texts[i] for texts, _, _ in found], pa.string()) for i in range(3)]
            whole = [fams, *texts, pa.array([tree for _, tree, _ in found], pa.string()), pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), rows)]
            yield pa.RecordBatch.from_arrays(whole, ["fam", "cost", "chosen_cost", "n_mprs", "tree", "events"])

    schema = "fam long, cost string, chosen_cost string, n_mprs string, tree string, events array<struct<gene_node:string,nb:string,ord:int,event:string,sp_node:string,sp_nb:string,locus:long>>"
    return families.select("fam", "newick", "genes").mapInArrow(run, schema)


def histories(families: DataFrame, species_newick: str, costs: Costs = Costs(), most: int = 3, rooted: bool = False) -> DataFrame:
    """fam, solution (from 0) and its events, of up to ``most`` optimal reconciliations of every family of ``reconcile``."""

    def listed(found: Reconciliation) -> tuple:
        return (), [found.events_of(x) for x in found.solutions(most)]

    def run(batches):
        for fams, found in _worked(batches, f"first {most}", listed, species_newick, costs, rooted):
            fam = [f for f, (_, _, lists) in zip(fams.to_pylist(), found) for rows in lists for _ in rows]
            solution = [k for _, _, lists in found for k, rows in enumerate(lists) for _ in rows]
            events = _event_columns([e for _, _, lists in found for rows in lists for e in rows])
            whole = pa.RecordBatch.from_arrays([pa.array(fam, pa.int64()), pa.array(solution, pa.int32()), *events], ["fam", "solution", "gene_node", "nb", "event", "sp_node", "sp_nb", "locus"])
            yield from (whole.slice(at, 20_000) for at in range(0, len(whole), 20_000))

    return families.select("fam", "newick", "genes").mapInArrow(run, "fam long, solution int, gene_node string, nb string, event string, sp_node string, sp_nb string, locus long")


def _worked(batches, name: str, what, species_newick: str, costs: Costs, rooted: bool):
    """Families' numbers and, for each, texts, rooted tree and lists of events that ``what`` takes from its reconciliation."""

    def work(newick: str, species: dict[str, str], locus: dict[str, int]) -> tuple:
        tree = resolved(parse_newick(newick, "g"), locus, rooted or len(species) < 3)
        if rooted or len(species) < 3:
            found = Reconciliation(species_tree, tree, species, locus, costs)
        else:
            found = best_rooting(species_tree, Unrooted.of(tree), species, locus, costs)
        texts, lists = what(found)
        return texts, to_newick(found.G, lengths=False), lists

    species_tree = _worker_state(("species", species_newick), lambda: parse_newick(species_newick))
    shapes = _worker_state((name, species_newick, costs, rooted), lambda: Histories(work))
    for batch in batches:
        bounds, genes, species, loci = _lists(batch.column("genes"), "gene", "species", "locus")
        loci = [None if x is None else int(x) for x in loci]
        found = [shapes(newick, genes[a:b], species[a:b], loci[a:b]) for newick, (a, b) in zip(batch.column("newick").to_pylist(), bounds)]
        for at in range(0, len(found), 2000):
            yield batch.column("fam").slice(at, 2000).cast(pa.int64()), found[at : at + 2000]


def permissive(families: DataFrame, special: DataFrame, species_newick: str) -> DataFrame:
    """Reconcile the families in ``special`` (fam) under costs that prefer origins; their cost is stored negative."""
    found = reconcile(families.join(special, "fam", "left_semi"), species_newick, PERMISSIVE)
    return found.withColumn("cost", F.concat(F.lit("-"), F.col("cost")))


def recon_events(reconciled: DataFrame) -> DataFrame:
    return reconciled.select("fam", F.explode("events").alias("e")).select("fam", "e.*")


def origin_families(reconciled: DataFrame) -> DataFrame:
    """source_fam, root, mrca, locus, genes, histories and locus families: a row for every origin."""

    def run(batches):
        for batch in batches:
            bounds, *columns = _lists(batch.column("events"), "gene_node", "nb", "event", "sp_node", "sp_nb", "locus")
            events, rows = list(zip(*columns)), []
            for fam, newick, (a, b) in zip(batch.column("fam").to_pylist(), batch.column("tree").to_pylist(), bounds):
                tree = parse_newick(newick, "g")
                known = gene_histories(tree, events[a:b])
                for part in split_by_origin(tree, events[a:b]):
                    rows.append((fam, part["root"], part["species"], part["locus"], part["genes"], [{"gene": g, "history": known[g]} for g in part["genes"]], part["families"]))
            for at in range(0, len(rows), 2000):
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows[at : at + 2000]), kinds)], names)

    genes = pa.list_(pa.string())
    own = pa.struct([("root", pa.string()), ("origin", pa.string()), ("species", pa.string()), ("locus", pa.int64()), ("genes", genes)])
    kinds = [pa.int64(), pa.string(), pa.string(), pa.int64(), genes, pa.list_(pa.struct([("gene", pa.string()), ("history", pa.string())])), pa.list_(own)]
    names = ["source_fam", "root", "mrca", "locus", "genes", "histories", "families"]
    schema = "source_fam long, root string, mrca string, locus long, genes array<string>, histories array<struct<gene:string,history:string>>, families array<struct<root:string,origin:string,species:string,locus:long,genes:array<string>>>"
    return reconciled.select("fam", "tree", "events").mapInArrow(run, schema)


def classify(origins: DataFrame, species_paths: DataFrame, focal_root: str) -> DataFrame:
    """``origins`` with class: C if its origin's species lies above the focal root, else X."""
    above = species_paths.where((F.col("desc") == focal_root) & (F.col("depth") > 0)).select(F.col("anc").alias("mrca"), F.lit("C").alias("c"))
    return origins.join(above, "mrca", "left").withColumn("class", F.coalesce("c", F.lit("X"))).drop("c")


def first_holding(sets: DataFrame, families: DataFrame) -> DataFrame:
    """grp, fam: the first family, by number, that holds all genes of a set. sets: grp, gene; families: fam, gene.

    With the ortholog sets of all strains these are the families of the hard core.
    """
    size = sets.groupBy("grp").agg(F.count("*").alias("n"))
    held = sets.join(families, "gene").groupBy("grp", "fam").agg(F.count("*").alias("k"))
    return held.join(size, "grp").where("k = n").groupBy("grp").agg(F.min("fam").alias("fam"))


def event_counts(events: DataFrame) -> DataFrame:
    """event, n over all families."""
    return events.groupBy("event").agg(F.count("*").alias("n"))


def events_by_species(events: DataFrame, event: str) -> DataFrame:
    return events.where(F.col("event") == event).groupBy("sp_node").agg(F.count("*").alias("n"))


def families_with_event(events: DataFrame, event: str) -> DataFrame:
    return events.where(F.col("event") == event).select("fam").distinct()


def score_below(events: DataFrame, paths: DataFrame, roots: DataFrame, costs: Costs, branches_only: bool = True) -> DataFrame:
    """fam, root, score: cost of the events below a gene node. ``paths``: fam, anc, desc; ``roots``: fam, root.

    ``branches_only`` counts what sits on branches (origins, losses, rearrangements),
    which leaves out duplications and transfers; without it all events count.
    """
    cost = F.coalesce(*[F.when(F.col("event") == e, F.lit(float(costs.of(e)))) for e in "DTLOR"], F.lit(0.0))
    rows = events.where("nb = 'b'") if branches_only else events
    below = roots.join(paths, (roots["fam"] == paths["fam"]) & (roots["root"] == paths["anc"]) & (paths["anc"] != paths["desc"])).select(roots["fam"], "root", F.col("desc").alias("gene_node"))
    found = below.join(rows, ["fam", "gene_node"]).groupBy("fam", "root").agg(F.sum(cost).alias("score"))
    return roots.join(found, ["fam", "root"], "left").fillna(0.0, ["score"])


def refine_candidates(reconciled: DataFrame, islands: DataFrame, loci: DataFrame, longest: int = 2) -> DataFrame:
    """fam of the families with more than one optimal solution that sit in an island of few locus families."""
    small = islands.where(F.size("lfs") <= longest).select(F.explode("lfs").alias("lf"))
    there = loci.join(small, "lf", "left_semi").select("fam").distinct()
    return reconciled.where(F.col("n_mprs").cast("decimal(38,0)") > 1).select("fam").join(there, "fam", "left_semi")
