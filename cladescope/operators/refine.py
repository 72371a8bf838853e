"""Refinement: of a family's optimal histories the one that leaves the fewest islands among its neighbours."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cladescope.functions.island_merge import agglomerate, cost_difference
from cladescope.functions.reconcile import Costs, Reconciliation, best_rooting, split_by_origin
from cladescope.functions.trees import Tree, Unrooted, parse_newick, to_newick
from cladescope.operators.families import resolved


def near_loci(candidates: DataFrame, order: DataFrame, members: DataFrame, around: int) -> DataFrame:
    """fam, lfs: the locus families of origin families with a gene within ``around`` places of a candidate's.

    candidates: fam, gene; members: gene, lf, ofam, source_fam, mrca. Families made
    of the candidate itself don't count; windows stop at contig ends.
    """
    places = order.join(candidates, "gene").select("fam", "strain", "contig", F.explode(F.sequence(F.greatest(F.col("pos") - around, F.lit(0)), F.col("pos") + around)).alias("pos")).distinct()
    genes = places.join(order, ["strain", "contig", "pos"]).select("fam", "gene")
    near = genes.join(members.select("gene", "ofam", "source_fam"), "gene").where("source_fam != fam").select("fam", "ofam").distinct()
    lfs = members.groupBy("ofam", "lf", "mrca").agg(F.array_sort(F.collect_list(F.col("gene").cast("long"))).alias("genes"))
    return near.join(lfs, "ofam").groupBy("fam").agg(F.array_sort(F.collect_list(F.struct("lf", "mrca", "genes"))).alias("lfs"))


def near_pairs(candidates: DataFrame, loci: DataFrame, proximity: DataFrame, most: int) -> DataFrame:
    """fam, pairs: genes of a candidate and its neighbours within ``most`` places. proximity: g1, g2, distance."""
    own = candidates.select("fam", F.col("gene").cast("long").alias("gene"))
    other = loci.select("fam", F.explode("lfs").alias("l")).select("fam", F.explode("l.genes").alias("gene"))
    genes = own.unionByName(other).distinct()
    a, b = genes.select("fam", F.col("gene").alias("g1")), genes.select("fam", F.col("gene").alias("g2"))
    met = proximity.where(F.col("distance") <= most).join(a, "g1").join(b, ["fam", "g2"])
    return met.groupBy("fam").agg(F.collect_set(F.struct(F.col("g1").cast("long").alias("g1"), F.col("g2").cast("long").alias("g2"))).alias("pairs"))


def count_islands(species_tree: Tree, loci: list[tuple[int, str, list[int]]], pairs: list[tuple[int, int]], strain: dict[int, str], threshold: float = 0) -> int:
    """Islands of locus families (number, species node, genes) that merge wherever their genes lie together."""
    at = {g: (lf, mrca) for lf, mrca, genes in loci for g in genes}
    together: dict[tuple[int, int], dict[str, bool]] = {}
    for a, b in pairs:
        if a in at and b in at and at[a] != at[b] and at[a][1] == at[b][1] and strain.get(a) in species_tree.leaves(at[a][1]):
            together.setdefault((min(at[a][0], at[b][0]), max(at[a][0], at[b][0])), {})[strain[a]] = True
    nodes: dict[str, list[int]] = {}
    for lf, mrca, _ in loci:
        nodes.setdefault(mrca, []).append(lf)

    def at_node(mrca: str, lfs: list[int]) -> int:
        known: dict[tuple[int, int], int] = {}

        def difference(a: int, b: int) -> int:
            pair = (min(a, b), max(a, b))
            if pair not in known:
                known[pair] = cost_difference(species_tree, mrca, together.get(pair, {}))
            return known[pair]

        return len(agglomerate({x: [x] for x in sorted(lfs)}, difference, threshold))

    return sum(at_node(mrca, lfs) for mrca, lfs in nodes.items())


def refine(candidates: DataFrame, loci: DataFrame, pairs: DataFrame, strains: DataFrame, species_newick: str, costs: Costs = Costs(), most: int = 20, threshold: float = 0) -> DataFrame:
    """fam, n_islands, tree, events: for every candidate the optimal history with the fewest islands, the first of equals.

    candidates: fam, newick, genes array<struct<gene string, species string, locus long>>;
    loci and pairs as ``near_loci`` and ``near_pairs`` give them; strains: gene, strain. All
    optimal histories are tried if there are fewer than ``most``, else ``most`` drawn
    alike by a seed of the family's number. A candidate and its neighbours are one row.
    """
    around = loci.select("fam", F.explode("lfs").alias("l")).select("fam", F.explode("l.genes").alias("gene")).join(strains, "gene")
    around = around.groupBy("fam").agg(F.map_from_entries(F.collect_set(F.struct(F.col("gene").cast("long").alias("gene"), "strain"))).alias("strain"))
    rows = candidates.join(loci, "fam", "left").join(pairs, "fam", "left").join(around, "fam", "left")

    def run(batches):
        species_tree = parse_newick(species_newick)
        for batch in batches:
            out = []
            for fam, newick, genes, lfs, met, strain in zip(*(batch[c] for c in ("fam", "newick", "genes", "lfs", "pairs", "strain"))):
                species = {g["gene"]: g["species"] for g in genes}
                locus = {g["gene"]: int(g["locus"]) for g in genes}
                tree = resolved(parse_newick(newick, "g"), locus, len(species) < 3)
                found = Reconciliation(species_tree, tree, species, locus, costs) if len(species) < 3 else best_rooting(species_tree, Unrooted.of(tree), species, locus, costs)
                near = [(x["lf"], x["mrca"], list(x["genes"])) for x in (lfs if lfs is not None else [])]
                together = [(p["g1"], p["g2"]) for p in (met if met is not None else [])]
                where = dict(strain if strain is not None else {}) | {int(g): s for g, s in species.items()}
                free = max((lf for lf, *_ in near), default=0) + 1
                best = None
                for solution in found.solutions() if found.count() < most else found.drawn(most, int(fam)):
                    events = found.events_of(solution)
                    parts = [f for p in split_by_origin(found.G, events) for f in p["families"]]
                    own = [(free + i, f["species"], [int(g) for g in f["genes"]]) for i, f in enumerate(parts)]
                    n = count_islands(species_tree, near + own, together, where, threshold)
                    if best is None or n < best[0]:
                        best = (n, events)
                events = [{"gene_node": g, "nb": p, "ord": i, "event": e, "sp_node": x, "sp_nb": b, "locus": y} for i, (g, p, e, x, b, y) in enumerate(best[1])]
                out.append((fam, best[0], to_newick(found.G, lengths=False), events))
            yield pd.DataFrame(out, columns=["fam", "n_islands", "tree", "events"])

    schema = "fam long, n_islands int, tree string, events array<struct<gene_node:string,nb:string,ord:int,event:string,sp_node:string,sp_nb:string,locus:long>>"
    return rows.select("fam", "newick", "genes", "lfs", "pairs", "strain").mapInPandas(run, schema)
