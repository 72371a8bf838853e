"""Locus islands: locus families of one species node that arrived and moved together."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cladescope.functions.clusters import bounded_clusters
from cladescope.functions.island_merge import agglomerate, cost_difference
from cladescope.functions.trees import parse_newick


def near_families(members: DataFrame, proximity: DataFrame, most: int) -> DataFrame:
    """lf1 < lf2, strain, distance: families with genes within ``most`` places in a strain. members: lf, strain, gene."""
    a = members.select(F.col("gene").alias("g1"), F.col("lf").alias("x"), "strain")
    b = members.select(F.col("gene").alias("g2"), F.col("lf").alias("y"))
    met = proximity.where(F.col("distance") <= most).join(a, "g1").join(b, "g2").where("x != y")
    return met.groupBy(F.least("x", "y").alias("lf1"), F.greatest("x", "y").alias("lf2"), "strain").agg(F.min("distance").alias("distance"))


def make_islands(families: DataFrame, near: DataFrame, species_newick: str, merge_range: int = 1, cluster_range: int = 2, most: int = 50, threshold: float = 0) -> DataFrame:
    """id, mrca, lfs: islands at every species node. families: lf, mrca; near: lf1, lf2, strain, distance.

    A node's families are one group. They are clustered by ``cluster_range`` up to
    ``most`` (greedy, so one task), merged within the clusters, and the larger
    islands again over the node; families that were alone stay alone.
    """
    own = families.select(F.col("lf").alias("lf1"), F.col("mrca").alias("m1"))
    other = families.select(F.col("lf").alias("lf2"), F.col("mrca").alias("m2"))
    pairs = near.join(own, "lf1").join(other, "lf2").where("m1 = m2").select(F.col("m1").alias("mrca"), "lf1", "lf2", "strain", "distance")

    def build(key, lfs: pd.DataFrame, met: pd.DataFrame) -> pd.DataFrame:
        tree, mrca = parse_newick(species_newick), key[0]
        inside = set(tree.leaves(mrca)) if mrca in tree.children or mrca in tree.parent else {mrca}
        together: dict[tuple[int, int], dict[str, bool]] = {}
        linked: set[tuple[int, int]] = set()
        for a, b, strain, d in zip(met["lf1"], met["lf2"], met["strain"], met["distance"]):
            if strain in inside:
                if d <= merge_range:
                    together.setdefault((a, b), {})[strain] = True
                if d <= cluster_range:
                    linked.add((a, b))
        known: dict[tuple[int, int], int] = {}

        def difference(a: int, b: int) -> int:
            pair = (min(a, b), max(a, b))
            if pair not in known:
                known[pair] = cost_difference(tree, mrca, together.get(pair, {}))
            return known[pair]

        items = sorted(lfs["lf"].tolist())
        clusters = bounded_clusters(items, lambda a, b: (min(a, b), max(a, b)) in linked, most)
        out = {x: [x] for c in clusters if len(c) == 1 for x in c}
        larger: dict[int, list[int]] = {}
        for c in clusters:
            if len(c) > 1:
                larger |= agglomerate({x: [x] for x in sorted(c)}, difference, threshold)
        out |= agglomerate(larger, difference, threshold)
        return pd.DataFrame({"id": list(out), "mrca": mrca, "lfs": list(out.values())})

    return families.groupBy("mrca").cogroup(pairs.groupBy("mrca")).applyInPandas(build, "id long, mrca string, lfs array<long>")


def assignments(islands: DataFrame, loci: DataFrame, origins: DataFrame) -> DataFrame:
    """gene, island, ifam, ofam, lf. loci: lf, fam, gene; origins: fam, source_fam."""
    flat = islands.select(F.col("id").alias("island"), F.explode("lfs").alias("lf"))
    return loci.join(flat, "lf").join(origins.select("fam", "source_fam"), "fam", "left").select("gene", "island", F.col("source_fam").alias("ifam"), F.col("fam").alias("ofam"), "lf")


def by_id(islands: DataFrame, ids: DataFrame) -> DataFrame:
    """The first island of each id asked for (id), by its node and families; ids without one are left out."""
    found = islands.join(ids.distinct(), "id", "left_semi")
    return found.groupBy("id").agg(F.min(F.struct("mrca", "lfs")).alias("x")).select("id", "x.*")


def size_table(islands: DataFrame) -> DataFrame:
    """mrca, size, n of islands."""
    return islands.groupBy("mrca", F.size("lfs").alias("size")).agg(F.count("*").alias("n"))


def replaced(islands: DataFrame, new: DataFrame) -> DataFrame:
    """Islands with every node in ``new`` blanked and refilled."""
    return islands.join(new.select("mrca").distinct(), "mrca", "left_anti").unionByName(new)
