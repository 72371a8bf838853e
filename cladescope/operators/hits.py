"""Pairwise similarity hits: filter, best hits, reciprocal best hits, ortholog cliques, identity."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def with_alignment(hits: DataFrame) -> DataFrame:
    """al_cov and al_len of a hit: ends minus starts over both sequences, without the closing position."""
    span = F.col("qend") - F.col("qstart") + F.col("send") - F.col("sstart")
    return hits.withColumns({"al_cov": span.cast("double") / (F.col("qlen") + F.col("slen")), "al_len": span.cast("double") / 2})


def filter_hits(hits: DataFrame, evalue: float = 1e-8, cover: float = 0.65, identity: float = 0.35) -> DataFrame:
    """Hits strictly beyond all three thresholds; identity is compared in the unit the hits carry."""
    return with_alignment(hits).where((F.col("evalue") < evalue) & (F.col("al_cov") > cover) & (F.col("pident") > identity))


def best_hits(hits: DataFrame, *carry: str) -> DataFrame:
    """Per query and strain pair the hit of the highest score; the first line wins ties."""
    best = F.max_by(F.struct("s", "score", *carry), F.struct("score", -F.col("line_no"))).alias("b")
    return hits.groupBy("strain_q", "strain_s", "q").agg(best).select("strain_q", "strain_s", "q", "b.*")


def best_hits_by_evalue(hits: DataFrame) -> DataFrame:
    """Per query the hit of the lowest e-value; the first line wins ties."""
    best = F.min_by(F.struct("s", "evalue"), F.struct("evalue", "line_no")).alias("b")
    return hits.groupBy("q").agg(best).select("q", "b.*")


def reciprocal_best(best: DataFrame, *carry: str) -> DataFrame:
    """Pairs that are each other's best hit; columns of the way back get the suffix _r."""
    back = best.select(F.col("strain_q").alias("strain_s"), F.col("strain_s").alias("strain_q"), F.col("q").alias("s"), F.col("s").alias("q"), *[F.col(c).alias(f"{c}_r") for c in ("score", *carry)])
    return best.join(back, ["strain_q", "strain_s", "q", "s"])


def all_around_best(rbh: DataFrame, strains: list) -> DataFrame:
    """Sets with one gene of every strain, all pairs of which are reciprocal best hits: grp, strain, gene.

    ``grp`` is the first strain's gene. A group is whole if it has a member of
    every other strain and none of its member pairs lacks a hit; the plan doesn't
    grow with the number of strains. Under two strains there is none.
    """
    pairs = rbh.select("strain_q", "strain_s", "q", "s").where("strain_q != strain_s").distinct()
    if len(strains) < 2:
        return pairs.select(F.col("q").alias("grp"), F.col("strain_q").alias("strain"), F.col("s").alias("gene")).limit(0)
    others = pairs.where(F.col("strain_q") == strains[0]).where(F.col("strain_s").isin(strains[1:])).select(F.col("q").alias("grp"), F.col("strain_s").alias("strain"), F.col("s").alias("gene"))
    sized = others.groupBy("grp").agg(F.count("*").alias("n")).where(F.col("n") == len(strains) - 1).select("grp")
    members = others.join(sized, "grp")
    a = members.select("grp", F.col("strain").alias("strain_q"), F.col("gene").alias("q"))
    b = members.select("grp", F.col("strain").alias("strain_s"), F.col("gene").alias("s"))
    met = a.join(b, "grp").where("strain_q < strain_s").join(pairs.withColumn("hit", F.lit(1)), ["strain_q", "strain_s", "q", "s"], "left")
    broken = met.where("hit is null").select("grp").distinct()
    whole = members.join(broken, "grp", "left_anti")
    first = whole.select("grp").distinct().select("grp", F.lit(strains[0]).alias("strain"), F.col("grp").alias("gene"))
    return first.unionByName(whole)


def identity(rbh: DataFrame, strains: DataFrame) -> DataFrame:
    """strain_q, strain_s, aai: identity over reciprocal best hits, weighted by alignment length of both ways.

    Pairs without a hit have 0, a strain with itself 100. ``rbh`` carries pident and al_len.
    """
    two = lambda c: F.col(c) + F.col(f"{c}_r")
    weighted = F.sum(F.col("pident") * F.col("al_len") + F.col("pident_r") * F.col("al_len_r")) / F.sum(two("al_len"))
    per = rbh.where("strain_q < strain_s").groupBy("strain_q", "strain_s").agg(weighted.alias("aai"))
    q, s = strains.select(F.col("strain").alias("strain_q")), strains.select(F.col("strain").alias("strain_s"))
    pairs = q.join(s, F.col("strain_q") <= F.col("strain_s"))
    value = F.when(F.col("strain_q") == F.col("strain_s"), F.lit(100.0)).otherwise(F.coalesce("aai", F.lit(0.0)))
    half = pairs.join(per, ["strain_q", "strain_s"], "left").select("strain_q", "strain_s", value.alias("aai"))
    return half.unionByName(half.where("strain_q < strain_s").select(F.col("strain_s").alias("strain_q"), F.col("strain_q").alias("strain_s"), "aai"))


def matrix(cells: DataFrame, row: str, column: str, value: str, columns: list) -> DataFrame:
    """A matrix with a row per ``row`` and a column m_<x> per x of ``columns``; missing cells are 0."""
    wide = cells.groupBy(row).pivot(column, columns).agg(F.first(value))
    return wide.select(row, *[F.coalesce(F.col(f"`{c}`"), F.lit(0.0)).alias(f"m_{c}") for c in columns])


def unmapped(genes: DataFrame, hits: DataFrame) -> DataFrame:
    """Genes without any hit."""
    return genes.join(hits.select(F.col("q").alias("gene")).distinct(), "gene", "left_anti")


def canonical(a: str | Column, b: str | Column) -> tuple[Column, Column]:
    """The pair in ascending order."""
    return F.least(a, b), F.greatest(a, b)


def edges(hits: DataFrame, score: str = "score") -> DataFrame:
    """g1 <= g2 and the best score of the two directions."""
    g1, g2 = canonical("q", "s")
    return hits.groupBy(g1.alias("g1"), g2.alias("g2")).agg(F.max(score).alias("raw_sc"))


def with_self_edges(pairs: DataFrame, genes: DataFrame) -> DataFrame:
    """Edges and one self edge per gene, without repeats."""
    own = genes.select(F.col("gene").alias("g1"), F.col("gene").alias("g2"), F.lit(None).cast(pairs.schema["raw_sc"].dataType).alias("raw_sc"))
    return pairs.unionByName(own).groupBy("g1", "g2").agg(F.max("raw_sc").alias("raw_sc"))


def adjacency(pairs: DataFrame) -> DataFrame:
    """node, neighbours: sorted, self edges left out."""
    both = pairs.where("g1 != g2").select(F.col("g1").alias("node"), F.col("g2").alias("other")).unionByName(pairs.where("g1 != g2").select(F.col("g2"), F.col("g1")).toDF("node", "other"))
    return both.groupBy("node").agg(F.array_sort(F.collect_set("other")).alias("neighbours"))


def distinct_pairs(edges: DataFrame) -> DataFrame:
    """g1, g2: every pair of genes once."""
    return edges.select("g1", "g2").distinct()


def degree(pairs: DataFrame) -> DataFrame:
    both = pairs.where("g1 != g2").select(F.explode(F.array("g1", "g2")).alias("node"))
    return both.groupBy("node").agg(F.count("*").alias("degree"))


def outside_connections(pairs: DataFrame, family: DataFrame) -> DataFrame:
    """fam, gene, other, raw_sc: edges from a family's genes to genes of no or another family."""
    both = pairs.select(F.col("g1").alias("gene"), F.col("g2").alias("other"), "raw_sc").unionByName(pairs.where("g1 != g2").select(F.col("g2").alias("gene"), F.col("g1").alias("other"), "raw_sc"))
    of = family.select(F.col("gene").alias("other"), F.col("fam").alias("other_fam"))
    return both.join(family.select("fam", "gene"), "gene").join(of, "other", "left").where(~F.col("fam").eqNullSafe(F.col("other_fam"))).select("fam", "gene", "other", "raw_sc")


def contained_sets(sets: DataFrame, family: DataFrame) -> DataFrame:
    """fam, grp of the ortholog sets all of whose genes are in the family."""
    size = sets.groupBy("grp").agg(F.count("*").alias("n"))
    held = sets.join(family, "gene").groupBy("fam", "grp").agg(F.count("*").alias("k"))
    return held.join(size, "grp").where("k = n").select("fam", "grp")


def straddled_sets(sets: DataFrame, family: DataFrame) -> DataFrame:
    """grp of the ortholog sets with genes in more than one family."""
    return sets.join(family, "gene").groupBy("grp").agg(F.countDistinct("fam").alias("n_fams")).where("n_fams > 1")
