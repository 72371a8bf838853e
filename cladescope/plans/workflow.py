"""The whole workflow, stage by stage: each stage reads tables and makes one, in the shared folder.

Input tables: strains (strain_idx, strain), genes (gene, name, strain, chrom, start,
end, ...), order (strain, contig, pos, gene), sequences (gene, protein), hits.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cladescope.config import Params
from cladescope.functions.trees import parse_newick, require_bifurcating
from cladescope.operators import families, hits, islands, order, refine, scores, tree
from cladescope.operators.numbering import numbered
from cladescope.storage import shared_dir


@dataclass
class Workflow:
    spark: SparkSession
    inputs: dict[str, DataFrame]
    species: str
    params: Params = field(default_factory=Params)
    made: dict[str, DataFrame] = field(default_factory=dict)

    def __post_init__(self):
        self.tree = parse_newick(self.species)
        require_bifurcating(self.tree)

    def __getitem__(self, name: str) -> DataFrame:
        """An input, or the table of a stage, which is made at its first use."""
        if name in self.inputs:
            return self.inputs[name]
        if name not in self.made:
            path = f"{shared_dir(self.spark)}/{name}-{uuid.uuid4().hex}"
            STAGES[name](self).write.parquet(path)
            self.made[name] = self.spark.read.parquet(path)
        return self.made[name]

    @property
    def strains(self) -> list[str]:
        return [r.strain for r in self["strains"].orderBy("strain_idx").collect()]


STAGES: dict[str, Callable[[Workflow], DataFrame]] = {}


def stage(f: Callable[[Workflow], DataFrame]):
    STAGES[f.__name__] = f
    return f


@stage
def kept_hits(w: Workflow) -> DataFrame:
    return hits.filter_hits(w["hits"], w.params.evalue, w.params.align_cover, w.params.identity)


@stage
def reciprocal(w: Workflow) -> DataFrame:
    return hits.reciprocal_best(hits.best_hits(w["kept_hits"].where("strain_q != strain_s"), "pident", "al_len"), "pident", "al_len")


@stage
def identity(w: Workflow) -> DataFrame:
    return hits.identity(w["reciprocal"], w["strains"])


@stage
def orthologs(w: Workflow) -> DataFrame:
    return hits.all_around_best(w["reciprocal"], w.strains)


@stage
def raw_edges(w: Workflow) -> DataFrame:
    pairs = w["kept_hits"].where("q != s").select(F.least("q", "s").alias("g1"), F.greatest("q", "s").alias("g2")).distinct()
    one, two = (w["sequences"].select(F.col("gene").alias(g), F.col("protein").alias(s)) for g, s in (("g1", "seq1"), ("g2", "seq2")))
    return scores.raw_scores(pairs.join(one, "g1").join(two, "g2"))


@stage
def edges(w: Workflow) -> DataFrame:
    """g1, g2, s1, s2, raw_sc, syn_sc, core_syn_sc; the strain pair in the order of names."""
    p, raw = w.params, w["raw_edges"]
    syn = scores.synteny_scores(raw, order.synteny_neighbours(w["order"], p.synteny_window), raw, p.synteny_take)
    placed = w["order"].join(w["orthologs"].select("gene", F.col("grp").alias("core")), "gene", "left")
    core = scores.core_synteny_scores(raw, order.core_context(placed, p.core_window))
    of = lambda g, s: w["genes"].select(F.col("gene").alias(g), F.col("strain").alias(s))
    rows = raw.join(syn, ["g1", "g2"]).join(core, ["g1", "g2"]).join(of("g1", "a"), "g1").join(of("g2", "b"), "g2")
    return rows.select("g1", "g2", F.least("a", "b").alias("s1"), F.greatest("a", "b").alias("s2"), "raw_sc", "syn_sc", "core_syn_sc")


@stage
def thresholds(w: Workflow) -> DataFrame:
    """s1, s2, syn_thr, core_thr from the edges between members of one ortholog set."""
    p = w.params
    a, b = (w["orthologs"].select("grp", F.col("gene").alias(g)) for g in ("g1", "g2"))
    inside = w["edges"].join(a, "g1").join(b, ["grp", "g2"])
    of = lambda c, name: scores.quantile_thresholds(inside.select("s1", "s2", F.col(c).alias("score")), ["s1", "s2"], p.synteny_quantile, p.synteny_times).withColumnRenamed("threshold", name)
    return of("syn_sc", "syn_thr").join(of("core_syn_sc", "core_thr"), ["s1", "s2"])


@stage
def score_summary(w: Workflow) -> DataFrame:
    return scores.summary(w["edges"].withColumnRenamed("raw_sc", "score"), ["s1", "s2"])


@stage
def score_histogram(w: Workflow) -> DataFrame:
    return scores.histogram(w["edges"].withColumnRenamed("raw_sc", "score"), w.params.histogram_bins, by=("s1", "s2"))


@stage
def blast_families(w: Workflow) -> DataFrame:
    return families.blast_families(w["edges"], w["genes"], w.params.largest_blast_family * len(w.strains))


@stage
def gene_trees(w: Workflow) -> DataFrame:
    """fam, newick by neighbour joining on one minus the raw score; pairs without an edge are 1 apart."""
    fam = w["blast_families"]
    a, b = (fam.select("fam", F.col("gene").alias(x)) for x in "ab")
    near = w["edges"].select(F.col("g1").alias("a"), F.col("g2").alias("b"), F.greatest(1 - F.col("raw_sc"), F.lit(0.0)).alias("d"))
    far = a.join(b, "fam").where("a < b").join(near, ["a", "b"], "left").select("fam", "a", "b", F.coalesce("d", F.lit(1.0)).alias("dist"))
    return families.gene_trees(far, fam)


@stage
def initial_families(w: Workflow) -> DataFrame:
    """fam, newick, genes (gene, species, locus): split gene trees, with their locus families' numbers as locations."""
    p = w.params
    sets = w["orthologs"].join(w["blast_families"], "gene").select("fam", "grp", F.col("gene").cast("string").alias("gene"))
    whole = sets.groupBy("fam", "grp").agg(F.count("*").alias("n")).where(F.col("n") == len(w.strains)).select("fam").distinct()
    longest = families.split_threshold(w["gene_trees"].join(whole, "fam", "left_semi"), p.split_quantile, p.split_times)
    parts = families.initial_families(w["gene_trees"], sets, longest, p.largest_initial_family * len(w.strains), p.forced_split_balance)
    parts = numbered(parts.withColumnRenamed("fam", "whole"), [F.desc(F.size("genes")), F.col("whole"), F.col("part")], "fam")
    return parts.select("fam", "newick", "genes")


@stage
def loci(w: Workflow) -> DataFrame:
    """lf, fam, gene: single linkage of same-locus edges within initial families."""
    own = w["initial_families"].select("fam", F.explode("genes").alias("g")).select("fam", F.col("g").cast("long").alias("gene"))
    return families.single_linkage(scores.same_locus(w["edges"], w["thresholds"]), own)


@stage
def reconciled(w: Workflow) -> DataFrame:
    gene = w["loci"].join(w["genes"].select("gene", F.col("strain").alias("species")), "gene")
    listed = gene.groupBy("fam").agg(F.array_sort(F.collect_list(F.struct(F.col("gene").cast("string").alias("gene"), "species", F.col("lf").alias("locus")))).alias("genes"))
    return families.reconcile(w["initial_families"].select("fam", "newick").join(listed, "fam"), w.species, w.params.costs)


@stage
def events(w: Workflow) -> DataFrame:
    return families.recon_events(w["reconciled"])


def _origins(w: Workflow, reconciled: DataFrame) -> DataFrame:
    rows = [(n, p) for n, p, _ in w.tree.rows()]
    paths = tree.closure(w.spark.createDataFrame(rows, "node string, parent string"))
    found = numbered(families.origin_families(reconciled), ["source_fam", "root"], "fam")
    return families.classify(found, paths, w.params.focal_root or w.tree.root)


def _locus_families(origins: DataFrame) -> DataFrame:
    flat = origins.select("fam", F.posexplode("families").alias("i", "f")).select("fam", "i", "f.*")
    return numbered(flat, ["fam", "i"], "lf").select("lf", "fam", F.col("species").alias("mrca"), "origin", F.col("genes").cast("array<long>").alias("genes"))


def _locus_islands(w: Workflow, locus_families: DataFrame) -> DataFrame:
    p = w.params
    member = locus_families.select("lf", F.explode("genes").alias("gene")).join(w["genes"].select("gene", "strain"), "gene")
    near = islands.near_families(member, order.proximity(w["order"], p.proximity_range), p.proximity_range)
    return islands.make_islands(locus_families.select("lf", "mrca"), near, w.species, p.proximity_merge, p.proximity_range, p.cluster_size, p.merge_threshold)


@stage
def origins(w: Workflow) -> DataFrame:
    """fam, source_fam, mrca, class, genes, histories, families: origin families, classed by the focal clade."""
    return _origins(w, w["reconciled"])


@stage
def locus_families(w: Workflow) -> DataFrame:
    """lf, fam, mrca, origin, genes."""
    return _locus_families(w["origins"])


@stage
def locus_islands(w: Workflow) -> DataFrame:
    return _locus_islands(w, w["locus_families"])


@stage
def assignments(w: Workflow) -> DataFrame:
    """gene, island, ifam, ofam, lf, class, history."""
    member = w["locus_families"].select("lf", "fam", F.explode("genes").alias("gene"))
    found = islands.assignments(w["locus_islands"], member, w["origins"])
    history = w["origins"].select("class", F.explode("histories").alias("h")).select("class", F.col("h.gene").cast("long").alias("gene"), "h.history")
    return found.join(history, "gene", "left")


@stage
def refine_candidates(w: Workflow) -> DataFrame:
    """fam of the families whose other optimal histories may give fewer islands."""
    of = w["locus_families"].join(w["origins"].select("fam", "source_fam"), "fam").select("lf", F.col("source_fam").alias("fam"))
    return families.refine_candidates(w["reconciled"], w["locus_islands"], of, w.params.refine_island)


@stage
def refined_histories(w: Workflow) -> DataFrame:
    """fam, n_islands, tree, events: of every candidate the optimal history that leaves the fewest islands around it."""
    p = w.params
    source = w["origins"].select(F.col("fam").alias("ofam"), "source_fam")
    member = w["locus_families"].select("lf", F.col("fam").alias("ofam"), "mrca", F.explode("genes").alias("gene")).join(source, "ofam")
    gene = w["loci"].join(w["genes"].select("gene", F.col("strain").alias("species")), "gene").join(w["refine_candidates"], "fam", "left_semi")
    own = gene.select("fam", "gene")
    listed = gene.groupBy("fam").agg(F.array_sort(F.collect_list(F.struct(F.col("gene").cast("string").alias("gene"), "species", F.col("lf").alias("locus")))).alias("genes"))
    asked = w["initial_families"].select("fam", "newick").join(listed, "fam")
    loci = refine.near_loci(own, w["order"], member, p.refine_range)
    pairs = refine.near_pairs(own, loci, order.proximity(w["order"], p.proximity_merge), p.proximity_merge)
    return refine.refine(asked, loci, pairs, w["genes"].select("gene", "strain"), w.species, p.costs, p.refine_solutions, p.merge_threshold)


@stage
def refined(w: Workflow) -> DataFrame:
    """``reconciled`` with the histories that refinement chose."""
    new = w["refined_histories"].select("fam", F.col("tree").alias("new_tree"), F.col("events").alias("new_events"))
    rows = w["reconciled"].join(new, "fam", "left").withColumns({"tree": F.coalesce("new_tree", "tree"), "events": F.coalesce("new_events", "events")})
    return rows.drop("new_tree", "new_events")


@stage
def refined_origins(w: Workflow) -> DataFrame:
    return _origins(w, w["refined"])


@stage
def refined_locus_families(w: Workflow) -> DataFrame:
    return _locus_families(w["refined_origins"])


@stage
def refined_islands(w: Workflow) -> DataFrame:
    return _locus_islands(w, w["refined_locus_families"])
