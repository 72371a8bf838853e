"""Registered queries over the driver's tables, and their SQL."""

from __future__ import annotations

import importlib
from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cladescope.functions.island_merge import merged
from cladescope.functions.reconcile import Costs
from cladescope.operators import families, graph, hits, islands, order, reports, scores, tree
from cladescope.plans import adapters as A

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    """Register a query, with its SQL where SQL can express it."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return add


def _filtered(spark, d):
    return hits.filter_hits(A.hits(spark, d))


def _best(spark, d):
    return hits.best_hits(_filtered(spark, d), "pident", "al_len")


def _rbh(spark, d):
    return hits.reciprocal_best(_best(spark, d), "pident", "al_len").where("strain_q != strain_s")


def _edges(spark, d):
    return hits.edges(_filtered(spark, d))


_RBH_SQL = f"""SELECT a.*, b.score AS score_r, b.pident AS pident_r, b.al_len AS al_len_r FROM ({A.BEST_SQL}) a JOIN ({A.BEST_SQL}) b
  ON a.q = b.s AND a.s = b.q AND a.strain_q = b.strain_s AND a.strain_s = b.strain_q WHERE a.strain_q != a.strain_s"""
_EDGES_SQL = f"SELECT least(q, s) AS g1, greatest(q, s) AS g2, max(score) AS raw_sc FROM ({A.FILTERED_SQL}) GROUP BY ALL"
_LINKED_SQL = f"SELECT g1, g2 FROM ({_EDGES_SQL}) WHERE raw_sc > 140"


@query(f"SELECT strain_q, strain_s, q, s, score, al_cov, al_len FROM ({A.FILTERED_SQL})")
def hit_filter(spark, d):
    return _filtered(spark, d).select("strain_q", "strain_s", "q", "s", "score", "al_cov", "al_len")


@query(f"SELECT strain_q, strain_s, q, s, score FROM ({A.BEST_SQL})")
def best_hits(spark, d):
    return _best(spark, d).select("strain_q", "strain_s", "q", "s", "score")


@query(f"SELECT q, s, evalue FROM (SELECT *, row_number() OVER (PARTITION BY q ORDER BY evalue, line_no) AS rn FROM ({A.HITS_SQL})) WHERE rn = 1")
def best_hits_by_evalue(spark, d):
    return hits.best_hits_by_evalue(A.hits(spark, d))


@query(f"SELECT strain_q, strain_s, q, s, score, score_r FROM ({_RBH_SQL})")
def reciprocal_best_hits(spark, d):
    return _rbh(spark, d).select("strain_q", "strain_s", "q", "s", "score", "score_r")


@query(f"""WITH r AS (SELECT strain_q, strain_s, q, s FROM ({_RBH_SQL})), g AS (SELECT a.q AS grp, a.s AS g1, b.s AS g2 FROM r a JOIN r b ON a.q = b.q
   WHERE a.strain_q = 0 AND a.strain_s = 1 AND b.strain_s = 2 AND EXISTS (SELECT 1 FROM r c WHERE c.q = a.s AND c.s = b.s))
 SELECT grp, 0::BIGINT AS strain, grp AS gene FROM g UNION ALL SELECT grp, 1, g1 FROM g UNION ALL SELECT grp, 2, g2 FROM g""")
def all_around_best_hits(spark, d):
    return hits.all_around_best(_rbh(spark, d), [0, 1, 2])


_AAI_SQL = f"""WITH p AS (SELECT strain_q, strain_s, sum(pident * al_len + pident_r * al_len_r) / sum(al_len + al_len_r) AS aai FROM ({_RBH_SQL}) GROUP BY ALL),
  s AS (SELECT DISTINCT p_partkey % 4 AS strain FROM part)
 SELECT a.strain AS strain_q, b.strain AS strain_s, round(CASE WHEN a.strain = b.strain THEN 100.0::DOUBLE ELSE coalesce((SELECT aai FROM p WHERE p.strain_q = least(a.strain, b.strain) AND p.strain_s = greatest(a.strain, b.strain)), 0.0::DOUBLE) END, 6) AS aai
 FROM s a CROSS JOIN s b"""


@query(_AAI_SQL)
def amino_acid_identity(spark, d):
    strains = A.genes(spark, d).select("strain").distinct()
    return hits.identity(_rbh(spark, d), strains).withColumn("aai", F.round("aai", 6))


@query(f"SELECT strain_q, max(CASE WHEN strain_s = 0 THEN aai END) AS m_0, max(CASE WHEN strain_s = 1 THEN aai END) AS m_1, max(CASE WHEN strain_s = 2 THEN aai END) AS m_2, max(CASE WHEN strain_s = 3 THEN aai END) AS m_3 FROM ({_AAI_SQL}) GROUP BY strain_q")
def identity_matrix(spark, d):
    return hits.matrix(amino_acid_identity(spark, d), "strain_q", "strain_s", "aai", [0, 1, 2, 3])


@query(_EDGES_SQL)
def canonical_edges(spark, d):
    return _edges(spark, d)


@query(f"SELECT g1, g2, max(raw_sc) AS raw_sc FROM (SELECT * FROM ({_EDGES_SQL}) UNION ALL SELECT p_partkey, p_partkey, NULL FROM part) GROUP BY ALL")
def edges_with_self(spark, d):
    return hits.with_self_edges(_edges(spark, d), A.genes(spark, d))


@query(f"SELECT node, count(*) AS degree FROM (SELECT g1 AS node FROM ({_EDGES_SQL}) UNION ALL SELECT g2 FROM ({_EDGES_SQL})) GROUP BY node")
def edge_degree(spark, d):
    return hits.degree(_edges(spark, d))


@query(f"SELECT node, string_agg(o::VARCHAR, ',' ORDER BY o) AS neighbours FROM (SELECT g1 AS node, g2 AS o FROM ({_EDGES_SQL}) UNION ALL SELECT g2, g1 FROM ({_EDGES_SQL})) GROUP BY node")
def edge_adjacency(spark, d):
    return hits.adjacency(_edges(spark, d)).select("node", F.array_join(F.col("neighbours").cast("array<string>"), ",").alias("neighbours"))


@query(f"SELECT p_partkey AS gene, p_partkey % 4 AS strain FROM part WHERE p_partkey NOT IN (SELECT q FROM ({A.FILTERED_SQL}))")
def unmapped_genes(spark, d):
    return hits.unmapped(A.genes(spark, d), _filtered(spark, d))


def _linked(spark, d):
    return _edges(spark, d).where("raw_sc > 140")


_CC_SQL = f"""WITH RECURSIVE e AS ({_LINKED_SQL}), b AS (SELECT g1 AS u, g2 AS v FROM e UNION SELECT g2, g1 FROM e UNION SELECT p_partkey, p_partkey FROM part),
 r AS (SELECT u, v FROM b UNION SELECT r.u, b.v FROM r JOIN b ON r.v = b.u) SELECT u AS node, min(v) AS component FROM r GROUP BY u"""


@query(_CC_SQL)
def connected_components(spark, d):
    own = A.genes(spark, d).select(F.col("gene").alias("g1"), F.col("gene").alias("g2"))
    return graph.connected_components(_linked(spark, d).select("g1", "g2").unionByName(own), "g1", "g2")


_FAM_SQL = f"""WITH c AS ({_CC_SQL}), n AS (SELECT component, count(*) AS n FROM c GROUP BY component),
 f AS (SELECT component, row_number() OVER (ORDER BY n DESC, component) AS fam FROM n) SELECT fam, node AS gene FROM c JOIN f USING (component)"""


@query(_FAM_SQL)
def blast_families(spark, d):
    return families.blast_families(_linked(spark, d), A.genes(spark, d))


@query()
def capped_families(spark, d):
    return families.blast_families(_linked(spark, d), A.genes(spark, d), cap=8)


@query(f"""WITH RECURSIVE f AS ({_FAM_SQL}), e AS (SELECT g1, g2 FROM ({_EDGES_SQL}) JOIN f a ON a.gene = g1 JOIN f b ON b.gene = g2 WHERE a.fam = b.fam AND raw_sc > 170),
 b AS (SELECT g1 AS u, g2 AS v FROM e UNION SELECT g2, g1 FROM e UNION SELECT gene, gene FROM f), r AS (SELECT u, v FROM b UNION SELECT r.u, b.v FROM r JOIN b ON r.v = b.u),
 c AS (SELECT u AS gene, min(v) AS component FROM r GROUP BY u), k AS (SELECT fam, component, row_number() OVER (ORDER BY fam, component) AS lf FROM (SELECT DISTINCT fam, component FROM c JOIN f USING (gene)))
 SELECT lf, fam, gene FROM c JOIN f USING (gene) JOIN k USING (fam, component)""")
def single_linkage_families(spark, d):
    return families.single_linkage(_edges(spark, d).where("raw_sc > 170"), blast_families(spark, d).checkpoint())


_FAMILY_SQL = "SELECT p_partkey AS gene, p_partkey % 97 AS fam FROM part WHERE p_size > 17"


def _family(spark, d):
    """Families of the larger parts; the others are in none."""
    return A.table(spark, d, "part").where("p_size > 17").select(F.col("p_partkey").alias("gene"), (F.col("p_partkey") % 97).alias("fam"))


@query(f"""WITH e AS ({_EDGES_SQL}), f AS ({_FAMILY_SQL}), b AS (SELECT g1 AS gene, g2 AS other, raw_sc FROM e UNION ALL SELECT g2, g1, raw_sc FROM e)
 SELECT f.fam, b.gene, b.other, b.raw_sc FROM b JOIN f ON f.gene = b.gene LEFT JOIN f o ON o.gene = b.other WHERE f.fam IS DISTINCT FROM o.fam""")
def outside_connections(spark, d):
    return hits.outside_connections(_edges(spark, d), _family(spark, d))


_SETS_SQL = "SELECT l_orderkey AS grp, l_partkey AS gene FROM lineitem GROUP BY ALL"


def _sets(spark, d):
    return A.table(spark, d, "lineitem").select(F.col("l_orderkey").alias("grp"), F.col("l_partkey").alias("gene")).distinct()


@query(f"""WITH s AS ({_SETS_SQL}), f AS (SELECT p_partkey AS gene, p_size % 3 AS fam FROM part), n AS (SELECT grp, count(*) AS n FROM s GROUP BY grp)
 SELECT fam, grp FROM (SELECT fam, grp, count(*) AS k FROM s JOIN f USING (gene) GROUP BY ALL) JOIN n USING (grp) WHERE k = n""")
def contained_sets(spark, d):
    fam = A.table(spark, d, "part").select(F.col("p_partkey").alias("gene"), (F.col("p_size") % 3).alias("fam"))
    return hits.contained_sets(_sets(spark, d), fam)


@query(f"SELECT grp, count(DISTINCT p_size % 3) AS n_fams FROM ({_SETS_SQL}) JOIN part ON p_partkey = gene GROUP BY grp HAVING count(DISTINCT p_size % 3) > 1")
def straddled_sets(spark, d):
    fam = A.table(spark, d, "part").select(F.col("p_partkey").alias("gene"), (F.col("p_size") % 3).alias("fam"))
    return hits.straddled_sets(_sets(spark, d), fam)


_text = lambda c: F.array_join(F.col(c).cast("array<string>"), ",").alias(c)


@query(f"""WITH o AS ({A.ORDER_SQL}) SELECT o.gene, coalesce(string_agg(p.gene::VARCHAR, ',' ORDER BY p.pos), '') AS neighbours
 FROM o LEFT JOIN o p ON o.contig = p.contig AND p.pos BETWEEN o.pos - 4 AND o.pos + 3 AND p.pos != o.pos GROUP BY o.gene""")
def synteny_neighbours(spark, d):
    return order.synteny_neighbours(A.gene_order(spark, d), 8).select("gene", _text("neighbours"))


@query(f"""WITH o AS ({A.ORDER_SQL}) SELECT least(a.gene, b.gene) AS g1, greatest(a.gene, b.gene) AS g2, (b.pos - a.pos)::INT AS distance
 FROM o a JOIN o b ON a.contig = b.contig AND b.pos - a.pos BETWEEN 1 AND 2""")
def gene_proximity(spark, d):
    return order.proximity(A.gene_order(spark, d), 2)


_CONTEXT_SQL = f"""WITH o AS ({A.ORDER_SQL}), f AS (SELECT a.gene, c.core, row_number() OVER (PARTITION BY a.gene ORDER BY c.pos) AS k FROM o a JOIN o c ON a.contig = c.contig AND c.core IS NOT NULL AND c.pos > a.pos),
 b AS (SELECT a.gene, c.core, row_number() OVER (PARTITION BY a.gene ORDER BY c.pos DESC) AS k FROM o a JOIN o c ON a.contig = c.contig AND c.core IS NOT NULL AND c.pos < a.pos),
 u AS (SELECT gene, core, k FROM f WHERE k <= 3 UNION ALL SELECT gene, core, k + 3 FROM b WHERE k <= 3)
 SELECT o.gene, list(u.core ORDER BY u.k) FILTER (u.core IS NOT NULL) AS context FROM o LEFT JOIN u USING (gene) GROUP BY o.gene"""


@query(f"SELECT gene, coalesce(array_to_string(context, ','), '') AS context FROM ({_CONTEXT_SQL})")
def core_context(spark, d):
    return order.core_context(A.gene_order(spark, d), 6).select("gene", _text("context"))


@query(f"""WITH c AS ({_CONTEXT_SQL}), p AS (SELECT DISTINCT event_id AS g1, (event_id * 7 + 3) % (SELECT max(event_id) + 1 FROM events) AS g2 FROM events)
 SELECT g1, g2, round(CASE WHEN greatest(coalesce(len(x.context), 0), coalesce(len(y.context), 0)) = 0 THEN 0.0::DOUBLE
   ELSE coalesce(len(list_intersect(x.context, y.context)), 0)::DOUBLE / greatest(coalesce(len(x.context), 0), coalesce(len(y.context), 0)) END, 9) AS core_syn_sc
 FROM p JOIN c x ON x.gene = g1 JOIN c y ON y.gene = g2""")
def core_synteny_scores(spark, d):
    e = A.table(spark, d, "events").select("event_id")
    top = e.agg(F.max("event_id")).first()[0] or 0
    pairs = e.select(F.col("event_id").alias("g1"), ((F.col("event_id") * 7 + 3) % (top + 1)).alias("g2")).distinct()
    found = scores.core_synteny_scores(pairs, order.core_context(A.gene_order(spark, d), 6))
    return found.withColumn("core_syn_sc", F.round("core_syn_sc", 9))


@query(f"""WITH o AS ({A.ORDER_SQL}) SELECT t.gene AS target, n.gene FROM o t JOIN o n ON t.contig = n.contig AND abs(n.pos - t.pos) <= 4
 WHERE t.core IS NOT NULL AND n.core IS NULL""")
def nearby_genes(spark, d):
    o = A.gene_order(spark, d)
    return order.nearby(o, o.where("core is not null"), 4)


@query(f"""WITH o AS ({A.ORDER_SQL}), i AS (SELECT *, contig AS island FROM o WHERE core IS NOT NULL), g AS (SELECT island, strain, contig, min(pos) - 2 AS a, max(pos) + 2 AS b FROM i GROUP BY ALL)
 SELECT g.island, g.strain, o.gene FROM g JOIN o ON o.contig = g.contig AND o.pos BETWEEN a AND b""")
def island_neighbourhood(spark, d):
    o = A.gene_order(spark, d)
    return order.island_neighbourhood(o, o.where("core is not null").select(F.col("contig").alias("island"), "gene"), 2)


@query("SELECT o_custkey AS gene, (o_custkey // 100) AS strain FROM orders WHERE o_custkey <= (SELECT max(c_custkey) FROM customer) GROUP BY ALL")
def strain_by_range(spark, d):
    ranges = A.table(spark, d, "customer").groupBy(F.floor(F.col("c_custkey") / 100).alias("strain")).agg(F.min(F.floor(F.col("c_custkey") / 100) * 100).alias("first"), (F.max(F.floor(F.col("c_custkey") / 100)) * 100 + 99).alias("last"))
    numbers = A.table(spark, d, "orders").select(F.col("o_custkey").alias("gene")).distinct()
    top = A.table(spark, d, "customer").agg(F.max("c_custkey")).first()[0] or 0
    return order.strain_of(numbers.where(F.col("gene") <= top), ranges)


@query("SELECT p_partkey % 4 AS strain, min(p_partkey) AS first, max(p_partkey) AS last FROM part GROUP BY 1")
def strain_ranges(spark, d):
    return order.strain_ranges(A.genes(spark, d))


@query("SELECT user_id, count(*) FILTER (event_type = before) AS n_same FROM (SELECT user_id, event_type, lag(event_type) OVER (PARTITION BY user_id ORDER BY event_id) AS before FROM events) GROUP BY user_id")
def same_as_previous(spark, d):
    return order.same_as_previous(A.table(spark, d, "events"), "user_id", "event_id", "event_type")


@query("SELECT s1, s2, round(quantile_cont(score, 0.1) * 0.5, 9) AS threshold FROM (SELECT l_returnflag AS s1, l_linestatus AS s2, l_extendedprice::DOUBLE AS score FROM lineitem) GROUP BY ALL")
def synteny_thresholds(spark, d):
    rows = A.table(spark, d, "lineitem").select(F.col("l_returnflag").alias("s1"), F.col("l_linestatus").alias("s2"), F.col("l_extendedprice").alias("score"))
    return scores.quantile_thresholds(rows, ["s1", "s2"]).withColumn("threshold", F.round("threshold", 9))


@query("""WITH e AS (SELECT l_partkey AS g1, l_suppkey AS g2, l_returnflag AS s1, l_linestatus AS s2, l_discount::DOUBLE AS syn_sc, l_quantity::DOUBLE AS core_syn_sc, l_orderkey FROM lineitem),
 t AS (SELECT s1, s2, quantile_cont(syn_sc, 0.1) * 0.5 AS a, quantile_cont(core_syn_sc, 0.1) * 0.5 AS b FROM e GROUP BY ALL)
 SELECT s1, s2, g1, g2, l_orderkey, syn_sc, core_syn_sc FROM e JOIN t USING (s1, s2) WHERE core_syn_sc >= b AND syn_sc >= a""")
def same_locus_edges(spark, d):
    e = A.table(spark, d, "lineitem").select(F.col("l_partkey").alias("g1"), F.col("l_suppkey").alias("g2"), F.col("l_returnflag").alias("s1"), F.col("l_linestatus").alias("s2"), F.col("l_discount").alias("syn_sc"), F.col("l_quantity").alias("core_syn_sc"), "l_orderkey")
    of = lambda c, name: scores.quantile_thresholds(e.withColumnRenamed(c, "score"), ["s1", "s2"]).withColumnRenamed("threshold", name)
    return scores.same_locus(e, of("syn_sc", "syn_thr").join(of("core_syn_sc", "core_thr"), ["s1", "s2"])).select("s1", "s2", "g1", "g2", "l_orderkey", "syn_sc", "core_syn_sc")


@query("SELECT s1, count(score) AS n, round(avg(score), 6) AS mean, round(stddev_samp(score), 6) AS sd FROM (SELECT c_mktsegment AS s1, c_acctbal::DOUBLE AS score FROM customer) GROUP BY s1")
def score_summary(spark, d):
    rows = A.table(spark, d, "customer").select(F.col("c_mktsegment").alias("s1"), F.col("c_acctbal").alias("score"))
    return scores.summary(rows, ["s1"]).withColumns({"mean": F.round("mean", 6), "sd": F.round("sd", 6)})


@query("""WITH v AS (SELECT l_discount::DOUBLE * 8 AS score FROM lineitem WHERE l_discount * 8 BETWEEN 0 AND 1), b AS (SELECT least(floor((score - 0) * 80 / (1.0::DOUBLE - 0)), 79)::INT AS bin, count(*) AS n FROM v GROUP BY 1)
 SELECT bin, n, round(n / ((SELECT count(*) FROM v) * (1.0::DOUBLE / 80)), 9) AS density FROM b""")
def score_histogram(spark, d):
    rows = A.table(spark, d, "lineitem").select((F.col("l_discount") * 8).alias("score"))
    return scores.histogram(rows).withColumn("density", F.round("density", 9))


@query()
def homolog_peaks(spark, d):
    rows = A.table(spark, d, "lineitem").select("l_returnflag", F.col("l_discount").alias("score"))
    bins = scores.histogram(rows, low=None, high=None, by=("l_returnflag",))

    def check(frame: pd.DataFrame) -> pd.DataFrame:
        height = [0.0] * 80
        for b, x in zip(frame["bin"], frame["density"]):
            height[b] = x
        centres = [(i + 0.5) / 80 for i in range(81)]
        return pd.DataFrame({"l_returnflag": frame["l_returnflag"].iloc[:1], "peak": [scores.has_homolog_peak(height, centres)]})

    return bins.groupBy("l_returnflag").applyInPandas(check, "l_returnflag string, peak boolean")


@query(A.CLOSURE_SQL.replace("SELECT * FROM c", 'SELECT anc, "desc", depth, dist FROM c'))
def tree_closure(spark, d):
    return tree.closure(A.tree(spark, d))


def _paths(spark, d):
    return tree.closure(A.tree(spark, d))


@query(f"""WITH c AS (SELECT * FROM ({A.CLOSURE_SQL})), t AS ({A.TREE_SQL}), l AS (SELECT node FROM t WHERE node NOT IN (SELECT parent FROM t WHERE parent IS NOT NULL))
 SELECT anc AS node, count(*) AS n_leaves FROM c JOIN l ON l.node = c."desc" GROUP BY anc""")
def leaf_counts(spark, d):
    return tree.leaf_counts(A.tree(spark, d), _paths(spark, d))


@query(f"""SELECT "desc" AS node, string_agg(anc, ',' ORDER BY depth) AS ancestors FROM ({A.CLOSURE_SQL}) WHERE depth > 0 GROUP BY 1""")
def ancestors(spark, d):
    return tree.ancestors(_paths(spark, d)).select("node", _text("ancestors"))


_GROUPS_SQL = "SELECT DISTINCT l_orderkey AS grp, 's' || l_suppkey AS node FROM lineitem"


@query(f"""WITH c AS (SELECT * FROM ({A.CLOSURE_SQL})), s AS ({_GROUPS_SQL}), n AS (SELECT grp, count(*) AS n FROM s GROUP BY grp), v AS (SELECT "desc" AS anc, max(depth) AS lv FROM c GROUP BY 1),
 o AS (SELECT grp, anc, count(*) AS k FROM s JOIN c ON c."desc" = s.node GROUP BY ALL) SELECT grp, arg_max(anc, lv) AS mrca FROM o JOIN n USING (grp) JOIN v USING (anc) WHERE k = n GROUP BY grp""")
def common_ancestors(spark, d):
    groups = A.table(spark, d, "lineitem").select(F.col("l_orderkey").alias("grp"), F.concat(F.lit("s"), "l_suppkey").alias("node")).distinct()
    return tree.common_ancestor(_paths(spark, d), groups)


@query(f"""WITH t AS ({A.TREE_SQL}), l AS (SELECT * FROM t WHERE node NOT IN (SELECT parent FROM t WHERE parent IS NOT NULL)), c AS (SELECT * FROM ({A.CLOSURE_SQL}))
 SELECT a.node AS leaf, b.node AS neighbour FROM l a JOIN c ON c.anc = a.parent JOIN l b ON b.node = c."desc" WHERE a.node != b.node""")
def nearest_neighbours(spark, d):
    return tree.nearest_neighbours(A.tree(spark, d), _paths(spark, d))


@query(f"""SELECT t.node, CASE WHEN t.node != 'r1' THEN t.parent END AS parent, t.branch_len FROM ({A.TREE_SQL}) t JOIN (SELECT * FROM ({A.CLOSURE_SQL})) c ON c."desc" = t.node AND c.anc = 'r1'""")
def subtree(spark, d):
    return tree.subtree(A.tree(spark, d), _paths(spark, d), "r1")


@query("SELECT p_partkey, p_name FROM part WHERE contains(p_name, 'a') OR contains(p_brand, '#1') OR contains(p_type, 'TIN')")
def gene_search(spark, d):
    rows = A.table(spark, d, "part")
    found = [reports.search(rows, [f], t) for f, t in (("p_name", "a"), ("p_brand", "#1"), ("p_type", "TIN"))]
    return found[0].union(found[1]).union(found[2]).select("p_partkey", "p_name").distinct()


@query(f"SELECT mrca, len(lfs)::INT AS size, count(*) AS n FROM ({A.ISLANDS_SQL}) GROUP BY ALL")
def island_sizes(spark, d):
    return islands.size_table(A.islands(spark, d))


@query(f"""WITH i AS ({A.ISLANDS_SQL}), p AS (SELECT a.id, a.lfs AS x, b.lfs AS y, (a.id % 4)::INT AS o FROM i a JOIN i b ON b.id = a.id + 1)
 SELECT id, o, array_to_string(CASE o WHEN 0 THEN x || y WHEN 1 THEN x || list_reverse(y) WHEN 2 THEN list_reverse(y) || x ELSE y || x END, ',') AS lfs FROM p""")
def merged_islands(spark, d):
    i = A.islands(spark, d)
    pairs = i.select("id", F.col("lfs").alias("x")).join(i.select((F.col("id") - 1).alias("id"), F.col("lfs").alias("y")), "id").withColumn("o", (F.col("id") % 4).cast("int"))

    def run(batches):
        for batch in batches:
            yield batch[["id", "o"]].assign(lfs=[",".join(map(str, merged(list(x), list(y), o))) for x, y, o in zip(batch["x"], batch["y"], batch["o"])])

    return pairs.mapInPandas(run, "id long, o int, lfs string")


@query(f"SELECT id, mrca, array_to_string(lfs, ',') AS lfs FROM ({A.ISLANDS_SQL}) WHERE mrca NOT IN ('n3', 'n4') UNION ALL SELECT id, 'n3', array_to_string(lfs, ',') FROM ({A.ISLANDS_SQL}) WHERE mrca = 'n4'")
def replaced_islands(spark, d):
    i = A.islands(spark, d)
    new = i.where("mrca = 'n4'").withColumn("mrca", F.lit("n3"))
    kept = islands.replaced(i.where("mrca != 'n4'"), new)
    return kept.select("id", "mrca", _text("lfs"))


@query("SELECT event_type AS event, count(*) AS n FROM events GROUP BY 1")
def event_counts(spark, d):
    return families.event_counts(A.table(spark, d, "events").withColumnRenamed("event_type", "event"))


SPECIES = "(((A:1,B:1)s2:1,C:2)s1:1,D:3)s0;"


def _recon_input(spark, d):
    """Small families of parts bought together: one gene per strain letter and part, trees by neighbour joining.

    Rows are dealt by family once, to a given number of tasks: what is done with a family takes far longer than its bytes tell.
    """
    o = A.table(spark, d, "lineitem").select(F.col("l_orderkey").alias("fam"), F.col("l_partkey").alias("p"), F.col("l_quantity").cast("long").alias("n"))
    o = o.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "fam")
    genes = o.groupBy("fam", "p").agg(F.max("n").alias("n")).withColumn("gene", F.col("p"))
    far = genes.alias("x").join(genes.alias("y"), "fam").where("x.gene < y.gene").select("fam", F.col("x.gene").alias("a"), F.col("y.gene").alias("b"), (1 + F.abs(F.col("x.n") - F.col("y.n"))).cast("double").alias("dist"))
    trees = families.gene_trees(far, genes.select("fam", "gene"))
    species = F.element_at(F.array(*map(F.lit, "ABCD")), (F.col("p") % 4 + 1).cast("int"))
    listed = genes.groupBy("fam").agg(F.array_sort(F.collect_list(F.struct(F.col("gene").cast("string").alias("gene"), species.alias("species"), (F.col("n") % 2).alias("locus")))).alias("genes"))
    return trees.join(listed, "fam")


@query()
def reconciliation(spark, d):
    found = families.reconcile(_recon_input(spark, d), SPECIES, Costs())
    return found.select("fam", "cost", "chosen_cost", "n_mprs", F.size("events").alias("n_events"))


@query()
def reconciliation_events(spark, d):
    return families.recon_events(families.reconcile(_recon_input(spark, d), SPECIES, Costs()))


@query()
def origin_families(spark, d):
    found = families.origin_families(families.reconcile(_recon_input(spark, d), SPECIES, Costs()))
    return found.select("source_fam", "root", "mrca", "locus", F.size("genes").alias("n_genes"), F.size("families").alias("n_families"))


#: A leaf for each of the five strains of the gene order.
STRAINS = "((((A:1,B:1)s3:1,C:2)s2:1,D:3)s1:1,E:4)s0;"


def _locus_order(spark, d):
    return A.gene_order(spark, d).withColumn("strain", F.element_at(F.array(*map(F.lit, "ABCDE")), (F.col("strain") + 1).cast("int")))


@query()
def locus_islands(spark, d):
    o = _locus_order(spark, d)
    members = o.select((F.col("gene") % 400).alias("lf"), "strain", "gene")
    near = islands.near_families(members, order.proximity(o, 2), 2)
    mrca = F.element_at(F.array(*map(F.lit, ["s3", "s2", "s1", "s0", "A"])), (F.col("lf") % 5 + 1).cast("int"))
    return islands.make_islands(members.select("lf").distinct().withColumn("mrca", mrca), near, STRAINS).select("id", "mrca", _text("lfs"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    importlib.import_module("cladescope.plans.derived")
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    importlib.import_module("cladescope.plans.derived")
    return dict(SQL)
